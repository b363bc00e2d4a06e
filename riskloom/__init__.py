"""Credit-scorecard analytics as Spark DataFrame plans."""

from riskloom.settings import DEFAULT_LIMITS, DEFAULT_ROLES, CohortLimits, CutMap, Roles

__all__ = ["DEFAULT_LIMITS", "DEFAULT_ROLES", "CohortLimits", "CutMap", "Roles"]
