"""Configuration data: column roles, cut tables, caps, rule tables and model runs.

Nothing here computes anything.  Every operator takes these objects as
arguments, so another portfolio only needs another set of tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

CE = "CE"
SE = "SE"


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in the modelling table."""

    customer: str = "identificacionCliente"
    month: str = "codigoPeriodoConcesion"
    label: str = "y"
    history: str = "numeroRegistrosRiesgo"
    reports: str = "reportesActivoU12m"
    overdue: str = "moraMesAnterior"
    score: str = "scoreBuro"
    rating: str = "clasificacion"
    tenure: str = "antiguedadBuroSBS"
    balance: str = "saldoCuentas"
    balance_u3m: str = "avgSaldoCuentasU3M"
    balance_u6m: str = "avgSaldoCuentasU6M"
    row_id: str | None = None
    segment: str = "experiencia"
    part: str = "particion"
    evident: str = "maloEvidente"
    weight: str = "weight"

    def column(self, role: str) -> str:
        return getattr(self, role)

    @property
    def identifiers(self) -> list[str]:
        return [self.customer, self.month, self.label, self.segment, self.part, self.weight]

    @property
    def candidates(self) -> list[str]:
        return [self.score, self.rating, self.tenure, self.balance]

    @property
    def winsorized(self) -> list[str]:
        return [self.tenure, self.balance]


DEFAULT_ROLES = Roles()

# The table derived in ``sources.mdt`` uses these names.
FIXTURE_ROLES = Roles(
    customer="identificacion_cliente",
    month="codigo_periodo",
    history="numero_registros_riesgo",
    reports="reportes_u12m",
    overdue="mora_mes_anterior",
    score="score_buro",
    tenure="antiguedad_buro",
    balance="saldo_cuentas",
    balance_u3m="avg_saldo_u3m",
    balance_u6m="avg_saldo_u6m",
    row_id="row_id",
    evident="malo_evidente",
)


@dataclass(frozen=True)
class CohortLimits:
    """Thresholds of the cohort preparation."""

    min_history: int = 12
    min_reports: int = 6
    start_month: int = 202401
    test_month: int = 202411
    max_overdue: int = 90


DEFAULT_LIMITS = CohortLimits()
FIXTURE_LIMITS = replace(DEFAULT_LIMITS, start_month=199801, test_month=200006)


@dataclass(frozen=True)
class CutMap:
    """Ascending cuts and one value per bin; ``right_closed`` means bins ``(a, b]``."""

    cuts: tuple
    values: tuple
    missing: object
    right_closed: bool = True

    def __post_init__(self):
        if len(self.values) != len(self.cuts) + 1:
            raise ValueError("a cut map needs one value more than cuts")
        if list(self.cuts) != sorted(set(self.cuts)):
            raise ValueError("cuts must be strictly ascending")


@dataclass(frozen=True)
class CodeMap:
    """Equality map on a numeric code with a default for everything else."""

    codes: tuple
    values: tuple
    default: object


# --- fixed values: class weights (bad, good) per segment ---------------------
CLASS_WEIGHTS = {CE: (16.22, 0.515), SE: (12.74, 0.520)}

# --- fixed values: hard caps, role -> segment -> (lower, upper) ---------------
HARD_CAPS = {
    "balance": {CE: (0.0, 9855.32), SE: (0.0, 9163.58)},
    "tenure": {CE: (None, 227.0), SE: (None, 219.0)},
}

# --- fixed values: hand-cut bin labels ----------------------------------------
BIN_LABELS = {
    (CE, "balance"): CutMap((7.26, 63.0, 200.0, 552.0), ("c_4", "c_3", "c_2", "c_1", "c_0"), "c_2"),
    (CE, "tenure"): CutMap((25.0, 41.0, 71.0, 140.0), ("c_4", "c_3", "c_2", "c_1", "c_0"), "c_4"),
    (SE, "balance"): CutMap((6.14, 92.0, 469.0, 1028.0), ("c_4", "c_3", "c_2", "c_1", "c_0"), "c_4"),
    (SE, "tenure"): CutMap((20.0, 54.0, 128.0), ("c_4", "c_2", "c_1", "c_0"), "c_3"),
}

# --- fixed values: weight of evidence per bin, lowest bin first ----------------
WOE_MAPS = {
    (CE, "balance"): CutMap(
        (7.26, 63.0, 200.0, 552.0), (-0.6276, -0.2367, -0.0476, 0.2025, 0.4944), -0.0476
    ),
    (CE, "score"): CutMap(
        (800, 894, 920, 960, 971, 979),
        (-1.3359, -0.6230, -0.3504, -0.069, 0.3419, 0.54579, 1.1462),
        -1.3359,
        right_closed=False,
    ),
    (CE, "tenure"): CutMap(
        (25.0, 41.0, 71.0, 140.0), (-0.3446, -0.0939, -0.02339, 0.18447, 0.3883), -0.3446
    ),
    (CE, "balance_u3m"): CutMap(
        (39.01, 132.92, 424.92, 792.97), (-0.5492, -0.2448, 0.0361, 0.2556, 0.4275), 0.0203
    ),
    (CE, "balance_u6m"): CutMap(
        (67.44, 275.64, 495.0, 1119.13), (-0.4425, -0.1247, 0.0353, 0.2291, 0.3180), 0.0203
    ),
    (SE, "balance"): CutMap(
        (6.14, 92.0, 469.0, 1028.0), (-0.79418, -0.1453, 0.2153, 0.5191, 0.7714), -0.79418
    ),
    (SE, "tenure"): CutMap((20.0, 54.0, 128.0), (-0.19288, 0.0798, 0.1362, 0.40036), -0.15734),
    (SE, "score"): CutMap(
        (800, 869, 873, 920, 940, 960, 972),
        (-0.3607, -0.4028, -0.22657, -0.1344, 0.06496, 0.4246, 0.532, 1.20337),
        -0.3607,
        right_closed=False,
    ),
    (SE, "balance_u3m"): CutMap(
        (37.69, 153.48, 287.13, 657.85), (-0.7477, -0.1541, 0.1631, 0.3047, 0.6672), -0.9295
    ),
    (SE, "balance_u6m"): CutMap(
        (53.10, 166.43, 302.54, 865.21), (-0.7385, -0.1050, 0.0895, 0.3714, 0.6334), -0.9295
    ),
}

RATING_WOE = {
    CE: CodeMap((1, 2, 3), (0.6764, 0.0757, -0.378), -0.93167),
    SE: CodeMap(
        (1, 2, 3, 4, 5, 6), (0.876159, 0.32346, -0.2124, -0.48007, -0.2144, -0.48007), -0.2144
    ),
}

# --- fixed values: reading guide of the information value, [low, high) --------
IV_STRENGTH = CutMap(
    (0.02, 0.1, 0.3, 0.5),
    ("sin poder predictivo", "debil", "medio", "fuerte", "sospechoso"),
    None,
    right_closed=False,
)

# --- fixed values: profile rule tables ----------------------------------------
# (score_min, score_max, balance_min, balance_max, include_missing, label);
# limits are >= min and < max unless written as (value, inclusive); the first
# matching rule wins; C_1 is the riskiest profile.
NO_PROFILE = "Sin Perfil"

RULES_FA_CE = [
    (979, None, 63, None, False, "C_11"),
    (960, 979, 552, None, False, "C_10"),
    (960, 979, 63, 552, False, "C_9"),
    (960, None, 7.26, 63, False, "C_8"),
    (894, 960, (552, False), None, False, "C_7"),
    (960, None, None, (7.26, True), False, "C_6"),
    (894, 960, 63, (552, True), False, "C_5"),
    (920, 960, 7.26, 63, False, "C_4"),
    (None, 894, 63, None, False, "C_3"),
    (920, 960, None, 7.26, False, "C_2"),
    (None, 920, None, 63, False, "C_1"),
]
RULES_FA_SE = [
    (972, None, 92, None, False, "C_12"),
    (940, 972, 469, None, False, "C_11"),
    (940, 972, 92, 469, False, "C_10"),
    (None, 940, 1028, None, False, "C_9"),
    (940, None, 6.14, 92, False, "C_8"),
    (None, 940, 469, 1028, False, "C_7"),
    (869, 940, 92, 469, False, "C_6"),
    (940, None, None, 6.14, False, "C_5"),
    (None, 869, 92, 469, False, "C_4"),
    (873, 940, 6.14, 92, False, "C_3"),
    (None, 873, 6.14, 92, False, "C_2"),
    (None, 940, None, 6.14, False, "C_1"),
]
RULES_U3M_CE = [
    (None, 920, None, 132.92, True, "C_1"),
    (920, 960, None, 39.01, False, "C_2"),
    (None, 894, 132.92, None, False, "C_3"),
    (920, 960, 39.01, 132.92, True, "C_4"),
    (894, 960, 132.92, 424.92, False, "C_5"),
    (960, 979, None, 132.92, False, "C_6"),
    (894, 960, 424.92, None, False, "C_7"),
    (960, 971, 132.92, None, True, "C_8"),
    (971, 979, 132.92, None, True, "C_9"),
    (979, None, None, 424.92, True, "C_10"),
    (979, None, 424.92, None, False, "C_11"),
]
RULES_U3M_SE = [
    (None, 940, None, 37.69, True, "C_1"),
    (None, 873, 37.69, 153.48, False, "C_2"),
    (873, 940, 37.69, 153.48, False, "C_3"),
    (940, None, None, 37.69, True, "C_4"),
    (None, 873, 153.48, 657.85, False, "C_5"),
    (873, 940, 153.48, 657.85, False, "C_6"),
    (None, 869, 657.85, None, False, "C_7"),
    (869, 940, 657.85, None, False, "C_8"),
    (940, None, 37.69, 153.48, False, "C_9"),
    (940, 972, 153.48, 657.85, False, "C_10"),
    (940, 972, 657.85, None, False, "C_11"),
    (972, None, 153.48, None, False, "C_12"),
]
RULES_U6M_CE = [
    (None, 894, None, 275.64, False, "C_1"),
    (None, 894, 275.64, None, True, "C_2"),
    (894, 960, None, 67.44, False, "C_3"),
    (894, 960, 67.44, 495, True, "C_4"),
    (894, 960, 495, 1119.13, False, "C_5"),
    (894, 960, 1119.13, None, False, "C_6"),
    (960, 979, None, 275.64, False, "C_7"),
    (960, 971, 275.64, None, True, "C_8"),
    (971, 979, 275.64, None, True, "C_9"),
    (979, None, None, 495, True, "C_10"),
    (979, None, 495, None, False, "C_11"),
]
RULES_U6M_SE = [
    (None, 940, None, 53.1, True, "C_1"),
    (None, 873, 53.1, 302.54, False, "C_2"),
    (940, None, None, 53.1, True, "C_3"),
    (873, 940, 53.1, 302.54, False, "C_4"),
    (None, 920, 302.54, None, False, "C_5"),
    (940, 972, 53.1, 302.54, False, "C_6"),
    (920, 940, 302.54, None, False, "C_7"),
    (940, 972, 302.54, None, False, "C_8"),
    (972, None, 53.1, None, False, "C_9"),
]
# Earlier tables, kept because they show the gaps the current ones close.
RULES_FA_CE_ORIGINAL = [
    (894, 960, 63, 552, False, "C_5") if rule[-1] == "C_5" else rule for rule in RULES_FA_CE
]
RULES_FA_SE_ORIGINAL = [
    (None, 920, None, 6.14, False, "C_1") if rule[-1] == "C_1" else rule for rule in RULES_FA_SE
]


@dataclass(frozen=True)
class ProfileRun:
    """One profile column: its three inputs, its output and its two rule tables."""

    model_type: str
    score: str
    balance: str
    output: str
    ce: tuple
    se: tuple


PROFILE_RUNS = {
    "fa": ProfileRun(
        "tipoModeloFA", "scoreBuroFA", "saldoCuentasFA", "perfilesReglasFA",
        tuple(RULES_FA_CE), tuple(RULES_FA_SE),
    ),
    "12d": ProfileRun(
        "tipoModelo12D", "scoreBuro12D", "saldoCuentas12D", "perfilesReglas12D",
        tuple(RULES_FA_CE), tuple(RULES_FA_SE),
    ),
    "u3m": ProfileRun(
        "tipoModeloFA", "scoreBuroFA", "avgSaldoCuentasU3M", "perfilesReglasU3M",
        tuple(RULES_U3M_CE), tuple(RULES_U3M_SE),
    ),
    "u6m": ProfileRun(
        "tipoModeloFA", "scoreBuroFA", "avgSaldoCuentasU6M", "perfilesReglasU6M",
        tuple(RULES_U6M_CE), tuple(RULES_U6M_SE),
    ),
}
# --- end of the fixed rule tables ----------------------------------------------


@dataclass(frozen=True)
class ModelRun:
    """One tree: its segment, its features (role, "woe" or "raw") and its depth."""

    model_id: str
    segment: str
    features: tuple
    max_depth: int = 4

    def feature_columns(self, roles: Roles) -> list[str]:
        return [
            roles.column(role) + ("_woe" if kind == "woe" else "") for role, kind in self.features
        ]


_WOE_SCORE = ("score", "woe")
_RAW_SCORE = ("score", "raw")

MODEL_RUNS = [
    ModelRun("T1", CE, (("balance", "woe"), _RAW_SCORE)),
    ModelRun("T2", SE, (("tenure", "woe"), ("balance", "woe"), _RAW_SCORE)),
    ModelRun("T3", SE, (("balance", "woe"), _WOE_SCORE)),
    ModelRun("T4", CE, (("balance", "woe"), _WOE_SCORE)),
    ModelRun("T5", CE, (("balance_u3m", "woe"), _WOE_SCORE)),
    ModelRun("T6", CE, (("balance_u6m", "woe"), _WOE_SCORE)),
    ModelRun("T7", SE, (("balance_u3m", "woe"), _WOE_SCORE)),
    ModelRun("T8", SE, (("balance_u6m", "woe"), _WOE_SCORE)),
]
GRID_RUNS = [
    ModelRun("grid-CE", CE, (("tenure", "woe"), ("balance", "woe"), _RAW_SCORE), 5),
    ModelRun("grid-SE", SE, (("tenure", "woe"), ("balance", "woe"), _RAW_SCORE), 5),
]
# Both features as they are, nearly continuous ones included.
RAW_RUNS = [ModelRun(f"raw-{s}", s, (("balance", "raw"), _RAW_SCORE)) for s in (CE, SE)]
GRID_DEPTHS = (3, 4, 5)
LEAF_SHARE = 0.05
RAW_SCORE_MISSING = 0.0
