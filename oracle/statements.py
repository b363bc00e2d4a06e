"""DuckDB statements that state each registered query's result in SQL.

They are written from the definitions (FIXTURES.md, README.md) with their own SQL text;
only configuration values (cuts, rules, caps) come from ``riskloom.settings``.
"""

from __future__ import annotations

from riskloom.functions.cuts import bins_of
from riskloom.settings import (
    BIN_LABELS, CLASS_WEIGHTS, GRID_RUNS, HARD_CAPS, MODEL_RUNS, NO_PROFILE, RATING_WOE, RAW_RUNS,
    RULES_FA_CE, RULES_FA_CE_ORIGINAL, RULES_FA_SE, RULES_FA_SE_ORIGINAL, RULES_U3M_CE,
    RULES_U3M_SE, RULES_U6M_CE, RULES_U6M_SE, WOE_MAPS,
)

COLUMN = {
    "score": "score_buro", "balance": "saldo_cuentas", "tenure": "antiguedad_buro",
    "balance_u3m": "avg_saldo_u3m", "balance_u6m": "avg_saldo_u6m",
}
MEASURED = ["antiguedad_buro", "saldo_cuentas", "avg_saldo_u3m", "avg_saldo_u6m"]
PROFILED = ["score_buro", *MEASURED, "y"]

MDT = """
select o_orderkey as row_id, o_custkey as identificacion_cliente,
 cast(year(o_orderdate)*100+month(o_orderdate) as int) as codigo_periodo,
 cast(case when (o_orderkey*7919)%1000 < 160 - ((o_orderkey*37)%300 - (o_orderkey*37)%3) / 3 - case when c_acctbal>3000 then 30 else 0 end then 1 else 0 end as int) as y,
 cast(6+o_orderkey%30 as int) as numero_registros_riesgo, cast(o_custkey%13 as int) as reportes_u12m,
 cast((o_orderkey*31)%120 as int) as mora_mes_anterior,
 cast(case when o_orderkey%29=0 then null else 700+(o_orderkey*37)%300 end as int) as score_buro,
 cast(1+o_orderkey%6 as varchar(1)) as clasificacion,
 cast(case when o_orderkey%23=0 then null else (o_orderkey*13)%260 end as double) as antiguedad_buro,
 case when o_orderkey%17=0 then null else c_acctbal/8 end as saldo_cuentas,
 case when o_orderkey%19=0 then null else o_totalprice/512 end as avg_saldo_u3m,
 case when o_orderkey%31=0 then null else o_totalprice/400 end as avg_saldo_u6m,
 case when o_orderkey%37=0 then null when o_custkey%13>=6 then 'MOD_CE' else 'MOD_SE' end as tipo_modelo_fa,
 case when (o_custkey+1)%13>=6 then 'MOD_CE' else 'MOD_SE' end as tipo_modelo_12d,
 cast(700+(o_orderkey*53)%300 as int) as score_12d,
 case when o_orderkey%13=0 then null else c_acctbal/16 end as saldo_12d
from orders join customer on o_custkey=c_custkey
"""

_WEIGHT = "case experiencia " + " ".join(
    f"when '{s}' then case when y = 1 then cast({b} as double) else cast({g} as double) end"
    for s, (b, g) in CLASS_WEIGHTS.items()
) + " end"

# Steps in the order in which they are defined: maturity, dedupe, segment, month, evident bads.
STEPS = f"""
mdt as materialized ({MDT}),
maduro as (select * from mdt
  where ((numero_registros_riesgo >= 12 and y = 0) or y = 1) and y is not null),
unico as (select * exclude (orden) from (
  select *, row_number() over (partition by identificacion_cliente, codigo_periodo
    order by y desc, row_id) as orden from maduro) where orden = 1),
cohorte as (select *,
  case when reportes_u12m >= 6 then 'CE' else 'SE' end as experiencia,
  case when codigo_periodo < 200006 then 'train' else 'test' end as particion,
  cast(case when mora_mes_anterior > 90 then 1 else 0 end as int) as malo_evidente
  from unico where codigo_periodo >= 199801),
base as materialized (select *, {_WEIGHT} as weight from cohorte where malo_evidente = 0)
"""


def r(expr: str, digits: int = 6) -> str:
    """Rounded, and without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0::double)"


def with_steps(body: str, *more: str) -> str:
    return "with recursive " + ",\n".join([STEPS, *more]) + "\n" + body


def num(value) -> str:
    return "null" if value is None else f"cast({value!r} as double)"


def text(value) -> str:
    return "null" if value is None else f"'{value}'"


def cut_case(column: str, table, show) -> str:
    sign = "<=" if table.right_closed else "<"
    arms = "".join(
        f" when {column} {sign} {num(cut)} then {show(v)}" for cut, v in zip(table.cuts, table.values)
    )
    return f"case when {column} is null then {show(table.missing)}{arms} else {show(table.values[-1])} end"


def segment_case(choices: dict) -> str:
    return "case experiencia " + " ".join(f"when '{s}' then {e}" for s, e in choices.items()) + " end"


def mapped(maps: dict, role: str, show) -> str:
    return segment_case(
        {s: cut_case(COLUMN[role], t, show) for (s, known), t in maps.items() if known == role}
    )


def code_case(table) -> str:
    arms = "".join(
        f" when try_cast(clasificacion as float) = {c} then {num(v)}"
        for c, v in zip(table.codes, table.values)
    )
    return f"case{arms} else {num(table.default)} end"


def woe_columns() -> str:
    roles = dict.fromkeys(role for _, role in WOE_MAPS)
    return ", ".join(f"{mapped(WOE_MAPS, role, num)} as {COLUMN[role]}_woe" for role in roles)


RATING = segment_case({s: code_case(t) for s, t in RATING_WOE.items()})
WOE_BASE = f"woe as materialized (select *, {woe_columns()}, {RATING} as clasificacion_woe from base)"
LABELLED = (
    "etiquetas as (select *, "
    + ", ".join(f"{mapped(BIN_LABELS, role, text)} as {COLUMN[role]}_bin" for role in ("balance", "tenure"))
    + " from base)"
)


def stacked(source: str, columns, name: str, keep: str = "experiencia", cast: str = "double") -> str:
    """One row per source row and column."""
    parts = [
        f"select {keep}, '{c}' as variable, cast({c} as {cast}) as {name} from {source}" for c in columns
    ]
    return " union all ".join(parts)


# --- profiles -------------------------------------------------------------------
def limit_tests(column: str, low, high) -> list[str]:
    found = []
    if low is not None:
        value, closed = low if isinstance(low, tuple) else (low, True)
        found.append(f"{column} {'>=' if closed else '>'} {num(value)}")
    if high is not None:
        value, closed = high if isinstance(high, tuple) else (high, False)
        found.append(f"{column} {'<=' if closed else '<'} {num(value)}")
    return found


def rule_test(rule, score: str, balance: str) -> str:
    s_low, s_high, b_low, b_high, missing, _ = rule
    tests = limit_tests(score, s_low, s_high)
    inner = " and ".join(limit_tests(balance, b_low, b_high)) or "true"
    tests.append(f"(({inner}) or {balance} is null)" if missing else f"({inner})")
    return " and ".join(tests)


def rule_case(rules, score: str, balance: str) -> str:
    arms = "".join(f" when {rule_test(x, score, balance)} then '{x[-1]}'" for x in rules)
    return f"case{arms} else '{NO_PROFILE}' end"


def rule_count(rules, score: str, balance: str) -> str:
    return " + ".join(f"case when {rule_test(x, score, balance)} then 1 else 0 end" for x in rules)


PROFILE_TABLES = {
    "fa": ("tipo_modelo_fa", "score_buro", "saldo_cuentas", "perfilesReglasFA", RULES_FA_CE, RULES_FA_SE),
    "12d": ("tipo_modelo_12d", "score_12d", "saldo_12d", "perfilesReglas12D", RULES_FA_CE, RULES_FA_SE),
    "u3m": ("tipo_modelo_fa", "score_buro", "avg_saldo_u3m", "perfilesReglasU3M", RULES_U3M_CE, RULES_U3M_SE),
    "u6m": ("tipo_modelo_fa", "score_buro", "avg_saldo_u6m", "perfilesReglasU6M", RULES_U6M_CE, RULES_U6M_SE),
    "original": ("tipo_modelo_fa", "score_buro", "saldo_cuentas", "perfilesOriginales",
                 RULES_FA_CE_ORIGINAL, RULES_FA_SE_ORIGINAL),
}


def profile_case(name: str) -> str:
    kind, score, balance, _, ce, se = PROFILE_TABLES[name]
    return (
        f"case when {kind} like '%CE' then {rule_case(ce, score, balance)} "
        f"else {rule_case(se, score, balance)} end"
    )


def profile_select(*names: str) -> str:
    shown = ", ".join(f"{profile_case(n)} as \"{PROFILE_TABLES[n][3]}\"" for n in names)
    return f"with mdt as ({MDT}) select row_id, {shown} from mdt"


def limits_of(rows, places) -> str:
    found = {x[0] if isinstance(x, tuple) else x for r in rows for x in (r[i] for i in places)}
    shown = [num(float(x)) for x in sorted(x for x in found if x is not None)]
    return ", ".join(f"({x})" for x in [*shown, "cast(null as double)"])


def audit() -> str:
    parts = []
    for name, (kind, score, balance, _, ce, se) in PROFILE_TABLES.items():
        limits = (
            f"(select * from (select distinct {kind} from mdt) "
            f"cross join (values {limits_of([*ce, *se], (0, 1))}) a({score}) "
            f"cross join (values {limits_of([*ce, *se], (2, 3))}) b({balance}))"
        )
        for origin, source in (("datos", "mdt"), ("limites", limits)):
            parts.append(
                f"select '{origin}' as origen, '{name}' as tabla, "
                f"case when {kind} like '%CE' then 'CE' else 'SE' end as rama, "
                f"({score} is null or {balance} is null) as con_nulos, "
                f"cast(case when {kind} like '%CE' then {rule_count(ce, score, balance)} "
                f"else {rule_count(se, score, balance)} end as int) as coincidencias, "
                f"{profile_case(name)} as perfil from {source}"
            )
    return (
        f"with mdt as ({MDT}), puntos as ({' union all '.join(parts)}) "
        "select origen, tabla, rama, con_nulos, coincidencias, perfil, count(*) as filas from puntos group by all"
    )


def profile_tables() -> str:
    parts = [f"select row_id, '{n}' as perfil_de, {profile_case(n)} as perfil from mdt" for n in ("fa", "12d", "u3m", "u6m")]
    return f"with mdt as ({MDT}) " + " union all ".join(parts)


def rectangles() -> str:
    """Cells between all limits of a table, rules that hold at a point of each, and runs of equal cells."""
    rules, points = [], []

    def ends(limit, plain):
        value, closed = limit if isinstance(limit, tuple) else (limit, plain)
        return (num(None if value is None else float(value)), "true" if closed else "false")

    for name, (kind, score, balance, _, ce, se) in PROFILE_TABLES.items():
        for branch, table in (("CE", ce), ("SE", se)):
            test = f"{kind} like '%CE'" if branch == "CE" else f"coalesce({kind} not like '%CE', true)"
            points.append(f"select '{name}_{branch}' as tabla, cast({score} as double) as s, {balance} as b from mdt where {test}")
            for order, (s0, s1, b0, b1, missing, label) in enumerate(table):
                shown = [x for v, plain in ((s0, True), (s1, False), (b0, True), (b1, False)) for x in ends(v, plain)]
                rules.append(f"('{name}_{branch}', {order}, {', '.join(shown)}, {'true' if missing else 'false'}, '{label}')")

    def axis(a):
        return f"""paso_{a} as (select tabla, lim, estricto, row_number() over (partition by tabla order by lim, estricto) as k
            from (select tabla, {a}0 as lim, not {a}0_in as estricto from reglas where {a}0 is not null
              union select tabla, {a}1, {a}1_in from reglas where {a}1 is not null)),
          tramo_{a} as (select t.tabla, t.k, lo.lim as lo, not lo.estricto as lo_in, hi.lim as hi, hi.estricto as hi_in, false as nulo,
              case when lo.lim is null then coalesce(hi.lim - 1, 0.0) when not lo.estricto then lo.lim
                else coalesce((lo.lim + hi.lim) / 2, lo.lim + 1) end as punto
            from (select tabla, k from paso_{a} union select tabla, 0 from reglas) t
            left join paso_{a} lo on lo.tabla = t.tabla and lo.k = t.k left join paso_{a} hi on hi.tabla = t.tabla and hi.k = t.k + 1
            union all select distinct tabla, -2, null::double, null, null::double, null, true, null::double from reglas)"""

    def holds(a, v):
        return (f"({a}0 is null or ({v} >= {a}0 and ({v} > {a}0 or {a}0_in))) and "
                f"({a}1 is null or ({v} <= {a}1 and ({v} < {a}1 or {a}1_in)))")

    def inside(a, v):
        return (f"case when z.{a}_nulo then {v} is null else {v} is not null and "
                f"(z.{a}_lo is null or {v} > z.{a}_lo or ({v} = z.{a}_lo and z.{a}_lo_in)) and "
                f"(z.{a}_hi is null or {v} < z.{a}_hi or ({v} = z.{a}_hi and z.{a}_hi_in)) end")

    return f"""with mdt as ({MDT}),
      reglas(tabla, orden, s0, s0_in, s1, s1_in, b0, b0_in, b1, b1_in, missing, label) as (values {', '.join(rules)}),
      {axis('s')}, {axis('b')},
      celda as (select x.tabla, x.k as i, y.k as j, coalesce(string_agg(r.label, ',' order by r.orden), '') as reglas,
          count(r.label) as n, arg_min(r.label, r.orden) as gana
        from tramo_s x join tramo_b y on x.tabla = y.tabla left join reglas r on r.tabla = x.tabla
          and coalesce({holds('s', 'x.punto')}, false) and (coalesce({holds('b', 'y.punto')}, false) or (r.missing and y.nulo))
        group by all),
      tira as (select tabla, i, reglas, any_value(n) as n, any_value(gana) as gana, min(j) as j0, max(j) as j1
        from (select *, j - row_number() over (partition by tabla, i, reglas order by j) as isla from celda)
        where n <> 1 group by tabla, i, reglas, isla),
      caja as (select tabla, reglas, any_value(n) as n, any_value(gana) as gana, j0, j1, min(i) as i0, max(i) as i1
        from (select *, i - row_number() over (partition by tabla, reglas, j0, j1 order by i) as isla from tira)
        group by tabla, reglas, j0, j1, isla),
      zona as (select c.tabla, c.reglas, c.n, c.gana, a.lo as s_lo, a.lo_in as s_lo_in, z.hi as s_hi, z.hi_in as s_hi_in,
          a.nulo as s_nulo, b.lo as b_lo, b.lo_in as b_lo_in, y.hi as b_hi, y.hi_in as b_hi_in, b.nulo as b_nulo
        from caja c join tramo_s a on a.tabla = c.tabla and a.k = i0 join tramo_s z on z.tabla = c.tabla and z.k = i1
        join tramo_b b on b.tabla = c.tabla and b.k = j0 join tramo_b y on y.tabla = c.tabla and y.k = j1),
      punto as (select tabla, s, b, count(*) as n from ({' union all '.join(points)}) group by all)
      select z.tabla, case when z.n = 0 then 'hueco' else 'traslape' end as tipo, z.reglas, z.gana,
        s_lo as score_min, s_lo_in as score_min_incl, s_hi as score_max, s_hi_in as score_max_incl, s_nulo as score_nulo,
        {witness('s')} as testigo_score,
        b_lo as saldo_min, b_lo_in as saldo_min_incl, b_hi as saldo_max, b_hi_in as saldo_max_incl, b_nulo as saldo_nulo,
        {witness('b')} as testigo_saldo,
        cast(coalesce(sum(p.n), 0) as bigint) as filas
      from zona z left join punto p on p.tabla = z.tabla and ({inside('s', 'p.s')}) and ({inside('b', 'p.b')})
      group by all"""


def witness(a: str) -> str:
    return (f"case when {a}_nulo then null when {a}_lo is null then coalesce({a}_hi - 1, 0.0) when {a}_lo_in then {a}_lo "
            f"else coalesce(({a}_lo + {a}_hi) / 2, {a}_lo + 1) end")


# --- profiling --------------------------------------------------------------------
MARKS = ["1%", "5%", "10%", "25%", "50%", "75%", "90%", "95%", "99%"]
_MOMENTS = (
    "count(*) as registros, count(*) - count(v) as nulos, count(v) as count, "
    "avg(v) as mean, stddev_samp(v) as stddev, min(v) as min, max(v) as max"
)


def eda() -> str:
    marks = ", ".join(f'quantile_disc(v, {float(m[:-1]) / 100}) as "{m}"' for m in MARKS)
    shown = ", ".join(f'{r(chr(34) + m + chr(34))} as "{m}"' for m in MARKS)
    return with_steps(
        f"""select experiencia, variable, registros, nulos, {r('pn')} as "porcNulos", "count",
          {r('mean')} as mean, {r('stddev')} as stddev, {r('"min"')} as "min", {shown},
          {r('"max"')} as "max", {r('iqr')} as "iQR", {r('lo')} as "bandaInferior",
          {r('hi')} as "bandaSuperior", atipicos, {r('pa')} as "porcentajeAtipicos",
          case when pn > 50 and pa > 5 then 'Porcentaje de Nulos mayor al 50% y Porcentaje de Atipicos mayor al 5%'
               when pn > 50 then 'Porcentaje de Nulos mayor al 50%'
               when pa > 5 then 'Porcentaje de Atipicos mayor al 5%' end as observaciones
        from final""",
        f"largo as materialized ({stacked('base', PROFILED, 'v')})",
        f"momentos as (select experiencia, variable, {_MOMENTS}, {marks} from largo group by all)",
        """bandas as (select *, "75%" - "25%" as iqr, "25%" - 1.5 * ("75%" - "25%") as lo,
          "75%" + 1.5 * ("75%" - "25%") as hi from momentos)""",
        """fuera as (select experiencia, variable, count(*) filter (where v < lo or v > hi) as atipicos
          from largo join bandas using (experiencia, variable) group by all)""",
        """final as (select *, round(100.0 * nulos / registros, 2) as pn,
          round(100.0 * atipicos / registros, 2) as pa from bandas join fuera using (experiencia, variable))""",
    )


def eda_outliers() -> str:
    return with_steps(
        f"""select experiencia, variable, {r('lo')} as "bandaInferior", {r('hi')} as "bandaSuperior",
          count(*) filter (where v < lo or v > hi) as atipicos
        from largo join bandas using (experiencia, variable) group by experiencia, variable, lo, hi""",
        f"largo as materialized ({stacked('base', MEASURED, 'v')})",
        """bandas as (select experiencia, variable, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
          from (select experiencia, variable, quantile_disc(v, 0.25) as q1, quantile_disc(v, 0.75) as q3
                from largo group by all))""",
    )


# --- bins and IV ---------------------------------------------------------------------
def bin_measures(good: str = "g", bad: str = "b") -> dict:
    mixed = "event > 0 and non_event > 0"
    return {
        "woe": f"case when {mixed} then ln({good} / {bad}) else 0.0 end",
        "iv": f"case when {mixed} then ({good} - {bad}) * ln({good} / {bad}) else 0.0 end",
        "js": f"case when {mixed} then ({good} * ln({good} / (({good} + {bad}) / 2)) "
              f"+ {bad} * ln({bad} / (({good} + {bad}) / 2))) / 2 else 0.0 end",
    }


def measured_bins(source: str, extra: str = "") -> str:
    m = bin_measures()
    return f"""select experiencia, variable, bin, {extra} n as count, event, non_event,
      {r('n / tn')} as count_share, {r('case when n > 0 then event / n end')} as event_rate,
      {r(m['woe'])} as woe, {r(m['iv'])} as iv, {r(m['js'])} as js
    from (select *, cast(non_event as double) / tg as g, cast(event as double) / tb as b from (
      select *, sum(n) over p as tn, sum(event) over p as tb, sum(non_event) over p as tg
      from {source} window p as (partition by experiencia, variable)))"""


BIN_ROWS = (
    "conteo as (select experiencia, variable, bin, count(*) filter (where y = 0) as c0, "
    "count(*) filter (where y = 1) as c1 from ("
    + stacked("etiquetas", ["saldo_cuentas_bin", "antiguedad_buro_bin"], "bin", "experiencia, y", "varchar")
    + ") group by all)"
)
IV_ROWS = """iv_bins as (
  select a.experiencia, a.variable, a.bin, a.c0 as count_0, b.c1 as count_1,
    ln((a.c0 / t0) / (b.c1 / t1)) as woe, (a.c0 / t0 - b.c1 / t1) * ln((a.c0 / t0) / (b.c1 / t1)) as iv
  from (select * from conteo where c0 > 0) a
  left join (select * from conteo where c1 > 0) b
    on a.experiencia = b.experiencia and a.variable = b.variable and a.bin = b.bin
  join (select experiencia, variable, cast(sum(c0) as double) as t0, cast(sum(c1) as double) as t1
        from conteo group by all) t on t.experiencia = a.experiencia and t.variable = a.variable)"""

# Optimal binning: exact prebin edges, every feasible chain of prebins, the best one.
_PROBS = ", ".join(f"{i / 20}" for i in range(1, 20))
OPTBIN = [
    f"largo as materialized ({stacked('base', MEASURED, 'v', 'row_id, experiencia, y')})",
    f"""bordes as (select experiencia, variable,
      list_sort(list_distinct(quantile_disc(v, [{_PROBS}]))) as bordes from largo where v is not null group by all)""",
    """precortes as (select experiencia, variable,
        case when v is not null then len(list_filter(bordes, lambda e: e <= v)) end as pre,
        count(*) as n, cast(sum(y) as bigint) as e
      from largo join bordes using (experiencia, variable) group by all)""",
    """puntos as (select experiencia, variable, i, bordes[pre] as borde,
        cast(sum(n) over o as bigint) as cn, cast(sum(e) over o as bigint) as ce
      from (select *, row_number() over (partition by experiencia, variable order by pre) as i
            from precortes where pre is not null) join bordes using (experiencia, variable)
      window o as (partition by experiencia, variable order by i))""",
    """finales as (select experiencia, variable, max(i) as m, max(cn) as tn, max(ce) as te
      from puntos group by all)""",
    """marcas as (select experiencia, variable, i, cn, ce from puntos
      union all select experiencia, variable, 0, 0, 0 from finales)""",
    """tramos as materialized (select *, cast(e as double) / n as tasa, (g - b) * ln(g / b) as iv from (
        select a.experiencia, a.variable, a.i as lo, z.i as hi, z.cn - a.cn as n, z.ce - a.ce as e,
          cast((z.cn - a.cn) - (z.ce - a.ce) as double) / (tn - te) as g, cast(z.ce - a.ce as double) / te as b
        from marcas a join marcas z on a.experiencia = z.experiencia and a.variable = z.variable and a.i < z.i
        join finales f on f.experiencia = a.experiencia and f.variable = a.variable
        where z.cn - a.cn >= cast(0.1 as double) * tn and z.ce > a.ce and z.cn - a.cn > z.ce - a.ce))""",
    """cadenas as (
        select experiencia, variable, hi, [hi] as fin, sentido, tasa, iv, 1 as k
        from tramos, (values (1), (-1)) s(sentido) where lo = 0
      union all
        select c.experiencia, c.variable, t.hi, list_append(c.fin, t.hi), c.sentido, t.tasa, c.iv + t.iv, c.k + 1
        from cadenas c join tramos t on t.experiencia = c.experiencia and t.variable = c.variable and t.lo = c.hi
        where c.k < 5 and ((c.sentido = 1 and t.tasa >= c.tasa) or (c.sentido = -1 and t.tasa <= c.tasa)))""",
    """completas as (select c.experiencia, c.variable, fin, max(iv) as iv from cadenas c
        join finales f on f.experiencia = c.experiencia and f.variable = c.variable and c.hi = f.m group by all)""",
    """mejor as (select experiencia, variable, fin[1:len(fin) - 1] as cortes, round(iv, 12) as iv,
        count(*) over (partition by experiencia, variable) as factibles
      from completas qualify row_number() over (partition by experiencia, variable
        order by round(iv, 12) desc, len(fin), fin) = 1)""",
    """elegidos as materialized (select m.experiencia, m.variable, any_value(m.iv) as search_iv,
        any_value(factibles) as feasible,
        coalesce(list(borde order by borde) filter (where borde is not null), []::double[]) as splits
      from mejor m left join puntos p on p.experiencia = m.experiencia and p.variable = m.variable
        and list_contains(m.cortes, p.i - 1) group by m.experiencia, m.variable)""",
    """conteos as (select experiencia, variable, case when v is null then len(splits) + 1
        else len(list_filter(splits, lambda s: s <= v)) end as bin_no, count(*) as n, sum(y) as e
      from largo join elegidos using (experiencia, variable) group by all)""",
    """marco as (select experiencia, variable, len(splits) as n_splits, splits,
        unnest(range(0, len(splits) + 2)) as bin_no from elegidos)""",
    """filas as (select experiencia, variable, cast(bin_no as int) as bin_no, cast(n_splits as int) as n_splits,
        case when bin_no > n_splits then 'Missing' else
          case when bin_no = 0 then '(-inf' else '[' || printf('%.2f', round(splits[bin_no], 2)) end || ', ' ||
          case when bin_no = n_splits then 'inf' else printf('%.2f', round(splits[bin_no + 1], 2)) end || ')' end as bin,
        cast(coalesce(n, 0) as bigint) as n, cast(coalesce(e, 0) as bigint) as event,
        cast(coalesce(n, 0) - coalesce(e, 0) as bigint) as non_event
      from marco left join conteos using (experiencia, variable, bin_no))""",
]
_MARCO = "n_splits, bin_no,"
IV_SUM = f"""ranking as (select experiencia, variable, sum(iv) as iv_sum, max(n_splits) as n_splits,
  max(n_splits) > 1 as usable from (select *, {bin_measures()['iv']} as iv from (
    select *, cast(non_event as double) / sum(non_event) over p as g, cast(event as double) / sum(event) over p as b
    from filas window p as (partition by experiencia, variable))) group by all)"""
_STRENGTH = (
    "case when iv_sum < 0.02 then 'sin poder predictivo' when iv_sum < 0.1 then 'debil' "
    "when iv_sum < 0.3 then 'medio' when iv_sum < 0.5 then 'fuerte' else 'sospechoso' end"
)


# --- trees ------------------------------------------------------------------------------
def model_rows(runs, keep: str = "") -> str:
    """One row per data row and model: the features as x0, x1, x2."""
    parts = []
    for run in runs:
        xs = []
        for role, kind in run.features:
            name = COLUMN[role]
            xs.append(f"{name}_woe" if kind == "woe" else f"coalesce(cast({name} as double), 0.0)")
        xs += ["cast(null as double)"] * (3 - len(xs))
        shown = ", ".join(f"{x} as x{i}" for i, x in enumerate(xs))
        parts.append(
            f"select '{run.model_id}' as run, {shown}, y, weight, particion{keep} "
            f"from woe where experiencia = '{run.segment}'"
        )
    return " union all ".join(parts)


def gini(w: str, wb: str) -> str:
    return f"coalesce(2 * ({wb}) * (({w}) - ({wb})) / nullif({w}, 0), 0)"


def candidates(level: str, cells: str) -> list[str]:
    flat = " union all ".join(
        f"select run, node, min_leaf, {i} as feature, x{i} as v, n, bad, w, wb from {cells} "
        f"where n > 0 and x{i} is not null"
        for i in range(3)
    )
    decrease = f"{gini('tw', 'twb')} - {gini('uw', 'uwb')} - {gini('tw - uw', 'twb - uwb')}"
    return [
        f"""plano{level} as materialized (select run, node, feature, v, max(min_leaf) as min_leaf, sum(n) as n,
          sum(bad) as bad, sum(w) as w, sum(wb) as wb from ({flat}) group by run, node, feature, v)""",
        f"""corrido{level} as (select run, node, feature, v, min_leaf, lead(v) over o as sig,
          sum(n) over o as un, sum(w) over o as uw, sum(wb) over o as uwb, sum(n) over t as tn,
          sum(bad) over t as tbad, sum(w) over t as tw, sum(wb) over t as twb from plano{level}
          window o as (partition by run, node, feature order by v), t as (partition by run, node, feature))""",
        f"""cand{level} as materialized (select *, decrease / w as gain from (
          select run, node, feature, (v + sig) / 2 as threshold, {decrease} as decrease, cast(tn as bigint) as n,
            cast(tbad as bigint) as bad, tw as w, twb as wb, cast(un as bigint) as n_left
          from corrido{level} where un >= min_leaf and tn - un >= min_leaf and un < tn and tbad > 0 and tbad < tn))""",
    ]


def cells_cte(source: str, fit: str, held: str) -> str:
    return f"""celdas as (select run, x0, x1, x2,
      count(*) filter (where {fit}) as n, coalesce(sum(y) filter (where {fit}), 0) as bad,
      coalesce(sum(weight) filter (where {fit}), 0) as w,
      coalesce(sum(weight * y) filter (where {fit}), 0) as wb,
      count(*) filter (where {held}) as test_n, coalesce(sum(y) filter (where {held}), 0) as test_bad
      from {source} group by run, x0, x1, x2)"""


def grown(depth: int, min_leaf: str) -> list[str]:
    """CTEs that grow all trees from ``celdas`` to ``depth`` and name their nodes ``nodos``."""
    ctes = [f"c0 as materialized (select celdas.*, 1 as node, min_leaf from celdas join ({min_leaf}) using (run))"]
    for d in range(depth):
        ctes += candidates(str(d), f"(select * from c{d} where node >= {2 ** d})")
        ctes.append(
            f"""mejor{d} as materialized (select * from cand{d} qualify row_number() over (
              partition by run, node order by round(gain, 10) desc, feature, threshold) = 1)"""
        )
        ctes.append(
            f"""c{d + 1} as materialized (select c.* exclude (node), case when m.threshold is null then c.node
              else 2 * c.node + case when (case m.feature when 0 then x0 when 1 then x1 else x2 end) > m.threshold
              then 1 else 0 end end as node from c{d} c left join mejor{d} m on c.run = m.run and c.node = m.node)"""
        )
    inner = " union all ".join(
        f"select run, node, n, bad, w, wb, feature, threshold, decrease from mejor{d}" for d in range(depth)
    )
    ctes.append(f"""nodos as materialized (select *, cast(length(bin(node)) - 1 as int) as depth, round(wb / w, 12) as p_bad,
      feature is null as is_leaf from ({inner} union all
      select run, node, cast(sum(n) as bigint), cast(sum(bad) as bigint), sum(w), sum(wb), null, null, null
      from c{depth} group by run, node having sum(n) > 0))""")
    return ctes


LEAF5 = "select run, cast(floor(cast(0.05 as double) * sum(n)) as bigint) as min_leaf from celdas group by run"


def names_cte(runs) -> str:
    rows = ", ".join(
        f"('{run.model_id}', {i}, '{COLUMN[role]}{'_woe' if kind == 'woe' else ''}', '{role}', '{kind}')"
        for run in runs for i, (role, kind) in enumerate(run.features)
    )
    return f"nombres as (select * from (values {rows}) t(run, feature, variable, rol, tipo))"


def tree_steps(runs=MODEL_RUNS, depth: int = 4) -> list[str]:
    return [
        WOE_BASE,
        f"filas_modelo as ({model_rows(runs)})",
        cells_cte("filas_modelo", "particion = 'train'", "particion = 'test'"),
        *grown(depth, LEAF5),
        names_cte(runs),
    ]


LIMITS = """limites as materialized (select h.run, h.node as leaf, a.feature,
    max(case when (h.node >> (k - 1)) % 2 = 1 then a.threshold end) as lo,
    min(case when (h.node >> (k - 1)) % 2 = 0 then a.threshold end) as hi
  from (select run, node, unnest(range(1, depth + 1)) as k from nodos where is_leaf) h
  join nodos a on a.run = h.run and a.node = (h.node >> k) and not a.is_leaf
  group by h.run, h.node, a.feature)"""


def scores_cte(nodes: str = "nodos", depth: int = 4) -> str:
    return f"""puntajes as (select run, particion, p as score, sum(n) as n, sum(bad) as bad from (
        select c.run, 'train' as particion, d.p_bad as p, c.n, c.bad from c{depth} c join {nodes} d using (run, node)
        union all
        select c.run, 'test', d.p_bad, c.test_n, c.test_bad from c{depth} c join {nodes} d using (run, node))
      group by all having sum(n) > 0)"""


def auc_select(source: str, keys: str) -> str:
    return f"""select {keys}, cast(sum(n) as bigint) as n, cast(sum(bad) as bigint) as bad,
      sum(cast(bad as double) * (debajo + (n - bad) / 2.0)) / nullif(cast(sum(bad) as double) * sum(n - bad), 0) as auc
      from (select *, coalesce(sum(n - bad) over (partition by {keys} order by score
        rows between unbounded preceding and 1 preceding), 0) as debajo from {source}) group by {keys}"""


def roc_select(source: str, keys: str) -> str:
    return f"""select {keys}, score as threshold,
      cast(sum(bad) over (partition by {keys} order by score desc) as double) / nullif(sum(bad) over (partition by {keys}), 0) as tpr,
      cast(sum(n - bad) over (partition by {keys} order by score desc) as double) / nullif(sum(n - bad) over (partition by {keys}), 0) as fpr
      from {source}"""


def youden_select(curve: str, keys: str) -> str:
    return f"""select {keys}, round(tpr - fpr, 12) as ks,
      case when round(tpr - fpr, 12) > 0 then threshold end as cut from {curve}
      qualify row_number() over (partition by {keys} order by round(tpr - fpr, 12) desc, threshold desc) = 1"""


SCORED = """puntajes as (select experiencia, particion, (1000 - score_buro) / cast(1024.0 as double) as score,
  count(*) as n, sum(y) as bad from base where score_buro is not null group by all)"""
_SP = "experiencia, particion"


def bins_cte(runs) -> str:
    rows = []
    for run in runs:
        for i, (role, kind) in enumerate(run.features):
            if kind != "woe":
                continue
            for b in bins_of(WOE_MAPS[(run.segment, role)]):
                left, _, right = b["text"].partition(", ")
                rows.append(
                    f"('{run.model_id}', {i}, {b['position']}, '{left}', '{right}', '{b['text']}', "
                    f"{num(b['value'])}, {'true' if b['is_missing'] else 'false'})"
                )
    return (
        "tramos_woe as (select * from (values " + ", ".join(rows)
        + ") t(run, feature, position, izq, der, bin, woe, is_missing))"
    )


LEAF_BINS = """hoja_tramos as materialized (select h.run, h.node as leaf, t.feature, t.position, izq, der, bin, woe, is_missing
  from nodos h join tramos_woe t on t.run = h.run and h.is_leaf
  left join limites l on l.run = h.run and l.leaf = h.node and l.feature = t.feature
  where (l.lo is null or woe > l.lo) and (l.hi is null or woe <= l.hi))"""
RANKED = """grupos as materialized (select run, node, n, p_bad, cast(n as double) / sum(n) over (partition by run) as muestra,
  case when p_bad > 0.5 then 'Malo' else 'Bueno' end as clase,
  'G' || row_number() over (partition by run order by p_bad, node) as grupo from nodos where is_leaf)"""
RANGES = """islas as (select run, leaf, feature, is_missing, min(position) as pos,
    arg_min(izq, position) || ', ' || arg_max(der, position) as t
  from (select *, position - row_number() over (partition by run, leaf, feature, is_missing order by position) as isla
        from hoja_tramos) group by run, leaf, feature, is_missing, isla)""", """rangos as (
  select run, leaf, feature, string_agg(case when is_missing then 'missing' else t end, ' o ' order by pos) as rango
  from islas group by all
  union all
  select l.run, l.leaf, l.feature, case when lo is null then '(-inf' else '(' || printf('%.2f', round(lo, 2)) end || ', ' ||
    case when hi is null then 'inf)' else printf('%.2f', round(hi, 2)) || ']' end
  from limites l join nombres n on n.run = l.run and n.feature = l.feature and n.tipo = 'raw')"""


def segment_steps(runs=MODEL_RUNS) -> list[str]:
    return [*tree_steps(runs), LIMITS, bins_cte(runs), LEAF_BINS, RANKED, *RANGES]


def leaf_segments() -> str:
    def axis(condition: str) -> str:
        return f"max(rango) filter (where {condition})"

    return with_steps(
        f"""select g.run, g.grupo, g.node, rango_score, rango_saldo, rango_antiguedad, g.n,
          {r('muestra')} as muestra, {r('p_bad')} as p_bad, clase
        from grupos g left join (select x.run, leaf, {axis("rol = 'score'")} as rango_score,
          {axis("rol like 'balance%'")} as rango_saldo, {axis("rol = 'tenure'")} as rango_antiguedad
          from rangos x join nombres n on n.run = x.run and n.feature = x.feature group by all) z
        on z.run = g.run and z.leaf = g.node""",
        *segment_steps(),
    )


def tree_rules() -> str:
    def part(sign: str, end: str) -> str:
        return f"variable || ' {sign} ' || printf('%.6f', round({end}, 6))"

    return with_steps(
        f"""select n.run, n.node, depth, coalesce(regla, '') as regla, n.n, {r('w - wb')} as peso_bueno,
          {r('wb')} as peso_malo, {r('p_bad')} as p_bad
        from nodos n left join (
          select l.run, leaf, string_agg(concat_ws(' AND ',
              case when lo is not null then {part('>', 'lo')} end,
              case when hi is not null then {part('<=', 'hi')} end), ' AND ' order by l.feature) as regla
          from limites l join nombres using (run, feature) group by all) t
        on t.run = n.run and t.leaf = n.node where is_leaf""",
        *tree_steps(), LIMITS,
    )


def risk_grid() -> str:
    runs = [run for run in MODEL_RUNS if run.model_id not in ("T1", "T2")]
    columns = list(dict.fromkeys(b["text"] for s in ("SE", "CE") for b in bins_of(WOE_MAPS[(s, "score")])))
    cell = "grupo || ' ' || printf('%.4f', round(p_bad, 4))"
    shown = ", ".join(f"max({cell}) filter (where c.bin = '{t}') as \"{t}\"" for t in columns)
    return with_steps(
        f"""select f.run, f.position as fila_pos, f.bin as fila_bin, {shown}
        from hoja_tramos f join hoja_tramos c on c.run = f.run and c.leaf = f.leaf and f.feature = 0 and c.feature = 1
        join grupos g on g.run = f.run and g.node = f.leaf group by all""",
        *segment_steps(runs),
    )


def risk_grid_cells() -> str:
    runs = [run for run in MODEL_RUNS if run.model_id not in ("T1", "T2")]
    return with_steps(
        f"""select f.run, f.position as fila_pos, f.bin as fila_bin, c.position as columna_pos, c.bin as columna_bin,
          grupo, {r('p_bad')} as p_bad
        from hoja_tramos f join hoja_tramos c on c.run = f.run and c.leaf = f.leaf and f.feature = 0 and c.feature = 1
        join grupos g on g.run = f.run and g.node = f.leaf""",
        *segment_steps(runs),
    )


def score_proba() -> str:
    return with_steps(
        f"""select row_id, experiencia, f.particion, f.run, {r('d.p_bad')} as p_malo
        from filas_con_id f join c4 c on c.run = f.run and c.x0 is not distinct from f.x0
          and c.x1 is not distinct from f.x1 and c.x2 is not distinct from f.x2
        join nodos d on d.run = c.run and d.node = c.node""",
        *tree_steps(), f"filas_con_id as ({model_rows(MODEL_RUNS, ', row_id, experiencia')})",
    )


def grid_steps() -> list[str]:
    """Folds 0-2 and the refit 'all' of both grids, cut off at depths 3, 4 and 5."""
    depth_rows = " union all ".join(
        f"""select c.run, {d} as max_depth, n.p_bad as score, c.test_n as n, c.test_bad as bad
        from c5 c join nodos n on n.run = c.run
          and n.node = case when length(bin(c.node)) - 1 > {d} then c.node >> (length(bin(c.node)) - 1 - {d}) else c.node end
        where not ends_with(c.run, '/all')"""
        for d in (3, 4, 5)
    )
    return [
        "woe as materialized (" + WOE_BASE[WOE_BASE.index("(") + 1:-1]
        + """ qualify row_number() over (partition by experiencia order by md5(row_id || ':13')) <=
            cast(floor(cast(0.1 as double) * count(*) over (partition by experiencia)) as bigint))""",
        "filas_modelo as (" + model_rows(
            GRID_RUNS, ", (row_number() over (partition by particion, y order by md5(row_id || ':17')) - 1) % 3 as fold"
        ) + ")",
        """filas_cv as (select * replace (run || '/' || case when via < 0 then 'all' else cast(via as varchar) end as run),
            particion = 'train' and (via < 0 or via <> fold) as ajusta,
            case when via < 0 then particion = 'test' else particion = 'train' and via = fold end as reserva
          from filas_modelo, (values (-1), (0), (1), (2)) v(via))""",
        cells_cte("filas_cv", "ajusta", "reserva"),
        *grown(5, """select a.run, min_leaf from (select distinct run from celdas) a join (
            select split_part(run, '/', 1) as modelo, cast(floor(cast(0.05 as double) * sum(n)) as bigint) as min_leaf
            from celdas where ends_with(run, '/all') group by all) b on b.modelo = split_part(a.run, '/', 1)"""),
        f"puntajes as (select run, max_depth, score, sum(n) as n, sum(bad) as bad from ({depth_rows}) group by all having sum(n) > 0)",
        f"aucs as ({auc_select('puntajes', 'run, max_depth')})",
        "medias as (select split_part(run, '/', 1) as run, max_depth, avg(auc) as m from aucs group by all)",
        """notas as (select run, max_depth, m, row_number() over (partition by run
            order by round(m, 10) desc, max_depth) = 1 as is_best from medias)""",
        names_cte(GRID_RUNS),
    ]


def importance(run: str, source: str) -> str:
    share = f"coalesce(dec / nullif(sum(dec) over (partition by {run}), 0), 0)"
    return f"""select run, variable, {r('share')} as importancia, cast(row_number() over (
      partition by run order by round(share, 12) desc, variable) as int) as rank
    from (select {run} as run, variable, {share} as share from {source})"""


def statements() -> dict[str, str]:
    found: dict[str, str] = {}
    mdt_only = f"with mdt as ({MDT}) "

    # cohort
    found["cohort_maturity"] = with_steps(
        "select row_id, identificacion_cliente, codigo_periodo, y, numero_registros_riesgo from maduro")
    found["cohort_dedupe"] = with_steps(
        "select identificacion_cliente, codigo_periodo, y, row_id from unico")
    found["segment_experience"] = mdt_only + (
        "select row_id, reportes_u12m, case when reportes_u12m >= 6 then 'CE' else 'SE' end as experiencia from mdt")
    found["split_out_of_time"] = mdt_only + (
        "select row_id, codigo_periodo, case when codigo_periodo < 200006 then 'train' else 'test' end as particion "
        "from mdt where codigo_periodo >= 199801")
    found["flag_evident_bad"] = with_steps(
        "select experiencia, particion, malo_evidente, count(*) as filas from cohorte group by all")
    found["modelling_base"] = with_steps(
        "select row_id, identificacion_cliente, codigo_periodo, y, experiencia, particion, weight, "
        "score_buro, clasificacion, antiguedad_buro, saldo_cuentas from base")
    found["class_weights"] = with_steps(
        f"""select experiencia, y, n, {r('sum(n) over (partition by experiencia) / (2.0 * n)')} as peso_balanceado,
          {_WEIGHT} as peso_fijo from (select experiencia, y, count(*) as n from base group by all)""")

    # outliers
    pair = ["antiguedad_buro", "saldo_cuentas"]
    found["winsorize"] = with_steps(
        "select row_id, experiencia, antiguedad_buro, saldo_cuentas, " + ", ".join(
            f"case when {c} < {c}_lo then {c}_lo when {c} > {c}_hi then {c}_hi else {c} end as {c}_win" for c in pair)
        + " from base join marcas using (experiencia)",
        "marcas as (select experiencia, " + ", ".join(
            f"quantile_disc({c}, 0.02) as {c}_lo, quantile_disc({c}, 0.98) as {c}_hi" for c in pair)
        + " from base group by all)")

    def cap(role: str) -> str:
        c = COLUMN[role]
        return segment_case({
            s: f"case when {c} >= {num(high)} then {num(high)}"
               + (f" when {c} < {num(low)} then {num(low)}" if low is not None else "") + f" else {c} end"
            for s, (low, high) in HARD_CAPS[role].items()})

    found["hard_cap"] = with_steps(
        f"select row_id, experiencia, {cap('balance')} as saldo_cuentas_cap, {cap('tenure')} as antiguedad_buro_cap from base")
    found["eda_profile"] = eda()
    found["eda_outliers"] = eda_outliers()
    found["agg_null_count"] = with_steps(
        "select experiencia, variable, count(*) as registros, count(*) - count(v) as nulos from largo group by all",
        f"largo as ({stacked('base', PROFILED, 'v')})")
    found["agg_summary"] = with_steps(
        f"""select experiencia, variable, registros, nulos, "count", {r('mean')} as mean, {r('stddev')} as stddev,
          {r('"min"')} as "min", {r('"max"')} as "max" from momentos""",
        f"largo as ({stacked('base', PROFILED, 'v')})",
        f"momentos as (select experiencia, variable, {_MOMENTS} from largo group by all)")
    found["agg_approx_quantile"] = with_steps(
        """select experiencia, variable, cast(p as double) as prob, q as value from (
          select experiencia, variable, unnest([0.02, 0.5, 0.98]) as p,
            unnest(quantile_disc(v, [0.02, 0.5, 0.98])) as q from largo where v is not null group by experiencia, variable)""",
        f"largo as ({stacked('base', MEASURED, 'v')})")
    found["reshape_unpivot"] = with_steps(stacked("base", MEASURED, "valor", "row_id, experiencia"))
    measures = ["nulos", "count", "mean", "stddev", "min", "max"]
    moment_steps = (
        f"largo as ({stacked('base', PROFILED, 'v')})",
        f"momentos as (select experiencia, variable, {_MOMENTS} from largo group by all)")
    found["set_union_all"] = with_steps(
        " union all ".join(
            f"select experiencia, variable, '{m}' as medida, {r(f'cast({chr(34)}{m}{chr(34)} as double)')} as valor from momentos"
            for m in measures), *moment_steps)
    found["reshape_pivot"] = with_steps(
        "select experiencia, variable, " + ", ".join(
            f"{r(f'cast({chr(34)}{m}{chr(34)} as double)')} as {chr(34)}{m}{chr(34)}" for m in measures)
        + " from momentos", *moment_steps)

    # bins, WOE, IV
    found["bin_label"] = with_steps(
        "select row_id, experiencia, saldo_cuentas_bin, antiguedad_buro_bin from etiquetas", LABELLED)
    found["woe_apply"] = with_steps(
        "select row_id, experiencia, " + ", ".join(f"{c}_woe" for c in COLUMN.values()) + " from woe", WOE_BASE)
    found["woe_category"] = with_steps(
        "select row_id, experiencia, clasificacion, clasificacion_woe from woe", WOE_BASE)
    found["udf_woe"] = mdt_only + (
        f"select row_id, {cut_case('avg_saldo_u3m', WOE_MAPS[('SE', 'balance_u3m')], num)} as woe from mdt")
    found["bin_table"] = with_steps(
        measured_bins("tabla"), LABELLED, BIN_ROWS,
        "tabla as (select experiencia, variable, bin, c0 + c1 as n, c1 as event, c0 as non_event from conteo)")
    found["calc_iv_bins"] = with_steps(
        f"select experiencia, variable, bin, count_0, count_1, {r('woe')} as woe, {r('iv')} as iv from iv_bins",
        LABELLED, BIN_ROWS, IV_ROWS)
    found["calc_iv"] = with_steps(
        f"select experiencia, variable, {r('sum(iv)')} as iv from iv_bins group by experiencia, variable",
        LABELLED, BIN_ROWS, IV_ROWS)
    found["optbin_fit"] = with_steps(
        f"""select *, cast(row_number() over (partition by experiencia, variable
          order by event_rate nulls last, bin_no) as int) as rank from ({measured_bins("filas", _MARCO)})""", *OPTBIN)
    found["optbin_sketch"] = found["optbin_fit"]   # below the sketch's accuracy both are exact
    recent = f"largo as materialized ({stacked('reciente', MEASURED, 'v', 'row_id, experiencia, y')})"
    window = "reciente as (select * from base where codigo_periodo between 199901 and 200112)"
    found["optbin_refit"] = found["optbin_fit"].replace(OPTBIN[0], window + ",\n" + recent)
    found["sketch_quantiles"] = with_steps(
        """select experiencia, variable, prob, n, n as n_sketch, true as within from (
          select experiencia, variable, count(v) as n from largo where v is not null group by all),
          (select unnest([0.02, 0.25, 0.5, 0.75, 0.98])::double as prob)""", window, recent)
    found["optbin_splits"] = with_steps(
        f"""select experiencia, variable, n_splits, {r('search_iv')} as search_iv, feasible, orden, corte from (
          select experiencia, variable, cast(len(splits) as bigint) as n_splits, search_iv, feasible,
            unnest(case when len(splits) = 0 then [null] else range(0, len(splits)) end)::int as orden,
            unnest(case when len(splits) = 0 then [null] else list_transform(splits, lambda s: round(s, 2)) end) as corte
          from elegidos)""", *OPTBIN)
    found["iv_ranking"] = with_steps(
        f"""select experiencia, variable, {r('iv_sum')} as iv_sum, n_splits, usable, cast(row_number() over (
          partition by experiencia order by round(iv_sum, 12) desc, variable) as int) as rank from ranking""",
        *OPTBIN, IV_SUM)
    found["iv_strength"] = with_steps(
        f"select experiencia, variable, {r('iv_sum')} as iv_sum, {_STRENGTH} as fuerza from ranking", *OPTBIN, IV_SUM)
    found["discretize"] = with_steps(
        "select row_id, experiencia, " + ", ".join(
            f"max(numero) filter (where variable = '{c}') as {c}_num" for c in MEASURED)
        + """ from (select row_id, experiencia, variable, case when len(splits) > 1 then cast(
            case when v is null then len(splits) + 1 else len(list_filter(splits, lambda s: s <= v)) end as double)
            else v end as numero
          from largo join elegidos using (experiencia, variable)) group by row_id, experiencia""", *OPTBIN)

    shown = ", ".join(
        f"max(woe) filter (where variable = '{c}') as {c}_woe, max(bin) filter (where variable = '{c}') as {c}_bin"
        for c in MEASURED
    )
    found["woe_fitted"] = with_steps(
        f"""select row_id, experiencia, {shown} from (
          select row_id, experiencia, variable, m.woe, m.bin from (
            select row_id, experiencia, variable, cast(case when v is null then len(splits) + 1
              else len(list_filter(splits, lambda s: s <= v)) end as int) as bin_no
            from largo join elegidos using (experiencia, variable))
          join medidas m using (experiencia, variable, bin_no)) group by row_id, experiencia""",
        *OPTBIN, f"medidas as materialized ({measured_bins('filas', 'bin_no,')})")

    # profiles
    for name in ("fa", "12d", "u3m", "u6m"):
        found[f"profile_{name}"] = profile_select(name)
    found["profile_all"] = profile_select("fa", "12d", "u3m", "u6m")
    found["profile_rules_original"] = profile_select("fa", "original")
    found["profile_rule_audit"] = audit()
    found["profile_tables"] = profile_tables()
    found["rule_rectangles"] = rectangles()

    # trees
    found["train_matrix"] = with_steps(
        "select row_id, experiencia, particion, " + ", ".join(f"{c}_woe" for c in COLUMN.values())
        + ", clasificacion_woe, score_buro, antiguedad_buro, saldo_cuentas, y, weight from woe",
        WOE_BASE)
    found["min_leaf_5pct"] = with_steps(
        "select experiencia, count(*) as n_train, cast(floor(cast(0.05 as double) * count(*)) as bigint) as min_leaf "
        "from base where particion = 'train' group by all")
    found["tree_split_search"] = with_steps(
        f"""select run, feature, {r('threshold')} as threshold, {r('gain')} as gain, n_left from cand0
          qualify row_number() over (partition by run, feature order by round(gain, 10) desc, threshold) = 1""",
        *tree_steps(depth=1))
    found["tree_fit"] = with_steps(
        f"""select d.run, node, cast(depth as int) as depth, variable, {r('threshold')} as threshold, n, bad,
          {r('w')} as w, {r('wb')} as wb, {r('p_bad')} as p_bad, is_leaf
        from nodos d left join nombres m on m.run = d.run and m.feature = d.feature""", *tree_steps())
    found["tree_raw_balance"] = with_steps(
        f"""select d.run, node, cast(depth as int) as depth, variable, {r('threshold')} as threshold, n, bad,
          {r('p_bad')} as p_bad, is_leaf
        from nodos d left join nombres m on m.run = d.run and m.feature = d.feature""", *tree_steps(RAW_RUNS))
    found["feature_importance"] = with_steps(
        importance("m.run", """nombres m left join (
          select run, feature, sum(decrease) as dec from nodos where not is_leaf group by all) d
          on d.run = m.run and d.feature = m.feature"""), *tree_steps())
    found["tree_rules"] = tree_rules()
    found["score_proba"] = score_proba()
    found["model_compare"] = with_steps(
        f"""select run, particion, n, bad, {r('auc')} as auc, {r('2 * auc - 1')} as gini, {r('ks')} as ks, {r('cut')} as cut
        from aucs join ({youden_select('curva', 'run, particion')}) using (run, particion)""",
        *tree_steps(), scores_cte(), f"aucs as ({auc_select('puntajes', 'run, particion')})",
        f"curva as ({roc_select('puntajes', 'run, particion')})")
    found["grid_search_depth"] = with_steps(
        f"select run, max_depth, {r('m')} as mean_auc, is_best from notas", *grid_steps())
    found["grid_importance"] = with_steps(
        importance("n.run", """nombres n left join (
          select split_part(d.run, '/', 1) as run, feature, sum(decrease) as dec
          from nodos d join notas b on d.run = b.run || '/all' and is_best and depth < max_depth
          where not is_leaf group by all) g on g.run = n.run and g.feature = n.feature"""), *grid_steps())

    # metrics
    found["metric_auc"] = with_steps(
        f"""select {_SP}, n, bad, {r('auc')} as auc, unscored from ({auc_select('puntajes', _SP)})
        right join (select {_SP}, count(*) filter (where score_buro is null) as unscored from base group by all)
          using ({_SP})""", SCORED)
    found["metric_gini"] = with_steps(
        f"select {_SP}, {r('2 * auc - 1')} as gini from ({auc_select('puntajes', _SP)})", SCORED)
    found["metric_roc_curve"] = with_steps(
        f"select {_SP}, {r('threshold')} as threshold, {r('tpr')} as tpr, {r('fpr')} as fpr "
        f"from ({roc_select('puntajes', _SP)})", SCORED)
    fine = """puntajes as (select experiencia, particion, (1000 - score_buro) - saldo_cuentas as score,
      count(*) as n, sum(y) as bad from base where score_buro is not null and saldo_cuentas is not null group by all)"""
    steps = """pasos as (select *, lag(n) over o as n0, lag(bad) over o as bad0, lead(score) over o as mas from puntajes
      window o as (partition by experiencia, particion order by score))"""
    found["metric_roc_thinned"] = with_steps(
        f"""select c.experiencia, c.particion, {r('threshold')} as threshold, {r('tpr')} as tpr, {r('fpr')} as fpr
        from ({roc_select('puntajes', _SP)}) c join pasos p on p.experiencia = c.experiencia
          and p.particion = c.particion and p.score = c.threshold
        where not coalesce(n = n0 and bad = bad0 and mas is not null, false)""", fine, steps)
    found["metric_youden_cut"] = with_steps(
        f"select {_SP}, {r('ks')} as ks, {r('cut')} as cut from ({youden_select('curva', _SP)})",
        SCORED, f"curva as ({roc_select('puntajes', _SP)})")

    # segment tables
    found["leaf_segments"] = leaf_segments()
    found["leaf_share_check"] = with_steps(
        f"select run, count(*) as grupos, {r('sum(muestra)')} as suma, abs(sum(muestra) - 1) < 1e-9 as cuadra "
        "from grupos group by run", *segment_steps())
    found["woe_cut_to_bins"] = with_steps(
        f"""select d.run, node, variable, {r('threshold')} as threshold, position, bin, {r('woe')} as woe,
          case when woe <= threshold then 'izquierda' else 'derecha' end as lado
        from nodos d join tramos_woe t on t.run = d.run and t.feature = d.feature and not is_leaf
        join nombres m on m.run = d.run and m.feature = d.feature""", *segment_steps())
    found["risk_grid"] = risk_grid()
    found["risk_grid_cells"] = risk_grid_cells()

    # sampling and sinks
    found["sample_fraction"] = mdt_only + (
        "select row_id, identificacion_cliente, codigo_periodo, y from mdt qualify row_number() over "
        "(order by md5(row_id || ':13')) <= cast(floor(cast(0.1 as double) * count(*) over ()) as bigint)")
    found["snk_csv"] = mdt_only + (
        "select row_id, identificacion_cliente, codigo_periodo, y, saldo_cuentas, tipo_modelo_fa from mdt")
    found["snk_show"] = with_steps(
        "select row_id, experiencia, saldo_cuentas from base order by saldo_cuentas desc nulls last, row_id limit 50")
    return found
