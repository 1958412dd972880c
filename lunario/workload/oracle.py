"""The result of every query stated as DuckDB SQL over the raw tables.

Statements are written from the definitions, not from the Spark plans: sums are decimal, months
come from ``date_trunc``, parsed reports are compared with the figures they were written from.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def month(column: str) -> str:
    return f"CAST(date_trunc('month', {column}) AS DATE)"


def total(expression: str) -> str:
    return f"CAST(SUM(CAST({expression} AS DECIMAL(18,4))) AS DOUBLE)"


def change(now: str, before: str) -> str:
    return f"({now} - {before}) / NULLIF({before}, 0) * 100"


def lagged(column: str, rows: int, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"lag({column}, {rows}) OVER ({part}ORDER BY fecha)"


SHIP, ORDER = month("l_shipdate"), month("o_orderdate")
CURRENCY = "CASE l_linestatus WHEN 'O' THEN 'MN' ELSE 'ME' END"
CELL = (
    "3 * (CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) + "
    "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
)
AGGREGATES = {
    "base_monetaria": 3, "m1": 5, "m1a": 7, "m2": 9, "m2a": 11, "m3": 13, "m3a": 15
}
# Rate kind, instrument and term of each return flag.
LABELS = """CASE l_returnflag WHEN 'R' THEN 'Pasiva' ELSE 'Activa' END AS tipo_tasa,
    CASE l_returnflag WHEN 'R' THEN 'Depósitos de ahorro' ELSE 'Préstamo' END AS instrumento,
    CASE l_returnflag WHEN 'A' THEN 'Corto Plazo' WHEN 'N' THEN 'Largo Plazo'
         ELSE 'Sin plazo fijo' END AS plazo"""


def base(prefix: str) -> dict[str, str]:
    """Base tables: national with prefix '', per supplier or customer with prefix 'e_'."""
    k = "entidad, " if prefix else ""
    ship = f"{'l_suppkey AS entidad, ' if prefix else ''}{SHIP} AS fecha"
    order = f"{'o_custkey AS entidad, ' if prefix else ''}{ORDER} AS fecha"
    by = "entidad" if prefix else ""
    part = "PARTITION BY entidad " if prefix else ""
    nested = ", ".join(
        f"{total(f'CASE WHEN {CELL} < {limit} THEN o_totalprice END')} AS {name}"
        for name, limit in AGGREGATES.items()
    )
    tables = {
        "precio": f"SELECT {ship}, {total('l_extendedprice')} / COUNT(*) AS ipc "
        "FROM lineitem GROUP BY ALL",
        "ipc": f"SELECT {k}fecha, ipc, {change('ipc', lagged('ipc', 1, by))} AS inflacion_mensual, "
        f"{change('ipc', lagged('ipc', 12, by))} AS inflacion_interanual, "
        "(ipc - dic) / NULLIF(dic, 0) * 100 AS inflacion_acumulada FROM ("
        "SELECT *, last_value(CASE WHEN month(fecha) = 12 THEN ipc END IGNORE NULLS) OVER ("
        f"{part}ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dic "
        f"FROM {prefix}precio)",
        "cpi_usa": f"SELECT {ship}, {total('l_extendedprice')} / COUNT(*) AS cpi_usa FROM lineitem "
        f"WHERE l_linestatus = 'F' GROUP BY ALL",
        "imae": f"SELECT {ship}, {total('l_quantity')} AS imae FROM lineitem GROUP BY ALL",
        "tc": f"SELECT {ship}, {total('l_quantity')} / COUNT(*) AS tc FROM lineitem "
        "WHERE l_linestatus = 'O' GROUP BY ALL",
        "trm": f"SELECT {ship}, 100 * {total('l_tax')} / COUNT(*) AS trm FROM lineitem "
        "WHERE l_returnflag = 'A' GROUP BY ALL",
        "interbancaria": f"SELECT {ship}, {CURRENCY} AS moneda, "
        f"100 * {total('l_tax')} / COUNT(*) AS tasa FROM lineitem GROUP BY ALL",
        "tasas": f"SELECT {ship}, {CURRENCY} AS moneda, {LABELS}, "
        f"100 * {total('l_discount')} / COUNT(*) AS tasa_porcentaje FROM lineitem GROUP BY ALL",
        "credito": f"SELECT {order}, {total('o_totalprice')} AS credito FROM orders "
        "WHERE o_orderstatus <> 'P' GROUP BY ALL",
        "rin": f"SELECT {order}, {total('o_totalprice')} / 20 AS rin FROM orders "
        "WHERE o_orderpriority = '1-URGENT' GROUP BY ALL",
        "bm": f"SELECT {order}, {nested} FROM orders GROUP BY ALL",
    }
    return {prefix + name: sql for name, sql in tables.items()}


CTES: dict[str, str] = {
    **base(""),
    **base("e_"),
    "usa": "SELECT c.fecha, c.cpi_usa, p.cpi_usa AS cpi_usa_anio_anterior, "
    f"{change('c.cpi_usa', 'p.cpi_usa')} AS inflacion_interanual_usa "
    "FROM cpi_usa c JOIN cpi_usa p ON p.fecha = CAST(c.fecha - INTERVAL 1 YEAR AS DATE)",
    "e_usa": "SELECT c.entidad, c.fecha, "
    f"{change('c.cpi_usa', 'p.cpi_usa')} AS inflacion_interanual_usa "
    "FROM e_cpi_usa c JOIN e_cpi_usa p ON p.entidad = c.entidad "
    "AND p.fecha = CAST(c.fecha - INTERVAL 1 YEAR AS DATE)",
    "plazos": "SELECT fecha, moneda, "
    "MAX(tasa_porcentaje) FILTER (tipo_tasa = 'Activa' AND plazo = 'Corto Plazo') AS corto, "
    "MAX(tasa_porcentaje) FILTER (tipo_tasa = 'Activa' AND plazo = 'Largo Plazo') AS largo "
    "FROM tasas GROUP BY ALL",
    "e_plazos": "SELECT entidad, fecha, moneda, "
    "MAX(tasa_porcentaje) FILTER (tipo_tasa = 'Activa' AND plazo = 'Corto Plazo') AS corto, "
    "MAX(tasa_porcentaje) FILTER (tipo_tasa = 'Activa' AND plazo = 'Largo Plazo') AS largo "
    "FROM e_tasas GROUP BY ALL",
    "margen": "SELECT fecha, moneda, corto - tasa AS spread_cp, largo - tasa AS spread_lp "
    "FROM plazos JOIN interbancaria USING (fecha, moneda)",
    "real": "SELECT p.fecha, p.moneda, corto - d AS tasa_real_col_cp, largo - d AS tasa_real_col_lp "
    "FROM (SELECT p.*, CASE moneda WHEN 'MN' THEN i.inflacion_interanual "
    "ELSE u.inflacion_interanual_usa END AS d FROM plazos p "
    "LEFT JOIN ipc i USING (fecha) LEFT JOIN usa u USING (fecha)) p",
    "desliz": f"SELECT fecha, inflacion_interanual, {change('tc', lagged('tc', 12))} AS desl "
    "FROM ipc JOIN tc USING (fecha)",
    "brecha": "SELECT fecha, inflacion_interanual, desl AS deslizamiento_anual, prev AS "
    "deslizamiento_previo, inflacion_interanual - desl AS brecha_deslizamiento FROM ("
    f"SELECT *, {lagged('desl', 1)} AS prev FROM desliz WHERE desl IS NOT NULL) "
    "WHERE prev IS NOT NULL",
    "relativa": "SELECT fecha, b.inflacion_interanual AS inflacion_nic, deslizamiento_anual, "
    "brecha_deslizamiento, inflacion_interanual_usa AS inflacion_usa, b.inflacion_interanual - "
    "(deslizamiento_anual + inflacion_interanual_usa) AS brecha_inflacion_relativa "
    "FROM brecha b JOIN usa USING (fecha)",
    "peso": "SELECT fecha, peso_estado, "
    f"{change('credito', 'c12')} AS var_inter_credito, {change('liq', 'l12')} AS var_inter_spnf "
    f"FROM (SELECT *, {lagged('liq', 12)} AS l12, {lagged('credito', 12)} AS c12 FROM ("
    "SELECT fecha, credito, m2a - m2 AS liq, (m2a - m2) / NULLIF(m3a, 0) AS peso_estado "
    "FROM bm JOIN credito USING (fecha) WHERE m2a IS NOT NULL AND m2 IS NOT NULL)) "
    "WHERE l12 IS NOT NULL AND c12 IS NOT NULL",
    "cobertura0": "SELECT fecha, "
    + ", ".join(
        f"CAST(CAST(rin * tc AS DECIMAL(18,6)) AS DOUBLE) / NULLIF({a}, 0) AS cobertura_rin_{'bm' if a == 'base_monetaria' else a}"
        for a in AGGREGATES
    )
    + " FROM rin JOIN tc USING (fecha) JOIN bm USING (fecha)",
    "cobertura": "SELECT * FROM (SELECT fecha, "
    + ", ".join(
        f"{c}, {change(c, lagged(c, 12))} AS var_int_{c}"
        for c in (
            f"cobertura_rin_{'bm' if a == 'base_monetaria' else a}" for a in AGGREGATES
        )
    )
    + " FROM cobertura0) WHERE var_int_cobertura_rin_m1 IS NOT NULL",
    "exposicion": "SELECT fecha, m2a, m3a, m3a - m2a AS depositos_no_residentes, "
    "CAST((m3a - m2a) / NULLIF(m3a, 0) AS DECIMAL(18,4)) AS ratio_exposicion_externa, "
    "CAST((m3a - m2a) * 100 / NULLIF(m3a, 0) AS DECIMAL(18,4)) AS ratio_exposicion_externa_pct "
    "FROM bm WHERE m3a IS NOT NULL AND m2a IS NOT NULL",
    "tcr": "SELECT fecha, tc, ipc / bi * 100 AS ipc_nic_base2011, cpi_usa / bu * 100 AS "
    "cpi_usa_base2011, tc * (cpi_usa / bu) / (ipc / bi) AS tcr FROM tc JOIN ipc USING (fecha) "
    "JOIN cpi_usa USING (fecha), (SELECT ipc AS bi FROM ipc WHERE fecha = DATE '1995-01-01'), "
    "(SELECT cpi_usa AS bu FROM cpi_usa WHERE fecha = DATE '1995-01-01')",
    "ldr": "SELECT fecha, {f} * credito / NULLIF(m3a, 0) AS ldr "
    "FROM credito JOIN bm USING (fecha)",
    "imae12": f"SELECT fecha, imae, {change('imae', lagged('imae', 12))} AS imae_var_int FROM imae",
    "proveedor": f"SELECT l_suppkey AS entidad, {SHIP} AS fecha, {total('l_quantity')} AS cantidad, "
    + total("CASE WHEN l_linestatus = 'O' THEN l_quantity END")
    + " AS abierto FROM lineitem GROUP BY ALL",
    "cliente": f"SELECT o_custkey AS entidad, {ORDER} AS fecha, {total('o_totalprice')} AS total "
    "FROM orders GROUP BY ALL",
}

DEPENDS: dict[str, tuple[str, ...]] = {
    "ipc": ("precio",),
    "e_ipc": ("e_precio",),
    "usa": ("cpi_usa",),
    "e_usa": ("e_cpi_usa",),
    "plazos": ("tasas",),
    "e_plazos": ("e_tasas",),
    "margen": ("plazos", "interbancaria"),
    "real": ("plazos", "ipc", "usa"),
    "desliz": ("ipc", "tc"),
    "brecha": ("desliz",),
    "relativa": ("brecha", "usa"),
    "peso": ("bm", "credito"),
    "cobertura0": ("rin", "tc", "bm"),
    "cobertura": ("cobertura0",),
    "exposicion": ("bm",),
    "tcr": ("tc", "ipc", "cpi_usa"),
    "ldr": ("credito", "bm"),
    "imae12": ("imae",),
}


def oracle(
    name: str, body: str, uses: str = "", rounded: str = "", factor: str = "1.2"
) -> None:
    """Register the SQL of a query: its shared tables, its body, its columns to round."""
    ordered: list[str] = []

    def visit(table: str) -> None:
        for needed in DEPENDS.get(table, ()):
            visit(needed)
        if table not in ordered:
            ordered.append(table)

    for table in uses.split():
        visit(table)
    head = ",\n".join(f"{t} AS ({CTES[t].replace('{f}', factor)})" for t in ordered)
    replaced = ", ".join(f"ROUND(CAST({c} AS DOUBLE), 6) AS {c}" for c in rounded.split())
    outer = f"SELECT * REPLACE ({replaced}) FROM ({body})" if rounded else body
    ORACLES[name] = (f"WITH {head}\n" if head else "") + outer


# --- sources and dimensions -------------------------------------------------------------------

oracle(
    "a4_inline_rows",
    "SELECT CASE l_returnflag WHEN 'A' THEN 'Aceptado' WHEN 'N' THEN 'Nuevo' "
    "WHEN 'R' THEN 'Rechazado' END AS nombre, "
    f"COUNT(*) AS filas, {total('l_extendedprice')} AS importe FROM lineitem "
    "WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY ALL",
    rounded="importe",
)
oracle(
    "a1_comma_csv",
    "SELECT o_orderkey AS pedido, CAST(o_orderdate AS DATE) AS fecha, o_totalprice AS importe "
    "FROM orders",
    rounded="importe",
)
# Spanish month names, January first.
NAMES = (
    "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', "
    "'septiembre', 'octubre', 'noviembre', 'diciembre']"
)
oracle(
    "a2_semicolon_csv",
    "SELECT l_orderkey AS pedido, CAST(l_linenumber AS BIGINT) AS linea, "
    f"{NAMES}[month(l_shipdate)] AS mes, 'Depósitos, año' AS instrumento, l_tax AS tasa FROM lineitem",
    rounded="tasa",
)
oracle(
    "a3_quoted_csv",
    "SELECT CAST(month(fecha) AS BIGINT) AS numero_mes, COUNT(*) AS filas, "
    "SUM(CAST(m3a AS DECIMAL(18,4))) AS m3a FROM e_bm GROUP BY ALL",
    "e_bm",
    "m3a",
)
oracle(
    "a5_row_order",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS posicion FROM orders",
)
oracle(
    "a7_month_calendar",
    "SELECT entidad, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS fecha FROM "
    f"(SELECT l_suppkey AS entidad, MIN({SHIP}) AS a, MAX({SHIP}) AS b FROM lineitem GROUP BY ALL)",
)
oracle(
    "a8_calendar_dim",
    "SELECT c.fecha, CAST(year(c.fecha) AS BIGINT) AS anio, CAST(month(c.fecha) AS BIGINT) AS mes, "
    "CAST(quarter(c.fecha) AS BIGINT) AS trimestre, COUNT(o.o_orderkey) AS pedidos FROM "
    "(SELECT CAST(unnest(generate_series(DATE '1994-07-01', DATE '2002-06-01', INTERVAL 1 MONTH)) "
    f"AS DATE) AS fecha) c LEFT JOIN orders o ON {ORDER} = c.fecha GROUP BY ALL",
)
oracle(
    "a9_currency_dim",
    "SELECT moneda, COUNT(*) AS filas, MAX(tasa) AS tasa_maxima, "
    "CASE moneda WHEN 'MN' THEN 'Córdobas' ELSE 'Dólares' END AS nombre "
    "FROM e_interbancaria GROUP BY moneda",
    "e_interbancaria",
    "tasa_maxima",
)
oracle(
    "a10_clean_simple",
    "SELECT o_orderkey AS pedido, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END "
    "AS fecha, o_totalprice AS total FROM orders "
    "WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')",
    rounded="total",
)

# --- upkeep -----------------------------------------------------------------------------------

oracle(
    "b3_upsert",
    "SELECT COALESCE(s.entidad, t.entidad) AS entidad, COALESCE(s.fecha, t.fecha) AS fecha, "
    "CASE WHEN s.fecha IS NOT NULL THEN s.total ELSE t.total END AS total, "
    "CASE WHEN s.fecha IS NOT NULL THEN s.urgente ELSE t.urgente END AS urgente FROM "
    + " FULL JOIN ".join(
        f"(SELECT o_custkey AS entidad, {ORDER} AS fecha, {total('o_totalprice')} AS total, "
        + total("CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END")
        + f" AS urgente FROM orders WHERE {where} GROUP BY ALL) {name}"
        for name, where in (
            ("t", "o_orderdate < '2000-01-01'"),
            ("s", "o_orderdate >= '1999-07-01'"),
        )
    )
    + " ON s.entidad = t.entidad AND s.fecha = t.fecha",
    rounded="total urgente",
)
oracle(
    "b4_update_from",
    "SELECT entidad, fecha, CASE WHEN tc IS NULL THEN imae ELSE imae * tc END AS imae "
    "FROM e_imae LEFT JOIN e_tc USING (entidad, fecha)",
    "e_imae e_tc",
    "imae",
)
oracle(
    "b5_update_window",
    f"SELECT *, {change('tc', lagged('tc', 12, 'entidad'))} AS deslizamiento_cambiario_anual "
    "FROM e_tc",
    "e_tc",
    "tc deslizamiento_cambiario_anual",
)
oracle(
    "b6_delete",
    "SELECT * FROM proveedor WHERE abierto IS NULL OR abierto >= 20",
    "proveedor",
    "cantidad abierto",
)
oracle(
    "b7_add_columns",
    "SELECT *, CAST(NULL AS DOUBLE) AS m1, CAST(NULL AS DOUBLE) AS m2 FROM e_credito",
    "e_credito",
    "credito",
)
oracle(
    "b9_key_violations",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS filas, "
    "CAST(0 AS BIGINT) AS nulos FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
)

# --- filters ----------------------------------------------------------------------------------

oracle(
    "c3_compare",
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' "
    "AND o_totalprice >= 250000 AND o_orderpriority <> '5-LOW'",
    rounded="o_totalprice",
)
oracle(
    "c4_between",
    "SELECT entidad, fecha, moneda, plazo, tasa_porcentaje FROM e_tasas WHERE moneda = 'MN' "
    "AND plazo = 'Largo Plazo' AND fecha BETWEEN DATE '2000-06-01' AND DATE '2000-12-01'",
    "e_tasas",
    "tasa_porcentaje",
)
oracle(
    "c5_in",
    "SELECT o_orderkey, o_orderpriority FROM orders "
    "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
oracle("c6_not_null", "SELECT * FROM proveedor WHERE abierto IS NOT NULL AND cantidad IS NOT NULL",
       "proveedor", "cantidad abierto")
oracle(
    "c7_like",
    "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' AND p_name NOT LIKE '%bolt%'",
)
oracle(
    "c8_year_filter",
    f"SELECT {ORDER} AS fecha, COUNT(*) AS pedidos, {total('o_totalprice')} AS total FROM orders "
    "WHERE year(o_orderdate) = 1998 GROUP BY ALL",
    rounded="total",
)

# --- joins ------------------------------------------------------------------------------------

oracle(
    "d1_spine_join",
    "SELECT entidad, fecha, ipc, imae, tc, trm FROM e_precio LEFT JOIN e_imae USING (entidad, fecha) "
    "LEFT JOIN e_tc USING (entidad, fecha) LEFT JOIN e_trm USING (entidad, fecha)",
    "e_precio e_imae e_tc e_trm",
    "ipc imae tc trm",
)
oracle(
    "d4_fanout_join",
    "SELECT entidad, fecha, trm, moneda, tasa FROM e_trm JOIN e_interbancaria USING (entidad, fecha)",
    "e_trm e_interbancaria",
    "trm tasa",
)
oracle(
    "d5_deflator_left",
    "SELECT entidad, fecha, moneda, corto - d AS tasa_real_col_cp, largo - d AS tasa_real_col_lp "
    "FROM (SELECT p.*, CASE moneda WHEN 'MN' THEN inflacion_interanual ELSE inflacion_interanual_usa "
    "END AS d FROM e_plazos p LEFT JOIN e_ipc USING (entidad, fecha) "
    "LEFT JOIN e_usa USING (entidad, fecha))",
    "e_plazos e_ipc e_usa",
    "tasa_real_col_cp tasa_real_col_lp",
)
oracle(
    "d6_prior_year_join",
    "SELECT a.*, b.imae AS imae_anio_anterior FROM e_imae a LEFT JOIN e_imae b ON b.entidad = "
    "a.entidad AND b.fecha = CAST(a.fecha - INTERVAL 1 YEAR AS DATE)",
    "e_imae",
    "imae imae_anio_anterior",
)
oracle(
    "d7_rebase_cross",
    "SELECT entidad, fecha, e.ipc / b.ipc * 100 AS ipc_base FROM e_precio e, "
    "(SELECT ipc FROM precio WHERE fecha = DATE '1995-01-01') b",
    "e_precio precio",
    "ipc_base",
)
oracle(
    "d9_densify",
    "SELECT c.entidad, c.fecha, tc FROM (SELECT entidad, CAST(unnest(generate_series(MIN(fecha), "
    "MAX(fecha), INTERVAL 1 MONTH)) AS DATE) AS fecha FROM e_tc GROUP BY entidad) c "
    "LEFT JOIN e_tc USING (entidad, fecha)",
    "e_tc",
    "tc",
)

# --- aggregates -------------------------------------------------------------------------------

oracle(
    "e1_yearly_avg",
    "SELECT entidad, year(fecha) AS anio, AVG(imae) AS imae_promedio FROM e_imae GROUP BY ALL",
    "e_imae",
    "imae_promedio",
)
oracle(
    "e2_pivot_term",
    "SELECT entidad, fecha, moneda, corto AS tasa_corto_plazo, largo AS tasa_largo_plazo "
    "FROM e_plazos",
    "e_plazos",
    "tasa_corto_plazo tasa_largo_plazo",
)
oracle(
    "e3_pivot_sum",
    "SELECT entidad, fecha, moneda, SUM(tasa_porcentaje) FILTER (tipo_tasa = 'Activa') AS activa, "
    "SUM(tasa_porcentaje) FILTER (tipo_tasa = 'Pasiva') AS pasiva FROM e_tasas GROUP BY ALL",
    "e_tasas",
    "activa pasiva",
)
oracle(
    "e4_pivot_currency",
    "SELECT entidad, fecha, tipo_tasa, plazo, MAX(tasa_porcentaje) FILTER (moneda = 'MN') AS tasa_mn, "
    "MAX(tasa_porcentaje) FILTER (moneda = 'ME') AS tasa_me FROM e_tasas GROUP BY ALL",
    "e_tasas",
    "tasa_mn tasa_me",
)
oracle(
    "e5_profile",
    "SELECT l_suppkey AS entidad, COUNT(*) AS total_filas, CAST(MIN(l_shipdate) AS DATE) AS "
    "fecha_inicio, CAST(MAX(l_shipdate) AS DATE) AS fecha_fin, COUNT(*) FILTER (l_returnflag = 'R') "
    "AS nulls_detectados, COUNT(*) FILTER (l_returnflag <> 'R' AND l_tax = 0) AS ceros_detectados "
    "FROM lineitem GROUP BY ALL",
)
oracle(
    "e6_key_counts",
    "SELECT moneda, plazo, COUNT(*) AS cantidad_registros FROM e_tasas GROUP BY ALL",
    "e_tasas",
)
oracle(
    "e8_dedup_max",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, MAX(l_quantity) AS l_quantity, "
    "MAX(l_tax) AS l_tax FROM lineitem GROUP BY ALL",
    rounded="l_quantity l_tax",
)
oracle(
    "e9_peak_gap",
    "SELECT a.entidad, anio, inflacion_promedio, inflacion_promedio - p AS gap_pico FROM (SELECT "
    "entidad, year(fecha) AS anio, AVG(inflacion_interanual) AS inflacion_promedio FROM e_ipc "
    "GROUP BY ALL) a LEFT JOIN (SELECT entidad, AVG(inflacion_interanual) AS p FROM e_ipc "
    "WHERE year(fecha) = 1998 GROUP BY ALL) USING (entidad)",
    "e_ipc",
    "inflacion_promedio gap_pico",
)

# --- changes and windows ----------------------------------------------------------------------

oracle(
    "f1_lag_by_key",
    f"SELECT *, {lagged('tasa', 1, 'entidad, moneda')} AS tasa_anterior FROM e_interbancaria",
    "e_interbancaria",
    "tasa tasa_anterior",
)
oracle(
    "f2_mom",
    f"SELECT *, {change('imae', lagged('imae', 1, 'entidad'))} AS var_men_imae FROM e_imae",
    "e_imae",
    "imae var_men_imae",
)
oracle(
    "f3_yoy_row",
    f"SELECT *, {change('tc', lagged('tc', 12, 'entidad'))} AS var_inter_tc FROM e_tc",
    "e_tc",
    "tc var_inter_tc",
)
oracle(
    "f3_yoy_calendar",
    f"SELECT a.*, {change('a.tc', 'b.tc')} AS var_inter_tc FROM e_tc a LEFT JOIN e_tc b ON "
    "b.entidad = a.entidad AND b.fecha = CAST(a.fecha - INTERVAL 1 YEAR AS DATE)",
    "e_tc",
    "tc var_inter_tc",
)
oracle(
    "f4_lag_densified",
    "SELECT a.*, b.tc AS tc_anio_anterior FROM e_tc a JOIN e_tc b ON "
    "b.entidad = a.entidad AND b.fecha = CAST(a.fecha - INTERVAL 1 YEAR AS DATE)",
    "e_tc",
    "tc tc_anio_anterior",
)

# Lines of the aggregate reports: header, month, mean and note lines of each customer's year.
LINES = (
    "SELECT entidad, anio, anio * 100 + linea AS source_row_id, linea, "
    "dense_rank() OVER (PARTITION BY entidad ORDER BY anio) AS grupo_anio FROM ("
    "SELECT DISTINCT o_custkey AS entidad, year(o_orderdate) AS anio, month(o_orderdate) AS linea "
    "FROM orders UNION SELECT DISTINCT o_custkey, year(o_orderdate), unnest([0, 13, 14]) FROM orders)"
)
oracle("f5_running_count", f"SELECT entidad, source_row_id, grupo_anio FROM ({LINES})")
oracle(
    "f6_group_fill",
    f"SELECT entidad, source_row_id, anio AS anio_real FROM ({LINES})",
)

oracle(
    "f6_group_max",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, "
    "MAX(l_quantity) OVER (PARTITION BY l_orderkey) AS mayor_cantidad FROM lineitem",
    rounded="l_quantity mayor_cantidad",
)

# --- sorts and sets ---------------------------------------------------------------------------

oracle(
    "g2_sort_keys",
    "SELECT entidad, plazo, moneda, COUNT(*) AS cantidad_registros FROM e_tasas GROUP BY ALL "
    "ORDER BY entidad, plazo, moneda",
    "e_tasas",
)
oracle(
    "g3_top_n",
    "SELECT * FROM e_interbancaria ORDER BY fecha DESC, entidad, moneda LIMIT 80",
    "e_interbancaria",
    "tasa",
)
oracle(
    "h1_union_all",
    "SELECT entidad, fecha, cantidad AS valor FROM proveedor UNION ALL "
    "SELECT entidad, fecha, total FROM cliente",
    "proveedor cliente",
    "valor",
)

# --- expressions ------------------------------------------------------------------------------

oracle(
    "i4_year_label",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(year(o_orderdate) AS VARCHAR) END "
    "AS anio, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS texto FROM orders",
)
oracle(
    "i7_try_number",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS importe FROM orders",
    rounded="importe",
)
oracle(
    "i8_guarded_ratio",
    "SELECT entidad, fecha, CASE WHEN abierto > 0 THEN (cantidad - abierto) / abierto END AS "
    "cerrado_por_abierto FROM proveedor",
    "proveedor",
    "cerrado_por_abierto",
)
oracle(
    "i12_month_number",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN month(o_orderdate) END AS numero_mes "
    "FROM orders",
)
oracle("i13_paren_negative", "SELECT c_custkey, c_acctbal AS saldo FROM customer", rounded="saldo")
oracle(
    "i15_make_date",
    f"SELECT CASE WHEN l_linestatus = 'F' THEN {SHIP} END AS fecha, COUNT(*) AS filas FROM lineitem "
    "GROUP BY ALL",
)
oracle(
    "i16_shift_month",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS mes_siguiente, "
    "CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) AS anio_anterior FROM orders",
)
oracle(
    "i18_month_name",
    "SELECT ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', "
    "'septiembre', 'octubre', 'noviembre', 'diciembre'][month(l_shipdate)] AS mes_texto, "
    "COUNT(*) AS filas FROM lineitem GROUP BY ALL",
)

# --- report loads -----------------------------------------------------------------------------

oracle(
    "j3_fill_year",
    "SELECT entidad, source_row_id, anio AS anio_real, linea AS numero_mes "
    f"FROM ({LINES}) WHERE linea BETWEEN 1 AND 12",
)
MONEY = " ".join(AGGREGATES)
oracle("j6_report_tidy", "SELECT * FROM e_bm", "e_bm", MONEY)
# Kind, instrument and term of the nine cells of the rate report.
CELLS = [
    ("Pasiva", "Depósitos de ahorro", "Sin plazo fijo"),
    ("Pasiva", "Depósitos a Plazo", "1 mes"),
    ("Pasiva", "Depósitos a Plazo", "3 meses"),
    ("Pasiva", "Depósitos a Plazo", "6 meses"),
    ("Pasiva", "Depósitos a Plazo", "9 meses"),
    ("Pasiva", "Depósitos a Plazo", "1 año"),
    ("Pasiva", "Depósitos a Plazo", "Más de 1 año"),
    ("Activa", "Préstamo", "Corto Plazo"),
    ("Activa", "Préstamo", "Largo Plazo"),
]
oracle(
    "j7_unpivot_rates",
    "SELECT entidad, fecha, moneda, "
    + ", ".join(
        f"[{', '.join(repr(c[n]) for c in CELLS)}][n] AS {name}"
        for n, name in enumerate(("tipo_tasa", "instrumento", "plazo"))
    )
    + ", tasa_porcentaje FROM (SELECT l_suppkey AS entidad, "
    f"{SHIP} AS fecha, {CURRENCY} AS moneda, "
    "3 * CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + l_linenumber % 3 + 1 AS n, "
    f"100 * {total('l_discount')} / COUNT(*) AS tasa_porcentaje FROM lineitem GROUP BY ALL)",
    rounded="tasa_porcentaje",
)
oracle("j9_staging_tidy", "SELECT * FROM bm", "bm", MONEY)
oracle(
    "j8_report_upsert",
    "SELECT entidad, fecha, "
    + ", ".join(
        f"CASE WHEN fecha < DATE '1999-01-01' THEN {a} + 1 ELSE {a} END AS {a}" for a in AGGREGATES
    )
    + " FROM e_bm",
    "e_bm",
    MONEY,
)

# --- views ------------------------------------------------------------------------------------

INFLATION = "inflacion_mensual inflacion_interanual inflacion_acumulada"
oracle(
    "k1_macro_panel",
    "SELECT fecha, base_monetaria, credito, imae, ipc, inflacion_mensual, inflacion_interanual, "
    "inflacion_acumulada, rin, tc, trm FROM ipc LEFT JOIN bm USING (fecha) LEFT JOIN credito "
    "USING (fecha) LEFT JOIN imae USING (fecha) LEFT JOIN rin USING (fecha) "
    "LEFT JOIN tc USING (fecha) LEFT JOIN trm USING (fecha)",
    "ipc bm credito imae rin tc trm",
    f"base_monetaria credito imae ipc {INFLATION} rin tc trm",
)
oracle("k2_bank_spread", "SELECT * FROM margen", "margen", "spread_cp spread_lp")
oracle("k3_real_lending_rate", "SELECT * FROM real", "real", "tasa_real_col_cp tasa_real_col_lp")
oracle(
    "k4_us_inflation",
    "SELECT * FROM usa",
    "usa",
    "cpi_usa cpi_usa_anio_anterior inflacion_interanual_usa",
)
oracle(
    "k5_real_financial_growth",
    "SELECT fecha, moneda, var_men_imae, var_men_credito, spread_cp, spread_lp FROM (SELECT fecha, "
    f"{change('imae', lagged('imae', 1))} AS var_men_imae, "
    f"{change('credito', lagged('credito', 1))} AS var_men_credito "
    "FROM credito JOIN imae USING (fecha)) JOIN margen USING (fecha) "
    "WHERE var_men_imae IS NOT NULL AND var_men_credito IS NOT NULL",
    "credito imae margen",
    "var_men_imae var_men_credito spread_cp spread_lp",
)
oracle(
    "k6_crawl_gap",
    "SELECT *, CASE WHEN brecha_deslizamiento <= 1.5 THEN 'Anclaje Exitoso' "
    "WHEN brecha_deslizamiento <= 4 THEN 'Presión por Costos Importados' "
    "WHEN brecha_deslizamiento > 4 THEN 'Desalineamiento / Shock Estructural' END "
    "AS estado_anclaje_cambiario FROM brecha",
    "brecha",
    "inflacion_interanual deslizamiento_anual deslizamiento_previo brecha_deslizamiento",
)
oracle(
    "k7_term_curve",
    "SELECT fecha, moneda, s AS spread_plazos, p AS spread_mes_anterior, CASE WHEN s > 0 THEN "
    "'Curva normal' WHEN s = 0 THEN 'Curva plana' WHEN s < 0 THEN 'Curva invertida' END AS "
    f"estado_spread FROM (SELECT *, {lagged('s', 1, 'moneda')} AS p FROM (SELECT fecha, moneda, "
    "SUM(tasa_porcentaje) FILTER (plazo = 'Largo Plazo') - "
    "SUM(tasa_porcentaje) FILTER (plazo = 'Corto Plazo') AS s FROM tasas GROUP BY ALL)) "
    "WHERE p IS NOT NULL",
    "tasas",
    "spread_plazos spread_mes_anterior",
)
oracle(
    "k8_external_exposure",
    "SELECT * FROM exposicion",
    "exposicion",
    "m2a m3a depositos_no_residentes ratio_exposicion_externa ratio_exposicion_externa_pct",
)
oracle(
    "k9_public_sector_weight",
    "SELECT * FROM peso",
    "peso",
    "peso_estado var_inter_credito var_inter_spnf",
)
oracle(
    "k9_stored_weight",
    "SELECT fecha, peso_estado, var_inter_credito, var_inter_spnf FROM (SELECT fecha, peso_estado, "
    f"{change('credito', lagged('credito', 12))} AS var_inter_credito, "
    f"{change('liq', lagged('liq', 12))} AS var_inter_spnf FROM (SELECT fecha, credito, m2a - m2 AS "
    "liq, CAST(CAST(m2a - m2 AS DECIMAL(18,6)) AS DOUBLE) / NULLIF(m3a, 0) AS peso_estado "
    "FROM bm JOIN credito USING (fecha))) "
    "WHERE var_inter_credito IS NOT NULL AND var_inter_spnf IS NOT NULL",
    "bm credito",
    "peso_estado var_inter_credito var_inter_spnf",
)
COVERAGE = " ".join(
    f"{prefix}cobertura_rin_{'bm' if a == 'base_monetaria' else a}"
    for a in AGGREGATES
    for prefix in ("", "var_int_")
)
oracle("k10_reserve_coverage", "SELECT * FROM cobertura", "cobertura", COVERAGE)
oracle(
    "k11_rate_parity",
    "SELECT *, tasa_real_mn - tasa_real_me AS spread_paridad_tasas FROM (SELECT fecha, tipo_tasa, "
    "plazo, mn - CAST(inflacion_interanual AS DECIMAL(18,6)) AS tasa_real_mn, "
    "me - inflacion_interanual_usa AS tasa_real_me FROM (SELECT fecha, tipo_tasa, plazo, "
    "MAX(tasa_porcentaje) FILTER (moneda = 'MN') AS mn, "
    "MAX(tasa_porcentaje) FILTER (moneda = 'ME') AS me FROM tasas GROUP BY ALL) "
    "JOIN ipc USING (fecha) JOIN usa USING (fecha)) "
    "WHERE tasa_real_mn IS NOT NULL AND tasa_real_me IS NOT NULL",
    "tasas ipc usa",
    "tasa_real_mn tasa_real_me spread_paridad_tasas",
)
oracle(
    "k12_real_exchange_rate",
    "SELECT * FROM tcr",
    "tcr",
    "tc ipc_nic_base2011 cpi_usa_base2011 tcr",
)
oracle(
    "k13_yearly_inflation",
    "SELECT year(fecha) AS anio, AVG(inflacion_interanual) AS inflacion_promedio, "
    "AVG(inflacion_interanual) - (SELECT AVG(inflacion_interanual) FROM ipc "
    "WHERE year(fecha) = 1998) AS gap_pico FROM ipc GROUP BY ALL",
    "ipc",
    "inflacion_promedio gap_pico",
)
oracle(
    "k14_term_rates_interbank",
    "SELECT fecha, moneda, corto AS tasa_corto_plazo, largo AS tasa_largo_plazo, tasa AS "
    "tasa_interbancaria FROM plazos JOIN interbancaria USING (fecha, moneda)",
    "plazos interbancaria",
    "tasa_corto_plazo tasa_largo_plazo tasa_interbancaria",
)
oracle(
    "k15_spread_history",
    f"SELECT *, {lagged('spread_cp', 1, 'moneda')} AS ultimo_spread_cp FROM margen",
    "margen",
    "spread_cp spread_lp ultimo_spread_cp",
)
oracle(
    "k16_policy_transmission",
    "SELECT fecha, moneda, gap AS gap_transmision, previo AS trm_mes_anterior, CASE WHEN gap <= 0.5 "
    "THEN 'Transmisión Efectiva' ELSE 'Desvío de Política' END AS estado_efectividad FROM (SELECT "
    f"fecha, moneda, tasa - trm AS gap, {lagged('trm', 1, 'moneda')} AS previo FROM trm "
    "JOIN interbancaria USING (fecha) WHERE trm IS NOT NULL) WHERE previo IS NOT NULL "
    "ORDER BY fecha DESC, moneda LIMIT 80",
    "trm interbancaria",
    "gap_transmision trm_mes_anterior",
)
oracle(
    "k17_computed_inflation",
    "SELECT fecha, ipc, COALESCE(inflacion_acumulada, 0) AS inflacion_interanual, "
    f"COALESCE({change('ipc', lagged('ipc', 12))}, COALESCE(inflacion_acumulada, 0)) "
    "AS inflacion_calculada FROM ipc",
    "ipc",
    "ipc inflacion_interanual inflacion_calculada",
)
oracle(
    "k18_yearly_changes",
    "SELECT fecha, imae, var_inter_imae, credito, var_inter_credito, tc, var_inter_tc FROM "
    f"(SELECT *, {change('imae', lagged('imae', 12))} AS var_inter_imae FROM imae) FULL JOIN "
    f"(SELECT *, {change('credito', lagged('credito', 12))} AS var_inter_credito FROM credito) "
    f"USING (fecha) FULL JOIN (SELECT *, {change('tc', lagged('tc', 12))} AS var_inter_tc FROM tc) "
    "USING (fecha)",
    "imae credito tc",
    "imae var_inter_imae credito var_inter_credito tc var_inter_tc",
)
oracle(
    "k19_relative_inflation_gap",
    "SELECT * FROM relativa",
    "relativa",
    "inflacion_nic deslizamiento_anual brecha_deslizamiento inflacion_usa brecha_inflacion_relativa",
)
oracle(
    "k20_reserves_local",
    "SELECT fecha, rin / 1000 AS rin, CAST(rin / 1000 * tc AS DECIMAL(14,6)) AS rin_nio "
    "FROM rin LEFT JOIN tc USING (fecha)",
    "rin tc",
    "rin rin_nio",
)
oracle(
    "k21_override",
    "SELECT fecha, tc, CASE WHEN year(fecha) = 1995 THEN 4.75 + month(fecha) / 100 ELSE "
    f"{change('tc', lagged('tc', 12))} END AS deslizamiento_cambiario_anual FROM tc",
    "tc",
    "tc deslizamiento_cambiario_anual",
)
oracle(
    "k22_money_differences",
    "SELECT *, m2a - m2 AS spnf_m2, m3a - m3 AS spnf_m3 FROM bm WHERE fecha >= DATE '2000-07-01'",
    "bm",
    f"{MONEY} spnf_m2 spnf_m3",
)
oracle(
    "k23_series_profile",
    "SELECT COUNT(*) AS total_filas, MIN(fecha) AS fecha_inicio, MAX(fecha) AS fecha_fin, "
    "COUNT(*) - COUNT(cpi_usa) AS nulls_detectados, "
    "COUNT(*) FILTER (cpi_usa = 0) AS ceros_detectados FROM cpi_usa",
    "cpi_usa",
)
oracle(
    "k24_zero_values",
    "SELECT CAST(l_shipdate AS DATE) AS fecha, l_orderkey, CAST(l_linenumber AS BIGINT) AS "
    "l_linenumber, l_tax FROM lineitem WHERE l_tax = 0",
    rounded="l_tax",
)
oracle(
    "k25_lending_rate_of_year",
    "SELECT ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', "
    "'septiembre', 'octubre', 'noviembre', 'diciembre'][month(fecha)] AS mes_texto, moneda, "
    "tasa_real_col_cp, tasa_real_col_lp FROM real WHERE year(fecha) = 2000",
    "real",
    "tasa_real_col_cp tasa_real_col_lp",
)
oracle(
    "k26_rates_listing",
    "SELECT t.fecha, t.moneda, plazo, tasa_porcentaje AS tasa, i.moneda AS moneda_interbancaria, "
    "i.tasa AS tasa_interbancaria FROM tasas t LEFT JOIN interbancaria i ON i.fecha = t.fecha "
    "WHERE tipo_tasa = 'Activa'",
    "tasas interbancaria",
    "tasa tasa_interbancaria",
)

# --- measures ---------------------------------------------------------------------------------

oracle(
    "l1_last_non_blank",
    "SELECT entidad, fecha, abierto AS valor FROM proveedor WHERE abierto IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY entidad ORDER BY fecha DESC) = 1",
    "proveedor",
    "valor",
)


def newest(name: str, table: str, column: str, label: str = "kpi", code: str = "") -> str:
    currency = {"kpi": f"'{code}' AS moneda, " if code else "CAST(NULL AS VARCHAR) AS moneda, "}
    where = f"moneda = '{code}'" if code else "TRUE"
    return (
        f"SELECT * FROM (SELECT '{name}' AS {label}, {currency.get(label, '')}fecha, "
        f"CAST({column} AS DOUBLE) AS valor "
        f"FROM {table} WHERE {column} IS NOT NULL AND {where} ORDER BY fecha DESC LIMIT 1)"
    )


oracle(
    "l2_named_kpis",
    " UNION ALL ".join(
        [
            newest("KPI_IMAE_Var_Int", "imae12", "imae_var_int"),
            newest("KPI_Inflacion_Interanual", "ipc", "inflacion_interanual"),
            newest("KPI_TC_Actual", "tc", "tc"),
            newest("KPI_RIN_Actual", "rin", "rin"),
            newest("KPI_Credito_Actual", "credito", "credito"),
            newest("KPI_TCR_Actual", "tcr", "tcr"),
            *[
                newest(f"KPI_Spread_{end}", "margen", f"spread_{end.lower()}", code=code)
                for end in ("CP", "LP")
                for code in ("MN", "ME")
            ],
            newest("KPI_LDR_Actual", "ldr", "ldr"),
        ]
    ),
    "imae12 ipc tc rin credito tcr margen ldr",
    "valor",
    factor="1.0",
)
oracle(
    "l3_weight_buffer",
    "SELECT fecha, peso_estado, 0.20 - peso_estado AS crowding_buffer FROM peso",
    "peso",
    "peso_estado crowding_buffer",
)
# Growth and inflation limits of the four macro states, their names and codes.
MACRO = [
    (">= 0.035", "<= 0.03", "Expansión con anclaje", 1),
    (">= 0.035", "> 0.03", "Expansión con presión", 2),
    ("< 0.035", "<= 0.03", "Desaceleración controlada", 3),
    ("< 0.035", "> 0.03", "Estanflación", 4),
]
oracle(
    "l4_l5_macro_states",
    "SELECT *, CASE "
    + " ".join(f"WHEN imae_var_int {g} AND inflacion {i} THEN '{t}'" for g, i, t, _ in MACRO)
    + " ELSE 'Sin datos' END AS estado_macro_actual, CAST(CASE "
    + " ".join(f"WHEN imae_var_int {g} AND inflacion {i} THEN {c}" for g, i, _, c in MACRO)
    + " ELSE 0 END AS BIGINT) AS estado_macro_valor FROM (SELECT fecha, imae_var_int / 100 AS "
    "imae_var_int, inflacion_interanual / 100 AS inflacion FROM ipc LEFT JOIN imae12 USING (fecha))",
    "ipc imae12",
    "imae_var_int inflacion",
)
oracle(
    "l6_purchasing_power_gap",
    "SELECT fecha, b AS brecha_ppa, CASE WHEN b > 1 THEN 'Presión inflacionaria' WHEN b >= -1 THEN "
    "'Equilibrio' ELSE 'Presión deflacionaria' END AS estado_anclaje_ppa_texto, CAST(CASE WHEN b > 1 "
    "THEN 1 WHEN b >= -1 THEN 2 ELSE 3 END AS BIGINT) AS estado_anclaje_ppa_valor "
    "FROM (SELECT fecha, brecha_inflacion_relativa AS b FROM relativa)",
    "relativa",
    "brecha_ppa",
)
oracle(
    "l7_ldr_zones",
    "SELECT *, CASE WHEN ldr < 0.75 THEN 'Subutilización' WHEN ldr <= 0.85 THEN 'Zona eficiente' "
    "ELSE 'Presión de liquidez' END AS estado_ldr_texto, CAST(CASE WHEN ldr < 0.75 THEN 1 "
    "WHEN ldr <= 0.85 THEN 2 ELSE 3 END AS BIGINT) AS estado_ldr_valor FROM ldr",
    "ldr",
    "ldr",
)
oracle(
    "l8_ldr_centred", "SELECT *, ldr - 0.75 AS ldr_centrado FROM ldr", "ldr", "ldr ldr_centrado"
)
oracle(
    "l9_real_rate_reference",
    "SELECT fecha, tcr, (SELECT AVG(tcr) FROM tcr) AS ref_promedio_tcr FROM tcr",
    "tcr",
    "tcr ref_promedio_tcr",
)
oracle(
    "l10_real_rate_status",
    "SELECT *, CASE WHEN desviacion > 0.05 THEN 'Por encima del promedio' WHEN desviacion >= -0.05 "
    "THEN 'En línea con el promedio' ELSE 'Por debajo del promedio' END AS indicador_status_tcr FROM "
    "(SELECT fecha, tcr, m AS ref_promedio_tcr, tcr / m - 1 AS desviacion FROM tcr, "
    "(SELECT AVG(tcr) AS m FROM tcr))",
    "tcr",
    "tcr ref_promedio_tcr desviacion",
)
oracle(
    "l11_correlation",
    "SELECT corr(i1, c1) AS correlacion_mensual, corr(i12, c12) AS correlacion_interanual FROM "
    "(SELECT "
    + ", ".join(
        f"{change(c, lagged(c, n))} AS {c[0]}{n}" for n in (1, 12) for c in ("imae", "credito")
    )
    + " FROM imae JOIN credito USING (fecha))",
    "imae credito",
    "correlacion_mensual correlacion_interanual",
)
oracle(
    "l12_weight_summary",
    "SELECT MAX(peso_estado) AS peso_maximo, MAX(fecha) FILTER (peso_estado IS NOT NULL) AS "
    "fecha_actual, (SELECT peso_estado FROM peso WHERE peso_estado IS NOT NULL ORDER BY fecha DESC "
    "LIMIT 1) AS peso_actual, COUNT(*) FILTER (peso_estado > 0.20) AS meses_en_alerta FROM peso",
    "peso",
    "peso_maximo peso_actual",
)
oracle(
    "l13_money_growth",
    "SELECT fecha, var_int_bm, var_int_m2, var_int_rin FROM (SELECT fecha, "
    f"{change('base_monetaria', lagged('base_monetaria', 12))} AS var_int_bm, "
    f"{change('m2', lagged('m2', 12))} AS var_int_m2 FROM bm) FULL JOIN "
    f"(SELECT fecha, {change('rin', lagged('rin', 12))} AS var_int_rin FROM rin) USING (fecha)",
    "bm rin",
    "var_int_bm var_int_m2 var_int_rin",
)
oracle(
    "l14_inflation_zones",
    "SELECT fecha, imae_var_int, CASE WHEN imae_var_int >= 3.5 THEN 'Expansión' WHEN imae_var_int < "
    "3.5 THEN 'Contracción' ELSE 'Sin datos' END AS zona_imae, inflacion_interanual, "
    "inflacion_interanual BETWEEN 2 AND 3 AS en_meta, inflacion_interanual_usa, "
    "inflacion_interanual_usa BETWEEN 2 AND 3 AS en_meta_usa FROM ipc LEFT JOIN imae12 USING (fecha) "
    "LEFT JOIN usa USING (fecha)",
    "ipc imae12 usa",
    "imae_var_int inflacion_interanual inflacion_interanual_usa",
)
oracle(
    "l15_fractions",
    "SELECT * REPLACE (tasa_porcentaje / 100 AS tasa_porcentaje) FROM e_tasas",
    "e_tasas",
    "tasa_porcentaje",
)
oracle(
    "l16_term_premium",
    "SELECT *, spread_lp_mn / NULLIF(spread_lp_me, 0) AS prima_plazo FROM (SELECT fecha, "
    "MAX(spread_lp) FILTER (moneda = 'MN') AS spread_lp_mn, "
    "MAX(spread_lp) FILTER (moneda = 'ME') AS spread_lp_me FROM margen GROUP BY ALL)",
    "margen",
    "spread_lp_mn spread_lp_me prima_plazo",
)
oracle(
    "l17_external_risk",
    " UNION ALL ".join(
        [newest("exposicion_externa_pct", "exposicion", "ratio_exposicion_externa_pct", "medida")]
        + [
            newest(f"cobertura_rin_{a}", "cobertura", f"cobertura_rin_{a}", "medida")
            for a in ("m1", "m2", "m2a")
        ]
    ),
    "exposicion cobertura",
    "valor",
)


from lunario.workload import stored_oracle as _stored_oracle  # noqa: E402, F401
