"""SQL of the queries over files and stored tables: what must be read back, from the raw tables."""

from __future__ import annotations

from lunario.workload.oracle import (
    AGGREGATES,
    CELLS,
    CURRENCY,
    MONEY,
    NAMES,
    ORACLES,
    SHIP,
    change,
    lagged,
    oracle,
    total,
)

TEXT = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"
DAY = "strftime(o_orderdate, '%Y-%m-%d')"
KEY = "CAST(o_orderkey AS VARCHAR)"
BAD = (
    "(o_orderstatus = 'P' OR o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM'))"
)
oracle(
    "a1_comma_file",
    "SELECT o_orderkey AS pedido, CAST(o_orderdate AS DATE) AS fecha, o_totalprice AS importe, "
    f"CAST(NULL AS VARCHAR) AS texto, CAST(NULL AS VARCHAR) AS motivo FROM orders WHERE NOT {BAD} "
    "UNION ALL SELECT NULL, NULL, NULL, "
    f"CASE WHEN o_orderstatus = 'P' THEN {KEY} || ',\"' || {DAY} || ',' || {TEXT} "
    f"WHEN o_orderpriority = '5-LOW' THEN {KEY} || ',' || {DAY} "
    f"WHEN o_orderpriority = '3-MEDIUM' THEN {KEY} || ',n.d.,' || {TEXT} "
    f"ELSE {KEY} || ',' || {DAY} || ',' || {TEXT} || ',de más' END, "
    "CASE WHEN o_orderstatus = 'P' THEN 'comillas sin cerrar' "
    "WHEN o_orderpriority = '5-LOW' THEN 'faltan campos' "
    "WHEN o_orderpriority = '3-MEDIUM' THEN 'valor ilegible' ELSE 'sobran campos' END "
    f"FROM orders WHERE {BAD}",
    rounded="importe",
)
oracle(
    "a2_code_page_file",
    "SELECT l_orderkey AS pedido, CAST(l_linenumber AS BIGINT) AS linea, "
    f"{NAMES}[month(l_shipdate)] AS mes, CASE l_returnflag WHEN 'A' THEN '€ 5 – “niño”' "
    "WHEN 'N' THEN 'Šalda…ž ‰ ™' ELSE '¿Qué? ½ ü' END AS nota, l_tax AS tasa FROM lineitem",
    rounded="tasa",
)
ORACLES["a3_quoted_file"] = ORACLES["a3_quoted_csv"]
GREATEST = ", ".join(f"MAX({a}) AS {a}" for a in AGGREGATES)
oracle(
    "j_load_csv",
    f"SELECT fecha, {', '.join(f'COALESCE(n.{a}, v.{a}) AS {a}' for a in AGGREGATES)} FROM "
    f"(SELECT fecha, {GREATEST} FROM e_bm GROUP BY fecha) n FULL JOIN "
    f"(SELECT CAST(fecha - INTERVAL 36 MONTH AS DATE) AS fecha, {', '.join(AGGREGATES)} FROM bm "
    "WHERE fecha < DATE '1997-01-01') v USING (fecha)",
    "bm e_bm",
    MONEY,
)
oracle(
    "j7_load_rates",
    "SELECT fecha, moneda, "
    + ", ".join(
        f"[{', '.join(repr(c[n]) for c in CELLS)}][n] AS {name}"
        for n, name in enumerate(("tipo_tasa", "instrumento", "plazo"))
    )
    + f", tasa_porcentaje FROM (SELECT l_suppkey, {SHIP} AS fecha, {CURRENCY} AS moneda, "
    "3 * CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + l_linenumber % 3 + 1 AS n, "
    f"100 * {total('l_discount')} / COUNT(*) AS tasa_porcentaje FROM lineitem GROUP BY ALL)",
    rounded="tasa_porcentaje",
)
SUPPLIER = "cantidad abierto"
oracle(
    "b1_append",
    "SELECT * FROM proveedor",
    "proveedor",
    SUPPLIER,
)
CUSTOMER = (
    "SELECT o_custkey AS entidad, CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, "
    f"{total('o_totalprice')} AS total, "
    + total("CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END")
    + " AS urgente FROM orders GROUP BY ALL"
)
oracle("b2_full_reload", CUSTOMER, rounded="total urgente")
oracle(
    "b8_snapshot",
    "SELECT 'base' AS copia, entidad, 2 * COUNT(*) AS filas, 2 * SUM(cantidad) AS cantidad "
    "FROM proveedor GROUP BY entidad UNION ALL SELECT 'respaldo', entidad, COUNT(*), SUM(cantidad) "
    "FROM proveedor GROUP BY entidad",
    "proveedor",
    "cantidad",
)
oracle(
    "b11_load_job",
    "SELECT fecha, "
    + ", ".join(
        f"CASE WHEN fecha < DATE '1997-01-01' THEN {a} + 1 ELSE {a} END AS {a}" for a in AGGREGATES
    )
    + " FROM bm",
    "bm",
    MONEY,
)
oracle(
    "b4_stored_update",
    "SELECT entidad, fecha, CASE WHEN tc IS NOT NULL AND year(fecha) = 1997 THEN imae * tc ELSE imae "
    "END AS imae FROM e_imae LEFT JOIN e_tc USING (entidad, fecha)",
    "e_imae e_tc",
    "imae",
)
oracle(
    "b6_stored_delete",
    "SELECT * FROM proveedor WHERE fecha <> DATE '1997-03-01' "
    "AND (year(fecha) <> 1998 OR abierto IS NULL OR abierto >= 20)",
    "proveedor",
    SUPPLIER,
)
oracle(
    "b3_stored_upsert",
    f"SELECT entidad, fecha, total, CASE WHEN fecha < DATE '1999-07-01' THEN urgente END AS urgente "
    f"FROM ({CUSTOMER})",
    rounded="total urgente",
)
oracle(
    "b7_generations",
    f"SELECT entidad, fecha, total, CASE WHEN fecha >= DATE '1998-01-01' THEN urgente END AS urgente "
    f"FROM ({CUSTOMER})",
    rounded="total urgente",
)
oracle(
    "b9_checked_load",
    "SELECT p.*, filas_rechazadas, nulos FROM proveedor p, (SELECT COUNT(*) AS filas_rechazadas, "
    "COUNT(*) FILTER (year(fecha) = 1997) AS nulos FROM proveedor "
    "WHERE year(fecha) <> 1997 OR abierto IS NULL)",
    "proveedor",
    SUPPLIER,
)
ORACLES["b10_persistent_view"] = ORACLES["k11_rate_parity"]
oracle(
    "c8_pruned_scan",
    "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, "
    "COUNT(DISTINCT o_custkey) AS filas, "
    f"{total('o_totalprice')} AS total FROM orders WHERE year(o_orderdate) = 1997 "
    "AND quarter(o_orderdate) = 2 GROUP BY 1",
    rounded="total",
)
oracle(
    "l1_kept_state",
    "SELECT entidad, MAX(fecha) AS fecha, arg_max(valor, fecha) AS valor FROM (SELECT entidad, fecha, "
    "MAX(abierto) AS valor FROM (SELECT l_suppkey AS entidad, l_returnflag, "
    f"{SHIP} AS fecha, " + total("CASE WHEN l_linestatus = 'O' THEN l_quantity END")
    + " AS abierto FROM lineitem GROUP BY ALL) WHERE abierto IS NOT NULL "
    "AND (fecha < DATE '2001-03-01' OR l_returnflag = 'R') GROUP BY ALL) GROUP BY entidad",
    rounded="valor",
)
oracle(
    "k4_refresh",
    "SELECT c.entidad, c.fecha, c.cpi_usa, p.cpi_usa AS cpi_usa_anio_anterior, "
    f"{change('c.cpi_usa', 'p.cpi_usa')} AS inflacion_interanual_usa FROM e_cpi_usa c JOIN e_cpi_usa p "
    "ON p.entidad = c.entidad AND p.fecha = CAST(c.fecha - INTERVAL 1 YEAR AS DATE)",
    "e_cpi_usa",
    "cpi_usa cpi_usa_anio_anterior inflacion_interanual_usa",
)
oracle(
    "k6_refresh",
    "SELECT entidad, fecha, inflacion_interanual, desl AS deslizamiento_anual, prev AS "
    "deslizamiento_previo, inflacion_interanual - desl AS brecha_deslizamiento, "
    "CASE WHEN inflacion_interanual - desl <= 1.5 THEN 'Anclaje Exitoso' "
    "WHEN inflacion_interanual - desl <= 4 THEN 'Presión por Costos Importados' "
    "WHEN inflacion_interanual - desl > 4 THEN 'Desalineamiento / Shock Estructural' END "
    f"AS estado_anclaje_cambiario FROM (SELECT *, {lagged('desl', 1, 'entidad')} AS prev FROM ("
    f"SELECT entidad, fecha, inflacion_interanual, {change('tc', lagged('tc', 12, 'entidad'))} AS desl "
    "FROM e_ipc JOIN e_tc USING (entidad, fecha)) WHERE desl IS NOT NULL) WHERE prev IS NOT NULL",
    "e_ipc e_tc",
    "inflacion_interanual deslizamiento_anual deslizamiento_previo brecha_deslizamiento",
)
ORACLES["k10_refresh"] = ORACLES["k10_reserve_coverage"]
