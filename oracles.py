"""DuckDB oracle SQL for the registered queries, written independently of the Spark code.

Tables are the pre-registered views; the dirty fixture is inlined as a CTE.  Nearest-
rank quantiles are taken with ``row_number`` here (the Spark side uses exact order
statistics), so the two sides share no code path.
"""

from __future__ import annotations

from cellwright.plans.fixtures import DIRTY_SQL

DIRTY = f"WITH dirty AS ({DIRTY_SQL})\n"

ORACLES: dict[str, str] = {}


def oracle(name, sql):
    ORACLES[name] = sql


# ---------------------------------------------------------------- A
oracle("flagship", """
SELECT lower(regexp_replace(c_mktsegment, '^\\s+|\\s+$', '', 'g')) AS c_mktsegment,
       count(*) AS n_customers, round(sum(c_acctbal), 2) AS total_acctbal
FROM customer WHERE c_acctbal >= 0 GROUP BY 1""")
CUST = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
oracle("a1_csv_roundtrip", CUST)
oracle("a2_json_roundtrip", CUST)
oracle("a1_csv_late_types", """SELECT o_orderkey, CASE WHEN o_orderkey > (SELECT max(o_orderkey) FROM orders) - 40
  THEN 'late ' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS code FROM orders""")
oracle("a1_csv_multiline", "SELECT doc_id, 'a \"q\", b' || chr(10) || text AS cell FROM documents")
oracle("a1_csv_whole_texts", "SELECT doc_id, 'a \"q\", b' || chr(10) || text || chr(10) || '\"z\",' AS cell FROM documents")
oracle("a2_json_array", CUST)
oracle("a5_detect_format", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS name, '{f}' AS format, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer"
    for n, f in (("t.csv", "csv"), ("t.JSON", "json"), ("t.pq", "parquet"))))
oracle("a8_sample_size", "SELECT least(count(*), 100) AS n, least(count(DISTINCT o_orderkey), 100) AS distinct_keys FROM orders")
oracle("a3_read_parquet", "SELECT * FROM orders")
TYPE_CASE = """CASE WHEN data_type = 'BIGINT' THEN '{b}' WHEN data_type = 'INTEGER' THEN '{i}'
  WHEN data_type = 'DOUBLE' THEN '{d}' WHEN data_type = 'VARCHAR' THEN '{s}'
  WHEN data_type LIKE 'TIMESTAMP%' AND data_type NOT LIKE '%TIME ZONE%' THEN '{t}'
  WHEN data_type = 'DATE' THEN '{dt}' ELSE data_type END"""
SPARK_T = TYPE_CASE.format(b="bigint", i="int", d="double", s="string", t="timestamp_ntz", dt="date")
REF_T = TYPE_CASE.format(b="Int64", i="Int32", d="Float64", s="String", t="Datetime", dt="Date")
oracle("a6_schema_report", f"""
SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
       {SPARK_T} AS spark_type, {REF_T} AS dtype
FROM information_schema.columns WHERE table_name = 'lineitem'""")

DIRTY_COLS = ["row_key", "client_code", "nombre", "email", "telefono", "direccion", "segmento", "saldo",
              "monto", "tasa", "pais", "fecha_nacimiento", "fecha_alta", "puntaje", "pedido", "nota",
              "fecha_texto"]
oracle("a7_table_stats", DIRTY + "\nUNION ALL\n".join(
    f"SELECT (SELECT count(*) FROM dirty) AS row_count, CAST({len(DIRTY_COLS)} AS BIGINT) AS column_count, "
    f"{i} AS position, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM dirty"
    for i, c in enumerate(DIRTY_COLS)))
oracle("a9_preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       CASE WHEN microsecond(o_orderdate) % 1000000 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') END AS o_orderdate,
       o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 10""")

# ---------------------------------------------------------------- B
TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
oracle("b01_clean_nulls", DIRTY + """
SELECT row_key, email, telefono, saldo FROM dirty
WHERE email IS NOT NULL AND telefono IS NOT NULL AND saldo IS NOT NULL""")
oracle("b02_fill_literal", DIRTY + """
SELECT row_key, coalesce(email, 'sin-email') AS email, coalesce(saldo, 0.0) AS saldo FROM dirty""")
oracle("b03_fill_mean", DIRTY + """
SELECT row_key, round(coalesce(saldo, (SELECT avg(saldo) FROM dirty)), 4) AS saldo,
       CAST(puntaje AS DOUBLE) AS puntaje FROM dirty""")
oracle("b04_fill_median", DIRTY + """
SELECT row_key, round(coalesce(saldo, (SELECT median(saldo) FROM dirty)), 4) AS saldo FROM dirty""")
oracle("b05_fill_forward", DIRTY + """
SELECT row_key,
  last_value(email IGNORE NULLS) OVER (ORDER BY row_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS email,
  last_value(saldo IGNORE NULLS) OVER (ORDER BY row_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS saldo,
  last_value(pedido IGNORE NULLS) OVER (ORDER BY row_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pedido
FROM dirty""")
oracle("b06_fill_backward", DIRTY + """
SELECT row_key,
  first_value(email IGNORE NULLS) OVER (ORDER BY row_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS email,
  first_value(saldo IGNORE NULLS) OVER (ORDER BY row_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS saldo,
  first_value(pedido IGNORE NULLS) OVER (ORDER BY row_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pedido
FROM dirty""")
oracle("b05_date_key", """
WITH d AS (SELECT o_orderdate, count(*) AS orders, max(o_custkey) AS top FROM orders GROUP BY o_orderdate)
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, last_value(CASE WHEN top % 3 = 0 THEN orders END IGNORE NULLS)
  OVER (ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS orders FROM d""")
oracle("b05_text_key", """
WITH d AS (SELECT c_name || '/' || c_custkey AS ref, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS v FROM customer)
SELECT ref, last_value(v IGNORE NULLS) OVER (ORDER BY ref ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_acctbal FROM d""")
oracle("b06_composite_key", """
SELECT conv_id, turn, first_value(CASE WHEN (conv_id + turn) % 5 = 1 THEN role END IGNORE NULLS)
  OVER (ORDER BY conv_id, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS role FROM conversations""")
oracle("b07_trim_whitespace", DIRTY + f"""
SELECT row_key, {TRIM.format('nombre')} AS nombre, {TRIM.format('direccion')} AS direccion, saldo FROM dirty""")
oracle("b08_uppercase", DIRTY + "SELECT row_key, upper(email) AS email, upper(nombre) AS nombre FROM dirty")
oracle("b09_lowercase", """
SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM customer""")
oracle("b10_dedup_keep_first", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
oracle("b11_dedup_keep_last", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1""")
oracle("b12_dedup_keep_none", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM (
  SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders) WHERE n = 1""")
oracle("b13_convert_type", """
SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal, CAST(c_nationkey AS VARCHAR) AS c_nationkey
FROM customer""")
oracle("b14_rename_column", """
SELECT c_custkey, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer""")
oracle("b15_drop_column", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
oracle("b16_filter_compare", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
WHERE l_quantity >= 25 AND l_returnflag <> 'N'""")
oracle("b17_filter_contains", """
SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '#0+1[0-9]{2}$')""")
oracle("b18_filter_null", DIRTY + "SELECT row_key, email, telefono FROM dirty WHERE email IS NULL")
oracle("b19_map_values", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'AUTOMOBILE' THEN 'A' ELSE 'OTHER' END
  AS c_mktsegment FROM customer""")
oracle("b20_normalize_dates_format", DIRTY + """
SELECT row_key, strftime(try_strptime(fecha_texto, '%d/%m/%Y'), '%Y-%m-%d') AS fecha_texto,
       strftime(try_strptime(nota, '%d/%m/%Y'), '%Y-%m-%d') AS nota FROM dirty""")
oracle("b21_normalize_dates_auto", DIRTY + """
SELECT row_key, strftime(strptime(fecha_texto, '%d/%m/%Y'), '%Y-%m-%d') AS fecha_texto, nombre,
       strftime(fecha_alta, '%Y-%m-%d') AS alta_compacta FROM dirty""")
oracle("b22_validate_types", f"""
WITH expected(column_name, expected, pos) AS (VALUES
  ('c_custkey', 'int', 1), ('c_name', 'str', 2), ('c_acctbal', 'float', 3), ('c_nationkey', 'int64', 4),
  ('c_mktsegment', 'int', 5), ('c_phone', 'str', 6)),
actual AS (SELECT column_name, {REF_T} AS actual FROM information_schema.columns WHERE table_name = 'customer')
SELECT e.column_name, e.expected, coalesce(a.actual, 'COLUMN_MISSING') AS actual,
  CASE WHEN a.actual IS NULL THEN false
       WHEN e.expected IN ('int', 'int64', 'int32') THEN a.actual IN ('Int8', 'Int16', 'Int32', 'Int64')
       WHEN e.expected IN ('float', 'float64', 'float32') THEN a.actual IN ('Float32', 'Float64')
       WHEN e.expected IN ('str', 'string') THEN a.actual = 'String'
       ELSE false END AS ok
FROM expected e LEFT JOIN actual a USING (column_name)""")


def _nearest(col: str, q: float) -> str:
    """Nearest-rank quantile of a dirty column with row_number (index round((n-1)q))."""
    return (f"(SELECT v FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) AS rn FROM dirty "
            f"WHERE {col} IS NOT NULL) WHERE rn = (SELECT CAST(floor((count({col}) - 1) * {q} + 0.5) AS BIGINT) + 1 "
            f"FROM dirty))")


def _iqr_mask(col: str) -> str:
    q1, q3 = _nearest(col, 0.25), _nearest(col, 0.75)
    return (f"(CAST({col} AS DOUBLE) < {q1} - 1.5 * ({q3} - {q1}) OR CAST({col} AS DOUBLE) > {q3} + 1.5 * ({q3} - {q1}))")


def _z_mask(col: str) -> str:
    return (f"(CASE WHEN (SELECT stddev_samp({col}) FROM dirty) IS NULL OR (SELECT stddev_samp({col}) FROM dirty) = 0 "
            f"THEN false ELSE abs(CAST({col} AS DOUBLE) - (SELECT avg({col}) FROM dirty)) / "
            f"(SELECT stddev_samp({col}) FROM dirty) > 3.0 END)")


OUT_COLS = ["saldo", "monto", "puntaje"]
oracle("b23_outliers_iqr_flag", DIRTY + "SELECT row_key, saldo, monto, puntaje, " + ", ".join(
    f"{_iqr_mask(c)} AS {c}_outlier" for c in OUT_COLS) + " FROM dirty")
oracle("b24_outliers_zscore_flag", DIRTY + "SELECT row_key, saldo, monto, puntaje, " + ", ".join(
    f"{_z_mask(c)} AS {c}_outlier" for c in OUT_COLS) + " FROM dirty")
oracle("b25_outliers_iqr_remove", DIRTY + "SELECT row_key FROM dirty WHERE NOT (false OR " + " OR ".join(
    _iqr_mask(c) for c in OUT_COLS) + ")")
oracle("b26_outliers_zscore_remove", DIRTY + "SELECT row_key FROM dirty WHERE NOT (false OR " + " OR ".join(
    _z_mask(c) for c in OUT_COLS) + ")")
oracle("b27_label_encode", DIRTY + """
SELECT row_key,
  CAST((SELECT count(DISTINCT segmento) FROM dirty d2 WHERE d2.segmento < d.segmento) AS INTEGER) AS segmento,
  CAST((SELECT count(DISTINCT pais) FROM dirty d2 WHERE d2.pais < d.pais) AS INTEGER) AS pais
FROM dirty d""")
oracle("b28_onehot_encode", DIRTY + """
SELECT row_key,
  CAST(segmento = 'BUILDING' AS TINYINT) AS segmento_BUILDING,
  CAST(segmento = 'FURNITURE' AS TINYINT) AS segmento_FURNITURE,
  CAST(segmento = 'FURNITUR' AS TINYINT) AS segmento_FURNITUR,
  CAST(segmento = 'HOUSEHOLD' AS TINYINT) AS segmento_HOUSEHOLD,
  CAST(segmento = 'MACHINERY' AS TINYINT) AS segmento_MACHINERY
FROM dirty""")


# ---------------------------------------------------------------- D (detectors on the dirty view)
# Column classes of the dirty view, decided from its schema and the name keywords.
NUMERIC = ["row_key", "saldo", "monto", "tasa", "puntaje"]
STRINGS = ["client_code", "nombre", "email", "telefono", "direccion", "segmento", "pais", "pedido", "nota",
           "fecha_texto"]
DATES = ["fecha_nacimiento", "fecha_alta"]
EMAIL_COLS, PHONE_COLS, NAME_COLS, ADDR_COLS = ["email"], ["telefono"], ["nombre"], ["direccion"]
ID_LIKE = ["row_key", "client_code", "pedido"]  # names holding id / code / key
EMAIL_RE = "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"
PLACE = ("'n/a','na','null','none','undefined','pendiente','tbd','todo','s/d','sin dato','sin datos',"
         "'desconocido','unknown','0000','xxxxxx','campo en blanco','véase otra columna','ver otra columna',"
         "'no aplica','no disponible','xxx','xx','x','-','--','---'")


def _rec(col, atype, affected, original="NULL", sugg="NULL", num="NULL", rel="NULL", where=None, src="dirty"):
    w = f" WHERE {where}" if where else ""
    return (f"SELECT * FROM (SELECT CAST('{col}' AS VARCHAR) AS column_name, CAST('{atype}' AS VARCHAR) AS anomaly_type, "
            f"CAST({affected} AS BIGINT) AS affected, CAST({original} AS VARCHAR) AS original_value, "
            f"CAST({sugg} AS VARCHAR) AS suggested_value, CAST({num} AS DOUBLE) AS suggested_num, "
            f"CAST({rel} AS VARCHAR) AS related_column FROM {src}){w}")


def _union(parts):
    return DIRTY + "\nUNION ALL\n".join(parts)


def _first(col, cond, what=None):
    return f"arg_min({what or col}, row_key) FILTER (WHERE {cond})"


def _trim(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _mode(col):
    return (f"(SELECT v FROM (SELECT CAST({col} AS VARCHAR) AS v, count(*) AS c FROM dirty WHERE {col} IS NOT NULL "
            f"GROUP BY 1) ORDER BY c DESC, v LIMIT 1)")


def _missing():
    parts = []
    for c in NUMERIC + STRINGS + DATES:
        nul = f"(SELECT count(*) FROM dirty WHERE {c} IS NULL)"
        if c in PHONE_COLS or c in ADDR_COLS:
            sugg, num = "NULL", "NULL"
        elif c in NUMERIC:
            sugg, num = "NULL", f"(SELECT coalesce(round(avg({c}), 4), 0) FROM dirty)"
        elif c in STRINGS:
            sugg, num = f"coalesce({_mode(c)}, '')", "NULL"
        else:
            sugg, num = "'null'", "NULL"
        parts.append(_rec(c, "MISSING_VALUE", nul, sugg=sugg, num=num, where="affected > 0",
                          src="(SELECT 1 AS one)"))
    return _union(parts)


def _zscore():
    parts = []
    for c in NUMERIC:
        st = f"(SELECT avg({c}) AS m, stddev_samp({c}) AS s, count({c}) AS n FROM dirty)"
        cnt = f"(SELECT count(*) FROM dirty, {st} st WHERE st.n >= 4 AND st.s > 0 AND abs({c} - st.m) / st.s > 3)"
        parts.append(_rec(c, "OUTLIER", cnt, num=f"(SELECT round(avg({c}), 4) FROM dirty)", where="affected > 0",
                          src="(SELECT 1 AS one)"))
    for c in DATES:
        bad = f"(year({c}) < 1900 OR year({c}) > 2030)"
        parts.append(_rec(c, "OUTLIER", f"count(*) FILTER (WHERE {bad})", original=_first(c, bad),
                          where="affected > 0"))
    return _union(parts)


def _dup_key(c, expr=None):
    e = expr or c
    if c in EMAIL_COLS:
        return f"lower({_trim(e)})"
    if c in PHONE_COLS:
        return f"regexp_replace({e}, '[\\s\\-()+.]', '', 'g')"
    return f"CAST({e} AS VARCHAR)"


def _duplicates():
    parts = []
    for c in NUMERIC + STRINGS:
        idl = c in ID_LIKE or c in EMAIL_COLS or c in PHONE_COLS
        thr = 0.80 if idl else 0.98
        # numeric columns count native numbers (ties broken numerically), text columns their key
        key = c if c in NUMERIC else _dup_key(c)
        vc = f"(SELECT {key} AS k, count(*) AS cnt FROM dirty WHERE {c} IS NOT NULL GROUP BY 1)"
        ex = "CAST(arg_min(k, (-cnt, k)) AS VARCHAR)"
        if c == "puntaje" or c == "row_key":
            ex = "CAST(arg_min(k, (-cnt, k)) AS VARCHAR)"
        elif c in NUMERIC:
            ex = "CAST(CAST(arg_min(k, (-cnt, k)) AS DOUBLE) AS VARCHAR)"
        src = (f"(SELECT sum(cnt) AS n, count(*) AS d, sum(cnt - 1) FILTER (WHERE cnt > 1) AS extra, "
               f"count(*) FILTER (WHERE cnt > 1) AS reps, {ex} AS ex FROM {vc})")
        parts.append(_rec(c, "DUPLICATE", "extra", original="ex", sugg="'DUPLICADO'",
                          where=f"n >= 4 AND d / n >= {thr} AND reps > 0", src=src)
                     .replace("SELECT CAST(", "SELECT n, d, reps, CAST(", 1))
    sel = "column_name, anomaly_type, affected, original_value, suggested_value, suggested_num, related_column"
    return DIRTY + "\nUNION ALL\n".join(f"SELECT {sel} FROM ({p})" for p in parts)


def _formats():
    parts = []
    for c in EMAIL_COLS:
        bad = f"({c} IS NOT NULL AND NOT regexp_full_match({c}, '{EMAIL_RE}'))"
        parts.append(_rec(c, "FORMAT_INVALID", f"count(*) FILTER (WHERE {bad})", original=_first(c, bad),
                          sugg="'EMAIL_INVALIDO'", where="affected > 0"))
    for c in PHONE_COLS:
        cl = f"regexp_replace({c}, '[\\s\\-()+.]', '', 'g')"
        bad = (f"({c} IS NOT NULL AND (NOT regexp_full_match({cl}, '[0-9]{{7,13}}') OR regexp_full_match({cl}, '0+') "
               f"OR regexp_matches({_trim(c)}, '^\\(?00\\)?[\\s\\-]')))")
        parts.append(_rec(c, "FORMAT_INVALID", f"count(*) FILTER (WHERE {bad})", original=_first(c, bad),
                          sugg="'TEL_INVALIDO'", where="affected > 0"))
    return _union(parts)


def _inconsistent():
    parts = []
    for c in STRINGS:
        vc = f"(SELECT {c} AS v, count(*) AS cnt FROM dirty WHERE {c} IS NOT NULL GROUP BY 1)"
        src = (f"(SELECT *, sum(cnt) FILTER (WHERE cnt < t) AS rare, arg_min(v, (-cnt, v)) FILTER (WHERE cnt < t) AS rex, "
               f"arg_min(v, (-cnt, v)) FILTER (WHERE cnt >= t) AS top FROM "
               f"(SELECT v, cnt, sum(cnt) OVER () AS n, count(*) OVER () AS d, "
               f"greatest(2, CAST(floor(sum(cnt) OVER () * 0.01) AS BIGINT)) AS t FROM {vc}) GROUP BY ALL)")
        src = (f"(SELECT max(n) AS n, max(d) AS d, sum(cnt) FILTER (WHERE cnt < t) AS rare, "
               f"arg_min(v, (-cnt, v)) FILTER (WHERE cnt < t) AS rex, arg_min(v, (-cnt, v)) FILTER (WHERE cnt >= t) AS top "
               f"FROM (SELECT v, cnt, sum(cnt) OVER () AS n, count(*) OVER () AS d, "
               f"greatest(2, CAST(floor(sum(cnt) OVER () * 0.01) AS BIGINT)) AS t FROM {vc}))")
        parts.append(_rec(c, "INCONSISTENT", "rare", original="rex", sugg="top",
                          where="n >= 10 AND d <= 15 AND d / n < 0.10 AND rare > 0", src=src)
                     .replace("SELECT CAST(", "SELECT n, d, rare, CAST(", 1))
    sel = "column_name, anomaly_type, affected, original_value, suggested_value, suggested_num, related_column"
    return DIRTY + "\nUNION ALL\n".join(f"SELECT {sel} FROM ({p})" for p in parts)


def _text(kind):
    parts = []
    for c in STRINGS:
        t = _trim(c)
        if kind == "WHITESPACE_ONLY":
            cond = f"({c} IS NOT NULL AND length({t}) = 0)"
            parts.append(_rec(c, kind, f"count(*) FILTER (WHERE {cond})",
                              original=f"'''' || {_first(c, cond)} || ''''", where="affected > 0"))
        elif kind == "SUSPICIOUS_PLACEHOLDER":
            cond = f"(lower({t}) IN ({PLACE}))"
            parts.append(_rec(c, kind, f"count(*) FILTER (WHERE {cond})", original=_first(c, cond),
                              sugg="'PENDIENTE_COMPLETAR'", where="affected > 0"))
        else:
            cond = f"({c} <> {t} AND length({t}) > 0)"
            parts.append(_rec(c, kind, f"count(*) FILTER (WHERE {cond})", original=_first(c, cond),
                              sugg=_first(c, cond, t), where="affected > 0"))
    return _union(parts)


def _swaps():
    """Wrong-field rules: name holds e-mail (all rows), then rules on all non-null values."""
    parts = []
    for c in STRINGS:
        samp = f"(SELECT {c} AS v, row_key FROM dirty WHERE {c} IS NOT NULL)"
        st = _trim("v")
        rules = {
            "date": "v <> '' AND regexp_matches(v, '^[0-9]{1,2}[/\\-][0-9]{1,2}[/\\-][0-9]{2,4}$|^[0-9]{4}[/\\-][0-9]{1,2}[/\\-][0-9]{1,2}$')",
            "phone": f"v <> '' AND regexp_matches({st}, '^[+\\s\\-()]*[0-9][0-9\\s\\-.()]{{6,19}}$') "
                     f"AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7",
            "phone_email": f"v <> '' AND regexp_matches({st}, '^\\+?[0-9\\s\\-()]{{7,20}}$') AND position('@' IN v) = 0",
            "email_addr": f"v <> '' AND regexp_matches(v, '{EMAIL_RE}')",
            "id_addr": f"v <> '' AND regexp_matches({st}, '^[A-Z][0-9]{{4}}$')",
            "locality": f"v <> '' AND regexp_matches({st}, '^[A-Za-z\\s]+,\\s*[A-Z]{{2}}\\s+[0-9]{{5}}$')",
        }
        cols = ", ".join(f"count(*) FILTER (WHERE {r}) AS {k}, arg_min(v, row_key) FILTER (WHERE {r}) AS {k}_ex"
                         for k, r in rules.items())
        full = (f"(SELECT count(*) FILTER (WHERE regexp_full_match({c}, '{EMAIL_RE}')) AS em, "
                f"arg_min({c}, row_key) FILTER (WHERE regexp_full_match({c}, '{EMAIL_RE}')) AS em_ex FROM dirty)")
        is_name, is_phone = c in NAME_COLS, c in PHONE_COLS
        is_email, is_addr = c in EMAIL_COLS, c in ADDR_COLS
        chain = []
        if is_name:
            chain.append(("em > 0", "em", "em_ex"))
            chain.append(("date > 0", "date", "date_ex"))
        if not is_phone:
            chain.append(("phone > 0 AND phone / greatest(n, 1) > 0.1", "phone", "phone_ex"))
        if is_email:
            chain.append(("phone_email > 0", "phone_email", "phone_email_ex"))
        if is_addr:
            chain.append(("email_addr > 0", "email_addr", "email_addr_ex"))
            chain.append(("id_addr > 0", "id_addr", "id_addr_ex"))
        if is_name:
            chain.append(("locality > 0", "locality", "locality_ex"))
        if not chain:
            continue
        cnt = "CASE " + " ".join(f"WHEN {w} THEN {a}" for w, a, _ in chain) + " END"
        ex = "CASE " + " ".join(f"WHEN {w} THEN {e}" for w, _, e in chain) + " END"
        src = f"(SELECT * FROM (SELECT count(*) AS n, {cols} FROM {samp}), {full})"
        parts.append(_rec(c, "CROSS_FIELD_SWAP", cnt, original=ex, sugg="'VALOR_EN_CAMPO_INCORRECTO'",
                          where="affected IS NOT NULL AND affected > 0", src=src))
    return _union(parts)


def _date_logical():
    s, e = "fecha_nacimiento", "fecha_alta"
    inv = f"({s} IS NOT NULL AND {e} IS NOT NULL AND {s} > {e})"
    orig = f"'{s}=' || CAST({_first(s, inv)} AS VARCHAR) || ' | {e}=' || CAST({_first(e, inv)} AS VARCHAR)"
    return _union([_rec(s, "DATE_LOGICAL", f"count(*) FILTER (WHERE {inv})", original=orig, rel=f"'{e}'",
                        where="affected > 0")])


def _round_numbers():
    parts = []
    for c in NUMERIC:
        if c in ID_LIKE:
            continue
        src = (f"(SELECT *, count(*) FILTER (WHERE CAST({c} AS DOUBLE) % dv = 0) AS hits, "
               f"arg_min(CAST({c} AS DOUBLE), row_key) FILTER (WHERE CAST({c} AS DOUBLE) % dv = 0) AS ex FROM dirty, "
               f"(SELECT count({c}) AS n, avg({c}) AS m, stddev_samp({c}) AS s, "
               f"CASE WHEN abs(avg({c})) >= 1000 THEN 1000.0 ELSE 100.0 END AS dv FROM dirty) GROUP BY ALL)")
        src = (f"(SELECT max(n) AS n, max(m) AS m, max(s) AS s, "
               f"count(*) FILTER (WHERE CAST({c} AS DOUBLE) % dv = 0) AS hits, "
               f"arg_min(CAST({c} AS DOUBLE), row_key) FILTER (WHERE CAST({c} AS DOUBLE) % dv = 0) AS ex FROM dirty, "
               f"(SELECT count({c}) AS n, avg({c}) AS m, stddev_samp({c}) AS s, "
               f"CASE WHEN abs(avg({c})) >= 1000 THEN 1000.0 ELSE 100.0 END AS dv FROM dirty))")
        parts.append(_rec(c, "NUMERIC_ROUND_NUMBER", "hits", original="ex",
                          where="n >= 10 AND m <> 0 AND s >= abs(m) * 0.1 AND hits / n > 0.40", src=src)
                     .replace("SELECT CAST(", "SELECT n, m, s, hits, CAST(", 1))
    sel = "column_name, anomaly_type, affected, original_value, suggested_value, suggested_num, related_column"
    return DIRTY + "\nUNION ALL\n".join(f"SELECT {sel} FROM ({p})" for p in parts)


def _low_variance():
    parts = []
    sel = "column_name, anomaly_type, affected, original_value, suggested_value, suggested_num, related_column"
    for c in NUMERIC:
        if c in ID_LIKE:
            continue
        src = f"(SELECT count({c}) AS n, avg({c}) AS m, stddev_samp({c}) AS s FROM dirty)"
        parts.append(_rec(c, "LOW_VARIANCE", "n", original="CAST(round(m, 4) AS VARCHAR)",
                          where="n > 10 AND m <> 0 AND s / abs(m) < 0.01", src=src)
                     .replace("SELECT CAST(", "SELECT n, m, s, CAST(", 1))
    for c in STRINGS:
        if c in ID_LIKE:
            continue
        vc = f"(SELECT {c} AS v, count(*) AS cnt FROM dirty WHERE {c} IS NOT NULL GROUP BY 1)"
        src = f"(SELECT sum(cnt) AS n, max(cnt) AS top, arg_min(v, (-cnt, v)) AS tv FROM {vc})"
        parts.append(_rec(c, "LOW_VARIANCE", "n", original="tv", sugg="'GRUPO_BAJO_VARIANZA'",
                          where="n > 10 AND top / n >= 0.95", src=src)
                     .replace("SELECT CAST(", "SELECT n, top, CAST(", 1))
    return DIRTY + "\nUNION ALL\n".join(f"SELECT {sel} FROM ({p})" for p in parts)


def _iqr():
    parts = []
    sel = "column_name, anomaly_type, affected, original_value, suggested_value, suggested_num, related_column"
    for c in NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        ranked = f"(SELECT {x} AS v, row_number() OVER (ORDER BY {x}) AS rn, count(*) OVER () AS n FROM dirty WHERE {c} IS NOT NULL)"
        qs = (f"(SELECT max(v) FILTER (WHERE rn = CAST(floor((n - 1) * 0.25 + 0.5) AS BIGINT) + 1) AS q1, "
              f"max(v) FILTER (WHERE rn = CAST(floor((n - 1) * 0.75 + 0.5) AS BIGINT) + 1) AS q3, "
              f"max(n) AS n, median(v) AS med FROM {ranked})")
        z = (f"(SELECT count(*) FROM dirty, (SELECT avg({c}) AS m, stddev_samp({c}) AS s, count({c}) AS n FROM dirty) st "
             f"WHERE st.n >= 4 AND st.s > 0 AND abs({c} - st.m) / st.s > 3)")
        out = f"({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1))"
        src = (f"(SELECT max(n) AS n, max(q3) - max(q1) AS iqr, max(med) AS med, count(*) FILTER (WHERE {out}) AS cnt, "
               f"arg_min({x}, row_key) FILTER (WHERE {out}) AS ex, {z} AS zc FROM dirty, {qs})")
        parts.append(_rec(c, "OUTLIER_IQR", "cnt", original="CAST(ex AS VARCHAR)", num="round(med, 4)",
                          where="n >= 4 AND iqr <> 0 AND cnt > 0 AND zc = 0", src=src)
                     .replace("SELECT CAST(", "SELECT n, iqr, cnt, zc, CAST(", 1))
    return DIRTY + "\nUNION ALL\n".join(f"SELECT {sel} FROM ({p})" for p in parts)


def _sequences():
    """Sequence rule per text column with sorted-index quartiles (index int(n*q))."""
    parts = []
    sel = "column_name, anomaly_type, affected, original_value, suggested_value, suggested_num, related_column"
    pat = "^([A-Za-z\\-_]*)([0-9]+)$"
    for c in STRINGS:
        gate = (f"(SELECT count({c}) AS n, count(DISTINCT {c}) AS d, "
                f"count(*) FILTER (WHERE regexp_full_match({c}, '{pat}')) AS m FROM dirty)")
        pref = (f"(SELECT p, cnt FROM (SELECT regexp_extract({c}, '{pat}', 1) AS p, count(*) AS cnt FROM dirty "
                f"WHERE regexp_full_match({c}, '{pat}') AND length(regexp_extract({c}, '{pat}', 2)) <= 36 "
                f"GROUP BY 1) ORDER BY cnt DESC, p LIMIT 1)")
        nums = (f"(SELECT CAST(regexp_extract({c}, '{pat}', 2) AS DECIMAL(38,0)) AS x FROM dirty, {pref} pr "
                f"WHERE regexp_full_match({c}, '{pat}') AND regexp_extract({c}, '{pat}', 1) = pr.p "
                f"AND length(regexp_extract({c}, '{pat}', 2)) <= 36)")
        srt = f"(SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS k FROM {nums})"
        qs = (f"(SELECT max(x) FILTER (WHERE i = least(k - 1, CAST(floor(k * 0.25) AS BIGINT))) AS q1, "
              f"max(x) FILTER (WHERE i = least(k - 1, CAST(floor(k * 0.75) AS BIGINT))) AS q3, "
              f"max(x) FILTER (WHERE i = least(k - 1, CAST(floor(k * 0.10) AS BIGINT))) AS p10, "
              f"max(x) FILTER (WHERE i = least(k - 1, CAST(floor(k * 0.90) AS BIGINT))) AS p90, "
              f"min(x) AS mn, max(x) AS mx, count(DISTINCT x) AS dx, max(k) AS k FROM {srt})")
        fence = (f"(SELECT *, CASE WHEN q3 - q1 > 0 THEN q1 - 1.5 * (q3 - q1) ELSE p10 END AS lo, "
                 f"CASE WHEN q3 - q1 > 0 THEN q3 + 1.5 * (q3 - q1) ELSE p90 END AS hi FROM {qs})")
        outs = (f"(SELECT count(*) FILTER (WHERE x < lo OR x > hi) AS outn, min(x) FILTER (WHERE x < lo OR x > hi) AS outx, "
                f"min(x) FILTER (WHERE x >= lo AND x <= hi) AS cmin, max(x) FILTER (WHERE x >= lo AND x <= hi) AS cmax "
                f"FROM {nums}, {fence})")
        hole = (f"(SELECT min(a.x) + 1 AS h FROM (SELECT DISTINCT x FROM {nums}) a "
                f"WHERE a.x < (SELECT max(x) FROM {nums}) AND NOT EXISTS "
                f"(SELECT 1 FROM (SELECT DISTINCT x FROM {nums}) b WHERE b.x = a.x + 1))")
        pad = "length(CAST(mn AS VARCHAR))"
        src = f"(SELECT * FROM {gate}, {pref} pr, {fence} f, {outs} o, {hole} hh)"
        affected = "CASE WHEN outn > 0 THEN outn ELSE (mx - mn + 1) - dx END"
        def zfill(v):  # Python str.zfill: pad to the width, never cut
            s_ = f"CAST({v} AS VARCHAR)"
            return f"(CASE WHEN length({s_}) >= {pad} THEN {s_} ELSE lpad({s_}, CAST({pad} AS INTEGER), '0') END)"
        ex = f"CASE WHEN outn > 0 THEN p || {zfill('outx')} ELSE p || {zfill('h')} END"
        lo_hi = (f"CASE WHEN outn > 0 AND q3 - q1 > 0 THEN CAST(cmin AS VARCHAR) || '|' || CAST(cmax AS VARCHAR) "
                 f"WHEN outn > 0 THEN CAST(p10 AS VARCHAR) || '|' || CAST(p90 AS VARCHAR) "
                 f"ELSE CAST(mn AS VARCHAR) || '|' || CAST(mx AS VARCHAR) END")
        orig = f"p || '|' || {lo_hi} || '|' || {ex}"
        parts.append(_rec(c, "SEQUENCE_GAP", affected, original=orig, sugg="'ID_FUERA_SECUENCIA'",
                          where=("n >= 4 AND d / n >= 0.95 AND m / n >= 0.80 AND cnt / n >= 0.80 AND k >= 2 "
                                 "AND affected > 0"), src=src)
                     .replace("SELECT CAST(", "SELECT n, d, m, cnt, k, CAST(", 1))
    return DIRTY + "\nUNION ALL\n".join(f"SELECT {sel} FROM ({p})" for p in parts)


oracle("d01_missing_value", _missing())
oracle("d02_outlier_zscore_and_dates", _zscore())
oracle("d03_duplicate", _duplicates())
oracle("d04_format_invalid", _formats())
oracle("d06_inconsistent", _inconsistent())
oracle("d08_whitespace_only", _text("WHITESPACE_ONLY"))
oracle("d09_cross_field_swap", _swaps())
oracle("d10_placeholder", _text("SUSPICIOUS_PLACEHOLDER"))
oracle("d11_leading_trailing", _text("LEADING_TRAILING_WHITESPACE"))
oracle("d12_date_logical", _date_logical())
oracle("d13_round_number", _round_numbers())
oracle("d14_low_variance", _low_variance())
oracle("d16_outlier_iqr", _iqr())
oracle("d17_sequence_gap", _sequences())
_ALL_D = ["d01_missing_value", "d02_outlier_zscore_and_dates", "d03_duplicate", "d04_format_invalid",
          "d06_inconsistent", "d08_whitespace_only", "d09_cross_field_swap", "d10_placeholder",
          "d11_leading_trailing", "d12_date_logical", "d13_round_number", "d14_low_variance", "d16_outlier_iqr",
          "d17_sequence_gap"]
oracle("d00_all_anomalies", DIRTY + "\nUNION ALL\n".join(
    f"SELECT * FROM ({ORACLES[k][len(DIRTY):]})" for k in _ALL_D))


# ---------------------------------------------------------------- M (review analytics)
from cellwright.plans.fixtures import (ANOMALY_SQL_BODY, DATASET_STATUS_SQL, DECISION_SQL_BODY,  # noqa: E402
                                       SUGGESTION_SQL_BODY)

REVIEW = f"""WITH datasets AS (
  SELECT o_orderkey AS dataset_id, o_custkey AS user_id, 'dataset-' || CAST(o_orderkey AS VARCHAR) AS name,
         {DATASET_STATUS_SQL} AS status, o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0
              THEN o_orderdate + to_hours(CAST(o_orderkey % 48 AS INTEGER)) END AS processed_at
  FROM orders),
anomalies AS (SELECT {ANOMALY_SQL_BODY} FROM lineitem),
decisions AS (SELECT {DECISION_SQL_BODY} FROM lineitem WHERE l_linestatus = 'F'),
suggestions AS (SELECT {SUGGESTION_SQL_BODY} FROM events),
pend AS (SELECT d.user_id, count(*) AS pending_reviews FROM anomalies a JOIN datasets d USING (dataset_id)
         WHERE a.status = 'PENDING' GROUP BY 1)
"""
oracle("m01_user_stats", REVIEW + """
SELECT user_id, count(*) AS total_datasets,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '1998-06-01') AS datasets_this_month,
  count(*) FILTER (WHERE status <> 'PENDING') AS total_jobs,
  count(*) FILTER (WHERE status = 'READY') AS jobs_completed,
  count(*) FILTER (WHERE status = 'ERROR') AS jobs_failed,
  CAST(coalesce(floor(avg(epoch_ms(processed_at) - epoch_ms(created_at))
       FILTER (WHERE status = 'READY' AND processed_at IS NOT NULL) + 0.5), 0) AS BIGINT) AS avg_processing_time_ms,
  CAST(coalesce(max(p.pending_reviews), 0) AS BIGINT) AS pending_reviews
FROM datasets LEFT JOIN pend p USING (user_id) GROUP BY user_id""")
oracle("m02_anomalies_with_decision", REVIEW + """
SELECT a.anomaly_id, a.dataset_id, a.anomaly_type, a.status, a.created_at, d.action AS decision_action
FROM anomalies a LEFT JOIN decisions d USING (anomaly_id)""")
oracle("m03_pending_by_user", REVIEW + "SELECT user_id, CAST(pending_reviews AS BIGINT) AS pending_reviews FROM pend")
oracle("m04_pending_by_dataset", REVIEW + """
SELECT dataset_id, count(*) AS pending FROM anomalies WHERE status = 'PENDING' GROUP BY 1""")
oracle("m05_decisions_of_datasets", REVIEW + """
SELECT d.anomaly_id, a.dataset_id, d.action FROM decisions d JOIN anomalies a USING (anomaly_id)""")
oracle("m06_review_totals", REVIEW + """
SELECT a.dataset_id, count(*) AS total_anomalies,
  count(*) FILTER (WHERE d.action = 'APPROVED') AS approved, count(*) FILTER (WHERE d.action = 'CORRECTED') AS corrected,
  count(*) FILTER (WHERE d.action = 'DISCARDED') AS discarded, count(*) FILTER (WHERE d.action IS NULL) AS pending
FROM anomalies a LEFT JOIN decisions d USING (anomaly_id) GROUP BY 1""")
oracle("m06_review_by_type", REVIEW + """,
j AS (SELECT a.*, d.action FROM anomalies a LEFT JOIN decisions d USING (anomaly_id)),
pa AS (SELECT dataset_id, anomaly_type, action, count(*) AS n, min(created_at) AS fts,
              arg_min(anomaly_id, (created_at, anomaly_id)) AS fid
       FROM j WHERE action IS NOT NULL GROUP BY 1, 2, 3),
dom AS (SELECT dataset_id, anomaly_type, arg_min(action, (-n, fts, fid)) AS dominant FROM pa GROUP BY 1, 2)
SELECT c.dataset_id, c.anomaly_type, c.count, coalesce(dom.dominant, 'PENDING') AS action
FROM (SELECT dataset_id, anomaly_type, count(*) AS count FROM j GROUP BY 1, 2) c
LEFT JOIN dom USING (dataset_id, anomaly_type)""")
oracle("m07_dataset_page", REVIEW + """
SELECT dataset_id, user_id, status, created_at FROM datasets
ORDER BY created_at DESC, dataset_id DESC LIMIT 20 OFFSET 20""")
oracle("m08_upsert_latest", REVIEW + """,
upd AS (SELECT anomaly_id, 'IN_REVIEW' AS status, created_at AS updated_at FROM decisions WHERE action = 'APPROVED'
        UNION ALL SELECT anomaly_id, 'RESOLVED', created_at + INTERVAL 1 DAY FROM decisions),
lu AS (SELECT anomaly_id, arg_max(status, (updated_at, status)) AS status FROM upd GROUP BY 1)
SELECT a.anomaly_id, a.dataset_id, a.anomaly_type, coalesce(lu.status, a.status) AS status
FROM anomalies a LEFT JOIN lu USING (anomaly_id)""")
ORACLES["m08_merge_bucketed"] = ORACLES["m08_upsert_latest"]
DEC_ALL = """, dec_all AS (SELECT anomaly_id FROM decisions UNION ALL
  SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 50 = 0)
"""
oracle("m09_resolve_anomalies", REVIEW + DEC_ALL + """
SELECT anomaly_id, CASE WHEN anomaly_id IN (SELECT anomaly_id FROM dec_all) THEN 'RESOLVED' ELSE status END AS status
FROM anomalies""")
oracle("m09_rejected_decisions", REVIEW + DEC_ALL + """
SELECT DISTINCT anomaly_id FROM dec_all WHERE anomaly_id NOT IN (SELECT anomaly_id FROM anomalies)""")
NORM = """norm AS (SELECT anomaly_id, CASE WHEN json_valid(suggestion) AND json_type(suggestion) = 'OBJECT'
    AND json_extract_string(suggestion, '$.actionType') IN ('FILL', 'DELETE', 'KEEP') THEN suggestion
  ELSE CAST(json_object('actionType', 'KEEP', 'value', NULL, 'reason', substr(suggestion, 1, 100)) AS VARCHAR) END
  AS suggestion
  FROM suggestions WHERE anomaly_id IS NOT NULL AND CAST(anomaly_id AS VARCHAR) <> ''
    AND suggestion IS NOT NULL AND suggestion <> '')
"""
oracle("m10_normalize_suggestions", REVIEW + ", " + NORM + "SELECT anomaly_id, suggestion FROM norm")
oracle("m11_read_suggestions", REVIEW + ", " + NORM + """
SELECT anomaly_id, suggestion,
  CASE WHEN json_valid(suggestion) AND json_type(suggestion) = 'OBJECT'
       THEN json_extract_string(suggestion, '$.actionType') END AS ai_action_type,
  CASE WHEN json_valid(suggestion) AND json_type(suggestion) = 'OBJECT'
       THEN json_extract_string(suggestion, '$.value') END AS ai_action_value,
  CASE WHEN json_valid(suggestion) AND json_type(suggestion) = 'OBJECT'
       THEN coalesce(json_extract_string(suggestion, '$.reason'), suggestion) ELSE suggestion END
    AS ai_suggestion_text
FROM norm""")


def _evidence():
    dtype = {c: "bigint" for c in ["row_key"]} | {c: "double" for c in ["saldo", "monto", "tasa"]} | \
            {"puntaje": "int"} | {c: "string" for c in STRINGS} | {c: "date" for c in DATES}
    anoms = ORACLES["d00_all_anomalies"][len(DIRTY):]
    parts = []
    for c in NUMERIC + STRINGS + DATES:
        num = c in NUMERIC
        x = f"CAST({c} AS DOUBLE)"
        if num:
            st = (f"(SELECT count({c}) AS n, avg({x}) AS m, stddev_samp({x}) AS s FROM dirty)")
            ranked = f"(SELECT {x} AS v, row_number() OVER (ORDER BY {x}) AS rn FROM dirty WHERE {c} IS NOT NULL)"
            q = lambda p: (f"(SELECT v FROM {ranked} WHERE rn = (SELECT CAST(floor((count({c}) - 1) * {p} + 0.5) AS BIGINT) + 1 "
                           f"FROM dirty))")
            outl = (f"(SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY rk) FROM (SELECT {x} AS v, row_key AS rk FROM dirty, "
                    f"{st} t WHERE t.n >= 2 AND t.s > 0 AND abs({x} - t.m) / t.s > 3 ORDER BY row_key LIMIT 10))")
            stats = (f"CASE WHEN t.n >= 2 THEN round(t.m, 4) END AS mean, CASE WHEN t.n >= 2 THEN round(t.s, 4) END AS std, "
                     f"CASE WHEN t.n >= 2 THEN {q(0.05)} END AS q05, CASE WHEN t.n >= 2 THEN {q(0.95)} END AS q95, "
                     f"CASE WHEN a.anomaly_type = 'OUTLIER' THEN {outl} END AS outliers")
            src = f", {st} t"
        else:
            stats = ("CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS q05, "
                     "CAST(NULL AS DOUBLE) AS q95, CAST(NULL AS VARCHAR) AS outliers")
            src = ""
        samples = (f"(SELECT string_agg(v, '|' ORDER BY rk) FROM (SELECT CAST({c} AS VARCHAR) AS v, row_key AS rk "
                   f"FROM dirty WHERE {c} IS NOT NULL ORDER BY row_key LIMIT 5))")
        parts.append(f"SELECT a.column_name, a.anomaly_type, '{dtype[c]}' AS dtype, a.affected, {stats}, "
                     f"{samples} AS samples FROM anoms a{src} WHERE a.column_name = '{c}'")
    return DIRTY.rstrip("\n") + f", anoms AS ({anoms})\n" + "\nUNION ALL\n".join(parts)


oracle("m12_column_evidence", _evidence())

oracle("b29_transform_chain", DIRTY + f"""SELECT row_key, {_trim('telefono')} AS telefono, coalesce(saldo, 0) AS saldo, email,
  'TRIM_WHITESPACE:ok,FILL_NULLS:ok,FILTER_ROWS:ok,CONVERT_TYPE:failed' AS steps
FROM dirty WHERE coalesce(saldo, 0) >= 100""")

# ---------------------------------------------------------------- I, F, C, O (correction language)
def _corrections():
    from cellwright.plans.corrections import BASE_SQL, REFUSED, SPECS
    b = f"WITH b AS ({BASE_SQL} FROM orders)\n"
    one = lambda agg: f"(SELECT {agg}(v) FROM b)"
    yes = lambda cond: f"CASE WHEN {cond} THEN 'yes' ELSE 'no' END"
    mean = one("avg")
    value = {
        "i01_fill_literal": "42", "i02_fill_mean": mean, "i03_fill_median": one("median"), "i04_fill_min": one("min"),
        "i05_fill_max": one("max"), "i06_fill_sum": one("sum"),
        "i07_fill_mode": "(SELECT st FROM b WHERE st IS NOT NULL GROUP BY st ORDER BY count(*) DESC, st LIMIT 1)",
        "i08_fill_from_column": "w", "i09_delete_rows": "v", "i10_keep": "v", "i11_transform": "round_even(w * 2, 1)",
        "i12_conditional": f"CASE WHEN v > {mean} THEN 1.0 ELSE w END",
        "f01_round": "round_even(w, 1)", "f02_floor": "floor(w)", "f03_ceil": "ceil(w)", "f04_abs": "abs(w)",
        "f05_upper": "upper(s)", "f06_lower": "lower(s)",
        "f07_title": "array_to_string(list_transform(regexp_extract_all(s, '[a-z]+|[^a-z]+'), "
                     "lambda p: upper(p[1]) || lower(p[2:])), '')",
        "f08_trim": "trim(s)", "f09_multiply": "w * 4", "f10_add": "w + 4", "f11_subtract": "w - 4", "f12_divide": "w / 4",
        "c01_eq": yes("st = 'F'"), "c02_neq": yes("st <> 'F'"), "c03_gt": yes("n > 700"), "c04_gte": yes("n >= 700"),
        "c05_lt": yes("n < 700"), "c06_lte": yes("n <= 700"), "c07_is_null": yes("v IS NULL"),
        "c08_is_not_null": yes("v IS NOT NULL"), "c09_contains": yes("contains(s, '-')"),
        "c10_starts_with": yes("starts_with(s, '  1')"), "c11_ends_with": yes("ends_with(s, 'h ')"),
        "c12_between": yes("v BETWEEN 50000 AND 150000"), "c13_eq_text_number": "'no'", "o01_literal": yes("n >= 500"),
        "o02_column": yes("v < w"), "o03_aggregate": yes(f"v > {one('median')}"),
    }
    kind = {"i09_delete_rows": "DELETE", "i10_keep": "KEEP"}
    for name, target, _, mask in SPECS:
        v = f"CASE WHEN {mask} THEN {value[name]} ELSE {target} END"
        v = f"round({v}, 4)" if target in "vw" else v
        oracle(name, f"{b}SELECT k, '{kind.get(name, 'FILL')}' AS kind, {v} AS value FROM b")
    oracle("c14_refused_trees", b + "\nUNION ALL\n".join(
        f"SELECT '{reason}' AS reason, true AS refused, count(*) AS n, round(sum({target}), 2) AS total FROM b"
        for reason, target, _ in REFUSED))


_corrections()
from cellwright.plans.corrections import TYPED_SQL  # noqa: E402

oracle("p03_apply_types", f"""WITH b AS ({TYPED_SQL} FROM orders)
SELECT k, d, coalesce(e, DATE '2020-01-31') AS e, CAST(coalesce(m, 2.50) AS VARCHAR) AS m,
       'date,date,decimal(12,2)' AS types FROM b""")

# ---------------------------------------------------------------- N (instruction rules)
from cellwright.plans.registry import INSTRUCTION_SQL  # noqa: E402


def _instructions():
    t = "regexp_replace(instruction, '^\\s+|\\s+$', '', 'g')"
    cond = f"regexp_matches({t}, '(?i)\\b(si|cuando|mayor|menor|igual|entre|mientras)\\b')"
    num = "^\\s*(-?[0-9]+(\\.[0-9]+)?)\\s*$"
    quoted = "^\"(.+)\"$|^''(.+)''$"
    copy = "(?i)(copia|toma).+(de|del)\\s+[''\"]?([A-Za-z0-9_]+)"
    cols = "('event_id', 'ts', 'user_id', 'event_type', 'value', 'props')"
    rules = [
        (f"regexp_matches({t}, '(?i)^\\s*null\\s*$')", "'FILL_LITERAL'", {}),
        (f"regexp_matches({t}, '{num}')", "'FILL_LITERAL'",
         {"value_num": f"CAST(regexp_extract({t}, '{num}', 1) AS DOUBLE)"}),
        (f"regexp_matches({t}, '{quoted}')", "'FILL_LITERAL'",
         {"value_text": f"coalesce(nullif(regexp_extract({t}, '{quoted}', 1), ''), regexp_extract({t}, '{quoted}', 2))"}),
        (f"regexp_matches({t}, '(?i)(usa|con|pon).+(mediana)')", "'FILL_AGGREGATE'", {"agg": "'median'"}),
        (f"regexp_matches({t}, '(?i)(usa|con|pon).+(media|promedio)')", "'FILL_AGGREGATE'", {"agg": "'mean'"}),
        (f"regexp_matches({t}, '(?i)(usa|con|pon).+(moda)')", "'FILL_AGGREGATE'", {"agg": "'mode'"}),
        (f"regexp_matches({t}, '(?i)(usa|con|pon).+(m[íi]nimo)')", "'FILL_AGGREGATE'", {"agg": "'min'"}),
        (f"regexp_matches({t}, '(?i)(usa|con|pon).+(m[áa]ximo)')", "'FILL_AGGREGATE'", {"agg": "'max'"}),
        (f"regexp_matches({t}, '(?i)(elimina|borra|quita).+(fila|registro)')", "'DELETE_ROWS'", {}),
        (f"regexp_matches({t}, '(?i)(mantener|dejar|deja|conserva)')", "'KEEP'", {}),
        (f"regexp_matches({t}, '{copy}')",
         f"CASE WHEN regexp_extract({t}, '{copy}', 3) IN {cols} THEN 'FILL_FROM_COLUMN' END",
         {"source_column": f"regexp_extract({t}, '{copy}', 3)"}),
    ]

    def chain(field):
        whens = " ".join(f"WHEN {r} THEN {op if field == 'op' else extra.get(field, 'NULL')}"
                         for r, op, extra in rules)
        return f"CASE WHEN {cond} THEN NULL {whens} ELSE NULL END"

    return f"""WITH ev AS (SELECT event_id, {INSTRUCTION_SQL} AS instruction FROM events),
p AS (SELECT event_id, {chain('op')} AS op, CAST({chain('value_text')} AS VARCHAR) AS value_text,
  CAST({chain('value_num')} AS DOUBLE) AS value_num, CAST({chain('agg')} AS VARCHAR) AS agg,
  CAST({chain('source_column')} AS VARCHAR) AS source_column FROM ev)
SELECT event_id, op, value_text, value_num, agg,
  CASE WHEN op IS NOT NULL THEN source_column END AS source_column,
  CASE WHEN op IS NOT NULL THEN 'rule' ELSE 'unresolved' END AS source FROM p"""


oracle("n01_parse_instructions", _instructions())

# ---------------------------------------------------------------- S (streams, checked against batch SQL)
JOB_EV = """je AS (SELECT user_id AS job_id, ts, event_id,
  CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'active' END AS event
  FROM events)"""
oracle("s01_latest_status", f"""WITH {JOB_EV}
SELECT job_id, CASE arg_max(event, (ts, event_id)) WHEN 'active' THEN 'PROCESSING' WHEN 'completed' THEN 'READY'
  WHEN 'failed' THEN 'ERROR' END AS status, max(ts) AS updated_at, count(*) AS n_events FROM je GROUP BY 1""")
oracle("s02_job_feed", f"""WITH {JOB_EV},
o AS (SELECT *, lag(event) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS prev,
  count(*) FILTER (WHERE event IN ('completed', 'failed')) OVER (PARTITION BY job_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS terms_before FROM je)
SELECT job_id, ts, event_id, event FROM o WHERE coalesce(terms_before, 0) = 0 AND (prev IS NULL OR prev <> event)""")
oracle("s04_row_checks", """WITH p AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events),
r AS (SELECT value AS v, row_number() OVER (ORDER BY value) AS rn FROM events WHERE value IS NOT NULL),
q AS (SELECT max(v) FILTER (WHERE rn = (SELECT CAST(floor((count(value) - 1) * 0.25 + 0.5) AS BIGINT) + 1 FROM events)) AS q1,
             max(v) FILTER (WHERE rn = (SELECT CAST(floor((count(value) - 1) * 0.75 + 0.5) AS BIGINT) + 1 FROM events)) AS q3
      FROM r)
SELECT count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS missing_value,
  count(*) FILTER (WHERE year(ts) < 1900 OR year(ts) > 2030) AS date_outlier,
  count(*) FILTER (WHERE lower(trim(event_type)) IN (""" + PLACE + """)) AS placeholder,
  count(*) FILTER (WHERE event_type <> trim(event_type) AND length(trim(event_type)) > 0) AS padding,
  count(*) FILTER (WHERE event_type IS NOT NULL AND length(trim(event_type)) = 0) AS whitespace_only,
  count(*) FILTER (WHERE p.s > 0 AND abs(value - p.m) / p.s > 3) AS zscore_outlier,
  count(*) FILTER (WHERE q.q3 - q.q1 <> 0 AND (value < q.q1 - 1.5 * (q.q3 - q.q1) OR value > q.q3 + 1.5 * (q.q3 - q.q1)))
    AS iqr_outlier
FROM events, p, q""")


# ---------------------------------------------------------------- R (cell finders) and P (apply)
ADDR_WORDS = ("street", "ave", "blvd", "road", "st.", "nj", "mt", "dr.")
SEQ_PAT = "^([A-Za-z\\-_]*)([0-9]+)$"
ANOMS = "anoms AS (" + ORACLES["d00_all_anomalies"][len(DIRTY):] + ")"


def _has(c, t):
    return f"EXISTS (SELECT 1 FROM anoms WHERE column_name = '{c}' AND anomaly_type = '{t}')"


def _anom_field(c, t, field):
    return f"(SELECT {field} FROM anoms WHERE column_name = '{c}' AND anomaly_type = '{t}' LIMIT 1)"


def _fcond(c, t, x=None):
    """SQL condition: does the row's snapshot cell of column c belong to anomaly type t."""
    x = x or f"d.{c}"
    if t == "MISSING_VALUE":
        return f"{x} IS NULL"
    if t == "OUTLIER":
        if c in NUMERIC:
            st = f"(SELECT avg({c}) AS m, stddev_samp({c}) AS s, count({c}) AS n FROM dirty)"
            return (f"(SELECT st.n >= 4 AND st.s > 0 AND abs(CAST({x} AS DOUBLE) - st.m) / st.s > 3 FROM {st} st)")
        if c in DATES:
            return f"(year({x}) < 1900 OR year({x}) > 2030)"
        return "false"
    if t == "DUPLICATE":
        if c in DATES:
            return "false"
        key = _dup_key(c)
        base = _dup_key(c, f"regexp_replace(CAST({c} AS VARCHAR), '_DUP$', '')")
        reps = f"(SELECT k FROM (SELECT {key} AS k, count(*) AS n FROM dirty WHERE {c} IS NOT NULL GROUP BY 1) WHERE n > 1)"
        later = (f"(SELECT row_key FROM (SELECT row_key, row_number() OVER (PARTITION BY b ORDER BY row_key) AS rn "
                 f"FROM (SELECT row_key, {base} AS b FROM dirty WHERE {c} IS NOT NULL) WHERE b IN {reps}) WHERE rn > 1)")
        return f"d.row_key IN {later}"
    if t == "FORMAT_INVALID":
        if c in EMAIL_COLS:
            return f"({x} IS NOT NULL AND NOT regexp_full_match({x}, '{EMAIL_RE}'))"
        if c in PHONE_COLS:
            cl = f"regexp_replace({x}, '[\\s\\-()+.]', '', 'g')"
            return (f"({x} IS NOT NULL AND (NOT regexp_full_match({cl}, '[0-9]{{7,13}}') OR regexp_full_match({cl}, '0+') "
                    f"OR regexp_matches({_trim(x)}, '^\\(?00\\)?[\\s\\-]')))")
        return "false"
    if t == "INCONSISTENT":
        if c not in STRINGS:
            return "false"
        return (f"{x} IN (SELECT v FROM (SELECT {c} AS v, count(*) AS cnt FROM dirty WHERE {c} IS NOT NULL GROUP BY 1) "
                f"WHERE cnt < (SELECT greatest(2, CAST(floor(count({c}) * 0.01) AS BIGINT)) FROM dirty))")
    if t == "WHITESPACE_ONLY":
        return f"({x} IS NOT NULL AND length({_trim(x)}) = 0 AND length({x}) > 0)" if c in STRINGS else "false"
    if t == "CROSS_FIELD_SWAP":
        if c not in STRINGS:
            return "false"
        s = _trim(x)
        low = f"lower({s})"
        addr = "(" + " OR ".join(f"contains({low}, '{w}')" for w in ADDR_WORDS) + ")"
        email_like = f"regexp_matches({s}, '{EMAIL_RE}')"
        conds = []
        if c in NAME_COLS:
            conds += [email_like, f"regexp_matches({s}, '^[0-9]{{1,2}}[/\\-][0-9]{{1,2}}[/\\-][0-9]{{2,4}}$|"
                                  f"^[0-9]{{4}}[/\\-][0-9]{{1,2}}[/\\-][0-9]{{1,2}}$')"]
        if c in EMAIL_COLS:
            conds += [f"(regexp_matches({s}, '^\\+?[0-9\\s\\-()]{{7,20}}$') AND position('@' IN {s}) = 0)",
                      f"(NOT {email_like} AND {addr})"]
        if c in ADDR_COLS:
            conds += [email_like, f"regexp_matches({s}, '^[A-Z][0-9]{{4}}$')"]
        if c in PHONE_COLS:
            conds += [email_like, addr]
        if c in NAME_COLS:
            conds += [f"regexp_matches({s}, '^[A-Za-z\\s]+,\\s*[A-Z]{{2}}\\s+[0-9]{{5}}$')"]
        if c not in PHONE_COLS:
            conds += [f"(regexp_matches({s}, '^[+\\s\\-()]*[0-9][0-9\\s\\-.()]{{6,19}}$') "
                      f"AND length(regexp_replace({s}, '[^0-9]', '', 'g')) >= 7)"]
        return f"({x} IS NOT NULL AND ({' OR '.join(conds)}))"
    if t == "SUSPICIOUS_PLACEHOLDER":
        sx = _trim(f"CAST({x} AS VARCHAR)")
        return f"({x} IS NOT NULL AND (lower({sx}) IN ({PLACE}) OR {sx} IN ('0', '0.0')))"
    if t == "LEADING_TRAILING_WHITESPACE":
        return f"({x} IS NOT NULL AND {x} <> {_trim(x)} AND length({_trim(x)}) > 0)" if c in STRINGS else "false"
    if t == "DATE_LOGICAL":
        ends = [e for s_, e in DATE_PAIRS if s_ == c]
        if not ends:
            return "false"
        return f"({x} IS NOT NULL AND d.{ends[0]} IS NOT NULL AND {x} > d.{ends[0]})"
    if t == "NUMERIC_ROUND_NUMBER":
        if c not in NUMERIC:
            return "false"
        st = f"(SELECT count({c}) AS n, avg({c}) AS m FROM dirty)"
        return (f"(SELECT st.n >= 10 AND st.m <> 0 AND {x} IS NOT NULL AND CAST({x} AS DOUBLE) % "
                f"(CASE WHEN abs(st.m) >= 1000 THEN 1000.0 ELSE 100.0 END) = 0 FROM {st} st)")
    if t == "LOW_VARIANCE":
        if c in NUMERIC:
            return "false"
        dom = _anom_field(c, t, "original_value")
        return f"({x} IS NOT NULL AND {_trim(f'CAST({x} AS VARCHAR)')} = {_trim(dom)})"
    if t == "OUTLIER_IQR":
        if c not in NUMERIC:
            return "false"
        q1, q3 = _nearest(c, 0.25), _nearest(c, 0.75)
        return (f"((SELECT count({c}) FROM dirty) >= 4 AND {q3} - {q1} > 0 AND "
                f"(CAST({x} AS DOUBLE) < {q1} - 1.5 * ({q3} - {q1}) OR CAST({x} AS DOUBLE) > {q3} + 1.5 * ({q3} - {q1})))")
    if t == "SEQUENCE_GAP":
        if c not in STRINGS:
            return "false"
        prefix = f"split_part({_anom_field(c, t, 'original_value')}, '|', 1)"

        def num(v):
            return (f"(CASE WHEN regexp_full_match({v}, '{SEQ_PAT}') AND regexp_extract({v}, '{SEQ_PAT}', 1) = {prefix} "
                    f"AND length(regexp_extract({v}, '{SEQ_PAT}', 2)) <= 36 "
                    f"THEN CAST(regexp_extract({v}, '{SEQ_PAT}', 2) AS DECIMAL(38,0)) END)")
        nums = f"(SELECT {num(c)} AS x FROM dirty WHERE {num(c)} IS NOT NULL)"
        srt = f"(SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS k FROM {nums})"
        qv = lambda q: f"max(x) FILTER (WHERE i = least(k - 1, CAST(floor(k * {q}) AS BIGINT)))"
        fence = (f"(SELECT CASE WHEN q3 - q1 > 0 THEN q1 - 1.5 * (q3 - q1) ELSE p10 END AS lo, "
                 f"CASE WHEN q3 - q1 > 0 THEN q3 + 1.5 * (q3 - q1) ELSE p90 END AS hi FROM "
                 f"(SELECT {qv(0.25)} AS q1, {qv(0.75)} AS q3, {qv(0.10)} AS p10, {qv(0.90)} AS p90 FROM {srt}))")
        nx = num(x)
        return f"(SELECT {nx} IS NOT NULL AND ({nx} < f.lo OR {nx} > f.hi) FROM {fence} f)"
    return "false"


DATE_PAIRS = [("fecha_nacimiento", "fecha_alta")]
NUM_TYPES = {c: "DOUBLE" for c in ["saldo", "monto", "tasa"]} | {"row_key": "BIGINT", "puntaje": "INTEGER"}
MISSING_LITERAL_COLS = ["saldo"]
TYPES_ALL = ["MISSING_VALUE", "OUTLIER", "DUPLICATE", "FORMAT_INVALID", "INCONSISTENT", "WHITESPACE_ONLY",
             "CROSS_FIELD_SWAP", "SUSPICIOUS_PLACEHOLDER", "LEADING_TRAILING_WHITESPACE", "DATE_LOGICAL",
             "NUMERIC_ROUND_NUMBER", "LOW_VARIANCE", "OUTLIER_IQR", "SEQUENCE_GAP"]
ALL_COLS = NUMERIC + STRINGS + DATES


def _findings():
    parts = []
    for t in TYPES_ALL:
        for c in ALL_COLS:
            cond = _fcond(c, t)
            if cond == "false":
                continue
            parts.append(f"SELECT d.row_key, '{c}' AS column_name, '{t}' AS anomaly_type FROM dirty d "
                         f"WHERE {_has(c, t)} AND coalesce({cond}, false)")
    return DIRTY.rstrip("\n") + f", {ANOMS}\n" + "\nUNION ALL\n".join(parts)


oracle("r01_find_cells", _findings())


def _applied():
    """Final table after the fixture's review rule, decision by decision in type order."""
    dirty_types = NUM_TYPES
    stages = []       # (name, select list) chain of CTEs
    cur = {c: c for c in ALL_COLS}
    # MISSING_VALUE: saldo corrected with the literal "0"
    for mc in MISSING_LITERAL_COLS:
        cur[mc] = f"CASE WHEN {_has(mc, 'MISSING_VALUE')} AND {mc} IS NULL THEN 0.0 ELSE {mc} END"
    stages.append(dict(cur))
    cur = {c: f"s1.{c}" for c in ALL_COLS}
    # OUTLIER (numeric): corrected with the median of the current column
    for c in NUMERIC:
        med = f"(SELECT median({c}) FROM s1)"
        val = f"CAST(trunc({med}) AS {dirty_types[c]})" if dirty_types[c] in ("BIGINT", "INTEGER") else med
        cur[c] = f"CASE WHEN {_has(c, 'OUTLIER')} AND coalesce({_fcond(c, 'OUTLIER', 'd0.' + c)}, false) THEN {val} ELSE s1.{c} END"
    stages.append(dict(cur))
    out = {}
    for c in ALL_COLS:
        v = f"CAST(s2.{c} AS VARCHAR)"
        # DUPLICATE approved: later occurrences get the _DUP suffix
        dm = f"coalesce({_fcond(c, 'DUPLICATE', 'd0.' + c)}, false)" if c not in DATES else "false"
        v = (f"CASE WHEN {_has(c, 'DUPLICATE')} AND {dm} AND {v} IS NOT NULL AND NOT ends_with({v}, '_DUP') "
             f"THEN {v} || '_DUP' ELSE {v} END")
        # FORMAT_INVALID approved: the label
        fm = _fcond(c, "FORMAT_INVALID", "d0." + c)
        if fm != "false":
            v = (f"CASE WHEN {_has(c, 'FORMAT_INVALID')} AND coalesce({fm}, false) THEN "
                 f"{_anom_field(c, 'FORMAT_INVALID', 'suggested_value')} ELSE {v} END")
        wm = _fcond(c, "WHITESPACE_ONLY", "d0." + c)
        if wm != "false":
            v = f"CASE WHEN {_has(c, 'WHITESPACE_ONLY')} AND coalesce({wm}, false) THEN NULL ELSE {v} END"
        lm = _fcond(c, "LEADING_TRAILING_WHITESPACE", "d0." + c)
        if lm != "false":
            v = (f"CASE WHEN {_has(c, 'LEADING_TRAILING_WHITESPACE')} AND coalesce({lm}, false) THEN {_trim(v)} "
                 f"ELSE {v} END")
        # final strip, blank -> null
        v = f"CASE WHEN length({_trim(v)}) = 0 THEN NULL ELSE {_trim(v)} END"
        out[c] = v
    # date repair on every DATE_LOGICAL pair
    for sc, ec in DATE_PAIRS:
        out[ec] = (f"CASE WHEN {_has(sc, 'DATE_LOGICAL')} AND s2.{sc} IS NOT NULL "
                   f"AND s2.{ec} IS NOT NULL AND s2.{ec} < s2.{sc} "
                   f"THEN CAST(s2.{sc} + 6570 AS VARCHAR) ELSE CAST(s2.{ec} AS VARCHAR) END")
    s1 = ", ".join(f"{e} AS {c}" for c, e in stages[0].items())
    s2 = ", ".join(f"{e} AS {c}" for c, e in stages[1].items())
    final = ", ".join(f"{e} AS {c}" for c, e in out.items())
    return (DIRTY.rstrip("\n") + f", {ANOMS},\n"
            f"s1 AS (SELECT {s1} FROM dirty),\n"
            f"s2 AS (SELECT {s2} FROM s1 JOIN dirty d0 USING (row_key))\n"
            f"SELECT {final} FROM s2 JOIN dirty d0 USING (row_key) JOIN dirty d USING (row_key)")


oracle("p01_apply_decisions", _applied())


# ---------------------------------------------------------------- detectors on a driver table as it is
def _detectors_for(spec: dict) -> str:
    """The same detector oracles over another table: rebinding the column classes."""
    g = globals()
    saved = {k: g[k] for k in spec}
    g.update(spec)
    try:
        builders = [_missing, _zscore, _duplicates, _formats, _inconsistent, lambda: _text("WHITESPACE_ONLY"),
                    _swaps, lambda: _text("SUSPICIOUS_PLACEHOLDER"), lambda: _text("LEADING_TRAILING_WHITESPACE"),
                    _round_numbers, _low_variance, _iqr, _sequences]
        bodies = []
        for b in builders:
            sql = b()
            body = sql[len(g["DIRTY"]):]
            if body.strip():
                bodies.append(f"SELECT * FROM ({body})")
        return g["DIRTY"] + "\nUNION ALL\n".join(bodies)
    finally:
        g.update(saved)


ORDERS_SPEC = {
    "DIRTY": "WITH dirty AS (SELECT o_orderkey AS row_key, * FROM orders)\n",
    "NUMERIC": ["o_orderkey", "o_custkey", "o_totalprice"], "STRINGS": ["o_orderstatus", "o_orderpriority"],
    "DATES": ["o_orderdate"], "EMAIL_COLS": [], "PHONE_COLS": [], "NAME_COLS": [], "ADDR_COLS": [],
    "ID_LIKE": ["o_orderkey", "o_custkey"],
}
oracle("d19_detect_orders", _detectors_for(ORDERS_SPEC))
# S3: matched pairs, plus anomalies without a decision whose window ended before the
# final watermark (the smaller of the two streams' max event time, minus 10 minutes).
oracle("s03_review_gate", """WITH a AS (SELECT user_id AS k, ts, event_id AS id FROM events WHERE event_type = 'error'),
d AS (SELECT user_id AS k, ts, event_id AS id FROM events WHERE event_type = 'purchase'),
wm AS (SELECT least((SELECT max(ts) FROM a), (SELECT max(ts) FROM d)) - INTERVAL 10 MINUTE AS w),
m AS (SELECT a.id AS a_id, a.k AS a_key, a.ts AS a_ts, d.id AS d_id, d.ts AS d_ts FROM a JOIN d
      ON a.k = d.k AND d.ts >= a.ts AND d.ts <= a.ts + INTERVAL 1800 SECOND)
SELECT a_id, a_key, a_ts, d_id, d_ts, false AS timed_out FROM m
UNION ALL
SELECT a.id, a.k, a.ts, NULL, NULL, true FROM a
WHERE a.id NOT IN (SELECT a_id FROM m) AND a.ts + INTERVAL 1800 SECOND < (SELECT w FROM wm)""")
oracle("s05_stream_dedup", """WITH g AS (SELECT *, ts - lag(ts) OVER w <= INTERVAL 6 HOUR AS follows FROM events WHERE ts IS NOT NULL
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
r AS (SELECT *, count(*) FILTER (WHERE follows IS NOT TRUE) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM g)
SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS n_rows
FROM r GROUP BY user_id, event_type, run
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)""")
SLICED = """e AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi FROM events),
sl AS (SELECT *, CASE WHEN us IS NULL OR us <= lo + (hi - lo) * 1 // 4 THEN 0 WHEN us <= lo + (hi - lo) * 2 // 4 THEN 1
  WHEN us <= lo + (hi - lo) * 3 // 4 THEN 2 ELSE 3 END AS slice FROM e)"""
oracle("s05_late_rows", f"""WITH {SLICED},
a AS (SELECT *, CASE WHEN event_id % 10 = 0 AND slice < 3 THEN slice + 1 ELSE slice END AS arrived FROM sl),
m AS (SELECT arrived, max(ts) AS top FROM a GROUP BY 1)
SELECT CAST(a.arrived AS BIGINT) AS arrived, event_type, count(*) AS n_rows,
  count(*) FILTER (WHERE ts < (SELECT max(top) FROM m WHERE m.arrived < a.arrived) - INTERVAL 1 HOUR) AS n_late
FROM a GROUP BY 1, 2""")


def _fences(rows: str, version: int) -> str:
    """Mean, deviation and nearest-rank fences of the values of ``rows``."""
    rank = "(SELECT CAST(floor((count(value) - 1) * {} + 0.5) AS BIGINT) + 1 FROM " + rows + ")"
    return f"""(SELECT {version} AS version, (SELECT avg(value) FROM {rows}) AS m, (SELECT stddev_samp(value) FROM {rows}) AS s,
  max(v) FILTER (WHERE rn = {rank.format(0.25)}) AS q1, max(v) FILTER (WHERE rn = {rank.format(0.75)}) AS q3
  FROM (SELECT value AS v, row_number() OVER (ORDER BY value) AS rn FROM {rows} WHERE value IS NOT NULL))"""


oracle("s04_profile_join", f"""WITH {SLICED}, half AS (SELECT * FROM sl WHERE slice < 2 AND us IS NOT NULL),
p AS ({_fences("half", 1)} UNION ALL {_fences("sl", 2)})
SELECT event_id, coalesce(s > 0 AND abs(value - m) / s > 3, FALSE) AS zscore_outlier,
  coalesce(q3 <> q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), FALSE) AS iqr_outlier,
  CAST(p.version AS BIGINT) AS version
FROM sl JOIN p ON p.version = CASE WHEN slice < 2 THEN 1 ELSE 2 END""")
oracle("s05_stream_dedup_hourly", """
SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS bucket FROM events""")
NO_KW = {"EMAIL_COLS": [], "PHONE_COLS": [], "NAME_COLS": [], "ADDR_COLS": []}
oracle("d20_detect_customer", _detectors_for({
    **NO_KW, "DIRTY": "WITH dirty AS (SELECT c_custkey AS row_key, * FROM customer)\n",
    "NUMERIC": ["c_custkey", "c_nationkey", "c_acctbal"], "STRINGS": ["c_name", "c_mktsegment"], "DATES": [],
    "NAME_COLS": ["c_name"], "ID_LIKE": ["c_custkey", "c_nationkey"]}))
oracle("d21_detect_events", _detectors_for({
    **NO_KW, "DIRTY": "WITH dirty AS (SELECT event_id AS row_key, * FROM events)\n",
    "NUMERIC": ["event_id", "user_id", "value"], "STRINGS": ["event_type", "props"], "DATES": ["ts"],
    "ID_LIKE": ["event_id", "user_id"]}))
oracle("d22_detect_part", _detectors_for({
    **NO_KW, "DIRTY": "WITH dirty AS (SELECT p_partkey AS row_key, * FROM part)\n",
    "NUMERIC": ["p_partkey", "p_size", "p_retailprice"], "STRINGS": ["p_name", "p_brand", "p_type"], "DATES": [],
    "NAME_COLS": ["p_name"], "ID_LIKE": ["p_partkey"]}))
from cellwright.plans.fixtures import DIRTY_LINEITEM_SQL  # noqa: E402

oracle("d23_detect_dirty_lineitem", _detectors_for({
    **NO_KW, "DIRTY": f"WITH dirty AS ({DIRTY_LINEITEM_SQL})\n",
    "NUMERIC": ["row_key", "cantidad", "precio", "descuento"], "STRINGS": ["estado", "email"],
    "DATES": ["fecha_envio"], "EMAIL_COLS": ["email"], "ID_LIKE": ["row_key"]}))


def _cycle_for(spec: dict, detect_sql: str, builder):
    """Finder / apply oracles over another dirty table: rebinding the column classes."""
    g = globals()
    spec = dict(spec)
    spec["ALL_COLS"] = spec["NUMERIC"] + spec["STRINGS"] + spec["DATES"]
    spec["ANOMS"] = "anoms AS (" + detect_sql[len(spec["DIRTY"]):] + ")"
    saved = {k: g[k] for k in spec}
    g.update(spec)
    try:
        return builder()
    finally:
        g.update(saved)


LINEITEM_SPEC = {
    **NO_KW, "DIRTY": f"WITH dirty AS ({DIRTY_LINEITEM_SQL})\n",
    "NUMERIC": ["row_key", "cantidad", "precio", "descuento"], "STRINGS": ["estado", "email"],
    "DATES": ["fecha_envio"], "EMAIL_COLS": ["email"], "ID_LIKE": ["row_key"], "DATE_PAIRS": [],
    "NUM_TYPES": {"row_key": "BIGINT", "cantidad": "DOUBLE", "precio": "DOUBLE", "descuento": "DOUBLE"},
    "MISSING_LITERAL_COLS": [],
}
oracle("r02_find_cells_dirty_lineitem", _cycle_for(LINEITEM_SPEC, ORACLES["d23_detect_dirty_lineitem"], _findings))
oracle("p02_apply_decisions_dirty_lineitem",
       _cycle_for(LINEITEM_SPEC, ORACLES["d23_detect_dirty_lineitem"], _applied))
oracle("d24_detect_documents", _detectors_for({
    **NO_KW, "DIRTY": "WITH dirty AS (SELECT doc_id AS row_key, * FROM documents)\n",
    "NUMERIC": ["doc_id", "n_chars"], "STRINGS": ["text", "lang", "source"], "DATES": [], "ID_LIKE": ["doc_id"]}))
oracle("d25_detect_labels", _detectors_for({
    **NO_KW, "DIRTY": "WITH dirty AS (SELECT doc_id AS row_key, * FROM labels)\n",
    "NUMERIC": ["doc_id", "quality", "toxic"], "STRINGS": [], "DATES": [], "ID_LIKE": ["doc_id"]}))
oracle("d26_detect_conversations", _detectors_for({
    **NO_KW, "DIRTY": "WITH dirty AS (SELECT conv_id * 1000000 + turn AS row_key, * FROM conversations)\n",
    "NUMERIC": ["conv_id", "turn"], "STRINGS": ["role", "text"], "DATES": [], "ID_LIKE": ["conv_id"]}))
oracle("d27_detect_pages", _detectors_for({
    **NO_KW, "DIRTY": "WITH dirty AS (SELECT page_id AS row_key, * FROM pages)\n",
    "NUMERIC": ["page_id"], "STRINGS": ["url", "html"], "DATES": [], "ID_LIKE": ["page_id"]}))
oracle("d28_detect_benchmark", _detectors_for({
    **NO_KW, "DIRTY": "WITH dirty AS (SELECT item_id AS row_key, * FROM benchmark)\n",
    "NUMERIC": ["item_id"], "STRINGS": ["text"], "DATES": [], "ID_LIKE": ["item_id"]}))

from cellwright.plans.fixtures import FAULTY_SQL  # noqa: E402

for _key, _name, _spec in (
        ("d29_faulty_part", "part", {
            "NUMERIC": ["row_key", "p_size", "p_retailprice"], "STRINGS": ["p_name", "p_brand", "p_type"],
            "NAME_COLS": ["p_name"], "ID_LIKE": ["row_key"]}),
        ("d30_faulty_conversations", "conversations", {
            "NUMERIC": ["row_key", "conv_id", "turn"], "STRINGS": ["role", "text"], "ID_LIKE": ["row_key", "conv_id"]}),
        ("d31_faulty_pages", "pages", {"NUMERIC": ["row_key"], "STRINGS": ["url", "html"], "ID_LIKE": ["row_key"]}),
        ("d32_faulty_benchmark", "benchmark", {
            "NUMERIC": ["row_key"], "STRINGS": ["text", "item_ref"], "ID_LIKE": ["row_key"]})):
    oracle(_key, _detectors_for({**NO_KW, "DIRTY": f"WITH dirty AS ({FAULTY_SQL[_name]})\n", "DATES": [], **_spec}))

oracle("d03_decimal_keys", """
WITH k AS (SELECT o_orderkey - CASE WHEN o_orderkey % 500 = 7 THEN 1 ELSE 0 END + 1000000000000000000 AS id FROM orders),
c AS (SELECT id, count(*) AS cnt FROM k GROUP BY id),
s AS (SELECT CAST(sum(cnt - 1) AS BIGINT) AS extra, CAST(arg_min(id, (-cnt, id)) AS VARCHAR) AS ex FROM c HAVING count(*) / sum(cnt) >= 0.8 AND max(cnt) > 1)
SELECT column_name, 'DUPLICATE' AS anomaly_type, extra AS affected, ex AS original_value, 'DUPLICADO' AS suggested_value,
       CAST(NULL AS DOUBLE) AS suggested_num, CAST(NULL AS VARCHAR) AS related_column
FROM s, (VALUES ('decimal_id'), ('long_id')) t(column_name)""")

oracle("b29_metrics", DIRTY + """, c AS (SELECT * FROM dirty WHERE email IS NOT NULL),
r AS (SELECT puntaje, row_number() OVER (ORDER BY puntaje) AS rn, count(*) OVER () AS n FROM c WHERE puntaje IS NOT NULL),
q AS (SELECT max(puntaje) FILTER (WHERE rn = CAST(floor((n - 1) * 0.25 + 0.5) AS BIGINT) + 1) AS q1,
        max(puntaje) FILTER (WHERE rn = CAST(floor((n - 1) * 0.75 + 0.5) AS BIGINT) + 1) AS q3 FROM r),
o AS (SELECT count(*) FILTER (WHERE puntaje < q1 - 1.5 * (q3 - q1) OR puntaje > q3 + 1.5 * (q3 - q1)) AS n FROM c, q)
SELECT 0::BIGINT AS step, 'CLEAN_NULLS' AS type, count(*) AS rows_before, count(email) AS rows_after,
       count(*) - count(email) AS nulls_before, NULL::BIGINT AS nulls_after, NULL::BIGINT AS outliers FROM dirty
UNION ALL SELECT 1, 'FILL_NULLS', count(*), count(*), count(*) - count(saldo), 0, NULL FROM c
UNION ALL SELECT 2, 'DETECT_OUTLIERS', count(*), count(*) - (SELECT n FROM o), NULL, NULL, (SELECT n FROM o) FROM c""")
