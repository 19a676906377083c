"""Derived inputs built from the driver tables with SQL that runs unchanged in Spark and DuckDB.

The driver tables are clean; the dirty view plants every anomaly type into
``customer`` so detectors, finders and corrections have something to find.  Its
size grows with ``customer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DIRTY_SQL = """
SELECT
  c_custkey AS row_key,
  CASE WHEN c_custkey % 97 = 5 THEN concat('C', cast(c_custkey + 900000 AS string))
       ELSE concat('C', lpad(cast(c_custkey + 1 AS string), 6, '0')) END AS client_code,
  CASE WHEN c_custkey % 53 = 3 THEN concat('user', cast(c_custkey AS string), '@shop.co')
       WHEN c_custkey % 41 = 7 THEN concat('  ', c_name, ' ')
       WHEN c_custkey % 67 = 1 THEN '   '
       ELSE c_name END AS nombre,
  CASE WHEN c_custkey % 29 = 2 THEN NULL
       WHEN c_custkey % 37 = 4 THEN 'not-an-email'
       WHEN c_custkey % 31 = 6 THEN concat('USER', cast(c_custkey - 1 AS string), '@shop.co')
       ELSE concat('user', cast(c_custkey AS string), '@shop.co') END AS email,
  CASE WHEN c_custkey % 43 = 8 THEN NULL
       WHEN c_custkey % 47 = 9 THEN '000-0000'
       WHEN c_custkey % 59 = 10 THEN '12345'
       ELSE concat('300-', lpad(cast(c_custkey AS string), 7, '0')) END AS telefono,
  CASE WHEN c_custkey % 61 = 11 THEN 'N/A'
       WHEN c_custkey % 71 = 12 THEN 'a@b.co'
       ELSE concat('Calle ', cast(c_nationkey AS string), ' # ', cast(c_custkey AS string)) END AS direccion,
  CASE WHEN c_custkey % 149 = 13 THEN 'FURNITUR' ELSE c_mktsegment END AS segmento,
  CASE WHEN c_custkey % 73 = 14 THEN NULL
       WHEN c_custkey % 113 = 15 THEN cast(999999 AS double)
       ELSE c_acctbal END AS saldo,
  CASE WHEN c_custkey % 2 = 0 THEN cast((c_custkey % 9) * 1000 AS double) ELSE c_acctbal END AS monto,
  cast(500 + (c_custkey % 2) AS double) AS tasa,
  CASE WHEN c_custkey % 50 = 16 THEN 'EU' ELSE 'CO' END AS pais,
  CASE WHEN c_custkey % 79 = 17 THEN DATE '1850-06-01'
       ELSE DATE '1980-01-01' + cast(c_custkey % 3650 AS int) END AS fecha_nacimiento,
  CASE WHEN c_custkey % 83 = 18 THEN DATE '1970-01-01'
       ELSE DATE '2015-01-01' + cast(c_custkey % 1000 AS int) END AS fecha_alta,
  CASE WHEN c_custkey % 10 = 3 THEN 30 ELSE 10 + cast(c_custkey % 5 AS int) END AS puntaje,
  CASE WHEN c_custkey % 100 = 50 THEN NULL ELSE concat('P-', cast(c_custkey AS string)) END AS pedido,
  CASE WHEN c_custkey % 5 = 0 THEN '300-123-4567' ELSE concat('ok ', cast(c_custkey AS string)) END AS nota,
  CASE WHEN c_custkey % 3 = 0 THEN '15/01/2024' ELSE '03/02/2024' END AS fecha_texto
FROM customer
"""

DIRTY_ORDER = "row_key"


def _view_name(name: str) -> str:
    """A private temp-view name per call, so concurrent callers never see each other's view."""
    import uuid
    return f"cw_{name}_{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty customer view (FIXTURES §3), as a DataFrame over ``customer``."""
    view = _view_name("customer")
    table(spark, sf_dir, "customer").createOrReplaceTempView(view)
    # the view is bound at analysis time, so later re-registrations do not affect this frame
    out = spark.sql(DIRTY_SQL.replace("FROM customer", f"FROM {view}"))
    spark.catalog.dropTempView(view)  # the frame keeps its analysed plan
    return out


# ---------------------------------------------------------------- review metadata
# Datasets, anomaly records and decisions derived from the order tables so that the
# review analytics run over data that grows with the scale factor.
REVIEW_TYPES = ("MISSING_VALUE", "OUTLIER", "DUPLICATE", "FORMAT_INVALID", "INCONSISTENT",
                "WHITESPACE_ONLY", "CROSS_FIELD_SWAP", "SUSPICIOUS_PLACEHOLDER",
                "LEADING_TRAILING_WHITESPACE", "DATE_LOGICAL", "NUMERIC_ROUND_NUMBER",
                "LOW_VARIANCE", "OUTLIER_IQR", "SEQUENCE_GAP")


def _type_case(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {i} THEN '{t}'" for i, t in enumerate(REVIEW_TYPES)) + " END"


DATASET_STATUS_SQL = ("CASE WHEN o_orderstatus = 'F' THEN 'READY' WHEN o_orderstatus = 'P' THEN 'ERROR' "
                      "WHEN o_orderpriority = '5-LOW' THEN 'PENDING' ELSE 'PROCESSING' END")
# a numeric key that is unique per line item (the order / part / supplier / line tuple)
LINE_ID = "((l_orderkey * 20011 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber"
ANOMALY_SQL_BODY = (f"{LINE_ID} AS anomaly_id, "
                    f"l_orderkey AS dataset_id, 'col_' || CAST(l_suppkey % 7 AS STRING) AS column_name, "
                    f"{_type_case('l_partkey % 14')} AS anomaly_type, CAST(l_quantity AS BIGINT) AS affected, "
                    f"CASE WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'RESOLVED' END AS status, "
                    f"l_shipdate AS created_at")
DECISION_SQL_BODY = (f"{LINE_ID} AS anomaly_id, "
                     "CASE l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN 'CORRECTED' ELSE 'DISCARDED' END "
                     "AS action, l_shipdate AS created_at")


def review_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` read as datasets: owner o_custkey, created o_orderdate, status from o_orderstatus."""
    from pyspark.sql import functions as F
    o = table(spark, sf_dir, "orders")
    processed = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 != 0),
                       F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 48).cast("int")))
    return o.select(F.col("o_orderkey").alias("dataset_id"), F.col("o_custkey").alias("user_id"),
                    F.concat(F.lit("dataset-"), F.col("o_orderkey").cast("string")).alias("name"),
                    F.expr(DATASET_STATUS_SQL).alias("status"), F.col("o_orderdate").alias("created_at"),
                    processed.alias("processed_at"))


def _select(spark: SparkSession, sf_dir: str, name: str, body: str, where: str = "") -> DataFrame:
    """Run a select list over one driver table (the view is bound when the frame is built)."""
    view = _view_name(name)
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    out = spark.sql(f"SELECT {body} FROM {view} {where}")
    spark.catalog.dropTempView(view)  # the frame keeps its analysed plan
    return out


def review_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One anomaly record per lineitem; open lines are still PENDING."""
    return _select(spark, sf_dir, "lineitem", ANOMALY_SQL_BODY)


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every finished line; the return flag picks the action."""
    return _select(spark, sf_dir, "lineitem", DECISION_SQL_BODY, "WHERE l_linestatus = 'F'")


SUGGESTION_SQL_BODY = (
    "event_id AS anomaly_id, CASE event_id % 3 "
    "WHEN 0 THEN '{\"actionType\": \"FILL\", \"value\": \"' || CAST(round(value, 2) AS STRING) || "
    "'\", \"reason\": \"usar ' || event_type || '\"}' "
    "WHEN 1 THEN 'Revisar el valor ' || event_type || ' del usuario ' || CAST(user_id AS STRING) || ' ' || props "
    "ELSE props END AS suggestion")


def review_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestion texts built per event row: a third valid JSON, a third free text, a third other JSON."""
    return _select(spark, sf_dir, "events", SUGGESTION_SQL_BODY)


# A larger dirty table planted into ``lineitem`` (a row per line item), for the
# detect -> find -> apply cycle at the size of the biggest driver table.
DIRTY_LINEITEM_SQL = """
SELECT
  ((l_orderkey * 20011 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber AS row_key,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS cantidad,
  CASE WHEN l_partkey % 997 = 1 THEN l_extendedprice * 1000 ELSE l_extendedprice END AS precio,
  l_discount AS descuento,
  CASE WHEN l_suppkey % 101 = 3 THEN '  ' || l_returnflag || ' '
       WHEN l_suppkey % 103 = 5 THEN 'N/A' ELSE l_returnflag END AS estado,
  CASE WHEN l_orderkey % 89 = 1 THEN 'cliente' || CAST(l_orderkey AS STRING) || '@'
       ELSE 'cliente' || CAST(l_orderkey AS STRING) || '@shop.co' END AS email,
  l_shipdate AS fecha_envio
FROM lineitem
"""


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view_name("lineitem")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView(view)
    out = spark.sql(DIRTY_LINEITEM_SQL.replace("FROM lineitem", f"FROM {view}"))
    spark.catalog.dropTempView(view)  # the frame keeps its analysed plan
    return out


# Tables with faults planted by position, as rows of the driver tables would have them.
FAULTY_SQL = {
    "part": """
SELECT p_partkey AS row_key,
  CASE WHEN p_partkey % 401 = 3 THEN 'a' || CAST(p_partkey AS STRING) || '@shop.co'
       WHEN p_partkey % 307 = 4 THEN ' ' || p_name || ' ' ELSE p_name END AS p_name,
  CASE WHEN p_partkey % 500 = 9 THEN 'Brand#X' ELSE 'Brand#' || CAST(p_size % 3 AS STRING) END AS p_brand,
  CASE WHEN p_partkey % 211 = 5 THEN NULL ELSE p_type END AS p_type,
  CASE WHEN p_partkey % 150 = 7 THEN 5000 ELSE p_size END AS p_size,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(1000 * (p_partkey % 7) AS DOUBLE) ELSE p_retailprice END AS p_retailprice
FROM part""",
    "conversations": """
SELECT conv_id * 1000000 + turn AS row_key, conv_id, turn,
  CASE WHEN conv_id % 90 = 2 AND turn = 0 THEN 'usr' ELSE role END AS role,
  CASE WHEN conv_id % 7 = 1 AND turn = 1 THEN '  ' WHEN conv_id % 11 = 2 AND turn = 0 THEN 'n/a' ELSE text END AS text
FROM conversations""",
    "pages": """
SELECT page_id AS row_key,
  CASE WHEN page_id % 50 = 1 THEN NULL WHEN page_id % 60 = 2 THEN 'http://repeated.example/' ELSE url || '#' || CAST(page_id AS STRING) END AS url,
  CASE WHEN page_id % 40 = 3 THEN ' ' || html ELSE html END AS html
FROM pages""",
    "benchmark": """
SELECT item_id AS row_key,
  CASE WHEN item_id % 10 = 4 THEN 'todo' WHEN item_id % 9 = 2 THEN '' ELSE text END AS text,
  'B-' || CAST(CASE WHEN item_id % 13 = 6 THEN item_id + 100000 ELSE item_id END AS STRING) AS item_ref
FROM benchmark""",
}


def faulty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with the faults of FAULTY_SQL."""
    view = _view_name(name)
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    out = spark.sql(FAULTY_SQL[name].replace(f"FROM {name}", f"FROM {view}"))
    spark.catalog.dropTempView(view)  # the frame keeps its analysed plan
    return out


def decimal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys beyond the exact range of a double, as DECIMAL(20,0) and BIGINT; every 500th
    row repeats its neighbour's."""
    o = table(spark, sf_dir, "orders")
    return o.selectExpr("o_orderkey AS row_key", *[
        f"CAST(o_orderkey - CASE WHEN o_orderkey % 500 = 7 THEN 1 ELSE 0 END + 1000000000000000000 AS {t}) AS {n}"
        for t, n in (("DECIMAL(20,0)", "decimal_id"), ("BIGINT", "long_id"))])
