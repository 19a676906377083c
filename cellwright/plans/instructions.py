"""Instruction text -> correction (N1-N12), as a column job over a table of instructions.

The reference classifies one instruction at a time with an ordered rule list; here
a whole column of instructions is classified by a first-match ``CASE`` chain of
native regular expressions, so it runs inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ustrip

# FIXED VALUES: rule patterns in the order they are tried (Java syntax; (?iu) is a
# Unicode case-insensitive match, as the reference's /i patterns).
RE_CONDITIONAL = r"(?iu)\b(si|cuando|mayor|menor|igual|entre|mientras)\b"
RE_NULL = r"(?iu)^\s*null\s*$"
RE_NUMBER = r"^\s*(-?\d+(\.\d+)?)\s*$"
RE_QUOTED = r"^\"(.+)\"$|^'(.+)'$"
RE_MEDIAN = r"(?iu)(usa|con|pon).+(mediana)"
RE_MEAN = r"(?iu)(usa|con|pon).+(media|promedio)"
RE_MODE = r"(?iu)(usa|con|pon).+(moda)"
RE_MIN = r"(?iu)(usa|con|pon).+(m[íi]nimo)"
RE_MAX = r"(?iu)(usa|con|pon).+(m[áa]ximo)"
RE_DELETE = r"(?iu)(elimina|borra|quita).+(fila|registro)"
RE_KEEP = r"(?iu)(mantener|dejar|deja|conserva)"
RE_COPY = r"(?iu)(copia|toma).+(de|del)\s+['\"]?(\w+)"

RESULT_COLUMNS = ["op", "value_text", "value_num", "agg", "source_column", "source"]


def parse_instructions(df: DataFrame, text_col: str, column_names: list[str] | None = None) -> DataFrame:
    """Add the parsed correction as columns op, value_text, value_num, agg, source_column,
    source ('rule' or 'unresolved') and ``ir`` (the IR tree as JSON)."""
    names = list(column_names or [])
    # Pass 1: the trimmed text and the index of the first matching rule (-1 for a
    # conditional instruction, null when no rule applies); each pattern runs once.
    t0 = ustrip(F.col(text_col))
    patterns = [RE_NULL, RE_NUMBER, RE_QUOTED, RE_MEDIAN, RE_MEAN, RE_MODE, RE_MIN, RE_MAX, RE_DELETE, RE_KEEP,
                RE_COPY]
    idx = F.when(t0.rlike(RE_CONDITIONAL), F.lit(-1))
    for i, pat in enumerate(patterns):
        idx = idx.when(t0.rlike(pat), F.lit(i))
    tagged = df.select("*", t0.alias("__t"), idx.alias("__rule"))
    # Pass 2: fields by rule index (extractions run only for the rule that matched).
    t, rule = F.col("__t"), F.col("__rule")
    copy_src = F.regexp_extract(t, RE_COPY, 3)
    copy_ok = copy_src.isin(*names) if names else F.lit(True)
    quoted = F.coalesce(F.nullif(F.regexp_extract(t, RE_QUOTED, 1), F.lit("")), F.regexp_extract(t, RE_QUOTED, 2))
    ops = ["FILL_LITERAL", "FILL_LITERAL", "FILL_LITERAL", "FILL_AGGREGATE", "FILL_AGGREGATE", "FILL_AGGREGATE",
           "FILL_AGGREGATE", "FILL_AGGREGATE", "DELETE_ROWS", "KEEP", "FILL_FROM_COLUMN"]
    aggs = {3: "median", 4: "mean", 5: "mode", 6: "min", 7: "max"}
    op = F.lit(None)
    for i, name in enumerate(ops):
        v = F.when(copy_ok, F.lit(name)) if name == "FILL_FROM_COLUMN" else F.lit(name)
        op = F.when(rule == i, v) if i == 0 else op.when(rule == i, v)
    agg = F.lit(None)
    for j, (i, a) in enumerate(aggs.items()):
        agg = F.when(rule == i, F.lit(a)) if j == 0 else agg.when(rule == i, F.lit(a))
    out = tagged.select(
        *[F.col(f"`{c}`") for c in df.columns],
        op.alias("op"),
        F.when(rule == 2, quoted).cast("string").alias("value_text"),
        F.when(rule == 1, F.regexp_extract(t, RE_NUMBER, 1).cast("double")).alias("value_num"),
        agg.cast("string").alias("agg"),
        F.when((rule == 10) & copy_ok, copy_src).cast("string").alias("source_column"),
        F.when(op.isNotNull(), F.lit("rule")).otherwise(F.lit("unresolved")).alias("source"),
    )
    lit_ir = (F.when(F.col("value_num").isNotNull(),
                     F.to_json(F.struct(F.col("op"), F.col("value_num").alias("value"))))
              .when(F.col("value_text").isNotNull(), F.to_json(F.struct(F.col("op"), F.col("value_text").alias("value"))))
              .otherwise(F.lit('{"op":"FILL_LITERAL","value":null}')))
    ir = (F.when(F.col("op") == "FILL_LITERAL", lit_ir)
          .when(F.col("op") == "FILL_AGGREGATE", F.to_json(F.struct(F.col("op"), F.col("agg"))))
          .when(F.col("op") == "FILL_FROM_COLUMN",
                F.to_json(F.struct(F.col("op"), F.col("source_column").alias("sourceColumn"))))
          .when(F.col("op").isNotNull(), F.to_json(F.struct(F.col("op")))))
    return out.withColumn("ir", ir)
