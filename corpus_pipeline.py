"""Corpus pipeline: quality rules, near-duplicate join, benchmark decontamination, PII
surrogates, byte-level BPE.  Every stage is one operator of ``cellwright.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``.  Null texts, repeated
rows, empty tables and extra columns follow the operators' docstrings; all stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.bpe import decode_documents, encode_documents
from cellwright.llm.common import materialise, pick, table, text_key
from cellwright.llm.decontam import contaminated_documents
from cellwright.llm.graph import Bloom
from cellwright.llm.jaccard import near_duplicates
from cellwright.llm.pii import replace_pii, session_key
from cellwright.llm.quality import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(pick(docs, *COLUMNS), keep=COLUMNS, lang="lang").where("kept").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one
    with the smallest doc_id, of equal ones a single row.  Documents without words stay."""
    docs = pick(docs, *COLUMNS).withColumn("__k", text_key("text"))
    groups = materialise(near_duplicates(docs.select("doc_id", "text"), k=5, percent=80), "pipeline-groups")
    stays = F.expr("n_shingles = 0 OR (doc_id <=> component_id AND key = component_key)")
    first = groups.where(stays).select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct()
    # Only what may go, or may stand there twice, meets the list of first documents in a join.
    twice = groups.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    hit = Bloom(groups.where(~stays).select("key").unionByName(twice), "key")
    sure = docs.where(~hit.column("__k"))
    checked = (docs.where(hit.column("__k"))
               .join(first, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__k") == F.col("k")), "left_semi")
               .dropDuplicates(["doc_id", "__k"]))
    return sure.unionByName(checked).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no benchmark item is covered by tiles to four fifths."""
    docs = pick(docs, *COLUMNS).withColumn("__k", text_key("text"))
    bad = materialise(contaminated_documents(docs.select("doc_id", "text"), pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))
                      .select(F.col("doc_id").alias("d"), F.col("key").alias("k")), "pipeline-contaminated")
    hit = Bloom(bad, "k")
    checked = docs.where(hit.column("__k")).join(
        bad, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__k") == F.col("k")), "left_anti")
    return docs.where(~hit.column("__k")).unionByName(checked).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, n_chars recounted."""
    out = replace_pii(pick(docs, *COLUMNS), session_key(spark)).drop("pii")
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
                          .otherwise(F.col("n_chars"))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids and their number, and the digest of the decoded bytes.  The ids are
    written before they are decoded: in one task, encoding and decoding take a Python worker
    each, and both stay with the executor, with their memory, for all steps that follow."""
    keep = ("doc_id", "lang", "source")
    ids = materialise(encode_documents(pick(docs, *COLUMNS), keep=keep), "pipeline-ids")
    out = decode_documents(ids, keep=(*keep, "ids"))
    return out.select(*keep, F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontamination),
          ("pii", pii), ("byte_bpe", byte_bpe)]

#: Near-duplicate groups, string tiling, keyed surrogates and byte-pair merges have no SQL form;
#: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and
    read back, so a lost executor never reruns more than one stage."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
