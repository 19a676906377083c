"""Benchmark decontamination by greedy string tiling.

1. Seeds: hashes of every run of ``seed`` words (an item with fewer words: the whole item).
   A Bloom filter of the benchmark's seeds, of a bounded number of bits, goes to all tasks;
   each document emits only the seeds that pass it.
2. Seeds meet in a shuffle join on the hash, which gives the (document, item) candidates.
3. Every candidate is tiled: Karp-Rabin hashes of ``seed`` words find the common runs, the
   longest run not yet marked is marked in both, again and again until none of ``seed`` words
   is left.  Tiles may come in any order, so reordered passages are caught.
4. A document is contaminated by an item if the tiles cover at least ``threshold`` of the
   item's words.

Hot passages: the seeds of a passage in a third of all documents are a hot join key on the
document side; the join is an ordinary one whose skewed partitions adaptive execution splits,
and what it emits is at most one row per (document, item) and partition.

Defined results: null texts are empty; an item without words contaminates nothing; repeated
documents are judged one by one, repeated items (same item_id and text) count once, rows of
one item_id with different texts are tiled one by one; empty tables give clean documents or no
rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise, pick, prepare, table, text_key
from .graph import Bloom
from .shingles import blocks, sequence_hash, shingle_at, word_hashes

SEED, THRESHOLD = 5, 0.8

def seeds_of(words: np.ndarray, seed: int) -> np.ndarray:
    if len(words) >= seed:
        return np.unique(shingle_at(words, seed))
    return np.array([sequence_hash(words)] if len(words) else [], dtype=np.uint64)


def tile(doc: np.ndarray, item: np.ndarray, seed: int) -> int:
    """Words of the item that greedy string tiling covers."""
    seed = min(seed, len(item))
    if not seed or len(doc) < seed:
        return 0
    rolled, wanted = (shingle_at(x, seed) for x in (doc, item))
    order = np.argsort(wanted, kind="stable")
    ranked = wanted[order]
    hits = np.flatnonzero(np.isin(rolled, ranked))
    if not len(hits):
        return 0
    lo, hi = (np.searchsorted(ranked, rolled[hits], side=s) for s in ("left", "right"))
    count = hi - lo
    d = np.repeat(hits, count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    i = order[np.repeat(lo, count) + within]
    same = np.ones(len(d), dtype=bool)
    for k in range(seed):  # equal hashes, now equal words
        same &= doc[d + k] == item[i + k]
    d, i = d[same], i[same]
    if not len(d):
        return 0
    # runs of hits along a diagonal are one maximal match
    by = np.lexsort((d, d - i))
    d, i = d[by], i[by]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (np.diff(d) != 1) | (np.diff(i) != 1)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(d))) + seed - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(length, d[at], i[at])]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    covered = 0
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        used = in_doc[a:a + n] | in_item[b:b + n]
        if not used.any():
            in_doc[a:a + n] = in_item[b:b + n] = True
            covered += n
            continue
        # what earlier tiles have left of this match goes back, if it is long enough
        free = np.flatnonzero(np.diff(np.concatenate(([1], used, [1])).astype(np.int8)))
        for s, e in zip(free[::2], free[1::2]):
            if e - s >= seed:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return covered


def _words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return word_hashes(raw, np.array([0, len(raw)], dtype=np.int64))[0]


def benchmark_seeds(items: DataFrame, item_id: str, text: str, seed: int) -> DataFrame:
    """(item_id, words, n_words, hash): the distinct seeds of every distinct item."""
    rows = (items.select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
            .distinct())

    def run(batches):
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                words = _words(t)
                found = seeds_of(words, seed)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([i] * n, pa.int64())),
                     pa.array([words.astype("<u8").tobytes()] * n, pa.binary()),
                     pa.array([len(words)] * n, pa.int32()), pa.array(found.view(np.int64))],
                    ["item_id", "words", "n_words", "hash"])

    out = StructType([rows.schema["item_id"], *StructType.fromDDL("words BINARY, n_words INT, hash BIGINT").fields])
    return rows.mapInArrow(run, out)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  item_id: str = "item_id", item_text: str = "text", seed: int = SEED,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, key, item_id, n_words, covered, coverage) for every pair of a document and
    an item with a tile; ``key`` is ``text_key(text)``.  Identical documents share their rows."""
    spark = docs.sparkSession
    prepare(spark)
    seeds = materialise(benchmark_seeds(items, item_id, item_text, seed), "bench-seeds")
    member = Bloom(seeds, "hash")
    # item lengths below ``seed`` words that occur: at most seed - 1 numbers
    short = sorted(r[0] for r in seeds.where(F.col("n_words") < seed).select("n_words").distinct().collect())
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(text).alias("key"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def run(batches):
        for b in batches:
            keep, words_out, hits_out = [], [], []
            for a, e, data, offsets in blocks(b.column(2)):
                words, first = word_hashes(data, offsets)
                every = shingle_at(words, seed)
                candidates = np.flatnonzero(member.passes(every))
                for row in range(a, e):
                    s, t = int(first[row - a]), int(first[row - a + 1])
                    x, y = np.searchsorted(candidates, (s, max(s, t - seed + 1)))
                    found = [every[candidates[x:y]]]
                    for k in short:
                        h = np.array([sequence_hash(words[i:i + k]) for i in range(s, t - k + 1)], dtype=np.uint64)
                        found.append(h[member.passes(h)])
                    found = np.unique(np.concatenate(found))
                    if len(found):
                        keep.append(row)
                        words_out.append(words[s:t].astype("<u8").tobytes())
                        hits_out.append(found.view(np.int64))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(words_out, pa.binary()),
                 pa.array([h.tolist() for h in hits_out], pa.list_(pa.int64()))], ["doc_id", "key", "doc_words", "hits"])

    cand = materialise(rows.mapInArrow(run, StructType([
        *rows.schema.fields[:2], *StructType.fromDDL("doc_words BINARY, hits ARRAY<BIGINT>").fields]))
        .dropDuplicates(["doc_id", "key"]), "bench-candidates")
    pairs = (cand.select("doc_id", "key", F.explode("hits").alias("hash"))
             .join(seeds, "hash").select("doc_id", "key", "item_id", "words", "n_words").distinct())

    def run_tiles(batches):
        for b in batches:
            n = [tile(np.frombuffer(d, dtype="<u8"), np.frombuffer(w, dtype="<u8"), seed) for d, w in zip(
                b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(n, pa.int32())],
                                             ["doc_id", "key", "item_id", "n_words", "covered"])

    both = (pairs.join(cand.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "doc_words"),
                       F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
            .select("doc_id", "key", "item_id", "n_words", "doc_words", "words"))
    tiles = both.mapInArrow(run_tiles, StructType([*both.schema.fields[:4], *StructType.fromDDL("covered INT").fields]))
    return (tiles.where("covered > 0")
            .withColumn("coverage", F.round(F.col("covered") / F.col("n_words"), 6))
            .withColumn("contaminates", F.col("covered") >= F.lit(threshold) * F.col("n_words")))


def contaminated_documents(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """(doc_id, key, n_items, item_ids, coverage) of the contaminated documents, one row each
    for identical documents."""
    t = decontaminate(docs, items, **parameters).where("contaminates")
    return t.groupBy("doc_id", "key").agg(
        F.countDistinct("item_id").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.max("coverage").alias("coverage"))


def op5_decontaminate(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    bad = contaminated_documents(docs, pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    bad = bad.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_items", "item_ids", "coverage")
    all_ = docs.select("doc_id", text_key("text").alias("key"))
    return (all_.join(bad, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
            .select("doc_id", F.col("n_items").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0)).alias("n_items"),
                    F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",").alias("item_ids"),
                    F.coalesce("coverage", F.lit(0.0)).alias("coverage")))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES: dict[str, str] = {}
