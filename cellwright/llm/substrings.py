"""Exact substring dedup by distributed prefix doubling.

A byte goes if it lies in a string of ``length`` bytes that also starts at another place of the
corpus.  Ranking all byte positions would move many times the corpus, so the doubling runs on
the positions that can decide: every window of ``length`` bytes has an anchor, the leftmost
position with the least 8-byte hash among the first three quarters of the window (its
minimiser).  Equal windows have their anchors at equal offsets, neighbouring windows share
them, and there is about one anchor for ``length * 3 / 8`` bytes.

1. The name of an anchor is the hash of its first ``length // 8`` bytes.  One aggregation finds
   the names that occur twice, a Bloom filter of bounded size holds them, and only anchors
   that pass it are kept: a unique prefix ends the search there.
2. The pairs (name, name of the next block) that occur twice are sorted and ranked anew, all
   other anchors drop out, and the ranked prefix doubles to the ``length // 4`` bytes that lie
   in every window of an anchor.
3. Past that: the pairs (rank, hash of all that the anchor's windows cover).  Where such a pair
   occurs twice, all windows of the anchor repeat.
4. What is left are anchors at the edge of a repeat: equal prefix, other surroundings.  Of every
   distinct surrounding of such a rank one anchor goes on, cut into BLOCK windows by their
   offset from the anchor.  What all windows of a block share is its core: a block with a
   unique core repeats nowhere, one that repeats as a whole is done, and only the others (about
   one at either end of a repeat) list their single windows, of which equal ones repeat.

A text is bytes of UTF-8; a string never crosses documents; overlapping repeats and repeats
within a document count.  A hot string is a hot key only of aggregations with map-side
combination and of ordinary joins, which adaptive execution splits.  Strings are compared by
64-bit hashes within groups that already agree on another 64-bit hash or on a rank.

Defined results: null texts are empty; texts shorter than ``length`` keep all bytes; repeated
rows repeat each other, so they lose what is long enough; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import materialise, pick, prepare, table, text_key
from .graph import Bloom
from .jaccard import _joined
from .shingles import mix, powers

LENGTH = 400
SEGMENT = 1 << 20
BLOCK = 16
_U = np.uint64


class Segment:
    """Up to SEGMENT window starts of one text, from byte ``at``."""

    def __init__(self, data: np.ndarray, at: int, length: int):
        self.at, self.length = at, length
        data = data[at:at + SEGMENT + length - 1]
        self.n = len(data) - length + 1  # windows
        grams = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        self.gram = mix(grams.astype(_U))
        up, self.down = powers(len(self.gram))
        self.total = np.zeros(len(self.gram) + 1, dtype=_U)
        np.cumsum(self.gram * up, out=self.total[1:])

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        """Hash of the bytes [start, start + size) of the segment, at least 8 of them."""
        return mix((self.total[start + size - 7] - self.total[start]) * self.down[start]
                   + mix(np.asarray(size).astype(_U)))

    def anchors(self):
        """(anchor, first window, last window), positions in the segment."""
        w = 3 * self.length // 4
        m = self.n + w - 1
        key = (self.gram[:m] & ~_U(0xFFFFFF)) | np.arange(m, dtype=_U)
        rows = -(-m // w)
        padded = np.full(rows * w, ~_U(0), dtype=_U)
        padded[:m] = key
        grid = padded.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:self.n], ahead[w - 1:w - 1 + self.n])
        at = (least & _U(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return at[first], first, np.append(first[1:], self.n) - 1


def segments(text: str, length: int):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        yield Segment(data, at, length)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def rerank(rows: DataFrame, pair: list[str], rank: str) -> DataFrame:
    """Rows whose pair occurs twice, with the pair's place in sorted order as their new rank."""
    names = rows.groupBy(*pair).agg(F.count("*").alias("m")).where("m > 1").select(*pair)
    names = materialise(names.sort(*pair).withColumn(rank, F.monotonically_increasing_id()), "ranks")
    return rows.join(names, pair).drop(*pair)


def identity(key, *at) -> np.ndarray:
    """One 64-bit name of a place: a document key and positions."""
    out = np.asarray(key, dtype=np.int64).view(_U)
    for x in at:
        out = mix(out ^ mix(np.asarray(x).astype(_U)))
    return out


def resolve(rows: DataFrame, group: list[str], whole: list[str], place: list[str], length: int):
    """Stretches of windows (first, last) that repeat as a whole, as byte ranges; and the places
    that must be looked at more closely: of every group with several wholes, one of each."""
    wholes = materialise(rows.groupBy(*group, *whole).agg(F.count("*").alias("m"), F.min(F.struct("key", *place)).alias("one")),
                         "substring-wholes")
    found = rows.join(wholes.where("m > 1").select(*group, *whole), [*group, *whole]).select(
        "doc_id", "key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    mixed = wholes.groupBy(*group).agg(F.count("*").alias("k")).where("k > 1").select(*group)

    @F.pandas_udf("bigint")
    def name(key: pd.Series, *at: pd.Series) -> pd.Series:
        return pd.Series(identity(key.to_numpy(), *[x.to_numpy() for x in at]).view(np.int64))

    closer = materialise(wholes.join(mixed, group).select(
        F.col("one.key").alias("key"), name("one.key", *[f"one.{p}" for p in place]).alias("who")), "substring-edges")
    return found, Bloom(closer, "key"), Bloom(closer, "who")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, start, end): byte ranges to remove, overlapping, in no order; ``key`` is
    ``text_key(doc_id, text)``."""
    if length < 64:
        raise ValueError("length must be at least 64 bytes")
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(doc_id, text).alias("key"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).where(F.octet_length("t") >= length)
    half, full = length // 8, length // 4
    id_field = StructField("doc_id", rows.schema["doc_id"].dataType)

    def schema(columns: str) -> StructType:
        return StructType([id_field, *StructType.fromDDL("key BIGINT, " + columns).fields])

    def scan(make, columns: str, keys: Bloom | None = None) -> DataFrame:
        """Rows (doc_id, key, ...) that ``make(segment, key)`` lists as arrays for every segment of
        the documents whose key passes."""
        out = schema(columns)

        def run(batches):
            for b in batches:
                key = b.column(1).to_numpy(zero_copy_only=False)
                wanted = range(len(key)) if keys is None else np.flatnonzero(keys.passes(key.view(_U)))
                for i in wanted:
                    for g in segments(b.column(2)[int(i)].as_py(), length):
                        found = make(g, key[i])
                        if found is not None:
                            row = pa.array(np.full(len(found[0]), i))
                            yield pa.RecordBatch.from_arrays(
                                [b.column(0).take(row), b.column(1).take(row), *map(_long, found)], out.names)

        return rows.mapInArrow(_joined(run), out)

    def names(batches):
        for b in batches:
            for t in b.column(0):
                for g in segments(t.as_py(), length):
                    yield pa.RecordBatch.from_arrays([_long(g.hash(g.anchors()[0], half))], ["name"])

    twice = (rows.select("t").mapInArrow(_joined(names), "name BIGINT").groupBy("name").agg(F.count("*").alias("m"))
             .where("m > 1").select("name"))
    twice = Bloom(materialise(twice, "substring-names"), "name")

    def kept(g, key):
        at, first, last = g.anchors()
        name = g.hash(at, half)
        ok = twice.passes(name)
        if not ok.any():
            return None
        at, first, last = at[ok], first[ok], last[ok]
        return (first + g.at, last + g.at, at - first, name[ok], g.hash(at + half, full - half),
                g.hash(first, last - first + length))

    anchors = materialise(scan(kept, "first BIGINT, last BIGINT, off BIGINT, b0 BIGINT, b1 BIGINT, w BIGINT"),
                          "substring-anchors")
    ranked = materialise(rerank(anchors, ["b0", "b1"], "rank").withColumn("size", F.col("last") - F.col("first")),
                         "substring-ranked")
    found, docs_a, places_a = resolve(ranked, ["rank"], ["w", "off", "size"], ["first"], length)

    def cut(g, key):
        """(anchor, place, block, least and greatest offset) of the blocks of the listed anchors."""
        at, first, last = g.anchors()
        ok = places_a.passes(identity(np.full(len(at), key), first + g.at))
        at, first, last = at[ok], first[ok], last[ok]
        lo, hi = (at - last) // BLOCK, (at - first) // BLOCK
        many = hi - lo + 1
        which = np.repeat(np.arange(len(at)), many)
        j = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + lo[which]
        least = np.maximum(j * BLOCK, (at - last)[which])
        most = np.minimum(j * BLOCK + BLOCK - 1, (at - first)[which])
        return at[which], first[which] + g.at, j, least, most

    def core(g, at, j):
        """What all windows of a block share, by block."""
        return mix(g.hash(at - j * BLOCK, length - BLOCK + 1) ^ mix(j.astype(_U)))

    def blocks(g, key):
        at, place, j, least, most = cut(g, key)
        if not len(at):
            return None
        return (at - most + g.at, at - least + g.at, place, j, least, most, core(g, at, j),
                g.hash(at - most, most - least + length))

    blocked = materialise(scan(blocks, "first BIGINT, last BIGINT, place BIGINT, j BIGINT, least BIGINT, most BIGINT, "
                                       "core BIGINT, w BIGINT", docs_a), "substring-blocks")
    found_b, docs_b, places_b = resolve(blocked, ["core"], ["w", "least", "most"], ["place", "j"], length)

    def windows(g, key):
        at, place, j, least, most = cut(g, key)
        ok = places_b.passes(identity(np.full(len(at), key), place, j))
        if not ok.any():
            return None
        at, j, least, most = at[ok], j[ok], least[ok], most[ok]
        many = most - least + 1
        which = np.repeat(np.arange(len(at)), many)
        start = (at - most)[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        return start + g.at, core(g, at, j)[which], g.hash(start, length)

    hashed = materialise(scan(windows, "start BIGINT, core BIGINT, w BIGINT", docs_b), "substring-windows")
    again = hashed.groupBy("core", "w").agg(F.count("*").alias("m")).where("m > 1").select("core", "w")
    single = hashed.join(again, ["core", "w"]).select("doc_id", "key", "start", (F.col("start") + length).alias("end"))
    return found.unionByName(found_b).unionByName(single)


def doubled_positions(docs: DataFrame, length: int = LENGTH, first: int = 25, text: str = "text",
                      doc_id: str = "doc_id") -> DataFrame:
    """(key, pos, rank): the starts of all strings of ``length`` bytes that start elsewhere too, by
    plain prefix doubling over every byte position; ``length`` is ``first`` times a power of two.

    A position's rank stands for its first ``first`` bytes, then for twice as many in every round:
    the pairs (rank, rank of the position behind) that occur twice are sorted and ranked anew,
    and positions with a unique pair drop out.  It moves many times the text in each round and
    serves as the yardstick for ``repeated_ranges``."""
    prepare(docs.sparkSession)
    rows = docs.select(text_key(doc_id, text).alias("key"), F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def run(batches):
        for b in batches:
            for key, row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for g in segments(t.as_py(), first):
                    at = np.arange(g.n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(g.n, key)), pa.array(np.full(g.n, row)), pa.array(at + g.at),
                                                      _long(g.hash(at, first))], ["key", "row", "pos", "rank"])

    now = materialise(rows.mapInArrow(run, "key BIGINT, row BIGINT, pos BIGINT, rank BIGINT"), "doubling")
    now = materialise(now.join(now.groupBy("rank").agg(F.count("*").alias("m")).where("m > 1").select("rank"), "rank"), "doubling")
    size = first
    while size < length:
        behind = now.select("key", "row", (F.col("pos") - size).alias("pos"), F.col("rank").alias("next"))
        now = materialise(rerank(now.join(behind, ["key", "row", "pos"]), ["rank", "next"], "new")
                          .select("key", "row", "pos", F.col("new").alias("rank")), "doubling")
        size *= 2
    return now


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document: the maximal removed byte ranges as
    array<struct<start, end>>, and the remaining bytes concatenated."""
    spark = docs.sparkSession
    ranges = materialise(repeated_ranges(docs, length, text, doc_id).groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("start", "end")).alias("ranges")), "substring-ranges")
    hit = Bloom(ranges.select("key"), "key")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(doc_id, text).alias("key"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"))

    marked = rows.withColumn("may", hit.column("key"))
    span_t = "ARRAY<STRUCT<start: BIGINT, end: BIGINT>>"
    clean = marked.where("NOT may").select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"),
                                           F.expr(f"CAST(array() AS {span_t})").alias("spans"), F.col("t").alias("kept"))
    r = ranges.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "ranges")
    both = (marked.where("may").join(r, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
            .select("doc_id", "t", "ranges"))

    def cut(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            sizes, spans, kept = [], [], []
            for t, ranges_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                sizes.append(len(t))
                found, out, done = [], [], 0
                for x in sorted((x["start"], x["end"]) for x in ranges_ or []):
                    if found and x[0] <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], x[1])
                    else:
                        found.append(list(x))
                for a, e in found:
                    out.append(t[done:a])
                    done = e
                kept.append(b"".join([*out, t[done:]]))
                spans.append([{"start": a, "end": e} for a, e in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind),
                                              pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return clean.unionByName(both.mapInArrow(cut, clean.schema))


def op1_substring_dedup(spark, sf_dir):
    out = remove_repeats(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_bytes", F.expr(
        "aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("has_repeats"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES: dict[str, str] = {}
