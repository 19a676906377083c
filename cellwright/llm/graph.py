"""Bounded filters and connected components shared by the join operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import materialise
from .shingles import mix

#: Bits of a Bloom filter: 32 for every key, at most this many (32 MB).
MAX_BITS = 1 << 28
HASHES = 3


def bit_positions(hashes: np.ndarray, n_bits: int) -> list[np.ndarray]:
    return [mix(hashes + np.uint64(i + 1)) & np.uint64(n_bits - 1) for i in range(HASHES)]


class Bloom:
    """Bloom filter of a column of 64-bit hashes, for use inside tasks.  Its size is bounded by
    MAX_BITS whatever the number of keys; beyond that it lets more through, never less."""

    def __init__(self, keys: DataFrame, column: str):
        n = keys.select(F.approx_count_distinct(column)).first()[0]
        self.n_bits = n_bits = min(MAX_BITS, 1 << max(16, int(32 * n).bit_length()))

        def run(batches):
            for b in batches:
                h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.unique(np.concatenate(bit_positions(h, n_bits))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63)], ["word", "bit"])

        bits = (keys.select(column).mapInArrow(run, "word BIGINT, bit BIGINT")
                .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, CAST(bit AS INT)))").alias("bits")))
        words = np.zeros(n_bits >> 6, dtype=np.int64)
        found = bits.toArrow()  # at most MAX_BITS / 64 rows
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(words.tobytes())

    def __getstate__(self):
        return self.n_bits, self.shared

    def __setstate__(self, state):
        self.n_bits, self.shared = state

    def column(self, key: Column | str) -> Column:
        """Does a 64-bit column pass?  Only that column goes to the Python workers."""
        @F.pandas_udf(BooleanType())
        def may(keys: pd.Series) -> pd.Series:
            return pd.Series(self.passes(keys.to_numpy(dtype=np.int64).view(np.uint64)))
        return may(key)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        words = np.frombuffer(self.shared.value, dtype=np.uint64)
        out = np.ones(len(hashes), dtype=bool)
        for at in bit_positions(hashes, self.n_bits):
            out &= ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) of the connected components of (a, b) edges; nodes without an edge are not
    listed.  Alternating large-star and small-star steps: every node links its neighbours to the
    least one it knows, until nothing changes; the number of rounds grows with the logarithm of
    a component's length.  Rounds are written to the shared folder."""
    now = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least2, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least2.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = materialise(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
    raise RuntimeError("components did not settle")
