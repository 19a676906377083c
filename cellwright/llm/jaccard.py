"""N-gram Jaccard join by multiple global orders.

A document is the set of its word shingles (64-bit hashes).  Two sets link when
``100 * |A & B| >= percent * |A | B|``; documents with equal sets form one class and go on as one
node.  A global order of all shingles puts those of frequent hash buckets last (counts over the
whole corpus, in a fixed number of buckets) and is otherwise decided by a seeded hash; every
seed gives another order.  Linked sets share a token among their first n - ceil(percent * n) + 1
tokens under every order, so

1. under the first order come the tokens that a single node has, as far as they lie in a fixed
   part of all hashes (EARLY); an aggregation over that part of the tokens, for one document of
   each class, finds those that two nodes have, which become a Bloom filter of bounded size.
   What is left of a node's prefix behind its own tokens is listed with positions;
2. these (token, node) rows are dealt by token and class of size (linked sets are of the same or
   neighbouring classes).  Not all pairs of such groups are formed at first: every node in them is
   paired with the least node (a hub) that shares a sketch of two least hashes, for BANDS
   sketches, which links most of what is similar;
3. a pair must also share a prefix token under each of the other orders (``arrays_overlap`` of
   16-bit token prints); then come sizes, counts in 64 buckets, which bound the difference of
   the sets from below, the same bound from as many buckets as a set has tokens, and for what
   is left the sets themselves (verification);
4. components of the verified links.  Links inside a component cannot change the result, so only
   nodes of groups with more than one component go on, with all their tokens.  A token that no
   other component has is a node's own; a node whose own tokens fill its prefix links with no
   other component and leaves, which makes more tokens own (``peel``).  The others are ordered
   anew, own tokens first, then by their count among these nodes, and in every group of a prefix
   token each node is compared with the one that has the least share of own tokens, which stands
   in the middle of its near copies.  Components and ``peel`` again; then all pairs of a group
   whose nodes are still in different components are taken through step 3, where the token's
   positions leave room for the tokens that linked sets share (which holds for the first one
   that they share).  Every such pair is tried, so no link is lost.
Large groups of near copies therefore cost one pair per node, and copies cost one node.

Defined results: a text with fewer words than a shingle is one shingle, without words (or null)
it has none, links with nothing and is its own component; repeated rows are each listed; a null
doc_id counts as greater than any other.  ``component_id`` is the smallest doc_id reachable.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import materialise, pick, prepare, release, table, text_key
from .graph import Bloom, components
from .shingles import mix, shingle_sets

BUCKET_BITS = 18
PART = 4096
ORDERS = 3
#: Sketches of a set, of two least hashes each, whose hub it is compared with at first.
BANDS = 12
#: Part of all tokens, by hash, that is looked through for tokens of a single set.
EARLY = 0.4
#: A number from the first bytes of a signature, as a column.
SHORT = "CAST(conv(hex(substring(sig, 1, 7)), 16, 10) AS BIGINT)"


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def fills_prefix(own: str, percent: int) -> Column:
    """Do so many own tokens fill the prefix of a set of n?"""
    return F.expr(f"{own} >= n - ({percent} * n + 99) DIV 100 + 1")


def ranks(s: np.ndarray, order: int, classes: np.ndarray) -> np.ndarray:
    """Tokens as hashes of one order, those of frequent buckets last."""
    rank = classes[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] << np.uint64(60)
    return rank | (mix(s + np.uint64(2 * order + 1)) >> np.uint64(4))


def prefix(s: np.ndarray, percent: int, order: int, classes: np.ndarray) -> np.ndarray:
    """Prefix tokens of a set under one order."""
    rank, p = ranks(s, order, classes), prefix_length(len(s), percent)
    return rank if p >= len(s) else np.partition(rank, p - 1)[:p]


def in_early(s: np.ndarray) -> np.ndarray:
    """Which tokens lie in the part EARLY of all tokens."""
    return mix(s ^ np.uint64(0x5EED)) < np.uint64(int(EARLY * 2 ** 64))


def early_tokens(s: np.ndarray, percent: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that may stand in the prefix under the first order, sorted: those of the part EARLY of
    all tokens that comes first in it, and as many others as a prefix still lacks."""
    rank, p = ranks(s, 0, classes), prefix_length(len(s), percent)
    first = in_early(s)
    more = np.sort(rank[~first])[:max(0, p - int(first.sum()))]
    return np.sort(rank[first]), more


def spread(s: np.ndarray) -> np.ndarray:
    """Counts of a set's tokens in 64 buckets."""
    return np.minimum(np.bincount((s & np.uint64(63)).astype(np.int64), minlength=64), 32767).astype(np.int16)


def fine(s: np.ndarray) -> bytes:
    """Counts of a set's tokens in as many buckets as its size, rounded down to a power of two
    (64 at least); counts stop at 255."""
    size = 1 << max(6, len(s).bit_length() - 1)
    return np.minimum(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """So many tokens at least are in one set only, by the sets' fine counts.  The longer counts
    are folded to the shorter ones' buckets."""
    x, y = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (a, b))
    size = min(len(x), len(y))
    x, y = (np.minimum(v.reshape(-1, size).sum(axis=0), 255) for v in (x, y))
    return int(np.abs(x - y).sum())


def bands(s: np.ndarray) -> np.ndarray:
    """Sketches of a set; sets of similarity j have each in common with probability j * j."""
    least = np.array([mix(s ^ np.uint64(0xBAD5EED + i)).min() for i in range(2 * BANDS)])
    return mix(mix(least[::2]) ^ least[1::2]).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def first_pass(rows: DataFrame, k: int) -> DataFrame:
    """Per document (part null): doc_id, key, sig, n.  Per task: the counts of its hash buckets,
    in parts of PART buckets."""
    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for b in batches:
            sig, size = [], []
            for _, s in shingle_sets(b.column(2), k):
                sig.append(digest(s) if len(s) else None)
                size.append(len(s))
                at, c = np.unique((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
                counts[at] += c
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sig, pa.binary()), pa.array(size, pa.int64()),
                 pa.nulls(len(sig), pa.int32()), pa.nulls(len(sig), pa.list_(pa.int64()))], names)
        if counts.any():
            m = len(counts) // PART
            parts = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * PART), pa.array(counts))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()),
                 pa.array(np.arange(m, dtype=np.int32)), parts], names)

    names = ["doc_id", "key", "sig", "n", "part", "counts"]
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    return rows.mapInArrow(run, StructType([
        *[StructField(f.name, f.dataType) for f in rows.schema.fields[:2]],
        *StructType.fromDDL("sig BINARY, n BIGINT, part INT, counts ARRAY<BIGINT>").fields]))


def frequency_classes(first: DataFrame) -> np.ndarray:
    """Class (0 to 15) of every hash bucket: doublings of its count over the mean.  At most
    2**BUCKET_BITS rows reach the driver, whatever the corpus."""
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.float64)
    found = (first.where("part IS NOT NULL").select("part", F.posexplode("counts").alias("i", "n")).where("n > 0")
             .groupBy("part", "i").agg(F.sum("n").alias("n")).toPandas())
    at = found["part"].to_numpy(dtype=np.int64) * PART + found["i"].to_numpy(dtype=np.int64)
    counts[at] = found["n"].to_numpy(dtype=np.float64)
    mean = max(1.0, counts.mean())
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / mean)), 0, 15).astype(np.uint64)


def crossing(rows: DataFrame) -> DataFrame:
    """(token, df): tokens that nodes of two components have, and how many nodes."""
    return (rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("df"))
            .where("lo <> hi").select("token", "df"))


def peel(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, node, root, n) of tokens that other components may have: those that others do
    have, of nodes whose own tokens (all others of n) do not fill the prefix, with the number of
    own tokens and the token's position, own ones first, then by df."""
    of_node = Window.partitionBy("node")
    return (rows.select("token", "node", "root", "n").join(crossing(rows), "token")
            .select("token", "node", "root", "n", (F.col("n") - F.count("*").over(of_node)).alias("own"),
                    F.row_number().over(of_node.orderBy("df", "token")).alias("at"))
            .where(~fills_prefix("own", percent))
            .select("token", "node", "root", "n", "own", F.expr("own + at - 1").alias("pos")))


def near_duplicates(docs: DataFrame, k: int, percent: int, text: str = "text", doc_id: str = "doc_id",
                    orders: int = ORDERS) -> DataFrame:
    """Rows (doc_id, key, n_shingles, component_id, component_key), one per document; ``key`` is
    ``text_key(text)``, and (component_id, component_key) the least document of the component."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(text).alias("key"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    first = materialise(first_pass(rows, k), "jaccard-docs")
    classes = spark.sparkContext.broadcast(frequency_classes(first))
    listed = first.where("part IS NULL").drop("part", "counts")

    # Texts are read for one document of each class.  A filter that lets another copy through adds
    # repeated rows, which change nothing.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes_ = materialise(listed.where("sig IS NOT NULL").groupBy("sig").agg(least.alias("least")), "jaccard-classes")
    firsts = Bloom(classes_.select(F.xxhash64("least.doc_id", "least.key").alias("who")), "who")
    texts = rows.select("t", F.xxhash64("doc_id", "key").alias("who"))

    def first_texts(b) -> pa.Array:
        return b.column(0).filter(pa.array(firsts.passes(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))

    def tokens(batches):
        for b in batches:
            sigs, sizes, early, late = [], [], [], []
            for _, s in shingle_sets(first_texts(b), k):
                if len(s):
                    first, more = early_tokens(s, percent, classes.value)
                    sigs.append(digest(s))
                    sizes.append(len(s))
                    early.append(first.view(np.int64))
                    late.append(more.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(early, pa.list_(pa.int64())), pa.array(late, pa.list_(pa.int64()))],
                                             ["sig", "n", "early", "late"])

    every = materialise(texts.mapInArrow(tokens, "sig BINARY, n BIGINT, early ARRAY<BIGINT>, late ARRAY<BIGINT>"), "jaccard-tokens")
    shared = (every.select(F.xxhash64("sig").alias("node"), F.explode(F.concat("early", "late")).alias("token")).groupBy("token")
              .agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token"))
    shared = materialise(shared, "jaccard-shared")
    known = Bloom(shared, "token")

    def postings(batches):
        for b in batches:
            for sig, n, early, late in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                early, late = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (early, late))
                twice = known.passes(early)
                alone = len(early) - int(twice.sum())
                p = np.concatenate([early[twice], late])[:max(0, prefix_length(n, percent) - alone)]
                at = np.arange(len(p), dtype=np.int32) + np.int32(alone)
                keep = known.passes(p)
                p, at = p[keep], at[keep]
                m = len(p)
                if m:
                    sigs = pa.BinaryArray.from_buffers(pa.binary(), m, [
                        None, pa.py_buffer(np.arange(m + 1, dtype=np.int32) * 16), pa.py_buffer(sig * m)])
                    yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), sigs, pa.array(np.full(m, n, np.int64)),
                                                      pa.array(at)], ["token", "sig", "n", "pos"])

    posted = materialise(every.mapInArrow(_joined(postings), "token BIGINT, sig BINARY, n BIGINT, pos INT").distinct(),
                         "jaccard-postings")
    release(every, shared)
    # Sizes of linked sets differ by a factor of at most 100 / percent, so the sets' classes of
    # that width differ by at most one: groups are (token, two neighbouring classes).
    width = math.log(100 / percent) * 1.0001 if percent < 100 else 1.0
    size = f"CAST(floor(ln(n) / {width!r}) AS INT)"

    def in_classes(rows: DataFrame) -> DataFrame:
        return rows.withColumn("c", F.explode(F.expr(f"array({size}, {size} + 1)")))

    classed = in_classes(posted)
    crowd = classed.groupBy("token", "c").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    grouped = materialise(classed.join(crowd, ["token", "c"]), "jaccard-groups")
    release(posted)
    posted = grouped

    # Of the texts, only those of nodes in such groups are needed.
    wanted = Bloom(materialise(posted.select("sig").distinct().select(F.expr(SHORT).alias("h")), "jaccard-wanted"), "h")

    def payload(batches):
        for b in batches:
            found = first_texts(b)
            at, sigs, sizes, parts, fines, sketches, prints = [], [], [], [], [], [], [[] for _ in range(1, orders)]
            for row, s in shingle_sets(found, k):
                if not len(s):
                    continue
                sig = digest(s)
                if not wanted.passes(np.array([int.from_bytes(sig[:7], "big")], dtype=np.uint64))[0]:
                    continue
                at.append(row)
                sigs.append(sig)
                sizes.append(len(s))
                parts.append(spread(s))
                fines.append(fine(s))
                sketches.append(bands(s))
                for o in range(1, orders):
                    p = prefix(s, percent, o, classes.value)
                    prints[o - 1].append(np.unique(mix(p).astype(np.uint16)).view(np.int16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(parts, pa.list_(pa.int16())), pa.array(fines, pa.binary()), pa.array(sketches, pa.list_(pa.int64())),
                 *[pa.array(p, pa.list_(pa.int16())) for p in prints], found.take(pa.array(at, pa.int64()))],
                ["sig", "n", "s", "fine", "bands", *[f"f{o}" for o in range(1, orders)], "t"])

    f_cols = [f"f{o}" for o in range(1, orders)]
    nodes = materialise(texts.mapInArrow(
        payload, "sig BINARY, n BIGINT, s ARRAY<SMALLINT>, fine BINARY, bands ARRAY<BIGINT>, " + "".join(f"{f} ARRAY<SMALLINT>, " for f in f_cols) + "t STRING"), "jaccard-nodes")

    def verify(pairs: DataFrame) -> DataFrame:
        """Links among (a, b) pairs: sizes, the other orders, then the sets."""
        def side(name: str, *columns: str, of: DataFrame = nodes) -> DataFrame:
            return of.select(F.col("sig").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

        close = (pairs.join(side("a", "n", "s", *f_cols), "a").join(side("b", "n", "s", *f_cols), "b")
                 .where((F.col("a_n") * 100 >= F.col("b_n") * percent) & (F.col("b_n") * 100 >= F.col("a_n") * percent)))
        for f in f_cols:
            close = close.where(F.arrays_overlap(f"a_{f}", f"b_{f}"))
        # Sets differ in at least as many tokens as their counts by bucket do.
        close = close.where(F.expr("aggregate(zip_with(a_s, b_s, (x, y) -> abs(x - y)), 0L, (n, d) -> n + d) "
                                   f"* {100 + percent} <= (a_n + b_n) * {100 - percent}"))

        def check(batches):
            for b in batches:
                left, right = ([s for _, s in shingle_sets(b.column(c), k)] for c in (2, 3))
                ok = pa.array([linked(x, y, percent) for x, y in zip(left, right)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

        def apart(batches):
            for b in batches:
                n = b.column(2).to_numpy() + b.column(3).to_numpy()
                least = np.array([least_difference(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())], np.int64)
                ok = pa.array(least * (100 + percent) <= n * (100 - percent))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

        # Last, the same bound from finer counts, for the pairs that are left.
        coarse = materialise(close.select("a", "b").distinct(), "jaccard-coarse")
        close = (coarse.join(side("a", "n", "fine"), "a").join(side("b", "n", "fine"), "b")
                 .select("a", "b", "a_n", "b_n", "a_fine", "b_fine").mapInArrow(apart, "a BINARY, b BINARY"))
        close = materialise(close, "jaccard-close")
        release(coarse)
        both = close.select("a").unionByName(close.select(F.col("b").alias("a"))).withColumnRenamed("a", "sig")
        texts = nodes.where(Bloom(both.select(F.expr(SHORT).alias("h")), "h").column(F.expr(SHORT)))
        full = (close.join(side("a", "t", of=texts), "a").join(side("b", "t", of=texts), "b")
                .select("a", "b", "a_t", "b_t"))
        return full.mapInArrow(check, "a BINARY, b BINARY")

    near = nodes.select("sig", F.posexplode("bands").alias("i", "band")).distinct()
    hubs = near.groupBy("i", "band").agg(F.min("sig").alias("hub"))
    first_pairs = materialise(near.join(hubs, ["i", "band"]).where("sig <> hub")
                              .select(F.col("hub").alias("a"), F.col("sig").alias("b")).distinct(), "jaccard-hub-pairs")
    links = materialise(verify(first_pairs), "jaccard-links")
    parts = components(links)
    placed = materialise(
        posted.select("token", "c", "sig", "n").join(parts.select(F.col("node").alias("sig"), "root"), "sig", "left")
        .select("token", "c", "sig", "n", F.coalesce("root", "sig").alias("root")), "jaccard-placed")
    release(posted)
    # nodes of groups of more than one component
    several = (placed.groupBy("token", "c").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
               .where("lo <> hi").select("token", "c"))
    open_ = materialise(placed.join(several, ["token", "c"]).select("sig", "n", "root").distinct()
                        .select("sig", F.xxhash64("sig").alias("node"), F.xxhash64("root").alias("root"), "n"), "jaccard-open")
    release(placed)

    def all_tokens(batches):
        for b in batches:
            sets = []
            for _, s in shingle_sets(b.column(3), k):
                alone = in_early(s)  # of these it is known whether another node has them
                alone[alone] = ~known.passes(ranks(s[alone], 0, classes.value))
                sets.append(s[~alone].view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.list_(pa.int64()))],
                                             ["node", "root", "n", "tokens"])

    open_texts = nodes.where(Bloom(open_.select(F.expr(SHORT).alias("h")), "h").column(F.expr(SHORT))).select("sig", "t")
    sets = materialise(open_.join(open_texts, "sig").dropDuplicates(["sig"]).select("node", "root", "n", "t")
                       .mapInArrow(all_tokens, "node BIGINT, root BIGINT, n BIGINT, tokens ARRAY<BIGINT>"), "jaccard-sets")
    crossed = Bloom(crossing(sets.select("root", F.explode("tokens").alias("token"))), "token")

    def crossing_tokens(batches):
        for b in batches:
            ends = b.column(3).offsets.to_numpy()
            tokens = b.column(3).values.to_numpy()
            ok = crossed.passes(tokens.view(np.uint64))
            kept = np.concatenate([[0], np.cumsum(ok)])[ends] - int(ok[:ends[0]].sum())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(tokens[ends[0]:ends[-1]][ok[ends[0]:ends[-1]]]))],
                ["node", "root", "n", "tokens"])

    crossed_rows = materialise(
        sets.mapInArrow(crossing_tokens, "node BIGINT, root BIGINT, n BIGINT, tokens ARRAY<BIGINT>")
        .where(~fills_prefix("n - size(tokens)", percent)).select("node", "root", "n", F.explode("tokens").alias("token")),
        "jaccard-crossing")
    release(sets)
    peeled = materialise(peel(crossed_rows, percent), "jaccard-peeled")
    release(crossed_rows)

    def in_groups(rows: DataFrame) -> DataFrame:
        return in_classes(rows.where(~fills_prefix("pos", percent)))

    # the sizes allow a link, and the first token that linked sets share leaves room in both for
    # all that they must share
    room = F.expr(f"root <> x_root AND n * 100 >= x_n * {percent} AND x_n * 100 >= n * {percent} "
                  f"AND least(n - pos, x_n - x_pos) * {100 + percent} >= (n + x_n) * {percent}")

    def as_pairs(found: DataFrame, *tried: DataFrame) -> DataFrame:
        """Signatures (a, b) of node pairs (x, node) that were not tried."""
        ids = open_.select("node", "sig")
        out = (found.select("x", "node").distinct().join(ids, "node").withColumnRenamed("sig", "b")
               .join(ids.select(F.col("node").alias("x"), F.col("sig").alias("a")), "x")
               .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        for t in tried:
            out = out.join(t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        return out

    grouped = in_groups(peeled)
    middle = (grouped.groupBy("token", "c").agg(F.min(F.struct(F.expr("own / n").alias("share"), "node", "root", "n", "pos")).alias("h"))
              .select("token", "c", F.col("h.node").alias("x"), F.col("h.root").alias("x_root"), F.col("h.n").alias("x_n"),
                      F.col("h.pos").alias("x_pos")))
    middle_pairs = materialise(as_pairs(grouped.join(middle, ["token", "c"]).where(room), first_pairs), "jaccard-middle-pairs")
    middle_links = materialise(verify(middle_pairs), "jaccard-links")
    parts = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(middle_links))
    now = parts.select(F.xxhash64("node").alias("node"), F.xxhash64("root").alias("now"))
    moved = peeled.join(now, "node", "left").select("token", "node", F.coalesce("now", "root").alias("root"), "n")
    last = materialise(peel(moved, percent), "jaccard-peeled")
    release(peeled)
    grouped = in_groups(last).withColumn("size", F.expr(size))
    # groups of more than one component, with their largest
    largest = (grouped.groupBy("token", "c", "root").agg(F.count("*").alias("m"))
               .groupBy("token", "c").agg(F.max(F.struct("m", "root")).alias("x"), F.count("*").alias("roots"))
               .where("roots > 1").select("token", "c", F.col("x.root").alias("largest")))
    grouped = materialise(grouped.join(largest, ["token", "c"]), "jaccard-groups")
    probe = grouped.where("root <> largest").select(
        "token", "c", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), F.col("root").alias("x_root"),
        F.col("size").alias("x_size"))
    # every pair of a token once: in the class of the larger set, and of two probes by the lesser one
    rest = probe.join(grouped, ["token", "c"]).where(room).where("greatest(size, x_size) = c AND (root = largest OR x < node)")
    pairs = materialise(as_pairs(rest, first_pairs, middle_pairs), "jaccard-pairs")
    more = materialise(verify(pairs), "jaccard-links")
    release(last, grouped, pairs, nodes)
    roots = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    # Classes keep their least document; components take the least of their classes'.
    rooted = (classes_.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left")
              .withColumn("root", F.coalesce("root", "sig")))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("top"))
    of_class = rooted.join(of_root, "root").select("sig", "top")
    return (listed.join(of_class, "sig", "left")
            .select("doc_id", "key", F.col("n").alias("n_shingles"),
                    F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"),
                    F.when(F.col("top").isNull(), F.col("key")).otherwise(F.col("top.key")).alias("component_key")))


def _joined(make, rows: int = 20_000):
    """Small record batches of a generator, put together."""
    def run(batches):
        held, n = [], 0
        for b in make(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return run


def op3_ngram_jaccard(spark, sf_dir):
    out = near_duplicates(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), k=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLES: dict[str, str] = {}
