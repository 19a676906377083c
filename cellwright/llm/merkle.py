"""Merkle manifest of a dataset, with a proof for every requested row.

A leaf is the digest of a row's fields; the leaves of a group, in order, are the lowest nodes of
a tree of FAN children a node, and the groups' roots, in order, are those of another tree with
the dataset's root on top.  H is SHA-256 of its inputs concatenated, digests as lowercase hex.

1. Ranks.  Rows are sorted by range of (group, order); every partition's rows are numbered, and
   the offsets of the partitions come from one row per partition and group.  No group is in one
   task, however large.
2. Records.  Level by level FAN consecutive nodes become their parent, by an aggregation over
   (group, rank div FAN).  A record maps a digest to its children's digests; equal records are
   one (content-addressed).
3. Descent.  Leaf requests go down from the root by the digits of their rank in base FAN.
   Requests that share a way share the descent: a frontier row is one node that has requests
   below it.  The node's digest is looked up in the records, the selected child becomes the next
   frontier row, and the children that were not selected are put on the path, those left and
   right of the way apart.  The leaves of the last node meet its frontier row in one join, so
   whole paths never travel for single leaves.
4. The segments of a path, reversed, are the proof from leaf to root.

Defined results: a null field is ``-``, so it differs from every text; null groups come before
all others, null orders before all others of their group; rows with equal order are sorted by
their leaf, equal rows are leaves of their own.  An empty table has no root and no rows.  Other
columns of the input are not read, except those asked for.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pick, table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """A field as the leaf hashes it: byte count, colon, value; ``-`` if null."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ranked(rows: DataFrame, group: list[str], order: str, tie: str) -> DataFrame:
    """Rows with their ``rank`` (from 0) within the group and the group's ``size``."""
    rows = materialise(
        rows.repartitionByRange(*group, order).sortWithinPartitions(*group, order, tie)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33).cast("int")), "merkle-sorted")
    pieces = rows.groupBy("part", *group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (pieces.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .withColumn("size", F.sum("n").over(Window.partitionBy(*group)))
              .select(F.col("part").alias("p"), *[F.col(g).alias(f"p_{g}") for g in group], "first", "offset", "size"))
    same = functools.reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"p_{g}")) for g in group],
                            F.col("part") == F.col("p"))
    return (rows.join(pieces, same).withColumn("rank", F.col("offset") + F.col("at") - F.col("first"))
            .drop("at", "part", "p", "first", "offset", *[f"p_{g}" for g in group]))


def depth(size: Column, levels: int) -> Column:
    """Levels above the leaves of a tree with ``size`` leaves; ``levels`` is the most there are."""
    return sum([F.when(size > FAN ** i, 1).otherwise(0) for i in range(levels)], F.lit(0)).cast("int")


def levels_of(size: int) -> int:
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def parents(nodes: DataFrame, group: list[str]) -> DataFrame:
    """The next level of (group, rank, digest): every FAN consecutive nodes are one, with their
    digests as ``children``."""
    return (nodes.groupBy(*group, F.floor(F.col("rank") / FAN).alias("rank"))
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("children"))
            .withColumn("digest", F.sha2(F.array_join("children", ""), 256)))


def build(leaves: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Records (digest, children) and roots (group, digest, size) of the trees over
    (group, rank, digest, size) leaves, and the number of levels of the tallest tree."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    top, records = [], []
    now = leaves.select(*group, "rank", "digest", "size")
    for level in range(levels_of(most)):
        top.append(now.where(F.col("size") <= FAN ** level).select(*group, "digest", "size")
                   if level == 0 else
                   now.where((F.col("size") <= FAN ** level) & (F.col("size") > FAN ** (level - 1))).select(*group, "digest", "size"))
        up = parents(now.where(F.col("size") > FAN ** level), [*group, "size"])
        up = materialise(up, f"merkle-level-{level + 1}")
        records.append(up.select("digest", "children"))
        now = up.select(*group, "rank", "digest", "size")
    last = levels_of(most)
    top.append(now.where(F.col("size") > FAN ** (last - 1)).select(*group, "digest", "size") if last
               else now.select(*group, "digest", "size"))
    union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    empty = leaves.sparkSession.createDataFrame([], "digest string, children array<string>")
    return union([empty, *records]).dropDuplicates(["digest"]), union(top), last


SEGMENT = "ARRAY<STRUCT<left: STRING, right: STRING>>"


def step(frontier: DataFrame, records: DataFrame, wanted: DataFrame, group: list[str], down: Column) -> DataFrame:
    """One level down.  ``frontier``: (group, rank, levels, digest, path, subroot), levels the
    number of levels left; ``wanted``: (group, rank) of the next level's nodes with requests."""
    children = (frontier.where(down).join(records, "digest")
                .select(*group, "rank", "levels", "path", "subroot", "children", F.posexplode("children").alias("digit", "child"))
                .select(*group, (F.col("rank") * FAN + F.col("digit")).alias("rank"), (F.col("levels") - 1).alias("levels"),
                        "subroot", F.col("child").alias("digest"), F.concat("path", F.array(F.struct(
                            F.array_join(F.slice("children", F.lit(1), F.col("digit")), "").alias("left"),
                            F.array_join(F.slice("children", F.col("digit") + 2, F.size("children")), "").alias("right"))))
                        .alias("path")))
    return children.join(wanted, _same(group, "rank"), "left_semi")


def _same(group: list[str], *more: str) -> Column:
    """Null-safe equality with the columns w_<name> of the other side."""
    return functools.reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"w_{g}")) for g in [*group, *more]])


def descend(start: DataFrame, records: DataFrame, requests: DataFrame, group: list[str], levels: int,
            stop: int) -> DataFrame:
    """Frontier rows with at most ``stop`` levels below them, after as many steps as that takes."""
    done = [start.where(F.col("levels") <= stop)]
    now = start.where(F.col("levels") > stop)
    for left in range(levels - 1, stop - 1, -1):
        # Trees shorter than the tallest wait until their first level is due.
        wanted = requests.where(F.col("levels") > left).select(
            *[F.col(g).alias(f"w_{g}") for g in group],
            F.floor(F.col("rank") / FAN ** left).alias("w_rank")).distinct()
        due = F.col("levels") == left + 1
        moved = step(now, records, wanted, group, due)
        now = materialise(now.where(~due).unionByName(moved) if left > stop else moved, "merkle-frontier")
    return functools.reduce(DataFrame.unionByName, [*done, now]) if levels > stop else done[0]


def manifest(rows: DataFrame, group: str, order: str, leaf: str) -> dict:
    """The DAG of a dataset: ``leaves`` (all columns of ``rows``, rank, size, levels, s_rank,
    subroot), ``records`` (digest, children), ``groups`` (group, subroot, rank, levels) and the
    ``root`` frame (digest, levels)."""
    leaves = materialise(ranked(rows, [group], order, leaf).withColumn("digest", F.col(leaf)), "merkle-leaves")
    low, roots, tall = build(leaves, [group])
    roots = materialise(roots, "merkle-subroots")
    tops = materialise(ranked(roots.select(F.lit(0).alias("all"), F.col(group).alias("g"), "digest"), ["all"], "g", "digest"),
                       "merkle-top")
    high, root, top_tall = build(tops, ["all"])
    return {"leaves": leaves.withColumn("levels", depth(F.col("size"), tall)),
            "records": materialise(low.unionByName(high).dropDuplicates(["digest"]), "merkle-records"),
            "groups": tops.withColumn("levels", depth(F.col("size"), top_tall)),
            "root": materialise(root, "merkle-root"), "levels": (tall, top_tall)}


def proofs(m: dict, requests: DataFrame, group: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per requested leaf (distinct rows of ``m["leaves"]``): the columns ``keep``, digest, subroot,
    root, and path, the siblings from the leaf's level up to the root's children."""
    tall, top_tall = m["levels"]
    asked = requests.select("rank", "levels", F.col(group).alias("g"), "digest", *keep)

    # From the root to the subroots that have requests ...
    groups = m["groups"].join(asked.select(F.col("g").alias("w_g")).distinct(), F.col("g").eqNullSafe(F.col("w_g")), "left_semi")
    start = m["root"].select(F.lit(0).alias("all"), F.lit(0).cast("long").alias("rank"), F.lit(top_tall).alias("levels"),
                             "digest", F.expr(f"CAST(array() AS {SEGMENT})").alias("path"),
                             F.lit(None).cast("string").alias("subroot"))
    found = descend(start, m["records"], groups.select("all", "rank", "levels"), ["all"], top_tall, 0)
    subroots = (found.select(F.col("rank").alias("w_rank"), "digest", "path").join(groups.select("rank", "g"), F.col("rank") == F.col("w_rank"))
                .select("g", F.col("digest").alias("subroot"), F.col("digest"), "path"))
    # ... and from there to the nodes right above the leaves.
    begin = (subroots.join(asked.select(F.col("g").alias("w_g"), F.col("levels")).distinct(), _same(["g"]))
             .select("g", F.lit(0).cast("long").alias("rank"), "levels", "digest", "path", "subroot"))
    last = descend(begin, m["records"], asked, ["g"], tall, 1)

    # The requests below one node: at most FAN, or one (a lone leaf is its own subroot).
    below = asked.groupBy(F.col("g").alias("w_g"), F.floor(F.col("rank") / FAN).alias("w_rank")).agg(
        F.collect_list(F.struct("rank", "digest", *keep)).alias("asked"))
    last = (last.join(m["records"].withColumnRenamed("digest", "r"), F.col("digest") == F.col("r"), "left")
            .select("g", "rank", "subroot", "path", F.when(F.col("levels") > 0, F.col("children")).alias("children")))
    top = m["root"].first()  # one row, or none
    met = (last.join(below, _same(["g"], "rank")).select("g", "subroot", "path", "children", F.explode("asked").alias("a"))
           .select("g", "subroot", "path", "children", "a.*").withColumn("digit", (F.col("rank") % FAN).cast("int")))
    leaf_segment = F.when(F.col("children").isNull(), F.expr(f"CAST(array() AS {SEGMENT})")).otherwise(F.array(F.struct(
        F.array_join(F.slice("children", F.lit(1), F.col("digit")), "").alias("left"),
        F.array_join(F.slice("children", F.col("digit") + 2, F.size("children")), "").alias("right"))))
    return met.select(F.col("g").alias(group), "digest", *keep, "subroot", F.lit(top and top["digest"]).alias("root"),
                      F.reverse(F.concat("path", leaf_segment)).alias("path"))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of its proof."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def tampered(text: Column, doc_id: Column) -> Column:
    """The text of a fifth of the rows with A-Z lower-cased, that of all others as it is."""
    return F.when(F.crc32(doc_id.cast("string")) % 5 == 0, F.translate(text, UPPER, UPPER.lower())).otherwise(text)


def verify_rows(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` (columns FIELDS) and the check of every row against it, with a fifth of
    the rows tampered with."""
    cols = [F.col(c) for c in FIELDS]
    changed = [*cols[:-1], tampered(F.col("text"), F.col("doc_id"))]
    rows = docs.select("doc_id", "source", leaf_digest(*cols).alias("leaf"), leaf_digest(*changed).alias("now"))
    m = manifest(rows, "source", "doc_id", "leaf")
    out = proofs(m, m["leaves"], "source", keep=("doc_id", "leaf", "now"))
    return (out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       fold(F.col("now"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op13_merkle_manifest(spark, sf_dir):
    return verify_rows(pick(table(spark, sf_dir, "documents"), *FIELDS))


def _sql_tree(name: str, leaves: str, levels: int) -> str:
    """CTEs <name>0..<name>{levels}: the nodes (g, r, h) of each level with the digests left and
    right of them in their run; ``n`` is the level's size."""
    out = []
    for i in range(levels + 1):
        below = leaves if i == 0 else f"""SELECT g, r // {FAN} AS r, CASE WHEN max(n) > 1
            THEN sha256(string_agg(h, '' ORDER BY r)) ELSE max(h) END AS h FROM {name}{i - 1} GROUP BY g, r // {FAN}"""
        run = f"OVER (PARTITION BY g, r // {FAN} ORDER BY r ROWS BETWEEN"
        out.append(f"""{name}{i} AS (SELECT g, r, h, count(*) OVER (PARTITION BY g) AS n,
            coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lt,
            coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt FROM ({below}))""")
    return ",\n".join(out)


def sql_crc32(points: str) -> str:
    """DuckDB expression: unsigned crc32 of a list of bytes."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {points}), lambda a, b: list_reduce(list_prepend(xor(a, b), "
            "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)")


def oracle(levels: int = 6, top_levels: int = 4) -> str:
    """The same tree in SQL, for up to FAN ** levels leaves a source and FAN ** top_levels sources."""
    def digest(text: str) -> str:
        return "sha256(" + " || ".join(
            f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text)) + ")"

    points = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)"
    joins, proof, folds = "", [], []
    for i, (t, at) in enumerate([(f"a{i}", f"(l.r // {FAN ** i})") for i in range(levels)]
                                + [(f"b{i}", f"(q.r // {FAN ** i})") for i in range(top_levels)]):
        on = f"{t}.g IS NOT DISTINCT FROM l.source AND {t}.r = {at}" if t[0] == "a" else f"{t}.r = {at}"
        if t == "b0":
            joins += " JOIN q ON q.source IS NOT DISTINCT FROM l.source"
        joins += f" JOIN {t} ON {on}"
        proof.append(f"{t}.lt || {t}.rt")
        folds.append(f"CASE WHEN {t}_n > 1 THEN sha256({t}_lt || x{i} || {t}_rt) ELSE x{i} END AS x{i + 1}")
    names = [f"a{i}" for i in range(levels)] + [f"b{i}" for i in range(top_levels)]
    carried = ", ".join(f"{t}.n AS {t}_n, {t}.lt AS {t}_lt, {t}.rt AS {t}_rt" for t in names)
    folded = "\n".join(f", f{i + 1} AS (SELECT *, {f} FROM f{i})" for i, f in enumerate(folds))
    return f"""
WITH d AS (SELECT *, CASE WHEN {sql_crc32(points)} % 5 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END AS text2
      FROM documents),
l0 AS (SELECT doc_id, source, {digest("text")} AS leaf, {digest("text2")} AS now FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM l0),
{_sql_tree("a", "SELECT source AS g, r, leaf AS h FROM l", levels)},
q AS (SELECT g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r FROM a{levels}),
{_sql_tree("b", "SELECT 0 AS g, r, h FROM q", top_levels)},
f0 AS (SELECT l.doc_id, l.leaf, q.h AS subroot, (SELECT max(h) FROM b{top_levels}) AS root,
         sha256({" || ".join(proof)}) AS proof_sha256, {carried}, l.now AS x0
       FROM l{joins})
{folded}
SELECT doc_id, leaf, subroot, root, proof_sha256, x{len(names)} AS folded_root, x{len(names)} = root AS verified FROM f{len(names)}"""


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": oracle()}
