"""Byte-level BPE encoding and decoding over long texts in overlapping chunks.

A text of up to ``chunk`` characters is one piece.  A longer one is cut into chunks that reach
``overlap`` characters into the next, and the chunks are dealt out over the cluster.  A chunk's
pre-tokens start at an arbitrary place, but wherever a word character is followed by a blank or
a line end every pre-token run has a boundary (no pre-token goes on from a non-blank to a
blank), so from there on both neighbours' pre-tokens agree.  The first such place in the
overlap is the stitch: it is found alike from either side, whole pre-tokens lie between two
stitches, and these stretches are encoded where they are.  Where an overlap has no such place
(an endless word), the open ends travel as text and are encoded joined, when the pieces of the
document meet.  Token ids equal those of the whole text, whatever the cuts.

Token ids of a document are one binary value (little-endian unsigned 32-bit); the largest task
holds one document.  Documents of one chunk are never shuffled.

Defined results: a null text is empty (no ids); repeated rows are each kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import pick, prepare, table, text_key

CHUNK, OVERLAP = 32_768, 512
#: The places where neighbouring chunks agree on a pre-token boundary.
STITCH = re.compile(r"(?<=\w)(?=[ \n])")


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str):
    """Encoding and the bytes of every id, once per Python worker."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    vocabulary = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        vocabulary[i] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), vocabulary


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """Ids of a stretch of whole pre-tokens."""
    if not text:
        return b""
    return np.asarray(codec(path, pattern)[0].encode_ordinary(text), dtype="<u4").tobytes()


def decode_ids(ids: bytes, path: str, pattern: str) -> bytes:
    vocabulary = codec(path, pattern)[1]
    return b"".join([vocabulary[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    return [text[i:i + chunk + overlap] for i in range(0, len(text), chunk)] or [""]


def encode_chunk(text: str, first: bool, last: bool, chunk: int, overlap: int, path: str,
                 pattern: str) -> tuple[str, bytes | None, str]:
    """(open head, ids, open tail) of a chunk.  ids None: no stitch at all, the head is the
    whole chunk's own text."""
    own = text if last else text[:chunk]
    start, head = 0, ""
    if not first:
        m = STITCH.search(text, 0, overlap)
        if m is None:  # the neighbour sees none in the overlap either, so its tail is open
            m = STITCH.search(own)
            if m is None:  # all of it is open, up to where the next chunk closes itself
                end = None if last else STITCH.search(text[chunk:], 0, overlap)
                return own if end is None else text[:chunk + end.start()], None, ""
            head = own[:m.start()]
        start = m.start()
    if last:
        return head, encode_text(text[start:], path, pattern), ""
    m = STITCH.search(text[chunk:], 0, overlap)
    if m is not None:
        return head, encode_text(text[start:chunk + m.start()], path, pattern), ""
    end = start
    for x in STITCH.finditer(own, start):
        end = x.start()
    return head, encode_text(own[start:end], path, pattern), own[end:]


def stitch(parts: list[tuple[str, bytes | None, str]], path: str, pattern: str) -> bytes:
    out, open_text = [], ""
    for head, ids, tail in parts:
        open_text += head
        if ids is None:
            continue
        out.append(encode_text(open_text, path, pattern))
        out.append(ids)
        open_text = tail
    out.append(encode_text(open_text, path, pattern))
    return b"".join(out)


def _carry(batch: pa.RecordBatch, n: int) -> list[pa.Array]:
    return [batch.column(i) for i in range(n)]


def encode_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None,
                     pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns plus ``ids`` (binary) of every document."""
    path, n = ranks or default_ranks(), len(keep)
    prepare(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    kept = rows.schema.fields[:n]
    out_schema = StructType([*kept, StructField("ids", BinaryType())])

    def whole(batches):
        for b in batches:
            ids = [encode_text(t, path, pattern) for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*_carry(b, n), pa.array(ids, pa.binary())], [*keep, "ids"])

    short = rows.where(F.length("__t") <= chunk).mapInArrow(whole, out_schema)

    def chunks(batches):
        for b in batches:
            for i, t in enumerate(b.column(n).to_pylist()):
                parts = cut(t, chunk, overlap)
                take = pa.array([i] * len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(take) for c in range(n + 2) if c != n],
                     pa.array(range(len(parts)), pa.int32()),
                     pa.array([j == len(parts) - 1 for j in range(len(parts))]), pa.array(parts, pa.string())],
                    [*keep, "__k", "__j", "__last", "__p"])

    def encoded(batches):
        for b in batches:
            got = [encode_chunk(p, j == 0, last, chunk, overlap, path, pattern) for j, last, p in zip(
                b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist(), b.column(n + 3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*_carry(b, n + 2), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.string())],
                [*keep, "__k", "__j", "head", "ids", "tail"])

    def joined(batches):
        for b in batches:
            ids, copies = [], []
            for parts in b.column(n).to_pylist():
                once = {p["j"]: (p["head"], p["ids"], p["tail"]) for p in parts}
                ids.append(stitch([once[j] for j in sorted(once)], path, pattern))
                copies.append(sum(p["j"] == 0 for p in parts))
            yield pa.RecordBatch.from_arrays(
                [*_carry(b, n), pa.array(ids, pa.binary()), pa.array(copies, pa.int32())], [*keep, "ids", "copies"])

    key = [StructField("__k", LongType()), StructField("__j", IntegerType())]
    long = (rows.where(F.length("__t") > chunk).withColumn("__k", text_key("__t"))
            .mapInArrow(chunks, StructType([*kept, *key, StructField("__last", BooleanType()), StructField("__p", StringType())]))
            .repartition("__k", "__j")
            .mapInArrow(encoded, StructType([*kept, *key, StructField("head", StringType()),
                                             StructField("ids", BinaryType()), StructField("tail", StringType())]))
            # identical rows meet in one group; their number is that of first chunks
            .groupBy(*[F.col(f"`{c}`") for c in keep], "__k")
            .agg(F.collect_list(F.struct(F.col("__j").alias("j"), "head", "ids", "tail")).alias("parts")).drop("__k")
            .mapInArrow(joined, StructType([*kept, StructField("ids", BinaryType()), StructField("copies", IntegerType())]))
            .withColumn("copies", F.explode(F.expr("sequence(1, copies)"))).drop("copies"))
    return short.unionByName(long)


def decode_documents(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id", "ids"), ranks: str | None = None,
                     pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``keep`` columns plus ``decoded``, the concatenated bytes of the tokens."""
    path = ranks or default_ranks()
    at = list(keep).index("ids")
    prepare(encoded.sparkSession)

    def decode(batches):
        for b in batches:
            out = [decode_ids(x, path, pattern) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*_carry(b, len(keep)), pa.array(out, pa.binary())], [*keep, "decoded"])

    rows = pick(encoded, *keep)
    return rows.mapInArrow(decode, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))


def op7_byte_bpe(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = decode_documents(encode_documents(docs))
    return out.select("doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
