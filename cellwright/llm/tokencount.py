"""Token counts by a unigram model, computed on tries of distinct pre-tokens.

A vocabulary piece of rank r has log probability -ln(r + 2) (a Zipf model; the rank file is a
parameter).  The count of a pre-token is the number of pieces on its best path: at every
prefix the best score that reaches it, of equal scores the fewer pieces.  Such a forward value
depends on the prefix alone.  A worker puts the distinct new pre-tokens of some megabytes of
text into a trie, laid out level by level as arrays: in sorted order, neighbours with a common
prefix share its node.  Each node's value is computed once, all nodes of a level together.  A
node carries the vocabulary matches still open at it, so a level costs the advance of those.
The count found at a pre-token's last byte is stored and reused for all its occurrences.
Pre-tokens over LONG bytes get the same values along a path of their own, so an endless word
does not widen the arrays.

The stored counts are emptied when there are ``max_counts`` of them; values do not depend on
when.  Documents are counted where they are read: nothing shuffles, and no key can be hot.

Defined results: a null or empty text has no pre-tokens and no tokens; repeated rows are
counted one by one; an empty table gives an empty result.  The vocabulary must hold all 256
single bytes (checked), so every text has a path.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import pick, prepare, table

MAX_COUNTS = 500_000
LONG = 64
GROUP_CHARS = 4 << 20


class Vocabulary:
    """Trie of the pieces.  ``moves`` holds state * 256 + byte in order, ``to`` the states they
    lead to, ``weight`` the log probability of the piece that ends in a state (or -inf)."""

    def __init__(self, path: str):
        children: list[dict[int, int]] = [{}]
        weight = [-math.inf]
        with open(path, "rb") as f:
            for line in f:
                piece, rank = line.split()
                state = 0
                for byte in base64.b64decode(piece):
                    if byte not in children[state]:
                        children[state][byte] = len(children)
                        children.append({})
                        weight.append(-math.inf)
                    state = children[state][byte]
                weight[state] = -math.log(int(rank) + 2)
        missing = [b for b in range(256) if b not in children[0] or weight[children[0][b]] == -math.inf]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.children = children
        pairs = sorted((s * 256 + b, to) for s, c in enumerate(children) for b, to in c.items())
        self.moves, self.to = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.weight = np.array(weight)

    def advance(self, states: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the states have the move, where it leads)."""
        move = states * 256 + byte
        at = np.minimum(np.searchsorted(self.moves, move), len(self.moves) - 1)
        ok = self.moves[at] == move
        return ok, self.to[at[ok]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def level_counts(tokens: list[bytes], vocab: Vocabulary) -> np.ndarray:
    """Pieces of every token; the tokens are distinct, not empty and in sorted order."""
    size = np.array([len(t) for t in tokens])
    width = int(size.max())
    grid = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), dtype=np.uint8).reshape(len(tokens), width)
    common = np.zeros(len(tokens), dtype=np.int64)  # bytes shared with the token before
    differ = grid[1:] != grid[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    out = np.zeros(len(tokens), dtype=np.int64)
    node_of = np.zeros(len(tokens), dtype=np.int64)  # node of each token's prefix, one level up
    score, pieces = np.zeros(1), np.zeros(1, dtype=np.int64)
    owner = state = np.zeros(0, dtype=np.int64)  # open matches of a level, by node
    from_score, from_pieces = np.zeros(0), np.zeros(0, dtype=np.int64)
    for depth in range(1, width + 1):
        rows = np.flatnonzero(size >= depth)
        new = common[rows] < depth
        first = rows[new]
        parent, byte = node_of[first], grid[first, depth - 1].astype(np.int64)
        # every open match of the parent, and the one that starts at the parent
        starts = np.searchsorted(owner, parent)
        many = np.searchsorted(owner, parent, side="right") - starts
        total = many + 1
        child = np.repeat(np.arange(len(first)), total)
        offset = np.arange(len(child)) - np.repeat(np.cumsum(total) - total, total)
        fresh = offset == np.repeat(many, total)
        at = np.where(fresh, 0, np.repeat(starts, total) + offset)
        up = parent[child]
        states = np.where(fresh, 0, state[at] if len(state) else 0)
        s = np.where(fresh, score[up], from_score[at] if len(state) else 0.0)
        n = np.where(fresh, pieces[up], from_pieces[at] if len(state) else 0)
        ok, state = vocab.advance(states, byte[child])
        owner, from_score, from_pieces = child[ok], s[ok], n[ok]
        reach = from_score + vocab.weight[state]
        cut = np.searchsorted(owner, np.arange(len(first)))  # no node is without a match
        score = np.maximum.reduceat(reach, cut)
        fewest = np.where(reach == score[owner], from_pieces + 1, np.iinfo(np.int64).max)
        pieces = np.minimum.reduceat(fewest, cut)
        node_of[rows] = np.cumsum(new) - 1
        ends = rows[size[rows] == depth]
        out[ends] = pieces[node_of[ends]]
    return out


def long_count(raw: bytes, vocab: Vocabulary) -> int:
    """Pieces of one token: the same forward values along a single path."""
    score, pieces, open_ = 0.0, 0, []
    for byte in raw:
        best, fewest, still = -math.inf, 0, []
        for s, n, at in (*open_, (score, pieces, 0)):
            to = vocab.children[at].get(byte)
            if to is None:
                continue
            still.append((s, n, to))
            reach = s + vocab.weight[to]
            if reach > best or (reach == best and n + 1 < fewest):
                best, fewest = reach, n + 1
        score, pieces, open_ = best, fewest, still
    return pieces


class Counter:
    def __init__(self, vocab: Vocabulary, max_counts: int = MAX_COUNTS):
        self.vocab, self.max_counts, self.counts = vocab, max_counts, {}

    def totals(self, texts: list[list[str]]) -> list[int]:
        """Pieces of each list of pre-tokens."""
        if len(self.counts) >= self.max_counts:
            self.counts = {}
        counts = self.counts
        new = {}
        for t in set().union(*texts).difference(counts):
            raw = t.encode()
            if len(raw) > LONG:
                counts[t] = long_count(raw, self.vocab)
            else:
                new[raw] = t
        if new:
            order = sorted(new)
            for raw, n in zip(order, level_counts(order, self.vocab).tolist()):
                counts[new[raw]] = n
        return [sum(map(counts.__getitem__, t)) for t in texts]


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None,
                 pattern: str = public_tokenizers.PATTERN, max_counts: int = MAX_COUNTS) -> DataFrame:
    """``keep`` columns plus n_pretokens and n_tokens (long) of every document."""
    path, n = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), len(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    prepare(docs.sparkSession)

    def run(batches):
        counter, split = Counter(vocabulary(path), max_counts), regex.compile(pattern)
        for b in batches:
            texts, tokens, totals, held, size = b.column(n), [], [], [], 0
            for i in range(len(texts)):
                t = texts[i].as_py()
                held.append(split.findall(t))
                size += len(t)
                if size >= GROUP_CHARS or i == len(texts) - 1:
                    tokens += map(len, held)
                    totals += counter.totals(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(n)], pa.array(tokens, pa.int64()), pa.array(totals, pa.int64())],
                [*keep, "n_pretokens", "n_tokens"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:n], StructField("n_pretokens", LongType()),
                                            StructField("n_tokens", LongType())]))


def op2_token_counts(spark, sf_dir):
    return count_tokens(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
