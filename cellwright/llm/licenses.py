"""License scans: ordered signature rules over the words of a text.

A text is reduced to its words (runs of ASCII letters and digits, A-Z lower-cased, and of any
non-ASCII characters), joined by single blanks.  The signature table below names license
families; ``signatures`` compiles it into some hundreds of regular expressions with a label,
a priority and a required keyword.  A rule's expression runs only where its keyword occurs
(prefilter).  Behind "SPDX-License-Identifier" the identifiers of the expression are read one
after the other, as long as ``or`` / ``and`` join them.  Detections are then resolved: going by
priority, a detection that lies within one already kept is suppressed.  The three base phrases are reported at all their places and
are never suppressed.

Each document is judged alone, in Arrow batches; nothing shuffles.

Defined results: a null or wordless text has no words, places, labels ('' ) and score 0;
repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import pick, prepare, table

#: Phrases and labels of the base detections.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Signature table: label, names (regular expressions over words), versions.
FAMILIES = (
    ("gpl", ("gnu general public licen[cs]e", "gnu gpl", "gpl"), ("1", "2", "3")),
    ("lgpl", ("gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "lgpl"), ("2", "2 1", "3")),
    ("agpl", ("gnu affero general public licen[cs]e", "affero gpl", "agpl"), ("1", "3")),
    ("gfdl", ("gnu free documentation licen[cs]e", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache software licen[cs]e", "apache licen[cs]e", "asl"), ("1 0", "1 1", "2 0")),
    ("mpl", ("mozilla public licen[cs]e", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public licen[cs]e", "epl"), ("1 0", "2 0")),
    ("eupl", ("european union public licen[cs]e", "eupl"), ("1 0", "1 1", "1 2")),
    ("cddl", ("common development and distribution licen[cs]e", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public licen[cs]e", "cpl"), ("0 5", "1 0")),
    ("osl", ("open software licen[cs]e", "osl"), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free licen[cs]e", "afl"), ("1 1", "2 0", "2 1", "3 0")),
    ("artistic", ("perl artistic licen[cs]e", "artistic licen[cs]e"), ("1 0", "2 0")),
    ("bsl", ("boost software licen[cs]e", "bsl"), ("1 0",)),
    ("cc-by-nc-nd", ("creative commons attribution noncommercial noderiv(?:ative)?s", "cc by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike", "cc by nc sa"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("creative commons attribution noncommercial", "cc by nc"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("creative commons attribution noderiv(?:ative)?s", "cc by nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("creative commons attribution share ?alike", "cc by sa"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", ("creative commons attribution", "cc by"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", ("creative commons zero", "cc0", "cc zero"), ("1 0",)),
    ("zpl", ("zope public licen[cs]e", "zpl"), ("1 1", "2 0", "2 1")),
    ("php", ("php licen[cs]e",), ("3 0", "3 01")),
    ("psf", ("python software foundation licen[cs]e", "psf licen[cs]e"), ("2",)),
    ("ofl", ("sil open font licen[cs]e", "open font licen[cs]e"), ("1 0", "1 1")),
    ("odbl", ("open database licen[cs]e", "odbl"), ("1 0",)),
    ("odc-by", ("open data commons attribution licen[cs]e",), ("1 0",)),
    ("ms-pl", ("microsoft public licen[cs]e", "ms pl"), ()),
    ("ms-rl", ("microsoft reciprocal licen[cs]e", "ms rl"), ()),
    ("unlicense", ("the unlicen[cs]e", "unlicense org"), ()),
    ("wtfpl", ("do what the fuck you want to public licen[cs]e", "wtfpl"), ("2",)),
    ("zlib", ("zlib licen[cs]e", "zlib libpng licen[cs]e"), ()),
    ("isc", ("isc licen[cs]e", "permission to use copy modify and(?: or)? distribute this software for any purpose with or "
             "without fee is hereby granted"), ()),
    ("x11", ("x11 licen[cs]e", "mit x11"), ()),
    ("mit", ("mit licen[cs]e", "expat licen[cs]e",
             "permission is hereby granted free of charge to any person obtaining a copy"), ()),
    ("bsd-2-clause", ("(?:2|two) clause bsd(?: licen[cs]e)?", "simplified bsd licen[cs]e", "bsd 2 clause"), ()),
    ("bsd-3-clause", ("(?:3|three) clause bsd(?: licen[cs]e)?", "new bsd licen[cs]e", "bsd 3 clause"), ()),
    ("bsd-4-clause", ("(?:4|four) clause bsd(?: licen[cs]e)?", "original bsd licen[cs]e", "bsd 4 clause"), ()),
    ("bsd", ("bsd licen[cs]e", "redistribution and use in source and binary forms"), ()),
    ("public-domain", ("in the public domain", "into the public domain", "dedicated to the public domain"), ()),
    ("proprietary", ("proprietary and confidential", "unauthorized copying of this file"), ()),
    ("copyright", ("copyright (?:c )?(?:19|20)[0-9]{2}", "© (?:19|20)[0-9]{2}"), ()),
    ("spdx", ("spdx licen[cs]e identifier",), ()),
    ("no-warranty", ("without warranty of any kind", "provided as is"), ()),
)
#: Ways in which a version follows a name, and what may follow the version.
VERSION_FORMS = ("{n} {v}", "{n} v{v}", "{n} version {v}")
#: An abbreviation may have the version glued to it.
GLUED_FORMS = ("{n}{v}", "{n}v{v}")
#: As in the notices at the head of source files.
NOTICE_FORM = "{n}(?: as published by the free software foundation)?(?: either)? version {v} of the licen[cs]e"
GRANTS = (("", ""), (" only", "-only"), (" or (?:at your option )?(?:any )?later(?: version)?", "-or-later"))
#: Names that mean a license with a version only, or in a list of licenses ("the MIT and BSD licenses").
WITH_VERSION = {"apache": ("apache",)}
IN_LISTS = ("mit", "bsd", "isc", "apache", "zlib")
LIST_FORMS = ("{n}(?= and [a-z0-9]+ licen[cs]es)", "{n}(?= or [a-z0-9]+ licen[cs]e)", "{n}(?= and [a-z0-9]+ licen[cs]e )")
#: Identifiers of SPDX expressions that differ from label and version.
SPDX_IDS = {"unlicense": "unlicense", "ofl": "ofl 1 1", "psf": "psf 2 0", "bsl": "bsl 1 0", "artistic": "artistic 2 0"}


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: str
    priority: int  # lower goes first


def signatures() -> list[Signature]:
    """Rules in order of priority: a version with its grant, a version, the bare name; the
    families keep the order of the table, longer names first."""
    out = []
    for rank, (label, names, versions) in enumerate(FAMILIES):
        gnu = label.endswith("gpl")
        for k, name in enumerate((*names, *WITH_VERSION.get(label, ()))):
            forms = (*VERSION_FORMS, *(GLUED_FORMS if re.fullmatch("[a-z]+", name) else ()), *((NOTICE_FORM,) if gnu else ()))
            name = re.sub(r"licen\[cs\]e$", "licen[cs]es?", name)
            for v in sorted(versions, key=len, reverse=True):
                # a version ends in 0 whether or not that is written
                written = re.sub("(?<=[0-9]) 0$", "", v)
                written += "" if " " in written else "(?: 0)?"
                for form in forms:
                    for grant, suffix in GRANTS if gnu else GRANTS[:1]:
                        out.append(Signature(f"{label}-{v.replace(' ', '.')}{suffix}", form.format(n=name, v=written) + grant,
                                             1000 * (0 if suffix else 1) + 10 * rank + k))
            if k < len(names):
                out.append(Signature(label, name, 2000 + 10 * rank + k))
        if label in IN_LISTS:
            out += [Signature(label, form.format(n=label), 2000 + 10 * rank + 9) for form in LIST_FORMS]
    return sorted(out, key=lambda s: s.priority)


def spdx_ids() -> list[tuple[str, str]]:
    """(label, expression) of the identifiers that may follow "spdx license identifier", longest first."""
    out = [(s.label, s.pattern) for s in signatures() if s.priority < 2000 and s.pattern.startswith(s.label.split("-")[0])]
    out += [(label, SPDX_IDS.get(label, label.replace("-", " "))) for label, _, _ in FAMILIES if label not in ("spdx", "copyright", "no-warranty", "proprietary")]
    return sorted(out, key=lambda x: (-len(x[1]), x[1]))


_KEEP = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
              for c in range(256))


def words_text(text: str | None) -> tuple[bytes, int]:
    """The words of a text, each with one blank around it, and their number."""
    words = (text or "").encode().translate(_KEEP).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" ", len(words)


def required_word(pattern: str) -> str:
    """The prefilter keyword of a rule: the longest piece of a word that every match of it contains."""
    plain = re.sub(r"\(\?[:=][^)]*\)\??|\[[^\]]*\](?:\{\d+\}|\+)?|.\?", "\0", pattern)
    return max(re.split("[ \0]", plain), key=len, default="")


@lru_cache(maxsize=1)
def compiled():
    """Rules grouped by keyword as (order, label, expression), and the base phrases."""
    rules: dict[bytes, list] = {}
    for order, s in enumerate(signatures()):
        rules.setdefault(required_word(s.pattern).encode(), []).append(
            (order, s.label, re.compile(b"(?<= )(?:" + s.pattern.encode() + b")(?= )")))
    return rules, [(f" {phrase} ".encode(), label) for phrase, label in BASE]


@lru_cache(maxsize=1)
def spdx_compiled():
    """Expression of the words before an SPDX expression, of one identifier, and of what joins two."""
    ids = spdx_ids()
    one = b"|".join(b"(%s)" % pattern.encode() for _, pattern in ids)
    return re.compile(b"(?<= )spdx licen[cs]e identifier "), re.compile(b"(?:%s)(?= )" % one), re.compile(b" (?:or|and) "), [x for x, _ in ids]


def spdx_places(norm: bytes) -> list[tuple[int, int, str]]:
    """(start, end, label) of the identifiers in SPDX expressions."""
    out = []
    if b" spdx " in norm:
        head, one, join, labels = spdx_compiled()
        for m in head.finditer(norm):
            at = m.end()
            while found := one.match(norm, at):
                out.append((at, found.end(), labels[found.lastindex - 1]))
                if not (more := join.match(norm, found.end())):
                    break
                at = more.end()
    return out


def suppress(hits: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Detections (order, start, end, label) that lie within none kept before them.  A Fenwick
    tree over the starts holds the furthest end of what is kept, so this takes n log n."""
    rank = {a: i + 1 for i, a in enumerate(sorted({h[1] for h in hits}))}
    furthest = [-1] * (len(rank) + 1)
    kept = []
    for _, a, b, label in sorted(hits, key=lambda h: (h[0], h[1] - h[2], h[1])):
        i, reach = rank[a], -1
        while i:
            reach = max(reach, furthest[i])
            i &= i - 1
        if reach >= b:
            continue
        kept.append((a, b, label))
        i = rank[a]
        while i < len(furthest):
            furthest[i] = max(furthest[i], b)
            i += i & -i
    return sorted(kept)


def scan(text: str | None):
    """(n_words, base places, detections kept), places as (start, end, label) in words."""
    norm, n = words_text(text)
    rules, base = compiled()
    places, hits = [], []
    for phrase, label in base:
        at = norm.find(phrase)
        while at >= 0:
            places.append((at + 1, at + len(phrase) - 1, label))
            at = norm.find(phrase, at + 1)
    for keyword, group in rules.items():
        if keyword in norm:
            for order, label, expression in group:
                hits += [(order, m.start(), m.end(), label) for m in expression.finditer(norm)]
    hits += [(-1, *x) for x in spdx_places(norm)]
    kept = suppress(hits)
    number, last, word = {}, 0, -1  # byte offset -> word number, in one walk
    for o in sorted({x for p in (*places, *kept) for x in p[:2]}):
        word += norm.count(b" ", last, o)
        last, number[o] = o, word
    in_words = [[(number[a], number[b] + 1, label) for a, b, label in sorted(found)] for found in (places, kept)]
    return n, *in_words


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_words, base and detections (arrays of start, end, label; words
    from 0, end exclusive) of every document."""
    n = len(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__t"))
    prepare(docs.sparkSession)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def column(found):
        return pa.array([[{"start": a, "end": b, "label": x} for a, b, x in f] for f in found], spans)

    def run(batches):
        for b in batches:
            got = [scan(t) for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(n)], pa.array([g[0] for g in got], pa.int64()),
                 column([g[1] for g in got]), column([g[2] for g in got])],
                [*keep, "n_words", "base", "detections"])

    extra = StructType.fromDDL("n_words BIGINT, base ARRAY<STRUCT<start: BIGINT, end: BIGINT, label: STRING>>, "
                               "detections ARRAY<STRUCT<start: BIGINT, end: BIGINT, label: STRING>>")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:n], *extra.fields]))


def op9_license_scan(spark, sf_dir):
    d = scan_licenses(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    covered = ("aggregate(sort_array(concat(base, detections)), struct(0L AS e, 0L AS n), (a, d) -> struct(greatest(a.e, d.end) AS e, "
               "a.n + greatest(0L, d.end - greatest(a.e, d.start)) AS n), a -> a.n)")
    labels = F.array_sort(F.array_distinct(F.expr("transform(base, b -> b.label)")))
    every = F.array_sort(F.array_distinct(F.expr(
        "concat(transform(base, b -> b.label), transform(detections, d -> d.label))")))
    return d.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                    F.expr("array_min(transform(base, b -> b.start))").alias("first_word"),
                    F.expr("array_max(transform(base, b -> b.start))").alias("last_word"),
                    F.array_join(labels, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
                    F.expr(f"CASE WHEN n_words = 0 THEN 0D ELSE round({covered} / CAST(n_words AS DOUBLE), 6) END").alias("score"))


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES: dict[str, str] = {}
