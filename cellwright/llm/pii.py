"""PII: surrogate generation with collision checks.

Entities (e-mail, IPv4 and IPv6 address, phone, card, US social security number, IBAN, secret,
titled name) are found by ordered patterns; of overlapping finds the earlier type of ``TYPES``
stays.  An entity's canonical form is what its spellings share (the national number of a phone,
the full form of an IPv6 address, lower case of an e-mail, a name without its titles), so all
mentions of one entity, in any document, get one surrogate.  A titled surname belongs to the
full name in its document that ends with it, if there is just one.

The surrogate of a canonical form comes from a keyed hash of (type, form, attempt): digits
become digits, letters become letters of the same script, punctuation stays; a card that
passes the Luhn check gets one that passes, octets stay octets, a name has the gender of its
titles in the corpus, if they tell one.  At each mention it is laid out in that mention's format (grouping and case).

Collision checks run over the distinct entities of the corpus: if two entities of a type have
one surrogate, all but the least take the next attempt, and so does every surrogate that is
itself an entity of the corpus; repeated until none is left.  From attempt ``WIDEN`` on a
surrogate grows by a character, so the search ends even where a format has too few values.

The rounds touch distinct entities only.  Texts without a digit run, ``@``, two colons or title (a built-in
pattern) are passed on where they are read; the others meet their replacements in a join.  A
hot entity is a hot key of an ordinary join, which adaptive execution splits.

The key is a required argument of the operator.  The query and the pipeline read it from the
session setting ``spark.cellwright.pii.key``; only where that is unset they take ``TEST_KEY``, which
is in the source and so protects nothing: a production job sets its own.

Defined results: a null text stays null with no entities; repeated rows are each kept and get
equal results; empty tables work; other columns pass unchanged, and where one of them is named
``pii`` the list of entities is named ``pii_`` (or with as many more ``_`` as it takes).
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import materialise, pick, prepare, table, text_key

KEY_SETTING = "spark.cellwright.pii.key"
TEST_KEY = b"cellwright surrogate key"
WIDEN, MAX_ATTEMPTS = 16, 64

#: Titles and the gender they tell.
TITLES = {"mr": "m", "mister": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "господин": "m",
          "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "madame": "f", "mademoiselle": "f",
          "señora": "f", "señorita": "f", "госпожа": "f", "dr": "n", "prof": "n"}
_TITLE = "|".join(sorted((f(t) for t in TITLES for f in (str.capitalize, str.upper)), key=len, reverse=True))
_NAME = r"[^\W\d_a-z][^\W\d_]+(?:[-'][^\W\d_]+)*"
#: Types in order of precedence; the entity is group 1.
TYPES = (
    # Keys and tokens that are known by their form; of a PEM block what is between its two lines.
    ("secret", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----\s*+([^-\s][^-]*[^-\s])\s*-----END")),
    ("secret", re.compile(r"(?<![\w\-])(gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}|sk-[A-Za-z0-9_\-]{20,}"
                          r"|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}"
                          r"|eyJ[A-Za-z0-9_\-]{5,}\.eyJ[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,})(?!\w)")),
    ("secret", re.compile(r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)"
                          r"([A-Za-z0-9+/_\-.]{8,})")),
    ("email", re.compile(r"(?<!\w)(\w[\w.!#$%&'*+\-^`{|}~]{0,63}@(?:[^\W_](?:[^\W_]|-){0,62}\.)+"
                         r"(?:(?:(?i:xn--)[A-Za-z0-9\-]{2,59}|[A-Za-z]{2,24})(?![A-Za-z0-9])|[^\W\d_A-Za-z]{2,24}))")),
    ("iban", re.compile(r"(?<!\w)([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)")),
    # With a label ("ip:") before it, if any; ``ipv6_span`` takes the address out.
    ("ipv6", re.compile(r"(?<![\w:])(\w{0,16}+(?::[0-9A-Fa-f]{0,4}){2,}+(?:(?:\.\d{1,3}){3})?)(?!\w|\.\d)")),
    ("ipv4", re.compile(r"(?<![\w.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w|\.\d)")),
    ("card", re.compile(r"(?<![\w+])(\d{13,19}|\d{4}([ \-])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ \-])\d{6}\3\d{5})(?!\w)")),
    ("ssn", re.compile(r"(?<![\w\-])(\d{3}-\d{2}-\d{4})(?![\w\-])")),
    ("phone", re.compile(r"(?<![\w+])((?:\+?1[ .\-]?)?\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?:\+?1[ .\-])?\d{3}[.\-]\d{3}[.\-]\d{4}"
                         r"|(?:\+|(?<!\d[.,\-])00(?=[1-9]))\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}"
                         # grouped by blanks; area codes with a trunk zero, in brackets or not
                         r"|(?<!\d[.,\-])(?:(?:1 )?\d{3} \d{3} \d{4}|0\d(?:([ .\-])\d{2})(?:\2\d{2}){3}"
                         r"|(?:0\d{1,4}[ /\-]|\(0\d{1,4}\) ?)(?:\d{3,4}[ \-]\d{3,4}|\d{6,8})))(?!\w)")),
    # Ten digits in a row are a phone number behind a word that says so.
    ("phone", re.compile(r"(?i:\b(?:tel|phone|telephone|mobile|cell|fax|call)\b[ .:#]{1,3})([2-9]\d{9})(?!\w)")),
    ("secret", re.compile(r"(?<!\w)((?=[0-9A-Fa-f]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,}))(?!\w)")),
    ("name", re.compile(rf"\b((?:(?:{_TITLE})\.? )+{_NAME}(?: {_NAME})?)(?!\w)")),
)
#: What every entity contains, for Spark's own pattern matcher.
_FIRST = "".join(sorted({t[0].upper() for t in TITLES}))
HINT = (rf"\p{{Nd}}[ .:\-()]*\p{{Nd}}|@|:[0-9A-Fa-f]{{0,4}}:|(?<![A-Za-z])(?=[{_FIRST}])(?:{_TITLE})\.? "
        r"|(?<![\w\-])(?:gh[pousr]_|github_pat_|A[KS]IA|sk-|xox[abprs]-|AIza|eyJ)|PRIVATE KEY"
        r"|(?i)(token|secret|passw|pwd|key)[\w\s\p{Z}]*[=:]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: Country calling codes of one and two digits; all others have three.
CALLING = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
           "81 82 84 86 90 91 92 93 94 95 98".split())


def national(surface: str) -> str:
    """Digits of a phone number without country code and trunk zero."""
    digits = "".join(c for c in surface if c.isdigit())
    if surface.startswith("+") or re.match("00[1-9]", digits):
        digits = digits.lstrip("0") if not surface.startswith("+") else digits
        code = next((c for c in CALLING if digits.startswith(c)), digits[:3])
        rest = digits[len(code):]
    else:
        rest = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    return rest.lstrip("0") or digits


def ipv6_span(text: str) -> tuple[int, int] | None:
    """Where the address is in a find of the ipv6 pattern: all of it, or without a label before
    and a colon after it.  Loopback and all zeros are nobody's address; a short form without a
    digit is rather code (``a::b``)."""
    after = text.find(":") + 1
    for a, b in ((0, len(text)), (0, len(text) - 1), (after, len(text)), (after, len(text) - 1)):
        try:
            found = ipaddress.IPv6Address(text[a:b])
        except ValueError:
            continue
        plain = "::" in text[a:b] and not any(c.isdigit() for c in text[a:b])
        return None if plain or found.is_loopback or found.is_unspecified else (a, b)
    return None


def split_titles(surface: str) -> tuple[str, str]:
    """Titles, and the name after them."""
    at = 0
    while (m := re.compile(r"(\S+?)\.? ").match(surface, at)) and m[1].lower() in TITLES:
        at = m.end()
    return surface[:at], surface[at:]


def gender(surface: str) -> str | None:
    """What the titles of a name tell, if anything."""
    told = {TITLES[t.strip(".").lower()] for t in split_titles(surface)[0].split()} - {"n"}
    return told.pop() if len(told) == 1 else None


def link_surnames(found: list[tuple]) -> list[tuple]:
    """The (start, end, type, surface, form) of one document; a surname alone takes the form of
    the one full name that ends with it and whose titles do not tell another gender."""
    full: dict[str, dict[str, set]] = {}
    for x in found:
        if x[2] == "name" and " " in x[4]:
            full.setdefault(x[4].rpartition(" ")[2], {}).setdefault(x[4], set()).add(gender(x[3]))
    out = []
    for x in found:
        if x[2] == "name" and x[4] in full:
            g = gender(x[3])
            fits = [f for f, told in full[x[4]].items() if g is None or not told - {None} or g in told]
            x = (*x[:4], fits[0]) if len(fits) == 1 else x
        out.append(x)
    return out


def canonical(kind: str, surface: str) -> str:
    if kind == "phone":
        return national(surface)
    if kind == "ipv6":
        return ipaddress.IPv6Address(surface).exploded
    if kind in ("card", "ssn"):
        return "".join(c for c in surface if c.isdigit())
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "name":
        return " ".join(split_titles(surface)[1].lower().split())
    return surface if kind == "secret" else surface.lower()


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type), in order.  What one pattern has found is blanked out for the next,
    so no two overlap."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in TYPES:
        spans = [m.span(1) for m in pattern.finditer(text)]
        if kind == "ipv6":
            spans = [(a + x[0], a + x[1]) for a, b in spans if (x := ipv6_span(text[a:b]))]
        if spans:
            parts, at = [], 0
            for a, b in spans:
                parts += [text[at:a], "\0" * (b - a)]
                at = b
                found.append((a, b, kind))
            text = "".join([*parts, text[at:]])
    return sorted(found)


class Stream:
    """Keyed bytes: HMAC-SHA256 in counter mode."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int):
        self.seed, self.key, self.n, self.have = f"{kind}\0{form}\0{attempt}".encode(), key, 0, b""

    def below(self, n: int) -> int:
        if len(self.have) < 4:
            self.have += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.have = int.from_bytes(self.have[:4], "big"), self.have[4:]
        return x % n


#: Letters by script, vowels first.
LETTERS = {"LATIN": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "CYRILLIC": ("аеиоу", "бвгджзклмнпрстфх"),
           "GREEK": ("αεηιο", "βγδζθκλμνπρστφχ")}


def script_of(c: str) -> str:
    return next((s for s in LETTERS if unicodedata.name(c, "").startswith(s)), "")


def letter_like(c: str, r: Stream, vowel: bool | None = None) -> str:
    """A letter of the same script and case; of a script without a table, one of its
    neighbours in the code chart that is a letter of that case."""
    script = script_of(c)
    if script:
        vowels, others = LETTERS[script]
        pool = vowels + others if vowel is None else vowels if vowel else others
        x = pool[r.below(len(pool))]
        return x.upper() if c.isupper() else x
    block = ord(c) & ~0x3F
    pool = [chr(u) for u in range(block, block + 64) if unicodedata.category(chr(u)) == unicodedata.category(c)]
    return pool[r.below(len(pool))]


def session_key(spark) -> bytes:
    """The key of the session's setting, else ``TEST_KEY``."""
    return (spark.conf.get(KEY_SETTING, None) or TEST_KEY.decode()).encode()


def surrogate(kind: str, form: str, attempt: int, key: bytes) -> str:
    """The canonical form of the replacement of a canonical form."""
    r = Stream(key, kind, form, attempt)
    more = attempt - WIDEN + 1 if attempt >= WIDEN else 0
    if kind == "ipv4":
        return ".".join(str(r.below(256)) for _ in range(4)) + (f".{attempt}" if more else "")
    if kind == "name":
        title, *names = form.split(" ") if form.partition(" ")[0] in TITLES else ("", *form.split(" "))
        ends = {"m": {"LATIN": "n", "CYRILLIC": "в", "GREEK": "ς"}, "f": {"LATIN": "a", "CYRILLIC": "а", "GREEK": "α"}}
        out = []
        for i, n in enumerate(names):
            new = "".join(letter_like(c, r, k % 2 == 1) if c.isalpha() else c for k, c in enumerate(n + "a" * more))
            end = ends.get(TITLES.get(title, "n"), {}).get(script_of(n[-1]))
            out.append(new[:-1] + end if i == 0 and end and len(new) > 2 else new)
        return " ".join([title, *out] if title else out)
    if kind == "email":
        local, _, domain = form.rpartition("@")
        head, dot, top = domain.rpartition(".")
        return _like(local + "a" * more, r) + "@" + _like(head, r) + dot + top
    if kind == "iban":
        return form[:2] + _like(form[2:] + "0" * more, r)
    if kind == "ipv6":  # not below 1000, so that no mixed or short form of it means another
        return "2" + "".join(c if c == ":" else "0123456789abcdef"[r.below(16)] for c in form[1:]) + "0" * more
    if kind == "secret" and re.fullmatch(r"[0-9a-f:]+|[0-9A-F:]+", form):
        digits = "0123456789ABCDEF" if re.search("[A-F]", form) else "0123456789abcdef"
        return "".join(c if c == ":" else digits[r.below(16)] for c in form + "0" * more)
    new = _like(form + "0" * more, r)
    if kind == "phone":  # as a national number, without a zero before it
        new = str(2 + r.below(8)) + new[1:]
    if kind == "card" and luhn(form):
        new = next(new[:-1] + d for d in "0123456789" if luhn(new[:-1] + d))
    return new


def _like(text: str, r: Stream) -> str:
    return "".join(str(r.below(10)) if c.isdigit() else letter_like(c, r) if c.isalpha() else c for c in text)


def lay_out(kind: str, surface: str, new: str) -> str:
    """The replacement in the format of one mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        slots = [i for i, c in enumerate(surface) if c.isalnum()]
        if kind == "phone":  # country code and trunk zero stay
            slots = slots[len(slots) - len(national(surface)):]
        out = list(surface)
        for i, c in zip(slots, new):
            out[i] = c
        return "".join(out) + new[len(slots):]
    if kind == "name":
        title, rest = split_titles(surface)
        names = new.split(" ")[-len(rest.split()):]
        upper = rest.isupper()
        return title + " ".join(n.upper() if upper else "-".join(p.capitalize() for p in n.split("-")) for n in names)
    if kind == "ipv6" and len(new) == 39 and len(surface) < 39:
        new = str(ipaddress.IPv6Address(new))
    return new.upper() if surface.isupper() else new


def detect(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, key, start, end, type, surface, form, gender) of every mention."""
    rows = (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(text).alias("key"), F.col(f"`{text}`").alias("t"))
            .where(F.col("t").rlike(HINT)))

    def run(batches):
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for x in link_surnames([(a, e, kind, t[a:e], canonical(kind, t[a:e])) for a, e, kind in find_entities(t)]):
                    at.append(i)
                    out.append((*x, gender(x[3]) if x[2] == "name" else None))
            take = pa.array(at, pa.int64())
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                 *[pa.array(c, pa.string()) for c in cols[2:]]],
                ["doc_id", "key", "start", "end", "type", "surface", "form", "gender"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], *StructType.fromDDL(
        "start INT, end INT, type STRING, surface STRING, form STRING, gender STRING").fields]))


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, form, surrogate) of distinct (type, form) rows: no two entities of a type share a
    surrogate, and no surrogate is an entity.  ``gender``, if there, is that of the form where
    its rows agree."""

    @F.pandas_udf(StringType())
    def make(kind, form, told, attempt):
        titles = {"m": "mr ", "f": "mrs "}
        return pd.Series([surrogate(k, (t := titles.get(g, "") if k == "name" else "") + f, int(a), key).removeprefix(t)
                          for k, f, g, a in zip(kind, form, told, attempt)], dtype=object)

    def attempt_of(df: DataFrame) -> DataFrame:
        return df.withColumn("surrogate", make("type", "form", "gender", "attempt"))

    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(None).cast("string"))
    one = F.when(F.min("gender") == F.max("gender"), F.min("gender")).alias("gender")
    now = materialise(attempt_of(entities.groupBy("type", "form").agg(one).withColumn("attempt", F.lit(0))), "pii-map")
    for _ in range(MAX_ATTEMPTS):
        twice = (now.groupBy("type", "surrogate").agg(F.min("form").alias("first"), F.count("*").alias("n"))
                 .where("n > 1").select("type", "surrogate", "first"))
        real = now.select("type", F.col("form").alias("surrogate")).withColumn("real", F.lit(True))
        judged = (now.join(twice, ["type", "surrogate"], "left").join(real, ["type", "surrogate"], "left")
                  .withColumn("bad", F.coalesce(F.col("first") != F.col("form"), F.lit(False)) | F.col("real").isNotNull()))
        bad = materialise(judged.where("bad").select("type", "form", "gender", (F.col("attempt") + 1).alias("attempt")), "pii-bad")
        if bad.isEmpty():
            return now.select("type", "form", "surrogate")
        again = attempt_of(bad)
        now = materialise(now.join(bad.select("type", "form"), ["type", "form"], "left_anti")
                          .unionByName(again), "pii-map")
    raise RuntimeError("surrogates still collide")


def replace_pii(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with the text replaced, plus ``pii`` (array of start,
    end, type, surface, surrogate; offsets in the source text)."""
    spark = docs.sparkSession
    taken, found_as = {c.lower() for c in docs.columns}, "pii"
    while found_as in taken:
        found_as += "_"
    prepare(spark)
    mentions = materialise(detect(docs, text, doc_id), "pii-mentions")
    names = surrogates(mentions, key)

    @F.pandas_udf(StringType())
    def laid(kind, surface, new):
        return pd.Series([lay_out(k, s, n) for k, s, n in zip(kind, surface, new)], dtype=object)

    found = (mentions.join(names, ["type", "form"])
             .select("doc_id", "key", "start", "end", "type", "surface",
                     laid("type", "surface", "surrogate").alias("surrogate"))
             .groupBy("doc_id", "key")
             .agg(F.sort_array(F.collect_set(F.struct("start", "end", "type", "surface", "surrogate"))).alias("__pii"))
             .select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "__pii"))
    hinted = F.coalesce(F.col(f"`{text}`").rlike(HINT), F.lit(False))
    kind = found.schema["__pii"].dataType
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    plain = docs.where(~hinted).select(*others, F.col(f"`{text}`"), F.array().cast(kind).alias(found_as))
    # The new text: the stretches between the mentions, and the surrogates.
    t = f"`{text}`"
    rest = f"substring({t}, coalesce(element_at(__pii, -1).end, 0) + 1)"
    pieces = (f"concat(array_join(transform(__pii, (x, i) -> concat(substring({t}, "
              f"IF(i = 0, 1, __pii[greatest(i - 1, 0)].end + 1), x.start - IF(i = 0, 0, __pii[greatest(i - 1, 0)].end)), "
              f"x.surrogate)), ''), {rest})")
    joined = (docs.where(hinted).withColumn("__k2", text_key(text))
              .join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col("__d")) & (F.col("__k2") == F.col("__k")), "left"))
    changed = joined.select(
        *others, F.when(F.col("__pii").isNull(), F.col(t)).otherwise(F.expr(pieces)).alias(text),
        F.coalesce("__pii", F.array().cast(kind)).alias(found_as))
    return plain.unionByName(changed).select(*[F.col(f"`{c}`") for c in docs.columns], found_as)


def op8_pii_surrogates(spark, sf_dir):
    out = replace_pii(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), session_key(spark))
    return out.select("doc_id", F.size("pii").cast("long").alias("n_entities"),
                      F.array_join(F.array_sort(F.array_distinct(F.expr("transform(pii, p -> p.type)"))), ",").alias("types"),
                      "text")


QUERIES = {"op8_pii_surrogates": op8_pii_surrogates}
ORACLES: dict[str, str] = {}
