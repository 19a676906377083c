"""Quality rules: a threshold table compiled into one projection.

``text_stats`` derives the counts of a text with built-in functions only; ``RULES`` is the
table of thresholds; ``compile_rules`` turns the table into one boolean array expression.
Nothing shuffles and no Python runs on rows: a document is judged from its own text alone,
so the plan is scan -> project at any size and no key can be hot.

Defined results: a null text counts as empty (all counts 0, base_failed true); repeated rows
are judged one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CHAR_RE, pick, table, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that",
    "the", "this", "to", "was", "with",
    "das", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "avec", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "ou", "par", "pas", "pour",
    "que", "qui", "sur", "un", "une",
    "como", "con", "del", "el", "es", "las", "lo", "los", "más", "no", "para", "por", "se", "su", "una", "y",
)
#: The languages of the list.
STOP_LANGS = ("en", "de", "fr", "es")
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Reject when ``1000 * numerator > limit * denominator`` (``above``) or ``<`` (``below``),
    for texts of at least ``min_words`` words; where ``only`` is given, for those it holds for."""
    name: str
    numerator: str
    denominator: str
    sense: str
    per_mille: int
    min_words: int = 0
    only: str | None = None


#: The threshold table.  Integer arithmetic, so that every engine decides alike.
RULES = (
    Rule("words_too_short", "word_chars", "n_words", "below", 2000),
    Rule("words_too_long", "word_chars", "n_words", "above", 15000),
    Rule("symbols", "n_symbols", "n_words", "above", 300),
    Rule("exclamations", "n_exclaims", "n_words", "above", 500),
    Rule("stop_words", "n_stop_words", "n_words", "below", 30, 20, "listed_language"),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", "above", 500, 20),
)


def _count_of(text: Column, chars: str) -> Column:
    """How often the given ASCII characters stand in a text: bytes that their removal saves."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def text_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
               lang: str | None = None) -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines (lines with a word), n_exclaims and n_stop_words (all long), and listed_language:
    whether column ``lang`` names a language of STOP_WORDS or, where it is null or not given,
    whether letters of other scripts do not prevail."""
    kept = [F.col(f"`{c}`") for c in keep]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(
        *kept,
        words_of(F.col(f"`{text}`")).alias("__w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR_RE)).alias("__l"),
        _count_of(t, SYMBOLS).alias("n_symbols"),
        _count_of(t, "!").alias("n_exclaims"),
        # Only texts that are not plain ASCII can have letters of other scripts.
        F.coalesce(*([F.split_part(F.lower(F.replace(F.col(f"`{lang}`"), F.lit("_"), F.lit("-"))), F.lit("-"), F.lit(1))
                      .isin(*STOP_LANGS)] if lang else []),
                   (F.octet_length(t) == F.length(t))
                   | (F.regexp_count(t, F.lit(r"[\p{L}&&[^\p{IsLatin}]]")) <= F.regexp_count(t, F.lit(r"\p{IsLatin}"))),
                   ).alias("listed_language"),
    )
    at = "xxhash64(" + ", ".join(f"__v[i + {k}]" for k in range(WINDOW)) + ")"
    hashed = base.withColumn("__v", F.expr("transform(__w, w -> xxhash64(w))")).withColumn("__h", F.expr(
        f"CASE WHEN size(__w) < {WINDOW} THEN CAST(array() AS ARRAY<BIGINT>) "
        f"ELSE transform(sequence(0, size(__w) - {WINDOW}), i -> {at}) END"))
    # Texts without a repeated window hash (nearly all) stop here; the others sort the windows
    # themselves, so a hash collision cannot change a count.
    sorted_ = hashed.withColumn("__s", F.expr(
        "CASE WHEN size(array_distinct(__h)) = size(__h) THEN CAST(array() AS ARRAY<STRUCT<x: STRING, i: INT>>) "
        f"ELSE sort_array(transform(sequence(0, size(__w) - {WINDOW}), "
        f"i -> struct(array_join(slice(__w, i + 1, {WINDOW}), ' ') AS x, i AS i))) END"))
    found = sorted_.withColumn("__p", F.expr(
        "sort_array(transform(filter(__s, (s, j) -> (j > 0 AND __s[greatest(j - 1, 0)].x = s.x) "
        "OR (j < size(__s) - 1 AND __s[least(j + 1, size(__s) - 1)].x = s.x)), s -> s.i))"))
    covered = (f"aggregate(__p, struct(0 AS e, 0L AS n), (a, p) -> struct(p + {WINDOW} AS e, "
               f"a.n + {WINDOW} - greatest(a.e - p, 0) AS n), a -> a.n)")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return found.select(
        *kept,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        # The partition number keeps this column where it is: a filter on the verdict that moved
        # below these steps would compute the arrays again for each of their elements.
        F.expr(f"IF(spark_partition_id() < 0, 0L, {covered})").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"), "n_exclaims",
        F.expr(f"CAST(size(filter(__w, w -> lower(w) IN ({stops}))) AS BIGINT)").alias("n_stop_words"),
        "listed_language",
    )


def compile_rules(rules=RULES) -> Column:
    """Names of the broken rules, as one array expression."""
    broken = []
    for r in rules:
        left = F.col(r.numerator) * 1000
        right = F.col(r.denominator) * r.per_mille
        hit = (left > right) if r.sense == "above" else (left < right)
        hit = hit & (F.col("n_words") >= r.min_words)
        broken.append(F.when(hit & F.col(r.only) if r.only else hit, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules=RULES,
                  lang: str | None = None) -> DataFrame:
    """One row per document: ``keep``, the counts, ``base_failed``, ``broken_rules`` and ``kept``."""
    stats = text_stats(docs, text, keep, lang)
    judged = stats.withColumns({"base_failed": base_failed(), "broken_rules": compile_rules(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def op6_quality_rules(spark, sf_dir):
    out = quality_rules(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules"))


def rules_sql(rules=RULES) -> str:
    parts = []
    for r in rules:
        sign = ">" if r.sense == "above" else "<"
        parts.append(f"CASE WHEN 1000 * {r.numerator} {sign} {r.per_mille} * {r.denominator} "
                     f"AND n_words >= {r.min_words} THEN '{r.name}' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    count = lambda chars: " + ".join(
        f"length(t) - length(replace(t, '{c}', ''))" for c in chars)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, x.word, x.i FROM (SELECT rid, unnest(list_transform(
        list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda v: v <> ''),
        lambda v, j: {{'word': v, 'i': j - 1}})) AS x FROM d)),
ws AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars,
        count(*) FILTER (lower(word) IN ({stops})) AS n_stop_words FROM w GROUP BY rid),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c, e, f) AS n FROM (
        SELECT rid, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c,
               lead(word, 3) OVER o AS e, lead(word, 4) OVER o AS f
        FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE f IS NOT NULL),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT rid, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM g WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM (
        SELECT rid, list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\\x20\\x09-\\x0D]')) AS ls FROM d)),
s AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        {count(SYMBOLS)} AS n_symbols, n_dup_lines, n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        {count('!')} AS n_exclaims, coalesce(n_stop_words, 0) AS n_stop_words
      FROM d LEFT JOIN ws USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
j AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
        {rules_sql()} AS broken_rules FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND broken_rules = '') AS kept, broken_rules FROM j"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": oracle()}
