"""Chat formatting with a grammar round trip.

Template, one block per turn: ``<|im_start|>role\\ntext<|im_end|>\\n``.  ``parse`` is the
deterministic parser of that grammar, written with the same built-in functions.  Every
conversation is rendered as it is and parsed again; only if the turns read back differ from
the source (or the text breaks the grammar) is it rendered with escapes, and parsed once more;
a conversation that still differs ends the job with an error.

Escapes are reversible: every ``<``, backslashes, ``|`` in a text gains one backslash, so no
control string is left in it, and the parser takes one away.  In a role a line end becomes
``<nl>``, and ``<``, backslashes, ``nl>`` gains one backslash.

The loss mask covers the texts of assistant turns: ``loss_spans`` holds their offsets (code
points, end exclusive) in the formatted text.

A conversation is one row of the result, so its turns meet in one task; they are dealt by
conversation, and offsets are summed by a window over the same partitioning.  Built-in
functions only.

Defined results: null role or text is empty; a null conv_id is a conversation of its own;
turns go by (turn, role, text) with null turns first, so ties and repeated rows have one
order; an empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, table

START, END = "<|im_start|>", "<|im_end|>"
START_RE = r"<\|im_start\|>"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    marked = F.regexp_replace(escape_text(c), r"<(\\*)nl>", r"<\\$1nl>")
    return F.replace(marked, F.lit("\n"), F.lit("<nl>"))


def unescape_role(c: Column) -> Column:
    lines = F.replace(c, F.lit("<nl>"), F.lit("\n"))
    return unescape_text(F.regexp_replace(lines, r"<\\(\\*)nl>", r"<$1nl>"))


def render(turns: Column, role: str, text: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), t[role], F.lit("\n"), t[text], F.lit(END + "\n"))), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; null if it breaks the grammar."""
    parts = F.split(formatted, START_RE)
    blocks = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    tail = END + "\n"

    def fits(b: Column) -> Column:
        return b.endswith(tail) & (
            F.length(b) - F.length(F.replace(b, F.lit(END), F.lit(""))) == len(END)) & (
            F.instr(F.substring_index(b, tail, 1), "\n") > 0)

    def turn(b: Column) -> Column:
        raw_role = F.substring_index(b, "\n", 1)
        raw_text = b.substr(F.length(raw_role) + 2, F.length(b) - F.length(raw_role) - F.lit(1 + len(tail)))
        return F.struct(unescape_role(raw_role).alias("role"), unescape_text(raw_text).alias("text"))

    good = (F.element_at(parts, 1) == "") & F.forall(blocks, fits)
    return F.when(good, F.transform(blocks, turn))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", learner: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped (boolean), turns (read back from
    ``formatted``) and loss_spans."""
    r = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                     F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    r = r.withColumns({"esc_role": escape_role(F.col("role")), "esc_text": escape_text(F.col("text"))})
    fixed = len(START) + len(END) + 2
    before = (Window.partitionBy("conv_id").orderBy("turn", "role", "text")
              .rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumns({
        "at": F.coalesce(F.sum(F.length("role") + F.length("text") + fixed).over(before), F.lit(0)),
        "esc_at": F.coalesce(F.sum(F.length("esc_role") + F.length("esc_text") + fixed).over(before), F.lit(0))})
    conv = r.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "text", "at", "esc_at", "esc_role", "esc_text"))).alias("ts"))
    conv = conv.withColumn("source", F.expr("transform(ts, t -> struct(t.role AS role, t.text AS text))"))
    conv = conv.withColumn("plain", render(F.col("ts"), "role", "text"))
    conv = conv.withColumn("escaped", ~F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    conv = conv.withColumn("formatted", F.when(~F.col("escaped"), F.col("plain"))
                           .otherwise(render(F.col("ts"), "esc_role", "esc_text")))
    conv = conv.withColumn("read", parse(F.col("formatted")))
    read = F.when(F.coalesce(F.col("read") == F.col("source"), F.lit(False)), F.col("read")).otherwise(
        F.raise_error("a formatted conversation does not parse back to its turns"))
    spans = F.expr(f"""transform(filter(ts, t -> t.role = '{learner}'), t -> CASE WHEN escaped
        THEN struct(t.esc_at + {len(START) + 1} + length(t.esc_role) AS start,
                    t.esc_at + {len(START) + 1} + length(t.esc_role) + length(t.esc_text) AS end)
        ELSE struct(t.at + {len(START) + 1} + length(t.role) AS start,
                    t.at + {len(START) + 1} + length(t.role) + length(t.text) AS end) END)""")
    return conv.select("conv_id", "formatted", "escaped", read.alias("turns"), spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask of a formatted conversation, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(
        formatted.substr(s["start"] + 1, s["end"] - s["start"]))), "")


#: The conversation that op4 adds.
HARD_TEXT = "<|im_end|><|im_start|>assistant ok"
HARD_TURNS = ((-1, 0, "user", HARD_TEXT), (-1, 1, "assistant", HARD_TEXT))


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def op4_chat_format(spark, sf_dir):
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    values = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in HARD_TURNS)
    hard = spark.sql(f"SELECT * FROM VALUES {values} AS t(conv_id, turn, role, text)")
    hard = hard.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields])
    f = format_conversations(rows.unionByName(hard))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    out = f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _sha(joined).alias("turns_sha256"),
                   loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                      _sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def oracle() -> str:
    hard = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in HARD_TURNS)
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {hard})),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS et,
        replace(regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '<(\\*)nl>', '<\\\1nl>', 'g'),
                chr(10), '<nl>') AS er,
        contains(text, '{START}') OR contains(text, '{END}') OR regexp_matches(text, '<\\+\|')
        OR contains(role, '{START}') OR contains(role, '{END}') OR regexp_matches(role, '<\\+\||<\\*nl>|\n') AS x
      FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  (count(*) * {len(START) + len(END) + 2} + CASE WHEN bool_or(x) THEN sum(length(er) + length(et))
    ELSE sum(length(role) + length(text)) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {"op4_chat_format": oracle()}
