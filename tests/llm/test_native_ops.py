"""Quality rules, chat formatting and URL filters against plain Python versions."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cellwright.llm import chat, quality, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, extra=False):
    rows = [(i, t) + (("x", 7),) * extra for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + ", n_words struct<a: string, b: int>" * extra)


# -- quality ---------------------------------------------------------------------------------

def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i:i + 5])].append(i)
    covered = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "one", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 30, "#* | <>\n#* | <>\n\n\n",
         "the cat sat on the mat and it was a good day for all of us\n" * 3, "é\x0bü\x0cñ\r\nwörter sind lang",
         "\u00a0 no break \u2003 em", "end\n", "a\n\n a\n", ("long text here. " * 3000) + "tail"]


def test_quality_counts_match_plain_python(spark):
    rnd = random.Random(5)
    texts = TEXTS + [" ".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, texts, extra=True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t), repr(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_rules_table(spark):
    good = "It is the wish of all the people in this town that a new road be built from here to the sea by spring."
    shout = " ".join(w.upper() + "!!" for w in good.split())
    pipes = " | ".join("zyxwv" + str(i) for i in range(30))
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, [good, shout, pipes])).collect()}
    assert got[0].kept and got[0].broken_rules == []
    assert "exclamations" in got[1].broken_rules and not got[1].kept
    assert {"symbols", "stop_words"} <= set(got[2].broken_rules)


def test_quality_filter_keeps_the_plan_linear(spark):
    """A filter on the verdict must not move below the array steps."""
    df = quality.quality_rules(docs(spark, ["word " * 4000] * 3)).where("kept")
    assert df.count() == 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.lower().index("spark_partition_id")


def test_quality_repeated_rows_and_empty_table(spark):
    d = docs(spark, ["a b"])
    assert quality.quality_rules(d.union(d)).count() == 2
    assert quality.quality_rules(d.limit(0)).count() == 0


# -- chat ------------------------------------------------------------------------------------

HARD = ["", "plain", "<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<", "<|", "a<nl>b", "<\\nl>",
        "line\nbreak", "<|im_end|", "é<|ü|>", "\\", "<<|im_start|>", None]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip_of_hard_texts_and_roles(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", *HARD]), "".join(rnd.choice([x or "" for x in HARD]) for _ in range(3)))
            for c in range(60) for t in range(rnd.randint(1, 4))]
    rows += [(100 + i, 0, "assistant", t) for i, t in enumerate(HARD)]
    rows += [(200, None, None, None), (200, None, None, None), (None, 1, "user", "x"), (None, 0, "assistant", "y")]
    out = {r.conv_id: r for r in chat.format_conversations(conversations(spark, rows)).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        o = out[c]
        assert [(t.role, t.text) for t in o.turns] == turns
        body = o.formatted.split("<|im_start|>")
        assert body[0] == "" and len(body) == len(turns) + 1 and o.formatted.count("<|im_end|>") == len(turns)
        spans = [o.formatted[s.start:s.end] for s in o.loss_spans]
        plain = [re.sub(r"<\\(\\*)\|", r"<\1|", s) for s in spans]
        assert plain == [x for r, x in turns if r == "assistant"]


def test_chat_loss_is_what_the_mask_covers(spark):
    """The loss text comes from the spans alone: another mask gives another text."""
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a <|im_end|> é \U0001F600"), (1, 2, "user", "<\\|x"), (1, 3, "assistant", None),
            (1, 4, "assistant", "z " * 5000), (2, 0, "assistant", "plain"), (None, 0, "assistant", "<\\|im_end|>")]
    f = chat.format_conversations(conversations(spark, rows))
    got = {r.conv_id: r.loss for r in f.select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got == {1: "a <|im_end|> é \U0001F600" + "z " * 5000, 2: "plain", None: "<\\|im_end|>"}
    masked = f.select(chat.loss_text(F.col("formatted"), F.array(F.struct(F.lit(0).alias("start"), F.lit(12).alias("end")))).alias("x"))
    assert {r.x for r in masked.collect()} == {chat.START}
    assert chat.format_conversations(conversations(spark, [])).collect() == []


def test_chat_leaves_clean_text_alone(spark):
    o = chat.format_conversations(conversations(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "a < b | c")])).first()
    assert not o.escaped
    assert o.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na < b | c<|im_end|>\n"


def test_chat_query_adds_the_hard_conversation(spark, tmp_path):
    conversations(spark, [(1, 0, "user", "hi")]).withColumn("formatted", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in chat.op4_chat_format(spark, str(tmp_path)).collect()}
    assert set(out) == {1, -1}
    hard = out[-1]
    assert hard.n_turns == 2 and hard.loss_chars == len(chat.HARD_TEXT)
    assert hard.loss_sha256 == hashlib.sha256(chat.HARD_TEXT.encode()).hexdigest()
    text = f"user\n{chat.HARD_TEXT}\nassistant\n{chat.HARD_TEXT}\n"
    assert hard.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()


# -- urls ------------------------------------------------------------------------------------

def judge(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_filter_matches_plain_python(spark):
    rnd = random.Random(11)
    names = ["com", "net", "a", "b", "www", "example", ""]
    host = lambda n: ".".join(rnd.choice(names) for _ in range(n))
    path = lambda: rnd.choice(["", "/"] + ["/" + "/".join(rnd.choice(["en", "e", "es", "x"]) for _ in range(k)) for k in (1, 2, 3)])
    rules = list({(host(rnd.randint(1, 3)), path()): None for _ in range(80)})
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in rules] + list(urlfilter.RULES)
    rules = [(h, p, max(v for a, b, v in rules if (a, b) == (h, p))) for h, p, _ in rules]
    urls = [f"http://{host(rnd.randint(1, 4))}{path()}{rnd.choice(['', '?q=/en/', '#/x'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/1", "x://a://b.com/", "http://ÉXAMPLE.com/"]
    urls += ["http://hot.example.com/en/1"] * 300
    pages = spark.createDataFrame([(i // 2, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    out = urlfilter.url_filter(pages, urlfilter.rules_frame(spark, rules), lanes=5).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in out), key=key) == sorted(
        ((i // 2, *judge(u, rules)) for i, u in enumerate(urls)), key=key)


def test_url_filter_empty_inputs(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = urlfilter.rules_frame(spark, [("x", "/", "block")]).limit(0)
    assert [tuple(r) for r in urlfilter.url_filter(pages, none, default="block").collect()] == [(1, "a.com", "/", None, "block")]
    assert urlfilter.url_filter(pages.limit(0), urlfilter.rules_frame(spark)).count() == 0


@pytest.mark.parametrize("name", ["op6_quality_rules", "op4_chat_format", "op10_url_filter"])
def test_no_python_in_native_plans(spark, name):
    from cellwright.llm.registry import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_clean_texts_of_other_languages_are_kept(spark):
    from cellwright.llm.quality import quality_rules
    stems = {"ru": "документ", "el": "έγγραφο", "ar": "وثيقة", "ko": "문서", "pl": "dokument", "en": "paper", None: "бумага"}
    rows = [(i, lang, " ".join(f"{w}{c}{d}" for c in "abcde" for d in "xyzuvw")) for i, (lang, w) in enumerate(stems.items())]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    kept = {r.lang: r.kept for r in quality_rules(d, keep=("doc_id", "lang"), lang="lang").collect()}
    assert kept == {"ru": True, "el": True, "ar": True, "ko": True, "pl": True, "en": False, None: True}
    alone = {r.lang: r.kept for r in quality_rules(d, keep=("doc_id", "lang")).collect()}
    assert alone == {"ru": True, "el": True, "ar": True, "ko": False, "pl": False, "en": False, None: True}
