"""Exact order statistics (brute-force oracle) and sources / table inspection."""

import json
import os
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cellwright.functions import quantiles as Q
from cellwright.sources import io as IO

from conftest import SF001


@pytest.mark.parametrize("exact_limit", [10**9, 50])
def test_kth_smallest_matches_sorting(spark, exact_limit):
    rnd = random.Random(7)
    vals = [rnd.choice([rnd.random() * 100, float(rnd.randint(0, 5))]) for _ in range(3000)] + [None] * 20
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    clean = sorted(v for v in vals if v is not None)
    n = len(clean)
    ks = [0, 1, n // 4, Q.nearest_rank(n, 0.25), n // 2, Q.nearest_rank(n, 0.75), n - 2, n - 1]
    got = Q.kth_smallest(df, [Q.Request(str(k), "x", k, n) for k in ks], exact_limit=exact_limit, accuracy=200)
    assert [got[str(k)] for k in ks] == [clean[k] for k in ks]


def test_kth_smallest_heavy_ties(spark):
    vals = [1.0] * 500 + [2.0] * 3 + [3.0] * 700
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    n = len(vals)
    got = Q.kth_smallest(df, [Q.Request(str(k), "x", k, n) for k in (0, 499, 500, 502, 503, n - 1)],
                         exact_limit=10, accuracy=100)
    assert [got[str(k)] for k in (0, 499, 500, 502, 503, n - 1)] == [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]


@pytest.mark.parametrize("kind, make", [
    ("decimal(38,0)", lambda rnd: 10**37 + rnd.choice([7, rnd.randint(0, 10**30), rnd.randint(0, 50)])),
    ("decimal(38,10)", lambda rnd: Decimal(rnd.choice([1, 3, rnd.randint(-10**20, 10**20)])) / 8),
    ("decimal(12,2)", lambda rnd: Decimal(rnd.randint(-900, 900)) / 100),
    ("bigint", lambda rnd: rnd.choice([2**62 + 1, rnd.randint(2**62, 2**62 + 40), -5])),
    ("int", lambda rnd: rnd.randint(-3, 3)),
    ("float", lambda rnd: rnd.choice([float("nan"), float("inf"), 0.5, float(rnd.randint(0, 90))])),
])
def test_kth_smallest_by_sketches_of_every_type(spark, kind, make):
    rnd = random.Random(kind)
    vals = [make(rnd) for _ in range(1500)]
    n = len(vals)
    df = spark.createDataFrame([(str(v),) for v in vals] + [(None,)], "t string").selectExpr(f"CAST(t AS {kind}) AS x")
    want = sorted((r.x for r in df.where("x IS NOT NULL").collect()), key=lambda v: (v != v, v))
    ks = [0, 1, 2, n // 4, n // 2 - 1, n // 2, (3 * n) // 4, n - 2, n - 1]
    got = Q.kth_smallest(df.repartition(7), [Q.Request(str(k), "x", k, n) for k in ks], exact_limit=5, accuracy=8)
    assert [repr(got[str(k)]) for k in ks] == [repr(want[k]) for k in ks]


def test_kth_smallest_of_many_columns_goes_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(Q, "SKETCH_ITEMS", 900)
    df = spark.range(4000).selectExpr(*[f"(id * {2 * c + 1}) % 4000 AS c{c}" for c in range(9)], "id")
    reqs = [Q.Request(f"{c}|{k}", f"c{c}", k, 4000) for c in range(9) for k in (10, 2000, 3999)]
    got = Q.kth_smallest(df, reqs, exact_limit=100, extra={"top": F.max("id")})
    assert got.pop("top") == 3999
    assert got == {f"{c}|{k}": sorted((i * (2 * c + 1)) % 4000 for i in range(4000))[k] for c in range(9) for k in (10, 2000, 3999)}


def test_nearest_rank_index():
    assert [Q.nearest_rank(11, q) for q in (0.25, 0.75, 0.05, 0.95)] == [3, 8, 1, 10]
    assert Q.floor_index(10, 0.75) == 7 and Q.floor_index(4, 1.0) == 3


def test_format_detection():
    assert IO.detect_format("data/File.CSV") == "csv"
    assert IO.detect_format("x.json") == "json"
    assert IO.detect_format("x.parquet") == "parquet"
    assert IO.detect_format("x.txt") == "csv"
    assert IO.detect_format("x.bin", "json") == "json"
    with pytest.raises(IO.FormatError):
        IO.detect_format("x.xlsx")
    assert IO.output_key("d", "j", "txt") == "processed/d/j/output.csv"
    assert IO.output_key("d", "j", "weird") == "processed/d/j/output.parquet"


def test_csv_json_parquet_roundtrip(spark):
    df = spark.createDataFrame([("Alice", 25, "NYC"), ("Bob", None, None), ("Charlie", 35, "SF")],
                               "name string, age bigint, city string")
    base = tempfile.mkdtemp(prefix="cw-io-")
    for fmt in ("csv", "json", "parquet"):
        path = os.path.join(base, fmt)
        assert IO.write_table(df, path, fmt) == fmt
        back = IO.read_table(spark, path, fmt)
        got = sorted((r["name"], r["age"], r["city"]) for r in back.collect())
        assert got == [("Alice", 25, "NYC"), ("Bob", None, None), ("Charlie", 35, "SF")]
    assert IO.write_table(df, os.path.join(base, "other"), "xlsx") == "parquet"


def test_headerless_csv_and_separator(spark):
    path = tempfile.mkdtemp(prefix="cw-csv-")
    with open(os.path.join(path, "a.csv"), "w") as fh:
        fh.write("1;x\n2;y\n")
    df = IO.read_csv(spark, path, separator=";", has_header=False)
    assert df.columns == ["column_1", "column_2"]
    assert df.count() == 2


def test_large_csv_and_stats(spark):
    path = tempfile.mkdtemp(prefix="cw-csv-")
    with open(os.path.join(path, "big.csv"), "w") as fh:
        fh.write("id,name,value\n")
        for i in range(10_000):
            fh.write(f"{i},n{i},{'' if i % 100 == 0 else i * 2}\n")
    df = IO.read_csv(spark, path)
    st = {r["column_name"]: r for r in IO.table_stats(df).collect()}
    assert st["value"]["null_count"] == 100 and st["id"]["row_count"] == 10_000 and st["id"]["column_count"] == 3
    rep = {r["column_name"]: r["dtype"] for r in IO.schema_report(df).collect()}
    assert rep == {"id": "Int32", "name": "String", "value": "Int32"}


def test_sample_and_preview(spark):
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    s1 = IO.sample_rows(orders, 10, seed=3, key=["o_orderkey"])
    s2 = IO.sample_rows(orders, 10, seed=3, key=["o_orderkey"])
    assert s1.count() == 10 and sorted(s1.collect()) == sorted(s2.collect())
    assert IO.sample_rows(orders.limit(5), 10, seed=1).count() == 5
    pv = IO.preview(orders, 3, order_by=["o_orderkey"]).collect()
    assert len(pv) == 3 and "T" in pv[0]["o_orderdate"] and pv[0]["o_orderkey"] == 0


def test_kth_smallest_keeps_large_integers_exact(spark):
    base = 10**17 + 1
    df = spark.createDataFrame([(base + i,) for i in range(11)], "x bigint")
    got = Q.kth_smallest(df, [Q.Request("m", "x", 5, 11)])
    assert got["m"] == base + 5 and isinstance(got["m"], int)


def test_json_array_of_objects(spark):
    path = tempfile.mkdtemp(prefix="cw-json-")
    with open(os.path.join(path, "a.json"), "w") as fh:
        fh.write('[{"name": "Alice", "age": 25, "city": "NYC"},\n {"name": "Bob", "age": null, "city": "LA"}]')
    df = IO.read_table(spark, os.path.join(path, "a.json"))
    assert sorted((r["name"], r["age"]) for r in df.collect()) == [("Alice", 25), ("Bob", None)]


def test_sample_is_repeatable_whatever_the_partitions(spark):
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    small = sorted(IO.sample_rows(orders, 25, seed=11, key=["o_orderkey"]).collect())
    assert len(small) == 25
    assert sorted(IO.sample_rows(orders.repartition(9), 25, seed=11, key=["o_orderkey"]).collect()) == small


def test_csv_types_follow_the_whole_input(spark):
    path = tempfile.mkdtemp(prefix="cw-csv-") + "/t.csv"
    with open(path, "w") as fh:
        fh.write("k,v\n" + "".join(f"{i},{i if i < 11_900 else 'late'}\n" for i in range(12_000)))
    df = IO.read_csv(spark, path)
    assert df.where("v = 'late'").count() == 100 and df.where("v IS NULL").count() == 0
    with pytest.raises(Exception):  # a given type that does not fit fails the job, it never becomes null
        IO.read_csv(spark, path, schema="k INT, v INT").agg({"v": "sum"}).collect()


def test_csv_cells_with_line_breaks_quotes_and_blanks(spark):
    rows = [(1, 'a\nb'), (2, 'say "x", y'), (3, "  padded  "), (4, 'end"\n'), (5, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    path = tempfile.mkdtemp(prefix="cw-csv-") + "/t.csv"
    IO.write_table(df.coalesce(1), path, "csv")
    assert sorted(tuple(r) for r in IO.read_table(spark, path).collect()) == rows


def test_json_lines_in_several_files_lose_no_row(spark):
    df = spark.range(100).withColumnRenamed("id", "k").repartition(2)
    path = tempfile.mkdtemp(prefix="cw-json-") + "/t.json"
    IO.write_table(df, path, "json")
    assert IO.read_table(spark, path).count() == 100
    with pytest.raises(IO.FormatError):
        IO.read_json(spark, path, multiline=True)


def test_kth_smallest_with_nan_on_both_ways(spark):
    from cellwright.functions import quantiles as Q
    nan, inf = float("nan"), float("inf")
    vals = [float(i % 37) for i in range(400)] + [nan] * 300 + [inf, -inf]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(3)
    ks = [0, 1, 200, 400, 401, 402, 550, 701]
    want = sorted((v for v in vals if v == v)) + [nan] * 300
    for limit in (10_000, 20):
        got = Q.kth_smallest(df, [Q.Request(str(k), "x", k, len(vals)) for k in ks], exact_limit=limit)
        assert [repr(got[str(k)]) for k in ks] == [repr(want[k]) for k in ks]


def test_large_and_small_mappings_cast_alike(spark, monkeypatch):
    from cellwright.operators import transforms as TR
    df = spark.createDataFrame([(k,) for k in "abcdef"] + [(None,)], "x string")
    for mapping in ({"a": True, "b": 1e20, "c": "z", "d": 7, "e": None}, {"a": 1, "b": 2.5, "c": float("nan")},
                    {"a": True, "b": False}, {"a": 1, "b": 2}):
        out = []
        for most in (5000, 0):
            monkeypatch.setattr(TR, "MAP_LITERAL_MAX", most)
            got = TR.map_values(df, columns=["x"], mapping=mapping)[0]
            out.append((got.dtypes, sorted(repr(r[0]) for r in got.collect())))
        assert out[0] == out[1]


def test_json_array_files_follow_the_rows(spark, monkeypatch):
    from cellwright.plans import registry as R
    made = []
    path = R.scratch_path
    monkeypatch.setattr(R, "scratch_path", lambda *a: made.append(path(*a)) or made[-1])
    monkeypatch.setattr(R, "ARRAY_ROWS", 5, raising=False)
    got = R.a2_json_array(spark, "/root/testdata/sf0.001")
    want = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select(*R.CUSTOMER_TYPES)
    assert got.exceptAll(want.select(*[want[c].cast(t) for c, t in R.CUSTOMER_TYPES.items()])).isEmpty() and got.count() == want.count()
    assert spark.read.text(made[0]).select("part").distinct().count() > 16


def test_csv_round_trip_of_whole_texts(spark, tmp_path):
    from cellwright.plans import registry as R
    texts = [None, "x", 'long "q", cell\n' * 20_000, "y" * 300_000 + '"', '\n\n"",\n']
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.cell for r in R.a1_csv_whole_texts(spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else f'a "q", b\n{t}\n"z",' for i, t in enumerate(texts)}


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700")
    yield
    spark.conf.set(key, before)


def nasty_rows(n):
    rnd = random.Random(n)
    bits = ["plain", 'say "hi"', "line\nbreak", "a,b", "", None, "\n\n\n", '"', '""\n"', "é\u2028x", "x" * 50, "tail\\", "carriage\r\nreturn"]
    return [(i, rnd.choice(bits), " ".join(str(rnd.choice(bits)) for _ in range(rnd.choice([1, 3, 60 if i % 50 == 7 else 2])))) for i in range(n)]


def test_csv_records_across_splits(spark, small_splits):
    rows = nasty_rows(300)
    path = tempfile.mkdtemp(prefix="cw-csv-")
    for part, chunk in enumerate((rows[:250], rows[250:])):
        with open(os.path.join(path, f"f{part}.csv"), "w", newline="") as fh:
            fh.write("id,name,the text\n")
            for i, a, b in chunk:
                fh.write(f"{i}," + ("" if a is None else '"' + a.replace('"', '""') + '"') + ',"' + b.replace('"', '""') + '"' + "\r" * (i % 40 == 5) + "\n")
    df = IO.read_csv(spark, path, order_key=True)
    assert df.columns == ["id", "name", "the text", IO.ORDER_COL] and dict(df.dtypes)["id"] == "int"
    got = df.orderBy(IO.ORDER_COL).drop(IO.ORDER_COL).collect()
    assert [tuple(r) for r in got] == [(i, a or None, b or None) for i, a, b in rows]  # as Spark reads ""
    blocks = IO.csv_records(spark, path, '"').select("file", "block").distinct().count()
    assert blocks > 10  # many splits took part


def test_csv_across_lines_headerless_and_bad_rows(spark):
    path = tempfile.mkdtemp(prefix="cw-csv-")
    with open(os.path.join(path, "a.csv"), "w") as fh:
        fh.write('1;"x\ny"\n\n2;z\n')
    df = IO.read_csv(spark, path, separator=";", has_header=False)
    assert df.columns == ["column_1", "column_2"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x\ny"), (2, "z")]
    with open(os.path.join(path, "b.csv"), "w") as fh:
        fh.write('3;"p\nq";too many\n')
    with pytest.raises(Exception):
        IO.read_csv(spark, path, separator=";", has_header=False, schema="a INT, b STRING").collect()


def test_json_arrays_across_splits(spark, small_splits):
    rows = [{"id": i, "a": a, "b": b, "deep": {"k": [{"z": "}{"}, {"q": '\\"' * (i % 3)}]}} for i, a, b in nasty_rows(250)]
    path = tempfile.mkdtemp(prefix="cw-json-")
    with open(os.path.join(path, "one.json"), "w") as fh:  # one line
        json.dump(rows[:120], fh)
    with open(os.path.join(path, "two.json"), "w") as fh:  # many lines, text beyond ASCII as it is
        json.dump(rows[120:249], fh, indent=1, ensure_ascii=False)
    with open(os.path.join(path, "three.json"), "w") as fh:  # one document
        json.dump(rows[249], fh, indent=2)
    with open(os.path.join(path, "none.json"), "w") as fh:
        fh.write("[]\n")
    got = sorted((r.asDict(recursive=True) for r in IO.read_json(spark, path).collect()), key=lambda r: r["id"])
    want = [{**r, "deep": {"k": [{"z": "}{", "q": None}, {"z": None, "q": r["deep"]["k"][1]["q"]}]}} for r in rows]
    assert got == want
    assert IO.json_records(spark, os.path.join(path, "one.json")).select("block").distinct().count() > 10


def test_json_array_of_something_else_is_refused(spark):
    path = tempfile.mkdtemp(prefix="cw-json-")
    with open(os.path.join(path, "a.json"), "w") as fh:
        fh.write('[1, 2,\n {"a": 1}]')
    with pytest.raises(Exception, match="no object but"):
        IO.read_json(spark, path).collect()


def test_records_of_small_blocks(spark, tmp_path, monkeypatch):
    """Blocks hold a few lines, however large the split; records that cross them come back whole."""
    from cellwright.sources import records
    monkeypatch.setattr(records, "BLOCK_LINES", 4)
    rows = [(i, "\n".join(f'l{j} "q", {i}' for j in range(i % 13))) for i in range(60)]
    path = str(tmp_path / "small.csv")
    IO.write_table(spark.createDataFrame(rows, "i long, t string").coalesce(1), path, "csv")
    assert records.csv_records(spark, path, '"').select("block").distinct().count() > 40
    back = IO.read_csv(spark, path, schema="i long, t string")
    assert sorted((r.i, r.t or "") for r in back.collect()) == rows
    (tmp_path / "a.json").write_text("[" + ",\n".join(f'{{"a": {i}, "b": {{"c": "}}{i}"}}}}' for i in range(50)) + "]")
    back = IO.read_json(spark, str(tmp_path / "a.json"))
    assert sorted((r.a, r.b.c) for r in back.collect()) == [(i, f"}}{i}") for i in range(50)]
