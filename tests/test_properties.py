"""Property tests: Spark expressions against plain-Python models of the reference rules."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwright.functions import quantiles as Q
from cellwright.functions.text import title_case, ustrip

# Unicode White_Space characters (what the reference's strip and Java's (?U)\s both use)
WHITE = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
         + "\u2028\u2029\u202f\u205f\u3000")
SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Zé1-'") + list(WHITE)), max_size=12), min_size=1,
                max_size=60))
def test_unicode_strip_matches_model(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(ustrip(F.col("s"))).collect()]
    assert got == [t.strip(WHITE) for t in texts]


@SETTINGS
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcXYZ éñüÉ'-1_.")), max_size=15), min_size=1,
                max_size=60))
def test_title_case_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(title_case(F.col("s"))).collect()]
    assert got == [t.title() for t in texts]


@SETTINGS
@given(st.lists(st.one_of(st.integers(-50, 50), st.floats(-1e6, 1e6, allow_nan=False, width=32)),
                min_size=1, max_size=400),
       st.integers(2, 60))
def test_kth_smallest_matches_sorted(spark, values, exact_limit):
    vals = [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    srt = sorted(vals)
    n = len(srt)
    ks = sorted({0, n - 1, n // 2, Q.nearest_rank(n, 0.25), Q.nearest_rank(n, 0.75), Q.floor_index(n, 0.9)})
    got = Q.kth_smallest(df, [Q.Request(str(k), "x", k, n) for k in ks], exact_limit=exact_limit, accuracy=50)
    assert [got[str(k)] for k in ks] == [srt[k] for k in ks]
