import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(f(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("s, want", [("get_current_user", ["get", "current", "user"]), ("getCurrentUser", ["getcurrentuser", "get", "current", "user"]), ("", []), ("a.b", ["a", "b"])])
def test_code_tokens(spark, s, want):
    assert one(spark, s, X.code_tokens) == want


@pytest.mark.parametrize("s, want", [("", 0), ("abcd", 1), ("a" * 40, 10), ("a" * 400, 100), ("ab", 1)])
def test_token_len(spark, s, want):
    assert one(spark, s, X.token_len) == want


def test_compact(spark):
    assert one(spark, "a\n\n\n\nb\n   \nc\n", X.compact) == "a\n\nb\n\nc"


def test_abstention_and_sentences(spark):
    assert one(spark, "The sources do not contain it.", X.is_abstention) is True
    assert one(spark, "One. Two!\nThree", X.sentences) == ["One.", "Two!", "Three"]
    assert one(spark, "a [1] b [2] c [1]", X.citations) == [1, 2, 1]


@pytest.mark.parametrize("a, b, want", [("APIRouter.add_api_route", "add_api_route", True), ("a.foo", "b.foo", True), ("foo", "bar", False)])
def test_symbol_match(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(X.symbol_match("a", "b")).first()[0] is want


@pytest.mark.parametrize("q, kind", [("Trace how a request flows", "multihop"), ("Where is it?", "where"), ("How do I add it?", "howto"), ("What is it?", "lookup")])
def test_routes(spark, q, kind):
    assert one(spark, q, X.query_class) == kind


def test_trim_keeps_the_first_line_and_hits(spark):
    code = "def f():\n" + "\n".join(f"    filler line number {i}" for i in range(60)) + "\n    needle here\n" + "\n".join(f"    more {i}" for i in range(60))
    out = spark.createDataFrame([(code, "needle")], "c string, q string").select(X.trim_to_query("c", "q", 50).alias("x")).first()["x"]
    assert out.startswith("def f():\n    # ...\n") and "needle here" in out and "more 20" not in out
    same = spark.createDataFrame([(code, "")], "c string, q string").select(X.trim_to_query("c", "q", 50).alias("x")).first()["x"]
    assert same == code


def test_tolerant_json(spark):
    out = spark.createDataFrame([('{"a": 1}',), ('Sure! {"a": 2} ok',), ("none",)], "s string").select(F.try_variant_get(X.tolerant_json("s"), "$.a", "int").alias("x"))
    assert [r["x"] for r in out.collect()] == [1, 2, None]


def test_prefixes():
    assert X.prefixes("nomic-ai/CodeRankEmbed")[0].startswith("Represent this query") and X.prefixes("intfloat/e5-base") == ("query: ", "passage: ")
    assert X.prefixes("all-MiniLM-L6-v2") == ("", "") and X.max_seq_len("coderank") == 512 and X.max_seq_len("other") is None


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], ["a", "b"], ["b", "c"], [], [])], "v array<double>, a array<string>, b array<string>, c array<string>, d array<string>")
    r = df.select(X.l2_normalised("v").alias("n"), X.dot("v", "v").alias("d"), X.jaccard("a", "b").alias("j"), X.jaccard("c", "d").alias("z")).first()
    assert r["n"] == [0.6, 0.8] and r["d"] == 25 and abs(r["j"] - 1 / 3) < 1e-12 and r["z"] == 0
