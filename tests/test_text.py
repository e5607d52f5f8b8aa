from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import vectors as V


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("string")


def test_token_estimate(spark):
    assert value(spark, X.token_estimate(lit("你好 hello wonderful!"))) == 2 + 2 + 3 + 1
    assert value(spark, X.token_estimate(lit(""))) == 0
    assert value(spark, X.token_estimate(lit(None))) == 0


def test_sentences(spark):
    assert value(spark, X.sentences(lit("One. Two v1.2 stays!  三。四？five\n\nsix"))) == ["One.", "Two v1.2 stays!", "三。", "四？", "five", "six"]
    assert value(spark, X.sentences(lit(None))) == []
    assert value(spark, X.sentences(lit("  \n "))) == []


def test_grams_and_terms(spark):
    assert value(spark, X.han_grams(lit("数据库 a 表"), 2)) == ["数据", "据库"]
    assert value(spark, X.query_terms(lit("Cache 数据库 cache"))) == ["cache", "数据库", "数据", "据库"]
    assert value(spark, X.lexical_fraction(F.array(lit("ab"), lit("zz")), lit("xABx"))) == 0.5
    assert value(spark, X.lexical_fraction(F.array().cast("array<string>"), lit("x"))) == 0


def test_word_bounds(spark):
    assert value(spark, X.word_bounded(lit("the cat sat"), lit("cat")))
    assert not value(spark, X.word_bounded(lit("concatenate"), lit("cat")))
    assert value(spark, X.word_bounded(lit("数据库"), lit("据库")))


def test_quality(spark):
    assert value(spark, X.quality_score(lit("plain text, 中文。"))) == 1
    assert value(spark, X.quality_score(lit(""))) == 0
    assert value(spark, X.is_garbled(lit("" * 50)))
    assert not value(spark, X.is_garbled(lit(None)))


def test_cleaning(spark):
    assert value(spark, X.strip_thinking(lit("<THINK>a\nb</think> answer"))) == "answer"
    assert value(spark, X.strip_tags(lit("<p>a &amp; <b>b</b></p>"))) == "a & b"
    assert value(spark, X.html_to_text(lit("<style>x{}</style><p>one</p><p>two</p>"))) == "one\n two"
    assert value(spark, X.redact_secrets(lit("api_key = abc, Bearer 1234567890 https://u:p@h/x"))) == "api_key=[REDACTED], Bearer [REDACTED] https://[REDACTED]@h/x"
    assert value(spark, X.squeeze_lines(lit("a\r\na\n\n b  c \nb c\na"))) == "a\nb c\na"
    assert value(spark, X.slug(lit("  A b/c: 报告!  "))) == "A-b-c-报告"
    assert value(spark, X.short_title(lit("x" * 40))) == "x" * 28 + "..."
    assert value(spark, X.head_and_tail(lit("a" * 50 + "b" * 50), 40, 10)) == "a" * 10 + "\n[...]\n" + "b" * 23


def test_urls(spark):
    assert value(spark, X.urls(lit("see https://a.example/x). and http://b.example/y, ok"))) == ["https://a.example/x", "http://b.example/y"]
    assert value(spark, X.canonical_url(lit("HTTPS://A.example/B/#c"))) == "https://a.example/b"
    assert value(spark, X.unwrap_url(lit("//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx&r=1"))) == "https://a.example/x"
    assert value(spark, X.unwrap_url(lit("javascript:x"))) is None
    assert value(spark, X.is_noise_url(lit("https://www.bing.com/x"))) and value(spark, X.is_noise_url(lit("https://a.example/p.png?x")))
    assert not value(spark, X.is_noise_url(lit("https://a.example/page")))


def test_citations_and_json(spark):
    assert value(spark, X.cited(lit("a [3] b [1][9][3]"), F.lit(5))) == [1, 3]
    assert value(spark, X.drop_false_citations(lit("a [0] b [2] c [7]"), F.lit(5))) == "a  b [2] c "
    assert value(spark, X.first_json(lit('text ```json\n{"a": 1}\n``` more'))) == '{"a": 1}'
    assert value(spark, X.first_json(lit("no json"))) is None
    assert value(spark, X.file_category(lit("a/Budget_3.xlsx"))) == "finance"
    assert value(spark, X.file_category(lit(None))) is None
    assert value(spark, X.natural_key(lit("a10"))) > value(spark, X.natural_key(lit("a9")))


def test_vectors(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert abs(value(spark, V.cosine(a, F.array(F.lit(1.0), F.lit(1.0)))) - 2**-0.5) < 1e-12
    assert value(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert value(spark, V.cosine(a, F.array(F.lit(1.0)))) is None
    assert value(spark, V.mean(F.array(a, F.array(F.lit(3.0), F.lit(2.0))))) == [2, 1]


def test_sensitive_merged_and_times(spark):
    from sparkloom.plans.metric_queries import SENSITIVE

    held = ["password: x", "a sk-abcdefghijklmnop", "11010119900101123X", "4111 1111 1111 1111", "OTP is 123456", "验证码：1234", "abc", "", None, "id 12345"]
    rows = spark.createDataFrame([(t, {"a": "1", "b": "2"} if i % 2 else None, {"b": "3"}) for i, t in enumerate(held)], "t string, base map<string,string>, new map<string,string>")
    got = rows.select("t", F.col("t").rlike(SENSITIVE).alias("s"), X.merged(F.col("base"), F.col("new")).alias("m")).collect()
    assert [r["s"] for r in got] == [True] * 6 + [False, False, None, False]
    assert [r["m"] for r in got[:2]] == [{"b": "3"}, {"a": "1", "b": "3"}]
    times = spark.sql("select timestamp'2024-01-02 03:04:05' as t union all select timestamp'2024-01-02 03:04:05.000120' union all select null").select(X.iso_time("t").alias("x")).collect()
    assert {r["x"] for r in times} == {"2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000120+00:00", None}


def test_title_mentions(spark, tmp_path):
    from sparkloom.plans.context_queries import title_mentions

    spark.createDataFrame([(1, "Ivory Gate Report", "x"), (2, "Ivory Gate", "x"), (3, "Standalone", None), (4, None, "x"), (5, "tiny", "x"), (6, "gate gate gate", "x"), (7, "云杉计划检索手册", "x"), (8, " - ", "x")], "doc_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = [("a", "see the Ivory-Gate report, please", 1), ("b", "ivory gateway standalone", 1), ("c", None, 1), ("d", "", 1), ("e", "x gate gate " * 3000 + "gate", 1), ("f", "云杉计划检索手册 ivory  gate", 1), ("a", "see the Ivory-Gate report, please", 1), (None, "ivory gate", 1)]
    spark.createDataFrame(chunks, "chunk_id string, text string, name int").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r["chunk_id"], r["name"]) for r in title_mentions(spark, str(tmp_path)).collect()}
    assert got == {("a", "ivory gate report"), ("a", "ivory gate"), ("b", "standalone"), ("e", "gate gate gate"), ("f", "云杉计划检索手册"), ("f", "ivory gate")}
