from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import context as C
from sparkloom.operators import memory as M
from sparkloom.operators import web as W


def test_trimmed(spark):
    rows = spark.createDataFrame([("short text",), ("word " * 300,), ("数据" * 300,), ("",), (None,)], "t string")
    out = rows.select("t", C.trimmed("t", 50).alias("s"), X.token_estimate(C.trimmed("t", 50)).alias("n")).collect()
    assert out[0]["s"] == "short text" and out[3]["s"] == "" and out[4]["s"] is None
    assert all(r["n"] <= 50 for r in out) and out[1]["s"].endswith("...") and out[2]["n"] >= 48


def test_around(spark):
    text = "a" * 500 + "NEEDLE" + "b" * 500
    row = spark.createDataFrame([(text, "NEEDLE"), (text, "none"), ("x", "x")], "t string, p string").select(C.around("t", "p", 100).alias("s")).collect()
    assert "NEEDLE" in row[0]["s"] and len(row[0]["s"]) == 100 and row[1]["s"] == "a" * 100 and row[2]["s"] == "x"


def test_selection(spark):
    rows = [("r", "a", True, 5, 0.0, 0.0, 60), ("r", "b", False, 0, 0.9, 0.9, 30), ("r", "c", False, 0, 0.1, 0.1, 30), ("r", "d", False, 0, 0.5, 0.5, 200), ("s", "e", False, 0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "request string, packet_id string, required boolean, priority int, relevance double, recency double, tokens long")
    out = {r["packet_id"]: r["kept"] for r in C.select(df, 196).collect()}
    assert out == {"a": True, "b": True, "c": False, "d": False, "e": False}
    q = {r["request"]: r for r in C.quality(C.select(df, 196)).collect()}
    assert q["r"]["kept_tokens"] == 90 and q["r"]["lost"] == 0 and q["s"]["kept"] == 0


def test_selection_of_many(spark):
    """The same choice as over all packets in order, for a request of many packets of few and of many sizes."""
    rng = __import__("random").Random(7)
    rows = [(q, f"p{i:05d}", rng.random() < 0.01, rng.randint(0, 3), rng.random(), rng.random(), rng.choice([None, 0, *range(1, most)])) for q, most in (("a", 400), ("b", 9), ("c", 3)) for i in range(1500)]
    df = spark.createDataFrame(rows, "request string, packet_id string, required boolean, priority int, relevance double, recency double, tokens long")
    out = {(r["request"], r["packet_id"]): (r["kept"], r["used"]) for r in C.select(df, 400).collect()}
    assert len(out) == len(rows)
    for q in "abc":
        value = lambda r: float(r[3]) if r[2] else 0.7 * r[4] + 0.3 * r[5] + r[3] / 1000
        used, kept = 0, {}
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], -value(r), r[1])):
            kept[r[1]] = r[6] is not None and used + r[6] <= 304
            used += r[6] if kept[r[1]] else 0
        assert {p: v for (x, p), v in out.items() if x == q} == {p: (k, used) for p, k in kept.items()}


def test_old_messages_are_packets(spark, tmp_path):
    from sparkloom.plans import context_queries as Q

    at = __import__("datetime").datetime(2025, 1, 1)
    day = __import__("datetime").timedelta(minutes=1)
    rows = [("s", f"m{i:03d}", at + i * day, at, "user", "x" * 200 if i == 0 else "ok") for i in range(260)]
    spark.createDataFrame(rows, "session_id string, message_id string, created_at timestamp, ingested_at timestamp, role string, content string").write.parquet(f"{tmp_path}/session_messages.parquet")
    out = {r["packet_id"]: r["kept"] for r in Q.context_selection(spark, str(tmp_path)).collect()}
    assert len(out) == 260 and out["m000"] and out["m259"]
    assert Q.context_quality(spark, str(tmp_path)).first()["packets"] == 260


def test_web(spark):
    page = "<html><head><title> A &amp; B </title><style>x</style></head><body><nav>menu</nav><p>one <b>two</b></p><div>three</div></body></html>"
    row = spark.createDataFrame([(page,), (None,)], "h string").select(W.main_text("h").alias("m"), W.page_title("h").alias("t")).collect()
    assert row[0]["m"] == "A & B one two\nthree".replace("A & B ", "A & B\n") and row[0]["t"] == "A & B" and row[1]["m"] is None
    links = '<a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.example%2Fa">First</a><a href="https://x.example/A/">Again</a><a href="https://bing.com/y">Noise</a><a href="https://y.example/">Second</a>'
    out = W.results(spark.createDataFrame([(links,)], "h string"), "h").collect()
    assert [(r["place"], r["title"]) for r in out] == [(1, "First"), (2, "Second")]
    one = spark.range(1).select(W.charset(F.lit("text/html; charset=GBK"), F.lit("")).alias("a"), W.charset(F.lit(""), F.lit('<meta charset="latin-1">')).alias("b"), W.charset(F.lit(None).cast("string"), F.lit("")).alias("c")).first()
    assert tuple(one) == ("gbk", "latin-1", "utf-8")


def test_cache(spark):
    cache = spark.createDataFrame([("a", "old", 0), ("a", "new", 100), ("b", "x", 0)], "key string, value string, s long").withColumn("stored_at", F.timestamp_seconds("s"))
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    out = {r["key"]: r["value"] for r in W.cached(keys, cache, F.timestamp_seconds(F.lit(150)), 60).collect()}
    assert out == {"a": "new", "b": None, "c": None}
    assert W.cached(keys, cache, F.timestamp_seconds(F.lit(150)), 0).where("hit").count() == 0


def test_memory_search(spark):
    schema = "memory_id string, scope string, memory_type string, content string, confidence double, status string, tags array<string>, updated_at timestamp, expires_at timestamp"
    at = __import__("datetime").datetime(2025, 1, 1)
    rows = [("m1", "user", "fact", "the page parser keeps order", 0.9, "active", [], at, None), ("m2", "user", "fact", "nothing shared here", 0.9, "active", [], at, None), ("m3", "user", "fact", "page parser", 0.9, "active", ["completed"], at, None), ("m4", "user", "fact", None, 0.9, "active", [], at, None)]
    queries = spark.createDataFrame([(1, "page parser order"), (2, ""), (3, None)], "query_id long, q string")
    assert [(r["query_id"], r["id"]) for r in M.search(queries, "q", spark.createDataFrame(rows, schema)).collect()] == [(1, "m1")]
