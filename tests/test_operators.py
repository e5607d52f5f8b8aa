import io
import random
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import vectors as V
from sparkloom.operators import blocks as B
from sparkloom.operators import retrieval as R
from sparkloom.operators import tables as O
from sparkloom import plans
from sparkloom.operators.ordered import with_neighbours
from sparkloom.sources import files


def test_neighbours_across_partitions(spark):
    rows = [("hot", i) for i in range(300)] + [("b", 1), ("c", 1), ("c", 2)]
    random.Random(1).shuffle(rows)
    out = with_neighbours(spark.createDataFrame(rows, "g string, i int"), ["g"], ["i"], ["i"]).collect()
    got = {(r["g"], r["i"]): (r["prev_i"], r["next_i"]) for r in out}
    assert len(got) == len(rows)
    for g, i in rows:
        assert got[g, i] == (i - 1 if (g, i - 1) in got else None, i + 1 if (g, i + 1) in got else None)


def test_streaks_across_partitions(spark):
    rng = random.Random(3)
    rows = [("hot", i, i % 100 < 60 or rng.random() < 0.5) for i in range(500)] + [("all", i, True) for i in range(100)] + [("none", 1, False), ("x", 1, None)]
    out = O.streaks(spark.createDataFrame(rows, "g string, i int, bad boolean"), "g", ["i"], F.col("bad"), 2).collect()
    want = []
    for g in ("hot", "all"):
        run = []
        for _, i, bad in sorted(r for r in rows if r[0] == g) + [(g, -1, False)]:
            if bad:
                run.append(i)
            else:
                if len(run) >= 2:
                    want.append((g, len(run), run[0], run[-1]))
                run = []
    assert sorted((r["g"], r["n"], r["first"]["i"], r["last"]["i"]) for r in out) == sorted(want)


def test_first_copies(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "x", 1), (None, "x", 1), (2, "z", None)], "id int, v string, at int")
    assert sorted((r["id"] or 0, r["v"]) for r in O.first_copies(df.withColumn("at", F.timestamp_seconds("at")), "id", "at").collect()) == [(0, "x"), (0, "x"), (1, "a"), (2, "z")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, title string, text string, source_type string")
    assert R.bm25(docs, R.query_set(docs)).count() == 0
    assert B.chunks(docs).count() == 0 and B.blocks(docs).count() == 0
    assert R.dense(spark.createDataFrame([], "id long, vector array<double>"), spark.createDataFrame([], "query_id long, vector array<double>")).count() == 0


def test_dense_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    x[5] = x[4]  # a tie
    x[9] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    queries = df.where("id % 50 = 0 and id < 300").withColumnRenamed("id", "query_id")
    got = R.dense(df, queries, 7).collect()
    for q in range(0, 200, 50):
        norms = np.linalg.norm(x, axis=1)
        s = x @ x[q] / np.where(norms > 0, norms, 1) / norms[q]
        want = [i for i in sorted(range(200), key=lambda i: (-round(s[i], 12), i)) if s[i] > 0][:7]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_dense_of_whole_numbers_brute_force(spark):
    """Cosines of whole numbers, whose dot products are taken in single precision, are exact: equal vectors tie by id; norms too large for it are summed as before."""
    for scale in (3, 3_000_000):
        x = np.random.default_rng(4).integers(-scale, scale + 1, (300, 12)).astype(float)
        x[7], x[201], x[9] = x[3], 2 * x[3], 0
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
        queries = df.where("id in (3, 9, 100, 150)").withColumnRenamed("id", "query_id")
        got = {}
        for r in R.dense(df, queries, 6, 0.08).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        for q in (3, 9, 100, 150):
            n = (x * x).sum(axis=1) * (x[q] @ x[q])
            s = np.maximum(x @ x[q], 0) / np.sqrt(np.where(n > 0, n, 1))
            want = [(i, s[i]) for i in sorted(range(300), key=lambda i: (-s[i], i)) if s[i] > 0.08][:6]
            assert [i for i, _ in got.get(q, [])] == [i for i, _ in want] and np.allclose([v for _, v in got.get(q, [])], [v for _, v in want], rtol=1e-14), (scale, q)


def test_texts_are_tokenized_for_results_only(spark, data):
    """Reranking and best sentences choose the texts of the results before they work on them."""
    docs = spark.createDataFrame([(0, "a", "alpha beta"), (1, "b", "alpha")], "doc_id long, title string, text string")
    found = spark.createDataFrame([(0, 1, 1.0, 1)], "query_id long, id long, score double, rank int")
    for out in (R.rerank(found, R.query_set(docs), docs), plans.QUERIES["best_sentences"](spark, data)):
        lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        semi = [i for i, line in enumerate(lines) if "LeftSemi" in line]
        assert semi and all("regexp" not in line and "split(" not in line for line in lines[semi[0] : semi[0] + 3])


def test_bm25_ranks_rare_terms_first(spark):
    docs = spark.createDataFrame([(0, None, "alpha beta"), (1, "alpha", "gamma gamma"), (2, None, "beta beta beta"), (3, None, None), (4, "x", ""), (5, None, "delta delta")], "doc_id long, title string, text string")
    out = R.bm25(docs, R.query_set(docs), 5).orderBy("rank").collect()
    assert out[0]["id"] == 0 and {r["id"] for r in out} == {0, 1, 2}


def test_bm25_against_all_pairs(spark):
    """Terms that are left out at first change nothing: every pair scored by the formula gives the same lists."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, rng.integers(1, 30), p=odds / odds.sum())) for _ in range(300)]
    texts[7] = texts[3]
    docs = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id long, title string, text string")
    got = {}
    for r in R.bm25(docs, R.query_set(docs, 10), 8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    tokens = [t.split() for t in texts]
    mean, n = np.mean([len(t) for t in tokens]), len(tokens)
    df = {w: sum(w in t for t in tokens) for w in words}
    for q in range(0, 300, 10):
        want = []
        for i, t in enumerate(tokens):
            s = 0.0
            for w in sorted(set(tokens[q])):
                tf = t.count(w)
                s += max(np.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) if tf else 0
            if s > 0:
                want.append((-round(s, 9), i))
        assert [(i, pytest.approx(-s, abs=1e-8)) for s, i in sorted(want)[:8]] == [(i, s) for _, i, s in sorted(got[q])]


def test_dense_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2] if i % 7 else None) for i, v in enumerate(rng.normal(size=(300, 6)))] + [(900, None, "a"), (901, [1.0], "b")], "id long, vector array<double>, label string")
    queries = rows.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    one = [key(R.dense(rows, queries, 5)), key(R.dense_per_group(rows, queries, "label", 3)), key(R.dense_in_group(rows, queries, "label", 3))]
    monkeypatch.setattr(R, "SLICE", 64)
    monkeypatch.setattr(R, "BLOCK", 7)
    many = [key(R.dense(rows, queries, 5)), key(R.dense_per_group(rows, queries, "label", 3)), key(R.dense_in_group(rows, queries, "label", 3))]
    strip = lambda x: [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in part] for part in x]
    assert strip(one) == strip(many)


def test_blocks_of_dense_search_shuffle_no_rows(spark):
    """Further blocks of queries read the rows again; vectors meet in no join, and what is stored are the best rows and the queries."""
    tables = Path(spark.conf.get("spark.checkpoint.dir"), "tables")
    rows = spark.range(500).selectExpr("id", "array(1D, id % 9, id % 7) as vector", "id % 3 as label")
    queries = rows.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    for how, of in (("all", None), ("own", "label"), ("each", "label")):
        there = set(tables.glob("*"))
        found = R.nearest(rows, queries, 4, 0.0, how, of, block=12)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "Join" not in plan and "Generate" not in plan
        assert found.count() == 50 * 4 * (3 if how == "each" else 1)
        made = [spark.read.parquet(str(t)) for t in set(tables.glob("*")) - there]
        assert sum(t.count() for t in made if "vector" in t.columns) == 50 and sum("score" in t.columns for t in made) == 5


def test_fusion_and_diversity(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    fused = R.fuse({"a": a, "b": b}).orderBy("rank").collect()
    assert [r["id"] for r in fused] == [11, 10, 12] and fused[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    found = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.89, 2), (1, 12, 0.5, 3)], "query_id long, id long, score double, rank int")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0])], "id long, vector array<double>")
    assert [r["id"] for r in R.diversify(found, vectors, 2, 0.5).orderBy("rank").collect()] == [10, 12]


def test_rank_metrics(spark):
    found = spark.createDataFrame([(1, 5, 1, False), (1, 6, 2, True), (2, 7, 1, True)], "query_id long, id long, rank int, hit boolean")
    gold = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "query_id long, gold long")
    out = {r["query_id"]: r for r in R.rank_metrics(found, gold, 5).collect()}
    assert out[1]["mrr"] == 0.5 and out[1]["precision"] == 0.5 and out[2]["ndcg"] == 1 and out[3]["recall"] == 0


def test_markdown_blocks():
    text = "# A\n\nintro\n\n## B\n| x | y |\n|---|---|\n- one\n- two\n\n```\n# no heading\n```\n# C\nlast"
    got = [(k, "/".join(p), t.split("\n")[0]) for k, p, t in B.markdown_blocks(text)]
    assert got == [("paragraph", "A", "intro"), ("table", "A/B", "| x | y |"), ("list", "A/B", "- one"), ("code", "A/B", "```"), ("paragraph", "C", "last")]


def test_markdown_runs():
    text = "- a\n- b\ntext\n\n| x | y |\nafter\n### deep\n## less\nz\n```\nopen | a | b\n\nstill"
    got = [(k, "/".join(p), t) for k, p, t in B.markdown_blocks(text)]
    assert got == [("paragraph", "", "- a\n- b\ntext"), ("table", "", "| x | y |"), ("paragraph", "", "after"), ("paragraph", "deep/less", "z"), ("code", "deep/less", "```\nopen | a | b\n\nstill")]


def test_no_chunk_above_the_limit(spark):
    table = "\n".join(f"| row {i} | value {i} | more of it {i} |" for i in range(400))
    code = "```\n" + "\n".join(f"x{i} = compute({i})" for i in range(500)) + "\n```"
    docs = [(1, f"# T\n\n{table}\n\nend", "md"), (2, code, "md"), (3, "word " * 6000, "txt"), (4, "字" * 3000, "pdf"), (5, "x" * 9000, "md"), (6, "Short. Text.", "md"), (7, None, "md"), (8, " ", "txt")]
    rows = B.chunks(spark.createDataFrame(docs, "doc_id long, text string, source_type string")).collect()
    assert max(B.size(r["text"]) for r in rows) <= B.Limits().most and {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6}
    for key, text, _ in docs[:6]:
        own = "".join("".join(r["text"].split()) for r in rows if r["doc_id"] == key)
        assert len(own) >= len("".join(text.replace("# T", "").split()))
    assert all("| row" not in r["text"] or r["text"].startswith("|") for r in rows if r["doc_id"] == 1)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab1 \n字,.", max_size=300), st.integers(1, 20))
def test_units(text, most):
    got = B.units(text, most)
    assert all(B.size(u) <= most for u in got) and "".join("".join(got).split()) == "".join(text.split())


def test_marker_blocks():
    got = B.marker_blocks("start\n\n[Page 2]\ntwo\n\nmore\n\n[Sheet: S]\n\nrow", False)
    assert got == [("paragraph", [], "start"), ("paragraph", ["page 2"], "two"), ("paragraph", ["page 2"], "more"), ("paragraph", ["sheet S"], "row")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 900), max_size=60), st.integers(0, 3))
def test_ranges_cover(tokens, overlap):
    limits = B.Limits(overlap=overlap)
    spans = B.merged(B.ranges(tokens, limits), tokens, limits)
    assert {i for a, b in spans for i in range(a, b)} == set(range(len(tokens)))
    assert all(sum(tokens[a:b]) <= limits.most or b - a == 1 for a, b in spans)
    assert all(x[0] <= y[0] and x[1] < y[1] for x, y in zip(spans, spans[1:]))


def test_topic_breaks():
    v = np.array([[1, 0], [1, 0], [0, 1], [0, 1]], float)
    assert B.topic_breaks(v, B.Limits(buffer=1)) == {2}


def test_windows_do_not_cross_headings(spark, data):
    chunks = B.chunks(spark.createDataFrame([(1, "# A\none. two.\n# B\nthree.", "md"), (2, None, "md"), (3, "", "txt")], "doc_id long, text string, source_type string")).collect()
    assert [(r["doc_id"], r["path"], r["text"]) for r in chunks] == [(1, ["A"], "one. two."), (1, ["B"], "three.")]


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("数据".encode("gb18030"))
    (tmp_path / "sub/b.md").write_text("# T\ntext")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(archive({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}))
    (tmp_path / "e.pptx").write_bytes(archive({f"ppt/slides/slide{n}.xml": f'<s xmlns:a="x"><a:p><a:r><a:t>s{n}</a:t></a:r></a:p></s>' for n in (10, 2)}))
    (tmp_path / "f.xlsx").write_bytes(archive({"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>'}))
    (tmp_path / "g.eml").write_bytes(b"Subject: Hi\nContent-Type: text/plain; charset=utf-8\n\nbody")
    (tmp_path / "h.docx").write_bytes(b"broken")
    (tmp_path / "i.html").write_text("<script>x</script><p>hello</p>")
    out = {r["path"].rsplit("/", 1)[1]: r for r in files.parse(files.scan(spark, str(tmp_path))).collect()}
    assert set(out) == {"a.txt", "b.md", "d.docx", "e.pptx", "f.xlsx", "g.eml", "h.docx", "i.html"}
    assert out["a.txt"]["text"] == "数据" and out["d.docx"]["text"] == "# Head\n\n| x | y |"
    assert out["e.pptx"]["text"] == "[Slide 1]\ns2\n\n[Slide 2]\ns10" and out["f.xlsx"]["text"] == "[Sheet 1]\nname | 7"
    assert out["g.eml"]["text"].startswith("Subject: Hi") and out["h.docx"]["text"] is None and out["h.docx"]["error"]
    assert out["i.html"]["text"] == "hello"
    scanned = files.scan(spark, str(tmp_path))
    assert files.new_files(scanned, scanned.where("source_type = 'md'")).count() == 7


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(tmp_path), "a int").collect()) == [1, 2]


def test_clashing_columns_are_ignored(spark):
    rows = [(i, f"t{i}", f"word{i} common", "md", i, "x") for i in range(5)] + [(7, None, None, None, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string, source_type string, id long, row string")
    assert R.bm25(docs, R.query_set(docs)).count() > 0
    assert B.blocks(docs).count() == 5


def test_related_memories_against_all_pairs(spark):
    from sparkloom.operators import memory as M

    random = np.random.default_rng(5)
    words = ["the", "plan", "for", "week", "tea", "oslo", "rain", "train", "gate", "lamp", "desk", "moss"]
    rows = []
    for i in range(120):
        own = [words[int(j)] for j in np.minimum(random.geometric(0.25, int(random.integers(0, 7))) - 1, 11)]
        rows.append((f"m{i:03}", [None, "fact", "task"][i % 3], None if i % 40 == 7 else " ".join(own), "active" if i % 11 else "deleted", i, "clash"))
    rows += rows[:5] + [("m500", "fact", "", "active", 1, "x"), (None, "fact", "the plan for", "active", 1, "x"), ("m501", "fact", "word " * 20000 + "the plan for", "active", 1, "x")]
    frame = spark.createDataFrame(rows, "memory_id string, memory_type string, content string, status string, updated_at long, words string")
    sets = {r[0]: (r[1], frozenset(r[2].split())) for r in rows if r[0] and r[2] is not None and r[3] == "active"}
    want = {}
    for a, (kind, own) in sets.items():
        same = [b for b, (k, o) in sets.items() if k == kind and o == own]
        want[a] = (min(same), sum(b != a and k == kind and len(own & o) >= 3 for b, (k, o) in sets.items()))
    got = M.related(frame).collect()
    assert {r["memory_id"]: (r["class_id"], r["links"]) for r in got} == want and len(got) == len(want)
    assert M.related(frame.limit(0)).collect() == []


def test_topic_conflicts_against_all_pairs(spark):
    from sparkloom.operators import memory as M

    random = np.random.default_rng(3)
    words = ["plan", "week", "oslo", "rain", "train", "gate", "lamp", "desk", "moss", "fern"]
    rows = []
    for i in range(150):
        own = [words[int(j)] for j in np.minimum(random.geometric(0.2, int(random.integers(0, 7))) - 1, 9)]
        tags = [None, [], ["topic:a"], ["topic:b", "x"], ["topic:a", "topic:b"]][int(random.integers(0, 5))] if i % 2 else None
        rows.append((f"m{i:03}", ["decision", "preference", "fact", None][min(3, int(random.integers(0, 5)))], None if i % 30 == 7 else " ".join(own), "active" if i % 9 else "pending", tags, None if i % 20 == 3 else i // 3, i, "clash"))
    rows += rows[:5] + [(None, "decision", "plan week", "active", None, 1, 1, "x"), ("m900", "decision", " ".join(f"word{i}" for i in range(3000)), "active", None, 5, 1, "x")]
    frame = spark.createDataFrame(rows, "memory_id string, memory_type string, content string, status string, tags array<string>, created_at long, updated_at long, terms string")
    items = {r[0]: (r[1], frozenset((r[2] or "").split()), frozenset(t for t in r[4] or () if t.startswith("topic:")), (-1 if r[5] is None else r[5], r[0])) for r in rows if r[0] and r[3] == "active" and r[1] in ("decision", "preference")}

    def one_topic(a, b):
        if a[2] and b[2]:
            return bool(a[2] & b[2])
        return len(a[1] & b[1]) / max(1, min(len(a[1]), len(b[1]))) >= 0.65

    want = {k: max((b[3] for b in items.values() if b[0] == a[0] and b[3] > a[3] and one_topic(a, b)), default=(0, None))[1] for k, a in items.items()}
    got = M.conflicts(frame).collect()
    assert {r["memory_id"]: r["superseded_by"] for r in got} == want and len(got) == len(want)
    assert M.conflicts(frame.limit(0)).collect() == []


def test_covering_results(spark):
    found = spark.createDataFrame([(1, 10, 0.9, 1, None, "a"), (1, 11, 0.8, 2, [2], "a"), (1, 12, 0.7, 3, [0, 2], "a"), (1, 13, 0.6, 4, [], "a"), (2, 10, 0.0, 1, None, "a")], "query_id long, id long, score double, rank int, claims array<int>, vector string")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 0.0]), (13, [0.0, 0.0])], "id long, vector array<double>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in R.cover(found, vectors, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 12, 1), (1, 11, 2), (1, 13, 3), (2, 10, 1)]
    assert R.cover(found.limit(0), vectors).collect() == []


def test_late_interaction(spark):
    docs = spark.createDataFrame([(1, "T", "red lamp red", 1), (2, None, None, 2), (3, None, "", 3), (4, None, "blue desk " * 3000, 4), (5, None, "red", 5)], "doc_id long, title string, text string, asked int")
    queries = spark.createDataFrame([(1, "red lamp"), (2, None)], "query_id long, text string")
    found = spark.createDataFrame([(q, d, 1.0, d) for q in (1, 2) for d in range(1, 6)], "query_id long, id long, score double, rank int")
    got = {(r["query_id"], r["id"]): r["score"] for r in R.late_interaction(found, queries, docs, 9).collect()}
    assert got[1, 1] == pytest.approx(1.0) and got[1, 5] == pytest.approx(0.5) and got[1, 2] == got[1, 3] == 0.0
    assert len(got) == 10 and all(got[2, d] == 0.0 for d in range(1, 6))


def test_late_interaction_searches_once(spark, data):
    plan = plans.QUERIES["late_interaction"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "MapInArrow" not in plan


def test_bm25_in_blocks_and_small_parts_keeps_ties(spark, monkeypatch):
    """Blocks of queries, parts of few rows and lookups of few pairs give what all pairs give; copies of a text rank by id."""
    words = [f"w{i}" for i in range(12)]
    texts_ = [" ".join(words[(i * j + i // 7) % 12] for j in range(1, 2 + i % 6)) for i in range(90)]
    docs = spark.createDataFrame([(i, texts_[i % 45] if i else None, None) for i in range(90)], "doc_id long, text string, title string")
    whole = sorted(map(tuple, R.bm25(docs, R.query_set(docs, 10), 90).collect()))
    assert len(whole) > 9 * 30
    monkeypatch.setattr(R, "CELLS", 64)
    monkeypatch.setattr(R, "PAIRS", 5)
    out = sorted(map(tuple, R.bm25(docs, R.query_set(docs, 10), 4, block=2).collect()))
    assert out == [r for r in whole if r[3] <= 4]
    by_query = {q: sorted((-s, i) for p, i, s, _ in whole if p == q) for q, *_ in whole}
    assert all([i for _, i in found] == [i for q, i, _, _ in sorted(whole, key=lambda r: r[3]) if q == p] for p, found in by_query.items())


def test_blocks_of_sparse_search_store_no_counts(spark):
    """Each further block of queries leaves its results on disk, not the counts of its terms in all rows."""
    tables = Path(spark.conf.get("spark.checkpoint.dir"), "tables")
    docs = spark.range(300).selectExpr("id as doc_id", "concat('alpha w', id % 9, ' v', id % 50) as text", "'' as title")
    there = set(tables.glob("*"))
    out = R.bm25(docs, R.query_set(docs, 10), 5, block=4)
    assert out.count() == 30 * 5 and out.select("query_id").distinct().count() == 30
    columns = [spark.read.parquet(str(t)).columns for t in set(tables.glob("*")) - there]
    assert sum("rank" in c for c in columns) == 8 and not any("tf" in c for c in columns)


def test_sparse_search_shuffles_no_pair_per_match(spark):
    """Every document matches every query; what meets in a shuffle are the best rows of the tasks."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('alpha beta gamma ', id % 50) as text", "'' as title")
    found = R.bm25(docs, R.query_set(docs), 5)
    assert found.count() == 30 * 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_hash_vectors_hash_each_word_once(spark):
    """Vectors are the sums of the buckets and signs of all words; null and wordless texts give zeros."""
    docs = spark.createDataFrame([(1, "One two, TWO three_4 十六 Σίσυφος"), (2, None), (3, "?!"), (4, "two " * 9)], "doc_id long, text string")
    got = {r["id"]: r["vector"] for r in R.hash_vectors(docs).collect()}
    for r in docs.select("doc_id", V.hash_buckets(F.coalesce("text", F.lit(""))).alias("b")).collect():
        want = np.zeros(384)
        for x in r["b"]:
            want[x["bucket"]] += x["sign"]
        assert got[r["doc_id"]] == want.tolist()
    assert not any(got[2] + got[3]) and sum(map(abs, got[4])) == 9


def test_equal_texts_have_equal_cosines():
    """Copies of a text tie to the last bit wherever they stand among the rows, so that their ids decide."""
    rng = np.random.default_rng(3)
    own, queries = rng.integers(-9, 10, (7, 384)).astype(float), rng.integers(-9, 10, (5, 384)).astype(float)
    rows = np.repeat(own, 300, axis=0)[rng.permutation(2100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2100)), pa.array(rows.tolist(), pa.list_(pa.float64())), pa.nulls(2100, pa.string())], names=["id", "vector", "group"])
    asked = R.Asked([(i, q.tolist(), None) for i, q in enumerate(queries)])
    (out,) = asked.best([batch], 2100, 0.0, "all", pa.string())
    for q in range(5):
        got = [(i, s) for p, i, s in zip(*(out.column(c).to_pylist() for c in ("query_id", "id", "score")), strict=True) if p == q]
        assert all(s == (x := int(rows[i] @ queries[q])) / float(int(rows[i] @ rows[i]) * int(queries[q] @ queries[q])) ** 0.5 and x > 0 for i, s in got)
        assert got == sorted(got, key=lambda r: (-r[1], r[0]))


def test_related_memories_meet_in_slices(spark, monkeypatch):
    """Slices of a few classes give the links of one; no join makes pairs of memories that share a common word."""
    from sparkloom.operators import memory as M

    words = ["the", "plan", "for", "week", "tea", "oslo", "rain"]
    rows = [(f"m{i:03}", ["fact", "task"][i % 2], " ".join(w for j, w in enumerate(words) if (i * 37 >> j) & 1), "active", i) for i in range(150)]
    frame = spark.createDataFrame(rows, "memory_id string, memory_type string, content string, status string, updated_at long")
    sets = {r[0]: (r[1], frozenset(r[2].split())) for r in rows}
    want = {a: sum(b != a and k == kind and len(own & o) >= 3 for b, (k, o) in sets.items()) for a, (kind, own) in sets.items()}
    monkeypatch.setattr(M, "SLICE", 9)
    out = M.related(frame)
    assert {r["memory_id"]: r["links"] for r in out.collect()} == want
    assert "array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()
