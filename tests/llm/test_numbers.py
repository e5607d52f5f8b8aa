import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import packing as P
from sparkloom.llm import quantiles as Q
from sparkloom.llm import splitting as S


def exact(values, q):
    values = sorted(values)
    return values[max(1, math.ceil(q * len(values))) - 1]


@pytest.mark.parametrize("passes", [2, 4])
def test_percentiles_against_sorting(spark, passes):
    rng = random.Random(1)
    groups = {"a": [rng.lognormvariate(5, 3) for _ in range(500)], "b": [0.0, -0.0, -5.5, 1e300, -1e-300, 7.0, 7.0], None: [3.0], "ties": [2.5] * 50}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan"))]
    data = Q.keyed(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v")
    points = spark.createDataFrame([(0.01,), (0.5,), (0.9,), (0.999,), (1.0,)], "q double")
    out = Q.quantiles(data, ["g"], points, passes).collect()
    assert len(out) == 4 * 5
    for r in out:
        want = exact(groups[r["g"]], r["q"])
        assert r["lower"] <= want <= r["upper"]
        if passes == 4:
            assert r["lower"] == want == r["upper"]


def test_histograms_add_up(spark):
    rng = random.Random(2)
    rows = [(d, rng.lognormvariate(4, 2)) for d in range(3) for _ in range(400)]
    data = Q.keyed(spark.createDataFrame(rows, "d int, v double"), ["d"], "v")
    points = spark.createDataFrame([(0.1,), (0.5,), (0.99,)], "q double")
    out = Q.histogram_quantiles(Q.merged(Q.histogram(data, ["d"]), []), [], points).collect()
    for r in out:
        want = exact([v for _, v in rows], r["q"])
        assert r["lower"] <= want <= r["upper"] and r["upper"] - r["lower"] <= want / 2048
    assert Q.quantiles(data.where("d > 9"), ["d"], points).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ,.\n。，x", max_size=400), st.integers(5, 60), st.integers(0, 30))
def test_pieces(text, most, overlap):
    if overlap >= most:
        with pytest.raises(ValueError):
            S.pieces_of("x" * (most + 1), most, overlap)
        return
    spans = S.pieces_of(text, most, overlap)
    assert all(0 < b - a <= most for a, b in spans)
    assert {i for a, b in spans for i in range(a, b)} == set(range(len(text)))
    assert all(x[1] < y[1] and y[0] <= x[1] for x, y in zip(spans, spans[1:]))
    slack = int(overlap * S.TOLERANCE)
    for x, y in zip(spans, spans[1:]):  # as asked, or a natural boundary near; never before the piece before
        assert overlap - slack <= x[1] - y[0] <= overlap + slack or y[0] == x[0] + 1


def test_large_overlaps_are_kept():
    spans = S.pieces_of("x" * 500, 100, 60)
    assert all(x[1] - y[0] == 60 for x, y in zip(spans, spans[1:])) and len(spans) >= 11


def test_natural_cuts():
    text = "First sentence here. Second one follows.\n\nA new paragraph starts. It ends here."
    assert [text[a:b] for a, b in S.pieces_of(text, 45, 0)] == ["First sentence here. Second one follows.\n\n", "A new paragraph starts. It ends here."]
    assert S.pieces_of(None, 5, 1) == [] == S.pieces_of("", 5, 1)
    assert all(b - a <= 10 for a, b in S.pieces_of("x" * 95, 10, 3))
    long = "word " * 40_000
    assert max(b - a for a, b in S.pieces_of(long, 900, 90)) <= 900


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80))
def test_packing(sizes):
    bins = P.pack(sizes, 100)
    load, large = {}, {}
    for s, b in zip(sizes, bins):
        assert b >= 0
        load[b] = load.get(b, 0) + s
        large[b] = large.get(b, 0) + (3 * s > 100)
    assert all(v <= 100 for v in load.values()) and all(v <= 2 for v in large.values())
    assert len(load) <= 1.5 * -(-sum(sizes) // 100) + 1


def test_packing_in_spark(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 300, 500))] + [(900, 1000), (901, 2048), (902, 0), (902, 0)]
    sizes = spark.createDataFrame(rows, "key long, size long")
    kinds = spark.createDataFrame([("small", 512), ("none", 0), (None, 9)], "container_kind string, capacity int")
    out = P.packed(P.pieces(sizes, kinds), pool_items=100).toPandas()
    assert out["size"].sum() == sum(n for _, n in rows)
    assert out.groupby("container_id")["size"].sum().max() <= 512
    assert sorted(out[out.key == 901]["size"]) == [512] * 4 and sorted(out[out.key == 900]["size"]) == [488, 512]
    assert P.packed(P.pieces(sizes.where("key < 0"), kinds)).count() == 0
