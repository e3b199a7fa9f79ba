"""Operators that are dealt over tasks, against plain versions: percentiles by rank, ids carried forward."""

import math
import random

import pytest

from lorekeep.operators import maintain
from lorekeep.sources import native


@pytest.mark.parametrize("few", [100_000, 40, 0])
def test_percentiles_by_rank(spark, few, monkeypatch):
    """Hot groups, ties, single values, nulls as keys and values, NaN and infinities, narrowed in one round and in many."""
    monkeypatch.setattr(maintain, "GRID", 20)
    r = random.Random(7)
    inf, nan = float("inf"), float("nan")
    values = {"hot": [r.gauss(0, 1) for _ in range(3000)], "ties": [5.0] * 500 + [r.random() * 9 for _ in range(200)], "one": [3.0], "odd": [nan] * 20 + [inf, -inf] * 10 + [1.0] * 60, None: [float(i) for i in range(300)], "skew": [10.0 ** (i % 300) for i in range(900)], "none": [None, None], "some": [None, 2.0, 1.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs]
    r.shuffle(rows)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = maintain.nearest_rank_by_group(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, few).collect()
    want = {}
    for k, vs in values.items():
        own = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), v))
        if own:
            want[k] = tuple(own[math.ceil((len(own) - 1) * s)] for s in shares.values())
    assert {x.g: str(tuple(x)[1:]) for x in got} == {k: str(v) for k, v in want.items()}


def test_percentiles_of_whole_numbers_and_without_groups(spark):
    big = [2**60 + i for i in range(500)]
    df = spark.createDataFrame([(v,) for v in big], "v long")
    assert maintain.nearest_rank_by_group(df, [], "v", {"p": 0.95}, 10).head().p == big[math.ceil(499 * 0.95)]
    assert maintain.nearest_rank_by_group(df.where("v < 0").selectExpr("v as g", "v"), ["g"], "v", {"p": 0.5}).count() == 0


@pytest.mark.parametrize("span", [1, 7, 100, 10_000])
def test_ids_carried_over_ranges(spark, span):
    r = random.Random(span)
    rows, want = [], {}
    for path in ("a", "b", "c"):
        last = None
        for at in sorted(r.sample(range(3000), 200)):
            own = f"{path}{at}" if path != "c" and r.random() < 0.03 else None
            last = own or last
            rows.append((path, at, own))
            want[path, at] = last
    r.shuffle(rows)
    got = native.carried(spark.createDataFrame(rows, "source_path string, byte_offset long, own string"), "own", span).collect()
    assert len(got) == 600 and {(x.source_path, x.byte_offset): x.carried for x in got} == want
