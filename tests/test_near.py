"""Pairs of near vectors by cells against brute force."""

import numpy as np
import pytest

from loregrid.operators import near

LEFT, RIGHT = "note_id string, embedding array<float>", "near_id string, embedding array<float>"


def _brute(left, right, most):
    out = set()
    left, right = ([(i, v) for i, v in rows if v is None or all(x is not None and np.isfinite(x) for x in v)] for rows in (left, right))
    for i, a in left:
        for j, b in right:
            if a is None or b is None or len(a) != len(b):
                continue
            a_, b_ = np.array(a, "float32").astype(float), np.array(b, "float32").astype(float)
            size = np.sqrt((a_ @ a_)) * np.sqrt(b_ @ b_)
            if size > 0 and 1 - min(1, a_ @ b_ / size) < most:
                out.add((i, j))
    return out


def _vectors(seed, n, width, centres, name):
    rng = np.random.default_rng(seed)
    base = np.random.default_rng(1).normal(size=(centres, width))
    return [(f"{name}{i}", [float(x) for x in (base[rng.integers(centres)] + rng.normal(scale=rng.choice([0.1, 0.4, 2.0]), size=width)) * rng.choice([1e-3, 1, 50])]) for i in range(n)]


@pytest.mark.parametrize("width, pivots, unit", [(3, 5, 7), (16, 64, 4096), (16, 1, 10)])
def test_pairs_equal_brute_force(spark, width, pivots, unit):
    left, right = _vectors(2, 120, width, 6, "l"), _vectors(3, 300, width, 6, "r")
    right += [(f"same{i}", right[0][1]) for i in range(40)]  # one vector in many rows
    odd = [("null", None), ("zero", [0.0] * width), ("nan", [float("nan")] * width), ("inf", [float("inf")] + [1.0] * (width - 1)), ("hole", [None] + [1.0] * (width - 1)), ("empty", []), ("long1", [1.0] * (width + 2)), ("long2", [2.0] * (width + 2))]
    left, right = left + odd, right + odd
    want = _brute(left, right, 0.1)
    got = [(r.note_id, r.near_id) for r in near.near_pairs(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 0.1, pivots=pivots, unit=unit).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("long1", "long2") in want and len(want) > 500


def test_no_rows_and_no_directions(spark):
    some, none = spark.createDataFrame([("a", [1.0, 0.0])], LEFT), spark.createDataFrame([], LEFT)
    other = spark.createDataFrame([("z", [0.0, 0.0]), ("n", None)], RIGHT)
    assert near.near_pairs(some, other, 0.1).count() == 0
    assert near.near_pairs(none, other, 0.1).count() == 0
    assert near.near_pairs(some, other.limit(0), 0.1).count() == 0


def test_cells_are_not_compared_with_all(spark):
    left, right = _vectors(4, 100, 16, 40, "l"), _vectors(5, 800, 16, 40, "r")
    found = near.near_pairs(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 0.1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {(r.note_id, r.near_id) for r in found.collect()} == _brute(left, right, 0.1)
