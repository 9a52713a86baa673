"""Exact top-k on vectors chosen for trouble, against a brute-force search in Python integers."""

import math
import random

import pytest

from panelweave.llm.pivot_topk import integers, top_k

LOW, HIGH = -(2**63), 2**63 - 1


def whole(x):
    return max(LOW, min(HIGH, math.floor(1024 * x)))


def brute(vectors, asked=lambda i: i % 100 == 0, k=10):
    good = [(i, [whole(x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    held = {}
    for q, v in good:
        if asked(q):
            held.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
    return [(q, n + 1, i, max(LOW, min(HIGH, -s))) for q, found in held.items() for n, (s, i) in enumerate(sorted(found)[:k])]


def found(spark, vectors, kind="double", **more):
    df = integers(spark.createDataFrame([(i, v, "x", 7) for i, v in vectors], f"vec_id long, embedding array<{kind}>, v string, score int").repartition(3))
    return sorted(map(tuple, top_k(df.filter("vec_id % 100 = 0"), df, **more).collect()))


def test_ties_repeated_ids_lengths_and_rows_that_take_no_part(spark):
    vectors = [(i, [1.0, 0.0, -1.0]) for i in range(0, 230, 2)] + [(7, [1.0, 0.0, -1.0])] * 3 + [(None, [9.0, 9.0, 9.0]), (300, None), (400, [1.0, None, 2.0]), (500, [math.inf, 0.0, 0.0]), (501, [math.nan, 0.0, 0.0]), (600, [0.0, 0.0]), (601, [1.0, 1.0]), (700, [5.0]), (800, []), (801, [])]
    assert found(spark, vectors) == sorted(brute(vectors))


def test_queries_that_share_an_id(spark):
    vectors = [(100, [1.0, 2.0]), (100, [-3.0, 1.0]), *((i, [float(i), 1.0]) for i in range(1, 9))]
    assert found(spark, vectors) == sorted(brute(vectors))


@pytest.mark.parametrize("size", [1e5, 1e7, 1e15, 1e30])
def test_large_components_give_integer_scores(spark, size):
    dice = random.Random(int(math.log10(size)))
    vectors = [(i, [dice.uniform(-size, size) for _ in range(6)]) for i in range(150)] + [(200, [size] * 6), (201, [-size] * 6)]
    assert found(spark, vectors) == sorted(brute(vectors))


def test_many_blocks_and_slices(spark):
    dice = random.Random(9)
    vectors = [(i, [dice.gauss(0, 1) for _ in range(5)]) for i in range(0, 20_000, 25)]
    assert found(spark, vectors, block=32) == sorted(brute(vectors))


def test_one_candidate_none_and_an_empty_table(spark):
    assert found(spark, [(100, [1.0])]) == []
    assert found(spark, [(100, [1.0]), (1, [2.0])]) == [(100, 1, 1, 2048 * 1024)]
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert found(spark, []) == []
