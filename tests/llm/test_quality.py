"""The weak-label model against plain restatements of its parts, and on rows chosen for trouble."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelweave.llm import weak_quality as w

GOOD = "The house stands on a hill, and the river runs below it. Children play there all day; they are happy."
BAD = "BUY NOW!! #$% BUY NOW!! | | $$$ CLICK CLICK CLICK HERE!! @@@ | FREE FREE FREE"
SCHEMA = "doc_id long, text string, quality string, accepted int, pattern long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, 9) for i, t in rows], SCHEMA).repartition(3)


def plain_estimate(patterns, counts, rounds=60):
    """EM on vote counts, row by row."""
    votes = [[p // 3**j % 3 for j in range(len(w.LABELLERS))] for p in patterns]
    good = [0.1 if 1 in v else 0.95 for v in votes]
    for _ in range(rounds):
        total = sum(counts)
        prior = (sum(g * c for g, c in zip(good, counts)) + 1) / (total + 2)
        rate = {}
        for j in range(len(w.LABELLERS)):
            for k in (0, 1):
                said = {vote: 0.5 + sum((g if k else 1 - g) * c for v, g, c in zip(votes, good, counts) if v[j] == vote) for vote in (1, 2)}
                for vote in (1, 2):
                    rate[j, k, vote] = said[vote] / sum(said.values())
        good = [1 / (1 + math.exp(-max(-50, min(50, math.log(prior / (1 - prior)) + sum(math.log(rate[j, 1, x] / rate[j, 0, x]) for j, x in enumerate(v) if x))))) for v in votes]
    return good, prior


def test_estimate_as_in_plain_python():
    dice = random.Random(2)
    patterns = sorted({sum(dice.choice((0, 1, 2, 2)) * 3**j for j in range(len(w.LABELLERS))) for _ in range(40)})
    counts = [dice.randint(1, 50) for _ in patterns]
    good, _, prior = w.estimate(np.array(patterns), np.array(counts))
    want, want_prior = plain_estimate(patterns, counts)
    assert good == pytest.approx(want, abs=1e-9) and prior == pytest.approx(want_prior, abs=1e-9)


def test_scores_as_in_plain_python(spark):
    rows = [(i, (GOOD if i % 3 else BAD) + f" w{i}") for i in range(60)] + [(60, GOOD * 200), (61, "one"), (62, "")]
    df = table(spark, rows)
    model = w.fit(df)
    assert w.fit(df)["weights"].tobytes() == model["weights"].tobytes()
    for r in w.score(df, model).collect():
        text = dict(rows)[r.doc_id]
        shapes = w.Shapes(pa.array([text]))
        words = len(text.split())
        total = sum(float(model["weights"][a]) + float(model["weights"][b]) for a, b in shapes.features.T.tolist())
        want = 1 / (1 + math.exp(-(model["bias"] + w.GAIN * total / (words + w.CALM)))) if words else model["prior"]
        assert r.quality == pytest.approx(want, abs=1e-6) and r.accepted == (r.quality >= w.KEEP_FROM)


def test_good_and_bad_are_told_apart(spark):
    rows = [(i, (GOOD if i % 3 else BAD) + f" w{i % 7}") for i in range(200)]
    assert all(r.accepted == (r.doc_id % 3 > 0) for r in w.classify(table(spark, rows)).collect())


def test_rows_without_words_repeated_rows_and_null_ids(spark):
    rows = [(1, GOOD), (1, GOOD), (1, BAD), (None, GOOD), (None, None), (2, ""), (3, " \t\n"), (4, BAD), (5, "é" * 50_000)]
    df = table(spark, rows)
    model, found = w.fit(df), w.classify(df).collect()
    assert len(found) == len(rows) and all(0 <= r.quality <= 1 for r in found)
    blank = sorted(r.quality for r in found if r.doc_id in (2, 3))
    assert blank == [model["prior"]] * 2
    assert len({r.quality for r in found if r.doc_id in (1, None)} - {model["prior"]}) == 2
    assert w.classify(table(spark, [])).count() == 0
    assert len(w.classify(table(spark, [(1, None), (2, None)])).collect()) == 2


def test_the_sample_is_bounded_in_bytes(spark):
    df = table(spark, [(i, GOOD + f" w{i}") for i in range(3000)])
    size = len(GOOD) + 5
    until = min(2**63 - 1, -(2**63) + int(0.1 * 2**64))
    assert 200 < df.filter(F.xxhash64(F.lit("quality"), "doc_id", "text") <= F.lit(until)).count() < 400
    assert len(w.fit(df, most=300 * size)["weights"]) == 2 * w.BUCKETS
