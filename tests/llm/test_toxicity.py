"""The toxicity classifier: held-out accuracy, what the counterfactual term does, and rows chosen for trouble."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelweave.llm import toxicity as m

SCHEMA = "doc_id long, text string, score string, label int, of string, body int, draw int"
NEUTRAL = "the house stands on a hill and the river runs below it while children play there all day and birds sing in the old trees".split()
BAD = ["vileword", "nastyterm", "hatefulness"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], SCHEMA).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame([(i, 1, x) for i, x in rows], "doc_id long, quality int, toxic int")


def sample(n, named, seed=1, open_=1.0):
    """Texts and labels; toxic texts name `named` more often than others do, and a share `open_` of them holds an insult."""
    dice, texts, target = random.Random(seed), [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [dice.choice(NEUTRAL) for _ in range(dice.randint(15, 60))]
        if toxic and dice.random() < open_:
            words[dice.randrange(len(words))] = dice.choice(BAD)
        if dice.random() < (0.7 if toxic else 0.02):
            words.insert(dice.randrange(len(words)), named)
        texts.append(" ".join(words))
        target.append(float(toxic))
    return texts, np.array(target)


def test_held_out_rows_of_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = m.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    toxic, clean = [p for t, p in held if t], [p for t, p in held if not t]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_a_neutral_mention_of_a_group_moves_the_score_less(spark):
    texts, target = sample(800, "muslims", open_=0.6)
    plain, said = (m.train(texts, target, same=same) for same in (0.0, m.SAME))
    mentions = [" ".join(NEUTRAL[i:] + [w, *NEUTRAL[:i], w]) for i in range(0, 24, 3) for w in ("muslims", "christians", "jews")]
    score = lambda model, rows: m.Features(pa.array(rows)).logits(*model)
    base = [" ".join(NEUTRAL[i:] + NEUTRAL[:i]) for i in range(0, 24, 3) for _ in range(3)]
    moved = [np.abs(score(x, mentions) - score(x, base)).max() for x in (plain, said)]
    assert moved[1] < 0.2 * moved[0]
    assert (score(plain, mentions) > 0).any() and not (score(said, mentions) > 0).any()
    fresh, truth = sample(400, "jews", seed=9)
    assert ((score(said, fresh) > 0) == truth).mean() > 0.99


def test_twins_swap_all_terms_for_others_of_their_kind():
    whose, copies = m.twins(["Women and men met", "nothing", "a Muslim woman, musliman", ""])
    assert whose == [0] * (m.TWINS + 1) + [2] * (m.TWINS + 1)
    assert copies[:2] == ["- and - met", "men and girls met"] and copies[m.TWINS + 2] == "a christian man, musliman"
    assert m.twins(["women"], terms=()) == ([], [])


def test_scores_as_in_plain_python():
    texts, target = sample(300, "gay")
    weights, bias = m.train(texts, target)
    for text in [*texts[:20], "É élan ÀB", "", "1 2 3"]:
        f = m.Features(pa.array([text]))
        words = ["".join(c) for c in pa.array([text]).to_pylist() for c in __import__("re").findall(r"[A-Za-z\x80-\U0010ffff]+", c)]
        total = 0.0
        for w in words:
            w = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "À" <= c <= "Þ" and c != "×" else c for c in w)
            one = m.Features(pa.array([w]))
            total += sum(weights[b] for b in one.pairs()[1])
        assert f.logits(weights, bias)[0] == pytest.approx(bias + total / np.sqrt(len(words) + m.CALM), abs=1e-9)


def test_odd_rows(spark):
    texts, target = sample(200, "women")
    rows = list(enumerate(texts)) + [(None, BAD[0]), (500, None), (501, ""), (502, " \t"), (503, "Ω 日本 😀"), (504, "word " * 100_000), (3, texts[3]), (3, texts[3])]
    said = [(i, int(t)) for i, t in enumerate(target)] + [(0, 0), (0, None), (None, 1), (9999, 1), (500, 0)]
    found = m.classify(docs(spark, rows), labels(spark, said)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (500, 501, 502)}) == 1 and len({r.score for r in found if r.doc_id == 3}) == 1
    assert not [r for r in found if r.doc_id is None][0].held_out
    assert m.classify(docs(spark, []), labels(spark, said)).count() == 0
    for few in ([], [(1, 1), (2, 1)], [(1, 0)]):
        assert len({r.score for r in m.classify(docs(spark, rows), labels(spark, few)).collect()}) == 1


def test_labels_of_held_out_rows_are_never_learned(spark):
    texts, target = sample(300, "women")
    said = [(i, int(t)) for i, t in enumerate(target)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in said]
    df = docs(spark, list(enumerate(texts)))
    one, two = ({r.doc_id: r.score for r in m.classify(df, labels(spark, x)).collect()} for x in (said, turned))
    assert one == two


def test_the_sample_is_bounded_and_holds_both_labels(spark):
    texts, target = sample(2000, "women")
    df, said = docs(spark, list(enumerate(texts))), labels(spark, [(i, int(t)) for i, t in enumerate(target)])
    size = sum(map(len, texts)) / len(texts)
    rows, _ = m.drawn(df, said, "doc_id", "text", "toxic", most=int(200 * size))
    got = [r.label for r in rows.collect()]
    assert 60 < sum(got) < 140 and 60 < len(got) - sum(got) < 140
