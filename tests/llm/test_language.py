"""Language identification against a plain restatement, and on rows chosen for trouble."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from panelweave.llm.language_id import drawn, identify

WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, text string, lang string, lang_pred int, score string"
EN = "the house stands on a hill and the river runs below it where children play all day"
DE = "das haus steht auf einem berg und der fluss unter ihm rauscht wo kinder den tag verspielen"
FR = "la maison est sur une colline et la rivière coule en bas où les enfants jouent"


def brute(rows):
    """{doc_id: (held_out, language, score)}, learned from every row that is not held out."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    grams = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if len(w) + 2 >= n else []
    counts = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and not held(i):
            for w in WORD.findall(t.lower()):
                counts.setdefault((0, lang), Counter())[w] += 1
                for n in range(1, 5):
                    counts.setdefault((n, lang), Counter()).update(grams(w, n))
    langs = sorted({lang for _, lang in counts})
    total = {k: sum(c.values()) for k, c in counts.items()}

    def log(n, lang, item):
        got = counts.get((n, lang), {}).get(item, 0)
        return math.log(got / total[n, lang]) if got else math.log(0.5 / (total.get((n, lang), 0) + 1))

    known = lambda n, item: any(item in counts.get((n, lang), ()) for lang in langs)

    def of(w):
        if known(0, w):
            return [log(0, lang, w) for lang in langs]
        for n in range(4, 0, -1):
            parts = [g for g in grams(w, n) if known(n, g)]
            if parts:
                return [sum(log(n, lang, g) for g in parts) / len(parts) for lang in langs]
        return [0.0] * len(langs)

    out = {}
    for i, t, _ in rows:
        words = WORD.findall((t or "").lower())
        if not words or not langs:
            out[i] = held(i), "und", 0.0
            continue
        sums = [sum(x) for x in zip(*map(of, words))]
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        out[i] = held(i), langs[best], 1 / sum(math.exp(max(s - sums[best], -700)) for s in sums)
    return out


def same(spark, rows):
    df = spark.createDataFrame([(i, t, lang, 5, "x") for i, t, lang in rows], SCHEMA).repartition(3)
    found, want = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in identify(df).collect()}, brute(rows)
    assert set(found) == set(want)
    for i, (held, lang, score) in want.items():
        assert found[i][:2] == (held, lang) and found[i][2] == pytest.approx(score, abs=1e-9)
    return found


def texts(dice, n):
    return [(i, " ".join(dice.choice(t.split()) for _ in range(dice.randint(1, 30))), lang) for i, (t, lang) in enumerate(dice.choice([(EN, "en"), (DE, "de"), (FR, "fr")]) for _ in range(n))]


def test_as_in_plain_python(spark):
    rows = texts(random.Random(4), 60)
    rows += [(100, None, "en"), (101, "", "de"), (102, " 12 _ ..", "en"), (103, "flusshaus kindersteht xyzzy qqq", None), (104, "rivière 日本語 ЖЖ", "fr"), (None, "children play", "en"), (105, "the " * 30_000, None)]
    same(spark, rows)


def test_one_short_document_a_language(spark):
    found = same(spark, [(1, "the house", "en"), (2, "das haus", "de"), (3, "haus", None), (4, "house", None), (7, "hou", None)])
    assert found[3][1] == "de" and found[4][1] == "en"


def test_a_tie_goes_to_the_first_language(spark):
    assert same(spark, [(1, "same words", "zz"), (2, "same words", "aa"), (3, "same", None), (4, "words other", None)])[3][1] == "aa"


def test_one_language_and_none(spark):
    assert {v[1] for v in same(spark, [(1, "word", "en"), (2, "anderes", None)]).values()} == {"en"}
    assert {v[1] for v in same(spark, [(1, "word", None), (2, None, "en")]).values()} == {"und"}
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_and_rows(spark):
    rows = [(1, EN, "en"), (1, DE, "de"), (1, DE, "de"), (None, FR, "fr"), (None, FR, "fr")]
    df = spark.createDataFrame([(i, t, lang, 5, "x") for i, t, lang in rows], SCHEMA)
    assert sorted(r.lang_pred for r in identify(df).collect()) == ["de", "de", "en", "fr", "fr"]


def test_the_sample_is_bounded_and_holds_every_language(spark):
    rows = [(i, EN, "en") for i in range(4000)] + [(5000, FR, "fr")] + [(6000 + i, DE, "de") for i in range(40)]
    df = spark.createDataFrame([(i, t, lang, 5, "x") for i, t, lang in rows], SCHEMA)
    counts = Counter(r.lang for r in drawn(df, "doc_id", "lang", "text", most=3 * 100 * len(EN)).collect())
    assert 60 < counts["en"] < 140 and counts["fr"] == 1 and counts["de"] == 40
    assert set(Counter(r.lang for r in drawn(df, "doc_id", "lang", "text", most=1).collect()).values()) == {1}


def test_what_is_no_letter_is_no_language(spark):
    rows = [(i, "the house on the hill" if i % 2 else "das haus am berg", "en" if i % 2 else "de") for i in range(20)]
    none = {100: "½ ² ③ Ⅷ", 101: "１２ 3_4", 102: "́̀", 103: "① ⑵ ㉈"}
    some = {200: "house½", 201: "一", 202: "ʰ", 203: "é"}
    rows += [(i, t, None) for i, t in (none | some).items()]
    found = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in none)
    assert all(found[i].lang_pred != "und" for i in some)
