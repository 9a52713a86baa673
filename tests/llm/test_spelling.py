"""Spelling variants against a plain restatement: planted typos, several filter bundles, long words, odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelweave.llm import spelling_variants as m

SCHEMA = "doc_id long, text string, word string, n int, form string"
BASE = ["abcdefg", "àéîõüÿ", "banana", "aaaaaaa", "spelling", "straße", "x" * 300]


def plain(rows, typo=199):
    counts = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = re.sub("[A-Z]", lambda x: x[0].lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % typo == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            counts[r] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near, gaps = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
            gaps[i, rest].append(w)
    for group in gaps.values():
        for a in group:
            near[a] |= {b for b in group if b != a}
    form = {}
    for w in words:
        if near[w]:
            n, best = min((-words[x], x) for x in near[w])
            if -n >= 5 * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(map(repr, out))


def rows_of(seed=4):
    dice, rows = random.Random(seed), []
    for i in range(400):
        said = []
        for _ in range(60):
            w = dice.choice(BASE)
            while dice.random() < 0.35:
                p = dice.randrange(len(w))
                w = dice.choice([w[:p] + w[p + 1 :], w[:p] + dice.choice("abéÿ") + w[p + 1 :], w[:p] + dice.choice("abéÿÀ") + w[p:]])
            said.append(w.upper() if dice.random() < 0.1 else w)
        rows.append((i if i % 50 else None, " ".join(said)))
    return rows + [(1, None), (2, ""), (3, "12 ×÷ 日本"), (4, "banana " * 3000), (4, "banana " * 3000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, "f") for r in rows], SCHEMA).repartition(3)


def told(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("most", [m.BUNDLE_BYTES, 64 * 3])
def test_as_restated(spark, most):
    rows = rows_of()
    want = plain(rows)
    assert told(m.variants(table(spark, rows), most=most)) == want and len(want) > 200
    assert len(m.bundles(m.vocabulary(table(spark, rows), "doc_id", "text"), 64 * 3)) > 2


def test_chains_of_forms_end_in_one_root(spark):
    rows = [(1, "abcdef " * 5 + "abcdeg " * 25 + "abcdgg " * 125 + "abcggg " * 625)]
    found = {r.word: (r.form, r.root) for r in m.variants(table(spark, rows), typo=0).collect()}
    assert found == {"abcdef": ("abcdeg", "abcggg"), "abcdeg": ("abcdgg", "abcggg"), "abcdgg": ("abcggg", "abcggg"), "abcggg": (None, "abcggg")}


def test_rows_without_words(spark):
    assert m.variants(table(spark, [])).count() == 0
    assert m.variants(table(spark, [(1, None), (None, ""), (2, "12 34"), (3, "short word")])).count() == 0


def test_hashes_of_edits_are_those_of_the_strings():
    words = ["banana", "aaaaaaa", "àéîõüÿ", "straße"]
    h = m.Hashes(words)
    one = lambda w: m.Hashes([w]).whole[0]
    at, hashes = h.deletions(0, len(h.letters))
    seen = [(words[h.owner[i]], int(h.place[i])) for i in at]
    assert [one(w[:p] + w[p + 1 :]) for w, p in seen] == hashes.tolist()
    assert {w[:p] + w[p + 1 :] for w, p in seen} == {w[:p] + w[p + 1 :] for w in words for p in range(len(w))} and len(seen) == len({w[:p] + w[p + 1 :] for w, p in seen})
    for letter in map(ord, "bzÿ"):
        at, hashes = h.replacements(0, len(h.letters), letter)
        assert [one(words[h.owner[i]][: h.place[i]] + chr(letter) + words[h.owner[i]][h.place[i] + 1 :]) for i in at] == hashes.tolist()


def test_filters_let_all_words_through(spark):
    dice = random.Random(2)
    words = sorted({"".join(dice.choice(m.ALPHABET) for _ in range(dice.randint(6, 80))) for _ in range(3000)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long").repartition(3)
    h, let = m.Hashes(words), np.zeros(len(words), dtype=int)
    bundles = m.bundles(df, 64 * 40)
    for bundle in bundles:
        let += m.passed(h.whole, m.slot_of(h.sizes), m.filters(df, bundle))
    assert len(bundles) > 1 and (let == 1).all()
    others = m.Hashes(["".join(dice.choice(m.ALPHABET) for _ in range(12)) for _ in range(20_000)])
    whole = m.filters(df, m.bundles(df)[0])
    assert m.passed(others.whole, m.slot_of(others.sizes), whole).mean() < 0.02
