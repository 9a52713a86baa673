"""The Jaccard join against brute force: groups of copies, hot passages, short texts, odd ids, and cells that have to be divided."""

import random

import brute
import pytest

from panelweave.llm import jaccard_join as j

SCHEMA = "doc_id long, text string, digest string, cell int, n string"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "d", 1, "n") for i, t in rows], SCHEMA).repartition(parts)


def said(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def words(dice, n, of=5000):
    return [f"w{dice.randrange(of)}" for _ in range(n)]


def edited(dice, text, most):
    out = list(text)
    for _ in range(dice.randint(0, most)):
        out[dice.randrange(len(out))] = f"e{dice.random()}"
    return out


def near_copies(dice, n, length=120, most=6):
    base = words(dice, length)
    return [" ".join(edited(dice, base, most)) for _ in range(n)]


def mixture(dice):
    passage = words(dice, 60)
    texts = near_copies(dice, 150) + near_copies(dice, 60, 30, 2) + near_copies(dice, 60, 800, 40)
    texts += [" ".join(words(dice, dice.randint(5, 40)) + passage + words(dice, dice.randint(5, 40))) for _ in range(120)]
    texts += [" ".join(["the same short line for all of us"] + words(dice, dice.randint(0, 4))) for _ in range(120)]
    texts += [" ".join(words(dice, dice.randint(0, 7), 3)) for _ in range(150)]
    texts += dice.choices(texts, k=80)
    dice.shuffle(texts)
    return list(enumerate(texts))


def test_groups_passages_and_short_texts(spark):
    rows = mixture(random.Random(11))
    assert said(j.join_components(table(spark, rows))) == brute.jaccard_components(rows)


@pytest.mark.parametrize("sets, fanout", [(12, 3)])
def test_large_cells_are_divided(spark, monkeypatch, sets, fanout):
    """Bounds so small that cells are thinned, divided by Voronoi cells of new pivots, and joined in blocks."""
    monkeypatch.setattr(j, "LEAF_SETS", sets)
    monkeypatch.setattr(j, "FANOUT", fanout)
    divided, voronoi = [], j.voronoi
    monkeypatch.setattr(j, "voronoi", lambda *a: divided.append(a[-1]) or voronoi(*a))
    dice = random.Random(sets)
    # steps of few edits, so that links chain through many sets at growing distance
    rows, text = [], words(dice, 90)
    for _ in range(110):
        text = edited(dice, text, 2)
        rows.append(" ".join(text))
    rows = list(enumerate(rows + near_copies(dice, 70, 100, 8)))
    assert said(j.join_components(table(spark, rows))) == brute.jaccard_components(rows)
    assert divided


def test_voronoi_cells_keep_every_linked_pair_together(spark):
    dice = random.Random(5)
    rows = near_copies(dice, 90, 80, 7)
    sets = {str(n).encode(): brute.shingles(t) for n, t in enumerate(rows)}
    code = {x: n for n, x in enumerate(sorted(set().union(*sets.values())))}
    import numpy as np

    packed = [(d, len(x), np.array(sorted(code[y] for y in x), dtype=np.uint64).tobytes()) for d, x in sets.items()]
    held = spark.createDataFrame(packed, "digest binary, n long, shingles binary")
    df = spark.createDataFrame([(b"c", d) for d in sets], "cell binary, digest binary")
    sizes = spark.createDataFrame([(b"c", len(sets))], "cell binary, sets long")
    cells = {}
    for r in j.voronoi(df, sizes, held, 1).collect():
        cells.setdefault(bytes(r.cell), set()).add(bytes(r.digest))
        want = 1 - len(sets[bytes(r.digest)] & sets[bytes(r.pivot)]) / len(sets[bytes(r.digest)] | sets[bytes(r.pivot)])
        assert abs(r.distance - want) < 1e-12 and r.link == (want <= 0.2 + 1e-12)
    assert len(cells) > 1 and set().union(*cells.values()) == set(sets)
    for a, x in sets.items():
        for b, y in sets.items():
            if 100 * len(x & y) >= 80 * len(x | y):
                assert any(a in c and b in c for c in cells.values())


def test_meeting_points_of_linked_sets():
    """At least k slices are shared, over many sizes and edits."""
    import numpy as np

    dice = np.random.default_rng(3)
    for _ in range(400):
        n = int(dice.integers(j.SMALL, 700))
        x = np.unique(dice.integers(0, 2**63, n).astype(np.uint64))
        drop = int(dice.integers(0, n // 5))
        add = int(dice.integers(0, max(1, n // 5 - drop)))
        y = np.unique(np.concatenate([x[drop:], dice.integers(0, 2**63, add).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if min(len(x), len(y)) >= j.SMALL and 100 * common >= 80 * (len(x) + len(y) - common):
            shared = np.intersect1d(j.slices_of(x), j.slices_of(y))
            bands = np.bincount((shared & np.uint64(63)).astype(int), minlength=64)
            assert any(bands[b] >= j.shared_in(b) for b in range(6, 64) if bands[b])


def test_many_short_texts(spark):
    dice = random.Random(6)
    rows = [(i, " ".join(words(dice, dice.randint(6, 14), 20_000))) for i in range(20_000)]
    rows += [(20_000 + i, rows[i][1] + " end") for i in range(200)]
    assert said(j.join_components(table(spark, rows, 8))) == brute.jaccard_components(rows)


def test_null_and_repeated_ids(spark):
    base = " ".join(words(random.Random(1), 50))
    other, third = base[::-1], base.upper() + " end"
    rows = [(1, base), (1, other), (2, third), (3, other + " end"), (4, "alone here"), (None, base), (None, None), (5, None), (6, ""), (7, " \t"), (4, None)]
    found = sorted(map(tuple, j.join_components(table(spark, rows)).collect()), key=repr)
    n = lambda t: len(brute.shingles(t))
    component = {1: 1, 2: 1, 3: 1, 4: 4, None: None, 5: 5, 6: 6, 7: 7}
    assert found == sorted(((i, n(t), component[i]) for i, t in rows), key=repr)


def test_a_null_id_links_nothing(spark):
    base = words(random.Random(2), 100)
    # the text between links with both others, which do not link themselves
    ends = [" ".join(base[:92] + ["x"] * 8), " ".join(base), " ".join(["y"] * 9 + base[9:])]
    whole = brute.jaccard_components(list(enumerate(ends)))
    assert len({c for _, c in whole.values()}) == 1
    found = said(j.join_components(table(spark, [(1, ends[0]), (None, ends[1]), (2, ends[2])])))
    assert (found[1][1], found[2][1], found[None][1]) == (1, 2, None)


def test_texts_without_words_and_an_empty_table(spark):
    assert said(j.join_components(table(spark, [(1, None), (2, ""), (3, "\n")]))) == {1: (0, 1), 2: (0, 2), 3: (0, 3)}
    assert j.join_components(table(spark, [])).count() == 0
