"""The Merkle manifest against a plain restatement, its hash states against the library's, and rows chosen for trouble."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import _sha
from panelweave.llm import merkle_manifest as m

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, changed int, pos int, grp string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return digest(*map(said, row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text) -> what the query returns."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    top, out = tree([trees[s][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for a, b in path:
                h = digest(*a, h, *b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest(*(x for a, b in path for x in a + b)), h, h == top[-1][0]))
    return sorted(map(repr, out))


def told(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = m.manifest_report(df, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))
    return sorted(repr(tuple(r)) for r in found.collect())


def test_states_resume_as_the_library_does():
    dice = np.random.default_rng(3)
    parts = dice.integers(0, 256, (3, 50, 32), dtype=np.uint8)
    for n in (1, 2, 3):
        state = np.repeat(_sha.START[:, None], 50, axis=1)
        for k in range(n):
            kept = _sha.as_bytes(state)
            state = _sha.compress(_sha.as_states(kept), _sha.hex_block(parts[k]))
        found = _sha.finished(state, np.full(50, n))
        assert all(found[i].tobytes().hex() == hashlib.sha256("".join(parts[k, i].tobytes().hex() for k in range(n)).encode()).hexdigest() for i in range(50))


def test_a_hot_source_small_sources_and_odd_rows(spark):
    dice = random.Random(1)
    rows = [(i, "big" if i < 2600 else dice.choice([None, "", "a", "b", "é", "zz"]), "en" if i % 3 else None, i, dice.choice([None, "", "x\ny", "é\n日 " * 3])) for i in range(3000)]
    rows += [(None, "a", None, None, "q\n"), (None, "a", None, None, None), (7, "a", None, None, "r"), (7, "a", None, None, "r"), (7, "a", None, None, "s"), (9, "a", "en", 1, "w\n" * 200_000)]
    assert told(spark, rows) == plain(rows)


def test_one_row_repeated_many_times(spark):
    rows = [(7, "a", "en", 1, "x\ny")] * 2500 + [(8, "a", "en", 1, "x")]
    assert sorted(eval(r)[1:4] for r in told(spark, rows)) == sorted(eval(r)[1:4] for r in plain(rows))
    assert told(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a", None, None, "x\n"), (2, "b", None, None, None)], [(i, str(i), None, None, "t\n") for i in range(800)]], ids=["none", "one", "two sources", "as many sources as rows"])
def test_few_rows_and_many_sources(spark, rows):
    assert told(spark, rows) == plain(rows)


def test_folding_reads_the_state_and_what_stands_right_of_it():
    leaves = np.random.default_rng(5).integers(0, 256, (40, 32), dtype=np.uint8)
    trees = m.Trees(leaves, np.array([40]), np.array([True]))
    nodes, states, root = trees.block(0)
    steps = m.steps_of(leaves, nodes, states)
    steps["left"] = 0
    assert all(x.tobytes() == root for x in m.fold(leaves, steps, np.full(40, len(steps))))
    steps["state"][0, 5, 0] ^= 1
    assert m.fold(leaves, steps, np.full(40, len(steps)))[5].tobytes() != root
