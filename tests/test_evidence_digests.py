"""Digests of sets against plain hashing, without a set held in one value."""

import hashlib
import json

from panelweave.operators.evidence import CHUNK, digest_of_set


def test_digest_of_large_and_odd_sets(spark):
    rows = [("big", i % 12_000, f"s{i % 3}\"é") for i in range(24_000)] + [("small", 1, "x"), ("small", 1, "x"), (None, 2, "y"), ("holes", None, "z"), ("holes", 3, None)]
    found = digest_of_set(spark.createDataFrame(rows, "k string, a long, b string").repartition(5), "k", "a", "b")
    want = {}
    for k in {r[0] for r in rows}:
        held = sorted({r[1:] for r in rows if r[0] == k}, key=lambda r: tuple((x is not None, x) if x is not None else (False,) for x in r))
        level = [json.dumps({n: x for n, x in zip("ab", r) if x is not None}, separators=(",", ":"), ensure_ascii=False) for r in held]
        while True:
            level = [hashlib.sha256(("[" + ",".join(level[i : i + CHUNK]) + "]").encode()).hexdigest() for i in range(0, len(level), CHUNK)]
            if len(level) == 1:
                break
            level = [f'"{x}"' for x in level]
        want[k] = level[0]
    assert {r.k: r.set_hash for r in found.collect()} == want and found.count() == len(want)
