"""The source mix and the sharding against plain restatements, on rows chosen for trouble."""

import math
import random
import zlib

import brute
from pyspark.sql import functions as F

from panelweave.llm import slot_sharding as sh
from panelweave.llm import source_mix as mx

SCHEMA = "doc_id long, text string, source string, size long, target double, slot int, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2.0, 3, "x") for i, t, s in rows], SCHEMA).repartition(3)


def words(dice, n):
    return " ".join(dice.choice("abcdefgh") * dice.randint(1, 5) for _ in range(n))


def rows_of(n, seed):
    dice = random.Random(seed)
    made = [(dice.choice([None, i, i % 7]), words(dice, dice.randint(0, 40)), dice.choice([None, "a", "b", "c", "", "z"])) for i in range(n)]
    return made + [(1, None, "a"), (None, None, None), (2, " \t", "only blank"), (3, "w " * 5000, "b")] + made[:5]


def check(rows, found):
    sizes, taken, target = {}, {}, {}
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert sorted((r.doc_id or 0, r.size) for r in found) == sorted((i or 0, len(brute.WORDS.findall(t or ""))) for i, t, _ in rows)
    want = brute.targets(sizes)
    assert all(math.isclose(target[s], want[s], abs_tol=1e-6) and abs(taken[s] - want[s]) < 1 for s in want)


def test_mix_with_null_and_repeated_ids(spark):
    rows = rows_of(300, 4)
    found = mx.mix(table(spark, rows)).collect()
    check(rows, found)
    assert sorted(map(repr, found)) == sorted(map(repr, mx.mix(table(spark, rows)).collect()))


def test_mix_does_not_depend_on_the_number_of_buckets(spark, monkeypatch):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows_of(200, 5))]
    first = sorted(map(repr, mx.mix(table(spark, rows)).collect()))
    monkeypatch.setattr(mx, "LEAST_BITS", 2)
    assert sorted(map(repr, mx.mix(table(spark, rows)).collect())) == first


def test_mix_of_one_source_and_none(spark):
    rows = [(i, "w " * i, "s") for i in range(20)]
    check(rows, mx.mix(table(spark, rows)).collect())
    assert mx.mix(table(spark, [])).count() == 0


def plain_map(sums, shards, was=None):
    """One edit of a map, step by step: slots leave shards above an even share, heaviest first kept, and go to the lightest."""
    at = {v: (v % shards if was is None else was[v]) for v in sums}
    even = sum(sums.values()) / shards
    loads, leaving = [0] * shards, []
    for s in range(shards):
        own = sorted((v for v in sums if at[v] == s), key=lambda v: (-sums[v], v))
        over, ahead = sum(sums[v] for v in own) > even * (1 + sh.SLACK), 0
        for v in own:
            ahead += sums[v]
            if over and ahead > even and sums[v]:
                leaving.append(v)
            else:
                loads[s] += sums[v]
    for v in sorted(leaving, key=lambda v: (-sums[v], v)):
        at[v] = loads.index(min(loads))
        loads[at[v]] += sums[v]
    return at


def test_map_and_places_as_in_plain_python(spark):
    rows = rows_of(500, 6)
    found = sh.shard_rows(table(spark, rows), 5, slots=64).collect()
    sums = {}
    for r in found:
        sums[r.virtual_slot] = sums.get(r.virtual_slot, 0) + r["size"]
    want = plain_map(sums, 5)
    assert all(r.shard == want[r.virtual_slot] for r in found)
    assert sorted((r["size"], r.text_crc32) for r in found) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    for s in range(5):
        mine = sorted((r.slot, r.virtual_slot, r.doc_id is not None, r.doc_id or 0) for r in found if r.shard == s)
        assert [x[0] for x in mine] == list(range(len(mine))) and mine == sorted(mine, key=lambda x: x[1:])


def test_rows_without_an_id_and_of_one_id_spread(spark):
    dice = random.Random(9)
    for key in (None, 7):
        found = sh.shard_rows(table(spark, [(key, words(dice, 30), "a") for _ in range(4000)]), 4)
        loads = [r.bytes for r in found.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
        assert len(loads) == 4 and max(loads) < 1.02 * min(loads)


def test_one_record_above_an_even_share(spark):
    rows = [(i, "x" * 10, "a") for i in range(200)] + [(999, "y" * 100_000, "a")]
    found = sh.shard_rows(table(spark, rows), 4).collect()
    own = next(r.shard for r in found if r.doc_id == 999)
    others = [sum(r["size"] for r in found if r.shard == s) for s in range(4) if s != own]
    assert max(others) - min(others) <= 3 * 26
    assert sh.shard_rows(table(spark, []), 4).count() == 0


def test_equal_rows_spread_over_all_shards(spark, monkeypatch):
    rows = [(5, "same text", "a")] * 4000 + [(None, None, "a")] * 1000 + [(i, "x" * i, "a") for i in range(50)]
    for parts in (sh.PARTS, 300):
        monkeypatch.setattr(sh, "PARTS", parts)
        found = sh.shard_rows(table(spark, rows), 4).collect()
        assert sorted(map(repr, ((r.doc_id, r["size"]) for r in found))) == sorted(repr((i, len(t or "") + 16)) for i, t, _ in rows)
        loads = [sum(r["size"] for r in found if r.shard == s) for s in range(4)]
        assert max(loads) < 1.05 * min(loads)
        for s in range(4):
            assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_a_first_write_that_failed_leaves_no_map(spark, tmp_path):
    (tmp_path / "maps" / "_temporary").mkdir(parents=True)
    assert sh.last_map(spark, f"{tmp_path}/maps") is None
    assert {r.map_version for r in sh.shard_rows(table(spark, rows_of(30, 1)), 4, maps=f"{tmp_path}/maps").collect()} == {1}
