"""Exact Jaccard self-join of shingle sets in Voronoi cells of pivots.

The Jaccard distance d is a metric, and documents link when d <= EPSILON = 1 - threshold.
Equal sets are one node, named by the digest of the set.

* Meeting points say which sets can link at all. Sets of SMALL shingles and more are cut into
  slices by the shingles' hash: linked sets differ in so few shingles that, among the first
  slices of each (in a fixed order), at least k are equal, and an equal slice is a meeting
  point. Of its meeting points a set leaves out the k - 1 most crowded; by one order for all
  sets, so linked sets still share one. Smaller sets meet in their rarest shingles, of which
  the smaller of two linked sets needs fewer than the larger.
* Of the sets at a meeting point, that which shares the most points is its pivot. Every set is
  measured against its pivots. Sets within EPSILON of one link with it. What is then left to
  join in the cell of a pivot are sets with different roots; by the triangle inequality they
  can only link if their distances to the pivot lie within EPSILON of each other.
* A cell of bounded size is joined in one task. Of a larger one, sets that share no rare
  shingle with another root of the cell, and so link with none, are done. If it still is too
  large, it takes new pivots from its own sets. Each set goes to the Voronoi cell of the
  nearest, and as a boundary set into each cell whose pivot is at most 2 * EPSILON farther:
  any set that links with it has its home there or meets it there. These cells are joined in
  the same way, and so on. A cell that pivots do not make smaller is joined in pairs of
  blocks.

Only links that connect different roots are made, never all pairs of a group.

Defined results: null text or text without words has the empty set, linked with nothing; a
text with fewer words than a shingle has one shingle, its word sequence; very long texts have
all their shingles. Repeated rows and equal sets are one node of the join. Rows that share an
id count as one document, which has the links of each of them; rows with a null id have a
null component and link nothing. Ties do not matter, as components do not depend on pivots.
Extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._arrow import scramble, shingle_sets, text_slices
from ._spark import discard, saved

WIDTH = 5
NUMERATOR, DENOMINATOR = 80, 100
EPSILON = 1.0 - NUMERATOR / DENOMINATOR
ROUNDING = 1e-9
SMALL = 64
MOST_SHARED = 16
FANOUT = 8
LEAF_SETS, LEAF_SHINGLES = 16_384, 1 << 22
SALTS = 16
FILTER_BITS = 1 << 23
RUN_ROWS = 1 << 20


def linked(common: np.ndarray, either: np.ndarray) -> np.ndarray:
    return DENOMINATOR * common >= NUMERATOR * either


def most_apart(n: int, other: int) -> int:
    """The most shingles in which linked sets of n and at most `other` shingles differ."""
    return (n + other) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def largest_partner(n: int) -> int:
    return n * DENOMINATOR // NUMERATOR


MOST_RARE = largest_partner(SMALL - 1)


def _most_apart_in(band: int) -> int:
    top = 2 ** (band + 1) - 1
    return most_apart(top, largest_partner(top))


def shared_in(band: int) -> int:
    """k: how many meeting points linked sets of a band share at least."""
    return 1 + min(MOST_SHARED - 1, _most_apart_in(band) // 4)


def slices_in(band: int) -> int:
    """How many slices sets of 2**band up to 2**(band + 1) shingles are cut into."""
    return math.ceil(1.25 * (_most_apart_in(band) + shared_in(band)))


def _slices(shingles: np.ndarray, band: int, apart: int) -> np.ndarray:
    """Names of the meeting points of a set in the scheme of one band; the band is in the low 6 bits.

    An empty slice is one only where a set of SMALL shingles fills too few, which chance makes
    about as rare as one set in a million.
    """
    count, most = slices_in(band), apart + shared_in(band)
    slot = (shingles % np.uint64(count)).astype(np.int64)
    held = np.bincount(slot, minlength=count)
    total = np.zeros(count, dtype=np.uint64)
    np.add.at(total, slot, scramble(shingles + np.uint64(band + 1)))
    names = scramble(total + np.arange(count, dtype=np.uint64) * np.uint64(2 * band + 3))
    filled = np.flatnonzero(held)
    if len(filled) >= most:
        # the fixed order: slices that hold the most come first, as they are shared by chance the least
        found = names[filled[np.lexsort((names[filled], -held[filled]))[:most]]]
    else:
        blank = np.flatnonzero(held == 0).astype(np.uint64)
        found = np.concatenate([names[filled], scramble(blank * np.uint64(1_000_003) + np.uint64(band))])
    return (found & ~np.uint64(63)) | np.uint64(band)


def slices_of(shingles: np.ndarray) -> np.ndarray:
    """Meeting points of a set of SMALL shingles at least: as the smaller of a pair, in its own band, and as the larger, also in the band below."""
    n = len(shingles)
    if n < SMALL:
        return np.zeros(0, dtype=np.uint64)
    band = n.bit_length() - 1
    found = [_slices(shingles, band, most_apart(n, largest_partner(n)))]
    below = 2**band - 1
    if below >= SMALL and largest_partner(below) >= n:
        found.append(_slices(shingles, band - 1, most_apart(n, n)))
    return np.unique(np.concatenate(found))


def set_digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def shingle_stats(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """key, n_shingles, a digest of the set (null if empty), and the set itself where it is of MOST_RARE shingles at most and another can be close to it."""

    def work(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                sets = shingle_sets(part.column(1), width)
                few = [s.view(np.int64) if len(s) <= MOST_RARE and most_apart(len(s), largest_partner(len(s))) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array(few, pa.list_(pa.int64()))], names=[key, "n_shingles", "digest", "few"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"{key} {kind}, n_shingles bigint, digest binary, few array<bigint>")


def slice_rows(docs: DataFrame, key: str, text: str, bits: np.ndarray | None = None, width: int = WIDTH) -> DataFrame:
    """A row (meeting, key) for each slice that is a meeting point of each document.

    Of equal sets that a task finds, only the first is placed: the others are the same node.
    Without a filter (bits), the rows only have to tell which points have two keys: of each
    run of rows, a point gets two at most, however many sets meet there.
    """

    def rows_of(batches):
        met: set[bytes] = set()
        for batch in batches:
            for part in text_slices(batch, text):
                names, rows = [], []
                for row, shingles in enumerate(shingle_sets(part.column(1), width)):
                    if len(shingles) < SMALL or not part.column(0)[row].is_valid or (digest := set_digest(shingles)) in met:
                        continue
                    met.add(digest)
                    found = slices_of(shingles)
                    if bits is not None:
                        found = found[_passing(found, bits)]
                    names.append(found)
                    rows.append(np.full(len(found), row))
                if names:
                    yield np.concatenate(names), part.column(0), np.concatenate(rows)

    def work(batches):
        held: list = []
        for found in rows_of(batches):
            if bits is not None:
                yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), found[1].take(pa.array(found[2]))], names=["meeting", key])
                continue
            held.append(found)
            if sum(len(x[0]) for x in held) > RUN_ROWS:
                yield _two_of_each(held, key)
                held = []
        if held:
            yield _two_of_each(held, key)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"meeting bigint, {key} {kind}")


def _two_of_each(found: list, key: str) -> pa.RecordBatch:
    """Rows (meeting, key) with one key of each meeting point, or two different ones where it has them."""
    keys = pa.concat_arrays([x[1] for x in found])
    start = np.cumsum([0, *(len(x[1]) for x in found)])
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    names = np.concatenate([x[0] for x in found])
    rows = np.concatenate([x[2] + a for x, a in zip(found, start)])
    order = np.lexsort((codes[rows], names))
    names, rows = names[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(names)) - 1
    last = last[codes[rows[last]] != codes[rows[first]]]
    take = np.concatenate([first, last])
    return pa.RecordBatch.from_arrays([pa.array(names[take].view(np.int64)), keys.take(pa.array(rows[take]))], names=["meeting", key])


def bit_filter(places: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set at the column place modulo their number. It only spares rows: a full one lets all pass to the joins."""
    place = F.pmod("place", F.lit(FILTER_BITS)) + 1
    parts = places.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros((FILTER_BITS // 32_768, 4_096), dtype=np.uint8)
    for row in parts:
        bits[row.part - 1] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return bits.ravel()


def _passing(meetings: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = (meetings >> np.uint64(6)) % np.uint64(FILTER_BITS)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _passes(digest: bytes, bits: np.ndarray) -> bool:
    place = int.from_bytes(digest[:4], "big") % FILTER_BITS
    return bool(bits[place >> 3] >> (place & 7) & 1)


def set_rows(docs: DataFrame, text: str, bits: np.ndarray, width: int = WIDTH) -> DataFrame:
    """digest, n and shingles (the bytes of the sorted hashes) of each row whose set's digest passes the filter; once for equal sets that a task finds."""

    def work(batches):
        met: set[bytes] = set()
        for batch in batches:
            for part in text_slices(batch, text):
                sets = []
                for x in shingle_sets(part.column(0), width):
                    if len(x) and (d := set_digest(x)) not in met and _passes(d, bits):
                        met.add(d)
                        sets.append((d, x))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in sets], pa.binary()), pa.array([len(x) for _, x in sets], pa.int64()), pa.array([x.tobytes() for _, x in sets], pa.binary())], names=["digest", "n", "shingles"])

    return docs.select(text).mapInArrow(work, "digest binary, n bigint, shingles binary")


def _from_pivot(batches):
    """cell, digest, n, pivot, and both sets -> cell, digest, n, pivot, distance and whether they link."""
    for batch in batches:
        own, pivot = ([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(c)] for c in (4, 5))
        common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(own, pivot)], dtype=np.int64)
        either = np.array([len(x) + len(y) for x, y in zip(own, pivot)], dtype=np.int64) - common
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(1 - common / np.maximum(either, 1)), pa.array(linked(common, either))], names=["cell", "digest", "n", "pivot", "distance", "link"])


def _first(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of how many shingles, in an order for all sets, linked sets share one: those of the smaller, and those of the larger."""
    smaller = sizes + (2 * NUMERATOR * sizes) // -(DENOMINATOR + NUMERATOR) + 1
    larger = sizes + (NUMERATOR * sizes) // -DENOMINATOR + 1
    return smaller, larger


def _spanning(names: list[bytes], sets: list[np.ndarray], roots: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Links that connect different roots among the sets of a bounded cell, without all the pairs.

    Shingles are ordered by how many of the sets hold them, the rarest first. A set is compared
    with the sets of at least its size that hold one of its first ones among their own.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(held), dtype=np.int64)
    place[np.argsort(held, kind="stable")] = np.arange(len(held))
    row, token = np.repeat(np.arange(len(sets)), sizes), place[token]
    order = np.lexsort((token, row))
    token, start = token[order], np.concatenate([[0], np.cumsum(sizes)])
    smaller, larger = _first(sizes)
    at = np.arange(len(token)) - start[row]
    among = np.flatnonzero(at < larger[row])
    among = among[np.argsort(token[among], kind="stable")]
    holders, of = row[among], np.searchsorted(token[among], np.arange(len(held) + 1))
    root = np.unique(np.array(roots, dtype=object), return_inverse=True)[1]
    mark, found = np.zeros(len(held), dtype=bool), []
    for x in range(len(sets)):
        first = token[start[x] : start[x] + smaller[x]]
        near = np.unique(np.concatenate([holders[of[t] : of[t + 1]] for t in first]))
        near = near[(root[near] != root[x]) & (sizes[near] >= sizes[x]) & (DENOMINATOR * sizes[x] >= NUMERATOR * sizes[near])]
        if len(near):
            own = token[start[x] : start[x + 1]]
            mark[own] = True
            both = np.concatenate([token[start[y] : start[y + 1]] for y in near])
            common = np.add.reduceat(mark[both].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            mark[own] = False
            for y in near[linked(common, sizes[x] + sizes[near] - common)]:
                if root[y] != root[x]:
                    found.append((names[x], names[y]))
                    root[root == root[y]] = root[x]
    return found


def _cell_links(batches):
    for batch in batches:
        out = []
        for cell in batch.column(0):
            held = {s["digest"].as_py(): (np.frombuffer(s["shingles"].as_buffer(), dtype=np.uint64), s["root"].as_py()) for s in cell}
            out += _spanning(list(held), [x for x, _ in held.values()], [r for _, r in held.values()])
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _first_apart(batches):
    """cell, digest, root and both the set and its pivot's -> the set's first shingles, those that the pivot has not before the others, and whether they are of the smaller's."""
    for batch in batches:
        out, rows = [], []
        for i, (own, pivot) in enumerate(zip(batch.column(3), batch.column(4))):
            own, pivot = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (own, pivot))
            own = own[np.lexsort((own, np.isin(own, pivot, assume_unique=True)))]
            smaller, larger = _first(np.int64(len(own)))
            out.append((own[:larger], np.arange(larger) < smaller))
            rows.append(np.full(larger, i))
        if out:
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(np.concatenate([x for x, _ in out]).view(np.int64)), pa.array(np.concatenate([x for _, x in out]))], names=["cell", "digest", "root", "meeting", "anchor"])


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that edges (a, b) reach from it) of every node that has an edge.

    Each round takes the least root among a node and its neighbours, and then that root's
    root, so rounds grow with the logarithm of the longest path. Many nodes have one root:
    they look it up in salted copies.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        better = saved(roots.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"), salt))
        led = better.groupBy("root").agg(F.lit(1).alias("one")).select(F.col("root").alias("at"))
        jump = better.join(led, F.col("node") == F.col("at")).select("at", F.col("root").alias("far"))
        jump = jump.filter("at <> far").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        jumped = better.join(jump, (better["root"] == jump["at"]) & (better["salt"] == jump["salt"]), "left")
        jumped = saved(jumped.select("node", F.coalesce("far", "root").alias("root"), "was"))
        discard(roots, better)
        roots = jumped.select("node", "root")
        if jumped.filter(F.col("root") != F.col("was")).isEmpty():
            discard(both)
            return roots


def rare_places(stats: DataFrame) -> DataFrame:
    """meeting, digest and anchor of each set of MOST_RARE shingles at most: its rarest shingles, and whether they are among those of the smaller of a pair.

    Linked sets of a <= b shingles share 8a/9 and 4b/5 of them at least, so some shingle is
    among the first of both when each has all but that many, and one more. Where shingles
    are ordered by how many sets hold them, common lines come last.
    """
    rows = stats.filter(F.col("few").isNotNull()).groupBy("digest").agg(F.first("few").alias("few"))
    rows = saved(rows.select("digest", F.size("few").alias("n"), F.explode("few").alias("meeting")))
    counts = rows.groupBy("meeting").agg(F.count("*").alias("holders"))
    ranked = rows.join(counts, "meeting").withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("holders", "meeting")))
    fewest = F.ceil(F.col("n") * F.lit(2 * NUMERATOR) / F.lit(DENOMINATOR + NUMERATOR) - F.lit(ROUNDING))
    most = F.ceil(F.col("n") * F.lit(NUMERATOR) / F.lit(DENOMINATOR) - F.lit(ROUNDING))
    return ranked.filter(F.col("rank") <= F.col("n") - most + 1).select("meeting", "digest", (F.col("rank") <= F.col("n") - fewest + 1).alias("anchor"))


def meeting_places(docs: DataFrame, stats: DataFrame, named: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """meeting, digest: the meeting points that two sets at least may share, less those that a set leaves out. named: id, digest and several (the id has other digests, too)."""
    # which points have two ids: nearly all have one, so they are combined in the tasks by runs and not once more before the shuffle
    spread = slice_rows(docs, key, text, None, width).repartition("meeting").groupBy("meeting").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    shared = saved(spread.filter("low <> high").select("meeting"))
    bits = bit_filter(shared.select(F.shiftrightunsigned("meeting", 6).alias("place")))
    met = slice_rows(docs, key, text, bits, width).join(shared, "meeting").select("meeting", F.col(key).alias("id"))
    met = saved(met.join(named, "id").groupBy("meeting", "digest").agg(F.max("several").alias("several")))
    crowds = met.groupBy("meeting").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    band = F.col("meeting").bitwiseAND(F.lit(63)).cast("int")
    spare = F.element_at(F.array(*(F.lit(shared_in(b)) for b in range(48))), band + 1)
    rank = F.row_number().over(Window.partitionBy("digest", band).orderBy(F.desc("crowd"), "meeting"))
    kept = met.join(crowds, "meeting").withColumn("rank", rank).filter((F.col("rank") >= spare) | F.col("several"))
    return kept.select("meeting", "digest", F.lit(True).alias("anchor")).unionAll(rare_places(stats))


def pivot_cells(places: DataFrame) -> DataFrame:
    """cell (its pivot's digest) and digest: the sets that share a meeting point with a pivot, the pivots included."""
    score = F.count("*").over(Window.partitionBy("digest"))
    places = saved(places.withColumn("score", score))
    best = F.max(F.struct("score", "digest"))
    points = places.groupBy("meeting").agg(best.alias("best"), F.count("*").alias("crowd"), F.max("anchor").alias("anchor")).filter("crowd > 1 and anchor")
    cells = places.join(points.select("meeting", F.col("best.digest").alias("cell")), "meeting").filter("cell <> digest").select("cell", "digest").distinct()
    cells = saved(cells)
    return cells.union(cells.select("cell", F.col("cell").alias("digest")).distinct())


def measured(rows: DataFrame, pivots: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (cell, digest) and pivots (cell, pivot) -> cell, digest, n, pivot, distance, link for each set and pivot of a cell."""
    held = rows.join(sets, "digest")
    fixed = pivots.join(sets.select(F.col("digest").alias("pivot"), F.col("shingles").alias("pivot_shingles")), "pivot")
    both = held.join(fixed, "cell").select("cell", "digest", "n", "pivot", "shingles", "pivot_shingles")
    return both.mapInArrow(_from_pivot, "cell binary, digest binary, n bigint, pivot binary, distance double, link boolean")


def open_rows(region: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (cell, digest, n, pivot, distance, link) that may still link with another root of their cell, inside the window of distances; foreign: not of the pivot's root."""
    rows = region.join(roots, F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("root", "digest")).drop("node")
    # each cell's roots, with the nearest and the farthest of each: few rows a cell and task
    spans = rows.groupBy("cell", "root").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.max(F.col("digest") == F.col("pivot")).alias("main"))
    mains = spans.filter("main").select("cell", F.col("root").alias("main_root"))
    foreign = spans.filter("not main").groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    cells = foreign.join(mains, "cell")
    inside = F.col("distance").between(F.col("near") - EPSILON - ROUNDING, F.col("far") + EPSILON + ROUNDING)
    rows = rows.join(cells, "cell").withColumn("foreign", F.col("root") != F.col("main_root"))
    return rows.filter(F.col("foreign") | inside).select("cell", "digest", "n", "root", "pivot", "foreign")


def cell_sizes(rows: DataFrame) -> DataFrame:
    """cell, the number and the shingles of its sets, of its foreign and of its other sets, and whether it is too large for one task."""
    foreign = F.col("foreign")
    held = lambda flag, what: F.coalesce(F.sum(F.when(flag, what)), F.lit(0))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"), held(foreign, 1).alias("foreign_sets"), held(foreign, F.col("n")).alias("foreign_shingles"), held(~foreign, 1).alias("main_sets"), held(~foreign, F.col("n")).alias("main_shingles"))
    return sizes.withColumn("large", (F.col("sets") > LEAF_SETS) | (F.col("shingles") > LEAF_SHINGLES))


def apart(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of large cells that share one of their first shingles with another root of their cell; the others link with none."""
    pivots = rows.select("cell", "pivot").distinct().join(sets.select(F.col("digest").alias("pivot"), F.col("shingles").alias("pivot_shingles")), "pivot").drop("pivot")
    both = rows.select("cell", "digest", "root").join(sets, "digest").join(pivots, "cell").select("cell", "digest", "root", "shingles", "pivot_shingles")
    first = saved(both.mapInArrow(_first_apart, "cell binary, digest binary, root binary, meeting bigint, anchor boolean"))
    points = first.groupBy("cell", "meeting").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("anchor").alias("anchor")).filter("low <> high and anchor")
    left = first.join(points.select("cell", "meeting"), ["cell", "meeting"]).select("cell", "digest").distinct()
    return rows.join(left, ["cell", "digest"])


def block_links(rows: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of each cell by pairs of its blocks, of which one at least is of foreign sets; a cell that fits in a task is one block."""
    blocks = lambda sets_, shingles: F.greatest(F.lit(1), F.ceil(F.col(sets_) / (LEAF_SETS / 2)), F.ceil(F.col(shingles) / (LEAF_SHINGLES / 2))).cast("int")
    sizes = sizes.select("cell", "large", blocks("foreign_sets", "foreign_shingles").alias("fs"), blocks("main_sets", "main_shingles").alias("ms"))
    own = F.pmod(F.xxhash64(F.lit("block"), "digest"), F.when(F.col("foreign"), F.col("fs")).otherwise(F.col("ms"))).cast("int")
    pair = lambda i, j, across: F.struct(i.alias("i"), j.alias("j"), F.lit(across).alias("across"))
    among = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    foreign = F.concat(among("fs", lambda i: pair(F.least(i, F.col("own")), F.greatest(i, F.col("own")), False)), among("ms", lambda j: pair(F.col("own"), j, True)))
    pairs = F.when(~F.col("large"), F.array(pair(F.lit(0), F.lit(0), True))).when(F.col("foreign"), foreign).otherwise(among("fs", lambda i: pair(i, F.col("own"), True)))
    dealt = rows.join(sizes, "cell").withColumn("own", own).select("cell", "digest", "root", F.explode(pairs).alias("pair"))
    groups = dealt.join(sets, "digest").groupBy("cell", "pair").agg(F.collect_list(F.struct("digest", "root", "shingles")).alias("sets"))
    return groups.select("sets").mapInArrow(_cell_links, "a binary, b binary")


def voronoi(rows: DataFrame, sizes: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Each large cell divided by new pivots of its own, about FANOUT of them: a row for the home cell and for each whose window holds the set."""
    draw = F.xxhash64(F.lit(f"pivot {level}"), "digest")
    drawn = rows.join(sizes.select("cell", "sets"), "cell").withColumn("draw", draw)
    least = drawn.groupBy("cell").agg(F.min_by("digest", "draw").alias("pivot"))
    chosen = drawn.filter(F.pmod("draw", F.lit(1 << 20)) * F.col("sets") < F.lit(FANOUT << 20)).select("cell", F.col("digest").alias("pivot"))
    pairs = saved(measured(rows.select("cell", "digest"), least.union(chosen).distinct(), sets))
    home = pairs.groupBy("cell", "digest").agg(F.min("distance").alias("home"))
    near = pairs.join(home, ["cell", "digest"]).filter(F.col("distance") <= F.col("home") + 2 * EPSILON + ROUNDING)
    return near.select(F.unhex(F.md5(F.concat("cell", "pivot"))).alias("cell"), "digest", "n", "pivot", "distance", "link", F.col("cell").alias("parent"))


def of_pivots(region: DataFrame) -> DataFrame:
    return region.filter(F.col("link") & (F.col("pivot") != F.col("digest"))).select(F.col("pivot").alias("a"), F.col("digest").alias("b"))


def links(docs: DataFrame, stats: DataFrame, named: DataFrame, tied: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """node and root of the sets that links reach. named: id, digest and several (the id has other digests, too); tied: (a, b) that count as linked."""
    members = saved(pivot_cells(meeting_places(docs, stats, named, key, text, width)))
    bits = bit_filter(members.select(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint").alias("place")))
    # sets that meet none stay where they are; only the others are shuffled
    wanted = members.select("digest").distinct()
    sets = saved(set_rows(docs, text, bits, width).groupBy("digest").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")).join(wanted, "digest"))
    region = saved(measured(members, members.select("cell", F.col("cell").alias("pivot")).distinct(), sets)).withColumn("parent", F.lit(None).cast("binary"))
    roots, level, before = components(tied.union(of_pivots(region))), 0, None
    while True:
        rows = saved(open_rows(region, roots))
        if rows.isEmpty():
            return roots
        level += 1
        sizes = saved(cell_sizes(rows))
        made = block_links(rows.join(sizes.filter("not large").select("cell"), "cell"), sizes, sets)
        deep = rows.join(sizes.filter("large").select("cell"), "cell")
        done = deep.isEmpty()
        if not done:
            deep = saved(apart(deep, sets))
            sizes = cell_sizes(deep)
            if before is None:
                sizes = saved(sizes.withColumn("divide", F.col("large")))
            else:
                # a cell that kept nearly all of its parent's sets is not made smaller by pivots
                parents = region.select("cell", "parent").distinct().join(before.select(F.col("cell").alias("parent"), F.col("sets").alias("were")), "parent")
                sizes = saved(sizes.join(parents, "cell").withColumn("divide", F.col("large") & (F.col("sets") < F.lit(0.7) * F.col("were"))))
            made = made.union(block_links(deep.join(sizes.filter("not divide").select("cell"), "cell"), sizes, sets))
            divided = deep.join(sizes.filter("divide").select("cell"), "cell")
            done = divided.isEmpty()
        if not done:
            region, before = saved(voronoi(divided, sizes, sets, level)), sizes
            made = made.union(of_pivots(region))
        roots = components(made.union(roots.filter("node <> root").select("node", "root")))
        if done:
            return roots


def _nodes(stats: DataFrame, key) -> DataFrame:
    """id, digest, the least digest of the id, and several: the id has other digests, too."""
    named = stats.filter(F.col("digest").isNotNull() & key.isNotNull()).select(key.alias("id"), "digest").distinct()
    ids = named.groupBy("id").agg(F.min("digest").alias("first"), (F.count("*") > 1).alias("several"))
    return saved(named.join(ids, "id"))


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, n_shingles and component_id (the least key reachable by links, its own included) of each row."""
    stats = saved(shingle_stats(docs, key, text, width))
    named = _nodes(stats, F.col(key))
    tied = named.filter("first <> digest").select(F.col("first").alias("a"), F.col("digest").alias("b"))
    roots = links(docs, stats, named, tied, key, text, width)
    least = named.groupBy("digest").agg(F.min("id").alias("id")).join(roots, F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("root", "digest"))
    least = saved(least.select("digest", "root", "id"))
    found = least.join(least.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("digest", "component_id")
    # a null id links nothing
    return stats.join(found, "digest", "left").select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id"))


def least_rows(docs: DataFrame, row: str, text: str = "text", width: int = WIDTH) -> DataFrame:
    """The least value of the struct `row` in each component of linked sets; rows of an empty set have none.

    Unlike join_components, rows that share an id are not tied: only their sets link them. A
    row is led from its meeting points to its set by a hash of its text, so near copies meet
    whatever their ids are.
    """
    held = docs.select(F.struct(F.col(row).alias("row"), F.xxhash64(text).alias("of")).alias("held"), F.col(text).alias("body"))
    stats = saved(shingle_stats(held, "held", "body", width).filter(F.col("digest").isNotNull()))
    named = _nodes(stats, F.col("held")["of"])
    tied = named.filter("false").select(F.col("first").alias("a"), F.col("digest").alias("b"))
    roots = links(held.select(F.col("held")["of"].alias("of"), "body"), stats, named, tied, "of", "body", width)
    least = stats.groupBy("digest").agg(F.min("held").alias("held")).join(roots, F.col("digest") == F.col("node"), "left")
    return least.groupBy(F.coalesce("root", "digest").alias("root")).agg(F.min("held").alias("held")).select(F.col("held")["row"].alias(row))
