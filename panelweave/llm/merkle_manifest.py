"""A Merkle manifest of a dataset whose parents keep hash states for each child slot.

Leaves are hashed in the JVM, stand in one order within their group and are cut into blocks
of ARITY ** LEVELS. A block's tree is built in one task; the roots of a group's blocks are
the leaves of the next tier, and so on until each group has one node, its subroot. Subroots
in order of their groups are the leaves of the same kind of tree, which ends in the root.

A parent hashes its children one after another. Before each child slot it keeps a copy of the
hash state (32 bytes, as a child's hex digest fills one block of SHA-256). Folding a changed
leaf resumes the state of its slot with the new digest and the siblings to its right, level
by level up to the root; siblings to the left are not read. They are part of the proof only.

No task holds more than a block. Places in a group come from range-partitioned, sorted runs
and their counts, so a group of any size is spread over all tasks. Rows that are equal in
group, id and leaf are dealt by their place in the input as well.

Defined results: a null group is a group of its own, before all others; null ids come first
in their group; rows of one id are ordered by their leaf; null fields are hashed as `-`.
Very long texts are hashed whole. Extra columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._sha import START, as_bytes, as_states, compress, finished, hex_block
from ._spark import discard, saved

ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
LANES = 6_000
#: one level of a path: the kept state, the siblings right and left of the slot (padded), and how many there are
STEP = np.dtype([("state", np.uint8, 32), ("right", np.uint8, (ARITY - 1, 32)), ("left", np.uint8, (ARITY - 1, 32)), ("rights", np.uint8), ("lefts", np.uint8)])


class Manifest(NamedTuple):
    """tiers: the blocks of each tier of the groups' trees; tops: those of the tree over subroots; root: its digest, None without leaves."""

    tiers: list[DataFrame]
    tops: list[DataFrame]
    subroots: DataFrame
    root: bytes | None


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each as `-` if null, else as byte count, colon and value."""
    said = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said)), 256)


def group_key(group: Column) -> Column:
    """A string that sorts as the group does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit(":"), group.cast("string")), F.lit(""))


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (grp, id, leaf, changed) with pos, the place in the group from 0, and total, its size."""
    order = ["grp", "id", "leaf", "salt"]
    ranged = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = saved(ranged.drop("salt").withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)))
    runs = rows.groupBy("grp", "run").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")
    ahead = F.coalesce(F.sum("n").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("grp", "run", "first", ahead.alias("ahead"), F.sum("n").over(whole).alias("total"))
    return rows.join(runs, ["grp", "run"]).select(*leaves.columns, (F.col("ahead") + F.col("at") - F.col("first")).alias("pos"), "total")


class Trees:
    """The trees of several blocks, level by level. sizes: leaves of each block; whole: which blocks are their group's only one and end with one node."""

    def __init__(self, leaves: np.ndarray, sizes: np.ndarray, whole: np.ndarray):
        self.nodes, self.states, self.sizes = [leaves], [], [sizes]
        alive = np.where(whole, sizes > 1, True)
        for _ in range(LEVELS):
            have = self.nodes[-1]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            up = np.where(alive, -(-sizes // ARITY), 0)
            owner = np.repeat(np.arange(len(sizes)), up)
            at = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(up)])[owner]
            first = starts[owner] + ARITY * at
            count = np.minimum(ARITY, sizes[owner] - ARITY * at)
            state = np.repeat(START[:, None], len(owner), axis=1)
            kept = np.zeros((len(owner), ARITY, 32), dtype=np.uint8)
            for slot in range(ARITY):
                kept[:, slot] = as_bytes(state)
                more = np.flatnonzero(count > slot)
                if len(more):
                    state[:, more] = compress(state[:, more], hex_block(have[first[more] + slot]))
            self.states.append(kept)
            self.nodes.append(finished(state, count))
            self.sizes.append(up)
            sizes = up
            alive = np.where(whole, up > 1, up > 0)
        self.ends = [np.cumsum(s) for s in self.sizes]

    def block(self, b: int) -> tuple[bytes, bytes, bytes]:
        """Digests above the leaves and kept states of block b, lowest level first, and its root."""
        nodes, states, root = [], [], None
        for level, sizes in enumerate(self.sizes):
            end = int(self.ends[level][b])
            part = self.nodes[level][end - sizes[b] : end]
            if sizes[b] == 1 or (level and sizes[b]):
                root = part[-1].tobytes()
            if level and sizes[b]:
                nodes.append(part.tobytes())
                states.append(self.states[level - 1][end - sizes[b] : end].tobytes())
        return b"".join(nodes), b"".join(states), root


def _slices(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of blocks with about LANES leaves."""
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // LANES)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _digests(column: pa.Array) -> np.ndarray:
    """A binary column of digests as (n, 32) bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def built(rows: DataFrame) -> DataFrame:
    """rows (grp, pos, total, leaf, id, changed) -> a row for each block: grp, block, total, items (id, leaf and changed in order), nodes, states and root."""
    item = F.struct("pos", "id", "leaf", "changed")
    blocks = rows.groupBy("grp", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(item)).alias("items"))  # BLOCK rows at most

    def work(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("items").value_lengths()).astype(np.int64)
            for a, b in _slices(sizes):
                part = batch.slice(a, b - a)
                trees = Trees(_digests(part.column("items").flatten().field("leaf")), sizes[a:b], np.asarray(part.column("total")) <= BLOCK)
                made = [trees.block(i) for i in range(b - a)]
                more = [pa.array([m[k] for m in made], pa.binary()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("grp", "block", "total", "items")), *more], names=["grp", "block", "total", "items", "nodes", "states", "root"])

    kind = blocks.schema["items"].dataType.simpleString()
    return saved(blocks.mapInArrow(work, f"grp string, block bigint, total bigint, items {kind}, nodes binary, states binary, root binary"))


def grown(rows: DataFrame) -> list[DataFrame]:
    """The tiers over rows (grp, pos, total, leaf, id, changed) until each group has one node."""
    tiers = [built(rows)]
    while not (more := tiers[-1].filter(F.col("total") > BLOCK)).isEmpty():
        up = more.select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).cast("bigint").alias("total"), F.col("root").alias("leaf"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("binary").alias("changed"))
        tiers.append(built(up))
    return tiers


def tops_of(tiers: list[DataFrame]) -> DataFrame:
    """grp and root of each group's last node."""
    ends = [t.filter(F.col("total") <= BLOCK).select("grp", "root") for t in tiers]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def build(leaves: DataFrame) -> Manifest:
    """The manifest of leaves (grp, id, leaf, changed); changed, the digest of a replaced leaf or null, is carried along for folding."""
    tiers = grown(placed(leaves))
    subroots = saved(tops_of(tiers))
    tops = grown(placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("changed"))))
    root = tops_of(tops).first()
    return Manifest(tiers, tops, subroots, bytes(root["root"]) if root else None)


def steps_of(leaves: np.ndarray, nodes: bytes, states: bytes) -> np.ndarray:
    """The steps (levels, n) of all n leaves of a block to its root."""
    n = have = len(leaves)
    digests, kept = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, 32), np.frombuffer(states, dtype=np.uint8).reshape(-1, ARITY, 32)
    levels, at, index = [], 0, np.arange(n)
    while at < len(kept):
        up = -(-have // ARITY)
        parent, slot = index // ARITY, index % ARITY
        count = np.minimum(ARITY, have - ARITY * parent)
        step = np.zeros(n, dtype=STEP)
        step["state"], step["lefts"], step["rights"] = kept[at + parent, slot], slot, count - slot - 1
        for k in range(ARITY - 1):
            some = np.flatnonzero(step["rights"] > k)
            step["right"][some, k] = leaves[index[some] + k + 1]
            some = np.flatnonzero(slot > k)
            step["left"][some, k] = leaves[ARITY * parent[some] + k]
        levels.append(step)
        leaves, have, index, at = digests[at : at + up], up, parent, at + up
    return np.stack(levels) if levels else np.zeros((0, n), dtype=STEP)


def fold(digests: np.ndarray, steps: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Roots (n, 32) from digests (n, 32) along steps (levels, n), of which the first depth[i] count for i: the state of the slot takes the digest and what stands right of it."""
    now = digests.copy()
    for level, step in enumerate(steps):
        on = np.flatnonzero(depth > level)
        if not len(on):
            break
        s = step[on]
        state = compress(as_states(s["state"]), hex_block(now[on]))
        for k in range(ARITY - 1):
            some = np.flatnonzero(s["rights"] > k)
            if len(some):
                state[:, some] = compress(state[:, some], hex_block(s["right"][some, k]))
        now[on] = finished(state, s["lefts"].astype(np.int64) + s["rights"] + 1)
    return now


def proof_of(steps: np.ndarray) -> bytes:
    """The hex digests of all siblings along steps (levels), lowest level first, left to right."""
    return b"".join(b"".join(x.tobytes() for x in (*s["left"][: s["lefts"]], *s["right"][: s["rights"]])) for s in steps).hex().encode()


def paths_of(tier: DataFrame) -> DataFrame:
    """grp, block, pos and id of each leaf of a tier, and its path within the block."""

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                items, nodes, states = (batch.column(c)[i] for c in ("items", "nodes", "states"))
                steps = steps_of(_digests(items.values.field("leaf")), nodes.as_py(), states.as_py())
                n = steps.shape[1]
                grp, block = (pa.array([batch.column(c)[i].as_py()] * n, batch.column(c).type) for c in ("grp", "block"))
                yield pa.RecordBatch.from_arrays([grp, block, items.values.field("pos"), items.values.field("id"), pa.array([steps[:, k].tobytes() for k in range(n)], pa.binary())], names=["grp", "block", "pos", "id", "path"])

    kind = tier.schema["items"].dataType.elementType["id"].dataType.simpleString()
    return tier.select("grp", "block", "items", "nodes", "states").mapInArrow(work, f"grp string, block bigint, pos bigint, id {kind}, path binary")


def tails(tiers: list[DataFrame], ends: DataFrame) -> DataFrame:
    """grp, block, tail and subroot of each block of the first tier: the path from its root on. ends: grp and tail of each group's last node."""
    out = None
    for k in range(len(tiers) - 1, -1, -1):
        blocks = tiers[k].select("grp", "block", "total", "root")
        last = blocks.filter(F.col("total") <= BLOCK).join(ends, "grp").select("grp", "block", "tail", F.col("root").alias("subroot"))
        if out is not None:
            up = paths_of(tiers[k + 1]).withColumnRenamed("block", "over").join(out.withColumnRenamed("block", "over"), ["grp", "over"])
            last = last.unionByName(up.select("grp", F.col("pos").alias("block"), F.concat("path", "tail").alias("tail"), "subroot"))
        out = last
    return out


def folded(manifest: Manifest) -> DataFrame:
    """grp, id, leaf, subroot, root, proof_sha256, folded_root and verified of each leaf; the changed digest is folded where there is one, else the leaf."""
    first, root = manifest.tiers[0], manifest.root or b""
    nothing = first.sparkSession.range(1).select(F.lit("").alias("grp"), F.unhex(F.lit("")).alias("tail"))
    ends = paths_of(manifest.tops[0]).join(tails(manifest.tops, nothing), ["grp", "block"]).select(F.col("id").alias("grp"), F.concat("path", "tail").alias("tail"))
    whole = first.join(tails(manifest.tiers, ends), ["grp", "block"])
    kind = first.schema["items"].dataType.elementType["id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("items").value_lengths()).astype(np.int64)
            for a, b in _slices(sizes):
                part = batch.slice(a, b - a)
                items = part.column("items").flatten()
                leaves = _digests(items.field("leaf"))
                ends = np.cumsum(sizes[a:b])
                own = [steps_of(leaves[end - n : end], part.column("nodes")[i].as_py(), part.column("states")[i].as_py()) for i, (end, n) in enumerate(zip(ends, sizes[a:b]))]
                rest = [np.frombuffer(x, dtype=STEP) for x in part.column("tail").to_pylist()]
                depth = np.concatenate([np.full(s.shape[1], len(s) + len(r)) for s, r in zip(own, rest)])
                steps, proofs, at = np.zeros((int(depth.max()), len(leaves)), dtype=STEP), [], 0
                for s, r in zip(own, rest):
                    n = s.shape[1]
                    steps[: len(s), at : at + n] = s
                    steps[len(s) : len(s) + len(r), at : at + n] = r[:, None]
                    shared = proof_of(r)
                    proofs += [hashlib.sha256(proof_of(s[:, k]) + shared).hexdigest() for k in range(n)]
                    at += n
                changed = items.field("changed").to_pylist()
                start = leaves.copy()
                for i, c in enumerate(changed):
                    if c is not None:
                        start[i] = np.frombuffer(c, dtype=np.uint8)
                roots = [x.tobytes() for x in fold(start, steps, depth)]
                owner = np.repeat(np.arange(b - a), sizes[a:b])
                yield pa.RecordBatch.from_arrays(
                    [part.column("grp").take(pa.array(owner)), items.field("id"), pa.array([x.tobytes().hex() for x in leaves]), part.column("subroot").take(pa.array(owner)), pa.array(proofs, pa.string()), pa.array([x.hex() for x in roots], pa.string()), pa.array([x == root for x in roots])],
                    names=["grp", "id", "leaf", "subroot", "proof_sha256", "folded_root", "verified"],
                )

    found = whole.select("grp", "items", "nodes", "states", "tail", "subroot").mapInArrow(work, f"grp string, id {kind}, leaf string, subroot binary, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumn("subroot", F.lower(F.hex("subroot"))).withColumn("root", F.lit(root.hex()))


def manifest_report(docs: DataFrame, changed: Column, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256 (untampered), folded_root and verified; changed: the text after tampering, or null where a row is left alone."""
    new = leaf_hash(*(F.col("changed") if f == text else F.col(f) for f in fields))
    was = leaf_hash(*(F.col(f) for f in fields))
    rows = docs.select(*dict.fromkeys((key, group, *fields))).withColumn("changed", changed)
    leaves = saved(rows.select(group_key(F.col(group)).alias("grp"), F.col(key).alias("id"), F.unhex(was).alias("leaf"), F.when(F.col("changed").isNotNull(), F.unhex(new)).alias("changed")))
    manifest = build(leaves)
    discard(leaves)
    return folded(manifest).select(F.col("id").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
