"""Spelling variants: words one edit apart, and the much more frequent word that each stands for.

The vocabulary is counted over whole texts. Its words set bits in blocked Bloom filters, a
filter for each length; a word's hash picks one block of 512 bits and BITS bits in it. Every
word's neighbourhood is generated as hashes alone: each deletion, and each replacement by a
later letter of the alphabet, so a pair of near words is generated from one side only and
once. Only what a filter lets through becomes a string, and is joined with the vocabulary
itself, which removes the false positives. So no pair is missed, and none is wrong.

Filters are broadcast in bundles of at most BUNDLE_BYTES, however large the vocabulary is: a
length with more words than one bundle holds is split by hash, and each bundle is a pass over
the words whose neighbourhoods reach it. A word of any length is probed in runs of positions.

Frequencies grow at least FACTOR-fold along a chain of forms, so following it takes a number
of rounds that is logarithmic in the counts, and fewer as each round doubles the step.

Defined results: null text has no words; a null id stands as the empty text in the hash that
plants misspellings; repeated rows count again; of near words with equal counts the first in
code-point order is the form; extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import scramble, text_slices
from ._spark import discard, saved

#: the letters of a word, once A-Z are lower-cased
ALPHABET = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
LEAST_LETTERS, LEAST_COUNT, FACTOR, TYPO = 6, 5, 5, 199
BITS, WORD_BITS, BLOCK_BITS = 6, 16, 512
BUNDLE_BYTES = 32 << 20
LONG = 64
TALLY_WORDS = 200_000
PROBES = 1 << 18

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_STEP = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_STEP, -1, 2**64))
_CODE = np.zeros(256, dtype=np.uint64)
_CODE[[ord(c) for c in ALPHABET]] = np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, len(ALPHABET), dtype=np.uint64)
_LETTERS = np.array([ord(c) for c in ALPHABET], dtype=np.uint8)


def occurrences(docs: DataFrame, key: str, text: str, typo: int = TYPO) -> DataFrame:
    """word and n of each run of letters, lower-cased; where `typo` divides crc32 of `id:run`, the run stands without one letter. typo 0: as they are."""

    def work(batches):
        tally: Counter = Counter()

        def told():
            words = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])
            tally.clear()
            return words

        for batch in batches:
            for part in text_slices(batch, "body"):
                for name, body in zip(part.column("name").to_pylist(), part.column("body").to_pylist()):
                    seen = Counter(_RUN.findall((body or "").translate(_LOWER)))
                    start = zlib.crc32(f"{name or ''}:".encode())
                    for run, n in seen.items() if typo else ():
                        h = zlib.crc32(run.encode(), start)
                        if h % typo == 0:
                            at = h % len(run)
                            tally[run[:at] + run[at + 1 :]] += n
                            tally[run] -= n
                    tally.update(seen)
                    if len(tally) > TALLY_WORDS:
                        yield told()
        yield told()

    sent = docs.select(F.col(key).cast("string").alias("name"), F.col(text).alias("body"))
    return sent.mapInArrow(work, "word string, n bigint")


def vocabulary(docs: DataFrame, key: str, text: str, typo: int = TYPO, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of at least `letters` code points that occur `count` times or more."""
    long = occurrences(docs, key, text, typo).filter(F.length("word") >= letters)
    return long.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


class Hashes:
    """Hashes of the words of a batch, and of what their edits give, without the strings."""

    def __init__(self, words: list[str]):
        self.words = words
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.letters = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        longest = int(self.sizes.max(initial=0))
        steps = np.full(longest + 1, _STEP, dtype=np.uint64)
        steps[0] = 1
        self.power = np.multiply.accumulate(steps)
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.letters)) - self.starts[self.owner]
        term = _CODE[self.letters] * self.power[self.place]
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(term)])
        self.whole = self.sums[self.ends] - self.sums[self.starts]

    def deletions(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions a to b (of the joined letters) whose deletion gives a string of its own, and the hashes of these strings."""
        at = np.arange(a, b)
        first = self.place[a:b] == 0
        at = at[first | (self.letters[a:b] != self.letters[np.maximum(at - 1, 0)])]
        own = self.owner[at]
        before, after = self.sums[at] - self.sums[self.starts[own]], self.sums[self.ends[own]] - self.sums[at + 1]
        return at, before + after * _BACK

    def replacements(self, a: int, b: int, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions a to b that hold an earlier letter than this, and the hashes of the words with this letter there."""
        at = np.arange(a, b)[self.letters[a:b] < letter]
        return at, self.whole[self.owner[at]] + (_CODE[letter] - _CODE[self.letters[at]]) * self.power[self.place[at]]


def slot_of(sizes: np.ndarray) -> np.ndarray:
    """The filter of words of these lengths; all longer ones share one."""
    return np.minimum(sizes, LONG)


def marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in its filter a hash stands (64 bits, of which a multiple picks part and block), and its bits as 8 words of 64."""
    where, inner = scramble(hashes), scramble(hashes ^ np.uint64(_STEP))
    bits = np.zeros((len(hashes), BLOCK_BITS // 64), dtype=np.uint64)
    rows = np.arange(len(hashes))
    for k in range(BITS):
        bit = (inner >> np.uint64(9 * k)) & np.uint64(BLOCK_BITS - 1)
        bits[rows, (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
    return where, bits


def _split(where: np.ndarray, n: int) -> np.ndarray:
    """Hashes dealt over n cells by their upper 32 bits."""
    return (((where >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def bundles(words: DataFrame, most: int = BUNDLE_BYTES) -> list[list[tuple[int, int, int, int]]]:
    """(slot, blocks of the slot's filter, first and last block but one) in runs of at most `most` bytes."""
    rows = words.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("slot")).agg(F.count("*").alias("n")).orderBy("slot").collect()  # a row for each length up to LONG
    out, room = [[]], most // (BLOCK_BITS // 8)
    for r in rows:
        blocks, at = -(-r.n * WORD_BITS // BLOCK_BITS), 0
        while at < blocks:
            if not room:
                out.append([])
                room = most // (BLOCK_BITS // 8)
            n = min(room, blocks - at)
            out[-1].append((r.slot, blocks, at, at + n))
            at, room = at + n, room - n
    return [b for b in out if b]


def filters(words: DataFrame, bundle: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int, np.ndarray]]:
    """The bundle's blocks: slot -> (blocks of the whole filter, first block held, bits). Bounded by the bundle."""
    wanted = {slot: (blocks, a, b) for slot, blocks, a, b in bundle}

    def work(batches):
        for batch in batches:
            h = Hashes(batch.column(0).to_pylist())
            slots = slot_of(h.sizes)
            where, bits = marks(h.whole)
            block = np.full(len(slots), -1)
            for slot, (blocks, a, b) in wanted.items():
                on = np.flatnonzero(slots == slot)
                at = _split(where[on], blocks)
                block[on] = np.where((at >= a) & (at < b), at - a, -1)
            on = np.flatnonzero(block >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(slots[on], pa.int64()), pa.array(block[on], pa.int64()), *(pa.array(bits[on, k].view(np.int64)) for k in range(8))], names=["slot", "block", *(f"m{k}" for k in range(8))])

    masks = ", ".join(f"m{k} bigint" for k in range(8))
    near = words.filter(F.least(F.length("word"), F.lit(LONG)).isin(*wanted)).select("word")
    rows = near.mapInArrow(work, f"slot bigint, block bigint, {masks}").groupBy("slot", "block").agg(*(F.bit_or(f"m{k}").alias(f"m{k}") for k in range(8))).toArrow()
    slots, block = np.asarray(rows["slot"].combine_chunks()), np.asarray(rows["block"].combine_chunks())
    bits = np.stack([np.asarray(rows[f"m{k}"].combine_chunks()).view(np.uint64) for k in range(8)], axis=1) if rows.num_rows else np.zeros((0, 8), np.uint64)
    out = {}
    for slot, (blocks, a, b) in wanted.items():
        held, on = np.zeros((b - a, 8), dtype=np.uint64), slots == slot
        held[block[on]] = bits[on]
        out[slot] = (blocks, a, held)
    return out


def passed(hashes: np.ndarray, slots: np.ndarray, held: dict[int, tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Which hashes the filters of their slots let through; none of a slot or block that the bundle lacks."""
    out = np.zeros(len(hashes), dtype=bool)
    where = scramble(hashes)
    for slot in np.unique(slots):
        if int(slot) not in held:
            continue
        blocks, a, bits = held[int(slot)]
        on = np.flatnonzero(slots == slot)
        at = _split(where[on], blocks) - a
        inside = (at >= 0) & (at < len(bits))
        on, at = on[inside], at[inside]
        inner = scramble(hashes[on] ^ np.uint64(_STEP))
        for k in range(BITS):  # most fail at the first bits
            bit = (inner >> np.uint64(9 * k)) & np.uint64(BLOCK_BITS - 1)
            fine = (bits[at, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            on, at, inner = on[fine], at[fine], inner[fine]
        out[on] = True
    return out


def probed(words: DataFrame, held: dict[int, tuple[int, int, np.ndarray]]) -> DataFrame:
    """word, n and candidate: the edits of words that the filters let through."""
    sent = words.sparkSession.sparkContext.broadcast(held)
    reach = {s for slot in held for s in (slot, slot + 1)} | ({LONG} if LONG in held else set())

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                names, counts = part.column(0).to_pylist(), part.column(1).to_pylist()
                h = Hashes(names)
                whose, edits = [], []
                for a in range(0, len(h.letters), PROBES):
                    b = min(a + PROBES, len(h.letters))
                    for letter in (0, *_LETTERS.tolist()):
                        at, hashes = h.replacements(a, b, letter) if letter else h.deletions(a, b)
                        at = at[passed(hashes, slot_of(h.sizes[h.owner[at]] - (0 if letter else 1)), sent.value)]
                        for p, w, i in zip(h.place[at].tolist(), h.owner[at].tolist(), at):
                            whose.append(w)
                            edits.append(names[w][:p] + (chr(letter) if letter else "") + names[w][p + 1 :])
                yield pa.RecordBatch.from_arrays([pa.array([names[w] for w in whose], pa.string()), pa.array([counts[w] for w in whose], pa.int64()), pa.array(edits, pa.string())], names=["word", "n", "candidate"])

    near = words.filter(F.least(F.length("word"), F.lit(LONG)).isin(*reach))
    return near.select("word", "n").mapInArrow(work, "word string, n bigint, candidate string")


def near_pairs(words: DataFrame, most: int = BUNDLE_BYTES) -> DataFrame:
    """word, n, near and near_n of all words one edit apart, each pair both ways."""
    target = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    out = None
    for bundle in bundles(words, most):
        found = probed(words, filters(words, bundle)).join(target, F.col("candidate") == F.col("near")).select("word", "n", "near", "near_n")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    pair = lambda a, b, m, n: F.struct(F.col(a).alias("word"), F.col(m).alias("n"), F.col(b).alias("near"), F.col(n).alias("near_n"))
    return out.select(F.explode(F.array(pair("word", "near", "n", "near_n"), pair("near", "word", "near_n", "n"))).alias("p")).select("p.*")


def roots(links: DataFrame) -> DataFrame:
    """word and root of each word with a form: the end of its chain. links: word and form; chains end, as counts grow along them."""
    now = saved(links.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", typo: int = TYPO, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, factor: int = FACTOR, most: int = BUNDLE_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the vocabulary."""
    words = saved(vocabulary(docs, key, text, typo, letters, count))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(near, "word", "left")
    stands = -F.col("best.minus") >= factor * F.col("n")
    rows = saved(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(stands, F.col("best.near")).alias("form"), F.when(stands, -F.col("best.minus")).alias("form_n")))
    ends = roots(rows.filter("form is not null"))
    discard(words)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
