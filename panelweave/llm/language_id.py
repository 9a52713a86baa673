"""Word-first language identification with backoff to character n-grams.

A word that training knows is scored in each language by the logarithm of its frequency
there. A word that it does not know falls back to its character n-grams of the longest
length of which any is known, and from that to shorter ones. Scores add up over the text.

The model is fitted on a bounded sample of labelled rows: SAMPLE_BYTES of text are expected,
the same share of them for each language, and each language has one row at least, so no
language is lost however rare it is. Rows are drawn by a hash of id and text. All words and
n-grams of the sample are learned; they are counted in Spark, and workers get them as sorted
64-bit hashes with a log frequency for each language that has them. The sample bounds the
size of the model for any input and any number of languages.

Defined results: null text or text without a letter (Unicode category L) is "und" with score 0. Rows with null
language are not learned from. Ties go to the language first in code-point order. With no
labelled rows every prediction is "und". Very long texts are scored whole. Repeated rows
score alike; rows with a null id are not held out. Extra columns do not matter; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import discard, saved

SAMPLE_BYTES = 24 << 20
LONGEST = 4
FLOOR = 0.5
MEMO_CELLS = 4_000_000
NOWHERE = "und"
# fixed value: the seed with which Spark's xxhash64 starts
HASH_SEED = 42
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters, lower-cased. `re` also takes fractions, raised numbers and the like for parts of words; where there are any, they part words."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split()]


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def word_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, item and count of each word."""

    def work(batches):
        for batch in batches:
            tally: Counter = Counter()
            for tongue, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tally.update((tongue, word) for word in words_of(body or ""))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], names=["lang", "item", "count"])

    return docs.select(lang, text).mapInArrow(work, "lang string, item string, count bigint").groupBy("lang", "item").agg(F.sum("count").alias("count"))


def gram_counts(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, n, item and count of each character n-gram of the words, which stand between < and >."""
    padded = words.select("lang", F.concat(F.lit("<"), F.col("item"), F.lit(">")).alias("word"), "count")
    sizes = F.explode(F.sequence(F.lit(1), F.lit(longest)))
    starts = F.when(F.length("word") >= F.col("n"), F.sequence(F.lit(1), F.length("word") - F.col("n") + 1))
    parts = padded.withColumn("n", sizes).withColumn("at", F.explode(starts))
    return parts.groupBy("lang", "n", F.substring("word", F.col("at"), F.col("n")).alias("item")).agg(F.sum("count").alias("count"))


def drawn(docs: DataFrame, key: str, lang: str, text: str, most: int = SAMPLE_BYTES) -> DataFrame:
    """The training sample of rows with a language and a text: about `most` bytes, as many of each language, and one row of each at least."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("sample"), key, text).alias("draw"))
    tongues = labelled.groupBy("lang").agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes"), F.min("draw").alias("least")).collect()
    if not tongues:
        return labelled
    share = most / len(tongues)
    # a draw is uniform in 64 bits; the threshold is the expected part of the language
    until = {r.lang: min(2**63 - 1, -(2**63) + int(min(1.0, share / max(1, r.bytes)) * 2**64)) for r in tongues}
    limits = F.create_map(*(F.lit(x) for r in tongues for x in (r.lang, max(until[r.lang], r.least))))
    return labelled.filter(F.col("draw") <= F.element_at(limits, F.col("lang")))


def fit(docs: DataFrame, key: str, lang: str, text: str, most: int = SAMPLE_BYTES) -> dict:
    """The model: languages, sorted hashes of items (words and n-grams by length), for each item the languages that have it with its log frequencies there, and floors for those that do not."""
    words = saved(word_counts(drawn(docs, key, lang, text, most), "lang", "text"))
    items = saved(words.select("lang", F.lit(0).alias("n"), "item", "count").unionAll(gram_counts(words)))
    totals = {(r.lang, r.n): r.total for r in items.groupBy("lang", "n").agg(F.sum("count").alias("total")).collect()}
    tongues = sorted({t for t, _ in totals})
    total = np.array([[totals.get((t, n), 0) for t in tongues] for n in range(LONGEST + 1)], dtype=np.float64).reshape(LONGEST + 1, len(tongues))
    if not tongues:
        return {"langs": [], "items": np.zeros(0, dtype=np.int64), "starts": np.zeros(1, dtype=np.int64), "tongues": np.zeros(0, dtype=np.int32), "logs": np.zeros(0), "floors": np.zeros((LONGEST + 1, 1))}
    place = F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(tongues) for x in (t, i))), F.col("lang"))
    hashed = F.xxhash64(F.concat_ws(":", "n", "item"))
    table = items.select(hashed.alias("item"), "n", place.alias("tongue"), "count").toArrow()
    column = lambda name: np.asarray(table[name].combine_chunks())
    item, tongue = column("item"), column("tongue").astype(np.int32)
    order = np.lexsort((tongue, item))
    known, starts = np.unique(item[order], return_index=True)
    logs = np.log(column("count") / total[column("n"), tongue])
    discard(words, items)
    return {"langs": tongues, "items": known, "starts": np.append(starts, len(order)), "tongues": tongue[order], "logs": logs[order], "floors": np.log(FLOOR / (total + 1))}


def item_hash(n: int, item: str) -> int:
    return xxhash.xxh64_intdigest(f"{n}:{item}", HASH_SEED)


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.items, self.starts, self.tongues, self.logs, self.floors = (model[k] for k in ("langs", "items", "starts", "tongues", "logs", "floors"))
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.matrix = np.zeros((0, self.floors.shape[1]))

    def _rows(self, hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Which items the model knows, and the rows of those."""
        wanted = np.array(hashes, dtype=np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.items, wanted), max(0, len(self.items) - 1))
        known = self.items[at] == wanted if len(self.items) else np.zeros(len(wanted), dtype=bool)
        return known, at[known]

    def _add(self, out: np.ndarray, into: np.ndarray, rows: np.ndarray, n: int) -> None:
        """Add the log frequencies of items of length n to the rows `into` of out."""
        out += np.bincount(into, minlength=len(out))[:, None] * self.floors[n]
        size = self.starts[rows + 1] - self.starts[rows]
        at = np.arange(size.sum()) + np.repeat(self.starts[rows] - np.cumsum(size) + size, size)
        np.add.at(out, (np.repeat(into, size), self.tongues[at]), self.logs[at] - self.floors[n, self.tongues[at]])

    def learn(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word: its own, or the mean over its n-grams of the longest length with a known one."""
        out = np.zeros((len(words), self.floors.shape[1]))
        known, rows = self._rows([item_hash(0, w) for w in words])
        self._add(out, np.flatnonzero(known), rows, 0)
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            parts = [grams(words[i], n) for i in left]
            owner = np.repeat(np.arange(len(left)), [len(p) for p in parts])
            if len(owner):
                known, rows = self._rows([item_hash(n, g) for p in parts for g in p])
                count = np.bincount(owner[known], minlength=len(left))
                total = np.zeros((len(left), self.floors.shape[1]))
                self._add(total, owner[known], rows, n)
                out[left[count > 0]] = total[count > 0] / count[count > 0, None]
                left = left[count == 0]
        return out

    def scores(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Sums of log frequencies by language; None without a letter."""
        split = [words_of(t) if t else [] for t in texts]
        if len(self.memo) * len(self.langs) > MEMO_CELLS:
            self._forget()
        new = [w for w in set().union(*split) if w not in self.memo] if split else []
        if new:
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
            self.matrix = np.concatenate([self.matrix, self.learn(new)])
        return [self.matrix[np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))].sum(0) if words else None for words in split]


def predict(docs: DataFrame, model: dict, key: str, text: str) -> DataFrame:
    """key, lang_pred, score: the most likely language and its probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                names, values = [], []
                for sums in scorer.scores(part.column(1).to_pylist()):
                    if sums is None or not scorer.langs:
                        names.append(NOWHERE)
                        values.append(0.0)
                        continue
                    best = int(np.argmax(sums))
                    names.append(scorer.langs[best])
                    values.append(float(1.0 / np.exp(np.maximum(sums - sums[best], -700.0)).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"{key} {kind}, lang_pred string, score double")


def held_out(key: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, and predict all rows."""
    model = fit(docs.filter(~held_out(F.col(key))), key, lang, text)
    return predict(docs, model, key, text).select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
