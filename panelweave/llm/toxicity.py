"""A toxicity classifier that is regularised by counterfactual identity terms.

A text is a bag of hashed words and word beginnings, each worth its count over the root of
the text's length, so long texts are not louder than short ones. A first pass over a bounded
sample of labelled rows keeps the features whose presence goes with the label; a logistic
scorer is trained on those. Each sampled text that names a group has counterfactual twins, in
which its identity terms are swapped for others of their kind, and in one for a blank. The
loss adds the squared change of the score (before the sigmoid) between a text and its twins,
so a mention of a group by itself moves the score neither up nor down, whatever the labelled
rows happen to say about that group or about groups at all.

The sample is of about SAMPLE_BYTES of text, half of it with either label, drawn by a hash of
id and text, and either label weighs the same in the loss. The groups and terms are a
parameter; where no labelled text names a group there are no twins, and the term is zero.

Defined results: null and empty texts, and texts without a letter, get the score of a text
without features. Rows without a label are scored and not learned from; a row that is labelled
more than once is toxic if one label says so. Rows with a null id are never learned from.
Very long texts are scored whole. Repeated rows score alike. Extra columns do not matter.
Without labelled rows of both kinds every score is the smoothed share of toxic labels. An
empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import MIX, _LETTERS, _power_tables, raw, scramble, text_slices
from ._spark import discard, saved
from .language_id import held_out

SAMPLE_BYTES = 24 << 20
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6, 7, 8)
CALM = 20
CLEAR = 3.0
STEPS, RATE, SHRINK, SAME = 300, 0.1, 2e-5, 1.0
TWINS, BLANK = 3, "-"
FEW_ROWS = 200_000

#: terms of one kind stand for each other in a counterfactual; lower-cased, in the languages of the corpus
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("asian", "african", "european", "american", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
)

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Features:
    """Buckets of the words of each text and of their beginnings. Words are runs of ASCII letters and bytes from 128 on; A-Z and À-Þ are lower-cased."""

    def __init__(self, column: pa.Array):
        data, self.rows = raw(column)
        n = len(data)
        low = _LOWER[data]
        second = np.zeros(n, dtype=bool)
        second[1:] = data[:-1] == 0xC3
        low[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
        solid, edge = _WORD[data], np.zeros(n + 1, dtype=bool)
        edge[self.rows] = True
        before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
        self.low = low
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, self.rows)
        up, self.down = _power_tables(n + 1)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[low] * up[:n], out=self.total[1:])
        self.row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.bounds))
        self.scale = 1 / np.sqrt(np.diff(self.bounds) + CALM)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of every word and beginning."""
        rows, buckets = [self.row], [self._buckets(self.starts, self.ends, 1)]
        for n in BEGINNINGS:
            on = np.flatnonzero(self.ends - self.starts >= n)
            rows.append(self.row[on])
            buckets.append(self._buckets(self.starts[on], self.starts[on] + n, 2))
        return np.concatenate(rows), np.concatenate(buckets)

    def _buckets(self, a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        h = (self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64) * MIX + np.uint64(kind)
        return (scramble(h) & np.uint64(BUCKETS - 1)).astype(np.int64)

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        out = np.zeros(len(self.scale))
        word = self._buckets(self.starts, self.ends, 1)
        out += np.bincount(self.row, weights[word], len(out))
        for n in BEGINNINGS:
            on = np.flatnonzero(self.ends - self.starts >= n)
            out += np.bincount(self.row[on], weights[self._buckets(self.starts[on], self.starts[on] + n, 2)], len(out))
        return bias + self.scale * out


def word_key(word: str) -> int:
    """The bucket of a whole word."""
    f = Features(pa.array([word]))
    return int(f._buckets(f.starts, f.ends, 1)[0])


def twins(texts: list[str], terms: tuple = IDENTITY_TERMS, most: int = TWINS) -> tuple[list[int], list[str]]:
    """For each text that names a group, copies in which every identity term is a blank, the next of its kind, the second next and so on, `most` of its kind: (text it comes from, copy)."""
    kinds = {word: (kind, i) for kind in terms for i, word in enumerate(kind)}
    if not kinds:
        return [], []
    names = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(map(re.escape, kinds), key=len, reverse=True)) + r")(?![^\W\d_])", re.IGNORECASE)
    whose, copies = [], []
    for i, text in enumerate(texts):
        if names.search(text):
            for step in range(most + 1):

                def other(m, step=step):
                    kind, at = kinds.get(m[0].lower(), ((m[0],), 0))
                    return kind[(at + step) % len(kind)] if step else BLANK

                whose.append(i)
                copies.append(names.sub(other, text))
    return whose, copies


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the distinct features of each text, made in slices of a few MB."""
    rows, buckets, values, at = [], [], [], 0
    for part in text_slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["body"]), "body"):
        f = Features(part.column(0))
        row, bucket = f.pairs()
        seen, count = np.unique(row * BUCKETS + bucket, return_counts=True)
        rows.append((seen // BUCKETS + at).astype(np.int32))
        buckets.append((seen % BUCKETS).astype(np.int32))
        values.append((f.scale[seen // BUCKETS] * count).astype(np.float32))
        at += part.num_rows
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((rows, np.int32), (buckets, np.int32), (values, np.float32)))


def clear_features(rows: np.ndarray, buckets: np.ndarray, target: np.ndarray, least: float = CLEAR) -> np.ndarray:
    """Whether the presence of each bucket differs between the labels by `least` standard errors; rows and buckets are distinct pairs."""
    with_, n = np.bincount(buckets, target[rows], BUCKETS), np.bincount(buckets, minlength=BUCKETS)
    pos, all_ = target.sum(), len(target)
    share = (n + 1) / (all_ + 2)
    error = np.sqrt(share * (1 - share) * (1 / max(pos, 1) + 1 / max(all_ - pos, 1)))
    return (np.abs(with_ / max(pos, 1) - (n - with_) / max(all_ - pos, 1)) / error >= least) & (n > 1)


def train(texts: list[str], target: np.ndarray, terms: tuple = IDENTITY_TERMS, same: float = SAME, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights by bucket and intercept: logistic loss, ridge, and `same` times the mean squared change of the score between a text and its twins."""
    weights = np.zeros(BUCKETS)
    whose, copies = twins(texts, terms)
    row, bucket, value = bags(texts + copies)
    real = row < len(texts)
    keep = clear_features(row[real], bucket[real], target)
    keep[[word_key(w) for kind in terms for w in kind]] |= bool(copies)
    on = keep[bucket]
    row, bucket, value = row[on], bucket[on], value[on].astype(np.float64)
    columns, at = np.unique(bucket, return_inverse=True)
    rows = len(texts) + len(copies)
    n, d = len(texts), len(columns)
    w, b = np.zeros(d), math.log((target.sum() + 1) / (len(target) - target.sum() + 1))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    whose = np.array(whose, dtype=np.int64)
    # either label weighs the same
    weight = np.where(target > 0, 0.5 / max(target.sum(), 1), 0.5 / max(n - target.sum(), 1))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[at] * value, rows)
        slope = np.zeros(rows)
        slope[:n] = weight * (1 / (1 + np.exp(-np.clip(b + z[:n], -50, 50))) - target)
        gb = slope.sum()
        if len(whose):
            change = 2 * same / len(whose) * (z[whose] - z[n:])
            slope[:n] += np.bincount(whose, change, n)
            slope[n:] -= change
        g = np.bincount(at, slope[row] * value, d) + SHRINK * w
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights[columns] = w
    return weights, float(b)


def drawn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = SAMPLE_BYTES) -> tuple[DataFrame, float]:
    """text and label of the training sample: about `most` bytes, half of either label, never a row that is held out; and the smoothed share of toxic rows."""
    said = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("of")).agg(F.max(F.col(label).cast("int")).alias("label"))
    rows = docs.filter(F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("of"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    draw = F.xxhash64(F.lit("toxicity"), "of", "body")
    known = saved(rows.select("of", F.octet_length("body").cast("bigint").alias("bytes"), draw.alias("draw")).join(said, "of"))
    sums = {r["label"]: r for r in known.groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}  # two rows
    until = {k: min(2**63 - 1, -(2**63) + int(min(1.0, most / 2 / max(1, r["bytes"])) * 2**64)) for k, r in sums.items()}
    limit = F.when(F.col("label") > 0, F.lit(until.get(1, -(2**63)))).otherwise(F.lit(until.get(0, -(2**63))))
    chosen = saved(known.filter((F.col("draw") <= limit) & (F.col("bytes") > 0)).select("of", "draw", "label").distinct())
    small = F.broadcast(chosen) if chosen.count() <= FEW_ROWS else chosen
    toxic, all_ = sums[1]["n"] if 1 in sums else 0, sum(r["n"] for r in sums.values())
    sample = rows.withColumn("draw", draw).join(small, ["of", "draw"]).select("of", "body", "label")
    discard(known)
    return sample, (toxic + 1) / (all_ + 2)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE_BYTES, terms: tuple = IDENTITY_TERMS, same: float = SAME) -> dict:
    """The scorer: weights (by bucket, only those that are not zero), bias."""
    sample, share = drawn(docs, labels, key, text, label, most)

    def work(batches):
        texts, target = [], []
        for batch in batches:
            texts += batch.column("body").to_pylist()
            target += batch.column("label").to_pylist()
        goal = np.array(target, dtype=np.float64)
        if 0 < goal.sum() < len(goal):
            weights, bias = train(texts, goal, terms, same)
            on = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array([on.tolist()], pa.list_(pa.int64())), pa.array([weights[on].tolist()], pa.list_(pa.float64())), pa.array([bias], pa.float64())], names=["at", "weights", "bias"])

    one = sample.repartition(1).sortWithinPartitions("of", F.xxhash64("body"))  # bounded by SAMPLE_BYTES
    row = one.mapInArrow(work, "at array<bigint>, weights array<double>, bias double").first()
    silent = math.log(share / (1 - share))
    if row is None:
        return {"at": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": silent}
    return {"at": np.array(row["at"], dtype=np.int64), "weights": np.array(row["weights"]), "bias": row["bias"]}


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score, the probability of label 1."""
    weights = np.zeros(BUCKETS)
    weights[model["at"]] = model["weights"]
    bias = model["bias"]
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batches):
        for batch in batches:
            for part in text_slices(batch, "body"):
                z = Features(part.column(1)).logits(sent.value, bias)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("of"), F.col(text).alias("body")).mapInArrow(work, f"{key} {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted; learned from labelled rows that are not held out."""
    found = score(docs, fit(docs, labels, key, text), key, text)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
