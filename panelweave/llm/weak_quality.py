"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of vote patterns of all documents estimates, for each labeller, how it votes
on good and on bad documents, and with that the posterior of each pattern. The posteriors of
a bounded sample train a linear scorer over hashed word and word-shape features, which then
scores every document. The sample is of about SAMPLE_BYTES of text: each row is drawn with
the same chance by a hash of id and text, and only the drawn rows go to the task that trains.

Defined results: null text or text without words gets the share of good documents as its
score. Repeated rows, and rows that share a text, score alike; a null id is an id like any
other. Very long texts are scored whole, and trained on whole where they are drawn. Extra
columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import Words, text_slices

SAMPLE_BYTES = 20 << 20
BUCKETS = 1 << 15
ROUNDS, STEPS, RATE, GAIN, SHRINK = 60, 200, 0.05, 8.0, 1e-4
CALM = 8
KEEP_FROM = 0.5
NOTHING, BAD, GOOD = 0, 1, 2

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[128:] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in ".,;:?"]] = 5
_CLASS[[ord(c) for c in "!"]] = 6
_CLASS[[ord(c) for c in "#$%&*+<=>@^_`|~\\/{}[]"]] = 7

#: labeller, bad from, good to, fewest words: shares of words (or bytes) that a heuristic sees
LABELLERS = (
    ("shouting", 0.5, 0.2, 3),
    ("symbol ends", 0.3, 0.1, 3),
    ("echoes", 0.3, 0.1, 5),
    ("echoes at two", 0.25, 0.08, 5),
    ("separators", 0.2, 0.05, 5),
    ("exclaiming", 0.3, 0.1, 3),
    ("symbol bytes", 0.08, 0.02, 3),
    ("no short words", 0.97, 0.85, 30),
    ("no sentence ends", 0.995, 0.97, 30),
)


class Shapes:
    """What the labellers and the scorer see of a slice of documents."""

    def __init__(self, column: pa.Array):
        words = self.words = Words(column)
        self.count = np.diff(words.bounds)
        data, kinds = words.data, _CLASS[words.data]
        first, last, size = (kinds[words.starts], kinds[words.ends - 1], words.ends - words.starts) if len(words.starts) else (np.zeros(0, np.uint8),) * 3
        upper = np.concatenate([[0], np.cumsum(kinds == 2)])
        ups = upper[words.ends] - upper[words.starts]
        shouted = ups * 2 > size
        echo = np.zeros(len(words.starts), dtype=bool)
        if len(echo):
            echo[1:] = words.hashes[1:] == words.hashes[:-1]
            inner = words.bounds[:-1][words.bounds[:-1] < len(echo)]
            echo[inner] = False
        wide = np.zeros(len(echo), dtype=bool)
        wide[2:] = echo[2:] & echo[1:-1]
        alone = (size == 1) & (first == 7)
        double = np.zeros(len(echo), dtype=bool)
        long = np.flatnonzero(size > 1)
        double[long] = (last[long] == 6) & (kinds[words.ends[long] - 2] == 6)
        symbols = np.concatenate([[0], np.cumsum(kinds == 7)])[words.rows]
        solid = self._per_row(size)
        share = lambda flags: self._per_row(flags) / np.maximum(self.count, 1)
        self.shares = np.stack([share(shouted & (size > 2)) / np.maximum(share(size > 2), 1e-9), share((last == 7) & ~alone), share(echo), share(wide), share(alone), share(double), np.diff(symbols) / np.maximum(solid, 1), 1 - share(size <= 3), 1 - share(last == 5)])
        case = np.where(shouted, 2, np.where(first == 2, 1, 0))
        self.shape = (((case * 8 + first) * 8 + last) * 4 + np.minimum(size // 4, 3)) * 4 + echo * 2 + double
        self.features = np.stack([self.shape.astype(np.int64) % BUCKETS, (words.hashes % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS])

    def _per_row(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return np.diff(total[self.words.bounds])

    def votes(self) -> np.ndarray:
        """A labeller's vote in each column."""
        out = []
        for share, (_, bad, good, fewest) in zip(self.shares, LABELLERS):
            vote = np.where(share >= bad, BAD, np.where(share <= good, GOOD, NOTHING))
            out.append(np.where(self.count >= fewest, vote, NOTHING))
        return np.stack(out, axis=1)

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        per_word = weights[self.features[0]] + weights[self.features[1]]
        total = np.concatenate([[0.0], np.cumsum(per_word)])
        return bias + GAIN * np.diff(total[self.words.bounds]) / (self.count + CALM)


def patterns_of(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // (3 ** np.arange(len(LABELLERS)))[None, :] % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, P(vote | labeller, class, it votes), P(good)) by expectation-maximisation.

    A labeller that does not vote says nothing about the class.
    """
    votes, weight = votes_of(patterns), counts.astype(np.float64)
    good = np.where((votes == BAD).any(1), 0.1, 0.95)
    rates, prior = np.zeros((votes.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        prior = (good @ weight + 1) / (weight.sum() + 2)
        for k, share in enumerate((1 - good, good)):
            for vote in (BAD, GOOD):
                rates[:, k, vote] = ((votes == vote) * (share * weight)[:, None]).sum(0) + 0.5
        rates /= rates.sum(2, keepdims=True)
        says = np.zeros_like(rates)
        says[:, :, BAD:] = np.log(rates[:, :, BAD:])
        lean = np.log(prior / (1 - prior)) + sum(says[j, 1, votes[:, j]] - says[j, 0, votes[:, j]] for j in range(votes.shape[1]))
        good = 1 / (1 + np.exp(-np.clip(lean, -50, 50)))
    return good, rates, float(prior)


def vote_patterns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pattern of votes, and bytes of each document."""

    def work(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                shapes = Shapes(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(patterns_of(shapes.votes()), pa.int64()), pa.array(np.diff(shapes.words.rows), pa.int64())], names=[key, "pattern", "bytes"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"{key} {kind}, pattern bigint, bytes bigint")


def train(features: list[np.ndarray], bounds: np.ndarray, target: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam. A document's features are the means over its words and CALM silent ones, so short texts stay near the bias."""
    weights, bias = np.zeros(2 * BUCKETS), 0.0
    if not len(target):
        return weights, bias
    count = np.diff(bounds) + CALM
    row = np.repeat(np.arange(len(target)), np.diff(bounds))
    both = np.concatenate(features)
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for t in range(1, steps + 1):
        total = np.concatenate([[0.0], np.cumsum(weights[features[0]] + weights[features[1]])])
        p = 1 / (1 + np.exp(-(bias + GAIN * np.diff(total[bounds]) / count)))
        slope = (p - target) / len(target)
        per_word = (GAIN * slope / count)[row]
        g = np.bincount(both, np.concatenate([per_word, per_word]), minlength=2 * BUCKETS) + SHRINK * weights
        gb = slope.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        weights -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return weights, float(bias)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE_BYTES) -> dict:
    """The scorer (weights, bias), the labellers' estimated rates, and the share of good documents."""
    seen = vote_patterns(docs, key, text).groupBy("pattern").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).orderBy("pattern").collect()  # at most 3 ** labellers rows
    patterns, counts = np.array([r.pattern for r in seen], dtype=np.int64), np.array([r.rows for r in seen], dtype=np.int64)
    if not len(patterns):
        return {"weights": np.zeros(2 * BUCKETS, dtype=np.float32), "bias": 0.0, "rates": None, "prior": 0.5}
    good, rates, prior = estimate(patterns, counts)
    posterior = dict(zip(patterns.tolist(), good.tolist()))
    chance = min(1.0, most / max(1, sum(r.bytes for r in seen)))
    until = min(2**63 - 1, -(2**63) + int(chance * 2**64))
    sample = docs.filter(F.xxhash64(F.lit("quality"), key, text) <= F.lit(until)).select(F.col(text).alias("body"), F.col(key).alias("of"))

    def work(batches):
        features, sizes, target = [], [], []
        for batch in batches:
            for part in text_slices(batch, "body"):
                shapes = Shapes(part.column(0))
                features.append(shapes.features)
                sizes.append(shapes.count)
                target += [posterior.get(p, prior) for p in patterns_of(shapes.votes()).tolist()]
        if features:
            weights, bias = train(list(np.concatenate(features, axis=1)), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.array(target))
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])

    # every task draws its part of the sample; only drawn rows go to the one that trains, in a fixed order
    drawn = sample.repartition(1).sortWithinPartitions("of", F.xxhash64("body"))  # bounded by SAMPLE_BYTES
    row = drawn.mapInArrow(work, "weights binary, bias double").first()
    weights = np.frombuffer(bytes(row[0]), dtype="<f4") if row else np.zeros(2 * BUCKETS, dtype=np.float32)
    return {"weights": weights, "bias": row[1] if row else 0.0, "rates": rates, "prior": prior}


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key (or the columns `keep`), quality (the score, 0 to 1) and accepted."""
    weights, bias, prior = np.asarray(model["weights"], dtype=np.float64), model["bias"], model["prior"]
    names = keep or [key]

    def work(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                shapes = Shapes(part.column(0))
                value = np.where(shapes.count > 0, 1 / (1 + np.exp(-np.clip(shapes.logits(weights, bias), -50, 50))), prior)
                yield pa.RecordBatch.from_arrays([*(part.column(i + 1) for i in range(len(names))), pa.array(value), pa.array(value >= KEEP_FROM)], names=[*names, "quality", "accepted"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    inner = docs.select(F.col(text).alias(text), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(names)))
    return inner.mapInArrow(work, f"{kinds}, quality double, accepted boolean")


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return score(docs, fit(docs, key, text), key, text)
