"""Quality rules: fixed counts per text, then a logistic regression on hashed n-grams.

The model sees word unigrams, word bigrams and character 4-grams (of code points), hashed into one
table; a text's features are the shares of its n-grams that fall into each slot. It is fitted on a
bounded sample of the labelled documents (of those with a text, the MAX_LABELLED with the smallest
MD5 of their id): tasks turn the texts into features, of which one row has SLOTS at most, and one
task fits the weights. One part is held out to map scores to probabilities (Platt's sigmoid).
Scoring runs in Arrow batches over every whole text; a text is kept at a probability of at least
KEEP_AT.

Defined results: null and empty texts have no words and fail the base rule; without labelled rows
of both kinds the model keeps whatever passes the base rule; of several labels of one document the
lowest counts, and of several texts the first in order; a probability of exactly KEEP_AT keeps;
repeated rows give repeated rows; an empty table gives an empty result; other columns are passed on
only where asked for. A text of any length is counted as a whole in one task, at some 60 bytes of
memory for each of its bytes.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SPACE, flat, grams, mix, repeated, slices, span_sums, spans_hash, sums, words
from .common import kept, small_batches, stash

SLOTS = 1 << 16
#: Labelled rows used for fitting at most.
MAX_LABELLED = 2000
KEEP_AT = 0.5
#: Code points of a character n-gram.
CHARS = 4
_SCALE = 30.0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    #: Share of the held-out labelled rows that fall on their label's side of one half.
    held_right: float | None = None

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50)))


class Texts:
    """The texts of a batch with everything the rules and the model count."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = flat(texts)
        self.starts, self.ends, self.first = words(self.data, self.offsets)
        self.sums = span_sums(self.data)
        self.hashes = spans_hash(self.data, self.starts, self.ends, self.sums)
        self.n_words = np.diff(self.first)

    def families(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind of n-gram: slots, and where each text's begin (one more than texts)."""
        shift, out = np.uint64(64 - 16), [(mix(self.hashes ^ np.uint64(1)) >> np.uint64(48), self.first)]
        pairs, at = grams(self.hashes, self.first, 2)
        out.append((mix(pairs ^ np.uint64(2)) >> shift, np.searchsorted(at, self.first)))
        # Character n-grams: spans from each code point's first byte to that of the fourth one behind it.
        chars = np.flatnonzero((self.data & 0xC0) != 0x80)
        first = np.searchsorted(chars, self.offsets)
        at = np.flatnonzero(np.arange(len(chars)) + CHARS <= np.repeat(first[1:], np.diff(first)))
        spans = spans_hash(self.data, chars[at], np.append(chars, len(self.data))[at + CHARS], self.sums)
        out.append((mix(spans ^ np.uint64(3)) >> shift, np.searchsorted(at, first)))
        return [(slots.astype(np.int64), borders) for slots, borders in out]

    def score(self, model: Model) -> np.ndarray:
        total = np.full(len(self.offsets) - 1, model.bias)
        for slots, borders in self.families():
            total += _SCALE * sums(model.weights[slots], borders, np.float64) / np.maximum(1, np.diff(borders))
        return total

    def base(self) -> dict[str, np.ndarray]:
        """The counts of the fixed rules."""
        data, texts = self.data, len(self.offsets) - 1
        in_word = ~SPACE[data]
        chars = sums(in_word & ((data & 0xC0) != 0x80), self.offsets)
        windows, at = grams(self.hashes, self.first, 3)
        of_word = np.repeat(np.arange(texts), self.n_words)
        some, _ = repeated(of_word[at], windows)
        covered = np.zeros(len(self.hashes) + 3, bool)
        for k in range(3):
            covered[at[some] + k] = True
        # Lines: a border behind each \n and at each text's start and end.
        breaks = np.flatnonzero(data == 10)
        begin = np.concatenate([breaks + 1, self.offsets[:-1]])
        of_line = np.concatenate([np.searchsorted(self.offsets, breaks, "right") - 1, np.arange(texts)])
        order = np.lexsort((begin, of_line))
        begin, of_line = begin[order], of_line[order]
        follow = np.append(of_line[1:] == of_line[:-1], False)
        end = np.where(follow, np.append(begin[1:], 0) - 1, self.offsets[1:][of_line])
        filled = np.concatenate([[0], np.cumsum(in_word)])
        full = filled[end] > filled[begin]
        begin, end, of_line = begin[full], end[full], of_line[full]
        _, later = repeated(of_line, spans_hash(data, begin, end, self.sums))
        return {
            "n_words": self.n_words,
            "word_chars": chars,
            "n_symbols": sums(_SYMBOL[data], self.offsets),
            "n_dup_lines": np.bincount(of_line[later], minlength=texts),
            "n_repeat_words": sums(covered[: len(self.hashes)], self.first),
        }


def features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Slots and values of each text, SLOTS at most."""
    found = []
    for slots, borders in Texts(texts).families():
        n = np.diff(borders)
        key = np.sort(np.repeat(np.arange(len(n)), n) * SLOTS + slots)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        key, count = key[edge[:-1]], np.diff(edge)
        found.append((key, _SCALE * count / n[key // SLOTS]))
    key, value = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total, key = np.add.reduceat(value, edge) if len(key) else value, key[edge]
    cuts = np.searchsorted(key // SLOTS, np.arange(1, len(texts)))
    return np.split((key % SLOTS).astype(np.int32), cuts), np.split(total.astype(np.float32), cuts)


def fit(slots: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, *, rounds: int = 80, penalty: float = 1e-4) -> Model:
    """Logistic regression by Adam on the bounded labelled sample, then Platt's sigmoid on every fourth row."""
    plain = Model(np.zeros(SLOTS), 0.0, 0.0, 50.0)
    held = np.arange(len(good)) % 4 == 3
    if len(set(good[held])) < 2 or len(set(good[~held])) < 2:
        return plain
    row = np.repeat(np.arange(len(good), dtype=np.int32), [len(s) for s in slots])
    col, val = np.concatenate(slots), np.concatenate(values)

    weights, bias = np.zeros(SLOTS), 0.0
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) * ~held
    m, v = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, val * weights[col], len(good))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good)
        grad = np.append(np.bincount(col, val * error[row], SLOTS) + penalty * weights, error.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights -= step[:-1]
        bias -= step[-1]
    z = bias + np.bincount(row, val * weights[col], len(good))
    # Platt: targets drawn in by one over the class size plus two.
    x, y = z[held], good[held]
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -50, 50)))
        d, w = p - target, p * (1 - p) + 1e-9
        a, b, c = (w * x * x).sum() + 1e-6, (w * x).sum(), w.sum() + 1e-6
        g, h = (d * x).sum(), d.sum()
        det = a * c - b * b
        slope, shift = slope - 0.5 * (c * g - b * h) / det, shift - 0.5 * (a * h - b * g) / det
    right = float(((slope * x + shift >= 0) == y).mean())
    return Model(weights, float(bias), float(slope), float(shift), right)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """The model from the labelled rows: labels has doc_id and quality (1 good, 0 not)."""
    usable = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    chosen = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.join(usable.select("doc_id").distinct(), "doc_id")
    # The sample has MAX_LABELLED rows of two numbers at most, whatever the tables hold.
    chosen = stash(chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(MAX_LABELLED))
    rows = usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def describe(batches):
        kept("op6")
        for whole in batches:
            for batch in slices(whole, "text"):
                slots, values = features(batch.column("text"))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "quality": batch.column("quality"),
                    "slots": pa.array(slots, pa.list_(pa.int32())), "values": pa.array(values, pa.list_(pa.float32())),
                })

    def learn(batches):
        kept("op6")
        ids, slots, values, good = [], [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            good += batch.column("quality").to_pylist()
            for into, name in ((slots, "slots"), (values, "values")):
                into += [x.values.to_numpy() for x in batch.column(name)]
        order = sorted(range(len(ids)), key=ids.__getitem__)
        model = fit([slots[i] for i in order], [values[i] for i in order], np.array([good[i] == 1 for i in order], bool))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    kinds = {c: labels.schema["quality"].dataType.simpleString() if c == "quality" else documents.schema["doc_id"].dataType.simpleString() for c in ("doc_id", "quality")}
    described = rows.mapInArrow(describe, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, slots array<int>, values array<float>")
    # One task sees the features of the bounded sample, the driver only the weights.
    learned = described.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(learned[0]["model"]) if learned else Model(np.zeros(SLOTS), 0.0, 0.0, 50.0)


def judge(documents: DataFrame, model: Model, *, min_words: int = 50, max_repeat_percent: int = 50, keep_at: float = KEEP_AT, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # SLOTS doubles

    def run(batches):
        kept("op6")
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = Texts(batch.column("text"))
                counts = texts.base()
                probability = shared.value.probability(texts.score(shared.value))
                failed = (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > max_repeat_percent * counts["n_words"])
                out = {c: batch.column(c) for c in carry} | {k: pa.array(v.astype(np.int64)) for k, v in counts.items()}
                out |= {"base_failed": pa.array(failed), "probability": pa.array(probability), "kept": pa.array(~failed & (probability >= keep_at))}
                yield pa.RecordBatch.from_pydict(out)

    source = documents.select(*dict.fromkeys((*carry, "text")))
    carried = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carry)
    return source.mapInArrow(run, f"{carried}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(documents, model).drop("probability")
