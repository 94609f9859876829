"""Ranked lexical search with bit-sliced Bloom signatures: the best documents of each item, exactly.

Index. A document's keys are its distinct terms, once for each level l with at least 2**l occurrences.
Documents with about as many keys (within a factor of 2) share blocks of up to ROWS rows. A block is
a bit matrix: bit slice s holds a bit for each of its documents, set if a key of it hashes to s. A
key is in a document only if the document's bits in all HASHES slices of the key are set: the slices'
conjunction is a bitmap of rows that overestimates presence.

Bounds. Presence at level l, but not at l + 1, means at most 2**(l+1) - 1 occurrences. An item's upper
bound for a document is the sum over levels of the term weights of the bitmaps that have its bit,
times how much a term's factor can grow up to that many occurrences in a document of its length.

Search. Of each item, the documents with the k highest bounds are scored exactly; the k-th score is a
threshold that no document with a smaller bound can reach. All others are scored exactly, and the k
best are the result. Of equal texts in a block, only the k with the smallest ids can be among them; each
distinct text is scored once.

Items are asked in parts of about PART_TERMS terms, each sent to all tasks; the parts grow with the
items only. Terms are compared as 64-bit hashes.

Defined results: null texts and texts without terms are never found and do not count; items without
terms find nothing; repeated rows of documents are found each for itself; repeated items are items of
their own; ties go by ascending doc_id, rows without one last; an empty table gives an empty result;
other columns are ignored. A text of any length is indexed whole in one task, at some 100 bytes of
memory for each of its bytes.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import LOWER, flat, mix, slices, spans_hash, words
from .common import discard, kept, small_batches, stash

#: Documents of a block, and keys of a block, at most (one document may have more).
ROWS, KEYS = 2048, 1 << 20
#: Bit slices of a key, and slices for each key of a block's largest document.
HASHES, SPARSE = 4, 8
#: Terms of items that are asked together.
PART_TERMS = 8192
#: Texts and their items that are broadcast to find the texts again; some 20 bytes each.
MOST_ASKED = 1_000_000
SCALE, K1, B = 1_000_000_000, 1000, 75

GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STEP = np.uint64(0xD1B54A32D192ED03)


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the first term of each text (one more than texts)."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, GAPS)
    return spans_hash(data, starts, ends), first


def counted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and occurrences of each distinct term of each text, texts in order."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])])) if len(text) else np.zeros(0, np.int64)
    return text[head], hashes[head], np.diff(np.append(head, len(text)))


def level_keys(terms: np.ndarray, level: int) -> np.ndarray:
    """The keys of terms that occur at least 2**level times."""
    return mix(terms + np.array([level + 1], np.uint64) * _STEP)


def slots(keys: np.ndarray, size: int) -> np.ndarray:
    """The slices of each key in a matrix of so many, one row per key."""
    other = mix(keys ^ _STEP) | np.uint64(1)
    return ((keys[:, None] + other[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def matrix(keys: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of slices, and the packed bit matrix of documents with so many keys each."""
    size = 64 * math.ceil(SPARSE * int(counts.max()) / 64)
    bits = np.zeros((size, len(counts)), bool)
    bits[slots(keys, size), np.repeat(np.arange(len(counts)), counts)[:, None]] = True
    return size, np.packbits(bits, axis=1)


def build_index(documents: DataFrame) -> DataFrame:
    """Blocks: slices, matrix, doc_ids, prints (of the texts) and lengths (in terms) of documents with terms."""
    schema = "slices int, matrix binary, doc_ids array<long>, prints array<long>, lengths array<int>"

    def run(batches):
        kept("op13 index")
        held: dict = {}

        def block(band):
            keys, counts, doc_ids, prints, n = held.pop(band)
            size, bits = matrix(np.concatenate(keys), np.concatenate(counts))
            lists = [pa.concat_arrays(doc_ids), pa.concat_arrays(prints), pa.array(np.concatenate(n).astype(np.int32))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([bits.tobytes()], pa.binary()), *lists], ["slices", "matrix", "doc_ids", "prints", "lengths"])

        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, first = term_hashes(batch.column("text"))
                text, term, tf = counted(hashes, first)
                of, keys = [], []
                level = 0
                while len(term):
                    of.append(text)
                    keys.append(level_keys(term, level))
                    level += 1
                    more = tf >= 1 << level
                    text, term, tf = text[more], term[more], tf[more]
                if not of:
                    continue
                of, keys = np.concatenate(of), np.concatenate(keys)
                order = np.argsort(of, kind="stable")
                of, keys = of[order], keys[order]
                counts = np.bincount(of, minlength=len(first) - 1)
                begin = np.concatenate([[0], np.cumsum(counts)])
                bands = np.where(counts > 0, np.frexp(counts)[1], 0)
                for band in np.unique(bands[counts > 0]).tolist():
                    rows = np.flatnonzero(bands == band)
                    per = max(1, min(ROWS, KEYS >> band))
                    for a in range(0, len(rows), per):
                        at = rows[a : a + per]
                        own = held.setdefault(band, ([], [], [], [], []))
                        taken = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(counts[at])[:-1]]), counts[at]) + np.arange(int(counts[at].sum()))
                        where = pa.array(at)
                        for values, value in zip(own, (keys[taken], counts[at], batch.column("doc_id").take(where), batch.column("print").take(where), np.diff(first)[at])):
                            values.append(value)
                        if sum(map(len, own[1])) >= per:
                            yield block(band)
        for band in sorted(held):
            yield block(band)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text").mapInArrow(run, schema)


def document_frequencies(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: how many documents hold each of the terms (64-bit hashes; a part of the items' terms)."""
    asked = documents.sparkSession.sparkContext.broadcast(np.unique(terms.select("term").toArrow().column(0).to_numpy().view(np.uint64)))

    def run(batches):
        kept("op13 frequencies")
        known = asked.value
        n = np.zeros(len(known), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, first = term_hashes(batch.column("text"))
                place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                hit = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                both = np.unique(text[hit] * max(1, len(known)) + place[hit])
                n += np.bincount(both % max(1, len(known)), minlength=len(known))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(n[some])], ["term", "df"])

    return documents.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of the row), term (its hash) and times, of each item's distinct terms."""

    def run(batches):
        kept("op13 items")
        for batch in batches:
            text, term, times = counted(*term_hashes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(text)), pa.array(term.view(np.int64)), pa.array(times)], ["item", "term", "times"])

    return items.select("item", "text").mapInArrow(run, "item long, term long, times long")


class Query:
    """Items of one part: terms in order, their weights, and how often each item has each."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, times: np.ndarray, df: dict[int, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.items, row = np.unique(items, return_inverse=True)
        self.terms, column = np.unique(terms, return_inverse=True)
        # A term that no document holds adds nothing.
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in self.terms.tolist()], np.int64)
        self.times = np.zeros((len(self.items), len(self.terms)), np.int64)
        self.times[row, column] = times
        joint = self.times * self.weights
        self.exact = np.float32 if joint.sum(1).max(initial=0) < 1 << 24 else np.float64
        self.joint = joint.astype(self.exact)

    def factor(self, tf, lengths: np.ndarray) -> np.ndarray:
        m = 100 - B + (B * lengths.astype(np.int64) * self.n_docs) // self.n_terms
        return (SCALE * tf) // (K1 * tf + 8 * m)

    def bounds(self, size: int, bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """An upper bound of each item's score for each document of a block."""
        out = np.zeros((len(self.items), len(lengths)), np.int64)
        level, terms, before, reached = 0, np.arange(len(self.terms)), None, np.zeros(len(lengths), np.int64)
        while len(terms):
            at = slots(level_keys(self.terms[terms], level), size)
            present = bits[at[:, 0]]
            for h in range(1, HASHES):
                present &= bits[at[:, h]]
            if before is not None:
                present &= before
            some = present.any(1)
            terms, before = terms[some], present[some]
            if not len(terms):
                break
            upto = self.factor((2 << level) - 1, lengths)
            there = np.unpackbits(before, axis=1, count=len(lengths)).astype(self.exact)
            out += (self.joint[:, terms] @ there).astype(np.int64) * (upto - reached)
            reached, level = upto, level + 1
        return out

    def scores(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The exact score of each text for each item; one row per text."""
        text, term, tf = counted(hashes, first)
        place = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        hit = self.terms[place] == term if len(self.terms) else np.zeros(len(term), bool)
        text, place, tf = text[hit], place[hit], tf[hit]
        gain = self.weights[place] * self.factor(tf.astype(np.int64), np.diff(first)[text])
        out = np.zeros((len(first) - 1, len(self.items)), np.int64)
        borders = np.searchsorted(text, np.arange(len(first)))
        for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
            out[i] = self.times[:, place[a:b]] @ gain[a:b]
        return out


def bounded(index: DataFrame, shared, name: str, k: int, least: dict[int, int] | None) -> DataFrame:
    """item, doc_id, print, bound of documents that can be among the k best: without `least` each task's k highest bounds of an item, else all that reach the item's threshold."""

    def run(batches):
        query: Query = kept(("op13", name), lambda: Query(*shared.value))
        floor = None if least is None else np.array([max(1, least.get(i, 1)) for i in query.items.tolist()], np.int64)[:, None]
        best: list[list[np.ndarray]] = [[] for _ in query.items]

        def rows(item, bound, doc_id, unknown, prints):
            return pa.RecordBatch.from_arrays([pa.array(query.items[item]), pa.array(doc_id, mask=unknown), pa.array(prints), pa.array(bound)], ["item", "doc_id", "print", "bound"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, prints, lengths = (row.column(c).flatten() for c in ("doc_ids", "prints", "lengths"))
                unknown, ids, prints = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(), prints.to_numpy()
                lengths, size = lengths.to_numpy(), row.column("slices")[0].as_py()
                bits = np.frombuffer(row.column("matrix")[0].as_buffer(), np.uint8).reshape(size, -1)
                found = query.bounds(size, bits, lengths)
                # Of equal texts the k first by id; others cannot come before them.
                order = np.lexsort((ids, unknown, prints))
                same = np.concatenate([[False], prints[order][1:] == prints[order][:-1]])
                rank = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                found[:, order[rank >= k]] = 0
                if floor is not None:
                    item, at = np.nonzero(found >= floor)
                    if len(at):
                        yield rows(item, found[item, at], ids[at], unknown[at], prints[at])
                    continue
                few = min(k, found.shape[1])
                top = np.argpartition(-found, few - 1, axis=1)[:, :few]
                for j in range(len(query.items)):
                    at = top[j][found[j, top[j]] > 0]
                    if len(at):
                        best[j].append(np.stack([found[j, at], ids[at], unknown[at], prints[at]]))
                        if sum(x.shape[1] for x in best[j]) > 8 * k:
                            joint = np.concatenate(best[j], axis=1)
                            best[j] = [joint[:, np.argsort(-joint[0], kind="stable")[:k]]]
        for j, parts in enumerate(best):
            if parts:
                joint = np.concatenate(parts, axis=1)
                joint = joint[:, np.argsort(-joint[0], kind="stable")[:k]]
                yield rows(np.full(joint.shape[1], j), joint[0], joint[1], joint[2].astype(bool), joint[3])

    return index.mapInArrow(run, "item long, doc_id long, print long, bound long")


def scored(candidates: DataFrame, documents: DataFrame, shared, name: str) -> DataFrame:
    """item, doc_id, print and score of the candidates; each distinct text is read and scored once."""
    texts = stash(candidates.groupBy("print").agg(F.min("doc_id").alias("_rep"), F.collect_set("item").alias("asked")))

    def run(batches):
        query: Query = kept(("op13", name), lambda: Query(*shared.value))
        for whole in batches:
            for batch in slices(whole, "text"):
                scores = query.scores(*term_hashes(batch.column("text")))
                asked = batch.column("asked")
                row = np.repeat(np.arange(len(batch)), np.diff(asked.offsets.to_numpy()))
                items = asked.flatten().to_numpy()
                found = scores[row, np.searchsorted(query.items, items)]
                yield pa.RecordBatch.from_arrays([batch.column("print").take(pa.array(row)), pa.array(items), pa.array(found)], ["print", "item", "score"])

    keyed = documents.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("print"), "text")
    size = texts.agg(F.sum(F.size("asked") + 1)).first()[0] or 0
    few = texts.withColumnRenamed("print", "_print")
    same = (F.col("print") == F.col("_print")) & F.col("_id").eqNullSafe(F.col("_rep"))
    read = keyed.join(F.broadcast(few) if size <= MOST_ASKED else few, same).select("print", "text", "asked")
    scores = read.mapInArrow(run, "print long, item long, score long").groupBy("print", "item").agg(F.max("score").alias("score"))
    return candidates.join(scores, ["print", "item"]).where("score > 0")


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The items' columns but text, rank, doc_id and score of each item's k best documents; items have text and none of the other names."""
    numbered = stash(items.withColumn("item", F.monotonically_increasing_id()))
    terms = stash(item_terms(numbered))
    index = stash(build_index(documents))
    total = index.select(F.size("lengths").cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    parts = max(1, math.ceil(terms.count() / PART_TERMS))
    out = None
    for part in range(parts if n_docs else 0):
        own = terms.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        got = own.toArrow()
        df = {r["term"] & 0xFFFFFFFFFFFFFFFF: r["df"] for r in document_frequencies(documents, own).collect()}
        shared, name = documents.sparkSession.sparkContext.broadcast((got.column("item").to_numpy(), got.column("term").to_numpy().view(np.uint64), got.column("times").to_numpy(), df, n_docs, n_terms)), uuid.uuid4().hex
        ordered = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
        first = stash(bounded(index, shared, name, k, None).withColumn("_r", F.row_number().over(ordered)).where(F.col("_r") <= k).drop("_r"))
        by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        known = scored(first, documents, shared, name).withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") == k)
        least = {r["item"]: r["score"] for r in known.select("item", "score").collect()}
        candidates = stash(bounded(index, shared, name, k, least))
        found = scored(candidates, documents, shared, name).select("item", "doc_id", "score")
        ranked = stash(found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k))
        discard(first, candidates)
        out = ranked if out is None else out.unionByName(ranked)
    discard(index, terms)
    if out is None:
        out = documents.sparkSession.createDataFrame([], "item long, doc_id long, score long, rank int")
    return numbered.drop("text").join(out, "item").drop("item")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
q AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
total AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
weights AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t, n),
asked AS (SELECT q, item_id, t, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(w) AS t FROM q) GROUP BY q, item_id, t),
gains AS (
  SELECT tf.r, d.doc_id, tf.t, weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * len(d.w)::BIGINT * n) // l)))) AS g
  FROM tf JOIN d USING (r) JOIN weights USING (t), total WHERE tf.t IN (SELECT t FROM asked)),
scores AS (SELECT q, item_id, r, doc_id, sum(times * g)::BIGINT AS score FROM asked JOIN gains USING (t) GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
