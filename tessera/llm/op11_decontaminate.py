"""Benchmark decontamination by winnowing: which words of a document lie in windows of a benchmark's items.

A window is WINDOW consecutive words of an item (a shorter item is one window). Of the hashes of the
K-grams in each sliding window the smallest one is kept, on both sides. Equal windows have equal
smallest hashes, so every shared span of WINDOW words or more has a common fingerprint: documents'
fingerprints are joined with the items', and hits are extended to whole windows, whose words are
compared one by one (as 64-bit hashes). Items of fewer words than a window keep the hash of all their
words, and documents all hashes of so many words, which is the same scheme with one hash per window.

A benchmark of up to MOST_WINDOWS windows (counted) goes to all tasks and documents are read once,
without a shuffle. A larger one is joined by fingerprint: each text is brought only those windows
that share a fingerprint with it, and is then looked through in the same way. Fingerprints of copies
of a text are joined once; hot fingerprints and copies stay where they are.

Words are runs of digits, a to z (A to Z lower-cased) and all characters beyond ASCII.

Defined results: null, empty and wordless texts have no words and no hits; items without words match
nothing; rows that share an item_id are one item; an item without an id gives hits but is not named;
repeated rows give repeated rows, and rows without a doc_id are kept; ties do not arise, since all
matching windows count; an empty table gives an empty result, an empty benchmark no hits; other columns
are ignored but for those named in `keep`. A text of any length is looked through whole in one task, at
some 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, flat, grams, slices, spans_hash, sums, words
from .common import discard, hot_join, kept, small_batches, stash

WINDOW, K = 10, 5
#: Windows of items that are sent to all tasks; some 100 bytes each.
MOST_WINDOWS = 400_000

GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word; first word of each text; bytes and first byte of each text."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, GAPS)
    return spans_hash(data, starts, ends), starts, ends, first, data, offsets


def minima(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest K-gram hash of each window of WINDOW words, and the window's first word."""
    every, at = grams(hashes, first, K)
    width = WINDOW - K + 1
    n = len(every) - width + 1
    if n <= 0:
        return every[:0], at[:0]
    low = every[:n].copy()
    for j in range(1, width):
        np.minimum(low, every[j : n + j], out=low)
    # K-grams of two texts do not follow each other without a gap.
    whole = at[width - 1 :] - at[:n] == width - 1
    return low[whole], at[:n][whole]


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ordered array; equal neighbours are looked up once."""
    if not len(values) or not len(ordered):
        return np.zeros(len(values), bool)
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    own = values[head]
    found = ordered[np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)] == own
    return np.repeat(found, np.diff(np.append(head, len(values))))


class Windows:
    """Windows of items, to be looked up in texts."""

    def __init__(self, sizes: list[int], windows: list[bytes], items: list[str | None]):
        """One entry for each window and item: how many words, their hashes, and the item's name."""
        self.names = sorted({i for i in items if i is not None})
        number = {name: i for i, name in enumerate(self.names)} | {None: -1}
        of = np.array([number[i] for i in items], np.int64)
        sizes = np.array(sizes, np.int64)
        self.tables = []
        for m in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == m)
            rows = np.frombuffer(b"".join([windows[i] for i in at]), np.uint64).reshape(-1, m)
            keys, _ = grams(rows.ravel(), np.arange(0, rows.size + 1, m), m)
            order = np.lexsort((of[at], keys))
            head = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
            prints = np.unique(minima(rows.ravel(), np.arange(0, rows.size + 1, m))[0]) if m == WINDOW else keys[order][head]
            self.tables.append((m, prints, keys[order][head], rows[order][head], np.append(head, len(at)), of[at][order]))

    def begins(self, hashes: np.ndarray, first: np.ndarray, m: int, prints: np.ndarray) -> np.ndarray:
        """First words of the windows of m words whose fingerprint is among the given ones."""
        low, at = minima(hashes, first) if m == WINDOW else grams(hashes, first, m)
        return at[among(low, prints)]

    def look(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hit, and the distinct (text, item) pairs as rows of two numbers; items without a name do not show."""
        border, pairs = np.zeros(len(hashes) + 1, np.int64), [np.zeros((0, 2), np.int64)]
        for m, prints, keys, rows, head, items in self.tables:
            at = self.begins(hashes, first, m, prints)
            if not len(at):
                continue
            own = hashes[at[:, None] + np.arange(m)]
            key, _ = grams(own.ravel(), np.arange(0, own.size + 1, m), m)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = (rows[place] == own).all(1)
            at, place = at[same], place[same]
            np.add.at(border, at, 1)
            np.add.at(border, at + m, -1)
            text = np.searchsorted(first, at, "right") - 1
            both = np.unique(np.stack([text, place], 1), axis=0)
            many = np.diff(head)[both[:, 1]]
            inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.stack([np.repeat(both[:, 0], many), items[np.repeat(head[:-1][both[:, 1]], many) + inner]], 1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return np.cumsum(border[:-1]) > 0, found[found[:, 1] >= 0]

    def columns(self, texts: pa.Array) -> dict[str, pa.Array]:
        """n_words, n_hit, items and spans of each text."""
        hashes, starts, ends, first, data, offsets = word_hashes(texts)
        hit, pairs = self.look(hashes, first)
        # A span is a run of hit words of one text, from the start of the first to the end of the last.
        head, tail = hit.copy(), hit.copy()
        head[1:] &= ~hit[:-1]
        tail[:-1] &= ~hit[1:]
        inner = first[(first > 0) & (first < len(hit))]
        head[inner] = hit[inner]
        tail[inner - 1] = hit[inner - 1]
        head, tail = np.flatnonzero(head), np.flatnonzero(tail)
        text = np.searchsorted(first, head, "right") - 1
        signs = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(head) else np.zeros(1, np.int64)
        place = lambda at: pa.array((signs[at] - signs[offsets[text]]).astype(np.int32))
        spans = pa.StructArray.from_arrays([place(starts[head]), place(ends[tail])], ["start", "end"])
        lists = lambda of, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(first))), pa.int32()), values)
        names = pa.array(self.names, pa.string()).take(pa.array(pairs[:, 1]))
        return {"n_words": pa.array(np.diff(first)), "n_hit": pa.array(sums(hit, first)), "items": lists(pairs[:, 0], names), "spans": lists(text, spans)}


def item_windows(items: DataFrame) -> DataFrame:
    """item (as a string), m, words (their hashes) and print of each window of each item."""

    def run(batches):
        kept("op11 items")
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _, first, _, _ = word_hashes(part.column("text"))
                names, out = part.column("item").to_pylist(), {"item": [], "m": [], "words": [], "print": []}
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    m = min(WINDOW, b - a)
                    if not m:
                        continue
                    own, ends = hashes[a:b], np.array([0, b - a])
                    prints = minima(own, ends)[0] if m == WINDOW else grams(own, ends, m)[0]
                    out["words"] += [own[j : j + m].tobytes() for j in range(b - a - m + 1)]
                    out["print"] += prints.view(np.int64).tolist()
                    out["item"] += [names[i]] * len(prints)
                    out["m"] += [m] * len(prints)
                kinds = {"item": pa.string(), "m": pa.int32(), "words": pa.binary(), "print": pa.int64()}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})

    source = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return source.mapInArrow(run, "item string, m int, words binary, print long").distinct()


_RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"


def decontaminate(documents: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), most: int = MOST_WINDOWS) -> DataFrame:
    """The columns to keep, n_words, n_hit, items (their ids, in order) and spans (code points, end exclusive) of each document."""
    windows = stash(item_windows(items))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema] + [_RESULT])
    if windows.count() > most:
        return _joined(documents, windows, keep, schema)
    got = windows.select("m", "words", "item").toArrow()
    discard(windows)
    shared, name = documents.sparkSession.sparkContext.broadcast([got.column(c).to_pylist() for c in ("m", "words", "item")]), uuid.uuid4().hex

    def run(batches):
        own = kept(("op11", name), lambda: Windows(*shared.value))
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({f"k{i}": part.column(i) for i in range(len(keep))} | own.columns(part.column("text"))).rename_columns([*keep, "n_words", "n_hit", "items", "spans"])

    return documents.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, schema)


def _joined(documents: DataFrame, windows: DataFrame, keep: tuple[str, ...], schema: str) -> DataFrame:
    """decontaminate for benchmarks of any size: texts meet the windows that share a fingerprint with them."""
    lengths = [m for (m,) in windows.select("m").distinct().orderBy("m").collect()]  # WINDOW numbers at most

    def prints(batches):
        kept("op11 prints")
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _, first, _, _ = word_hashes(part.column("text"))
                for m in lengths:
                    low, at = minima(hashes, first) if m == WINDOW else grams(hashes, first, m)
                    both = np.unique(np.stack([np.searchsorted(first, at, "right").astype(np.uint64) - np.uint64(1), low], 1), axis=0)
                    yield pa.RecordBatch.from_pydict({"text": part.column("class").take(pa.array(both[:, 0].astype(np.int64))), "print": pa.array(both[:, 1].view(np.int64))})

    of = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text", F.md5("text").alias("class"))
    have = stash(of.where("text is not null").select("class", "text").mapInArrow(prints, "text string, print long").distinct())
    grouped = stash(windows.groupBy("print").agg(F.collect_list(F.struct("m", "words", "item")).alias("w")))
    met = hot_join(have, grouped, "print").select(F.col("text").alias("class"), "w")
    own = stash(met.groupBy("class").agg(F.flatten(F.collect_list("w")).alias("w")))
    every = hot_join(of, own, "class", "left").drop("class")
    discard(have, grouped, windows)

    def run(batches):
        kept("op11 joined")
        nothing = Windows([], [], [])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                w = row.column("w")[0].as_py()
                look = Windows(*[[x[c] for x in w] for c in ("m", "words", "item")]) if w else nothing
                yield pa.RecordBatch.from_pydict({f"k{j}": row.column(f"k{j}") for j in range(len(keep))} | look.columns(row.column("text"))).rename_columns([*keep, "n_words", "n_hit", "items", "spans"])

    return every.select(*[f"k{i}" for i in range(len(keep))], "text", "w").mapInArrow(run, schema)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0)),
spots AS (
  SELECT r, m, unnest(range(1, len(w) - m + 2)) AS k, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS g
  FROM d, (SELECT DISTINCT m FROM win)),
hits AS (SELECT r, k, m, item_id FROM spots JOIN win USING (m, g)),
covered AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT r, k, m FROM hits)) GROUP BY r),
named AS (SELECT r, count(*)::BIGINT AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(named.s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
