"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both encodings of a text are lists of byte offsets where tokens end. The shorter list drives a
galloping search into the longer one: from where the text begins there, steps of doubled size until
the offset is reached, then a binary search; all offsets of an array of texts take their steps
together. Offsets in both lists cut the tokens into groups; the difference of neighbouring common
ranks in each list is the range of tokens of a group. In a group, every token of one side shares the
group's bytes with every token of the other: these pairs are linked.

Both vocabularies cut in front of a single space, so a text's alignment is that of its space-delimited
chunks, one behind the other, and each distinct chunk of a slice is encoded and aligned once, with a
memory of chunks that is bounded in bytes. Texts with blanks beside white space, or literal space
marks, are aligned whole.

Documents are encoded once: each one's figures and its distinct linked pairs (with how often it has
each) are written as a table. From it come the corpus-wide counts, one row for each pair of ids, and,
by a join with them, the sums of each document. Up to MOST_PAIRS pairs (counted) the counts are
broadcast; beyond that pairs are shuffled, while those that very many documents have stay where they are.

Defined results: null and empty texts, and texts whose tokens do not spell a space and the text (a
literal space mark does that), have no tokens: zeros and an empty groups_sha256. Strings of special
tokens inside texts are plain text. All pairs with an A id's highest count are its best ones, ties
included. Repeated rows are documents of their own; rows without a doc_id are kept; an empty table
gives an empty result; other columns are ignored. A text of any length is aligned in one task, at some
200 bytes of memory for each of its bytes; between two common ends memory also grows with the distinct
ids of one side times those of the other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Lexicon, flat, slices, sums
from .common import discard, hot_join, kept, small_batches, stash
from .op05_pieces import MARK, check_settings, read_model
from .op10_tokens import _SPACE, Encoder, byte_letters

#: Bytes of text worked on at once within a batch.
SLICE_BYTES = 4_000_000
#: Bytes of chunks that a worker remembers.
MEMORY = 64 << 20
#: Pairs whose counts are broadcast; some 20 bytes each.
MOST_PAIRS = 2_000_000
#: Products of tokens in a group from which on distinct ids are counted first.
WIDE = 256
#: Pairs are stored as 32-bit numbers from here on.
LEAST = -(1 << 31)


def gallop(x: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each x the first place in many[low:high], which is ordered, that is not below it (high if there is none)."""
    step = np.ones(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        probe = low[live] + step[live]
        live = live[probe < high[live]]
        live = live[many[low[live] + step[live]] < x[live]]
        step[live] *= 2
    low, high = low + step // 2, np.minimum(low + step + 1, high)
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) // 2
        below = many[middle] < x[live]
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]
        live = live[low[live] < high[live]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both have in a text; each text's shorter list is looked up in its longer one.

    Ends of all texts lie behind each other in a and in b; first_a and first_b tell where each text's begin.
    """
    shorter = np.diff(first_a) <= np.diff(first_b)
    found = []
    for few, many, first, other, texts in ((a, b, first_a, first_b, shorter), (b, a, first_b, first_a, ~shorter)):
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        at = np.flatnonzero(texts[text])
        text = text[at]
        place = gallop(few[at], other[text], other[text + 1], many)
        hit = place < other[text + 1]
        hit[hit] = many[place[hit]] == few[at][hit]
        found.append((at[hit], place[hit]))
    i, j = np.concatenate([found[0][0], found[1][1]]), np.concatenate([found[0][1], found[1][0]])
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def inner(size: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def packed(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """The bytes of the 32-bit values between each two borders."""
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer((borders * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


class Aligner:
    """Alignments of texts by two vocabularies, each distinct chunk once."""

    def __init__(self, a_path: str, b_model: bytes):
        import sentencepiece

        check_settings(b_model)
        pieces = read_model(b_model)
        if any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind == 1):
            raise ValueError("a piece has a space mark behind another character")
        self.a, self.b = Encoder(a_path), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        spelled = {i: bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w, i in self.a.tokenizer.get_vocab().items()}
        self.a_bytes = pa.array([spelled.get(i, b"") for i in range(max(spelled) + 1)], pa.binary())
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(MARK, " ").encode() for p, _, kind in pieces], pa.binary())
        self.times = len(pieces)
        if len(self.a_bytes) * self.times >= 1 << 32:
            raise ValueError("pairs of ids have to fit 32 bits")
        most = max(len(self.a_bytes), self.times)
        self.numbers, self.most = pa.array([f"{i}{sign}" for sign in ",|;" for i in range(most)], pa.string()), most
        self.lexicon = Lexicon(self.chunk_columns, MEMORY)

    def chunk_columns(self, words: list[str]) -> list[pa.Array]:
        """columns() of chunks, given without the space in front."""
        own = [self.a.packed(" " + w) for w in words]
        return self.columns([" " + w for w in words], np.frombuffer(b"".join(own), np.uint16), [len(x) // 2 for x in own], words)

    def whole_columns(self, texts: list[str]) -> list[pa.Array]:
        """columns() of whole texts."""
        own = [self.a.tokenizer.encode(" " + t, add_special_tokens=False).ids if t else [] for t in texts]
        return self.columns([" " + t if t else "" for t in texts], np.fromiter(chain.from_iterable(own), np.int64), [len(x) for x in own], texts)

    def columns(self, raw: list[str], a_ids: np.ndarray, n_a: list[int], texts: list[str]) -> list[pa.Array]:
        """Per text: tokens of A and of B, groups, links, groups as text (each with a sign behind it), whether both spell it, distinct pairs and how often each."""
        n, own = len(texts), self.b.encode(texts, num_threads=1) if texts else []
        n_a, n_b = np.array(n_a, np.int64), np.fromiter(map(len, own), np.int64, n)
        a_ids, b_ids = a_ids.astype(np.int64), np.fromiter(chain.from_iterable(own), np.int64, int(n_b.sum()))
        # Texts that one side does not spell have no tokens.
        first = lambda count: np.concatenate([[0], np.cumsum(count)])
        data, offsets = flat(pa.array(raw, pa.string()))
        same = np.diff(offsets) > 0
        sides = []
        for ids, count, table in ((a_ids, n_a, self.a_bytes), (b_ids, n_b, self.b_bytes)):
            spelled, at = flat(table.take(pa.array(ids)))
            borders = at[first(count)]
            same &= np.diff(borders) == np.diff(offsets)
            sides.append((spelled, borders, np.diff(at)))
        for spelled, borders, _ in sides:
            size = np.where(same, np.diff(offsets), 0)
            off = spelled[np.repeat(borders[:-1], size) + inner(size)] != data[np.repeat(offsets[:-1], size) + inner(size)]
            same &= sums(off, first(size)) == 0
        a_ids, b_ids = a_ids[keep_a := np.repeat(same, n_a)], b_ids[keep_b := np.repeat(same, n_b)]
        n_a, n_b = np.where(same, n_a, 0), np.where(same, n_b, 0)
        first_a, first_b = first(n_a), first(n_b)
        a_end, b_end = common_ends(np.cumsum(sides[0][2][keep_a]), np.cumsum(sides[1][2][keep_b]), first_a, first_b)
        # The last ends of a text are common, so no group reaches into the next text.
        size_a, size_b = np.diff(a_end, prepend=-1), np.diff(b_end, prepend=-1)
        a_first, b_first = a_end + 1 - size_a, b_end + 1 - size_b
        of = np.searchsorted(first_a, a_end, "right") - 1
        borders, links = np.searchsorted(of, np.arange(n + 1)), size_a * size_b
        narrow = np.where(links <= WIDE, links, 0)
        at, width = inner(narrow), np.repeat(size_b, narrow)
        joint = [np.repeat(of, narrow) << 32 | a_ids[np.repeat(a_first, narrow) + at // np.maximum(width, 1)] * self.times + b_ids[np.repeat(b_first, narrow) + at % np.maximum(width, 1)]]
        often = [np.ones(len(joint[0]), np.int64)]
        for g in np.flatnonzero(links > WIDE).tolist():
            x, y = Counter(a_ids[a_first[g] : a_end[g] + 1].tolist()), Counter(b_ids[b_first[g] : b_end[g] + 1].tolist())
            keys = np.add.outer(np.array(list(x)) * self.times, np.array(list(y))).ravel()
            joint.append(of[g] << 32 | keys)
            often.append(np.multiply.outer(np.array(list(x.values())), np.array(list(y.values()))).ravel())
        keys, place = np.unique(np.concatenate(joint), return_inverse=True)
        often = np.bincount(place, np.concatenate(often), len(keys)).astype(np.int32)
        ends = np.searchsorted(keys >> 32, np.arange(n + 1))
        # Groups as text: numbers with the sign that follows each, A and B of a group behind each other.
        codes = np.zeros(len(a_ids) + len(b_ids), np.int64)
        group_a, group_b = np.repeat(np.arange(len(of)), size_a), np.repeat(np.arange(len(of)), size_b)
        i, j = np.arange(len(a_ids)), np.arange(len(b_ids))
        codes[i + b_first[group_a]] = a_ids + self.most * (i == a_end[group_a])
        codes[j + a_end[group_b] + 1] = b_ids + 2 * self.most * (j == b_end[group_b])
        spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array((first_a + first_b).astype(np.int32)), self.numbers.take(pa.array(codes))), "")
        numbers = [pa.array(x) for x in (n_a, n_b, np.diff(borders), sums(links, borders))]
        return [*numbers, spelled, pa.array(same), packed((keys & 0xFFFFFFFF).astype(np.uint32), ends), packed(often, ends)]

    def run(self, texts: pa.Array) -> tuple[list[pa.Array], np.ndarray, pa.Array]:
        """Columns of chunks, each text's chunks as rows of them, and where each text's rows begin (one more than texts)."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, f"^$|^ |{_SPACE} (?:{_SPACE}|$)|  | $|{MARK}"), pc.greater(pc.binary_length(texts), 8 * SLICE_BYTES))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        distinct = lists.flatten().dictionary_encode()
        rows, columns = self.lexicon(distinct.dictionary)
        which = rows[distinct.indices.to_numpy()]
        whole = self.whole_columns(texts.filter(odd).to_pylist())
        first = lists.offsets.to_numpy()[:-1].astype(np.int64)
        which[first[odd.to_numpy(zero_copy_only=False)]] = len(columns[0]) + np.arange(len(whole[0]))
        return [pa.concat_arrays([c, w]) for c, w in zip(columns, whole)], which, lists.offsets


def distinct_pairs(columns: list[pa.Array], which: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's distinct linked pairs begin (one more than texts), the pairs, and how often each is linked."""
    of = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    own, times = np.unique(of * len(columns[0]) + which, return_counts=True)
    text, row = own // len(columns[0]), own % len(columns[0])
    (data, begin), (often, _) = flat(columns[6]), flat(columns[7])
    begin = begin // 4
    size = np.diff(begin)[row]
    at = np.repeat(begin[row], size) + inner(size)
    joint = np.repeat(text, size) << 32 | data.view(np.uint32)[at].astype(np.int64)
    order = np.argsort(joint)
    joint, weight = joint[order], (often.view(np.int32)[at] * np.repeat(times, size))[order]
    head = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]])) if len(joint) else np.zeros(0, np.int64)
    keys = joint[head]
    return np.searchsorted(keys >> 32, np.arange(len(borders))), keys & 0xFFFFFFFF, sums(weight, np.append(head, len(joint)))


def aligned(documents: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (how often the document has each linked); with_groups adds the groups."""
    with open(b_path, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, under 1 MB

    def run(batches):
        own = kept(("op12", a_path, b_path), lambda: Aligner(a_path, model.value))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                columns, which, offsets = own.run(batch.column("text"))
                borders = offsets.to_numpy().astype(np.int64)
                good = sums(~columns[5].to_numpy(zero_copy_only=False)[which], borders) == 0
                # A text that has a chunk which one side does not spell has no tokens.
                which = which[np.repeat(good, np.diff(borders))]
                borders = np.concatenate([[0], np.cumsum(np.where(good, np.diff(borders), 0))])
                spelled = [s[:-1] for s in pc.binary_join(pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), columns[4].take(pa.array(which))), "").to_pylist()]
                begin, pairs, times = distinct_pairs(columns, which, borders)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(v))
                out = [batch.column("doc_id"), *[pa.array(sums(columns[i].to_numpy()[which], borders)) for i in range(4)], pa.array(map(digest, spelled), pa.string())]
                out += [lists((pairs + LEAST).astype(np.int32)), lists(times), *([pa.array(spelled, pa.string())] if with_groups else [])]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>" + ", groups string" * with_groups
    names = [part.split(" ")[0] for part in schema.split(", ")]
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(table: DataFrame, b_size: int) -> DataFrame:
    """pair, n, best: how many rows have each pair of ids linked, and whether that is the highest of its A id; pairs as in aligned()."""
    counts = table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    first = stash(counts.withColumn("_a", F.expr(f"(cast(pair AS bigint) - {LEAST}) div {b_size}")))
    most = first.groupBy("_a").agg(F.max("n").alias("_most"))
    out = stash(first.join(most, "_a").select("pair", "n", (F.col("n") == F.col("_most")).alias("best")))
    discard(first)
    return out


def align_documents(documents: DataFrame, a_path: str, b_path: str, *, with_groups: bool = False, most: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of each document; with_groups adds the groups themselves."""
    with open(b_path, "rb") as f:
        b_size = len(read_model(f.read()))
    table = stash(aligned(documents, a_path, b_path, with_groups).withColumn("_row", F.monotonically_increasing_id()))
    counts = pair_counts(table, b_size)
    linked = table.select("_row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    met = linked.join(F.broadcast(counts), "pair") if counts.count() <= most else hot_join(linked, counts, "pair")
    totals = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    every = table.drop("pairs", "times").join(totals, "_row", "left").drop("_row")
    return every.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark, 4000, SLICE_BYTES)
    found = align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
