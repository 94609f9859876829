"""Token-id files: byte-level ids compressed by Re-Pair per shard, readable at random.

Documents are range-partitioned and sorted by doc_id, tokenized, and written in shards of about
SHARD_IDS ids. In each shard the frequent pairs of neighbouring ids are replaced by nonterminals,
round by round, until no pair is frequent or all 16-bit symbols are used; pairs never cross the end
of a document, so every document keeps symbols of its own. A shard file holds the rules, the
expansion length of every symbol, and an index of its documents; one document, or any range of its
ids, is decoded from these alone.

File: b"RPR2", five little-endian unsigned 32-bit numbers (documents, rules, symbols, first
nonterminal, documents without an id, which come first), then the arrays doc_id int64, ids per
document uint32, symbols per document uint32, rules as pairs of uint32, expansion length per
nonterminal uint32, symbols as uint16.

Ids are those of the library's encode(text, add_special_tokens=False). A text is cut at its spaces
where the pre-tokenizer cuts it too, and each distinct word of a slice is encoded once, by
tiktoken's encoder built from the same file, if the file is of the form that both define alike
(checked when it is read), else by the library. Texts that hold an added token, such as
<|endoftext|>, or a space between other white space, where the pre-tokenizer looks further, go
through the library whole.

Defined results: null and empty texts have the end id only; rows without a doc_id come first;
repeated doc_ids stand beside each other, in order of their texts; an empty table gives an empty
result; other columns are ignored. A text of any length is one document of one shard, in memory
with its ids at once: some 20 bytes for each of its bytes.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import Lexicon, flat, slices
from .common import kept, put_file, scan_splits, shared_dir, small_batches, stash

#: The pattern that the byte-level pre-tokenizer splits by (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 0
SHARD_IDS = 1 << 20
SLICE_BYTES = 8_000_000
_SPACE = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Bytes of a word from which on the library encodes it.
LONG_WORD = 1000


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write each byte as, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of arrays of texts, each followed by END; each distinct word of an array is encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        if self.vocabulary > 1 << 16:
            raise ValueError("ids of more than 16 bits are not supported")
        # Added tokens are matched in the text before the pre-tokenizer splits it.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.quick = self.same_encoder(json.load(f))
        # Ids are remembered as packed 16-bit numbers.
        self.inner = Lexicon(lambda words: [pa.array([self.packed(" " + w) for w in words], pa.binary())])
        self.heads = Lexicon(lambda words: [pa.array([self.packed(w) for w in words], pa.binary())], 4 << 20)

    def packed(self, text: str) -> bytes:
        """Packed ids of a whole text, or of a word that begins where a pre-token begins."""
        if self.quick is None or len(text) > LONG_WORD:
            return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("H", self.quick(text)).tobytes()

    def same_encoder(self, file: dict):
        """An encoder of the same ids, if merges are ordered by the id of what they give and nothing else touches the text."""
        import tiktoken

        model, split = file["model"], file["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if file.get("normalizer") or not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("unk_token"):
            return None
        letters, vocab = byte_letters(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab.get(a + b) for a, b in pairs]
        if None in made or made != sorted(set(made)) or len(made) + 256 != len([w for w in vocab if w not in self.added]):
            return None
        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items() if w not in self.added}
        return tiktoken.Encoding("quick", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with END behind each text, and where each text's begin (one more than texts)."""
        texts = pc.fill_null(texts, "")
        if self.quick is None:
            odd = pc.greater(pc.binary_length(texts), 0)
        else:
            odd = pc.or_(pc.match_substring_regex(texts, f"(?:^|{_SPACE}) (?:{_SPACE}|$)"), pc.greater(pc.binary_length(texts), 8 * SLICE_BYTES))
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        words, ends = lists.flatten(), lists.offsets.to_numpy()[1:].astype(np.int64)
        first = lists.offsets.to_numpy()[:-1].astype(np.int64)
        distinct = words.dictionary_encode()
        rows, (inner,) = self.inner(distinct.dictionary)
        which = rows[distinct.indices.to_numpy()]
        # A text's first word has no space in front; texts that are not cut stand as a whole in its place.
        heads = words.take(pa.array(first)).dictionary_encode()
        rows, (front,) = self.heads(heads.dictionary)
        which[first] = len(inner) + rows[heads.indices.to_numpy()]
        whole = [array("H", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts.filter(odd).to_pylist()]
        which[first[odd.to_numpy(zero_copy_only=False)]] = len(inner) + len(front) + np.arange(len(whole))
        table = pa.concat_arrays([inner, front, pa.array([*whole, array("H", [END]).tobytes()], pa.binary())])
        ids, begin = flat(table.take(pa.array(np.insert(which, ends, len(table) - 1))))
        return ids.view(np.uint16), begin[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])] // 2


def expand(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The items of each symbol, one symbol after the other."""
    own = size[symbols]
    shift = start[symbols] - (np.cumsum(own) - own)
    return flat[np.repeat(shift, own) + np.arange(int(own.sum()))]


def re_pair(ids: np.ndarray, counts: np.ndarray, first: int, *, least: int = 16, per_round: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, symbols per document, and rules (pairs of symbols) that give back the ids.

    Each round counts all pairs of neighbours inside documents, gives the most frequent ones (at
    least `least` times, ties by the pair) nonterminals, and replaces them from the left. It ends
    when no pair is frequent or 16 bits are used up.
    """
    seq = ids.astype(np.uint32)
    inner = np.ones(len(seq), bool)  # false at the last symbol of each document
    inner[np.cumsum(counts) - 1] = False
    rules: list[np.ndarray] = []
    used = first
    while True:
        room = min(per_round, (1 << 16) - used)
        if len(seq) < 2 or room <= 0:
            break
        keys = (seq[:-1] << np.uint32(16) | seq[1:])[inner[:-1]]
        keys.sort()
        border = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        often = np.diff(border)
        enough = np.flatnonzero(often >= least)
        if not len(enough):
            break
        enough = enough[np.argsort(-often[enough], kind="stable")[:room]]
        chosen = np.sort(keys[border[enough]])
        left, right = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        left[chosen >> np.uint32(16)] = True
        right[chosen & np.uint32(0xFFFF)] = True
        at = np.flatnonzero(left[seq[:-1]] & right[seq[1:]] & inner[:-1])
        # A small table from the place of the left and of the right symbol among the chosen ones to the rule.
        lefts, rights = np.cumsum(left) - 1, np.cumsum(right) - 1
        table = np.full((int(lefts[-1]) + 1, int(rights[-1]) + 1), -1, np.int16)
        table[lefts[chosen >> np.uint32(16)], rights[chosen & np.uint32(0xFFFF)]] = np.arange(len(chosen))
        rule = table[lefts[seq[at]], rights[seq[at + 1]]]
        hit = rule >= 0
        at, rule = at[hit], rule[hit].astype(np.int64)
        # In a run of overlapping pairs every second one is replaced, from the left.
        head = np.concatenate([[True], at[1:] != at[:-1] + 1])
        place = at - at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))] if len(at) else at
        at, rule = at[place % 2 == 0], rule[place % 2 == 0]
        seq[at] = (used + rule).astype(np.uint32)
        inner[at] = inner[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, inner = seq[keep], inner[keep]
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], 1))
        used += len(chosen)
    ends = np.flatnonzero(~inner) + 1
    return seq.astype(np.uint16), np.diff(np.concatenate([[0], ends])).astype(np.uint32), np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each nonterminal stands for."""
    out = np.ones(first + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist(), first):
        out[i] = out[a] + out[b]
    return out[first:]


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, vocabulary: int, nameless: int = 0) -> bytes:
    """A shard file; nameless: how many documents in front have no id."""
    symbols, own, rules = re_pair(ids, counts, vocabulary)
    head = struct.pack("<4s5I", b"RPR2", len(doc_ids), len(rules), len(symbols), vocabulary, nameless)
    arrays = doc_ids.astype("<i8"), counts.astype("<u4"), own.astype("<u4"), rules.astype("<u4"), lengths(rules, vocabulary).astype("<u4"), symbols.astype("<u2")
    return head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """A shard file opened for reading."""

    def __init__(self, data: bytes):
        magic, docs, rules, symbols, self.vocabulary, self.nameless = struct.unpack_from("<4s5I", data)
        if magic != b"RPR2":
            raise ValueError("not a token shard")
        at, got = 24, []
        for kind, n in (("<i8", docs), ("<u4", docs), ("<u4", docs), ("<u4", 2 * rules), ("<u4", rules), ("<u2", symbols)):
            got.append(np.frombuffer(data, kind, n, at))
            at += got[-1].nbytes
        self.doc_ids, self.counts, self.own, pairs, long, self.symbols = got
        self.begin = np.concatenate([[0], np.cumsum(self.own, dtype=np.int64)])
        self.size = np.concatenate([np.ones(self.vocabulary, np.int64), long.astype(np.int64)])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.zeros(int(self.size.sum()), np.int32)
        self.flat[: self.vocabulary] = np.arange(self.vocabulary)
        for i, (a, b) in enumerate(pairs.reshape(-1, 2).tolist(), self.vocabulary):
            s, n = self.start[i], self.size[a]
            self.flat[s : s + n] = self.flat[self.start[a] : self.start[a] + n]
            self.flat[s + n : s + self.size[i]] = self.flat[self.start[b] : self.start[b] + self.size[b]]

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.start, self.size, self.flat)

    def document(self, number: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids [begin, end) of the document at a place in the shard, decoded from its symbols alone."""
        own = self.symbols[self.begin[number] : self.begin[number + 1]]
        upto = np.cumsum(self.size[own])
        end = int(self.counts[number]) if end is None else min(end, int(self.counts[number]))
        if begin >= end:
            return np.zeros(0, np.int32)
        a, b = int(np.searchsorted(upto, begin, "right")), int(np.searchsorted(upto, end, "left"))
        skipped = int(upto[a - 1]) if a else 0
        return expand(own[a : b + 1], self.start, self.size, self.flat)[begin - skipped : end - skipped]


def write_shards(documents: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Writes the shard files; part, number, n_docs, n_ids of each, in doc_id order by (part, number)."""
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * scan_splits(documents))
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        coder, part, number = kept(("op10", tokenizer_path), lambda: Encoder(tokenizer_path)), TaskContext.get().partitionId(), 0
        held: list = []

        def flush():
            nonlocal held, number
            doc_ids, counts, ids, nameless = map(np.concatenate, zip(*held))
            put_file(f"{folder}/part-{part:06d}-{number:06d}.rpr", pack(doc_ids, counts, ids, coder.vocabulary, int(nameless.sum())))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_docs": pa.array([len(counts)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})
            held, number = [], number + 1
            return row

        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                doc_ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy()
                nameless = pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False)
                ids, borders = coder.run(batch.column("text"))
                begin = 0
                while begin < len(doc_ids):
                    room = max(0, SHARD_IDS - sum(len(h[2]) for h in held))
                    end = min(len(doc_ids), max(begin + (not held), int(np.searchsorted(borders, borders[begin] + room, "right")) - 1))
                    if end > begin:
                        held.append((doc_ids[begin:end], np.diff(borders[begin : end + 1]), ids[borders[begin] : borders[end]], nameless[begin:end]))
                        begin = end
                    if begin < len(doc_ids):
                        yield flush()
        if held:
            yield flush()

    return stash(ordered.mapInArrow(run, "part int, number int, n_docs long, n_ids long"))


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the folder's files; shards is what write_shards gave."""

    def run(batches):
        kept("op10 reading")
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                shard = Shard(content.as_py())
                ids, n = shard.ids().astype("<u4"), len(shard.counts)
                ends = np.cumsum(shard.counts, dtype=np.int64)
                view, starts = memoryview(ids.tobytes()), ends - shard.counts
                part, number = path.rpartition("/")[2].removesuffix(".rpr").split("-")[1:]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([int(part)] * n, pa.int32()), "number": pa.array([int(number)] * n, pa.int32()),
                    "doc_id": pa.array(shard.doc_ids, mask=np.arange(n) < shard.nameless), "local": pa.array(starts), "n_tokens": pa.array(shard.counts.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                })

    files = shards.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.rpr").load(folder).select("path", "content")
    found = files.mapInArrow(run, "part int, number int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # Ids before each file: within its part, and in the parts before (one row for each task that wrote).
    own = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    front = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(front), F.lit(0)).alias("ahead"))
    offsets = shards.withColumn("inside", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(parts, "part").select("part", "number", (F.col("ahead") + F.col("inside")).alias("before"))
    return found.join(offsets, ["part", "number"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark, 4000, SLICE_BYTES)
    folder = shared_dir(spark)
    shards = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(shards, folder)
