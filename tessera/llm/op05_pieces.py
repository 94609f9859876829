"""SentencePiece encoding and decoding: exact merge-type (BPE) encoding by backtracking.

A sequence of pieces is the merge result of a text exactly when every piece is the merge result
of its own characters and no merge crosses the border of any two neighbours. So one pass of an
Aho-Corasick automaton over the text gives the longest pieces, one behind the other, and the encoder
walks from the left: it takes the longest piece at a position (from that pass, else from the
automaton again) if it is compatible with the piece before it, else tries shorter prefixes, else
steps back. Compatibility of two pieces is decided by merging their joined characters again, and
remembered. A bitfield marks positions known to fail, so every position fails at most once.

No piece has a space mark behind another character. Merges thus never cross the border in front
of a space mark, and texts are encoded by space-delimited chunks; each distinct chunk of an Arrow
batch is encoded once, with a memory of chunks over batches that is bounded in bytes.

Defined results: null and empty texts give no ids and decode to the empty text; characters
without a piece become byte pieces; runs of spaces and literal space marks are kept as the
library keeps them (a literal mark decodes to a space); no two candidates tie, since a text has one
merge result (best score first, then leftmost); repeated rows give repeated rows; an empty table
gives an empty result; other columns are ignored. A text of any length is encoded whole in one task,
in memory with its ids as text: some 20 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .arrays import Lexicon, slices, sums
from .common import kept, small_batches

MARK = "▁"
#: Bytes of chunks that a worker remembers.
MEMORY = 64 << 20
#: Pairs of pieces whose compatibility a worker remembers.
PAIRS = 300_000
#: Bytes of text worked on at once within a batch.
SLICE_BYTES = 8_000_000


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = b[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(b):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, b[at : at + size]
            at += size


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a SentencePiece model file, by id.

    Types: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte.
    """
    pieces = []
    for field, value in fields(data):
        if field == 1:
            own = dict(fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, 1)))
    return pieces


def check_settings(data: bytes) -> None:
    """Refuses models whose settings the codec does not follow: merge type, no normalisation, a mark in front, blanks kept."""
    top = dict(fields(data))
    trainer, normalizer = dict(fields(top.get(2, b""))), dict(fields(top.get(3, b"")))
    if trainer.get(3, 1) != 2:
        raise ValueError("only merge-type (BPE) models are supported")
    if trainer.get(24, 0):
        raise ValueError("models with marks behind words are not supported")
    if normalizer.get(2, b"") or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only models without normalisation, with a mark in front and all blanks kept are supported")


class PieceCodec:
    """Encoder and decoder for one merge-type model with byte fallback and a leading space mark."""

    def __init__(self, model: bytes):
        import ahocorasick

        check_settings(model)
        pieces = read_model(model)
        if any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.text = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == 1}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a space mark behind another character")
        ranks = {s: r for r, s in enumerate(sorted({s for _, s, k in pieces if k == 1}, reverse=True))}
        self.rank = {p: ranks[s] for p, s, k in pieces if k == 1}
        self.number = [str(i) for i in range(len(pieces))]
        self.spelled = {i: p.replace(MARK, " ") for i, (p, _, k) in enumerate(pieces) if k == 1}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = next(i for i, k in enumerate(self.kind) if k == 2)
        # Only pieces that their own characters merge to can be part of a result.
        self.usable = {p for p in self.id if self.merge(p) == [p]}
        self.size = max(map(len, self.usable))
        self.length = [len(p) for p in self.text]
        # The automaton walks any start of a piece; each start knows the longest usable piece on its way.
        self.automaton = ahocorasick.Automaton()
        self.on_way: dict[str, int | None] = {}
        self.shorter: list[int | None] = [None] * len(pieces)
        for p in sorted(self.usable, key=len):
            self.automaton.add_word(p, self.id[p])
            self.shorter[self.id[p]] = next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.usable), None)
            for n in range(1, len(p) + 1):
                if p[:n] not in self.on_way:
                    self.on_way[p[:n]] = next((self.id[p[:m]] for m in range(n, 0, -1) if p[:m] in self.usable), None)
            self.on_way[p] = self.id[p]
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """The merge result of a short text: best rank first, then leftmost."""
        parts, rank = list(text), self.rank
        ranks = [rank.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1])

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.text[left], self.text[right]
        fits = self.merge(a + b) == [a, b]
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[left * 65536 + right] = fits
        return fits

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already: the merge result, by backtracking."""
        known = self.id.get(text)
        if known is not None and text in self.usable:
            return [known]
        # The longest pieces from the left, in one pass: where each begins.
        ahead_of = {end + 1 - self.length[i]: i for end, i in self.automaton.iter_long(text)}
        walk, on_way, length, size = self.automaton.longest_prefix, self.on_way, self.length, self.size
        pairs, shorter = self.pairs, self.shorter
        total, at, out, strange = len(text), 0, [], False
        failed = bytearray(total + 1)
        piece = -1
        while at < total:
            if piece == -1:
                piece = ahead_of.get(at)
                if piece is None:
                    ahead = text[at : at + size]
                    steps = walk(ahead)
                    piece = on_way[ahead[:steps]] if steps else None
                if piece is None:
                    # No piece has this character alone or in front: nothing merges with it.
                    piece, strange = -2 - ord(text[at]), True
            if piece < 0:
                fits, end = not failed[at + 1], at + 1
            else:
                end = at + length[piece]
                if failed[end]:
                    fits = False
                elif not out or out[-1] < 0:
                    fits = True
                else:
                    fits = pairs.get(out[-1] * 65536 + piece)
                    if fits is None:
                        fits = self.compatible(out[-1], piece)
            if fits:
                out.append(piece)
                at, piece = end, -1
                continue
            piece = shorter[piece] if piece >= 0 else None
            while piece is None:
                failed[at] = 1
                taken = out.pop()
                at -= length[taken] if taken >= 0 else 1
                piece = shorter[taken] if taken >= 0 else None
        if not strange:
            return out
        ids: list[int] = []
        for i in out:
            if i >= 0:
                ids.append(i)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unknown)
        return ids

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text, each with the space marks in front of it."""
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in self.encode_chunk(chunk)]

    def spell(self, ids: list[int]) -> str:
        """The text of ids with spaces for marks, the leading one included."""
        spelled = self.spelled
        try:
            return "".join([spelled[i] for i in ids])
        except KeyError:
            pass
        out, raw = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if self.kind[i] == 1:
                out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        spelled = self.spell(ids)
        return spelled[1:] if spelled.startswith(" ") else spelled


class BatchCodec:
    """Encodes and decodes arrays of texts, each distinct chunk once."""

    def __init__(self, model: bytes):
        self.codec = PieceCodec(model)
        self.lexicon = Lexicon(lambda words: self.columns([MARK + w for w in words]), MEMORY)

    def columns(self, chunks: list[str]) -> list[pa.Array]:
        """How many ids, the ids as text, and what they decode to."""
        codec, number = self.codec, self.codec.number
        ids = [codec.encode_chunk(c) for c in chunks]
        joined = pa.array([",".join([number[i] for i in own]) for own in ids], pa.string())
        return [pa.array(map(len, ids), pa.int64()), joined, pa.array(map(codec.spell, ids), pa.string())]

    def run(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, ids as comma-joined decimals, and decoded text of each text."""
        texts = pc.fill_null(texts, "")
        # Chunks of these are not what lies between single spaces; huge texts would not fit Arrow's 32-bit offsets.
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  | $|{MARK}|^$"), pc.greater(pc.binary_length(texts), 5 * SLICE_BYTES))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        distinct = lists.flatten().dictionary_encode()
        rows, (counts, ids, spelled) = self.lexicon(distinct.dictionary)
        at, offsets = pa.array(rows[distinct.indices.to_numpy()]), lists.offsets
        join = lambda values, by: pc.binary_join(pa.ListArray.from_arrays(offsets, values.take(at)), by).to_pylist()
        ids_of, texts_of = join(ids, ","), [t[1:] for t in join(spelled, "")]
        n_of = sums(counts.take(at).to_numpy(), offsets.to_numpy()).tolist()
        for i in pc.indices_nonzero(odd).to_pylist():
            own = self.columns(self.codec.chunks(texts[i].as_py()))
            n_of[i], ids_of[i] = sum(own[0].to_pylist()), ",".join(own[1].to_pylist())
            whole = "".join(own[2].to_pylist())
            texts_of[i] = whole[1:] if whole.startswith(" ") else whole
        return n_of, ids_of, texts_of


def encode_documents(documents: DataFrame, model_path: str, *, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; with_text adds ids and decoded."""
    with open(model_path, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, under 1 MB

    def run(batches):
        codec = kept(("op5", model_path), lambda: BatchCodec(model.value))
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                counts, ids, decoded = codec.run(batch.column("text"))
                out = {c: batch.column(c) for c in ("doc_id", *keep)}
                out |= {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(map(digest, ids), pa.string()), "decoded_sha256": pa.array(map(digest, decoded), pa.string())}
                if with_text:
                    out |= {"ids": pa.array(ids, pa.string()), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    source = documents.select("doc_id", *keep, "text")
    of = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join([f"`{c}` {of[c]}" for c in ("doc_id", *keep)] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["ids string, decoded string"] * with_text)
    return source.mapInArrow(run, schema)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark, 4000, SLICE_BYTES)
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
