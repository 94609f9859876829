"""N-gram Jaccard join with a token-group matrix: exact links between similar texts, as components.

A document's tokens are the 64-bit hashes of its distinct word shingles. Documents with equal sets
form one class. The join then goes through groups of similar classes:

1. Partition: classes that share a band of minimum hashes are compared with the smallest class of
   that band and with their next neighbours in it, if they agree in half of all bands; verified
   links join them into groups. This only shapes the groups: a link it misses is found in step 3.
2. Candidates: a set's tokens are dealt into K segments. Two sets whose similarity reaches the
   bound differ in at most D tokens, and each of those spoils one segment, so at least K - D minus
   the empty ones are equal. K and D follow from the sizes alone, in bands of sizes that can link.
   Equal segments point from a query class to a group, once per segment and group, never within a
   group.
3. Matrix: for the groups left, the union of their members' tokens is stored as a row of BITS bits,
   one per hashed token. Tokens of a query whose bits the row lacks are in no member, so its overlap
   with the union is bounded; it opens a group only if the bound reaches what a link to any member
   needs. The queries and rows that meet in a segment are asked in blocks of about BLOCK by BLOCK,
   dealt over all tasks; a family of texts just below the bound yields no rows there. In opened
   groups the members' own bits are asked in the same way, both ways round, in blocks too, and what
   is left is compared token by token.

Frequent passages make no long lists: a segment mixes tokens from the whole text, so equal segments
mean equal texts there, not a shared passage. Components of all verified links are the result.

Copies of a text never meet all at once: a task makes segments for the first of the copies it sees,
and the table of classes is brought to the copies, not the copies to it.

Defined results: rows without a doc_id cannot be the smallest of a component; they take part as
others do, and links that lead over such a row are followed, but one that reaches no row with a
doc_id has a null component_id; a doc_id of 2^62 or more raises an error; null texts and texts without words have an empty set and
link with nothing; with fewer words than a shingle the whole sequence is the one token; repeated
rows and equal texts are one class; rows of one doc_id with different texts are one class with the
tokens of the text whose digest is smallest; an empty table gives an empty result; other columns are
ignored. A text of any length is one set in one task, at some 60 bytes of memory for each of its
bytes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import LOWER, flat, grams, mix, slices, spans_hash, words
from .common import discard, hot_join, kept, small_batches, spread_join, stash
from .components import components

BANDS, ROWS = 8, 3
#: How often texts with too many empty segments are dealt anew before they share one signature.
DEALS = 8
SIGNATURE_BITS = 48
#: Bits of a row of the token-group matrix.
BITS = 2048
#: Queries, and matrix rows, that one task looks at together.
BLOCK = 512
#: Classes of one band that are put in order together.
BAND_ROWS = 1000
#: Ids of rows without a doc_id begin here; doc_ids lie below.
NAMELESS = 1 << 62
#: Neighbours within a band that a class is compared with while groups are shaped.
NEIGHBOURS = 3
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def token_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = spans_hash(data, starts, ends)
    shingles, at = grams(hashes, first, n)
    border = np.searchsorted(at, first).tolist()
    first = first.tolist()
    out = []
    for i in range(len(first) - 1):
        if border[i + 1] > border[i]:
            own = np.sort(shingles[border[i] : border[i + 1]])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif first[i + 1] > first[i]:
            joint = np.uint64(n)
            for h in hashes[first[i] : first[i + 1]]:
                joint = mix(np.array([joint ^ h], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
            out.append(np.array([joint], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache
def size_bands(percent: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """First size of each band, and per band (segments, most empty ones, least common ones).

    A set and one it can link to lie in the same band or in neighbouring ones. The figures of a
    band hold for pairs whose smaller set lies in it; no segments: only equal sets can link.
    """
    begins, plans = [1], []
    while begins[-1] < 1 << 40:
        low = begins[-1]
        begins.append(low * 100 // percent + 1)
        high = begins[-1] - 1
        differ = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
        common, empty = 1, 0
        for _ in range(4):
            k = differ + common + empty
            empty = int(np.ceil(k * np.exp(-low / k))) + 1
        plans.append((differ + common + empty, empty, common) if differ else (0, 0, 0))
    return begins, plans


def signatures(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The signatures of each set's segments, for its own band and as the larger set for the band below."""
    begins, plans = size_bands(percent)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    band = np.searchsorted(begins, sizes, "right") - 1
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for down in (0, 1):
        scheme = band - down
        k = np.array([plans[b][0] if b >= 0 else 0 for b in scheme], np.int64)
        most = np.array([plans[b][1] if b >= 0 else 0 for b in scheme], np.int64)
        live = k > 0
        for deal in range(DEALS):
            if not live.any():
                break
            use = live[owner]
            t, o = tokens[use], owner[use]
            base = np.cumsum(np.where(live, k, 0)) - np.where(live, k, 0)
            spread = mix(t ^ np.uint64(0xA5A5 + 977 * deal))
            place = base[o] + ((spread >> np.uint64(11)) % k[o].astype(np.uint64)).astype(np.int64)
            total = int(np.where(live, k, 0).sum())
            acc, filled = np.zeros(total, np.uint64), np.zeros(total, bool)
            np.add.at(acc, place, mix(t + np.uint64(deal)))
            filled[place] = True
            doc = np.repeat(np.arange(len(sets)), np.where(live, k, 0))
            number = np.arange(total) - base[doc]
            key = mix(acc ^ mix((scheme[doc].astype(np.uint64) << np.uint64(40)) + (number.astype(np.uint64) << np.uint64(4)) + np.uint64(deal)))
            found.append((doc[filled], key[filled]))
            empties = np.bincount(doc[~filled], minlength=len(sets))
            live = live & (empties > most)
        rest = np.flatnonzero(live)
        for turn in range(4096 if len(rest) else 0):
            # Too many empty segments in every deal: these few share signatures enough to be compared with each other.
            need = np.array([plans[b][2] for b in scheme[rest]])
            if not (need > turn).any():
                break
            found.append((rest[need > turn], mix((scheme[rest[need > turn]].astype(np.uint64) << np.uint64(20)) + np.uint64(turn * 16 + 15))))
    docs = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    keys = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
    order = np.argsort(docs, kind="stable")
    keys = (keys[order] >> np.uint64(64 - SIGNATURE_BITS)).astype(np.int64)
    return np.split(keys, np.searchsorted(docs[order], np.arange(1, len(sets)))) if sets else []


def band_keys(sets: list[np.ndarray]) -> list[list[int]]:
    """A key per band from the minimum hashes of each set; none for empty sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(sizes)
    out: list[list[int]] = [[] for _ in sets]
    if len(full):
        tokens = np.concatenate([sets[i] for i in full])
        begin = np.cumsum(sizes[full]) - sizes[full]
        least = [np.minimum.reduceat((tokens ^ (tokens >> np.uint64(29))) * s, begin) for s in _SEEDS]
        keys = np.zeros((len(full), BANDS), np.uint64)
        for b in range(BANDS):
            joint = np.full(len(full), b + 1, np.uint64)
            for r in range(ROWS):
                joint = mix(joint ^ least[b * ROWS + r])
            keys[:, b] = joint
        for i, row in zip(full.tolist(), keys.astype(np.int64).tolist()):
            out[i] = row
    return out


def prints(sets: list[np.ndarray]) -> list[bytes | None]:
    """A digest of each whole set; none for empty sets."""
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]


def ids_of(batch: pa.RecordBatch, found: list[bytes | None]) -> np.ndarray:
    """The doc_ids of a batch; rows without one are named by the digest of their set."""
    column = batch.column("doc_id")
    ids = pc.fill_null(column, 0).to_numpy().copy()
    for i in pc.indices_nonzero(pc.is_null(column)).to_pylist():
        ids[i] = NAMELESS + (int.from_bytes((found[i] or bytes(8))[:8], "big") >> 2)
    return ids


def describe(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, nameless, size, print (of the whole set), bands of every document."""

    def run(batches):
        kept("op4")
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = token_sets(batch.column("text"), n)
                found = prints(sets)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids_of(batch, found)), "nameless": pc.is_null(batch.column("doc_id")), "size": pa.array([len(s) for s in sets], pa.int64()),
                    "print": pa.array(found, pa.binary()), "bands": pa.array(band_keys(sets), pa.list_(pa.int64())),
                })

    return documents.mapInArrow(run, "doc_id long, nameless boolean, size long, print binary, bands array<long>")


def segment_rows(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, signature: one row per filled segment; of the copies that a task sees, the first stands for all."""

    def run(batches):
        kept("op4")
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole, "text", 500_000):
                sets = token_sets(batch.column("text"), n)
                found = prints(sets)
                ids, new = ids_of(batch, found), []
                for i, own in enumerate(found):
                    if own is not None and own not in seen:
                        new.append(i)
                        seen.add(own)
                if len(seen) > 300_000:
                    seen.clear()
                keys = signatures([sets[i] for i in new], percent)
                ids = np.repeat(ids[new], list(map(len, keys)))
                keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                for i in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[i : i + 100_000]), "signature": pa.array(keys[i : i + 100_000])})

    return documents.mapInArrow(run, "doc_id long, signature long")


def token_bits(tokens: np.ndarray) -> list[int]:
    """The matrix row of a set: BITS bits as 64-bit numbers."""
    filled = np.zeros(BITS, bool)
    filled[(tokens >> np.uint64(20)) % np.uint64(BITS)] = True
    return np.packbits(filled).view(np.int64).tolist()


def stored_sets(documents: DataFrame, n: int) -> DataFrame:
    """class, print, tokens (sorted, as bytes), bits of the given documents."""

    def run(batches):
        kept("op4")
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = token_sets(batch.column("text"), n)
                found = prints(sets)
                yield pa.RecordBatch.from_pydict({
                    "class": pa.array(ids_of(batch, found)), "print": pa.array(found, pa.binary()),
                    "tokens": pa.array([s.tobytes() for s in sets], pa.binary()), "bits": pa.array(map(token_bits, sets), pa.list_(pa.int64())),
                })

    return documents.mapInArrow(run, "class long, print binary, tokens binary, bits array<long>")


def asked_in_blocks(queries: DataFrame, rows: DataFrame, query_bits: DataFrame, row_bits: DataFrame, percent: int, *, members: bool) -> DataFrame:
    """class, size, other: the queries and rows that meet in a key and pass the bound of their bits.

    queries: (key, class, group, size); rows: (key, other, small, large), the least and most tokens of
    what a row stands for: a group with its union, or a member with its own tokens. Bits come by class
    (class, bits) and by row (other, bits), only where they are compared.
    """
    own, theirs = (df.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n)) for df, n in ((queries, "_nq"), (rows, "_nr")))
    blocks = stash(own.join(theirs, "key"))
    number = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = hot_join(queries, blocks, "key").select("key", number("class", "_nq").alias("qb"), every("_nr").alias("rb"), "class", "group", "size")
    r = hot_join(rows, blocks, "key").select("key", every("_nq").alias("qb"), number("other", "_nr").alias("rb"), "other", "small", "large")
    columns = ("key", "qb", "rb", "kind", "class", "group", "size", "large", "bits")
    one = q.join(query_bits, "class").select("key", "qb", "rb", F.lit(0).alias("kind"), "class", "group", "size", F.lit(0).cast("long").alias("large"), "bits")
    two = r.join(row_bits, "other").select("key", "qb", "rb", F.lit(1).alias("kind"), F.col("other").alias("class"), F.col("other").alias("group"), F.col("small").alias("size"), "large", "bits")
    dealt = one.union(two).select(*columns).repartition("key", "qb", "rb").sortWithinPartitions("key", "qb", "rb", "kind")

    def ask(part):
        key, kind, cls, group, size, large, bits = part
        mine, theirs = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        for begin in range(0, len(mine), 64):
            m = mine[begin : begin + 64]
            fits = (100 * large[theirs][None, :] >= percent * size[m][:, None]) & (100 * size[m][:, None] >= percent * size[theirs][None, :])
            if not members:
                fits &= group[m][:, None] > group[theirs][None, :]
            a, b = np.nonzero(fits)
            x, y = bits[m[a]], bits[theirs[b]]
            shared = size[m[a]] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
            if members:
                shared = np.minimum(shared, size[theirs[b]] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
                good = (100 + percent) * shared >= percent * (size[m[a]] + size[theirs[b]])
            else:
                # A link to any member takes at least what the smallest one would.
                good = (100 + percent) * shared >= percent * (size[m[a]] + size[theirs[b]])
            yield cls[m[a[good]]], size[m[a[good]]], group[theirs[b[good]]]

    def run(batches):
        kept("op4")
        held = None

        def pieces():
            nonlocal held
            for batch in batches:
                now = [np.stack([batch.column(c).to_numpy() for c in ("key", "qb", "rb")], 1)]
                now += [batch.column(c).to_numpy() for c in ("kind", "class", "group", "size", "large")]
                now.append(batch.column("bits").flatten().to_numpy().reshape(-1, BITS // 64).view(np.uint64))
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
                border = np.flatnonzero((held[0][1:] != held[0][:-1]).any(1)) + 1
                if len(border):
                    # All but the last run are whole; a run has about 2 * BLOCK rows at most.
                    for x, y in zip([0, *border[:-1]], border):
                        yield [v[x:y] for v in held]
                    held = [v[border[-1] :] for v in held]
            if held is not None and len(held[0]):
                yield held

        seen = set()
        for part in pieces():
            for classes, sizes, others in ask(part):
                fresh = [p for p in zip(classes.tolist(), sizes.tolist(), others.tolist()) if p not in seen]
                if fresh:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.update(fresh)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*fresh)], ["class", "size", "other"])

    return dealt.mapInArrow(run, "class long, size long, other long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the bound, by counting their common tokens.

    pairs is read more than once, so it should be a stashed table. A class that very many pairs name
    is dealt over several tasks, its tokens repeated for each.
    """

    def run(batches):
        kept("op4")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append(len(q) > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    own = lambda c, t: sets.select(F.col("class").alias(c), F.col("tokens").alias(t))
    met = spread_join(pairs, own("a", "ta"), "a", "b")
    return met.join(own("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def similar(documents: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included)."""
    ids = F.col("doc_id").cast("long")
    ids = F.when(ids >= NAMELESS, F.raise_error(F.lit("doc_ids have to lie below 2^62"))).otherwise(ids)
    source = documents.select(ids.alias("doc_id"), "text")
    described = stash(describe(source, n))
    first = described.where(F.col("print").isNotNull()).groupBy("print").agg(F.min("doc_id").alias("class"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stash(hot_join(described.drop("bands"), first, "print", "left").withColumn("class", F.coalesce("class", "doc_id")))
    classes = stash(members.where("doc_id = class and size > 0").groupBy("class").agg(F.min(F.struct("print", "size")).alias("p")).select("class", "p.print", "p.size"))

    # Step 1, pairs to compare: each class with the smallest one of each of its bands, and with its next ones there.
    banded = described.drop("nameless").withColumnRenamed("doc_id", "class").join(classes.select("class", "print"), ["class", "print"], "left_semi").dropDuplicates(["class"])
    banded = banded.select("class", "size", "bands", F.explode("bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.min(F.struct("class", "size", "bands")).alias("p"), F.count("*").alias("n")).where("n > 1")
    near = hot_join(banded, pivots, "band")
    near = near.withColumn("part", F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / BAND_ROWS)))
    in_band = Window.partitionBy("band", "part").orderBy("bands", "class")
    own = F.struct(F.col("class").alias("first"), F.col("size").alias("its"), F.col("bands").alias("theirs"))
    pivot = F.struct(F.col("p.class").alias("first"), F.col("p.size").alias("its"), F.col("p.bands").alias("theirs"))
    others = near.withColumn("o", F.array(pivot, *[F.lead(own, k).over(in_band) for k in range(1, NEIGHBOURS + 1)]))
    beside = others.select("class", "size", "bands", F.explode("o").alias("o")).where("o is not null").select("class", "size", "bands", "o.*")
    agree = F.aggregate(F.zip_with("bands", "theirs", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    beside = beside.where((F.col("class") != F.col("first")) & (100 * F.least("size", "its") >= percent * F.greatest("size", "its")) & (agree >= BANDS // 2))
    shaping = stash(beside.select(F.least("class", "first").alias("a"), F.greatest("class", "first").alias("b")).distinct())

    # Step 2, common segments. Copies of a class have the same segments; they fall together here.
    rows = segment_rows(source, n, percent)
    shared = rows.withColumn("n", F.count("*").over(Window.partitionBy("signature"))).where("n > 1")
    class_of = members.select("doc_id", "class").distinct().join(classes.select("class", "size"), "class")
    held = stash(shared.join(class_of, "doc_id").groupBy("signature", "class").agg(F.min("size").alias("size")))
    several = held.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature")
    met_once = stash(hot_join(held, several, "signature"))
    discard(described, held)
    held = met_once
    involved = stash(held.select("class").union(shaping.select("a")).union(shaping.select("b")).distinct().join(classes.select("class", "print"), "class"))
    texts = source.join(involved.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").union(source.where(F.col("doc_id").isNull()))
    sets = stash(stored_sets(texts, n).join(involved, ["class", "print"], "left_semi").dropDuplicates(["class"]).drop("print"))

    links = stash(verified(shaping, sets, percent))
    groups = stash(components(links).select(F.col("node").alias("class"), F.col("label").alias("group")))
    of_group = stash(held.join(groups, "class", "left").withColumn("group", F.coalesce("group", "class")))
    apart = of_group.groupBy("signature").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("signature")
    met = stash(hot_join(of_group, apart, "signature").select(F.col("signature").alias("key"), "class", "group", "size"))
    discard(held, of_group)

    # Step 3: a bound on the overlap with each group's token union, then with its members.
    all_groups = sets.select("class", "bits").join(groups, "class", "left").withColumn("group", F.coalesce("group", "class"))
    asked = all_groups.join(met.select("group").distinct(), "group", "left_semi")
    matrix = stash(asked.groupBy(F.col("group").alias("other")).agg(F.array(*[F.bit_or(F.col("bits")[i]) for i in range(BITS // 64)]).alias("bits")))
    targets = met.groupBy("key", F.col("group").alias("other")).agg(F.min("size").alias("small"), F.max("size").alias("large"))
    opened = stash(asked_in_blocks(met, stash(targets), sets.select("class", "bits"), matrix, percent, members=False))
    inside = asked.join(classes.select("class", "size"), "class").select(F.col("group").alias("key"), F.col("class").alias("other"), F.col("size").alias("small"), F.col("size").alias("large"))
    inside = stash(inside.join(opened.select(F.col("other").alias("key")).distinct(), "key", "left_semi"))
    queries = stash(opened.select(F.col("other").alias("key"), "class", F.col("other").alias("group"), "size"))
    compare = asked_in_blocks(queries, inside, sets.select("class", "bits"), sets.select(F.col("class").alias("other"), "bits"), percent, members=True)
    compare = stash(compare.select(F.col("class").alias("a"), F.col("other").alias("b")))
    found = stash(verified(compare, sets, percent))
    labels = components(links.union(found)).withColumnRenamed("node", "class")
    discard(shaping, involved, sets, groups, met, matrix, opened, inside, queries, compare, links, found, classes)
    result = hot_join(members, labels, "class", "left").withColumn("_c", F.coalesce("label", "class"))
    named = lambda c, gone: F.when(~gone, F.col(c))
    return result.select(named("doc_id", F.col("nameless")).alias("doc_id"), F.col("size").alias("n_shingles"), named("_c", F.col("_c") >= NAMELESS).alias("component_id"))


def op4_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\x00', ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS t FROM w),
n AS (SELECT doc_id, len(t)::BIGINT AS n, list_sort(t) AS t FROM s),
classes AS (SELECT min(doc_id) AS c, any_value(n) AS n, t FROM n WHERE n > 0 GROUP BY t),
tokens AS (SELECT c, n, unnest(t) AS tok FROM classes),
df AS (SELECT tok, count(*) AS f FROM tokens GROUP BY tok),
ordered AS (SELECT c, n, tok, row_number() OVER (PARTITION BY c ORDER BY f, tok) AS k FROM tokens JOIN df USING (tok)),
prefix AS (SELECT c, n, tok FROM ordered WHERE k <= n - (90 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.c AS a, b.c AS b FROM prefix a JOIN prefix b ON a.tok = b.tok AND a.c < b.c
         AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM cand JOIN classes x ON x.c = a JOIN classes y ON y.c = b
  WHERE 100 * len(list_intersect(x.t, y.t)) >= 90 * (x.n + y.n - len(list_intersect(x.t, y.t)))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS c, min(b) AS label FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(comp.label, n.doc_id) AS component_id
FROM n LEFT JOIN classes ON n.t = classes.t LEFT JOIN comp ON comp.c = classes.c
"""
