"""WARC: writing pages as archives and reading them back, with segment reassembly.

Each page becomes one record, an HTTP answer in chunked framing; a payload that an earlier page has
too becomes a revisit record that names that page's record. Long records are split: the first
segment stands in for the record, the others are continuation records that carry the origin's
identifier and a segment number, the last one also the total length. Files are compressed record
by record and rolled at a fixed size. Reading parses every file by itself, groups segments by
origin identifier, orders them by number, checks numbers and total length, and only then decodes
the chunked framing.

Equal payloads meet through their digests. Digests that more than one in HOT_SHARE of all rows
have (so HOT_SHARE of them at most) are told to all tasks beforehand; their copies go without
their payload and stay spread over all tasks.

Defined results: null html is an empty payload; payloads under MIN_SHARED bytes are never
revisited; rows without a page_id are responses, which none revisits; of equal payloads the smallest
page_id is the response, and repeated rows of that page are responses too; equal rows are told apart
by their turn; an empty table gives an empty result; other columns are ignored. A record with missing
or extra segments, a wrong total length or broken framing raises an error. A payload of any length is
written in segments; it is whole in the memory of one task when it is written and when it is joined.
"""

from __future__ import annotations

import gzip
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, kept, put_file, shared_dir, small_batches, stash

MIN_SHARED = 100
SEGMENT_BYTES = 16_384
FILE_BYTES = 8_000_000
_CHUNK = 4096
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "page_id long, kind string, origin string, number int, total long, digest string, refers_to long, block binary"


def chunked(body: bytes) -> bytes:
    """The body in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + _CHUNK]), body[i : i + _CHUNK]) for i in range(0, len(body), _CHUNK)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The body in chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(data) < at + size + 2 or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunked framing")
        out.append(data[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, turn: int) -> list[bytes]:
    """The records of one page: one, or as many as it has segments."""
    # Pages without an id are told apart by their address.
    home = lambda page: f"{page}:{digest[:16]}" if page is not None else f":{digest[:16]}-{zlib.crc32((url or '').encode('utf-8', 'surrogatepass')):08x}"
    name = lambda page, n: f"<urn:page:{home(page)}:{n}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    common = [("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", uri)] if uri else [("WARC-Date", "2000-01-01T00:00:00Z")]
    common += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(page_id, turn)), *common, ("WARC-Refers-To", name(refers_to, 0)), ("WARC-Profile", _PROFILE)], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    origin = name(page_id, turn)
    if len(block) <= SEGMENT_BYTES:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common], block)]
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{origin[:-1]}:{n}>"), common[0], ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(n))]
        out.append(_record(fields + [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(parts)), part))
    return out


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size, refers_to (null for responses), _place: where equal payloads meet."""
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    source = source.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    shared = stash(source.where(F.col("size") >= MIN_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.sum("n")).collect()[0][0] or 0
    # Fewer than HOT_SHARE digests can each have more than one in HOT_SHARE of these rows.
    hot = shared.where(F.col("n") > F.lit(total / HOT_SHARE)).select(F.col("digest").alias("_d"), F.col("first").alias("_hot"))
    rows = source.join(F.broadcast(hot), F.col("digest") == F.col("_d"), "left").drop("_d")
    settled = (F.col("size") < MIN_SHARED) | F.col("_hot").isNotNull()
    rows = rows.withColumn("html", F.when(F.col("_hot").isNull() | F.col("page_id").isNull() | (F.col("_hot") == F.col("page_id")), F.col("html")))
    mine = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("url", F.lit("")))))
    rows = rows.withColumn("_place", F.when(settled | F.col("page_id").isNull(), F.concat_ws("#", "digest", mine)).otherwise(F.col("digest")))
    first = shared.where(F.col("n") <= F.lit(total / HOT_SHARE)).select(F.col("digest").alias("_place"), "first")
    joined = rows.join(first, "_place", "left").withColumn("first", F.coalesce("_hot", "first"))
    return joined.select("page_id", "url", "html", "digest", "size", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"), "_place")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages as .warc.gz files into the folder; file, n_records of each."""
    planned = plan_records(pages)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = planned.repartition(parts, "_place").sortWithinPartitions("page_id", "digest", "url").drop("_place")

    def run(batches):
        kept("op2")
        from pyspark import TaskContext

        part, held, size, made, n = TaskContext.get().partitionId(), [], 0, 0, 0
        seen: tuple = ()
        turn = 0
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["page_id"], row["digest"], None if row["page_id"] is not None else row["url"])
                turn = turn + 1 if key == seen else 0
                seen = key
                payload = (row["html"] or "").encode("utf-8")
                for record in records(row["page_id"], row["url"], payload, row["digest"], row["size"], row["refers_to"], turn):
                    held.append(gzip.compress(record, 3, mtime=0))
                    size += len(held[-1])
                    n += 1
                    if size >= FILE_BYTES:
                        name = f"part-{part:06d}-{made:06d}.warc.gz"
                        put_file(f"{folder}/{name}", b"".join(held))
                        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64())})
                        held, size, made, n = [], 0, made + 1, 0
        if held:
            name = f"part-{part:06d}-{made:06d}.warc.gz"
            put_file(f"{folder}/{name}", b"".join(held))
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64())})

    return stash(ordered.mapInArrow(run, "file string, n_records long"))


def members(data: bytes, step: int = 16_384):
    """The unzipped members of a .warc.gz file, in one walk over its bytes."""
    view, at = memoryview(data), 0
    while at < len(view):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if at >= len(view):
                raise ValueError("a .warc.gz file ends within a record")
            parts.append(unzip.decompress(view[at : at + step]))
            at = min(len(view), at + step) - len(unzip.unused_data)
        yield b"".join(parts)


def parse(data: bytes):
    """(fields, block) of each record of a .warc.gz file, member by member."""
    for raw in members(data):
        at = 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            size = int(fields["content-length"])
            block = raw[end + 4 : end + 4 + size]
            if len(block) != size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
                raise ValueError("a WARC record is shorter than its Content-Length")
            yield fields, block
            at = end + 8 + size


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the folder's archives: page_id, kind, origin, number (null: not segmented), total, digest, refers_to, block."""

    def run(batches):
        kept("op2")
        page = lambda name: int(number) if (number := name.split(":")[2]) else None
        schema = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in parse(content.as_py()):
                    get = fields.get
                    origin = get("warc-segment-origin-id") or fields["warc-record-id"]
                    number, total, refers = get("warc-segment-number"), get("warc-segment-total-length"), get("warc-refers-to")
                    rows.append((page(origin), fields["warc-type"], origin, int(number) if number else None, int(total) if total else None, (get("warc-payload-digest") or "").removeprefix("sha256:"), page(refers) if refers else None, block))
                    size += len(block)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(run, PARSED)


def reassemble(parsed: DataFrame) -> DataFrame:
    """Whole records: page_id, kind, digest, refers_to, block. Segments are joined in order and checked.

    The segments of a record come to one task in order of their numbers; each is copied once, and a
    task holds one record at a time.
    """
    columns = ("page_id", "kind", "digest", "refers_to", "block")
    whole = parsed.where(F.col("number").isNull()).select(*columns)
    ordered = parsed.where(F.col("number").isNotNull()).repartition("origin").sortWithinPartitions("origin", "number")

    def joined(origin: str, head: tuple, parts: list[bytes], total: int | None) -> pa.RecordBatch:
        if sum(map(len, parts)) != total:
            raise ValueError(f"segments missing or of a wrong total length: {origin}")
        return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(head, (pa.int64(), pa.string(), pa.string(), pa.int64()))), pa.array([b"".join(parts)], pa.binary())], names=list(columns))

    def run(batches):
        kept("op2")
        origin, head, parts, total = None, (), [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("origin", "number", *columns, "total"))):
                if row[0] != origin:
                    if origin is not None:
                        yield joined(origin, head, parts, total)
                    origin, head, parts, total = row[0], row[2:6], [], None
                parts.append(row[6])
                if row[1] != len(parts):
                    raise ValueError(f"segments missing or of a wrong total length: {origin}")
                total = row[7] if row[7] is not None else total
        if origin is not None:
            yield joined(origin, head, parts, total)

    return whole.unionByName(ordered.mapInArrow(run, "page_id long, kind string, digest string, refers_to long, block binary"))


def payloads(archived: DataFrame) -> DataFrame:
    """page_id, record_type, digest, refers_to, payload_bytes, payload (null for revisits); responses are checked against their digest."""

    def run(batches):
        kept("op2")
        import hashlib

        for batch in batches:
            sizes, bodies = [], []
            for kind, digest, block in zip(*(batch.column(c).to_pylist() for c in ("kind", "digest", "block"))):
                head, _, body = block.partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
                if kind == "revisit":
                    sizes.append(int(fields[b"content-length"]))
                    bodies.append(None)
                    continue
                payload = unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError("a payload does not have the digest that its record names")
                sizes.append(len(payload))
                bodies.append(payload)
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "record_type": batch.column("kind"), "digest": batch.column("digest"),
                "refers_to": batch.column("refers_to"), "payload_bytes": pa.array(sizes, pa.int64()), "payload": pa.array(bodies, pa.binary()),
            })

    return archived.mapInArrow(run, "page_id long, record_type string, digest string, refers_to long, payload_bytes long, payload binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_dir(spark)
    if write_archives(pages, folder).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = payloads(reassemble(read_records(spark, folder)))
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM m
"""
