"""Each operator against a brute-force version or an exact round trip, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import gzip
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, op01_mixing, op02_warc, op03_chat, op04_similar, op05_pieces, op06_quality, op07_secrets, op08_flac, op09_private, op10_tokens, registry
from tessera.llm.common import shared_dir
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def tokenizer(name):
    return pytest.importorskip("public_tokenizers").path(name)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql)


def same(df, relation):
    names = [c[0] for c in relation.description]
    key = lambda r: [str(v) for v in r]
    got = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=key)
    want = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in relation.fetchall()), key=key)
    assert got == want


def test_mixing_follows_sql(documents):
    unique = documents.dropDuplicates(["doc_id"])
    same(op01_mixing.mix(unique).drop("source"), duck(registry.SQL["op1_mixing"], documents=unique.select("doc_id", "source", "text")))


def test_mixing_comes_near_its_targets(documents):
    rows = op01_mixing.mix(documents).collect()
    assert len(rows) == documents.count() and all(r.taken <= 3 * r.size for r in rows)
    largest = max(r.size for r in rows)
    by = collections.defaultdict(int)
    for r in rows:
        by[r.source, r.target, r.source_size] += r.taken
    assert abs(sum(by.values()) - sum(r.size for r in rows)) <= largest
    for (_, target, _), taken in by.items():
        assert abs(taken - target) <= 2 * largest


def test_mixing_of_nothing(empty):
    assert op01_mixing.mix(empty).count() == 0


@pytest.fixture(scope="module")
def pages(spark, texts):
    html = [*texts, "y" * 99, "y" * 99, "z" * 100, "z" * 100, "z" * 100, "long " * 20_000, "long " * 20_000]
    rows = [(i, f"http://x/{i} \r\n?é" if i % 3 else None, h, i) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, first long")


def test_archives_round_trip(spark, pages, tmp_path):
    folder = shared_dir(spark)
    op02_warc.write_archives(pages, folder)
    found = op02_warc.payloads(op02_warc.reassemble(op02_warc.read_records(spark, folder)))
    got = {r.page_id: r for r in found.collect()}
    assert len(got) == pages.count()
    first = {}
    for r in pages.orderBy("page_id").collect():
        payload = (r.html or "").encode()
        home = first.setdefault(payload, r.page_id) if len(payload) >= 100 else r.page_id
        out = got[r.page_id]
        assert (out.record_type, out.refers_to) == (("response", None) if home == r.page_id else ("revisit", home))
        assert out.payload_bytes == len(payload) and out.digest == hashlib.sha256(payload).hexdigest()
        assert out.payload is None if home != r.page_id else bytes(out.payload) == payload
    kinds = {r.kind for r in op02_warc.read_records(spark, folder).select("kind").distinct().collect()}
    assert kinds == {"response", "continuation", "revisit"}


def test_repeated_pages_and_no_pages(spark):
    rows = [(1, None, "q" * 200), (1, None, "q" * 200), (2, None, "q" * 200)]
    folder = shared_dir(spark)
    op02_warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    found = op02_warc.payloads(op02_warc.reassemble(op02_warc.read_records(spark, folder)))
    assert sorted((r.page_id, r.record_type) for r in found.collect()) == [(1, "response"), (1, "response"), (2, "revisit")]
    assert op02_warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), shared_dir(spark)).isEmpty()


def test_damaged_segments_are_found(spark):
    payload = b"p" * 60_000
    parts = op02_warc.records(5, None, payload, hashlib.sha256(payload).hexdigest(), len(payload), None, 0)
    assert len(parts) > 3
    parsed = [x for p in parts for x in op02_warc.parse(gzip.compress(p))]
    rows = [(5, f["warc-type"], f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f.get("warc-payload-digest", "").removeprefix("sha256:"), None, b) for f, b in parsed]
    whole = spark.createDataFrame(rows[::-1], op02_warc.PARSED)
    assert bytes(op02_warc.payloads(op02_warc.reassemble(whole)).collect()[0].payload) == payload
    for bad in (rows[:1] + rows[2:], rows[:-1]):
        with pytest.raises(Exception, match="segments missing"):
            op02_warc.reassemble(spark.createDataFrame(bad, op02_warc.PARSED)).collect()
    with pytest.raises(ValueError):
        op02_warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_chat_follows_sql(spark, texts):
    r = random.Random(2)
    rows = [(c, t, ("system" if t == 0 and c % 2 else "user" if t % 2 else "assistant"), r.choice(texts[:60]), 0) for c in range(6) for t in range(r.choice((1, 5, 30, 300)))]
    rows += [(9, 1, None, None, 0), (9, 1, "us:er\n#", "### a:\n</turn>\n\\", 0), (None, 0, "assistant", "lost", 0), rows[0]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window long")
    table = table.where(~F.coalesce(F.col("text"), F.lit("")).contains("\x00"))
    got = op03_chat.read_back(op03_chat.windows(table))
    want = duck(registry.SQL["op3_chat"], conversations=table.drop("window"))
    same(got, want.filter("conv_id is null or conv_id <> -7"))


def test_chat_windows_keep_budget_and_mask(spark):
    rows = [(1, t, "system" if t == 0 else "user" if t % 2 else "assistant", "w " * 50) for t in range(41)]
    found = op03_chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
    assert len(found) > 3
    for w in found[1:]:
        turns = op03_chat.parse(w.text)
        assert turns[0][0] == "system" and w.context_turns == 1 + op03_chat.HISTORY
        assert len(w.loss) == sum(role == "assistant" for role, _ in turns[w.context_turns :])
        assert len(WORD.findall(w.text)) < op03_chat.BUDGET + 54 * (2 + w.context_turns)
    assert op03_chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_components(rows, n, percent):
    sets, label = {}, {}
    for i, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        label[i] = i
    ids = sorted(sets)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_similar_follows_brute_force(spark, documents, n, percent):
    r = random.Random(5)
    extra, base = [], ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(160)]
    for i in range(120):
        v = list(base[: r.choice((11, 25, 60, 160))])
        for _ in range(r.randint(0, max(1, len(v) // 14))):
            v[r.randrange(len(v))] = r.choice("xyz") + str(r.randint(0, 99))
        extra.append((10_000 + i, " ".join(v)))
    table = documents.select("doc_id", "text", "size", "class").union(spark.createDataFrame(extra, "doc_id long, text string").select("doc_id", "text", F.lit(0), F.lit("c")))
    rows = {(x.doc_id, x.text) for x in table.collect()}
    want = brute_components(rows, n, percent)
    got = op04_similar.similar(table, n=n, percent=percent).collect()
    assert len(got) == table.count()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_similar_of_nothing(empty):
    assert op04_similar.similar(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.label for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_pieces_follow_the_library(spark, documents, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = op05_pieces.encode_documents(documents, path, with_text=True).collect()
    texts = collections.Counter((r.doc_id, r.text) for r in documents.collect())
    got = collections.Counter()
    by_id = dict(texts.keys())
    for r in found:
        ids = library.encode(by_id[r.doc_id] or "")
        assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        got[r.doc_id, by_id[r.doc_id]] += 1
    assert got == texts
    assert op05_pieces.encode_documents(empty, path).count() == 0


def test_pieces_of_random_texts():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        codec = op05_pieces.BatchCodec(f.read())
    r = random.Random(4)
    signs = "the of a ▁  \n\t<>()[]=0123 éñß漢字😀\x00\x01 ▁▁in ing er tion    aaaa zzzz"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    _, ids, decoded = codec.run(pa.array(texts))
    for text, own, spelled in zip(texts, ids, decoded):
        want = library.encode(text)
        assert own == ",".join(map(str, want)) and spelled == library.decode(want)
        assert codec.codec.encode(text) == want and codec.codec.decode(want) == library.decode(want)


def brute_quality(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), dup, len(covered), failed


def test_quality_counts(spark, documents, empty):
    model = op06_quality.Model(np.zeros(op06_quality.SLOTS), 0.0, 0.0, 50.0)
    by_id = {r.doc_id: r.text for r in documents.collect()}
    found = op06_quality.judge(documents, model).collect()
    assert len(found) == documents.count()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(by_id[r.doc_id])
        assert r.kept == (not r.base_failed)
    assert op06_quality.judge(empty, model).count() == 0


def test_quality_learns(spark, documents):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(("the", "river", "was", "long", "and", "quiet", "today")) for _ in range(80))
    bad = lambda: " ".join(r.choice(("BUY!!", "NOW###", "$$$", "CHEAP|")) for _ in range(80))
    rows = [(i, good() if i % 3 else bad(), int(bool(i % 3))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.where("doc_id < 200").select("doc_id", "quality").union(spark.createDataFrame([(999_999, 1), (5, None)], "doc_id long, quality int"))
    model = op06_quality.train(docs.drop("quality"), labels)
    found = {x.doc_id: x for x in op06_quality.judge(docs.drop("quality"), model).collect()}
    held = [(i, q) for i, _, q in rows if i >= 200]
    assert sum((found[i].probability >= 0.5) == bool(q) for i, q in held) == len(held)
    none = op06_quality.train(docs.drop("quality"), labels.where("quality = 1"))
    assert all(x.probability > 0.5 for x in op06_quality.judge(docs.drop("quality"), none).collect())


def test_quality_features_are_shares_of_ngrams():
    texts = ["ab é汉😀x", "", None, "one two one two", "é" * 9]
    slots, values = op06_quality.features(pa.array(texts, pa.string()))
    for text, s, v in zip(texts, slots, values):
        n = [len(WORD.findall(text or "")), max(0, len(WORD.findall(text or "")) - 1), max(0, len(text or "") - 3)]
        assert len(set(s.tolist())) == len(s) and abs(v.sum() - 30 * sum(x > 0 for x in n)) < 1e-3
    # One character repeated is one word and one kind of 4-gram, whatever its bytes.
    assert len(slots[4]) == 2
    model = op06_quality.Model(np.random.default_rng(0).normal(size=op06_quality.SLOTS), 0.3, 1.0, 0.0)
    score = op06_quality.Texts(pa.array(texts, pa.string())).score(model)
    for x, s, v in zip(score, slots, values):
        assert abs(x - 0.3 - (model.weights[s] * v).sum()) < 1e-3


def test_quality_follows_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = op06_quality.train(docs, labels.where("doc_id % 3 > 0"))
    found = op06_quality.judge(docs, model).join(labels.where("doc_id % 3 = 0 and quality is not null"), "doc_id").select("quality", "probability", "base_failed").collect()
    right = sum((r.probability >= 0.5 and not r.base_failed) == (r.quality == 1) for r in found)
    assert model.held_right > 0.9 and len(found) > 20 and right / len(found) > 0.9


def test_secrets_are_found_and_numbers_are_not(spark, documents, empty):
    r = random.Random(9)
    rows, planted = [], set()
    for i in range(240):
        secret = "".join(r.choice("0123456789abcdef") for _ in range(24))
        kind = i % 4
        number = "".join(r.choice("0123456789") for _ in range(16))
        text = [f"some words password={secret} and more", f'x token = "{secret}" y', f"plain {number} card here", f"mail a{i}.b2@mail{i}.example.com from 10.20.30.{i}"][kind]
        if kind < 2:
            planted.add((i, text.index(secret), text.index(secret) + 24))
        rows.append((i, text, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    found = op07_secrets.scan(docs).where("kept").select("doc_id", "begin", "end").collect()
    assert {tuple(x) for x in found} == planted
    measured = op07_secrets.held_out(docs).first()
    assert measured.precision == measured.recall == 1.0 and measured.findings > 20
    assert op07_secrets.scan(empty).count() == 0
    assert op07_secrets.scan(documents).select("doc_id").where("doc_id < 15").count() == 0


def brute_candidates(text):
    """Values assigned to a secret's name, and runs of key characters, found word by word."""
    names = "|".join(op07_secrets.SECRET_NAMES)
    assigned = re.compile(rf"(?i:{names})[\w.-]{{0,40}}[\"']?[ \t-\r]{{0,4}}(:=|=>|=|:)[ \t-\r]{{0,4}}[\"'`(\[{{<]*", re.A)
    out, at = [], 0
    while at < len(text):
        m = assigned.match(text, at)
        value = re.compile(r"[^ \t-\r\"'`,;)\]}<>]+").match(text, m.end()) if m else None
        run = re.compile(r"[A-Za-z0-9+/_=.@-]+").match(text, at)
        if value:
            begin, end = value.span()
        elif run and len(run[0]) >= 12 and re.search("[0-9]", run[0]) and (at == 0 or not re.match(r"[A-Za-z0-9+/_=.@-]", text[at - 1])):
            own = re.match(r"[\w.-]*?=+(?=.)", run[0], re.A)
            begin, end = at + (own.end() if own else 0), run.end()
        else:
            at += 1
            continue
        at = end
        while end > begin and text[end - 1] in ".,;:!?":
            end -= 1
        if end > begin:
            out.append((begin, text[begin:end]))
    return out


def test_secret_candidates_follow_brute_force(spark, documents):
    fixed = ["password: hunter2", "pwd = s3cr3t!x", 'token = "abcdefghijklmnopqrstuvwxyz" next', "my_api-key=>(abc) and auth_x: 'y'", "key=abcdefgh12345== ok", "password=" + "z" * 50_000 + "1", "password: ", "secret:token=abc123def456ghi"]
    r = random.Random(12)
    parts = ["password", "token", "x", " = ", ": ", '"', "12345", "abcdef", "==", "/", " ", "  ", ".", ",", "auth", "é", "A1b2C3d4E5f6", "@"]
    fixed += ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(fixed)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for x in op07_secrets.candidates(docs).orderBy("doc_id", "begin").collect():
        got[x.doc_id].append((x.begin, x.value))
    for i, text in enumerate(fixed):
        assert got[i] == brute_candidates(text), text[:200]
    near = {x.value: (x.previous, x.next) for x in op07_secrets.candidates(docs.where("doc_id = 2").union(spark.createDataFrame([(1, "the big (key) 0123456789abcd, was here")], "doc_id long, text string"))).collect()}
    assert near == {"abcdefghijklmnopqrstuvwxyz": ("", "next"), "0123456789abcd": ("key", "was")}


def lpc_frame(samples, order, weights, shift, k):
    """A frame with one LPC subframe, written bit by bit."""
    bits = []
    put = lambda v, n: bits.extend(v >> i & 1 for i in range(n - 1, -1, -1))
    put((32 | order - 1) << 1, 8)
    for s in samples[:order]:
        put(s & 255, 8)
    put(5 - 1, 4)
    put(shift, 5)
    for w in weights:
        put(w & 31, 5)
    put(0, 6)
    put(k, 4)
    for i in range(order, len(samples)):
        e = samples[i] - (sum(w * samples[i - 1 - j] for j, w in enumerate(weights)) >> shift)
        u = 2 * e if e >= 0 else -2 * e - 1
        put(0, u >> k)
        put(1, 1)
        put(u & (1 << k) - 1, k)
    bits += [0] * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x14, 0x02, 0])
    one = lambda b: (np.array([len(b)]), np.array([len(b)]))
    head += bytes(op08_flac.crc8(np.frombuffer(head, np.uint8), *one(head)))
    body = head + bytes(np.packbits(np.array(bits, np.uint8)))
    return body + int(op08_flac.crc16(np.frombuffer(body, np.uint8), *one(body))[0]).to_bytes(2, "big")


def test_flac_reads_linear_predictors():
    samples = [int(60 * np.sin(i / 5)) for i in range(192)]
    frame = lpc_frame(samples, 2, [15, -8], 3, 2)
    got = op08_flac.decode_frames(np.frombuffer(frame, np.uint8), np.array([0]), np.array([1]), np.array([0]))
    assert got[0].tolist() == samples


def test_flac_checksums_are_the_standard_ones():
    def crc(data, poly, bits):
        c = 0
        for b in data:
            c ^= b << bits - 8
            for _ in range(8):
                c = (c << 1 ^ poly if c >> bits - 1 else c << 1) & (1 << bits) - 1
        return c

    data = bytes(range(50, 90))
    at = np.frombuffer(data, np.uint8), np.array([40]), np.array([40])
    assert op08_flac.crc8(*at)[0] == crc(data, 0x07, 8) and op08_flac.crc16(*at)[0] == crc(data, 0x8005, 16)


def test_flac_round_trip(documents, empty):
    media = op08_flac.encode_documents(documents)
    found = op08_flac.describe(media).collect()
    by_id = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert len(found) == documents.count()
    for r in found:
        raw = by_id[r.doc_id]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    blocks = op08_flac.pcm_blocks(media.dropDuplicates(["doc_id"])).collect()
    joined = collections.defaultdict(bytes)
    for b in sorted(blocks, key=lambda b: (b.doc_id, b.first_sample)):
        assert b.first_sample == len(joined[b.doc_id])
        joined[b.doc_id] += bytes(b.pcm)
    assert all(joined[i].startswith(raw) for i, raw in by_id.items())
    assert op08_flac.describe(op08_flac.encode_documents(empty)).count() == 0


def test_flac_finds_damage():
    r = np.random.default_rng(3)
    wave = (128 + 40 * np.sin(np.arange(192 * 30) / 9) + r.integers(-3, 4, 192 * 30)).astype(np.uint8)
    stream = op08_flac.encode(wave, np.array([0, len(wave)]))[0]
    assert op08_flac.decode([stream])[0] == wave.tobytes() and len(stream) < len(wave)
    for at in (len(stream) - 1, len(stream) - 40, len(stream) // 2):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            op08_flac.decode([bytes(broken)])


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and op09_private.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_private_base_follows_brute_force(documents, empty):
    r = random.Random(6)
    for _ in range(6000):
        signs = r.choice(("a@b.c_%+-1. ", "0123.45 -+()", "4 0-1+", "1.2.3@x.y", "25.0@a_"))
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 60)))
        assert op09_private.base_spans(text) == brute_spans(text)
    by_id = {x.doc_id: x.text or "" for x in documents.collect()}
    for x in op09_private.find_private(documents, []).collect():
        want = ",".join(f"{op09_private.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(by_id[x.doc_id]))
        assert x.spans == want and x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert op09_private.find_private(empty, op09_private.learn_patterns(empty)).count() == 0


def test_private_contexts_find_unseen_identifiers(spark):
    r = random.Random(8)

    def card():
        body = [r.randint(0, 9) for _ in range(15)]
        return next("".join(map(str, body)) + str(c) for c in range(10) if op09_private.luhn("".join(map(str, body)) + str(c)))

    rows = [(i, f"please charge account {card()} for item {i}", 0) for i in range(40)]
    rows += [(100, "please charge account 4111111111111112 now", 0), (101, "there were 1234567890123456 grains", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value int")
    patterns = op09_private.learn_patterns(docs)
    found = {x.doc_id: x for x in op09_private.find_private(docs, patterns, with_text=True).collect()}
    assert found[100].spans == "found:22:38" and found[100].redacted == "please charge account <found> now"
    assert found[101].spans == "" and found[5].spans.startswith("card:") and "<card>" in found[5].redacted


def test_private_uses_every_trusted_pattern(spark):
    contexts = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(2100)]
    cards = [n for n in map(str, range(4 * 10**15, 4 * 10**15 + 400)) if op09_private.luhn(n)][:10]
    rows = [(-1, None), (-2, "")] + [(i, f"{c} {card} end") for i, c in enumerate(contexts) for card in cards]
    rows += [(10_000 + i, f"{c} 4000000000000001 end") for i, c in enumerate(contexts)]
    assert not op09_private.luhn("4000000000000001")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = op09_private.find_private(docs, op09_private.learn_patterns(docs), with_text=True, carry=("doc_id", "text")).collect()
    late = [x for x in found if x.doc_id >= 10_000]
    assert len(found) == len(rows) and len(late) == 2100
    assert all(x.spans == "found:4:20" and x.redacted == x.text[:4] + "<found> end" for x in late)


def test_private_follows_chains_of_patterns(spark):
    numbers = list(map(str, range(4 * 10**15, 4 * 10**15 + 400)))
    cards, other = [[n for n in numbers if op09_private.luhn(n) == kind] for kind in (True, False)]
    # Seeds alone make the first context trusted; each other one needs the two values told by the one before it.
    held = {"one": other[:2]} | {name: other[2 * k : 2 * k + 4] for k, name in enumerate(("two", "three", "four", "five", "six"))}
    held["never"] = other[100:104]
    texts = [f"{name} {value}" for name, values in held.items() for value in (*cards[:20], *values)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x.spans for x in op09_private.find_private(docs, op09_private.learn_patterns(docs)).collect()}
    for i, text in enumerate(texts):
        name, _, value = text.partition(" ")
        kind = "card:" if value in cards else "" if name == "never" else "found:"
        assert found[i] == (kind and f"{kind}{len(name) + 1}:{len(text)}")


def test_private_learns_from_words_without_digits(spark):
    names = [a + b for a in "bcdfg" for b in ("ano", "elu", "ito", "omy")]
    texts = [f"write to mail: {n}.doe@example.com soon" for n in names] + [f"my mail={n}.roe@example.org" for n in names]
    texts += ["write to mail: jane.doe@ex\u00e4mple.com soon", "my mail=jane.roe@ex\u00e4mple.org", "no mail jane here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x.spans for x in op09_private.find_private(docs, op09_private.learn_patterns(docs)).collect()}
    assert all(found[i].startswith("email:") and "," not in found[i] for i in range(40))
    assert (found[40], found[41], found[42]) == ("found:15:35", "found:8:28", "")


def test_private_shape_covers_the_whole_value():
    address = ":".join(["2001", "db8", "0", "0", "0", "0", "0", "1"])
    assert op09_private.shape(address) == "4:xs:d:d:d:d:d:d"
    assert op09_private.shape(address) != op09_private.shape(address[:-1]) != op09_private.shape(address + ":ff")


def test_token_files_follow_the_library(spark, documents, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    folder = shared_dir(spark)
    shards = op10_tokens.write_shards(documents, path, folder)
    found = op10_tokens.read_shards(shards, folder).orderBy("start").collect()
    start = 0
    rows = sorted(((r.doc_id, r.text or "") for r in documents.collect()), key=lambda r: r[0])
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    for r, (_, text) in zip(found, rows):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert op10_tokens.write_shards(empty, path, shared_dir(spark)).isEmpty()


def test_token_shards_read_at_random():
    r = np.random.default_rng(2)
    counts = r.integers(1, 400, 60)
    ids = r.choice(np.array([5, 6, 7, 7, 7, 900, 50000]), counts.sum()).astype(np.int32)
    data = op10_tokens.pack(np.arange(60), counts, ids, 50257)
    shard = op10_tokens.Shard(data)
    assert (shard.ids() == ids).all() and len(shard.symbols) < len(ids) / 2 and len(shard.size) > 50257
    ends = np.cumsum(counts)
    for i in range(60):
        own = ids[ends[i] - counts[i] : ends[i]]
        for a, b in ((0, None), (1, 5), (int(counts[i]) // 2, int(counts[i])), (3, 3)):
            assert shard.document(i, a, b).tolist() == own[a:b].tolist()


def test_token_encoder_on_random_texts():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    r = random.Random(3)
    signs = "the of a '  \n\t<>()[]=0123 éñß漢字😀\x00\x01　\xa0 it's they'll in ing er tion \r\n  aaaa zzzz\x85 \x1f\x1c"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["x" * 50_000, " " * 5000, " \u3000" * 3000, "a." * 20_000, "1" * 999 + " " + "2" * 3000, ("x" + " " * 390) * 20]
    coder = op10_tokens.Encoder(path)
    slow = op10_tokens.Encoder(path)
    slow.quick = None
    for part in (texts[:700], texts[300:], [None, "", "one"], []):
        ids, begin = coder.run(pa.array(part, pa.string()))
        assert len(begin) == len(part) + 1
        for i, text in enumerate(part):
            assert ids[begin[i] : begin[i + 1]].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert slow.run(pa.array(part, pa.string()))[0].tolist() == ids.tolist()


def test_token_encoder_matches_added_tokens():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = [f"{a}{t}{b}" for t in added for a in ("", "end of one.", "a ", "é\n", "<|") for b in ("", " start", "x", f" {t}{t}", "\t ")]
    texts += ["end of one.<|endoftext|> start", "<|endoftext", "< |endoftext|>", "<|ENDOFTEXT|>", "plain", "", None]
    ids, begin = op10_tokens.Encoder(path).run(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]
    assert "<|endoftext|>" in added and 50256 in ids.tolist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_follow_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(registry.QUERIES[name](spark, SF), con.sql(registry.SQL[name]))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_others(spark, monkeypatch, how):
    monkeypatch.setattr(common, "ONE_TASK", 10)
    many = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(300)] + [(None, 1), (50, 2)], "k long, v long")
    one = spark.createDataFrame([(k, str(k)) for k in range(6)], "k long, w string")
    got = common.hot_join(many, one, "k", how).collect()
    assert sorted(map(str, got)) == sorted(map(str, many.join(one, "k", how).collect()))


@pytest.mark.parametrize("least", [10, 1000])
def test_spread_keys_join_like_others(spark, monkeypatch, least):
    monkeypatch.setattr(common, "ONE_TASK", least)
    many = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(300)] + [(None, 1), (50, 2), (1, None), (1, None)], "k long, v long")
    one = spark.createDataFrame([(k, "w" * 1000 * k) for k in range(6)], "k long, w string")
    spread = common.spread_join(many, one, "k", "v")
    assert spread.columns == ["k", "v", "w"]
    assert sorted(map(str, spread.collect())) == sorted(map(str, many.join(one, "k").collect()))
    assert common.spread_join(many.where("v < 0"), one, "k", "v").count() == 0


def test_few_keys_are_hot_at_any_size():
    assert common.hot_from(1000) == 1 and common.hot_from(10**7) == common.hot_from(10**9) == common.ONE_TASK
    assert all(n / common.hot_from(n) <= common.MOST_HOT for n in (10**5, 10**8, 10**9, 10**13))


def test_similar_with_busy_classes(spark, monkeypatch):
    """Pairs of one class dealt over several tasks: the same links as in one task."""
    monkeypatch.setattr(common, "ONE_TASK", 3)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*words, *[f"x{i}y{j}" for j in range(3)]])) for i in range(40)] + [(99, "other words here")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in op04_similar.similar(docs, n=3, percent=90).collect()}
    assert found == {**{i: 0 for i in range(40)}, 99: 99}


def test_private_contexts_are_whole_words():
    long = "x" * 500
    a, b = (op09_private.candidates(f"{w} {' ' * 300} 12345")[0] for w in (long + "a", long + "b"))
    assert a[2] != b[2] and len(a[2][0]) == 40
    assert op09_private.candidates("one two  12") == [(9, 11, tuple({"two", "one two"}), "d")]
    assert [op09_private.candidates(t)[0][:2] for t in ("user: jane", "user=jane")] == [(6, 10), (5, 9)]


def test_pages_without_an_id(spark):
    rows = [(None, "a", "q" * 70_000), (None, "a", "q" * 70_000), (None, "b", "q" * 70_000), (None, None, None), (7, "c", "q" * 70_000), (9, "c", "q" * 70_000)]
    folder = shared_dir(spark)
    op02_warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    found = op02_warc.payloads(op02_warc.reassemble(op02_warc.read_records(spark, folder))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in found) == [(0, "response", None, 0)] + [(0, "response", None, 70_000)] * 3 + [(7, "response", None, 70_000), (9, "revisit", 7, 70_000)]


def test_archives_are_read_in_one_walk():
    parts = [gzip.compress(bytes([i % 251]) * (i * 37 % 60_000)) for i in range(300)]
    assert list(op02_warc.members(b"".join(parts))) == [gzip.decompress(p) for p in parts]
    with pytest.raises(ValueError, match="ends within"):
        list(op02_warc.members(b"".join(parts)[:-9]))


def decode_stream(stream):
    """An independent reader of FLAC streams, bit by bit: signed samples of a mono stream of 8 bits."""
    at, last = 4, False
    while not last:
        last, size = bool(stream[at] & 128), int.from_bytes(stream[at + 1 : at + 4], "big")
        at += 4 + size
    bits = "".join(f"{b:08b}" for b in stream[at:])
    pos, out = 0, []

    def take(n, signed=False):
        nonlocal pos
        v = int(bits[pos : pos + n] or "0", 2)
        pos += n
        return v - (1 << n) if signed and v >> (n - 1) else v

    while pos < len(bits):
        assert take(14) == 0x3FFE and take(2) == 0
        size_code, _, _, depth, _ = take(4), take(4), take(4), take(3), take(1)
        assert (size_code, depth) == (1, 1)
        lead = take(8)
        for _ in range(max(0, 7 - len(f"{lead ^ 255:b}") - 1) if lead >= 0xC0 else 0):
            take(8)
        take(8)
        kind = take(8) >> 1
        x = []
        if kind == 0:
            x = [take(8, True)] * 192
        elif kind == 1:
            x = [take(8, True) for _ in range(192)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [take(8, True) for _ in range(order)]
            shift, weights = 0, [[], [1], [2, -1]][order] if kind < 32 else None
            if kind >= 32:
                precision, shift = take(4) + 1, take(5, True)
                weights = [take(precision, True) for _ in range(order)]
            method, parts = take(2), take(4)
            for part in range(1 << parts):
                k = take(4 + method)
                for _ in range((192 >> parts) - (order if part == 0 else 0)):
                    q = bits.index("1", pos) - pos
                    pos += q + 1
                    u = q << k | take(k) if k else q
                    e = u >> 1 if u % 2 == 0 else -(u >> 1) - 1
                    x.append(e + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
        pos = (pos + 7) // 8 * 8 + 16
        out += x
    return out


def test_flac_streams_are_read_by_an_independent_decoder():
    r = np.random.default_rng(7)
    wave = (128 + 60 * np.sin(np.arange(192 * 6) / 5) + r.integers(-9, 10, 192 * 6)).astype(np.uint8)
    text = np.frombuffer(("The river ran on and on, then it was quiet again. " * 40).encode()[: 192 * 8], np.uint8)
    for data in (wave, text, np.full(192, 32, np.uint8), r.integers(0, 256, 192 * 2).astype(np.uint8)):
        stream = op08_flac.encode(data, np.array([0, len(data)]))[0]
        assert decode_stream(stream) == (data.astype(int) - 128).tolist() and op08_flac.decode([stream])[0] == data.tobytes()
    kinds = {op08_flac.encode(wave, np.array([0, len(wave)]))[0][-1]}
    assert kinds


def test_flac_reads_partitioned_residuals():
    samples = [int(40 * np.sin(i / 7)) for i in range(192)]
    bits = []
    put = lambda v, n: bits.extend(v >> i & 1 for i in range(n - 1, -1, -1))
    put(9 << 1, 8)
    put(samples[0] & 255, 8)
    put(1, 2)
    put(2, 4)
    for part, k in enumerate((3, 1, 2, 0)):
        put(k, 5)
        for i in range(max(1, part * 48), part * 48 + 48):
            e = samples[i] - samples[i - 1]
            u = 2 * e if e >= 0 else -2 * e - 1
            put(0, u >> k)
            put(1, 1)
            put(u & (1 << k) - 1, k)
    bits += [0] * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x14, 0x02, 0])
    one = lambda b: (np.array([len(b)]), np.array([len(b)]))
    head += bytes(op08_flac.crc8(np.frombuffer(head, np.uint8), *one(head)))
    body = head + bytes(np.packbits(np.array(bits, np.uint8)))
    frame = body + int(op08_flac.crc16(np.frombuffer(body, np.uint8), *one(body))[0]).to_bytes(2, "big")
    got = op08_flac.decode_frames(np.frombuffer(frame, np.uint8), np.array([0]), np.array([1]), np.array([0]))
    assert got[0].tolist() == samples


@pytest.fixture(scope="module")
def nameless(spark):
    """Rows without an id, most of them equal, beside rows with one; a clashing column and a null source."""
    long = words_of(random.Random(3), 80)
    rows = [(None, t, None, "k") for t in (None, "", long, long, long + " end", "alone " * 60)] + [(4, long, "a", "k"), (9, long, "b", "k"), (11, None, "b", "k"), (-(1 << 60), long + " end", "b", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")


def words_of(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_rows_without_an_id(spark, nameless, monkeypatch):
    count = lambda rows: collections.Counter(r.doc_id for r in rows)
    want = count(nameless.collect())
    assert count(op01_mixing.mix(nameless).collect()) == want
    found = op04_similar.similar(nameless, n=5, percent=80).collect()
    assert count(found) == want
    least = -(1 << 60)
    assert collections.Counter((r.doc_id, r.component_id) for r in found) == {(None, None): 3, (None, least): 3, (4, least): 1, (9, least): 1, (least, least): 1, (11, 11): 1}
    model = op06_quality.train(nameless, spark.createDataFrame([(4, 1), (None, 0)], "doc_id long, quality int"))
    assert count(op06_quality.judge(nameless, model).collect()) == want
    assert op07_secrets.scan(nameless).count() == 0
    assert count(op08_flac.describe(op08_flac.encode_documents(nameless)).collect()) == want
    assert count(op09_private.find_private(nameless, op09_private.learn_patterns(nameless)).collect()) == want
    assert count(op05_pieces.encode_documents(nameless, tokenizer("piece_bpe_32k.model")).collect()) == want
    folder = shared_dir(spark)
    tokens = op10_tokens.read_shards(op10_tokens.write_shards(nameless, tokenizer("byte_bpe_50k.json"), folder), folder).orderBy("start").collect()
    assert count(tokens) == want and [r.doc_id for r in tokens] == [None] * 6 + [least, 4, 9, 11]


def test_one_very_long_text(spark):
    """A text of 3 MB goes through every text operator as a whole."""
    text = words_of(random.Random(5), 200_000) + " token = abc123def456ghi and me.now@mail.example.com " + words_of(random.Random(6), 300_000)
    docs = spark.createDataFrame([(1, text, "a"), (2, text + " x", "a"), (3, "short text", "b")], "doc_id long, text string, source string")
    assert {r.doc_id: r.component_id for r in op04_similar.similar(docs, n=3, percent=90).collect()} == {1: 1, 2: 1, 3: 3}
    quality = {r.doc_id: r.n_words for r in op06_quality.judge(docs, op06_quality.Model(np.zeros(op06_quality.SLOTS), 0.0, 0.0, 50.0)).collect()}
    assert quality == {1: len(text.split()), 2: len(text.split()) + 1, 3: 2}
    begin = text.index("abc123")
    assert {(r.doc_id, r.begin, r.end) for r in op07_secrets.scan(docs).collect()} >= {(1, begin, begin + 15), (2, begin, begin + 15)}
    assert {r.doc_id: r.payload_bytes >= len(text) for r in op08_flac.describe(op08_flac.encode_documents(docs)).collect()} == {1: True, 2: True, 3: False}
    at = text.index("me.now")
    spans = {r.doc_id: r.spans.split(",") for r in op09_private.find_private(docs, []).collect()}
    assert f"email:{at}:{at + 23}" in spans[1]
    for run in (lambda p: op05_pieces.encode_documents(docs, p).collect(),):
        n = {r.doc_id: r.n_tokens for r in run(tokenizer("piece_bpe_32k.model"))}
        assert n[2] == n[1] + 1 > 500_000


def luhn_numbers(n):
    return [x for x in map(str, range(4 * 10**15, 4 * 10**15 + 40 * n)) if op09_private.luhn(x)][:n]


def test_private_ordinary_words_announce_nothing(spark):
    cards = luhn_numbers(40)
    texts = [f"the {c} end" for c in cards[:20]] + [f"card {c} end" for c in cards[20:]]
    texts += ["the 4000000000000001 end", "card 4000000000000001 end"] + ["the cat and the dog"] * 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = op09_private.learn_patterns(docs)
    assert {r.context for r in patterns.collect()} == {"card"}
    spans = {r.doc_id: r.spans for r in op09_private.find_private(docs, patterns).collect()}
    assert (spans[40], spans[41]) == ("", "found:5:21")
    # 21 candidates behind 45 articles: just what a lower share takes.
    assert {r.context for r in op09_private.learn_patterns(docs, min_share=21 / 45).collect()} == {"card", "the"}


@pytest.mark.parametrize("few", [20_000, 1])
def test_private_words_behind_contexts_follow_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(op09_private, "BROADCAST_PATTERNS", few)
    r = random.Random(11)
    texts = [None, "", " ", "one", "X" * 70 + " two"] + [" ".join(r.choice(("a", "B", "c", "12", "d:")) for _ in range(r.randint(1, 30))) for _ in range(60)]
    want = {}
    for words in ((t or "").split() for t in texts):
        for i in range(len(words)):
            before = op09_private.words_before(" ".join(words), len(" ".join(words[:i])) + (i > 0))
            for context in {before[-1], " ".join(before)} if before else {""}:
                want[context] = want.get(context, 0) + 1
    asked = [c for i, c in enumerate(sorted(want)) if i % 2] + ["never seen"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {x.context: x.behind for x in op09_private.words_behind(docs, spark.createDataFrame([(c,) for c in asked], "context string")).collect()}
    assert got == {c: want[c] for c in asked if c in want}


def test_private_recovers_seeds_held_back(spark):
    cards = luhn_numbers(200)
    texts = [f"card {c} end" for c in cards[:100]] + [f"the {c} cat the dog the end" for c in cards[100:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op09_private.recovered(docs, every=10).first()
    assert 0 < got.recalled == got.announced < got.held and got.told == got.sound == 100
    assert tuple(op09_private.recovered(docs.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_private_hot_and_empty_texts_stay_where_they_are(spark, monkeypatch):
    hot, cold = "account 4000000000000001 end", "account 4000000000000003 end"
    rows = [(i, hot) for i in range(60)] + [(i, None) for i in range(60, 120)] + [(i, "") for i in range(120, 150)] + [(200, cold), (None, hot), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for share in (5, 1000):
        monkeypatch.setattr(op09_private, "HOT_SHARE", share)
        got = op09_private.find_private(docs, [("account", "16")], with_text=True).collect()
        assert len(got) == len(rows) and sum(x.spans == "found:8:24" for x in got) == 62
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.redacted) for x in got if x.redacted) == sorted([(i, "account <found> end") for i in (*range(60), 200, -1)])


def test_long_records_are_joined_in_linear_time(spark):
    payload = random.Random(3).randbytes(8_000_000)
    parts = op02_warc.records(5, None, payload, hashlib.sha256(payload).hexdigest(), len(payload), None, 0)
    rows = []
    for f, b in (x for p in parts for x in op02_warc.parse(gzip.compress(p, 1))):
        rows.append((5, f["warc-type"], f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), int(f.get("warc-segment-total-length", 0)) or None, f.get("warc-payload-digest", "").removeprefix("sha256:"), None, b))
    random.Random(4).shuffle(rows)
    got = op02_warc.payloads(op02_warc.reassemble(spark.createDataFrame(rows, op02_warc.PARSED).repartition(4))).collect()
    assert len(got) == 1 and bytes(got[0].payload) == payload
    for bad in (rows + rows[:1], [x for x in rows if x[3] != 1], [(*x[:4], 7 if x[4] else None, *x[5:]) for x in rows]):
        with pytest.raises(Exception, match="segments missing"):
            op02_warc.reassemble(spark.createDataFrame(bad, op02_warc.PARSED)).collect()


def test_mixing_spreads_rows_without_id_and_words(spark):
    rows = [(None, t, "s") for t in (None, "", " \t ") for _ in range(200)] + [(None, "a b", "s"), (None, "a b", "s"), (1, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    keys = op01_mixing.mix(docs)
    assert keys.count() == len(rows)
    assert {(x.size, x.taken) for x in keys.where("source = 's'").collect()} <= {(0, 0), (2, 0), (2, 2), (2, 4), (2, 6)}
    assert keys.where("size = 0").agg({"taken": "sum"}).first()[0] == 0
