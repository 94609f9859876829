"""Personal data: fixed patterns, then bootstrapped extraction from their contexts.

Base kinds (e-mail, IP address, card, phone) come from fixed patterns over every whole text. They
seed the bootstrap. Every candidate (a word with a digit or an at-sign, what an equals sign or colon
assigns, and the word behind a word that ends in one) is an occurrence with a shape
(runs of letters, digits and signs) and a context (the words before it, lower-cased). Spark scores
the graph of patterns (context, shape) and instances (values) until nothing changes: a pattern's
confidence is the trusted share of its occurrences, an instance's confidence is what the patterns
that extract it leave of doubt. Patterns of high confidence and enough support then extract
unseen identifiers wherever they match in any text; those are the extra spans, of kind "found".

Contexts are words that announce an identifier, so a pattern needs support from several distinct
trusted instances, and at least half of the words that stand behind its context, counted over all
texts, have to be candidates: an article is followed by an identifier now and then, but announces
none. Base kinds hold digits or an at-sign, so patterns whose shape has neither become
trusted only through values that such patterns tell. Other words without a digit, an at-sign or a
sign that assigns them are not in the graph; no trusted pattern has their shape.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; of
base spans that overlap (they are of different kinds) all are reported, and redaction keeps the
first; a span found twice counts once; repeated rows give repeated rows; an empty table gives an
empty result; other columns are ignored. A text of any length is searched as a whole in one task,
in time and memory in proportion to its length; contexts over 64 characters are kept as digests.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, discard, hot_join, kept, small_batches, stash

KINDS = ("email", "ip", "card", "phone", "found")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs give up at once where the plain pattern would only try shorter ones in vain.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile("[0-9@=:]")
#: What may hold an identifier: a word with one of the marks, or one behind a word that ends in a sign.
_HINT = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@=:]*+[0-9@=:][^\x20\x09-\x0D]*+|(?<=[=:][\x20\x09-\x0D])[^\x20\x09-\x0D]++")
_RUN = re.compile(r"[^\W_]+|[\W_]")
#: Patterns, or contexts, that are sent to all tasks at most.
BROADCAST_PATTERNS = 20_000
_TRIM = "\"'`()[]{}<>,;:!?.|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, in order."""
    out, done = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            begin = m.start()
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < m.start():
                out.append((begin, 0, m.end()))
                done = m.end()
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        n = len(m[0])
        if n >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def shape(value: str) -> str:
    """What a value looks like: a letters, d up to three digits, longer digit runs by their length, x mixed runs by a length class, other signs as they are."""
    out = []
    for run in _RUN.findall(value):
        if not run[0].isalnum():
            out.append(run[0])
        elif run.isdigit():
            out.append("d" if len(run) <= 3 else str(len(run)))
        elif any("0" <= c <= "9" for c in run):
            out.append("x" + ("s" if len(run) < 8 else "m" if len(run) < 16 else "l"))
        else:
            out.append("a")
    return "".join(out)


def _context(word: str) -> str:
    """A word of a context: lower-cased, a long one as its digest."""
    return word.lower() if len(word) <= 64 else hashlib.sha1(word.lower().encode("utf-8", "surrogatepass")).hexdigest()


def words_before(text: str, at: int) -> list[str]:
    """The two words before a place, whole and lower-cased; long ones as digests."""
    reach = 80
    while True:
        begin = max(0, at - reach)
        found = text[begin:at].split()
        if begin == 0 or len(found) > 2:
            return [_context(w) for w in found[-2:]]
        reach *= 4


def candidates(text: str) -> list[tuple[int, int, tuple[str, ...], str]]:
    """(start, end, contexts, shape) of every candidate; contexts are the one and the two words before it.

    key=value words are cut at their last sign before a digit or at-sign, else at their first sign,
    and the key is the context.
    """
    out = []
    if _MARK.search(text) is None:
        return out
    for m in _HINT.finditer(text):
        begin, end = m.span()
        word = m[0]
        mark = _DIGIT.search(word)
        mark = len(word) if mark is None and "@" not in word else mark.start() if mark else word.index("@")
        cut = max(word.rfind("=", 0, mark), word.rfind(":", 0, mark)) if mark < len(word) else min((i for i in (word.find("="), word.find(":")) if i >= 0), default=-1)
        if cut >= 0:
            before, begin = [_context(word[:cut]), word[cut]], begin + cut + 1
        else:
            before = None
        while begin < end and text[begin] in _TRIM:
            begin += 1
        while end > begin and text[end - 1] in _TRIM:
            end -= 1
        if end > begin:
            if before is None:
                before = words_before(text, m.start())
            out.append((begin, end, tuple({before[-1], " ".join(before)}) if before else ("",), shape(text[begin:end])))
    return out


def followed(text: str, wanted: frozenset[str] | None, lasts: frozenset[str]) -> Counter:
    """How often a word stands behind each context of a text; wanted limits the contexts, lasts are the last words of those with two."""
    words = text.lower().split()
    if len(max(words, key=len, default="")) > 60:
        words = [_context(w) for w in text.split()]
    found = Counter(words[:-1])
    pairs = zip(words, words[1:-1])
    if wanted is not None:
        ends = found.keys() & lasts
        found = Counter({w: found[w] for w in found.keys() & wanted})
        pairs = filter(lambda p: p[1] in ends, pairs) if ends else ()
    both = map(" ".join, pairs)
    found.update(both if wanted is None else filter(wanted.__contains__, both))
    if words:
        found[""] += 1
    return found


def words_behind(documents: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, behind: how many words of all texts stand behind each of the given contexts."""
    few = contexts.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    # Few contexts go to the tasks; otherwise all are counted there, and meet the given ones by a shuffle.
    wanted = frozenset(r.context for r in contexts.collect()) if few else None
    lasts = frozenset(w.rpartition(" ")[2] for w in wanted or () if " " in w)

    def run(batches):
        kept("op9")
        for batch in batches:
            found = Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    found.update(followed(text, wanted, lasts))
            items = list(found.items())
            for i in range(0, len(items), 50_000):
                part = list(zip(*items[i : i + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.int64())], ["context", "n"])

    counted = documents.select("text").mapInArrow(run, "context string, n long").groupBy("context").agg(F.sum("n").alias("behind"))
    return counted.join(contexts, "context", "left_semi")


def announcing(documents: DataFrame, graph: DataFrame, min_values: int, min_share: float) -> DataFrame:
    """The contexts with at least min_values distinct values, behind which at least min_share of all words are candidates.

    Values that a sign within a word assigns (key=value) are no words of their own: they count as candidates only.
    """
    held = stash(graph.groupBy("context", "value").agg(F.sum("times").alias("times")).groupBy("context").agg(F.count("*").alias("n"), F.sum("times").alias("times")).where(F.col("n") >= min_values))
    joined = held.join(words_behind(documents, held.select("context")), "context", "left")
    out = stash(joined.where(F.col("times") >= min_share * F.coalesce("behind", F.lit(0))).select("context"))
    discard(held)
    return out


def occurrences(documents: DataFrame) -> DataFrame:
    """context, shape, value, seed of every candidate of every text; value is a digest, seed tells that a base span covers it."""

    def run(batches):
        kept("op9")
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = candidates(text) if text else ()
                if found:
                    spans = base_spans(text)
                    for begin, end, contexts, form in found:
                        seed = any(b < end and begin < e for b, _, e in spans)
                        value = hashlib.sha1(text[begin:end].encode("utf-8", "surrogatepass")).hexdigest()[:20]
                        rows += [(context, form, value, seed) for context in contexts]
            for i in range(0, len(rows), 50_000):
                part = list(zip(*rows[i : i + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.string(), pa.string(), pa.string(), pa.bool_()))], ["context", "shape", "value", "seed"])

    return documents.select("text").mapInArrow(run, "context string, shape string, value string, seed boolean")


def learn_patterns(documents: DataFrame, *, min_values: int = 5, min_confidence: float = 0.9, min_share: float = 0.5, held_back: int = 0) -> DataFrame:
    """All trusted patterns: context, shape.

    Only contexts that announce speak: at least min_share of the words behind them are candidates.
    Pattern confidence: share of its distinct values that are trusted, counted as their confidence.
    Instance confidence: 1 for seeds, else 1 - product(1 - confidence of its patterns), where only
    patterns of at least min_confidence and min_values values speak. Trust never falls from round to
    round; it ends when neither the number nor the confidence of these patterns changes any more.
    held_back leaves out one in so many seed values, to measure what patterns find of them.
    """
    seen = occurrences(documents)
    if held_back:
        seen = seen.where(~(F.col("seed") & held_back_value(held_back)))
    graph = stash(seen.groupBy("context", "shape", "value").agg(F.max(F.col("seed").cast("double")).alias("seed"), F.count("*").alias("times")))
    # A context that announces nothing can hold very many values: it stays where it is.
    graph, whole = stash(hot_join(graph, announcing(documents, graph, min_values, min_share), "context").drop("times")), graph
    discard(whole)
    seeds = stash(graph.groupBy("value").agg(F.max("seed").alias("seed")))
    trust = seeds.withColumnRenamed("seed", "trust")
    before, old = (0, 0.0), []
    while True:
        # A number that stands in very many contexts, and a context with very many values, are hot keys.
        scored = hot_join(graph, trust, "value").groupBy("context", "shape").agg(F.count("value").alias("n"), F.avg("trust").alias("confidence"))
        strong = stash(scored.where((F.col("n") >= min_values) & (F.col("confidence") >= min_confidence)))
        now = strong.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        discard(*old)
        if now[0] == before[0] and abs(now[1] - before[1]) < 1e-6:
            break
        before = now
        doubt = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence"))))
        key = F.concat_ws("\x00", "shape", "context")
        spoken = strong.select(key.alias("_pattern"), "confidence")
        told = hot_join(graph.select(key.alias("_pattern"), "value"), spoken, "_pattern").groupBy("value").agg((1 - F.exp(doubt)).alias("told"))
        trust = seeds.join(told, "value", "left")
        trust = stash(trust.select("value", F.greatest("seed", F.coalesce("told", F.lit(0.0))).alias("trust")))
        old = [strong, trust]
    discard(graph, seeds)
    return strong.select("context", "shape")


def held_back_value(every: int) -> Column:
    """Whether the digest in value is one of those held back: one in every."""
    return F.pmod(F.xxhash64("value"), F.lit(every)) == 0


def recovered(documents: DataFrame, *, every: int = 5, **options) -> DataFrame:
    """One row that tells how patterns learnt from other seeds do: held (values of seeds held back), announced (those that stand in an announcing context), recalled (those that a trusted pattern extracts), told (values that trusted patterns extract), sound (seeds among them).

    sound / told is a lower bound of the precision, since unseen identifiers count against it.
    """
    patterns = stash(learn_patterns(documents, held_back=every, **options))
    graph = stash(occurrences(documents).groupBy("context", "shape", "value").agg(F.max(F.col("seed").cast("double")).alias("seed"), F.count("*").alias("times")))
    contexts = announcing(documents, graph, options.get("min_values", 5), options.get("min_share", 0.5))
    key = F.concat_ws("\x00", "shape", "context").alias("_pattern")
    rows = hot_join(stash(graph.select("context", "value", "seed", key)), contexts.withColumn("_speaks", F.lit(True)), "context", "left")
    rows = hot_join(stash(rows), patterns.select(key).withColumn("_trusted", F.lit(True)), "_pattern", "left")
    values = rows.groupBy("value").agg(F.max("seed").alias("seed"), F.max(F.coalesce("_speaks", F.lit(False))).alias("speaks"), F.max(F.coalesce("_trusted", F.lit(False))).alias("found"))
    held = (F.col("seed") == 1) & held_back_value(every)
    return values.agg(
        F.count(F.when(held, 1)).alias("held"), F.count(F.when(held & F.col("speaks"), 1)).alias("announced"), F.count(F.when(held & F.col("found"), 1)).alias("recalled"),
        F.count(F.when(F.col("found"), 1)).alias("told"), F.count(F.when(F.col("found") & (F.col("seed") == 1), 1)).alias("sound"),
    )


def text_key(text: str) -> bytes:
    """The digest that spans found in a text are brought back to its rows by."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def matches(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """_digest of a text, _found: begin and end of its candidates that a trusted pattern matches and no base span meets."""

    def run(batches):
        kept("op9")
        for batch in batches:
            rows = []
            for text in {t for t in batch.column("text").to_pylist() if t}:
                open_, spans = candidates(text), None
                if open_:
                    key, spans = text_key(text), base_spans(text)
                    for begin, end, contexts, form in open_:
                        if not any(b < end and begin < e for b, _, e in spans):
                            rows += [(key, begin, end, context, form) for context in contexts]
            for i in range(0, len(rows), 50_000):
                part = list(zip(*rows[i : i + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["_digest", "begin", "end", "context", "shape"])

    open_ = documents.select("text").mapInArrow(run, "_digest binary, begin long, end long, context string, shape string")
    key = F.concat_ws("\x00", "shape", "context").alias("_pattern")
    trusted = patterns.select(key).distinct()
    keyed = open_.select("_digest", "begin", "end", key)
    # A small table of patterns goes to the candidates; a large one meets them by a shuffle without hot keys.
    few = trusted.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    hits = keyed.join(F.broadcast(trusted), "_pattern") if few else hot_join(stash(keyed), trusted, "_pattern")
    return hits.groupBy("_digest").agg(F.collect_set(F.struct("begin", "end")).alias("_found"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, done = [], 0
    for begin, kind, end in spans:
        if begin >= done:
            out += [text[done:begin], f"<{KINDS[kind]}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_private(documents: DataFrame, patterns: DataFrame | list[tuple[str, str]], *, with_text: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry, counts per base kind, base_sha256, spans; with_text adds the redacted text.

    Patterns are joined with the candidates, so any number of them is used; what they find depends
    on the text alone and comes back to its rows by the text's digest.
    """
    if not isinstance(patterns, DataFrame):
        patterns = documents.sparkSession.createDataFrame(patterns, "context string, shape string")
    name = lambda spans: ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in spans)

    def base(batches):
        kept("op9")
        for batch in batches:
            counts, digests, lists, keys = [[], [], [], []], [], [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(name(spans).encode()).hexdigest())
                lists.append([{"begin": b, "kind": k, "end": e} for b, k, e in spans])
                keys.append(text_key(text) if text else None)
            out = {c: batch.column(c) for c in passed} | {f"n_{KINDS[k]}": pa.array(counts[k], pa.int64()) for k in range(4)}
            out |= {"base_sha256": pa.array(digests, pa.string()), "_base": pa.array(lists, pa.list_(pa.struct([("begin", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))), "_key": pa.array(keys, pa.binary())}
            yield pa.RecordBatch.from_pydict(out)

    def cover(batches):
        kept("op9")
        for batch in batches:
            lists, texts = [], []
            old = batch.column("text").to_pylist() if with_text else [None] * batch.num_rows
            for text, fixed, found in zip(old, batch.column("_base").to_pylist(), batch.column("_found").to_pylist()):
                spans = sorted([(s["begin"], s["kind"], s["end"]) for s in fixed] + [(s["begin"], 4, s["end"]) for s in found or ()])
                lists.append(name(spans))
                if with_text:
                    texts.append(text if text is None else redact(text, spans))
            out = {c: batch.column(c) for c in first} | {"spans": pa.array(lists, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"redacted": pa.array(texts, pa.string())} if with_text else {}))

    # Only rows that are to be redacted take their text through the join.
    source = documents.select(*dict.fromkeys((*carry, "text")))
    passed = tuple(source.columns) if with_text else carry
    types = lambda names: ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    counted = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string"
    rows = source.mapInArrow(base, f"{types(passed)}, {counted}, _base array<struct<begin: bigint, kind: bigint, end: bigint>>, _key binary")
    first = (*carry, *(f"n_{k}" for k in KINDS[:4]), "base_sha256")
    # Copies of a text that more than one in HOT_SHARE rows hold (fewer than HOT_SHARE texts) stay where they are, and so do empty texts.
    found = stash(matches(documents, patterns))
    copies = stash(documents.where("text <> ''").groupBy(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("_hot")).agg(F.count("*").alias("n")).where("n > 1"))
    total = documents.count()
    hot = copies.where(F.col("n") > F.lit(total / HOT_SHARE)).select("_hot")
    hot = hot.join(found.withColumnRenamed("_found", "_same"), F.col("_hot") == F.col("_digest"), "left").drop("_digest")
    flagged = rows.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    alone = F.encode(F.concat(F.lit("#"), F.monotonically_increasing_id()), "utf-8")
    flagged = flagged.withColumn("_place", F.when(F.col("_key").isNull() | F.col("_hot").isNotNull(), alone).otherwise(F.col("_key")))
    joined = flagged.join(found, F.col("_place") == F.col("_digest"), "left").withColumn("_found", F.coalesce("_same", "_found"))
    joined = joined.drop("_key", "_digest", "_place", "_hot", "_same")
    return joined.mapInArrow(cover, f"{types(carry)}, {counted}, spans string" + ", redacted string" * with_text)


def op9_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_private(documents, learn_patterns(documents))
