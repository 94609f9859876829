"""Chat formatting in budgeted windows, with a loss mask, and reading it back.

A turn is written as "### <role>:", a line break, its text, a line break and "</turn>"; inside roles
and texts every backslash, number sign and less-than sign gets a backslash in front (roles also
colons and line breaks), so no text can look like a mark and everything is read back as it was.

Prefix sums of the turns' words choose the windows: a turn belongs to window (words before it) div
budget, so windows hold whole turns. A conversation's first turn, if it is a system turn, is kept
in every window, and a window begins with the HISTORY turns before it; such repeated turns are
context, and only assistant texts that are new in a window are under its loss mask.

Nothing gathers a conversation: places and sums come from buckets of turns plus the sums of the
buckets before, context comes from equi-joins on places. Windows are read back where they lie; only
what the digests of a conversation run over is brought together, and streams through one task in
order, since a digest is sequential.

Defined results: null texts and roles are empty; equal turn numbers are ordered by role and text,
turns without a number come first, in that order too (they are one bucket of their conversation, put
in order by a sort that spills); repeated rows are turns of their own; a null conv_id is a
conversation; an empty table gives an empty result; other columns are ignored. A turn is never cut:
a text of any length is one turn of one window, which a task holds a few times over, and a system
turn is repeated in each window of its conversation, however long it is.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, n_words, small_batches, stash

BUDGET = 256
HISTORY = 2
#: Turns of a conversation that are put in order together.
BUCKET = 128
#: Words that a turn's marks count as.
MARKS = 4


def places(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, place (0 onwards) and before (words of the turns in front) of every turn."""
    source = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumns({"_words": n_words(F.col("text")) + MARKS, "_bucket": F.floor(F.coalesce("turn", F.lit(-1)) / BUCKET)})
    order = Window.partitionBy("conv_id", "_bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = source.withColumns({"_n": F.row_number().over(order) - 1, "_w": F.coalesce(F.sum("_words").over(upto), F.lit(0))})
    sums = source.groupBy("conv_id", "_bucket").agg(F.count("*").alias("_bn"), F.sum("_words").alias("_bw"))
    earlier = Window.partitionBy("conv_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("conv_id").alias("_c"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_on"), F.coalesce(F.sum("_bw").over(earlier), F.lit(0)).alias("_ow"))
    joined = inside.join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    return joined.select("conv_id", "role", "text", (F.col("_n") + F.col("_on")).cast("long").alias("place"), (F.col("_w") + F.col("_ow")).alias("before"))


def escape(text, signs: str):
    return F.regexp_replace(text, f"([{signs}])", r"\\$1")


def windows(conversations: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, context_turns, loss: the formatted windows.

    loss: (start, end) in code points of text of every span under the mask.
    """
    turns = stash(places(conversations).withColumn("window", F.floor(F.col("before") / budget)))
    starts = turns.groupBy("conv_id", "window").agg(F.min("place").alias("start"))
    others = starts.where("start > 0").select(F.col("conv_id").alias("_c"), F.col("window").alias("_w"), "start")
    back = others.select("_c", "_w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - history), F.col("start") - 1)).alias("_p"))
    repeated = turns.join(back, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("_p"))).select("conv_id", "role", "text", "place", F.col("_w").alias("window"))
    systems = turns.where("place = 0 and role = 'system'").select("conv_id", "role", "text", "place")
    kept = others.where(F.col("start") > history).join(systems, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "role", "text", "place", F.col("_w").alias("window"))
    columns = ["conv_id", "role", "text", "place", "window"]
    rows = turns.select(*columns, F.lit(False).alias("context")).union(repeated.union(kept).select(*columns, F.lit(True)))
    head = F.concat(F.lit("### "), escape(F.col("role"), r"\\#<:\n"), F.lit(":\n"))
    body = escape(F.col("text"), r"\\#<")
    rows = rows.withColumns({"_head": F.length(head), "_body": F.length(body), "_text": F.concat(head, body, F.lit("\n</turn>\n"))})
    rows = rows.withColumn("_target", (F.col("role") == "assistant") & ~F.col("context"))
    # A window holds budget words, one turn more and the context: its turns fit into one group.
    grouped = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("place", "_text", "_head", "_body", "_target"))).alias("t"), F.count(F.when(F.col("context"), 1)).alias("context_turns"))
    step = lambda a, t: F.struct(
        (a["at"] + F.length(t["_text"])).alias("at"),
        F.when(t["_target"], F.concat(a["loss"], F.array(F.struct((a["at"] + t["_head"]).alias("start"), (a["at"] + t["_head"] + t["_body"]).alias("end"))))).otherwise(a["loss"]).alias("loss"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    loss = F.aggregate("t", F.struct(F.lit(0).alias("at"), none.alias("loss")), step, lambda a: a["loss"])
    return grouped.select("conv_id", "window", F.array_join(F.transform("t", lambda t: t["_text"]), "").alias("text"), F.col("context_turns").cast("long").alias("context_turns"), loss.alias("loss"))


_SIGN = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n(.*?)\n</turn>\n", re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    plain = lambda s: _SIGN.sub(r"\1", s)
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("broken chat format")
        out.append((plain(m[1]), plain(m[2])))
        at = m.end()
    return out


def unpacked(formatted: DataFrame) -> DataFrame:
    """conv_id, window, n_turns, turns, loss_chars, loss, chars: what is new in each window, unescaped."""

    def run(batches):
        kept("op3")
        plain = lambda s: _SIGN.sub(r"\1", s)
        for batch in batches:
            rows = []
            for text, context, loss in zip(*(batch.column(c).to_pylist() for c in ("text", "context_turns", "loss"))):
                new = parse(text)[context:]
                said = [plain(text[span["start"] : span["end"]]) for span in loss]
                turns = "".join(f"{role}\n{words}\n" for role, words in new).encode("utf-8", "surrogatepass")
                rows.append((len(new), turns, sum(map(len, said)), "".join(said).encode("utf-8", "surrogatepass"), len(text)))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
            parts = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("window"), *parts], ["conv_id", "window", "n_turns", "turns", "loss_chars", "loss", "chars"])

    return formatted.mapInArrow(run, "conv_id long, window long, n_turns long, turns binary, loss_chars long, loss binary, chars long")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from formatted windows."""
    ordered = unpacked(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        kept("op3")
        rows: list[tuple] = []
        now, state = object(), None
        put = lambda: rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names)
        for batch in batches:
            for conv, n, turns, loss_chars, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "turns", "loss_chars", "loss", "chars"))):
                if state is None or conv != now:
                    if state is not None:
                        put()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(turns)
                state[2] += loss_chars
                state[3].update(loss)
                state[4] += chars
            if len(rows) > 10_000:
                yield make()
                rows.clear()
        if state is not None:
            put()
        if rows:
            yield make()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(windows(table.union(extra)))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, row_number() OVER o - 1 AS place,
    coalesce(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 256 AS win,
    len(regexp_replace(role, '([\\#<:\n])', '\\\1', 'g')) + len(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 15 AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
starts AS (SELECT conv_id, win, min(place) AS start FROM p GROUP BY ALL),
n AS (
  SELECT p.conv_id, p.place, p.chars, count(*) FILTER (WHERE s.start > 0 AND
      ((p.place < s.start AND p.place >= s.start - 2) OR (p.place = 0 AND p.role = 'system' AND s.start > 2))) AS again
  FROM p JOIN starts s ON p.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY ALL),
f AS (SELECT conv_id, sum(chars * (1 + again))::BIGINT AS formatted_chars FROM n GROUP BY conv_id)
SELECT p.conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars
FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY p.conv_id
"""
