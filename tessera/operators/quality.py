"""Data-quality and point-in-time checks: tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import parts_for


def reasons(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold, as an array in the given order; null counts as not holding."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def admissibility(records: DataFrame, horizon: int) -> DataFrame:
    """Adds reasons and admitted of records with trained, watermark, features, scored, decision, labels_end and digest."""
    tests = {
        "trained_after_watermark": F.col("trained") >= F.col("watermark"),
        "watermark_after_features": F.col("watermark") > F.col("features"),
        "features_after_decision": F.col("features") > F.col("decision"),
        "scored_after_decision": F.col("scored") > F.col("decision"),
        "bad_digest": ~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "labels_too_short": F.datediff("labels_end", "decision") < horizon,
    }
    out = records.withColumn("reasons", reasons(tests))
    return out.withColumn("admitted", F.size("reasons") == 0)


def envelope_problems(envelopes: DataFrame, column: str, required: tuple[str, ...]) -> DataFrame:
    """Adds problems of JSON envelopes: unreadable, missing:<key>, unknown:<key>."""
    keys = F.json_object_keys(column)
    need = F.array(*[F.lit(k) for k in required])
    missing = F.transform(F.array_except(need, keys), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.array_except(keys, need), lambda k: F.concat(F.lit("unknown:"), k))
    return envelopes.withColumn("problems", F.when(keys.isNull(), F.array(F.lit("unreadable"))).otherwise(F.sort_array(F.concat(missing, unknown))))


ENVELOPE = "asset_class string, calibrator_content_digest string, data_watermark string, decision_timestamp string, model_content_digest string, producer_run_id string, schema_version int, session_calendar string, session_date string, signal_snapshot_digest string, signals map<string,double>, universe_hash string"


def envelope_digest(doc: Column) -> Column:
    """SHA-256 of an envelope's canonical JSON without its own digest: keys in order, no blanks, times in UTC."""
    instant = lambda c: F.date_format(F.to_utc_timestamp(F.try_to_timestamp(doc[c]), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias(c)
    names = [part.split(" ")[0] for part in ENVELOPE.split(", ")]
    ordered = F.map_from_entries(F.array_sort(F.map_entries(doc["signals"])))
    own = {"data_watermark": instant("data_watermark"), "decision_timestamp": instant("decision_timestamp"), "signals": ordered.alias("signals")}
    kept = [own.get(c, doc[c].alias(c)) for c in names if c != "signal_snapshot_digest"]
    return F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256)


def signal_envelope_problems(envelopes: DataFrame, column: str, *, classes: tuple[str, ...] = ("crypto",), versions: tuple[int, ...] = (1,)) -> DataFrame:
    """Adds problems of signal envelopes (JSON text), in a fixed order; none for good ones.

    unreadable; missing:<key> and unknown:<key>; version, asset_class, empty:<field>, hex:<field>,
    time:<field> (no time with a zone), calendar (only UTC), after_decision (data newer than the
    decision), session (not the decision's UTC date), signals (none, a blank key, or a value that is no
    finite number), pair:<key> (no BASE/QUOTE in capitals), digest (not that of the content).
    """
    names = tuple(part.split(" ")[0] for part in ENVELOPE.split(", "))
    keyed = envelope_problems(envelopes, column, names).withColumn("_d", F.from_json(column, ENVELOPE))
    d = F.col("_d")
    zoned = lambda c: d[c].rlike("T.*(Z|[+-][0-9]{2}:[0-9]{2})$") & F.try_to_timestamp(d[c]).isNotNull()
    no = lambda test: ~F.coalesce(test, F.lit(False))
    day = F.to_date(F.to_utc_timestamp(F.try_to_timestamp(d["decision_timestamp"]), F.current_timezone()))
    finite = F.forall(F.map_values(d["signals"]), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    tests = {"version": no(d["schema_version"].isin(*versions)), "asset_class": no(d["asset_class"].isin(*classes))}
    tests |= {f"empty:{c}": no(F.length(d[c]) > 0) for c in ("producer_run_id", "universe_hash")}
    tests |= {f"hex:{c}": no(d[c].rlike("^[0-9a-f]{64}$")) for c in ("model_content_digest", "calibrator_content_digest", "signal_snapshot_digest")}
    tests |= {f"time:{c}": no(zoned(c)) for c in ("data_watermark", "decision_timestamp")}
    tests |= {"calendar": no(d["session_calendar"] == "UTC"), "after_decision": F.try_to_timestamp(d["data_watermark"]) > F.try_to_timestamp(d["decision_timestamp"]), "session": no(d["session_date"] == day.cast("string"))}
    tests |= {"signals": no((F.size(d["signals"]) > 0) & F.forall(F.map_keys(d["signals"]), lambda k: F.length(F.trim(k)) > 0) & finite)}
    pairs = F.transform(F.filter(F.coalesce(F.map_keys(d["signals"]), F.array().cast("array<string>")), lambda k: ~k.rlike("^[A-Z]+/[A-Z]+$")), lambda k: F.concat(F.lit("pair:"), k))
    first = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))
    digest = F.when(no(d["signal_snapshot_digest"] == envelope_digest(d)), F.array(F.lit("digest"))).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.size("problems") > 0, F.col("problems")).otherwise(F.concat(first, pairs, digest))
    return keyed.withColumn("problems", whole).drop("_d")


def content_conflicts(records: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys whose records do not all have one content.

    Records are dealt before they are counted, by key and content and then by key, into parts of
    some 250,000: nearly all keys differ, so counting where they are read would hold them all.
    """
    parts = parts_for(records)
    own = records.select(*keys, F.col(digest).alias("_c")).repartition(parts, *keys, "_c").groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
    return own.repartition(parts, *keys).groupBy(*keys).agg(F.count("_c").alias("contents"), F.sum("_n").alias("n")).where("contents > 1")


def source_consistency(rows: DataFrame, digest: str, end: str, decision: str, horizon: int) -> DataFrame:
    """One row: digests, ends, short (rows whose labels end too early), ok."""
    out = rows.agg(F.countDistinct(digest).alias("digests"), F.countDistinct(end).alias("ends"), F.count(F.when(F.datediff(end, decision) < horizon, 1)).alias("short"))
    return out.withColumn("ok", (F.col("digests") <= 1) & (F.col("ends") <= 1) & (F.col("short") == 0))


def axis_audit(rows: DataFrame, axis: DataFrame, lookahead: int) -> DataFrame:
    """rows, at_or_before_cutoff, unverifiable (label date beyond or off the axis), share; rows has date and cutoff, axis date and pos."""
    end = axis.agg(F.max("pos").alias("_end"))
    placed = rows.join(F.broadcast(axis), "date", "left").join(F.broadcast(end))
    bad = F.col("pos").isNull() | (F.col("pos") + lookahead > F.col("_end"))
    return placed.agg(F.count("*").alias("rows"), F.count(F.when(F.col("date") <= F.col("cutoff"), 1)).alias("at_or_before_cutoff"), F.count(F.when(bad, 1)).alias("unverifiable"), F.avg(bad.cast("double")).alias("share"))


def row_hash(index: str, text: str) -> Column:
    """The SHA-256 of a ledger row: its index, its text and the hash of the row before it (null: none); a null text has a hash of its own."""
    return F.sha2(F.concat_ws("|", F.col(index).cast("string"), F.coalesce(text, F.lit("\x00")), F.coalesce("prev_row_sha", F.lit("-"))), 256)


def chain_hashes(rows: DataFrame, index: str, text: str) -> DataFrame:
    """Adds prev_row_sha and row_sha, which covers the row's index and text and prev_row_sha.

    A chain is sequential: its rows stream through one task in order, and only the last hash is held.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        chain = last = None
        for batch in batches:
            before, own = [], []
            for c, i, t in zip(*(batch.column(n).to_pylist() for n in ("chain", index, text))):
                last = last if c == chain else None
                chain = c
                before.append(last)
                last = hashlib.sha256("|".join((str(i), "\x00" if t is None else t, last or "-")).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], [*batch.schema.names, "prev_row_sha", "row_sha"])

    ordered = rows.repartition("chain").sortWithinPartitions("chain", index)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ordered.mapInArrow(run, f"{kinds}, prev_row_sha string, row_sha string")


#: Indexes of a slice of a chain, which is ordered and checked in one task.
SLICE = 1 << 16


def chain_violations(ledger: DataFrame, index: str, text: str, key: str) -> DataFrame:
    """chain, index, problem: gaps in the index, broken links, rows that do not match their hash, repeated business keys.

    Every row is checked by itself against the link that it stores, so chains of any length are
    checked in parallel: a chain is cut into slices of its index, and a slice's first row is held
    against the last row of the slice before. Keys are counted in a second deal of narrow rows. The
    ledger is read three times and should be a written table.
    """
    parts = parts_for(ledger)
    cut = ledger.withColumn("_s", F.floor(F.col(index) / SLICE))
    ends = cut.groupBy("chain", "_s").agg(F.max(F.struct(F.col(index).alias("i"), F.col("row_sha").alias("h"))).alias("_last"))
    # One row per slice.
    before = ends.select(F.col("chain").alias("_chain"), F.col("_s").alias("_slice"), F.lag("_last").over(Window.partitionBy("chain").orderBy("_s")).alias("_before"))
    own = Window.partitionBy("chain", "_s").orderBy(index)
    at = F.row_number().over(own) == 1
    rows = cut.repartition(parts, "chain", "_s").withColumns({"_i": F.lag(index).over(own), "_h": F.lag("row_sha").over(own), "_at": at})
    rows = rows.join(F.broadcast(before), F.col("chain").eqNullSafe(F.col("_chain")) & F.col("_s").eqNullSafe(F.col("_slice")), "left")
    tests = {
        "gap": F.col(index) != F.coalesce(F.when(F.col("_at"), F.col("_before.i")).otherwise(F.col("_i")) + 1, F.lit(0)),
        "broken_link": ~F.col("prev_row_sha").eqNullSafe(F.when(F.col("_at"), F.col("_before.h")).otherwise(F.col("_h"))),
        "altered": ~F.col("row_sha").eqNullSafe(row_hash(index, text)),
    }
    found = rows.select("chain", index, F.explode(reasons(tests)).alias("problem"))
    keys = ledger.select("chain", index, key).repartition(parts, "chain", key)
    again = keys.withColumn("_n", F.count("*").over(Window.partitionBy("chain", key))).where("_n > 1")
    return found.union(again.select("chain", index, F.lit("repeated_key")))


def series_problems(series: DataFrame, value: str, axis: DataFrame) -> DataFrame:
    """date, problem of a per-date series: repeated dates, values that are not finite, dates missing between its ends on the axis."""
    twice = series.groupBy("date").count().where("count > 1").select("date", F.lit("repeated").alias("problem"))
    odd = series.where(F.isnan(value) | F.col(value).isNull() | (F.abs(value) == float("inf"))).select("date", F.lit("not finite").alias("problem"))
    ends = series.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    missing = axis.join(F.broadcast(ends)).where(F.col("date").between(F.col("_a"), F.col("_b"))).join(series.select("date"), "date", "left_anti").select("date", F.lit("missing").alias("problem"))
    return twice.union(odd).union(missing)


def moments_gate(df: DataFrame, features: list[str], mean: float = 0.1, sd: tuple[float, float] = (0.9, 1.1)) -> DataFrame:
    """share, n: how many standardised columns have a mean near 0 and a spread near 1."""
    stats = df.unpivot([], features, "feature", "x").groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    fine = (F.abs("m") <= mean) & F.col("s").between(*sd)
    return stats.agg(F.avg(F.coalesce(fine, F.lit(False)).cast("double")).alias("share"), F.count("*").alias("n"))


def table_stats(df: DataFrame, date: str, key: str) -> DataFrame:
    """rows, dates, keys, first, last."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(date).alias("dates"), F.countDistinct(key).alias("keys"), F.min(date).alias("first"), F.max(date).alias("last"))


def field_parity(documents: DataFrame, column: str, reference: str) -> DataFrame:
    """id, field, problem: fields of JSON objects that are missing, unexpected or of another type than in a reference object."""
    kind = lambda v: F.when(v.rlike("^-?[0-9]+$"), "integer").when(v.rlike(r"^-?[0-9.]+([eE][-+]?\d+)?$"), "number").when(v.rlike("^(true|false)$"), "boolean").otherwise("text")
    own, wanted = F.from_json(F.col(column), "map<string,string>"), F.from_json(F.lit(reference), "map<string,string>")
    have, want = F.coalesce(own, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), wanted

    def problem(field: Column) -> Column:
        a, b = F.try_element_at(have, field), F.try_element_at(want, field)
        return F.when(~F.map_contains_key(have, field), "missing").when(~F.map_contains_key(want, field), "unexpected").when(kind(a) != kind(b), "type")

    fields = F.transform(F.array_union(F.map_keys(have), F.map_keys(want)), lambda f: F.struct(f.alias("field"), problem(f).alias("problem")))
    return documents.select("id", F.explode(F.filter(fields, lambda p: p["problem"].isNotNull())).alias("p")).select("id", "p.field", "p.problem")
