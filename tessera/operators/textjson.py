"""JSON documents, canonical text and digests as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col


def field_variation(documents: DataFrame, column: str) -> DataFrame:
    """field, distinct_values, n, kind (constant or varying) over a column of flat JSON objects."""
    pairs = documents.select(F.explode(F.from_json(column, "map<string,string>")).alias("field", "v"))
    out = pairs.groupBy("field").agg(F.countDistinct("v").alias("distinct_values"), F.count("v").alias("n"))
    return out.withColumn("kind", F.when(F.col("distinct_values") <= 1, "constant").otherwise("varying"))


def canonical_row(columns: list[tuple[str, str]]) -> Column:
    """A row as text: dates as ISO, floats with ten decimals, joined by bars; null is empty. columns: (name, kind)."""
    parts = []
    for name, kind in columns:
        text = {"date": F.date_format(name, "yyyy-MM-dd"), "float": F.format_string("%.10f", F.col(name))}.get(kind, F.col(name).cast("string"))
        parts.append(F.coalesce(F.when(F.col(name).isNotNull(), text), F.lit("")))
    return F.concat_ws("|", *parts)


def canonical_json(columns: list[str]) -> Column:
    """The columns as a JSON object in order of their names, nulls kept, NaN and infinities as null."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def finite(x) -> Column:
    """Null for NaN and infinities."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def table_digest(df: DataFrame, row: Column, by: str, digits: int = 3, most: int = 1000) -> DataFrame:
    """One digest of the table, whatever the order of its rows.

    Row digests are sorted and digested in buckets of the group by their first hex digits, the
    buckets' digests by group, the groups' digests over the table. A group has 16 buckets to the power
    of digits, or of so many more that a bucket has some `most` rows: the number follows from its rows alone.
    """
    rows = df.select(F.col(by).cast("string").alias("k"), F.sha2(row, 256).alias("d"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("_n")).select(F.col("k").alias("_k"), F.greatest(F.lit(digits), F.ceil(F.log(16.0, F.col("_n") / most)).cast("int")).alias("_digits"))
    rows = rows.join(F.broadcast(sizes), F.col("k").eqNullSafe(F.col("_k"))).select("k", "d", F.expr("substring(d, 1, _digits)").alias("b"))
    joined = lambda lines: F.sha2(F.concat_ws("\n", F.sort_array(lines)), 256)
    line = lambda key, value: F.collect_list(F.concat_ws(":", F.col(key), F.col(value)))
    buckets = rows.groupBy("k", "b").agg(joined(F.collect_list("d")).alias("d"), F.count("*").alias("n"))
    groups = buckets.groupBy("k").agg(joined(line("b", "d")).alias("d"), F.sum("n").alias("n"))
    return groups.agg(joined(line("k", "d")).alias("digest"), F.sum("n").alias("n"))
