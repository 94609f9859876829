"""Sources: multi-file scans whose key, schema or layout varies, and reading of documents as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import business_day_add


def finite_columns(df: DataFrame) -> DataFrame:
    """Doubles and floats with NaN and infinities as null, once at the source."""
    fix = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def panel(df: DataFrame, label: str, *, keys: DataFrame | None = None, cutoff: str | None = None, embargo: int = 0, strict: bool = True) -> DataFrame:
    """Rows with a label, of the listed keys, whose date lies so many business days before the cutoff."""
    out = finite_columns(df).where(F.col(label).isNotNull())
    if keys is not None:
        out = out.join(keys, "key", "left_semi")
    if cutoff is not None:
        end = business_day_add(F.lit(cutoff).cast("date"), -embargo)
        out = out.where(F.col("date") < end if strict else F.col("date") <= end)
    return out


def per_key_files(spark: SparkSession, pattern: str, key: str = r"key=([^/]+)/[^/]*$") -> DataFrame:
    """One scan over all keys' files with merged columns; the key comes from the path."""
    found = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(pattern)
    return found.select("*", F.regexp_extract(F.col("_metadata.file_path"), key, 1).alias("key"))


def first_present(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of several columns, upper or lower case, that the table has, as text; null without any."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(have[n.lower()]).cast("string") for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def utc_daily_last(df: DataFrame, names: tuple[str, ...], key: str, order: str) -> DataFrame:
    """One row per key and UTC day: the last by order."""
    day = F.to_date(first_present(df, names).cast("timestamp"))
    best = df.withColumn("day", day).where("day is not null").groupBy(key, "day").agg(F.max_by(F.struct(*df.columns), order).alias("_r"))
    return best.select("day", "_r.*")


def csv_returns(spark: SparkSession, path: str) -> DataFrame:
    """date, key, value of CSV files with any of the usual headers; rows that cannot be read or are not finite go."""
    raw = spark.read.option("header", True).csv(path)
    value = F.expr("try_cast(_v as double)")
    picked = raw.select(first_present(raw, ("date", "prediction_date")).alias("_d"), first_present(raw, ("ticker", "symbol", "key")).alias("key"), first_present(raw, ("fwd_return", "forward_return", "return", "value")).alias("_v"))
    read = picked.select(F.expr("try_cast(_d as date)").alias("date"), "key", value.alias("value"))
    return finite_columns(read).where("date is not null and key is not null and value is not null")


def json_scores(spark: SparkSession, path: str) -> DataFrame:
    """date, digest, key, score of date-named JSON files {"scores": {key: value}}."""
    files = spark.read.option("wholetext", True).text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})", 1).cast("date").alias("date"))
    scores = files.select("date", F.sha2("value", 256).alias("digest"), F.explode(F.from_json("value", "scores map<string,double>")["scores"]).alias("key", "score"))
    return finite_columns(scores).where("score is not null")


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files with a column _corrupt_record for those that cannot be read."""
    files = spark.read.option("wholetext", True).text(path)
    doc = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return files.select(doc.alias("d")).select("d.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; a line that is blank or cannot be read has bad = true."""
    lines = spark.read.text(path)
    doc = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    read = lines.select("value", doc.alias("d"))
    return read.select("d.*", (F.col("d").isNull() | F.col("d._corrupt_record").isNotNull() | (F.trim("value") == "")).alias("bad")).drop("_corrupt_record")


def file_tree(spark: SparkSession, path: str) -> DataFrame:
    """name, size, sha256 of every file below a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def file_null_rates(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """file, n and the null rate of each column per file, over one merged scan."""
    found = spark.read.option("mergeSchema", True).parquet(path)
    have = [c for c in columns if c in found.columns]
    return found.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in have])


def footers(spark: SparkSession, path: str) -> DataFrame:
    """file, n, columns (in order), nulls (by column; null where the file has no statistics) of Parquet files, from their footers alone.

    Files are listed without their content; each task opens its share of them and reads no data page.
    """

    def run(batches):
        import pandas as pd
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            out = []
            for uri in batch["path"]:
                system, place = fs.FileSystem.from_uri(uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                meta = pq.read_metadata(place, filesystem=system)
                names = [meta.schema.column(i).path for i in range(meta.num_columns)]
                nulls: dict[str, int | None] = dict.fromkeys(names, 0)
                for g in range(meta.num_row_groups):
                    for i, name in enumerate(names):
                        stats = meta.row_group(g).column(i).statistics
                        known = stats is not None and stats.has_null_count and nulls[name] is not None
                        nulls[name] = nulls[name] + stats.null_count if known else None
                out.append((uri, meta.num_rows, names, nulls))
            yield pd.DataFrame(out, columns=["file", "n", "columns", "nulls"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    return listed.mapInPandas(run, "file string, n long, columns array<string>, nulls map<string,long>")


def label_source(first: DataFrame, second: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys and label from the first table that has the column."""
    return (first if label in first.columns else second).select(*keys, label)


def map_dimension(df: DataFrame, column: str, field: str) -> DataFrame:
    """key and one field of a JSON object of objects."""
    read = F.from_json(column, f"map<string,struct<{field}:string>>")
    return df.select(F.explode(read).alias("key", "v")).select("key", F.col(f"v.{field}").alias(field))
