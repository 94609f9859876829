"""The corpus pipeline: quality rules, near duplicates, personal data, source mixing, token pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents (COLUMNS; further
columns of docs are not carried on, whatever they are called); the last returns what encoding gives.

Defined results of every stage: an empty table gives an empty result; whole texts are used, however
long; rows without a doc_id are documents of their own; repeated rows are kept apart where the stage
does not name one of them. Ties are settled by the operators as their docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, stash
from tessera.llm.op01_mixing import mix
from tessera.llm.op04_similar import similar
from tessera.llm.op05_pieces import SLICE_BYTES, encode_documents
from tessera.llm.op06_quality import judge, train
from tessera.llm.op09_private import find_private, learn_patterns

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rules and the model keep; null and empty texts fail the rules."""
    small_batches(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model, carry=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones: the one with the smallest doc_id.

    Rows that repeat a doc_id stay with it; rows without a doc_id stay, for none of them can be named.
    """
    small_batches(spark)
    found = similar(docs.select("doc_id", "text"), n=5, percent=80)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by its kind; null texts stay null."""
    small_batches(spark)
    clean = find_private(docs, learn_patterns(docs), with_text=True, carry=COLUMNS)
    text = F.col("redacted")
    return clean.select("doc_id", text.alias("text"), "lang", "source", F.when(text.isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does; of rows with one doc_id, all as often as the one taken most."""
    small_batches(spark)
    copies = mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("_d")).agg(F.max("copies").alias("copies"))
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_d")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again; null and empty texts have no ids."""
    import public_tokenizers

    small_batches(spark, 4000, SLICE_BYTES)
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("source",))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("private", private),
    ("mixture", mixture),
    ("pieces", pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stash(docs)
    return docs
