"""Where users plug in their own functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_texts(df: DataFrame, text: str, scorer: Callable[[list[str]], list[float]], name: str = "sentiment") -> DataFrame:
    """Adds the scores of a batch function from texts to numbers, called once per Arrow batch; blank texts get null."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            filled = texts.fillna("").str.strip() != ""
            out = pd.Series([None] * len(texts), dtype="float64")
            if filled.any():
                out[filled.to_numpy()] = scorer(texts[filled].tolist())
            yield out

    return df.withColumn(name, run(F.col(text)))


def with_readers(build: Callable[..., DataFrame], **readers: Callable[[], DataFrame]) -> DataFrame:
    """Calls a builder with the tables that its readers give."""
    return build(**{name: read() for name, read in readers.items()})


def pipeline(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies table functions in turn."""
    for step in steps:
        df = df.transform(step)
    return df


def per_date(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, date: str = "date") -> DataFrame:
    """A user's pandas function on each date's rows; a date's cross-section must fit one task."""
    return df.groupBy(date).applyInPandas(function, schema)
