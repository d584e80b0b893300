"""Where users' own functions go in.  All run on Arrow batches; none is called row by row by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From columns, each a series, to one number for each row.
Reward = Callable[..., pd.Series]


def reward_columns(df: DataFrame, rewards: dict[str, Reward], columns: Sequence[str]) -> DataFrame:
    """Adds a column for each reward function; a function gets the given columns as series."""

    def column(fn: Reward) -> Column:
        @F.pandas_udf("double")
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series(fn(*series), dtype="float64")

        return run(*columns)

    return df.withColumns({name: column(fn) for name, fn in rewards.items()})


def batched(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows in, any number of rows out, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def scored(df: DataFrame, load: Callable[[], Callable[[pd.Series], pd.Series]], text: str, out: str = "score") -> DataFrame:
    """Adds a score by a function that is loaded once for each task, as a model would be."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(b), dtype="float64")

    return df.withColumn(out, run(text))


def generated(df: DataFrame, generate: Callable[[list[str | None]], list[str | None]], prompt: str, out: str = "response") -> DataFrame:
    """Adds the text that ``generate`` gives for a batch of prompts.  Which service it asks, if any, is up to the caller."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(generate([None if pd.isna(x) else x for x in s]), dtype=object)

    return df.withColumn(out, run(prompt))


def grouped_metric(df: DataFrame, key: str, fn: Callable[..., float], columns: Sequence[str], out: str = "metric") -> DataFrame:
    """A number for each group by a function of whole columns.  A group must fit in the memory of a task; metrics of large
    groups are better written as aggregates."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> float:
        return float(fn(*series))

    return df.groupBy(key).agg(run(*columns).alias(out))
