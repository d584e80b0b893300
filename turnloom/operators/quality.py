"""Validation of records, and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles that a record may have.
ROLES = ("system", "human", "gpt")


def validated(lines: DataFrame, value: str = "value", roles: tuple[str, ...] = ROLES) -> DataFrame:
    """Adds ``error``: the first rule that a line of JSON breaks, null for a valid one.  Rules: it is JSON; it has
    ``conversations``; that is a list; every item has ``from`` and ``value``; every ``from`` is a known role."""
    v = F.try_parse_json(F.col(value))
    items = F.try_variant_get(v, "$.conversations", "array<variant>")
    kind = F.schema_of_variant(v)
    present = F.try_variant_get(v, "$.conversations", "variant")
    has = lambda x, f: F.try_variant_get(x, f"$.{f}", "variant").isNotNull()
    error = (
        F.when(v.isNull(), "no JSON")
        .when(~F.startswith(kind, F.lit("OBJECT")) | present.isNull(), "no conversations")
        .when(items.isNull(), "conversations is no list")
        .when(~F.forall(items, lambda x: has(x, "from") & has(x, "value")), "item without from or value")
        .when(~F.forall(items, lambda x: F.coalesce(F.try_variant_get(x, "$.from", "string").isin(*roles), F.lit(False))), "unknown role")
    )
    return lines.withColumn("error", error)


def validation_report(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("valid"), F.count_if(F.col("error").isNotNull()).alias("invalid"))


def squared_and_absolute_error(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    d = F.col(predicted) - F.col(actual)
    return df.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))


def pairwise_log_loss(chosen: Column, rejected: Column) -> Column:
    """-log sigmoid of the difference, without overflow."""
    d = chosen - rejected
    return F.greatest(-d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def corpus_perplexity(df: DataFrame, nll: str, target: str) -> DataFrame:
    """exp of the summed loss over the rows times the characters of all targets."""
    return df.agg(F.exp(F.sum(nll) / (F.count("*") * F.sum(F.length(target)))).alias("perplexity"))


def token_usage(df: DataFrame, prompt: str, completion: str) -> DataFrame:
    return df.withColumn("total_tokens", F.col(prompt) + F.col(completion))


def count_and_size(df: DataFrame, key: str, size: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count"), F.sum(size).alias("size"))


def trainable_share(df: DataFrame, n: str, trainable: str) -> DataFrame:
    kept = F.sum(F.when(F.col(trainable), F.col(n)).otherwise(0))
    return df.agg(kept.alias("trainable"), F.sum(n).alias("total"), (100 * kept / F.sum(n)).alias("percent"))
