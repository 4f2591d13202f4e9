"""Token usage and its cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def price_table(prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """One price per model name: a custom price beats a mapped name, which beats the listed name."""
    fields = ["input", "output", "cache_read", "cache_creation"]
    listed = prices.where("origin = 'list'")
    mapped = aliases.join(listed.withColumnRenamed("model", "listed"), "listed").select("model", *fields, F.lit(1).alias("rank"))
    plain = listed.select("model", *fields, F.lit(2).alias("rank"))
    custom = prices.where("origin = 'custom'").select("model", *fields, F.lit(0).alias("rank"))
    every = custom.unionByName(mapped).unionByName(plain)
    return every.groupBy("model").agg(F.min_by(F.struct(*fields), "rank").alias("price"))


def price_usage(usage: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Usage rows with the parts of their cost; every part is NULL for a model without a price."""
    priced = usage.join(price_table(prices, aliases), "model", "left")
    p = F.col("price")
    known = p.isNotNull()

    def part(tokens: Column, price: Column) -> Column:
        return F.when(known & (tokens != 0) & (price != 0), tokens * price)

    new = F.when(known, (F.col("prompt_tokens") - F.coalesce("cached_tokens", F.lit(0))) * F.coalesce(p["input"], F.lit(0.0)))
    return (
        priced.withColumn("new_prompt_cost", new)
        .withColumn("cached_cost", part(F.col("cached_tokens"), p["cache_read"]))
        .withColumn("creation_cost", part(F.col("creation_tokens"), p["cache_creation"]))
        .withColumn("completion_cost", F.when(known, F.col("completion_tokens") * F.coalesce(p["output"], F.lit(0.0))))
        .withColumn(
            "prompt_cost",
            F.col("new_prompt_cost") + F.coalesce("cached_cost", F.lit(0.0)) + F.coalesce("creation_cost", F.lit(0.0)),
        )
        .withColumn("total_cost", F.col("prompt_cost") + F.col("completion_cost"))
        .drop("price")
    )


def usage_filter(usage: DataFrame, model: str | None = None, since=None) -> DataFrame:
    kept = usage if model is None else usage.where(F.col("model") == model)
    return kept if since is None else kept.where(F.col("ts") >= since)


def usage_measures() -> list[Column]:
    """Aggregates of priced usage; ``total_cost_ref`` counts cached reads twice, as the usual report does."""
    zero = F.lit(0.0)
    return [
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum(F.coalesce("cached_tokens", F.lit(0))).alias("cached_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.count("*").alias("invocations"),
        F.coalesce(F.sum("prompt_cost"), zero).alias("prompt_cost"),
        F.coalesce(F.sum("completion_cost"), zero).alias("completion_cost"),
        F.coalesce(F.sum("total_cost"), zero).alias("total_cost"),
        (F.coalesce(F.sum("total_cost"), zero) + F.coalesce(F.sum("cached_cost"), zero)).alias("total_cost_ref"),
    ]


def usage_summary(priced: DataFrame) -> DataFrame:
    """Totals per model and overall (model NULL) in one pass."""
    out = priced.rollup("model").agg(F.grouping("model").alias("overall"), *usage_measures())
    return out.withColumn("average_tokens", F.col("total_tokens") / F.col("invocations"))


def usage_for_run(usage: DataFrame, run: str = "run") -> DataFrame:
    """Token sums per run."""
    return usage.groupBy(run).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls")
    )


def usage_for_model(usage: DataFrame) -> DataFrame:
    """Token sums per model."""
    return usage.groupBy("model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum(F.coalesce("cached_tokens", F.lit(0))).alias("cached_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )
