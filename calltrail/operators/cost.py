"""Pricing (C1, C2). The price list joins without a hint: Catalyst broadcasts it when it is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import js_round
from .conversations import conversation_rollup


def _prices(models: DataFrame) -> DataFrame:
    return models.select(F.col("id").alias("model"), F.col("input_cost_per_million").alias("_in"),
                         F.col("output_cost_per_million").alias("_out"), F.lit(True).alias("_priced"))


def price_of(prompt_tokens: Column, completion_tokens: Column, per_in: Column, per_out: Column) -> Column:
    million = F.lit(1_000_000.0)
    return js_round((prompt_tokens / million) * per_in + (completion_tokens / million) * per_out, 6)


def estimate_cost(requests: DataFrame, models: DataFrame, out: str = "estimated_cost") -> DataFrame:
    """Price every row from the price list; an unknown model costs 0."""
    cost = price_of(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("_in"), F.col("_out"))
    return (requests.join(_prices(models), "model", "left")
            .withColumn(out, F.coalesce(cost, F.lit(0.0))).drop("_in", "_out", "_priced"))


def reprice_requests(requests: DataFrame, models: DataFrame) -> DataFrame:
    """New cost for rows of registered models; the others keep theirs."""
    million = F.lit(1_000_000.0)
    fresh = js_round(F.col("prompt_tokens") * F.col("_in") / million
                     + F.col("completion_tokens") * F.col("_out") / million, 6)
    return (requests.join(_prices(models), "model", "left")
            .withColumn("estimated_cost", F.when(F.col("_priced"), fresh).otherwise(F.col("estimated_cost")))
            .select(*requests.columns))


def recalculate_costs(requests: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(re-priced calls, conversations with matching cost)."""
    priced = reprice_requests(requests, models)
    return priced, conversation_rollup(priced)
