"""Conversation rollups and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import blank_to_null, js_round
from ..functions.messages import last_user_message, parse_messages


def conversation_rollup(requests: DataFrame) -> DataFrame:
    """Message count, tokens, cost and first/last time per conversation."""
    return (requests.filter(F.col("conversation_id").isNotNull())
            .groupBy(F.col("conversation_id").alias("id"))
            .agg(F.count(F.lit(1)).alias("total_messages"),
                 F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
                 F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("total_cost"),
                 F.min("created_at").alias("first_message_at"),
                 F.max("created_at").alias("last_message_at")))


def conversation_requests(requests: DataFrame, conversation_ids: DataFrame | None = None) -> DataFrame:
    """Requests of the given conversations (column ``id``), oldest first."""
    rows = requests.filter(F.col("conversation_id").isNotNull())
    if conversation_ids is not None:
        wanted = conversation_ids.select(F.col("id").alias("conversation_id")).distinct()
        rows = rows.join(wanted, "conversation_id", "left_semi")
    return rows.orderBy("conversation_id", "created_at", "id")


def conversation_replay(requests: DataFrame) -> DataFrame:
    """Chat rows: the last user message of each request, then its answer."""
    answer = F.coalesce(
        blank_to_null("output_message"), F.get_json_object("raw_response", "$.choices[0].message"))
    none_long, none_double = F.lit(None).cast("long"), F.lit(None).cast("double")
    base = (requests.filter(F.col("conversation_id").isNotNull())
            .select("conversation_id", "id", "created_at", "completion_tokens", "estimated_cost",
                    last_user_message(parse_messages("input_messages")).alias("_user"), answer.alias("_answer")))
    asked = F.when(F.col("_user").isNotNull(), F.struct(
        F.lit(0).alias("position"), F.col("_user.role").alias("role"), F.col("_user.content").alias("content"),
        none_long.alias("tokens"), none_double.alias("cost")))
    answered = F.when(F.json_object_keys("_answer").isNotNull(), F.struct(
        F.lit(1).alias("position"), F.get_json_object("_answer", "$.role").alias("role"),
        F.get_json_object("_answer", "$.content").alias("content"),
        F.col("completion_tokens").cast("long").alias("tokens"), F.col("estimated_cost").alias("cost")))
    return (base.select("conversation_id", "id", "created_at",
                        F.explode(F.filter(F.array(asked, answered), lambda m: m.isNotNull())).alias("m"))
            .select("conversation_id", "created_at", "id", "m.*")
            .orderBy("conversation_id", "created_at", "id", "position"))


def tokens_per_second(completion_tokens, latency_ms):
    """One decimal; 0 when nothing was completed, NULL when no time passed."""
    rate = js_round(F.try_divide(completion_tokens, latency_ms / F.lit(1000.0)), 1)
    return F.when(completion_tokens > 0, rate).otherwise(F.lit(0.0))


def playground_session(requests: DataFrame) -> DataFrame:
    """Cost, tokens and turns per playground chat (rows tagged ``playground``)."""
    tagged = F.array_contains(F.from_json("tags", "array<string>"), "playground")
    counted = F.col("status") == "success"
    return (requests.filter(tagged & F.col("conversation_id").isNotNull())
            .groupBy("conversation_id")
            .agg(F.coalesce(F.sum(F.when(counted, F.col("estimated_cost"))), F.lit(0.0)).alias("total_cost"),
                 F.coalesce(F.sum(F.when(counted, F.col("total_tokens"))), F.lit(0)).alias("total_tokens"),
                 F.count_if(counted).alias("turns")))


def playground_runs(requests: DataFrame) -> DataFrame:
    """Speed of every playground run."""
    tagged = F.array_contains(F.from_json("tags", "array<string>"), "playground")
    return requests.filter(tagged).select(
        "id", "conversation_id", "total_tokens", "latency_ms",
        tokens_per_second(F.col("completion_tokens"), F.col("latency_ms")).alias("tokens_per_second"))
