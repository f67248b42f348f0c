"""Alert rows for failed or slow calls (K3); the same function serves batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colours of failure and latency alerts in the two payload formats.
SLACK_COLOURS = ("#ff3333", "#ffaa00")
DISCORD_COLOURS = (16724787, 16755200)
TITLE = "🚨 Observability Alert"


def alerts(requests: DataFrame, on_failure: bool = True, latency_ms: int = 0) -> DataFrame:
    """id, model, status, latency, reason, error details and the two webhook payloads."""
    failed = F.coalesce(F.col("status") == "error", F.lit(False)) & F.lit(on_failure)
    slow = F.lit(latency_ms > 0) & (F.coalesce("latency_ms", F.lit(0)) >= F.lit(latency_ms))
    took = F.col("latency_ms").cast("string")
    over = F.concat(F.lit("("), took, F.lit(f"ms >= {latency_ms}ms)."))
    reason = (F.when(failed & slow, F.concat(F.lit("Request failed and exceeded latency threshold "), over))
              .when(failed, F.lit("Request execution failed."))
              .otherwise(F.concat(F.lit("Request latency exceeded threshold "), over)))
    base = requests.filter(failed | slow).select(
        "id", "model", F.upper("status").alias("status"), F.concat(took, F.lit(" ms")).alias("latency"),
        reason.alias("reason"), F.nullif(F.col("error_message"), F.lit("")).alias("error_details"), "created_at")
    is_error = F.col("status") == "ERROR"

    def fields(label: str, flag: str) -> Column:
        def entry(name: str, value: Column, short: bool) -> Column:
            return F.struct(F.lit(name).alias(label), value.alias("value"), F.lit(short).alias(flag))

        items = F.array(entry("Request ID", F.col("id"), True), entry("Model", F.col("model"), True),
                        entry("Status", F.col("status"), True), entry("Latency", F.col("latency"), True),
                        entry("Trigger Reason", F.col("reason"), False),
                        F.when(F.col("error_details").isNotNull(), entry("Error Details", F.col("error_details"), False)))
        return F.filter(items, lambda x: x.isNotNull()).alias("fields")

    slack = F.to_json(F.struct(F.array(F.struct(
        F.when(is_error, F.lit(SLACK_COLOURS[0])).otherwise(F.lit(SLACK_COLOURS[1])).alias("color"),
        F.lit(TITLE).alias("title"), F.col("reason").alias("text"), fields("title", "short"),
        F.unix_timestamp("created_at").alias("ts"))).alias("attachments")))
    discord = F.to_json(F.struct(F.array(F.struct(
        F.lit(TITLE).alias("title"), F.col("reason").alias("description"),
        F.when(is_error, F.lit(DISCORD_COLOURS[0])).otherwise(F.lit(DISCORD_COLOURS[1])).alias("color"),
        fields("name", "inline"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")))
        .alias("embeds")))
    return base.select("*", slack.alias("slack_payload"), discord.alias("discord_payload"))
