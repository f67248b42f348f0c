"""Raw calls to request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import blank_to_null, once
from ..functions.messages import estimate_tokens, parse_messages
from ..functions.pii import guardrail_check, mask_pii_json
from ..operators.cost import price_of
from ..operators.evaluation import text_fields
from ..schema import REQUESTS

# What is stored when payload logging is off.
HIDDEN_INPUT = '[{"role":"system","content":"[Payload logging disabled]"}]'
HIDDEN_OUTPUT = '{"role":"assistant","content":"[Payload logging disabled]"}'
HIDDEN_RAW = '{"info":"Payload logging disabled"}'
STREAM_END = "[DONE]"
BLOCK = 4096


def _joined(position: str, text: str) -> Column:
    """Texts of a group in order of ``position``."""
    ordered = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(position, text))))
    return F.array_join(F.transform(ordered, lambda s: s[text]), "")


def _last(name: str, position: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(position)))


def stream_parts(chunks: DataFrame, key: str = "request_id", block: int = BLOCK) -> DataFrame:
    """(key, part, content, usage, finish_reason): payload rows joined per ``block`` sequence numbers.

    Parts follow each other in text order; each is joined by its own group, so a
    very long stream is worked on by many tasks.
    """
    rows = chunks.filter(F.col("data") != STREAM_END).select(key, "seq", "data")
    rows = (once(rows, _d=text_fields("data", ("choices", "usage")))
            .filter(F.col("_d._malformed").isNull() & F.col("_d").isNotNull())
            .select(key, "seq", F.floor(F.col("seq") / block).alias("part"),
                    blank_to_null(F.get_json_object("_d.choices", "$[0].delta.content")).alias("_text"),
                    blank_to_null(F.get_json_object("_d.choices", "$[0].finish_reason")).alias("_finish"),
                    F.from_json("_d.usage", "prompt_tokens long, completion_tokens long, total_tokens long").alias("_usage")))
    return rows.groupBy(key, "part").agg(
        _joined("seq", "_text").alias("content"), _last("_usage", "seq").alias("usage"),
        _last("_finish", "seq").alias("finish_reason"))


def assemble_stream_chunks(chunks: DataFrame, key: str = "request_id", block: int = BLOCK) -> DataFrame:
    """Rows (key, seq, data) of stream payloads to one row per call.

    content is the text of all deltas, whatever their number, usage and
    finish_reason the last ones given, parts the number of rows of
    :func:`stream_parts`. Deltas are joined in parts first, then parts.
    """
    pieces = stream_parts(chunks, key, block)
    usage = F.col("usage")
    whole = pieces.groupBy(key).agg(
        _joined("part", "content").alias("content"), F.count(F.lit(1)).alias("parts"),
        _last("usage", "part").alias("usage"), _last("finish_reason", "part").alias("finish_reason"))
    counts = F.struct(*[F.coalesce(usage[n], F.lit(0)).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])
    return whole.select(key, "content", F.when(usage.isNotNull(), counts).alias("usage"), "finish_reason", "parts")


def _truthy(text: Column) -> Column:
    return F.nullif(F.nullif(blank_to_null(text), F.lit("0")), F.lit("false"))


def normalize_calls(calls: DataFrame, models: DataFrame, provider: str = "deepinfra", *, log_payloads: bool = True,
                    mask: bool = False, chunks: DataFrame | None = None) -> DataFrame:
    """Call records (request, response, headers, HTTP status, latency) to request rows.

    Fields come from the request body, then the headers, then the defaults.
    ``chunks`` holds the payload rows of streamed calls (A4).
    """
    fields = ("model", "messages", "user", "conversation_id", "trace_id", "span_id", "parent_span_id", "span_name",
              "span_type", "span_status", "temperature", "max_tokens", "top_p", "frequency_penalty", "presence_penalty",
              "metadata")
    rows = once(calls, q=text_fields("request", fields), p=text_fields("response", ("model", "choices", "usage", "error")))
    if chunks is not None:
        streams = assemble_stream_chunks(chunks).select(
            F.col("request_id").alias("id"), F.col("content").alias("s_content"), F.col("usage").alias("s_usage"),
            F.col("finish_reason").alias("s_finish"))
        rows = rows.join(streams, "id", "left")
    else:
        rows = (rows.withColumn("s_content", F.lit(None).cast("string"))
                .withColumn("s_usage", F.lit(None).cast("struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"))
                .withColumn("s_finish", F.lit(None).cast("string")))

    def header(name: str) -> Column:
        named = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == F.lit(name))
        return blank_to_null(F.get(named, F.lit(0))["value"])

    def field(name: str, head: str) -> Column:
        return F.coalesce(_truthy(F.col(f"q.{name}")), header(head))

    ok = F.col("http_status").between(200, 299)
    failed = F.col("transport_error").isNotNull()
    streamed = F.coalesce("stream", F.lit(False))
    refused = streamed & ~ok
    override = F.coalesce(header("x-span-status"), _truthy(F.col("q.span_status")))
    no_counts = failed | refused
    message = F.get_json_object("p.choices", "$[0].message")
    usage = F.from_json("p.usage", "prompt_tokens long, completion_tokens long, total_tokens long, estimated_cost double")
    error_text = F.coalesce(blank_to_null(F.get_json_object("p.error", "$.message")),
                            F.when(~streamed, F.col("p.error")),
                            F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
    rows = once(rows, _message=F.when(~no_counts & ~streamed, message), _usage=usage, _trace=field("trace_id", "x-trace-id"),
                _model=F.coalesce(_truthy(F.col("q.model")), F.when(~streamed & ~failed, _truthy(F.col("p.model"))), F.lit("unknown")))
    output_text = F.when(streamed, F.col("s_content")).otherwise(F.get_json_object("_message", "$.content"))
    guess = estimate_tokens(parse_messages("q.messages"), output_text)
    rows = once(rows, _guess=guess)
    u_prompt, u_completion = F.coalesce("_usage.prompt_tokens", F.lit(0)), F.coalesce("_usage.completion_tokens", F.lit(0))
    blind = F.when(streamed, F.col("s_usage").isNull()).otherwise((u_prompt == 0) & (u_completion == 0))

    def count(name: str, plain: Column) -> Column:
        seen = F.when(streamed, F.col(f"s_usage.{name}")).otherwise(plain)
        return F.when(no_counts, F.lit(0)).when(blind, F.col(f"_guess.{name}")).otherwise(seen).cast("long")

    rows = rows.withColumn("prompt_tokens", count("prompt_tokens", u_prompt)).withColumn(
        "completion_tokens", count("completion_tokens", u_completion))
    both = F.col("prompt_tokens") + F.col("completion_tokens")
    plain_total = F.coalesce(F.nullif(F.col("_usage.total_tokens"), F.lit(0)), both)
    stream_total = F.when(F.col("s_usage").isNotNull(), F.col("s_usage.total_tokens")).otherwise(both)
    total = F.when(no_counts, F.lit(0)).when(streamed, stream_total).otherwise(plain_total).cast("long")
    prices = models.select(F.col("id").alias("_model"), F.col("input_cost_per_million").alias("_in"),
                           F.col("output_cost_per_million").alias("_out"))
    rows = rows.join(prices, "_model", "left")
    priced = F.coalesce(price_of(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("_in"), F.col("_out")), F.lit(0.0))
    cost = F.when(no_counts, F.lit(0.0)).when(streamed, priced).otherwise(F.coalesce("_usage.estimated_cost", priced))
    status = (F.when(failed, F.coalesce(override, F.lit("error"))).when(refused, F.lit("error"))
              .otherwise(F.coalesce(override, F.when(ok, F.lit("success")).otherwise(F.lit("error")))))
    display = provider[:1].upper() + provider[1:]
    hide = not log_payloads

    def stored(doc: Column, hidden: str) -> Column:
        if hide:
            return F.when(doc.isNotNull(), F.lit(hidden))
        return mask_pii_json(doc) if mask else doc

    stream_out = F.when(blank_to_null("s_content").isNotNull(), F.to_json(
        F.struct(F.lit("assistant").alias("role"), F.col("s_content").alias("content"))))
    output = F.when(no_counts, F.lit(None)).when(streamed, stream_out).otherwise(F.col("_message"))
    stream_raw = F.to_json(F.struct(F.col("s_finish").alias("finish_reason"), F.col("s_usage").alias("usage"),
                                    F.length(F.coalesce("s_content", F.lit(""))).alias("content_length")))
    raw_response = F.when(failed, F.lit(None)).when(streamed & ok, stream_raw).otherwise(F.col("response"))
    trace = F.col("_trace")
    values = {
        "id": F.col("id"), "conversation_id": field("conversation_id", "x-conversation-id"), "model": F.col("_model"),
        "provider": F.lit(provider), "input_messages": stored(F.coalesce("q.messages", F.lit("[]")), HIDDEN_INPUT),
        "output_message": stored(output, HIDDEN_OUTPUT), "prompt_tokens": F.col("prompt_tokens"),
        "completion_tokens": F.col("completion_tokens"), "total_tokens": total, "estimated_cost": cost,
        "latency_ms": F.coalesce("latency_ms", F.lit(0)), "status": status,
        "error_message": F.when(failed, F.col("transport_error")).when(~ok, error_text),
        "temperature": F.col("q.temperature"), "max_tokens": F.col("q.max_tokens"), "top_p": F.col("q.top_p"),
        "frequency_penalty": F.col("q.frequency_penalty"), "presence_penalty": F.col("q.presence_penalty"),
        "user_id": field("user", "x-user-id"), "metadata": F.when(~no_counts, _truthy(F.col("q.metadata"))),
        "tags": F.lit(None), "stream": streamed, "raw_request": stored(F.col("request"), HIDDEN_RAW),
        "raw_response": stored(raw_response, HIDDEN_RAW), "feedback": F.lit(None), "evaluation": F.lit(None),
        "trace_id": trace, "span_id": field("span_id", "x-span-id"),
        "parent_span_id": field("parent_span_id", "x-parent-span-id"),
        "span_name": F.coalesce(field("span_name", "x-span-name"),
                                F.when(trace.isNotNull(), F.concat(F.lit(f"{display} - "), F.col("_model")))),
        "span_type": F.coalesce(field("span_type", "x-span-type"), F.when(trace.isNotNull(), F.lit("llm"))),
        "created_at": F.col("created_at")}
    return rows.select(*[values[f.name].try_cast(f.dataType).alias(f.name) for f in REQUESTS])


def drop_blocked(calls: DataFrame, banned: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls that pass the keyword guardrail, blocked calls with keyword and message)."""
    check = guardrail_check(parse_messages(F.from_json("request", "struct<messages:string>")["messages"]), *([banned] if banned else []))
    marked = calls.withColumn("_check", check)
    passed = marked.filter(~F.col("_check.blocked")).drop("_check")
    blocked = marked.filter(F.col("_check.blocked")).select("id", "_check.keyword", "_check.message", "created_at")
    return passed, blocked


def redact_payloads(requests: DataFrame, log_payloads: bool) -> DataFrame:
    """Replace stored payloads by placeholders when payload logging is off; figures stay."""
    if log_payloads:
        return requests

    def hidden(name: str, text: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.lit(text))

    return (requests.withColumn("input_messages", F.lit(HIDDEN_INPUT))
            .withColumn("output_message", hidden("output_message", HIDDEN_OUTPUT))
            .withColumn("raw_request", hidden("raw_request", HIDDEN_RAW))
            .withColumn("raw_response", hidden("raw_response", HIDDEN_RAW)))
