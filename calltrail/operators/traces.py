"""Trace rollups, span trees, replays and approval checks.

A trace may hold a large part of all spans. Rollups therefore use aggregates
with constant-size buffers (``min_by``, ``count_if``); joins use (trace, span)
keys; ordering is a global sort, which range-partitions inside a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import blank_to_null, overlay_numbers
from ..functions.messages import message_content, parse_message, parse_messages, tool_io, with_role
from ..scale import left_join_sparse
from ..schema import AGENT_METRICS, MESSAGES_DDL
from ..session import reliable_checkpoint
from .filters import between

ROOT_MARK = "root"
NEWEST = ("created_at", "id")


def has_trace() -> Column:
    return blank_to_null("trace_id").isNotNull()


def is_root() -> Column:
    parent = F.coalesce("parent_span_id", F.lit(""))
    return parent.isin("", ROOT_MARK)


def earliest(value: Column, where: Column | None = None) -> Column:
    """Value of the earliest row (created_at, id), optionally among rows that satisfy ``where``."""
    order = F.struct(*NEWEST)
    return F.min_by(value, order if where is None else F.when(where, order))


def trace_sessions(requests: DataFrame, start=None, end=None) -> DataFrame:
    """One row per trace: figures over the date range, name and model over the whole trace.

    With a range the figures come from its days alone; names are then looked up
    for the traces found, in a slim projection of the log. Without one a single
    aggregation gives both.
    """
    spans = requests.filter(has_trace())
    figures = [F.min("created_at").alias("first_span_at"), F.max("created_at").alias("last_span_at"),
               F.count(F.lit(1)).alias("total_spans"), F.sum("latency_ms").alias("total_latency_ms"),
               F.round(F.sum("estimated_cost"), 6).alias("total_cost"), F.sum("total_tokens").alias("total_tokens")]
    head = F.struct("span_name", "model")
    heads = [earliest(head, is_root()).alias("_root"), earliest(head).alias("_first")]
    if start is None and end is None:
        sessions = spans.groupBy("trace_id").agg(*figures, *heads)
    else:
        seen = between(spans, start, end).groupBy("trace_id").agg(*figures)
        named = (spans.select("trace_id", "created_at", "id", "span_id", "parent_span_id", "span_name", "model")
                 .join(seen.select("trace_id"), "trace_id", "left_semi").groupBy("trace_id").agg(*heads))
        sessions = seen.join(named, "trace_id")
    return (sessions
            .select("trace_id", "first_span_at", "last_span_at", "total_spans", "total_latency_ms", "total_cost",
                    "total_tokens",
                    F.coalesce("_root.span_name", "_first.span_name", F.lit("Trace Session")).alias("name"),
                    F.coalesce("_root.model", "_first.model", F.lit("unknown")).alias("model"))
            .orderBy(F.col("last_span_at").desc(), "trace_id"))


def trace_count(requests: DataFrame, start=None, end=None) -> DataFrame:
    return between(requests.filter(has_trace()), start, end).agg(F.count_distinct("trace_id").alias("total"))


def span_kinds() -> tuple[Column, Column, Column]:
    """Whether a span is a tool call, successful, and one that may stand for its trace."""
    return (F.col("span_type") == "tool", F.coalesce(F.col("status") == "success", F.lit(False)),
            F.col("parent_span_id").isNull() | is_root() | (F.col("span_type") == "agent"))


def agent_metric_columns() -> list[Column]:
    """Aggregates behind :func:`agent_metrics`; all of them merge, so streams can keep them too."""
    tool, good, top = span_kinds()
    head = F.struct("id", "status")
    return [earliest(head, top).alias("_root"), earliest(head).alias("_first"),
            F.count_if(tool).alias("_tools"), F.count_if(tool & good).alias("_tools_ok"),
            F.count(F.lit(1)).alias("_spans"), F.count_if(good).alias("_ok")]


def agent_metric_values() -> list[Column]:
    head = F.coalesce("_root", "_first")
    rate = F.col("_tools_ok") / F.col("_tools")
    has_tools = F.col("_tools") > 0
    return [F.col("trace_id"), head["id"].alias("root_id"),
            F.when(has_tools, rate).otherwise(F.lit(1.0)).alias("tool_success_rate"),
            F.col("_spans").alias("iteration_count"),
            F.when(head["status"] == "success", F.lit(1.0)).otherwise(F.lit(0.0)).alias("goal_completion_rate"),
            F.when(has_tools, rate).when(F.col("_ok") == F.col("_spans"), F.lit(1.0)).otherwise(F.lit(0.5))
            .alias("planning_accuracy"),
            F.when(has_tools, rate).otherwise(F.lit(1.0)).alias("tool_selection_accuracy")]


def agent_metrics(requests: DataFrame) -> DataFrame:
    """Tool, planning and goal figures per trace with the id of its root request."""
    return (requests.filter(has_trace()).groupBy("trace_id").agg(*agent_metric_columns())
            .select(*agent_metric_values()))


def with_agent_metrics(requests: DataFrame) -> DataFrame:
    """``evaluation`` of each root request with the agent figures of its trace laid over it."""
    figures = agent_metrics(requests).select(
        F.col("root_id").alias("id"), F.to_json(F.struct(*AGENT_METRICS)).alias("_figures"))
    merged = F.when(F.col("_figures").isNotNull(), overlay_numbers("evaluation", "_figures", AGENT_METRICS)).otherwise(F.col("evaluation"))
    return (requests.join(figures, "id", "left")
            .select(*[merged.alias(c) if c == "evaluation" else F.col(c) for c in requests.columns]))


# ------------------------------------------------------------------ tool context

def tool_outputs(requests: DataFrame) -> DataFrame:
    """(trace_id, created_at, id, text): what each tool span of a trace returned."""
    text = F.when(blank_to_null("output_message").isNotNull(), message_content("output_message")).otherwise(
        blank_to_null("raw_response"))
    return (requests.filter(has_trace() & (F.col("span_type") == "tool"))
            .select("trace_id", "created_at", "id", text.alias("text"))
            .filter(F.col("text").isNotNull()))


def gather_tool_context(requests: DataFrame) -> DataFrame:
    """(trace_id, context): all tool outputs of a trace joined by a blank line, in time order."""
    return join_slices(tool_outputs(requests))


def join_slices(outputs: DataFrame) -> DataFrame:
    """(trace_id, context) from rows of :func:`tool_outputs`.

    Outputs are joined per minute first, then minutes, so the rows that meet in one task are few even in a long trace.
    """
    def joined(position: list[str]) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*position, "text"))), lambda s: s["text"]), "\n\n")

    slices = (outputs.withColumn("slice", F.date_trunc("minute", "created_at")).groupBy("trace_id", "slice")
              .agg(joined(["created_at", "id"]).alias("text")))
    return slices.groupBy("trace_id").agg(joined(["slice"]).alias("context"))


# ------------------------------------------------------------------ later spans

def subsequent_spans(requests: DataFrame, anchors: DataFrame) -> DataFrame:
    """Spans of a trace later than an anchor span of that trace (columns trace_id, created_at).

    With several anchors in a trace the result is their union, which is what
    follows the earliest one: one row per anchored trace joins, never pairs.
    """
    first = (anchors.filter(has_trace()).groupBy("trace_id")
             .agg(F.min("created_at").alias("anchored_at")))
    return (requests.join(first, "trace_id").filter(F.col("created_at") > F.col("anchored_at"))
            .drop("anchored_at").select(*requests.columns))


def spans_after(requests: DataFrame, anchors: DataFrame, block: str = "minute") -> DataFrame:
    """(anchor_id, later spans): a row for each anchor (id, trace_id, created_at) and each span of its trace after it.

    An anchor is handed to the blocks of time at and after its own in which its trace has spans, so it meets them by
    (trace, block): a trace of any size is spread over its blocks, and no pair is made that is not in the result, but
    for those within the anchor's own block. Anchors and spans without a trace or a time follow nothing.
    """
    at = F.date_trunc(block, "created_at").alias("_block")
    spans = requests.filter(has_trace() & F.col("created_at").isNotNull()).select("*", at)
    blocks = spans.select("trace_id", "_block").distinct()
    marks = anchors.filter(has_trace() & F.col("created_at").isNotNull()).select(
        F.col("id").alias("anchor_id"), "trace_id", F.col("created_at").alias("_after"), F.date_trunc(block, "created_at").alias("_from"))
    handed = marks.join(blocks, "trace_id").filter(F.col("_block") >= F.col("_from"))
    return (spans.join(handed, ["trace_id", "_block"]).filter(F.col("created_at") > F.col("_after"))
            .select("anchor_id", *requests.columns))


def approval_queue(requests: DataFrame) -> DataFrame:
    """Check spans: those waiting for a person, and those already decided."""
    state = (F.when(F.col("status").isin("awaiting_approval", "paused"), F.lit("pending"))
             .when(F.col("status") == "success", F.lit("approved"))
             .when(F.col("status") == "rejected", F.lit("rejected")))
    return (requests.filter(F.col("span_type") == "check").withColumn("state", state)
            .filter(F.col("state").isNotNull())
            .select("id", "trace_id", "span_id", "span_name", "user_id", "status", "state", "created_at")
            .orderBy("created_at", "id"))


def stalled_checks(requests: DataFrame) -> DataFrame:
    """Decided checks after which their trace shows no later span.

    ``No later span`` means that the check is the newest of its trace, so an
    aggregate of one row per trace replaces the inequality join.
    """
    last = requests.filter(has_trace()).groupBy("trace_id").agg(F.max("created_at").alias("_last"))
    checks = requests.filter((F.col("span_type") == "check") & F.col("status").isin("success", "rejected") & has_trace())
    return (checks.join(last, "trace_id").filter(F.col("created_at") >= F.col("_last"))
            .select("id", "trace_id", "span_id", "span_name", "user_id", "status", "created_at"))


# ------------------------------------------------------------------ span trees

def span_parents(requests: DataFrame) -> DataFrame:
    """(trace_id, id, span_id, created_at, parent_id): the request id of every span's parent, NULL where the trace has none.

    Where several spans of a trace share a span id, the newest one acts as the parent.
    """
    spans = requests.filter(has_trace()).select("trace_id", "id", "span_id", "parent_span_id", "created_at")
    owner = (spans.filter(F.col("span_id").isNotNull()).groupBy("trace_id", "span_id")
             .agg(F.max_by("id", F.struct("created_at", "id")).alias("parent_id"))
             .withColumnRenamed("span_id", "parent_span_id"))
    wanted = F.when(~is_root(), F.col("parent_span_id"))
    return (left_join_sparse(spans.withColumn("parent_span_id", wanted), owner, ["trace_id", "parent_span_id"],
                             "parent_span_id", "id")
            .select("trace_id", "id", "span_id", "created_at", "parent_id"))


def span_tree(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, cycles) over the spans of every trace.

    tree: trace_id, id, span_id, parent_id, root_id, depth, path. ``parent_id`` is
    the request id of the parent span; a parent that is absent from the trace
    makes its child a root. ``path`` holds (created_at, id) of the ancestors and
    the span itself, so sorting by it walks the tree depth first. cycles: spans
    that reach no root.

    Ancestors are found by doubling: each round joins every open span with its
    current ancestor and takes over that one's path, so a tree of depth d needs
    log2(d) rounds. Spans that reached a root leave the rounds. Where several
    spans of a trace share a span id, the newest one acts as the parent.
    """
    nodes = span_parents(requests).select("trace_id", "id", "span_id", "parent_id",
                                          F.array(F.struct("created_at", "id")).alias("path"), F.col("parent_id").alias("next_id"))
    nodes = reliable_checkpoint(nodes)
    done, still = nodes.filter(F.col("next_id").isNull()), nodes.filter(F.col("next_id").isNotNull())
    left = still.count()
    while left:
        ahead = done.unionByName(still).select(
            "trace_id", F.col("id").alias("next_id"), F.col("path").alias("_up"), F.col("next_id").alias("_next"))
        moved = (still.join(ahead, ["trace_id", "next_id"])
                 .select("trace_id", "id", "span_id", "parent_id", F.concat("_up", "path").alias("path"),
                         F.col("_next").alias("next_id")))
        moved = reliable_checkpoint(moved)
        done = done.unionByName(moved.filter(F.col("next_id").isNull()))
        still = moved.filter(F.col("next_id").isNotNull())
        now_left = still.count()
        if now_left == left:
            break
        left = now_left
    tree = done.select("trace_id", "id", "span_id", "parent_id", F.get("path", 0)["id"].alias("root_id"),
                       (F.size("path") - 1).alias("depth"), "path")
    return tree, still.select("trace_id", "id", "span_id", "parent_id")


def flatten_tree(tree: DataFrame) -> DataFrame:
    """Depth-first order inside each trace."""
    return tree.orderBy("trace_id", "path").drop("path")


# ------------------------------------------------------------------ replays

def split_tool_io(requests: DataFrame) -> DataFrame:
    """Adds tool_input and tool_output for tool spans."""
    io = F.when(F.col("span_type") == "tool", tool_io("input_messages", "output_message", "raw_request", "raw_response"))
    return requests.withColumn("_io", io).select(
        *requests.columns, F.col("_io.tool_input").alias("tool_input"), F.col("_io.tool_output").alias("tool_output"))


def _row(position: int | Column, role: str | Column, content: Column, tokens: Column | None = None,
         cost: Column | None = None, tool_input: Column | None = None, tool_output: Column | None = None,
         error: Column | None = None) -> Column:
    def text(c: Column | None, kind: str) -> Column:
        return (F.lit(None) if c is None else c).cast(kind)

    return F.struct(
        F.lit(position).cast("int").alias("position"), F.lit(role).alias("role"), text(content, "string").alias("content"),
        text(tokens, "bigint").alias("tokens"), text(cost, "double").alias("cost"),
        text(tool_input, "string").alias("tool_input"), text(tool_output, "string").alias("tool_output"),
        text(error, "string").alias("error"))


# Lines shown for the state of a check.
CHECK_LINES = {"success": "✅ Check approved.", "rejected": "❌ Check rejected.",
               "awaiting_approval": "⏳ Awaiting review/approval.", "paused": "⏳ Awaiting review/approval."}


def trace_replay(requests: DataFrame) -> DataFrame:
    """Every trace as chat rows, ordered by (created_at, id, position)."""
    users = with_role(parse_messages("input_messages"), "user")
    base = (requests.filter(has_trace())
            .select("trace_id", "id", "span_id", "span_name", "span_type", "status", "error_message", "created_at",
                    "completion_tokens", "estimated_cost", users.alias("_users"),
                    message_content("output_message").alias("_answer"),
                    tool_io("input_messages", "output_message", "raw_request", "raw_response").alias("_io")))
    model_like = F.col("span_type").isNull() | F.col("span_type").isin("", "llm", "agent")
    check, tool = F.col("span_type") == "check", F.col("span_type") == "tool"
    spoken = F.transform("_users", lambda m, i: _row(i, "user", m["content"]))
    answer = F.array(_row(F.size("_users"), "assistant", F.col("_answer"), F.col("completion_tokens"), F.col("estimated_cost")))
    prefix = F.concat(F.lit("[Verification Check: "), F.coalesce("span_name", F.lit("null")), F.lit("] "))
    asked = F.transform("_users", lambda m, i: _row(i, "user", F.concat(prefix, m["content"])))
    line = None
    for status, text in CHECK_LINES.items():
        hit = F.col("status") == status
        line = F.when(hit, F.lit(text)) if line is None else line.when(hit, F.lit(text))
    verdict = F.array(_row(F.size("_users"), "assistant", line))
    used = F.array(_row(0, "tool", F.lit(None), tool_input=F.col("_io.tool_input"),
                        tool_output=F.col("_io.tool_output"), error=F.col("error_message")))
    rows = (F.when(model_like & F.col("_answer").isNotNull(), F.concat(spoken, answer))
            .when(model_like, spoken)
            .when(check & line.isNotNull(), F.concat(asked, verdict))
            .when(check, asked)
            .when(tool, used))
    return (base.select("trace_id", "created_at", "id", "span_id", "span_name", F.explode(rows).alias("m"))
            .select("trace_id", "created_at", "id", "span_id", "span_name", "m.*")
            .orderBy("trace_id", "created_at", "id", "position"))


# Fixed value: system text used when a logged call has none.
DEFAULT_SYSTEM = "You are a helpful and clear AI assistant."


def playground_payload(requests: DataFrame) -> DataFrame:
    """Replay data set: system text, dialogue including the answer, model and temperature."""
    inputs = parse_messages("input_messages")
    base = requests.select("id", "model", F.coalesce("temperature", F.lit(0.7)).alias("temperature"),
                           inputs.alias("_in"), parse_message("output_message").alias("_out"))
    system = F.get(with_role("_in", "system"), F.lit(0))["content"]
    talk = F.filter("_in", lambda m: ~F.coalesce(m["role"] == F.lit("system"), F.lit(False)))
    answer = F.struct(F.coalesce(blank_to_null(F.col("_out.role")), F.lit("assistant")).alias("role"),
                      F.col("_out.content").alias("content"))
    tail = F.when(F.col("_out").isNotNull(), F.array(answer)).otherwise(F.array().cast(MESSAGES_DDL))
    return base.select("id", F.lit("chat").alias("mode"), "model", "temperature",
                       F.coalesce(system, F.lit(DEFAULT_SYSTEM)).alias("system_prompt"),
                       F.concat(talk, tail).alias("messages"))
