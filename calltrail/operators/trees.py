"""Span trees by numbers instead of paths: depth-first places, subtree sizes, and nested JSON in ordered parts.

Every row has constant width, however deep a trace is, so a chain of spans takes space in proportion to its length. All
rounds are doubling rounds: a tree of depth d needs log2(d) of them, over (trace, span) keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import left_join_sparse
from ..session import reliable_checkpoint
from .traces import span_parents

SPAN = ["trace_id", "id"]
_NO_TIME = "TIMESTAMP '0001-01-01'"


def _ahead(state: DataFrame, *values: str) -> DataFrame:
    """What a span finds at the ancestor it points to: the values there, and where that one points."""
    return state.select("trace_id", F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(v).alias(f"_{v}") for v in values])


def _sizes(nodes: DataFrame) -> DataFrame:
    """(trace_id, id, up, root_id, depth, size); ``up`` stays set where no root is reached.

    After k rounds ``up`` is the ancestor 2^k steps above, or NULL beyond the root, and ``size`` counts the spans less than
    2^k steps below. A span hands its count to the ancestor it points to, which is a partial sum before the shuffle.
    """
    here = F.col("parent_id")
    state = nodes.select(*SPAN, here.alias("up"), F.coalesce(here, "id").alias("root_id"),
                         F.when(here.isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("size"))
    left = -1
    while True:
        waiting = state.filter(F.col("up").isNotNull())
        now_left = waiting.count()
        if now_left in (0, left):  # spans in cycles, and below them, wait for ever
            return state
        left = now_left
        below = waiting.groupBy("trace_id", F.col("up").alias("id")).agg(F.sum("size").alias("_below"))
        joined = left_join_sparse(state.join(below, SPAN, "left"), _ahead(state, "root_id", "depth"), ["trace_id", "up"], "up", "id")
        state = reliable_checkpoint(joined.select(
            *SPAN, F.col("_up").alias("up"), F.coalesce("_root_id", "root_id").alias("root_id"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("_below", F.lit(0))).alias("size")))


def _steps(tree: DataFrame, block: str) -> DataFrame:
    """(trace_id, id, up, enter): how far a span's place lies behind its parent's, which its older siblings decide.

    Siblings are summed within blocks of time first, so that one parent of very many spans is spread over its blocks.
    """
    family = F.when(F.col("parent_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), "parent_id"))
    rows = tree.select(*SPAN, "parent_id", "created_at", "size", family.alias("_family"),
                       F.coalesce(F.date_trunc(block, "created_at"), F.expr(_NO_TIME)).alias("_block"))
    keys = ["trace_id", "_family", "_block"]
    earlier = (Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys).agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys[:2]).orderBy("_block").rowsBetween(*earlier))
    inside = F.sum("size").over(Window.partitionBy(*keys).orderBy("created_at", "id").rowsBetween(*earlier))
    zero = F.lit(0)
    down = F.when(F.col("parent_id").isNull(), 0).otherwise(1)
    return (rows.withColumn("_inside", inside).join(blocks.select(*keys, before.alias("_before")), keys)
            .select(*SPAN, F.col("parent_id").alias("up"), (down + F.coalesce("_inside", zero) + F.coalesce("_before", zero)).cast("long").alias("enter")))


def number_spans(requests: DataFrame, block: str = "minute") -> tuple[DataFrame, DataFrame]:
    """(tree, cycles) over the spans of every trace, without paths.

    tree: trace_id, id, span_id, created_at, parent_id, root_id, depth, enter, leave, size. ``enter`` counts the spans of
    the trace from 0 in depth-first order, siblings and roots by (created_at, id); ``leave`` is the last number in the
    span's subtree and ``size`` the number of spans in it. So x lies below y if y.enter < x.enter <= y.leave in one
    trace: descendants, ancestors and whole subtrees are range conditions, and sorting by (trace_id, enter) flattens
    the tree. cycles: spans that reach no root, as in :func:`~calltrail.operators.traces.span_tree`.

    Cases: a parent that the trace lacks makes its child a root; siblings without a time come first; ids are unique within
    a trace; an empty log gives empty tables. Spans of one parent within one ``block`` of time are ordered in one task.
    """
    nodes = reliable_checkpoint(span_parents(requests))
    sizes = _sizes(nodes)
    known = nodes.join(sizes.select(*SPAN, F.col("up").alias("_open"), "root_id", "depth", "size"), SPAN)
    tree = reliable_checkpoint(known.filter(F.col("_open").isNull()).drop("_open"))
    cycles = known.filter(F.col("_open").isNotNull()).select(*SPAN, "span_id", "parent_id")
    state = reliable_checkpoint(_steps(tree, block))
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        joined = left_join_sparse(state, _ahead(state, "enter"), ["trace_id", "up"], "up", "id")
        state = reliable_checkpoint(joined.select(*SPAN, F.col("_up").alias("up"), (F.col("enter") + F.coalesce("_enter", F.lit(0))).alias("enter")))
    numbered = tree.join(state.select(*SPAN, "enter"), SPAN)
    return numbered.select(*SPAN, "span_id", "created_at", "parent_id", "root_id", F.col("depth").cast("int").alias("depth"),
                           "enter", (F.col("enter") + F.col("size") - 1).alias("leave"), "size"), cycles


def children(tree: DataFrame) -> DataFrame:
    """(trace_id, parent_id, id, enter, next_enter): one row per edge; ``next_enter`` is the next sibling's number, if any.

    The next sibling starts right behind the subtree, so it is found by an equality join, not by a window over siblings.
    """
    kids = tree.filter(F.col("parent_id").isNotNull())
    after = kids.select("trace_id", "parent_id", (F.col("enter") - 1).alias("leave"), F.col("enter").alias("next_enter"))
    return kids.join(after, ["trace_id", "parent_id", "leave"], "left").select("trace_id", "parent_id", "id", "enter", "next_enter")


def subtrees(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """(top_id, spans of its subtree, itself included) for each (trace_id, id) of ``tops``: a join by trace and a range of numbers."""
    ranges = tree.join(tops.select(*SPAN).distinct(), SPAN).select("trace_id", F.col("id").alias("top_id"), F.col("enter").alias("_from"), F.col("leave").alias("_to"))
    return (tree.join(ranges, "trace_id").filter(F.col("enter").between(F.col("_from"), F.col("_to")))
            .select("top_id", *tree.columns))


def nested_parts(tree: DataFrame, fields: tuple[str, ...] = ("id", "span_id")) -> DataFrame:
    """(trace_id, enter, part): the nested JSON of every trace as one short text per span.

    The parts of a trace, joined in the order of ``enter`` and put in brackets, are the array of its roots; each span is
    an object of its ``fields`` and its ``children``. A part opens its span and closes those that end before the next
    one, of which only the depth is needed: one equality join with the following number. ``fields`` that are NULL are left
    out; they may be any columns of ``tree``, also ones joined to it before.
    """
    following = tree.select("trace_id", (F.col("enter") - 1).alias("enter"), F.col("depth").alias("_next"))
    shut: Column = F.col("depth") - F.coalesce("_next", F.lit(0)) + 1
    head = F.to_json(F.struct(*fields))
    opened = F.concat(F.when(head == "{}", F.lit("{")).otherwise(F.concat(F.left(head, F.length(head) - 1), F.lit(","))), F.lit('"children":['))
    comma = F.when(F.col("_next") <= F.col("depth"), F.lit(",")).otherwise(F.lit(""))
    return (tree.join(following, ["trace_id", "enter"], "left")
            .select("trace_id", "enter", F.concat(opened, F.repeat(F.lit("]}"), shut), comma).alias("part")))


def nested_documents(parts: DataFrame) -> DataFrame:
    """(trace_id, doc): the whole nested JSON of each trace in one cell, for the traces one looks at; select them before."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("enter", "part"))), lambda p: p["part"])
    return parts.groupBy("trace_id").agg(F.concat(F.lit("["), F.array_join(ordered, ""), F.lit("]")).alias("doc"))
