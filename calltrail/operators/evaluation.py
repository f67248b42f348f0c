"""Judge pipeline and evaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import blank_to_null, js_round, once, overlay_numbers
from ..functions.messages import first_content, message_content, parse_messages
from ..functions.retrieval import mrr, precision_at_k, recall_at_k
from ..scale import left_join_sparse
from ..schema import (AGENT_METRICS, CONTEXT_METRICS, RAG_METRICS, RETRIEVAL_METRICS, TASK_METRICS,
                      TEXT_METRICS)
from .analytics import as_time
from .filters import between
from .metrics import text_metrics, text_scores
from .traces import gather_tool_context, join_slices, tool_outputs

BAD = "_malformed"


def text_fields(doc: Column | str, names) -> Column:
    """Parse a JSON object once into a struct of text fields; NULL when it is not an object."""
    ddl = ", ".join(f"`{n}` string" for n in dict.fromkeys(names)) + f", `{BAD}` string"
    return F.from_json(F.col(doc) if isinstance(doc, str) else doc, ddl, {"columnNameOfCorruptRecord": BAD})


# ------------------------------------------------------------------ report

def evaluation_analytics(requests: DataFrame, start, end) -> DataFrame:
    """One row of production, feedback, retrieval, text, hallucination and agent figures.

    The means of a family divide by the number of rows that belong to the
    family, not by the rows that carry the single metric. Documents that are not
    JSON objects are skipped.
    """
    names = RAG_METRICS + TEXT_METRICS + ("hallucination_rate",) + AGENT_METRICS
    rows = once(between(requests, start, end).select("status", "latency_ms", "estimated_cost", "total_tokens", "feedback", "evaluation"),
                f=text_fields("feedback", ("rating", "task_success")), e=text_fields("evaluation", names)).drop("feedback", "evaluation")
    rows = rows.withColumn("f_ok", F.col("f").isNotNull() & F.col(f"f.{BAD}").isNull()).withColumn(
        "e_ok", F.col("e").isNotNull() & F.col(f"e.{BAD}").isNull())

    def any_of(*keys: str) -> Column:
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.col(f"e.{k}").isNotNull()
        return F.col("e_ok") & hit

    in_rag = any_of("faithfulness", "answer_relevancy", "context_precision", "context_recall", "recall_at_k")
    in_text = any_of("exact_match", "f1_score", "bleu")
    in_hall = any_of("hallucination_rate")
    in_agent = any_of("iteration_count", "tool_success_rate")

    def total(key: str, member: Column) -> Column:
        return F.round(F.coalesce(F.sum(F.when(member, F.col(f"e.{key}").try_cast("double"))), F.lit(0.0)), 9)

    sums = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("failed"),
            F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency"),
            F.round(F.coalesce(F.sum("estimated_cost"), F.lit(0.0)), 9).alias("cost"),
            F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
            F.count_if("f_ok").alias("n_feedback"),
            F.count_if(F.col("f_ok") & F.col("f.rating").isNotNull()).alias("n_rating"),
            F.coalesce(F.sum(F.when(F.col("f_ok"), F.col("f.rating").try_cast("double"))), F.lit(0.0)).alias("ratings"),
            F.count_if(F.col("f_ok") & (F.col("f.task_success") == "true")).alias("n_success"),
            F.count_if(in_rag).alias("n_rag"), F.count_if(in_text).alias("n_text"),
            F.count_if(in_hall).alias("n_hall"), F.count_if(in_agent).alias("n_agent")]
    sums += [total(k, in_rag).alias(f"rag_{k}") for k in RAG_METRICS]
    sums += [total(k, in_text).alias(f"text_{k}") for k in TEXT_METRICS]
    sums += [total("hallucination_rate", in_hall).alias("hall_sum")]
    sums += [total(k, in_agent).alias(f"agent_{k}") for k in AGENT_METRICS]
    agg = rows.agg(*sums)

    def mean(sum_name: str, count: str, digits: int, scale: float = 1.0) -> Column:
        value = js_round(F.col(sum_name) / F.col(count) * F.lit(scale), digits)
        return F.when(F.col(count) > 0, value).otherwise(F.lit(0.0))

    minutes = max(1000.0, (as_time(end) - as_time(start)).total_seconds() * 1000.0) / 60000.0
    out = [F.col("n").alias("total_requests"), F.col("failed").alias("failed_requests"),
           mean("failed", "n", 2, 100.0).alias("error_rate"),
           js_round(F.col("n") / F.lit(minutes), 2).alias("throughput"),
           mean("latency", "n", 0).alias("avg_latency"), js_round("cost", 4).alias("total_cost"),
           F.col("tokens").alias("total_tokens"),
           mean("ratings", "n_rating", 1).alias("avg_rating"), F.col("n_rating").alias("rating_count"),
           mean("n_success", "n_feedback", 0, 100.0).alias("task_success_rate"),
           mean("text_exact_match", "n_text", 0, 100.0).alias("accuracy")]
    for k in RAG_METRICS:
        out.append(mean(f"rag_{k}", "n_rag", 2 if k in RETRIEVAL_METRICS else 1).alias(k))
    out += [mean(f"text_{k}", "n_text", 2).alias(k) for k in TEXT_METRICS]
    out.append(mean("hall_sum", "n_hall", 2).alias("hallucination_rate"))
    for k in AGENT_METRICS:
        name = "avg_iterations" if k == "iteration_count" else k
        out.append(mean(f"agent_{k}", "n_agent", 1 if k == "iteration_count" else 2).alias(name))
    return agg.select(*out)


# ------------------------------------------------------------------ judge input

def eval_candidates(requests: DataFrame) -> DataFrame:
    """Rows worth judging: not failed and with a non-empty answer."""
    return requests.filter((F.col("status") != "error") & message_content("output_message").isNotNull())


def _metadata(requests: DataFrame) -> DataFrame:
    fields = ("context", "retrieved_chunks", "chunks", "expected_answer", "ground_truth", "retrieved_ids", "relevant_ids")
    return once(requests, _meta=text_fields("metadata", fields))


def _expected() -> Column:
    return F.coalesce(blank_to_null(F.col("_meta.expected_answer")), blank_to_null(F.col("_meta.ground_truth")),
                      blank_to_null(F.get_json_object("feedback", "$.expected_answer")))


# Fixed value: heading of the context in a prompt.
CONTEXT_HEADING = "[Retrieved Context Documents]:\n"


def judge_inputs(requests: DataFrame, inline_context: bool = True) -> DataFrame:
    """One prompt per candidate, with the parts it is built from.

    Context comes from the metadata, else, whole, from the tool spans of the
    trace. Without ``inline_context`` the latter is not copied into the rows of
    every span: join :func:`~calltrail.operators.traces.gather_tool_context` by
    ``trace_id`` where a prompt is used.
    """
    candidates = _metadata(eval_candidates(requests))
    stored = F.coalesce(blank_to_null(F.col("_meta.context")), blank_to_null(F.col("_meta.retrieved_chunks")),
                        blank_to_null(F.col("_meta.chunks")))
    messages = parse_messages("input_messages")
    base = candidates.select(
        "id", "trace_id", stored.alias("_stored"), messages.alias("_in"),
        message_content("output_message").alias("response"), _expected().alias("expected"))
    # Rows that bring their own context, and rows without a trace, look nothing up.
    base = base.withColumn("_trace", F.when(F.col("_stored").isNull(), blank_to_null("trace_id")))
    if inline_context:
        per_trace = gather_tool_context(requests).select(F.col("trace_id").alias("_trace"), F.col("context").alias("_tool_context"))
        joined = left_join_sparse(base, per_trace, ["_trace"], "_trace", "id")
    else:
        joined = base.withColumn("_tool_context", F.lit(None).cast("string"))
    parts = joined.select(
        "id", "trace_id",
        F.coalesce(first_content("_in", "system"), F.lit("")).alias("system_message"),
        F.coalesce(blank_to_null(first_content("_in", "user")), F.lit("(no user message)")).alias("user_message"),
        "response", F.coalesce("_stored", "_tool_context").alias("context"), "expected")

    def block(title: str, text: Column) -> Column:
        return F.concat(F.lit(f"[{title}]:\n"), text)

    system = F.coalesce(blank_to_null("system_message"), F.lit("(none)"))
    prompt = F.concat_ws(
        "\n\n", F.when(blank_to_null("context").isNotNull(), block("Retrieved Context Documents", F.col("context"))),
        block("System Prompt Given to Assistant", system), block("User Query", F.col("user_message")),
        block("Assistant Response", F.col("response")),
        F.when(F.col("expected").isNotNull(), block("Expected Ground Truth Answer", F.col("expected"))))
    return parts.withColumn("prompt", prompt)


def context_slices(requests: DataFrame) -> DataFrame:
    """(trace_id, created_at, id, text): the context of every trace, each tool output once; traces whose context is empty are left out."""
    slices = tool_outputs(requests)
    filled = slices.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"))
    return slices.join(filled.filter((F.col("n") > 1) | (F.col("longest") > 0)).select("trace_id"), "trace_id", "left_semi")


def judge_prompt_parts(requests: DataFrame) -> DataFrame:
    """(id, position, text, context_of): the prompts of :func:`judge_inputs` as ordered parts, a trace's context by reference.

    Position 1 is the prompt without the tool outputs of the trace. Where it needs them, position 0 has the heading and
    names the trace in ``context_of``; the outputs themselves are the rows of :func:`context_slices`, stored once. What is
    written is linear in the log, also for a trace of very many spans. A join against the distinct traces with a context
    decides, so no text of it is shuffled.
    """
    own = judge_inputs(requests, inline_context=False)
    asks = own.select("id", "prompt", F.when(F.col("context").isNull(), blank_to_null("trace_id")).alias("_trace"))
    known = context_slices(requests).select(F.col("trace_id").alias("_trace")).distinct().withColumn("_has", F.lit(True))
    rows = left_join_sparse(asks, known, ["_trace"], "_trace", "id")
    none = F.lit(None).cast("string")
    whole = F.struct(F.lit(1).alias("position"), F.col("prompt").alias("text"), none.alias("context_of"))
    heading = F.struct(F.lit(0).alias("position"), F.lit(CONTEXT_HEADING).alias("text"), F.col("_trace").alias("context_of"))
    return rows.select("id", F.inline(F.when(F.col("_has"), F.array(heading, whole)).otherwise(F.array(whole))))


def join_prompt_parts(parts: DataFrame, slices: DataFrame) -> DataFrame:
    """(id, prompt) of the prompts whose ``parts`` are given; pass those that are about to be sent, since contexts are copied here.

    The context of a trace is put together once (by minute first, as in
    :func:`~calltrail.operators.traces.gather_tool_context`), for traces that the parts name.
    """
    named = parts.filter(F.col("context_of").isNotNull()).select(F.col("context_of").alias("trace_id")).distinct()
    contexts = join_slices(slices.join(named, "trace_id", "left_semi")).select(F.col("trace_id").alias("context_of"), "context")
    filled = left_join_sparse(parts, contexts, ["context_of"], "context_of", "id")
    text = F.concat("text", F.when(F.col("context_of").isNotNull(), F.concat(F.col("context"), F.lit("\n\n"))).otherwise(F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("position", text.alias("text"))))
    return filled.groupBy("id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("prompt"))


def local_metrics(requests: DataFrame) -> DataFrame:
    """Text metrics (where an expected answer exists) and retrieval metrics (where ids exist) per candidate."""
    candidates = _metadata(eval_candidates(requests))
    both = F.col("_meta.retrieved_ids").isNotNull() & F.col("_meta.relevant_ids").isNotNull()
    got = F.from_json(F.col("_meta.retrieved_ids"), "array<string>")
    want = F.from_json(F.col("_meta.relevant_ids"), "array<string>")
    rows = candidates.select(
        "id", message_content("output_message").alias("generated"), _expected().alias("expected"), both.alias("_both"),
        F.when(both, recall_at_k(got, want)).alias("recall_at_k"), F.when(both, precision_at_k(got, want)).alias("precision_at_k"),
        F.when(both, mrr(got, want)).alias("mrr"))
    useful = rows.filter(F.col("expected").isNotNull() | F.col("_both"))
    return text_scores(useful, ["id", *RETRIEVAL_METRICS]).select("id", *TEXT_METRICS, *RETRIEVAL_METRICS)


# ------------------------------------------------------------------ judge output

# Fixed value: name of the function a judge calls to hand in its result.
JUDGE_CALL = "submit_evaluation"


def parse_judge_output(raw: DataFrame, id_col: str = "id", response: str = "response") -> tuple[DataFrame, DataFrame]:
    """(id, judge_json) and rejects, from judge responses.

    The JSON is the argument of the judge's function call, else the message text
    without its code fence.
    """
    message = "$.choices[0].message"
    called = F.when(F.get_json_object(response, f"{message}.tool_calls[0].function.name") == JUDGE_CALL,
                    F.get_json_object(response, f"{message}.tool_calls[0].function.arguments"))
    text = F.trim(F.coalesce(F.get_json_object(response, f"{message}.content"), F.lit("")))
    bare = F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\n", ""), r"\n```$", ""))
    text = F.coalesce(bare, text)

    def valid(doc: Column) -> Column:
        return F.when(F.json_object_keys(doc).isNotNull(), doc)

    parsed = raw.withColumn("judge_json", F.coalesce(valid(called), valid(text)))
    good = parsed.filter(F.col("judge_json").isNotNull()).select(F.col(id_col).alias("id"), "judge_json")
    bad = parsed.filter(F.col("judge_json").isNull()).select(
        F.col(id_col).alias("id"), F.lit("unparseable judge output").alias("reason"))
    return good, bad


def _number(name: str) -> Column:
    return F.col(f"_j.{name}").try_cast("double")


def judged_values(parsed: DataFrame, has_context: Column | None = None, has_expected: Column | None = None) -> DataFrame:
    """Checked and rounded judge fields; ``score`` is NULL where the row is to be rejected."""
    names = ("score", "reasoning", "category", "task_type", "safety_status", "safety_reasoning", "task_metrics",
             "applicable_metrics", "hallucination_rate") + TASK_METRICS + CONTEXT_METRICS
    none = F.array().cast("array<string>")
    j = once(once(parsed, _j=text_fields("judge_json", names)),
             _listed=F.coalesce(F.from_json("_j.task_metrics", "array<string>"), none),
             _fit=F.coalesce(F.from_json("_j.applicable_metrics", "array<string>"), none))
    score = _number("score")
    context = F.lit(False) if has_context is None else F.coalesce(has_context, F.lit(False))

    def task(name: str) -> Column:
        v = _number(name)
        return F.when(F.array_contains("_listed", name) & (v >= 1) & (v <= 5), js_round(v, 1)).alias(name)

    def fitting(name: str, digits: int) -> Column:
        return F.when(context & F.array_contains("_fit", name), js_round(_number(name), digits)).alias(name)

    keep = [c for c in parsed.columns if c != "judge_json"]
    out = j.select(
        *keep, F.when((score >= 1) & (score <= 5), js_round(score, 1)).alias("score"),
        F.coalesce("_j.reasoning", F.lit("")).alias("reasoning"),
        F.coalesce(blank_to_null(F.col("_j.category")), F.lit("helpfulness")).alias("category"),
        F.coalesce(blank_to_null(F.col("_j.task_type")), F.lit("general")).alias("task_type"),
        F.when(blank_to_null(F.col("_j.safety_status")).isNotNull(), F.struct(
            F.col("_j.safety_status").alias("status"), F.coalesce("_j.safety_reasoning", F.lit("")).alias("reasoning")))
        .alias("safety"),
        *[task(n) for n in TASK_METRICS], *[fitting(n, 1) for n in CONTEXT_METRICS],
        fitting("hallucination_rate", 2), F.array_contains("_fit", "ground_truth_alignment").alias("_aligned"))
    scored = F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in TASK_METRICS]), lambda n: n.isNotNull())
    return out.withColumn("task_metrics", scored)


def assemble_evaluation(parsed: DataFrame, candidates: DataFrame | None = None,
                        metrics: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(evaluations, rejects).

    ``parsed`` has id and judge_json; ``candidates`` id and context (rows absent
    there have no context); ``metrics`` the local metrics per id. Text metrics
    enter only where the judge calls the ground truth aligned, retrieval
    metrics always, context metrics only where context exists.
    """
    rows = parsed.select("id", "judge_json")
    if candidates is not None:
        seen = candidates.select("id", blank_to_null("context").isNotNull().alias("_has_context"))
        rows = rows.join(seen, "id", "left")
        values = judged_values(rows, F.col("_has_context")).drop("_has_context")
    else:
        values = judged_values(rows)
    if metrics is not None:
        values = values.join(metrics, "id", "left")
        for name in TEXT_METRICS:
            values = values.withColumn(name, F.when(F.col("_aligned"), F.col(name)))
    else:
        for name in TEXT_METRICS + RETRIEVAL_METRICS:
            values = values.withColumn(name, F.lit(None).cast("double"))
    values = values.drop("_aligned")
    rejects = values.filter(F.col("score").isNull()).select("id", F.lit("score outside 1 to 5").alias("reason"))
    return values.filter(F.col("score").isNotNull()), rejects


# Notes on rows without a usable judge result.
UNREADABLE = "Failed to parse LLM evaluation; local NLP/retrieval metrics calculated."
UNREACHED = "API evaluation failed; local NLP/retrieval metrics calculated."


def failed_evaluations(rejects: DataFrame, metrics: DataFrame, note: str = UNREADABLE) -> DataFrame:
    """Rows whose judge output could not be read (or had) keep their local metrics, with score 0."""
    return (rejects.join(metrics, "id")
            .select("id", F.lit(0.0).alias("score"),
                    F.lit(note).alias("reasoning"),
                    F.lit("general").alias("category"), *TEXT_METRICS, *RETRIEVAL_METRICS))


def evaluation_json(evaluations: DataFrame) -> DataFrame:
    """(id, evaluation): the JSON text stored with a request; absent metrics are left out."""
    return evaluations.select("id", F.to_json(F.struct(*[c for c in evaluations.columns if c != "id"])).alias("evaluation"))


def apply_expected_answers(requests: DataFrame, feedback: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Requests with new feedback; where it brings an expected answer, text metrics follow.

    ``feedback`` has id and feedback (JSON). A row of ``judged`` (id, evaluation)
    replaces the evaluation; otherwise the recomputed text metrics are laid over it.
    """
    news = feedback.select("id", F.col("feedback").alias("_feedback"),
                           blank_to_null(F.get_json_object("feedback", "$.expected_answer")).alias("_expected"))
    rows = requests.join(news, "id", "left")
    pairs = (rows.filter(F.col("_expected").isNotNull())
             .select("id", message_content("output_message").alias("generated"), F.col("_expected").alias("expected"))
             .filter(F.col("generated").isNotNull()))
    fresh = text_metrics(pairs, "id").select("id", F.to_json(F.struct(*TEXT_METRICS)).alias("_fresh"))
    rows = rows.join(fresh, "id", "left")
    overlaid = overlay_numbers("evaluation", "_fresh", TEXT_METRICS)
    evaluation = F.when(F.col("_fresh").isNotNull(), overlaid).otherwise(F.col("evaluation"))
    if judged is not None:
        rows = rows.join(judged.select("id", F.col("evaluation").alias("_judged")), "id", "left")
        evaluation = F.coalesce(F.col("_judged"), evaluation)
    columns = {c: F.col(c) for c in requests.columns}
    columns["feedback"] = F.coalesce("_feedback", "feedback").alias("feedback")
    columns["evaluation"] = evaluation.alias("evaluation")
    return rows.select(*columns.values())


def safety_summary(evaluations: DataFrame) -> DataFrame:
    """Number of evaluations per safety status."""
    return (evaluations.filter(F.col("safety.status").isNotNull())
            .groupBy(F.col("safety.status").alias("status")).agg(F.count(F.lit(1)).alias("evaluations"))
            .orderBy("status"))
