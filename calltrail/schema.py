"""Table layouts of the call log."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the call table and its types.
REQUESTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("conversation_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("input_messages", T.StringType()),
    T.StructField("output_message", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("estimated_cost", T.DoubleType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("max_tokens", T.LongType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("frequency_penalty", T.DoubleType()),
    T.StructField("presence_penalty", T.DoubleType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("stream", T.BooleanType()),
    T.StructField("raw_request", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("feedback", T.StringType()),
    T.StructField("evaluation", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("parent_span_id", T.StringType()),
    T.StructField("span_name", T.StringType()),
    T.StructField("span_type", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

MODELS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("input_cost_per_million", T.DoubleType()),
    T.StructField("output_cost_per_million", T.DoubleType()),
    T.StructField("context_window", T.LongType()),
])

PROMPTS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("system_prompt", T.StringType()),
    T.StructField("user_template", T.StringType()),
    T.StructField("variables", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

# One raw call as a gateway would record it, before it becomes a request row.
CALLS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("request", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("transport_error", T.StringType()),
    T.StructField("stream", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
])

MESSAGE_DDL = "struct<role:string,content:string>"
MESSAGES_DDL = f"array<{MESSAGE_DDL}>"

# Evaluation keys of each metric family.
RAG_METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall",
               "context_relevance", "recall_at_k", "precision_at_k", "mrr")
TEXT_METRICS = ("exact_match", "f1_score", "rouge_1", "rouge_2", "rouge_l", "bleu")
AGENT_METRICS = ("tool_success_rate", "tool_selection_accuracy", "planning_accuracy",
                 "iteration_count", "goal_completion_rate")
CONTEXT_METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall",
                   "context_relevance")
RETRIEVAL_METRICS = ("recall_at_k", "precision_at_k", "mrr")
# Task metrics a judge may report, in reporting order.
TASK_METRICS = ("conciseness", "information_retention", "coherence", "fluency",
                "semantic_preservation", "lexical_diversity", "instruction_following",
                "completeness", "creativity", "code_correctness", "translation_accuracy",
                "factual_accuracy", "readability", "code_efficiency", "tone_relevance",
                "classification_accuracy", "reasoning_quality", "extraction_precision",
                "format_compliance", "conversational_flow", "helpfulness")
