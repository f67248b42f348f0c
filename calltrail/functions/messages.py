"""Message arrays, labels and small field rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MESSAGES_DDL, MESSAGE_DDL
from .base import ColumnLike, as_col, blank_to_null, is_json, js_trim, json_like, utf16_length

PLACEHOLDER = r"\{\{[\s]*([A-Za-z0-9_]+)[\s]*\}\}"


def parse_messages(doc: ColumnLike) -> Column:
    """JSON array text to ``array<struct<role,content>>``; anything else gives an empty array.

    Elements that are no objects are left out, the others stay. Of a repeated key the last one counts.
    """
    c = as_col(doc)
    objects = F.filter(F.from_json(c, "array<variant>"), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    parsed = F.transform(objects, lambda v: F.from_json(F.to_json(v), MESSAGE_DDL))
    # A variant takes neither repeated keys nor more than 128 MB; then the elements are read one by one from the text.
    direct = F.filter(F.from_json(c, MESSAGES_DDL), lambda m: m.isNotNull())
    texts = F.filter(F.from_json(c, "array<string>"), lambda x: json_like(x, "{"))
    single = F.filter(F.transform(texts, lambda x: F.from_json(x, MESSAGE_DDL)), lambda m: m.isNotNull())
    rest = F.when(is_json(c), F.coalesce(direct, single))
    return F.when(json_like(c, "["), F.coalesce(parsed, rest, F.array().cast(MESSAGES_DDL))).otherwise(
        F.array().cast(MESSAGES_DDL))


def parse_message(doc: ColumnLike) -> Column:
    c = as_col(doc)
    return F.when(json_like(c, "{"), F.from_json(c, MESSAGE_DDL))


def message_content(doc: ColumnLike) -> Column:
    """Non-empty ``content`` of a message JSON, else NULL."""
    return blank_to_null(F.get_json_object(as_col(doc), "$.content"))


def with_role(messages: ColumnLike, role: str) -> Column:
    return F.filter(as_col(messages), lambda m: m["role"] == F.lit(role))


def first_content(messages: ColumnLike, role: str) -> Column:
    return F.get(with_role(messages, role), F.lit(0))["content"]


def last_user_message(messages: ColumnLike) -> Column:
    """Last message of role ``user`` as a struct, or NULL."""
    return F.try_element_at(with_role(messages, "user"), F.lit(-1))


def _compact(doc: Column) -> Column:
    return F.coalesce(F.to_json(F.try_parse_json(doc)), F.get_json_object(doc, "$"))


def _beyond_variant(doc: Column, opener: str) -> Column:
    """True for an array or object that no variant holds: keys repeat, or it is too large."""
    return F.try_parse_json(doc).isNull() & json_like(doc, opener) & is_json(doc)


def canonical_inputs(input_messages: ColumnLike, raw_request: ColumnLike) -> Column:
    """Input side of B9: stored messages, else those of the raw request."""
    stored = blank_to_null(input_messages)
    doc = F.coalesce(stored, F.get_json_object(as_col(raw_request), "$.messages"))
    variant = F.try_parse_json(doc)
    kind = F.schema_of_variant(variant)
    scalar = variant.cast("string")

    def one(text: Column) -> Column:
        return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))

    return (F.when(_beyond_variant(doc, "["), parse_messages(doc))
            .when(_beyond_variant(doc, "{"), one(_compact(doc)))
            .when(variant.isNull() | kind.isin("VOID"), F.array().cast(MESSAGES_DDL))
            .when(kind.startswith("ARRAY"), parse_messages(doc))
            .when(kind.startswith("OBJECT"), one(_compact(doc)))
            .when(scalar.isin("", "0", "false"), F.array().cast(MESSAGES_DDL))
            .otherwise(one(scalar)))


def canonical_output(output_message: ColumnLike, raw_response: ColumnLike) -> Column:
    """Output side of B9: stored message, else the first choice of the raw response."""
    stored = blank_to_null(output_message)
    doc = F.coalesce(stored, F.get_json_object(as_col(raw_response), "$.choices[0].message"))
    variant = F.try_parse_json(doc)
    kind = F.schema_of_variant(variant)
    scalar = variant.cast("string")
    role = F.coalesce(blank_to_null(F.get_json_object(doc, "$.role")), F.lit("assistant"))
    has_content = F.array_contains(F.json_object_keys(doc), "content")

    def message(r: Column, text: Column) -> Column:
        return F.struct(r.alias("role"), text.alias("content"))

    kept = message(F.get_json_object(doc, "$.role"), F.get_json_object(doc, "$.content"))
    last = F.from_json(doc, MESSAGE_DDL)
    return (F.when(_beyond_variant(doc, "{") & has_content, message(last["role"], last["content"]))
            .when(_beyond_variant(doc, "{"), message(F.coalesce(blank_to_null(last["role"]), F.lit("assistant")), _compact(doc)))
            .when(_beyond_variant(doc, "["), message(F.lit("assistant"), _compact(doc)))
            .when(variant.isNull() | kind.isin("VOID"), F.lit(None))
            .when(kind.startswith("OBJECT") & has_content, kept)
            .when(kind.startswith("OBJECT"), message(role, _compact(doc)))
            .when(kind.startswith("ARRAY"), message(F.lit("assistant"), _compact(doc)))
            .when(scalar.isin("", "0", "false"), F.lit(None))
            .otherwise(message(F.lit("assistant"), scalar)))


def model_leaf(model: ColumnLike) -> Column:
    c = as_col(model)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("Unknown")).otherwise(F.substring_index(c, "/", -1))


def task_label(evaluation: ColumnLike) -> Column:
    c = as_col(evaluation)
    return F.coalesce(blank_to_null(F.get_json_object(c, "$.task_type")),
                      blank_to_null(F.get_json_object(c, "$.category")), F.lit("general"))


def task_title(label: ColumnLike) -> Column:
    """``snake_case`` to ``Title Words``; letters after the first stay as they are."""
    words = F.transform(F.split(as_col(label), "_"),
                        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2 ** 31 - 1)))
    return F.array_join(words, " ")


def score_band(score: ColumnLike) -> Column:
    c = F.coalesce(as_col(score).cast("double"), F.lit(0.0))
    return F.when(c >= 4, F.lit("high")).when(c >= 3, F.lit("mid")).otherwise(F.lit("low"))


def estimate_tokens(messages: ColumnLike, output: ColumnLike) -> Column:
    """struct(prompt_tokens, completion_tokens): a quarter of the characters, at least one."""
    def size(text: Column) -> Column:
        return F.coalesce(utf16_length(text), F.lit(0))

    chars = F.aggregate(as_col(messages), F.lit(0).cast("long"),
                        lambda acc, m: acc + size(m["content"]) + size(m["role"]))
    prompt = F.greatest(F.lit(1), F.ceil(F.coalesce(chars, F.lit(0)) / 4)).cast("long")
    completion = F.greatest(F.lit(1), F.ceil(size(as_col(output)) / 4)).cast("long")
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"))


# Task words, tried in this order.
TASK_WORDS = (
    ("summarization", ("summarize", "summary")),
    ("paraphrase", ("paraphrase", "rephrase", "reword", "rewrite")),
    ("code_generation", ("code", "function", "javascript", "python")),
)


def classify_task_keywords(messages_json: ColumnLike) -> Column:
    text = F.lower(F.coalesce(as_col(messages_json), F.lit("")))
    out = None
    for label, words in TASK_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit("general"))


def derive_feedback(score: ColumnLike, rating: ColumnLike, comment: ColumnLike, task_success: ColumnLike,
                    expected_answer: ColumnLike, score_given: ColumnLike | None = None) -> Column:
    """Feedback struct; a missing score follows from the rating (4 and up good, 2 and down bad).

    ``score_given`` tells an explicit NULL score from an absent one.
    """
    s = as_col(score).cast("int")
    r = as_col(rating).cast("double")
    given = as_col(score_given) if score_given is not None else s.isNotNull()
    derived = F.when(r >= 4, F.lit(1)).when(r <= 2, F.lit(-1))
    return F.struct(F.when(given, s).otherwise(derived).alias("score"), r.alias("rating"),
                    F.coalesce(as_col(comment), F.lit("")).alias("comment"),
                    as_col(task_success).cast("boolean").alias("task_success"),
                    F.coalesce(as_col(expected_answer), F.lit("")).alias("expected_answer"))


def template_variables(text: ColumnLike) -> Column:
    """Distinct placeholder names in first-seen order."""
    found = F.array_distinct(F.regexp_extract_all(as_col(text), F.lit(PLACEHOLDER), F.lit(1)))
    return F.coalesce(found, F.array().cast("array<string>"))


def fill_template(text: ColumnLike, bindings: ColumnLike) -> Column:
    """Replace ``{{ name }}`` from a ``map<string,string>`` in one pass."""
    c = as_col(text)
    b = as_col(bindings)
    whole = F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(0))
    names = F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(1))
    values = F.zip_with(whole, names, lambda w, n: F.coalesce(F.try_element_at(b, n), w))
    pieces = F.split(c, PLACEHOLDER, -1)
    merged = F.zip_with(pieces, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    return F.coalesce(F.array_join(merged, ""), F.lit(""))


def tool_io(input_messages: ColumnLike, output_message: ColumnLike, raw_request: ColumnLike,
            raw_response: ColumnLike) -> Column:
    """struct(tool_input, tool_output) of a tool span."""
    text = first_content(parse_messages(input_messages), "user")
    marker = "\nOutput: "
    at = F.locate(marker, text)
    marked = text.startswith("Input: ") & (at > 0)
    inner = F.substring(text, F.lit(8), at - 8)
    outer = F.substring(text, at + len(marker), F.length(text))

    def fallback(raw: ColumnLike, stored: ColumnLike) -> Column:
        return F.coalesce(blank_to_null(raw), as_col(stored), F.lit(""))

    return F.struct(
        F.when(marked, js_trim(inner)).otherwise(fallback(raw_request, input_messages)).alias("tool_input"),
        F.when(marked, js_trim(outer)).otherwise(fallback(raw_response, output_message)).alias("tool_output"))


def parse_created_at(text: ColumnLike) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` or ISO ``T…Z`` to a timestamp; NULL when it is neither.

    Spark also reads words such as ``now``, which are no dates here.
    """
    c = as_col(text)
    return F.when(c.rlike("^[0-9]"), F.try_to_timestamp(c))


def mask_secret(value: ColumnLike) -> Column:
    c = F.coalesce(as_col(value), F.lit(""))
    n = F.length(c)
    shown = F.concat(F.substring(c, 1, 4), F.lit("..."), F.right(c, F.lit(4)))
    return F.when(n == 0, F.lit("")).when(n > 8, shown).otherwise(F.lit("********"))
