"""Versioned prompt templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import js_trim
from ..functions.messages import fill_template
from ..functions.text import line_diff
from ..scale import number_within, previous_order

# Fixed value: names a prompt may have.
NAME_PATTERN = r"^[a-zA-Z0-9_\-\s.]+$"


def latest_prompts(prompts: DataFrame) -> DataFrame:
    """Newest version of every prompt, by name.

    Only (name, version) is aggregated; the texts are joined on both keys, so a
    name with many versions does not meet in one task.
    """
    newest = prompts.groupBy("name").agg(F.max("version").alias("version"))
    return prompts.join(newest, ["name", "version"], "left_semi").orderBy("name")


def prompt_history(prompts: DataFrame, name: str | None = None) -> DataFrame:
    rows = prompts if name is None else prompts.filter(F.col("name") == F.lit(name))
    return rows.orderBy("name", F.col("version").desc())


def append_prompt_versions(prompts: DataFrame, new: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(prompts with the new versions, rejected rows).

    ``new`` has name, system_prompt, user_template, variables (array) and a
    unique integer ``order``; versions continue from the newest stored one.
    """
    named = new.withColumn("name", js_trim("name"))
    valid = F.coalesce(F.col("name").rlike(NAME_PATTERN), F.lit(False))
    rejects = named.filter(~valid).withColumn("reason", F.lit("invalid prompt name"))
    top = prompts.groupBy("name").agg(F.max("version").alias("_top"))
    numbered = number_within(named.filter(valid), ["name"], order, out="_nth")
    added = (numbered.join(top, "name", "left")
             .select("name", (F.coalesce("_top", F.lit(0)) + F.col("_nth")).cast("long").alias("version"),
                     F.coalesce("system_prompt", F.lit("")).alias("system_prompt"),
                     F.coalesce("user_template", F.lit("")).alias("user_template"),
                     F.coalesce(F.to_json("variables"), F.lit("[]")).alias("variables")))
    return prompts.unionByName(added, allowMissingColumns=True), rejects


def delete_prompts(prompts: DataFrame, names: DataFrame) -> DataFrame:
    """Drop all versions of the given names."""
    return prompts.join(names.select("name").distinct(), "name", "left_anti")


def _lines(pairs: DataFrame) -> DataFrame:
    return (pairs.select("name", "from_version", "to_version",
                         F.posexplode(line_diff("_old", "_new")).alias("line_no", "edit"))
            .select("name", "from_version", "to_version", "line_no", "edit.type", "edit.text"))


def prompt_diff(prompts: DataFrame, column: str = "user_template", against: str = "previous") -> DataFrame:
    """Line edits between versions of a prompt.

    ``previous`` compares each version with the one before it; ``latest`` compares
    every older version with the newest. The partner version is found on key
    columns only; texts meet in an equi-join on (name, version).
    """
    texts = prompts.select("name", F.col("version").cast("long").alias("version"), column)
    if against == "latest":
        top = texts.groupBy("name").agg(F.max("version").alias("to_version"))
        steps = texts.select("name", F.col("version").alias("from_version")).join(top, "name").filter(
            F.col("from_version") < F.col("to_version"))
    else:
        steps = (previous_order(texts, ["name"], "version", out="from_version")
                 .filter(F.col("from_version").isNotNull()).withColumnRenamed("version", "to_version"))
    old = texts.select("name", F.col("version").alias("from_version"), F.col(column).alias("_old"))
    new = texts.select("name", F.col("version").alias("to_version"), F.col(column).alias("_new"))
    return _lines(steps.join(old, ["name", "from_version"]).join(new, ["name", "to_version"]))


def render_prompts(prompts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Fill the templates of ``prompts`` for a table (binding_id, name, values map<string,string>).

    A binding may name a ``version``; otherwise the newest version is used.
    """
    if "version" in bindings.columns:
        source, keys = prompts, ["name", "version"]
    else:
        source, keys = latest_prompts(prompts), ["name"]
    return bindings.join(source, keys).select(
        "binding_id", "name", "version", fill_template("system_prompt", "values").alias("system_prompt"),
        fill_template("user_template", "values").alias("user_prompt"))
