"""Change tables applied to stored tables.

A change row names a key, a field and a value; the latest change per key and
field (by ``seq``) wins. Latest-of is a merging aggregate, so a key that is
changed very often is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Request fields a change may set.
REQUEST_FIELDS = ("tags", "status", "feedback", "evaluation")
PRICE_FIELDS = ("input_cost_per_million", "output_cost_per_million")


def _latest(field: str) -> Column:
    """struct(value) of the latest change of ``field``, or NULL; keeps an explicit NULL value apart."""
    return F.max_by(F.struct(F.col("value")), F.when(F.col("field") == field, F.col("seq"))).alias(f"_{field}")


def merge_changes(requests: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed requests, rejects).

    ``changes``: id, field (tags, status, feedback, evaluation or delete), value
    (text), seq. An unknown field, an empty status, tags that are no JSON array
    and unknown ids are rejected.
    """
    known = F.col("field").isin(*REQUEST_FIELDS, "delete")
    tags_ok = (F.col("field") != "tags") | F.coalesce(F.json_array_length("value").isNotNull(), F.lit(False))
    status_ok = (F.col("field") != "status") | (F.coalesce(F.col("value"), F.lit("")) != "")
    reason = (F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown field")).when(~tags_ok, F.lit("tags must be an array"))
              .when(~status_ok, F.lit("status is required")))
    marked = changes.withColumn("reason", reason)
    invalid = marked.filter(F.col("reason").isNotNull())
    valid = marked.filter(F.col("reason").isNull())
    latest = valid.groupBy("id").agg(*[_latest(f) for f in REQUEST_FIELDS],
                                     F.count_if(F.col("field") == "delete").alias("_deletes"))
    joined = requests.join(latest, "id", "left").filter(F.coalesce("_deletes", F.lit(0)) == 0)
    columns = [F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value")).otherwise(F.col(c)).alias(c)
               if c in REQUEST_FIELDS else F.col(c) for c in requests.columns]
    unknown = (valid.join(requests.select("id"), "id", "left_anti").withColumn("reason", F.lit("unknown id")))
    names = ["id", "field", "value", "seq", "reason"]
    return joined.select(*columns), invalid.select(*names).unionByName(unknown.select(*names))


def merge_model_prices(models: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models with new prices, rejects); only the given price fields change.

    ``changes``: id, input_cost_per_million, output_cost_per_million (either may
    be NULL), seq.
    """
    low, high = F.col(PRICE_FIELDS[0]), F.col(PRICE_FIELDS[1])
    reason = (F.when(low.isNull() & high.isNull(), F.lit("no price given"))
              .when((low < 0) | (high < 0), F.lit("price must be non-negative")))
    marked = changes.withColumn("reason", reason)
    valid = marked.filter(F.col("reason").isNull())
    latest = valid.groupBy("id").agg(*[F.max_by(p, F.when(F.col(p).isNotNull(), F.col("seq"))).alias(f"_{p}") for p in PRICE_FIELDS])
    columns = [F.coalesce(f"_{c}", c).alias(c) if c in PRICE_FIELDS else F.col(c) for c in models.columns]
    unknown = valid.join(models.select("id"), "id", "left_anti").withColumn("reason", F.lit("unknown id"))
    names = ["id", *PRICE_FIELDS, "seq", "reason"]
    rejects = marked.filter(F.col("reason").isNotNull()).select(*names).unionByName(unknown.select(*names))
    return models.join(latest, "id", "left").select(*columns), rejects


def register_models(models: DataFrame, new: DataFrame, provider: str = "deepinfra") -> tuple[DataFrame, DataFrame]:
    """(models with the new ones, rejects with id and reason).

    ``new`` has id and any columns of ``models``. A missing name is the id, a
    missing provider ``provider``, a missing price 0; a missing id, a negative
    price, a known id and a repeated one are rejected.
    """
    def given(name: str) -> Column:
        kind = models.schema[name].dataType
        value = F.col(name).cast(kind) if name in new.columns else F.lit(None).cast(kind)
        default = {"name": F.col("id"), "display_name": F.col("id"), "provider": F.lit(provider)}.get(name, F.lit(0.0) if name in PRICE_FIELDS else None)
        return (value if default is None else F.coalesce(value, default.cast(kind))).alias(name)

    rows = new.select(*[given(c) for c in models.columns])
    reason = F.when(F.coalesce("id", F.lit("")) == "", F.lit("id is required")).when(
        (F.col(PRICE_FIELDS[0]) < 0) | (F.col(PRICE_FIELDS[1]) < 0), F.lit("price must be non-negative"))
    marked = rows.withColumn("reason", reason)
    out, taken = insert_if_absent(models, marked.filter("reason IS NULL").drop("reason"), "id")
    return out, marked.filter("reason IS NOT NULL").select("id", "reason").unionByName(taken.select("id", "reason"))


def insert_if_absent(base: DataFrame, new: DataFrame, key: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(base plus new rows with unused keys, rejected rows).

    Among new rows of one key the one with the smallest ``order`` is taken (all
    columns decide when no order is given). Each further one is rejected, equal
    rows as often as they come.
    """
    ranking = F.struct(order) if order else F.struct(*new.columns)
    columns = [c for c in new.columns if c in base.columns]
    first = (new.groupBy(key).agg(F.min_by(F.struct(*new.columns), ranking).alias("_row"), F.count(F.lit(1)).alias("_copies"))
             .join(base.select(key), key, "left_anti"))
    added = first.select("_row.*").select(*columns)
    taken = new.join(base.select(key), key, "left_semi").withColumn("reason", F.lit("key exists"))
    # Equal rows are counted first, so a key that holds most rows is spread over its different rows.
    row = F.struct(*new.columns)
    kinds = new.groupBy(*new.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_this", row)
    winners = first.select(F.col(key).alias("_key"), "_row")
    left = F.col("_n") - F.when(F.col("_this").eqNullSafe(F.col("_row")), 1).otherwise(0)
    repeats = (kinds.join(winners, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_left", left).filter("_left > 0")
               .select(*new.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_left"))).alias("_copy")).drop("_copy"))
    taken = taken.unionByName(repeats.withColumn("reason", F.lit("repeated key")))
    return base.unionByName(added, allowMissingColumns=True), taken
