"""Totals are kept by deltas: they need the deltas and commit marks alone, and a delta holds what a batch changes."""

from pyspark.sql import functions as F

from calltrail.llm import rollups

CHANGE = "doc_id long, deleted boolean, text string, source string, lang string"


def groups(df):
    return {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in df.collect()}


def test_deltas_alone_give_totals(spark, tmp_path):
    store, bare, count = str(tmp_path / "store"), str(tmp_path / "bare"), [rollups.word_counter("w")]
    rollups.commit_batch(spark, store, 1, spark.createDataFrame([(1, False, "a b", "s", "en"), (2, False, "c", "s", "en"), (3, False, "d", None, None)], CHANGE), count)
    rollups.commit_batch(spark, store, 2, spark.createDataFrame([(1, False, "a b c d", "s", "en"), (2, True, None, None, None), (4, False, "x", "t", "en"), (9, True, None, None, None)], CHANGE), count)
    rollups.commit_batch(spark, store, 3, spark.createDataFrame([(4, True, None, None, None)], CHANGE), count)
    deltas = [groups(spark.read.schema(rollups.DELTA).parquet(f"{store}/deltas/batch={n}")) for n in (1, 2, 3)]
    assert deltas == [{("s", "en"): (2, 3), (None, None): (1, 1)}, {("s", "en"): (-1, 1), ("t", "en"): (1, 1)}, {("t", "en"): (-1, -1)}]
    for table in ("deltas", "commits"):
        for n in (1, 2, 3):
            spark.read.parquet(f"{store}/{table}/batch={n}").write.parquet(f"{bare}/{table}/batch={n}")
    want = {("s", "en"): (1, 4), (None, None): (1, 1)}
    assert groups(rollups.totals(spark, store)) == groups(rollups.totals(spark, bare)) == want


def test_a_batch_without_its_mark_does_not_count(spark, tmp_path):
    store, count = str(tmp_path / "store"), [rollups.word_counter("w")]
    assert rollups.totals(spark, store).isEmpty()
    one = spark.createDataFrame([(1, False, "a b", "s", "en")], CHANGE)
    rollups.commit_batch(spark, store, 1, one, count)
    spark.read.parquet(f"{store}/deltas/batch=1").withColumn("n_tokens", F.lit(99).cast("long")).write.parquet(f"{store}/deltas/batch=2")
    assert groups(rollups.totals(spark, store)) == {("s", "en"): (1, 2)}
    rollups.commit_batch(spark, store, 2, one.withColumn("text", F.lit("a")), count)
    assert groups(rollups.totals(spark, store)) == {("s", "en"): (1, 1)}
