"""Changes written into a stored table touch only the partitions that hold a changed id, once."""

import os

import pytest
from pyspark.sql import functions as F

from calltrail.plans.views import requests
from calltrail.sources import rewrites as W
from calltrail.sources.changes import merge_changes
from calltrail.sources.tables import load_table, write_requests

CHANGE = "id string, field string, value string, seq long"


@pytest.fixture
def store(spark, folder, tmp_path):
    path = str(tmp_path / "log")
    write_requests(requests(spark, folder), path)
    return path


def files(path):
    found = {}
    for base, _, names in os.walk(path):
        if "_changes" not in base:
            found |= {os.path.join(base, n): os.stat(os.path.join(base, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def rows(spark, path):
    return sorted(map(str, load_table(spark, path).collect()))


def test_other_files_stay_and_a_replay_changes_nothing(spark, store):
    one = load_table(spark, store).orderBy("created_at", "id").first()
    changes = spark.createDataFrame([(one["id"], "status", "reviewed", 1), (one["id"], "tags", '["a"]', 2), ("nobody", "status", "x", 3), (one["id"], "status", "", 4)], CHANGE)
    want, _ = merge_changes(load_table(spark, store), changes)
    want, before = sorted(map(str, want.collect())), files(store)
    rejects = W.apply_changes(spark, store, changes, "c1")
    assert sorted(r["reason"] for r in rejects.collect()) == ["status is required", "unknown id"]
    after = files(store)
    day = f"day={one['day']}"
    assert rows(spark, store) == want and len(before) > 3
    assert {k: v for k, v in before.items() if day not in k} == {k: v for k, v in after.items() if day not in k}
    assert {k for k in before if day in k}.isdisjoint(k for k in after if day in k)
    W.apply_changes(spark, store, changes.limit(0), "c1")
    assert files(store) == after
    W.apply_changes(spark, store, spark.createDataFrame([("nobody", "delete", None, 1)], CHANGE), "c2")
    assert files(store) == after


def test_a_day_that_loses_all_rows(spark, store):
    log = load_table(spark, store)
    day = log.agg(F.min("day")).first()[0]
    n, gone = log.count(), log.filter(F.col("day") == day)
    k = gone.count()
    W.apply_changes(spark, store, gone.select("id", F.lit("delete").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(1).cast("long").alias("seq")), "wipe")
    assert load_table(spark, store).count() == n - k and not os.path.exists(f"{store}/day={day}")


@pytest.mark.parametrize("mark", ["_staged", "_done"])
def test_goes_on_after_a_failure(spark, store, monkeypatch, mark):
    ids = [r["id"] for r in load_table(spark, store).orderBy("id").limit(40).collect()]
    changes = spark.createDataFrame([(i, "delete" if k % 3 == 0 else "status", "s", k) for k, i in enumerate(ids)], CHANGE)
    want = sorted(map(str, merge_changes(load_table(spark, store), changes)[0].collect()))
    real = W._mark

    def failing(session, path):
        if path.endswith(mark):
            raise OSError("lost")
        real(session, path)

    monkeypatch.setattr(W, "_mark", failing)
    with pytest.raises(OSError):
        W.apply_changes(spark, store, changes, "c")
    monkeypatch.setattr(W, "_mark", real)
    W.apply_changes(spark, store, changes, "c")
    assert rows(spark, store) == want


def test_partitions_by_day_and_batch_and_a_missing_day(spark, folder, tmp_path):
    path = str(tmp_path / "log")
    made = requests(spark, folder).withColumns({"day": F.when(F.col("id") > "req_3", F.to_date("created_at")), "batch": F.length("id") % 2})
    made.write.partitionBy("day", "batch").parquet(path)
    some = [r["id"] for r in made.filter("day IS NULL AND batch = 1").orderBy("id").limit(2).collect()]
    before = files(path)
    W.apply_changes(spark, path, spark.createDataFrame([(i, "status", "s", 1) for i in some], CHANGE), "c", ("day", "batch"))
    changed = {k for k in before if k not in files(path)}
    assert changed and all("__HIVE_DEFAULT_PARTITION__/batch=1" in k for k in changed)
    log = load_table(spark, path)
    assert log.count() == made.count() and log.filter("status = 's'").count() == 2


def test_one_id_holds_most_changes(spark, store):
    one = load_table(spark, store).first()["id"]
    changes = spark.range(200_000).select(F.lit(one).alias("id"), F.lit("status").alias("field"), F.concat(F.lit("s"), "id").alias("value"), F.col("id").alias("seq"))
    W.apply_changes(spark, store, changes, "hot")
    assert load_table(spark, store).filter(F.col("id") == one).first()["status"] == "s199999"
