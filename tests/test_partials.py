"""Rollups from partial aggregates of micro-batches: no state, any number of batches, equal to the batch form."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from calltrail.operators import analytics as A
from calltrail.operators.conversations import conversation_rollup
from calltrail.operators.traces import agent_metrics
from calltrail.plans.views import requests
from calltrail.streaming import partials as P


@pytest.fixture(scope="module")
def run(spark, folder, tmp_path_factory):
    """The log in 40 micro-batches, with a hot conversation and trace; (log, sinks, progress) of the three rollups."""
    base = tmp_path_factory.mktemp("partials")
    log = requests(spark, folder).withColumn("n", F.crc32("id") % 40)
    hot = F.crc32("id") % 3 == 0
    log = log.withColumns({"conversation_id": F.when(hot, "hot").otherwise(F.col("conversation_id")), "trace_id": F.when(hot, "hot").otherwise(F.col("trace_id")),
                           "latency_ms": F.when(F.col("n") != 3, F.col("latency_ms"))})
    log.repartition(40, "n").sortWithinPartitions("id").drop("n").write.option("maxRecordsPerFile", 40).parquet(str(base / "in"))
    log, progress, sinks = log.drop("n"), {}, {}
    per = -(-len(glob.glob(str(base / "in" / "*.parquet"))) // 40)
    for name, rollup in (("conversations", P.conversations()), ("agents", P.agents()), ("latencies", P.latencies())):
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", per).parquet(str(base / "in"))
        sinks[name] = str(base / name)
        query = P.stream_rollup(stream, rollup, sinks[name], str(base / f"{name}-state"), snapshot_every=7).trigger(availableNow=True).start()
        query.awaitTermination()
        progress[name] = list(query.recentProgress)
    return log, sinks, progress


def rows(df):
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(str, df.select(*rounded).collect()))


def test_nothing_is_kept_between_batches(run):
    _, sinks, progress = run
    for name, sink in sinks.items():
        assert len(glob.glob(f"{sink}/batch=*")) >= 20 and len(glob.glob(f"{sink}/snapshot=*")) >= 2
        assert all(not p["stateOperators"] for p in progress[name])


def test_conversations(spark, run):
    log, sinks, _ = run
    want = conversation_rollup(log)
    assert rows(P.current(spark, sinks["conversations"], P.conversations()).select(want.columns)) == rows(want)


def test_agents(spark, run):
    log, sinks, _ = run
    want = agent_metrics(log)
    assert rows(P.current_agent_metrics(spark, sinks["agents"]).select(want.columns)) == rows(want)


def test_percentiles_and_daily_figures(spark, run):
    log, sinks, _ = run
    histogram = P.current(spark, sinks["latencies"], P.latencies())
    assert rows(P.latency_stats_of(histogram)) == rows(A.latency_stats(log, "2000-01-01", "2100-01-01"))
    assert rows(P.latency_stats_of(histogram, "2024-01-05", "2024-01-09")) == rows(A.latency_stats(log, "2024-01-05 00:00:00", "2024-01-09 23:59:59.999999"))
    assert rows(P.daily_stats_from(histogram)) == rows(A.daily_stats(log))


def test_half_written_snapshot_and_replayed_batch(spark, run, folder):
    log, sinks, _ = run
    sink = sinks["conversations"]
    newest = max(int(p.rpartition("=")[2]) for p in glob.glob(f"{sink}/snapshot=*"))
    before = rows(P.current(spark, sink, P.conversations()))
    os.rename(f"{sink}/snapshot={newest}/_SUCCESS", f"{sink}/snapshot={newest}/_half")
    assert rows(P.current(spark, sink, P.conversations())) == before
    os.rename(f"{sink}/snapshot={newest}/_half", f"{sink}/snapshot={newest}/_SUCCESS")
    same = P.current(spark, sink, P.conversations(), below=newest)
    assert rows(same) == rows(spark.read.parquet(f"{sink}/snapshot={newest}").select(same.columns))


def test_before_the_first_batch(spark, tmp_path):
    assert P.current(spark, str(tmp_path / "none"), P.agents()).count() == 0
