"""Files and streams: write, read back, compare."""

import csv
import glob
import json
from datetime import datetime

from pyspark.sql import functions as F

from calltrail.operators import traces as T
from calltrail.operators.analytics import daily_stats, write_daily_stats
from calltrail.operators.conversations import conversation_rollup
from calltrail.plans.views import models, requests
from calltrail.sources import calls as S
from calltrail.sources import exports as X
from calltrail.sources import imports as I
from calltrail.sources.tables import conform_requests, load_table, write_requests
from calltrail.streaming import jobs as J


def _text(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_csv_round_trip(spark, folder, tmp_path):
    log = requests(spark, folder)
    X.export_csv(log, str(tmp_path), status="error")
    head = _text(tmp_path / "header").strip().split(",")
    rows = list(csv.DictReader(_text(tmp_path / "rows").splitlines(), fieldnames=head))
    want = log.filter("status = 'error'").orderBy(F.col("created_at").desc(), F.col("id").desc()).collect()
    assert tuple(head) == X.CSV_COLUMNS and [r["id"] for r in rows] == [w["id"] for w in want]
    assert all(r["error_message"] == w["error_message"] and float(r["estimated_cost"]) == w["estimated_cost"] for r, w in zip(rows, want))


def test_csv_quoting(spark):
    df = conform_requests(spark.createDataFrame([("a,b", 'say "hi"', "two\nlines", datetime(2024, 1, 1))], "id string, model string, error_message string, created_at timestamp"))
    line = X.csv_lines(df).first()["value"]
    assert line.startswith('"a,b","say ""hi""",deepinfra,success,0,0,0,0,0,,,,0,"two\nlines",,,,2024-01-01T00:00:00.000Z')


def test_finetuning(spark, tmp_path):
    rows = [("1", '[{"role":"user","content":"hé"}]', '{"role":"assistant","content":"y"}', "success"), ("2", "[]", '{"content":"y"}', "success"),
            ("3", '{"role":"user"}', '{"content":"y"}', "success"), ("4", '[{"a":1.50}]', None, "success"), ("5", "[1", '{"c":1}', "success"),
            ("6", '[{"role":"user","content":"z"}]', '{"content":"e"}', "error")]
    df = conform_requests(spark.createDataFrame(rows, "id string, input_messages string, output_message string, status string"))
    X.export_finetuning(df, str(tmp_path / "out"))
    lines = [json.loads(x) for x in _text(tmp_path / "out").splitlines()]
    assert lines == [{"messages": [{"role": "user", "content": "hé"}, {"role": "assistant", "content": "y"}]}]


def test_import_files(spark, tmp_path):
    records = [{"id": "a", "prompt_tokens": 3, "completion_tokens": "4", "cost": 0.5, "tags": "bad", "metadata": "nope"},
               {"id": "a", "model": "later"}, {"model": "m", "input_messages": [{"role": "user", "content": "x"}], "stream": True}, {"id": "old"}]
    (tmp_path / "l.jsonl").write_text("\n\n".join(json.dumps(r) for r in records) + "\n[1]\n{oops\n")
    (tmp_path / "l.json").write_text(json.dumps(records, indent=2))
    (tmp_path / "one.json").write_text(json.dumps(records[0]))
    existing = spark.createDataFrame([("old",)], "id string")
    for name, bad in (("l.jsonl", 2), ("l.json", 0)):
        rows, rejects = I.import_logs(spark, str(tmp_path / name), existing)
        got = {r["id"]: r for r in rows.collect()}
        assert len(got) == 2 and got["a"]["total_tokens"] == 7 and got["a"]["estimated_cost"] == 0.5 and got["a"]["model"] == "unknown"
        assert got["a"]["tags"] == '["imported"]' and got["a"]["metadata"] == '{"imported":true}' and got["a"]["span_name"] == "Imported - unknown"
        other = next(r for i, r in got.items() if i != "a")
        assert other["stream"] is True and other["span_id"] == other["id"] and len(other["id"]) == 36
        reasons = sorted(r["reason"] for r in rejects.collect())
        assert reasons == sorted(["duplicate id", "id exists"] + ["not a JSON object"] * bad)
    assert I.import_logs(spark, str(tmp_path / "one.json"))[0].count() == 1


def _call(spark, **kw):
    base = {"id": "c", "request": None, "response": None, "headers": {}, "http_status": 200, "latency_ms": 5, "transport_error": None,
            "stream": False, "created_at": datetime(2024, 1, 1)}
    base.update(kw)
    from calltrail.schema import CALLS
    return spark.createDataFrame([tuple(base[f.name] for f in CALLS)], CALLS)


def test_call_rules(spark):
    prices = models(spark)

    def norm(chunks=None, **kw):
        return S.normalize_calls(_call(spark, **kw), prices, chunks=chunks).first()

    r = norm(request='{"model":"deepseek-ai/DeepSeek-V3","messages":[],"trace_id":"body"}', headers={"X-Trace-Id": "head", "X-User-Id": "u", "x-span-status": "paused"},
             response='{"usage":{"prompt_tokens":1000,"completion_tokens":500},"choices":[{"message":{"role":"assistant","content":"x"}}]}')
    assert r["estimated_cost"] == 0.000935 and r["trace_id"] == "body" and r["user_id"] == "u" and r["status"] == "paused"
    assert r["span_name"] == "Deepinfra - deepseek-ai/DeepSeek-V3" and r["span_type"] == "llm" and r["total_tokens"] == 1500
    r = norm(request='{"messages":[{"role":"user","content":"hello"}]}', response='{"model":"served","choices":[{"message":{"role":"assistant","content":"ok"}}],"usage":{"estimated_cost":0.25}}')
    assert (r["model"], r["prompt_tokens"], r["completion_tokens"], r["estimated_cost"], r["span_name"]) == ("served", 3, 1, 0.25, None)
    assert norm(request="{}", response='{"error":"plain"}', http_status=500)["error_message"] == "plain"
    assert norm(request="{}", response="{}", http_status=404)["error_message"] == "HTTP 404"
    r = norm(request='{"model":"m"}', transport_error="boom", http_status=None)
    assert (r["status"], r["error_message"], r["total_tokens"], r["output_message"]) == ("error", "boom", 0, None)
    r = norm(request='{"model":"m"}', response='{"error":{"message":"busy"}}', http_status=429, stream=True, headers={"x-span-status": "paused"})
    assert (r["status"], r["error_message"], r["total_tokens"], r["stream"]) == ("error", "busy", 0, True)
    chunks = spark.createDataFrame([("c", 0, '{"choices":[{"delta":{"content":"he"}}]}'), ("c", 5000, '{"choices":[{"delta":{"content":"y"},"finish_reason":"stop"}]}'),
                                    ("c", 9999, "[DONE]")], "request_id string, seq long, data string")
    r = norm(chunks, request='{"model":"m","messages":[{"role":"user","content":"hello"}]}', stream=True)
    assert json.loads(r["output_message"]) == {"role": "assistant", "content": "hey"} and (r["prompt_tokens"], r["completion_tokens"]) == (3, 1)
    assert json.loads(r["raw_response"])["finish_reason"] == "stop"
    hidden = S.normalize_calls(_call(spark, request='{"model":"m","messages":[{"role":"user","content":"secret"}]}', response="{}"), prices, log_payloads=False).first()
    assert "secret" not in str(hidden.asDict())
    masked = S.normalize_calls(_call(spark, request='{"model":"m","messages":[{"role":"user","content":"a@b.com"}]}', response="{}"), prices, mask=True).first()
    assert "a@b.com" not in str(masked.asDict()) and "[EMAIL_REDACTED]" in masked["input_messages"]


def test_long_stream_in_parts(spark):
    rows = [("long", i, json.dumps({"choices": [{"delta": {"content": f"w{i} "}}]})) for i in range(100)]
    rows += [("long", 100, '{"usage":{"prompt_tokens":3}}'), ("short", 7, '{"choices":[{"delta":{"content":"x"},"finish_reason":"stop"}]}'), ("short", 8, "junk")]
    chunks = spark.createDataFrame(rows, "request_id string, seq long, data string").repartition(5)
    text = "".join(f"w{i} " for i in range(100))
    assert {r["request_id"]: r["content"] for r in S.assemble_stream_chunks(chunks, block=8).collect()} == {"long": text, "short": "x"}
    got = {r["request_id"]: r for r in S.assemble_stream_chunks(chunks, block=8).collect()}
    assert got["long"]["content"] == text and got["long"]["parts"] == 13 and tuple(got["long"]["usage"]) == (3, 0, 0)
    assert got["short"]["content"] == "x" and got["short"]["finish_reason"] == "stop" and got["short"]["usage"] is None
    parts = S.stream_parts(chunks, block=8).filter("request_id = 'long'").orderBy("part").collect()
    assert len(parts) == 13 and "".join(p["content"] for p in parts) == text


def test_requests_by_day(spark, folder, tmp_path):
    log = requests(spark, folder)
    write_requests(log, str(tmp_path / "log"))
    back = load_table(spark, str(tmp_path / "log"))
    assert sorted(map(tuple, back.select(*log.columns).collect())) == sorted(map(tuple, log.collect()))
    text = back.filter("day = '2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in text


def test_daily_stats_overwrites_only_its_dates(spark, folder, tmp_path):
    log = requests(spark, folder)
    path = str(tmp_path / "daily")
    write_daily_stats(log, path)
    write_daily_stats(log.filter("to_date(created_at) = '2024-01-03'").withColumn("total_tokens", F.lit(0).cast("long")), path)
    back = spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))
    assert back.count() == daily_stats(log).count()
    assert back.filter("date = '2024-01-03'").agg(F.sum("total_tokens")).first()[0] == 0
    assert back.filter("date = '2024-01-04'").agg(F.sum("total_tokens")).first()[0] > 0


def _in_batches(spark, log, tmp_path):
    """The log as three files, read one file per micro-batch."""
    source = str(tmp_path / "in")
    for part in range(3):
        log.filter((F.crc32("id") % 3) == part).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)


def test_stream_rollup_over_batches(spark, folder, tmp_path):
    log = requests(spark, folder)
    stream = _in_batches(spark, log, tmp_path)
    sink = str(tmp_path / "sink")
    J.run_available(J.stream_conversation_stats(stream, sink, str(tmp_path / "state")))
    assert len(glob.glob(f"{sink}/batch=*")) >= 3
    rounded = F.round("total_cost", 6)
    want = conversation_rollup(log).withColumn("total_cost", rounded)
    got = J.latest(spark, sink, ["id"]).withColumn("total_cost", rounded)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    J.compact(spark, sink, str(tmp_path / "packed"), ["id"])
    assert J.latest(spark, str(tmp_path / "packed"), ["id"]).count() == want.count()


def test_stream_agents_over_batches(spark, folder, tmp_path):
    log = requests(spark, folder)
    sink = str(tmp_path / "sink")
    J.run_available(J.stream_agent_metrics(_in_batches(spark, log, tmp_path), sink, str(tmp_path / "state")))
    want = T.agent_metrics(log)
    got = J.latest(spark, sink, ["trace_id"]).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_queue_names_each_request_once(spark, folder, tmp_path):
    log = requests(spark, folder)
    twice = log.unionByName(log)
    for mark in (None, "60 days"):
        base = tmp_path / f"w{mark is not None}"
        rows = J.stream_eval_queue(_in_batches(spark, twice, base), mark)
        J.run_available(J.write_append(rows, str(base / "sink"), str(base / "state")))
        got = [r["id"] for r in spark.read.parquet(str(base / "sink")).select("id").collect()]
        assert len(got) == len(set(got)) > 0


def test_stream_buckets_append_with_watermark(spark, folder, tmp_path):
    rows = J.stream_buckets(_in_batches(spark, requests(spark, folder), tmp_path), "daily", watermark="40 days")
    J.run_available(J.write_append(rows, str(tmp_path / "sink"), str(tmp_path / "state")))
    assert "bucket" in spark.read.schema(rows.schema).parquet(str(tmp_path / "sink")).columns
