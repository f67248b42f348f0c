"""Chunks of streamed calls before, with and after their record give one row; broken streams wait, then are written."""

import json
import random

import pytest

from calltrail.sources import calls as S
from calltrail.streaming.jobs import run_available
from calltrail.streaming.streamed_calls import add_ranges, stream_ingest_streamed, written_calls

CALL = "id string, request string, response string, headers map<string,string>, http_status int, latency_ms long, transport_error string, stream boolean, created_at timestamp"
CHUNK = "request_id string, seq long, data string"
PRICES = "id string, input_cost_per_million double, output_cost_per_million double"


def call(i, stream=True, text="hi"):
    return {"id": i, "request": json.dumps({"model": "m", "messages": [{"role": "user", "content": text}]}), "response": None, "headers": {}, "http_status": 200,
            "latency_ms": 5, "transport_error": None, "stream": stream, "created_at": "2024-01-02T03:04:05.678901Z"}


def parts(i, words):
    rows = [{"request_id": i, "seq": k, "data": json.dumps({"choices": [{"delta": {"content": w}}]})} for k, w in enumerate(words)]
    return [*rows, {"request_id": i, "seq": len(words), "data": "[DONE]"}]


class Arrivals:
    """Two folders that a test adds files to, and the job that reads what is there."""

    def __init__(self, spark, base, **options):
        self.spark, self.base, self.options, self.n = spark, base, options, 0
        for name in ("calls", "chunks"):
            (base / name).mkdir()

    def come(self, calls=(), chunks=(), run=True):
        for name, rows in (("calls", calls), ("chunks", chunks)):
            if rows:
                (self.base / name / f"{self.n}.json").write_text("\n".join(map(json.dumps, rows)))
        self.n += 1
        if run:
            prices = self.spark.createDataFrame([("m", 1.0, 2.0)], PRICES)
            read = lambda name, schema: self.spark.readStream.schema(schema).json(str(self.base / name))
            run_available(stream_ingest_streamed(read("calls", CALL), read("chunks", CHUNK), prices, str(self.base / "sink"), str(self.base / "state"), **self.options))

    def rows(self):
        found = written_calls(self.spark, str(self.base / "sink"))
        return [] if found is None else sorted((r["id"], json.loads(r["output_message"])["content"] if r["output_message"] else None) for r in found.collect())

    def orphans(self):
        return sorted((r["request_id"], r["seq"]) for r in self.spark.read.parquet(str(self.base / "sink" / "orphans")).collect())


def test_chunks_before_with_and_after_the_record(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    before, together, after = (parts(i, ["x ", "y ", i]) for i in ("before", "with", "after"))
    a.come(calls=[call("after"), call("plain", stream=False)], chunks=before + after[2:])
    assert a.rows() == [("plain", None)]
    a.come(calls=[call("before"), call("with")], chunks=together + after[:1] + after[2:3])
    assert a.rows() == [("before", "x y before"), ("plain", None), ("with", "x y with")]
    a.come(chunks=after[1:2])
    want = [("after", "x y after"), ("before", "x y before"), ("plain", None), ("with", "x y with")]
    assert a.rows() == want and a.orphans() == []
    stamps = {str(r["created_at"]) for r in written_calls(spark, str(tmp_path / "sink")).collect()}
    assert stamps == {"2024-01-02 03:04:05.678901"}


def test_a_long_call_in_many_shuffled_batches(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    chunks = parts("long", [f"w{k} " for k in range(12_000)])
    random.Random(1).shuffle(chunks)
    a.come(chunks=chunks[:5000])
    a.come(calls=[call("long")], chunks=chunks[4000:9000])  # a thousand of them come again
    assert a.rows() == []
    a.come(chunks=chunks[9000:])
    assert a.rows() == [("long", "".join(f"w{k} " for k in range(12_000)))]


def test_broken_streams_are_written_after_some_time(spark, tmp_path):
    a = Arrivals(spark, tmp_path, patience_ms=1, clock_slack="0 seconds")
    a.come(calls=[call("broken"), call("silent")], chunks=parts("broken", ["half"])[:1] + parts("nobody", ["z"]))
    for n in range(3):  # later batches run the timers
        a.come(calls=[call(f"later{n}", stream=False)])
    assert [r for r in a.rows() if "later" not in r[0]] == [("broken", "half"), ("silent", None)]
    assert a.orphans() == [("nobody", 0), ("nobody", 1)]


def test_blocked_calls_are_left_out(spark, tmp_path):
    a = Arrivals(spark, tmp_path, banned="secret plan")
    a.come(calls=[call("bad", text="a secret plan"), call("good")], chunks=parts("bad", ["a"]) + parts("good", ["b"]))
    assert a.rows() == [("good", "b")]


def test_same_rows_as_the_batch_form(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    calls = [call(f"c{k}", stream=k % 3 > 0, text=f"t{k}") for k in range(12)]
    chunks = [c for k in range(12) if k % 3 for c in parts(f"c{k}", [f"{k}", " é", "\n"])]
    a.come(calls=calls[:6], chunks=chunks[::2])
    a.come(calls=calls[6:], chunks=chunks[1::2])
    (tmp_path / "all").mkdir()
    (tmp_path / "all" / "c.json").write_text("\n".join(map(json.dumps, calls)))
    whole = S.normalize_calls(spark.read.schema(CALL).json(str(tmp_path / "all")), spark.createDataFrame([("m", 1.0, 2.0)], PRICES),
                              chunks=spark.createDataFrame([tuple(c.values()) for c in chunks], CHUNK))
    got = written_calls(spark, str(tmp_path / "sink")).select(whole.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("seed", range(5))
def test_ranges(seed):
    rng = random.Random(seed)
    ranges, seen = [], set()
    for _ in range(30):
        some = [rng.randrange(40) for _ in range(rng.randrange(6))]
        ranges, fresh = add_ranges(ranges, some)
        assert set(fresh) == set(some) - seen
        seen |= set(some)
        assert {n for a, b in ranges for n in range(a, b + 1)} == seen
        assert all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
