"""Inputs that must lose nothing: mixed import folders, odd JSON, long streams, special characters, repeated keys, old streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from calltrail.functions.base import overlay_numbers
from calltrail.functions.messages import canonical_inputs, canonical_output, parse_messages
from calltrail.functions.pii import _mask_json, mask_pii_json
from calltrail.operators import analytics as A
from calltrail.operators import filters as B
from calltrail.operators import traces as T
from calltrail.plans.views import requests
from calltrail.sources import calls as S
from calltrail.sources import imports as I
from calltrail.sources.changes import insert_if_absent
from calltrail.sources.exports import finetuning_lines
from calltrail.sources.tables import load_table, write_requests
from calltrail.streaming import jobs as J
from conftest import one


def _lines(*ids):
    return "".join(json.dumps({"id": i, "model": "m"}) + "\n" for i in ids)


def test_import_of_a_mixed_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "part-0.jsonl").write_text(_lines("a1", "a2", "a3"))
    with gzip.open(folder / "z.jsonl.gz", "wt") as f:
        f.write(_lines("b1", "b2", "b3"))
    (folder / "one.ndjson").write_text(_lines("c1", "c2", "c3"))
    (folder / "list.json").write_text(json.dumps([{"id": "d1"}, {"id": "d2"}], indent=1))
    (folder / "object.json").write_text(json.dumps({"id": "e1", "model": "m"}, indent=1))
    (folder / "lines.json").write_text(_lines("f1", "f2"))
    (folder / "broken.json").write_text('{"id":"g1"} trailing')
    got, rejects = I.import_logs(spark, str(folder))
    assert sorted(r["id"] for r in got.collect()) == ["a1", "a2", "a3", "b1", "b2", "b3", "c1", "c2", "c3", "d1", "d2", "e1", "f1", "f2"]
    assert [r["reason"] for r in rejects.collect()] == ["not a JSON object"]
    (tmp_path / "single.jsonl").write_text(_lines("x", "y"))
    assert I.import_logs(spark, str(tmp_path / "single.jsonl"))[0].count() == 2
    assert I.import_logs(spark, str(folder / "lines.json"), lines=True)[0].count() == 2


def test_second_import_makes_new_ids(spark, tmp_path):
    path = tmp_path / "noid.jsonl"
    path.write_text('{"model":"m"}\n{"model":"m"}\n')
    first, _ = I.import_logs(spark, str(path))
    again, rejects = I.import_logs(spark, str(path), existing=first)
    assert again.count() == 2 and rejects.count() == 0
    known = I.import_logs(spark, str(path), import_id="one")[0]
    assert I.import_logs(spark, str(path), existing=known, import_id="one")[1].count() == 2


@pytest.mark.parametrize("doc", [
    '{"score":4,"extra":{"a":1,"bleu":0.2}}', '{"extra":{"bleu":0.2,"a":1},"bleu":0.1}', '{"bleu":"0.5","z":[1,{"bleu":2}]}', '{}', '{"bleu":null}'])
def test_overlay_keeps_all_else(spark, doc):
    got = json.loads(one(spark, overlay_numbers(F.lit(doc), F.lit('{"bleu":0.9}'), ["bleu"])))
    assert got == json.loads(doc) | {"bleu": 0.9}


@pytest.mark.parametrize("doc", ["[1]", "nope", "", None, "3"])
def test_overlay_of_no_object(spark, doc):
    assert one(spark, overlay_numbers(F.lit(doc).cast("string"), F.lit('{"bleu":0.9}'), ["bleu"])) == '{"bleu":0.9}'


def test_odd_elements_leave_messages(spark):
    doc = '[{"role":"user","content":"how to exploit"}, 5, null, "x", {"role":"user","content":[{"type":"text"}]}, {"content":7}]'
    got = [(m["role"], m["content"]) for m in one(spark, parse_messages(F.lit(doc)))]
    assert got == [("user", "how to exploit"), ("user", '[{"type":"text"}]'), (None, "7")]
    calls = spark.createDataFrame([("a", json.dumps({"messages": json.loads(doc)}), None), ("b", '{"messages":[{"role":"user","content":"fine"},5]}', None)], "id string, request string, created_at timestamp")
    passed, blocked = S.drop_blocked(calls)
    assert [r["id"] for r in passed.collect()] == ["b"] and [r["id"] for r in blocked.collect()] == ["a"]


@pytest.mark.parametrize("term,hits", [("C:\\dir", {0}), ("dir\\", {0}), ("\\", {0}), ("É", {2}), ("é", {3}), ("a%z", {1}), ("A_Z", {4}), ("c:\\DIR", {0})])
def test_search_terms(spark, term, hits):
    texts = ["see C:\\dir\\x", "abcz", "É here", "é there", "a.z", "dir%x"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r["n"] for r in df.filter(B.contains_folded("t", term)).collect()}
    assert got == hits | ({4} if term == "a%z" else set())


def test_masking_of_odd_json(spark):
    deep = "[" * 5000 + '"a@b.com"' + "]" * 5000
    assert one(spark, mask_pii_json(F.lit(deep))) == deep.replace("a@b.com", "[EMAIL_REDACTED]")
    assert _mask_json('{"n": 1e400, "k@b.com": 1E5, "x": "a@b.com", "y": ["\\u00e9 a@b.com", 0.10]}') == '{"n":1e400,"k@b.com":1E5,"x":"[EMAIL_REDACTED]","y":["é [EMAIL_REDACTED]",0.10]}'
    assert _mask_json('{"n": NaN, "x": "a@b.com"}') == '{"n": NaN, "x": "[EMAIL_REDACTED]"}'


def test_repeated_keys_are_reported(spark):
    base = spark.createDataFrame([("k0", 1)], "id string, v int")
    new = spark.createDataFrame([("k0", 5), ("k1", 1), ("k1", 2), ("k1", 1), ("k2", 3), ("k2", 3)], "id string, v int")
    for order in (None, "v"):
        out, rejects = insert_if_absent(base, new, "id", order)
        assert sorted(map(tuple, out.collect())) == [("k0", 1), ("k1", 1), ("k2", 3)]
        assert sorted((r["id"], r["v"], r["reason"]) for r in rejects.collect()) == [("k0", 5, "key exists"), ("k1", 1, "repeated key"), ("k1", 2, "repeated key"), ("k2", 3, "repeated key")]


def test_stream_with_sparse_numbers(spark):
    rows = [("s", 5000 * i, json.dumps({"choices": [{"delta": {"content": f"w{i} "}}]})) for i in range(1100)]
    got = S.assemble_stream_chunks(spark.createDataFrame(rows, "request_id string, seq long, data string")).first()
    assert got["content"] == "".join(f"w{i} " for i in range(1100)) and got["parts"] == 1100


def test_reports_open_only_their_days(spark, folder, tmp_path):
    log = requests(spark, folder)
    write_requests(log, str(tmp_path / "log"))
    stored = load_table(spark, str(tmp_path / "log"))
    span = ("2024-01-03 00:00:00", "2024-01-03 23:59:59")
    for report in (A.model_usage, A.error_trend, A.overview, A.user_stats, A.token_usage):
        got = report(stored, *span)
        assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, report(log, *span).collect()))
    sessions = T.trace_sessions(stored, *span)
    assert "PartitionFilters: [isnotnull(day" in sessions._jdf.queryExecution().executedPlan().toString()
    assert list(map(str, sessions.collect())) == list(map(str, T.trace_sessions(log, *span).collect()))
    assert B.filter_requests(stored, start=span[0], end=span[1]).count() == B.filter_requests(log, start=span[0], end=span[1]).count()


def test_sink_reads_few_folders(spark, tmp_path):
    sink = str(tmp_path / "sink")
    write = J._versions(sink, ["k"], snapshot_every=4)
    for b in range(11):
        write(spark.createDataFrame([(b % 3, b), (100 + b, b)], "k long, v long"), b)
    assert len(J.version_folders(spark, sink)) == 3
    got = {r["k"]: r["v"] for r in J.latest(spark, sink, ["k"]).collect()}
    assert got == {0: 9, 1: 10, 2: 8} | {100 + b: b for b in range(11)}
    write(spark.createDataFrame([(1, 10), (110, 10)], "k long, v long"), 10)  # a replay changes nothing
    assert {r["k"]: r["v"] for r in J.latest(spark, sink, ["k"]).collect()} == got


def test_page_after_refuses_more_than_a_page(spark, folder):
    with pytest.raises(ValueError):
        B.page_after(requests(spark, folder), None, None, limit=501)


def test_import_takes_names_in_any_case(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, name in enumerate(["a.Jsonl", "b.JSONL", "c.nDjson"]):
        (folder / name).write_text(_lines(f"{k}x", f"{k}y"))
    with gzip.open(folder / "d.jsonl.GZ", "wt") as f:
        f.write(_lines("3x"))
    (folder / "e.JSON").write_text(json.dumps([{"id": "4x"}]))
    names = {r["value"] for r in I.read_records(spark, str(folder)).collect()}
    assert {f'"{k}x"' for k in (0, 1, 2, 4)} <= {json.dumps(json.loads(v)["id"]) for v in names if v.startswith("{")}


def test_import_keeps_documents_with_repeated_keys(spark):
    value = '{"id":"r1","input_messages":[{"role":"user","role":"user","content":"x"}],"output_message":{"role":"a","content":1,"content":"y"},"metadata":{"k":1,"k":2}}'
    got, rejects = I.import_records(spark.createDataFrame([(0, value)], "seq long, value string"))
    row = got.first()
    assert rejects.count() == 0
    assert json.loads(row["input_messages"]) == [{"role": "user", "content": "x"}]
    assert json.loads(row["output_message"]) == {"role": "a", "content": "y"}
    assert json.loads(row["metadata"]) == {"k": 2, "imported": True}


def test_metadata_survives_export_and_import(spark):
    for first in ('{"imported":false,"k":1}', '{"k":1}', '{"imported":true}', '{"imported":1,"imported":2,"k":{"imported":3}}', '{}', '{"imported":0,"n":{"a":1,"a":2}}'):
        text, want = first, {**json.loads(first), "imported": True}
        for _ in range(3):
            records = spark.createDataFrame([(0, json.dumps({"id": "m"})[:-1] + ',"metadata":' + text + "}")], "seq long, value string")
            text = I.import_records(records)[0].first()["metadata"]
            assert json.loads(text) == want


@pytest.mark.parametrize("request_", [
    '{"messages":[{"role":"user","role":"user","content":"a jailbreak"}]}',
    '{"messages":[{"role":"user","content":"fine"},"x",{"role":"user","content":"fine","content":"a jailbreak"}]}',
    '{"messages":[{"role":"user","content":"fine"}],"messages":[{"role":"user","content":"a jailbreak"}]}',
    '{"messages":[{"role":"user","content":"a jailbreak","extra":{"a":1,"a":2}}]}'])
def test_repeated_keys_are_no_way_round_the_guardrail(spark, request_):
    calls = spark.createDataFrame([("c1", request_, None)], "id string, request string, created_at timestamp")
    passed, blocked = S.drop_blocked(calls)
    assert passed.count() == 0 and blocked.first()["keyword"] == "jailbreak"


def test_repeated_keys_in_messages(spark):
    doc = '[{"role":"a","role":"u","content":"x"},3,null,"s",{"content":"y","role":"v","z":{"q":1,"q":2}}]'
    assert [tuple(m) for m in one(spark, parse_messages(F.lit(doc)))] == [("u", "x"), ("v", "y")]
    assert one(spark, parse_messages(F.lit(doc + " x"))) == [] and one(spark, parse_messages(F.lit(doc[:-1]))) == []
    assert [tuple(m) for m in one(spark, canonical_inputs(F.lit(doc), F.lit(None)))] == [("u", "x"), ("v", "y")]
    assert json.loads(one(spark, canonical_inputs(F.lit('{"a":1,"a":2}'), F.lit(None)))[0]["content"]) == {"a": 2}
    assert tuple(one(spark, canonical_output(F.lit('{"role":"a","content":"x","content":"y"}'), F.lit(None)))) == ("a", "y")


@pytest.mark.parametrize("doc", ['{"bleu":1,"bleu":2,"k":3}', '{"k":1,"k":3}', '{"k":3,"deep":{"a":1,"a":2}}', '{"k":3,"bleu":1,"deep":[{"a":1,"a":2}]}'])
def test_overlay_of_repeated_keys(spark, doc):
    got = json.loads(one(spark, overlay_numbers(F.lit(doc), F.lit('{"bleu":0.9}'), ["bleu"])))
    assert got == {**json.loads(doc), "bleu": 0.9}
    assert json.loads(one(spark, overlay_numbers(F.lit(doc), F.lit("{}"), ["x"]))) == json.loads(doc)


def test_fine_tuning_lines_keep_answers_with_repeated_keys(spark):
    rows = requests(spark, "/root/testdata/sf0.001").limit(1).withColumns({
        "input_messages": F.lit('[{"role":"user","content":"q"}]'), "output_message": F.lit('{"role":"a","content":"x","content":"y"}')})
    assert json.loads(finetuning_lines(rows).first()["value"])["messages"][1] == {"role": "a", "content": "y"}
