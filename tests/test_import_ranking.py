"""Ranking of imported records by id: no task holds the records of all its files, and the rejects are those of a plain count."""

import json
import random
import re

import pytest

import __spark_entry__ as entry
from calltrail.scale import BLOCK
from calltrail.sources import imports as I


@pytest.mark.parametrize("name", ["import_rejects", "import_logs"])
def test_tasks_that_read_files_keep_no_rows(spark, folder, name):
    lines = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: re.search(r"[A-Za-z]", x).start()
    lines = [x for x in lines if re.search(r"[A-Za-z]", x)]
    for at in (k for k, x in enumerate(lines) if "FileScan" in x):
        level = depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) < level:
                level = depth(line)
                if "Exchange" in line:
                    break
                assert not re.match(r"\W*(Sort|HashAggregate|ObjectHashAggregate|SortAggregate|Window|WindowGroupLimit) ", line)


def test_rejects_by_a_plain_count(spark):
    rng = random.Random(3)
    ids = ["hot"] * 6 + ["a", "b", "c", "d", "e", "f"]
    data = [(rng.randrange(4 * BLOCK), rng.choice(ids)) for _ in range(120)]
    data += [(7, "twice"), (7, "twice"), (3 * BLOCK, "twice"), (None, "nowhere"), (5, "nowhere"), (None, "alone"), (None, "a")]
    records = spark.createDataFrame([(s, json.dumps({"id": i, "model": f"m{s}"})) for s, i in data] + [(1, "no json")], "seq long, value string")
    stored = spark.createDataFrame([("hot",), ("hot",), ("b",), ("alone",), ("twice",), ("other",), (None,)], "id string")
    rows, rejects = I.import_records(records, stored)
    least = {}
    for s, i in data:
        if s is not None:
            least[i] = min(s, least.get(i, s))
    want = [(1, None, "not a JSON object")] + [(s, i, "duplicate id") for s, i in data if s is None or s > least[i]]
    # The taken record is the one without a position, if there is one.
    want += [(None if (None, i) in data else least[i], i, "id exists") for i in ("hot", "b", "alone", "twice")]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, rejects.collect()), key=key) == sorted(want, key=key)
    taken = {r["id"]: r["model"] for r in rows.collect()}
    assert taken == {i: "mNone" if (None, i) in data else f"m{least[i]}" for i in ("a", "c", "d", "e", "f", "nowhere")}
    # Without stored ids nothing else is refused.
    assert sorted(map(tuple, I.import_records(records)[1].collect()), key=key) == sorted((x for x in want if x[2] != "id exists"), key=key)
