"""A call that comes whole in one micro-batch makes no round trip to the state but one."""

import pandas as pd
import pytest

from calltrail.streaming.streamed_calls import OpenCalls


class NoState:
    """A state that holds nothing and takes nothing."""

    def get(self):
        return None

    def __getattr__(self, name):
        raise AssertionError(f"{name} of the state")


@pytest.mark.parametrize("batches", [1, 3])
def test_a_whole_call_passes_without_the_state(batches):
    rows = [{"call": None, "seq": k % 4, "data": "[DONE]" if k % 4 == 3 else f"w{k}", "at": 5} for k in range(6)] + [{"call": "{}", "seq": None, "data": None, "at": 5}]
    held = OpenCalls(10)
    held.progress, held.chunks, held.handle = NoState(), NoState(), NoState()
    parts = iter(pd.DataFrame(rows[k::batches]) for k in range(batches))
    out = pd.concat(held.handleInputRows(("c",), parts, None))
    assert set(out["request_id"]) == {"c"} and out["call"].dropna().tolist() == ["{}"]
    found = out[out["seq"].notna()]
    assert sorted(found["seq"]) == [0, 1, 2, 3] and found.set_index("seq")["data"].loc[3] == "[DONE]"
