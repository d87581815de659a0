"""State of batches and entries that share a hash bucket."""

import pandas as pd
import pytest

from vecwatch.streaming import stateful


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers, self.value = [], Value()

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Now:
    def __init__(self, at):
        self.at = at

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.at


def rows_of(*events):
    return iter([pd.DataFrame([(b, k, pd.Timestamp(at, unit="s")) for b, k, at in events], columns=["batch_id", "kind", "at"])])


def told(frames):
    return [tuple(r) for f in frames for r in f[["batch_id", "deadline"]].assign(deadline=lambda x: x["deadline"].astype("datetime64[s]").astype("int64")).itertuples(index=False)]


@pytest.fixture
def bucket():
    handle, made = Handle(), stateful._Timeouts(10, "opened", "error", "late", "EventTime")
    made.init(handle)
    return handle, made


def test_batches_of_a_bucket_keep_their_own_deadlines(bucket):
    handle, made = bucket
    assert told(made.handleInputRows((1,), rows_of(("b", "opened", 105), ("a", "opened", 100), ("c", "opened", 100), ("c", "ended", 110), ("d", "opened", 100), ("d", "ended", 111)), None)) == [("d", 110)]
    assert handle.timers == [110_000]  # one for the bucket
    handle.timers.clear()  # it fires
    assert told(made.handleExpiredTimer((1,), Now(112_000), Now(110_000))) == [("a", 110)]
    assert handle.timers == [115_000]
    assert told(made.handleInputRows((1,), rows_of(("a", "opened", 112), ("c", "opened", 112), ("b", "ended", 115)), None)) == []  # known as ended; b just in time
    handle.timers.clear()
    assert told(made.handleExpiredTimer((1,), Now(200_000), Now(115_000))) == []
    assert not handle.value.exists() and handle.timers == []


def test_a_deadline_at_the_watermark_is_not_passed(bucket):
    handle, made = bucket
    list(made.handleInputRows((1,), rows_of(("a", "opened", 100), ("b", "opened", 101)), None))
    handle.timers.clear()
    assert told(made.handleExpiredTimer((1,), Now(111_000), Now(110_000))) == [("a", 110)]
    assert handle.timers == [111_000]


def test_entries_of_a_bucket_take_their_own_patches():
    handle, made = Handle(), stateful._Patches()
    made.init(handle)
    entry = {"name": "n", "category": None, "description": None, "active": True, "match_threshold": float("nan"), "json_data": None, "blacklist_version": 1}
    made.handleInitialState((1,), pd.DataFrame([{"entry_id": e, **entry} for e in ("x", "y", "z")]), None)
    none = dict.fromkeys(stateful._FIELDS)
    patches = [("y", 2, {"match_threshold": 0.5}), ("x", 1, {"active": False}), ("y", 1, {"match_threshold": 0.25}), ("gone", 1, {"active": False})]
    rows = pd.DataFrame([{"entry_id": e, "seq": s, "given": list(p), **none, **p} for e, s, p in patches])
    (out,) = made.handleInputRows((1,), iter([rows]), None)
    assert {r["id"]: (r["active"], r["match_threshold"] if r["id"] == "y" else None, r["blacklist_version"]) for r in out.to_dict("records")} == {"x": (False, None, 1), "y": (True, 0.5, 3)}
    (out,) = made.handleInputRows((1,), iter([rows[rows["entry_id"] == "x"].assign(active=True)]), None)
    assert out.to_dict("records")[0]["blacklist_version"] == 2
