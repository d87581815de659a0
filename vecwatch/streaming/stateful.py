"""Keyed state over streams: batches that time out, and watch-list entries that take their patches as they arrive.

Both run on Spark's arbitrary state with timers. Batches or entries of one hash bucket share a key, so that a micro-batch costs a call into Python and two of
the state store per bucket, not per batch or entry. The state store has to be the one that keeps its state on disk; `use_disk_state` sets it. A checkpoint
belongs to the number of buckets it was made with.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C

BUCKETS = 256  # keys of the state: batches or entries by the hash of their id
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _bucket(name: str):
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int").alias("bucket")


# --- timeouts ---------------------------------------------------------------------
TIMED_OUT = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("error_message", T.StringType()), T.StructField("deadline", T.TimestampType())])
_OPEN = T.StructType([T.StructField("timer_ms", T.LongType()), T.StructField("batches", T.StringType())])


def _millis(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64") // 1000).tolist()


class _Timeouts(StatefulProcessor):
    """One deadline per batch. What has ended stays known for as long again as the timeout, so that repeated messages open nothing; then its state is dropped.

    A bucket holds {batch: [deadline, ended]} as JSON and one timer, at its earliest deadline or before.
    """

    def __init__(self, seconds: int, opened: str, status: str, text: str, time_mode: str):
        self.span, self.opened, self.status, self.text, self.time_mode = seconds * 1000, opened, status, text, time_mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("batches", _OPEN)

    def _load(self) -> tuple[int | None, dict]:
        state = self.state.get() if self.state.exists() else None
        return (None, {}) if state is None else (state[0], json.loads(state[1]))

    def _keep(self, timer: int | None, held: dict) -> None:
        if not held:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.state.clear()
            return
        first = min(deadline for deadline, _ in held.values())
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.state.update((timer, json.dumps(held)))

    def _told(self, late: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if late:
            yield pd.DataFrame({"batch_id": [b for b, _ in late], "status": self.status, "error_message": self.text, "deadline": pd.to_datetime([d for _, d in late], unit="ms")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told, late = pd.concat(list(rows)), []
        timer, held = self._load()
        for batch, at, ends in sorted(zip(told["batch_id"].tolist(), _millis(told["at"]), (told["kind"] != self.opened).tolist())):
            deadline, ended = held.get(batch, (None, False))
            if ended:
                continue
            if not ends and deadline is None:
                held[batch] = [at + self.span, False]
            elif ends:
                if deadline is not None and at > deadline:  # the end came too late: the batch had timed out before
                    late.append((batch, deadline))
                held[batch] = [max(at, deadline or at) + self.span, True]
        self._keep(timer, held)
        yield from self._told(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, late = expiredTimerInfo.getExpiryTimeInMs(), []
        now = timerValues.getCurrentWatermarkInMs() if self.time_mode == "EventTime" else timerValues.getCurrentProcessingTimeInMs()
        timer, held = self._load()
        for batch, (deadline, ended) in list(held.items()):
            if deadline >= now and deadline > fired:
                continue
            if ended:
                del held[batch]
            else:
                late.append((batch, deadline))
                held[batch] = [deadline + self.span, True]
        self._keep(None if timer is not None and timer <= fired else timer, held)
        yield from self._told(late)

    def close(self) -> None:
        pass


def batch_timeouts(events: DataFrame, seconds: int = C.COMPUTE_TIMEOUT_SECONDS, *, late: str = "0 seconds", time_mode: str = "EventTime") -> DataFrame:
    """A stream of batches that stayed open for more than `seconds`: one row each (batch_id, status, error_message, deadline).

    `events` is a stream of (batch_id, kind, at): kind `opened` starts a batch, any other kind ends it. A batch that ends at its deadline or before never times out; one that ends
    later, or not at all, times out once. By event time a deadline passes with the watermark, `late` behind the newest event; by `ProcessingTime` it passes with the clock.
    """
    use_disk_state(events.sparkSession)
    rows = events.where(F.col("batch_id").isNotNull() & F.col("at").isNotNull()).select("batch_id", "kind", "at")
    if time_mode == "EventTime":
        rows = rows.withWatermark("at", late)
    rows = rows.withColumn("bucket", _bucket("batch_id"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Timeouts(seconds, "opened", C.BATCH_ERROR, "compute timeout", time_mode), TIMED_OUT, "Append", time_mode)


# --- entry patches ------------------------------------------------------------------
_FIELDS = ("name", "category", "description", "active", "match_threshold", "json_data")
_PATCH = "name string, category string, description string, active boolean, match_threshold double, json_data string"
ENTRY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("active", T.BooleanType()), T.StructField("match_threshold", T.DoubleType()), T.StructField("json_data", T.StringType()), T.StructField("blacklist_version", T.IntegerType())])
_HELD = T.StructType(ENTRY.fields[1:])
_BUCKET = T.StructType([T.StructField("entries", T.StringType())])


def _plain(value):
    return None if value is None or value is pd.NA or (isinstance(value, float) and value != value) else value


def patched(entry: dict, patch: dict, given: set[str]) -> dict:
    """An entry after one patch; `given` names the keys the patch has. A new threshold, or a switch back on, adds one version."""
    out = dict(entry)
    moved = "match_threshold" in given and patch["match_threshold"] != entry["match_threshold"]
    revived = bool(patch["active"]) and not entry["active"]
    for name in _FIELDS:
        if name in given and (patch[name] is not None or name not in ("name", "active")):
            out[name] = patch[name]
    out["blacklist_version"] = entry["blacklist_version"] + int(moved or revived)
    return out


class _Patches(StatefulProcessor):
    """The present entry per id; a patch of an unknown entry changes nothing. A bucket holds {id: fields} as JSON."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entries", _BUCKET)

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = self._load()
        for row in initialState.to_dict("records"):
            held.setdefault(row["entry_id"], _fields({n: _plain(row[n]) for n in _HELD.fieldNames()}))
        self.state.update((json.dumps(held),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._load(), []
        if not held:
            return
        told = pd.concat(list(rows)).sort_values(["entry_id", "seq"], kind="stable")
        for entry_id, patches in groupby(told.to_dict("records"), key=lambda row: row["entry_id"]):
            if entry_id not in held:
                continue
            entry = dict(zip(_HELD.fieldNames(), held[entry_id]))
            for row in patches:
                entry = patched(entry, {n: _plain(row[n]) for n in _FIELDS}, set(row["given"]))
            held[entry_id] = _fields(entry)
            out.append({"id": entry_id, **entry})
        if out:
            self.state.update((json.dumps(held),))
            yield pd.DataFrame(out, columns=ENTRY.fieldNames()).astype({"active": "boolean", "match_threshold": "Float64", "blacklist_version": "int32"})

    def close(self) -> None:
        pass


def _fields(entry: dict) -> list:
    """An entry's fields in order, as plain values."""
    return [entry["name"], entry["category"], entry["description"], None if entry["active"] is None else bool(entry["active"]),
            None if entry["match_threshold"] is None else float(entry["match_threshold"]), entry["json_data"], int(entry["blacklist_version"])]


def patched_entries(patches: DataFrame, entries: DataFrame) -> DataFrame:
    """A stream of entries after the patches of each micro-batch, in order of arrival (entry_id, seq, patch JSON).

    `entries` is the state at the stream's first start; later starts go on from the checkpoint. The rules are those of `apply_patches`; fields that no patch can
    change are not carried. A patch that is no JSON object gives no key and changes nothing.
    """
    use_disk_state(patches.sparkSession)
    body = F.from_json("patch", _PATCH)
    keys = F.coalesce(F.json_object_keys("patch"), F.array().cast("array<string>"))
    rows = patches.where(F.col("entry_id").isNotNull()).select("entry_id", "seq", keys.alias("given"), body.alias("b")).select("entry_id", "seq", "given", *[F.col(f"b.{n}").alias(n) for n in _FIELDS])
    rows = rows.withColumn("bucket", _bucket("entry_id"))
    start = entries.where(F.col("id").isNotNull()).select(_bucket("id"), F.col("id").alias("entry_id"), *_HELD.fieldNames())
    return rows.groupBy("bucket").transformWithStateInPandas(_Patches(), ENTRY, "Update", "None", initialState=start.groupBy("bucket"))
