"""Streams settled in event time: a wait gate, a quiet period and a barrier, with timers and a watermark.

Messages of a key may arrive in any order. They wait in the state of their key until the watermark has passed what
could still change their outcome; one timer a key wakes it then. So the rows that leave do not depend on how
messages were dealt to triggers, as long as none is later than the watermark allows. State is kept by Spark's
``transformWithState`` in its state store, a key a process; what waits is bounded by the watermark's delay.

Each input row has ``session``, ``at`` (timestamp, the event time), ``id`` (breaks ties of ``at``) and ``body`` (JSON).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.tables import shared_folder

MESSAGE = "session string, at timestamp, id long, body string"
_WAITING = "at long, id long, body string"


class Settled(StatefulProcessor):
    """Keeps what waits, in order, and wakes when the watermark has passed ``settle``'s wake time."""

    columns: list[str] = []

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.own = handle.getValueState("own", "state string")

    def settle(self, session: str, waiting: list[tuple], watermark: int, own: dict) -> tuple[list[tuple], list[tuple], int | None]:
        """(rows to send, what still waits, when to wake or None). Times are microseconds; ``own`` may be changed."""
        raise NotImplementedError

    def _run(self, key: tuple, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        if not key[0]:  # the end of a table, see ``with_end``
            return
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        own = json.loads(self.own.get()[0]) if self.own.exists() else {}
        out, left, wake = self.settle(key[0], sorted(held + new), 1000 * watermark, own)
        wake = wake if wake is None else -(-wake // 1000)  # timers count in milliseconds
        if left:
            self.waiting.put(left)
        elif held:
            self.waiting.clear()
        self.own.update((json.dumps(own),))
        armed = set(self.handle.listTimers())
        if wake is not None and wake not in armed:
            self.handle.registerTimer(wake)
        for t in armed - {wake}:
            if t > watermark:  # those not later have fired and are gone when this call ends
                self.handle.deleteTimer(t)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t.value // 1000), int(i), b) for frame in rows for t, i, b in zip(pd.to_datetime(frame["at"]), frame["id"], frame["body"], strict=True)]
        yield from self._run(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Gate(Settled):
    """Edits of regions: at once on a ready region, when it gets ready on a pending one, rejected on a failed or unknown one.

    Bodies: ``{"kind": detected | region | error | edit, "region": name, "names": [..]}``. ``detected`` lists the regions that are
    pending from then on and forgets all others and what waits for them ('dropped'); ``region`` makes one ready; ``error``
    fails all that are pending."""

    columns = ["session", "edit", "region", "outcome", "delay_ms"]
    schema = "session string, edit long, region string, outcome string, delay_ms long"

    def settle(self, session, waiting, watermark, own):
        out = []
        status, held = own.setdefault("status", {}), own.setdefault("held", {})
        due = [r for r in waiting if r[0] < watermark]

        def finish(region: str, outcome: str, at: int) -> None:
            out.extend((session, i, region, outcome, (at - asked) // 1000) for i, asked in held.pop(region, []))

        for at, i, body in due:
            m = json.loads(body)
            kind, region = m["kind"], m.get("region")
            if kind == "detected":
                for name in list(held):
                    finish(name, "dropped", at)
                status.clear()
                status.update(dict.fromkeys(m["names"], "pending"))
            elif kind == "region":
                status[region] = "ready"
                finish(region, "waited", at)
            elif kind == "error":
                for name in [n for n, s in status.items() if s == "pending"]:
                    status[name] = "failed"
                    finish(name, "rejected", at)
            elif status.get(region) == "ready":
                out.append((session, i, region, "at_once", 0))
            elif status.get(region) == "pending":
                held.setdefault(region, []).append((i, at))
            else:
                out.append((session, i, region, "rejected", 0))
        left = waiting[len(due) :]
        return out, left, left[0][0] + 1 if left else None


class Quiet(Settled):
    """The last message of each burst: one after which its key says nothing for ``quiet_ms``."""

    columns = ["session", "id", "burst"]
    schema = "session string, id long, burst long"

    def __init__(self, quiet_ms: int = 450):
        self.quiet_ms = quiet_ms

    def settle(self, session, waiting, watermark, own):
        out, burst = [], []
        for n, row in enumerate(waiting):
            burst.append(row)
            ends = row[0] + 1000 * self.quiet_ms
            if n + 1 < len(waiting) and waiting[n + 1][0] < ends:
                continue
            if ends > watermark:  # a message may still come in between
                return out, waiting[n + 1 - len(burst) :], ends
            out.append((session, row[1], len(burst)))
            burst = []
        return out, [], None


class Barrier(Settled):
    """Layout of a block once all its members are in, or, marked as incomplete, when ``grace_ms`` have passed since the last.

    Bodies: ``{"x": left, "y": top, "w": width, "n": members}``. Alignment is that of least variance among left edges, centres and
    right edges (in this order for ties), the line height the median distance of tops."""

    columns = ["session", "lines", "alignment", "line_height", "complete"]
    schema = "session string, lines long, alignment string, line_height double, complete boolean"

    def __init__(self, grace_ms: int = 60_000):
        self.grace_ms = grace_ms

    def settle(self, session, waiting, watermark, own):
        if not waiting:
            return [], [], None
        members = [json.loads(body) for _, _, body in waiting]
        complete, until = len(members) >= members[0]["n"], waiting[-1][0] + 1000 * self.grace_ms
        if not complete and until > watermark:
            return [], waiting, until
        return [(session, len(members), *layout(members), complete)], [], None


def layout(members: list[dict]) -> tuple[str, float | None]:
    def spread(values: list[float]) -> float:
        mean = sum(values) / len(values)
        return round(sum((v - mean) ** 2 for v in values) / len(values), 9)

    tops = sorted(m["y"] for m in members)
    steps = sorted(b - a for a, b in zip(tops[:-1], tops[1:], strict=True))
    if not steps:
        return "left", None
    edges = {"left": [m["x"] for m in members], "center": [m["x"] + m["w"] / 2 for m in members], "right": [m["x"] + m["w"] for m in members]}
    return min(edges, key=lambda k: spread(edges[k])), float((steps[(len(steps) - 1) // 2] + steps[len(steps) // 2]) / 2)


def settled(messages: DataFrame, processor: Settled, delay: str) -> DataFrame:
    """The rows of ``processor`` over a stream of messages of which none is more than ``delay`` late (append mode)."""
    keyed = messages.select("session", "at", "id", "body").withWatermark("at", delay).groupBy("session")
    return keyed.transformWithStateInPandas(processor, processor.schema, "Append", "EventTime")


def run_stream(spark: SparkSession, source: DataFrame, write_to: str | None = None) -> DataFrame:
    """Runs a stream over what its source holds now and gives back the table it wrote. Output and checkpoints are in the
    shared folder, so the query goes on from there if it is started again."""
    folder = write_to or f"{shared_folder(spark)}/inkgrid-streams/{uuid.uuid4().hex}"
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = source.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    return spark.read.schema(source.schema).parquet(f"{folder}/rows")


def with_end(messages: DataFrame) -> DataFrame:
    """Adds a message of no session far in the future: with it the watermark passes all others."""
    last = messages.agg((F.max("at") + F.expr("INTERVAL 10000 DAYS")).alias("at")).filter("at IS NOT NULL")
    return messages.unionByName(last.select(F.lit("").alias("session"), "at", F.lit(0).cast("long").alias("id"), F.lit('{"kind": "end", "n": 0}').alias("body")))


def stream_table(messages: DataFrame, processor: Settled, delay: str) -> DataFrame:
    """What ``processor`` sends over a finished table of messages, read as a stream to its end. Rows without session are left out."""
    spark = messages.sparkSession
    folder = f"{shared_folder(spark)}/inkgrid-streams/{uuid.uuid4().hex}"
    with_end(messages.filter("session IS NOT NULL AND session <> ''").select("session", "at", "id", "body")).write.parquet(f"{folder}/messages")
    source = spark.readStream.schema(MESSAGE).parquet(f"{folder}/messages")
    return run_stream(spark, settled(source, processor, delay), f"{folder}/run").filter("session <> ''")
