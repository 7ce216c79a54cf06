"""Per-session region state from a message stream: merge by id, lifecycle, edits, waits, undo.

One pure function, ``Session.apply``, holds the rules; ``replay`` runs it over a finished table and
``stream`` over a Structured Streaming source, with the state kept between triggers. Messages of a
session are applied in the order of ``seq``; a batch may bring them in any order.

Message kinds: detected (a new list of pending regions), region (one enriched region), progress, result
(all regions, authoritative, merged one by one), error (pending regions fail), edit, style, undo, redo,
cancel. An edit on a pending region waits until it is ready; on a failed one it is rejected.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import written

MESSAGE = "session string, seq long, kind string, region string, payload string"
STATE = "session string, region string, status string, text string, dx double, dy double, style string, overridden boolean"
_STYLE = ("font_family", "font_weight", "font_size", "letter_spacing", "text_color", "alignment")
DEPTH = 5


def merged(current: dict, incoming: dict) -> dict:
    """What arrives wins, but for what the user has set: text, offsets and, if overridden, the style."""
    out = {**incoming, **{k: current[k] for k in ("text", "dx", "dy", "overridden") if k in current}, "status": "ready"}
    if current.get("overridden"):
        out = {k: v for k, v in out.items() if k not in _STYLE} | {k: current[k] for k in _STYLE if k in current}
    return out


@dataclass
class Session:
    regions: dict[str, dict] = field(default_factory=dict)
    waiting: dict[str, list[dict]] = field(default_factory=dict)
    edits: dict[str, dict] = field(default_factory=dict)
    done: list[dict] = field(default_factory=list)
    undone: list[dict] = field(default_factory=list)
    progress: int = 0
    finished: bool = False
    rejected: int = 0

    def apply(self, kind: str, region: str | None, payload: dict) -> None:
        handler = getattr(self, f"_on_{kind}", None)
        if handler is None:
            raise ValueError(f"unknown message {kind!r}")
        handler(region, payload)

    def _on_detected(self, _, payload: dict) -> None:
        self.__init__()
        for r in payload.get("regions", []):
            self.regions[r["id"]] = {"dx": 0.0, "dy": 0.0, "overridden": False, **r, "status": "pending"}

    def _on_progress(self, _, payload: dict) -> None:
        self.progress = max(self.progress, int(payload.get("current", 0)))

    def _on_region(self, region: str, payload: dict) -> None:
        current = self.regions.get(region)
        self.regions[region] = merged(current, payload) if current else {"dx": 0.0, "dy": 0.0, "overridden": False, **payload, "status": "ready"}
        for edit in self.waiting.pop(region, []):
            self._commit(region, edit)

    def _on_result(self, _, payload: dict) -> None:
        for r in payload.get("regions", []):
            self._on_region(r["id"], r)
        self.finished = True

    def _on_error(self, *_) -> None:
        for name, r in self.regions.items():
            if r["status"] == "pending":
                r["status"] = "failed"
                self.rejected += len(self.waiting.pop(name, []))

    def _on_end(self, *_) -> None:
        """End of the stream: without a result it is an error, whatever the transport said."""
        if not self.finished:
            self._on_error()

    def _on_edit(self, region: str, payload: dict) -> None:
        status = self.regions.get(region, {}).get("status")
        if status == "ready":
            self._commit(region, payload)
        elif status == "pending":
            self.waiting.setdefault(region, []).append(payload)
        else:
            self.rejected += 1

    def _on_style(self, region: str, payload: dict) -> None:
        if region in self.regions:
            self._remember()
            self.regions[region].update({k: payload[k] for k in _STYLE if k in payload}, overridden=True)

    def _on_undo(self, *_) -> None:
        self._step(self.done, self.undone)

    def _on_redo(self, *_) -> None:
        self._step(self.undone, self.done)

    def _on_cancel(self, *_) -> None:
        self.__init__()

    def _snapshot(self) -> dict:
        return {"regions": json.loads(json.dumps(self.regions)), "edits": json.loads(json.dumps(self.edits))}

    def _remember(self) -> None:
        """A new edit ends what could be redone; the oldest of more than five is forgotten."""
        self.done = [*self.done, self._snapshot()][-DEPTH:]
        self.undone = []

    def _step(self, source: list[dict], target: list[dict]) -> None:
        if source:
            target.append(self._snapshot())
            del target[:-DEPTH]
            state = source.pop()
            self.regions, self.edits = state["regions"], state["edits"]

    def _commit(self, region: str, edit: dict) -> None:
        self._remember()
        self.edits[region] = {**self.edits.get(region, {}), **edit}
        self.regions[region].update({k: edit[k] for k in ("text", "dx", "dy") if k in edit})

    def rows(self, session: str) -> list[tuple]:
        return [(session, name, r["status"], r.get("text"), float(r.get("dx", 0)), float(r.get("dy", 0)), json.dumps({k: r[k] for k in _STYLE if k in r}, sort_keys=True), bool(r.get("overridden"))) for name, r in sorted(self.regions.items())]


_COLUMNS = ["session", "region", "status", "text", "dx", "dy", "style", "overridden"]


def _apply_all(state: Session, rows: pd.DataFrame) -> None:
    for m in rows.sort_values("seq").itertuples():
        state.apply(m.kind, m.region, json.loads(m.payload) if m.payload else {})


def replay(messages: DataFrame) -> DataFrame:
    """Final state of every session of a finished table."""

    def run(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = Session()
        _apply_all(state, rows)
        return pd.DataFrame(state.rows(names[0]), columns=_COLUMNS)

    return messages.groupBy("session").applyInPandas(run, STATE)


def stream(messages: DataFrame) -> DataFrame:
    """State of a session after each trigger that brings it messages (update mode)."""

    def run(names: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = Session(**json.loads(held.get[0])) if held.exists else Session()
        _apply_all(state, pd.concat(list(frames)))
        held.update((json.dumps(asdict(state)),))
        yield pd.DataFrame(state.rows(names[0]), columns=_COLUMNS)

    return messages.groupBy("session").applyInPandasWithState(run, STATE, "state string", "update", "NoTimeout")


# ---------------------------------------------------------------- relational parts


def latest_edits(edits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last edit of each region: replaying all edits from the pristine input ends in these."""
    others = [c for c in edits.columns if c not in key]
    return edits.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_e")).select(*key, "_e.*")


def debounced(events: DataFrame, key: list[str], at: str, quiet: str = "450 milliseconds") -> DataFrame:
    """The last event of each burst: one after which the key is quiet."""
    others = [c for c in events.columns if c not in key]
    bursts = events.groupBy(*key, F.session_window(at, quiet).alias("_w")).agg(F.max_by(F.struct(*others), at).alias("_e"), F.count("*").alias("burst"))
    return bursts.select(*key, "_e.*", "burst")


def lines_of_chunks(chunks: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """key, line, content: lines of a text that came in chunks cut anywhere. A last line without a newline counts, blank ones do not.

    Chunks are dealt by ranges of (key, order), so a stream in one key is never in one task, and cut into lines range by range: the text is
    shuffled once and written once. Only what lies before the first newline and behind the last one of a key in a range is put together with
    its neighbours, two pieces a range, and numbered with the count of the lines between; a line is as long as it is."""
    spark = chunks.sparkSession
    rows = chunks.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(text).alias("_t"))
    keys, places = [f"_k{i}" for i in range(len(key))], [f"_o{i}" for i in range(len(order))]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *places).sortWithinPartitions(*keys, *places)
    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    pieces = written(dealt.select(*keys, F.spark_partition_id().alias("_part"), "_t").mapInArrow(_cut_to_lines, f"{kinds}_part int, _kind int, _n long, content string"))
    tails = Window.partitionBy(*keys).orderBy("_part", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = pieces.filter(F.col("_kind") > INNER).withColumn("_group", F.sum((F.col("_kind") == TAIL).cast("long")).over(tails))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_kind", "content"))), lambda x: x["content"]), "")
    across = ends.groupBy(*keys, "_group").agg(joined.alias("content"), F.max(F.when(F.col("_kind") == TAIL, F.col("_part"))).alias("_part"), F.sum("_n").alias("_n")).withColumn("_counts", (F.trim("content") != "").cast("long"))
    upto = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    numbered = written(across.withColumn("_first", F.coalesce(F.sum(F.col("_n") + F.col("_counts")).over(upto), F.lit(0))))
    named = [F.col(k).alias(name) for k, name in zip(keys, key, strict=True)]
    starts = numbered.filter("_part IS NOT NULL").select(*[F.col(k).alias(f"_s{k}") for k in keys], F.col("_part").alias("_s_part"), "_first")
    same = F.col("_part") == F.col("_s_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_s{k}"))
    inner = pieces.filter(F.col("_kind") == INNER).join(starts, same).select(*named, (F.col("_first") + F.col("_n")).cast("int").alias("line"), "content")
    # a line that goes on behind a range comes after the lines between in the range where it begins
    return inner.unionByName(numbered.filter("_counts = 1").select(*named, (F.col("_first") + F.col("_n")).cast("int").alias("line"), "content"))


#: A line that begins and ends within a range, what is before its first newline (or all, if there is none), and what is behind its last one.
INNER, HEAD, TAIL = 0, 1, 2


def _cut_to_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order (key columns, _part, _t) -> key columns, _part, _kind, _n, content. ``_n`` numbers the lines within that are not blank; a
    tail has their number. Holds one batch and the line that is open."""
    at, part, cut, n, held, schema = None, 0, False, 0, [], None
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) or [()] * 5
        names = list(zip(*rows[0], strict=True)) or [()] * (len(schema) - 2)
        columns = [*names, *rows[1:]]
        types = [*[f.type for f in schema][:-2], pa.int32(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*schema.names[:-2], "_part", "_kind", "_n", "content"])

    def end() -> None:
        if at is not None:
            out.append((at, part, TAIL if cut else HEAD, n, "".join(held)))

    for batch in batches:
        schema = batch.schema
        columns = [c.to_pylist() for c in batch.columns]
        for name, p, t in zip(zip(*columns[:-2], strict=True) if len(columns) > 2 else [()] * len(batch), columns[-2], columns[-1], strict=True):
            if name != at:
                end()
                at, part, cut, n, held = name, p, False, 0, []
            if "\n" not in t:
                held.append(t)
                continue
            first, *lines, last = t.split("\n")
            held.append(first)
            lines.insert(0, "".join(held))
            if not cut:
                out.append((at, part, HEAD, 0, lines.pop(0)))
                cut = True
            for line in lines:
                if line.strip(" "):
                    out.append((at, part, INNER, n, line))
                    n += 1
            held = [last]
        yield table()
        out.clear()
    if schema is not None:
        end()
        yield table()


def attempt_outcome(attempts):
    """ok if any attempt is; resource_oom if all were killed for memory; timeout if any timed out; else error."""
    some = F.size(attempts) > 0
    return F.when(F.exists(attempts, lambda a: a["status"] == "ok"), "ok").when(some & F.forall(attempts, lambda a: F.coalesce(a["oom_killed"], F.lit(False))), "resource_oom").when(F.exists(attempts, lambda a: a["status"] == "timeout"), "timeout").otherwise("error")


def session_ends(messages: DataFrame) -> DataFrame:
    """session, complete: whether its final result came."""
    return messages.groupBy("session").agg((F.count_if(F.col("kind") == "result") > 0).alias("complete"))


def running_progress(messages: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Adds ``current``: completions so far, and ``total``."""
    w = Window.partitionBy(session)
    return messages.withColumn("current", F.count("*").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.count("*").over(w))


def step_at(steps: DataFrame, moments: DataFrame) -> DataFrame:
    """Step of a looping timeline (``step``, ``ms``) at each ``at`` in milliseconds. Steps are few and broadcast."""
    w = Window.orderBy("step")
    ends = steps.withColumn("_end", F.sum("ms").over(w)).withColumn("_start", F.col("_end") - F.col("ms")).withColumn("_all", F.sum("ms").over(Window.partitionBy()))
    joined = moments.crossJoin(F.broadcast(ends.agg(F.max("_all").alias("_loop")))).withColumn("_t", F.pmod("at", "_loop"))
    return joined.join(F.broadcast(ends), (F.col("_t") >= F.col("_start")) & (F.col("_t") < F.col("_end"))).select(*moments.columns, "step")


def split_fragments(regions: DataFrame, marker: str, gap: float = 2.0) -> DataFrame:
    """A row for each non-empty fragment of a text with its offset, widths in proportion to its characters; a text
    with fewer than two fragments stays one row. Needs ``region``, ``text`` and ``width``."""
    parts = F.filter(F.split("text", marker), lambda t: F.trim(t) != "")
    rows = regions.withColumn("_p", F.when(F.size(parts) >= 2, F.transform(parts, F.trim)).otherwise(F.array("text")))
    each = rows.select("region", "width", F.length("text").alias("_n"), F.posexplode("_p").alias("fragment", "content"), F.size("_p").alias("_k"))
    sized = each.withColumn("w", F.when(F.col("_k") >= 2, F.try_divide(F.col("width") * F.length("content"), F.col("_n"))).otherwise(F.col("width")))
    before = Window.partitionBy("region").orderBy("fragment").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("x", F.coalesce(F.sum(F.col("w") + gap).over(before), F.lit(0.0))).select("region", "fragment", "content", "x", "w")
