"""Hosts for a state machine: an ordered backfill and two Structured Streaming operators.

Streams are independent, so all hosts key by stream (and model, output or horizon, where a machine has several). The
backfill sorts each task's rows by stream and order and steps through them batch by batch, with the machine's state carried
over: a task holds one Arrow batch and one machine, however long its streams are. A single stream is still replayed by
one task, since each step needs the one before. The streaming host keeps the machine's state as one JSON value in the
state store, so a restart continues from its checkpoint. The timed host keeps rows, too, until the watermark has passed
them, and steps them by event-time timers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from strandline.streaming import machines
from strandline.streaming.machines import Machine


def _plain(value):
    if isinstance(value, (np.ndarray, list)):
        return [_plain(v) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    return None if isinstance(value, float) and value != value else value


def _rows(pdf: pd.DataFrame) -> Iterator[dict]:
    for r in pdf.to_dict("records"):
        yield {k: _plain(v) for k, v in r.items()}


def _values(column: pa.Array, plain: bool) -> list:
    """A column as Python values, whole buffers at a time. ``plain``: NaN is None, as ``_plain`` has it; fields of structs stay."""
    kind = column.type
    if pa.types.is_float64(kind):
        x = column.to_numpy(zero_copy_only=False)
        out = x.tolist()
        if plain and np.isnan(x).any():
            return [None if v != v else v for v in out]
        return column.to_pylist() if column.null_count else out
    if pa.types.is_integer(kind) and not column.null_count:
        return column.to_numpy().tolist()
    if pa.types.is_list(kind):
        ends, flat = column.offsets.to_numpy(), _values(column.flatten(), plain)
        if column.null_count:  # flatten() leaves out what null lists hold
            ends = np.append(0, np.cumsum(np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(ends))))
        out = [flat[a:b] for a, b in pairwise((ends - ends[0]).tolist())]
        return out if not column.null_count else [v if ok else None for v, ok in zip(out, column.is_valid().to_pylist(), strict=True)]
    if pa.types.is_struct(kind):
        names = [kind.field(i).name for i in range(kind.num_fields)]
        out = [dict(zip(names, v, strict=True)) for v in zip(*(_values(f, False) for f in column.flatten()), strict=True)]
        return out if not column.null_count else [v if ok else None for v, ok in zip(out, column.is_valid().to_pylist(), strict=True)]
    return column.to_pylist()


def _records(batch: pa.RecordBatch, raw: list[str]) -> Iterator[dict]:
    """The rows of a batch as a machine reads them; ``raw`` columns as they are."""
    names = batch.schema.names
    for v in zip(*(_values(c, n not in raw) for n, c in zip(names, batch.columns, strict=True)), strict=True):
        yield dict(zip(names, v, strict=True))


#: Partitions that streams are dealt to at least: few streams should not meet in one task.
PARTITIONS = 64


def _sorted(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whole streams, each in order inside one partition, and few of them to a partition.

    They are dealt by a hash of the keys, and not by the keys: a shuffle by the keys themselves is left out where a join
    on them has made one, which adaptive execution may then turn into a broadcast that leaves the streams scattered. A
    stated number of partitions is not coalesced, since what a task costs is its steps and not its bytes.
    """
    n = max(PARTITIONS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, F.xxhash64(*keys)).sortWithinPartitions(*keys, order)


def backfill(df: DataFrame, keys: list[str], order: str, make: Callable[[], Machine], schema: str, columns: list[str], snapshot: str | None = None) -> DataFrame:
    """Replay ordered streams; the result has the keys, ``order`` and the machine's outputs in ``columns``.

    ``snapshot`` names a column whose value in a stream's first row is the state to go on from (see ``snapshots``).
    """
    arrow, named = to_arrow_schema(StructType.fromDDL(schema)), [*keys, order, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, machine = None, None
        for batch in batches:
            out = []
            for r in _records(batch, [*keys, order]):
                at, body = tuple([r[k] for k in keys]), r.pop(snapshot) if snapshot else None
                if machine is None or at != stream:
                    stream, machine = at, make()
                    if body:
                        _load(machine, json.loads(body))
                made = machine.step(r)
                out.append([*at, r[order], *[_plain(made[c]) for c in columns]])
            lists = zip(*out, strict=True) if out else [[] for _ in named]
            found = dict(zip(named, lists, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return _sorted(df, keys, order).mapInArrow(run, schema)


def snapshots(df: DataFrame, keys: list[str], order: str, mark: str, make: Callable[[], Machine]) -> DataFrame:
    """keys, ``order`` and ``body``, the state as JSON, after each row whose column ``mark`` is true."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in (*keys, order)), "body string"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, machine = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at, marked = tuple(r[k] for k in keys), r.pop(mark)
                if machine is None or at != stream:
                    stream, machine = at, make()
                machine.step({k: _plain(v) for k, v in r.items()})
                if marked:
                    out.append({**{k: r[k] for k in (*keys, order)}, "body": json.dumps(_dump(machine))})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _sorted(df, keys, order).mapInArrow(run, schema)


def changes(df: DataFrame, keys: list[str], order: str, makes: list[Callable[[], Machine]], column: str, kind: str = "int", width: int = 9) -> DataFrame:
    """Many machines side by side over sorted rows: keys, cell, ``order`` and ``column`` wherever its value changes.

    What travels on has the size of the changes, not that of the rows times the machines. A pass steps ``width`` machines
    at most, so that those of one stream share the work of several tasks.
    """
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "cell int", f"{order} {types[order]}", f"{column} {kind}"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    parts = -(-len(makes) // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, machines_, last = None, [], []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = tuple(r[k] for k in dealt)
                part = r.pop("_part")
                if not machines_ or at != stream:
                    stream, machines_, last = at, [(i, makes[i]()) for i in range(part, len(makes), parts)], {}
                row = {k: _plain(v) for k, v in r.items()}
                for i, machine in machines_:
                    value = _plain(machine.step(row)[column])
                    if value != last.get(i):
                        last[i] = value
                        out.append({**{k: r[k] for k in (*keys, order)}, "cell": i, column: value})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    dealt = [*keys, "_part"]
    return _sorted(df.withColumn("_part", F.explode(F.array(*map(F.lit, range(parts))))), dealt, order).mapInArrow(run, schema)


class MachineProcessor(StatefulProcessor):
    """One machine a key. Rows of a batch are stepped in order; rows at or before the last seen position are counted late."""

    def __init__(self, keys: list[str], order: str, make: Callable[[], Machine], columns: list[str]):
        self.keys, self.order, self.make, self.columns = keys, order, make, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("machine", "body string, last double, late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, last, late = self.make(), float("-inf"), 0
        if self.value.exists():
            body, last, late = self.value.get()
            _load(machine, json.loads(body))
        pdf = pd.concat(list(rows)).sort_values(self.order, ignore_index=True)
        fresh = pdf[pdf[self.order] > last]
        late += len(pdf) - len(fresh)
        out = [machine.step(r) for r in _rows(fresh)]
        if len(fresh):
            last = float(fresh[self.order].iloc[-1])
        self.value.update((json.dumps(_dump(machine)), last, late))
        made = pd.DataFrame({c: [o[c] for o in out] for c in self.columns}, dtype=object)
        yield pd.concat([fresh[[*self.keys, self.order]].reset_index(drop=True), made], axis=1)

    def close(self) -> None:
        pass


class TimedProcessor(StatefulProcessor):
    """One machine a key, stepped in event time: rows wait in the state store until the watermark passes them.

    Each row sets a timer at its own time. When it fires, all rows up to it are stepped in order and leave the store, so
    rows may arrive in any order within the watermark's delay; what comes later than that is dropped by Spark.
    """

    def __init__(self, keys: list[str], order: str, time: str, make: Callable[[], Machine], columns: list[str]):
        self.keys, self.order, self.time, self.make, self.columns = keys, order, time, make, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("machine", "body string")
        self.rows = handle.getMapState("rows", "at double", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in _rows(pdf):
                when = int(pd.Timestamp(r.pop(self.time)).value // 1_000_000)
                self.rows.updateValue((float(r[self.order]),), (json.dumps([when, r]),))
                self.handle.registerTimer(when)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit, due = expiredTimerInfo.getExpiryTimeInMs(), []
        for at, body in self.rows.iterator():
            when, row = json.loads(body[0])
            if when <= limit:
                due.append((at[0], row))
        if not due:
            return
        machine = self.make()
        if self.value.exists():
            _load(machine, json.loads(self.value.get()[0]))
        out = []
        for at, row in sorted(due, key=lambda d: d[0]):
            self.rows.removeKey((at,))
            made = machine.step(row)
            out.append({**{k: row[k] for k in (*self.keys, self.order)}, **{c: _plain(made[c]) for c in self.columns}})
        self.value.update((json.dumps(_dump(machine)),))
        yield pd.DataFrame(out, dtype=object)

    def close(self) -> None:
        pass


def _dump(machine: Machine) -> dict:
    return {k: {"_machine": _dump(v), "_class": type(v).__name__} if isinstance(v, Machine) else v for k, v in machine.__dict__.items()}


def _load(machine: Machine, state: dict) -> None:
    for k, v in state.items():
        if isinstance(v, dict) and "_machine" in v:
            part = getattr(machine, k)
            if part is None:  # made on the way
                part = getattr(machines, v["_class"]).__new__(getattr(machines, v["_class"]))
                setattr(machine, k, part)
            _load(part, v["_machine"])
        else:
            setattr(machine, k, v)


def streaming(df: DataFrame, keys: list[str], order: str, make: Callable[[], Machine], schema: str, columns: list[str]) -> DataFrame:
    """The same machine over a streaming DataFrame (needs the RocksDB state store)."""
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=MachineProcessor(keys, order, make, columns), outputStructType=schema, outputMode="Update", timeMode="None")


def streaming_timed(df: DataFrame, keys: list[str], order: str, time: str, delay: str, make: Callable[[], Machine], schema: str, columns: list[str]) -> DataFrame:
    """The same machine in event time: ``time`` is watermarked by ``delay``, and timers step the rows that it passes."""
    late = df.withWatermark(time, delay).groupBy(*keys)
    return late.transformWithStateInPandas(statefulProcessor=TimedProcessor(keys, order, time, make, columns), outputStructType=schema, outputMode="Append", timeMode="EventTime")
