"""The parts of the library that run on streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from berrak.plans.auditor import Audit

#: The limit of the service: hits within a window of seconds.
LIMIT, WINDOW = 60, 60.0


def _same(a: Any, b: Any) -> bool:
    """Equal as grouping keys are: null and NaN equal themselves."""
    return a == b or (a != a and b != b)


def rate_limit(events: DataFrame, key: str, at: str, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """Events (with event_id) with ``allowed``: decided by client in the order of time, then of event_id.

    A hit that is rejected does not count, nor does one without a time, which is let through. A client's
    events are sorted, which may spill, and then read once: only the at most ``limit`` hits
    that still count are held, however many events a client has.
    """
    rows = events.select(F.col(key), "event_id", F.col(at).cast("timestamp").cast("double").alias("t"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hits = object(), deque()
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not _same(k, last):
                    last, hits = k, deque()
                if t is None:
                    out.append(limit > 0)
                    continue
                while hits and hits[0] <= t - window:
                    hits.popleft()
                out.append(len(hits) < limit)
                if out[-1]:
                    hits.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=[key, "event_id", "allowed"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2]]
    return rows.repartition(key).sortWithinPartitions(key, "t", "event_id").mapInArrow(decide, ", ".join([*kinds, "allowed boolean"]))


def limited_stream(events: DataFrame, key: str, at: str, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """The same on a stream, with the hits that still count as each client's state; idle clients are forgotten."""

    def step(id_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        out = []
        for t in rows["t"]:
            hits = [h for h in hits if h > t - window]
            out.append(len(hits) < limit)
            if out[-1]:
                hits.append(t)
        state.update((hits,))
        state.setTimeoutDuration(int(window * 10_000))
        yield pd.DataFrame({key: [id_[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "allowed": out})

    rows = events.select(key, "event_id", F.col(at).cast("timestamp").cast("double").alias("t"))
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, allowed boolean", "hits array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def audit_stream(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **settings: object) -> StreamingQuery:
    """Audits each micro-batch of a stream of documents (doc_id, text) and hands its findings to a sink.

    A document is whole within its batch, so that the findings are those of a batch audit.
    """
    return docs.writeStream.foreachBatch(lambda batch, n: sink(Audit(batch, **settings).findings, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()  # type: ignore[arg-type]
