"""The change feed: event filter, debouncing, and incremental reloads with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import relative_to

WINDOW_MS = 300
#: Names that editors and systems leave behind.
NOISE = r"(?:^|/)(?:\.#[^/]*|\.DS_Store|Thumbs\.db|4913|[^/]*~|#[^/]*#|[^/]*\.(?:sw[a-z]|tmp|temp|bak|lock))$"


def relevant(kind: Column, path: Column) -> Column:
    """Changes of real files: no access events, no recovery folders, no noise."""
    return (kind != "access") & ~path.rlike(r"(?:^|/)(?:recovery|\.git|\.foliospark)(?:/|$)") & ~path.rlike(NOISE)


def fixed_windows(times: list[int], width: int = WINDOW_MS) -> list[tuple[int, int]]:
    """(start, events) of windows that an event opens and that do not grow; sorted times in milliseconds."""
    out: list[list[int]] = []
    for t in times:
        if out and t < out[-1][0] + width:
            out[-1][1] += 1
        else:
            out.append([t, 1])
    return [tuple(w) for w in out]


def debounce(events: DataFrame, key: str, width: int = WINDOW_MS) -> DataFrame:
    """(key, window_start, events) of a batch: one reload for each fixed window of a key.

    Events are dealt by key and sorted; a task scans them in turn and holds one open window, however many events a key has.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, n = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, ms = b.column(0), b.column(1).to_numpy()
            differ = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, b.num_rows - 1)), True) if b.num_rows > 1 else pa.array([], pa.bool_())
            both_null = pc.and_(keys.slice(1).is_null(), keys.slice(0, b.num_rows - 1).is_null()) if b.num_rows > 1 else differ
            at = [0, *(1 + np.flatnonzero(pc.and_not(differ, both_null).to_numpy(zero_copy_only=False))).tolist(), b.num_rows]
            done: list[tuple] = []
            for lo, hi in zip(at, at[1:]):
                own = keys[lo].as_py()
                if start is None or own != now:
                    if start is not None:
                        done.append((now, start, n))
                    now, start, n = own, int(ms[lo]), 0
                while lo < hi:
                    if ms[lo] >= start + width:
                        done.append((now, start, n))
                        start, n = int(ms[lo]), 0
                    end = lo + int(np.searchsorted(ms[lo:hi], start + width))
                    n, lo = n + end - lo, end
            yield batch(done, keys.type)
        if start is not None:
            yield batch([(now, start, n)], keys.type)

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64()), strict=True)], [key, "window_start", "events"])

    own = events.select(key, F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).where("ms is not null").repartition(key).sortWithinPartitions(key, "ms")
    return own.mapInArrow(run, f"{key} {kind}, window_start long, events long")


def debounce_stream(events: DataFrame, key: str, width: int = WINDOW_MS) -> DataFrame:
    """The same for a stream with a watermark on ts: a window is reported when time has passed its end."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        times = sorted(t for f in frames for t in f["ms"].tolist()) if not state.hasTimedOut else []
        done = []
        for t in times:
            if start is not None and t < start + width:
                count += 1
            else:
                if start is not None:
                    done.append((k[0], start, count))
                start, count = t, 1
        if state.hasTimedOut:
            done.append((k[0], start, count))
            state.remove()
        else:
            state.update((start, count))
            state.setTimeoutTimestamp(max(start + width, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[key, "window_start", "events"])

    kind = events.schema[key].dataType.simpleString()
    own = events.select(key, "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return own.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, window_start long, events long", "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def read_files(spark, folder: str) -> DataFrame:
    """A stream of (relative_path, markdown, ts) of Markdown files as they appear under a folder; paths are relative to it."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(folder)
    return raw.select(relative_to(F.col("path"), folder).alias("relative_path"), F.col("content").cast("string").alias("markdown"), F.col("modificationTime").alias("ts"))


def reload_incremental(catalog, parse, changed: DataFrame, removed: DataFrame | None = None) -> None:
    """Parses changed files (relative_path, markdown, ts) and replaces those documents' sections in the catalog; those of removed paths go."""
    newest = changed.groupBy("relative_path").agg(F.max_by("markdown", "ts").alias("markdown"))
    catalog.replace("sections", parse(newest), "relative_path", _paths(newest, removed))


def _paths(newest: DataFrame, removed: DataFrame | None) -> DataFrame:
    own = newest.select("relative_path")
    return own if removed is None else own.union(removed.select("relative_path"))


def reload_into(catalog, parse):
    """For foreachBatch: a micro-batch's files go into the catalog in one commit that rewrites only their buckets."""
    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            reload_incremental(catalog, parse, batch)

    return run
