"""Running sums, means and sessions of a stream of values over the cells of a raster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.plans.state import ship


def cell_sums(events: DataFrame, cell: Column, value: str = "value") -> DataFrame:
    """n, total, hits of each cell; on a stream the state is one row for each cell that was ever hit."""
    return events.select(cell.cast("long").alias("n"), F.col(value).alias("v")).groupBy("n").agg(F.sum("v").alias("total"), F.count("v").alias("hits"))


def windowed_cell_sums(events: DataFrame, cell: Column, late: str, width: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """The same by time window; rows later than the watermark are left out on a stream."""
    rows = events.withWatermark(ts, late).select(F.window(ts, width).alias("w"), cell.cast("long").alias("n"), F.col(value).alias("v"))
    return rows.groupBy("w", "n").agg(F.sum("v").alias("total"), F.count("v").alias("hits")).select(F.col("w.start").alias("start"), "n", "total", "hits")


def sessions(events: DataFrame, cell: Column, late: str, gap: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """n, start, end, mean, hits of each run of a cell's values that follow each other within the gap.

    On a stream in append mode a session is told once the watermark has passed its end, and its state goes; rows whose own
    session the watermark has passed are left out.
    """
    rows = events.withWatermark(ts, late).select(F.session_window(ts, gap).alias("w"), cell.cast("long").alias("n"), F.col(value).alias("v"))
    return rows.groupBy("w", "n").agg(F.avg("v").alias("mean"), F.count("v").alias("hits")).select("n", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "hits")


_MEANS = "n long, first timestamp, last timestamp, mean double, hits long"
_CELL = np.dtype([("n", "i8"), ("hits", "i8"), ("mean", "f8"), ("first", "i8"), ("last", "i8"), ("due", "i8")])
#: A state has at most 2 ** 10 cells, those of a block of 2 ** 14 that have the same remainder by 16.
_BLOCK, _APART = 14, 16


def _with_values(held: np.ndarray, n: np.ndarray, times: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The cells, by n, after more values; cells that had any are due at 0."""
    every = np.union1d(held["n"], n)
    if len(every) > len(held):
        known, held = held, np.zeros(len(every), _CELL)
        held["n"], held["first"], held["last"] = every, 2**62, -(2**62)
        held[np.searchsorted(every, known["n"])] = known
    at = np.searchsorted(every, n)
    np.minimum.at(held["first"], at, times)
    np.maximum.at(held["last"], at, times)
    held["due"][at] = 0
    some = ~np.isnan(values)
    at, values = at[some], values[some]
    held["hits"] += np.bincount(at, minlength=len(held))
    held["mean"] += np.bincount(at, values - held["mean"][at], len(held)) / np.maximum(held["hits"], 1)
    return held


def running_means(events: DataFrame, cell: Column, late: str, idle: float, ts: str = "ts", value: str = "value") -> DataFrame:
    """n, first, last, mean, hits of each cell of a stream, told once it has been idle for `idle` seconds by the watermark.

    Each cell has a state of five numbers: how many values, their mean, updated by each value, the first and the last time,
    and when it is due, at the last time plus `idle`. At most 1024 cells share a stored state, so that the work for a
    batch goes with its rows and not with calls for each cell. A state's timer is at the first time that a cell is due; it
    tells those cells' rows and removes them, so state holds the cells that were hit lately, not all that ever were.
    Rows later than the watermark are left out; null values count as no hit.
    """
    rows = events.withWatermark(ts, late).select(cell.cast("long").alias("n"), F.col(ts).alias("t"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("block", F.shiftright("n", _BLOCK) * _APART + F.col("n").bitwiseAND(_APART - 1))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, now = np.frombuffer(state.get[0] if state.exists else b"", _CELL).copy(), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for batch in batches:
                n = batch["n"].fillna(0).to_numpy().astype("int64")  # without a number there is a block of its own
                held = _with_values(held, n, batch["t"].to_numpy().astype("datetime64[us]").astype("int64"), batch["v"].to_numpy())
            hit = held["due"] == 0
            held["due"][hit] = np.maximum(held["last"][hit] // 1000 + int(idle * 1000), now + 1)
        over = held["due"] < now
        told, held = held[over], held[~over]
        if len(held):
            state.update((held.tobytes(),))
            state.setTimeoutTimestamp(int(held["due"].min()))
        else:
            state.remove()
        if len(told):
            n = np.full(len(told), None) if pd.isna(key[0]) else told["n"]
            first, last = (told[c].astype("datetime64[us]") for c in ("first", "last"))
            yield pd.DataFrame({"n": n, "first": first, "last": last, "mean": np.where(told["hits"] > 0, told["mean"], np.nan), "hits": told["hits"]})

    ship(events.sparkSession)
    return rows.groupBy("block").applyInPandasWithState(run, _MEANS, "cells binary", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what its sources have now, into files under folder/out, and waits; a further run goes on from there.

    append writes what is final; complete writes the whole result of the last batch. Nothing passes the driver.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/out")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    q = writer.start()
    q.awaitTermination()
    return q
