"""Structured Streaming forms: health of sources as state, upserts by micro-batch, first-seen rows, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DISABLE_AT = 5
STATE = "source string, failures int, status string, at timestamp"
KEPT = "good_at long, good_id long, at long[], id long[], counted int, last long".replace("long[]", "array<long>")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Failures of one source since its last success, by event time: the state holds the last success and the failures after it, so it doesn't depend on the order in which runs come. Failures before the watermark can't be undone by a late success and are only counted."""
    good, counted, last = (-(2**63), -(2**63)), 0, -(2**63)
    bad: set[tuple[int, int]] = set()
    if state.exists:
        at, run, times, ids, counted, last = state.get
        good, bad = (at, run), set(zip(times, ids, strict=True))
    for rows in batches:
        micros = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        for one, ok in zip(zip(micros.tolist(), rows["run_id"].tolist(), strict=True), rows["ok"].tolist(), strict=True):
            last = max(last, one[0])
            if not ok:
                bad.add(one)
            elif one > good:
                good, counted = one, 0
    bad = {one for one in bad if one > good}
    failures = counted + len(bad)
    mark = state.getCurrentWatermarkMs() * 1000 if state._watermark_present else -(2**63)
    old = [one for one in bad if one[0] < mark]
    bad, counted = bad.difference(old), counted + len(old)
    state.update((*good, [x[0] for x in sorted(bad)], [x[1] for x in sorted(bad)], counted, last))
    status = "disabled" if failures >= DISABLE_AT else "degraded" if failures >= 2 else "healthy"
    yield pd.DataFrame({"source": [key[0]], "failures": [failures], "status": [status], "at": [pd.Timestamp(last, unit="us")]})


def source_health(runs: DataFrame, late: str | None = None) -> DataFrame:
    """A stream of runs (source, ts, run_id, ok) to updates of each source's state. Any order and any split of the runs into batches ends in the state of the whole. With ``late``, runs that come later than that after the newest are dropped, and the state stays small however long a source fails; runs of one time and id count once."""
    if late is None:
        return runs.groupBy("source").applyInPandasWithState(_advance, STATE, KEPT, "update", GroupStateTimeout.NoTimeout)
    return runs.withWatermark("ts", late).groupBy("source").applyInPandasWithState(_advance, STATE, KEPT, "update", GroupStateTimeout.EventTimeTimeout)


def windowed(runs: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Runs and failures by source and window of event time, late rows up to a bound."""
    return runs.withWatermark("ts", late).groupBy(F.window("ts", width), "source").agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failed"))


def first_seen(rows: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Rows whose key hasn't come within the bound."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upserting(path: str, merge):
    """A foreachBatch function that keeps a table of the latest rows: each batch is merged into the version before and written as the next. A batch that is run again writes the same version."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = merge(spark.read.parquet(f"{path}/v{number - 1}") if number else None, batch)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write
