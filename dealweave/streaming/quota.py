"""Uses of the last 24 hours per client, exact to the second, as a stream.

Every client's state holds its uses by second, in one value. One timer per client stands at its next step, the second
of a use or that 24 hours later; when it expires, all steps that the watermark has passed are counted at once and the
uses that are a day old leave the state, so it never holds more than the last day and what the watermark still waits
for. Results come once the watermark has passed them, whatever the order of arrival; rows older than the watermark are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dealweave.operators.rows import first_per_group
from dealweave.streaming.jobs import appended_result

DAY = 86_400
#: Earlier than any second of a time.
NEVER = -(1 << 60)
#: Half a second more than an hour: no step falls on the watermark itself.
LATENESS = "3600500 milliseconds"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastDay(StatefulProcessor):
    """State of a client: the ``seconds`` of its uses in order, their ``counts``, and the second up to which the steps are
    ``done``. The one timer stands at the next step."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uses = handle.getValueState("uses", "seconds array<bigint>, counts array<bigint>, done bigint")

    def _held(self) -> tuple[np.ndarray, np.ndarray, int]:
        seconds, counts, done = self.uses.get() if self.uses.exists() else ([], [], NEVER)
        return np.array(seconds, np.int64), np.array(counts, np.int64), done

    @staticmethod
    def _steps(seconds: np.ndarray, done: int) -> np.ndarray:
        """Seconds after ``done`` at which a use comes in or is a day old."""
        moments = np.union1d(seconds, seconds + DAY)
        return moments[moments > done]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = np.concatenate([batch["second"].to_numpy(np.int64) for batch in rows])
        new = new[new * 1000 > passed]
        if not len(new):
            return iter(())
        seconds, counts, done = self._held()
        before = self._steps(seconds, done)
        all_seconds, at = np.unique(np.concatenate([seconds, new]), return_inverse=True)
        all_counts = np.bincount(at, np.concatenate([counts, np.ones(len(new), np.int64)])).astype(np.int64)
        self.uses.update((all_seconds.tolist(), all_counts.tolist(), done))
        first = self._steps(all_seconds, done)[0]
        if not len(before) or first < before[0]:
            if len(before):
                self.handle.deleteTimer(int(before[0]) * 1000)
            self.handle.registerTimer(int(first) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // 1000
        seconds, counts, done = self._held()
        steps = self._steps(seconds, done)
        ready = steps[steps <= passed]
        total = np.concatenate([[0], np.cumsum(counts)])
        used = total[np.searchsorted(seconds, ready, "right")] - total[np.searchsorted(seconds, ready - DAY, "right")]
        kept = seconds + DAY > passed
        if kept.any():
            self.uses.update((seconds[kept].tolist(), counts[kept].tolist(), passed))
            self.handle.registerTimer(int(steps[len(ready)]) * 1000)
        else:
            self.uses.clear()
        yield pd.DataFrame({"client": key[0], "second": ready, "used": used})

    def close(self) -> None:
        pass


def usage_steps(log: DataFrame, user: str = "user_email") -> DataFrame:
    """(client, at, used) for every second at which a use of the client comes in or is a day old.

    ``used`` counts the successful uses of the 24 hours up to and with ``at``; it holds until the client's next step.
    Rows without a client or time are left out.
    """
    rows = log.filter(F.col("error").isNull() & F.col(user).isNotNull()).withWatermark("created_at", LATENESS).select(
        F.col(user).cast("string").alias("client"), F.unix_seconds("created_at").alias("second"), "created_at")
    steps = rows.groupBy("client").transformWithStateInPandas(
        LastDay(), "client string, second bigint, used bigint", "Append", "EventTime")
    return steps.select("client", F.timestamp_seconds("second").alias("at"), "used")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB on the executors, with its changes in the checkpoint."""
    old = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, old)


def run_usage_steps(log: DataFrame, folder: str, user: str = "user_email") -> DataFrame:
    """All steps so far: takes in what has arrived, from where the last run on the folder ended."""
    with rocksdb_state(log.sparkSession):
        return appended_result(usage_steps(log, user), folder)


def used_at(steps: DataFrame, moments: DataFrame) -> DataFrame:
    """(client, at, used): the quota used by clients at given moments. ``moments``: client, at, without repeats."""
    asked = moments.select("client", F.col("at").alias("_asked"))
    held = asked.join(steps, "client", "left").filter(F.col("at").isNull() | (F.col("at") <= F.col("_asked")))
    last = first_per_group(held, ["client", "_asked"], [F.desc("at")])
    return asked.join(last, ["client", "_asked"], "left").select(
        "client", F.col("_asked").alias("at"), F.coalesce("used", F.lit(0).cast("bigint")).alias("used"))
