"""Rows of a key that wait for the watermark, kept by time bucket.

A micro-batch appends its rows as one chunk per bucket without reading what is there; one timer per bucket
wakes the key when the watermark has passed the bucket's end, and only the buckets passed are read.  So
the work of a batch is bounded by its own rows and the rows that leave, not by all rows that wait.

Every access to the state is a message between processes.  So where rows of a key are older than the newest of them by more than
the watermark's delay, all of them are one chunk, in the earliest of their buckets: the watermark passes the older ones at the end of
the batch, and mostly the others too, as it follows the newest row of all keys.  What is left of the chunk then goes to
its own buckets, so no row is read more than twice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

CHUNKS, ROWS = "waiting_chunks", "waiting_rows"


class TimeBuckets:
    """``schema`` is that of a row; ``us`` is the place of its event time in microseconds."""

    def __init__(self, handle: StatefulProcessorHandle, schema: T.StructType, width_us: int, us: int = 0, delay_us: int | None = None):
        self.handle, self.us, self.delay = handle, us, delay_us
        self.width = max(1, width_us // 1000)  # milliseconds, as timers are
        self.chunks = handle.getMapState(CHUNKS, "bucket long", "chunks int")
        held = T.StructType([T.StructField("rows", T.ArrayType(schema))])
        self.rows = handle.getMapState(ROWS, "bucket long, chunk int", held)

    def passed(self, clock_ms: int) -> int:
        """The time in microseconds before which all rows have been taken."""
        return clock_ms // self.width * self.width * 1000

    def wake(self, us: int) -> None:
        """A timer for the first moment at which all rows up to ``us`` have been taken."""
        self.handle.registerTimer((us // 1000 // self.width + 1) * self.width)

    def add(self, rows: Iterable[tuple]) -> None:
        new: dict[int, list[tuple]] = {}
        for row in rows:
            new.setdefault(row[self.us] // 1000 // self.width, []).append(row)
        if self.delay is not None and len(new) > 1:
            soon = (max(row[self.us] for row in new[max(new)]) - self.delay) // 1000
            if (min(new) + 1) * self.width <= soon:
                new = {min(new): [row for own in new.values() for row in own]}
        self._store(new)

    def _store(self, new: dict[int, list[tuple]]) -> None:
        for bucket, own in new.items():
            n = self.chunks.getValue((bucket,))[0] if self.chunks.containsKey((bucket,)) else 0
            self.rows.updateValue((bucket, n), (own,))
            self.chunks.updateValue((bucket,), (n + 1,))
            if not n:
                self.handle.registerTimer((bucket + 1) * self.width)

    def take(self, clock_ms: int) -> list[tuple]:
        """Remove and return the rows of all buckets that end at ``clock_ms`` or before."""
        over = sorted(k[0] for k in self.chunks.keys() if (k[0] + 1) * self.width <= clock_ms)
        out, early, end = [], {}, self.passed(clock_ms)
        for bucket in over:
            for chunk in range(self.chunks.getValue((bucket,))[0]):
                for r in self.rows.getValue((bucket, chunk))[0]:
                    row = tuple(r)
                    if row[self.us] < end:
                        out.append(row)
                    else:
                        early.setdefault(row[self.us] // 1000 // self.width, []).append(row)
                self.rows.removeKey((bucket, chunk))
            self.chunks.removeKey((bucket,))
        self._store(early)
        return out


def read_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable of a stopped query as a table."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def waiting_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``key`` and the columns of the rows that still wait."""
    held = read_state(spark, checkpoint, ROWS)
    return held.select("key", F.explode("user_map_value.rows").alias("row")).select("key", "row.*")
