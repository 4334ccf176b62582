"""Size-checked small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small_table(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Evaluate a table that is expected to be small (one row per class or per file).

    Up to ``max_rows`` rows become a table marked for broadcast: Spark does not know the size of rows from the driver, and a
    shuffle by a few classes leaves the large side in as many tasks.  A larger table is returned as it was and joins by shuffle.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
