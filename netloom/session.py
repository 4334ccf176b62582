"""Session settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Wide aggregates outgrow what the JIT compiles; run those operators one by one instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Keyed streaming state goes to disk, and the stateful operators need this provider.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def use_disk_state(spark: SparkSession) -> None:
    """The stateful operators exist only on this state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, SETTINGS[name])


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
