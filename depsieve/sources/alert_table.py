"""The alert table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsieve.rules import ALERT_TYPES, SEVERITIES


def checked_alerts(alerts: DataFrame, extra_types: tuple[str, ...] = ()) -> DataFrame:
    """Fail the job, not the data, on a severity or an alert type outside the vocabulary."""
    known = F.col("severity").isin(*SEVERITIES) & F.col("alert_type").isin(*ALERT_TYPES, *extra_types)
    bad = ~F.coalesce(known, F.lit(False))
    message = F.concat(F.lit("not an alert: "), F.to_json(F.struct("alert_type", "severity")))
    return alerts.withColumn("severity", F.when(bad, F.raise_error(message)).otherwise(F.col("severity")))


def write_alerts(alerts: DataFrame, path: str, mode: str = "overwrite", stamp: bool = True, extra_types: tuple[str, ...] = ()) -> None:
    """Write alerts as parquet, one folder per alert type, with the time of the scan.

    ``extra_types`` names the alert types of a user's own detectors.
    """
    rows = checked_alerts(alerts, extra_types)
    if stamp and "scanned_at" not in rows.columns:
        rows = rows.withColumn("scanned_at", F.current_timestamp())
    rows.write.mode(mode).partitionBy("alert_type").parquet(path)


def read_alerts(spark: SparkSession, path: str, alert_types: tuple[str, ...] = (), extra_types: tuple[str, ...] = ()) -> DataFrame:
    """Read an alert table back; naming types reads only their folders."""
    alerts = spark.read.parquet(path)
    unknown = set(alert_types) - set(ALERT_TYPES) - set(extra_types)
    if unknown:
        raise ValueError(f"not an alert type: {sorted(unknown)}")
    return alerts.where(F.col("alert_type").isin(*alert_types)) if alert_types else alerts
