"""The publication feed as a stream."""

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depsieve.schemas import CHANGES
from depsieve.session import intermediates
from depsieve.sources.alert_table import write_alerts


def read_changes(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Change documents from a landing folder of JSON lines, a bounded page per batch."""
    return (
        spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    )


def publications(changes: DataFrame) -> DataFrame:
    """Name and latest version of each change that has both; deletions fall out."""
    name, latest = F.col("doc.name"), F.col("doc.`dist-tags`.latest")
    kept = [c for c in ("seq", "ingested_at") if c in changes.columns]
    return changes.where((name != "") & (latest != "")).select(
        *kept, name.alias("package"), latest.alias("version")
    )


def resume_from_seq(changes: DataFrame, last_seq: int) -> DataFrame:
    """Only changes after ``last_seq``. Between runs the checkpoint keeps the position."""
    return changes.where(F.col("seq") > last_seq)


def dedupe_publications(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a version within ``delay`` of event time (``ingested_at``)."""
    return stream.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(
        ["package", "version"]
    )


def quarantine(published: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split publications into scannable ones and errors with a reason.

    A version is in error if it has no files at all or a file that could not be read;
    its readable files can still be scanned. Contents are not read here.
    """
    key = ["package", "version"]
    # Only files of the versions in question are counted, not the whole corpus for each batch.
    asked = published.select(*key).distinct()
    state = files.select(*key, "path", "content_error").join(asked, key, "left_semi").groupBy(*key).agg(
        F.count("content_error").alias("unreadable"), F.count("path").alias("known_files")
    )
    reason = F.when(F.col("known_files").isNull(), "no files").when(
        F.col("unreadable") > 0, F.concat(F.col("unreadable").cast("string"), F.lit(" unreadable file(s)"))
    )
    judged = published.join(state, key, "left").withColumn("reason", reason)
    return (
        judged.where(F.col("reason").isNull()).select(*published.columns),
        judged.where(F.col("reason").isNotNull()).select(*published.columns, "reason"),
    )


def scan_stream(
    published: DataFrame,
    scan: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    available_now: bool = False,
    files: DataFrame | None = None,
    extra_types: tuple[str, ...] = (),
    run: str | None = None,
) -> StreamingQuery:
    """Scan each micro-batch of publications and write its alerts.

    ``scan`` turns a batch of (package, version) into alerts, reading static tables.
    Every batch overwrites its own ``run=``/``batch_id=`` folder, so a replay after a failure
    leaves the table as if it had run once. Batches are numbered from 0 for each checkpoint;
    ``run`` names the folder of one (a hash of its path if not given), so that a new one
    leaves the alerts of others alone. After a lost checkpoint the same ``run`` and the
    same input from the start replace what was there. With
    ``files``, publications in error go to ``<out>-errors`` in the same way and do not stop
    the feed. ``extra_types`` names alert types of a user's own detectors.
    """
    run_id = run or hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def scan_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            with intermediates(batch.sparkSession):
                write_alerts(scan(batch), f"{out}/run={run_id}/batch_id={batch_id}", extra_types=extra_types)
            if files is not None:
                _, bad = quarantine(batch, files)
                bad.write.mode("overwrite").parquet(f"{out}-errors/run={run_id}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = published.writeStream.foreachBatch(scan_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 second"}
    return writer.trigger(**trigger).start()


def drain_to_table(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is available now to a parquet table, then stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
