"""Column layouts of the relations this library reads and writes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POPULAR = "package STRING, rank INT"
KNOWN_BAD_FEED = (
    "package STRING, versions ARRAY<STRING>, incident STRING, date STRING, "
    "ioc STRUCT<maliciousDependencies: ARRAY<STRING>, description: STRING, references: ARRAY<STRING>>"
)
CHANGES = (
    "id STRING, seq LONG, deleted BOOLEAN, changes ARRAY<STRUCT<rev: STRING>>, "
    "doc STRUCT<name: STRING, `dist-tags`: STRUCT<latest: STRING>>, ingested_at TIMESTAMP"
)

# One nullable struct with every key any detector writes, so that all branches of
# the alert union share a schema and unused keys can still be pruned.
DETAIL_FIELDS = {
    "scripts": "MAP<STRING, STRING>",
    "patterns": "ARRAY<STRING>",
    "count": "LONG",
    "files": "ARRAY<STRUCT<file: STRING, entropy: DOUBLE>>",
    "threshold": "DOUBLE",
    "suspicious_matches": "ARRAY<STRUCT<package: STRING, distance: INT, similarity: DOUBLE>>",
    "target_package": "STRING",
    "incident": "STRING",
    "date": "STRING",
    "description": "STRING",
    "malicious_dependencies": "ARRAY<STRING>",
    "references": "ARRAY<STRING>",
    "file": "STRING",
    "package": "STRING",
    "version": "STRING",
}

ALERT_COLUMNS = (
    "package",
    "version",
    "detector_ord",
    "alert_ord",
    "part",
    "alert_type",
    "severity",
    "message",
    "details",
)

DETECTOR_ORD = {
    "install_script": 1,
    "network_access": 2,
    "typosquat": 3,
    "filesystem_access": 4,
    "obfuscated_code": 5,
    "shell_access": 6,
    "known_compromised": 7,
    "lockfile_match": 8,
}
EXTRA_DETECTOR_ORD = 100


def details(**values: Column) -> Column:
    """The details struct with the given keys set and all others NULL."""
    unknown = set(values) - set(DETAIL_FIELDS)
    if unknown:
        raise ValueError(f"not a details key: {sorted(unknown)}")
    return F.struct(
        *[
            (values[name] if name in values else F.lit(None)).cast(kind).alias(name)
            for name, kind in DETAIL_FIELDS.items()
        ]
    )


def alert_rows(
    df: DataFrame,
    alert_type: str,
    severity: Column | str,
    message: Column | str,
    detail: Column,
    alert_ord: Column | None = None,
    part: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Project ``df`` (which has package and version) to the alert layout."""
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        *keep,
        "package",
        "version",
        F.lit(DETECTOR_ORD.get(alert_type, EXTRA_DETECTOR_ORD)).alias("detector_ord"),
        (F.lit(0) if alert_ord is None else alert_ord).cast("long").alias("alert_ord"),
        (F.lit(0) if part is None else part).cast("int").alias("part"),
        F.lit(alert_type).alias("alert_type"),
        as_col(severity).alias("severity"),
        as_col(message).alias("message"),
        detail.alias("details"),
    )
