"""Alerts as report lines. Continuation parts of an alert are not reported again."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsieve.rules import ANNOTATION_PATTERNS, PLAIN_PATTERNS

_TEXTS = "ARRAY<STRING>"
_RULER = "=" * 60


def _label() -> Column:
    return F.translate(F.upper("alert_type"), "_", " ")


def _first_present(patterns: Column, scripts: Column, incident: Column, file: Column) -> Column:
    """The detail lines of the first kind of detail the alert has."""
    d = F.col("details")
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    return (
        F.when(d["patterns"].isNotNull(), patterns)
        .when(d["scripts"].isNotNull(), scripts)
        .when(filled(d["incident"]), incident)
        .when(filled(d["file"]), file)
        .otherwise(F.array().cast(_TEXTS))
    )


def _texts(*lines: Column) -> Column:
    """An array of the lines that are not NULL."""
    return F.array_compact(F.array(*lines))


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _ioc_line() -> Column:
    deps = F.col("details.malicious_dependencies")
    return F.when(F.size(deps) > 0, _say("IOC dependencies: ", F.concat_ws(", ", deps)))


def _incident_lines(before: tuple[str, ...] = ()) -> Column:
    d = F.col("details")
    first = _say("Incident: ", d["incident"], " (", d["date"], ")")
    return _texts(*[F.lit(b) for b in before], first, d["description"], _ioc_line())


def _numbered(alerts: DataFrame, lines: Column) -> DataFrame:
    keys = [c for c in ("project", "package", "version", "detector_ord", "alert_ord") if c in alerts.columns]
    return alerts.where(F.col("part") == 0).select(*keys, F.posexplode(lines).alias("line_no", "line"))


def annotation_rows(alerts: DataFrame) -> DataFrame:
    """CI annotation lines: one for the alert and up to three for its details."""
    d = F.col("details")
    command = F.when(F.col("severity") == "high", "error").when(
        F.col("severity") == "medium", "warning"
    ).otherwise("notice")
    bodies = F.concat(
        F.array(_say(_label(), ": ", F.col("message"))),
        _first_present(
            patterns=_texts(
                _say("Detected patterns: ", F.concat_ws(", ", F.slice(d["patterns"], 1, ANNOTATION_PATTERNS)))
            ),
            scripts=_texts(_say("Scripts: ", F.concat_ws(", ", F.map_keys(d["scripts"])))),
            incident=_incident_lines(),
            file=_texts(_say("Found in: ", d["file"])),
        ),
    )
    return _numbered(alerts, F.transform(bodies, lambda body: _say("::", command, "::", body)))


def plain_report_rows(alerts: DataFrame, keep: int = PLAIN_PATTERNS) -> DataFrame:
    """Plain-text lines: ruler, label, message, details, ruler."""
    d = F.col("details")
    # The shell detector lists only some of its hits; "more" refers to the listed ones.
    listed = F.when(F.col("alert_type") == "shell_access", F.size(d["patterns"]).cast("long")).otherwise(d["count"])
    more = F.when(listed > keep, _say("  ... and ", (listed - keep).cast("string"), " more"))
    bullet = lambda text: _say("  - ", text)
    lines = F.concat(
        _texts(
            F.lit(""),
            F.lit(_RULER),
            _say("[", F.upper("severity"), "] ", _label()),
            F.col("message"),
        ),
        _first_present(
            patterns=F.concat(
                _texts(F.lit(""), F.lit("Detected patterns:")),
                F.transform(F.slice(d["patterns"], 1, keep), bullet),
                _texts(more),
            ),
            scripts=F.concat(
                _texts(F.lit(""), F.lit("Scripts found:")),
                F.transform(F.map_entries(d["scripts"]), lambda e: bullet(_say(e["key"], ": ", e["value"]))),
            ),
            incident=_incident_lines(before=("",)),
            file=_texts(F.lit(""), _say("Found in: ", d["file"])),
        ),
        _texts(F.lit(_RULER)),
    )
    return _numbered(alerts, lines)


def write_report(rows: DataFrame, path: str) -> None:
    """Write report lines as text, in package order."""
    order = [c for c in rows.columns if c != "line"]
    rows.orderBy(*order).select("line").write.mode("overwrite").text(path)
