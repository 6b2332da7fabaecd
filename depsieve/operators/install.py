"""Manifests: install-time scripts and declared dependencies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsieve.functions.json import last_value, parse_object, truthy_text, unique_entries
from depsieve.functions.text import let
from depsieve.rules import INSTALL_SCRIPT_NAMES
from depsieve.schemas import alert_rows, details

_VARIANTS = "MAP<STRING, VARIANT>"


def script_entries(manifest: Column) -> Column:
    """The install-time scripts of a manifest text: (key, value) pairs in fixed order."""
    scripts = parse_object(manifest, f"scripts {_VARIANTS}")["scripts"]

    def wanted(found: Column) -> Column:
        pairs = [
            F.struct(F.lit(name).alias("key"), truthy_text(last_value(found, F.lit(name))).alias("value"))
            for name in INSTALL_SCRIPT_NAMES
        ]
        return F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())

    return let(scripts, wanted)


def install_scripts(manifests: DataFrame) -> DataFrame:
    """Install-time scripts with a truthy command, as names in fixed order and as a map."""
    return (
        manifests.select("package", "version", script_entries(F.col("manifest")).alias("entries"))
        .where(F.size("entries") > 0)
        .select(
            "package",
            "version",
            F.col("entries.key").alias("names"),
            F.map_from_entries("entries").alias("scripts"),
        )
    )


def install_script_alerts(manifests: DataFrame) -> DataFrame:
    return script_alerts(install_scripts(manifests))


def script_alerts(scripts: DataFrame) -> DataFrame:
    """Alerts from (package, version, names, scripts)."""
    message = F.concat(F.lit("Package contains install scripts: "), F.concat_ws(", ", "names"))
    return alert_rows(scripts, "install_script", "high", message, details(scripts=F.col("scripts")))


def declared_dependencies(manifests: DataFrame) -> DataFrame:
    """Scan requests for all dependencies of each manifest; a devDependencies entry wins.

    Takes and keeps whatever key columns stand next to ``manifest``; the merge of the two
    maps happens inside the row.
    """
    owner = {"package": "dependent", "version": "dependent_version"}
    keys = {c: owner.get(c, c) for c in manifests.columns if c != "manifest"}
    fields = f"dependencies {_VARIANTS}, devDependencies {_VARIANTS}"
    none = F.from_json(F.lit("{}"), _VARIANTS)
    own = lambda field: unique_entries(F.coalesce(f"m.{field}", none))
    merged = F.concat(
        F.filter("deps", lambda e: ~F.array_contains(F.col("dev.key"), e["key"])), F.col("dev")
    )
    return (
        manifests.select(
            *[F.col(c).alias(name) for c, name in keys.items()],
            parse_object(F.col("manifest"), fields).alias("m"),
        )
        .where(F.col("m").isNotNull())
        .select(
            *keys.values(),
            own("dependencies").alias("deps"),
            own("devDependencies").alias("dev"),
        )
        .select(*keys.values(), F.inline(merged).alias("package", "range"))
        .where(F.schema_of_variant("range") == "STRING")
        .select(
            *keys.values(),
            "package",
            F.regexp_replace(F.try_variant_get("range", "$", "string"), r"^[\^~]", "").alias("version"),
        )
    )
