"""Resolved dependencies from the three lockfile formats.

A lockfile is one row; its entries are worked out inside the row and exploded, so
parsing needs no shuffle. ``nested='leaf'`` reads entries the default rules miss or
misname: nested and scoped packages, protocol ranges and peer suffixes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsieve.functions.json import parse_object, truthy_text, unique_entries
from depsieve.functions.text import LINE_END, SPACE
from depsieve.rules import LOCKFILE_NAMES

NPM, YARN, PNPM = LOCKFILE_NAMES
ENTRY_COLUMNS = ("project", "path", "file_name", "ord", "package", "version")


def _entries(lockfiles: DataFrame, file_name: str, found: Column) -> DataFrame:
    """Explode an array of (package, version) into lock entries."""
    return (
        lockfiles.where(F.col("file_name") == file_name)
        .select("project", "path", "file_name", F.posexplode(found).alias("ord", "entry"))
        .select("project", "path", "file_name", "ord", "entry.package", "entry.version")
    )


def _pair(package: Column, version: Column) -> Column:
    return F.struct(package.alias("package"), version.alias("version"))


def npm_lock_entries(lockfiles: DataFrame, nested: str = "path") -> DataFrame:
    """``packages`` (also if empty) or else ``dependencies``, in the order of the text."""
    both = "packages MAP<STRING, VARIANT>, dependencies MAP<STRING, VARIANT>"
    key = F.col("key")
    if nested == "leaf":
        name = F.regexp_replace(key, r"^(?:.*/)?node_modules/", "")
    else:
        name = F.regexp_replace(F.regexp_replace(key, r"^node_modules/", ""), r"/node_modules/", "/")
    # A NULL map may be a present value that is not an object, which still wins.
    has_packages = F.get_json_object("content", "$.packages").isNotNull()
    chosen = F.coalesce("lock.packages", F.when(~has_packages, F.col("lock.dependencies")))
    return (
        lockfiles.where(F.col("file_name") == NPM)
        .select("*", parse_object(F.col("content"), both).alias("lock"))
        .select("project", "path", "file_name", F.posexplode(unique_entries(chosen)).alias("ord", "entry"))
        .select("project", "path", "file_name", "ord", "entry.*")
        .select(
            "project",
            "path",
            "file_name",
            "ord",
            name.alias("package"),
            # NULL unless the value is an object that has it
            truthy_text(F.try_variant_get("value", "$.version", "variant")).alias("version"),
        )
        .where(F.col("version").isNotNull())
    )


_S = f"[{SPACE}]"
_NOT_S = f"[^{SPACE}]"
_INDENTED = rf"[ \t]+[^{LINE_END}]*\n"
_VERSION_LINE = r'[ \t]+version[: ]+"?(\d[\d.a-zA-Z\-+]*)"?'
_REST_OF_BLOCK = rf"(?:(?!{_VERSION_LINE}){_INDENTED})*+{_VERSION_LINE}"
_YARN_BLOCK = {
    "path": (
        rf'^"?([^@"{SPACE}]+)@[^":\n]+"?{_S}*'
        rf'(?:,{_S}*"?[^@"{SPACE}]+@[^":\n]+"?)*+:(?>{_S}*\n)' + _REST_OF_BLOCK
    ),
    "leaf": rf'^"?(@?[^@",{SPACE}]+)@[^\n]*:(?>{_S}*\n)' + _REST_OF_BLOCK,
}


def yarn_lock_entries(lockfiles: DataFrame, nested: str = "path") -> DataFrame:
    """One entry per block: name of the first descriptor and first indented version.

    The text is cut into blocks at lines that start in column one, and each block is
    matched on its own. A header spread over several lines is not read.
    """
    regex = _YARN_BLOCK[nested]
    blocks = F.split("content", rf"(?<=[{LINE_END}])(?={_NOT_S})")
    named = F.transform(
        F.filter(blocks, lambda b: b.rlike(regex)),
        lambda b: _pair(
            F.regexp_replace(F.regexp_extract(b, regex, 1), r"^[^:]+:", ""),
            # group 2 belongs to the lookahead, group 3 to the version line itself
            F.regexp_extract(b, regex, 3),
        ),
    )
    return _entries(lockfiles, YARN, named)


# A key is the first text of its line (or of a line after a blank one). The lookahead
# requires the closing colon first, so each candidate is read only once or twice.
_KEY_START = rf"(?<!{_S})(?>{_S}*[{LINE_END}]{_S}+|\A{_S}+)"
_PNPM_KEY = {
    "path": rf"/?(?=[^:{SPACE}]++:)([a-zA-Z0-9@._\-/]+?)[@/](\d+\.\d+\.\d+[^:{SPACE}]*):",
    "leaf": rf"""['"]?/?(?=[^:{SPACE}]++:)([a-zA-Z0-9@._\-/]+?)[@/](\d+\.\d+\.\d+[^:(_'"{SPACE}]*)[^:{SPACE}]*:""",
}


def pnpm_lock_entries(lockfiles: DataFrame, nested: str = "path") -> DataFrame:
    """Indented ``name@1.2.3:`` or ``/name/1.2.3:`` keys, each name and version once per file."""
    regex = _PNPM_KEY[nested]
    keys = F.regexp_extract_all("content", F.lit(rf"{_KEY_START}({regex})"), F.lit(1))
    named = F.transform(
        keys,
        lambda k: _pair(
            F.regexp_replace(F.regexp_extract(k, "^" + regex, 1), "^/", ""),
            F.regexp_extract(k, "^" + regex, 2),
        ),
    )
    return _entries(lockfiles, PNPM, F.array_distinct(named))


def lock_entries(lockfiles: DataFrame, nested: str = "path") -> DataFrame:
    """Entries of all three formats."""
    return (
        npm_lock_entries(lockfiles, nested)
        .unionByName(yarn_lock_entries(lockfiles, nested))
        .unionByName(pnpm_lock_entries(lockfiles, nested))
    )


def leaf_lock_entries(lockfiles: DataFrame) -> DataFrame:
    """All entries under the wider rules."""
    return lock_entries(lockfiles, nested="leaf")
