"""Package files: from landed archives or from extracted trees."""

import io
import itertools
import json
import tarfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depsieve.functions.json import parse_object

#: What one Spark string holds with room for replaced bytes; a larger file is reported, not read.
MAX_MEMBER_BYTES = 640 << 20
_MANIFEST_BYTES = 16 << 20
_DAMAGED = (tarfile.TarError, EOFError, OSError, ValueError, zlib.error)
_FRAME_CHARS = 8 << 20
_UNPACKED_BYTES = 32 << 20


def _frames(rows: Iterable[dict]) -> Iterator[pd.DataFrame]:
    """Batch rows into frames of a few million characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row["content"] or "")
        if size >= _FRAME_CHARS:
            yield pd.DataFrame(held)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held)


def _inner_path(member: tarfile.TarInfo) -> str:
    """The path of a regular file without the leading folder; empty for all else."""
    path = "/".join(p for p in member.name.split("/") if p not in ("", "."))
    path = path.partition("/")[2]
    return path if member.isreg() and ".." not in path.split("/") else ""


def _unpacked(data: bytes) -> tuple[bytes, str]:
    """A small whole archive unpacked once, for all later passes, else as it is; and tarfile's mode."""
    stream = zlib.decompressobj(31)
    try:
        plain = stream.decompress(data, _UNPACKED_BYTES)
    except zlib.error:
        return data, "r:gz"
    return (plain, "r:") if stream.eof and not stream.unused_data else (data, "r:gz")


def _survey(data: bytes, mode: str) -> tuple[str | None, str | None]:
    """The name in an archive's root manifest, and what is wrong with the archive.

    The stream is read to its end, where gzip keeps checksum and length. A header that is
    neither valid nor zero ends the list of members early, which tarfile does not report.
    """
    name = None
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as archive:
            for member in archive:
                if _inner_path(member) == "package.json" and member.size <= _MANIFEST_BYTES:
                    try:
                        manifest = json.loads(archive.extractfile(member).read())
                    except (ValueError, RecursionError):
                        continue
                    found = manifest.get("name") if isinstance(manifest, dict) else None
                    name = found if isinstance(found, str) else name
            archive.fileobj.seek(archive.offset)
            if archive.fileobj.read(tarfile.BLOCKSIZE).strip(b"\0"):
                return name, "bad archive: damaged header"
            while archive.fileobj.read(1 << 20):
                pass
    except _DAMAGED as error:
        return name, f"bad archive: {type(error).__name__}"
    return name, None


def _members(archive_path: str, data: bytes, max_bytes: int) -> Iterator[dict]:
    """The regular files of one archive, and one row with the error if it is damaged."""
    data, mode = _unpacked(data)
    name, damage = _survey(data, mode)
    row = {"archive": archive_path, "name": name, "path": None, "content": None, "content_error": None}
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as archive:
            for member in archive:
                path = _inner_path(member)
                if not path:
                    continue
                if member.size > max_bytes:
                    yield {**row, "path": path, "content_error": f"larger than {max_bytes} bytes"}
                    continue
                text = archive.extractfile(member).read().decode("utf-8", "replace")
                yield {**row, "path": path, "content": text}
    except _DAMAGED as error:
        damage = damage or f"bad archive: {type(error).__name__}"
    if damage:
        yield {**row, "content_error": damage}


def unpack_archives(archives: DataFrame, max_bytes: int = MAX_MEMBER_BYTES) -> DataFrame:
    """``binaryFile`` rows of ``.tgz`` archives -> package files.

    One archive is one row; members come out one by one, so a task holds a single
    archive and a single member. A member over the size limit gives a row with
    ``content_error``; so does a damaged archive, beside the files that could be read.
    Neither fails the task. An archive whose file name holds no version gets its whole
    name as the package, no version, and an error on each of its rows.

    File names have the slash of a scoped package as a dash; where the root manifest's
    name is the same but for that, it is the package's name.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(
            row
            for batch in batches
            for name, data in zip(batch["path"], batch["content"])
            for row in _members(name, data, max_bytes)
        )

    rows = archives.select("path", "content").mapInPandas(
        unpack, "archive STRING, name STRING, path STRING, content STRING, content_error STRING"
    )
    stem = F.regexp_extract("archive", r"([^/]+)\.tgz\z", 1)
    named = _named(rows.withColumn("stem", stem))
    unnamed = F.col("package") == ""
    scoped = F.replace(F.col("name"), F.lit("/"), F.lit("-")) == F.col("package")
    package = F.when(unnamed, F.col("stem")).when(scoped, F.col("name")).otherwise(F.col("package"))
    no_version = F.when(unnamed, F.lit("no version in the archive's name"))
    return named.select(
        package.alias("package"), "version", "path", "content", F.coalesce("content_error", no_version).alias("content_error")
    )


def _named(rows: DataFrame) -> DataFrame:
    """Split ``name-1.2.3`` at the first dash that a version number follows."""
    pattern = r"^(.+?)-(\d+\.\d+\.\d+.*)$"
    return rows.withColumn("package", F.regexp_extract("stem", pattern, 1)).withColumn(
        "version", F.regexp_extract("stem", pattern, 2)
    )


def ingest_archives(spark: SparkSession, folder: str, max_bytes: int = MAX_MEMBER_BYTES) -> DataFrame:
    """Package files of all ``<name>-<version>.tgz`` archives in a landing folder.

    Names that start with a dot or an underscore are left out, as in Spark's file sources.
    Tasks list what is below the folder and read the archives. A folder that only Spark can
    open, or a pattern, goes through its own source, with the list of files on the driver.
    """
    try:
        if set(folder) & set("*?[]{}"):
            raise ValueError("a pattern, not a folder")
        _open(folder)
    except (ValueError, OSError):
        archives = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.tgz")
            .option("recursiveFileLookup", "true")
            .load(folder)
        )
        # Spark counts each file as 4 MB, which makes a task of every few archives.
        return unpack_archives(archives.coalesce(_tasks(spark)), max_bytes)

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, _ = _open(folder)

        def rows():
            for batch in batches:
                for full in batch["full"]:
                    with target.open_input_stream(full, compression=None) as stream:
                        yield {"path": full, "content": stream.read()}

        yield from _frames(rows())

    found = _files_below(spark, folder, hidden=False).where(F.col("full").endswith(".tgz"))
    archives = found.select("full").repartition(_tasks(spark), "full").mapInPandas(contents, "path STRING, content BINARY")
    return unpack_archives(archives, max_bytes)


def below(path: Column, folder: str) -> Column:
    """The part of a file URI below ``folder``, with URI escapes undone."""
    base = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substring(plain, F.locate(base, plain) + F.lit(len(base)), F.length(plain))


def _open(uri: str):
    """The file system and the path of a folder, for use on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def _tasks(spark: SparkSession) -> int:
    """Tasks for rows of few bytes but much work each; by size, adaptive execution would merge them into very few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _files_below(spark: SparkSession, folder: str, hidden: bool = True) -> DataFrame:
    """(full, size) of all files below a folder, with or without what hidden names hold.

    The driver sees only the names in the folder itself. Tasks open two more levels, each
    spread anew, then walk what is below.
    """
    from pyarrow import fs

    system, base = _open(folder)
    entry = "full STRING, size LONG, is_folder BOOLEAN"

    def children(target, full: str) -> Iterator[tuple]:
        for info in target.get_file_info(fs.FileSelector(full)):
            if info.type in (fs.FileType.File, fs.FileType.Directory) and (hidden or info.base_name[0] not in "._"):
                yield info.path, info.size or 0, info.type == fs.FileType.Directory

    def open_folders(deep: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            target, _ = _open(folder)

            def rows():
                for batch in batches:
                    pending = list(batch.itertuples(index=False, name=None))
                    while pending:
                        row = pending.pop()
                        if not row[2]:
                            yield row
                        elif deep:
                            pending.extend(children(target, row[0]))
                        else:
                            yield from children(target, row[0])

            found = rows()
            while chunk := list(itertools.islice(found, 10_000)):
                yield pd.DataFrame(chunk, columns=["full", "size", "is_folder"])

        return run

    listed = spark.createDataFrame(list(children(system, base)), entry)
    for deep in (False, False, True):
        listed = listed.repartition("full").mapInPandas(open_folders(deep), entry)
    return listed.select("full", "size")


def read_package_tree(spark: SparkSession, folder: str, max_bytes: int = MAX_MEMBER_BYTES) -> DataFrame:
    """Package files of extracted trees: ``<package>/<version>/<path>``.

    A scoped package takes two folders (``@scope/name``). Spark's own file sources skip
    every name that starts with a dot or an underscore, which is where a package may
    hide code, so tasks list and read the files themselves; the files found are spread
    evenly over new tasks before they are read.
    """
    _, base = _open(folder)

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, _ = _open(folder)

        def rows():
            for batch in batches:
                for full, size in zip(batch["full"], batch["size"]):
                    row = {"file": full[len(base) :].lstrip("/"), "content": None, "content_error": None}
                    if size > max_bytes:
                        row["content_error"] = f"larger than {max_bytes} bytes"
                    else:
                        try:
                            with target.open_input_stream(full) as stream:
                                row["content"] = stream.read().decode("utf-8", "replace")
                        except OSError as error:
                            row["content_error"] = f"unreadable: {type(error).__name__}"
                    yield row

        yield from _frames(rows())

    files = (
        _files_below(spark, folder)
        .repartition(_tasks(spark), "full")
        .mapInPandas(contents, "file STRING, content STRING, content_error STRING")
    )
    pattern = r"^((?:@[^/]+/)?[^/]+)/([^/]+)/(.+)$"
    return files.select(
        F.regexp_extract("file", pattern, 1).alias("package"),
        F.regexp_extract("file", pattern, 2).alias("version"),
        F.regexp_extract("file", pattern, 3).alias("path"),
        "content",
        "content_error",
    ).where(F.col("path") != "")


def read_manifests(files: DataFrame) -> DataFrame:
    """The root ``package.json`` of each version, where it is a valid JSON object."""
    return files.where(
        (F.col("path") == "package.json") & parse_object(F.col("content"), "name STRING").isNotNull()
    ).select("package", "version", F.col("content").alias("manifest"))
