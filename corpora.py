"""Package-like relations derived from the supplied tables.

The supplied tables hold no packages, so the registered queries run on relations that
SQL derives from whole tables. Each text below is valid in Spark and in DuckDB, so
both sides of a comparison start from the same rows. One package version ("hub")
holds a third of all files on purpose.
"""

from __future__ import annotations

import io
import json
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsieve.session import new_folder

PACKAGE_FILES = r"""
select case when doc_id % 3 = 0 then 'hub' else concat('pkg-', cast(floor(doc_id / 12) as bigint)) end as package,
 concat('1.', doc_id % 3, '.0') as version,
 concat(case when doc_id % 11 = 0 then 'node_modules/x/' when doc_id % 13 = 0 then '.github/' else 'src/' end, 'f', doc_id,
        case doc_id % 5 when 0 then '.js' when 1 then '.ts' when 2 then '.mjs' when 3 then '.md' else '.cjs' end) as path,
 concat(case doc_id % 8
   when 0 then concat('const http = require(', chr(34), 'http', chr(34), ');')
   when 1 then concat('import fs from ', chr(34), 'fs', chr(34), '; fs.writeFileSync(p, d); fs.rm(p);')
   when 2 then concat('const { exec } = require(', chr(34), 'child_process', chr(34), '); exec(', chr(34), 'bash -c id', chr(34), ');')
   when 3 then 'await fetch(u); new WebSocket(u);'
   when 4 then repeat('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!@#%^&*()_+-=[]{}|;:,.<>?', 200)
   when 5 then concat('import {', chr(10), ' a', chr(10), '} from ', chr(34), 'got', chr(34), ';')
   when 6 then concat('// fetch(x)', chr(10), '/* new WebSocket(u) */ const s = ', chr(34), 'fetch(1)', chr(34), ';', chr(10), 'import ', chr(34), 'dns', chr(34), ';')
   else 'function add(a, b) { return a + b; }' end, chr(10), text) as content
from documents
"""

MANIFESTS = r"""
select package, version, concat('{', chr(34), 'name', chr(34), ':', chr(34), package, chr(34), ',', chr(34), 'scripts', chr(34), ':{',
   chr(34), case d % 4 when 0 then 'postinstall' when 1 then 'preinstall' when 2 then 'test' else 'install' end, chr(34), ':',
   case when d % 5 = 0 then 'false' else concat(chr(34), 'node s', d, '.js', chr(34)) end, '}}') as manifest, d
from (select case when doc_id % 3 = 0 then 'hub' else concat('pkg-', cast(floor(doc_id / 12) as bigint)) end as package,
             concat('1.', doc_id % 3, '.0') as version, max(doc_id) as d
      from documents group by 1, 2) x
"""

# At most 50 parts per project, so a project's lockfile stays one small text.
LOCK_PAIRS = r"""
select concat('proj-', cast(floor(p_partkey / 50) as bigint)) as project, replace(p_name, ' ', '-') as package,
 max(concat('1.', p_size % 4, '.', p_partkey % 3)) as version
from part group by 1, 2
"""

# Two overlapping batches of incidents; the earlier entry of a version counts.
KNOWN_BAD = r"""
select package, version, concat(batch, ' of ', package) as incident, '2024-01-01' as date,
 concat('bad ', version, ' of ', package) as description, replace(package, stem, 'cold-') as malicious_dependency, entry_ord
from (
 select replace(p_name, ' ', '-') as package, concat('1.', p_size % 4, '.', p_partkey % 3) as version, 'hot-' as stem,
  'First wave' as batch, min(p_partkey) as entry_ord from part where p_name like 'hot %' group by 1, 2
 union all
 select replace(p_name, ' ', '-'), concat('1.', p_size % 4, '.', p_partkey % 3), 'hot-', 'Second wave', max(p_partkey) + 1000000000
 from part where p_name like 'hot r%' or p_name like 'red %' group by 1, 2
) w
"""

# A project asks for all versions of the parts it uses; the registry lacks some.
REQUESTS = r"""
select distinct concat('proj-', cast(floor(p_partkey / 50) as bigint)) as project, replace(p_name, ' ', '-') as package,
 concat('1.', p_size % 4, '.', p_partkey % 3) as version
from part
"""
REGISTRY = r"""
select distinct replace(p_name, ' ', '-') as package, concat('1.', p_size % 4, '.', p_partkey % 3) as version
from part where p_name not like 'hot %' or p_size % 4 = 3
"""

CHANGES = r"""
select event_id as seq, case when event_type = 'error' then null else concat('pkg-', user_id % 40) end as name,
 case when event_type = 'error' then null else concat('1.', event_id % 3, '.0') end as version, ts
from events
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in ("documents", "part", "events", "pages") if f"from {t}" in sql]
    tables(spark, sf_dir, *used)
    return spark.sql(sql)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a table that was written as one small file.

    A table with at least as many scan tasks as the cluster has cores is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    docs.createOrReplaceTempView("documents")
    return spark.sql(PACKAGE_FILES).withColumn("content_error", F.lit(None).cast("string"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, MANIFESTS).drop("d")


def known_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, KNOWN_BAD).select(
        "package", "version", "incident", "date", "description",
        F.array("malicious_dependency").alias("malicious_dependencies"),
        F.array(F.lit("https://example.org/advisory")).alias("references"),
        "entry_ord",
    )


def known_bad_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same incidents as feed entries (one per batch and package, up to 12 versions)."""
    rows = derived(spark, sf_dir, KNOWN_BAD)
    return rows.groupBy("package", "incident", "date", "malicious_dependency").agg(
        F.collect_set("version").alias("versions"), F.min("entry_ord").alias("entry_ord")
    ).select(
        "package", "versions", "incident", "date",
        F.struct(
            F.array("malicious_dependency").alias("maliciousDependencies"),
            F.concat(F.lit("bad "), F.col("package")).alias("description"),
            F.array(F.lit("https://example.org/advisory")).alias("references"),
        ).alias("ioc"),
        "entry_ord",
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a lower-case ASCII word in the documents, as a package name."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("package"))


# --- lockfile texts --------------------------------------------------------------

_NPM_ENTRY = '"node_modules/{p}":{{"version":"{v}"}}'


def _lock_text(kind: str) -> str:
    """SQL for one project's lockfile text from its sorted (package, version) pairs."""
    q = "chr(34)"
    if kind == "package-lock.json":
        entry = (
            f"concat({q}, 'node_modules/', e.package, {q}, ':', '{{', {q}, 'version', {q}, ':', {q}, e.version, {q}, '}}')"
        )
        return (
            f"concat('{{', {q}, 'lockfileVersion', {q}, ':3,', {q}, 'packages', {q}, ':{{', {q}, {q}, ':{{}},', "
            f"concat_ws(',', transform(pairs, e -> {entry})), '}}}}')"
        )
    if kind == "yarn.lock":
        entry = (
            f"concat(e.package, '@^', e.version, ', ', e.package, '@~', e.version, ':', chr(10), '  version ', {q}, e.version, {q}, "
            f"chr(10), '  resolved ', {q}, 'https://example.org/x.tgz', {q}, chr(10))"
        )
        return f"concat('# yarn lockfile v1', chr(10), chr(10), concat_ws(chr(10), transform(pairs, e -> {entry})))"
    entry = "concat('  /', e.package, '@', e.version, ':', chr(10), '    resolution: {{}}', chr(10))".replace("{{}}", "{}")
    return f"concat('lockfileVersion: 6', chr(10), 'packages:', chr(10), concat_ws(chr(10), transform(pairs, e -> {entry})))"


def lockfiles(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """A lockfile per project and format, written from the same pairs (at most 50)."""
    kinds = kinds or ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")
    pairs = (
        derived(spark, sf_dir, LOCK_PAIRS)
        .groupBy("project")
        .agg(F.sort_array(F.collect_list(F.struct("package", "version"))).alias("pairs"))
    )
    texts = F.array(
        *[F.struct(F.lit(k).alias("file_name"), F.expr(_lock_text(k)).alias("content")) for k in kinds]
    )
    return pairs.select("project", F.inline(texts)).select(
        "project", F.concat_ws("/", "project", "file_name").alias("path"), "file_name", "content"
    )


def nested_lockfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lockfiles in the spellings that only the wider rules read."""
    rows = derived(spark, sf_dir, LOCK_PAIRS)
    q = '"'
    npm = F.format_string(
        '{"packages":{"node_modules/host/node_modules/%s":{"version":"%s"},"node_modules/@s/%s":{"version":"%s"}}}',
        "package", "version", "package", "version",
    )
    yarn = F.format_string(
        f'{q}@s/%s@npm:^%s{q}:\n  version: %s\n\n{q}%s@npm:%s{q}:\n  version: %s\n',
        "package", "version", "version", "package", "version", "version",
    )
    pnpm = F.format_string(
        "packages:\n\n  '@s/%s@%s':\n    a: 1\n\n  /%s@%s(peer@2.0.0):\n    a: 1\n",
        "package", "version", "package", "version",
    )
    texts = F.array(
        *[
            F.struct(F.lit(k).alias("file_name"), t.alias("content"))
            for k, t in (("package-lock.json", npm), ("yarn.lock", yarn), ("pnpm-lock.yaml", pnpm))
        ]
    )
    own = F.concat_ws("/", "project", "package")
    return rows.select(own.alias("project"), F.inline(texts)).select(
        "project", F.concat_ws("/", "project", "file_name").alias("path"), "file_name", "content"
    )


def dependency_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest per project: all pairs as dependencies, those of version 1.0.x again as devDependencies."""
    pairs = (
        derived(spark, sf_dir, LOCK_PAIRS)
        .groupBy("project")
        .agg(F.sort_array(F.collect_list(F.struct("package", "version"))).alias("pairs"))
    )
    as_json = lambda prefix, source: F.to_json(
        F.map_from_entries(
            F.transform(source, lambda e: F.struct(e["package"], F.concat(F.lit(prefix), e["version"])))
        )
    )
    dev = F.filter("pairs", lambda e: e["version"].startswith("1.0."))
    text = F.concat(
        F.lit('{"dependencies":'), as_json("^", F.col("pairs")),
        F.lit(',"devDependencies":'), as_json("~9.", dev), F.lit("}"),
    )
    return pairs.select("project", text.alias("manifest"))


# --- landing folders -------------------------------------------------------------


def land(rows: DataFrame, folder: str) -> str:
    """Write (path, data) rows as files under the shared ``folder``, one task per partition."""

    def write(batches):
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        made = set()
        for batch in batches:
            for path, data in zip(batch["path"], batch["data"]):
                full = f"{base}/{path}"
                if (parent := full.rsplit("/", 1)[0]) not in made:
                    target.create_dir(parent, recursive=True)
                    made.add(parent)
                with target.open_output_stream(full) as out:
                    out.write(bytes(data))
            yield pd.DataFrame({"files": [len(batch)]})

    rows.select("path", F.col("data").cast("binary").alias("data")).mapInPandas(write, "files LONG").write.format(
        "noop"
    ).mode("overwrite").save()
    return folder


def uri(folder: str) -> str:
    """A folder as pyarrow and Spark both accept it."""
    return folder.replace("file:///", "/").replace("file:/", "/") if folder.startswith("file:") else folder


def landing(spark: SparkSession, label: str) -> str:
    return uri(new_folder(spark, label))


def land_archives(spark: SparkSession, sf_dir: str) -> str:
    """One .tgz per document: its file and a manifest, under a leading folder; some thousands in a folder."""
    doc = F.regexp_extract("path", r"f(\d+)\.", 1)
    files = package_files(spark, sf_dir).select(
        F.concat(F.floor(doc.cast("long") / 4096), F.lit("/doc-"), doc, F.lit("-1.0.0.tgz")).alias("path"),
        F.col("path").alias("member"),
        "content",
    )

    def build(batches):
        held, size = [], 0
        for batch in batches:
            for path, member, content in zip(batch["path"], batch["member"], batch["content"]):
                buffer = io.BytesIO()
                with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as archive:
                    for name, text in ((member, content), ("package.json", json.dumps({"name": member}))):
                        data = text.encode("utf-8")
                        info = tarfile.TarInfo(f"package/{name}")
                        info.size = len(data)
                        archive.addfile(info, io.BytesIO(data))
                held.append((path, buffer.getvalue()))
                size += 100 + len(held[-1][1])
                if size >= 4 << 20:
                    yield pd.DataFrame(held, columns=["path", "data"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", "data"])

    return land(files.mapInPandas(build, "path STRING, data BINARY"), landing(spark, "archives"))


def land_tree(spark: SparkSession, sf_dir: str) -> str:
    files = package_files(spark, sf_dir)
    rows = files.select(F.concat_ws("/", "package", "version", "path").alias("path"), F.col("content").alias("data"))
    return land(rows, landing(spark, "tree"))


def land_lockfiles(spark: SparkSession, sf_dir: str) -> str:
    texts = lockfiles(spark, sf_dir)
    rows = texts.select("path", F.col("content").alias("data")).unionByName(
        texts.select(F.concat(F.col("project"), F.lit("/sub/"), F.col("file_name")).alias("path"), F.lit("x").alias("data"))
    )
    return land(rows, landing(spark, "lockfiles"))


def land_changes(spark: SparkSession, sf_dir: str) -> str:
    """The events as change documents: JSON lines in a landing folder."""
    folder = new_folder(spark, "changes")
    rows = derived(spark, sf_dir, CHANGES)
    doc = F.struct(F.col("name").alias("name"), F.struct(F.col("version").alias("latest")).alias("dist-tags"))
    rows.select(
        F.coalesce("name", F.lit("?")).alias("id"),
        "seq",
        F.col("name").isNull().alias("deleted"),
        F.array(F.struct(F.concat(F.lit("1-"), F.col("seq").cast("string")).alias("rev"))).alias("changes"),
        F.when(F.col("name").isNotNull(), doc).alias("doc"),
        F.col("ts").cast("timestamp").alias("ingested_at"),
    ).write.json(folder)
    return folder
