"""Archives, trees, lockfile folders, indicator feeds and the alert table."""

import gzip
import io
import json
import random
import tarfile

import pytest

import depsieve as ds
from depsieve.operators.ioc import first_known_bad
from depsieve.schemas import alert_rows, details


def _tgz(path, members):
    with tarfile.open(path, "w:gz") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "a.js"
                archive.addfile(info)
            else:
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))


def test_archives(spark, tmp_path):
    _tgz(tmp_path / "left-pad-1.3.0.tgz", [
        ("package/a.js", b"x"), ("package/lib/_b.js", b"\xff\xc3y"), ("package/link.js", None), ("top.js", b"z"),
        ("other/big.js", b"0" * 5000), ("./package/c.js", b"c"), ("package/../../evil.js", b"e"),
    ])
    _tgz(tmp_path / "@s-name-2.0.0-beta.1.tgz", [("package/package.json", b"{}")])
    (tmp_path / "bad-1.0.0.tgz").write_bytes(b"not an archive")
    (tmp_path / "ignored.zip").write_bytes(b"")
    rows = ds.ingest_archives(spark, str(tmp_path), max_bytes=1000).collect()
    found = {(r.package, r.version, r.path): (r.content, r.content_error) for r in rows}
    assert found == {
        ("left-pad", "1.3.0", "a.js"): ("x", None),
        ("left-pad", "1.3.0", "lib/_b.js"): ("��y", None),
        ("left-pad", "1.3.0", "big.js"): (None, "larger than 1000 bytes"),
        ("left-pad", "1.3.0", "c.js"): ("c", None),
        ("@s-name", "2.0.0-beta.1", "package.json"): ("{}", None),
        ("bad", "1.0.0", None): (None, "bad archive: ReadError"),
    }


def test_many_small_archives_take_few_tasks(spark, tmp_path):
    for k in range(120):
        folder = tmp_path / f"{k % 3}" / f"{k % 5}"
        folder.mkdir(parents=True, exist_ok=True)
        _tgz(folder / f"p{k}-1.0.0.tgz", [("package/a.js", b"x" * k)])
    for hidden in (tmp_path / "_h-1.0.0.tgz", tmp_path / ".h" / "h-1.0.0.tgz", tmp_path / "0" / ".h-1.0.0.tgz"):
        hidden.parent.mkdir(exist_ok=True)
        _tgz(hidden, [("package/a.js", b"x")])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        for folder in (str(tmp_path), f"{tmp_path}/[0-2]"):
            files = ds.ingest_archives(spark, folder)
            assert files.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
            assert {(r.package, len(r.content)) for r in files.collect()} == {(f"p{k}", k) for k in range(120)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_damaged_archives_are_reported(spark, tmp_path):
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w:gz") as archive:
        for k in range(3):
            info = tarfile.TarInfo(f"package/f{k}.js")
            info.size = 4000
            archive.addfile(info, io.BytesIO(random.Random(k).randbytes(4000)))
    data = whole.getvalue()
    rnd, names = random.Random(1), set()
    for k in range(30):
        at = rnd.randrange(20, len(data) - 8)
        (tmp_path / f"p{k}-1.0.0.tgz").write_bytes(data[:at] + bytes(b ^ 0x5A for b in data[at : at + 8]) + data[at + 8 :])
        names.add(f"p{k}")
    (tmp_path / "cut-1.0.0.tgz").write_bytes(data[:-30])
    raw = bytearray(gzip.decompress(data))
    raw[4608 : 4608 + 100] = b"x" * 100  # the second header
    (tmp_path / "header-1.0.0.tgz").write_bytes(gzip.compress(bytes(raw)))
    (tmp_path / "good-1.0.0.tgz").write_bytes(data)
    rows = ds.ingest_archives(spark, str(tmp_path)).collect()
    assert {r.package for r in rows if r.content_error and r.path is None} == names | {"cut", "header"}
    assert [r.path for r in rows if r.package == "good"] == ["f0.js", "f1.js", "f2.js"]


def test_scoped_and_unnamed_archives(spark, tmp_path):
    manifest = json.dumps({"name": "@s/name"}).encode()
    _tgz(tmp_path / "@s-name-1.0.0.tgz", [("package/a.js", b"a"), ("package/package.json", manifest)])
    _tgz(tmp_path / "other-1.0.0.tgz", [("package/a.js", b"a"), ("package/package.json", manifest)])
    _tgz(tmp_path / "first.tgz", [("package/a.js", b"a")])
    _tgz(tmp_path / "second.tgz", [("package/a.js", b"a")])
    rows = {(r.package, r.version, r.content_error) for r in ds.ingest_archives(spark, str(tmp_path)).collect()}
    error = "no version in the archive's name"
    assert rows == {("@s/name", "1.0.0", None), ("other", "1.0.0", None), ("first", "", error), ("second", "", error)}


def test_known_bad_without_places(spark):
    rows = [("p", "1", "b", None), ("p", "1", "a", None), ("q", "1", "z", 1), ("q", "1", "a", None)]
    schema = "package STRING, version STRING, incident STRING, entry_ord LONG"
    known = spark.createDataFrame(rows, schema).selectExpr(
        "*", "'d' as date", "'x' as description", "array('m') as malicious_dependencies", "array('r') as references"
    )
    assert {r.package: r.incident for r in first_known_bad(known).collect()} == {"p": "a", "q": "z"}
    assert {r.package: r.incident for r in first_known_bad(known.drop("entry_ord")).collect()} == {"p": "a", "q": "a"}


def test_alert_types_of_own_detectors(spark, tmp_path):
    base = spark.createDataFrame([("p", "1")], "package STRING, version STRING")
    own = alert_rows(base, "long_file", "low", "m", details())
    with pytest.raises(Exception, match="not an alert"):
        ds.write_alerts(own, str(tmp_path / "t"))
    ds.write_alerts(own, str(tmp_path / "u"), extra_types=("long_file",))
    assert ds.read_alerts(spark, str(tmp_path / "u"), ("long_file",), extra_types=("long_file",)).count() == 1


def test_tree_reads_hidden_and_underscored_files(spark, tmp_path):
    for path in ("a/1.0.0/src/x.js", "a/1.0.0/.github/y.js", "a/1.0.0/_z.js", "@s/b/2.0.0/w w+%.js", "@s/b/2.0.0/big.js"):
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text("0" * 500 if "big" in path else path, encoding="utf-8")
    rows = {(r.package, r.version, r.path): r for r in ds.read_package_tree(spark, str(tmp_path), max_bytes=100).collect()}
    assert set(rows) == {
        ("a", "1.0.0", "src/x.js"), ("a", "1.0.0", ".github/y.js"), ("a", "1.0.0", "_z.js"),
        ("@s/b", "2.0.0", "w w+%.js"), ("@s/b", "2.0.0", "big.js"),
    }
    assert rows[("a", "1.0.0", "_z.js")].content == "a/1.0.0/_z.js"
    assert rows[("@s/b", "2.0.0", "big.js")].content_error == "larger than 100 bytes"


def test_lockfile_folder(spark, tmp_path):
    for path in ("p/yarn.lock", "p/package-lock.json", "p/sub/yarn.lock", "q q/pnpm-lock.yaml", "q q/other.lock"):
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text("a\nb\n")
    rows = ds.read_lockfiles(spark, str(tmp_path)).collect()
    assert sorted((r.project, r.path, r.file_name, r.content, r.kind_ord) for r in rows) == [
        ("p", "p/package-lock.json", "package-lock.json", "a\nb\n", 0),
        ("p", "p/yarn.lock", "yarn.lock", "a\nb\n", 1),
        ("q q", "q q/pnpm-lock.yaml", "pnpm-lock.yaml", "a\nb\n", 2),
    ]


def test_known_bad_feed(spark, tmp_path):
    entry = {"package": "a", "versions": ["1", "2"], "incident": "i", "date": "d", "ioc": {"description": "x"}, "entry_ord": 0}
    (tmp_path / "feed.json").write_text(json.dumps(entry))
    rows = ds.known_bad_table(spark, str(tmp_path / "feed.json")).collect()
    assert sorted((r.package, r.version, r.malicious_dependencies) for r in rows) == [("a", "1", None), ("a", "2", None)]
    seed = ds.known_bad_table(spark).collect()
    assert sorted(r.version for r in seed) == ["0.30.4", "1.14.1"]
    assert ds.ioc_dependencies(ds.known_bad_table(spark)).first().package == "plain-crypto-js"


def test_alert_table(spark, tmp_path):
    base = spark.createDataFrame([("p", "1")], "package STRING, version STRING")
    two = alert_rows(base, "typosquat", "high", "m", details()).unionByName(
        alert_rows(base, "network_access", "medium", "m", details())
    )
    ds.write_alerts(two, str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t").glob("alert_type=*")} == {"alert_type=typosquat", "alert_type=network_access"}
    only = ds.read_alerts(spark, str(tmp_path / "t"), ("typosquat",))
    assert [r.scanned_at is not None for r in only.collect()] == [True]
    with pytest.raises(Exception, match="not an alert"):
        ds.write_alerts(alert_rows(base, "typosquat", "fatal", "m", details()), str(tmp_path / "u"))
    with pytest.raises(ValueError):
        ds.read_alerts(spark, str(tmp_path / "t"), ("nonsense",))
