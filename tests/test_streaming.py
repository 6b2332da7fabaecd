"""The publication feed."""

import json
from pathlib import Path

import pytest

import depsieve as ds
from depsieve.streaming.feed import drain_to_table

CHANGES = [
    {"id": "a", "seq": 1, "doc": {"name": "a", "dist-tags": {"latest": "1.0.0"}}, "ingested_at": "2024-01-01T00:00:00Z"},
    {"id": "b", "seq": 2, "deleted": True, "ingested_at": "2024-01-01T00:00:01Z"},
    {"id": "c", "seq": 3, "doc": {"dist-tags": {"latest": "1.0.0"}}, "ingested_at": "2024-01-01T00:00:02Z"},
    {"id": "d", "seq": 4, "doc": {"name": "d", "dist-tags": {}}, "ingested_at": "2024-01-01T00:00:03Z"},
    {"id": "e", "seq": 5, "doc": {"name": "", "dist-tags": {"latest": "1"}}, "ingested_at": "2024-01-01T00:00:04Z"},
    {"id": "a", "seq": 6, "doc": {"name": "a", "dist-tags": {"latest": "1.0.0"}}, "ingested_at": "2024-01-01T00:00:05Z"},
    {"id": "f", "seq": 7, "doc": {"name": "f", "dist-tags": {"latest": "2.0.0"}}, "ingested_at": "2024-01-01T00:00:06Z"},
]


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "changes"
    folder.mkdir()
    for i, change in enumerate(CHANGES):
        (folder / f"{i}.json").write_text(json.dumps(change))
    return folder


def drained(stream, tmp_path, label="out"):
    query = drain_to_table(stream, str(tmp_path / label), str(tmp_path / f"{label}-state"))
    assert query.awaitTermination(120)
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / label))


def test_publications(spark, landing, tmp_path):
    rows = drained(ds.publications(ds.read_changes(spark, str(landing))), tmp_path).collect()
    assert sorted((r.seq, r.package, r.version) for r in rows) == [(1, "a", "1.0.0"), (6, "a", "1.0.0"), (7, "f", "2.0.0")]


def test_resume_and_checkpoint(spark, landing, tmp_path):
    stream = ds.publications(ds.resume_from_seq(ds.read_changes(spark, str(landing)), 5))
    assert sorted(r.seq for r in drained(stream, tmp_path).collect()) == [6, 7]
    new = {"id": "g", "seq": 8, "doc": {"name": "g", "dist-tags": {"latest": "1"}}}
    (landing / "8.json").write_text(json.dumps(new))
    assert sorted(r.seq for r in drained(stream, tmp_path).collect()) == [6, 7, 8]


def test_dedupe(spark, landing, tmp_path):
    stream = ds.dedupe_publications(ds.publications(ds.read_changes(spark, str(landing))))
    assert sorted(r.package for r in drained(stream, tmp_path).collect()) == ["a", "f"]


def test_scan_stream_is_idempotent(spark, landing, make_files, tmp_path):
    files = make_files(("a", "1.0.0", "x.js", "fs.rm(a)"), ("f", "2.0.0", "x.js", "fetch(u)"), ("z", "1", "x.js", "fetch(u)"))
    extra = {"id": "h", "seq": 9, "doc": {"name": "h", "dist-tags": {"latest": "1"}}}
    (landing / "9.json").write_text(json.dumps(extra))
    popular = ds.popular_packages(spark)

    def scan(batch):
        return ds.scan_packages(files, batch, popular)

    out = str(tmp_path / "alerts")
    stream = ds.publications(ds.read_changes(spark, str(landing), files_per_trigger=3))
    kept = lambda: {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("depsieve/*")}
    before = kept()
    for state in ("one", "two"):  # a lost checkpoint replays all batches
        query = ds.scan_stream(stream, scan, out, str(tmp_path / state), available_now=True, files=files, run="feed")
        assert query.awaitTermination(300)
        rows = spark.read.option("basePath", out).parquet(out).collect()
        assert sorted((r.package, r.alert_type) for r in rows) == [
            ("a", "filesystem_access"), ("a", "filesystem_access"), ("f", "network_access"),
        ]
        errors = spark.read.option("basePath", f"{out}-errors").parquet(f"{out}-errors").collect()
        assert [(r.package, r.reason) for r in errors] == [("h", "no files")]
    assert kept() == before  # intermediate tables of the batches are gone
    # A new checkpoint on other changes keeps the alerts that are there.
    later = ds.publications(ds.resume_from_seq(ds.read_changes(spark, str(landing)), 8))
    query = ds.scan_stream(later, scan, out, str(tmp_path / "three"), available_now=True, files=files)
    assert query.awaitTermination(300)
    assert spark.read.option("basePath", out).parquet(out).count() == 3


def test_quarantine(spark, make_files):
    files = spark.createDataFrame(
        [("a", "1", "x.js", "ok", None), ("b", "1", "x.js", "ok", None), ("b", "1", "y.js", None, "larger than 9 bytes"), ("c", "1", None, None, "bad archive: ReadError")],
        "package STRING, version STRING, path STRING, content STRING, content_error STRING",
    )
    published = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "package STRING, version STRING")
    good, bad = ds.quarantine(published, files)
    assert [r.package for r in good.collect()] == ["a"]
    assert sorted((r.package, r.reason) for r in bad.collect()) == [
        ("b", "1 unreadable file(s)"), ("c", "1 unreadable file(s)"), ("d", "no files"),
    ]
