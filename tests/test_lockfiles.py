"""Lockfile entries, indicator matches and their alerts."""

import json
import random
import re

import pytest

import depsieve as ds

NPM, YARN, PNPM = "package-lock.json", "yarn.lock", "pnpm-lock.yaml"


@pytest.fixture
def locks(spark):
    def make(*texts, project="p"):
        rows = [(project, f"{project}/{name}", name, text) for name, text in texts]
        return spark.createDataFrame(rows, "project STRING, path STRING, file_name STRING, content STRING")

    return make


def entries(df):
    return [(r.package, r.version) for r in df.orderBy("file_name", "ord").collect()]


# --- npm -------------------------------------------------------------------------


@pytest.mark.parametrize(
    "lock, expected",
    [
        ({"dependencies": {"z": {"version": "1"}, "a": {"version": "2"}}}, [("z", "1"), ("a", "2")]),
        (
            {"packages": {"": {"name": "me", "version": "0.1"}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/b": {"version": "2"}, "node_modules/@s/c": {"version": "3"}}},
            [("", "0.1"), ("a", "1"), ("a/b", "2"), ("@s/c", "3")],
        ),
        ({"packages": {}, "dependencies": {"a": {"version": "1"}}}, []),
        ({"packages": None, "dependencies": {"a": {"version": "1"}}}, [("a", "1")]),
        ({"packages": [], "dependencies": {"a": {"version": "1"}}}, []),
        ({"dependencies": {"a": None, "b": 5, "c": "x", "d": [1], "e": {}, "f": {"version": ""}, "g": {"version": 7}, "h": {"version": "1"}}}, [("g", "7"), ("h", "1")]),
        ({}, []),
    ],
)
def test_npm(locks, lock, expected):
    assert entries(ds.npm_lock_entries(locks((NPM, json.dumps(lock))))) == expected


def test_npm_repeated_keys(locks):
    text = '{"packages":{"a":{"version":"1"},"b":{"version":"1","version":"2"},"a":{"version":"3"}}}'
    assert entries(ds.npm_lock_entries(locks((NPM, text)))) == [("a", "3"), ("b", "2")]


def test_npm_invalid(locks):
    assert entries(ds.npm_lock_entries(locks((NPM, '{"packages":{"a":{"version":"1"}}')))) == []


# --- yarn and pnpm against the plain patterns ------------------------------------

YARN_PATTERN = re.compile(
    r"""^(?:"?([^@\s"]+)@[^":\n]+"?\s*(?:,\s*"?[^@\s"]+@[^":\n]+"?)*):\s*\n(?:[ \t]+.*\n)*?[ \t]+version[: ]+"?(\d[\d.a-zA-Z\-+]*)"?""",
    re.M,
)
PNPM_PATTERN = re.compile(r"^\s+/?([a-zA-Z0-9@._\-/]+?)[@/](\d+\.\d+\.\d+[^\s:]*):", re.M)


def test_yarn_cases(locks):
    text = (
        '# yarn lockfile v1\n\n"axios@^1.14.1", "axios@~1.14.0":\n  version "1.14.1"\n  resolved "x"\n\n'
        "left-pad@^1.0.0, left-pad@~1.0:\n  resolved x\n  version: 1.3.0-beta+1\n\n"
        '"@scope/a@^1":\n  version "1.0.0"\n\n"b@npm:^2":\n  version: 2.0.0\n\npatch:c@1:\n  version "3.0.0"\n'
    )
    assert entries(ds.yarn_lock_entries(locks((YARN, text)))) == [
        ("axios", "1.14.1"), ("left-pad", "1.3.0-beta+1"), ("c", "3.0.0"),
    ]
    assert entries(ds.yarn_lock_entries(locks((YARN, text)), nested="leaf")) == [
        ("axios", "1.14.1"), ("left-pad", "1.3.0-beta+1"), ("@scope/a", "1.0.0"), ("b", "2.0.0"), ("c", "3.0.0"),
    ]


def test_yarn_long_block_without_version(locks):
    text = "a@1:\n" + "  x y\n" * 200_000 + "b@1:\n  version 1.0.0\n"
    assert entries(ds.yarn_lock_entries(locks((YARN, text)))) == [("b", "1.0.0")]


def test_yarn_equals_plain_pattern(spark, locks):
    rnd = random.Random(6)
    tokens = ["a@1:\n", '"b@^2", "b@3":\n', "c@1, d@2:\n", "  version 1.2\n", '\tversion "2.0-x"\n', "  other x\n", "\n", "e:\n", "  version: 3\n", '"@s/f@1":\n', "g@npm:1:\n", "  versions 4\n", "h@1:  \n", " \n", '  "a@1":\n']
    texts = ["".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 12))) for _ in range(4000)]
    rows = [(str(i), "p", YARN, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "project STRING, path STRING, file_name STRING, content STRING").repartition(8)
    ours = {}
    for r in ds.yarn_lock_entries(df).orderBy("ord").collect():
        ours.setdefault(int(r.project), []).append((r.package, r.version))
    for i, text in enumerate(texts):
        plain = [(re.sub("^[^:]+:", "", m[1]), m[2]) for m in YARN_PATTERN.finditer(text)]
        assert ours.get(i, []) == plain, repr(text)


def test_pnpm_cases(locks):
    text = "packages:\n\n  /a/1.2.3:\n    x: 1\n  /b@1.2.3:\n  c@1.2.3:\n  c@1.2.3:\n  /@s/d@4.5.6:\n  e@1.0.0(f@2.0.0):\n"
    assert entries(ds.pnpm_lock_entries(locks((PNPM, text)))) == [
        ("a", "1.2.3"), ("b", "1.2.3"), ("c", "1.2.3"), ("@s/d", "4.5.6"), ("e", "1.0.0(f@2.0.0)"),
    ]
    leaf = entries(ds.pnpm_lock_entries(locks((PNPM, text + "  '@q/g@1.0.0':\n")), nested="leaf"))
    assert leaf[-2:] == [("e", "1.0.0"), ("@q/g", "1.0.0")]


def test_pnpm_equals_plain_pattern(spark):
    rnd = random.Random(7)
    tokens = ["a@1.2.3:", "/b/1.2.3:", " ", "  ", "\n", "\n\n", "@s/c@1.0.0:", "1.2.3", "/", "@", "x", ":", "(y@2.0.0)", "\t", "-1", "4.5.6:"]
    texts = ["".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 14))) for _ in range(8000)]
    rows = [(str(i), "p", PNPM, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "project STRING, path STRING, file_name STRING, content STRING").repartition(8)
    ours = {}
    for r in ds.pnpm_lock_entries(df).orderBy("ord").collect():
        ours.setdefault(int(r.project), []).append((r.package, r.version))
    for i, text in enumerate(texts):
        plain = list(dict.fromkeys((re.sub("^/", "", m[1]), m[2]) for m in PNPM_PATTERN.finditer(text)))
        assert ours.get(i, []) == plain, repr(text)


def test_npm_leaf(locks):
    lock = {"packages": {"node_modules/a/node_modules/@s/b": {"version": "2"}, "node_modules/c": {"version": "1"}}}
    assert entries(ds.npm_lock_entries(locks((NPM, json.dumps(lock))), nested="leaf")) == [("@s/b", "2"), ("c", "1")]


# --- matches ---------------------------------------------------------------------

LOCK = json.dumps({"packages": {"node_modules/plain-crypto-js": {"version": "4.2.1"}, "node_modules/axios": {"version": "1.14.1"}, "node_modules/ok": {"version": "1.0.0"}}})


def test_alerts_of_all_formats(spark, locks):
    files = locks((PNPM, "packages:\n  /axios/0.30.4:\n"), (YARN, 'axios@^1:\n  version "1.14.0"\n'), (NPM, LOCK))
    alerts = ds.lockfile_alerts(files, ds.known_bad_table(spark)).orderBy("alert_ord").collect()
    assert [a.message for a in alerts] == [
        "IOC dependency plain-crypto-js@4.2.1 found in package-lock.json — associated with a known supply chain incident",
        "Known-compromised version axios@1.14.1 found in package-lock.json (Axios npm supply chain compromise)",
        "Known-compromised version axios@0.30.4 found in pnpm-lock.yaml (Axios npm supply chain compromise)",
    ]
    assert {a.severity for a in alerts} == {"high"}
    assert alerts[1].details.file == "p/package-lock.json" and alerts[1].details.package == "axios"


def _bad(spark, *rows):
    full = [(p, v, i, "2024-01-01", "d", deps, None, o) for o, (p, v, i, deps) in enumerate(rows)]
    return spark.createDataFrame(
        full,
        "package STRING, version STRING, incident STRING, date STRING, description STRING, "
        "malicious_dependencies ARRAY<STRING>, references ARRAY<STRING>, entry_ord LONG",
    )


def test_first_entry_wins_and_one_entry_can_match_twice(spark, locks):
    bad = _bad(spark, ("axios", "1.14.1", "one", ["axios"]), ("axios", "1.14.1", "two", None))
    alerts = ds.lockfile_alerts(locks((NPM, LOCK)), bad).orderBy("alert_ord").collect()
    assert [a.message.split(" ")[0] for a in alerts] == ["Known-compromised", "IOC"]
    assert alerts[0].message.endswith("(one)")


def test_ioc_dependencies(spark):
    bad = _bad(spark, ("a", "1", "x", ["m", "n"]), ("b", "1", "y", ["m"]), ("c", "1", "z", None))
    assert sorted(r.package for r in ds.ioc_dependencies(bad).collect()) == ["m", "n"]


def test_known_compromised_only_when_gone(spark):
    requests = spark.createDataFrame([("axios", "1.14.1"), ("axios", "0.30.4"), ("axios", "9.9.9")], "package STRING, version STRING")
    registry = spark.createDataFrame([("axios", "0.30.4")], "package STRING, version STRING")
    bad = ds.known_bad_table(spark)
    (row,) = ds.known_compromised_alerts(requests, registry, bad).collect()
    assert row.message == "axios@1.14.1 is a known-compromised version that was removed from npm"
    assert row.details.incident == "Axios npm supply chain compromise" and row.details.date == "2025-03-26"
    assert list(row.details.malicious_dependencies) == ["plain-crypto-js"] and len(row.details.references) == 2
    assert ds.known_compromised_alerts(requests, registry, bad, include_available=True).count() == 2
    gone = ds.unavailable_requests(requests, registry).collect()
    assert sorted(r.version for r in gone) == ["1.14.1", "9.9.9"]


def test_incident_lockfiles(spark, locks, monkeypatch):
    requests = spark.createDataFrame(
        [("p", "axios", "1.14.1"), ("q", "axios", "9.9.9")], "project STRING, package STRING, version STRING"
    )
    registry = spark.createDataFrame([("x", "1")], "package STRING, version STRING")
    bad = ds.known_bad_table(spark)
    files = locks((NPM, LOCK)).unionByName(locks((NPM, LOCK), project="q"))
    found = []
    for limit in (100_000, 0):
        monkeypatch.setattr("depsieve.operators.ioc.BROADCAST_PROJECTS", limit)
        incidents = ds.known_compromised_alerts(requests, registry, bad)
        rows = ds.incident_lockfile_alerts(incidents, files, bad).collect()
        found.append(sorted((r.project, r.package, r.version, r.details.package) for r in rows))
    assert found[0] == found[1] == [("p", "axios", "1.14.1", "axios"), ("p", "axios", "1.14.1", "plain-crypto-js")]


def test_hostile_lockfiles_finish(locks):
    n = 50_000
    header = ", ".join(f'"a@{i}"' for i in range(20_000))
    deep = '{"packages":{"node_modules/x":{"version":"1","d":' + "[" * 5000 + "]" * 5000 + "}}}"
    files = locks(
        (YARN, header + ':\n  version "1.0.0"\n'),
        (YARN, "a@1:\n" + "\n" * n + " \n" * n),
        (YARN, "a" * n + "@" * n + ":" * n),
        (PNPM, "\n" * n + " " * n + "a/1.1.1" * n + "\n" + "  b@1.0.0:\n"),
        (PNPM, "  " + "a/" * n + ":\n"),
        (NPM, deep),
        (NPM, '{"packages":{' + ",".join(f'"node_modules/p{i}":{{"version":"1"}}' for i in range(20_000)) + "}}"),
    )
    assert set(entries(ds.yarn_lock_entries(files))) == {("a", "1.0.0")}
    assert entries(ds.pnpm_lock_entries(files)) == [("b", "1.0.0")]
    assert ds.npm_lock_entries(files).count() == 20_000


def test_matches_need_no_left_join(spark):
    lockfiles = spark.createDataFrame([], "project STRING, path STRING, file_name STRING, content STRING")
    plan = ds.lockfile_alerts(lockfiles, ds.known_bad_table(spark))._jdf.queryExecution().analyzed().toString()
    assert "LeftOuter" not in plan and plan.count("Join Inner") == 1
