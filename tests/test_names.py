"""Look-alike names and the popular list."""

import random

import pytest

import depsieve as ds


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "package STRING")


def alert(spark, name):
    pairs = ds.typosquat_pairs(names(spark, name), ds.popular_packages(spark))
    return ds.typosquat_alerts(pairs).collect()


@pytest.mark.parametrize("name, target", [("chalkk", "chalk"), ("mogoose", "mongoose"), ("requost", "request")])
def test_one_edit(spark, name, target):
    (row,) = alert(spark, name)
    assert (row.alert_type, row.severity) == ("typosquat", "high")
    assert row.details.suspicious_matches[0].package == target
    assert row.details.target_package == name
    assert row.message == f'Potential typosquat of popular package "{target}" (distance: 1)'


@pytest.mark.parametrize("name", ["tidepool-ledger", "mocha", "no-such-neighbour", "vo"])
def test_no_alert(spark, name):
    assert alert(spark, name) == []


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_both_joins_equal_brute_force(spark):
    rnd = random.Random(5)
    bases = ["".join(rnd.choice("ab-c") for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    words = set(bases)
    for word in bases:
        for _ in range(3):
            for _ in range(rnd.randint(1, 3)):
                i = rnd.randint(0, len(word))
                word = word[:i] + rnd.choice(["", "a", "b", "-"]) + word[i + rnd.randint(0, 1) :]
            words.add(word)
    words = sorted(words - {""})
    popular = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "package STRING, rank INT")
    expected = {
        (a, b, _distance(a, b))
        for a in words
        for b in words
        if a != b and _distance(a, b) <= 2 and 1 - _distance(a, b) / max(len(a), len(b)) >= 0.75
    }
    assert len(expected) > 200
    theta = ds.typosquat_pairs(names(spark, *words, *words), popular, broadcast_names=1000)
    blocked = ds.typosquat_pairs(names(spark, *words, *words), popular, broadcast_names=10)
    for pairs in (theta, blocked):
        rows = pairs.collect()
        assert len(rows) == len(expected)
        assert {(r.package, r.popular, r.distance) for r in rows} == expected
    assert "BroadcastNestedLoopJoin" not in blocked._jdf.queryExecution().toString()


def test_matches_are_ordered_and_limited(spark):
    popular = [("abcdefgx", 1), ("abcdexgh", 2), ("abcdefgh", 3), ("xbcdefgh", 4), ("abcdefghi", 5), ("abcxefgh", 6), ("abcdefyz", 7)]
    pairs = ds.typosquat_pairs(names(spark, "abcdefgz"), spark.createDataFrame(popular, "package STRING, rank INT"))
    (row,) = ds.typosquat_alerts(pairs).collect()
    found = [(m.package, m.distance) for m in row.details.suspicious_matches]
    assert found == [("abcdefgx", 1), ("abcdefgh", 1), ("abcdefyz", 1)][: len([f for f in found if f[1] == 1])] + [
        f for f in found if f[1] == 2
    ]
    assert len(found) == 5 and [d for _, d in found] == sorted(d for _, d in found)


def test_one_alert_per_requested_version(spark):
    requests = spark.createDataFrame([("reakt", "1.0.0"), ("reakt", "2.0.0"), ("react", "1.0.0")], "package STRING, version STRING")
    pairs = ds.typosquat_pairs(requests, ds.popular_packages(spark))
    rows = ds.typosquat_alerts(pairs, requests=requests).collect()
    assert sorted((r.package, r.version) for r in rows) == [("reakt", "1.0.0"), ("reakt", "2.0.0")]


def test_popular_list(spark):
    assert ds.popular_packages(spark).count() == 34
    downloads = spark.createDataFrame([("a", 5), ("b", 9), ("a", 5), ("c", 10), ("d", 1)], "package STRING, downloads LONG")
    top = ds.popular_packages(spark, downloads, 3).orderBy("rank").collect()
    assert [(r.package, r["rank"]) for r in top] == [("a", 1), ("c", 2), ("b", 3)]


def test_both_joins_give_the_same_rows(spark):
    ours = names(spark, "ab🙂🙂", "🙂🙂", "🙂🙃", "abcdefgh", "abcdefg", "ab")
    listed = spark.createDataFrame([("🙂🙂", 1), ("🙂🙂", 1), ("abcdefgi", 2), ("ab🙂🙃", 3), ("abcdefgi", 4)], "package STRING, rank INT")
    assert sorted(ds.typosquat_pairs(ours, listed).collect()) == sorted(ds.typosquat_pairs_blocked(ours, listed).collect())
    assert ds.typosquat_pairs(ours, listed).count() > 3


def test_distances_come_after_pairs_are_made_distinct(spark):
    pairs = ds.typosquat_pairs_blocked(names(spark, "abcdefgh"), spark.createDataFrame([("abcdefgi", 1)], "package STRING, rank INT"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "levenshtein" in line and "Filter" in line]
    assert len(filters) == 1 and plan.index(filters[0]) < plan.index("Aggregate")
