"""Ranked lexical search, Merkle manifests and spot signatures against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from depsieve.llm import lexical_search, merkle, queries, spotsigs

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- op11 ---------------------------------------------------------------------------


def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _brute_search(docs, items, k=20):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    big_n, big_l = sum(1 for n in lengths if n), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (d, c), n in zip(counts, lengths):
            if not n:
                continue
            m = 75 + (25 * n * big_n) // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in _terms(text) if c[t]
            )
            if score > 0:
                scored.append((-score, -(2**63) if d is None else d, d, score))
        for rank, (_, _, d, score) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, d, score))
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()[:12]
    docs = [(r["doc_id"], r["text"]) for r in docs] + [(None, "zz Ünïcode TERM term"), (5000, None), (5001, "")]
    items = [(r["item_id"], r["text"]) for r in items] + [(-1, "term ünïcode the"), (-2, None), (-3, "...")]
    got = lexical_search.top_k(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), lexical_search.Settings(k=7)
    )
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute_search(docs, items, k=7)


def test_search_ties_repeats_and_empty(spark):
    docs = [(1, "alpha beta"), (2, "alpha beta"), (2, "alpha beta"), (3, "gamma")]
    items = [(10, "alpha"), (10, "alpha"), (11, "delta")]
    got = lexical_search.top_k(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(_brute_search(docs, items))
    # Item 10 is two query rows; equal scores go by ascending doc_id.
    assert sorted(r[2] for r in rows if r[0] == 10 and r[1] == 1) == [1, 1]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lexical_search.top_k(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, "alpha", 9)], "doc_id long, text string, score long")
    assert lexical_search.top_k(clash, spark.createDataFrame(items, "item_id long, text string")).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_in_turns_and_over_any_partitions(spark):
    """Few queries at once, few seeds, many small tasks: the same rows."""
    rnd = random.Random(5)
    word = lambda: rnd.choice(["the", "of", f"w{rnd.randrange(30)}", f"w{rnd.randrange(400)}", "Ünï", "x_y"])
    docs = [(i % 350, " ".join(word() for _ in range(rnd.randrange(60)))) for i in range(400)] + [(None, "the w1 w2"), (900, None)]
    docs += [(1000 + i, "the of w1 w1 w2 Ünï") for i in range(40)]
    items = [(i, " ".join(word() for _ in range(rnd.randrange(1, 25)))) for i in range(30)] + [(40, "zzz"), (41, None)]
    settings = lexical_search.Settings(k=5, seeds=3, items_at_once=7, bucket_ratio=1.01)
    got = lexical_search.top_k(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(9), spark.createDataFrame(items, "item_id long, text string"), settings
    )
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute_search(docs, items, k=5)


def test_search_reads_long_texts_as_short_ones(monkeypatch):
    ids, text = {b"a": 0, "é".encode(): 1}, "A b é_a\x7fÉ a1 ".encode() * 3
    short = lexical_search._term_counts(text, ids)
    monkeypatch.setattr(lexical_search, "_LIST_BYTES", 1)
    assert short == lexical_search._term_counts(text, ids) == (18, {0: 6, 1: 3})


# --- op12 ---------------------------------------------------------------------------


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(r, text):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _h("".join(enc(x) for x in (r[0], r[3], r[2], r[4], text)))


def _build(hs, arity=3):
    paths, members, level = [[] for _ in hs], [[i] for i in range(len(hs))], list(hs)
    while len(level) > 1:
        up, grouped = [], []
        for s in range(0, len(level), arity):
            run = level[s : s + arity]
            for j in range(len(run)):
                for i in members[s + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(_h("".join(run)))
            grouped.append([i for m in members[s : s + arity] for i in m])
        level, members = up, grouped
    return level[0], paths


def _brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in keys:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        subs[s] = (ordered, *_build([_leaf(r, r[1]) for r in ordered]))
    root, group_paths = _build([subs[s][1] for s in keys])
    out = []
    for g, s in enumerate(keys):
        ordered, top, paths = subs[s]
        for r, p in zip(ordered, paths):
            full = p + group_paths[g]
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            acc = _leaf(r, text)
            for left, right in full:
                acc = _h(left + acc + right)
            out.append((r[0], _leaf(r, r[1]), top, root, _h("".join(a + b for a, b in full)), acc, acc == root))
    return sorted(out, key=repr)


def _op12(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").isNotNull()
    changed = [F.when(tampered, F.regexp_replace("text", "\\n", "")).otherwise(F.col("text")) if f == "text" else F.col(f) for f in queries.LEAF_FIELDS]
    df = df.select(*queries.LEAF_FIELDS, merkle.leaf_of(changed).alias("_tampered"))
    found = merkle.manifest(df, queries.LEAF_FIELDS, group="source", order="doc_id", carry=("doc_id", "_tampered"), label="t12")
    folded = merkle.fold(F.col("_tampered"), F.col("path"))
    got = found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("f"), (folded == F.col("root")).alias("v"))
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 10, 28])
def test_manifest_equals_brute_force(spark, size):
    rows = [(i * 7 % 23, f"line {i}\nnext {i}", "en", "a" if i % 3 else ("é" if i % 2 else None), i) for i in range(size)]
    assert _op12(spark, rows) == _brute_manifest(rows)


def test_manifest_nulls_repeats_and_empty(spark):
    rows = [(None, "x\ny", None, None, None), (4, None, "de", "s", 1), (4, None, "de", "s", 1), (4, "a\nb", "de", "s", 2), (2, "", "fr", "", 0)]
    assert _op12(spark, rows) == _brute_manifest(rows)
    assert _op12(spark, []) == []


def test_manifest_query_on_table(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang", "source", "n_chars"]).to_pylist()]
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, SF).collect()), key=repr)
    assert got == _brute_manifest(rows)


# --- op13 ---------------------------------------------------------------------------


def _signatures(text, anchors, settings=spotsigs.Settings()):
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            content = [v for v in words[i + 1 : i + 1 + settings.span] if v not in anchors]
            if len(content) >= settings.chain:
                out.add(":".join([w, *content[: settings.chain]]))
    return out


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_signatures_equal_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()[:60]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs] + [(-1, None), (-2, ""), (-3, "the the the the")], "doc_id long, text string")
    anchors = spotsigs.common_words(df, 24)
    got = df.select("doc_id", "text", F.size(spotsigs.signatures(F.col("text"), anchors)).alias("n")).collect()
    for r in got:
        assert r["n"] == len(_signatures(r["text"], set(anchors))), r["doc_id"]


def test_likeness_and_equal_texts(spark):
    anchors = ["the", "of", "a"]
    texts = ["the cat sat on a mat of the big house today", "the cat sat on a mat of the small house today", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[0])], "doc_id long, text string")
    sig = df.select("doc_id", spotsigs.signatures(F.col("text"), anchors).alias("s"))
    rows = {r["doc_id"]: r["s"] for r in sig.collect()}
    assert rows[0] == rows[9]
    pair = sig.alias("x").join(sig.alias("y"), F.col("x.doc_id") < F.col("y.doc_id")).select("x.doc_id", "y.doc_id", spotsigs.likeness(F.col("x.s"), F.col("y.s")).alias("l"))
    for a, b, value in pair.collect():
        want = _jaccard(_signatures(texts[a] if a < 9 else texts[0], set(anchors)), _signatures(texts[b] if b < 9 else texts[0], set(anchors)))
        assert value == pytest.approx(want), (a, b)


def test_op13_query_rows(spark):
    rows = queries.op13_spot_signatures(spark, SF).collect()
    docs = sorted(pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    for i, d in enumerate(docs):
        text, nxt = d["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        r = by[d["doc_id"]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0.0 <= r["near_edited"] <= 1.0 and 0.0 <= r["near_next"] <= 1.0


def test_op13_shuffles_texts_once(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    # Without adaptive execution and broadcasts, the plan shows which shuffles are reused.
    for key, value in zip(before, ("false", "-1")):
        spark.conf.set(key, value)
    try:
        plan = queries.op13_spot_signatures(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert plan.count("documents.parquet") == 1 and "ReusedExchange" in plan


def test_similar_pairs_keeps_copies_as_members(spark):
    prints = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 5]), (3, [1, 2, 3, 4, 6]), (4, [7, 8]), (5, [])], "doc_id long, sigs array<long>")
    members, pairs = spotsigs.similar_pairs(prints, 0.6)
    assert sorted(tuple(r) for r in members.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 3)]
