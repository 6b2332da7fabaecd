"""Passage deduplication, the Jaccard join, decontamination, toxicity and the pipeline."""

import collections
import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depsieve.llm import common, components, decontamination, jaccard_join, line_dedup, toxicity, words

SCHEMA = "doc_id long, text string"


def _prose(rnd, n, stem="w"):
    return [f"{stem}{rnd.randrange(10**6)}" for _ in range(n)]


def test_word_hashes_follow_words():
    texts = ["The the  THE", None, "", "a\tb\nc\x0bd", "é É", "x" * (words.PIECE + 10) + " tail", ("ab cd " * 300_000)]
    hashes, ends = words.word_hashes(pa.array(texts))
    lists = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(ends).tolist() == [len(x) for x in lists]
    by_word = collections.defaultdict(set)
    for w, h in zip(itertools.chain(*lists), hashes.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    assert np.array_equal(words.word_hashes(pa.array(texts).slice(3, 2))[0], hashes[ends[3] : ends[5]])


# --- passages ----------------------------------------------------------------------------


def _removed(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("en"))
    return {r.doc_id: r.text for r in line_dedup.remove_repeated_passages(docs, **options).collect()}


def test_passages_of_any_cut_are_removed(spark):
    rnd = random.Random(3)
    line = lambda n: " ".join(_prose(rnd, n))
    passages = [[line(rnd.choice([8, 20, 60])) for _ in range(k)] for k in (2, 3, 4, 7)] + [[line(55)]]
    passages = [p for p in passages if sum(len(x.split()) for x in p) >= 50]
    rows, own = [], {}
    for i in range(60):
        before, after = [line(rnd.randint(3, 40)) for _ in range(rnd.randint(0, 4))], [line(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 4))]
        own[i] = before + after
        rows.append((i, "\n".join(before + passages[i % len(passages)] + after)))
    found = _removed(spark, rows)
    for i, text in rows:
        first = i < len(passages)
        assert found[i] == (text if first else "\n".join(own[i]))


def test_short_repeats_and_odd_rows_stay(spark):
    short = "Released under a licence.\nAll rights reserved."
    rows = [(1, f"{short}\nfirst own line"), (2, f"{short}\nsecond own line"), (3, None), (4, ""), (None, "no id"), (6, "\n\n\n"), (7, "\n\n\n")]
    assert _removed(spark, rows) == dict(rows)


def test_whole_copies_are_dropped_and_inner_repeats_cut(spark):
    rnd = random.Random(4)
    lines = [" ".join(_prose(rnd, 20)) for _ in range(6)]
    text = "\n".join(lines)
    found = _removed(spark, [(5, text), (9, text), (7, text + "\n" + text + "\nend"), (5, text)])
    assert 9 not in found and found[5] == text
    assert found[7] == "end"


def test_line_hash_clashes_are_told_by_bytes(spark):
    spans = spark.createDataFrame([(1, 11, 0, 1), (2, 22, 0, 1)], "_id long, _hash long, first int, last int")
    texts = spark.createDataFrame([(1, 11, "a\nb"), (2, 22, "a\nb")], "_id long, _hash long, _text string")
    assert line_dedup._different_lines(texts, spans).count() == 0


# --- Jaccard join --------------------------------------------------------------------------


def _near(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def _corpus(seed):
    rnd, rows = random.Random(seed), []
    shared = _prose(rnd, 60, "s")
    for _ in range(12):
        base = _prose(rnd, rnd.choice([3, 5, 12, 40, 150, 400]))
        for _ in range(rnd.choice([1, 2, 6, 9])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(len(base) // 60, 1))):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(10**6)}"
            rows.append(copy)
    rows += [shared[k : k + 45] + _prose(rnd, rnd.choice([2, 6, 60])) for k in range(14)]
    rows += [shared[:50] + [f"t{k}"] for k in range(8)]
    texts = [(i, " ".join(w)) for i, w in enumerate(rows)]
    return [*texts, (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two")]


@pytest.mark.parametrize("seed, percent, frequent", [(1, 85, 1 << 16), (2, 80, 2), (3, 60, 1 << 16)])
def test_components_equal_brute_force(spark, monkeypatch, seed, percent, frequent):
    rows = _corpus(seed)
    # Nearly every shared token counts as frequent, so pairs of tokens are indexed too.
    settings = jaccard_join.Settings(words=4, percent=percent, frequent_from=3, frequent_entries=frequent)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_shingles", F.lit("clash"))
    found = jaccard_join.jaccard_components(docs, settings).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == _near(rows, 4, percent)


def test_signatures_meet_whatever_is_frequent():
    rnd = np.random.default_rng(7)
    for percent in (60, 80, 85):
        s = jaccard_join.Settings(percent=percent)
        for _ in range(150):
            n = int(rnd.choice([1, 2, 5, 14, 17, 40, 130, 600]))
            x = np.unique(rnd.integers(1, 2**63, n, dtype=np.uint64))
            y = x[rnd.random(len(x)) > rnd.random() * 0.3]
            y = np.unique(np.concatenate([y, rnd.integers(1, 2**63, int(rnd.integers(0, n // 8 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if not len(y) or 100 * both < percent * (len(x) + len(y) - both):
                continue
            mark = np.uint64(rnd.integers(1, 4))
            frequent = [(z % np.uint64(4)) < mark for z in (x, y)]
            assert len(np.intersect1d(jaccard_join.signatures(x, frequent[0], s), jaccard_join.signatures(y, frequent[1], s)))


def test_no_depth_is_taken_for_whole():
    assert int(np.uint64(2**64 - 1) >> np.uint64(57)) < jaccard_join._WHOLE


def test_repeated_ids_and_null_ids(spark):
    text = " ".join(_prose(random.Random(1), 30))
    rows = [(3, text), (3, text), (None, text), (2, text + " x"), (3, "other words here for the same id")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), jaccard_join.Settings(words=4)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found) == [("2", 28, 2), ("3", 4, 3), ("3", 27, 2), ("3", 27, 2), ("None", 27, 2)]


def test_far_edits_of_a_text_are_not_compared_with_all_its_copies(spark, monkeypatch):
    """Their rare tokens, shared by some of them, tell that the frequent ones are not enough."""
    rnd = random.Random(8)
    base = _prose(rnd, 150)
    edits = [(3 * k, f"edit{k}") for k in range(48)]

    def edited(k):
        text = list(base)
        for at, word in rnd.sample(edits, k):
            text[at] = word
        return " ".join(text)

    rows = [(0, " ".join(base))] + [(i, edited(1)) for i in range(1, 90)] + [(i, edited(rnd.choice([4, 5]))) for i in range(90, 240)]
    tested = []

    def counted(df, label):
        found = common.stored(df, label)
        if label.startswith("op3-pairs"):
            tested.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "stored", counted)
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), jaccard_join.Settings(words=4, percent=85)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == _near(rows, 4, 85)
    assert sum(tested) < 6000


def test_long_lists_end_after_few_rounds(spark, monkeypatch):
    """Each round costs a dozen shuffles, however few pairs are left."""
    rnd = random.Random(8)
    base = _prose(rnd, 150)
    edits = [(3 * k, f"edit{k}") for k in range(48)]

    def edited(k):
        text = list(base)
        for at, word in rnd.sample(edits, k):
            text[at] = word
        return " ".join(text)

    rows = [(0, " ".join(base))] + [(i, edited(rnd.choice([4, 5]))) for i in range(1, 200)]
    labels = []

    def counted(df, label):
        labels.append(label)
        return common.stored(df, label)

    monkeypatch.setattr(jaccard_join, "stored", counted)
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), jaccard_join.Settings(words=4, percent=85)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == _near(rows, 4, 85)
    assert sum(label.startswith("op3-pairs") for label in labels) <= 3


def test_a_star_is_found_in_one_round(spark, monkeypatch):
    labels = []

    def counted(df, label):
        labels.append(label)
        return common.stored(df, label)

    monkeypatch.setattr(components, "stored", counted)
    found = components.connected_components(spark.createDataFrame([(7, k) for k in range(8, 40)] + [(7, 8)], "a long, b long"), "star").collect()
    assert {(r.node, r.root) for r in found} == {(k, 7) for k in range(8, 40)}
    assert labels == ["star-1"]


def test_connected_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)] + [(5, 5), (None, 3)]
    root = {n: n for e in edges if None not in e for n in e}
    for _ in range(len(edges)):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {n: r for n, r in root.items() if n != r}


# --- decontamination -------------------------------------------------------------------------


def test_contamination_equals_search(spark):
    rnd = random.Random(6)
    common = ["the", "of", "and", "to", "in"]
    sentence = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.4 else f"w{rnd.randrange(3000)}" for _ in range(n))
    items = [(k, f"{sentence(rnd.randint(8, 90))}? {sentence(rnd.randint(2, 30))}.") for k in range(60)] + [(90, None), (91, ""), (92, "single words")]
    rows, planted = [], set()
    for i in range(150):
        parts = [sentence(rnd.randint(5, 400))]
        if i % 3 == 0:
            k = rnd.randrange(60)
            planted.add((i, k))
            parts.insert(rnd.randint(0, 1), items[k][1].upper().replace(" ", "  \n"))
        if i % 7 == 0:  # the question alone is no match
            parts.append(items[(i * 5 + 1) % 60][1].split("?")[0])
        rows.append((i, " ".join(parts)))
    rows += [(200, None), (201, "")]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    for settings in (decontamination.Settings(), decontamination.Settings(index_bytes=6_000, block=4)):
        found = decontamination.find_contamination(docs, bench, settings).collect()
        assert {(r.doc_id, r.item_id) for r in found} == planted
    kept = {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in planted}


def test_edited_items_are_found(spark):
    rnd = random.Random(9)
    own = iter(range(10**6))
    fresh = lambda n: [f"v{next(own)}" for _ in range(n)]
    items, rows, planted = [], [], set()
    for k, (asked, answered) in enumerate([(28, 8), (12, 5), (28, 4), (20, 3), (15, 2), (3, 12), (11, 11), (9, 1)]):
        question, answer = fresh(asked), fresh(answered)
        items.append((k, f"{' '.join(question)}? {' '.join(answer)}."))
        for part, other, front in ((question, answer, True), (answer, question, False)):
            # One edit in any part of several words, two where they are at most a fifth of it.
            for edits in (1, 2)[: 0 if len(part) < 2 else 2 if len(part) >= 10 else 1]:
                for kind in ("replace", "drop", "insert"):
                    for _ in range(4):
                        new = list(part)
                        for at in sorted(rnd.sample(range(len(part)), edits), reverse=True):
                            new[at : at + (kind != "insert")] = [] if kind == "drop" else fresh(1)
                        words_of = new + other if front else other + new
                        planted.add((len(rows), k))
                        rows.append((len(rows), " ".join(fresh(rnd.randint(0, 90)) + words_of + fresh(rnd.randint(0, 90)))))
        # The question alone, or with another answer, is no match.
        rows += [(len(rows), " ".join(fresh(30) + question)), (len(rows) + 1, " ".join(fresh(30) + question + fresh(answered)))]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_contamination(docs, bench).collect()} == planted


def test_items_are_retrieved_without_their_rarest_words(spark):
    common = [f"c{k}" for k in range(8)]
    items = [(k, " ".join([*common, f"own{k}", f"other{k}"])) for k in range(40)]
    items.append((40, f"{' '.join(common[:4])} rare? {' '.join(common[4:])} seldom."))
    docs = spark.createDataFrame([(1, f"{' '.join(common[:4])} x {' '.join(common[4:])} y")], SCHEMA)
    found = decontamination.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert 40 in {r.item_id for r in found}
    assert all(0 < r.score <= 1 + 1e-9 for r in found)


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], SCHEMA)
    assert decontamination.find_contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontamination.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


# --- toxicity ------------------------------------------------------------------------------------


def _syllables(rnd, n):
    parts = ["ka", "lo", "mi", "tem", "ra", "su", "ne", "vo", "pi", "dar"]
    return ["".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(n)]


def test_toxicity_learns_and_catches_misspellings(spark):
    rnd = random.Random(8)
    bad = ["horridword", "nastyterm", "vileslur"]
    rows, labels = [], []
    for i in range(1200):
        own, toxic = _syllables(rnd, rnd.randint(10, 80)), int(i % 5 == 0)
        if toxic:
            own[rnd.randrange(len(own))] = rnd.choice(bad)
            own[rnd.randrange(len(own))] = rnd.choice(bad)
        rows.append((i, " ".join(own)))
        labels.append((i, toxic))
    rows += [(900, " ".join([*_syllables(rnd, 8), "nastytermm", "horridwordz"])), (901, " ".join(_syllables(rnd, 10))), (902, None), (903, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    known = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where("doc_id % 4 <> 2 or doc_id is null"))
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in labels if i % 4 == 2]
    right = [(found[i] >= 0.3) == (i % 5 == 0) for i in held]
    assert np.mean(right) > 0.95
    assert found[900] >= 0.3 > found[901]
    assert found[902] == found[903] and 0 <= found[902] <= 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words")], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= toxicity.score(docs, model).first().score <= 1


# --- pipeline --------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    near = _near([(r.doc_id, r.text) for r in rows], 5, 80)
    assert all(root == i for i, (_, root) in near.items())
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(item in " ".join((r.text or "").lower().split()) for item in items for r in rows)
    assert len(rows) > 0.7 * docs.count()


def test_passages_are_scored_together():
    rnd = random.Random(11)
    items = [(k, " ".join(rnd.choices([f"w{i}" for i in range(60)], k=rnd.randint(6, 40)))) for k in range(30)]
    words = [decontamination._words_of(t) for _, t in items]
    counts = collections.Counter(w for own in words for w in set(own.tolist()))
    index = decontamination.Index(items, counts, len(items), sum(map(len, words)) / len(words), decontamination.Settings())
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(90)], k=rnd.randint(0, 200))) for _ in range(300)]
    texts += [f"{texts[k]} {t} {texts[-k]}" for k, t in items]
    looked = []
    look = index._look
    index._look = lambda *args: looked.append(0) or list(look(*args))
    found = list(index.hits(pa.array(texts)))
    together = len(looked)
    # Without the common scores each passage near a block is looked at alone.
    index._reaching = lambda c, blocks, firsts, stops, term: iter(range(len(blocks)))
    assert list(index.hits(pa.array(texts))) == found and {h[1] for h in found} == set(range(30))
    assert together < len(looked) - together


def test_batches_are_worked_on_in_parts():
    texts = ["a" * 10] * 1200 + ["b" * (3 << 20)] * 3 + ["c" * (9 << 20), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(common.in_parts(iter([batch.slice(0, 0), batch])))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert all(p.num_rows <= common.PART_ROWS and (p.num_rows == 1 or p.nbytes <= common.PART_BYTES) for p in parts)


def test_training_drops_what_other_operators_kept(spark):
    common.worker_memo("another operator's", dict)
    list(toxicity._rows_of(toxicity.Settings())(iter([pa.record_batch([["some text"], pa.array([1], pa.int32())], names=["_text", "toxic"])])))
    assert not common._memo


def test_training_order_is_that_of_whole_contents():
    rnd = np.random.default_rng(3)
    bags = [(rnd.integers(0, 4, n).astype(np.int32), rnd.integers(0, 3, n).astype(np.int16), int(rnd.integers(0, 2))) for n in rnd.integers(0, 4, 300)]
    plain = lambda b: (b[2], len(b[0]), b[0].tobytes(), b[1].tobytes())
    assert [plain(b) for b in toxicity.in_order(bags)] == sorted(map(plain, bags))


def test_last_stage_runs_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "two words", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    import corpus_pipeline

    last = corpus_pipeline.byte_bpe_stage(spark, docs, "")
    assert last._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert last.collect()[0].round_trip
