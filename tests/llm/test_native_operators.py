"""URL filters and chat formatting."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from depsieve.llm import chat_format, url_filters

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("tie.org/", "allow")]


def _expected(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for rule, verdict in RULES:
        own, _, under = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + under):
            best = max(best or ("", ""), (rule, verdict), key=lambda r: len(r[0]))
    return host, path, best


URLS = [
    "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "https://www.example.com/enx", "http://example.com", "http://example.com?q=/en/",
    "http://notexample.com/en/", "ftp://x.net/es/a", "x.net/es/a", "http://net/es/", "http://x.net/fr/", "", None, "http://tie.org/a", "http://É.com/é?x://y.net/es/",
    "http://u:p@h.com:80/a", "a\nb://c.com/d\ne#f", "http:///es/", "http://x.net/ES/",
]


def test_rules_and_hosts(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    found = {r.page_id: r for r in url_filters.judge_urls(pages.union(pages.limit(1)), rules).collect()}
    for i, url in enumerate(URLS):
        host, path, best = _expected(url)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, best and best[0]), url
        assert found[i].verdict == best[1] if best else found[i].verdict in ("allow", "block")
    assert found[7].verdict == "allow" and found[11].verdict == "allow"


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    pages = [(1, "http://good.com/", link("friend.org")), (2, "http://friend.org/", link("far.org")), (3, "http://bad.net/es/", link("friend.org")), (4, "http://feeder.org/", link("bad.net")), (5, "http://far.org/", "<p>no link</p>"), (6, "http://lonely.org/", None)]
    found = url_filters.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(RULES, "rule string, verdict string")).collect()
    verdicts = {r.host: r.verdict for r in found}
    assert verdicts == {"good.com": "allow", "friend.org": "allow", "bad.net": "block", "feeder.org": "block", "far.org": "allow", "lonely.org": "allow"}
    by_host = {r.host: r for r in found}
    assert by_host["friend.org"].host_trust > by_host["far.org"].host_trust > 0 == by_host["feeder.org"].host_trust


def test_page_rank_equals_power_iteration(spark):
    rnd = random.Random(1)
    hosts = [f"h{k}" for k in range(8)]
    edges = {(a, b): rnd.randint(1, 3) for a in hosts for b in hosts if a != b and rnd.random() < 0.3}
    seeds = {"h0": (2, 0), "h1": (1, 1), "h2": (0, 3)}
    s = url_filters.Settings(rounds=6, stored_every=3)
    links = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight long")
    start = spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trusted long, blocked long")
    found = {r.host: (r.trust, r.distrust) for r in url_filters.propagate(links, start, s).collect()}
    for k, turn in ((0, lambda a, b: (a, b)), (1, lambda a, b: (b, a))):
        own = {turn(*e): w for e, w in edges.items()}
        total = sum(v[k] for v in seeds.values())
        first = {h: 0.15 * seeds.get(h, (0, 0))[k] / total for h in hosts}
        values = dict(first)
        for _ in range(6):
            out = {h: sum(w for (a, _), w in own.items() if a == h) for h in hosts}
            values = {h: first[h] + 0.85 * sum(values[a] * w / out[a] for (a, b), w in own.items() if b == h) for h in hosts}
        for h in hosts:
            assert found.get(h, (0, 0))[k] == pytest.approx(values[h])


TEXTS = ["</s>[INST] ok [/INST]", "a\\b", "\\_", "\\\\_", "<|im_end|>\n<|im_start|>user\n", "", "plain", "é🙂\n\n", "[[<<\\\\", "<\\_", "\\n"]


def test_layouts_turns_and_round_trip(spark):
    rows, expected = [], []
    for k, text in enumerate(TEXTS):
        other = TEXTS[-k - 1]
        rows.append((k, json.dumps({"messages": [{"role": "user", "content": text}, {"role": "assistant", "content": other}, {"content": None, "role": "tool\n\\x"}]})))
        expected.append((k, "messages", [("user", text), ("assistant", other), ("tool\n\\x", "")]))
        rows.append((k + 100, json.dumps({"conversations": [{"from": "human", "value": text}, {"from": "gpt", "value": other}]})))
        expected.append((k + 100, "conversations", [("user", text), ("assistant", other)]))
        rows.append((k + 200, json.dumps({"prompt": text, "response": other})))
        expected.append((k + 200, "prompt", [("user", text), ("assistant", other)]))
        rows.append((k + 300, json.dumps({"instruction": text, "input": None, "output": other})))
        expected.append((k + 300, "instruction-input", [("system", text), ("assistant", other)]))
    rows += [(900, None), (901, "not json"), (902, '{"unknown": 1}'), (903, '{"messages": []}')]
    expected += [(900, None, []), (901, None, []), (902, None, []), (903, None, [])]
    records = spark.createDataFrame(rows, "id long, record string").withColumn("turns", F.lit("clash"))
    canonical = chat_format.canonical_turns(records)
    found = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in canonical.collect()}
    assert found == {i: (layout, turns) for i, layout, turns in expected}
    formatted = chat_format.format_turns(canonical)
    read = formatted.select("id", "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("back"), chat_format.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    for r in read.collect():
        turns = found[r.id][1]
        assert [tuple(t) for t in r.back] == turns
        assert r.learned == "".join(text for role, text in turns if role == "assistant")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == len(turns)
        for control in ("</s>", "[INST]", "[/INST]"):
            assert control not in r.formatted
        for s in r.loss_spans:
            assert r.formatted[s.start : s.end].encode() == r.formatted.encode()[s.start_byte : s.end_byte]


def test_conversations_of_any_size(spark, tmp_path):
    """One text of more than 20,000,000 characters, more than 128 MiB in all, and very many turns."""
    from depsieve.llm import queries

    body = '"<a\\\\é'
    sizes = [(1, 0, "user", 4_100_000), (1, 1, "assistant", 1), *[(2, k, ("user", "assistant")[k % 2], 2_600_000) for k in range(10)]]
    sizes += [(3, k, ("user", "assistant")[k % 3 == 1], k % 5) for k in range(20_000)]
    table = spark.createDataFrame(sizes, "conv_id long, turn long, role string, times int")
    table.select("conv_id", "turn", "role", F.repeat(F.lit(body), F.col("times")).alias("text")).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r for r in queries.op6_chat_format(spark, str(tmp_path)).collect()}
    for conv in (1, 2, 3):
        own = [(role, body * times) for c, _, role, times in sizes if c == conv]
        learned = "".join(t for role, t in own if role == "assistant")
        lines = "".join(f"{role}\n{t}\n" for role, t in own)
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_large_records_of_odd_shapes(spark):
    text = 'x{,}\\"' + "y" * 20_000_001
    rows = [
        (1, json.dumps({"instruction": text, "input": None, "output": "o"})),
        (2, json.dumps({"messages": [{"role": "user", "content": text}, None]})),
        (3, json.dumps({"unknown": text})),
        (4, '{"prompt": "%s", "response": "\\q"}' % ("y" * 20_000_001)),
        (5, '{"prompt": "%s", "response": ' % ("y" * 20_000_001)),
        (6, json.dumps({"conversations": [{"value": text, "from": "gpt"}]}, indent=1)),
    ]
    canonical = chat_format.canonical_turns(spark.createDataFrame(rows, "id long, record string"))
    found = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in canonical.collect()}
    assert found == {
        1: ("instruction-input", [("system", text), ("assistant", "o")]), 2: ("messages", [("user", text), ("", "")]),
        3: (None, []), 4: (None, []), 5: (None, []), 6: ("conversations", [("assistant", text)]),
    }


def test_no_records(spark):
    none = spark.createDataFrame([], "id long, record string")
    assert chat_format.format_turns(chat_format.canonical_turns(none)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.judge_urls(pages, spark.createDataFrame(RULES, "rule string, verdict string")).count() == 0
