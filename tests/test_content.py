"""Content detectors: file walks, patterns, entropy and their alerts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import depsieve as ds
from depsieve import rules
from depsieve.functions.text import java_regex, utf16_left, utf16_length
from depsieve.operators import content as C


def hits(df):
    return [r.hit for r in df.orderBy("path", "rule_ord", "pos").collect()]


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- walks -----------------------------------------------------------------------


def test_walks(make_files):
    paths = [
        "a.js", "src/b.tsx", ".js", "src/.js", "..js", ".github/x.js", "node_modules/x.js", "a/node_modules/b.ts",
        ".git/x.js", "a.md", "a.js/b.txt", "node_modules", "my_node_modules/a.js", "a.JS", "x.js\n", ".hidden.mjs", "_a.cjs",
    ]
    files = make_files(*[(p, "") for p in paths])
    kept = lambda walk: {r.path for r in ds.source_files(files, walk).collect()}
    assert kept("hidden_pruned") == {"a.js", "src/b.tsx", "..js", "my_node_modules/a.js", ".hidden.mjs", "_a.cjs"}
    assert kept("git_pruned") == kept("hidden_pruned") | {".js", "src/.js", ".github/x.js"}


# --- network ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "path, code, expected",
    [
        ("lib/proxy.cjs", "let relay = require('http').Agent", ["Module: http", "Require: http"]),
        ("src/load.mjs", "pages.map(p => fetch(p))", ["Global: fetch", "Call: fetch()"]),
        ("sync.tsx", "import axios from 'axios'\nexport default axios.head", ["Module: axios", "Import: axios"]),
    ],
)
def test_network_cases(make_files, path, code, expected):
    alert = only(ds.network_alerts(make_files((path, code))))
    assert (alert.alert_type, alert.severity) == ("network_access", "medium")
    assert set(expected) <= set(alert.details.patterns)
    assert alert.details["count"] == len(alert.details.patterns)


def test_network_clean_empty_and_many(make_files):
    assert ds.network_alerts(make_files(("a.js", "let total = 0; for (const n of [1, 2]) total -= n"))).count() == 0
    assert ds.network_alerts(make_files(("a.txt", "fetch(x)"))).count() == 0
    code = "require('http'); require('https'); require('net'); fetch(u); new WebSocket(u);"
    assert len(only(ds.network_alerts(make_files(("a.js", code)))).details.patterns) > 3


def test_network_quote_kinds(make_files):
    # a backtick may open the module name of a require, but not close it
    assert hits(ds.network_hits(make_files(("a.js", "require(`http')")))) == [f"Regex match: {rules.NETWORK_PATTERNS[0]}"]
    assert hits(ds.network_hits(make_files(("a.js", "require('http`)")))) == []


@pytest.mark.parametrize(
    "code, expected",
    [
        ('import {\n a\n} from "got";', ["Import: got"]),
        ("import 'http'; import\"dns\"", ["Import: http", "Import: dns"]),
        ("import type { X } from 'axios'", ["Import: axios"]),
        ("const important = 1; from 'http'", []),
        ("export { a } from 'http';", []),
        ("x.import('http')", []),
        ("const { a } = require( 'got' , 1 ); obj.require('ky');", ["Require: got"]),
        ("require('./http'); require('http' + x);", []),
        ("fetch (u); a.fetch(u); window.fetch(u); prefetch(u); function fetch(u) {}", ["Call: fetch()"]),
        ("x = new WebSocket; y = new XMLHttpRequest(); new a.EventSource(); new WebSocket.Server()", ["New: WebSocket", "New: XMLHttpRequest"]),
        ("// fetch(a)\n/* new WebSocket(u) */ const s = 'fetch(1)', t = \"new EventSource\";", []),
        ("/* unclosed fetch(a)", []),
        ("`${fetch(x)}`", ["Call: fetch()"]),
        ("const u = 'http://x'; fetch(u)", ["Call: fetch()"]),
        ("it's fetch(u)", ["Call: fetch()"]),
    ],
)
def test_network_structure(make_files, code, expected):
    assert hits(ds.network_structural_hits(make_files(("a.js", code)))) == expected


def test_hostile_lines_finish(make_files):
    """Input on which naive patterns are quadratic or overflow the stack."""
    n = 300_000
    texts = [
        "import " * n, '"' + '\\"' * n, "/*" * n, "\nimport" * n, "`" + "\\`" * n, "from 'x" * n,
        "import" + " " * n, "'" * n, "require(" * n, '"' + "a" * n + "'fs'",
    ]
    files = make_files(*[(f"f{i}.js", t) for i, t in enumerate(texts)])
    assert ds.file_hits(files).count() >= 0


# --- filesystem and shell --------------------------------------------------------


def test_filesystem_cases(make_files):
    alert = only(ds.filesystem_alerts(make_files(("a.js", "const fs = require('fs');\nfs.writeFileSync('a', 'b');"))))
    assert (alert.alert_type, alert.severity) == ("filesystem_access", "medium")
    assert list(alert.details.patterns) == ["require('fs')", "fs.writeFile", "fs.writeFileSync"]
    assert only(ds.filesystem_alerts(make_files(("a.js", "fs.unlinkSync(a); fs.rmdirSync(b)")))).details.patterns
    assert ds.filesystem_alerts(make_files(("a.js", "const sum = (a, b) => a + b;"))).count() == 0


def test_filesystem_hits_need_no_word_boundary(make_files):
    found = hits(ds.filesystem_hits(make_files(("a.js", "gfs.writeFileSync(a); gfs.writeFile(b); fs.rmx"))))
    assert found == ["fs.writeFile", "fs.writeFile", "fs.writeFileSync"]


def test_shell_cases(make_files):
    alert = only(ds.shell_alerts(make_files(("a.js", "const { exec } = require('child_process');\nexec('ls');"))))
    assert (alert.alert_type, alert.severity) == ("shell_access", "high")
    assert only(ds.shell_alerts(make_files(("a.js", "spawn('bash', ['-c'])")))).details.patterns
    assert ds.shell_alerts(make_files(("a.js", "[1, 2].map(x => x * 2);"))).count() == 0
    assert hits(ds.shell_hits(make_files(("a.js", "re.exec(s); preexec(x); \u00e9exec(y)")))) == ["exec(", "exec("]


def test_shell_keeps_ten_of_eleven_and_cuts(make_files):
    lines = "\n".join(f"'push {i}'" for i in range(11))
    alert = only(ds.shell_alerts(make_files(("a.js", lines))))
    assert list(alert.details.patterns) == [f"'push {i}'" for i in range(10)]
    assert alert.details["count"] == 11
    long = "'bash " + "x" * 200 + "'"
    assert hits(ds.shell_string_hits(make_files(("a.js", long)))) == [long[:100]]


def test_first_seen_order_is_path_then_rule(make_files):
    files = make_files(("b.js", "fs.unlink(a)"), ("a.js", "fs.chmod(a); fs.mkdir(b)"))
    assert list(only(ds.filesystem_alerts(files)).details.patterns) == ["fs.mkdir", "fs.chmod", "fs.unlink"]


def test_user_rules(make_files):
    found = ds.match_patterns(make_files(("a.js", "eval(x); eval (y)")), [C.plain_rule(r"\beval\s*\(")])
    assert [(r.rule_ord, r.pos, r.hit) for r in found.orderBy("pos").collect()] == [(0, 0, "eval("), (0, 1, "eval (")]


# --- rules against the plain patterns --------------------------------------------


def _random_texts(spark, tokens, n, seed):
    rnd = random.Random(seed)
    rows = [("".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 14))),) for _ in range(n)]
    return spark.createDataFrame(rows, "s STRING").repartition(8)


def test_line_rules_equal_plain_patterns(spark):
    tokens = [
        "import", "import ", "from", "from ", "'fs'", '"fs"', "'http'", '"got"', " ", "  ", "\n", "\r", "\u2028", "\u0085",
        "\n\n", "x", "'", "i", "im", "\u00a0", " from 'http'", '\nfrom "got"', "important ", ";",
    ]
    texts, s = _random_texts(spark, tokens, 40000, 1), F.col("s")
    plain = F.regexp_extract_all(s, F.lit(java_regex(rules.FILESYSTEM_PATTERNS[2])), F.lit(0))
    ours = F.coalesce(C._rule_hits(s, C.FILESYSTEM_RULES[2], False), F.array().cast("ARRAY<STRING>"))
    assert texts.where(F.size(plain) > 0).count() > 100
    assert texts.where(plain != ours).count() == 0
    pattern = rules.NETWORK_PATTERNS[1]
    assert texts.where(s.rlike(java_regex(pattern))).count() > 100
    assert texts.where(s.rlike(java_regex(pattern)) != C._network_test(s, pattern)).count() == 0


def test_shell_strings_equal_plain_pattern(spark):
    tokens = ["'", '"', "`", "sh", "bash", "x", "\n", "\r", "cmd", "\u2028", " ", "zs"]
    texts, s = _random_texts(spark, tokens, 40000, 2), F.col("s")
    plain = F.regexp_extract_all(s, F.lit(java_regex(rules.SHELL_STRING_PATTERN)), F.lit(0))
    ours = F.transform(F.coalesce(C.shell_string_array(s), F.array().cast(C.HIT)), lambda h: h["hit"])
    assert texts.where(plain != ours).count() == 0


def test_dialect():
    assert java_regex(r"a.b") == r"a[^\n\r\u2028\u2029]b"
    assert java_regex(r"[.]\.") == r"[.]\."
    with pytest.raises(ValueError):
        java_regex(r"a\b ")


# --- UTF-16 and entropy ----------------------------------------------------------


def test_utf16(spark):
    rows = [("a" * 99,), ("\U0001f600" * 60,), ("x" * 99 + "\U0001f600" + "y",), ("",), ("\u00e9" * 120,)]
    df = spark.createDataFrame(rows, "t STRING")
    for r in df.select("t", utf16_length(F.col("t")).alias("n"), utf16_left(F.col("t"), 100).alias("cut")).collect():
        raw = r.t.encode("utf-16-be")
        assert r.n == len(raw) // 2
        assert r.cut == raw[:200].decode("utf-16-be", "replace")


def _entropy(text):
    units = len(text.encode("utf-16-be")) // 2
    return -sum(n / units * math.log2(n / units) for n in Counter(text).values())


def test_entropy_values(spark):
    rnd = random.Random(3)
    texts = ["a", "ab" * 50, "".join(chr(rnd.randint(32, 1000)) for _ in range(3000)), "\U0001f600a" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    for r in ds.char_entropy(df, "id", "t").collect():
        assert r.entropy == pytest.approx(_entropy(texts[r.id]), abs=1e-12)


def test_obfuscation_cases(make_files):
    rnd = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!@#$%^&*()_+-=[]{}|;:,.<>?"
    noise = "\n".join("".join(rnd.choice(alphabet) for _ in range(100)) for _ in range(50))
    alert = only(ds.obfuscation_alerts(make_files(("lib/a.js", noise), ("b.js", "const x = 1;"))))
    assert (alert.alert_type, alert.severity, alert.details.threshold) == ("obfuscated_code", "high", 5.5)
    assert [(f.file, f.entropy) for f in alert.details.files] == [("lib/a.js", round(_entropy(noise), 2))]
    normal = "function add(a, b) {\n  return a + b;\n}\n" * 10
    assert ds.obfuscation_alerts(make_files(("a.js", normal), ("s.js", "const x = 1;"))).count() == 0


def test_obfuscation_limits(make_files):
    chars = "".join(chr(0x100 + i) for i in range(100))
    found = ds.obfuscated_files(make_files(("a.js", chars[:99]), ("b.js", chars)))
    assert [r.file for r in found.collect()] == ["b.js"]
    # exactly at the threshold is not above it
    flat = "".join(chr(0x100 + i) for i in range(32)) * 4
    assert ds.obfuscated_files(make_files(("a.js", flat)), threshold=5.0).count() == 0
