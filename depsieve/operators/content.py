"""Pattern hits in file contents.

All hits of a file are worked out inside its own row, as array expressions, so the
content column is never shuffled; only the (small) hits leave the scan.

Every rule is linear in the length of the text, also on hostile input such as one
huge line: where the plain pattern would restart its scan at each candidate, the rule
uses an equivalent that settles each line once (the tests compare the two on random
text).
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsieve.functions.text import LINE_END, SPACE, java_regex, let, utf16_left
from depsieve.operators.files import in_walk, source_files
from depsieve.operators.install import script_entries
from depsieve.rules import (
    FILESYSTEM_PATTERNS,
    NETWORK_CALLS,
    NETWORK_CONSTRUCTORS,
    NETWORK_GLOBALS,
    NETWORK_MODULES,
    NETWORK_PATTERNS,
    SHELL_HIT_UNITS,
    SHELL_PATTERNS,
    SHELL_WORDS,
)

HIT = "ARRAY<STRUCT<rule_ord: INT, pos: INT, hit: STRING>>"
_LINE_START = rf"(?<![^{LINE_END}])"


@dataclass(frozen=True)
class Rule:
    """One content rule: report ``group`` of every match of ``regex`` (Java syntax).

    ``needs`` is a plain substring of every match and ``needs_regex`` a cheap pattern
    found in every match; texts without them skip the regex.
    ``literal`` is set when all matches are that same string.
    """

    regex: str
    group: int = 0
    needs: str | None = None
    literal: str | None = None
    needs_regex: str | None = None


def plain_rule(pattern: str) -> Rule:
    """A rule straight from an ECMAScript pattern."""
    if re.fullmatch(r"(?:[\w -]|\\[./(])+", pattern):
        text = re.sub(r"\\(.)", r"\1", pattern)
        return Rule(java_regex(pattern), needs=text, literal=text)
    word = re.match(r"(?:\\b)?([A-Za-z_]+)(?=\\s|\\\()", pattern)
    return Rule(java_regex(pattern), needs=word.group(1) if word and "|" not in pattern else None)


def _up_to(word: str, then: str = "") -> str:
    """The rest of a line up to the first ``word`` (followed by ``then``), never given back."""
    return rf"(?:[^{word[0]}{LINE_END}]++|{word[0]}(?!{word[1:]}{then}))*+"


def import_rule(pattern: str) -> Rule:
    """``import.*from <tail>``: at most one match per line, from its first ``import``.

    The first import of a line either reaches the last matching tail of that line or
    none of the imports does, so the line is read up to its first import only once.
    """
    tail = java_regex(pattern.removeprefix("import.*"))
    head = rf"(?:{_LINE_START}|\G){_up_to('import')}"
    return Rule(rf"{head}(import[^{LINE_END}]*{tail})", group=1, needs="import", needs_regex=tail)


def rules_from(patterns: tuple[str, ...]) -> list[Rule]:
    return [import_rule(p) if p.startswith("import.*") else plain_rule(p) for p in patterns]


FILESYSTEM_RULES = rules_from(FILESYSTEM_PATTERNS)
SHELL_RULES = rules_from(SHELL_PATTERNS)


def _any_of(content: Column, words: tuple[str, ...]) -> Column:
    return F.greatest(*[content.contains(w) for w in words])


def _rule_hits(content: Column, rule: Rule, distinct: bool) -> Column:
    """All matches of one rule in text order, optionally without repeats."""
    if rule.literal is not None and distinct:
        return F.when(content.contains(rule.literal), F.array(F.lit(rule.literal)))
    found = F.regexp_extract_all(content, F.lit(rule.regex), F.lit(rule.group))
    if distinct:
        found = F.array_distinct(found)
    if rule.needs is None:
        return found
    gate = content.contains(rule.needs)
    return F.when(gate & content.rlike(rule.needs_regex) if rule.needs_regex else gate, found)


def _number(found: Column, rule_ord: int, text=lambda hit: hit) -> Column:
    """Array of strings -> array of (rule_ord, pos, hit)."""
    return F.transform(
        F.coalesce(found, F.array().cast("ARRAY<STRING>")),
        lambda hit, pos: F.struct(
            F.lit(rule_ord).alias("rule_ord"), pos.cast("int").alias("pos"), text(hit).alias("hit")
        ),
    )


def rule_hits(content: Column, rules: list[Rule], distinct: bool = False, first_ord: int = 0) -> Column:
    """Hits of all rules as one array, in rule order and then text order."""
    spaces = F.lit("\t\n\x0b\x0c\r \xa0\ufeff\u2028\u2029")
    parts = [
        _number(_rule_hits(content, rule, distinct), first_ord + i, lambda hit: F.trim(hit, spaces))
        for i, rule in enumerate(rules)
    ]
    return F.concat(*parts)


def match_patterns(files: DataFrame, rules: list[Rule], hits=None) -> DataFrame:
    """Every match of every rule: (package, version, path, rule_ord, pos, hit)."""
    array = rule_hits(F.col("content"), rules) if hits is None else hits
    return unfold(files.select("package", "version", "path", array.alias("hits")))


def unfold(rows: DataFrame) -> DataFrame:
    """One row per element of ``hits``.

    The array is a projected column (a projection compiles and shares common parts, a
    generator does not), and the generator is the outer form: for the inner one the
    optimizer adds a filter on the array, which would work all hits out a second time.
    """
    keys = [c for c in rows.columns if c != "hits"]
    return rows.select(*keys, F.inline_outer("hits")).where(F.col("hit").isNotNull())


# --- filesystem ------------------------------------------------------------------


def filesystem_array(content: Column, distinct: bool = False) -> Column:
    return F.when(content.contains("fs"), rule_hits(content, FILESYSTEM_RULES, distinct))


def filesystem_hits(files: DataFrame) -> DataFrame:
    return match_patterns(source_files(files), [], filesystem_array(F.col("content")))


# --- shell -----------------------------------------------------------------------


def shell_call_array(content: Column, distinct: bool = False) -> Column:
    hits = rule_hits(content, SHELL_RULES, distinct)
    cut = F.transform(hits, lambda h: h.withField("hit", utf16_left(h["hit"], SHELL_HIT_UNITS)))
    return F.when(_any_of(content, ("child_process", "exec", "spawn")), cut)


def shell_string_array(content: Column, distinct: bool = False) -> Column:
    """Per line, the text from its first to its last quote if a shell word is in between."""
    # bash, powershell and zsh all contain "sh".
    words = tuple(w for w in SHELL_WORDS if not any(o != w and o in w for o in SHELL_WORDS))
    quoted = F.regexp_extract_all(content, F.lit(rf"""['"`][^{LINE_END}]*['"`]"""), F.lit(0))
    cut = F.transform(F.filter(quoted, lambda text: _any_of(text, words)), lambda hit: utf16_left(hit, SHELL_HIT_UNITS))
    found = F.array_distinct(cut) if distinct else cut
    return F.when(_any_of(content, words), _number(found, len(SHELL_RULES)))


def shell_hits(files: DataFrame) -> DataFrame:
    return match_patterns(source_files(files), [], shell_call_array(F.col("content")))


def shell_string_hits(files: DataFrame) -> DataFrame:
    return match_patterns(source_files(files), [], shell_string_array(F.col("content")))


# --- network, by text ------------------------------------------------------------

_MODULES = "|".join(NETWORK_MODULES)


def _import_presence(pattern: str) -> str:
    """Linear test for ``import\\s+.*\\s+from<tail>``.

    One scan per line: from the line's first ``import`` followed by space, or from an
    import whose space runs on to a later line.
    """
    tail = java_regex(pattern.removeprefix(r"import\s+.*\s+"))
    begin = (
        rf"(?:{_LINE_START}{_up_to('import', f'[{SPACE}]')}import[{SPACE}]++"
        rf"|import[{SPACE}&&[^{LINE_END}]]*+[{LINE_END}][{SPACE}]*+)"
    )
    return rf"{begin}(?:[^{LINE_END}]*(?<![{SPACE}])[{SPACE}]++|(?<=[{SPACE}]{{2}})){tail}"


def _network_test(content: Column, pattern: str) -> Column:
    word = re.search(r"require|import|XMLHttpRequest|WebSocket|fetch", pattern).group()
    if word != "import":
        return content.contains(word) & content.rlike(java_regex(pattern))
    tail = java_regex(pattern.removeprefix(r"import\s+.*\s+"))
    return content.contains(word) & content.rlike(tail) & content.rlike(_import_presence(pattern))


def _present(tests: list[tuple[Column, str]], first_ord: int) -> Column:
    """The texts of the tests that hold, as hits in rule order."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    test,
                    F.struct(F.lit(first_ord + i).alias("rule_ord"), F.lit(0).alias("pos"), F.lit(text).alias("hit")),
                )
                for i, (test, text) in enumerate(tests)
            ]
        )
    )


def _quotes_module(content: Column) -> Column:
    return content.rlike(rf"""['"](?:{_MODULES})['"]""")


def network_text_array(content: Column) -> Column:
    """Presence tests in fixed order: regexes, module literals, globals.

    Each group sits behind a test that is cheaper than its members, so a text
    without any network vocabulary costs a few substring searches.
    """
    regexes = [(_network_test(content, pattern), f"Regex match: {pattern}") for pattern in NETWORK_PATTERNS]
    modules = []
    for module in NETWORK_MODULES:
        forms = [f"{head}{q}{module}{q}{end}" for head, end in (("require(", ")"), ("from ", "")) for q in "'\""]
        modules.append((_any_of(content, tuple(forms)), f"Module: {module}"))
    names = [
        (content.contains(name) & content.rlike(java_regex(rf"\b{name}\s*\(")), f"Global: {name}")
        for name in NETWORK_GLOBALS
    ]
    none = F.array().cast(HIT)
    groups = [
        (_any_of(content, ("require", "import", *NETWORK_GLOBALS)), regexes),
        ((content.contains("require(") | content.contains("from ")) & _quotes_module(content), modules),
        (_any_of(content, NETWORK_GLOBALS), names),
    ]
    arrays, first_ord = [], 0
    for gate, tests in groups:
        arrays.append(F.coalesce(F.when(gate, _present(tests, first_ord)), none))
        first_ord += len(tests)
    return F.concat(*arrays)


_TEXT_RULES = len(NETWORK_PATTERNS) + len(NETWORK_MODULES) + len(NETWORK_GLOBALS)


def network_hits(files: DataFrame) -> DataFrame:
    return match_patterns(source_files(files, "git_pruned"), [], network_text_array(F.col("content")))


# --- network, by code structure --------------------------------------------------

# Token stream cleaner: keeps module-name strings, template literals and unclosed
# quotes ($1, $2); drops other strings and all comments. Every alternative consumes
# what it looked at, so the pass is linear.
_CLEAN = (
    rf"""("(?:{_MODULES})"|'(?:{_MODULES})'|`(?:[^`\\]++|\\[\s\S])*+`?)"""
    r"""|"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+'"""
    r"""|("(?:[^"\\\n]++|\\[\s\S])*+|'(?:[^'\\\n]++|\\[\s\S])*+)"""
    r"""|/\*(?:[\s\S]*?\*/|[\s\S]*+)|//[^\n]*+"""
)
# A stretch without quotes, semicolons or parentheses that ends in a module name.
_STRETCH = rf"""(?:^|['"`;()])[^'"`;()]*+['"](?:{_MODULES})(?=['"])"""
_STATEMENT_IMPORT = r"(?:^;?|[\n}])[^\S\n]*+import(?![\w$])"
_ENDS_IN_FROM = r"""(?<![\w$])from\s*['"][^'"]*\z"""
_ENDS_IN_IMPORT = _STATEMENT_IMPORT + r"""\s*+['"][^'"]*\z"""
_REQUIRE = rf"""(?<![.\w$])require\s*\(\s*['"](?:{_MODULES})['"]\s*[,)]"""
_CALL = rf"(?:\b(?:new|function)\s*\*?\s*+)?(?<![.\w$])(?:{'|'.join(NETWORK_CALLS)})\s*\("
_NEW = rf"(?<![\w$])new\s+(?:{'|'.join(NETWORK_CONSTRUCTORS)})(?![\w$.])"


def network_structure_array(content: Column) -> Column:
    """Imports, requires, bare calls and constructions found outside comments and strings."""
    cleaned = F.regexp_replace(content, F.lit(_CLEAN), F.lit("$1$2"))

    def signals(code: Column) -> Column:
        every = lambda regex: F.regexp_extract_all(code, F.lit(regex), F.lit(0))
        imports = F.filter(
            every(_STRETCH),
            lambda s: (s.rlike(_STATEMENT_IMPORT) & s.rlike(_ENDS_IN_FROM)) | s.rlike(_ENDS_IN_IMPORT),
        )
        calls = F.filter(every(_CALL), lambda s: ~s.rlike(r"^(?:new|function)\b"))
        kinds = [
            (imports, lambda s: F.concat(F.lit("Import: "), F.regexp_extract(s, r"""['"]([^'"]*)\z""", 1))),
            (calls, lambda s: F.concat(F.lit("Call: "), F.regexp_extract(s, r"^(\w+)", 1), F.lit("()"))),
            (every(_REQUIRE), lambda s: F.concat(F.lit("Require: "), F.regexp_extract(s, r"""['"]([^'"]*)['"]""", 1))),
            (every(_NEW), lambda s: F.concat(F.lit("New: "), F.regexp_extract(s, r"(\w+)\z", 1))),
        ]
        return F.concat(
            *[
                _number(F.array_distinct(F.transform(found, name)), _TEXT_RULES + i)
                for i, (found, name) in enumerate(kinds)
            ]
        )

    uses_module = (content.contains("require") | content.contains("import")) & _quotes_module(content)
    return F.when(_any_of(content, NETWORK_GLOBALS) | uses_module, let(cleaned, signals))


def network_structural_hits(files: DataFrame) -> DataFrame:
    return match_patterns(source_files(files, "git_pruned"), [], network_structure_array(F.col("content")))


# --- all families in one pass ----------------------------------------------------

NETWORK, FILESYSTEM, SHELL, ENTROPY, INSTALL = "network", "filesystem", "shell", "entropy", "install"
FAMILIES = (NETWORK, FILESYSTEM, SHELL, ENTROPY)
TAGGED = "ARRAY<STRUCT<family: STRING, rule_ord: INT, pos: INT, hit: STRING, text: STRING>>"
MANIFEST_PATH = "package.json"


def tagged_hit(family: str, rule_ord: Column, pos: Column, hit: Column, text: Column | None = None) -> Column:
    return F.struct(
        F.lit(family).alias("family"),
        rule_ord.alias("rule_ord"),
        pos.alias("pos"),
        hit.alias("hit"),
        (F.lit(None).cast("string") if text is None else text).alias("text"),
    )


def family_array(path: Column, content: Column, families: tuple[str, ...]) -> Column:
    """The distinct hits of one file for the wanted families, tagged with the family.

    An install script is a hit of the root manifest: its name, with the command as text.
    """
    hidden, git = in_walk(path, "hidden_pruned"), in_walk(path, "git_pruned")
    sources = {
        NETWORK: [(git, network_text_array(content)), (git, network_structure_array(content))],
        FILESYSTEM: [(hidden, filesystem_array(content, distinct=True))],
        SHELL: [(hidden, shell_call_array(content, True)), (hidden, shell_string_array(content, True))],
    }
    none = F.array().cast(TAGGED)

    def tag(hits: Column, family: str) -> Column:
        return F.transform(hits, lambda h: tagged_hit(family, h["rule_ord"], h["pos"], h["hit"]))

    tagged = [
        F.coalesce(F.when(walk, tag(hits, family)), none)
        for family in families
        if family in sources
        for walk, hits in sources[family]
    ]
    if INSTALL in families:
        scripts = F.transform(
            script_entries(content),
            lambda e, i: tagged_hit(INSTALL, i.cast("int"), F.lit(0), e["key"], e["value"]),
        )
        tagged.append(F.coalesce(F.when(path == MANIFEST_PATH, scripts), none))
    return F.concat(none, *tagged)
