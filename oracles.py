"""The registered queries in ANSI SQL for a second engine.

Patterns are the rules as they stand (RE2 runs in linear time, so none of the
rewrites of the library is needed here).
"""

from __future__ import annotations

import corpora
from depsieve import rules

_EOL = r"\n\r\x{2028}\x{2029}"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """An ECMAScript rule for RE2: the dot stops at all line ends."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out.append(f"[^{_EOL}]" if c == "." and not in_class else c)
        i += 1
    return "".join(out)


def _with(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


_EXT = "(js|ts|jsx|tsx|mjs|cjs)$"
FILES = f"files as ({corpora.PACKAGE_FILES})"
HIDDEN = (
    f"hidden as (select * from files where regexp_matches(path, '[^/][.]{_EXT}') "
    r"and not regexp_matches(path, '(^|/)(node_modules|[.][^/]*)/'))"
)
GIT = (
    f"git as (select * from files where regexp_matches(path, '[.]{_EXT}') "
    r"and not regexp_matches(path, '(^|/)(node_modules|[.]git)(/|$)'))"
)


def _all_matches(source: str, pattern: str, rule_ord: int, group: int = 0, hit: str = "hit") -> str:
    """Rows (package, version, path, rule_ord, pos, hit) of one pattern."""
    return (
        f"select package, version, path, {rule_ord} as rule_ord, pos, {hit} as hit from ("
        f"select package, version, path, cast(unnest(range(len(m))) as integer) as pos, unnest(m) as hit from ("
        f"select package, version, path, regexp_extract_all(content, {_lit(pattern)}, {group}) as m from {source}) a) b"
    )


FS_HITS = "fs_hits as (" + " union all ".join(
    _all_matches("hidden", _re2(p), i) for i, p in enumerate(rules.FILESYSTEM_PATTERNS)
) + ")"
SHELL_CALLS = "shell_calls as (" + " union all ".join(
    _all_matches("hidden", _re2(p), i, hit="left(hit, 100)") for i, p in enumerate(rules.SHELL_PATTERNS)
) + ")"


def _shell_strings(source: str) -> str:
    return _all_matches(source, _re2(rules.SHELL_STRING_PATTERN), len(rules.SHELL_PATTERNS), hit="left(hit, 100)")


SHELL_STRINGS = f"shell_strings as ({_shell_strings('hidden')})"


def _network_text() -> str:
    tests = [(f"regexp_matches(content, {_lit(_re2(p))})", f"Regex match: {p}") for p in rules.NETWORK_PATTERNS]
    for m in rules.NETWORK_MODULES:
        forms = [f"require({q}{m}{q})" for q in "'\""] + [f"from {q}{m}{q}" for q in "'\""]
        tests.append(("(" + " or ".join(f"contains(content, {_lit(f)})" for f in forms) + ")", f"Module: {m}"))
    for g in rules.NETWORK_GLOBALS:
        tests.append((f"regexp_matches(content, {_lit(rf'\b{g}\s*\(')})", f"Global: {g}"))
    return "net_text as (" + " union all ".join(
        f"select package, version, path, {i} as rule_ord, cast(0 as integer) as pos, {_lit(hit)} as hit from git where {test}"
        for i, (test, hit) in enumerate(tests)
    ) + ")"


NET_TEXT = _network_text()
_MODS = "|".join(rules.NETWORK_MODULES)
_CLEAN = (
    rf"""("(?:{_MODS})"|'(?:{_MODS})'|`(?:[^`\\]|\\(?:.|\n))*`?)"""
    r"""|"(?:[^"\\\n]|\\(?:.|\n))*"|'(?:[^'\\\n]|\\(?:.|\n))*'"""
    r"""|("(?:[^"\\\n]|\\(?:.|\n))*|'(?:[^'\\\n]|\\(?:.|\n))*)"""
    r"""|/\*(?:(?:.|\n)*?\*/|(?:.|\n)*)|//[^\n]*"""
)
CLEAN = (
    "clean as (select package, version, path, "
    f"regexp_replace(content, {_lit(_CLEAN)}, '\\1\\2', 'g') as content from git)"
)


def _network_structure() -> str:
    n = len(rules.NETWORK_PATTERNS) + len(rules.NETWORK_MODULES) + len(rules.NETWORK_GLOBALS)
    calls, news = "|".join(rules.NETWORK_CALLS), "|".join(rules.NETWORK_CONSTRUCTORS)
    kinds = [
        (rf"""(?:^|[;\n}}])\s*import\b(?:[^'"`;()]*\bfrom\s*|\s*)['"]({_MODS})['"]""", "concat('Import: ', h)"),
        (rf"""(?:^|[^.\w$])((?:new\s+|function\s+)?(?:{calls})\s*\()""", "concat('Call: ', regexp_extract(h, '^(\\w+)', 1), '()')"),
        (rf"""(?:^|[^.\w$])require\s*\(\s*['"]({_MODS})['"]\s*[,)]""", "concat('Require: ', h)"),
        (rf"""(?:^|[^\w$])new\s+({news})(?:[^\w$.]|$)""", "concat('New: ', h)"),
    ]
    parts = []
    for i, (pattern, name) in enumerate(kinds):
        # distinct names in order of their first place in the file
        found = (
            "select package, version, path, cast(unnest(range(len(m))) as integer) as p, unnest(m) as h from ("
            f"select package, version, path, regexp_extract_all(content, {_lit(pattern)}, 1) as m from clean) a"
        )
        parts.append(
            f"select package, version, path, {n + i} as rule_ord, cast(row_number() over (partition by package, version, path order by min(p)) - 1 as integer) as pos, "
            f"{name} as hit from ({found}) b where not regexp_matches(h, '^(new|function)\\s') group by package, version, path, {name}"
        )
    return "net_structure as (" + " union all ".join(parts) + ")"


NET_STRUCTURE = _network_structure()


def _distinct(name: str, source: str) -> str:
    """Each distinct hit of a version with its first place."""
    return (
        f"{name} as (select package, version, hit, min(struct_pack(a := path, b := rule_ord, c := pos)) as seen "
        f"from ({source}) s group by package, version, hit)"
    )


NET = _distinct("net", "select * from net_text union all select * from net_structure")
FS = _distinct("fs", "select * from fs_hits")
SHELL = _distinct("shell", "select * from shell_calls union all select * from shell_strings")
_NETWORK = (FILES, GIT, NET_TEXT, CLEAN, NET_STRUCTURE, NET)
_FILESYSTEM = (FILES, HIDDEN, FS_HITS, FS)
_SHELL = (FILES, HIDDEN, SHELL_CALLS, SHELL_STRINGS, SHELL)


def _entropy_of(source: str, keys: str, text: str, name: str = "entropy_rows") -> str:
    return (
        f"{name} as (select {keys}, -sum(c * 1.0 / n * log2(c * 1.0 / n)) as entropy from ("
        f"select {keys}, n, ch, cast(count(*) as double) as c from (select {keys}, cast(length({text}) as double) as n, "
        f"unnest(string_split({text}, '')) as ch from {source}) a group by {keys}, n, ch) b group by {keys})"
    )


LONG = "long_files as (select * from hidden where length(content) >= 100)"
ENTROPY = _entropy_of("long_files", "package, version, path", "content")
OBFUSCATED = (
    "obfuscated as (select package, version, path as file, floor(entropy * 100 + 0.5) / 100 as entropy "
    "from entropy_rows where entropy > 5.5)"
)
_OBFUSCATED = (FILES, HIDDEN, LONG, ENTROPY, OBFUSCATED)

MANIFESTS = f"manifests as ({corpora.MANIFESTS})"
SCRIPTS = (
    "scripts as (select package, version, case d % 4 when 0 then 'postinstall' when 1 then 'preinstall' else 'install' end as name, "
    "concat('node s', d, '.js') as command from manifests where d % 5 <> 0 and d % 4 <> 2)"
)
_SCRIPTS = (MANIFESTS, SCRIPTS)

PAIRS = f"pairs as ({corpora.LOCK_PAIRS})"
BAD_ROWS = f"bad_rows as ({corpora.KNOWN_BAD})"
BAD = (
    "bad as (select package, version, incident, date, description, malicious_dependency from ("
    "select *, row_number() over (partition by package, version order by entry_ord) as rn from bad_rows) r where rn = 1)"
)
IOC = "ioc as (select distinct malicious_dependency as package from bad_rows)"
_KINDS = "(values ('package-lock.json', 0), ('yarn.lock', 1), ('pnpm-lock.yaml', 2)) k(file_name, kind)"
ENTRIES = f"entries as (select project, file_name, kind, package, version from pairs cross join {_KINDS})"
MATCHES = (
    "matches as (select project, e.file_name, e.package, e.version, kind, 0 as match, "
    "concat('Known-compromised version ', e.package, '@', e.version, ' found in ', file_name, ' (', incident, ')') as reason "
    "from entries e join bad on e.package = bad.package and e.version = bad.version "
    "union all select project, file_name, package, version, kind, 1 as match, "
    "concat('IOC dependency ', package, '@', version, ' found in ', file_name, ' — associated with a known supply chain incident') "
    "from entries where package in (select package from ioc))"
)
_MATCHES = (PAIRS, BAD_ROWS, BAD, IOC, ENTRIES, MATCHES)
REQUESTS = f"requests as ({corpora.REQUESTS})"
REGISTRY = f"registry as ({corpora.REGISTRY})"
GONE = (
    "gone as (select * from requests r where not exists (select 1 from registry g "
    "where g.package = r.package and g.version = r.version))"
)
COMPROMISED = (
    "compromised as (select g.project, g.package, g.version, b.incident, b.date, b.description, b.malicious_dependency "
    "from gone g join bad b on g.package = b.package and g.version = b.version)"
)
_COMPROMISED = (REQUESTS, REGISTRY, GONE, BAD_ROWS, BAD, COMPROMISED)

WORDS = "words as (select unnest(regexp_extract_all(text, '[a-z]+')) as package from documents)"
POPULAR = (
    "popular as (select package, cast(row_number() over (order by n desc, package) as integer) as rank from ("
    "select package, count(*) as n from words group by package order by n desc, package limit 200) t)"
)
NAMES = "names as (select distinct package from words)"
LOOKALIKES = (
    "lookalikes as (select *, floor((1 - distance * 1.0 / longest) * 100 + 0.5) / 100 as similarity from ("
    "select n.package, p.package as popular, p.rank, cast(levenshtein(n.package, p.package) as integer) as distance, "
    "cast(greatest(length(n.package), length(p.package)) as double) as longest "
    "from names n join popular p on n.package <> p.package and abs(length(n.package) - length(p.package)) <= 2) d "
    "where distance between 1 and 2 and 1 - cast(distance as double) / longest >= 0.75)"
)
_LOOKALIKES = (WORDS, POPULAR, NAMES, LOOKALIKES)
SQUATS = (
    "squats as (select package, min(place_distance) as best, "
    "string_agg(concat(popular, ':', distance, ':', cast(similarity * 100 as integer)), '|' order by place) as detail, "
    "min(case when place = 1 then popular end) as top, min(case when place = 1 then distance end) as top_distance from ("
    "select *, distance as place_distance, row_number() over (partition by package order by distance, rank) as place from lookalikes) r "
    "where place <= 5 group by package)"
)

FEED = f"feed as ({corpora.CHANGES})"

# --- the scan: alerts of every version of the derived corpus ----------------------

_ORDERED = "string_agg(hit, ' | ' order by seen)"
SCAN_ALERTS = (
    "alerts as ("
    "select package, version, 1 as detector_ord, 'install_script' as alert_type, 'high' as severity, "
    "concat('Package contains install scripts: ', name) as message, concat(name, '=', command) as detail, cast(null as bigint) as n from scripts "
    f"union all select package, version, 2, 'network_access', 'medium', 'Package makes network requests', {_ORDERED}, count(*) from net group by package, version "
    f"union all select package, version, 4, 'filesystem_access', 'medium', 'Package accesses the filesystem', {_ORDERED}, count(*) from fs group by package, version "
    "union all select package, version, 5, 'obfuscated_code', 'high', 'Package contains obfuscated code with high entropy', cast(null as varchar), cast(null as bigint) "
    "from obfuscated group by package, version "
    "union all select package, version, 6, 'shell_access', 'high', 'Package executes shell commands', "
    "string_agg(hit, ' | ' order by seen) filter (where rn <= 10), count(*) from ("
    "select *, row_number() over (partition by package, version order by seen) as rn from shell) s group by package, version)"
)
_SCAN = (
    FILES, GIT, HIDDEN, NET_TEXT, CLEAN, NET_STRUCTURE, NET, FS_HITS, FS, SHELL_CALLS, SHELL_STRINGS, SHELL,
    LONG, ENTROPY, OBFUSCATED, MANIFESTS, SCRIPTS, SCAN_ALERTS,
)
_ALERT = "package, version, alert_type, severity, message"
_HIT_COLUMNS = "package, version, path, rule_ord, pos, hit"
_NAMED_NETWORK = {"net_text": (FILES, GIT, NET_TEXT), "net_structure": (FILES, GIT, CLEAN, NET_STRUCTURE)}


def _entries_of(kind: str, nested: bool = False) -> str:
    return _with(PAIRS, select=f"select project, '{kind}' as file_name, package, version from pairs")


def _report(lines: str) -> str:
    return _with(*_MATCHES, select=lines)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # sources and sinks
    q["ingest_archives"] = _with(
        FILES,
        select="select concat('doc-', regexp_extract(path, 'f(\\d+)[.]', 1)) as package, '1.0.0' as version, path, content from files "
        "union all select concat('doc-', regexp_extract(path, 'f(\\d+)[.]', 1)), '1.0.0', 'package.json', "
        "concat('{', chr(34), 'name', chr(34), ': ', chr(34), path, chr(34), '}') from files",
    )
    q["read_package_tree"] = _with(FILES, select="select package, version, path, content from files")
    q["source_files"] = _with(
        FILES, HIDDEN, GIT,
        select="select 'hidden_pruned' as walk, package, version, path from hidden "
        "union all select 'git_pruned', package, version, path from git",
    )
    q["read_manifests"] = _with(MANIFESTS, select="select package, version, manifest from manifests")
    q["declared_dependencies"] = _with(
        PAIRS,
        select="select project, package, case when version like '1.0.%' then concat('9.', version) else version end as version from pairs",
    )
    q["read_lockfiles"] = _with(
        PAIRS,
        select=f"select project, file_name, kind as kind_ord, concat(project, '/', file_name) as path from (select distinct project from pairs) p cross join {_KINDS}",
    )
    q["popular_packages"] = _with(WORDS, POPULAR, select="select package, rank from popular")
    q["known_bad_table"] = _with(
        BAD_ROWS,
        select="select package, version, incident, date, malicious_dependency, concat('bad ', package) as description from bad_rows",
    )
    q["ioc_dependencies"] = _with(BAD_ROWS, IOC, select="select package from ioc")
    q["write_alerts"] = _with(*_FILESYSTEM, select=(
        "select package, version, 'filesystem_access' as alert_type, 'medium' as severity, count(*) as n from fs group by package, version"))
    # content detectors
    q["match_patterns"] = _with(FILES, HIDDEN, select=_all_matches("hidden", "[A-Za-z]+ion", 0) + " union all " + _all_matches("hidden", r"\d{3,}", 1))
    q["filesystem_hits"] = _with(FILES, HIDDEN, FS_HITS, select=f"select {_HIT_COLUMNS} from fs_hits")
    q["shell_hits"] = _with(FILES, HIDDEN, SHELL_CALLS, select=f"select {_HIT_COLUMNS} from shell_calls")
    q["shell_string_hits"] = _with(
        "raw_pages as (select concat('page-', page_id) as package, '1.0.0' as version, 'page.js' as path, html as content from pages)",
        FILES, HIDDEN, f"hits as ({_shell_strings('hidden')} union all {_shell_strings('raw_pages')})",
        select=f"select {_HIT_COLUMNS} from hits",
    )
    q["network_hits"] = _with(*_NAMED_NETWORK["net_text"], select=f"select {_HIT_COLUMNS} from net_text")
    q["network_structural_hits"] = _with(*_NAMED_NETWORK["net_structure"], select=f"select {_HIT_COLUMNS} from net_structure")
    q["char_entropy"] = _with(
        _entropy_of("documents", "doc_id", "text", "doc_entropy"), _entropy_of("pages", "page_id", "html", "page_entropy"),
        select="select 'documents' as source, doc_id as id, round(entropy, 6) as entropy from doc_entropy "
        "union all select 'pages', page_id, round(entropy, 6) from page_entropy",
    )
    q["obfuscated_files"] = _with(*_OBFUSCATED, select="select package, version, file, entropy from obfuscated")
    q["install_scripts"] = _with(*_SCRIPTS, select="select package, version, name, command from scripts")
    # roll-ups
    q["network_alerts"] = _with(*_NETWORK, select=(
        "select package, version, 'medium' as severity, 'Package makes network requests' as message, "
        f"{_ORDERED} as patterns, count(*) as n from net group by package, version"))
    q["filesystem_alerts"] = _with(*_FILESYSTEM, select=(
        "select package, version, 'medium' as severity, 'Package accesses the filesystem' as message, hit as pattern, "
        "count(*) over (partition by package, version) as n from fs"))
    q["shell_alerts"] = _with(*_SHELL, select=(
        "select package, version, 'high' as severity, 'Package executes shell commands' as message, "
        "string_agg(hit, ' | ' order by seen) filter (where rn <= 10) as patterns, count(*) as n from ("
        "select *, row_number() over (partition by package, version order by seen) as rn from shell) s group by package, version"))
    q["obfuscation_alerts"] = _with(*_OBFUSCATED, select=(
        "select package, version, 'high' as severity, 'Package contains obfuscated code with high entropy' as message, "
        "5.5 :: double as threshold, file, entropy from obfuscated"))
    q["install_script_alerts"] = _with(*_SCRIPTS, select=(
        "select package, version, 'high' as severity, concat('Package contains install scripts: ', name) as message, "
        "concat(name, '=', command) as scripts from scripts"))
    # names
    pairs = "select package, popular, rank, distance, similarity from lookalikes"
    q["typosquat_pairs"] = _with(*_LOOKALIKES, select=pairs)
    q["typosquat_pairs_blocked"] = _with(*_LOOKALIKES, select=pairs)
    q["typosquat_alerts"] = _with(*_LOOKALIKES, SQUATS, select=(
        "select package, case when top_distance = 1 then 'high' else 'medium' end as severity, "
        "concat('Potential typosquat of popular package \"', top, '\" (distance: ', top_distance, ')') as message, detail as matches from squats"))
    # lockfiles and indicators
    q["npm_lock_entries"] = _entries_of("package-lock.json")
    q["yarn_lock_entries"] = _entries_of("yarn.lock")
    q["pnpm_lock_entries"] = _entries_of("pnpm-lock.yaml")
    q["leaf_lock_entries"] = _with(PAIRS, select=(
        f"select concat(project, '/', package) as project, file_name, name as package, version from (select *, unnest([package, concat('@s/', package)]) as name from pairs) p cross join {_KINDS}"))
    match_columns = "project, file_name, package, version, reason"
    q["known_bad_matches"] = _with(*_MATCHES, select=f"select {match_columns} from matches where match = 0")
    q["ioc_dependency_matches"] = _with(*_MATCHES, select=f"select {match_columns} from matches where match = 1")
    q["lockfile_alerts"] = _with(*_MATCHES, select=(
        "select project, package, version, 'lockfile_match' as alert_type, 'high' as severity, reason as message, concat(project, '/', file_name) as file, "
        "cast(row_number() over (partition by project order by kind, package, match) as integer) as place from matches"))
    q["unavailable_requests"] = _with(REQUESTS, REGISTRY, GONE, select="select project, package, version from gone")
    q["known_compromised_alerts"] = _with(*_COMPROMISED, select=(
        "select project, package, version, 'high' as severity, "
        "concat(package, '@', version, ' is a known-compromised version that was removed from npm') as message, "
        "incident, date, description, malicious_dependency from compromised"))
    incident_ctes = (*_COMPROMISED, PAIRS, IOC, ENTRIES, MATCHES)
    q["incident_lockfile_alerts"] = _with(*incident_ctes, select=(
        "select c.project, c.package, c.version, m.reason as message, m.package as locked_package, m.version as locked_version "
        "from compromised c join matches m on c.project = m.project"))
    # scan and reports
    q["scan_packages"] = _with(*_SCAN, select=f"select {_ALERT}, detector_ord, detail, n from alerts")
    listed = "string_agg(alert_type, ',' order by detector_ord)"
    results = (
        "select v.package, v.version, coalesce(a.n, 0) as alert_count, coalesce(a.types, '') as alert_types from "
        "(select distinct package, version from files) v left join (select package, version, count(*) as n, "
        f"{listed} as types from alerts group by package, version) a on a.package = v.package and a.version = v.version"
    )
    q["scan_results"] = _with(*_SCAN, select=f"select package, version, alert_count, alert_types, true as stamped from ({results}) r")
    q["order_by_severity"] = _with(*_SCAN, select=(
        "select package, version, alert_type, severity, cast(row_number() over (partition by package, version "
        "order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, detector_ord) as integer) as place from alerts"))
    q["scan_summary"] = _with(*_SCAN, select=(
        "select package, version, alert_count, case when alert_count = 0 then 'PASS' else 'WARN' end as status, "
        "case when alert_count = 0 then 'NO THREATS DETECTED' when alert_count = 1 then '1 ALERT FOUND' "
        f"else concat(alert_count, ' ALERTS FOUND') end as headline from ({results}) r"))
    first = lambda n: f"array_to_string(list_slice(string_split(detail, ' | '), 1, {n}), ', ')"
    level = "case severity when 'high' then 'error' when 'medium' then 'warning' else 'notice' end"
    q["annotation_rows"] = _with(*_SCAN, select=(
        f"select package, version, detector_ord, cast(0 as integer) as line_no, concat('::', {level}, '::', replace(upper(alert_type), '_', ' '), ': ', message) as line from alerts "
        f"union all select package, version, detector_ord, 1, concat('::', {level}, '::Detected patterns: ', {first(3)}) from alerts where n is not null "
        f"union all select package, version, detector_ord, 1, concat('::', {level}, '::Scripts: ', regexp_extract(detail, '^([^=]+)=', 1)) from alerts where alert_type = 'install_script'"))
    q["plain_report_rows"] = _with(*_SCAN, select=(
        "select package, version, detector_ord, cast(row_number() over (partition by package, version, detector_ord order by k, i) - 1 as integer) as line_no, line from ("
        "select package, version, detector_ord, 0 as k, unnest([0, 1, 2, 3]) as i, unnest(['', repeat('=', 60), concat('[', upper(severity), '] ', replace(upper(alert_type), '_', ' ')), message]) as line from alerts "
        "union all select package, version, detector_ord, 1, unnest([0, 1]), unnest(['', 'Detected patterns:']) from alerts where n is not null "
        "union all select package, version, detector_ord, 2, i, concat('  - ', p) from (select package, version, detector_ord, unnest(range(len(l))) as i, unnest(l) as p from ("
        "select package, version, detector_ord, list_slice(string_split(detail, ' | '), 1, 5) as l from alerts where n is not null) z) y "
        "union all select package, version, detector_ord, 3, 0, concat('  ... and ', size - 5, ' more') from (select *, len(string_split(detail, ' | ')) as size from alerts where n is not null) s where size > 5 "
        "union all select package, version, detector_ord, 1, unnest([0, 1, 2]), unnest(['', 'Scripts found:', concat('  - ', replace(detail, '=', ': '))]) from alerts where alert_type = 'install_script' "
        "union all select package, version, detector_ord, 9, 0, repeat('=', 60) from alerts) lines"))
    q["gate"] = _with(*_MATCHES, select=(
        "select p.project, coalesce(n, 0) as alert_count, coalesce(n, 0) as failing_count, case when coalesce(n, 0) > 0 then 'FAIL' else 'PASS' end as status "
        "from (select distinct project from pairs) p left join (select project, count(*) as n from matches group by project) m on p.project = m.project"))
    # feed
    published = "from feed where name is not null"
    q["read_changes"] = _with(FEED, select="select seq, name is null as deleted, name as package, version from feed")
    q["publications"] = _with(FEED, select=f"select seq, name as package, version {published}")
    q["resume_from_seq"] = _with(FEED, select=(
        f"select seq, name as package, version {published} and seq > (select count(*) / 2 from events)"))
    q["dedupe_publications"] = _with(FEED, select=f"select distinct name as package, version {published}")
    versions = "versions as (select package, version, min(path) as p from files group by package, version)"
    q["quarantine"] = _with(FEED, FILES, versions, select=(
        "select f.seq, f.name as package, f.version, case when v.package is null then 'no files' else 'ok' end as reason "
        "from feed f left join versions v on v.package = f.name and v.version = f.version where f.name is not null"))
    q["scan_stream"] = _with(FEED, *_FILESYSTEM, select=(
        "select a.package, a.version, 'filesystem_access' as alert_type, a.n from (select package, version, count(*) as n from fs group by package, version) a "
        "where exists (select 1 from feed f where f.name = a.package and f.version = a.version)"))
    # extension
    q["extra_detectors"] = _with(*_SCAN, select=(
        "select package, version, alert_type, detector_ord from alerts union all "
        "select package, version, 'long_file', 100 from files where length(content) > 20000 group by package, version"))
    return q
