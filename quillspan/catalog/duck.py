"""DuckDB expressions the oracle SQL is written with."""

from __future__ import annotations

from quillspan import constants as K
from quillspan.catalog.registry import quote as q

_WS = K.WS_CLASS


def trimmed(x: str) -> str:
    return f"trim({x}, {q(K.WS_CHARS)})"


def re_all(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"


def re_first(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def simplified(x: str) -> str:
    return f"trim({re_all(x, f'[{_WS}]+', ' ')})"


def ascii_squash(x: str) -> str:
    return f"trim({re_all(x, '[\\t-\\r ]+', ' ')})"


def unix(x: str) -> str:
    return re_all(x, "\r\n?", "\n")


def normalize_block(x: str) -> str:
    y = re_all(x, r"[ \t]+(\n|\z)", r"\1")
    return trimmed(re_all(y, "\n{4,}", "\n\n\n"))


def clean(x: str) -> str:
    y = f"replace({unix(x)}, chr(9), '    ')"
    return normalize_block(re_all(y, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{A0}]", " "))


def clean_page(x: str) -> str:
    y = f"replace({unix(x)}, chr(9), '    ')"
    return re_all(y, r"[\x00-\x08\x0B\x0E-\x1F\x{A0}]", " ")


def preview(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE {trimmed(f'left({x}, {max(80, n)})')} || ' …' END"


def compact(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN trim(left({x}, {n - 3})) || '...' ELSE {x} END"


def count_re(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def words(x: str) -> str:
    return count_re(x, r"[\p{L}\p{N}]+")


def alnum(x: str) -> str:
    return f"length({re_all(x, r'[^\p{L}\p{N}]+', '')})"


def count_of(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(needle)}, ''))) // {len(needle)})"


def lines(x: str) -> str:
    return f"CASE WHEN {trimmed(x)} = '' THEN 0 ELSE {count_of(x, chr(10))} + 1 END"


def has_any(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def starts_any(x: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in prefixes) + ")"


def one_of(x: str, values: list[str]) -> str:
    return f"{x} IN (" + ", ".join(q(v) for v in values) + ")"


def token_list(x: str, allowed: str) -> str:
    return f"list_filter(string_split({re_all(x, f'[^{allowed}]+', ' ')}, ' '), lambda t: t <> '')"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda tok, nth: list_position({x}, tok) = nth)"


def synonym_map(table: dict[str, list[str]]) -> str:
    keys = ", ".join(q(k) for k in table)
    values = ", ".join("[" + ", ".join(q(v) for v in vs) + "]" for vs in table.values())
    return f"MAP([{keys}], [{values}])"


def query_terms(x: str) -> str:
    kept = f"list_filter({token_list(f'lower({x})', 'a-z0-9._+:-')}, lambda t: length(t) >= 2 AND NOT {one_of('t', K.QUERY_STOP_WORDS)})"
    table = synonym_map(K.QUERY_SYNONYMS)
    full = f"flatten(list_transform({kept}, lambda t: list_concat([t], coalesce(({table})[t], []))))"
    return full


def is_marker(x: str) -> str:
    return f"(starts_with({x}, '[[PAGE ') AND ends_with({x}, ']]'))"


def is_fence(x: str) -> str:
    return f"(starts_with({x}, '```') OR starts_with({x}, '~~~'))"


def is_heading(x: str) -> str:
    return f"(starts_with({x}, '#') OR {matches(x, K.RE_NUMBERED_HEADING)} OR {matches(x, K.RE_TITLED_HEADING)})"


def is_bullet(x: str) -> str:
    return matches(x, K.RE_BULLET)


def is_code(raw: str, line: str) -> str:
    tests = [f"starts_with({raw}, '    ')", f"starts_with({raw}, chr(9))", f"starts_with({line}, '$')",
             f"starts_with({line}, '#')", has_any(line, ["::", "=>", "{", "}", "="])]
    return f"({line} <> '' AND (" + " OR ".join(tests) + "))"


def is_lead(x: str) -> str:
    tests = " OR ".join(matches(x, p) for p in (K.RE_LEAD_NUMBERED, K.RE_LEAD_IMPERATIVE, K.RE_LEAD_STEP))
    return f"({x} <> '' AND NOT {is_marker(x)} AND ({tests}))"


def is_contents(x: str) -> str:
    return (
        f"({x} <> '' AND length({x}) <= 220 AND NOT {is_marker(x)} AND ({matches(x, K.RE_DOTTED_LEADER)} "
        f"OR {matches(x, K.RE_TRAILING_PAGE)}))"
    )


def outline_key(x: str) -> str:
    return f"lower({simplified(re_first(trimmed(x), r'\.{2,}\s*\d+\z', ''))})"


def strip_page(x: str) -> str:
    y = re_first(trimmed(x), r"\.{2,}\s*\d+\z", "")
    return trimmed(re_first(y, r"\s+\d+\z", ""))


def structure(x: str) -> str:
    heads = f"len(list_filter(string_split({x}, chr(10)), lambda l: {is_heading(trimmed('l'))}))"
    return (
        f"({has_any(f'lower({x})', K.STRUCTURE_WORDS)} OR {heads} >= 3 OR {count_re(x, K.RE_SPLIT_HEADING_PAIR)} >= 2)"
    )


def keep_chunk(x: str, simple: str) -> str:
    """``simple`` is the simplified form of ``x``."""
    struct = f"(contains({x}, chr(10)) AND {has_any(x, ['{', '=', ':', '->'])})"
    return (
        f"({simple} <> '' AND (length({simple}) >= 80 OR CASE WHEN {struct} THEN {alnum(simple)} >= 18 AND {words(simple)} >= 3 "
        f"ELSE {alnum(simple)} >= 32 AND {words(simple)} >= 6 END))"
    )


def redact(x: str) -> str:
    for pattern in K.REDACTION_PATTERNS:
        x = re_all(x, pattern, K.REDACTION_TEXT)
    return ascii_squash(x)


def host(x: str) -> str:
    return f"regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"


def html_snippet(x: str) -> str:
    y = re_all(x, "<[^>]+>", " ")
    for entity, plain in K.HTML_ENTITIES:
        y = f"replace({y}, {q(entity)}, {q(plain)})"
    y = re_all(y, "[\t\r\n]+", " ")
    for marker in K.ENVELOPE_MARKERS:
        y = f"replace({y}, {q(marker)}, {q(K.ENVELOPE_REPLACEMENT)})"
    return simplified(y)


def drop_tags(x: str) -> str:
    for literal in [K.END_TAG, *[t for pair in reversed(K.HIDDEN_TAGS) for t in pair]]:
        x = f"replace({x}, {q(literal)}, '')"
    return x


def dedup_key(x: str) -> str:
    return f"left(lower({simplified(drop_tags(unix(x)))}), 240)"


def sanitize_section(x: str) -> str:
    y = f"replace({unix(x)}, {q(K.END_TAG)}, '')"
    y = re_all(y, r"(?s)<think>.*?</think>", "")
    return trimmed(re_all(drop_tags(y), "\n{4,}", "\n\n\n"))


def loop_line(x: str) -> str:
    return f"left(trim({re_all(f'lower({x})', '[^a-z0-9]+', ' ')}), {K.LOOP_LINE_CHARS})"


def trim_budget(x: str, n: int) -> str:
    """``x`` is already trimmed."""
    room = n - len(K.BUDGET_TRIM_MARKER)
    head = int(room * 0.58)
    h, t = trimmed(f"left({x}, {head})"), trimmed(f"right({x}, {room - head})")
    return (
        f"CASE WHEN length({x}) <= {n} THEN {x} WHEN {t} = '' OR {h} = {t} THEN {h} ELSE {h} || {q(K.BUDGET_TRIM_MARKER)} || {t} END"
    )


def balanced(x: str, n: str) -> str:
    """``x`` is already trimmed; ``n`` is an SQL expression."""
    room = f"greatest(0, {n} - {len(K.STUDY_TRIM_MARKER)})"
    head = f"CAST(floor({room} * 0.62::DOUBLE) AS BIGINT)"
    return (
        f"CASE WHEN length({x}) <= {n} THEN {x} ELSE {trimmed(f'left({x}, {head})')} || {q(K.STUDY_TRIM_MARKER)} || "
        f"{trimmed(f'right({x}, {room} - {head})')} END"
    )


def memory_key(x: str) -> str:
    k = re_all(re_all(f"lower({x})", "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return f"left(CASE WHEN {k} = '' THEN 'memory-note' ELSE {k} END, 64)"


def memory_value(x: str) -> str:
    y = re_all(x, "^[\"'`\\t-\\r ]+|[\"'`\\t-\\r ]+\\z", "")
    y = trimmed(re_all(y, r"[\t-\r ]+", " "))
    z = f"CASE WHEN {y} = '' OR {matches(y, r'[.!?]\z')} THEN {y} ELSE {y} || '.' END"
    return compact(simplified(z), 220)


def safe_value(x: str) -> str:
    t = trimmed(x)
    low = f"lower({t})"
    brackets = f"length({low}) - length({re_all(low, '[{}<>\\[\\]]', '')})"
    return (
        f"(length({t}) BETWEEN 3 AND 220 AND NOT contains({t}, chr(10)) AND NOT contains({t}, '```') AND NOT ends_with({t}, '?') "
        f"AND NOT {has_any(low, K.UNSAFE_PHRASES)} AND {brackets} < 4 AND {count_re(low, '[a-z0-9]+')} <= 32)"
    )


def role_bias(intent: str, role: str) -> str:
    cases = " ".join(
        f"WHEN {intent} = {q(i)} AND {role} = {q(r)} THEN {w}::DOUBLE" for i, t in K.ROLE_BIAS.items() for r, w in t.items())
    return f"(CASE {cases} ELSE 0::DOUBLE END)"


def bound(low, x, high) -> str:
    return f"greatest({low}, least({high}, {x}))"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5::DOUBLE) AS BIGINT)"


def last_nl(x: str, upto: str) -> str:
    """0-based index of the last newline at or before ``upto``; -1 if none."""
    head = f"left({x}, {upto} + 1)"
    return f"CASE WHEN contains({head}, chr(10)) THEN length({head}) - strpos(reverse({head}), chr(10)) ELSE -1 END"


def occurrences(x: str, t: str) -> str:
    """Overlapping occurrences; positions are walked only where the term does overlap itself in the text."""
    plain = f"(length({x}) - length(replace({x}, {t}, ''))) // length({t})"
    walked = f"len(list_filter(range(1, length({x}) + 1), lambda p: substr({x}, p, length({t})) = {t}))"
    overlaps = f"lambda b: left({t}, b) = right({t}, b) AND contains({x}, {t} || substr({t}, b + 1))"
    return (
        f"CASE WHEN NOT contains({x}, {t}) THEN 0 WHEN len(list_filter(range(1, length({t})), {overlaps})) > 0 "
        f"THEN {walked} ELSE {plain} END"
    )
