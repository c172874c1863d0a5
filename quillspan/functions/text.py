"""Text clean-up, measures, keys and budgeted trims as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from quillspan import constants as K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def any_contains(c: Column, needles: list[str]) -> Column:
    """True when ``c`` contains one of ``needles``."""
    out = F.lit(False)
    for needle in needles:
        out = out | c.contains(needle)
    return out


def any_equals(c: Column, values: list[str]) -> Column:
    return c.isin(*values)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(K.WS_CHARS))


def simplified(c: Column) -> Column:
    """Every white-space run becomes one space; both ends trimmed."""
    return F.trim(F.regexp_replace(c, f"[{K.WS_CLASS}]+", " "))


def is_blank(c: Column) -> Column:
    return trimmed(c) == ""


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def rstrip_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<![ \t])[ \t]+(\n|\z)", "$1")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{4,}", "\n\n\n")


def clean_text(c: Column) -> Column:
    c = F.replace(unix_newlines(c), F.lit("\t"), F.lit("    "))
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\xA0]", " ")
    return trimmed(collapse_blank_lines(rstrip_lines(c)))


def clean_page_text(c: Column) -> Column:
    """As ``clean_text`` but form feeds survive, so pages can still be split."""
    c = F.replace(unix_newlines(c), F.lit("\t"), F.lit("    "))
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0E-\x1F\xA0]", " ")


def normalize_block(c: Column) -> Column:
    return trimmed(collapse_blank_lines(rstrip_lines(c)))


def compact_preview(c: Column, n: int) -> Column:
    text = normalize_block(c)
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(trimmed(F.left(text, F.lit(max(80, n)))), F.lit(" …"))
    )


def compact(c: Column, n: int) -> Column:
    text = simplified(c)
    return F.when(F.length(text) > n, F.concat(F.trim(F.left(text, F.lit(n - 3))), F.lit("..."))).otherwise(text)


def count_of(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+"))


def count_lines(c: Column) -> Column:
    return F.when(is_blank(c), F.lit(0)).otherwise(count_of(c, "\n") + 1)


def fingerprint(c: Column) -> Column:
    return F.sha1(F.encode(simplified(c), "UTF-8"))


def content_hash(content: Column) -> Column:
    """SHA-1 of raw bytes."""
    return F.sha1(content)


def sanitize_for_embedding(c: Column) -> Column:
    c = F.regexp_replace(unix_newlines(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\xA0]", " ")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return trimmed(collapse_blank_lines(c))


def _class_of(chars: str) -> str:
    return "[" + "".join("\\" + ch if ch in r"\[]^-&" else ch for ch in chars) + "]"


def estimate_tokens(c: Column) -> Column:
    """Closed form of the unit weights: one class count per weight."""
    alnum = alnum_count(c)
    runs = count_words(c)
    newlines = count_of(c, "\n")
    spaces = F.length(c) - F.length(F.regexp_replace(c, f"[{K.WS_CLASS}]+", "")) - newlines
    dense = F.length(c) - F.length(F.regexp_replace(c, _class_of(K.TOKEN_DENSE_CHARS) + "+", ""))
    other = F.length(c) - alnum - newlines - spaces - dense
    units = alnum + runs + newlines * 3 + spaces + dense * 4 + other * 2
    return F.when(is_blank(c), F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(units / 4).cast("int")))


def last_index(c: Column, needle: str, upto: Column) -> Column:
    """0-based index of the last ``needle`` that starts at or before ``upto``; -1 if none."""
    head = F.left(c, upto + len(needle))
    pos = F.locate(needle[::-1], F.reverse(head))
    return F.when(pos > 0, F.length(head) - pos - (len(needle) - 1)).otherwise(F.lit(-1))


def _head_tail(c: Column, head: Column, tail: Column, marker: str) -> Column:
    return F.concat(trimmed(F.left(c, head)), F.lit(marker), trimmed(F.right(c, tail)))


def balanced_trim(c: Column, n: Column | int) -> Column:
    """Head 62 % and tail around the study marker."""
    n = F.lit(n) if isinstance(n, int) else n
    text = trimmed(c)
    room = F.greatest(F.lit(0), n - len(K.STUDY_TRIM_MARKER))
    head = F.floor(room * F.lit(0.62)).cast("int")
    return F.when((n <= 0) | (F.length(text) <= n), text).otherwise(
        _head_tail(text, head, room - head, K.STUDY_TRIM_MARKER)
    )


def trim_for_budget(c: Column, n: int) -> Column:
    """Head 58 % and tail around the budget marker; tiny budgets are cut plainly."""
    text = trimmed(c)
    if n <= 0:
        return text
    marker = K.BUDGET_TRIM_MARKER
    if n <= len(marker) + 32:
        short = trimmed(F.left(text, F.lit(n)))
    else:
        room = n - len(marker)
        head_chars = int(room * 0.58)
        head = trimmed(F.left(text, F.lit(head_chars)))
        tail = trimmed(F.right(text, F.lit(room - head_chars)))
        short = F.when((tail == "") | (head == tail), head).otherwise(F.concat(head, F.lit(marker), tail))
    return F.when(F.length(text) <= n, text).otherwise(short)


def compact_for_retry(c: Column, n: int) -> Column:
    """Head 55 % and tail around the retry marker; ``c`` is an already deduplicated section."""
    text = trimmed(c)
    if n <= 0:
        return text
    usable = max(512, n - len(K.RETRY_TRIM_MARKER))
    head = max(256, usable * 11 // 20)
    tail = max(256, usable - head)
    cut = F.left(_head_tail(text, F.lit(head), F.lit(tail), K.RETRY_TRIM_MARKER), F.lit(n))
    return F.when(F.length(text) <= n, text).otherwise(trimmed(cut))


def _drop_literals(c: Column, literals: list[str]) -> Column:
    for literal in literals:
        c = F.replace(c, F.lit(literal), F.lit(""))
    return c


def hidden_tag_literals() -> list[str]:
    return [tag for pair in reversed(K.HIDDEN_TAGS) for tag in pair]


def dedup_key(c: Column) -> Column:
    c = _drop_literals(unix_newlines(c), [K.END_TAG, *hidden_tag_literals()])
    return F.left(F.lower(simplified(c)), F.lit(240))


def sanitize_section(c: Column) -> Column:
    c = F.replace(unix_newlines(c), F.lit(K.END_TAG), F.lit(""))
    c = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    c = _drop_literals(c, hidden_tag_literals())
    return trimmed(collapse_blank_lines(c))


def marker_summary(c: Column) -> Column:
    counts = [F.concat(F.lit(f"{name}="), count_of(c, marker).cast("string"))
              for name, marker in K.PACKET_MARKERS.items()]
    full = F.concat_ws(
        " | ",
        F.concat(F.lit("chars="), F.length(c).cast("string")),
        F.concat(F.lit("sha1="), F.left(F.sha1(F.encode(c, "UTF-8")), F.lit(12))),
        *counts,
    )
    return F.when(is_blank(c), F.lit("chars=0 | sha1=<empty>")).otherwise(full)


def normalize_loop_line(c: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(K.LOOP_LINE_CHARS))


def looks_code_like(c: Column) -> Column:
    lower = F.lower(c)
    signals = F.lit(0)
    for signal in K.CODE_SIGNALS:
        signals = signals + lower.contains(signal).cast("int")
    punct = F.length(c) - F.length(F.translate(c, "{};()#", ""))
    indented = F.regexp_count(c, F.lit(r"(?:\A|\n)(?:    |\t)"))
    return ~is_blank(c) & ((signals >= 2) | (punct >= 6) | ((signals >= 1) & (indented >= 1)))


def answer_hygiene(c: Column) -> Column:
    """Line ends, NULs, breaks beside fences, odd fence closed, blank lines around fences."""
    c = F.replace(unix_newlines(c), F.lit("\x00"), F.lit(""))
    c = F.regexp_replace(c, r"(?i)```([A-Za-z0-9_+\-]*)<br\s*/?>", "```$1\n")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>```", "\n```")
    fences = F.regexp_count(c, F.lit(rf"(?:\A|\n)[{K.WS_CLASS}&&[^\n]]*```"))
    closing = F.when(F.endswith(c, F.lit("\n")), F.lit("```\n")).otherwise(F.lit("\n```\n"))
    c = F.when(fences % 2 == 1, F.concat(c, closing)).otherwise(c)
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, "([^\n])\n(```[A-Za-z0-9_+#\\-]*\n)", "$1\n\n$2")
    c = F.regexp_replace(c, "(\n```\n)([^\n])", "$1\n$2")
    return trimmed(c)


def clip_for_embedding(c: Column) -> Column:
    """Cut to the safe character and token budget at the best boundary.

    The cut repeats until the text fits, so this is the one text function that
    needs a Python worker; texts that already fit are never sent to it.
    """
    text = sanitize_for_embedding(c)
    fits = (F.length(text) <= K.EMBED_SAFE_CHARS) & (estimate_tokens(text) <= K.EMBED_SAFE_TOKENS)
    return F.coalesce(_clip_loop(F.when(~fits, text)), text)


def _clip_loop(c: Column) -> Column:
    from quillspan.operators.packing import clip_to_budget

    @F.pandas_udf("string")
    def clip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else clip_to_budget(t))

    return clip(c)
