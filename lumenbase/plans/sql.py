"""Expressions that the SQL texts share."""

from __future__ import annotations

from lumenbase.functions.text import STOPWORDS
from lumenbase.plans.registry import sql_literal

EDGE, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def one_space(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def quotes(x: str) -> str:
    return f"translate({x}, '’`', '''''')"


def question(x: str) -> str:
    return one_space(quotes(strip(f"lower(nfc_normalize({x}))")))


def search(x: str) -> str:
    inner = rf"regexp_replace({quotes(strip(f'lower(nfc_normalize({x}))'))}, '[^\p{{L}}\p{{M}}\p{{N}}_\sÀ-ỹđĐ]', ' ', 'g')"
    return one_space(inner)


def terms(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda t: length(t) > 1 AND NOT list_contains({sql_literal(STOPWORDS)}, t))"


def clean(x: str) -> str:
    inner = strip(r"regexp_replace(x, '[ \t]+', ' ', 'g')")
    return rf"array_to_string(list_filter(list_transform(string_split(regexp_replace(nfc_normalize({x}), '\r\n?', chr(10), 'g'), chr(10)), lambda x: {inner}), lambda x: x <> ''), chr(10))"


def subject(x: str) -> str:
    parts = rf"list_filter(list_transform(string_split_regex({x}, '\s*;\s*'), lambda p: {strip('p')}), lambda p: p <> '')"
    noted = strip(rf"regexp_replace({one_space('p')}, '\s*\[([^\]]*)\]\s*$', ' [\1]')")
    return f"array_to_string(list_transform({parts}, lambda p: CASE WHEN p = '[TRỐNG]' THEN p ELSE {noted} END), ' / ')"


def packed(lines: str, most: int) -> str:
    """Parts of a list of lines: the fold's state is one text whose parts are set apart by chr(1)."""
    last = "list_extract(string_split(a, chr(1)), -1)"
    return f"string_split(list_reduce({lines}, lambda a, x: CASE WHEN length({last}) + 1 + length(x) <= {most} THEN a || chr(10) || x ELSE a || chr(1) || x END), chr(1))"


def joined(x: str) -> str:
    return f"array_to_string({x}, ',')"


def header(field: str) -> str:
    """What follows 'field:' on its line of a document."""
    return rf"trim(regexp_extract(document, '(?im)^\s*{field}\s*:\s*([^\n]+)', 1))"


#: Class and grade, and single days in the order of the week, of a normalised question q.
CLASS = r"regexp_extract(q, '\b((?:6|7|8|9|10|11|12)a\d+)\b', 1)"
CLASS_GRADE = rf"upper(nullif({CLASS}, '')) AS class_name, coalesce(nullif(regexp_extract({CLASS}, '^(6|7|8|9|10|11|12)a', 1), ''), nullif(regexp_extract(q, 'khối\s*(6|7|8|9|10|11|12)\b', 1), '')) AS grade"
DAYS = "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(q, '\bthứ\s*({n}){END}') THEN '{c}' END" for c, n in (("2", "hai|2"), ("3", "ba|3"), ("4", "tư|4"), ("5", "năm|5"), ("6", "sáu|6"), ("7", "bảy|7"))) + "], lambda d: d IS NOT NULL)"
