"""Text functions as Column expressions. Patterns start with (?U) wherever Unicode classes are meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries and chunks drop. Bigrams can't match a token, so none is listed.
STOPWORDS = (
    "la là cua của truong trường hoc học sinh bao nhung những nao nào gi gì ai the thế duoc được cho trong tai tại "
    "ve về co có khong không một mot cac các moi mỗi nay này khi nhiêu dien diễn ra theo doi đời thuoc thuộc nam năm"
).split()

#: Days by code.
DAY_DISPLAY = {"2": "Thứ Hai", "3": "Thứ Ba", "4": "Thứ Tư", "5": "Thứ Năm", "6": "Thứ Sáu", "7": "Thứ Bảy"}
#: Names of days, with and without accents, to codes.
DAY_NAMES = {
    "hai": "2", "ba": "3", "tư": "4", "tu": "4", "bốn": "4", "bon": "4", "năm": "5", "nam": "5",
    "sáu": "6", "sau": "6", "bảy": "7", "bay": "7",
}
SESSION_DISPLAY = {"S": "Sáng", "C": "Chiều"}
EMPTY_SLOT = "[TRỐNG]"
CLASS_NAME = "(?:6|7|8|9|10|11|12)A[0-9]+"
#: What (?U)\s matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def as_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def looked_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(as_map(values), key)


def strip(c: Column) -> Column:
    """White space of any kind off both ends. Trimmed, for a pattern would look at every character between the ends."""
    return F.btrim(c, F.lit(WHITE))


def one_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def nfc(c: Column) -> Column:
    """Unicode composition, by the ICU library that Spark's collations use. What stands below U+0300 is composed already, so
    only texts with something above are looked at. Spark takes the call for one whose result may change: an aggregate must
    read it from a column of its own."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike("[^\\x00-\\u02ff]"), composed).otherwise(c)


def clean_text(c: Column, white: str = WHITE) -> Column:
    """Composed; lines with runs of blanks as one, stripped of `white`, without empty ones; null gives the empty text."""
    lines = F.split(F.regexp_replace(F.coalesce(nfc(c), F.lit("")), "\r\n?", "\n"), "\n")
    lines = F.transform(lines, lambda x: F.btrim(F.regexp_replace(x, "[ \t]+", " "), F.lit(white)))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def cell_line(c: Column) -> Column:
    """A cleaned cell on one line."""
    return F.replace(clean_text(c), F.lit("\n"), F.lit(" "))


def clean_cell(c: Column) -> Column:
    """A cell value on one line; null gives the empty text."""
    return strip(one_space(F.coalesce(c, F.lit(""))))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "’`", "''")


def normalize_question(c: Column) -> Column:
    """Composed, lower case, straight quotes, single spaces; punctuation stays."""
    return one_space(straight_quotes(strip(F.lower(nfc(F.coalesce(c, F.lit("")))))))


def normalize_search(c: Column) -> Column:
    """As normalize_question, but with a space for each run of what is no letter, digit or underscore, quotes too; one space may
    be left at either end. ASCII texts take the quicker classes."""
    wide = F.regexp_replace(strip(F.lower(nfc(c))), r"(?U)[[^\wÀ-ỹđĐ]\u1680]+", " ")
    return F.when(c.rlike("[^\\x00-\\x7f]"), wide).otherwise(F.regexp_replace(strip(F.lower(c)), r"\W+", " "))


def tokens(c: Column) -> Column:
    """Words of the normalised text, longer than one character and no stop words."""
    return tokens_of(normalize_search(c))


def tokens_of(norm: Column) -> Column:
    """tokens() of a text that is normalised already."""
    return F.filter(F.split(norm, " "), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def format_subject(c: Column) -> Column:
    """Entries between semicolons, each on one space, a trailing note in brackets set off by one space, joined by ' / '."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\s*;\s*"), strip), lambda p: p != "")
    noted = F.transform(parts, lambda p: F.when(p == EMPTY_SLOT, p).otherwise(strip(F.regexp_replace(one_space(p), r"(?U)\s*\[([^\]]*)\]\s*$", " [$1]"))))
    return F.array_join(noted, " / ")


def split_assignments(c: Column) -> Column:
    """array<struct<subject, teacher>>: entries between semicolons, without a trailing note, split at ' - '."""
    parts = F.transform(F.split(clean_cell(c), r"(?U)\s*;\s*"), strip)
    parts = F.transform(F.filter(parts, lambda p: p != ""), lambda p: strip(F.regexp_replace(p, r"(?U)\s*\[[^\]]*\]\s*$", "")))
    pattern = r"(?U)^(.+?)\s+-\s+(.+?)\s*$"

    def pair(p: Column) -> Column:
        split = p.rlike(pattern)
        subject = F.when(split, strip(F.regexp_extract(p, pattern, 1))).otherwise(p)
        teacher = F.when(split, strip(F.regexp_extract(p, pattern, 2))).otherwise(F.lit(""))
        return F.struct(subject.alias("subject"), teacher.alias("teacher"))

    return F.transform(parts, pair)


def is_class_name(c: Column) -> Column:
    return c.rlike(f"(?i)^{CLASS_NAME}$")


def grade_of_class(c: Column) -> Column:
    return F.regexp_extract(c, "(?i)^(6|7|8|9|10|11|12)A", 1)


def day_code(c: Column) -> Column:
    """A single digit 2 to 7 or a day's name; else null."""
    token = strip(F.lower(c))
    return F.when(token.rlike("^[2-7]$"), token).otherwise(looked_up(DAY_NAMES, token))


def sheet_day(c: Column) -> Column:
    """Day of a sheet's cell: the first name of this order that stands anywhere in the 'thứ ...' match, else a lone digit
    2 to 7, else the text itself."""
    order = [(n, d) for n, d in DAY_NAMES.items() if n not in ("tu", "bốn")]  # those two aren't known here
    found = F.regexp_extract(F.lower(c), rf"(?U)(?:thứ|thu)\s*(?:{'|'.join(n for n, _ in order)}|[2-7])", 0)
    named = F.coalesce(*[F.when(found.contains(n), F.lit(d)) for n, d in order])
    digit = F.regexp_extract(c, r"(?U)\b([2-7])\b", 1)
    return F.coalesce(named, F.when(digit != "", digit), strip(c))


def sheet_session(c: Column) -> Column:
    """S, C or the text itself."""
    up = F.upper(strip(c))
    return (
        F.when((up == "S") | up.contains("SÁNG") | up.contains("SANG"), F.lit("S"))
        .when((up == "C") | up.contains("CHIỀU") | up.contains("CHIEU"), F.lit("C"))
        .otherwise(strip(c))
    )


def sessions_in(c: Column) -> Column:
    """Sessions that a question names, morning first; a bare s or c counts only if it is all there is."""
    return sessions_of(normalize_question(c))


def sessions_of(q: Column) -> Column:
    """sessions_in() of a text that is normalised already."""
    named = F.filter(F.array(F.when(q.rlike(r"(?U)\bs[aá]ng\b"), F.lit("S")), F.when(q.rlike(r"(?U)\bchi[eề]u\b"), F.lit("C"))), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, named).when(q.isin("s", "c"), F.array(F.upper(q))).otherwise(named)


def sheet_day_display(c: Column) -> Column:
    """'Thứ Hai (2)' and so on; other texts as they are."""
    return F.coalesce(looked_up({k: f"{v} ({k})" for k, v in DAY_DISPLAY.items()}, c), c)


def sheet_session_display(c: Column) -> Column:
    return F.coalesce(looked_up({"S": "Sáng (S)", "C": "Chiều (C)"}, F.upper(c)), c)


def number_key(c: Column) -> Column:
    """Sort key: the first whole number in the text (999 without one), then the text."""
    return F.struct(F.coalesce(F.regexp_extract(c, "[0-9]+", 0).try_cast("int"), F.lit(999)).alias("n"), c.alias("s"))


def period_key(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z.-]", "")


def header_value(document: Column, field: str) -> Column:
    """Text after 'field:' on its first line, trimmed; null without one."""
    pattern = rf"(?imU)^\s*{field}\s*:\s*([^\n]+)"
    return F.when(document.rlike(pattern), strip(F.regexp_extract(document, pattern, 1)))


def names_class(document: Column, class_name: Column) -> Column:
    """Whether a line begins with the class and a colon."""
    return F.regexp_like(document, F.concat(F.lit(r"(?imU)^\s*\Q"), class_name, F.lit(r"\E\s*:")))


def names_grade(document: Column, grade: Column) -> Column:
    return F.regexp_like(document, F.concat(F.lit(r"(?imU)^\s*\Q"), grade, F.lit(r"\Ea[0-9]+\s*:")))


def period_lines(document: Column) -> Column:
    """Numbers of all 'Tiết n:' lines, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(document, F.lit(r"(?imU)^\s*Tiết\s*([0-9]+)\s*:"), F.lit(1)))


def is_heading(c: Column) -> Column:
    """Begins with a roman numeral, a dot or bracket, and white space."""
    return c.rlike(r"(?iU)^[IVXLC]+[.)]\s+")


def file_id(relative_path: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.replace(relative_path, F.lit("\\"), F.lit("/"))).cast("binary")), 1, 16)


def catalogue_id(relative_path: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(F.replace(relative_path, F.lit("\\"), F.lit("/")), F.lit("/"))).cast("binary"), 256), 1, 16)


def numbered_id(file: Column, kind: str, index: Column) -> Column:
    """'<file>-b00001' for blocks, '-c00001' for chunks; longer numbers stay whole."""
    return F.concat(file, F.lit(f"-{kind}"), F.format_string("%05d", index.cast("int")))


def reply_text(c: Column) -> Column:
    """A model's reply without its thinking: what follows the first closing tag, else what precedes an opening one."""
    after, before = F.split(c, "</think>", 2), F.split(c, "<think>", 2)
    return strip(F.when(F.size(after) == 2, after[1]).otherwise(before[0]))


def reply_answer(c: Column) -> Column:
    """The answer of a JSON reply if it is a text that isn't blank, else the reply itself, both without thinking."""
    answer = F.variant_get(F.try_parse_json(c), "$.answer", "variant")
    text = F.when(F.schema_of_variant(answer) == "STRING", answer.try_cast("string"))
    return reply_text(F.when(strip(text) != "", text).otherwise(c))


def retrieval_text(source: Column, section: Column, text: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Tên tài liệu: "), source),
        F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Phần: "), section)),
        F.concat(F.lit("Nội dung:\n"), text),
    )


def location_label(section: Column, page: Column, table: Column, sheet: Column, row: Column) -> Column:
    """'section=..., page=...' of what is there."""
    named = {"section": section, "page": page, "table": table, "sheet": sheet, "row": row}
    parts = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}="), c.cast("string"))) for n, c in named.items()]
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", F.lit("Không rõ")).otherwise(joined)


def truncated(c: Column, most: int = 1250) -> Column:
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most), r"(?U)\s+$", ""), F.lit(" ..."))).otherwise(c)


def byte_size(c: Column) -> Column:
    """B, whole KB, or MB with one decimal; a half goes to the even digit."""
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024 * 1024, F.format_string("%.0f KB", F.bround(c.cast("double") / 1024, 0)))
        .otherwise(F.format_string("%.1f MB", F.bround(c.cast("double") / (1024 * 1024), 1)))
    )


def numeric_only(text: Column) -> Column:
    """Whether, without its header lines, a chunk has lines and all are 'name: number'."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike("^(Trang tính:|Tiêu đề:|Thứ:|Buổi:|Tiết:)"))
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"^[^:]+: ?[0-9]+(\.0)?$"))
