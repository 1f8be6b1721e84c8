"""Questions in natural language to predicates, in three dialects.

`engine` keeps punctuation, knows ranges of days and periods, and fills a missing part from context; `chunk_v1` and
`chunk_v4` work on text without punctuation, as the two chunk searches do. All are Column expressions over one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbase.functions.text import DAY_NAMES, looked_up, normalize_question, normalize_search, sessions_of

#: What the single form of a day may be called, by code.
SINGLE_DAYS = {"2": "hai|2", "3": "ba|3", "4": "tư|4", "5": "năm|5", "6": "sáu|6", "7": "bảy|7"}
ANY_DAY = "|".join([*DAY_NAMES, "[2-7]"])
#: The patterns that define what a question may say.
DAY_RANGE = rf"(?U)\bthứ\s*({ANY_DAY})\s*(?:đến|tới|->|-)\s*(?:thứ\s*)?({ANY_DAY})\b"
CLASS = r"(?iU)\b((?:6|7|8|9|10|11|12)A\d+)\b"
GRADE = r"(?iU)\bkhối\s*(6|7|8|9|10|11|12)\b"
TIMETABLE_WORD = r"(?U)\b(?:tkb|thời khóa biểu|thời khoá biểu)\b"
LESSON_WORD = r"(?U)\b(?:học|môn|tiết)\b"
FOLLOW_WORD = r"(?U)\b(?:vậy|thế|còn|nữa|tiếp|thì sao)\b"
CONTEXT_WORD = r"(?U)\b(?:tiết|buổi|thứ|sáng|chiều|còn|nữa|vậy|thế)\b"



def strings(*items: Column) -> Column:
    """The items that are not null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def found(pattern: str, q: Column, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(q, pattern, group), F.lit(""))


def single_days(q: Column) -> Column:
    """Days named one by one, in the order of the week."""
    return strings(*[F.when(q.rlike(rf"(?U)\bthứ\s*(?:{names})\b"), F.lit(code)) for code, names in SINGLE_DAYS.items()])


def day_ends(q: Column) -> dict[str, Column]:
    """The codes of the two days that a range names, as numbers; null without a range."""

    def code(group: int) -> Column:
        token = F.when(q.contains("thứ"), F.regexp_extract(q, DAY_RANGE, group))
        return F.coalesce(looked_up(DAY_NAMES, token), F.nullif(token, F.lit(""))).cast("int")

    return {"first": code(1), "last": code(2)}


def days_between(q: Column, ends: dict[str, Column]) -> Column:
    first, last = ends["first"], ends["last"]
    spread = F.transform(F.sequence(F.least(first, last), last), lambda d: d.cast("string"))
    return F.when((first <= last).eqNullSafe(True), spread).otherwise(single_days(q))


def days_in(q: Column) -> Column:
    """A range that does not run backwards gives all its days; otherwise the single days."""
    return days_between(q, day_ends(q))


def engine_periods(q: Column) -> Column:
    """'tiết a' or a range from a to b (b at most 20), 1 to 20, each once."""
    pattern = F.lit(r"(?U)\btiết\s*(\d+)(?:\s*(?:-|–|—|đến|tới)\s*(\d+))?")
    both = F.zip_with(F.regexp_extract_all(q, pattern, F.lit(1)), F.regexp_extract_all(q, pattern, F.lit(2)), lambda a, b: F.struct(a.try_cast("int").alias("a"), b.try_cast("int").alias("b")))
    runs = F.transform(both, lambda p: F.when((p.b >= p.a) & (p.b <= 20), F.sequence(p.a, F.greatest(p.a, F.least(p.b, F.lit(20))))).otherwise(F.array(p.a)))
    return F.array_distinct(F.filter(F.flatten(runs), lambda n: n.between(1, 20)))


def count_said(q: Column, words: str) -> Column:
    """N of 'có N tiết' and the like; null without it."""
    return F.when(q.contains("tiết"), F.regexp_extract(q, rf"(?U)\b(?:{words})\s*(?:toàn bộ\s*)?(\d+)\s*tiết\b", 1).try_cast("int"))


def counted(n: Column, most: int) -> Column:
    """1 to N, N at most `most`; else empty."""
    return F.when(n.between(1, most), F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(most))))).otherwise(F.array().cast("array<int>"))


def if_empty(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(second)


def has(c: Column) -> Column:
    return F.size(c) > 0


def follow_up(q: Column, said: dict[str, Column]) -> Column:
    """Whether a normalised question goes on from the one before: it says something about a lesson without naming the
    timetable, and either has a word for going on or gives periods alone."""
    about = [said["class_name"], said["grade"], said["periods"], said["sessions"], said["days"] & q.rlike(LESSON_WORD)]
    alone = [said["periods"], *[~said[f] for f in ("class_name", "grade", "days", "sessions")]]
    any_of = F.exists(F.array(*about), lambda c: c)
    return any_of & ~q.rlike(TIMETABLE_WORD) & (q.rlike(FOLLOW_WORD) | F.forall(F.array(*alone), lambda c: c))


def wants_table(q: Column, named_class: Column, days: Column, sessions: Column, periods: Column) -> Column:
    """Whether the answer is a table: the timetable is named, a list has several values, or a class stands alone or with a
    whole half day."""
    several = F.exists(F.array(*[F.size(c) for c in (days, sessions, periods)]), lambda n: n > 1)
    half_days = named_class.isNotNull() & ~has(periods) & (has(days) == has(sessions))
    return q.rlike(TIMETABLE_WORD) | several | half_days


def parse_engine(text: Column, context: Column | None = None) -> Column:
    """struct<class_name, grade, days, sessions, periods, mode, explicit_fields>. `context`: a struct of class_name, grade,
    days and sessions that a follow-up question inherits, field by field; periods are never inherited."""
    return engine_of(normalize_question(text), context)


def engine_parts(q: Column) -> dict[str, Column]:
    """What engine_of() reads more than once, first step."""
    return {"class": F.upper(found(CLASS, q)), "named": engine_periods(q), "count": count_said(q, "cả|gồm|có|đủ|trong"), "sessions": sessions_of(q), **day_ends(q)}


def engine_lists(q: Column, p: dict[str, Column]) -> dict[str, Column]:
    """The second step."""
    grade = F.when(p["class"].isNull(), found(GRADE, q))
    return {"class": p["class"], "sessions": p["sessions"], "grade": grade, "days": days_between(q, p), "periods": if_empty(p["named"], counted(p["count"], 20))}


def engine_of(q: Column, context: Column | None = None, lists: dict[str, Column] | None = None) -> Column:
    """parse_engine() of a text that is normalised already; `lists`: its engine_lists(), where they are columns of their own."""
    lists = engine_lists(q, engine_parts(q)) if lists is None else lists
    named_class, grade, days, sessions, periods = (lists[k] for k in ("class", "grade", "days", "sessions", "periods"))
    said = {"class_name": named_class.isNotNull(), "grade": grade.isNotNull(), "days": has(days), "sessions": has(sessions), "periods": has(periods)}
    explicit = strings(*[F.when(c, F.lit(n)) for n, c in said.items()])
    if context is not None:
        follows = context.isNotNull() & follow_up(q, said)
        none = F.array().cast("array<string>")
        named_class = F.coalesce(named_class, F.when(follows, context["class_name"]))
        grade = F.coalesce(grade, F.when(follows, context["grade"]))
        days = F.when(follows, if_empty(days, F.coalesce(context["days"], none))).otherwise(days)
        sessions = F.when(follows, if_empty(sessions, F.coalesce(context["sessions"], none))).otherwise(sessions)
    mode = F.when(wants_table(q, named_class, days, sessions, periods), F.lit("timetable")).otherwise(F.lit("lookup"))
    return F.struct(named_class.alias("class_name"), grade.alias("grade"), days.alias("days"), sessions.alias("sessions"), periods.alias("periods"), mode.alias("mode"), explicit.alias("explicit_fields"))


def is_timetable_question(text: Column, has_context: Column | None = None) -> Column:
    """Whether the timetable answers the question; with a context, also a mere follow-up word."""
    return routed_of(normalize_question(text), has_context)


def routed_of(q: Column, has_context: Column | None = None) -> Column:
    """is_timetable_question() of a text that is normalised already."""
    direct = q.rlike(TIMETABLE_WORD) | q.rlike(CLASS) | q.rlike(GRADE) | q.rlike(r"(?U)\btiết\s*\d+\b") | q.rlike(r"(?U)\bbuổi\s+(?:sáng|chiều)\b") | (has(days_in(q)) & q.rlike(LESSON_WORD))
    return direct if has_context is None else direct | (has_context & q.rlike(CONTEXT_WORD))


def chunk_grade(q: Column, named: Column) -> Column:
    """The grade of the class if there is one, else the grade named."""
    return F.coalesce(found("^(6|7|8|9|10|11|12)A", named), found(GRADE, q))


def listed(q: Column, pattern: str) -> Column:
    """The number lists after each 'tiết', as texts."""
    return F.regexp_extract_all(q, F.lit(rf"(?U)\btiết\s*(\d+(?:\s*(?:{pattern})\s*\d+)*)"), F.lit(1))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))


def parse_chunk_v1(text: Column) -> Column:
    """struct<class_name, grade, day, session, periods>: one day, one session, periods as a list of texts."""
    return chunk_v1_of(normalize_search(text))


def chunk_v1_parts(q: Column) -> dict[str, Column]:
    return {"class": F.upper(found(CLASS, q))}


def chunk_v1_lists(q: Column, p: dict[str, Column]) -> dict[str, Column]:
    return p


def chunk_v1_of(q: Column, lists: dict[str, Column] | None = None) -> Column:
    """parse_chunk_v1() of a text that is normalised already."""
    named = (chunk_v1_parts(q) if lists is None else lists)["class"]
    session = F.when(q.rlike(r"(?U)\bsáng\b"), F.lit("S")).when(q.rlike(r"(?U)\bchiều\b"), F.lit("C"))
    periods = F.array_distinct(F.flatten(F.transform(listed(q, ",|và|&|- "), numbers)))
    return F.struct(named.alias("class_name"), chunk_grade(q, named).alias("grade"), F.get(single_days(q), F.lit(0)).alias("day"), session.alias("session"), periods.alias("periods"))


def parse_chunk_v4(text: Column) -> Column:
    """struct<class_name, grade, days, day, session, periods, period_count>."""
    return chunk_v4_of(normalize_search(text))


def chunk_v4_parts(q: Column) -> dict[str, Column]:
    """What chunk_v4_of() reads more than once, first step."""

    def opened(group: Column) -> Column:
        """A pair joined by 'đến' or a dash is a range; a backward one holds nothing."""
        n = F.transform(numbers(group), lambda x: x.try_cast("int"))
        first, last = n[0], F.get(n, F.lit(1))
        pair = (F.size(n) == 2) & group.rlike("-|đến")
        return F.when(pair & (first > last), F.array().cast("array<int>")).when(pair, F.sequence(F.least(first, last), F.greatest(first, last))).otherwise(n)

    named = F.array_distinct(F.transform(F.flatten(F.transform(listed(q, ",|và|&|-|đến"), opened)), lambda n: n.cast("string")))
    return {"class": F.upper(found(CLASS, q)), "named": named, "count": count_said(q, "gồm|có|đủ|trong"), **day_ends(q)}


def chunk_v4_lists(q: Column, p: dict[str, Column]) -> dict[str, Column]:
    """The second step."""
    return {"class": p["class"], "named": p["named"], "days": days_between(q, p), "count": counted(p["count"], 10)}


def chunk_v4_of(q: Column, lists: dict[str, Column] | None = None) -> Column:
    """parse_chunk_v4() of a text that is normalised already."""
    lists = chunk_v4_lists(q, chunk_v4_parts(q)) if lists is None else lists
    named, named_periods, days, count = (lists[k] for k in ("class", "named", "days", "count"))
    session = F.when(q.rlike(r"(?U)\bsáng\b|\bb[uù]ổi\s+s[aá]ng\b"), F.lit("S")).when(q.rlike(r"(?U)\bchi[eề]u\b"), F.lit("C"))
    by_count = ~has(named_periods) & has(count)
    periods = if_empty(named_periods, F.transform(count, lambda n: n.cast("string")))
    day = F.when(F.size(days) == 1, days[0])
    return F.struct(named.alias("class_name"), chunk_grade(q, named).alias("grade"), days.alias("days"), day.alias("day"), session.alias("session"), periods.alias("periods"), F.when(by_count, F.size(count)).alias("period_count"))


def parse_question(text: Column, dialect: str = "engine", context: Column | None = None) -> Column:
    if dialect == "engine":
        return parse_engine(text, context)
    return {"chunk_v1": parse_chunk_v1, "chunk_v4": parse_chunk_v4}[dialect](text)


def with_parsed(df: DataFrame, dialect: str = "engine", text: str = "question", context: Column | None = None, name: str = "q") -> DataFrame:
    """df with the parsed text. The normalised text, and what the parser reads more than once, are columns of their own for the
    time, so that each pattern is sought once a row: within one expression, branches would seek it again and again."""
    parts, lists, parse = {"engine": (engine_parts, engine_lists, engine_of), "chunk_v1": (chunk_v1_parts, chunk_v1_lists, chunk_v1_of), "chunk_v4": (chunk_v4_parts, chunk_v4_lists, chunk_v4_of)}[dialect]
    q = F.col("normalised")
    out = df.withColumn("normalised", (normalize_question if dialect == "engine" else normalize_search)(F.col(text)))
    steps = {}
    for k, step in enumerate((parts, lists)):
        made = step(q, steps) if k else step(q)
        steps = {part: F.col(f"said_{k}_{part}") for part in made}
        out = out.select(*df.columns, "normalised", *[c.alias(f"said_{k}_{part}") for part, c in made.items()])
    parsed = parse(q, context, steps) if dialect == "engine" else parse(q, steps)
    return out.withColumn(name, parsed).select(*[c for c in df.columns if c != name], name)
