"""All registered queries of the question-answering engine."""

from lumenbase.plans import build_queries, search_queries, source_queries, text_queries, timetable_queries  # noqa: F401  registered as they are imported
from lumenbase.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
