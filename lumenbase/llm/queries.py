"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table,
and derives the digest columns that the query returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbase.llm.common import release as release_tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> int:
    """Delete the tables that results of these queries read; how many."""
    return release_tables(spark)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.html import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.topk import exact_top

    return exact_top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.warc import archive

    return archive(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.tokenfile import token_files

    return token_files(table(spark, sf_dir, "documents"))


def op4_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.substrings import removal_digests

    return removal_digests(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.langid import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, share=80)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.conversations import repair

    return repair(table(spark, sf_dir, "conversations"))


def op13_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenbase.llm.secrets import document_secrets

    return document_secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_exact_topk": op2_exact_topk,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ivf_pq": op4_ivf_pq,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_minhash_forest": op9_minhash_forest,
    "op10_token_files": op10_token_files,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_secret_ledger": op13_secret_ledger,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
    """,
    "op5_substring_dedup": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL
        ), p AS (
            SELECT doc_id, unnest(range(1, len(ws) - 18)) AS start, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i : i + 19], ' '))) AS win FROM w WHERE len(ws) >= 20
        ), l AS (
            SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) > 1 AS later FROM p
        ), x AS (
            SELECT DISTINCT doc_id, start + j AS i FROM l, range(0, 20) AS r(j) WHERE later
        ), k AS (
            SELECT w.doc_id, i, ws[i] AS word, x.i IS NULL AS stays
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) AS w LEFT JOIN x USING (doc_id, i)
        ), s AS (
            SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (stays) AS kept FROM k GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN s USING (doc_id)
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages WHERE page_id IS NOT NULL),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
        FROM f
    """,
    "op9_minhash_forest": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
            FROM documents WHERE doc_id IS NOT NULL
        ), g AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS gs FROM w
        ), n AS (
            SELECT doc_id, CAST(len(gs) AS BIGINT) AS n_shingles FROM g
        ), e AS (
            SELECT doc_id, unnest(gs) AS s FROM g
        ), c AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e AS a JOIN e AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), l AS (
            SELECT x, y FROM c JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y
            WHERE 100 * common >= 80 * (p.n_shingles + q.n_shingles - common)
        ), r(a, b) AS (
            SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x
        )
        SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept
        FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) AS m USING (doc_id)
    """,
    "op12_conversation_repair": """
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations WHERE conv_id IS NOT NULL
        ), hashed AS (
            SELECT *, xor(list_reduce(
                list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
                lambda crc, b: list_reduce(
                    list_prepend(xor(crc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])),
                    lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END)
            ), CAST(4294967295 AS UBIGINT)) % 20 AS kind FROM keyed
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM hashed
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
            FROM damaged
        ), judged AS (
            SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS initial,
                   CASE WHEN said = '' THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                        WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM placed
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) AS n
            FROM judged GROUP BY conv_id
        ), crossed AS (
            SELECT conv_id, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM (SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM judged) GROUP BY conv_id
        ), follows(last, due, inserts, cost, lines) AS (
            VALUES ('', '', '', 0, CAST([] AS VARCHAR[])), ('', 'u', 'I', 2, ['user:']), ('', 'a', 'II', 4, ['user:', 'assistant:']),
                   ('s', 's', '', 0, []), ('s', 'u', 'I', 2, ['user:']), ('s', 'a', 'II', 4, ['user:', 'assistant:']),
                   ('u', 'u', '', 0, []), ('u', 'a', 'I', 2, ['assistant:']), ('a', 'a', '', 0, []), ('a', 'u', 'I', 2, ['user:'])
        ), next(last, due, name) AS (
            VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')
        ), lattice AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS pos, '' AS last, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM counted
            UNION ALL
            SELECT conv_id, pos, last, min(w).cost AS cost, min(w).audit AS audit, min(w).lines AS lines FROM (
                SELECT j.conv_id, j.pos, e.last, {'cost': l.cost + f.cost + e.cost, 'audit': l.audit || f.inserts || e.letter, 'lines': l.lines || f.lines || e.line} AS w
                FROM lattice AS l JOIN judged AS j ON j.conv_id = l.conv_id AND j.pos = l.pos + 1 JOIN follows AS f ON f.last = l.last JOIN next AS x ON x.last = f.due,
                LATERAL (
                    SELECT f.due AS last, 3 AS cost, 'D' AS letter, CAST([] AS VARCHAR[]) AS line
                    UNION ALL
                    SELECT x.due, CASE WHEN j.fault = 'truncated' THEN 3 ELSE 2 END, 'R', [x.name || ':' || j.text] WHERE j.fault NOT IN ('blank', 'duplicate')
                    UNION ALL
                    SELECT j.initial, CASE WHEN j.fault = 'truncated' THEN 1 ELSE 0 END, 'K', [j.role || ':' || j.text]
                    WHERE j.fault NOT IN ('blank', 'duplicate') AND (j.initial = x.due OR j.initial = 's' AND f.due = '')
                ) AS e
            ) GROUP BY conv_id, pos, last
        ), ended AS (
            SELECT l.conv_id, min({'cost': l.cost + f.cost, 'audit': l.audit || f.inserts, 'lines': l.lines || f.lines}) AS w
            FROM lattice AS l JOIN counted AS c ON c.conv_id = l.conv_id AND c.n = l.pos JOIN follows AS f ON f.last = l.last
            WHERE f.due IN ('', 'a') GROUP BY l.conv_id
        )
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0) AS cost, coalesce(w.audit, '') AS audit,
               sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM keyed) LEFT JOIN counted USING (conv_id) LEFT JOIN crossed USING (conv_id) LEFT JOIN ended USING (conv_id)
    """,
    "op13_secret_ledger": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL
        ), rules(k, kind, pattern, value, least) AS (
            VALUES (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+',
                    '^[a-zA-Z_]+["'']?\\x20*[:=]\\x20*["'']?', 6),
                   (1, 'access', 'AKIA[A-Z0-9]+', '^', 20),
                   (2, 'hex', '[0-9a-f]+', '^', 24)
        ), found AS (
            SELECT doc_id, k, kind, value, least, regexp_extract_all(text, pattern) AS hits, list_transform(string_split_regex(text, pattern), lambda g: length(g)) AS gaps FROM d, rules
        ), each AS (
            SELECT doc_id, k, kind, value, least, unnest(hits) AS hit, unnest(gaps[: len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM found
        ), placed AS (
            SELECT *, sum(gap + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM each
        ), kept AS (
            SELECT doc_id, k, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE length(regexp_replace(hit, value, '')) >= least
        ), s AS (
            SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
            FROM kept GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN s USING (doc_id)
    """,
}
