"""Rank fusion and two-stage, document-first selection of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.operators.lexical import LexicalIndex, bm25
from lumenbase.operators.search import KEY, PLACES, by_batches, cosine
from lumenbase.sources.shared import kept

#: The constants of the rank fusion.
RRF_K, STRUCTURED_K, STRUCTURED_WEIGHT = 60, 20, 2.0
SEMANTIC_WEIGHT, LEXICAL_WEIGHT, AGREEMENT = 1.0, 1.5, 0.25
FINAL_TOP, DOCUMENT_TOP, PER_DOCUMENT, RANKS_A_DOCUMENT, SECONDARY_RANK = 12, 5, 4, 5, 5
LAST = 10**9


def reciprocal(rank: Column, weight: float = 1.0, k: int = RRF_K) -> Column:
    return F.lit(weight) / (F.lit(k) + rank)


def rrf(semantic: DataFrame, lexical: DataFrame, structured: DataFrame | None = None, top: int = FINAL_TOP) -> DataFrame:
    """question_id, KEY, rrf_score, semantic_rank, lexical_rank, structured_rank, rank: the lists merged on the chunk. Ties:
    what the first list holds first, then the next."""
    lists = [(semantic, "semantic_rank", 1.0, RRF_K), (lexical, "lexical_rank", 1.0, RRF_K)]
    lists += [(structured, "structured_rank", STRUCTURED_WEIGHT, STRUCTURED_K)] if structured is not None else []
    parts = None
    for place, (hits, name, weight, k) in enumerate(lists):
        ranks = [F.when(F.lit(n == name), F.col("rank")).alias(n) for n in ("semantic_rank", "lexical_rank", "structured_rank")]
        part = hits.select("question_id", *KEY, reciprocal(F.col("rank"), weight, k).alias("part"), F.struct(F.lit(place), F.col("rank")).alias("seen"), *ranks)
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("question_id", *KEY).agg(F.round(F.sum("part"), PLACES).alias("rrf_score"), F.min("seen").alias("seen"), *[F.max(n).alias(n) for n in ("semantic_rank", "lexical_rank", "structured_rank")])
    order = Window.partitionBy("question_id").orderBy(F.desc("rrf_score"), "seen")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("seen")


def document_rank(semantic: DataFrame, lexical: DataFrame, top: int = DOCUMENT_TOP) -> DataFrame:
    """question_id, file_id, document_score, best_semantic, best_lexical, document_rank: of each list a document's five best
    ranks count, and a document that both lists hold gets a bonus."""
    both = semantic.select("question_id", "file_id", "rank", F.lit("s").alias("list")).unionByName(lexical.select("question_id", "file_id", "rank", F.lit("l").alias("list")))
    order = Window.partitionBy("question_id", "file_id", "list").orderBy("rank")
    kept = both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= RANKS_A_DOCUMENT)
    in_list = {x: F.col("list") == x for x in "sl"}
    score = F.sum(F.when(in_list["s"], reciprocal(F.col("rank"), SEMANTIC_WEIGHT)).otherwise(reciprocal(F.col("rank"), LEXICAL_WEIGHT)))
    agreed = F.when(F.max(in_list["s"]) & F.max(in_list["l"]), AGREEMENT / (RRF_K + 1)).otherwise(0.0)
    docs = kept.groupBy("question_id", "file_id").agg(
        F.round(score + agreed, PLACES).alias("document_score"),
        F.min(F.when(in_list["s"], F.col("rank"))).alias("best_semantic"),
        F.min(F.when(in_list["l"], F.col("rank"))).alias("best_lexical"),
    )
    order = Window.partitionBy("question_id").orderBy(F.desc("document_score"), F.coalesce("best_semantic", F.lit(LAST)), F.coalesce("best_lexical", F.lit(LAST)), "file_id")
    return docs.withColumn("document_rank", F.row_number().over(order)).where(F.col("document_rank") <= top)


def document_first_evidence(vectors: DataFrame, index: LexicalIndex, questions: DataFrame, semantic: DataFrame, lexical: DataFrame, top: int = FINAL_TOP, texts: DataFrame | None = None) -> DataFrame:
    """The evidence rows of each question. vectors: KEY, document, embedding of the prose chunks; texts: KEY, document, where the
    texts lie apart from the vectors, so that only the texts of the evidence are moved and not all to their vectors; index: their lexical
    index; questions: question_id, question, vector; semantic, lexical: the corpus-wide hit lists. The keys of the chosen
    documents' chunks are written once, for three steps read them, and so are the evidence's, before their texts are joined."""
    docs = document_rank(semantic, lexical)
    chosen = by_batches(questions, lambda asked: vectors.join(F.broadcast(docs.join(asked.select("question_id", "vector"), "question_id").select("question_id", "file_id", "document_rank", "vector")), "file_id"))
    score = F.coalesce(F.round(cosine(F.col("embedding"), F.col("vector")), PLACES), F.lit(0.0))
    keys = kept(chosen.select("question_id", *KEY, "document_rank", score.alias("semantic_score_local")), "chosen")
    local = keys.join(bm25(index, questions, keys), ["question_id", *KEY], "left").withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0)))
    in_doc = Window.partitionBy("question_id", "file_id")
    local = local.withColumn("semantic_rank_local", F.row_number().over(in_doc.orderBy(F.desc("semantic_score_local"), "chunk_index")))
    matched = F.col("bm25_score") > 0
    local = local.withColumn("lexical_rank_local", F.when(matched, F.row_number().over(in_doc.orderBy(F.desc("bm25_score"), "chunk_index"))))
    local_rrf = reciprocal(F.col("semantic_rank_local"), SEMANTIC_WEIGHT) + F.when(matched, reciprocal(F.col("lexical_rank_local"), LEXICAL_WEIGHT) + AGREEMENT / (RRF_K + 1)).otherwise(0.0)
    local = local.withColumn("rrf_score", F.round(local_rrf, PLACES))
    place = F.row_number().over(in_doc.orderBy(F.desc("rrf_score"), "semantic_rank_local", F.coalesce("lexical_rank_local", F.lit(LAST))))
    best = local.withColumn("n", place).where(F.col("n") <= PER_DOCUMENT).drop("n")
    for name, hits in (("semantic_rank_global", semantic), ("lexical_rank_global", lexical)):
        best = best.join(hits.select("question_id", *KEY, F.col("rank").alias(name)), ["question_id", *KEY], "left")
    s, lx = F.col("semantic_rank_global"), F.col("lexical_rank_global")
    whole = F.coalesce(reciprocal(s, SEMANTIC_WEIGHT), F.lit(0.0)) + F.coalesce(reciprocal(lx, LEXICAL_WEIGHT), F.lit(0.0)) + F.when(s.isNotNull() & lx.isNotNull(), AGREEMENT / (RRF_K + 1)).otherwise(0.0)
    best = best.withColumn("global_rrf_score", F.round(whole, PLACES))
    best = best.withColumn("final_score", F.round(2 * F.col("global_rrf_score") + F.col("rrf_score") + 0.02 / F.col("document_rank"), PLACES))
    rows = kept(gated(best, top), "evidence")  # a few rows a question; only now their texts
    return (vectors if texts is None else texts).select(*KEY, "document").join(rows, list(KEY)).select("question_id", *KEY, "document", *[c for c in rows.columns if c not in ("question_id", *KEY)])


def gated(kept: DataFrame, top: int) -> DataFrame:
    """All rows of the first document; of the others, in their order, those with a strong corpus-wide hit, until `top` rows
    are there; then the best `top` of them."""
    best = F.least(F.coalesce("semantic_rank_global", F.lit(LAST)), F.coalesce("lexical_rank_global", F.lit(LAST)))
    per_doc = kept.groupBy("question_id", "file_id", "document_rank").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    admitted = per_doc.where((F.col("document_rank") == 1) | (F.col("best") <= SECONDARY_RANK))
    so_far = Window.partitionBy("question_id").orderBy("document_rank").rowsBetween(Window.unboundedPreceding, -1)
    admitted = admitted.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).where(F.col("before") < top).select("question_id", "file_id")
    rows = kept.join(admitted, ["question_id", "file_id"], "left_semi")
    order = Window.partitionBy("question_id").orderBy(F.desc("final_score"), "document_rank", "semantic_rank_local")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def evidence_by_file(evidence: DataFrame) -> DataFrame:
    """question_id, file_id, chunks, score: the score is that of the file's first row."""
    return evidence.groupBy("question_id", "file_id").agg(F.count(F.lit(1)).alias("chunks"), F.min_by("final_score", "rank").alias("score"))
