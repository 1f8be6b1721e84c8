"""BM25 over a stored index, with block-max pruning.

Chunks are dealt into ranges of about RANGE chunks of like length. A block is what a range holds of a term: its postings, and
the most that any of them can score at the average length of the whole index (a part of it, whose average is longer, can score
more by no more than the ratio of the two). A question's bound for a range is the sum over its terms (one more if a chunk of the range holds its phrase).

A search scores the few ranges with the largest bounds in full. The k-th best score found there is a threshold that the true
k-th best can't be below, so a range whose bound doesn't reach it is left alone, and only the blocks of the others are opened.
Blocks of one range hold all that a chunk of it can score, so scores are whole. Blocks lie by zone, a coarser measure of
length, and sorted by term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.functions.text import normalize_search, tokens, tokens_of
from lumenbase.operators.grams import GramIndex, dictionary_of, gram_rows, holding, part_of, read_grams, write_grams
from lumenbase.operators.search import KEY, PLACES, SLACK, by_batches, ranked
from lumenbase.operators.textscan import TextScan, holding_texts, matched_rows, term_counts
from lumenbase.sources.shared import kept

K1, B = 1.5, 0.75
RANGE, FIRST = 32, 8
PLACE = ("file_type", "tier", "slot")


@dataclass(frozen=True)
class LexicalIndex:
    """What BM25 reads. rows: KEY, PLACE, part, document, norm, n_terms; blocks: PLACE, term, most, n, entries;
    terms: file_type, term, df; stats: file_type, n_chunks, n_terms; grams: of the normalised texts; whole: stats of
    the index that this is a part of."""

    rows: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    grams: GramIndex
    whole: DataFrame

    def average(self) -> Column:
        return self.whole.agg(F.sum("n_terms") / F.sum("n_chunks")).scalar()

    def of(self, *file_types: str) -> LexicalIndex:
        """The part of some file types, with statistics of its own. Grams stay whole: what they find is looked up in rows."""
        return LexicalIndex(*(t.where(F.col("file_type").isin(*file_types)) for t in (self.rows, self.blocks, self.terms, self.stats)), self.grams, self.whole)

    @property
    def postings(self) -> DataFrame:
        """file_type, KEY, n_terms, term, tf."""
        return self.blocks.select("file_type", "term", F.explode("entries").alias("e")).select("file_type", *[f"e.{c}" for c in KEY], "e.n_terms", "term", "e.tf")


def indexed_rows(chunks: DataFrame, text: Column | None = None) -> DataFrame:
    """The chunks with norm, terms, n_terms and tier. text: what is searched, by default the document."""
    text = F.col("document") if text is None else text
    rows = chunks.withColumn("norm", normalize_search(text)).withColumn("terms", tokens_of(F.col("norm"))).withColumn("n_terms", F.size("terms"))
    return rows.withColumn("tier", F.floor(4 * F.log2(F.col("n_terms") + 1)).cast("int"))


def slots_of(rows: DataFrame) -> DataFrame:
    """file_type, tier, slots: into how many ranges of about RANGE rows a tier is dealt. Tiers are few, four to an octave."""
    return rows.groupBy("file_type", "tier").agg(F.ceil(F.count(F.lit(1)) / RANGE).alias("slots"))


def placed(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """With the slot of each row in its tier."""
    return rows.join(F.broadcast(slots), ["file_type", "tier"]).withColumn("slot", F.pmod(F.xxhash64("chunk_index", "file_id"), "slots").cast("int")).drop("slots")


def saturation(tf: Column, n_terms: Column, average: Column) -> Column:
    """What a posting scores for an idf of one."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_terms / average))


def blocks_of(rows: DataFrame) -> DataFrame:
    """PLACE, zone, term, most, n, entries. One shuffle by the range serves both groupings."""
    average = counted_rows(rows).agg(F.sum("n_terms") / F.sum("n_chunks")).scalar()
    dealt = rows.select(*PLACE, *KEY, "n_terms", "terms").repartition(*PLACE)
    each = dealt.select(*PLACE, *KEY, "n_terms", F.explode("terms").alias("term")).groupBy(*PLACE, *KEY, "n_terms", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    entries = F.collect_list(F.struct(*KEY, "tf", "n_terms")).alias("entries")
    blocks = each.groupBy(*PLACE, "term").agg(F.max(saturation(F.col("tf"), F.col("n_terms"), average)).alias("most"), F.count(F.lit(1)).cast("int").alias("n"), entries)
    return blocks.withColumn("zone", F.floor(F.col("tier") / 8).cast("int"))


def counted_terms(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("file_type", "term").agg(F.sum("n").alias("df"))


def counted_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_terms").alias("n_terms"))


def lexical_index(chunks: DataFrame, text: Column | None = None) -> LexicalIndex:
    """The index of chunks as plans over the rows, which are normalised and written once; write_index() for more uses."""
    rows = kept(indexed_rows(chunks, text).withColumn("part", part_of(KEY)), "rows")
    rows = placed(rows, slots_of(rows))
    blocks, postings = blocks_of(rows), gram_rows(rows, KEY, F.col("norm"))
    stats = counted_rows(rows)
    return LexicalIndex(rows.drop("terms"), blocks, counted_terms(blocks), stats, GramIndex(postings, dictionary_of(postings), KEY), stats)


def section_text() -> Column:
    """What the corpus-wide search looks at: source, section and document."""
    return F.concat_ws("\n", "source", F.nullif(F.coalesce("section", F.lit("")), F.lit("")), "document")


def write_index(chunks: DataFrame, path: str, text: Column | None = None, grams: bool = True) -> None:
    """Write rows (by file type and part: texts are dealt once and normalised once), blocks (by file type and zone, in each file ordered by term, so that a scan for some
    terms skips row groups), document frequencies, statistics and grams below `path`."""
    spark = chunks.sparkSession
    spread = F.pmod(F.xxhash64("chunk_index"), F.lit(1 + int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    dealt = chunks.withColumn("part", part_of(KEY)).repartition("file_type", "part", spread)
    indexed_rows(dealt, text).drop("terms").write.partitionBy("file_type", "part").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows").withColumn("terms", tokens_of(F.col("norm")))
    slots_of(rows).write.parquet(f"{path}/slots")
    rows = placed(rows, spark.read.parquet(f"{path}/slots"))
    blocks_of(rows).sortWithinPartitions("file_type", "zone", "term").write.partitionBy("file_type", "zone").parquet(f"{path}/blocks")
    counted_terms(spark.read.parquet(f"{path}/blocks")).write.parquet(f"{path}/terms")
    counted_rows(rows).write.parquet(f"{path}/stats")
    if grams:
        write_grams(rows, KEY, F.col("norm"), f"{path}/grams")


def read_index(spark: SparkSession, path: str, grams: bool = True) -> LexicalIndex:
    """What write_index() wrote; without stored grams they are plans over the rows."""
    rows, slots, blocks, terms, stats = (spark.read.parquet(f"{path}/{t}") for t in ("rows", "slots", "blocks", "terms", "stats"))
    rows = placed(rows, slots)
    if grams:
        return LexicalIndex(rows, blocks, terms, stats, read_grams(spark, f"{path}/grams", KEY), stats)
    postings = gram_rows(rows, KEY, F.col("norm"))
    return LexicalIndex(rows, blocks, terms, stats, GramIndex(postings, dictionary_of(postings), KEY), stats)


def sizes(index: LexicalIndex) -> DataFrame:
    """file_type, chunks, terms, postings, longest: how many chunks, distinct terms and postings, and the largest frequency."""
    by_type = index.blocks.groupBy("file_type").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("postings"), F.max(F.array_max(F.transform("entries", lambda e: e["tf"]))).cast("long").alias("longest"))
    return index.stats.select("file_type", F.col("n_chunks").alias("chunks")).join(by_type, "file_type")


def corpus_stats(index: LexicalIndex | TextScan) -> DataFrame:
    """n_chunks, avg_terms: one row. Chunks without a term count."""
    if isinstance(index, TextScan):
        return term_counts(index).agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("n_terms").alias("avg_terms"))
    return index.stats.agg(F.sum("n_chunks").alias("n_chunks"), (F.sum("n_terms") / F.sum("n_chunks")).alias("avg_terms"))


def question_terms(questions: DataFrame) -> DataFrame:
    """question_id, terms (each once), phrase: the terms longer than two characters joined, if there are two at least."""
    asked = questions.withColumn("asked", tokens(F.col("question")))
    long = F.filter("asked", lambda t: F.length(t) > 2)
    return asked.select("question_id", F.array_distinct("asked").alias("terms"), F.when(F.size(long) >= 2, F.array_join(long, " ")).alias("phrase"))


def phrase_hits(index: LexicalIndex | TextScan, asked: DataFrame) -> DataFrame:
    """question_id, KEY of the chunks whose text holds a question's phrase, which may begin and end within words."""
    if isinstance(index, TextScan):
        return holding_texts(index, asked)
    return holding(index.grams, index.rows, F.col("norm"), asked)


def idf_of(n_chunks: Column) -> Column:
    return F.log(1 + (n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))


def weighted_terms(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """question_id, term, idf, avg_terms, stretch (the most that a part's longer average adds to a block's bound) for each term
    of a batch that the index has."""
    terms = F.broadcast(asked.select("question_id", F.explode("terms").alias("term")))
    df = index.terms.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    stats = corpus_stats(index)
    n_chunks, avg_terms = (stats.select(c).scalar() for c in ("n_chunks", "avg_terms"))
    idf = idf_of(n_chunks)
    return df.join(terms, "term").select("question_id", "term", idf.alias("idf"), avg_terms.alias("avg_terms"), F.greatest(F.lit(1.0), avg_terms / index.average()).alias("stretch"))


def impact(tf: Column, n_terms: Column) -> Column:
    return F.col("idf") * saturation(tf, n_terms, F.col("avg_terms"))


def scored(parts: DataFrame) -> DataFrame:
    return parts.groupBy("question_id", *KEY).agg(F.round(F.sum("part"), PLACES).alias("bm25_score")).where("bm25_score > 0")


def scanned_parts(scan: TextScan, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question_id, KEY, tf, n_terms, idf, avg_terms; question_id, KEY of the phrases) of a batch's questions, from one scan.
    Document frequencies are a row for each term of the batch."""
    rows = matched_rows(scan, asked)
    stats = rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("n_terms").alias("avg_terms"))
    n_chunks, avg_terms = (stats.select(c).scalar() for c in ("n_chunks", "avg_terms"))
    each = rows.select(*KEY, "n_terms", F.explode("hits").alias("hit")).select(*KEY, "n_terms", "hit.term", "hit.tf")
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = asked.select("question_id", F.explode("terms").alias("term")).join(F.broadcast(df), "term")
    weights = terms.select("question_id", "term", idf_of(n_chunks).alias("idf"), avg_terms.alias("avg_terms"))
    return each.join(F.broadcast(weights), "term"), rows.select(F.explode("held").alias("question_id"), *KEY)


def bm25(index: LexicalIndex | TextScan, questions: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """question_id, KEY, bm25_score over 0, of all chunks. Statistics are the whole index's; `rows` (question_id, KEY)
    restricts what is scored, before anything is. A question's phrase in the text adds one, also without a matching term."""

    def scores(batch: DataFrame) -> DataFrame:
        asked = question_terms(batch)
        if isinstance(index, TextScan):
            found, bonus = scanned_parts(index, asked)
        else:
            found, bonus = index.postings.join(F.broadcast(weighted_terms(index, asked)), "term"), phrase_hits(index, asked)
        if rows is not None:
            wanted = rows.select("question_id", *KEY).distinct()
            found, bonus = (t.join(wanted, ["question_id", *KEY], "left_semi") for t in (found, bonus))
        parts = found.select("question_id", *KEY, impact(F.col("tf"), F.col("n_terms")).alias("part"))
        return scored(parts.unionByName(bonus.withColumn("part", F.lit(1.0))))

    return by_batches(questions, scores)


@dataclass(frozen=True)
class Pruned:
    """A batch's plan. terms: weighted_terms(); bonus: question_id, KEY, PLACE of phrase hits; open: question_id, PLACE."""

    terms: DataFrame
    bonus: DataFrame
    open: DataFrame


def opened(index: LexicalIndex, terms: DataFrame, ranges: DataFrame) -> DataFrame:
    """question_id, PLACE, entry e, idf, avg_terms: the postings of the batch's terms in the given ranges."""
    blocks = index.blocks.join(F.broadcast(terms), "term").join(ranges, ["question_id", *PLACE], "left_semi")
    return blocks.select("question_id", "idf", "avg_terms", F.explode("entries").alias("e"))


def scores_in(index: LexicalIndex, terms: DataFrame, bonus: DataFrame, ranges: DataFrame) -> DataFrame:
    parts = opened(index, terms, ranges).select("question_id", *[f"e.{c}" for c in KEY], impact(F.col("e.tf"), F.col("e.n_terms")).alias("part"))
    extra = bonus.join(ranges, ["question_id", *PLACE], "left_semi").select("question_id", *KEY, F.lit(1.0).alias("part"))
    return scored(parts.unionByName(extra))


def pruned(index: LexicalIndex, batch: DataFrame, top: int) -> Pruned:
    """Which ranges a batch of questions must open for its `top` best. What the batch asks for is written once, for every step
    reads it: its terms, and the chunks with a phrase."""
    asked = question_terms(batch)
    terms = kept(weighted_terms(index, asked), "terms")
    bonus = kept(holding(index.grams, index.rows, F.col("norm"), asked, carry=PLACE), "phrases")
    heads = index.blocks.join(F.broadcast(terms), "term").select("question_id", *PLACE, (F.col("idf") * F.col("most") * F.col("stretch")).alias("most"))
    lifted = bonus.select("question_id", *PLACE).distinct().withColumn("most", F.lit(1.0))
    bounds = heads.unionByName(lifted).groupBy("question_id", *PLACE).agg(F.sum("most").alias("bound"))
    order = Window.partitionBy("question_id").orderBy(F.desc("bound"), *PLACE)
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST * (1 + -(-top // RANGE))).select("question_id", *PLACE)
    found = ranked(scores_in(index, terms, bonus, first), "bm25_score", top).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min("bm25_score").alias("least"))
    cut = found.where(F.col("n") == top).select("question_id", "least")
    left = bounds.join(F.broadcast(cut), "question_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
    return Pruned(terms, bonus, left.select("question_id", *PLACE))


def lexical_hits(index: LexicalIndex | TextScan, questions: DataFrame, top: int = 100) -> DataFrame:
    """question_id, file_id, chunk_index, bm25_score, rank: the rows of bm25() that rank best; from an index, without scoring
    the others."""

    def best(batch: DataFrame) -> DataFrame:
        if isinstance(index, TextScan):
            return ranked(bm25(index, batch), "bm25_score", top)
        plan = pruned(index, batch, top)
        return ranked(scores_in(index, plan.terms, plan.bonus, plan.open), "bm25_score", top)

    return by_batches(questions, best).select("question_id", *KEY, "bm25_score", "rank")


def postings_opened(index: LexicalIndex, questions: DataFrame, top: int = 100) -> DataFrame:
    """question_id, opened, postings: how many postings of a question's terms lexical_hits() opens, of how many."""

    def counts(batch: DataFrame) -> DataFrame:
        plan = pruned(index, batch, top)
        of_terms = index.blocks.join(F.broadcast(plan.terms), "term").select("question_id", *PLACE, "n")
        opened_ = of_terms.join(plan.open, ["question_id", *PLACE], "left_semi").groupBy("question_id").agg(F.sum("n").alias("opened"))
        return of_terms.groupBy("question_id").agg(F.sum("n").alias("postings")).join(opened_, "question_id", "left").select("question_id", F.coalesce("opened", F.lit(0)).alias("opened"), "postings")

    return by_batches(questions, counts)
