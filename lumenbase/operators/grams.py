"""Substring search through an index of character n-grams.

The index of a table of texts is a posting row for each text and each of its distinct n-grams, and a dictionary of the grams
with how many texts have them. Texts count as ending with n - 1 end marks, so that a gram begins at every character and a
needle shorter than n is the beginning of the grams of all texts that hold it.

A search takes each needle's rarest pieces (its grams, or itself if it is shorter), joins them with the postings, and keeps the
texts that hold all of them: the survivors. Only survivors are read and compared. Postings lie by a hash of the gram, texts
by a hash of their key, so a search reads the parts that its pieces and survivors lie in and leaves the others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.sources.shared import kept

GRAM, PARTS, RAREST = 3, 16, 4
END = "\0"


@dataclass(frozen=True)
class GramIndex:
    """postings: slot, gram, the key; dictionary: slot, gram, n; key: the columns that name a text."""

    postings: DataFrame
    dictionary: DataFrame
    key: tuple[str, ...]


def part_of(key: tuple[str, ...] | list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int")


def grams_in(text: Column) -> Column:
    """All runs of GRAM characters, each once. A run that begins within a pair of surrogates counts like any other: it does so
    in texts and in needles alike."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))


def gram_rows(texts: DataFrame, key: tuple[str, ...], text: Column) -> DataFrame:
    """slot, gram, key: each gram of a text once. A null text has none."""
    each = texts.where(text.isNotNull()).select(*key, F.explode(grams_in(F.concat(text, F.lit(END * (GRAM - 1))))).alias("gram"))
    return each.select(F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int").alias("slot"), "gram", *key)


def dictionary_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("slot", "gram").agg(F.count(F.lit(1)).alias("n"))


def write_grams(texts: DataFrame, key: tuple[str, ...], text: Column, path: str) -> None:
    """Write the index of the texts below `path`. A common gram's postings are dealt over tasks by their key."""
    spark = texts.sparkSession
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    rows = gram_rows(texts, key, text).repartition("slot", F.pmod(F.xxhash64(*key), F.lit(spread)))
    rows.sortWithinPartitions("slot", "gram").write.partitionBy("slot").parquet(f"{path}/postings")
    dictionary_of(spark.read.parquet(f"{path}/postings")).write.parquet(f"{path}/dictionary")


def read_grams(spark: SparkSession, path: str, key: tuple[str, ...]) -> GramIndex:
    return GramIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/dictionary"), key)


def pieces_of(needles: DataFrame) -> DataFrame:
    """question_id, piece, pieces: each needle's distinct grams, or the needle itself if it is shorter; and how many."""
    parts = F.when(F.length("phrase") >= GRAM, grams_in(F.col("phrase"))).otherwise(F.array("phrase"))
    return needles.select("question_id", parts.alias("all")).select("question_id", F.size("all").alias("pieces"), F.explode("all").alias("piece"))


def chosen_grams(index: GramIndex, needles: DataFrame, rarest: int = RAREST) -> DataFrame:
    """slot, gram, question_id, needed: the postings to look up for each needle, and in how many of them a text must be. A
    needle of which some piece is in no text has none. At most `rarest` grams a needle; for one shorter than a gram, the
    grams that begin with it."""
    wanted = F.broadcast(pieces_of(needles))
    begun = index.dictionary.select("slot", "gram", "n", F.explode(F.array_distinct(F.array(*[F.left("gram", F.lit(k)) for k in range(1, GRAM + 1)]))).alias("piece"))
    known = begun.join(wanted, "piece")
    totals = known.groupBy("question_id", "piece", "pieces").agg(F.sum("n").alias("n"), F.collect_list(F.struct("slot", "gram")).alias("grams"))
    by_need = Window.partitionBy("question_id")
    ranked = totals.withColumn("found", F.count(F.lit(1)).over(by_need)).withColumn("place", F.row_number().over(by_need.orderBy("n", "piece")))
    best = ranked.where((F.col("found") == F.col("pieces")) & (F.col("place") <= rarest))
    return best.select("question_id", F.least("pieces", F.lit(rarest)).alias("needed"), F.explode("grams").alias("g")).select("g.slot", "g.gram", "question_id", "needed")


def survivors(index: GramIndex, needles: DataFrame, rarest: int = RAREST) -> DataFrame:
    """question_id, key: the texts that have all of a needle's chosen pieces. needles: question_id, phrase; a bounded batch."""
    met = index.postings.join(F.broadcast(chosen_grams(index, needles, rarest)), ["slot", "gram"])
    return met.groupBy("question_id", *index.key).agg(F.count(F.lit(1)).alias("met"), F.first("needed").alias("needed")).where(F.col("met") >= F.col("needed")).select("question_id", *index.key)


def holding(index: GramIndex, texts: DataFrame, text: Column, needles: DataFrame, rarest: int = RAREST, carry: tuple[str, ...] = ()) -> DataFrame:
    """question_id, key and `carry` of the texts that hold each needle; an empty needle has none. texts: the key, `part`
    (part_of the key, best a partition column), what `text` reads, and `carry`. The survivors are written, so that their parts
    are known before any text is read; without survivors none is."""
    asked = needles.where(F.col("phrase").isNotNull() & (F.col("phrase") != "")).select("question_id", "phrase")
    left = kept(survivors(index, asked, rarest), "survivors").withColumn("part", part_of(index.key))
    parts = [r[0] for r in left.select("part").distinct().collect()]  # PARTS numbers at most
    columns = ["question_id", *index.key, *carry]
    if not parts:
        kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *texts.schema]}
        return texts.sparkSession.createDataFrame([], ", ".join(f"{c} {kinds[c]}" for c in columns))
    found = texts.where(F.col("part").isin(parts)).select("part", *index.key, *carry, text.alias("held")).join(left, ["part", *index.key])
    return found.join(F.broadcast(asked), "question_id").where(F.col("held").contains(F.col("phrase"))).select(columns)
