"""Tables clustered by a key for lookups and joins: bucketed and sorted by the place of a row, with Bloom filters.

A row's place is the hash of its key and of the part of the key that it is dealt to, so that a key that holds a third of all
rows lies in many buckets. A lookup names the places of its keys: Spark then opens the buckets that hold them and no others, and
of those the row groups that may hold them. A join with a list of keys leaves the clustered rows where they are."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "place"
ABOUT = "key string, spread string, buckets int, parts int, columns string"


@dataclass(frozen=True)
class Clustered:
    """A clustered table: `rows` has PLACE besides the columns that were written."""

    rows: DataFrame
    key: str
    spread: str
    parts: int


def place_of(key: Column, part: Column) -> Column:
    return F.xxhash64(key, part.cast("int"))


def write_clustered(rows: DataFrame, path: str, key: str, spread: str, buckets: int = 64, parts: int = 16) -> None:
    """Replaces the table at the path. Rows of a key are dealt to `parts` by the hash of `spread`; a null key is a key like any
    other. Each bucket is one file, written by one task."""
    placed = rows.withColumn(PLACE, place_of(F.col(key), F.pmod(F.xxhash64(spread), F.lit(parts))))
    spark, name = rows.sparkSession, f"clustered_{uuid.uuid4().hex}"
    writer = placed.repartition(buckets, PLACE).write.mode("overwrite").format("parquet").bucketBy(buckets, PLACE).sortBy(PLACE, spread)
    writer = writer.option(f"parquet.bloom.filter.enabled#{PLACE}", "true").option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option("path", f"{path}/rows").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    spark.createDataFrame([(key, spread, buckets, parts, columns)], ABOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def read_clustered(spark: SparkSession, path: str) -> Clustered:
    """The table at the path, as a table of this session's catalogue, for buckets are known to tables only."""
    about = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
    name = f"clustered_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({about.columns}) USING parquet CLUSTERED BY ({PLACE}) SORTED BY ({PLACE}, `{about.spread}`) INTO {about.buckets} BUCKETS LOCATION '{path}/rows'")
    return Clustered(spark.table(name), about.key, about.spread, about.parts)


def lookup(table: Clustered, values: Iterable) -> DataFrame:
    """The rows of a few keys; None looks up the null key."""
    spark, kind = table.rows.sparkSession, table.rows.schema[table.key].dataType
    wanted = spark.createDataFrame([(v,) for v in dict.fromkeys(values)], f"v {kind.simpleString()}")
    found = wanted.select("v", F.explode(F.sequence(F.lit(0), F.lit(table.parts - 1))).alias("p")).select("v", place_of(F.col("v"), F.col("p")).alias("at")).collect()
    named = [r.v for r in found if r.v is not None]
    held = F.col(table.key).isin(*dict.fromkeys(named)) if named else F.lit(False)
    held = held | F.col(table.key).isNull() if len(named) < len(found) else held
    return table.rows.where(F.col(PLACE).isin(*{r["at"] for r in found}) & held).drop(PLACE)


def of_keys(table: Clustered, keys: DataFrame) -> DataFrame:
    """The rows whose key is among the keys, of which only the distinct ones are moved, once for each part. Null is no key here.

    The join is on the place alone, by which the table is bucketed: an equality of the key would be a second join key, and Spark
    would move both sides by the two. Two keys of one place, which only a collision of 64 bits makes, are told apart after it."""
    parts = F.sequence(F.lit(0), F.lit(table.parts - 1))
    spots = keys.select(F.col(table.key).alias("wanted")).where(F.col("wanted").isNotNull()).distinct().withColumn("p", F.explode(parts))
    spots = spots.select(place_of(F.col("wanted"), F.col("p")).alias("at"), "wanted")
    same = (F.col(table.key) <= F.col("wanted")) & (F.col(table.key) >= F.col("wanted"))
    return table.rows.join(spots, (F.col(PLACE) == F.col("at")) & same, "left_semi").drop(PLACE)
