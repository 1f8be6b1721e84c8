"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its content, the SHA-256 of its bytes. The ledger is a folder of Parquet files, a
partition for each scan, with a row for each blob that the scan looked at: its digest, and for each rule and rule version the
spans found. A scan takes one copy of each blob, asks the ledger which of the current rules have not seen it yet, looks at
those pairs alone, and adds them; a scan that dies leaves no row, and its pairs stay unseen. Findings are joined back to every
path whose version has that content, also to paths that no scan moved.

A rule is a pattern and the length that its last group must have; bumping a rule's version makes its pairs unseen. The JVM
decides by a plain search which blobs a rule can say anything about, so the texts of all others don't reach Python.

The rules are those of the contract. The ledger changes what is scanned, not what counts as a secret: it adds no span to
theirs.

Defined results: a null text is empty; rows with a null id are left out, repeated ids count once (see common.keyed); matches
are leftmost and don't overlap within a kind, kinds may; letters of the first rule match in either case, those of ASCII only;
spans are those of whole matches in code points. Texts are searched whole, whatever their length."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbase.llm.common import bound_batches, forget_caches, fresh_path, keyed, release_later, write_once


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # of the last group, else of the match; in code points
    hint: str  # found in every text that has a match, in the JVM's dialect
    version: int = 1
    any_case: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))
        last = found.groups and found.groups
        return [m.span() for m in found.finditer(text) if m.end(last) - m.start(last) >= self.least]


#: The rules of the contract, in its order.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 24, r"[0-9a-f]{24}"),
)

SPANS = "array<struct<start:int,end:int>>"
PAIRS_DDL = f"digest string, results array<struct<kind:string,version:int,spans:{SPANS}>>"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
PAIRS = pa.schema([("digest", pa.string()), ("results", pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("spans", pa.list_(SPAN))])))])


def content(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """What all finished scans of a ledger have added; an absent ledger is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return spark.read.schema(f"{PAIRS_DDL}, scan string").parquet(path)


def pair(kind: Column, version: Column) -> Column:
    return F.concat_ws(":", kind, version)


def unseen_blobs(versions: DataFrame, path: str, rules: tuple[Rule, ...]) -> DataFrame:
    """digest, text, kinds: one copy of each blob that some current rule hasn't seen, and those rules."""
    spark = versions.sparkSession
    blobs = versions.groupBy("digest").agg(F.first("text").alias("text"))
    seen = ledger_rows(spark, path).select("digest", F.explode("results").alias("r")).select("digest", pair(F.col("r.kind"), F.col("r.version")).alias("seen"))
    seen = seen.groupBy("digest").agg(F.collect_set("seen").alias("seen"))
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    due = F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "digest", "left").select("digest", "text", due.alias("kinds")).where(F.size("kinds") > 0)


def scan_unseen(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Look at every pair of blob and rule version that the ledger hasn't, and add them. versions: digest, text."""
    bound_batches(versions.sparkSession)
    hinted = F.lit(False)
    for r in rules:
        hinted = hinted | (F.array_contains("kinds", f"{r.kind}:{r.version}") & F.col("text").rlike(r.hint))
    due = unseen_blobs(versions, path, rules).select("digest", "kinds", F.when(hinted, F.col("text")).alias("text"))

    def look(batches):
        forget_caches()
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            found = [(digest, [(r.kind, r.version, r.spans(text or "")) for r in rules if f"{r.kind}:{r.version}" in kinds]) for digest, kinds, text in rows]
            digests, results = [d for d, _ in found], [[{"kind": k, "version": v, "spans": [{"start": s, "end": e} for s, e in spans]} for k, v, spans in rs] for _, rs in found]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(results, PAIRS.field(1).type)], schema=PAIRS)

    write_once(due.mapInArrow(look, PAIRS_DDL), f"{path}/scan={uuid.uuid4().hex}")


def found_spans(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """digest, spans (kind, start, end; by start, then kind as the rules are listed) of every blob in which a current rule
    found something. Two scans at a time may add a pair twice; it counts once."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(k))])
    r = ledger_rows(spark, path).select("digest", F.explode("results").alias("r")).select("digest", "r.kind", "r.spans", F.element_at(order, pair(F.col("r.kind"), F.col("r.version"))).alias("k"))
    r = r.where(F.col("k").isNotNull() & (F.size("spans") > 0))
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("k").alias("k"), s["end"].alias("end"), F.col("kind").alias("kind")))
    whole = r.select("digest", "k", each.alias("spans")).groupBy("digest", "k").agg(F.first("spans").alias("spans"))
    return whole.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def findings(paths: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `paths` (any columns, digest among them) with the spans of their blobs; none is the empty list. Few blobs
    hold a secret, so their side is small; a digest that many paths share is split by AQE."""
    found = paths.join(found_spans(paths.sparkSession, path, rules), "digest", "left")
    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string>>")
    return found.withColumn("spans", F.coalesce("spans", none))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def document_secrets(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document. `ledger`: a folder that outlives the call;
    by default a new one in the shared folder."""
    spark = docs.sparkSession
    path = ledger or fresh_path(spark, "secrets")
    if ledger is None:
        release_later(spark, path)
    versions = keyed(docs, id_col, text_col).select("doc_id", content(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    scan_unseen(versions.select("digest", "text"), path)
    found = findings(versions.select("doc_id", "digest"), path)
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{r.kind}')")).cast("long").alias(f"n_{r.kind}") for r in RULES]
    text = spelled(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))
