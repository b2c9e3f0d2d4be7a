"""Secret scans: an incremental blob ledger in DataFrame operations only.

Every version of a document is content-addressed: its blob is the SHA-256 of its text. The ledger is a table in the shared
folder with one row for each (blob, rule, rule version) ever scanned and the spans found, empty ones too. A scan takes one
representative document of each blob, looks up which (rule, version) pairs the ledger lacks for it, runs only those, adds
them to the ledger, and joins the ledger's findings back to all documents (paths) that carry the blob. The query scans in
two batches through one ledger: the documents of the first, then all, of which only unseen blobs are scanned.

A match's place comes from built-ins alone: every match is wrapped in a noncharacter (which the text itself is freed of
first, one character for one, in no rule's alphabet), the text is split at it, so every second piece is a match, and the
pieces' lengths add up to code-point offsets.

Nulls: a null text is the empty blob, a null doc_id is a path like any other. Repeated rows share a blob and get the same
findings; rows that share a doc_id but not a text do not, because representatives are fetched by doc_id and blob. Empty
tables give no rows. Very long texts are scanned whole. Other columns are not touched, whatever their names.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, shared_dir, table

MARK = "﷐"


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str  # Java syntax; matched leftmost, without overlap
    group: int  # the group that has to be long enough
    least: int


#: The patterns and lengths of the three base kinds.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's spans in text: array of (start, kind, end), end exclusive, in code points."""
    marked = F.regexp_replace(F.translate(text, MARK, "\x01"), F.lit(rule.pattern), F.lit(f"{MARK}$0{MARK}"))
    pieces = F.split(marked, MARK)

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.char_length(piece)
        fits = F.char_length(F.regexp_extract(piece, rule.pattern, rule.group)) >= rule.least
        found = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(
            end.cast("bigint").alias("at"),
            (~acc["odd"]).alias("odd"),
            F.when(acc["odd"] & fits, F.array_append(acc["out"], found)).otherwise(acc["out"]).cast(SPAN).alias("out"),
        )

    empty = F.array().cast(SPAN)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("odd"), empty.alias("out"))
    return F.when(F.instr(marked, MARK) > 0, F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(empty)


LEDGER = "blob binary, kind string, version int, found " + SPAN


class Ledger:
    """The table of all scans so far: batches of rows in one folder of the shared store, only ever added to."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
        self.spark.createDataFrame([], LEDGER).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def add(self, fresh: DataFrame) -> None:
        fresh.write.mode("append").parquet(self.path)


def paths_of(docs: DataFrame) -> DataFrame:
    """doc_id, blob of every row."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("blob"))


def unseen(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that docs lack: every blob's representative scanned with the rules (or rule versions) not yet run on it."""
    known = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    blobs = paths_of(docs).groupBy("blob").agg(F.min("doc_id").alias("one")).join(seen, "blob", "left")
    blobs = blobs.withColumn("missing", F.array_except(known, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>"))))
    blobs = blobs.where(F.size("missing") > 0).select(F.col("blob").alias("sha"), "one", "missing")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # Rows equal in doc_id and text are one text, scanned once each: their equal findings fall together below.
    one = texts.join(blobs, (F.col("blob") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("one")))
    kinds = [r.kind for r in rules]
    runs = [F.when(F.array_contains("missing", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r, kinds.index(r.kind)).alias("found"))) for r in rules]
    rows = one.select("blob", F.explode(F.array_compact(F.array(*runs))).alias("run")).select("blob", "run.kind", "run.version", "run.found")
    return rows.groupBy("blob", "kind", "version").agg(F.first("found").alias("found"))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, found (spans sorted by start, then rule) of every row of docs, from the ledger alone."""
    valid = F.lit(False)
    for r in rules:
        valid = valid | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    place = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")) - 1  # these rules' order, not that of an earlier scan
    named = F.transform("found", lambda s: F.struct(s["start"].alias("start"), place.cast("int").alias("kind"), s["end"].alias("end")))
    own = ledger.where(valid & (F.size("found") > 0)).withColumn("found", named).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return paths_of(docs).join(own, "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast(SPAN)).alias("found"))


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger has not seen, add it to the ledger, and give the findings of every row of docs."""
    ledger.add(unseen(docs, ledger.rows(), rules))
    return findings(docs, ledger.rows(), rules)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark)
    scan(docs.where(bucket_of(F.col("doc_id"), 2) == 0), ledger)  # an earlier batch
    found = scan(docs, ledger)
    names = F.array(*[F.lit(r.kind) for r in RULES])
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES)]
    return found.select("doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))
