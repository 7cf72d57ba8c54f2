r"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches in ascending document id.  A *run* holds the line
keys one batch saw first, hash-bucketed and sorted on the key hash, so a later
batch is merge-joined against it without moving the run.  After each batch its
new keys become a run of level 0; when a level holds ``fanout`` runs they are
compacted into one run of the next level, so a batch meets a logarithmic
number of runs.

A line's key is the line without ``[\x20\x09-\x0D]`` at its ends, A-Z
lower-cased.  A key of at least ``min_chars`` code points held by two documents
loses all its lines except those of the smallest document id holding it.

Keys are compared by 128 bits of hash.  Everything is JVM-side.  A very
common line is pre-aggregated before the shuffle; in the join that marks its
lines it is one skewed key of a plain equi-join, which AQE splits.

Defined cases: a null or empty text is one empty line (never dropped); rows
that share a document id are one document; a null document id counts as one
document behind all others; an empty table gives no rows; extra columns, also
with clashing names, are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.session import materialize, stage_path

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\f\r"
#: Shorter keys are never dropped.
MIN_CHARS = 10
LAST_ID = (1 << 63) - 1
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The key of a line.  Only A-Z are lower-cased: an all-ASCII line takes
    the fast path, any other line is translated."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(
        F.translate(bare, UPPER, LOWERED))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("d"),
                       F.xxhash64(text).alias("t"), text.alias("text"))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``d, t, pos, h1, h2`` of every line whose key is long enough; ``t``
    tells rows of one document apart."""
    lines = _identified(docs, id_col, text_col).select(
        "d", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("d", "t", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("d", "t", "pos", F.xxhash64("key").alias("h1"),
                        F.xxhash64(F.lit(0x51ED27), "key").alias("h2"))


class Runs:
    """Levelled runs: bucketed, sorted tables in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", stage_path(self.spark, name)).format("parquet").saveAsTable(name))
        table = self.spark.table(name)
        table.schema  # resolved: the catalogue entry is no longer needed
        self.spark.sql(f"DROP TABLE {name}")
        return table

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, run: DataFrame) -> None:
        self.levels[0].append(run)
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                return
            merged = level[0]
            for r in level[1:]:
                merged = merged.unionByName(r)
            level.clear()
            if k + 1 == len(self.levels):
                self.levels.append([])
            # a groupBy deals the rows to their buckets; keys of different runs differ
            self.levels[k + 1].append(self.write(merged.groupBy(*KEY).agg(F.lit(True).alias("new"))).select(*KEY))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                  batches: int = 4, fanout: int = 2) -> DataFrame:
    """``d, t, pos`` of the lines to drop."""
    spark = docs.sparkSession
    found = line_hashes(docs, id_col, text_col, min_chars)
    # equal-width id ranges; how evenly they fill decides speed, never results
    lo, hi = docs.select(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    width = (hi - lo) // batches + 1
    bounds = [lo + width * i for i in range(1, batches)]
    batch = F.lit(0)
    for b in bounds:
        batch = batch + F.when(F.col("d") >= b, 1).otherwise(0)
    lines = materialize(found.withColumn("batch", batch), "lines")
    runs, marks = Runs(spark, fanout), []
    for b in range(batches):
        keys = (lines.where(F.col("batch") == b).groupBy(*KEY)
                .agg(F.min("d").alias("first"), F.max("d").alias("last")))
        # merge-join with each run: a key is in one run at most
        seen = F.lit(False)
        for i, run in enumerate(runs.all()):
            keys = keys.join(run.select(*KEY, F.lit(True).alias(f"in{i}")), KEY, "left")
            seen = seen | F.coalesce(F.col(f"in{i}"), F.lit(False))
        keys = runs.write(keys.select(*KEY, "first", "last", seen.alias("seen")))
        marks.append(keys.where("seen or first < last").select(
            *KEY, F.lit(b).alias("batch"), F.when(F.col("seen"), F.lit(None)).otherwise(F.col("first")).alias("owner")))
        if b + 1 < batches:
            runs.add(keys.where("not seen").select(*KEY))
    marked = marks[0]
    for m in marks[1:]:
        marked = marked.unionByName(m)
    return (lines.join(marked, [*KEY, "batch"]).where(F.col("owner").isNull() | (F.col("d") != F.col("owner")))
            .select("d", "t", "pos"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with every column, plus a struct column ``_lines`` of ``n_lines``
    (before dropping), ``n_dropped`` and ``kept`` (the remaining lines joined by
    a newline)."""
    drops = (dropped_lines(docs, id_col, text_col, min_chars, batches, fanout)
             .groupBy(F.col("d").alias("_d"), F.col("t").alias("_t"))
             .agg(F.collect_set("pos").alias("_drop")))
    # the text goes through the shuffle once: beside the other columns, not also among them
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = common.packed(docs, [text_col], _d=F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)),
                          _t=F.xxhash64(text), _text=F.col(text_col))
    whole = F.coalesce("_text", F.lit(""))
    joined = keyed.join(drops, ["_d", "_t"], "left").withColumn("_all", F.split(whole, "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), whole).otherwise(
        F.array_join(F.transform(F.array_sort(keep), lambda i: F.get(F.col("_all"), i)), "\n"))
    out = common.unpacked(joined, docs.columns, **{text_col: F.col("_text")}, _lines=F.struct(
        F.size("_all").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")))
    return out.select(*[f"`{c}`" for c in docs.columns if c != "_lines"], "_lines")
