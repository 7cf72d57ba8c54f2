"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the
stage before it kept.  All but the last return the columns of ``documents``;
``n_chars`` follows the text.  Rows that share a document id share its fate; a
null id is never joined to anything and stays.  A column of the documents may bear
the name of an operator's result; empty tables give no rows.

1. ``language_id``: documents without a letter, or whose language stays
   ambiguous, go.
2. ``line_dedup``: repeated lines go, except in the first document; a document
   that loses lines and keeps none long enough to be compared (a copy of which only
   scraps remain) goes.
3. ``minhash_near_dedup``: five-word shingles, similarity 0.8; the smallest
   document id of each group stays.
4. ``benchmark_decontamination``: documents that hold a window of a benchmark
   item go.
5. ``bpe_encoding``: token ids of the whole text, and the text decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covgrid.llm import bpe_codec, common, decontaminate, language_id, line_dedup, minhash_dedup
from covgrid.session import materialize


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents; a text alone decides."""
    model = language_id.fit(docs)
    found = language_id.predict(common.packed(docs, ["text"], text=F.col("text")), model)
    kept = found.where((F.col("_lang.lang") != language_id.UNKNOWN) & ~F.col("_lang.ambiguous"))
    return common.unpacked(kept, docs.columns, text=F.col("text")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = common.packed(docs, ["text"], doc_id=F.col("doc_id"), text=F.col("text"), n_chars=F.col("n_chars"))
    out = line_dedup.dedup_lines(packed)
    changed = F.col("_lines.n_dropped") > 0
    whole = F.exists(F.split("_lines.kept", "\n"), lambda line: F.length(
        F.btrim(line, F.lit(line_dedup.BLANK))) >= line_dedup.MIN_CHARS)
    out = out.where(~changed | whole)
    text = F.when(changed, F.col("_lines.kept")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("_lines.kept").cast("long")).otherwise(F.col("n_chars"))
    out = out.withColumns({"text": text, "n_chars": n_chars})
    return out.select(*[F.col(c) if c in ("text", "n_chars") else F.col("doc")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(docs, k=5, percent=80)
    gone = found.where("not kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items)
    gone = found.where("contaminated").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, decoded``."""
    codec = bpe_codec.build_codec(docs, tokenizer_path())
    out = codec.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("_bpe.ids").cast("long").alias("n_tokens"),
                      "_bpe.ids", "_bpe.decoded")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: Learned classifiers, components and tokenisation are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
