"""The corpus pipeline: language, repeated lines, near duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the
next stage's docs. Columns of docs travel in one struct, so extra columns, whatever their names,
come through every stage unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, language_id, line_dedup, ngram_jaccard, sentencepiece_fst
from barloom.llm.common import once_a_task, stored, table

#: SQL can express neither language models nor tilings.
ORACLE_SQL = None
#: A text whose best language has less than half of the posterior is in no known language.
LEAST_SCORE = 0.5
#: Neither is one that takes so many times the bits a byte of the language's usual text.
MOST_TIMES = 3.0


def _packed(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, and all others in one struct."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in keep]
    return docs.select(*keep, F.struct(*(rest or [F.lit(None).cast("int").alias("none")])).alias("_rest"))


def _unpacked(df: DataFrame, columns: list[str], keep: tuple[str, ...], **new) -> DataFrame:
    """The columns in their old order: replaced, kept, or out of the struct."""
    return df.select(*[new.get(c, F.col(c) if c in keep else F.col(f"_rest.`{c}`")).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty texts too) or in no learned language; all others stay as they are."""
    keep = ("doc_id", "text", "lang")
    found = language_id.identify(_packed(docs, *keep), carry=("text", "lang", "_rest"), times=MOST_TIMES)
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE) & F.col("fits")
    return _unpacked(found.where(known), docs.columns, keep)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines from texts (n_chars follows). A document that loses lines and has no
    text left goes; its lines stay in the document with the largest doc_id. A null text stays null."""
    packed = _packed(docs, "doc_id", "text").withColumn("_null", F.col("text").isNull())
    out = line_dedup.dedup_lines(packed, carry=("_rest", "_null"))
    left = (F.col("n_dropped") == 0) | F.col("kept").rlike(r"\S")
    new = {"text": F.when(~F.col("_null"), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("_rest.n_chars"))
    return _unpacked(out.where(left), docs.columns, ("doc_id", "text"), **new)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest doc_id, of each group of near copies. Equal rows
    count as copies; rows with a null doc_id take no part and stay."""
    kept = ngram_jaccard.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    packed = _packed(docs, "doc_id", "text").withColumn("_h", F.xxhash64("text"))
    this = (F.col("doc_id") == F.col("_id")) & (F.col("_h") == F.col("_hash"))
    once = once_a_task(packed.where("doc_id is not null"), "doc_id", "_h")
    stay = once.join(kept, this, "left_semi").dropDuplicates(["doc_id", "_h", "text"])  # on the join's own shuffle
    return _unpacked(stay.unionByName(packed.where("doc_id is null")), docs.columns, ("doc_id", "text"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that cover half of a benchmark item or more."""
    found = decontaminate.with_hits(_packed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(F.size("hits") == 0), docs.columns, ("doc_id", "text"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again: the documents with ids, n_byte_pieces and round_trip."""
    out = sentencepiece_fst.encode_documents(_packed(docs, "doc_id", "text"), decoded=True)
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    names = [c for c in docs.columns if c not in ("ids", "n_byte_pieces", "round_trip")]
    new = {"ids": F.col("ids"), "n_byte_pieces": F.col("n_byte_pieces"), "round_trip": same}
    return _unpacked(out, [*names, *new], ("doc_id", "text"), **new)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmark_passages),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each on what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
