"""The corpus operators' queries by name, and DuckDB SQL where SQL can express their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    decontaminate, embedding_dedup, importance, language_id, line_dedup, lm_score, merkle, ngram_jaccard, pii, sentencepiece_fst, token_count, toxicity, url_filter,
)
from .common import table


def op1_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_token_counts(spark, sf_dir):
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op3_lm_score(spark, sf_dir):
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_fst.encode_documents(docs, decoded=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_byte_pieces",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


def op5_toxicity(spark, sf_dir):
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "toxic", "p_toxic", "p_low_quality")


def op6_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_pii(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_token_counts, op3_lm_score, op4_sentencepiece, op5_toxicity, op6_ngram_jaccard,
        op7_decontamination, op8_line_dedup, op9_language_id, op10_embedding_dedup,
        op11_importance_resampling, op12_merkle_manifest, op13_pii,
    )
}
ORACLES = {
    "op1_url_filter": url_filter.oracle(),
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_embedding_dedup": embedding_dedup.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
