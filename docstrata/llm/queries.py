"""The registered queries of this subpackage: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ann import nearest
from .bpe import code_documents
from .common import table
from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .langid import predict_language, train_language
from .licenses import TEMPLATES, oracle as license_oracle, scan_licenses
from .mixing import mix_sources
from .negatives import ORACLE as NEGATIVES, hard_negatives, relabelled
from .passages import ORACLE as PASSAGES, remove_passages
from .pii import replace_pii
from .quality import fit_quality, score_quality
from .spelling import spelling_forms
from .suffixes import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, threshold=0.9).withColumn("n_shingles", F.col("n_shingles").cast("long"))


def fold(n: int) -> Column:
    """The CRC-32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language(docs, may_learn=fold(4) != 2)
    held = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    return predict_language(docs, model).select("doc_id", held, "lang_pred", "score", "rejected")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("draws")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or tokenizer_path()
    coded = code_documents(table(spark, sf_dir, "documents"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(docs, table(spark, sf_dir, "labels"), may_learn=fold(3) != 1)
    held = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return score_quality(docs, trees).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Query] = {"op1_licenses": op1_licenses, "op2_suffix_dedup": op2_suffix_dedup, "op3_jaccard": op3_jaccard, "op4_language": op4_language, "op10_quality": op10_quality, "op5_pii": op5_pii, "op6_mixing": op6_mixing, "op7_nearest": op7_nearest, "op8_exact_dedup": op8_exact_dedup, "op9_bpe": op9_bpe, "op11_spelling": op11_spelling, "op12_hard_negatives": op12_hard_negatives, "op13_passages": op13_passages}

ORACLE_SQL: dict[str, str] = {
    "op12_hard_negatives": NEGATIVES,
    "op13_passages": PASSAGES,
    "op1_licenses": license_oracle(TEMPLATES),
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
