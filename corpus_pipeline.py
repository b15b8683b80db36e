"""The corpus pipeline: quality, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docstrata.llm.bpe import code_documents
from docstrata.llm.common import cut, partitions, sized, table
from docstrata.llm.exact_dedup import exact_dedup
from docstrata.llm.jaccard import jaccard_components
from docstrata.llm.mixing import mix_sources
from docstrata.llm.quality import fit_quality, score_quality
from docstrata.llm.queries import fold, tokenizer_path


def fresh(docs: DataFrame, name: str) -> str:
    """name, made longer until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever their names."""
    return [docs[f"`{c}`"] for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier accepts. It learns from the labelled ones among docs."""
    trees, score = fit_quality(docs, table(spark, sf_dir, "labels"), may_learn=fold(3) != 1), fresh(docs, "quality_score")
    scored = score_quality(docs, trees, score)
    return scored.where(F.col(score) >= 0.5).select(*own(scored)[: len(docs.columns)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest doc_id; rows with a null doc_id stay only if all
    rows of their text have one, and then one of them."""
    flags = cut(exact_dedup(docs).where("group_size > 1").withColumn("again", ~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    id_, sha = fresh(docs, "same_id"), fresh(docs, "same_sha")
    key = [F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)]
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col(sha))
    gone = cut(flags.where("not kept and not again").select(*key).distinct())
    kept = docs.join(sized(gone), same, "left_anti")
    if flags.where("again").isEmpty():
        return kept
    repeated = cut(flags.where("again").select(*key).distinct())  # rows that repeat id and text
    once = kept.join(sized(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(sized(repeated), same, "left_anti").unionByName(once)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group of near copies: five-word
    shingles, Jaccard similarity of 0.8 or more. Rows without a doc_id stay."""
    id_ = fresh(docs, "same_id")
    gone = cut(jaccard_components(docs, n=5, threshold=0.8).where("doc_id <> component_id").select(F.col("doc_id").alias(id_)).distinct())
    return docs.join(sized(gone), docs["doc_id"] == F.col(id_), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents so that each source has about its target's words, dealt to
    shards by the splitting tree and shuffled within them. A draw that takes part of a document takes
    it in whole if that part is half of it or more; documents without words stay once."""
    id_, drawn, shard, place = (fresh(docs, c) for c in ("mixed_id", "drawn", "mix_shard", "mix_place"))
    n_shards = 1 << (partitions(spark) - 1).bit_length()
    some = F.filter("draws", lambda d: d["words"] * 2 >= F.col("size"))
    empty = F.array(F.struct(F.lit(0).cast("long").alias("pass"), F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int").alias("shard"), F.lit(0).cast("long").alias("words"), F.xxhash64(F.lit(1), "doc_id").alias("place")))
    mixed = mix_sources(docs, n_shards).select(F.col("doc_id").alias(id_), F.when(F.col("size") == 0, empty).otherwise(some).alias(drawn))
    mixed = cut(mixed.groupBy(id_).agg(F.max(drawn).alias(drawn)).where(F.size(drawn) > 0))
    joined = docs.join(sized(mixed), docs["doc_id"].eqNullSafe(F.col(id_))).withColumn(drawn, F.explode(drawn))
    dealt = joined.withColumns({shard: F.col(drawn)["shard"], place: F.col(drawn)["place"]})
    return dealt.repartition(shard).sortWithinPartitions(shard, place).select(*own(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the decoded text of every row."""
    coded = code_documents(docs, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [("quality", quality), ("exact dedup", exact), ("n-gram jaccard", near), ("mixing", mix), ("bpe", tokens)]

#: No SQL expresses the classifier, the mix or the tokens; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
