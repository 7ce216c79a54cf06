"""Corpus pipeline: toxic documents go, one document of each near-duplicate class stays, repeated
passages are cut out, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of the documents they get, whatever further columns those have. Rows that repeat a
doc_id, or have none, are documents of their own: each stays unless it is a near copy of another row.
A text that is cut away whole stays as an empty text. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm.common import materialize, table, vocabulary_path
from inkgrid.llm.ngram_join import jaccard_join
from inkgrid.llm.packing import pack_documents
from inkgrid.llm.suffix_dedup import remove_repeats
from inkgrid.llm.toxicity import with_scores


def _boxed(docs: DataFrame) -> DataFrame:
    """All columns in one, so that no further column can clash with those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    scored = with_scores(_boxed(docs), table(spark, sf_dir, "labels"), ["row"])
    return scored.filter("score < 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the n-gram Jaccard join the row of least doc_id stays (null last, then least xxhash64(text))."""
    rows = _boxed(docs).withColumn("place", F.col("doc_id").cast("long"))
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        # ids that name no single row: rows are numbered by a distributed sort
        ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        rows = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "numbered")
    classes = jaccard_join(rows.select(F.col("place").alias("doc_id"), "text"))
    gone = classes.filter("class_id <> doc_id").select(F.col("doc_id").alias("place"))
    return rows.join(gone, "place", "left_anti").select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that also start earlier in the corpus are cut out of the texts."""
    cut = remove_repeats(_boxed(docs), ["row"], with_text=True)
    row = F.col("row").withField("text", F.when(F.col("row.text").isNotNull(), F.col("kept")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("row.n_chars").isNotNull(), F.length("kept")).cast(docs.schema["n_chars"].dataType))
    return cut.select(row.alias("row")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of 1024 tokens."""
    return pack_documents(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

#: A trained classifier and a tokenizer are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
