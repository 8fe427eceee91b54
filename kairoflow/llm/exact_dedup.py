"""Exact duplicates through content-defined chunk recipes; DataFrame functions only.

A text is cut where its own content says so (after a line break or a sentence end, not before
``MIN_CHUNK`` characters, at ``MAX_CHUNK`` at the latest). Each chunk is named by its SHA-256. One
shuffle of distinct chunk bytes verifies that no name stands for two different chunks; after that
only the ordered lists of names ("recipes") move, never the long texts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoflow.session import materialize

MIN_CHUNK, MAX_CHUNK = 1024, 8192


def _pattern(least: int, most: int) -> str:
    return rf"(?s).{{{least},{most}}}?(?:(?<=\n)|(?<=[.!?] )|\z)|.{{1,{most}}}"


def chunk_column(text, least: int = MIN_CHUNK, most: int = MAX_CHUNK):
    """The chunks of a text column, in order; joined they are the text. Empty text: no chunk."""
    return F.regexp_extract_all(text, F.lit(_pattern(least, most)), F.lit(0))


def ambiguous_chunks(docs: DataFrame, text: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """Digests that stand for more than one chunk's bytes (in practice none): (digest)."""
    chunks = docs.select(F.explode(chunk_column(F.coalesce(F.col(text), F.lit("")), least, most)).alias("chunk"))
    named = chunks.select(F.unhex(F.sha2(F.col("chunk").cast("binary"), 256)).alias("digest"), "chunk").distinct()
    return named.groupBy("digest").count().where("count > 1").select("digest")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical byte for byte; null counts as empty. Of equal texts the largest
    doc_id stays (a null doc_id stays only in a group without any other). Rows that repeat a doc_id
    are counted each and are kept or dropped together. Very long texts only make longer recipes. An
    empty table gives no rows; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # A digest shared by different chunks cannot name them: documents are then compared whole.
    verified = ambiguous_chunks(docs, text, least, most).isEmpty()
    parts = F.transform(chunk_column(body, least, most), lambda c: F.unhex(F.sha2(c.cast("binary"), 256)))
    recipes = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.sha2(body.cast("binary"), 256).alias("text_sha256"),
        (parts if verified else F.array(body.cast("binary"))).alias("recipe"),
    )
    # Both sides of the join are written tables, so a recipe of very many rows can be split there.
    recipes = materialize(recipes, "recipes")
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    joined = recipes.join(materialize(groups, "groups"), "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat another row's text; all columns as they are.

    Rows are told apart by doc_id and text: a row goes only if its own text stays under another
    doc_id, so a repeated doc_id with a text of its own loses nothing.
    """
    found = exact_duplicates(docs, doc_id, text)
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text")).distinct()
    own = F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256)
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["_gone_id"]) & (own == gone["_gone_text"]), "left_anti")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.drop("n_chunks")


ORACLE = {
    "op9_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
}
