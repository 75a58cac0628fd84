"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own letters say so, every chunk gets an identifier, and two texts
are equal when their ordered identifier lists are. Long texts move once, as distinct chunks,
to verify the identifiers; after that only identifier lists are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.session import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
# 512 to 4,096 characters; from 512 on the chunk ends after the first space that follows two
# letters of these classes. Text without such a place is cut at 4,096.
CHUNK = r"(?s).{512,4096}?(?<=[h-n][a-g] )|.{1,4096}"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, SPACES, " ")).otherwise(text)


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def fingerprint(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunk_collisions(rows: DataFrame) -> DataFrame:
    """(h, chunk, ordinal) of the second and later chunks that share a fingerprint with another text.

    Every distinct chunk is compared as text; copies are merged in the map tasks before they move.
    """
    distinct = rows.select("h", "chunk").distinct()
    shared = cut_lineage(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    if shared.isEmpty():
        return rows.sparkSession.createDataFrame([], "h long, chunk string, ordinal int")
    numbered = (
        rows.join(shared, "h")
        .select("h", "chunk")
        .distinct()
        .withColumn("ordinal", F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1)
    )
    return cut_lineage(numbered.filter("ordinal > 0"))


def exact_groups(docs: DataFrame, mark: Callable[[Column], Column] = fingerprint) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of `docs`.

    Texts are equal when identical after `normalised`; empty and null texts are equal to each
    other. The smallest doc_id of a group stays; rows that repeat its doc_id are the same
    document and stay with it. A null doc_id stays only in a group without other ids. An empty
    table gives no rows; columns other than doc_id and text are ignored.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    cut = text.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks_of(F.col("norm")).alias("chunks"))
    pieces = cut.select("doc_id", "text_sha256", F.posexplode("chunks").alias("at", "chunk")).withColumn("h", mark(F.col("chunk")))
    again = chunk_collisions(pieces)
    recipes = cut.select("doc_id", "text_sha256", F.transform("chunks", mark).alias("recipe"))
    if again.isEmpty():
        recipes = recipes.withColumn("fixes", F.array().cast("array<struct<at:int,ordinal:int>>"))
    else:
        fixes = (
            pieces.join(again, ["h", "chunk"])
            .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.struct("at", "ordinal").alias("fix"))
            .groupBy("_id", "_sha")
            .agg(F.array_sort(F.collect_set("fix")).alias("fixes"))
        )
        recipes = recipes.join(fixes, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left").select(
            "doc_id", "text_sha256", "recipe", F.coalesce("fixes", F.array().cast("array<struct<at:int,ordinal:int>>")).alias("fixes")
        )
    recipes = cut_lineage(recipes)
    # written, so that the join deals out both sides itself and can split a hot group's rows
    groups = cut_lineage(
        recipes.groupBy("recipe", "fixes")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    # left: a row alone in its group needs no partner
    joined = recipes.join(groups, ["recipe", "fixes"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that `exact_groups` keeps."""
    gone = exact_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.sha2(normalised(docs["text"]), 256) == gone["_sha"])
    return docs.join(gone, same, "left_anti")
