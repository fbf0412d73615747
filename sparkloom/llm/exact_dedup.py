"""Exact deduplication, in DataFrame operations only.

Three combining stages, each of which compares whole texts: map-side partial aggregation deduplicates each
input partition; groups of (digest, salt, text) merge its winners, a hot text being dealt over ``salts`` tasks;
groups of (digest, text) combine the salt winners.  Each document then finds its group through (digest, salt),
so that no task meets more than a salt's share of a group.

Texts are grouped by content, never by digest alone: should two texts share a digest, they are told apart and
documents of that digest are matched by their texts.

Defined results: null text counts as empty; the row with the largest doc_id of a group stays (a null doc_id
stays only in a group that has no other); rows that repeat doc_id and text are one document and share its
decision; very long texts are compared whole; an empty table gives no rows; other columns are ignored by ``exact_groups`` and kept by
``drop_copies`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SALTS, has_rows, salted, unused_name, written


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """``doc_id, digest, keep_id, group_size, kept`` for each row of ``docs``."""
    spark = docs.sparkSession
    content = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = content.select("doc_id", digest(F.col("text")).alias("digest"), salted(F.col("doc_id"), salts=salts).alias("salt"), "text")
    merged = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    # dealt by digest alone: the groups of (digest, text) and then of digest need no further exchange
    whole = merged.repartition("digest").groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
    by_digest = whole.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.flatten(F.collect_list("salts")).alias("salts"), F.count("*").alias("texts"))
    found, _ = written(by_digest, "digests")
    single = found.where("texts = 1").select("digest", "keep_id", "group_size", F.explode("salts").alias("salt"))
    thin = rows.select("doc_id", "digest", "salt")
    out = thin.join(single, ["digest", "salt"])
    clashes = found.where("texts > 1").select("digest")
    if has_rows(clashes):
        apart = whole.join(clashes, "digest", "left_semi").select("digest", "text", "keep_id", "group_size", F.explode(F.array_distinct("salts")).alias("salt"))
        told = rows.join(apart, ["digest", "salt", "text"])
        out = out.unionByName(told.select(out.columns))
    return out.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay; of rows that repeat doc_id and text, one."""
    groups, _ = written(exact_groups(docs, id_col, text_col, salts).select("doc_id", "digest", "kept"), "decisions")
    own, gone_id, gone_digest = (unused_name(docs.columns, c) for c in ("digest", "gone", "gone_digest"))
    gone = groups.where("not kept").select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest)).distinct()
    left = docs.withColumn(own, sha256(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    left = left.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_digest)), "left_anti")
    if has_rows(groups.where("kept").groupBy("doc_id", "digest").count().where("count > 1")):
        left = left.dropDuplicates([id_col, own])
    return left.drop(own)
