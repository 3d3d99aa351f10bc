"""Exact deduplication by skew-safe combining.

The normalised text itself is the grouping key of every stage, beside its SHA-256 digest, so texts are equal only if
their full contents are:

1. locally: Spark's partial aggregation merges equal texts inside each task, before anything is sent;
2. by salted digest group: what is left of a group goes to ``salts`` reducers, each task to one of them, so a group
   with a third of all rows never meets in one task;
3. globally: at most ``salts`` winners of each text are combined.

The members of a group are never gathered: every document looks its winner up by digest, in a join that broadcasts the
few hot digests (fewer than 1000 by counting) and shuffles 40-byte rows for the rest. A digest that two different texts
share would be looked up by its full text instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def normalized(column: str = "text"):
    """Each run of white space as one space; null counts as empty."""
    return F.regexp_replace(common.text_or_empty(column), common.SPACES, " ")


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per distinct text: (digest, content, keep_id, group_size)."""
    keyed = docs.select(F.col(id_col).alias("id"), normalized(text_col).alias("content"))
    keyed = keyed.select("id", "content", F.sha2("content", 256).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    salted = keyed.groupBy("digest", "content", "salt").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 (replaced if present).

    The row with the smallest id of each group of equal texts is kept; rows that repeat that id are all marked kept.
    Null ids: a null loses against any id; in a group of null ids only, keep_id is null and its rows are kept. Null
    texts count as empty; texts of any length are compared whole. Other columns pass, whatever their names. Empty table:
    empty result.
    """
    out_names = ["keep_id", "group_size", "kept", "text_sha256"]
    rest = [c for c in docs.columns if c not in out_names]
    digest = common.fresh_name(docs.columns, "digest")
    first = common.fresh_name(docs.columns, "first_id")
    size = common.fresh_name(docs.columns, "size")
    members = common.fresh_name(docs.columns, "members")
    texts = common.fresh_name(docs.columns, "texts")
    found = winners(docs, id_col, text_col, salts)
    by_digest = common.materialize(
        found.groupBy("digest").agg(
            F.min("keep_id").alias(first),
            F.max("group_size").alias(size),
            F.sum("group_size").alias(members),
            F.count(F.lit(1)).alias(texts),
        ).withColumnRenamed("digest", digest),
        "dedup",
        release=True,
    )
    total, most = by_digest.agg(F.sum(members), F.max(texts)).first()
    marked = docs.select(*rest, F.sha2(normalized(text_col), 256).alias(digest))
    if (most or 1) == 1:
        one = common.lookup_join(marked, by_digest.drop(texts), [digest], members, total or 0)
    else:  # two texts share a digest: look these up by their full content
        content = common.fresh_name([*docs.columns, first, size], "content")
        full = found.select(F.col("digest").alias(digest), F.col("content").alias(content), F.col("keep_id").alias(first), F.col("group_size").alias(size))
        one = marked.withColumn(content, normalized(text_col)).join(full, [digest, content], "left").drop(content)
    return one.select(
        *rest,
        F.col(first).alias("keep_id"),
        F.col(size).cast("long").alias("group_size"),
        F.col(id_col).eqNullSafe(F.col(first)).alias("kept"),
        F.col(digest).alias("text_sha256"),
    )


def query(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def stage(spark, docs, sf_dir):
    """Pipeline stage: keeps the first document of each group of equal texts, and rows that repeat its id, as
    ``exact_groups`` marks them; nulls, long texts and other columns as there."""
    out = exact_groups(docs)
    return out.filter("kept").select(*docs.columns)


ORACLE = """
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
