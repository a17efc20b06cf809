"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import join_groups, keep


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 prefix_bytes: int = 64, sieve: int = 1 << 18, digest: bool = False) -> DataFrame:
    """Which document of each group of equal texts stays: (doc_id, keep_id, group_size, kept).

    Texts are equal when their bytes are; null counts as ''. The largest id of a group stays. Each
    step reads more of fewer texts: lengths are grouped first; texts whose length occurs twice get
    a prefix hash; those whose (length, prefix) occurs twice get the full SHA-256. Between the
    steps only the set of surviving hash buckets travels, at most `sieve` longs, so its broadcast
    is bounded whatever the input; a bucket that holds two keys only costs further hashing.

    One row a row of `docs`, judged by its own text whatever other texts its id has. Any other
    columns are ignored. A null id is smaller than every other and, being no id, stays only in a
    group without ids. Rows that repeat an id with one text are one document and share its
    verdict; `group_size` counts rows. With `digest` each row also has the hexadecimal SHA-256 of
    its text as `text_sha256`, for which the texts settled early are hashed too.
    """
    single, groups = _judged(docs, doc_id, text, prefix_bytes, sieve, digest)
    more = [F.lower(F.hex("_full")).alias("text_sha256")] if digest else []
    return single.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), *more).unionByName(groups.select("doc_id", "keep_id", "group_size", "kept", *more))


def _judged(docs: DataFrame, doc_id: str, text: str, prefix_bytes: int, sieve: int,
            digest: bool) -> tuple[DataFrame, DataFrame]:
    """The rows that the sieves settle, (doc_id, _full), and the others by their groups, also with
    their length, keep_id, group_size and kept."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_body")).withColumn(
        "_length", F.octet_length("_body").cast("long"))

    def repeated(df: DataFrame, bucket: str) -> DataFrame:
        return F.broadcast(keep(df.groupBy(bucket).count().where("count > 1").select(bucket, F.lit(True).alias(f"{bucket}_hit"))))

    by_length = F.pmod(F.xxhash64("_length"), F.lit(sieve)).alias("_b1")
    by_prefix = F.pmod(F.xxhash64("_length", "_prefix"), F.lit(sieve)).alias("_b2")
    lengths = repeated(rows.select(by_length), "_b1")
    prefixed = rows.select("*", by_length).join(lengths, "_b1", "left").select(
        "doc_id", "_length", "_body",
        F.when(F.col("_b1_hit"), F.xxhash64(F.substring("_body", 1, prefix_bytes))).alias("_prefix"))
    prefixes = repeated(prefixed.where("_prefix is not null").select(by_prefix), "_b2")
    sieved = prefixed.select("*", F.when(F.col("_prefix").isNotNull(), by_prefix).alias("_b2")).join(prefixes, "_b2", "left")
    full = F.unhex(F.sha2("_body", 256))
    hashed = keep(sieved.select("doc_id", "_length", "_prefix", F.col("_b2_hit").isNotNull().alias("_open"),
                                (full if digest else F.when(F.col("_b2_hit"), full)).alias("_full")))

    keys = ["_length", "_prefix", "_full"]
    open_ = hashed.where("_open")
    groups = open_.groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return hashed.where("not _open"), join_groups(open_, keep(groups), keys, "group_size").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    groups = _judged(docs, "doc_id", "text", 64, 1 << 18, False)[1]
    gone = groups.where("not kept").select(
        F.col("doc_id").alias("_gone"), F.col("_length").alias("_size"), F.col("_full").alias("_hash"))
    body = F.coalesce(docs["text"], F.lit("")).cast("binary")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.octet_length(body) == gone["_size"])
                     & (F.unhex(F.sha2(body, 256)) == gone["_hash"]), "left_anti")
