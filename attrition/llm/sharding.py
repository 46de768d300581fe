"""Shards by extendible hashing.

A document's key is a hash of its id.  The directory is indexed by the first
bits of the key; a bucket that holds more than the byte limit is split on its
next bit, the others keep their shorter prefix.  So the bytes of all prefixes
are summed level by level, and a document's shard is the shortest prefix of its
key whose bucket fits.

Buckets of more depth than the directory are split further among their own
documents only; behind the id's bits come those of the row's number, so rows
that repeat an id can be parted as well.

Defined results: a null text has no bytes; a null id is hashed like the text
``null``; a document larger than the limit is a shard of its own; an empty
table gives an empty result; other columns are not read by ``assign`` and
written unchanged by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage

#: Largest size of a shard.
MAX_BYTES = 64 << 20
#: Bits of one word of a key.
BITS = 60


def key_word(column) -> F.Column:
    """The first 60 bits of the MD5 digest of a text."""
    return F.conv(F.substring(F.md5(column), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: F.Column) -> F.Column:
    """The first ``depth`` bits of (key, more) as a text of zeros and ones."""
    bits = F.concat(F.lpad(F.bin("key"), BITS, "0"), F.lpad(F.bin("more"), BITS, "0"))
    return F.substring(bits, F.lit(1), depth)


def directory(rows: DataFrame, max_bytes: int, depth: int) -> DataFrame:
    """(cell, depth): for each prefix of ``depth`` bits the length of its bucket's prefix.

    ``depth + 1`` where the bucket is still too large.
    """
    cells = (rows.groupBy(F.shiftright("key", BITS - depth).alias("cell"))
             .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
    cells = stage(cells, "cells")
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    placed = (cells.select("cell", "bytes", "n", level)
              .withColumn("prefix", F.expr(f"shiftright(cell, {depth} - level)")))
    over = (placed.groupBy("level", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
            .where((F.col("bytes") > max_bytes) & (F.col("n") > 1)).select("level", "prefix"))
    split = placed.select("cell", "level", "prefix").join(over, ["level", "prefix"]).groupBy("cell").agg(
        F.count(F.lit(1)).cast("int").alias("depth"))  # a bucket's ancestors are all too large
    return cells.select("cell").join(split, "cell", "left").select("cell", F.coalesce("depth", F.lit(0)).alias("depth"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per input row: id, shard (bits of its prefix), doc_bytes, shard_bytes, shard_docs."""
    rows = stage(docs.select(F.col(id_col).alias("id"),
                             key_word(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("key"),
                             key_word(F.monotonically_increasing_id().cast("string")).alias("more"),
                             F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")), "keys")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(0, -(-total // max_bytes) - 1).bit_length() + 4)
    cell = F.shiftright("key", BITS - depth)
    placed = rows.join(directory(rows, max_bytes, depth), cell == F.col("cell")).drop("cell")
    done = placed.where(F.col("depth") <= depth)
    open_ = stage(placed.where(F.col("depth") > depth).drop("depth"), "open")
    while depth < 2 * BITS and not open_.isEmpty():
        depth += 1
        prefixed = open_.withColumn("prefix", _prefix(F.lit(depth)))
        over = (prefixed.groupBy("prefix").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
                .where((F.col("b") > max_bytes) & (F.col("n") > 1)).select("prefix"))
        fits = prefixed.join(over, "prefix", "left_anti") if depth < 2 * BITS else prefixed
        done = done.unionByName(stage(fits.drop("prefix").withColumn("depth", F.lit(depth)), "fits"))
        open_ = stage(prefixed.join(over, "prefix", "left_semi").drop("prefix"), "open")
    sharded = done.select("id", _prefix(F.col("depth")).alias("shard"), "bytes")
    sizes = sharded.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    return sharded.join(sizes, "shard").select(F.col("id").alias(id_col), "shard", F.col("bytes").alias("doc_bytes"),
                                               "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 max_bytes: int = MAX_BYTES, partitions: int = 200) -> None:
    """Write ``docs`` to ``path``, one folder ``shard=<bits>`` per shard. Ids are taken to be unique."""
    plan = assign(docs, id_col, text_col, max_bytes).select(F.col(id_col).alias("shard_id"),
                                                            F.concat(F.lit("b"), "shard").alias("shard"))
    (docs.join(plan, docs[id_col].eqNullSafe(plan.shard_id)).drop("shard_id")
     .repartition(partitions, "shard").write.partitionBy("shard").parquet(path))
