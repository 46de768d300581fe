"""Exact deduplication with a heavy-hitter split.

Frequent texts are found by Misra-Gries summaries of the SHA-256 digests, one
summary per task.  The exact winner and size of each frequent digest are then
aggregated (partial sums per task), verified by that recount, and broadcast:
rows of frequent texts are settled on the map side and never shuffled.  All
other digests occur at most ``2 * rows / capacity`` times and use an ordinary
shuffle on the digest.

Defined results
- a null text counts as the empty text; so all null and empty rows are one group;
- of equal texts the row with the largest id stays; a null id loses to any other;
- repeated rows (same id and text) are rows of the group like others; exactly one row of a group
  is kept, also if several carry the winning id;
- an empty table gives an empty result; extra columns are ignored by ``assign`` and returned
  unchanged by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .storage import stage

#: Counters per Misra-Gries summary, and so the largest number of broadcast winners.
CAPACITY = 1024


def shrink(counters: dict[bytes, int], capacity: int) -> dict[bytes, int]:
    """Reduce a summary to ``capacity`` counters; every estimate falls by the same amount.

    The amount is the (capacity + 1)-th largest count, so the total error of a
    summary over n rows stays below n / (capacity + 1).
    """
    if len(counters) <= capacity:
        return counters
    cut = sorted(counters.values(), reverse=True)[capacity]
    return {k: c - cut for k, c in counters.items() if c > cut}


def _summarise(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[bytes, int] = {}
        for batch in batches:
            counts = pc.value_counts(batch.column(0))
            for digest, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()):
                counters[digest] = counters.get(digest, 0) + n
            counters = shrink(counters, capacity)
        yield pa.RecordBatch.from_pydict({
            "digest": pa.array(list(counters), pa.binary()),
            "n": pa.array(list(counters.values()), pa.int64()),
        })

    return run


def text_digest(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def frequent_digests(rows: DataFrame, capacity: int, n_rows: int) -> DataFrame:
    """At most ``capacity`` digests, among them each that occurs ``2 * n_rows / capacity`` times or more.

    The counters of all summaries add up to ``n_rows`` at most, so no more than
    ``capacity`` of them can reach ``n_rows / capacity``; a digest loses at
    most that much to all summaries together.
    """
    return (rows.select("digest").mapInArrow(_summarise(capacity), "digest binary, n bigint")
            .groupBy("digest").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= F.lit(max(2, -(-n_rows // capacity)))).select("digest"))


def winners_of_frequent(rows: DataFrame, capacity: int) -> DataFrame:
    """(digest, win, size) of the frequent digests, recounted exactly; at most ``capacity`` rows."""
    spark = rows.sparkSession
    n_rows = rows.count()
    found = frequent_digests(rows, capacity, n_rows)
    exact = (rows.join(F.broadcast(found), "digest").groupBy("digest")
             .agg(F.max(F.struct("id", "rid")).alias("win"), F.count(F.lit(1)).alias("size"))
             .where("size > 1"))
    return spark.createDataFrame(exact.collect(), exact.schema)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rid, digest) of every row, stored once so that ``rid`` keeps naming the same row."""
    return stage(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"),
                             text_digest(F.col(text_col)).alias("digest")), "digests")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = _numbered(docs, id_col, text_col)
    heavy = winners_of_frequent(rows, capacity)
    tagged = rows.join(F.broadcast(heavy), "digest", "left")
    group = Window.partitionBy("digest")
    rest = (tagged.where("size IS NULL").select("id", "rid", "digest")
            .withColumn("win", F.max(F.struct("id", "rid")).over(group))
            .withColumn("size", F.count(F.lit(1)).over(group)))
    both = tagged.where("size IS NOT NULL").select(*rest.columns).unionByName(rest)
    return both.select(F.col("id").alias(id_col), F.col("win.id").alias("keep_id"),
                       F.col("size").alias("group_size"), (F.col("rid") == F.col("win.rid")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY) -> DataFrame:
    """``docs`` without copies: of equal texts the row with the largest id, all columns unchanged.

    Rows of frequent texts other than the winner's are removed before the only
    shuffle of whole rows.
    """
    heavy = winners_of_frequent(_numbered(docs, id_col, text_col), capacity)
    heavy = heavy.select("digest", F.col("win.id").alias("win_id"))
    inner = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = (docs.select(row.alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"))
            .join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "digest", "left")
            .where("heavy IS NULL OR id <=> win_id"))
    tie = F.struct("id", F.xxhash64(*[F.col(f"row.{f.name}") for f in inner.fields]))
    one = rows.groupBy("digest").agg(F.max_by("row", tie).alias("row"))
    return one.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
