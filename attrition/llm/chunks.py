"""Documents in id order, packed into chunks of a few megabytes for array work inside tasks.

A chunk is one row: its number, the ids of its documents, the byte lengths of
their texts, and the texts as one compressed block.  Chunk numbers rise with
the order of the documents, so "earlier" needs no more than (chunk, place in
the chunk).  A chunk is never cut: every pass that opens it sees the same words
at the same places.  A text longer than a chunk is a chunk of its own.

Documents are ordered by (id, hash of the text); null ids come first, a null
text is an empty one, and rows that agree in both id and text follow one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk is closed by the text that fills it to so many bytes.
CHUNK_BYTES = 4 << 20

SCHEMA = "chunk bigint, ids array<bigint>, sizes binary, raw bigint, block binary"
_ARROW = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("raw", pa.int64()),
                    ("block", pa.binary())])


def _row(number: int, ids: list[pa.Array], texts: list[pa.Array]) -> pa.RecordBatch:
    all_texts = pa.concat_arrays(texts)
    sizes = pc.binary_length(all_texts).to_numpy(zero_copy_only=False).astype("<i8")
    joined = "\n".join(all_texts.to_pylist()).encode("utf-8")
    block = pa.compress(joined, codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
         pa.array([sizes.tobytes()], pa.binary()), pa.array([len(joined)], pa.int64()),
         pa.array([block], pa.binary())], schema=_ARROW)


def pack(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk (see the module); lazily, so that the caller stores it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            column = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            lengths = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else []
            at = 0
            while at < len(column):
                done = int(lengths[at - 1]) if at else 0
                stop = min(len(column), 1 + int(np.searchsorted(lengths, done + chunk_bytes - held)))
                ids.append(batch.column(0).slice(at, stop - at))
                texts.append(column.slice(at, stop - at))
                held += int(lengths[stop - 1]) - done
                at = stop
                if held >= chunk_bytes:
                    yield _row(number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield _row(number, ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


class Chunk:
    """An opened chunk: ``data`` are the bytes of its texts, each text followed by a line feed."""

    def __init__(self, sizes: bytes, raw: int, block: bytes):
        joined = pa.decompress(block, decompressed_size=raw, codec="zstd", asbytes=True)
        self.data = np.frombuffer(joined + b"\n", np.uint8)
        self.ends = np.cumsum(np.frombuffer(sizes, "<i8") + 1) - 1
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])

    def texts(self) -> list[str]:
        data = self.data.tobytes()
        return [data[a:b].decode("utf-8") for a, b in zip(self.starts.tolist(), self.ends.tolist())]
