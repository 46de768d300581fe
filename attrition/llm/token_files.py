"""Token-id files: concatenated ids with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by id, encoded, and cut into
blocks of whole documents.  A block is one row of a Parquet file: its ids as
little-endian 16- or 32-bit integers, and the ends of its documents as an
Elias-Fano sequence (low bits packed, high parts in unary, the positions of
every 64th one as 32-bit select samples), about ``2 + log2(mean length)`` bits
a document.  Spark's commit protocol makes files of retried tasks whole.  A
block knows how many ids of its part come before it, so a reader only needs
the totals of the parts (one row per written partition) for global offsets.

Defined results: a null or empty text holds the end id alone; null ids come
first; rows that repeat an id follow one another in the order of a hash of their texts; special-token strings inside
texts are ordinary text; an empty table gives no blocks; extra columns are
never read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import UnitEncoder

#: A block ends with the document that fills it to so many ids.
BLOCK_IDS = 500_000

_EVERY = 64

BLOCK_SCHEMA = ("part int, block int, ids_before bigint, doc_ids array<bigint>, n_ids bigint, id_bytes int, "
                "ids binary, low_bits int, low binary, high binary, samples binary")


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.int64)
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        places = (values >> bits) + np.arange(n)
        high = np.zeros(n + (top >> bits) + 1, np.uint8)
        high[places] = 1
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        return cls(n, bits, pack(low), pack(high), places[::_EVERY].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(np.frombuffer(self.samples, "<u4")[i // _EVERY])
        left = i % _EVERY
        byte = place >> 3
        word = self.high[byte] >> (place & 7) << (place & 7)  # ones from the sample on
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        at = i * self.low_bits
        window = int.from_bytes(self.low[at >> 3:(at + self.low_bits + 7 >> 3)], "little") >> (at & 7)
        return high << self.low_bits | window & (1 << self.low_bits) - 1

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        high = ones - np.arange(self.n)
        if not self.low_bits:
            return high
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[:self.n * self.low_bits]
        return high << self.low_bits | low.reshape(self.n, self.low_bits) @ (1 << np.arange(self.low_bits))


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet by its rule: visible Latin-1 characters stand for themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _plain(form: dict) -> bool:
    """Whether a file splits texts by the usual pattern of byte-level vocabularies and changes nothing before."""
    before = form.get("pre_tokenizer") or {}
    return (before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not form.get("normalizer"))


@cache
def text_encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """Ids (little-endian 32-bit) of whole texts by the tokenizers library, per worker process.

    For a plain byte-level BPE file the library's model encodes the matches of
    the pre-split pattern, those of known units once; other files go through
    the library whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    if not _plain(form):
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    letters, tokenize = _byte_letters(), tokenizer.model.tokenize

    def piece(match: str) -> bytes:
        if match.isascii() and match.isprintable():  # of these only the space has another letter
            spelled = match.replace(" ", letters[0x20])
        else:
            spelled = match.encode("utf-8").decode("latin-1").translate(letters)
        return array("I", [t.id for t in tokenize(spelled)]).tobytes()

    return UnitEncoder(piece, pattern)


def _block(part: int, block: int, before: int, doc_ids: list, pieces: list[bytes], end_id: int) -> dict:
    ids = np.frombuffer(b"".join(pieces), "<u4")
    ends = np.cumsum([len(p) // 4 for p in pieces])
    width = 2 if max(int(ids.max(initial=0)), end_id) < 1 << 16 else 4
    ef = EliasFano.encode(ends)
    return {"part": part, "block": block, "ids_before": before, "doc_ids": doc_ids, "n_ids": int(ends[-1]),
            "id_bytes": width, "ids": ids.astype(f"<u{width}").tobytes(), "low_bits": ef.low_bits, "low": ef.low,
            "high": ef.high, "samples": ef.samples}


def write_tokens(docs: DataFrame, path: str, encoder: Callable[[], Callable[[str], bytes]], end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, each followed by ``end_id``, to ``path`` in ascending id order.

    ``encoder`` makes, inside a task, the function from a text to its ids' bytes.
    """
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("id_bytes", pa.int32()),
                        ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()),
                        ("samples", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(), TaskContext.get().partitionId()
        block, before, held, doc_ids, pieces = 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_block(part, block, before, doc_ids, pieces, end_id)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                pieces.append(encode(text.as_py() or "") + end)
                doc_ids.append(doc_id.as_py())
                held += len(pieces[-1]) // 4
                if held >= block_ids:
                    yield flush()
                    block, before, held, doc_ids, pieces = block + 1, before + held, 0, [], []
        if pieces:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    (rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text")).mapInArrow(run, BLOCK_SCHEMA)
     .write.mode("errorifexists").parquet(path))


def _with_start(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the number of ids in all files before each block.

    Broadcast: one row per part, and there are no more parts than partitions
    of the writing job.
    """
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    return (blocks.join(F.broadcast(starts), "part")
            .withColumn("block_start", F.col("part_start") + F.col("ids_before")))


def _boundaries(row: dict) -> EliasFano:
    return EliasFano(len(row["doc_ids"]), row["low_bits"], row["low"], row["high"], row["samples"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as 32-bit integers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
                ends = _boundaries(row).decode()
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(starts + row["block_start"], pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64())})

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    return _with_start(blocks).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of single documents (doc_id, ids array<int>), found by select without decoding a block's boundaries."""
    wanted = set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ef, ids = _boundaries(row), np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
                hits = [k for k, d in enumerate(row["doc_ids"]) if d in wanted]
                spans = [ids[ef.select(k - 1) if k else 0:ef.select(k)] for k in hits]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([row["doc_ids"][k] for k in hits], pa.int64()),
                    "ids": pa.array([s.tolist() for s in spans], pa.list_(pa.int32()))})

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    near = F.exists("doc_ids", lambda d: d.isin(*wanted)) if wanted else F.lit(False)
    return blocks.where(near).mapInArrow(run, "doc_id bigint, ids array<int>")
