"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, bands, weighted Jaccard.

1. Document frequencies of word shingles are counted over all documents in a
   hashed feature table of fixed size (the usual hashing-TF-IDF layout), which
   is small enough to broadcast at any corpus size.
2. Each distinct document gets ``bands * rows`` samples by consistent weighted
   sampling: a shingle that occurs n times is n occurrences of the weight of
   its inverse document frequency, but of no more than is usual in the
   document, and a sample is the occurrence that comes first when each waits
   an exponential time at the rate of its weight, fixed by the hashes of the
   shingle, the occurrence's number and the sample.  All samples are drawn
   over all occurrences, independently, so two documents agree in a sample
   with a probability of at least their weighted Jaccard similarity.
3. Documents that agree in all samples of a band share a bucket.  Those that
   hold too little in common with all other candidates together are out of reach
   of the threshold and leave.  Within the buckets, pivots are compared with
   the members that are not known to be connected with them, until each
   bucket's members are all connected or all compared.  No pair is given up
   unless an exact bound rules the link out, and a large group of near copies
   mostly costs one comparison a member.
4. A compared pair is a link if its weighted Jaccard similarity, computed over
   all shingles, reaches the threshold.  Classes are the connected components.

Texts with the same shingles (same words) are one node, so exact copies are
never compared with each other.

Defined results: a null or empty text, or one without words, is a class of its
own; a text of fewer than five words is one shingle; repeated rows are members
like others; the representative is the smallest id of a class (null if all its
ids are null); an empty table gives an empty result; extra columns are not read
by ``classes`` and returned unchanged by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import stage
from .words import hashed_words, mix, seeded, shingles

_U = np.uint64


@dataclass(frozen=True)
class Params:
    """Shingle size in words, similarity threshold, bands, samples per band, size of the frequency table (power of 2).

    20 bands of 4 miss a pair at the threshold of 0.8 with a probability of 3e-5.
    """

    words: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 4
    buckets: int = 1 << 22

    @property
    def samples(self) -> int:
        return self.bands * self.rows


#: Rows of an Arrow batch that are worked on together.
_SLICE = 256
#: Parts in which tables of fixed size travel.
_PARTS = 64
#: Cells in which the weight that two bags can have in common is bounded.
_CELLS = 32
#: Bits of the table that tells candidates' texts from others.
_BITS = 1 << 24


def _bags(texts: pa.Array, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingles in ascending order and their counts."""
    for at in range(0, len(texts), _SLICE):
        part = texts.slice(at, _SLICE)
        rows, found = shingles(*hashed_words(part), p.words)
        bounds = np.searchsorted(rows, np.arange(len(part) + 1))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            yield np.unique(found[lo:hi], return_counts=True)


# --- document frequencies

def _count_table(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(p.buckets, np.uint32)
        for batch in batches:
            for found, _ in _bags(batch.column(0), p):
                np.add.at(table, (found & _U(p.buckets - 1)).astype(np.int64), np.uint32(1))  # no other table beside it
        for k, part in enumerate(np.split(table, _PARTS)):
            kind = np.min_scalar_type(int(part.max(initial=0)))
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()),
                                              "width": pa.array([kind.itemsize], pa.int32()),
                                              "counts": pa.array([part.astype(kind).tobytes()], pa.binary())})

    return run


def _add_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["counts"], f"<u{row['width']}").astype(np.int64)
            total[row["part"]] = total[row["part"]] + counts if row["part"] in total else counts
    for k, counts in total.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()),
                                          "counts": pa.array([counts.tobytes()], pa.binary())})


def idf_table(texts: DataFrame, p: Params) -> np.ndarray:
    """Inverse document frequencies by hashed shingle, over all rows of the one-column frame ``texts``.

    What reaches the driver is the summed table: ``8 * p.buckets`` bytes at any input size.
    """
    partial = texts.mapInArrow(_count_table(p), "part int, width int, counts binary")
    summed = partial.repartition(_PARTS, "part").mapInArrow(_add_tables, "part int, counts binary")
    n = texts.count()
    idf = np.empty(p.buckets, np.float32)
    idf[:] = np.log(n + 1.0) + 1.0
    size = p.buckets // _PARTS
    for row in stage(summed, "frequencies").toLocalIterator():  # one part at a time
        df = np.minimum(np.frombuffer(row["counts"], np.int64), n)
        idf[row["part"] * size:(row["part"] + 1) * size] = np.log((n + 1) / (df + 1.0)) + 1.0
    return idf


#: Weights of occurrences are multiples of one over this, so that sums of them are exact in any order.
_STEPS = 4096


def weights(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights in which no shingle counts for rarer than is usual in its document.

    The unit is the interquartile mean of the inverse document frequencies of
    the document's distinct shingles, so that a line does not become usual by
    being repeated.  A shingle that is more common than usual weighs less than
    one, others weigh one.  In a large group of copies the frequencies of the
    shared shingles grow with the group; without this bound the few changed
    words would outweigh them, and the group would fall apart.
    """
    rare = idf[(found & _U(len(idf) - 1)).astype(np.int64)].astype(np.float64)
    n = len(rare)
    if not n:
        return rare
    inner = np.diff(np.clip(np.arange(n + 1), n * 0.25, n * 0.75))  # the middle half, with parts of a shingle
    usual = (inner * np.sort(rare)).sum() / (n * 0.5)
    return counts * (np.rint(np.minimum(rare / usual, 1.0) * _STEPS) / _STEPS)


# --- consistent weighted sampling

_LOW = _U(0xFFFFFFFF)


def _unit(x: np.ndarray, high: bool) -> np.ndarray:
    """Numbers in (0, 1) from one half of 64-bit hashes."""
    half = x >> _U(32) if high else x & _LOW
    return (half.astype(np.float64) + 0.5) * 2.0 ** -32


_SEEDS = seeded(21, 8) | _U(1)
#: Draws of one document that are worked on together.
_DRAWS = 1 << 15


def signature(found: np.ndarray, weight: np.ndarray, samples: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The samples of one document; ``counts`` (1 if not given) are the shingles' occurrences.

    A shingle weighs the same for each of its occurrences in a document, which
    are numbered per shingle.  In each sample every occurrence waits an
    exponential time at the rate of its weight, and the first one is the sample:
    two documents agree with a probability of their weighted Jaccard similarity
    if they give what they share the same weights, of more if they do not, and
    samples are independent.
    """
    if not len(found):
        return np.zeros(samples, _U)
    counts = np.ones(len(found), np.int64) if counts is None else counts
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = mix(np.repeat(found, counts) + number.astype(_U) * _SEEDS[0])
    scale = np.repeat(counts / weight, counts)
    seeds = seeded(23, -(-samples // 2))
    out = np.empty((len(seeds), 2), _U)
    step = max(1, _DRAWS // len(keys))
    for k in range(0, len(seeds), step):
        x = mix(keys[None, :] ^ seeds[k:k + step, None])
        for half in (0, 1):  # a hash has two draws
            out[k:k + step, half] = keys[(np.log(_unit(x, half == 0)) * scale).argmax(axis=1)]
    return out.ravel()[:samples]


def band_keys(samples: np.ndarray, p: Params) -> np.ndarray:
    """One key per band."""
    factors = seeded(22, p.rows) | _U(1)
    joined = (samples.reshape(p.bands, p.rows) * factors).sum(axis=1, dtype=_U)
    return mix(joined + np.arange(p.bands, dtype=_U) * _SEEDS[6])


def fingerprint(found: np.ndarray, counts: np.ndarray) -> bytes:
    """128 bits that stand for a bag of shingles."""
    n = counts.astype(_U)
    return np.array([mix(found * _SEEDS[6] + n).sum(dtype=_U), mix(found * _SEEDS[7] ^ n).sum(dtype=_U)], _U).tobytes()


def weighted_jaccard(found_a: np.ndarray, weight_a: np.ndarray, found_b: np.ndarray, weight_b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weights of two bags of distinct shingles."""
    _, at, to = np.intersect1d(found_a, found_b, assume_unique=True, return_indices=True)
    least = np.minimum(weight_a[at], weight_b[to]).sum()
    most = weight_a.sum() + weight_b.sum() - least
    return float(least / most) if most else 0.0


#: Room for rounding in bounds on similarities.
_SLACK = 1e-6


# --- Spark jobs

def _signatures(p: Params, idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            prints, keys = [], []
            for found, counts in _bags(batch.column(1), p):
                if not len(found):
                    prints.append(None)
                    keys.append(None)
                    continue
                prints.append(fingerprint(found, counts))
                samples = signature(found, weights(found, counts, table), p.samples, counts)
                keys.append(band_keys(samples, p).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "node", "keys"])

    return run


def _bag_rows(p: Params, idf, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = idf.value, bits.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            texts = batch.column(1).filter(pa.array((wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            bags = ((fingerprint(f, c), f.view(np.int64), weights(f, c, table).astype(np.float32))
                    for f, c in _bags(texts, p) if len(f))
            while some := list(islice(bags, _SLICE)):
                node, found, weight = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(found, pa.list_(pa.int64())),
                                                  pa.array(weight, pa.list_(pa.float32()))], ["node", "found", "weight"])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(_BITS // 8, np.uint8)
    for batch in batches:
        at = batch.column(0).to_numpy()
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
    for k, part in enumerate(np.split(table, _PARTS)):
        if part.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "bits": pa.array([part.tobytes()])})


def _add_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(row["bits"], np.uint8)
            total[row["part"]] = total[row["part"]] | part if row["part"] in total else part
    for k, part in total.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "bits": pa.array([part.tobytes()])})


def _place(column) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(_BITS))


def candidate_bits(ids: DataFrame) -> np.ndarray:
    """One bit per hash place, set for the ids of the one-column frame; ``_BITS / 8`` bytes at any input size."""
    marks = ids.select(_place(F.col(ids.columns[0])).alias("at")).mapInArrow(_mark, "part int, bits binary")
    table = np.zeros(_BITS // 8, np.uint8)
    size = len(table) // _PARTS
    for row in marks.repartition(_PARTS, "part").mapInArrow(_add_marks, "part int, bits binary").collect():
        table[row["part"] * size:(row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return table


def _values(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        side = [[batch.column(f"{name}_{s}") for name in ("found", "weight")] for s in "ab"]
        sims = [weighted_jaccard(*[_values(column, k) for columns in side for column in columns])
                for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())],
                                         ["a", "b", "similarity"])


def _within_reach(bags: DataFrame, p: Params) -> DataFrame:
    """(node, total, common, cells) of the nodes that can have a link at all.

    ``common`` is the weight of the shingles that some other candidate holds as
    well, ``cells`` what of it falls into each of ``_CELLS`` hash cells.  A
    similarity is at most the smaller ``common`` over the larger ``total``, so a
    node with less than the threshold in common has no link.
    """
    each = (bags.select(F.xxhash64("node").alias("n64"), F.explode(F.arrays_zip("found", "weight")).alias("x"))
            .select("n64", "x.found", "x.weight"))
    several = each.groupBy("found").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("found")
    cell = F.shiftrightunsigned("found", 40) % _CELLS
    sums = [F.sum(F.when(F.col("cell") == k, F.col("weight")).otherwise(0.0)).alias(f"c{k}") for k in range(_CELLS)]
    common = (each.join(several, "found", "left_semi").select("n64", "weight", cell.alias("cell")).groupBy("n64").agg(*sums)
              .select("n64", F.array(*[f"c{k}" for k in range(_CELLS)]).alias("cells")))
    added = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x)
    common = common.select("n64", added.alias("common"), F.col("cells").cast("array<float>").alias("cells"))
    total = F.aggregate("weight", F.lit(0.0), lambda s, x: s + x)
    return (bags.select("node", F.xxhash64("node").alias("n64"), total.alias("total")).join(common, "n64").drop("n64")
            .where(F.col("common") >= F.col("total") * (p.threshold - _SLACK)))


def _pivots(members: DataFrame, splits: int) -> DataFrame:
    """(key, pivots) of the buckets that hold several components; members have key, keys, shade, node, label, total, common, cells.

    A bucket is split ``splits`` times by hash; each part offers a node of its
    smallest and one of its largest label, so that a few strangers in a large
    group soon come up.  In the first round (``splits`` is 0) all labels differ
    and one pivot will do, the same for bands of one shade.  All are partial
    aggregates: a large bucket meets in no task.
    """
    pivot = ("node", "label", "total", "common", "cells", "keys")
    if not splits:
        one = F.min(F.struct(F.xxhash64("node", "shade").alias("order"), *pivot))
        return (members.groupBy("key").agg(one.alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
                .select("key", F.array(F.struct(*[f"p.{c}" for c in pivot])).alias("pivots")))
    order = F.xxhash64("key", "node")
    entry = F.struct("label", order.alias("order"), "node", "total", "common", "cells", "keys")
    parts = members.groupBy("key", F.pmod(order, F.lit(splits)).alias("part")).agg(
        F.min(entry).alias("lo"), F.max(entry).alias("hi"))
    both = [F.collect_list(F.struct(*[f"{x}.{c}" for c in pivot])).alias(f"{x}s") for x in ("lo", "hi")]
    return (parts.groupBy("key").agg(F.min("lo.label").alias("least"), F.max("hi.label").alias("most"), *both)
            .where("least <> most").select("key", F.array_union("los", "his").alias("pivots")))


def find_links(signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, p: Params, idf) -> DataFrame | None:
    """(node, root) of the nodes that are linked with a smaller one; None if there are none."""
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    placed = nodes.select("node", "id", F.posexplode("keys").alias("band", "key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    placed = stage(placed.join(shared, "key", "left_semi").select("key", (F.col("band") % 4).alias("shade"), "node", "id"),
                   "buckets")
    bits = docs.sparkSession.sparkContext.broadcast(candidate_bits(placed.select("id")))
    texts = docs.select(_place(F.col(id_col)).alias("at"), F.col(text_col).alias("text"))
    bags = stage(texts.mapInArrow(_bag_rows(p, idf, bits), "node binary, found array<bigint>, weight array<float>")
                 .dropDuplicates(["node"]), "bags")
    bits.destroy()
    members = stage(placed.drop("id").join(_within_reach(bags, p), "node").join(
        signed.where("node IS NOT NULL").groupBy("node").agg(F.first("keys").alias("keys")), "node"), "members")
    # an intersection is at most the smaller common weight, in each cell as well, and t / (1 + t) of both totals in a link
    enough = f"(x.total + total) * {p.threshold / (1 + p.threshold) - _SLACK}D"
    reach = f"x.label <> label AND least(x.common, common) >= {enough}"
    cells = f"aggregate(zip_with(x.cells, cells, (i, j) -> least(i, j)), 0D, (s, i) -> s + i) >= {enough}"
    # after the first round a pair is the business of the first band in which it agrees, where it comes up
    # as long as that bucket is open
    first = "array_position(zip_with(keys, x.keys, (i, j) -> i = j), true) = array_position(keys, key)"
    roots, splits = None, 0
    while True:
        label = F.col("node")
        if roots is not None:
            members, label = members.join(roots, "node", "left"), F.coalesce("root", "node")
        labelled = members.withColumn("label", label).drop("root")
        pivots = stage(_pivots(labelled, splits), "pivots")
        if pivots.isEmpty():
            return roots
        open_ = labelled.join(pivots, "key")
        close = F.expr(f"filter(pivots, x -> {reach}{f' AND {first}' if splits else ''} AND {cells})")
        pairs = (open_.select("node", F.explode(close).alias("pivot"))
                 .select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct())
        if splits <= 8:  # later rounds are about ever fewer nodes
            bags = stage(bags.join(open_.select("node").distinct(), "node", "left_semi"), "bags")
        left, right = (bags.select(F.col("node").alias(s), F.col("found").alias(f"found_{s}"),
                                   F.col("weight").alias(f"weight_{s}")) for s in "ab")
        judged = stage(pairs.join(left, "a").join(right, "b")
                       .mapInArrow(_similar, "a binary, b binary, similarity double"), "compared")
        links = judged.where(F.col("similarity") >= p.threshold).select("a", "b")
        # pivots have met every member with another label
        members = stage(open_.where(~F.exists("pivots", lambda x: x.node == F.col("node")))
                        .drop("label", "pivots").withColumn("shade", F.lit(0)), "members")
        if not links.isEmpty():
            known = links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"),
                                                                               F.col("root").alias("b")))
            roots = components(known)
        splits = max(8, 16 * splits)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class), class_size, kept."""
    spark, p = docs.sparkSession, params
    idf = spark.sparkContext.broadcast(idf_table(docs.select(F.col(text_col)), p))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = stage(rows.mapInArrow(_signatures(p, idf), f"id {kind}, node binary, keys array<bigint>"), "signatures")
    roots = find_links(signed, docs, id_col, text_col, p, idf)
    idf.destroy()  # all that read it is stored
    placed = signed.select("id", "node")
    if roots is None:
        placed = placed.withColumn("root", F.col("node"))
    else:
        placed = placed.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    groups = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("class_id"),
                                                                   F.count(F.lit(1)).alias("class_size"))
    out = placed.join(groups, "root", "left")
    return out.select(F.col("id").alias(id_col),
                      F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("class_size", F.lit(1)).alias("class_size"),
                      (F.col("root").isNull() | F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     params: Params = Params()) -> DataFrame:
    """``docs`` without the documents that represent no class; rows that share an id go or stay together."""
    found = stage(classes(docs, id_col, text_col, params), "classes")
    gone = found.groupBy(F.col(id_col).alias("gone_id")).agg(F.max("kept").alias("stays")).where("NOT stays")
    return docs.join(gone, docs[id_col].eqNullSafe(gone.gone_id), "left_anti")
