"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets.  Sources in code-point order (null last) take the weights in turn and
share the total size; a target stops at ``max_repeats`` times its source's size
and the excess goes to the others by weight.

Blocks.  The documents of a source are put in a random order fixed by their
hashes and cut into blocks of about ``block_words`` words.  A source's quota is
an exact number of blocks: all blocks as often as the target holds whole
passes, and the first blocks of one more pass, up to the first document that does not
fit.  Documents that do not fit are left out, and later ones fill the gap until none
that is left fits; a last one may go over the target if that comes nearer.  Where more
than the smallest document is still missing, a large document that did not fit behind
the others is taken before them.  These documents form blocks of their own behind
those of the last pass.

Tree.  The quotas are split recursively among the output shards: the left half
of a node's shards gets a multivariate-hypergeometric draw from the node's
blocks, the right half the rest.  Each draw is seeded by its node, so every
shard finds its counts, and the place where its blocks begin in each source's
permuted sequence of blocks, by walking down its own path.  So the shards'
blocks are disjoint and use up the quotas, and no task sees all shards.  Each
shard then shuffles its documents locally.

Defined results: size 0 for null, empty and blank texts; a null source is a
source of its own, the last; repeated rows (same id, text and source) are drawn
like different ones; an empty table gives an empty result; columns other than
id, text and source are not read, and returned unchanged by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stage

#: The characters between words are space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    """Weights by turns, largest repetition, shards, words of a block, seed.

    ``max_sources`` bounds the table of source totals that the driver sees and
    broadcasts; more sources are refused, not cut.  Blocks grow beyond
    ``block_words`` where there would be more than ``max_blocks`` in the mix.
    """

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    max_repeats: int = 3
    shards: int = 64
    block_words: int = 4096
    max_sources: int = 100_000
    max_blocks: int = 400_000_000
    seed: int = 17


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess is reshared by weight."""
    left, rest = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while rest:
        total = sum(weights[k] for k in rest)
        over = [k for k in rest if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in rest:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = most * float(sizes[k])
        left -= sum(out[k] for k in over)
        rest -= set(over)
    return out


def shard_counts(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of one shard in each source's sequence, by walking down the tree."""
    total = int(quotas.sum())
    before = lambda k: total * k // shards  # noqa: E731  blocks of the shards before the k-th
    lo, hi, start, left = 0, shards, np.zeros_like(quotas), quotas.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        half = rng.multivariate_hypergeometric(left, before(mid) - before(lo), method="marginals")
        if shard < mid:
            hi, left = mid, half
        else:
            lo, start, left = mid, start + half, left - half
    return start, left


def stride(n: int, seed: int) -> int:
    """A step that visits all of 0 .. n - 1, far from its neighbours."""
    a = max(1, int(n * 0.6180339887) + seed % 97) % n if n > 1 else 1
    while gcd(a, n) != 1:
        a = (a + 1) % n or 1
    return a


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, mark, source, size), stored once; ``mark`` tells rows of one id with different contents apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return stage(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col), F.col(source_col)).alias("mark"),
                             F.col(source_col).alias("source"),
                             F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")


def source_table(rows: DataFrame, p: Params) -> pd.DataFrame:
    """One row per source, in order: number, source, size, steps (words and documents), target."""
    found = (rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
             .orderBy(F.col("source").asc_nulls_last()).limit(p.max_sources + 1).collect())
    if len(found) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources")
    weight = [p.weights[k % len(p.weights)] for k in range(len(found))]
    goal = targets([r["size"] for r in found], weight, p.max_repeats)
    return pd.DataFrame({"number": range(len(found)), "source": [r["source"] for r in found],
                         "source_size": [r["size"] for r in found], "steps": [r["size"] + r["n"] for r in found],
                         "target": goal})


def permuted_blocks(rows: DataFrame, table: pd.DataFrame, p: Params) -> tuple[DataFrame, int]:
    """(number, id, mark, size, before, block) of every row, stored once, and the words of a block.

    ``before`` is the size of the source's documents that come earlier in its
    random order.  A document counts one word more for its block, so that
    empty ones fill blocks too.  The running sums are taken in hash ranges of
    some thousand rows, on top of the ranges' own running sums.
    """
    spark = rows.sparkSession
    block = max(p.block_words, int(table["steps"].sum() * (p.max_repeats + 1) // p.max_blocks) + 1)
    known = spark.createDataFrame([(int(n), s) for n, s in zip(table["number"], table["source"])],
                                  f"number int, known {rows.schema['source'].dataType.simpleString()}")
    bits = max(1, (rows.count() // 8192).bit_length())
    placed = (rows.join(F.broadcast(known), rows.source.eqNullSafe(known.known)).drop("source", "known")
              .withColumn("hash", F.xxhash64(F.lit(p.seed), "id", "mark"))
              .withColumn("range", F.shiftrightunsigned("hash", 64 - bits)))
    parts = placed.groupBy("number", "range").agg(F.sum("size").alias("words"),
                                                  F.sum(F.col("size") + 1).alias("steps"))
    earlier = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("number", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words0"),
                         F.coalesce(F.sum("steps").over(earlier), F.lit(0)).alias("steps0"))
    inside = (Window.partitionBy("number", "range").orderBy("hash", "id", "mark")
              .rowsBetween(Window.unboundedPreceding, -1))
    summed = (placed.withColumn("words1", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .withColumn("steps1", F.coalesce(F.sum(F.col("size") + 1).over(inside), F.lit(0))))
    out = summed.join(parts, ["number", "range"]).select(
        "number", "id", "mark", "size", (F.col("words0") + F.col("words1")).alias("before"),
        F.floor((F.col("steps0") + F.col("steps1")) / F.lit(block)).alias("block"))
    return stage(out, "blocks"), block


#: A document is in the first blocks of a source's last pass if it fits before the target.
IN_LAST_PASS = "(rest > 0 AND before + size <= rest)"


def _leading(free: DataFrame) -> DataFrame:
    """The documents that come first in their source's order and fit together into its ``gap``; ``words`` before each."""
    placed = free.withColumn("range", F.expr("block DIV 64"))
    earlier = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy("number", "range").agg(F.sum("size").alias("n"))
             .select("number", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("words0")))
    inside = Window.partitionBy("number", "range").orderBy("before").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("words0") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return placed.join(parts, ["number", "range"]).withColumn("words", words).where("words + size <= gap")


def fill_gaps(blocks: DataFrame, rest: dict[int, float], gap: dict[int, float], first: list[tuple],
              block: int) -> tuple[DataFrame, dict[int, int], dict[int, float], list]:
    """(documents that fill the gaps, with blocks -1, -2, ...; their words, what is missed then and, one row for
    each source that has it, the largest unused document within the rest), all by source.

    ``first`` holds documents (number, id, mark, size, before) that are taken in any case, behind ``rest``.

    In a round each source takes the largest unused document that fits, then
    the next ones of its order that fit together; so a document that does not
    fit is passed over, and the gap at least falls below the size of one that
    fitted before.  When nothing fits, the document that goes over the target
    least is taken if that comes nearer than the gap.  The driver sees one row
    per source and round.
    """
    spark = blocks.sparkSession
    columns = ["number", "id", "mark", "size", "before"]
    kind = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in columns) + ", block bigint"
    gap, words = dict(gap), dict.fromkeys(gap, 0)
    chosen = spark.createDataFrame([], kind)

    def free(sources: list[int], fits: str) -> DataFrame:
        gaps = spark.createDataFrame([(int(n), float(rest[n]), float(gap[n])) for n in sources],
                                     "number int, rest double, gap double")
        unused = blocks.join(F.broadcast(gaps), "number").where(f"size > 0 AND before + size > rest AND {fits}")
        return unused.join(chosen.select("number", "before"), ["number", "before"], "left_anti")

    def take(rows: list[tuple]) -> None:
        nonlocal chosen
        placed = []
        for n, ident, mark, size, before in rows:
            placed.append((n, ident, mark, size, before, -1 - words[n] // block))
            words[n] += size
        chosen = chosen.unionByName(spark.createDataFrame(placed, kind))

    def nearest(sources: list[int], fits: str) -> list:
        miss = F.abs(F.col("gap") - F.col("size")).alias("miss")
        best = F.min(F.struct(miss, "before", "mark", "id", "size")).alias("best")
        found = free(sources, fits).groupBy("number").agg(best, F.min("size").alias("least")).collect()
        take([(r["number"], r["best"]["id"], r["best"]["mark"], r["best"]["size"], r["best"]["before"]) for r in found])
        for r in found:
            gap[r["number"]] -= r["best"]["size"]
        return found

    take(first)
    left = [n for n in gap if gap[n] > 0]
    while left:
        left = [r["number"] for r in nearest(left, "size <= gap") if gap[r["number"]] >= r["least"]]
        if left:
            starts = spark.createDataFrame([(int(n), words[n]) for n in left], "number int, start bigint")
            more = _leading(free(left, "size <= gap")).join(F.broadcast(starts), "number")
            more = stage(more.select(*columns, F.expr(f"-1 - (start + words) DIV {block}").alias("block")), "fill")
            chosen = chosen.unionByName(more)
            for r in more.groupBy("number").agg(F.sum("size").alias("words")).collect():
                words[r["number"]] += r["words"]
                gap[r["number"]] -= r["words"]
    left, large = [n for n in gap if gap[n] > 0], []
    if left:
        entry = F.max(F.struct("size", "before", "mark", "id")).alias("best")
        large = free(left, "size <= rest").groupBy("number").agg(entry).collect()
        nearest(left, "size < 2 * gap")
    return stage(chosen, "fills"), words, {n: abs(g) for n, g in gap.items()}, large


def quotas(blocks: DataFrame, table: pd.DataFrame, block: int) -> tuple[pd.DataFrame, DataFrame]:
    """``table`` with passes, rest (words of the last pass without the documents that fill gaps), blocks of a pass,
    part (blocks up to the first document that does not fit into the rest) and quota; and the documents that fill gaps.

    The aggregates return one row per source.
    """
    spark = blocks.sparkSession
    size = table["source_size"].to_numpy(np.float64)
    passes = np.floor(np.divide(table["target"].to_numpy(), size, out=np.zeros(len(size)), where=size > 0))
    out = table.assign(passes=passes.astype(np.int64), rest=table["target"] - passes * size,
                       blocks=-(-table["steps"] // block))
    rest = {int(n): float(r) for n, r in zip(out["number"], out["rest"])}
    first: dict[int, list[tuple]] = {n: [] for n in rest}
    best: dict[int, dict] = {}
    tried: list[DataFrame] = []
    while rest:
        known = spark.createDataFrame(list(rest.items()), "number int, rest double")
        fits = F.expr("rest > 0 AND before + size <= rest")
        found = (blocks.join(F.broadcast(known), "number").groupBy("number")
                 .agg(F.max(F.when(fits, F.col("before") + F.col("size"))).alias("filled"),
                      (F.max(F.when(fits, F.col("block"))) + 1).alias("part"),
                      F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect())
        gap = {r["number"]: rest[r["number"]] - (r["filled"] or 0) for r in found}
        fills, words, miss, large = fill_gaps(blocks, rest, gap, [x for n in gap for x in first[n]], block)
        better = [r for r in found if r["number"] not in best or miss[r["number"]] < best[r["number"]]["miss"]]
        for r in better:
            n = r["number"]
            best[n] = {"miss": miss[n], "rest": rest[n], "part": r["part"] or 0, "more": -(-words[n] // block),
                       "tried": len(tried)}
        tried.append(fills)
        # where more than a document is missing, a large one goes before the others
        again = {r["number"] for r in better if r["least"] and miss[r["number"]] > r["least"]}
        rest = {n: r for n, r in rest.items() if n in again}
        pinned = {r["number"]: r["best"] for r in large if r["number"] in again}
        for n, x in pinned.items():
            first[n].append((n, x["id"], x["mark"], x["size"], x["before"]))
            rest[n] -= x["size"]
        rest = {n: rest[n] for n in pinned}
    for name in ("rest", "part", "more"):
        out[name] = [best[n][name] for n in out["number"]]
    fills = blocks.select("number", "id", "mark", "size", "before", "block").limit(0)
    for k, frame in enumerate(tried):
        chosen = spark.createDataFrame([(int(n),) for n, x in best.items() if x["tried"] == k], "number int")
        fills = fills.unionByName(frame.join(F.broadcast(chosen), "number", "left_semi"))
    return out.assign(quota=out["passes"] * out["blocks"] + out["part"] + out["more"]), fills


def draws(blocks: DataFrame, table: pd.DataFrame, p: Params) -> DataFrame:
    """(number, block, shard, pass): the blocks that each shard draws."""
    spark, numbers = blocks.sparkSession, table["number"].to_numpy()
    quota = table["quota"].to_numpy(np.int64)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                start, count = shard_counts(quota, int(shard), p.shards, p.seed)
                some = count > 0
                yield pd.DataFrame({"shard": int(shard), "number": numbers[some], "start": start[some],
                                    "count": count[some]})

    slices = spark.range(p.shards).mapInPandas(walk, "shard int, number int, start bigint, count bigint")
    steps = spark.createDataFrame(
        [(int(r.number), int(r.quota), stride(int(r.quota), p.seed), int(r.blocks), int(r.passes), int(r.part))
         for r in table.itertuples()],
        "number int, quota bigint, stride bigint, blocks bigint, passes int, part bigint")
    place = F.explode(F.expr("sequence(start, start + count - 1)")).alias("place")
    return (slices.join(F.broadcast(steps), "number").select("*", place)
            .withColumn("unit", F.expr("(place * stride) % quota"))
            .withColumn("pass", F.expr("CAST(least(unit DIV blocks, passes) AS INT)"))
            .withColumn("block", F.expr("unit - pass * blocks"))
            .select("number", F.expr("IF(pass = passes AND block >= part, part - 1 - block, block)").alias("block"), "shard",
                    "pass"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str,
          p: Params) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows in blocks, those that fill gaps, drawn blocks, source totals)."""
    spark = docs.sparkSession
    rows = sizes(docs, id_col, text_col, source_col)
    table = source_table(rows, p)
    blocks, words = permuted_blocks(rows, table, p)
    table, fills = quotas(blocks, table, words)
    totals = spark.createDataFrame(
        [(int(r.number), int(r.source_size), float(r.target), int(r.passes), float(r.rest)) for r in table.itertuples()],
        "number int, source_size bigint, target double, passes int, rest double")
    return blocks, fills, draws(blocks, table, p), totals


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          params: Params = Params()) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words in the mix, repeats counted)."""
    blocks, fills, drawn, totals = _plan(docs, id_col, text_col, source_col, params)
    drawn = (drawn.join(F.broadcast(totals.select("number", "passes")), "number")
             .groupBy("number", "block").agg(F.count_if(F.expr("pass < passes")).alias("whole"),
                                             F.count_if(F.expr("pass = passes")).alias("part")))
    # places in the order are unique for documents of some words, and only those fill gaps
    fills = (fills.join(drawn, ["number", "block"])
             .select("number", "before", F.lit(True).alias("some"), F.col("part").alias("fill")))
    rows = (blocks.join(drawn, ["number", "block"], "left").join(F.broadcast(totals), "number")
            .withColumn("some", F.col("size") > 0).join(fills, ["number", "before", "some"], "left"))
    times = (F.coalesce("whole", F.lit(0)) + F.when(F.expr(IN_LAST_PASS), F.coalesce("part", F.lit(0))).otherwise(0)
             + F.coalesce("fill", F.lit(0)))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target",
                       (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        params: Params = Params()) -> DataFrame:
    """The mix itself: rows of ``docs``, one per draw, shard by shard, each shard in a random order."""
    p = params
    blocks, fills, drawn, totals = _plan(docs, id_col, text_col, source_col, p)
    blocks = blocks.unionByName(fills)
    # a document that fills a gap comes right behind its other row and is the same copy
    copies = (Window.partitionBy("id", "mark").orderBy("before", F.desc("block"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    plan = (blocks.withColumn("copy", F.count_if(F.col("block") >= 0).over(copies)).join(drawn, ["number", "block"])
            .join(F.broadcast(totals), "number").where(f"block < 0 OR pass < passes OR {IN_LAST_PASS}")
            .select(F.coalesce("id", F.lit(0)).alias("key"), F.col("id").isNull().alias("none"), "mark",
                    F.struct("copy", "shard", F.xxhash64(F.lit(p.seed), "shard", "pass", "id", "mark", "copy")
                             .alias("order")).alias("draw"))
            .groupBy("key", "none", "mark").agg(F.collect_list("draw").alias("draws")))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    rows = docs.select(row, F.coalesce(F.col(id_col), F.lit(0)).alias("key"), F.col(id_col).isNull().alias("none"),
                       F.xxhash64(F.col(text_col), F.col(source_col)).alias("mark"))
    again = Window.partitionBy("key", "none", "mark").orderBy("key")
    joined = (rows.join(plan, ["key", "none", "mark"]).withColumn("copy", F.row_number().over(again))
              .select("row", F.explode(F.expr("filter(draws, x -> x.copy = copy)")).alias("draw")))
    return (joined.repartition(p.shards, F.col("draw.shard")).sortWithinPartitions("draw.shard", "draw.order")
            .select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
