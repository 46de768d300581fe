"""Spelling variants: pairs of words one edit apart, and the most frequent form behind each word.

Two words are *near* if they differ by exactly one inserted, deleted or
replaced code point.  Near pairs are the paths of ``V o E o V``, the acceptor
of the vocabulary composed with a one-edit transducer and the acceptor again.

The composition is cut at its initial states.  Take the longer length ``m`` of
a pair: if the edit is in the last half, both words reach the same state by
their first ``m // 2`` code points; if not, by their last ones, in the
acceptor of the reversed words.  So each word goes to four partitions (both
directions; as the longer and as the shorter word), and a task holds the words
of one initial state at a time: it builds their minimal acyclic acceptor and
enumerates what the composition accepts.  The transducer is unambiguous (behind a deleted
code point the same one may not follow), so a pair has one path.  A partition of
more than ``max_state_words`` words is cut further: into the states one code
point deeper, and into the composed states behind an edit at just that place,
where the rest of both words is the same.

Only near pairs are made, never the pairs of a partition.  A word of L code
points has fewer than ``(2 L + 2) * alphabet`` of them.

Defined results
- null and empty texts, and texts without letters, have no words; a null id is written ``null`` for the noise rule;
- words are counted over all rows, repeated rows and repeated ids included;
- of near words of equal count the first in code-point order is the form;
- an empty table gives an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, scratch_path, stage, stage_at

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: Words of one initial state that a task may hold.
MAX_STATE_WORDS = 50_000
#: Words (in one of four roles) of a task.
TASK_ROWS = 60_000

_ROW = "state string, side int, m int, key string, tail string, rest string, long boolean, n bigint"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, noise_every: int | None = None) -> DataFrame:
    """(word, n): letter runs, A-Z in lower case, of enough code points and occurrences.

    ``noise_every``: a run loses the code point ``h % length`` if the number divides h, the CRC-32 of
    ``<id>:<run>``; a reproducible misspelling for measurements.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN})"), 0)).alias("run"))
    words = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    if noise_every:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = F.col("h") % F.length("word")
        cut = F.concat(F.expr("substring(word, 1, int(h % length(word)))"), F.col("word").substr(at.cast("int") + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % noise_every == 0, cut).otherwise(F.col("word")).alias("word"))
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


class Acceptor:
    """Minimal acyclic automata of sorted word lists; states with the same right language are one."""

    def __init__(self):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self._known: dict[tuple, int] = {}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, tuple(arcs.items()))
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.final.append(final)
            self.arcs.append(arcs)
        return state

    def add(self, words: Iterable[str]) -> int:
        """The initial state of an acceptor of ``words`` (sorted, distinct)."""
        path: list[list] = [[False, {}]]  # the open states along the last word
        last = ""
        for word in words:
            same = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                same += 1
            self._close(path, last, same)
            path += [[False, {}] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        return self._state(*path[0])

    def _close(self, path: list[list], last: str, depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(*path.pop())
            path[-1][1][last[len(path) - 1]] = state

    def common(self, p: int, q: int) -> list[str]:
        """The words that both states accept."""
        out, todo = [], [(p, q, "")]
        while todo:
            p, q, s = todo.pop()
            if self.final[p] and self.final[q]:
                out.append(s)
            a, b = self.arcs[p], self.arcs[q]
            if len(b) < len(a):
                a, b = b, a
            for c, r in a.items():
                if c in b:
                    todo.append((r, b[c], s + c))
        return out


def one_edit_pairs(long: list[str], short: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart: two words of ``long`` (replaced), or a word of ``long`` and one of ``short`` (deleted).

    All words of a list have one length, ``short`` has one code point less; lists are sorted and distinct.
    """
    acceptor = Acceptor()
    start, other = acceptor.add(long), acceptor.add(short)
    arcs, memo = acceptor.arcs, {}

    def common(p: int, q: int) -> list[str]:
        key = (p, q) if p < q else (q, p)
        found = memo.get(key)
        if found is None:
            found = memo[key] = acceptor.common(p, q)
        return found

    todo: list[tuple[int, int | None, str]] = [(start, other, "")]
    while todo:
        p, q, x = todo.pop()
        out = list(arcs[p].items())
        for i, (a, r) in enumerate(out):
            for b, t in out[i + 1:]:
                for s in common(r, t):
                    yield x + a + s, x + b + s
            if q is not None:
                for s in common(r, q):
                    if s[:1] != a:
                        yield x + a + s, x + s
            todo.append((r, arcs[q].get(a) if q is not None else None, x + a))


def _places(words: DataFrame) -> DataFrame:
    """Each word at its four initial states."""
    length, word = F.length("word"), F.col("word")
    rows = []
    for long in (True, False):
        m = length if long else length + 1
        half = F.floor(m / 2).cast("int")
        rows += [F.struct(F.lit(0).alias("side"), m.alias("m"), half.alias("k"), word.alias("w"), F.lit(long).alias("long")),
                 F.struct(F.lit(1).alias("side"), m.alias("m"), (m - half).alias("k"), F.reverse(word).alias("w"),
                          F.lit(long).alias("long"))]
    return (words.select(F.explode(F.array(*rows)).alias("r"), "n")
            .select(F.col("r.side").alias("side"), F.col("r.m").alias("m"), F.expr("left(r.w, r.k)").alias("key"),
                    F.lit("").alias("tail"), F.expr("substring(r.w, r.k + 1)").alias("rest"), F.col("r.long").alias("long"), "n"))


def _stated(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\u0000", F.col("side").cast("string"), F.col("m").cast("string"), "key", "tail")
                       .alias("state"), "side", "m", "key", "tail", "rest", "long", "n")


def _deeper(rows: DataFrame) -> DataFrame:
    """The rows of a state one code point on, and behind an edit at this place (``rest`` is then the edited one)."""
    on = rows.where("rest <> ''").select(
        "side", "m", F.concat("key", F.expr("left(rest, 1)")).alias("key"), "tail", F.expr("substring(rest, 2)").alias("rest"),
        "long", "n")
    edited = rows.select(
        "side", "m", "key", F.concat(F.lit("\u0001"), F.when(F.col("long"), F.expr("substring(rest, 2)")).otherwise(F.col("rest"))).alias("tail"),
        F.when(F.col("long"), F.expr("left(rest, 1)")).otherwise(F.lit("")).alias("rest"), "long", "n")
    return _stated(on.unionByName(edited))


def _initial_states(words: DataFrame, max_state_words: int) -> DataFrame:
    """(state, ...) rows; no state of which more can come holds more than ``max_state_words``.

    A state behind an edit holds at most one word for each code point and one more.
    """
    done, rows = None, stage(_stated(_places(words)), "states")
    while True:
        large = stage(rows.where("tail = ''").groupBy("state").count().where(F.col("count") > max_state_words).select("state"),
                      "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "state", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = stage(_deeper(rows.join(large, "state", "left_semi")), "states")


def _links_of_state(side: int, m: int, key: str, tail: str, rest: list[str], long: list[bool],
                    n: list[int]) -> Iterator[tuple[str, int, str, int]]:
    count = dict(zip(zip(long, rest), n))
    longs = sorted({r for r, is_long in zip(rest, long) if is_long})
    shorts = sorted({r for r, is_long in zip(rest, long) if not is_long})
    if not longs or len(longs) + len(shorts) < 2:
        return
    behind = tail[1:]
    for u, v in one_edit_pairs(longs, shorts):
        nu, nv = count[True, u], count[len(v) == len(u), v]
        if len(v) < len(u) and tail and behind[:1] == u:
            continue  # the same deletion has its path further on
        a, b = key + u + behind, key + v + behind
        if side:
            a, b = a[::-1], b[::-1]
            if a[:m // 2] == b[:m // 2]:
                continue  # found from the front
        yield a, nu, b, nv


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
        a, na, b, nb = zip(*found) if found else ((), (), (), ())
        return pa.RecordBatch.from_pydict({"word": pa.array([*a, *b], pa.string()), "near": pa.array([*b, *a], pa.string()),
                                           "n": pa.array([*nb, *na], pa.int64())})

    state, head, rest, long, n = None, None, [], [], []
    for batch in batches:
        found = []
        for s, side, m, key, tail, r, is_long, k in zip(*[c.to_pylist() for c in batch.columns]):
            if s != state:
                if len(rest) > 1:
                    found += _links_of_state(*head, rest, long, n)
                state, head, rest, long, n = s, (side, m, key, tail), [], [], []
            rest.append(r)
            long.append(is_long)
            n.append(k)
        yield out(found)
    if len(rest) > 1:
        yield out(list(_links_of_state(*head, rest, long, n)))


def near_words(words: DataFrame, max_state_words: int = MAX_STATE_WORDS) -> DataFrame:
    """(word, near, n): both directions of every near pair of ``words`` (word, n), with the count of ``near``."""
    rows = _initial_states(words, max_state_words)
    tasks = 1 + rows.count() // TASK_ROWS
    return rows.repartition(tasks, "state").sortWithinPartitions("state").mapInArrow(_links, "word string, near string, n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain word -> form, by pointer jumping.

    Counts at least double along a chain, so the rounds are few: log2 of log2 of the largest count.
    """
    spark = forms.sparkSession
    path = scratch_path(spark, "roots")
    at = stage_at(forms.select("word", F.col("form").alias("root")), path)
    while True:
        nxt = scratch_path(spark, "roots")
        far = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = stage_at(at.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                              F.col("further").isNotNull().alias("moved")), nxt)
        more = not jumped.where("moved").isEmpty()
        discard(spark, path)
        at, path = jumped.select("word", "root"), nxt
        if not more:
            return at


def forms(words: DataFrame, ratio: int = RATIO, max_state_words: int = MAX_STATE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n)."""
    words = stage(words, "vocabulary")
    best = near_words(words, max_state_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "near")).alias("best"))
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.minus") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n")))
        .alias("f"))
    judged = stage(judged.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
