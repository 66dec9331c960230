"""Periodic runs of words, found as maximal pairs in the tree of LCP intervals of each text."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isopleth.llm.text import let, words
from isopleth.session import small_batches

#: Texts are sorted together up to so many words; a longer text is sorted alone, as a whole.
BATCH_WORDS = 1 << 18

Run = tuple[int, int, int]


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The positions of ``codes`` in the order of their suffixes, and their ranks by the first 1, 2, 4 ... codes.

    Prefix doubling: in each round only suffixes that still share their rank
    with another are sorted again, by the rank that lies one prefix further.
    Every code of one text must differ from every code of another.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks, step = [rank.copy()], 1
    while True:
        alone = fresh & np.append(fresh[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order, ranks
        at = order[slots]
        # Slots of a group are neighbours, so sorting by (group, next rank) keeps each group in its place.
        key = rank[at] * (n + 2) + rank[np.minimum(at + step, n)] + 1
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[slots] = at
        fresh[slots[1:]] |= key[1:] != key[:-1]
        # A group begins at its first slot, and all its slots follow each other.
        rank[at] = np.maximum.accumulate(np.where(fresh[slots], slots, 0))
        ranks.append(rank.copy())
        step *= 2


def common_prefixes(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and at ``b``, pair by pair."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    end = len(ranks[0]) - 1
    for level in reversed(range(len(ranks))):
        same = (ranks[level][a] == ranks[level][b]) & (a < end) & (b < end)
        step = same.astype(np.int64) << level
        a, b, out = a + step, b + step, out + step
    return out


class _Interval:
    """An LCP interval while it is built: its positions, all of them and by the word to their left."""

    __slots__ = ("lcp", "all", "by_left")

    def __init__(self, lcp: int):
        self.lcp, self.all, self.by_left = lcp, [], {}

    def add(self, at: int, left: int) -> None:
        insort(self.all, at)
        insort(self.by_left.setdefault(left, []), at)

    def partners(self, at: int, left: int, reach: int) -> Iterator[int]:
        """Positions within ``reach`` of ``at`` that another word precedes.

        The list of ``at``'s own class is part of the list of all, so the next
        position of another class is where the two first differ: found by
        halving, without a look at the positions in between.
        """
        every, own = self.all, self.by_left.get(left, ())
        i, end = bisect_left(every, at - reach), bisect_right(every, at + reach)
        j = bisect_left(own, at - reach)
        rest = bisect_right(own, at + reach)
        while end - i > rest - j:
            low, high = 0, rest - j
            while low < high:
                middle = (low + high) // 2
                if every[i + middle] == own[j + middle]:
                    low = middle + 1
                else:
                    high = middle
            yield every[i + low]
            i, j = i + low + 1, j + low


def maximal_pairs(positions: list[int], lcps: list[int], left: list[int], times: int, least: int) -> Iterator[Run]:
    """(start, length, distance) of the close maximal pairs of one group of suffixes in order.

    A maximal pair are two positions whose suffixes share ``lcp`` words but
    neither the next word (they meet first in the interval of that lcp) nor the
    word before (they are of different left classes).  What it spans, from the
    first position to the end of the second occurrence, repeats at its distance
    and cannot be extended; with at least ``times`` distances in it, it is a
    run.  ``lcps[i]`` belongs to positions i and i + 1.

    Intervals are closed bottom-up; of two lists that meet the shorter one is
    looked up in, and then added to, the longer one.
    """
    stack: list[_Interval] = []

    def meet(a: _Interval, b: _Interval, lcp: int) -> Iterator[Run]:
        """Pairs between two parts of one interval; afterwards ``a`` holds both."""
        if len(a.all) < len(b.all):
            a.all, a.by_left, b.all, b.by_left = b.all, b.by_left, a.all, a.by_left
        reach = lcp // (times - 1)
        small = [(at, word) for word, where in b.by_left.items() for at in where]
        for at, word in small:
            for other in a.partners(at, word, reach):
                first, distance = min(at, other), abs(at - other)
                if distance + lcp >= least:
                    yield first, distance + lcp, distance
        for at, word in small:
            a.add(at, word)

    for i, at in enumerate(positions):
        after = lcps[i] if i < len(lcps) else 0
        part = _Interval(-1)
        part.add(at, left[i])
        # Close every interval that is deeper than what the next suffix shares; the last part joins its parent.
        while stack and stack[-1].lcp > after:
            top = stack.pop()
            yield from meet(top, part, top.lcp)
            part = top
        if i < len(lcps):
            if stack and stack[-1].lcp == after:
                yield from meet(stack[-1], part, after)
            else:
                node = _Interval(after)
                node.all, node.by_left = part.all, part.by_left
                stack.append(node)


def runs_of(texts: list[np.ndarray], times: int = 4, least: int = 6) -> list[list[Run]]:
    """(start, length, period) of every run of each text, by start, then period; a text is its words' codes.

    A run is a stretch with smallest period q and length of at least
    max(``least``, ``times`` * q) that no neighbour extends.  A multiple of q
    spans the same stretch, so of pairs with one span the least distance counts.
    """
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    if not sizes.sum():
        return out
    text = np.repeat(np.arange(len(texts)), sizes)
    words = np.concatenate(texts).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    order, ranks = suffix_order(text * (words.max() + 1) + words)
    # A pair at distance d shares (times - 1) * d words or more, so a shorter prefix than this is none.
    shortest = max(times - 1, -(-least * (times - 1) // times))
    coarse = ranks[min(shortest.bit_length() - 1, len(ranks) - 1)]
    near = np.flatnonzero(coarse[order[1:]] == coarse[order[:-1]])
    shared = common_prefixes(order[near], order[near + 1], ranks)
    near, shared = near[shared >= shortest], shared[shared >= shortest]
    if not len(near):
        return out
    # Suffixes that follow each other with such prefixes form groups; a group without two close positions has no run.
    first = np.concatenate([[0], np.flatnonzero(np.diff(near) != 1) + 1, [len(near)]])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        at = order[near[a] : near[b - 1] + 2]
        lcps = shared[a:b]
        if np.diff(np.sort(at)).min() * (times - 1) > lcps.max():
            continue
        doc = int(text[at[0]])
        base = int(begin[doc])
        left = np.where(at > base, words[at - 1], -1)
        out[doc].extend((s - base, n, d) for s, n, d in maximal_pairs(at.tolist(), lcps.tolist(), left.tolist(), times, least))
    for doc, found in enumerate(out):
        if found:
            period: dict[tuple[int, int], int] = {}
            for start, length, distance in found:
                span = (start, length)
                period[span] = min(distance, period.get(span, distance))
            out[doc] = sorted(((s, n, d) for (s, n), d in period.items()), key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words that no run repeats: of every run its first period stays, unless another run drops it."""
    if not runs:
        return words
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def _collapsed(texts: Iterator[str | None], times: int, least: int) -> Iterator[tuple[list[Run], str]]:
    """Runs and collapsed text of each text; texts are sorted in batches of :data:`BATCH_WORDS`."""

    def settled() -> Iterator[tuple[list[Run], str]]:
        codes: dict[bytes, int] = defaultdict(count().__next__)
        coded = [np.fromiter(map(codes.__getitem__, w), dtype=np.int64, count=len(w)) for w in held]
        for split, found in zip(held, runs_of(coded, times, least)):
            yield found, b" ".join(kept_words(split, found)).decode()

    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        # bytes.split() splits at the six ASCII characters only.
        split = text.encode().split() if text else []
        if held and size + len(split) > BATCH_WORDS:
            yield from settled()
            held, size = [], 0
        held.append(split)
        size += len(split)
    yield from settled()


def collapse(docs: DataFrame, text_col: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """The input with ``runs`` (start, length, period, in words) and ``collapsed``, the text without repeats.

    Words are split at white space.  A run is a maximal stretch of words with
    smallest period q, at least ``times`` * q and ``least`` words long.  In
    ``collapsed`` its words after the first q are gone, the others are joined by
    single spaces.  Null, empty and blank texts have no runs and collapse to the
    empty text.  A text is always handled whole, whatever its length; work is
    n log n in its words and at most linear in its runs.  Repeated rows stay
    rows of their own; other columns pass through, columns of those two names
    are replaced.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop(*[c for c in ("runs", "collapsed") if c != text_col])
    fields = [f for f in rows.schema.fields if f.name not in ("runs", "collapsed")]
    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType([*fields, T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    names = [f.name for f in fields]
    rows = rows.select("*", F.col(text_col).cast("string").alias("_text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # A slice of bounded size, or a single row; its results leave before the next is read.
                part = batch.slice(at, _rows_within(batch.column("_text"), at))
                at += part.num_rows
                done = list(_collapsed((x.as_py() for x in part.column("_text")), times, least))
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x, _ in done], pa.list_(_RUN))
                columns = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, runs, pa.array([t for _, t in done], pa.string())], [*names, "runs", "collapsed"])

    return rows.mapInArrow(find, schema)


def _rows_within(texts: pa.Array, at: int, most_bytes: int = 1 << 23) -> int:
    """How many texts from ``at`` on have at most ``most_bytes`` together; one at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts.slice(at)), 0).to_numpy(zero_copy_only=False))
    return max(1, int(np.searchsorted(sizes, most_bytes, side="right")))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input where a tenth of the texts, by id, becomes periodic from some word on.

    With h the CRC-32 of the decimal id and g = h div 10, texts of h % 10 = 0
    have each word i >= a replaced by word a + (i - a) % p of the n there were,
    where a = g % n and p = 1 + (n - a) div (3 + g % 8).  Null ids and texts
    without words stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10).cast("long")

    def change(w):
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i).cast("int")))
        return F.when(n > 0, F.array_join(again, " ")).otherwise(F.col(text_col))

    chosen = F.pmod(h, F.lit(10)) == 0
    return docs.withColumn(text_col, F.when(chosen, let(words(F.col(text_col)), change)).otherwise(F.col(text_col)))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_runs, the strongest run, and hashes of all runs and of the collapsed text."""
    stronger = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]

    def first(best, r):
        more = stronger(r, best)
        tie = (more == 0) & ((r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"])))
        return F.when(best.isNull() | (more > 0) | tie, r).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    said = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = found.withColumn("_best", F.aggregate("runs", none, first))
    return rows.select(
        F.col(id_col).alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.call_function("div", 1000 * F.col("_best.length"), F.col("_best.period")).alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
