"""Ranked lexical search over K2-treaps: quadtrees of the term-document grid whose cells keep their largest impact."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isopleth.session import small_batches, written

#: A block of the grid ends with the document that reaches one of these; a longer document is a block of its own.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 20, 4096
#: Items searched together in a task, and items that one pass over the index takes.
TOGETHER, ITEMS_PER_PASS = 64, 1024

#: ASCII letters in lower case, digits and all bytes of other characters stay; everything else separates terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_POPCOUNT = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters; A-Z lower-cased; null has none."""
    return text.encode().translate(_FOLD).split() if text else []


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    """What one occurrence-weighted term adds per unit of its weight: saturating in ``tf``, less in long documents."""
    m = 100 - 25 + (25 * n * docs) // tokens
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of ``x`` moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


@dataclass
class Treap:
    """Levels from the root down: which quadrants of a cell are filled, where its children begin, largest impacts."""

    masks: list[np.ndarray]
    first: list[np.ndarray]
    largest: list[np.ndarray]

    @property
    def height(self) -> int:
        return len(self.masks)

    @classmethod
    def build(cls, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> Treap:
        """From the filled cells of a grid, no cell twice."""
        side = int(max(row.max(initial=0), col.max(initial=0)))
        key = (_spread(row) << np.uint64(1)) | _spread(col)
        turn = np.argsort(key)
        key, value = key[turn], value[turn].astype(np.int64)
        masks, largest = [], [value]
        for _ in range(max(1, side.bit_length())):
            up = key >> np.uint64(2)
            at = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            quadrant = np.left_shift(1, (key & np.uint64(3)).astype(np.int64))
            masks.append(np.bitwise_or.reduceat(quadrant, at).astype(np.uint8))
            value = np.maximum.reduceat(value, at)
            largest.append(value)
            key = up[at]
        return cls._linked(masks[::-1], largest[::-1])

    @classmethod
    def _linked(cls, masks: list[np.ndarray], largest: list[np.ndarray]) -> Treap:
        first = [np.cumsum(_POPCOUNT[m]) - _POPCOUNT[m] for m in masks]
        return cls(masks, first, largest)

    def pack(self) -> bytes:
        """Compressed: the sizes of the levels, the masks, and by how much each cell falls short of its parent."""
        sizes = np.array([len(m) for m in self.masks] + [len(self.largest[-1])], dtype="<i8")
        drops = [self.largest[0]]
        for level, mask in enumerate(self.masks):
            drops.append(np.repeat(self.largest[level], _POPCOUNT[mask]) - self.largest[level + 1])
        body = sizes.tobytes() + np.concatenate(self.masks).tobytes() + np.concatenate(drops).astype("<i4").tobytes()
        return len(sizes).to_bytes(2, "little") + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def unpack(cls, data: bytes) -> Treap:
        levels = int.from_bytes(data[:2], "little")
        body = zstandard.ZstdDecompressor().decompress(data[2:])
        sizes = np.frombuffer(body, dtype="<i8", count=levels)
        inner = int(sizes[:-1].sum())
        masks = np.split(np.frombuffer(body, dtype=np.uint8, count=inner, offset=8 * levels), np.cumsum(sizes[:-2]))
        drops = np.split(np.frombuffer(body, dtype="<i4", offset=8 * levels + inner).astype(np.int64), np.cumsum(sizes[:-1]))
        largest = [drops[0]]
        for mask, drop in zip(masks, drops[1:]):
            largest.append(np.repeat(largest[-1], _POPCOUNT[mask]) - drop)
        return cls._linked(masks, largest)

    def down(self, level: int, node: np.ndarray, row: np.ndarray, right: int) -> tuple[np.ndarray, np.ndarray]:
        """Children of cells in the half of the columns named by ``right``, on the paths of ``row``: whether filled, and which."""
        quadrant = 2 * ((row >> (self.height - 1 - level)) & 1) + right
        mask = self.masks[level][node]
        there = (mask >> quadrant) & 1 == 1
        return there, self.first[level][node] + _POPCOUNT[mask & ((1 << quadrant) - 1)]


def block_of(docs: list[list[bytes]], total_docs: int, total_tokens: int) -> tuple[bytes, np.ndarray, np.ndarray, bytes]:
    """Grid of some documents' terms: terms by row, their document counts, documents by column, the packed treap.

    Columns rise with the length of the documents, so neighbours have like
    impacts.  Rows fall with the order of magnitude of a term's documents, and
    follow its first column within one, so the cells of rare terms lie close.
    """
    codes: dict[bytes, int] = defaultdict(count().__next__)
    coded = [np.fromiter(map(codes.__getitem__, d), dtype=np.int64, count=len(d)) for d in docs]
    n = np.array([len(d) for d in docs], dtype=np.int64)
    column = np.argsort(n, kind="stable")
    at = np.repeat(np.arange(len(docs)), n[column])
    cells, tf = np.unique(np.concatenate([coded[i] for i in column.tolist()]) * len(docs) + at, return_counts=True)
    code, col = cells // len(docs), cells % len(docs)
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    df = np.diff(np.append(begin, len(code)))
    by_row = np.lexsort((np.arange(len(df)), col[begin], -np.floor(np.log2(df))))
    row = np.empty(len(df), dtype=np.int64)
    row[by_row] = np.arange(len(df))
    value = impacts(tf.astype(np.int64), n[column][col], total_docs, total_tokens)
    names = list(codes)
    listed = b"\0".join(names[i] for i in by_row.tolist())
    return listed, df[by_row], column, Treap.build(row[code], col, value).pack()


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have with repeats."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = tokens = 0
        for batch in batches:
            for text in batch.column(0):
                held = len(terms_of(text.as_py()))
                n, tokens = n + (held > 0), tokens + held
        yield pa.RecordBatch.from_pydict({"n": [n], "tokens": [tokens]}, schema=pa.schema([("n", pa.int64()), ("tokens", pa.int64())]))

    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(tally, "n long, tokens long").agg(F.sum("n"), F.sum("tokens")).first()
    return (sums[0] or 0, sums[1] or 0)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """Written blocks (ids, terms, dfs, treap) of all documents with a term, and their :func:`corpus_size`.

    ``ids`` are by column, ``terms`` (parted by a zero byte) and ``dfs`` by row.
    A task holds one block at a time.  Rows with the same id are documents of
    their own.
    """
    small_batches(docs.sparkSession)
    n_docs, n_tokens = corpus_size(docs, text_col)
    key = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(key)),
            T.StructField("terms", T.BinaryType()),
            T.StructField("dfs", T.BinaryType()),
            T.StructField("treap", T.BinaryType()),
        ]
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Scalar] = []
        held: list[list[bytes]] = []
        tokens = 0

        def block() -> pa.RecordBatch:
            terms, df, column, treap = block_of(held, n_docs, n_tokens)
            own = pa.array([ids[i].as_py() for i in column.tolist()], ids[0].type)
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            binary = lambda x: pa.array([x], pa.binary())
            return pa.RecordBatch.from_arrays([listed, binary(terms), binary(df.astype("<i4").tobytes()), binary(treap)], ["ids", "terms", "dfs", "treap"])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                if held and (tokens + len(found) > BLOCK_TOKENS or len(held) >= BLOCK_DOCS):
                    yield block()
                    ids, held, tokens = [], [], 0
                ids.append(i)
                held.append(found)
                tokens += len(found)
        if held:
            yield block()

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return written(rows.mapInArrow(gather, schema)), n_docs, n_tokens


def _top(query: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each query, best first: highest score, then lowest tie."""
    order = np.lexsort((tie, -score, query))
    q = query[order]
    begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return order[place < k]


class _Ranges:
    """Open document ranges of one level, with the cells of their items' rows (entries, in the order of ranges)."""

    def __init__(self, query, col, bound, size, row, node, weight):
        self.query, self.col, self.bound, self.size = query, col, bound, size
        self.row, self.node, self.weight = row, node, weight

    def __len__(self) -> int:
        return len(self.query)

    def where(self, keep: np.ndarray) -> _Ranges:
        e = np.repeat(keep, self.size)
        return _Ranges(self.query[keep], self.col[keep], self.bound[keep], self.size[keep], self.row[e], self.node[e], self.weight[e])

    def joined(self, other: _Ranges) -> _Ranges:
        return _Ranges(*(np.concatenate([getattr(self, x), getattr(other, x)]) for x in ("query", "col", "bound", "size", "row", "node", "weight")))

    def halves(self, treap: Treap, level: int) -> _Ranges:
        """Both halves of every range; only rows with a cell in a half go on to it."""
        own = np.repeat(np.arange(len(self)), self.size)
        parts = []
        for right in (0, 1):
            there, child = treap.down(level, self.node, self.row, right)
            parts.append((2 * own[there] + right, self.row[there], child[there], self.weight[there]))
        at, row, node, weight = (np.concatenate(x) for x in zip(*parts))
        turn = np.argsort(at, kind="stable")
        at, row, node, weight = at[turn], row[turn], node[turn], weight[turn]
        size = np.bincount(at, minlength=2 * len(self))
        # Sums of integers below 2**53 are exact in doubles.
        bound = np.bincount(at, weights=weight * treap.largest[level + 1][node], minlength=2 * len(self)).astype(np.int64)
        some = size > 0
        half = np.repeat(self.col, 2) * 2 + np.tile([0, 1], len(self))
        return _Ranges(np.repeat(self.query, 2)[some], half[some], bound[some], size[some], row, node, weight)


def best_of_block(treap: Treap, rows: list[list[tuple[int, int]]], tie: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, column, score) of each query's ``k`` best columns, those below ``floor`` left out.

    ``rows`` has (row, weight) pairs per query.  The paths of a query's rows go
    down together: an open document range is bounded by the weighted sum of the
    largest impacts of the cells that its rows cross.  In each round every query
    opens its most promising ranges, twice as many as before once documents are
    found, until no open range can reach its k-th best score.  A range of one
    column is a document and its bound the score.
    """
    size = np.array([len(r) for r in rows], dtype=np.int64)
    some = np.flatnonzero(size)
    row = np.array([r for q in rows for r, _ in q], dtype=np.int64)
    weight = np.array([w for q in rows for _, w in q], dtype=np.int64)
    zero = np.zeros(len(row), dtype=np.int64)
    root = np.bincount(np.repeat(np.arange(len(rows)), size), weights=weight * treap.largest[0][zero], minlength=len(rows))
    levels: dict[int, _Ranges] = {0: _Ranges(some, np.zeros(len(some), dtype=np.int64), root[some].astype(np.int64), size[some], row, zero, weight)}
    least = floor.copy()
    query = col = score = np.empty(0, dtype=np.int64)
    width = 16
    while levels:
        depths = sorted(levels)
        q = np.concatenate([levels[d].query for d in depths])
        chosen = np.zeros(len(q), dtype=bool)
        chosen[_top(q, np.concatenate([levels[d].bound for d in depths]), np.zeros(len(q)), width)] = True
        opened = dict(zip(depths, np.split(chosen, np.cumsum([len(levels[d]) for d in depths])[:-1])))
        fresh: dict[int, _Ranges] = {}
        for depth in depths:
            if not opened[depth].any():
                continue
            half = levels[depth].where(opened[depth]).halves(treap, depth)
            half = half.where(half.bound >= least[half.query])
            levels[depth] = levels[depth].where(~opened[depth])
            if depth + 1 < treap.height:
                fresh[depth + 1] = half
                continue
            query, col, score = (np.concatenate(x) for x in ((query, half.query), (col, half.col), (score, half.bound)))
            best = _top(query, score, tie[col], k)
            query, col, score = query[best], col[best], score[best]
            n = np.bincount(query, minlength=len(rows))
            full = np.flatnonzero(n >= k)
            least[full] = np.maximum(least[full], score[np.cumsum(n)[full] - 1])
        for depth, half in fresh.items():
            levels[depth] = levels[depth].joined(half) if depth in levels else half
        levels = {d: kept for d, r in levels.items() if len(kept := r.where(r.bound >= least[r.query]))}
        if len(query):
            width *= 2
    return query, col, score


def _document_counts(blocks: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """In how many documents each wanted term is."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for terms, dfs in zip(batch.column("terms"), batch.column("dfs")):
                names, df = terms.as_py().split(b"\0"), np.frombuffer(dfs.as_py(), dtype="<i4").tolist()
                found.update({t: n for t, n in zip(names, df) if t in wanted})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "df"])

    counted = blocks.select("terms", "dfs").mapInArrow(tally, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in counted.collect()}


def _searched(blocks: DataFrame, items: list[tuple[int, list[tuple[bytes, int]]]], k: int) -> DataFrame:
    """(_item, doc_id, score): the best ``k`` of each item in each task's blocks; a block starts from what earlier ones found."""
    key = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("_item", T.LongType()), T.StructField("doc_id", key), T.StructField("score", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        kind = None
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for ids, terms, packed in zip(batch.column("ids"), batch.column("terms"), batch.column("treap")):
                own = ids.as_py()
                row_of = {t: i for i, t in enumerate(terms.as_py().split(b"\0"))}
                treap = Treap.unpack(packed.as_py())
                # Ascending ids, null last, settle ties.
                tie = np.empty(1 << treap.height, dtype=np.int64)
                tie[np.array(sorted(range(len(own)), key=lambda i: (own[i] is None, own[i])), dtype=np.int64)] = np.arange(len(own))
                for at in range(0, len(items), TOGETHER):
                    part = items[at : at + TOGETHER]
                    rows = [[(row_of[t], w) for t, w in said if t in row_of] for _, said in part]
                    floor = np.array([best[at + i][-1][0] * -1 if len(best[at + i]) == k else 1 for i in range(len(part))], dtype=np.int64)
                    for q, c, s in zip(*(x.tolist() for x in best_of_block(treap, rows, tie, floor, k))):
                        best[at + q].append((-s, own[c] is None, own[c]))
                    for i in range(at, at + len(part)):
                        best[i] = sorted(best[i])[:k]
        found = [(items[i][0], x[2], -x[0]) for i, held in enumerate(best) for x in held]
        if found:
            number, doc, score = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], ["_item", "doc_id", "score"])

    return blocks.select("ids", "terms", "treap").mapInArrow(search, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents of score above 0.

    A document scores the sum over the item's terms, repeats included, of the
    term's weight (rarer terms more, :func:`term_weight`) times its impact
    (:func:`impacts`).  Equal scores go by ascending id, null ids last.

    Documents without terms (null, empty) match nothing; an item without terms,
    or whose terms no document has, returns no row.  Rows that share an id are
    documents of their own, and item rows that share an id are ranked one by
    one.  Other columns are not read.  Items are taken ``ITEMS_PER_PASS`` at a
    time, each time against all blocks; a task returns ``k`` rows per item.
    """
    blocks, n_docs, _ = index(docs, id_col, text_col)
    numbered = written(items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("t"), F.monotonically_increasing_id().alias("_item")))
    passes = max(1, math.ceil(numbered.count() / ITEMS_PER_PASS))
    found = None
    for turn in range(passes):
        rows = numbered.where(F.pmod(F.xxhash64("_item"), F.lit(passes)) == turn).select("_item", "t").collect()
        said = [(r["_item"], Counter(terms_of(r["t"]))) for r in rows]
        df = _document_counts(blocks, set().union(*(c for _, c in said)))
        weights = {t: term_weight(n_docs, n) for t, n in df.items()}
        # A term in nearly every document may weigh nothing; it adds nothing then.
        weighed = [(i, [(t, n * weights[t]) for t, n in c.items() if weights.get(t, 0) > 0]) for i, c in said]
        part = written(_searched(blocks, weighed, k))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")
