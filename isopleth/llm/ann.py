"""Approximate nearest neighbours: stable projections, a kd-tree over them, a chi-square stopping test.

A Gaussian projection to m dimensions turns a distance d into d times the root
of a chi-square variable with m degrees of freedom.  Cells of a kd-tree over
the projections are visited by rising distance from the query's projection;
rows there are verified on the original vectors.  A query stops once every row
nearer than its k-th neighbour would, with the stated probability, have had its
projection inside the radius visited so far.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.session import pinned


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half = np.asarray(x, dtype=np.float64) / 2
    with np.errstate(over="ignore", invalid="ignore"):
        terms = sum(half**i / math.factorial(i) for i in range(m // 2))
        return np.where(np.isfinite(half), 1 - np.exp(-half) * terms, 1.0)


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(np.array(high), m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(np.array(mid), m) < p else (low, mid)
    return high


def projection(dim: int, m: int, seed: int) -> np.ndarray:
    """dim x m independent normal values, the same in every task."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


@dataclass
class Tree:
    """A full binary kd-tree over projections: inner node i has children 2i+1 and 2i+2."""

    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, depth: int) -> Tree:
        """Medians of the sample along the axis of its widest spread, level by level."""
        inner = (1 << depth) - 1
        axis, cut = np.zeros(inner, dtype=np.int64), np.zeros(inner)
        held = {0: points}
        for i in range(inner):
            own = held.pop(i)
            if len(own):
                axis[i] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                cut[i] = np.median(own[:, axis[i]])
            low = own[:, axis[i]] <= cut[i]
            held[2 * i + 1], held[2 * i + 2] = own[low], own[~low]
        return cls(axis, cut)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), dtype=np.int64)
        row = np.arange(len(points))
        for _ in range(int(math.log2(len(self.axis) + 1))):
            at = 2 * at + 1 + (points[row, self.axis[at]] > self.cut[at])
        return at - len(self.axis)


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, v``: rows with an id and a vector of finite components, not all zero; exact repeats once."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & good & F.exists("v", lambda x: x != 0)).dropDuplicates()


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).reshape(-1, width) if len(column) else np.zeros((0, width))


@dataclass
class Index:
    """Blocks of rows by dimension and leaf, and each leaf's box of projections."""

    blocks: DataFrame
    place: Callable[[DataFrame], DataFrame]
    boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    m: int


def build(
    df: DataFrame,
    m: int = 8,
    seed: int = 11,
    leaf_rows: int = 2048,
    block_rows: int = 512,
    sample_rows: int = 20_000,
    most_leaves: int = 4096,
    copies: int | None = None,
    sample_bytes: int = 64 << 20,
) -> Index:
    """Index every vector of :func:`vectors`, each with its ``copies`` smallest ids (all where it is None).

    A search for k neighbours needs k + 1 copies of a vector: any further one is
    as far from a query as these, and behind them.  They are picked before the
    shuffle as well, so a vector that very many rows share costs no more than others.

    Only the tree's cuts are fitted on a sample (by hash of the id, about
    ``sample_rows`` rows and no more than about ``sample_bytes``).  At most ``most_leaves`` leaves per dimension bound what
    is sent to tasks; beyond that leaves grow and are read in more blocks.
    Blocks hold about ``block_rows`` rows dealt by id, so a leaf into which
    very many vectors fall is many blocks.  Vectors are compared with
    those of their own dimension only.
    """
    if copies is not None:
        copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        df = df.withColumn("_copy", copy).where(F.col("_copy") <= copies).drop("_copy")
    base = pinned(df)
    per_dim = {d: n for d, n in base.groupBy(F.size("v")).count().collect()}
    total = sum(per_dim.values())
    held = 8 * sum(d * n for d, n in per_dim.items())
    share = min(1.0, sample_rows / max(total, 1), sample_bytes / max(held, 1))
    sample = base.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    picked: dict[int, list[np.ndarray]] = {}
    for (v,) in sample.select("v").toLocalIterator():
        picked.setdefault(len(v), []).append(np.array(v))
    trees = {}
    for d, n in per_dim.items():
        depth = max(0, math.ceil(math.log2(max(1, min(n / leaf_rows, most_leaves)))))
        points = np.array(picked.get(d, np.zeros((0, d)))).reshape(-1, d) @ projection(d, m, seed)
        trees[d] = Tree.fit(points, depth)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, part in frame.groupby(frame["v"].map(len)):
                points = _matrix(part["v"], d) @ projection(d, m, seed)
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "dim": d, "leaf": trees[d].leaf(points), "p": list(points)})

    def placed(rows: DataFrame) -> DataFrame:
        return rows.mapInPandas(place, "id long, v array<double>, dim int, leaf int, p array<double>")

    rows = pinned(placed(base))
    sides = [f(F.get("p", F.lit(i))).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(m)]
    leaves = pinned(rows.groupBy("dim", "leaf").agg(F.count("*").alias("n"), *sides))
    boxes = {}
    for d, part in leaves.toPandas().groupby("dim"):
        part = part.sort_values("leaf")
        boxes[int(d)] = (part["leaf"].to_numpy(), *(part[[f"{s}{i}" for i in range(m)]].to_numpy() for s in ("lo", "hi")))
    counts = leaves.select("dim", "leaf", F.ceil(F.col("n") / block_rows).alias("chunks"))
    chunked = rows.join(counts, ["dim", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    blocks = chunked.groupBy("dim", "leaf", "chunk").agg(F.collect_list(F.struct("id", "v", "p")).alias("b"))
    flat = blocks.select(
        "dim",
        "leaf",
        F.transform("b", lambda x: x["id"]).alias("ids"),
        F.flatten(F.transform("b", lambda x: x["v"])).alias("vs"),
        F.flatten(F.transform("b", lambda x: x["p"])).alias("ps"),
    )
    return Index(pinned(flat), placed, boxes, m)


def _order(box: tuple[np.ndarray, np.ndarray, np.ndarray], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves by rising squared distance of their box from a projected query."""
    leaf, low, high = box
    gap = np.maximum(np.maximum(low - q, q - high), 0.0)
    far = (gap * gap).sum(axis=1)
    by = np.lexsort((leaf, far))
    return leaf[by], far[by]


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    probability: float = 0.95,
    first_leaves: int = 4,
    growth: int = 3,
    query_block: int = 256,
    **index: int,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of :func:`vectors` with ``is_query`` (on ``id``) its k nearest.

    Score is the Euclidean distance of the original vectors in double
    precision, ties go to the smaller id, and rows with the query's own id are
    left out.  Fewer candidates than k are all returned; an empty table gives
    no rows.  If an id has several vectors all are candidates, and the
    smallest one is its query.

    Rounds visit 4 leaves per query, then 12, 36 and so on.  Within a round,
    queries that visit a leaf meet its rows in blocks of at most about
    ``query_block`` by ``block_rows``, and rows whose projection lies outside
    the stopping radius of the query's current neighbours are skipped.
    """
    df = pinned(df)
    idx = build(df, copies=k + 1, **index)
    m, boxes = idx.m, idx.boxes
    reach = chi_square_quantile(probability, m)
    asking = df.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    queries = pinned(idx.place(asking).select("id", "v", "p", "dim"))
    n_blocks = max(1, math.ceil(queries.count() / query_block))
    most = max((len(b[0]) for b in boxes.values()), default=0)
    spark = df.sparkSession
    tops = spark.createDataFrame([], "query_id long, vec_id long, score double")
    begin, size = 0, first_leaves
    while begin < most:
        end = begin + size
        known = tops.groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("far"), F.count("*").alias("n"))
        state = queries.join(known, "id", "left").withColumn("kth", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))))

        def visits(frames: Iterator[pd.DataFrame], begin: int = begin, end: int = end) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for i, d, p, kth in frame[["id", "dim", "p", "kth"]].itertuples(index=False, name=None):
                    leaf, far = _order(boxes[d], np.asarray(p))
                    for one, distance in zip(leaf[begin:end], far[begin:end]):
                        # Nothing at an equal projected distance may be skipped while the k-th is at 0.
                        if distance > reach * kth * kth:
                            break
                        out.append((i, int(one)))
                yield pd.DataFrame(out, columns=["id", "leaf"])

        asked = state.mapInPandas(visits, "id long, leaf int")
        tasks = (
            asked.join(state, "id")
            .withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
            .groupBy("dim", "leaf", "qb")
            .agg(F.collect_list(F.struct("id", "v", "p", "kth")).alias("q"))
            .select(
                "dim",
                "leaf",
                F.transform("q", lambda x: x["id"]).alias("qids"),
                F.flatten(F.transform("q", lambda x: x["v"])).alias("qvs"),
                F.flatten(F.transform("q", lambda x: x["p"])).alias("qps"),
                F.transform("q", lambda x: x["kth"]).alias("kths"),
            )
        )
        tasks = pinned(tasks)
        if tasks.isEmpty():
            break
        found = tasks.join(idx.blocks, ["dim", "leaf"]).mapInArrow(
            lambda batches: _verify(batches, k, m, reach), "query_id long, vec_id long, score double"
        )
        place = Window.partitionBy("query_id").orderBy("score", "vec_id")
        merged = tops.unionByName(found).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        tops = pinned(merged.drop("rank"))
        begin, size = end, size * growth
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return tops.select("query_id", rank.alias("rank"), "vec_id", "score")


def _verify(batches: Iterator[pa.RecordBatch], k: int, m: int, reach: float) -> Iterator[pa.RecordBatch]:
    """For each pair of a query block and a row block, every query's k nearest rows by true distance."""
    for batch in batches:
        out_q, out_v, out_s = [], [], []
        for r in range(batch.num_rows):
            part = {name: np.asarray(batch.column(name)[r].values) for name in ("qids", "qvs", "qps", "kths", "ids", "vs", "ps")}
            d = batch.column("dim")[r].as_py()
            rows, rows_p = part["vs"].reshape(-1, d), part["ps"].reshape(-1, m)
            for i, (qid, kth) in enumerate(zip(part["qids"], part["kths"])):
                gap = rows_p - part["qps"][i * m : (i + 1) * m]
                near = part["ids"] != qid
                if np.isfinite(kth):
                    near &= np.einsum("ij,ij->i", gap, gap) <= reach * kth * kth * (1 + 1e-9)
                at = np.flatnonzero(near)
                diff = rows[at] - part["qvs"][i * d : (i + 1) * d]
                score = np.sqrt((diff * diff).sum(axis=1))
                ids = part["ids"][at]
                best = np.lexsort((ids, score))[:k]
                out_q.append(np.full(len(best), qid))
                out_v.append(ids[best])
                out_s.append(score[best])
        join = lambda xs, kind: pa.array(np.concatenate(xs) if xs else np.zeros(0), type=kind)
        yield pa.RecordBatch.from_arrays(
            [join(out_q, pa.int64()), join(out_v, pa.int64()), join(out_s, pa.float64())], names=["query_id", "vec_id", "score"]
        )
