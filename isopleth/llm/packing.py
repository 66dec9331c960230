"""Best-fit packing of tokenized documents into fixed-length sequences by sums of squares."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isopleth.llm.tables import if_small
from isopleth.session import pinned, small_batches, written

#: Splitting pattern of the byte-level vocabulary.  Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Where a vocabulary file of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary of ``path`` in a faster encoder with the same ids.

    The file's merges are in the order of its ids, so ranks are ids.  Special
    tokens in a text become their ids, as they do in the file's own library.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of = _byte_of_char()
    ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of one text and the closing 0; no text gives the 0 alone."""
    ids = encoder(path).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, 0).astype("<u4")


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    keep_ids: bool = False,
) -> DataFrame:
    """Each document's ids cut into pieces of at most ``length``: doc_id, piece, start, length, ids_crc32 [, ids].

    Only documents longer than ``length`` are cut; their first piece takes the
    remainder, the others are full.  Null text counts as empty; a null id and
    repeated rows are kept.  Other columns are not read.
    """
    key = docs.schema[id_col].dataType
    fields = [
        T.StructField("doc_id", key),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, text in zip(frame["k"].tolist(), frame["t"].tolist()):
                ids = token_ids(text, tokenizer)
                first = len(ids) % length or length
                starts = [0, *range(first, len(ids), length)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    row = (k, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    rows.append(row + (ids[a:b].astype(np.int32),) if keep_ids else row)
            out = pd.DataFrame(rows, columns=[f.name for f in fields])
            if isinstance(key, T.IntegralType):
                out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    # Integers travel as text where null, so that large ids stay exact.
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    if not isinstance(key, T.IntegralType):
        return source.mapInPandas(cut, T.StructType(fields))
    exact = source.select(F.col("k").cast("string").alias("k"), "t")

    def cut_exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [None if k is None else int(k) for k in frame["k"].tolist()]
            yield from cut([frame.assign(k=pd.array(ids, dtype="Int64"))])

    return exact.mapInPandas(cut_exact, T.StructType(fields))


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each size, placed in the given order.

    A size goes to the open sequence for which the sum over gaps of (number of
    open sequences with that gap) squared becomes smallest; ties go to the
    smaller gap.  A new sequence is opened where none has room.  Work per size
    is one pass over the gaps, whatever the number of sequences.
    """
    open_with = np.zeros(length + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    where = np.empty(len(sizes), dtype=np.int64)
    offset = np.empty(len(sizes), dtype=np.int64)
    n = 0
    for i, s in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(open_with[s:])
        if s < length and len(gaps):
            change = 2 * (open_with[gaps] - open_with[gaps + s] + 1)
            if gaps[0] == 0:  # an exact fit closes the sequence
                change[0] = 1 - 2 * open_with[s]
            gap = int(gaps[np.argmin(change)]) + s
            sequence = stacks[gap].pop()
            open_with[gap] -= 1
        else:
            gap, sequence, n = length, n, n + 1
        where[i], offset[i] = sequence, length - gap
        if gap > s:
            stacks[gap - s].append(sequence)
            open_with[gap - s] += 1
    return where, offset


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    group_rows: int = 50_000,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``.

    Pieces are dealt to groups of about ``group_rows`` by row position, so a
    repeated id does not fill one group; each group packs on its own, longest
    first, which costs at most a few part-filled sequences per group.  A group
    holds numbers only: with ``keep_ids`` (array of long) its rows are numbered
    and the ids of a row wait where they were written for its place.  An empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    cut = pieces(docs, tokenizer or public_tokenizer(), id_col, text_col, length, keep_ids)
    if not keep_ids:
        return _placed(pinned(cut), length, group_rows)
    # Written, not cached: a row that is made again must not get another number.
    cut = written(cut.withColumn("_row", F.monotonically_increasing_id()))
    sizes = cut.select("_row", "piece", "length", "ids_crc32")
    places = written(_placed(sizes, length, group_rows).select("_row", "sequence_id", "offset"))
    whole = cut.join(if_small(places), "_row")
    return whole.select(*cut.drop("_row", "ids").columns, F.col("ids").cast("array<long>").alias("ids"), "sequence_id", "offset")


def _placed(cut: DataFrame, length: int, group_rows: int) -> DataFrame:
    """The kept rows ``piece, length, ids_crc32`` and more with ``sequence_id`` and ``offset``."""
    groups = max(1, math.ceil(cut.count() / group_rows))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    integral = "doc_id" in cut.columns and isinstance(cut.schema["doc_id"].dataType, T.IntegralType)

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((frame["ids_crc32"], frame["piece"], -frame["length"]))
        frame = frame.iloc[order]
        group = int(frame["_group"].iloc[0])
        where, offset = sum_of_squares(frame["length"].to_numpy(), length)
        out = frame.drop(columns="_group").assign(sequence_id=where + (group << 40), offset=offset)
        if integral:
            out["doc_id"] = pd.array([None if k is None else int(k) for k in out["doc_id"].tolist()], dtype="Int64")
        return out

    dealt = cut.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    if integral:
        dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    return dealt.groupBy("_group").applyInPandas(place, schema)
