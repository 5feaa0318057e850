"""Token ids packed into rows of fixed length by best-fit decreasing.

Overlong documents are split without loss into segments of at most one row's length.
Segments of a pool go in order of falling length into the fullest row that still has
room; a segment tree over capacities finds that row in logarithmic time. Each row
carries its ids, cumulative segment lengths, and the places where positions restart.

Pools are filled per task up to ``pool`` segments, so memory is bounded and no
shuffle is needed; a lost task packs its own input again, with the same result.
Null and empty texts have no ids and are in no row. Repeated rows are packed as
often as they occur; segments say which document and part they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.bpe import rank_pairs, read_ranks
from churnscope.llm.common import bound_batches


@dataclass(frozen=True)
class PackOptions:
    length: int = 2048
    pool: int = 4096
    pad: int = 0


class CapacityTree:
    """Counts of open rows by free room; finds the least room that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += n
            at >>= 1

    def least_from(self, room: int) -> int | None:
        """The smallest room >= ``room`` that an open row has."""
        at = self.size + room
        if self.count[at]:
            return room
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of segment numbers; equal lengths keep their order, rows fill in order of opening."""
    rows: list[list[int]] = []
    with_room: dict[int, list[int]] = {}
    tree = CapacityTree(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least_from(lengths[i])
        if room is None:
            rows.append([])
            row, room = len(rows) - 1, capacity
        else:
            row = with_room[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        left = room - lengths[i]
        if left:
            with_room.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def split_ids(ids: np.ndarray, length: int) -> list[np.ndarray]:
    return [ids[k : k + length] for k in range(0, len(ids), length)]


def _packer(options: PackOptions):
    def flush(segments: list[tuple[int | None, int, np.ndarray]]) -> pd.DataFrame:
        out = []
        for row in best_fit_decreasing([len(s[2]) for s in segments], options.length):
            parts = [segments[i] for i in row]
            ids = np.full(options.length, options.pad, dtype=np.uint32)
            ends = np.cumsum([len(p[2]) for p in parts])
            ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
            starts = [0, *ends[:-1].tolist()]
            out.append((ids.tobytes(), [0, *ends.tolist()], starts, [p[0] for p in parts], [p[1] for p in parts], int(ends[-1])))
        return pd.DataFrame(out, columns=["ids", "cu_lengths", "position_resets", "doc_ids", "parts", "n_tokens"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool: list[tuple[int | None, int, np.ndarray]] = []
        for batch in batches:
            for doc_id, packed in zip(batch["doc_id"].astype("Int64"), batch["_ids"].array):
                doc = None if doc_id is pd.NA else int(doc_id)
                for k, part in enumerate(split_ids(np.frombuffer(packed, np.uint32), options.length)):
                    pool.append((doc, k, part))
                    if len(pool) == options.pool:
                        yield flush(pool)
                        pool = []
        if pool:
            yield flush(pool)

    return pack


SCHEMA = "ids binary, cu_lengths array<int>, position_resets array<int>, doc_ids array<long>, parts array<int>, n_tokens int"


def pack_documents(docs: DataFrame, rank_path: str, pattern: str, options: PackOptions = PackOptions()) -> DataFrame:
    """One row per packed sequence: ``length`` ids (32-bit, padded), cumulative lengths of
    its segments from 0, starts at which positions restart, and each segment's origin.

    Packing is the matter here, so ids come from the tiktoken library, which gives the
    same ids as ``bpe``. Text to rows is one map, in one Python worker a task.
    """
    bound_batches(docs.sparkSession)
    data = read_ranks(rank_path)

    def encode_and_pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(rank_pairs(data)), special_tokens={})
        ids = lambda t: np.array(coder.encode_ordinary(t), dtype=np.uint32).tobytes() if t else b""
        yield from pack(pd.DataFrame({"doc_id": b["doc_id"], "_ids": [ids(t) for t in b["text"].array]}) for b in batches)

    pack = _packer(options)
    return docs.select("doc_id", "text").mapInPandas(encode_and_pack, SCHEMA)


def positions(packed: pd.Series, length: int) -> np.ndarray:
    """Position ids of a row: counting from 0 anew at each reset, 0 in the padding."""
    out = np.zeros(length, dtype=np.int32)
    for a, b in zip(packed["cu_lengths"], packed["cu_lengths"][1:]):
        out[a:b] = np.arange(b - a)
    return out


def write_packed(docs: DataFrame, path: str, rank_path: str, pattern: str, options: PackOptions = PackOptions()) -> None:
    """Write the matrices as Parquet files of rows: ids, cumulative lengths, resets, origins."""
    pack_documents(docs, rank_path, pattern, options).write.mode("error").parquet(path)


def read_matrix(df: DataFrame, length: int) -> Iterator[np.ndarray]:
    """Id matrices of [rows, length], one per Arrow batch, streamed to the reader."""
    for row in df.select(F.col("ids")).toLocalIterator():
        yield np.frombuffer(row[0], np.uint32).reshape(-1, length)
