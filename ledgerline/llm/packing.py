"""Filling fixed-capacity containers with texts.

Harmonic packing: a length s belongs to class k = floor(capacity / s), that is to (capacity / (k + 1), capacity / k],
and a container opened for class k holds exactly k documents of it; no further one would fit. Plain harmonic packing
(`harmonic`) stops there and leaves up to 1 / (k + 1) of each container empty. `classed` tops every container up with
documents of higher classes, the longest that still fit, one after another. Within a class lengths are told apart by
their exact token counts - there are at most `capacity` of them - so all of this is planned from counts alone, as
patterns that hold a fixed number of documents of each length and are repeated while the counts last. Documents are
packed in independent blocks, after one shuffle of two numbers a document.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Classes from here on (lengths up to capacity / SMALL) are one in plain harmonic packing: SMALL of them always fit.
SMALL = 64


def pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first token, length) of every piece: a text is cut only where it exceeds the capacity by itself."""
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, k * capacity, np.minimum(capacity, sizes[row] - k * capacity)


def patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(containers, [(length, documents of that length in each)]) until all counted lengths are used.

    Classes in rising order: a container takes its class's fixed number of documents, the longest first (fewer only
    where the class runs out), then of the higher classes the longest that fit.
    """
    left = dict(counts)
    lengths = sorted(left)
    while lengths:
        quota = capacity // lengths[-1]
        rest, top, used = capacity, len(lengths), []
        while rest and (top := bisect_right(lengths, rest, 0, top)):
            s = lengths[top - 1]
            of_class = capacity // s == capacity // lengths[-1]
            m = min(left[s], quota if of_class else rest // s)
            if m:
                used.append((s, m))
                rest -= m * s
                quota -= m if of_class else 0
            top -= 1
        times = min(left[s] // m for s, m in used)
        for s, m in used:
            left[s] -= m * times
            if not left[s]:
                del lengths[bisect_right(lengths, s) - 1]
        yield times, used


def classed(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each piece: harmonic classes, topped up."""
    order = np.argsort(-sizes, kind="stable")
    lengths, first, count = np.unique(-sizes[order], return_index=True, return_counts=True)
    at = {int(-s): int(f) for s, f in zip(lengths, first, strict=True)}
    out, base = np.zeros(len(sizes), np.int64), 0
    for times, used in patterns({int(-s): int(n) for s, n in zip(lengths, count, strict=True)}, capacity):
        for s, m in used:
            out[order[at[s] : at[s] + m * times]] = base + np.arange(m * times) // m
            at[s] += m * times
        base += times
    return out


def harmonic(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each piece, by plain harmonic classes."""
    k = np.minimum(capacity // sizes, SMALL)
    out, base = np.zeros(len(sizes), np.int64), 0
    for c in np.unique(k):
        row = np.nonzero(k == c)[0]
        out[row] = base + np.arange(len(row)) // c
        base += -(-len(row) // int(c))
    return out


_PACKED = "pack_name string, capacity_tokens long, container_id long, id long, first_token long, tokens long"


def packed(sizes: DataFrame, packs: list[tuple[str, int]], method: str = "classed", block: int = 250_000) -> DataFrame:
    """pack_name, capacity_tokens, container_id, id, first_token, tokens: every text with tokens, in each kind of container.

    sizes: id, tokens (a stored table). A task packs about `block` documents by itself, so only its last few
    containers stay part empty. container_id is unique within a pack; documents of one length are taken by id, so up
    to `block` documents are packed alike however they are partitioned. Documents of 0 or null tokens need no
    container; repeated ids are packed each; capacities under 1 are refused.
    """
    if any(c < 1 for _, c in packs):
        raise ValueError("a capacity is under 1 token")
    place = {"classed": classed, "harmonic": harmonic}[method]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by("id")
        ids, n = t["id"].combine_chunks(), t["tokens"].to_numpy()  # ids may be null
        part = TaskContext.get().partitionId() << 40
        for name, capacity in packs:
            row, start, length = pieces(n, capacity)
            where = part + place(length, capacity)
            out = pa.table({
                "pack_name": pa.array([name] * len(row), pa.string()), "capacity_tokens": np.full(len(row), capacity),
                "container_id": where, "id": ids.take(pa.array(row)), "first_token": start, "tokens": length,
            })
            yield from out.to_batches(max_chunksize=100_000)

    rows = sizes.filter("tokens > 0").selectExpr("cast(id as bigint) as id", "cast(tokens as bigint) as tokens")
    return rows.repartition(max(1, math.ceil(sizes.count() / block))).mapInArrow(scan, _PACKED)
