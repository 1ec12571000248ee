"""Vectors compressed to codes: each part of a vector becomes the index of the nearest entry of that part's codebook.

Codebooks are fitted by Lloyd's rounds over integers, so every result is exact. Rows are cut into
chunks; a chunk builds, once, a balanced kd-tree over each of its parts and writes it: points in tree order,
and for each node its bounding box, sum and count. A round walks all nodes of a level together. An
entry goes from a node's list where another one is nearer to the whole box; a node left with one entry
gives its sum and count as a whole, and only leaves with several compare their points one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a chunk, and points of a leaf, at most.
CHUNK_ROWS, LEAF = 4096, 16
#: Squared distances, four times as long, below this are reckoned in 64 bits; of larger numbers, all is left to Python's integers.
PLAIN = 1 << 62
#: Distinct labels up to which their sums are broadcast.
FEW_LABELS = 10_000


class Tree(NamedTuple):
    """Points of one part of a chunk in tree order; ``bounds[l]`` cuts them into the nodes of level l."""

    order: np.ndarray
    points: np.ndarray
    bounds: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def levels(n: int) -> list[np.ndarray]:
    """Where the nodes of each level begin and end: halves, until no leaf has more than ``LEAF`` points."""
    out = [np.array([0, n])]
    while -(-n // (len(out[-1]) - 1)) > LEAF:
        k = 2 * (len(out[-1]) - 1)
        out.append(np.arange(k + 1) * n // k)
    return out


def tree(points: np.ndarray, order: np.ndarray | None = None) -> Tree:
    """The tree of these points; with ``order``, the points are in tree order already."""
    bounds = levels(len(points))
    if order is None:
        order = np.arange(len(points))
        for cut in bounds[:-1]:
            if not points.shape[1]:
                break
            now = points[order]
            spread = np.maximum.reduceat(now, cut[:-1]) - np.minimum.reduceat(now, cut[:-1])
            node = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            widest = np.array([max(range(len(s)), key=s.__getitem__) for s in spread]) if points.dtype == object else spread.argmax(1)
            order = order[np.lexsort((now[np.arange(len(now)), widest[node]], node))]
        points = points[order]
    low, high, sums = ([f.reduceat(points, bounds[-1][:-1])] for f in (np.minimum, np.maximum, np.add))
    for _ in bounds[:-1]:
        low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
        high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
        sums.insert(0, sums[0][::2] + sums[0][1::2])
    return Tree(order, points, bounds, low, high, sums)


def far(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each entry."""
    return ((points[:, None, :] - entries) ** 2).sum(2)


def assigned(t: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(entry, begin, end, level) of the nodes that go to one entry as a whole, by level; then of single points, at level -1."""
    nodes, listed = np.array([0]), np.ones((1, len(entries)), bool)
    for level, cut in enumerate(t.bounds):
        low, high = t.low[level][nodes], t.high[level][nodes]
        # twice the middle, so that it stays a whole number; distances to it then are four times as long
        d = ((2 * entries - (low + high)[:, None, :]) ** 2).sum(2)
        best = np.array([min(np.flatnonzero(k), key=x.__getitem__) for x, k in zip(d, listed, strict=True)]) if d.dtype == object else np.where(listed, d, np.iinfo(np.int64).max).argmin(1)
        # of the box, the corner furthest towards an entry is where that entry is best, next to the node's best one
        near = entries[best][:, None, :]
        corner = np.where(entries > near, high[:, None, :], low[:, None, :])
        lead = ((corner - entries) ** 2).sum(2) - ((corner - near) ** 2).sum(2)
        worse = (lead > 0) | ((lead == 0) & (np.arange(len(entries)) > best[:, None]))
        listed &= ~worse.astype(bool)
        listed[np.arange(len(nodes)), best] = True
        single = listed.sum(1) == 1
        yield best[single], cut[nodes[single]], cut[nodes[single] + 1], level
        nodes, listed = nodes[~single], listed[~single]
        if not len(nodes):
            return
        if level + 1 < len(t.bounds):
            nodes, listed = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(listed, 2, 0)
    size = cut[nodes + 1] - cut[nodes]
    at = np.repeat(cut[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    d, listed = far(t.points[at], entries), np.repeat(listed, size, 0)
    best = np.array([min(np.flatnonzero(k), key=x.__getitem__) for x, k in zip(d, listed, strict=True)]) if d.dtype == object else np.where(listed, d, np.iinfo(np.int64).max).argmin(1)
    yield best, at, at + 1, -1


def totals(t: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points of each entry."""
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    for best, begin, end, level in assigned(t, entries):
        whole = t.points[begin] if level < 0 else t.sums[level][np.searchsorted(t.bounds[level], begin)]
        np.add.at(sums, best, whole)
        np.add.at(counts, best, end - begin)
    return sums, counts


def codes(t: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, and its squared distance, of each point in the order it came."""
    code = np.empty(len(t.points), np.int64)
    for best, begin, end, level in assigned(t, entries):
        if level < 0:
            code[begin] = best
        else:
            size = end - begin
            code[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(best, size)
    error = ((t.points - entries[code]) ** 2).sum(1)
    back = np.empty(len(code), np.int64)
    back[t.order] = np.arange(len(code))
    return code[back], error[back]


def cuts(dim: int) -> list[int]:
    return [dim * i // PARTS for i in range(PARTS + 1)]


def integers(x: np.ndarray, wide: bool) -> np.ndarray:
    """floor(4096 * x) of each component, exactly."""
    if not wide:
        return np.floor(x * float(SCALE)).astype(np.int64)
    return np.array([n * SCALE // d for n, d in map(float.as_integer_ratio, x.ravel().tolist())], object).reshape(x.shape)


def trees(rows: DataFrame, dim: int, wide: bool) -> DataFrame:
    """Chunks of rows: their ids and labels, and of each part the tree's order and points."""
    cut = cuts(dim)

    def packed(x: np.ndarray) -> bytes:
        return "\n".join(map(str, x.ravel())).encode() if wide else x.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                b = whole.slice(at, CHUNK_ROWS)
                x = integers(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim), wide)
                built = [tree(x[:, i:j]) for i, j in zip(cut, cut[1:], strict=False)]
                lists = [pa.array([v], pa.list_(kind)) for v, kind in ((b.column(0).to_pylist(), pa.int64()), (b.column(1).to_pylist(), pa.string()), ([t.order.astype(np.int32).tobytes() for t in built], pa.binary()), ([packed(t.points) for t in built], pa.binary()))]
                yield pa.RecordBatch.from_arrays(lists, ["ids", "labels", "orders", "points"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, "ids array<long>, labels array<string>, orders array<binary>, points array<binary>")


def reopened(orders: list[bytes], points: list[bytes], dim: int, wide: bool) -> list[Tree]:
    """The trees of a written chunk."""
    cut, out = cuts(dim), []
    for order, raw, i, j in zip(orders, points, cut, cut[1:], strict=False):
        order = np.frombuffer(order, np.int32)
        flat = np.array([*map(int, raw.split())], object) if wide else np.frombuffer(raw, np.int64)
        out.append(tree(flat.reshape(len(order), j - i), order))
    return out


def first_entries(rows: DataFrame, dim: int, wide: bool) -> list[np.ndarray]:
    """The codebooks that rounds begin with: the parts of the rows of least vec_id."""
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(ENTRIES).collect() or rows.orderBy("v").limit(ENTRIES).collect()
    x = integers(np.array([r["v"] for r in first], float).reshape(len(first), dim), wide)
    cut = cuts(dim)
    return [x[:, i:j] for i, j in zip(cut, cut[1:], strict=False)]


def one_round(chunks: DataFrame, books: list[np.ndarray], dim: int, wide: bool) -> list[np.ndarray]:
    """The codebooks after a round: sums come in as one packed row a task, are added per part and entry by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for orders, points in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, t in enumerate(reopened(orders, points, dim, wide)):
                    s, n = totals(t, books[k])
                    sums[k], counts[k] = sums[k] + s, counts[k] + n
        rows = [(k, e, int(c), int(counts[k][e]), str(v)) for k, s in enumerate(sums) for e in range(len(s)) for c, v in enumerate([0, *s[e]], -1)]
        part, entry, place, n, total = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32()) for x in (part, entry, place)], pa.array(n, pa.int64()), pa.array(total, pa.string())], ["part", "entry", "place", "n", "total"])

    found = chunks.select("orders", "points").mapInArrow(run, "part int, entry int, place int, n long, total string")

    def added(group: pd.DataFrame) -> pd.DataFrame:
        """One row a task, of numbers too large for Spark's."""
        return group.head(1).assign(n=group["n"].sum(), total=str(sum(map(int, group["total"]))))

    new, groups = [b.copy() for b in books], found.groupBy("part", "entry", "place")
    total = groups.applyInPandas(added, found.schema) if wide else groups.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("long")).alias("total"))
    for r in total.where("n > 0 AND place >= 0").collect():
        new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return new


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of all entries, in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def of_one_size(keep: Scratch, rows: DataFrame, dim: int, wide: bool) -> DataFrame:
    books = first_entries(rows, dim, wide)
    chunks = keep(trees(rows, dim, wide), "trees")
    for _ in range(ROUNDS):
        books = one_round(chunks, books, dim, wide)
    sha = digest(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, orders, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [codes(t, b) for t, b in zip(reopened(orders, points, dim, wide), books, strict=True)]
                names = [bytes(c).hex() for c in np.stack([c for c, _ in found], 1).astype(np.uint8)]
                error = [str(x) for x in sum(e for _, e in found)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(names), pa.array(error, pa.string())], ["vec_id", "label", "code", "error"])

    coded = chunks.select("ids", "labels", "orders", "points").mapInArrow(run, "vec_id long, label string, code string, error string")
    return coded.select("vec_id", "label", "code", F.col("error").try_cast("long").alias("error"), F.lit(sha).alias("codebooks_sha256"))


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A row per vector that is not null and holds finite components only: vec_id, code, error, label_error, codebooks_sha256.

    Codebooks begin with the vectors of least vec_id (of equal ids, the least vectors first; null ids only if
    there are no others) and are fitted on all rows, repeated ones and null ids included; with fewer than
    ``ENTRIES`` rows there are fewer entries. Vectors of another number of components have codebooks of
    their own; if it isn't a multiple of ``PARTS``, parts are as equal as can be, empty ones too. Rows of
    equal labels, over all sizes, share label_error; null labels are equal. Components too large for 64 bits
    are reckoned with Python's integers; an error, or sum of errors, beyond a long is null. An
    empty table gives none. To the driver go one codebook a round and size. Other columns are not read.
    """
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    v = v.where(F.col("v").isNotNull() & F.forall("v", finite))
    largest = F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))), F.lit(0.0))
    sizes = v.groupBy(F.size("v").alias("dim")).agg(largest.alias("largest")).orderBy("dim").collect()
    result = Scratch(vectors.sparkSession)
    with Scratch(vectors.sparkSession) as keep:
        coded = vectors.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long, codebooks_sha256 string")
        for size in sizes:
            width = size["dim"] // PARTS + 1
            wide = 16 * width * (SCALE * int(size["largest"]) + SCALE) ** 2 >= PLAIN
            coded = coded.unionByName(of_one_size(keep, v.where(F.size("v") == size["dim"]), size["dim"], wide))
        coded = result(coded, "codes")
    by_label = result(coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error")), "labels").withColumnRenamed("label", "of")
    if by_label.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        by_label = F.broadcast(by_label)
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
