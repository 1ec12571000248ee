"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Centroids come from a bounded sample, split in halves until leaves are small, so lists are about
equally long. A vector near a boundary stands in several lists. The centroids nearest to a vector
are sought in a graph of centroids, held in memory; a query reads the lists whose centroid is not
much further than the nearest one. How many and how much further is measured: some queries are compared
with all vectors, and of the bounds by which enough of their true neighbours are found, those that
read least are taken. Lists are then matched with their queries as ordinary groups, a long list or one
with many queries in blocks. Of equal vectors no more than could be found go on, and of what a list
holds only what scores no less than the k-th best of those sample vectors that stand in the query's own lists. A
query that finds fewer than it asks for reads all lists. Inner products become distances by one more
component, which makes all candidates equally long; a query's is 0, and its length makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import kept

#: The most vectors that fitting uses (those of least hash), the wanted list length, and sample vectors a list at least.
SAMPLE_ROWS, LIST_ROWS, SAMPLE_A_LIST = 20_000, 400, 5
#: A vector joins at most so many lists, of centroids at most so many times as far as its nearest.
REPLICAS, REPLICA_RATIO = 2, 1.06
#: So many queries (those of least hash) are compared with all vectors; they must find this share of their true neighbours.
TRIALS, RECALL = 64, 0.95
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
NEIGHBOURS, BEAM, ENTRIES = 16, 12, 32
#: Bytes of the sample that queries are scored against to learn the least score that can count.
FLOOR_BYTES = 8 << 20
#: Partial answers of trial queries that a task merges.
MERGED = 256
#: Inner products by matrix multiplication are off by less than this, of the product of lengths.
SLACK = 1e-11
FOUND = "query_id long, vec_id long, score double"
DEALT = "list int, role boolean, id long, v binary, floor double"


class Graph(NamedTuple):
    """Centroids with one more component, each one's nearest others, and where a search begins."""

    centroids: np.ndarray
    near: np.ndarray
    entries: np.ndarray
    longest: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1, keepdims=True), 0))], 1)

    def routed(self, x: np.ndarray) -> np.ndarray:
        """Queries among lifted candidates: the nearest are those of largest inner product, whatever the candidates' lengths."""
        x = x / np.abs(x).max(1, keepdims=True)
        return np.concatenate([x * (self.longest / np.sqrt((x**2).sum(1, keepdims=True))), np.zeros((len(x), 1))], 1)

    def members(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists found for each vector, nearest first, and which of them it joins."""
        found, far = self.search(self.lifted(x), REPLICAS)
        return found, ((far <= REPLICA_RATIO * far[:, :1]) | (np.arange(found.shape[1]) == 0)) & np.isfinite(far)

    def search(self, x: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found for each row, nearest first, and their distances.

        All rows go best-first and in step, from the entries on; a row is done when none of its
        nearest centroids has neighbours left to look at.
        """
        n, k = len(x), len(self.centroids)
        wanted = min(wanted, k)
        beam = min(k, max(BEAM, wanted + wanted // 4))
        squares, own = (self.centroids**2).sum(1), (x**2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        far = squares[self.entries] - 2 * x @ self.centroids[self.entries].T
        open_ = np.ones(ids.shape, bool)

        def best(rows: np.ndarray, ids: np.ndarray, far: np.ndarray, open_: np.ndarray) -> None:
            top = np.argsort(far, 1, kind="stable")[:, :beam]
            for whole, part in zip(state, (ids, far, open_), strict=True):
                whole[rows, : top.shape[1]] = np.take_along_axis(part, top, 1)

        state = np.full((n, beam), -1), np.full((n, beam), np.inf), np.zeros((n, beam), bool)
        best(np.arange(n), ids, far, open_)
        ids, far, open_ = state
        while len(rows := np.flatnonzero((open_ & np.isfinite(far)).any(1))):
            at = np.argmax(open_[rows] & np.isfinite(far[rows]), 1)
            open_[rows, at] = False
            new = self.near[ids[rows, at]]
            fresh = ~seen[rows[:, None], new]
            seen[rows[:, None], new] = True
            d = np.where(fresh, squares[new] - 2 * np.einsum("nd,nkd->nk", x[rows], self.centroids[new]), np.inf)
            best(rows, np.concatenate([ids[rows], new], 1), np.concatenate([far[rows], d], 1), np.concatenate([open_[rows], fresh], 1))
        return ids[:, :wanted], np.sqrt(np.maximum(far[:, :wanted] + own[:, None], 0))


def halves(x: np.ndarray, leaf: int, seed: int = 7) -> np.ndarray:
    """Means of leaves of at most ``leaf`` rows: each part is cut at the median between two centres."""
    rng, todo, means = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        part = x[own]
        if len(own) <= leaf:
            means.append(part.mean(0))
            continue
        a, b = part[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = ((part - a) ** 2).sum(1) < ((part - b) ** 2).sum(1)
            if side.all() or not side.any():
                break
            a, b = part[side].mean(0), part[~side].mean(0)
        order = np.argsort(part @ (a - b), kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return np.array(means)


def build(sample: np.ndarray, lists: int, longest: float, rounds: int = 4) -> Graph:
    """Balanced centroids of the sample, drawn to their nearest vectors in a few rounds with a price on long lists."""
    bare = Graph(np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, int), longest)
    x = bare.lifted(sample)
    centroids = halves(x, max(1, -(-len(x) // lists)))
    sizes = np.full(len(centroids), len(x) / len(centroids))
    for _ in range(rounds):
        d = (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)
        price = d.min(1).mean() * 0.5 * (sizes / sizes.mean() - 1)
        own = (d + price).argmin(1)
        sizes = np.bincount(own, minlength=len(centroids)).astype(float)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    d = (centroids**2).sum(1)[:, None] - 2 * centroids @ centroids.T + (centroids**2).sum(1)
    near = np.argsort(d, 1, kind="stable")[:, 1 : NEIGHBOURS + 1] if len(centroids) > 1 else np.zeros((1, 0), int)
    far_apart = [0]
    while len(far_apart) < min(ENTRIES, len(centroids)):
        far_apart.append(int(d[far_apart].min(0).argmax()))
    # every centroid can be reached: each also points to the next in a ring
    ring = np.roll(np.arange(len(centroids)), -1)[:, None]
    return Graph(centroids, np.concatenate([near, ring], 1), np.array(far_apart), longest)


def usable(vector: Column) -> Column:
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda v: F.coalesce(number(v), F.lit(False))) & F.exists(vector, lambda v: v != 0)


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest found, by largest inner product.

    Queries are rows for which ``is_query`` holds; candidates all rows of other ids and the same number of
    components, of whatever length. A query with fewer candidates than ``k`` gets all of them. Ties go to the smaller id. Scores are sums of
    products in double precision, always in the same order, so equal vectors score equally. Rows of
    null id, and vectors that are null, zero, or hold null or non-finite components, take no part.
    Repeated rows count once. Other columns are not read. There are no more lists than a fifth of
    ``sample_rows``; beyond that lists grow longer, and a longer sample keeps them short. ``recall``
    is what the trial queries must reach; at 1 all lists that hold true neighbours of theirs are within bounds.
    """
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    v = v.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    longest = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    sizes = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), longest.alias("longest"), F.max("q").alias("asked")).where("asked").orderBy("dim").collect()
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"  # such vectors travel as they came
    found = vectors.sparkSession.createDataFrame([], FOUND)
    for size in sizes:
        found = found.unionByName(of_one_size(v.where(F.size("v") == size["dim"]), size["dim"], size["n"], size["longest"], k, sample_rows, list_rows, recall, single))
    return ranked(found, k)


def of_one_size(v: DataFrame, dim: int, n: int, longest: float, k: int, sample_rows: int, list_rows: int, recall: float, single: bool) -> DataFrame:
    """query_id, vec_id, score: the best of each query in each list that it reads."""
    rows = packed(v.orderBy(F.xxhash64("v"), "vec_id").limit(sample_rows)).collect()
    sample_ids, sample = np.frombuffer(b"".join(r["id"] for r in rows), np.int64), np.frombuffer(b"".join(r["v"] for r in rows)).reshape(-1, dim)
    lists = int(max(1, min(n // list_rows, len(sample) // SAMPLE_A_LIST)))
    graph = build(sample, lists, float(longest))
    probes, ratio = bounds(v, graph, dim, k, recall)
    _, first = np.unique(sample_ids, return_index=True)
    first = np.sort(first)[: FLOOR_BYTES // (8 * dim)]
    first = first[fewest(sample_ids[first], sample[first], k)]
    some_ids, some = sample_ids[first], sample[first]
    stands, joins = graph.members(some)

    def floors(ids: np.ndarray, x: np.ndarray, read: np.ndarray) -> np.ndarray:
        """Of each query, the k-th best score among the sample's others in the lists it reads: no candidate below it can be among its k."""
        if len(some) <= k:
            return np.full(len(x), -np.inf)
        s = x @ some.T
        there = np.zeros(s.shape, bool)
        for c in range(stands.shape[1]):
            there |= read[:, stands[:, c]] & joins[:, c]
        s[~there | (ids[:, None] == some_ids)] = -np.inf
        return np.partition(s, len(some) - k, 1)[:, len(some) - k]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                ids, q = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                few = fewest(ids, x, k)
                yield dealt_rows(False, *graph.members(x[few]), ids[few], x[few], np.zeros(len(few)), single)
                if q.any():
                    ids, x = ids[q], x[q]
                    found, far = graph.search(graph.routed(x), probes)
                    wanted = ((far <= ratio * np.maximum(far[:, :1], 1e-300)) | (np.arange(found.shape[1]) < least_probes(k, list_rows))) & np.isfinite(far)
                    read = np.zeros((len(x), len(graph.centroids)), bool)
                    r, c = np.nonzero(wanted)
                    read[r, found[r, c]] = True
                    yield dealt_rows(True, found, wanted, ids, x, floors(ids, x, read), single)

    def everywhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(graph.centroids))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                found = np.broadcast_to(every, (len(x), len(every)))
                yield dealt_rows(True, found, np.ones(found.shape, bool), part.column(0).to_numpy(zero_copy_only=False), x, np.full(len(x), -np.inf), single)

    dealt = kept(v.mapInArrow(assign, DEALT), "lists")
    found = matched(dealt, dim, k, float(longest), single)
    if probes >= len(graph.centroids) and not np.isfinite(ratio):
        return found
    found = kept(found, "found")
    enough = found.select("query_id", "vec_id").distinct().groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = v.where("q").join(enough, F.col("vec_id") == F.col("query_id"), "left_anti").select("vec_id", "v")
    more = kept(short.mapInArrow(everywhere, DEALT), "short")
    if more.isEmpty():
        return found
    return found.unionByName(matched(dealt.where("NOT role").unionByName(more), dim, k, float(longest), single))


def packed(rows: DataFrame) -> DataFrame:
    """Ids and vectors of the rows, each batch as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = (c.to_numpy(zero_copy_only=False).tobytes() for c in (b.column(0), b.column(1).flatten()))
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([x], pa.binary())], ["id", "v"])

    return rows.select("vec_id", "v").mapInArrow(run, "id binary, v binary")


def least_probes(k: int, list_rows: int) -> int:
    """Lists that every query reads, so that candidates fill its ``k``."""
    return 4 + 4 * k // list_rows


def fewest(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows without those of equal vectors that have ``k`` and one more of smaller id."""
    order = np.argsort(ids, kind="stable")
    same = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)[1][order]
    by = np.argsort(same, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], same[by][1:] != same[by][:-1]]))
    place = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return np.sort(order[by[place <= k]])


def bounds(v: DataFrame, graph: Graph, dim: int, k: int, recall: float) -> tuple[int, float]:
    """How many lists a query reads at most, and how much further than the nearest they may be.

    Some queries are compared with all vectors. Of the pairs of bounds within which enough of their true
    neighbours are found, that counts by which these queries read the fewest lists.
    """
    lists = len(graph.centroids)
    asked = [] if lists <= 4 else v.where("q").orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).select("vec_id", "v").collect()
    if not asked:
        return lists, float("inf")
    own, x = np.array([r["vec_id"] for r in asked]), np.array([r["v"] for r in asked])
    order, far = graph.search(graph.routed(x), lists)
    rows = np.arange(len(x))[:, None]
    place, further = np.empty((len(x), lists), np.int32), np.empty((len(x), lists), np.float32)
    place[rows, order], further[rows, order] = np.arange(lists), far / np.maximum(far[:, :1], 1e-300)

    def best(ids: np.ndarray, scores: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
        """The ``k`` of each row that score most, each id once; ids and scores are first among what is kept."""
        at = np.lexsort((ids, -scores), 1)
        ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
        again = np.zeros(ids.shape, bool)
        again[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (scores[:, 1:] == scores[:, :-1])
        top = np.argsort(again, 1, kind="stable")[:, :k]
        scores = np.where(again, -np.inf, scores)
        return [np.take_along_axis(a, top, 1) for a in (ids, scores, *(np.take_along_axis(o, at, 1) for o in others))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores, held = np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0)), np.zeros((0, dim))
        which = np.zeros((len(x), 0), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                y, new = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), b.column(0).to_numpy(zero_copy_only=False)
                s = x @ y.T
                s[own[:, None] == new] = -np.inf
                n = min(k, len(new))
                top = np.argpartition(-s, n - 1, 1)[:, :n]
                ids, scores, which = best(np.concatenate([ids, new[top]], 1), np.concatenate([scores, np.take_along_axis(s, top, 1)], 1), np.concatenate([which, top + len(held)], 1))
                used, which = np.unique(which, return_inverse=True)
                held, which = np.concatenate([held, y])[used], which.reshape(ids.shape)
        if not len(held):
            return
        parts = [graph.members(held[i : i + 1024]) for i in range(0, len(held), 1024)]
        found, member = (np.concatenate(p) for p in zip(*parts, strict=True))
        found, member = found[which], member[which]
        places = np.where(member, place[rows[:, :, None], found], lists)
        first = np.take_along_axis(found, places.argmin(2)[:, :, None], 2)[:, :, 0]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (ids, scores, places.min(2).astype(np.int32), further[rows, first])], ["ids", "scores", "places", "further"])

    kinds = {"ids": np.int64, "scores": np.float64, "places": np.int32, "further": np.float32}

    def together(rows: list[dict]) -> list[np.ndarray]:
        return best(*(np.concatenate([np.frombuffer(r[n], t).reshape(len(x), -1) for r in rows], 1) for n, t in kinds.items()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for at in range(0, b.num_rows, MERGED):
                held += b.slice(at, MERGED).to_pylist()
                held = [{n: a.astype(t).tobytes() for (n, t), a in zip(kinds.items(), together(held), strict=True)}]
        if held:
            yield pa.RecordBatch.from_pylist(held, pa.schema([(n, pa.binary()) for n in kinds]))

    schema = ", ".join(f"{n} binary" for n in kinds)
    partial = v.select("vec_id", "v").mapInArrow(compare, schema)
    tasks = v.rdd.getNumPartitions()
    while tasks > MERGED:
        tasks = -(-tasks // MERGED)
        partial = partial.repartition(tasks).mapInArrow(merge, schema)
    found = [r.asDict() for r in partial.collect()]
    if not found:
        return lists, float("inf")
    _, scores, places, further = together(found)
    real = np.isfinite(scores)
    places, further = places[real], further[real]
    if not len(places):
        return lists, float("inf")
    every = far / np.maximum(far[:, :1], 1e-300)
    choices = []
    for ratio in [*np.quantile(further, np.linspace(recall, 1, 12)), np.inf]:
        held = np.sort(places[(further <= ratio) & (places < lists)])
        need = int(np.ceil(recall * len(places)))
        if len(held) >= need:
            probes = int(held[need - 1]) + 1
            choices.append(((every[:, :probes] <= ratio).sum(), probes, float(ratio)))
    return min(choices)[1:] if choices else (lists, float("inf"))


def dealt_rows(role: bool, found: np.ndarray, chosen: np.ndarray, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, single: bool) -> pa.RecordBatch:
    x = x.astype(np.float32 if single else np.float64)
    r, c = np.nonzero(chosen)
    return pa.RecordBatch.from_arrays([pa.array(found[r, c].astype(np.int32)), pa.array([role] * len(r), pa.bool_()), pa.array(ids[r]), pa.array([x[i].tobytes() for i in r], pa.binary()), pa.array(floor[r])], ["list", "role", "id", "v", "floor"])


def matched(dealt: DataFrame, dim: int, k: int, longest: float, single: bool = False) -> DataFrame:
    """The ``k`` best of each query in each block of a list: query_id, vec_id, score."""
    counts = {(r["list"], r["role"]): r["n"] for r in dealt.groupBy("list", "role").agg(F.count("*").alias("n")).collect()}
    most = max((i for i, _ in counts), default=-1) + 1
    blocks = lambda role, size: [-(-counts.get((i, role), 0) // size) or 1 for i in range(most)]
    by = lambda role, size: F.get(F.split(F.lit(",".join(map(str, blocks(role, size)))), ",").cast("array<int>"), F.col("list"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("role"), by(True, BLOCK_QUERIES)).otherwise(by(False, BLOCK_ROWS)))
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("role"), by(False, BLOCK_ROWS)).otherwise(by(True, BLOCK_QUERIES)) - 1))
    cells = dealt.withColumn("own", own.cast("int")).select("*", others.alias("other"))
    cells = cells.select("list", F.when(F.col("role"), F.col("own")).otherwise(F.col("other")).alias("qb"), F.when(F.col("role"), F.col("other")).otherwise(F.col("own")).alias("cb"), "role", "id", "v", "floor")

    def best(group: pd.DataFrame) -> pd.DataFrame:
        role, ids = group["role"].to_numpy(bool), group["id"].to_numpy()
        vectors = np.frombuffer(b"".join(group["v"]), np.float32 if single else np.float64).reshape(-1, dim).astype(np.float64)
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        floor = group["floor"].to_numpy()
        c, q = np.flatnonzero(~role), np.flatnonzero(role)
        _, once = np.unique(ids[c], return_index=True)
        c = c[once]
        if len(c) and len(q):
            c = c[fewest(ids[c], vectors[c], k)]
            cv, cid = vectors[c], ids[c]
            for at in range(0, len(q), 256):
                x, own = vectors[q[at : at + 256]], ids[q[at : at + 256]]
                s = x @ cv.T
                s[own[:, None] == cid] = -np.inf
                n = min(k, len(cid))
                # all that rounding could bring among the first k, then exact scores of these
                last = np.maximum(np.partition(s, len(cid) - n, 1)[:, len(cid) - n], floor[q[at : at + 256]]) - SLACK * longest * np.sqrt((x**2).sum(1))
                i, j = np.nonzero((s >= last[:, None]) & np.isfinite(s))
                exact = (x[i] * cv[j]).sum(1)
                o = np.lexsort((cid[j], -exact, i))
                i, j, exact = i[o], j[o], exact[o]
                start = np.searchsorted(i, np.arange(len(own)))
                top = np.arange(len(i)) - start[i] < k
                out.append((own[i[top]], cid[j[top]], exact[top]))
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    return cells.groupBy("list", "qb", "cb").applyInPandas(best, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = F.struct((0.0 - F.col("score")).alias("less"), F.col("vec_id"))
    lists = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(best)), 1, k).alias("best"))
    rows = lists.select("query_id", F.posexplode("best").alias("at", "b"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (0.0 - F.col("b.less")).alias("score"))
