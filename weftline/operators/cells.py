"""Scores of all documents for many queries as sums over shared terms, in cells of documents and queries: no pair is ever a row.

Documents (group, id, scale, terms, tfs) and queries (group, query_id, terms, weights, and what a fold asks for) are dealt
into blocks by hash, by how many terms they hold, so a cell's size is bounded whatever the tables hold. Within a cell a
query's terms are added up in their order over posting arrays, and a fold makes a few rows of it. Terms are 64-bit
hashes; two of ten million terms meet with odds of 3e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.shared import kept

#: Terms of a block of documents, and of a block of queries.
DOC_TERMS, QUERY_TERMS = 1_500_000, 2_000_000
#: Scores have so many digits.
DIGITS = 6
#: Blocks of cosines hold so many times these terms, but a table makes so many blocks, if they hold a third of DOC_TERMS at least.
WIDER, LEAST_BLOCKS = 5, 32
#: Words of a part of a group's words on average, and bits of a place in it.
PART_WORDS, PLACE_BITS = 1 << 16, 17
#: Queries scored at once, if their scores are so many at most; documents of a product; a word is a row of a matrix if it is in more than one of so many.
BATCH, BATCH_CELLS, TILE, COMMON = 256, 8_000_000, 2048, 16

Part = Callable[[np.ndarray, np.ndarray], np.ndarray]
Fold = Callable[[pa.Table, pa.Table, np.ndarray, Iterator], dict]


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each row's begin."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)


def of_cell(docs: pa.Table, queries: pa.Table, part: Part) -> tuple[np.ndarray, Iterator]:
    """Ids in order, and for each query its number, its scores of these (a buffer that is used again) and which of them share a term with it."""
    ids, place = np.unique(docs["id"].to_numpy(), return_inverse=True)
    terms, ends = flat(docs["terms"])
    tfs, row = flat(docs["tfs"])[0], np.repeat(np.arange(len(place)), np.diff(ends))
    wanted, at = flat(queries["terms"])
    weights = flat(queries["weights"])[0]
    known, which = np.unique(wanted, return_inverse=True)
    if len(known):
        slot = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        has = known[slot] == terms
        slot, row, tfs = slot[has], row[has], tfs[has]
        order = np.argsort(slot, kind="stable")
        slot, row, tfs = slot[order], row[order], tfs[order]
        parts = part(tfs, docs["scale"].to_numpy()[row])
        row = place[row]
        starts = np.searchsorted(slot, np.arange(len(known) + 1))
    once, wide = len(ids) == len(place), {}

    def add(s: np.ndarray, t: int, weight: float) -> None:
        low, high = starts[t], starts[t + 1]
        if high - low > len(ids) / 8:
            if t not in wide:
                wide[t] = np.zeros(len(ids))
                np.add.at(wide[t], row[low:high], parts[low:high])
            s += weight * wide[t]
        elif once:
            s[row[low:high]] += weight * parts[low:high]
        elif high > low:
            np.add.at(s, row[low:high], weight * parts[low:high])

    def each() -> Iterator:
        s = np.zeros(len(ids))
        for i in range(len(at) - 1):
            s[:] = 0
            own = slice(at[i], at[i + 1])
            for t, weight in zip(which[own].tolist(), weights[own].tolist(), strict=True):
                add(s, t, weight)
            if (weights[own] > 0).all():
                touched = s > 0
            else:
                touched = np.zeros(len(ids), bool)
                for t in which[own].tolist():
                    touched[row[starts[t] : starts[t + 1]]] = True
            yield i, s, touched

    return ids, each()


def folded(docs: DataFrame, queries: DataFrame, part: Part, fold: Fold, schema: str) -> DataFrame:
    """What ``fold`` makes of every cell: it gets the cell's documents and queries, ids in order and ``of_cell``'s rows, and returns columns. Rows of null ids take no part."""
    blocks = lambda c, most: F.greatest(F.ceil(F.sum(F.size(c).cast("long")) / most), F.lit(1)).cast("int")
    docs, queries = docs.where("id IS NOT NULL"), queries.where("query_id IS NOT NULL")
    sizes = docs.groupBy("group").agg(blocks("terms", DOC_TERMS).alias("doc_blocks")).join(queries.groupBy("group").agg(blocks("terms", QUERY_TERMS).alias("query_blocks")), "group")
    sizes = kept(sizes, "cells")  # a row a group
    n = sizes.agg(F.coalesce(F.sum(F.col("doc_blocks").cast("long") * F.col("query_blocks")), F.lit(1)).alias("n")).first()["n"]
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c, b: F.pmod(F.xxhash64(c, F.lit(1)), F.col(b)).cast("int")
    keys = ["group", "a", "b"]
    deal = lambda rows, a, b: rows.join(sizes, "group").select("*", a.alias("a")).select("*", b.alias("b")).drop("doc_blocks", "query_blocks").repartition(min(2 * n, 4000), *keys)
    left = deal(docs, place("id", "doc_blocks"), spread("query_blocks")).groupBy(*keys)
    right = deal(queries, spread("doc_blocks"), place("query_id", "query_blocks")).groupBy(*keys)
    types = pa.schema([(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}[c.split()[1]]) for c in schema.split(", ")])

    def cell(d: pa.Table, q: pa.Table) -> pa.Table:
        if not d.num_rows or not q.num_rows:
            found = {c: [] for c in types.names}
        else:
            found = fold(d, q, *of_cell(d, q, part))
        return pa.table({c: found[c] for c in types.names}, schema=types)

    return left.cogroup(right).applyInArrow(cell, schema)


def best_of(k: int) -> tuple[Fold, str]:
    """query_id, id, score: each query's ``k`` best of a cell."""

    def fold(docs: pa.Table, queries: pa.Table, ids: np.ndarray, rows: Iterator) -> dict:
        names, out = queries["query_id"].to_numpy(), [[], [], []]
        for i, s, touched in rows:
            # rounding keeps order, so what it makes equal to the k-th lies within a digit of it
            at = np.flatnonzero(touched)
            if len(at) > k:
                at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k] - 10.0**-DIGITS]
            score = np.round(s[at], DIGITS) + 0.0
            o = np.lexsort((at, -score))[:k]
            for column, values in zip(out, (np.full(len(o), names[i]), ids[at[o]], score[o]), strict=True):
                column.append(values)
        return {c: np.concatenate(v) if v else [] for c, v in zip(("query_id", "id", "score"), out, strict=True)}

    return fold, "query_id long, id long, score double"


def places(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order (equal ones stay), and the postings of a block: its distinct terms, where each one's rows begin, the rows."""
    terms, ends = flat(docs["terms"])
    by = np.argsort(docs["id"].to_numpy(), kind="stable")
    at = np.empty(len(by), np.int32)
    at[by] = np.arange(len(by))
    order = np.argsort(terms, kind="stable")
    terms, rows = terms[order], np.repeat(at, np.diff(ends))[order]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
    return docs["id"].to_numpy()[by], terms[first], np.append(first, len(terms)), rows


def sums(postings: tuple[np.ndarray, np.ndarray], columns: int, asked: list[tuple[np.ndarray, np.ndarray]], common: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A row a query (its terms' numbers, their weights), a column a row of the block: terms of ``common`` (their row of ``matrix``, or -1) by products, others along their postings."""
    starts, rows = postings
    own, s = np.zeros((len(asked), len(matrix))), np.zeros((len(asked), columns))
    for i, (t, weight) in enumerate(asked):
        wide = common[t] >= 0
        own[i] = np.bincount(common[t[wide]], weight[wide], len(matrix))
    for low in range(0, columns, TILE):
        s[:, low : low + TILE] = own @ matrix[:, low : low + TILE].astype(float)
    for i, (t, weight) in enumerate(asked):
        t, weight = t[common[t] < 0], weight[common[t] < 0]
        n = starts[t + 1] - starts[t]
        ends = np.cumsum(n)
        if len(ends):
            s[i] += np.bincount(rows[np.arange(ends[-1]) + np.repeat(starts[t] - ends + n, n)], np.repeat(weight, n), columns)
    return s


def best_cosines(docs: pa.Table, words: pa.Table, marks: pa.Table, asked: pa.Table, k: int, sided: bool) -> dict:
    """query_id, id, score, side: each query's ``k`` best of a cell (with ``sided``, of either side) but for ``exclude``.

    Words that the group's table lacks are in one document. Rows of one id count together.
    """
    ids, distinct, starts, rows = places(docs)
    words = words.sort_by("part")
    (known, ends), df = flat(words["terms"]), flat(words["dfs"])[0]
    n, offset = words["n"][0].as_py(), np.zeros(words["part"][-1].as_py() + 1, int)
    offset[words["part"].to_numpy()] = ends[:-1]
    order = np.argsort(known)
    at = order[np.minimum(np.searchsorted(known, distinct, sorter=order), len(known) - 1)]
    has = known[at] == distinct
    number = np.full(len(known), -1)
    number[at[has]] = np.flatnonzero(has)
    square = np.bincount(rows, np.repeat(np.log(n / np.where(has, df[at], 1)) ** 2, np.diff(starts)), len(ids))

    columns, first = len(ids), np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    twice = len(first) < len(ids)
    ids, square = ids[first], np.add.reduceat(square, first)
    marks = marks.filter(pc.is_in(marks["id"], pa.array(ids)))  # documents without words have marks too
    marked = marks.filter(pc.is_valid(marks["square"]))
    square[np.searchsorted(ids, marked["id"].to_numpy())] = marked["square"].to_numpy()
    norm = np.sqrt(square)
    inverse = np.divide(1, norm, out=np.zeros(len(norm)), where=norm > 0)
    sides = {None: np.ones(len(ids), bool)} if not sided else {s: np.zeros(len(ids), bool) for s in (True, False)}
    for s in sides if sided else ():
        sides[s][np.searchsorted(ids, marks.filter(pc.equal(marks[str(s).lower()], True))["id"].to_numpy())] = True

    wide = np.flatnonzero(np.diff(starts) > columns / COMMON)
    common, matrix = np.full(len(distinct), -1), np.zeros((len(wide), columns), np.uint8)
    common[wide] = np.arange(len(wide))
    for i, t in enumerate(wide):
        matrix[i, rows[starts[t] : starts[t + 1]]] = 1

    names, less, (slots, ends) = asked["query_id"].to_numpy(), asked["exclude"].to_numpy(), flat(asked["slots"])
    slots = offset[slots >> PLACE_BITS] + (slots & (1 << PLACE_BITS) - 1)
    weights, terms, out = np.log((n - 1) / (df[slots] - 1)) ** 2, number[slots], ([], [], [], [])
    step = max(1, min(BATCH, BATCH_CELLS // columns))
    for low in range(0, len(names), step):
        own = [slice(ends[i], ends[i + 1]) for i in range(low, min(low + step, len(names)))]
        s = sums((starts, rows), columns, [(terms[o][terms[o] >= 0], weights[o][terms[o] >= 0]) for o in own], common, matrix)
        s = np.add.reduceat(s, first, axis=1) if twice else s
        for i, o in enumerate(own, low):
            found, q_norm = s[i - low], np.sqrt(weights[o].sum())
            found[ids == less[i]] = 0
            near = found * (inverse / q_norm) if q_norm else found
            for side, among in sides.items():
                # rounding keeps order, so what it makes equal to the k-th lies within a digit of it
                likely = np.where(among, near, 0) if sided else near
                least = np.partition(likely, len(ids) - k)[len(ids) - k] if len(ids) > k else 0
                at = np.flatnonzero((likely > 0) & (likely >= least - 1.01 * 10.0**-DIGITS))
                score = np.round(found[at] / (q_norm * norm[at]), DIGITS) + 0.0
                order = np.lexsort((at, -score))[:k]
                for column, values in zip(out, (np.full(len(order), names[i]), ids[at[order]], score[order], np.full(len(order), side)), strict=True):
                    column.append(values)
    return {c: np.concatenate(v) for c, v in zip(("query_id", "id", "score", "side"), out, strict=True)}


def cosines(docs: DataFrame, words: DataFrame, marks: DataFrame, asked: DataFrame, k: int, sided: bool) -> DataFrame:
    """query_id, id, score (and side): candidates for each query's ``k`` best of its group, by weights that a cell makes of the group's words.

    Documents (group, id, terms) are shuffled once for each block of queries. A block of them meets its group's words
    (group, part, n, terms, dfs: in how many of ``n`` documents a term is), queries as numbers of these (group, query_id, exclude, slots)
    and what is known of single documents (``marks``: group, id, square: a norm's square that isn't made in one group; true, false: its sides).
    Blocks are wide, as words and queries are written once for each; a small table makes smaller ones, for all tasks.
    """
    docs, asked = docs.where("id IS NOT NULL").where(F.size("terms") > 0), asked.where("query_id IS NOT NULL")
    sizes = kept(docs.groupBy("group").agg(F.sum(F.size("terms").cast("long")).alias("d")).join(asked.groupBy("group").agg(F.sum(F.size("slots").cast("long")).alias("q")), "group"), "cells")  # a row a group
    most = min(WIDER * DOC_TERMS, max(DOC_TERMS // 3, (sizes.agg(F.sum("d").alias("d")).first()["d"] or 0) // LEAST_BLOCKS))
    sizes = sizes.select("group", F.ceil(F.col("d") / most).cast("int").alias("doc_blocks"), F.ceil(F.col("q") / (WIDER * QUERY_TERMS)).cast("int").alias("query_blocks"))
    n = sizes.agg(F.coalesce(F.sum(F.col("doc_blocks").cast("long") * F.col("query_blocks")), F.lit(1)).alias("n")).first()["n"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c, b: F.pmod(F.xxhash64(c, F.lit(1)), F.col(b)).cast("int")
    keys = ["group", "a", "b"]
    met = lambda rows, a, b: rows.join(sizes, "group").select("*", a.alias("a")).select("*", b.alias("b")).drop("doc_blocks", "query_blocks")
    dealt = lambda rows: rows.repartition(min(4 * n, 4000), *keys).groupBy(*keys)
    a, b = place("id", "doc_blocks"), every("query_blocks")
    others = met(asked, every("doc_blocks"), place("query_id", "query_blocks"))
    for rows in (met(words, every("doc_blocks"), b), met(marks, a, b)):
        others = others.unionByName(rows, allowMissingColumns=True)
    types = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())] + [("side", pa.bool_())] * sided)

    def cell(d: pa.Table, o: pa.Table) -> pa.Table:
        asked, words, marks = (o.filter(pc.is_valid(o[c])) for c in ("query_id", "part", "id"))
        found = best_cosines(d, words, marks, asked, k, sided) if d.num_rows and asked.num_rows else {c: [] for c in types.names}
        return pa.table({c: found[c] for c in types.names}, schema=types)

    return dealt(met(docs, a, b)).cogroup(dealt(others)).applyInArrow(cell, "query_id long, id long, score double" + ", side boolean" * sided)


def held_best(docs: pa.Table, queries: pa.Table, ids: np.ndarray, rows: Iterator) -> dict:
    """query_id, own_score, own_id: of a cell's documents that name the query in ``holds``, the one that comes first."""
    holds, ends = flat(docs["holds"])
    place = np.repeat(np.searchsorted(ids, docs["id"].to_numpy()), np.diff(ends))
    order = np.argsort(holds, kind="stable")
    holds, place = holds[order], place[order]
    names = queries["query_id"].to_numpy()
    low, high = np.searchsorted(holds, names), np.searchsorted(holds, names, side="right")
    out = []
    for i, s, touched in rows:
        at = np.unique(place[low[i] : high[i]])
        at = at[touched[at]]
        if len(at):
            score = np.round(s[at], DIGITS) + 0.0
            out.append((names[i], score.max(), ids[at[score.argmax()]]))
    return dict(zip(("query_id", "own_score", "own_id"), zip(*out, strict=True) if out else ([], [], []), strict=True))


HELD_BEST = "query_id long, own_score double, own_id long"


def beaten(docs: pa.Table, queries: pa.Table, ids: np.ndarray, rows: Iterator) -> dict:
    """query_id, beats: how many of a cell's documents that share a term come before the query's target (own_score, own_id)."""
    own, target = queries["own_score"].to_numpy(), queries["own_id"].to_numpy()
    beats = np.zeros(len(own), np.int64)
    for i, s, touched in rows:
        at = np.flatnonzero(s > own[i] - 10.0**-DIGITS)
        score = np.round(s[at], DIGITS)
        beats[i] = (touched[at] & ((score > own[i]) | (score == own[i]) & (ids[at] < target[i]))).sum()
    return {"query_id": queries["query_id"].to_numpy(), "beats": beats}


BEATEN = "query_id long, beats long"


def placed(k: int) -> tuple[Fold, str]:
    """query_id, id, score, beats: the ``k`` best of all a cell's documents (beats null), those without a shared term score 0; and for each of a query's ``own_ids`` with ``own_scores`` how many come before it."""

    def fold(docs: pa.Table, queries: pa.Table, ids: np.ndarray, rows: Iterator) -> dict:
        names, own, scores = queries["query_id"].to_pylist(), queries["own_ids"].to_pylist(), queries["own_scores"].to_pylist()
        out = []
        for i, s, _ in rows:
            score = np.round(s, DIGITS) + 0.0
            at = np.lexsort((ids, -score))[:k]
            out += [(names[i], x, y, None) for x, y in zip(ids[at].tolist(), score[at].tolist(), strict=True)]
            out += [(names[i], x, y, int((score > y).sum() + ((score == y) & (ids < x)).sum())) for x, y in zip(own[i], scores[i], strict=True)]
        return dict(zip(("query_id", "id", "score", "beats"), map(list, zip(*out, strict=True)) if out else ([], [], [], []), strict=True))

    return fold, "query_id long, id long, score double, beats long"


def packed(terms: DataFrame) -> DataFrame:
    """One row a group and query (group, query_id, terms, weights) of rows (group, query_id, term, weight), terms in the order of their hashes."""
    one = terms.groupBy("group", "query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("t"))
    return one.withColumn("terms", F.col("t.term")).withColumn("weights", F.col("t.weight")).drop("t")
