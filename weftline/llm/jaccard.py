"""Exact n-gram Jaccard join of whole texts: every link, and the groups that links form.

A text is the set of its distinct word 5-grams; texts of equal sets are one class. In a common order
of 5-grams, frequent ones last, the first that two linked sets share stands early in both, so the
index lists hold first quarters only. Set relations then spare most of the comparisons:

* Index level. A list's owners are compared with its most central owner first, the one that stands
  furthest forward. Where that gives no answer, parts of lists are skipped by sizes, and by the
  positions behind which too few 5-grams are left.
* Answer level. A set similar to a central one takes over its answers. What the two differ by is known, so
  a set that shares too little with the central one, even with that difference added, can't link with
  its likes: one comparison answers for all of them. Only where it leaves a doubt are these looked at
  one by one, with what both central sets share and the differences as their bound.

Pairs that are left are bounded by parity sketches and then verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, slices, small_batches, unused
from weftline.llm.components import components

WORDS = 5
#: Links need 100 * intersection >= 75 * union, so an intersection of at least 3/7 of both sizes' sum.
PERCENT = 75
#: A 5-gram that so many of a task's distinct sets hold, of sets with so many 5-grams together, is reported as frequent.
FREQUENT, COUNTED = 3, 2_000_000
#: Frequent 5-grams come late in order, and of them so many, the most frequent ones, last by their counts.
MOST_FREQUENT = 1 << 16
#: 5-grams of a block of index lists, about; a list estimated to be longer than half of that is dealt out in parts.
BLOCK = 500_000
#: Pairs that a task looks at, and holds, at a time.
LIST_PAIRS = 2_000_000
#: 5-grams in a written piece of index lists.
PIECE = 100_000
#: In lists of so many owners at most, all pairs are looked at.
SHORT = 32
MOST_BITS = 27
#: Words of a bit table that are put together in one group.
TABLE_BLOCK = 1 << 15
NO_ID = (1 << 63) - 1
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
CHUNK = "block int, part int, parts int, grams binary, places binary, owner binary, keys binary, sizes binary"
MERGED = "block int, part int, parts int, grams binary, leader binary, keys binary, roots binary, low binary, high binary, rest binary, weight binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[1]
    h = (h ^ (h >> np.uint64(29))) * ODD[2]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of five words (of all words as one run, if fewer)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    width = min(WORDS, len(words))
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += mixed(h[k : k + n] + np.uint64(k)) * ODD[k]
    return np.unique(mixed(total))


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketch(s: np.ndarray) -> bytes:
    """Whether each of a power of two of ranges, one a hash or more, holds an odd number of hashes."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    at = (s >> np.uint64(8)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def most_common(n: int, n2: int, x: bytes, y: bytes) -> int:
    """What two sets of these sizes and sketches have in common, at most: a range odd in one alone holds a hash that is not in both."""
    bits = 8 * min(len(x), len(y))
    folded = []
    for z in (x, y):
        v, width = int.from_bytes(z, "little"), 8 * len(z)
        while width > bits:
            width //= 2
            v = (v >> width) ^ (v & ((1 << width) - 1))
        folded.append(v)
    return (n + n2 - (folded[0] ^ folded[1]).bit_count()) // 2


def in_common(x: pa.Scalar, y: pa.Scalar) -> int:
    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
    if not len(p) or not len(q):
        return 0
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())


def described(docs: DataFrame) -> DataFrame:
    """Of each text: doc_id, text_key, n, key, rep, sketch. In further rows, 5-grams that are frequent in a task: gram, n."""
    kinds = "doc_id long, text_key long, n long, key binary, rep long, sketch binary, gram long"
    names = [k.split()[0] for k in kinds.split(", ")]

    def frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        grams, counts = grams[counts >= FREQUENT], counts[counts >= FREQUENT]
        none = lambda kind: pa.nulls(len(grams), kind)
        return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), pa.array(counts, pa.int64()), none(pa.binary()), none(pa.int64()), none(pa.binary()), pa.array(grams.view(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = {}, 0
        for part in slices(batches):
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            keys = [*map(set_key, sets)]
            rows = [part.column(0), part.column(2), pa.array([*map(len, sets)], pa.int64()), pa.array(keys, pa.binary()), part.column(3), pa.array([*map(sketch, sets)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(sets), pa.int64())], names)
            new = {k: x for k, x in zip(keys, sets, strict=True) if k not in held}
            held |= new
            if (room := room + sum(map(len, new.values()))) > COUNTED:
                yield frequent([*held.values()])
                held, room = {}, 0
        yield frequent([*held.values()])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), "rep").mapInArrow(run, kinds)


def bit_table(numbers: DataFrame, count: int | None = None) -> np.ndarray:
    """Bits set for each number of the single column, in a table of at most 2 ** MOST_BITS bits: four bits a number. Repeated numbers do no harm; ``count`` is how many there are, or more."""
    count = numbers.count() if count is None else count
    size = 1 << min(MOST_BITS, max(10, (16 * count).bit_length()))
    words, block = size // 64, min(size // 64, TABLE_BLOCK)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(words, np.int64)
        for b in batches:
            own = b.column(0).to_numpy()
            for i in range(4):
                at = (own >> (11 * i)) % size
                np.bitwise_or.at(table, at // 64, np.int64(1) << (at % 64))
        places = np.flatnonzero(table)
        for k in np.unique(places // block):
            here = places[places // block == k]
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([(here % block).tobytes()], pa.binary()), pa.array([table[here].tobytes()], pa.binary())], ["block", "places", "bits"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(block, np.int64)
        for places, bits in zip(group["places"], group["bits"], strict=True):
            part[np.frombuffer(places, np.int64)] |= np.frombuffer(bits, np.int64)
        return pd.DataFrame({"block": group["block"].iloc[:1], "bits": [part.tobytes()]})

    table = np.zeros(words, np.int64)
    parts = numbers.mapInArrow(local, "block int, places binary, bits binary").groupBy("block").applyInPandas(joined, "block int, bits binary")
    for r in parts.collect():
        table[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["bits"], np.int64)
    return table


def maybe(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers may be in a bit table; those denied are surely not."""
    size, found = 64 * len(table), np.ones(len(numbers), bool)
    for i in range(4):
        at = (numbers >> (11 * i)) % size
        found &= (table[at // 64] >> (at % 64)) & 1 == 1
    return found


def wanted_only(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows (rep, text) whose number ``table`` may hold, in slices."""
    return slices(b.filter(pa.array(maybe(table, b.column(0).to_numpy()))) for b in batches)


def sets_of(docs: DataFrame, wanted: DataFrame, count: int | None = None) -> DataFrame:
    """key and hashes (packed) of the classes whose representatives' numbers ``wanted`` holds; texts are read again for it."""
    table = bit_table(wanted, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wanted_only(batches, table):
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([*map(set_key, sets)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "hashes"])

    return docs.select("rep", "text").mapInArrow(run, "key binary, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"))


def compared(keep: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, key2, n, n2, common of those ``pairs`` (key, key2, required) whose whole sets have at least ``required`` in common."""
    own = lambda x: classes.select(F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("rep").alias(f"rep{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(own(""), F.col("key") == F.col("k")).drop("k").join(own("2"), F.col("key2") == F.col("k2")).drop("k2")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, n2, need = (b.column(c).to_numpy() for c in ("n", "n2", "required"))
            ok = [most_common(int(i), int(j), x, y) >= r for i, j, x, y, r in zip(n, n2, b.column("s").to_pylist(), b.column("s2").to_pylist(), need, strict=True)]
            yield b.select(["key", "key2", "required", "n", "n2", "rep", "rep2"]).filter(pa.array(ok, pa.bool_()))

    left = keep(both.select("key", "key2", "required", "n", "n2", "rep", "rep2", "s", "s2").mapInArrow(bounded, "key binary, key2 binary, required long, n long, n2 long, rep long, rep2 long"), "pairs")
    sets = keep(sets_of(docs, left.select("rep").unionByName(left.select(F.col("rep2").alias("rep"))).distinct()), "sets")
    side = lambda k, x: sets.select(F.col("key").alias(k), F.col("hashes").alias(x))
    whole = left.join(side("kx", "x"), F.col("key") == F.col("kx")).join(side("ky", "y"), F.col("key2") == F.col("ky"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common = np.array([in_common(x, y) for x, y in zip(b.column("x"), b.column("y"), strict=True)], np.int64)
            found = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "key2", "n", "n2")), pa.array(common)], ["key", "key2", "n", "n2", "common"])
            yield found.filter(pa.array(common >= b.column("required").to_numpy()))

    return keep(whole.select("key", "key2", "required", "n", "n2", "x", "y").mapInArrow(run, "key binary, key2 binary, n long, n2 long, common long"), "compared")


def prefix_size(n: int) -> int:
    """So many 5-grams of a set, first in order, hold one at least of those shared with any set that it links with."""
    return n - (PERCENT * n + 99) // 100 + 1


def least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What two sets of these sizes have in common, at least, if they link."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def first_grams(s: np.ndarray, often: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 5-grams of a set, and the counts that ordered them: those that ``often`` may hold come late, by their counts in ``most`` (1 if not there)."""
    many = maybe(often, s.view(np.int64)).astype(np.int64)
    if len(most):
        place = np.minimum(np.searchsorted(most["gram"], s), len(most) - 1)
        many = np.where(most["gram"][place] == s, most["n"][place], many)
    late = np.flatnonzero(many)
    order = np.concatenate([np.flatnonzero(many == 0), late[np.lexsort((s[late], many[late]))]])[: prefix_size(len(s))]
    return s[order], many[order]


def index_chunks(docs: DataFrame, table: np.ndarray, often: np.ndarray, most: np.ndarray, blocks: int, longest: int) -> DataFrame:
    """First 5-grams of each class, in chunks by block and part: part 0 has whole lists, parts from 1 to ``parts`` those of lists that are dealt out. Columns: grams, place (in the set's order), owner (a number within the chunk), the owners' keys and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in wanted_only(batches, table):
            sets = [s for s in map(shingles, texts.column(1).to_pylist()) if len(s)]
            if not sets:
                continue
            grams, many = zip(*(first_grams(s, often, most) for s in sets), strict=True)
            keys = np.frombuffer(b"".join(map(set_key, sets)), "V16")
            sizes = np.array([*map(len, sets)], np.int32)
            owner = np.repeat(np.arange(len(grams)), [*map(len, grams)])
            flat, many = np.concatenate(grams), np.concatenate(many)
            place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])
            block = ((flat >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
            own = np.array([s[0] >> np.uint64(8) for s in sets], np.uint64)[owner]
            parts = many // longest + 1
            part = np.where(parts > 1, (own % parts.astype(np.uint64)).astype(np.int64) + 1, 0)
            order = np.lexsort((part, block))
            at = (block[order] << 32) + part[order]
            full, start = np.unique(at, return_index=True)
            out: list[list] = [[], [], [], [], []]
            most_parts = np.maximum.reduceat(parts[order], start)
            for rows in np.split(order, start[1:]):
                # a chunk names the owners that it has, so that all chunks together grow with the grams alone
                here, number = np.unique(owner[rows], return_inverse=True)
                for column, values in zip(out, (flat[rows], place[rows], number.astype(np.int32), keys[here], sizes[here]), strict=True):
                    column.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array((full >> 32).astype(np.int32)), pa.array((full & 0xFFFFFFFF).astype(np.int32)), pa.array(most_parts.astype(np.int32)), *[pa.array(c, pa.binary()) for c in out]], [c.split()[0] for c in CHUNK.split(", ")])

    return docs.select("rep", "text").mapInArrow(run, CHUNK)


def whole(group: pd.DataFrame, column: str, kind: str | type) -> np.ndarray:
    return np.frombuffer(b"".join(group[column]), kind)


def numbered(group: pd.DataFrame, owner: str, keys: str) -> np.ndarray:
    """Owners' numbers of all chunks of a group, as places among all of the group's keys."""
    many = np.array([len(x) // 16 for x in group[keys]])
    return np.concatenate([np.frombuffer(x, np.int32).astype(np.int64) + b for x, b in zip(group[owner], np.cumsum(many) - many, strict=True)])


def starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))


def partners(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of each entry and of the next ``count`` ones after it, in parts of bounded work (one entry at least)."""
    done, at = np.cumsum(count), 0
    while at < len(count):
        before = done[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(done, before + LIST_PAIRS, side="right")))
        one = np.repeat(np.arange(at, stop), count[at:stop])
        yield one, one + 1 + np.arange(len(one)) - np.repeat(done[at:stop] - count[at:stop] - before, count[at:stop])
        at = stop


def central_pairs(chunks: DataFrame) -> DataFrame:
    """The lists of several owners, again as chunks; and in further rows key, key2: each owner with the most central one of a list that it may link with."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        dealt = bool(group["part"].iloc[0])  # then an owner's partners may be in other parts, and all owners go on
        keys, own = np.unique(whole(group, "keys", "V16"), return_inverse=True)
        sizes = np.zeros(len(keys), np.int64)
        sizes[own] = whole(group, "sizes", np.int32)
        owner, gram, place = own[numbered(group, "owner", "keys")], whole(group, "grams", np.uint64), whole(group, "places", np.int32)
        order = np.lexsort((owner, place, gram))
        owner, gram, place = owner[order], gram[order], place[order]
        # repeated rows of one class are one owner
        once = np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])
        owner, gram, place = owner[once], gram[once], place[once]
        first = starts(gram)
        length = np.diff(np.append(first, len(gram)))
        several = np.repeat((length > 1) | dealt, length)
        owner, gram, place = owner[several], gram[several], place[several]
        if not len(gram):
            return pd.DataFrame({n: [] for n in [*names, "key", "key2"]})
        first = starts(gram)
        lists = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(gram))))
        hub, at = owner[first][lists], place[first][lists]
        n, n2 = sizes[owner], sizes[hub]
        ok = (hub != owner) & (np.minimum(n - place, n2 - at) >= least_common(n, n2))
        pairs = np.unique(np.minimum(owner, hub)[ok] * len(keys) + np.maximum(owner, hub)[ok])
        # of short lists only those go on that may link with another one there; in pieces of lists all do
        length = np.diff(np.append(first, len(gram)))[lists]
        may = (length > SHORT) | dealt
        for i, j in partners(np.where(may, 0, first[lists] + length - 1 - np.arange(len(gram)))):
            a, b = sizes[owner[i]], sizes[owner[j]]
            good = np.minimum(a - place[i], b - place[j]) >= least_common(a, b)
            may[i[good]] = may[j[good]] = True
        owner, gram, place = owner[may], gram[may], place[may]
        first = starts(gram) if len(gram) else np.zeros(0, int)
        # lists go in pieces, so that no row is large
        pieces: list[list] = [[], [], [], [], []]
        cuts = [0, len(gram)] if len(gram) <= PIECE else [0, *first[np.unique(np.searchsorted(first, np.arange(PIECE, len(gram), PIECE))).clip(max=len(first) - 1)], len(gram)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                used, number = np.unique(owner[i:j], return_inverse=True)
                for column, x in zip(pieces, (gram[i:j], place[i:j].astype(np.int32), number.astype(np.int32), keys[used], sizes[used].astype(np.int32)), strict=True):
                    column.append(x.tobytes())
        m, k = len(pieces[0]), len(pairs)
        at = lambda c: pd.array([int(group[c].max())] * m + [None] * k, dtype="Int32")
        named = lambda i: [keys[j].tobytes() for j in i]
        columns = [at("block"), at("part"), at("parts"), *[[*p, *[None] * k] for p in pieces]]
        both = {"key": [*[None] * m, *named(pairs // len(keys))], "key2": [*[None] * m, *named(pairs % len(keys))]}
        return pd.DataFrame({**dict(zip(names, columns, strict=True)), **both})

    return chunks.groupBy("block", "part").applyInPandas(run, f"{CHUNK}, key binary, key2 binary")


def held_in(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """of_block, of_part, key: where sets of ``known`` (and maybe a few others) are owners."""
    head = F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long")
    table, powers = bit_table(known.select(head.alias("number"))), 256 ** np.arange(6, -1, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, part, keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                may = np.frombuffer(keys, np.uint8).reshape(-1, 16)
                may = may[maybe(table, may[:, :7].astype(np.int64) @ powers)]
                rows = [pa.array([x] * len(may), pa.int32()) for x in (block, part)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([x.tobytes() for x in may], pa.binary())], ["of_block", "of_part", "key"])

    return chunks.select("block", "part", "keys").mapInArrow(run, "of_block int, of_part int, key binary")


def merged_lists(chunks: DataFrame, known: DataFrame, others: bool) -> DataFrame:
    """Lists in which each central set stands for itself and its likes.

    known: key, root, leader, extra (what the set has beyond its leader). Sets that ``known`` lacks stand for
    themselves if ``others``, else they are left out. Of each 5-gram and leader: the least and greatest
    size, the most 5-grams left from a place on, and the least weight. The weights of two, summed
    and divided by seven, are what leaders must share for any of their likes to link.
    """
    known = held_in(chunks, known).join(known, "key").select("of_block", "of_part", "key", "root", "leader", "extra")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in MERGED.split(", ")]
        if not len(left):
            return pd.DataFrame({n: [] for n in names})
        keys, sizes = whole(left, "keys", "V16"), whole(left, "sizes", np.int32).astype(np.int64)
        owner, gram, place = numbered(left, "owner", "keys"), whole(left, "grams", np.uint64), whole(left, "places", np.int32).astype(np.int64)
        facts = {k: (r, h, e) for k, r, h, e in zip(right["key"], right["root"], right["leader"], right["extra"], strict=True)}
        own = [facts.get(k, (k, k, 0) if others else None) for k in (x.tobytes() for x in keys)]
        there = np.array([f is not None for f in own])
        own = [f or (b"\0" * 16, b"\0" * 16, 0) for f in own]
        leaders, leader = np.unique(np.frombuffer(b"".join(f[1] for f in own), "V16"), return_inverse=True)
        roots = np.zeros(len(leaders), "V16")
        roots[leader] = np.frombuffer(b"".join(f[0] for f in own), "V16")
        weight = 3 * sizes - 7 * np.array([f[2] for f in own], np.int64)
        chosen = there[owner]
        owner, gram, place = owner[chosen], gram[chosen], place[chosen]
        if not len(gram):
            return pd.DataFrame({n: [] for n in names})
        order = np.lexsort((leader[owner], gram))
        owner, gram, place = owner[order], gram[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (leader[owner][1:] != leader[owner][:-1])]))
        n = sizes[owner]
        used, number = np.unique(leader[owner[first]], return_inverse=True)
        rows = [gram[first], number.astype(np.int32), leaders[used], roots[used], *[x.astype(np.int32) for x in (np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), np.maximum.reduceat(n - place, first), np.minimum.reduceat(weight[owner], first))]]
        return pd.DataFrame({k: [v] for k, v in zip(names, [*(int(left[c].max()) for c in names[:3]), *[x.tobytes() for x in rows]], strict=True)})

    return chunks.groupBy("block", "part").cogroup(known.groupBy("of_block", "of_part")).applyInPandas(run, MERGED)


def leader_pairs(merged: DataFrame) -> DataFrame:
    """key, key2, required: leaders of different roots that a list's sizes and positions let link, or their likes, if they share so much.

    Each pair of parts of the lists that are dealt out is a task of its own.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        across = group["low_part"].iloc[0] < group["high_part"].iloc[0]
        part = np.repeat(group["part"].to_numpy(np.int64), [len(g) // 8 for g in group["grams"]])
        keys, own, at = np.unique(whole(group, "keys", "V16"), return_index=True, return_inverse=True)
        own, at = at, own
        roots = np.unique(whole(group, "roots", "V16")[at], return_inverse=True)[1]
        who, gram = own[numbered(group, "leader", "keys")], whole(group, "grams", np.uint64)
        low, high, rest, weight = (whole(group, c, np.int32).astype(np.int64) for c in ("low", "high", "rest", "weight"))
        order = np.lexsort((low, gram))
        who, gram, part, low, high, rest, weight = (x[order] for x in (who, gram, part, low, high, rest, weight))
        first = starts(gram)
        lists = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(gram))))
        # in a list by size, all that are too large stand behind an end
        end = np.searchsorted((lists << 32) + low, (lists << 32) + high * 100 // PERCENT, side="right")
        count = np.maximum(end - np.arange(len(who)) - 1, 0)
        codes, least = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def fewer() -> None:
            nonlocal codes, least
            o = np.lexsort((least, codes))
            f = starts(codes[o]) if len(o) else o
            codes, least = codes[o][f], least[o][f]

        for one, two in partners(count):
            good = (roots[who[one]] != roots[who[two]]) & (np.minimum(rest[one], rest[two]) >= least_common(low[one], low[two])) & ((part[one] != part[two]) | (not across))
            one, two = one[good], two[good]
            x, y = np.minimum(who[one], who[two]), np.maximum(who[one], who[two])
            codes, least = np.concatenate([codes, x * len(keys) + y]), np.concatenate([least, -(-(weight[one] + weight[two]) // 7)])
            if len(codes) > LIST_PAIRS:
                fewer()
        fewer()
        return pd.DataFrame({"key": [keys[i].tobytes() for i in codes // len(keys)], "key2": [keys[i].tobytes() for i in codes % len(keys)], "required": least})

    others = F.explode(F.when(F.col("part") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), "parts"))).alias("other")
    pairs = merged.select("*", others).withColumn("low_part", F.least("part", "other")).withColumn("high_part", F.greatest("part", "other")).drop("other")
    found = pairs.groupBy("block", "low_part", "high_part").applyInPandas(run, "key binary, key2 binary, required long")
    return found.groupBy("key", "key2").agg(F.min("required").alias("required"))


def leaders_of(links: DataFrame) -> DataFrame:
    """key, leader, extra of the sets that another one stands for: of those it links with, that with the most links, if none stands for that one in turn."""
    both = links.select("key", "key2", "n", "common").unionByName(links.select(F.col("key2").alias("key"), F.col("key").alias("key2"), F.col("n2").alias("n"), "common"))
    degree = both.groupBy("key").agg(F.count("*").alias("d"))
    joined = both.join(degree, "key").join(degree.select(F.col("key").alias("key2"), F.col("d").alias("d2")), "key2")
    more = joined.where("struct(d2, key2) > struct(d, key)")
    picks = more.groupBy("key").agg(F.max(F.struct("d2", "key2", (F.col("common") - F.col("n")).alias("less"))).alias("p"))
    picks = picks.select("key", F.col("p.key2").alias("leader"), (-F.col("p.less")).alias("extra"))
    return picks.join(picks.select(F.col("key").alias("leader")), "leader", "left_anti").select("key", "leader", "extra")


def links_of(keep: Scratch, docs: DataFrame, classes: DataFrame, every: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (key, key2) and links by which all sets that links reach are reached (a, b: id, key)."""
    frequent = keep(every.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")), "frequent")
    rows = frequent.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).collect()
    most = np.zeros(len(rows), [("gram", np.uint64), ("n", np.int64)])
    most["gram"] = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
    most["n"] = np.array([r["n"] for r in rows], np.int64)
    most.sort(order="gram")
    grams = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-(grams // 4) // block), min(12, 1 + grams // 200_000))

    index = index_chunks(docs, bit_table(classes.select("rep")), bit_table(frequent.select("gram")), most, blocks, max(1, block // 2))
    lists = keep(central_pairs(index), "lists")
    chunks = lists.where("grams IS NOT NULL").drop("key", "key2")
    linked = F.expr(f"100 * common >= {PERCENT} * (n + n2 - common)")
    size = lambda k, n: classes.select(F.col("key").alias(k), F.col("n").alias(n))

    def needed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(size("key", "n"), "key").join(size("key2", "n2"), "key2")
        return both.withColumn("required", F.expr(f"({PERCENT} * (n + n2) + {99 + PERCENT}) div {100 + PERCENT}")).drop("n", "n2")

    def edges(links: DataFrame) -> DataFrame:
        node = lambda k, x: classes.select(F.col("key").alias(k), F.struct("id", "key").alias(x))
        return links.join(node("key", "a"), "key").join(node("key2", "b"), "key2").select("a", "b")

    stars = compared(keep, docs, classes, needed(lists.where("key2 IS NOT NULL").select("key", "key2").distinct()))
    groups = keep(components(edges(stars), keep), "groups")
    likes = keep(leaders_of(stars), "likes")
    known = groups.select(F.col("node.key").alias("key"), F.col("root.key").alias("root")).join(likes, "key", "left")
    known = keep(known.select("key", "root", F.coalesce("leader", "key").alias("leader"), F.coalesce("extra", F.lit(0)).alias("extra")), "known")

    answers = compared(keep, docs, classes, leader_pairs(merged_lists(chunks, known, True)))
    links = stars.select("key", "key2").unionByName(answers.where(linked).select("key", "key2"))
    doubtful = keep(answers.where(~linked).select(F.least("key", "key2").alias("h"), F.greatest("key", "key2").alias("h2"), "common").distinct(), "doubtful")
    if not doubtful.isEmpty():
        heads = doubtful.select(F.col("h").alias("leader")).unionByName(doubtful.select(F.col("h2").alias("leader"))).distinct()
        single = heads.join(known.select(F.col("key").alias("leader")), "leader", "left_anti")
        single = single.select(F.col("leader").alias("key"), F.col("leader").alias("root"), "leader", F.lit(0).cast("long").alias("extra"))
        of_heads = keep(known.join(heads, "leader", "left_semi").select("key", "root", "leader", "extra").unionByName(single), "heads")
        alone = leader_pairs(merged_lists(chunks, of_heads.select("key", "root", F.col("key").alias("leader"), F.lit(0).cast("long").alias("extra")), False))
        side = lambda k, h, e: of_heads.select(F.col("key").alias(k), F.col("leader").alias(h), F.col("extra").alias(e))
        both = alone.join(side("key", "ha", "e"), "key").join(side("key2", "hb", "e2"), "key2")
        ordered = both.select("key", "key2", "required", "e", "e2", F.least("ha", "hb").alias("h"), F.greatest("ha", "hb").alias("h2"))
        derived = ordered.join(doubtful, ["h", "h2"]).where("common + e + e2 >= required")
        links = links.unionByName(compared(keep, docs, classes, derived.select("key", "key2", "required")).select("key", "key2"))
    links = keep(links, "links")
    later = links.join(stars, ["key", "key2"], "left_anti")
    return links, groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges(later))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per input row: doc_id, n_shingles, class_id (least id of equal sets), n_links, component_id, group_key, text_key.

    ``n_links`` counts the links that were verified for a row's class; not all are, since those within a
    group found already are not. ``component_id`` is exact: the least doc_id that links reach. Null
    and empty texts have empty sets, which link with nothing. Texts are taken whole, however long; a
    task holds the sets of a bounded length of text, or of one text. Rows with equal ids but different sets are
    told apart (``group_key`` names the group, ``text_key`` hashes the text); null ids count only if a
    group has no other. Other columns are not read.
    """
    docs = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("rep", F.xxhash64("text", "doc_id"))
    result = Scratch(docs.sparkSession)
    with Scratch(docs.sparkSession) as keep:
        every = result(described(docs), "texts")
        base = every.where("key IS NOT NULL").select("doc_id", "text_key", "n", "key", "rep", "sketch")
        least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "rep", "n", "sketch"))
        classes = keep(base.where("n > 0").groupBy("key").agg(least.alias("c"), F.count("*").alias("rows")).select("key", "c.id", "c.rep", "c.n", "c.sketch", "rows"), "classes")
        links, edges = links_of(keep, docs, classes, every, block)
        reached = components(edges, keep).select(F.col("node.key").alias("key"), F.col("root.id").alias("root"), F.col("root.key").alias("root_key"))
        degree = links.select("key").unionByName(links.select(F.col("key2").alias("key"))).groupBy("key").agg(F.count("*").alias("n_links"))
        labels = classes.select("key", F.col("id").alias("class"), "rows").join(reached.join(degree, "key"), "key", "left")
        labels = result(labels.select(F.col("key").alias("label_key"), "class", "root", "root_key", "n_links"), "labels")
    out = base.join(labels, base["key"] == labels["label_key"], "left")
    plain = lambda c: F.when(c != NO_ID, c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(plain(F.col("class")), "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), plain(F.coalesce("root", "class", "doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.hex(F.coalesce("root_key", "key"))).alias("group_key"), "text_key")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which each group keeps one: that of the least id (of equal ids, the least hash of the text).

    Rows without words, which link with nothing, all stay.
    """
    i, t, e, f, u, w = unused(docs, "id", "text", "empty", "first", "its_text", "stays")
    found = join(docs, id_col=id_col, text_col=text_col)
    first = found.where("n_shingles > 0").groupBy("group_key").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), F.col("text_key").alias("t"))).alias("k"))
    stay = first.select(F.col("k.i").alias(f), F.col("k.t").alias(u), F.lit(True).alias(w))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    empty = ~text.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select("*", F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias(i), F.xxhash64(text).alias(t), F.when(empty, F.monotonically_increasing_id() + 1).otherwise(0).alias(e))
    kept_rows = rows.join(stay, (rows[i] == stay[f]) & (rows[t] == stay[u]), "left").where(F.col(w) | (F.col(e) > 0))
    return kept_rows.dropDuplicates([i, t, e]).select(*docs.columns)
