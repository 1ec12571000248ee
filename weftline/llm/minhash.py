"""Near-duplicate groups by bottom-k sketches: the least hashes of a text's 5-grams under one hash function.

Texts of equal sets are one class. A class keeps the ``K`` least hashes of its set, which are the
whole set if that is small. What two linked sets must have in common of their sketches is known (of
large ones but for odds of ``ODDS``), so in a common order of values, frequent ones last, the first
value that both hold stands early in both: inverted lists hold only these early values.

* The members of a list are compared with its most central one, the one of most frequent values.
  Each then knows, as bits, which of the central one's values it holds, and how many others.
* Links that this gives join classes into groups. Only lists that still hold several groups are
  joined with themselves. Two members' bits and counts of others bound what they can have in common,
  and a pair is made only in the list of the first value that both hold.

Pairs are filtered by the estimate of the sketch of their union, and verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp, lgamma, log
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, slices, small_batches
from weftline.llm.components import components
from weftline.llm.jaccard import NO_ID, bit_table, in_common, maybe, set_key, sets_of, shingles

#: Values in a sketch: four longs of bits.
K = 256
WORDS_OF_BITS = K // 64
#: Links need 100 * intersection >= 85 * union.
PERCENT = 85
#: Odds that two linked sets, one of them larger than its sketch, share fewer sketch values than is asked for.
ODDS = 1e-12
#: Values of so many classes at least come late in order, and of them so many, the most frequent ones, last by their counts.
FREQUENT, MOST_FREQUENT = 3, 1 << 16
#: Values of a block that are counted together, about; values that a task holds before it hands on their counts.
BLOCK, COUNTED = 2_000_000, 1_000_000


@cache
def least_shared(k: int = K, percent: int = PERCENT, odds: float = ODDS) -> int:
    """So many of the ``k`` least values of a union, at least, are in both of two linked sets, but for the given odds."""
    share, below = percent / 100, 0.0
    for n in range(k + 1):
        below += exp(lgamma(k + 1) - lgamma(n + 1) - lgamma(k - n + 1) + n * log(share) + (k - n) * log(1 - share))
        if below > odds:
            return n
    return k


def early(n: int, percent: int = PERCENT) -> int:
    """So many values of the sketch of a set of ``n``, first in order, hold one at least that a linked set's sketch has too."""
    shared = -(-percent * n // 100)
    if 100 * n >= percent * (K + 1):  # a linked set may be larger than its sketch
        shared = min(shared, least_shared(K, percent))
    return min(n, K) - shared + 1


def described(docs: DataFrame) -> DataFrame:
    """Of each text: doc_id, n, key of its set, rep (a number for this row's text), sketch (sorted values, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            columns = [part.column(0), pa.array([*map(len, sets)], pa.int64()), pa.array([*map(set_key, sets)], pa.binary()), part.column(2), pa.array([s[:K].tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "rep", "sketch"])

    return docs.select("doc_id", "text", "rep").mapInArrow(run, "doc_id long, n long, key binary, rep long, sketch binary")


def shared_values(classes: DataFrame, blocks: int) -> DataFrame:
    """value, n: the values that several sketches hold, with the number of these sketches. Tasks count first, so that a block gets each value once a task and part."""

    def some(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        block = (values >> np.uint64(20)) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        full, start = np.unique(block[order], return_index=True)
        parts = [[x[rows].tobytes() for rows in np.split(order, start[1:])] for x in (values, counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(p, pa.binary()) for p in parts]], ["block", "values", "counts"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [np.zeros(0, np.uint64)], 0
        for b in batches:
            held.append(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64))
            if (room := room + len(held[-1])) > COUNTED:
                yield some(held)
                held, room = [np.zeros(0, np.uint64)], 0
        if room:
            yield some(held)

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        values, at = np.unique(np.frombuffer(b"".join(group["values"]), np.uint64), return_inverse=True)
        counts = np.bincount(at, np.frombuffer(b"".join(group["counts"]), np.int64), len(values)).astype(np.int64)
        return pd.DataFrame({"value": values[counts > 1].view(np.int64), "n": counts[counts > 1]})

    return classes.select("sketch").mapInArrow(local, "block int, values binary, counts binary").groupBy("block").applyInPandas(whole, "value long, n long")


class Common(NamedTuple):
    """What the order of values rests on: a bit table of the frequent ones, and the counts (value, n) of the most frequent."""

    often: np.ndarray
    most: np.ndarray


def in_order(sketch: np.ndarray, common: Common) -> tuple[np.ndarray, int]:
    """The sketch's values in the common order, frequent ones late, the most frequent last by their counts; and how many are frequent."""
    counts, most = maybe(common.often, sketch.view(np.int64)).astype(np.int64), common.most
    if len(most):
        place = np.minimum(np.searchsorted(most["value"], sketch), len(most) - 1)
        counts = np.where(most["value"][place] == sketch, most["n"][place], counts)
    return sketch[np.lexsort((sketch, counts))], int((counts > 0).sum())


def postings(classes: DataFrame, common: Common, several: np.ndarray, percent: int) -> DataFrame:
    """value, key, n, m (of its sketch), place, central (share of frequent values, in 256ths) of each early value that another sketch may hold."""
    names = ["value", "key", "n", "m", "place", "central"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, raw = (c.to_pylist() for c in b.columns)
            firsts, facts = [], []
            for n, x in zip(sizes, raw, strict=True):
                order, frequent = in_order(np.frombuffer(x, np.uint64), common)
                firsts.append(order[: early(n, percent)])
                facts.append((n, len(order), 256 * frequent // max(1, len(order))))
            count = np.array([*map(len, firsts)])
            row = np.repeat(np.arange(len(keys)), count)
            values = np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            ok = maybe(several, values)
            row, facts = row[ok], np.array(facts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(values[ok]), pa.array(keys, pa.binary()).take(pa.array(row)), pa.array(facts[row, 0]), *[pa.array(x.astype(np.int32)) for x in (facts[row, 1], place[ok], facts[row, 2])]], names)

    return classes.select("key", "n", "sketch").mapInArrow(run, "value long, key binary, n long, m int, place int, central int")


def with_sketches(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (key, key2) with n, n2, rep, rep2, s and s2. Only sketches of classes in pairs are shuffled, and maybe a few others."""
    number = lambda c: F.xxhash64(c)
    both = pairs.select(number("key").alias("number")).unionByName(pairs.select(number("key2").alias("number")))
    table = bit_table(both, 2 * pairs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe(table, b.column(0).to_numpy())))

    own = classes.select(number("key").alias("number"), "key", "n", "rep", "sketch").mapInArrow(run, "number long, key binary, n long, rep long, sketch binary")
    side = lambda x: own.select(F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("rep").alias(f"rep{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side(""), F.col("key") == F.col("k")).drop("k").join(side("2"), F.col("key2") == F.col("k2")).drop("k2")
    return both.select("key", "key2", "n", "n2", "rep", "rep2", "s", "s2")


COMPARED = "key binary, key2 binary, n long, n2 long, rep long, rep2 long, sure boolean, bits array<long>, others int"


def estimated(pairs: DataFrame, order: Common, percent: int) -> DataFrame:
    """Each pair as ``COMPARED``: sure is true of links between sets that their sketches hold whole, null where the estimate of
    the union's sketch allows a link, else false; bits tell which of key2's values, in order, key holds, and others how many it has beside them."""
    names = [c.split()[0] for c in COMPARED.split(", ")]
    least = least_shared(K, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sure, bits, others, known = [], [], [], {}
            for n, n2, x, y in zip(*(b.column(c).to_pylist() for c in ("n", "n2", "s", "s2")), strict=True):
                if y not in known:
                    known[y] = in_order(np.frombuffer(y, np.uint64), order)[0]
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                held = np.isin(known[y], one, assume_unique=True)
                common = int(held.sum())
                if n <= K and n2 <= K:
                    sure.append(100 * common >= percent * (n + n2 - common))
                else:
                    union = np.union1d(one, two)[:K]
                    sure.append(None if (known[y][held] <= union[-1]).sum() >= least else False)
                bits.append(np.packbits(np.concatenate([held, np.zeros(K - len(held), bool)]), bitorder="little").view("<i8").tolist())
                others.append(len(one) - common)
            new = [pa.array(sure, pa.bool_()), pa.array(bits, pa.list_(pa.int64())), pa.array(others, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:6]), *new], names)

    return pairs.mapInArrow(run, COMPARED)


def verified(keep: Scratch, docs: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    """key, key2 of those pairs whose whole sets link."""
    sure, left = compared.where("sure").select("key", "key2"), compared.where("sure IS NULL").select("key", "key2", "n", "n2", "rep", "rep2")
    open_ = left.count()
    if not open_:
        return sure
    sets = keep(sets_of(docs, left.select("rep").unionByName(left.select(F.col("rep2").alias("rep"))), 2 * open_), "sets")
    side = lambda k, x: sets.select(F.col("key").alias(k), F.col("hashes").alias(x))
    whole = left.join(side("kx", "x"), F.col("key") == F.col("kx")).join(side("ky", "y"), F.col("key2") == F.col("ky"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common = np.array([in_common(x, y) for x, y in zip(b.column("x"), b.column("y"), strict=True)], np.int64)
            both = b.column("n").to_numpy() + b.column("n2").to_numpy()
            yield b.select(["key", "key2"]).filter(pa.array(100 * common >= percent * (both - common)))

    exact = whole.select("key", "key2", "n", "n2", "x", "y").mapInArrow(run, "key binary, key2 binary")
    return keep(sure.unionByName(exact), "verified")


def needed(n: Column, n2: Column, percent: int) -> Column:
    """What the sketches of two sets of these sizes have in common, at least, if the sets link."""
    exact = ((percent * (n + n2) + 99 + percent) / (100 + percent)).cast("long")
    return F.when((n <= K) & (n2 <= K), exact).otherwise(least_shared(K, percent))


def may_link(rows: DataFrame, one: str, two: str, place: Column, percent: int) -> Column:
    """Whether sizes and places in a list, of columns with these prefixes, let two members link."""
    n, n2 = rows[f"{one}n"], rows[f"{two}n"]
    left = F.least(rows[f"{one}m"] - rows[f"{one}place"], rows[f"{two}m"] - place)
    return (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & (left >= needed(n, n2, percent))


def pairs_across(members: DataFrame, percent: int) -> DataFrame:
    """key, key2 of members of a list, in different groups, that sizes, places and what they hold of the central member's values let link.

    Members that can't link with the central one have no bits; nothing is known of their pairs then.
    """
    names = ["key", "n", "m", "place", "root", "bits", "others"]
    a, b = (members.select("value", "first", *[F.col(c).alias(f"{x}_{c}") for c in names]) for x in "ab")
    b = b.drop("first")
    c = F.col
    need = needed(c("a_n"), c("b_n"), percent)
    word = lambda i: c("a_bits")[i].bitwiseAND(c("b_bits")[i])
    shared = sum((F.bit_count(word(i)) for i in range(1, WORDS_OF_BITS)), F.bit_count(word(0)))
    # values of the central member that stand before this list's value: if both hold one, the pair is made there
    low = lambda i: F.when(c("first") >= 64 * (i + 1), F.lit(-1).cast("long")).when(c("first") <= 64 * i, F.lit(0).cast("long")).otherwise(F.expr(f"~shiftleft(-1L, first - {64 * i})"))
    earlier = F.lit(False)
    for i in range(WORDS_OF_BITS):
        earlier = earlier | (word(i).bitwiseAND(low(i)) != 0)
    both = a.join(b, ["value"])
    apart = (c("a_key") < c("b_key")) & (c("a_root") != c("b_root")) & may_link(both, "a_", "b_", c("b_place"), percent)
    both = both.where(apart & F.coalesce(~earlier & (shared + F.least("a_others", "b_others") >= need), F.lit(True)))
    return both.select(c("a_key").alias("key"), c("b_key").alias("key2")).distinct()


def links_of(keep: Scratch, docs: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups of classes (node, root) that links with central members join, and further links (key, key2), by which all classes are reached that links reach."""
    total = classes.agg(F.coalesce(F.sum(F.length("sketch")) / 8, F.lit(0)).cast("long")).first()[0]
    shared = keep(shared_values(classes, max(12, -(-total // BLOCK))), "values")
    rows = shared.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "value").limit(MOST_FREQUENT).collect()
    most = np.zeros(len(rows), [("value", np.uint64), ("n", np.int64)])
    most["value"], most["n"] = np.array([r["value"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    most.sort(order="value")
    order = Common(bit_table(shared.where(F.col("n") >= FREQUENT).select("value")), most)

    listed = keep(postings(classes, order, bit_table(shared.select("value")), percent), "postings")
    central = F.max(F.struct("central", "m", "key", "place", "n")).alias("c")
    facts = [F.col(f"c.{c}").alias(f"hub_{c}") for c in ("n", "m")]
    hubs = listed.groupBy("value").agg(F.count("*").alias("rows"), central).where("rows > 1").select("value", F.col("c.key").alias("hub"), F.col("c.place").alias("first"), *facts)
    members = keep(listed.join(hubs, "value"), "members")
    pairs = keep(members.where(F.col("key") != F.col("hub")).where(may_link(members, "", "hub_", F.col("first"), percent)).select("key", F.col("hub").alias("key2")).distinct(), "stars")
    stars = keep(estimated(with_sketches(classes, pairs), order, percent), "compared")
    links = verified(keep, docs, stars, percent)
    groups = keep(components(links.select(F.col("key").alias("a"), F.col("key2").alias("b")), keep), "groups")

    roots = members.join(groups.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    roots = keep(roots, "roots")
    mixed = roots.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
    left = roots.join(mixed, "value", "left_semi")
    # the central member holds all of its own values
    every = F.array(*[F.when(F.col("m") >= 64 * (i + 1), F.lit(-1).cast("long")).when(F.col("m") <= 64 * i, F.lit(0).cast("long")).otherwise(F.expr(f"~shiftleft(-1L, m - {64 * i})")) for i in range(WORDS_OF_BITS)])
    left = left.join(stars.select("key", F.col("key2").alias("hub"), "bits", "others"), ["key", "hub"], "left")
    central = F.col("key") == F.col("hub")
    left = keep(left.withColumn("bits", F.when(central, every).otherwise(F.col("bits"))).withColumn("others", F.when(central, 0).otherwise(F.col("others"))), "mixed")
    more = pairs_across(left, percent).join(pairs.select(F.least("key", "key2").alias("key"), F.greatest("key", "key2").alias("key2")), ["key", "key2"], "left_anti")
    answers = keep(estimated(with_sketches(classes, keep(more, "pairs")), order, percent), "compared")
    return groups, verified(keep, docs, answers, percent)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least doc_id that links reach, itself included; ``kept`` tells whether it is the
    row's own, and is null for a null id. Null and empty texts, and texts without words, have empty
    sets, which link with nothing. Texts are taken whole, however long. Repeated rows give repeated
    rows, all kept if one is; of rows with equal ids but different texts each has its own group. Null ids
    count only where a group has no other. A link of two sets of at most ``K`` 5-grams is never missed, one
    of others with odds below ``ODDS``. An empty table gives none. Other columns are not read.
    """
    docs = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("rep", F.xxhash64("text", "doc_id"))
    result = Scratch(docs.sparkSession)
    with Scratch(docs.sparkSession) as keep:
        every = keep(described(docs), "texts")
        least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "rep", "n", "sketch"))
        classes = keep(every.where("n > 0").groupBy("key").agg(least.alias("c")).select("key", "c.id", "c.rep", "c.n", "c.sketch"), "classes")
        groups, links = links_of(keep, docs, classes, percent)
        # only the groups' roots take part in the second round
        own = lambda k, x: groups.select(F.col("node").alias(k), F.col("root").alias(x))
        over = links.join(own("key", "a"), "key", "left").join(own("key2", "b"), "key2", "left").select(F.coalesce("a", "key").alias("a"), F.coalesce("b", "key2").alias("b"))
        more = components(over, keep).select(F.col("node").alias("of"), F.col("root").alias("top"))
        named = classes.select("key", "id").join(own("node", "first"), F.col("key") == F.col("node"), "left").withColumn("first", F.coalesce("first", "key"))
        named = keep(named.join(more, F.col("first") == F.col("of"), "left").select("key", "id", F.coalesce("top", "first").alias("group")), "named")
        least_ids = named.groupBy("group").agg(F.min("id").alias("root"), F.count("*").alias("classes")).where("classes > 1").select(F.col("group").alias("g"), "root")
        labels = named.join(least_ids, F.col("group") == F.col("g"), "left").select(F.col("key").alias("label_key"), F.coalesce("root", "id").alias("root"))
        base = every.select("doc_id", "n", "key")
        out = base.join(labels, base["key"] == labels["label_key"], "left")
        own_id = F.coalesce("root", "doc_id")
        component = F.when(own_id != NO_ID, own_id)
        return result(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept")), "groups")
