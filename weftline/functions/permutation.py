"""Permutation tests: labels shuffled among cases, of large entities drawn as counts, of others case by case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entities that one task holds at a time, shuffles of one seed, shuffles made at a time, and tasks that shuffles of few entities are dealt to.
ENTITIES, TURNS, TILE, TASKS = 8192, 500, 10, 32
#: Cases up to which an entity's are dealt one by one: as many as a byte counts.
FEW = 255


def split(rng: np.random.Generator, labels: np.ndarray, taken: int) -> np.ndarray:
    """How many of each label (turns x labels) fall to ``taken`` of the cases, drawn without replacement, a row per turn."""
    out, left, rest = np.zeros_like(labels), np.full(len(labels), taken), labels.sum(1)
    for c in range(labels.shape[1] - 1):
        rest = rest - labels[:, c]
        out[:, c] = rng.hypergeometric(labels[:, c], rest, left)
        left = left - out[:, c]
    out[:, -1] = left
    return out


def of_block(seed: tuple[int, ...], sizes: np.ndarray, labels: np.ndarray, block: int, turns: int) -> np.ndarray:
    """How many of each label fall to one block of cases, a row per turn, by halving the blocks.

    Each halving has a seed of its own, so tasks of other blocks draw the same numbers on shared ways.
    """
    ends, low, high = np.concatenate([[0], np.cumsum(sizes)]), 0, len(sizes)
    now = np.tile(labels, (turns, 1))
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([*seed, low, high]), now, int(ends[middle] - ends[low]))
        low, high, now = (low, middle, left) if block < middle else (middle, high, now - left)
    return now


def dealt(rng: np.random.Generator, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How many of each label fall to each entity of ``sizes`` (falling, at most ``FEW``), labels x turns x entities; ``labels`` (turns x labels) are all dealt.

    Each case gets a label by its share, independently; then cases drawn among all that have a label too often get one
    that is too rare. Neither step tells cases apart, so any arrangement of these labels is as likely as any other:
    a shuffle. A turn redraws about as many cases as the square root of all.
    """
    turns, k = labels.shape
    if not sizes.any():
        return np.zeros((k, turns, len(sizes)), np.uint8)
    # as[l]: cases with a label up to l, so the last is the size
    upto = np.zeros((k, turns, len(sizes)), np.uint8)
    upto[-1] = sizes
    shares = np.minimum(np.rint(labels.cumsum(1)[:, :-1] / sizes.sum() * 65536), 65535).astype(np.uint16)
    # one case of each entity that has so many at a time
    for n in np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right").tolist():
        u = rng.bit_generator.random_raw(-(-turns * n // 4)).view(np.uint16)[: turns * n].reshape(turns, n)
        for c in range(k - 1):
            part = upto[c, :, :n]
            np.add(part, (u < shares[:, c, None]).view(np.uint8), out=part)
    found = np.diff(upto, axis=0, prepend=np.zeros((1, *upto.shape[1:]), np.uint8))
    over = found.sum(2, dtype=np.int64).T - labels
    for t in np.flatnonzero(over.any(1)):
        short = np.repeat(np.arange(k), np.maximum(-over[t], 0))
        moved = []
        for c in np.flatnonzero(over[t] > 0):
            ends = found[c, t].cumsum(dtype=np.int64)
            moved.append(np.searchsorted(ends, rng.choice(int(ends[-1]), int(over[t, c]), replace=False, shuffle=False), side="right"))
            found[c, t] -= np.bincount(moved[-1], minlength=len(sizes)).astype(np.uint8)
        moved = rng.permutation(np.concatenate(moved))
        for c in np.flatnonzero(over[t] < 0):
            found[c, t] += np.bincount(moved[short == c], minlength=len(sizes)).astype(np.uint8)
    return found


def shuffles(rng: np.random.Generator, sizes: np.ndarray, labels: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Counts of labels x turns x entities, ``TILE`` turns at a time; ``sizes``: strata x entities, ``labels``: turns x labels of each stratum."""
    large = [np.flatnonzero(n > FEW) for n in sizes]
    drawn, rest = {}, list(labels)
    for s, entities in enumerate(large):
        for e in entities:
            drawn[s, e] = split(rng, rest[s], int(sizes[s, e]))
            rest[s] = rest[s] - drawn[s, e]
    few = np.where(sizes > FEW, 0, sizes)
    falling = np.argsort(-few, axis=1, kind="stable")
    places = np.argsort(falling, axis=1)
    for t in range(0, len(labels[0]), TILE):
        turns = slice(t, t + TILE)
        out = np.zeros((labels[0].shape[1], len(labels[0][turns]), sizes.shape[1]), np.int32)
        for s, order in enumerate(falling):
            found = dealt(rng, few[s, order], rest[s][turns])
            out += found if (order[1:] > order[:-1]).all() else found.take(places[s], axis=2)
        for (_, e), part in drawn.items():
            out[:, :, e] += part[turns].T
        yield out


def shuffled_chi2(cells: DataFrame, entity: str, stratum: str, label: str, count: str, *, turns: int = 5000, seed: int = 0, blocks: int | None = None) -> DataFrame:
    """turn, chi2: Pearson's statistic of entity by label, turn 0 as it is and each other with labels shuffled within strata.

    ``cells`` has one row for each entity, stratum and label with a count (positive; no nulls). Two labels give the
    spread of rates, sum of (k - np)^2 / np(1-p). Blocks' counts are hypergeometric draws, as are those of entities with
    more than 255 cases in a stratum, whatever their number; other cases are dealt one by one, a nanosecond or two each.
    Tasks hold 8192 entities. The driver has counts of strata by labels and of blocks by strata,
    so strata and labels must be few; a stratum holds fewer than 1e9 cases, numpy's bound.
    """
    spark = cells.sparkSession
    n = blocks or max(1, -(-cells.select(entity).distinct().count() // ENTITIES))
    cells = cells.select(F.col(entity).cast("string").alias("entity"), F.col(stratum).cast("string").alias("stratum"), F.col(label).cast("string").alias("label"), F.col(count).cast("long").alias("n"))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(n)).cast("int"))
    totals = cells.groupBy("stratum", "label").agg(F.sum("n")).collect()
    sizes = cells.groupBy("block", "stratum").agg(F.sum("n")).collect()
    strata, names = sorted({r[0] for r in totals}), sorted({r[1] for r in totals})
    if not totals:
        return spark.createDataFrame([], "turn int, chi2 double")
    of_labels, of_blocks = np.zeros((len(strata), len(names)), np.int64), np.zeros((len(strata), n), np.int64)
    for s, c, k in totals:
        of_labels[strata.index(s), names.index(c)] = k
    at = {s: i for i, s in enumerate(strata)}
    for b, s, k in sizes:
        of_blocks[at[s], b] = k
    if of_blocks.sum(1).max() >= 10**9:
        raise ValueError("a stratum holds 1e9 cases or more")
    shares = of_labels.sum(0) / of_labels.sum()
    parts = -(-turns // TURNS)
    each = -(-parts // max(1, TASKS // n))

    def run(key: tuple[int, int], rows: pd.DataFrame) -> pd.DataFrame:
        block, group = key
        at = [pd.factorize(rows["entity"], sort=True)[0], *(pd.Categorical(rows[c], categories=v).codes for c, v in (("stratum", strata), ("label", names)))]
        own = np.zeros((len(strata), len(names), at[0].max() + 1), np.int64)
        np.add.at(own, (at[1], at[2], at[0]), rows["n"].to_numpy())
        own = own[:, :, np.argsort(-own.sum((0, 1)), kind="stable")]
        expected = own.sum((0, 1)) * shares[:, None]
        spread = lambda x: sum(((x[c] - expected[c]) ** 2 / expected[c]).sum(1) for c in range(len(names)))
        q = [*spread(own.sum(0)[:, None])] if group == 0 else []
        first, last = group * each, min(parts, (group + 1) * each)
        for chunk in range(first, last):
            made = min(turns, (chunk + 1) * TURNS) - chunk * TURNS
            labels = [of_block((seed, chunk, s), of_blocks[s], of_labels[s], block, made) for s in range(len(strata))]
            for x in shuffles(np.random.Generator(np.random.SFC64([seed, chunk, n + 1, block])), own.sum(1), labels):
                q += [*spread(x)]
        return pd.DataFrame({"turn": range(0 if group == 0 else first * TURNS + 1, min(turns, last * TURNS) + 1), "part": q})

    groups = -(-parts // each)
    spans = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    # Small rows, long work: a number of partitions that is asked for isn't coalesced by size.
    spread_out = cells.select("*", spans).repartition(min(4 * n * groups, 4000), "block", "group")
    return spread_out.groupBy("block", "group").applyInPandas(run, "turn int, part double").groupBy("turn").agg(F.sum("part").alias("chi2"))


def tested(drawn: DataFrame) -> DataFrame:
    """One row from ``shuffled_chi2``: the statistic, its mean over shuffles, and p = (1 + shuffles at or above it) / (1 + shuffles)."""
    # a single pass, as each one makes all shuffles
    turns = F.array_sort(F.collect_list(F.when(F.col("turn") > 0, F.col("chi2"))))
    one = drawn.agg(F.max(F.when(F.col("turn") == 0, F.col("chi2"))).alias("q"), turns.alias("turns"))
    total = F.aggregate("turns", F.lit(0.0), lambda a, x: a + x)
    shuffles, above = F.size("turns").cast("long"), F.size(F.filter("turns", lambda x: x >= F.col("q") - 1e-9))
    return one.select("q", F.try_divide(total, shuffles).alias("mean_shuffled"), shuffles.alias("shuffles"), ((1 + above) / (1 + shuffles)).alias("p"))
