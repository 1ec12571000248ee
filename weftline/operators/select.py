"""Samples, pairings and selections that are the same in every run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.shared import kept


def hashed(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *columns))


def first_of_each(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows of each stratum, in the order of hashes."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(hashed(seed, key), key))).where(F.col("place") <= n)


def in_turns(rows: DataFrame, stratum: str, group: str, entity: str, key: str, target: int, cap: int, seed: str = "0") -> DataFrame:
    """``target`` rows of each stratum: groups in turns, at most ``cap`` of an entity; where that falls short, the rest in the same order."""
    turn = F.row_number().over(Window.partitionBy(stratum, group).orderBy(hashed(seed, key), key))
    rows = rows.withColumn("turn", turn)
    order = [F.col("turn"), F.col(group), F.col(key)]
    of_entity = F.row_number().over(Window.partitionBy(stratum, entity).orderBy(*order))
    rows = rows.withColumn("over_cap", of_entity > cap)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy("over_cap", *order))).where(F.col("place") <= target)


def before(rows: DataFrame, group: str, order: list[str], weight: str | None = None, name: str = "before") -> DataFrame:
    """``rows`` with ``name``: how many rows of the same group, or what ``weight`` of them, stand before it in ``order`` (ascending).

    No group is gathered: ranges of group and order are sorted each by itself, and written. A range then needs
    to know only what its first group has in the ranges before, a number a range. Columns of
    ``order`` should tell rows apart; ties are in any order. Null groups are one group, null weights count 0.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, total, now, runs = TaskContext.get().partitionId(), 0, 0, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(group)
            w = np.ones(b.num_rows, np.int64) if weight is None else pc.fill_null(b.column(weight), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = pc.fill_null(own.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            new = np.concatenate([[not at or own[0].as_py() != now], codes[1:] != codes[:-1]])
            sums = np.cumsum(w)
            start = np.where(new, sums - w, 0)
            base = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            local = sums - w + np.where(base < 0, total, -start[np.maximum(base, 0)])
            run_no = runs + np.cumsum(new)
            columns = [*b.columns, pa.array(np.full(len(w), part, np.int32)), pa.array(np.arange(at, at + len(w))), pa.array(local), pa.array(run_no == 1), pa.array(w)]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "_part", "_at", "_local", "_first", "_weight"])
            at, total, now, runs = at + len(w), int(local[-1] + w[-1]), own[-1].as_py(), int(run_no[-1])

    found = kept(ranged.mapInArrow(run, f"{schema}, _part int, _at long, _local long, _first boolean, _weight long"), "places")
    end = F.max_by(F.struct((F.col("_local") + F.col("_weight")).alias("sum"), "_first", F.col(group).alias("group")), "_at").alias("last")
    begin = F.min_by(F.struct(F.col(group).alias("group")), "_at").alias("first")
    offsets, carry, group_before = [], 0, object()
    for r in sorted(found.groupBy("_part").agg(begin, end).collect(), key=lambda r: r["_part"]):
        offset = carry if r["first"]["group"] == group_before else 0
        offsets.append((r["_part"], offset))
        carry, group_before = r["last"]["sum"] + (offset if r["last"]["_first"] else 0), r["last"]["group"]
    # a row a range
    moved = rows.sparkSession.createDataFrame(offsets, "_of int, _offset long")
    out = found.join(F.broadcast(moved), F.col("_part") == F.col("_of"))
    return out.select(*rows.columns, (F.col("_local") + F.when(F.col("_first"), F.col("_offset")).otherwise(0)).alias(name))


def coded(rows: DataFrame, tag: str, key: str, stratum: str, prefix: str) -> DataFrame:
    """``rows`` with opaque codes in the order of sha1 sums, counted within each stratum."""
    placed = before(rows.withColumn("_sum", F.sha1(F.concat_ws("|", tag, key))), stratum, ["_sum", key])
    return placed.withColumn("code", F.format_string(f"{prefix}%05d", F.col("before") + 1)).drop("_sum", "before")


def blinded(rows: DataFrame, tag: str, key: str, stratum: str, prefix: str, answers: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a judge sees (code and all columns but ``key``, ``stratum`` and ``answers``), and the key table (code and these). Codes are given once and written, so the two agree."""
    placed = kept(coded(rows, tag, key, stratum, prefix), "codes")
    hidden = list(dict.fromkeys([key, stratum, *answers]))
    return placed.select("code", *[c for c in rows.columns if c not in hidden]), placed.select("code", *hidden)


def tied_ranks(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """group, value, ``name``: the mean rank of each distinct value of a group, ties sharing theirs."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return before(counts, group, [value], "n").select(group, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))


def distinct_greedy(rows: DataFrame, key: str, category: str, confidence: str, vector: str, most: float, size: int) -> DataFrame:
    """The ``size`` most confident rows, none alike another of its category that was chosen before it (cosine of ``most`` or over).

    Rows of a category come one after another, most confident first, in batches; only the vectors
    chosen so far are held. What one category chooses never depends on another, so the cut to
    ``size`` comes last, and a category stops once it has chosen ``size``: later rows of it couldn't stay. Null categories count as one; null vectors are like nothing.
    """
    unit = "_category"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, chosen, taken = object(), 0, np.zeros((0, 0)), 0
        for batch in batches:
            take = []
            for c, v in zip(batch[unit], batch[vector], strict=True):
                if c != now:
                    now, held, chosen, taken = c, 0, np.zeros((0, 0)), 0
                if taken == size:
                    take.append(False)
                    continue
                x = None if v is None else np.asarray(v, float)
                n = None if x is None else np.linalg.norm(x)
                alike = x is not None and n > 0 and held and (chosen[:held] @ (x / n)).max() >= most
                take.append(not alike)
                taken += not alike
                if not alike and x is not None and n > 0:
                    if held == len(chosen):
                        chosen = np.concatenate([chosen.reshape(-1, len(x)), np.zeros((max(16, held), len(x)))])
                    chosen[held] = x / n
                    held += 1
            yield batch.loc[take, [key, category, confidence]]

    ready = rows.select(key, category, confidence, vector, F.coalesce(F.col(category).cast("string"), F.lit("")).alias(unit))
    ready = ready.repartition(unit).sortWithinPartitions(unit, F.col(confidence).desc(), key)
    kinds = ready.select(key, category, confidence).schema
    return ready.mapInPandas(run, kinds).orderBy(F.desc(confidence), key).limit(size)
