"""Nearest rows of a group by inner product, in blocks of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.search import best

#: Rows of a block on either side.
BLOCK_ROWS = 2048
DIGITS = 6


def blocked(vectors: DataFrame, k: int, *, group: str, key: str, vector: str, asked: str = "true", earlier: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, other, score, rank, seen: the ``k`` rows of its group most alike each row that ``asked`` (SQL) holds for.

    Candidates are the group's other keys, with ``earlier`` the smaller ones alone; ``seen`` counts them. Scores
    have six digits, ties go to the smaller key. No pair is ever a row: a group is dealt into blocks by hash, every
    pair of blocks is one matrix product, and gives ``k`` rows an asked row at most. Rows of null groups,
    keys or vectors take no part; repeated keys are candidates as often as they stand there. A row without candidates isn't returned.
    """
    rows = vectors.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(F.expr(asked), F.lit(False)).alias("asked"))
    parts = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.count_if("asked").alias("a")).where("a > 0").select("group", parts("n").alias("blocks"), parts("a").alias("asked_blocks"))
    rows = rows.join(sizes, "group")
    place = F.xxhash64("key", F.lit(1))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.select("group", spread("asked_blocks").alias("a"), F.pmod(place, "blocks").cast("int").alias("b"), "key", "v", F.lit(False).alias("left"))
    left = rows.where("asked").select("group", F.pmod(place, "asked_blocks").cast("int").alias("a"), spread("blocks").alias("b"), "key", "v", F.lit(True).alias("left"))

    def nearest(cell: pd.DataFrame) -> pd.DataFrame:
        out, side = [], cell["left"].to_numpy(bool)
        keys = cell["key"].to_numpy()
        if side.any() and not side.all():
            x, y = (np.stack(cell["v"][s].to_numpy()) for s in (side, ~side))
            own, other = keys[side], keys[~side]
            for at in range(0, len(own), 256):
                s = np.round(x[at : at + 256] @ y.T, DIGITS) + 0.0
                mine = own[at : at + 256]
                ok = other < mine[:, None] if earlier else other != mine[:, None]
                s[~ok] = -np.inf
                n = min(k, len(other))
                last = np.partition(s, len(other) - n, 1)[:, len(other) - n]
                i, j = np.nonzero((s >= last[:, None]) & ok)
                o = np.lexsort((other[j], -s[i, j], i))
                i, j = i[o], j[o]
                first = np.searchsorted(i, np.arange(len(mine)))
                top = np.arange(len(i)) - first[i] < k
                i, j, lead = i[top], j[top], (np.arange(len(i)) == first[i])[top]
                out.append(pd.DataFrame({"key": mine[i], "other": other[j], "score": s[i, j], "seen": np.where(lead, ok.sum(1)[i], 0)}))
        return pd.concat(out) if out else pd.DataFrame({"key": keys[:0], "other": keys[:0], "score": np.zeros(0), "seen": np.zeros(0, int)})

    kind = vectors.schema[key].dataType.simpleString()
    found = left.unionByName(right).groupBy("group", "a", "b").applyInPandas(nearest, f"key {kind}, other {kind}, score double, seen long")
    seen = found.groupBy("key").agg(F.sum("seen").alias("seen"))
    return best(found.drop("seen"), ["key"], [F.desc("score"), F.col("other")], k).join(seen, "key").select("key", "other", "score", "rank", "seen")
