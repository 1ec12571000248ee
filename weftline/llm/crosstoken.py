"""Alignment of two tokenisers over the same bytes, and counts of which ids stand for each other.

Byte offsets where tokens of both end are common cuts. A first pass tokenises each text, aligns its
tokens, and keeps its distinct linked id pairs, packed. These are counted by a salted shuffle in two
stages, so that a pair in every text is never one task's. Most links have one of few pairs: the most
frequent ones, as many as ``MOST_PAIRS`` at most, go to all tasks; the others are joined with their counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, slices, small_batches
from weftline.llm.packing import ByteLevelFile, byte_letters

#: Id pairs, with their counts, that all tasks get; 17 bytes each.
MOST_PAIRS = 1 << 20
#: Distinct pairs that a task counts together, about, and parts that each pair's counts are added up in at first.
COUNTED, SALTS = 2_000_000, 16
MARK = "▁"


class LetterFile(ByteLevelFile):
    """A file of byte-level BPE, with each id's bytes; strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        super().__init__(path, pattern)
        self.own.encode_special_tokens = True
        self.marks = [t.content for t in self.own.get_added_tokens_decoder().values() if not t.special]
        letters = byte_letters()
        added = {t.content for t in self.own.get_added_tokens_decoder().values()}
        self.bytes_of = {v: k.encode() if k in added else bytes(letters[c] for c in k) for k, v in self.own.get_vocab(with_added_tokens=True).items()}

    def tokens(self, text: str) -> np.ndarray | None:
        """The ids of a text, which is encoded whole; None if their bytes aren't the text's."""
        if self.fast and not any(m in text for m in self.marks):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)  # every byte has an id, so nothing can be lost
        ids = self.own.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.int64) if b"".join(map(self.bytes_of.__getitem__, ids)) == text.encode() else None


class PieceFile:
    """A ``sentencepiece`` model, with each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.bytes_of = {i: bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}

    def tokens(self, text: str) -> np.ndarray | None:
        """The ids of a text, which is encoded whole; None if their bytes aren't a space and the text."""
        ids = self.own.encode(text, num_threads=1)
        return np.array(ids, np.int64) if b"".join(map(self.bytes_of.__getitem__, ids)) == b" " + text.encode() else None


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number with each place from its ``low`` to before its ``high``."""
    many = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(low)), many)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common cuts of tokens that end at these bytes, and the group of each token on either side. No token is empty, so ends are distinct."""
    common = np.intersect1d(a, b, assume_unique=True)
    return common, np.searchsorted(common, a), np.searchsorted(common, b)


def links(a: np.ndarray, b: np.ndarray, kind: str = "end") -> tuple[np.ndarray, np.ndarray]:
    """Places of linked tokens, given where tokens end: those that end together (``end``), or that share a byte (``overlap``)."""
    if kind == "end":
        return expanded(np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right"))
    if kind == "overlap":
        starts = lambda ends: np.concatenate([[0], ends[:-1]])
        return expanded(np.searchsorted(b, starts(a)[: len(a)], "right"), np.searchsorted(starts(b)[: len(b)], a, "left"))
    raise ValueError(f"no such kind of links: {kind}")


class Aligner:
    """Both tokenisers in a worker, and the strings that digests are made of."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.a, self.b = LetterFile(a_path, pattern), PieceFile(b_path)
        self.sizes, self.names = [], []
        for own, ends in ((self.a, "|"), (self.b, ";")):
            most = max(own.bytes_of) + 1
            self.sizes.append(np.array([len(own.bytes_of.get(i, b"")) for i in range(most)]))
            self.names += [f"{i},".encode() for i in range(most)] + [f"{i}{ends}".encode() for i in range(most)]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids on either side; none if either side's bytes aren't a space and the text."""
        if text and (b := self.b.tokens(text)) is not None and (a := self.a.tokens(" " + text)) is not None:
            return a, b
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def digest(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> str:
        """Ids by group: those of A, a bar, those of B; groups apart by semicolons."""
        if not len(a):
            return ""
        last = lambda g: np.append(g[1:] != g[:-1], True)
        many, more = map(len, self.sizes)
        at = np.empty(len(a) + len(b), np.int64)
        at[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = a + last(a_group) * many
        at[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = 2 * many + b + last(b_group) * more
        return hashlib.sha256(b"".join(map(self.names.__getitem__, at.tolist()))[:-1]).hexdigest()


@lru_cache(maxsize=2)
def _worker(a_path: str, b_path: str, pattern: str) -> Aligner:
    return Aligner(a_path, b_path, pattern)


FACTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def described(docs: DataFrame, a_path: str, b_path: str, pattern: str, kind: str) -> DataFrame:
    """``FACTS`` of each text, with its distinct linked pairs (a << 32 | b, packed, in order) and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = _worker(a_path, b_path, pattern), TaskContext.get().partitionId() << 33
        names = [*(c.split()[0] for c in FACTS.split(", ")), "pairs", "times"]
        for part in slices(batches):
            out: list[list] = [[] for _ in names[2:]]
            for text in part.column(1).to_pylist():
                a, b = both.tokens(text or "")
                a_ends, b_ends = np.cumsum(both.sizes[0][a]), np.cumsum(both.sizes[1][b])
                common, a_group, b_group = aligned(a_ends, b_ends)
                i, j = links(a_ends, b_ends, kind)
                pairs, times = np.unique(a[i] << 32 | b[j], return_counts=True)
                for column, x in zip(out, (len(a), len(b), len(common), len(i), both.digest(a, b, a_group, b_group), pairs.tobytes(), times.astype("<u4").tobytes()), strict=True):
                    column.append(x)
            rows = pa.array(np.arange(row, row + part.num_rows))
            row += part.num_rows
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([rows, part.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names)

    return docs.mapInArrow(run, f"{FACTS}, pairs binary, times binary")


def counted(stored: DataFrame) -> DataFrame:
    """pair, n: links of each id pair in the whole table."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, waiting, room = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def fold() -> None:
            nonlocal pairs, times, waiting, room
            every = np.concatenate([pairs, *(np.frombuffer(p, np.int64) for p, _ in waiting)])
            pairs, at = np.unique(every, return_inverse=True)
            times = np.bincount(at, np.concatenate([times, *(np.frombuffer(t, "<u4") for _, t in waiting)]), len(pairs)).astype(np.int64)
            waiting, room = [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])

        for b in batches:
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                waiting.append((p, t))
                if (room := room + len(p) // 8) > COUNTED:
                    fold()
                    if len(pairs) > COUNTED:
                        yield told()
                        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fold()
        yield told()

    parts = stored.select("pairs", "times").mapInArrow(local, "pair long, n long").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def most_frequent(ranked: DataFrame, most: int) -> np.ndarray:
    """Of the pairs with the greatest counts, by powers of two, as many as ``most`` at most: pair, n and whether it is its B id's best."""
    power = F.floor(F.log2("n")).cast("int")
    least, room = None, most
    for r in ranked.groupBy(power.alias("power")).agg(F.count("*").alias("rows")).orderBy(F.desc("power")).collect():
        room -= r["rows"]
        if room < 0:
            break
        least = r["power"]
    table = np.zeros(0, [("pair", np.int64), ("n", np.int64), ("best", bool)])
    if least is None:
        return table

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in b.columns], ["pair", "n", "best"])

    found = ranked.where(power >= least).select("pair", "n", "best").mapInArrow(packed, "pair binary, n binary, best binary").collect()
    whole = {c: np.frombuffer(b"".join(r[c] for r in found), table.dtype[c]) for c in table.dtype.names}
    table = np.zeros(len(whole["pair"]), table.dtype)
    for c in table.dtype.names:
        table[c] = whole[c]
    return np.sort(table, order="pair")


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, *, kind: str = "end", id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """A row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``kind`` says which tokens are linked: those that ``end`` together, or that ``overlap``. A pair's count is
    that of its links over the whole table; ``n_best`` counts the row's links whose pair has its B id's
    greatest count, ties included, and ``count_sum`` adds up the counts of all of its links. Null and empty
    texts, and those whose tokens don't give back a space and the text on both sides, have zeros
    and an empty digest. Texts go whole, however long. Repeated rows count and are returned as often
    as they stand there, null ids too. An empty table gives none. Other columns are not read. To the driver and all tasks
    go ``most_pairs`` counts at most; results are the same for any number.
    """
    docs = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    result = Scratch(docs.sparkSession)
    with Scratch(docs.sparkSession) as keep:
        stored = keep(described(docs, a_path, b_path, pattern, kind), "aligned")
        counts = keep(counted(stored), "counts")
        # a row for each id of B, so no more than it has
        best = counts.groupBy(F.expr("pair & 4294967295L").alias("b")).agg(F.max("n").alias("most"))
        ranked = counts.join(F.broadcast(best), F.expr("pair & 4294967295L") == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
        ranked = keep(ranked, "ranked")
        top = docs.sparkSession.sparkContext.broadcast(most_frequent(ranked, most_pairs))

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, names = top.value, [*(c.split()[0] for c in FACTS.split(", ")), "n_best", "count_sum", "pair", "times"]
            facts, code, many, best = names[:7], table["pair"].copy(), table["n"].copy(), table["best"].copy()
            for b in batches:
                rows, sums, rest = b.column("row").to_numpy(), [], [(np.zeros(0, np.int64),) * 3]
                for row, p, t in zip(rows, b.column("pairs").to_pylist(), b.column("times").to_pylist(), strict=True):
                    pairs, times = np.frombuffer(p, np.int64), np.frombuffer(t, "<u4").astype(np.int64)
                    at = np.minimum(np.searchsorted(code, pairs), max(0, len(code) - 1))
                    there = code[at] == pairs if len(code) else np.zeros(len(pairs), bool)
                    at, held = at[there], times[there]
                    sums.append((int(held[best[at]].sum()), int((held * many[at]).sum())))
                    if not there.all():
                        rest.append((np.full((~there).sum(), row), pairs[~there], times[~there]))
                n_best, count_sum = np.array(sums, np.int64).reshape(-1, 2).T
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in facts), pa.array(n_best), pa.array(count_sum), none, none], names)
                row, pairs, times = map(np.concatenate, zip(*rest, strict=True))
                if len(row):
                    empty = [pa.nulls(len(row), b.schema.field(c).type) for c in facts[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array(row), *empty, pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int64()), pa.array(pairs), pa.array(times)], names)

        found = keep(stored.mapInArrow(known, f"{FACTS}, n_best long, count_sum long, pair long, times long"), "found")
        seldom = found.where("pair IS NOT NULL").select("row", "pair", "times").join(ranked, "pair")
        sums = seldom.groupBy("row").agg(F.sum(F.expr("IF(best, times, 0L)")).alias("more_best"), F.sum(F.expr("times * n")).alias("more_sum"))
        out = found.where("pair IS NULL").drop("pair", "times").join(sums, "row", "left")
        total = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0).cast("long"))).alias(c)
        out = result(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", F.col("more_best")), total("count_sum", F.col("more_sum")), "groups_sha256"), "links")
    return out
