"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs (lines). A section ends behind a paragraph whose digest says so, so that an
edit moves no boundary but its own. A section's digest is that of its paragraphs' digests, the
root's that of the sections'. Equal roots mean equal texts; where roots differ, comparing branches
leads to the paragraphs edited. Below paragraphs a fingerprint also has short digests of their runs
of words, so that likeness can be told within paragraphs that differ.
"""

from __future__ import annotations

import binascii
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_batches

#: One in so many paragraphs ends a section.
SECTION = 8
#: Runs of up to eight words, ended by a word whose last byte leaves 1 when divided by four; never over 32 bytes of one word.
ENDS = b"[" + b"".join(b"\\x%02x" % b for b in range(33, 256) if b % 4 == 1) + b"]"
RUN = re.compile(rb"(?:\S{1,32}\s+){0,7}?\S{0,31}" + ENDS + rb"\s+|\S{1,32}\s*|\s+")
FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree(NamedTuple):
    """Digests: root and sections in letters, paragraphs by section, and 24-bit ones of runs by section and paragraph."""

    root: str
    sections: list[str]
    paragraphs: list[list[str]]
    runs: list[list[np.ndarray]]

    def __str__(self) -> str:
        """``root;section,paragraph,...;section,...``: hex root, eight letters a section, four a paragraph and for each of its runs."""
        flat = [r for section in self.runs for r in section]
        letters, at, out = lettered(np.concatenate(flat)), 0, [self.root]
        for section, names, runs in zip(self.sections, self.paragraphs, self.runs, strict=True):
            row = [section]
            for name, r in zip(names, runs, strict=True):
                row.append(name + letters[at : (at := at + 4 * len(r))])
            out.append(",".join(row))
        return ";".join(out)

    @property
    def size(self) -> int:
        return sum(len(r) for section in self.runs for r in section)


def lettered(numbers: np.ndarray) -> str:
    """Four letters for each 24-bit number."""
    return binascii.b2a_base64(numbers.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes(), newline=False).decode()


def tree(text: str) -> Tree:
    paragraphs: list[list[bytes]] = [[]]
    runs: list[list[np.ndarray]] = [[]]
    hashed = xxhash.xxh3_64_intdigest
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    for i, line in enumerate(lines):
        d = digest(line)
        runs[-1].append(np.array([hashed(r) & 0xFFFFFF for r in RUN.findall(line)], np.int64))
        paragraphs[-1].append(d)
        if d[0] % SECTION == 0 and i + 1 < len(lines):
            paragraphs.append([])
            runs.append([])
    sections = [digest(b"".join(p)) for p in paragraphs]
    short = lambda d, n: binascii.b2a_base64(d[:n], newline=False).decode()
    return Tree(digest(b"".join(sections)).hex(), [short(d, 6) for d in sections], [[short(d, 3) for d in p] for p in paragraphs], runs)


def read(fingerprint: str) -> Tree:
    """The tree that a fingerprint tells of."""
    root, *sections = fingerprint.split(";")
    parts = [s.split(",") for s in sections]
    numbers = lambda letters: np.frombuffer(b"\0" + binascii.a2b_base64(letters), np.uint8)[1:].reshape(-1, 3) @ np.array([1 << 16, 1 << 8, 1])
    return Tree(root, [p[0] for p in parts], [[x[:4] for x in p[1:]] for p in parts], [[numbers(x[4:]) for x in p[1:]] for p in parts])


def unmatched(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """Places in ``a`` and ``b`` that are left once equal digests are paired, one for one."""
    left, mine, free = Counter(b), [], Counter()
    for i, d in enumerate(a):
        if left[d]:
            left[d] -= 1
            free[d] += 1
        else:
            mine.append(i)
    other = []
    for i, d in enumerate(b):
        if free[d]:
            free[d] -= 1
        else:
            other.append(i)
    return mine, other


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots, else the share of runs that both have, each as often as it is in both (Dice), always below 1.

    Sections of equal digests count whole, and so do paragraphs in those that are left; runs are
    compared only in paragraphs that differ.
    """
    if a.root == b.root:
        return 1.0
    mine, other = unmatched(a.sections, b.sections)
    x, y = ([(d, r) for i in at for d, r in zip(t.paragraphs[i], t.runs[i], strict=True)] for t, at in ((a, mine), (b, other)))
    mine, other = unmatched([d for d, _ in x], [d for d, _ in y])
    p, q = (np.concatenate([np.zeros(0, np.int64), *[z[i][1] for i in at]]) for z, at in ((x, mine), (y, other)))
    n = a.size + b.size
    return min((n - len(p) - len(q) + 2 * in_both(p, q)) / n, n / (n + 1)) if n else 0.0


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two bags share."""
    (x, n), (y, m) = (np.unique(z, return_counts=True) for z in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def edits(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """Where two texts differ: paragraphs from and to (exclusive) in ``a``, and in ``b``; trees may come from ``read``.

    Sections are compared first; only within those that differ are paragraphs looked at.
    """
    out = []
    if a.root == b.root:
        return out
    at_a, at_b = (np.cumsum([0, *map(len, t.paragraphs)]).tolist() for t in (a, b))
    for tag, i, j, k, m in SequenceMatcher(None, a.sections, b.sections, autojunk=False).get_opcodes():
        if tag != "equal":
            x, y = ([p for s in t.paragraphs[u:v] for p in s] for t, u, v in ((a, i, j), (b, k, m)))
            out += [(at_a[i] + o[1], at_a[i] + o[2], at_b[k] + o[3], at_b[k] + o[4]) for o in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o[0] != "equal"]
    return out


def place(bounds: Column, steps: int, key: Column) -> Column:
    """How many of the sorted ``bounds`` (fewer than two to the power ``steps``) are not above ``key``, by halving."""
    widths = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    return F.aggregate(widths, F.lit(0), lambda low, w: F.when(F.get(bounds, low + w - 1) <= key, low + w).otherwise(low))


def long_array(numbers: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """bucket, guest, key, doc_id, text: sorted in each partition by descending key, each bucket followed by the row that comes next.

    Buckets are ranges of ids with about equal numbers of rows. The first row of a bucket is also sent,
    as a guest, to the bucket before; that of the first bucket to the last. So texts are shuffled
    once, and the driver has two numbers a bucket.
    """
    least = -(1 << 63)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(least))
    quantiles = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx(key, quantiles, 20 * buckets)).first()[0] if quantiles else []
    bounds = sorted(set(found or []))
    bucket = place(long_array(bounds), len(bounds).bit_length(), F.col("key")) if bounds else F.lit(0)
    rows = rows.withColumn("key", key).withColumn("bucket", bucket.cast("int"))
    first = {r[0]: r[1] for r in rows.groupBy("bucket").agg(F.max("key")).collect()}
    order = sorted(first)
    heads = [first.get(b, least) for b in range(len(bounds) + 1)]
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    before = [following.get(b, 0) for b in range(len(bounds) + 1)]
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(long_array(before), F.col("bucket")).cast("int").alias("bucket"), F.lit(1).alias("guest"))
    sent = F.when(F.col("key") == F.get(long_array(heads), F.col("bucket")), F.array(own, guest)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", "key", F.explode(sent).alias("to")).select("to.bucket", "to.guest", "key", "doc_id", "text")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", F.col("key").desc(), "text")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited form, and likenesses; a row per input row.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next
    row's text, in descending order of ids; rows of one id are ordered by text, null ids come last,
    and after the last row comes the first (a lone row is its own next). A null text counts as empty.
    A very long text is one row of a batch of its own; its tree is held with that of the row before.
    Other columns are not read.
    """
    buckets = buckets or max(1, docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FINGERPRINTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        waiting = None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                rows = []
                for _, guest, _, doc_id, text in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns), strict=True):
                    if guest and not waiting:
                        continue
                    own = tree(text)
                    if waiting:
                        i, t, had = waiting
                        m = len(t) // 2
                        edited = t[: len(t) - m] + text[:m]
                        new = tree(edited)
                        rows.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(had), str(new), likeness(had, new), likeness(had, own)))
                    waiting = None if guest else (doc_id, text, own)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return with_next(small_batches(docs), id_col, text_col, buckets).mapInArrow(run, FINGERPRINTS)
