"""Concatenate and cut: all texts as one stream of ids, cut into windows of a fixed length.

The first pass tokenises each partition once, into a table in the shared folder that also has each
document's place within its partition. The sums of the partitions, one number each, are added up
to where each partition begins in the whole stream. The second pass cuts: a document that reaches
over a boundary gets a record on either side.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import CHUNKED, Chunks, chunks
from weftline.llm.common import kept, small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Chunks whose ids a worker keeps, at most.
MOST_CHUNKS = 150_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelFile:
    """A ``tokenizers`` file of byte-level BPE, read into ranks that ``tiktoken`` merges by.

    In such files an id is the rank of its merge, so both give the same ids; the file's own tokeniser
    takes what has one of its added tokens, and all texts if the file is of another kind. The ids of
    a chunk between lone spaces are kept, as in ``bpe.chunks``.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_padding()
        self.own.no_truncation()
        spec = json.loads(self.own.to_str())
        self.kind = np.dtype("<u2") if self.own.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.marks = [t.content for t in self.own.get_added_tokens_decoder().values()]
        before, letters = spec["pre_tokenizer"] or {}, byte_letters()
        ranks = {bytes(letters[c] for c in k): v for k, v in self.own.get_vocab(with_added_tokens=False).items() if k not in self.marks} if before.get("type") == "ByteLevel" else {}
        plain = pattern == CHUNKED and ranks and spec["model"]["type"] == "BPE" and not spec["normalizer"] and not before["add_prefix_space"] and before["use_regex"]
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if plain else None
        code = self.kind.char
        self.make = lambda x: array(code, self.fast.encode_ordinary(x)).tobytes()
        self.cache = Chunks(self.make, " ", MOST_CHUNKS) if self.fast else {}

    def ids(self, text: str) -> bytes:
        """The ids of one text, packed."""
        if self.fast is None or any(m in text for m in self.marks):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        first, *more = chunks(text)
        return b"".join([self.make(first), *map(self.cache.__getitem__, more)])


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> ByteLevelFile:
    return ByteLevelFile(path, pattern)


def tokenised(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, part, start (in its partition), doc_tokens and ids (binary, with the closing id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, hub = TaskContext.get().partitionId(), 0, _worker(tokenizer_path, pattern)
        close = np.array([end_id], hub.kind).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                raw = [hub.ids(t or "") + close for t in batch.column(1).to_pylist()]
                sizes = np.array([len(x) // hub.kind.itemsize for x in raw], np.int64)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(raw), pa.int32()), pa.array(starts), pa.array(sizes), pa.array(raw, pa.binary())], ["doc_id", "part", "start", "doc_tokens", "ids"])

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, part int, start long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, *, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of a document: its place in the document, its place in a sequence, its ids' crc32.

    Each text's ids are followed by ``end_id``; a null or empty text is that id alone. Every input row
    is packed, repeated rows and null ids too; of sequences only the last can be shorter than
    ``window``. Rows keep the order that the input's partitions have when read. Other columns are
    not read. To the driver go as many numbers as the input has partitions.
    """
    stored = kept(tokenised(docs, tokenizer_path, pattern, end_id, id_col, text_col), "packing")
    sums = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    begins, total = {}, 0
    for part, n in sums:
        begins[part], total = total, total + n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, part, start, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()
                at, done = begins[part] + start, 0
                while done < n:
                    seq, offset = divmod(at + done, window)
                    length = min(window - offset, n - done)
                    for column, value in zip(out, (doc_id, done, length, zlib.crc32(ids[4 * done : 4 * (done + length)]), n, seq, offset), strict=True):
                        column.append(value)
                    done += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return stored.select("doc_id", "part", "start", "doc_tokens", "ids").mapInArrow(cut, PIECES)
