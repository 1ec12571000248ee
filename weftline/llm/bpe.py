"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece there is exactly one token that can end a valid encoding of it. The
encoder keeps these last tokens in an array: following them backwards gives the encoding of any
prefix, appending bytes only adds entries, and after an edit the entries before it stay valid.

A token may follow another only if the merges of both together give back just these two. A
sequence is the encoding of its bytes exactly if that holds for each adjacent pair.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftline.llm.common import small_batches

#: White space as Unicode has it, by code point.
SPACE_POINTS = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = "".join(map(chr, SPACE_POINTS))
#: What Python takes for white space, other than the plain space and the line feed.
ODD_SPACE = "".join(map(chr, (*(c for c in SPACE_POINTS if c not in (10, 32)), 0x1C, 0x1D, 0x1E, 0x1F)))
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
CACHE_ENTRIES = 400_000
#: Characters of a piece or chunk whose ids are kept, at most, so that a cache is bounded in bytes too.
LONGEST_KEPT = 64
#: Fixed value: the splitting pattern for which texts may be cut into chunks, and those shortened. Texts go whole through any other.
CHUNKED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def split_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with ``\s`` and ``\S`` written out, so that they match Unicode white space only."""
    inside = re.sub(r"\[\^\\s", lambda _: f"[^{SPACE}", pattern)
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def chunks(text: str) -> list[str]:
    """``text`` cut at each plain space that stands alone between other characters.

    All chunks but the first belong with the space before them. A piece of the usual splitting
    patterns never reaches over such a space, so chunks can be encoded separately.
    """
    if "  " in text or "\n " in text or " \n" in text or any(c in text for c in ODD_SPACE):
        return LONE_SPACE.split(text)
    return text.split(" ")


class PrefixBpe:
    """Encoder and decoder over one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, split_pattern(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        for data, rank in ranks.items():
            self.automaton.add_word(data.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pieces: dict[str, list[int]] = {}

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """Merges of lowest rank first, leftmost of equals, down to ``least`` parts: the plain definition, for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            found = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, at = min(found)
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of ``token`` joins; None of a byte, and of what merges never make."""
        if token not in self._halves:
            parts = self.merged(self.bytes_of[token], 2)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 and self.merged(self.bytes_of[token]) == [token] else None
        return self._halves[token]

    def _stands(self, token: int) -> bool:
        return self.size[token] == 1 or self._split(token) is not None

    def _follows(self, a: int, b: int) -> bool:
        """Whether the merges of both together end in just these two.

        Merges on either side of the boundary are undone, the latest first; none across it may have had a
        lower rank than the one undone, or the same rank and stand further left.
        """
        if (ok := self._pairs.get(a << 32 | b)) is None:
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            x, y, limit, ok = a, b, 1 << 60, self._stands(a) and self._stands(b)
            while ok:
                if self.ranks.get(self.bytes_of[x] + self.bytes_of[y], limit) < limit:
                    ok = False
                elif self.size[x] > 1 and (x > y or self.size[y] == 1):
                    limit, x = x, self._split(x)[1]
                elif self.size[y] > 1:
                    limit, y = y + 1, self._split(y)[0]
                else:
                    break
            self._pairs[a << 32 | b] = ok
        return ok

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Completes ``last``, the last tokens of the prefixes of ``data``, from its present length on.

        An automaton gives the tokens that end at each byte, longest first; the first that may follow
        what stands before it is the one.
        """
        done, follows, size = len(last), self._follows, self.size
        start = max(0, done - self.longest + 1)
        for end, token in self.automaton.iter(data.decode("latin-1"), start):
            if end == len(last):
                begin = end + 1 - size[token]
                if begin >= start or not start:
                    if follows(last[begin - 1], token) if begin else self._stands(token):
                        last.append(token)
        if len(last) < len(data):
            raise ValueError(f"no token for byte {data[len(last)]}")
        return last

    def backwards(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes (of all, by default)."""
        end, out = len(last) if end is None else end, []
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def piece(self, piece: str) -> list[int]:
        """Tokens of a match of the pattern; one that is a token as a whole is that token."""
        if (ids := self._pieces.get(piece)) is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None else self.backwards(self.extend(data, []))
            if len(piece) <= LONGEST_KEPT:
                if len(self._pieces) >= CACHE_ENTRIES:
                    self._pieces.clear()
                self._pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.piece(piece)]

    def packed(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        return np.array(self.encode(text), "<u4").tobytes()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableText:
    """A text with its encoding by pieces, kept exact under appends and edits.

    An edit splits anew from the piece before it; once a new piece begins where an old one began,
    behind the edit, the rest is taken over. In a piece that is only longer, the last tokens of its
    old prefixes are kept.
    """

    def __init__(self, bpe: PrefixBpe, text: str = ""):
        self.bpe, self.text, self._last = bpe, "", {}
        self.pieces: list[tuple[int, str, list[int]]] = []
        self.replaced = 0  # pieces split anew by the last edit
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for _, _, ids in self.pieces for i in ids]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in place of the code points from ``start`` to ``end``."""
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        at = next((k for k, (b, p, _) in enumerate(self.pieces) if b + len(p) >= start), len(self.pieces))
        at = max(0, at - 1)  # the piece before may now reach further
        old_begins = {b + shift: k for k, (b, _, _) in enumerate(self.pieces) if b >= end and k > at}
        begin, made, rest = (self.pieces[at][0] if at < len(self.pieces) else 0), [], []
        for m in self.bpe.pattern.finditer(self.text, begin):
            if m.start() in old_begins and m.start() >= start + len(new) and made:
                rest = [(b + shift, p, ids) for b, p, ids in self.pieces[old_begins[m.start()] :]]
                break
            made.append((m.start(), m[0], self._ids(m[0])))
        self.replaced = len(made)
        self.pieces = self.pieces[:at] + made + rest

    def _ids(self, piece: str) -> list[int]:
        data = piece.encode()
        if (whole := self.bpe.ranks.get(data)) is not None:
            return [whole]
        old, last = self._last.get("piece", b""), self._last.get("last", [])
        last = self.bpe.extend(data, last[: len(commonprefix((old, data)))])
        self._last = {"piece": data, "last": last}
        return self.bpe.backwards(last)


class Chunks(dict):
    """The ids of chunks with ``before`` before them, made once; those not asked for again, and long ones, are dropped.

    Only what is not yet known is encoded: a line feed between other characters, and a full stop
    or comma behind a letter or digit, are pieces of their own.
    """

    def __init__(self, make, before: str, most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.before, self.most, self.older = make, before, most, {}
        self.after_line = self if not before else Chunks(make, "", most)
        self.single = {c: make(c) for c in ".,\n"}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if (value := self.older.get(chunk)) is None:
            at = chunk.find("\n", 1)
            if 0 < at < len(chunk) - 1 and not chunk[at - 1].isspace() and not chunk[at + 1].isspace():
                value = self[chunk[:at]] + self.single["\n"] + self.after_line[chunk[at + 1 :]]
            elif len(chunk) > 1 and chunk[-1] in ".," and chunk[-2].isalnum():
                value = self[chunk[:-1]] + self.single[chunk[-1]]
            else:
                value = self.make(self.before + chunk)
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = value
        return value


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> tuple[PrefixBpe, Chunks]:
    bpe = PrefixBpe(load_ranks(path), pattern)
    return bpe, Chunks(bpe.packed, " ")


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes each whole text and decodes its ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary, little-endian
    unsigned 32-bit): a row per input row, null ids and repeated rows included. A null text counts as
    empty; no ids give the digests of empty strings. Texts go whole, however long. Other columns are not read.
    """
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = _worker(ranks_path, pattern)
        names = [b"%d" % i for i in range(max(bpe.bytes_of) + 1)]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                packed, counts, shas, decoded = [], [], [], []
                for text in part.column(1).to_pylist():
                    first, *more = chunks(text or "") if pattern == CHUNKED else [text or ""]
                    raw = b"".join([bpe.packed(first), *map(cache.__getitem__, more)])
                    ids = np.frombuffer(raw, "<u4").tolist()
                    packed.append(raw)
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(b",".join(map(names.__getitem__, ids))).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(packed, pa.binary())] * with_ids, [k.split()[0] for k in kinds.split(", ")])

    return small_batches(docs).select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, kinds)
