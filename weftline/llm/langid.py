"""Language identification of words, and of spans of mixed text.

A word's scores are the log-probabilities of its letter n-grams in each learned language. The
word's script leaves only languages that use it. Over a text's words, Viterbi finds the labels of
highest total, where a change of language costs a penalty; the language with most letters wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, small_batches
from weftline.llm.quality import held_out

#: The most documents of a language that fitting reads (those of least hash), and the table of n-gram scores.
SAMPLE_DOCS = 1500
CELLS = 1 << 16
SWITCH = 8.0
UNKNOWN = "und"
CACHE_WORDS = 400_000
#: A dirty column may name any number of languages; each costs a table of ``CELLS`` numbers.
MOST_LANGS = 200
WORD = re.compile(r"[^\W\d_]+")
#: First and last code points of scripts' main blocks.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = (*dict.fromkeys(n for n, _, _ in SCRIPTS), "other")


def script(word: str) -> int:
    """The index in ``SCRIPT_NAMES`` of the script of a word's first letter."""
    c = ord(word[0])
    return next((SCRIPT_NAMES.index(n) for n, a, b in SCRIPTS if a <= c <= b), len(SCRIPT_NAMES) - 1)


def ngram_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the 1- to 4-grams of each word within ``^`` and ``$``, and where each word's begin.

    The n-grams that end at a letter are hashed together from the code points; those that would
    begin before the word are hashed as they are, with the marks between words.
    """
    flat = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    begin = np.cumsum(sizes) - sizes
    since = np.arange(len(flat)) - np.repeat(begin, sizes)  # letters before this one in its word
    out, mixed = np.zeros((len(flat), 4), np.uint64), np.zeros(len(flat), np.uint64)
    for n in range(4):
        back = np.zeros(len(flat), np.uint64)
        back[n:] = flat[: len(flat) - n]
        back[since < n] = 0
        mixed = (mixed + back + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        out[:, n] = mixed % np.uint64(CELLS)
    return out.astype(np.int64), begin


class Model(NamedTuple):
    langs: list[str]
    scores: np.ndarray  # cells x languages: log-probabilities, each row less its mean
    scripts: np.ndarray  # scripts x languages: 0 where the language uses the script, else a large penalty


def counted(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, cell, n: n-gram counts of whole texts; cells of ``CELLS`` on count words by script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
        for lang, words in seen.items():
            if not words:
                continue
            cells, begin = ngram_cells([*words])
            weight = np.repeat(np.fromiter(words.values(), float, len(words)), np.diff([*begin, len(cells)]))
            count = np.bincount(cells.ravel(), np.repeat(weight, 4), CELLS + len(SCRIPT_NAMES))
            for w, n in words.items():
                count[CELLS + script(w)] += n
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(count[at])], ["lang", "cell", "n"])

    return small_batches(docs).select(docs[lang_col].cast("string"), docs[text_col].cast("string")).mapInArrow(run, "lang string, cell long, n double")


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, most_langs: int = MOST_LANGS, parts: int = 3, part: int = 1) -> Model:
    """Fits on whole texts of documents that have a language and aren't held out.

    Of each language, about ``sample_docs`` documents: a share of the hash range, set by its count.
    To the driver goes a table of ``CELLS`` counts per language, of at most ``most_langs`` languages: those of most documents,
    of equals those first in alphabetical order. Repeated rows count as often as they are there.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col), parts, part))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_langs).collect()}
    if not sizes:
        return Model([], np.zeros((CELLS, 0)), np.zeros((len(SCRIPT_NAMES), 0)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_docs / n))])
    sample = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.get(F.array(share[F.col(lang_col)]), F.lit(0)) * 1_000_000)
    langs = sorted(sizes)
    table = np.zeros((CELLS + len(SCRIPT_NAMES), len(langs)))
    for r in counted(sample, id_col, text_col, lang_col).groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():
        table[r["cell"], langs.index(r["lang"])] += r["n"]
    grams, scripts = table[:CELLS] + 0.5, table[CELLS:]
    scores = np.log(grams / grams.sum(0))
    uses = scripts >= np.maximum(1, 0.01 * scripts.sum(0))
    return Model(langs, scores - scores.mean(1, keepdims=True), np.where(uses | ~uses.any(1, keepdims=True), 0.0, -1e6))


class WordScores:
    """The score row of each word, made once; bounded."""

    def __init__(self, model: Model):
        self.model, self.row, self.rows = model, {}, np.zeros((0, len(model.langs)))

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of ``self.rows`` for the words of each text."""
        if len(self.row) > CACHE_WORDS:
            self.row, self.rows = {}, self.rows[:0]
        new = [w for w in set().union(*texts) if w not in self.row] if texts else []
        made = []
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            cells, begin = ngram_cells(some)
            made.append(np.add.reduceat(self.model.scores[cells].sum(1), begin, axis=0) + self.model.scripts[[*map(script, some)]])
        self.row.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, *made])
        return [np.fromiter(map(self.row.__getitem__, t), np.int64, len(t)) for t in texts]


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best labels of each sequence of score rows, a step of all sequences at a time; ties go to the earlier language."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    out: list = [None] * len(scores)
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    offset = np.concatenate([[0], np.cumsum(alive)])
    n_langs = scores[0].shape[1] if scores else 0
    if not n_langs:
        return [np.zeros(len(s), np.int16) for s in scores]
    laid = np.empty((int(offset[-1]), n_langs))
    for k, i in enumerate(order):
        if len(scores[i]):
            laid[offset[: len(scores[i])] + k] = scores[i]
    back = np.empty((int(offset[-1]), n_langs), np.int16)
    best = np.zeros((len(scores), n_langs))
    own = np.arange(n_langs)
    for t in range(steps):
        m = alive[t]
        now = best[:m]
        top = now.argmax(1)
        jump = now[np.arange(m), top] - switch
        stay = now >= jump[:, None]
        back[offset[t] : offset[t + 1]] = np.where(stay, own, top[:, None])
        best[:m] = np.where(stay, now, jump[:, None]) + laid[offset[t] : offset[t + 1]]
    label = best.argmax(1)
    chosen = np.empty(int(offset[-1]), np.int16)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        chosen[offset[t] : offset[t] + m] = label[:m]
        label[:m] = back[np.arange(offset[t], offset[t + 1]), label[:m]]
    for k, i in enumerate(order):
        out[i] = chosen[offset[: len(scores[i])] + k]
    return out


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case; as many as there are in the text as it is, where lower case is longer too."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def labelled(texts: list[str | None], model: Model, words: WordScores, switch: float) -> Iterator[tuple[list[re.Match] | list[str], np.ndarray]]:
    """The words of each text, in lower case, and their labels; a group of texts of about equal work at a time."""
    at = 0
    while at < len(texts):
        end, room = at, 2_000_000
        while end < len(texts) and (room > 0 or end == at):
            room -= len(texts[end] or "") + 1
            end += 1
        found = [words_of(t or "") for t in texts[at:end]]
        yield from zip(found, viterbi([words.rows[r] for r in words.of(found)], switch), strict=True)
        at = end


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and n_switches, a row per input row, null ids and repeated rows included.

    ``score`` is the share of letters in words of the predicted language; equal shares go to the
    language first in alphabetical order. A text that is null or has no letters, or any text if no
    language was learned, is ``und`` with score 0. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = WordScores(model), len(model.langs)
        for b in slices(batches):
            langs, scores, switches = [], [], []
            for found, label in labelled(b.column(1).to_pylist(), model, words, switch):
                if not n or not any(any(map(str.isalpha, w)) for w in found):  # numerals such as Ⅷ are no letters
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    switches.append(0)
                    continue
                letters = np.bincount(label, np.fromiter(map(len, found), float, len(found)), n)
                langs.append(model.langs[int(letters.argmax())])
                scores.append(float(letters.max() / letters.sum()))
                switches.append(int((label[1:] != label[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(switches, pa.int64())], ["doc_id", "lang_pred", "score", "n_switches"])

    return small_batches(docs).select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_switches long")


def spans(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """doc_id, start, end (code points, end exclusive) and lang of each longest run of words of one language.

    Texts that are null or have no letters have no rows, nor has any if no language was learned; repeated rows and null
    ids have their own. Texts are taken whole. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(model)
        for b in slices(batches):
            rows = []
            texts = b.column(1).to_pylist()
            for doc_id, text, (found, label) in zip(b.column(0).to_pylist(), texts, labelled(texts, model, words, switch), strict=True):
                places = [m.span() for m in WORD.finditer(text or "")]
                if not model.langs:
                    continue
                for k in [i for i in range(len(label)) if not i or label[i] != label[i - 1]]:
                    last = next((i for i in range(k + 1, len(label)) if label[i] != label[k]), len(label)) - 1
                    rows.append((doc_id, places[k][0], places[last][1], model.langs[label[k]]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "start", "end", "lang"])

    return small_batches(docs).select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, start long, end long, lang string")


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text", switch: float = SWITCH, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, in one learned language for at least the share ``least`` of their letters.

    Null texts and texts without letters go, as do all if no language was learned; repeated rows and null ids are judged like any other.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = WordScores(model), len(model.langs)
        for b in slices(batches, at):
            good = []
            for found, label in labelled(b.column(at).to_pylist(), model, words, switch):
                letters = np.bincount(label, np.fromiter(map(len, found), float, len(found)), n) if found and n else np.zeros(1)
                good.append(bool(letters.sum() and letters.max() >= least * letters.sum()))
            yield b.filter(pa.array(good, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
