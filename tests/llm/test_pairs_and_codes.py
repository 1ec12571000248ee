import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.plain import TABLES, edge_docs, edge_rows, shingle_set
from weftline.llm import codes, crosstoken, minhash, queries

FILE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# op11


def plain_components(rows, percent):
    """component of each row (doc_id, text): all pairs of sets of similar sizes compared."""
    sets = [shingle_set(t) for _, t in rows]
    group = [*range(len(rows))]

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    by_gram = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by_gram[g].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in by_gram[g] if j < i)
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                group[top(i)] = top(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[top(i)].append(rows[i][0])
    return [(i, len(s), min((x for x in members[top(k)] if x is not None), default=None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def in_rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def with_kept(rows):
    return sorted(((i, n, c, None if i is None or c is None else i == c) for i, n, c in rows), key=repr)


def crowd(seed=5):
    """Texts about a few bases, some of them longer than a sketch: copies with edits, common passages, repeated rows."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(100_000)}"
    passage = [word() for _ in range(60)]
    for size in (12, 60, 146, 300, 300, 420, 900, 2500):
        base = [word() for _ in range(size)]
        for _ in range(30):
            new = base[:]
            for _ in range(rng.randrange(1 + max(3, size // 40))):
                new[rng.randrange(size)] = word()
            rows += [" ".join(new)] * rng.choice((1, 1, 1, 3))
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(1, 40))]) for _ in range(60)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_dedup_against_all_pairs(spark):
    rows = crowd()
    found = in_rows(minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    want = with_kept(plain_components(rows, 85))
    assert found == want
    sizes = Counter(c for _, _, c, _ in want)
    assert max(sizes.values()) > 20 and sum(1 for n in sizes.values() if n == 1) > 50


def test_dedup_of_tables_and_odd_rows(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert in_rows(minhash.dedup(docs)) == with_kept(plain_components(rows, 85))
    rows = edge_rows()
    assert in_rows(minhash.dedup(edge_docs(spark, rows))) == with_kept(plain_components(rows, 85))
    assert in_rows(minhash.dedup(edge_docs(spark, rows).where("false"))) == []


def test_least_shared_is_a_binomial_bound():
    for k, percent in ((64, 85), (256, 85), (256, 75)):
        s = minhash.least_shared(k, percent, 1e-12)
        below = lambda m: sum(math.comb(k, n) * (percent / 100) ** n * (1 - percent / 100) ** (k - n) for n in range(m))
        assert below(s) <= 1e-12 < below(s + 1)


# op12


def plain_codes(rows):
    """(code, error, codebooks_sha256) of rows (vec_id, vector) of one size, every distance reckoned, in Python's integers."""
    ints = [[math.floor(4096 * float(x)) if abs(x) < 1e300 else int(x) * 4096 for x in v] for _, v in rows]
    dim = len(ints[0])
    cut = [dim * i // 8 for i in range(9)]
    order = sorted((i for i in range(len(rows)) if rows[i][0] is not None), key=lambda i: (rows[i][0], [*rows[i][1]]))[:16]
    parts = [[x[a:b] for x in ints] for a, b in zip(cut, cut[1:], strict=False)]
    books = [[p[i] for i in order] for p in parts]

    def assign(p, book):
        d = [[sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book] for x in p]
        return [(min(range(len(book)), key=x.__getitem__), min(x)) for x in d]

    for _ in range(6):
        for k, (p, book) in enumerate(zip(parts, books, strict=True)):
            own = assign(p, book)
            for e in range(len(book)):
                held = [x for x, (i, _) in zip(p, own, strict=True) if i == e]
                if held:
                    books[k][e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    found = [assign(p, book) for p, book in zip(parts, books, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [("".join(f"{f[i][0]:02x}" for f in found), sum(f[i][1] for f in found), sha) for i in range(len(rows))]


def plain_table(rows):
    """Rows (vec_id, vector, label) as op12 returns them."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for dim in {len(r[1]) for r in kept}:
        same = [r for r in kept if len(r[1]) == dim]
        out += [(r[0], r[2], *c) for r, c in zip(same, plain_codes([r[:2] for r in same]), strict=True)]
    sums = Counter()
    short = lambda e: e if e < 1 << 63 else None
    for _, label, _, error, _ in out:
        sums[label] += short(error) or 0
    return sorted(((i, c, short(e), short(sums[label]), s) for i, label, c, e, s in out), key=repr)


def coded(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_codes_of_the_table(spark):
    table = spark.read.parquet(f"{TABLES}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert coded(codes.compress(table.repartition(3))) == plain_table(rows)


def test_codes_of_odd_rows(spark):
    rng = random.Random(3)
    near = lambda dim: [rng.choice((-0.5, 0.0, 0.25, rng.random())) for _ in range(dim)]
    rows = [(i // 2 if i % 5 else None, near(16), rng.choice((None, 1, 2))) for i in range(300)]
    rows += rows[:20] + [(1, None, 1), (2, [None] * 16, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, 1)]
    rows += [(900 + i, near(13), 2) for i in range(5)] + [(950, [], None), (951, [1.0], 7)]
    schema = "vec_id long, embedding array<double>, label int, code string, error string, part string, ids string"
    table = spark.createDataFrame([(*r, "c", "e", "p", "i") for r in rows], schema).repartition(4)
    assert coded(codes.compress(table)) == plain_table(rows)
    assert coded(codes.compress(table.where("false"))) == []


def test_codes_of_large_numbers(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice((1e30, -1e12, 3.5, rng.random() * 1e6)) for _ in range(8)], 1) for i in range(80)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    assert coded(codes.compress(table)) == plain_table(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 4), st.integers(1, 16), st.integers(0, 10_000))
def test_trees_assign_as_plain_distances(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    points, entries = rng.integers(-6, 7, (n, dim)), rng.integers(-6, 7, (k, dim))
    t = codes.tree(points)
    d = ((points[:, None] - entries) ** 2).sum(2)
    code, error = codes.codes(t, entries)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    sums, counts = codes.totals(t, entries)
    for e in range(k):
        assert counts[e] == (d.argmin(1) == e).sum() and (sums[e] == points[d.argmin(1) == e].sum(0)).all()
    again = codes.tree(t.points, t.order)
    assert all((x == y).all() for a, b in zip(t, again, strict=True) for x, y in zip(a, b, strict=True))


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    entries = np.array([[0, 0], [1000, 0], [0, 1000]])
    t = codes.tree(np.concatenate([e + rng.integers(-20, 20, (500, 2)) for e in entries]))
    single = sum(len(begin) for _, begin, _, level in codes.assigned(t, entries) if level < 0)
    assert single < 100


# op13


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(FILE), sentencepiece.SentencePieceProcessor(model_file=MODEL)
        self.a.encode_special_tokens = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in visible)}
        self.a_bytes = {v: bytes(letters.get(c, 0) for c in k) for k, v in self.a.get_vocab().items()}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        """[(id, end)] of either side; none if bytes differ."""
        out = []
        for ids, own in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes.__getitem__), (self.b.encode(text), self.b_bytes)) if text else ():
            at, side, data = 0, [], b""
            for i in ids:
                data += own(i)
                at = len(data)
                side.append((i, at))
            if data != b" " + text.encode():
                return [], []
            out.append(side)
        return out or ([], [])

    def table(self, rows):
        aligned, counts = [], Counter()
        for i, text in rows:
            a, b = self.tokens(text)
            ends = sorted({e for _, e in a} & {e for _, e in b})
            linked = [(x, y) for x, e in a for y, f in b[:0] or [t for t in b if t[1] == e] for _ in [f]]
            groups = [";".join("|".join(",".join(str(x) for x, e in side if (low < e <= high)) for side in (a, b)) for low, high in zip([0, *ends], ends, strict=False))]
            counts.update(linked)
            aligned.append((i, len(a), len(b), len(ends), linked, hashlib.sha256(groups[0].encode()).hexdigest() if a else ""))
        best = Counter()
        for (_, y), n in counts.items():
            best[y] = max(best[y], n)
        return sorted(((i, na, nb, ng, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for i, na, nb, ng, ls, sha in aligned), key=repr)


def odd_texts():
    special = ["a <|endoftext|> b", "<s>x</s> <unk> <0x41>", "a▁b", "two  spaces", " lead", "trail ", "tab\tand\nline\r\n", "nul \x00 byte", "é ① ﬁ", "\U0001f600 emoji", "x" * 5000, " ", "\n", "don't we'll 12345"]
    return [(100 + k, t) for k, t in enumerate(special)]


def aligned_rows(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert df.columns == columns
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("most", [1 << 20, 300, 0])
def test_alignment_against_plain(spark, most):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + odd_texts() + [(i, t) for i, t in edge_rows() if not t or len(t) < 5000]
    found = crosstoken.align(edge_docs(spark, rows), FILE, MODEL, public_tokenizers.PATTERN, most_pairs=most)
    assert aligned_rows(found) == Plain().table(rows)
    if not most:
        assert aligned_rows(crosstoken.align(edge_docs(spark, rows).where("false"), FILE, MODEL, public_tokenizers.PATTERN)) == []


@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=30))
def test_links_by_plain_loops(a, b):
    for kind in ("end", "overlap"):
        i, j = crosstoken.links(np.cumsum(np.array(a, np.int64)), np.cumsum(np.array(b, np.int64)), kind)
        want = []
        for x in range(len(a)):
            for y in range(len(b)):
                low, high, low2, high2 = sum(a[:x]), sum(a[: x + 1]), sum(b[:y]), sum(b[: y + 1])
                if high == high2 if kind == "end" else low < high2 and low2 < high:
                    want.append((x, y))
        assert [*zip(i.tolist(), j.tolist(), strict=True)] == want


def test_new_queries_run(spark):
    for name in ("op11_bottom_k_dedup", "op12_vector_codes", "op13_cross_tokens"):
        assert name in queries.QUERIES
