"""Names out of texts: replacements that depend on the match, scrubbing, leaks, citations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Capitalised words that are no personal names.
NOT_NAMES = (
    "District", "Respondent", "Respondents", "Education", "Code", "Board", "Accusation", "Resolution", "Section", "County", "School", "Services",
    "Title", "Notice", "Hearing", "Evidence", "Credential", "ALJ", "Judge", "Administrative", "Law", "Order", "Decision", "State", "California",
    "Unified", "Union", "Elementary", "Secondary", "High", "Office", "Act", "Government", "Article", "Whether", "The", "Respondent's", "PKS", "FTE",
    "ADA", "March", "January", "February", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Monday",
    "Tuesday", "Wednesday", "Thursday", "Friday", "Superintendent", "Skipping", "Bumping", "Seniority", "Competency", "Procedural", "Reduction",
)
#: Words of bodies and places, never scrubbed.
BODIES = (
    "Unified", "Union", "District", "School", "Schools", "County", "Office", "Education", "Code", "Board", "Community", "Court", "Center", "Department",
    "Association", "Act", "Resolution", "Elementary", "Secondary", "High", "Valley", "Oak", "Charter", "City", "Joint", "Area", "Service", "Special",
    "Government", "State", "California", "Administrative", "Law", "Title", "Section", "Article", "Subject", "Single", "Multiple", "Reading", "English",
    "Spanish", "Math", "Science", "Business", "Computer", "Physical", "Home",
)
#: Capitalised words that are never taken for a misspelt surname.
NEVER_NEAR = (
    "district", "respondent", "respondents", "education", "code", "board", "accusation", "april", "march", "english", "spanish", "french", "german",
    "county", "school", "services", "section", "american", "resolution", "february", "january", "title", "master", "doctor", "found", "order",
    "judge", "court", "state", "notice", "hearing", "evidence", "credential",
)
#: Terms that give an issue away, by category; texts are lower-cased first.
GIVEAWAYS = {
    "skipping": (r"\bskip(?:p?ed|ping|s)?\b", r"deviat\w+ from seniority"),
    "bumping": (r"\bbump(?:ed|ing|s)?\b",),
    "tie_breaking": (r"tie[- ]?break\w*", r"break\w*\s+the\s+tie", r"tie[d]?\s+seniority"),
    "competency": (r"\bcompeten\w+\b",),
    "pks_reduction": (r"particular kinds? of services", r"\bPKS\b", r"reduction (?:in|of) (?:particular )?services"),
    "domino_theory": (r"\bdomino\b",),
    "attrition": (r"\battrition\b", r"positively assured"),
    "reemployment_rights": (r"reemploy\w*", r"reappoint\w*", r"39[- ]month"),
    "categorically_funded": (r"categorical\w*",),
    "credentials": (r"\bcredential\w*\b",),
}
#: Shapes of names and citations.
NAME_WORD = r"[A-Z][a-zà-ÿ'\-]+"
TITLED = rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Superintendent|Principal|Director|Coordinator)\.?\s+{NAME_WORD}(?:\s+{NAME_WORD})?"
TWO_NAMES = rf"\b{NAME_WORD}\s+{NAME_WORD}\b"
CITE = r"([A-Z][\w.,'&/ -]{0,60}?)?\(\s*(?:ALJ\s+)?([A-Z][a-zà-ÿ'’-]+)\s*\)\s*,?\s*((?:19|20)\d{2})"
NEAR_WORD = re.compile(r"\b[A-Z][A-Za-zà-ÿ'\-]{2,}\b")
NO_NEAR_LETTER = re.compile(r"[^a-zà-ÿ'\-]")
BEFORE_MARK = re.compile(r"\b([A-Za-zà-ÿ'\-]+)\s+(?=R\d+\b|\[a respondent\])")


def replaced(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """``text`` with each match of ``pattern`` (never empty) changed by ``new``; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    change = lambda gap, match: F.concat(gap, F.when(match.isNull(), "").otherwise(new(match)))
    return F.array_join(F.zip_with(F.split(whole, pattern, -1), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), change), "")


def replaced_capitals(text: Column, pattern: str, mark: str) -> tuple[Column, Column]:
    """Matches of ``pattern`` replaced by ``mark``, but for those all in lower case; and how many were."""
    whole = F.coalesce(text, F.lit(""))
    lower = lambda m: (F.lower(m) == m) & (F.upper(m) != m)
    n = F.size(F.filter(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), lambda m: ~lower(m)))
    return replaced(text, pattern, lambda m: F.when(lower(m), m).otherwise(mark)), n


def scrubbed(text: Column) -> Column:
    """Names behind a title, and pairs of capitalised words of which none is a body's or a known other word, give way to ``[name]``."""
    kept = lambda m: F.arrays_overlap(F.split(m, r"\s+"), F.array(*map(F.lit, sorted({*NOT_NAMES, *BODIES}))))
    return replaced(F.regexp_replace(text, TITLED, "[name]"), TWO_NAMES, lambda m: F.when(kept(m), m).otherwise("[name]"))


def leaks(text: Column, terms: dict[str, tuple[str, ...]] = GIVEAWAYS) -> Column:
    """category and sorted distinct hits, of categories whose terms stand in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = lambda patterns: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in patterns]))))
    return F.filter(F.array(*[F.struct(F.lit(c).alias("category"), hits(p).alias("hits")) for c, p in terms.items()]), lambda x: F.size(x["hits"]) > 0)


def cites(text: Column) -> Column:
    """district (null if there is none), judge and year of each citation ``District (Judge), Year``, in order."""
    part = lambda i: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITE), F.lit(i))
    rows = F.arrays_zip(part(1).alias("d"), part(2).alias("j"), part(3).alias("y"))
    return F.transform(rows, lambda r: F.struct(F.nullif(F.btrim(r["d"], F.lit(" *,.-")), F.lit("")).alias("district"), r["j"].alias("judge"), r["y"].cast("int").alias("year")))


def unnamed(text: Column, district: Column, judge: Column) -> Column:
    """The row's own district and judge out of its text; ``Judge (`` stays, as it cites."""
    plain = F.when(F.coalesce(district, F.lit("")) != "", F.replace(text, district, F.lit("the District"))).otherwise(text)
    own = F.concat(F.lit(r"\b\Q"), judge, F.lit(r"\E\b(?!\s*\()"))
    return F.when(F.coalesce(judge, F.lit("")) != "", F.regexp_replace(plain, own, F.lit("[ALJ]"))).otherwise(plain)


def wanted_names(roster: list[dict], judge: str, district: str) -> tuple[dict[str, str], set[str]]:
    """Texts to look for with their marks, and first names in lower case; a surname that is the judge's or in the district's name is left out."""
    marks: dict[str, str] = {}
    firsts = set()
    for name, mark in ((str(r["name"] or "").strip(), r["ref"]) for r in roster):
        if not name or not mark:
            continue
        last, comma, first = (x.strip() for x in name.partition(","))
        if not comma:
            first, last = name.split()[0], name.split()[-1]
        for full in [f"{first} {last}", name] if comma else [name]:
            marks.setdefault(full, mark)
        firsts.update(w.lower() for w in first.split()[:1])
        if len(last) >= 3 and last.lower() != judge and last.lower() not in district:
            marks.setdefault(last, mark)
    return marks, firsts


def one_edit(a: str, b: str) -> bool:
    """Whether one edit at most parts two words: behind the common start and before the common end, one letter is left at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[start + 1 :] == b[start + 1 :] or a[start:] == b[start + 1 :] or a[start + 1 :] == b[start:]


def latin(text: str) -> bool:
    """Whether a letter of the text matches in either case just what has the same lower-case letter: so it is within Latin-1."""
    return text.isascii() or max(text) <= "\xff"


def whole_words(text: str, name: str) -> Iterator[tuple[int, int]]:
    """Spans of ``name`` in ``text``, spelt just so, between word boundaries as ``\\b`` has them.

    Every row has names of its own, so a pattern for each would be compiled anew for each row.
    """
    a, size, last = text.find(name), len(name), len(text)
    while a >= 0:
        b = a + size
        before, after = a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_"), b < last and (text[b].isalnum() or text[b] == "_")
        if before != (name[0].isalnum() or name[0] == "_") and after != (name[-1].isalnum() or name[-1] == "_"):
            yield a, b
            a = text.find(name, b)
        else:
            a = text.find(name, a + 1)


def ordered(marks: dict[str, str]) -> tuple[list[tuple[str, str, str, bool]], list[tuple[str, str]]]:
    """Names with their lower case and mark, longest first, and surnames that a word may be one edit away from; worked out once a row."""
    names = [(n, n.lower(), marks[n], latin(n)) for n in sorted(marks, key=len, reverse=True)]
    # an edit changes one letter, so a name with two that no near word has is near none
    surnames = [(low, mark) for n, low, mark, _ in names if " " not in n and len(n) >= 5 and len(NO_NEAR_LETTER.sub("", low)) >= len(low) - 1]
    return names, surnames


def pseudonymous(text: str, marks: dict[str, str], firsts: set[str], judge: str, district: str, known: tuple | None = None) -> tuple[str, int]:
    """The text with names as marks, longest names first, and the number of replacements; spans once taken stay. ``known``: ``ordered`` of the marks."""
    names, surnames = known or ordered(marks)
    spans: list[tuple[int, int, str]] = []
    free = lambda a, b: all(b <= x or a >= y for x, y, _ in spans)
    plain, lower = text.isascii() or latin(text), text.lower()
    for name, low, mark, simple in names:
        # beyond Latin-1 a letter may match several in either case, which a pattern knows
        if plain and simple:
            if low not in lower:
                continue
            found = whole_words(lower, low)
        else:
            found = (m.span() for m in re.finditer(rf"\b{re.escape(name)}\b", text, re.IGNORECASE))
        for a, b in found:
            if (" " in name or not text[a:b].islower()) and (not spans or free(a, b)):
                spans.append((a, b, mark))
    near: dict[str, str] = {}
    for word in {m[0] for m in NEAR_WORD.finditer(text) if free(*m.span())} if surnames else ():
        low = word.lower()
        if not (word.isupper() or low == judge or low in district or low in NEVER_NEAR):
            if found := {mark for n, mark in surnames if one_edit(low, n)}:
                near[word] = found.pop() if len(found) == 1 else "[a respondent]"
    for word, mark in near.items():
        spans += [(a, b, mark) for a, b in whole_words(text, word) if free(a, b)]
    at, joined, pieces = 0, "", 0
    for a, b, mark in sorted(spans):
        joined += text[at:a] + mark
        at = b
    joined += text[at:]

    def alone(m: re.Match) -> str:
        nonlocal pieces
        pieces += m[1].lower() in firsts
        return "" if m[1].lower() in firsts else m[0]

    left = joined.lower()
    for first in firsts:
        if first in left:
            joined = BEFORE_MARK.sub(alone, joined)
            break
    return joined, len(spans) + pieces


@F.pandas_udf(ArrayType(StructType().add("text", "string").add("n", "integer")))
def deidentified(texts: pd.Series, roster: pd.Series, judge: pd.Series, district: pd.Series) -> pd.Series:
    """Each of a row's texts with roster names as marks; a null text is empty, a null roster names nobody.

    Order decides which name wins, which built-in functions can't express. Any leaf of a nested
    record can be sent in one call a row.
    """
    out = []
    for row, names, j, d in zip(texts, roster, judge, district, strict=True):
        j, d = (j or "").lower(), (d or "").lower()
        marks, firsts = wanted_names(names if names is not None else [], j, d)
        order = ordered(marks)
        changed = [pseudonymous(t or "", marks, firsts, j, d, order) for t in (row if row is not None else [])]
        out.append([{"text": t, "n": n} for t, n in changed])
    return pd.Series(out)


def walked(values: pa.Array, rows: np.ndarray, change: Callable[[str, int], str]) -> pa.Array:
    """``values`` of any nested type with each string leaf changed, given the number of the row that it belongs to; map keys stay."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pa.array([None if t is None else change(t, r) for t, r in zip(values.to_numpy(zero_copy_only=False), rows.tolist(), strict=True)], kind)
    if pa.types.is_struct(kind):
        inner = [walked(x, rows, change) for x in values.flatten()]
        return pa.StructArray.from_arrays(inner, fields=list(kind), mask=values.is_null()) if inner else values
    if pa.types.is_map(kind) or pa.types.is_list(kind):
        own = values.to_pylist() if pa.types.is_map(kind) else None
        sizes = np.array([len(x or ()) for x in own]) if own is not None else pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
        ends, inside = np.concatenate([[0], np.cumsum(sizes)]), np.repeat(rows, sizes)
        if own is not None:
            keys, items = (pa.array([pair[i] for x in own for pair in x or ()], t) for i, t in ((0, kind.key_type), (1, kind.item_type)))
            null = values.is_null().to_pylist() + [False]
            return pa.MapArray.from_arrays(pa.array([None if n else int(e) for e, n in zip(ends, null, strict=True)], pa.int32()), keys, walked(items, inside, change)).cast(kind)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), walked(values.flatten(), inside, change), mask=values.is_null()).cast(kind)
    return values


def listed(roster: pa.ListArray) -> list[list[dict]]:
    """Names and marks of each row's roster, taken by whole columns; nulls name nobody."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(roster), 0).to_numpy(zero_copy_only=False)).tolist()
    names, marks = (pc.struct_field(roster.flatten(), c).to_numpy(zero_copy_only=False) for c in ("name", "ref"))
    people = [{"name": n, "ref": m} for n, m in zip(names, marks, strict=True)]
    return [people[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def nested_deidentified(records: DataFrame, column: str, roster: str, judge: str, district: str) -> DataFrame:
    """``records`` with roster names as marks in every string of a nested column, however deep: structs, arrays and map values.

    The schema stays as it is, nulls stay null, map keys and other types stay. A row's names are worked out
    once, for all of its leaves. roster: an array of structs with ``name`` and ``ref``; nulls name nobody.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judges, districts = (b.column(c).to_numpy(zero_copy_only=False) for c in (judge, district))
            low = [((j or "").lower(), (d or "").lower()) for j, d in zip(judges, districts, strict=True)]
            known = [wanted_names(people, *jd) for people, jd in zip(listed(b.column(roster)), low, strict=True)]
            order = [ordered(marks) for marks, _ in known]
            changed = walked(b.column(column), np.arange(b.num_rows), lambda t, r: pseudonymous(t, *known[r], *low[r], order[r])[0])
            yield b.set_column(b.schema.get_field_index(column), b.schema.field(column), changed)

    return records.mapInArrow(run, records.schema)
