"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name suffixes that are no surname, and words that titles keep in lower case.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "esq")
SMALL_WORDS = ("of", "and", "the", "for", "de", "del", "la", "las", "los")
#: Words of four letters or more that say nothing of a text's content.
STOP_WORDS = (
    "that", "this", "with", "from", "were", "have", "been", "such", "which",
    "their", "would", "could", "there", "respondent", "respondents",
    "district", "because", "where", "when", "shall", "must", "than",
    "they", "them", "into", "more", "less", "year", "years", "alj",
    "section", "education", "code", "board", "school", "teacher", "teachers",
)

#: Categories that count as another one, and the eras by their last year.
SAME_CATEGORY = {"pks_allowed": "pks_reduction", "pks_not_allowed": "pks_reduction"}
ERAS = ((2001, "1999-2001"), (2010, "2004-2009"), (None, "2018-2025"))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case; accented letters part words. Null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def folded(text: Column) -> Column:
    """Without accents, in lower case, with single spaces: letters of Latin blocks that are a base letter with marks become the base, combining marks go."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and all(map(unicodedata.combining, d[1:]))]
    plain = F.regexp_replace(F.translate(text, *map("".join, zip(*pairs, strict=True))), r"\p{Mn}", "")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def content_words(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of four letters or more (accented ones too) that are not in ``stop``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zà-ÿ]{4,}"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def surname(name: Column) -> Column:
    """The last word of a name once commas and suffixes are gone; null if nothing is left."""
    words = F.filter(F.split(F.trim(F.regexp_replace(name, ",", " ")), r"\s+"), lambda w: (w != "") & ~F.lower(F.regexp_replace(w, r"\.", "")).isin(*SUFFIXES))
    return F.try_element_at(words, F.lit(-1))


def title_case(text: Column) -> Column:
    """Each word capitalised; small words only where they come first."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(capital(w))), " ")


def citation(text: Column) -> Column:
    """A citation up to its first bracket or comma: single spaces, no closing dots, lower case."""
    cut = F.trim(F.regexp_replace(F.regexp_replace(text, r"[(,][\s\S]*$", ""), r"\s+", " "))
    return F.lower(F.regexp_replace(cut, r"\.+$", ""))


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def names_itself(text: Column, name: Column) -> Column:
    """Whether the row's own name stands in the text as a whole word, case as it is."""
    return F.rlike(text, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")))


def near_equal(a: Column, b: Column) -> Column:
    """Whether one edit at most turns one into the other."""
    return F.levenshtein(a, b, 1) >= 0


def without_lines(text: Column, start: str) -> Column:
    """The text less its lines that begin with ``start`` and a colon, in any case."""
    return F.regexp_replace(text, rf"(?im)^\s*{start}\s*:.*\n?", "")


def capital_spans(text: Column, known: tuple[str, ...] = ()) -> Column:
    """Runs of one to three capitalised words that aren't all ``known``."""
    spans = F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zà-ÿ'\-]+(?:\s+[A-Z][a-zà-ÿ'\-]+){0,2}\b"), F.lit(0))
    return F.filter(spans, lambda s: ~F.forall(F.split(s, r"\s+"), lambda w: w.isin(*known) if known else F.lit(False)))


def short_district(text: Column) -> Column:
    """A district's name in title case, without its closing kind."""
    return F.regexp_replace(F.regexp_replace(title_case(text), " School District$", ""), " District$", "")


def joined_parts(*parts: Column) -> Column:
    """What is left of the parts once trimmed, with single spaces between; empty parts count as missing."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def label(code: Column, names: dict[str, str]) -> Column:
    """The name of a code; of one without a name, the code with spaces for underscores."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.replace(code, F.lit("_"), F.lit(" ")))


def one_category(code: Column, same: dict[str, str] = SAME_CATEGORY) -> Column:
    """The category that a code counts as; itself where ``same`` has none, null if null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in same.items() for x in pair]), code), code)


def case_year(case_no: Column) -> Column:
    """The first four digits in a row; null if there are none."""
    return F.regexp_extract(case_no, r"(\d{4})", 1).try_cast("int")


def era(year: Column, eras: tuple[tuple[int | None, str], ...] = ERAS) -> Column:
    """The first era whose last year isn't before ``year``; ``unknown`` if null."""
    return F.coalesce(*[F.when(year <= last if last is not None else year.isNotNull(), name) for last, name in eras], F.lit("unknown"))


def fingerprint(basis: Column, *parts: Column) -> Column:
    """A matter as one line: its basis, then the rendered lines of each part (an array; null has none, null lines go), parted by bars."""
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(F.concat(F.lit("Basis: "), F.coalesce(basis, F.lit("")))), *[F.coalesce(p, none) for p in parts]), " | ")


def filled(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` as that value's text; null is a dash. Braces within values stay as they are."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("-")) if i % 2 else F.lit(x) for i, x in enumerate(pieces)])
