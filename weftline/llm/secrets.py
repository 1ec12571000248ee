"""Secret scan by built-in functions alone, with parts of credentials linked within a scope.

Strong findings stand alone: assignments, access identifiers, long runs of hex digits. Weak
candidates (a lone 40-character key, an endpoint) say little alone. They are reported only where
an interval join finds complementary parts within the scope: a key near an access identifier, an
endpoint near an access identifier and a secret.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import kept, unused

#: The patterns of the base kinds and the least lengths of what they find.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KEY = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
#: Flat classes, tried at the beginning of a run only: no recursion and no second look, however long a run is.
ENDPOINT = r"https?://[^\s\"'<>]++|(?<![A-Za-z0-9.-])[A-Za-z0-9.-]{1,253}\.amazonaws\.com(?![A-Za-z0-9-])"
KINDS = ("assign", "access", "hex", "key", "endpoint")
SPAN = "array<struct<start:int,kind:int,end:int>>"
BLOCK = 64


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def begins(lengths: Column) -> Column:
    """The sum of all before it, for each of an array of numbers, by blocks of sums."""

    def by_blocks(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        before = lambda s: F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i)))
        return bound(bound(blocks, before), lambda p: F.transform(n, lambda _, i: F.get(p, F.floor(i / BLOCK).cast("int")) + total(F.slice(n, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return bound(lengths, by_blocks)


def matches(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Spans (start, kind, end; code points, end exclusive) of all leftmost non-overlapping matches whose ``group`` has at least ``least`` characters.

    What stands between the matches gives their places, so no position function is needed.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
        F.split(text, pattern, -1).alias("between"),
    )

    def spans(p: Column) -> Column:
        steps = F.transform(p["m"], lambda m, i: F.length(F.get(p["between"], i)) + F.length(m))
        at = lambda b: F.transform(p["m"], lambda m, i: F.struct((F.get(b, i) + F.length(F.get(p["between"], i))).alias("start"), F.lit(kind).alias("kind"), (F.get(b, i) + F.length(F.get(p["between"], i)) + F.length(m)).alias("end"), F.length(F.get(p["g"], i)).alias("n")))
        return F.transform(F.filter(bound(begins(steps), at), lambda x: x["n"] >= least), lambda x: F.struct(x["start"], x["kind"], x["end"]))

    return F.when(text.rlike(pattern), bound(parts, spans)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def rendered(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """A row per input row: doc_id, text_key, base (spans of the strong kinds), linked (weak spans that are backed).

    ``scope`` is the greatest number of code points between parts of one credential. A null text
    counts as empty and has no spans; rows with a null id are scanned as well. Equal rows get equal
    results, each its own row. Other columns are not read. Patterns are linear in a text's length,
    and parts are joined by their row and window, so a text of any length has only pairs of near parts.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = F.array_sort(F.concat(matches(F.col("text"), ASSIGN, 0, ASSIGN_VALUE, 2), matches(F.col("text"), ACCESS, 1, ACCESS_LENGTH), matches(F.col("text"), HEX, 2, HEX_LENGTH)))
    weak = F.concat(matches(F.col("text"), KEY, 3), matches(F.col("text"), ENDPOINT, 4))
    has_access = F.exists(F.col("base"), lambda x: x["kind"] == 1)
    found = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", base.alias("base"))
    found = found.select("doc_id", F.xxhash64("text").alias("text_key"), "base", F.when(has_access, weak).otherwise(F.array().cast(SPAN)).alias("weak"))
    found = kept(found, "secrets")

    own = ["doc_id", "text_key"]
    some = found.where((F.size("weak") > 0)).dropDuplicates(own)
    part = lambda p, kinds: p.where(F.col("p.kind").isin(kinds)).select(*own, "p")
    strong = some.select(*own, F.explode("base").alias("p"))

    def near(candidates: DataFrame, by: DataFrame, most: int) -> DataFrame:
        """The candidates with one of ``by`` at most so many code points away (below 0: overlapping), by windows; a long span lies in several."""
        first = lambda c, more: F.floor((F.col(f"{c}.start") - more) / scope)
        last = lambda c, more: F.floor((F.col(f"{c}.end") + more) / scope)
        left = candidates.withColumn("bin", F.explode(F.sequence(first("w", max(most, 0)), last("w", max(most, 0)))))
        right = by.withColumn("bin", F.explode(F.sequence(first("p", 0), last("p", 0))))
        apart = F.greatest(F.col("w.start"), F.col("p.start")) - F.least(F.col("w.end"), F.col("p.end"))
        keys = [left[k].eqNullSafe(right[k]) for k in own] + [left["bin"] == right["bin"]]
        return left.join(right, [*keys, apart <= most], "left_semi").select(*own, "w").distinct()

    def backed(candidates: DataFrame, by: DataFrame) -> DataFrame:
        return near(candidates, by, scope)

    every = some.select(*own, F.explode("weak").alias("w"))
    taken = near(every, strong, -1).select(*[F.col(c).alias(f"its_{c}") for c in [*own, "w"]])
    weak_part = every.join(taken, [every[c].eqNullSafe(taken[f"its_{c}"]) for c in [*own, "w"]], "left_anti")
    access = part(strong, [1])
    keys = backed(weak_part.where("w.kind = 3"), access)
    secrets = part(strong, [0, 2]).unionByName(keys.select(*own, F.col("w").alias("p")))
    ends = backed(backed(weak_part.where("w.kind = 4"), access), secrets)
    linked = keys.unionByName(ends).groupBy(*own).agg(F.array_sort(F.collect_set("w")).alias("linked"))
    linked = linked.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "linked")
    joined = found.join(linked, found["doc_id"].eqNullSafe(linked["d"]) & (found["text_key"] == linked["t"]), "left")
    return joined.select("doc_id", "text_key", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans (all kinds), as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "linked"))
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(every).alias("spans"))


def redact(docs: DataFrame, scanned: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of each span; overlapping spans become one mark. Texts without spans stay as they are, null included."""
    d, t, s = unused(docs, "doc", "text", "spans")
    spans = scanned.select(F.col("doc_id").alias(d), F.col("text_key").alias(t), F.array_sort(F.concat("base", "linked")).alias(s)).where(F.size(s) > 0).dropDuplicates([d, t])
    text = docs[text_col]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    put = lambda a, x: F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))
    new = F.aggregate(F.col(s), start, put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    joined = docs.join(spans, docs[id_col].cast("long").eqNullSafe(spans[d]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == spans[t]), "left")
    return joined.select(*[F.when(F.col(s).isNotNull(), new).otherwise(text).alias(text_col) if c == text_col else docs[c] for c in docs.columns])
