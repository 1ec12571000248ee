"""Which documents hold which passages, word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import tokens
from weftline.operators.index import bound

#: Tokens of a run that serves as join key.
RUN = 4


def runs(words: Column, width: Column) -> Column:
    """Hashes of the distinct runs of ``width`` tokens."""

    def hashed(w: Column) -> Column:
        n = F.size(w) - width + 1
        return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, width))))).otherwise(F.array().cast("array<bigint>"))

    return bound(words, hashed)


def holding(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", passage_id: str = "item_id", passage_text: str = "text") -> DataFrame:
    """passage, id: the documents whose text contains the passage, character by character and case by case.

    A passage's first and last token may be parts of words in a document; those between are whole there, so a
    run of up to four of these is in each document that holds it. The passage's rarest run is its join key, so
    a run that a third of all documents hold is a key only for passages without a rarer one. What the keys bring
    together is then compared as whole texts. Passages of fewer than three tokens, and null ones, are sought in
    nothing. Repeated documents or passages give repeated rows.
    """
    inner = F.slice(tokens(F.col(passage_text)), 2, F.greatest(F.size(tokens(F.col(passage_text))) - 2, F.lit(0)))
    asked = passages.select(F.col(passage_id).alias("passage"), F.col(passage_text).alias("wanted"), inner.alias("inner")).where(F.size("inner") > 0)
    asked = asked.withColumn("width", F.least(F.size("inner"), F.lit(RUN)))
    keys = asked.select("passage", "wanted", "width", F.explode(runs(F.col("inner"), F.col("width"))).alias("run"))
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    shape = asked.select("width").distinct()
    # a row a run of the widths that are asked for, four of them at most
    held = words.crossJoin(F.broadcast(shape)).select("id", "width", F.explode(runs(F.col("words"), F.col("width"))).alias("run"))
    counts = held.join(keys.select("width", "run").distinct(), ["width", "run"]).groupBy("width", "run").agg(F.count("*").alias("df"))
    rarest = keys.join(counts, ["width", "run"], "left").groupBy("passage", "wanted", "width").agg(F.min_by("run", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "run")).alias("run"))
    pairs = held.join(rarest, ["width", "run"]).select("passage", "wanted", "id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("whole"))
    return pairs.join(texts, "id").where(F.contains("whole", "wanted")).select("passage", "id")
