"""Nested records from JSON files: explicit schemas, documents exploded from them, and sinks that can go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import joined_parts
from weftline.operators.records import not_yet
from weftline.sources.shared import kept

#: The record layouts, which two versions of the files share; nothing is inferred.
HOLDING = """struct<issue: struct<category: string, subtype: string, statement: string>, ruling: struct<prevailing_party: string, remedies: array<string>>,
  summary_style_holding: string, reasoning: struct<summary: string>, facts: array<struct<summary: string>>, arguments: array<struct<party: string, summary: string>>,
  authorities: array<struct<raw_cite: string, type: string, role: string>>, notable: struct<flag: boolean>>"""
DECISION = f"""identity struct<district: struct<raw: string>, alj: struct<raw: string>, decision_kind: string>, outcome struct<overall: string, roster: array<struct<name: string, ref: string>>>,
  full_text string, related_proceedings array<string>, holdings array<{HOLDING}>"""
GOLD = "sort_year int, category_raw string, category_canonical array<string>, text string, letter_title string, volume string, cites array<struct<district: string, alj: string>>"
ALIGNMENT = "system array<struct<case_no: string, holding_idx: int, status: string, matched_gold_idxs: array<int>, category: string>>, gold array<struct<status: string, text: string, case_no: string, holding_idx: int, categories: array<string>>>"
JUDGMENT = "_id string, _arm string, _model string, include boolean, confidence double, reasons array<string>, rationale string, score double"


def decisions(spark: SparkSession, *roots: str, year: int | None = None) -> DataFrame:
    """One row per file of all roots, keyed by its name (case_no); files of other years are not opened."""
    found = spark.read.schema(DECISION).option("multiLine", True).option("pathGlobFilter", f"{year or ''}*.json").json([*roots])
    return found.select(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json$", "").alias("case_no"), "*")


def gold_rows(spark: SparkSession, path: str, years: int | set[int] | None = None) -> DataFrame:
    """Rows of JSON lines, of one year, of some or of all, with an id (``gold_id``) that hashes the row's content."""
    rows = spark.read.schema(GOLD).json(path)
    rows = rows.withColumn("gold_id", F.sha1(F.to_json(F.struct(*rows.columns)).cast("binary")))
    if years is None:
        return rows
    return rows.where(F.col("sort_year").isin(*({years} if isinstance(years, int) else years)))


def holding_documents(decided: DataFrame) -> DataFrame:
    """A document per holding that has any text: doc_id (``case_no:place``), text, and what is known of it."""
    h = decided.select("case_no", "identity", "outcome", F.posexplode("holdings").alias("place", "h"))
    text = joined_parts(F.col("h.summary_style_holding"), F.col("h.issue.statement"), F.col("h.reasoning.summary"))
    out = h.select(
        F.concat_ws(":", "case_no", F.col("place").cast("string")).alias("doc_id"), text.alias("text"), "case_no",
        F.regexp_extract("case_no", r"(\d{4})", 1).try_cast("int").alias("year"), F.col("identity.district.raw").alias("district"), F.col("identity.alj.raw").alias("alj"),
        F.col("h.issue.category").alias("category"), F.col("h.issue.subtype").alias("subtype"), F.col("h.ruling.prevailing_party").alias("prevailing_party"),
        F.coalesce("h.ruling.remedies", F.array().cast("array<string>")).alias("remedies"), F.coalesce("h.notable.flag", F.lit(False)).alias("notable"),
        F.size(F.coalesce("h.arguments", F.array())).alias("n_arguments"), F.size(F.coalesce("h.authorities", F.array())).alias("n_authorities"), F.size(F.coalesce("h.facts", F.array())).alias("n_facts"),
    )
    return out.where("text <> ''")


def gold_documents(rows: DataFrame) -> DataFrame:
    """Gold rows that are no headers (their category is not blank) and have text."""
    return rows.where("trim(category_raw) <> '' AND trim(text) <> ''").select(F.col("gold_id").alias("doc_id"), "text", F.col("sort_year").alias("year"), "category_raw", F.col("category_canonical").alias("categories"), "cites")


def decision_documents(decided: DataFrame) -> DataFrame:
    """A document per decision, with how many holdings it has."""
    return decided.select(F.col("case_no").alias("doc_id"), F.col("full_text").alias("text"), F.col("identity.district.raw").alias("district"), F.col("identity.alj.raw").alias("alj"), F.size(F.coalesce("holdings", F.array())).alias("n_holdings"))


def public_view(decided: DataFrame) -> DataFrame:
    """Decisions without their full text and without the names on their rosters."""
    roster = F.transform("outcome.roster", lambda r: r.dropFields("name"))
    return decided.drop("full_text").withColumn("outcome", F.col("outcome").withField("roster", roster))


def judgments(spark: SparkSession, root: str) -> DataFrame:
    """One-row files from a folder per year and arm (``root/year/arm/*.json``), with both from the path."""
    found = spark.read.schema(JUDGMENT).option("multiLine", True).json(f"{root}/*/*/*.json")
    parts = F.split("_metadata.file_path", "/")
    return found.select(F.element_at(parts, -3).try_cast("int").alias("year"), F.element_at(parts, -2).alias("arm"), *[found[c] for c in found.columns])


def inclusion(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and whether any gold row matches it; of files that name a holding twice the last by name counts."""
    rows = spark.read.schema(ALIGNMENT).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode("system").alias("place", "s"))
    found = F.size(F.coalesce("s.matched_gold_idxs", F.array())) > 0
    return rows.groupBy(F.concat_ws(":", "s.case_no", F.col("s.holding_idx").cast("string")).alias("doc_id")).agg(F.max_by(found, F.struct("file", "place")).alias("included"))


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends to a Parquet table the rows whose keys it lacks, so that a job that stopped goes on where it was."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
    (not_yet(df, spark.read.parquet(path), keys) if there else df).write.mode("append").parquet(path)


def content_mark(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive hash: a manifest by which an index knows that it is stale."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("mark"))


def reports(df: DataFrame, key: str, order: str, title: str, line: str) -> DataFrame:
    """A text per key: its title, then a line per row in order. ``line`` is an SQL expression."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.expr(line).alias("l")))).alias("rows"))
    return rows.select(key, F.concat(F.lit(f"# {title} "), F.col(key).cast("string"), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["l"])), "\n")).alias("text"))


def checked(spark: SparkSession, schema: str, *paths: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of JSON files (whole files, or lines), with the file of each; and a table of rejects (file, broken): what doesn't parse, or not into this schema.

    Nothing broken becomes a row of nulls; files are parsed once, into the shared folder. An empty folder gives two empty tables.
    """
    found = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").option("multiLine", not lines).json([*paths])
    found = kept(found.select("*", F.col("_metadata.file_path").alias("file")), "checked")
    return found.where("_broken IS NULL").drop("_broken"), found.where("_broken IS NOT NULL").select("file", F.col("_broken").alias("broken"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """category, definition: the members of one whole JSON object; nested values stay as JSON text."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    return whole.select(F.explode("m").alias("category", "definition"))


def write_evaluation_set(chosen: DataFrame, path: str, by: str) -> None:
    """Writes chosen matters in a folder per value of ``by``, and beside them an index: how many there are of each."""
    chosen.write.mode("overwrite").partitionBy(by).parquet(f"{path}/matters")
    chosen.groupBy(by).agg(F.count("*").alias("selected")).write.mode("overwrite").parquet(f"{path}/index")


def evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Matters and index of a written evaluation set."""
    return spark.read.parquet(f"{path}/matters"), spark.read.parquet(f"{path}/index")
