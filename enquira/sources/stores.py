"""Readers and writers of catalogue and lead tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED = ["url", "title", "description", "institution", "data_type"]


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON files: a list, or an object with ``faqs``; entries without question or
    answer are dropped.  ``idx`` is the raw position over all files in the order of their names; an entry that
    states another ``index`` is an error."""
    names = ("question", "answer", "category", "institution")
    entry = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("index", T.LongType())]))
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    wrapped = F.from_json("value", T.StructType([T.StructField("faqs", entry)]))["faqs"]
    entries = F.when(F.trim("value").startswith("["), F.from_json("value", entry)).otherwise(wrapped)
    files = raw.select("file", F.coalesce(entries, F.array().cast(entry)).alias("entries"))
    above = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = files.select("file", F.size("entries").alias("n")).select("file", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    rows = files.join(F.broadcast(offsets), "file").select("before", F.posexplode("entries").alias("pos", "e")).select((F.col("before") + F.col("pos")).alias("idx"), "e")
    at = F.when(F.coalesce(F.col("e.index"), F.col("idx")) == F.col("idx"), F.col("idx")).otherwise(F.raise_error(F.format_string("entry %s states index %s", "idx", "e.index")).cast("long"))
    kept = rows.select(at.alias("idx"), "e").where((F.coalesce("e.question", F.lit("")) != "") & (F.coalesce("e.answer", F.lit("")) != ""))
    return kept.select(
        "idx", "e.question", "e.answer", F.coalesce("e.keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("e.category", F.lit("General Enquiries")).alias("category"), F.coalesce("e.institution", F.lit("General")).alias("institution"),
    )


def check_gold(gold: DataFrame) -> DataFrame:
    """Rules that each gold row breaks: a query without text, or an abstention that does not
    match the missing document."""
    rules = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "empty_query"),
        F.when(F.col("expected_abstain") != F.col("gold_id").isNull(), "abstain_mismatch"),
    ))
    return gold.withColumn("violations", rules)


def latest_features(spark: SparkSession, folder: str, stem: str, source: str, rebuild: DataFrame | None = None) -> DataFrame:
    """The newest table ``<stem>_*`` below a folder by name, CSV before JSON, with its ``source``.

    Names may be files or folders of part files.  JSON may be a list, or an object with ``data``; a byte
    order mark is passed over.  Without any file ``rebuild`` is taken, with ``provenance`` "rebuilt".
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.regexp_extract("path", rf"^(.*/{stem}_[^/]*\.(csv|json))(/|$)", 1)
    found = files.select(name.alias("path")).where("path <> ''").select("path", F.col("path").endswith(".csv").alias("csv"), F.element_at(F.split("path", "/"), -1).alias("name"))
    best = found.agg(F.max(F.struct("csv", "name", "path")).alias("m")).first()["m"]
    if best is None:
        if rebuild is None:
            raise FileNotFoundError(f"no {stem}_* in {folder}")
        return rebuild.withColumn("source", F.lit(source)).withColumn("provenance", F.lit("rebuilt"))
    if best["csv"]:
        rows = spark.read.option("header", True).option("inferSchema", True).csv(best["path"])
    else:
        rows = spark.read.option("multiLine", True).json(best["path"])
        if "data" in rows.columns:
            rows = rows.select(F.explode("data").alias("r")).select("r.*")
    rows = rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))
    return rows.withColumn("source", F.lit(source)).withColumn("provenance", F.lit(best["name"]))


def flatten(df: DataFrame) -> DataFrame:
    """All columns as text, by name; nested values as JSON, NULL as ""."""
    def text(f: T.StructField):
        c = F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name).cast("string")
        return F.coalesce(c, F.lit("")).alias(f.name)

    return df.select(*(text(df.schema[c]) for c in sorted(df.columns)))


NOTHING = "No data scraped"


def write_csv(df: DataFrame, path: str) -> None:
    """Flattened rows with a header; an empty table gives one line that says so."""
    if df.isEmpty():
        df.sparkSession.createDataFrame([(NOTHING,)], "value string").coalesce(1).write.text(path)
    else:
        flatten(df).write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in sorted(columns))
    if [r[0] for r in spark.read.text(path).take(2)] == [NOTHING]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path).fillna("")


def write_json(df: DataFrame, path: str, *partition: str) -> None:
    df.write.partitionBy(*partition).json(path)


def upsert_by_url(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing rows plus new ones whose url is new; the first row per url in ``seq`` order wins,
    rows without a url are all inserted, rows without a title are skipped."""
    extra = F.to_json(F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in sorted(set(new.columns) - {*FIXED, "seq"}))), F.array(*(F.col(c).cast("string") for c in sorted(set(new.columns) - {*FIXED, "seq"})))), lambda k, v: v.isNotNull()))
    rows = new.where(F.col("title").isNotNull()).select("seq", *FIXED, extra.alias("extra"))
    first = F.row_number().over(Window.partitionBy("url").orderBy("seq"))
    with_url = rows.where(F.col("url").isNotNull()).withColumn("_n", first).where("_n = 1").drop("_n")
    fresh = with_url.join(existing.select("url").where("url is not null").distinct(), "url", "left_anti")
    columns = ["seq", *FIXED, "extra"]
    return existing.select(*columns).unionByName(fresh.select(*columns)).unionByName(rows.where(F.col("url").isNull()).select(*columns))


def store_statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("data_type") == "courses").alias("courses"), F.count_if(F.col("data_type") == "accommodation").alias("accommodation"),
        F.countDistinct("institution").alias("institutions"),
    )


def run_summary(raw: DataFrame, routed: DataFrame) -> DataFrame:
    """Scraped, processed and failed rows per institution and kind."""
    keys = ["institution", "data_type"]
    a = raw.groupBy(*keys).agg(F.count("*").alias("scraped"))
    b = routed.groupBy(*keys).agg(F.count_if(F.col("status") == "valid").alias("processed"), F.count_if(F.col("status") != "valid").alias("errors"))
    return a.join(b, keys, "full_outer").select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("scraped", "processed", "errors")))


def job_summary(jobs: DataFrame, raw: DataFrame, routed: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row per job of (institution, data_type, scraper, started, completed, pages, scrape_errors, error): its status ("failed" with an
    error, else "success"), its times, and the rows scraped, processed and enriched; errors are those of processing and of scraping."""
    keys = ["institution", "data_type"]
    scraped = raw.groupBy(*keys).agg(F.count("*").alias("scraped"))
    done = routed.groupBy(*keys).agg(F.count_if(F.col("status") == "valid").alias("processed"), F.count_if(F.col("status") != "valid").alias("bad"))
    more = enriched.groupBy(*keys).agg(F.count("*").alias("enriched"))
    rows = jobs.join(scraped, keys, "left").join(done, keys, "left").join(more, keys, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("scraped", "processed", "enriched")]
    errors = F.coalesce("bad", F.lit(0)) + F.coalesce("scrape_errors", F.lit(0))
    status = F.when(F.col("error").isNotNull(), "failed").otherwise("success")
    return rows.select(*keys, status.alias("status"), "error", "scraper", "started", "completed", F.coalesce("pages", F.lit(0)).alias("pages"), *counts, errors.alias("errors"))
