"""A store of scraped records: one table per source, inserts that ignore known urls, batches that count once.

Layout below the root::

    rows/batch=<id>/source=<institution>_<data_type>/bucket=<k>/*.parquet    what a batch has added
    ledger/batch=<id>/*.parquet                                              one row: the batch is complete

A url lies in the bucket of its hash, so a batch reads only the buckets of its own urls.  Known urls are ignored, so rows are only ever
added: a batch writes its folder (anew, if an earlier try broke off), then its row in the ledger; readers see the batches of the
ledger only, and a batch that is in it is passed over.  The same batch may therefore run again at any time, as streams do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIXED = ["title", "url", "description", "institution", "data_type", "scraped_at", "related_faqs"]
SCHEMA = "seq long, title string, url string, description string, institution string, data_type string, scraped_at string, related_faqs string, extra string, batch long, source string, bucket int"


class UpsertStore:
    """``buckets`` must stay as it is for a root; pick it so that a bucket of the largest source fits a task."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def batches(self) -> DataFrame:
        """(batch, rows) of every complete batch."""
        if not self._exists(f"{self.root}/ledger"):
            return self.spark.createDataFrame([], "rows long, batch long")
        return self.spark.read.schema("rows long, batch long").parquet(f"{self.root}/ledger")

    def rows(self) -> DataFrame:
        """All rows of complete batches, with their source."""
        if not self._exists(f"{self.root}/rows"):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/rows").join(F.broadcast(self.batches().select("batch")), "batch")  # an id per batch

    def prepared(self, records: DataFrame) -> DataFrame:
        """Records with a title, in the store's columns; keys beyond the fixed ones become JSON without nulls.

        ``seq`` is the order of input; nested values and ``related_faqs`` become JSON; a missing ``scraped_at`` is the time of the run."""
        have = {f.name: f.dataType.typeName() for f in records.schema}

        def text(c: str):
            return F.to_json(c) if have[c] in ("array", "struct", "map") else F.col(c).cast("string")

        fixed = {c: text(c) if c in have else F.lit(None).cast("string") for c in FIXED}
        fixed["scraped_at"] = F.coalesce(fixed["scraped_at"], F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
        fixed["related_faqs"] = F.coalesce(fixed["related_faqs"], F.lit("[]"))
        others = sorted(set(have) - {*FIXED, "seq"})
        extra = F.to_json(F.struct(*others)) if others else F.lit("{}")  # to_json leaves nulls out
        rows = records.where(F.col("title").isNotNull()).select("seq", *(v.alias(c) for c, v in fixed.items()), extra.alias("extra"))
        source = F.concat_ws("_", "institution", "data_type")
        return rows.withColumn("source", source).withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("url", F.col("seq").cast("string"))), F.lit(self.buckets)).cast("int"))

    def upsert(self, records: DataFrame, batch: int) -> None:
        """Add the records of a batch whose url their source does not know; the first of the batch in ``seq`` order wins,
        records without a url are all added.  Fit for ``foreachBatch``."""
        if self.batches().where(F.col("batch") == batch).take(1):
            return
        rows = self.prepared(records)
        key = ["source", "bucket", "url"]
        first = rows.where("url is not null").withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("_n = 1").drop("_n")
        known = self.rows().where("url is not null").select(*key).join(first.select(*key), key, "left_semi")  # only these buckets are read
        fresh = first.join(known, key, "left_anti").unionByName(rows.where("url is null"))
        into = f"{self.root}/rows/batch={batch}"
        fresh.repartition("source", "bucket").write.mode("overwrite").partitionBy("source", "bucket").parquet(into)
        n = self.spark.read.schema(SCHEMA).parquet(into).count() if self._exists(into) else 0
        self.spark.createDataFrame([(n,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/batch={batch}")

    def statistics(self) -> DataFrame:
        """Rows per data type over all sources, and distinct institutions."""
        return self.rows().agg(
            F.count_if(F.col("data_type") == "courses").alias("courses"), F.count_if(F.col("data_type") == "accommodation").alias("accommodation"),
            F.countDistinct("institution").alias("institutions"),
        )
