"""A stored inverted index: built once, read by the buckets of a query's terms only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import analyze
from lodestrata.operators.retrieval import K1, B

#: Folders that postings are cut into by term, and parts of each by document, so that a frequent term is not one task's.
BUCKETS, PARTS = 64, 8


@dataclass(frozen=True)
class TextIndex:
    """Postings ``(term, key, tf, dl)`` by bucket, and statistics, in batches; a batch written again replaces itself."""

    spark: SparkSession
    folder: str
    key: str
    buckets: int = BUCKETS

    def add(self, documents: DataFrame, text: str, batch: int = 0) -> None:
        """Index documents that are not in it yet.  Null and empty texts count for the statistics and have no postings.

        Postings are counted per document before they are shuffled, lie sorted by term
        within the files of their bucket, and so are skipped by the files' statistics.
        """
        tokens = documents.select(F.col(self.key).alias("key"), analyze(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
        counted = tokens.select("key", "dl", F.explode("t").alias("term")).groupBy("term", "key", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        placed = counted.withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        spread = placed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(PARTS))).sortWithinPartitions("bucket", "term", "key")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/batch={batch}")
        tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).write.mode("overwrite").parquet(f"{self.folder}/statistics/batch={batch}")

    def postings(self, terms: list[str]) -> DataFrame:
        """``term, key, tf, dl`` of some terms; only their buckets are read."""
        rows = self.spark.read.parquet(f"{self.folder}/postings")
        wanted = self.spark.range(1).select(F.array(*[bucket_of(F.lit(t), self.buckets) for t in terms]).alias("b")).first()["b"] if terms else []
        return rows.where(F.col("bucket").isin(sorted(set(wanted))) & F.col("term").isin(terms)).select("term", "key", "tf", "dl")

    def bm25(self, terms: list[str], least: int = 1) -> DataFrame:
        """``key, matched, score`` of the documents with at least ``least`` of the terms.

        Document frequencies, one row per query term, are read by the driver.
        """
        stats = self.spark.read.parquet(f"{self.folder}/statistics").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
        n, average = stats["n"] or 0, (stats["length"] or 0) / max(1, stats["n"] or 0)
        found = self.postings(terms)
        df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        rarity = F.create_map(*[x for t, d in df.items() for x in (F.lit(t), F.log(1 + (n - F.lit(d) + 0.5) / (F.lit(d) + 0.5)))])[F.col("term")] if df else F.lit(0.0)
        part = rarity * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(average or 1))))
        scored = found.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("matched"), F.round(F.sum(part), 6).alias("score"))
        return scored.where(F.col("matched") >= least).withColumnRenamed("key", self.key)


def bucket_of(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
