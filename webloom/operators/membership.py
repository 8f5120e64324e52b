"""Seen urls as a filter of bits and a sketch of their number: both are built, merged and stored by Spark."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a filter that may be sent to every executor; a larger one is joined word by word.
SENT_BYTES = 32 << 20


class SeenFilter:
    """``bits`` bits, ``hashes`` of them set for each url: a url that was added always answers yes, another one by chance.

    Its table is ``word, bits``: 64 bits of the filter a row, words without a set bit left out.
    """

    def __init__(self, bits: int, hashes: int):
        self.bits, self.hashes = max(64, bits), max(1, hashes)

    @classmethod
    def sized(cls, urls: int, rate: float = 0.01) -> SeenFilter:
        """For so many urls at a rate of false answers."""
        bits = math.ceil(-max(urls, 1) * math.log(rate) / math.log(2) ** 2)
        return cls(bits, round(bits / max(urls, 1) * math.log(2)))

    def _places(self, url: Column) -> Column:
        """The bits of a url, by double hashing."""
        first, step = F.pmod(F.xxhash64(url), F.lit(self.bits)), F.pmod(F.xxhash64(url, F.lit(1)), F.lit(self.bits - 1)) + 1
        return F.array(*[(first + F.lit(i) * step) % self.bits for i in range(self.hashes)])

    def build(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """Table of the filter of all (non-null) urls; words combine before the shuffle."""
        each = urls.where(F.col(url).isNotNull()).select(F.explode(self._places(F.col(url))).alias("place"))
        bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
        return each.groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))

    def merge(self, *tables: DataFrame) -> DataFrame:
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        return every.groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def count(self, table: DataFrame) -> int:
        """About how many urls were added, from the number of set bits."""
        x = table.agg(F.sum(F.bit_count("bits"))).first()[0] or 0
        return round(-self.bits / self.hashes * math.log(1 - min(x, self.bits - 1) / self.bits))

    def maybe(self, items: DataFrame, table: DataFrame, url: str = "url") -> DataFrame:
        """Adds ``maybe``: false only for urls that were never added (null urls too)."""
        if self.bits // 8 <= SENT_BYTES:
            spark = items.sparkSession
            dense = spark.range((self.bits + 63) // 64).withColumnRenamed("id", "word").join(table, "word", "left")
            words = F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda w: w["bits"])
            one = F.broadcast(dense.agg(words.alias("_words")))  # one row, bounded by the bits
            hit = F.forall(self._places(F.col(url)), lambda p: F.bit_get(F.get("_words", F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)
            return items.crossJoin(one).withColumn("maybe", F.coalesce(hit, F.lit(False)) & F.col(url).isNotNull()).drop("_words")
        each = items.select(url).where(F.col(url).isNotNull()).distinct().select(url, F.explode(self._places(F.col(url))).alias("place"))
        each = each.withColumn("word", F.expr("place div 64")).join(table, "word").where(F.bit_get("bits", (F.col("place") % 64).cast("int")) == 1)
        known = each.groupBy(url).agg(F.countDistinct("place").alias("_n"))
        full = F.size(F.array_distinct(self._places(F.col(url))))
        return items.join(known, url, "left").withColumn("maybe", F.coalesce(F.col("_n") == full, F.lit(False))).drop("_n")

    def unseen(self, items: DataFrame, table: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
        """Items whose url is none of ``seen``, exactly: only those that the filter can't rule out are joined."""
        marked = self.maybe(items, table, url)
        rest = marked.where("maybe").join(seen.select(url).distinct(), url, "left_anti")
        return marked.where("not maybe").unionByName(rest).drop("maybe").select(items.columns)

    def save(self, table: DataFrame, sketch: DataFrame, path: str) -> None:
        """Words, size and the sketch of ``distinct_sketch`` in a folder."""
        table.write.mode("overwrite").parquet(f"{path}/words")
        sketch.select(F.lit(self.bits).cast("long").alias("bits"), F.lit(self.hashes).alias("hashes"), "sketch").write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[SeenFilter, DataFrame, DataFrame]:
    """(filter, its table, the sketch) of a folder."""
    about = spark.read.parquet(f"{path}/about")
    one = about.select("bits", "hashes").first()
    return SeenFilter(one["bits"], one["hashes"]), spark.read.parquet(f"{path}/words"), about.select("sketch")


def distinct_sketch(urls: DataFrame, url: str = "url") -> DataFrame:
    """One row ``sketch`` (binary): how many distinct urls there are; sketches of parts can be merged."""
    return urls.agg(F.hll_sketch_agg(url, F.lit(14)).alias("sketch"))


def merged_sketch(*sketches: DataFrame) -> DataFrame:
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    return every.agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimate(sketch: DataFrame) -> int:
    return sketch.select(F.hll_sketch_estimate("sketch")).first()[0] or 0
