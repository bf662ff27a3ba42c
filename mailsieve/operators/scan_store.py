"""Stored scans: a layout that opens a page, a day or one scan by reading a small part.

Rows lie in ``<path>/rows``, partitioned by day of ``created_at`` and sorted by id within their files,
with Parquet bloom filters on ``id`` and ``email_id``.  ``<path>/ranks`` is the rank index: ids are cut into
ranges of RANGE, and every range that has rows keeps their number, the number of rows in the lower
ranges (``below``) and its first and last day.  So

* the rows of one id lie in the days of its range: partitions and row groups of other days are not read;
* a date filter becomes a partition filter;
* page p, newest id first, are the rows number total - p * size and on from below: the ranges that hold them
  are found in the index, and only these ids and days are read.  It costs the same for any p.

The prefix sums are two windows: over the ranges of a block of BLOCK ranges, and over the blocks.  New rows may be
appended while their ids lie above the stored ones, as scan ids do; the index rows of older ranges then stay as they are
(of a range that is continued, the newest row counts).  Null days lie in their own partition, null ids are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsieve.operators.scans import _day, filter_scans

RANGE = 1 << 16
BLOCK = 1 << 12
#: sizes of bloom filter that a file chooses from, each half of the one before, from 1 MB on
BLOOM_SIZES = 15
RANKS = "range long, n long, below long, first_day date, last_day date"


def _rank_index(rows: DataFrame, width: int, stored: int) -> DataFrame:
    """One row per range of ids (RANKS), ``stored`` rows being below."""
    ranges = rows.groupBy(F.floor(F.col("id") / width).alias("range")).agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("day").isNull()).alias("undated"))
    ranges = ranges.withColumn("block", F.floor(F.col("range") / BLOCK))
    blocks = ranges.groupBy("block").agg(F.sum("n").alias("block_n"))
    lower = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row a block of BLOCK * RANGE ids
    blocks = blocks.select("block", F.coalesce(F.sum("block_n").over(lower.orderBy("block")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(lower.partitionBy("block").orderBy("range")), F.lit(0))
    counted = ranges.select("*", inside.alias("inside")).join(blocks, "block")
    # rows without a day may lie anywhere: such a range names no days
    days = [F.when(F.col("undated") == 0, F.col(c)).alias(c) for c in ("first_day", "last_day")]
    return counted.select("range", "n", (F.col("before") + F.col("inside") + stored).cast("long").alias("below"), *days)


class ScanStore:
    """Stored scans below ``path``."""

    def __init__(self, spark: SparkSession, path: str, width: int = RANGE):
        self.spark, self.path, self.width = spark, path.rstrip("/"), width

    def append(self, scans: DataFrame) -> None:
        """Store scans whose ids lie above all stored ones."""
        dated = scans.withColumn("day", F.to_date("created_at"))
        dated = dated.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a stored scan needs an id")).cast("long")))
        writer = dated.repartitionByRange("day", "id").sortWithinPartitions("day", "id").write.mode("append").partitionBy("day")
        top = self.top()
        if top is not None:
            lowest = dated.agg(F.min("id")).first()[0]
            if lowest is not None and lowest <= top[1]:
                raise ValueError(f"ids up to {top[1]} are stored; the new ones begin at {lowest}")
        for column in ("id", "email_id"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.candidates.number#{column}", str(BLOOM_SIZES))
        # as large as the rows of a file ask for: a filter without this has the greatest size, 1 MB, in every day's file
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.path}/rows")
        stored = 0 if top is None else top[0]
        # what was stored before is counted again only in the range that is continued
        begins = None if top is None else top[1] // self.width
        rows = self.rows() if begins is None else self.rows().where(F.col("id") >= begins * self.width)
        if begins is not None:
            stored -= sum(r["n"] for r in self._newest(self.ranks().where(F.col("range") == begins)))
        _rank_index(rows.select("id", "day"), self.width, stored).write.mode("append").parquet(f"{self.path}/ranks")

    def rows(self) -> DataFrame:
        """All stored scans, with their ``day``."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def ranks(self) -> DataFrame:
        return self.spark.read.schema(RANKS).parquet(f"{self.path}/ranks")

    @staticmethod
    def _newest(ranks: DataFrame) -> list:
        """Index rows of a few ranges; of a range that was continued the one with most rows."""
        best: dict = {}
        for r in ranks.collect():
            if r["range"] not in best or r["n"] > best[r["range"]]["n"]:
                best[r["range"]] = r
        return [best[k] for k in sorted(best)]

    def top(self) -> tuple[int, int] | None:
        """(number of stored scans, greatest id), None where nothing is stored."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ranks")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        last = self.ranks().agg(F.max(F.struct("range", "n", "below"))).first()[0]
        if last is None:
            return None
        greatest = self._days(self.rows(), self._newest(self.ranks().where(F.col("range") == last["range"]))).agg(F.max("id")).first()[0]
        return last["below"] + last["n"], greatest

    def _days(self, rows: DataFrame, ranges: list) -> DataFrame:
        """Only the ids and days of some ranges."""
        if not ranges:
            return rows.where(F.lit(False))
        rows = rows.where((F.col("id") >= ranges[0]["range"] * self.width) & (F.col("id") < (ranges[-1]["range"] + 1) * self.width))
        if any(r["first_day"] is None for r in ranges):
            return rows
        return rows.where(F.col("day").between(F.lit(min(r["first_day"] for r in ranges)), F.lit(max(r["last_day"] for r in ranges))))

    def lookup(self, scan_id: int) -> DataFrame:
        """The scan of an id, from the days of its range."""
        ranges = self._newest(self.ranks().where(F.col("range") == scan_id // self.width))
        return self._days(self.rows(), ranges).where(F.col("id") == scan_id)

    def between(self, date_from: str | None = None, date_to: str | None = None, label: str | None = None) -> DataFrame:
        """B7 + B8 on partitions: only the days asked for are read."""
        rows = self.rows()
        if date_from:
            rows = rows.where(F.col("day") >= _day(date_from))
        if date_to:
            rows = rows.where(F.col("day") <= _day(date_to))
        return filter_scans(rows, label, date_from, date_to)

    def page(self, page: int = 1, page_size: int = 10) -> tuple[DataFrame, dict]:
        """a page of the newest ids first; pages beyond the last one give the last one."""
        if not 1 <= page_size <= 100:
            raise ValueError("page_size must be in 1..100")
        if page < 1:
            raise ValueError("page must be >= 1")
        top = self.top()
        total = top[0] if top else 0
        pages = max(1, -(-total // page_size))
        page = min(page, pages)
        last = total - (page - 1) * page_size
        first = max(last - page_size, 0)
        meta = {"total": total, "page": page, "pages": pages, "page_size": page_size}
        if not total:
            return (self.rows() if top else self.spark.createDataFrame([], "id long")).where(F.lit(False)), meta
        ranges = self._newest(self.ranks().where((F.col("below") < last) & (F.col("below") + F.col("n") > first)))
        rows = self._days(self.rows(), ranges)
        # the ranges hold at most RANGE rows each, the page begins after those above it
        skip = ranges[-1]["below"] + ranges[-1]["n"] - last
        return rows.orderBy(F.desc("id")).offset(skip).limit(last - first), meta
