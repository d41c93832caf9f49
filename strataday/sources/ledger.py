"""A collection of daily polygon files that is kept up to date from run to run.

Below its folder a collection has two tables. ``rows`` holds the staged lines of every file that was opened,
one directory an update; ``ledger`` the versions of the files (path, size, modification time) with
their verdicts, one directory an update. An update compares the listing with the ledger and opens
only files that are new or have another size or time. The last entry of a file counts, and of its lines those
written by the same update, so a changed file replaces its rows and nothing is rewritten. Files that are
gone get an entry that says so.

An update writes its lines first and its ledger directory last, by one commit. One that dies in between leaves
lines that no entry names; the next one starts from the listing again. Updates of one collection must
not run at the same time.

After each update :meth:`PolygonLedger.polygons` has the rows that reading all files anew would give.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import path_exists
from .polygons import file_verdicts, gzip_sizes, lines_of, list_versions, polygons_of, report_days, stage_lines

_LEDGER = (
    "path string, Date date, size long, modified timestamp, accepted boolean, n_lines long, gone boolean, number int, update string"
)


@dataclass(frozen=True)
class Update:
    """What an update found: files opened, how many of them were accepted, and files that are gone."""

    number: int
    opened: int
    accepted: int
    gone: int


class PolygonLedger:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def entries(self) -> DataFrame:
        """All entries of all updates."""
        path = f"{self.base}/ledger"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).parquet(path)

    def files(self) -> DataFrame:
        """The last entry of every file that is there."""
        names = [x.split(" ")[0] for x in _LEDGER.split(", ") if not x.startswith("path ")]
        last = self.entries().groupBy("path").agg(F.max_by(F.struct(*names), "number").alias("e"))
        return last.select("path", "e.*").where(~F.col("gone"))

    def polygons(self) -> DataFrame:
        """Polygons of all accepted files, tagged with the file's day."""
        path = f"{self.base}/rows"
        if not path_exists(self.spark, path):
            raise ValueError("the collection has no update yet")
        current = self.files().where("accepted").select("path", "update")
        return polygons_of(self.spark.read.parquet(path).join(current, ["path", "update"], "left_semi"))

    def report(self, days: DataFrame) -> DataFrame:
        """Per expected day: ``accepted``, ``rejected`` or ``missing``, and its line count, without opening a file."""
        return report_days(days, self.files())

    def update(self, root: str, first: dt.date | None = None, last: dt.date | None = None) -> Update:
        """Bring the collection up to the files below ``root``, of all days or from ``first`` to ``last``.

        The paths of the files to open come to the driver, which has listed all of them already.
        """
        listed = list_versions(self.spark, root, first, last)
        known = self.files()
        same = [listed[c].eqNullSafe(known[c]) for c in ("path", "size", "modified")]
        new = listed.join(known, same, "left_anti")
        asked = known
        if first is not None:
            asked = asked.where(F.col("Date") >= F.lit(first))
        if last is not None:
            asked = asked.where(F.col("Date") <= F.lit(last))
        gone = asked.join(listed.select("path"), "path", "left_anti")
        versions = [r for r in new.toLocalIterator()]
        lost = [r for r in gone.select("path", "Date", "size", "modified").toLocalIterator()]
        number = (self.entries().agg(F.max("number")).first()[0] or 0) + 1
        if not versions and not lost:
            return Update(number - 1, 0, 0, 0)
        label = f"{number:09d}-{uuid.uuid4().hex[:8]}"
        schema = "path string, Date date, size long, modified timestamp"
        opened = self.spark.createDataFrame(versions, schema)
        if versions:
            target = f"{self.base}/rows/update={label}"
            stage_lines(lines_of(self.spark, [r.path for r in versions])).write.parquet(target)
            verdicts = file_verdicts(self.spark.read.parquet(target), gzip_sizes(opened)).select("path", "accepted", "n_lines")
            opened = opened.join(verdicts, "path", "left")
        else:
            opened = opened.withColumns({"accepted": F.lit(None).cast("boolean"), "n_lines": F.lit(None).cast("long")})
        entries = opened.withColumn("gone", F.lit(False)).unionByName(
            self.spark.createDataFrame(lost, schema).withColumn("gone", F.lit(True)), allowMissingColumns=True
        ).withColumns({
            "accepted": F.coalesce("accepted", F.lit(False)), "n_lines": F.coalesce("n_lines", F.lit(0)).cast("long"),
            "number": F.lit(number),
        })
        place = f"{self.base}/ledger/update={label}"
        entries.write.parquet(place)
        accepted = self.spark.read.parquet(place).where("accepted").count()
        return Update(number, len(versions), accepted, len(lost))
