"""Daily smoke-polygon files: tolerant ingest, schema gate and quarantine.

A file holds one GeoJSON-like object per line and carries its day in its path
(``hms_smoke20220406``). The whole directory is read in one scan; a file with
other columns or geometries, or one that cannot be read to its end, contributes no rows and
is reported instead of stopping the run. That the end was reached is proven by sizes: the lines
have as many bytes as a plain file, or, modulo 2**32, as a gzip file's last four bytes say, which are
read by seeking to them, however large the file. Files of several gzip members or of other codecs prove
nothing and are rejected. A file that vanishes between its listing and its reading stops the run.

Each line is parsed once, into a table in the shared scratch folder from which both the verdicts
and the polygons are taken. :class:`~strataday.sources.ledger.PolygonLedger` keeps that table from run to run.

``geometry.coordinates`` is always a list of polygons, one for the type Polygon.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import join_text, remove_text, slice_text
from ..schemas import POLYGON_COLUMNS, POLYGON_RINGS, POLYGON_SCHEMA
from ..scratch import written

FILE_STEM = "hms_smoke"


def daily_path(date: Column | str, base: str) -> Column:
    """``<base>/<yyyy>/<mm>/hms_smoke<yyyymmdd>``, NULL for a NULL date."""
    return join_text(
        F.lit(base), slice_text(date, 1, 4), slice_text(date, 6, 7),
        join_text(F.lit(FILE_STEM), remove_text(date, "-")), sep="/",
    )


def file_date(path: Column | str) -> Column:
    """The day a file path carries."""
    text = F.col(path) if isinstance(path, str) else path
    return F.try_to_date(F.regexp_extract(text, FILE_STEM + r"(\d{8})", 1), "yyyyMMdd")


def _reader(spark: SparkSession, source: str) -> DataFrameReader:
    return (
        spark.read.format(source)
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, day and length of every polygon file below ``root``; contents are not read."""
    files = _reader(spark, "binaryFile").load(root)
    return files.select("path", file_date("path").alias("Date"), "length").where(
        F.col("Date").isNotNull()
    )


def _of_days(df: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """Rows of files with a day, within the days asked for. Files of other days aren't opened."""
    df = df.where(F.col("Date").isNotNull())
    if first is not None:
        df = df.where(F.col("Date") >= F.lit(first))
    if last is not None:
        df = df.where(F.col("Date") <= F.lit(last))
    return df


def lines_of(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every line of the files below a root, or of listed files, with its file's path, day and size.

    A file that cannot be decompressed ends where it breaks off.
    """
    if not isinstance(paths, str):  # listed paths are URIs, and stand for themselves
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(p)) for p in paths]
    lines = _reader(spark, "text").option("lineSep", "\n").load(paths)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        file_date(F.col("_metadata.file_path")).alias("Date"),
        F.col("_metadata.file_size").alias("size"),
    )


def scan_lines(
    spark: SparkSession, root: str, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """Every line of every polygon file below ``root`` with its path, day and the file's size."""
    return _of_days(lines_of(spark, root), first, last)


def list_versions(
    spark: SparkSession, root: str, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """Path, day, size and modification time of every polygon file below ``root``, from the listing alone."""
    files = _reader(spark, "binaryFile").load(root)
    return _of_days(files.select(
        F.col("_metadata.file_path").alias("path"),
        file_date(F.col("_metadata.file_path")).alias("Date"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ), first, last)


def _last_four(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as file:
                size = file.size()
                found.append(struct.unpack("<I", file.read_at(4, size - 4))[0] if size >= 4 else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("Date"), pa.array(found, pa.int64())], ["path", "Date", "unpacked"]
        )


def gzip_sizes(files: DataFrame) -> DataFrame:
    """Unpacked size modulo 2**32 that each gzip file of a listing ends with.

    Only these four bytes are read of each file, through Arrow's file systems (local, HDFS,
    object stores). The files are spread over the cluster first, as their listing is small.
    """
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    gzips = files.where(F.col("path").endswith(".gz")).select("path", "Date").repartition(parts, "path")
    return gzips.mapInArrow(_last_four, "path string, Date date, unpacked long")


def names_match(line: Column | str, names: Sequence[str] = POLYGON_COLUMNS) -> Column:
    """The line is an object with exactly these fields in this order."""
    text = F.col(line) if isinstance(line, str) else line
    return F.coalesce(
        F.concat_ws(",", F.json_object_keys(text)) == ",".join(names), F.lit(False)
    )


def geometry_parts(geometry: Column) -> Column:
    """The geometry with its coordinates parsed, as a list of polygons whatever its type.

    Coordinates of another type or depth are NULL.
    """
    kind, raw = geometry["type"], geometry["coordinates"]
    listed = F.when(kind == "Polygon", F.concat(F.lit("["), raw, F.lit("]"))).when(kind == "MultiPolygon", raw)
    parts = F.from_json(listed, T.ArrayType(POLYGON_RINGS))
    return F.when(geometry.isNotNull(), F.struct(kind.alias("type"), parts.alias("coordinates")))


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines with their fields ``f``, their geometry and whether that fits.

    A geometry fits if it is NULL, or one or several polygons down to the numbers of their points.
    """
    number = lambda x: x.isNotNull()
    point = lambda p: p.isNotNull() & (F.size(p) >= 2) & F.forall(p, number)
    ring = lambda r: r.isNotNull() & F.forall(r, point)
    part = lambda p: p.isNotNull() & F.forall(p, ring)
    whole = F.coalesce(F.forall(F.col("geometry.coordinates"), part), F.lit(False))
    nothing = F.get_json_object("value", "$.geometry").isNull()
    shaped = lines.withColumn("f", F.from_json("value", POLYGON_SCHEMA)).withColumn("geometry", geometry_parts(F.col("f.geometry")))
    return shaped.withColumn("fits", F.when(F.col("f.geometry").isNull(), nothing).otherwise(whole))


def stage_lines(lines: DataFrame) -> DataFrame:
    """Every line parsed once: its file, its length, whether it passes the gate, and its fields."""
    names = [c for c in POLYGON_COLUMNS if c != "geometry"]
    return _parsed(lines).select(
        "path", "Date", "size", F.octet_length("value").cast("long").alias("bytes"),
        (names_match("value") & F.col("fits")).alias("good"),
        *[F.col(f"f.{c}").alias(c) for c in names], "geometry",
    )


def file_verdicts(lines: DataFrame, gzips: DataFrame | None = None) -> DataFrame:
    """One row per file: its day, whether it passes the gate, and its line count.

    A file passes if all its lines do and it was read to its end. ``lines`` are those of
    :func:`scan_lines` or :func:`stage_lines`.
    """
    rows = lines if "good" in lines.columns else stage_lines(lines)
    rows = rows.select("path", "Date", "size", "bytes", "good", F.lit(None).cast("long").alias("unpacked"))
    if gzips is not None:
        rows = rows.unionByName(gzips, allowMissingColumns=True)
    files = rows.groupBy("path", "Date").agg(
        F.min("good").alias("good"), F.count("bytes").alias("n_lines"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.max("size").alias("size"), F.max("unpacked").alias("unpacked"),
    )
    # each line has its end, the last one perhaps not
    read = F.col("bytes") + F.col("n_lines")
    gzip = F.col("path").endswith(".gz")
    over = F.when(gzip, F.pmod(read - F.col("unpacked"), F.lit(1 << 32))).otherwise(read - F.col("size"))
    return files.select(
        "path", "Date", F.coalesce(F.col("good") & over.isin(0, 1), F.lit(False)).alias("accepted"), "n_lines"
    )


def polygons_of(staged: DataFrame) -> DataFrame:
    """The polygons among staged lines, tagged with the file's day."""
    return staged.select(*POLYGON_COLUMNS, "Date")


def collect_polygons(
    spark: SparkSession, root: str, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """Polygons of all accepted files, tagged with the file's day, of all days or from ``first`` to ``last``.

    The lines are read and parsed once, now, into the scratch folder; rejected files, of which
    there are few, are told apart there, and adaptive execution sends their paths out by their measured size.
    """
    staged = written(stage_lines(scan_lines(spark, root, first, last)), "polygon-lines")
    verdicts = written(file_verdicts(staged, gzip_sizes(list_versions(spark, root, first, last))), "polygon-files")
    rejected = verdicts.where(~F.col("accepted")).select("path")
    return polygons_of(staged.join(rejected, "path", "left_anti"))


def report_days(days: DataFrame, files: DataFrame) -> DataFrame:
    """Per expected day: ``accepted``, ``rejected`` or ``missing``, and its line count.

    ``files`` has a row per file: Date, accepted, n_lines, size. A day is rejected if one of its
    files is or if none has a line; files of no length count as missing.
    """
    found = files.where((F.col("size") > 0) | (F.col("n_lines") > 0)).groupBy("Date").agg(
        F.sum("n_lines").alias("n_lines"),
        F.coalesce(F.min(F.when(F.col("n_lines") > 0, F.col("accepted"))), F.lit(False)).alias("accepted"),
    )
    status = (
        F.when(F.col("accepted").isNull(), "missing")
        .when(F.col("accepted"), "accepted")
        .otherwise("rejected")
    )
    return days.join(found, "Date", "left").select(
        "Date", status.alias("status"), F.coalesce("n_lines", F.lit(0)).alias("n_lines")
    )


def collection_report(
    spark: SparkSession, root: str, days: DataFrame, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """Per expected day: ``accepted``, ``rejected`` or ``missing``, and its line count.

    ``days`` has one ``Date`` column. Expected days are matched against what
    was found, so an absent file is a row in the report, not a failed read. A
    file without a readable line counts as rejected, one of no length as missing. With ``first`` or ``last``
    only files of these days are opened; days beyond are missing.
    """
    listed = list_versions(spark, root, first, last)
    read = written(file_verdicts(scan_lines(spark, root, first, last), gzip_sizes(listed)), "polygon-files")
    files = listed.select("path", "Date", "size").join(read.drop("Date"), "path", "left")
    return report_days(days, files.withColumns({
        "n_lines": F.coalesce("n_lines", F.lit(0)), "accepted": F.coalesce("accepted", F.lit(False)),
    }))


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    """Boundary file, one feature a line: the geometries only, already in EPSG:4326.

    A line with another geometry than polygons ends the run.
    """
    lines = _parsed(spark.read.text(path))
    odd = F.raise_error(F.lit("a boundary needs polygons")).cast(lines.schema["geometry"].dataType)
    return lines.select(F.when(F.col("fits"), F.col("geometry")).otherwise(odd).alias("geometry"))


def geometry_json(geometry: Column | str) -> Column:
    """A geometry of ``collect_polygons`` or ``read_boundary`` as text, of the depth its type asks for."""
    col = F.col(geometry) if isinstance(geometry, str) else geometry
    one = F.to_json(F.struct(col["type"].alias("type"), col["coordinates"][0].alias("coordinates")))
    return F.when(col["type"] == "Polygon", one).otherwise(F.to_json(col))


def polygon_line(
    satellite: Column, start: Column, end: Column, density: Column, geometry: Column
) -> Column:
    """One polygon feature as a line of text, fields in the gate's order."""
    parts = [satellite, start, end, density, geometry]
    return F.to_json(F.struct(*[p.alias(n) for p, n in zip(parts, POLYGON_COLUMNS)]))
