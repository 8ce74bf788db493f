"""Image folders: listing, decoding by Spark's image source, limits as error columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.functions.columns import let
from assetloom.schema import IMAGE_SUFFIXES, Settings

#: Fixed values of the EXIF format, and how much of a file and of its first directory is looked at.
ORIENTATION_TAG = 0x0112
HEADER_BYTES, MOST_ENTRIES = 1 << 16, 64


def list_images(spark: SparkSession, folder: str, limit: int | None = None, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime), by path; only suffixes of images. Contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder).drop("content")
    known = files.where(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(IMAGE_SUFFIXES)).orderBy("path")
    return known.limit(limit) if limit else known


def orientation(content: Column) -> Column:
    """1 to 8, the orientation tag of a file's EXIF header; 1 where there is none or it can't be read.

    The first HEADER_BYTES are read as a string whose characters are the bytes. The tag is an entry of the first
    directory of the TIFF structure that follows the marker, or the file's beginning.
    """
    head = F.decode(F.substring(content, 1, HEADER_BYTES), "ISO-8859-1")
    marked = F.locate("Exif\0\0", head)
    # PNG has a chunk with the structure alone.
    begin = F.when(marked > 0, marked + 6).when(F.locate("eXIf", head) > 0, F.locate("eXIf", head) + 4).otherwise(1)
    bytes_at = lambda h, at, n: [F.ascii(F.substring(h, at + k, F.lit(1))) for k in range(n)]

    def number(t, at, n):
        found = bytes_at(t["head"], at, n)
        value = lambda b: sum((x.cast("long") * 256**k for k, x in enumerate(b)), F.lit(0).cast("long"))
        # Nothing lies beyond the header.
        return F.least(F.when(t["little"], value(found)).otherwise(value(found[::-1])), F.lit(HEADER_BYTES)).cast("int")

    def tag(t):
        directory = t["begin"] + number(t, t["begin"] + 4, 4)
        entries = lambda d: F.transform(F.sequence(F.lit(0), F.least(number(t, d, 2), F.lit(MOST_ENTRIES))), lambda i: d + 2 + 12 * i)
        own = lambda d: F.filter(entries(d), lambda e: number(t, e, 2) == ORIENTATION_TAG)
        return let(directory, lambda d: number(t, F.coalesce(F.get(own(d), F.lit(0)), F.lit(1)) + 8, 2) * (F.size(own(d)) > 0).cast("int"))

    def of(h):
        sign = F.substring(h["head"], h["begin"], F.lit(2))
        fields = F.struct(h["head"].alias("head"), h["begin"].alias("begin"), (sign == "II").alias("little"))
        return F.when(sign.isin("II", "MM"), let(fields, tag))

    found = let(F.struct(head.alias("head"), begin.alias("begin")), of)
    return F.when(found.between(1, 8), found).otherwise(1).cast("int")


def one_slash(path: Column) -> Column:
    """A path with one slash after its scheme: the two sources write local paths differently."""
    return F.regexp_replace(path, "^([^:/]+):/+", "$1:/")


def orientations(spark: SparkSession, folder: str) -> DataFrame:
    """(origin, orientation) of the files in a folder, from their first bytes; only those other than 1."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.col("path").alias("origin"), orientation(F.col("content")).alias("orientation")).where("orientation > 1")


def decode(spark: SparkSession, folder: str, settings: Settings | None = None) -> DataFrame:
    """(image, orientation, error): rows of the image source with the files' orientation tags; files that can't be
    decoded, have channels of another number than 1, 3 or 4, or break a limit keep their row."""
    s = settings or Settings.of(spark)
    rows = spark.read.format("image").option("dropInvalid", "false").load(folder)
    rows = rows.join(orientations(spark, folder), one_slash(F.col("image.origin")) == one_slash(F.col("origin")), "left").withColumn("orientation", F.coalesce("orientation", F.lit(1))).drop("origin")
    long, short = F.greatest("image.width", "image.height"), F.least("image.width", "image.height")
    error = F.when(F.col("image.width") < 0, "cannot decode").when(~F.col("image.nChannels").isin(1, 3, 4), F.concat(F.col("image.nChannels").cast("string"), F.lit(" channels"))).when(long > s.max_side, F.concat(F.lit("long edge above "), F.lit(str(s.max_side)))).when(short < s.min_side, F.concat(F.lit("short edge below "), F.lit(str(s.min_side))))
    return rows.withColumn("error", error)


def upload_errors(uploads: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Adds error to rows with content: empty, or above the limit."""
    s = settings or Settings.of(uploads.sparkSession)
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    return uploads.withColumn("error", F.when(size == 0, "empty").when(size > int(s.max_upload_mb * 1e6), "too large"))


def first_source(inline, fetched, stored):
    """Contents of an item: inline, else fetched, else stored."""
    return F.coalesce(inline, fetched, stored)
