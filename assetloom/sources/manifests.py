"""Tolerant manifests: CSV and JSON lists of images as typed rows, what can't be used as warnings."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.functions.columns import blank_to_null, category, is_http, key_of
from assetloom.schema import CATEGORY_COLUMNS, ENVELOPES, SKU_COLUMNS, URL_COLUMNS

DELIMITERS = ",;\t|"


def _normalised(name: str) -> str:
    return name.replace("﻿", "").strip().lower().replace(" ", "_").replace("-", "_")


def _pick(columns: dict[str, str], names: list[str]) -> Column:
    """The first of ``names``, in their order, whose trimmed value isn't blank; columns: normalised -> actual, the last of equal names."""
    found = [blank_to_null(F.col(f"`{columns[n]}`").cast("string")) for n in names if n in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def delimiter_of(header: str) -> str:
    """The delimiter that the header line holds most often; a comma where none occurs."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


def _typed(rows: DataFrame, url: Column, kind: Column, sku: Column) -> DataFrame:
    return rows.select("row", url.alias("source"), url.alias("url"), category(kind).alias("category"), sku.alias("sku"))


def _names(header: str, sep: str) -> list[str]:
    """The header's names as CSV has them."""
    return next(csv.reader([header], delimiter=sep))


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    """Adds row, the number inside the row's file."""
    placed = rows.withColumns({"csv_file": F.input_file_name(), "csv_place": F.monotonically_increasing_id()})
    begins = placed.groupBy("csv_file").agg(F.min("csv_place").alias("csv_begin"))
    return placed.join(begins, "csv_file").withColumn("row", F.col("csv_place") - F.col("csv_begin") + first)


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, warnings). Items: row, source, url, category, sku; warnings: row, warning.

    Only the first line reaches the driver. ``path`` may be a folder of lists with the same header. Rows are numbered in
    their own file, the header being 1; a file is one task, since a quoted field may hold line ends. Of
    columns whose names are the same the last one counts. Without a known URL column every line is
    read again, the first included: column 1 is the URL if it starts with http(s), column 2 the category.
    """
    lines = spark.read.text(path)
    head = lines.where(F.trim("value") != "").limit(1).collect()
    empty_items = spark.createDataFrame([], "row long, source string, url string, category string, sku string")
    if not head:
        return empty_items, spark.createDataFrame([(None, "CSV is empty")], "row long, warning string")
    sep = delimiter_of(head[0].value)
    columns = {_normalised(name): f"c{i}" for i, name in enumerate(_names(head[0].value, sep))}
    schema = ", ".join(f"c{i} string" for i in range(max(2, len(_names(head[0].value, sep)))))
    # Names of our own, so that equal names in the file can't clash.
    reader = spark.read.schema(schema).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("enforceSchema", True)
    if not columns.keys() & set(URL_COLUMNS):
        bare = _numbered(reader.csv(path, header=False), 1)
        url = F.trim(F.regexp_replace("c0", "^\ufeff", ""))
        return _typed(bare.where(is_http(url)), url, F.col("c1"), F.lit(None).cast("string")), spark.createDataFrame([(1, "no known URL column; column 1 is used")], "row long, warning string")
    numbered = _numbered(reader.csv(path, header=True), 2)
    url = _pick(columns, URL_COLUMNS)
    good = numbered.where(url.isNotNull())
    bad = numbered.where(url.isNull()).select("row", F.format_string("row %d: no image URL", "row").alias("warning"))
    return _typed(good, url, _pick(columns, CATEGORY_COLUMNS), _pick(columns, SKU_COLUMNS)), bad


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, warnings) of one JSON document: a list of addresses or objects, an object that holds such
    a list, or a single object. Items are numbered from 0."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    doc = text.select("value", F.try_parse_json("value").alias("v"))
    lists = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ENVELOPES]
    entries = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *lists, F.when(F.schema_of_variant("v").startswith("OBJECT"), F.array("v")))
    bad_doc = doc.where(F.col("v").isNull() | entries.isNull()).select(F.lit(None).cast("long").alias("row"), F.lit("not a JSON list or object").alias("warning"))
    # The entries' own text keeps the order of their keys, which a variant doesn't.
    raw_lists = [F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>") for k in ENVELOPES]
    raw = F.coalesce(F.from_json("value", "array<string>"), *raw_lists, F.array("value"))
    each = doc.where(F.col("v").isNotNull() & entries.isNotNull()).select(F.posexplode(F.arrays_zip(entries.alias("e"), raw.alias("raw"))).alias("pos", "z")).select(F.col("pos").cast("long").alias("row"), "z.e", "z.raw")
    kind = F.schema_of_variant("e")
    # Keys that normalise alike come one after the other; the last value counts.
    pairs = F.map_entries(F.from_json("raw", "map<string,string>"))
    fields = F.when(kind.startswith("OBJECT"), F.transform(pairs, lambda x: F.struct(key_of(x["key"]).alias("key"), x["value"].alias("value"))))
    last = lambda name: F.try_element_at(F.filter("fields", lambda x: x["key"] == name), F.lit(-1))["value"]
    each = each.withColumns({"text": F.when(kind == "STRING", F.trim(F.col("e").cast("string"))), "fields": fields})
    pick = lambda names: F.coalesce(*[blank_to_null(last(n)) for n in names])
    url = F.when(F.col("text").isNotNull(), F.when(is_http(F.col("text")), F.col("text"))).otherwise(pick(URL_COLUMNS))
    good = _typed(each.where(url.isNotNull()), url, pick(CATEGORY_COLUMNS), pick(SKU_COLUMNS))
    why = F.when(F.col("text").isNotNull(), "not an http(s) address").when(F.col("fields").isNotNull(), "no image URL").otherwise("not an object or text")
    bad = each.where(url.isNull()).select("row", F.concat(F.format_string("item %d: ", "row"), why).alias("warning"))
    return good, bad.union(bad_doc)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """By suffix; any other name by the first character that isn't blank."""
    name = path.lower()
    if name.endswith(".json"):
        return read_json(spark, path)
    if name.endswith((".csv", ".tsv", ".txt")):
        return read_csv(spark, path)
    head = spark.read.text(path).where(F.trim("value") != "").select(F.left(F.trim("value"), F.lit(1))).limit(1).collect()
    return (read_json if head and head[0][0] in "[{" else read_csv)(spark, path)


def read_commented_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table of titles with comment lines, rows without a title dropped."""
    table = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True)
    return table.where(F.trim("title") != "")


def with_hints(items: DataFrame, hints: DataFrame) -> DataFrame:
    """Sets the category of items (column file) from a table (file, category), auto where there is none.

    The join is left to the planner, which broadcasts the hints when they are small.
    """
    one = hints.groupBy("file").agg(F.max(blank_to_null(F.col("category"))).alias("hint"))
    return items.join(one, "file", "left").withColumn("category", category(F.col("hint"))).drop("hint")
