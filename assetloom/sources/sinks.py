"""Result files: flat CSV, sidecars, split lists, PNG and the HTML report."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions.columns import basename, blank_to_null, html_escape, percent
from assetloom.operators.reporting import flat_results, report_order


def write_results_csv(results: DataFrame, path: str) -> None:
    flat_results(results).write.mode("overwrite").csv(path, header=True, emptyValue="", quote='"', escape='"')


def write_sidecars(results: DataFrame, path: str) -> None:
    """One JSON line an image, in folders by job."""
    results.write.mode("overwrite").partitionBy("job_id").json(path)


def split_lists(rows: DataFrame) -> DataFrame:
    """(split, line): ``image<TAB>label``, the reviewed label if there is one."""
    label = F.coalesce(blank_to_null(F.col("label_final")), F.col("label_auto"))
    return rows.select("split", F.concat_ws("\t", "image", label).alias("line"))


def write_split_lists(rows: DataFrame, path: str) -> None:
    split_lists(rows).write.mode("overwrite").partitionBy("split").text(path)


def export_files(results: DataFrame, base: list[str], extra: list[str], showcase: list[str], all_layers: bool = False) -> DataFrame:
    """(id, file): the basic layers of every image, the others for showcased ids or all."""
    shown = F.lit(all_layers) | F.exists(F.array(*map(F.lit, showcase)).cast("array<string>"), lambda s: F.col("id").contains(s))
    suffix = F.explode(F.when(shown, F.array(*map(F.lit, base + extra))).otherwise(F.array(*map(F.lit, base)))).alias("suffix")
    return results.select("id", suffix).select("id", F.concat("id", "suffix").alias("file"))


def report_rows(results: DataFrame) -> DataFrame:
    """The report's table as HTML rows, in its order: review, failed, ready, low confidence first."""
    cells = [F.col("verdict"), percent(F.coalesce("confidence", F.lit(0.0))), basename(F.col("source")), F.coalesce(F.try_element_at("reasons", F.lit(1)), F.coalesce("error", F.lit("")))]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escape(F.coalesce(c, F.lit(""))), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    return results.orderBy(*report_order()).select(row.alias("html"))


def png_chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png_of(width: int, height: int, channels: int, pixels: bytes, level: int = 6) -> bytes:
    """A PNG of 8-bit grey, RGB or RGBA pixels, row by row."""
    step = width * channels
    lines = b"".join(b"\0" + pixels[y * step : (y + 1) * step] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", head) + png_chunk(b"IDAT", zlib.compress(lines, level)) + png_chunk(b"IEND", b"")


def _png_batches(batches):
    for batch in batches:
        pngs = [png_of(w, h, 1, bytes(v)) for w, h, v in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pngs, pa.binary())], ["image", "png"])


def encode_png(images: DataFrame) -> DataFrame:
    """(image, png) from rows of pixels: image, y, x, v (0-255). A row of the result is one encoded image."""
    rows = images.groupBy("image").agg(F.max("x").alias("w"), F.max("y").alias("h"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    packed = rows.select("image", (F.col("w") + 1).alias("w"), (F.col("h") + 1).alias("h"), F.transform("p", lambda s: s["v"].cast("int")).alias("v"))
    return packed.mapInArrow(_png_batches, f"image {images.schema['image'].dataType.simpleString()}, png binary")
