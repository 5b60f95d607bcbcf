"""Sinks. Tables go through Spark's committed writers; single documents are small and written by the driver."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import numbered


def json_rows(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines with sorted keys. An order asks for one sorted file and is meant for results of report size."""
    out = df.select(*sorted(df.columns))
    (out.orderBy(*order).coalesce(1) if order else out).write.mode("overwrite").json(path)


def csv_rows(frames: list[DataFrame], path: str) -> bool:
    """Rows of all frames under the sorted union of their columns; nothing is written if there is none."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if out.isEmpty():
        return False
    out.select(*sorted(out.columns)).write.mode("overwrite").option("header", True).csv(path)
    return True


def document(payload: dict[str, Any], path: str | Path) -> None:
    """One JSON document with sorted keys, replaced at once."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(temporary, path)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text of the fields in the order of their names."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def masked_index(records: DataFrame) -> DataFrame:
    """id, joined annotation text and its number of words; records without annotations go."""
    texts = F.transform("annotations", lambda a: a["text"])
    words = F.aggregate(texts, F.lit(0), lambda n, t: n + F.size(F.filter(F.split(t, "\\s+"), lambda w: w != "")))
    return records.where(F.size("annotations") > 0).select("id", F.array_join(texts, " | ").alias("text"), words.alias("n_words"))


def pick(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order; ones that the frame lacks are empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def scatter(rows: DataFrame, order: str, value: str, width: int = 640, height: int = 360) -> DataFrame:
    """Canvas points of a series, evenly spaced in the given order."""
    bounds = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_count"))
    placed = numbered(rows, order, "_at").crossJoin(F.broadcast(bounds))  # one row
    y = F.coalesce((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)), F.lit(0.5))
    x = F.col("_at") * width / F.greatest(F.col("_count") - 1, F.lit(1))
    return placed.select(order, F.round(x, 3).alias("x"), F.round(height * (1 - y), 3).alias("y"))


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A report-size frame as a Markdown table."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def svg(points: list[tuple[float, float]], width: int = 640, height: int = 360) -> str:
    dots = "".join(f'<circle cx="{x:g}" cy="{y:g}" r="2"/>' for x, y in points)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{dots}</svg>\n'


MOST_IMAGES = 1_000_000


def image_document(records: DataFrame, root: str, path: str) -> None:
    """One JSON document with its root and a list of image entries; one row holds it, so longer lists than fit are refused."""
    if (n := records.limit(MOST_IMAGES + 1).count()) > MOST_IMAGES:
        raise ValueError(f"{n} images or more are too many for one document")
    entry = F.struct(
        F.concat(F.lit("imgs/"), F.col("id"), F.lit(".png")).alias("img_name"), F.col("resolution").alias("width"), F.col("resolution").alias("height"),
        "caption", F.lit(0.0).alias("wm_score"), "annotations",
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("id"), entry.alias("entry")))), lambda x: x["entry"])
    records.agg(listed.alias("data_list")).select(F.lit(root).alias("data_root"), "data_list").coalesce(1).write.json(path)


def record_list_hash(rows: DataFrame, keys: list[str], order: str, record: Column) -> DataFrame:
    """SHA-256 of each key's records in order, each after its length as eight bytes, so that other splits differ.

    The hash follows one order, so a key's records meet in one task: for manifests and other lists of bounded length.
    """
    part = F.concat(F.lpad(F.hex(F.octet_length(record).cast("long")), 16, "0"), F.hex(record.cast("binary")))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), part.alias("part"))))
    joined = F.array_join(F.transform(listed, lambda x: x["part"]), "")
    return rows.groupBy(*keys).agg(F.sha2(F.unhex(joined), 256).alias("sha256"))


def files(rows: DataFrame) -> DataFrame:
    """Write a file for each row (path, content as bytes) and return path and bytes; tasks write, nothing is gathered.

    Each file is written aside and moved into place, so a task that is tried again replaces whole files.
    """

    def run(it):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        for batch in it:
            paths, sizes = batch.column("path").to_pylist(), []
            for path, content in zip(paths, batch.column("content").to_pylist(), strict=True):
                where, at = fs.FileSystem.from_uri(path)
                where.create_dir(at.rsplit("/", 1)[0], recursive=True)
                part = f"{at}.{uuid.uuid4().hex}.part"
                with where.open_output_stream(part) as out:
                    out.write(content or b"")
                where.move(part, at)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, bytes long")


def fan_out(rows: DataFrame) -> DataFrame:
    """Copy or, where source and target share a local disk, hard-link files (path, target); returns target and how."""

    def run(it):
        import os

        import pyarrow as pa
        from pyarrow import fs

        for batch in it:
            targets, how = batch.column("target").to_pylist(), []
            for path, target in zip(batch.column("path").to_pylist(), targets, strict=True):
                (a, source), (b, place) = fs.FileSystem.from_uri(path), fs.FileSystem.from_uri(target)
                b.create_dir(place.rsplit("/", 1)[0], recursive=True)
                try:
                    if not (isinstance(a, fs.LocalFileSystem) and isinstance(b, fs.LocalFileSystem)):
                        raise OSError("not on one disk")
                    if os.path.exists(place):
                        os.unlink(place)
                    os.link(source, place)
                    how.append("link")
                except OSError:
                    fs.copy_files(source, place, source_filesystem=a, destination_filesystem=b)
                    how.append("copy")
            yield pa.RecordBatch.from_arrays([pa.array(targets, pa.string()), pa.array(how, pa.string())], names=["target", "how"])

    return rows.select("path", "target").mapInArrow(run, "target string, how string")
