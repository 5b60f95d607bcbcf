"""Small JSON documents and folder listings through Spark's own file systems, so that they may lie wherever tables lie."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

HASHED = 64 << 20  # larger files are named in manifests, not hashed on the driver


class DocumentError(ValueError):
    """A document is missing or is no JSON object."""


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return target.getFileSystem(conf), target, conf


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """Replace the file at once: readers see the old bytes or the new ones, never a part."""
    files, target, conf = _place(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(part, True)
    out.write(bytearray(data))
    out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(part), files.makeQualified(target), how)


def write(spark: SparkSession, payload: dict[str, Any], path: str) -> None:
    """One JSON document with sorted keys, replaced at once."""
    write_bytes(spark, (json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode(), path)


def create(spark: SparkSession, payload: dict[str, Any], path: str) -> bool:
    """Write a document only if none is there; of several writers one succeeds."""
    files, target, _ = _place(spark, path)
    try:
        out = files.create(target, False)
    except Exception:
        if files.exists(target):
            return False
        raise
    out.write(bytearray(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()))
    out.close()
    return True


def read_bytes(spark: SparkSession, path: str) -> bytes:
    files, target, _ = _place(spark, path)
    stream = files.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read(spark: SparkSession, path: str) -> dict[str, Any]:
    if not is_file(spark, path):
        raise DocumentError(f"{path}: there is no such document")
    try:
        payload = json.loads(read_bytes(spark, path))
    except ValueError:
        raise DocumentError(f"{path}: not JSON") from None
    if not isinstance(payload, dict):
        raise DocumentError(f"{path}: not a JSON object")
    return payload


def exists(spark: SparkSession, path: str) -> bool:
    files, target, _ = _place(spark, path)
    return files.exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    files, target, _ = _place(spark, path)
    return files.exists(target) and not files.getFileStatus(target).isDirectory()


def is_dir(spark: SparkSession, path: str) -> bool:
    files, target, _ = _place(spark, path)
    return files.exists(target) and files.getFileStatus(target).isDirectory()


def size(spark: SparkSession, path: str) -> int:
    files, target, _ = _place(spark, path)
    return files.getFileStatus(target).getLen()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, hidden ones left out."""
    files, target, _ = _place(spark, folder)
    found = [s.getPath().getName() for s in files.listStatus(target)]
    return sorted(n for n in found if not n.startswith(("_", ".")))


def delete(spark: SparkSession, path: str) -> None:
    files, target, _ = _place(spark, path)
    files.delete(target, True)


def sha256(spark: SparkSession, path: str) -> str | None:
    """Hash of a file's bytes; none if it is larger than the driver should read."""
    if size(spark, path) > HASHED:
        return None
    return hashlib.sha256(read_bytes(spark, path)).hexdigest()
