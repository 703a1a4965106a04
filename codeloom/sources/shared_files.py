"""Small files and folders through Hadoop's file system: any store that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of what lies at ``path``, or right below it."""
    fs, p = _at(spark, path)
    found = fs.globStatus(p) or []
    below = [x for top in found for x in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in below))


def read(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Whole contents under a new name; False if the name is taken by then."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        return False
    new = f"{path}.{uuid.uuid4().hex}"
    _, q = _at(spark, new)
    stream = fs.create(q, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(p) or not fs.rename(q, p):
        fs.delete(q, False)
        return False
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
