"""Small steps on the file system that may be repeated after a crash.

Metadata only (renames, listings, short text files) through the Hadoop file
system client, so they work wherever Spark reads and writes.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    """(file system of the path, constructor of its path objects)."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def move(fs, source, target) -> None:
    """Rename unless it was done before. If both exist (a store that copies was
    interrupted), the copy is discarded and made again."""
    if not fs.exists(source):
        return
    if fs.exists(target):
        fs.delete(target, False)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise RuntimeError(f"could not rename {source} to {target}")


def write_text(fs, to_path, path: str, text: str) -> None:
    """Write a short file that appears whole or not at all; an older one is replaced."""
    part = to_path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(to_path(path)):
        fs.delete(to_path(path), False)
    if not fs.rename(part, to_path(path)):
        raise RuntimeError(f"could not write {path}")


def read_text(fs, to_path, path: str) -> str:
    size = fs.getFileStatus(to_path(path)).getLen()
    data = fs.open(to_path(path))
    try:
        return bytes(data.readNBytes(size)).decode()
    finally:
        data.close()


def children(fs, to_path, path: str) -> list[str]:
    """Names of what a folder holds (nothing if there is no folder)."""
    folder = to_path(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def data_files(fs, to_path, path: str) -> list[str]:
    """Names of the files of a folder that readers see."""
    return [n for n in children(fs, to_path, path) if not n.startswith(("_", "."))]
