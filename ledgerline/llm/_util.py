"""Helpers shared by the operators: written tables and byte-string hashing."""

from __future__ import annotations

import gc
import tempfile
import threading
import zipfile
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import fresh_path

#: Learning never sees rows whose crc32(id as text) mod 4 is this.
HELD_OUT_FOLD = 2


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark) -> None:
    """Make this package importable in Python workers wherever the driver was
    started: its source files are added to the session once, as a zip."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerline_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="ledgerline-code-")) / "ledgerline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._ledgerline_shipped = True


def read(spark, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def _setting(spark, key: str, value: str):
    """The session's setting while the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def wide_groups(spark):
    """Aggregations of what is written in the block keep up to 2**18 groups a task in
    the compiled hash map; beyond it (by default 2**16) every row is looked up twice."""
    return _setting(spark, "spark.sql.codegen.aggregate.fastHashMap.capacityBit", "18")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder in the shared work root (its ``saved_at``) and read it back:
    cuts the lineage and gives later joins a plain scan on either side. The
    shuffle files of the write are removed when it is done."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    if blocks := getattr(_scratch, "blocks", None):
        blocks[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


_scratch = threading.local()


def _delete(spark, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``save`` has written, once nothing reads them any more; others stay."""
    for table in tables:
        if path := vars(table).get("saved_at"):              # not a column of that name
            _delete(table.sparkSession, path)


@contextmanager
def scratch(spark):
    """Tables that are saved in the block are removed at its end, but for those that are passed to
    what it yields (which returns them)."""
    if not hasattr(_scratch, "blocks"):
        _scratch.blocks = []
    paths: list[str] = []
    kept: list[str] = []
    _scratch.blocks.append(paths)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(vars(table)["saved_at"])
        return table

    try:
        yield keep
    finally:
        _scratch.blocks.pop()
        for path in paths:
            if path not in kept:
                _delete(spark, path)
        if _scratch.blocks:
            _scratch.blocks[-1].extend(kept)


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(id_col):
    """True for rows of the held-out fold (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT_FOLD, F.lit(False))


_held: dict[tuple, object] = {}


def one_model(owner: str, key: int, build):
    """What a Python worker keeps between tasks: one object, built when first
    asked for. Asking for another one drops it, so a reused worker does not hold the
    models of stages that are over."""
    if (owner, key) not in _held:
        _held.clear()
        gc.collect()
        _held[owner, key] = build()
    return _held[owner, key]


_BASE = 0x9E3779B97F4A7C15                   # odd, so powers have inverses modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int):
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PrefixHash:
    """Hashes of arbitrary substrings of one byte string in O(1) each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[:n], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, length: int) -> np.ndarray:
        """Hash of every substring of this length."""
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.inverse[:n])
