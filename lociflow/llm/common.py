"""Helpers shared by the training-data operators."""

from __future__ import annotations

import bisect
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest


class WordHashes(dict):
    """64-bit hashes of words, kept for as long as they are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


def by_place(df: DataFrame) -> DataFrame:
    """All columns, named by their places _c0, _c1 and so on, since names may repeat."""
    ship(df.sparkSession)
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name and first place, so that extra or repeated columns can't clash."""
    at = [df.columns.index(n) for n in names]
    return by_place(df).select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def range_of(bounds: list[tuple], columns: list[str]) -> Column:
    """How many of the sorted bounds are not above a row's place in the order of ``columns``, nulls first; by nested comparisons of log depth."""

    def reached(bound: tuple) -> Column:
        out = F.lit(True)
        for c, v in reversed(list(zip(columns, bound, strict=True))):
            x = F.col(c)
            above, same = (x.isNotNull(), x.isNull()) if v is None else (F.coalesce(x > F.lit(v), F.lit(False)), F.coalesce(x == F.lit(v), F.lit(False)))
            out = above | (same & out)
        return out

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(reached(bounds[mid]), part(mid + 1, hi)).otherwise(part(lo, mid))

    return part(0, len(bounds))


#: Ranges at most: their bounds, and a sample of some rows for each, pass through the driver.
MOST_RANGES = 20_000


def range_bounds(rows: DataFrame, columns: list[str], n: int, size: str, total: int, each: int = 40) -> list[tuple]:
    """Bounds of up to ``n`` ranges of ``columns`` with about equal sums of the column ``size``, whose sum over all rows is ``total``.

    They are taken from a sample of about ``each`` rows for a range, in which a row's chance grows with its size.
    """
    n = min(n, MOST_RANGES)
    if n < 2 or not total:
        return []
    chance = (F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) + 0.5) / (1 << 30)
    sample = rows.where(chance < F.col(size) * (each * n / total)).select(*columns).collect()
    found = sorted((tuple(r) for r in sample), key=place_of)
    return sorted({found[len(found) * i // n] for i in range(1, n)}, key=place_of) if found else []


def place_of(row: tuple) -> list[tuple]:
    """A key that sorts rows as Spark does, nulls first."""
    return [(x is not None, x if x is not None else 0) for x in row]


def range_number(bounds: list[tuple], columns: list[str]) -> Column:
    """As range_of(), for many bounds: only ``columns`` go to Python, which searches the bounds by halves."""
    keys = [place_of(b) for b in bounds]

    def number(*values: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(keys, place_of(row)) for row in zip(*(v.to_pylist() for v in values), strict=True)], pa.int32())

    return F.arrow_udf(number, "int")(*columns) if bounds else F.lit(0)


def ordered(rows: list[tuple]) -> list[tuple]:
    """Distinct rows in Spark's order, nulls first."""
    return sorted(set(rows), key=place_of)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session without one gets a temporary folder, which only a local master can share.
    """
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lociflow-"))
        place = spark.sparkContext.getCheckpointDir()
    return place


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here remove their shuffle files when they end, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder; lineage ends there, and so do the shuffle files that led to it."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column, over all rows."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that their Python can import it."""
    context = spark.sparkContext
    if getattr(context, "_has_lociflow", False):
        return
    home = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="lociflow-code-")) / f"{home.name}.zip"
    with zipfile.ZipFile(to, "w") as archive:
        for p in sorted(home.rglob("*.py")):
            archive.write(p, p.relative_to(home.parent))
    context.addPyFile(str(to))
    context._has_lociflow = True
