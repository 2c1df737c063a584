"""CIGAR strings as columns.  All functions are built from Spark's own array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that move along the reference, and along the read.
ON_REFERENCE, ON_READ = "MDN", "MIS"
KNOWN = "MIDNSHP"
_CHUNK = 64


def parse_cigar(cigar: Column | str) -> Column:
    """array<struct<op, n>>; empty for ``*``, null for null."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(parts, lambda t: F.struct(F.right(t, F.lit(1)).alias("op"), F.left(t, F.length(t) - 1).cast("int").alias("n")))


def is_valid_cigar(cigar: Column | str) -> Column:
    """Whether only the seven known operations occur (``=`` and ``X`` are not among them)."""
    return F.coalesce(F.regexp_like(cigar, F.lit(rf"^(\d+[{KNOWN}])+$")), F.lit(False))


def _moves(op: Column, n: Column, ops: str) -> Column:
    return F.when(op.isin(*ops), n).otherwise(0).cast("long")


def total_length(ops: Column, kinds: str) -> Column:
    """Summed length of the operations of the given kinds."""
    return F.aggregate(ops, F.lit(0).cast("long"), lambda acc, x: acc + _moves(x["op"], x["n"], kinds))


def reference_end(ref_start: Column | str, cigar: Column | str) -> Column:
    """The position after the last aligned one."""
    start = F.col(ref_start) if isinstance(ref_start, str) else ref_start
    return (start + total_length(parse_cigar(cigar), ON_REFERENCE)).cast("int")


def _scan(ops: Column, rp: Column, qp: Column) -> Column:
    none = F.array().cast("array<struct<op:string,n:int,rp:bigint,qp:bigint>>")
    start = F.struct(rp.cast("long").alias("rp"), qp.cast("long").alias("qp"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["op"].alias("op"), x["n"].alias("n"), acc["rp"].alias("rp"), acc["qp"].alias("qp"))
        return F.struct(
            (acc["rp"] + _moves(x["op"], x["n"], ON_REFERENCE)).alias("rp"),
            (acc["qp"] + _moves(x["op"], x["n"], ON_READ)).alias("qp"),
            F.array_append(acc["out"], here).alias("out"),
        )

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def with_offsets(ops: Column) -> Column:
    """array<struct<op, n, rp, qp>>: each operation with its offset from the alignment start and into the read.

    Prefix sums go over groups of 64 operations and then inside each, so that a long read's array isn't
    copied once per operation.  No shuffle is needed.
    """
    groups = F.transform(F.sequence(F.lit(0), F.greatest((F.size(ops) - 1) / _CHUNK, F.lit(0)).cast("int")), lambda c: F.slice(ops, c * _CHUNK + 1, F.lit(_CHUNK)))
    none = F.array().cast("array<struct<rp:bigint,qp:bigint,ops:array<struct<op:string,n:int>>>>")
    start = F.struct(F.lit(0).cast("long").alias("rp"), F.lit(0).cast("long").alias("qp"), none.alias("out"))

    def step(acc: Column, group: Column) -> Column:
        return F.struct(
            (acc["rp"] + total_length(group, ON_REFERENCE)).alias("rp"),
            (acc["qp"] + total_length(group, ON_READ)).alias("qp"),
            F.array_append(acc["out"], F.struct(acc["rp"].alias("rp"), acc["qp"].alias("qp"), group.alias("ops"))).alias("out"),
        )

    placed = F.aggregate(groups, start, step, lambda acc: acc["out"])
    return F.flatten(F.transform(placed, lambda g: _scan(g["ops"], g["rp"], g["qp"])))
