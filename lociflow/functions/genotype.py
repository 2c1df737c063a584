"""Genotypes and variant classes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Genotype codes, and class codes of alleles.
HOM, HET, HOM_ALT = 0, 1, 2
SNP_OR_DELETION, INSERTION = 0, 1
PASS = "PASS"
DELETED = "*"


def parse_genotype(gt: Column | str) -> Column:
    """array<int> from text such as ``0/1``, ``1|1``, ``1`` or ``./.``; a dot is null."""
    return F.split(F.translate(gt, "|", "/"), "/").try_cast("array<int>")  # in compiled code, since filters on genotypes repeat it


def is_called(gt: Column, filter_: Column) -> Column:
    """Whether a record counts as variant: two alleles, not both 0, and PASS; or one allele other than 0; any other number of alleles counts."""
    zero = lambda i: F.get(gt, F.lit(i)).eqNullSafe(F.lit(0))
    return (
        F.when(F.size(gt) == 2, ~((zero(0) & zero(1)) | ~filter_.eqNullSafe(F.lit(PASS))))
        .when(F.size(gt) == 1, ~zero(0))
        .otherwise(True)
    )


def genotype_code(gt: Column) -> Column:
    """0 (both alleles 0, or the only one), 1 (two different), 2 (two equal, both missing included, or a single 1), else null."""
    a, b = F.get(gt, F.lit(0)), F.get(gt, F.lit(1))
    zero, one = a.eqNullSafe(F.lit(0)), a.eqNullSafe(F.lit(1))
    two = F.when(~a.eqNullSafe(b), HET).when(zero, HOM).otherwise(HOM_ALT)
    return F.when(F.size(gt) == 2, two).when((F.size(gt) == 1) & zero, HOM).when((F.size(gt) == 1) & one, HOM_ALT).cast("int")


def variant_class(ref: Column, alt: Column) -> Column:
    """SNP, IN or DEL by the lengths of both alleles; null for equal lengths over 1, which have no class."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNP").when(r < a, "IN").when(r > a, "DEL")


def is_supported(genotypes: Column) -> Column:
    """Whether an array of genotype codes has any other than 0; false if it is empty."""
    return F.exists(genotypes, lambda g: ~g.eqNullSafe(F.lit(HOM)))
