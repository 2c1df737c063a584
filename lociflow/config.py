"""Settings of the pile-up and of what counts as a candidate."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PileupConfig:
    """Limits are exclusive: a value must be above them.

    ``threshold``: "running" tests the counts as each read arrives, "final" the counts over all reads.
    ``allele_order``: "rarest" keeps the alleles seen least often, "commonest" those seen most often.
    ``label_match``: "alleles" compares allele strings; "none" gives every allele the label 0.
    ``label_span``: how many positions, from the candidate's own on, a truth record may stand at.
    ``ref_mutation``: whether an insertion shortens the reference bases for the ALT alleles after it.
    ``invalid``: "quarantine" leaves records without a defined meaning out, "raise" fails on the first.
    """

    min_mapq: int = 5
    min_mismatches: int = 2
    min_percent: int = 2
    min_coverage: int = 10
    ploidy: int = 2
    threshold: str = "running"
    allele_order: str = "rarest"
    label_match: str = "alleles"
    label_span: int = 2
    ref_mutation: bool = True
    invalid: str = "quarantine"

    def __post_init__(self) -> None:
        for name, allowed in (("threshold", ("running", "final")), ("allele_order", ("rarest", "commonest")), ("label_match", ("alleles", "none")), ("invalid", ("quarantine", "raise"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")
