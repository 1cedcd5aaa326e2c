"""Parameters of a phasing run."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PhasingConfig:
    """Defaults are those of the command line; ``for_technology`` sets the flanks."""

    technology: str = "pacbio"
    chrom: str | None = None
    snvs_only: bool = False
    multiallelics: bool = False
    max_allele_length: int = 50_000
    min_allele_count: int = 1
    min_base_quality: int = 0
    min_mapq: int = 20
    flank_snv: int = 33
    flank_indel: int = 100
    max_meth_distance: int = 5_000
    use_all_methylated_sites: bool = False
    max_sites: int = 25_000
    error_rate: float = 1e-3
    llr_threshold: float = 4.0
    damping: float = 0.0

    def __post_init__(self):
        if self.technology not in ("pacbio", "ont"):
            raise ValueError("technology is 'pacbio' or 'ont'")

    @staticmethod
    def for_technology(technology: str, **changes) -> PhasingConfig:
        """Flanks are 33 and 100 bases for PacBio HiFi, 66 and 200 for ONT."""
        flanks = {"flank_snv": 66, "flank_indel": 200} if technology == "ont" else {}
        return replace(PhasingConfig(technology=technology), **{**flanks, **changes})

    @property
    def ont(self) -> bool:
        return self.technology == "ont"
