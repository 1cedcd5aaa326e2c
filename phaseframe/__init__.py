"""Read-based haplotype phasing as partitioned DataFrame plans."""
