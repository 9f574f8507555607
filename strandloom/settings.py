"""Every option of a run, with its default."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_K = 31
#: Categories: 2 * library + 1 if paired for short reads; then long ones, and reference sequences.
LONG, REFERENCE = (4, 5), 6


def valid_k(k: int) -> int:
    """Odd and at most MAX_K: even values are decremented, larger ones clamped."""
    k = min(int(k), MAX_K)
    if k % 2 == 0:
        k -= 1
    if k < 1:
        raise ValueError("the word length must be positive")
    return k


def k_values(text: str) -> list[int]:
    """A word length, or `m,M,s`: from m to M exclusive by an even step s (2 by default)."""
    parts = [int(x) for x in str(text).split(",") if x != ""]
    if len(parts) == 1:
        return [valid_k(parts[0])]
    if len(parts) not in (2, 3):
        raise ValueError("give k, or m,M or m,M,s")
    step = parts[2] if len(parts) == 3 else 2
    step += step % 2
    if step <= 0:
        raise ValueError("the step must be positive")
    return list(dict.fromkeys(valid_k(k) for k in range(valid_k(parts[0]), parts[1], step)))


@dataclass(frozen=True)
class AssemblySettings:
    """Options of hashing and assembly. `None` is unset, "auto" is estimated from the coverage."""

    k: int = 21
    strand_specific: bool = False
    cov_cutoff: float | str | None = None
    long_cov_cutoff: float | None = None
    exp_cov: float | str | None = None
    ins_length: dict[int, int] = field(default_factory=dict)
    ins_length_sd: dict[int, int] = field(default_factory=dict)
    read_trkg: bool = False
    scaffolding: bool = True
    export_filtered: bool = False
    amos_file: bool = False
    alignments: bool = False
    unused_reads: bool = False
    min_contig_lgth: int | None = None
    coverage_mask: int = 1
    max_branch_length: int = 100
    max_divergence: float = 0.2
    max_gap_count: int = 3
    min_pair_count: int = 5
    max_coverage: float | None = None
    long_mult_cutoff: int = 2
    paired_exp_fraction: float = 0.1
    clean: bool = False
    very_clean: bool = False
    conserve_long: bool = False
    short_mate_paired: frozenset[int] = frozenset()
    # metagenomes
    discard_chimera: bool = False
    max_chimera_rate: float = 0.0
    repeat_cov_sd: float = 0.1
    min_split_length: int = 0
    valid_connections: int = 1
    noise_connections: int = 0
    use_connections: bool = True
    report_split_detail: bool = False
    report_subgraph: bool = False
    exp_covs: tuple[float, ...] = ()
    min_peak_cov: float = 0.0
    max_peak_cov: float = 500.0
    histo_bin_width: float = 1.0
    histo_sn_ratio: float = 10.0

    def __post_init__(self):
        object.__setattr__(self, "k", valid_k(self.k))
        if not 0 <= self.max_divergence <= 1:
            raise ValueError("max_divergence must lie between 0 and 1")
        if self.max_gap_count < 0 or self.max_branch_length < 0:
            raise ValueError("limits must not be negative")
        if self.clean or self.very_clean:
            raise ValueError("intermediate tables go with the session; there is nothing to clean up after a run")
        if self.valid_connections < 0 or self.noise_connections < 0 or not 0 <= self.max_chimera_rate <= 1 or self.min_peak_cov > self.max_peak_cov:
            raise ValueError("limits of the metagenome run do not fit together")
        for x in (self.cov_cutoff, self.exp_cov):
            if isinstance(x, str) and x != "auto":
                raise ValueError("give a number or auto")

    @property
    def tracking(self) -> bool:
        """Read tracking: asked for, or needed by a positive expected coverage."""
        return self.read_trkg or self.exp_cov == "auto" or (isinstance(self.exp_cov, (int, float)) and self.exp_cov > 0)

    @property
    def tracked(self) -> bool:
        """Whether reads are threaded: for tracking, or for a result that lists reads."""
        return self.tracking or self.unused_reads or self.amos_file

    @property
    def least_contig(self) -> int:
        """In k-mers; twice the word length by default."""
        return 2 * self.k if self.min_contig_lgth is None else max(1, self.min_contig_lgth - self.k + 1)

    def library(self, number: int) -> tuple[int, int] | None:
        """(mean, variance) of a library's insert length, if given; the deviation is a tenth by default."""
        if number not in self.ins_length:
            return None
        mean = self.ins_length[number]
        sd = self.ins_length_sd.get(number, mean // 10)
        return mean, sd * sd
