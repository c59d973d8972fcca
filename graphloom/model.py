"""Schemas and plan parameters."""

from __future__ import annotations

from dataclasses import dataclass

NODES = "node_id long, rank long, comp long, len int, seq string"
EDGES = "src long, dst long, from_start boolean, to_end boolean, overlap int"
PATH_STEPS = "path_id long, path_name string, pos int, node_id long, is_reverse boolean"
READS = "read_id long, name string, seq string"
SEEDS = "node_id long, node_offset int, read_id long, read_offset int, match_len int, gocc long"
GAF = (
    "line long, q_name string, q_len long, q_start long, q_end long, q_fwd boolean, path string, p_len long, p_start long, p_end long,"
    " match long, block long, qual long, tag_az map<string,string>, tag_i map<string,int>, tag_f map<string,float>"
)


@dataclass(frozen=True)
class Params:
    """What a seed-finding plan needs.

    k: seed length; read_step: distance of seeds on a read (0: k); loci_step: distance of starting loci; paths: haplotypes
    per component; patched: keep only what is new of later haplotypes; context: length of a patch's flanks (0: k);
    occurrence_limit: skip seeds found more often on paths (0: none); max_hits: hits of a read in a scan (0: all);
    dmin, dmax: distances of the distance index (0, 0: none); distinct: drop repeated hits.
    """

    k: int
    read_step: int = 0
    loci_step: int = 1
    paths: int = 0
    patched: bool = True
    context: int = 0
    occurrence_limit: int = 0
    max_hits: int = 0
    dmin: int = 0
    dmax: int = 0
    distinct: bool = False

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be at least 1")
        if min(self.read_step, self.loci_step - 1, self.paths, self.context, self.occurrence_limit, self.max_hits, self.dmin, self.dmax) < 0:
            raise ValueError("parameters may not be negative, and loci_step must be at least 1")
        if 0 < self.context < self.k:
            raise ValueError("context must be 0 or at least k")
        if self.dmax and self.dmax < self.dmin:
            raise ValueError("dmax must be 0 or at least dmin")

    @property
    def step(self) -> int:
        return self.read_step or self.k

    @property
    def flank(self) -> int:
        return self.context or self.k
