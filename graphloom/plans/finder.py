"""The seed finder: index paths, find what they leave uncovered, join reads with both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.kmers import kmers
from graphloom.model import Params
from graphloom.operators import distance, haplotypes, paths, seeds, walks
from graphloom.sources import tables
from graphloom.staging import staged


@dataclass
class Index:
    """path_steps and ends, their k-mers, the uncovered loci and, if asked for, the distance pairs."""

    path_steps: DataFrame
    ends: DataFrame | None
    path_kmers: DataFrame
    loci: DataFrame
    distances: DataFrame | None


class SeedFinder:
    """Seeds of reads on a graph. The union of seeds on indexed paths and seeds off them from uncovered loci is complete:
    as a distinct set it equals the expansion from all loci, whatever the paths."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, params: Params) -> None:
        self.nodes, self.edges, self.params = nodes, edges, params
        self.index: Index | None = None

    def pick_paths(self, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        p = self.params
        how = "patched" if p.patched else "full"
        picked = staged(haplotypes.pick_paths(self.nodes, self.edges, p.paths, how, p.flank, seed=seed), "picked")
        return haplotypes.as_steps(picked), haplotypes.as_ends(picked)

    def build(self, path_steps: DataFrame | None = None, ends: DataFrame | None = None) -> Index:
        """Index given paths, or pick some. Without paths every locus is uncovered."""
        p = self.params
        if path_steps is None:
            path_steps, ends = self.pick_paths()
        found = staged(paths.path_kmers(path_steps, self.nodes, p.k, ends), "path-kmers")
        far = None
        if p.dmin or p.dmax:
            far = staged(distance.distance_pairs(self.nodes, self.edges, p.dmin, p.dmax), "distances")
        # A patch's first and last node count whole: what it does not use of them lies on the earlier walks.
        loci = staged(walks.uncovered_loci(self.nodes, self.edges, path_steps, p.k, p.loci_step), "loci")
        self.index = Index(path_steps, ends, found, loci, far)
        return self.index

    def save(self, prefix: str) -> None:
        p, i = self.params, self._built()
        tables.save(i.path_kmers, f"{prefix}_paths", "paths", k=p.k, paths=p.paths, patched=p.patched, context=p.flank)
        tables.save(i.path_steps, f"{prefix}_steps", "steps", paths=p.paths, patched=p.patched, context=p.flank)
        if i.ends is not None:
            tables.save(i.ends, f"{prefix}_ends", "ends", paths=p.paths, patched=p.patched, context=p.flank)
        tables.save(i.loci, tables.loci_name(prefix, p.k, p.loci_step), "loci", k=p.k, step=p.loci_step)
        if i.distances is not None:
            tables.save(i.distances, tables.distance_name(prefix, p.dmin, p.dmax), "distances", dmin=p.dmin, dmax=p.dmax)

    def load(self, prefix: str) -> Index:
        """The saved index; loci or distances that are missing are made again, and saved there."""
        p, spark = self.params, self.nodes.sparkSession
        found = tables.load(spark, f"{prefix}_paths", "paths", k=p.k, paths=p.paths, patched=p.patched, context=p.flank)
        steps = tables.load(spark, f"{prefix}_steps", "steps", paths=p.paths, patched=p.patched, context=p.flank)
        ends = tables.load(spark, f"{prefix}_ends", "ends", paths=p.paths, patched=p.patched, context=p.flank) if tables.exists(spark, f"{prefix}_ends") else None
        at = tables.loci_name(prefix, p.k, p.loci_step)
        if not tables.exists(spark, at):
            tables.save(walks.uncovered_loci(self.nodes, self.edges, steps, p.k, p.loci_step), at, "loci", k=p.k, step=p.loci_step)
        loci = tables.load(spark, at, "loci", k=p.k, step=p.loci_step)
        far = None
        if p.dmin or p.dmax:
            there = tables.distance_name(prefix, p.dmin, p.dmax)
            if not tables.exists(spark, there):
                tables.save(distance.distance_pairs(self.nodes, self.edges, p.dmin, p.dmax), there, "distances", dmin=p.dmin, dmax=p.dmax)
            far = tables.load(spark, there, "distances", dmin=p.dmin, dmax=p.dmax)
        self.index = Index(steps, ends, found, loci, far)
        return self.index

    def _built(self) -> Index:
        if self.index is None:
            raise ValueError("build or load an index first")
        return self.index

    def read_kmers(self, reads: DataFrame) -> DataFrame:
        return kmers(reads, self.params.k, self.params.step).where("not contains(kmer, 'N')")

    def on_paths(self, reads: DataFrame) -> DataFrame:
        return seeds.on_paths(self._built().path_kmers, self.read_kmers(reads), self.params.k, self.params.occurrence_limit)

    def off_paths(self, reads: DataFrame) -> DataFrame:
        return seeds.off_paths(self._built().loci, self.nodes, self.edges, self.read_kmers(reads), self.params.k)

    def seeds(self, reads: DataFrame) -> DataFrame:
        return seeds.all_seeds(self.on_paths(reads), self.off_paths(reads), self.params.distinct)

    def verify_distances(self, pairs: DataFrame) -> DataFrame:
        i = self._built()
        if i.distances is None:
            raise ValueError("the index has no distances")
        return distance.verify(pairs, i.distances, self.params.dmin, self.params.dmax or self.params.dmin)

    def stats(self) -> DataFrame:
        """n_paths, n_bases, context, n_uncovered, n_start_nodes, n_loci of the index."""
        i = self._built()
        spark = self.nodes.sparkSession
        texts = paths.length(paths.step_starts(i.path_steps, self.nodes, i.ends)).agg(F.count("*"), F.coalesce(F.sum("n_bases"), F.lit(0))).first()
        bare = i.loci.agg(F.count("*"), F.countDistinct("node_id")).first()
        every = self.nodes.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
        return spark.createDataFrame([(texts[0], texts[1], self.params.flank, bare[0], bare[1], every)], "n_paths long, n_bases long, context int, n_uncovered long, n_start_nodes long, n_loci long")
