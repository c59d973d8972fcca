"""Picking haplotype paths that cover many different walks.

Picking is sequential within a component: every walk is steered by those before. So a component is the unit of
parallelism (one group of applyInPandas), and only its links and node lengths, not its text, go to the task.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalar import hashed_index
from graphloom.operators.graph import union
from graphloom.staging import staged

OUT = "comp long, path_no int, pos int, node_id long, head int, tail int"


class Picker:
    """Walks of one component: succ by node (in edge order), size by node; node ids are topological ranks."""

    def __init__(self, succ: dict[int, list[int]], size: dict[int, int], start: int, seed: int = 0) -> None:
        self.succ, self.size, self.start, self.seed = succ, size, start, seed
        self.done: list[tuple[list[int], dict[int, int]]] = []  # walks so far, with the position of each node
        self.draws = 0

    def holds(self, walk: list[int], run: list[int]) -> bool:
        """Whether a walk passes the run's nodes one after the other."""
        nodes, at = walk
        i = at.get(run[0])
        return i is not None and nodes[i : i + len(run)] == run

    def seen(self, run: list[int]) -> bool:
        return any(self.holds(w, run) for w in self.done)

    def coverage(self, run: list[int]) -> int:
        return sum(self.holds(w, run) for w in self.done)

    def draw(self, options: list[int]) -> int:
        self.draws += 1
        h = hashlib.md5(f"{self.seed}:{self.start}:{self.draws}".encode()).digest()
        return options[int.from_bytes(h[:4], "big") % len(options)]

    def choose(self, node: int, recent: list[int]) -> int:
        """The next node of a walk: the first one on the first walk; later one that makes the recent nodes a new run,
        else the one whose run is on the fewest walks, else any."""
        options = self.succ[node]
        past = len(self.done)
        if past == 0 or len(options) == 1:
            return options[0]
        probes = [[]] if past == 1 else [recent]
        if past == 1:
            probes.append([node])
        for lead in probes:
            for to in options:
                if not self.seen([*lead, to]):
                    return to
        cover = [self.coverage([*recent, to]) for to in options] if past > 1 and recent else [0]
        if min(cover) < max(cover):
            return options[cover.index(min(cover))]
        return self.draw(options)

    def walk(self, bases: int = 0) -> list[int]:
        """A walk from the start to a sink. bases: remember that many bases, instead of a number of choices that grows
        with the walks so far."""
        nodes, node, recent, choices = [self.start], self.start, [self.start], max(1, len(self.succ.get(self.start, [])))
        while self.succ.get(node):
            if bases:
                while len(recent) > 1 and sum(self.size[x] for x in recent[1:]) >= bases:
                    recent.pop(0)
            else:
                while recent and choices > max(1, len(self.done)):
                    choices //= max(1, len(self.succ.get(recent.pop(0), [])))
            node = self.choose(node, recent)
            nodes.append(node)
            recent.append(node)
            choices *= max(1, len(self.succ.get(node, [])))
        return nodes

    def random_walk(self) -> list[int]:
        nodes = [self.start]
        while self.succ.get(nodes[-1]):
            nodes.append(self.draw(self.succ[nodes[-1]]))
        return nodes

    def keep(self, walk: list[int]) -> None:
        self.done.append((walk, {n: i for i, n in enumerate(walk)}))

    def patches(self, walk: list[int], context: int) -> list[tuple[list[int], int, int]]:
        """The parts of a walk (nodes, used bases of the first and last node) whose windows of `context` bases lie on no
        earlier walk. Windows that overlap or touch make one patch; ends reach over the window's last base only."""
        start, at = [], 0
        for n in walk:
            start.append(at)
            at += self.size[n]
        spans: list[list[int]] = []
        i = 0
        for b in range(max(0, at - context) + 1):
            while start[i] + self.size[walk[i]] <= b:
                i += 1
            e, j = min(b + context, at), i
            while start[j] + self.size[walk[j]] < e:
                j += 1
            if not self.seen(walk[i : j + 1]):
                if spans and b <= spans[-1][1]:
                    spans[-1][1] = e
                else:
                    spans.append([b, e])
        out = []
        for b, e in spans:
            i = max(k for k in range(len(walk)) if start[k] <= b)
            j = max(k for k in range(len(walk)) if start[k] < e)
            head, tail = start[i] + self.size[walk[i]] - b, e - start[j]
            out.append((walk[i : j + 1], head if head < self.size[walk[i]] else 0, tail if tail < self.size[walk[j]] else 0))
        return out


def _pick(pdf: pd.DataFrame, paths: int, how: str, context: int, tries: int, seed: int) -> pd.DataFrame:
    first = pdf.dropna(subset=["len"])
    size = dict(zip(first["node_id"].astype(int), first["len"].astype(int), strict=True))
    start = int(first.loc[first["rank"].idxmin(), "node_id"])
    links = pdf.dropna(subset=["dst"]).sort_values(["node_id", "dst"])
    succ = {int(a): [int(x) for x in g] for a, g in links.groupby("node_id")["dst"]}
    p = Picker(succ, size, start, seed)
    comp, rows, no = int(pdf["comp"].iloc[0]), [], 0

    def add(nodes: list[int], head: int = 0, tail: int = 0) -> None:
        nonlocal no
        rows.extend((comp, no, i, n, head, tail) for i, n in enumerate(nodes))
        no += 1

    for _ in range(paths):
        w = p.random_walk() if how == "random" else p.walk(context if how == "local" else 0)
        for _ in range(tries):
            if not p.seen(w):
                break
            w = p.random_walk() if how == "random" else p.walk(context if how == "local" else 0)
        if how == "patched" and p.done:
            for nodes, head, tail in p.patches(w, context):
                add(nodes, head, tail)
        else:
            add(w)
        p.keep(w)
    return pd.DataFrame(rows, columns=["comp", "path_no", "pos", "node_id", "head", "tail"])


def pick_paths(nodes: DataFrame, edges: DataFrame, paths: int, how: str = "full", context: int = 0, tries: int = 0, seed: int = 0) -> DataFrame:
    """comp, path_no, pos, node_id, head, tail: `paths` haplotypes for each component.

    how: full (whole walks), patched (the first whole, then only what is new), local (the memory is `context` bases) or
    random. patched and local need a context. No paths: no rows. tries: how often a walk that is already known is drawn
    again.
    """
    if how not in ("full", "patched", "local", "random"):
        raise ValueError(f"unknown way {how}")
    if how in ("patched", "local") and context < 1:
        raise ValueError("this way needs a context")
    if paths == 0:
        return nodes.select("comp", F.lit(0).alias("path_no"), F.lit(0).alias("pos"), "node_id", F.lit(0).alias("head"), F.lit(0).alias("tail")).limit(0)
    own = nodes.select("comp", "node_id", "rank", F.length("seq").alias("len"), F.lit(None).cast("long").alias("dst"))
    links = edges.join(nodes.select(F.col("node_id").alias("src"), "comp"), "src").select("comp", F.col("src").alias("node_id"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("int").alias("len"), "dst")
    return own.union(links).groupBy("comp").applyInPandas(lambda pdf: _pick(pdf, paths, how, context, tries, seed), OUT)


def as_steps(picked: DataFrame, most: int = 1_000_000) -> DataFrame:
    """path_id, pos, node_id of picked paths; path_id = comp * most + path_no."""
    return picked.select((F.col("comp") * most + F.col("path_no")).alias("path_id"), "pos", "node_id")


def as_ends(picked: DataFrame, most: int = 1_000_000) -> DataFrame:
    return picked.select((F.col("comp") * most + F.col("path_no")).alias("path_id"), "head", "tail").distinct()


def random_haplotypes(starts: DataFrame, edges: DataFrame, ploidy: int, seed: int = 0) -> DataFrame:
    """name, comp, hap, pos, node_id: random walks, all components and haplotypes in step.

    starts: comp, name, node_id. The next node is the hash of (seed, comp, hap, position) modulo the out-degree, in the
    order of node ids, so any engine with md5 gets the same walks. All walks advance together, one join for each step.
    """
    out = edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("next"))
    front = starts.select("name", "comp", F.explode(F.sequence(F.lit(0), F.lit(ploidy - 1))).alias("hap"), F.lit(0).alias("pos"), "node_id")
    parts: list[DataFrame] = []
    while True:
        front = staged(front, "haplotypes")
        if front.isEmpty():
            break
        parts.append(front)
        grown = front.join(out, front.node_id == out.src)
        i = hashed_index(F.size("next"), "comp", "hap", "pos", seed=seed)
        front = grown.select("name", "comp", "hap", (F.col("pos") + 1).alias("pos"), F.get("next", i).alias("node_id"))
        if len(parts) % 64 == 0:  # bound the number of tables
            parts = [staged(union(parts), "haplotypes")]
    return union(parts) if parts else front


def ordered(picked: DataFrame) -> DataFrame:
    """Picked paths with the successor of each step."""
    return picked.withColumn("next_id", F.lead("node_id").over(W.partitionBy("comp", "path_no").orderBy("pos")))


