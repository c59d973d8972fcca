"""Near-duplicate vectors by a dual traversal of cover trees.

Cosine at least s means a distance of at most r = sqrt(2 - 2 s) between the unit vectors. The top level of the trees is
a net of pivots chosen from a bounded sample; every vector goes to the nearest pivot of its label. Two cells are
compared only if their pivots are no further apart than r and both covering radii. Large cells are dealt into parts of
bounded size, and every pair of parts is one task unit with two cover trees: nested levels whose radii halve. A unit
walks both trees together, level by level: a node pair is dropped when its centres are further apart than r and both
covering radii, accepted as a whole when even its furthest members are within r, and else opened; at the last level the
cosines are taken in double precision. Units return a count and one link per vector, not pairs.

Equal vectors of a label are one weighted vector. Vectors of different labels or lengths are never compared.

Defined cases. A vector that is null, empty, zero, or holds null or non-finite components, and one with a null label or
id, links with nothing. Repeated rows of a vector are one vector; the result has a row for each. An empty table gives an
empty result. Only the id, the vector and the label are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, per_batch, staged

SLACK = 1e-9


class Tree:
    """Levels of nodes. centre, radius and parent by level; leaf[i] is the last-level node of point i.

    Every level is a net of its scale within the nodes above: a node's first point is its centre and takes what lies
    within the scale. The distances of the part's points are taken by one product, so a centre costs one look at a row.
    """

    def __init__(self, x: np.ndarray, least: float) -> None:
        self.x = x
        far = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
        self.centre, self.radius, self.parent = [], [], []
        node = np.zeros(len(x), np.int64)
        scale = 2.0
        self._level(node, np.zeros(1, np.int64), np.zeros(1, np.int64), far)
        while scale > least and len(self.centre[-1]) < len(x):
            scale /= 2
            near = far <= scale
            new, centres, parents = np.full(len(x), -1, np.int64), [], []
            alone = near.sum(1) == 1  # they are nodes of their own, whatever the order
            order = np.argsort(node, kind="stable")
            for p, own in enumerate(np.split(order, np.searchsorted(node[order], np.arange(1, len(self.centre[-1]))))):
                single = own[alone[own]]
                new[single] = len(centres) + np.arange(len(single))
                centres += single.tolist()
                parents += [p] * len(single)
                own = own[~alone[own]]
                while len(own):
                    c = own[0]
                    taken = near[c, own]
                    taken[0] = True
                    new[own[taken]] = len(centres)
                    centres.append(c)
                    parents.append(p)
                    own = own[~taken]
            node = new
            self._level(node, np.array(centres), np.array(parents), far)
        self.leaf = node
        order = np.argsort(node, kind="stable")
        self.members = np.split(order, np.searchsorted(node[order], np.arange(1, len(self.centre[-1]))))

    def _level(self, node: np.ndarray, centre: np.ndarray, parent: np.ndarray, far: np.ndarray) -> None:
        radius = np.zeros(len(centre))
        np.maximum.at(radius, node, far[np.arange(len(node)), centre[node]])
        self.centre.append(centre)
        self.radius.append(radius)
        self.parent.append(parent)

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level k, or the last one standing for all further ones."""
        if k < len(self.centre):
            return self.centre[k], self.radius[k], self.parent[k]
        n = len(self.centre[-1])
        return self.centre[-1], self.radius[-1], np.arange(n)


def dual(a: Tree, b: Tree, raw_a: np.ndarray, raw_b: np.ndarray, w_a: np.ndarray, w_b: np.ndarray, cosine: float, same: bool):
    """Weighted link counts of both sides, and linked index pairs that span each side's links."""
    r = np.sqrt(2 - 2 * cosine)
    count_a, count_b = np.zeros(len(w_a), np.int64), np.zeros(len(w_b), np.int64)
    norm_a, norm_b = (np.sqrt((v * v).sum(1)) for v in (raw_a, raw_b))
    left, right = [], []
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)  # the node pairs that are still open
    for k in range(max(len(a.centre), len(b.centre))):
        (ca, ra, pa_), (cb, rb, pb) = a.level(k), b.level(k)
        if k:
            i, j = _opened(i, j, pa_, pb)
        d = _distances(a.x[ca], b.x[cb], i, j)
        reach = ra[i] + rb[j]
        near = d - reach <= r + 1e-6
        if same:
            near &= i <= j
        i, j, whole = i[near], j[near], (d + reach <= r - 1e-6)[near]
    for p, q, every in zip(i.tolist(), j.tolist(), whole.tolist(), strict=True):
        m, n = a.members[p], b.members[q]
        own = same and p == q
        if every:
            count_a[m] += w_b[n].sum() - (w_a[m] if own else 0)
            if not own:
                count_b[n] += w_a[m].sum()
            left += [m, np.full(len(n), m[0])]
            right += [np.full(len(m), n[0]), n]
            continue
        if own and len(m) == 1:
            continue
        linked = (raw_a[m] @ raw_b[n].T) / (norm_a[m][:, None] * norm_b[n][None, :]) >= cosine
        if own:
            linked = np.triu(linked, 1)
        x, y = np.nonzero(linked)
        np.add.at(count_a, m[x], w_b[n[y]])
        np.add.at(count_b, n[y], w_a[m[x]])
        left.append(m[x])
        right.append(n[y])
    none = np.zeros(0, np.int64)
    return count_a, count_b, np.concatenate([none, *left]), np.concatenate([none, *right])


def _opened(i: np.ndarray, j: np.ndarray, parent_a: np.ndarray, parent_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of the open node pairs. Children of a node are adjacent."""
    (start_a, size_a), (start_b, size_b) = ((np.searchsorted(p, x), np.searchsorted(p, x, "right") - np.searchsorted(p, x)) for p, x in ((parent_a, i), (parent_b, j)))
    n = size_a * size_b
    pair = np.repeat(np.arange(len(i)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return start_a[pair] + at // size_b[pair], start_b[pair] + at % size_b[pair]


def _distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j) of unit vectors: one product where most pairs are open, else pair by pair."""
    if 16 * len(i) > len(x) * len(y):
        dot = (x @ y.T)[i, j]
    else:
        dot = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536))])
    return np.sqrt(np.maximum(0, 2 - 2 * dot))


def _unit(table: pa.Table, cosine: float) -> pa.Table:
    ids, w, side = (table[c].to_numpy() for c in ("rep", "w", "side"))
    raw = np.array(table["v"].combine_chunks().values.to_numpy(), np.float64).reshape(len(ids), -1)
    raw /= np.abs(raw).max(1, keepdims=True)  # so that squares of large and small components stay finite
    x = raw / np.sqrt((raw * raw).sum(1, keepdims=True))
    parts = [np.flatnonzero(side == s) for s in (0, 1)]
    same = table["a"][0].as_py() == table["b"][0].as_py()
    if same:
        parts[1] = parts[0]
    count = np.zeros(len(ids), np.int64)
    lab = np.arange(len(ids))
    if all(map(len, parts)):
        least = np.sqrt(2 - 2 * cosine) / 2
        trees = [Tree(x[p], least) for p in parts[:1]]
        trees.append(trees[0] if same else Tree(x[parts[1]], least))
        ca, cb, p, q = dual(trees[0], trees[1], raw[parts[0]], raw[parts[1]], w[parts[0]], w[parts[1]], cosine, same)
        np.add.at(count, parts[0], ca)
        np.add.at(count, parts[1], cb)
        p, q = parts[0][p], parts[1][q]
        by_id = np.argsort(ids)  # labels are ranks of ids, so the least id of a component wins
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        lab = rank.copy()
        while len(p):
            before = lab.copy()
            np.minimum.at(lab, p, lab[q])
            np.minimum.at(lab, q, lab[p])
            lab = np.minimum(lab, lab[by_id[lab]])
            if (lab == before).all():
                break
        lab = by_id[lab]
    hit = np.flatnonzero(count > 0)
    return pa.table({"rep": pa.array(ids[hit]), "links": pa.array(count[hit]), "root": pa.array(ids[lab[hit]])})


def _unit_vector(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _net(sample: list, most: int) -> dict:
    """Per (label, length): pivots, farthest first, as unit vectors."""
    rows: dict = {}
    for r in sample:
        v = np.array(r["v"], np.float64)
        rows.setdefault((r["label"], len(v)), []).append(_unit_vector(v))
    nets = {}
    for key, vectors in rows.items():
        x = np.array(vectors)
        d, picked = np.full(len(x), np.inf), [0]
        while len(picked) < min(most, len(x) // 8 + 1):
            d = np.minimum(d, np.sqrt(((x - x[picked[-1]]) ** 2).sum(1)))
            picked.append(int(d.argmax()))
        nets[key] = x[picked]
    return nets


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", part: int = 1500, sample: int = 4096, pivots: int = 32) -> DataFrame:
    """id, n_links, component_id and kept, for every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    finite = "forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(v, c -> c <> 0)"
    usable = rows.where(f"id is not null and label is not null and v is not null and size(v) > 0 and {finite}")
    reps = usable.distinct().groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("w"))
    reps = staged(reps, "vectors")
    picked = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("label", "v").collect()
    nets = spark.sparkContext.broadcast(_net(picked, pivots))

    def assign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        labels, v = batch.column(0).to_pylist(), batch.column(1)
        cell, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for row, label in enumerate(labels):
            x = np.array(v[row].values.to_numpy(zero_copy_only=False), np.float64)
            net = nets.value.get((label, len(x)))
            if net is not None:
                d = np.sqrt(((net - _unit_vector(x)) ** 2).sum(1))
                cell[row], far[row] = d.argmin(), d.min()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], ["label", "v", "rep", "w", "cell", "far"])

    celled = reps.select("label", "v", "rep", "w").mapInArrow(per_batch(assign), f"label {label_kind}, v {rows.schema['v'].dataType.simpleString()}, rep {kind}, w long, cell long, far double")
    celled = staged(celled.withColumn("dim", F.size("v")), "cells")
    cells = celled.groupBy("label", "dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    first = {(k, d): [(i, c) for i, c in enumerate(net)] for (k, d), net in nets.value.items()}
    r = np.sqrt(2 - 2 * cosine)
    known = [tuple(x) for x in cells.where("radius > 0").select("label", "dim", "cell", "radius").collect()]  # no more cells than pivots
    radius = {(k, d, c): f for k, d, c, f in known}
    near = [
        (k, d, i, j)
        for (k, d), net in first.items()
        for i, p in net
        for j, q in net
        if i < j and np.sqrt(((p - q) ** 2).sum()) <= r + radius.get((k, d, i), 0.0) + radius.get((k, d, j), 0.0) + SLACK
    ]
    cell_pairs = spark.createDataFrame(near, f"label {label_kind}, dim int, c1 long, c2 long")
    own = cells.select("label", "dim", F.col("cell").alias("c1"), F.col("cell").alias("c2"), F.col("parts").alias("n1"), F.col("parts").alias("n2"))
    two = cells.select("label", "dim", F.col("cell").alias("c1"), F.col("parts").alias("n1"))
    other = cells.select("label", "dim", F.col("cell").alias("c2"), F.col("parts").alias("n2"))
    units = own.unionByName(cell_pairs.join(two, ["label", "dim", "c1"]).join(other, ["label", "dim", "c2"]).select(own.columns))
    units = units.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    units = units.where("c1 <> c2 or i <= j").select("label", "dim", F.concat_ws(":", "c1", "i").alias("a"), F.concat_ws(":", "c2", "j").alias("b"))
    units = staged(units, "units")
    sides = units.select("label", "dim", F.col("a").alias("at"), F.lit(0).alias("side"), "a", "b").union(units.where("a <> b").select("label", "dim", "b", F.lit(1), "a", "b"))
    placed = celled.join(cells.select("label", "dim", "cell", "parts"), ["label", "dim", "cell"])
    placed = placed.withColumn("at", F.concat_ws(":", "cell", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("string"))).select("label", "dim", "at", "v", "rep", "w")
    dealt = placed.join(sides, ["label", "dim", "at"]).select("label", "dim", "a", "b", "side", "v", "rep", "w")
    found = dealt.groupBy("label", "dim", "a", "b").applyInArrow(lambda t: _unit(t, cosine), f"rep {kind}, links long, root {kind}")
    found = staged(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("rep <> root").select("rep", "root")
    label = components(edges, "rep", "root")
    done = reps.join(links, "rep", "left").join(label, reps.rep == label.node, "left")
    done = done.select("label", "v", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    marked = usable.join(done, ["label", "v"]).select("id", "n", "c").groupBy("id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = rows.select("id").join(marked.withColumnRenamed("id", "mid"), F.col("id") == F.col("mid"), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
