"""A small graph of five two-way sites (fixed values), and brute-force versions of graph queries."""

from __future__ import annotations

# Node texts by id from 1 on, and edges.
TEXTS = ["CAAATAAG", "A", "G", "T", "C", "TTG", "A", "G", "AAATTTTCTGGAGTTCTAT", "A", "T", "ATAT", "A", "T", "CCAACTCTCTG"]
EDGES = [(1, 2), (1, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 6), (5, 6), (6, 7), (6, 8), (7, 9), (8, 9), (9, 10), (9, 11), (10, 12), (11, 12), (12, 13), (12, 14), (13, 15), (14, 15)]
# Loci pairs with and without a walk of 8 to 12 bases between them.
NEAR = [(1, 0, 2, 0), (1, 0, 6, 0), (1, 0, 6, 2), (9, 0, 9, 8), (9, 1, 9, 13), (9, 10, 9, 18), (9, 6, 9, 18), (9, 18, 15, 1), (9, 18, 15, 5)]
FAR = [(1, 0, 1, 0), (1, 0, 1, 1), (1, 0, 1, 3), (1, 0, 1, 6), (1, 0, 1, 7), (1, 0, 7, 0), (2, 0, 9, 10), (9, 1, 9, 14), (9, 5, 9, 18), (9, 18, 11, 0), (9, 18, 11, 3), (9, 18, 15, 0), (9, 18, 15, 6)]


def nodes(spark):
    rows = [(i, i, 1, len(s), s) for i, s in enumerate(TEXTS, 1)]
    return spark.createDataFrame(rows, "node_id long, rank long, comp long, len int, seq string")


def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def walks(k: int):
    """Every k-walk: (node, offset, text, nodes)."""
    after: dict[int, list[int]] = {}
    for a, b in EDGES:
        after.setdefault(a, []).append(b)

    def go(node, at, text, path):
        text += TEXTS[node - 1][at:]
        path = [*path, node]
        if len(text) >= k:
            yield text[:k], path
        else:
            for n in after.get(node, []):
                yield from go(n, 0, text, path)

    return [(n, o, t, p) for n in range(1, len(TEXTS) + 1) for o in range(len(TEXTS[n - 1])) for t, p in go(n, o, "", [])]
