"""DuckDB SQL for the registered queries."""

from __future__ import annotations

K, DMIN, DMAX = 8, 6, 10


def _dna(mark: str, key: str) -> str:
    return f"translate(md5(concat('{mark}', CAST({key} AS VARCHAR))), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _draw(n: str, *key: str, seed: int = 0) -> str:
    text = "concat_ws(':', " + ", ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in key)]) + ")"
    return f"CAST(floor(CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0 * ({n})) AS INTEGER)"


BASE = f"""
nodes AS (SELECT p_partkey + 1 AS node_id, CAST(floor(p_partkey / 50) AS BIGINT) AS comp,
  substr({_dna("n", "p_partkey")}, 1, CAST(1 + p_partkey % 8 AS INTEGER)) AS seq FROM part),
edges AS (SELECT a.node_id AS src, b.node_id AS dst FROM nodes a JOIN nodes b ON a.comp = b.comp AND b.node_id IN (a.node_id + 1, a.node_id + 2)),
reads AS (SELECT c_custkey AS read_id, {_dna("r", "c_custkey")} AS seq FROM customer),
path_steps AS (SELECT comp * 2 + 1 AS path_id, (node_id - 1) % 50 AS pos, node_id FROM nodes
  UNION ALL SELECT comp * 2, (node_id - 1) % 50 // 2, node_id FROM nodes WHERE (node_id - 1) % 50 % 2 = 0),
starts AS (SELECT path_id, pos, s.node_id, length(seq) AS size,
  coalesce(sum(length(seq)) OVER (PARTITION BY path_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start
  FROM path_steps s JOIN nodes n ON n.node_id = s.node_id),
texts AS (SELECT path_id, string_agg(seq, '' ORDER BY pos) AS text FROM path_steps s JOIN nodes n ON n.node_id = s.node_id GROUP BY path_id),
position_map AS (SELECT path_id, start + i AS text_pos, node_id, i AS node_offset FROM starts, unnest(range(size::BIGINT)) t(i)),
path_kmers AS (SELECT substr(text, t.i::INTEGER + 1, {K}) AS kmer, x.path_id, t.i AS text_pos, node_id, node_offset
  FROM texts x, unnest(range(length(text) - {K} + 1)) t(i) JOIN position_map m ON m.path_id = x.path_id AND m.text_pos = t.i),
read_kmers AS (SELECT read_id, t.i AS read_offset, substr(seq, t.i::INTEGER + 1, {K}) AS kmer FROM reads, unnest(range(0, length(seq) - {K} + 1, {K})) t(i)),
on_paths AS (SELECT node_id, node_offset, read_id, read_offset, {K} AS match_len, count(*) OVER (PARTITION BY p.kmer, read_id, read_offset) AS gocc
  FROM path_kmers p JOIN read_kmers r ON p.kmer = r.kmer)"""

WALKS = f"""
walks AS (
  SELECT node_id, o AS node_offset, node_id AS cur, substr(seq, o::INTEGER + 1, {K}) AS text, concat(',', node_id, ',') AS ids FROM nodes, unnest(range(length(seq))) t(o)
  UNION ALL
  SELECT w.node_id, w.node_offset, e.dst, w.text || substr(n.seq, 1, {K} - length(w.text)), concat(w.ids, e.dst, ',')
  FROM walks w JOIN edges e ON e.src = w.cur JOIN nodes n ON n.node_id = e.dst WHERE length(w.text) < {K}),
kwalks AS (SELECT node_id, node_offset, text AS kmer, ids FROM walks WHERE length(text) = {K})"""

UNCOVERED = """
path_ids AS (SELECT path_id // 2 AS comp, concat(',', string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos), ',') AS ids FROM path_steps GROUP BY path_id),
bare AS (SELECT k.* FROM kwalks k JOIN nodes n ON n.node_id = k.node_id
  WHERE NOT EXISTS (SELECT 1 FROM path_ids p WHERE p.comp = n.comp AND contains(p.ids, k.ids))),
bare_loci AS (SELECT DISTINCT node_id, node_offset FROM bare),
counted AS (SELECT kmer, count(*) AS gocc FROM read_kmers GROUP BY kmer)"""

OFF = f"""
off_paths AS (SELECT k.node_id, k.node_offset, r.read_id, r.read_offset, {K} AS match_len, c.gocc
  FROM kwalks k JOIN bare_loci b ON b.node_id = k.node_id AND b.node_offset = k.node_offset JOIN read_kmers r ON r.kmer = k.kmer JOIN counted c ON c.kmer = k.kmer)"""


def _pairs(name: str, dmin: int, dmax: int) -> str:
    return f"""
gaps_{name} AS (SELECT src, dst, 0 AS gap FROM edges UNION
  SELECT g.src, e.dst, g.gap + length(n.seq) FROM gaps_{name} g JOIN nodes n ON n.node_id = g.dst JOIN edges e ON e.src = g.dst WHERE g.gap + length(n.seq) <= {dmax}),
{name} AS (SELECT DISTINCT g.src AS v, o, g.dst AS u, p FROM gaps_{name} g JOIN nodes a ON a.node_id = g.src JOIN nodes b ON b.node_id = g.dst,
    unnest(range(length(a.seq))) s(o), unnest(range(length(b.seq))) t(p) WHERE length(a.seq) - o + gap + p BETWEEN {dmin} AND {dmax}
  UNION SELECT node_id, o, node_id, p FROM nodes, unnest(range(length(seq))) s(o), unnest(range(length(seq))) t(p) WHERE p - o BETWEEN {dmin} AND {dmax})"""


FIRST = "first AS (SELECT node_id, coalesce(sum(length(seq)) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM nodes)"
CELLS = f"{FIRST}, cells AS (SELECT a.f + o AS row, b.f + p AS col FROM pairs JOIN first a ON a.node_id = v JOIN first b ON b.node_id = u)"
RANGES = "ranges AS (SELECT row, min(col) AS col_lo, max(col) AS col_hi FROM (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS g FROM cells) GROUP BY row, g)"

GAF = """
gaf0 AS (SELECT o_orderkey AS line, floor(o_orderkey / 2)::BIGINT AS read, o_orderkey % 150 + 1 AS node FROM orders),
gaf AS (SELECT line, concat('q', floor(read * 3 / 4)::BIGINT) AS name, (line % 2)::INTEGER AS mate, line % 7 <> 0 AS fwd, node, line % 3 AS p_start,
  CASE WHEN line % 11 = 0 THEN 0 ELSE 32 END AS block, 1 - (line % 25) / 100.0 AS identity, concat('q', floor(read * 3 / 4)::BIGINT, CASE line % 2 WHEN 0 THEN '/1' ELSE '/2' END) AS full_name,
  CASE WHEN line % 10 = 9 THEN concat('q', floor(read * 3 / 4)::BIGINT, '/1') WHEN line % 2 = 1 OR line % 13 = 0 THEN '' WHEN line % 26 = 2 THEN 'other' ELSE concat('q', floor(read * 3 / 4)::BIGINT, '/2') END AS fn,
  CASE WHEN line % 2 = 0 OR line % 10 = 9 THEN '' WHEN line % 34 = 1 THEN 'other' ELSE concat('q', floor(read * 3 / 4)::BIGINT, '/1') END AS fp FROM gaf0),
gaf_runs AS (SELECT *, line - row_number() OVER (PARTITION BY name ORDER BY line) AS run FROM gaf),
gaf_mates AS (SELECT *, row_number() OVER w AS i, lead(line) OVER w AS line2 FROM gaf_runs WINDOW w AS (PARTITION BY name, run ORDER BY line)),
gaf_pairs AS (SELECT line AS line1, line2 FROM gaf_mates WHERE i % 2 = 1 AND line2 IS NOT NULL),
gaf_seq AS (SELECT line, full_name AS n, block <> 0 AS ok, block <> 0 AND identity >= 0.9 AS hi, fn, fp, block <> 0 AND fn <> '' AS starts, row_number() OVER (ORDER BY line) AS i FROM gaf),
-- in a run of records that could wait every other one does, the first among them
gaf_isles AS (SELECT *, i - row_number() OVER (PARTITION BY starts ORDER BY i) AS isle FROM gaf_seq),
gaf_waits AS (SELECT *, starts AND row_number() OVER (PARTITION BY starts, isle ORDER BY i) % 2 = 1 AS waits FROM gaf_isles),
gaf_steps AS (SELECT a.n, a.ok, a.hi, a.waits, w.n AS wn, coalesce(w.hi, false) AS whi, w.i IS NOT NULL AS waited, w.i IS NOT NULL AND a.ok AND a.n = w.fn AND a.fp = w.n AS met FROM gaf_waits a LEFT JOIN gaf_waits w ON w.i = a.i - 1 AND w.waits),
gaf_parts AS (
  SELECT n AS name, met::INTEGER AS paired, (ok AND NOT met AND NOT waits)::INTEGER AS single, (NOT ok)::INTEGER AS invalid, (met AND hi AND whi)::INTEGER AS hp, ((met AND hi <> whi) OR (hi AND NOT met AND NOT waits))::INTEGER AS hs FROM gaf_steps
  UNION ALL SELECT wn, 0, 1, 0, 0, whi::INTEGER FROM gaf_steps WHERE waited AND NOT met),
per_read AS (SELECT name, sum(paired)::BIGINT AS paired, sum(single)::BIGINT AS single, sum(invalid)::BIGINT AS invalid, sum(hp)::BIGINT AS hi_paired, sum(hs)::BIGINT AS hi_single FROM gaf_parts GROUP BY 1),
classed AS (SELECT *, CASE WHEN hi_paired = 1 THEN 'NHUP' WHEN hi_paired <> 0 THEN 'NHMP' WHEN paired = 1 THEN 'NLUP' WHEN paired <> 0 THEN 'NLMP' WHEN hi_single = 1 THEN 'NHUS' WHEN hi_single = 2 THEN 'NHDS'
  WHEN hi_single <> 0 THEN 'NHMS' WHEN single = 1 THEN 'NLUS' WHEN single = 2 THEN 'NLDS' WHEN single <> 0 THEN 'NLMS' END AS class FROM per_read)"""


TRUTH = """
loci AS (SELECT full_name, list({'f': fwd OR odd, 'n': CASE WHEN odd THEN 1 ELSE node END, 'o': CASE WHEN line % 3 = 2 THEN 0 ELSE p_start END} ORDER BY line) AS t
  FROM (SELECT *, substr(name, 2)::BIGINT % 2 = 1 AS odd FROM gaf WHERE block <> 0) GROUP BY full_name),
firsts AS (SELECT full_name, p_start, block, t, (SELECT min(k) FROM range(1, 9) r(k) WHERE k <= len(t) AND t[k].f = fwd AND t[k].n = node) AS k FROM gaf LEFT JOIN loci USING (full_name)),
flags AS (SELECT full_name AS name, bit_or(CASE WHEN block = 0 OR k IS NULL THEN 0 WHEN t[k].o = p_start THEN 3 * power(4, k - 1)::INTEGER ELSE 2 * power(4, k - 1)::INTEGER END) AS flag FROM firsts GROUP BY 1)"""


def _with(*parts: str, then: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {then}"


def _base(then: str, *more: str) -> str:
    return _with(BASE, *more, then=then)


def _hap(columns: str, length: int, n: int) -> str:
    at = _draw(f"length(text) - {length} + 1", "hap_id", "i", "0")
    return f"""sim AS (SELECT hap_id, i, text, {at} AS pos FROM (SELECT path_id AS hap_id, text FROM texts) x, unnest(range({n})) t(i)),
raw AS (SELECT hap_id, i, pos, CASE WHEN i % 2 = 0 THEN 'F' ELSE 'R' END AS strand, substr(text, pos + 1, {length}) AS fragment FROM sim) SELECT {columns} FROM raw"""


_REV = "reverse(translate({0}, 'ACGTN', 'TGCAN'))"
_ON = "SELECT node_id, node_offset, read_id, read_offset, match_len, gocc FROM on_paths"

SQL: dict[str, str] = {
    "node_charorder": _base("SELECT node_id, f AS first FROM first", FIRST),
    "topo_check": _base("SELECT count(*) AS n_edges, count(*) FILTER (src >= dst) AS n_backward FROM edges"),
    "weak_components": _base("SELECT node_id, comp * 50 + 1 AS comp FROM nodes"),
    "component_ranks": _base("SELECT path_id, min(node_id) AS first_rank FROM path_steps GROUP BY path_id"),
    "bfs_levels": _with(
        BASE,
        "reach AS (SELECT min(node_id) AS node_id, 0 AS level FROM nodes GROUP BY comp UNION SELECT e.dst, level + 1 FROM reach r JOIN edges e ON e.src = r.node_id WHERE level < 60)",
        then="SELECT node_id, min(level) AS level FROM reach GROUP BY node_id",
    ),
    "induced_graph": _base("SELECT DISTINCT src, dst FROM (SELECT node_id AS src, lead(node_id) OVER (PARTITION BY path_id ORDER BY pos) AS dst FROM path_steps) WHERE dst IS NOT NULL"),
    "graph_kwalks": _base("SELECT node_id, node_offset, kmer, count(*) AS n_walks FROM kwalks GROUP BY ALL", WALKS),
    "count_kmers": _base("SELECT count(*) AS n_walks FROM kwalks", WALKS),
    "loci_stepped": _base(
        "SELECT node_id, o AS node_offset FROM (SELECT n.node_id, o, f - min(f) OVER (PARTITION BY comp) + o AS place FROM nodes n JOIN first USING (node_id), unnest(range(length(seq))) t(o)) WHERE place % 4 = 0", FIRST
    ),
    "loci_range": _base("SELECT node_id, o AS node_offset FROM nodes, unnest(range(length(seq))) t(o) WHERE node_id BETWEEN 11 AND 40 ORDER BY 1, 2 LIMIT 20"),
    "read_kmers_overlap": _base(f"SELECT read_id, i AS read_offset, substr(seq, i::INTEGER + 1, {K}) AS kmer FROM reads, unnest(range(length(seq) - {K} + 1)) t(i)"),
    "read_kmers_nonoverlap": _base("SELECT read_id, read_offset, kmer FROM read_kmers"),
    "read_kmers_greedy": _base("SELECT read_id, i AS read_offset, substr(seq, i::INTEGER + 1, 7) AS kmer FROM reads, unnest(list_append(range(0, length(seq) - 7, 7), length(seq) - 7)) t(i)"),
    "distinct_kmers": _base("SELECT kmer, count(*) AS n FROM (SELECT substr(seq, i::INTEGER + 1, 5) AS kmer FROM reads, unnest(range(length(seq) - 4)) t(i)) GROUP BY kmer"),
    "revcomp_reads": _base(f"SELECT read_id, {_REV.format('seq')} AS revcomp FROM reads"),
    "scalar_functions": f"""SELECT p_partkey, CASE WHEN p_size < 2 THEN 1 ELSE CAST(power(2, ceil(log2(p_size))) AS BIGINT) END AS power, split_part(p_name, ' ', 1) AS first_word,
      {_draw("10", "p_partkey")} AS draw, p_brand AS brand, starts_with(p_brand, 'Brand#1') AS is_one, CAST(p_partkey AS VARCHAR) AS name FROM part""",
    "path_text": _base("SELECT path_id, text FROM texts"),
    "path_text_reversed": _base("SELECT path_id, reverse(text) AS text FROM texts"),
    "path_text_trimmed": _base(
        """SELECT path_id, string_agg(CASE WHEN pos = 0 THEN right(seq, 1) WHEN pos = last THEN left(seq, 1) ELSE seq END, '' ORDER BY pos) AS text
        FROM (SELECT s.path_id, s.pos, n.seq, max(pos) OVER (PARTITION BY path_id) AS last FROM path_steps s JOIN nodes n ON n.node_id = s.node_id) GROUP BY path_id"""
    ),
    "path_position_map": _base("SELECT path_id, text_pos, node_id, node_offset FROM position_map"),
    "path_locate": _base("SELECT path_id, text_pos, node_id, node_offset FROM position_map WHERE text_pos % 10 = 0"),
    "path_kmers": _base("SELECT kmer, path_id, text_pos, node_id, node_offset FROM path_kmers"),
    "path_coverage": _base("SELECT node_id, count(DISTINCT path_id) AS n_paths FROM path_steps GROUP BY node_id"),
    "path_occurrences": _base(
        "SELECT src * 10 + dst - src AS walk_id, a.path_id, a.pos FROM edges JOIN path_steps a ON a.node_id = src JOIN path_steps b ON b.node_id = dst AND b.path_id = a.path_id AND b.pos = a.pos + 1"
    ),
    "covered_walks": _base(
        "SELECT DISTINCT src * 10 + dst - src AS walk_id FROM edges JOIN path_steps a ON a.node_id = src JOIN path_steps b ON b.node_id = dst AND b.path_id = a.path_id AND b.pos = a.pos + 1"
    ),
    "walk_coverage": _base(
        """SELECT src * 10 + dst - src AS walk_id, (SELECT count(DISTINCT a.path_id) FROM path_steps a JOIN path_steps b ON b.path_id = a.path_id AND b.pos = a.pos + 1 WHERE a.node_id = src AND b.node_id = dst) AS n_paths FROM edges"""
    ),
    "path_contains": _base(
        """SELECT path_id, coalesce(p[x + 1] = f + 4 AND p[x + 2] = f + 6, false) AS run, coalesce(p[2] = f + 1, false) AS gap, coalesce(p[x + 1] = f + 4 AND p[x + 2] = f + 6, false) AS rev, list_contains(p, f + 4) AS any_order,
        coalesce(p[x + 1] = f + 4 AND p[x + 2] = f + 6, false) AS by_rank FROM (SELECT path_id, p, p[1] AS f, list_position(p, p[1] + 2) AS x FROM (SELECT path_id, list(node_id ORDER BY pos) AS p FROM path_steps GROUP BY path_id))"""
    ),
    "path_algebra": _base(
        """SELECT path_id, CASE WHEN x IS NULL THEN len(p) ELSE x - 1 END::INTEGER AS back, CASE WHEN x IS NULL THEN len(p) ELSE len(p) - x END::INTEGER AS front, CASE WHEN x IS NULL THEN len(p) ELSE x END::INTEGER AS back_kept
        FROM (SELECT path_id, p, nullif(list_position(p, p[1] + 9), 0) AS x FROM (SELECT path_id, list(node_id ORDER BY pos) AS p FROM path_steps GROUP BY path_id))"""
    ),
    "path_trim_by_length": _base("SELECT path_id, count(*) AS n_steps FROM starts JOIN texts USING (path_id) WHERE length(text) - start > 20 GROUP BY path_id"),
    "edge_kmers": _base("SELECT path_id, arg_min(node_id, text_pos) AS node_id, arg_min(node_offset, text_pos) AS node_offset FROM path_kmers GROUP BY path_id"),
    "path_mappings": _base("SELECT path_id, pos + 1 AS rank, node_id, size AS n_bases FROM starts"),
    "path_marked": _base("SELECT path_id, count(*) FILTER (size > 1) AS n_marked FROM starts GROUP BY path_id"),
    "induced_nodes": _base("SELECT DISTINCT node_id FROM path_steps"),
    "seeds_on_paths": _base(_ON),
    "seeds_on_paths_limited": _base(_ON + " WHERE gocc <= 1"),
    "seeds_all_loci": _base(
        f"SELECT k.node_id, k.node_offset, r.read_id, r.read_offset, {K} AS match_len, c.gocc FROM kwalks k JOIN read_kmers r ON r.kmer = k.kmer JOIN (SELECT kmer, count(*) AS gocc FROM read_kmers GROUP BY kmer) c ON c.kmer = k.kmer",
        WALKS,
    ),
    "uncovered_loci": _base("SELECT node_id, node_offset FROM bare_loci", WALKS, UNCOVERED),
    "uncovered_kmers": _base("SELECT count(*) AS n_walks, count(DISTINCT node_id) AS n_nodes FROM bare", WALKS, UNCOVERED),
    "seeds_off_paths": _base("SELECT * FROM off_paths", WALKS, UNCOVERED, OFF),
    "seeds_all": _base(f"{_ON.replace('gocc FROM', 'gocc, ' + chr(39) + 'on' + chr(39) + ' AS source FROM')} UNION ALL SELECT *, 'off' FROM off_paths", WALKS, UNCOVERED, OFF),
    "seeds_distinct": _base("SELECT DISTINCT k.node_id, k.node_offset, r.read_id, r.read_offset FROM kwalks k JOIN read_kmers r ON r.kmer = k.kmer", WALKS),
    "hit_totals": _base(
        "SELECT count(*) AS n_hits, count(*) FILTER (off) AS n_off_paths, count(DISTINCT read_id) AS n_reads FROM (SELECT read_id, false AS off FROM on_paths UNION ALL SELECT read_id, true FROM off_paths)", WALKS, UNCOVERED, OFF
    ),
    "read_matches_whole": _base(
        """SELECT m.node_id, m.node_offset, r.read_id, x.path_id, m.text_pos FROM texts x JOIN position_map m ON m.path_id = x.path_id
        JOIN (SELECT read_id, seq FROM reads UNION ALL SELECT -path_id - 1, substr(text, 4, 32) FROM texts WHERE length(text) >= 35) r ON substr(text, m.text_pos::INTEGER + 1, 32) = r.seq"""
    ),
    "prefix_counts": _base("SELECT prefix, count(*) AS n FROM (SELECT substr(text, i::INTEGER + 1, m::INTEGER) AS prefix FROM texts, unnest(range(length(text))) t(i), unnest(range(1, 5)) u(m) WHERE i + m <= length(text)) GROUP BY prefix"),
    "linear_reference_seeds": _base(
        f"""SELECT path_id AS node_id, i AS node_offset, read_id, read_offset, {K} AS match_len, count(*) OVER (PARTITION BY read_id, read_offset) AS gocc FROM texts, unnest(range(length(text) - {K} + 1)) t(i)
        JOIN read_kmers r ON r.kmer = substr(text, i::INTEGER + 1, {K})"""
    ),
    "doc_benchmark_kmers": """WITH a AS (SELECT DISTINCT item_id, array_to_string(w[i::INTEGER : i::INTEGER + 5], ' ') AS kmer FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), unnest(range(1, len(w) - 4)) t(i)),
      b AS (SELECT DISTINCT doc_id, array_to_string(w[i::INTEGER : i::INTEGER + 5], ' ') AS kmer FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents), unnest(range(1, len(w) - 4)) t(i))
      SELECT doc_id, item_id, count(*) AS n FROM a JOIN b USING (kmer) GROUP BY doc_id, item_id""",
    "distance_pairs": _base("SELECT v, o, u, p FROM pairs", _pairs("pairs", DMIN, DMAX)),
    "verify_distance": _base(
        """SELECT v, o, u, p, CASE WHEN u = v THEN p BETWEEN 6 AND 10 ELSE EXISTS (SELECT 1 FROM pairs x WHERE x.v = q.v AND x.o = q.o AND x.u = q.u AND x.p = q.p) END AS ok
        FROM (SELECT node_id AS v, 0::BIGINT AS o, node_id + i AS u, CASE WHEN i = 0 THEN length(seq) - 1 ELSE 0 END AS p FROM nodes, unnest(range(7)) t(i)) q""",
        _pairs("pairs", DMIN, DMAX),
    ),
    "dindex_ranges": _base("SELECT row, col_lo, col_hi FROM ranges", _pairs("pairs", DMIN, DMAX), CELLS, RANGES),
    "dindex_merge": _base("SELECT v, o, u, p FROM p1 UNION SELECT v, o, u, p FROM p2", _pairs("p1", DMIN, 8), _pairs("p2", 8, DMAX)),
    "dindex_compress": _base("SELECT v, o, u, p FROM pairs WHERE v <> u", _pairs("pairs", DMIN, DMAX)),
    "dindex_stats": _base(
        """SELECT n AS n_rows, n AS n_cols, c AS n_cells, r AS n_ranges, round(c / CAST(r AS DOUBLE), 6) AS cells_per_range
        FROM (SELECT (SELECT sum(length(seq))::BIGINT FROM nodes) AS n, (SELECT count(*) FROM cells) AS c, (SELECT count(*) FROM ranges) AS r)""", _pairs("pairs", DMIN, DMAX), CELLS, RANGES
    ),
    "haplotypes_random": _base(
        "SELECT comp, hap, pos, node_id FROM hap",
        f"""succ AS (SELECT src, list(dst ORDER BY dst) AS next FROM edges GROUP BY src),
        hap AS (SELECT comp, h AS hap, 0 AS pos, min(node_id) AS node_id FROM nodes, unnest(range(2)) t(h) GROUP BY comp, h
          UNION ALL SELECT comp, hap, pos + 1, next[{_draw("len(next)", "comp", "hap", "pos")} + 1] FROM hap JOIN succ ON src = node_id)""",
    ),
    "reads_dist": _base(
        """SELECT path_id AS hap_id, coalesce(n + CASE WHEN i <= 1000 - given THEN 1 ELSE 0 END, 0)::BIGINT AS n_reads FROM texts LEFT JOIN
        (SELECT path_id, n, row_number() OVER (ORDER BY path_id) AS i, sum(n) OVER () AS given FROM
          (SELECT path_id, floor(1000 * length(text) / sum(length(text)) OVER ())::BIGINT AS n FROM texts WHERE length(text) >= 40)) USING (path_id)"""
    ),
    "simulated_reads": _base("SELECT hap_id, i, pos, strand, seq FROM sim_out", "sim_out AS (WITH " + _hap(f"hap_id, i, pos, strand, CASE WHEN strand = 'F' THEN fragment ELSE {_REV.format('fragment')} END AS seq", 30, 5) + ")"),
    "simulated_pairs": _base(
        f"SELECT hap_id, i, pos, 1 AS mate, left(fragment, 20) AS seq, repeat('I', 20) AS qual FROM sim_out UNION ALL SELECT hap_id, i, pos, 2, {_REV.format('right(fragment, 20)')}, repeat('I', 20) FROM sim_out",
        "sim_out AS (WITH " + _hap("hap_id, i, pos, fragment", 50, 3) + ")",
    ),
    "gaf_parse": _with(
        GAF,
        then="SELECT line, concat(name, CASE WHEN mate = 0 THEN '/1' ELSE '/2' END) AS q_name, 32::BIGINT AS q_len, true AS q_fwd, p_start, block::BIGINT AS block, node AS first_node, fwd AS first_forward, 2 AS nm, round(CAST(identity AS DOUBLE), 4) AS identity FROM gaf",
    ),
    "source_gfa": _base("SELECT 'S' AS kind, node_id AS a, length(seq)::BIGINT AS b, seq AS text FROM nodes UNION ALL SELECT 'L', src, dst, '' FROM edges UNION ALL SELECT 'P', pos, node_id, CAST(path_id AS VARCHAR) FROM path_steps"),
    "source_fasta": _base("SELECT concat('r', read_id) AS name, seq FROM reads"),
    "source_fastq": _base("SELECT concat('r', read_id) AS name, seq, repeat('I', length(seq)) AS qual FROM reads"),
    "source_gaf": _with(GAF, then="SELECT full_name AS q_name, concat(CASE WHEN fwd THEN '>' ELSE '<' END, node, '>', node + 1) AS path, p_start, block::BIGINT AS block, count(*) AS n FROM gaf GROUP BY ALL"),
    "source_loci": _base("SELECT node_id, o AS node_offset FROM nodes, unnest(range(length(seq))) t(o)"),
    "gaf_pairs": _with(GAF, then="SELECT line1, line2 FROM gaf_pairs"),
    "gaf_header": _with(GAF, then="SELECT count(*) AS n_records, count(*) FILTER (block <> 0) AS n_valid, count(*) FILTER (block = 0) AS n_invalid FROM gaf"),
    "read_alignments": _with(GAF, TRUTH, then="SELECT name, paired, single, invalid, hi_paired, hi_single, flag FROM per_read JOIN flags USING (name)"),
    "read_classes": _with(
        GAF,
        then="""SELECT class, count(*) AS n FROM (SELECT class FROM classed WHERE class IS NOT NULL UNION ALL SELECT 'NRAL' FROM per_read WHERE paired + single > 0
        UNION ALL SELECT 'NMUL' FROM per_read WHERE paired + single > 1 UNION ALL SELECT 'NWIN' FROM per_read WHERE invalid > 0) GROUP BY class""",
    ),
    "class_sample": _with(GAF, then="SELECT name, paired, single, invalid, hi_paired, hi_single, 0 AS flag FROM classed WHERE class = 'NLUP' AND CAST(concat('0x', substr(md5(concat('0:', name)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.5"),
    "gaf_fragments": _with(GAF, then="SELECT least(n, 3)::INTEGER AS n_fragments, count(*) AS n_reads FROM (SELECT full_name, count(*) FILTER (block <> 0) AS n FROM gaf GROUP BY full_name) GROUP BY 1"),
    "truth_classes": _with(
        GAF,
        TRUTH,
        then="""SELECT class, count(*) AS n FROM (SELECT CASE flag WHEN 15 THEN 'NFFM' WHEN 10 THEN 'NPPM' WHEN 14 THEN 'NFPM' WHEN 11 THEN 'NFPM' WHEN 12 THEN 'NFNM' WHEN 3 THEN 'NFNM' WHEN 8 THEN 'NPNM' WHEN 2 THEN 'NPNM' WHEN 0 THEN 'NNNM' END AS class FROM flags)
        WHERE class IS NOT NULL GROUP BY class""",
    ),
    "pair_distance_check": _base(
        """SELECT line1 AS line, v, o, u, p, CASE WHEN u = v THEN p - o BETWEEN 6 AND 10 ELSE EXISTS (SELECT 1 FROM pairs x WHERE x.v = a.v AND x.o = a.o AND x.u = a.u AND x.p = a.p) END AS ok FROM asked a""",
        GAF,
        """ends AS (SELECT line1, CASE WHEN a.fwd THEN a.node ELSE b.node END + 1 AS v, CASE WHEN a.fwd THEN b.node ELSE a.node END + 1 AS u FROM gaf_pairs JOIN gaf a ON a.line = line1 JOIN gaf b ON b.line = line2),
        asked AS (SELECT line1, v, (length(seq) - 25 - 1)::INTEGER AS o, u, 25::INTEGER AS p FROM ends JOIN nodes ON node_id = v)""",
        _pairs("pairs", DMIN, DMAX),
    ),
    "pair_distance": _base(
        "SELECT line1 AS line, b.ref_pos + 32 - a.ref_pos AS distance FROM gaf_pairs JOIN placed a ON a.line = line1 JOIN placed b ON b.line = line2 WHERE a.path_id = b.path_id",
        GAF,
        """hits AS (SELECT line, path_id, start + CASE WHEN i = 0 THEN p_start ELSE 0 END AS ref_pos, row_number() OVER (PARTITION BY line ORDER BY i, path_id, start) AS r
          FROM gaf, unnest(range(2)) t(i) JOIN starts s ON s.node_id = node + i WHERE path_id IN (SELECT arg_max(path_id, n * 1000000 + path_id) FROM path_steps JOIN (SELECT path_id, count(*) AS n FROM path_steps GROUP BY path_id) USING (path_id) GROUP BY node_id)),
        placed AS (SELECT line, path_id, ref_pos FROM hits WHERE r = 1)""",
    ),
    "run_metrics": """WITH runs AS (SELECT s_suppkey AS run, s_suppkey % 100 + 1 AS n_reads, s_suppkey % 1000 AS hits, s_suppkey % 10 AS off_hits, s_suppkey % 60 / 4.0 AS query_s, s_suppkey % 100 * 36.0 AS traverse_s,
      s_suppkey % 50 AS loci, s_suppkey * 1024 AS index_bytes FROM supplier)
      SELECT run, round(CAST(hits AS DOUBLE) / (121 * n_reads), 6) AS sensitivity, round(CAST(query_s AS DOUBLE) * 1e3 / (5 * n_reads), 6) AS kmer_query_ms, round(CAST(query_s AS DOUBLE) * 1e6 / nullif(hits, 0), 6) AS us_per_hit,
      round(CAST(hits - off_hits AS DOUBLE) / nullif(hits, 0), 6) AS on_path_share, round(CAST(traverse_s AS DOUBLE) / 3600, 6) AS traverse_h, round(CAST(traverse_s AS DOUBLE) / nullif(loci, 0), 6) AS traverse_s_per_locus,
      round(CAST(index_bytes AS DOUBLE) / 1048576, 6) AS index_mb FROM runs""",
    "class_cumulative": """SELECT run, class, round(n / CAST(sum(n) OVER (PARTITION BY run) AS DOUBLE), 6) AS share,
      round(sum(n) OVER (PARTITION BY run ORDER BY class ROWS UNBOUNDED PRECEDING) / CAST(sum(n) OVER (PARTITION BY run) AS DOUBLE), 6) AS cumulative
      FROM (SELECT c_nationkey AS run, c_mktsegment AS class, count(*) AS n FROM customer GROUP BY 1, 2)""",
    "occurrence_histogram": _base(
        "SELECT (n // 2 * 2)::BIGINT AS bin, count(*) AS n FROM (SELECT kmer, count(*) AS n FROM (SELECT substr(seq, i::INTEGER + 1, 6) AS kmer FROM reads, unnest(range(length(seq) - 5)) t(i)) GROUP BY kmer) GROUP BY 1"
    ),
    "metrics_long": "SELECT p_partkey, 'size' AS name, p_size::BIGINT AS value FROM part UNION ALL SELECT p_partkey, 'name_length', length(p_name) FROM part",
    "log_extract": """SELECT user_id AS run, arg_min(event_type, event_id) AS first_stage, CAST(sum(event_id % 97) AS DOUBLE) AS total_us, count(*) AS n_stages, CAST(max(event_id % 97) AS DOUBLE) AS max_us FROM events GROUP BY user_id""",
}
SQL["next_kmers"] = _base(
    """SELECT kmer, number, (SELECT string_agg(substr('ACGT', CAST(((number + 1) % 65536) // CAST(power(4, 8 - i) AS BIGINT) % 4 + 1 AS INTEGER), 1), '' ORDER BY i) FROM unnest(range(1, 9)) t(i)) AS successor FROM numbered""",
    """numbered AS (SELECT kmer, CAST(sum((position(substr(kmer, i::INTEGER, 1) IN 'ACGT') - 1) * power(4, 8 - i)) AS BIGINT) AS number FROM (SELECT DISTINCT kmer FROM read_kmers), unnest(range(1, 9)) t(i) GROUP BY kmer)""",
)
SQL["seeds_all_loci_pruned"] = SQL["seeds_all_loci"]
SQL["source_index"] = SQL["seeds_distinct"]
SQL["finder_patched"] = SQL["seeds_distinct"]
SQL["seeds_stream"] = SQL["seeds_on_paths"]
