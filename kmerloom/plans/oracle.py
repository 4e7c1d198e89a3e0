"""SQL of the mapping plan by its definitions: windows are tried at every place, nothing is pruned by events."""

from __future__ import annotations

from kmerloom.functions.hashing import BASE, COMPLEMENT, threshold
from kmerloom.params import Params
from kmerloom.plans.inputs import PARAMS


def _rot(x: str, n: str) -> str:
    n = f"((({n}) % 64 + 64) % 64)"
    return f"(CASE WHEN {n} = 0 THEN {x} ELSE (({x} & ((1::UBIGINT << (64 - {n})) - 1)) << {n}) | ({x} >> (64 - {n})) END)"


def _lut(complement: bool) -> str:
    arms = " ".join(f"WHEN {i} THEN {BASE[COMPLEMENT[b] if complement else b]}::UBIGINT" for i, b in enumerate("ACGT"))
    return f"(CASE c {arms} END)"


def sketch_ctes(p: Params = PARAMS, tables: tuple[tuple[str, str, str], ...] = (("ref", "documents", "doc_id"), ("own", "benchmark", "item_id"))) -> str:
    """CTEs ref_sketch and own_sketch (owner, tpos, r, h, strand)."""
    out = []
    for name, table, key in tables:
        out.append(f"""
{name}_chars AS (SELECT {key} AS owner, unnest(range(0, len(cs))) AS r, unicode(unnest(cs)) % 4 AS c FROM (SELECT {key}, string_split(text, '') AS cs FROM {table} WHERE length(text) > 0)),
{name}_rot AS (SELECT owner, r, {_rot(_lut(False), '-r')} AS f, {_rot(_lut(True), 'r')} AS v FROM {name}_chars),
{name}_run AS (SELECT owner, r, bit_xor(f) OVER w AS f, bit_xor(v) OVER w AS v FROM {name}_rot WINDOW w AS (PARTITION BY owner ORDER BY r ROWS {p.k - 1} PRECEDING)),
{name}_hash AS (SELECT owner, r, {_rot('f', 'r')} AS f, {_rot('v', f'-(r - {p.k - 1})')} AS v FROM {name}_run WHERE r >= {p.k - 1}),
{name}_sketch AS MATERIALIZED (SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY r) - 1 AS INT) AS tpos, CAST(r AS INT) AS r, CAST(xor(f, v) AS BIGINT) AS h, f > v AS strand
  FROM {name}_hash WHERE xor(f, v) <= {threshold(p.h_frac)}::UBIGINT)""")
    return ",".join(out)


def seed_ctes(p: Params = PARAMS) -> str:
    budget = "CAST(count(*) OVER (PARTITION BY read_idx) AS INT)" if p.one_sweep else f"CAST(trunc((1.0 - ({p.theta!r} - {p.min_diff!r})) * m) AS INT) + 1"
    return f"""
freq AS (SELECT h, count(*) AS hits FROM ref_sketch GROUP BY h),
grouped AS (SELECT owner AS read_idx, h, CAST(count(*) AS INT) AS occs, arg_min(strand, r) AS strand, list(r ORDER BY r DESC) AS pmatches FROM own_sketch GROUP BY owner, h),
seeds AS (SELECT g.*, CAST(coalesce(f.hits, 0) AS INT) AS hits, CAST(sum(occs) OVER (PARTITION BY read_idx) AS INT) AS m,
  CAST(row_number() OVER (PARTITION BY read_idx ORDER BY h) - 1 AS INT) AS seed_num,
  CAST(sum(occs) OVER (PARTITION BY read_idx ORDER BY coalesce(f.hits, 0), h ROWS UNBOUNDED PRECEDING) - occs AS INT) AS seeds_before FROM grouped g LEFT JOIN freq f USING (h)),
budgeted AS MATERIALIZED (SELECT *, {budget} AS budget FROM seeds)"""


def bucket_ctes(p: Params = PARAMS) -> str:
    """hits by bucket, and the content of buckets over the budget and over all seeds."""
    live = "SELECT * REPLACE (1.0::DOUBLE AS sh) FROM ordered" if p.no_pruning else f"SELECT * FROM ordered WHERE sh >= {p.theta!r} * (1.0 - {p.min_diff!r})"
    return f"""
met AS (SELECT s.read_idx, s.h, s.occs, s.m, s.seeds_before < s.budget AS early, t.owner AS segm_id, t.tpos, t.r, CASE WHEN s.strand = t.strand THEN 1 ELSE -1 END AS same,
  CAST(floor(t.tpos / s.m) AS INT) AS b0 FROM budgeted s JOIN ref_sketch t USING (h) WHERE s.m >= {p.min_sketch}),
hits AS (SELECT *, b0 AS b FROM met UNION ALL SELECT *, b0 - 1 FROM met WHERE b0 > 0),
early_seed AS (SELECT read_idx, segm_id, b, h, least(any_value(occs), count(*)) AS matches, sum(same) AS codirection, min(r) AS r_min, max(r) AS r_max FROM hits WHERE early GROUP BY ALL),
early_bucket AS MATERIALIZED (SELECT read_idx, segm_id, b, CAST(sum(matches) AS INT) AS matches, CAST(sum(codirection) AS INT) AS codirection, min(r_min) AS r_min, max(r_max) AS r_max FROM early_seed GROUP BY ALL),
all_seed AS (SELECT read_idx, segm_id, b, h, least(any_value(occs), count(*)) AS matches, any_value(m) AS m, sum(same) AS codirection, min(r) AS r_min, max(r) AS r_max
  FROM hits SEMI JOIN early_bucket USING (read_idx, segm_id, b) GROUP BY read_idx, segm_id, b, h),
content AS MATERIALIZED (SELECT read_idx, segm_id, b, any_value(m) AS m, CAST(sum(matches) AS INT) AS matches, CAST(sum(codirection) AS INT) AS codirection, min(r_min) AS r_min, max(r_max) AS r_max FROM all_seed GROUP BY read_idx, segm_id, b),
sizes AS (SELECT owner AS segm_id, count(*) AS n_kmers FROM ref_sketch GROUP BY owner),
ordered AS MATERIALIZED (SELECT c.*, 1.0::DOUBLE - (c.m - c.matches) / c.m::DOUBLE AS sh, n_kmers,
  row_number() OVER (PARTITION BY c.read_idx ORDER BY e.matches DESC, c.segm_id, c.b) AS place, count(*) OVER (PARTITION BY c.read_idx) AS seeded_buckets
  FROM content c JOIN early_bucket e USING (read_idx, segm_id, b) JOIN sizes USING (segm_id)),
live AS MATERIALIZED ({live})"""


def window_ctes(p: Params = PARAMS) -> str:
    """scored: the best window of each live bucket, every place tried."""
    score = "i / (m + (right_ - l) - i)::DOUBLE" if p.metric == "Jaccard" else "i / m::DOUBLE"
    return f"""
span AS (SELECT *, b * m AS l0, least((b + 2) * m, n_kmers) AS e0 FROM live),
tried AS (SELECT read_idx, segm_id, b, m, e0, unnest(range(l0, e0)) AS l FROM span),
bounds AS (SELECT *, least(l + m, e0) AS right_ FROM tried),
inside AS (SELECT w.read_idx, w.segm_id, w.b, w.m, w.l, w.right_, s.h, least(any_value(s.occs), count(*)) AS k, sum(CASE WHEN s.strand = t.strand THEN 1 ELSE -1 END) AS same
  FROM bounds w JOIN ref_sketch t ON t.owner = w.segm_id AND t.tpos >= w.l AND t.tpos < w.right_ JOIN budgeted s ON s.read_idx = w.read_idx AND s.h = t.h GROUP BY ALL),
windows AS (SELECT read_idx, segm_id, b, m, l, right_, CAST(sum(k) AS INT) AS i, CAST(sum(same) AS INT) AS same_strand FROM inside GROUP BY ALL),
ranked AS (SELECT *, {score} AS score, row_number() OVER (PARTITION BY read_idx, segm_id, b ORDER BY {score} DESC, l) AS n FROM windows),
scored AS MATERIALIZED (SELECT v.read_idx, v.segm_id, v.b, v.m, v.place, v.sh, v.seeded_buckets, k.score, k.i AS intersection, k.same_strand, x.r AS t_l, y.r AS t_r, y.r - x.r + 1 AS s_sz
  FROM live v JOIN ranked k USING (read_idx, segm_id, b) JOIN ref_sketch x ON x.owner = v.segm_id AND x.tpos = k.l JOIN ref_sketch y ON y.owner = v.segm_id AND y.tpos = k.right_ - 1 WHERE k.n = 1)"""


def bound_ctes() -> str:
    return """
scored AS MATERIALIZED (SELECT read_idx, segm_id, b, m, place, sh, seeded_buckets, sh AS score, matches AS intersection, codirection AS same_strand, r_min AS t_l, r_max AS t_r, r_max - r_min AS s_sz FROM live)"""


def chosen(p: Params = PARAMS) -> str:
    """The best and second best mapping of each read with its quality."""
    return f"""
first_pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_idx ORDER BY score DESC, place) AS n FROM scored WHERE sh >= {p.theta!r} AND score > {p.theta!r}) WHERE n = 1),
second_pick AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.read_idx ORDER BY s.score DESC, s.place) AS n FROM scored s JOIN first_pick f USING (read_idx)
  WHERE s.sh >= f.score * (1.0 - {p.min_diff!r}) AND s.score > f.score * (1.0 - {p.min_diff!r})
    AND (s.segm_id <> f.segm_id OR (greatest(s.t_r, f.t_r) > least(s.t_l, f.t_l) AND greatest(0, least(s.t_r, f.t_r) - greatest(s.t_l, f.t_l)) / (greatest(s.t_r, f.t_r) - least(s.t_l, f.t_l))::DOUBLE < {p.max_overlap!r}))) WHERE n = 1),
mapped AS (SELECT f.read_idx, f.segm_id, f.b, f.t_l, f.t_r, f.s_sz, f.intersection, f.same_strand, f.score, f.sh, f.m AS p_sz, f.seeded_buckets, coalesce(s.intersection, -1) AS intersection2,
  greatest(coalesce(s.score, -1.0), {p.theta!r} - {p.min_diff!r}) AS score2, coalesce(s.segm_id, -1) AS segm_id2, coalesce(s.b, -1) AS b2 FROM first_pick f LEFT JOIN second_pick s USING (read_idx)),
final AS (SELECT *, CASE WHEN NOT (1.0 - score2 / score > {p.min_diff!r}) THEN 0 WHEN abs(same_strand) < intersection // 2 THEN 5 ELSE 60 END AS mapq FROM mapped)"""


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select
