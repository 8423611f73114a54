"""SQL counterparts of the queries that SQL can express on whole tables."""

_RECORDS = """rec AS (SELECT id, any_value(map_id) AS map_id, any_value(seq_id) AS seq_id, any_value(ord) AS ord,
  any_value(x) AS x, any_value(y) AS y, any_value(dist) AS dist, any_value(ts) AS ts
  FROM classification_map WHERE id IS NOT NULL GROUP BY id)"""

_RUNS = f"""WITH {_RECORDS},
placed AS (SELECT rec.*, c.nid IS NOT NULL AS ok FROM rec LEFT JOIN codebook c
  ON rec.map_id = c.map_id AND rec.x = c.r AND rec.y = c.c WHERE seq_id IS NOT NULL AND ord IS NOT NULL),
linked AS (SELECT *, coalesce(ok AND lag(ok) OVER w AND abs(x - lag(x) OVER w) <= 1 AND abs(y - lag(y) OVER w) <= 1, FALSE) AS link
  FROM placed WINDOW w AS (PARTITION BY seq_id ORDER BY ord, id)),
numbered AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY ord, id) AS run FROM linked),
runs AS (SELECT seq_id, arg_min(id, (ord, id)) AS first_id, arg_max(id, (ord, id)) AS last_id, count(*)::bigint AS n_records,
  round((epoch_us(arg_max(ts, (ord, id))) - epoch_us(arg_min(ts, (ord, id))))::double / 1e6, 6) AS duration_s
  FROM numbered GROUP BY seq_id, run HAVING count(*) >= 2)"""

_TOP = f"""WITH {_RECORDS},
best AS (SELECT rec.map_id, rec.x, rec.y, id, dist, row_number() OVER (PARTITION BY rec.map_id, rec.x, rec.y ORDER BY dist DESC, id) AS rank
  FROM rec JOIN codebook c ON rec.map_id = c.map_id AND rec.x = c.r AND rec.y = c.c
  WHERE dist >= 0 AND isfinite(dist))"""

#: All similar pairs: complete vectors by two components' cells, incomplete ones with all.
_SIMILAR = f"""one AS (SELECT id, any_value(data) AS data FROM classification_map WHERE id IS NOT NULL GROUP BY id),
vec AS (SELECT id, list_transform(range(1, 17), lambda i: CASE WHEN isfinite(data[i]) THEN data[i] END) AS d FROM one WHERE data IS NOT NULL),
sized AS (SELECT id, d, len(list_filter(d, lambda v: v IS NOT NULL)) AS n FROM vec),
whole AS (SELECT id, d, floor(d[1] / 0.081)::bigint AS c1, floor(d[2] / 0.081)::bigint AS c2 FROM sized WHERE n = 16),
around AS (SELECT id, d, c1 + s AS c1, c2 + t AS c2 FROM whole, (SELECT unnest([-1, 0, 1]) AS s), (SELECT unnest([-1, 0, 1]) AS t)),
met AS (SELECT a.id AS p, b.id AS q, a.d AS dp, b.d AS dq FROM around a JOIN whole b ON a.c1 = b.c1 AND a.c2 = b.c2 WHERE a.id < b.id
  UNION ALL SELECT a.id, b.id, a.d, b.d FROM sized a JOIN sized b ON a.n BETWEEN 12 AND 15 AND b.n >= 12 AND (b.n = 16 OR a.id < b.id)
    AND coalesce(abs(a.d[1] - b.d[1]), 0) <= 0.081 AND coalesce(abs(a.d[2] - b.d[2]), 0) <= 0.081 AND coalesce(abs(a.d[3] - b.d[3]), 0) <= 0.081),
close_pairs AS (SELECT least(p, q) AS id_a, greatest(p, q) AS id_b FROM (SELECT p, q,
    list_filter(list_transform(list_zip(dp, dq), lambda t: (t[1] - t[2]) ** 2), lambda v: v IS NOT NULL) AS s FROM met)
  WHERE len(s) >= 12 AND sqrt(list_sum(s) / len(s)) <= 0.02)"""

SQL = {
    "p1_rank_errors": f"""WITH {_RECORDS},
        placed AS (SELECT rec.*, c.nid IS NOT NULL AS ok, CASE WHEN dist >= 0 AND isfinite(dist) THEN dist END AS v FROM rec
          LEFT JOIN codebook c ON rec.map_id = c.map_id AND rec.x = c.r AND rec.y = c.c)
        SELECT 'node_dist' AS measure, map_id, x, y, NULL::int AS day_number, count(*) AS n, TRUE AS within FROM placed WHERE ok AND v IS NOT NULL GROUP BY map_id, x, y
        UNION ALL SELECT 'day_dist', NULL, NULL, NULL, (epoch_us(ts) // 86400000000)::int AS day, count(*), TRUE FROM placed WHERE v IS NOT NULL GROUP BY day
        UNION ALL SELECT 'map_x', map_id, NULL, NULL, NULL, count(*), TRUE FROM placed WHERE ok GROUP BY map_id
        UNION ALL SELECT 'map_y', map_id, NULL, NULL, NULL, count(*), TRUE FROM placed WHERE ok GROUP BY map_id""",
    "p5_found": f"WITH {_SIMILAR} SELECT id_a, id_b FROM close_pairs",
    "p5_membership": f"""WITH RECURSIVE {_SIMILAR},
        step AS (SELECT id_a AS a, id_b AS b FROM close_pairs UNION ALL SELECT id_b, id_a FROM close_pairs),
        reach(id, r) AS (SELECT DISTINCT a, a FROM step UNION SELECT step.b, r FROM reach JOIN step ON step.a = reach.id)
        SELECT id, min(r) AS cluster_id FROM reach GROUP BY id""",
    "p2_found": f"{_RUNS} SELECT seq_id, first_id, last_id FROM runs",
    "p2_stays": f"{_RUNS} SELECT seq_id, first_id, last_id, n_records, duration_s FROM runs",
    "p4_found": f"{_TOP} SELECT map_id, x, y, id FROM best WHERE rank <= 5",
    "p4_ranked": f"{_TOP} SELECT map_id, x, y, rank::int AS rank, id, dist FROM best WHERE rank <= 5",
}
