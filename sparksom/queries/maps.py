"""Distances, best-matching units, map quality, labels and plot data, on the recorded samples."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import distances
from ..operators import quality, views
from ..sources import read_table
from . import base

MAP = ["map_id"]


def _distance(name: str, band: int | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = base.weighed(spark, sf_dir).select("id", "data", "w")
        return distances.with_pair_distance(pairs, "data", "w", name, "dist", band).select("id", F.round("dist", 6).alias("dist")).dropDuplicates(["id"])

    return query


def _bmu(distance: str = "euclidean", own: bool = False, normalized: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = base.scored(spark, sf_dir, distance, own, normalized)
        return best.select("id", "map_id", "nid", "nid2", F.round("dist", 6).alias("dist"), F.round("dist2", 6).alias("dist2"))

    return query


def activation_map(spark, sf_dir):
    return quality.activation_map(base.scored(spark, sf_dir), base.nodes(spark, sf_dir), MAP)


def error_maps(spark, sf_dir):
    cells = quality.error_maps(base.scored(spark, sf_dir), base.nodes(spark, sf_dir), MAP)
    return cells.select("map_id", "nid", "activations", F.round("distance_sum", 5).alias("distance_sum"), "misses", F.round("qe", 12).alias("qe"), F.round("te", 6).alias("te"))


def map_quality(spark, sf_dir):
    """Quantization error, mean distance and activated nodes, with the topological error."""
    both = quality.quantization_error(base.scored(spark, sf_dir), MAP)
    return both.select("map_id", "n_samples", "num_activations", F.round("mean_distance", 5).alias("mean_distance"),
                       F.round("quantization_error", 5).alias("quantization_error"), F.round("topological_error", 6).alias("topological_error"))


def qe_euclidean(spark, sf_dir):
    pairs = base.weighed(spark, sf_dir)
    each = distances.with_pair_distance(pairs, "data", "w", "euclidean", "dist").select("id", "map_id", "dist").dropDuplicates(["id"])
    e = each.groupBy("map_id").agg(F.avg("dist").alias("quantization_error_euclidean"))
    return e.select("map_id", F.round("quantization_error_euclidean", 5).alias("quantization_error_euclidean"))


def distortion(spark, sf_dir):
    book = read_table(spark, sf_dir, "codebook")
    sigma = base.sizes(spark, sf_dir).select("map_id", F.col("size").cast("double").alias("sigma"))
    rows = base.scored_vectors(spark, sf_dir).select("map_id", "nid", "data")
    return quality.distortion(rows, "data", book, sigma, MAP).select("map_id", F.round("distortion", 3).alias("distortion"))


def umatrix(spark, sf_dir):
    return quality.u_matrix(read_table(spark, sf_dir, "codebook"), MAP).withColumn("value", F.round("value", 6))


def _label() -> Column:
    return F.trim(F.regexp_replace(F.lower("label"), "[^a-z]+", " "))


def _labelled(spark, sf_dir):
    return base.placed(spark, sf_dir, "label").select("map_id", "nid", _label().alias("label")).where("label is not null")


def majority_class(spark, sf_dir):
    return views.majority_labels(_labelled(spark, sf_dir), "label", MAP)


def hit_map(spark, sf_dir):
    hits = views.hit_map(views.majority_labels(_labelled(spark, sf_dir), "label", MAP), MAP)
    return hits.select("map_id", "nid", "majority", "n_labelled", F.round("half_width", 6).alias("half_width"))


def purity(spark, sf_dir):
    return quality.purity(_labelled(spark, sf_dir), "label", MAP).select("map_id", F.round("purity", 6).alias("purity"))


def nmi(spark, sf_dir):
    return quality.nmi(_labelled(spark, sf_dir), "label", MAP).select("map_id", F.round("nmi", 6).alias("nmi"))


def _hits(spark, sf_dir):
    return quality.activation_map(base.placed(spark, sf_dir), base.nodes(spark, sf_dir), MAP)


def heat_map(spark, sf_dir):
    return views.heat_map(_hits(spark, sf_dir), MAP)


def bar_chart(spark, sf_dir):
    return views.bar_chart(_hits(spark, sf_dir), "activations", MAP)


def activation_histogram(spark, sf_dir):
    return views.activation_histogram(_hits(spark, sf_dir), MAP)


def characteristics(spark, sf_dir):
    return views.characteristics(read_table(spark, sf_dir, "codebook"), MAP).withColumn("value", F.round("value", 6))


def codebook_planes(spark, sf_dir):
    return views.codebook_planes(read_table(spark, sf_dir, "codebook"), MAP).select("map_id", "feature", "plot_row", "plot_col", "value")


def weight_grid(spark, sf_dir):
    grid = views.weight_grid(read_table(spark, sf_dir, "codebook"), views.majority_labels(_labelled(spark, sf_dir), "label", MAP), MAP)
    return grid.select("map_id", "nid", "majority", "n_majority", F.posexplode("w").alias("feature", "value"))


def rotated_weights(spark, sf_dir):
    turned = views.rotated_weights(read_table(spark, sf_dir, "codebook"), base.sizes(spark, sf_dir), MAP)
    return turned.select("map_id", "plot_row", "plot_col", F.posexplode("w").alias("feature", "value"))


def rotated_umatrix(spark, sf_dir):
    cells = quality.u_matrix(read_table(spark, sf_dir, "codebook"), MAP)
    return views.rotated_u_matrix(cells, base.sizes(spark, sf_dir), MAP).withColumn("value", F.round("value", 6))


def queries() -> dict:
    named = {f"dist_{n}": _distance(n) for n in distances.available()}
    named["dist_dtw_band"] = _distance("dtw", 2)
    named |= {"bmu_top2": _bmu(), "bmu_own_distance": _bmu(own=True), "bmu_own_normalization": _bmu(own=True, normalized=True)} | {f"bmu_{n}": _bmu(n) for n in distances.available() if n != "euclidean"}
    plain = (activation_map, error_maps, map_quality, qe_euclidean, distortion, umatrix, majority_class, hit_map, purity, nmi,
             heat_map, bar_chart, activation_histogram, characteristics, codebook_planes, weight_grid, rotated_weights, rotated_umatrix)
    return {**named, **{f.__name__: f for f in plain}}


_ZIP = "list_zip(data, w)"
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_DTW = """WITH RECURSIVE {samples},
dp(id, i, data, w, costs) AS (
  SELECT id, 0, data, w, [0.0::double] || list_transform(range(16), lambda k: 'infinity'::double) FROM weighed
  UNION ALL
  SELECT id, i + 1, data, w, list_reduce(range(1, 17), lambda acc, j: list_append(acc,
      CASE WHEN {inside} THEN (data[i + 1] - w[j]) ** 2 + least(costs[j + 1], costs[j], acc[j]) ELSE 'infinity'::double END), ['infinity'::double])
  FROM dp WHERE i < 16)
SELECT id, round(sqrt(costs[17]), 6) AS dist FROM dp WHERE i = 16"""
_EDGES = """u AS (SELECT a.map_id, 2*a.r + (b.r - a.r) AS ur, 2*a.c + (b.c - a.c) AS uc, list_distance(a.w, b.w) AS d,
    (b.r <> a.r AND b.c <> a.c) AS diag
  FROM codebook a JOIN codebook b ON a.map_id = b.map_id AND ((b.r = a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1) OR (b.r = a.r AND b.c = a.c + 1))),
cells AS (
  SELECT map_id, ur, uc, d AS value, 'edge' AS kind FROM u WHERE NOT diag
  UNION ALL SELECT map_id, ur, uc, avg(d), 'diagonal' FROM u WHERE diag GROUP BY map_id, ur, uc
  UNION ALL SELECT c.map_id, 2*c.r, 2*c.c, avg(u.d), 'node' FROM codebook c JOIN u ON u.map_id = c.map_id AND NOT u.diag
    AND abs(u.ur - 2*c.r) + abs(u.uc - 2*c.c) = 1 GROUP BY c.map_id, c.r, c.c)"""
_LABELLED = base.SQL_PLACED + """,
lab AS (SELECT map_id, nid, trim(regexp_replace(lower(label), '[^a-z]+', ' ', 'g')) AS label FROM placed WHERE label IS NOT NULL),
cnt AS (SELECT map_id, nid, label, count(*) AS n FROM lab GROUP BY map_id, nid, label),
maj AS (SELECT map_id, nid, arg_min(label, (-n, label)) AS majority, max(n) AS n_majority, sum(n)::bigint AS n_labelled FROM cnt GROUP BY map_id, nid)"""
_SIDE = "side AS (SELECT map_id, max(r) + 1 AS size FROM codebook GROUP BY map_id)"
_HITS = base.SQL_PLACED + """,
hits AS (SELECT c.map_id, c.nid, c.r, c.c, count(p.id) AS activations FROM codebook c LEFT JOIN placed p ON p.map_id = c.map_id AND p.nid = c.nid
  GROUP BY c.map_id, c.nid, c.r, c.c)"""
_CELLS = base.SQL_SCORED + """,
per AS (SELECT map_id, nid, count(*) AS n, sum(dist) AS s, sum(CASE WHEN greatest(abs(r - r2), abs(c - c2)) > 1 THEN 1 ELSE 0 END)::bigint AS misses
  FROM scored GROUP BY map_id, nid)"""


def _normal(v: str) -> str:
    """A vector by its map's normalisation (``o``), with the map's statistics (``t``)."""
    one = lambda x: f"CASE WHEN {x} = 0 THEN 1.0 ELSE {x} END"
    quantile = lambda q: f"list_aggregate({v}, 'quantile_cont', {q})"
    each = lambda centre, scale: f"list_transform(range(1, 17), lambda i: ({v}[i] - {centre}) / ({one(scale)}))"
    return f"""CASE o.normalization WHEN 'zscore_feature' THEN {each('t.m[i]', 't.sd[i]')} WHEN 'zscore' THEN {each('t.m[i]', 't.sd[i]')}
        WHEN 'minmax_feature' THEN {each('t.lo[i]', '(t.hi[i] - t.lo[i])')} WHEN '01scale' THEN {each('t.lo[i]', '(t.hi[i] - t.lo[i])')}
        WHEN 'zscore_sample' THEN {each(f'list_avg({v})', f'list_stddev_pop({v})')} WHEN 'minmax_sample' THEN {each(f'list_min({v})', f'(list_max({v}) - list_min({v}))')}
        WHEN 'robust_sample' THEN {each(quantile(0.5), f'({quantile(0.75)} - {quantile(0.25)})')} ELSE {v} END"""


def oracle_sql() -> dict[str, str]:
    def dist(expr: str) -> str:
        return f"WITH {base.SQL_WEIGHED} SELECT id, round({expr}, 6) AS dist FROM weighed"

    top2 = "SELECT id, map_id, nid, nid2, round(dist, 6) AS dist, round(dist2, 6) AS dist2 FROM scored"

    def bmu(expr: str) -> str:
        pairs = base.SQL_PAIRS.replace("list_distance(s.data, c.w)", expr)
        return f"WITH {pairs}{base.SQL_RANKED} {top2}"

    centred = [f"list_transform({v}, lambda t: t - list_avg({v}))" for v in ("data", "w")]
    size = "sqrt(list_dot_product(data, data)) * sqrt(list_dot_product(w, w))"
    cross = f"""CASE WHEN {size} = 0 THEN 1.0 ELSE 1 - list_max(list_transform(range(-15, 16), lambda s:
            abs(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i + s BETWEEN 1 AND 16 THEN data[i] * w[i + s] ELSE 0.0 END))))) / ({size}) END"""
    flat = {
        # The terms are added in the kernel's order: some nodes are equally far from a sample.
        "manhattan": f"list_transform([list_transform({_ZIP}, lambda t: abs(t[1] - t[2]))], lambda v: " + " + ".join(
            f"(({four[0]}) + ({four[1]}))" for four in ([f"(v[{i}] + v[{i + 8}]) + (v[{i + 1}] + v[{i + 9}])" for i in at] for at in ((1, 3), (5, 7)))) + ")[1]",
        "chebyshev": f"list_max(list_transform({_ZIP}, lambda t: abs(t[1] - t[2])))",
        "cosine": f"CASE WHEN {size} = 0 THEN 1.0 ELSE 1 - {_COS.format(a='data', b='w')} END",
        "correlation": f"""CASE WHEN list_max(data) = list_min(data) OR list_max(w) = list_min(w) THEN 1.0
            ELSE 1 - abs({_COS.format(a=centred[0], b=centred[1])}) END""",
    }

    def own(data: str, w: str) -> str:
        """Each map by its own distance; ``data`` and ``w`` say what is compared."""
        stats = ", ".join(f"[{', '.join(f'{f}(data[{i}])' for i in range(1, base.DIMS + 1))}] AS {n}" for n, f in (("m", "avg"), ("sd", "stddev_pop"), ("lo", "min"), ("hi", "max")))
        return f"""WITH RECURSIVE {base.SQL_SAMPLES},
            stats AS (SELECT map_id, {stats} FROM samp GROUP BY map_id),
            own AS (SELECT map_id, any_value(CASE WHEN lower(trim(distance)) IN ('manhattan', 'chebyshev', 'cosine', 'correlation', 'dtw', 'cross_correlation')
              THEN lower(trim(distance)) ELSE 'euclidean' END) AS distance,
              any_value(lower(trim(normalization))) AS normalization FROM trained_map GROUP BY map_id),
            ns AS (SELECT s.id, s.map_id, s.label, {data} AS data FROM samp s LEFT JOIN own o ON o.map_id = s.map_id LEFT JOIN stats t ON t.map_id = s.map_id),
            nc AS (SELECT c.map_id, c.nid, c.r, c.c, {w} AS w FROM codebook c LEFT JOIN own o ON o.map_id = c.map_id LEFT JOIN stats t ON t.map_id = c.map_id),
            met AS (SELECT s.id, s.map_id, s.label, s.data, c.nid, c.r, c.c, c.w, coalesce(o.distance, 'euclidean') AS distance
              FROM ns s JOIN nc c ON s.map_id = c.map_id LEFT JOIN own o ON o.map_id = s.map_id),
            dp(id, nid, i, data, w, costs) AS (
              SELECT id, nid, 0, data, w, [0.0::double] || list_transform(range(16), lambda k: 'infinity'::double) FROM met WHERE distance = 'dtw'
              UNION ALL
              SELECT id, nid, i + 1, data, w, list_reduce(range(1, 17), lambda acc, j: list_append(acc, (data[i + 1] - w[j]) ** 2 + least(costs[j + 1], costs[j], acc[j])),
                ['infinity'::double]) FROM dp WHERE i < 16),
            pairs AS (SELECT id, map_id, label, nid, r, c, CASE distance {' '.join(f"WHEN '{name}' THEN {expr}" for name, expr in flat.items())}
                WHEN 'cross_correlation' THEN {cross} ELSE list_distance(data, w) END AS d FROM met WHERE distance <> 'dtw'
              UNION ALL SELECT m.id, m.map_id, m.label, m.nid, m.r, m.c, sqrt(p.costs[17]) FROM dp p JOIN met m ON m.id = p.id AND m.nid = p.nid WHERE p.i = 16)
            {base.SQL_RANKED} {top2}"""

    return {
        "dist_euclidean": dist(f"sqrt(list_sum(list_transform({_ZIP}, lambda t: (t[1] - t[2]) ** 2)))"),
        **{f"dist_{name}": dist(expr) for name, expr in flat.items()},
        "dist_cross_correlation": dist(cross),
        "dist_dtw": _DTW.format(samples=base.SQL_WEIGHED, inside="TRUE"),
        "dist_dtw_band": _DTW.format(samples=base.SQL_WEIGHED, inside="abs(i + 1 - j) <= 2"),
        "bmu_top2": f"WITH {base.SQL_SCORED} {top2}",
        **{f"bmu_{name}": bmu(expr) for name, expr in flat.items()},
        "bmu_cross_correlation": bmu(cross),
        "bmu_own_distance": own("s.data", "c.w"),
        "bmu_own_normalization": own(_normal("s.data"), _normal("c.w")),
        "activation_map": f"""WITH {base.SQL_SCORED} SELECT c.map_id, c.nid, c.r, c.c, count(s.id) AS activations
            FROM codebook c LEFT JOIN scored s ON s.map_id = c.map_id AND s.nid = c.nid GROUP BY c.map_id, c.nid, c.r, c.c""",
        "error_maps": f"""WITH {_CELLS} SELECT c.map_id, c.nid, coalesce(n, 0)::bigint AS activations, round(coalesce((round_even(s * 1e5, 0) / 1e5), 0), 5) AS distance_sum,
            coalesce(misses, 0)::bigint AS misses, round(coalesce((round_even(s * 1e5, 0) / 1e5) / n, 0), 12) AS qe, round(coalesce(misses::double / n, 0), 6) AS te
            FROM codebook c LEFT JOIN per p ON p.map_id = c.map_id AND p.nid = c.nid""",
        "map_quality": f"""WITH {_CELLS} SELECT map_id, sum(n)::bigint AS n_samples, count(*) AS num_activations, round(sum(s) / sum(n), 5) AS mean_distance,
            round(sum((round_even(s * 1e5, 0) / 1e5)) / sum(n), 5) AS quantization_error, round(sum(misses)::double / sum(n), 6) AS topological_error FROM per GROUP BY map_id""",
        "qe_euclidean": f"WITH {base.SQL_WEIGHED} SELECT map_id, round(avg(list_distance(data, w)), 5) AS quantization_error_euclidean FROM weighed GROUP BY map_id",
        "distortion": f"""WITH {base.SQL_SAMPLES}, {_SIDE},
            pairs AS (SELECT s.id, s.map_id, c.nid, c.r, c.c, list_distance(s.data, c.w) AS d FROM samp s JOIN codebook c ON s.map_id = c.map_id),
            best AS (SELECT id, arg_min(r, (d, nid)) AS br, arg_min(c, (d, nid)) AS bc FROM pairs GROUP BY id)
            SELECT p.map_id, round(sum(exp(-((r - br) ** 2 + (c - bc) ** 2)::double / (2.0 * size * size)) * d * d) / count(DISTINCT p.id), 3) AS distortion
            FROM pairs p JOIN best USING (id) JOIN side USING (map_id) GROUP BY p.map_id""",
        "umatrix": f"WITH {_EDGES} SELECT map_id, ur, uc, round(value, 6) AS value, kind FROM cells",
        "rotated_umatrix": f"WITH {_EDGES}, {_SIDE} SELECT map_id, 2 * size - 2 - uc AS plot_row, ur AS plot_col, round(value, 6) AS value FROM cells JOIN side USING (map_id)",
        "majority_class": f"WITH {_LABELLED} SELECT map_id, nid, n_majority, n_labelled, majority FROM maj",
        "hit_map": f"""WITH {_LABELLED} SELECT map_id, nid, majority, n_labelled,
            round(0.18::double + 0.72::double * sqrt(n_labelled::double / max(n_labelled) OVER (PARTITION BY map_id)), 6) AS half_width FROM maj""",
        "purity": f"WITH {_LABELLED} SELECT map_id, round(sum(n_majority)::double / sum(n_labelled), 6) AS purity FROM maj GROUP BY map_id",
        "nmi": f"""WITH {_LABELLED}, t AS (SELECT map_id, sum(n)::double AS t FROM cnt GROUP BY map_id),
            a AS (SELECT map_id, nid, sum(n)::double AS a FROM cnt GROUP BY map_id, nid), b AS (SELECT map_id, label, sum(n)::double AS b FROM cnt GROUP BY map_id, label),
            ha AS (SELECT map_id, -sum(a / t * ln(a / t)) AS h FROM a JOIN t USING (map_id) GROUP BY map_id),
            hb AS (SELECT map_id, -sum(b / t * ln(b / t)) AS h FROM b JOIN t USING (map_id) GROUP BY map_id),
            mi AS (SELECT map_id, sum(n / t * ln(n * t / (a * b))) AS mi FROM cnt JOIN a USING (map_id, nid) JOIN b USING (map_id, label) JOIN t USING (map_id) GROUP BY map_id)
            SELECT map_id, round(CASE WHEN (ha.h + hb.h) / 2 <= 1e-15 THEN 1.0 ELSE greatest(0, mi / ((ha.h + hb.h) / 2)) END, 6) AS nmi
            FROM mi JOIN ha USING (map_id) JOIN hb USING (map_id)""",
        "heat_map": f"WITH {_HITS} SELECT map_id, c AS plot_row, r AS plot_col, activations FROM hits",
        "bar_chart": f"WITH {_HITS} SELECT map_id, nid AS position, activations::double AS value FROM hits",
        "activation_histogram": f"""WITH {_HITS}, m AS (SELECT map_id, unnest(range(max(activations) + 1)) AS hits FROM hits GROUP BY map_id)
            SELECT m.map_id, m.hits, count(h.nid) AS n_nodes FROM m LEFT JOIN hits h ON h.map_id = m.map_id AND h.activations = m.hits GROUP BY m.map_id, m.hits""",
        "characteristics": "SELECT map_id, nid, (i - 1)::int AS feature, round(w[i], 6) AS value FROM codebook, range(1, 17) t(i)",
        "codebook_planes": "SELECT map_id, (i - 1)::int AS feature, c AS plot_row, r AS plot_col, round_even(w[i] * 100, 0) / 100 AS value FROM codebook, range(1, 17) t(i)",
        "weight_grid": f"""WITH {_LABELLED} SELECT c.map_id, c.nid, m.majority, m.n_majority, (i - 1)::int AS feature, c.w[i] AS value
            FROM codebook c CROSS JOIN range(1, 17) t(i) LEFT JOIN maj m ON m.map_id = c.map_id AND m.nid = c.nid""",
        "rotated_weights": f"""WITH {_SIDE} SELECT map_id, size - 1 - c AS plot_row, r AS plot_col, (i - 1)::int AS feature, w[i] AS value
            FROM codebook JOIN side USING (map_id) CROSS JOIN range(1, 17) t(i)""",
    }
