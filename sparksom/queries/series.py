"""Normalisation, sequences of nodes, signal features, index series."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.features import BAND_POWERS, COMPLEXITY, SPECTRAL, STATISTICAL, FeatureExtractor
from ..operators import quality, temporal, views
from ..operators.normalize import Normalizer, assemble, per_sample
from ..plans import checkpoint_dir, delete, materialize
from ..sources import append_side_table, read_index, read_table, write_index
from . import base

MAP, SEQ = ["map_id"], ["map_id", "seq_id"]
#: Samples per second of the signal windows, so that all bands lie below half of it.
RATE = 200.0


def _feature_norm(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = assemble(read_table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
        fitted = Normalizer(method).fit(parts, "features")
        rows = parts.select("p_partkey", F.posexplode(fitted.apply(F.col("features"))).alias("feature", "value"))
        return rows.withColumn("value", F.round("value", 6))

    return query


def _sample_norm(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read_table(spark, sf_dir, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
        return rows.select("vec_id", F.posexplode(per_sample(method, F.col("x"))).alias("feature", "value")).withColumn("value", F.round("value", 6))

    return query


def norm_none(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.select("vec_id", F.posexplode(Normalizer("none").apply(F.col("x"))).alias("feature", "value"))


# -- sequences ------------------------------------------------------------------------------


def _steps(spark, sf_dir):
    return temporal.steps(base.placed(spark, sf_dir, "seq_id", "ord").where("seq_id is not null and ord is not null"), SEQ, "ord")


def trajectory(spark, sf_dir):
    return base.placed(spark, sf_dir, "seq_id", "ord").where("seq_id is not null and ord is not null").select("seq_id", "ord", "nid", "r", "c")


def trajectory_view(spark, sf_dir):
    """The plotted path, with its replayable jitter."""
    view = views.trajectory(trajectory(spark, sf_dir), ["seq_id"], "ord")
    return view.withColumns({c: F.round(c, 6) for c in ("jx", "jy")})


def transitions(spark, sf_dir):
    return temporal.transitions(_steps(spark, sf_dir), MAP).withColumn("prob", F.round("prob", 6))


def path_metrics(spark, sf_dir):
    m = temporal.path_metrics(_steps(spark, sf_dir), SEQ)
    return m.select("map_id", "seq_id", "n_samples", *[F.round(c, 6).alias(c) for c in ("stability", "mean_path_length", "mean_chebyshev_jump", "temporal_coherence")])


def top_transitions(spark, sf_dir):
    return temporal.most_frequent_transitions(temporal.transitions(_steps(spark, sf_dir), MAP), MAP, 10)


def dwell_times(spark, sf_dir):
    return temporal.dwell_times(_steps(spark, sf_dir), MAP).withColumn("mean_dwell", F.round("mean_dwell", 6))


def dwell_map(spark, sf_dir):
    return views.dwell_map(temporal.dwell_times(_steps(spark, sf_dir), MAP), base.nodes(spark, sf_dir), MAP).withColumn("mean_dwell", F.round("mean_dwell", 6))


def map_summary(spark, sf_dir):
    """The summary of every map's sequences."""
    m = temporal.summaries(_steps(spark, sf_dir), MAP)
    return m.select("map_id", "n_samples", "n_nodes", "top_steps", *[F.round(c, 6).alias(c) for c in ("stability", "mean_path_length", "mean_chebyshev_jump", "temporal_coherence")])


def dense_transitions(spark, sf_dir):
    """The whole transition matrix of every map, as plots need it."""
    matrix = temporal.dense_transitions(temporal.transitions(_steps(spark, sf_dir), MAP), base.nodes(spark, sf_dir), MAP)
    return matrix.withColumn("prob", F.round("prob", 6))


def side_table(spark, sf_dir):
    """Placed records with their recording's columns."""
    rows = base.placed(spark, sf_dir, "seq_id", "ord").select("id", "map_id", "seq_id", "nid")
    side = read_table(spark, sf_dir, "recordings", "seq_id", "map_id", "station", "period_s", "n_expected").where("seq_id is not null")
    return append_side_table(rows, side, ["seq_id"], salt_by="id")


def signal_labels(spark, sf_dir):
    """Signal windows with the name of their label."""
    windows = read_table(spark, sf_dir, "signal_batch", "window_id", "label_code").where("window_id is not null").dropDuplicates(["window_id"])
    return append_side_table(windows, read_table(spark, sf_dir, "waveform_labels"), ["label_code"], salt_by="window_id")


def rank_correlation(spark, sf_dir):
    """Spearman correlation of each step's two flat node numbers, per map."""
    pairs = _steps(spark, sf_dir).where("prev_nid is not null")
    return quality.flat_rank_correlation(pairs, "prev_nid", "nid", MAP).withColumn("spearman", F.round("spearman", 6))


# -- signals ----------------------------------------------------------------------------------


def _features(names: tuple[str, ...], psd: str = "periodogram"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        windows = read_table(spark, sf_dir, "signal_batch", "window_id", "signal").where("window_id is not null").dropDuplicates(["window_id"])
        extractor = FeatureExtractor(list(names), fs=RATE, psd=psd)
        out = extractor.extract(windows, "signal")
        # An infinite entropy (no matching template of the longer kind) is null here.
        finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.round(c, 6)).alias(c)
        return out.select("window_id", *[finite(n) for n in extractor.names])

    return query


# -- index series -----------------------------------------------------------------------------

#: Fixed value: the code for a missing month in the index files.
MISSING = -99.9


def rolling_index(spark, sf_dir):
    """Mean of the last 20 present values of each monthly series (a fixed, small table)."""
    rows = read_table(spark, sf_dir, "climate_index").where((F.col("index_value").isNotNull()) & (F.col("index_value") != MISSING))
    w = Window.partitionBy("index_name").orderBy("index_year", "index_month").rowsBetween(-19, 0)
    return rows.select("index_name", "index_year", "index_month", F.round(F.avg("index_value").over(w), 6).alias("rolling_mean"))


def index_files(spark, sf_dir):
    """Every monthly series written as an index file and read again."""
    series = read_table(spark, sf_dir, "climate_index")
    out, folder = None, f"{checkpoint_dir(spark)}/sparksom/index-{uuid.uuid4().hex}"
    for k, (name,) in enumerate(sorted(series.select("index_name").where("index_name is not null").distinct().collect())):  # a few series
        write_index(series.where(F.col("index_name") == name), f"{folder}/{k}")
        read = read_index(spark, f"{folder}/{k}").select(F.lit(name).alias("index_name"), "index_year", "index_month", "index_value")
        out = read if out is None else out.unionByName(read)
    kept = materialize(out if out is not None else series.limit(0), "index-rows")
    delete(spark, folder)
    return kept


def index_ranks(spark, sf_dir):
    """Rank of each series within a month, equal values sharing the smallest rank."""
    rows = read_table(spark, sf_dir, "climate_index").where((F.col("index_value").isNotNull()) & (F.col("index_value") != MISSING))
    w = Window.partitionBy("index_year", "index_month").orderBy(F.col("index_value").desc())
    return rows.select("index_name", "index_year", "index_month", F.rank().over(w).alias("rank"))


FEATURES = {
    "feat_statistical": _features(STATISTICAL), "feat_hjorth": _features(COMPLEXITY[:3]), "feat_sample_entropy": _features(("sample_entropy",)),
    "feat_spectral": _features(SPECTRAL), "feat_band_power": _features(BAND_POWERS), "feat_welch": _features(SPECTRAL, "welch"),
}


def queries() -> dict:
    norms = {f"norm_{m}": _feature_norm(m) for m in ("zscore", "fwn", "robust", "01scale")}
    norms |= {f"norm_{m}": _sample_norm(m) for m in ("zscore_sample", "robust_sample", "minmax_sample", "l2", "euclidean")}
    plain = (norm_none, map_summary, dense_transitions, side_table, signal_labels, index_files, trajectory, trajectory_view, transitions, path_metrics, top_transitions, dwell_times, dwell_map, rank_correlation, rolling_index, index_ranks)
    return {**norms, **{f.__name__: f for f in plain}, **FEATURES}


def _norm_sql(value: str, stats: str) -> str:
    return f"""WITH f AS (SELECT p_partkey, 0 AS feature, p_size::double AS v FROM part UNION ALL SELECT p_partkey, 1, p_retailprice::double FROM part),
        s AS (SELECT feature, {stats} FROM f GROUP BY feature)
        SELECT p_partkey, feature::int AS feature, round({value}, 6) AS value FROM f JOIN s USING (feature)"""


def _sample_sql(value: str, stats: str) -> str:
    return f"""WITH f AS (SELECT vec_id, (i - 1)::int AS feature, embedding[i]::double AS v FROM embeddings, range(1, 65) t(i)),
        s AS (SELECT vec_id, {stats} FROM f GROUP BY vec_id)
        SELECT vec_id, feature, round({value}, 6) AS value FROM f JOIN s USING (vec_id)"""


def _or_one(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 1.0 ELSE {x} END"


_STEPS = base.SQL_PLACED + """,
steps AS (SELECT map_id, seq_id, ord, nid, r, c, lag(nid) OVER w AS pn, lag(r) OVER w AS pr, lag(c) OVER w AS pc
  FROM placed WHERE seq_id IS NOT NULL AND ord IS NOT NULL WINDOW w AS (PARTITION BY map_id, seq_id ORDER BY ord)),
tr AS (SELECT map_id, pn AS from_nid, nid AS to_nid, count(*) AS cnt FROM steps WHERE pn IS NOT NULL GROUP BY map_id, pn, nid)"""
_DWELL = _STEPS + """,
dwell AS (SELECT map_id, nid, count(*) AS n_samples, count(*) FILTER (pn IS NULL OR pn <> nid) AS n_stays FROM steps GROUP BY map_id, nid)"""
_WINDOWS = """win AS (SELECT window_id, any_value(signal) AS signal FROM signal_batch WHERE window_id IS NOT NULL GROUP BY window_id),
good AS (SELECT window_id, signal AS x, len(signal) AS n FROM win WHERE len(signal) > 0
  AND len(list_filter(signal, lambda v: v IS NOT NULL AND isfinite(v))) = len(signal)),
pts AS (SELECT window_id, n, i, x[i] AS v FROM good, range(1, 4097) t(i) WHERE i <= n)"""
_PSD = _WINDOWS + f""",
dft AS (SELECT p.window_id, p.n, k, sum(v * cos(2 * pi() * k * (i - 1) / p.n)) AS re, sum(v * sin(2 * pi() * k * (i - 1) / p.n)) AS im
  FROM pts p, range(0, 2049) t(k) WHERE k <= p.n // 2 GROUP BY p.window_id, p.n, k),
psd AS (SELECT window_id, n, k, k * (1.0::double / (n * (1.0::double / {RATE}::double))) AS f, (re * re + im * im) / n AS p FROM dft),
""" + (_TRAP := """trap AS (SELECT window_id, k, f, p, lead(f) OVER w AS f2, lead(p) OVER w AS p2, sum(p) OVER (PARTITION BY window_id ORDER BY k) AS cum,
  sum(p) OVER (PARTITION BY window_id) AS total FROM psd WINDOW w AS (PARTITION BY window_id ORDER BY k))""")
_SPECTRAL_AGG = """agg AS (SELECT window_id, coalesce(sum((f2 - f) * (p + p2) / 2), 0) AS spectral_power, arg_max(f, (p, -k)) AS dominant_frequency,
  CASE WHEN any_value(total) = 0 THEN 0 ELSE -sum(p / nullif(total, 0) * ln(p / nullif(total, 0) + 1e-12)) END AS spectral_entropy,
  coalesce(sum(f * p) / nullif(any_value(total), 0), 0) AS spectral_centroid,
  min(f) FILTER (cum >= 0.85::double * total) AS spectral_rolloff FROM trap GROUP BY window_id)"""


def oracle_sql() -> dict[str, str]:
    from ..functions.features import BANDS

    zscore = _norm_sql(f"(v - m) / ({_or_one('sd')})", "avg(v) AS m, stddev_pop(v) AS sd")
    l2 = _sample_sql(f"v / ({_or_one('q')})", "sqrt(sum(v * v)) AS q")
    bands = ",\n".join(
        f"round(coalesce(sum((f2 - f) * (p + p2) / 2) FILTER (f >= {lo} AND f2 <= {hi}), 0), 6) AS {b}_power" for b, (lo, hi) in BANDS.items())
    every = "SELECT w.window_id, {cols} FROM win w LEFT JOIN agg a ON a.window_id = w.window_id"
    stat = [*STATISTICAL]
    return {
        "norm_none": "SELECT vec_id, (i - 1)::int AS feature, embedding[i]::double AS value FROM embeddings, range(1, 65) t(i)",
        "norm_zscore": zscore, "norm_fwn": zscore,
        "norm_robust": _norm_sql(f"(v - m) / ({_or_one('(b - a)')})", "quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b"),
        "norm_01scale": _norm_sql(f"(v - a) / ({_or_one('(b - a)')})", "min(v) AS a, max(v) AS b"),
        "norm_zscore_sample": _sample_sql(f"(v - m) / ({_or_one('sd')})", "avg(v) AS m, stddev_pop(v) AS sd"),
        "norm_robust_sample": _sample_sql(f"(v - m) / ({_or_one('(b - a)')})", "quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b"),
        "norm_minmax_sample": _sample_sql(f"(v - a) / ({_or_one('(b - a)')})", "min(v) AS a, max(v) AS b"),
        "norm_l2": l2, "norm_euclidean": l2,
        "trajectory": f"WITH {base.SQL_PLACED} SELECT seq_id, ord, nid, r, c FROM placed WHERE seq_id IS NOT NULL AND ord IS NOT NULL",
        "trajectory_view": f"""WITH {base.SQL_PLACED}, p AS (SELECT seq_id, ord, nid, r, c,
              {', '.join(f"(('0x' || substr(md5('0,{salt},' || seq_id || ',' || ord), 1, 7))::bigint / {16 ** 7}.0::double * 2 - 1) * 0.12::double AS j{salt}" for salt in (1, 2))}
              FROM placed WHERE seq_id IS NOT NULL AND ord IS NOT NULL)
            SELECT seq_id, ord, nid, r, c, round(c + j1, 6) AS jx, round(r + j2, 6) AS jy FROM p""",
        "transitions": f"WITH {_STEPS} SELECT map_id, from_nid, to_nid, cnt, round(cnt / sum(cnt) OVER (PARTITION BY map_id, from_nid), 6) AS prob FROM tr",
        "path_metrics": f"""WITH {_STEPS} SELECT map_id, seq_id, count(*) AS n_samples,
            round(coalesce(avg((nid = pn)::int), 1.0), 6) AS stability, round(coalesce(avg(sqrt((r - pr) ** 2 + (c - pc) ** 2)), 0.0), 6) AS mean_path_length,
            round(coalesce(avg(greatest(abs(r - pr), abs(c - pc))) FILTER (pn IS NOT NULL), 0.0), 6) AS mean_chebyshev_jump,
            round(coalesce(avg((greatest(abs(r - pr), abs(c - pc)) <= 1)::int) FILTER (pn IS NOT NULL), 1.0), 6) AS temporal_coherence
            FROM steps GROUP BY map_id, seq_id""",
        "map_summary": f"""WITH {_STEPS}, k AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY cnt DESC, from_nid, to_nid) AS rank FROM tr),
            top AS (SELECT map_id, string_agg(from_nid || '>' || to_nid || ':' || cnt, ';' ORDER BY rank) AS top_steps FROM k WHERE rank <= 3 GROUP BY map_id)
            SELECT s.map_id, count(*) AS n_samples, count(DISTINCT nid) AS n_nodes, coalesce(any_value(top_steps), '') AS top_steps,
            round(coalesce(avg((nid = pn)::int), 1.0), 6) AS stability, round(coalesce(avg(sqrt((r - pr) ** 2 + (c - pc) ** 2)), 0.0), 6) AS mean_path_length,
            round(coalesce(avg(greatest(abs(r - pr), abs(c - pc))) FILTER (pn IS NOT NULL), 0.0), 6) AS mean_chebyshev_jump,
            round(coalesce(avg((greatest(abs(r - pr), abs(c - pc)) <= 1)::int) FILTER (pn IS NOT NULL), 1.0), 6) AS temporal_coherence
            FROM steps s LEFT JOIN top ON top.map_id = s.map_id GROUP BY s.map_id""",
        "dense_transitions": f"""WITH {_STEPS} SELECT a.map_id, a.nid AS from_nid, b.nid AS to_nid, coalesce(cnt, 0)::bigint AS cnt,
            round(coalesce(cnt / sum(cnt) OVER (PARTITION BY a.map_id, a.nid), 0), 6) AS prob
            FROM codebook a JOIN codebook b ON a.map_id = b.map_id LEFT JOIN tr ON tr.map_id = a.map_id AND tr.from_nid = a.nid AND tr.to_nid = b.nid""",
        "side_table": f"""WITH {base.SQL_PLACED}, side AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY map_id NULLS FIRST, station NULLS FIRST,
              period_s NULLS FIRST, n_expected NULLS FIRST) AS k FROM recordings WHERE seq_id IS NOT NULL)
            SELECT p.id, p.map_id, p.seq_id, p.nid, s.map_id AS map_id_side, station, period_s, n_expected
            FROM placed p LEFT JOIN side s ON s.seq_id = p.seq_id AND k = 1""",
        "signal_labels": """SELECT w.window_id, w.label_code, l.label FROM (SELECT window_id, any_value(label_code) AS label_code FROM signal_batch
            WHERE window_id IS NOT NULL GROUP BY window_id) w LEFT JOIN (SELECT label_code, min(label) AS label FROM waveform_labels GROUP BY label_code) l USING (label_code)""",
        "index_files": """SELECT index_name, index_year, index_month, round(index_value, 4) AS index_value FROM climate_index
            WHERE index_name IS NOT NULL AND index_year IS NOT NULL AND index_month IS NOT NULL AND index_value IS NOT NULL""",
        "feat_welch": f"""WITH {_WINDOWS},
            mean AS (SELECT window_id, CASE WHEN min(v) = max(v) THEN min(v) ELSE avg(v) END AS m FROM pts GROUP BY window_id),
            hann AS (SELECT p.window_id, n, i, CASE WHEN n > 1 THEN 0.5::double - 0.5::double * cos(2 * pi() * (i - 1) / n) ELSE 1.0 END AS h, v - m AS v FROM pts p JOIN mean USING (window_id)),
            scale AS (SELECT window_id, sum(h * h) AS w2 FROM hann GROUP BY window_id),
            dft AS (SELECT p.window_id, p.n, k, sum(h * v * cos(2 * pi() * k * (i - 1) / p.n)) AS re, sum(h * v * sin(2 * pi() * k * (i - 1) / p.n)) AS im
              FROM hann p, range(0, 2049) t(k) WHERE k <= p.n // 2 GROUP BY p.window_id, p.n, k),
            psd AS (SELECT window_id, n, k, k * (1.0::double / (n * (1.0::double / {RATE}::double))) AS f,
              CASE WHEN k > 0 AND (n % 2 = 1 OR k < n // 2) THEN 2 ELSE 1 END * (re * re + im * im) / ({RATE}::double * w2) AS p FROM dft JOIN scale USING (window_id)),
            {_TRAP}, {_SPECTRAL_AGG}
            {every.format(cols=", ".join(f"round({c}::double, 6) AS {c}" for c in SPECTRAL))}""",
        "top_transitions": f"""WITH {_STEPS}, k AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY cnt DESC, from_nid, to_nid)::int AS rank FROM tr)
            SELECT map_id, rank, from_nid, to_nid, cnt FROM k WHERE rank <= 10""",
        "dwell_times": f"WITH {_DWELL} SELECT map_id, nid, n_samples, n_stays, round(n_samples / n_stays, 6) AS mean_dwell FROM dwell",
        "dwell_map": f"""WITH {_DWELL} SELECT c.map_id, c.nid, c.r, c.c, round(coalesce(n_samples / n_stays, 0.0), 6) AS mean_dwell
            FROM codebook c LEFT JOIN dwell d ON d.map_id = c.map_id AND d.nid = c.nid""",
        "rank_correlation": f"""WITH {_STEPS}, s AS (SELECT map_id, pn, nid FROM steps WHERE pn IS NOT NULL),
            k AS (SELECT map_id, rank() OVER (PARTITION BY map_id ORDER BY pn) + (count(*) OVER (PARTITION BY map_id, pn) - 1) / 2.0::double AS ra,
              rank() OVER (PARTITION BY map_id ORDER BY nid) + (count(*) OVER (PARTITION BY map_id, nid) - 1) / 2.0::double AS rb FROM s)
            SELECT map_id, round(CASE WHEN min(ra) = max(ra) OR min(rb) = max(rb) THEN NULL ELSE corr(ra, rb) END, 6) AS spearman FROM k GROUP BY map_id""",
        "rolling_index": f"""SELECT index_name, index_year, index_month, round(avg(index_value) OVER (PARTITION BY index_name ORDER BY index_year, index_month
            ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM climate_index WHERE index_value IS NOT NULL AND index_value <> {MISSING}::double""",
        "index_ranks": f"""SELECT index_name, index_year, index_month, rank() OVER (PARTITION BY index_year, index_month ORDER BY index_value DESC)::int AS rank
            FROM climate_index WHERE index_value IS NOT NULL AND index_value <> {MISSING}::double""",
        "feat_statistical": f"""WITH {_WINDOWS},
            m AS (SELECT window_id, avg(v) AS m, CASE WHEN min(v) = max(v) THEN 0 ELSE stddev_pop(v) END AS s FROM pts GROUP BY window_id),
            d AS (SELECT window_id, v, i, n, v - lag(v) OVER w AS dv, sign(v) - sign(lag(v) OVER w) AS ds FROM pts WINDOW w AS (PARTITION BY window_id ORDER BY i)),
            agg AS (SELECT window_id, any_value(m) AS mean, any_value(s) AS std, any_value(s * s) AS var,
              CASE WHEN any_value(s) > 0 THEN avg((v - m) ** 3) / any_value(s) ** 3 ELSE 0 END AS skewness,
              CASE WHEN any_value(s) > 0 THEN avg((v - m) ** 4) / any_value(s) ** 4 - 3 ELSE 0 END AS kurtosis,
              sqrt(avg(v * v)) AS rms, max(v) - min(v) AS peak_to_peak,
              coalesce(sum(abs(ds)) / (2.0::double * nullif(any_value(n) - 1, 0)), 0) AS zero_crossing_rate, coalesce(sum(abs(dv)), 0) AS line_length
              FROM d JOIN m USING (window_id) GROUP BY window_id)
            {every.format(cols=", ".join(f"round({c}::double, 6) AS {c}" for c in stat))}""",
        "feat_hjorth": f"""WITH {_WINDOWS},
            d1 AS (SELECT window_id, i, v, v - lag(v) OVER w AS dv FROM pts WINDOW w AS (PARTITION BY window_id ORDER BY i)),
            d2 AS (SELECT *, dv - lag(dv) OVER (PARTITION BY window_id ORDER BY i) AS ddv FROM d1),
            var AS (SELECT window_id, CASE WHEN min(v) = max(v) THEN 0 ELSE var_pop(v) END AS v0, CASE WHEN count(dv) = 0 OR min(dv) = max(dv) THEN 0 ELSE var_pop(dv) END AS v1,
              CASE WHEN count(ddv) = 0 OR min(ddv) = max(ddv) THEN 0 ELSE var_pop(ddv) END AS v2 FROM d2 GROUP BY window_id),
            mob AS (SELECT *, CASE WHEN v0 > 0 THEN sqrt(v1 / v0) ELSE 0 END AS mobility, CASE WHEN v1 > 0 THEN sqrt(v2 / v1) ELSE 0 END AS inner_mobility FROM var),
            agg AS (SELECT window_id, v0 AS hjorth_activity, mobility AS hjorth_mobility, CASE WHEN mobility > 0 THEN inner_mobility / mobility ELSE 0 END AS hjorth_complexity FROM mob)
            {every.format(cols=", ".join(f"round({c}::double, 6) AS {c}" for c in COMPLEXITY[:3]))}""",
        "feat_sample_entropy": f"""WITH {_WINDOWS},
            tol AS (SELECT window_id, 0.2::double * CASE WHEN min(v) = max(v) THEN 0 ELSE stddev_pop(v) END AS tol FROM pts GROUP BY window_id),
            cand AS (SELECT g.window_id, g.n, i, j, greatest(abs(x[i] - x[j]), abs(x[i + 1] - x[j + 1])) AS d2, abs(x[i + 2] - x[j + 2]) AS d3, tol
              FROM good g JOIN tol USING (window_id), range(1, 4097) a(i), range(1, 4097) b(j) WHERE j <= n - 2 AND i < j),
            cnt AS (SELECT window_id, count(*) FILTER (d2 < tol) AS b, count(*) FILTER (j <= n - 3 AND d2 < tol AND d3 < tol) AS a FROM cand GROUP BY window_id),
            agg AS (SELECT g.window_id, CASE WHEN coalesce(b, 0) = 0 THEN 0 WHEN a = 0 THEN NULL ELSE -ln(a::double / b) END AS e FROM good g LEFT JOIN cnt USING (window_id))
            {every.format(cols="round(e, 6) AS sample_entropy")}""",
        "feat_spectral": f"""WITH {_PSD}, {_SPECTRAL_AGG}
            {every.format(cols=", ".join(f"round({c}::double, 6) AS {c}" for c in SPECTRAL))}""",
        "feat_band_power": f"""WITH {_PSD}, agg AS (SELECT window_id, {bands} FROM trap GROUP BY window_id)
            {every.format(cols=", ".join(f"{c}::double AS {c}" for c in BAND_POWERS))}""",
    }
