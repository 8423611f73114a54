"""Training: schedules, kernels, single steps (checked by SQL), and whole fits."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import grid
from ..operators.quality import quantization_error
from ..operators.train import SomEstimator, SomModel, TemporalSomEstimator, reinforce, search_sizes, temporal_bmu as recurrent_scores
from ..plans import checkpoint_dir, delete, lookup_join, materialize
from ..sources import read_table
from . import base

T, RATE, SIGMA = 1000, 0.5, 8.0


def _schedule(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = grid.schedule(spark, T, RATE, SIGMA, 1.0, mode)
        return s.select("t", F.round("lr", 9).alias("lr"), F.round("radius", 9).alias("radius"))

    return query


def grid_kernels(spark, sf_dir):
    """Influence of every map's middle node on its others, by both kernels and grid distances."""
    from ..functions.distances import grid_distance

    mid = base.sizes(spark, sf_dir).withColumn("m", F.floor(F.col("size") / 2).cast("int"))
    joined = base.nodes(spark, sf_dir).join(mid, "map_id")
    dr, dc = F.col("r") - F.col("m"), F.col("c") - F.col("m")
    euclid, cheb = grid_distance("euclidean", dr, dc), grid_distance("chebyshev", dr, dc)
    return joined.select("map_id", "nid", F.round(grid.kernel_col(euclid, 2.0, True), 9).alias("gaussian"),
                         grid.kernel_col(euclid, 2.0, False).alias("bubble"), grid.kernel_col(cheb, 2.0, False).alias("bubble_chebyshev"))


def recommended_sizes(spark, sf_dir):
    n = base.deliveries(spark, sf_dir).select("id", "map_id").dropDuplicates(["id"]).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("map_id", "n", grid.vesanto_size_col(F.col("n")).alias("size"))


def online_step(spark, sf_dir):
    """One online step on every map: its record of smallest id is presented, with rate 0.5
    and a Gaussian radius of 2."""
    s = base.scored(spark, sf_dir).select("map_id", "id", F.col("r").alias("br"), F.col("c").alias("bc"))
    first = s.groupBy("map_id").agg(F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in ("br", "bc")])
    first = materialize(first, "first-records")  # a row per map
    vectors = lookup_join(base.deliveries(spark, sf_dir).select("id", "data"), first.select("id"), ["id"]).dropDuplicates(["id"])
    first = first.join(vectors, "id").drop("id")
    book = read_table(spark, sf_dir, "codebook").join(first, "map_id")
    g2 = (F.col("r") - F.col("br")) * (F.col("r") - F.col("br")) + (F.col("c") - F.col("bc")) * (F.col("c") - F.col("bc"))
    h = F.lit(0.5) * F.exp(-g2.cast("double") / 8.0)
    moved = F.zip_with("w", "data", lambda w, x: w + h * (x - w))
    return book.select("map_id", "nid", F.posexplode(moved).alias("feature", "w")).withColumn("w", F.round("w", 6))


def batch_epoch(spark, sf_dir):
    """One batch epoch on every map: kernel-weighted means of the node sums, radius 2. Samples
    are combined per node before anything is shuffled; then nodes meet nodes of their map."""
    sums = base.scored_vectors(spark, sf_dir).groupBy("map_id", F.col("r").alias("br"), F.col("c").alias("bc")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("data", F.lit(i))).alias(f"s{i}") for i in range(base.DIMS)])
    pairs = base.nodes(spark, sf_dir).join(sums, "map_id")
    g2 = (F.col("r") - F.col("br")) * (F.col("r") - F.col("br")) + (F.col("c") - F.col("bc")) * (F.col("c") - F.col("bc"))
    pairs = pairs.withColumn("h", F.exp(-g2.cast("double") / 8.0))
    mass = F.sum(F.col("h") * F.col("n"))
    means = pairs.groupBy("map_id", "nid").agg(mass.alias("mass"), *[(F.sum(F.col("h") * F.col(f"s{i}")) / mass).alias(f"w{i}") for i in range(base.DIMS)])
    return means.where("mass > 1e-9").select("map_id", "nid", F.posexplode(F.array(*[f"w{i}" for i in range(base.DIMS)])).alias("feature", "w")).withColumn("w", F.round("w", 5))


# -- whole fits: not expressible in SQL, checked against an independent NumPy version in tests --


def _embeddings(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def _codebook(model: SomModel, spark) -> DataFrame:
    return model.codebook(spark).select("nid", "r", "c", F.posexplode("w").alias("feature", "w"))


def fit_online(spark, sf_dir):
    return _codebook(SomEstimator(size=6, period=500, initial_lr=0.5, use_decay=True, weights="sample", random_seed=42).fit(_embeddings(spark, sf_dir)), spark)


def fit_pca(spark, sf_dir):
    return _codebook(SomEstimator(size=6, period=200, weights="PCA", normalization="zscore", lr_decay="asymptotic", random_seed=1).fit(_embeddings(spark, sf_dir)), spark)


def fit_batch(spark, sf_dir):
    rows = base.samples(spark, sf_dir).select("id", F.col("data").alias("features"))
    return _codebook(SomEstimator(size=8, weights="sample", random_seed=7, algorithm="batch").fit(rows), spark)


def fit_reinforced(spark, sf_dir):
    data = _embeddings(spark, sf_dir)
    model = SomEstimator(size=5, period=200, random_seed=3, presentation="sequential").fit(data)
    return _codebook(reinforce(model, data, reinforcement=2, extension=2), spark)


#: Context of the recurrent scoring of the recorded maps.
CONTEXT = {"context_weight": 0.6, "context_influence": 0.3, "distance": "euclidean"}


def _temporal(initial_context: list[float] | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Recordings scored with a context, each on its own map's codebook."""
        rows = base.samples(spark, sf_dir, "seq_id", "ord").where("seq_id is not null and ord is not null")
        book = read_table(spark, sf_dir, "codebook", "map_id", "nid", "w")
        scored = recurrent_scores(rows, "data", book, CONTEXT, "seq_id", "ord", initial_context, by="map_id").where("nid is not null")
        return scored.select("id", "seq_id", "ord", "nid", "nid2", F.round("dist", 6).alias("dist"), F.round("combined", 6).alias("combined"))

    return query


def fit_temporal(spark, sf_dir):
    """A recurrent map fitted to the records, which it then scores recording by recording."""
    rows = base.samples(spark, sf_dir, "seq_id", "ord").where("seq_id is not null and ord is not null").select("id", "seq_id", "ord", F.col("data").alias("features"))
    model = TemporalSomEstimator(size=5, period=300, weights="sample", random_seed=5, context_influence=0.3).fit(rows)
    return model.transform(rows).select("id", "seq_id", "ord", "nid", "nid2", F.round("dist", 6).alias("dist"))


def size_search(spark, sf_dir):
    models, best = search_sizes(_embeddings(spark, sf_dir), 200, 0.5, range(3, 6), 11, validation=_embeddings(spark, sf_dir))
    rows = [(k, k == best, quantization_error(m.transform(_embeddings(spark, sf_dir))).first()["quantization_error"]) for k, m in models.items()]
    return spark.createDataFrame(rows, "size int, best boolean, quantization_error double")


def model_roundtrip(spark, sf_dir):
    """A model saved as JSON, loaded again, and used."""
    model = SomEstimator(size=4, period=100, normalization="robust", random_seed=2).fit(_embeddings(spark, sf_dir))
    path = f"{checkpoint_dir(spark)}/sparksom/model-{uuid.uuid4().hex}"
    model.save(spark, path)
    loaded = SomModel.load(spark, path)
    delete(spark, path)
    return loaded.transform(_embeddings(spark, sf_dir)).select("id", "nid", "nid2", F.round("dist", 6).alias("dist"))


def queries() -> dict:
    plain = (grid_kernels, recommended_sizes, online_step, batch_epoch, fit_online, fit_pca, fit_batch, fit_reinforced, fit_temporal, size_search, model_roundtrip)
    return {"temporal_bmu": _temporal(), "temporal_bmu_initial": _temporal([0.5] * base.DIMS), "schedule_linear": _schedule("linear"), "schedule_asymptotic": _schedule("asymptotic"), **{f.__name__: f for f in plain}}


def _temporal_sql(first: str) -> str:
    """A recursion along each recording; ``first`` is the context before its first record."""
    mixed = f"list_transform(ws, lambda w: {1 - CONTEXT['context_influence']}::double * list_distance(data, w) + {CONTEXT['context_influence']}::double * list_distance(ctx, w))"
    alone = "list_transform(ws, lambda w: list_distance(data, w))"
    keep = CONTEXT["context_weight"]
    return f"""WITH RECURSIVE {base.SQL_SAMPLES},
        books AS (SELECT map_id, list(w ORDER BY nid) AS ws FROM codebook GROUP BY map_id),
        seqs AS (SELECT s.id, s.map_id, s.seq_id, s.ord, s.data, row_number() OVER (PARTITION BY s.seq_id ORDER BY s.ord) AS k
          FROM samp s JOIN books USING (map_id) WHERE s.seq_id IS NOT NULL AND s.ord IS NOT NULL),
        walk(seq_id, k, id, ord, one, two, dist, combined, ctx) AS (
          SELECT DISTINCT seq_id, 0::bigint, NULL::bigint, NULL::int, NULL::bigint, NULL::bigint, NULL::double, NULL::double, {first} FROM seqs
          UNION ALL
          SELECT seq_id, k, id, ord, one, list_position(rest, list_min(rest))::bigint, list_distance(data, ws[one]), least,
            CASE WHEN ctx IS NULL THEN ws[one] ELSE list_transform(list_zip(ctx, ws[one]), lambda t: {keep}::double * t[1] + {1 - keep}::double * t[2]) END
          FROM (SELECT *, list_transform(scores, lambda v, i: CASE WHEN i = one THEN 'infinity'::double ELSE v END) AS rest
            FROM (SELECT *, list_position(scores, list_min(scores))::bigint AS one, list_min(scores) AS least
              FROM (SELECT q.*, b.ws, w.ctx, CASE WHEN w.ctx IS NULL THEN {alone} ELSE {mixed} END AS scores
                FROM walk w JOIN seqs q ON q.seq_id = w.seq_id AND q.k = w.k + 1 JOIN books b ON b.map_id = q.map_id) a) b) c)
        SELECT id, seq_id, ord, (one - 1)::int AS nid, (two - 1)::int AS nid2, round(dist, 6) AS dist, round(combined, 6) AS combined FROM walk WHERE k > 0"""


def oracle_sql() -> dict[str, str]:
    side = "side AS (SELECT map_id, max(r) + 1 AS size FROM codebook GROUP BY map_id)"
    return {
        "temporal_bmu": _temporal_sql("NULL::double[]"),
        "temporal_bmu_initial": _temporal_sql(f"[0.5::double for i in range({base.DIMS})]"),
        "schedule_linear": f"SELECT t, round({RATE}::double * (1 - t / {T + 1}::double), 9) AS lr, round(1 + {SIGMA}::double * (1 - t / {T}::double), 9) AS radius FROM range(1, {T + 1}) r(t)",
        "schedule_asymptotic": f"SELECT t, round({RATE}::double / (1 + t / {T / 2}::double), 9) AS lr, round(1 + {SIGMA}::double / (1 + t / {T / 2}::double), 9) AS radius FROM range(1, {T + 1}) r(t)",
        "grid_kernels": f"""WITH {side} SELECT map_id, nid, round(exp(-((r - size // 2) ** 2 + (c - size // 2) ** 2) / 8.0::double), 9) AS gaussian,
            ((r - size // 2) ** 2 + (c - size // 2) ** 2 <= 4)::int::double AS bubble, (greatest(abs(r - size // 2), abs(c - size // 2)) <= 2)::int::double AS bubble_chebyshev
            FROM codebook JOIN side USING (map_id)""",
        "recommended_sizes": f"WITH {base.SQL_SAMPLES} SELECT map_id, count(*) AS n, greatest(2, round_even(sqrt(5 * sqrt(count(*)::double)), 0)::int) AS size FROM samp GROUP BY map_id",
        "online_step": f"""WITH {base.SQL_SCORED}, f AS (SELECT map_id, arg_min(id, id) AS id, arg_min(r, id) AS br, arg_min(c, id) AS bc FROM scored GROUP BY map_id),
            x AS (SELECT f.*, samp.data FROM f JOIN samp ON samp.id = f.id)
            SELECT c.map_id, c.nid, (i - 1)::int AS feature, round(w[i] + 0.5::double * exp(-((c.r - br) ** 2 + (c.c - bc) ** 2) / 8.0::double) * (data[i] - w[i]), 6) AS w
            FROM codebook c JOIN x ON x.map_id = c.map_id CROSS JOIN range(1, 17) t(i)""",
        "batch_epoch": f"""WITH {base.SQL_SCORED}, s AS (SELECT b.map_id, b.r AS br, b.c AS bc, i, count(*) AS n, sum(data[i]) AS s
              FROM scored b JOIN samp ON samp.id = b.id CROSS JOIN range(1, 17) t(i) GROUP BY b.map_id, b.r, b.c, i),
            h AS (SELECT c.map_id, c.nid, s.i, exp(-((c.r - br) ** 2 + (c.c - bc) ** 2) / 8.0::double) AS h, n, s FROM codebook c JOIN s ON s.map_id = c.map_id)
            SELECT map_id, nid, (i - 1)::int AS feature, round(sum(h * s) / sum(h * n), 5) AS w FROM h GROUP BY map_id, nid, i HAVING sum(h * n) > 1e-9""",
    }
