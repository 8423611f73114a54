"""Relations that several queries start from, in Spark and in SQL."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import distances
from ..operators.bmu import bmu_by_map
from ..operators.normalize import SAMPLE_METHODS
from ..plans import lookup_join
from ..sources import read_table, records, records_in_place

DIMS = 16
#: A codebook with weights is broadcast up to this many nodes (some 20 MB).
MAX_WIDE_ROWS = 100_000


def complete(column: str) -> Column:
    """Whether an array has all its components, each finite."""
    return (F.size(column) == DIMS) & F.forall(column, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))


def deliveries(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Deliveries of records with a complete sample vector: ``id, map_id, data`` and more
    columns; an id may come several times."""
    names = dict.fromkeys(["id", "map_id", "data", *columns])
    return read_table(spark, sf_dir, "classification_map", *names).where(F.col("id").isNotNull() & complete("data"))


def samples(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Records with a complete sample vector, each once, in their place: no vector is shuffled."""
    names = dict.fromkeys(["map_id", "data", *columns])
    return records_in_place(spark, sf_dir, *names).where(complete("data"))


def placed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Records on a valid position, with their node ``nid, r, c`` (r = x, c = y). Numbers are
    deduplicated by a hash aggregate; with a text, which it can't hold, records stay in place."""
    nodes = read_table(spark, sf_dir, "codebook", "map_id", F.col("r").alias("x"), F.col("c").alias("y"), "nid")
    once = records_in_place if "label" in columns else records
    rows = once(spark, sf_dir, *dict.fromkeys(["map_id", "x", "y", *columns]))
    return lookup_join(rows, nodes, ["map_id", "x", "y"], "inner", salt_by="id").withColumnsRenamed({"x": "r", "y": "c"})


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of complete samples on a valid position with the weights ``w`` of their node."""
    nodes = read_table(spark, sf_dir, "codebook", "map_id", F.col("r").alias("x"), F.col("c").alias("y"), "nid", "w")
    return lookup_join(deliveries(spark, sf_dir, "x", "y"), nodes, ["map_id", "x", "y"], "inner", salt_by="id", max_broadcast_rows=MAX_WIDE_ROWS)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``map_id, size`` by the codebook itself."""
    return read_table(spark, sf_dir, "codebook", "map_id", "r").groupBy("map_id").agg((F.max("r") + 1).cast("int").alias("size"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "codebook", "map_id", "nid", "r", "c")


def scored(spark: SparkSession, sf_dir: str, distance: str = "euclidean", own: bool = False, normalized: bool = False) -> DataFrame:
    """Records with a complete sample, their two best nodes on their own map and both positions.

    Deliveries are scored where they lie; what is shuffled, to count each record once, are
    an id and the result. ``own`` takes each map's own distance, as ``trained_map`` has it,
    ``normalized`` its own normalisation as well.
    """
    book = read_table(spark, sf_dir, "codebook", "map_id", "nid", "w")
    if own:
        book = book.join(own_distances(spark, sf_dir), "map_id", "left")
    if normalized:
        book = book.join(own_normalizations(spark, sf_dir), "map_id", "left")
    best = bmu_by_map(deliveries(spark, sf_dir), "data", book, "map_id", "id", distance, keep=["id", "map_id"]).dropDuplicates(["id"])
    return _positions(spark, sf_dir, best)


def scored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`scored`, with the samples' vectors ``data``."""
    book = read_table(spark, sf_dir, "codebook", "map_id", "nid", "w")
    return _positions(spark, sf_dir, bmu_by_map(samples(spark, sf_dir), "data", book, "map_id", "id"))


def own_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``map_id, distance``: the maps' distances by their registered names; Euclidean where a
    map names none or an unknown one."""
    name = F.lower(F.trim("distance"))
    known = F.when(name.isin(*distances.available()), name).otherwise(F.lit("euclidean"))
    return read_table(spark, sf_dir, "trained_map", "map_id", known.alias("distance")).dropDuplicates(["map_id"])


#: Names of normalisations in ``trained_map`` that the registry has under another.
NORMALIZATIONS = {"zscore_feature": "zscore", "minmax_feature": "01scale", "robust_feature": "robust"}


def own_normalizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``map_id, normalization, centre, scale``: the maps' normalisations, those per feature
    fitted to the map's complete records; none where a map names none or an unknown one, or
    has no record to fit. A row per map; records are combined before anything is shuffled."""
    name = F.lower(F.trim("normalization"))
    for given, ours in NORMALIZATIONS.items():
        name = F.when(name == given, F.lit(ours)).otherwise(name)
    known = F.when(name.isin("zscore", "fwn", "01scale", *SAMPLE_METHODS), name).otherwise(F.lit("none"))
    methods = read_table(spark, sf_dir, "trained_map", "map_id", known.alias("normalization")).dropDuplicates(["map_id"])
    cells = [F.get("data", F.lit(i)) for i in range(DIMS)]
    fits = [[f(c).alias(f"{n}{i}") for i, c in enumerate(cells)] for n, f in (("m", F.avg), ("s", F.stddev_pop), ("a", F.min), ("b", F.max))]
    stats = samples(spark, sf_dir).groupBy("map_id").agg(*[c for fit in fits for c in fit])
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    range_ = F.col("normalization") == "01scale"
    centre = F.when(range_, F.array(*[f"a{i}" for i in range(DIMS)])).otherwise(F.array(*[f"m{i}" for i in range(DIMS)]))
    scale = F.when(range_, F.array(*[one(F.col(f"b{i}") - F.col(f"a{i}")) for i in range(DIMS)])).otherwise(F.array(*[one(F.col(f"s{i}")) for i in range(DIMS)]))
    fitted = methods.join(stats, "map_id", "left").select("map_id", "normalization", centre.alias("centre"), scale.alias("scale"), F.col("m0").isNotNull().alias("fits"))
    method = F.when(F.col("fits") | F.col("normalization").isin(*SAMPLE_METHODS), F.col("normalization")).otherwise(F.lit("none"))
    return fitted.select("map_id", method.alias("normalization"), "centre", "scale")


def _positions(spark: SparkSession, sf_dir: str, best: DataFrame) -> DataFrame:
    side = sizes(spark, sf_dir)
    joined = lookup_join(best, side, ["map_id"], "inner", salt_by="id")
    row = lambda n: F.floor(F.col(n) / F.col("size")).cast("int")
    return joined.withColumns({"r": row("nid"), "c": F.col("nid") % F.col("size"), "r2": row("nid2"), "c2": F.col("nid2") % F.col("size")})


SQL_RECORDS = """rec AS (SELECT id, any_value(map_id) AS map_id, any_value(seq_id) AS seq_id, any_value(ord) AS ord, any_value(label) AS label,
  any_value(data) AS data, any_value(x) AS x, any_value(y) AS y, any_value(dist) AS dist, any_value(ts) AS ts
  FROM classification_map WHERE id IS NOT NULL GROUP BY id)"""
SQL_SAMPLES = SQL_RECORDS + """,
samp AS (SELECT * REPLACE (list_transform(data, lambda v: coalesce(v, 0.0)) AS data) FROM rec WHERE len(data) = 16 AND len(list_filter(data, lambda v: v IS NOT NULL AND isfinite(v))) = 16)"""
SQL_WEIGHED = SQL_SAMPLES + """,
weighed AS (SELECT samp.*, c.nid, c.w FROM samp JOIN codebook c ON samp.map_id = c.map_id AND samp.x = c.r AND samp.y = c.c)"""
SQL_PLACED = SQL_RECORDS + """,
placed AS (SELECT rec.*, c.nid, c.r, c.c FROM rec JOIN codebook c ON rec.map_id = c.map_id AND rec.x = c.r AND rec.y = c.c)"""
SQL_PAIRS = SQL_SAMPLES + """,
pairs AS (SELECT s.id, s.map_id, s.label, c.nid, c.r, c.c, list_distance(s.data, c.w) AS d
  FROM samp s JOIN codebook c ON s.map_id = c.map_id)"""
SQL_RANKED = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS k FROM pairs),
scored AS (SELECT a.id, a.map_id, a.label, a.nid, a.d AS dist, a.r, a.c, b.nid AS nid2, b.d AS dist2, b.r AS r2, b.c AS c2
  FROM ranked a JOIN ranked b ON a.id = b.id AND a.k = 1 AND b.k = 2)"""
SQL_SCORED = SQL_PAIRS + SQL_RANKED
