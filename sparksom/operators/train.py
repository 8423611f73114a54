"""Training of self-organizing maps.

Online training is a fold: every presentation changes the weights that the next one
sees, so it has no parallel form. What scales is everything around it. The schedule of
presentations is drawn first, so that only the rows it names (at most ``period``) are
fetched, by a join on the row number; the fold then runs over those. The batch variant
(``algorithm="batch"``) is the trainer for large data: each epoch is one pass that finds
every sample's node and one small aggregate per node.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import distances
from ..plans import materialize, release
from . import grid
from .bmu import MAX_NODES, best_two, block_scores, bmu_arrow, top_two
from .normalize import Normalizer

WEIGHTS = ("random", "random_negative", "sample", "PCA")


def number_rows(df: DataFrame, *order: str, out: str = "row") -> DataFrame:
    """The columns ``order`` with consecutive row numbers from 0 in their total order.

    Rows are sorted by range, so a partition holds a stretch of the order; the numbers
    start at the count of rows in the partitions before. No window spans the table, and
    only the columns of the order, which should be narrow, are sorted and written.
    """
    kept = materialize(df.select(*order).sort(*order).withColumn("__p", F.spark_partition_id()), "rows")
    sizes = sorted((r["__p"], r["count"]) for r in kept.groupBy("__p").count().collect())  # a row per partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    firsts = df.sparkSession.createDataFrame(starts, "__p int, __first bigint")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    numbered = kept.join(F.broadcast(firsts), "__p").withColumn(out, (F.col("__first") + inside - 1).cast("bigint")).drop("__p", "__first")
    numbered._sparksom_path = kept._sparksom_path  # for release()
    return numbered


class SomModel:
    """A trained map: weights [k*k, d], how samples are normalised, and all parameters."""

    def __init__(self, params: dict, weights: np.ndarray, normalizer: Normalizer, rng: np.random.Generator | None = None):
        self.params = dict(params)
        self.weights = np.asarray(weights, float)
        self.normalizer = normalizer
        self.rng = rng if rng is not None else np.random.default_rng(params.get("random_seed"))

    @property
    def size(self) -> int:
        return self.params["size"]

    def winner(self):
        """How training picks the winner among weights ``w`` for a sample ``x``."""
        kernel = distances.get(self.params["distance"], self.params.get("dtw_band")).kernel
        return lambda w, x: int(np.argmin(kernel(x[None, :], w)[0]))

    def codebook(self, spark: SparkSession) -> DataFrame:
        """``nid, r, c, w``: one row per node."""
        k = self.size
        rows = [(i, i // k, i % k, [float(v) for v in w]) for i, w in enumerate(self.weights)]
        return spark.createDataFrame(rows, "nid int, r int, c int, w array<double>")

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Samples normalised, with their two best nodes: ``nid, dist, nid2, dist2, r, c, r2, c2``."""
        normal = df.withColumn(features, self.normalizer.apply(F.col(features).cast("array<double>")))
        scored = bmu_arrow(normal, features, self.weights, self.params["distance"], self.params.get("dtw_band"))
        return with_positions(scored, self.size)

    # -- persistence: every parameter, so that a loaded map behaves like the saved one --

    def to_json(self) -> str:
        return json.dumps({"model": [{
            **self.params, "weights": self.weights.tolist(), "normalizer": {"method": self.normalizer.method, "params": self.normalizer.params}}]})

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as JSON text to any file system that Spark reaches."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SomModel":
        """Reads a saved model, of our layout or of the one that names the side ``map_size`` and
        the normalisation's numbers ``norm_params`` and has the weights by row and column. Of
        several entries the last counts, of recurrent maps' the first. A missing path is an
        AnalysisException."""
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        entries = json.loads(text)["model"]
        temporal = "context_weight" in entries[0]
        entry = dict(entries[0] if temporal else entries[-1])
        weights = np.array(entry.pop("weights"), float)
        if "map_size" in entry:
            entry["size"] = entry.pop("map_size")
            numbers = entry.pop("norm_params", {})
            entry = {"dtw_band": None, "lr_decay": "linear", "normalization": "none", "weights_init": "random", "random_seed": None,
                     "initial_neighbourhood": entry["neighbourhood"], **({"presentation": "sequential", "context_influence": 0.5} if temporal else {}), **entry}
            normalizer = Normalizer(entry["normalization"], Normalizer.params_of(numbers))
        else:
            normal = entry.pop("normalizer")
            normalizer = Normalizer(normal["method"], normal["params"])
        return (TemporalSomModel if temporal else SomModel)(entry, weights.reshape(entry["size"] ** 2, -1), normalizer)


def with_positions(scored: DataFrame, size: int) -> DataFrame:
    """Row and column of both nodes."""
    row = lambda n: F.floor(F.col(n) / F.lit(size)).cast("int")
    return scored.withColumns({"r": row("nid"), "c": F.col("nid") % size, "r2": row("nid2"), "c2": F.col("nid2") % size})


class _Rows:
    """Samples (``id, x``) by their number in the order of ``id``; equal ids by their vector's hash."""

    def __init__(self, data: DataFrame):
        self.data = data
        self.numbered: DataFrame | None = None

    def fetch(self, drawn: np.ndarray) -> np.ndarray:
        """The samples of the drawn row numbers, in that order; only these reach the driver.

        Ids and hashes are numbered; a vector is read again for the drawn ones alone.
        """
        keyed = self.data.select("id", F.xxhash64("x").alias("h"), "x")
        if self.numbered is None:
            self.numbered = number_rows(keyed, "id", "h")
        wanted = self.data.sparkSession.createDataFrame([(int(i),) for i in np.unique(drawn)], "row bigint")
        places = {r["row"]: (r["id"], r["h"]) for r in self.numbered.join(F.broadcast(wanted), "row").collect()}  # at most as many as drawn
        kind = self.data.schema["id"].dataType.simpleString()
        names = F.broadcast(self.data.sparkSession.createDataFrame(sorted(set(places.values()), key=str), f"id2 {kind}, h2 bigint"))
        rows = keyed.join(names, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))).drop("id2", "h2")
        found = {(r["id"], r["h"]): r["x"] for r in rows.dropDuplicates(["id", "h"]).collect()}
        return np.array([found[places[int(i)]] for i in drawn], float)

    def release(self) -> None:
        release(self.numbered)
        self.numbered = None


class SomEstimator:
    """Parameters of a map; ``fit`` trains it on an array column and returns a :class:`SomModel`.

    ``period`` counts single presentations, not passes. ``presentation`` "sequential" takes
    the rows in the order of ``order``; anything else draws them at random. The random
    stream (weights first, then one draw per presentation) is replayable by
    ``random_seed``. Samples must be finite: a null, NaN or infinite component is a
    ValueError. All parameters are checked at construction.
    """

    def __init__(self, size: int | None = None, period: int = 10, initial_lr: float = 0.1, initial_neighbourhood: float = 0,
                 distance: str = "euclidean", dtw_band: int | None = None, use_decay: bool = False, lr_decay: str = "linear",
                 normalization: str = "none", presentation: str = "random", weights: str = "random",
                 random_seed: int | None = None, algorithm: str = "online"):
        if period <= 1:
            raise ValueError("period must be greater than 1")
        if not 0 < initial_lr < 1:
            raise ValueError("initial_lr must lie between 0 and 1")
        if size is not None and size < 2:
            raise ValueError("size must be at least 2")
        distances.get(distance, dtw_band)
        if weights not in WEIGHTS:
            raise ValueError(f"unknown weights {weights!r}; available: {', '.join(WEIGHTS)}")
        if algorithm not in ("online", "batch"):
            raise ValueError("algorithm must be online or batch")
        Normalizer(normalization)
        self.params = dict(
            size=size, period=int(period), initial_lr=float(initial_lr), initial_neighbourhood=initial_neighbourhood, distance=distance,
            dtw_band=dtw_band, use_decay=use_decay, lr_decay=lr_decay, normalization=normalization, presentation=presentation,
            weights_init=weights, random_seed=random_seed)
        self.algorithm = algorithm

    def _model(self, params: dict, weights: np.ndarray, normalizer: Normalizer, rng) -> SomModel:
        return SomModel(params, weights, normalizer, rng)

    def fit(self, df: DataFrame, features: str = "features", order: str = "id") -> SomModel:
        p = dict(self.params)
        data = df.select(F.col(order).alias("id"), F.col(features).cast("array<double>").alias("x"))
        normalizer = Normalizer(p["normalization"]).fit(data, "x")
        data = data.withColumn("x", normalizer.apply(F.col("x")))
        odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        total, bad = data.agg(F.count(F.lit(1)), F.count(F.when(F.col("x").isNull() | odd, 1))).first()
        if bad:
            raise ValueError(f"{bad} samples are null or have non-finite components")
        if not total:
            raise ValueError("no samples to train on")
        p["num_data"] = total
        p["size"] = p["size"] or grid.vesanto_size(total)
        p["neighbourhood"] = p["initial_neighbourhood"] or p["size"]
        rng = np.random.default_rng(p["random_seed"])
        rows = _Rows(data)
        weights = self._initial(rows, p, rng)
        model = self._model(p, weights, normalizer, rng)
        if self.algorithm == "batch":
            model.weights = batch_epochs(data, "x", weights, p)
        else:
            final = 1 if p["use_decay"] else 0
            model.weights = _present(rows, model, p["initial_lr"], p["neighbourhood"], final)
        rows.release()
        return model

    def _initial(self, rows: _Rows, p: dict, rng: np.random.Generator) -> np.ndarray:
        k2, n = p["size"] ** 2, p["num_data"]
        d = rows.data.select(F.size("x")).first()[0]
        p["input_data_dimension"] = d
        if p["weights_init"] == "random":
            return rng.random(d * k2).reshape(k2, d)
        if p["weights_init"] == "random_negative":
            return rng.uniform(-1, 1, d * k2).reshape(k2, d)
        if p["weights_init"] == "sample":
            drawn = rng.choice(n, size=k2, replace=True)
            return rows.fetch(drawn)
        return pca_weights(rows.data, "x", d, p["size"])


def pca_weights(rows: DataFrame, x: str, d: int, size: int) -> np.ndarray:
    """A plane along the two main directions of the data, one unit each way.

    The d x d products are one aggregation; the directions come from them on the driver.
    The sign of a direction is fixed: its largest component is positive.
    """
    if d < 2:
        raise ValueError("PCA needs at least two features")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            m = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            n, total, products = n + len(m), total + m.sum(0), products + m.T @ m
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [total.tolist()], "p": [products.ravel().tolist()]})

    parts = rows.select(x).mapInArrow(moments, "n bigint, s array<double>, p array<double>")
    summed = parts.select("n", F.posexplode(F.concat("s", "p")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    flat = {r["i"]: r["v"] for r in summed.collect()}  # d + d * d numbers
    n = parts.agg(F.sum("n")).first()[0]
    mean = np.array([flat[i] for i in range(d)]) / n
    cov = np.array([flat[d + i] for i in range(d * d)]).reshape(d, d) / n - np.outer(mean, mean)
    _, vectors = np.linalg.eigh(cov)
    axes = [v * (1 if v[np.argmax(np.abs(v))] > 0 else -1) for v in (vectors[:, -1], vectors[:, -2])]
    steps = np.linspace(-1, 1, size)
    return (steps[:, None, None] * axes[0] + steps[None, :, None] * axes[1]).reshape(size * size, d)


def _present(rows: _Rows, model: SomModel, rate: float, sigma: float, final: float, winner=None) -> np.ndarray:
    """One online phase: the fold over the scheduled samples."""
    p, n = model.params, model.params["num_data"]
    period = p["period"]
    if p["presentation"] == "sequential":
        drawn = np.arange(period) % n
    else:
        drawn = model.rng.integers(0, n, size=period)
    return fold_online(rows.fetch(drawn), model, rate, sigma, final, winner)


def fold_online(samples: np.ndarray, model: SomModel, rate: float, sigma: float, final: float, winner=None) -> np.ndarray:
    """The weights after presenting ``samples`` one after the other."""
    p, k = model.params, model.size
    nodes = np.arange(k * k)
    row, col = nodes // k, nodes % k
    w, mode, total = model.weights.copy(), p["lr_decay"], len(samples)
    winner = winner or model.winner()
    for t, x in enumerate(samples, 1):
        best = winner(w, x)
        eta = grid.learning_rate(rate, t, total, mode)
        v = grid.radius(sigma, t, total, final, mode)
        away = distances.grid_kernel(p["distance"], row, col, row[best], col[best])
        h = grid.gaussian(away, v) if p["use_decay"] else grid.bubble(away, v)
        w += eta * h[:, None] * (x - w)
    return w


def reinforce(model: SomModel, df: DataFrame, reinforcement: int = 0, extension: float = 1, compression: float = 0.5,
              features: str = "features", order: str = "id") -> SomModel:
    """Further online rounds on (new) data; returns the refined model.

    Each round multiplies the period by ``extension`` and the rate by ``compression``; the
    radius decays to 1, from the neighbourhood in the first round and from 1 in later
    ones. No rounds leave the map as it is.
    """
    if not reinforcement:
        return model
    data = df.select(F.col(order).alias("id"), model.normalizer.apply(F.col(features).cast("array<double>")).alias("x"))
    rows = _Rows(data)
    after = type(model)({**model.params, "num_data": data.count()}, model.weights, model.normalizer, model.rng)
    rate, sigma = model.params["initial_lr"], model.params["neighbourhood"]
    winner = after.winner()  # a recurrent map's context starts anew once, not per round
    for _ in range(reinforcement):
        after.params["period"] = int(after.params["period"] * extension)
        rate *= compression
        after.weights = _present(rows, after, rate, sigma, 1, winner)
        sigma = 1
    rows.release()
    after.params["num_data"] = model.params["num_data"]
    return after


def batch_epochs(data: DataFrame, x: str, weights: np.ndarray, p: dict, epochs: int = 10) -> np.ndarray:
    """Batch training: per epoch one pass, one row per (partition, node) in the shuffle.

    Each map task adds up count and sum of its samples per node; the driver receives one
    row per node and moves every node to the kernel-weighted mean of all sums. The radius
    falls from the neighbourhood to 1/2 over the epochs. Nodes without influence stay.
    """
    k, d = p["size"], weights.shape[1]
    nodes = np.arange(k * k)
    row, col = nodes // k, nodes % k
    away = np.stack([distances.grid_kernel(p["distance"], row, col, r, c) for r, c in zip(row, col)])
    w = weights.copy()
    for epoch in range(epochs):
        n, s = node_sums(data, x, w, p["distance"], p.get("dtw_band"))
        sigma = max(0.5, p["neighbourhood"] / 2 * (1 - epoch / epochs))
        h = grid.gaussian(away, sigma)
        mass = h @ n
        w = np.where(mass[:, None] > 1e-12, (h @ s) / np.where(mass > 1e-12, mass, 1)[:, None], w)
    return w


def node_sums(data: DataFrame, x: str, weights: np.ndarray, distance: str, band: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the samples per best node, combined in the map tasks."""
    k2, d = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = distances.get(distance, band)
        n, s = np.zeros(k2, np.int64), np.zeros((k2, d))
        for batch in batches:
            m = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for at, (best, *_) in best_two(measure, m, weights):
                n += np.bincount(best, minlength=k2)
                np.add.at(s, best, m[at:at + len(best)])
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"nid": hit.astype(np.int32), "n": n[hit], "s": s[hit].tolist()})

    parts = data.select(x).mapInArrow(run, "nid int, n bigint, s array<double>")
    sums = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(d)]
    n, s = np.zeros(k2), np.zeros((k2, d))
    for r in parts.groupBy("nid").agg(F.sum("n").alias("n"), *sums).collect():  # a row per node
        n[r["nid"]], s[r["nid"]] = r["n"], r[2:]
    return n, s


# -- recurrent maps -----------------------------------------------------------------------


def context_winner(kernel, alpha: float, beta: float, state: dict):
    """Winner by ``(1 - beta) * signal + beta * distance to the context``; the context then
    moves to the winner's weights, ``alpha`` of it staying. ``state`` holds it."""
    def winner(w: np.ndarray, x: np.ndarray) -> int:
        return context_step(kernel(x[None, :], w)[0], alpha, beta, state, w)[0]

    return winner


def context_step(signal: np.ndarray, alpha: float, beta: float, state: dict, w: np.ndarray) -> tuple:
    """One step: both best nodes by the combined distance, each with its signal and its
    combined distance, as ``node, signal, combined`` twice. Moves the context."""
    context, scores = state.get("context"), signal
    if context is not None and beta > 0:
        scores = (1.0 - beta) * signal + beta * np.sqrt(((w - context) ** 2).sum(1))
    one, d1, two, d2 = (v[0] for v in top_two(scores[None, :]))
    state["context"] = w[one].copy() if context is None else alpha * context + (1.0 - alpha) * w[one]
    return int(one), float(signal[one]), float(d1), int(two), float(signal[two]), float(d2)


class TemporalSomModel(SomModel):
    """A recurrent map; ``transform`` scores each sequence in its order with a context of its own."""

    def winner(self):
        """A winner with a fresh context, kept from presentation to presentation."""
        kernel = distances.get(self.params["distance"], self.params.get("dtw_band")).kernel
        return context_winner(kernel, self.params["context_weight"], self.params["context_influence"], {})

    def transform(self, df: DataFrame, features: str = "features", sequence: str = "seq_id", order: str = "ord",
                  initial_context: list[float] | None = None) -> DataFrame:
        """As the plain map's, sequence by sequence: the best nodes are those of the combined
        distance (``combined``, ``combined2``), ``dist`` and ``dist2`` their signal distances.

        A sequence is an ordered recurrence, so it is scored in one task, streaming through
        it in batches: the memory a task needs doesn't depend on a sequence's length.
        """
        normal = df.withColumn(features, self.normalizer.apply(F.col(features).cast("array<double>")))
        scored = temporal_bmu(normal, features, self.weights, self.params, sequence, order, initial_context)
        return with_positions(scored, self.size)


CONTEXT_SCHEMA = "nid int, dist double, combined double, nid2 int, dist2 double, combined2 double"


def temporal_bmu(df: DataFrame, features: str, weights: np.ndarray | DataFrame, params: dict, sequence: str, order: str,
                 initial_context: list[float] | None = None, by: str | None = None, max_nodes: int = MAX_NODES) -> DataFrame:
    """``df`` with :data:`CONTEXT_SCHEMA`, a context per sequence.

    ``weights`` is one map's array, or with ``by`` a codebook of many (``by, nid, w``, nodes
    numbered from 0), of which a sequence uses one. Rows of one sequence are one task's, in
    batches; a codebook of more than ``max_nodes`` nodes isn't broadcast, but meets the
    sequences of its maps, which are then in memory as a whole. A null sample has null
    results and leaves the context; so have the rows of a map without nodes.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + CONTEXT_SCHEMA
    kinds = (pa.int32(), pa.float64(), pa.float64()) * 2
    names = [*df.columns, *(part.split()[0] for part in CONTEXT_SCHEMA.split(", "))]
    alpha, beta = params["context_weight"], params["context_influence"]
    distance, band = params["distance"], params.get("dtw_band")

    def score(batches, books: dict) -> Iterator[pa.RecordBatch]:
        kernel = distances.get(distance, band).kernel
        current, state = object(), {}
        for batch in batches:
            out: list[tuple] = [(None,) * 6] * batch.num_rows
            keys = batch.column(by).to_pylist() if by else [None] * batch.num_rows
            sequences = batch.column(sequence).to_pylist()
            rows = np.flatnonzero(np.asarray(batch.column(features).is_valid()))
            x = batch.column(features).drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
            at = 0
            while at < len(rows):  # stretches of rows with the same weights
                key, end = keys[rows[at]], at + 1
                while end < len(rows) and keys[rows[end]] == key:
                    end += 1
                w = books.get(key)
                for start, signals in block_scores(kernel, x[at:end], w) if w is not None else ():
                    for i, signal in zip(rows[at + start:], signals):
                        if sequences[i] != current:
                            current, state = sequences[i], {} if initial_context is None else {"context": np.array(initial_context, float)}
                        out[i] = context_step(signal, alpha, beta, state, w)
                at = end
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((),) * 6, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    def books_of(rows) -> dict:
        found: dict = {}
        for key, nid, w in rows:
            found.setdefault(key, []).append((nid, w))
        return {k: np.array([w for _, w in sorted(v)], float) for k, v in found.items()}

    if isinstance(weights, DataFrame):
        nodes = weights.select(by, "nid", "w")
        if nodes.count() > max_nodes:
            used = df.select(F.col(sequence).alias("__seq"), F.col(by).alias("__by")).distinct().join(nodes.withColumnRenamed(by, "__by"), "__by")

            def meet(left: pa.Table, right: pa.Table) -> pa.Table:
                books = books_of(zip(*(right[c].to_pylist() for c in ("__by", "nid", "w"))))
                return pa.Table.from_batches(score(left.sort_by(order).combine_chunks().to_batches(), books))

            return df.groupBy(sequence).cogroup(used.groupBy("__seq")).applyInArrow(meet, schema)
        weights = books_of(nodes.collect())
    shared = df.sparkSession.sparkContext.broadcast(weights if by else {None: weights})
    placed = df.repartition(sequence).sortWithinPartitions(sequence, order)
    return placed.mapInArrow(lambda batches: score(batches, shared.value), schema)


class TemporalSomEstimator(SomEstimator):
    """A recurrent map: ``context_weight`` of the old context stays in each step,
    ``context_influence`` is its share in the distance. Presents samples in their order."""

    def __init__(self, context_weight: float = 0.5, context_influence: float = 0.5, **params):
        for name, value in (("context_weight", context_weight), ("context_influence", context_influence)):
            if not 0 <= value <= 1:
                raise AssertionError(f"{name} must lie between 0 and 1")
        super().__init__(**{**params, "presentation": "sequential"})
        self.params.update(context_weight=context_weight, context_influence=context_influence)

    def _model(self, params, weights, normalizer, rng) -> SomModel:
        return TemporalSomModel(params, weights, normalizer, rng)


# -- size search --------------------------------------------------------------------------


def size_range(n: int, min_size: int = 2, max_size: int | None = None) -> range:
    """Sizes around the recommendation for ``n`` samples."""
    v = grid.vesanto_size(n)
    return range(max(min_size, v - 2), (v + 2 if max_size is None else min(max_size, v + 2)) + 1)


def search_sizes(df: DataFrame, period: int, initial_lr: float, sizes=None, random_seed: int | None = None,
                 validation: DataFrame | None = None, features: str = "features", order: str = "id", **params) -> tuple[dict, int | None]:
    """A map per size (seed + i), and the size of the least quantization error on the
    validation data (the training data without it); the first wins on ties."""
    import warnings

    from .quality import quantization_error

    if validation is None:
        warnings.warn("sizes are compared on the training data; pass validation data to avoid that", stacklevel=2)
    models, best, least = {}, None, float("inf")
    for i, size in enumerate(sizes if sizes is not None else size_range(df.count())):
        seed = None if random_seed is None else random_seed + i
        model = SomEstimator(size=size, period=period, initial_lr=initial_lr, random_seed=seed, **params).fit(df, features, order)
        models[size] = model
        qe = quantization_error(model.transform(df if validation is None else validation, features)).first()["quantization_error"]
        if qe < least:
            best, least = size, qe
    return models, best
