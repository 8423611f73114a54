"""Best and second-best matching units of every sample.

The codebook is small (a grid of nodes) and travels with the task; samples are never
shuffled. Ties go to the smallest node number. Two plans give the same answer:

* ``native``: the codebook as one literal array, distances as array expressions; the two
  smallest (distance, node) structs are the answer. Stays in the JVM.
* ``arrow``: blocks of samples against the codebook in NumPy; the faster one for wide
  codebooks, and the plan for distances whose expression is costly.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import distances
from ..plans import lookup_join, materialize
from .normalize import Normalizer

#: Doubles that one block of differences may hold.
BLOCK = 4_000_000
BMU_SCHEMA = "nid int, dist double, nid2 int, dist2 double"


def codebook_column(codebook: DataFrame) -> DataFrame:
    """A ``nid, w`` table as one row with one array, in the order of the nodes."""
    return codebook.groupBy().agg(
        F.array_sort(F.collect_list(F.struct(F.col("nid").alias("nid"), F.col("w").cast("array<double>").alias("w")))).alias("__nodes"))


def bmu_native(samples: DataFrame, features: str, codebook: DataFrame, distance: str = "euclidean", band: int | None = None) -> DataFrame:
    """``samples`` with ``nid, dist, nid2, dist2``; ``codebook`` (``nid, w``) has the nodes
    of one map, a few thousand at most, and is broadcast as a single row."""
    expr = distances.get(distance, band).expr
    scored = F.array_sort(F.transform("__nodes", lambda n: F.struct(expr(F.col(features), n["w"]).alias("d"), n["nid"].alias("nid"))))
    return (
        samples.join(F.broadcast(codebook_column(codebook)))
        .withColumn("__top", F.slice(scored, 1, 2)).drop("__nodes")
        .withColumns({
            "nid": F.get("__top", F.lit(0))["nid"], "dist": F.get("__top", F.lit(0))["d"],
            "nid2": F.get("__top", F.lit(1))["nid"], "dist2": F.get("__top", F.lit(1))["d"]})
        .drop("__top")
    )


def top_two(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and second smallest of every row, first position on ties. NaN rows, as a
    NaN sample has, give nodes 0 and 1 at distance NaN."""
    rows = np.arange(len(scores))
    one = np.argmin(scores, axis=1)
    d1 = scores[rows, one]
    rest = scores.copy()
    rest[rows, one] = np.inf
    two = np.argmin(rest, axis=1)
    return one, d1, two, rest[rows, two]


#: Nodes per sample that are measured exactly after an estimate.
CLOSEST = 4
#: Pairs of a sample and a node whose warping is worked on at once.
PAIRS = 4_096


def best_two(distance: distances.Distance, x: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """(first row, :func:`top_two`) of blocks of samples.

    Euclidean distances are estimated by one matrix product, and exact, as the kernel has
    them, for the closest few nodes; a sample whose next node could be as close, or that
    is not finite, is measured against all nodes. So the result is the kernel's. For dtw see
    :func:`_best_two_warped`.
    """
    if distance.name == "dtw" and distance.band is None and len(w) > 2 * CLOSEST and x.shape[1] == w.shape[1] >= 8:
        yield from _best_two_warped(distance, x, w)
        return
    if distance.name != "euclidean" or len(w) <= 2 * CLOSEST:
        for at, scores in block_scores(distance.kernel, x, w):
            yield at, top_two(scores)
        return
    middle = w.mean(0)
    near_w = w - middle
    w2 = (near_w * near_w).sum(1)
    step = max(1, BLOCK // len(w))
    for at in range(0, len(x), step):
        block = x[at:at + step]
        near_x = block - middle
        with np.errstate(invalid="ignore", over="ignore"):
            estimate = w2 - 2.0 * (near_x @ near_w.T)
            few = np.sort(np.argpartition(estimate, CLOSEST - 1, axis=1)[:, :CLOSEST], axis=1)
            exact = np.sqrt(((block[:, None, :] - w[few]) ** 2).sum(axis=2))
            order = np.argsort(exact, axis=1, kind="stable")[:, :2]
            nodes, found = np.take_along_axis(few, order, 1), np.take_along_axis(exact, order, 1)
            rows = np.arange(len(block))
            last = np.take_along_axis(estimate, few, 1).max(1)
            error = 1e-9 * ((near_x * near_x).sum(1) + w2.max())
            doubtful = np.flatnonzero(~(last - estimate[rows, nodes[:, 1]] > error))
        one, d1, two, d2 = nodes[:, 0].copy(), found[:, 0].copy(), nodes[:, 1].copy(), found[:, 1].copy()
        for start, scores in block_scores(distance.kernel, block[doubtful], w):
            some = doubtful[start:start + len(scores)]
            one[some], d1[some], two[some], d2[some] = top_two(scores)
        yield at, (one, d1, two, d2)


def _best_two_warped(distance: distances.Distance, x: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """:func:`best_two` by dtw, which is at most the Euclidean distance.

    The nodes that are closest by that one are measured exactly; the second of them bounds
    what can be among the two best. In single precision, less what its rounding may add, the
    beginnings and ends of the other nodes' paths, and then the whole of those that are left,
    drop what is beyond; the rest is measured exactly. Samples that are not finite, or too
    large for single precision, are measured against all nodes.
    """
    n, half, centre = x.shape[1], x.shape[1] // 2, w.mean()
    turned, narrow = np.ascontiguousarray(w.T), np.ascontiguousarray((w - centre).T, np.float32)
    square, reach = ((w - centre) ** 2).sum(1), np.abs(w - centre).max()

    def exact(of: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for k in range(0, len(row), PAIRS):
            out[k:k + PAIRS] = np.sqrt(distances.warped(of[row[k:k + PAIRS]].T, turned[:, node[k:k + PAIRS]]))
        return out

    step, few_rows = max(1, BLOCK // (8 * len(w))), max(1, PAIRS // len(w))
    for at in range(0, len(x), step):
        block = x[at:at + step]
        with np.errstate(invalid="ignore", over="ignore"):
            scale = np.abs(block - centre).max(1) + reach
        fits = scale < 1e15
        found = [np.zeros(len(block), t) for t in (np.int64, float, np.int64, float)]
        odd = np.flatnonzero(~fits)
        for start, scores in block_scores(distance.kernel, block[odd], w):
            for out, part in zip(found, top_two(scores)):
                out[odd[start:start + len(scores)]] = part
        use = np.flatnonzero(fits)
        if len(use):
            mine, scale = block[use], scale[use]
            few = np.argpartition(square - 2.0 * ((mine - centre) @ (w - centre).T), CLOSEST - 1, axis=1)[:, :CLOSEST]
            row, node = np.repeat(np.arange(len(mine)), CLOSEST), few.ravel()
            known = exact(mine, row, node)
            second = np.partition(known.reshape(-1, CLOSEST), 1, axis=1)[:, 1]
            limit = ((second * (1 + 2.4e-7 * n) + 2.4e-7 * (2 * n) ** 0.5 * scale) ** 2).astype(np.float32)
            short = np.ascontiguousarray((mine - centre).T, np.float32)
            maybe = np.empty((len(mine), len(w)), bool)
            for k in range(0, len(mine), few_rows):
                a, b = short[:, k:k + few_rows, None], narrow[:, None, :]
                least = distances.warped(a, b, half) + distances.warped(a[::-1], b[::-1], half)
                maybe[k:k + few_rows] = least <= limit[k:k + few_rows, None]
            np.put_along_axis(maybe, few, False, 1)
            others, nodes = np.nonzero(maybe)
            near = np.empty(len(others), bool)
            for k in range(0, len(others), PAIRS):
                some = others[k:k + PAIRS]
                near[k:k + PAIRS] = distances.warped(short[:, some], narrow[:, nodes[k:k + PAIRS]]) <= limit[some]
            others, nodes = others[near], nodes[near]
            row, node, known = (np.concatenate(p) for p in ((row, others), (node, nodes), (known, exact(mine, others, nodes))))
            order = np.lexsort((node, known, row))
            first = order[np.searchsorted(row[order], np.arange(len(mine)))]
            next_ = order[np.searchsorted(row[order], np.arange(len(mine))) + 1]
            for out, part in zip(found, (node[first], known[first], node[next_], known[next_])):
                out[use] = part
        yield at, tuple(found)


def block_scores(kernel, x: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, BLOCK // max(1, w.size))
    for at in range(0, len(x), step):
        yield at, kernel(x[at:at + step], w)


def bmu_arrow(samples: DataFrame, features: str, weights: np.ndarray, distance: str = "euclidean",
              band: int | None = None, normalizer=None) -> DataFrame:
    """``samples`` with ``nid, dist, nid2, dist2`` by NumPy blocks; ``weights`` is [nodes, d].

    A null sample has null results. With ``normalizer`` samples are normalised in the same
    pass. Works alike on streams.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema) + ", " + BMU_SCHEMA
    names = [*samples.columns, "nid", "dist", "nid2", "dist2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = distances.get(distance, band)
        for batch in batches:
            column = batch.column(features)
            valid = np.flatnonzero(np.asarray(column.is_valid()))
            flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
            x = flat.reshape(len(valid), weights.shape[1])
            if normalizer is not None:
                x = normalizer.apply_numpy(x)
            out = [np.zeros(batch.num_rows, t) for t in (np.int32, float, np.int32, float)]
            for at, best in best_two(measure, x, weights):
                for column_, part in zip(out, best):
                    column_[valid[at:at + len(part)]] = part
            null = np.ones(batch.num_rows, bool)
            null[valid] = False
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o, mask=null) for o in out)], names)

    return samples.mapInArrow(run, schema)


#: Nodes of all maps together that are broadcast as arrays (16 doubles each: 26 MB).
MAX_NODES = 200_000
#: Samples that one task scores at once where codebooks are too many to broadcast.
GROUP_ROWS = 100_000


def bmu_by_map(samples: DataFrame, features: str, codebook: DataFrame, by: str, item: str,
               distance: str = "euclidean", band: int | None = None, max_nodes: int = MAX_NODES, keep: list[str] | None = None) -> DataFrame:
    """``samples`` with ``nid, dist, nid2, dist2``, each against the codebook of its own map.

    ``codebook`` has ``by, nid, w`` and may have ``distance``, the name of the map's own (null:
    ``distance``), and ``normalization`` with ``centre`` and ``scale``, the map's way to
    normalise samples, which its weights go through as well (null: none). ``keep`` are the samples' columns that go on, all of them by default. Up to ``max_nodes`` nodes travel to the tasks as arrays
    and no sample is shuffled; beyond, samples meet their map's nodes in groups of
    (map, salt), as many salts as a map needs to stay near ``GROUP_ROWS``.
    Samples must be complete and finite; samples of unknown maps are left out.
    """
    keep = samples.columns if keep is None else keep
    names = [*keep, "nid", "dist", "nid2", "dist2"]
    schema = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in keep) + ", " + BMU_SCHEMA

    def score(block: pa.Table, nodes: dict) -> pa.Table:
        coded = block[by].combine_chunks().dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        vectors = block[features].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = vectors.reshape(block.num_rows, -1) if block.num_rows else vectors
        out, rows = [[] for _ in range(4)], []
        for code, key in enumerate(coded.dictionary.to_pylist()):
            if key not in nodes:
                continue
            nids, w, name, normalizer = nodes[key]
            mine = order[starts[code]:starts[code + 1]]
            for _, (one, d1, two, d2) in best_two(distances.get(name, band), normalizer.apply_numpy(vectors[mine]), w):
                for o, part in zip(out, (nids[one], d1, nids[two], d2)):
                    o.append(part)
            rows.append(mine)
        picked = block.select(keep).take(pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
        columns = [np.concatenate(o) if o else np.zeros(0) for o in out]
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.float64())
        return pa.table([*picked.columns, *(pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds))], names=names)

    def table_of(rows) -> dict:
        found: dict = {}
        for key, *node in rows:
            found.setdefault(key, []).append(node)
        out = {}
        for key, of_map in found.items():
            of_map.sort(key=lambda node: node[0])
            _, _, name, method, centre, scale = of_map[0]
            normalizer = Normalizer(method, {"centre": centre, "scale": scale})
            out[key] = np.array([n[0] for n in of_map], np.int32), normalizer.apply_numpy(np.array([n[1] for n in of_map], float)), name, normalizer
        return out

    def given(column: str, otherwise: Column) -> Column:
        return (F.coalesce(column, otherwise) if column in codebook.columns else otherwise).alias(column)

    nothing = F.lit(None).cast("array<double>")
    columns = (by, "nid", "w", "distance", "normalization", "centre", "scale")
    nodes = codebook.select(by, "nid", "w", given("distance", F.lit(distance)), given("normalization", F.lit("none")), given("centre", nothing), given("scale", nothing))
    if nodes.count() <= max_nodes:
        shared = samples.sparkSession.sparkContext.broadcast(table_of(nodes.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from score(pa.Table.from_batches([batch]), shared.value).to_batches()

        return samples.mapInArrow(run, schema)

    salts = F.ceil(F.col("count") / F.lit(GROUP_ROWS)).cast("int").alias("__salts")
    many = materialize(samples.groupBy(by).count().where(F.col("count") > GROUP_ROWS).select(by, salts), "map-salts")
    of_map = F.coalesce("__salts", F.lit(1))
    spread = lookup_join(samples, many, [by], "left", salt_by=item)
    spread = spread.withColumn("__salt", F.pmod(F.xxhash64(item), of_map).cast("int")).drop("__salts")
    repeated = lookup_join(nodes, many, [by], "left", salt_by="nid")
    repeated = repeated.withColumn("__salt", F.explode(F.sequence(F.lit(0), of_map - 1))).drop("__salts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = zip(*(right[c].to_pylist() for c in columns))
        return score(left.drop_columns(["__salt"]), table_of(rows))

    return spread.groupBy(by, "__salt").cogroup(repeated.groupBy(by, "__salt")).applyInArrow(meet, schema)
