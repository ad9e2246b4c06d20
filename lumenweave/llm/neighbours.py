"""Approximate nearest neighbours by shifted space-filling curves.

Largest inner product becomes nearness by one more coordinate: a vector x of norm up to M is indexed as
(x, sqrt(M^2 - |x|^2)), a query as its multiple of norm M.  Every curve projects these onto ``AXES`` random
orthogonal directions, cuts each direction at its sampled quantiles after a random shift, and orders the
cells of that grid by a Hilbert curve.  A row's place on a curve is the share of sampled keys up to its own.

The windows are fitted to the data, not to the table: ``CALIBRATE`` queries get their true neighbours by a
scan of all rows, and for every number of curves the half-width is taken at which ``TARGET`` of these
neighbours lie in a window of some curve; the cheapest choice wins.  Where vectors have structure this is a few
curves and a sliver of each, however large the table; a window is at least one of ``MAX_RANGES`` ranges.  Where
they have none it tends to the whole curve, and never costs more products than an exact scan, since one curve
with a window over everything is among the choices (figures in the README).

Sampled places cut a curve into ranges of an eighth of the half-width; Spark deals rows out by range, and a
query goes to all ranges that its window touches.  What the windows find merges and is reranked by the exact
inner product on the original vectors.  Ranges and their queries are split into blocks of ``BLOCK`` rows by
counts per range, so a task's memory grows neither with the table nor with a key that many rows share.  Equal
vectors are indexed once with their 21 smallest ids, which is exact for 20 neighbours, so a vector that fills a
third of the table is one row.  The directions, quantiles and places are fitted on a hash sample of ``SAMPLE``
vectors at most; every row is indexed.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite parts take
no part; ties go to the smaller vec_id; rows that repeat a vec_id and vector count once; a row never finds its
own vec_id; fewer candidates than asked for give fewer rows; an empty table gives an empty table; a score that
overflows is infinite, and one whose sum is undefined (both infinities) counts as minus infinity; other columns
are never read.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import column
from .common import save

log = logging.getLogger(__name__)

CURVES, AXES, BITS = 12, 8, 8
#: Queries whose true neighbours set the windows, and the share of these that windows must hold.
CALIBRATE, TARGET, MAX_RANGES = 128, 0.95, 4096
TOP, SAMPLE, BLOCK, SEED = 20, 20_000, 8192, 97


def hilbert_keys(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates below 2**bits.

    From the highest bit down, the coordinates' bits walk the curve's Gray code, and reflections and
    exchanges with the first axis turn the sub-cube into the curve's standard position.
    """
    x = grid.astype(np.uint64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, rest = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & rest)
            x[0] ^= np.where(high, rest, swap)
            x[i] ^= swap if i else np.uint64(0)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & np.uint64(1), np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


class Curves:
    """Fitted curves: the places of vectors and of queries, as shares of the table."""

    def __init__(self, sample: np.ndarray, norm: float, curves: int = CURVES, axes: int = AXES):
        self.norm = norm
        rng = np.random.default_rng(SEED)
        dim = sample.shape[1] + 1
        axes = min(axes, dim)
        x = self.lift(sample)
        self.parts = []
        for _ in range(curves):
            axis = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :axes]
            shift = rng.random(axes)
            cuts = np.quantile(x @ axis, np.linspace(0, 1, 1 << (BITS - 1)), axis=0)
            self.parts.append((axis, shift, cuts, np.sort(self._keys(x, axis, shift, cuts))))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))[:, None]])

    def _keys(self, x: np.ndarray, axis: np.ndarray, shift: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        y = x @ axis
        grid = np.empty(y.shape, np.int64)
        for i in range(y.shape[1]):  # the rank among the quantiles, shifted: both halves of the range are reached
            grid[:, i] = np.searchsorted(cuts[:, i], y[:, i]) + shift[i] * (len(cuts) - 1)
        return hilbert_keys(np.minimum(grid, (1 << BITS) - 1))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        """The place of each vector on each curve (rows, curves)."""
        return self._places(self.lift(x))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return self._places(np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))]))

    def _places(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(keys, self._keys(x, *rest), side="right") / len(keys) for *rest, keys in self.parts], axis=1)


def windows(places: np.ndarray, found: np.ndarray, target: float = TARGET) -> tuple[int, float, float]:
    """Number of curves, half-width and expected products per query and row, from the places of queries and of their true neighbours."""
    apart = np.minimum.accumulate(np.abs(places - found), axis=1)
    best = (1, 1.0, 1.0)
    for c in range(apart.shape[1]):
        w = float(np.quantile(apart[:, c], target, method="higher"))
        cost = (c + 1) * (2 * w - w * w)
        if cost < best[2]:
            best = (c + 1, w, cost)
    return best


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added in the order of the components."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * x[:, i]
    return np.where(np.isnan(out), -np.inf, out)


def selected(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``q`` and of ``x`` of all pairs that can be among a query's ``k`` largest products, whatever the rounding."""
    top = max(np.abs(q).max(), np.abs(x).max(), 1e-300)
    q, x = q / top, x / top
    slack = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    found = []
    for i in range(0, len(q), 512):
        near = q[i : i + 512] @ x.T
        least = np.partition(near, len(x) - k, axis=1)[:, len(x) - k]
        a, c = np.nonzero(near >= (least - slack[i : i + 512])[:, None])
        found.append((i + a, c))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = F.col("embedding")
    rows = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull()).select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (size[0]["d"] if size else 0))


def _matrix(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def fitted_windows(units: DataFrame, shipped, reps: np.ndarray, asked: np.ndarray, top: int) -> tuple[int, float, float]:
    """Curves, half-width and cost of windows that hold the true neighbours of the queries ``asked`` (rows ``reps``)."""

    def nearest(batches):
        """The nearest rows of a partition for each query, with their places: a bounded list, renewed with every batch."""
        curves, kept = shipped.value, None
        for b in batches:
            if b.num_rows == 0:
                continue
            rep, x = column(b, "rep").to_numpy(), _matrix(column(b, "v"))
            a, c = selected(asked, x, min(top + 1, len(x)))
            fresh = [a, rep[c], exact_products(asked[a], x[c]), c]
            other = fresh[1] != reps[fresh[0]]
            a, r, score, c = (z[other] for z in fresh)
            used, back = np.unique(c, return_inverse=True)
            places = curves.of_vectors(x[used])[back] if len(used) else np.empty((0, len(curves.parts)))
            now = (a, r, score, places) if kept is None else tuple(np.concatenate(z) for z in zip(kept, (a, r, score, places), strict=True))
            order = np.lexsort((now[1], -now[2], now[0]))
            rank = np.arange(len(order)) - np.searchsorted(now[0][order], now[0][order])
            kept = tuple(z[order[rank < top]] for z in now)
        if kept is not None and len(kept[0]):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept[0]) + 1, dtype=np.int32) * kept[3].shape[1]), pa.array(kept[3].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), pa.array(kept[1]), pa.array(kept[2]), lists], ["q", "rep", "score", "places"])

    rows = units.select("rep", "v").mapInArrow(nearest, "q int, rep long, score double, places array<double>")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    rows = rows.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= top).select("q", "places").collect()  # CALIBRATE * top rows
    if not rows:
        return 1, 1.0, 1.0
    places = shipped.value.of_queries(asked)
    return windows(places[[r["q"] for r in rows]], np.array([r["places"] for r in rows]))


def search(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """For each row that ``is_query`` (a Column of vec_id) selects: query_id, rank, vec_id, score."""
    rows = usable(vectors).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    few = Window.partitionBy("h1", "h2").orderBy("vec_id")
    some = rows.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("i", F.row_number().over(few)).filter(F.col("i") <= top + 1)
    units = some.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    asked = rows.filter(is_query).select("h1", "h2", F.col("vec_id").alias("query_id")).distinct()
    units = save(units.join(asked.select("h1", "h2").distinct().withColumn("asked", F.lit(True)), ["h1", "h2"], "left"), "ann-units")
    n, n_asked, biggest = units.select(F.count(F.lit(1)), F.count("asked"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n or not n_asked:
        return vectors.sparkSession.createDataFrame([], schema)
    # Norms by way of the largest component, so that no square overflows.
    norm = biggest * units.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(biggest)) * (x / F.lit(biggest)))))).first()[0]
    hashed = F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.lit(1 << 30))
    chosen = lambda rows, most, of: rows if most >= of else rows.filter(hashed < int(most / of * (1 << 30)))
    curves = Curves(np.array([r["v"] for r in chosen(units, SAMPLE, n).select("rep", "v").orderBy("rep").collect()] or [units.select("v").first()["v"]]), norm)
    shipped = vectors.sparkSession.sparkContext.broadcast(curves)
    probes = units.filter("asked").select("rep", "v", hashed.alias("h")).orderBy("h", "rep").limit(CALIBRATE).collect()
    n_curves, half, cost = fitted_windows(units, shipped, np.array([r["rep"] for r in probes]), np.array([r["v"] for r in probes]), top)
    log.info("%d curves, windows of %.4f on both sides, %.3f products expected per query and row", n_curves, half, cost)
    ranges = int(np.clip(np.ceil(8 / max(half, 1e-9)), 1, MAX_RANGES))

    def deal(batches):
        curves = shipped.value
        for b in batches:
            if b.num_rows:
                x, asked = _matrix(column(b, "v")), column(b, "asked").is_valid().to_numpy(zero_copy_only=False)
                cell = lambda at: np.clip((at * ranges).astype(np.int32), 0, ranges - 1)
                places, low, high = cell(curves.of_vectors(x)[:, :n_curves]), np.zeros((len(x), n_curves), np.int32), np.full((len(x), n_curves), -1, np.int32)
                if asked.any():
                    at = curves.of_queries(x[asked])[:, :n_curves]
                    low[asked], high[asked] = cell(at - half), cell(at + half)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n_curves), pa.array(r.reshape(-1))) for r in (places, low, high)]
                yield pa.RecordBatch.from_arrays([column(b, "rep"), column(b, "v"), column(b, "asked"), *lists], ["rep", "v", "asked", "cells", "low", "high"])

    dealt = units.select("rep", "v", "asked").mapInArrow(deal, "rep long, v array<double>, asked boolean, cells array<int>, low array<int>, high array<int>")
    held = dealt.select("rep", "v", F.lit(False).alias("asks"), F.posexplode("cells").alias("curve", "cell"))
    asks = dealt.filter("asked").select("rep", "v", F.posexplode(F.arrays_zip("low", "high")).alias("curve", "z"))
    asks = asks.select("rep", "v", F.lit(True).alias("asks"), "curve", F.explode(F.sequence("z.low", "z.high")).alias("cell"))
    both = held.select("asks", "curve", "cell").unionByName(asks.select("asks", "curve", "cell"))
    of = lambda c: F.ceil(F.count(F.when(c, 1)) / BLOCK).cast("int")
    # At most CURVES * MAX_RANGES rows.  A range without rows or without queries needs no task.
    cells = save(both.groupBy("curve", "cell").agg(of(~F.col("asks")).alias("blocks"), of(F.col("asks")).alias("q_blocks")).filter("blocks > 0 and q_blocks > 0"), "ann-cells")
    block = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "rep"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    held = held.join(F.broadcast(cells), ["curve", "cell"]).withColumn("b", block(1, "blocks")).withColumn("qb", every("q_blocks"))
    asks = asks.join(F.broadcast(cells), ["curve", "cell"]).withColumn("qb", block(2, "q_blocks")).withColumn("b", every("blocks"))

    def window(table: pa.Table) -> pa.Table:
        ask = table.column("asks").to_numpy()
        rep = table.column("rep").to_numpy()
        v = _matrix(table.column("v").combine_chunks())
        q, x, q_rep, x_rep = v[ask], v[~ask], rep[ask], rep[~ask]
        order = np.argsort(x_rep, kind="stable")
        x, x_rep = x[order], x_rep[order]
        k = min(top + 1, len(x))
        a, c = selected(q, x, k) if k and len(q) else (np.empty(0, int), np.empty(0, int))
        return pa.table({"q": pa.array(q_rep[a], pa.int64()), "rep": pa.array(x_rep[c], pa.int64()), "score": pa.array(exact_products(q[a], x[c]), pa.float64())})

    hits = held.select("rep", "v", "asks", "curve", "cell", "b", "qb").unionByName(asks.select("rep", "v", "asks", "curve", "cell", "b", "qb"))
    hits = hits.groupBy("curve", "cell", "b", "qb").applyInArrow(window, "q long, rep long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    merged = hits.groupBy("q", "rep").agg(F.max("score").alias("score"))
    # Among equal vectors only the first ids can be among the nearest, so a query's rows stay few.
    merged = merged.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).filter(F.col("i") <= top + 1)
    listed = merged.join(units.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= top + 1)
    near = listed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("i", "vec_id", "score"))).alias("near"))
    out = asked.join(units.select("h1", "h2", F.col("rep").alias("q")), ["h1", "h2"]).join(near, "q")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    out = out.select("query_id", F.posexplode(own).alias("p", "x"))
    return out.select(F.col("query_id").cast("long").alias("query_id"), (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").cast("long").alias("vec_id"), F.col("x.score").alias("score"))


def neighbour_report(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0)
