"""Nearest neighbours by inner product over balanced posting lists.

Vectors are lifted to one norm (a last component fills each up to the largest norm), so that the largest inner product is
the smallest distance. Centroids are fitted on a bounded sample; clusters that hold too much of it are split until all
are of like size. Every vector goes to the list of its nearest centroid, and, near a boundary, to those of further
centroids whose distance is within a ratio of the nearest, unless a chosen centroid is nearer to them than the vector is.
Centroids are held in memory in a graph of near neighbours and searched by best-first steps; a query's lists are those
whose centroid is within a ratio of its nearest. That ratio is set on the sample, as the smallest with which the lists
hold the wanted share of the sample's true neighbours. The lists are then searched exactly.

Equal vectors are searched once and stand for all their ids; only the smallest ids of a group can be among the nearest.
Lists that lie near each other are bundled up to a bounded number of vectors, and a query's lists of one bundle give one
answer. Longer lists are dealt to several bundles, and the queries of a bundle into blocks, so that the work of a task is
bounded.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id. Repeated rows count once. A candidate is any other id. Ties go to the smaller id. If there
are at most as many candidates as asked for, all are returned. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earthworks.llm.store import kept

LIST_ROWS = 1000
SAMPLE_ROWS = 16_384
BUNDLE_ROWS = 16_384
BLOCK_ROWS = 4096
REPLICAS = 4
BOUNDARY = 1.15
DEGREE = 16
RECALL = 0.96
PROBE_BATCH = 256


@dataclass(frozen=True)
class Index:
    """Centroids in the lifted space, their graph, and the ratio that selects a query's lists."""

    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    ratio: float
    sizes: np.ndarray  # vectors whose nearest centroid it is

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return lift(x, self.norm)

    def near(self, x: np.ndarray, ratio: float, rows: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lists and distances for each point, nearest first: all within the ratio, and as many as hold enough rows."""
        out = []
        for at in range(0, len(x), PROBE_BATCH):
            out += self._search(x[at : at + PROBE_BATCH], ratio, rows)
        return out

    def _search(self, x: np.ndarray, ratio: float, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, k = len(x), len(self.centroids)
        each = np.arange(n)
        gap, open_ = np.full((n, k), np.inf), np.zeros((n, k), bool)
        gap[:, 0], open_[:, 0] = np.linalg.norm(x - self.centroids[0], axis=1), True
        live = each
        while live.size:
            reach = np.where(open_[live], gap[live], np.inf)
            node = reach.argmin(axis=1)
            dist = reach[np.arange(len(live)), node]
            # a point goes on while its nearest open node can matter: within the ratio (or on the way down to it), or rows lack
            held = np.where(np.isfinite(gap[live]) & ~open_[live], self.sizes, 0).sum(axis=1)
            on = np.isfinite(dist) & ((dist <= gap[live].min(axis=1) * max(ratio, 1.05)) | (held < rows))
            live, node = live[on], node[on]
            open_[live, node] = False
            around = self.graph[node]
            flat, to = np.repeat(live, around.shape[1]), around.ravel()
            new = ~np.isfinite(gap[flat, to])
            flat, to = flat[new], to[new]
            gap[flat, to] = np.linalg.norm(x[flat] - self.centroids[to], axis=1)
            open_[flat, to] = True
        out = []
        for row in gap:
            order = np.argsort(row, kind="stable")[: int(np.isfinite(row).sum())]
            enough = int(np.searchsorted(np.cumsum(self.sizes[order]), rows)) + 1
            take = max(int((row[order] <= row[order[0]] * ratio).sum()), min(enough, len(order)) if rows else 1)
            out.append((order[:take], row[order[:take]]))
        return out

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that hold each point: the nearest, and across a boundary those that look another way."""
        out = []
        for lists, gaps in self.near(x, BOUNDARY):
            chosen = [lists[0]]
            for one, gap in zip(lists[1:], gaps[1:], strict=True):
                if len(chosen) == REPLICAS:
                    break
                if (np.linalg.norm(self.centroids[chosen] - self.centroids[one], axis=1) > gap * 0.5).all():
                    chosen.append(one)
            out.append(np.array(chosen))
        return out


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
    return np.column_stack([x, rest])


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def balanced(x: np.ndarray, k: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """About ``k`` centroids; clusters of over twice the mean size are split in two until there are none."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    limit = max(2 * len(x) / max(k, 1), 2)
    for step in range(2 * steps):
        home = _nearest(x, centroids)
        grown = []
        for c in range(len(centroids)):
            own = x[home == c]
            if not len(own):
                continue
            if len(own) > limit and step < 2 * steps - 1 and (far := np.ptp(own, axis=0)).any():
                side = own[:, far.argmax()] > np.median(own[:, far.argmax()])
                grown += [own[side].mean(axis=0), own[~side].mean(axis=0)] if side.any() else [own.mean(axis=0)]
            else:
                grown.append(own.mean(axis=0))
        centroids = np.array(grown)
    return centroids


def near_graph(centroids: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours of each centroid; a ring through all of them keeps the graph in one piece."""
    k = len(centroids)
    gaps = (centroids * centroids).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * centroids @ centroids.T
    near = np.argsort(gaps, axis=1, kind="stable")[:, 1 : degree + 1]
    ring = np.column_stack([(np.arange(k) + 1) % k, (np.arange(k) - 1) % k])
    return np.column_stack([near, ring])


def fit(sample: np.ndarray, norm: float, lists: int, total: int, k: int) -> Index:
    """Centroids, graph and ratio from the sample."""
    x = lift(sample, norm)
    centroids = balanced(x, lists)
    sizes = np.bincount(_nearest(x, centroids), minlength=len(centroids)) * (total / len(x))
    index = Index(centroids, near_graph(centroids), norm, 1.0, sizes)
    asked = sample[:: max(len(sample) // 256, 1)][:256]
    q = np.column_stack([asked, np.zeros(len(asked))])
    inner = asked @ sample.T
    best = np.argsort(-inner, axis=1, kind="stable")[:, : min(k + 1, len(sample))]
    places = {int(v): h for v, h in zip(np.unique(best), index.homes(x[np.unique(best)]), strict=True)}
    gaps = np.linalg.norm(q[:, None] - centroids[None], axis=2)
    # the ratio at which each true neighbour is found, and its quantile for the wanted recall
    needed = [gaps[i, places[int(v)]].min() / gaps[i].min() for i, row in enumerate(best) for v in row]
    return Index(centroids, index.graph, norm, float(np.quantile(needed, RECALL)) + 1e-9, sizes)


def bundled(index: Index, rows: dict[int, int], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bundle of each list, and over how many it is dealt.

    Lists are taken in a walk from one to the nearest that is left; a bundle is closed before it would hold over ``limit`` rows.
    """
    count = len(index.centroids)
    first, parts, left = np.zeros(count, np.int64), np.ones(count, np.int64), np.ones(count, bool)
    at, bundle, held = 0, 0, 0
    while True:
        left[at] = False
        size = rows.get(at, 0)
        if held and held + size > limit:
            bundle, held = bundle + 1, 0
        first[at], parts[at] = bundle, max(-(-size // limit), 1)
        bundle, held = (bundle, held + size) if parts[at] == 1 else (bundle + int(parts[at]), 0)
        if not left.any():
            return first, parts
        others = np.flatnonzero(left)
        at = int(others[np.linalg.norm(index.centroids[others] - index.centroids[at], axis=1).argmin()])


def best_of(
    lists: np.ndarray, x: np.ndarray, q: np.ndarray, wanted: np.ndarray, starts: np.ndarray, names: np.ndarray, keep: int,
) -> tuple[np.ndarray, np.ndarray]:
    """For every query the places and scores of the ``keep`` best rows of its lists; a place below 0 is none.

    ``wanted`` has the lists of all queries one after the other, those of query i from ``starts[i]`` on. ``names`` tells
    which rows are copies of one vector.
    """
    place = np.full((len(q), keep), -1)
    score = np.full((len(q), keep), -np.inf)
    asking = np.repeat(np.arange(len(q)), np.diff(starts))
    for one in np.unique(lists):
        rows, who = np.flatnonzero(lists == one), asking[wanted == one]
        if not who.size:
            continue
        inner = q[who] @ x[rows].T
        some = min(keep, len(rows))
        at = np.argpartition(-inner, some - 1, axis=1)[:, :some]
        places = np.column_stack([place[who], rows[at]])
        scores = np.column_stack([score[who], np.take_along_axis(inner, at, axis=1)])
        # a vector that is in several lists counts once
        named = np.where(places < 0, -1 - np.arange(places.shape[1]), names[places])
        order = np.argsort(named, axis=1, kind="stable")
        twice = np.diff(np.take_along_axis(named, order, axis=1), axis=1, prepend=np.iinfo(np.int64).min) == 0
        np.put_along_axis(scores, order, np.where(twice, -np.inf, np.take_along_axis(scores, order, axis=1)), axis=1)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
        score[who] = np.take_along_axis(scores, best, axis=1)
        place[who] = np.where(np.isfinite(score[who]), np.take_along_axis(places, best, axis=1), -1)
    return place, score


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part, once each."""
    v = F.col(vector).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", v.alias("v")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def nearest(
    df: DataFrame, asked: Column, k: int = 20, vector: str = "embedding", list_rows: int = LIST_ROWS,
    sample_rows: int = SAMPLE_ROWS, bundle_rows: int = BUNDLE_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest to every row for which ``asked`` holds."""
    rows = kept(usable(df, vector), "vectors")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    rows = rows.join(F.broadcast(length.select("n")), F.size("v") == F.col("n"), "left_semi")
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    groups = kept(few.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "groups")
    queries = kept(rows.where(asked).join(groups.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, norm = groups.agg(F.count(F.lit(1)), F.sqrt(F.max(norm2))).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not total:
        return df.sparkSession.createDataFrame([], out)
    sample = groups.orderBy(F.xxhash64("rep")).limit(sample_rows).select("rep", "v").toArrow()
    lists = min(max(round(total / list_rows), 1), max(sample_rows // 8, 1))
    index = fit(_matrix(sample.column("v")), float(norm), lists, total, k)
    context = df.sparkSession.sparkContext
    sent = context.broadcast(index)  # as many centroids as an eighth of the sample, at most

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            if batch.num_rows:
                to = index.homes(index.lifted(_matrix(batch.column(1))))
                rows = np.repeat(np.arange(len(to)), [len(t) for t in to])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(to).astype(np.int32)), *[c.take(pa.array(rows)) for c in batch.columns]],
                    names=["list", "rep", "v"])

    homes = kept(groups.select("rep", "v").mapInArrow(home, "list int, rep long, v array<double>"), "postings")
    held = {r["list"]: r["count"] for r in homes.groupBy("list").count().collect()}  # one row per centroid
    first, parts = bundled(index, held, bundle_rows)
    dealt_to = context.broadcast((first, parts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (first, parts) = sent.value, dealt_to.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            rows, bundles, lists = [], [], []
            for row, (found, _) in enumerate(index.near(np.column_stack([x, np.zeros(len(x))]), index.ratio, 4 * (k + 1))):
                every = np.repeat(found, parts[found])
                places = np.concatenate([np.arange(first[one], first[one] + parts[one]) for one in found])
                for bundle in np.unique(places):
                    rows.append(row)
                    bundles.append(int(bundle))
                    lists.append(every[places == bundle].astype(np.int32))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bundles, pa.int32()), pa.array(lists, pa.list_(pa.int32())), batch.column(0).take(at), batch.column(1).take(at)],
                names=["bundle", "lists", "rep", "v"])

    wanted = groups.join(queries.select("rep").distinct(), "rep", "left_semi")
    probes = kept(wanted.select("rep", "v").mapInArrow(probe, "bundle int, lists array<int>, rep long, v array<double>"), "probes")
    blocks = kept(probes.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")), "blocks")
    bounds = df.sparkSession.createDataFrame(
        [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(first, parts, strict=True))], "list int, first int, parts int")
    own = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int")
    left = homes.join(F.broadcast(bounds), "list").withColumn("bundle", own).join(blocks, "bundle").select(
        "bundle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "rep", "v")
    right = probes.join(blocks, "bundle").select(
        "bundle", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "lists", "rep", "v")

    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, q, reps = _matrix(held.column("v")), _matrix(asked.column("v")), held.column("rep").to_numpy()
        lists = asked.column("lists").combine_chunks()
        starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        place, _ = best_of(held.column("list").to_numpy(), x, q, lists.flatten().to_numpy(), starts, reps, k + 1)
        asker, rank = np.nonzero(place >= 0)
        at = place[asker, rank]
        # one by one in a fixed order, so that a pair has the same score wherever it is met
        exact = np.einsum("nd,nd->n", q[asker], x[at])
        return pa.table({"q": asked.column("rep").to_numpy()[asker], "rep": reps[at], "score": exact})

    keys = ["bundle", "block"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, "q long, rep long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    pairs = hits.groupBy("q", "rep").agg(F.max("score").alias("score"))
    # k + 1 groups hold k + 1 ids at least; a group's other ids come in by its list
    top = pairs.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    named = top.join(groups.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1).drop("_n")
    found = queries.join(named, F.col("rep") == F.col("q")).where("vec_id != query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
