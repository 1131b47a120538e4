"""Approximate nearest neighbours by a hierarchical k-means tree (op10).

The tree is fitted on a bounded sample (``sample`` vectors, in hash order);
every vector is then put into the leaf it descends to.  Largest inner product
becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2), with M the
largest norm of all; a query has 0 there.

A query visits leaves best-bin-first: a priority queue of tree nodes by the
distance to their centres.  How many leaves are visited is calibrated: sampled
queries are compared with all vectors, in blocks, and visits are widened until
the calibrated share of their true neighbours lies in visited leaves.  A query
goes on beyond that until its leaves hold ``k + 1`` ids.

Equal vectors are one entry that lists its ``k + 1`` smallest ids: more can
never be among the nearest, since ties go to smaller ids.  Equal queries are
searched once.  Neighbouring leaves form bundles of about ``PART`` entries.  A
query meets a bundle once, with the leaves it visits there, and takes one list
of hits from it.  A leaf of more entries is a bundle cut into parts, and so are
the queries of a bundle, so that neither a crowded leaf nor a popular one meets
in one task.

Inside a task, matrix products find the entries that can be among the best of
a query, with a margin over their rounding error; for these alone the products
are added up from the first component to the last in double precision.  So
scores do not depend on the blocks, and equal vectors get equal scores.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or have another length than most, take no part, nor do rows without an id; rows
of equal id and vector count once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlake.llm.common import bounded
from packlake.session import materialize

BRANCHES, LEAF_ROWS, MOST_LEAVES = 8, 64, 4096
SAMPLE, CALIBRATION, RECALL = 20_000, 64, 0.95
PART, QUERY_BLOCK = 4096, 256


def grow(points: np.ndarray, leaves: int) -> dict:
    """A hierarchical k-means tree as plain arrays: per node its children's centres, children and leaf number.

    Leaves are split, the fullest first, until there are enough of them, and
    numbered in the order of a walk through the tree, so that neighbouring
    numbers lie close together.
    """
    tree: dict = {"centres": [None], "below": [[]], "leaf": [-1], "n_leaves": 0}
    rng = np.random.default_rng(7)
    queue, count = [(-len(points), 0, points)], 1
    while queue:
        size, node, own = heapq.heappop(queue)
        parts = _split_points(own, rng) if count < leaves and -size >= 2 * BRANCHES else []
        if len(parts) < 2:
            continue
        tree["centres"][node] = np.array([c for c, _ in parts])
        for _, part in parts:
            child = len(tree["leaf"])
            for name, empty in (("centres", None), ("below", []), ("leaf", -1)):
                tree[name].append(empty)
            tree["below"][node].append(child)
            heapq.heappush(queue, (-len(part), child, part))
        count += len(parts) - 1
    walk = [0]
    while walk:
        node = walk.pop()
        walk += reversed(tree["below"][node])
        if not tree["below"][node]:
            tree["leaf"][node] = tree["n_leaves"]
            tree["n_leaves"] += 1
    return tree


def _split_points(points: np.ndarray, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    centres = points[rng.choice(len(points), BRANCHES, replace=False)]
    for _ in range(10):
        near = _squared(points, centres).argmin(axis=1)
        moved = np.array([points[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        if np.allclose(moved, centres):
            break
        centres = moved
    near = _squared(points, centres).argmin(axis=1)
    return [(centres[k], points[near == k]) for k in range(len(centres)) if (near == k).any()]


def descend(tree: dict, points: np.ndarray) -> np.ndarray:
    """Leaf of each point: the nearest centre on every level."""
    out = np.zeros(len(points), dtype=np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if tree["centres"][node] is None:
            out[rows] = tree["leaf"][node]
            continue
        near = _squared(points[rows], tree["centres"][node]).argmin(axis=1)
        todo += [(child, rows[near == k]) for k, child in enumerate(tree["below"][node]) if (near == k).any()]
    return out


def visits(tree: dict, point: np.ndarray, most: int, ids: list[int] | None = None, least: int = 0) -> list[int]:
    """The first ``most`` leaves, best bin first, and more until they hold ``least`` of the ``ids`` per leaf."""
    queue, out, held = [(0.0, 0)], [], 0
    while queue and (len(out) < most or held < least):
        _, node = heapq.heappop(queue)
        if tree["centres"][node] is None:
            out.append(tree["leaf"][node])
            held += ids[tree["leaf"][node]] if ids else 0
        else:
            for distance, child in zip(_squared(point[None, :], tree["centres"][node])[0], tree["below"][node]):
                heapq.heappush(queue, (float(distance), child))
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0)


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))[:, None]])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _ordered_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, added up in the order of the components."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d] * vectors[:, d]
    return out


def _nearest(queries: pd.DataFrame, entries: pd.DataFrame, k: int) -> Iterator[tuple[int, list[int], list[float]]]:
    """Per query its ``k`` best ids among the entries of its leaves, ties to smaller ids."""
    entries = entries.sort_values("leaf", kind="stable")
    vectors = _matrix(entries["v"])
    lists = [np.asarray(x) for x in entries["ids"]]
    first = np.array([x[0] for x in lists])
    leaf, starts = np.unique(entries["leaf"].to_numpy(), return_index=True)
    spans = dict(zip(leaf.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(entries)])))
    longest = np.sqrt((vectors * vectors).sum(axis=1)).max()
    for start in range(0, len(queries), QUERY_BLOCK):
        block = queries.iloc[start : start + QUERY_BLOCK]
        points = _matrix(block["v"])
        about = np.full((len(block), len(vectors)), -np.inf)
        asking: dict[int, list[int]] = {}
        for at, leaves in enumerate(block["leaves"]):
            for x in leaves:
                asking.setdefault(int(x), []).append(at)
        for x, rows in asking.items():
            if x in spans:
                low, high = spans[x]
                about[rows, low:high] = points[rows] @ vectors[low:high].T
        # twice the bound on the rounding error of either way to add up
        margin = 8 * points.shape[1] * np.finfo(float).eps * np.sqrt((points * points).sum(axis=1)) * longest
        if len(vectors) > k:
            least = np.partition(about, len(vectors) - k, axis=1)[:, len(vectors) - k]
        else:
            least = np.full(len(block), -np.inf)
        rows, columns = np.nonzero((about >= (least - margin)[:, None]) & (about > -np.inf))
        exact = _ordered_scores(points[rows], vectors[columns])
        ends = np.searchsorted(rows, np.arange(len(block) + 1))
        for at, qid in enumerate(block["qid"]):
            kept, scores = columns[ends[at] : ends[at + 1]], exact[ends[at] : ends[at + 1]]
            order = np.lexsort((first[kept], -scores))
            kept, scores = kept[order], scores[order]
            pairs: list[tuple[float, int]] = []
            place = 0
            while place < len(kept) and len(pairs) < k:  # equal scores are taken together, then by id
                tied = kept[place : place + np.searchsorted(-scores[place:], -scores[place], side="right")]
                pairs += sorted((-scores[place], int(i)) for e in tied for i in lists[e])
                place += len(tied)
            yield int(qid), [i for _, i in pairs[:k]], [-s for s, _ in pairs[:k]]


FOUND = "qid bigint, ids array<bigint>, scores array<double>"


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part, in double precision, each (id, vector) once."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    )
    usable = materialize(usable)
    length = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return usable.filter(F.size("v") == (length.n if length else 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0


def _smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its ``k`` smallest ids; every map task sends ``k`` rows a vector at most."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= k).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def _bundles(placed: DataFrame, n_leaves: int) -> tuple[list[int], list[int]]:
    """Bundle of each leaf, and ids in each leaf; one row per leaf, ``MOST_LEAVES`` at most, comes to the driver."""
    sizes, ids = [0] * n_leaves, [0] * n_leaves
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size("ids")).alias("ids")).collect():
        sizes[r.leaf], ids[r.leaf] = r.entries, r.ids
    bundle, at, held = [], 0, 0
    for size in sizes:
        if held and held + size > PART:
            at, held = at + 1, 0
        bundle.append(at)
        held += size
    return bundle, ids


def _split(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a part number inside their bundle, and the bundle's number of parts."""
    parts = materialize(rows.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    numbered = rows.join(bounded(parts), "bundle").withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")).cast("int")).drop("parts")
    return numbered, parts


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query among all other rows."""
    spark = vectors.sparkSession
    valid = materialize(_valid(vectors).distinct())
    stats = valid.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not stats.n:
        return empty
    norm = math.sqrt(stats.m)
    entries = materialize(_smallest_ids(valid, k + 1))
    # the tree's sample: bounded by SAMPLE
    sample = _matrix(pd.Series([r.v for r in entries.select("v", "ids").orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(SAMPLE).collect()]))
    distinct = entries.count()
    tree = grow(_lifted(sample, norm), min(MOST_LEAVES, max(1, distinct // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast(tree)  # plain arrays, MOST_LEAVES centres at most per level

    @F.pandas_udf("bigint")
    def leaf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series(descend(shared.value, _lifted(_matrix(column), norm)) if len(column) else [], dtype="int64")

    placed = materialize(entries.withColumn("leaf", leaf("v")))
    bundle, ids = _bundles(placed, tree["n_leaves"])
    asked = valid.filter(is_query)
    searches = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("qid")))
    most = _calibrated(searches, placed, tree, k + 1, recall)

    @F.pandas_udf("array<struct<bundle:bigint,leaves:array<bigint>>>")
    def leaves(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out = []
            for x in column:
                own: dict[int, list[int]] = {}
                for found in visits(shared.value, np.append(np.asarray(x, dtype=np.float64), 0.0), most, ids, k + 1):
                    own.setdefault(bundle[found], []).append(found)
                out.append([{"bundle": b, "leaves": own[b]} for b in sorted(own)])
            yield pd.Series(out)

    numbers = F.array(*[F.lit(b) for b in bundle])
    rows, row_parts = _split(placed.withColumn("bundle", F.element_at(numbers, (F.col("leaf") + 1).cast("int")).cast("bigint")), "v")
    visited = materialize(searches.select("qid", "v", F.explode(leaves("v")).alias("to")).select(F.col("qid").alias("_q"), "v", "to.bundle", "to.leaves"))
    queries, query_parts = _split(visited, "_q")
    queries = queries.join(bounded(row_parts), "bundle").select("bundle", F.col("part").alias("query_part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("_q").alias("qid"), "v", "leaves")
    rows = rows.join(bounded(query_parts), "bundle").select("bundle", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("query_part"), "leaf", "v", "ids")

    def near(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        found = list(_nearest(queries, entries, k + 1)) if len(queries) and len(entries) else []
        return pd.DataFrame(found, columns=["qid", "ids", "scores"])

    keys = ["bundle", "part", "query_part"]
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(near, FOUND)
    return _ranked(asked, searches, found, k)


def _ranked(asked: DataFrame, searches: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query, without its own row."""
    each = found.select("qid", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select("qid", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    best = materialize(each.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k + 1).groupBy("qid").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("hits")))
    own = asked.join(searches, "v").select(F.col("vec_id").alias("query_id"), "qid")
    hits = F.slice(F.filter(F.array_sort("hits"), lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    listed = own.join(best, "qid").select("query_id", F.posexplode(hits).alias("at", "hit"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def _calibrated(searches: DataFrame, placed: DataFrame, tree: dict, k: int, recall: float) -> int:
    """Leaves to visit so that the true neighbours of sampled queries are found in the wanted share."""
    sampled = searches.orderBy(F.xxhash64("qid"), "qid").limit(CALIBRATION).toPandas()
    if tree["n_leaves"] == 1 or sampled.empty:
        return tree["n_leaves"]

    def truth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Best entries of each batch of vectors for the sampled queries, with their leaves."""
        for batch in batches:
            if not len(batch):
                continue
            scores = _matrix(sampled["v"]) @ _matrix(batch["v"]).T
            top = min(k, len(batch))
            for qid, row in zip(sampled["qid"], scores):
                best = np.argsort(-row, kind="stable")[:top]
                yield pd.DataFrame({"qid": qid, "score": row[best], "leaf": batch["leaf"].to_numpy()[best], "n": batch["ids"].map(len).to_numpy()[best]})

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "leaf")
    best = placed.mapInPandas(truth, "qid bigint, score double, leaf bigint, n int").withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).toPandas()
    place = {}
    for qid, v in zip(sampled["qid"], sampled["v"]):
        point = np.append(np.asarray(v, dtype=np.float64), 0.0)
        place[qid] = {leaf: at for at, leaf in enumerate(visits(tree, point, tree["n_leaves"]), 1)}
    needed = np.sort([place[q][leaf] for q, leaf in zip(best["qid"], best["leaf"])])
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])
