"""Embedding near-deduplication: robust-pruned flat graph on overlapping cluster shards, range-expanding greedy search.

* **Shards.** Centroids come from k-means on a bounded sample (``SAMPLE`` vectors); every vector
  belongs to its ``OVERLAP`` nearest centroids, so clusters overlap at their borders. A shard of
  more than ``BLOCK`` vectors becomes blocks, and every pair of blocks a task: no task holds
  more than two blocks, whatever a cluster's size.
* **Graph.** Every task links each vector to near and to far candidates and prunes them robustly
  (a candidate is dropped if a chosen neighbour is ``ALPHA`` times closer to it); the adjacency
  lists of all tasks are united per vector.
* **Search.** In every task each vector is a query: a greedy beam search starts at the medoid
  (and at the query's own vertex), then expands every vertex found in range until nothing new
  in range turns up.
* **Verification.** A pair is a link if its cosine in double precision reaches the threshold; a pair
  that several tasks see is counted in the first of them only. So that the first does not miss what another
  finds, every task completes the search by comparing its blocks exactly: only pairs without a shard in common are missed.

A task returns a link count and the smallest linked vector's component per vector, never
pairs: a dense group costs rows in proportion to its vectors. Components over tasks are
joined by ``components``. ``audit`` measures recall against brute force for a stated set of queries.

Vectors that are null, empty, zero, hold a null or non-finite component, or have another
length than most vectors (the most frequent length; the smaller one on a tie) link with nothing and are their own component. Equal vectors form one
class before sharding and count as links of each other. Rows that repeat a ``vec_id`` are vectors of
one id; a null ``vec_id`` is counted as a partner and has no component. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.tables import components
from linkweave.session import materialize

SAMPLE = 8192
SHARD = 600
OVERLAP = 3
BLOCK = 1024
MAX_CENTROIDS = 1024
MERGE = 0.97
NEAR, FAR, ALPHA = 16, 8, 1.2
BEAM = 24
THRESHOLD = 0.9


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 2) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        full = size > 1e-12
        c[full] = total[full] / size[full, None]
    return c


def robust_prune(x: np.ndarray, near: int = NEAR, far: int = FAR, alpha: float = ALPHA, seed: int = 1) -> np.ndarray:
    """(n, near + far) neighbours of every vector, -1 where fewer are left."""
    n = len(x)
    rng = np.random.default_rng(seed)
    width = min(n - 1, 3 * near)
    if width <= 0:
        return np.full((n, 1), -1)
    out = np.full((n, near + far), -1)
    for lo in range(0, n, 512):
        rows = np.arange(lo, min(n, lo + 512))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -np.inf
        cand = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        cand = np.concatenate([cand, rng.integers(0, n, (len(rows), far))], axis=1)
        own = np.take_along_axis(sim, cand, axis=1)
        own[cand == rows[:, None]] = -np.inf
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, axis=1), np.take_along_axis(own, order, axis=1)
        dist = np.sqrt(np.maximum(2 - 2 * own, 0))
        between = np.einsum("nid,njd->nij", x[cand], x[cand])
        between = np.sqrt(np.maximum(2 - 2 * between, 0))
        open_ = np.isfinite(own)
        at = np.arange(len(rows))
        for j in range(near):  # the closest candidate left, then prune what it covers
            pick = open_.argmax(axis=1)
            ok = open_[at, pick]
            out[rows[ok], j] = cand[at, pick][ok]
            covered = alpha * between[at, pick] <= dist
            open_ &= ~covered
            open_[at, pick] = False
        last = np.where(np.isfinite(own[:, -far:]), cand[:, -far:], -1)  # the farthest keep the graph connected
        out[rows, near:near + last.shape[1]] = last
    return out


def united(own: np.ndarray, n: int, limit: int = 64) -> np.ndarray:
    """Adjacency with the reverse edges added, up to ``limit`` per vertex; bounds the search alone, ``complete`` finds the rest."""
    src = np.repeat(np.arange(n), own.shape[1])
    dst = own.ravel()
    ok = (dst >= 0) & (dst != src)
    a, b = np.concatenate([src[ok], dst[ok]]), np.concatenate([dst[ok], src[ok]])
    key = np.unique(a * n + b)
    a, b = key // n, key % n
    first = np.searchsorted(a, np.arange(n))
    nth = np.arange(len(a)) - first[a]
    keep = nth < limit
    out = np.full((n, min(limit, int(nth.max()) + 1) if len(nth) else 1), -1)
    out[a[keep], nth[keep]] = b[keep]
    return out


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, beam: int = BEAM) -> np.ndarray:
    """(queries, n) truth table of vertices in range: greedy beam search from the medoid, then range expansion.

    ``own``: the query's vertex, or -1.
    """
    n, q = len(x), len(queries)
    seen = np.zeros((q, n), bool)
    hit = np.zeros((q, n), bool)
    expanded = np.zeros((q, n), bool)
    medoid = int((x @ x.mean(axis=0)).argmax())
    at = np.arange(q)
    ids = np.full((q, beam), -1)
    sims = np.full((q, beam), -np.inf)
    ids[:, 0] = medoid
    sims[:, 0] = queries @ x[medoid]
    seen[:, medoid] = True
    known = own >= 0
    ids[known, 1] = own[known]
    sims[known, 1] = np.einsum("ij,ij->i", queries[known], x[own[known]])
    seen[at[known], own[known]] = True
    hit[:, medoid] = sims[:, 0] >= threshold
    hit[at[known], own[known]] = sims[known, 1] >= threshold
    while True:  # expand the best open vertex of every beam
        fresh = (ids >= 0) & ~expanded[at[:, None], np.maximum(ids, 0)]
        live = np.flatnonzero(fresh.any(axis=1))
        if not len(live):
            break
        pick = np.where(fresh[live], sims[live], -np.inf).argmax(axis=1)
        v = ids[live, pick]
        expanded[live, v] = True
        nb = graph[v]
        ok = (nb >= 0) & ~seen[live[:, None], np.maximum(nb, 0)]
        r, c = np.nonzero(ok)
        seen[live[r], nb[r, c]] = True
        s = np.full(nb.shape, -np.inf)
        s[r, c] = np.einsum("ij,ij->i", queries[live[r]], x[nb[r, c]])
        in_range = s >= threshold
        hit[live[:, None].repeat(nb.shape[1], 1)[in_range], nb[in_range]] = True
        all_ids = np.concatenate([ids[live], nb], axis=1)
        all_sims = np.concatenate([sims[live], s], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[live] = np.where(np.take_along_axis(all_sims, best, 1) > -np.inf, np.take_along_axis(all_ids, best, 1), -1)
        sims[live] = np.take_along_axis(all_sims, best, 1)
    todo = hit & ~expanded
    while todo.any():  # everything in range is expanded
        a, v = np.nonzero(todo)
        expanded[a, v] = True
        for lo in range(0, len(a), 1 << 14):
            qa, nb = a[lo:lo + (1 << 14)], graph[v[lo:lo + (1 << 14)]]
            ok = (nb >= 0) & ~seen[qa[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(ok)
            if not len(r):
                continue
            key = np.unique(qa[r].astype(np.int64) * n + nb[r, c])
            qq, vv = key // n, key % n
            seen[qq, vv] = True
            inside = np.einsum("ij,ij->i", queries[qq], x[vv]) >= threshold
            hit[qq[inside], vv[inside]] = True
        todo = hit & ~expanded
    return hit


def complete(x: np.ndarray, linked: np.ndarray, threshold: float) -> None:
    """Add the pairs that the search has missed, by exact comparison in slices of 512 rows."""
    for lo in range(0, len(x), 512):
        linked[lo:lo + 512] |= x[lo:lo + 512] @ x.T >= threshold


def clean(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vector, usable)``: unit vectors in double precision."""
    wide = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("raw"))
    finite = F.forall("raw", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    top = F.aggregate("raw", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    ok = F.coalesce(finite & (F.size("raw") > 0) & (top > 0), F.lit(False))
    scaled = F.transform("raw", lambda v: v / F.col("top"))  # largest component 1: no overflow or underflow in the norm
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, v: a + v * v))
    return (wide.withColumn("ok", ok).withColumn("top", F.when(F.col("ok"), top))
            .withColumn("scaled", F.when(F.col("ok"), scaled)).withColumn("norm", norm)
            .select("vec_id", F.when(F.col("ok"), F.transform("scaled", lambda v: v / F.col("norm"))).alias("vector")))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def centroids(classes: DataFrame, n: int, dims: int) -> np.ndarray:
    """Centroids from a bounded sample of the vectors, chosen by a hash."""
    share = (1 << 40) * SAMPLE // max(1, n)
    sample = (classes.where(F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1)) <= F.lit(share))
              .select("node", "vector").limit(2 * SAMPLE).orderBy("node").toArrow())
    x = _matrix(sample.column("vector"), dims)
    k = max(1, min(MAX_CENTROIDS, math.ceil(n / SHARD), len(x)))
    found = kmeans(x, k)
    keep: list[int] = []
    for i in range(len(found)):  # one centroid per dense group, so that its vectors share their shards
        if not keep or (found[keep] @ found[i]).max() < MERGE:
            keep.append(i)
    return found[keep]


def sharded(classes: DataFrame, centres: np.ndarray, dims: int) -> DataFrame:
    """``(node, vector, shards)``: ascending numbers of the nearest centroids of every vector."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    take = min(OVERLAP, len(centres))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sims = _matrix(b.column("vector"), dims) @ shared.value.T
            near = np.sort(np.argpartition(-sims, take - 1, axis=1)[:, :take], axis=1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, take, dtype=np.int32)), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("vector"), lists], ["node", "vector", "shards"])

    return classes.select("node", "vector").mapInArrow(place, "node bigint, vector array<double>, shards array<bigint>")


def tasks(placed: DataFrame) -> DataFrame:
    """Rows replicated to tasks ``(shard, lo, hi)``: a shard of several blocks becomes block pairs."""
    rows = placed.select("node", "vector", "shards", F.explode("shards").alias("shard"))
    size = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("bigint")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    return (rows.join(size, "shard").withColumn("blocks", blocks).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
            .select("shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                    "own", "node", "vector", "shards"))


def _sorted(part: pa.Table) -> pa.Table:
    return part.sort_by("node")


def adjacency(work: DataFrame, dims: int) -> DataFrame:
    """``(node, neighbours)``: the pruned lists of all tasks, united per vector."""

    def build(key: tuple, part: pa.Table) -> pa.Table:
        part = _sorted(part)
        node = part.column("node").to_numpy()
        graph = robust_prune(_matrix(part.column("vector"), dims))
        a, j = np.nonzero(graph >= 0)
        return pa.table({"node": node[a], "neighbour": node[graph[a, j]]})

    edges = work.groupBy("shard", "lo", "hi").applyInArrow(build, "node bigint, neighbour bigint")
    return edges.groupBy("node").agg(F.collect_set("neighbour").alias("neighbours"))


def search(work: DataFrame, graph: DataFrame, dims: int, threshold: float) -> DataFrame:
    """``(node, n_links, root)`` per task and vector: verified links counted there, smallest vertex linked in the task."""

    def look(key: tuple, part: pa.Table) -> pa.Table:
        part = _sorted(part)
        node, x = part.column("node").to_numpy(), _matrix(part.column("vector"), dims)
        copies = part.column("copies").to_numpy()
        own_block, lists = part.column("own").to_numpy(), part.column("neighbours").combine_chunks()
        n = len(node)
        count = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        src = np.repeat(np.arange(n), count)
        pos = np.minimum(np.searchsorted(node, flat), n - 1)
        here = node[pos] == flat  # of the united lists, the vertices of this task
        src, pos = src[here], pos[here]
        nth = np.arange(len(src)) - np.searchsorted(src, src)
        graph = np.full((n, int(nth.max()) + 1 if len(nth) else 1), -1)
        graph[src, nth] = pos
        linked = range_search(x, united(graph, n), x, np.arange(n), threshold)
        complete(x, linked, threshold)
        np.fill_diagonal(linked, False)
        linked |= linked.T
        lo, hi = key[1].as_py(), key[2].as_py()
        if lo != hi:  # pairs inside one block belong to that block's own task
            linked &= own_block[:, None] != own_block[None, :]
        shards = part.column("shards").combine_chunks().flatten().to_numpy().reshape(n, -1)
        a, b = np.nonzero(linked)
        first = np.full(len(a), np.iinfo(np.int64).max)
        for i in range(shards.shape[1]):
            shared = (shards[b] == shards[a, i][:, None]).any(axis=1)
            first = np.minimum(first, np.where(shared, shards[a, i], first))
        counted = first == key[0].as_py()
        links = np.bincount(a[counted], weights=copies[b[counted]], minlength=n).astype(np.int64)
        root = np.arange(n)
        while len(a):  # smallest vertex reachable inside the task
            new = root.copy()
            np.minimum.at(new, a, root[b])
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.table({"node": node, "n_links": links, "root": node[root]})

    rows = work.join(graph, "node", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>")))
    return rows.groupBy("shard", "lo", "hi").applyInArrow(look, "node bigint, n_links bigint, root bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row."""
    rows = materialize(clean(vectors), "vectors")
    size = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    alone = (F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if size is None:
        return rows.select("vec_id", *alone)
    dims = size["dims"]
    fits = F.coalesce(F.size("vector") == dims, F.lit(False))
    good = rows.where(fits)
    digest = F.xxhash64("vector")
    classes = materialize(good.groupBy("vector").agg(F.min("vec_id").alias("holder"), F.count(F.lit(1)).alias("copies"))
                          .select(digest.alias("node"), "holder", "copies", "vector"), "vector-classes")
    n = classes.count()
    work = materialize(tasks(sharded(classes, centroids(classes, n, dims), dims))
                       .join(classes.select("node", "copies"), "node"), "vector-tasks")
    graph = materialize(adjacency(work, dims), "vector-graph")
    found = materialize(search(work, graph, dims, threshold), "vector-links")
    links = found.groupBy("node").agg(F.sum("n_links").alias("linked"))
    joined = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    whole = (classes.select("node", "holder", "copies").join(links, "node")
             .join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = whole.groupBy("component").agg(F.min("holder").alias("component_id"))
    named = (whole.join(least, "component")
             .select("node", (F.col("linked") + F.col("copies") - 1).alias("n_links"), "component_id"))
    linked = (good.withColumn("node", digest).join(named, "node")
              .select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id")))
    linked = linked.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return linked.union(rows.where(~fits).select("vec_id", *alone))


def audit(vectors: DataFrame, result: DataFrame, modulo: int = 20, threshold: float = THRESHOLD) -> DataFrame:
    """``(n_queries, true_links, found_links, recall)``: brute force for every vector whose id is divisible by ``modulo``.

    Queries are dealt to blocks of about 512; every vector is compared with one block at a time.
    """
    rows = materialize(clean(vectors).where("vector IS NOT NULL AND vec_id IS NOT NULL"), "audit-vectors")
    queries = rows.where(F.pmod("vec_id", F.lit(modulo)) == 0)
    parts = max(1, math.ceil(queries.count() / 512))
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"),
                             F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("block"))
    spread = rows.select("vec_id", "vector", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"),
                         F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(64)).alias("slice"))
    sliced = queries.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))))

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        total = np.zeros(n, np.int64)
        ids = left.column("query_id").to_numpy()
        if n and right.num_rows:
            dims = len(left.column("query")[0])
            q, x = _matrix(left.column("query"), dims), right.column("vector").combine_chunks()
            fits = np.diff(x.offsets.to_numpy()) == dims
            x, other = _matrix(x.filter(pa.array(fits)), dims), right.column("vec_id").to_numpy()[fits]
            for lo in range(0, len(x), 4096):
                total += ((q @ x[lo:lo + 4096].T >= threshold) & (ids[:, None] != other[lo:lo + 4096])).sum(axis=1)
        return pa.table({"vec_id": pa.array(ids, pa.int64()), "true_links": pa.array(total)})

    truth = (sliced.groupBy("block", "slice").cogroup(spread.groupBy("part", "slice"))
             .applyInArrow(compare, "vec_id bigint, true_links bigint").groupBy("vec_id").agg(F.sum("true_links").alias("true_links")))
    both = truth.join(result.select("vec_id", "n_links"), "vec_id")
    return both.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("true_links").alias("true_links"),
                    F.sum(F.least("true_links", "n_links")).alias("found_links")).withColumn(
        "recall", F.when(F.col("true_links") > 0, F.col("found_links") / F.col("true_links")).otherwise(F.lit(1.0)))
