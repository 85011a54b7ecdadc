"""Approximate nearest neighbours with learned partitions.

On a bounded sample: the graph of each vector's nearest neighbours is cut into parts of nearly
equal size with few edges between them, and a softmax classifier learns, from a vector, in
which parts its neighbours lie. The classifier then puts every row of the table into its likeliest
part, and sends a query to several of the most probable ones, where all rows are ranked by exact cosine.

Parts are compared in blocks of bounded size, so a crowded part (a vector copied many times, say)
is many groups; a block hands on its best few per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score double"
#: Rows a part, and the least and most parts of a table; rows of the sample for each part.
ROWS, LEAST_PARTS, MOST_PARTS, SAMPLED = 32_768, 16, 1024, 64
#: Components that a block of one side holds.
BLOCK = 1 << 21


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each unit row."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        near = x[lo : lo + 512] @ x.T
        near[np.arange(len(near)), lo + np.arange(len(near))] = -2
        out[lo : lo + 512] = np.argpartition(-near, k - 1, 1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each row, none above slack times the mean: halves along the widest direction, then
    rows move to the part with most of their neighbours where there is room."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            label[rows] = first
            continue
        own = x[rows] - x[rows].mean(0)
        direction = np.linalg.eigh(own.T @ own)[1][:, -1]
        order = rows[np.argsort(own @ direction, kind="stable")]
        cut = len(order) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    room = int(np.ceil(slack * len(x) / parts))
    size = np.bincount(label, minlength=parts)
    source = np.repeat(np.arange(len(x)), graph.shape[1])
    both = [[] for _ in range(len(x))]
    for a, b in zip(source.tolist(), graph.ravel().tolist()):
        both[a].append(b)
        both[b].append(a)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            votes = np.bincount(label[both[i]], minlength=parts)
            votes[size >= room] = -1
            best = int(votes.argmax())
            if best != label[i] and votes[best] > (label[both[i]] == label[i]).sum():
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A softmax classifier over unit vectors; knows the number of components it was fitted for."""

    def __init__(self, weights: np.ndarray, offset: np.ndarray):
        self.weights, self.offset = weights, offset
        self.width, self.parts = weights.shape
        self.probes = self.parts

    def calibrate(self, x: np.ndarray, recall: float, k: int = 5, queries: int = 400) -> None:
        """Sets probes to the fewest parts in which `recall` of the neighbours among rows x lie."""
        k = min(k, len(x) - 1)
        if k < 1 or self.parts == 1:
            return
        u = unit(x)
        label = self.logits(x).argmax(1)
        near = u[:queries] @ u.T
        near[np.arange(len(near)), np.arange(len(near))] = -3
        true = label[np.argpartition(-near, k - 1, 1)[:, :k]]
        place = np.argsort(np.argsort(-self.logits(x[:queries]), 1), 1)
        needed = np.sort(np.take_along_axis(place, true, 1).ravel()) + 1
        self.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return unit(x) @ self.weights + self.offset


def fit(x: np.ndarray, parts: int = 16, neighbours: int = 10, steps: int = 400, seed: int = 11) -> Router:
    """Learns the parts of a sample; fewer parts where the sample is small."""
    rng = np.random.default_rng(seed)
    x = np.unique(unit(x), axis=0)
    parts = int(max(1, min(parts, len(x) // 24)))
    k = min(neighbours, len(x) - 1)
    if parts == 1 or k < 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1))
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts, rng)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), k), label[graph].ravel()), 1.0 / (k + 2))
    share[np.arange(len(x)), label] += 2.0 / (k + 2)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - share) / len(x)
        for i, (theta, grad) in enumerate(((w, x.T @ g), (b, g.sum(0)))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            theta -= 0.2 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9)
    return Router(w, b)


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that take part (double) and their places: not null or zero, all components finite,
    and as many as width (or as the first has)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
    if flat.null_count:
        values = np.where(np.asarray(flat.is_null()), np.nan, values)
    width = width or (int(n[n > 0][0]) if (n > 0).any() else 1)
    at = np.flatnonzero(n == width)
    start = np.cumsum(n) - n
    x = values[start[at, None] + np.arange(width)] if len(at) else np.empty((0, width))
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[ok], at[ok]


def learn(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = 8192, parts: int | None = None, recall: float = 0.96) -> Router:
    """Fits a router to a bounded sample, those rows with the smallest hashes of their ids: one half gives the parts, the
    other tells how many parts to probe for the recall.

    Unless given, the parts grow with the table, one for each ROWS rows from LEAST_PARTS to MOST_PARTS, and the sample with
    them: about `sample` rows, or SAMPLED rows a part where these are more, so never more than SAMPLED * MOST_PARTS."""
    n = vectors.count()
    parts = parts or min(MOST_PARTS, max(LEAST_PARTS, n // ROWS))
    sample = max(sample, SAMPLED * parts)
    rows = vectors.where(F.col(embedding).isNotNull())
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(vec_id), F.lit(1 << 30)) < F.lit(int(sample / n * (1 << 30))))
    found = rows.orderBy(F.xxhash64(vec_id), vec_id).limit(2 * sample).select(embedding).toArrow()
    x, _ = matrix(found.column(0)) if found.num_rows else (np.empty((0, 1)), None)
    if not len(x):
        return Router(np.zeros((1, 1)), np.zeros(1))
    router = fit(x[::2], parts)
    router.calibrate(x[1::2], recall)
    return router


def routed(vectors: DataFrame, router: Router, embedding: str = "embedding") -> DataFrame:
    """Adds _parts, all parts of each row from the most probable on; empty for rows that take no part."""

    @F.arrow_udf("array<int>")
    def ranked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x, at = matrix(batch, router.width)
            order = np.argsort(-router.logits(x), 1, kind="stable").astype(np.int32)
            sizes = np.zeros(len(batch) + 1, np.int32)
            sizes[at + 1] = router.parts
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(order.ravel()))

    return vectors.withColumn("_parts", ranked(F.col(embedding)))


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best candidates of each query: a product of matrices finds all that may be, the exact measure ranks them."""
    q_norm, c_norm = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    step = max(1, (1 << 22) // max(1, len(c)))
    for lo in range(0, len(q), step):
        near = (q[lo : lo + step] @ c.T) / q_norm[lo : lo + step, None] / c_norm
        near[q_ids[lo : lo + step, None] == c_ids] = -3
        kth = np.partition(near, -k, 1)[:, -k] if len(c) > k else np.full(len(near), -2.0)
        i, j = np.nonzero((near >= np.maximum(kth, -2)[:, None] - 1e-9) & (near > -2.5))
        for a in range(0, len(i), 1 << 15):
            ia, ja = i[a : a + (1 << 15)] + lo, j[a : a + (1 << 15)]
            score = (q[ia] * c[ja]).sum(1) / (q_norm[ia] * c_norm[ja])
            order = np.lexsort((c_ids[ja], -score, q_ids[ia]))
            ids = q_ids[ia][order]
            place = np.arange(len(ids)) - np.searchsorted(ids, ids)
            top = order[place < k]
            yield q_ids[ia[top]], c_ids[ja[top]], score[top]


def search(
    vectors: DataFrame, queries: DataFrame, router: Router, k: int = 5, probes: int | None = None, block: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows in the parts it is sent to.

    Ties go to the smaller id; the row of the query's own id is no candidate. Vectors that are null or
    zero, hold a null or non-finite component, have another number of components or a null id
    take no part. probes is the router's own unless given; a query goes on to further parts until those hold more than k rows; with
    fewer candidates it gets all. Repeated ids are one candidate, the nearest. Empty tables
    give no row. A part's rows and the queries sent there meet in blocks of `block` rows (about BLOCK components unless given).
    """
    block = block or max(1024, BLOCK // router.width)
    base = routed(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id IS NOT NULL"), router)
    base = base.where(F.size("_parts") > 0).withColumn("part", F.col("_parts")[0]).drop("_parts")
    asked = routed(queries.select(F.col(vec_id).alias("query_id"), F.col(embedding).alias("embedding")).where("query_id IS NOT NULL"), router).where(F.size("_parts") > 0)
    held = {r[0]: r[1] for r in base.groupBy("part").count().collect()}  # one number for each part
    n_in = F.array(*[F.lit(held.get(p, 0)) for p in range(router.parts)])
    # how many parts from the first hold more than k rows
    step = lambda a, p: F.struct(F.when(a["n"] <= k, a["i"] + 1).otherwise(a["i"]).alias("i"), F.when(a["n"] <= k, a["n"] + F.get(n_in, p)).otherwise(a["n"]).alias("n"))
    enough = F.aggregate("_parts", F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n")), lambda a, p: step(a, p))["i"]
    sent = asked.withColumn("part", F.explode(F.slice("_parts", F.lit(1), F.greatest(F.lit(probes or router.probes), enough)))).drop("_parts")
    sent_n = {r[0]: r[1] for r in sent.groupBy("part").count().collect()}
    blocks = F.array(*[F.lit(max(1, -(-held.get(p, 0) // block))) for p in range(router.parts)])
    q_blocks = F.array(*[F.lit(max(1, -(-sent_n.get(p, 0) // block))) for p in range(router.parts)])
    b, qb = F.get(blocks, F.col("part")), F.get(q_blocks, F.col("part"))
    rows = base.withColumns({"cell": F.pmod(F.xxhash64("vec_id"), b).cast("int"), "q_cell": F.explode(F.sequence(F.lit(0), qb - 1))})
    asks = sent.withColumns({"q_cell": F.pmod(F.xxhash64("query_id"), qb).cast("int"), "cell": F.explode(F.sequence(F.lit(0), b - 1))})

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, qi = matrix(left.column("embedding"), router.width)
            c, ci = matrix(right.column("embedding"), router.width)
            kept = list(_best(left.column("query_id").to_numpy()[qi], q, right.column("vec_id").to_numpy()[ci], c, k))
        columns = [np.concatenate(x) for x in zip(*kept)] if kept else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    keys = ("part", "cell", "q_cell")
    met = asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(rank, RESULT)
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
