"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table has ``functions`` hash functions h(x) = floor((a x + b) / width) with Gaussian a (2-stable: projected differences follow
the Euclidean distance) and uniform b; a bucket is the tuple of all. A query looks into its own bucket and into ``probes``
perturbed ones of each table, in the order of their estimated success: a perturbation moves some functions
to the neighbouring slot, its score is the sum of the squared distances from the query's projection to those slots, and sets of perturbations
are visited by expected score (the order is worked out once for all queries, by rank of each query's own sorted
distances). Candidates of all tables are ranked by exact distance.

The parameters follow from the data (``tuned``): for a bounded sample of queries the true neighbours are found by comparing them with every row, and
of a grid of parameters the one is taken that compares the fewest vectors of a second bounded sample while it finds ``RECALL`` of those neighbours.
Where vectors are nearly equidistant this is most of the data; in clustered data a small part.

Widths are in units of the root mean square norm. Every row is indexed and lies in one bucket of each table; queries are sent to the buckets they probe, and a bucket is compared as
blocks of matrix products. Large buckets are cut into blocks of about ``BLOCK`` vectors and ``QUERIES`` queries; every query of the bucket meets every
block, so nothing is dropped. Each block returns a query's best k; the best k of all are the answer.

Nulls and edge cases, for data and queries alike: rows with a null id, a null or empty embedding, a null or non-finite element (after conversion to
single precision), or a length other than the table's most frequent one are left out; rows equal in id and vector are one;
rows that share an id but not the vector are not each other's neighbours, and count as one neighbour at the nearest distance. Equal distances are ranked by id. With fewer than
k other ids in its buckets a query has fewer than k neighbours. An empty table, or no query, gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, hashed_sample, small

K, RECALL = 10, 0.97
BLOCK, QUERIES = 32_768, 16_384
#: Rows that the parameters are chosen on: queries, which are compared with every row, and vectors for the cost.
TUNE_QUERIES, TUNE_ROWS = 128, 2048
GRID = {"functions": (2, 4, 6, 8, 12, 16), "tables": (1, 2, 4), "width": (0.5, 1.0, 1.5, 2.0, 3.0, 4.0)}
MOST_PROBES = 32


def probe_order(functions: int, probes: int) -> list[tuple[int, ...]]:
    """The first ``probes`` sets of ranks (1 .. 2 x functions of a query's sorted distances to neighbouring slots) by expected score.

    Ranks r and 2M + 1 - r belong to the two sides of one function, so a valid set holds at most one of them.
    """
    m = functions
    expected = [0.0] + [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    out: list[tuple[int, ...]] = []
    heap: list[tuple[float, tuple[int, ...]]] = [(expected[1], (1,))]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if all(2 * m + 1 - r not in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last < 2 * m:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*ranks, last + 1)))
    return out


class Hashing:
    """The tables' functions, from a fixed seed: equal on every executor."""

    def __init__(self, dimensions: int, tables: int, functions: int, width: float, probes: int, scale: float = 1.0, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.functions = tables, functions
        self.width = width * scale
        self.a = rng.standard_normal((dimensions, tables * functions)).astype(np.float32)
        self.b = rng.uniform(0, self.width, tables * functions).astype(np.float32)
        self.sets = probe_order(functions, probes)

    def _slots(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.functions)
        slot = np.floor(at)
        return slot.astype(np.int64), at - slot

    def _name(self, slot: np.ndarray) -> np.ndarray:
        """A bucket's name: its slots in base 2^(60 / functions)."""
        bits = 60 // self.functions
        out = np.zeros(slot.shape[:-1], np.int64)
        for j in range(self.functions):
            out = (out << bits) | (slot[..., j] & ((1 << bits) - 1))
        return out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """n x tables names of the vectors' own buckets."""
        return self._name(self._slots(x)[0])

    def probes(self, x: np.ndarray) -> np.ndarray:
        """n x tables x (1 + probes) names of the buckets to visit, own first, then by estimated success."""
        slot, part = self._slots(x)
        n, m = len(x), self.functions
        distance = np.concatenate([part, 1 - part], axis=2) ** 2  # to the slot below, to the slot above
        order = np.argsort(distance, axis=2, kind="stable")
        out = np.empty((n, self.tables, 1 + len(self.sets)), np.int64)
        out[:, :, 0] = self._name(slot)
        for k, ranks in enumerate(self.sets):
            moved = slot.copy()
            for r in ranks:
                which = order[:, :, r - 1]
                step = np.where(which < m, -1, 1)
                np.put_along_axis(moved, (which % m)[..., None], np.take_along_axis(moved, (which % m)[..., None], 2) + step[..., None], 2)
            out[:, :, k + 1] = self._name(moved)
        return out


def block_top_k(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, distance) of each query's k nearest other ids, ties by id; an id with several vectors counts once, by the nearest.

    A matrix product in single precision finds everything within rounding of the k-th distance; those are measured exactly.
    """
    rows, hits, dist = [], [], []
    norm_x = np.einsum("ij,ij->i", x, x)
    most = int(np.unique(x_id, return_counts=True)[1].max()) if len(x_id) else 1
    for s in range(0, len(q), 128):
        part = q[s : s + 128]
        norm_q = np.einsum("ij,ij->i", part, part)
        d = norm_q[:, None] + norm_x[None, :] - 2 * (part @ x.T)
        d[q_id[s : s + 128, None] == x_id[None, :]] = np.inf
        far = min(k * most, d.shape[1])  # k ids are among so many vectors
        last = np.partition(d, far - 1, axis=1)[:, far - 1] if d.shape[1] > far else np.full(len(part), np.finfo(np.float32).max)
        r, c = np.nonzero((d <= (last + 1e-4 * (norm_q + norm_x.max()))[:, None]) & (d < np.inf))
        exact = np.sqrt(((part[r].astype(np.float64) - x[c].astype(np.float64)) ** 2).sum(axis=1))
        if most > 1:
            order = np.lexsort((exact, x_id[c], r))
            r, c, exact = r[order], c[order], exact[order]
            nearest = np.concatenate([[True], (r[1:] != r[:-1]) | (x_id[c[1:]] != x_id[c[:-1]])]) if len(r) else np.zeros(0, bool)
            r, c, exact = r[nearest], c[nearest], exact[nearest]
        order = np.lexsort((x_id[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, np.arange(len(part)))
        keep = np.arange(len(r)) - first[r] < k
        rows.append(r[keep] + s)
        hits.append(c[keep])
        dist.append(exact[keep])
    return np.concatenate(rows), np.concatenate(hits), np.concatenate(dist)


def _matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def vectors_of(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, hash of v) of the usable rows, rows equal in both once."""
    v = F.col(f"`{vector_column}`").cast("array<float>")
    df = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v"))
    ok = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return df.where(F.coalesce(ok, F.lit(False))).withColumn("vh", F.xxhash64("v")).dropDuplicates(["id", "vh"])


def nearest_of(base: DataFrame, q: np.ndarray, q_id: np.ndarray, k: int) -> list[tuple[int, float, list[float]]]:
    """(query row, distance, vector) of the exact k nearest of a few queries, from all rows."""
    n = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                r, c, d = block_top_k(q, q_id, _matrix(batch.column("v"), n), batch.column("id").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), batch.column("id").take(pa.array(c)), pa.array(d), batch.column("v").take(pa.array(c))], ["q", "id", "d", "v"])

    each = base.select("id", "v").mapInArrow(run, "q int, id long, d double, v array<float>").groupBy("q", "id").agg(F.min(F.struct("d", "v")).alias("x"))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("x.d", "id"))).where(F.col("r") <= k)
    return [(r["q"], r["d"], r["v"]) for r in ranked.select("q", "x.d", "x.v").collect()]


def tuned(base: DataFrame, dimensions: int, scale: float, k: int, recall: float = RECALL) -> dict[str, float]:
    """The cheapest parameters of the grid that find ``recall`` of the sampled queries' true neighbours, with what they cost: ``share`` of the rows compared."""
    sample = hashed_sample(base, TUNE_ROWS, "id", "vh").select("id", "v", "vh").toPandas().sort_values(["vh", "id"])
    x, ids = np.stack(sample["v"].to_list()).astype(np.float32), sample["id"].to_numpy()
    asked = slice(0, TUNE_QUERIES)
    truth = nearest_of(base, x[asked], ids[asked], k)
    if not truth:
        return {"tables": 1, "functions": 2, "width": 4.0, "probes": 0, "recall": 1.0, "share": 1.0}
    owner, near = np.array([t[0] for t in truth]), np.array([t[2] for t in truth], np.float32)
    best: dict[str, float] = {}
    for functions in GRID["functions"]:
        for width in GRID["width"]:
            h = Hashing(dimensions, max(GRID["tables"]), functions, width, MOST_PROBES, scale)
            looked, at_near, at_all = h.probes(x[asked]), h.buckets(near), h.buckets(x)
            hit = at_near[:, :, None] == looked[owner]  # neighbour x table x probe
            met = np.stack([(at_all[:, t, None, None] == looked[None, :, t]).mean(axis=0) for t in range(h.tables)], axis=1)  # query x table x probe
            for tables in GRID["tables"]:
                found = np.maximum.accumulate(hit[:, :tables].any(axis=1), axis=1).mean(axis=0)
                cost = met[:, :tables].sum(axis=1).cumsum(axis=1).mean(axis=0)
                enough = np.flatnonzero(found >= recall)
                if len(enough) and (not best or cost[enough[0]] < best["share"]):
                    best = {"tables": tables, "functions": functions, "width": width, "probes": int(enough[0]), "recall": float(found[enough[0]]), "share": float(cost[enough[0]])}
    return best or {"tables": 1, "functions": 1, "width": 1e6, "probes": 0, "recall": 1.0, "share": 1.0}


def nearest_neighbours(vectors: DataFrame, asked: DataFrame | None = None, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", **hashing: float) -> DataFrame:
    """(vec_id, neighbour_id, distance, rank) for every row of ``asked`` (by default of ``vectors``) against all of ``vectors``.

    ``hashing`` gives tables, functions, width and probes; without it they are tuned.
    """
    if k < 1:
        raise ValueError("k must be positive")
    base = vectors_of(vectors, id_column, vector_column)
    stats = base.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.avg(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).alias("square")).orderBy(F.desc("rows"), "n").first()
    out = f"{id_column} long, neighbour_id long, distance double, rank int"
    if stats is None:
        return vectors.sparkSession.createDataFrame([], out)
    n, scale = stats["n"], min(max(stats["square"], 1e-12), 1e30) ** 0.5
    base = base.where(F.size("v") == n)
    queries = base if asked is None else vectors_of(asked, id_column, vector_column).where(F.size("v") == n)
    hashing = hashing or tuned(base, n, scale, k)
    h = Hashing(n, *(hashing[p] for p in ("tables", "functions", "width", "probes")), scale=scale)

    def copies(probing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("v"), n)
                names = h.probes(x) if probing else h.buckets(x)[:, :, None]
                row, table, _ = np.indices(names.shape)
                row, table, names = row.ravel(), table.ravel(), names.ravel()
                order = np.argsort(table, kind="stable")
                part = batch.take(pa.array(row[order]))
                yield pa.RecordBatch.from_arrays([pa.array(table[order].astype(np.int32)), pa.array(names[order]), *part.columns], ["tab", "bucket", *part.schema.names])

        return run

    schema = "tab int, bucket long, id long, v array<float>, vh long"
    key = ["tab", "bucket"]
    data = base.mapInArrow(copies(False), schema)
    # Queries of hot buckets are spread over parts, vectors of hot buckets over blocks: the grid of both, for each bucket with queries.
    asking = queries.mapInArrow(copies(True), schema)
    wanted = checkpoint(asking.groupBy(*key).agg(F.count("*").alias("asked")))
    grid = data.select(*key).join(small(wanted), key).groupBy(*key).agg(F.count("*").alias("n"), F.first("asked").alias("asked"))
    grid = small(checkpoint(grid.select(*key, F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("asked") / QUERIES).alias("parts"))))
    own = F.pmod(F.xxhash64("vh", "id"), F.col("blocks"))
    part = F.pmod(F.xxhash64("id", "vh"), F.col("parts"))
    cells = [*key, "block", "part"]
    data = data.join(grid, key).withColumns({"block": own, "part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))}).select(*cells, "id", "v")
    asking = asking.join(grid, key).withColumns({"part": part, "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))}).select(*cells, "id", "v", "vh")
    result = pa.schema([("id", pa.int64()), ("vh", pa.int64()), ("neighbour_id", pa.int64()), ("distance", pa.float64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return result.empty_table()
        x_id, q_id = left.column("id").to_numpy(), right.column("id").to_numpy()
        r, c, d = block_top_k(_matrix(right.column("v"), n), q_id, _matrix(left.column("v"), n), x_id, k)
        return pa.table([q_id[r], right.column("vh").to_numpy()[r], x_id[c], d], schema=result)

    found = data.groupBy(*cells).cogroup(asking.groupBy(*cells)).applyInArrow(compare, "id long, vh long, neighbour_id long, distance double")
    best = found.groupBy("id", "vh", "neighbour_id").agg(F.min("distance").alias("distance"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id", "vh").orderBy("distance", "neighbour_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(id_column), "neighbour_id", "distance", "rank")
