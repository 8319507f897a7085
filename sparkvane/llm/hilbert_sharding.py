"""Sharding along a Hilbert curve over document metadata.

Language, source and length are quantised to ``BITS`` bits each; a cell's place on the Hilbert curve orders the
documents so that a run of them is compact in all three dimensions, and runs of ``SHARD_ROWS`` documents become shards. A file
for each shard then has narrow minima and maxima in every dimension, which readers prune by.

* ``lang`` and ``source``: number of cut points not above the value. The cut points divide the sorted distinct values into 2^BITS equal runs,
  whatever the number of values: up to ``VALUES`` are sorted by the driver, more by range partitions, with the same result.
* ``n_chars``: two steps an octave.

Positions are exact without a global sort: cells and salts within a cell are counted, the counts' running sums give
every (cell, salt) its offset, and a window within (cell, salt) gives the rest. The number of salts grows with the table, so that a hot cell
is cut into windows of about ``WINDOW_ROWS`` rows at most. What is sorted in one task are the cells: 2^(3 x BITS) at most, a parameter.

Nulls and edge cases: a null category counts as the empty string, a null or negative length as 0, a null doc_id sorts before all
others (ids may be of any sortable type). Rows that tie in everything take consecutive places in any order. Every row gets a shard, repeated rows too; an empty
table gives none. Texts, however long, aren't looked at by ``shards``. Other columns are ignored, or kept by ``write_shards``, whatever their names; only columns
called ``hilbert`` or ``shard``, of an earlier sharding, are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

BITS, SHARD_ROWS = 5, 4096
#: Salts at least, rows of a window about, distinct values that are sorted by the driver.
SALTS, WINDOW_ROWS, VALUES = 64, 1 << 20, 10_000
THRESHOLDS = [int(round(2 ** (k / 2))) for k in range(4, 4 + (1 << BITS) - 1)]


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n x dimensions), by transposing axes bit by bit."""
    x = x.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            far = (x[:, i] & q) != 0
            swap = np.where(far, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(far, p, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def curve(spark, bits: int = BITS) -> DataFrame:
    """The curve's place of each of the 2^(3 x bits) cells: a table whose size is a parameter."""
    side = np.arange(1 << bits)
    grid = np.stack([a.ravel() for a in np.meshgrid(side, side, side, indexing="ij")], axis=1)
    return spark.createDataFrame(pd.DataFrame({"x": grid[:, 0].astype(np.int32), "y": grid[:, 1].astype(np.int32), "z": grid[:, 2].astype(np.int32), "cell": hilbert_index(grid, bits)}))


def cut_points(docs: DataFrame, column: str, bits: int = BITS, values: int = VALUES) -> list[str]:
    """At most 2^bits - 1 values: those where the next of 2^bits equal runs of the sorted distinct values begins."""
    steps = 1 << bits
    distinct = docs.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).distinct()
    rows = distinct.limit(values + 1).collect()
    if len(rows) > values:
        return _distributed_cut_points(distinct, steps)
    known = sorted((r["value"] for r in rows), key=lambda v: v.encode())
    return [known[r] for r in _cut_ranks(len(known), steps)]


def _cut_ranks(n: int, steps: int) -> list[int]:
    """The ranks, of n sorted values, at which the next run begins: the first r of which r * steps // max(n, steps) is k."""
    return [r for r in (-(-k * max(n, steps) // steps) for k in range(1, steps)) if r < n]


def _distributed_cut_points(distinct: DataFrame, steps: int) -> list[str]:
    """The same cut points of any number of values: sorted by range partitions, whose sizes tell in which of them, and where, each rank lies."""
    # An id is the partition's number, shifted by 33 bits, and the place in it; written once, so that both queries see the same ids.
    ranged = checkpoint(distinct.orderBy("value").select("value", F.monotonically_increasing_id().alias("id")))
    sizes = sorted(ranged.groupBy(F.shiftright("id", 33).alias("part")).count().collect())
    ids, before, ranks = [], 0, _cut_ranks(sum(r["count"] for r in sizes), steps)
    for part, n in sizes:
        ids += [(part << 33) + r - before for r in ranks if before <= r < before + n]
        before += n
    return [r["value"] for r in ranged.where(F.col("id").isin(ids)).orderBy("id").collect()]


def _steps(value: F.Column, cuts: list) -> F.Column:
    out = F.lit(0)
    for c in cuts:
        out = out + (value >= F.lit(c)).cast("int")
    return out


def placed(docs: DataFrame, bits: int = BITS, shard_rows: int = SHARD_ROWS, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``docs`` with ``hilbert`` and ``shard``."""
    kept = [c for c in docs.columns if c.lower() not in ("hilbert", "shard")]
    salts = max(SALTS, -(-docs.count() // window_rows))
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    whole = docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte")
    salt = F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if whole else F.xxhash64(F.col("doc_id").cast("string")), F.lit(salts))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), _steps(lang, cut_points(docs, "lang", bits)).alias("x"), _steps(source, cut_points(docs, "source", bits)).alias("y"), _steps(F.coalesce(F.col("n_chars"), F.lit(0)), THRESHOLDS).alias("z"), salt.alias("salt"))
    base = base.join(F.broadcast(curve(docs.sparkSession, bits)), ["x", "y", "z"]).select("row", "cell", "salt")
    counts = base.groupBy("cell", "salt").count()
    cells = counts.groupBy("cell").agg(F.sum("count").alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("inner", F.sum("count").over(within)).join(cells.select("cell", "before"), "cell")
    offsets = offsets.select("cell", "salt", (F.coalesce("before", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("row.doc_id"))
    ranked = base.withColumn("nth", nth).join(offsets, ["cell", "salt"])
    shard = F.floor((F.col("offset") + F.col("nth") - 1) / shard_rows).cast("long")
    return ranked.select(*[F.col(f"row.`{c}`") for c in kept], F.col("cell").alias("hilbert"), shard.alias("shard"))


def shards(docs: DataFrame, bits: int = BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, hilbert, shard) of every row."""
    return placed(docs.select("doc_id", "lang", "source", "n_chars"), bits, shard_rows).select("doc_id", "hilbert", "shard")


def write_shards(docs: DataFrame, path: str, bits: int = BITS, shard_rows: int = SHARD_ROWS, shards_per_task: int = 16) -> None:
    """Write ``docs`` with one file a shard, in one folder: tasks take runs of shards, sorted along the curve, and begin a new file after each."""
    out = placed(docs, bits, shard_rows)
    tasks = max(1, -(-docs.count() // (shard_rows * shards_per_task)))
    out = out.repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "hilbert")
    out.drop("hilbert").write.option("maxRecordsPerFile", shard_rows).parquet(path)


def shards_sql(bits: int = BITS, shard_rows: int = SHARD_ROWS) -> str:
    """The same rows in SQL: the curve unrolled step by step, a global row number cut into runs."""
    steps, levels = 1 << bits, [1 << b for b in range(bits - 1, 0, -1)]
    names = ["x", "y", "z"]
    thresholds = ", ".join(map(str, THRESHOLDS))
    ctes = [
        "l AS (SELECT lang, floor((row_number() OVER (ORDER BY lang) - 1) * %d / greatest(count(*) OVER (), %d))::BIGINT x FROM (SELECT DISTINCT coalesce(lang, '') lang FROM documents))" % (steps, steps),
        "s AS (SELECT source, floor((row_number() OVER (ORDER BY source) - 1) * %d / greatest(count(*) OVER (), %d))::BIGINT y FROM (SELECT DISTINCT coalesce(source, '') source FROM documents))" % (steps, steps),
        f"c0 AS (SELECT d.doc_id, d.doc_id id, l.x, s.y, len(list_filter([{thresholds}], lambda t: t <= coalesce(d.n_chars, 0)))::BIGINT z FROM documents d JOIN l ON l.lang = coalesce(d.lang, '') JOIN s ON s.source = coalesce(d.source, ''))",
    ]
    k = 0
    for q in levels:
        for i, v in enumerate(names):
            swap = f"(CASE WHEN {v} & {q} <> 0 THEN 0 ELSE xor(x, {v}) & {q - 1} END)"
            first = f"xor(x, CASE WHEN {v} & {q} <> 0 THEN {q - 1} ELSE {swap} END)"
            cols = {n: n for n in names} | {"x": first} | ({v: f"xor({v}, {swap})"} if i else {})
            ctes.append(f"c{k + 1} AS (SELECT doc_id, id, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM c{k})")
            k += 1
    ctes.append(f"g1 AS (SELECT doc_id, id, x, xor(y, x) AS y, xor(z, xor(y, x)) AS z FROM c{k})")
    flip = "0"
    for q in levels:
        flip = f"xor({flip}, CASE WHEN z & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    ctes.append(f"g2 AS (SELECT doc_id, id, xor(x, f) AS x, xor(y, f) AS y, xor(z, f) AS z FROM (SELECT *, {flip} AS f FROM g1))")
    bits_out = " + ".join(f"(((({v} >> {b}) & 1)) << {3 * b + 2 - i})" for b in range(bits - 1, -1, -1) for i, v in enumerate(names))
    ctes.append(f"h AS (SELECT doc_id, id, {bits_out} AS hilbert FROM g2)")
    return f"WITH {', '.join(ctes)} SELECT doc_id, hilbert, (row_number() OVER (ORDER BY hilbert, ((coalesce(id, 0) % n) + n) % n, id NULLS FIRST) - 1) // {shard_rows} AS shard FROM h, (SELECT greatest({SALTS}, (count(*) + {WINDOW_ROWS - 1}) // {WINDOW_ROWS}) AS n FROM documents)"
