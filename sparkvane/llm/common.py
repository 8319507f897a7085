"""Identity of documents, checkpoints, bounded samples, size-checked broadcasts and connected components, shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document's identity: 64 and 31 bits of two differently seeded hashes of its id and text, nulls told apart from empty texts.
KEY, HASH = "__doc_key", "__doc_hash"
#: A table of at most this many short rows may be broadcast.
BROADCAST_ROWS = 1_000_000


#: Bytes of a batch that goes to a Python worker, where the session keeps Spark's default (64 MB): a worker's memory is a multiple of it.
BATCH_CONF, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_CONF).rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def identity(doc_id: str = "doc_id", text: str = "text") -> dict[str, F.Column]:
    """The columns ``KEY`` and ``HASH``.

    Rows that agree in both id and text are the same document; all others are different ones, whatever the type of
    the id. 95 bits: among 10^11 documents two agree by chance with a probability of about 10^-7.
    """
    parts = [F.col(doc_id).isNull(), F.col(doc_id).cast("string"), F.col(text).isNull(), F.col(text)]
    return {KEY: F.xxhash64(*parts), HASH: F.shiftrightunsigned(F.xxhash64(F.lit("second"), *parts), 33)}


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, identity) of every row."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text", *[c.alias(k) for k, c in identity().items()])


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    bound_batches(docs.sparkSession)
    return docs.schema[column].dataType.simpleString()


def marked(docs: DataFrame) -> DataFrame:
    """(row, identity): each row of ``docs`` as one struct, so that no column of it can clash with those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in identity().items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which must be cheap to compute twice, marked for a broadcast if it has at most ``rows`` rows; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later stages neither recompute it nor depend on an executor.

    The folder is the session's ``spark.checkpoint.dir``. Only a session that runs in one process may have none: it then
    gets a temporary folder; on a cluster that is an error, as executors would write to their own disks.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or a temporary one for a session in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="sparkvane-")


def hashed_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows, the same ones whatever the partitioning: those whose hashed key is below a threshold set by the count.

    A filter, so that no more than the sample meets anywhere; rows of an equal key share their fate. A table of fewer rows is taken whole.
    """
    n = df.count()
    if n <= rows:
        return df
    share = max(rows - 4 * rows**0.5, 1) / n  # four standard deviations below, so that the limit hardly ever bites
    return df.where(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *key), 1) < F.lit(int(share * (1 << 63)))).limit(rows)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (node, root), root being the least node; nodes without an edge are absent.

    Alternates large-star and small-star steps, each one shuffle, until the edges are stars. Every round is
    checkpointed, so the lineage stays short and a lost executor costs one round at most.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        # A sum by key and a join, not a window: a node may have a third of all edges.
        e = e.join(e.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u")
        # The neighbours (for a large star those above u) and u itself now point to the least of them.
        moved = F.when(F.col("v") == F.col("m"), F.col("u")).when(F.col("v") > F.col("u") if large else F.lit(True), F.col("v"))
        return e.select(moved.alias("u"), F.col("m").alias("v")).where("u is not null and u <> v").distinct()

    e = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        e = checkpoint(star(star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            return e.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root"))))).distinct()
        seen = now
