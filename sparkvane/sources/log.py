"""Durable upserts and removals: an append-only log of Parquet batches.

Every batch is one folder ``tx=<number>`` that counts only once its ``_SUCCESS`` marker is there, so a batch that a crash cut off is
as if it had never been. The live view takes the last entry of each id and leaves removed ids out. Compaction writes
the live view as a new base and never touches what is being read.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .documents import unify


def live_view(log: DataFrame, id_col: str = "doc_id", order: tuple[str, ...] = ("tx", "seq"), op: str = "op") -> DataFrame:
    """The last entry of each id by ``order``, unless it removes the id."""
    last = Window.partitionBy(id_col).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("__n", F.row_number().over(last)).where((F.col("__n") == 1) & (F.col(op) == "ADD")).drop("__n", op, *order)


class MutationLog:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id") -> None:
        self.spark, self.path, self.id_col = spark, path.rstrip("/"), id_col
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def _folders(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._exists(self.path) else []

    def transactions(self) -> list[int]:
        """The committed batches since the last committed base, that base included (as its last transaction)."""
        done = [f for f in self._folders() if self._exists(f"{self.path}/{f}/_SUCCESS")]
        base = max((int(f[5:]) for f in done if f.startswith("base=")), default=None)
        later = [int(f[3:]) for f in done if f.startswith("tx=") and (base is None or int(f[3:]) > base)]
        return ([base] if base is not None else []) + sorted(later)

    def _next(self) -> int:
        return max((int(f.split("=")[1]) for f in self._folders() if "=" in f), default=0) + 1

    def _append(self, df: DataFrame, op: str, tx: int | None) -> int:
        tx = self._next() if tx is None else tx
        target = f"{self.path}/tx={tx:012d}"
        if self._exists(f"{target}/_SUCCESS"):
            return tx  # a replay of a committed batch changes nothing
        out = df.withColumns({"op": F.lit(op), "seq": F.monotonically_increasing_id()})
        out.write.mode("overwrite").parquet(target)
        return tx

    def add(self, docs: DataFrame, tx: int | None = None) -> int:
        """Append an upsert of ``docs``; of rows with one id the last wins. Returns the transaction's number."""
        if self.id_col not in docs.columns:
            raise ValueError(f"no id column {self.id_col!r}")
        return self._append(docs, "ADD", tx)

    def remove(self, ids: DataFrame, tx: int | None = None) -> int:
        return self._append(ids.select(F.col(ids.columns[0]).alias(self.id_col)), "REMOVE", tx)

    def entries(self) -> DataFrame | None:
        """All committed entries since the last base, with ``tx``, ``op`` and ``seq``.

        Transactions of one schema, or of schemas that merge, are one read whatever their number; only where a field has values of different kinds is each read by itself.
        """
        numbers = self.transactions()
        if not numbers:
            return None
        first = f"{self.path}/base={numbers[0]:012d}"
        has_base = self._exists(f"{first}/_SUCCESS")
        base = [self.spark.read.parquet(first).withColumn("tx", F.lit(numbers[0]))] if has_base else []
        rest = numbers[1:] if has_base else numbers
        folders = [f"{self.path}/tx={n:012d}" for n in rest]
        if not rest:
            return base[0]
        try:
            later = [self.spark.read.option("basePath", self.path).option("mergeSchema", True).parquet(*folders)]
        except PySparkException:  # the schemas don't merge
            later = [self.spark.read.parquet(f).withColumn("tx", F.lit(n)) for f, n in zip(folders, rest, strict=True)]
        return unify([*base, *later])

    def live(self) -> DataFrame:
        """The documents as they are now."""
        log = self.entries()
        if log is None:
            raise ValueError("the log is empty")
        return live_view(log, self.id_col)

    def count(self) -> int:
        return 0 if not self.transactions() else self.live().count()

    def compact(self) -> int:
        """Write the live view as a base that replaces all committed batches up to now."""
        tx = max(self.transactions())
        if self._exists(f"{self.path}/base={tx:012d}/_SUCCESS"):
            return tx
        self.live().withColumns({"op": F.lit("ADD"), "seq": F.monotonically_increasing_id()}).write.mode("overwrite").parquet(f"{self.path}/base={tx:012d}")
        return tx

    def bytes(self) -> int:
        """Size of the log on disk."""
        return self._fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)).getLength() if self._exists(self.path) else 0
