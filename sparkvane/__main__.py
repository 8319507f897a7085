"""A small shell: ``load FOLDER`` reads text files, ``exit`` leaves, anything else is searched for; the best ten paths are printed."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.embedding import embed, hashed_embedding
from .operators.collection import Collection
from .plans.query import Similar
from .sources.files import read_text_files


def answer(spark: SparkSession, line: str, loaded: Collection | None) -> tuple[Collection | None, list[str]]:
    """What a line does: the collection afterwards and the lines to print."""
    if line.startswith("load "):
        df = read_text_files(spark, line[5:].strip()).withColumn("embedding", embed(F.col("text"))).cache()
        return Collection(df), [f"{df.count()} documents"]
    if loaded is None:
        return None, ["nothing is loaded: load FOLDER"]
    hits = loaded.search(Similar("embedding", tuple(float(x) for x in hashed_embedding(line))), 10, fields=["path"])
    return loaded, [f"{r['score']:.2f} {r['path']}" for r in hits.collect()]


def main() -> None:
    spark = SparkSession.builder.appName("search").getOrCreate()
    loaded = None
    while (line := input("> ").strip()) != "exit":
        if line:
            loaded, out = answer(spark, line, loaded)
            print("\n".join(out))


if __name__ == "__main__":
    main()
