"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import idsets, retrieval, telemetry
from .operators.collection import Collection
from .operators.embedding_store import EmbeddingStore, decoded
from .operators.indexed import IndexedCollection
from .operators.string_index import StringIndex
from .operators.vector_index import VectorIndex
from .plans.query import IntCompare, Multi, Not, Query, QueryBuilder, Similar, StringMatch
from .sources import documents, files, ingest
from .sources.log import MutationLog, live_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """A stored vector as a literal, so that the search is a plain scan."""
    return [float(x) for x in _read(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def _embeddings(spark: SparkSession, d: str) -> Collection:
    return Collection(_read(spark, d, "embeddings"), "vec_id")


def _parts(spark: SparkSession, d: str) -> Collection:
    return Collection(_read(spark, d, "part"), "p_partkey")


# Cosine in double precision, summed in order; DuckDB's own cosine is single precision.
def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _cos(a: str, b: str) -> str:
    return f"{_dot(a, b)} / greatest(sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}), 1e-8)"


_SCORED = f"scored AS (SELECT e.*, {_cos('e.embedding', 'q.embedding')} AS c FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _vec(c: Collection, q: Query, k: int | None = None, **options: Any) -> DataFrame:
    return c.search(q, k, fields=[], **options).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED} SELECT vec_id, round(c, 6) AS score FROM scored WHERE c > 0 ORDER BY c DESC, vec_id LIMIT 10")
def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vec(_embeddings(spark, d), Similar("embedding", tuple(_vector(spark, d))), 10)


@query(f"WITH {_SCORED} SELECT vec_id, round(c, 6) AS score FROM scored WHERE c > 0")
def vec_all_positive(spark: SparkSession, d: str) -> DataFrame:
    return _vec(_embeddings(spark, d), Similar("embedding", tuple(_vector(spark, d))))


@query(f"WITH {_SCORED} SELECT vec_id, round(c, 6) AS score FROM scored WHERE c > 0 AND c >= 0.2 ORDER BY c DESC, vec_id LIMIT 20")
def vec_min_score(spark: SparkSession, d: str) -> DataFrame:
    return _vec(_embeddings(spark, d), Similar("embedding", tuple(_vector(spark, d))), 20, min_score=0.2)


@query(f"WITH {_SCORED} SELECT vec_id, label, floor(100 * c + 0.5) / 100 AS score FROM scored WHERE c >= 0.1")
def vec_score_rounded(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.relevant_files(_read(spark, d, "embeddings"), _vector(spark, d), 0.1, id_col="vec_id")


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, {_cos('e.embedding', 'q.embedding')} AS c FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM p WHERE c > 0)
SELECT query_id, vec_id, round(c, 6) AS score, rank FROM r WHERE rank <= 5""")
def vec_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks all of them."""
    asked = _read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _embeddings(spark, d).search_batch(asked, "embedding", 5).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def projection(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).search(IntCompare("label", "=", 3), fields=["label"]).drop("score")


def _leaf(name: str, table: str, id_col: str, q: Query, condition: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Collection(_read(spark, d, table), id_col).search(q, fields=[])

    run.__name__ = name
    query(f"SELECT {id_col}, 1.0::DOUBLE AS score FROM {table} WHERE {condition}")(run)


_leaf("str_eq", "documents", "doc_id", StringMatch("lang", "equals", "de"), "lang = 'de'")
_leaf("str_prefix", "part", "p_partkey", StringMatch("p_name", "starts_with", "s"), "starts_with(p_name, 's')")
_leaf("str_suffix", "documents", "doc_id", StringMatch("source", "ends_with", "7"), "suffix(source, '7')")
_leaf("str_contains", "documents", "doc_id", StringMatch("text", "contains", "tion"), "contains(text, 'tion')")
_leaf("int_eq", "part", "p_partkey", IntCompare("p_size", "=", 15), "p_size = 15")
_leaf("int_lt", "part", "p_partkey", IntCompare("p_size", "<", 15), "p_size < 15")
_leaf("int_le", "part", "p_partkey", IntCompare("p_size", "<=", 15), "p_size <= 15")
_leaf("int_gt", "part", "p_partkey", IntCompare("p_size", ">", 15), "p_size > 15")
_leaf("int_ge", "part", "p_partkey", IntCompare("p_size", ">=", 15), "p_size >= 15")
_leaf("int_scale", "lineitem", "l_orderkey", IntCompare("l_linenumber", ">", 5), "l_linenumber > 5")

_SMALL, _S = IntCompare("p_size", "<", 20), StringMatch("p_name", "contains", "e")
_A, _B, _C = "(p_size < 20)", "contains(p_name, 'e')", "(p_size >= 10)"


def _tree(name: str, q: Query, sql: str, scoring: str = "mean") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _parts(spark, d).search(q, fields=[], scoring=scoring).withColumn("score", F.round("score", 6))

    run.__name__ = name
    query(sql)(run)


def _mean(*conditions: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END" for c in conditions) + f") / {len(conditions)}"


_tree("and_mean", Multi("AND", (_SMALL, _S)), f"SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE {_A} AND {_B}")
_tree("or_mean", Multi("OR", (_SMALL, _S)), f"SELECT p_partkey, {_mean(_A, _B)} AS score FROM part WHERE {_A} OR {_B}")
_tree("not_pred", Not(_SMALL), f"SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE NOT {_A}")
_tree("not_not", Not(Not(_SMALL)), f"SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE {_A}")
_tree("and3_mean", Multi("AND", (_SMALL, _S, IntCompare("p_size", ">=", 10))), f"SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE {_A} AND {_B} AND {_C}")
_tree("or3_mean", Multi("OR", (_SMALL, _S, IntCompare("p_size", ">=", 10))), f"SELECT p_partkey, round({_mean(_A, _B, _C)}, 6) AS score FROM part WHERE {_A} OR {_B} OR {_C}")
_tree("nested_not", Multi("AND", (Not(Multi("OR", (_SMALL, Not(_S)))), IntCompare("p_size", ">=", 10))), f"SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE NOT ({_A} OR NOT {_B}) AND {_C}")
_tree("or3_geo", Multi("OR", (_SMALL, _S, IntCompare("p_size", ">=", 10))), f"SELECT p_partkey, (CASE WHEN {_A} OR {_B} THEN {_mean(_A, _B)} ELSE 0 END + CASE WHEN {_C} THEN 1 ELSE 0 END) / 2 AS score FROM part WHERE {_A} OR {_B} OR {_C}", "geometric")
_tree("builder", QueryBuilder().starts_with("s", "p_name").is_greater_than(30, "p_size").not_(QueryBuilder().is_equal(40, "p_size")).build(), "SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE starts_with(p_name, 's') AND p_size > 30 AND p_size <> 40")


@query("SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE NOT (p_partkey % 2 = 0 AND p_size = 15)")
def not_missing(spark: SparkSession, d: str) -> DataFrame:
    half = _read(spark, d, "part").withColumn("size", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")))
    return Collection(half, "p_partkey").search(Not(IntCompare("size", "=", 15)), fields=[])


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents LEFT JOIN (SELECT doc_id AS l, max(toxic) AS t FROM labels GROUP BY 1) ON l = doc_id WHERE NOT coalesce(t = 1, false)")
def not_missing_label(spark: SparkSession, d: str) -> DataFrame:
    labels = _read(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return Collection(_read(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left"), "doc_id").search(Not(IntCompare("toxic", "=", 1)), fields=[])


def _hybrid(name: str, make: Callable[[Query], Query], scoring: str, score: str, hit: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _vec(_embeddings(spark, d), make(Similar("embedding", tuple(_vector(spark, d)))), scoring=scoring)

    run.__name__ = name
    query(f"WITH {_SCORED}, b AS (SELECT vec_id, c, CASE WHEN label >= 5 THEN 1.0::DOUBLE ELSE 0.0 END AS l FROM scored), s AS (SELECT vec_id, c, l, {score} AS s FROM b) SELECT vec_id, round(s, 6) AS score FROM s WHERE {hit}")(run)


_LABEL = IntCompare("label", ">=", 5)
_hybrid("hybrid_and_mean", lambda v: Multi("AND", (v, _LABEL)), "mean", "CASE WHEN c = 0 OR l = 0 THEN 0 ELSE (c + l) / 2 END", "s > 0")
_hybrid("hybrid_or_mean", lambda v: Multi("OR", (v, _LABEL)), "mean", "(c + l) / 2", "s > 0")
_hybrid("hybrid_not_mean", lambda v: Multi("OR", (Not(v), _LABEL)), "mean", "(CASE WHEN c = 0 THEN 1 ELSE 0 END + l) / 2", "s > 0")
_hybrid("hybrid_and_geo", lambda v: Multi("AND", (v, _LABEL)), "geometric", "sqrt(greatest(c * l, 0))", "c > 0 AND l > 0")
_hybrid("hybrid_or_geo", lambda v: Multi("OR", (v, _LABEL)), "geometric", "(c + l) / 2", "c > 0 OR l > 0")
_hybrid("hybrid_not_geo", lambda v: Multi("AND", (Not(v), _LABEL)), "geometric", "sqrt(greatest((1 - c) * l, 0))", "NOT c > 0 AND l > 0")


def _two(name: str, op: str, condition: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _read(spark, d, "embeddings").withColumn("reversed", F.reverse("embedding"))
        b = QueryBuilder()
        v = _vector(spark, d)
        b = b.all_similar_to(v, ["embedding", "reversed"]) if op == "AND" else b.any_similar_to(v, ["embedding", "reversed"])
        return _vec(Collection(df, "vec_id"), b.build())

    run.__name__ = name
    query(f"""WITH s AS (SELECT e.vec_id, {_cos('e.embedding', 'q.embedding')} AS a, {_cos('list_reverse(e.embedding)', 'q.embedding')} AS b FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT vec_id, round((a + b) / 2, 6) AS score FROM s WHERE {condition}""")(run)


_two("all_similar", "AND", "a <> 0 AND b <> 0 AND (a + b) / 2 > 0")
_two("any_similar", "OR", "(a + b) / 2 > 0")


@query(f"""WITH {_SCORED}, m AS (SELECT label, list_sum(list(c ORDER BY vec_id)) / count(*) AS c FROM scored GROUP BY label) SELECT label, round(c, 6) AS score FROM m WHERE c > 0""")
def matrix_similar(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    m = _read(spark, d, "embeddings").groupBy("label").agg(F.transform(rows, lambda r: r["embedding"]).alias("matrix"))
    return Collection(m, "label").search(Similar("matrix", tuple(_vector(spark, d))), fields=[]).withColumn("score", F.round("score", 6))


@query(f"WITH s AS (SELECT e.vec_id, {_dot('e.embedding', 'q.embedding')} AS c FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) SELECT vec_id, round(c, 6) AS score FROM s WHERE c > 0")
def metric_dot(spark: SparkSession, d: str) -> DataFrame:
    return _vec(_embeddings(spark, d), Similar("embedding", tuple(_vector(spark, d))), metric="dot")


def _indexed(name: str, op: str, value: str, condition: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        part = _read(spark, d, "part")
        return StringIndex.build(part, "p_name", "p_partkey").search(part, StringMatch("p_name", op, value)).select("p_partkey", "p_name")

    run.__name__ = name
    query(f"SELECT p_partkey, p_name FROM part WHERE {condition}")(run)


_indexed("idx_str_eq", "equals", "small ring", "p_name = 'small ring'")
_indexed("idx_str_prefix", "starts_with", "s", "starts_with(p_name, 's')")
_indexed("idx_str_suffix", "ends_with", "g", "suffix(p_name, 'g')")
_indexed("idx_str_contains", "contains", "e", "contains(p_name, 'e')")


@query("SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE (starts_with(p_name, 's') OR suffix(p_name, 'g')) AND NOT contains(p_name, 'e') AND p_size < 20")
def indexed_tree(spark: SparkSession, d: str) -> DataFrame:
    c = IndexedCollection.configured(_read(spark, d, "part"), {"string_indexes": "p_name"}, "p_partkey")
    either = Multi("OR", (StringMatch("p_name", "starts_with", "s"), StringMatch("p_name", "ends_with", "g")))
    return c.search_indexed(Multi("AND", (either, Not(_S), _SMALL)), fields=[]).withColumn("score", F.ceil("score").cast("double"))


@query(f"WITH {_SCORED} SELECT vec_id, round(c, 6) AS score FROM scored WHERE c > 0 AND label < 5 ORDER BY c DESC, vec_id LIMIT 10")
def indexed_nearest(spark: SparkSession, d: str) -> DataFrame:
    c = IndexedCollection(_read(spark, d, "embeddings"), "vec_id").with_vector_index("embedding", 8)
    return c.search_nearest("embedding", _vector(spark, d), 10, 8, IntCompare("label", "<", 5)).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, n_chars, NULL::VARCHAR AS n_chars__string FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, NULL, n_chars::VARCHAR FROM documents WHERE lang <> 'en'")
def unify_kinds(spark: SparkSession, d: str) -> DataFrame:
    df = _read(spark, d, "documents")
    return documents.unify([df.where("lang = 'en'").select("doc_id", "n_chars"), df.where("lang <> 'en'").select("doc_id", F.col("n_chars").cast("string").alias("n_chars"))])


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') AS ts, user_id, event_type, value::VARCHAR AS value, props FROM events")
def coerce_documents(spark: SparkSession, d: str) -> DataFrame:
    """The whole table with its timestamps."""
    return documents.coerce(_read(spark, d, "events"))


def _set(name: str, combine: Callable[[DataFrame, DataFrame], DataFrame], condition: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = _parts(spark, d)
        return combine(idsets.ids(p.scored(_SMALL), "p_partkey"), idsets.ids(p.scored(_S), "p_partkey"))

    run.__name__ = name
    query(f"SELECT p_partkey FROM part WHERE {condition}")(run)


_set("idset_and", idsets.both, f"{_A} AND {_B}")
_set("idset_or", idsets.either, f"{_A} OR {_B}")
_set("idset_andnot", idsets.only_first, f"{_A} AND NOT {_B}")

_LIVE = "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)"


def _mutations(spark: SparkSession, d: str) -> DataFrame:
    """Events as a mutation log by user: an error removes the user, anything else upserts its last value."""
    return _read(spark, d, "events").withColumn("op", F.when(F.col("event_type") == "error", "REMOVE").otherwise("ADD"))


@query(f"{_LIVE} SELECT user_id, event_type, value, props FROM l WHERE n = 1")
def upsert_live_view(spark: SparkSession, d: str) -> DataFrame:
    return live_view(_read(spark, d, "events").withColumn("op", F.lit("ADD")), "user_id", ("ts", "event_id"))


@query(f"{_LIVE} SELECT user_id, event_type, value, props FROM l WHERE n = 1 AND event_type <> 'error'")
def remove_live_view(spark: SparkSession, d: str) -> DataFrame:
    return live_view(_mutations(spark, d), "user_id", ("ts", "event_id"))


@query(f"{_LIVE} SELECT count(*) AS n FROM l WHERE n = 1 AND event_type <> 'error'")
def count_live(spark: SparkSession, d: str) -> DataFrame:
    return live_view(_mutations(spark, d), "user_id", ("ts", "event_id")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id = 17")
def get_by_id(spark: SparkSession, d: str) -> DataFrame:
    return Collection(_read(spark, d, "documents"), "doc_id").get(17)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, 'new ' || p_name, p_size FROM part WHERE p_size >= 20 AND p_size <= 40")
def collection_add_remove(spark: SparkSession, d: str) -> DataFrame:
    part = _read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    c = Collection(part, "p_partkey").add(part.where("p_size >= 20").withColumn("p_name", F.concat(F.lit("new "), "p_name")))
    return c.remove(part.where("p_size > 40").select("p_partkey")).df


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder: below the session's shared one, or a temporary one for a session in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not shared and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='sparkvane-')}/{name}-{uuid.uuid4().hex}"


_INDEXES: dict[tuple[str, str], VectorIndex] = {}


def _index(spark: SparkSession, d: str) -> VectorIndex:
    """The tables' index: built and written at the first search of a session, read by all later ones."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = VectorIndex.build(_read(spark, d, "embeddings"), "embedding", "vec_id").write(_folder(spark, "index"))
    return _INDEXES[key]


@query(SQL["vec_topk"])
def ann_full_probe(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return index.search(_vector(spark, d), 10, index.nlist).select("vec_id", F.round("score", 6).alias("score"))


@query()
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(_vector(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(SQL["vec_topk"])
def ann_add_remove(spark: SparkSession, d: str) -> DataFrame:
    """An index of half of the vectors, to which the other half and some strangers are added, and these removed again."""
    e = _read(spark, d, "embeddings").select("vec_id", "embedding")
    strangers = e.withColumn("vec_id", -F.col("vec_id") - 1)
    index = VectorIndex.build(e.where("vec_id % 2 = 0"), "embedding", "vec_id").add(e.where("vec_id % 2 = 1").union(strangers)).remove(strangers.select("vec_id"))
    return index.search(_vector(spark, d), 10, index.nlist).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def ndjson_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines and read with their schema."""
    docs, path = _read(spark, d, "documents"), _folder(spark, "ndjson")
    docs.write.json(path)
    return files.read_ndjson(spark, path, docs.schema)


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, value FROM l WHERE n = 1 AND event_type <> 'error'")
def log_recovery(spark: SparkSession, d: str) -> DataFrame:
    """The events, in order, as transactions of a log with a compaction among them, a batch that a crash cut off and one that is replayed."""
    e = _read(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id")
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    log = MutationLog(spark, _folder(spark, "log"), "user_id")
    edges = e.approxQuantile("event_id", [0.3, 0.6], 0.0)
    # By time, so that later transactions hold later entries; within one, the last of each user.
    cuts = [None, *[r[0] for r in e.where(F.col("event_id").isin(edges)).select("ts").orderBy("ts").collect()], None]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = e if a is None else e.where(F.col("ts") > a)
        part = part if b is None else part.where(F.col("ts") <= b)
        part = part.withColumn("n", F.row_number().over(last)).where("n = 1")
        tx = log.add(part.where("event_type <> 'error'").select("user_id", "event_type", "value"))
        log.remove(part.where("event_type = 'error'").select("user_id"))
        if k == 0:
            log.compact()
        if k == 1:
            log.add(e.select("user_id", F.lit("replayed").alias("event_type"), "value"), tx=tx)
    e.limit(5).select("user_id", F.lit("lost").alias("event_type"), "value", F.lit("ADD").alias("op"), F.lit(0).cast("long").alias("seq")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).parquet(f"{log.path}/tx={9999:012d}")
    return MutationLog(spark, log.path, "user_id").live().select("user_id", "event_type", "value")


@query(f"WITH {_SCORED} SELECT vec_id, round((c + 1) / 2, 6) AS score FROM scored WHERE c > 0 AND label >= 5 ORDER BY c DESC, vec_id LIMIT 10")
def ann_filtered(spark: SparkSession, d: str) -> DataFrame:
    index = VectorIndex.build(_read(spark, d, "embeddings"), "embedding", "vec_id")
    return index.search(_vector(spark, d), 10, index.nlist, F.col("label") >= 5, blend_match_all=True).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE label <> 9) AS ingested, count(*) FILTER (WHERE label = 9) AS errors FROM embeddings")
def ingest_validate(spark: SparkSession, d: str) -> DataFrame:
    ragged = F.when(F.col("label") == 9, F.array("embedding", F.slice("embedding", 1, 3))).otherwise(F.array("embedding", F.reverse("embedding")))
    return ingest.summary(_read(spark, d, "embeddings").withColumn("matrix", ragged), "vec_id")


_V3 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"SELECT page_id, {_V3} AS doc_id FROM (SELECT page_id, md5(url || '#page:1') AS h FROM pages)")
def page_ids(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", documents.name_uuid(F.concat("url", F.lit("#page:1"))).alias("doc_id"))


@query()
def page_docs(spark: SparkSession, d: str) -> DataFrame:
    return files.page_documents(_read(spark, d, "pages"))


@query(f"SELECT conv_id, turn, {_V3} AS doc_id FROM (SELECT conv_id, turn, md5(conv_id || '#page:' || turn) AS h FROM conversations)")
def turn_ids(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "conversations")
    return c.select("conv_id", "turn", documents.name_uuid(F.concat(F.col("conv_id").cast("string"), F.lit("#page:"), F.col("turn").cast("string"))).alias("doc_id"))


def _store(spark: SparkSession, d: str) -> EmbeddingStore:
    e = _read(spark, d, "embeddings")
    store = EmbeddingStore(spark)
    meta = F.create_map(F.lit("label"), F.concat(F.lit("integer:"), F.col("label").cast("string")), F.lit("note"), F.concat(F.lit("string:a:"), F.col("label").cast("string")))
    store.add_frame(e.select(F.format_string("%012d", "vec_id").alias("doc_id"), (F.col("vec_id") % 100).cast("string").alias("extId"), "embedding", F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), meta.alias("metadata")))
    return store


@query(f"WITH {_SCORED} SELECT (vec_id % 100)::VARCHAR AS \"extId\", round(c, 6) AS score, 'text ' || vec_id AS text FROM scored WHERE c >= 0.15 AND c > 0 ORDER BY c DESC, vec_id LIMIT 25")
def emb_store_search(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).search(_vector(spark, d), 25, 0.15).select("extId", F.round("score", 6).alias("score"), "text")


@query("SELECT (vec_id % 100)::VARCHAR AS \"extId\", 'text ' || vec_id AS text FROM embeddings WHERE vec_id % 100 NOT IN (3, 7)")
def emb_store_remove(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    store.remove_all(["3", "7"])
    return store.df.select("extId", "text")


@query("SELECT 'text ' || vec_id AS text, 'integer' AS label_kind, label::DOUBLE AS label_number, 'string' AS note_kind, 'a:' || label AS note_text FROM embeddings")
def metadata_decode(spark: SparkSession, d: str) -> DataFrame:
    df = _store(spark, d).df.select("text", decoded(F.col("metadata")["label"]).alias("l"), decoded(F.col("metadata")["note"]).alias("n"))
    return df.select("text", F.col("l.kind").alias("label_kind"), F.col("l.number").alias("label_number"), F.col("n.kind").alias("note_kind"), F.col("n.text").alias("note_text"))


@query(f"""WITH {_SCORED}, t AS (SELECT 'text ' || vec_id AS text, c, vec_id FROM scored WHERE c >= 0.2 ORDER BY c DESC, vec_id LIMIT 2)
SELECT count(*) AS n_passages, string_agg(text, chr(10) || chr(10) ORDER BY c DESC, vec_id) AS context FROM t""")
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    passages = _read(spark, d, "embeddings").withColumn("text", F.concat(F.lit("text "), F.col("vec_id").cast("string")))
    return retrieval.context(passages, _vector(spark, d), 2, 0.2, id_col="vec_id")


@query("SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY event_type")
def metric_counts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.counters(_read(spark, d, "events"), "event_type").withColumn("total", F.round("total", 4))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def metric_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.timers(_read(spark, d, "events"), "event_type").withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p90", "p99")})


@query("SELECT event_type, max(ts) AS ts, arg_max(value, struct_pack(ts := ts, value := value)) AS value FROM events GROUP BY event_type")
def metric_gauge_last(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.gauges(_read(spark, d, "events"), "event_type")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type")
def metric_levels(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "view", "BASIC").when(F.col("event_type") == "click", "DETAILED").otherwise("DIAGNOSTIC")
    return telemetry.at_level(_read(spark, d, "events").withColumn("level", level), "DETAILED").groupBy("event_type").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
