"""The library on the small fixtures that define its behaviour."""

import itertools
import random
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkvane.functions.embedding import embed, hashed_embedding
from sparkvane.functions.similarity import cosine, rounded_score
from sparkvane.operators import idsets, retrieval, telemetry
from sparkvane.operators.collection import Collection
from sparkvane.operators.embedding_store import EmbeddingStore, decode, decoded, encode
from sparkvane.operators.string_index import StringIndex
from sparkvane.operators.vector_index import VectorIndex
from sparkvane.plans.compiler import Compiler
from sparkvane.plans.query import IntCompare, MatchAll, MatchNone, Multi, Not, QueryBuilder, Similar, StringMatch
from sparkvane.sources import documents, files, ingest
from sparkvane.sources.log import MutationLog
from sparkvane.streaming.ingest import stream_into

MIXED = "doc_id string, s string, n int, v array<float>, m array<array<float>>"


def hits(df):
    return [(r["doc_id"], round(r["score"], 6)) for r in df.collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        ("a", "FIRST DOCUMENT", 100, [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]),
        ("b", "SECOND DOCUMENT", 200, [0.0, 1.0], [[0.0, 1.0], [0.0, 2.0]]),
        ("c", "100%_literal", None, [-1.0, -1.0], []),
        ("d", None, 300, None, None),
        ("e", "", -5, [0.0, 0.0], [[0.0, 0.0]]),
    ]
    return Collection(spark.createDataFrame(rows, MIXED))


def q():
    return QueryBuilder()


@pytest.mark.parametrize(
    ("builder", "want"),
    [
        (q().is_equal("FIRST DOCUMENT", "s"), "a"),
        (q().starts_with("SECOND", "s"), "b"),
        (q().ends_with("DOCUMENT", "s"), "ab"),
        (q().contains("DOC", "s"), "ab"),
        (q().contains("%_", "s"), "c"),
        (q().contains("D%T", "s"), ""),
        (q().starts_with("", "s"), "abce"),
        (q().is_equal(100, "n"), "a"),
        (q().is_greater_than(100, "n"), "bd"),
        (q().is_greater_than_or_equal(200, "n"), "bd"),
        (q().is_less_than(200, "n"), "ae"),
        (q().is_less_than_or_equal(200, "n"), "abe"),
        (q().is_equal(1, "absent"), ""),
        (q().is_equal(1, "s"), ""),
        (q().is_equal("1", "n"), ""),
        (q().not_(q().is_equal(1, "absent")), "abcde"),
        (q().not_(q().is_equal(100, "n")), "bcde"),
        (q().not_(q().contains("DOC", "s")), "cde"),
        (q().not_(q().not_(q().contains("DOC", "s"))), "ab"),
        (q().contains("DOC", "s").is_greater_than(100, "n"), "b"),
        (q().contains("DOC", "s").is_greater_than(250, "n").with_operator("OR"), "abd"),
        (q().not_(q().contains("DOC", "s").is_less_than(0, "n").with_operator("OR")), "cd"),
    ],
)
def test_predicates(mixed, builder, want):
    for scoring in ("mean", "geometric"):
        assert sorted(d for d, _ in hits(mixed.search(builder, scoring=scoring))) == list(want)


def test_vectors(mixed):
    assert hits(mixed.search(q().is_similar_to([1, 0], "v"))) == [("a", 1.0)]
    assert hits(mixed.search(q().is_similar_to([1, 1], "v"))) == [("a", 0.707107), ("b", 0.707107)]
    assert hits(mixed.search(q().is_similar_to([1, 0], "m"))) == [("a", 0.5)]
    assert hits(mixed.search(q().is_similar_to([0, 1], "m"))) == [("b", 1.0), ("a", 0.5)]
    assert hits(mixed.search(q().is_similar_to([1, 1], "v"), 1)) == [("a", 0.707107)]
    assert hits(mixed.search(q().is_similar_to([1, 1], "v"), 0)) == []
    assert hits(mixed.search(q().is_similar_to([1, 1], "v"), min_score=0.8)) == []
    with pytest.raises(ValueError):
        mixed.search(q().is_similar_to([1, 1], "v"), -1)
    with pytest.raises(Exception, match="differ in length"):
        mixed.search(q().is_similar_to([1, 1, 1], "v")).collect()
    assert hits(mixed.search(q().is_similar_to([1, 1, 1], "v"), on_mismatch="skip")) == []


def test_all_and_any_similar(mixed):
    df = mixed.df.where("doc_id in ('a', 'b')").withColumn("w", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    c = Collection(df)
    assert hits(c.search(q().all_similar_to([1, 0], ["v", "w"]))) == [("a", 1.0)]
    assert hits(c.search(q().any_similar_to([1, 0], ["v", "w"]))) == [("a", 1.0), ("b", 0.5)]
    assert q().all_similar_to([1, 0], ["v"]).build() == Similar("v", (1.0, 0.0))
    with pytest.raises(ValueError):
        q().all_similar_to([1, 0], [])


def test_tree_validation():
    with pytest.raises(ValueError):
        q().build()
    with pytest.raises(ValueError):
        Multi("AND", (MatchAll(),))
    with pytest.raises(ValueError):
        StringMatch("f", "like", "x")
    with pytest.raises(ValueError):
        IntCompare("f", "=", "1")
    assert q().is_equal(1, "n").with_operator("OR").build() == IntCompare("n", "=", 1)


# A plain evaluation of both profiles, to compare compiled trees with.


def reference(node, row, scoring):
    """(match, score) of a document."""
    if isinstance(node, MatchAll):
        return True, 1.0
    if isinstance(node, MatchNone):
        return False, 0.0
    if isinstance(node, StringMatch):
        x = row[node.field]
        ok = x is not None and {"equals": x == node.value, "starts_with": x.startswith(node.value), "ends_with": x.endswith(node.value), "contains": node.value in x}[node.op]
        return ok, float(ok)
    if isinstance(node, IntCompare):
        x = row[node.field]
        ok = x is not None and {"=": x == node.value, "<": x < node.value, "<=": x <= node.value, ">": x > node.value, ">=": x >= node.value}[node.op]
        return ok, float(ok)
    if isinstance(node, Similar):
        x = row[node.field]
        if x is None:
            return False, 0.0
        a, b = np.array(x, float), np.array(node.vector)
        s = float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-8))
        return s > 0, s
    if isinstance(node, Not):
        m, s = reference(node.child, row, scoring)
        return (s == 0, float(s == 0)) if scoring == "mean" else (not m, 1 - s)
    parts = [reference(x, row, scoring) for x in node.operands]
    if scoring == "mean":
        s = 0.0 if node.op == "AND" and any(p[1] == 0 for p in parts) else sum(p[1] for p in parts) / len(parts)
        return s > 0, s
    m, s = parts[0]
    for m2, s2 in parts[1:]:
        if node.op == "AND":
            m = m and m2
            s = max(s * s2, 0) ** 0.5 if m else 0.0
        else:
            m = m or m2
            s = (s + s2) / 2 if m else 0.0
    return m, s


LEAVES = st.sampled_from([StringMatch("s", "contains", "DOC"), StringMatch("s", "equals", ""), IntCompare("n", ">", 100), IntCompare("n", "<=", 100), Similar("v", (1.0, 0.0)), Similar("v", (-1.0, 0.5)), MatchAll(), MatchNone()])
TREES = st.recursive(LEAVES, lambda t: st.one_of(t.map(Not), st.tuples(st.sampled_from(["AND", "OR"]), st.lists(t, min_size=2, max_size=3)).map(lambda x: Multi(x[0], tuple(x[1])))), max_leaves=6)


def test_random_trees(mixed):
    rows = [r.asDict() for r in mixed.df.collect()]

    @settings(max_examples=25, deadline=None)
    @given(TREES)
    def check(tree):
        for scoring in ("mean", "geometric"):
            want = {}
            for r in rows:
                m, s = reference(tree, r, scoring)
                if m and (scoring == "geometric" or s > 0):
                    want[r["doc_id"]] = round(s, 5) + 0.0
            assert {r["doc_id"]: round(r["score"], 5) + 0.0 for r in mixed.scored(tree, scoring).collect()} == want

    check()


def test_search_repeats_without_drift_and_projects(mixed):
    b = q().is_similar_to([1, 1], "v").contains("DOC", "s")
    assert hits(mixed.search(b)) == hits(mixed.search(b)) == [("a", 0.853553), ("b", 0.853553)]
    assert mixed.search(b, fields=["n"]).columns == ["doc_id", "n", "score"]


def test_pushdown_and_top_k(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(str(i), f"s{i}", i, [float(i), 1.0], [[1.0]]) for i in range(50)], MIXED).write.parquet(path)
    df = Collection(spark.read.parquet(path)).search(q().starts_with("s1", "s").is_greater_than(10, "n").is_similar_to([1, 0], "v"), 3, fields=[])
    plan = df._jdf.queryExecution().toString()
    assert "StringStartsWith(s,s1)" in plan and "GreaterThan(n,10)" in plan and "TakeOrderedAndProject" in plan
    assert "m:array" not in plan.split("ReadSchema")[1]


def test_large_two_clusters(spark):
    near = spark.range(1000).select(F.concat(F.lit("x"), "id").alias("doc_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("v"))
    far = spark.range(1_000_000).select(F.concat(F.lit("y"), "id").alias("doc_id"), F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>").alias("v"))
    assert Collection(near.union(far)).search(Similar("v", (1.0, 0.0))).count() == 1000


def test_cosine_pairs(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 2.0], [-1.0, -2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    for precision in ("float64", "float32"):
        got = [round(r[0], 4) for r in df.select(cosine(F.col("a"), F.col("b"), precision)).collect()]
        assert got == [1.0, -1.0, 0.0, 0.7071, 0.0]
    x = np.random.default_rng(1).standard_normal((2, 64)).astype(np.float32)
    total = np.float32(0)
    squares = [np.float32(0), np.float32(0)]
    for a, b in zip(*x):
        total = np.float32(total + a * b)
        squares = [np.float32(squares[0] + a * a), np.float32(squares[1] + b * b)]
    want = np.float32(total / np.float32(max(np.sqrt(float(squares[0])) * np.sqrt(float(squares[1])), 1e-8)))
    one = spark.createDataFrame([(x[0].tolist(),)], "a array<float>").select(cosine(F.col("a"), x[1].tolist(), "float32")).first()[0]
    assert abs(one - want) < 1e-7
    assert [r[0] for r in spark.createDataFrame([(0.125,), (0.994,), (-0.005,)], "s double").select(rounded_score(F.col("s"))).collect()] == [0.13, 0.99, 0.0]


def test_metrics_and_stored_norm(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0], 5.0), ("b", [1.0, 0.0], 1.0)], "doc_id string, v array<float>, norm double")
    assert hits(Collection(df).search(Similar("v", (3.0, 4.0)), metric="dot")) == [("a", 25.0), ("b", 3.0)]
    assert hits(Collection(df).search(Similar("v", (3.0, 4.0)), metric="l2"))[0] == ("a", 1.0)
    assert hits(Collection(df, norms={"v": "norm"}).search(Similar("v", (1.0, 0.0)))) == [("b", 1.0), ("a", 0.6)]


def test_batch_search(mixed, spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "query_id int, vector array<float>")
    got = sorted((r["query_id"], r["doc_id"], r["rank"]) for r in mixed.search_batch(asked, "v", 2).collect())
    assert got == [(1, "a", 1), (2, "a", 1), (2, "b", 2)]


def test_collection_changes(spark, mixed):
    c = mixed.add(spark.createDataFrame([("a", "changed", 7.5), ("z", "new", 1.0)], "doc_id string, s string, extra double"))
    assert c.count() == 6 and c.get("a").first()["s"] == "changed" and c.get("a").first()["n"] is None and c.get("nope").count() == 0
    assert c.remove(["a", "unknown"]).count() == 5 and c.remove(c.df.select("doc_id")).count() == 0 and c.remove([]).count() == 6
    c.view("documents_view")
    assert spark.sql("SELECT count(*) FROM documents_view").first()[0] == 6
    with pytest.raises(ValueError):
        Collection(c.df, "no")


def test_unify_keeps_conflicting_kinds(spark):
    a = spark.createDataFrame([("1", 1990)], "doc_id string, year int")
    b = spark.createDataFrame([("2", "MCM")], "doc_id string, year string")
    u = documents.unify([a, b])
    assert u.columns == ["doc_id", "year", "year__string"]
    assert hits(Collection(u).search(q().is_equal("MCM", "year__string"))) == [("2", 1.0)]
    t = documents.coerce(spark.sql("SELECT 1 AS n, true AS b, date'2024-01-02' AS d, array(1f) AS v"))
    assert dict(t.dtypes) == {"n": "int", "b": "string", "d": "string", "v": "array<float>"}


def test_name_uuid(spark):
    import hashlib

    names = ["http://x/y.pdf#page:1", "", "é"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(documents.name_uuid(F.col("n"))).collect()]
    assert got == [str(uuid.UUID(bytes=hashlib.md5(n.encode()).digest(), version=3)) for n in names]


def test_string_index(spark, tmp_path):
    rows = [("1", "John"), ("2", "Jane"), ("3", "John Doe"), ("4", "Mary Jane"), ("5", None)]
    df = spark.createDataFrame(rows, "doc_id string, name string")
    index = StringIndex.build(df, "name").write(str(tmp_path / "i"))
    for index in (index, StringIndex.read(spark, str(tmp_path / "i"), "name")):
        for op, value, n in (("equals", "John", 1), ("starts_with", "John", 2), ("ends_with", "Jane", 2), ("contains", "n", 4)):
            query = StringMatch("name", op, value)
            assert index.search(df, query).count() == n == Collection(df).scored(query).count()
    assert index.search(df.where("doc_id <> '1'"), StringMatch("name", "equals", "John")).count() == 0
    with pytest.raises(ValueError):
        index.lookup(StringMatch("other", "equals", "x"))


def test_id_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "id int") for v in ([1, 2, 2, 3], [2, 3, 4]))
    ids = lambda d: sorted(r[0] for r in d.collect())
    assert (ids(idsets.both(a, b)), ids(idsets.either(a, b)), ids(idsets.only_first(a, b))) == ([2, 3], [1, 2, 3, 4], [1])
    assert idsets.cardinality(a) == 3 and idsets.contains(a, 2) and not idsets.contains(a, 9)


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 16))
    x = centres[rng.integers(0, 8, 400)] + 0.2 * rng.standard_normal((400, 16))
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)] + [(999, None, 0)], "doc_id int, v array<double>, g int")
    index = VectorIndex.build(df, "v", nlist=8).write(str(tmp_path / "v"))
    exact = lambda v, k: hits(Collection(df).search(Similar("v", tuple(v)), k))
    assert hits(index.search(x[3], 10, 8)) == exact(x[3], 10)
    assert index.recall([v.tolist() for v in x[:10]], 5, 2) >= 0.9
    found = index.search(x[3], 50, 1, F.col("g") == 0)
    assert found.count() == Collection(df.where("g = 0")).search(Similar("v", tuple(x[3])), 50).count()
    assert abs(index.search(x[3], 1, 8, blend_match_all=True).first()["score"] - 1.0) < 1e-9
    with pytest.raises(ValueError):
        index.probe([1.0], 1)
    assert "PartitionFilters: [" in index.candidates(x[0], 2)._jdf.queryExecution().toString()


def test_log_upserts_removals_and_recovery(spark, tmp_path):
    path = str(tmp_path / "log")
    log = MutationLog(spark, path)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, v string").coalesce(1)
    log.add(frame([("a", "1"), ("b", "1"), ("a", "2")]))
    log.remove(frame([("b", None), ("nope", None)]))
    log.add(frame([("c", ""), ("d", "x")]))
    log.add(spark.createDataFrame([("d", 5)], "doc_id string, w int"))
    live = {r["doc_id"]: (r["v"], r["w"]) for r in log.live().collect()}
    assert live == {"a": ("2", None), "c": ("", None), "d": (None, 5)} and log.count() == 3 and log.bytes() > 0
    # A batch that was cut off before its commit marker doesn't exist; its number is not used again.
    cut = tmp_path / "log" / "tx=000000000005"
    frame([("ghost", "x")]).write.parquet(str(cut))
    (cut / "_SUCCESS").unlink()
    assert MutationLog(spark, path).count() == 3
    assert log.add(frame([("e", "1")])) == 6
    assert log.compact() == 6 and log.compact() == 6
    assert log.transactions() == [6] and {r["doc_id"] for r in log.live().collect()} == {"a", "c", "d", "e"}
    log.remove(frame([("a", None)]))
    assert MutationLog(spark, path).count() == 3
    assert log.add(frame([("zz", "1")]), tx=7) == 7 and log.count() == 3  # a replay of a committed transaction
    with pytest.raises(ValueError):
        log.add(spark.createDataFrame([("1",)], "other string"))


def test_concurrent_shapes_zero_vector_included(spark, tmp_path):
    log = MutationLog(spark, str(tmp_path / "c"))
    for w in range(3):
        log.add(spark.createDataFrame([(f"{w}-{n}", [float(n)] + [0.0] * 7) for n in range(50)], "doc_id string, embedding array<float>"))
    c = Collection(log.live())
    assert c.count() == 150 and c.get("0-0").count() == 1
    assert c.search(Similar("embedding", (1.0,) + (0.0,) * 7)).count() == 147


def test_ingest(spark, tmp_path):
    log = MutationLog(spark, str(tmp_path / "i"))
    good = lambda: spark.createDataFrame([(str(i), f"t{i}", [[1.0, 2.0]]) for i in range(100)], "doc_id string, text string, m array<array<float>>")
    assert ingest.ingest([good], log) == ingest.IngestionResult(100, 100, [])
    bad = lambda: spark.createDataFrame([("x", "t", [[1.0], [1.0, 2.0]]), (None, "t", None), ("ok", "t", None)], "doc_id string, text string, m array<array<float>>")

    def broken():
        raise OSError("no network")

    r = ingest.ingest([bad, broken], log)
    assert (r.total, r.ingested, len(r.errors)) == (4, 1, 3) and log.count() == 101
    assert {e for _, e in r.errors} == {"ragged matrix: m", "no id", "OSError: no network"}
    assert ingest.summary(bad()).first().asDict() == {"total": 3, "ingested": 1, "errors": 2}


def test_streaming_upserts(spark, tmp_path):
    source, log = str(tmp_path / "in"), MutationLog(spark, str(tmp_path / "log"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, v string")
    frame([("a", "1"), ("b", "1")]).write.parquet(source)
    run = lambda: stream_into(spark.readStream.schema("doc_id string, v string").parquet(source), log, str(tmp_path / "ck")).awaitTermination()
    run()
    frame([("a", "2"), (None, "no id")]).write.mode("append").parquet(source)
    run()
    assert {r["doc_id"]: r["v"] for r in log.live().collect()} == {"a": "2", "b": "1"}
    # The stream's own record of its last batch is lost: the batch is replayed, as the transaction that it was.
    before = log.transactions()
    (tmp_path / "ck" / "commits" / "1").unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink()
    run()
    assert log.transactions() == before


def test_ndjson_and_arxiv(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text('{"id": "1", "title": "T", "versions": [{"version": "v1", "created": "Mon"}, {"version": "v2", "created": "Tue"}], "authors_parsed": [["Doe", "J", ""], ["Roe", "R"]]}\n\n{"id": "2"}\n')
    raw = files.read_ndjson(spark, str(f), files.ARXIV_SCHEMA)
    got = {r["id"]: r for r in files.arxiv_documents(raw).collect()}
    assert got["1"]["versions"] == "v1:Mon,v2:Tue" and got["1"]["authors_parsed"] == "Doe J,Roe R" and got["2"]["pdf_url"].endswith("/2")
    assert files.read_ndjson(spark, str(f), files.ARXIV_SCHEMA, 1).count() == 1
    assert files.read_ndjson(spark, str(tmp_path / "missing.json"), files.ARXIV_SCHEMA).count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "t" / "sub" / "b.txt").write_text("  \n")
    assert [r["text"] for r in files.read_text_files(spark, str(tmp_path / "t")).collect()] == ["one\ntwo\n"]
    assert files.read_lines(spark, str(tmp_path / "t" / "a.txt")).count() == 2
    html = "<html><head><title>x</title></head><body><!-- c --><script>var t='</p>'</script><p>A &amp; B</p><br>C</body></html>"
    r = files.page_documents(spark.createDataFrame([("u", html)], "url string, html string")).first()
    assert r["text"] == "A & B C" and r["page"] == 1
    (tmp_path / "x.yaml").write_text(f"tool:\n  artifacts:\n    one:\n      path: {tmp_path}/t/a.txt\n      description: first\n")
    assert files.read_artifacts(spark, str(tmp_path / "x.yaml"), "tool.artifacts").first()["description"] == "first"
    (tmp_path / "y.yaml").write_text("artifacts:\n  one:\n    path: /no/such/file\n    description: d\n")
    with pytest.raises(FileNotFoundError):
        files.read_artifacts(spark, str(tmp_path / "y.yaml"))


def test_layout_markdown():
    line = lambda t, s=10.0: [(t, s, 0, 50)]
    table = [("a", 10, 0, 5), ("b", 10, 50, 55), ("c", 10, 100, 105)]
    got = files.layout_markdown([line("Big", 26), line("Mid", 21), line("Small", 16), line("• item"), line("1. first"), line("plain"), table, line(" ")])
    assert got.split("\n") == ["# Big", "## Mid", "### Small", "- item", "1. first", "plain", "| a | b | c |", ""]


class Server:
    def __init__(self, *statuses):
        self.statuses, self.calls, self.waits = itertools.chain(statuses, itertools.repeat(statuses[-1])), 0, []

    def __call__(self, url, timeout):
        import io
        import urllib.error

        self.calls += 1
        status = next(self.statuses)
        if status != 200:
            raise urllib.error.HTTPError(url, status, "", {}, None)
        return io.BytesIO(b"body")


@pytest.mark.parametrize(("statuses", "calls", "ok"), [((200,), 1, True), ((500, 500, 200), 3, True), ((503,), 4, False), ((404,), 1, False)])
def test_fetch_retries(statuses, calls, ok):
    server = Server(*statuses)
    run = lambda: files.fetch("http://x", opener=server, sleep=server.waits.append)
    if ok:
        assert run() == b"body"
    else:
        with pytest.raises(files.DownloadError):
            run()
    assert server.calls == calls and server.waits == [float(i + 1) for i in range(calls - 1)]


def test_download_reports_failures(spark):
    r = files.download(spark.createDataFrame([("file:///no/such",)], "url string"), retries=0).first()
    assert r["content"] is None and r["error"]


def test_embedding_store(spark):
    s = EmbeddingStore(spark)
    one = s.add([1, 0], "one", metadata={"n": 1, "f": 1.5, "id": uuid.UUID(int=3), "s": "a:b", "big": 1 << 40})
    s.add_all([[0, 1], [1, 1]], ["two", "three"], ["x", "x"])
    got = s.search([1, 0], 10).collect()
    assert [(r["extId"], r["text"]) for r in got] == [(one, "one"), ("x", "three")]
    assert {k: decode(v) for k, v in got[0]["metadata"].items()} == {"n": 1, "f": 1.5, "id": uuid.UUID(int=3), "s": "a:b", "big": 1 << 40}
    assert s.search([1, 0], 10, 0.9).count() == 1 and s.search([1, 0], 1).count() == 1
    assert s.search([1, 0], 10, where=F.col("text") == "three").count() == 1
    s.remove("x")
    assert s.df.count() == 1
    s.remove_all()
    assert s.df.count() == 0
    with pytest.raises(ValueError):
        s.add_all([[1.0]], ["a", "b"])
    with pytest.raises(TypeError):
        encode([1])
    assert decode("plain") == "plain" and decode("odd:1") == "odd:1" and decode(None) is None


def test_decoded_column(spark):
    df = spark.createDataFrame([("integer:5",), ("double:-2.5",), ("string:a:b",), ("raw",), ("double:1e3",)], "t string")
    got = [tuple(r[0]) for r in df.select(decoded(F.col("t"))).collect()]
    assert got == [("integer", "5", 5.0), ("double", "-2.5", -2.5), ("string", "a:b", None), ("raw", "raw", None), ("double", "1e3", 1000.0)]


def test_retrieval(spark):
    df = spark.createDataFrame([("1", "near", [1.0, 0.1]), ("2", "near", [1.0, 0.0]), ("3", "far", [0.0, 1.0])], "doc_id string, text string, embedding array<float>")
    assert retrieval.prompt(df, "q?", [1, 0]).count("near") == 1
    assert retrieval.prompt(df, "q?", [0, -1]) == "q?"
    got = retrieval.relevant_files(df.withColumnRenamed("doc_id", "name"), [1, 0]).collect()
    assert [(r["name"], r["score"]) for r in got] == [("2", 1.0), ("1", 1.0)]


def test_embedding_function(spark):
    df = spark.createDataFrame([("roman mythology",), ("roman myths",), ("cooking pasta",), (None,)], "t string")
    v = [r[0] for r in df.select(embed(F.col("t"))).collect()]
    assert np.allclose(v[0], hashed_embedding("roman mythology")) and np.dot(v[0], v[1]) > np.dot(v[0], v[2])
    assert df.select(embed(F.col("t"), lambda ts: [[float(len(t or ""))] for t in ts])).first()[0] == [15.0]


def test_telemetry(spark, mixed):
    r = telemetry.Recorder("BASIC")
    c = Collection(mixed.df, telemetry=r)
    c.search(MatchAll())
    c.count()
    r("index.recall", 1.0)
    m = r.frame(spark)
    assert m.count() == 2 and telemetry.gauges(m).where("name = 'documents.count'").first()["value"] == 5.0
    df = spark.createDataFrame([(random.Random(1).random(),) for _ in range(3)], "value double").withColumn("name", F.lit("x"))
    assert telemetry.timers(df, exact=False).first()["n"] == 3 and telemetry.counters(df).first()["n"] == 3
    assert [telemetry.sampled(spark.range(4096), F.col("id"), k).count() for k in ("OFF", "ALL")] == [0, 4096]
    assert 10 < telemetry.sampled(spark.range(8192), F.col("id"), "LOW").count() < 60
    assert any("documents_count" in x[0] for x in telemetry.exposition(m).collect())
    assert len(c.hits(MatchAll(), 2)) == 2 and {x[1] for x in r.rows} == {"search.count", "documents.count", "search.latency"}


def test_compiler_rejects_unknown(mixed):
    with pytest.raises(ValueError):
        Compiler(mixed.df.schema, "max")
    with pytest.raises(TypeError):
        Compiler(mixed.df.schema).compile("text")
