"""The registered queries, with their production parameters, on small tables against brute force; the pipeline on awkward ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import AWKWARD, bench_fixture, brute_contamination, brute_groups, brute_neighbours, brute_spans, brute_tokens, docs, labelled, near_fixture, passages, ranges, unpacked

import corpus_pipeline
from sparkvane.llm import linear, ordinal_quality, toxicity_chain, trie_unigram
from sparkvane.llm.queries import oracle_sql, queries
from sparkvane.llm.textops import text_buffers


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables: passages, near copies, leaks and labelled texts among the documents, all with ids of their own."""
    d = str(tmp_path_factory.mktemp("tables"))
    leaks, items = bench_fixture()
    toxic, labels = labelled(600)
    rows = [(i, t) for i, t in passages()] + [(10_000 + i, t) for i, t in near_fixture()] + [(20_000 + i, t) for i, t in leaks] + [(30_000 + i, t) for i, t in toxic]
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(30_000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, rows, items, x


def test_every_operator_has_one_query():
    assert sorted(int(n.split("_")[0][2:]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) == {"op1_substring_dedup", "op6_hilbert_sharding", "op8_url_filter"}


def test_op1(spark, tables):
    d, rows, _, _ = tables
    want = {i: v for (i, _), v in brute_spans(rows, 50).items()}
    assert ranges(queries()["op1_substring_dedup"](spark, d).collect()) == want


def test_op2(spark, tables):
    d, _, _, x = tables
    order, _ = brute_neighbours(x, 10)
    got = {(r["vec_id"], r["neighbour_id"]) for r in queries()["op2_nearest_neighbours"](spark, d).collect()}
    asked = range(0, len(x), 50)
    assert {q for q, _ in got} == set(asked) and len(got & {(i, int(j)) for i in asked for j in order[i]}) >= 0.9 * 10 * len(asked)


def test_op3(spark, tables):
    import sentencepiece

    d, rows, _, _ = tables
    m = sentencepiece.SentencePieceProcessor(model_file=trie_unigram.VOCABULARY)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    scores = {p.encode(): -float(np.log(r + 2)) for r, p in enumerate(pieces)}
    fallback = min(scores.values()) - 10
    known: dict[str, int] = {}

    def count(w):
        if w not in known:
            known[w] = brute_tokens(w, scores, fallback)
        return known[w]

    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in queries()["op3_token_counts"](spark, d).collect()}
    assert got == {i: (len(t.split()), sum(map(count, t.split()))) for i, t in rows}


def test_op4_and_op7(spark, tables):
    """Against the labels, and row by row against the models applied to each text alone."""
    d, rows, _, _ = tables
    frame, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    toxic = {r["doc_id"]: r for r in queries()["op4_toxicity"](spark, d).collect()}
    quality = {r["doc_id"]: r for r in queries()["op7_quality"](spark, d).collect()}
    assert set(toxic) == set(quality) == {i for i, _ in rows} and len(toxic) == len(rows)
    assert np.mean([toxic[i]["rejected"] == bool(t) for i, (_, t) in truth.items()]) > 0.97
    assert np.mean([quality[i]["selected"] == (q == 1 and t == 0) for i, (q, t) in truth.items()]) > 0.93
    chain, model = toxicity_chain.fit_chain(frame, labels), ordinal_quality.fit_quality(frame, labels)
    for i, t in rows[::37]:
        x = linear.features(*text_buffers(pa.array([t])))
        assert np.allclose([toxic[i]["p_low_quality"], toxic[i]["p_toxic"]], chain.probabilities(*x)[0], atol=2e-6)
        assert np.allclose([quality[i]["p_ge_1"], quality[i]["p_ge_2"]], model.tails(*x)[0], atol=2e-6)


def test_op5(spark, tables):
    d, rows, _, _ = tables
    got = queries()["op5_best_fit_packing"](spark, d).collect()
    parts = unpacked(got, 2048)
    assert {i: "".join(p[k][0] for k in sorted(p)) for i, p in parts.items()} == dict(rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in queries()["op3_token_counts"](spark, d).collect()}
    total = sum(p["n_tokens"] for r in got for p in r["pieces"])
    assert total == sum(counts.values()) and len(got) <= 1.02 * total / 2048 + 2


def test_op9(spark, tables):
    d, rows, items, _ = tables
    got = {(r["doc_id"], r["item_id"]) for r in queries()["op9_decontamination"](spark, d).collect()}
    assert got == brute_contamination(rows, items)


def test_op10(spark, tables):
    d, rows, _, _ = tables
    groups: dict[int, list[int]] = {}
    kept = []
    for r in queries()["op10_simhash_near_dedup"](spark, d).collect():
        groups.setdefault(r["group_id"], []).append(r["doc_id"])
        kept += [r["doc_id"]] if r["kept"] else []
    assert sorted(sorted(g) for g in groups.values()) == brute_groups(rows) and sorted(kept) == sorted(groups)


def test_pipeline_stages_take_awkward_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x y"), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rng = random.Random(1)
    rows = AWKWARD + [(50, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000)))]
    full = docs(spark, rows).withColumns({"lang": F.when(F.col("doc_id") == 1, F.lit(None)).otherwise("en"), "n_chars": F.lit(None).cast("long"), "source": F.lit(None).cast("string"), "sym": F.lit("s"), "root": F.lit(1), "op": F.lit(True), "length": F.lit(2.0), "item_id": F.lit(9), "row": F.lit("r"), "__doc_key": F.lit(1), "__doc_hash": F.lit(2), "h": F.lit(0), "y0": F.lit(1), "known": F.lit(3)})
    for start in (full, full.where("false")):
        current = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, current, d)
            path = f"{d}/{start is full}/{k}"
            out.write.parquet(path)
            current = spark.read.parquet(path)
            if k < 4:
                assert current.columns == full.columns, name
        assert (current.count() > 20) == (start is full)


def test_pipeline_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
