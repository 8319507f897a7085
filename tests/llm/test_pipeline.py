"""The pipeline, stage by stage, against brute force."""

import random

from test_llm import brute_contamination, brute_groups, brute_spans, docs, near_fixture, unpacked, words

import corpus_pipeline
from sparkvane.llm import toxicity_chain
from sparkvane.llm.common import read


def corpus():
    rng = random.Random(21)
    rows = near_fixture()
    shared, item = words(rng, 70), words(rng, 30)
    for i in range(3000, 3060):
        w = words(rng, 120)
        if i % 5 == 0:
            w[40:40] = shared
        if i % 7 == 0:
            w[10:10] = item
        if i % 4 == 0:
            w[5:5] = ["idiot", "moron"]
        rows.append((i, " ".join(w)))
    labels = [(i, 1, 1 if i >= 3000 and i % 4 == 0 else 0) for i, _ in rows if i % 3 or i >= 3000]
    return rows, labels, [(1, " ".join(item))]


def test_pipeline(spark, tmp_path):
    rows, labels, items = corpus()
    d = str(tmp_path)
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame = read(spark, d, "documents")
    columns = frame.columns

    chain = toxicity_chain.fit_chain(frame, read(spark, d, "labels"))
    toxic = {r["doc_id"] for r in toxicity_chain.score(frame, chain).where("rejected").collect()}
    assert {i for i, _, t in labels if t} <= toxic
    want = [r for r in rows if r[0] not in toxic]
    gone = {x for g in brute_groups(want) for x in g[1:]}
    want = [r for r in want if r[0] not in gone]
    cut = {i: c for (i, _), (_, c) in brute_spans(want, 50).items()}
    want = [(i, " ".join(w for p, w in enumerate(t.split()) if p not in cut.get(i, ()))) for i, t in want]
    want = [r for r in want if r[1]]
    bad = {i for i, _ in brute_contamination(want, items)}
    want = {i: t.split() for i, t in want if i not in bad}

    current = frame
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, d).write.parquet(f"{d}/out/{k}")
        current = spark.read.parquet(f"{d}/out/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or current.columns == columns
    for result in (current, corpus_pipeline.run(spark, d)):  # every word of every kept document, in order, in some sequence
        parts = unpacked(result.collect(), 2048)
        assert {i: "".join(p[k][0] for k in sorted(p)).split() for i, p in parts.items()} == want
