"""Indexed searches return what scans return."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkvane.__main__ import answer
from sparkvane.operators import idsets
from sparkvane.operators.indexed import IndexedCollection
from sparkvane.operators.string_index import StringIndex
from sparkvane.plans.query import IntCompare, Multi, Not, Similar, StringMatch

LEAVES = st.sampled_from([StringMatch("name", "contains", "n"), StringMatch("name", "starts_with", "John"), StringMatch("city", "equals", "Rome"), StringMatch("free", "equals", "x"), IntCompare("n", ">", 2)])
TREES = st.recursive(LEAVES, lambda t: st.one_of(t.map(Not), st.tuples(st.sampled_from(["AND", "OR"]), st.lists(t, min_size=2, max_size=3)).map(lambda x: Multi(x[0], tuple(x[1])))), max_leaves=5)


def people(spark):
    rows = [("1", "John", "Rome", "x", 1, [1.0, 0.0]), ("2", "Jane", None, "y", 2, [0.9, 0.1]), ("3", "John Doe", "Oslo", None, 3, [0.0, 1.0]), ("4", "Mary Jane", "Rome", "x", None, [0.5, 0.5]), ("5", None, "Rome", "x", 5, None)]
    return spark.createDataFrame(rows, "doc_id string, name string, city string, free string, n int, v array<float>")


def test_indexed_equals_scan(spark):
    c = IndexedCollection.configured(people(spark), {"string_indexes": "name, city", "vector_indexes": "v", "nlist": "2"})
    assert c.is_indexed("name") and c.is_indexed("v", "vector") and not c.is_indexed("free")

    @settings(max_examples=12, deadline=None)
    @given(TREES)
    def check(tree):
        want = [(r["doc_id"], r["score"]) for r in c.search(tree).collect()]
        assert [(r["doc_id"], r["score"]) for r in c.search_indexed(tree).collect()] == want

    check()
    assert [r["doc_id"] for r in c.search_nearest("v", [1, 0], 2, 2).collect()] == ["1", "2"]
    assert [r["doc_id"] for r in c.search_nearest("v", [1, 0], 2, 1, StringMatch("city", "equals", "Rome")).collect()] == ["1", "4"]
    assert c.search_nearest("n", [1, 0], 2).count() == c.search(Similar("n", (1.0, 0.0)), 2).count() == 0


def test_overwritten_and_removed_documents(spark):
    c = IndexedCollection(people(spark)).with_string_index("name")
    changed = IndexedCollection(c.add(people(spark).where("doc_id = '1'").withColumn("name", F.lit("Jack"))).remove(["3"]).df)
    changed.string_indexes = c.string_indexes  # an index made before the changes
    assert changed.search_indexed(StringMatch("name", "starts_with", "John")).count() == 0
    changed.with_string_index("name")
    assert [r["doc_id"] for r in changed.search_indexed(StringMatch("name", "starts_with", "J")).collect()] == ["1", "2"]


def test_shell(spark, tmp_path):
    assert answer(spark, "anything", None)[1] == ["nothing is loaded: load FOLDER"]
    (tmp_path / "a.txt").write_text("roman mythology")
    (tmp_path / "b.txt").write_text("cooking pasta")
    loaded, said = answer(spark, f"load {tmp_path}", None)
    assert said == ["2 documents"] and answer(spark, "roman myths", loaded)[1][0].endswith("a.txt")


def test_no_set_of_ids_is_broadcast_by_an_estimate(spark, monkeypatch):
    c = IndexedCollection.configured(people(spark), {"string_indexes": "name, city"})
    john, jane, rome = StringMatch("name", "starts_with", "John"), StringMatch("name", "ends_with", "Jane"), StringMatch("city", "equals", "Rome")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    # A tree on one field is one condition on the index's terms: one join, no aggregate.
    one = plan(c.search_indexed(Multi("AND", (Multi("OR", (john, jane)), Not(StringMatch("name", "contains", "D")), IntCompare("n", ">", 0)))))
    assert one.count("Join") == one.count("SortMergeJoin") == 1 and "Aggregate" not in one
    for tree in (Multi("AND", (john, rome)), Multi("AND", (Not(john), Not(rome))), Multi("OR", (Not(jane), rome)), Not(Multi("AND", (Not(john), rome)))):
        assert "Broadcast" not in plan(c.search_indexed(tree))
        assert sorted(c.search_indexed(tree).collect()) == sorted(c.search(tree).collect())
    sets = [people(spark).where("n > 1").select("doc_id"), people(spark).where("n < 4").select("doc_id")]
    assert not any("Broadcast" in plan(f(*sets)) for f in (idsets.both, idsets.only_first))
    # Few ids found are broadcast, more are not; a repeated document is found as often as it is there.
    twice = people(spark).union(people(spark).where("doc_id = '1'"))
    few = StringIndex.build(twice, "name").search(twice, john)
    monkeypatch.setattr("sparkvane.operators.string_index.BROADCAST_IDS", 2)
    many = StringIndex.build(twice, "name").search(twice, john)
    assert "BroadcastHashJoin" in plan(few) and "BroadcastHashJoin" not in plan(many)
    assert sorted(r["doc_id"] for r in few.collect()) == sorted(r["doc_id"] for r in many.collect()) == ["1", "1", "3"]
    assert StringIndex.build(twice, "name").lookup(john).count() == 2
