"""Each operator against a brute-force version of itself on small fixtures, and on the awkward inputs every one must take."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkvane.llm import hilbert_sharding, linear, linear_grouping, multiprobe_lsh, ordinal_quality, recompression, simhash_vptree, string_tiling, temporal_urls, toxicity_chain, trie_unigram
from sparkvane.llm.common import HASH, KEY, components, hashed_sample, identified, shared_folder
from sparkvane.llm.textops import CHUNK_BYTES, U64, Tokens, text_buffers, token_hashes, tokens_of, window_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).repartition(3)


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


AWKWARD = [(1, None), (None, "null id here with words"), (2, ""), (3, "   \n\t "), (4, "one"), (5, "dup row text"), (5, "dup row text"), (5, "same id other text"), (6, "x" * 5000), (7, "a " * 3000), (8, "é à ÜBER ñandú   　 x"), (9, "\x00 odd � bytes")]


# Text primitives


def test_tokens_are_words():
    texts = ["Hello,  World!\n", "", None, "ÉTÉ été ÜBER über", "a" * 10, " x y "]
    data, offs = text_buffers(pa.array(texts))
    t = Tokens(data, offs)
    got = [[data[s:e].tobytes().decode() for s, e in zip(t.start[a:b], t.end[a:b])] for a, b in zip(t.first[:-1], t.first[1:])]
    assert got == [(x or "").split() for x in texts]
    folded = Tokens(data, offs, fold=True)
    h = folded.hash[folded.first[3] : folded.first[4]]
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


def test_tokens_do_not_cross_documents_and_chunks_agree():
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randrange(0, 60))) for _ in range(200)]
    data, offs = text_buffers(pa.array(texts))
    whole = Tokens(data, offs).hash
    parts = np.concatenate([t.hash for _, _, t in tokens_of(data, offs, size=500)])
    assert (whole == parts).all() and len(whole) == sum(len(t.split()) for t in texts)
    assert (np.concatenate([token_hashes(t, fold=False) for t in texts]) == whole).all()


def test_window_hashes_equal_iff_windows_equal():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 3, 400).astype(U64)
    w = window_hashes(h, 4)
    by = {}
    for i in range(len(w)):
        by.setdefault(tuple(h[i : i + 4].tolist()), set()).add(int(w[i]))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    assert len(window_hashes(h[:3], 4)) == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 substring dedup


def brute_spans(rows, width):
    """Repeated and cut word ranges by looking at every window."""
    rows = sorted({(i, t) for i, t in rows if t}, key=lambda r: (-(1 << 63) if r[0] is None else r[0]))
    places = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - width + 1):
            places.setdefault(tuple(w[p : p + width]), []).append((i, t, p))
    marks = {}
    for at in places.values():
        for k, (i, t, p) in enumerate(at if len(at) > 1 else []):
            repeated, cut = marks.setdefault((i, t), (set(), set()))
            repeated.update(range(p, p + width))
            if k:  # all but the first place; within the first one's document only what lies beyond it
                own = at[0][:2] == (i, t)
                cut.update(range(max(p, at[0][2] + width) if own else p, p + width))
    return {k: v for k, v in marks.items()}


def ranges(rows):
    """(repeated, cut) words of each document id, from rows of spans."""
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], (set(), set()))[r["kind"] == "cut"].update(range(r["from_word"], r["to_word"]))
    return out


def passages(seed=7):
    rng = random.Random(seed)
    shared = [words(rng, n) for n in (50, 51, 60, 75, 200, 49)]
    rows = []
    for i in range(40):
        parts = [words(rng, rng.randrange(0, 80))]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            parts += [s, words(rng, rng.randrange(0, 40))]
        rows.append((i * 3, " ".join(itertools.chain(*parts))))
    rows += [(200, rows[3][1]), (201, rows[3][1] + " tail"), (202, " ".join(shared[2] + words(rng, 9) + shared[2])), (203, "z " * 300), (204, "z " * 120 + "end")]
    return rows


@pytest.mark.parametrize("hot", [recompression.HOT, 3])
def test_repeated_passages_match_brute_force(spark, monkeypatch, hot):
    rows = passages()
    monkeypatch.setattr(recompression.repeated_spans, "__defaults__", (50, hot))
    got = ranges(recompression.repeated_passages(docs(spark, rows)).collect())
    assert got == {i: v for (i, _), v in brute_spans(rows, 50).items()}


def test_whole_copies_and_long_repeats_match_brute_force(spark):
    """Copies of long texts, which high-level symbols cover, with and without edits and shifts."""
    rng = random.Random(31)
    long = words(rng, 2500)
    rows = [(i, " ".join(long)) for i in (5, 6, 7)] + [(i, " ".join(words(rng, i) + long[i * 40 :])) for i in range(10, 20)]
    for i in range(20, 30):
        w = list(long)
        for _ in range(i - 18):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(None, " ".join(long[300:900])), (40, "a " * 200), (41, "k " * 61), (42, ("line of words again " * 400))]
    got = ranges(recompression.repeated_passages(docs(spark, rows)).collect())
    assert got == {i: v for (i, _), v in brute_spans(rows, 50).items()}


def test_one_copy_of_a_repeated_word_stays(spark):
    rows = [(1, "a " * 200), (2, "k " * 61), (3, ("x y z " * 40))]
    got = {r["doc_id"]: len(r["text"].split()) for r in recompression.drop_repeated_passages(docs(spark, rows)).collect()}
    assert got == {1: 50, 2: 50, 3: 50}


def test_recompression_never_misses_a_repeat():
    rng = np.random.default_rng(2)
    for length in (50, 57, 80):
        n = 400
        same = rng.integers(1, 1 << 62, (n, length)).astype(U64)
        sides = []
        for _ in range(2):
            x = rng.integers(1, 1 << 62, (n, length + 80)).astype(U64)
            x[:, 40 : 40 + length] = same
            sym, size, start, _ = recompression.recompress(x.ravel(), np.repeat(np.arange(n), length + 80))
            high = size >= recompression.SEED_WORDS
            sides.append({(int(s), int(p) // (length + 80)) for s, p in zip(sym[high], start[high])})
        assert len({d for _, d in sides[0] & sides[1]}) == n


def test_recompression_never_misses_a_periodic_repeat():
    rng = np.random.default_rng(8)
    for length in (60, 400):
        n, missed = 300, 0
        for period in range(2, 12):
            lines = rng.integers(1, 1 << 62, (n, period)).astype(U64)
            same = np.tile(lines, (1, -(-length // period)))[:, :length]
            sides = []
            for _ in range(2):
                x = rng.integers(1, 1 << 62, (n, length + 80)).astype(U64)
                x[:, 40 : 40 + length] = same
                sym, size, start, _ = recompression.recompress(x.ravel(), np.repeat(np.arange(n), length + 80))
                high = (size >= recompression.SEED_WORDS) & (start % (length + 80) >= 40) & (start % (length + 80) + size <= 40 + length)
                sides.append({(int(s), int(p) // (length + 80)) for s, p in zip(sym[high], start[high])})
            missed += n - len({d for _, d in sides[0] & sides[1]})
        assert missed == 0, (length, missed)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=200))
def test_recompression_covers_the_text(x):
    h = np.array(x, dtype=U64) + U64(5)
    _, size, start, _ = recompression.recompress(h, np.zeros(len(h), np.int64))
    assert size.sum() == len(h) and (start == np.cumsum(size) - size).all()


def test_cutting_passages(spark):
    rows = passages()
    cut = {(i, t): c for (i, t), (_, c) in brute_spans(rows, 50).items()}
    got = {r["doc_id"]: r for r in recompression.drop_repeated_passages(docs(spark, rows)).collect()}
    for i, t in rows:
        left = [w for p, w in enumerate(t.split()) if p not in cut.get((i, t), ())]
        if not left:
            assert i not in got
        else:
            assert got[i]["text"].split() == left and got[i]["n_chars"] == len(got[i]["text"])
        if not cut.get((i, t)):
            assert got[i]["text"] == t


# 2 nearest neighbours


def brute_neighbours(x, k):
    d = np.sqrt(((x[:, None, :].astype(np.float64) - x[None, :, :].astype(np.float64)) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, 1)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 32)).astype(np.float32)
    x[1::7] = x[0::7][: len(x[1::7])] + 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = multiprobe_lsh.nearest_neighbours(df).collect()
    order, dist = brute_neighbours(x, 10)
    truth = {(i, int(j)): float(e) for i in range(len(x)) for j, e in zip(order[i], dist[i])}
    found = {(r["vec_id"], r["neighbour_id"]): r["distance"] for r in got}
    assert len(found) == len(got) and all(a != b for a, b in found)
    assert len(truth.keys() & found.keys()) / len(truth) >= 0.9
    assert all(abs(found[p] - truth[p]) < 1e-5 for p in truth.keys() & found.keys())


def test_neighbours_exhaustive_probing_is_exact_and_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, 8)).astype(np.float32)
    x[10] = x[11] = x[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(multiprobe_lsh, "BLOCK", 20)
    monkeypatch.setattr(multiprobe_lsh, "QUERIES", 30)
    got = multiprobe_lsh.nearest_neighbours(df, k=5, tables=1, functions=2, width=50.0, probes=8).collect()
    order, _ = brute_neighbours(x, 5)
    assert {(r["vec_id"], r["neighbour_id"], r["rank"]) for r in got} == {(i, int(order[i, r]), r + 1) for i in range(150) for r in range(5)}


def test_probe_order_is_by_score_and_valid():
    sets = multiprobe_lsh.probe_order(3, 26)
    assert len(sets) == len(set(sets)) == 26  # all combinations of three functions, each moved down, up or not
    assert all(7 - r not in s for s in sets for r in s) and sets[0] == (1,)


def test_neighbours_awkward(spark):
    schema = "vec_id long, embedding array<float>, extra string"
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.0], None), (3, None, "c"), (4, [], "d"), (5, [1.0], "e"), (6, [None, 1.0], "f"), (7, [float("nan"), 1.0], "g"), (None, [0.5, 0.5], "h"), (8, [0.0, 1.0], "i")]
    got = {(r["vec_id"], r["neighbour_id"]) for r in multiprobe_lsh.nearest_neighbours(spark.createDataFrame(rows, schema), tables=1, functions=1, width=100.0, probes=0).collect()}
    assert got == {(a, b) for a in (1, 2, 8) for b in (1, 2, 8) if a != b}
    assert multiprobe_lsh.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        multiprobe_lsh.nearest_neighbours(spark.createDataFrame(rows, schema), k=0)


def test_neighbours_of_asked_rows_are_tuned_to_the_data(spark, monkeypatch):
    """Clustered vectors: few rows are compared, and the neighbours are found; an id with two vectors is one neighbour."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 16)) * 4
    x = (np.repeat(centres, 50, axis=0) + rng.standard_normal((2000, 16)) * 0.3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, (x[3] + 0.01).tolist()), (9, [1e300] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    chosen = []
    monkeypatch.setattr(multiprobe_lsh, "tuned", lambda *a, f=multiprobe_lsh.tuned: chosen.append(f(*a)) or chosen[0])
    got = multiprobe_lsh.nearest_neighbours(df, df.where("vec_id % 50 = 0")).collect()
    assert chosen[0]["share"] < 0.15 and chosen[0]["recall"] >= multiprobe_lsh.RECALL
    order, _ = brute_neighbours(x, 10)
    found = {(r["vec_id"], r["neighbour_id"]) for r in got}
    assert len(found) == len(got) <= 400 and {a for a, _ in found} == set(range(0, 2000, 50))
    assert len(found & {(i, int(j)) for i in range(0, 2000, 50) for j in order[i]}) >= 0.9 * 400


# 3 token counts


def test_token_counts_match_a_unigram_model():
    from tokenizers import models

    rng = random.Random(8)
    letters = "abcé"
    pieces = {"▁", *letters, *("".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(80)), *("▁" + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(40))}
    scored = [(p, -1 - 10 * rng.random()) for p in sorted(pieces)]
    model = models.Unigram([("<unk>", 0.0), *scored], 0, False)
    listed = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    distinct = sorted(set(listed))
    got = trie_unigram.word_counts([w.encode() for w in distinct], trie_unigram.Vocabulary(scored))
    assert got.tolist() == [len(model.tokenize("▁" + w)) for w in distinct]


def brute_tokens(word, scores, fallback):
    raw = ("▁" + word).encode()
    best = [(0.0, 0)] + [None] * len(raw)
    for d in range(1, len(raw) + 1):
        lead = (raw[d - 1] & 0xC0) != 0x80
        options = [(best[d - 1][0] + (fallback if lead else 0.0), best[d - 1][1] + 1)]
        options += [(best[e][0] + scores[raw[e:d]], best[e][1] + 1) for e in range(d) if raw[e:d] in scores]
        best[d] = max(options, key=lambda o: o[0])
    return best[-1][1]


def test_token_counts_query(spark):
    rng = random.Random(9)
    vocabulary = trie_unigram.load_vocabulary()
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=trie_unigram.VOCABULARY)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    scores = {p.encode(): -float(np.log(r + 2)) for r, p in enumerate(pieces)}
    rows = [(100 + i, " ".join(rng.choice(["the", "reading", "électricité", "日本語", "𓀀x", "ungkeit", "a1b2", "foo,bar!"]) + rng.choice(["", "s", "ing"]) for _ in range(30))) for i in range(20)] + AWKWARD
    got = trie_unigram.token_counts(docs(spark, rows), vocabulary).collect()
    assert len(got) == len(rows)
    spaces = " \t\n\x0b\x0c\r"
    split = lambda t: [w for w in "".join(" " if c in spaces else c for c in t or "").split(" ") if w]
    want = sorted((str(i), len(split(t)), sum(brute_tokens(w, scores, vocabulary.fallback) for w in split(t))) for i, t in rows)
    have = sorted((str(r["doc_id"]), r["n_pretokens"], r["n_tokens"]) for r in got)
    assert have == want
    assert trie_unigram.token_counts(docs(spark, []), vocabulary).count() == 0


def test_pretokens_are_looked_up_once_a_worker(monkeypatch):
    """Counts of 200,000 pre-tokens were remembered, as Python objects; with more, all were forgotten again and again."""
    vocabulary = trie_unigram.load_vocabulary()
    text = [" ".join(f"{i:x}" for i in range(at, at + 70_000)) for at in range(0, 280_000, 70_000)]
    data, offs = text_buffers(pa.array(text))
    first = [c.copy() for _, _, _, c in trie_unigram.counted(data, offs, vocabulary)]
    seen = []
    scores = trie_unigram.Vocabulary.scores
    monkeypatch.setattr(trie_unigram.Vocabulary, "scores", lambda self, key: seen.append(len(key)) or scores(self, key))
    again = [c for _, _, _, c in trie_unigram.counted(data, offs, vocabulary)]
    assert sum(map(len, first)) == 280_000 and not seen and all((a == b).all() for a, b in zip(first, again, strict=True))


def test_what_is_remembered_is_bounded_and_changes_no_count(monkeypatch):
    rng = random.Random(12)
    vocabulary, plain = trie_unigram.load_vocabulary(), trie_unigram.load_vocabulary()
    monkeypatch.setattr(trie_unigram, "CHUNK", 700)
    listed = [rng.choice(["é", "日本", "x", "ing", "the"]) * rng.randrange(1, 30) + str(rng.randrange(300)) for _ in range(600)]
    data, offs = text_buffers(pa.array([" ".join(listed[k : k + 20]) for k in range(0, 600, 20)] + ["", None, " "]))
    want = [trie_unigram.segment(w.encode(), plain)[0] for w in listed]
    for most in (0, 5, 100, 1 << 20):
        monkeypatch.setattr(trie_unigram, "MEMORY", most)
        got = []
        for _, _, _, c in trie_unigram.counted(data, offs, vocabulary):
            got += c.tolist()
            assert len(vocabulary.known) == len(vocabulary.counts) <= most and (vocabulary.known[1:] > vocabulary.known[:-1]).all()
        assert got == want
    assert trie_unigram.word_counts([b""], plain).tolist() == [trie_unigram.segment(b"", plain)[0]] and not len(trie_unigram.word_counts([], plain))


# 4 toxicity and 7 quality


def labelled(n=3000, seed=3):
    rng = random.Random(seed)
    bad, junk = ["idiot", "moron", "scum"], ["###", "$$$", "%%%"]
    rows, labels = [], []
    for i in range(n):
        toxic, low = rng.random() < 0.15, rng.random() < 0.2
        w = words(rng, rng.randrange(5, 60), 800)
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        if low:
            w = [x + rng.choice(junk) for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if low else 1, 1 if toxic else 0))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled()
    known = spark.createDataFrame([x for x in labels if x[0] < 2400] + [(None, 1, 1), (3, None, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    chain = toxicity_chain.fit_chain(df, known)
    assert chain.categories == ["low_quality", "toxic"] and len(chain.models[1][2]) == 2  # a constant and the earlier category
    got = {r["doc_id"]: r for r in toxicity_chain.score(df, chain).collect()}
    held = [x for x in labels if x[0] >= 2400]
    assert np.mean([got[i]["rejected"] == bool(t) for i, _, t in held]) > 0.95
    assert np.mean([got[i]["rejected"] for i, _, t in held if t]) > 0.75
    assert np.mean([(got[i]["p_low_quality"] > 0.5) == (q == 0) for i, q, _ in held]) > 0.97
    kept = {r["doc_id"] for r in toxicity_chain.drop_toxic(df, chain).collect()}
    assert kept == {i for i in got if not got[i]["rejected"]}
    odd = docs(spark, AWKWARD)
    assert toxicity_chain.score(odd, chain).count() == len(AWKWARD) and toxicity_chain.drop_toxic(odd, chain).columns == odd.columns
    assert toxicity_chain.score(docs(spark, []), chain).count() == 0


def test_chain_without_labels_rejects_nothing(spark):
    df = docs(spark, [(1, "a b"), (2, None)])
    chain = toxicity_chain.fit_chain(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["rejected"] for r in toxicity_chain.score(df, chain).collect()] == [False, False]


def test_quality_held_out(spark):
    rows, labels = labelled()
    df = docs(spark, rows)
    model = ordinal_quality.fit_quality(df, spark.createDataFrame([x for x in labels if x[0] < 2400], "doc_id long, quality int, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in ordinal_quality.score(df, model).collect()}
    held = [x for x in labels if x[0] >= 2400]
    assert np.mean([got[i]["selected"] == (q == 1 and not t) for i, q, t in held]) > 0.92
    assert all(r["p_ge_1"] >= r["p_ge_2"] and abs(r["expected_grade"] - r["p_ge_1"] - r["p_ge_2"]) < 1e-5 for r in got.values())
    grade = {i: 0 if q == 0 else 2 - t for i, q, t in held}
    mean = [np.mean([got[i]["expected_grade"] for i in grade if grade[i] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert ordinal_quality.score(docs(spark, AWKWARD), model).count() == len(AWKWARD)
    empty = ordinal_quality.fit_quality(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert ordinal_quality.score(df, empty).count() == len(rows)


def sparse(rng, n=400, columns=40):
    """(index, offsets, dense 0/1 matrix) of a small random table, every column used."""
    x = rng.random((n, columns)) < 0.15
    return np.concatenate([np.flatnonzero(r) for r in x]), np.concatenate([[0], np.cumsum(x.sum(axis=1))]), x.astype(float)


def test_logistic_fit_against_a_plain_one():
    """Full-batch gradient descent to the optimum of the same loss finds about the same probabilities."""
    rng = np.random.default_rng(1)
    index, offs, x = sparse(rng)
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-(x @ rng.standard_normal(40) * 1.5)))).astype(np.int64)
    w, v = linear.fit_logistic(index, offs, np.zeros((len(x), 0)), y, epochs=200)
    got = 1 / (1 + np.exp(-(linear.sums(w, index, offs) + v[0])))
    a, b = np.zeros(40), 0.0
    for _ in range(20_000):
        s = (1 / (1 + np.exp(-(x @ a + b))) - y) / len(x)
        a, b = a - 2 * (x.T @ s + 1e-3 * a), b - 2 * s.sum()
    want = 1 / (1 + np.exp(-(x @ a + b)))
    assert np.abs(got - want).mean() < 0.03 and np.corrcoef(got, want)[0, 1] > 0.99


def test_chain_is_fitted_on_out_of_fold_predictions():
    """The chain, put together from single fits by hand."""
    rng = np.random.default_rng(2)
    index, offs, x = sparse(rng)
    first = (x[:, 0] + x[:, 1] + 0.3 * rng.standard_normal(len(x)) > 0.5).astype(np.int64)
    second = (first + x[:, 2] + 0.3 * rng.standard_normal(len(x)) > 1.2).astype(np.int64)
    chain = toxicity_chain.fit(index, offs, {"first": first, "second": second}, 1.0)
    n, none, held = len(x), np.zeros((len(x), 0)), np.zeros(len(x))
    for f in range(toxicity_chain.FOLDS):
        rows, rest = np.flatnonzero(np.arange(n) % 5 != f), np.flatnonzero(np.arange(n) % 5 == f)
        w, v = linear.fit_logistic(*linear.take(index, offs, rows), none[rows], first[rows], 1.0)
        held[rest] = linear.sums(w, *linear.take(index, offs, rest)) + v[0]
    w1, v1 = linear.fit_logistic(index, offs, none, first, 1.0)
    w2, v2 = linear.fit_logistic(index, offs, np.clip(held, -10, 10)[:, None], second, 1.0)
    logit = linear.sums(w1, index, offs) + v1[0]
    want = np.stack([logit, linear.sums(w2, index, offs) + v2[0] + v2[1] * np.clip(logit, -10, 10)], axis=1)
    assert np.abs(chain.probabilities(index, offs) - 1 / (1 + np.exp(-want))).max() < 1e-6 and v2[1] > 0.2


def test_ordinal_fit_against_a_plain_one():
    """Numerical gradient descent on the cumulative-link likelihood finds about the same expected grades."""
    rng = np.random.default_rng(3)
    index, offs, x = sparse(rng, 300, 8)
    z = x @ rng.standard_normal(8) * 2 + rng.logistic(size=len(x))
    grade = (z > -0.5).astype(np.int64) + (z > 1)
    model = ordinal_quality.fit(index, offs, grade, epochs=300)
    got = model.tails(index, offs).sum(axis=1)
    p = np.zeros(10)
    p[8:] = -0.5, 0.0

    def tails(p):
        t = np.array([p[8], p[8] + np.exp(p[9])])
        return 1 / (1 + np.exp(-((x @ p[:8])[:, None] - t)))

    def loss(p):
        t = np.column_stack([np.ones(len(x)), tails(p), np.zeros(len(x))])
        at = np.arange(len(x))
        return -np.log(t[at, grade] - t[at, grade + 1] + 1e-12).mean() + 5e-4 * (p[:8] ** 2).sum()

    for _ in range(1500):
        g = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in 1e-5 * np.eye(10)])
        p -= 0.8 * g
    want = tails(p).sum(axis=1)
    assert np.abs(got - want).mean() < 0.05 and np.corrcoef(got, want)[0, 1] > 0.99


def test_features_are_counted_over_whole_texts():
    long = " ".join(f"u{i}" for i in range(CHUNK_BYTES // 4)) + " marker"
    data, offs = text_buffers(pa.array([long, "marker", None]))
    index, at = linear.features(data, offs)
    one = set(index[at[1] : at[2]].tolist())
    assert len(at) == 4 and len(one & set(index[at[0] : at[1]].tolist())) >= len(one) - 1


# 5 packing


def check_plan(counts, capacity=64, groups=6):
    plan = linear_grouping.best_plan(counts, capacity, 0.125, groups)
    fill, ranks = {}, {}
    for length, a, b, first, per in plan.rows:
        for r in range(a, b):
            assert (length, r) not in ranks
            at = first + (r - a) // per
            ranks[length, r] = at
            fill[at] = fill.get(at, 0) + length
    assert sorted(ranks) == [(k, r) for k in sorted(counts) for r in range(counts[k])]
    assert all(v <= capacity for v in fill.values()) and set(fill) == set(range(plan.sequences))
    return plan.sequences


def test_small_pieces_are_packed_by_best_fit():
    """Against a plain best fit, piece by piece, on plans without large pieces."""
    rng = random.Random(5)
    for _ in range(20):
        counts = {k: rng.randrange(1, 30) for k in rng.sample(range(1, 9), 4)}
        gaps = []
        for k in sorted(counts, reverse=True):
            for _ in range(counts[k]):
                fits = [g for g in gaps if g >= k]
                if fits:
                    gaps.remove(min(fits))
                gaps.append((min(fits) if fits else 64) - k)
        assert check_plan(counts) == len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
def test_packing_is_valid_and_near_first_fit_decreasing(counts):
    used = check_plan(counts)
    gaps = []
    for k in sorted(counts, reverse=True):  # first fit decreasing
        for _ in range(counts[k]):
            at = next((i for i, g in enumerate(gaps) if g >= k), None)
            if at is None:
                gaps.append(64 - k)
            else:
                gaps[at] -= k
    assert used <= 1.2 * len(gaps) + 6


def unpacked(rows, capacity):
    """The texts by document id, put together again from sequences that hold what they say."""
    parts, seen = {}, set()
    for r in rows:
        assert r["sequence"] not in seen and r["n_tokens"] == sum(p["n_tokens"] for p in r["pieces"]) <= capacity
        assert r["doc_ids"] == [p["doc_id"] for p in r["pieces"]]
        seen.add(r["sequence"])
        for p in r["pieces"]:
            parts.setdefault(p["doc_id"], {}).setdefault(p["piece"], []).append(p["text"])
    assert seen == set(range(len(rows)))
    return parts


def test_packing_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, rng.choice([3, 20, 40, 63, 130, 400])))) for i in range(300)] + AWKWARD
    rows += [(900, "  begins and ends blank \n"), (901, "é" * 700 + " " + "日本語" * 90 + " end"), (902, "twice " * 50), (902, "twice " * 50)]
    vocabulary = trie_unigram.load_vocabulary()
    got = linear_grouping.pack(docs(spark, rows).withColumns({"sequence": F.lit(1), "piece": F.lit("p"), "salt": F.lit(2)}), vocabulary, capacity=64, groups=6).collect()
    parts = unpacked(got, 64)
    texts = {}
    for i, t in rows:
        if t and t.strip(" \t\n"):
            texts.setdefault(i, []).append(t)
    assert set(parts) == set(texts)
    for i, t in texts.items():
        if len(t) == 1:
            assert "".join(parts[i][k][0] for k in sorted(parts[i])) == t[0]
        else:  # rows that share an id: every text is there as often as the table has it
            assert sum(len(x) for p in parts[i].values() for x in p) == sum(map(len, t))
    counts = {r["doc_id"]: r["n_tokens"] for r in trie_unigram.token_counts(docs(spark, [r for r in rows if len(texts.get(r[0], [])) == 1]), vocabulary).collect()}
    held = {}
    for r in got:
        for p in r["pieces"]:
            held[p["doc_id"]] = held.get(p["doc_id"], 0) + p["n_tokens"]
    assert all(held[i] == n for i, n in counts.items() if n)
    assert len(got) <= 1.12 * sum(held.values()) / 64 + 3
    assert linear_grouping.pack(docs(spark, [])).count() == 0


# 6 sharding


def test_hilbert_curve_is_a_walk_through_all_cells():
    side = np.arange(8)
    grid = np.stack([a.ravel() for a in np.meshgrid(side, side, side, indexing="ij")], axis=1)
    h = hilbert_sharding.hilbert_index(grid, 3)
    walk = grid[np.argsort(h)]
    assert sorted(h) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([i, None, -i]), "t", rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), rng.choice([None, -3, 0, 10, 5000, 10**9])) for i in range(500)]
    df = spark.createDataFrame(rows, DOCS).withColumn("hot", F.lit(1))
    got = hilbert_sharding.shards(df, shard_rows=64).collect()
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
    assert len(got) == 500 and [sizes[s] for s in range(8)] == [64] * 7 + [52]
    order = sorted(got, key=lambda r: r["shard"])
    assert all(a["hilbert"] <= b["hilbert"] or a["shard"] == b["shard"] for a, b in zip(order, order[1:]))
    small = hilbert_sharding.placed(df.withColumns({"x": F.lit(1), "cell": F.lit("c"), "salt": F.lit(0), "row": F.lit(7), "__x": F.lit(2)}), shard_rows=64, window_rows=3)
    assert small.columns == [*df.columns, "x", "cell", "salt", "row", "__x", "hilbert", "shard"] and small.where("x = 1 and cell = 'c' and row = 7").count() == 500
    assert sorted(r[0] for r in small.groupBy("shard").count().select("count").collect()) == [52] + [64] * 7
    hilbert_sharding.write_shards(df, str(tmp_path / "s"), shard_rows=64, shards_per_task=3)
    files = [spark.read.parquet(str(f)).select("shard").distinct().collect() for f in (tmp_path / "s").glob("*.parquet")]
    assert len(files) == 8 and all(len(f) == 1 for f in files)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 500 and back.select("shard").distinct().count() == 8 and set(df.columns) <= set(back.columns)
    assert hilbert_sharding.shards(spark.createDataFrame([], DOCS)).count() == 0


def test_cut_points_divide_any_number_of_values(spark):
    for n in (0, 1, 5, 32, 33, 100):
        values = [f"v{i:04}" for i in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "source string")
        cuts = hilbert_sharding.cut_points(df, "source")
        assert [sum(c <= v for c in cuts) for v in values] == [r * 32 // max(n, 32) for r in range(n)]
    df = spark.range(5000).select(F.format_string("v%05d", "id").alias("source"))
    cuts = hilbert_sharding.cut_points(df, "source", values=1000)
    assert 28 <= len(cuts) <= 31 and cuts == sorted(cuts) and cuts[15] > "v02000" and cuts[15] < "v03000"


def test_cut_points_are_exact_above_any_number_of_values(spark):
    """They were those of a sample when there were more values than the driver sorts."""
    values = sorted({f"{'é' * (i % 3)}v{i * 7919 % 10007:05}" for i in range(1234)} | {"", "~", "\U0001f600", "\uffff"}, key=str.encode)
    df = spark.createDataFrame([(v or None,) for v in values * 2], "source string").repartition(5)
    want = [v for r, v in enumerate(values) if r and r * 32 // len(values) > (r - 1) * 32 // len(values)]
    assert len(want) == 31
    assert hilbert_sharding.cut_points(df, "source") == hilbert_sharding.cut_points(df, "source", values=10) == want
    assert hilbert_sharding.cut_points(df, "source", values=len(values) - 1) == hilbert_sharding.cut_points(df, "source", values=len(values)) == want
    few = df.where("source < 'v00100'")
    assert hilbert_sharding.cut_points(few, "source", values=0) == hilbert_sharding.cut_points(few, "source")


def test_shards_of_many_sources_match_sql(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(hilbert_sharding.cut_points, "__defaults__", (hilbert_sharding.BITS, 50))
    rows = [(i, "t", f"l{i % 70}", f"s{i * 7919 % 1009}", i * 37 % 9000) for i in range(3000)]
    got = hilbert_sharding.shards(spark.createDataFrame(rows, DOCS), shard_rows=64)
    with duckdb.connect() as db:
        db.register("documents", pa.table({"doc_id": [r[0] for r in rows], "lang": [r[2] for r in rows], "source": [r[3] for r in rows], "n_chars": [r[4] for r in rows]}))
        want = db.sql(hilbert_sharding.shards_sql(shard_rows=64)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


# 8 URL filter


def test_url_patterns(spark):
    urls = ["https://User@A.B.Example.com:80/En/x?y", "http://x.org", "ftp://a.b/c", "nonsense", None, "http://host./d/", ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(temporal_urls.patterns_of(F.col("url"))).collect()]
    assert got[0] == ["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/En"]
    assert got[1] == ["x.org"] and got[5] == ["host", "host/d"] and not any(p for p in (got[4] or []))


def test_patterns_are_brought_to_one_form(spark):
    known = {"B.org.": "b.org", "a.org/EN": "a.org/EN", "HTTP://u@A.org:80/x/": "a.org/x", "a.org/": "a.org", "a.org/x/y": None, "": None, "a b": "a b", None: None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in known], "p string").select("p", temporal_urls.normal_pattern(F.col("p"))).collect()}
    assert got == known
    cap = spark.createDataFrame([(1, "http://a.org/EN/x", 5), (2, "http://A.org./en/x", 5), (3, "http://b.org", 5), (4, "http://b.org", 50)], "page_id long, url string, t long").withColumn("fetched_at", F.timestamp_seconds("t"))
    ent = spark.createDataFrame([("a.org/EN", "BLOCK", 1, None), ("B.org.", "block", 1, 40), ("a.org", "other", 1, None), ("a.org", "block", 9, 9)], "pattern string, action string, t long, u long").withColumns({"listed_on": F.timestamp_seconds("t"), "delisted_on": F.timestamp_seconds("u")})
    assert {r["page_id"]: r["blocked"] for r in temporal_urls.judge(cap, ent).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_url_filter_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org"]
    entries = [(rng.choice([*hosts, "b.a.com/x", "B.A.com.", "b.a.com/X"]), rng.choice(["block", "allow", "BLOCK"]), 100 * rng.randrange(20), rng.choice([None, None, 50 + 100 * rng.randrange(22)])) for _ in range(60)] + [(None, "block", 1, None), ("a.com", None, 5, None), ("d.org", "block", None, None)]
    captures = [(rng.choice([i, None]), f"http://{rng.choice(hosts)}/{rng.choice(['x/', 'X/', ''])}p", rng.choice([rng.randrange(2100), 300, None])) for i in range(300)]
    captures += [captures[0], (7, None, 50), (8, "junk", 50)]
    cap = spark.createDataFrame(captures, "page_id long, url string, t long").withColumns({"fetched_at": F.timestamp_seconds("t"), "pattern": F.lit("clash"), "copies": F.lit(9)})
    ent = spark.createDataFrame(entries, "pattern string, action string, t long, u long").withColumns({"listed_on": F.timestamp_seconds("t"), "delisted_on": F.timestamp_seconds("u"), "url": F.lit("clash")})
    got = sorted((str(r["page_id"]), str(r["url"]), str(r["t"]), str(r["pattern"]), str(r["action"]), r["blocked"]) for r in temporal_urls.judge(cap, ent).withColumn("t", F.unix_timestamp("fetched_at")).collect())

    def form(p):
        host, _, path = p.partition("/")
        return host.lower().rstrip(".") + ("/" + path if path else "")

    known = [(form(p), a.lower(), t, u) for p, a, t, u in entries if p and a and t is not None and (u is None or u > t)]
    want = []
    for page, url, t in captures:
        best = None
        if url and url != "junk" and t is not None:
            host, path = url[7:].split("/", 1)
            labels = host.split(".")
            covers = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] + ([f"{host}/{path[:1]}"] if "/" in path else [])
            for p in covers:
                times = [at for q, _, at, _ in known if q == p and at <= t]
                if times:
                    a, end = max(((a, u if u is not None else 10**9) for q, a, at, u in known if q == p and at == max(times)))
                    if t < end:
                        best = max(best or (0, "", ""), (len(p), p, a))
        want.append((str(page), str(url), str(t), str(best and best[1]), str(best and best[2]), bool(best and best[2] == "block")))
    assert got == sorted(want)
    assert temporal_urls.judge(cap, ent.where("false")).where("blocked").count() == 0
    assert temporal_urls.judge(cap.where("false"), ent).count() == 0


# 9 decontamination


def brute_tiles(a, b, least):
    """Greedy tiling by looking at all pairs of positions."""
    used_a, used_b, covered = set(), set(), 0
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        done = False
        for i, j in found:
            if not any(i + k in used_a or j + k in used_b for k in range(best)):
                used_a.update(range(i, i + best))
                used_b.update(range(j, j + best))
                covered, done = covered + best, True
        if not done:
            return covered


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=40))
def test_tiling_covers_as_much_as_brute_force(a, b):
    tiles = string_tiling.tile(np.array(a, dtype=U64) + U64(9), np.array(b, dtype=U64) + U64(9), 3)
    assert sum(t[2] for t in tiles) == brute_tiles(a, b, 3)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)


def bench_fixture():
    rng = random.Random(11)
    items = [(k, words(rng, rng.choice([4, 12, 30, 40]), 3000)) for k in range(25)]
    rows = []
    for i in range(120):
        w = words(rng, rng.randrange(10, 150), 3000)
        if i % 3 == 0:
            _, q = rng.choice(items)
            kind = i % 4
            part = q if kind == 0 else q[len(q) // 2 :] + ["zz"] + q[: len(q) // 2] if kind == 1 else q[: len(q) // 3] if kind == 2 else [x.upper() + "," for x in q]
            at = rng.randrange(len(w))
            w[at:at] = part
        rows.append((i, " ".join(w)))
    return rows, [(k, " ".join(w)) for k, w in items] + [(100, None), (101, ""), (102, "two words"), (None, items[3][1] and " ".join(items[3][1]))]


def brute_contamination(rows, items):
    import re

    fold = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in rows:
        for k, q in items:
            a, b = fold(q), fold(t)
            if len(a) >= 3 and len(b) >= min(5, len(a)) and brute_tiles(a, b, min(5, len(a))) / len(a) >= 0.5:
                out.add((i, k))
    return out


def test_contamination_by_both_paths(spark):
    rows, items = bench_fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(rows, items)
    assert len(want) > 20
    near = string_tiling.contaminated(docs(spark, rows), bench)
    far = string_tiling.contaminated(docs(spark, rows), bench, broadcast_seeds=0)
    assert {(r["doc_id"], r["item_id"]) for r in near.collect()} == want == {(r["doc_id"], r["item_id"]) for r in far.collect()}
    kept = {r["doc_id"] for r in string_tiling.drop_contaminated(docs(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert kept == {r["doc_id"] for r in string_tiling.drop_contaminated(docs(spark, rows), bench, broadcast_seeds=0).collect()}
    with pytest.raises(ValueError):
        string_tiling.contaminated(docs(spark, rows), bench, 0.3)


def test_contamination_by_items_that_repeat_themselves(spark):
    phrase, digits = "alpha beta gamma delta epsilon", "7 7 7 7 7 7 7 7 7 7"
    items = [(1, " ".join([phrase] * 20)), (2, " ".join([digits] * 8)), (3, "so " * 50), (4, "one two three four five six seven eight nine ten eleven twelve")]
    rows = [(10 * i, f"before it {t} and after") for i, t in items] + [(50, f"once {phrase} only"), (60, "7 7 7 7 7 once"), (70, "nothing at all of these")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(rows, items)
    assert want == {(10, 1), (20, 2), (30, 3), (40, 4)}
    for seeds in (string_tiling.BROADCAST_SEEDS, 0):
        got = string_tiling.contaminated(docs(spark, rows + rows[:2]), bench, broadcast_seeds=seeds).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and all(r["coverage"] == 1 for r in got)


@pytest.mark.parametrize("seeds", [string_tiling.BROADCAST_SEEDS, 0])
def test_contamination_awkward(spark, seeds):
    bench = spark.createDataFrame([(1, "null id here with words"), (2, None), (2, None), (1, "null id here with words")], "item_id long, text string")
    df = docs(spark, AWKWARD).withColumns({"item": F.lit(1), "row": F.lit("r"), "seed": F.lit(2), "__doc_key": F.lit(3)})
    assert [r["doc_id"] for r in string_tiling.contamination_report(df, bench, broadcast_seeds=seeds).collect()] == [None]
    out = string_tiling.drop_contaminated(df, bench, broadcast_seeds=seeds)
    assert out.columns == df.columns and out.count() == len(AWKWARD) - 1
    assert string_tiling.drop_contaminated(df, bench.where("false"), broadcast_seeds=seeds).count() == len(AWKWARD)
    assert string_tiling.contamination_report(docs(spark, []), bench, broadcast_seeds=seeds).count() == 0


def test_tiling_of_very_repetitive_texts_is_quick():
    import time

    item = np.arange(60, dtype=U64) % U64(3)
    began = time.time()
    assert sum(t[2] for t in string_tiling.tile(item, np.tile(item, 1667))) == 60
    string_tiling.tile(item, np.random.default_rng(1).integers(0, 2, 100_000).astype(U64))
    assert time.time() - began < 5


# 10 near-dedup


def near_fixture(seed=12):
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.randrange(40, 300)))) for i in range(150)]
    for i in range(40):
        w = rows[i][1].split()
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, rows[100][1]) for i in range(30)]
    return rows


def brute_groups(rows):
    rows = sorted({(i, t) for i, t in rows}, key=lambda r: (-(1 << 63) if r[0] is None else r[0], str(r[1])))
    data, offs = text_buffers(pa.array([t for _, t in rows], pa.string()))
    fp, n = simhash_vptree.fingerprints(data, offs)
    level = simhash_vptree.length_level(n)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if n[a] and n[b] and np.bitwise_count(fp[a, 0] ^ fp[b, 0]) <= simhash_vptree.R64 and np.bitwise_count(fp[a] ^ fp[b]).sum() <= simhash_vptree.R256 and abs(level[a] - level[b]) <= simhash_vptree.LEN_LEVELS:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def brute_links(rows):
    """Links to other classes of each document, by comparing all pairs of classes."""
    rows = sorted({(i, t) for i, t in rows}, key=str)
    fp, n = simhash_vptree.fingerprints(*text_buffers(pa.array([t for _, t in rows], pa.string())))
    level, kind = simhash_vptree.length_level(n), [(*f.tolist(), int(k)) for f, k in zip(fp, n)]
    one = {k: i for i, k in enumerate(kind) if n[i]}
    out = {}
    for i, (d, _) in enumerate(rows):
        out[d] = sum(k != kind[i] and np.bitwise_count(fp[i, 0] ^ fp[j, 0]) <= simhash_vptree.R64 and np.bitwise_count(fp[i] ^ fp[j]).sum() <= simhash_vptree.R256 and abs(level[i] - level[j]) <= simhash_vptree.LEN_LEVELS for k, j in one.items())
    return out


@pytest.mark.parametrize(("leaf_rows", "visitors", "links"), [(65_536, 524_288, 2_000_000), (30, 524_288, 2_000_000), (30, 25, 3)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, leaf_rows, visitors, links):
    rows = near_fixture()
    monkeypatch.setattr(simhash_vptree, "LINKS", links)
    g = simhash_vptree.near_duplicate_groups(docs(spark, rows), leaf_rows=leaf_rows, visitors=visitors).collect()
    got = {}
    for r in g:
        got.setdefault(r["first"]["doc_id"], []).append(r["doc_id"])
    assert sorted(sorted(v) for v in got.values()) == brute_groups(rows)
    assert {len(v) for v in got.values()} >= {31} and all(i in got or any(i in v for v in got.values()) for i in range(40))
    want = brute_links(rows)
    assert {r["doc_id"]: r["n_links"] for r in g} == {r["doc_id"]: want[r["doc_id"]] for r in g}
    classes = {}
    for r in g:
        classes.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert {100, *range(2000, 2030)} in classes.values()


def test_vantage_point_tree_prunes_and_finds_all():
    rng = np.random.default_rng(3)
    n = 3000
    word = rng.integers(0, 1 << 63, n).astype(U64)
    word[1::2] = word[::2] ^ (U64(1) << rng.integers(0, 63, n // 2).astype(U64))
    level = rng.integers(0, 200, n)
    tree = simhash_vptree.Tree(word, level, 16, 2, 200)
    kinds = {x[0] for x in tree.nodes}
    assert "word" in kinds and tree.leaves == 16
    homes, visits, pairs = np.zeros(n, int), 0, set()
    for _, rows, home in tree.route(word, level):
        homes[rows[home]] += 1
        visits += len(rows)
        d = np.bitwise_count(word[rows[home], None] ^ word[None, rows]) <= 2
        pairs |= {tuple(sorted((int(rows[home][i]), int(rows[j])))) for i, j in zip(*np.nonzero(d)) if rows[home][i] != rows[j]}
    every = np.bitwise_count(word[:, None] ^ word[None, :]) <= 2
    assert (homes == 1).all() and visits < 0.8 * 16 * n
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(every)) if i < j}


@pytest.mark.parametrize("leaves", [1, 2, 7, 8])
def test_two_classes_meet_in_one_leaf_only(leaves):
    """Each of them visited the other's leaf, so that all pairs were compared twice."""
    rng = np.random.default_rng(4)
    n = 600
    word = rng.integers(0, 1 << 63, n).astype(U64)
    word[1::2] = word[::2] ^ (U64(1) << rng.integers(0, 63, n // 2).astype(U64))
    level = np.repeat(rng.integers(0, 60, n // 2), 2) + rng.integers(0, 4, n)
    met = np.zeros((n, n), int)
    tree = simhash_vptree.Tree(word, level, leaves, 3, 4)
    for _, rows, home in tree.meetings(word, level):
        a, b = rows[home], rows[~home]
        met[np.ix_(a, a)] += 1
        met[np.ix_(a, b)] += 1
        met[np.ix_(b, a)] += 1
    close = (np.bitwise_count(word[:, None] ^ word[None]) <= 3) & (np.abs(level[:, None] - level[None]) <= 4)
    assert tree.leaves == leaves and met.max() == 1 and (met[close] == 1).all() and (np.diag(met) == 1).all()


@pytest.mark.parametrize(("n", "block", "width"), [(403, 64, 2048), (403, 7, 13), (64, 8, 16), (2, 64, 2048)])
def test_close_pairs_are_all_pairs_once(n, block, width):
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 63, (n, 4)).astype(U64)
    for k in range(1, n, 2):
        for w in range(4):
            fp[k, w] = fp[k - 1, w] ^ np.bitwise_or.reduce(U64(1) << rng.integers(0, 63, rng.integers(1, 30)).astype(U64))
    level = np.sort(rng.integers(0, 40, n))
    home = rng.random(n) < 0.5
    home[0] = True
    near = (np.bitwise_count(fp[:, None, 0] ^ fp[None, :, 0]) <= 22) & (np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= 60) & (np.abs(level[:, None] - level[None]) <= 8)
    inside = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near))) if home[i] and home[j] and i < j}
    across = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near))) if home[i] and not home[j]}
    for inner in (True, False):
        got = [(int(i), int(j)) for a, b in simhash_vptree.close_pairs(fp, level, home, 22, 60, 8, inner, block, width) for i, j in zip(a, b)]
        assert len(got) == len(set(got)) and set(got) == (inside | across if inner else across)
    assert n < 100 or (len(inside) > 5 and len(across) > 5)


@pytest.mark.parametrize("rows_to_broadcast", [1_000_000, 0])
def test_drop_near_duplicates(spark, monkeypatch, rows_to_broadcast):
    monkeypatch.setattr("sparkvane.llm.common.small.__defaults__", (rows_to_broadcast,))
    rows = near_fixture() + AWKWARD + [(3, AWKWARD[3][1])]
    df = docs(spark, rows).withColumn("root", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("__doc_hash", F.lit(2))
    out = simhash_vptree.drop_near_duplicates(df)
    assert out.columns == df.columns
    kept = sorted(str(r["doc_id"]) for r in out.collect())
    gone = [x for g in brute_groups(rows) for x in sorted(g, key=lambda v: -(1 << 63) if v is None else v)[1:]]
    want = [i for i, _ in sorted(set(rows), key=str)] + [3]  # rows without a word stay, repeated or not
    for x in gone:
        want.remove(x)
    assert kept == sorted(map(str, want))
    assert simhash_vptree.drop_near_duplicates(docs(spark, [])).count() == 0 and simhash_vptree.near_duplicates(docs(spark, AWKWARD[:4])).count() == 0


# The operators on documents with clashing extra columns and on the awkward ones


def test_substring_dedup_awkward(spark):
    df = docs(spark, AWKWARD).withColumns({"seeds": F.lit(1), "at": F.lit("x"), "__index": F.lit(2)})
    out = recompression.drop_repeated_passages(df)
    assert out.columns == df.columns
    texts = sorted(str(r["text"]) for r in out.collect())
    assert len(texts) == len(AWKWARD) and sorted(t for _, t in AWKWARD if t and not t.startswith("a a")) == [t for t in texts if t not in ("", "None") and not t.startswith("a ")]
    assert recompression.repeated_passages(docs(spark, [])).count() == 0
    assert recompression.drop_repeated_passages(docs(spark, [])).count() == 0


# Identity


def test_documents_are_told_apart_whatever_their_ids(spark):
    """Equal and null ids, nulls and empty texts: different rows have different identities. 31 bits alone would merge some of these."""
    rows = [(None, f"text {i}") for i in range(200_000)] + [(1, None), (1, ""), (None, None), (None, "")]
    found = identified(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.select(KEY, HASH).distinct().count() == len(rows) and found.select(HASH).distinct().count() < len(rows)
    kept = simhash_vptree.drop_near_duplicates(spark.createDataFrame([(None, "one two three"), (None, "four five six"), (None, "four five six")], "doc_id long, text string"))
    assert sorted(r["text"] for r in kept.collect()) == ["four five six", "one two three"]


def test_operators_take_string_ids(spark):
    rng = random.Random(17)
    shared = " ".join(words(rng, 70))
    rows = [(f"id-{i}", " ".join(words(rng, 60)) + (f" {shared}" if i % 2 else "") + (" idiot" if i % 3 == 0 else "")) for i in range(40)]
    rows += [("copy", rows[4][1]), (None, "null id")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS.replace("doc_id long", "doc_id string"))
    labels = spark.createDataFrame([(f"id-{i}", 1, int(i % 3 == 0)) for i in range(40)], "doc_id string, quality int, toxic int")
    bench = spark.createDataFrame([("item", " ".join(rows[2][1].split()[:30]))], "item_id string, text string")
    ids = {i for i, _ in rows}
    assert {r["doc_id"] for r in recompression.repeated_passages(df).collect()} == {f"id-{i}" for i in range(1, 40, 2)} | {"id-4", "copy"}
    assert recompression.drop_repeated_passages(df).count() == len(rows) - 1  # of the copies, the first by id stays
    vocabulary = trie_unigram.load_vocabulary()
    assert {r["doc_id"] for r in trie_unigram.token_counts(df, vocabulary).collect()} == ids
    chain = toxicity_chain.fit_chain(df, labels)
    assert {r["doc_id"] for r in toxicity_chain.score(df, chain).collect()} == ids and toxicity_chain.drop_toxic(df, chain).columns == df.columns
    assert {r["doc_id"] for r in ordinal_quality.score(df, ordinal_quality.fit_quality(df, labels)).collect()} == ids
    assert set(unpacked(linear_grouping.pack(df, vocabulary, 64, groups=4).collect(), 64)) == ids
    assert {r["doc_id"] for r in hilbert_sharding.shards(df).collect()} == ids
    for seeds in (string_tiling.BROADCAST_SEEDS, 0):
        assert [(r["doc_id"], r["item_id"]) for r in string_tiling.contamination_report(df, bench, broadcast_seeds=seeds).collect()] == [("id-2", "item")]
    assert {(r["doc_id"], r["group_id"], r["kept"]) for r in simhash_vptree.near_duplicates(df).collect()} >= {("copy", "copy", True), ("id-4", "copy", False)}


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared_folder(Session)


def test_samples_are_bounded_and_do_not_depend_on_partitions(spark):
    df = spark.range(5000).toDF("id")
    one, two = hashed_sample(df, 500, "id"), hashed_sample(df.repartition(7), 500, "id")
    assert 350 < one.count() <= 500 and sorted(one.collect()) == sorted(two.collect())
    assert hashed_sample(df, 5000, "id").count() == 5000 and hashed_sample(df.where("false"), 5, "id").count() == 0
    rows = [(7, f"text {i}") for i in range(2000)] + [(i, "x") for i in range(100, 110)]
    labels = spark.createDataFrame([(7, 1), *[(i, 0) for i in range(100, 110)]], "doc_id long, toxic int")
    index, offs, y = linear.sample(docs(spark, rows), labels, {"toxic": F.col("toxic")}, 11)
    assert len(offs) == 12 and sum(y["toxic"]) == 1  # an id counts once however many documents have it
