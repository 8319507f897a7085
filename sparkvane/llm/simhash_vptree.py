"""Near-duplicate documents: SimHash fingerprints searched through vantage-point trees.

A document's features are its distinct folded words and distinct neighbouring word pairs; a fingerprint has 256
sign bits of their hashed sum, kept as four words of 64. Two documents are near copies when

* the Hamming distance of the whole fingerprint is at most ``R256`` and of the first word at most ``R64`` (a quick test: at the
  full distance 0.6 % of pairs fail it, at a distance of 50 fewer than 1 in 1,000), and
* their word counts differ by at most ``LEN_LEVELS`` steps of 1/16 octave (thermometer-coded, so that this too is a
  Hamming distance).

The search is exact for that definition. Documents with equal fingerprint and length form a class first. A tree whose
inner nodes are vantage points (a fingerprint, or the empty document for the thermometer part) is built from a bounded
sample; each node splits at the median distance. Every class has one home leaf and visits, as a query, leaves
that the triangle bound can't exclude (distance within the radius of the split). The bound is symmetric: of two close classes each could visit the other's
leaf, so for any two leaves only the classes of one visit the other, and a pair is compared once. A leaf compares home x (home + visitors); if the sample
tells of more than ``VISITORS`` visitors, these are dealt over copies of the leaf, so that memory stays bounded.
Of all vantage points tried for a node the one with the least overlap is taken. A link is found in one leaf and counted for both its classes;
links are folded to a forest block by block, so a leaf never holds all its pairs.

The result has one row a document with its class and the class's number of links to other classes; copies aren't expanded into pairs.

Nulls and edge cases: a null or wordless text has no fingerprint and no group, and such rows all stay; other rows equal in id and text are one
document; of those that differ in other columns any one is kept; a null doc_id is an id of its own, before all others, ids may be of any sortable type; a group is named by
its least id, ties by hash of the text. Very long texts are fingerprinted whole. Extra columns are kept by ``drop_near_duplicates``, whatever their names, and else
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH, KEY, checkpoint, components, hashed_sample, id_type, identified, marked, small
from .textops import U64, combine, mix, signed, text_buffers, tokens_of

R64, R256, LEN_LEVELS = 22, 60, 8
#: Classes that have their home in a leaf, and visitors of a leaf that are compared at a time, about.
LEAF_ROWS, VISITORS = 65_536, 524_288
#: Leaves at least, so that all cores have work, as long as each has ``LEAST_ROWS`` classes.
LEAVES, LEAST_ROWS = 24, 2_048
#: Links that are kept before they are folded to a forest.
LINKS = 2_000_000
SAMPLE_ROWS = 16_384
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float32)


def fingerprints(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n x 4 words) and word counts of documents given as bytes and offsets."""
    n = len(offs) - 1
    out, words = np.zeros((n, 4), U64), np.zeros(n, np.int64)
    for i, j, t in tokens_of(data, offs, fold=True):
        nd = j - i
        words[i:j] = np.diff(t.first)
        if not len(t.hash):
            continue
        same = t.doc[1:] == t.doc[:-1]
        pair = combine(t.hash[:-1][same], t.hash[1:][same])
        doc = np.concatenate([t.doc, t.doc[1:][same]])
        value = np.concatenate([t.hash, pair])
        for lo in range(0, nd, 4096):  # sort keys hold 12 bits of document and 52 of feature
            part = slice(None) if nd <= 4096 else (doc >= lo) & (doc < lo + 4096)
            key = ((doc[part] - lo).astype(U64) << U64(52)) | (value[part] >> U64(12))
            key.sort()
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            key = key[fresh]
            d = (key >> U64(52)).astype(np.int64)
            feature = key << U64(12)
            m = min(4096, nd - lo)
            half = np.bincount(d, minlength=m).astype(np.float32) / 2
            for w in range(4):
                x = mix(feature + U64(0x51ED27 * (w + 1)))
                at = d * 256
                for byte in range(8):
                    hist = np.bincount(at + ((x >> U64(8 * byte)) & U64(255)).astype(np.int64), minlength=m * 256).reshape(m, 256)
                    bits = (hist.astype(np.float32) @ _BITS) > half[:, None]
                    out[i + lo : i + lo + m, w] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(U64) << U64(8 * byte)
    return out, words


def length_level(words: np.ndarray) -> np.ndarray:
    """Number of thermometer bits set for a word count: 16 an octave."""
    return np.rint(16 * np.log2(np.maximum(words, 1))).astype(np.int64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree over (first word, length level); leaves are shards. Bounded by its sample, whatever the data."""

    def __init__(self, word: np.ndarray, level: np.ndarray, leaves: int, r64: int, r_len: int, seed: int = 7) -> None:
        self.r64, self.r_len, self.nodes, self.leaves = r64, r_len, [], 0
        self._rng = np.random.default_rng(seed)
        self.root = self._build(word, level, max(1, leaves))

    def _distances(self, kind: str, vantage: int, word: np.ndarray, level: np.ndarray) -> np.ndarray:
        return level if kind == "length" else hamming(word, U64(vantage)).astype(np.int64)

    def _build(self, word: np.ndarray, level: np.ndarray, leaves: int) -> int:
        best = None
        if leaves > 1 and len(word) > 1:
            tries = [("length", 0)] + [("word", int(v)) for v in self._rng.choice(word, min(4, len(word)), replace=False)]
            for kind, vantage in tries:
                d = self._distances(kind, vantage, word, level)
                mu = int(np.median(d))
                r = self.r_len if kind == "length" else self.r64
                left = int((d <= mu).sum())
                if left in (0, len(d)):
                    mu -= 1
                    left = int((d <= mu).sum())
                    if left in (0, len(d)):
                        continue
                cost = int((d <= mu + r).sum()) * left + int((d > mu - r).sum()) * (len(d) - left)
                if best is None or cost < best[0]:
                    best = (cost, kind, vantage, mu, d <= mu)
        if best is None:
            self.leaves += 1
            self.nodes.append(("leaf", self.leaves - 1))
            return len(self.nodes) - 1
        _, kind, vantage, mu, inside = best
        share = max(1, min(leaves - 1, round(leaves * float(inside.mean()))))
        a = self._build(word[inside], level[inside], share)
        b = self._build(word[~inside], level[~inside], leaves - share)
        self.nodes.append((kind, vantage, mu, a, b))
        return len(self.nodes) - 1

    def route(self, word: np.ndarray, level: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, row indexes, whether it is their home), each row once in its home and in every leaf its ball touches."""
        stack = [(self.root, np.arange(len(word)), np.ones(len(word), bool))]
        while stack:
            at, rows, home = stack.pop()
            if not len(rows):
                continue
            node = self.nodes[at]
            if node[0] == "leaf":
                yield node[1], rows, home
                continue
            kind, vantage, mu, a, b = node
            r = self.r_len if kind == "length" else self.r64
            d = self._distances(kind, vantage, word[rows], level[rows])
            to_a, to_b = d <= mu + r, d > mu - r
            stack.append((a, rows[to_a], home[to_a] & (d[to_a] <= mu)))
            stack.append((b, rows[to_b], home[to_b] & (d[to_b] > mu)))

    def meetings(self, word: np.ndarray, level: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As ``route``, but of any two leaves only one is visited from the other: each is from about half of the others."""
        routed, own = list(self.route(word, level)), np.zeros(len(word), np.int64)
        for leaf, rows, home in routed:
            own[rows[home]] = leaf
        for leaf, rows, home in routed:
            ahead = (leaf - own[rows]) % self.leaves
            stays = home | (2 * ahead < self.leaves) | ((2 * ahead == self.leaves) & (own[rows] < leaf))
            yield leaf, rows[stays], home[stays]


def _within(a: np.ndarray, b: np.ndarray, r: int) -> np.ndarray:
    """Places, in the flattened table of all pairs of a and b, of those that differ in at most r bits."""
    near = (np.bitwise_count(a[:, None] ^ b[None]) <= r).ravel()
    if len(near) % 8:
        return np.flatnonzero(near)
    some = np.flatnonzero(near.view(U64))  # few are near: look for them in eights first
    at = np.flatnonzero(near.reshape(-1, 8)[some].ravel())
    return some[at >> 3] * 8 + (at & 7)


def close_pairs(fp: np.ndarray, level: np.ndarray, home: np.ndarray, r64: int, r256: int, r_len: int, inner: bool = True, block: int = 64, width: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (home row, visitor) within the radii, and, if ``inner``, (home row, later home row), block by block. Rows must be sorted by level."""
    words = [np.ascontiguousarray(fp[:, w]) for w in range(4)]
    sides = [(at, words[0][at], level[at]) for at in (np.flatnonzero(home), np.flatnonzero(~home))]
    homes, first, levels = sides[0]
    for s in range(0, len(homes), block):
        q, own, reach = homes[s : s + block], first[s : s + block], levels[s : s + block]
        for side, (others, word, its) in enumerate(sides):
            if not (side or inner):
                continue
            lo = max(0 if side else s, int(np.searchsorted(its, reach[0] - r_len, "left")))
            hi = int(np.searchsorted(its, reach[-1] + r_len, "right"))
            for c in range(lo, hi, width):
                e = min(hi, c + width)
                i, j = np.divmod(_within(own, word[c:e], r64), e - c)
                i, j = q[i], others[c:e][j]
                # Of pairs that are near in the first word hardly any is in three.
                d = sum(np.bitwise_count(w[i] ^ w[j]) for w in words[:3])
                ok = d <= r256
                if ok.any():
                    i, j, d = i[ok], j[ok], d[ok]
                    ok = (d + np.bitwise_count(words[3][i] ^ words[3][j]) <= r256) & (np.abs(level[i] - level[j]) <= r_len)
                    if not side:
                        ok &= j > i
                    if ok.any():
                        yield i[ok], j[ok]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes (vectorised label propagation with pointer jumping)."""
    root = np.arange(n)
    while len(a):
        m = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], m)
        np.minimum.at(new, root[b], m)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, identity, f0..f3, n_words) of each row that has a word."""
    names = ["doc_id", KEY, HASH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, words = fingerprints(*text_buffers(batch.column("text")))
            out = [batch.column(k) for k in names] + [pa.array(signed(np.ascontiguousarray(fp[:, w]))) for w in range(4)] + [pa.array(words)]
            yield pa.RecordBatch.from_arrays(out, [*names, "f0", "f1", "f2", "f3", "n_words"]).filter(pa.array(words > 0))

    return identified(docs).mapInArrow(run, f"doc_id {id_type(docs)}, {KEY} long, {HASH} long, f0 long, f1 long, f2 long, f3 long, n_words long")


def near_duplicate_groups(docs: DataFrame, r64: int = R64, r256: int = R256, r_len: int = LEN_LEVELS, leaf_rows: int = LEAF_ROWS, visitors: int = VISITORS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Every document of a group of two or more, or that has several rows: (doc_id, identity, class_id, n_rows, n_links, n_docs, first: doc_id and identity of the group's first document)."""
    of_class = ["f0", "f1", "f2", "f3", "n_words"]
    fps = checkpoint(fingerprint_table(docs).groupBy("doc_id", KEY, HASH, *of_class).agg(F.count("*").alias("n_rows")).withColumn("node", F.xxhash64(*of_class)))
    nodes = checkpoint(fps.select("node", *of_class).distinct())
    total = nodes.count()
    want = max(-(-total // leaf_rows), min(LEAVES, total // least_rows), 1)
    sample = hashed_sample(nodes.select("node", "f0", "n_words"), SAMPLE_ROWS, "node").orderBy("node").toPandas() if want > 1 else None
    if sample is None:
        tree = Tree(np.zeros(0, U64), np.zeros(0, np.int64), 1, r64, r_len)
    else:
        tree = Tree(sample["f0"].to_numpy().astype(np.int64).view(U64), length_level(sample["n_words"].to_numpy()), want, r64, r_len)

    copies = np.ones(tree.leaves, np.int64)
    if sample is not None:
        for leaf, _, home in tree.meetings(sample["f0"].to_numpy().astype(np.int64).view(U64), length_level(sample["n_words"].to_numpy())):
            copies[leaf] = max(1, -(-int((~home).sum()) * total // (len(sample) * visitors)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("f0").to_numpy().view(U64)
            level = length_level(batch.column("n_words").to_numpy())
            for leaf, rows, home in tree.meetings(word, level):
                n = int(copies[leaf])
                # A visitor goes to one copy of the leaf, a row at home to all.
                copy = np.where(home, 0, (mix(word[rows]) % U64(n)).astype(np.int64))
                rows = np.concatenate([rows, np.tile(rows[home], n - 1)])
                copy = np.concatenate([copy, np.repeat(np.arange(1, n), int(home.sum()))])
                home = np.concatenate([home, np.ones(len(rows) - len(home), bool)])
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, np.int32)), pa.array(copy.astype(np.int32)), pa.array(home), *part.columns], ["leaf", "copy", "home", *part.schema.names])

    out = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        """A link of each class to its tree's root in this leaf, and how many links each class has here."""
        level = length_level(table.column("n_words").to_numpy())
        order = np.argsort(level, kind="stable")
        ids = table.column("node").to_numpy()[order]
        fp = np.stack([table.column(f"f{w}").to_numpy().view(U64)[order] for w in range(4)], axis=1)
        home = table.column("home").to_numpy(zero_copy_only=False)[order]
        n, inner = len(ids), int(table.column("copy")[0].as_py()) == 0  # two rows at home meet in the first copy only
        root, links, kept, size = np.arange(n), np.zeros(n, np.int64), [], 0

        def fold() -> None:
            nonlocal root, links, kept, size
            for side in zip(*kept, strict=True):
                links += np.bincount(np.concatenate(side), minlength=n)
            root, kept, size = _folded(n, root, kept), [], 0

        for pair in close_pairs(fp, level[order], home, r64, r256, r_len, inner):
            kept.append(pair)
            size += len(pair[0])
            if size > LINKS:
                fold()
        fold()
        some = np.flatnonzero((root != np.arange(n)) | (links > 0))
        return pa.table([ids[some], ids[root[some]], links[some]], schema=out)

    routed = nodes.mapInArrow(route, "leaf int, copy int, home boolean, node long, f0 long, f1 long, f2 long, f3 long, n_words long")
    found = checkpoint(routed.groupBy("leaf", "copy").applyInArrow(compare, "node long, other long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(found.where("node <> other"), "node", "other")
    member = fps.join(roots, "node", "left").join(links, "node", "left").select("doc_id", KEY, HASH, "n_rows", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.hex("node").alias("class_id"), F.coalesce("root", "node").alias("root"))
    group = member.groupBy("root").agg(F.min(F.struct("doc_id", KEY, HASH)).alias("first"), F.count("*").alias("n_docs"))
    return member.join(group, "root").where("n_docs > 1 or n_rows > 1").drop("root")


def _folded(n: int, root: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The forest after further links."""
    if not links:
        return root
    known = np.flatnonzero(root != np.arange(n))
    return _forest(n, np.concatenate([known, *[a for a, _ in links]]), np.concatenate([root[known], *[b for _, b in links]]))


def _is_first() -> F.Column:
    return (F.col(KEY) == F.col(f"first.{KEY}")) & (F.col(HASH) == F.col(f"first.{HASH}"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every document that has a copy or near copy: (doc_id, group_id, class_id, n_links, n_docs, kept).

    Documents of one class have equal fingerprints; ``n_links`` is the number of other classes that the class is a near copy of. Links join classes to groups, of which one
    document, the one called as the group, is kept.
    """
    g = near_duplicate_groups(docs).where("n_docs > 1")
    return g.select("doc_id", F.col("first.doc_id").alias("group_id"), "class_id", "n_links", "n_docs", _is_first().alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; all columns stay. Rows equal in id and text become one.

    Only what goes is joined with the texts: by broadcast if it is small, else by a shuffle of the documents. Documents of several rows
    are reduced apart, so that all others pass by.
    """
    groups = checkpoint(near_duplicate_groups(docs).select(KEY, HASH, "n_rows", _is_first().alias("kept")))
    rows, by = marked(docs), [KEY, HASH]
    out = rows.join(small(groups.where("not kept or n_rows > 1").select(*by)), by, "left_anti")
    several = groups.where("kept and n_rows > 1").select(*by)
    if several.limit(1).count():
        out = out.union(rows.join(small(several), by, "left_semi").dropDuplicates(by))
    return out.select("row.*")
