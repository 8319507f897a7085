"""Benchmark decontamination by greedy string tiling.

Words are folded. Windows of ``SEED`` words that a test item and a document share are the seeds: they are found by a join on
the window's hash. For each (document, item) pair with enough seeded words, tiling repeatedly marks the longest match of
unmarked words of both texts (running Karp-Rabin: match lengths are tried from long to short on window hashes), never
overlapping, until none of ``SEED`` words is left. The share of the item's words under tiles is its coverage; order
doesn't count, so passages that were cut up and reordered are caught. A document is contaminated by an item when the
coverage is at least ``COVERAGE``. A pair is a candidate unless its seeds, at all their places in the item, can't cover that much.

The test set is the small side. Its seeds are broadcast if they are at most ``BROADCAST_SEEDS``; otherwise seeds of both sides are
shuffled and joined, which gives the same pairs. A Bloom filter of the items' seeds, of a fixed size, then keeps most windows of the documents out of the shuffle.

Nulls and edge cases: null or empty texts match nothing; an item of fewer than ``SEED`` words is matched by its whole
length if it has at least ``MIN_ITEM`` words and is ignored below; equal items are each reported, rows equal in item id and text once; rows equal in id and text
are one document in the report and are all dropped; a null doc_id or item_id is an id of its own, and ids may be of any type. Of equally long tiles the leftmost in the item, then in the document, comes first.
Very long texts are tiled whole. An empty table on either side gives no contamination. Extra columns are kept by ``drop_contaminated``, whatever their names, and else ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import HASH, KEY, checkpoint, id_type, identified, marked, small
from .textops import U64, signed, text_buffers, token_hashes, tokens_of, window_hashes

SEED, MIN_ITEM, COVERAGE = 5, 3, 0.5
BROADCAST_SEEDS = 2_000_000


def tile(a: np.ndarray, b: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word hashes a and b: (start in a, start in b, length), longest first, leftmost among equals."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    tiles: list[tuple[int, int, int]] = []
    length = _longest(a, b, free_a, free_b, least, min(len(a), len(b)))
    while length >= least:
        at_a, lo, hi, at_b = _matches(a, b, free_a, free_b, length)
        tried: dict[int, int] = {}  # by hash: windows of b before this one are marked, and stay so
        for i, first, end in zip(at_a, lo, hi, strict=True):
            if not free_a[i : i + length].all():
                continue
            m = tried.get(first, first)
            while m < end and not free_b[at_b[m] : at_b[m] + length].all():
                m += 1
            tried[first] = m
            if m < end:
                j = at_b[m]
                free_a[i : i + length] = free_b[j : j + length] = False
                tiles.append((i, j, length))
        length = _longest(a, b, free_a, free_b, least, length - 1)
    return tiles


def _open(free: np.ndarray, length: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(total[length:] - total[:-length] == length)


def _longest(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, least: int, most: int) -> int:
    """The greatest length up to ``most`` with a match of unmarked words; 0 if none of ``least``. Matches shrink to prefixes, so halving finds it."""
    lo, hi = 0, most
    if least > most:
        return 0
    while lo < hi or lo == 0:
        mid = max(least, (lo + hi + 1) // 2)
        if mid > hi:
            return lo
        if len(np.intersect1d(window_hashes(a, mid)[_open(free_a, mid)], window_hashes(b, mid)[_open(free_b, mid)])):
            lo = mid
        else:
            hi = mid - 1
    return lo


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, length: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Starts in a that have a match; for each the range [from, to) of its matches in the last list, which has the starts in b."""
    at_a, at_b = _open(free_a, length), _open(free_b, length)
    ha, hb = window_hashes(a, length)[at_a], window_hashes(b, length)[at_b]
    order = np.argsort(hb, kind="stable")
    lo, hi = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    some = hi > lo
    return at_a[some].tolist(), lo[some].tolist(), hi[some].tolist(), at_b[order].tolist()


class Items:
    """The tokenised test set with a sorted table of its seeds. Pickled once into a broadcast."""

    def __init__(self, ids: list[int | None], texts: list[str | None]) -> None:
        self.ids, self.words, hashes, owners = ids, [], [], []
        data, offs = text_buffers(pa.array(texts, pa.large_string()))
        for i, j, t in tokens_of(data, offs, fold=True):
            for d in range(j - i):
                h = t.hash[t.first[d] : t.first[d + 1]].copy()
                self.words.append(h)
                if len(h) >= MIN_ITEM:
                    w = window_hashes(h, min(SEED, len(h)))
                    hashes.append(w)
                    owners.append(np.full(len(w), i + d))
        h, o = (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, U64), np.zeros(0, np.int64))
        pair, self.times = np.unique(np.stack([signed(h), o], axis=1), axis=0, return_counts=True) if len(h) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        self.seed, self.owner = pair[:, 0], pair[:, 1]
        self.widths = sorted({min(SEED, len(w)) for w in self.words if len(w) >= MIN_ITEM}, reverse=True)
        self.distinct = np.unique(self.seed)
        self.filter = np.zeros(1 << 20, bool)  # a first test by 20 bits, so that few windows reach the sorted table
        self.filter[self.distinct & 0xFFFFF] = True

    def hits(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows, of any of the widths and within one document, that are a seed."""
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in self.widths:
            w = signed(window_hashes(h, width))
            i = np.flatnonzero(self.filter[w & 0xFFFFF])
            i = i[np.isin(w[i], self.distinct) & (doc[i] == doc[i + width - 1])]
            at.append(i)
            found.append(w[i])
        return np.concatenate(at), np.concatenate(found)

    def candidates(self, seeds: np.ndarray) -> np.ndarray:
        """Items of which enough seeds occur to reach the coverage: each place of a seed in the item covers at most ``SEED`` words."""
        seeds = np.unique(seeds)
        lo, hi = np.searchsorted(self.seed, seeds, "left"), np.searchsorted(self.seed, seeds, "right")
        owner = np.concatenate([self.owner[a:b] for a, b in zip(lo, hi, strict=True)]) if len(seeds) else np.zeros(0, np.int64)
        times = np.concatenate([self.times[a:b] for a, b in zip(lo, hi, strict=True)]) if len(seeds) else np.zeros(0, np.int64)
        item, at = np.unique(owner, return_inverse=True)
        n = np.bincount(at, times, len(item))
        need = np.array([COVERAGE * len(self.words[i]) / SEED for i in item])
        return item[n >= need]


def _judge(h: np.ndarray, seeds: np.ndarray, items: Items, threshold: float) -> list[tuple[int, float, int]]:
    out = []
    for k in items.candidates(seeds):
        item = items.words[k]
        tiles = tile(item, h, min(SEED, len(item)))
        coverage = sum(t[2] for t in tiles) / len(item)
        if coverage >= threshold:
            out.append((int(k), coverage, len(tiles)))
    return out


def _judge_batch(batch: pa.RecordBatch, items: Items, threshold: float) -> Iterator[tuple[int, int, float, int]]:
    """(row, item, coverage, tiles) of a batch's contaminated texts."""
    data, offs = text_buffers(batch.column("text"))
    for i, _, t in tokens_of(data, offs, fold=True):
        at, found = items.hits(t.hash, t.doc)
        owner = t.doc[at]
        for d in np.unique(owner):
            h = t.hash[t.first[d] : t.first[d + 1]]
            for k, coverage, n in _judge(h, found[owner == d], items, threshold):
                yield int(i + d), k, coverage, n


def _small(benchmark: DataFrame, broadcast_seeds: int) -> Items | None:
    """The test set, if its seeds may be broadcast: an item has at most one seed for two characters."""
    size = benchmark.agg(F.sum(F.length("text")), F.count("*")).first()
    if (size[0] or 0) // 2 + size[1] > broadcast_seeds:
        return None
    rows = benchmark.select("item_id", "text").distinct().collect()
    rows.sort(key=lambda r: (r[0] is not None, str(r[0]), r[1] or ""))
    return Items([r[0] for r in rows], [r[1] for r in rows])


def _checked(threshold: float) -> None:
    if threshold < COVERAGE:
        raise ValueError(f"threshold must be at least {COVERAGE}: candidates are chosen for that")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, identity, item_id, coverage, n_tiles) of every document and item at or above the threshold."""
    _checked(threshold)
    source = identified(docs)
    items = _small(benchmark, broadcast_seeds)
    if items is None:
        return _contaminated_by_join(source, benchmark, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    own, item_type = id_type(docs), id_type(benchmark, "item_id")
    item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_judge_batch(batch, shared.value, threshold))
            if rows:
                at, item, coverage, n = zip(*rows, strict=True)
                names = pa.array([shared.value.ids[k] for k in item], item_kind)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in ("doc_id", KEY, HASH)], names, pa.array(coverage), pa.array(n, pa.int32())], ["doc_id", KEY, HASH, "item_id", "coverage", "n_tiles"])

    return source.mapInArrow(run, f"doc_id {own}, {KEY} long, {HASH} long, item_id {item_type}, coverage double, n_tiles int").distinct()


#: Groups of the Bloom filter's bits, and bits of each: 16 MB in all, whatever the test set's size.
BLOOM_GROUPS, BLOOM_BITS = 2048, 1 << 16


def _bloom(seeds: DataFrame) -> np.ndarray:
    """Two bits a seed, as groups x bytes: put together by group on the executors, of a size that is a parameter."""

    def bits(table: pa.Table) -> pa.Table:
        h = table.column("seed").to_numpy().view(U64)
        out = np.zeros(BLOOM_BITS, bool)
        for k in (16, 32):
            out[((h >> U64(k)) & U64(BLOOM_BITS - 1)).astype(np.int64)] = True
        return pa.table({"g": pa.array([int(h[0] % U64(BLOOM_GROUPS))], pa.int32()), "b": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    group = F.expr(f"int(pmod(seed, {BLOOM_GROUPS}))")  # a power of two: as for the unsigned value
    filled = np.zeros((BLOOM_GROUPS, BLOOM_BITS // 8), np.uint8)
    for r in seeds.select("seed").distinct().groupBy(group).applyInArrow(bits, "g int, b binary").collect():
        filled[r["g"]] = np.frombuffer(r["b"], np.uint8)
    return filled


def _may_hold(bloom: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which of the seeds may be in the filter."""
    h = w.view(U64)
    g, ok = (h % U64(BLOOM_GROUPS)).astype(np.int64), np.ones(len(h), bool)
    for k in (16, 32):
        bit = ((h >> U64(k)) & U64(BLOOM_BITS - 1)).astype(np.int64)
        ok &= (bloom[g, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
    return ok


def _contaminated_by_join(source: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """The same for a test set of any size: seeds of both sides meet in a shuffled join, pairs with enough seeds fetch both texts."""
    items = benchmark.select("item_id", "text").distinct().select(F.xxhash64(F.col("item_id").isNull(), F.col("item_id").cast("string"), F.col("text").isNull(), "text").alias("item"), "item_id", F.col("text").alias("item_text"))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("item_text"))
            for i, j, t in tokens_of(data, offs, fold=True):
                for d in range(j - i):
                    h = t.hash[t.first[d] : t.first[d + 1]]
                    if len(h) >= MIN_ITEM:
                        width = min(SEED, len(h))
                        w, times = np.unique(signed(window_hashes(h, width)), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(w), batch.column("item").take(pa.array(np.full(len(w), i + d))), pa.array(np.full(len(w), len(h), np.int32)), pa.array(np.full(len(w), width, np.int32)), pa.array(times.astype(np.int32))], ["seed", "item", "n", "width", "times"])

    item_seeds = checkpoint(items.select("item", "item_text").mapInArrow(of_items, "seed long, item long, n int, width int, times int"))
    widths = sorted(r[0] for r in item_seeds.select("width").distinct().collect())
    bloom = source.sparkSession.sparkContext.broadcast(_bloom(item_seeds))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, _, t in tokens_of(data, offs, fold=True):
                for width in widths:
                    w = signed(window_hashes(t.hash, width))
                    at = np.flatnonzero((t.doc[: len(w)] == t.doc[width - 1 :]) & _may_hold(bloom.value, w)) if len(w) else np.zeros(0, np.int64)
                    if len(at):
                        pair = np.unique(np.stack([t.doc[at], w[at]], axis=1), axis=0)
                        row = pa.array(pair[:, 0] + i)
                        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1]), batch.column(KEY).take(row), batch.column(HASH).take(row)], ["seed", KEY, HASH])

    doc_seeds = source.mapInArrow(of_docs, f"seed long, {KEY} long, {HASH} long")
    met = doc_seeds.join(item_seeds, "seed").groupBy(KEY, HASH, "item", "seed").agg(F.first("times").alias("times"), F.first("n").alias("n"))
    pairs = met.groupBy(KEY, HASH, "item").agg(F.sum("times").alias("m"), F.first("n").alias("n")).where(F.col("m") >= F.col("n") * COVERAGE / SEED)
    both = pairs.select(KEY, HASH, "item").join(source.dropDuplicates([KEY, HASH]), [KEY, HASH]).join(items, "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, facts = [], []
            for k in range(len(batch)):
                items = Items([0], [batch.column("item_text")[k].as_py()])
                h = token_hashes(batch.column("text")[k].as_py())
                for _, coverage, n in _judge(h, items.hits(h, np.zeros(len(h), np.int64))[1], items, threshold):
                    keep.append(k)
                    facts.append((coverage, n))
            if keep:
                rows = batch.select(["doc_id", KEY, HASH, "item_id"]).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([f[0] for f in facts]), pa.array([f[1] for f in facts], pa.int32())], [*rows.schema.names, "coverage", "n_tiles"])

    out = both.select("doc_id", KEY, HASH, "item_id", "text", "item_text")
    return out.mapInArrow(run, f"doc_id {id_type(out)}, {KEY} long, {HASH} long, item_id {id_type(out, 'item_id')}, coverage double, n_tiles int")


def contamination_report(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) of every contaminated document."""
    return contaminated(docs, benchmark, threshold, broadcast_seeds).select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``docs`` without the contaminated documents. With a test set that may be broadcast nothing is shuffled."""
    _checked(threshold)
    items = _small(benchmark, broadcast_seeds)
    if items is None:
        bad = checkpoint(contaminated(docs, benchmark, threshold, broadcast_seeds).select(KEY, HASH).distinct())
        return marked(docs).join(small(bad), [KEY, HASH], "left_anti").select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for row, *_ in _judge_batch(batch, shared.value, threshold):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
