"""Best-fit packing of documents into sequences of ``CAPACITY`` tokens, by the linear grouping scheme.

Lengths are token counts under a public vocabulary (``trie_unigram``). The plan is made on the histogram of lengths, which has at most ``CAPACITY``
entries however many documents there are; documents are then matched to it by (length, rank), so nothing but the histogram and the plan reaches the driver.

1. A document longer than a sequence is cut before a word (or, within a word of more tokens than a sequence, after a token) into pieces that fill a sequence
   as far as they can, and a rest. Pieces are slices of the text that leave nothing out: put together again they are the document, byte by byte.
2. Pieces above ``SMALL`` x capacity are large. Sorted by length they are cut into ``GROUPS`` groups of equal cardinality (or twice or four times as many, whichever
   plan needs the fewest sequences), and all lengths of a group are rounded up to its greatest.
3. Packing the few rounded sizes is a configuration problem: configurations (how many of each size fit in a sequence) are
   generated by column generation on its linear relaxation (multiplicative weights price the sizes, a knapsack finds the best
   configuration); the rounded-down solution is kept and what is left over is packed by first-fit over configurations.
4. The actual pieces take the places of their group's rounded size, which they can't exceed.
5. Small pieces, longest first, go to the fullest sequence that still holds them (best fit); a new sequence is opened only when
   none does.

Sequences with the same content by length are handled as one run, so every step works on counts. The texts are shuffled twice: to meet
their places, and to their sequences, which hold a bounded number of tokens.

Nulls and edge cases: a null or wordless text has no pieces and is in no sequence; rows equal in id and text are separate
documents here (each is packed); a null doc_id stays null and ids may be of any type. Which of several pieces of one length takes which place is decided by hash. Very long texts are cut, never shortened.
Extra columns are ignored, whatever their names. An empty table gives no sequences.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HASH, KEY, checkpoint, id_type, identified
from .textops import text_buffers
from .trie_unigram import Vocabulary, counted, load_vocabulary, token_ends

CAPACITY, SMALL, GROUPS = 2048, 0.125, 24
#: Salts at least, and rows of a window about.
SALTS, WINDOW_ROWS = 64, 1 << 20

Run = tuple[int, int]  # first sequence, number of sequences


def groups_of(counts: dict[int, int], groups: int) -> list[tuple[int, int, list[Run]]]:
    """Equal-cardinality groups of the lengths, longest first: (rounded size, pieces, [(length, pieces)...])."""
    total = sum(counts.values())
    if not total:
        return []
    out: list[tuple[int, int, list[Run]]] = []
    per, parts, filled = -(-total // groups), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            n = min(left, per - filled)
            parts.append((length, n))
            filled, left = filled + n, left - n
            if filled == per:
                out.append((parts[0][0], filled, parts))
                parts, filled = [], 0
    if parts:
        out.append((parts[0][0], filled, parts))
    merged: list[tuple[int, int, list[Run]]] = []
    for size, n, p in out:  # groups that round to one size are one size
        if merged and merged[-1][0] == size:
            merged[-1] = (size, merged[-1][1] + n, merged[-1][2] + p)
        else:
            merged.append((size, n, p))
    return merged


def best_configuration(sizes: list[int], value: np.ndarray, limit: list[int], capacity: int) -> list[int]:
    """The configuration of greatest value, with at most ``limit`` pieces of each size (sizes over capacity/8: at most 8 pieces)."""
    best = np.zeros(capacity + 1)
    choice = np.full((len(sizes), capacity + 1), 0, np.int16)
    for i, size in enumerate(sizes):
        new = best.copy()
        for k in range(1, min(limit[i], capacity // size) + 1):
            cand = np.full(capacity + 1, -1.0)
            cand[k * size :] = best[: capacity + 1 - k * size] + k * value[i]
            better = cand > new + 1e-12
            new[better] = cand[better]
            choice[i][better] = k
        best = new
    room, out = capacity, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = int(choice[i][room])
        room -= out[i] * sizes[i]
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 60) -> list[tuple[tuple[int, ...], int]]:
    """How many sequences to make of which configuration, so that every size's demand is met exactly."""
    left = np.array(demand, float)
    price = np.array(sizes, float) / capacity
    pool: dict[tuple[int, ...], int] = {}
    # Column generation: prices follow how badly each size is covered; each round adds the best configuration found.
    weight = np.zeros(len(pool))
    columns: list[tuple[int, ...]] = []
    cover = np.zeros(len(sizes))
    for _ in range(rounds):
        c = tuple(best_configuration(sizes, price, demand, capacity))
        if c not in columns:
            columns.append(c)
            weight = np.append(weight, 0.0)
        k = columns.index(c)
        step = min(left[i] / c[i] for i in range(len(sizes)) if c[i]) / 8
        weight[k] += step
        cover += step * np.array(c)
        lack = np.maximum(cover / left, 0)
        price = np.array(sizes, float) / capacity * np.exp(-2 * (lack - lack.mean()))
    scale = min(1.0, 1 / max((cover / left).max(), 1e-9))
    need = np.array(demand)
    for k, c in enumerate(columns):
        n = int(weight[k] * scale)
        if n:
            pool[c] = pool.get(c, 0) + n
            need -= n * np.array(c)
    # What rounding down left over: repeat the fullest configuration that the remaining demand allows.
    while need.any():
        c = tuple(best_configuration(sizes, np.array(sizes, float), [int(x) for x in need], capacity))
        n = int(min(need[i] // c[i] for i in range(len(sizes)) if c[i]))
        pool[c] = pool.get(c, 0) + n
        need -= n * np.array(c)
    return sorted(pool.items(), reverse=True)


class Packing:
    """The plan: ``rows`` of (length, first rank, last rank + 1, first sequence, pieces a sequence); rank r of a length goes to first sequence + (r - first rank) // pieces."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS) -> None:
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self._rank: dict[int, int] = defaultdict(int)
        self._gaps: dict[int, list[Run]] = defaultdict(list)
        self._sizes: list[int] = []
        full = counts.get(capacity, 0)
        if full:
            self._place(capacity, full, self._open(full))
        large = {k: n for k, n in counts.items() if small * capacity < k < capacity and n}
        self._large(groups_of(large, groups))
        for length in sorted((k for k, n in counts.items() if 0 < k <= small * capacity and n), reverse=True):
            self._best_fit(length, counts[length])

    def _open(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def _place(self, length: int, n: int, first: int, per: int = 1) -> None:
        self.rows.append((length, self._rank[length], self._rank[length] + n, first, per))
        self._rank[length] += n

    def _gap(self, gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if not self._gaps[gap]:
            bisect.insort(self._sizes, gap)
        self._gaps[gap].append((first, n))

    def _large(self, groups: list[tuple[int, int, list[Run]]]) -> None:
        if not groups:
            return
        sizes = [g[0] for g in groups]
        supply = [list(reversed(g[2])) for g in groups]
        for config, n in configurations(sizes, [g[1] for g in groups], self.capacity):
            runs = [(self._open(n), n, self.capacity)]
            for i, k in enumerate(config):
                for _ in range(k):  # one place of size i in each of these sequences
                    parted = []
                    for first, m, gap in runs:
                        while m:
                            length, have = supply[i].pop()
                            take = min(m, have)
                            if have > take:
                                supply[i].append((length, have - take))
                            self._place(length, take, first)
                            parted.append((first, take, gap - length))
                            first, m = first + take, m - take
                    runs = parted
            for first, m, gap in runs:
                self._gap(gap, first, m)

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            at = bisect.bisect_left(self._sizes, length)
            if at == len(self._sizes):
                per = self.capacity // length  # new sequences are filled with this length as far as it goes
                bins = -(-n // per)
                self._gap(self.capacity, self._open(bins), bins)
                continue
            gap = self._sizes[at]
            first, m = self._gaps[gap].pop()
            if not self._gaps[gap]:
                self._sizes.pop(at)
            per = gap // length  # after its first piece a sequence is the fullest one: it is filled before the next of the run
            take = min(n, m * per)
            self._place(length, take, first, per)
            full, rest = divmod(take, per)
            self._gap(gap - per * length, first, full)
            if rest:
                self._gap(gap - rest * length, first + full, 1)
            self._gap(gap, first + full + (rest > 0), m - full - (rest > 0))
            n -= take


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS) -> Packing:
    """The plan of fewest sequences among those with ``groups`` groups, twice and four times as many: finer groups round less, but leave more remainders."""
    return min((Packing(counts, capacity, small, groups * k) for k in (1, 2, 4)), key=lambda p: p.sequences)


def cuts(counts: np.ndarray, ends: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(end in bytes, tokens) of the pieces of a text given as units of at most ``capacity`` tokens, with the byte that each ends before."""
    total = np.concatenate([[0], np.cumsum(counts)])
    out, at = [], 0
    while at < len(counts):
        to = int(np.searchsorted(total, total[at] + capacity, "right")) - 1
        out.append((int(ends[to - 1]), int(total[to] - total[at])))
        at = to
    return out


def _units(raw: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray, capacity: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """A long text's units: words with the space after them; of words of more tokens than a sequence, runs of tokens that end with a character."""
    ends = np.append(start[1:], len(raw))
    parts_n, parts_end, done = [], [], 0
    for k in np.flatnonzero(counts > capacity).tolist():
        parts_n.append(counts[done:k])
        parts_end.append(ends[done:k])
        word = raw[start[k] : end[k]]
        at = token_ends(word.tobytes(), vocabulary)
        whole = np.flatnonzero(np.append((word[at[:-1]] & 0xC0) != 0x80, True))  # the next byte begins a character
        parts_n.append(np.diff(np.concatenate([[-1], whole])))
        parts_end.append(np.append(at[whole[:-1]] + start[k], ends[k]))
        done = k + 1
    parts_n.append(counts[done:])
    parts_end.append(ends[done:])
    return np.concatenate(parts_n), np.concatenate(parts_end)


def pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY) -> DataFrame:
    """(identity, piece, from_byte, n_bytes, n_tokens) of each piece of each row that has a word."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, j, t, counts in counted(data, offs, shared.value):
                total = np.bincount(t.doc, weights=counts, minlength=j - i).astype(np.int64)
                fits = np.flatnonzero((total > 0) & (total <= capacity))
                rows = [np.stack([fits + i, 0 * fits, 0 * fits, np.diff(offs)[fits + i], total[fits]])]
                for d in np.flatnonzero(total > capacity):
                    part, base = slice(t.first[d], t.first[d + 1]), int(offs[i + d] - offs[i])
                    units = _units(data[offs[i + d] : offs[i + d + 1]], t.start[part] - base, t.end[part] - base, counts[part], capacity, shared.value)
                    at = 0
                    for k, (end, n) in enumerate(cuts(*units, capacity)):
                        rows.append(np.array([[i + d], [k], [at], [end - at], [n]]))
                        at = end
                r = np.concatenate(rows, axis=1)
                at = pa.array(r[0])
                yield pa.RecordBatch.from_arrays([batch.column(KEY).take(at), batch.column(HASH).take(at), *map(pa.array, r[1:])], [KEY, HASH, "piece", "from_byte", "n_bytes", "n_tokens"])

    return identified(docs).mapInArrow(run, f"{KEY} long, {HASH} long, piece long, from_byte long, n_bytes long, n_tokens long")


def placements(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """The pieces with the sequence that each goes to."""
    spark = docs.sparkSession
    p = checkpoint(pieces(docs, vocabulary, capacity))
    histogram = {r["n_tokens"]: r["n"] for r in p.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    plan = best_plan(histogram, capacity, small, groups)
    # The histogram has at most `capacity` rows, the plan is of its size: both are bounded by a parameter. Ranks within a length are cut by
    # salts, whose number grows with the data, and shifted by the salts before.
    salts = max(SALTS, -(-sum(histogram.values()) // window_rows))
    p = p.withColumn("salt", F.pmod(F.xxhash64(KEY, HASH, "piece"), F.lit(salts)))
    earlier = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = p.groupBy("n_tokens", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy("n_tokens", "salt").orderBy(KEY, HASH, "piece")
    ranked = p.join(shift, ["n_tokens", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    table = defaultdict(list)
    for length, *run in plan.rows:
        table[length].append(tuple(run))
    lookup = spark.createDataFrame([(k, sorted(v)) for k, v in table.items()] or [(0, [])], "n_tokens long, runs array<struct<a: long, b: long, first: long, per: long>>")
    hit = F.filter("runs", lambda x: (x["a"] <= F.col("rank")) & (F.col("rank") < x["b"]))[0]
    ranked = ranked.join(F.broadcast(lookup), "n_tokens").withColumn("run", hit)
    sequence = F.expr("run.first + (rank - run.a) div run.per")
    return ranked.select(KEY, HASH, "piece", "from_byte", "n_bytes", "n_tokens", sequence.alias("sequence"))


def pack(docs: DataFrame, vocabulary: Vocabulary | None = None, capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS) -> DataFrame:
    """(sequence, n_tokens, doc_ids, pieces): a row for each sequence; a piece has its document's id, its number within the document, tokens and text."""
    placed = checkpoint(placements(docs, vocabulary or load_vocabulary(), capacity, small, groups))
    by = [KEY, HASH]
    texts = identified(docs)
    if placed.where("piece = 0").groupBy(*by).count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(by)  # the places of all rows of a document are with its one text
    part = F.expr("cast(substring(cast(text as binary), cast(from_byte + 1 as int), cast(n_bytes as int)) as string)")
    met = texts.join(placed, by).select("sequence", F.struct("doc_id", "piece", "n_tokens", part.alias("text")).alias("p"))
    rows = met.groupBy("sequence").agg(F.sort_array(F.collect_list("p")).alias("pieces"))
    return rows.select("sequence", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, x: n + x["n_tokens"]).alias("n_tokens"), F.col("pieces.doc_id").alias("doc_ids"), "pieces")
