"""Substring dedup by recompression.

Every text becomes a sequence of word hashes. In rounds, runs of one symbol and then neighbouring pairs are replaced by
new symbols. A new symbol's name is a 64-bit function of what it replaces and of the round, and which side of a pair a
symbol may take in a round is a bit of its name; so all partitions name equal runs and pairs alike, without exchanging a
dictionary. Equal substrings therefore get equal symbols but for a few at their ends. Rounds come in phases: in a phase only
symbols of fewer words than its level merge, and it ends when no two neighbours can. The first level gives ``SEED_WORDS``-word seeds,
the levels after it (``LEVELS`` and the whole text) give high-level symbols that cover long repeats by one name each.

1. ``symbols``: seeds and high-level symbols of every document are counted by name. A high-level name comes with a second hash of all the
   words it stands for, so that a shared one is a verified repeat of 128 bits: all its occurrences are repeated spans, all but the first are later copies.
2. What high-level symbols leave open is decided by windows of ``min_words`` words around shared seeds, under two Karp-Rabin hashes
   of their words (95 bits). They are looked at only where a seed is shared along with half of the words that a window lacks.
   Windows within a later copy of a high-level symbol need none: the first copy stands for them.
   Windows that occur at two or more places are repeats: no seed decides alone.
3. The union of a document's repeated windows and symbols is its repeated spans. The union of the later occurrences is what dedup cuts. First is
   the least by document id, then by position.

A later occurrence that overlaps the first one in the same document cuts only the words beyond that first one, so ``a a a ...`` keeps its first
``min_words`` words: one copy of every passage stays.

A passage may occur in a third of all documents: counts and firsts of symbols are sums by key with map-side combining and joins, which adaptive
execution splits when skewed; so are those of windows with a seed of ``HOT`` places. Other windows have fewer places than that, and meet in a window function.

Nulls and edge cases: a null or empty text has no spans. Rows equal in id and text are one document and don't repeat each
other, and all of them are cut alike; a null doc_id is an id of its own, before all others; ids may be of any sortable type. A passage that repeats within one document
counts too. Ties in id are broken by the identity's hash. Very long texts are handled whole. An empty table gives no spans. Extra columns are kept
by ``drop_repeated_passages``, whatever their names, and else ignored. Words are split at ASCII white space; case and punctuation count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as counting

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HASH, KEY, checkpoint, free_name, id_type, identified, identity, small
from .textops import U64, Ranges, Tokens, combine, mix, second, signed, text_buffers, tokens_of

MIN_WORDS = 50
SEED_WORDS = 8
#: A seed with so many places is hot: windows that hold one are summed up by key before they are compared, instead of one task holding all.
HOT = 100_000
#: Words of a high-level symbol at least, by phase; the last phase leaves one symbol for the whole text.
LEVELS = (128, 1024, 8192, 1 << 40)


def recompress(h: np.ndarray, doc: np.ndarray, frozen: int = SEED_WORDS, length: np.ndarray | None = None, start: np.ndarray | None = None, phase: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after a phase over all documents of a chunk: (name, words covered, first word, document). Symbols of ``frozen`` words merge no further."""
    sym = h.copy()
    length = np.ones(len(h), np.int64) if length is None else length.copy()
    start = np.arange(len(h)) if start is None else start
    for r in counting(phase << 20):
        same_doc = doc[1:] == doc[:-1]
        if not (same_doc & (length[1:] < frozen) & (length[:-1] < frozen)).any():
            break
        equal = (sym[1:] == sym[:-1]) & same_doc & (length[1:] < frozen)
        if equal.any():  # runs: blocks of equal symbols from the start of the run, of at most `frozen` words or two symbols
            index = np.arange(len(sym))
            first = np.concatenate([[True], ~equal])
            nth = index - np.maximum.accumulate(np.where(first, index, 0))
            head = np.flatnonzero(nth % np.maximum(2, frozen // length) == 0)
            count = np.diff(np.append(head, len(sym)))
            name = sym[head]
            runs = count > 1
            name[runs] = combine(name[runs], count[runs].astype(U64), 2 * r + 1)
            sym, length, start, doc = name, np.add.reduceat(length, head), start[head], doc[head]
            same_doc = doc[1:] == doc[:-1]
        side = (mix(sym + U64(7919 * r + 1)) & U64(1)).astype(bool)
        free = length < frozen
        i = np.flatnonzero(~side[:-1] & side[1:] & same_doc & free[:-1] & free[1:])
        sym = sym.copy()
        sym[i] = combine(sym[i], sym[i + 1], 2 * r)
        length[i] += length[i + 1]
        keep = np.ones(len(sym), bool)
        keep[i + 1] = False
        sym, length, start, doc = sym[keep], length[keep], start[keep], doc[keep]
    return sym, length, start, doc


def hierarchy(h: np.ndarray, doc: np.ndarray, min_words: int = MIN_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, words, first word): first of the seeds, then of all high-level symbols of ``min_words`` words or more, level by level."""
    sym, length, start, owner = recompress(h, doc)
    high = length >= SEED_WORDS
    yield sym[high], length[high], start[high]
    known = np.zeros(len(h), np.int64)  # by first word: the length of the symbol last given out
    for phase, level in enumerate(LEVELS, 1):
        sym, length, start, owner = recompress(sym, owner, level, length, start, phase)
        high = (length >= max(min_words, level if phase < len(LEVELS) else 0)) & (known[start] != length)
        known[start[high]] = length[high]
        yield sym[high], length[high], start[high]


def _lists(values: np.ndarray, doc: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """One list a document of values that are in the documents' order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _symbols(min_words: int):
    """Maps texts to their seeds (names, places) and high-level symbols (names, checks, sizes, places), as lists: one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, j, t in tokens_of(data, offs):
                n = j - i
                levels = hierarchy(t.hash, t.doc, min_words)
                sym, _, start = next(levels)
                d = t.doc[start]
                out = [_lists(signed(sym), d, n, pa.int64()), _lists(start - t.first[d], d, n, pa.int32())]
                name, size, start = (np.concatenate(x) for x in zip(*levels, strict=True))
                check = Ranges(second(t.hash)).hash(start, start + size)
                order = np.argsort(start, kind="stable")
                name, size, start, check = name[order], size[order], start[order], check[order]
                d = t.doc[start]
                out += [_lists(signed(name), d, n, pa.int64()), _lists(signed(check), d, n, pa.int64()), _lists(size, d, n, pa.int32()), _lists(start - t.first[d], d, n, pa.int32())]
                part = batch.slice(i, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column(KEY), part.column(HASH), *out], ["doc_id", KEY, HASH, "seed", "seed_at", "name", "check", "size", "at"])

    return run


def _windows_in(n: int, parts: np.ndarray, part_words: int, later: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows, of a text of n words, that hold one of the parts (given by their starts) and lie within no range of ``later``."""
    if n < width or not len(parts):
        return np.zeros(0, np.int64)
    lo, hi = np.maximum(parts + part_words - width, 0), np.minimum(parts, n - width)
    step, inner = np.zeros(n + 2, np.int64), np.zeros(n + 2, np.int64)
    ok = lo <= hi
    np.add.at(step, lo[ok], 1)
    np.add.at(step, hi[ok] + 1, -1)
    np.add.at(inner, later[:, 0], 1)
    np.add.at(inner, later[:, 1] - width + 1, -1)
    return np.flatnonzero((np.cumsum(step) > 0) & (np.cumsum(inner) == 0))


def _union(ranges: np.ndarray) -> list[dict[str, int]]:
    """The union of word ranges [from, to), given as rows (from, to); ranges that touch become one."""
    if not len(ranges):
        return []
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    head = np.flatnonzero(np.concatenate([[True], r[1:, 0] > reach[:-1]]))
    return [{"from": int(a), "to": int(b)} for a, b in zip(r[head, 0], reach[np.append(head[1:], len(r)) - 1], strict=True)]


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, first row of the chunk, row within it, tokens with their hashes, and the arrays at, size, later, hot of what is known of the text) of each text."""
    for batch in batches:
        data, offs = _unpacked(batch.column("text"))
        column = batch.column("known")
        bound, flat = column.offsets.to_numpy(), column.values
        at, size, later, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        at, size = at.astype(np.int64), size.astype(np.int64)
        for i, j, t in tokens_of(data, offs):
            chunk = _Hashed(t)
            for d in range(j - i):
                own = slice(bound[i + d], bound[i + d + 1])
                yield batch, i, d, chunk, at[own], size[own], later[own], hot[own]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for a smaller shuffle."""
    pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
    for batch in batches:
        texts = [pack(x or b"") for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a column of compressed texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [unpack(x) for x in column.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])


class _Hashed:
    def __init__(self, t: Tokens) -> None:
        self.first, self.words, self.others = t.first, Ranges(t.hash), Ranges(second(t.hash))


def _rows(batch: pa.RecordBatch, row: int, columns: dict[str, np.ndarray], keep: list[str]) -> pa.RecordBatch:
    """A batch of ``columns`` with a row's values of the columns to keep."""
    n = len(next(iter(columns.values())))
    same = [batch.column(k).take(pa.array(np.full(n, row))) for k in keep]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), *same], [*columns, *keep])


def _joined(make):
    """``make``'s small batches put together, about 2^16 rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for part in make(batches):
            kept.append(part)
            n += len(part)
            if n >= 1 << 16:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept, n = [], 0
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, identity, repeated, cut) of every document that shares ``min_words`` consecutive words: word ranges [from, to)."""
    kind = id_type(docs)
    source = identified(docs)
    lists = "seed array<long>, seed_at array<int>, name array<long>, check array<long>, size array<int>, at array<int>"
    symbols = checkpoint(source.mapInArrow(_symbols(min_words), f"doc_id {kind}, {KEY} long, {HASH} long, {lists}").where("size(seed) > 0"))
    place = F.xxhash64(KEY, HASH, "at")
    several = F.min("place") < F.max("place")  # repeated rows are one place

    # Seeds that occur twice.
    seeds = symbols.select(KEY, HASH, F.inline(F.arrays_zip("seed", F.col("seed_at").alias("at"))))
    shared = checkpoint(seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").withColumn("hot", F.col("n") >= hot))
    any_hot = bool(shared.where("hot").limit(1).count())
    seeds = seeds.join(shared, "seed").select(KEY, HASH, "at", F.lit(0).alias("size"), F.lit(False).alias("later"), "hot")

    # High-level symbols that occur twice, and which of their occurrences is the first.
    names = ["name", "check", "size"]
    order = F.struct("doc_id", KEY, HASH, "at")
    high = symbols.select("doc_id", KEY, HASH, F.inline(F.arrays_zip(*names, "at")))
    firsts = high.withColumn("place", place).groupBy(*names).agg(F.min(order).alias("first"), several.alias("several")).where("several").drop("several")
    high = high.join(firsts, names).select("doc_id", KEY, HASH, "at", "size", (order != F.col("first")).alias("later"))
    known = seeds.union(high.drop("doc_id").withColumn("hot", F.lit(False))).groupBy(KEY, HASH).agg(F.collect_list(F.struct("at", "size", "later", "hot")).alias("known"))
    packed = source.where("text is not null").mapInArrow(_packed, f"doc_id {kind}, text binary, {KEY} long, {HASH} long")
    texts = packed.join(known, [KEY, HASH]).select("doc_id", KEY, HASH, "text", "known")

    # Of the words beside a shared seed, a window of ``min_words`` around it holds half or more of those that it lacks on one side:
    # only where such a part occurs twice too, windows are looked at.
    half = -(-(min_words - SEED_WORDS) // 2)
    part_words = SEED_WORDS + half

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, d, t, at, size, _, is_hot in _known(batches):
            seed = np.concatenate([at[size == 0], at[size == 0] - half])
            start, which = np.unique(seed, return_inverse=True)
            heat = np.bincount(which, np.tile(is_hot[size == 0], 2), len(start)) > 0
            ok = (start >= 0) & (start + part_words <= t.first[d + 1] - t.first[d])
            start, heat = start[ok], heat[ok]
            if len(start):
                a = start + t.first[d]
                yield _rows(batch, i + d, {"part": signed(t.words.hash(a, a + part_words)), "at": start.astype(np.int32), "hot": heat}, [KEY, HASH])

    part = texts.mapInArrow(_joined(parts), f"part long, at int, hot boolean, {KEY} long, {HASH} long")
    rows = (part.where("not hot") if any_hot else part).select("part", KEY, HASH, "at")
    if any_hot:
        rows = rows.withColumn("n", F.lit(1)).union(part.where("hot").groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit(None), F.lit(None), F.lit(None), "n"))
    rows = rows.withColumn("total", F.sum("n" if any_hot else F.lit(1)).over(Window.partitionBy("part"))).where("total > 1")
    twice = rows.where("at is not null").select(KEY, HASH, "at")
    if any_hot:
        twice = twice.union(part.where("hot").join(rows.where("at is null").select("part"), "part").select(KEY, HASH, "at"))
    twice = twice.groupBy(KEY, HASH).agg(F.collect_list("at").alias("parts"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, d, t, at, size, later, is_hot in _known(batches):
            copies = np.stack([at[later], at[later] + size[later]], axis=1)
            n = int(t.first[d + 1] - t.first[d])
            start = _windows_in(n, batch.column("parts")[i + d].values.to_numpy().astype(np.int64), part_words, copies, min_words)
            if len(start):
                a = start + t.first[d]
                heat = np.append(np.sort(at[is_hot]), 1 << 60)
                columns = {"window": signed(t.words.hash(a, a + min_words)), "check": (t.others.hash(a, a + min_words) >> U64(33)).astype(np.int32), "place": (batch.column(HASH)[i + d].as_py() << 32) | start, "hot": heat[np.searchsorted(heat, start)] + SEED_WORDS <= start + min_words}
                yield _rows(batch, i + d, columns, ["doc_id", KEY])

    # The shuffled texts and lists are reused; tokens are worked out again rather than stored.
    window = texts.join(twice, [KEY, HASH]).mapInArrow(_joined(windows), f"window long, check int, place long, hot boolean, doc_id {kind}, {KEY} long")
    by, whole = ["window", "check"], ["doc_id", KEY, "place"]
    rows = (window.where("not hot") if any_hot else window).select(*by, *whole)
    kind_of = F.lit(0)
    if any_hot:
        # Every place of a window that occurs very often holds a seed that does: those are summed up by key before they meet the others.
        sums = window.where("hot").withColumn("one", F.xxhash64(KEY, "place")).groupBy(*by).agg(F.min(F.struct(*whole)).alias("f"), (F.min("one") < F.max("one")).alias("several"))
        rows = rows.withColumn("kind", F.lit(0)).union(sums.select(*by, "f.*", F.when(F.col("several"), 2).otherwise(1)))
        kind_of = F.col("kind")
    alike = Window.partitionBy(*by)
    ordered = alike.orderBy(*whole)  # equal rows, of a repeated document, share a rank
    first = [f"first_{KEY}", "first_place"]
    rows = rows.select("*", F.rank().over(ordered).alias("rank"), *[F.first(c).over(ordered).alias(f) for c, f in zip(whole[1:], first, strict=True)])
    rows = rows.withColumn("most", F.max(F.greatest("rank", kind_of)).over(alike)).where("most > 1")
    found = rows.where(kind_of == 0).select(*whole, *first)
    if any_hot:
        found = found.union(window.where("hot").join(rows.where(kind_of > 0).select(*by, *first), by).select(*whole, *first))
    own = (F.col(first[0]) == F.col(KEY)) & (F.shiftright(first[1], 32) == F.shiftright("place", 32))
    at, first_at = (F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") for c in ("place", first[1]))
    begin = F.when(own, F.greatest(at, first_at + min_words)).otherwise(at)
    found = found.select("doc_id", KEY, F.shiftright("place", 32).alias(HASH), at.alias("at"), F.lit(min_words).alias("size"), F.when(~(own & (at == first_at)), begin).alias("cut"))
    symbol = high.select("doc_id", KEY, HASH, "at", "size", F.when(F.col("later"), F.col("at")).alias("cut"))
    spans = found.union(symbol).groupBy("doc_id", KEY, HASH).agg(F.collect_list(F.struct("at", "size", "cut")).alias("found"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch in batches:
            column = batch.column("found")
            bound, flat = column.offsets.to_numpy(), column.values
            at, end = flat.field(0).to_numpy().astype(np.int64), flat.field(0).to_numpy().astype(np.int64) + flat.field(1).to_numpy()
            cut = flat.field(2).fill_null(-1).to_numpy().astype(np.int64)
            repeated, cuts = [], []
            for a, b in zip(bound[:-1], bound[1:], strict=True):
                repeated.append(_union(np.stack([at[a:b], end[a:b]], axis=1)))
                late = np.flatnonzero(cut[a:b] >= 0) + a
                cuts.append(_union(np.stack([cut[late], end[late]], axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(KEY), batch.column(HASH), pa.array(repeated, kinds), pa.array(cuts, kinds)], ["doc_id", KEY, HASH, "repeated", "cut"])

    span = "array<struct<from: int, to: int>>"
    return spans.mapInArrow(unite, f"doc_id {kind}, {KEY} long, {HASH} long, repeated {span}, cut {span}")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, kind, from_word, to_word): a row for each span ``repeated`` of a document and each span ``cut``, which leaves the first occurrence out."""


    def rows(kind: str) -> F.Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["from"].alias("from_word"), s["to"].alias("to_word")))

    return repeated_spans(docs, min_words).select("doc_id", F.inline(F.concat(rows("repeated"), rows("cut"))))


def drop_repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the later occurrences of repeated passages.

    ``n_chars``, where it exists, is counted anew for the documents that changed. A document of which no word is left
    is dropped; one without a word from the start stays. Columns and untouched texts stay as they were.
    """
    cuts = checkpoint(repeated_spans(docs, min_words).where(F.size("cut") > 0).select(KEY, HASH, "cut"))
    name, key, second_key = (free_name(docs, k) for k in ("cut", KEY, HASH))
    rows = docs.select("*", identity()[KEY].alias(key), identity()[HASH].alias(second_key))
    rows = rows.join(small(cuts.toDF(key, second_key, name)), [key, second_key], "left").select(*[f"`{c}`" for c in docs.columns], f"`{name}`")
    place = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, columns = batch.column(name), list(batch.columns)
            texts = batch.column(place).to_pylist() if spans.null_count < len(batch) else []
            keep = np.ones(len(batch), bool)
            for i in np.flatnonzero(~np.asarray(spans.is_null())):
                data, offs = text_buffers(pa.array([texts[i]], pa.large_string()))
                t = next(tokens_of(data, offs, size=len(data) + 1))[2]
                raw, at, left = data.tobytes(), 0, []
                for s in spans[int(i)].as_py():
                    left.append(raw[at : t.start[s["from"]]])
                    at = t.start[s["to"]] if s["to"] < len(t.start) else len(raw)
                left.append(raw[at:])
                texts[i] = b"".join(left).decode()
                keep[i] = bool(texts[i].strip())
            if texts:
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep))

    out = rows.mapInArrow(cut, rows.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"`{name}`").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


_WORDS = r"list_filter(string_split_regex(text, '[\t\n\x0b\f\r ]+'), lambda w: w <> '')"


def sql(min_words: int = MIN_WORDS) -> str:
    """``repeated_passages`` by its definition: every window of every text, grouped by its words."""

    def union(kind: str, begin: str, source: str) -> str:
        """Ranges to islands: a range that begins after all earlier ones have ended starts a new one."""
        heads = f"SELECT doc_id, text, {begin} AS a, p + {min_words} AS b FROM {source}"
        new = f"SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY doc_id, text ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM ({heads})"
        islands = f"SELECT *, sum(new) OVER (PARTITION BY doc_id, text ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM ({new})"
        return f"SELECT doc_id, '{kind}' AS kind, min(a)::INT AS from_word, max(b)::INT AS to_word FROM ({islands}) GROUP BY doc_id, text, island"

    return f"""
WITH docs AS MATERIALIZED (SELECT DISTINCT doc_id, text FROM documents),
words AS MATERIALIZED (SELECT doc_id, text, {_WORDS} AS w FROM docs),
windows AS (SELECT doc_id, text, p, md5(array_to_string(w[p + 1 : p + {min_words}], ' ')) AS h FROM (SELECT *, unnest(range(0, len(w) - {min_words} + 1)) AS p FROM words)),
ranked AS MATERIALIZED (SELECT doc_id, text, p, count(*) OVER (PARTITION BY h) AS n,
  first_value(struct_pack(doc_id := doc_id, text := text, p := p)) OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, text, p) AS f FROM windows)
{union('repeated', 'p', 'ranked WHERE n > 1')}
UNION ALL
{union('cut', 'CASE WHEN f.doc_id IS NOT DISTINCT FROM doc_id AND f.text = text THEN greatest(p, f.p + ' + str(min_words) + ') ELSE p END', 'ranked WHERE n > 1 AND NOT (f.doc_id IS NOT DISTINCT FROM doc_id AND f.text = text AND f.p = p)')}
"""
