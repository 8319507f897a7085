"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a maximal run of bytes other than ASCII white space, with the mark U+2581 before it. Its best
segmentation maximises the sum of the pieces' scores. The distinct pre-tokens of a chunk of documents form a trie; the forward
score of a trie node (a prefix) depends on its ancestors only, so it is computed once for all pre-tokens that share the prefix,
depth by depth for all nodes of that depth at a time, and the number of tokens stored at a terminal node is that pre-token's count.
Counts are remembered within a worker, in sorted arrays, so later chunks only bring their new pre-tokens. Pre-tokens of more than ``LONG`` bytes, whose prefixes hardly
anything shares, take the same steps one by one along their own path.

The vocabulary comes from a public tokenizer file whose path is a parameter. Log probabilities in it are taken as they are; a file that
only ranks its pieces (whole numbers) gives a piece's score by Zipf's law, -log(rank + 2). A character that is no piece falls back to its bytes: one token each,
at a score below every piece's.

Chunks are independent, so nothing is shuffled: the counts of a document need only its own chunk's trie.

Nulls and edge cases: a null, empty or blank text has 0 pre-tokens and 0 tokens; every row is counted, repeated ones alike; a null doc_id
stays null and ids may be of any type; extra columns are ignored, whatever their names; an empty table gives no rows. Very long texts and pre-tokens are handled whole. Of segmentations with equal
sums (within 1e-9) the one with the longest last piece counts, and so on towards the front.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type
from .textops import _BYTE_VALUES, U64, Tokens, _powers, mix, text_buffers, tokens_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
CHUNK = 1 << 20
#: Bytes of a pre-token that goes through the trie, and pre-tokens whose counts a worker remembers.
LONG, MEMORY = 64, 1 << 20


class Vocabulary:
    """Pieces by hash, in arrays: of fixed size whatever the data, so it can be broadcast."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        table = {p.encode(): s for p, s in pieces if p}
        raw = list(table)
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(p) for p in raw], np.int64)
        end = np.cumsum(size)
        total = _prefix(buffer)
        _, down = _powers.upto(len(buffer) + 1)
        key = _name(total, down, end - size, end)
        order = np.argsort(key)
        self.key, self.score = key[order], np.array([table[p] for p in raw])[order]
        self.sizes = np.unique(size)
        self.fallback = float(self.score.min()) - 10 if len(self.score) else -10.0
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.key & U64(0xFFFFF)).astype(np.int64)] = True
        self.known, self.counts = np.zeros(0, U64), np.zeros(0, np.int32)  # remembered pre-tokens by hash, sorted

    def scores(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys are pieces, their scores)."""
        hit = np.flatnonzero(self.filter[(key & U64(0xFFFFF)).view(np.int64)])
        at = np.searchsorted(self.key, key[hit])
        at[at == len(self.key)] = 0
        ok = self.key[at] == key[hit] if len(self.key) else np.zeros(len(hit), bool)
        return hit[ok], self.score[at[ok]]

    def recalled(self, names: np.ndarray) -> np.ndarray:
        """Token counts of pre-tokens by hash, -1 for those that aren't remembered."""
        if not len(self.known):
            return np.full(len(names), -1, np.int64)
        at = np.searchsorted(self.known, names)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == names, self.counts[at], -1).astype(np.int64)

    def remember(self, names: np.ndarray, counts: np.ndarray) -> None:
        """Adds pre-tokens that aren't remembered yet, in the order of their hashes; if there would be too many, all earlier ones go."""
        if len(self.known) + len(names) > MEMORY:
            self.known, self.counts = names[:MEMORY], counts[:MEMORY].astype(np.int32)
            return
        at = np.searchsorted(self.known, names)
        self.known, self.counts = np.insert(self.known, at, names), np.insert(self.counts, at, counts)


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The normal pieces of a sentencepiece file, with their log probabilities, or scored by rank where it has none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(scored([(model.id_to_piece(i), model.get_score(i)) for i in ids]))


def scored(pieces: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Pieces with log probabilities: those given, or by Zipf's law if all are whole numbers, which are ranks."""
    if any(s != int(s) for _, s in pieces):
        return pieces
    return [(p, -float(np.log(r + 2))) for r, (p, _) in enumerate(pieces)]


def _prefix(buffer: np.ndarray) -> np.ndarray:
    up, _ = _powers.upto(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, U64)
    np.cumsum(_BYTE_VALUES[buffer] * up[: len(buffer)], out=total[1:])
    return total


def _name(total: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(U64))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, a place of each, which of them each key is)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def word_counts(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Number of tokens of each word (distinct, without the mark)."""
    size = np.array([len(w) for w in words], np.int64)
    return slice_counts(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, vocabulary)


def slice_counts(data: np.ndarray, start: np.ndarray, size: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Number of tokens of each word (distinct, without the mark) given as a slice of the data, through one trie."""
    n, mark = len(start), len(MARK)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(-size, kind="stable")  # the words of at least some length are a prefix of this order
    size, source = size[order] + mark, start[order] - mark
    start = np.cumsum(size) - size
    buffer = np.empty(int(size.sum()), np.uint8)
    marks = start[:, None] + np.arange(mark)
    if len(data):
        buffer[:] = data[np.maximum(np.arange(len(buffer)) + np.repeat(source - start, size), 0)]
    buffer[marks] = np.frombuffer(MARK, np.uint8)
    total = _prefix(buffer)
    _, down = _powers.upto(len(buffer) + 1)
    longest = int(vocabulary.sizes.max()) if len(vocabulary.sizes) else 1
    node_of = {0: np.zeros(n, np.int64)}
    best = {0: np.zeros(1)}
    count = {0: np.zeros(1, np.int64)}
    result = np.zeros(n, np.int64)
    alive = n
    for d in range(1, int(size[0]) + 1):
        while alive and size[alive - 1] < d:
            alive -= 1
        s = start[:alive]
        _, rep, node = distinct(_name(total, down, s, s + d))
        at = s[rep]
        upto = total[at + d]
        parent = node_of[d - 1][rep]
        lead = (buffer[at + d - 1] & 0xC0) != 0x80
        score = best[d - 1][parent] + np.where(lead, vocabulary.fallback, 0.0)
        tokens = count[d - 1][parent] + 1
        for length in vocabulary.sizes[::-1]:
            if length > d:
                continue
            begin = at + (d - length)
            hit, value = vocabulary.scores(mix((upto - total[begin]) * down[begin] + U64(length)))
            if not len(hit):
                continue
            ancestor = node_of[d - length][rep[hit]]
            value = value + best[d - length][ancestor]
            better = value > score[hit] + 1e-9
            which = hit[better]
            score[which] = value[better]
            tokens[which] = count[d - length][ancestor[better]] + 1
        node_of[d], best[d], count[d] = node, score, tokens
        done = np.flatnonzero(size[:alive] == d)
        result[done] = tokens[node[done]]
        for table in (node_of, best, count):
            table.pop(d - longest, None)
    out = np.empty(n, np.int64)
    out[order] = result
    return out


def segment(word: bytes, vocabulary: Vocabulary, block: int = 1 << 20) -> tuple[int, bytearray]:
    """(number of tokens, size of the last piece of each prefix's best segmentation) of one word with its mark before it."""
    raw = MARK + word
    n, sizes = len(raw), vocabulary.sizes[::-1]
    longest = int(sizes[0]) if len(sizes) else 1
    ring = 1 << max(4, longest.bit_length())  # the last scores and counts, by place modulo this
    best, count, last = [0.0] * ring, [0] * ring, bytearray(n + 1)
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        base = max(0, lo - longest)
        buffer = np.frombuffer(raw[base:hi], np.uint8)
        total, (_, down) = _prefix(buffer), _powers.upto(len(buffer) + 1)
        ends, lengths, values = [], [], []
        for size in sizes.tolist():
            start = np.arange(max(0, lo + 1 - size - base), len(buffer) - size + 1)  # pieces that end within the block
            hit, value = vocabulary.scores(_name(total, down, start, start + size)) if len(start) else (start, start)
            ends.append(start[hit] + size + base)
            lengths.append(np.full(len(hit), size))
            values.append(value)
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        order = np.argsort(end, kind="stable")  # keeps longer pieces first
        at = np.searchsorted(end[order], np.arange(lo + 1, hi + 2)).tolist()
        length, value = np.concatenate(lengths)[order].tolist() if ends else [], np.concatenate(values)[order].tolist() if ends else []
        for d in range(lo + 1, hi + 1):
            p = (d - 1) % ring
            score, tokens, back = best[p] + (vocabulary.fallback if raw[d - 1] & 0xC0 != 0x80 else 0.0), count[p] + 1, 1
            for k in range(at[d - lo - 1], at[d - lo]):
                q = (d - length[k]) % ring
                v = value[k] + best[q]
                if v > score + 1e-9:
                    score, tokens, back = v, count[q] + 1, length[k]
            q = d % ring
            best[q], count[q], last[d] = score, tokens, back
    return count[n % ring], last


def token_ends(word: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """Ends, in bytes of the word, of the tokens of its best segmentation."""
    _, last = segment(word, vocabulary)
    ends, d = [], len(last) - 1
    while d > 0:
        ends.append(d)
        d -= last[d]
    return np.maximum(np.array(ends[::-1], np.int64) - len(MARK), 0)


def counted(data: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple[int, int, Tokens, np.ndarray]]:
    """(from, to, pre-tokens, number of tokens of each) of each chunk of documents."""
    for i, j, t in tokens_of(data, offs, size=CHUNK):
        names, rep, which = distinct(t.hash)
        found = vocabulary.recalled(names)
        new = np.flatnonzero(found < 0)
        if len(new):
            start, size, chunk = t.start[rep[new]], (t.end - t.start)[rep[new]], data[offs[i] : offs[j]]
            short, fresh = size <= LONG, np.zeros(len(new), np.int64)
            fresh[short] = slice_counts(chunk, start[short], size[short], vocabulary)
            for k in np.flatnonzero(~short):
                fresh[k] = segment(chunk[start[k] : start[k] + size[k]].tobytes(), vocabulary)[0]
            found[new] = fresh
            vocabulary.remember(names[new], fresh)
        yield i, j, t, found[which]


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, j, t, count in counted(*text_buffers(batch.column("text")), shared.value):
                words[i:j] = np.diff(t.first)
                tokens[i:j] = np.bincount(t.doc, weights=count, minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, n_pretokens long, n_tokens long")
