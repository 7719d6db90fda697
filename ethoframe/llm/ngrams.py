"""Language-model scoring with an n-gram trie in Elias-Fano levels.

The model is a trigram model with absolute discounting, interpolated down to add-one unigrams, learnt from every training document:
    p(w | u v) = (c(uvw) - D) / c(uv.) + D * types(uv.) / c(uv.) * p(w | v),   p(w | v) likewise,   p(w) = (c(w) + 1) / (N + V + 1).
Tokens are words between ASCII white space, A-Z in lower case, then one end, which is the context of the next text's first word too.

Everything that grows with the corpus stays in files of the shared folder, written by tasks and mapped by tasks:
* The vocabulary, in parts by hash: 63-bit hashes as one Elias-Fano sequence a part, and running sums of counts. A word's id is its place in hash order.
* The trie, in shards of about SHARD_TOKENS training tokens, each a range of (u, v, w). Level 2 has the successors of each u, level 3 those of each (u, v): ids
  that count on from the range before, so a level is one monotone Elias-Fano sequence; monotone pointers, Elias-Fano too, say where the range of a
  context begins. A successor is found by its value relative to its context. Discounted probabilities and interpolation weights are logarithms in
  16 bits, with a step of 1 / STEPS.
Shards are cut by the words' own frequencies, so a frequent word is spread over shards by its second word and a frequent pair by its third. Contexts
that may lie in several shards stand at a shard's ends; their totals, two pairs and two words a shard, are summed on the driver.

Two passes over the training text send sorted blocks that are summed before the shuffle; scoring a text moves nothing but its row. The shared folder must be
mounted on all machines (file:). Hash collisions: two of n words share a hash with a chance of about n**2 / 2**64.

Nulls and edges: null and empty texts are one end; a null doc_id counts as an empty string; repeated rows count each; unknown words have the unigram
share of a word with count 0; without training rows every score is 0; columns of docs pass through, those with the names of the added ones are replaced.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethoframe.llm import tokens
from ethoframe.llm.common import shared_dir
from ethoframe.llm.elias_fano import EliasFano, read, write

DISCOUNT = 0.75
#: Steps of a quantised logarithm in a unit.
STEPS = 4096
SHARD_TOKENS = 1_000_000
#: Tokens of a block that is sorted and sent; a longer text is a block of its own. Below 2**21 three ranks fit into a long, which sorts faster.
BLOCK_TOKENS = 1_500_000
SLICE_BYTES = 4_000_000
HASH_BITS = 63
MOST_PARTS = 4096
END = np.uint64(0x1D1E5A7E5C0FFEE5 >> 1)
ADDED = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
_RANK, _WIDE = 21, 31


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def mounted(path: str) -> str:
    """The shared folder as the path under which each machine sees it."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"tasks map the trie's files, so spark.checkpoint.dir must be a mounted folder, not {url.scheme}:")
    return url.path


def text_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the words and one END of each text."""
    h, starts = tokens.hashed(texts, lower=True)
    ends = starts[1:] + np.arange(len(starts) - 1)
    out = np.empty(len(h) + len(ends), np.uint64)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = h >> np.uint64(1), END
    return out, starts + np.arange(len(starts))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of longs as compressed planes of bytes; ascending ones should come as steps."""
    raw = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(c.reshape(8, -1).T).view("<i8").ravel() for c in np.split(raw, columns)]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values ascending, rank of each value); by hashing, as sorting all values takes longer."""
    coded = pc.dictionary_encode(pa.array(h))
    values = np.asarray(coded.dictionary)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], rank[np.asarray(coded.indices)]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _counted(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct combinations of ranks, ascending, and how often each stands."""
    if max(int(x.max(initial=0)) for x in (u, v, w)) >> _RANK:
        order = np.lexsort((w, v, u))
        u, v, w = u[order], v[order], w[order]
        new = _runs(u, v, w)
        return u[new], v[new], w[new], np.diff(np.append(new, len(u)))
    keys = np.sort(u << 2 * _RANK | v << _RANK | w)
    new = _runs(keys)
    one, mask = keys[new], (1 << _RANK) - 1
    return one >> 2 * _RANK, one >> _RANK & mask, one & mask, np.diff(np.append(new, len(keys)))


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEPS), 65535).astype(np.uint16)


def plain(q: np.ndarray) -> np.ndarray:
    return np.power(10.0, q / -float(STEPS))


@lru_cache(maxsize=4096)
def _mapped(path: str) -> list[np.ndarray]:
    return read(path)


@dataclass
class Vocabulary:
    """Parts by the hash's first bits. Ids count from 1 in hash order; 0 is an unknown word."""

    paths: list[str | None]
    first: np.ndarray  # words before each part, and all
    before: np.ndarray  # tokens before each part, and all

    @property
    def bits(self) -> int:
        return HASH_BITS - (len(self.paths) - 1).bit_length()

    @property
    def words(self) -> int:
        return int(self.first[-1])

    @property
    def tokens(self) -> int:
        return int(self.before[-1])

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes."""
        out = np.zeros(len(h), np.int64)
        cuts = np.searchsorted(h, np.arange(len(self.paths) + 1, dtype=np.uint64) << np.uint64(self.bits))
        for k, path in enumerate(self.paths):
            a, b = cuts[k], cuts[k + 1]
            if path and b > a:
                at = EliasFano.from_parts(_mapped(path)[:5]).find((h[a:b] & np.uint64((1 << self.bits) - 1)).astype(np.int64))
                out[a:b] = np.where(at >= 0, self.first[k] + at + 1, 0)
        return out

    def sums(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words before, tokens) of ascending ids; of id 0 both are 0."""
        low, count = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.first + 1)
        for k, path in enumerate(self.paths):
            a, b = cuts[k], cuts[k + 1]
            if path and b > a:
                running, at = _mapped(path)[5], ids[a:b] - self.first[k] - 1
                low[a:b], count[a:b] = self.before[k] + running[at], running[at + 1] - running[at]
        return low, count


def _shards_of(n: int, total: int, u: tuple, v: tuple, w_low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard of a trigram, whether its word, its pair may lie in several): u and v are (tokens before, tokens). Ascending with (u, v, w)."""
    low = u[0] * n // total
    width = (np.maximum((u[0] + u[1]) * n - 1, 0) // total) - low + 1
    inner = v[0] * width // total
    inner_width = (np.maximum((v[0] + v[1]) * width - 1, 0) // total) - inner + 1
    return low + inner + w_low * inner_width // total, width > 1, inner_width > 1


class Shard:
    """One file of the trie. Contexts of level 2 are words from ``u0`` on, those of level 3 are places in level 2."""

    def __init__(self, path: str) -> None:
        parts = _mapped(path)
        self.u0, self.n_words = parts[0].tolist()
        self.pointers = {2: EliasFano.from_parts(parts[1:6]), 3: EliasFano.from_parts(parts[6:11])}
        self.successors = {2: EliasFano.from_parts(parts[11:16]), 3: EliasFano.from_parts(parts[16:21])}
        self.own = {2: parts[21], 3: parts[22]}
        self.rest = {2: parts[23], 3: parts[24]}

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place in the level of word after context, or -1; equal contexts stand together."""
        if not len(context):
            return np.zeros(0, np.int64)
        pointers, successors = self.pointers[level], self.successors[level]
        new = _runs(context)
        one = context[new]
        low, high = pointers.values(one), pointers.values(one + 1)
        base = np.zeros(len(one), np.int64)
        later = low > 0
        base[later] = successors.values(low[later] - 1)
        size = np.diff(np.append(new, len(context)))
        low, high, base = np.repeat(low, size), np.repeat(high, size), np.repeat(base, size)
        found = np.full(len(context), -1, np.int64)
        some = np.flatnonzero((high > low) & (word > 0))
        at = successors.find(base[some] + word[some])
        found[some] = np.where((at >= low[some]) & (at < high[some]), at, -1)
        return found

    def pair(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        place = np.full(len(u), -1, np.int64)
        known = np.flatnonzero((u >= self.u0) & (u < self.u0 + self.n_words))
        place[known] = self.find(2, u[known] - self.u0, v[known])
        return place


def _relative(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, int]:
    """Successors as one ascending sequence: each context's ids count on from the last of the one before."""
    if not len(word):
        return word, 1
    new = _runs(context)
    last = word[np.append(new[1:], len(word)) - 1]
    base = np.concatenate([[0], np.cumsum(last)])
    return np.repeat(base[:-1], np.diff(np.append(new, len(word)))) + word, int(base[-1]) + 1


def _write_shard(path: str, vocabulary: Vocabulary, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, discount: float) -> list[tuple[int, ...]]:
    """Write the trie of ascending distinct trigrams (w is 0 after a text's end) and return the totals of the contexts at its ends."""
    new = _runs(u, v)
    pu, pv, pair_count = u[new], v[new], np.add.reduceat(c, new)
    of_pair = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(u))))
    real = w > 0
    context_count = np.bincount(of_pair[real], weights=c[real], minlength=len(new)).astype(np.int64)
    context_types = np.bincount(of_pair[real], minlength=len(new))
    u0, n_words = int(u[0]), int(u[-1] - u[0]) + 1
    word_types = np.bincount(pu - u0, minlength=n_words)
    word_count = vocabulary.sums(np.arange(u0, u0 + n_words))[1]
    pointer2, pointer3 = np.concatenate([[0], np.cumsum(word_types)]), np.concatenate([[0], np.cumsum(context_types)])
    level2, level3 = _relative(pu, pv), _relative(of_pair[real], w[real])
    parts = [np.array([u0, n_words], np.int64)]
    for values, universe in ((pointer2, len(pu) + 1), (pointer3, int(real.sum()) + 1), level2, level3):
        parts += EliasFano.of(values, universe).parts()
    share = lambda types, count: quantised(np.where(types > 0, discount * types / np.maximum(count, 1), 1.0))
    parts += [quantised((pair_count - discount) / word_count[pu - u0]), quantised((c[real] - discount) / context_count[of_pair[real]]), share(word_types, word_count), share(context_types, context_count)]
    write(path, parts)
    ends = sorted({0, len(pu) - 1})
    return [(int(pu[i]), int(pv[i]), int(pair_count[i]), int(context_count[i]), int(context_types[i]), int(word_types[pu[i] - u0])) for i in ends]


@dataclass
class Model:
    vocabulary: Vocabulary
    shards: list[str | None]
    discount: float = DISCOUNT
    #: Totals of contexts that may lie in several shards: (u, v): pair, context, types; u: types; (shard, u, v): the context's tokens in it.
    pairs: dict[tuple[int, int], tuple[int, int, int]] = field(default_factory=dict)
    words: dict[int, int] = field(default_factory=dict)
    local: dict[tuple[int, int, int], int] = field(default_factory=dict)

    def probabilities(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training counts, probabilities) of the tokens of texts."""
        total, n = self.vocabulary.tokens, len(self.shards)
        values, rank = _distinct(h)
        ids = self.vocabulary.ids(values)
        low, count = self.vocabulary.sums(np.maximum.accumulate(ids))
        low, count = np.where(ids > 0, low, 0), np.where(ids > 0, count, 0)
        one = (count[rank] + 1) / (total + self.vocabulary.words + 1)
        if not total:
            return count[rank], one
        # every token with the one or two before it; a text's first word follows an end
        first = np.zeros(len(h), bool)
        first[starts[:-1]] = True
        end = np.searchsorted(values, END)
        v = np.where(first, end, np.roll(rank, 1))
        u = np.where(np.roll(first, 1), end, np.roll(v, 1))
        known, in_pair = np.flatnonzero(ids[v] > 0), np.zeros(len(h), bool)

        # bigrams: each distinct one once
        keys, at = np.unique(v[known] << _WIDE | rank[known], return_inverse=True)
        a, b = keys >> _WIDE, keys & ((1 << _WIDE) - 1)
        shard, wide_word, wide_pair = _shards_of(n, total, (low[a], count[a]), (low[b], count[b]), np.zeros(len(a), np.int64))
        own2, rest2, rest3, place = np.zeros(len(a)), np.zeros(len(a)), np.full(len(a), -1.0), np.full(len(a), -1, np.int64)
        ia, ib = ids[a], ids[b]
        for s in np.unique(shard):
            if self.shards[s] is None:
                continue
            here, file = np.flatnonzero(shard == s), Shard(self.shards[s])
            inside = here[(ia[here] >= file.u0) & (ia[here] < file.u0 + file.n_words)]
            rest2[inside] = plain(file.rest[2][ia[inside] - file.u0])
            got = file.pair(ia[here], ib[here])
            hit, got = here[got >= 0], got[got >= 0]
            place[hit] = got
            own2[hit] = plain(file.own[2][got])
            more = file.pointers[3].values(got + 1) > file.pointers[3].values(got)
            rest3[hit[more]] = plain(file.rest[3][got[more]])
        wide = np.flatnonzero(wide_word)
        many, back = np.unique(a[wide], return_inverse=True)
        types = np.array([self.words[i] for i in ids[many].tolist()], np.int64)
        rest2[wide] = plain(quantised(self.discount * types / count[many]))[back]
        for i in np.flatnonzero(wide_pair):
            pair, context, types = self.pairs.get((int(ia[i]), int(ib[i])), (0, 0, 0))
            own2[i] = plain(quantised(np.array((pair - self.discount) / count[a[i]]))) if pair else 0.0
            rest3[i] = plain(quantised(np.array(self.discount * types / context))) if context else -1.0
        two = one.copy()
        two[known] = own2[at] + rest2[at] * one[known]

        # trigrams: their context is the bigram that ends one token before
        bigram = np.full(len(h), -1, np.int64)
        bigram[known] = at
        context = np.where(first, -1, np.roll(bigram, 1))
        in_pair = np.flatnonzero((context >= 0) & (rest3[context] >= 0))
        keys, back = np.unique(context[in_pair] << _WIDE | rank[in_pair], return_inverse=True)
        pair, w = keys >> _WIDE, keys & ((1 << _WIDE) - 1)
        pa_, pb = a[pair], b[pair]
        shard = _shards_of(n, total, (low[pa_], count[pa_]), (low[pb], count[pb]), low[w])[0]
        own3 = np.zeros(len(keys))
        for s in np.unique(shard):
            if self.shards[s] is None:
                continue
            here, file = np.flatnonzero(shard == s), Shard(self.shards[s])
            at2 = place[pair[here]].copy()
            wide = np.flatnonzero(wide_pair[pair[here]])
            at2[wide] = file.pair(ia[pair[here[wide]]], ib[pair[here[wide]]])
            here, at2 = here[at2 >= 0], at2[at2 >= 0]
            got = file.find(3, at2, ids[w[here]])
            hit, got = here[got >= 0], got[got >= 0]
            own3[hit] = plain(file.own[3][got])
            for i in hit[wide_pair[pair[hit]]]:  # the file knows the context's tokens in itself only
                key = (int(ia[pair[i]]), int(ib[pair[i]]))
                own3[i] *= self.local[(int(s), *key)] / self.pairs[key][1]
        three = two
        three[in_pair] = own3[back] + rest3[context[in_pair]] * two[in_pair]
        return count[rank], three


def train(docs: DataFrame, shard_tokens: int = SHARD_TOKENS, discount: float = DISCOUNT) -> Model:
    """Vocabulary and trie of all texts of docs, as files in the shared folder; the driver gets a row per part and per shard."""
    spark = docs.sparkSession
    folder = f"{mounted(shared_dir(spark))}/ngrams-{uuid.uuid4().hex}"
    os.makedirs(folder)
    texts = docs.select("text")
    n_parts = 1 << (min(MOST_PARTS, max(1, texts.rdd.getNumPartitions())) - 1).bit_length()
    bits = HASH_BITS - (n_parts - 1).bit_length()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens of several texts at a time: (hashes, starts)."""
        held, size = [], 0
        for batch in batches:
            for part in tokens.slices(batch, most=SLICE_BYTES):
                h, starts = text_tokens(part.column("text"))
                if size + len(h) > BLOCK_TOKENS and held:
                    yield _joined(held)
                    held, size = [], 0
                held.append((h, starts))
                size += len(h)
        if held:
            yield _joined(held)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _ in blocks(batches):
            values, rank = _distinct(h)
            counts = np.bincount(rank, minlength=len(values))
            cuts = np.searchsorted(values, np.arange(n_parts + 1, dtype=np.uint64) << np.uint64(bits))
            rows = [(k, pack(values[a:b].view(np.int64), counts[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["part", "data"])

    def write_words(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        h, c = (np.concatenate(x) for x in zip(*(unpack(d, 2) for d in table["data"].to_pylist()), strict=True))
        values, rank = np.unique(h, return_inverse=True)
        counts = np.bincount(rank, weights=c).astype(np.int64)
        running = np.concatenate([[0], np.cumsum(counts)])
        path = f"{folder}/words-{part}"
        write(path, [*EliasFano.of(values & ((1 << bits) - 1), 1 << bits).parts(), running])
        return pa.table({"part": pa.array([part], pa.int32()), "path": [path], "words": [len(values)], "tokens": [int(running[-1])]})

    counted = texts.mapInArrow(count_words, "part int, data binary")
    found = {r.part: r for r in counted.groupBy("part").applyInArrow(write_words, "part int, path string, words long, tokens long").collect()}
    paths = [found[k].path if k in found else None for k in range(n_parts)]
    total = lambda name: np.concatenate([[0], np.cumsum([getattr(found[k], name) if k in found else 0 for k in range(n_parts)])]).astype(np.int64)
    vocabulary = Vocabulary(paths, total("words"), total("tokens"))
    if not vocabulary.tokens:
        return Model(vocabulary, [], discount)
    n = -(-vocabulary.tokens // shard_tokens)

    def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, starts in blocks(batches):
            values, rank = _distinct(h)
            ids = vocabulary.ids(values)
            low, count = vocabulary.sums(ids)
            end = int(np.searchsorted(values, END))
            # a text's trigrams begin at the end before it and stop with the pair of its last word and end
            at = starts[:-1] + np.arange(len(starts) - 1)
            line = np.insert(rank, starts[:-1], end) + 1
            u, v, w = line[:-1], line[1:], np.append(line[2:], 0)
            last = np.zeros(len(line), bool)
            last[np.append(at[1:], len(line)) - 1] = True
            w = np.where(last[1:], 0, w)
            keep = ~last[:-1]
            u, v, w, c = _counted(u[keep], v[keep], w[keep])
            u, v, w = u - 1, v - 1, w - 1
            w_id, w_low = np.where(w < 0, 0, ids[w]), np.where(w < 0, 0, low[w])
            shard = _shards_of(n, vocabulary.tokens, (low[u], count[u]), (low[v], count[v]), w_low)[0]
            cuts = np.append(_runs(shard), len(shard))
            rows = [(int(shard[a]), pack(np.diff(ids[u[a:b]], prepend=0), ids[v[a:b]], w_id[a:b], c[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["shard", "data"])

    def write_trie(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        got = [unpack(d, 4) for d in table["data"].to_pylist()]
        u, v, w, c = (np.concatenate(x) for x in zip(*((np.cumsum(g[0]), *g[1:]) for g in got), strict=True))
        u0, bits_v, bits_w = int(u.min()), int(v.max()).bit_length(), int(w.max()).bit_length()
        fits = int(u.max() - u0).bit_length() + bits_v + bits_w < 64
        order = np.argsort((u - u0) << (bits_v + bits_w) | v << bits_w | w) if fits else np.lexsort((w, v, u))
        u, v, w, c = (x[order] for x in (u, v, w, c))
        new = _runs(u, v, w)
        path = f"{folder}/trie-{shard}"
        ends = _write_shard(path, vocabulary, u[new], v[new], w[new], np.add.reduceat(c, new), discount)
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path], "ends": pa.array([[list(e) for e in ends]], pa.list_(pa.list_(pa.int64())))})

    shards = texts.mapInArrow(count_ngrams, "shard int, data binary").groupBy("shard").applyInArrow(write_trie, "shard int, path string, ends array<array<bigint>>").collect()
    model = Model(vocabulary, [None] * n, discount)
    for r in sorted(shards, key=lambda r: r.shard):
        model.shards[r.shard] = r.path
        seen = set()
        for u, v, pair, context, types, word_types in r.ends:
            old = model.pairs.get((u, v))
            if u not in seen:  # a pair in two shards is one type of its word
                model.words[u] = model.words.get(u, 0) + word_types - (old is not None and r.ends[0][:2] == [u, v])
                seen.add(u)
            model.pairs[u, v] = tuple(x + y for x, y in zip(old or (0, 0, 0), (pair, context, types), strict=True))
            model.local[r.shard, u, v] = context
    return model


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.cumsum([0, *(len(h) for h, _ in held)])
    return np.concatenate([h for h, _ in held]), np.concatenate([s[:-1] + at for (_, s), at in zip(held, sizes, strict=False)] + [sizes[-1:]])


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score, the log10 probabilities of each text as unigrams and under the model."""
    added = T.StructType.fromDDL(ADDED)
    docs = docs.drop(*added.names)
    schema = T.StructType([*docs.schema.fields, *added.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in tokens.slices(batch, most=SLICE_BYTES):
                h, starts = text_tokens(part.column("text"))
                count, p = model.probabilities(h, starts)
                base = np.log10((count + 1) / (model.vocabulary.tokens + model.vocabulary.words + 1))
                sums = [np.add.reduceat(x.astype(np.longdouble), starts[:-1]).astype(float) for x in (base, np.log10(p))]
                known = np.add.reduceat((count > 0).astype(np.int64), starts[:-1])
                made = [np.diff(starts), known, np.full(part.num_rows, model.vocabulary.tokens), *sums]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, made)], schema.names)

    return docs.mapInArrow(scored, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out and score all."""
    return score_texts(docs, train(docs.where(~held_out(F.col("doc_id"))))).withColumn("held_out", held_out(F.col("doc_id")))
