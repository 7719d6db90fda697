"""Substring dedup: words covered by a window of ``width`` words that also stands elsewhere are removed.

The reference of the comparison is the whole table, cut into shards that only meet the documents they can match:

1. Anchors. Among the ANCHOR-word runs of a window the one with the smallest hash (the rightmost of equals) is its anchor: equal windows
   have equal anchors. Consecutive windows with one anchor form a passage. Anchors are counted over all documents.
2. An anchor that all its passages share word for word needs no search. Where an anchor has different passages, its distinct
   passages are reference texts. They are dealt to shards by anchor; a shard's suffix automaton is built in the task, the
   shard's passages are streamed through it for matching statistics, and a window counts if the automaton has seen it twice.
3. An anchor with more than HOT passages is not gathered: its distinct passages are cut into windows, which are counted
   by their own digest (summed before the shuffle).
4. Windows that count become spans of their document; the words under them go.

Automata are not broadcast: with the whole table as reference every task would stream every document through every shard. Dealing by
anchor gives the same matches in one pass over the passages.

Nulls and edges: a null text has no words; texts with fewer words than the window keep all; a document may repeat itself; all copies
of a window go, the first too (the input is judged, not what is left); rows that repeat a document are occurrences of their own;
rows are known by doc_id and a hash of the text, so rows that share a doc_id, or have none, are judged each by its own text; an empty table gives an empty result. Columns of
docs pass through, and text, n_words and n_removed are set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethoframe.llm import tokens
from ethoframe.llm.common import materialize

WIDTH = 35
ANCHOR = 8
HOT = 5_000
SHARD_WORDS = 60_000
#: A row is known by its doc_id and a hash of its text; rows that share both have the same windows.
KEY = ["key", "mark"]


def _rightmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the position of its smallest, the rightmost of equals; by doubling."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at, have = np.where(h[right] <= h[left], right, left), have + step
    return at


def passages(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, anchor, digest) of the passages: runs of windows with one anchor."""
    h, starts = tokens.hashed(texts)
    none = np.zeros(0, np.int64)
    if len(h) < width:
        return none, none, none, none, none
    anchor = min(ANCHOR, width)
    grams = tokens.runs_of(h, anchor)
    low = _rightmost_minimum(grams, width - anchor + 1)
    doc = tokens.doc_of(starts)
    first = np.arange(len(h) - width + 1)
    inside = doc[first] == doc[first + width - 1]
    first, low = first[inside], low[inside]
    if not len(first):
        return none, none, none, none, none
    fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[first[1:]] != doc[first[:-1]])])
    head = np.flatnonzero(fresh)
    n = np.diff(np.concatenate([head, [len(first)]]))
    at = first[head]
    digest = tokens.spans_hash(h, at, at + n + width - 1)
    return doc[at], at - starts[doc[at]], n, grams[low[head]].view(np.int64), digest.view(np.int64)


class Automaton:
    """Suffix automaton of a list of token sequences, with the number of places of every state."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link, self.count = [0], [-1], [0]
        last = 0
        for k, sequence in enumerate(sequences):
            for token in sequence:
                last = self._add(last, token)
            last = self._add(last, -1 - k)  # a mark of its own ends each sequence
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def _add(self, last: int, token: int) -> int:
        new = len(self.length)
        self.next.append({}), self.length.append(self.length[last] + 1), self.link.append(0), self.count.append(1)
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = len(self.length)
                self.next.append(dict(self.next[q])), self.length.append(self.length[p] + 1), self.link.append(self.link[q]), self.count.append(0)
                while p != -1 and self.next[p].get(token) == q:
                    self.next[p][token] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
        return new

    def repeated(self, sequence: list[int], width: int) -> int:
        """Bit i is set if the window that starts at i has at least two places."""
        state, matched, mask = 0, 0, 0
        for end, token in enumerate(sequence):
            while state and token not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if token in self.next[state]:
                state, matched = self.next[state][token], matched + 1
            while state and self.length[self.link[state]] >= width:
                state = self.link[state]
                matched = self.length[state]
            if matched >= width and self.count[state] > 1:
                mask |= 1 << (end - width + 1)
        return mask


def _runs(docs: DataFrame, width: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                doc, start, n, anchor, digest = passages(part.column("text"), width)
                key, mark = (part.column(c).take(pa.array(doc)) for c in KEY)
                yield pa.RecordBatch.from_arrays([key, mark, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(digest)], [*KEY, "start", "n", "anchor", "digest"])

    return docs.mapInArrow(cut, "key long, mark long, start int, n int, anchor long, digest long")


def _texts_of(joined: DataFrame, width: int) -> DataFrame:
    """anchor, digest, n, hot, words for each entry of a document that needs a comparison."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "n", "hot", "words"]
        for batch in batches:
            for part in tokens.slices(batch):
                out: list[tuple] = []
                for text, entries in zip(part.column("text").to_pylist(), part.column("entries").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    out += [(e["anchor"], e["digest"], e["n"], e["hot"], b" ".join(words[e["start"] : e["start"] + e["n"] + width - 1])) for e in entries or () if e["mixed"]]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names)

    return joined.mapInArrow(cut, "anchor long, digest long, n int, hot boolean, words binary")


def _by_automata(texts: DataFrame, width: int) -> DataFrame:
    """anchor, digest, bits for distinct passages whose anchors are not hot."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(rows: list[tuple[int, int, int, int, list[bytes]]]) -> pa.RecordBatch:
            codes: dict[bytes, int] = {}
            sequences = [[codes.setdefault(w, len(codes)) for w in words] for *_, words in rows]
            automaton = Automaton(sequences)
            masks = [(1 << n) - 1 if times > 1 else automaton.repeated(s, width) for (_, _, n, times, _), s in zip(rows, sequences, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(masks, pa.int64())], ["anchor", "digest", "bits"])

        held, size = [], 0
        for batch in batches:
            for anchor, digest, n, times, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "n", "times", "words")), strict=True):
                if size >= SHARD_WORDS and anchor != held[-1][0]:
                    yield finish(held)
                    held, size = [], 0
                held.append((anchor, digest, n, times, text.split(b" ")))
                size += len(held[-1][4])
        if held:
            yield finish(held)

    return texts.repartition("anchor").sortWithinPartitions("anchor", "digest").mapInArrow(matched, "anchor long, digest long, bits long")


def _by_windows(texts: DataFrame, width: int) -> DataFrame:
    """anchor, digest, bits for distinct passages of hot anchors: windows counted by their digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, digest, n, times, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "n", "times", "words")), strict=True):
                words = text.split(b" ")
                out += [(anchor, digest, i, times, xxhash.xxh3_128_digest(b" ".join(words[i : i + width]))) for i in range(n)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["anchor", "digest", "i", "times", "window"])

    windows = materialize(texts.mapInArrow(cut, "anchor long, digest long, i int, times long, window binary"), "repeat-hot")
    often = windows.groupBy("window").agg(F.sum("times").alias("all")).where("all > 1").select("window")
    return windows.join(often, "window").groupBy("anchor", "digest").agg(F.expr("bit_or(shiftleft(1L, i))").alias("bits"))


def repeated_entries(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, mark and entries (start, bits: bit i marks the window at start + i), for rows with repeated windows; docs has key, mark and text."""
    runs = _runs(docs, width)
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("times"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("times > 1")
    anchors = materialize(anchors.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"), (F.col("times") > HOT).alias("hot")), "repeat-anchors")
    entry = F.struct("start", "n", "anchor", "digest", "mixed", "hot")
    # rows that repeat key and mark have the same entries: a set holds them once, while anchors and texts below count all rows
    found = runs.join(anchors, "anchor").groupBy(*KEY).agg(F.collect_set(entry).alias("entries"))
    found = materialize(found, "repeat-entries")
    needy = found.where(F.exists("entries", lambda e: e["mixed"]))
    texts = _texts_of(docs.join(needy, KEY).select("text", "entries"), width)
    texts = texts.groupBy("anchor", "digest").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("hot").alias("hot"), F.first("words").alias("words"))
    texts = materialize(texts, "repeat-texts")
    masks = _by_automata(texts.where("not hot"), width).unionByName(_by_windows(texts.where("hot"), width))
    masks = materialize(masks.where("bits <> 0"), "repeat-masks")
    each = found.select(*KEY, F.inline("entries"))
    sure = each.where("not mixed").select(*KEY, "start", (F.expr("shiftleft(1L, n)") - 1).alias("bits"))
    judged = each.where("mixed").join(masks, ["anchor", "digest"]).select(*KEY, "start", "bits")
    return sure.unionByName(judged).groupBy(*KEY).agg(F.collect_list(F.struct("start", "bits")).alias("entries"))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with n_words, n_removed and the kept words, joined by one space, as text."""
    if not ANCHOR < width <= ANCHOR + 62:
        raise ValueError(f"width must be above {ANCHOR} and at most {ANCHOR + 62}")  # a passage's windows are bits of a long
    docs = docs.drop("n_words", "n_removed")
    key: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    text = F.col("text").cast("string")
    keyed = docs.withColumns({"repeat_key": key, "repeat_mark": F.xxhash64(text)})
    slim = docs.select(key.alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))
    entries = repeated_entries(slim, width).withColumnsRenamed({"key": "repeat_key", "mark": "repeat_mark", "entries": "repeat_entries"})
    joined = keyed.join(entries, ["repeat_key", "repeat_mark"], "left").drop("repeat_key", "repeat_mark")
    passed = [c for c in docs.columns if c != "text"]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                texts, sizes, gone = [], [], []
                for text, marks in zip(part.column("text").to_pylist(), part.column("repeat_entries").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    edges = np.zeros(len(words) + 1, np.int64)
                    for m in marks or ():
                        bits = np.flatnonzero([m["bits"] >> i & 1 for i in range(m["bits"].bit_length())]) + m["start"]
                        bits = bits[bits < len(words)]
                        np.add.at(edges, bits, 1)
                        np.add.at(edges, np.minimum(bits + width, len(words)), -1)
                    under = np.cumsum(edges)[:-1] > 0 if len(words) else np.zeros(0, bool)
                    texts.append(b" ".join(w for w, u in zip(words, under, strict=True) if not u) if marks else b" ".join(words))
                    sizes.append(len(words)), gone.append(int(under.sum()))
                columns = [part.column(c) for c in passed] + [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*passed, "text", "n_words", "n_removed"])

    fields = [docs.schema[c] for c in passed] + [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return joined.mapInArrow(kept, T.StructType(fields))
