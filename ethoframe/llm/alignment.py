"""Alignment of two tokenizers on the same texts: which tokens of one cover the bytes of which tokens of the other.

Each text is encoded by both, and a transducer walks both sequences at once. Its state is the dangling suffix: the side that leads and its bytes that
the other hasn't matched yet. The lagging side's next token either uses up part of the suffix, or all of it and becomes the leader, or
leaves nothing, which closes a group. Transitions are memoised by (state, token); a suffix is always the end of one token, so there are finitely many.
Walks from the empty state back to it over a unit (a word with the spaces before it) are memoised as a whole.
All pairs of a token of A and one of B within a group are links.

On the corpus a pair of ids counts the documents that hold it linked. Spark keeps one row per document with its distinct pairs (sorted, as compressed
bytes), sums counts over blocks before the shuffle, and looks counts up in two ways: pairs that stand in more than 1 / HOT of all (document, pair)
rows, which are fewer than HOT whatever the input, are broadcast; the rest, none of them frequent, is joined by key.

Nulls and edges: null and empty texts, and texts that a tokenizer doesn't keep byte by byte, have zeros and an empty hash; every row is a document of
its own, with or without a doc_id, so repeated rows count each; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoframe.llm import tokens
from ethoframe.llm.common import materialize

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ids of B are below 2**15, those of A below 2**16: a pair is one int.
B_BITS = 15
#: Most pairs that are broadcast.
HOT = 400_000
SLICE_BYTES = 1_000_000
#: Pairs that a task works on at a time.
BLOCK_PAIRS = 2_000_000
#: A group with more token pairs is counted by its distinct ids.
LARGE_GROUP = 4096
ROWS = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@dataclass
class Side:
    """An encoder without special tokens and the bytes of each id."""

    encode: Callable[[str], list[int]]
    bytes_of: list[bytes]
    joined: Callable[[list[int]], bytes] | None = None
    by_units: bool = True


@cache
def side_a(path: str) -> Side:
    """A byte-level vocabulary file. Its merges stand in the order of the ids that they make, so the ids serve as ranks of one merge loop."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"] for t in model["added_tokens"]}
    vocabulary = {w: i for w, i in model["model"]["vocab"].items() if w not in special}
    ranks = {bytes(alphabet[c] for c in w): i for w, i in vocabulary.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    if made != sorted(set(made)) or len(ranks) != len(made) + 256:
        raise ValueError(f"{path}: merges are not in the order of their ids")
    names = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        names[i] = b
    encoding = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return Side(encoding.encode_ordinary, names, encoding.decode_bytes)


@cache
def side_b(path: str) -> Side:
    """A piece model that adds one space, and whether any of its pieces has a space after another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    names = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(lambda texts: model.encode(texts, num_threads=1), names, by_units=not any("▁" in p.lstrip("▁") for p in pieces))


class State(dict):
    """A dangling suffix: its bytes, whether B lags and so reads next, and the known transitions, by token, to the next state."""

    __slots__ = ("b_reads", "suffix", "walk")

    def __init__(self, walk: Transducer, b_reads: bool, suffix: bytes | None) -> None:
        self.walk, self.b_reads, self.suffix = walk, b_reads, suffix

    def __missing__(self, token: int) -> State:
        if self.suffix is None:
            return self
        read = (self.walk.b if self.b_reads else self.walk.a)[token]
        if self.suffix and self.suffix.startswith(read):
            to = self.walk.state(self.b_reads, self.suffix[len(read) :])
        elif read.startswith(self.suffix):
            to = self.walk.state(not self.b_reads, read[len(self.suffix) :])
        else:
            to = self.walk.dead
        self[token] = to
        return to


class Transducer:
    """Both sides' bytes by id, and the states met so far. In the empty state A reads; from the dead state nothing leads away."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        self.a, self.b = a, b
        self.empty, self.dead = State(self, False, b""), State(self, False, None)
        self.states: dict[tuple[bool, bytes], State] = {}

    def state(self, b_reads: bool, suffix: bytes) -> State:
        if not suffix:
            return self.empty
        key = (b_reads, suffix)
        if key not in self.states:
            self.states[key] = State(self, b_reads, suffix)
        return self.states[key]

    def cuts(self, a: list[int], b: list[int]) -> tuple[array, array] | None:
        """How many tokens of A and of B end with each group; None if the sequences differ."""
        s = empty = self.empty
        j = 0
        ends_a, ends_b = array("q"), array("q")
        close_a, close_b = ends_a.append, ends_b.append
        try:
            for i, t in enumerate(a, 1):
                s = s[t]
                while s.b_reads:
                    s = s[b[j]]
                    j += 1
                if s is empty:
                    close_a(i)
                    close_b(j)
        except IndexError:  # B has ended
            return None
        return (ends_a, ends_b) if s is empty and j == len(b) else None


@cache
def _names() -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids with the mark that follows them, three to an id: bytes in rows of six, and which of them are used."""
    rows = np.array([f"{i}{mark}" for i in range(1 << 16) for mark in ",|;"], "S6").view(np.uint8).reshape(-1, 6)
    return rows, rows > 0


def groups_text(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: both sides' ids group by group."""
    ids = np.empty(len(a) + len(b), np.int64)
    marks = np.zeros(len(ids), np.int64)
    in_a, in_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    ids[np.arange(len(a)) + np.repeat(ends_b - in_b, in_a)] = a
    ids[np.arange(len(b)) + np.repeat(ends_a, in_b)] = b
    marks[ends_a + ends_b - in_b - 1] = 1
    marks[ends_a + ends_b - 1] = 2
    names, used = _names()
    at = ids * 3 + marks
    return names[at][used[at]].tobytes()[:-1]


def link_pairs(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, ends_b: np.ndarray, small: np.ndarray | None = None) -> np.ndarray:
    """The id pair of every link, group by group, of the small groups or of all."""
    of_a = np.repeat(np.arange(len(in_a)), in_a)
    pick = np.arange(len(a)) if small is None else np.flatnonzero(small[of_a])
    width = in_b[of_a[pick]]
    start = (ends_b - in_b)[of_a[pick]]
    offset = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    return np.repeat(a[pick], width) << B_BITS | b[np.repeat(start, width) + offset]


def linked_pairs(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, links): the distinct id pairs linked in the text, ascending, and their links."""
    in_a, in_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    small = in_a * in_b <= LARGE_GROUP
    pairs, links = np.unique(link_pairs(a, b, in_a, in_b, ends_b, small), return_counts=True)
    for g in np.flatnonzero(~small):  # distinct ids of each side, multiplied
        (x, nx), (y, ny) = (np.unique(t[e[g] - n[g] : e[g]], return_counts=True) for t, e, n in ((a, ends_a, in_a), (b, ends_b, in_b)))
        pairs = np.concatenate([pairs, (x[:, None] << B_BITS | y).ravel()])
        links = np.concatenate([links, (nx[:, None] * ny).ravel()])
    if not small.all():
        pairs, at = np.unique(pairs, return_inverse=True)
        links = np.bincount(at, weights=links).astype(np.int64)  # exact: far below 2**53
    return pairs, links


def pack(pairs: np.ndarray, links: np.ndarray) -> bytes:
    """Ascending pairs as steps in four planes of bytes; links where they aren't 1."""
    steps = np.diff(pairs, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    many = np.flatnonzero(links > 1)
    raw = np.int64(len(pairs)).tobytes() + np.int64(len(many)).tobytes() + steps.T.tobytes() + many.astype("<u4").tobytes() + links[many].astype("<i8").tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd", asbytes=True)
    n, m = np.frombuffer(raw, np.int64, 2)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 16).reshape(4, n).T).view("<u4").ravel()
    pairs, links = np.cumsum(steps, dtype=np.int64), np.ones(n, np.int64)
    links[np.frombuffer(raw, "<u4", m, 16 + 4 * n)] = np.frombuffer(raw, "<i8", m, 16 + 4 * n + 4 * m)
    return pairs, links


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row ids, pairs of each, pairs, links) of packed rows, about BLOCK_PAIRS at a time."""
    ids, held, size = [], [], 0
    for row, data in zip(batch.column("row_id").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
        ids.append(row)
        held.append(unpack(data))
        size += len(held[-1][0])
        if size >= BLOCK_PAIRS:
            yield _block(ids, held)
            ids, held, size = [], [], 0
    if held:
        yield _block(ids, held)


def _block(ids: list[int], held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.array(ids, np.int64), np.array([len(p) for p, _ in held]), np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held])


@cache
def _sides(folder: str) -> tuple[Side, Side, Transducer]:
    a, b = side_a(f"{folder}/{A_FILE}"), side_b(f"{folder}/{B_FILE}")
    return a, b, Transducer(a.bytes_of, b.bytes_of)


def align_text(text: str | None, folder: str = TOKENIZERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(ids of A, ids of B, and how many of each end with each group) of space + text; None if there are none or a side changes the bytes."""
    if not text:
        return None
    one, two, walk = _sides(folder)
    spaced = " " + text
    a = one.encode(spaced)
    if one.joined(a) != spaced.encode():
        return None
    b = two.encode(text)
    ends = walk.cuts(a, b)
    return ends and (np.array(a), np.array(b), np.frombuffer(ends[0], np.int64), np.frombuffer(ends[1], np.int64))


#: Units that a task remembers, if they are shorter than LONG_UNIT.
KNOWN_UNITS, LONG_UNIT = 300_000, 32
#: Units end before a space that follows anything but white space. No token of A reaches over such a place, and none of B if its pieces have spaces in front only.
_UNIT_ENDS = re.compile(r"(?<=\S)(?= )")


class Aligner:
    """Texts aligned unit by unit: at the end of a unit the transducer is in its empty state, so its walks over whole units are memoised as well."""

    def __init__(self, folder: str) -> None:
        a, self.b, _ = _sides(folder)
        self.folder, self.sizes = folder, np.array([len(x) for x in a.bytes_of])
        #: unit without its first space, never one that ends in white space: (numbers of tokens, groups, linked pairs one by one), as bytes
        self.known: dict[str, tuple[bytes, bytes, bytes]] = {}

    def row(self, text: str | None) -> tuple[int, int, int, int, str, bytes | None]:
        """n_a, n_b, n_groups, n_links, hash of the groups, packed pairs."""
        if not text:
            return 0, 0, 0, 0, "", None
        if not self.b.by_units or text[-1] == " " or "▁" in text or not (met := self._units(text)):
            return self._whole(text)
        sizes, groups, links = zip(*met, strict=True)
        n_a, n_b = np.frombuffer(b"".join(sizes), np.int32).reshape(-1, 2).sum(0).tolist()
        joined = b";".join(groups)
        pairs, n = np.unique(np.frombuffer(b"".join(links), np.int32), return_counts=True)
        return n_a, n_b, joined.count(b"|"), int(n.sum()), hashlib.sha256(joined).hexdigest(), pack(pairs.astype(np.int64), n)

    def _whole(self, text: str) -> tuple[int, int, int, int, str, bytes | None]:
        found = align_text(text, self.folder)
        if found is None:
            return 0, 0, 0, 0, "", None
        a, b, ends_a, ends_b = found
        pairs, links = linked_pairs(a, b, ends_a, ends_b)
        return len(a), len(b), len(ends_a), int(links.sum()), hashlib.sha256(groups_text(a, b, ends_a, ends_b)).hexdigest(), pack(pairs, links)

    def _units(self, text: str) -> list[tuple[bytes, bytes, bytes]] | None:
        """The walks over the units; None if new ones can't be told apart: a side changes their bytes, or a group is large."""
        known = self.known
        if len(known) > KNOWN_UNITS:
            known.clear()
        units = text.split(" ")
        new = [u for u in dict.fromkeys(units) if u not in known]
        odd = [u for u in new if not u or u[-1].isspace()]
        if odd and (odd != units[-1:] or units.count(odd[0]) > 1):
            units = [u[1:] for u in _UNIT_ENDS.split(" " + text)]
            new = [u for u in dict.fromkeys(units) if u not in known]
        if new and not self._learn(new):
            return None
        met = list(map(known.__getitem__, units))
        for u in new:
            if len(u) >= LONG_UNIT or u[-1].isspace():
                del known[u]
        return met

    def _learn(self, new: list[str]) -> bool:
        """One walk over the new units of a text, cut where they end. Only the last of them may end in white space, as in the text."""
        found = align_text(" ".join(new), self.folder)
        if found is None:
            return False
        a, b, ends_a, ends_b = found
        in_a, in_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        group_ends = np.cumsum(self.sizes[a])[ends_a - 1]
        unit_ends = np.cumsum([len(u.encode()) + 1 for u in new])
        last = np.searchsorted(group_ends, unit_ends)
        if (in_a * in_b).max() > LARGE_GROUP or last[-1] >= len(group_ends) or (group_ends[last] != unit_ends).any():
            return False
        counts = np.stack([np.diff(e[last], prepend=0) for e in (ends_a, ends_b)], 1).astype(np.int32).tobytes()
        groups = groups_text(a, b, ends_a, ends_b).split(b";")
        links = link_pairs(a, b, in_a, in_b, ends_b).astype(np.int32).tobytes()
        links_end = (np.cumsum(in_a * in_b)[last] * 4).tolist()
        g = w = 0
        for k, (u, to, end) in enumerate(zip(new, (last + 1).tolist(), links_end, strict=True)):
            self.known[u] = counts[8 * k : 8 * k + 8], groups[g] if to == g + 1 else b";".join(groups[g:to]), links[w:end]
            g, w = to, end
        return True


@cache
def _aligner(folder: str) -> Aligner:
    return Aligner(folder)


def aligned_rows(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row per document: sizes, the hash of its groups, and its distinct linked pairs, packed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, most=SLICE_BYTES):
                out, seen = [], {}
                for text in part.column("text").to_pylist():
                    if text not in seen:
                        seen[text] = _aligner(folder).row(text)
                    out.append(seen[text])
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                made = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("doc_id"), *made], [x.split()[0] for x in ROWS.split(", ")])

    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(rows, ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): in how many documents each pair is linked; blocks of documents are summed before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, pairs, _ in blocks(batch):
                pairs, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(n)], ["pair", "n"])

    part = rows.where("pairs IS NOT NULL").select("row_id", "pairs").mapInArrow(counted, "pair int, n long")
    return part.groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, folder: str = TOKENIZERS, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: see the module's text."""
    rows = materialize(aligned_rows(docs, folder), "align-rows")
    counts = materialize(pair_counts(rows), "align-counts")
    # at most one row per id of A: bounded by the vocabulary
    best = F.broadcast(counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n").alias("most")))
    known = counts.join(best, F.shiftright("pair", B_BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = total // hot + 1  # fewer than ``hot`` pairs reach it
    top = known.where(F.col("n") >= least).orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(np.asarray(top[c].to_numpy()) for c in ("pair", "n", "best")))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document with the sums over its frequent pairs (pair null), and a row for each other pair."""
        pair, n, is_best = shared.value
        for batch in batches:
            for ids, sizes, pairs, links in blocks(batch):
                at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
                hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
                row = np.repeat(np.arange(len(ids)), sizes)
                sums = [np.zeros(len(ids), np.int64) for _ in range(2)]
                for total, weight in zip(sums, (is_best[at[hit]], n[at[hit]]), strict=True):
                    np.add.at(total, row[hit], links[hit] * weight)
                lost = ~hit
                none = np.zeros(lost.sum(), np.int64)
                columns = [
                    pa.array(np.concatenate([ids, ids[row[lost]]])), pa.array(np.concatenate([np.zeros(len(ids), np.int32), pairs[lost].astype(np.int32)]), mask=np.arange(len(ids) + len(none)) < len(ids)),
                    pa.array(np.concatenate([np.zeros(len(ids), np.int64), links[lost]])), *(pa.array(np.concatenate([total, none])) for total in sums),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "pair", "links", "n_best", "count_sum"])

    found = materialize(rows.where("pairs IS NOT NULL").select("row_id", "pairs").mapInArrow(looked_up, "row_id long, pair int, links long, n_best long, count_sum long"), "align-found")
    rare = found.where("pair IS NOT NULL").join(known.where(F.col("n") < least), "pair")
    rare = rare.select("row_id", F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    sums = found.where("pair IS NULL").select("row_id", "n_best", "count_sum").unionByName(rare).groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = rows.drop("pairs").join(sums, "row_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
