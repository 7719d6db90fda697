"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents are classes of equal n-gram sets, so copies are one row of the matrix. Its columns are dealt to blocks by n-gram; a block
multiplies its columns with themselves and keeps a pair only where its sizes and the places of the shared n-gram still allow the
threshold. As an n-gram set of size n must share ``ceil(threshold * n)`` of its elements with any partner, only the first
``n - ceil(threshold * n) + 1`` n-grams of a fixed global order take part (no pair is lost by this, whatever the order). The order puts
n-grams that many documents share last, then follows the hash: boilerplate hardly ever enters the product.

Columns with more than FEW rows are not multiplied out at once. Their rows are first compared with the column's smallest and largest
document, and these links are joined to components. What a column then still holds apart is screened in full, tile by tile, by sketches: BINS
parities of the n-grams' hashes. Every n-gram that only one of two sets has flips one parity, so sets whose sketches differ in more bins than the
threshold allows n-grams of one side only can not link, and unlike documents are dropped without a row. Of those left, each document's
nearest partners are verified first; once their components are joined, all that are still apart are. Links inside a component cannot change any
class, so nothing is lost.

N-grams and sets are named by 64-bit hashes: two of k different n-grams of the table share one with probability below k * k / 2**65.

Nulls and edges: null and empty texts have size 0 and link with nothing; a text with fewer words than the n-gram has its whole sequence
as one; every row is a node of its own, so rows that share a doc_id may be in different components; component_id is the smallest doc_id of the
component's rows, null if none has one; ties in size go to the smaller class; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoframe.llm import tokens
from ethoframe.llm.common import broadcast_up_to, materialize
from ethoframe.llm.graph import components

WIDTH = 5
#: The threshold is NUMERATOR / DENOMINATOR, so that no comparison rounds.
NUMERATOR, DENOMINATOR = 75, 100
FEW = 6
#: N-grams in at least this many classes, as far as chunks of CHUNK n-grams show it, stand last in the order; at most HOT_LIMIT of them.
HOT, HOT_LIMIT = 16, 1_000_000
CHUNK = 1_000_000
BLOCK_ROWS = 800_000
HOT_CENTERS = 4
#: Share of a set on which pairs are bounded before whole sets are compared.
PART = 0.3
#: Bins of a sketch, rows of a tile, and pairs screened at once.
BINS, TILE, PAIRS = 1024, 4096, 200_000


def ngram_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the distinct n-grams of each text, sorted by hash."""
    h, starts = tokens.hashed(texts, lower=True)
    sizes = np.diff(starts)
    doc = tokens.doc_of(starts)
    grams, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= width:
        first = np.arange(len(h) - width + 1)
        inside = doc[first] == doc[first + width - 1]
        grams, of = tokens.runs_of(h, width)[inside], doc[first][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        whole = [xxhash.xxh3_64_intdigest(h[starts[i] : starts[i + 1]].tobytes()) for i in short]
        grams, of = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    grams = grams.copy()
    bounds = np.searchsorted(of, np.arange(len(sizes) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        grams[a:b].sort()
    fresh = np.concatenate([[True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, bool)
    grams, of = grams[fresh], of[fresh]
    return grams, np.searchsorted(of, np.arange(len(sizes) + 1))


def _class(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def document_classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark (a hash of the text), n (size of the set), cls (equal for equal sets; null for empty ones)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                grams, starts = ngram_sets(part.column("text"), width)
                n = np.diff(starts)
                cls = [_class(grams[a:b]) if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(n.astype(np.int64)), pa.array(cls, pa.int64())], ["doc_id", "mark", "n", "cls"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(rows, "doc_id long, mark long, n long, cls long")


def _distinct_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(classes, sets) of a task, slice by slice; a class that the task has had already is left out."""
    seen: set[int] = set()
    for batch in batches:
        for part in tokens.slices(batch):
            grams, starts = ngram_sets(part.column("text"), width)
            classes, sets = [], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b > a and (c := _class(grams[a:b])) not in seen:
                    seen.add(c), classes.append(c), sets.append(grams[a:b])
            yield classes, sets


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """N-grams that stand last in the order: a bounded set, as only the HOT_LIMIT most frequent ones are taken. It steers the order alone."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(held: list[np.ndarray]) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(_signed(values[n > 1])), pa.array(n[n > 1].astype(np.int64))], ["s", "n"])

        held, size = [], 0
        for _, sets in _distinct_sets(batches, width):
            held, size = held + sets, size + sum(map(len, sets))
            if size >= CHUNK:
                yield often(held)
                held, size = [], 0
        if held:
            yield often(held)

    total = materialize(docs.mapInArrow(counts, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT), "ngram-frequent")
    if total.count() > HOT_LIMIT:
        total = total.orderBy(F.desc("n"), "s").limit(HOT_LIMIT)
    return np.sort(np.asarray(total.select("s").toArrow()["s"], dtype=np.int64))


def _columns(docs: DataFrame, hot: np.ndarray, width: int) -> DataFrame:
    """s, cls, n, at (place in the global order), hot: the incidences that take part in the product."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for classes, sets in _distinct_sets(batches, width):
            if not classes:
                continue
            sizes = np.array([len(x) for x in sets])
            flat = _signed(np.concatenate(sets))
            of = np.repeat(np.arange(len(sets)), sizes)
            often = np.zeros(len(flat), bool)
            if len(table):
                often = table[np.minimum(np.searchsorted(table, flat), len(table) - 1)] == flat
            if often.any():  # sets are sorted by hash already
                order = np.argsort(2 * of + often, kind="stable")
                flat, often = flat[order], often[order]
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = at < (sizes - -(-NUMERATOR * sizes // DENOMINATOR) + 1)[of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[keep]), pa.array(np.array(classes)[of[keep]]), pa.array(sizes[of[keep]].astype(np.int32)), pa.array(at[keep].astype(np.int32)), pa.array(often[keep])],
                ["s", "cls", "n", "at", "hot"],
            )

    return docs.mapInArrow(rows, "s long, cls long, n int, at int, hot boolean")


def _allowed(n_a, n_b, at_a, at_b):
    """Whether two sets can reach the threshold if this is their first shared n-gram; for numpy arrays and columns alike."""
    need = NUMERATOR * (n_a + n_b)  # of (NUMERATOR + DENOMINATOR) times the overlap
    whole = NUMERATOR + DENOMINATOR
    return ((n_a - at_a) * whole >= need) & ((n_b - at_b) * whole >= need)


def _multiply(block: DataFrame) -> DataFrame:
    """a, b (a < b): candidates of the columns with few rows, and centre pairs of the others; s, cls, n, at, hot of the latter and of frequent columns."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "s", "cls", "n", "at", "hot"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        held = []
        for batch in batches:
            often = np.asarray(batch.column("hot"))
            if often.any():
                passed = batch.filter(pa.array(often))
                columns = [passed.column(c) for c in names[2:]]
                yield pa.RecordBatch.from_arrays([pa.nulls(passed.num_rows, pa.int64())] * 2 + columns, names)
            if not often.all():
                held.append([np.asarray(batch.column(c))[~often] for c in ("s", "cls", "n", "at")])
        if not held:
            return
        s, cls, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(s)
        sorted_s = s[order]
        edge = np.concatenate([[True], sorted_s[1:] != sorted_s[:-1], [True]])
        order = order[~(edge[:-1] & edge[1:])]  # columns with one row have no product
        if not len(order):
            return
        s, cls, n, at = s[order], cls[order], n[order].astype(np.int64), at[order].astype(np.int64)
        order = np.lexsort((cls, n, s))
        s, cls, n, at = s[order], cls[order], n[order], at[order]
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (cls[1:] != cls[:-1])])
        s, cls, n, at = s[fresh], cls[fresh], n[fresh], at[fresh]
        head = np.concatenate([[True], s[1:] != s[:-1]])
        first = np.flatnonzero(head)
        rows = np.diff(np.concatenate([first, [len(s)]]))
        size, start = np.repeat(rows, rows), np.repeat(first, rows)
        left, right = [], []
        for step in range(1, FEW):  # each row with the row `step` further down its column
            i = np.flatnonzero((size <= FEW) & (np.arange(len(s)) - start + step < size))
            left.append(i), right.append(i + step)
        many = np.flatnonzero(size > FEW)
        for centre in (start[many], start[many] + size[many] - 1):
            left.append(many), right.append(centre)
        left, right = np.concatenate(left), np.concatenate(right)
        good = (left != right) & _allowed(n[left], n[right], at[left], at[right])
        a, b = np.minimum(cls[left[good]], cls[right[good]]), np.maximum(cls[left[good]], cls[right[good]])
        pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        k, m = pairs.shape[1], len(many)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *(pa.nulls(k, t) for t in types[2:])], names)
        rest = [pa.array(s[many]), pa.array(cls[many]), pa.array(n[many].astype(np.int32)), pa.array(at[many].astype(np.int32)), pa.array(np.zeros(m, bool))]
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64())] * 2 + rest, names)

    return block.mapInArrow(product, "a long, b long, s long, cls long, n int, at int, hot boolean")


def _possible(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int) -> bool:
    """Whether sets of n_x and n_y elements can reach the threshold, given their first elements in hash order (all of them: whether they do).

    Up to the smaller of the two last hashes both sets are known, so only what lies behind it is open.
    """
    known_x, known_y = len(x), len(y)
    if len(x) < n_x or len(y) < n_y:
        last = min(v[-1] for v, n in ((x, n_x), (y, n_y)) if len(v) < n)
        known_x, known_y = int(np.searchsorted(x, last, side="right")), int(np.searchsorted(y, last, side="right"))
    x, y = x[:known_x], y[:known_y]
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
    most = shared + min(n_x - known_x, n_y - known_y)
    return DENOMINATOR * most >= NUMERATOR * (n_x + n_y - most)


def _holders(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs such that each wanted class has one (or few equal ones)."""
    held = classes.join(wanted.select("cls").distinct(), "cls", "left_semi")
    held = materialize(held.select(F.coalesce("holder.doc_id", F.lit(0)).alias("held_id"), F.col("holder.mark").alias("held_mark")).distinct(), "ngram-holders")
    same = (F.coalesce("doc_id", F.lit(0)) == F.col("held_id")) & (F.xxhash64("text") == F.col("held_mark"))
    return docs.join(broadcast_up_to(held, held.count()), same, "left_semi")


def _compared(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, share: float) -> DataFrame:
    """The pairs that the first ``share`` of their sets, in hash order, leaves possible; with share 1 those that reach the threshold.

    A set goes to each of its pairs, so each pair is two rows of one shuffle.
    """
    pairs = materialize(pairs.select("a", "b", F.monotonically_increasing_id().alias("pair")), "ngram-compare")
    sides = materialize(pairs.select(F.explode(F.array("a", "b")).alias("cls"), "pair"), "ngram-sides")
    n_sides = sides.count()
    sides = broadcast_up_to(sides, n_sides)
    texts = _holders(docs, classes, sides)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, grams in _distinct_sets(batches, width):
            sizes = [len(g) for g in grams]
            parts = [g[: int(share * len(g)) + 1].tobytes() for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], ["cls", "size", "grams"])

    dealt = texts.mapInArrow(sets, "cls long, size long, grams binary").join(sides, "cls").repartition("pair").sortWithinPartitions("pair", "cls")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one = None, None
        for batch in batches:
            good = []
            for pair, cls, size, grams in zip(*(batch.column(c) for c in ("pair", "cls", "size", "grams")), strict=True):
                pair, cls, size, grams = pair.as_py(), cls.as_py(), size.as_py(), np.frombuffer(grams.as_py(), np.uint64)
                if pair == at and cls != one[0]:
                    if _possible(one[2], grams, one[1], size):
                        good.append((one[0], cls))
                at, one = pair, (cls, size, grams)
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], ["a", "b"])

    kept = dealt.mapInArrow(check, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(kept, "ngram-kept")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs whose exact sets reach the threshold; most others fall to a bound on a part of the sets first."""
    return _compared(docs, classes, _compared(docs, classes, pairs, width, PART), width, 1.0)


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sketches(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cls, sketch: the parity of a set's n-grams in each of BINS bins, as packed bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, grams in _distinct_sets(batches, width):
            bits = [np.packbits(np.bincount((g % np.uint64(BINS)).astype(np.int64), minlength=BINS) & 1 > 0).tobytes() for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(bits, pa.binary())], ["cls", "sketch"])

    made = _holders(docs, classes, wanted).mapInArrow(rows, "cls long, sketch binary")
    return materialize(made.groupBy("cls").agg(F.first("sketch").alias("sketch")), "ngram-sketches")


def _screen(column: pa.Table, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, differing bins) of pairs of one column or of two of its tiles that may link: of all, or of each row's nearest ones."""
    cls, n, at, component, tile = (np.asarray(column[c], dtype=np.int64) for c in ("cls", "n", "at", "component", "tile"))
    sketch = np.frombuffer(b"".join(column["sketch"].to_pylist()), np.uint64).reshape(len(cls), -1)
    one = np.flatnonzero(tile == tile.min())
    other = one if tile.min() == tile.max() and column["p"][0] == column["q"][0] else np.flatnonzero(tile != tile.min())
    found = []
    step = max(1, PAIRS // max(1, len(other)))
    for k in range(0, len(one), step):
        i, j = np.meshgrid(one[k : k + step], other, indexing="ij")
        i, j = i.ravel(), j.ravel()
        good = (component[i] != component[j]) & _allowed(n[i], n[j], at[i], at[j])
        if other is one:
            good &= i < j
        i, j = i[good], j[good]
        apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        # at the threshold, (DENOMINATOR - NUMERATOR) / (DENOMINATOR + NUMERATOR) of both sizes stand on one side only
        good = apart * (DENOMINATOR + NUMERATOR) <= (DENOMINATOR - NUMERATOR) * (n[i] + n[j])
        found.append((i[good], j[good], apart[good]))
    i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    if best and len(i):
        picked = []
        for side in (i, j):
            order = np.lexsort((apart, side))
            picked.append(order[np.concatenate([[True], side[order][1:] != side[order][:-1]])])
        i, j = i[np.concatenate(picked)], j[np.concatenate(picked)]
    return np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), apart


def _screened(open_: DataFrame, best: bool) -> DataFrame:
    """a, b: pairs of different components that the columns of open_ (with sketches) leave possible. A column of more than TILE rows is dealt as pairs of tiles."""
    tiles = F.ceil(F.col("rows") / TILE)
    dealt = open_.withColumn("tile", F.pmod(F.xxhash64("cls"), tiles)).withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    dealt = dealt.select("s", F.least("tile", "mate").alias("p"), F.greatest("tile", "mate").alias("q"), "tile", "cls", "n", "at", "component", "sketch")
    dealt = dealt.repartition("s", "p", "q").sortWithinPartitions("s", "p", "q")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b, _ = _screen(pa.Table.from_batches(held), best)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, at = [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("s", "p", "q")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if first == last:
                    continue
                key = tuple(keys[:, first].tolist())
                if held and key != at:
                    yield finish(held)
                    held = []
                held.append(batch.slice(first, last - first))
                at = key
        if held:
            yield finish(held)

    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def _open(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (s, cls, ...) of columns whose rows are in several components, with component and the column's number of rows."""
    roots = materialize(components(links), "ngram-roots").withColumnRenamed("id", "cls")
    rooted = materialize(rows.drop("component", "rows").join(roots, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "ngram-rooted")
    split = rooted.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("s", "rows")
    return materialize(rooted.join(split, "s"), "ngram-open")


def _components_of(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(members; cls, component): the rows of docs with their classes, and the components of the classes."""
    members = materialize(document_classes(docs, width), "ngram-members")
    named = members.where("cls IS NOT NULL")
    holder = F.min_by(F.struct("doc_id", "mark"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark")))
    classes = materialize(named.groupBy("cls").agg(holder.alias("holder"), F.max("n").alias("n")), "ngram-classes")
    hot = _frequent(docs, width)
    columns = _columns(docs, hot, width)
    kept = F.col("n") - F.ceil(NUMERATOR * F.col("n") / DENOMINATOR) + 1
    incidences = classes.agg(F.coalesce(F.sum(kept), F.lit(0)).alias("k")).first()["k"]
    # rows of frequent n-grams only pass through, so they are dealt by class as well
    salt = F.when(F.col("hot"), F.pmod("cls", F.lit(997))).otherwise(0)
    blocks = columns.withColumn("salt", salt).repartition(max(1, -(-int(incidences) // BLOCK_ROWS)), "s", "salt")
    product = materialize(_multiply(blocks), "ngram-product")
    # columns of frequent n-grams are never gathered: centres are minima and maxima, summed before the shuffle
    often = materialize(product.where("hot").select("s", "cls", "n", "at").distinct(), "ngram-often")
    near = often.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "s", "n"))), 1, HOT_CENTERS).alias("few")).select("cls", F.inline("few"))
    centre = lambda f, name: f(F.struct("n", "cls")).alias(name)
    centres = near.groupBy("s").agg(centre(F.min, "lo"), centre(F.max, "hi"))
    starred = near.join(centres, "s").select("cls", "n", F.explode(F.array("lo", "hi")).alias("c")).select(F.col("cls").alias("a"), F.col("c.cls").alias("b"), "n", F.col("c.n").alias("m"))
    starred = starred.where((F.least("n", "m") * DENOMINATOR >= F.greatest("n", "m") * NUMERATOR)).select("a", "b")
    pairs = materialize(_distinct_pairs(product.where("a IS NOT NULL").select("a", "b").unionByName(starred)), "ngram-pairs")
    links = _verified(docs, classes, pairs, width)
    # the rest: columns whose rows are still in different components
    large = product.where("cls IS NOT NULL AND NOT hot").select("s", "cls", "n", "at").unionByName(often)
    open_ = _open(large, links)
    if open_.limit(1).count():
        open_ = open_.join(_sketches(docs, classes, open_, width), "cls")
        for best in (True, False):
            left = materialize(_screened(open_, best).join(pairs, ["a", "b"], "left_anti"), "ngram-screened")
            if left.limit(1).count():
                links, pairs = links.unionByName(_verified(docs, classes, left, width)), pairs.unionByName(left)
            if best:
                open_ = _open(open_, links)
    roots = materialize(components(links), "ngram-all-roots")
    found = named.select("cls").distinct().join(roots.withColumnRenamed("id", "cls"), "cls", "left")
    return members, materialize(found.select("cls", F.coalesce("component", "cls").alias("component")), "ngram-components")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def jaccard_classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    members, found = _components_of(_plain(docs), width)
    rooted = members.join(found, "cls", "left")
    least = materialize(rooted.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id")), "ngram-least")
    return rooted.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last), then the smallest hash of its text; of equal rows one stays.

    Rows without words stay.
    """
    members, found = _components_of(_plain(docs), width)
    rooted = materialize(members.join(found, "cls").select("component", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark").alias("row")), "ngram-rooted-rows")
    kept = materialize(rooted.groupBy("component").agg(F.min("row").alias("row"), F.count("*").alias("rows")).where("rows > 1"), "ngram-kept-rows")
    rows = rooted.groupBy("component", "row").agg(F.count("*").alias("n")).join(kept.withColumnRenamed("row", "best"), "component")
    fate = F.when(F.col("row") != F.col("best"), "goes").when(F.col("n") > 1, "once")
    fates = rows.select(F.coalesce("row.doc_id", F.lit(0)).alias("fate_id"), F.col("row.unnamed").alias("fate_unnamed"), F.col("row.mark").alias("fate_mark"), fate.alias("fate")).where("fate IS NOT NULL")
    fates = materialize(fates.distinct(), "ngram-fates")
    doc_id, mark = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    same = (F.coalesce(doc_id, F.lit(0)) == F.col("fate_id")) & (doc_id.isNull() == F.col("fate_unnamed")) & (mark == F.col("fate_mark"))
    judged = docs.join(broadcast_up_to(fates, fates.count()), same, "left")
    out = judged.where("fate IS NULL").select(*(docs[c] for c in docs.columns))
    if fates.where("fate = 'once'").limit(1).count():
        twice = judged.where("fate = 'once'").groupBy("fate_id", "fate_unnamed", "fate_mark").agg(F.first(F.struct(*(docs[c] for c in docs.columns))).alias("row"))
        out = out.unionByName(twice.select("row.*"))
    return out
