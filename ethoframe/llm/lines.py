"""Line dedup: fuzzy lines by MinHash over character shingles, exact Jaccard, and one line kept per component.

A line is what stands between line ends, without blanks at its ends; blank lines are never judged. Its shingles are its runs of ``SHINGLE``
UTF-16 units (a shorter line is one shingle). Signatures are minima of a shingle hash under BANDS * ROWS masks; lines that agree on all ROWS minima
of a band are candidates. Long lines take the minima over the quarter of shingles whose hash ends in 00, which is the same choice of
shingles in all lines; lines near the border, and longer ones whose head, or sample and head, show few distinct shingles (rulers, repeated phrases), have both signatures, so
that two lines whose numbers of distinct shingles allow the threshold have one of the same kind.

First candidates of a bucket are its lines with the bucket's smallest and largest line, so a bucket of any size gives two per line; components
join what several bands link. In large buckets a round of centres follows, lines of the largest component with which all others are compared. Buckets whose other lines are still in different components (templated lines) go into an exact join: lines at
the threshold share one of the first ``n - ceil(threshold * n) + 1`` of their n shingles in any fixed order, and the order puts shingles of many
lines last. Links inside a component cannot change any class, so no link between two lines of a bucket is lost. A candidate links if the exact
Jaccard index of the shingle sets is at least ``threshold``. The kept line of a component is its first one, by doc_id, hash of the text, and line number.

Everything runs as DataFrame expressions. Lines are named by a 64-bit hash (two of n different lines share one with probability below
n * n / 2**65).

Nulls and edges: a null text has no lines and stays null; a null doc_id sorts first; equal lines are one node; rows are known by doc_id and a hash of the text, so
rows that share a doc_id, or have none, are cut each by its own lines, and of rows that share both one is judged by its lines and the others lose all of theirs; lines of any length are compared whole; an empty table gives an
empty result. Columns of docs pass through; n_lines and n_removed are set.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoframe.llm.common import BROADCAST_ROWS, bound, broadcast_up_to, materialize
from ethoframe.llm.graph import components

SHINGLE = 10
#: What is no part of a line at its ends.
BLANKS = " \t\r\f\x0b"
BANDS, ROWS = 8, 3
THRESHOLD = 0.75
#: Lines with more shingles than this have a signature over every fourth; up to SHORT / THRESHOLD distinct ones they have the full one, too.
SHORT = 128
#: SHORT / THRESHOLD distinct shingles leave 43 in the sample, which set 37 of 128 bits on average, and more than this in less than one line of 1,000.
FEW_BITS = 50
#: So many shingles more than that at the head of such a line are looked at to see that it has more distinct ones.
SPARE = 24
#: The heads of lines with up to so many shingles are looked at in any case: the sample of one with more sets few bits only if shingles repeat.
LONG = 384
#: Masks of the permutations, an arithmetic progression on the golden ratio, so that their leading bits differ.
MASKS = [(0x9E3779B9 * (i + 1)) % 2**32 - 2**31 for i in range(BANDS * ROWS)]
REMOVED_LINES = 5_000_000
#: Shingles of about this many lines of mixed buckets, and more, stand last in the order of the exact join.
HOT = 16
#: Sketches (of about 100 bytes) that may be broadcast.
SKETCH_ROWS = 100_000
#: Longs of a sketch: 64 parities each.
SKETCH = 12
#: Buckets with more lines than LARGE have ROUNDS rounds (a second one found 3 links where the first found 291) in which their lines are compared with CENTRES lines of the bucket's largest component.
LARGE, ROUNDS, CENTRES = 32, 1, 3


def _trimmed(line: Column) -> Column:
    """Most lines have no blanks at their ends, and trim() looks at every character to cut the right end."""
    return F.when(reduce(or_, (end(line, F.lit(c)) for c in BLANKS for end in (F.startswith, F.endswith))), F.trim(line, F.lit(BLANKS))).otherwise(line)


def _is_blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)) == ""


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """One row per line that is not blank: the columns named, line_no and line."""
    cut = docs.select(*more, F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    return cut.withColumn("line", _trimmed(F.col("line"))).where("line <> ''")


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _size(units: Column) -> Column:
    """Shingles of a line, repeats counted."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(units) / 2).cast("int") - SHINGLE + 1)


def _places(size: Column) -> Column:
    """Where the shingles begin in a line's units, in bytes from 1."""
    return F.sequence(F.lit(1), size * 2 - 1, F.lit(2))


def _shingle(units: Column, place: Column) -> Column:
    return F.substring(units, place, F.lit(2 * SHINGLE))


def _minima(rows: DataFrame, *more: Column) -> DataFrame:
    """id, kind (0: all shingles, 1 and 2: the sample), bands (a key for each band; null if no shingle is in the sample) and more, summed up before and after one shuffle; rows: id, units, size, kinds."""
    rows = rows.select("id", "units", "size", F.explode_outer("kinds").alias("kind"))
    at = rows.select("id", "kind", "units", F.explode_outer(_places(F.col("size"))).alias("i"))
    hashed = at.select("id", "kind", "i", F.hash(_shingle(F.col("units"), F.col("i"))).alias("h"))
    taken = hashed.withColumn("h", F.when((F.col("kind") == 0) | (F.col("h").bitwiseAND(3) == 0), F.col("h"))).where("h IS NOT NULL OR i = 1")
    minima = taken.groupBy("id", "kind").agg(*(F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(MASKS)), *more)
    keys = F.array(*(F.xxhash64(F.lit(b), F.least("kind", F.lit(1)), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)))
    return minima.select("id", "kind", F.when(F.col("m0").isNotNull(), keys).alias("bands"), *(c for c in minima.columns if c.startswith("seen")))


def _signatures(docs: DataFrame, threshold: float) -> DataFrame:
    """id, bands of each distinct line and kind. Long lines whose head shows few distinct shingles get the full signature, too; beyond LONG only if the sample sets few of 128 bits."""
    named = _lines(docs).select(F.xxhash64("line").alias("id"), "line")
    sized = lambda lines: lines.select("id", "line", _units(F.col("line")).alias("units")).withColumn("size", _size(F.col("units")))
    rows = sized(named)
    border = int(SHORT / threshold) + 1
    few_ahead = F.size(_shingles(F.col("line"), border + SPARE)) <= border
    kinds = F.when(F.col("size") <= SHORT, F.array(F.lit(0))).when(F.col("size") > LONG, F.array(F.lit(2))).when((F.col("size") <= border) | few_ahead, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    bit = F.expr("shiftleft(1L, shiftrightunsigned(h, 3) & 63)")
    seen = [F.bit_or(F.when(F.col("h").bitwiseAND(4) == 4 * k, bit).otherwise(F.lit(0).cast("long"))).alias(f"seen{k}") for k in range(2)]
    first = materialize(_minima(rows.withColumn("kinds", kinds), *seen), "lines-signatures")
    few = materialize(first.where((F.col("kind") == 2) & (F.bit_count("seen0") + F.bit_count("seen1") <= FEW_BITS)).select("id"), "lines-few")
    # a table, so that heads are looked at after the join
    again = materialize(named.join(broadcast_up_to(few, few.count()), "id", "left_semi"), "lines-again")
    again = sized(again.where(few_ahead))
    full = materialize(_minima(again.withColumn("kinds", F.array(F.lit(0)))).select("id", "bands"), "lines-full")
    return first.select("id", "bands").unionByName(full)


def _buckets(signatures: DataFrame) -> DataFrame:
    """band, id, lo, hi: lines of buckets with several lines, with the smallest and largest line of the bucket."""
    banded = signatures.select("id", F.explode("bands").alias("band"))
    # a hot bucket is three sums before the shuffle, and its join is one that adaptive execution can split; most buckets have one line or two and need no join
    buckets = banded.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    buckets = materialize(buckets, "lines-shared")
    ends = buckets.select("band", F.explode(F.array("lo", "hi")).alias("id"), "lo", "hi")
    many = buckets.where("n > 2").select("band", "lo", "hi")
    inner = banded.join(broadcast_up_to(many, many.count()), "band").where("id <> lo AND id <> hi")
    return ends.unionByName(inner)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hashes(line: Column, most: int | None = None) -> Column:
    """64-bit hashes of the first ``most`` shingles, repeats included (sets of longs are hashed, sets of binaries compared one by one)."""
    size = (lambda u: _size(u)) if most is None else (lambda u: F.least(_size(u), F.lit(most)))
    return bound(_units(line), lambda u: F.transform(_places(size(u)), lambda i: F.xxhash64(_shingle(u, i))))


def _shingles(line: Column, most: int | None = None) -> Column:
    """The distinct ones of these hashes."""
    return F.array_distinct(_hashes(line, most))


def _alike(threshold: float) -> Column:
    """Whether sizes and sketches of lines a and b allow the threshold."""
    sizes = F.col("n_a") + F.col("n_b")
    apart = sum((F.bit_count(F.get("sketch_a", F.lit(k)).bitwiseXOR(F.get("sketch_b", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    return (1 + threshold) * apart <= (1 - threshold) * sizes + 1e-6


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float, label: str) -> DataFrame:
    """The pairs whose shingle sets reach the threshold."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", _hashes(F.col("line_a")).alias("x"), _hashes(F.col("line_b")).alias("y")).withColumn("most", F.size("x") + F.size("y"))
    both = both.select("a", "b", "most", "x", "y", F.size(F.array_union("x", "y")).alias("union"))
    # what both have is at most what they have in all less the union, so most pairs below the threshold need no intersection
    may = (1 + threshold) * F.col("union") <= F.col("most") + 1e-6
    both = both.select("a", "b", "union", F.when(may, F.size(F.array_intersect("x", "y"))).alias("overlap"))
    return materialize(both.where(F.col("overlap") >= threshold * F.col("union")).select("a", "b"), label)


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """id, component: lines that are neither first nor last in a bucket where such lines are in different components."""
    inner = rows.where("id <> lo AND id <> hi").select("band", "id").join(roots, "id", "left")
    inner = inner.select("band", "id", F.coalesce("component", "id").alias("component"))
    inner = materialize(inner, "lines-inner")
    split = inner.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    return materialize(inner.join(split, "band", "left_semi").select("id", "component").distinct(), "lines-mixed")


def _crossed(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b: lines of different components that a shared shingle, their sizes, its places and their sketches allow to reach the threshold."""
    some = mixed.count()
    opened = materialize(texts.join(broadcast_up_to(mixed, some), "id", "left_semi"), "lines-open")
    # lines are dealt by id first, so shingles are not shuffled to be put together
    single = opened.repartition("id").select("id", F.explode(_shingles(F.col("line"))).alias("s"))
    # every order gives the same links, so how often shingles stand is estimated: from every fourth line, by its hash
    fourth = opened.where(F.pmod("id", F.lit(4)) == 0).select(F.explode(_shingles(F.col("line"))).alias("s"))
    often = materialize(fourth.groupBy("s").agg((F.count("*") * 4).alias("often")).where(F.col("often") >= HOT), "lines-often")
    known = single.join(broadcast_up_to(often, often.count()), "s", "left")
    # rare shingles are negative and come first by hash; the others follow by frequency, then hash
    place = F.when(F.col("often").isNull(), F.col("s").bitwiseOR(-(2**63))).otherwise(F.shiftleft(F.least("often", F.lit(2**20)), 42).bitwiseOR(F.col("s").bitwiseAND(2**42 - 1)))
    bit = F.expr("shiftleft(1L, cast(shiftright(s, 20) & 63 AS int))")
    parities = [F.bit_xor(F.when(F.pmod("s", F.lit(SKETCH)) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(SKETCH)]
    # parities apart from the lists, as generated code
    sets = known.groupBy("id").agg(F.sort_array(F.collect_list(place)).alias("x")).join(single.groupBy("id").agg(*parities), "id").withColumn("n", F.size("x"))
    first = F.slice("x", 1, F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1)
    sets = materialize(sets.select("id", "n", first.alias("x"), F.array(*(f"p{k}" for k in range(SKETCH))).alias("sketch")).join(broadcast_up_to(mixed, some), "id"), "lines-sets")
    prefix = sets.select("id", "component", F.posexplode("x").alias("at", "s"))
    same = F.struct(F.count("*").alias("lines"), F.bit_xor(F.xxhash64("id")).alias("which"))
    columns = prefix.groupBy("s").agg(same.alias("column"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("s", "column")
    columns = prefix.join(columns, "s").groupBy("column", "id", "component").agg(F.min("at").alias("at"))
    prefix = materialize(columns, "lines-columns").join(broadcast_up_to(sets.select("id", "n", "sketch"), some, SKETCH_ROWS), "id")
    side = lambda x: prefix.select("column", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "at", "sketch")))
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    allowed = (1 + threshold) * most >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-6
    pairs = side("a").join(side("b"), "column").where((F.col("component_a") < F.col("component_b")) & allowed & _alike(threshold))
    return materialize(_ordered(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))), "lines-crossed")


def _centred(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: lines of large buckets with CENTRES lines of the component that has most of the bucket's lines, if they are in other ones."""
    named = rows.select("band", "id").join(roots, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    named = materialize(named, "lines-named")
    centres = [F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"c{k}") for k in range(CENTRES)]
    parts = named.groupBy("band", "component").agg(F.count("*").alias("n"), *centres)
    leads = parts.groupBy("band").agg(F.sum("n").alias("rows"), F.count("*").alias("parts"), F.max_by(F.struct("component", *(f"c{k}" for k in range(CENTRES))), F.struct("n", "component")).alias("lead"))
    leads = leads.where((F.col("parts") > 1) & (F.col("rows") > LARGE)).select("band", "lead")
    others = named.join(leads, "band").where(F.col("component") != F.col("lead.component"))
    return materialize(_ordered(others.select(F.col("id").alias("a"), F.explode(F.array(*(f"lead.c{k}" for k in range(CENTRES)))).alias("b"))), "lines-centred")


def line_components(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id, component): lines with a link, and the smallest line that they reach; (doc_id, mark, line_no, id): where all lines stand."""
    rows = materialize(_buckets(_signatures(docs, threshold)), "lines-buckets")
    pairs = materialize(_ordered(rows.select(F.col("id").alias("a"), F.explode(F.array("lo", "hi")).alias("b"))), "lines-pairs")
    wanted = materialize(rows.select("id").distinct(), "lines-wanted")
    # one pass over the texts for both
    wanted = wanted.withColumn("wanted", F.lit(True))
    places = _lines(docs, "doc_id", "mark").withColumn("id", F.xxhash64("line")).join(broadcast_up_to(wanted, wanted.count()), "id", "left")
    places = materialize(places.select("doc_id", "mark", "line_no", "id", F.when(F.col("wanted"), F.col("line")).alias("line")), "lines-places")
    texts = materialize(places.where("line IS NOT NULL").groupBy("id").agg(F.min("line").alias("line")), "lines-texts")
    places = places.drop("line")
    links = _linked(pairs, texts, threshold, "lines-links")
    roots = materialize(components(links), "lines-roots")
    for _ in range(ROUNDS):
        centred = _centred(rows, roots)
        if not centred.limit(1).count():
            break
        links = links.unionByName(_linked(centred, texts, threshold, "lines-centrelinks"))
        roots = materialize(components(links), "lines-roots")
    mixed = _mixed(rows, roots)
    if mixed.limit(1).count():
        found = _linked(_crossed(mixed, texts, threshold), texts, threshold, "lines-crosslinks")
        if found.limit(1).count():
            roots = materialize(components(links.unionByName(found)), "lines-all-roots")
    return roots, places


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with text shortened to the kept lines, n_lines (lines that are not blank) and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    text = F.col("text").cast("string")
    slim = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    roots, places = line_components(slim, threshold)
    roots = roots.withColumnRenamed("component", "root")
    place = F.struct("doc_id", "mark", "line_no")
    known = places.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(roots, "id", "left").where("n > 1 OR root IS NOT NULL")
    known = materialize(known.select("id", F.coalesce("root", "id").alias("root"), "first"), "lines-known")
    keep = materialize(known.groupBy("root").agg(F.min("first").alias("keep")), "lines-keep")
    keep = materialize(known.join(keep, "root").select("id", "keep"), "lines-kept")
    gone = places.join(keep, "id").where(~place.eqNullSafe(F.col("keep"))).select("doc_id", "mark", "line_no")
    gone = gone.groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("gone"))
    gone = materialize(gone, "lines-gone")
    rows, numbers = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    if numbers <= REMOVED_LINES:
        gone = broadcast_up_to(gone, rows, BROADCAST_ROWS)
    docs = _with_repeats(docs, slim)
    gone = gone.select(F.col("doc_id").alias("line_doc"), F.col("mark").alias("line_mark"), F.col("gone").alias("line_gone"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("line_doc")) & (F.xxhash64(text) == F.col("line_mark")), "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("line_gone"), i))
    blank = F.array_join(F.filter(lines, _is_blank), "\n")
    text = F.when(F.col("line_again"), blank).when(F.col("line_gone").isNull(), F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: ~_is_blank(x))), F.lit(0))
    n_removed = F.when(F.col("line_again"), n_lines).otherwise(F.coalesce(F.size("line_gone"), F.lit(0)))
    computed = {"n_lines": n_lines.cast("long"), "n_removed": n_removed.cast("long")}
    passed = [c for c in docs.columns if c != "line_again"]
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in passed), *(computed[c].alias(c) for c in ("n_lines", "n_removed")))


def _with_repeats(docs: DataFrame, slim: DataFrame) -> DataFrame:
    """docs with line_again: true in all but one of the rows that share doc_id and text.

    Only rows that repeat each other are written, with numbers of their own; a group of any size is a minimum, summed up before its shuffle.
    """
    named = lambda df: df.select(F.col("doc_id").alias("line_doc"), F.col("mark").alias("line_mark"), *(c for c in df.columns if c not in ("doc_id", "mark")))
    repeated = named(materialize(slim.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "mark"), "lines-repeated"))
    rows = repeated.count()
    if not rows:
        return docs.withColumn("line_again", F.lit(False))
    repeated, mark = broadcast_up_to(repeated, rows), F.xxhash64(F.col("text").cast("string"))
    same = F.col("doc_id").eqNullSafe(F.col("line_doc")) & (mark == F.col("line_mark"))
    again = materialize(docs.join(repeated, same, "left_semi").withColumn("line_row", F.monotonically_increasing_id()), "lines-rows")
    first = named(again.groupBy("doc_id", mark.alias("mark")).agg(F.min("line_row").alias("line_first")))
    again = again.join(broadcast_up_to(first, rows), same).withColumn("line_again", F.col("line_row") != F.col("line_first"))
    alone = docs.join(repeated, same, "left_anti").withColumn("line_again", F.lit(False))
    return alone.unionByName(again.select(*docs.columns, "line_again"))
