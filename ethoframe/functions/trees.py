"""Nested values as tables of paths: JSON and XML trees of any depth, their leaves, values set by path, trees rebuilt from leaves, JSON inside texts.

A tree is a VARIANT. A path is an array of steps (key, pos): key is null for an element of an array, pos for a member of an object. Objects have no order; members come
by key. Trees are walked six levels in a plan, to rows of leaves or, in from_leaves(), to an array in the row of the tree. A JSON text is written leaf by leaf in the order of
their paths; elements are rebuilt with a plan per level.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ethoframe.shared import materialize

STEP = "struct<key:string,pos:int>"


def json_tree(text: Column) -> Column:
    """The tree of a JSON text; null if it isn't one."""
    return F.try_parse_json(text)


def xml_tree(text: Column, attributes: str = "@", content: str = "#text", types: bool = True) -> Column:
    """The simplified tree of an XML element: attributes and children are members, repeated children an array, an element that has only text is that text.

    Numbers and booleans get their types unless types is off. Evaluated inside a lambda, which keeps the parser out of generated code.
    """
    options = {"attributePrefix": attributes, "valueTag": content, "inferSchema": str(types).lower(), "mode": "PERMISSIVE"}
    return F.transform(F.array(text), lambda t: F.from_xml(t, "variant", options))[0]


LEVELS = 6


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use() names it."""
    return F.transform(F.array(value), use)[0]


def _spread(nodes: Column) -> Column:
    """Nodes (path, value, leaf) replaced by their children; one without children becomes a leaf."""

    def node(path: Column, value: Column, leaf: bool) -> Column:
        return F.struct(path.alias("path"), value.alias("value"), F.lit(leaf).alias("leaf"))

    def below(n: Column, key: Column, pos: Column, value: Column) -> Column:
        return node(F.array_append(n["path"], F.struct(key.cast("string").alias("key"), pos.cast("int").alias("pos"))), value, False)

    def children(n: Column) -> Column:
        members, elements = (F.try_variant_get(n["value"], "$", t) for t in ("map<string,variant>", "array<variant>"))
        # an element is looked for only in what is no object
        listed = _bound(elements, lambda x: F.when(F.size(x) > 0, F.transform(x, lambda v, i: below(n, F.lit(None), i, v))).otherwise(F.array(node(n["path"], n["value"], True))))
        return _bound(members, lambda x: F.when(F.size(x) > 0, F.transform(F.map_entries(x), lambda e: below(n, e["key"], F.lit(None), e["value"]))).otherwise(listed))

    return F.flatten(F.transform(nodes, lambda n: F.when(n["leaf"], F.array(n)).otherwise(children(n))))


def from_leaves(df: DataFrame, ids: Sequence[str], tree: str, make: Callable[[Column], Column], name: str) -> DataFrame:
    """ids and make(leaves) of each tree, leaves being an array of (path, json), in any order. A null tree has no row.

    A tree stays in its row. A plan walks six levels; of deeper trees what was reached is stored and walked on.
    """
    root = F.array(F.struct(F.expr(f"CAST(array() AS array<{STEP}>)").alias("path"), F.col(tree).alias("value"), F.lit(False).alias("leaf")))
    todo, found = df.where(F.col(tree).isNotNull()).select(*ids, root.alias("_nodes")), []
    while True:
        nodes = F.col("_nodes")
        for _ in range(LEVELS):
            nodes = _spread(nodes)
        walked = todo.select(*ids, nodes.alias("_nodes")).withColumn("_open", F.exists("_nodes", lambda n: ~n["leaf"]))
        leaves = F.transform("_nodes", lambda n: F.struct(n["path"].alias("path"), F.to_json(n["value"]).alias("json")))
        made = F.when(~F.col("_open"), make(leaves))
        stored = materialize(walked.select(*ids, "_open", made.alias(name), F.when(F.col("_open"), F.col("_nodes")).alias("_nodes")), "tree-leaves")
        found.append(stored.where("NOT _open").select(*ids, name))
        todo = stored.where("_open").select(*ids, "_nodes")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, found)


def leaf_paths(df: DataFrame, ids: Sequence[str], tree: str) -> DataFrame:
    """ids, path, depth, json: every leaf with its value as JSON text. Empty objects and arrays are leaves; a null tree has none.

    A plan walks six levels: a node is replaced by its children, one without children stays. Only what may have more children is read again.
    """
    level = df.select(*ids, F.expr(f"CAST(array() AS array<{STEP}>)").alias("path"), F.col(tree).alias("value")).where(F.col("value").isNotNull())
    found = []
    while True:
        for _ in range(LEVELS):
            spread = level.select(*ids, "path", "value").lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("value").outer()).toDF("_pos", "_key", "_value"))
            whole = F.col("_pos").isNull()
            step = F.struct(F.col("_key").alias("key"), F.when(F.col("_key").isNull(), F.col("_pos")).alias("pos")).cast(STEP)
            level = spread.select(*ids, F.when(whole, F.col("path")).otherwise(F.array_append("path", step)).alias("path"), F.when(whole, F.col("value")).otherwise(F.col("_value")).alias("value"), whole.alias("_leaf"))
        level = materialize(level.withColumns({"json": F.when(F.col("_leaf"), F.to_json("value")), "value": F.when(~F.col("_leaf"), F.col("value"))}), "tree-level")
        found.append(level.where("_leaf").select(*ids, "path", F.size("path").alias("depth"), "json"))
        level = level.where(~F.col("_leaf"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def path_text(path: Column) -> Column:
    """``orders[0].lines[2].price``"""
    steps = F.transform(path, lambda s: F.when(s["key"].isNull(), F.concat(F.lit("["), s["pos"].cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), s["key"])))
    return F.regexp_replace(F.array_join(steps, ""), "^\\.", "")


def path_of(*steps: str | int) -> Column:
    """A literal path: texts are keys, numbers are positions."""
    one = lambda s: F.struct(F.lit(s if isinstance(s, str) else None).cast("string").alias("key"), F.lit(None if isinstance(s, str) else s).cast("int").alias("pos"))
    return F.array(*map(one, steps))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("k")))
    return F.when(F.regexp_like(text, F.lit(r"^[ !#-\[\]-~]*$")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.substr(whole, F.lit(6), F.char_length(whole) - 6))


def _gather(leaves: DataFrame, ids: Sequence[str], value: str, node) -> DataFrame:
    """Bottom up, a plan per level: node(children, is_array) makes a parent's value of its children (key, pos, value), which are sorted."""
    deepest = leaves.agg(F.max(F.size("path"))).first()[0] or 0
    current = leaves.select(*ids, "path", value)
    for depth in range(deepest, 0, -1):
        low = current.where(F.size("path") == depth).withColumns({"_step": F.element_at("path", -1), "path": F.slice("path", 1, depth - 1)})
        children = F.array_sort(F.collect_list(F.struct(F.col("_step.key").alias("key"), F.col("_step.pos").alias("pos"), F.col(value).alias("value"))))
        grown = low.groupBy(*ids, "path").agg(children.alias("_c")).select(*ids, "path", node(F.col("_c")).alias(value))
        current = materialize(current.where(F.size("path") < depth).unionByName(grown), "tree-grown")
    return current.select(*ids, value)


def _shared(path: Column, other: Column) -> Column:
    """How many steps two paths of leaves share: the last step of either isn't one, as a leaf holds nothing."""
    first = F.array_position(F.zip_with(path, other, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
    least = F.least(F.size(path), F.size(other)) - 1
    return F.when(first < 0, least).otherwise(F.least(first, least))


def _placed(leaves: Column, use: Callable[[Column], Column]) -> Column:
    """use() of the leaves, which have a path, in their order, each with shared, the steps that it shares with the leaf before it, and after, those with the next (-1: none)."""
    shared = lambda of: F.transform(of, lambda x, i: F.when(i == 0, F.lit(-1)).otherwise(_shared(x["path"], F.get(of, i - 1)["path"])))
    zipped = lambda of, c: F.transform(of, lambda x, i: F.struct(x.alias("leaf"), F.get(c, i).alias("shared"), F.coalesce(F.get(c, i + 1), F.lit(-1)).alias("after")))
    return _bound(F.sort_array(leaves), lambda of: _bound(shared(of), lambda c: _bound(zipped(of, c), use)))


def json_of(leaves: Column) -> Column:
    """The JSON text of a tree whose leaves (path, json) are given, members by key, elements by position.

    A leaf writes what its path opens beyond the leaf before it, its value, and what it closes before the next one.
    """

    def text(of: Column) -> Column:
        # a container that has both elements and members is an array: elements come first
        switched = lambda x, i: (x["shared"] >= 0) & F.get(x["leaf"]["path"], x["shared"])["key"].isNotNull() & F.get(F.get(of, i - 1)["leaf"]["path"], x["shared"])["key"].isNull()
        return _bound(F.transform(F.filter(of, switched), lambda x: F.slice(x["leaf"]["path"], F.lit(1), x["shared"])), lambda mixed: F.array_join(F.transform(of, lambda x: piece(x, mixed)), ""))

    def piece(x: Column, mixed: Column) -> Column:
        path, n, new, shut = x["leaf"]["path"], F.size(x["leaf"]["path"]), F.greatest(x["shared"], F.lit(0)), x["after"] + 1
        element = lambda step, d: step["key"].isNull() | ((F.size(mixed) > 0) & F.array_contains(mixed, F.slice(path, F.lit(1), d)))
        comma = lambda k: (k == 0) & (x["shared"] >= 0)
        opened = lambda step, k: F.when(element(step, new + k), F.when(comma(k), F.lit(",")).otherwise(F.lit("["))).otherwise(F.concat(F.when(comma(k), F.lit(",")).otherwise(F.lit("{")), _quoted(step["key"]), F.lit(":")))
        closed = lambda step, k: F.when(element(step, shut + k), F.lit("]")).otherwise(F.lit("}"))
        opens = F.transform(F.slice(path, new + 1, n - new), opened)
        closes = F.when(n > shut, F.array_join(F.reverse(F.transform(F.slice(path, shut + 1, n - shut), closed)), "")).otherwise(F.lit(""))
        return F.concat(F.array_join(opens, ""), x["leaf"]["json"], closes)

    return _placed(F.transform(leaves, lambda x: F.struct(x["path"].alias("path"), x["json"].alias("json"))), text)


def tree_text(leaves: DataFrame, ids: Sequence[str]) -> DataFrame:
    """ids, json: the trees whose leaves (ids, path, json) are given as rows, see json_of()."""
    return leaves.groupBy(*ids).agg(F.collect_list(F.struct("path", "json")).alias("_leaves")).select(*ids, json_of(F.col("_leaves")).alias("json"))


def with_values(leaves: Column, values: Column) -> Column:
    """The leaves of a tree with the values, both arrays of (path, json), set as in set_values()."""

    def goes(path: Column) -> Column:
        return F.exists(values, lambda v: (F.slice(path, F.lit(1), F.size(v["path"])) == v["path"]) | (F.slice(v["path"], F.lit(1), F.size(path)) == path))

    return F.concat(F.filter(leaves, lambda x: ~goes(x["path"])), values)


def set_values(leaves: DataFrame, ids: Sequence[str], values: DataFrame) -> DataFrame:
    """Leaves with the values (ids, path, json) set: what stood at or below their paths goes, and so does a leaf above, as the path is made."""
    new = values.select(*ids, F.col("path").alias("_new"))
    joined = leaves.join(new, list(ids), "left")
    below, above = F.slice("path", F.lit(1), F.size("_new")) == F.col("_new"), F.slice("_new", F.lit(1), F.size("path")) == F.col("path")
    hit = joined.where(below | above).select(*ids, "path").distinct()
    kept = leaves.join(hit, [*ids, "path"], "left_anti")
    return kept.select(*ids, "path", "json").unionByName(values.select(*ids, "path", "json"))


def _escaped(text: Column, quotes: bool = False) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else [])):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def xml_text(leaves: DataFrame, ids: Sequence[str], tag: str, attributes: str = "@", content: str = "#text") -> DataFrame:
    """ids, xml: an element ``tag`` for each tree of leaves (ids, path, json). Members with the prefix are attributes, the content member is text, arrays repeat their element.

    Inside, a node is its attributes and its content, apart; the parent knows its tag.
    """
    bare = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), F.col("json"), F.lit("}")), "$.v"), F.lit(""))
    parts = leaves.withColumn("parts", F.array(F.struct(F.lit("").alias("attributes"), _escaped(bare).alias("body"), bare.alias("raw"))))

    def element(name: Column, part: Column) -> Column:
        return F.when(part["body"] == "", F.concat(F.lit("<"), name, part["attributes"], F.lit("/>"))).otherwise(F.concat(F.lit("<"), name, part["attributes"], F.lit(">"), part["body"], F.lit("</"), name, F.lit(">")))

    def node(children: Column) -> Column:
        is_attribute = lambda c: c["key"].startswith(attributes)
        named = F.transform(F.filter(children, is_attribute), lambda c: F.concat(F.lit(" "), F.substr(c["key"], F.lit(len(attributes) + 1)), F.lit('="'), _escaped(c["value"][0]["raw"], quotes=True), F.lit('"')))
        inner = F.transform(F.filter(children, lambda c: ~is_attribute(c)), lambda c: F.when(c["key"] == content, c["value"][0]["body"]).otherwise(F.array_join(F.transform(c["value"], lambda p: element(c["key"], p)), "")))
        one = F.array(F.struct(F.array_join(named, "").alias("attributes"), F.array_join(inner, "").alias("body"), F.lit("").alias("raw")))
        return F.when(children[0]["key"].isNull(), F.flatten(F.transform(children, lambda c: c["value"]))).otherwise(one)

    whole = _gather(parts, ids, "parts", node)
    return whole.select(*ids, F.array_join(F.transform("parts", lambda p: element(F.lit(tag), p)), "").alias("xml"))


def json_spans(df: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """ids, start (from 0), length, json: every substring that is a valid JSON object or array.

    A text is cut into brackets, quotes (escaped ones apart) and what is between. A bracket opens a candidate if it stands outside of strings, which depends on where
    reading begins: outside is where the number of quotes so far is as even or odd as at the opening bracket. So there are two sequences of brackets, and in each
    a bracket closes at the next one of the same depth. Only those spans, one per opening bracket, are parsed.
    """
    pattern = r'(?s)\\["\\]|[\[\]{}"]|[^\\\[\]{}"]+|\\'
    pieces = df.select(*ids, text, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("_i", "_p"))
    along = Window.partitionBy(*ids).orderBy("_i")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumns({
        "start": F.coalesce(F.sum(F.char_length("_p")).over(before), F.lit(0)),
        "_odd": F.coalesce(F.sum(F.when(F.col("_p") == '"', 1).otherwise(0)).over(before), F.lit(0)) % 2,
    })
    brackets = placed.where(F.col("_p").isin("{", "[", "}", "]")).withColumn("_step", F.when(F.col("_p").isin("{", "["), 1).otherwise(-1))
    depth = F.sum("_step").over(Window.partitionBy(*ids, "_odd").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    level = brackets.withColumn("_level", F.when(F.col("_step") == 1, depth).otherwise(depth + 1))
    same = Window.partitionBy(*ids, "_odd", "_level").orderBy("_i")
    closed = level.withColumns({"_to": F.lead("start").over(same), "_end": F.lead("_p").over(same)}).where((F.col("_step") == 1) & F.col("_end").isin("}", "]"))
    spans = closed.withColumn("length", (F.col("_to") - F.col("start") + 1).cast("long"))
    spans = spans.withColumn("json", F.substr(F.col(text), (F.col("start") + 1).cast("int"), F.col("length").cast("int")))
    return spans.where(F.try_parse_json("json").isNotNull()).select(*ids, F.col("start").cast("long").alias("start"), "length", "json")


def longest_json(df: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """ids, json: the longest valid object or array inside each text that has one; of equal ones the first."""
    best = F.max_by("json", F.struct("length", (-F.col("start")).alias("first")))
    return json_spans(df, ids, text).groupBy(*ids).agg(best.alias("json"))
