"""Disjoint sets: choices of pairwise disjoint sets that cover as many members as possible.

Sets conflict if they share a member, and the components of the conflict graph are independent. A problem is one small row of its sets with their members: tasks find the
conflicts there and solve each component exactly by branch and bound; the bound covers the open sets with cliques, each of which can give its largest set only. Largest choices
of problems with more than PACKED members are cut into their components first, by an equi join on members. Exact search takes time
that may double with each set of a component, so components of many dozens of loosely linked sets are beyond it.

Nulls and ties: null members and sets are left out, so empty sets never appear; null names a problem of its own; repeated rows count once. Of choices that cover equally many members that comes first
which has the smallest set where they differ.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethoframe.graph import components
from ethoframe.shared import materialize

#: Members, over all sets, of a problem that is packed whole; rows that a task holds as Python objects at once.
PACKED, SLICE = 4096, 256


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _bound(open_: int, weights: Sequence[int], near: Sequence[int]) -> int:
    """No choice among the open sets covers more: each clique of a greedy cover counts with its largest set."""
    total = 0
    for i in sorted(_bits(open_), key=lambda i: -weights[i]):
        if open_ >> i & 1:
            total += weights[i]
            clique = open_ & near[i]
            open_ &= ~(1 << i)
            for j in _bits(clique):
                if clique >> j & 1:
                    open_ &= ~(1 << j)
                    clique &= near[j]
    return total


def best_choices(weights: Sequence[int], near: Sequence[int], every: bool = False, allowed: int | None = None) -> list[list[int]]:
    """The best choice of places (ascending), or with ``every`` all that cover as much; near[i] has a bit for each set in conflict with i."""
    best, found = 0, [[]]

    def search(open_: int, chosen: list[int], covered: int) -> None:
        nonlocal best, found
        if not open_:
            if covered > best:
                best, found = covered, [list(chosen)]
            elif every and covered == best and chosen not in found:
                found.append(list(chosen))
            return
        reach = covered + _bound(open_, weights, near)
        if reach < best or (reach == best and not every and best):
            return
        i = next(_bits(open_))  # the first open set goes in, then stays out: choices come in order
        search(open_ & ~(1 << i) & ~near[i], [*chosen, i], covered + weights[i])
        if open_ & near[i]:  # without a rival left, leaving it out never helps
            search(open_ & ~(1 << i), chosen, covered)

    search((1 << len(weights)) - 1 if allowed is None else allowed, [], 0)
    return found


def conflicts(members: DataFrame, problem: Sequence[str], set_id: str, member: str) -> DataFrame:
    """problem, a, b: pairs of sets (a < b) of a problem that share a member."""
    left = members.select(*problem, F.col(set_id).alias("a"), member)
    right = members.select(*(F.col(c).alias(f"_{c}") for c in problem), F.col(set_id).alias("b"), F.col(member).alias("_member"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in problem), F.col(member) == F.col("_member"))
    return left.join(right, same).where("a < b").select(*problem, "a", "b").distinct()


def _near(sets: Sequence[Sequence[Hashable]]) -> list[int]:
    """A bit for each other set that shares a member, for each set."""
    holders = defaultdict(int)
    for i, own in enumerate(sets):
        for m in own:
            holders[m] |= 1 << i
    near = []
    for i, own in enumerate(sets):
        reach = 0
        for m in own:
            reach |= holders[m]
        near.append(reach & ~(1 << i))
    return near


def _parts(near: Sequence[int]) -> Iterator[list[int]]:
    """The places of each component, ascending."""
    left = (1 << len(near)) - 1
    while left:
        part, open_ = 0, left & -left
        while open_:
            part |= open_
            reach = 0
            for i in _bits(open_):
                reach |= near[i]
            open_ = reach & ~part
        left &= ~part
        yield list(_bits(part))


#: weights and near of a problem's sets to choices: the place of a set that stands for the component, number of the choice, places.
Solver = Callable[[list[int], list[int]], list[tuple[list[int], int, list[int]]]]


def _solve(sets: DataFrame, keys: Sequence[str], set_type: T.DataType, solver: Solver) -> DataFrame:
    """sets (keys, set, members, node) to keys, component (smallest node of the component), choice, set; each value of keys is one row."""
    rows = sets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("set", "members", "node"))).alias("sets"))
    added = [T.StructField("component", T.LongType()), T.StructField("choice", T.IntegerType()), T.StructField("set", set_type)]
    schema = T.StructType([*sets.select(*keys).schema.fields, *added])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            take, component, choice, chosen = [], [], [], []
            kind = batch.column("sets").type.value_type
            nested = pa.types.is_nested(kind.field("members").type.value_type)
            for row, found in enumerate(batch.column("sets").to_pylist()):
                near = _near([[repr(m) for m in s["members"]] if nested else s["members"] for s in found])
                for part, k, places in solver([len(s["members"]) for s in found], near):
                    take += [row] * len(places)
                    component += [min(found[i]["node"] for i in part)] * len(places)
                    choice += [k] * len(places)
                    chosen += [found[i]["set"] for i in places]
            columns = [batch.column(c).take(pa.array(take, pa.int64())) for c in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(component, pa.int64()), pa.array(choice, pa.int32()), pa.array(chosen, kind.field("set").type)], schema.names)

    return rows.mapInArrow(solve, schema)


def _sets(members: DataFrame, problem: Sequence[str], set_id: str, member: str) -> DataFrame:
    """problem, set, members (distinct), node (hash of problem and set), without nulls."""
    own = F.col(member)
    if isinstance(members.schema[member].dataType, (T.FloatType, T.DoubleType)):
        own = (own + F.lit(0.0)).cast("string")  # one text for all NaN and for both zeros
    rows = members.where(F.col(set_id).isNotNull() & F.col(member).isNotNull())
    sets = rows.groupBy(*problem, F.col(set_id).alias("set")).agg(F.collect_set(own).alias("members"))
    return sets.withColumn("node", F.xxhash64(*problem, "set"))


def _cut(sets: DataFrame, problem: Sequence[str]) -> DataFrame:
    """sets with part, the component of each."""
    members = materialize(sets.select(*problem, "set", F.explode("members").alias("member")), "disjoint-members")
    node = lambda c: F.xxhash64(*problem, c)
    edges = conflicts(members, problem, "set", "member").select(node("a").alias("a"), node("b").alias("b"))
    parts = components(edges).select(F.col("id").alias("node"), F.col("component").alias("part"))
    return sets.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))


def max_disjoint_sets(members: DataFrame, problem: Sequence[str], set_id: str, member: str, alternatives: bool = False) -> DataFrame:
    """problem, component, choice, set: the sets of a largest disjoint choice for each problem, a row each.

    With alternatives, choice 1, 2, ... of a component are its other choices that cover as many members; any combination over components is a solution.
    Components are named by a hash of problem and set.
    """
    kind = members.schema[set_id].dataType

    def solver(weights: list[int], near: list[int]) -> list[tuple[list[int], int, list[int]]]:
        out = []
        for part in _parts(near):
            allowed = sum(1 << i for i in part)
            out += [(part, k, places) for k, places in enumerate(best_choices(weights, near, alternatives, allowed))]
        return out

    sets = materialize(_sets(members, problem, set_id, member), "disjoint-sets")
    if not problem:
        return _solve(_cut(sets, problem), ["part"], kind, solver).drop("part")
    sizes = sets.groupBy(*problem).agg(F.sum(F.size("members")).alias("size")).where(F.col("size") > PACKED)
    large = materialize(sizes, "disjoint-large").select(*(F.col(c).alias(f"_{c}") for c in problem))
    if not large.limit(1).count():
        return _solve(sets, problem, kind, solver)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in problem))
    cut = _cut(materialize(sets.join(large, same, "left_semi"), "disjoint-cut"), problem)
    whole = _solve(sets.join(large, same, "left_anti"), problem, kind, solver)
    return whole.unionByName(_solve(cut, [*problem, "part"], kind, solver).drop("part"))


def _condensed(weights: list[int], near: list[int]) -> list[tuple[list[int], int, list[int]]]:
    """Choices one after the other: each has the first set that is left and a largest disjoint choice of the others."""
    every, left, out = list(range(len(weights))), (1 << len(weights)) - 1, []
    while left:
        first = next(_bits(left))
        (rest,) = best_choices(weights, near, allowed=left & ~(1 << first) & ~near[first])
        out.append((every, len(out), [first, *rest]))
        for i in out[-1][2]:
            left &= ~(1 << i)
    return out


def condense_disjoint(members: DataFrame, problem: Sequence[str], set_id: str, member: str) -> DataFrame:
    """problem, choice, set: every set of a problem in one of its disjoint choices 0, 1, ..., each the largest one around the first set that was left."""
    return _solve(_sets(members, problem, set_id, member), problem, members.schema[set_id].dataType, _condensed).drop("component")
