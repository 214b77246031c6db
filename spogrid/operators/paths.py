"""Property paths (sequence, alternative, inverse) and hierarchy closure.

A path expression is a predicate string or a nested ``seq`` / ``alt`` / ``inv`` / ``star`` / ``plus`` /
``opt`` / ``neg`` value; :func:`path` expands it into joins and unions of triple patterns.
Repeated parts with a bound end are searched from there, a frontier at a time (:func:`reachable`); only
with both ends unbound are all pairs computed.
:func:`closure` computes the transitive closure of an edge table by iterative
joins to a fixpoint, cutting lineage with reliable checkpoints.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.functions.terms import aux, is_var, var_name
from spogrid.operators.patterns import bgp, iri_aux, natural_join, triple_pattern
from spogrid.session import materialize
from spogrid.sources.store import as_store


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Inv:
    part: object


@dataclass(frozen=True)
class Rep:
    """``part`` at least ``least`` times, at most ``most`` (None: any number)."""

    part: object
    least: int
    most: int | None = None


@dataclass(frozen=True)
class Neg:
    """One step by any predicate but these, or backwards by any but those of ``inverse``."""

    parts: tuple
    inverse: tuple = ()


def star(part) -> Rep:
    return Rep(part, 0)


def plus(part) -> Rep:
    return Rep(part, 1)


def opt(part) -> Rep:
    return Rep(part, 0, 1)


def neg(*parts, inverse=()) -> Neg:
    return Neg(tuple(parts), tuple(inverse))


def seq(*parts) -> Seq:
    return Seq(tuple(parts))


def alt(*parts) -> Alt:
    return Alt(tuple(parts))


def inv(part) -> Inv:
    return Inv(part)


def path(triples, s: str, expr, o: str) -> DataFrame:
    """Solutions of ``s expr o``; fresh middle variables are hidden and dropped."""
    counter = itertools.count()

    def tr(e, a, b) -> DataFrame:
        if isinstance(e, str):
            return triple_pattern(triples, (a, e, b))
        if isinstance(e, Inv):
            return tr(e.part, b, a)
        if isinstance(e, Seq):
            if all(isinstance(x, str) or isinstance(x, Inv) and isinstance(x.part, str) for x in e.parts):
                # plain steps are one graph pattern: its variables prune and its scans merge
                nodes = [a, *(f"?_m{next(counter)}" for _ in e.parts[1:]), b]
                steps = zip(e.parts, nodes, nodes[1:], strict=False)
                return bgp(triples, [(x, p, y) if isinstance(p, str) else (y, p.part, x) for p, x, y in steps])
            cur, acc = a, None
            for k, part in enumerate(e.parts):
                nxt = b if k == len(e.parts) - 1 else f"?_m{next(counter)}"
                step = tr(part, cur, nxt)
                acc = step if acc is None else natural_join(acc, step)
                cur = nxt
            return acc
        if isinstance(e, Alt):
            out = None
            for part in e.parts:
                d = tr(part, a, b)
                out = d if out is None else out.unionByName(d, allowMissingColumns=True)
            return out
        if isinstance(e, Neg):
            out = [triple_pattern(triples, (a, _others(triples, e.parts), b))] if e.parts or not e.inverse else []
            if e.inverse:
                out.append(triple_pattern(triples, (b, _others(triples, e.inverse), a)))
            return out[0] if len(out) == 1 else out[0].unionByName(out[1], allowMissingColumns=True)
        if isinstance(e, Rep):
            return _repeated(triples, a, e, b)
        raise TypeError(f"not a path: {e!r}")

    res = tr(expr, s, o)
    return res.drop(*[c for c in res.columns if c.startswith("_m")])


def _others(triples, preds) -> tuple:
    return tuple(p for p in as_store(triples).predicates() if p not in preds)


def _repeated(triples, a: str, e: Rep, b: str) -> DataFrame:
    """Solutions of ``a e b`` over IRIs. A bound end reaches itself in no step, whether or not the graph has it;
    with both ends unbound these are the graph's own terms."""
    if is_var(a) and is_var(b):
        step = path(triples, "?a", e.part, "?b")
        edges = (step.where(F.col(aux("b", "kind")) == "iri") if aux("b", "kind") in step.columns else step).select("a", "b").distinct()
        if e.most == 1:
            pairs = edges
        else:
            pairs = closure(edges, "a", "b").select(F.col("child").alias("a"), F.col("ancestor").alias("b"))
        if e.least == 0:
            every = as_store(triples).all
            nodes = every.select(F.explode(F.when(F.col("kind") == "iri", F.array("sub", "obj")).otherwise(F.array("sub"))).alias("a")).distinct()
            pairs = pairs.unionByName(nodes.withColumn("b", F.col("a"))).distinct()
        x, y = var_name(a), var_name(b)
        if x == y:
            return pairs.where("a = b").select(F.col("a").alias(x), *iri_aux(x))
        return pairs.select(F.col("a").alias(x), F.col("b").alias(y), *iri_aux(x), *iri_aux(y))
    if not is_var(a) and not is_var(b):
        return between(triples, a, e, b).select(F.lit(True).alias("_m"))
    start, name, part = (a, var_name(b), e.part) if is_var(b) else (b, var_name(a), Inv(e.part))
    return reachable(triples, start, Rep(part, e.least, e.most)).select(F.col("node").alias(name), *iri_aux(name))


def _turned(e):
    """The same part backwards."""
    return e.part if isinstance(e, Inv) else Inv(e)


# Nodes of a frontier up to which a scan of the edges gets them as a list; larger ones are joined.
PUSHED = 1000


class _Steps:
    """Edges of single predicates between IRIs, each written once, sorted by the end that a search comes from: a
    small frontier is pushed down to the scan, which then reads the row groups that may hold its nodes."""

    def __init__(self, triples):
        self.triples, self.spark, self.edges = triples, as_store(triples).spark, {}

    def one(self, pred, back: bool, nodes: DataFrame) -> DataFrame:
        if (pred, back) not in self.edges:
            found = triple_pattern(self.triples, ("?a", pred, "?b"))
            found = found.where(F.col(aux("b", "kind")) == "iri") if aux("b", "kind") in found.columns else found
            self._write((pred, back), found, *(("b", "a") if back else ("a", "b")))
        return self._next((pred, back), nodes)

    def _write(self, name, found: DataFrame, near: str, far: str) -> None:
        found = found.select(F.col(near).alias("near"), F.col(far).alias("far"))
        self.edges[name] = materialize(found.repartitionByRange("near").sortWithinPartitions("near"), "path-edges")

    def through(self, pred: str, then: str, nodes: DataFrame) -> DataFrame:
        """Backwards by ``pred`` and on by ``then``, as one step: what lies between has one value of each."""
        if (pred, then) not in self.edges:
            found = bgp(self.triples, [("?m", pred, "?a"), ("?m", then, "?b")])
            for v in ("a", "b"):
                found = found.where(F.col(aux(v, "kind")) == "iri") if aux(v, "kind") in found.columns else found
            self._write((pred, then), found, "a", "b")
        return self._next((pred, then), nodes)

    def one_value(self, pred: str) -> bool:
        """No subject has two values of the predicate, as far as the store tells."""
        store = as_store(self.triples)
        branches = store._branches.get(pred, []) if store.virtual else []
        return len(branches) == 1 and branches[0].functional and store.unique(branches[0])

    def _passes(self, part, then) -> bool:
        return isinstance(part, Inv) and isinstance(part.part, str) and isinstance(then, str) and self.one_value(part.part) and self.one_value(then)

    def _next(self, name, nodes: DataFrame) -> DataFrame:
        edges = self.edges[name]
        few = [r[0] for r in nodes.limit(PUSHED + 1).collect()]
        near = edges.where(F.col("near").isin(few)) if len(few) <= PUSHED else edges.join(nodes.withColumnRenamed("node", "near"), "near")
        return near.select(F.col("far").alias("node")).distinct()

    def step(self, e, nodes: DataFrame, back: bool = False) -> DataFrame:
        """The nodes that one ``e`` leads to; what is between its parts are sets of nodes too, not pairs."""
        if isinstance(e, Inv):
            return self.step(e.part, nodes, not back)
        if isinstance(e, Seq):
            parts = [_turned(part) for part in reversed(e.parts)] if back else list(e.parts)
            while parts:
                if len(parts) > 1 and self._passes(parts[0], parts[1]):
                    found, parts = self.through(parts[0].part, parts[1], nodes), parts[2:]
                else:
                    found, parts = self.step(parts[0], nodes), parts[1:]
                nodes = materialize(found, "path-nodes")
            return nodes
        if isinstance(e, Alt):
            return reduce(DataFrame.unionByName, [self.step(p, nodes, back) for p in e.parts]).distinct()
        if isinstance(e, Neg):
            sides = [self.one(_others(self.triples, e.parts), back, nodes)] if e.parts or not e.inverse else []
            sides += [self.one(_others(self.triples, e.inverse), not back, nodes)] if e.inverse else []
            return reduce(DataFrame.unionByName, sides).distinct()
        if isinstance(e, Rep):
            return self.search(Rep(e.part if not back else Inv(e.part), e.least, e.most), nodes)
        return self.one(e, back, nodes)

    def search(self, e: Rep, starts: DataFrame) -> DataFrame:
        """The nodes that some start reaches by ``e``."""
        frontier = materialize(starts.select("node").distinct(), "path-nodes")
        rounds = [frontier] if e.least == 0 else []
        done = 0
        while e.most is None or done < e.most:
            found = self.step(e.part, frontier)
            for seen in rounds:
                found = found.join(seen, "node", "left_anti")
            frontier = materialize(found, "path-nodes")
            if frontier.isEmpty():
                break
            done += 1
            if done < e.least:  # on the way: not an answer yet
                continue
            rounds.append(frontier)
            if len(rounds) > 8:
                rounds = [materialize(reduce(DataFrame.unionByName, rounds), "path-nodes")]
        return reduce(DataFrame.unionByName, rounds) if rounds else frontier

    def node(self, iri: str) -> DataFrame:
        return self.spark.createDataFrame([(iri,)], "node string")


def reachable(triples, start: str, e: Rep) -> DataFrame:
    """The nodes that an IRI reaches by ``e``, each once. Each round advances the newest nodes by one step, and writes those not
    met before: what is read and kept grows with the part of the graph that is reached."""
    steps = _Steps(triples)
    return steps.search(e, steps.node(start))


def between(triples, s: str, e: Rep, o: str) -> DataFrame:
    """(s, o, steps) if ``s`` reaches ``o``, with the least number of repetitions; else no row.

    Searched from both ends, the smaller frontier first, until they meet."""
    steps = _Steps(triples)
    answer = lambda n: steps.spark.createDataFrame([] if n is None else [(s, o, n)], "s string, o string, steps int")
    if e.least == 0 and s == o:
        return answer(0)
    if e.least > 1:
        raise ValueError("the number of repetitions is none or one at least")
    seen = [[steps.node(s)], [steps.node(o)]]
    size, n = [1, 1], 0
    while (e.most is None or n < e.most) and min(size) > 0:
        side = 0 if size[0] <= size[1] else 1
        found = steps.step(e.part if side == 0 else Inv(e.part), seen[side][-1])
        # the far side's newest nodes are met first where its way is as short as can be
        found = materialize(found, "path-nodes")
        n += 1
        if not found.join(seen[1 - side][-1], "node", "left_semi").isEmpty():
            return answer(n)
        for known in seen[side][1:] if n == 1 else seen[side]:
            found = found.join(known, "node", "left_anti")
        seen[side].append(materialize(found, "path-nodes"))
        size[side] = seen[side][-1].count()
        if len(seen[side]) > 8:
            seen[side] = [materialize(reduce(DataFrame.unionByName, seen[side][:-1]), "path-nodes"), seen[side][-1]]
    return answer(None)


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Transitive closure ``(child, ancestor, depth)`` with the shortest depth.

    Breadth-first: each round joins the newest pairs with the edges and keeps
    only pairs not seen before, so cycles terminate.  Each round's new pairs
    are checkpointed (reliable, in the session's checkpoint directory) to cut
    lineage; the loop stops when a round adds nothing.
    """
    from spogrid.session import checkpoint_dir

    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where(F.col("p").isNotNull()).distinct()
    known = e.select(F.col("c").alias("child"), F.col("p").alias("ancestor"), F.lit(1).alias("depth")).checkpoint()
    frontier = known
    depth = 1
    while True:
        depth += 1
        step = (
            frontier.join(e, frontier["ancestor"] == e["c"])
            .select(frontier["child"], e["p"].alias("ancestor"))
            .distinct()
        )
        new = step.join(known.select("child", "ancestor"), ["child", "ancestor"], "left_anti")
        new = new.withColumn("depth", F.lit(depth)).checkpoint()
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        if depth % 4 == 0:
            known = known.checkpoint()
        frontier = new


def levels(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Depth of every node below its root: roots (no parent) have depth 0."""
    e = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent"))
    nodes = e.select(F.col("child").alias("node")).union(
        e.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node"))
    ).distinct()
    has_parent = e.where(F.col("parent").isNotNull()).select(F.col("child").alias("node")).distinct()
    roots = nodes.join(has_parent, "node", "left_anti")
    c = closure(e, "child", "parent")
    below = c.join(roots.select(F.col("node").alias("ancestor")), "ancestor").groupBy(
        F.col("child").alias("node")
    ).agg(F.max("depth").alias("depth"))
    return roots.withColumn("depth", F.lit(0)).unionByName(below)
