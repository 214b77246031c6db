"""Extended vertical partitioning: semi-join reductions of predicate tables.

For two predicates p1, p2 the reduction of VP(p1) keeps the p1 triples whose

* SS: subject is a subject of some p2 triple (p1 != p2),
* OS: object is a subject of some p2 triple,
* SO: subject is an object of some p2 triple.

Instead of one job per ordered predicate pair, each relation is ONE join of the
triple table with a distinct ``(value, predicate)`` index; every output row is
``(rel, p1, p2, triple)``.  Statistics need no rows: values are grouped by the
predicates that they have, and sizes are sums over these profiles.  Skew sits on hot values (class IRIs, countries); the index
side is distinct per value and AQE's skew join splits hot partitions of the
triple side.  Literal objects can never be subjects, so OS and SO join only IRIs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.operators.patterns import _is_variable
from spogrid.session import materialize
from spogrid.sources.store import TripleStore, as_frame, compatible, may_meet, select_preds, side_by_side

RELATIONS = ("SS", "OS", "SO")
# Side of an item that stands for all predicates of a source's row, and the most predicates it can hold.
ROW, ROW_BITS = "R", 62
# Beginnings of values up to which triples that can meet none are left out before a shuffle.
SPACES = 1000


def predicates(triples) -> DataFrame:
    """Distinct predicates.  Of a store over entities, those with a row: a predicate is asked for its
    first triple only, so no column is read that its presence does not need."""
    if isinstance(triples, TripleStore) and triples.virtual:
        return triples.present_predicates()
    return as_frame(triples).select("pred").distinct()


def _index(t: DataFrame, position: str) -> DataFrame:
    src = t if position == "sub" else t.where(F.col("kind") == "iri")
    return src.select(F.col(position).alias("v"), F.col("pred").alias("p2")).distinct()


def related_predicates(triples, rel: str, profiles: DataFrame | None = None) -> DataFrame:
    """Pairs ``(p1, p2)`` with a non-empty ``rel`` reduction."""
    return reduction_counts(triples, [rel], profiles).select("p1", "p2")


def reduction_rows(triples, rels: Sequence[str] = RELATIONS) -> DataFrame:
    """All reduced rows: ``(rel, p1, p2, sub, obj, kind, dt, lang, num, ts)``."""
    t = as_frame(triples)
    idx_s = _index(t, "sub")
    out = []
    if "SS" in rels:
        ss = t.join(idx_s, t["sub"] == idx_s["v"]).where(F.col("pred") != F.col("p2"))
        out.append(ss.withColumn("rel", F.lit("SS")))
    if "OS" in rels:
        ti = t.where(F.col("kind") == "iri")
        os_ = ti.join(idx_s, ti["obj"] == idx_s["v"])
        out.append(os_.withColumn("rel", F.lit("OS")))
    if "SO" in rels:
        idx_o = _index(t, "obj")
        so = t.join(idx_o, t["sub"] == idx_o["v"])
        out.append(so.withColumn("rel", F.lit("SO")))
    cols = ["rel", F.col("pred").alias("p1"), "p2", "sub", "obj", "kind", "dt", "lang", "num", "ts"]
    frames = [d.select(*cols) for d in out]
    res = frames[0]
    for f in frames[1:]:
        res = res.unionByName(f)
    return res


def vp_sizes(triples) -> DataFrame:
    """``(pred, size)`` of each vertical partition (on a stored table the partition column alone is read)."""
    return as_frame(triples).groupBy("pred").agg(F.count(F.lit(1)).alias("size"))


def value_counts(triples) -> DataFrame:
    """``(v, p, side, n)``: triples per subject value (side 'S') and per IRI
    object value (side 'O') and predicate, from ONE scan and ONE aggregation
    (map-side combined)."""
    t = as_frame(triples)
    pairs = F.array(
        F.struct(F.col("sub").alias("v"), F.col("pred").alias("p"), F.lit("S").alias("side")),
        F.when(F.col("kind") == "iri", F.struct(F.col("obj").alias("v"), F.col("pred").alias("p"), F.lit("O").alias("side"))),
    )
    return (
        t.select(F.explode(pairs).alias("x"))
        .where(F.col("x").isNotNull())
        .select("x.*")
        .groupBy("v", "p", "side")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _whole_rows(triples, group) -> bool:
    """A row of the source has all that it says of its subject: predicates of one value each, and no subject twice."""
    return len(group) <= ROW_BITS and all(b.functional for b in group) and triples.is_set(group)


def _row_items(number: int, group) -> DataFrame:
    """One item for all predicates of a row: the number of the source, and a bit for each that it has."""
    has = reduce(lambda x, y: x.bitwiseOR(y), [F.when(b.present, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, b in enumerate(group)])
    row = group[0].source.select(group[0].sub.alias("v"), has.alias("n")).where("n > 0")
    return _single_items(row.withColumns({"side": F.lit(ROW), "p": F.lit(str(number))}))


def _apart(triples, group) -> bool:
    """No other source has subjects that can be this one's, and no object can be one: a row is all that its value has."""
    if len({str(b.sub) for b in group}) > 1 or group[0].sub_key is None:
        return False
    prefix = group[0].sub_key.prefix
    for other in triples.sources():
        if other[0].source is not group[0].source and any(b.sub_key is None or compatible(prefix, b.sub_key.prefix) for b in other):
            return False
        if any(b.kind == "iri" and may_meet(b, {prefix}) for b in other):
            return False
    return True


def _value_items(triples, but: Sequence[int] = ()) -> DataFrame | None:
    """``(v, items)``, items ``(side, p, n)``: rows of one value may be several.

    Of a store over entities, a row of a source whose subjects are unique gives all its predicates at once, as one item that
    :func:`_spelt` spells out once values are grouped, and objects whose prefix no subject has are left out, as they are no value of another's; else triples are counted by :func:`value_counts`.
    The subjects of the sources numbered in ``but`` are left out; None if nothing is left."""
    if not (isinstance(triples, TripleStore) and triples.virtual):
        return _single_items(value_counts(triples))
    frames = []
    prefixes = triples.subject_prefixes()
    for number, group in enumerate(triples.sources()):
        if not _whole_rows(triples, group):
            frames.append(_single_items(value_counts(triples.frame_of(group))))
            continue
        if number not in but:
            frames.append(_row_items(number, group))
        met = [b for b in group if b.kind == "iri" and may_meet(b, prefixes)]
        if met:
            pairs = F.array(*[F.when(b.present, F.struct(b.obj.alias("v"), F.lit(b.pred).alias("p"))) for b in met])
            objects = group[0].source.select(F.explode(pairs).alias("x")).where(F.col("x").isNotNull()).select("x.*")
            frames.append(_single_items(objects.groupBy("v", "p").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("O"))))
    return reduce(DataFrame.union, frames) if frames else None


def _spelt(triples, items: Column) -> Column:
    """Items of whole rows as one for each of the row's predicates."""
    if not (isinstance(triples, TripleStore) and triples.virtual):
        return items

    def predicates_of(x: Column) -> Column:
        found = F.array(x)
        for number, group in enumerate(triples.sources()):
            if len(group) <= ROW_BITS:
                one = F.lit(1).cast("long")
                own = [F.when(x["n"].bitwiseAND(F.lit(1 << k)) != 0, F.struct(F.lit("S").alias("side"), F.lit(b.pred).alias("p"), one.alias("n"))) for k, b in enumerate(group)]
                found = F.when((x["side"] == ROW) & (x["p"] == str(number)), F.array_compact(F.array(*own))).otherwise(found)
        return found

    return F.flatten(F.transform(items, predicates_of))


def _single_items(counts: DataFrame) -> DataFrame:
    return counts.select("v", F.array(F.struct("side", "p", "n")).alias("items"))


def value_profiles(triples) -> DataFrame:
    """``(side, items, preds, n)``: all values by what they have in common, a few rows for millions of values.

    Side 'S': ``n`` values are subjects of ``items`` (predicate and triples ``k`` of each), and objects of ``preds``.
    Side 'N': the same of subjects that are null, which meet nothing.
    Side 'O': ``n`` triples of the predicate in ``items`` have an object that is a subject of ``preds``.
    Values are shuffled once, and no value goes on from there; rows of a source whose subjects stand apart are counted where they are read."""
    groups = triples.sources() if isinstance(triples, TripleStore) and triples.virtual else []
    apart = [k for k, group in enumerate(groups) if _apart(triples, group) and _whole_rows(triples, group)]
    profiles = [_row_items(k, groups[k]).groupBy(F.col("v").isNull().alias("lone"), "items").agg(F.count(F.lit(1)).alias("m")) for k in apart]
    shared = _value_items(triples, apart)
    if shared is not None:
        # rows without a value meet nothing, not each other either
        lone = F.when(F.col("v").isNull(), F.monotonically_increasing_id()).alias("lone")
        rows = shared.where(F.size("items") > 0).select("v", "items", lone).repartition("v", "lone")
        v = rows.groupBy("v", "lone").agg(F.flatten(F.collect_list("items")).alias("items"))
        profiles.append(v.groupBy(F.col("lone").isNotNull().alias("lone"), F.sort_array("items").alias("items")).agg(F.count(F.lit(1)).alias("m")))
    v = reduce(DataFrame.unionByName, profiles)
    v = v.select("lone", "m", _spelt(triples, F.col("items")).alias("items"))

    def side(name: str) -> Column:
        """(p, k) of a side's predicates, in order."""
        mine = F.filter("items", lambda x: x["side"] == name)
        preds = F.array_sort(F.array_distinct(F.transform(mine, lambda x: x["p"])))
        total = lambda p: F.aggregate(F.filter(mine, lambda x: x["p"] == p), F.lit(0).cast("long"), lambda t, x: t + x["n"])
        return F.transform(preds, lambda p: F.struct(p.alias("p"), total(p).alias("k")))

    def fact(name: Column, items: Column, preds: Column, n: Column) -> Column:
        return F.struct(name.alias("side"), items.alias("items"), preds.alias("preds"), n.alias("n"))

    names = lambda c: F.transform(c, lambda x: x["p"])
    v = v.select("m", F.when(F.col("lone"), "N").otherwise("S").alias("as"), side("S").alias("s"), side("O").alias("o"))
    # a test of the count too: one of the group alone would be made of every value before they are grouped
    v = v.where(F.when(F.col("m") > 0, F.size("s")).otherwise(0) > 0)
    one = F.lit(1).cast("long")
    of_objects = F.transform("o", lambda x: fact(F.lit("O"), F.array(F.struct(x["p"].alias("p"), one.alias("k"))), names("s"), x["k"] * F.col("m")))
    facts = F.concat(F.array(fact(F.col("as"), F.col("s"), names("o"), F.col("m"))), of_objects)
    return v.select(F.explode(facts).alias("f")).select("f.*").groupBy("side", "items", "preds").agg(F.sum("n").alias("n"))


def reduction_counts(triples, rels: Sequence[str] = RELATIONS, profiles: DataFrame | None = None) -> DataFrame:
    """``(rel, p1, p2, size)`` without building the reduced rows: from the profiles of the values, a row for each
    pair of predicates that a profile has."""
    c = profiles if profiles is not None else materialize(value_profiles(triples), "value-profiles")
    items = c.select("side", "items", "preds", "n", F.explode("items").alias("x"))
    items = items.select("side", F.col("x.p").alias("p1"), (F.col("x.k") * F.col("n")).alias("n"), "items", "preds")
    out = []
    if "SS" in rels:
        ss = items.where("side = 'S'").select("p1", "n", F.explode(F.transform("items", lambda x: x["p"])).alias("p2"))
        out.append(ss.where(F.col("p1") != F.col("p2")).withColumn("rel", F.lit("SS")))
    for rel, side in (("OS", "O"), ("SO", "S")):
        if rel in rels:
            out.append(items.where(F.col("side") == side).select("p1", "n", F.explode("preds").alias("p2")).withColumn("rel", F.lit(rel)))
    return reduce(DataFrame.unionByName, out).groupBy("rel", "p1", "p2").agg(F.sum("n").alias("size"))


def reduction_stats(triples, rows: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """``(rel, p1, p2, size, vp_size, ratio, vp_ratio)`` of every non-empty reduction.

    ``ratio`` = size / size of VP(p1), rounded half-up to two decimals;
    ``vp_ratio`` = size of VP(p1) / number of triples.  Sizes, VP sizes and the
    total all derive from :func:`value_profiles` unless reduced ``rows`` are given.
    """
    c = profiles if profiles is not None else materialize(value_profiles(triples), "value-profiles")
    if rows is not None:
        counts = rows.groupBy("rel", "p1", "p2").agg(F.count(F.lit(1)).alias("size"))
    else:
        counts = reduction_counts(triples, profiles=c)
    own = c.where("side <> 'O'").select(F.explode("items").alias("x"), "n")
    vp = own.groupBy(F.col("x.p").alias("p1")).agg(F.sum(F.col("x.k") * F.col("n")).alias("vp_size"))
    total = vp.agg(F.sum("vp_size")).scalar()  # scalar subquery
    vp = vp.withColumn("vp_ratio", F.col("vp_size") / total)
    out = counts.join(vp, "p1")
    return out.select(
        "rel", "p1", "p2", "size", "vp_size", ratio2(F.col("size"), F.col("vp_size")).alias("ratio"), "vp_ratio"
    )


def ratio2(size, whole):
    """``size / whole`` rounded half-up to two decimals, computed on integers (exact)."""
    return F.floor((size * 200 + whole) / (whole * 2)) / 100


def bounded(stats: DataFrame, bound: float) -> DataFrame:
    """Statistics with the ``bound`` and a ``stored`` flag: kept when size < vp_size x bound (strict).
    These travel together, so tables are chosen among those that were written."""
    return stats.withColumns({"bound": F.lit(float(bound)), "stored": F.col("size") < F.col("vp_size") * F.lit(bound)})


def statistics(triples, bound: float, profiles: DataFrame | None = None) -> DataFrame:
    """Statistics of all reductions under one bound, written once: the explicit step before
    summaries, table choice and writing."""
    return materialize(bounded(reduction_stats(triples, profiles=profiles), bound), "reduction-stats")


def _flagged(stats: DataFrame, bound: float | None) -> DataFrame:
    if "stored" in stats.columns:
        return stats
    if bound is None:
        raise ValueError("statistics without a bound: use bounded() or statistics()")
    return bounded(stats, bound)


def reduction_summary(stats: DataFrame, triples, bound: float | None = None) -> DataFrame:
    """Per relation: saved, non-empty but not saved, and empty tables; a row for each of
    the three relations, also when it has no table.

    The number of possible tables is n*(n-1) for SS and n*n for OS / SO
    (n = number of predicates).
    """
    n = predicates(triples).agg(F.count(F.lit(1))).scalar()
    b = _flagged(stats, bound).select("rel", "stored")
    names = stats.sparkSession.createDataFrame([(r,) for r in RELATIONS], "rel string")
    per = b.unionByName(names.withColumn("stored", F.lit(None).cast("boolean"))).groupBy("rel").agg(
        F.count(F.when(F.col("stored"), 1)).alias("saved"),
        F.count(F.when(~F.col("stored"), 1)).alias("unsaved_nonempty"),
        F.count("stored").alias("nonempty"),
    )
    rels = per.withColumn("n", n)
    possible = F.when(F.col("rel") == "SS", F.col("n") * (F.col("n") - 1)).otherwise(F.col("n") * F.col("n"))
    return rels.select("rel", "saved", "unsaved_nonempty", (possible - F.col("nonempty")).alias("empty"))


def storage(stats: DataFrame, bound: float | None = None) -> DataFrame:
    """Stored triples and number of tables below the bound, per relation."""
    b = _flagged(stats, bound).where(F.col("stored"))
    return b.groupBy("rel").agg(F.sum("size").alias("stored_triples"), F.count(F.lit(1)).alias("tables"))


_SHOWN = ("sub", "obj", "kind", "dt", "lang", "num", "ts")


def _namespace(v: str) -> Column:
    return F.substring_index(v, "/", 1)


def _bits(n: int) -> list[Column]:
    """Masks ``__m0``, ``__m1``, ... of the numbers ``__k`` below ``n``."""
    bit = F.expr(f"shiftleft(1L, __k % {ROW_BITS})")
    return [F.coalesce(F.bit_or(F.when(F.floor(F.col("__k") / ROW_BITS) == m, bit)), F.lit(0).cast("long")).alias(f"__m{m}") for m in range(-(-n // ROW_BITS))]


def _kept_bits(triples, stats: DataFrame, bound: float | None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Triples that are in a kept table, each once for the end that it is met by, with their tables as bits ``__both`` of what
    is returned beside them: ``(side, p2)``.

    What a kept table asks for, a predicate's subjects or objects, is a bit; the predicates of kept tables pass through the driver."""
    # the end of the triple that a relation looks at, and whether it meets subjects or objects
    at = F.when(F.col("rel") == "OS", "obj").otherwise("sub").alias("at")
    side = F.when(F.col("rel") == "SO", "O").otherwise("S").alias("side")
    keep = _flagged(stats, bound).where(F.col("stored") & F.col("p1").isNotNull() & F.col("p2").isNotNull()).select(at, side, F.col("p1").alias("pred"), "p2")
    asked = sorted({tuple(r) for r in keep.select("side", "p2").distinct().collect()}) or [("S", "")]
    ends = [tuple(r) for r in keep.select("at", "pred").distinct().collect()]
    index = stats.sparkSession.createDataFrame([(*x, k) for k, x in enumerate(asked)], "side string, p2 string, __k int")
    subjects = select_preds(triples, [p for s, p in asked if s == "S"]).select(F.col("sub").alias("v"), F.lit("S").alias("side"), F.col("pred").alias("p2"))
    objects = select_preds(triples, [p for s, p in asked if s == "O"]).where(F.col("kind") == "iri").select(F.col("obj").alias("v"), F.lit("O").alias("side"), F.col("pred").alias("p2"))
    values = subjects.unionByName(objects).where("v IS NOT NULL").join(F.broadcast(index), ["side", "p2"])
    # what the values of a kept table begin with: triples whose end does not begin so are not shuffled
    spaces = values.select("side", "p2", _namespace("v").alias("space")).distinct()
    spaces = materialize(keep.join(spaces, ["side", "p2"]).select("at", "pred", "space").distinct(), "spaces")
    few = spaces.limit(SPACES + 1).count() <= SPACES
    left = []
    for end in ("sub", "obj"):
        rows = select_preds(triples, [p for a, p in ends if a == end])
        rows = (rows if end == "sub" else rows.where(F.col("kind") == "iri")).withColumns({"at": F.lit(end), "key": F.col(end)})
        left.append(rows.join(F.broadcast(spaces), (rows["pred"] == spaces["pred"]) & (rows["at"] == spaces["at"]) & (_namespace("key") == spaces["space"]), "left_semi") if few else rows)
    # a row for each value with the bits of its predicates: the triples meet it once, and go on with the tables that they are in
    masks = _bits(len(asked))
    idx = values.groupBy("v").agg(*masks)
    kept = keep.join(F.broadcast(index), ["side", "p2"]).groupBy("at", "pred").agg(*masks).select("at", "pred", *[F.col(f"__m{m}").alias(f"__n{m}") for m in range(len(masks))])
    j = reduce(DataFrame.unionByName, left).join(idx, F.col("key") == F.col("v")).join(F.broadcast(kept), ["at", "pred"])
    both = F.array(*[F.col(f"__m{m}").bitwiseAND(F.col(f"__n{m}")) for m in range(len(masks))]).alias("__both")
    j = j.select("at", "pred", *_SHOWN, both).where(F.exists("__both", lambda x: x != 0))
    return j, asked


def _tables_of(bits: DataFrame, asked: list[tuple[str, str]]) -> tuple[Column, Column, Column]:
    """The numbers of a row's tables, and relation and second predicate of the table numbered ``__k``."""
    numbers = F.expr(f"filter(sequence(0, {len(asked) - 1}), k -> shiftright(__both[k div {ROW_BITS}], k % {ROW_BITS}) & 1 = 1)")
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("__k"))
    rel = F.when(F.col("at") == "obj", "OS").when(of([s for s, _ in asked]) == "S", "SS").otherwise("SO")
    return numbers, rel.alias("rel"), of([p for _, p in asked]).alias("p2")


def _by_table(bits: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    numbers, rel, p2 = _tables_of(bits, asked)
    return bits.select("*", F.explode(numbers).alias("__k")).select(rel, F.col("pred").alias("p1"), p2, *_SHOWN)


def _kept_hits(triples, stats: DataFrame, bound: float | None) -> DataFrame:
    """The same with the tables spelt out as ``hits``, ``(rel, p2)``."""
    bits, asked = _kept_bits(triples, stats, bound)
    numbers, rel, p2 = _tables_of(bits, asked)
    rows = bits.withColumn("__row", F.monotonically_increasing_id()).select("*", F.explode(numbers).alias("__k"))
    return rows.groupBy("__row", "at", "pred", *_SHOWN).agg(F.collect_list(F.struct(rel, p2)).alias("hits")).drop("__row")


def kept_rows(triples, stats: DataFrame, bound: float | None = None) -> DataFrame:
    """Reduced rows of the kept tables only.

    Both join sides are cut to the kept predicates before the join, and triples to values that begin like one that they can meet.
    The index has one row for each value with all of its predicates, so a triple is shuffled once for each of its ends.
    Whether the kept list is broadcast is left to its size at run time.
    """
    return _by_table(*_kept_bits(triples, stats, bound))


def write_reductions(triples, stats: DataFrame, bound: float | None, path: str, mode: str = "overwrite") -> None:
    """Write only the kept reductions, partitioned by ``(rel, p1, p2)``; no table
    list passes through the driver, only the kept tables' predicates.  Triples are rebalanced by predicate to tasks of the advisory size before they are dealt to
    their tables, and a task writes its tables side by side: a triple moves once, not once for each table."""
    bits, asked = _kept_bits(triples, stats, bound)
    with side_by_side(bits.sparkSession):
        writer = _by_table(bits.hint("rebalance", "at", "pred"), asked).write.mode(mode).option("compression", "zstd").option("parquet.block.size", str(32 << 20))
        writer.partitionBy("rel", "p1", "p2").parquet(path)


# ------------------------------------------------------------------ table choice


def _candidate_pairs(patterns: Sequence[tuple]) -> list[tuple[int, str, str, str]]:
    """``(pattern index, rel, p1, p2)`` for every pair of patterns sharing a variable."""
    out = []
    for i, (s1, p1, o1) in enumerate(patterns):
        if _is_variable(p1):
            continue
        for j, (s2, p2, o2) in enumerate(patterns):
            if i == j or _is_variable(p2):
                continue
            if _is_variable(s1) and s1 == s2 and p1 != p2:
                out.append((i, "SS", p1, p2))
            if _is_variable(o1) and o1 == s2:
                out.append((i, "OS", p1, p2))
            if _is_variable(s1) and s1 == o2:
                out.append((i, "SO", p1, p2))
    return out


def choose_tables(spark, patterns: Sequence[tuple], stats: DataFrame, bound: float | None = None) -> DataFrame:
    """Smallest stored table per pattern: ``(idx, rel, p1, p2, size)``; VP when no
    reduction applies (``rel`` = 'VP').  Ties keep the earlier candidate."""
    cands = _candidate_pairs(patterns)
    schema = "idx int, cand int, rel string, p1 string, p2 string"
    cdf = spark.createDataFrame([(i, k, r, a, b) for k, (i, r, a, b) in enumerate(cands)], schema)
    st = _flagged(stats, bound).where(F.col("stored")).select("rel", "p1", "p2", "size")
    scored = cdf.join(st, ["rel", "p1", "p2"])
    vp_rows = [(i, -1, "VP", p, None) for i, (_, p, _) in enumerate(patterns) if not _is_variable(p)]
    vp = spark.createDataFrame(vp_rows, schema).join(
        stats.select(F.col("p1"), F.col("vp_size").alias("size")).distinct(), "p1", "left"
    )
    allc = scored.unionByName(vp.select(*scored.columns))
    best = allc.groupBy("idx").agg(F.min_by(F.struct("rel", "p1", "p2", "size"), F.struct("size", "cand")).alias("b"))
    return best.select("idx", "b.rel", "b.p1", "b.p2", "b.size")


def empty_relations(spark, patterns: Sequence[tuple], stats: DataFrame) -> DataFrame:
    """Candidate reductions missing from the statistics: if any row is returned,
    the BGP has no answer (both predicates exist but never meet)."""
    cands = _candidate_pairs(patterns)
    schema = "idx int, rel string, p1 string, p2 string"
    cdf = spark.createDataFrame(cands, schema) if cands else spark.createDataFrame([], schema)
    return cdf.join(stats.select("rel", "p1", "p2"), ["rel", "p1", "p2"], "left_anti")


def reduced_store(rows: DataFrame) -> dict:
    """Lookup of reduced tables: ``(rel, p1, p2) -> triple DataFrame`` (lazy filters)."""

    def table(rel: str, p1: str, p2: str) -> DataFrame:
        r = rows.where((F.col("rel") == rel) & (F.col("p1") == p1) & (F.col("p2") == p2))
        return r.select("sub", F.col("p1").alias("pred"), "obj", "kind", "dt", "lang", "num", "ts")

    return table


def bgp_tables(store: TripleStore, rows: DataFrame, choice: list) -> dict[int, DataFrame]:
    """Map pattern index -> reduced table from a collected choice (one row per pattern)."""
    table = reduced_store(rows)
    return {r["idx"]: table(r["rel"], r["p1"], r["p2"]) for r in choice if r["rel"] != "VP"}


def bgp_sizes(patterns: Sequence[tuple], choice: list) -> list[float]:
    """Rows of the chosen table of each pattern, for the join order of ``bgp(sizes=...)``: 0 for a predicate
    without triples; a variable predicate counts as the largest of all."""
    size = {r["idx"]: float(r["size"] or 0) for r in choice}
    return [size.get(i, float("inf")) for i in range(len(patterns))]
