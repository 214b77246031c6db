"""Triple patterns and basic graph patterns.

A pattern is a ``(s, p, o)`` tuple.  A string starting with ``?`` is a
variable, ``_:x`` is a blank node (an unnamed variable, dropped after the
BGP), any other string is an IRI, and a :class:`~spogrid.functions.terms.Lit`
or a Python number is a literal.

A solution DataFrame has one column per variable holding the lexical form;
variables bound in object position also carry ``<var>__kind``, ``__dt``,
``__lang``, ``__num`` and ``__ts`` so filters compare typed values.  Unused
columns cost nothing: Catalyst prunes them before the scan.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.functions.terms import TERM_AUX, Lit, aux, is_blank, is_var, var_name

Pattern = tuple


def _is_variable(t) -> bool:
    return is_var(t) or is_blank(t)


def const_obj_cond(o, obj=None, kind=None, lang=None, dt=None, num=None) -> Column:
    """Match of a constant object against the object columns (or given expressions)."""
    obj = F.col("obj") if obj is None else obj
    kind = F.col("kind") if kind is None else kind
    lang = F.col("lang") if lang is None else lang
    dt = F.col("dt") if dt is None else dt
    num = F.col("num") if num is None else num
    if isinstance(o, Lit):
        cond = (obj == o.lexical) & (kind == "lit")
        if o.lang is not None:
            return cond & (F.lower(lang) == o.lang.lower())
        if o.dt is not None and o.dt != "xsd:string":
            return cond & (dt == o.dt)
        # a plain literal: without a language, of no type or xsd:string
        return cond & lang.isNull() & (dt.isNull() | (dt == "xsd:string"))
    if isinstance(o, bool):
        return (obj == str(o).lower()) & (kind == "lit")
    if isinstance(o, (int, float)):
        return (num == float(o)) & (kind == "lit")
    return (obj == o) & (kind == "iri")


def const_key(term: str) -> str:
    """Hidden column that carries a constant IRI so patterns sharing it equi-join."""
    return "_k_" + hashlib.sha1(term.encode()).hexdigest()[:10]


def _is_iri_const(t) -> bool:
    return isinstance(t, str) and not _is_variable(t)


def _pattern_consts(pat):
    s, p, o = pat
    pred = None if _is_variable(p) else p
    sub_const = s if _is_iri_const(s) else None
    obj_iri = o if _is_iri_const(o) else None
    obj_is_lit = not _is_variable(o) and not _is_iri_const(o)
    return pred, sub_const, obj_iri, obj_is_lit


def _allowed_for(pat, allowed):
    if not allowed:
        return None, None
    s, _, o = pat
    sa = allowed.get(var_name(s)) if _is_variable(s) else None
    oa = allowed.get(var_name(o)) if _is_variable(o) else None
    return sa, oa


def _scan(triples, pat, allowed=None, sub_in=None) -> DataFrame:
    """Triples a pattern can match: for a store, only the branches whose
    predicate and IRI prefixes fit, with constant IRIs pushed to key filters."""
    from spogrid.sources.store import TripleStore

    if isinstance(triples, TripleStore):
        return triples.scan(*_pattern_consts(pat), *_allowed_for(pat, allowed), sub_in=sub_in)
    return triples


def var_prefixes(store, patterns, skip=()) -> dict[str, set]:
    """IRI prefixes each variable can take: in an inner join a variable's
    values must fit every pattern binding it, so the keyed prefixes of the
    candidate branches are intersected across patterns."""
    from spogrid.sources.store import compatible

    allowed: dict[str, set] = {}
    for i, pat in enumerate(patterns):
        if i in skip:
            continue
        cands = store.candidates(*_pattern_consts(pat))
        for pos, t in (("sub", pat[0]), ("obj", pat[2])):
            if not _is_variable(t):
                continue
            ps: set | None = set()
            for b, _ in cands:
                k = b.sub_key if pos == "sub" else b.obj_key
                if k is None:
                    ps = None
                    break
                ps.add(k.prefix)
            if ps is None:
                continue
            name = var_name(t)
            if name in allowed:
                ps = {max(x, y, key=len) for x in allowed[name] for y in ps if compatible(x, y)}
            allowed[name] = ps
    return allowed


def triple_pattern(
    triples,
    pat: Pattern,
    source: DataFrame | None = None,
    keep: frozenset | set = frozenset(),
    allowed: dict | None = None,
    sub_in: DataFrame | None = None,
) -> DataFrame:
    """Solutions of one triple pattern.

    ``source`` may be a pre-reduced table (VP or ExtVP) holding the triples of
    the pattern's predicate; it must have the triple columns.  Constant IRIs
    in ``keep`` are carried as hidden key columns (:func:`const_key`).
    """
    from spogrid.sources.store import select_preds

    s, p, o = pat
    if isinstance(p, tuple):
        df = source if source is not None else select_preds(triples, p)
        df, p = df.where(F.col("pred").isin(list(p))), None
    else:
        df = source if source is not None else _scan(triples, pat, allowed, sub_in)
    if p is not None and not _is_variable(p):
        df = df.where(F.col("pred") == p)
    if not _is_variable(s):
        df = df.where(F.col("sub") == s)
    if not _is_variable(o):
        df = df.where(const_obj_cond(o))

    cols: list[Column] = []
    names: list[str] = []
    seen: dict[str, str] = {}
    # a variable used twice in one pattern means equality of the positions
    for position, t in (("sub", s), ("pred", p), ("obj", o)):
        if t is None or not _is_variable(t):
            continue
        name = var_name(t)
        if name in seen:
            df = df.where(F.col(seen[name]) == F.col(position))
            if position == "obj":  # subjects and predicates are IRIs
                df = df.where(F.col("kind") == "iri")
            continue
        seen[name] = position
        cols.append(F.col(position).alias(name))
        names.append(name)
        if position == "obj":
            cols.extend(F.col(a).alias(aux(name, a)) for a in TERM_AUX)
        else:
            cols.extend(iri_aux(name))
    for position, t in (("sub", s), ("obj", o)):
        if _is_iri_const(t) and t in keep and const_key(t) not in names:
            cols.append(F.col(position).alias(const_key(t)))
            names.append(const_key(t))
    if not cols:  # fully bound pattern: an existence test, one row if it matches
        return df.select(F.lit(1).alias("__ask")).distinct()
    return df.select(*cols)


def iri_aux(name: str) -> list[Column]:
    """Term columns of a variable that stands for an IRI (a subject or predicate)."""
    types = {"num": "double", "ts": "timestamp_ntz"}
    return [F.lit("iri" if a == "kind" else None).cast(types.get(a, "string")).alias(aux(name, a)) for a in TERM_AUX]


def variables(df: DataFrame) -> list[str]:
    """Visible variable columns of a solution DataFrame (no auxiliary columns)."""
    return [c for c in df.columns if "__" not in c]


def shared_vars(a: DataFrame, b: DataFrame) -> list[str]:
    bv = set(variables(b))
    return [c for c in variables(a) if c in bv]


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join two solution sets on all shared variables (never just the first one), as terms:
    see :func:`same_term`.  Without a shared variable it is an error; a cross
    product must be asked for (:func:`~spogrid.operators.algebra.cross`)."""
    on = shared_vars(a, b)
    if not on:
        raise ValueError("patterns share no variable: this would be a cross product; ask for it with cross()")
    b = renamed(a, b)
    out = a.join(b, reduce(lambda x, y: x & y, [same_term(a, b, v) for v in on]), how)
    return out.drop(*[c for c in b.columns if c.endswith(_RIGHT)])


# Suffix of the right side's columns in a join whose names the left side has too.
_RIGHT = "__right"


def renamed(a: DataFrame, b: DataFrame) -> DataFrame:
    """``b`` with the columns that ``a`` has too renamed."""
    have = set(a.columns)
    return b.select(*[F.col(c).alias(c + _RIGHT) if c in have else F.col(c) for c in b.columns])


def same_term(a: DataFrame, b: DataFrame, v: str) -> Column:
    """Equality of a shared variable as a term: lexical form, kind, datatype and language (``b`` is
    :func:`renamed`).  Where one side carries only the text (a parameter table), texts are compared.
    Kinds that are constant on both sides fold away before the join is planned."""
    cond = F.col(v) == F.col(v + _RIGHT)
    if aux(v, "kind") in a.columns and aux(v, "kind") + _RIGHT in b.columns:
        for part in ("kind", "dt", "lang"):
            left, right = F.col(aux(v, part)), F.col(aux(v, part) + _RIGHT)
            if part == "dt":  # xsd:string is the type of plain literals
                left, right = (F.when(x != "xsd:string", x) for x in (left, right))
            if part == "lang":
                left, right = F.lower(left), F.lower(right)
            cond = cond & left.eqNullSafe(right)
    return cond


def _pattern_vars(pat) -> set[str]:
    return {var_name(t) for t in pat if _is_variable(t)}


def _n_consts(pat) -> int:
    return sum(1 for t in pat if not _is_variable(t))


def join_order(
    patterns: Sequence[Pattern],
    sizes: Sequence[float] | None = None,
    consts: Sequence[int] | None = None,
    bound: set[str] | None = None,
) -> list[int]:
    """Connected greedy order: most constants first (then smallest table), then a
    pattern sharing a variable with those already joined, so no accidental cross
    product.  Ties keep the written order."""
    consts = list(consts) if consts is not None else [_n_consts(p) for p in patterns]
    return _order_units([_pattern_vars(p) for p in patterns], consts, sizes, bound)


def _order_units(var_sets, consts, sizes=None, bound=None) -> list[int]:
    n = len(var_sets)
    sizes = list(sizes) if sizes is not None else [0.0] * n
    remaining = list(range(n))

    def key(i):
        return (-consts[i], sizes[i], i)

    order: list[int] = []
    bound = set(bound or ())
    if not bound:
        first = min(remaining, key=key)
        order.append(first)
        remaining.remove(first)
        bound = set(var_sets[first])
    while remaining:
        connected = [i for i in remaining if var_sets[i] & bound]
        nxt = min(connected or remaining, key=key)
        order.append(nxt)
        remaining.remove(nxt)
        bound |= var_sets[nxt]
    return order


def _star_groups(store, patterns, skip, allowed=None) -> dict:
    """Patterns on one subject whose predicates each come from exactly one
    functional branch of the same source: ``(subject, source) -> [(index, branch, conds), ...]``.

    A source that extends another (the same rows, joined with more columns)
    takes in the patterns over that one: the join is needed anyway."""
    groups: dict = {}
    for i, pat in enumerate(patterns):
        s, p, o = pat
        if i in skip or not isinstance(p, str) or _is_variable(p) or not isinstance(s, str):
            continue
        cands = store.candidates(*_pattern_consts(pat), *_allowed_for(pat, allowed))
        if len(cands) != 1 or not cands[0][0].functional or not store.unique(cands[0][0]):
            continue
        b, conds = cands[0]
        groups.setdefault((s, id(b.source)), []).append((i, b, conds))
    for s, source in list(groups):
        wider = next((k for k in groups if k[0] == s and store.base_of(k[1]) == source), None)
        if wider:
            groups[wider] += groups.pop((s, source))
    return groups


def _extras(store, group, patterns) -> list:
    """Of some patterns on a star's subject, those its source answers in the same scan:
    ``[(pattern, branches), ...]``, one functional branch for each predicate."""
    source = id(group[0][1].source)
    out = []
    for pat in patterns:
        preds = pat[1] if isinstance(pat[1], tuple) else (pat[1],)
        found = [store.candidates(*_pattern_consts((pat[0], p, pat[2]))) for p in preds]
        if all(
            len(c) == 1 and c[0][0].functional and source in (id(c[0][0].source), store.extension_of(id(c[0][0].source), source))
            for c in found
        ):
            out.append((pat, [c[0][0] for c in found]))
    return out


def _term_struct(b) -> Column:
    return F.struct(b.obj.alias("obj"), F.lit(b.kind).alias("kind"), b.dt.alias("dt"), b.lang.alias("lang"), b.num.alias("num"), b.ts.alias("ts"))


def _star_frame(patterns, group, keep, sub_in: DataFrame | None = None, optionals=(), choices=()) -> DataFrame:
    """One scan of the shared source for a star of functional patterns
    (``sub_in``: subject values to semi-join into the source first).  ``optionals``
    are nullable columns of the same row, ``choices`` give one row for each of several
    predicates that the row has."""
    b0 = group[0][1]
    subject = patterns[group[0][0]][0]
    conds: list[Column] = []
    sel: list[Column] = []
    names: dict[str, tuple] = {}
    if _is_variable(subject):
        names[var_name(subject)] = (b0.sub, None)
        sel.append(b0.sub.alias(var_name(subject)))
        sel.extend(iri_aux(var_name(subject)))
    else:
        conds.append(b0.sub == subject)
        if subject in keep:
            names[const_key(subject)] = (b0.sub, None)
            sel.append(b0.sub.alias(const_key(subject)))
    for i, b, bconds in group:
        o = patterns[i][2]
        conds.extend(bconds)
        conds.append(b.present)
        if _is_variable(o):
            name = var_name(o)
            if name in names:
                expr, other = names[name]
                kind = "iri" if other is None else other.kind
                conds.append((b.obj == expr) & F.lit(b.kind == kind))
                if other is not None:
                    conds.append(F.when(b.dt != "xsd:string", b.dt).eqNullSafe(F.when(other.dt != "xsd:string", other.dt)))
                    conds.append(F.lower(b.lang).eqNullSafe(F.lower(other.lang)))
                continue
            names[name] = (b.obj, b)
            sel.append(b.obj.alias(name))
            for part, expr in (("kind", F.lit(b.kind)), ("dt", b.dt), ("lang", b.lang), ("num", b.num), ("ts", b.ts)):
                sel.append(expr.alias(aux(name, part)))
        else:
            conds.append(const_obj_cond(o, b.obj, F.lit(b.kind), b.lang, b.dt, b.num))
            if _is_iri_const(o) and o in keep and const_key(o) not in names:
                names[const_key(o)] = (b.obj, b)
                sel.append(b.obj.alias(const_key(o)))
    src = b0.source.where(reduce(lambda x, y: x & y, conds))
    if sub_in is not None:
        from spogrid.sources.store import restrict

        src = restrict(src, b0.sub, sub_in)
    for (_, _, o), (b,) in optionals:
        name = var_name(o)
        sel.append(F.when(b.present, b.obj).alias(name))
        for part, expr in (("kind", F.lit(b.kind)), ("dt", b.dt), ("lang", b.lang), ("num", b.num), ("ts", b.ts)):
            sel.append(F.when(b.present, expr).alias(aux(name, part)))
    for (_, _, o), branches in choices:
        name = var_name(o)
        terms = F.filter(F.array(*[F.when(b.present, _term_struct(b)) for b in branches]), lambda x: x.isNotNull())
        src = src.select("*", F.explode(terms).alias("__c_" + name))
        sel += [F.col(f"__c_{name}.{part}").alias(name if part == "obj" else aux(name, part)) for part in ("obj", *TERM_AUX)]
    return src.select(*sel) if sel else src.select(F.lit(1).alias("__ask")).distinct()


def bgp(
    triples,
    patterns: Sequence[Pattern],
    tables: dict[int, DataFrame] | None = None,
    sizes: Sequence[float] | None = None,
    keep_consts: bool = False,
    seed: DataFrame | None = None,
    optionals: Sequence[Pattern] = (),
) -> DataFrame:
    """Basic graph pattern: n-ary inner natural join of the pattern solutions.

    A predicate may be a tuple of predicates: the pattern then matches any of them (a
    UNION of patterns).  ``optionals`` are single OPTIONAL patterns, each with a new
    variable as its object.  Where the store knows that one source row holds them beside other
    patterns on the same subject, both are columns of the same scan instead of joins.

    ``triples`` is a triple DataFrame or a :class:`~spogrid.sources.store.TripleStore`
    (then a bound predicate reads only its own partition).

    ``tables`` optionally maps a pattern index to a reduced table to scan
    instead of the triple table (see :func:`spogrid.operators.extvp.choose_tables`);
    ``sizes`` gives table sizes to order the joins.  Blank-node columns are
    dropped at the end.

    A constant IRI used by two or more patterns (``<p10> label ?l . <p10>
    comment ?c``) is carried as a hidden key column, so those patterns are an
    equi-join on it instead of a cross product.  ``keep_consts`` keeps such
    keys for every constant and leaves them in the result, so a later
    :func:`~spogrid.operators.algebra.optional` on the same constant joins on it.

    ``seed`` is a solution DataFrame (e.g. a one-row parameter table) that the
    fold starts from, so its bindings restrict the first join.
    """
    tables = tables or {}
    uses = Counter(t for pat in patterns for t in {pat[0], pat[2]} if _is_iri_const(t))
    keep = {t for t, n in uses.items() if n >= 2 or keep_consts}
    keep |= {pat[0] for pat in optionals if _is_iri_const(pat[0])}
    keyed = [tuple(t if not (_is_iri_const(t) and t in keep) else ("?" + const_key(t)) for t in pat) for pat in patterns]
    sizes = list(sizes) if sizes is not None else [0.0] * len(patterns)

    # units: merged stars over one keyed source, and single patterns
    units: list[tuple[set, int, float, object]] = []
    merged: set[int] = set()
    joined = list(optionals)
    from spogrid.sources.store import TripleStore

    allowed = None
    seeded = set(variables(seed)) if seed is not None else set()

    def sub_in(subject):
        # a subject bound by the seed (a parameter table) restricts the source early
        if _is_variable(subject) and var_name(subject) in seeded:
            return seed.select(var_name(subject))
        return None

    if isinstance(triples, TripleStore) and triples.virtual:
        several = {i for i, pat in enumerate(patterns) if isinstance(pat[1], tuple)}
        allowed = var_prefixes(triples, patterns, set(tables) | several)
        for (subject, _), g in _star_groups(triples, patterns, set(tables) | several, allowed).items():
            mine = [pat for pat in joined if pat[0] == subject]
            opts = _extras(triples, g, mine)
            alts = _extras(triples, g, [patterns[i] for i in several if i not in merged and patterns[i][0] == subject])
            if len(g) + len(opts) + len(alts) < 2:
                continue
            taken = [pat for pat, _ in opts]
            joined = [pat for pat in joined if pat not in taken]
            idx = [i for i, _, _ in g] + [i for i in several if patterns[i] in [pat for pat, _ in alts]]
            merged.update(idx)
            vs = set().union(*[_pattern_vars(keyed[i]) for i in idx])
            units.append((vs, sum(_n_consts(patterns[i]) for i in idx), min(sizes[i] for i in idx),
                          lambda g=g, o=opts, a=alts: _star_frame(patterns, g, keep, sub_in(patterns[g[0][0]][0]), o, a)))
    for i, pat in enumerate(patterns):
        if i not in merged:
            units.append((_pattern_vars(keyed[i]), _n_consts(pat), sizes[i],
                          lambda i=i: triple_pattern(triples, patterns[i], tables.get(i), keep, allowed,
                                                     sub_in(patterns[i][0]))))

    order = _order_units(
        [u[0] for u in units], [u[1] for u in units], [u[2] for u in units],
        set(variables(seed)) if seed is not None else None,
    )
    acc = seed
    for k in order:
        sol = units[k][3]()
        acc = sol if acc is None else natural_join(acc, sol)
    for pat in joined:
        acc = natural_join(acc, triple_pattern(triples, pat, None, keep, None), "left")
    hidden = [c for c in acc.columns if c.startswith("_b_") or c == "__ask"]
    if not keep_consts:
        hidden += [c for c in acc.columns if c.startswith("_k_")]
    return acc.drop(*hidden)


def substitute(patterns: Sequence[Pattern], equal: dict[str, str]) -> list[Pattern]:
    """``FILTER(?a = ?b)`` as substitution: rename ``?a`` to ``?b`` in every pattern,
    so the equality becomes a join key instead of a filter over a product.
    :func:`assign` gives ``?a`` back to the solutions."""
    return [tuple(equal.get(t, t) if isinstance(t, str) else t for t in pat) for pat in patterns]


def assign(sol: DataFrame, equal: dict[str, str]) -> DataFrame:
    """After :func:`substitute`: the replaced variables, bound to the same terms."""
    for a, b in equal.items():
        a, b = var_name(a), var_name(b)
        sol = sol.withColumns({a: F.col(b)} | {aux(a, x): F.col(aux(b, x)) for x in TERM_AUX if aux(b, x) in sol.columns})
    return sol
