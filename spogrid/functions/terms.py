"""RDF terms as columns.

A triple row is ``sub, pred, obj, kind, dt, lang, num, ts``: ``obj`` is the
lexical form (unquoted), ``kind`` is ``'iri'`` or ``'lit'``, ``dt`` the datatype
(compact IRI) of a typed literal, ``lang`` the language tag of a language
literal, and ``num`` / ``ts`` hold the value of numeric and temporal literals
so comparisons are numeric or temporal without per-predicate type lists.

All helpers here return ``Column`` expressions built from Spark built-ins, so
they stay inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Standard vocabulary namespaces plus our own shop vocabulary.
PREFIXES: dict[str, str] = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "rev": "http://purl.org/stuff/rev#",
    "shop": "http://example.org/shop/vocabulary/",
    "inst": "http://example.org/shop/instances/",
}

TRIPLE_SCHEMA = T.StructType(
    [
        T.StructField("sub", T.StringType(), False),
        T.StructField("pred", T.StringType(), False),
        T.StructField("obj", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("dt", T.StringType(), True),
        T.StructField("lang", T.StringType(), True),
        T.StructField("num", T.DoubleType(), True),
        T.StructField("ts", T.TimestampNTZType(), True),
    ]
)
TRIPLE_COLUMNS = [f.name for f in TRIPLE_SCHEMA.fields]
# Columns that describe an object term besides its lexical form.
TERM_AUX = ["kind", "dt", "lang", "num", "ts"]

NUMERIC_TYPES = ("xsd:integer", "xsd:int", "xsd:long", "xsd:decimal", "xsd:double", "xsd:float", "shop:USD")
TEMPORAL_TYPES = ("xsd:date", "xsd:dateTime")

# Lexical formats used when values become text (same on the DuckDB side).
DATETIME_FMT = "yyyy-MM-dd'T'HH:mm:ss"
DATE_FMT = "yyyy-MM-dd"


@dataclass(frozen=True)
class Lit:
    """A literal constant in a pattern or template."""

    value: object
    dt: str | None = None
    lang: str | None = None

    @property
    def lexical(self) -> str:
        return str(self.value)


def is_var(term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def is_blank(term) -> bool:
    return isinstance(term, str) and term.startswith("_:")


def var_name(term: str) -> str:
    """Column name of a variable (``?x`` -> ``x``); blank nodes get a hidden name."""
    if is_var(term):
        return term[1:]
    if is_blank(term):
        return "_b_" + term[2:]
    raise ValueError(f"not a variable: {term!r}")


def aux(var: str, part: str) -> str:
    """Name of an auxiliary term column of a variable, e.g. ``price__num``."""
    return f"{var.lstrip('?')}__{part}"


def num(var: str) -> Column:
    """Numeric value of a variable bound to a literal."""
    return F.col(aux(var, "num"))


def ts(var: str) -> Column:
    """Temporal value of a variable bound to a date / dateTime literal."""
    return F.col(aux(var, "ts"))


def lang(var: str) -> Column:
    """``lang(?x)``: the language tag, '' for literals without one (SPARQL)."""
    return F.coalesce(F.col(aux(var, "lang")), F.lit(""))


def datatype(var: str) -> Column:
    return F.col(aux(var, "dt"))


def term(var: str) -> Column:
    """``str(?x)``: the lexical form."""
    return F.col(var.lstrip("?"))


# ---------------------------------------------------------------- literals


def typed_value_columns(lexical: Column, dt: Column) -> tuple[Column, Column]:
    """(num, ts) of a literal from its lexical form and datatype, via try_cast."""
    num_c = F.when(dt.isin(*NUMERIC_TYPES), lexical.try_cast("double"))
    ts_c = (
        F.when(dt == "xsd:dateTime", F.try_to_timestamp(F.regexp_replace(lexical, "T", " ")).cast("timestamp_ntz"))
        .when(dt == "xsd:date", F.try_to_timestamp(lexical, F.lit("yyyy-MM-dd")).cast("timestamp_ntz"))
    )
    return num_c, ts_c


def _replace_all(c: Column, pairs) -> Column:
    """Literal (non-regex) replacements in order."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), pairs, c)


# escaped backslashes are protected first, so an escaped backslash followed by
# 'n' stays a backslash and an 'n'
_PROTECT = [("\\\\", "\u0000")]
_UNESCAPE = [('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\u0000", "\\")]
_ESCAPE = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]


def held(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it (it stands in an array of one)."""
    return F.element_at(F.transform(F.array(c), f), 1)


def unescape(c: Column) -> Column:
    """Text without N-Triples escapes: the short ones, ``\\uXXXX`` and ``\\UXXXXXXXX``."""
    # most texts have no escape; the others are held, so that each step sees a value and not an expression that grows with the steps
    return held(c, lambda x: F.when(F.contains(x, F.lit("\\")), _unescape(x)).otherwise(x))


def _unescape(c: Column) -> Column:
    c = _replace_all(c, _PROTECT)
    for mark, size, charset in (("\\u", 4, "UTF-16BE"), ("\\U", 8, "UTF-32")):
        # few texts have codes: only those are searched for them
        c = held(c, lambda x: F.when(F.contains(x, F.lit(mark)), _decode_codes(x, mark, size, charset)).otherwise(x))  # noqa: B023
    return _replace_all(c, _UNESCAPE)


def _decode_codes(c: Column, mark: str, size: int, charset: str) -> Column:
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit(f"\\{mark}([0-9A-Fa-f]{{{size}}})"), 1))

    def put(text: Column, code: Column) -> Column:
        return F.replace(text, F.concat(F.lit(mark), code), F.decode(F.unhex(code), charset))

    return F.aggregate(codes, c, put)


def parse_term(text: Column) -> Column:
    """Parse one N-Triples term (``<iri>``, ``_:b``, ``"x"``, ``"x"^^<dt>``, ``"x"@en``).

    Returns a struct ``(value, kind, dt, lang)``.  The literal body runs from
    the first to the last quote (an escaped body holds no bare quote), found
    with string functions; only the short suffix after it goes through a
    regular expression, so long texts cost one pass of literal replacements.
    """
    return held(F.trim(text), _parse_trimmed)


def _parse_trimmed(t: Column) -> Column:
    none = F.lit(None).cast("string")

    def term(value: Column, kind: str, dt: Column = none, lang_c: Column = none) -> Column:
        return F.struct(value.alias("value"), F.lit(kind).alias("kind"), dt.alias("dt"), lang_c.alias("lang"))

    def literal(last: Column) -> Column:
        """``last`` is the position of the closing quote."""
        return held(F.substr(t, last + F.lit(1), F.length(t)), lambda suffix: with_suffix(F.substr(t, F.lit(2), last - F.lit(2)), suffix))

    def with_suffix(body: Column, suffix: Column) -> Column:
        dt_iri = F.regexp_extract(suffix, r"^\^\^<(.*)>$", 1)
        lang_tag = F.regexp_extract(suffix, r"^@([A-Za-z0-9-]+)$", 1)
        dt = F.when(dt_iri != "", shorten(dt_iri)).when(lang_tag == "", F.lit("xsd:string"))
        return term(unescape(body), "lit", dt, F.when(lang_tag != "", F.lower(lang_tag)))

    iri = term(unescape(F.substr(t, F.lit(2), F.length(t) - F.lit(2))), "iri")
    node = F.when(t.startswith("_:"), term(t, "bnode")).otherwise(held(F.length(t) - F.instr(F.reverse(t), '"') + 1, literal))
    return F.when(t.startswith("<"), iri).otherwise(node)


def format_term(obj: Column, kind: Column, dt: Column, lang_c: Column) -> Column:
    """Inverse of :func:`parse_term`: the N-Triples text of an object term."""
    quoted = F.concat(F.lit('"'), _replace_all(obj, _ESCAPE), F.lit('"'))
    literal = (
        F.when(lang_c.isNotNull(), F.concat(quoted, F.lit("@"), lang_c))
        .when(dt.isNotNull() & (dt != "xsd:string"), F.concat(quoted, F.lit("^^<"), expand(dt), F.lit(">")))
        .otherwise(quoted)
    )
    return F.when(kind == "iri", F.concat(F.lit("<"), expand(obj), F.lit(">"))).when(kind == "bnode", obj).otherwise(
        literal
    )


# ---------------------------------------------------------------- IRIs


def expand(col: Column, prefixes: dict[str, str] | None = None, base: str | None = None) -> Column:
    """``rdfs:label`` -> full IRI; relative IRIs (``product/3``) get ``base``."""
    prefixes = prefixes or PREFIXES
    base = PREFIXES["inst"] if base is None else base
    out = None
    for p, ns in prefixes.items():
        cond = col.startswith(p + ":")
        val = F.concat(F.lit(ns), F.substring(col, len(p) + 2, 1 << 30))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    is_abs = col.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return out.when(is_abs, col).otherwise(F.concat(F.lit(base), col))


def shorten(col: Column, prefixes: dict[str, str] | None = None, base: str | None = None) -> Column:
    """Full IRI -> compact form; the longest matching namespace wins."""
    prefixes = prefixes or PREFIXES
    base = PREFIXES["inst"] if base is None else base
    out = None
    for p, ns in sorted(prefixes.items(), key=lambda kv: -len(kv[1])):
        if ns == base:
            continue
        cond = col.startswith(ns)
        val = F.concat(F.lit(p + ":"), F.substring(col, len(ns) + 1, 1 << 30))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    out = out.when(col.startswith(base), F.substring(col, len(base) + 1, 1 << 30))
    return out.otherwise(col)


def clean_iri(col: Column) -> Column:
    """Table-safe name of a predicate: every run of non-word characters becomes ``_``.

    The whole IRI is kept (no truncation), so distinct predicates never collide
    unless they differ only in punctuation.
    """
    return F.regexp_replace(col, r"[^A-Za-z0-9]+", "_")


def lang_matches(lang_col: Column, tag: str) -> Column:
    """SPARQL ``langMatches``: case-insensitive; ``*`` matches any tag; prefix on '-'."""
    lc = F.lower(F.coalesce(lang_col, F.lit("")))
    t = tag.lower()
    if t == "*":
        return lc != ""
    return (lc == t) | lc.startswith(t + "-")


def cast_term(col: Column, xsd_type: str) -> Column:
    """``xsd:float(?x)`` and friends: NULL (unbound) where the cast fails."""
    target = {
        "xsd:float": "double",
        "xsd:double": "double",
        "xsd:decimal": "decimal(18,2)",
        "xsd:integer": "bigint",
        "xsd:string": "string",
        "xsd:boolean": "boolean",
    }[xsd_type]
    return col.try_cast(target)
