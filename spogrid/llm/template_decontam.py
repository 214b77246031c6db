"""Benchmark decontamination by templates, with DataFrame functions alone.

A text becomes a template: numbers, names (capitalised words inside a sentence)
and units after a number turn into typed placeholders, all else is lower-cased.
Runs of five template tokens are hashed where at least three are literal words;
other runs by their surface forms, as placeholders alone say nothing, and items of
fewer than five tokens as a whole. Those of the benchmark are joined with all of
all documents. Document and item meet at an offset; the windows of the item that a document holds are its
coverage. Where an item has placeholders, their surface forms (slots) must be
consistent in what matched windows cover, each at its own offset: the same number, name or unit in the item stands for the same one
in the document, and different ones for different ones, so a question with new
numbers is caught, and a text that merely has numbers in the same places is not.

A document is contaminated by an item when it is consistent and either holds
at least 0.8 of the item's windows (all, or those of literal words), or nine windows in a row (thirteen
words, a common convention for long passages), or all its tokens in place but for one that was
replaced or left out (items of ten tokens or more) or two that were replaced (twenty or more).
An inserted word is found by coverage or run alone.

The benchmark's windows and the candidates are broadcast only when they were counted and
are few; otherwise the joins shuffle, and a frequent window is split by adaptive execution.

Defined cases: null and empty texts match nothing; items of fewer than five tokens
match where all their tokens stand in a row; items of equal text are reported each; rows with the same doc_id are one document; rows
with a null id are not reported, and stay; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.llm.shared import few, stored

WINDOW, LITERALS, COVERAGE, RUN = 5, 3, 0.8, 9
NEAR = 16  # shifts up to so far apart are read as one place of the document
JOINER, NAME, UNIT, NUMBER = "\ue000", "\ue001", "\ue002", "0"
UNITS = (
    "kilometers", "kilometres", "centimeters", "centimetres", "millimeters", "millimetres", "kilograms", "milligrams", "milliliters",
    "millilitres", "meters", "metres", "grams", "liters", "litres", "miles", "yards", "inches", "feet", "pounds", "ounces", "gallons",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "percent", "degrees", "dollars", "euros", "cents", "usd", "eur",
    "kg", "mg", "km", "cm", "mm", "ml", "lbs", "lb", "oz", "mph", "kmh", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "kw", "kwh",
)
# What marks surface forms (in order), then what turns marked and lower-cased text into a template. $1, $2: groups.
MARKS = (
    ("([0-9])[.,:/]([0-9])", f"$1{JOINER}$2"),
    (r"([\p{L}\p{N},;] )(\p{Lu}\p{Ll})", f"$1{NAME}$2"),
)
TEMPLATE = (
    (f"{NAME}[\\p{{L}}\\p{{N}}{JOINER}]+", NAME),
    (f"[0-9][0-9{JOINER}]*", NUMBER),
    (f"(^|[^\\p{{L}}\\p{{N}}]){NUMBER} ({'|'.join(UNITS)})($|[^\\p{{L}}\\p{{N}}])", f"$1{NUMBER} {UNIT}$3"),
)
BREAK = f"[^\\p{{L}}\\p{{N}}{JOINER}{NAME}{UNIT}]+"


def _replaced(text: Column, steps) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, *step), steps, text)


def surface(text: Column) -> Column:
    """Tokens in lower case; a name is the same at a sentence's start, where it bears no mark."""
    return F.transform(F.array_remove(F.split(F.lower(_replaced(text, MARKS)), BREAK), ""), lambda x: F.translate(x, NAME, ""))


def template(text: Column) -> Column:
    """Template tokens, as many as surface() has."""
    return F.array_remove(F.split(_replaced(F.lower(_replaced(text, MARKS)), TEMPLATE), BREAK), "")


def _windows(tokens: str, of) -> Column:
    last = F.size(tokens) - WINDOW
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), of))


def _hash(tokens: str):
    return lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(WINDOW)))


def _form_hash(tokens: str, n: int):
    """Of surface forms, and of no template."""
    return lambda i: F.xxhash64(F.lit("forms"), F.lit(n), *(F.get(tokens, (i + k).cast("int")) for k in range(n)))


def _heavy(tokens: str) -> Column:
    """Where windows with too few literal words begin: three slots or more lie within five tokens."""
    need = WINDOW - LITERALS + 1
    last = F.size(tokens) - WINDOW
    slots = F.filter(F.transform(tokens, lambda x, i: F.when(_is_slot(x), i)), lambda i: i.isNotNull())
    spans = F.zip_with(slots, F.slice(slots, need, F.greatest(F.size(slots), F.lit(1))), lambda a, z: F.when(
        (z - a < WINDOW) & (F.greatest(z - WINDOW + 1, F.lit(0)) <= F.least(a, last)), F.sequence(F.greatest(z - WINDOW + 1, F.lit(0)), F.least(a, last))))
    return F.array_distinct(F.flatten(F.filter(spans, lambda s: s.isNotNull())))


def _is_slot(token: Column) -> Column:
    return token.isin(NAME, UNIT) | F.contains(token, F.lit(NUMBER))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, matched, coverage, run, shift, slots, changed, short): one row for each
    document and item that contaminates it; shift: the item's place in the document's tokens, changed: slots
    with another surface form, short: the item's text has fewer tokens than a window."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    # each text of an item under a number of its own
    items = items.distinct().select(F.monotonically_increasing_id().alias("item_id"), F.col("item_id").alias("own"), template(F.col("text")).alias("t"), surface(F.col("text")).alias("s"))
    items = stored(items, "benchmark-templates")
    owners = items.select("item_id", "own", F.size("t").between(1, WINDOW - 1).alias("short"))
    items = items.drop("own")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    split = items.withColumn("heavy", _heavy("t"))
    plain_at = F.filter(F.sequence(F.lit(0), F.size("t") - WINDOW), lambda i: ~F.array_contains("heavy", i))
    by_template = split.where(F.size("t") >= WINDOW).select("item_id", F.explode(F.transform(plain_at, lambda i: F.struct(i.alias("item_at"), _hash("t")(i).alias("h"), F.lit(True).alias("literal")))).alias("w"))
    by_form = split.where(F.size("t") >= WINDOW).select("item_id", F.explode(F.transform("heavy", lambda i: F.struct(i.alias("item_at"), _form_hash("s", WINDOW)(i).alias("h"), F.lit(False).alias("literal")))).alias("w"))
    short = split.where(F.size("t").between(1, WINDOW - 1))
    whole = short.select("item_id", F.lit(0).alias("item_at"), F.coalesce(*(F.when(F.size("s") == n, _form_hash("s", n)(F.lit(0))) for n in range(1, WINDOW))).alias("h"), F.lit(False).alias("literal"))
    places = stored(by_template.unionByName(by_form).select("item_id", "w.*").unionByName(whole), "benchmark-windows")
    joined = few(places)
    tokens = texts.select("doc_id", "text", template(F.col("text")).alias("t")).withColumn("heavy", _heavy("t"))
    tokens = tokens.select("doc_id", "t", "heavy", F.when(F.size("heavy") > 0, surface(F.col("text"))).alias("s"))
    none = F.array().cast("array<bigint>")
    hashes = F.concat(F.coalesce(_windows("t", _hash("t")), none), F.coalesce(F.transform("heavy", _form_hash("s", WINDOW)), none))
    windows = tokens.select("doc_id", "heavy", (F.size("t") - WINDOW + 1).alias("n"), F.posexplode(hashes).alias("at", "h"))
    windows = windows.select("doc_id", F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(F.get("heavy", F.col("at") - F.col("n"))).alias("doc_at"), "h")
    met = windows.join(joined, "h")
    # whole items of fewer tokens than a window: their own lengths, if there are any
    for (n,) in short.select(F.size("t")).distinct().collect():
        forms = texts.select("doc_id", surface(F.col("text")).alias("s")).where(F.size("s") >= n)
        forms = forms.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("s") - n), _form_hash("s", n))).alias("doc_at", "h"))
        met = met.unionByName(forms.join(joined, "h"))
    met = met.groupBy("doc_id", "item_id", "item_at", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.max("literal").alias("literal"))
    met = stored(met, "template-matches")
    # windows in a row: at one offset, places less their rank stay the same
    row = met.withColumn("line", F.col("item_at") - F.row_number().over(_by("doc_id", "item_id", "shift").orderBy("item_at")))
    lines = row.groupBy("doc_id", "item_id", "shift", "line").agg(F.count("*").alias("run"), F.min("item_at").alias("first"), F.collect_list(F.when(F.col("literal"), F.col("item_at"))).alias("literal"))
    best = lines.groupBy("doc_id", "item_id", "shift").agg(F.sum("run").alias("n"), F.max("run").alias("run"))
    best = best.groupBy("doc_id", "item_id").agg(F.max(F.struct("n", -F.col("shift"), "run")).alias("b"), F.max("run").alias("run"))
    of_literal = F.when(F.col("literal"), F.col("item_at"))
    held = met.groupBy("doc_id", "item_id").agg(F.countDistinct("item_at").alias("matched"), F.countDistinct(of_literal).alias("met_literal"))
    sizes = places.groupBy("item_id").agg(F.count("*").alias("windows"), F.count(of_literal).alias("literals"))
    found = held.join(best, ["doc_id", "item_id"]).join(few(sizes), "item_id")
    found = found.select("doc_id", "item_id", "windows", "literals", "matched", _coverage("matched", "met_literal").alias("coverage"), "run", (-F.col("b.col2")).alias("shift"))
    found = stored(found.where(_enough("coverage", "run")), "template-candidates")
    slotted = items.where(F.exists("t", _is_slot))
    plain = found.join(items.where(~F.exists("t", _is_slot)).select("item_id"), "item_id", "left_semi")
    plain = plain.drop("literals").withColumns({"slots": F.lit(0), "changed": F.lit(0)})
    out = stored(plain.unionByName(_consistent(found.join(few(slotted), "item_id"), lines, texts).select(*plain.columns)), "template-found")
    out = out.unionByName(_edited(out, held, lines, sizes, items, texts).select(*plain.columns))
    # of an item's texts, the one that covers most
    columns = [c for c in plain.columns if c not in ("doc_id", "item_id")]
    out = out.join(few(owners), "item_id").groupBy("doc_id", "own").agg(F.max(F.struct("coverage", "run", "matched", *(c for c in columns if c not in ("coverage", "run", "matched")), "short")).alias("b"))
    return out.select("doc_id", F.col("own").alias("item_id"), *(f"b.{c}" for c in columns), "b.short")


def _coverage(matched: str, met_literal: str) -> Column:
    """The share of all windows, or of those with enough literal words: a copy with other values holds no others."""
    return F.greatest(F.col(matched) / F.col("windows"), F.when(F.col("literals") > 0, F.col(met_literal) / F.col("literals")))


def _enough(coverage: str, run: str) -> Column:
    return (F.col(coverage) >= COVERAGE) | (F.col(run) >= RUN)


def _agree(pairs: Column) -> Column:
    """Whether each form of the item stands for one of the document, and the other way round."""
    n = lambda *names: F.size(F.array_distinct(F.transform(pairs, lambda x: F.struct(*(x[k] for k in names)))))
    return (n("t", "item", "doc") == n("t", "item")) & (n("t", "item", "doc") == n("t", "doc"))


def _consistent(candidates: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidates that reach the coverage or the run with consistent slots alone.

    Slots are read where matched windows lie, at these windows' own shift. Shifts are taken from the one with most
    windows down, as long as their slots agree with those taken: among shifts near one another (words were put in
    or left out), and among all."""
    pair = ["doc_id", "item_id"]
    shifts = lines.join(few(stored(candidates.select(*pair), "template-slotted")), pair, "left_semi")
    shifts = shifts.groupBy(*pair, "shift").agg(F.sum("run").alias("n"), F.max("run").alias("run"), F.collect_list(F.struct("first", F.col("run").alias("size"), "literal")).alias("parts"))
    near = F.floor(F.col("shift") / NEAR).cast("long")
    shifts = shifts.withColumn("near", F.explode(F.array(near, near + 1, F.lit(None).cast("long"))))
    unit = F.struct((-F.col("n")).alias("less"), "shift", "n", "run", "parts")
    groups = shifts.groupBy(*pair, "near").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    groups = groups.join(candidates.select(*pair, "windows", "literals", "t", "s"), pair)
    groups = stored(groups, "template-slots")
    checked = texts.join(few(groups), "doc_id").withColumn("d", surface(F.col("text")))
    at = lambda u: F.flatten(F.transform(u.parts, lambda p: F.sequence(p["first"], p["first"] + p["size"] - 1)))
    slots = lambda u: F.transform(
        F.filter(F.array_distinct(F.flatten(F.transform(u.parts, lambda p: F.sequence(p["first"], p["first"] + p["size"] + WINDOW - 2)))), lambda i: (i < F.size("t")) & _is_slot(F.get("t", i.cast("int")))),
        lambda i: F.struct(i.alias("at"), F.get("t", i.cast("int")).alias("t"), F.get("s", i.cast("int")).alias("item"), F.get("d", (u.shift + i).cast("int")).alias("doc")),
    )
    units = F.transform("units", lambda u: F.struct(u.shift.alias("shift"), u.run.alias("run"), at(u).alias("at"), F.flatten(F.transform(u.parts, lambda p: p["literal"])).alias("literal"), slots(u).alias("slots")))
    checked = checked.withColumn("units", units)
    none = lambda name: F.filter(F.get("units", F.lit(0))[name], lambda x: F.lit(False))
    start = F.struct(F.lit(None).cast("long").alias("shift"), F.lit(0).cast("long").alias("run"), none("at").alias("at"), none("literal").alias("literal"), none("slots").alias("slots"))

    def take(got: Column, u: Column) -> Column:
        slots = F.array_union(got.slots, u.slots)
        more = F.struct(F.coalesce(got.shift, u.shift).alias("shift"), F.greatest(got.run, u.run).alias("run"), F.array_union(got["at"], u["at"]).alias("at"), F.array_union(got["literal"], u["literal"]).alias("literal"), slots.alias("slots"))
        return F.when(_agree(slots), more).otherwise(got)

    checked = checked.select(*pair, "windows", "literals", F.aggregate("units", start, take).alias("got"))
    checked = checked.select(*pair, "windows", "literals", F.size("got.at").cast("long").alias("matched"), F.size("got.literal").cast("long").alias("met_literal"), "got.run", "got.shift", "got.slots")
    checked = checked.withColumn("coverage", _coverage("matched", "met_literal")).where(_enough("coverage", "run"))
    checked = checked.withColumns({"changed": F.size(F.filter("slots", lambda x: x.item != x.doc)), "slots": F.size("slots")})
    names = ("matched", "windows", "coverage", "run", "shift", "slots", "changed")
    one = checked.groupBy(*pair).agg(F.max(F.struct("matched", (-F.col("shift")).alias("order"), *names[1:])).alias("b"))
    return one.select(*pair, *(f"b.{k}" for k in names))


def _edited(out: DataFrame, held: DataFrame, lines: DataFrame, sizes: DataFrame, items: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents that hold a whole item but for one replaced or missing word, or two replaced ones in a long item.

    One word breaks five windows at most, so shifts with all but these are compared token by token."""
    pair = ["doc_id", "item_id"]
    edits = F.when(F.col("windows") > 3 * WINDOW, 2).when(F.col("windows") > WINDOW, 1)
    shifts = lines.groupBy(*pair, "shift").agg(F.sum("run").alias("n"), F.max("run").alias("run"))
    before = F.lag(F.struct("shift", "n")).over(_by(*pair).orderBy("shift"))
    shifts = shifts.withColumn("before", before).join(few(sizes.withColumn("edits", edits).where("edits > 0")), "item_id")
    both = F.col("n") + F.when(F.col("before.shift") == F.col("shift") - 1, F.col("before.n")).otherwise(0)
    shifts = shifts.where((F.col("n") >= F.col("windows") - WINDOW * F.col("edits")) | (both >= F.col("windows") - WINDOW))
    shifts = shifts.join(few(out.select(*pair)), pair, "left_anti")
    tried = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("shift"), F.col("shift") + 1)))))
    tried = shifts.groupBy(*pair).agg(F.first("windows").alias("windows"), F.first("edits").alias("edits"), F.max("run").alias("run"), tried.alias("tried"))
    # words of literal windows as a template, others by their surface
    covered = F.transform("t", lambda x, i: F.exists(F.sequence(F.greatest(i - WINDOW + 1, F.lit(0)), F.least(i, F.size("t") - WINDOW)), lambda a: ~F.array_contains("heavy", a)))
    items = items.where(F.size("t") > WINDOW).withColumn("heavy", _heavy("t")).withColumn("covered", covered).drop("heavy")
    tried = stored(tried.join(held, pair).join(few(stored(items, "benchmark-covered")), "item_id"), "template-edited")
    texts = texts.join(few(tried), "doc_id").withColumns({"d": surface(F.col("text")), "dt": template(F.col("text"))})
    at = lambda tokens, i, s: F.when(s + i >= 0, F.get(tokens, F.greatest(s + i, F.lit(0)).cast("int")))
    other = lambda i, s: ~F.coalesce((F.get("s", i) == at("d", i, s)) | (F.get("covered", i) & (F.get("t", i) == at("dt", i, s))), F.lit(False))
    places = F.sequence(F.lit(0), F.size("t") - 1)
    differ = lambda s: F.filter(places, lambda i: other(i, s))
    texts = texts.withColumn("tried", F.transform("tried", lambda s: F.struct(s.alias("shift"), differ(s).alias("here"), differ(s - 1).alias("after"))))
    missing = lambda u: F.coalesce(F.array_max(u.after) <= F.array_min(u.here), F.lit(False))
    texts = texts.withColumn("tried", F.filter("tried", lambda u: (F.size(u.here) <= F.col("edits")) | missing(u)))

    def slots(u: Column) -> Column:
        gap = F.when(F.size(u.here) > F.col("edits"), F.array_min(u.here))  # after a missing word, the text is one token behind
        kept = F.filter(places, lambda i: _is_slot(F.get("t", i)) & F.when(gap.isNull(), ~F.array_contains(u.here, i)).otherwise(i != gap))
        return F.transform(kept, lambda i: F.struct(F.get("t", i).alias("t"), F.get("s", i).alias("item"), at("d", i, u.shift - F.when(i > gap, 1).otherwise(0)).alias("doc")))

    texts = texts.withColumn("tried", F.filter(F.transform("tried", lambda u: F.struct(u.shift.alias("shift"), slots(u).alias("slots"))), lambda u: _agree(u.slots)))
    texts = texts.where(F.size("tried") > 0).withColumn("u", F.get("tried", F.lit(0)))
    return texts.select(*pair, "windows", "matched", (F.col("matched") / F.col("windows")).alias("coverage"), "run", "u.shift",
                        F.size("u.slots").alias("slots"), F.size(F.filter("u.slots", lambda x: x.item != x.doc)).alias("changed"))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no item contaminates, with all their columns. An item of fewer tokens than a window
    only counts where it is a whole line of the document."""
    found = stored(contaminated(docs, benchmark, id_col, text_col).select("doc_id", "item_id", "short"), "contaminated")
    short = benchmark.select(F.col("item_id").cast("long").alias("item_id"), surface(F.col("text").cast("string")).alias("s")).where(F.size("s").between(1, WINDOW - 1))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.split(F.col(text_col).cast("string"), "[\\n\\r]+").alias("lines"))
    lines = lines.join(few(found.where("short").select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.explode(F.transform("lines", surface)).alias("s"))
    whole = found.where("short").join(few(stored(short, "benchmark-short")), "item_id").join(lines, ["doc_id", "s"], "left_semi")
    bad = found.where("NOT short").select("doc_id").unionByName(whole.select("doc_id")).distinct()
    return docs.join(few(stored(bad.select(F.col("doc_id").alias(id_col)), "contaminated-ids")), id_col, "left_anti").select(*docs.columns)


def sql() -> str:
    """contaminated() as DuckDB SQL, without the slots' columns."""
    rep = lambda c, steps: reduce(lambda x, s: f"regexp_replace({x}, '{s[0]}', '{s[1].replace('$', chr(92))}', 'g')", steps, c)
    marked = f"lower({rep('text', MARKS)})"
    split = lambda c: f"list_filter(string_split_regex({c}, '{BREAK}'), lambda x: x <> '')"
    slot = f"(x IN ('{NAME}', '{UNIT}') OR contains(x, '{NUMBER}'))"
    windows = f"unnest(range(0, greatest(len(t) - {WINDOW} + 1, 0))) AS i"
    return f"""
WITH items AS MATERIALIZED (SELECT item_id, {split(rep(marked, TEMPLATE))} AS t, {split(marked)} AS s FROM benchmark WHERE text IS NOT NULL),
docs AS MATERIALIZED (SELECT doc_id, {split(rep(marked, TEMPLATE))} AS t, {split(marked)} AS s FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, i, t[i + 1:i + {WINDOW}] AS w FROM (SELECT item_id, t, {windows} FROM items)
       WHERE len(list_filter(t[i + 1:i + {WINDOW}], lambda x: NOT {slot})) >= {LITERALS}),
dw AS (SELECT doc_id, i, t[i + 1:i + {WINDOW}] AS w FROM (SELECT doc_id, t, {windows} FROM docs)),
met AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, iw.i AS item_at, dw.i - iw.i AS shift FROM dw JOIN iw USING (w)),
stretches AS (SELECT doc_id, item_id, shift, line_no, count(*) AS run FROM (
  SELECT *, item_at - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_at) AS line_no FROM met) GROUP BY ALL),
shifts AS (SELECT doc_id, item_id, shift, sum(run) AS n, max(run) AS run FROM stretches GROUP BY ALL),
best AS (SELECT doc_id, item_id, max(run) AS run, arg_max(shift, n * 1000000000 - shift) AS shift FROM shifts GROUP BY ALL),
held AS (SELECT doc_id, item_id, count(DISTINCT item_at) AS matched FROM met GROUP BY ALL),
sizes AS (SELECT item_id, count(*) AS windows FROM iw GROUP BY ALL),
found AS (SELECT doc_id, item_id, windows, matched, matched / windows AS coverage, run, shift
  FROM held JOIN best USING (doc_id, item_id) JOIN sizes USING (item_id) WHERE matched / windows >= {COVERAGE} OR run >= {RUN}),
pairs AS (SELECT f.doc_id, f.item_id, list_filter(list_transform(range(1, len(items.t) + 1), lambda k:
    {{'t': items.t[k], 'item': items.s[k], 'doc': CASE WHEN f.shift + k >= 1 THEN docs.s[f.shift + k] END}}),
    lambda p: (p.t IN ('{NAME}', '{UNIT}') OR contains(p.t, '{NUMBER}')) AND p.doc IS NOT NULL) AS p
  FROM found f JOIN items USING (item_id) JOIN docs USING (doc_id))
SELECT doc_id, item_id, windows, matched, coverage, run, shift FROM found JOIN pairs USING (doc_id, item_id)
WHERE len(list_distinct(p)) = len(list_distinct(list_transform(p, lambda x: {{'t': x.t, 'item': x.item}})))
  AND len(list_distinct(p)) = len(list_distinct(list_transform(p, lambda x: {{'t': x.t, 'doc': x.doc}})))"""
