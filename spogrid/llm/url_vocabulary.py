"""URL filter: domain and path rules first, then a weighted vocabulary.

Every url is lower-cased (A-Z) and read once by an Aho-Corasick automaton of
strict and soft terms. A hit counts where neither the character before nor the
one after is one of a-z and 0-9, so "win" is not found in "window". A url is
blocked on one strict hit, or when the weights of its distinct soft terms
reach the limit.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule, and its whole text (null: empty) is judged by the vocabulary;
equal rows are judged alike; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.llm.shared import bounded_batches

# Rules: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Terms that block a url by themselves.
STRICT = ("casino", "cialis", "malware", "phishing", "porn", "viagra", "warez", "xxx")
# Terms that count together, with their weights.
SOFT = {
    "adult": 1, "bet": 1, "bonus": 1, "cheap": 1, "click": 1, "deal": 1, "farm": 1, "free": 1, "loan": 1,
    "pill": 1, "pills": 1, "poker": 1, "promo": 1, "spam": 1, "win": 1,
}
SOFT_LIMIT = 2


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return _lower(host), slash + path


def _lower(text: str) -> str:
    return text.encode().lower().decode()


def find_rule(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(r + p, v) for v, r, p in rules if (host == r or host.endswith("." + r)) and path.startswith(p)]
    return max(fits, key=lambda x: (len(x[0]), x[0]), default=None)


class Vocabulary:
    def __init__(self, strict: Sequence[str], soft: Mapping[str, float], limit: float):
        import ahocorasick

        self.limit = limit
        self.automaton = ahocorasick.Automaton()
        for term, weight in [*((t, w) for t, w in soft.items()), *((t, None) for t in strict)]:
            self.automaton.add_word(term, (term, weight))
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[list[str], list[str], float]:
        """Distinct strict and soft terms, and the weight of the soft ones."""
        text = _lower(url)
        strict, soft = set(), {}
        inside = lambda k: 0 <= k < len(text) and text[k] in "abcdefghijklmnopqrstuvwxyz0123456789"
        for end, (term, weight) in self.automaton.iter(text) if len(self.automaton) else ():
            if inside(end + 1) or inside(end - len(term)):
                continue
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
        return sorted(strict), sorted(soft), float(sum(soft.values()))


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, limit: float = SOFT_LIMIT, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_terms, soft_terms, soft_weight) for every row."""
    soft = dict(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(strict, soft, limit)
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                found = find_rule(host, path, rules)
                bad, doubtful, weight = words.hits(url or "")
                verdict = found[1] if found else "block" if bad or weight >= limit else "allow"
                out.append((host, path, found[0] if found else None, verdict, bad, doubtful, weight))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
            yield pa.record_batch(
                [batch.column("page_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "soft_weight"],
            )

    bounded_batches(pages)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, "
        "strict_terms array<string>, soft_terms array<string>, soft_weight double"
    )


def sql(rules=RULES, strict=STRICT, soft=SOFT, limit: float = SOFT_LIMIT) -> str:
    """The same judgement as DuckDB SQL over ``pages``, without the lists of terms."""
    at = "(^|[^a-z0-9])({})([^a-z0-9]|$)"
    fits = [
        f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}"
        for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    by_rule = lambda of: "CASE " + " ".join(
        "WHEN " + f.format(f"'{of(r)}'") for f, r in zip(fits, sorted(rules, key=lambda r: -len(r[1] + r[2])), strict=True)
    )
    total = " + ".join(f"CASE WHEN regexp_matches(low, '{at.format(t)}') THEN {w} ELSE 0 END" for t, w in soft.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
j AS (SELECT *, {total} AS soft_weight,
        regexp_matches(low, '{at.format("|".join(strict))}') AS bad FROM p)
SELECT page_id, host, path, {by_rule(lambda r: r[1] + r[2])} END AS rule,
       {by_rule(lambda r: r[0])} WHEN bad OR soft_weight >= {limit} THEN 'block' ELSE 'allow' END AS verdict
FROM j"""
