"""URL filter: logistic regression on hashed character n-grams of host and path.

Rules (block or allow, for a host with its subdomains and a path prefix) go first; the
longest fitting rule decides. Other urls are judged by the regression. Training reads a
small labelled url table - the built-in one, or a CSV file given by path - on the driver,
at most ``max_rows`` of its distinct rows, picked by a hash; the weights become integers
(millionths), so every engine adds them up to the same score. Scoring is an SQL
expression over a constant weight array: no join, no shuffle, no Python.

Defined cases: a null url, or one without ``://``, has empty host and path; no rule
fits it and the regression judges the empty parts; a score right at the limit is allowed;
repeated rows are judged each and alike; other columns, whatever their names, are ignored;
null ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import csv
import hashlib
import json
import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_name
from .url_table import UNWANTED, WANTED

BUCKETS = 65_536  # four hexadecimal digits of an n-gram's md5
ORDERS = (3, 4)
#: A url is blocked if it is unwanted with more than this probability.
LEAST_CHANCE = 0.7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (rule, action); a rule is a host, a slash, and the rest of a path prefix.
RULES: tuple[tuple[str, str], ...] = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)

Labelled = list[tuple[str | None, int]]


def labelled_urls() -> Labelled:
    """The built-in training table: (url, 1 for unwanted)."""
    return [(url, label) for label, block in ((1, UNWANTED), (0, WANTED)) for url in block.split()]


def read_labelled(path: str) -> Labelled:
    """A labelled table of one's own: CSV with the columns url and label (1 for unwanted)."""
    with open(path, encoding="utf-8", newline="") as file:
        return [(row["url"] or None, int(row["label"])) for row in csv.DictReader(file)]


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    cut = min((rest[2].find(c) for c in "/?#" if c in rest[2]), default=len(rest[2]))
    path = rest[2][cut:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return rest[2][:cut].translate(str.maketrans(_UPPER, _LOWER)), path[:stop]


def ngrams(host: str, path: str) -> set[str]:
    found = set()
    for tag, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in ORDERS:
            found |= {f"{tag}{text[i : i + n]}" for i in range(len(text) - n + 1)}
    return found


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:4], 16)


def drawn(rows: Labelled, max_rows: int) -> Labelled:
    """Distinct rows, at most ``max_rows`` of them: those with the smallest hashes."""
    return sorted(set(rows), key=lambda row: hashlib.md5(f"{row[0]}|{row[1]}".encode()).digest())[:max_rows]


def fit(rows: Labelled, max_rows: int = 5_000, rounds: int = 300, step: float = 2.0, penalty: float = 0.003) -> tuple[list[int], int]:
    """Weights per bucket and the constant, in millionths, by full-batch ascent on a bounded sample.

    Both classes weigh the same. Without rows of both classes everything is allowed.
    """
    rows = drawn(rows, max_rows)
    labels = np.array([label for _, label in rows], float)
    if not 0 < labels.sum() < len(rows):
        return [0] * BUCKETS, 0
    features = [sorted({_bucket(g) for g in ngrams(*url_parts(url))}) for url, _ in rows]
    row, column = np.repeat(np.arange(len(rows)), list(map(len, features))), np.concatenate([np.array(f, np.int64) for f in features])
    share = np.where(labels == 1, len(rows) / (2 * labels.sum()), len(rows) / (2 * (len(rows) - labels.sum())))
    size = 1 / np.maximum(1, np.bincount(row, minlength=len(rows)))  # long urls move no more than short ones
    weights, constant = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        latent = constant + np.bincount(row, weights[column], minlength=len(rows))
        miss = share * (labels - 1 / (1 + np.exp(-np.clip(latent, -60, 60))))
        weights += step * (np.bincount(column, (miss * size)[row], minlength=BUCKETS) - penalty * weights)
        constant += 0.05 * miss.mean()
    return [round(1e6 * w) for w in weights.tolist()], round(1e6 * constant)


@lru_cache(maxsize=1)
def default_weights() -> tuple[list[int], int]:
    return fit(labelled_urls())


def _grams(tag: str, text: Column) -> list[Column]:
    """N-grams of ``text`` between its edge marks, one array per order."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def order(n: int) -> Column:
        cut: Callable[[Column], Column] = lambda i: F.concat(F.lit(tag), F.substring(marked, i, F.lit(n)))
        return F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), cut)).otherwise(F.array().cast("array<string>"))

    return [order(n) for n in ORDERS]


def block_above(chance: float = LEAST_CHANCE) -> int:
    """The score, in millionths, at which a url is unwanted with that probability."""
    return round(1e6 * math.log(chance / (1 - chance)))


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, weights: tuple[list[int], int] | None = None, keep: tuple[str, ...] = ("page_id",), url: str = "url", chance: float = LEAST_CHANCE
) -> DataFrame:
    """Columns ``keep`` plus host, path, rule, verdict and the regression's score.

    ``rules`` are constants of the plan: a list of policy size (thousands), not a table.
    """
    values, constant = weights or default_weights()
    rows = pages.select(
        *keep,
        F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER).alias("host"),
        F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit("")).alias("path"),
    )
    parsed = [{"rule": r, "host": r.partition("/")[0], "path": "/" + r.partition("/")[2], "action": a} for r, a in rules]
    listed = F.from_json(F.lit(json.dumps(parsed)), "array<struct<rule:string,host:string,path:string,action:string>>")
    fits = lambda r: ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))) & F.col("path").startswith(r["path"])
    longest = F.array_max(F.transform(F.filter(listed, fits), lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["action"].alias("action"))))
    table = F.from_json(F.lit(json.dumps(values)), "array<bigint>")
    # Buckets are told apart, not n-grams: two n-grams of one bucket weigh once, as in training.
    bucket = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 4), 16, 10).cast("int")
    buckets = F.array_distinct(F.transform(F.concat(*_grams("h", F.col("host")), *_grams("p", F.col("path"))), bucket))
    score = F.aggregate(buckets, F.lit(constant).cast("long"), lambda acc, b: acc + F.get(table, b))
    found = fresh_name(rows, "rule")
    rows = rows.withColumn(found, longest).withColumn("score", score)
    method = F.when(F.col("score") > block_above(chance), "block").otherwise("allow")
    return rows.select(*keep, "host", "path", F.col(f"{found}.rule").alias("rule"), F.coalesce(F.col(f"{found}.action"), method).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str, labelled: str | None = None) -> DataFrame:
    """``labelled``: path of a labelled url table; the built-in one without it."""
    weights = fit(read_labelled(labelled)) if labelled else default_weights()
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), weights=weights)


def op6_sql() -> str:
    values, constant = default_weights()
    grams = " || ".join(
        f"list_transform(range(1, greatest(1, length({c}) + 4 - {n})), lambda i: '{tag}' || substr('^' || {c} || '$', i, {n}))" for tag, c in (("h", "host"), ("p", "path")) for n in ORDERS
    )
    fits = ", ".join(
        f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN {{'n': {len(r)}, 'rule': '{r}', 'action': '{a}'}} END"
        for r, a in RULES
        for h, _, p in [r.partition("/")]
    )
    listed = ", ".join(f"({b}, {w})" for b, w in enumerate(values) if w)
    return f"""
WITH w(b, v) AS (VALUES {listed}),
u AS (SELECT row_number() OVER () AS k, page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
             coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages),
g AS (SELECT k, page_id, host, path, list_distinct(list_transform({grams}, lambda x: ('0x' || substr(md5(x), 1, 4))::INT)) AS buckets,
             list_max(list_filter([{fits}], lambda x: x IS NOT NULL)) AS r FROM u),
t AS (SELECT k, sum(v) AS v FROM (SELECT k, unnest(buckets) AS b FROM g) JOIN w USING (b) GROUP BY k),
s AS (SELECT g.*, ({constant} + coalesce(v, 0))::BIGINT AS score FROM g LEFT JOIN t USING (k))
SELECT page_id, host, path, r.rule AS rule, coalesce(r.action, CASE WHEN score > {block_above()} THEN 'block' ELSE 'allow' END) AS verdict, score FROM s
"""
