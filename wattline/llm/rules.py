"""Quality rules as a bitmask ledger, in SQL functions only.

``ledger`` measures every text once, evaluates every rule once, and stores one long of
failure bits beside the measurements. Versioned policies are masks over those bits:
applying another version, or asking what each rule alone removes, never reads a text
again (``apply_policy``, ``ablations``).

A repeated 3-word window is found by sorting the 64-bit hashes of a text's windows;
two different windows of one text share a hash with a chance of about n*n/2**65.

Defined cases: null text has no words and all measures 0; repeated rows get a row
each; texts are measured whole; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD_SPLIT, fresh_name, text_of

#: Fixed values of the contract: symbol characters and white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A named failure test; its bit is its place in RULES and never changes."""

    name: str
    fails: Callable[[], Column]


#: Append only: stored ledgers refer to rules by their place here.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("many_words", lambda: F.col("n_words") > 1_000_000),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 5 * F.col("n_lines")),
    Rule("shouting", lambda: 10 * F.col("n_exclamations") > 5 * F.col("n_words")),
    Rule("few_distinct_words", lambda: (F.col("n_words") >= 50) & (10 * F.col("n_distinct_words") < F.col("n_words"))),
)
BASE = ("few_words", "repeated_windows")
#: Version -> names of the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "short_words", "long_words", "symbols", "duplicate_lines", "shouting"),
    "v2": (*BASE, "many_words", "short_words", "long_words", "symbols", "duplicate_lines", "shouting", "few_distinct_words"),
}


def policy_mask(version: str) -> int:
    places = {rule.name: i for i, rule in enumerate(RULES)}
    return sum(1 << places[name] for name in POLICIES[version])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside one expression."""
    return F.transform(F.array(value), body)[0]


def _removed(text: Column, characters: str) -> Column:
    """How many of ``characters`` a text holds."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeated_places(hashes: Column) -> Column:
    """Places, ascending, of the windows whose hash occurs twice or more."""

    def by_sort(pairs: Column) -> Column:
        same = lambda x, j: ((j > 0) & (F.get(pairs, j - 1)["h"] == x["h"])) | F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, same), lambda x: x["i"]))

    def chosen(found: Column) -> Column:
        few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(found, h), i)), lambda i: i.isNotNull())
        many = _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), by_sort)
        return F.when(F.size(found) == 0, F.array().cast("array<int>")).when(F.size(found) <= 16, few).otherwise(many)

    repeated = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x)))
    return _let(_let(F.sort_array(hashes), repeated), chosen)


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` plus all measurements of every text."""
    whole, words, lines, hashes = (fresh_name(docs, stem) for stem in ("whole", "words", "lines", "hashes"))
    rows = docs.select(*keep, text_of(text).alias(whole))
    rows = rows.withColumn(words, F.filter(F.split(whole, WORD_SPLIT), lambda w: w != ""))
    rows = rows.withColumn(lines, F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0))
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    rows = rows.withColumn(hashes, F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)).otherwise(F.array().cast("array<bigint>")))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total"))
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        *keep,
        size(words).alias("n_words"),
        F.length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
        _removed(F.col(whole), SYMBOLS).alias("n_symbols"),
        (size(lines) - size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.aggregate(_repeated_places(F.col(hashes)), start, covered, lambda acc: acc["total"]).alias("n_repeat_words"),
        size(lines).alias("n_lines"),
        _removed(F.col(whole), "!").alias("n_exclamations"),
        size(F.array_distinct(words)).alias("n_distinct_words"),
    )


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Measurements and ``failed_bits``: bit i is set where RULES[i] fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, keep, text).withColumn("failed_bits", bits)


def apply_policy(ledger_rows: DataFrame, version: str, name: str = "kept") -> DataFrame:
    return ledger_rows.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0)


def ablations(ledger_rows: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows only it removes, rows kept without it."""
    mask = policy_mask(version)
    masked = ledger_rows.select(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    rules = [(i, r.name) for i, r in enumerate(RULES) if mask >> i & 1]
    per_rule = F.explode(F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(name).alias("rule")) for i, name in rules])).alias("x")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    hit = F.col("b").bitwiseAND(F.col("bit")) != 0
    others = F.col("b").bitwiseAND(F.bitwise_not(F.col("bit")))
    return (
        masked.select("b", "n", per_rule)
        .select("b", "n", "x.*")
        .groupBy("rule")
        .agg(count(hit).alias("failing"), count(F.col("b") == F.col("bit")).alias("only_this"), count(others == 0).alias("kept_without"))
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "v1")
    base_failed = F.col("failed_bits").bitwiseAND(F.lit(policy_mask("base")).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "failed_bits")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, r, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations, len(list_distinct(ws))::BIGINT AS n_distinct
      FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_words > 1000000)::BIGINT
       + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT + 32 * (10 * n_symbols > 3 * n_words)::BIGINT
       + 64 * (10 * n_dup_lines > 5 * n_lines)::BIGINT + 128 * (10 * n_exclamations > 5 * n_words)::BIGINT
       + 256 * (n_words >= 50 AND 10 * n_distinct < n_words)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       (failed_bits & 251) = 0 AS kept, failed_bits FROM b
"""
