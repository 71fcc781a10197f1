"""op5: quality rules as a ledger of bitmasks, with DataFrame functions alone.

Every rule is evaluated once for a text, from measurements that are kept
beside the mask of the rules it failed. A policy is a version and the mask of
the rules that it enforces, so another policy, or a policy without one of its
rules, is a bitwise operation on the ledger and never a new pass over texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bit k is set for a text that fails the k-th rule; all in whole numbers.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > word_chars"),
    ("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("marks", "20 * n_marks > word_chars"),
    ("word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
POLICIES = {1: BASE, 2: BASE | BIT["symbols"] | BIT["capitals"] | BIT["marks"], 3: (1 << len(RULES)) - 1}
CURRENT = 3
#: With so many repeated windows at most, membership is tested against a list; with more, by neighbours in sorted order. Both are exact and give the same; the list is cheaper for the many texts with few repeats.
FEW = 8


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for a row, even if body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_window_words(parts: Column, n: int = 3) -> Column:
    """Words inside windows of n words that the text holds twice or more."""

    def covered(places: Column) -> Column:
        steps = F.aggregate(F.sequence(F.lit(1), F.size(places) - 1), F.lit(n), lambda total, k: total + F.least(F.lit(n), F.get(places, k) - F.get(places, k - 1)))
        return F.when(F.size(places) == 0, 0).when(F.size(places) == 1, n).otherwise(steps)

    def by_list(grams: Column, again: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda k: F.array_contains(again, F.get(grams, k)))

    def by_order(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, k: F.struct(g.alias("g"), k.alias("k"))))

        def beside(s: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: ((j > 0) & (F.get(s, j)["g"] == F.get(s, j - 1)["g"])) | F.coalesce(F.get(s, j)["g"] == F.get(s, j + 1)["g"], F.lit(False)))
            return F.sort_array(F.transform(at, lambda j: F.get(s, j)["k"]))

        return let(pairs, beside)

    def places(grams: Column) -> Column:
        again = let(F.sort_array(grams), lambda s: F.array_distinct(F.filter(s, lambda g, k: (k > 0) & (g == F.get(s, k - 1)))))
        return let(again, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).when(F.size(a) <= FEW, by_list(grams, a)).otherwise(by_order(grams)))

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))

    found = let(parts, lambda w: F.when(F.size(w) <= n, F.lit(0)).otherwise(let(grams(w), lambda g: let(places(g), covered))))
    return found.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failures`, the mask of failed rules.

    One row for each row with a doc_id; rows without one are left out,
    repeated rows give one row each. Null and empty texts measure 0
    throughout and fail few_words alone. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    w = words(F.col("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = docs.where("doc_id is not null").select("doc_id", text.alias("text"))
    measured = rows.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        count_chars(F.col("text"), SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        repeated_window_words(w).alias("n_repeat_words"),
        count_chars(F.col("text"), CAPITALS).alias("n_capitals"),
        count_chars(F.col("text"), "!?").alias("n_marks"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").alias("n_lines"), "n_capitals", "n_marks")
    bits = " | ".join(f"case when {rule} then {1 << k}L else 0L end" for k, (_, rule) in enumerate(RULES))
    return measured.withColumn("failures", F.expr(bits))


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """A ledger with base_failed and the verdict of a policy."""
    return rows.withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("failures").bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0)


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: texts that fail it, that fail nothing else of the policy, and that the policy without it keeps."""
    mask = POLICIES[version]
    within = F.col("failures").bitwiseAND(F.lit(mask))
    aggregates = []
    for name, bit in BIT.items():
        if mask & bit:
            aggregates.append(F.struct(F.lit(name).alias("rule"), F.sum((within.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias("failed"), F.sum((within == bit).cast("long")).alias("failed_alone"), F.sum((within.bitwiseAND(F.lit(~bit)) == 0).cast("long")).alias("kept_without")))
    return rows.agg(F.array(*aggregates).alias("rules")).select(F.inline("rules"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def kept_ledger(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The ledger, written and read again: the one pass over texts that all policies and ablations share."""
    return textkit.saved(ledger(docs), path)


def op5_rule_ledger(spark, sf_dir: str) -> DataFrame:
    """The current policy's verdicts from the stored ledger, and for each earlier version whether it keeps the text."""
    rows = kept_ledger(textkit.documents(spark, sf_dir))
    older = [(F.col("failures").bitwiseAND(F.lit(mask | BASE)) == 0).alias(f"kept_v{version}") for version, mask in POLICIES.items() if version != CURRENT]
    return apply_policy(rows).select("doc_id", *MEASURES[:5], "base_failed", "kept", "failures", *MEASURES[5:], *older)


OP5_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents where doc_id is not null),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from d),
u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
g as (select doc_id, i, x, lead(x) over p as y, lead(x, 2) over p as z from u window p as (partition by doc_id order by i)),
f as (select doc_id, i, z is not null and count(*) over (partition by doc_id, x, y, z) > 1 as hit from g),
c as (select doc_id, i, max(hit::int) over (partition by doc_id order by i rows between 2 preceding and current row) as covered from f),
r as (select doc_id, sum(covered)::bigint as n from c group by doc_id),
m as (
  select w.doc_id, len(w)::bigint as n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(r.n, 0)::bigint as n_repeat_words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls,
    (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::bigint as n_capitals, (length(t) - length(translate(t, '!?', '')))::bigint as n_marks
  from w left join r on w.doc_id = r.doc_id),
n as (select *, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines from m),
b as (select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (10 * n_symbols > word_chars)::bigint + 8 * (10 * n_dup_lines > 5 * n_lines)::bigint
    + 16 * (2 * n_capitals > word_chars)::bigint + 32 * (20 * n_marks > word_chars)::bigint + 64 * (word_chars > 20 * n_words or word_chars < 2 * n_words)::bigint as failures from n)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 as base_failed, failures = 0 as kept, failures, n_lines, n_capitals, n_marks,
  (failures & 3) = 0 as kept_v1, (failures & 55) = 0 as kept_v2 from b
"""
