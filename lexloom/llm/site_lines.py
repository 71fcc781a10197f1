"""op9: removal of lines that many sites share, with DataFrame functions alone.

Lines are hashed; a HyperLogLog sketch of the sources that hold a line is
built for each hash, partly before the shuffle, and merged by aggregation.
Lines whose estimate is near the threshold (a margin far beyond the sketch's
error) get an exact distinct count; the others are settled by the sketch.
The first copy of a removed line, by (doc_id, line number), stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

BLANKS = " \t\n\x0b\x0c\r"
MIN_SITES, MIN_CHARS, LOG_K, MARGIN = 10, 16, 12, 0.3
#: Bytes of a broadcast row, beside 8 for each of its line numbers.
ROW = 96


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_hash(line: Column, min_chars: int) -> Column:
    core = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(core) >= min_chars, F.xxhash64(core))


def shared_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, first_doc, first_at) of lines that at least min_sites sources hold; rows: doc_id, at, line, source."""
    sketched = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LOG_K))).alias("sites"), F.min(F.struct("doc_id", "at")).alias("first"))
    some = textkit.saved(sketched.where(F.col("sites") >= min_sites * (1 - MARGIN)).select("line", "sites", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at")))
    near = some.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line", "source").count().groupBy("line").count().where(F.col("count") >= min_sites).select("line")
    sure = some.where(F.col("sites") > min_sites * (1 + MARGIN))
    return sure.union(some.join(exact, "line", "left_semi")).drop("sites")


def without_shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows that have a doc_id, with `text` less the lines shared across sites, and n_lines, n_removed.

    Lines are what newlines separate; they are compared without the blanks
    around them, and those of fewer than min_chars characters never go. A null
    source counts as one site of its own. Null and empty texts have no lines
    and stay as they are. Rows that share a doc_id and text lose the same
    lines; an empty table gives no rows. Other columns are kept; columns named
    n_lines or n_removed are replaced.
    """
    docs = docs.where("doc_id is not null").drop("n_lines", "n_removed")
    key, numbers, own_id, own_text = F.xxhash64("text"), *(textkit.free_name(docs.columns, x) for x in ("line_numbers", "line_doc", "line_text"))
    # texts are cut into lines once; what follows reads hashes
    numbered = textkit.saved(docs.select("doc_id", key.alias("text_key"), F.coalesce("source", F.lit("")).alias("source"), F.posexplode(F.transform(F.split("text", "\n"), lambda x: line_hash(x, min_chars))).alias("at", "line")).where("line is not null"))
    shared = shared_lines(numbered.select("doc_id", "at", "line", "source"), min_sites)
    hits = numbered.select("doc_id", "text_key", "at", "line").join(shared, "line").where("doc_id <> first_doc or at <> first_at")
    gone = textkit.saved(hits.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias(numbers)))
    textkit.discard(numbered)
    size = gone.agg(F.sum(ROW + 8 * F.size(numbers).cast("long"))).first()[0] or 0
    gone = gone.withColumnsRenamed({"doc_id": own_id, "text_key": own_text})
    joined = docs.join(F.broadcast(gone) if size <= textkit.BROADCAST else gone, (docs["doc_id"] == gone[own_id]) & (key == gone[own_text]), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers))
    kept = let(lines, lambda x: F.array_join(F.transform(left, lambda k: F.get(x, k)), "\n"))
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long")
    new = {"n_lines": n_lines, "n_removed": F.coalesce(F.size(numbers), F.lit(0)).cast("long"), "text": F.when(F.col(numbers).isNull(), F.col("text")).otherwise(kept)}
    return joined.select(*[new["text"].alias("text") if c == "text" else F.col(c) for c in docs.columns], new["n_lines"].alias("n_lines"), new["n_removed"].alias("n_removed"))


def op9_site_spread_lines(spark, sf_dir: str) -> DataFrame:
    return without_shared_lines(textkit.documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


OP9_SQL = """
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as source from documents where doc_id is not null),
s as (select doc_id, source, string_split(t, chr(10)) as ls from d),
u as (select doc_id, source, unnest(ls) as l, generate_subscripts(ls, 1) as pos from s),
k as (select *, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as c from u),
b as (select c, count(distinct source) as sites, min(row(doc_id, pos)) as one from k where length(c) >= 16 group by c having count(distinct source) >= 10),
m as (select k.doc_id, k.pos, k.l, b.c is not null and row(k.doc_id, k.pos) <> b.one as gone from k left join b on k.c = b.c),
r as (select doc_id, count(*) as n, count(*) filter (gone) as g, coalesce(string_agg(l, chr(10) order by pos) filter (not gone), '') as kept from m group by doc_id)
select d.doc_id, case when d.t = '' then 0 else r.n end::bigint as n_lines, r.g::bigint as n_removed, length(r.kept)::bigint as kept_chars, md5(r.kept) as kept_md5 from d join r on d.doc_id = r.doc_id
"""
