"""Corpus preparation: cleaning, section parsing, filling bodies by key, re-ordering of interleaved lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values ---
DROP_RATIO, DROP_COUNT = 0.08, 5
VOLUME, CHAPTER, FORMULA = map(T.wide, ("^#\\s+(\\S+編)\\s*$", "^##\\s+(.+?)(?:\\.pdf)?\\s*$", "^-\\s+`(.*)`\\s*$"))
SECTION = T.wide("^([0-9０-９]+(?:・[0-9０-９]+){2})\\s+(.+)$")
STOP = T.wide("^(第[0-9０-９]+章|[0-9０-９]+・[0-9０-９]+\\s+\\S|[0-9０-９]+(?:・[0-9０-９]+){2}\\s+\\S|天アキ|\\d+mm)")
BUFFER = 180


def derubble(body: Column) -> Column:
    """Sentences without mojibake stay; those with much of it go; the others are stripped and tidied."""
    found = lambda s: F.regexp_count(s, F.lit(T.GARBAGE))
    kept = F.filter(F.split(body, "(?<=。)"), lambda s: (s != "") & ~((found(s) >= DROP_COUNT) | (found(s) / F.greatest(F.lit(1), F.length(s)) > DROP_RATIO)))
    return F.array_join(F.transform(kept, lambda s: F.when(found(s) == 0, s).otherwise(T.tidy(T.strip_garbage(s)))), "")


def clean_file(text: Column) -> Column:
    """Headings and breadcrumbs lose characters only; other lines are de-rubbled; blank lines stay."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(T.has(x, "^\\s*[#>]"), T.strip_garbage(x)).when(T.strip(x) == "", x).otherwise(derubble(x)))
    return F.array_join(lines, "\n")


def title(text: Column) -> Column:
    return T.strip(F.regexp_extract(text, T.wide("(?m)^\\s*#\\s+(.+)\\s*$"), 1))


def front_matter(docs: DataFrame) -> DataFrame:
    """(doc_id, title_line, crumbs, body): the first heading, the breadcrumb lines, and the cleaned body lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    heads = F.transform(F.filter(lines, lambda x: T.has(x, "^\\s*#")), lambda x: T.sub(x, "\\s+$", ""))
    crumbs = F.transform(F.filter(lines, lambda x: T.has(x, "^\\s*>")), lambda x: T.sub(x, "\\s+$", ""))
    body = F.filter(F.transform(F.filter(lines, lambda x: ~T.has(x, "^\\s*[#>]")), T.clean_line), lambda x: x != "")
    return docs.select("doc_id", F.coalesce(F.get(heads, F.lit(0)), F.lit("")).alias("title_line"), crumbs.alias("crumbs"), body.alias("body"))


def parse_chapters(dumps: DataFrame) -> DataFrame:
    """(dump_id, chapter_no, title, volume, formulas, tables, prose, stats) of dumps (dump_id, text); empty chapters stay (see drop_empty).

    Lines are numbered in their dump; running counts of chapter headings assign
    lines to chapters, so dumps are parsed in parallel and lines in order.
    """
    lines = dumps.select("dump_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    volume, chapter = F.regexp_extract("line", VOLUME, 1), F.regexp_extract("line", CHAPTER, 1)
    is_volume = F.col("line").rlike(VOLUME)
    is_chapter = ~is_volume & F.col("line").rlike(CHAPTER) & ~F.col("line").startswith("###")
    order = Window.partitionBy("dump_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(
        "*", F.sum(is_chapter.cast("int")).over(order).alias("chapter_no"), F.coalesce(F.last(F.when(is_volume, volume), ignorenulls=True).over(order), F.lit("")).alias("volume"), is_chapter.alias("is_chapter"), is_volume.alias("is_volume"), F.trim(chapter).alias("name")
    ).where("chapter_no > 0")
    raw = F.regexp_extract("line", FORMULA, 1)
    clean = T.clean_inline(F.when(F.col("line").rlike(FORMULA), raw).otherwise(F.col("line")))
    kind = (
        F.when(F.col("is_volume"), None).when(F.col("is_chapter"), "head").when(F.col("line").rlike(FORMULA), "formula").when(T.has(F.col("line"), "^\\s*\\|"), "table").when((T.strip(F.col("line")) != "") & (T.strip(F.col("line")) != "---"), "prose")
    )
    rows = marked.select("dump_id", "chapter_no", "pos", "volume", "name", kind.alias("kind"), clean.alias("clean"), raw.alias("raw")).where("kind is not null")
    signal = T.formula_signal(F.col("clean"))

    def listed(when: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(when & (F.col("clean") != ""), F.struct("pos", "clean")))), lambda x: x["clean"])

    formula = F.col("kind") == "formula"
    return rows.groupBy("dump_id", "chapter_no").agg(
        F.max(F.when(F.col("kind") == "head", F.col("name"))).alias("title"), F.max(F.when(F.col("kind") == "head", F.col("volume"))).alias("volume"), listed(formula & signal).alias("formulas"), listed(F.col("kind") == "table").alias("tables"), listed(F.col("kind") == "prose").alias("prose"),
        F.struct(F.sum(formula.cast("long")).alias("formulas_in"), F.sum((formula & signal).cast("long")).alias("formulas_kept"), F.sum((formula & (F.col("clean") != F.col("raw"))).cast("long")).alias("cleaned")).alias("stats"),
    )


def drop_empty(chapters: DataFrame) -> DataFrame:
    return chapters.where("size(formulas) > 0 or size(tables) > 0 or size(prose) > 0")


def corpus_metrics(chapters: DataFrame) -> DataFrame:
    return chapters.agg(F.sum("stats.formulas_in").alias("formulas_in"), F.sum("stats.formulas_kept").alias("formulas_kept"), F.sum("stats.cleaned").alias("cleaned"), F.count("*").alias("chapters"))


def render_chapter() -> Column:
    """Markdown of a chapter; sections only where there is something in them."""
    part = lambda when, *lines: F.when(when, F.concat(*lines)).otherwise(F.lit(""))
    body = F.concat(
        F.lit("# "), F.col("title"), F.lit("\n\n> **編**: "), F.when(F.coalesce("volume", F.lit("")) == "", "—").otherwise(F.col("volume")), F.lit("\n\n"),
        part(F.size("prose") > 0, F.array_join("prose", "\n"), F.lit("\n\n")),
        part(F.size("formulas") > 0, F.lit("## 計算式\n\n"), F.array_join(F.transform("formulas", lambda f: F.concat(F.lit("- `"), f, F.lit("`"))), "\n"), F.lit("\n\n")),
        part(F.size("tables") > 0, F.lit("## 表\n\n"), F.array_join("tables", "\n"), F.lit("\n\n")),
    )
    return F.concat(T.sub(body, "\\s+$", ""), F.lit("\n"))


def text_sections(files: DataFrame) -> DataFrame:
    """(file_id, pos, key, body): from each three-part heading to the next line that stops a section; files: file_id, text."""
    lines = files.select("file_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = T.strip(F.col("line"))
    order = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select("*", bare.rlike(SECTION).alias("head"), bare.rlike(STOP).alias("stop")).withColumn("part", F.sum(F.col("stop").cast("int")).over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("stop"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return marked.groupBy("file_id", "part").agg(F.max(F.when(F.col("head"), F.struct("pos", T.strip(F.col("line")).alias("line")))).alias("h"), body.alias("body")).where("h is not null").select("file_id", F.col("h.pos").alias("pos"), T.heading_key(F.col("h.line")).alias("key"), "body")


def fill_by_unique_key(docs: DataFrame, sections: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, body, filled, longer): bodies replaced by the section of the same key, if that key is unique and its clean text long enough.

    docs: doc_id, key, body; sections: key, body. A text that holds mojibake after cleaning is refused.
    """
    unique = sections.groupBy("key").agg(F.count("*").alias("m"), F.first("body").alias("raw")).where("m = 1").select("key", T.fill_clean(F.col("raw")).alias("source"))
    good = unique.where((F.length("source") >= least) & ~F.col("source").rlike(T.GARBAGE_WITH_REPLACEMENT))
    out = docs.join(good, "key", "left")
    return out.select("doc_id", F.coalesce("source", "body").alias("body"), F.col("source").isNotNull().alias("filled"), F.coalesce(F.length("source") > F.length("body") * 1.15, F.lit(False)).alias("longer"))


def emit_sentences(lines: Column) -> Column:
    """Sentences of body lines: mathematics is skipped, blanks and headings end a sentence, what has no end by 180 characters is dropped."""
    last = f"^([\\s\\S]*[{T.ENDERS}])([\\s\\S]*)$"

    def step(acc: Column, line: Column) -> Column:
        buffer = F.concat(acc["buf"], line)
        done, rest = F.regexp_extract(buffer, last, 1), F.regexp_extract(buffer, last, 2)
        made = F.filter(F.transform(T.clean_sentences(done), T.sanitize), lambda s: s != "")
        grown = F.when(done != "", F.struct(F.concat(acc["out"], made).alias("out"), rest.alias("buf"))).otherwise(F.struct(acc["out"].alias("out"), F.when(F.length(buffer) > BUFFER, "").otherwise(buffer).alias("buf")))
        cleared = F.struct(acc["out"].alias("out"), F.lit("").alias("buf"))
        return F.when(T.math_line(line), acc).when((line == "") | T.heading_line(line), cleared).otherwise(grown)

    return F.aggregate(lines, F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf")), step, lambda acc: acc["out"])


def deinterleaved(lines: Column) -> Column:
    return F.concat(F.filter(lines, lambda x, i: i % 2 == 0), F.filter(lines, lambda x, i: i % 2 == 1))


def clean_yield(sentences: Column) -> Column:
    return F.size(F.filter(sentences, lambda s: (F.length(s) >= 18) & ~T.junk_sentence(s)))


def bigram_model(seeds: DataFrame) -> DataFrame:
    """(a, b, logp) of the character bigrams of seed texts."""
    chars = seeds.select(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "").alias("c")).where("size(c) > 1")
    pairs = chars.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(F.get("c", i).alias("a"), F.get("c", i + 1).alias("b")))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    firsts = pairs.groupBy("a").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return pairs.join(firsts, "a").select("a", "b", F.log((F.col("n") + 0.5) / (F.col("total") + 0.5 * (F.col("kinds") + 1))).alias("logp"))


def fluency(texts: DataFrame, model: DataFrame, unseen: float = -12.0) -> DataFrame:
    """(text_id, fluency): mean log-probability of a text's character bigrams; texts: text_id, text."""
    chars = texts.select("text_id", F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "").alias("c")).where("size(c) > 1")
    pairs = chars.select("text_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(F.get("c", i).alias("a"), F.get("c", i + 1).alias("b")))).alias("p")).select("text_id", "p.a", "p.b")
    scored = pairs.join(model, ["a", "b"], "left").groupBy("text_id").agg(F.round(F.avg(F.coalesce("logp", F.lit(unseen))), 9).alias("fluency"))
    return texts.select("text_id").join(scored, "text_id", "left").select("text_id", F.coalesce("fluency", F.lit(unseen)).alias("fluency"))


def choose_order(rows: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(doc_id, sentences, deinterleaved, ya, yb): the line order that yields more clean, more fluent sentences; rows: doc_id, body (lines)."""
    a, b = emit_sentences(F.col("body")), emit_sentences(deinterleaved(F.col("body")))
    once = lambda *columns: F.explode(F.array(F.struct(*columns))).alias("x")  # noqa: E731  filters on what follows are not pushed below it, where they would make the sentences again
    both = rows.select("doc_id", F.size("body").alias("n"), once(a.alias("a"), b.alias("b"))).select("doc_id", "n", "x.*")
    both = both.select("*", once(clean_yield(F.col("a")).alias("ya"), clean_yield(F.col("b")).alias("yb"))).select("doc_id", "n", "a", "b", "x.*")
    if model is not None:
        named = lambda side: both.select(F.concat(F.col("doc_id").cast("string"), F.lit(side)).alias("text_id"), F.array_join(side, "").alias("text"))
        scores = fluency(named("a").union(named("b")), model)
        for side in "ab":
            mine = scores.where(F.col("text_id").endswith(side)).select(F.expr("substring(text_id, 1, length(text_id) - 1)").cast("long").alias("doc_id"), F.col("fluency").alias(f"f{side}"))
            both = both.join(mine, "doc_id", "left")
    else:
        both = both.withColumn("fa", F.lit(0.0)).withColumn("fb", F.lit(0.0))
    second = (
        F.when((F.col("n") < 6) | (F.col("yb") == 0), False).when(F.col("ya") == 0, True).when(F.col("yb") > F.col("ya") * 1.2, True)
        .when((F.col("fb") > F.col("fa")) & (F.col("yb") >= F.col("ya") * 0.7), True).when((F.col("fa") > F.col("fb")) & (F.col("ya") >= F.col("yb") * 0.7), False).otherwise(F.col("yb") > F.col("ya"))
    )
    return both.select("doc_id", F.when(second, F.col("b")).otherwise(F.col("a")).alias("sentences"), second.alias("deinterleaved"), "ya", "yb")


def rewrites(chosen: DataFrame) -> DataFrame:
    """Only documents put into another order, with two sentences at least, are rewritten."""
    return chosen.where("deinterleaved and size(sentences) >= 2")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(changed, removed_chars) between two versions (doc_id, text)."""
    both = before.select("doc_id", F.col("text").alias("x")).join(after.select("doc_id", F.col("text").alias("y")), "doc_id")
    return both.agg(F.sum((~F.col("x").eqNullSafe(F.col("y"))).cast("long")).alias("changed"), F.sum(F.length(F.coalesce("x", F.lit(""))) - F.length(F.coalesce("y", F.lit("")))).alias("removed_chars"))
