"""Text functions as Column expressions: tokenisers, hashes, splitters, cleaners, predicates.

All stay inside the JVM. Patterns hold for Java's regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character classes and word lists that results depend on ---
CJK = "[\u3040-\u30ff\u4e00-\u9fff\uff66-\uff9f]"
CJK_SET = "\u3040-\u30ff\u4e00-\u9fff\uff66-\uff9f"
CLOSE, OPEN = "）)」』】〕｝", "（(「『【〔｛"
ENDERS = "。．！？!?"
PUA, HANGUL, YIJING = "\ue000-\uf8ff", "\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f\ua960-\ua97f\ud7b0-\ud7ff", "\u4dc0-\u4dff"
GARBAGE = f"[{PUA}{HANGUL}{YIJING}]"
GARBAGE_WITH_REPLACEMENT = f"[{PUA}{HANGUL}{YIJING}\ufffd]"
GENERIC_WORDS = (
    "基礎 基本 分類 概要 定義 特徴 種類 方法 手法 仕組 構成 構造 応用 利用 評価 設計 解析 技術 装置 システム "
    "モデル 理論 原理 管理 問題 影響 関係 性質 目的 効果 対策 動向 歴史 意義 概念 機能 役割 課題 現状 動作"
).split()
CAPTION = "^\\s*(?:表|図|式|付表|付図|第\\s*[0-9０-９]+\\s*[章節項表図])"
JAPANESE = "[\u4e00-\u9fffぁ-ヶ゠-ヿ]"
KANJI_KANA = "[\u4e00-\u9fffぁ-ヿ]"
#: What counts as a blank: JavaScript's white space, ideographic and no-break blanks included. The inside of a character class, for Java and RE2.
BLANKS = "\\s\\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# --- end of fixed values ---


def wide(pattern: str) -> str:
    """A pattern whose \\s and \\S mean all of BLANKS; Java's and RE2's own are ASCII blanks alone."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == "\\s":
            out.append(BLANKS if inside else f"[{BLANKS}]")
        elif two == "\\S" and not inside:
            out.append(f"[^{BLANKS}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            k -= 1
        k += 2
    return "".join(out)


def sub(text: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(text, wide(pattern), new)


def has(text: Column, pattern: str) -> Column:
    return text.rlike(wide(pattern))


def strip(text: Column) -> Column:
    return sub(text, "^\\s+|\\s+$", "")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(wide(pattern)), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(wide(pattern)))


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once for a row, even where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- tokenisers ---


def terms(text: Column) -> Column:
    """Lower-case Latin words of two characters or more, then bigrams of the text's CJK characters (others skipped)."""
    latin = _all(F.lower(text), "[a-z][a-z0-9\\-]{1,}")
    pairs = bind(_all(text, CJK), lambda c: F.when(F.size(c) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat(F.get(c, i), F.get(c, i + 1)))))
    return F.concat(latin, pairs)


def embedding_tokens(text: Column) -> Column:
    return _all(text, f"[A-Za-z]+|[0-9]+|{CJK}|[^\\sA-Za-z0-9{CJK_SET}]")


def lm_tokens(text: Column) -> Column:
    return _all(text, "[A-Za-z0-9']+|[\u3040-\u30ff\u4e00-\u9fff]|[、。，．！？!?…・]|\\n")


def detokenize(tokens: Column) -> Column:
    """Blanks between two Latin tokens only; line breaks stay; trimmed."""
    latin = "^[A-Za-z0-9']+$"
    out = F.aggregate(
        tokens,
        F.struct(F.lit("").alias("text"), F.lit(False).alias("latin")),
        lambda acc, t: F.struct(F.concat(acc["text"], F.when(acc["latin"] & has(t, latin), F.lit(" ")).otherwise(F.lit("")), t).alias("text"), has(t, latin).alias("latin")),
        lambda acc: acc["text"],
    )
    return sub(out, "^\\s+|\\s+$", "")


def space_tokens(text: Column) -> Column:
    return _all(text, "\\s+|\\S+")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as a non-negative long."""
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295))
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    # a character beyond the basic plane has two units
    both = lambda h, c: step(step(h, F.lit(55232) + F.shiftright(c, 10)), F.lit(56320) + c.bitwiseAND(F.lit(1023)))
    return F.aggregate(points, F.lit(2166136261).cast("bigint"), lambda h, c: F.when(c < 65536, step(h, c)).otherwise(both(h, c)))


def token_ids(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("text"), F.pmod(fnv1a(F.lower(t)), F.lit(50000)).cast("int").alias("id")))


# --- sentences ---


def _split_sentences(text: Column) -> Column:
    flat = F.trim(sub(text, "\\s+", " "))
    return F.transform(F.split(flat, f"(?<=[{ENDERS}])|(?<=\\.)(?=\\s|$)"), lambda x: F.trim(x))


def sentences(text: Column) -> Column:
    return F.filter(_split_sentences(text), lambda s: F.length(s) > 0)


def clean_sentences(text: Column) -> Column:
    return F.filter(_split_sentences(text), lambda s: F.length(sub(s, "[\\s、,]", "")) >= 8)


def feedback_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, f"(?<=[{ENDERS}])"), lambda s: sub(s, "^\\s+|\\s+$", "")), lambda s: F.length(s) >= 6)


def key_terms(text: Column) -> Column:
    runs = _all(F.coalesce(text, F.lit("")), "[\u4e00-\u9fff]{2,}|[ァ-ヶー]{2,}|[A-Za-z][A-Za-z0-9\\-]+")
    return F.array_distinct(F.filter(runs, lambda r: ~r.isin(GENERIC_WORDS)))


def signature(text: Column) -> Column:
    return bind(key_terms(text), lambda k: F.lower(F.when(F.size(k) > 0, F.array_join(F.array_sort(k), "|")).otherwise(sub(F.coalesce(text, F.lit("")), "\\s+", ""))))


# --- cleaners ---


def strip_garbage(text: Column, replacement_too: bool = False) -> Column:
    return sub(text, GARBAGE_WITH_REPLACEMENT if replacement_too else GARBAGE, "")


def clean_inline(text: Column) -> Column:
    """Strip mojibake and citation markers, collapse blanks, trim."""
    marks = sub(strip_garbage(text, True), "[⁻₋][⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]+[·・]", "")
    return sub(sub(marks, "[ \\t]{2,}", " "), "^\\s+|\\s+$", "")


def formula_signal(text: Column) -> Column:
    # fixed values: the glyphs that tell a formula
    greek = has(text, "[α-ωΑ-Ω∀-⋿]") | has(text, "[\\x{1d400}-\\x{1d7ff}]")
    sign = has(text, "[=<>≤≥≈≅≡∝∫∮∑∏√∂∇±×÷→←↔∈]")
    return F.when(text == "", False).when(greek | sign, True).when(has(text, "^[A-Za-z]+[)\\].,]*$"), False).otherwise(has(text, "[A-Za-z]"))


def restore_punctuation(text: Column) -> Column:
    stop = sub(text, f"(?<=[{CJK_SET}{CLOSE}])\\.", "。")
    comma = sub(stop, f"(?<=[{CJK_SET}{CLOSE}]),", "、")
    return sub(comma, f",(?=[{CJK_SET}{OPEN}])", "、")


def restore_punctuation_before_gap(text: Column) -> Column:
    # fixed values: the characters that Japanese punctuation follows
    before = "(?<=[ぁ-んァ-ヶ\u4e00-\u9fff々ー）)」』])"
    stop = sub(text, f"(?m){before}\\.(?=$|[^0-9A-Za-z])", "。")
    return sub(stop, f"(?m){before},(?=$|[^0-9A-Za-z])", "、")


def fill_clean(text: Column) -> Column:
    out = restore_punctuation_before_gap(sub(text, "[\ue000-\uf8ff\uac00-\ud7a3\u1100-\u11ff\ufffd]", ""))
    for pattern, new in (  # fixed values: the patterns and their order
        ("[（(]\\s*[)）]", ""), ("「\\s*」|『\\s*』", ""), ("[ \\t　]{2,}", " "), ("，{2,}", "，"), ("、{2,}", "、"), ("。{2,}", "。"), ("．{2,}", "．"),
        ("\\s+([，。、．）)」』])", "$1"), ("(?m)[ \\t]+$", ""), ("^\\s+|\\s+$", ""),
    ):
        out = sub(out, pattern, new)
    return out


def tidy(text: Column) -> Column:
    return sub(sub(sub(text, "[、，][、，]+", "、"), ",{2,}", ","), "^[、，。\\s]+", "")


def clean_line(line: Column) -> Column:
    out = line
    for pattern in ("^[ \\t]*#{1,6}[ \\t]+", "^[ \\t]*>[ \\t]?", "[*_`]+", "^\\s+|\\s+$"):
        out = sub(out, pattern, "")
    return out


def sanitize(sentence: Column) -> Column:
    """Nine ordered removals: citations, figure and equation references, list marks, leading punctuation, blanks."""
    out = F.coalesce(sentence, F.lit(""))
    for pattern, new in (  # fixed values: the patterns and their order
        ("^[A-Za-z][^。．！？]*?[（(]\\s*(?:19|20)\\d{2}\\s*[)）][^。．！？]*?[.．](?=\\s*[\u4e00-\u9fffぁ-ヿ])", ""),
        ("[（(]\\s*(?:19|20)\\d{2}\\s*[)）]\\s*,?\\s*\\d*\\.?", ""),
        ("[（(]\\s*(?:図|表|式)[^）)]*[）)]", ""),
        ("式\\s*\\([^)]*\\)", ""),
        ("[（(]\\s*[ⅰ-ⅹⅠ-Ⅹ]+\\s*[）)]", ""),
        ("[（(]\\s*[0-9０-９]{1,2}\\s*[）)]", ""),
        ("β\\s*\\d+\\s*[－-]\\s*\\d+|β\\s*\\d+\\s*編|[\u4e00-\u9fff]\\d+\\s*編", ""),
        ("^[\\s.．。・･,，、:：;；)\\]】」』>＞〕）]+", ""),
        ("[ \\t　]{2,}", " "),
        ("\\s+([、。，．）)」』])", "$1"),
        ("^\\s+|\\s+$", ""),
    ):
        out = sub(out, pattern, new)
    return out


def normalize_title(title: Column) -> Column:
    out = F.coalesce(title, F.lit(""))
    for pattern in ("^[\\d０-９]+([・.·][\\d０-９]+)*\\s*", "[（(][^）)]*[）)]", "\\s+"):
        out = sub(out, pattern, "")
    return out


def heading_key(line: Column) -> Column:
    return sub(sub(line, "^#\\s*", ""), "\\s+", "")


# --- predicates ---


def japanese_ratio(text: Column) -> Column:
    return _count(text, JAPANESE) / F.greatest(F.lit(1), F.length(text))


def unbalanced(text: Column) -> Column:
    return _count(text, "[（(]") != _count(text, "[）)]")


def junk_sentence(s: Column) -> Column:
    """Whether a sentence breaks one of thirteen rules of well-formed prose."""
    return (  # fixed values: the rules' patterns and limits
        ~has(s, f"[{ENDERS}]")
        | (F.length(sub(s, "[\\s、，]", "")) < 14)
        | has(s, "^[をはがのにへともでやゝ々、，。・ー）)】」』＞ァィゥェォッャュョヮぁぃぅぇぉっゃゅょゎｧｨｩｪｫｬｭｮｯ]")
        | has(s, CAPTION)
        | has(s, "^\\s*(?:[（(]?\\s*[0-9０-９a-zａ-ｚ]+\\s*[)）.．、]|[①-⑳]|[・･\\-*▪◦])")
        | (_count(s, "：") >= 2)
        | has(s, "[＝∫∑Σ∏Γ∇√]")
        | has(s, "[（(]\\s*[0-9０-９]{1,2}\\s*[）)]\\s*\\S")
        | has(s, "[βα]\\s*\\d|－\\s*\\d{2,}|\\d+\\s*編(?=[0-9A-Za-z_])")
        | (_count(s, "[、，][ 　\\t]") >= 2)
        | (_count(s, f"{KANJI_KANA}[ 　\\t]{KANJI_KANA}") >= 2)
        | unbalanced(s)
        | (_count(s, JAPANESE) < F.length(s) * 0.55)
    )


def heading_line(line: Column) -> Column:
    # fixed values: limits and marks of headings and of mathematics
    return ~has(line, f"[{ENDERS}]") & ((F.length(line) <= 9) | has(line, CAPTION) | has(line, "^[0-9０-９]+[.．・]"))


def math_line(line: Column) -> Column:
    return (_count(line, KANJI_KANA) < F.length(line) * 0.35) & has(line, "[=＝＋×÷∫∑√σεγτθλμνπρω()（）0-9]")


# --- web and routes ---


def wants_web(query: Column) -> Column:
    q = F.coalesce(query, F.lit(""))
    return (  # fixed values: directive phrases
        has(q, "(?iu)(web|ウェブ|wikipedia|ウィキペディア|ウィキ|ネット|ねっと|オンライン)\\s*(で|に|から)")
        | has(q, "(ググ|ぐぐ)(って|っで|り|る|れ|ろ)")
        | has(q, "(検索|サーチ)\\s*(して|し直して|してください|して下さい)")
        | has(q, "(?i)(web|ネット)\\s*検索")
    )


def web_term(query: Column) -> Column:
    q = sub(F.coalesce(query, F.lit("")), "^\\s+|\\s+$", "")
    for pattern in (  # fixed values: directive phrases, in order
        "(?iu)(web|ウェブ|wikipedia|ウィキペディア|ウィキ|ネット|ねっと|オンライン)\\s*(で|に|から|を)?",
        "(ググ|ぐぐ)(って|っで|り|る|れ|ろ)",
        "(で)?\\s*(検索|サーチ)(して|し直して|してください|して下さい)",
        "(を|について)?\\s*(調べ|探し|教え)(て(ください|下さい)?|る|たい)",
        "[をはがにでへとのもや]$",
        "^[\\s、。　]+|[\\s、。　]+$",
        "(とは(何(です)?か)?|について(教えて|知りたい)?|の意味|を(教えて|説明して?)|ですか|でしょうか|なに|何)[?？]*$",
        "[?？]+$",
        "^\\s+|\\s+$",
    ):
        q = sub(q, pattern, "")
    return q


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def query_parameters(query: Column) -> Column:
    """a=b&c=d as a map, URL-decoded; the last of equal keys wins, pairs without a key are dropped."""
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.length(F.substring_index(p, "=", 1)) > 0)
    keyed = F.transform(pairs, lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.url_decode(F.regexp_extract(p, "^[^=]*=?([\\s\\S]*)$", 1)).alias("v")))
    return F.map_from_entries(bind(keyed, lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["k"] == x["k"]))))


def route_parameters(path: Column, route: str) -> Column:
    """Parameters of a path under a route such as /docs/:id, null where the path doesn't match."""
    parts = [p for p in route.split("/") if p]
    got = F.filter(F.split(path, "/"), lambda p: p != "")
    match = F.size(got) == len(parts)
    entries = []
    for k, part in enumerate(parts):
        if part.startswith(":"):
            entries.append(F.struct(F.lit(part[1:]).alias("k"), F.url_decode(F.get(got, F.lit(k))).alias("v")))
        else:
            match = match & (F.get(got, F.lit(k)) == part)
    found = F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast("map<string,string>")
    return F.when(match, found)
