"""Fragments of DuckDB SQL that several oracles share."""

from ..functions import text as T

CJK = "[぀-ヿ一-鿿ｦ-ﾟ]"
#: A blank, and the inside of a class of blanks.
B = T.BLANKS
W = f"[{B}]"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{W}+|{W}+$', '', 'g')"


def wide(pattern: str) -> str:
    """A pattern with all blanks for \\s, as an SQL literal."""
    return "'" + T.wide(pattern).replace("'", "''") + "'"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {wide(pattern)}))"


def replaced(text: str, *steps: tuple[str, str]) -> str:
    """Replacements of all matches, one after the other."""
    for pattern, new in steps:
        text = f"regexp_replace({text}, {wide(pattern)}, '{new}', 'g')"
    return text


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {wide(pattern)})"


def fnv(text: str) -> str:
    """FNV-1a over UTF-16 units."""
    units = f"flatten(list_transform(string_split({text}, ''), lambda c: case when unicode(c) < 65536 then [unicode(c)] else [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] end))"
    return f"(case when {text} = '' then 2166136261 else list_reduce({units}, lambda h, c: (xor(h, c::hugeint) * 16777619::hugeint) % 4294967296::hugeint, 2166136261::hugeint) end)::bigint"


LM = "'[A-Za-z0-9'']+|[぀-ヿ一-鿿]|[、。，．！？!?…・]|\\n'"


def lm_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {LM})"


KEYS = "'[一-鿿]{2,}|[ァ-ヶー]{2,}|[A-Za-z][A-Za-z0-9\\-]+'"
GENERIC = "[" + ", ".join(f"'{w}'" for w in T.GENERIC_WORDS) + "]"


def key_terms(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, {KEYS}), lambda x: not list_contains({GENERIC}, x))"


def signature(text: str) -> str:
    k = f"list_sort(list_distinct({key_terms(text)}))"
    return f"lower(case when len({k}) > 0 then array_to_string({k}, '|') else regexp_replace({text}, '{W}+', '', 'g') end)"


GARBAGE = T.GARBAGE
GARBAGE_TOO = T.GARBAGE_WITH_REPLACEMENT
TIDY = (("[、，][、，]+", "、"), (",{2,}", ","), ("^[、，。\\s]+", ""))
LINE = (("^[ \\t]*#{1,6}[ \\t]+", ""), ("^[ \\t]*>[ \\t]?", ""), ("[*_`]+", ""), ("^\\s+|\\s+$", ""))
AFTER, BEFORE = "[぀-ヿ一-鿿ｦ-ﾟ）)」』】〕｝]", "[぀-ヿ一-鿿ｦ-ﾟ（(「『【〔｛]"
#: Look-behind and look-ahead become groups; none of them can overlap the next match.
PUNCTUATION = ((f"({AFTER})\\.", "\\1。"), (f"({AFTER}),", "\\1、"), (f",({BEFORE})", "、\\1"))
SANITIZE = (
    ("^[A-Za-z][^。．！？]*?[（(]\\s*(?:19|20)\\d{2}\\s*[)）][^。．！？]*?[.．](\\s*[一-鿿ぁ-ヿ])", "\\1"),
    ("[（(]\\s*(?:19|20)\\d{2}\\s*[)）]\\s*,?\\s*\\d*\\.?", ""),
    ("[（(]\\s*(?:図|表|式)[^）)]*[）)]", ""),
    ("式\\s*\\([^)]*\\)", ""),
    ("[（(]\\s*[ⅰ-ⅹⅠ-Ⅹ]+\\s*[）)]", ""),
    ("[（(]\\s*[0-9０-９]{1,2}\\s*[）)]", ""),
    ("β\\s*\\d+\\s*[－-]\\s*\\d+|β\\s*\\d+\\s*編|[一-鿿]\\d+\\s*編", ""),
    ("^[\\s.．。・･,，、:：;；)\\]】」』>＞〕）]+", ""),
    ("[ \\t　]{2,}", " "),
    ("\\s+([、。，．）)」』])", "\\1"),
    ("^\\s+|\\s+$", ""),
)
ENDERS = "[。．！？!?]"


def junk(s: str) -> str:
    """The rules of well-formed prose."""
    return "(" + " or ".join((
        f"not {matches(s, ENDERS)}",
        f"length({replaced(s, ('[\\s、，]', ''))}) < 14",
        matches(s, "^[をはがのにへともでやゝ々、，。・ー）)】」』＞ァィゥェォッャュョヮぁぃぅぇぉっゃゅょゎｧｨｩｪｫｬｭｮｯ]"),
        matches(s, T.CAPTION),
        matches(s, "^\\s*(?:[（(]?\\s*[0-9０-９a-zａ-ｚ]+\\s*[)）.．、]|[①-⑳]|[・･\\-*▪◦])"),
        f"{count(s, '：')} >= 2",
        matches(s, "[＝∫∑Σ∏Γ∇√]"),
        matches(s, "[（(]\\s*[0-9０-９]{1,2}\\s*[）)]\\s*\\S"),
        matches(s, "[βα]\\s*\\d|－\\s*\\d{2,}|\\d+\\s*編[0-9A-Za-z_]"),
        f"{count(s, '[、，][ 　\\t]')} >= 2",
        f"{count(s, '[一-鿿ぁ-ヿ][ 　\\t][一-鿿ぁ-ヿ]')} >= 2",
        f"{count(s, '[（(]')} <> {count(s, '[）)]')}",
        f"{count(s, '[一-鿿ぁ-ヶ゠-ヿ]')} < length({s}) * 0.55::double",
    )) + ")"


def heading(l: str) -> str:  # noqa: E741
    return f"(not {matches(l, ENDERS)} and (length({l}) <= 9 or {matches(l, T.CAPTION)} or {matches(l, '^[0-9０-９]+[.．・]')}))"


def maths(l: str) -> str:  # noqa: E741
    return f"({count(l, '[一-鿿ぁ-ヿ]')} < length({l}) * 0.35::double and {matches(l, '[=＝＋×÷∫∑√σεγτθλμνπρω()（）0-9]')})"


def derubble(line: str) -> str:
    parts = f"list_filter(string_split(replace({line}, '。', '。' || chr(2)), chr(2)), lambda s: s <> '')"
    g = lambda s: f"len(regexp_extract_all({s}, '{GARBAGE}'))"
    kept = f"list_filter({parts}, lambda s: not ({g('s')} >= 5 or {g('s')}::double / greatest(1, length(s)) > 0.08::double))"
    return f"array_to_string(list_transform({kept}, lambda s: case when {g('s')} = 0 then s else {replaced('s', (GARBAGE, ''), *TIDY)} end), '')"


def terms(text: str) -> str:
    cj = f"regexp_extract_all({text}, '{CJK}')"
    return f"list_concat(regexp_extract_all(lower({text}), '[a-z][a-z0-9\\-]{{1,}}'), list_transform(range(1, len({cj})), lambda i: {cj}[i] || {cj}[i + 1]))"


def index(docs: str = "documents") -> str:
    return f"""
t as (select doc_id, unnest({terms("coalesce(text, '')")}) as term from {docs}),
tf as (select doc_id, term, count(*) as tf from t group by all),
df as (select term, count(*) as df from tf group by all),
dl as (select d.doc_id, coalesce(s.dl, 0)::bigint as dl from {docs} d left join (select doc_id, sum(tf) as dl from tf group by all) s on d.doc_id = s.doc_id),
st as (select count(*)::double as n, sum(dl)::double / count(*)::double as avgdl from dl)"""


INDEX = index()
QUERIES = f"""
q as (select item_id as qid, term, count(*) as qtf from (select item_id, unnest({terms("text")}) as term from benchmark) group by all)"""


def bm25(k1: float, b: float) -> str:
    return f"ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * {k1 + 1}::double / (tf + {k1}::double * ({1 - b}::double + {b}::double * dl / avgdl))"


BM25_SCORES = f"""
sc as (select q.qid, tf.doc_id, round(sum({bm25(1.5, 0.75)}), 9) as score from q join tf on q.term = tf.term join df on df.term = tf.term join dl on dl.doc_id = tf.doc_id cross join st group by all)"""
COSINE_SCORES = """
i as (select term, ln(1 + n / df) as idf from df cross join st),
dv as (select tf.doc_id, tf.term, tf.tf * i.idf as w from tf join i on tf.term = i.term),
qv as (select q.qid, q.term, q.qtf * i.idf as w from q join i on q.term = i.term),
dn as (select doc_id, sqrt(sum(w * w)) as n from dv group by all),
qn as (select qid, sqrt(sum(w * w)) as n from qv group by all),
sc as (select qv.qid, dv.doc_id, round(sum(qv.w * dv.w) / (any_value(qn.n) * any_value(dn.n)), 9) as score from qv join dv on qv.term = dv.term join qn on qn.qid = qv.qid join dn on dn.doc_id = dv.doc_id group by qv.qid, dv.doc_id)"""


def top(k: int, source: str = "sc") -> str:
    return f"select qid, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by score desc, doc_id)::int as rank from {source}) where rank <= {k}"


def flat(text: str) -> str:
    """Text with white space collapsed and trimmed."""
    return f"trim(regexp_replace({text}, '{W}+', ' ', 'g'))"


def sentences(text: str) -> str:
    """Sentences: enders are followed by U+0002, which is then split on."""
    marked = f"regexp_replace(regexp_replace({flat(text)}, '([。．！？!?])', '\\1' || chr(2), 'g'), '\\.( |$)', '.' || chr(2) || '\\1', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(2)), lambda x: trim(x)), lambda x: x <> '')"


def split(docs: str) -> str:
    return f"s as (select doc_id, unnest(ss) as sentence, (generate_subscripts(ss, 1) - 1)::int as pos from (select doc_id, {sentences("coalesce(text, '')")} as ss from {docs}))"


SENTENCES = split("documents")


def feedback_sentences(text: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({text}, '([。．！？!?])', '\\1' || chr(2), 'g'), chr(2)), lambda x: {strip('x')}), lambda x: length(x) >= 6)"
