"""Texts that set off each rule: the driver's documents have no Japanese, no formulas and no mojibake, so queries of text rules read documents with such phrases put into them, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRASES = (
    "　歯車は動力を伝える重要な機械要素である。　軸は回転を支える大切な部品です。　",
    "歯車.軸,と(図)は、ABC.と,（式）で表す.値は12.5,3.4である.",
    "これは前述の説明に続く文であり十分に長い日本語の文である。",
    "この章では引張応力とひずみの関係を詳しく説明するものである。",
    "表3 材料の性質と強さの違いを示すものとする。",
    "第 3 章　強さ設計",
    "4・1・2 歯車（gear）の　強さ",
    "・箇条書きの項目は文として扱わないのがよいとされる。",
    "(1) 番号付きの項目も同じく文ではないものとする。",
    "①丸数字で始まる項目は箇条である。②次の項目も同じである。",
    "条件：温度：圧力：の三つを与えて応力を計算する。",
    "応力＝荷重∑面積の式で∫を使って計算するものである。",
    "係数（3）を用いて補正した値を示すものとする。",
    "β 3 編と設計4編Aを参照して値を求めるとよいとされる。",
    "材料、 温度、 圧力の順に大きく影響するとされている。",
    "歯 車と 軸 受の 組 合せを示す文であるとされる。",
    "括弧（が閉じない文は整っていないとみなすのである。",
    "短い文。をはじめとする助詞で始まる文は壊れているとみなす。",
    "Smith (1998) による結果.材料の疲労強度は（2001）年に報告された(図3)。",
    "式 (2.3)に示すとおり（ⅱ）の場合は大きくなる　、とされる（表 2）。",
    "가나다라마바 is garbage \ue001\ue002 text䷀、、歯車は良い。軸\uac00も良い。",
    "歯車の材\ue000料は鋼である。、軸は，，長く가まっすぐ\ufffdである部品として広く使われている。",
    "# 見出し　強さ",
    "> **章**: 基礎　編",
    "**太字** と `符号` の_行_ 　",
    "s⁻¹ と 値⁻¹²・次　の注₋₃・です。",
    "σ = P/A",
    "y=ax+b (1)",
    "歯車の種類　　には平歯車，，はすば歯車、、がある。。",
    "、。　先頭の句読点は除いてから文を読むものとする。",
    "Webで歯車を検索してください",
    "ネットで軸受とは何ですか？",
    "ググって歯車の強さについて教えて",
    "特徴：強度が高い、軽い、安価である、ャすい、のギヤなどがある。",
    "まず荷重を求め、次に断面を決める。",
    "\u00a0NBSP と\u2003全角空白\u3000の処理を\u3000\u3000確かめる文である。\ufeff",
    "引張応力の求め方と座屈、はりの曲げ応力を計算する。",
    "やはり円柱は橋梁とねじれを含む語であるとされる。",
    "図5は軸受の構造と寿命の関係を示すものである。",
    "基礎 概要 CAD-1 と CAD-1 の歯車とギヤの歯車。",
    "材料の強さは大きいほど望ましいとされているものの一つ",
    "熱伝達率は対流の速さで決まる量である（ただし空気中に限る）。",
)


def phrase(key: Column, step: int = 1) -> Column:
    """One phrase for each id; `step` varies which."""
    n = len(PHRASES)
    return F.get(F.array(*map(F.lit, PHRASES)), F.pmod(key * step + (step - 1), F.lit(n)).cast("int"))


def mixed(text: Column, key: Column) -> Column:
    """A whole text with phrases before it and after it, as lines and inside a line."""
    return F.concat(phrase(key), F.lit("\n"), F.coalesce(text, F.lit("")), phrase(key, 5), F.lit("\n\n"), phrase(key, 11), phrase(key, 13), F.lit("\n"), phrase(key, 17))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def phrase_sql(key: str, step: int = 1) -> str:
    return f"(list_extract([{', '.join(map(_literal, PHRASES))}], (({key} * {step} + {step - 1}) % {len(PHRASES)} + 1)::int))"


def mixed_sql(text: str, key: str) -> str:
    return f"{phrase_sql(key)} || chr(10) || coalesce({text}, '') || {phrase_sql(key, 5)} || chr(10) || chr(10) || {phrase_sql(key, 11)} || {phrase_sql(key, 13)} || chr(10) || {phrase_sql(key, 17)}"


#: documents (doc_id, text) with phrases, for SQL.
MIXED = f"m as (select doc_id, {mixed_sql('text', 'doc_id')} as text from documents)"
#: One phrase for each document, for SQL.
LONE = f"ph as (select doc_id, {phrase_sql('doc_id')} as text from documents)"
