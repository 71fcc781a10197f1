"""A registry of formulas and tables: lookup by trigger terms and computation with units."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: trigger terms, words that never match alone, words that hide a short term, units ---
FORMULAS = {
    "tensile": ("引張応力", "引張荷重", "垂直応力"),
    "hooke": ("フック", "縦弾性係数", "ヤング率", "ひずみ"),
    "bending": ("曲げ応力", "断面係数", "はり", "梁", "曲げモーメント"),
    "torsion": ("ねじり応力", "ねじり", "せん断応力", "極断面係数"),
    "euler": ("オイラー", "座屈", "柱"),
    "l10": ("転がり軸受の寿命", "基本定格寿命", "軸受の寿命", "軸受寿命", "等価荷重", "定格荷重"),
    "newton": ("対流熱伝達", "熱伝達率", "ニュートンの冷却", "冷却則", "熱伝達"),
    "fourier": ("熱伝導", "フーリエ", "熱伝導率"),
    "module": ("モジュール", "基準円直径", "歯数"),
    "lewis": ("ルイス", "歯元曲げ応力", "歯元"),
    "bolt": ("締付け", "締結", "ボルト", "ねじ"),
    "spring": ("ばね定数", "コイルばね"),
    "safety": ("許容応力", "安全係数", "降伏点", "基準強さ"),
}
TABLES = {"fit": ("はめあい", "中間ばめ", "すきまばめ", "しまりばめ", "圧入"), "carbon-steel": ("炭素鋼", "引張強さ", "鋼材"), "gear-type": ("歯車の種類", "軸配置"), "safety-factor": ("安全率",)}
HIDERS = {"柱": "[円支角]柱", "はり": "やはり", "梁": "橋梁", "ねじ": "ねじ[れり]"}
UNITS = {
    "N": 1.0, "kN": 1e3, "m": 1.0, "mm": 1e-3, "m2": 1.0, "mm2": 1e-6, "m3": 1.0, "m4": 1.0, "Pa": 1.0, "MPa": 1e6, "N·m": 1.0, "K": 1.0, "-": 1.0, "W/(m²·K)": 1.0, "W/(m·K)": 1.0,
}
#: id: inputs, units of the inputs in the formula and of the result
SIGNATURES = {
    "tensile": (("P", "A"), "Pa"), "hooke": (("E", "ε"), "Pa"), "bending": (("M", "Z"), "Pa"), "torsion": (("T", "Z_p"), "Pa"), "euler": (("E", "I", "l_k"), "N"), "l10": (("C", "P", "p"), "10⁶ rev"),
    "newton": (("h", "A", "ΔT"), "W"), "fourier": (("λ", "A", "ΔT", "L"), "W"), "module": (("d", "z"), "mm"), "lewis": (("F_t", "b", "m", "Y"), "MPa"), "bolt": (("K", "d", "F"), "N·m"), "spring": (("G", "d", "D", "n"), "N/mm"), "safety": (("σ_s", "S"), "Pa"),
}
#: Factors from SI to the unit of the result.
SCALE = {"mm": 1e3, "MPa": 1e-6, "N/mm": 1e-3}
# --- end of fixed values ---


def registry(spark) -> DataFrame:
    rows = [("formula", k, t) for k, ts in FORMULAS.items() for t in ts] + [("table", k, t) for k, ts in TABLES.items() for t in ts]
    return spark.createDataFrame([(*r, HIDERS.get(r[2])) for r in rows], "cat string, id string, term string, hider string")


def matched(text: Column, term: Column, hider: Column) -> Column:
    """Whether a term occurs outside the words that only contain it."""
    return F.contains(F.when(hider.isNull(), text).otherwise(F.regexp_replace(text, F.coalesce(hider, F.lit("")), "")), term)


def lookup(queries: DataFrame, max_formulas: int = 1, max_tables: int = 1) -> DataFrame:
    """(qid, cat, id, rank): entries whose terms a query holds, the longest matching term first; the registry is small and fixed, so it is broadcast."""
    hits = queries.select("qid", "query").join(F.broadcast(registry(queries.sparkSession)), matched(F.col("query"), F.col("term"), F.col("hider")))
    best = hits.groupBy("qid", "cat", "id").agg(F.max(F.length("term")).alias("strength"), F.count("*").alias("m"))
    rank = F.row_number().over(Window.partitionBy("qid", "cat").orderBy(F.desc("strength"), F.desc("m"), "id"))
    return best.withColumn("rank", rank).where(F.when(F.col("cat") == "formula", F.col("rank") <= max_formulas).otherwise(F.col("rank") <= max_tables)).select("qid", "cat", "id", "strength", "rank")


def best_entry(queries: DataFrame) -> DataFrame:
    """(qid, cat, id): the strongest entry of either kind, or none."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("strength"), "cat"))
    top = lookup(queries).withColumn("r", rank).where("r = 1").select("qid", "cat", "id")
    return queries.select("qid").join(top, "qid", "left").select("qid", F.coalesce("cat", F.lit("none")).alias("cat"), "id")


def compute(rows: DataFrame) -> DataFrame:
    """(row_id, id, ok, value, unit, why) of formulas on inputs: rows have row_id, id, inputs map<string, struct<value, unit>>."""
    factor = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))

    def v(name: str) -> Column:
        x = F.try_element_at("inputs", F.lit(name))
        return x["value"] * F.try_element_at(factor, x["unit"])

    div = lambda a, b: F.when(b != 0, a / b)
    value = {
        "tensile": div(v("P"), v("A")), "hooke": v("E") * v("ε"), "bending": div(v("M"), v("Z")), "torsion": div(v("T"), v("Z_p")), "euler": div(F.lit(math.pi**2) * v("E") * v("I"), v("l_k") * v("l_k")), "l10": F.pow(div(v("C"), v("P")), v("p")),
        "newton": v("h") * v("A") * v("ΔT"), "fourier": div(v("λ") * v("A") * v("ΔT"), v("L")), "module": div(v("d"), v("z")), "lewis": div(v("F_t"), v("b") * v("m") * v("Y")), "bolt": v("K") * v("d") * v("F"),
        "spring": div(v("G") * F.pow(v("d"), F.lit(4)), 8 * F.pow(v("D"), F.lit(3)) * v("n")), "safety": div(v("σ_s"), v("S")),
    }
    result, unit, missing = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(True)
    for name, (inputs, out) in SIGNATURES.items():
        mine = F.col("id") == name
        result = F.when(mine, value[name] * SCALE.get(out, 1.0)).otherwise(result)
        unit = F.when(mine, out).otherwise(unit)
        lacks = F.lit(False)
        for i in inputs:
            lacks = lacks | v(i).isNull()
        missing = F.when(mine, lacks).otherwise(missing)
    rows = rows.select("row_id", "id", result.alias("value"), unit.alias("unit"), missing.alias("missing"))
    why = F.when(F.col("unit").isNull(), "unknown formula").when(F.col("missing"), "missing input").when(F.col("value").isNull(), "division by zero")
    return rows.select("row_id", "id", why.isNull().alias("ok"), F.when(why.isNull(), F.col("value")).alias("value"), "unit", why.alias("why"))
