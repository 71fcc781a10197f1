"""The rule-based agent trace as array expressions on a column of goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values: trigger words, step texts and messages ---
TRIGGERS = {
    "test": ("テスト", "test", "spec", "ci", "通す", "green"),
    "fix": ("修正", "バグ", "fix", "bug", "repair", "debug", "直す"),
    "create": ("作成", "作る", "create", "add", "追加", "new", "新規"),
    "search": ("検索", "探す", "search", "find", "locate", "調査", "調べる"),
    "refactor": ("リファクタ", "refactor", "整理", "cleanup", "clean"),
    "doc": ("ドキュメント", "doc", "readme", "説明", "文書"),
}
STEPS = {
    "locate": "関連コードを検索して問題箇所を特定する",
    "analyse": "原因となるファイルを読み込み根本原因を分析する",
    "patch": "修正パッチを書き込む",
    "create": "要件を満たす新しいファイル／関数を作成する",
    "refactor": "対象コードを読み込み構造を整理する",
    "doc": "変更内容に合わせてドキュメントを更新する",
    "split": "ゴールを部分課題に分解する",
    "gather": "必要な情報を収集して下準備を行う",
    "apply": "主要な変更を適用する",
    "run_tests": "テストを実行して結果を確認する（検証）",
    "verify": "変更を検証して受け入れ条件を満たすか確認する（検証）",
}
FAILED = "\n→ 失敗: 1 件のテストが赤 (assert mismatch)"
PASSED = "run_tests() → テストスイートを実行\n→ 成功: 全テストが緑 ✓"
REFLECTION = "失敗を分析: 期待値と実装の不一致。修正パッチが境界条件を取りこぼしている可能性が高い。エッジケースを補ってから再実行する。"
RETRY = "Thought: エッジケースを追加で修正\nAct: write_file() → run_tests()  (試行 2)"
BACKOFFS = ("run_tests() → 接続タイムアウト", "run_tests() → flaky な 1 件が赤", "run_tests() → 全テスト緑 ✓")
# --- end of fixed values ---


def has(goal: Column, intent: str) -> Column:
    g = F.lower(F.coalesce(goal, F.lit("")))
    out = F.lit(False)
    for w in TRIGGERS[intent]:
        out = out | F.contains(g, F.lit(w))
    return out


def intents(goal: Column) -> Column:
    return F.filter(F.array(*(F.when(has(goal, name), F.lit(name)) for name in TRIGGERS)), lambda x: x.isNotNull())


def plan(goal: Column) -> Column:
    """Ordered steps of a goal; the last one verifies."""
    step = lambda name, when: F.when(when, F.lit(STEPS[name]))
    fix = has(goal, "fix")
    main = F.filter(
        F.array(step("locate", has(goal, "search") | fix), step("analyse", fix), step("patch", fix), step("create", has(goal, "create")), step("refactor", has(goal, "refactor")), step("doc", has(goal, "doc"))), lambda x: x.isNotNull()
    )
    fallback = F.array(*(F.lit(STEPS[s]) for s in ("split", "gather", "apply")))
    last = F.when(has(goal, "test"), STEPS["run_tests"]).otherwise(STEPS["verify"])
    return F.concat(F.when(F.size(main) == 0, fallback).otherwise(main), F.array(last))


def short_goal(goal: Column) -> Column:
    g = F.trim(T.sub(F.when(F.coalesce(goal, F.lit("")) == "", "タスク").otherwise(goal), "\\s+", " "))
    return F.when(F.length(g) > 24, F.concat(F.substring(g, 1, 24), F.lit("…"))).otherwise(g)


def target_file(goal: Column) -> Column:
    return F.when(has(goal, "test") | has(goal, "fix"), "src/auth.js").when(has(goal, "create"), "src/feature.js").when(has(goal, "doc"), "README.md").otherwise("src/main.js")


def tool(step: Column) -> Column:
    return F.when(step.rlike("検索|特定"), "search").when(step.rlike("読み込|分析|整理"), "read_file").when(step.rlike("書き込|パッチ|作成|更新"), "write_file").when(step.rlike("テスト|検証|確認"), "run_tests").otherwise("search")


def observation(step: Column, goal: Column) -> Column:
    t, file = tool(step), target_file(goal)
    return (
        F.when(t == "read_file", F.concat(F.lit('read_file("'), file, F.lit('") → '), (12 + F.length(file) % 40).cast("string"), F.lit(" 行を読み込み")))
        .when(t == "write_file", F.concat(F.lit('write_file("'), file, F.lit('") → パッチを適用')))
        .when(t == "run_tests", F.lit("run_tests() → テストスイートを実行"))
        .otherwise(F.concat(F.lit('search("'), short_goal(goal), F.lit('") → 3 件の候補を取得')))
    )


def trace(goals: DataFrame) -> DataFrame:
    """(goal_id, seq, phase, text, ok, iter); a verification fails once, is reflected on, and succeeds. goals: goal_id, goal."""
    event = lambda phase, text, ok, it: F.struct(F.lit(phase).alias("phase"), text.alias("text"), F.lit(ok).alias("ok"), it.cast("int").alias("iter"))

    def events(step: Column, i: Column) -> Column:
        it, seen = i + 1, observation(step, F.col("goal"))
        act = event("Action", F.concat(F.lit("Thought: "), step, F.lit("\nAct: "), tool(step), F.lit("()")), True, it)
        failed = (event("Observation", F.concat(seen, F.lit(FAILED)), False, it), event("Reflection", F.lit(REFLECTION), True, it), event("Retry", F.lit(RETRY), True, it + 1), event("Observation", F.lit(PASSED), True, it + 1))
        return F.when(step.rlike("検証") | (tool(step) == "run_tests"), F.array(act, *failed)).otherwise(F.array(act, event("Observation", seen, True, it)))

    planned = goals.select("goal_id", "goal", plan(F.col("goal")).alias("steps"))
    listed = F.concat(F.size("steps").cast("string"), F.lit(" ステップの計画を生成:\n"), F.array_join(F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"))
    zero = F.lit(0)
    head = F.array(event("Goal", F.when(F.coalesce("goal", F.lit("")) == "", "(ゴール未設定)").otherwise(F.col("goal")), True, zero), event("Plan", listed, True, zero))
    # only the last step verifies, so a step's iteration is its place
    return planned.select("goal_id", F.posexplode(F.concat(head, F.flatten(F.transform("steps", events)))).alias("seq", "e")).select("goal_id", "seq", "e.*")


def reflect(traces: DataFrame) -> DataFrame:
    """(goal_id, actions, fails, retries, verified, n_suggestions) of traces."""
    rows = traces.groupBy("goal_id").agg(
        F.sum((F.col("phase") == "Action").cast("long")).alias("actions"), F.sum((~F.col("ok")).cast("long")).alias("fails"), F.sum((F.col("phase") == "Retry").cast("long")).alias("retries"),
        F.bool_or((F.col("phase") == "Observation") & F.col("text").rlike("成功|緑")).alias("verified"),
    )
    return rows.withColumn("n_suggestions", (F.lit(3) + (F.col("fails") > 0).cast("int") + (F.col("retries") > 0).cast("int")).cast("long"))


def suggestions(reflected: DataFrame) -> DataFrame:
    """(goal_id, suggestions) from the counts of a trace."""
    n = F.col("actions").cast("string")
    lines = F.array(
        F.when(F.col("fails") > 0, "最初の検証で失敗が発生: 変更前にローカルでテストを先に書く（テスト駆動）と早期に検知できる。"),
        F.when(F.col("retries") > 0, "リトライで回復: 失敗原因（境界条件）を計画段階のチェックリストに追加し、同種の失敗を未然に防ぐ。"),
        F.when(F.col("actions") > 4, F.concat(F.lit("アクション数が "), n, F.lit(" と多め: 関連ファイルをまとめて読み込み、往復回数を減らせる。"))).otherwise(F.concat(F.lit("アクション数は "), n, F.lit(" と適度: 各ステップが明確で無駄が少ない。"))),
        F.when(F.col("verified"), "最終的に検証ステップが成功: 受け入れ条件を満たしたことを明示的に確認できている。").otherwise("検証ステップが未完了: 必ず run_tests() などで受け入れ条件を確認する。"),
        F.lit("観測（Observation）を毎回 Thought に反映し、次のアクションの根拠を残すとトレースの追跡性が上がる。"),
    )
    return reflected.select("goal_id", F.filter(lines, lambda x: x.isNotNull()).alias("suggestions"))


def backoff_schedule(attempts: DataFrame, key: str, at: str, most: int = 3, base_ms: int = 1000) -> DataFrame:
    """Attempts (key, at, ok) with n, the place of each in its run, and backoff_ms, a wait that doubles with n and is 0 after a success.

    A run ends with a success, or after `most` attempts. Attempts of a key are
    in the order of `at`, which is distinct; an unknown outcome (null) is a failure.
    """
    order = Window.partitionBy(key).orderBy(at)
    done = F.coalesce(F.col("ok"), F.lit(False))
    runs = attempts.withColumn("run", F.coalesce(F.sum(done.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.pmod(F.row_number().over(Window.partitionBy(key, "run").orderBy(at)) - 1, F.lit(most)) + 1
    return runs.withColumn("n", n.cast("long")).withColumn("backoff_ms", F.when(done, F.lit(0.0)).otherwise(F.lit(base_ms) * F.pow(F.lit(2.0), F.col("n") - 1)).cast("long")).drop("run")


def summary(traces: DataFrame) -> DataFrame:
    return traces.groupBy("goal_id").agg(F.max("iter").alias("iterations"), F.bool_or(~F.col("ok")).alias("any_failure"), F.count("*").alias("events"))
