"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text whose rate exceeds a cutoff. For each stratum (language) the cutoffs of all rules form one nested chain, from
lenient to strict: each step tightens one rule, first where most labelled bad documents go for the fewest unlabelled ones. Labelled good
documents have no part in the chain; they show how many of them the rules of a step reject together. A step is valid if the exact binomial
probability of so few rejections, were the true rate over ALPHA, is at most the level; the first failure ends the chain. The level
is divided by the number of strata only (Bonferroni), so with confidence 1 - DELTA no stratum loses over ALPHA of its good documents.
Of the valid steps, the one that best parts bad from good documents is taken."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.llm.common import BREAK, WORD, crc32_mod, documents, written

ALPHA, DELTA = 0.02, 0.05
#: Words of a window whose repetition counts.
WINDOW = 8
#: Cutoffs of every rule, from lenient to strict.
GRID = [round(2.0 ** (-i / 4), 6) for i in range(49)]
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "least(5 * n_dup_lines / greatest(n_words, 1), 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "least(word_chars / greatest(n_words, 1) / 40, 1)",
}


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.element_at(F.transform(F.array(windows), _covered), 1)


def _covered(windows: Column) -> Column:
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda s: F.filter(
        s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"]))
    )
    hits = F.element_at(F.transform(F.array(placed), again), 1)
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - x)).alias("n"), (x + WINDOW).alias("end"))
    covered = F.aggregate(F.array_sort(F.transform(hits, lambda x: x["i"])), state, step, lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of each whole text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), text.alias("t"))
    rows = rows.withColumn("words", F.filter(F.split("t", BREAK, -1), lambda w: w != ""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", BREAK, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def choose(counts: list[tuple[int, int]], good: int, bad: int, rate: float, level: float) -> int | None:
    """Index of the cutoff to use, given (good, bad) rejected by each; None if no valid one helps."""
    best, gain = None, 0.0
    for i, (g, b) in enumerate(counts):
        if not good or binomial_tail(g, good, rate) > level:
            break
        if bad and b / bad - g / good > gain + 1e-12:
            best, gain = i, b / bad - g / good
    return best


def _passes(rate: Column) -> Column:
    """How many cutoffs of the grid let the rate pass."""
    return F.aggregate(F.array(*map(F.lit, GRID)), F.lit(0), lambda a, g: a + (rate <= g).cast("int"))


def chain(bad: dict[str, list[int]], others: dict[str, list[int]]) -> list[dict[str, int]]:
    """Nested steps of (index of the cutoff by rule), given how many bad and other rows pass so many cutoffs of each rule."""
    steps, at = [], {}
    while True:
        best = None
        for rule in bad:
            caught = lost = 0
            for to in range(at[rule] + 1 if rule in at else 0, len(GRID)):
                caught, lost = caught + bad[rule][to], lost + others[rule][to]
                if caught and (best is None or caught / (lost + 1) > best[0]):
                    best = caught / (lost + 1), rule, to
        if best is None:
            return steps
        at = at | {best[1]: best[2]}
        steps.append(at)


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str | None, str], float]:
    """Cutoff by (stratum, rule), from rows that don't fail the base rules: those with a label in labels(doc_id, quality), and for the order of the cutoffs those without.

    A stratum with hardly any without gives a fifth of its good ones for the order; these are not tested."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
    passes = [_passes(F.expr(v).cast("double")).alias(k) for k, v in RULES.items()]
    cells = written(measured.filter(~F.col("base_failed")).join(known, "doc_id", "left").select("stratum", "quality", (crc32_mod("doc_id", 5) == 0).alias("fold"), *passes))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("passes")) for k in RULES)))
    table = (
        cells.filter("quality is null or quality = 0 or fold")
        .select("stratum", F.expr("case quality when 0 then 0 when 1 then 2 else 1 end").alias("kind"), each.alias("x"))
        .groupBy("stratum", "kind", "x.rule", "x.passes")
        .count()
        .collect()  # a row for each stratum, rule, label and grid cell at most
    )
    counts: dict[str | None, tuple[dict, ...]] = {}
    for r in table:
        held = counts.setdefault(r["stratum"], tuple({k: [0] * (len(GRID) + 1) for k in RULES} for _ in range(3)))
        held[r["kind"]][r["rule"]][r["passes"]] += r["count"]
    size = lambda kind: sum(kind[next(iter(RULES))])
    thin = {s for s, (_, without, fold) in counts.items() if size(without) < size(fold)}
    chains = {s: steps for s, (bad, without, fold) in counts.items() if (steps := chain(bad, fold if s in thin else without))}
    if not chains:
        return {}
    first = [(s, s in thin, *([next((k for k, at in enumerate(steps) if at.get(rule, -1) >= n), len(steps)) for n in range(len(GRID) + 1)] for rule in RULES)) for s, steps in chains.items()]
    plan = measured.sparkSession.createDataFrame(first, ", ".join(["s string", "thin boolean", *(f"first_{k} array<int>" for k in RULES)]))
    step = F.least(*(F.get(f"first_{k}", F.col(k)) for k in RULES))  # the first step that rejects the row by any rule
    tested = cells.filter("quality is not null").join(F.broadcast(plan), F.expr("stratum <=> s")).filter("not (thin and fold and quality = 1)")
    joint = tested.groupBy("stratum", "quality", step.alias("step")).count().collect()
    out = {}
    steps_of = {s: [[0] * (len(steps) + 1) for _ in range(2)] for s, steps in chains.items()}
    for r in joint:
        steps_of[r["stratum"]][r["quality"]][r["step"]] += r["count"]
    for s, steps in chains.items():
        at = steps_of[s]
        rejected = [(sum(at[1][: i + 1]), sum(at[0][: i + 1])) for i in range(len(steps))]
        i = choose(rejected, sum(at[1]), sum(at[0]), alpha, delta / len(chains))
        if i is not None:
            out |= {(s, rule): GRID[n] for rule, n in steps[i].items()}
    return out


def verdicts(measured: DataFrame, cutoffs: dict[tuple[str | None, str], float]) -> DataFrame:
    """measured with `kept`; the cutoffs, a row for each stratum that has any, are joined."""
    strata = sorted({s for s, _ in cutoffs}, key=str)
    table = measured.sparkSession.createDataFrame([(s, *(cutoffs.get((s, rule)) for rule in RULES)) for s in strata], ", ".join(["s string", *(f"cutoff_{rule} double" for rule in RULES)]))
    joined = measured.join(F.broadcast(table), F.expr("stratum <=> s"), "left")
    kept = ~F.col("base_failed")
    for rule, rate in RULES.items():
        kept = kept & F.coalesce(F.expr(rate) <= F.col(f"cutoff_{rule}"), F.lit(True))
    return joined.select(*measured.columns, kept.alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of docs(doc_id, text, lang).

    A null or empty text has no words and fails the base rules. A null lang is a stratum of its own; a stratum without enough labels
    to prove its first cutoffs (about 217 good ones with four strata) rejects only by the base rules. Ties at a cutoff pass. Repeated rows and null ids keep their
    rows, other columns are ignored, labels of no document are ignored, and an empty table gives an empty one."""
    measured = written(measures(docs))
    return verdicts(measured, calibrate(measured, labels, alpha, delta)).drop("stratum")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
