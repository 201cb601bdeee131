"""Quality rules learned as a decision list.

Sequential covering on labelled rows: grow a conjunction of threshold conditions by
information gain on two thirds of the rows, prune its last conditions on the rest,
keep it if it is right often enough there, set aside the rows it covers, and go on.
The list becomes one ordered Spark conditional expression. Candidate thresholds are
quantiles; all a step needs are counts by feature and bin, which Spark adds up over
all labelled rows, so the driver sees a few hundred numbers however many rows.

Everything runs in DataFrame expressions, row by row over whole texts.

Defined cases: a null text has no words; very long texts are measured whole; a feature without a value (a share of
nothing) is null and meets no condition; rows with a null label or id teach nothing;
of several labels of an id the lowest counts; without labels of both kinds the list
is empty and accepts all; repeated rows get equal results; an empty table gives an
empty table. ``measured`` takes a prefix, so that its columns need not clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.tables import written

BLANKS = " \t\n\x0b\f\r"
BINS = 32  # quantiles of a feature
GRID = 16  # even steps between its ends
RULES = 8
CONDITIONS = 3
PRECISION = 0.9  # of a rule, smoothed, on the rows it was not grown on
#: What the rules may test.
FEATURES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share"]
#: All that ``measured`` adds.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_upper", "n_exclaim", "n_lines", "n_dup_lines", "n_repeat_words", *FEATURES]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        value = F.col(prefix + self.feature)
        return F.coalesce(value > self.threshold if self.above else value <= self.threshold, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction that rejects."""

    rules: tuple[tuple[Condition, ...], ...]

    def _which(self, prefix: str, found, otherwise) -> Column:
        out = None
        for i, rule in enumerate(self.rules):
            met = F.lit(True)
            for condition in rule:
                met = met & condition.column(prefix)
            out = F.when(met, found(i)) if out is None else out.when(met, found(i))
        return otherwise if out is None else out.otherwise(otherwise)

    def accepts(self, prefix: str = "") -> Column:
        return self._which(prefix, lambda _: F.lit(False), F.lit(True))

    def reason(self, prefix: str = "") -> Column:
        """The first rule that rejects, as text; null if none does."""
        return self._which(
            prefix, lambda i: F.lit(" and ".join(map(str, self.rules[i]))), F.lit(None).cast("string")
        )


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns, the counts of the base rules and the learned rules' features."""
    p = prefix
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    start = docs.withColumns({f"{p}__words": words, f"{p}__lines": lines})
    w = F.col(f"{p}__words")
    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = start.withColumns(
        {
            f"{p}n_words": F.size(w).cast("long"),
            f"{p}word_chars": F.length(F.array_join(w, "")).cast("long"),
            f"{p}n_symbols": (F.size(F.split(text, "[#*$%&|<>]", -1)) - 1).cast("long"),
            f"{p}n_upper": (F.size(F.split(text, "[A-Z]", -1)) - 1).cast("long"),
            f"{p}n_exclaim": (F.size(F.split(text, "!", -1)) - 1).cast("long"),
            f"{p}n_lines": F.size(f"{p}__lines").cast("long"),
            f"{p}n_dup_lines": (F.size(f"{p}__lines") - F.size(F.array_distinct(f"{p}__lines"))).cast("long"),
            f"{p}__windows": windows,
        }
    )
    seen = F.col(f"{p}__windows")
    # Equal windows stand together once sorted, with the place of each. 64-bit hashes
    # of one text's windows: equal ones are equal windows but for 1 in 10^10 texts.
    placed = F.when(
        F.size(F.array_distinct(seen)) < F.size(seen),
        F.sort_array(F.transform(seen, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    marked = counted.withColumn(f"{p}__placed", placed)
    at = F.col(f"{p}__placed")
    twice = F.filter(
        F.sequence(F.lit(0), F.size(at) - 1),
        lambda i: (i > 0) & (F.get(at, i)["h"] == F.get(at, F.greatest(i - 1, F.lit(0)))["h"])
        | F.coalesce(F.get(at, i)["h"] == F.get(at, i + 1)["h"], F.lit(False)),
    )
    covered = F.flatten(F.transform(twice, lambda i: F.sequence(F.get(at, i)["i"], F.get(at, i)["i"] + 2)))
    repeats = F.when(at.isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(f"{p}{whole}") > 0, F.col(f"{p}{part}") / F.col(f"{p}{whole}"))

    return (
        marked.withColumn(f"{p}n_repeat_words", repeats)
        .withColumns(
            {
                f"{p}word_length": share("word_chars", "n_words"),
                f"{p}symbol_share": share("n_symbols", "n_words"),
                f"{p}dup_line_share": share("n_dup_lines", "n_lines"),
                f"{p}repeat_share": share("n_repeat_words", "n_words"),
                f"{p}upper_share": share("n_upper", "word_chars"),
                f"{p}exclaim_share": share("n_exclaim", "n_words"),
            }
        )
        .drop(*[f"{p}{name}" for name in ("__words", "__lines", "__windows", "__placed")])
    )


def base_failed(prefix: str = "") -> Column:
    """The fixed rules before the learned ones."""
    n_words, n_repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


def _bad(label: Column) -> Column:
    return (label == 0).cast("int")


def learn(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DecisionList:
    """Rules that find label 0 among ``measured`` rows; other labels are good."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(_bad(F.min(label_col)).alias("__bad"))
    joined = rows.select(F.col(id_col).alias("__id"), *FEATURES).join(known, "__id")
    part = (F.pmod(F.xxhash64("__id"), F.lit(3)) == 0).cast("int").alias("__held")
    table = written(joined.select("__bad", part, *FEATURES), "labelled")
    quantiles = [F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 2000).alias(f) for f in FEATURES]
    ends = [F.struct(F.min(f).alias("low"), F.max(f).alias("high")).alias(f"{f}__ends") for f in FEATURES]
    first = table.agg(F.sum("__bad").alias("bad"), F.count("*").alias("n"), *quantiles, *ends).first()
    if not first["bad"] or first["bad"] == first["n"]:
        return DecisionList(())
    cuts = {f: thresholds(first[f] or [], first[f"{f}__ends"]["low"], first[f"{f}__ends"]["high"]) for f in FEATURES}

    def bin_of(feature: str) -> Column:  # how many cuts lie below the value
        below = F.filter(F.lit(cuts[feature]).cast("array<double>"), lambda cut: cut < F.col(feature))
        return F.when(F.col(feature).isNotNull(), F.size(below))

    pairs = F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in FEATURES])
    table = written(table.withColumn("__bins", pairs), "binned")
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < RULES:
        left = table.filter(DecisionList(tuple(rules)).accepts())
        grown = _grow(left.filter("__held = 0"), cuts)
        rule = _pruned(left.filter("__held = 1"), grown) if grown else ()
        if not rule:
            break
        rules.append(rule)
    return DecisionList(tuple(rules))


def thresholds(quantiles: list[float], low: float | None, high: float | None) -> list[float]:
    """Quantiles, the middles between them and an even grid, so that a threshold need not
    lie at the edge of the values it keeps."""
    if low is None:
        return []
    known = sorted({low, high, *quantiles})
    middles = [(a + b) / 2 for a, b in zip(known, known[1:])]
    grid = [low + (high - low) * i / GRID for i in range(1, GRID)]
    return sorted({*quantiles, *middles, *grid})


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, ...]:
    """Add the condition of the largest gain until no bad row is told apart better."""
    rule: tuple[Condition, ...] = ()
    bad = n = None
    while len(rule) < CONDITIONS:
        pairs = rows.select("__bad", F.explode("__bins").alias("at")).filter("at.b is not null")
        stats = pairs.groupBy("at.f", "at.b").agg(F.sum("__bad").alias("bad"), F.count("*").alias("n")).collect()
        if bad is None:
            whole = rows.agg(F.sum("__bad").alias("bad"), F.count("*").alias("n")).first()
            bad, n = whole["bad"] or 0, whole["n"]
        if not bad or bad == n:
            break
        best: tuple[float, Condition, int, int] | None = None
        for feature in FEATURES:
            own = sorted((r["b"], r["bad"], r["n"]) for r in stats if r["f"] == feature)
            all_bad, all_n = sum(r[1] for r in own), sum(r[2] for r in own)
            low_bad = low_n = at = 0
            for i, cut in enumerate(cuts[feature]):  # a value of bin i lies at or below cut i
                while at < len(own) and own[at][0] <= i:
                    low_bad, low_n, at = low_bad + own[at][1], low_n + own[at][2], at + 1
                for above, p, m in ((False, low_bad, low_n), (True, all_bad - low_bad, all_n - low_n)):
                    if p and m < n:
                        gain = p * (math.log2(p / m) - math.log2(bad / n))
                        # Of equal gains the one furthest from the kept rows.
                        if best is None or gain > best[0] or above and gain == best[0]:
                            best = gain, Condition(feature, above, cut), p, m
        if best is None or best[0] <= 1e-9:
            break
        _, condition, bad, n = best
        rule += (condition,)
        rows = rows.filter(condition.column())
    return rule


def _pruned(rows: DataFrame, rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The prefix of the rule that is right most often on rows it was not grown on;
    nothing if that is too seldom."""
    sums, met = [], F.lit(True)
    for i, condition in enumerate(rule):
        met = met & condition.column()
        sums += [F.sum(F.when(met, F.col("__bad"))).alias(f"p{i}"), F.count(F.when(met, 1)).alias(f"n{i}")]
    found = rows.agg(*sums).first()
    right = [((found[f"p{i}"] or 0) + 1) / (found[f"n{i}"] + 2) for i in range(len(rule))]
    best = max(range(len(rule)), key=lambda i: (right[i], -i))
    return rule[: best + 1] if right[best] >= PRECISION else ()


def judge(rows: DataFrame, rules: DecisionList, prefix: str = "") -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``reason`` to measured rows."""
    failed = base_failed(prefix)
    reason = F.when(failed, "base").otherwise(rules.reason(prefix))
    return rows.withColumns(
        {f"{prefix}base_failed": failed, f"{prefix}kept": ~failed & rules.accepts(prefix), f"{prefix}reason": reason}
    )
