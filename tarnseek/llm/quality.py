"""Quality rules: a learned decision list over countable signs of a text.

Sequential covering on labelled rows: a rule grows by the threshold condition with the best
information gain until it covers no good row, is pruned on rows kept aside, and the rows it
covers are taken out before the next rule. All counts come from grouped aggregates; the driver
sees one row per sign and interval. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnseek.llm.common import SPACE_CLASS, let, written

WINDOW = 3
MIN_WORDS = 50
#: Signs that rules may test, each worked out from the counts of ``signs``.
TESTED = ["symbol_share", "upper_share", "mark_share", "mean_word", "dup_line_share", "repeat_share"]
#: Quantiles of each class whose midpoints are the thresholds tried.
_QUANTILES = [i / 20 for i in range(21)]
_POSITION_BITS = 31


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three that are found twice or more.

    Windows are first told apart by 33 bits of hash sorted along with their place; only those
    whose neighbours there agree are compared as strings. Work is that of a sort of the row's own words.
    """

    def window(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(WINDOW)]

    def packed(i: Column) -> Column:
        part = F.xxhash64(*window(i)).bitwiseAND(F.lit((1 << 33) - 1))
        return F.shiftleft(part, _POSITION_BITS).bitwiseOR(i.cast("long"))

    def twice(rows: Column, of) -> Column:
        return F.filter(rows, lambda x, k: (of(x) == of(F.get(rows, k - 1))) | (of(x) == of(F.get(rows, k + 1))))

    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    maybe = let(F.sort_array(F.transform(places, packed)), lambda s: twice(s, lambda x: F.shiftrightunsigned(x, _POSITION_BITS)))
    spelt = F.transform(
        maybe,
        lambda x: let(
            x.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int"),
            lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("words"), i.alias("at")),
        ),
    )
    same = let(F.sort_array(spelt), lambda s: twice(s, lambda x: x["words"]))
    at = F.sort_array(F.transform(same, lambda x: x["at"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(
        at,
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(total)


def signs(text: Column) -> Column:
    """Struct of counts over the whole text; a null text has none of anything. Each is a long.

    Words are runs of anything but ASCII white space; a line is a dup if it has a word and equals
    an earlier one.
    """
    text = F.coalesce(text, F.lit(""))

    def left_of(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            left_of(r"[^#*$%&|<>]+").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
            left_of(r"[^A-Z]+").alias("n_upper"),
            left_of(r"[^!?]+").alias("n_marks"),
        )

    return let(words_of(text), counts)


def base_failed(s: Column) -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def measures(s: Column) -> dict[str, Column]:
    """The tested signs as shares; 0 where there is nothing to share."""

    def share(a: str, b: str) -> Column:
        return F.when(s[b] > 0, s[a] / s[b]).otherwise(F.lit(0.0))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "mean_word": share("word_chars", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    sign: str
    above: bool
    threshold: float

    def of(self, values: dict[str, Column]) -> Column:
        value = values[self.sign]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.sign} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, values: dict[str, Column]) -> Column:
    held = F.lit(True)
    for c in rule:
        held = held & c.of(values)
    return held


def _columns() -> dict[str, Column]:
    return {name: F.col(name) for name in TESTED}


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Midpoints between the quantiles of the two classes."""
    wanted = [
        F.percentile_approx(F.when(F.col("bad") == flag, F.col(name)), _QUANTILES, 10_000).alias(f"{name}_{flag}")
        for name in TESTED
        for flag in (0, 1)
    ]
    row = rows.agg(*wanted).first()
    out = {}
    for name in TESTED:
        points = sorted({x for flag in (0, 1) for x in row[f"{name}_{flag}"] or []})
        out[name] = [(a + b) / 2 for a, b in zip(points, points[1:])]
    return out


def _interval_counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """For each sign and interval between its thresholds: how many bad and good rows lie there."""
    parts = []
    for name, points in cuts.items():
        interval = sum((F.when(F.col(name) > p, 1).otherwise(0) for p in points), F.lit(0))
        parts.append(F.struct(F.lit(name).alias("sign"), interval.alias("interval")))
    found = rows.select("bad", F.explode(F.array(*parts)).alias("x")).groupBy("x.sign", "x.interval")
    found = found.agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
    out = {name: [[0, 0] for _ in range(len(points) + 1)] for name, points in cuts.items()}
    for r in found:
        out[r["sign"]][r["interval"]] = [r["bad"], r["n"] - r["bad"]]
    return out


def _best_condition(counts: dict[str, list[list[int]]], cuts: dict[str, list[float]]) -> tuple[float, Condition | None, int, int]:
    """The condition with the highest gain in bits per bad row it keeps."""
    best: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for name, parts in counts.items():
        bad, good = (sum(p[i] for p in parts) for i in (0, 1))
        if not bad:
            continue
        before = math.log2(bad / (bad + good))
        low = [0, 0]
        for point, part in zip(cuts[name], parts):
            low = [low[0] + part[0], low[1] + part[1]]
            for above, (b, g) in ((False, low), (True, [bad - low[0], good - low[1]])):
                if b:
                    gain = b * (math.log2(b / (b + g)) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(name, above, point), b, g)
    return best


def _covered(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    """Bad and good rows under each rule."""
    sums = []
    for i, rule in enumerate(rules):
        held = _holds(rule, _columns())
        sums += [F.sum(F.when(held, F.col("bad"))).alias(f"b{i}"), F.count(F.when(held, 1)).alias(f"n{i}")]
    row = rows.agg(*sums).first()
    return [(row[f"b{i}"] or 0, row[f"n{i}"] - (row[f"b{i}"] or 0)) for i in range(len(rules))]


def learn(labelled: DataFrame, min_precision: float = 0.95, min_rows: int = 5, max_rules: int = 8, max_conditions: int = 4) -> list[Rule]:
    """Rules for bad rows, in order. ``labelled`` has the tested signs and ``bad`` (1 or 0); all its rows are counted.

    A third of the rows, by the hash of all their values, is kept aside for pruning. Stops when a rule covers
    fewer than ``min_rows`` bad rows or isn't right often enough. No rows, or none of one class, give no rules.
    """
    rows = labelled.select("bad", *TESTED).withColumn("aside", F.pmod(F.xxhash64("bad", *TESTED), F.lit(3)) == 0)
    cuts = _thresholds(rows)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows
        for r in rules:
            left = left.where(~_holds(r, _columns()))
        grow = left.where("not aside")
        rule: Rule = ()
        while len(rule) < max_conditions:
            gain, condition, bad, good = _best_condition(_interval_counts(grow.where(_holds(rule, _columns())), cuts), cuts)
            if condition is None:
                break
            rule += (condition,)
            if not good:
                break
        if not rule:
            break
        shorter = [rule[:i] for i in range(len(rule), 0, -1)]
        scores = _covered(left.where("aside"), shorter)
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in scores]
        rule = shorter[worth.index(max(worth))]
        [(bad, good)] = _covered(left, [rule])
        if bad < min_rows or bad < min_precision * (bad + good):
            break
        rules.append(rule)
    return rules


def verdict(s: Column, rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: false at the first rule that holds, else true."""
    values = measures(s)
    out = F
    for rule in rules:
        out = out.when(_holds(rule, values), F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def kept(s: Column, rules: list[Rule]) -> Column:
    """False for rows that fail the base rules or that the list rejects."""
    return ~base_failed(s) & verdict(s, rules)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and ``s``, the struct of counts, written to the shared folder. Other columns aren't read."""
    return written(docs.select("doc_id", signs(F.col("text")).alias("s")), "signs")


def learn_from_labels(counts: DataFrame, labels: DataFrame, **settings) -> list[Rule]:
    """Rules from rows whose ``quality`` is 0 or 1 and that pass the base rules."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("doc_id"), (1 - F.col("quality")).cast("int").alias("bad"))
    rows = counts.join(known, "doc_id").where(~base_failed(F.col("s")))
    table = written(rows.select("bad", *[c.alias(n) for n, c in measures(F.col("s")).items()]), "labelled-signs")
    return learn(table, **settings)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, and kept of every row. Repeated rows stay; an empty table gives an empty one."""
    counts = counted(docs)
    rules = learn_from_labels(counts, labels)
    s = F.col("s")
    return counts.select("doc_id", "s.*", base_failed(s).alias("base_failed"), kept(s, rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Only labelled texts are counted to learn from; those of all rows are counted once, where the list is applied.
    Texts are shuffled only to meet labels that are too many to broadcast.
    """
    known = labels.where("quality in (0, 1)").select("doc_id").distinct()
    rules = learn_from_labels(counted(docs.select("doc_id", "text").join(known, "doc_id", "left_semi")), labels)
    return docs.where(let(signs(F.col("text")), lambda s: kept(s, rules)))
