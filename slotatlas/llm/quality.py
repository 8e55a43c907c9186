"""Quality rules: text statistics, and an ordered list of learned rejection rules. Built-in functions only.

The list is learned by sequential covering. Labelled statistics are counted once, in cells between candidate
thresholds of each feature (at most (cuts + 1) ** features cells, whatever the number of labels), separately for a part
that rules grow on and a part they are pruned on. A rule grows by the threshold condition with the largest information
gain, loses its last conditions while that doesn't hurt on the pruning part, and is kept if it is precise enough; what
it covers is taken out before the next one. The rules become one conditional expression; the default keeps.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas.llm.common import SPACES, let, materialize, words_of

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = ["base_failed", "kept", "rule"]


window_hash = F.xxhash64


def n_repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the text.

    Windows are hashed to 64 bits less the bits that a place needs, put before the place, and sorted as plain numbers:
    equal windows become neighbours. Only places whose hash occurs twice go on; their words are compared, so windows that
    merely share a hash don't count.
    """
    def body(w: Column) -> Column:
        bits = F.ceil(F.log2(F.size(w) + F.lit(1))).cast("int")
        return let(bits, lambda b: places(w, b))

    def places(w: Column, b: Column) -> Column:
        def numbered(i: Column) -> Column:
            window = window_hash(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.call_function("shiftleft", window, b).bitwiseOR(i.cast("long"))

        numbers = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), numbered))
        return let(numbers, lambda s: repeated(w, s, b))

    def repeated(w: Column, s: Column, b: Column) -> Column:
        high = lambda x: F.call_function("shiftright", x, b)
        twice = F.filter(s, lambda x, i: (high(x) == high(F.get(s, i + 1))) | (high(x) == high(F.get(s, i - 1))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
        return let(F.transform(twice, lambda x: x.bitwiseAND(mask)), lambda p: let(spelled(w, p), equal))

    def spelled(w: Column, p: Column) -> Column:
        def window(x: Column) -> Column:
            i = x.cast("int")  # words hold no blank
            return F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("window"), x.alias("place"))

        return F.sort_array(F.transform(p, window))

    def equal(v: Column) -> Column:
        at = lambda i: F.get(v, i)["window"]
        twice = F.filter(v, lambda x, i: (x["window"] == at(i + 1)) | (x["window"] == at(i - 1)))
        return let(F.sort_array(F.transform(twice, lambda x: x["place"])), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1), x + 3) - x))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, body))


def free_name(name: str, df: DataFrame) -> str:
    """A name that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of a text (all long): words, their characters, symbols, repeated lines, words in repeats.

    Null and empty texts have none of anything. Columns of the same names are replaced.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in STATISTICS]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    word, line = free_name("words", df), free_name("lines", df)
    split = df.select(*kept, words_of(whole).alias(word), lines.alias(line))
    return split.select(
        *kept,
        F.size(word).cast("long").alias("n_words"),
        F.char_length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col(word)).alias("n_repeat_words"))


def base_failed() -> Column:
    """The fixed rule that goes before the learned ones."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """What conditions look at; null for a text without words."""
    per_word = lambda c: F.col(c) / F.when(F.col("n_words") > 0, F.col("n_words"))
    return {"n_words": F.col("n_words").cast("double"), "word_length": per_word("word_chars"), "symbols": per_word("n_symbols"),
            "dup_lines": per_word("n_dup_lines"), "repeats": per_word("n_repeat_words")}


class Condition(NamedTuple):
    feature: str
    above: bool
    cut: float

    def expression(self, columns: dict[str, Column]) -> Column:
        value = columns[self.feature]
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


class Rule(NamedTuple):
    """A conjunction that rejects, and how it did on the labels it met: rejected bad ones and good ones."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.cut:.6g}" for c in self.conditions)


class Cell(NamedTuple):
    """Counts of labels between thresholds: bins by feature, then bad and good ones to grow on and to prune on."""

    bins: tuple[int, ...]
    grow: tuple[int, int]
    prune: tuple[int, int]


def cut_points(labelled: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Candidate thresholds: the outer quantiles of good texts, and quantiles of bad ones. At most 6 for each feature."""
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    quantiles = [F.percentile_approx(F.when(side, F.col(n)), at, 10_000).alias(f"{n}_{k}")
                 for n in names for k, (side, at) in enumerate([(good, [0.005, 0.995]), (bad, [0.2, 0.4, 0.6, 0.8])])]
    row = labelled.agg(*quantiles).first()
    return {n: sorted({float(x) for k in range(2) for x in row[f"{n}_{k}"] or []}) for n in names}


def cells(labelled: DataFrame, cuts: dict[str, list[float]]) -> list[Cell]:
    """Counts by cell; a third of the labels, by hash of the id, is for pruning."""
    bins = [sum((F.col(n) > F.lit(c)).cast("int") for c in cuts[n]) if cuts[n] else F.lit(0) for n in cuts]
    on_prune = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    count = lambda side, quality: F.count_if(side & (F.col("quality") == quality))
    sides = [count(side, q) for side in (~on_prune, on_prune) for q in (0, 1)]
    rows = labelled.groupBy(*(b.alias(n) for n, b in zip(cuts, bins))).agg(*(s.alias(f"__{k}") for k, s in enumerate(sides))).collect()
    return [Cell(tuple(r[:-4]), (r[-4], r[-3]), (r[-2], r[-1])) for r in rows]


def learn(table: list[Cell], cuts: dict[str, list[float]], max_rules: int = 16, max_conditions: int = 3,
          precision: float = 0.95, least: int = 3) -> list[Rule]:
    """Sequential covering over counted cells. Rules come in the order in which they apply."""
    names = list(cuts)
    literals = [(f, above, k) for f, n in enumerate(names) for k in range(len(cuts[n])) for above in (False, True)]
    holds = lambda cell, lit: (cell.bins[lit[0]] > lit[2]) == lit[1]

    def total(rows: list[Cell], part: int) -> tuple[int, int]:
        return sum(c[part][0] for c in rows), sum(c[part][1] for c in rows)

    def worth(bad: int, good: int) -> float:
        return (bad - good) / (bad + good) if bad + good else -1.0

    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule, rows = [], table
        while len(rule) < max_conditions:
            bad, good = total(rows, 1)
            if not bad or not good:
                break
            now, best = math.log2(bad / (bad + good)), (0.0, None)
            for lit in literals:
                b, g = total([c for c in rows if holds(c, lit)], 1)
                gain = b * (math.log2(b / (b + g)) - now) if b else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, lit)
            if best[1] is None:
                break
            rule.append(best[1])
            rows = [c for c in rows if holds(c, best[1])]
        covered = lambda lits: [c for c in table if all(holds(c, x) for x in lits)]
        while len(rule) > 1 and worth(*total(covered(rule[:-1]), 2)) >= worth(*total(covered(rule), 2)):
            rule.pop()
        hit = covered(rule)
        bad, good = (x + y for x, y in zip(total(hit, 1), total(hit, 2)))
        if not rule or bad < least or bad < precision * (bad + good):
            break
        rules.append(Rule(tuple(Condition(names[f], above, cuts[names[f]][k]) for f, above, k in rule), bad, good))
        gone = set(hit)
        table = [c for c in table if c not in gone]
    return rules


def learned_rules(stats: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    """Rules from all labelled rows that pass the base rule. Labels other than 0 and 1 are left out; of several, the lowest counts."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    columns = features()
    seen = stats.where(~base_failed()).select("doc_id", *(c.alias(f"f_{n}") for n, c in columns.items())).join(known, "doc_id")
    seen = seen.select("doc_id", "quality", *(F.col(f"f_{n}").alias(n) for n in columns))
    cuts = cut_points(seen, list(columns))
    return learn(cells(seen, cuts), cuts, **options)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    columns = features()
    chain = F.when(F.lit(False), F.lit(0))
    for number, rule in enumerate(rules, 1):
        condition = F.lit(True)
        for c in rule.conditions:
            condition = condition & c.expression(columns)
        chain = chain.when(condition, F.lit(number))
    return chain


def judge(df: DataFrame, labels: DataFrame, text: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """Statistics, `base_failed`, `rule` (number of the learned rule that rejects) and `kept` for every row.

    `df` needs `doc_id` and the text; `carry` are its columns to keep (default: all). Every row is judged, repeated
    ones alike. Without usable labels no rule is learned, and only the base rule rejects. Statistics are computed once,
    in a written table.
    """
    own = [c for c in (df.columns if carry is None else carry) if c.lower() not in {*STATISTICS, *VERDICT}]
    stats = statistics(df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*own, "doc_id", text]))), text)
    table = materialize(stats.select(*(F.col(f"`{c}`") for c in own), *STATISTICS), "statistics")
    rules = learned_rules(table, labels, **options)
    number = F.when(~base_failed(), verdict(rules))
    return table.select(*(F.col(f"`{c}`") for c in own), *STATISTICS, base_failed().alias("base_failed"), number.alias("rule")) \
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
