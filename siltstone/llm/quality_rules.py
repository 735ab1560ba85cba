"""Quality rules: a decision list learned by sequential covering, all in DataFrame expressions.

Measures of every text are built-in functions.  Labelled documents are binned
at quantiles; each literal is chosen from sums over (feature, bin, label,
fold), which Spark computes over all labelled rows and which have a fixed
size.  A rule grows literal by literal on two thirds of the labelled rows by
information gain and is pruned on the rest; rows that it covers leave, and the
next rule follows.  The list becomes one ordered CASE expression.

Edge cases: a null text has no words, fails the base rules and is not kept;
an empty table gives no rows; repeated rows are judged alike; without labels
of both kinds the list is empty and only the base rules hold; labels that
repeat a doc_id count once (the lowest quality); other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import settle

WHITE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = r"[#*$%&|<>]"
BINS = 16
MAX_RULES = 10
MAX_LITERALS = 4
MIN_PRECISION = 0.8
MIN_COVER = 12
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, carried: list[Column] | None = None) -> DataFrame:
    """doc_id and the measures of each whole text of ``docs`` (doc_id, text), with the columns ``carried``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [f"_carried{i}" for i in range(len(carried or []))]
    key = ("doc_id", *more)
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for c, n in zip(carried or [], more, strict=True)], text.alias("text"))
    at = at.withColumn("w", F.array_remove(F.split("text", WHITE, -1), ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \t\x0B\f\r]"))
    count = lambda chars: F.regexp_count("text", F.lit(chars)).cast("long")
    at = at.select(
        *key,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count("[A-Z]").alias("n_upper"),
        count("[0-9]").alias("n_digits"),
        count("!").alias("n_cries"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("v"),
    )
    # one hash for each window of three words
    hashes = F.transform(F.slice("v", 1, F.greatest(F.size("v") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("v", i + 1), F.get("v", i + 2)))
    counts = ("n_words", "word_chars", "n_symbols", "n_upper", "n_digits", "n_cries")
    at = at.select(*key, *counts, "lines", hashes.alias("h"))
    pairs = F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    at = at.select(
        *key,
        *counts,
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(pairs)).alias("p"),
    )
    same = lambda x, i: F.coalesce(F.get("p", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("p", lambda x, i: same(x, i + 1) | same(x, i - 1))
    at = at.withColumn("q", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("q", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("q", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return at.select(*key, *counts, "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def features() -> dict[str, Column]:
    """What thresholds are put on, by name: ratios of the measures."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "repeat_share": per_word("n_repeat_words"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "digit_share": F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)),
        "cries_per_word": per_word("n_cries"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    bin: int
    above: bool
    threshold: float

    def on_bins(self) -> Column:
        at = F.col(f"bin_{self.feature}")
        return at >= self.bin if self.above else at < self.bin

    def on_values(self, values: dict[str, Column]) -> Column:
        at = values[self.feature]
        return at >= self.threshold if self.above else at < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


def _every(literals: list[Literal], of) -> Column:
    out = F.lit(True)
    for x in literals:
        out = out & of(x)
    return out


def _sums(rows: DataFrame, names: list[str]) -> dict[tuple[str, int], list[float]]:
    """By feature and bin: labelled bad and good rows for growing, then for pruning."""
    long = rows.select("bad", "grow", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"bin_{n}").alias("b")) for n in names])).alias("x"))
    want = lambda grow, bad: F.sum(F.when((F.col("grow") == grow) & (F.col("bad") == bad), 1).otherwise(0))
    found = long.groupBy("x.f", "x.b").agg(want(True, 1), want(True, 0), want(False, 1), want(False, 0)).collect()  # at most features x BINS rows
    return {(r[0], r[1]): [float(v) for v in r[2:]] for r in found}


def _best(sums: dict, cuts: dict[str, list[float]], base: tuple[float, float]) -> Literal | None:
    """The literal with the most information gain for the bad rows that it keeps."""
    p0, n0 = base
    best, found = 1e-9, None
    for f, own in cuts.items():
        for b, threshold in enumerate(own, 1):
            for above in (True, False):
                kept = [v for (g, k), v in sums.items() if g == f and (k >= b) == above]
                p, n = sum(v[0] for v in kept), sum(v[1] for v in kept)
                if p < MIN_COVER / 2 or p + n == p0 + n0:
                    continue
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                if gain > best:
                    best, found = gain, Literal(f, b, above, threshold)
    return found


def learn(measured: DataFrame, labels: DataFrame) -> list[list[Literal]]:
    """The ordered rules that reject, from ``labels`` (doc_id, quality) of rows of measures()."""
    values = features()
    names = list(values)
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = settle(
        measured.join(judged, "doc_id").where(~base_failed()).select((F.col("quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *[v.alias(n) for n, v in values.items()]), "labelled_measures"
    )
    at = [i / BINS for i in range(1, BINS)]
    quantiles = rows.groupBy().agg(*[F.percentile_approx(n, at, 2000).alias(n) for n in names], *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(n)), at, 2000).alias(f"bad_{n}") for n in names], F.sum("bad"), F.count("bad")).first()
    bad, total = quantiles[-2] or 0, quantiles[-1] or 0
    if not bad or bad == total:
        return []
    cuts = {n: sorted({*quantiles[n], *quantiles[f"bad_{n}"]}) for n in names}
    binned = rows.select("bad", "grow", *[sum([(F.col(n) >= c).cast("int") for c in cuts[n]], F.lit(0)).alias(f"bin_{n}") for n in names])
    binned = settle(binned, "labelled_bins")
    rules: list[list[Literal]] = []
    left = F.lit(True)
    while len(rules) < MAX_RULES:
        rule: list[Literal] = []
        trail: list[tuple[float, float]] = []  # bad and good rows for pruning under each prefix of the rule
        while True:
            sums = _sums(binned.where(left & _every(rule, Literal.on_bins)), names)
            own = [v for (f, _), v in sums.items() if f == names[0]]
            p, n, pp, pn = (sum(v[i] for v in own) for i in range(4))
            trail.append((pp, pn))
            if not n or not p or len(rule) == MAX_LITERALS:
                break
            literal = _best(sums, cuts, (p, n))
            if literal is None:
                break
            rule.append(literal)
        worth = [(pp - pn) / (pp + pn) if pp + pn else -1.0 for pp, pn in trail]
        length = max(range(1, len(trail)), key=lambda i: (worth[i], -i), default=0)
        if not length or sum(trail[length]) < MIN_COVER / 3 or (worth[length] + 1) / 2 < MIN_PRECISION:
            break
        rules.append(rule[:length])
        left = left & ~_every(rules[-1], Literal.on_bins)
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[list[Literal]]) -> Column:
    """The number of the first rule that rejects a row of measures(), from 1; 0 if none does."""
    values = features()
    out = F
    for i, rule in enumerate(rules, 1):
        out = out.when(_every(rule, lambda x: x.on_values(values)), F.lit(i))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures, base_failed, rule and kept of each row of ``docs``."""
    measured = settle(measures(docs), "measures")
    rules = learn(measured, labels)
    return measured.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & (verdict(rules) == 0)).alias("kept"), verdict(rules).alias("rule"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; no row is shuffled."""
    # measured once: the rows wait in the shared folder until the rules are known
    whole = settle(measures(docs, [F.struct(*[F.col(c) for c in docs.columns])]), "measured_documents")
    rules = learn(whole.drop("_carried0"), labels)
    return whole.where(~base_failed() & (verdict(rules) == 0)).select(*[F.col("_carried0")[c].alias(c) for c in docs.columns])
