"""Quality rules: an ordered list of threshold conjunctions, learned from labelled statistics.

Sequential covering: each rule is grown condition by condition on one part of the labelled rows, by the gain
of FOIL, and pruned on the other part; rows it covers leave, and the next rule is grown on the rest. The list
becomes one conditional expression; a text that no rule covers stays.

Defined cases: null and empty texts have no words and fail the base rules; labels of texts that are not
there, null labels and texts that fail the base rules are not learned from; with labels of one kind only, or
none, no rule is learned and the base rules alone decide; of contradicting labels the lower counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veil.llm.common import SPACES, keep

LABELLED_ROWS = 5000  # rules are fitted on this many labelled rows at most, drawn by hash
STATS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_upper n_digits n_marks".split()
)
STATS_TYPE = StructType([StructField(s, LongType()) for s in STATS])
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, MARKS = bytes(range(65, 91)), b"0123456789", b".,;:!?"
NO_SPACES = str.maketrans("", "", SPACES.decode())


def text_stats(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space only
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        count, covered = Counter(triples), 0
        for at, triple in enumerate(triples):
            if count[triple] > 1:
                repeated += at + 3 - max(at, covered)
                covered = at + 3
    less = lambda chars: len(raw) - len(raw.translate(None, chars))
    spaces = less(SPACES)
    return (
        len(words), len(text) - spaces, less(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines),
        len(set(words)), less(UPPER), less(DIGITS), less(MARKS),
    )


@F.arrow_udf(STATS_TYPE)
def stats(texts: pa.Array) -> pa.Array:
    rows = [text_stats(t.as_py() or "") for t in texts]
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(STATS))]
    return pa.StructArray.from_arrays(columns, STATS)


def base_failed(s: Column) -> Column:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def features(s: Column) -> dict[str, Column]:
    """What conditions compare: shares and means, which hold for texts of any length."""
    part = lambda a, b: s[a].cast("double") / F.greatest(s[b], F.lit(1)).cast("double")
    return {
        "symbol_share": part("n_symbols", "word_chars"),
        "dup_line_share": part("n_dup_lines", "n_lines"),
        "repeat_share": part("n_repeat_words", "n_words"),
        "distinct_share": part("n_distinct", "n_words"),
        "word_length": part("word_chars", "n_words"),
        "upper_share": part("n_upper", "word_chars"),
        "digit_share": part("n_digits", "word_chars"),
        "mark_share": part("n_marks", "word_chars"),
        "words_per_line": part("n_words", "n_lines"),
        "n_words": s.n_words.cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, x: dict[str, Column]) -> Column:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


Rule = list[Condition]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest FOIL gain; thresholds lie halfway between neighbouring values."""
    p, n = bad.sum(), (~bad).sum()
    now, best = np.log2(p / (p + n)), (0.0, None)
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, hits = values[order], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        below_p, below = hits[cut], cut + 1
        for above, ps, all_ in ((False, below_p, below), (True, p - below_p, p + n - below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ps > 0, ps * (np.log2(ps / all_) - now), 0.0)
            if len(gain) and gain.max() > best[0] + 1e-9:
                k = int(gain.argmax())
                best = float(gain[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 6) -> Rule:
    rule: Rule = []
    while len(rule) < most and bad.any() and not bad.all():
        _, condition = best_condition(x, bad)
        if condition is None:
            break
        rule.append(condition)
        inside = condition.holds(x)
        x, bad = {k: v[inside] for k, v in x.items()}, bad[inside]
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (p - n) / (p + n); shorter among equals."""

    def worth(part: Rule) -> float:
        hit = covers(part, x)
        return (2 * bad[hit].sum() - hit.sum()) / hit.sum() if hit.any() else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda part: (round(worth(part), 12), -len(part)))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """Rules in order. A rule counts if ``precision`` of what it covers is bad in both parts, and ``least`` rows are."""
    rules, left = [], np.ones(len(bad), bool)
    growing = np.arange(len(bad)) % 3 != 0
    pick = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
    while (bad & left & growing).sum() >= least:
        rule = grow(*pick(left & growing))
        if not rule:
            break
        rule = prune(rule, *pick(left & ~growing))
        hit = covers(rule, x) & left
        parts = [hit & growing, hit & ~growing]
        if hit.sum() < least or any(p.any() and bad[p].mean() < precision for p in parts):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality") -> list[Rule]:
    """Rules from at most ``rows`` labelled texts; only their statistics reach the driver."""
    named = labels.where(labels[label].isNotNull() & labels["doc_id"].isNotNull())
    drawn = named.groupBy("doc_id").agg(F.min(label).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    # at most ``rows`` pairs of numbers; written, so that no filter on statistics moves below the join, and that
    # they are counted once, by one Python worker a task
    joined = keep(texts.join(F.broadcast(drawn), "doc_id"), "labelled-texts")
    counted = keep(joined.select("doc_id", "good", stats("text").alias("s")), "labelled-stats").where(~base_failed(F.col("s")))
    seen = counted.select("doc_id", "good", *[c.alias(n) for n, c in features(F.col("s")).items()])
    table = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()
    bad = (table["good"].to_numpy() == 0) if len(table) else np.zeros(0, bool)
    return learn({n: table[n].to_numpy(float) for n in table.columns[2:]}, bad)


def verdict(rules: list[Rule], s: Column) -> Column:
    """The number of the first rule that covers a text, as one conditional expression; null if none does."""
    x = features(s)
    chain = None
    for number, rule in enumerate(rules):
        hit = rule[0].column(x)
        for condition in rule[1:]:
            hit = hit & condition.column(x)
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    return F.lit(None).cast("int") if chain is None else chain.otherwise(F.lit(None).cast("int"))


def judge(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, base decision, the rule that rejects and whether the text stays, for every row."""
    counted = docs.select(docs[doc_id].alias("doc_id"), stats(docs[text].cast("string")).alias("s"))
    decided = counted.select("doc_id", "s.*", base_failed(F.col("s")).alias("base_failed"), verdict(rules, F.col("s")).alias("rule"))
    return decided.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_only(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the rules keep, with all their columns and no others."""
    row = docs.select(F.struct("*").alias("row"), stats(docs[text].cast("string")).alias("s"))
    return row.where(~base_failed(F.col("s")) & verdict(rules, F.col("s")).isNull()).select("row.*")
