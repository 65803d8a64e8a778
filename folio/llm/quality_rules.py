"""Quality rules: statistics of whole texts and a learned decision list, in DataFrame operations only.

The statistics are array expressions inside a row, so no word leaves its row: three-word windows become hashes,
the hashes are sorted with their positions, and equal neighbours mark the repeated windows.

The decision list is learned by sequential covering.  All labelled texts are summed up once into counts for
each combination of threshold bins; a rule grows one threshold condition at a time by the best gain over those
counts, is pruned from its end against a held-out third of the texts, and is kept if it is precise enough there, by
its share of bad texts and by the lower bound of that share, so that few held-out texts can do if all of them agree;
then the texts that it covers go and the next rule is grown.  Rules are emitted as one ordered CASE expression.

Defined results: a null text has no words and fails the base rule; texts without label count for nothing in
learning; with no labels, or none of one kind, the list is empty and keeps what passes the base rule; a text with
several labels counts with the smallest quality; rows that repeat an id or have none get a row each, and null ids have
no label; ties between conditions go to the last feature and threshold; a text's windows stay in its row, so a very
long text costs memory by its words; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEATED = 50
#: Features that rules may test, as shares so that they mean the same for any length.
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length", "caps_share", "bar_share", "distinct_share")
BINS = 16
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
#: Least lower bound of a rule's held-out precision, one standard deviation down.
MIN_LOWER = 0.6
MIN_COVER = 0.002


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares in FEATURES)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", BLANK), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    # windows by their first word: (hash, position), sorted so that equal windows are neighbours
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))
    rows = rows.withColumn("windows", F.array_sort(hashed))
    rows = rows.select(
        id_col, "n_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.char_length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_caps"),
        F.regexp_count("text", F.lit(r"[|]")).cast("long").alias("n_bars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        "windows",
    )
    last = F.size("windows")
    same = F.zip_with(F.slice("windows", 1, F.greatest(last - 1, F.lit(0))), F.slice("windows", 2, F.greatest(last, F.lit(1))), lambda a, b: a["h"] == b["h"])
    rows = rows.withColumn("same", same)
    # a window is repeated if it equals the one before or after it
    flags = F.zip_with(F.concat(F.array(F.lit(False)), F.col("same")), F.concat(F.col("same"), F.array(F.lit(False))), lambda a, b: a | b)
    marked = F.filter(F.zip_with("windows", flags, lambda w, f: F.when(f, w["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("marked", F.array_sort(F.when(F.exists("same", lambda x: x), marked).otherwise(F.array().cast("array<int>"))))
    gaps = F.zip_with(F.slice("marked", 1, F.greatest(F.size("marked") - 1, F.lit(0))), F.slice("marked", 2, F.greatest(F.size("marked"), F.lit(1))), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("marked") > 0, F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).otherwise(0).cast("long")
    rows = rows.withColumn("n_repeat_words", covered)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "n_words").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("word_length"), share("n_caps", "word_chars").alias("caps_share"), share("n_bars", "n_words").alias("bar_share"), share("n_distinct", "n_words").alias("distinct_share"),
    )


def base_failed(min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        found = F.lit(True)
        for c in self.conditions:
            found = found & c.column()
        return found

    def __str__(self) -> str:
        return "IF " + " AND ".join(map(str, self.conditions)) + f" THEN reject ({self.precision:.3f} of {self.covered})"


def _binned(stats: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """Bin numbers of all features: the number of thresholds that a value is above."""
    bins = [F.size(F.filter(F.array(*map(F.lit, t)), lambda x: F.col(f) > x)).alias(f) if t else F.lit(0).alias(f) for f, t in thresholds.items()]  # noqa: B023
    return stats.select("bad", "held", *bins)


def lower_bound(p: float, n: float, z: float = 1.0) -> float:
    """Wilson's lower bound of the share p / (p + n)."""
    total = p + n
    if not total:
        return 0.0
    share = p / total
    return (share + z * z / (2 * total) - z * math.sqrt(share * (1 - share) / total + z * z / (4 * total * total))) / (1 + z * z / total)


def learn_rules(labelled: DataFrame, *, features: tuple[str, ...] = FEATURES, bins: int = BINS, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION, min_lower: float = MIN_LOWER, min_cover: float = MIN_COVER) -> list[Rule]:
    """An ordered list of rules that reject, from rows with the features, ``bad`` and ``held`` (for pruning).

    Each step asks Spark for one row of counts; what comes back has one number for each feature, threshold and
    direction.  The table that is scanned holds a row for each combination of bins that occurs.
    """
    cuts = [i / bins for i in range(1, bins)] + [0.97, 0.98, 0.99, 0.995]
    points = labelled.agg(*(F.percentile_approx(f, F.array(*map(F.lit, cuts)), F.lit(10_000)).alias(f) for f in features)).first()
    thresholds = {f: sorted(set(points[f] or [])) for f in features}
    table = _binned(labelled, thresholds).groupBy("bad", "held", *features).agg(F.count(F.lit(1)).alias("n"))
    table = scratch.stored(table, "rule-bins")
    candidates = [(f, above, k) for f in features for k in range(len(thresholds[f])) for above in (True, False)]
    test = lambda c: F.col(c[0]) > c[2] if c[1] else F.col(c[0]) <= c[2]
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")

    def holds(conds):
        found = F.lit(True)
        for c in conds:
            found = found & test(c)
        return found

    rules, rest = [], table
    size = table.agg(F.sum("n")).first()[0] or 0
    while len(rules) < max_rules:
        grown: list[tuple] = []
        while len(grown) < max_conditions and candidates:
            inside = rest.filter(~F.col("held")).filter(holds(grown))
            counts = inside.agg(F.array(total(F.col("bad")), total(~F.col("bad")), *(x for c in candidates for x in (total(test(c) & F.col("bad")), total(test(c) & ~F.col("bad"))))).alias("x")).first()[0]
            p0, n0 = counts[:2]
            if p0 < 1 or n0 < 1 and grown:
                break
            before = math.log2(p0 / (p0 + n0))
            gain, best = max(((p * (math.log2(p / (p + n)) - before) if p >= min_cover * size * 0.3 and p else -1.0, c) for c, p, n in zip(candidates, counts[2::2], counts[3::2], strict=True)), key=lambda x: x[0])
            if gain <= 0:
                break
            grown.append(best)
        if not grown:
            break
        held = rest.filter("held").agg(F.array(*(x for k in range(1, len(grown) + 1) for x in (total(holds(grown[:k]) & F.col("bad")), total(holds(grown[:k]) & ~F.col("bad"))))).alias("x")).first()[0]
        scored = [(p / (p + n) if p else 0.0, lower_bound(p, n), p + n, -k) for k, (p, n) in enumerate(zip(held[::2], held[1::2], strict=True), 1)]
        good = [x for x in scored if x[0] >= min_precision and x[1] >= min_lower and x[2] >= min_cover * size * 0.3]
        if not good:
            break
        precision, _, covered, k = max(good, key=lambda x: (x[0] * x[2], x[3]))
        kept = grown[:-k]
        rules.append(Rule(tuple(Condition(f, above, thresholds[f][i]) for f, above, i in kept), precision, int(covered)))
        rest = rest.filter(~holds(kept))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for what no rule rejects: CASE WHEN first rule THEN false WHEN second ... ELSE true."""
    found = None
    for r in rules:
        found = F.when(r.column(), F.lit(False)) if found is None else found.when(r.column(), F.lit(False))
    return F.lit(True) if found is None else found.otherwise(F.lit(True))


def first_rule(rules: list[Rule]) -> Column:
    """The number of the rule that decides, from 1; null if none does."""
    found = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules, 1))):
        found = F.when(r.column(), F.lit(k)).otherwise(found)
    return found


def with_labels(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Labelled rows of ``stats`` with ``bad`` and ``held`` (a third, by a hash of the id)."""
    quality = labels.filter("quality is not null").groupBy(F.col(id_col).alias("label_id")).agg(F.min("quality").alias("label_quality"))
    joined = stats.join(quality, F.col(id_col) == F.col("label_id"))
    return joined.withColumn("bad", F.col("label_quality") == 0).withColumn("held", F.pmod(F.xxhash64(id_col), F.lit(3)) == 0).drop("label_id", "label_quality")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = scratch.stored(statistics(scratch.documents(spark, sf_dir)), "quality-statistics")
    passed = with_labels(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter(~base_failed())
    rules = learn_rules(passed)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"), first_rule(rules).alias("rule")
    )
