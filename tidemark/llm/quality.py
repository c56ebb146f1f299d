"""Quality rules: per-text statistics and a learned decision list over them. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Labelled rows that a list is fitted on, about: beyond it, those with the least hashes of their ids.
FIT_ROWS = 60_000
#: Every third id (by CRC-32) prunes and judges rules, the others grow them.
PRUNE_EVERY = 3
#: Shares of the labelled rows of either class at which thresholds are tried.
SHARES = (0.0, 0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.94, 0.97, 0.99, 0.999, 1.0)
MAX_RULES, MAX_CONDITIONS, LEAST_PRECISION = 16, 4, 0.8
#: Statistics that conditions may name.
STATS = ("n_words", "word_len", "distinct_share", "repeat_share", "symbol_share", "upper_share", "digit_share", "mark_share", "other_share", "dup_line_share", "line_words")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ``STATS``.

    Windows of three words are found again by sorting: each window's hash and place share one number, equal hashes
    become neighbours, and the few candidates are compared by their whole 64-bit hashes. A text of n words takes
    n log n steps in its own row; nothing is shuffled. Arrays used more than once are columns of their own,
    so that they aren't made anew for each element.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    rows = rows.select(
        "id",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.length("t").alias("chars"),
        F.regexp_replace("t", r"[^!-`{-~]+", "").alias("rare"),  # ASCII but lower case and spaces
    )

    def window(at: Column) -> Column:
        return F.xxhash64(F.get("words", at), F.get("words", at + 1), F.get("words", at + 2))

    def count(pattern: str) -> Column:
        return (F.length("rare") - F.length(F.regexp_replace("rare", pattern, ""))).cast("long")

    n = F.size("words")
    bits = F.length(F.bin(n))  # places take as many bits as the largest of them
    places = F.when(n > 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(places, lambda i: F.call_function("shiftleft", window(i), bits).bitwiseOR(i.cast("long")))
    rows = rows.select(
        "id",
        "words",
        n.cast("long").alias("n_words"),
        bits.alias("bits"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("chars").cast("long").alias("chars"),
        count(r"[#*$%&|<>]+").alias("n_symbols"),
        count("[A-Z]+").alias("n_upper"),
        count("[0-9]+").alias("n_digit"),
        count("[!?]+").alias("n_mark"),
        count(r"""["'(),./:;@\[\\\]^_`{}~+=-]+""").alias("n_other"),
        F.sort_array(packed).alias("packed"),
    )

    def high(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col("bits"))

    def twin(items: str, key):
        return F.filter(items, lambda x, j: (key(x) == key(F.get(items, j - 1))) | (key(x) == key(F.get(items, j + 1))))

    kept = [c for c in rows.columns if c not in ("words", "packed", "bits")]
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    rows = rows.select(*kept, F.array_sort(F.transform(twin("packed", high), lambda x: _hashed(x.bitwiseAND(low).cast("int"), window))).alias("twins"))
    rows = rows.select(*kept, F.sort_array(F.transform(twin("twins", lambda x: x["h"]), lambda x: x["at"])).alias("again"))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate("again", start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")), lambda a: a["sum"])
    rows = rows.select(*kept, covered.alias("n_repeat_words"))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return rows.select(
        "id",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        share("word_chars", "n_words").alias("word_len"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_symbols", "chars").alias("symbol_share"),
        share("n_upper", "chars").alias("upper_share"),
        share("n_digit", "chars").alias("digit_share"),
        share("n_mark", "chars").alias("mark_share"),
        share("n_other", "chars").alias("other_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_words", "n_lines").alias("line_words"),
    )


def _hashed(at: Column, window) -> Column:
    return F.struct(window(at).alias("h"), at.alias("at"))


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.stat) > self.cut if self.above else F.col(self.stat) <= self.cut

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.cut!r}"


Rule = tuple[Condition, ...]


def matches(rule: Rule) -> Column:
    return reduce(and_, (c.column() for c in rule))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a row meets (from 1), null if it meets none: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(matches(rules[k - 1]), k).otherwise(out)
    return out


def case_when(rules: list[Rule]) -> str:
    """The list as SQL."""
    arms = "".join(f" WHEN {' AND '.join(map(str, r))} THEN {k}" for k, r in enumerate(rules, 1))
    return f"CASE{arms} END" if rules else "CAST(NULL AS INT)"


def best_condition(counts: dict[tuple[str, int], tuple[int, int]], cuts: dict[str, list[float]]) -> tuple[float, Condition | None]:
    """The condition of the greatest FOIL gain, from (bad, good) rows per statistic and bin.

    Bin b of a statistic holds values above ``cuts[b - 1]`` up to ``cuts[b]``. Of neighbouring cuts with equal counts
    the middle one is taken, so that rules keep a margin; other ties go to the first statistic, and to ``<=``.
    """
    best, found = 0.0, None
    for stat, at in cuts.items():
        bins = [counts.get((stat, b), (0, 0)) for b in range(len(at) + 1)]
        bad, good = sum(b for b, _ in bins), sum(g for _, g in bins)
        if not bad or not good:
            return 0.0, None  # nothing to tell apart
        base = log2(bad / (bad + good))
        runs, p, n = [], 0, 0
        for b, cut in enumerate(at):
            p, n = p + bins[b][0], n + bins[b][1]
            if runs and runs[-1][:2] == (p, n):
                runs[-1][2].append(cut)
            else:
                runs.append((p, n, [cut]))
        for above in (False, True):
            for p, n, same in runs:
                x, y = (bad - p, good - n) if above else (p, n)
                gain = x * (log2(x / (x + y)) - base) if x else 0.0
                if gain > best + 1e-9:
                    best, found = gain, Condition(stat, above, same[len(same) // 2])
    return best, found


def pruned(rule: Rule, counts: list[tuple[int, int]]) -> tuple[Rule, tuple[int, int]]:
    """The prefix of ``rule`` with the best (bad - good) / (bad + good) on the pruning rows, the shortest of equals."""
    worth = [((p - n) / (p + n) if p + n else -1.0) for p, n in counts]
    k = worth.index(max(worth))
    return rule[: k + 1], counts[k]


def learn(labelled: DataFrame, max_rules: int = MAX_RULES) -> list[Rule]:
    """Sequential covering over ``labelled`` (columns bad: 0 or 1, prune: boolean, and the ``STATS``).

    A rule grows by the condition of greatest gain until it holds no good row of the growing part (or has
    ``MAX_CONDITIONS``), loses its last conditions as far as that helps on the pruning part, and stays if
    ``LEAST_PRECISION`` of the rows it holds there are bad. Rows it holds leave both parts before the next one
    grows. Each step is one aggregation into counts per statistic and bin; rows never come to the driver.
    """
    ends = labelled.groupBy("bad").agg(*[F.percentile(c, list(SHARES)).alias(c) for c in STATS]).collect()
    if len(ends) < 2:
        return []
    cuts = {}
    for c in STATS:
        at = sorted({x for r in ends for x in r[c]})
        cuts[c] = sorted({*at, *((a + b) / 2 for a, b in zip(at, at[1:]))})
    places = [F.struct(F.lit(c).alias("stat"), _bin(c, cuts[c]).alias("bin")) for c in STATS]
    labelled = stage(labelled.select("bad", "prune", *STATS, F.array(*places).alias("bins")))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = labelled.where(~reduce(or_, map(matches, rules))) if rules else labelled
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            part = left.where(~F.col("prune"))
            part = (part.where(matches(rule)) if rule else part).select("bad", F.explode("bins").alias("x"))
            sums = part.groupBy("x.stat", "x.bin").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
            _, found = best_condition({(r.stat, r.bin): (r.p, r.n - r.p) for r in sums}, cuts)
            if found is None:
                break
            rule = (*rule, found)
        if not rule:
            break
        held = [matches(rule[: k + 1]) for k in range(len(rule))]
        sums = left.where("prune").agg(*[F.struct(F.count_if(h & (F.col("bad") == 1)).alias("p"), F.count_if(h & (F.col("bad") == 0)).alias("n")) for h in held]).first()
        rule, (p, n) = pruned(rule, [(s.p, s.n) for s in sums])
        if not p or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule)
    return rules


def _bin(stat: str, at: list[float]) -> Column:
    """How many of ``at`` lie below the value: a binary search written as nested conditions."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(stat) <= at[mid], search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(at))


def quality_rules(
    docs: DataFrame, labels: DataFrame, least_words: int = 50, most_repeated: int = 50, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> tuple[DataFrame, list[Rule]]:
    """(rows, rules): each row's statistics, base_failed, kept and rule, and the list that was learned.

    The base rules fail texts under ``least_words`` words or with over ``most_repeated`` % of their words in repeated
    windows. The list is learned from labelled rows that pass the base rules, at most about ``FIT_ROWS`` of them (those with the
    least hashes of their ids), and judges all others: ``rule`` is the number of the first rule met (null if none; also null
    where the base rules fail), and such rows aren't kept.

    Null texts have no words and fail. An id that is labelled twice counts as low quality if one label says so; null ids
    and null labels teach nothing; without labels of both classes the list is empty. Repeated rows each give a row; an empty
    table gives none; other columns aren't read. Texts of any length are taken whole.
    """
    rows = stage(text_statistics(docs, id_col, text_col))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("quality"))
    labelled = rows.where("not base_failed").join(marks, "id")
    prune = F.crc32(F.col("id").cast("string").cast("binary")) % PRUNE_EVERY == 0
    labelled = stage(labelled.select((F.col("quality") == 0).cast("int").alias("bad"), prune.alias("prune"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("draw"), *STATS))
    share = 1_000_000 * FIT_ROWS / max(labelled.count(), 1)
    rules = learn(labelled.where(F.col("draw") < share))
    rows = rows.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).withColumnRenamed("id", id_col), rules
