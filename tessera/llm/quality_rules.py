"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, votes bad or abstains. Expectation-maximisation over the counts of vote patterns estimates
how often each rule gives each vote on good and on bad documents; a document is kept if its posterior probability
of being good is at least a half, whatever single rules say, unless it fails the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, shared_dir

WINDOW = 8
#: The base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
BLANKS = r"[\x20\x09-\x0D]+"

#: The rules: name, share that is looked at, bad at or above, good at or below (between, or None: abstain). Each
#: kind of junk is seen by two or more rules, whose agreement is what the estimation lives on.
RULES = (
    ("symbol_share", "n_symbols / n_chars", 0.03, None),
    ("symbols_a_word", "n_symbols / n_words", 0.15, None),
    ("repeated_words", "n_repeat_words / n_words", 0.20, None),
    ("repeated_lines", "n_dup_lines / n_lines", 0.20, None),
    ("capitals", "n_upper / n_chars", 0.30, None),
    ("word_length", "abs(n_word_chars / n_words - 5.5)", 2.5, None),
    ("pipes", "n_pipes / n_words", 0.10, None),
    ("shouts", "n_shouts / n_words", 0.25, None),
    ("plain", "(n_symbols + n_shouts) / n_words", None, 0.01),
)
#: Prior probability of good, pseudo-counts that the estimates start from, and the end of the iteration.
PRIOR_GOOD, PSEUDO, ROUNDS, TOLERANCE = 0.85, 1.0, 200, 1e-9
#: P(vote | good), P(vote | bad) before any document is seen.
START = {1: (0.6, 0.2), 0: (0.38, 0.4), -1: (0.02, 0.4)}


def let(value: Column, body) -> Column:
    """``body`` of a column that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, keep: str) -> Column:
    """The number of characters of ``text`` outside the class whose complement is ``keep``."""
    return F.length(F.regexp_replace(text, keep, "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the array.

    Windows are compared by a 64-bit hash made of the words' hashes. Only arrays with a repeated window are
    sorted; the cost of an array is that of a sort, whatever it repeats.
    """
    n, window = F.size(words), WINDOW

    def pairs_at(hashes: Column, step: int) -> Column:
        return F.zip_with(F.slice(hashes, 1, F.size(hashes) - step), F.slice(hashes, step + 1, F.size(hashes) - step), lambda x, y: F.xxhash64(x, y))

    def windows(hashes: Column) -> Column:
        """Hashes of all windows of 8 words, from those of 2 and 4."""
        return let(let(pairs_at(hashes, 1), lambda two: pairs_at(two, 2)), lambda four: pairs_at(four, 4))

    def covered(ordered: Column) -> Column:
        marked = F.filter(
            ordered,
            lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)),
        )
        places = F.sort_array(F.transform(marked, lambda x: x["p"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"), p.alias("last")))["n"]

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    return F.when(n < window + 1, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), counted)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, in one projection of the whole text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select("doc_id", text.alias("t"), F.filter(F.split(text, BLANKS), lambda w: w != "").alias("words"))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return first.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("n_word_chars"),
        _count(F.col("t"), r"[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.length("t").cast("long").alias("n_chars"),
        _count(F.col("t"), r"[^\p{Lu}]+").alias("n_upper"),
        _count(F.col("t"), r"[^|]+").alias("n_pipes"),
        _count(F.col("t"), r"[^!]+").alias("n_shouts"),
    )


def votes(rules: tuple = RULES) -> list[Column]:
    """One column a rule: 1 good, -1 bad, 0 abstain."""
    out = []
    for name, share, bad, good in rules:
        value = F.expr("case when n_words > 0 then " + share.replace("/ n_lines", "/ greatest(n_lines, 1)") + " end")
        out.append(F.when(F.lit(False) if bad is None else value >= bad, -1).when(F.lit(False) if good is None else value <= good, 1).otherwise(0).alias(f"vote_{name}"))
    return out


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over (votes, count): the share of good and, per rule and vote, P(vote | good), P(vote | bad).

    Conditional independence of the rules given the class is assumed. Starts from mildly trusted rules; there is
    one row a pattern, of which there are at most 3 to the number of rules, whatever the number of documents.
    """
    m = len(patterns[0][0]) if patterns else len(RULES)
    share = PRIOR_GOOD
    table = [dict(START) for _ in range(m)]
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        good = [n * posterior(v, share, table) for v, n in patterns]
        sum_good = sum(good)
        new_share = (sum_good + 8 * PSEUDO) / (total + 10 * PSEUDO)
        new = []
        for r in range(m):
            row = {}
            for vote, start in START.items():
                g = sum(x for (v, _), x in zip(patterns, good, strict=True) if v[r] == vote)
                b = sum(n - x for (v, n), x in zip(patterns, good, strict=True) if v[r] == vote)
                row[vote] = ((g + 10 * PSEUDO * start[0]) / (sum_good + 10 * PSEUDO), (b + 10 * PSEUDO * start[1]) / (total - sum_good + 10 * PSEUDO))
            new.append(row)
        moved = max([abs(new_share - share)] + [abs(a - b) for x, y in zip(new, table, strict=True) for k in x for a, b in zip(x[k], y[k], strict=True)])
        share, table = new_share, new
        if moved < TOLERANCE:
            break
    return share, table


def posterior(vote: tuple[int, ...], share: float, table: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for v, t in zip(vote, table, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def quality_rules(docs: DataFrame, threshold: float = 0.5, rules: tuple = RULES) -> DataFrame:
    """Counts, base verdict and posterior quality of every whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good and kept. A
    null text is an empty one: no words, base_failed. Repeated rows each give a row; other columns are not
    carried; an empty table gives an empty one. The counts are written once to the shared folder (a few numbers a
    document); only counts of vote patterns are shuffled and reach the driver.
    """
    counts = materialise(features(docs), shared_dir(docs.sparkSession), "rule_counts")
    voted = counts.withColumns({f"vote_{r[0]}": v for r, v in zip(rules, votes(rules), strict=True)})
    names = [f"vote_{r[0]}" for r in rules]
    share, table = fit([(tuple(row[:-1]), row[-1]) for row in voted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()])
    odds = F.lit(math.log(share / (1 - share)))
    for name, t in zip(names, table, strict=True):
        weight = {v: math.log(t[v][0] / t[v][1]) for v in t}
        odds = odds + F.when(F.col(name) == 1, weight[1]).when(F.col(name) == -1, weight[-1]).otherwise(weight[0])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    good = 1 / (1 + F.exp(-odds))
    return voted.select("doc_id", "n_words", F.col("n_word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.round(good, 9).alias("p_good"), (~failed & (good >= threshold)).alias("kept"))
