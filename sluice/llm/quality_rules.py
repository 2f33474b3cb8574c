"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote
patterns estimates how each rule votes on good and on bad documents; the posterior probability
of good replaces "all rules must pass". The patterns are at most 3^(number of rules) rows, whatever the
corpus, so that their counts are all that reaches the driver.

Rules abstain where they cannot tell. No two look at one signal alone, and none repeats the base. Null text is empty. Documents
without words fail the base; texts of any length are read whole. Repeated rows count each and fare alike, with or without doc_id. A
posterior of just the threshold keeps. An empty table gives no rows and the prior. Other columns, whatever their
names, are ignored by `judge` and kept by `filtered`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import by_content, durable

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CLOSING = ".!?:;\"')]»”。！？"
#: Words without letter or digit, and three of one sign in a row.
WORDLESS, RUNS = r"(?<!\S)[^\p{L}\p{N}\s]++(?!\S)", r"([#*$%&|<>=~_^!?.-])\1\1"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
KEEP_AT = 0.5
ROUNDS = 60
#: Before any vote is seen: how often a rule that votes is taken to vote bad, on good and on bad documents, and as how many
#: votes each belief counts against those that are seen.
FALSE_ALARMS, ALARMS = (0.005, 100), (0.3, 20)
SHARE_GOOD = 0.9


def lacking(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def features(documents: DataFrame) -> DataFrame:
    """Base counts and what the rules look at; one row per document. Nothing is shuffled."""
    text = F.col("_t")
    out = documents.select("*", F.coalesce("text", F.lit("")).alias("_t"))
    bare = F.btrim(text, F.lit(SPACES))
    out = out.select(
        "*",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_l"),
    )
    n = F.size("_w")
    out = out.select("*", F.when(n >= 3, F.transform(F.slice(F.col("_w"), 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    out = out.select("*", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    twice = F.flatten(F.filter(F.zip_with(F.slice("_s", 1, F.size("_s") - 1), F.slice("_s", F.lit(2), F.size("_s") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    out = out.select("*", F.sort_array(F.array_distinct(twice)).alias("_p"))
    covered = F.aggregate(F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    length = F.length(text)
    return out.select(
        *documents.columns,
        n.cast("bigint").alias("n_words"),
        lacking(text, SPACES).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("_l").cast("bigint").alias("n_lines"),
        F.size(F.filter("_l", lambda x: F.instr(F.lit(CLOSING), F.right(F.btrim(x, F.lit(SPACES)), F.lit(1))) > 0)).cast("bigint").alias("n_closed_lines"),
        (length - lacking(text, UPPER)).cast("bigint").alias("n_upper"),
        F.regexp_count(text, F.lit("[!?]")).cast("bigint").alias("n_shouts"),
        F.size(F.array_distinct("_w")).cast("bigint").alias("n_distinct"),
        F.regexp_count(text, F.lit(WORDLESS)).cast("bigint").alias("n_wordless"),
        F.regexp_count(text, F.lit(RUNS)).cast("bigint").alias("n_runs"),
    )


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def rules() -> dict[str, Column]:
    c = F.col
    return {
        "v_symbols": vote(20 * c("n_symbols") > c("word_chars"), 200 * c("n_symbols") <= c("word_chars")),
        "v_wordless": vote(10 * c("n_wordless") > c("n_words"), 50 * c("n_wordless") <= c("n_words")),
        "v_runs": vote(20 * c("n_runs") > c("n_words"), 200 * c("n_runs") <= c("n_words")),
        "v_open_lines": vote((2 * c("n_closed_lines") < c("n_lines")) & (c("n_lines") >= 3), 5 * c("n_closed_lines") >= 4 * c("n_lines")),
        "v_repeats": vote(3 * c("n_repeat_words") > c("n_words"), 20 * c("n_repeat_words") <= c("n_words")),
        "v_variety": vote((c("n_distinct") * c("n_distinct") < 4 * c("n_words")) & (c("n_words") >= 20), c("n_distinct") * c("n_distinct") >= 16 * c("n_words")),
        "v_lines": vote((c("n_dup_lines") >= 3) & (3 * c("n_dup_lines") > c("n_lines")), c("n_dup_lines") == 0),
        "v_upper": vote(3 * c("n_upper") > c("word_chars"), 10 * c("n_upper") <= c("word_chars")),
        "v_shouts": vote(5 * c("n_shouts") > c("n_words"), 50 * c("n_shouts") <= c("n_words")),
        "v_word_length": vote((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")), c("word_chars").between(3 * c("n_words"), 9 * c("n_words"))),
    }


def votes(documents: DataFrame) -> DataFrame:
    return features(documents).select("*", *(v.alias(k) for k, v in rules().items()))


def pattern_counts(voted: DataFrame, names: list[str]) -> dict[tuple[int, ...], int]:
    """Documents by vote pattern: at most 3^len(names) rows."""
    return {tuple(r[x] for x in names): r["n"] for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}


def fit(counts: dict[tuple[int, ...], int], n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Log odds of good, and for each rule the log ratio of its votes' probabilities on good and bad documents.

    Rules are taken to abstain as often on either kind, so an abstention says nothing.
    """
    total = sum(counts.values())
    share, rates = SHARE_GOOD, ([FALSE_ALARMS[0]] * n_rules, [ALARMS[0]] * n_rules)
    for _ in range(rounds):
        ratios = [{1: math.log((1 - f) / (1 - a)), -1: math.log(f / a), 0: 0.0} for f, a in zip(*rates)]
        sums = [[(rate * weight, weight) for _ in range(n_rules)] for rate, weight in (FALSE_ALARMS, ALARMS)]
        good = 0.0
        for pattern, n in counts.items():
            odds = math.log(share / (1 - share)) + sum(ratio[v] for ratio, v in zip(ratios, pattern))
            q = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good += n * q
            for kind, m in enumerate((n * q, n * (1 - q))):
                for j, v in enumerate(pattern):
                    if v:
                        x, y = sums[kind][j]
                        sums[kind][j] = (x + m * (v < 0), y + m)
        rates = tuple([x / y for x, y in rows] for rows in sums)
        share = min(0.999, max(0.5, (good + 9) / (total + 10)))
    return math.log(share / (1 - share)), [{1: math.log((1 - f) / (1 - a)), -1: math.log(f / a), 0: 0.0} for f, a in zip(*rates)]


def posterior(names: list[str], prior: float, ratios: list[dict[int, float]]) -> Column:
    odds = F.lit(prior)
    for name, ratio in zip(names, ratios):
        odds = odds + F.when(F.col(name) == 1, ratio[1]).when(F.col(name) == -1, ratio[-1]).otherwise(ratio[0])
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(documents: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, quality (posterior) and the votes."""
    voted = durable(votes(documents.select("doc_id", "text")).drop("text"))
    names = list(rules())
    prior, ratios = fit(pattern_counts(voted, names), len(names))
    out = voted.withColumn("base_failed", base_failed()).withColumn("quality", posterior(names, prior, ratios))
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("quality") >= keep_at)).alias("kept"), "quality", *names)


def filtered(documents: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that are kept, with their columns. The rules run once; what they reject is told by doc_id and text."""
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    names = list(rules())
    voted = durable(votes(rows).select("doc_id", "h", base_failed().alias("base_failed"), *names))
    prior, ratios = fit(pattern_counts(voted, names), len(names))
    gone = voted.filter(F.col("base_failed") | (posterior(names, prior, ratios) < keep_at))
    return by_content(documents, gone, "left_anti")
