"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far to trust each, a posterior decides.

Native: DataFrame functions only. The driver sees nothing but the counts of vote patterns, at most 3 ** len(RULES) rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import cut, kept_columns, let, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: name, SQL that is true for a vote of bad, SQL that is true for a vote of good; else the rule abstains. 20 * a > b and
#: the like keep to integers, so that every engine decides alike.
RULES = [
    ("symbols", "10 * n_symbols > 3 * n_words", "20 * n_symbols <= n_words"),
    ("exclamation", "10 * n_bangs > 3 * n_words", "20 * n_bangs <= n_words"),
    ("word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words", "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines > 1"),
    ("repeated_words", "10 * n_repeat_words > n_words", "n_repeat_words = 0 and n_words >= 50"),
    ("function_words", "n_words >= 50 and 100 * n_short < 5 * n_words", "n_words >= 50 and 10 * n_short >= n_words"),
]

#: Starting point: P(bad vote | good), P(good vote | good), P(bad vote | bad), P(good vote | bad) of every rule, and P(good).
START = (0.02, 0.60, 0.50, 0.20)
PRIOR = 0.85
ROUNDS = 20
#: A bad vote on a good text stays rare and a good vote on a bad text stays possible, whatever the counts say.
MOST_FALSE_ALARMS = 0.05
LEAST, MOST = 0.01, 0.98


def repeated_words(w: Column) -> Column:
    """Words of the array w inside 5-word windows that occur twice or more in it.

    Hashes of the windows only rule out texts without any repeat; the windows themselves decide the rest.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(sorted_windows: Column) -> Column:
        again = F.filter(sorted_windows, lambda x, i: (x["w"] == F.get(sorted_windows, i - 1)["w"]) | (x["w"] == F.get(sorted_windows, i + 1)["w"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        new = lambda p: F.aggregate(
            p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last"))
        )["n"]
        return let(places, new)

    exact = let(F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i")))), covered)
    return F.when(n < 2 * WINDOW - 4, 0).when(F.size(F.array_distinct(hashes)) == n - (WINDOW - 1), 0).otherwise(exact)


def count_of(text: Column, characters: str) -> Column:
    """Occurrences in text of the given one-byte characters."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))) for c in characters), F.lit(0))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the struct keep of the columns to be kept, and what the rules look at, all as long."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # one column a step: each is used several times by the next, and so is not computed again
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(F.col(id_col).alias("doc_id"), kept_columns(keep), text.alias("text"), words(text).alias("w"), lines.alias("lines"))
    return split.select(
        "doc_id",
        "keep",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        count_of(F.col("text"), "!").cast("long").alias("n_bangs"),
        F.regexp_count(F.col("text"), F.lit(r"(?<![^\x20\x09-\x0D])[a-z]{1,4}(?![^\x20\x09-\x0D])")).cast("long").alias("n_short"),
    )


def _settled(df: DataFrame) -> DataFrame:
    """df, whose columns a filter above will not compute again: it sees what a generator returns."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("x")).select("x.*")


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float, float, float]]]:
    """EM over counts of vote patterns: P(good), and for each rule its four vote probabilities."""
    n_rules = len(RULES)
    prior, rules = PRIOR, [START] * n_rules
    total = sum(n for _, n in patterns)
    if not total:
        return prior, rules
    for _ in range(ROUNDS):
        weights = [(votes, n, posterior(votes, prior, rules)) for votes, n in patterns]
        good = sum(n * p for _, n, p in weights)
        bad = total - good
        prior = min(max(good / total, 0.5), MOST)
        new = []
        for j in range(n_rules):
            share = lambda vote, side, whole: sum(n * (p if side else 1 - p) for votes, n, p in weights if votes[j] == vote) / max(whole, 1e-9)  # noqa: B023,E731
            clamp = lambda x, most=MOST: min(max(x, LEAST), most)
            new.append((clamp(share(-1, 1, good), MOST_FALSE_ALARMS), clamp(share(1, 1, good)), clamp(share(-1, 0, bad)), clamp(share(1, 0, bad))))
        rules = new
    return prior, rules


def log_odds(vote: int, rule: tuple[float, float, float, float]) -> float:
    """What a vote adds to the log odds of good."""
    bad_good, good_good, bad_bad, good_bad = rule
    if vote < 0:
        return math.log(bad_good / bad_bad)
    if vote > 0:
        return math.log(good_good / good_bad)
    return math.log(max(1 - bad_good - good_good, LEAST) / max(1 - bad_bad - good_bad, LEAST))


def posterior(votes: Sequence[int], prior: float, rules: Sequence[tuple[float, float, float, float]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(log_odds(v, r) for v, r in zip(votes, rules, strict=True))
    return 1 / (1 + math.exp(-odds))


def votes() -> list[Column]:
    return [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(f"vote_{name}") for name, bad, good in RULES]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), only_kept: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, the struct keep of the columns listed in keep, the statistics, base_failed, quality
    (a posterior) and kept.

    A text fails outright on base_failed. For the rest each rule of RULES votes good, bad or abstains; EM over the
    counts of vote patterns of all rows fits each rule's error rates, and kept says that the posterior probability of
    good is at least one half. Null and blank texts have no words, and fail; repeated rows are judged alike; an empty
    table gives an empty result. Very long texts are read whole. Other columns are ignored unless listed in keep. only_kept
    gives the rows that are kept alone; the rules are fitted on the same rows either way.
    """
    stats = statistics(docs, id_col, text_col, keep)
    # the statistics take far longer than to write them and what is kept
    stats = cut(_settled(stats).filter(f"not ({BASE_FAILED})") if only_kept else stats)
    names = [f"vote_{name}" for name, _, _ in RULES]
    voted = stats.select("*", F.expr(BASE_FAILED).alias("base_failed"), *votes())
    counts = voted.filter(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** 6 rows
    prior, rules = estimate(sorted((tuple(r[x] for x in names), r["n"]) for r in counts))
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, rule in zip(names, rules, strict=True):
        odds = odds + F.when(F.col(name) < 0, log_odds(-1, rule)).when(F.col(name) > 0, log_odds(1, rule)).otherwise(log_odds(0, rule))
    scored = voted.withColumn("quality", 1 / (1 + F.exp(-odds)))
    scored = scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop(*names)
    return scored.filter("kept") if only_kept else scored


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(table(spark, sf_dir, "documents")).select(*columns)


def _sql() -> str:
    names = [f"vote_{name}" for name, _, _ in RULES]
    vote = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS vote_{name}" for name, bad, good in RULES)

    def odds(row: str) -> str:
        parts = [f"ln({row}.prior / (1 - {row}.prior))"]
        for x in names:
            p = [f"{row}.{x}_{k}" for k in ("bg", "gg", "bb", "gb")]
            parts.append(f"CASE WHEN v.{x} < 0 THEN ln({p[0]} / {p[2]}) WHEN v.{x} > 0 THEN ln({p[1]} / {p[3]}) ELSE ln(greatest(1 - {p[0]} - {p[1]}, {LEAST}) / greatest(1 - {p[2]} - {p[3]}, {LEAST})) END")
        return " + ".join(parts)

    start = ", ".join([f"{PRIOR}::DOUBLE AS prior", *(f"{v}::DOUBLE AS {x}_{k}" for x in names for k, v in zip(("bg", "gg", "bb", "gb"), START, strict=True))])
    steps = []
    for i in range(ROUNDS):
        sums = ", ".join(
            f"least(greatest(sum(CASE WHEN {x} = {v} THEN n * {p} ELSE 0 END) / greatest(sum(n * {p}), 1e-9), {LEAST}), {most}) AS {x}_{k}"
            for x in names
            for k, v, p, most in (("bg", -1, "p", MOST_FALSE_ALARMS), ("gg", 1, "p", MOST), ("bb", -1, "(1 - p)", MOST), ("gb", 1, "(1 - p)", MOST))
        )
        steps.append(f"em{i + 1} AS MATERIALIZED (SELECT least(greatest(sum(n * p) / sum(n), 0.5), {MOST}) AS prior, {sums} FROM (SELECT v.*, 1 / (1 + exp(-({odds('e')}))) AS p FROM patterns v, em{i} e))")
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
numbered AS (SELECT *, row_number() OVER () AS rid FROM split),
windows AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM numbered WHERE len(w) >= 5)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(5) AS r(k) GROUP BY rid),
stats AS MATERIALIZED (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_bangs,
         len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]{{1,4}}')))::BIGINT AS n_short
  FROM numbered d LEFT JOIN covered c USING (rid)),
voted AS MATERIALIZED (SELECT *, ({BASE_FAILED}) AS base_failed, {vote} FROM stats),
patterns AS MATERIALIZED (SELECT {", ".join(names)}, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY ALL),
em0 AS (SELECT {start}),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({odds('e')}))) >= 0.5 AS kept
FROM voted v, em{ROUNDS} e
"""


OP4_SQL = _sql()
