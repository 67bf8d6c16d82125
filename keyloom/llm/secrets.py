"""Secret scans: known shapes of keys, and sliding-window Shannon entropy per character class.

Native: DataFrame functions only. Java's regular expressions give the matches but not their places, so that each text is
also split at its matches; the lengths of pieces and matches add up to the places.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import cut, kept_columns, let, table

#: kind, expression, group whose length counts, least length. The order of kinds breaks ties between spans.
KINDS = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WIDTH = 20
#: character class, expression for the whole candidate, bits a character from which a window counts. The first that fits holds.
CLASSES = [
    ("digits", r"^[0-9_=+/-]+$", 3.0),
    ("hex", r"^[0-9a-fA-F]+$", 3.0),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*$", 3.8),
    ("lower", r"^(?=.*[0-9])(?=.*[a-z]).*$", 3.7),
    ("upper", r"^(?=.*[0-9])(?=.*[A-Z]).*$", 3.7),
    ("letters", r"^[^0-9]+$", 4.0),  # random lower-case letters alone have about 3.7, as words have
]
#: Candidates that fit one of these are no secrets: UUIDs. None may repeat a group, as Java's matcher recurses for each turn.
ALLOWED = [r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"]
#: Each part of a path between slashes.
PATH_PART = r"^[A-Za-z_-]*[0-9]{0,4}$"
#: What documentation puts where a key would stand, in either case. No window reaches over one of these.
SAMPLES = ["placeholder", "abcdefghij", "0123456789", "example", "sample", "dummy"]
#: The characters of candidates; a window's counts are eight bits each in whole numbers of 64 bits.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Windows that one pass over a piece of a candidate looks at.
PIECE = 512
UNIT = 1 << 20


def _scaled(n: int) -> int:
    """n log2 n in whole 2 ** -20ths: sums of these are exact, and so the same in any order."""
    return round(n * math.log2(n) * UNIT) if n else 0


def most_sum(bits: float, width: int = WIDTH) -> int:
    """A window has at least these bits a character if its counts' sum of n log2 n is at most this."""
    return math.floor((math.log2(width) - bits) * width * UNIT)


def starts(lengths: Column) -> Column:
    """For each of the lengths the sum of those before it. In chunks: appending to one array copies it every time."""
    chunk = 256
    add = lambda s, x: F.struct((s["n"] + x).alias("n"), F.concat(s["out"], F.array(s["n"])).alias("out"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))

    def of(chunks: Column) -> Column:
        heads = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)), none, add)["out"]
        each = lambda heads: F.flatten(F.transform(chunks, lambda c, i: F.transform(F.aggregate(c, none, add)["out"], lambda x: x + F.get(heads, i))))
        return let(heads, each)

    n = F.size(lengths)
    return let(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda i: F.slice(lengths, i * chunk + 1, chunk)), of)


def found(text: Column, expression: str, group: int = 0) -> Column:
    """start, end, group and match of every match, in code points, end exclusive; null if there is none."""
    rule = F.lit(expression)

    def place(m: Column) -> Column:
        whole = F.transform(m, lambda x: F.char_length(x["match"]).cast("long"))
        pieces = F.transform(F.split(text, expression, -1), lambda x: F.char_length(x).cast("long"))
        # piece, match, piece, match ...: a match starts where the pieces through its own and the matches before it end
        steps = lambda w: F.zip_with(F.slice(pieces, 1, F.size(w)), w, lambda p, n: F.struct(p.alias("p"), n.alias("n")))

        def spans(s: Column) -> Column:
            begin = starts(F.transform(s, lambda x: x["p"] + x["n"]))
            return F.zip_with(F.zip_with(begin, s, lambda b, x: F.struct((b + x["p"]).alias("start"), (b + x["p"] + x["n"]).alias("end"))), m, lambda a, x: F.struct(a["start"].alias("start"), a["end"].alias("end"), x["group"].alias("group"), x["match"].alias("match")))

        return let(let(whole, steps), spans)

    both = F.zip_with(F.regexp_extract_all(text, rule, F.lit(group)), F.regexp_extract_all(text, rule, F.lit(0)), lambda g, x: F.struct(g.alias("group"), x.alias("match")))
    return F.when(text.rlike(expression), let(both, place))


def entropy_windows(candidate: Column, limit: Column) -> Column:
    """Merged runs of windows of WIDTH characters whose n log2 n sum is at most limit: start and end in the candidate.

    The counts change by the character that enters and the one that leaves, and the sum with them. A long candidate is
    passed in pieces that overlap by a window less one character, so that the work grows with its length alone.
    """
    sums = F.array(*[F.lit(_scaled(n)).cast("long") for n in range(WIDTH + 2)])
    slots = F.array(*[F.lit(max(ALPHABET.find(chr(c)), 0)) for c in range(128)])
    f = lambda n: F.get(sums, n)
    word = lambda slot: F.shiftright(slot, 3)
    bits = lambda slot: F.shiftleft(slot.bitwiseAND(7), 3)
    one = lambda slot: F.call_function("shiftleft", F.lit(1).cast("long"), bits(slot))
    count = lambda counts, slot: F.call_function("shiftright", F.get(counts, word(slot)), bits(slot)).bitwiseAND(255).cast("int")
    run = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    runs_of = "array<struct<start:int,end:int>>"
    none = F.struct(
        F.array_repeat(F.lit(0).cast("long"), (len(ALPHABET) + 7) // 8).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        run(F.lit(-1), F.lit(-1)).alias("open"),
        F.array().cast(runs_of).alias("done"),
    )

    def step(s: Column, x: Column) -> Column:
        enters, leaves, end = x["enters"], x["leaves"], x["end"]
        more = count(s["counts"], enters)
        less = count(s["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0)
        total = s["sum"] + f(more + 1) - f(more) + F.coalesce(f(less - 1) - f(less), F.lit(0).cast("long"))
        counts = F.transform(s["counts"], lambda c, k: c + F.when(k == word(enters), one(enters)).otherwise(0) - F.when(k == word(leaves), one(leaves)).otherwise(0))
        counts_in = (end >= WIDTH) & (total <= limit)
        joins = s["open"]["end"] >= end - WIDTH
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(~counts_in, s["open"]).when(joins, run(s["open"]["start"], end)).otherwise(run(end - WIDTH, end)).alias("open"),
            F.when(counts_in & ~joins, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
        )

    def of_piece(piece: Column, begin: Column) -> Column:
        steps = F.transform(piece, lambda slot, i: F.struct(slot.alias("enters"), F.get(piece, i - WIDTH).alias("leaves"), (i + 1).alias("end")))
        runs = let(F.aggregate(steps, none, step), lambda s: F.filter(F.concat(s["done"], F.array(s["open"])), lambda r: r["start"] >= 0))
        return F.transform(runs, lambda r: run(begin + r["start"], begin + r["end"]))

    def merged(runs: Column) -> Column:
        heads = F.filter(runs, lambda r, i: (i == 0) | (r["start"] > F.get(runs, i - 1)["end"]))
        tails = F.filter(runs, lambda r, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1)["start"] > r["end"]))
        return F.zip_with(heads, tails, lambda a, b: run(a["start"], b["end"]))

    def of(codes: Column) -> Column:
        begins = F.sequence(F.lit(0), F.size(codes) - WIDTH, F.lit(PIECE))
        return let(F.flatten(F.transform(begins, lambda b: let(F.slice(codes, b + 1, PIECE + WIDTH - 1), lambda piece: of_piece(piece, b)))), merged)

    codes = F.transform(F.split(candidate, ""), lambda c: F.get(slots, F.ascii(c)))
    return F.when(F.char_length(candidate) < WIDTH, F.array().cast(runs_of)).otherwise(let(codes, of))


def is_path(candidate: Column) -> Column:
    """Whether slashes part a candidate into names, each with at most four digits at its end."""
    return F.contains(candidate, F.lit("/")) & F.forall(F.split(candidate, "/"), lambda part: part.rlike(PATH_PART))


def without_samples(text: Column, samples: Sequence[str]) -> Column:
    """text with blanks in the place of each sample, so that all places stay."""
    for sample in samples:
        text = F.regexp_replace(text, "(?i)" + re.escape(sample), " " * len(sample))
    return text


def class_limit(candidate: Column, classes: Sequence[tuple[str, str, float]] = CLASSES) -> Column:
    limit = F.lit(None).cast("long")
    for _, expression, bits in reversed(classes):
        limit = F.when(candidate.rlike(expression), F.lit(most_sum(bits)).cast("long")).otherwise(limit)
    return limit


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Sequence[str] = ALLOWED, samples: Sequence[str] = SAMPLES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the struct keep of the columns listed in keep, and found: kind, start and end of each
    span, in order.

    Spans count code points, end exclusive, and go by start, then kind (assign, access, hex, entropy). Matches of the known
    shapes always stay. Spans of kind entropy are the merged windows of a long unbroken string whose entropy reaches the
    bits asked for by the string's character class, unless the string is a path or fits one of allowed. Strings end at
    the words of samples (ASCII, in either case). Null and empty texts have no spans; repeated rows get the same spans; an
    empty table gives an empty result. Texts are read whole, in time that grows with their length alone. Other columns
    are ignored unless listed in keep.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), kept_columns(keep), text.alias("text"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    long_enough = lambda least: lambda x: F.char_length(x["group"]) >= least
    of_kind = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    arrays = []
    for k, (name, expression, group, least) in enumerate(KINDS):
        # a lambda's second parameter would be the index: k and least must not look like one
        spans = F.transform(F.filter(found(F.col("text"), expression, group), long_enough(least)), of_kind(k))
        base = base.withColumn(name, F.coalesce(spans, none))
        arrays.append(F.col(name))

    # strings that reach over a sample are rare: only these texts are looked through again
    long_strings = F.when(F.col("text").rlike(CANDIDATE), without_samples(F.col("text"), samples))
    base = base.withColumn("likely", found(long_strings, CANDIDATE))
    suits = lambda x: ~is_path(x["match"]) & (~x["match"].rlike("|".join(f"(?:{a})" for a in allowed)) if allowed else F.lit(True))
    windows = lambda x: F.transform(
        let(class_limit(x["match"]), lambda limit: F.when(limit >= 0, entropy_windows(x["match"], limit)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))),
        lambda r: F.struct((x["start"] + r["start"]).alias("start"), F.lit(len(KINDS)).alias("kind"), (x["start"] + r["end"]).alias("end")),
    )
    base = base.withColumn("entropy", F.coalesce(F.flatten(F.transform(F.filter("likely", suits), windows)), none))
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("entropy"))
    spans = F.transform(F.sort_array(F.concat(*arrays, F.col("entropy"))), lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return base.select("doc_id", "keep", spans.alias("found"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = cut(scan_secrets(table(spark, sf_dir, "documents")))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id",
        *[count(k[0]) for k in KINDS],
        F.sha2(written(F.filter("found", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


def _oracle() -> str:
    """SQL for op10: the contract's own expressions, every window counted anew, runs merged by gaps and islands."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    keys = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    expressions = [f"""({keys})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "(AKIA[A-Z0-9]+)", "([0-9a-f]+)"]
    groups, blanked = [2, 1, 1], "text"
    for sample in SAMPLES:
        blanked = f"regexp_replace({blanked}, '{either(sample)}', '{' ' * len(sample)}', 'g')"
    found = lambda of, e, g, name, least: f"""
{name} AS MATERIALIZED (
  SELECT r, through - len(m) AS start, through AS "end", m FROM (
    SELECT r, m, g, sum(len(p) + len(m)) OVER (PARTITION BY r ORDER BY i) AS through FROM (
      SELECT r, unnest(ps[:len(ms)]) AS p, unnest(ms) AS m, unnest(gs) AS g, generate_subscripts(ms, 1) AS i FROM (
        SELECT r, regexp_split_to_array({of}, '{e}') AS ps, regexp_extract_all({of}, '{e}', 0) AS ms, regexp_extract_all({of}, '{e}', {g}) AS gs FROM docs)))
  WHERE len(g) >= {least})"""  # noqa: E731
    base = [found("text", e, g, name, least) for e, g, (name, _, _, least) in zip(expressions, groups, KINDS, strict=True)]
    has = lambda e: f"regexp_matches(m, '{e}')"
    bits = {name: most_sum(b) for name, _, b in CLASSES}
    limit = f"""CASE WHEN NOT {has('[A-Za-z]')} THEN {bits['digits']} WHEN NOT {has('[^0-9a-fA-F]')} THEN {bits['hex']}
              WHEN NOT {has('[0-9]')} THEN {bits['letters']} WHEN {has('[a-z]')} AND {has('[A-Z]')} THEN {bits['mixed']}
              WHEN {has('[a-z]')} THEN {bits['lower']} ELSE {bits['upper']} END"""
    uuid = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    sums = [_scaled(n) for n in range(WIDTH + 1)]
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),{','.join(base)},
blanked AS MATERIALIZED (SELECT r, {blanked} AS blank FROM docs WHERE regexp_matches(text, '{CANDIDATE}')),{found('blank', f'({CANDIDATE})', 1, 'candidates', WIDTH).replace('FROM docs', 'FROM blanked')},
suited AS MATERIALIZED (
  SELECT r, start, m, {limit} AS most FROM candidates
  WHERE NOT regexp_matches(m, '{uuid}')
    AND NOT (contains(m, '/') AND len(list_filter(string_split(m, '/'), lambda x: NOT regexp_matches(x, '{PATH_PART}'))) = 0)),
windows AS MATERIALIZED (
  SELECT r, start AS of, start + i AS start, most, substr(m, i + 1, {WIDTH}) AS w FROM (
    SELECT r, start, m, most, unnest(range(0, len(m) - {WIDTH - 1})) AS i FROM suited)),
counting AS (
  SELECT r, of, start FROM windows
  WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: {sums}[len(w) - len(replace(w, c, '')) + 1])) <= most),
islands AS (
  SELECT r, of, start, sum(new) OVER (PARTITION BY r, of ORDER BY start) AS island FROM (
    SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY r, of ORDER BY start) + {WIDTH} THEN 0 ELSE 1 END AS new FROM counting)),
spans AS (
  SELECT r, 0 AS k, 'assign' AS kind, start, "end" FROM assign UNION ALL SELECT r, 1, 'access', start, "end" FROM access
  UNION ALL SELECT r, 2, 'hex', start, "end" FROM hex
  UNION ALL SELECT r, 3, 'entropy', min(start), max(start) + {WIDTH} FROM islands GROUP BY r, of, island),
written AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY start, k, "end") FILTER (k < 3) AS base,
         string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY start, k, "end") AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN written USING (r)
"""


OP10_SQL = _oracle()
