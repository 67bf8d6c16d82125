"""The n-gram Jaccard join and connected components against plain Python."""

import random
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import hashing, ngram_join
from keyloom.llm.components import components


def plain_sets(t):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(table)) if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_components(sets):
    """ids to least linked ids."""
    ids = list(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check(df, texts, **options):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, **options).collect()}
    sets = {i: plain_sets(t) for i, t in texts}
    want = plain_components(sets)
    assert out == {i: (len(sets[i]), want[i]) for i in sets}


def test_documents(docs, rows):
    check(docs, [(i, t) for i, t, *_ in rows])


def family(rng, words, n_families, size, length):
    """Families of near copies of near copies, so that links form chains."""
    texts = []
    for _ in range(n_families):
        t = [rng.choice(words) for _ in range(length)]
        for _ in range(size):
            t = list(rng.choice(texts[-3:]) if rng.random() < 0.5 and texts[-3:] and len(texts[-1]) == length else t)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(length)] = rng.choice(words)
            texts.append(t)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


SMALL = ngram_join.Sizes(small_run=8, frequent=3, window=500, flush=300, block=400)


@pytest.mark.parametrize(
    "sizes",
    [
        SMALL,
        replace(SMALL, task_sets=3),
        replace(SMALL, task_sets=3, hot=20, rounds=1, dense=0, one_step=2),  # hot columns spread, two steps, parted by next columns
        replace(SMALL, task_sets=3, rounds=0, dense=1, levels=3, pivots=1, hot=12),
        replace(SMALL, task_entries=50, rounds=0, most_frequent=5),
    ],
)
def test_large_families_and_frequent_columns(spark, sizes):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = family(rng, words, 3, 40, 60)
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(2, 30))) for _ in range(60)]
    texts += [f"{rng.choice(words)} to our nice shop of fine {rng.choice(words[:3])}" for _ in range(40)]  # three or four shingles
    texts += [f"one two three four five six{' seven' * (i % 2)}{' eight' * (i % 3)} w{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check(df, list(enumerate(texts)), sizes=sizes)


def test_places_of_a_run_are_those_of_one_column(spark, monkeypatch):
    """Near copies that link only through columns of the same classes in two blocks, whose rows meet in any order."""
    rng = random.Random(12)
    families = []
    while len(families) < 2:
        t = " ".join(f"w{rng.randrange(10_000)}" for _ in range(23))
        first = (ngram_join.shingles(t)[:5] % 2).tolist()  # the block of each column that is dealt, in order
        if len(set(first[:3])) == 1 and len(set(first)) == 2:  # one block's first column is three places after the other's
            families.append(t)
    sizes = ngram_join.Sizes(task_sets=3)
    texts = [f"{t} end{k}" for t in families for k in range(sizes.small_run + 2)]
    sizes = replace(sizes, block=len(texts) * 20 // 2)  # two blocks
    cut = ngram_join.cut
    mixed = lambda df: df.repartition(1).sortWithinPartitions(F.xxhash64("a", "place")) if "run" in df.columns and "overlap" in df.columns else df
    monkeypatch.setattr(ngram_join, "cut", lambda df: cut(mixed(df)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check(df, list(enumerate(texts)), sizes=sizes)


@pytest.mark.parametrize("hot", [200, 1 << 40])
def test_many_unlike_sets_of_one_column_make_few_pairs(spark, monkeypatch, hot):
    """Sets that have three columns in common, of which one is dealt, and that link with one set alone."""
    n = 20_000
    texts = [f"w{i} to our nice little shop of things" for i in range(n)] + ["to our nice little shop of things"]
    made = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, sets: (made.append(pairs.count()), verified(pairs, sets))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = ngram_join.jaccard_components(df, sizes=ngram_join.Sizes(hot=hot, block=100_000, window=50_000, rounds=1)).collect()
    assert {r["component_id"] for r in out} == {0}  # through the short one
    assert sum(made) <= 5 * n


def test_words_of_one_polynomial_stay_apart(spark):
    """The Thue-Morse word and its complement agree in every polynomial hash modulo 2 ** 64."""
    w = "a"
    for _ in range(11):
        w += w.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, w), (2, w.translate(str.maketrans("ab", "ba"))), (3, w)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_order_of_columns_does_not_matter(docs, rows):
    check(docs, [(i, t) for i, t, *_ in rows], sizes=ngram_join.Sizes(most_frequent=0))


def test_words_of_many_texts_at_once(monkeypatch):
    """Equal words have equal hashes and others do not, wherever texts and pieces begin; null and blank texts have none."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abÉ\u2003\u0000z", k=rng.choice([1, 1, 2, 7, 8, 9, 15, 16, 17, 40, 64, 65, 90])))
    texts = ["".join(rng.choice([" ", "\t", "\n\x0b\x0c\r", " "]) + word() for _ in range(rng.randint(0, 30))).strip(rng.choice(["", " \t"])) for _ in range(60)] + ["", " ", "a" * 500, "ab", "AB"]
    rule = re.compile(r"[^\x20\x09-\x0D]+")
    of = {}
    for piece in (64, 4_000_000):
        monkeypatch.setattr(hashing, "PIECE", piece)
        for lower in (False, True):
            got = [h[a:b].tolist() for h, bounds in hashing.hashed_texts(pa.array([None, *texts])[0:], lower) for a, b in zip(bounds[:-1], bounds[1:])]
            assert got[0] == [] and len(got) == len(texts) + 1
            for t, h in zip(texts, got[1:], strict=True):
                w = rule.findall(t.translate({c: c + 32 for c in range(65, 91)}) if lower else t)
                assert len(w) == len(h)
                for x, y in zip(w, h, strict=True):
                    assert of.setdefault(x, y) == y
    assert len(set(of.values())) == len(of) > 500
    assert list(hashing.hashed_texts(pa.array([], pa.string()))) == [] and len(hashing.word_hashes("")) == 0


def test_edges(spark, nothing, clashing):
    assert ngram_join.jaccard_components(nothing).count() == 0
    out = ngram_join.jaccard_components(clashing).collect()
    assert len(out) == 45 and sum(r["doc_id"] is None for r in out) == 2
    long = " ".join(f"w{i % 50_000}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, None), (4, " "), (5, "A b"), (6, "a B"), (7, "b a")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()} == {1: (50_000, 1), 2: (50_001, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (1, 7)}


def test_shingles_are_those_of_words():
    t = "The quick\tbrown fox\n jumps OVER the lazy dog the quick brown fox jumps"
    assert len(ngram_join.shingles(t)) == len(plain_sets(t))
    assert np.array_equal(ngram_join.shingles(t.upper()), ngram_join.shingles(t.lower()))
    assert len({ngram_join.shingles(x).tobytes() for x in ("a b", "b a", "ab", "a  b", "a b c", "é b")}) == 5


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)] + [(5, 5), (None, 3), (7, None)]
    rng.shuffle(links)
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {i: find(i) for i in root if find(i) != i}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
