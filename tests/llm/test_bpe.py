"""BPE against the tokenizers library and plain merging."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = bpe.vocabulary()
    with open(path, encoding="utf-8") as f:
        return bpe.Encoder(bpe.Automaton(f.read())), tokenizers.Tokenizer.from_file(path)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_bpe_equals_the_library(pair):
    encoder, library = pair
    rng = random.Random(1)
    kinds = [
        lambda: "".join(rng.choice("abehitn rsou'") for _ in range(rng.randint(0, 24))),
        lambda: "".join(rng.choice("a!=-*_ .\n\t") for _ in range(rng.randint(0, 40))),
        lambda: "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x4E00, 0x4FFF), 10, 9, 0x3000, 0x1F600, 0x85, 0x1C])) for _ in range(rng.randint(0, 20))),
        lambda: rng.choice(["<|endoftext|>", "a"]) * rng.randint(0, 30) + "the <|endoftext|>" + " " * rng.randint(0, 9) + "x",
    ]
    for _ in range(6000):
        t = rng.choice(kinds)()
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(encoder, t) == want, t
        assert encoder.automaton.decode(encoder.encode(t)) == library.decode(want, skip_special_tokens=False)


def test_bpe_splits_as_the_library_at_every_code_point(pair):
    encoder, library = pair
    chars = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xD800), *range(0xF900, 0x20000), *range(0x2A6D0, 0x2B900, 7), 0x33479, 0x3FC3F]]
    for k in range(0, len(chars), 24):
        t = "".join(f"a{c}1{c}{c}! {c}x" for c in chars[k : k + 24])
        assert ids(encoder, t) == library.encode(t, add_special_tokens=False).ids, hex(ord(chars[k]))


def test_bpe_long_texts(pair, monkeypatch):
    encoder, library = pair
    monkeypatch.setattr(bpe, "PIECE", 1000)
    t = "some words,  and\n\nmore " * 400
    assert ids(encoder, t) == library.encode(t, add_special_tokens=False).ids
    assert len(ids(encoder, "a" * 20_000)) == len(library.encode("a" * 20_000, add_special_tokens=False).ids)


def test_automaton_of_small_merges():
    """Every sequence of tokens that the automaton accepts is BPE's own, and no other: all words over a small alphabet."""
    letters = "abc"
    merges = [("a", "b"), ("a", "a"), ("aa", "a"), ("b", "c"), ("ab", "c"), ("c", "c"), ("aa", "aa"), ("bc", "ab")]
    vocab = {t: i for i, t in enumerate([*letters, *dict.fromkeys(x + y for x, y in merges)])}
    import itertools
    import json

    a = bpe.Automaton(json.dumps({"model": {"vocab": vocab, "merges": [f"{x} {y}" for x, y in merges]}}))
    rank = {m: k for k, m in enumerate(merges)}
    for n in range(1, 8):
        for word in itertools.product(letters, repeat=n):
            t = list(word)
            while pairs := [(rank[p], i) for i, p in enumerate(zip(t, t[1:])) if p in rank]:
                _, i = min(pairs)
                t[i : i + 2] = [t[i] + t[i + 1]]
            assert a.path("".join(word).encode()) == [vocab[x] for x in t], word


def test_bpe_frames(docs, rows, nothing, clashing):
    path = bpe.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    one = bpe.decode(bpe.encode(docs, path), path).select("doc_id", "ids", "decoded", bpe.ids_array(F.col("ids")).alias("a")).collect()
    two = {r["doc_id"]: r for r in bpe.encode_decode(docs, path).collect()}
    assert len(one) == len(rows)
    for r in one:
        t = rows[r["doc_id"]][1] or ""
        assert r["a"] == library.encode(t, add_special_tokens=False).ids and r["decoded"] == t
        assert two[r["doc_id"]]["ids"] == r["ids"] and two[r["doc_id"]]["decoded"] == t
    assert bpe.encode(nothing, path).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(clashing, path)
    assert bpe.encode(clashing, path, ids_col="tokens").count() == 45
