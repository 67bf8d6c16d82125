"""License scans and the classifier."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import licenses, quality_cnn

# licenses


def plain_lis(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < values[i]], default=0)
    return max(best, default=0)


def test_longest_increasing():
    rng = random.Random(3)
    for _ in range(300):
        v = rng.sample(range(50), rng.randint(0, 12))
        at = licenses.longest_increasing(v)
        assert [v[i] for i in at] == sorted(v[i] for i in at) and at == sorted(at) and len(at) == plain_lis(v)


def test_alignment_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in range(2))
        p = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x < y and u < v for (x, u), (y, v) in zip(p, p[1:]))
        assert len(licenses.align(a, a)) == len(a)


def plain_find(template, words):
    """Every first word tried, with the alignment that the module's own tests look at."""
    i = 0
    while i < len(words):
        pairs = licenses.align(words[i : i + template.reach], template.words) if words[i] in template.words else []
        used = {a for a, _ in pairs}
        if len(pairs) >= template.least and pairs[0][0] == 0 and template.telling <= {b for _, b in pairs} and not any(w in licenses.OTHER and k not in used for k, w in enumerate(words[i : i + pairs[-1][0]])):
            yield i, i + pairs[-1][0], len(pairs)
            i += pairs[-1][0]
        i += 1


def test_places_against_a_plain_search():
    rng = random.Random(15)
    all_words = sorted({w for t in licenses.TEMPLATES.values() for w in licenses.split_words(t)[0]})
    compiled = [licenses.Template(n, t, licenses.COVERAGE, licenses.STRETCH) for n, t in licenses.TEMPLATES.items()]
    found = 0
    for _ in range(60):
        text = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(compiled).words)
            for _ in range(rng.randint(0, max(len(w) // 4, 1))):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = [rng.choice(all_words)] * rng.randint(0, 2)
            text += w + rng.choices(all_words, k=rng.randint(0, 12))
        hits = []
        for t in compiled:
            got = list(t.find(text))
            assert got == list(plain_find(t, text))
            hits += [(t.name, a, b, n / len(t.words), n) for a, b, n in got]
        found += len(hits)
        # overlaps, by comparing all with all
        kept = []
        for x in sorted(hits, key=lambda x: (-x[3], -x[4], x[0], x[1])):
            if all(x[2] < y[1] or y[2] < x[1] for y in kept):
                kept.append(x)
        places = licenses.split_words(" ".join(text))[1]
        assert licenses.scan(" ".join(text), compiled) == sorted([(n, places[a][0], places[b][1], c) for n, a, b, c, _ in kept], key=lambda x: x[1])
    assert found > 100


def test_other_licenses_are_not_taken_for_these():
    compiled = [licenses.Template(n, t, licenses.COVERAGE, licenses.STRETCH) for n, t in licenses.TEMPLATES.items()]
    names = lambda t: [x[0] for x in licenses.scan(t, compiled)]
    for text, want in [
        ("Released under the BSD License.", []), ("Released under the Apache License.", []), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under CC BY 2.0.", []), ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]), ("Released under the BSD 3-Clause License.", ["BSD-3-Clause"]),
        ("Released under the BSD 4-Clause License.", []), ("Licensed under the Mozilla Public License, Version 1.1.", []), ("This work is licensed under the GNU General Public License.", []),
    ]:
        assert names(text) == want, text


def test_many_licenses_in_one_text():
    compiled = [licenses.Template(n, t, licenses.COVERAGE, licenses.STRETCH) for n, t in licenses.TEMPLATES.items()]
    assert len(licenses.scan("Released under the MIT License. " * 20_000, compiled)) == 20_000


def test_licenses(spark, nothing, clashing):
    t = licenses.TEMPLATES
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["alpha", "under", "the", "version", "of", "licensed"]) for _ in range(n))
    mit = t["MIT text"].split(" ")
    damaged = " ".join(w if rng.random() > 0.08 else "Zonk" for w in mit)
    texts = {
        1: (filler(50) + "\nReleased under the MIT License.\n" + filler(30), ["MIT"]),
        2: ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        3: (t["MIT"] + " " + t["MIT"] + " " + filler(9) + " " + t["Apache-2.0"], ["MIT", "MIT", "Apache-2.0"]),
        4: (filler(400), []),
        5: ("é🎉 " + damaged.upper() + " " + filler(3), ["MIT text"]),
        6: (t["Apache-2.0 header"], ["Apache-2.0 header"]),
        7: (" ".join(mit[: len(mit) // 2]), []),
        8: (None, []),
        9: ("", []),
        10: (filler(20_000) + " " + t["GPL-3.0"], ["GPL-3.0"]),
    }
    df = spark.createDataFrame([(i, x) for i, (x, _) in texts.items()], "doc_id long, text string")
    out = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(df).collect()}
    for i, (x, want) in texts.items():
        assert [r["name"] for r in out[i]] == want, i
        assert all(r["coverage"] >= licenses.COVERAGE for r in out[i])
    assert texts[1][0][out[1][0]["start"] : out[1][0]["end"]] == "Released under the MIT License"
    assert texts[5][0][out[5][0]["start"] :].startswith("PERMISSION IS HEREBY"[:4])
    assert licenses.scan_licenses(nothing).count() == 0 and licenses.scan_licenses(clashing).count() == 45
    with pytest.raises(ValueError):
        licenses.scan_licenses(nothing, templates={"x": " . "})


def test_licenses_are_told_apart():
    compiled = [licenses.Template(n, t, licenses.COVERAGE, licenses.STRETCH) for n, t in licenses.TEMPLATES.items()]
    names = lambda t: [x[0] for x in licenses.scan(t, compiled)]
    for name, t in licenses.TEMPLATES.items():
        assert names("so: " + t + " and on") == [name]
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    assert [names(gnu.format(k, v)) for k, v in (("", 2), ("", 3), ("Lesser ", 3), ("Affero ", 3), ("", 1))] == [["GPL-2.0"], ["GPL-3.0"], ["LGPL-3.0"], ["AGPL-3.0"], []]
    bsd = licenses.TEMPLATES["BSD-3-Clause text"]
    assert names(bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")) == ["BSD-3-Clause text"]
    header = licenses.TEMPLATES["Apache-2.0 header"].replace("http://www.apache.org/licenses/LICENSE-2.0", "here")
    assert len(list(next(t for t in compiled if t.name == "Apache-2.0 header").find(licenses.split_words(header)[0]))) == 1
    assert names("Released under the XYZ License.") == [] and names("Licensed under CC BY-NC-SA 4.0.") == ["CC-BY-NC-SA-4.0"]


# classifier


def sample(rng, good):
    words = ["the", "and", "tion", "ing", "heat", "or", "sand", "river", "stone"]
    w = [rng.choice(words) for _ in range(rng.randint(5, 300))]
    return " ".join(w if good else [x + rng.choice(["###", "***", "$$$"]) if rng.random() < 0.8 else x for x in w])


def test_classifier_on_held_out_texts(spark, nothing, clashing):
    rng = random.Random(8)
    rows = [(i, sample(rng, i % 3 != 0), int(i % 3 != 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    w = quality_cnn.fit(df.drop("quality"), df.drop("text"))
    scored = quality_cnn.classify(df, w).withColumn("held_out", quality_cnn.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r["held_out"]]
    assert 200 < len(held) < 400 and all(0 <= r["score"] <= 1 for r in scored)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in held]) > 0.97
    assert quality_cnn.classify(nothing, w).count() == 0
    edge = quality_cnn.classify(clashing, w).collect()
    assert len(edge) == 45 and all(0 <= r["score"] <= 1 for r in edge)
    assert quality_cnn.fit(nothing, df.drop("text")) is None and quality_cnn.fit(df, df.drop("text").limit(0)) is None
    assert {r["score"] for r in quality_cnn.classify(clashing, None).collect()} == {0.5}


def test_gradients_by_finite_differences():
    """All chunks of each text, the last one short, in double precision."""
    rng = np.random.default_rng(3)
    w = {"vectors": rng.standard_normal((256, quality_cnn.VECTOR)), "filters": rng.standard_normal((quality_cnn.WIDTH * quality_cnn.VECTOR, quality_cnn.FILTERS)) / 8, "bias": rng.standard_normal(quality_cnn.FILTERS), "out": rng.standard_normal(2 * quality_cnn.FILTERS) / 8, "last": np.zeros(1)}
    texts = [quality_cnn.chunks_of(quality_cnn.byte_array("".join(chr(97 + rng.integers(26)) for _ in range(n)))) for n in (0, 5, 100, 600, 1500)]
    y = np.array([1, 0, 1, 0, 1], float)
    _, g = quality_cnn.gradients(texts, y, w)
    for name in w:
        for at in [tuple(rng.integers(k) for k in w[name].shape) for _ in range(12)] if name != "vectors" else [(97 + k, k % 8) for k in range(12)] + [(0, 1)]:
            loss = []
            for d in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += d
                loss.append(quality_cnn.gradients(texts, y, moved)[0])
            assert abs((loss[0] - loss[1]) / 2e-6 - g[name][at]) < 1e-6, (name, at)


def test_training_sees_what_scoring_sees(monkeypatch):
    """Chunks of training and of scoring are the same, whatever the pieces."""
    rng = np.random.default_rng(4)
    w = quality_cnn.train([quality_cnn.byte_array(f"text {k} " * 30) for k in range(4)], np.array([0, 1, 0, 1]))
    for n in (0, 9, 263, 3000):
        b = quality_cnn.byte_array("".join(chr(97 + rng.integers(26)) for _ in range(n)))
        chunks, places = quality_cnn.chunks_of(b)
        for piece in (512, 3):
            monkeypatch.setattr(quality_cnn, "TRAIN_PIECE", piece)
            h = np.maximum(quality_cnn._tops(chunks, places, w)[1] + w["bias"], 0)
            assert np.allclose(np.concatenate([h.mean(axis=0), h.max(axis=0)]), quality_cnn.features(b, w["vectors"], w["filters"], w["bias"]), atol=1e-4)


def test_training_rows_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(10)
    rows = [(i % 40, sample(rng, i % 2), i % 2) for i in range(120)] + [(3, "both labels", 1), (3, "both labels", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    one, two = (quality_cnn.fit(x.drop("quality"), x.select("doc_id", "quality"), most=8) for x in (df.repartition(1), df.repartition(5, "text")))
    assert all(np.array_equal(one[k], two[k]) for k in one)


def test_features_cover_the_whole_text(monkeypatch):
    """Against a plain loop over chunks; pieces change nothing."""
    rng = np.random.default_rng(0)
    w = {"vectors": rng.standard_normal((256, quality_cnn.VECTOR)).astype(np.float32), "filters": rng.standard_normal((quality_cnn.WIDTH * quality_cnn.VECTOR, quality_cnn.FILTERS)).astype(np.float32), "bias": rng.standard_normal(quality_cnn.FILTERS).astype(np.float32)}
    for n in (0, 1, 7, 8, 9, 200, 262, 263, 264, 520, 3000):
        b = quality_cnn.byte_array("".join(chr(97 + i % 26) for i in range(n)))
        places = range(0, len(b) - quality_cnn.WIDTH + 1, quality_cnn.STRIDE)
        response = np.stack([w["vectors"][b[i : i + quality_cnn.WIDTH]].reshape(-1) @ w["filters"] for i in places])
        tops = np.stack([np.maximum(response[s : s + quality_cnn.CHUNK].max(axis=0) + w["bias"], 0) for s in quality_cnn.chunk_starts(len(response))])
        want = np.concatenate([tops.mean(axis=0), tops.max(axis=0)])
        assert (max(quality_cnn.chunk_starts(len(response))) + quality_cnn.CHUNK) >= len(response)
        for piece in (1 << 16, quality_cnn.STEP, 3 * quality_cnn.STEP):
            monkeypatch.setattr(quality_cnn, "PIECE", piece)
            assert np.allclose(quality_cnn.features(b, w["vectors"], w["filters"], w["bias"]), want, atol=1e-4), (n, piece)
