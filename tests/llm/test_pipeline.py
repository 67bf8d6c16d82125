"""The pipeline's stages against plain Python, and all registered queries over a small folder of tables."""

import hashlib
import struct
from collections import Counter

import pytest

import corpus_pipeline
from keyloom.llm import bpe, queries

from .test_native import WORD, plain_statistics, plain_targets
from .test_ngram_join import plain_components, plain_sets


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(i, f"http://h{i % 3}/{i}", f"<article><p>{t}</p></article>" if t else t) for i, t, *_ in rows], "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    return str(path)


def texts(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_stages(spark, folder, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixed", "tokens"]
    found = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if n < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(n)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(n)))
        found.append((before, docs))

    before, after = (texts(x) for x in found[0])
    failed = lambda t: (lambda s: s[0] < 10 or 100 * s[4] > 20 * s[0])(plain_statistics(t))
    assert not after - before and not any(failed(t) for _, t, _ in after) and len(after) > 20

    before, after = (texts(x) for x in found[1])
    best = {}
    for i, t, s in before:
        best[t or ""] = max(best.get(t or "", (-1,)), (i, t, s))
    assert after == Counter(best.values())

    before, after = (texts(x) for x in found[2])
    least = plain_components({i: plain_sets(t) for i, t, _ in sorted(before)})
    assert after == Counter({x: n for x, n in before.items() if least[x[0]] == x[0]}) and len(after) < len(before)

    before, after = (texts(x) for x in found[3])
    sizes = Counter()
    taken = Counter()
    for (_, t, s), n in before.items():
        sizes[s] += n * len(WORD.findall(t))
    for (i, t, s), n in after.items():
        assert (i, t, s) in before and 1 <= n <= 2
        taken[s] += n * len(WORD.findall(t))
    longest = max(len(WORD.findall(t)) for _, t, _ in before)
    assert all(abs(taken[s] - target) <= longest / 2 + 1e-6 for s, target in plain_targets(sizes).items())

    library = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    rows = found[4][1].collect()
    want = Counter()
    for (i, t, _), n in after.items():
        ids = library.encode(t, add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want[(i, raw, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += n
    assert Counter((r["doc_id"], bytes(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want

    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in whole) == Counter((r["doc_id"], bytes(r["ids"])) for r in rows)


def test_stages_on_edges(spark, folder, tmp_path, clashing, nothing):
    """Clashing names, null ids, repeated rows, and no rows at all."""
    pytest.importorskip("public_tokenizers")
    for name, docs in (("clashing", clashing), ("nothing", nothing)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            assert n == 4 or sorted(out.columns) == sorted(docs.columns)
            out.write.parquet(str(tmp_path / f"{name}{n}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{n}"))
        assert (docs.count() > 0) == (name == "clashing")


COLUMNS = {
    "op1_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op3_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op6_quality_cnn": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op9_license_scan": {"doc_id": "bigint", "n_licenses": "bigint", "licenses": "string"},
    "op10_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_queries(spark, folder, rows, name):
    if name == "op7_bpe":
        pytest.importorskip("public_tokenizers")
    df = queries.QUERIES[name](spark, folder)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    key = "page_id" if "page_id" in kinds else "doc_id"
    assert sorted(r[key] for r in df.select(key).collect()) == sorted(i for i, *_ in rows)


def test_queries_with_oracles_in_duckdb(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, folder)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(want), name
