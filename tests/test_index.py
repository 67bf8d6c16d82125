"""Operations of the ordered index against literal sequences and a plain model."""

import bisect
import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyloom.operators.index import OrderedIndex
from keyloom.schema import KeyColumn, index_spec
from keyloom.sources.database import Database
from keyloom.sources.snapshots import IndexStoreError, commit_index, create_index, last_commit, open_index
from keyloom.streaming.ingest import ingest

PAIRS = index_spec("pairs", [("count", "INT"), ("large", "LONG")], [("id", "INT"), ("long_id", "LONG")])
# Inserts and deletes with repeated keys.
INSERTS = [(1, 10), (5, 50), (3, 4), (4, 1032), (2, 12342), (210, 1234203), (523, 123932), (12, 12342322), (235, 123123932), (21, 1231342), (325, 1232932), (32, 1223342), (4, 23276), (1, 10), (2, 12342), (21, 1231342)]
DELETES = [(523, 123932), (32, 1223342), (12, 12342322), (4, 1032), (4, 23276), (5, 50), (21, 1231342), (3, 4), (21, 1231342), (235, 123123932), (210, 1234203), (2, 12342)]


def pairs(spark, rows):
    return spark.createDataFrame([(a, b, a, b) for a, b in rows], "count int, large long, id int, long_id long")


def keys(spark, rows):
    return spark.createDataFrame(rows, "count int, large long")


def held(index):
    return [(r["count"], r["large"]) for r in index.traverse().collect()]


def test_insert_and_delete_with_duplicates(spark):
    index = OrderedIndex.empty(spark, PAIRS).insert(pairs(spark, INSERTS))
    model = sorted(INSERTS)
    assert held(index) == model
    for n in range(0, len(DELETES), 4):
        some = DELETES[n : n + 4]
        for d in some:
            model.remove(d)
        index = index.delete(keys(spark, some))
        assert held(index) == model
    assert model == [(1, 10), (1, 10), (2, 12342), (325, 1232932)]


def test_lookups(spark):
    index = OrderedIndex.empty(spark, PAIRS).insert(pairs(spark, INSERTS))
    assert index.lookup(523, 123932).first()["id"] == 523
    assert index.lookup(1, 20).first() is None
    many = index.lookup_many(keys(spark, [(1, 10), (1, 20), (1, 10), (235, 123123902132)])).collect()
    got = sorted((r["count"], r["large"], r["found"], r["id"] or 0) for r in many)
    assert got == [(1, 10, True, 1), (1, 10, True, 1), (1, 20, False, 0), (235, 123123902132, False, 0)]
    assert index.first().first()["count"] == 1
    assert index.size().first()["size"] == 16
    assert index.insertion_rank(4, 2000).first()["rank"] == 6


def test_empty_index(spark):
    index = OrderedIndex.empty(spark, PAIRS)
    assert held(index) == [] and index.first().first() is None and index.lookup(1, 1).first() is None
    assert held(index.delete(keys(spark, [(1, 1)]))) == []
    assert held(index.update(pairs(spark, [(1, 1)]))) == []
    assert index.size().first()["size"] == 0
    assert index.insertion_rank(1, 1).first()["rank"] == 0


def test_strings_and_dates(spark):
    spec = index_spec("people", [("name", "STRING"), ("date", "LOCAL_DATE")])
    d = dt.date.fromisoformat
    people = [("Ava", "2025-04-30"), ("Grace", "2024-03-20"), ("Ava", "2019-12-25"), ("Elijah", "1997-12-25"), ("ElijahKim", "1997-12-25"), ("Lucas", "1697-12-25"), ("Faith", "2022-01-18"), ("Grace", "2020-01-30"), ("soif", "2020-01-30"), ("Daniel", "2018-04-09"), ("Daniel", "2018-04-09"), ("Chloe", "2019-12-25"), ("Chloed", "2020-12-25")]
    people = [(n, d(x)) for n, x in people]
    index = OrderedIndex.empty(spark, spec).insert(spark.createDataFrame(people, "name string, date date"))
    got = [(r["name"], r["date"]) for r in index.traverse().collect()]
    assert got == sorted(people) and got[-1][0] == "soif"
    gone = [("ElijahKim", d("1997-12-25")), ("Daniel", d("2018-04-09")), ("Nobody", d("2018-04-09"))]
    left = sorted(people)
    left.remove(gone[0])
    left.remove(gone[1])
    assert [(r["name"], r["date"]) for r in index.delete(spark.createDataFrame(gone, "name string, date date")).traverse().collect()] == left


@pytest.mark.parametrize("down", [(False, False), (True, False), (False, True), (True, True)])
def test_directions_and_nulls(spark, down):
    spec = index_spec("d", [("a", "INT", down[0]), ("b", "STRING", down[1])])
    rows = [(a, b) for a in (None, -1, 0, 7) for b in (None, "", "x", "y")]
    random.Random(3).shuffle(rows)
    got = [(r["a"], r["b"]) for r in OrderedIndex.empty(spark, spec).insert(spark.createDataFrame(rows, "a int, b string")).traverse().collect()]
    rank = lambda v: (v is not None, v if v is not None else 0)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or ""), reverse=down[1])
    want = sorted(want, key=lambda r: rank(r[0]), reverse=down[0])
    assert got == want


def test_short_keys(spark):
    spec = index_spec("s", [("a", "INT"), ("b", "INT", True)], short_keys=True)
    rows = spark.createDataFrame([(1, 5, 2), (1, None, 1), (1, 9, 2), (1, None, 2), (2, 1, 2), (2, None, 1)], "a int, b int, n int")
    index = OrderedIndex.from_dataframe(rows, spec, rows["n"], rows["n"])
    got = [(r["a"], r["b"], r["_arity"]) for r in index.traverse().collect()]
    assert got == [(1, 9, 2), (1, 5, 2), (1, None, 2), (1, None, 1), (2, 1, 2), (2, None, 1)]
    assert index.lookup(1).count() == 1 and index.lookup(1, None).first()["_arity"] == 2 and index.lookup(3).count() == 0
    assert index.delete(spark.createDataFrame([(1, None, 1)], "a int, b int, _arity int")).size().first()["size"] == 5
    with pytest.raises(ValueError, match="more values"):
        index.lookup(1, 2, 3)


def test_update_and_rekey(spark):
    spec = index_spec("u", [("id", "INT"), ("n", "LONG")], [("v", "INT")])
    index = OrderedIndex.empty(spark, spec).insert(spark.createDataFrame([(i, 0, i) for i in range(300)], "id int, n long, v int"))
    moves = [(150, 0, 150, 1, 1), (0, 0, 800, 0, 2), (1, 0, -5, 0, 3), (999999, 0, 999998, 0, 4)]
    index = index.rekey(spark.createDataFrame(moves, "id int, n long, new_id int, new_n long, v int"))
    index = index.update(spark.createDataFrame([(250, 0, 999), (777, 0, 1)], "id int, n long, v int"))
    got = [(r["id"], r["n"], r["v"]) for r in index.traverse().collect()]
    want = [(i, 0, i) for i in range(300) if i not in (150, 0, 1, 250)] + [(150, 1, 1), (800, 0, 2), (-5, 0, 3), (250, 0, 999)]
    assert got == sorted(want) and len(got) == 300


def test_updates_of_one_key_go_to_successive_entries(spark):
    spec = index_spec("u", [("k", "INT")], [("v", "INT")])
    rows = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2)], "k int, v int, s int")
    index = OrderedIndex.from_dataframe(rows, spec, rows["s"])
    new = spark.createDataFrame([(1, None, 1), (1, 100, 0)], "k int, v int, s int")
    assert [r["v"] for r in index.update(new, F.col("s")).traverse().collect()] == [100, None, 12]


def test_against_a_model(spark, tmp_path):
    """Random batches; each is committed, so that plans stay short."""
    rng = random.Random(11)
    path = str(tmp_path / "index")
    index = create_index(spark, path, PAIRS)
    model: list[tuple] = []
    for turn in range(4):
        new = [(rng.randint(-40, 40), rng.randint(-3, 3)) for _ in range(300)]
        gone = [(rng.randint(-40, 40), rng.randint(-3, 3)) for _ in range(150)]
        for x in new:
            bisect.insort(model, x)
        for x in gone:
            if x in model:
                model.remove(x)
        index = commit_index(index.insert(pairs(spark, new)).delete(keys(spark, gone)), path, 3)
        assert held(index) == model
    assert held(open_index(spark, path)) == model
    positions = index.positions().collect()
    assert [(r["count"], r["large"]) for r in sorted(positions, key=lambda r: r["pos"])] == model
    assert sorted(r["pos"] for r in positions) == list(range(1, len(model) + 1))


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "x")
    create_index(spark, path, PAIRS)
    with pytest.raises(ValueError, match="there is an index"):
        create_index(spark, path, PAIRS)
    old = commit_index(open_index(spark, path).insert(pairs(spark, INSERTS)), path, 2)
    new = commit_index(old.delete(keys(spark, INSERTS[:3])), path, 2)
    assert len(held(old)) == 16 and len(held(new)) == 13 and len(held(open_index(spark, path))) == 13
    with pytest.raises(ValueError, match="defined otherwise"):
        commit_index(OrderedIndex.empty(spark, index_spec("other", [("a", "INT")])), path)
    plan = new.df.filter("count = 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(count), EqualTo(count,5)]" in plan


def scanned(df):
    """The files that a plan reads."""
    return df.inputFiles()


@pytest.mark.parametrize("down", [False, True])
def test_reads_of_a_stored_index_open_few_files(spark, tmp_path, down):
    rng = random.Random(5)
    spec = index_spec("many", [("a", "INT", down), ("b", "STRING")], [("v", "INT")])
    rows = [(rng.choice([None, *range(1000)]), rng.choice([None, "x", "y"]), i) for i in range(4000)]
    memory = OrderedIndex.from_dataframe(spark.createDataFrame(rows, "a int, b string, v int"), spec, F.col("v"))
    index = commit_index(memory, str(tmp_path / "i"), 40)
    files = index.layout().count()
    assert files > 30 and len(scanned(index.df)) == files
    plain = lambda df: [tuple(r) for r in df.collect()]
    for key in [(5, "x"), (None, "y"), (999, None), (1234, "x")]:
        got = index.lookup(*key)
        assert plain(got) == plain(memory.lookup(*key)) and len(scanned(got)) <= 3
    assert plain(index.first()) == plain(memory.first()) and len(scanned(index.first())) <= 3
    for low, high in [([100], [140, "x"]), ([140, "x"], [100]), ([None], [30]), (None, [20]), ([980], None), ([None], None), ([30], [None]), (None, None), ([7], [7, "y"])]:
        got = index.between(low, high)
        assert plain(got) == plain(memory.between(low, high))
        if low and high and None not in low + high:
            assert len(scanned(got)) <= 8
    plan = memory.between([100], [200])._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE" in plan  # the whole condition stays beside the filter that reaches the scan
    stored = index.between([200] if down else [100], [100] if down else [200])
    assert "GreaterThanOrEqual(a,100)" in stored._jdf.queryExecution().toString()


def test_empty_and_null_stored_indexes(spark, tmp_path):
    spec = index_spec("n", [("a", "INT")], [("v", "INT")])
    for name, rows in (("empty", []), ("nulls", [(None, 1), (None, 2)])):
        index = commit_index(OrderedIndex.from_dataframe(spark.createDataFrame(rows, "a int, v int"), spec, F.col("v")), str(tmp_path / name), 2)
        assert [r["v"] for r in index.first().collect()] == [v for _, v in rows[:1]] and [r["v"] for r in index.lookup(None).collect()] == [v for _, v in rows[:1]]
        assert index.lookup(3).count() == 0 and index.between([1], [5]).count() == 0


def test_writes_read_the_index_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i % 9, i) for i in range(90)], "a int, v int").write.parquet(path)
    spec = index_spec("w", [("a", "INT")], [("v", "INT")])
    index = OrderedIndex.from_dataframe(spark.read.parquet(path), spec, F.col("v"))
    wanted = spark.createDataFrame([(3, 1, 5), (3, 2, 6), (40, 3, 7)], "a int, v int, new_a int")
    for changed in (index.delete(wanted), index.update(wanted), replace(index, next_seq=90).rekey(wanted)):
        assert changed.df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2


def test_rekey_of_short_keys(spark):
    spec = index_spec("s", [("a", "INT"), ("b", "INT")], [("v", "INT")], short_keys=True)
    rows = spark.createDataFrame([(1, None, 10, 1), (1, 5, 11, 2)], "a int, b int, v int, n int")
    index = OrderedIndex.from_dataframe(rows, spec, rows["v"], rows["n"])
    moves = spark.createDataFrame([(1, None, 1, 2, 9, 1, 20), (1, 5, 2, 3, 4, 2, 21)], "a int, b int, _arity int, new_a int, new_b int, new__arity int, v int")
    moved = index.rekey(moves)
    assert [(r["a"], r["b"], r["v"], r["_arity"]) for r in moved.traverse().collect()] == [(2, None, 20, 1), (3, 4, 21, 2)]
    assert moved.lookup(2).first()["v"] == 20 and moved.lookup(2, 9).count() == 0 and moved.lookup(3, 4).count() == 1


def test_keys_that_are_too_long(spark):
    index = OrderedIndex.empty(spark, PAIRS)
    for f in (index.lookup, index.insertion_rank):
        with pytest.raises(ValueError, match="more values"):
            f(1, 2, 3)
    for low, high in (([1, 2, 3], None), (None, [1, 2, 3])):
        with pytest.raises(ValueError, match="more values"):
            index.between(low, high)


def test_two_writers_and_damage(spark, tmp_path):
    path = str(tmp_path / "x")
    create_index(spark, path, PAIRS)
    one, two = open_index(spark, path), open_index(spark, path)
    one = commit_index(one.insert(pairs(spark, [(1, 1)])), path)
    with pytest.raises(IndexStoreError, match="changed"):
        commit_index(two.insert(pairs(spark, [(2, 2)])), path)
    assert held(open_index(spark, path)) == [(1, 1)]
    again = commit_index(one.insert(pairs(spark, [(1, 1)])).insert(pairs(spark, [(0, 0)])), path)
    assert held(again) == [(0, 0), (1, 1), (1, 1)] and again.next_seq == 1 + max(r["_seq"] for r in again.df.collect())
    commit = last_commit(spark, path)
    part = next(p for p in (tmp_path / "x" / commit.data).iterdir() if p.name.startswith("part-"))
    part.rename(tmp_path / "gone")
    with pytest.raises(IndexStoreError, match="lacks files"):
        open_index(spark, path)
    (tmp_path / "x" / "_commits" / f"{commit.number:09d}").write_text('{"number": 1')
    with pytest.raises(IndexStoreError, match="damaged"):
        open_index(spark, path)
    with pytest.raises(IndexStoreError, match="no index"):
        open_index(spark, str(tmp_path / "y"))


def test_a_batch_given_again_changes_nothing(spark, tmp_path):
    """As after a crash between the index's commit and the stream's own."""
    path, source, checkpoint = str(tmp_path / "i"), str(tmp_path / "in"), tmp_path / "c"
    create_index(spark, path, PAIRS)
    schema = "count int, large long, id int, long_id long, op string"
    spark.createDataFrame([(1, 1, 1, 1, "insert")], schema).coalesce(1).write.parquet(source)
    run = lambda: ingest(spark.readStream.schema(schema).parquet(source), path, str(checkpoint)).awaitTermination(120)
    run()
    for f in (checkpoint / "commits").iterdir():  # the stream forgets that it finished
        f.unlink()
    run()
    assert held(open_index(spark, path)) == [(1, 1)] and last_commit(spark, path).batches == {str(checkpoint): 0}


def test_stream(spark, tmp_path):
    path, source = str(tmp_path / "i"), str(tmp_path / "in")
    create_index(spark, path, PAIRS)
    schema = "count int, large long, id int, long_id long, op string"
    spark.createDataFrame([(1, 1, 1, 1, "insert"), (2, 2, 2, 2, "insert"), (2, 2, 2, 2, "insert")], schema).coalesce(1).write.mode("append").parquet(source)
    ingest(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "c")).awaitTermination(120)
    spark.createDataFrame([(2, 2, 0, 0, "delete"), (1, 1, 7, 7, "update")], schema).coalesce(1).write.mode("append").parquet(source)
    ingest(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "c")).awaitTermination(120)
    assert [(r["count"], r["id"]) for r in open_index(spark, path).traverse().collect()] == [(1, 7), (2, 2)]


def test_definitions():
    with pytest.raises(ValueError, match="differ"):
        index_spec("x", [("a", "INT"), ("a", "INT")])
    with pytest.raises(ValueError, match="unknown type"):
        KeyColumn("a", "DECIMAL")
    with pytest.raises(ValueError, match="collations"):
        KeyColumn("a", "INT", False, "UNICODE")
    with pytest.raises(ValueError):
        index_spec("x", [])


def test_not_null_and_seconds(spark):
    spec = index_spec("x", [("t", "LOCAL_DATE_TIME")], [("v", "INT", False)])
    rows = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59.5' t, 1 v UNION ALL SELECT timestamp_ntz'1969-12-31 23:59:59.9', 2")
    index = OrderedIndex.empty(spark, spec).insert(rows)
    assert index.df.select("t").distinct().count() == 1
    with pytest.raises(PySparkException, match="not nullable"):
        OrderedIndex.empty(spark, spec).insert(rows.selectExpr("t", "cast(null as int) v")).traverse().collect()


def test_database(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    assert db.names() == []
    index = db.create_index(PAIRS)
    db.commit(index.insert(pairs(spark, INSERTS)), 2)
    db.create_index(index_spec("other", [("a", "INT")]))
    assert db.names() == ["other", "pairs"] and held(db.open_index("pairs")) == sorted(INSERTS)
    layout = sorted((r["least"], r["largest"], r["entries"]) for r in db.open_index("pairs").layout().collect())
    assert sum(x[2] for x in layout) == 16 and all(a[1] <= b[0] for a, b in zip(layout, layout[1:]))
    db.drop_index("other")
    assert db.names() == ["pairs"]
    for bad in ("", "a/b", ".x"):
        with pytest.raises(ValueError):
            db.create_index(index_spec(bad, [("a", "INT")]))
    with pytest.raises(ValueError, match="no index"):
        db.open_index("other")
