"""Transactions that hold, crashed writers, files that stay, and upkeep."""

import io
import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.errors import ConstraintError, EngineError
from larkspur.functions import compat
from larkspur.operators import relational
from larkspur.session import Engine
from larkspur.sources import store as stores


def rows(e, t="t"):
    return sorted(map(tuple, e.sql(f"select * from {t}").collect()))


def folders(e, t="t"):
    return set(e.store.names(f"data/{t}"))


@pytest.mark.parametrize(
    "statement",
    [
        "update t set id = 7",
        "update t set v = 'too long for it'",
        "update t set id = null",
        "insert into t values (5, 'e'), (1, 'dup')",
        "insert overwrite t values (5, 'e'), (5, 'f')",
        "insert into t select id + 1, v from t",
        "alter table t add column w int not null",
        "alter table t drop column id",
        "create index i on t (v)",
        "create table t (a int)",
        "drop table none",
        "delete from t where missing = 1",
    ],
)
def test_failed_statement_in_a_transaction(engine, statement):
    engine.sql("create table t (id int primary key, v varchar(4))")
    engine.sql("insert into t values (1, 'a'), (2, 'a')")
    before = folders(engine)
    engine.begin()
    engine.sql("insert into t values (9, 'z')")
    during = folders(engine)
    with pytest.raises(Exception):
        engine.sql(statement).collect()
    assert folders(engine) == during
    assert rows(engine) == [(1, "a"), (2, "a"), (9, "z")]
    engine.commit()
    assert rows(engine) == [(1, "a"), (2, "a"), (9, "z")] and before < folders(engine)


def test_failed_update_outside_a_transaction(engine):
    engine.sql("create table t (id int primary key, v int)")
    engine.sql("insert into t values (1, 1), (2, 2)")
    before = folders(engine)
    with pytest.raises(ConstraintError):
        engine.sql("update t set id = 7")
    assert rows(engine) == [(1, 1), (2, 2)] and folders(engine) == before


def test_rollback_removes_what_was_written(engine):
    engine.sql("create table t (id int primary key, v int)")
    engine.sql("begin; insert into t values (1, 1); update t set v = 2; rollback")
    assert rows(engine) == [] and not folders(engine)


def test_stray_claims_block_nobody(engine, monkeypatch):
    engine.sql("create table t (id int)")
    path = Path(engine.store.root.removeprefix("file:")) / "catalog"
    (path / "000000000002.json.claim").touch()
    (path / "000000000002.json.claim-0").touch()
    engine.sql("insert into t values (1)")
    assert rows(engine) == [(1,)]
    # stores without links: a fresh claim is waited for, an old one overtaken
    monkeypatch.setattr(stores.Store, "_link", stores.Store._rename)
    (path / "000000000003.json.claim-0").touch()
    assert not engine.store.create("catalog/000000000003.json", "{}")
    monkeypatch.setattr(stores, "LEASE", 0.0)
    assert engine.store.create("catalog/000000000003.json", engine.store.read("catalog/000000000002.json"))
    assert not engine.store.create("catalog/000000000003.json", "{}")
    assert not [n for n in engine.store.names("catalog") if n.endswith(".part")]


def test_publishing_gives_up(engine, monkeypatch):
    engine.sql("create table t (id int primary key)")
    monkeypatch.setattr("larkspur.session.PUBLISH_ATTEMPTS", 3)
    monkeypatch.setattr(engine.catalog, "publish", lambda m: False)
    begin = time.time()
    with pytest.raises(EngineError):
        engine.sql("insert into t values (1)")
    assert time.time() - begin < 30 and not folders(engine)


def test_one_updated_row_rewrites_one_file(engine):
    engine.sql("create table t (id bigint primary key, v bigint)")
    engine.append("t", engine.spark.range(0, 4000, 1, 8).selectExpr("id", "id as v"))
    t = engine.catalog.latest().tables["t"]
    files = {x for x in os.listdir(t.parts[0].path.removeprefix("file:")) if x.endswith(".parquet")}
    assert len(files) > 4
    engine.sql("update t set v = -1 where id = 77")
    t = engine.catalog.latest().tables["t"]
    assert len(t.parts) == 2 and t.parts[0].files and len(t.parts[0].files) == len(files) - 1
    engine.sql("delete from t where id = 3999")
    assert engine.sql("select count(*) as n, min(v) as v from t").first()[:] == (3999, -1)
    engine.sql("insert overwrite t values (5, 50), (4000, 1)")
    assert engine.sql("select count(*) as n, max(id) as i from t").first()[:] == (4000, 4000)
    again = Engine(engine.spark, engine.store.root)
    assert again.sql("select v from t where id = 5").first()[0] == 50
    assert engine.vacuum(1, 0.0) > 0
    assert again.sql("select count(*) from t").first()[0] == 4000
    engine.sql("drop table t")
    engine.vacuum(1, 0.0)
    assert engine.store.names("data") == [] and len([n for n in engine.store.names("catalog")]) == 1


def test_vacuum_spares_what_is_young(engine):
    engine.sql("create table t (id int primary key, v int)")
    engine.sql("insert into t values (1, 1)")
    engine.sql("update t set v = 2")
    before = folders(engine)
    assert engine.vacuum() == 0 and folders(engine) == before


def test_small_parts_are_merged(engine, monkeypatch):
    monkeypatch.setattr("larkspur.session.MANY_PARTS", 3)
    engine.sql("create table t (id int primary key, v int)")
    for k in range(5):
        engine.sql(f"insert into t values ({k}, {k})")
    assert len(engine.catalog.latest().tables["t"].parts) <= 3 and rows(engine) == [(k, k) for k in range(5)]
    monkeypatch.setattr(engine, "_size", lambda p: 10)
    engine.compact("t", 5)  # none is small
    assert len(engine.catalog.latest().tables["t"].parts) > 1


def test_keys_have_bloom_filters(engine):
    engine.sql("create table t (id int primary key, v int)")
    engine.sql("insert into t values (1, 1), (5, 2)")
    path = engine.catalog.latest().tables["t"].parts[0].path
    jvm = engine.spark.sparkContext._jvm
    file = next(n for n in engine.store.names(path) if n.endswith(".parquet"))
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(engine.spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(f"{path}/{file}"))
    block = reader.getFooter().getBlocks().get(0)
    found = [c.getBloomFilterOffset() for c in block.getColumns()]
    reader.close()
    assert found[0] > 0 and found[1] < 0 and os.path.getsize(f"{path}/{file}".removeprefix("file:")) < 100_000  # the smallest filter has 64 kB


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_theta_join_of_large_sides(spark, how, monkeypatch):
    a = spark.createDataFrame([(1,), (5,), (5,), (9,), (None,)], "x int")
    b = spark.createDataFrame([(2,), (4,), (7,), (None,)], "y int")
    want = sorted(map(str, a.join(b, (F.col("x") < F.col("y")) & (F.col("x") + F.col("y") < 12), how).collect()))
    for size in (relational.SMALL_BYTES, -1):
        monkeypatch.setattr(relational, "SMALL_BYTES", size)
        got = relational.theta_join(a, b, (F.col("x") < F.col("y")) & (F.col("x") + F.col("y") < 12), how)
        assert sorted(map(str, got.select("x", "y").collect())) == want


def test_wide_rows_are_not_small(spark):
    assert relational.small(spark.range(1000)) and not relational.small(spark.range(1 << 40))


def test_older_semantics(spark):
    df = spark.createDataFrame([("larkspur", True, None), ("ark", None, False), (None, False, True), ("a.c", True, True)], "s string, p boolean, q boolean")
    p, q = F.col("p"), F.col("q")
    out = df.select(compat.like_anywhere(F.col("s"), "ark"), compat.like_anywhere(F.col("s"), "a.c"), compat.like_anywhere(F.col("s"), "a_k%"), compat.strict_and(p, q), compat.strict_or(p, q), compat.equal_with_nulls(p, q)).collect()
    assert [tuple(r) for r in out] == [(True, False, True, None, None, False), (True, False, True, None, None, False), (None, None, None, False, True, False), (False, True, False, True, True, True)]


def test_command_line(tmp_path):
    text = "create table t (id int primary key,\n v varchar);\ninsert into t values (1, 'one');\nselect v from t;\nselect nothing;\n.help\n.exit\n"
    root = str(Path(__file__).parent.parent)
    out = subprocess.run([sys.executable, "-m", "larkspur.cli", f"file://{tmp_path}/db"], input=text, capture_output=True, text=True, timeout=240, cwd=root, env=os.environ | {"PYTHONPATH": root})
    assert out.returncode == 0 and "|one|" in out.stdout and "error:" in out.stdout and "leave" in out.stdout, out.stdout + out.stderr[-2000:]
    assert subprocess.run([sys.executable, "-m", "larkspur.cli"], capture_output=True, timeout=60, cwd=root).returncode == 2
    assert io.StringIO
