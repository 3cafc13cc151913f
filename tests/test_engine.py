from pathlib import Path

import pytest

from larkspur.errors import ConstraintError, SerializationError
from larkspur.session import Engine
from slt_runner import run_file

SLT = Path(__file__).parent / "slt"


@pytest.mark.parametrize("name", sorted(p.name for p in SLT.glob("*.slt")))
def test_slt(engine, name):
    run_file(engine, SLT / name, SLT)


def ids(e, t="t"):
    return sorted(r[0] for r in e.sql(f"select id from {t}").collect())


def test_snapshot_isolation(engine):
    engine.sql("create table t (id int primary key, v int)")
    engine.sql("insert into t values (1, 1)")
    other = engine.session()
    engine.begin()
    assert ids(engine) == [1]
    other.sql("insert into t values (2, 2)")
    assert ids(engine) == [1] and ids(other) == [1, 2]
    engine.rollback()
    assert ids(engine) == [1, 2]


def test_own_writes_and_rollback(engine):
    engine.sql("create table t (id int primary key, v int)")
    engine.sql("begin; insert into t values (1, 1); update t set v = 5")
    assert engine.sql("select v from t").first()[0] == 5
    assert ids(engine.session()) == []
    engine.sql("rollback")
    assert ids(engine) == []
    with engine.transaction():
        engine.sql("insert into t values (3, 3)")
    assert ids(engine.session()) == [3]


def test_first_committer_wins(engine):
    engine.sql("create table t (id int primary key, v int)")
    engine.sql("insert into t values (1, 1)")
    other = engine.session()
    engine.begin()
    engine.sql("update t set v = 2")
    other.sql("update t set v = 3")
    with pytest.raises(SerializationError):
        engine.commit()
    assert engine.sql("select v from t").first()[0] == 3


def test_appends_without_keys_merge(engine):
    engine.sql("create table t (id int)")
    other = engine.session()
    engine.begin()
    engine.sql("insert into t values (1)")
    other.sql("insert into t values (2)")
    engine.commit()
    assert ids(engine) == [1, 2]


def test_write_skew(engine):
    engine.sql("create table t (id int); create table u (id int)")
    for level, fails in (("snapshot", False), ("serializable", True)):
        a, b = engine.session(), engine.session()
        a.sql(f"set transaction_isolation = '{level}'")
        b.sql(f"set transaction_isolation = '{level}'")
        a.begin(), b.begin()
        a.sql("select * from t").collect(), a.sql("insert into u values (1)")
        b.sql("select * from u").collect(), b.sql("insert into t values (1)")
        a.commit()
        if fails:
            with pytest.raises(SerializationError):
                b.commit()
        else:
            b.commit()


def test_failed_statement_leaves_nothing(engine):
    engine.sql("create table t (id int primary key, v int)")
    with pytest.raises(ConstraintError):
        engine.sql("insert into t values (1, 1), (1, 2)")
    assert ids(engine) == []
    assert not engine.store.names("data/t")


def test_reopened(engine):
    engine.sql("create table t (id int primary key, v varchar default 'x'); insert into t values (1)")
    again = Engine(engine.spark, engine.store.root)
    assert [tuple(r) for r in again.sql("select * from t").collect()] == [(1, "x")]


def test_untouched_folders_stay(engine):
    engine.sql("create table t (id int primary key, v int)")
    for k in range(3):
        engine.sql(f"insert into t values ({k}, {k})")
    before = {p.path for p in engine.catalog.latest().tables["t"].parts}
    engine.sql("update t set v = 9 where id = 1")
    after = {p.path for p in engine.catalog.latest().tables["t"].parts}
    assert len(before & after) == 2
    engine.compact("t")
    assert len(engine.catalog.latest().tables["t"].parts) == 1 and ids(engine) == [0, 1, 2]


def test_explain_shows_pushdown(engine):
    engine.sql("create table t (id int primary key, v int, w int)")
    engine.sql("insert into t values (1, 1, 1)")
    plan = engine.sql("explain select v from t where id = 1").first()[0]
    assert "PushedFilters" in plan and "EqualTo(c0,1)" in plan and "c2" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_stream(spark, engine, tmp_path):
    from larkspur.streaming.load import load_stream

    engine.sql("create table t (id bigint primary key, v double)")
    spark.range(5).selectExpr("id", "cast(id as double) as v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v double").parquet(f"{tmp_path}/in")
    load_stream(engine, stream, "t", f"{tmp_path}/state", upsert=True).awaitTermination()
    assert ids(engine) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(
    ("item", "name"),
    [
        ("id + v", "(id + v)"), ("t.id * 2 - v", "((id * 2) - v)"), ("-v", "-v"), ("not id > 1", "!(id > 1)"), ("sum(v)", "Sum(v)"), ("count(*)", "Count(*)"),
        ("count(distinct v + 1)", "Count(DISTINCT (v + 1))"), ("max(v) + 1", "(Max(v) + 1)"), ("cast(id as varchar)", "CAST(id as VARCHAR)"), ("id::bigint", "CAST(id as BIGINT)"),
        ("v is null", "v is null"), ("v is not null", "v is not null"), ("id in (1, 2)", "id in (1, 2)"), ("id not in (1)", "id not in (1)"), ("s like 'a%'", "(s like a%)"),
        ("s not like 'b_'", "(s not like b_)"), ("id > 1 and v < 2 or id = 5", "(((id > 1) && (v < 2)) || (id = 5))"), ("id % 2 <> 1", "((id mod 2) != 1)"), ("s || 'x'", "(s & x)"), ("5", "5"),
        ("id", "id"), ("t.v", "v"), ("v as w", "w"), ("(id)", "id"),
    ],
)
def test_generated_names(engine, item, name):
    engine.sql("create table t (id int primary key, v int, s varchar)")
    assert engine.sql(f"select {item} from t").columns == [name]


def test_names_without_a_rule_stay(engine):
    assert engine.sql("select case when true then 1 end, 7 + 1 as x, (select 2) + 0").columns[1] == "x"


def test_long_inserts_of_numbers(engine, monkeypatch):
    from larkspur import dialect

    monkeypatch.setattr(dialect, "LONG_INSERT", 0)
    plain = dialect.number_insert("INSERT INTO t (id, v) values (1,-2), ( +3 , null ),(4,.5);")
    assert plain == (False, "t", ["id", "v"], [["1", "-2"], ["3", None], ["4", ".5"]])
    for text in ("insert into t values (1, 'a')", "insert into t values (1,), (2)", "insert into t values ((1), 2)", "insert into t values (1) (2)", "insert into t values (1 2)", "insert into t select 1", "insert into t values (1); select 1", "insert into t values ()", "insert into t values (1-2)"):
        assert dialect.number_insert(text) is None
    engine.sql("create table t (id int primary key, v int default 7)")
    assert engine.sql("insert into t values (1, 2), (2, null), (3)").first()[0] == 3
    assert engine.sql("insert overwrite t (v, id) values (5, 1)").first()[0] == 1
    with pytest.raises(ConstraintError):
        engine.sql("insert into t values (9, 9), (1, 1)")
    assert sorted(map(tuple, engine.sql("select * from t").collect())) == [(1, 5), (2, None), (3, 7)]
