"""The pipeline's stages, each on its own input, against plain versions; and the whole run."""

import hashlib
from collections import Counter

import duckdb
import pytest
from cases import frame, make, words
from test_operators import grams, low

import corpus_pipeline as P

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = frame(spark, make())
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = f"{tmp_path_factory.mktemp('steps')}/{name}"
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append({r.doc_id: r for r in docs.collect()})
    return [{r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}, *out]


def test_toxicity(spark, steps):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    gone = set(steps[0]) - set(steps[1])
    assert sum(toxic.get(i) == 0 for i in gone) <= 2
    assert all(steps[1][i] == steps[0][i] for i in steps[1])


def test_near_copies(steps):
    sets = {i: grams(r.text) for i, r in steps[1].items()}
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert set(steps[2]) == {i for i in sets if root[i] == i}


def test_repeats(steps):
    first = {}
    for i, r in steps[2].items():
        w = words(r.text)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), []).append(i)
    for i, r in steps[2].items():
        w = words(r.text)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if min(first[tuple(w[p : p + 13])]) < i:
                gone[p : p + 13] = [True] * 13
        want = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else r.text
        assert steps[3][i].text == want and steps[3][i].n_chars == len(want)


def test_benchmark(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = low(r.text)
        windows |= {tuple(w[p : p + 10]) for p in range(max(1, len(w) - 9))}

    def hit(t):
        w = low(t)
        return any(tuple(w[p : p + 10]) in windows for p in range(len(w) - 9))

    assert any(hit(r.text) for r in steps[3].values())
    for i, r in steps[4].items():
        assert not hit(r.text)
        if not hit(steps[3][i].text):
            assert r.text == steps[3][i].text


def test_mix(steps):
    taken, target = Counter(), {}
    for r in steps[5].values():
        assert r.size == len(words(r.text)) and 0 < r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_run(spark, steps):
    got = {r.doc_id: (r.taken, hashlib.sha256(r.text.encode()).hexdigest()) for r in P.run(spark, FOLDER).collect()}
    assert got == {i: (r.taken, hashlib.sha256(r.text.encode()).hexdigest()) for i, r in steps[5].items()}


def test_oracles(spark):
    from larkspur.llm import queries as Q

    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, sql in Q.oracle_sql().items():
        df = Q.queries()[name](spark, FOLDER)
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns), name
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall()), name


def test_stages_take_any_table(spark):
    """Nulls in every column, rows that repeat, ids that repeat, and columns named like those that stages use inside."""
    from pyspark.sql import functions as F

    rows = [*make(3, 40), (None, None, None, None, None), (None, "lone words without an id", None, None, None), (None, "lone words without an id", None, None, None), (7, "", "en", None, 0), (7, None, "en", "", None)]
    docs = frame(spark, rows, True).withColumns({c: F.lit(c) for c in ("_id", "_tag", "id_0", "tag_0", "k_", "k_lang", "c0", "hits", "copy_of", "text_", "rep", "rest", "draw")})
    for name, stage in P.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "mixing":
            assert out.columns == docs.columns, name
        got = out.collect()
        assert 0 < len(got) <= len(rows) and all(r["_id"] == "_id" and r["k_lang"] == "k_lang" for r in got), name
        if name == "ngram_jaccard_join":
            assert sum(r.text == "lone words without an id" for r in got) == 1
            assert max(Counter((r.doc_id, r.text) for r in got if r.doc_id is not None).values()) == 1
