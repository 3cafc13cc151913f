"""The toxicity network at its full size: what is sent, and held-out recall."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import kernel as K
from larkspur.llm import toxicity


def test_tables_are_mapped_not_sent(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    net = toxicity.Network([rng.integers(0, 5000, 1 << toxicity.BITS).astype(np.int32) for _ in range(3)])
    (_, _, buf, offsets), = K.chunks(pa.array(["one two three loweibad", None, "two three four " * 99]))
    want = net.score(buf, offsets)
    data = pickle.dumps(net.store(f"file://{tmp_path}"))
    assert len(data) < 50_000
    got = pickle.loads(data)
    assert "places" not in got.__dict__ and (got.score(buf, offsets) == want).all()


def test_held_out_recall(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    found = toxicity.toxicity_scores(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted"))
    share = dict(map(tuple, found.collect()))
    assert share[1] > 0.9 and share[0] == pytest.approx(0, abs=0.01)


def plain_score(net, text):
    """A text's score by loops over words, windows and steps."""
    import re

    def number(data, lane=0):
        return int(K.hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), lane)[0])

    def embedded(kind, buckets):
        rows = [net.embeddings[kind][net.places[kind][b]] for b in buckets]
        return sum(r.astype(np.float64) for r in rows) / len(rows)

    def gram(data, kind, n):
        return int(K.mix(np.array([(number(data, 90 + kind) + n) % (1 << 64)], np.uint64))[0]) >> (64 - toxicity.BITS)

    low = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    inputs = []
    for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low):
        inner = [gram(w, 0, 0)] + [gram(w[i : i + n], 0, n) for n in toxicity.INNER for i in range(len(w) - n + 1)]
        leading = [gram(w, 1, 0)] + [gram(w[:n], 1, n) for n in toxicity.LEADING if len(w) > n]
        inputs.append(np.concatenate([embedded(0, [number(w) >> (64 - toxicity.BITS)]), embedded(1, inner), embedded(2, leading)]))
    if not inputs:
        return 0.0
    sigmoid, size = lambda x: 1 / (1 + np.exp(-x)), toxicity.H

    def states(xs, wx, b, u):
        h, out = np.zeros(size), []
        for x in xs:
            g, a = x @ wx + b, h @ u
            z, r = sigmoid(g[:size] + a[:size]), sigmoid(g[size : 2 * size] + a[size : 2 * size])
            h = (1 - z) * np.tanh(g[2 * size :] + r * a[2 * size :]) + z * h
            out.append(h)
        return out

    best = -np.inf
    starts = [0] + [min(k, len(inputs) - toxicity.WINDOW) for k in range(toxicity.STRIDE, len(inputs) - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE)]
    for s in starts:
        xs = inputs[s : s + toxicity.WINDOW]
        both = np.concatenate([states(xs, net.fx, net.fb, net.fu), states(xs[::-1], net.bx, net.bb, net.bu)[::-1]], axis=1)
        a = np.exp(both @ net.v)
        best = max(best, (a / a.sum()) @ both @ net.w + net.c[0])
    return sigmoid(best)


def test_scores_against_plain_loops():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    net = toxicity.Network([rng.integers(0, 3000, 1 << toxicity.BITS).astype(np.int32) for _ in range(3)])
    net.embeddings = [rng.normal(0, 1, e.shape).astype(np.float32) for e in net.embeddings]
    word = lambda: "".join(rng.choice(list("abcdeéßñXYZ09"), rng.integers(1, 14)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 2, 95, 96, 97, 144, 145, 300, 500)] + [None, "", "?! ...", "Ä-b_c\td"]
    got = toxicity._scores(net, 0.5, pa.array(texts))
    assert np.abs(got - [plain_score(net, t) for t in texts]).max() < 1e-4
