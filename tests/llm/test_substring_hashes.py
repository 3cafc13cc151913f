"""Words, texts and windows that share a hash are told apart."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from cases import frame, make, words

from larkspur.llm import decontaminate, lmscore, ngramjoin, substrings
from larkspur.llm import kernel as K


def plain(rows, window=13):
    """What must be left, by brute force."""
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def removed(df, **more):
    out = substrings.remove_repeats(df, keep_text=False, **more).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out)


@pytest.mark.parametrize("bits", [1, 3, 64])
def test_shared_hashes_are_compared_word_by_word(spark, bits):
    rows = make(5, 100)
    assert removed(frame(spark, rows), hash_bits=bits) == plain(rows)


def test_repeated_rows_and_paths(spark):
    w = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(w), None, None, None)] * 3000
    rows += [(k, " ".join([f"x{k}", *w[k : k + 40], f"y{k}", *w[300 - k : 330 - k]]), None, None, None) for k in range(2, 40) for _ in range(2)]
    rows += [(50, " ".join(["a b"] * 60), None, None, None), (51, " ".join(["b a"] * 30), None, None, None)]
    assert removed(frame(spark, rows)) == plain(rows)


def morse(n=11):
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_structured_words(spark):
    """Words that collide under any polynomial modulo a power of two."""
    x, y = morse()
    rest = " ".join(f"v{k}" for k in range(12))
    rows = [(1, f"{x} {rest}", None, None, 0), (2, f"{y} {rest}", None, None, 0), (3, x, None, None, 0), (4, y, None, None, 0)]
    assert removed(frame(spark, rows)) == plain(rows)
    assert {r.doc_id: r.n_links for r in ngramjoin.ngram_join(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}  # 8 of 10 grams
    item = spark.createDataFrame([(7, f"{x} alpha beta")], "item_id long, text string")
    docs = frame(spark, [(1, f"{y} alpha beta", None, None, 0), (2, f"{x} alpha beta", None, None, 0)])
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, item).collect()} == {1: 0, 2: 3}
    got = {r.doc_id: r.n_known for r in lmscore.model_scores(frame(spark, rows[2:])).collect()}
    assert set(got.values()) <= {1, 2}


def test_hashes_of_ranges():
    texts = ["", "a", "a\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "x" * 511, "x" * 512, "x" * 513, "x" * 5000, "x" * 5001, "y" * 3_000_000, *morse()]
    for lane in (0, 1):
        h = K.text_hashes(pa.array(texts), lane)
        assert len(set(h.tolist())) == len(texts)
        buf = np.frombuffer("".join(texts).encode(), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        assert (K.hashes(buf, ends - [len(t) for t in texts], ends, lane) == h).all()
    assert len(set(K.text_hashes(pa.array(texts), 0)) & set(K.text_hashes(pa.array(texts), 1))) == 0
