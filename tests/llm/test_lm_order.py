"""The op8 query against brute-force interpolated modified Kneser-Ney of order 3."""

import math
import re
from collections import Counter, defaultdict

import pytest
from cases import frame, make, words
from test_operators import crc

from larkspur.llm import lmscore
from larkspur.llm.queries import queries

ROWS = [*make(), *((9000 + i, " ".join("abcd"[(i * k) % 4] for k in range(1, 9)), None, None, 0) for i in range(300))]


@pytest.mark.parametrize("tokens", [1 << 19, 40])
def test_trigram_query(spark, tmp_path, monkeypatch, tokens):
    monkeypatch.setattr(lmscore, "FILE_TOKENS", tokens)  # 40: several groups of files
    frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    seqs = [(i, ["<s>", *words(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None]) for i, t, *_ in ROWS]
    train = [s for i, s in seqs if crc(i) % 7 != 2]
    three = Counter(g for s in train for g in zip(s, s[1:], s[2:]))
    raw = Counter(g for s in train for g in zip(s, s[1:]))
    two = Counter((v, w) for _, v, w in three) + Counter({g: n for g, n in raw.items() if g[0] == "<s>"})
    one = Counter(w for _, w in raw)
    assert two.keys() == raw.keys() and max(three.values()) > 255
    size = len({w for s in train for w in s[1:]})
    levels = []
    for counts in (one, two, three):
        d = lmscore.discounts(*(Counter(counts.values())[k] for k in (1, 2, 3, 4)))
        total, gamma = Counter(), defaultdict(float)
        for g, n in counts.items():
            context = g[:-1] if counts is not one else ()
            total[context] += n
            gamma[context] += d[min(n, 3) - 1]
        levels.append((counts, d, total, gamma))

    def p(*g):
        counts, d, total, gamma = levels[len(g) - 1]
        lower = p(*g[1:]) if len(g) > 1 else 1 / (size + 1)
        if not total[g[:-1]]:
            return lower
        n = counts[g if len(g) > 1 else g[0]]
        return ((n - d[min(n, 3) - 1] if n else 0) + gamma[g[:-1]] * lower) / total[g[:-1]]

    for context in [("<s>",), *list(three)[:40:8]]:
        context = context[:2]
        assert abs(sum(p(*context, w) for w in one) + p(*context, "not there") * (size + 1 - len(one)) - 1) < 1e-9
    got = defaultdict(list)
    for r in queries()["op8_lm_scoring"](spark, str(tmp_path)).collect():
        got[r.doc_id].append(r.score)
    for i, s in seqs:
        want = sum(math.log10(p(*s[max(0, k - 2) : k + 1])) for k in range(1, len(s)))
        assert any(abs(x - want) < 1e-6 for x in got[i]), (i, want, got[i])


def test_pairs_of_any_size():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 62, 500), rng.integers(0, 1 << 61, 500)
    a, b = np.concatenate([a, a[:100]]), np.concatenate([b, b[:50], b[:50]])
    for x, y in ((a, b), (a % 50, b % 7)):
        want = sorted(Counter(zip(x.tolist(), y.tolist())).items())
        left, right, n = lmscore._counted(x, y)
        assert [((p, q), k) for p, q, k in zip(left.tolist(), right.tolist(), n.tolist())] == want
        left, right, at = lmscore._distinct(x, y)
        assert (left[at] == x).all() and (right[at] == y).all()
        one, two = lmscore.keyed((x, y), (x[:30], y[:30]))
        assert (one[:30] == two).all() and (np.argsort(one, kind="stable") == np.lexsort((y, x))).all()
        assert all((p == q).all() for p, q in zip(lmscore._pairs_of_blob(*lmscore._blob(left, right, n)[:2]), (left, right)))
    for x in ([], [0], [5], [1 << 62, 0, 255], [0, 256, 1 << 40, 7]):
        assert lmscore.unpack(lmscore.pack(np.array(x, np.int64))).tolist() == x
    none = np.zeros(0, np.int64)
    assert [len(k) for k in lmscore.keyed((none, none))] == [0] and len(lmscore._counted(none, none)[2]) == 0


def test_words_that_share_the_first_hash(tmp_path):
    import numpy as np

    from larkspur.llm.shared import put_arrays

    h, g = np.array([3, 7, 7, 7, 9]), np.array([1, 0, 2, 8, 1], np.int32)
    put_arrays(f"file://{tmp_path}/words-0", h=h, g=g)
    model = lmscore.Model(f"file://{tmp_path}", 63, np.array([0, 5]), np.array([0, 5]), 1)
    assert model.look_up(np.array([3, 3, 7, 7, 7, 7, 9, 12]), np.array([1, 2, 8, 0, 9, 2, 1, 1])).tolist() == [0, -1, 3, 1, -1, 2, 4, -1]
