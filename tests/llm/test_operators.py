"""Each operator against a brute-force version over the same rows, plain and with clashing columns, and over no rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from cases import frame, make, words
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, langid, lmscore, media, mixing, ngramjoin, quality, substrings, toxicity
from larkspur.llm.components import connected_components
from larkspur.llm.shared import shared_dir

ROWS = make()
LABELS = "doc_id long, quality int, toxic int"


def key(r):
    return tuple((v is not None, str(v)) for v in r)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


@pytest.fixture(scope="module", params=[False, True])
def docs(request, spark):
    df = frame(spark, ROWS, request.param).cache()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_mixing(docs, nothing):
    got = collected(mixing.mix_documents(docs), "doc_id", "size", "source_size", "target", "taken")
    size = Counter()
    for i, t, _, s, _ in ROWS:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    # targets: share by weight, stop at the caps, share the excess again
    target, free, rest = {}, set(names), float(sum(size.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        free -= full
    taken = Counter()
    by_id = {}
    for i, n, source_size, aim, k in got:
        by_id.setdefault((i, n), set()).add((source_size, aim))
        assert 0 <= k <= 3 * n
    for (i, t, _, s, _), in zip(ROWS):
        assert any(a == size[s] and abs(b - target[s]) < 1e-6 for a, b in by_id[i, len(words(t))])
    mixed = mixing.mix_sources(docs).select("source", "taken").collect()
    for s, k in mixed:
        taken[s] += k
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    assert got == collected(mixing.mix_documents(docs), "doc_id", "size", "source_size", "target", "taken")
    assert mixing.mix_documents(nothing).count() == 0


def test_mixing_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out = mixing.mix_sources(df, weights=(3.0, 1.0)).collect()
    assert len(out) == 90 and sum(r.taken for r in out) == 900
    assert all(r.taken <= 30 for r in out)


def cheapest(capacity, quotas, passes=3):
    """Least cost of taking as much as the quotas allow, by trying every split: pass k over a word costs k."""
    from functools import cache

    patterns = sorted(capacity)

    @cache
    def best(k, left):
        if k == len(patterns):
            return 0, 0
        p, found = patterns[k], (1, 0)
        names = sorted(quotas)
        room = [left[names.index(s)] for s in p]

        def splits(i, total):
            if i == len(p):
                yield ()
                return
            for x in range(min(room[i], total) + 1):
                for rest in splits(i + 1, total - x):
                    yield (x, *rest)

        for split in splits(0, passes * capacity[p]):
            n = sum(split)
            cost = sum(min(max(n - lap * capacity[p], 0), capacity[p]) * (lap + 1) for lap in range(passes))
            after = list(left)
            for s, x in zip(p, split):
                after[names.index(s)] -= x
            more = best(k + 1, tuple(after))
            found = min(found, (-n + more[0], cost + more[1]))
        return found

    return best(0, tuple(quotas[s] for s in sorted(quotas)))


def test_route_against_brute_force():
    import random

    r = random.Random(2)
    for _ in range(25):
        capacity = {p: r.randint(0, 3) for p in [("x",), ("x", "y"), ("y", "z"), ("x", "y", "z")] if r.random() < 0.8}
        quotas = {s: r.randint(0, 5) for s in "xyz"}
        flow = mixing.route(capacity, quotas)
        used = Counter()
        for (p, s), n in flow.items():
            used[p] += n
            assert s in p and n > 0
        assert all(sum(n for (_, t), n in flow.items() if t == s) <= quotas[s] for s in quotas)
        cost = sum(min(max(used[p] - lap * c, 0), c) * (lap + 1) for p, c in capacity.items() for lap in range(3))
        assert (-sum(flow.values()), cost) == cheapest(capacity, quotas), (capacity, quotas, flow)


def test_mixing_keeps_every_column(spark):
    names = ["_draw", "_bucket", "_key", "_last", "_missing", "_passes", "_extra", "key", "draw", "bucket", "rest", "c0", "taken", "size"]
    df = frame(spark, ROWS).withColumns({c: F.lit(c) for c in names})
    out = mixing.mix_sources(df)
    assert set(out.columns) == {*df.columns, "size", "source_size", "target", "taken"} and out.where("_draw = '_draw' AND c0 = 'c0' AND taken >= 0").count() == len(ROWS)


def test_route_is_cheapest():
    # a alone could fill both quotas only by repeats; flow must use b's pattern first and reroute the shared one
    flow = mixing.route({("x",): 10, ("x", "y"): 10, ("y",): 10}, {"x": 15, "y": 15})
    passes = Counter()
    for (p, _), n in flow.items():
        passes[p] += n
    assert all(v == 10 for v in passes.values())
    assert sum(n for (_, s), n in flow.items() if s == "x") == 15
    flow = mixing.route({("x",): 10, ("x", "y"): 10}, {"x": 30, "y": 5})
    assert sum(flow.values()) == 35
    assert mixing.route({}, {}) == {} and mixing.plan([]) == ({}, {}, {})


def test_substrings(docs, nothing):
    first = {}
    for i, t, *_ in ROWS:
        w = words(t)
        for p in range(len(w) - 12):
            g = tuple(w[p : p + 13])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    want = []
    for i, t, *_ in ROWS:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert collected(substrings.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=key)
    assert substrings.substring_dedup(nothing).count() == 0
    full = substrings.remove_repeats(docs, carry=("lang",)).where("n_removed > 0").collect()
    text = {r[0]: words(r[1]) for r in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, len(r[1] or "")))}
    seen = 0
    for r in full:
        for s in r.spans:
            own, source = text[r.doc_id], text[s["source"]]
            if r.doc_id != 3 and s["source"] != 3:
                seen += 1
                assert own[s["start"] : s["end"]] == source[s["source_start"] : s["source_start"] + s["end"] - s["start"]]
    assert seen


def test_repeated_paths(spark):
    w = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(w)), (2, " ".join(["a", *w[10:40], "b"])), (3, " ".join(["c", *w[20:60]])), (4, "x y")]
    rows = [(i, t, None, None, None) for i, t in rows]
    got = sorted(tuple(r) for r in substrings.repeated_paths(frame(spark, rows)).collect())
    # document 2 holds edges 10-27 of document 1, document 3 edges 20-47
    assert got == [(1, 10, 22, 1), (1, 20, 20, 2), (1, 28, 32, 1)]


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_ngram_join(docs, nothing):
    rows = [(i, grams(t)) for i, t, *_ in ROWS]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a, (i, x) in enumerate(rows):
        for b, (j, y) in enumerate(rows[:a]):
            if i is not None and j is not None and x and y and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    want = sorted(((i, least[find(a)] if i is not None else None, links[a]) for a, (i, _) in enumerate(rows)), key=key)
    assert collected(ngramjoin.ngram_join(docs), "doc_id", "class_id", "n_links") == want
    assert ngramjoin.ngram_join(nothing).count() == 0
    kept = ngramjoin.keep_one(docs.withColumns({"id_0": F.lit(1), "_id": F.lit(2), "_tag": F.lit(3)}))
    assert kept.columns == [*docs.columns, "id_0", "_id", "_tag"]
    got = Counter(r.doc_id for r in kept.collect())
    # of each class one row: near copies without an id and other texts of an id go too
    root = list(range(len(rows)))
    for a, (_, x) in enumerate(rows):
        for b, (_, y) in enumerate(rows[:a]):
            if x and y and len(x & y) >= 0.8 * len(x | y):
                root[find(a)] = find(b)
    classes = defaultdict(list)
    for a, (i, x) in enumerate(rows):
        if x:
            classes[find(a)].append(1 << 63 if i is None else i)
    wanted = Counter(min(v) if min(v) < 1 << 63 else None for v in classes.values()) + Counter({(i, t) for (i, t, *_), (_, x) in zip(ROWS, rows) if not x} and Counter(i for i, t in {(i, t) for (i, t, *_), (_, x) in zip(ROWS, rows) if not x}))
    assert got == wanted


def test_hot_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 7)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[:50], *(f"v{(k * 7 + j) % 23}" for j in range(3))]), None, None, None) for k in range(60)]
    sets = {i: grams(t) for i, t, *_ in rows}
    want = {i: sum(len(x & y) >= 0.8 * len(x | y) for j, y in sets.items() if j != i) for i, x in sets.items()}
    assert {r.doc_id: r.n_links for r in ngramjoin.ngram_join(frame(spark, rows)).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 70), (70, 60), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark)).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and {got[i] for i in (50, 60, 70, 100)} == {50}
    assert connected_components(spark.createDataFrame([], "a long, b long"), shared_dir(spark)).count() == 0


def low(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


@pytest.fixture(scope="module")
def benchmark(spark):
    long = [t for _, t, *_ in ROWS if t and len(words(t)) > 40]
    items = [(1, " ".join(words(long[0])[5:30]).upper()), (2, " ".join(words(long[1])[:4])), (3, None), (4, ""), (5, "zz yy xx"), (6, " ".join(words(long[0])[5:30])), (10, " ".join(words(long[2])[3:13])), (None, " ".join(words(long[0])[8:40]))]
    return spark.createDataFrame(items, "item_id long, text string"), items


def test_decontamination(docs, nothing, benchmark):
    frame_, items = benchmark
    windows = defaultdict(set)
    for i, t in items:
        w = low(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[p : p + 10])].add(None if i is None else str(i))
    want = []
    for i, t, *_ in ROWS:
        w = low(t)
        hit, found = [False] * len(w), set()
        for n in {len(g) for g in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit[p : p + n] = [True] * n
                    found |= windows[tuple(w[p : p + n])]
        want.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest(), sum(hit) > 0))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sum(r[-1] for r in want) > 3
    assert collected(decontaminate.contamination(docs, frame_), *columns) == sorted(want, key=key)
    assert decontaminate.contamination(nothing, frame_).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, frame_.limit(0)).collect())
    cut = decontaminate.cut_benchmark(docs, frame_)
    assert cut.columns == docs.columns
    assert not decontaminate.contamination(cut, frame_).where("contaminated").count()
    same = {(r.doc_id, r.text) for r in cut.collect()}
    assert all((i, t) in same for (i, t, *_), w in zip(ROWS, want) if not w[-1])
    with pytest.raises(ValueError):
        decontaminate.contamination(docs, frame_) if False else decontaminate.decontaminate(docs, frame_, max_benchmark_bytes=3)


def test_blocks_of_items(docs, benchmark, monkeypatch):
    whole = collected(decontaminate.contamination(docs, benchmark[0]), "doc_id", "n_hit", "items_sha256")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    assert collected(decontaminate.contamination(docs, benchmark[0]), "doc_id", "n_hit", "items_sha256") == whole


def test_media(docs, nothing):
    import io
    import wave

    got = {}
    for r in media.media_digests(docs).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        stored = io.BytesIO()
        with wave.open(stored, "wb") as f:  # the standard library's own writer
            f.setnchannels(1)
            f.setsampwidth(1)
            f.setframerate(media.RATE)
            f.writeframes(payload)
        stored = stored.getvalue()
        with wave.open(io.BytesIO(stored)) as f:
            assert f.readframes(f.getnframes()) == payload
            feature = f"audio/wav;channels={f.getnchannels()};rate={f.getframerate()};bits={8 * f.getsampwidth()};samples={f.getnframes()};embedded=0"
        want = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
        assert want in got[i]
    assert media.media_digests(nothing).count() == 0


def samples():
    import gzip
    import io
    import struct
    import zipfile

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer\n<<>>\nstartxref\n28\n%%EOF"
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03\x00\x12\x34\xff\x00\x56\xff\xd9"
    box = lambda k, d: struct.pack(">I", 8 + len(d)) + k + d
    mp4 = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", b"\0" * 8)
    return {"image/png": png, "application/zip": z.getvalue(), "application/pdf": pdf, "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "application/gzip": gzip.compress(b"data"), "audio/wav": media.store_wave(b"ab" * 9), "video/mp4": mp4}


def test_sniffing_and_carving(spark):
    for kind, data in samples().items():
        assert media.inspect(data, "text/plain")[:2] == (kind, True), kind
        assert media.inspect(data, kind)[:2] == (kind, False)
        assert media.inspect(data[:-1], "text/plain")[0] == "text/plain", kind  # cut short
        assert media.carve(b"noise BM RIFF %PDF-" + data + b"more") == [(kind, data)], kind
    assert media.inspect(None, None) == (None, False, []) and media.inspect(b"", "a")[0] == "a"
    rows = [(k, bytearray(b"junk" + v), k) for k, v in samples().items()] + [("none", None, None)]
    out = media.inspect_media(spark.createDataFrame(rows, "name string, data binary, media_type string"), "data", "media_type").collect()
    assert all([e["type"] for e in r.embedded] == [r["name"]] for r in out if r["name"] != "none")


def test_revised_pdfs_and_large_boxes(spark):
    import struct
    import time

    pdf = samples()["application/pdf"]
    revised = pdf + b"\n2 0 obj\nendobj\nxref\ntrailer\nstartxref\n90\n%%EOF"
    assert media.carve(b"x " + revised + b" %%EOF noise " + pdf + b"tail") == [("application/pdf", revised), ("application/pdf", pdf)]
    box = lambda k, d: struct.pack(">I", 8 + len(d)) + k + d
    large = struct.pack(">I4sQ", 1, b"mdat", 16 + 5) + b"12345"
    for parts in ([box(b"moov", b"m" * 8), large], [large, box(b"emsg", b"e"), box(b"styp", b"s"), box(b"moov", b"m")], [box(b"moov", b"m"), struct.pack(">I", 0) + b"mdat" + b"rest"]):
        data = box(b"ftyp", b"isom\0\0\0\0") + b"".join(parts)
        assert media.inspect(data, "x")[0] == "video/mp4" and media.carve(b"junk" + data) == [("video/mp4", data)]
    begin = time.time()
    assert media.carve(b"%PDF-1.4 " * 200_000) == [] and time.time() - begin < 20
    rows = [(bytearray(b"junk" + pdf), "a", "b")]
    out = media.inspect_media(spark.createDataFrame(rows, "data binary, _data string, _declared string"), "data")
    assert out.columns[:3] == ["data", "_data", "_declared"] and out.first()[1:3] == ("a", "b")


def test_language(spark, nothing):
    de, en = "der die und das nicht ein für über schön".split(), "the and of that with this from have been".split()
    rows = [(i, " ".join((de if i % 2 else en)[(i * k) % 9] for k in range(1, 12)), "de" if i % 2 else "en", None, 0) for i in range(200)]
    odd = [(500, None, "en", None, 0), (501, "", "en", None, 0), (502, "12 -- !", "de", None, 0), (503, "ÜBER Schön", None, None, 0), (504, "нет", None, None, 0), (None, "the the", "en", None, 0)]
    out = langid.languages(frame(spark, rows + odd, True)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 206
    assert all(got[i].lang_pred == g for i, _, g, *_ in rows)
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "de" and got[504].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 and r.held_out == (crc(r.doc_id) % 5 == 0) for r in out)
    assert langid.languages(nothing).count() == 0
    assert {r.lang_pred for r in langid.languages(frame(spark, [(0, "abc", None, None, 0)])).collect()} == {"und"}


def brute(word, prob):
    """Sum over all segmentations, one by one."""
    total = [1.0] + [0.0] * len(word)
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            total[j] += total[i] * prob.get(word[i:j], 0.0)
    return total[-1]


def test_forward_sums_all_segmentations():
    import itertools

    import numpy as np

    pieces = [b"a", b"b", b"ab", b"aba", b"ba", b"abababab", b"baabbaabba"]
    theta = np.array([[0.3], [0.1], [0.25], [0.2], [0.15], [0.3], [0.2], [0.0]])
    p = langid.Pieces(pieces)
    prob = dict(zip(pieces, theta[:, 0]))
    word = b"abaabbaabbaabababab"
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        total += math.prod(prob.get(word[a:b], 0.0) for a, b in zip(at, at[1:]))
    ids = p.lattice(np.frombuffer(word, np.uint8)[None, :], len(word), np.array([len(word)]))
    assert abs(langid.forward(ids, theta)[0, -1, 0] / total - 1) < 1e-9 and abs(brute(word, prob) / total - 1) < 1e-9


def test_long_words_are_not_cut():
    import random

    import numpy as np

    r = random.Random(4)
    pieces = sorted({bytes(r.choice(b"abc") for _ in range(k)) for k in (1, 1, 1, 2, 3, 7, 9, 12, 20) for _ in range(9)})
    theta = np.append(np.random.default_rng(1).random((len(pieces), 2)) / len(pieces), np.zeros((1, 2)), axis=0)
    model = langid.Model(["x", "y"], langid.Pieces(pieces), theta)
    words_ = [bytes(r.choice(b"abc") for _ in range(k)) for k in (1, 2, 5, 47, 48, 49, 63, 64, 65, 66, 127, 128, 129, 150, 160, 3000)]
    r.shuffle(words_)
    ends = np.cumsum([len(w) for w in words_])
    got = model.log_words(np.frombuffer(b"".join(words_), np.uint8), ends - [len(w) for w in words_], ends)
    for w, row in zip(words_, got):
        for k in (0, 1):
            parts = [(0.0, 1.0)]  # exponent and mantissa
            prob, alpha, scale = dict(zip(pieces, theta[:, k])), [1.0], 0.0
            for j in range(1, len(w) + 1):
                x = sum(alpha[i] * prob.get(w[i:j], 0.0) for i in range(max(0, j - 20), j))
                alpha.append(x)
                if x < 1e-200:
                    alpha = [a * 1e200 for a in alpha[:-21]][:0] + [0.0] * max(0, len(alpha) - 21) + [a * 1e200 for a in alpha[-21:]]
                    scale += math.log(1e200)
            assert parts and abs(math.log(alpha[-1]) - scale - row[k]) < 1e-3 * len(w), len(w)


def test_language_query_against_plain_model(spark):
    """The same model, word by word in plain Python, over the table's whole texts."""
    import numpy as np
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    sample = [r for r in rows if r.text is not None and r.lang is not None and crc(r.doc_id) % 5 != 0]
    sample.sort(key=lambda r: (r.doc_id, r.text))
    model = langid.train(pa.table({"text": pa.array([r.text for r in sample]), "lang": pa.array([r.lang for r in sample])}))
    theta = model.theta.astype(np.float32).astype(np.float64)
    pieces = langid.read_pieces()
    tables = [dict(zip(pieces, theta[:, k])) for k in range(len(model.langs))]
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    known = {}
    for r in rows:
        text = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in r.text or "")
        found = re.findall(rb"[a-z\x80-\xff]+", text.encode())
        if len(found) > 3000:
            continue
        log = np.zeros(len(tables))
        for w in found:
            if w not in known:
                known[w] = np.array([math.log(brute(w[:400], t)) for t in tables]) if len(w) < 400 else None
            if known[w] is None:
                break
            log += known[w]
        else:
            if found:
                best = int(log.argmax())
                share = 1 / np.exp(np.clip(log - log.max(), -700, 0)).sum()
                assert got[r.doc_id].lang_pred == model.langs[best] and abs(got[r.doc_id].score - share) < 1e-3
            else:
                assert got[r.doc_id].lang_pred == "und"


def test_samples_of_any_size(spark):
    from larkspur.llm.labelled import bounded, share

    rows = spark.range(1, 40_000).selectExpr("id", "id % 3 as y").union(spark.range(1).selectExpr("-1L", "null"))
    got = {r.y: r["count"] for r in bounded(rows, "y", 500).groupBy("y").count().collect()}
    assert got[None] == 1 and all(abs(got[k] - 500) < 100 for k in range(3))
    faked = spark.range(1).select(*(share(F.lit(n).cast("long"), 500).alias(f"n{n}") for n in (1, 500, 10**6, 10**12))).first()
    assert faked.n1 == faked.n500 >= (1 << 63) - 2048 and abs(faked.n1000000000000 / (1 << 63) - 5e-10) < 1e-15
    many = spark.range(3000).selectExpr("id", "cast(id % 1500 as string) as y")
    assert bounded(many, "y", 2).count() == 3000


def labelled(n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, ("WIN!! NOW!! " if bad else "we read and wrote ") * 5 + f"word{i} " * 3 + ("scumbag" if i % 4 == 0 else "friend") + " and more of it " * 3, "en", "s", 0))
        labels.append((i, 0 if bad else 1, 1 if i % 4 == 0 else 0))
    return rows, labels


def test_classifiers(spark, nothing):
    rows, labels = labelled()
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "we read", None, None, None), rows[0]]
    labels += [labels[0], (None, 1, 1), (7777, 1, None)]
    df, lab = frame(spark, rows, True), spark.createDataFrame(labels, LABELS)
    y = {i: (q, t) for i, q, t in labels[:400]}
    for f, k, folds, held, cut in ((quality.quality_scores, 0, 5, 0, 0.3), (toxicity.toxicity_scores, 1, 3, 1, 0.7)):
        out = f(df, lab).collect()
        assert len(out) == len(rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (crc(r.doc_id) % folds == held) for r in out)
        right = [r.predicted == y[r.doc_id][k] for r in out if r.doc_id in y and r.held_out]
        assert sum(right) / len(right) > 0.95, f
        again = {r.doc_id: r.score for r in f(df, lab).collect()}
        assert all(again[r.doc_id] == r.score for r in out)
        assert f(nothing, lab).count() == 0
        assert {r.predicted for r in f(df, lab.limit(0)).collect()} <= {0, 1}


def test_quality_against_plain_model(spark):
    """FTRL over the same hashed n-grams with dictionaries and Python floats, and the query's scores over whole texts."""
    import numpy as np
    import pyarrow as pa

    from larkspur.llm import kernel as K

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in text and crc(r.doc_id) % 5 != 0}

    def word_hash(word):
        b = word.encode()
        return K.hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]

    def shape(word):
        out = []
        for c in word.encode():
            s = 97 if 97 <= c <= 122 or 0xA0 <= c < 0xC0 else 65 if 65 <= c <= 90 or 0x80 <= c < 0xA0 else 48 if 48 <= c <= 57 else 0 if c >= 0xC0 else c
            if s and (not out or out[-1] != s):
                out.append(s)
        b = bytes(out)
        return K.hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), 21)[0] if b else None

    known = {}

    def vector(t):
        out = {1 << quality.BITS: 1.0}
        w = words(t)
        for x in w:
            if x not in known:
                known[x] = word_hash(x), shape(x)
        h = np.array([known[x][0] for x in w], np.uint64)
        s = np.array([known[x][1] for x in w], np.uint64)
        for kind, (seq, n) in enumerate(((h, 1), (h, 2), (s, 1), (s, 2), (s, 3))):
            grams = [int(K.ngram_hashes(seq[k : k + n], n, kind + 1)[0] >> np.uint64(64 - quality.BITS)) for k in range(len(w) - n + 1)]
            for g, c in Counter(grams).items():
                out.setdefault(g, 0.0)
                out[g] += c / len(grams)
            if kind == 1 and grams:
                for g, c in Counter(int(w[k] == w[k + 1]) for k in range(len(w) - 1)).items():
                    out.setdefault(g, 0.0)
                    out[g] += c / len(grams)
        return out

    keep = [i for i in sorted(y) if len(words(text[i])) < 1500 and all(x for x in map(shape, set(words(text[i]))))]
    texts = pa.array([text[i] for i in keep])
    truth = np.array([y[i] for i in keep], np.float64)
    weights = quality.train(texts, truth)
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -math.copysign(abs(z[i]) - quality.L1, z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    rows, rng = [vector(text[i]) for i in keep], np.random.default_rng(1)
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(len(rows)):
            w = {i: weight(i) for i in rows[k]}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in rows[k].items())))
            for i, x in rows[k].items():
                g = (p - truth[k]) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    got = quality.scores(weights, texts)
    want = [1 / (1 + math.exp(-sum(weight(i) * x for i, x in v.items()))) for v in rows]
    assert np.abs(got - want).max() < 0.02 and len(keep) > 20
    # the query over whole texts is the same model, trained on all labelled rows
    sample = sorted(y)
    model = quality.train(pa.array([text[i] for i in sample]), np.array([y[i] for i in sample], np.float64))
    for r in quality.quality_scores(docs, labels).collect():
        assert abs(r.score - quality.scores(model, pa.array([text[r.doc_id]]))[0]) < 1e-9


def test_network_gradient():
    import numpy as np
    import pyarrow as pa

    from larkspur.llm import kernel as K

    texts = pa.array(["one two three loweibad", "two three four five six " * 9])
    (_, _, buf, offsets), = K.chunks(texts)
    v = toxicity.Vocabulary(buf, offsets)
    net = toxicity.Network([np.arange(1 << toxicity.BITS, dtype=np.int32) % 997 for _ in range(3)])
    for n in ("fx", "fb", "fu", "bx", "bb", "bu", "v", "w", "c"):
        setattr(net, n, getattr(net, n).astype(np.float64))
    start, length, _ = v.windows()
    words_, real = v.at(start, length)
    x = net.inputs(v.kinds).astype(np.float64)
    y, weight = np.arange(len(start)) % 2, np.ones(len(start))

    def loss():
        z = net.logits(net.gates(x), words_, real)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grad, dx = net._gradient(x, words_, real, y, weight)
    rng = np.random.default_rng(0)
    for n, g in [*grad.items(), ("x", dx)]:
        a = x if n == "x" else getattr(net, n)
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in a.shape)
            old = a[i]
            a[i] = old + 1e-3
            up = loss()
            a[i] = old - 1e-3
            down = loss()
            a[i] = old
            assert abs((up - down) / 2e-3 - g[i]) < 1e-4, n


def test_lm(docs, nothing):
    text = [(i, re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for i, t, *_ in ROWS]
    seqs = [(i, [*words(t), None]) for i, t in text]
    train = [s for i, s in seqs if crc(i) % 7 != 2]
    c = Counter(w for s in train for w in s)
    N, V = sum(c.values()), len(c)
    pairs = Counter(p for s in train for p in zip(["<s>", *s], s))
    a, total, kinds = Counter(w for _, w in pairs), Counter(), defaultdict(Counter)
    for (v, w), n in pairs.items():
        total[v] += n
        kinds[v][min(n, 3)] += 1
    d2 = lmscore.discounts(*(Counter(pairs.values())[k] for k in (1, 2, 3, 4)))
    d1 = lmscore.discounts(*(Counter(a.values())[k] for k in (1, 2, 3, 4)))
    g1 = sum(d1[min(n, 3) - 1] for n in a.values()) / len(pairs)

    def p1(w):
        return (a[w] - d1[min(a[w], 3) - 1] if a[w] else 0) / len(pairs) + g1 / (V + 1)

    def p2(v, w):
        if v not in total:
            return p1(w)
        n = pairs[v, w]
        return (n - d2[min(n, 3) - 1] if n else 0) / total[v] + sum(d2[k - 1] * m for k, m in kinds[v].items()) / total[v] * p1(w)

    assert abs(sum(p2("<s>", w) for w in a) + p2("<s>", "not there") * (V + 1 - len(a)) - 1) < 1e-9
    got = defaultdict(list)
    for r in lmscore.model_scores(docs, order=2).collect():
        got[r.doc_id].append(tuple(r))
    for i, s in seqs:
        base = sum(math.log10((c[w] + 1) / (N + V + 1)) for w in s)
        score = sum(math.log10(p2(v, w)) for v, w in zip(["<s>", *s], s))
        want = (i, crc(i) % 7 == 2, len(s), sum(w in c for w in s), N)
        assert any(r[:5] == want and abs(r[5] - base) < 1e-6 and abs(r[6] - score) < 1e-6 for r in got[i])
    assert lmscore.model_scores(nothing).count() == 0


def test_extra_columns_do_not_matter(spark):
    a = collected(lmscore.model_scores(frame(spark, ROWS)), "doc_id", "n_tokens", "n_known")
    assert a == collected(lmscore.model_scores(frame(spark, ROWS, True)), "doc_id", "n_tokens", "n_known")


def test_all_train_or_none(spark):
    one = lmscore.model_scores(frame(spark, [(next(i for i in range(99) if crc(i) % 7 == 2), "a b", None, None, 0)])).collect()[0]
    assert one.train_tokens == 0 and one.base_score == 0 and one.score == 0 and one.n_known == 0 and one.n_tokens == 3
    assert F is not None
