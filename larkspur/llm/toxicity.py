"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text's words (ASCII letters, digits and all non-ASCII, lower-cased) are read in windows of `WINDOW` words, each starting
`STRIDE` after the one before, so that neighbours overlap; the last window reaches the last word. A word's input is its
embedding and the means of the embeddings of its inner and of its leading character grams; words and grams that fewer than
`SEEN` training documents have share a zero embedding. Forward and backward states are pooled by attention, a window's score
is the sigmoid of a linear form, a text's score that of its highest window. The network is trained in numpy on at most about
`limit` labelled documents of each class. Labels mark documents, not windows: the first round trains on windows drawn from
each document, later ones on those that the network itself scores highest, and on others drawn from label 0.

Edge cases: null, empty and wordless texts score 0; without labels of both classes every text with words scores the share
of label 1; repeated ids count once in training, with their larger label; repeated rows score alike. Extra columns are
not read.

The task that trains leaves the tables in the shared folder, where workers map them; through the driver go the small weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernel as K
from larkspur.llm.labelled import fit_in_task, fold, labelled_sample
from larkspur.llm.shared import map_array, put_arrays, shared_dir

LIMIT = 3000
WINDOW, STRIDE = 96, 48
BITS = 20  # of the buckets of words, and of grams of each kind
SEEN = 4
D, H = 8, 12  # sizes of each embedding, and of a direction's state
INPUTS = 3 * D
DROPPED = 0.3  # embeddings left out in training
THRESHOLD = 0.7
CHUNK = 1 << 20
ROWS = 2048  # windows scored at once
BATCH, ROUNDS, RATE, TABLE_RATE = 192, (4, 2, 2), 0.01, 0.05  # epochs of each round
DRAWN = 3  # windows of a document in the first round
UP = 1.5  # weight of label 1 where it is rarer, at most
INNER = (5,)  # bytes of grams anywhere in a word
LEADING = (4, 5, 6, 7, 8)  # of those at its start


def char_grams(w: K.Words, buf: np.ndarray, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the inner and of the leading character grams of some words, and their bounds per word; each kind has the
    whole word too, so none is empty."""
    starts, ends = w.starts[which], w.ends[which]
    size = ends - starts
    out = []
    for kind, sizes in enumerate((INNER, LEADING)):
        at, end, owner, salt = [starts], [ends], [np.arange(len(which))], [np.zeros(len(which), np.uint64)]
        for n in sizes:
            count = np.maximum(size - n + 1, 0) if kind == 0 else (size > n).astype(np.int64)
            own = np.repeat(np.arange(len(which)), count)
            begin = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[own]
            at.append(begin)
            end.append(begin + n)
            owner.append(own)
            salt.append(np.full(len(own), n, np.uint64))
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        grams = K.mix(K.hashes(buf, np.concatenate(at), np.concatenate(end), 90 + kind) + np.concatenate(salt))[order]
        out.append(((grams >> np.uint64(64 - BITS)).astype(np.int32), np.searchsorted(owner[order], np.arange(len(which) + 1)).astype(np.int32)))
    return out


class Vocabulary:
    """The distinct words of a chunk: word buckets, character buckets; and the windows of each document over them."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        w = K.split_words(buf, offsets, K.ALNUM, lower=True)
        self.first = w.first
        hashes, at, word = np.unique(w.hashes, return_index=True, return_inverse=True)
        self.word = word.astype(np.int32)
        bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
        #: words, inner grams, leading grams: buckets and bounds per distinct word
        self.kinds = [(bucket, np.arange(len(bucket) + 1, dtype=np.int32)), *char_grams(w, K.LOWER[buf], at)]

    def some(self, u: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The kinds of some distinct words."""
        out = []
        for buckets, bounds in self.kinds:
            size = bounds[u + 1] - bounds[u]
            end = np.cumsum(size)
            out.append((buckets[np.arange(size.sum()) - np.repeat(end - size, size) + np.repeat(bounds[u], size)], np.concatenate([[0], end]).astype(np.int32)))
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length, and document of each window."""
        sizes = np.diff(self.first)
        count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(sizes)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.minimum(k * STRIDE, np.maximum(sizes[doc] - WINDOW, 0))
        return self.first[doc] + start, np.minimum(sizes[doc], WINDOW), doc

    def at(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct-word numbers (windows x longest, 0 where short) and the mask of real words."""
        place = np.arange(length.max(initial=1))
        real = place < length[:, None]
        return np.where(real, self.word[np.minimum(start[:, None] + place, len(self.word) - 1)], 0), real


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def segment_sums(x: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of x by their number in to, n of them."""
    out = np.zeros((n, x.shape[1]), x.dtype)
    if len(to):
        order = np.argsort(to, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0]))
        out[to[order[at]]] = np.add.reduceat(x[order], at, axis=0)
    return out


class Network:
    """places: of each kind, the row of a bucket's embedding; row 0 is zero and stays so."""

    def __init__(self, places: list[np.ndarray], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        r = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.folder, self.sizes = "", [int(p.max(initial=0)) + 1 for p in places]
        self.places = places
        self.embeddings = [rng.normal(0, 0.05, (n, D)).astype(np.float32) for n in self.sizes]
        for e in self.embeddings:
            e[0] = 0
        self.fx, self.fb, self.fu = r(INPUTS, 3 * H), np.zeros(3 * H, np.float32), r(H, 3 * H)
        self.bx, self.bb, self.bu = r(INPUTS, 3 * H), np.zeros(3 * H, np.float32), r(H, 3 * H)
        self.v, self.w, self.c = r(2 * H), r(2 * H), np.full(1, -1, np.float32)

    def store(self, folder: str) -> Network:
        """Leaves the tables in the folder; from there they are mapped where the network is sent."""
        put_arrays(f"{folder}/network", **{f"{name}{k}": x for name in ("places", "embeddings") for k, x in enumerate(getattr(self, name))})
        self.folder = folder
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not self.folder or k not in ("places", "embeddings")}

    def __getattr__(self, name: str) -> list[np.ndarray]:
        """Tables are mapped when first used, so never on the driver."""
        if name not in ("places", "embeddings"):
            raise AttributeError(name)
        kind, shape = (np.int32, (-1,)) if name == "places" else (np.float32, (-1, D))
        self.__dict__[name] = [np.asarray(map_array(f"{self.folder}/network.{name}{k}", kind)).reshape(shape) for k in range(3)]
        return self.__dict__[name]

    def inputs(self, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Input of each distinct word."""
        if len(kinds[0][1]) < 2:
            return np.zeros((1, INPUTS), np.float32)
        parts = []
        for table, places, (buckets, bounds) in zip(self.embeddings, self.places, kinds, strict=True):
            rows = table[places[buckets]]
            parts.append(np.add.reduceat(rows, bounds[:-1], axis=0) / np.diff(bounds)[:, None] if len(rows) > len(bounds) - 1 else rows)
        return np.concatenate(parts, axis=1, dtype=np.float32)

    def run(self, gates: np.ndarray, u: np.ndarray, words: np.ndarray, real: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
        """States (T, rows, H); keep gets what the backward pass needs. gates: of each distinct word."""
        h = np.zeros((len(words), H), np.float32)
        steps = words.shape[1]
        out = np.empty((steps, len(words), H), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            g = gates[words[:, t]]
            a = h @ u
            zr = 0.5 * np.tanh(0.5 * (g[:, : 2 * H] + a[:, : 2 * H])) + 0.5
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(g[:, 2 * H :] + r * a[:, 2 * H :])
            new = n + z * (h - n)
            m = real[:, t]
            if not m.all():
                new = np.where(m[:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, a[:, 2 * H :]))
            h = out[t] = new
        return out

    def pool(self, hf: np.ndarray, hb: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate([hf, hb], axis=2)
        a = np.where(real.T, h @ self.v, -1e9)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        return h, a, np.einsum("tb,tbh->bh", a, h) @ self.w + self.c[0]

    def logits(self, gates: tuple[np.ndarray, np.ndarray], words: np.ndarray, real: np.ndarray) -> np.ndarray:
        return self.pool(self.run(gates[0], self.fu, words, real, False), self.run(gates[1], self.bu, words, real, True), real)[2]

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.fx + self.fb, x @ self.bx + self.bb

    def window_logits(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        start, length, doc = v.windows()
        gates = self.gates(self.inputs(v.kinds))
        out = np.empty(len(start))
        order = np.argsort(length, kind="stable")  # windows of a length take as many steps
        for i in range(0, len(start), ROWS):
            some = order[i : i + ROWS]
            out[some] = self.logits(gates, *v.at(start[some], length[some]))
        return out, start, length, doc

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Highest window score of each document; 0 without words."""
        out = np.zeros(len(offsets) - 1)
        v = Vocabulary(buf, offsets)
        if len(v.word):
            logits, _, _, doc = self.window_logits(v)
            at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[doc[at]] = _sigmoid(np.maximum.reduceat(logits, at))
        return out

    def _gradient(self, x: np.ndarray, words: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        gf, gb = self.gates(x)
        kept_f, kept_b = [], []
        hf, hb = self.run(gf, self.fu, words, real, False, kept_f), self.run(gb, self.bu, words, real, True, kept_b)
        h, a, logit = self.pool(hf, hb, real)
        d = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        pooled = np.einsum("tb,tbh->bh", a, h)
        grad = {"w": d @ pooled, "c": d.sum(keepdims=True)}
        dp = d[:, None] * self.w
        da = np.einsum("tbh,bh->tb", h, dp)
        ds = a * (da - (a * da).sum(axis=0))
        grad["v"] = np.einsum("tb,tbh->h", ds, h)
        dh = a[:, :, None] * dp + ds[:, :, None] * self.v
        dx = np.zeros_like(x)
        to = words.T.ravel()
        for name, kept, part, wx, u in (("f", kept_f, dh[:, :, :H], self.fx, self.fu), ("b", kept_b, dh[:, :, H:], self.bx, self.bu)):
            carry = np.zeros((len(y), H), x.dtype)
            du, steps = np.zeros_like(u), np.zeros((words.shape[1], len(y), 3 * H), x.dtype)
            for t, h0, z, r, n, an in reversed(kept):
                m = real[:, t][:, None]
                total = carry + part[t]
                g = np.where(m, total, 0)
                dn = g * (1 - z) * (1 - n * n)
                pre = np.concatenate([g * (h0 - n) * z * (1 - z), dn * an * r * (1 - r), dn * r], axis=1)
                du += h0.T @ pre
                carry = np.where(m, g * z + pre @ u.T, total)
                steps[t, :, : 2 * H], steps[t, :, 2 * H :] = pre[:, : 2 * H], dn
            dg = segment_sums(steps.reshape(-1, 3 * H), to, len(x))
            grad[name + "u"], grad[name + "x"], grad[name + "b"] = du, x.T @ dg, dg.sum(axis=0)
            dx += dg @ wx.T
        return grad, dx

    def fit(self, batches: list[tuple], epochs: int, state: dict, rng: np.random.Generator) -> None:
        """batches: (kinds, words, real, y, weight) over the batch's own distinct words."""
        for _ in range(epochs):
            for kinds, words, real, y, weight in batches:
                x = self.inputs(kinds)
                kept = (rng.random((len(x), 3)) >= DROPPED).repeat(D, axis=1).astype(np.float32) / (1 - DROPPED)
                x *= kept
                grad, dx = self._gradient(x, words, real, y, weight)
                dx *= kept
                state["t"] += 1
                for name, g in grad.items():  # Adam
                    m, s = state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    getattr(self, name)[...] -= RATE * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(s / (1 - 0.999 ** state["t"])) + 1e-8)
                for k, (buckets, bounds) in enumerate(kinds):  # Adagrad
                    size = np.diff(bounds)
                    rows = self.places[k][buckets]
                    g = (dx[:, k * D : k * D + D] / size[:, None]).repeat(size, axis=0)[rows > 0]
                    u, inverse = np.unique(rows[rows > 0], return_inverse=True)
                    total = segment_sums(g, inverse, len(u))
                    seen = state.setdefault(k, np.full(self.sizes[k], 1e-8, np.float32))
                    seen[u] += (total * total).mean(axis=1)
                    self.embeddings[k][u] -= TABLE_RATE * total / np.sqrt(seen[u])[:, None]


def merged(vocabularies: list[Vocabulary]) -> Vocabulary:
    """Several chunks as one; a word of two chunks stands for itself in each."""
    out = object.__new__(Vocabulary)
    sizes = np.concatenate([[0], np.cumsum([len(v.kinds[0][0]) for v in vocabularies])])
    out.word = np.concatenate([v.word + base for v, base in zip(vocabularies, sizes, strict=False)]).astype(np.int32)
    out.first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(v.first) for v in vocabularies]))])
    out.kinds = [(np.concatenate([v.kinds[k][0] for v in vocabularies]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(v.kinds[k][1]) for v in vocabularies]))]).astype(np.int32)) for k in range(3)]
    return out


def _batches(v: Vocabulary, start: np.ndarray, length: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Windows in batches of alike lengths. Classes weigh alike, up to a factor of UP."""
    out = []
    up = min(UP, max(1.0, (len(y) - y.sum()) / max(y.sum(), 1)))
    order = np.lexsort((rng.random(len(y)), length))
    parts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    for k in rng.permutation(len(parts)):
        words, real = v.at(start[parts[k]], length[parts[k]])
        u, place = np.unique(words, return_inverse=True)
        own = y[parts[k]].astype(np.float32)
        out.append((v.some(u), place.reshape(words.shape).astype(np.int32), real, own, np.where(own > 0, up, 1).astype(np.float32)))
    return out


def seen_places(v: Vocabulary) -> list[np.ndarray]:
    """Of each kind, a row number for the buckets that SEEN documents have, 0 for the others."""
    counts = [np.zeros(1 << BITS, np.int32) for _ in range(3)]
    for d in range(len(v.first) - 1):
        u = np.unique(v.word[v.first[d] : v.first[d + 1]])
        for k, (buckets, _) in enumerate(v.some(u) if len(u) else ()):
            counts[k][np.unique(buckets)] += 1
    return [np.where(c >= SEEN, np.cumsum(c >= SEEN), 0).astype(np.int32) for c in counts]


def _highest(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The first window of each document with the highest value."""
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    pick = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, at), np.diff(np.append(at, len(doc)))))
    return pick[np.unique(doc[pick], return_index=True)[1]]


def train(texts: pa.Array, y: np.ndarray) -> Network | None:
    if not 0 < y.sum() < len(y):
        return None
    rng = np.random.default_rng(3)
    v = merged([Vocabulary(buf, offsets) for _, _, buf, offsets in K.chunks(texts, CHUNK)])
    if not len(v.word):
        return None
    network = Network(seen_places(v))
    start, length, doc = v.windows()
    state: dict = {"t": 0}
    for turn, epochs in enumerate(ROUNDS):
        drawn = [_highest(rng.random(len(doc)), doc) for _ in range(1 if turn else DRAWN)]
        if turn:
            drawn = [drawn[0][y[doc[drawn[0]]] == 0], _highest(network.window_logits(v)[0], doc)]
        rows = np.unique(np.concatenate(drawn))
        network.fit(_batches(v, start[rows], length[rows], y[doc[rows]], rng), epochs, state, rng)
    return network


def _scores(network: Network | None, share: float, texts: pa.Array) -> np.ndarray:
    parts = [np.zeros(0)]
    for _, _, buf, offsets in K.chunks(texts, CHUNK):
        parts.append(network.score(buf, offsets) if network else share * (np.diff(K.split_words(buf, offsets, K.ALNUM).first) > 0))
    return np.concatenate(parts)


def _score(network: Network | None, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(_scores(network, share, batch["text"]))], names=["id", "held_out", "score"])

    return run


def _keep(network: Network | None, share: float, threshold: float, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(network, share, batch[column]) < threshold))

    return run


def _train(folder: str):
    def run(sample: pa.Table) -> tuple[Network | None, float]:
        y = sample["y"].to_numpy().astype(np.float64)
        network = train(sample["text"].combine_chunks(), y)
        return network and network.store(folder), float(y.mean()) if len(y) else 0.0

    return run


def _fit(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int, id_col: str, text_col: str) -> tuple[Network | None, float]:
    return fit_in_task(labelled_sample(docs, labels, label, folds, held_out, limit, id_col, text_col), _train(shared_dir(docs.sparkSession)))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, limit: int = LIMIT, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score (0 to 1) and predicted of every row."""
    model = _fit(docs, labels, label, folds, held_out, limit, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_score(*model), f"id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, limit: int = LIMIT, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose score reaches the threshold; text_col is a string column."""
    model = _fit(docs, labels, label, folds, held_out, limit, id_col, text_col)
    return docs.mapInArrow(_keep(*model, threshold, text_col), docs.schema)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The op10 digest."""
    return score_toxicity(documents, labels)
