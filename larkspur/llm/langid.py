"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by a forward algorithm; that of a text is the product over its words (maximal runs of
letters, Latin capitals lower-cased), however long: all letter pieces of the vocabulary take part, and probabilities carry
a scale, so that none underflows. Piece probabilities come from expectation maximisation with forward-backward counts over a
bounded sample of training documents (`limit` for each language; words of more than RUN bytes are counted in runs).

Edge cases: a text that is null or has no letter is `und` with score 0; without any training document every text is `und`;
a null language is never learned; ties go to the language first in code point order; repeated rows get equal results.
Extra columns are not read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernel as K
from larkspur.llm.labelled import bounded, fit_in_task, fold
from larkspur.llm.shared import materialize, shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LIMIT = 500
ROUNDS = 4
RUN = 48  # bytes of a run in training; scoring never cuts
STEPS = 64  # bytes of a word that are looked up at once
SMALL = 200_000  # sampled ids that are sent to all executors; more are joined by a shuffle
CACHE = 1 << 23  # numbers kept for words seen before
_SMALL, _SCALE = 1e-100, 1e100

_b = np.arange(256)
LETTERS = ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 0x80)


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file, one `base64 rank` a line: those of letters alone, without the space before a word, and all single
    letter bytes."""
    pieces = {bytes([i]) for i in range(256) if LETTERS[i]}
    with open(path, "rb") as f:
        for line in f:
            piece = base64.b64decode(line.split()[0]).lower().removeprefix(b" ")
            if piece and LETTERS[list(piece)].all():
                pieces.add(piece)
    return sorted(pieces)


def _longer(key: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of runs that are one byte longer."""
    x = (key ^ (codes.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Pieces:
    def __init__(self, pieces: list[bytes]) -> None:
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        #: of each length, hashes in order and the pieces' numbers
        self.of_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(p) for p in pieces}):
            at = np.array([i for i, p in enumerate(pieces) if len(p) == size])
            codes = np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(-1, size)
            key = np.zeros(len(at), np.uint64)
            for k in range(size):
                key = _longer(key, codes[:, k])
            order = np.argsort(key)
            self.of_size[size] = key[order], at[order]

    def lattice(self, codes: np.ndarray, steps: int, left: np.ndarray) -> np.ndarray:
        """codes: rows of bytes, of which `left` count. [row, i, size - 1]: the piece of `size` bytes at byte i < steps, or self.n."""
        rows, width = codes.shape
        out = np.full((rows, steps, min(self.longest, max(width, 1))), self.n, np.int32)
        key = np.zeros((rows, steps), np.uint64)
        for size in range(1, out.shape[2] + 1):
            n = min(steps, width - size + 1)
            if n <= 0:
                break
            key = _longer(key[:, :n], codes[:, size - 1 : size - 1 + n])
            if size in self.of_size:
                keys, numbers = self.of_size[size]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = (keys[at] == key) & (np.arange(n) + size <= left[:, None])
                out[:, :n, size - 1][there] = numbers[at[there]]
        return out


def forward(ids: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """alpha[row, i]: probability of the first i bytes, summed over segmentations; theta has a last row of zeros."""
    rows, length, sizes = ids.shape
    alpha = np.zeros((rows, length + 1, theta.shape[1]))
    alpha[:, 0] = 1
    for i in range(length):
        n = min(sizes, length - i)
        alpha[:, i + 1 : i + 1 + n] += alpha[:, i, None] * theta[ids[:, i, :n]]
    return alpha


def log_forward(pieces: Pieces, theta: np.ndarray, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log probability of words in order of length, of any length: STEPS bytes at a time, with a scale for each word and
    language."""
    rows, langs, longest = len(starts), theta.shape[1], int(sizes[-1])
    span = min(pieces.longest, longest)
    alpha = np.zeros((rows, min(STEPS, longest) + span + 1, langs))
    alpha[:, 0] = 1
    scale, out, done = np.zeros((rows, langs)), np.zeros((rows, langs)), 0
    for base in range(0, longest + 1, STEPS):
        steps = min(STEPS, longest - base)
        place = starts[:, None] + base + np.arange(steps + span)
        ids = pieces.lattice(buf[np.minimum(place, len(buf) - 1)], steps, sizes - base) if steps else None
        for i in range(min(STEPS, longest + 1 - base)):
            if done < rows and sizes[done] == base + i:
                ended = int(np.searchsorted(sizes, base + i, "right"))
                out[done:ended] = np.log(np.maximum(alpha[done:ended, i], 1e-300)) - scale[done:ended] * math.log(_SCALE)
                done = ended
            if done == rows:
                return out
            if i % 8 == 0:
                low = (alpha[:, i] < _SMALL) & (alpha[:, i] > 0)
                if low.any():
                    alpha[:, i:] *= np.where(low, _SCALE, 1)[:, None]
                    scale += low
            alpha[:, i + 1 : i + 1 + span] += alpha[:, i, None] * theta[ids[:, i, :span]]
        alpha[:, : span + 1] = alpha[:, STEPS : STEPS + span + 1]
        alpha[:, span + 1 :] = 0
    return out


def by_length(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Word numbers in order of length, in groups of alike lengths that bound the work at once."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        least = int(sizes[order[at]])
        end = int(np.searchsorted(sizes[order], least + least // 4, "right"))
        end = min(end, at + max(1, (1 << 18) // min(least, STEPS)))
        yield order[at:end]
        at = end


def expect(pieces: Pieces, words: list[tuple[np.ndarray, np.ndarray]], theta: np.ndarray) -> np.ndarray:
    """Expected piece counts; words: (lattice, counts per language) of words of one length."""
    total = np.zeros_like(theta)
    for ids, counts in words:
        alpha = forward(ids, theta)
        length = ids.shape[1]
        beta = np.zeros_like(alpha)
        beta[:, length] = 1
        scale = counts / np.maximum(alpha[:, length], 1e-300)
        for i in range(length - 1, -1, -1):
            n = min(ids.shape[2], length - i)
            pair = theta[ids[:, i, :n]] * beta[:, i + 1 : i + 1 + n]
            beta[:, i] = pair.sum(axis=1)
            gain = (alpha[:, i] * scale)[:, None] * pair
            at = ids[:, i, :n].ravel()
            real = np.flatnonzero(at < pieces.n)
            for k in range(theta.shape[1]):
                total[:, k] += np.bincount(at[real], gain[:, :, k].ravel()[real], len(theta))
    total[-1] = 0
    return total


def _letters(buf: np.ndarray) -> np.ndarray:
    """Lower-cased bytes: ASCII, and the two-byte Latin-1 capitals."""
    buf = K.LOWER[buf]
    if len(buf) > 1:
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        buf[1:][capital] += 0x20
    return buf


def _words(buf: np.ndarray, offsets: np.ndarray) -> K.Words:
    """Runs of letters."""
    return K.split_words(_letters(buf), offsets, LETTERS)


class Model:
    def __init__(self, langs: list[str], pieces: Pieces, theta: np.ndarray) -> None:
        self.langs, self.pieces, self.theta = langs, pieces, theta
        slots = 1 << ((CACHE // max(len(langs), 1)).bit_length() - 1)
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.known, self.values = np.zeros(slots, np.uint64), np.zeros((slots, len(langs)), np.float32)

    def log_words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), len(self.langs)), np.float32)
        sizes = ends - starts
        for some in by_length(sizes):
            out[some] = log_forward(self.pieces, self.theta, buf, starts[some], sizes[some])
        return out

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log probability of each text under each language. Values of words seen before are kept, one for each slot."""
        w = _words(buf, offsets)
        if not len(w.hashes) or not self.langs:
            return np.zeros((w.n_docs, len(self.langs)))
        hashes, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        slot = hashes >> self.shift
        value = self.values[slot]
        new = np.flatnonzero((self.known[slot] != hashes) | (hashes == 0))
        if len(new):
            value[new] = self.log_words(w.buf, w.starts[first[new]], w.ends[first[new]])
            last = new[np.append(slot[new][1:] != slot[new][:-1], True)]
            self.known[slot[last]], self.values[slot[last]] = hashes[last], value[last]
        return K.segment_sum(value[inverse].astype(np.float64), w.first)


def train(sample: pa.Table, vocabulary: list[bytes] | None = None, rounds: int = ROUNDS) -> Model:
    """sample: text, lang; vocabulary: pieces, those of VOCABULARY if None."""
    langs = sorted(set(sample["lang"].to_pylist()))
    place = {x: k for k, x in enumerate(langs)}
    pieces = Pieces(vocabulary or read_pieces())
    number = np.array([place[x] for x in sample["lang"].to_pylist()], np.int64)
    counted: dict[bytes, np.ndarray] = {}
    for row, _, buf, offsets in K.chunks(sample["text"].combine_chunks()):
        w = _words(buf, offsets)
        lang = number[row + w.doc()]
        for s, e, k in zip(w.starts.tolist(), w.ends.tolist(), lang.tolist(), strict=True):
            for at in range(s, e, RUN):
                counted.setdefault(w.buf[at : min(at + RUN, e)].tobytes(), np.zeros(len(langs)))[k] += 1
    lattices = []
    for size in sorted(set(map(len, counted))):
        own = [x for x in counted if len(x) == size]
        codes = np.frombuffer(b"".join(own), np.uint8).reshape(-1, size)
        lattices.append((pieces.lattice(codes, size, np.full(len(own), size)), np.array([counted[x] for x in own])))
    theta = np.zeros((pieces.n + 1, len(langs)))
    theta[:-1] = 1 / pieces.n
    for _ in range(rounds):
        total = expect(pieces, lattices, theta)[:-1]
        # each piece is smoothed towards its share over all languages
        everywhere = (total.sum(axis=1) + 0.01) / (total.sum() + 0.01 * pieces.n)
        theta[:-1] = (total + 50 * everywhere[:, None]) / (total.sum(axis=0) + 50)
    return Model(langs, pieces, theta)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    log = [np.zeros((0, len(model.langs)))]
    plain = [np.zeros(0, bool)]
    ascii_letter = LETTERS & (_b < 0x80)
    for _, _, buf, offsets in K.chunks(texts):
        log.append(model.texts(buf, offsets))
        plain.append(K.segment_any(ascii_letter[buf], offsets))
    log, letters = np.concatenate(log), np.concatenate(plain)
    for i in np.flatnonzero(~letters):  # no ASCII letter: look at the characters themselves
        letters[i] = _has_letter(texts[i].as_py())
    if not model.langs:
        return ["und"] * len(log), np.zeros(len(log))
    best = log.argmax(axis=1)
    share = 1 / np.exp(np.clip(log - log.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
    return [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, share, 0.0)


def _predict(langs: list[str], pieces: Pieces, theta: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(langs, pieces, theta)
        for batch in batches:
            names, share = predict(model, batch["text"])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(names, pa.string()), pa.array(share)], names=["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0, limit: int = LIMIT, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred and score (the language's share of the probability) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.where("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL")
    chosen = materialize(bounded(known.select("id", "lang"), "lang", limit).distinct(), shared_dir(docs.sparkSession), "sample")
    if chosen.count() <= SMALL:
        chosen = F.broadcast(chosen)
    sample = known.join(chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).select("id", "text", "lang")
    vocabulary = read_pieces(path)  # on the driver, which has the file; less than 1 MB goes with the task
    model = fit_in_task(sample, lambda t: train(t, vocabulary))
    kind = rows.schema["id"].dataType.simpleString()
    theta = model.theta.astype(np.float32).astype(np.float64)
    out = rows.select("id", "held_out", "text").mapInArrow(_predict(model.langs, model.pieces, theta), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def languages(documents: DataFrame) -> DataFrame:
    """The op1 digest."""
    return identify(documents)
