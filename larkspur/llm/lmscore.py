"""Language-model scoring: an interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, kept as sorted
arrays in the shared folder and memory-mapped by the workers that score.

Steps, all sizes following the corpus:

1. Words of the training documents are counted by two hashes, 94 bits together. The vocabulary is written as sorted hash
   arrays, a file for each range of hashes; a word's number is its place in that order.
2. Bigrams (with a start and an end token for each text) are counted by the numbers of both words. A pair's file follows
   from the words' cumulated counts, so that files hold alike many tokens, a frequent first word is spread over several
   files, and files are in key order without sampling. Tasks send each file's sorted keys as blobs of byte planes.
3. Each file's task merges its keys and counts; continuation counts of second words and counts of counts of first words
   are added up by vocabulary range.
4. Order 3: a bigram's number is its place in the files. Trigrams are counted by bigram number and third word, in the file
of their first two words: each file has its bigrams' third words in order, and their counts. Distinct words before
each bigram then go to groups of bigram files, which add them up.
5. Scoring maps the arrays and looks up sorted keys.

p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w),   p(w) = max(a(w) - D'(a(w)), 0) / A + g' / (V + 1),
a(w): distinct words before w, A: their sum, V: distinct training tokens. D and D' are the three modified Kneser-Ney
discounts of their level. At order 3, p(w | uv) = max(c(uvw) - D''(c(uvw)), 0) / c(uv) + g(uv) p(w | v), and in p(w | v)
a(vw), the distinct words before vw, stands for c(vw), and their sum over w for c(v); where v is the start token, which
nothing precedes, the counts stay. A text's first token has the start token alone as context.

Edge cases: null and empty texts are one end token; without training documents every token has probability 1 / (V + 1) = 1;
discounts that counts of counts leave undefined are set to half the count; unknown words and contexts back off; a null id
is in the fold of the empty text; repeated rows count each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernel as K
from larkspur.llm.labelled import fold
from larkspur.llm.shared import discard, map_array, materialize, put_arrays, put_bytes, release, shared_dir

CHUNK = 3 << 20
VOCABULARY_ROWS = 1 << 18  # words of a vocabulary file, about
FILE_TOKENS, MOST_TOKENS = 1 << 19, 1 << 24  # tokens of a bigram file, about: as few as make WAVES files for each core
WAVES = 32
GROUP = 16  # bigram files whose continuation counts one task adds up
MERGE = 1 << 22  # keys that are merged at once, about
START, END = np.int64(1), np.int64(2)  # hashes of the start and end tokens
KEY_LIMIT = 1 << 63

_maps: dict[str, np.ndarray] = {}


def _map(uri: str, dtype: type) -> np.ndarray:
    if uri not in _maps:
        if len(_maps) > 20_000:
            _maps.clear()
        _maps[uri] = map_array(uri, dtype)
    return _maps[uri]


def put_sections(uri: str, *arrays: np.ndarray) -> None:
    """Several arrays as one file, each at a multiple of 8 bytes."""
    data = [np.ascontiguousarray(x).tobytes() for x in arrays]
    head = np.array([len(data), *map(len, data)], np.int64).tobytes()
    put_bytes(uri, b"".join([head, *(x + bytes(-len(x) % 8) for x in data)]))


def sections(uri: str, *dtypes: type) -> list[np.ndarray]:
    raw = _map(uri, np.uint8)
    sizes = raw[8 : 8 + 8 * len(dtypes)].view(np.int64).tolist()
    out, at = [], 8 + 8 * len(dtypes)
    for size, dtype in zip(sizes, dtypes, strict=True):
        out.append(raw[at : at + size].view(dtype))
        at += size + -size % 8
    return out


def small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mostly small numbers as bytes; places and values of those above 254."""
    over = np.flatnonzero(x > 254)
    return np.minimum(x, 255).astype(np.uint8), np.concatenate([over, x[over]]).astype(np.int64)


def small_at(x: np.ndarray, over: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    out = x[at].astype(np.int64)
    if len(over) and (full := np.flatnonzero(out == 255)).size:
        places, values = over.reshape(2, -1)
        out[full] = values[np.searchsorted(places, full if isinstance(at, slice) else at[full])]
    return out


def search(x: np.ndarray, low: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each wanted number the place in x[low:end], which is sorted; and where it is there."""
    low, high = low.astype(np.int64), end.astype(np.int64)
    while (some := np.flatnonzero(low < high)).size:
        middle = (low[some] + high[some]) >> 1
        less = x[middle] < wanted[some]
        low[some[less]] = middle[less] + 1
        high[some[~less]] = middle[~less]
    hit = np.flatnonzero(low < end)
    return low, hit[x[low[hit]] == wanted[hit]]


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 as the first, then byte planes of the others, as many as the largest needs."""
    if not len(x):
        return b""
    x = x.astype(np.int64)
    first = x[:1].copy()
    x[0] = 0
    width = max(1, -(-int(x.max()).bit_length() // 8))
    return bytes([width]) + first.tobytes() + np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    out = out.view(np.int64).ravel()
    out[0] = np.frombuffer(data, np.int64, 1, 1)[0]
    return out


def keyed(*pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """One number for each pair, in the pairs' order, whatever their size: numbers that would not fit 63 bits are taken among
    those that occur."""
    some = [(a, b) for a, b in pairs if len(a)]
    if not some:
        return [a for a, _ in pairs]
    low, high, width = min(int(a.min()) for a, _ in some), max(int(a.max()) for a, _ in some), max(int(b.max()) for _, b in some) + 1
    if (high - low + 1) * width < KEY_LIMIT:
        return [(a - low) * width + b for a, b in pairs]
    left, right = (np.unique(np.concatenate([p[k] for p in some])) for k in (0, 1))
    return [np.searchsorted(left, a) * len(right) + np.searchsorted(right, b) for a, b in pairs]


def _merge(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs, and their counts added up."""
    keys = keyed((a, b))[0]
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    first = order[at]
    return a[first], b[first], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _merge(a, b, np.ones(len(a), np.int64))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs, and of each pair its place among them."""
    keys = keyed((a, b))[0]
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    del keys
    at = np.empty(len(a), np.int64)
    at[order] = np.cumsum(new) - 1
    first = order[new]
    return a[first], b[first], at


def _blob(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted pairs as differences: of the first numbers, and of second numbers under one first."""
    step, more = np.diff(a, prepend=0), np.diff(b, prepend=0)
    new = step != 0
    more[new] = b[new]
    return pack(step), pack(more), pack(counts)


def _pairs_of_blob(k: bytes, l: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, more = unpack(k), unpack(l)
    new = step != 0
    if len(new):
        new[0] = True
    at, run = np.flatnonzero(new), np.cumsum(more)
    return np.cumsum(step), run - np.repeat(run[at] - more[at], np.diff(np.append(at, len(run))))


_BLOBS = [("k", pa.binary()), ("l", pa.binary()), ("c", pa.binary())]


def _merge_blobs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and counts of a file's blobs; repeated pairs are added up on the way."""
    held, size = [(np.zeros(0, np.int64),) * 3], 0
    for k, l, c in zip(t["k"], t["l"], t["c"], strict=True):
        held.append((*_pairs_of_blob(k.as_py(), l.as_py()), unpack(c.as_py())))
        size += len(held[-1][0])
        if size > MERGE:
            held = [_merge(*map(np.concatenate, zip(*held, strict=True)))]
            size = 0
    return _merge(*map(np.concatenate, zip(*held, strict=True)))


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens' two hashes, in order of the first; for each word and end token its place in them; their bounds per
    document."""
    w = K.split_words(buf, offsets, K.NOT_SPACE, lower=True)
    first = w.first + np.arange(w.n_docs + 1)
    h = np.insert((w.hashes >> np.uint64(1)).astype(np.int64), w.first[1:], END)
    u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    g, real = np.zeros(len(u), np.int64), np.flatnonzero(u != END)
    word = at[real] - (np.searchsorted(first, at[real], "right") - 1)
    if len(word):
        g[real] = (K.hashes(K.LOWER[buf], w.starts[word], w.ends[word], 1) >> np.uint64(33)).astype(np.int64)
    return u, g, inverse, first


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, end, buf, offsets in K.chunks(batch["text"], CHUNK):
            u, g, inverse, _ = tokens(buf, offsets)
            c = np.bincount(inverse, minlength=len(u))
            cols = np.append(u, START), np.append(g, 0), np.append(c, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["h", "g", "c"])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows with the same key from batches sorted by it."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = t[key].to_numpy()
        starts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and k[a] != last:
                yield last, pa.concat_tables(held)
                held = []
            last = int(k[a])
            held.append(t.slice(a, b - a))
    if held:
        yield last, pa.concat_tables(held)


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _runs(batches, "part"):
            h, g, c = (t[x].to_numpy() for x in ("h", "g", "c"))
            put_arrays(f"{folder}/words-{part}", h=h, g=g.astype(np.int32), c=c, sum=np.cumsum(c) - c)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([c.sum()], pa.int64())], names=["part", "n", "tokens"])

    return run


@dataclass
class Model:
    """Where the arrays are, and the few numbers that go with them."""

    folder: str
    shift: int  # part of a hash: h >> shift
    base: np.ndarray  # number of the first word of each vocabulary part, and the end
    base_tokens: np.ndarray  # tokens before each vocabulary part, start tokens included
    documents: int
    order: int = 3
    files: int = 1
    pair_base: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))  # number of each file's first bigram, and the end
    start: int = -1  # number of the start token
    level3: list[float] = field(default_factory=list)
    level2: list[float] = field(default_factory=list)  # discounts D1, D2, D3+
    level1: list[float] = field(default_factory=list)
    pairs: int = 0  # distinct bigrams
    continuations: list[int] = field(default_factory=list)  # words with 1, 2, and more distinct words before them

    @property
    def size(self) -> int:
        """Words with the start token."""
        return int(self.base[-1])

    @property
    def vocabulary(self) -> int:
        return max(self.size - 1, 0)

    @property
    def tokens(self) -> int:
        return int(self.base_tokens[-1]) - self.documents

    @property
    def word(self) -> type:
        """Type of a stored word number."""
        return np.uint32 if self.size < 1 << 32 else np.uint64

    def look_up(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes, sorted by the first; -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        part = h >> self.shift
        for a, b in _spans(part):
            p = int(part[a])
            n = int(self.base[p + 1] - self.base[p])
            if n:
                known, other = _map(f"{self.folder}/words-{p}.h", np.int64), _map(f"{self.folder}/words-{p}.g", np.int32)
                at = np.searchsorted(known, h[a:b])
                todo = np.arange(b - a)
                while len(todo := todo[at[todo] < n]) and len(todo := todo[known[at[todo]] == h[a + todo]]):
                    same = other[at[todo]] == g[a + todo]
                    out[a + todo[same]] = at[todo[same]] + self.base[p]
                    todo = todo[~same]  # words that share the first hash follow each other
                    at[todo] += 1
        return out

    def column(self, name: str, numbers: np.ndarray, dtype: type) -> np.ndarray:
        """Values of a vocabulary array at sorted word numbers."""
        out = np.zeros(len(numbers), dtype)
        part = np.searchsorted(self.base, numbers, "right") - 1
        for a, b in _spans(part):
            out[a:b] = _map(f"{self.folder}/words-{part[a]}.{name}", dtype)[numbers[a:b] - self.base[part[a]]]
        return out

    def file_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The bigram file of sorted pairs."""
        u, inverse = np.unique(first, return_inverse=True)
        start = self.column("sum", u, np.int64) + self.base_tokens[np.searchsorted(self.base, u, "right") - 1]
        count = self.column("c", u, np.int64)
        at = start[inverse] + count[inverse] * (second / self.size)
        return np.minimum((at * (self.files / float(self.base_tokens[-1]))).astype(np.int64), self.files - 1)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of sorted bigrams; -1 where unknown."""
        out = np.full(len(first), -1, np.int64)
        file = self.file_of(first, second)
        for a, b in _spans(file):
            base = self.pair_base[file[a]]
            if base < self.pair_base[file[a] + 1]:
                firsts, starts, seconds = self.pairs_of(file[a])[:3]
                own = first[a:b]
                at = np.minimum(np.searchsorted(firsts, own), len(firsts) - 1)
                place, hit = search(seconds, starts[at], np.where(firsts[at] == own, starts[at + 1], starts[at]), second[a:b])
                out[a + hit] = place[hit] + base
        return out

    def pairs_of(self, file: int) -> list[np.ndarray]:
        """A file's distinct first words, where the bigrams of each begin (and the end), second words, counts."""
        return sections(f"{self.folder}/pairs-{file}", self.word, np.uint32, self.word, np.uint8, np.int64)

    def trigrams_of(self, file: int) -> list[np.ndarray]:
        """Where the trigrams of every 16th bigram begin, and how far behind it those of each (and the end) do; how many of each
        bigram's occur once, and twice; third words, counts."""
        return sections(f"{self.folder}/trigrams-{file}", np.uint32, *(np.uint8, np.int64) * 3, self.word, np.uint8, np.int64)

    def of_pairs(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Counts (c), or distinct words before (a), of sorted bigram numbers."""
        out = np.zeros(len(numbers), np.int64)
        file = np.searchsorted(self.pair_base, numbers, "right") - 1
        for a, b in _spans(file):
            of = self.pairs_of(file[a])[3:] if name == "c" else sections(f"{self.folder}/before-{file[a]}", np.uint8, np.int64)
            out[a:b] = small_at(*of, numbers[a:b] - self.pair_base[file[a]])
        return out

    def contexts(self, numbers: np.ndarray) -> np.ndarray:
        """Of sorted bigram numbers: the words seen once, twice, and more often after them."""
        out = np.zeros((3, len(numbers)), np.int64)
        file = np.searchsorted(self.pair_base, numbers, "right") - 1
        for a, b in _spans(file):
            every, behind, over, *n = self.trigrams_of(file[a])
            at = numbers[a:b] - self.pair_base[file[a]]
            out[0, a:b], out[1, a:b] = small_at(*n[:2], at), small_at(*n[2:4], at)
            size = _start(every, behind, over, at + 1) - _start(every, behind, over, at)
            out[2, a:b] = size - out[0, a:b] - out[1, a:b]
        return out

    def trigrams(self, pair: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Counts of sorted trigrams, by their bigram and third word."""
        out = np.zeros(len(pair), np.int64)
        file = np.searchsorted(self.pair_base, pair, "right") - 1
        for a, b in _spans(file):
            every, behind, over, *_, thirds, c, c_over = self.trigrams_of(file[a])
            at = pair[a:b] - self.pair_base[file[a]]
            place, hit = search(thirds, _start(every, behind, over, at), _start(every, behind, over, at + 1), third[a:b])
            out[a + hit] = small_at(c, c_over, place[hit])
        return out


def _start(every: np.ndarray, behind: np.ndarray, over: np.ndarray, at: np.ndarray) -> np.ndarray:
    return every[at >> 4] + small_at(behind, over, at)


def _spans(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal entries."""
    if len(x):
        cuts = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
        yield from zip([0, *cuts], [*cuts, len(x)], strict=True)


def _keys(model: Model, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes seen and their numbers; for each token its place in them; token bounds; the start token's number."""
    u, g, inverse, first = tokens(buf, offsets)
    return u, model.look_up(u, g), inverse, first, int(model.look_up(np.array([START]), np.zeros(1, np.int64))[0])


def _before(number: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The token before each, a start token at each document's first."""
    out = np.empty_like(number)
    out[1:] = number[:-1]
    out[first[:-1]] = start
    return out


def _pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in K.chunks(batch["text"], CHUNK):
                _, numbers, inverse, first, start = _keys(model, buf, offsets)
                number = numbers[inverse]
                left, right, counts = _counted(_before(number, first, start), number)
                yield _blobs(model.file_of(left, right), left, right, counts)

    return run


def _trigrams(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in K.chunks(batch["text"], CHUNK):
                _, numbers, inverse, first, start = _keys(model, buf, offsets)
                number = numbers[inverse]
                left, right, at = _distinct(_before(number, first, start), number)
                pair, later = model.find(left, right)[at], _later(first)
                pair, third, counts = _counted(pair[later - 1], number[later])
                yield _blobs(np.searchsorted(model.pair_base, pair, "right") - 1, pair, third, counts)

    return run


def _blobs(file: np.ndarray, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row of blobs for each file."""
    rows = [(int(file[i]), *_blob(a[i:j], b[i:j], counts[i:j])) for i, j in _spans(file)]
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, [("file", pa.int64()), *_BLOBS], strict=True)], names=["file", *(n for n, _ in _BLOBS)])


def _later(first: np.ndarray) -> np.ndarray:
    """Places of the tokens that are not their document's first."""
    later = np.ones(first[-1], bool)
    later[first[:-1]] = False
    return np.flatnonzero(later)


def _write_trigrams(model: Model):
    """Merges each file. Rows (grp, kind, k, l, c): kind 0 bigrams and distinct words before them, 1 the file's counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, t in _runs(batches, "file"):
            context, third, counts = _merge_blobs(t)
            n = int(model.pair_base[file + 1] - model.pair_base[file])
            context -= model.pair_base[file]
            starts = np.searchsorted(context, np.arange(n + 1))
            n1, n2 = (np.bincount(context[counts == k], minlength=n) for k in (1, 2))
            behind = starts - starts[::16].repeat(16)[: n + 1]
            put_sections(f"{model.folder}/trigrams-{file}", starts[::16].astype(np.uint32), *small(behind), *small(n1), *small(n2), third.astype(model.word), *small(counts))
            rows = [(file // GROUP, 1, b"", b"", pack(np.bincount(np.minimum(counts, 5), minlength=6)[1:]))]
            if len(third):
                left, right, c = _counted(model.pairs_of(file)[2][context].astype(np.int64), third)
                group = model.file_of(left, right) // GROUP
                rows += [(int(group[a]), 0, *_blob(left[a:b], right[a:b], c[a:b])) for a, b in _spans(group)]
            cols = zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), *(t for _, t in _BLOBS)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["grp", "kind", *(n for n, _ in _BLOBS)])

    return run


def _write_continuations(model: Model):
    """Each group's bigram counts of the lower level. Rows (file, part, kind, at, n): kind 1 to 3 first words' numbers of bigrams
    with count 1, 2 and more, 5 their sums of counts, 4 counts of counts and 6 those of trigrams (part -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, t in _runs(batches, "grp"):
            kind = t["kind"].to_numpy()
            seen = sum(unpack(x.as_py()) for x in t.filter(pa.array(kind == 1))["c"])
            left, right, counts = _merge_blobs(t.filter(pa.array(kind == 0)))
            rows = [(group * GROUP, -1, 6, pack(np.arange(5)), pack(seen))]
            for file in range(group * GROUP, min(group * GROUP + GROUP, model.files)):
                if model.pair_base[file] == model.pair_base[file + 1]:
                    continue
                firsts, starts, seconds, *counted = model.pairs_of(file)
                first = firsts.astype(np.int64).repeat(np.diff(starts))
                low, high = np.searchsorted(left, first[0]), np.searchsorted(left, first[-1], "right")
                known, keys = keyed((first, seconds.astype(np.int64)), (left[low:high], right[low:high]))
                inside = np.searchsorted(keys, (known[0], known[-1] + 1))
                keys, low, high = keys[inside[0] : inside[1]], low + inside[0], low + inside[1]
                a = np.where(first == model.start, small_at(*counted, slice(None)), 0)
                a[np.searchsorted(known, keys)] = counts[low:high]
                put_sections(f"{model.folder}/before-{file}", *small(a))
                rows.append((file, -1, 4, pack(np.arange(5)), pack(np.bincount(np.minimum(a, 5), minlength=6)[1:])))
                u, at = np.unique(first, return_index=True)
                sums = [(5, u, np.add.reduceat(a, at)), *((k, *np.unique(first[a == k if k < 3 else a > 2], return_counts=True)) for k in (1, 2, 3))]
                for k, u, n in sums:
                    part = np.searchsorted(model.base, u, "right") - 1
                    rows += [(file, int(part[i]), k, pack(np.diff(u[i:j], prepend=0)), pack(n[i:j])) for i, j in _spans(part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, (_, ty) in zip(zip(*rows, strict=True), _SUMS, strict=True)], names=[n for n, _ in _SUMS])

    return run


_SUMS = [("file", pa.int64()), ("part", pa.int64()), ("kind", pa.int64()), ("at", pa.binary()), ("n", pa.binary())]


def _write_pairs(model: Model):
    """Merges each file. Rows (part, kind, at, n): kind 0 continuation counts, 1 to 3 first words' numbers of bigrams with
    count 1, 2 and more, 4 counts of counts (part -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, t in _runs(batches, "file"):
            left, right, counts = _merge_blobs(t)
            firsts, starts = np.unique(left, return_index=True)
            put_sections(f"{model.folder}/pairs-{file}", firsts.astype(model.word), np.append(starts, len(left)).astype(np.uint32), right.astype(model.word), *small(counts))
            rows = [(file, -1, 4, pack(np.arange(5)), pack(np.append(np.bincount(np.minimum(counts, 5), minlength=6)[1:5], len(left))))]
            for kind in range(4 if model.order == 2 else 1):
                words = np.sort(right) if kind == 0 else left[counts == kind if kind < 3 else counts > 2]
                u, n = np.unique(words, return_counts=True)
                part = np.searchsorted(model.base, u, "right") - 1
                rows += [(file, int(part[a]), kind, pack(np.diff(u[a:b], prepend=0)), pack(n[a:b])) for a, b in _spans(part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, (_, ty) in zip(zip(*rows, strict=True), _SUMS, strict=True)], names=[n for n, _ in _SUMS])

    return run


def _write_sums(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _runs(batches, "part"):
            dense = np.zeros((6, int(model.base[part + 1] - model.base[part])), np.int64)
            for kind, at, n in zip(t["kind"].to_pylist(), t["at"], t["n"], strict=True):
                dense[kind, np.cumsum(unpack(at.as_py())) - model.base[part]] += unpack(n.as_py())
            put_arrays(f"{model.folder}/words-{part}", a=dense[0], n1=dense[1], n2=dense[2], n3=dense[3], **({"t": dense[5]} if model.order == 3 else {}))
            seen = np.bincount(np.minimum(dense[0], 5), minlength=6)[1:].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, *seen)], names=["part", "n1", "n2", "n3", "n4", "more"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more."""
    n = (n1, n2, n3, n4)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and y else k / 2
        out.append(d if 0 < d < k else k / 2)
    return out


def _discount(levels: list[float], counts: np.ndarray) -> np.ndarray:
    return np.array([0.0, *levels])[np.minimum(counts, 3)]


def build(train: DataFrame, folder: str, order: int = 3) -> Model:
    """train: text. Counts, and the arrays in folder."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = train.sparkSession
    words = materialize(train.mapInArrow(_words, "h long, g long, c long").groupBy("h", "g").agg(F.sum("c").alias("c")), folder, "words")
    n = words.count()
    bits = max(0, (max(n, 1) // VOCABULARY_ROWS).bit_length())
    parts = 1 << bits
    sized = words.withColumn("part", F.shiftright("h", 63 - bits) if bits else F.lit(0).cast("long"))
    found = sized.repartition("part").sortWithinPartitions("part", "h", "g").mapInArrow(_write_words(folder), "part long, n long, tokens long").collect()
    sizes, totals = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    for r in found:
        sizes[r.part], totals[r.part] = r.n, r.tokens
    documents = words.where((F.col("h") == int(START)) & (F.col("g") == 0)).first()
    discard(spark, f"{folder}/words")  # the arrays have it all
    model = Model(folder, 63 - bits, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(totals)]), documents.c if documents else 0, order)
    if not n:
        return model
    total = int(model.base_tokens[-1])
    model.files = -(-total // max(FILE_TOKENS, min(MOST_TOKENS, total // (WAVES * spark.sparkContext.defaultParallelism))))
    release(spark)
    pairs = train.mapInArrow(_pairs(model), "file long, k binary, l binary, c binary").repartition("file").sortWithinPartitions("file")
    sums = materialize(pairs.mapInArrow(_write_pairs(model), "file long, part long, kind long, at binary, n binary").repartition("part"), folder, "sums")
    release(spark)
    of_counts, sizes = np.zeros(5, np.int64), np.zeros(model.files, np.int64)
    for r in sums.where("kind = 4").select("file", "n").toLocalIterator():  # five numbers a file
        of_counts += (row := unpack(bytes(r.n)))
        sizes[r.file] = row[4]
    model.pair_base, model.pairs = np.concatenate([[0], np.cumsum(sizes)]), int(of_counts[4])
    if order == 3:
        model.start = int(model.look_up(np.array([START]), np.zeros(1, np.int64))[0])
        every = spark.range(model.files).select(F.col("id").alias("file"), *(F.lit(b"").alias(x) for x in "klc"))  # so that each file is written
        trigrams = train.mapInArrow(_trigrams(model), "file long, k binary, l binary, c binary").union(every).repartition("file").sortWithinPartitions("file")
        lower = trigrams.mapInArrow(_write_trigrams(model), "grp long, kind long, k binary, l binary, c binary").repartition("grp").sortWithinPartitions("grp")
        lower = materialize(lower.mapInArrow(_write_continuations(model), "file long, part long, kind long, at binary, n binary"), folder, "lower")
        release(spark)
        of_counts, of_trigrams = np.zeros(5, np.int64), np.zeros(5, np.int64)
        for r in lower.where("kind IN (4, 6)").select("kind", "n").toLocalIterator():
            (of_counts if r.kind == 4 else of_trigrams)[:] += unpack(bytes(r.n))
        model.level3 = discounts(*of_trigrams[:4].tolist())
        sums = sums.union(lower)
    seen = sums.where("part >= 0").repartition("part").sortWithinPartitions("part").mapInArrow(_write_sums(model), "part long, n1 long, n2 long, n3 long, n4 long, more long")
    seen = list(seen.agg(*(F.sum(c) for c in ("n1", "n2", "n3", "n4", "more"))).first())
    for name in ("sums", "lower"):
        discard(spark, f"{folder}/{name}")
    model.level2, model.level1 = discounts(*of_counts[:4].tolist()), discounts(*seen[:4])
    model.continuations = [seen[0], seen[1], sum(seen[2:])]
    return model


def score_chunk(model: Model, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_tokens, n_known, base score and model score of each document."""
    u, numbers, inverse, first, start = _keys(model, buf, offsets)
    known = numbers >= 0
    count = np.zeros(len(u), np.int64)
    count[known] = model.column("c", numbers[known], np.int64)
    base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
    n_tokens, n_known = np.diff(first), K.segment_sum(known[inverse].astype(np.int64), first)
    base_score = K.segment_sum(base[inverse], first)
    if not model.pairs:
        return n_tokens, n_known, base_score, n_tokens * np.log10(1 / (model.vocabulary + 1))
    a = np.zeros(len(u), np.int64)
    a[known] = model.column("a", numbers[known], np.int64)
    before_known = np.append(numbers[known], start)
    order = np.argsort(before_known, kind="stable")
    gamma = np.zeros(len(before_known))
    total = np.zeros(len(before_known), np.int64)
    sorted_numbers = before_known[order]
    total[order] = model.column("c" if model.order == 2 else "t", sorted_numbers, np.int64)
    gamma[order] = sum(d * model.column(f"n{k}", sorted_numbers, np.int64) for k, d in enumerate(model.level2, 1))
    gamma /= np.maximum(total, 1)
    uniform = sum(d * n for d, n in zip(model.level1, model.continuations, strict=True)) / model.pairs
    p1 = np.maximum(a - _discount(model.level1, a), 0) / model.pairs + uniform / (model.vocabulary + 1)
    # contexts by place: of the words seen, then the start token
    place = np.full(len(u) + 1, -1, np.int64)
    place[:-1][known] = np.arange(known.sum())
    place[-1] = known.sum()
    before = _before(inverse, first, len(u))
    context = place[before]
    back = np.ones(len(inverse))
    has = context >= 0
    back[has] = gamma[context[has]]
    p = p1[inverse]
    p *= back
    both = np.flatnonzero(has & known[inverse])
    left, right, at = _distinct(before_known[context[both]], numbers[inverse[both]])
    pair, c = model.find(left, right), np.zeros(len(left), np.int64)
    c[pair >= 0] = model.of_pairs("c" if model.order == 2 else "a", pair[pair >= 0])
    c = c[at]
    p[both] += np.maximum(c - _discount(model.level2, c), 0) / total[context[both]]
    if model.order == 3:
        pairs, later = np.full(len(inverse), -1, np.int64), _later(first)
        pairs[both] = pair[at]
        later = later[pairs[later - 1] >= 0]
        u, at = np.unique(pairs[later - 1], return_inverse=True)
        total = model.of_pairs("c", u)
        p[later] *= ((np.array(model.level3) @ model.contexts(u)) / total)[at]
        seen = known[inverse[later]]
        later, at = later[seen], at[seen]
        left, right, place = _distinct(u[at], numbers[inverse[later]])
        c = model.trigrams(left, right)[place]
        p[later] += np.maximum(c - _discount(model.level3, c), 0) / total[at]
    return n_tokens, n_known, base_score, K.segment_sum(np.log10(p), first)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offsets in K.chunks(batch["text"], CHUNK):
                n_tokens, n_known, base, score = score_chunk(model, buf, offsets)
                cols = [pa.array(x) for x in (n_tokens, n_known, base, score)]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(row, end - row) for c in ("id", "held_out")), *cols], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (log10) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = build(rows.where("NOT held_out").select("text"), shared_dir(docs.sparkSession), order)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_score(model), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def model_scores(documents: DataFrame, order: int = 3) -> DataFrame:
    """The op8 digest."""
    return score_texts(documents, order=order)
