"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of about SHARD_BYTES, at most those of one Arrow batch. Its words become symbols: one for
each word that some benchmark item has, and one for any other word, runs of which are folded together, as no phrase can match
there. The shard's FM-index is searched backwards for all test phrases at once, occurrences are located by sampled suffix
positions, their words compared by a second hash, and their spans merged per document.

A phrase (window) is `window` consecutive words of an item; an item with fewer words, but not none, is one phrase. The
benchmark is a stated query set: its texts are bounded by `max_benchmark_bytes` (checked before anything is collected)
and are run in blocks of items of BLOCK_BYTES, one index pass for each. Blocks are made one after the other and left in the
shared folder, where workers map them; what is sent with a task are the items' ids.

Edge cases: null or empty texts have no words, so no hits; items with a null text have no phrases; an item with a null id
counts as an item, and its id is left out of the joined ids; items with equal texts are all reported; documents without hits get n_items 0 and the hash of the empty string; repeated rows are judged one by one; a
null id passes through; a text longer than a shard is a shard of its own; an empty table or benchmark gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernel as K
from larkspur.llm.fmindex import FMIndex
from larkspur.llm.shared import map_array, put_arrays, shared_dir

WINDOW = 10
SHARD_BYTES = 6 << 20
MAX_BENCHMARK_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20


class Phrases:
    """The distinct windows of benchmark items over a dense vocabulary."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW) -> None:
        column = pa.array([t for _, t in items], pa.string())
        parts, more, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, _, buf, offsets in K.chunks(column):
            w = K.split_words(buf, offsets, K.ALNUM, lower=True)
            parts.append(w.hashes)
            more.append(K.hashes(K.LOWER[buf], w.starts, w.ends, 1))
            first.append(w.first[1:] + first[-1][-1])
        words, second, first = np.concatenate(parts), np.concatenate(more), np.concatenate(first)
        #: sorted hashes of the items' words; symbol = place + 2 (1: any other word, 0: the index's own end)
        self.vocabulary = np.unique(words)
        symbols = np.searchsorted(self.vocabulary, words) + 2
        rows: dict[bytes, int] = {}
        found: list[list[int]] = []
        patterns, seconds, lengths = [], [], []
        for item in range(len(items)):
            w, g = symbols[first[item] : first[item + 1]], second[first[item] : first[item + 1]]
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                k = rows.setdefault(w[i : i + size].tobytes() + g[i : i + size].tobytes(), len(patterns))
                if k == len(patterns):
                    patterns.append(np.concatenate([np.zeros(window - size, np.int32), w[i : i + size].astype(np.int32)]))
                    seconds.append(np.concatenate([np.zeros(window - size, np.uint64), g[i : i + size]]))
                    lengths.append(size)
                    found.append([])
                if not found[k] or found[k][-1] != item:
                    found[k].append(item)
        #: symbols of each phrase, right-aligned, and the second hashes of its words
        self.patterns = np.array(patterns, np.int32).reshape(-1, window)
        self.seconds = np.array(seconds, np.uint64).reshape(-1, window)
        self.lengths = np.array(lengths, np.int64)
        #: of each phrase, its items: item_list[item_first[k] : item_first[k + 1]]
        self.item_first = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        self.item_list = np.array([i for x in found for i in x], np.int32)
        self.ids = [i for i, _ in items]
        self.window, self.uri = window, ""

    _ARRAYS = {"vocabulary": np.uint64, "patterns": np.int32, "seconds": np.uint64, "lengths": np.int64, "item_first": np.int64, "item_list": np.int32}

    def store(self, uri: str) -> Phrases:
        """Leaves the arrays in the shared folder, where they are mapped when first used."""
        put_arrays(uri, **{name: getattr(self, name) for name in self._ARRAYS})
        for name in self._ARRAYS:
            del self.__dict__[name]
        self.uri = uri
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not self.uri or k not in self._ARRAYS}

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in self._ARRAYS or not self.__dict__.get("uri"):
            raise AttributeError(name)
        x = np.asarray(map_array(f"{self.uri}.{name}", self._ARRAYS[name]))
        self.__dict__[name] = x.reshape(-1, self.window) if name in ("patterns", "seconds") else x
        return self.__dict__[name]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)

    def occurrences(self, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, word position) of each occurrence in the words of a shard."""
        none = np.zeros(0, np.int64)
        if not len(w.hashes) or not len(self.patterns):
            return none, none
        symbols = self.symbols(w.hashes)
        # one foreign symbol ends each document; runs of foreign words fold into one
        ends = w.first[1:]
        text = np.insert(symbols, ends, 1)
        place = np.insert(np.arange(len(symbols)), ends, -1)
        keep = np.ones(len(text), bool)
        keep[1:] = (text[1:] != 1) | (text[:-1] != 1)
        text, place = text[keep], place[keep]
        index = FMIndex(text, len(self.vocabulary) + 2)
        lo, hi = index.search(self.patterns, self.lengths)
        count = hi - lo
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        at = place[index.locate(rows)]
        if len(at):  # the words themselves, by their second hash
            word = at[:, None] + np.arange(-self.window, 0) + self.lengths[phrase][:, None]
            real = np.arange(-self.window, 0) >= -self.lengths[phrase][:, None]
            word = np.where(real, word, 0)
            u, back = np.unique(word, return_inverse=True)
            same = (K.hashes(K.LOWER[w.buf], w.starts[u], w.ends[u], 1)[back].reshape(word.shape) == self.seconds[phrase]) | ~real
            phrase, at = phrase[same.all(axis=1)], at[same.all(axis=1)]
        return phrase, at


RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _merge(start: np.ndarray, end: np.ndarray) -> list[dict]:
    order = np.argsort(start, kind="stable")
    out: list[dict] = []
    for s, e in zip(start[order].tolist(), end[order].tolist(), strict=True):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def _sorted(ids: Iterable[str | None]) -> list[str | None]:
    return sorted(set(ids), key=lambda x: (x is None, x or ""))


def scan_shard(phrases: Phrases, buf: np.ndarray, offsets: np.ndarray) -> tuple[list, list, list, list]:
    """n_words, n_hit, items and merged word spans of each document of a shard."""
    w = K.split_words(buf, offsets, K.ALNUM, lower=True)
    phrase, at = phrases.occurrences(w)
    size = phrases.lengths[phrase]
    hit = K.segment_sum(K.cover(at, size, len(w.hashes)).astype(np.int64), w.first) if len(w.hashes) else np.zeros(w.n_docs, np.int64)
    items: list[list[str]] = [[] for _ in range(w.n_docs)]
    spans: list[list[dict]] = [[] for _ in range(w.n_docs)]
    if len(at):
        doc = np.searchsorted(w.first, at, "right") - 1
        order = np.argsort(doc, kind="stable")
        phrase, at, doc, size = phrase[order], at[order], doc[order], size[order]
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])).tolist() + [len(doc)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            d = int(doc[a])
            some = np.unique(phrase[a:b])
            items[d] = _sorted(phrases.ids[i] for p in some.tolist() for i in phrases.item_list[phrases.item_first[p] : phrases.item_first[p + 1]].tolist())
            start = at[a:b] - w.first[d]
            spans[d] = _merge(start, start + size[a:b])
    return np.diff(w.first).tolist(), hit.tolist(), items, spans


def _blocks(items: list[tuple[str, str]], limit: int) -> list[list[tuple[str, str]]]:
    out: list[list] = [[]]
    size = 0
    for item in items:
        if out[-1] and size + len(item[1]) > limit:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item[1])
    return out


def _scan(blocks: list[Phrases]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offsets in K.chunks(batch["_text"], SHARD_BYTES):
                n_words, n_hit, items, spans = scan_shard(blocks[0], buf, offsets)
                for more in blocks[1:]:
                    _, _, i2, s2 = scan_shard(more, buf, offsets)
                    items = [_sorted([*a, *b]) for a, b in zip(items, i2, strict=True)]
                    spans = [_merge(*(np.array([x[k] for x in [*a, *b]], np.int64) for k in ("start", "end"))) for a, b in zip(spans, s2, strict=True)]
                    n_hit = [sum(x["end"] - x["start"] for x in s) for s in spans]
                found = [pa.array(x, t) for x, t in zip((n_words, n_hit, items, spans), _TYPES, strict=True)]
                kept = [c for c in batch.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(row, end - row) for c in kept), *found], names=[*kept, "n_words", "n_hit", "items", "spans"])

    return run


def cut_text(blocks: list[Phrases], text: bytes) -> bytes:
    """text without any phrase: spans are cut until none is left, also of phrases that a cut has brought together."""
    while True:
        buf = np.frombuffer(text, np.uint8)
        offsets = np.array([0, len(buf)])
        spans = _merge(*(np.array(x, np.int64) for x in (lambda s: ([y["start"] for y in s], [y["end"] for y in s]))([y for p in blocks for y in scan_shard(p, buf, offsets)[3][0]])))
        if not spans:
            return text
        w = K.split_words(buf, offsets, K.ALNUM, lower=True)
        parts, at = [], 0
        for s in spans:
            parts.append(text[at : w.starts[s["start"]]])
            at = w.ends[s["end"] - 1]
        text = b"".join([*parts, text[at:]])


def _cut(blocks: list[Phrases], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(column)
            for row, end, buf, offsets in K.chunks(batch[column], SHARD_BYTES):
                part = batch.slice(row, end - row)
                hit = np.zeros(end - row, bool)
                for phrases in blocks:
                    hit |= np.array(scan_shard(phrases, buf, offsets)[1]) > 0
                if hit.any():
                    texts = part[column].to_pylist()
                    for k in np.flatnonzero(hit).tolist():
                        texts[k] = cut_text(blocks, texts[k].encode()).decode()
                    part = part.set_column(place, column, pa.array(texts, batch.schema.field(place).type))
                yield part

    return run


def cut_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """docs with every occurrence of a benchmark phrase cut from text_col (a string column)."""
    blocks = _phrases(benchmark, item_id, item_text, window, max_benchmark_bytes)
    return docs.mapInArrow(_cut(blocks, text_col), docs.schema)


def _phrases(benchmark: DataFrame, item_id: str, item_text: str, window: int, max_benchmark_bytes: int) -> list[Phrases]:
    tests = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_benchmark_bytes:
        raise ValueError(f"the benchmark holds {size} bytes; max_benchmark_bytes is {max_benchmark_bytes}")
    items = sorted(((r.id, r.text) for r in tests.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))
    folder = shared_dir(benchmark.sparkSession)
    return [Phrases(b, window).store(f"{folder}/phrases-{k}") for k, b in enumerate(_blocks(items, BLOCK_BYTES))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """docs' columns with n_words, n_hit, items (ids as sorted strings) and spans (word ranges to remove)."""
    blocks = _phrases(benchmark, item_id, item_text, window, max_benchmark_bytes)
    kept = docs.drop("n_words", "n_hit", "items", "spans").columns
    rows = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(kept)), F.col(text_col).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(_scan(blocks), f"{fields}, {RESULT}").withColumnsRenamed({f"c{k}": c for k, c in enumerate(kept)})


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The op6 digest."""
    found = decontaminate(documents.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT item, len(w) AS n, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT bw.item, bw.size, array_to_string(b.w[bw.pos : bw.pos + bw.size - 1], ' ') AS gram FROM bw JOIN b ON bw.item = b.item),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT d.doc_id, s.size, unnest(range(1, len(d.w) - s.size + 2)) AS pos FROM d, sizes s WHERE len(d.w) >= s.size),
dg AS (SELECT dw.doc_id, dw.size, dw.pos, array_to_string(d.w[dw.pos : dw.pos + dw.size - 1], ' ') AS gram FROM dw JOIN d ON dw.doc_id = d.doc_id),
hits AS (SELECT dg.doc_id, dg.pos, dg.size, win.item FROM dg JOIN win ON dg.gram = win.gram AND dg.size = win.size),
words AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT doc_id, pos, size FROM hits) x),
nh AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(nh.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(ni.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ni.items, '')) AS items_sha256, coalesce(nh.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id
"""
