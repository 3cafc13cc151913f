"""Removal of long word spans that repeat across documents, by a compacted de Bruijn graph of token k-mers.

Nodes are (window - 1)-grams; an edge is a window of `window` words, known by the hashes of the two nodes it joins. Steps:

0. Copies: of documents with equal texts (SHA-256), those with a larger id are removed whole if they hold a window, and
   leave the graph: the copy with the smallest id has all their edges.
1. Candidates: each window's minimizer (least hash of its 6-grams) is counted over all documents; a window can be repeated
   only if its minimizer is. The repeated ones go into a bitmap that grows with them, so that later steps move only windows
   that may be repeated. This drops nothing: equal windows have equal minimizers.
2. Edges are aggregated to their source coordinate (the occurrence in the document with the smallest id), the number of
   documents, and a sum that tells the set of places where they occur, and where the words before them would.
3. Compaction: a join at the shared node links an edge to the one after it if both occur at the same places, that is if
   the node has one way in and one way out wherever the edges occur. Linked edges have consecutive source coordinates, so
   each maximal nonbranching path is one row: its first edge, length and source coordinate.
4. Occurrences: a path is met whole or not at all, so that documents are searched for first edges alone. They join the
   paths; where a document follows consecutive paths of one source, they are one run.
5. Verification: the words at each run's source coordinate are read and hashed by SHA-256; a document drops a run only if
   its own words there have the same. Where they have not (two sequences share a hash), the windows of all runs that meet
   these places of the source are compared word by word.
6. Removal: words that a verified span covers are dropped.

Edge cases: null and empty texts have no words; texts with fewer words than a window keep all; a null id is neither
smaller nor larger than another, so such rows keep all words and are no source; rows with the same id do not repeat each
other, each row is judged by its own text; an empty table gives an empty result. Ids are integers. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import kernel as K
from larkspur.llm.bitmap import in_bitmap, write_bitmap
from larkspur.llm.shared import materialize, release, shared_dir

WINDOW = 13
SHORT = 6  # words of the grams that minimizers are chosen from
HASH_BITS = 64  # of a node's hash; tests take fewer, so that different words share one
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def _minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Least hash of the short grams in each window of h (len(h) - window + 1 of them)."""
    short = min(SHORT, window)
    best, size = K.ngram_hashes(h, short), 1
    wanted = window - short + 1
    while size < wanted:
        step = min(size, wanted - size)
        best = np.minimum(best[: len(best) - step], best[step:])
        size += step
    return best


def _nodes(w: K.Words, window: int, bits: int) -> np.ndarray:
    return K.ngram_hashes(w.hashes >> np.uint64(64 - bits) if bits < 64 else w.hashes, window - 1)


def _edge_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return K.mix(left ^ (right << np.uint64(1)), 31)


def _row_hash(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(ids.view(np.uint64), 5) ^ tags.view(np.uint64), 6)


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a tag of the text: with the id, it tells rows apart whose texts differ."""
    return docs.withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)))


def _where(bitmap: str, batch: pa.RecordBatch, inside: bool = True) -> pa.RecordBatch:
    """The rows whose id and tag may be in a bitmap, or are not."""
    some = in_bitmap(bitmap, _row_hash(K.longs(batch["id"]), K.longs(batch["tag"]))) & batch["id"].is_valid().to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(some if inside else ~some))


def _filter(bitmap: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _where(bitmap, batch)

    return run


def _row_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_row_hash(K.longs(batch["id"]), K.longs(batch["tag"])).view(np.int64))], names=["h"])


def _write_rows(rows: DataFrame, folder: str, name: str) -> str:
    """A bitmap of (id, tag) rows."""
    keys = materialize(rows.mapInArrow(_row_keys, "h long"), folder, name)
    return write_bitmap(keys, "h", keys.count(), f"{folder}/{name}.bits")


def _count_minimizers(window: int, firsts: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in K.chunks(_where(firsts, batch)["text"]):
                w = K.split_words(buf, offsets)
                at = np.flatnonzero(K.window_starts(w.first, window))
                if not len(at):
                    continue
                m, doc = K.mix(_minimizers(w.hashes, window)[at], 77), w.doc()[at]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
                m, doc = m[new], doc[new]
                order = np.argsort(m, kind="stable")
                m, doc = m[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                last = np.append(first[1:], len(m)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(m[first].view(np.int64)), pa.array(1 + (doc[first] != doc[last]).astype(np.int64))], names=["m", "c"])

    return run


def _edges(window: int, bits: int, minimizers: str, firsts: str):
    """(l, r, id, at, s, p) of each candidate edge of a document: its nodes, its first place (tag and position), and the sums
    of its places and of those before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _where(firsts, batch)
            ids, tags, numbers = (K.longs(batch[c]) for c in ("id", "tag", "row"))
            for row, _, buf, offsets in K.chunks(batch["text"]):
                w = K.split_words(buf, offsets)
                at = np.flatnonzero(K.window_starts(w.first, window))
                if len(at):
                    at = at[in_bitmap(minimizers, K.mix(_minimizers(w.hashes, window)[at], 77))]
                if not len(at):
                    continue
                node, doc = _nodes(w, window, bits), w.doc()[at]
                left, right, pos = node[at], node[at + 1], (at - w.first[doc]).astype(np.uint64)
                doc += row
                base = K.mix(numbers[doc].view(np.uint64), 9)
                here, before = K.mix(base + pos * _PLACE), K.mix(base + (pos - np.uint64(1)) * _PLACE)
                order = np.argsort(_edge_hash(left, right), kind="stable")
                left, right, doc = left[order], right[order], doc[order]
                new = np.ones(len(at), bool)
                new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                place = (tags[doc[first]] << 32) | pos[order[first]].astype(np.int64)
                cols = left[first].view(np.int64), right[first].view(np.int64), ids[doc[first]], place, *(np.bitwise_xor.reduceat(x[order], first).view(np.int64) for x in (here, before))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["l", "r", "id", "at", "s", "p"])

    return run


def _path_starts(window: int, bits: int, starts: str, firsts: str):
    """(l, r, id, at) of every place that may hold a path's first edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _where(firsts, batch)
            ids, tags = K.longs(batch["id"]), K.longs(batch["tag"])
            for row, _, buf, offsets in K.chunks(batch["text"]):
                w = K.split_words(buf, offsets)
                at = np.flatnonzero(K.window_starts(w.first, window))
                if not len(at):
                    continue
                node = _nodes(w, window, bits)
                at = at[in_bitmap(starts, _edge_hash(node[at], node[at + 1]))]
                doc = row + w.doc()[at]
                place = (tags[doc] << 32) | (at - w.first[doc - row])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[at].view(np.int64), node[at + 1].view(np.int64), ids[doc], place)], names=["l", "r", "id", "at"])

    return run


def _edge_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_edge_hash(*(K.longs(batch[c]).view(np.uint64) for c in ("l", "r"))).view(np.int64))], names=["h"])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Row numbers and words, one row's at a time."""
    for i, x in enumerate(batch["text"]):
        yield i, (x.as_py() or "").encode().split()


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tag, hits) to runs (id, tag, pos, len, src, sat)."""
    for batch in batches:
        lists = batch["hits"]
        bounds = lists.offsets.to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        pos, size, src, sat = (K.longs(lists.values.field(c))[bounds[0] : bounds[-1]] for c in ("pos", "len", "src", "sat"))
        order = np.lexsort((pos, sat - pos, src, row))
        row, pos, size, src, sat = (x[order] for x in (row, pos, size, src, sat))
        new = np.ones(len(row), bool)
        # within a source, runs lie on one diagonal
        new[1:] = (row[1:] != row[:-1]) | (src[1:] != src[:-1]) | (pos[1:] != pos[:-1] + size[:-1]) | (sat[1:] != sat[:-1] + size[:-1])
        first = np.flatnonzero(new)
        cols = K.longs(batch["id"])[row[first]], K.longs(batch["tag"])[row[first]], pos[first], np.add.reduceat(size, first) if len(first) else size, src[first], sat[first]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "tag", "pos", "len", "src", "sat"])


def _source_words(window: int):
    """Rows (id, tag, text, spans of positions and lengths in windows) to (src, sat, len, words), words being SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, out = K.longs(batch["id"]), K.longs(batch["tag"]), []
            for i, words in _texts(batch):
                spans = ((s["pos"], s["len"]) for s in batch["spans"][i].as_py())
                out += [(int(ids[i]), int(tags[i]) << 32 | a, n, _digest(words[a : a + n + window - 1])) for a, n in spans if a + n + window - 1 <= len(words)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["src", "sat", "len", "words"])

    return run


def _window_words(window: int):
    """Rows (id, tag, text, spans) to (id, tag, pos, words) of each window in the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = K.longs(batch["id"]), K.longs(batch["tag"])
            for i, words in _texts(batch):
                at = sorted({a for s in batch["spans"][i].as_py() for a in range(s["pos"], min(s["pos"] + s["len"], len(words) - window + 1))})
                cols = [int(ids[i])] * len(at), [int(tags[i])] * len(at), at, [_digest(words[a : a + window]) for a in at]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "tag", "pos", "words"])

    return run


def _joined(hits: list[dict], window: int) -> list[dict]:
    """Spans of words from (pos, len, src, sat): runs that follow each other in both documents are one span."""
    out: list[dict] = []
    for pos, source, place, size in sorted((h["pos"], h["src"], h["sat"] & 0xFFFFFFFF, h["len"]) for h in hits):
        last = out[-1] if out else None
        if last and last["source"] == source and last["end"] - last["start"] - window + 1 == pos - last["start"] == place - last["source_start"]:
            last["end"] = pos + size + window - 1
        else:
            out.append({"start": pos, "end": pos + size + window - 1, "source": source, "source_start": place})
    return out


RESULT = "n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,end:long,source:long,source_start:long>>, doubts array<struct<src:long,sat:long,len:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))
_DOUBT = pa.list_(pa.struct([("src", pa.int64()), ("sat", pa.int64()), ("len", pa.int64())]))
_NOTHING = hashlib.sha256(b"").hexdigest()


def _finish(window: int, keep_text: bool):
    """Rows (text, hits, copy_of) to results; hits whose words differ from their source's are doubts."""

    def one(words: list[bytes], hits: list[dict], copy_of: int | None) -> tuple:
        n = len(words)
        if copy_of is not None and n >= window:
            return n, n, _NOTHING, "" if keep_text else None, [{"start": 0, "end": n, "source": copy_of, "source_start": 0}], []
        sure, doubts = [], []
        for h in hits:
            # a window compared word by word comes without its source's words
            same = h["words"] is None or (h["pos"] + h["len"] + window - 1 <= n and _digest(words[h["pos"] : h["pos"] + h["len"] + window - 1]) == h["words"])
            (sure if same else doubts).append(h)
        spans = _joined(sure, window)
        if spans:
            x = np.array([(s["start"], s["end"]) for s in spans], np.int64)
            gone = K.cover(x[:, 0], x[:, 1] - x[:, 0], n)
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        kept = b" ".join(words)
        return n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None, spans, [{k: h[k] for k in ("src", "sat", "len")} for h in doubts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = "hits" in batch.schema.names
            carried = [c for c in batch.schema.names if c not in ("text", "hits", "copy_of")]
            rows, size, start = [], 0, 0
            for i, words in _texts(batch):
                rows.append(one(words, (batch["hits"][i].as_py() or []) if held else [], batch["copy_of"][i].as_py() if held else None))
                size += sum(map(len, words)) if keep_text else 256
                if size > 1 << 24 or i == batch.num_rows - 1:
                    cols = list(zip(*rows, strict=True))
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), _SPAN, _DOUBT)
                    yield pa.RecordBatch.from_arrays([*(batch[c].slice(start, len(rows)) for c in carried), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*carried, "n_words", "n_removed", "kept_sha256", "kept", "spans", "doubts"])
                    rows, size, start = [], 0, i + 1

    return run


def _untouched(bitmap: str, window: int, keep_text: bool):
    """Results of the rows that have no hits for sure."""
    finish = _finish(window, keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from finish(_where(bitmap, batch, False) for batch in batches)

    return run


def _tag(at: str) -> F.Column:
    return F.shiftrightunsigned(at, 32)


def _pos(at: str) -> F.Column:
    return F.col(at).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(tag: str, pos: str) -> F.Column:
    return F.shiftleft(tag, 32).bitwiseOR(F.col(pos))


class Graph:
    """The compacted graph over rows (id, text, tag): copies (id, tag, copy_of) of smaller ids, and paths (l, r, src, at, len, n):
    nodes of the first edge, source coordinate, length in edges, documents that hold the path."""

    def __init__(self, rows: DataFrame, folder: str, window: int = WINDOW, bits: int = HASH_BITS) -> None:
        self.rows, self.folder, self.window, self.bits = rows.where("id IS NOT NULL"), folder, window, bits
        spark = rows.sparkSession
        prints = materialize(self.rows.select("id", "tag", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha")), folder, "prints")
        first = materialize(prints.groupBy("sha").agg(F.min("id").alias("copy_of"), F.min("tag").alias("tag")), folder, "first")
        copies = prints.join(first.drop("tag"), "sha").where("copy_of < id").groupBy("id", "tag").agg(F.min("copy_of").alias("copy_of"))
        self.copies = materialize(copies, folder, "copies")
        self.firsts = _write_rows(first.select(F.col("copy_of").alias("id"), "tag"), folder, "firsts")
        counted = self.rows.mapInArrow(_count_minimizers(window, self.firsts), "m long, c long")
        seen = materialize(counted.groupBy("m").agg(F.sum("c").alias("c")).where("c > 1").select("m"), folder, "minimizers")
        minimizers = write_bitmap(seen, "m", seen.count(), f"{folder}/minimizers.bits")
        release(spark)
        numbered = self.rows.withColumn("row", F.monotonically_increasing_id())
        edges = numbered.mapInArrow(_edges(window, bits, minimizers, self.firsts), "l long, r long, id long, at long, s long, p long")
        edges = edges.groupBy("l", "r").agg(F.count("*").alias("n"), F.min("id").alias("src"), F.min_by("at", "id").alias("at"), F.bit_xor("s").alias("s"), F.bit_xor("p").alias("p"))
        edges = materialize(edges.where("n > 1"), folder, "edges")
        release(spark)
        # at their shared node, an edge follows the one that occurs wherever it does
        ends = edges.select(F.col("r").alias("l"), F.col("s").alias("p"), "src", (F.col("at") + 1).alias("at"), F.lit(True).alias("inner"))
        linked = edges.join(ends, ["l", "p", "src", "at"], "left").select("l", "r", "n", "src", "at", F.coalesce("inner", F.lit(False)).alias("inner"))
        line = Window.partitionBy("src", _tag("at")).orderBy("at")
        numbers = linked.withColumn("path", F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(line))
        paths = numbers.groupBy("src", _tag("at"), "path").agg(F.min_by("l", "at").alias("l"), F.min_by("r", "at").alias("r"), F.min("at").alias("at"), F.count("*").alias("len"), F.first("n").alias("n"))
        self.paths = materialize(paths.select("l", "r", "src", "at", "len", "n"), folder, "paths")

    def runs(self) -> DataFrame:
        """(id, tag, pos, len, src, sat): where a document follows paths whose source has no larger id, paths that follow each
        other in both being one run."""
        keys = self.paths.mapInArrow(_edge_keys, "h long")
        starts = write_bitmap(keys, "h", self.paths.count(), f"{self.folder}/starts.bits")
        met = self.rows.mapInArrow(_path_starts(self.window, self.bits, starts, self.firsts), "l long, r long, id long, at long")
        hits = met.join(self.paths.select("l", "r", "src", F.col("at").alias("sat"), "len"), ["l", "r"]).where("src < id OR (src = id AND sat != at)")
        hits = hits.groupBy("id", _tag("at").alias("tag")).agg(F.collect_set(F.struct(_pos("at").alias("pos"), "len", "src", "sat")).alias("hits"))
        return materialize(hits.mapInArrow(_runs, "id long, tag long, pos long, len long, src long, sat long"), self.folder, "runs")

    def texts(self, spans: DataFrame, name: str) -> DataFrame:
        """Of (id, tag, pos, len), rows (id, tag, text, spans): the documents with their spans."""
        lists = spans.groupBy("id", "tag").agg(F.collect_set(F.struct("pos", "len")).alias("spans"))
        lists = materialize(lists, self.folder, name)
        some = self.rows.mapInArrow(_filter(_write_rows(lists.select("id", "tag"), self.folder, f"{name}-rows")), self.rows.schema)
        return some.join(lists, ["id", "tag"])

    def with_words(self, runs: DataFrame) -> DataFrame:
        """The runs from smaller ids, with SHA-256 of the words at their source coordinate."""
        runs = runs.where("src < id")
        sources = self.texts(runs.select(F.col("src").alias("id"), _tag("sat").alias("tag"), _pos("sat").alias("pos"), "len"), "sources")
        words = sources.select("id", "tag", "text", "spans").mapInArrow(_source_words(self.window), "src long, sat long, len long, words binary")
        words = materialize(words.groupBy("src", "sat", "len").agg(F.min("words").alias("words")), self.folder, "words")
        # without words at the source nothing is verified
        return materialize(runs.join(words, ["src", "sat", "len"], "left").withColumn("words", F.coalesce("words", F.lit(b""))), self.folder, "verified")

    def compared(self, verified: DataFrame, runs: DataFrame, doubts: DataFrame) -> DataFrame:
        """verified without the doubtful runs (src, sat, len), and with the windows of these, compared word by word: with those
        of all runs that meet the same places of the source, and of the source."""
        bad = doubts.select("src", _tag("sat").alias("stag"), F.col("sat").alias("low"), (F.col("sat") + F.col("len")).alias("high"))
        met = runs.withColumn("stag", _tag("sat")).join(bad, ["src", "stag"]).where("sat < high AND low < sat + len").select("id", "tag", "pos", "len")
        places = met.union(doubts.select(F.col("src").alias("id"), _tag("sat").alias("tag"), _pos("sat").alias("pos"), "len"))
        windows = self.texts(places, "doubted").select("id", "tag", "text", "spans").mapInArrow(_window_words(self.window), "id long, tag long, pos long, words binary")
        windows = materialize(windows.distinct(), self.folder, "windows")
        least = windows.groupBy("words").agg(F.min("id").alias("src"), F.min_by(_place("tag", "pos"), "id").alias("sat"))
        found = windows.join(least, "words").where("src < id").select("id", "tag", "pos", F.lit(1).cast("long").alias("len"), "src", "sat", F.lit(None).cast("binary").alias("words"))
        return materialize(verified.join(doubts, ["src", "sat", "len"], "left_anti").unionByName(found), self.folder, "compared")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True, carry: tuple[str, ...] = (), hash_bits: int = HASH_BITS) -> DataFrame:
    """id_col, the carried columns, n_words, n_removed, kept_sha256, kept (words joined by one space; null unless
    keep_text) and spans of every row. Carried columns named like a result are refused."""
    if window < 2:
        raise ValueError("a window has two words at least")
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    names = [f"c{k}" for k in range(len(carry))]
    rows = _rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True))))
    graph = Graph(rows.select("id", "text", "tag"), folder, window, hash_bits)
    runs = graph.runs()
    release(spark)
    verified = graph.with_words(runs)
    release(spark)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def touched(hits: DataFrame, copies: DataFrame, bitmap: str, name: str) -> DataFrame:
        by_row = hits.groupBy("id", "tag").agg(F.collect_list(F.struct("pos", "len", "src", "sat", "words")).alias("hits"))
        some = rows.mapInArrow(_filter(bitmap), rows.schema).join(by_row, ["id", "tag"], "left").join(copies, ["id", "tag"], "left")
        done = some.select("id", "text", *names, "tag", "hits", "copy_of").mapInArrow(_finish(window, keep_text), f"{fields}, {RESULT}")
        return materialize(done, folder, name)

    # only documents that may have hits are shuffled with their texts
    bitmap = _write_rows(verified.select("id", "tag").union(graph.copies.select("id", "tag")).distinct(), folder, "touched")
    some = touched(verified, graph.copies, bitmap, "results")
    doubts = materialize(some.select(F.explode("doubts").alias("d")).select("d.src", "d.sat", "d.len").distinct(), folder, "doubts")
    if not doubts.isEmpty():
        some = touched(graph.compared(verified, runs, doubts), graph.copies, bitmap, "compared-results")
    release(spark)
    out = rows.mapInArrow(_untouched(bitmap, window, keep_text), f"{fields}, {RESULT}").unionByName(some).drop("tag", "doubts")
    if clash := {id_col, *carry} & {f for f in out.columns if f not in ("id", *names)}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    return out.withColumnsRenamed({"id": id_col} | dict(zip(names, carry, strict=True)))


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The compacted graph: each maximal nonbranching path of repeated edges, by its source coordinates. Columns: source,
    start, n_words, n_documents (documents that repeat the path; whole copies of a text are no part of the graph)."""
    rows = _rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    paths = Graph(rows, shared_dir(docs.sparkSession), window).paths
    return paths.select(F.col("src").alias("source"), _pos("at").alias("start"), (F.col("len") + window - 1).alias("n_words"), (F.col("n") - 1).alias("n_documents"))


def remove_from_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated spans cut from the text; texts that lose nothing stay as they are."""
    rest = {c: f"k{n}" for n, c in enumerate(docs.columns) if c not in (id_col, text_col)}
    safe = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("input"), F.col(text_col).alias("whole"), *(F.col(c).alias(k) for c, k in rest.items()))
    out = remove_repeats(safe, "doc", "input", window, True, ("whole", *rest.values()))
    out = out.select(F.col("doc").alias(id_col), F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("whole")).alias(text_col), *(F.col(k).alias(c) for c, k in rest.items()))
    return out.select(*docs.columns)


def substring_dedup(documents: DataFrame) -> DataFrame:
    """The op9 digest."""
    return remove_repeats(documents, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
g AS (SELECT d.doc_id, s.pos, array_to_string(d.w[s.pos : s.pos + 12], ' ') AS gram FROM d, (SELECT doc_id AS di, unnest(range(1, len(w) - 11)) AS pos FROM d WHERE len(w) >= 13) s WHERE s.di = d.doc_id),
f AS (SELECT gram, min(doc_id) AS src FROM g GROUP BY gram),
h AS (SELECT g.doc_id, g.pos FROM g JOIN f ON g.gram = f.gram WHERE f.src < g.doc_id),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM h, (SELECT unnest(range(0, 13)) AS k) o),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS t, count(*) AS n FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos WHERE gone.pos IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
