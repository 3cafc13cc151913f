"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Texts are taken as sets of `n` consecutive words (`[^\\x20\\x09-\\x0D]+`, unchanged); a text with fewer words, but not
none, is one gram. Steps:

1. Each document gets the hash of its gram set and `BANDS` band keys of `ROWS` MinHash rows each. Two texts with
   similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS: 1 - 1.5e-5 at 0.8.
2. Documents with equal sets are one class with a multiplicity; from here on each class counts once.
3. Keys with one class are dropped, and of the keys with the same classes all but one.
4. Classes of a key meet in blocks of `BLOCK`: each pair of blocks is one group, so no key is gathered in one task. The texts
   of a key with several blocks are written once a block to the shared folder, where the groups read them. In a group,
   intersections of the full gram sets come from a product of incidence matrices. A pair is judged under the least key that
   both have, so that it counts once. A group returns a count and a root per class, never its pairs.
5. Components of the roots give the classes of near copies.

Edge cases: null, empty and blank texts have no grams and link to nothing (class of their own); a null id is returned
with a null class and 0 links and links to nothing; rows with the same id count as documents of their own, and share the
class id; an empty table gives an empty result. Ids are integers. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import kernel as K
from larkspur.llm.bitmap import in_bitmap, write_bitmap
from larkspur.llm.components import connected_components
from larkspur.llm.shared import get_bytes, materialize, put_bytes, release, shared_dir

GRAM = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 5
BLOCK = 256
COLUMNS = 4096

_seeds = np.random.default_rng(5).integers(1, 1 << 32, (BANDS * ROWS, 2), dtype=np.int64).astype(np.uint32) | np.uint32(1)


def gram_sets(w: K.Words, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes of each document, in order, and their bounds per document."""
    sizes = np.diff(w.first)
    at = np.flatnonzero(K.window_starts(w.first, n))
    grams, doc = K.ngram_hashes(w.hashes, n)[at] if len(at) else np.zeros(0, np.uint64), np.repeat(np.arange(w.n_docs), np.maximum(sizes - n + 1, 0))
    for size in range(1, n):  # short texts: one gram of all words
        short = np.flatnonzero(sizes == size)
        if len(short):
            grams = np.append(grams, K.mix(K.ngram_hashes(w.hashes, size)[w.first[short]], size))
            doc = np.append(doc, short)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(w.n_docs + 1))


def set_hashes(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set: two sums of mixed members, mixed with the size."""
    a, b = (K.segment_sum(K.mix(grams, salt), first) for salt in (0x1F83D9AB, 0x6A09E667))
    return K.mix(a + K.mix(b) + np.diff(first).astype(np.uint64))


def band_keys(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents with grams) x BANDS keys."""
    low, at = (grams >> np.uint64(32)).astype(np.uint32), first[:-1][np.diff(first) > 0]
    keys = np.zeros((len(at), BANDS), np.uint64)
    y, t = np.empty_like(low), np.empty_like(low)
    for band in range(BANDS):
        key = np.full(len(at), band, np.uint64)
        for a, b in _seeds[band * ROWS : band * ROWS + ROWS]:
            np.bitwise_xor(low, b, out=y)
            np.multiply(y, a, out=y)
            np.right_shift(y, np.uint32(15), out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, np.uint32(0x2C1B3C6D), out=y)
            key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, at), band + 1)
        keys[:, band] = key
    return keys


def _sets(n: int):
    """(id, tag, text) to (id, tag, set hash, band keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offsets in K.chunks(batch["text"]):
                grams, first = gram_sets(K.split_words(buf, offsets), n)
                some = np.diff(first) > 0
                keys = band_keys(grams, first) if len(grams) else np.zeros((0, BANDS), np.uint64)
                bounds = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                mask = ~some
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(row, end - row), batch["tag"].slice(row, end - row), pa.array(set_hashes(grams, first).view(np.int64), mask=mask), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.ravel().view(np.int64)))],
                    names=["id", "tag", "set", "keys"],
                )

    return run


def _texts_of(bitmap: str, n: int):
    """(id, text) of the sets in a bitmap, to (id, set, text); only rows whose id is in it are hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = in_bitmap(bitmap, K.mix(K.longs(batch["id"]).view(np.uint64), 9))
            part = batch.filter(pa.array(some))
            for row, end, buf, offsets in K.chunks(part["text"]):
                grams, first = gram_sets(K.split_words(buf, offsets), n)
                yield pa.RecordBatch.from_arrays([part["id"].slice(row, end - row), pa.array(set_hashes(grams, first).view(np.int64)), part["text"].slice(row, end - row)], names=["id", "set", "text"])

    return run


def _mix_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(K.mix(K.longs(batch["id"]).view(np.uint64), 9).view(np.int64))], names=["h"])


def _common(values: np.ndarray, owner: np.ndarray, rows: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of values that each row of left has in common with each of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    size = np.diff(np.append(start, len(values)))
    shared = size > 1  # a value that one row has alone meets nothing
    owner, column = owner[np.repeat(shared, size)], np.repeat(np.arange(shared.sum()), size[shared])
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        m = np.zeros((rows, min(COLUMNS, int(shared.sum()) - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m[left] @ m[right].T
    return out


def judge(sets: list[np.ndarray], smaller: list[list[int]], weight: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links per member, weighted by the partners' multiplicity, and the root (a member's index) of each."""
    rows = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    inter = _common(np.concatenate(sets), np.repeat(np.arange(rows), sizes.astype(int)), rows, left, right)
    linked = inter >= similarity * (sizes[left][:, None] + sizes[right] - inter) - 1e-6
    if same:
        linked &= np.tri(rows, k=-1, dtype=bool)
    if any(smaller) and linked.any():
        owner = np.repeat(np.arange(rows), [len(s) for s in smaller])
        linked &= _common(np.array([k for s in smaller for k in s], np.int64), owner, rows, left, right) == 0
    links = np.zeros(rows)
    np.add.at(links, left, linked @ weight[right])
    np.add.at(links, right, linked.T @ weight[left])
    root = np.arange(rows)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = find(left[a]), find(right[b])
        root[max(a, b)] = min(a, b)
    return links, np.array([find(x) for x in range(rows)], np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal (key, i, j) from sorted batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        ids = np.stack([t[c].to_numpy() for c in ("key", "i", "j")])
        starts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own = tuple(ids[:, a].tolist())
            if own != last and held:
                yield pa.concat_tables(held)
                held = []
            last = own
            held.append(t.slice(a, b - a))
        if held:
            held = [pa.concat_tables(held).combine_chunks()]
    if held:
        yield pa.concat_tables(held)


_MEMBERS = ["set", "text", "keys", "m"]


def _write_block(folder: str, t: pa.Table) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.select(_MEMBERS).schema) as writer:
        writer.write_table(t.select(_MEMBERS))
    key = t["key"][0].as_py()
    put_bytes(f"{folder}/blocks/{key & 0xFF:02x}/{key}-{t['i'][0].as_py()}", sink.getvalue().to_pybytes())


def _read_block(folder: str, key: int, i: int) -> pa.Table:
    try:
        t = pa.ipc.open_stream(get_bytes(f"{folder}/blocks/{key & 0xFF:02x}/{key}-{i}")).read_all()
    except FileNotFoundError:  # a block that no class fell into
        return pa.table({"set": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "keys": pa.array([], pa.list_(pa.int64())), "m": pa.array([], pa.int64()), "block": pa.array([], pa.int32())})
    return t.append_column("block", pa.array([i] * t.num_rows, pa.int32()))


def _pairs_of_blocks(folder: str):
    """Rows (key, i, j) to their blocks' members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for key, i, j in zip(*(batch[c].to_pylist() for c in ("key", "i", "j")), strict=True):
                t = pa.concat_tables([_read_block(folder, key, k) for k in sorted({i, j})])
                yield pa.table({"key": pa.array([key] * t.num_rows, pa.int64()), "i": pa.array([i] * t.num_rows, pa.int32()), "j": pa.array([j] * t.num_rows, pa.int32()), **{c: t[c] for c in (*_MEMBERS, "block")}})

    return run


def _verify(n: int, similarity: float, folder: str, groups: Callable = _groups):
    """Judges groups; those that are one of several blocks are written instead, as their pairs come later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            if not t.num_rows:
                continue
            if "blocks" in t.column_names and t["blocks"][0].as_py() > 1:
                _write_block(folder, t)
                continue
            key, i, j = (t[c][0].as_py() for c in ("key", "i", "j"))
            _, first_row = np.unique(t["set"].to_numpy(), return_index=True)  # repeated rows of a representative
            if len(first_row) < 2:
                continue
            t = t.take(pa.array(first_row))
            ids, block, weight = t["set"].to_numpy(), t["block"].to_numpy(), t["m"].to_numpy().astype(np.float64)
            sets: list[np.ndarray] = []
            for _, _, buf, offsets in K.chunks(t["text"]):
                grams, first = gram_sets(K.split_words(buf, offsets), n)
                sets += [grams[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            smaller = [[x for x in k if x < key] for k in t["keys"].to_pylist()]
            left, right = (np.arange(len(ids)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
            links, root = judge(sets, smaller, weight, left, right, i == j, similarity)
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[root][some])], names=["set", "links", "root"])

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, similarity: float = SIMILARITY) -> DataFrame:
    """id, tag (xxhash64 of the text), class_id (least id of the component), class_tag (of those with that id, the least tag),
    n_links (other documents with similarity at or above the bound)."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tagged = rows.select("id", F.xxhash64("text").alias("tag"), "text")
    sets = materialize(tagged.mapInArrow(_sets(n), "id long, tag long, `set` long, keys array<long>"), folder, "sets")
    real = sets.where("id IS NOT NULL AND `set` IS NOT NULL")
    classes = materialize(real.groupBy("set").agg(F.min("id").alias("rep"), F.min(F.struct("id", "tag")).alias("least"), F.count("*").alias("m"), F.any_value("keys").alias("keys")), folder, "classes")
    pairs = classes.select("set", F.explode("keys").alias("key"))
    live = pairs.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("set").alias("x")).where("n > 1")
    live = materialize(live.groupBy("n", "x").agg(F.min("key").alias("key")).select("key", "n"), folder, "live")
    members = materialize(pairs.join(live, "key"), folder, "members")
    by_set = members.groupBy("set").agg(F.collect_list("key").alias("keys")).join(classes.select("set", "rep", "m"), "set")
    by_set = materialize(by_set, folder, "by_set")
    ids = by_set.select(F.col("rep").alias("id")).mapInArrow(_mix_ids, "h long")
    bitmap = write_bitmap(ids, "h", by_set.count(), f"{folder}/members.bits")
    texts = rows.where("id IS NOT NULL").mapInArrow(_texts_of(bitmap, n), "id long, `set` long, text string")
    texts = texts.join(by_set, "set").where("id = rep").drop("id", "rep")
    release(spark)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("set"), blocks.cast("long")).cast("int")})
    met = dealt.select("set", "key", "blocks", "block", F.col("block").alias("i"), F.col("block").alias("j")).join(texts, "set")
    met = met.repartition("key", "i").sortWithinPartitions("key", "i", "j")
    result = "`set` long, links long, root long"
    found = materialize(met.mapInArrow(_verify(n, similarity, folder), result), folder, "found")
    many = live.where(F.col("n") > BLOCK).select("key", blocks.alias("blocks"))
    if not many.isEmpty():
        pairs = many.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1)))
        pairs = pairs.select("key", "i", "j").repartition("key", "i", "j")
        found = found.unionByName(materialize(pairs.mapInArrow(_verify(n, similarity, folder, _pairs_of_blocks(folder)), result), folder, "found-blocks"))
    release(spark)
    roots = connected_components(found.select(F.col("set").alias("a"), F.col("root").alias("b")), folder)
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    info = classes.select("set", "least", "m").join(links, "set", "left").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    info = materialize(info, folder, "info")
    least = info.groupBy("root").agg(F.min("least").alias("class"))
    info = materialize(info.join(least, "root").select("set", F.col("class.id").alias("class_id"), F.col("class.tag").alias("class_tag"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), folder, "result")
    # copies of one text may be a third of all rows: the small side is unique by set, so Spark can split the large one
    found = real.select("id", "tag", "set").join(info, "set").select("id", "tag", "class_id", "class_tag", "n_links")
    return found.unionByName(sets.where("id IS NULL OR `set` IS NULL").select("id", "tag", F.col("id").alias("class_id"), F.col("tag").alias("class_tag"), F.lit(0).cast("long").alias("n_links")))


def ngram_join(documents: DataFrame) -> DataFrame:
    """The op2 result."""
    return near_copies(documents).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def _pair_hash(batch: pa.RecordBatch, own: str, tag: str) -> np.ndarray:
    return K.mix(K.mix(K.longs(batch[own]).view(np.uint64), 9) ^ K.longs(batch[tag]).view(np.uint64), 10)


def _pair_keys(own: str, tag: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_pair_hash(batch, own, tag).view(np.int64))], names=["h"])

    return run


def _pairs_in(bitmap: str, own: str, tag: str, inside: bool):
    """Rows whose id and tag may be in the bitmap, or are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap, _pair_hash(batch, own, tag)) == inside))

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class: that with the least id (null ids come last), of those the one with the least tag
    of its text. Of rows with equal id and text one stays. Any column name is taken."""
    spark = docs.sparkSession
    own, tag = (next(x for x in (f"{name}_{k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns) for name in ("id", "tag"))
    last = (1 << 63) - 1
    rows = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(last)), tag: F.xxhash64(F.col(text_col).cast("string"))})
    found = materialize(near_copies(rows.select(own, text_col), own, text_col, n, similarity), shared_dir(spark), "classes").withColumnsRenamed({"id": own, "tag": tag})
    gone = materialize(found.where(f"{own} != class_id OR {tag} != class_tag").select(own, tag).distinct(), shared_dir(spark), "gone")
    # rows without an id and without words are no copies of each other
    twice = found.groupBy(own, tag).count().where(f"count > 1 AND {own} != {last}").select(own, tag)
    empty = found.where(f"{own} = {last} AND n_links > 0").groupBy(own, tag).count().where("count > 1").select(own, tag)
    twice = materialize(twice.union(empty), shared_dir(spark), "twice")
    # only rows that may go, or may be there twice, are shuffled with their texts
    keys = gone.union(twice).mapInArrow(_pair_keys(own, tag), "h long")
    bitmap = write_bitmap(keys, "h", gone.count() + twice.count(), f"{shared_dir(spark)}/gone.bits")
    some = rows.mapInArrow(_pairs_in(bitmap, own, tag, True), rows.schema).join(gone, [own, tag], "left_anti")
    some = materialize(some, shared_dir(spark), "some")
    once = rows.mapInArrow(_pairs_in(bitmap, own, tag, False), rows.schema).unionByName(some.join(twice, [own, tag], "left_anti"))
    return once.unionByName(some.join(twice, [own, tag], "left_semi").dropDuplicates([own, tag])).select(*docs.columns)
