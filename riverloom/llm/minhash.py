"""Near-duplicates by dart-throwing weighted minimum hashes, banded joining and exact verification.

A document is the multiset of its runs of five words; the similarity of two is the sum of the smaller counts over the
sum of the larger ones, and 0.8 links them. The weights of an element are cut into regions, each as wide as all below
it, in which darts land, hashed from the element alone, so equal elements of two documents meet equal darts and a
weight costs its logarithm. A dart has a rank and a coordinate; a document keeps the earliest dart of each coordinate. Only darts up to a rank that leaves about TARGET of them per
document are thrown; a document with a coordinate still empty throws again up to twice that rank.

Equal word sequences are one class before anything is joined. Bands of the signature then name buckets. In each bucket
the member that shares most of its buckets with others is tested against all others (a star, not all pairs); what the
stars link becomes components. Where a bucket still holds members of different components, it is dealt out in pairs of
blocks, and a task compares all members across components through a table of their elements, so no link that a bucket
could show is lost and no pairs are emitted. All tests compare the exact multisets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverloom.llm import common
from riverloom.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Coordinates of a signature: BANDS x ROWS, a pair at 0.8 misses all bands with probability 7e-5.
COORDINATES = BANDS * ROWS
#: Darts that a document throws at first: leaves no coordinate empty for most documents.
TARGET = 900
#: Words and documents of a block.
BLOCK_WORDS, BLOCK = 128_000, 512
#: Words that one batch of array operations covers.
BATCH_WORDS = 150_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_G = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, each computed once while the table has room."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = h
        return h


def elements(words: list[list[bytes]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of SHINGLE words; a shorter document, if not empty, is one run."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    get = hashes.__getitem__
    w = np.fromiter((get(x) for d in words for x in d), np.uint64, int(sizes.sum()))
    start = np.cumsum(sizes) - sizes
    runs = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(words)), runs)
    at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + start[doc]
    left = sizes[doc] - (at - start[doc])
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        inside = k < left
        h = h * _BASE + np.where(inside, w[np.where(inside, at + k, 0)] if len(w) else 0, np.uint64(0))
        h = mix(h + _G)
    return doc, h


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal elements of a document as one with its count."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h))).astype(np.float64)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES, floor: float = 1.0) -> np.ndarray:
    """(n, k) earliest darts; doc ascending. All zeros for a document without elements. Weights may be any positive numbers.

    Regions of weight are [0, floor), [floor, 2 floor), [2 floor, 4 floor), ...; darts fall into a region in proportion
    to its width, and count where they fall below the weight. ``floor`` must be the same for all documents that are
    compared, and near the smallest weights: smaller ones cost in inverse proportion.
    """
    table = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(doc, weight, n)
    limit = np.where(total > 0, TARGET / np.maximum(total, 1e-300), 0)
    open_ = total > 0
    while open_.any():
        own = open_[doc]
        d, e, w = doc[own], h[own], weight[own] / floor
        regions = 1 + np.ceil(np.log2(np.maximum(w, 1.0))).astype(np.int64)
        part = np.arange(int(regions.sum())) - np.repeat(np.cumsum(regions) - regions, regions)
        d, e = np.repeat(d, regions), np.repeat(e, regions)
        width = np.where(part > 0, 2.0 ** (part - 1), 1.0)
        room = np.minimum((np.repeat(w, regions) - np.where(part > 0, width, 0.0)) / width, 1.0)  # the share that counts
        rate = width * floor
        state = mix(e + mix(part.astype(np.uint64) + _G))
        rank = np.zeros(len(d))
        while len(d):
            state = mix(state + _G)
            step = (state >> np.uint64(11)).astype(np.float64)
            rank = rank - np.log((step + 1.0) / 2.0**53) / rate
            on = rank < limit[d]
            d, rank, room, rate, state = d[on], rank[on], room[on], rate[on], state[on]
            dart = mix(state ^ _M2)
            inside = room >= 1.0
            if not inside.all():
                inside |= (mix(dart + _M1) >> np.uint64(11)).astype(np.float64) / 2.0**53 < room
            key = (rank[inside].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart[inside] >> np.uint64(32))
            coordinate = ((dart[inside] & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
            np.minimum.at(table, d[inside] * k + coordinate.astype(np.int64), key)
        empty = (table.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1) & open_
        limit[empty] *= 2
        open_ = empty
    out = table.reshape(n, k)
    out[total <= 0] = 0
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the bands of signatures; the band's number is part of its hash."""
    x = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _G, x.shape[:2])
    for k in range(ROWS):
        h = mix(h * _BASE + x[:, :, k] + _G)
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two documents as (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either else 0.0


def _batches(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first document, words of each) of runs of about BATCH_WORDS words."""
    held: list[list[bytes]] = []
    first = size = 0
    for a, texts in common.text_slices(column, 2_000_000):
        for k, t in enumerate(texts, a):
            w = common.split_words(t)
            if held and size + len(w) > BATCH_WORDS:
                yield first, held
                held, first, size = [], k, 0
            held.append(w)
            size += len(w)
    if held:
        yield first, held


SIGNED = "doc_id long, digest binary, n_words long, bands array<long>"


def word_digest(words: list[bytes]) -> bytes | None:
    """Names a word sequence; None where there are no words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids = batch.column("doc_id")
        for first, words in _batches(batch.column("text")):
            n = len(words)
            doc, h = elements(words, hashes)
            sig = signatures(*counted(doc, h), n)
            digest = [word_digest(w) for w in words]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids.slice(first, n),
                    "digest": pa.array(digest, pa.binary()),
                    "n_words": pa.array([len(w) for w in words], pa.int64()),
                    "bands": _lists(bands(sig)),
                }
            )
    del hashes
    common.release()


def with_digest(docs: DataFrame, text_col: str, name: str = "digest") -> DataFrame:
    """``docs`` with the digest of each text's word sequence, null where it has no words."""
    docs = docs.drop(name)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` binary"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in _batches(batch.column(text_col)):
                part = batch.slice(first, len(words))
                digest = pa.array([word_digest(w) for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, digest], [*part.schema.names, name])
        common.release()

    return docs.mapInArrow(add, schema)


def _lists(x: np.ndarray) -> pa.Array:
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(x.ravel()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    last, known = None, None

    def profile(text):
        _, h, n = counted(*elements([common.split_words(text)], hashes))
        return h, n

    for batch in batches:
        keep = []
        for a in range(0, batch.num_rows, 500):
            for row in batch.slice(a, 500).to_pylist():
                if last != row["a"]:
                    last, known = row["a"], profile(row["text_a"])
                keep.append(similarity(known, profile(row["text_b"])) >= THRESHOLD)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    common.release()


KEY = ["band", "h", "low", "high"]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between members of different components in each piece of a bucket.

    The elements of the piece's documents are one inverted table; a document's common weight with all others is summed
    over the lists of its own elements. A linked document is returned with the smallest one that it reaches.
    """
    hashes = WordHashes()
    a: list[int] = []
    b: list[int] = []
    for rows in common.groups(batches, KEY):
        n, low, high = len(rows), rows[0]["low"], rows[0]["high"]
        block = np.asarray([r["block"] for r in rows])
        component = np.asarray([r["component"] for r in rows])
        doc, h, count = counted(*elements([common.split_words(r["text"]) for r in rows], hashes))
        cut = np.searchsorted(doc, np.arange(n + 1))
        total = np.bincount(doc, count, n)
        _, at = np.unique(h, return_inverse=True)
        order = np.argsort(at, kind="stable")
        begin = np.searchsorted(at[order], np.arange(int(at.max(initial=-1)) + 2))
        i, j = [], []
        for k in np.flatnonzero(block == low).tolist():
            own = at[cut[k] : cut[k + 1]]
            size = begin[own + 1] - begin[own]
            lists = order[np.arange(int(size.sum())) + np.repeat(begin[own] - np.cumsum(size) + size, size)]
            common_ = np.bincount(doc[lists], np.minimum(np.repeat(count[cut[k] : cut[k + 1]], size), count[lists]), n)
            near = common_ >= THRESHOLD * (total[k] + total - common_)
            near &= (component != component[k]) & (block == high)
            if low == high:
                near[:k] = False
            found = np.flatnonzero(near)
            i += [k] * len(found)
            j += found.tolist()
        if i:
            root = common.roots(n, np.asarray(i), np.asarray(j))
            for k in sorted({*i, *j}):
                if root[k] != k:
                    a.append(rows[k]["node"])
                    b.append(rows[root[k]]["node"])
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    common.release()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id), one row per distinct id: the class is the smallest id of all near-duplicates linked to it.

    Rows that repeat an id are one document: it has the links of all its texts, and so links the classes of texts that
    differ. Null ids are left out. A text that is null or has no words is like nothing and is its own class. A text of
    fewer than five words is one run. Texts of any length are compared whole; similarities of exactly 0.8 link. An empty
    table has no classes. Other columns are not read, whatever their names.
    """
    with common.Scratch(docs.sparkSession) as scratch:
        placed = common.written(text_classes(docs, id_col=id_col, text_col=text_col), "placed")
        several = placed.where("component is not null").groupBy("doc_id")
        several = several.agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a <> z").select("doc_id", "a")
        several = common.written(several, "several")
        placed = placed.withColumn("whole", F.col("component"))
        if not several.isEmpty():
            same = placed.join(several, "doc_id").select("a", F.col("component").alias("b")).where("a <> b")
            merged = connected_components(same).select(F.col("id").alias("component"), F.col("component").alias("into"))
            placed = placed.join(merged, "component", "left").withColumn("whole", F.coalesce("into", "component"))
            placed = common.written(placed.select("doc_id", "whole"), "whole")
        least = placed.where("whole is not null").groupBy("whole").agg(F.min("doc_id").alias("class_id"))
        found = placed.join(common.written(least, "least"), "whole", "left").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
        return scratch.keep(found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")), "classes")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one of each class of near-duplicate texts does: that with the smallest id.

    Rows that repeat an id are judged each by its own text: those with texts of different classes are no duplicates. Of
    rows that repeat an id and a word sequence the one stays whose text, then whose hash over all columns, is smallest.
    Rows without an id take part in no class and stay; so do texts without words, once for each id and text.
    """
    own, digest = "__doc_id", "__digest"
    docs_ = docs.withColumn(own, F.col(id_col).cast("long"))
    classes = common.written(text_classes(docs, id_col=id_col, text_col=text_col), "placed")
    first = F.min(F.struct("doc_id", "digest")).alias("x")
    first = common.written(classes.where("component is not null").groupBy("component").agg(first), "first")
    other = classes.join(first, "component").where("doc_id <> x.doc_id or digest <> x.digest")
    gone = common.written(other.select(F.col("doc_id").alias(own), F.col("digest").alias(digest)), "gone")
    again = common.written(docs_.where(F.col(own).isNotNull()).groupBy(own).count().where("count > 1").select(own), "repeated")
    once = docs_.join(again, own, "left_anti").join(gone.select(own), own, "left_anti")
    names = [own, digest]
    more = with_digest(docs_.join(again, own, "left_semi"), text_col, digest).join(gone, names, "left_anti")
    plain = [f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    line = Window.partitionBy(*names, F.when(F.col(digest).isNull(), F.col(text_col))).orderBy(text_col, F.xxhash64(*plain))
    more = more.withColumn("__n", F.row_number().over(line)).where("__n = 1")
    return once.select(*docs.columns).unionByName(more.select(*docs.columns))


def text_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, component), a row per distinct pair: the class of each different word sequence of each id.

    A component is a number of this run; it is null, as the digest is, for texts without words.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    # once written, numbers of rows stay what they are
    signed = common.written(base.mapInArrow(_sign, SIGNED).withColumn("uid", F.monotonically_increasing_id()), "signed")
    some = signed.where("n_words > 0")
    # Equal word sequences are one node: the number of one of their rows, whose bands stand for all. Tables that tell a
    # group's size, star or node are written before they are joined, so the join is free to split a large group.
    rep = some.groupBy("digest").agg(F.min("uid").alias("node"), F.min_by("doc_id", "uid").alias("doc_id"))
    rep = common.written(rep, "nodes")
    rows = some.join(rep.select(F.col("node").alias("uid")), "uid", "left_semi")
    rows = rows.select(F.col("uid").alias("node"), "n_words", F.posexplode("bands").alias("band", "h"))
    rows = common.written(rows, "bands")
    size = rows.groupBy("band", "h").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    size = common.written(size.where("n > 1"), "bucket-sizes")
    rows = common.written(rows.drop("n_words").join(size, ["band", "h"]), "buckets")
    degree = common.written(rows.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    star = rows.join(degree, "node").groupBy("band", "h").agg(F.max(F.struct("degree", "node")).alias("x"))
    star = common.written(star.select("band", "h", F.col("x.node").alias("star")), "stars")
    pairs = rows.join(star, ["band", "h"]).where("star <> node").select(F.col("star").alias("a"), F.col("node").alias("b"))
    texts = _texts(base, rep, degree.select("node"))
    first = common.written(_verified(pairs.distinct(), texts), "linked")
    component = connected_components(first)
    across = _across(rows, component, texts)
    if not across.isEmpty():
        component = connected_components(component.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(across))
    node = rep.select("digest", "node").join(component.withColumnRenamed("id", "node"), "node", "left")
    node = common.written(node.select("digest", F.coalesce("component", "node").alias("component")), "node-components")
    placed = signed.select("doc_id", "digest").distinct()
    return placed.join(node, "digest", "left").select("doc_id", "digest", "component")


def _texts(base: DataFrame, rep: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the word sequences that stand in a bucket, once each, from documents that have them.

    Such a document's id may have other texts as well, so the digests of its texts are computed again.
    """
    wanted = common.written(rep.join(nodes, "node", "left_semi"), "wanted")
    ids = wanted.select("doc_id").distinct()
    found = with_digest(base.join(ids, "doc_id", "left_semi").select("text"), "text").join(wanted.select("digest", "node"), "digest")
    return common.written(found.groupBy("node").agg(F.min("text").alias("text")), "texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those with a similarity of THRESHOLD or more."""
    other = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = other.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def _across(rows: DataFrame, component: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of different components of a bucket; buckets with the same members are looked at once."""
    placed = rows.join(component.withColumnRenamed("id", "node"), "node", "left")
    placed = common.written(placed.withColumn("component", F.coalesce("component", "node")), "placed")
    wide = "decimal(38,0)"
    mixed = placed.groupBy("band", "h").agg(
        F.min("component").alias("x"),
        F.max("component").alias("y"),
        F.sum(F.xxhash64("node").cast(wide)).alias("s"),
        F.sum(F.xxhash64(F.lit(1), "node").cast(wide)).alias("t"),
    )
    mixed = mixed.where("x <> y").groupBy("s", "t").agg(F.min(F.struct("band", "h")).alias("z")).select("z.*")
    members = placed.join(common.written(mixed, "mixed"), ["band", "h"])
    blocks = F.greatest(F.ceil(F.col("words") / BLOCK_WORDS), F.ceil(F.col("n") / BLOCK))
    dealt = common.in_blocks(members, blocks, "node").join(texts, "node")
    dealt = dealt.select(*KEY, "block", "node", "component", "text")
    dealt = dealt.repartition(*KEY).sortWithinPartitions(*KEY)
    return common.written(dealt.mapInArrow(_link, "a long, b long"), "across")
