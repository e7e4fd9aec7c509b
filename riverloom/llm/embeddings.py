"""Near-duplicate vectors: sign hashes of random hyperplanes in several tables, exact cosines, connected components.

Equal vectors with equal labels are one node before anything is joined. Each node gets TABLES codes of BITS signs; nodes
with equal label, table and code meet in a bucket. Buckets are found by 64-bit hashes of these alone, and of buckets
with the same nodes the one of the first table is looked at; only then do vectors join. A bucket is dealt out in pairs
of blocks of bounded size, so no task holds more than two blocks of a bucket. A task compares the vectors of its blocks
exactly and returns, per node, how many rows it links to and a link within its group; it emits no pairs. A pair that
shares a bucket of an earlier table is counted there only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverloom.llm import common
from riverloom.llm.components import connected_components

THRESHOLD = 0.98
#: A pair at a cosine of 0.98 misses all tables with probability 6e-4, one at 0.99 with 5e-6.
TABLES, BITS = 24, 20
#: Nodes in a block.
BLOCK = 512
#: Numbers of vectors, and pairs of them, that a task holds as doubles at once.
CHUNK, PAIRS = 2_000_000, 50_000
SEED = 20240601


def matrix_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) of each length of vectors without nulls, in chunks of about CHUNK numbers."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        for a in range(0, len(rows), max(1, CHUNK // dim)):
            some = rows[a : a + max(1, CHUNK // dim)]
            flat = column.take(pa.array(some)).flatten()
            null = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
            values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            yield some[~null], values[~null]


def units_of(x: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision; those without a direction become nan."""
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lru_cache(maxsize=2)
def planes(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, TABLES * BITS))


def codes_of(units: np.ndarray) -> np.ndarray:
    """(n, TABLES) sign codes of unit vectors of one dimension."""
    signs = (units @ planes(units.shape[1]) >= 0).reshape(len(units), TABLES, BITS)
    return (signs * (1 << np.arange(BITS))).sum(axis=2).astype(np.int32)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and codes of vectors that can link; null for others, whose vectors are null, too."""
    for batch in batches:
        labels = batch.column("label")
        digest: list[bytes | None] = [None] * batch.num_rows
        codes = np.zeros((batch.num_rows, TABLES), np.int32)
        named = labels.is_valid().to_numpy(zero_copy_only=False)
        names = labels.to_pylist()
        for rows, x in matrix_of(batch.column("vector")):
            units = units_of(x)
            good = named[rows] & np.isfinite(x).all(axis=1) & np.isfinite(units).all(axis=1)
            rows, x, units = rows[good], x[good] + 0.0, units[good]  # -0.0 is 0.0
            if len(rows):
                codes[rows] = codes_of(units)
            for k, v in zip(rows.tolist(), x, strict=True):
                digest[k] = hashlib.blake2b(names[k].encode() + b"\0" + v.tobytes(), digest_size=16).digest()
        good = np.array([d is not None for d in digest], bool)
        ends = np.concatenate([[0], np.cumsum(np.where(good, TABLES, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes[good].ravel()))
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"),
                pc.if_else(keep, labels, pa.scalar(None, pa.string())),
                pa.array(digest, pa.binary()),
                pc.if_else(keep, batch.column("vector"), pa.scalar(None, batch.column("vector").type)),
                pc.if_else(keep, lists, pa.scalar(None, lists.type)),
            ],
            ["vec_id", "label", "digest", "vector", "codes"],
        )
    common.release()


KEY = ["key", "low", "high"]
COMPARED = "node long, links long, other long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole pieces, from batches sorted by KEY: all that are complete once a batch is read."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, k: int) -> tuple:
        return tuple(b.column(c)[k].as_py() for c in KEY)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = key(batch, batch.num_rows - 1)
        if held and key(held[-1], held[-1].num_rows - 1) == last and key(batch, 0) == last:
            held.append(batch)
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in KEY]
        same = np.logical_and.reduce([c == x for c, x in zip(columns, last, strict=True)])
        a = int(np.flatnonzero(same)[0])
        if a or held:
            yield pa.Table.from_batches([*held, batch.slice(0, a)])
        held = [batch.slice(a)]
    if held:
        yield pa.Table.from_batches(held)


def _within(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i before j, of the rows of each group, about PAIRS at once."""
    count = size * (size - 1) // 2
    total = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
        parts = [np.triu_indices(n, 1) for n in range(int(size[a:b].max()) + 1)]
        i = [parts[n][0] + f for f, n in zip(first[a:b].tolist(), size[a:b].tolist(), strict=True)]
        j = [parts[n][1] + f for f, n in zip(first[a:b].tolist(), size[a:b].tolist(), strict=True)]
        yield np.concatenate(i), np.concatenate(j)
        a = b


def _near(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the cosine of each pair of rows is THRESHOLD or more."""
    a, b = x[i], x[j]
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)) >= THRESHOLD


def _linked_pairs(x, label, codes, block, tab, low, high, first, size) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows of the same piece that no earlier table shows."""

    def fresh(i, j):
        keep = label[i] == label[j]
        i, j = i[keep], j[keep]
        keep = _near(x, i, j)
        i, j = i[keep], j[keep]
        earlier = (codes[i] == codes[j]) & (np.arange(TABLES) < tab[i][:, None])
        keep = ~earlier.any(axis=1)
        return i[keep], j[keep]

    small = (size <= 32) & (low[first] == high[first])
    for i, j in _within(first[small], size[small]):
        yield fresh(i, j)
    for f, n in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
        own = np.arange(f, f + n)
        a, b = own[block[own] == low[f]], own[block[own] == high[f]]
        for k in range(0, len(a), max(1, 4_000_000 // max(1, len(b)))):
            part = a[k : k + max(1, 4_000_000 // max(1, len(b)))]
            i, j = np.nonzero(x[part] @ x[b].T >= THRESHOLD - 1e-9)
            i, j = part[i], b[j]
            if low[f] == high[f]:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), PAIRS):
                yield fresh(i[c : c + PAIRS], j[c : c + PAIRS])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _pieces(batches):
        rows = rows.combine_chunks()
        get = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)  # noqa: E731, B023
        key, low, high = (get(c) for c in KEY)
        node, n, block, tab, label = (get(c) for c in ("node", "n", "block", "tab", "label"))
        size = pc.list_value_length(rows.column("vector").combine_chunks()).to_numpy(zero_copy_only=False)
        codes = pc.list_flatten(rows.column("codes").combine_chunks()).to_numpy(zero_copy_only=False).reshape(-1, TABLES)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        links = np.zeros(len(key), np.int64)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(key)))
        i_all, j_all = [], []
        flat = rows.column("vector").combine_chunks()
        a = 0
        while a < len(first):  # pieces whose vectors have about CHUNK numbers together
            ends = np.cumsum(np.add.reduceat(size, first[a:]).astype(np.int64))
            b = a + max(1, int(np.searchsorted(ends, CHUNK, side="right")))
            lo, hi = int(first[a]), int(first[b]) if b < len(first) else len(key)
            part = slice(lo, hi)
            dims = np.unique(size[part])
            for dim in dims.tolist():  # a bucket's hash covers the length: others are rare collisions
                at = np.flatnonzero(size[part] == dim) + lo
                x = units_of(pc.list_flatten(flat.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                of = np.searchsorted(first, at, side="right") - 1
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                args = (x, label[at], codes[at], block[at], tab[at], low[at], high[at], begin, np.diff(np.append(begin, len(at))))
                for i, j in _linked_pairs(*args):
                    i, j = at[i], at[j]
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    i_all.append(i), j_all.append(j)
                    if sum(map(len, i_all)) > CHUNK:  # what reaches what takes a pair a row
                        root = common.roots(hi - lo, np.concatenate(i_all) - lo, np.concatenate(j_all) - lo) + lo
                        some = np.flatnonzero(root != np.arange(lo, hi))
                        i_all, j_all = [some + lo], [root[some]]
            if i_all:
                i, j = np.concatenate(i_all), np.concatenate(j_all)
                root = common.roots(hi - lo, i - lo, j - lo)
                some = np.flatnonzero(links[part])
                yield pa.RecordBatch.from_pydict(
                    {"node": pa.array(node[lo + some], pa.int64()), "links": pa.array(links[lo + some]), "other": pa.array(node[lo + root[some]], pa.int64())}
                )
                i_all, j_all = [], []
            a = b
    common.release()


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``rows``.

    Rows link when their labels are equal and not null, their vectors have one length, and their cosine is THRESHOLD or
    more: a cosine of exactly that links. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing. Rows that repeat an id are vectors like others: each counts. A null id never names a component that
    has another id. An empty table gives an empty one. Other columns are not read, whatever their names.
    """
    with common.Scratch(rows.sparkSession) as scratch:
        return scratch.keep(_linked(rows, id_col, vector_col, label_col), "near-vectors")


def _linked(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    kind = base.schema["vector"].dataType.simpleString()
    hashed = base.mapInArrow(_hash, f"vec_id long, label string, digest binary, vector {kind}, codes array<int>")
    # once written, numbers of rows stay what they are
    base = common.written(hashed.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    valid = base.where("digest is not null")
    counts = valid.groupBy("digest").agg(F.min("uid").alias("node"), F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    counts = common.written(counts, "vector-nodes")
    many = counts.where("n > 1").select("digest", "node", "n")
    copies = common.written(valid.select("digest", "uid").join(many, "digest").select("uid", "node"), "vector-copies")
    nodes = valid.join(copies.where("uid <> node").select("uid"), "uid", "left_anti").withColumnRenamed("uid", "node")
    keyed = nodes.select("node", "label", F.size("vector").alias("dim"), F.posexplode("codes").alias("tab", "code"))
    keyed = keyed.select("node", "tab", F.xxhash64("label", "dim", "tab", "code").alias("key"))
    size = common.written(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "vector-sizes")
    buckets = common.written(keyed.join(size, "key"), "vector-buckets")
    wide = "decimal(38,0)"
    sets = buckets.groupBy("key").agg(
        F.min("tab").alias("tab"), F.sum(F.xxhash64("node").cast(wide)).alias("s"), F.sum(F.xxhash64(F.lit(1), "node").cast(wide)).alias("t")
    )
    # of buckets with the same nodes the first: a pair is counted in the first bucket that it shares, which is kept
    sets = sets.groupBy("s", "t").agg(F.min(F.struct("tab", "key")).alias("x")).select(F.col("x.key").alias("key"))
    meeting = common.in_blocks(buckets.join(common.written(sets, "vector-sets"), "key"), F.ceil(F.col("m") / BLOCK), "node")
    meeting = common.written(meeting.select("node", "tab", *KEY, "block"), "vector-pieces")
    wanted = common.written(meeting.select("node").distinct(), "vector-wanted")
    full = nodes.join(wanted, "node", "left_semi").join(many.select("node", "n"), "node", "left").select("node", "label", "vector", "codes", F.coalesce("n", F.lit(1)).alias("n"))
    dealt = meeting.join(full, "node").repartition(*KEY).sortWithinPartitions(*KEY)
    found = common.written(dealt.mapInArrow(_compare, COMPARED), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = counts.join(component.withColumnRenamed("id", "node"), "node", "left").where("n > 1 or component is not null")
    placed = common.written(placed.withColumn("component", F.coalesce("component", "node")), "vector-placed")
    least = common.written(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "vector-least")
    placed = placed.join(least, "component").join(links, "node", "left")
    placed = placed.select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = base.select("vec_id", "digest").join(common.written(placed, "vector-components"), "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", common.same(F.col("vec_id"), F.col("component_id")))
