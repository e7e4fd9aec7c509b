"""Benchmark decontamination: an FM-index over each shard of training text, searched backwards for test phrases.

A shard is a run of documents of bounded size. All its words become numbers, and its documents (equal ones once) are the
indexed text. The index is the Burrows-Wheeler transform of that text in a wavelet matrix, whose bit planes answer how
often a symbol occurs before a row, and a sample of suffix positions; it does not depend on the benchmark. All phrases
of the benchmark, block by block, are searched in it together, word by word from their ends; each occurrence is located
by stepping backwards to the next sampled position. Occurrences in a document merge into spans to remove.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverloom.llm import common

#: Words of documents that one index covers; a longer document is a shard of its own.
SHARD_WORDS = 400_000
#: Bytes of benchmark text that a task holds at once; a longer benchmark is searched in blocks of so many.
BLOCK_BYTES = 8_000_000
#: Every so many text positions one suffix position is kept.
SAMPLE = 8
#: Occurrences that are located at once.
LOCATED = 1_000_000


class RankBits:
    """A packed bit vector that counts its ones before a position in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits.astype(bool), bitorder="little")
        self.words = np.zeros(n // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.total = int(self.before[-1]) + int(np.bitwise_count(self.words[-1]))

    def rank1(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Occurrences of a symbol before a position, by one bit plane for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.planes: list[RankBits] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            self.planes.append(RankBits(bit))
            self.zeros.append(len(now) - self.planes[-1].total)
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros(len(symbol), np.int64)
        at = np.asarray(i, np.int64)
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            a, b = plane.rank1(low), plane.rank1(at)
            low = np.where(one, zeros + a, low - a)
            at = np.where(one, zeros + b, at - b)
        return at - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order. Symbols are small whole numbers, of which the last occurs once.

    Suffixes are sorted by as many symbols as fit an integer; groups that are still equal are sorted by the ranks of
    what follows, twice as far in each round, and only they are looked at again.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(symbols.max()).bit_length())
    step = min(n, max(1, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: n - k] += symbols[k:]
    sa = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's number is where it begins
    rank = np.empty(n, np.int64)
    rank[sa] = group
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # rows of groups of several suffixes
    while len(open_):
        at = sa[open_]
        follow = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        order = np.lexsort((follow, group[open_]))
        at, follow = at[order], follow[order]
        sa[open_] = at
        new = np.ones(len(open_), bool)
        new[1:] = (follow[1:] != follow[:-1]) | (group[open_][1:] != group[open_][:-1])
        group[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        rank[at] = group[open_]
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return sa


class FMIndex:
    """Counts and locates phrases in a text of symbols 1.. in which 0 ends every run."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        self.n = len(text)
        ends = np.flatnonzero(text == 0)
        first = text.astype(np.int64) + len(ends)
        first[ends] = np.arange(len(ends))  # each run ends in an end of its own, so no comparison goes beyond
        sa = suffix_array(first)
        self.bwt = text[sa - 1].astype(np.int32)
        self.wavelet = WaveletMatrix(self.bwt, n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        starts = np.concatenate([[0], ends[:-1] + 1]) if self.n else ends
        kept = np.arange(self.n) % sample == 0
        kept[starts] = True  # a run is never left backwards
        self.marked = RankBits(kept[sa])
        self.sampled = sa[kept[sa]].astype(np.int32)

    def search(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase symbols[start : start + length].

        A symbol of 0 is one that the text lacks: its phrase has no rows.
        """
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        live = np.arange(len(start))
        for k in range(int(length.max(initial=0))):
            live = live[(length[live] > k) & (low[live] < high[live])]
            if not len(live):
                break
            c = symbols[start[live] + length[live] - 1 - k]
            high[live[c == 0]] = 0
            live, c = live[c > 0], c[c > 0]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            open_ = open_[~self.marked[rows[open_]]]
            r = rows[open_]
            c = self.bwt[r]
            rows[open_] = self.before[c] + self.wavelet.rank(c, r)
            steps[open_] += 1
        return self.sampled[self.marked.rank1(rows)] + steps if len(rows) else rows


@dataclass
class Phrases:
    """Windows of a block of benchmark items: places in one array of word numbers, so a word costs a few bytes."""

    words: list[bytes]  # word k has the number k
    numbers: np.ndarray  # of the words of all items
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray  # the item that a window is of
    names: list[str | None]

    @classmethod
    def of(cls, rows: list[tuple[str | None, list[bytes]]], width: int) -> Phrases:
        known: dict[bytes, int] = {}
        sizes = np.fromiter((len(w) for _, w in rows), np.int64, len(rows))
        numbers = np.fromiter((known.setdefault(x, len(known)) for _, w in rows for x in w), np.int32, int(sizes.sum()))
        count = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
        item = np.repeat(np.arange(len(rows), dtype=np.int32), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = (np.cumsum(sizes) - sizes)[item] + at
        return cls(list(known), numbers, start.astype(np.int32), np.minimum(sizes, width)[item].astype(np.int16), item, [n for n, _ in rows])


class Shard:
    """A run of documents as one indexed text."""

    def __init__(self, words: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        seen: dict[bytes, int] = {}
        pieces: list[np.ndarray] = []
        self.which = np.zeros(len(words), np.int64)  # the distinct document that each one is
        end = np.zeros(1, np.int32)
        for k, w in enumerate(words):
            ids = np.fromiter((self.number.setdefault(x, len(self.number) + 1) for x in w), np.int32, len(w))
            self.which[k] = j = seen.setdefault(ids.tobytes(), len(seen))
            if 2 * j == len(pieces):
                pieces += [ids, end]
        text = np.concatenate(pieces)
        self.first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in pieces[::2]])])
        self.index = FMIndex(text, len(self.number) + 1)
        self.change = np.zeros(len(text) + 1, np.int64)  # of the number of occurrences over each word
        self.items: list[set[str]] = [set() for _ in seen]

    def find(self, phrases: Phrases) -> None:
        """Mark the occurrences of a block's phrases, and gather the items that they are of."""
        if not len(phrases.start):
            return
        symbols = np.fromiter((self.number.get(w, 0) for w in phrases.words), np.int32, len(phrases.words))[phrases.numbers]
        low, high = self.index.search(symbols, phrases.start, phrases.length)
        found = np.flatnonzero(high > low)
        # equal phrases have equal rows and lengths: each is located once
        key = np.stack([low[found], high[found], phrases.length[found]])
        distinct, of = np.unique(key, axis=1, return_inverse=True)
        order = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[order], np.arange(distinct.shape[1] + 1))
        count = distinct[1] - distinct[0]
        total = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(count):
            b = max(a + 1, int(np.searchsorted(total, total[a] + LOCATED, side="right")) - 1)
            phrase = np.repeat(np.arange(a, b), count[a:b])
            rows = np.arange(int(total[b] - total[a])) + np.repeat(distinct[0, a:b] - total[a:b] + total[a], count[a:b])
            at = self.index.locate(rows)
            np.add.at(self.change, at, 1)
            np.add.at(self.change, at + distinct[2, phrase], -1)
            doc = np.searchsorted(self.first, at, side="right") - 1
            for d, p in np.unique(np.stack([doc, phrase]), axis=1).T.tolist():
                names = (phrases.names[phrases.item[found[k]]] for k in order[begin[p] : begin[p + 1]])
                self.items[d].update(n for n in names if n is not None)
            a = b

    def spans(self) -> tuple[list[list[dict]], list[list[str]]]:
        """Per document, merged spans in its word numbers, and the names of its items in order."""
        hit = np.concatenate([[False], np.cumsum(self.change[:-1]) > 0, [False]])
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        begin, end = edge[::2], edge[1::2]
        doc = np.searchsorted(self.first, begin, side="right") - 1
        spans: list[list[dict]] = [[] for _ in self.items]
        for d, x, y in zip(doc.tolist(), (begin - self.first[doc]).tolist(), (end - self.first[doc]).tolist(), strict=True):
            spans[d].append({"start": x, "end": y})
        names = [sorted(x) for x in self.items]
        return [spans[d] for d in self.which], [names[d] for d in self.which]


def _shards(column: pa.Array, most: int) -> Iterator[tuple[int, list[str | None], list[list[bytes]]]]:
    """(first document, texts, words) of runs of about ``most`` words; a longer document is a run alone."""
    held: list[list[bytes]] = []
    kept: list[str | None] = []
    first = size = 0
    for a, texts in common.text_slices(column, 2_000_000):
        for k, t in enumerate(texts, a):
            w = common.split_words(t)
            if held and size + len(w) > most:
                yield first, kept, held
                held, kept, first, size = [], [], k, 0
            held.append(w)
            kept.append(t)
            size += len(w)
    if held:
        yield first, kept, held


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


#: The block that a worker searched last; reading it anew for every task would cost as much as a small shard.
_LAST: dict[str, Phrases] = {}


def _block(path: str) -> Phrases:
    if path not in _LAST:
        _LAST.clear()
        fs, at = common.filesystem(path)
        with fs.open_input_file(at) as f:
            _LAST[path] = pickle.loads(f.read())
    return _LAST[path]


def _found(words: list[list[bytes]], paths: list[str]) -> tuple[list[list[dict]], list[list[str]]]:
    shard = Shard(words)
    for path in paths:
        shard.find(_block(path))
    return shard.spans()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> Iterator[Phrases]:
    """Items in blocks of bounded size, read one partition at a time; a table of any size passes through.

    An item that does not fit into a block goes on in the next one, which repeats what windows reach over.
    """
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col))
    for name, text in rows.toLocalIterator():
        words = common.split_words(text)
        a = 0
        while a < len(words):
            b, room = a, BLOCK_BYTES - size
            while b < len(words) and room > len(words[b]):
                room -= len(words[b]) + 1
                b += 1
            if b < len(words) and (held or b - a < width):
                if held:
                    yield Phrases.of(held, width)
                    held, size = [], 0
                    continue
                b = min(len(words), a + width)  # a block has room for one window at least
            held.append((name, words[a:b]))
            size += sum(map(len, words[a:b])) + b - a
            a = b if b == len(words) else b - width + 1
    if held:
        yield Phrases.of(held, width)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    keep_text: bool = False,
    cut: bool = False,
) -> DataFrame:
    """Every row of ``docs``, without its text unless that is kept, with ``n_words``, ``spans`` (merged runs of hit words) and ``items``.

    A phrase is ``width`` consecutive words of an item, or a shorter item whole. Null texts have no words; texts of any
    length are indexed whole, those of more than SHARD_WORDS words alone, and take about 100 bytes a word. Phrases of
    items with a null id hit as others do, but are in no list of items; items that share an id, or repeat, count once.
    Repeated rows are judged alike. An empty benchmark hits nothing, an empty table gives an empty one. Columns of
    ``docs`` named like new ones are replaced. With ``cut`` the texts come back without the words of their spans.

    The benchmark is written to the shared folder in blocks of at most BLOCK_BYTES. A task reads its documents once,
    indexes each shard once, and searches it for one block after another.
    """
    spark = docs.sparkSession
    folder = common.new_folder(spark, "benchmark")
    paths: list[str] = []
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, width)):
        out = common.SharedWriter(folder, f"block-{k:06d}")
        out.write(pickle.dumps(block))
        out.commit()
        paths.append(f"{folder}/block-{k:06d}")
    docs = docs.drop("n_words", "spans", "items")
    names = [c for c in docs.columns if keep_text or cut or c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, words in _shards(batch.column(text_col), SHARD_WORDS):
                n = len(words)
                sizes = [len(w) for w in words]
                spans, items = _found(words, paths) if paths else ([[]] * n, [[]] * n)
                del words
                columns = {c: batch.column(c).slice(first, n) for c in names}
                if cut:
                    left = [cut_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
                    columns[text_col] = pa.array(left, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*columns.values(), pa.array(sizes, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
                    [*names, "n_words", "spans", "items"],
                )
        common.release()

    return docs.mapInArrow(search, ", ".join(x for x in (schema, FOUND) if x))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with texts without the words of their spans; a line break marks each cut. Options are those of ``scan``."""
    return scan(docs, benchmark, cut=True, **options).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from what ``scan`` returns."""
    return (
        found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("spans", "items")
    )


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the words of its spans and what stands between them; a line break marks each cut."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    marks = raw.translate(common.WORD_TABLE)
    is_word = np.frombuffer(marks, np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], is_word.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : begin[a]])
        at = int(end[b - 1])
    out.append(raw[at:])
    return b"\n".join(out).decode("utf-8", "surrogatepass")
