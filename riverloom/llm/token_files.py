"""Token ids in a seekable binary file: independent zstandard frames, a trailing seek table, a checksum per frame.

File layout (the public seekable zstandard format)::

    frame 0 | frame 1 | ... | skippable frame: entries, footer

Each document is one frame holding its ids as little-endian unsigned integers (2 bytes where the vocabulary has at
most 65,536 ids, else 4). A seek-table entry is (compressed size, decompressed size, low 32 bits of XXH64 of the
decompressed bytes), each an unsigned 32-bit integer; the footer is the number of frames, a descriptor byte with the
checksum flag, and a magic number. Any zstandard decoder reads the file as a whole; a reader that wants one document
reads the table at the end, seeks, and inflates that frame alone. A second, skippable frame before the seek table
holds the frames' document ids and the id width, so a file needs no catalogue.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverloom.llm import common

SKIPPABLE = 0x184D2A5E
DIRECTORY = 0x184D2A5D
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
NO_ID = -(2**63)
#: Pieces that a worker keeps encoded; beyond it the half that was met first stays, which holds the frequent ones.
CACHE_PIECES = 800_000
#: Bytes of text of a file, by the plan's estimate.
SHARD_BYTES = 256_000_000
#: Bytes of text that a worker encodes at once.
BATCH_CHARS = 2_000_000


class Encoder:
    """Encodes whole texts as the ``tokenizers`` library does, each distinct piece of a text once.

    A byte-level BPE cuts a text into pieces by a fixed pattern and merges within each piece alone, so the ids of a
    text are the ids of its pieces one after another. Where the tokenizer's file says that it is one, plain texts, in
    which this module's pattern is known to cut as the library does, are cut here and only pieces not met before go to
    the library. Texts with other characters or with strings of added tokens, and all texts of any other tokenizer, go
    to the library whole. ``special_as_text`` is the library's switch ``encode_special_tokens``, off as it is there:
    strings of special tokens in a text become these tokens, unless it is set.
    """

    PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ]*")
    PIECES = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+"
        r"| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ſ]+|\s+(?!\S)|\s+"
    )

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = special_as_text
        self.lib.no_truncation()
        self.lib.no_padding()
        self.vocab = self.lib.get_vocab_size(with_added_tokens=True)
        self.cuts = cuts_as_known(json.loads(self.lib.to_str()))
        added = [t for t in self.lib.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)")
        self.known = _Numbers()
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def forget(self) -> None:
        kept = CACHE_PIECES // 2
        self.known = _Numbers(islice(self.known.items(), kept))
        self.start = self.start[: len(self.known) + 1].copy()
        self.ids = self.ids[: self.start[-1]].copy()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, many in one text: a line break between two pieces is a piece of its own."""
        inline = [k for k, p in enumerate(pieces) if not p.isspace()]
        sizes = np.zeros(len(pieces), np.int64)
        got: list[tuple[np.ndarray, np.ndarray]] = []  # (piece, id) of every id
        for a in range(0, len(inline), 512):
            some = inline[a : a + 512]
            e = self.lib.encode("\n".join(pieces[k] for k in some), add_special_tokens=False)
            word = np.asarray(e.word_ids, np.int64)
            if len(word) == 0 or word[-1] != 2 * len(some) - 2:
                raise ValueError("pieces are not cut as the library cuts")
            own = word % 2 == 0
            got.append((np.asarray(some)[word[own] // 2], np.asarray(e.ids, np.int32)[own]))
        blank = [k for k, p in enumerate(pieces) if p.isspace()]
        for k, e in zip(blank, self.lib.encode_batch_fast([pieces[k] for k in blank], add_special_tokens=False), strict=True):
            got.append((np.full(len(e.ids), k), np.asarray(e.ids, np.int32)))
        piece = np.concatenate([x for x, _ in got])
        ids = np.concatenate([x for _, x in got])[np.argsort(piece, kind="stable")]
        sizes = np.bincount(piece, minlength=len(pieces))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them with add_special_tokens=False."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.PLAIN.fullmatch(t) and not self.added.search(t)] if self.cuts else []
        plain_set = set(plain)
        if rest := [k for k in range(len(texts)) if k not in plain_set]:
            for k, e in zip(rest, self.lib.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = np.asarray(e.ids, np.int32)
        if len(self.known) > CACHE_PIECES:
            self.forget()
        number = self.known.__getitem__
        at = [np.fromiter(map(number, self.PIECES.findall(texts[k])), np.int64) for k in plain]
        if self.known.fresh:
            self._learn(self.known.fresh)
            self.known.fresh = []
        for k, x in zip(plain, at, strict=True):
            first, size = self.start[x], self.start[x + 1] - self.start[x]
            total = int(size.sum())
            step = np.repeat(first - np.cumsum(size) + size, size) + np.arange(total)
            out[k] = self.ids[step]
        return out  # type: ignore[return-value]


def cuts_as_known(spec: dict) -> bool:
    """Whether a tokenizer's description is that of a byte-level BPE that cuts by the pattern of ``Encoder``."""
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix")
    return bool(level and spec.get("normalizer") is None and model.get("type") == "BPE" and not any(model.get(k) for k in odd))


class _Numbers(dict):
    """Numbers pieces in the order in which they are first met; ``fresh`` gathers the new ones."""

    def __init__(self, known=()):
        super().__init__(known)
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class FrameWriter:
    """Writes one seekable file, a frame per document."""

    def __init__(self, out, width: int, level: int = 3):
        import zstandard

        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False)
        self.sizes: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        raw = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.sizes.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)

    def finish(self) -> None:
        n = len(self.sizes)
        self.out.write(_skippable(DIRECTORY, struct.pack("<II", self.width, n) + np.asarray(self.doc_ids, "<i8").tobytes()))
        table = np.asarray(self.sizes, "<u4").reshape(n, 3)
        self.out.write(_skippable(SKIPPABLE, table.tobytes() + struct.pack("<IBI", n, CHECKSUMS, SEEKABLE)))


class FrameReader:
    """Reads single documents of a seekable file; only their bytes and the tables at its end are read."""

    def __init__(self, fs, path: str):
        import zstandard

        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        begin = end - 9 - 12 * n - 8
        self.table = np.frombuffer(self._at(begin + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        directory = self._at(int(self.offset[-1]), begin - int(self.offset[-1]))
        kind, _, self.width, m = struct.unpack("<IIII", directory[:16])
        if kind != DIRECTORY or m != n:
            raise ValueError(f"{path}: no directory of documents")
        self.doc_ids = np.frombuffer(directory[16:], "<i8")
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def __len__(self) -> int:
        return len(self.table)

    def ids(self, k: int) -> np.ndarray:
        """The ids of frame ``k`` as unsigned 32-bit integers, after its checksum held."""
        import xxhash

        size, full, check = (int(x) for x in self.table[k])
        raw = self.unpack.decompress(self._at(int(self.offset[k]), size), max_output_size=max(full, 1))
        if len(raw) != full or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum does not hold")
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")


MANIFEST = "shard int, path string, n_docs long, n_ids long"


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    shards: int | None = None,
    special_as_text: bool = False,
) -> DataFrame:
    """Encode every whole text and write one file per shard under ``folder``; returns the manifest, one row a file.

    Documents are dealt to shards by ranges of ``id_col`` (nulls first) and written in ascending order, so the files in
    order of their names hold all documents in order. Repeated ids are neighbours, ordered by a hash of the text, then
    by the text; as the ranges reach into the hash, rows without ids or with one id are spread over shards, too. A null
    text is an empty one and has the end id alone; a text of any length is one frame. An empty table gives an empty
    manifest. Other columns are not read, whatever their names. The tokenizer's file must be readable under
    ``tokenizer_path`` on every executor, as installed packages are; see ``Encoder`` for ``special_as_text``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = shards or common.parts_for(rows, SHARD_BYTES)
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    rows = rows.drop("h").withColumn("shard", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = out = frames = None
        shard, total = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if enc is None:
                enc = _encoder(tokenizer_path, special_as_text)
                shard = batch.column("shard")[0].as_py()
                out = common.SharedWriter(folder, f"part-{shard:08d}.zst")
                frames = FrameWriter(out, 2 if enc.vocab <= 65536 else 4)
            ids = batch.column("doc_id").to_pylist()
            for a, texts in common.text_slices(batch.column("text"), BATCH_CHARS):
                for doc_id, x in zip(ids[a : a + len(texts)], enc.encode(texts), strict=True):
                    frames.add(doc_id, np.append(x, end_id))
                    total += len(x) + 1
        if out is not None:
            frames.finish()
            path = out.commit()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(frames.sizes)], "n_ids": [total]}
            )
        common.release()

    return common.written(rows.mapInArrow(encode, MANIFEST), "token-manifest")


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, special_as_text: bool) -> Encoder:
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: one row per document with its first position, length and crc32 of its ids.

    ``start`` counts the ids of all documents before it, over all files. The number of files is the number of shards,
    so the running total over them is a window over that many rows.
    """
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = files.repartitionByRange(max(1, manifest.count()), "shard").select("shard", "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = FrameReader(fs, path)
                n = file.table[:, 1] // file.width
                first = start + np.cumsum(n) - n
                for a in range(0, len(file), 4096):
                    b = min(a + 4096, len(file))
                    doc = pa.array(file.doc_ids[a:b], mask=file.doc_ids[a:b] == NO_ID)
                    crc = pa.array([zlib.crc32(file.ids(k).tobytes()) for k in range(a, b)], pa.int64())
                    yield pa.RecordBatch.from_pydict({"doc_id": doc, "start": first[a:b], "n_tokens": n[a:b], "ids_crc32": crc})

    return files.mapInArrow(read, DIGEST)
