"""Token ids in files of directly addressable codes.

A segment file holds the ids of up to about SEGMENT_TOKENS tokens of whole documents in
levels of eight-bit chunks: level 0 has the low chunk of every id, the next level the next
chunk of the ids that have one, and so on. A bitmap of each level says which ids continue,
and a directory of its ones before each block of 512 gives the place in the next level, so
any token is read by one lookup per level. Segments are rows of a Parquet table:

    part, sequence, first (tokens of the part before it), n_tokens, payload

payload, little-endian: magic ``DACS``, u16 version, u16 levels, u32 documents, u64 tokens;
i64 doc_id and u8 known of each document, u64 end of each document; per level u64 items,
items bytes, ceil(items / 8) bitmap bytes, u32 ones before each block of 512 items.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import scratch_path

SEGMENT_TOKENS = 1 << 19
BLOCK = 512
CACHED_WORDS = 1 << 20
_HEAD = struct.Struct("<4sHHIQ")
_SEGMENTS = "part int, sequence int, first long, n_tokens long, payload binary"
_encoders: dict[str, Encoder] = {}


def finder(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern; in ASCII texts those of letters, numbers and white space are found by ``re``, which is faster.

    The classes are spelled out as ``regex`` has them, so the matches are the same. Patterns
    with other properties stay with ``regex``.
    """
    import regex

    wide = regex.compile(pattern).findall
    if "[" in pattern.replace(r"[^\s\p{L}\p{N}]", "") or re.search(r"\\(?![sS]|p\{[LN]\})", pattern):
        return wide
    letters, numbers, space = ("".join(f"\\x{ord(c):02x}" for c in regex.findall(name, "".join(map(chr, range(128)))))
                               for name in (r"\p{L}", r"\p{N}", r"\s"))
    for written, spelled in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"),
                             (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        pattern = pattern.replace(written, spelled)
    narrow = re.compile(pattern).findall
    return lambda t: narrow(t) if t.isascii() else wide(t)


class Encoder:
    """Encodes texts with a tokenizers file whose pre-tokenizer is the byte-level pattern.

    Merges never cross the pattern's pieces, so the ids of each distinct piece are looked
    up once by the tokenizer and kept; the store is emptied when it is full.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = finder(pattern)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(pieces) + 1)).tolist()
        raw = np.array(found.ids, np.uint32).tobytes()
        for i, piece in enumerate(pieces):
            self.known[piece] = raw[4 * cuts[i]:4 * cuts[i + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        out: list[bytes | None] = []
        later: dict[int, list[str]] = {}
        get = self.known.__getitem__
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes())
                continue
            pieces = self.find(t)
            try:
                out.append(b"".join(map(get, pieces)))
            except KeyError:  # a piece not seen yet
                out.append(None)
                later[i] = pieces
        new = {p for pieces in later.values() for p in pieces}.difference(self.known)
        if new:
            self._learn(list(new))
        for i, pieces in later.items():
            out[i] = b"".join(map(get, pieces))
        return out


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: list[int]) -> bytes:
    """Payload of a segment."""
    levels = []
    while True:
        more = ids > 0xFF
        ones = np.cumsum(np.add.reduceat(more, np.arange(0, len(ids), BLOCK)) if len(ids) else np.zeros(0, np.int64))
        before = np.concatenate([[0], ones[:-1]]) if len(ones) else ones
        levels.append(b"".join([struct.pack("<Q", len(ids)), (ids & 0xFF).astype(np.uint8).tobytes(),
                                np.packbits(more, bitorder="little").tobytes(), before.astype("<u4").tobytes()]))
        if not more.any():
            break
        ids = ids[more] >> 8
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([_HEAD.pack(b"DACS", 1, len(levels), len(doc_ids), ends[-1] if ends else 0),
                     np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(ends, "<u8").tobytes(), *levels])


class Segment:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        magic, version, levels, docs, self.n_tokens = _HEAD.unpack_from(payload)
        if magic != b"DACS" or version != 1:
            raise ValueError("not a segment of directly addressable codes")
        self._at, self._payload = _HEAD.size, payload
        ids, known = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.ends = self._take("<u8", docs).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            items = int(self._take("<u8", 1)[0])
            self.levels.append((self._take("u1", items), self._take("u1", -(-items // 8)), self._take("<u4", -(-items // BLOCK))))

    def _take(self, kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(self._payload, kind, count, self._at)
        self._at += out.nbytes
        return out

    def token(self, i: int) -> int:
        """Id of token ``i`` of the segment: one chunk and one rank per level."""
        value = 0
        for level, (chunks, bitmap, before) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            low = i // BLOCK * BLOCK
            bits = np.unpackbits(bitmap[low >> 3:(i >> 3) + 1], bitorder="little")
            i = int(before[i // BLOCK]) + int(bits[:i - low].sum())
        return value

    def tokens(self) -> np.ndarray:
        """All ids."""
        values, at = np.zeros(self.n_tokens, np.uint32), np.arange(self.n_tokens)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            values[at] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return values


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, end_id: int) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = Encoder(path, pattern)
    encoder = _encoders[path]
    end = struct.pack("<I", end_id)
    ids: list[bytes] = []
    doc_ids: list[int | None] = []
    ends: list[int] = []
    part = sequence = first = 0

    def segment() -> pa.RecordBatch:
        payload = pack(np.frombuffer(b"".join(ids), np.uint32), doc_ids, ends)
        values = (part, sequence, first, ends[-1], payload)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                          names=["part", "sequence", "first", "n_tokens", "payload"])

    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            rows = batch.slice(low, 256)
            part = rows.column("part")[0].as_py()
            texts = [t or "" for t in rows.column("text").to_pylist()]
            for doc_id, raw in zip(rows.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += [raw, end]
                doc_ids.append(doc_id)
                ends.append((ends[-1] if ends else 0) + len(raw) // 4 + 1)
                if ends[-1] >= SEGMENT_TOKENS:
                    yield segment()
                    sequence, first = sequence + 1, first + ends[-1]
                    ids, doc_ids, ends = [], [], []
    if ends:
        yield segment()


def write_codes(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 0) -> None:
    """Encode documents and write their segments to ``path`` in ascending doc_id order.

    Each document is followed by ``end_id``. Null text is empty; rows without doc_id come
    last; equal doc_ids are ordered by text. An empty table writes no segment.
    ``tokenizer`` is a file that every executor can read.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    written = rows.mapInArrow(partial(_encode, path=tokenizer, pattern=pattern, end_id=end_id), _SEGMENTS)
    written.write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, payload in zip(batch.column("before").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            segment = Segment(payload)
            raw, ends = segment.tokens().astype("<u4").tobytes(), segment.ends
            starts = np.concatenate([[0], ends[:-1]])
            sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment.doc_ids, pa.int64()), pa.array(starts + before), pa.array(ends - starts), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Segments at ``path`` with ``before``, the ids before each in the whole table.

    One row per written part is summed on the driver, as many as there were write tasks.
    """
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before, rows = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        rows.append((part, before))
        before += n
    starts = spark.createDataFrame(rows, "part int, _before long")
    return segments.join(F.broadcast(starts), "part").select("part", "sequence", (F.col("_before") + F.col("first")).alias("before"), "n_tokens", "payload")


def documents(segments: DataFrame) -> DataFrame:
    """Per document of ``read_codes``: doc_id, start, n_tokens, ids_crc32, all from the files."""
    return segments.select("before", "payload").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Write the documents' ids to a new folder and read them back, a row per document."""
    path = scratch_path(docs.sparkSession, "codes")
    write_codes(docs, path, tokenizer, pattern, end_id)
    return documents(read_codes(docs.sparkSession, path))
