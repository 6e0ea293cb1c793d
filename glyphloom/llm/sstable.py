"""Token ids in sorted-string-table shards.

A shard is one file: data blocks, a sparse index with one entry a block, a Bloom filter and a footer.

    block   entries [shared varint | rest varint | length varint | rest of key | value], then crc32 of them (4 bytes)
    index   for each block: first key, offset, length, entries
    bloom   bits; the k probes of a key come from one 128-bit xxh3 hash
    footer  offsets and lengths of index and bloom, entries, ids, k, bytes of an id, magic

Keys are 9 bytes: a null mark, then the signed 64-bit id with its sign bit flipped, big-endian, so byte order is id order
(null first). A key shares its prefix with the entry before it in its block; a block's first entry shares nothing, so a
reader binary-searches the index for the block and scans only that.

Shards come in the order of id and a hash of the text, so that the rows of one id, or of none, may be dealt to several; a shard that
reaches ``SHARD_BYTES`` is closed and the next begins, so neither its keys nor its index grow with the input.

Defined cases: a null or empty text is a document of only the end id; repeated ids are all kept, next to each other, by
that hash; an empty table gives no shard and no rows; other columns of the input, whatever their names, are ignored. The tokenizer's own
special tokens in a text become their ids, as the library does by itself.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.llm.shared import Tidy, fresh_path, keep, text_rows

MAGIC = b"GLSST001"
FOOTER = struct.Struct("<QQQQQQBB8s")
INDEX_ENTRY = struct.Struct("<QII")
END_ID = 2
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 128 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7


# -- tokenizing -------------------------------------------------------------------------------------------------------


def _byte_symbols() -> list[str]:
    """The printable character that byte-level BPE uses for each byte: itself if it prints, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordCachedEncoder:
    """Whole texts to ids with the ``tokenizers`` library, calling it once for each distinct piece between spaces.

    Byte-level pre-tokenization always ends a token where white space begins, so a text may be cut before each space
    and the ids put together again. Runs of three or more white-space characters, or two at the end, would be cut
    inside; such texts, and those with one of the tokenizer's added tokens, go to the library whole. ``limit`` bounds the cache's entries: beyond it the cache starts anew.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        import re

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.limit, self.words, self.heads = limit, {}, {}
        self.model = self.tokenizer.model
        self.symbols = {b: s for b, s in enumerate(_byte_symbols())}
        self.run = re.compile(r"\s\s(?:\s|\Z)")

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: str) -> bytes:
        """A pre-token of letters only goes straight to the library's BPE model."""
        return self._pack([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.symbols))])

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            got = self._letters(" " + word)
        elif word and word[-1] in ".," and word[:-1].isalpha():
            got = (self.words.get(word[:-1]) or self._letters(" " + word[:-1])) + self._head(word[-1])
        else:
            got = self._whole(" " + word)
        self.words[word] = got
        return got

    def _head(self, word: str) -> bytes:
        if (got := self.heads.get(word)) is None:
            if len(self.heads) >= self.limit:
                self.heads.clear()
            got = self.heads[word] = self._whole(word) if word else b""
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian ids, two bytes each if the vocabulary allows, else four."""
        if self.run.search(text) or any(t in text for t in self.added):
            return self._whole(text)
        if len(self.words) > self.limit:
            self.words.clear()
        parts, words = text.split(" "), self.words
        out = [self._head(parts[0])]
        try:
            out += [words[p] for p in parts[1:]]
        except KeyError:
            out = [out[0], *(words[p] if p in words else self._word(p) for p in parts[1:])]
        return b"".join(out)


_encoders: dict[str, WordCachedEncoder] = {}


def encoder(path: str) -> WordCachedEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordCachedEncoder(path)
        keep("tokens", _encoders.clear)
    return _encoders[path]


# -- the file format ----------------------------------------------------------------------------------------------------


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int, k: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, (h >> 64) | 1
    return [(a + i * b) % bits for i in range(k)]


class ShardWriter:
    """Entries must come in key order; ``close`` returns the entries and ids written."""

    def __init__(self, sink, id_bytes: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.id_bytes, self.block_bytes = sink, id_bytes, block_bytes
        self.block, self.entries, self.first, self.last = bytearray(), 0, b"", b""
        self.index, self.keys, self.at, self.ids = [], [], 0, 0
        self.size = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        if self.entries:
            shared = len(os.path.commonprefix((self.last, key)))
        else:
            shared, self.first = 0, key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.size += len(value)
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(value) // self.id_bytes
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.sink.write(data)
            self.index.append((self.first, self.at, len(data), self.entries))
            self.at += len(data)
            self.block, self.entries, self.last = bytearray(), 0, b""

    def close(self) -> tuple[int, int]:
        self._flush()
        index = b"".join(_varint(len(k)) + k + INDEX_ENTRY.pack(o, n, e) for k, o, n, e in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for p in _probes(key, bits, BLOOM_PROBES):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_data = struct.pack("<Q", bits) + bloom.tobytes()
        self.sink.write(index + bloom_data)
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom_data), len(self.keys), self.ids, BLOOM_PROBES, self.id_bytes, MAGIC))
        return len(self.keys), self.ids


class ShardReader:
    """Random access by key, or all entries in order. ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - FOOTER.size)
        i_at, i_len, b_at, b_len, self.entries, self.ids, self.k, self.id_bytes, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(i_at)
        data, at, self.first, self.blocks = source.read(i_len), 0, [], []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.first.append(data[at : at + n])
            self.blocks.append(INDEX_ENTRY.unpack_from(data, at + n))
            at += n + INDEX_ENTRY.size
        source.seek(b_at)
        raw = source.read(b_len)
        self.bits, self.bloom = struct.unpack_from("<Q", raw)[0], raw[8:]

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits, self.k))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        offset, length, entries = self.blocks[i]
        self.source.seek(offset)
        data = self.source.read(length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        at, key = 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key, by binary search over the sparse index."""
        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.blocks) and self.first[i] <= key:
            out += [np.frombuffer(v, f"<u{self.id_bytes}").astype(np.uint32) for k, v in self.block(i) if k == key]
            i += 1
        return out

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)


# -- distributed writing and reading --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _WriteShards:
    folder: str
    tokenizer: str
    end_id: int
    block_bytes: int
    shard_bytes: int

    def __call__(self, batches):
        """One shard a partition, or more of bounded size. Each attempt has files of its own, and only the manifest's files count."""
        coder, writer, sink, made, task = encoder(self.tokenizer), None, None, 0, TaskContext.get()
        end = np.asarray([self.end_id], coder.kind).tobytes()
        fs, base = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        begun = {}

        def done():
            entries, ids = writer.close()
            sink.close()
            return pa.RecordBatch.from_pylist([begun | {"entries": entries, "ids": ids}], SHARD_SCHEMA)

        for batch in batches:
            for doc_id, text, print_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if writer is None:
                    begun = {"shard": f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{made:05d}.sst", "first_id": doc_id, "first_print": print_}
                    sink = fs.open_output_stream(f"{base}/{begun['shard']}")
                    writer, made = ShardWriter(sink, int(coder.kind[-1]), self.block_bytes), made + 1
                writer.add(key_of(doc_id), coder.encode(text.as_py()) + end)
                if writer.size >= self.shard_bytes:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()


SHARD_SCHEMA = pa.schema([("shard", pa.string()), ("first_id", pa.int64()), ("first_print", pa.int64()), ("entries", pa.int64()), ("ids", pa.int64())])
ROW_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


@dataclass(frozen=True)
class _ReadShards:
    folder: str

    def __call__(self, batches):
        fs, base = pafs.FileSystem.from_uri(self.folder)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fs.open_input_file(f"{base}/{shard}") as f:
                    reader = ShardReader(f)
                    for key, value in reader:
                        ids = np.frombuffer(value, f"<u{reader.id_bytes}").astype("<u4")
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=ROW_SCHEMA)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards under ``folder`` in ascending doc_id; return the manifest, itself a table there.

    The manifest has shard, first_id, first_print (the hash of its first text), entries, ids and start, the ids before it.
    """
    spark = docs.sparkSession
    order = [F.asc_nulls_first("doc_id"), F.asc("print")]
    rows = text_rows(docs).withColumn("print", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    columns = "shard string, first_id long, first_print long, entries long, ids long"
    rows.mapInArrow(Tidy(_WriteShards(folder, tokenizer, end_id, block_bytes, shard_bytes), "tokens"), columns).write.parquet(f"{folder}/manifest")
    before = Window.orderBy(F.asc_nulls_first("first_id"), "first_print", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(columns).parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every entry, from the files. Each shard is read by a task of its own where possible."""
    shards = manifest.select("shard", "start")
    return shards.repartition(max(1, spark.sparkContext.defaultParallelism * 4)).mapInArrow(_ReadShards(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the shards and return what their files hold."""
    folder = folder or fresh_path(docs.sparkSession, "token-shards")
    return read_shards(docs.sparkSession, write_shards(docs, tokenizer, folder), folder)
