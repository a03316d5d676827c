"""Token-id files: one wavelet matrix per shard of documents.

Documents are range-partitioned and sorted by id; each task encodes its documents as they come and writes them as one file,
or as several where they are more than a file should hold, so that files follow each other in the order of ids. A wavelet matrix keeps one bit of all ids in each plane;
each plane sorts the ids stably by that bit for the next. With the number of ones before each block of 512 bits it
supports access to any token, the count of a token up to a place (rank) and the place of its n-th use (select) on
the planes themselves. Planes, counts and the document table are compressed apart, so a reader opens what it needs.

File: magic, then little-endian 64-bit numbers: tokens, documents, planes, and for each section its compressed and
plain size; then the sections: document ids, their null marks, document lengths, zeros of each plane, then bits and
block counts of each plane.

Defined cases: a null text counts as empty (one end id); an empty table makes no files and no rows; null ids come
first; rows of one id go by their text's checksum, repeated rows are written each; other columns are ignored, whatever
their names. A special token's string inside a text becomes that token's id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.bpe import binary_column
from tidelog.llm.common import materialise, shared_dir, text_chunks
from tidelog.llm.spans import IdCache, mark_cuts, words_of

MAGIC = b"TDWM0001"
BLOCK = 512
#: Ids that the cache of a worker holds, about.
CACHE_IDS = 6_000_000
#: Units that the library encodes in one call.
CALL_UNITS = 1000
#: Text bytes of a task's documents, about, and of a file, at most (but for a single longer document).
SHARD_BYTES, FILE_BYTES = 8 << 20, 16 << 20
#: Partitions whose tokens are summed up together before the running sums.
BLOCK_PARTS = 1000
FILES = "part int, seq int, file string, n_docs long, n_tokens long"
#: Rows of shard offsets that may be broadcast; more are joined by a shuffle.
BROADCAST_SHARDS = 100_000


class WordEncoder:
    """The tokenizers library behind a bounded cache of white-space separated units.

    The vocabulary drops white space, and nothing joins across it or from a letter to a mark, so a unit has the same ids
    anywhere. New units are
    encoded by the library, many in one call with a special token between them; those that hold one go alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = max(special.items(), key=lambda x: x[1])
        self.special = [t.encode() for t in special]
        self.units = IdCache(CACHE_IDS)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        together = [k for k, u in enumerate(units) if not (b"<" in u and any(s in u for s in self.special))]
        lengths, flat = np.zeros(len(units), np.int64), [np.empty(0, np.int32)]
        for at in range(0, len(together), CALL_UNITS):
            some = together[at : at + CALL_UNITS]
            ids = self._whole([self.mark.join(units[k].decode() for k in some)])[0]
            marks = np.flatnonzero(ids == self.mark_id)
            lengths[some] = np.diff(np.r_[-1, marks, len(ids)]) - 1
            flat.append(np.delete(ids, marks))
        ids = np.concatenate(flat)
        if rest := sorted({*range(len(units))} - {*together}):
            alone = dict(zip(rest, self._whole([units[k].decode() for k in rest]), strict=True))
            at = np.cumsum(lengths)
            ids = np.insert(ids, np.repeat(at[rest], [len(v) for v in alone.values()]), np.concatenate([*alone.values()]))
            lengths[rest] = [len(v) for v in alone.values()]
        return ids, lengths

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (in UTF-8), and the number of ids of each."""
        joined = b" ".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        begins, stops = np.zeros((2, len(raw) + 1), bool)
        for marked, places in zip((begins, stops), words_of(raw), strict=True):
            marked[places] = marked[mark_cuts(raw)] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        ids, lengths = self.units.gather(self.units.places(raw, starts, ends, lambda a, b: self._fresh(joined, a, b)))
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        return ids, np.diff(np.r_[0, np.cumsum(lengths)][np.searchsorted(starts, np.r_[0, text_ends])])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)


def write_wavelet(ids: np.ndarray, lengths: np.ndarray, names: list[int | None]) -> bytes:
    """A shard's file: all ids of its documents one after another, the number of ids of each and the document ids."""
    planes = max(1, int(ids.max(initial=0)).bit_length())
    row = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, bits = [], []
    for b in range(planes - 1, -1, -1):
        ones = (row & row.dtype.type(1 << b)) != 0
        packed = np.packbits(ones, bitorder="little")
        packed = np.r_[packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)]
        counts = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        at = np.flatnonzero(ones)
        zeros.append(z := len(row) - len(at))
        bits += [packed.tobytes(), (np.cumsum(counts) - counts).astype("<i8").tobytes()]
        sorted_row = np.empty_like(row)
        sorted_row[:z], sorted_row[z:] = row[~ones], row[at]
        row = sorted_row
    null = np.array([n is None for n in names])
    sections = [np.array([n or 0 for n in names], "<i8").tobytes(), null.tobytes(), lengths.astype("<i8").tobytes(), np.array(zeros, "<i8").tobytes(), *bits]
    codec = pa.Codec("zstd", 1)
    packed = [codec.compress(s, asbytes=True) for s in sections]
    head = np.array([len(ids), len(names), planes, *(x for p, s in zip(packed, sections, strict=True) for x in (len(p), len(s)))], "<u8")
    return MAGIC + head.tobytes() + b"".join(packed)


class WaveletFile:
    """Reads a shard's file: tokens, counts and occurrences from its planes."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n, self.n_docs, self.planes = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
        sizes = np.frombuffer(raw, "<u8", 2 * (4 + 2 * self.planes), 32).reshape(-1, 2).astype(np.int64)
        starts = 32 + sizes.size * 8 + np.cumsum(sizes[:, 0]) - sizes[:, 0]
        self._raw, self._at, self._codec = raw, [(int(a), int(p), int(s)) for a, (p, s) in zip(starts, sizes, strict=True)], pa.Codec("zstd")
        null = np.frombuffer(self._section(1), bool)
        self.doc_ids = [None if m else d for d, m in zip(np.frombuffer(self._section(0), "<i8").tolist(), null.tolist(), strict=True)]
        self.lengths = np.frombuffer(self._section(2), "<i8")
        self.zeros = np.frombuffer(self._section(3), "<i8")
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _section(self, k: int) -> bytes:
        at, packed, plain = self._at[k]
        return self._codec.decompress(self._raw[at : at + packed], plain, asbytes=True) if plain else b""

    def plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of plane k, and the ones before each of its blocks."""
        if k not in self._open:
            self._open[k] = np.frombuffer(self._section(4 + 2 * k), "<u8"), np.frombuffer(self._section(5 + 2 * k), "<i8")
        return self._open[k]

    def _ones(self, k: int, at: int) -> int:
        """Ones of plane k before a place."""
        words, blocks = self.plane(k)
        if at <= 0 or not len(words):
            return 0
        block = min(at // BLOCK, len(blocks) - 1)
        first, last = block * BLOCK // 64, at // 64
        total = int(blocks[block]) + int(np.bitwise_count(words[first:last]).sum())
        return total + (int(words[last]) & ((1 << at % 64) - 1)).bit_count() if at % 64 else total

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for k in range(self.planes):
            words, _ = self.plane(k)
            ones = self._ones(k, at)
            if bit := int(words[at // 64]) >> (at % 64) & 1:
                at = int(self.zeros[k]) + ones
            else:
                at -= ones
            token = token << 1 | bit
        return token

    def _span(self, token: int, end: int) -> tuple[int, int]:
        """After the last plane, where the uses of a token before `end` lie."""
        a, b = 0, min(max(end, 0), self.n)
        if token >> self.planes:
            return 0, 0
        for k in range(self.planes):
            x, y = self._ones(k, a), self._ones(k, b)
            a, b = (int(self.zeros[k]) + x, int(self.zeros[k]) + y) if token >> (self.planes - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, end: int | None = None) -> int:
        """How often a token stands before `end`."""
        a, b = self._span(token, self.n if end is None else end)
        return b - a

    def _find(self, k: int, bit: int, nth: int) -> int:
        """The place of the nth (from 0) such bit of plane k: a search over the block counts, then inside the block."""
        words, blocks = self.plane(k)
        before = blocks if bit else np.arange(len(blocks)) * BLOCK - blocks
        block = int(np.searchsorted(before, nth, "right")) - 1
        inside = np.unpackbits(words[block * BLOCK // 64 : (block + 1) * BLOCK // 64].view(np.uint8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(inside == bit)[nth - int(before[block])])

    def select(self, token: int, nth: int) -> int:
        """The place of the nth (from 0) use of a token."""
        a, b = self._span(token, self.n)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        at = a + nth
        for k in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - k) & 1
            at = self._find(k, bit, at - int(self.zeros[k]) if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids: the planes' sorts undone from the last to the first."""
        row = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for k in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self.plane(k)[0].view(np.uint8), count=self.n, bitorder="little").view(bool)
            z, up = int(self.zeros[k]), np.empty_like(row)
            row[z:] |= row.dtype.type(1 << (self.planes - 1 - k))
            up[~ones] = row[:z]
            up[np.flatnonzero(ones)] = row[z:]
            row = up
            self._open.pop(k)
        return row


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder. hdfs and viewfs need libhdfs beside every worker."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def put_file(uri: str, raw: bytes) -> None:
    """Writes a whole file or none: under another name first, so a task that is run twice does no harm."""
    store, path = opened(uri)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
        out.write(raw)
    store.move(part, path)


def write_token_files(docs: DataFrame, vocab_path: str, end_id: int = 2, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Writes the files and returns (part, seq, file, n_docs, n_tokens) of each, which go in order of part and seq, and their folder."""
    spark = docs.sparkSession
    if uri is None:
        base = shared_dir(spark)
        uri = f"{base if ':' in base.split('/')[0] else 'file://' + base}/tokens-{uuid.uuid4().hex}"
    store, path = opened(uri)
    store.create_dir(path, recursive=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    # the last key deals out repeated rows of one id
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("row"))
    keys = ["id", "crc", "row"]
    placed = keyed.repartitionByRange(max(1, -(-total // shard_bytes)), *keys).sortWithinPartitions(*keys).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = word_encoder(vocab_path), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, list[int | None]]] = []
        size = 0

        def written() -> pa.RecordBatch:
            ids, lengths = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            name = f"shard-{part:08d}-{seq:04d}.wm"
            put_file(f"{uri}/{name}", write_wavelet(ids, lengths, [n for h in held for n in h[2]]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]), pa.array([len(lengths)], pa.int64()), pa.array([len(ids)], pa.int64())], ["part", "seq", "file", "n_docs", "n_tokens"])

        for batch in text_chunks(batches, "text"):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            more = sum(map(len, texts))
            if held and size + more > file_bytes:
                yield written()
                seq, size = seq + 1, 0
            ids, lengths = encoder.encode_batch(texts)
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            held.append((ids.astype(np.uint16 if ids.max() < 1 << 16 else np.uint32), lengths + 1, batch.column("id").to_pylist()))
            size += more
        if held:
            yield written()

    return materialise(placed.mapInArrow(write, FILES)), uri


def file_offsets(shards: DataFrame) -> DataFrame:
    """Per file: the tokens of all files before it, as sums of blocks of partitions and running sums inside them."""
    blocked = shards.withColumn("block", F.floor(F.col("part") / BLOCK_PARTS))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    before = Window.partitionBy("block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocked.select("block", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("inside"))
    return inside.join(blocks, "block").select("file", (F.col("start") + F.col("inside")).alias("_base"))


def read_token_files(shards: DataFrame, uri: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: the id, start (ids of all documents before it) and ids (as little-endian unsigned 32-bit integers)."""
    offsets = file_offsets(shards)
    spark = shards.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(uri) if shards.take(1) else spark.createDataFrame([], "path string, content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = WaveletFile(batch.column("content")[i].as_py())
                ids = file.tokens().astype("<u4")
                starts = np.cumsum(file.lengths) - file.lengths
                step = np.cumsum(file.lengths) // (1 << 20)
                cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), file.n_docs]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    lengths = file.lengths[a:b]
                    flat = ids[int(starts[a]) : int(starts[a] + lengths.sum())] if len(lengths) else ids[:0]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("file")[i].as_py()] * (b - a)), pa.array(file.doc_ids[a:b], pa.int64()), pa.array(starts[a:b]), binary_column(flat, lengths)], ["file", id_col, "_in_file", "ids"])

    read = files.select(F.substring_index("path", "/", -1).alias("file"), "content").mapInArrow(run, f"file string, `{id_col}` long, _in_file long, ids binary")
    if shards.count() <= BROADCAST_SHARDS:
        offsets = F.broadcast(offsets)
    return read.join(offsets, "file").select(id_col, (F.col("_in_file") + F.col("_base")).alias("start"), "ids")
