"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round finds, for every word, its pair of lowest rank and merges
all places of that pair; ranks come from a binary search over the sorted keys of all merge pairs, and only pairs beside
a merge are looked up again. Words that have no mergeable pair leave the array. Texts are cut at spaces into units;
a bounded cache per worker keeps the ids of units seen before, by 64-bit hashes, so a round only sees new ones.

Defined cases: a null text encodes as an empty one; empty texts have no ids; a special token's string inside a text
becomes that token's id; ids that aren't valid UTF-8 together decode with replacement characters; repeated rows are
repeated in the result; columns other than the id and the text are ignored, whatever their names; a null id stays null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidelog.llm.common import text_chunks
from tidelog.llm.spans import IdCache, mark_cuts, ranges

#: The pre-tokenizer pattern of the byte-level vocabulary files.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids that each cache of a worker holds, about.
CACHE_IDS = 2_500_000
#: White space that units seldom hold; it parts units that go through the pattern together.
BREAK = 0x0B
#: Bytes that begin white space, or may.
MAY_BE_SPACE = np.zeros(256, bool)
MAY_BE_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True
NO_RANK = np.iinfo(np.int32).max
SHIFT = 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class MergeTable:
    """Merge pairs as sorted keys, with the rank and the merged id of each."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right, new = (np.array([vocab[s] for s in x], np.int64) for x in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        keys = (left << SHIFT) | right
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.rank, self.new = keys, first.astype(np.int32), new[first].astype(np.int32)
        self.new_by_rank = new.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left.astype(np.int64) << SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], NO_RANK)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words given as one flat array of first symbols and their lengths (each 1 at least); the same of the results."""
        words = np.arange(len(lengths))
        symbols, lengths = symbols.astype(np.int32), lengths.astype(np.int64)
        out_words: list[np.ndarray] = []
        out_lengths: list[np.ndarray] = []
        out_symbols: list[np.ndarray] = []
        rank = np.full(len(symbols), NO_RANK, np.int32)  # of the pair that begins at each symbol
        if len(symbols) > 1:
            inner = np.ones(len(symbols), bool)
            inner[np.cumsum(lengths) - 1] = False
            at = np.flatnonzero(inner)
            rank[at] = self.ranks(symbols[at], symbols[at + 1])
        while len(words):
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, starts)
            done = least == NO_RANK
            if done.any():
                gone = np.repeat(done, lengths)
                out_words.append(words[done])
                out_lengths.append(lengths[done])
                out_symbols.append(symbols[gone])
                keep = ~gone
                symbols, rank, words, lengths, least = symbols[keep], rank[keep], words[~done], lengths[~done], least[~done]
                if not len(words):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            if len(hit) > 1 and (near := np.diff(hit) == 1).any():
                # x x x with the pair (x, x): take every other place of a run, from its left
                begins = np.r_[True, ~near]
                runs = np.flatnonzero(begins)
                offset = np.arange(len(hit)) - np.repeat(runs, np.diff(np.r_[runs, len(hit)]))
                hit = hit[offset % 2 == 0]
            symbols[hit] = self.new_by_rank[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            removed = np.add.reduceat(~keep, np.cumsum(lengths) - lengths, dtype=np.int64)
            last_of_word = np.zeros(len(symbols), bool)
            last_of_word[np.cumsum(lengths) - 1] = True
            last_of_word[hit] = last_of_word[hit + 1]
            moved = np.cumsum(keep) - 1
            first_of_word = np.zeros(len(symbols), bool)
            first_of_word[np.cumsum(lengths) - lengths] = True
            fresh = moved[hit]
            symbols, rank, ends, heads, lengths = symbols[keep], rank[keep], last_of_word[keep], first_of_word[keep], lengths - removed
            beside = np.zeros(len(symbols), bool)
            beside[fresh] = True
            beside[fresh[~heads[fresh]] - 1] = True
            look = np.flatnonzero(beside)
            inner = look[~ends[look]]
            rank[look] = NO_RANK
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        if not out_words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        words, lengths, flat = np.concatenate(out_words), np.concatenate(out_lengths), np.concatenate(out_symbols)
        order = np.argsort(words, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        return flat[ranges(starts, lengths[order])], lengths[order]


class ByteBPE:
    """Encodes and decodes with a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, characters = file["model"]["vocab"], byte_characters()
        self.table = MergeTable(vocab, file["model"]["merges"])
        self.byte_ids = np.array([vocab[c] for c in characters], np.int32)
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        self.special_pattern = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        value = {c: b for b, c in enumerate(characters)}
        tokens = {i: bytes(value[c] for c in s) if all(c in value for c in s) else s.encode() for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        listed = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_lengths = np.array([len(t) for t in listed], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(listed), np.uint8)
        self.pattern = regex.compile(PIECES)
        self.pieces, self.units = IdCache(CACHE_IDS), IdCache(CACHE_IDS)

    def _pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of units, by the pattern.

        Units go through the pattern together, with BREAK between them, unless white space at their ends could join it."""
        before = [raw[np.maximum(ends - k, starts)] for k in (1, 2, 3)]
        odd = ASCII_SPACE[before[0]] | (before[1] == 0xC2) | (before[2] >= 0xE1) & (before[2] <= 0xE3)
        odd |= MAY_BE_SPACE[raw[starts]] & ((raw[starts] != 32) | (ends - starts == 1) | MAY_BE_SPACE[raw[np.minimum(starts + 1, len(raw) - 1)]])
        inside = np.r_[0, np.cumsum(raw == BREAK)]
        odd |= inside[ends] > inside[starts]
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        sizes = (ends - starts)[plain]
        text = np.insert(raw[ranges(starts[plain], sizes)], np.cumsum(sizes), BREAK)
        found = self.pattern.findall(text.tobytes().decode())
        counts = np.diff(np.r_[-1, np.flatnonzero(self._is_break(text, found))]) - 1
        pieces, at_break = [text], [counts]
        for k in rest.tolist():
            unit = raw[starts[k] : ends[k]]
            own = self.pattern.findall(unit.tobytes().decode())
            found += own
            pieces.append(unit)
            at_break.append([len(own)])
        text, counts = np.concatenate(pieces), np.concatenate(at_break).astype(np.int64)
        piece_starts, piece_ends = self._piece_bounds(text, found)
        if len(plain):
            real = np.ones(len(found), bool)
            real[np.cumsum(counts[: len(plain)]) + np.arange(len(plain))] = False
            piece_starts, piece_ends = piece_starts[real], piece_ends[real]
        at = self.pieces.places(text, piece_starts, piece_ends, lambda a, b: self.table.merge(self.byte_ids[text[ranges(a, b - a)]], b - a))
        ids, lengths = self.pieces.gather(at)
        totals = np.diff(np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]])
        order = np.r_[plain, rest]
        begins, sizes = np.empty((2, len(order)), np.int64)
        begins[order], sizes[order] = np.cumsum(totals) - totals, totals
        return ids[ranges(begins, sizes)], sizes

    @staticmethod
    def _piece_bounds(text: np.ndarray, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Byte bounds of pieces that make up a text."""
        chars = np.r_[np.flatnonzero((text & 0xC0) != 0x80), len(text)]
        bounds = chars[np.cumsum(np.r_[0, np.fromiter(map(len, found), np.int64, len(found))])]
        return bounds[:-1], bounds[1:]

    def _is_break(self, text: np.ndarray, found: list[str]) -> np.ndarray:
        starts, _ = self._piece_bounds(text, found)
        return text[starts] == BREAK

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Without special tokens. The pattern always begins a piece at a space before what isn't white space, and what
        stands before it doesn't depend on what follows; so texts are cut there, and before marks after a letter, into units."""
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = b"".join(texts)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(joined, np.uint8)
        doc_starts = np.cumsum(sizes) - sizes
        cut = np.zeros(len(raw), bool)
        cut[:-1] = (raw[:-1] == 32) & ~MAY_BE_SPACE[raw[1:]]
        cut[doc_starts[1:][doc_starts[1:] > 0] - 1] = False  # what follows the last space is another text
        cut[mark_cuts(raw)] = True
        cut[doc_starts[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        at = self.units.places(raw, starts, np.r_[starts[1:], len(raw)], lambda a, b: self._pieces(raw, a, b))
        ids, lengths = self.units.gather(at)
        ends = np.cumsum(np.r_[0, lengths])
        bounds = ends[np.searchsorted(starts, np.r_[doc_starts, len(raw)])]
        return ids, np.diff(bounds)

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (in UTF-8), and the number of ids of each."""
        if not texts or not any(s in t for s in self.special for t in texts):
            return self._plain(texts)
        parts = [self.special_pattern.split(t) for t in texts]
        ids, lengths = self._plain([p if k % 2 == 0 else b"" for x in parts for k, p in enumerate(x)])
        marks = [self.special[p] if k % 2 else -1 for x in parts for k, p in enumerate(x)]
        ends = np.cumsum(lengths)
        places = np.array([k for k, m in enumerate(marks) if m >= 0], np.int64)
        ids = np.insert(ids, ends[places], [marks[k] for k in places])
        lengths[places] = 1
        return ids, np.add.reduceat(lengths, np.cumsum([0, *map(len, parts)])[:-1])

    def decode_batch(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """UTF-8 of each decoded text."""
        sizes = self.token_lengths[ids]
        raw = self.token_bytes[ranges(self.token_starts[ids], sizes)].tobytes()
        ends = np.cumsum(np.r_[0, sizes])[np.cumsum(np.r_[0, lengths])].tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return [b if valid(b) else b.decode("utf-8", "replace").encode() for b in out]


def valid(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """One codec per worker process and file."""
    return ByteBPE(path)


def bpe_encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Per row: the id, `ids` (the token ids as little-endian unsigned 32-bit integers) and, if asked for, `decoded` (their text)."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary" + ", decoded string" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(vocab_path)
        for batch in text_chunks(batches, text_col):
            ids, lengths = codec.encode_batch([t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()])
            columns = [batch.column(id_col), binary_column(ids.astype("<u4"), lengths)]
            if decode:
                columns.append(pa.array(codec.decode_batch(ids, lengths), pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "decoded"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def binary_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Each row's run of values as bytes, without copies."""
    offsets = (np.cumsum(np.r_[0, lengths]) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
