"""Secret scans: a keyword prefilter, expressions anchored at its hits, and checksum validation.

An Aho-Corasick automaton finds all keywords of a text in one pass; each kind's expression is then matched at its own
hits only, left to right, skipping hits inside an earlier match. Long hexadecimal runs have no keyword: a run of 32 or
more covers four neighbouring places among every eighth byte, so only those bytes are looked up, and runs are read out
where four in a row fit. Tokens that carry a checksum of themselves are kept only if it agrees.

Kinds: assign, access and hex (see BASE), then github and npm (with checksum). Spans are in code points, end exclusive.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned each; spans of different kinds
may overlap; an empty table gives no rows; columns other than the id and the text are ignored by scan_secrets and kept
as they are by redact_secrets; no text is too long.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import text_chunks

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = {"github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Keywords in lower case, and the kind each stands for.
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
IS_HEX = np.zeros(256, bool)
IS_HEX[list(b"0123456789abcdef")] = True
HEX_STEP = 8


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum_holds(body: bytes, check: bytes) -> bool:
    """The last six characters are the CRC-32 of the others, in base 62."""
    value, out = zlib.crc32(body), bytearray()
    while value:
        value, digit = divmod(value, 62)
        out.append(DIGITS[digit])
    return bytes(reversed(out)).rjust(6, b"0") == check


def keyword_spans(raw: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, of the kinds that keywords announce."""
    spans, ends = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton().iter(raw.lower().decode("latin-1")):
        start = last - size + 1
        if start < ends[kind]:
            continue
        expression = ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED[kind]
        if m := expression.match(raw, start):
            ends[kind] = m.end()
            good = len(m[1]) >= LEAST_ASSIGN if kind == "assign" else len(m[0]) >= LEAST_ACCESS if kind == "access" else checksum_holds(m[1], m[2])
            if good:
                spans.append((start, kind, m.end()))
    return spans


def hex_spans(texts: list[bytes]) -> dict[int, list[tuple[int, str, int]]]:
    """By text: its long hexadecimal runs."""
    joined = b"\n".join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)]).tolist()
    hit = IS_HEX[np.frombuffer(joined, np.uint8)[::HEX_STEP]]
    n = LEAST_HEX // HEX_STEP
    four = hit[: max(0, len(hit) - n + 1)].copy()
    for k in range(1, n):
        four &= hit[k : len(hit) - n + 1 + k]
    found: dict[int, list[tuple[int, str, int]]] = {}
    end = 0
    for at in (np.flatnonzero(four) * HEX_STEP).tolist():
        if at < end:
            continue
        start = at
        while start and IS_HEX[joined[start - 1]]:
            start -= 1
        end = HEX.match(joined, start).end()
        if end - start >= LEAST_HEX:
            k = bisect_right(starts, start) - 1
            found.setdefault(k, []).append((start - starts[k], "hex", end - starts[k]))
    return found


def spans_of(texts: list[bytes]) -> list[list[tuple[int, str, int]]]:
    """Per text: (start, kind, end) in code points, by start and kind."""
    runs = hex_spans(texts)
    out = []
    for k, raw in enumerate(texts):
        spans = sorted(keyword_spans(raw) + runs.get(k, []), key=lambda s: (s[0], KINDS.index(s[1])))
        if spans and not raw.isascii():
            places = sorted({p for a, _, b in spans for p in (a, b)})
            points, seen, before = {}, 0, 0
            for p in places:
                seen, before = seen + len(raw[before:p].decode()), p
                points[p] = seen
            spans = [(points[a], kind, points[b]) for a, kind, b in spans]
        out.append(spans)
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and `spans`, by start and kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_col):
            found = spans_of([t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in spans] for spans in found], kind)], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}")


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the name of its first kind."""
    out, done, at = [], 0, 0
    while at < len(spans):
        start, kind, end = spans[at]
        at += 1
        while at < len(spans) and spans[at][0] < end:
            end = max(end, spans[at][2])
            at += 1
        out += [text[done:start], f"[{kind}]"]
        done = end
    return "".join([*out, text[done:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns; texts with spans have them replaced, and their length column follows."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_col):
            raw = batch.column(text_col).cast(pa.binary()).to_pylist()
            found = spans_of([t or b"" for t in raw])
            columns = {n: batch.column(n) for n in names}
            if any(found):
                texts = [None if t is None else redacted(t.decode(), s) if s else t.decode() for t, s in zip(raw, found, strict=True)]
                columns[text_col] = pa.array(texts, pa.string())
                if length_col in columns:
                    lengths = columns[length_col].to_pylist()
                    columns[length_col] = pa.array([len(t) if s else n for t, s, n in zip(texts, found, lengths, strict=True)], columns[length_col].type)
            yield pa.RecordBatch.from_arrays([*columns.values()], names)

    return docs.mapInArrow(run, docs.schema)
