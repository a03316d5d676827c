"""Quality rules: base statistics, and a linear-chain conditional random field over lines.

Each line with a word has features (binary buckets of its length, symbols, capitals, marks, short words, digits, end and
repetition). The field has two states, content and boilerplate; Viterbi decoding gives the best states of a document's
lines, and the share of its word characters on content lines decides whether it is kept. Weights are fitted on the
documents of the SAMPLE_DOCS labelled ids of smallest hash, each line labelled as its document, so the chain's weights
carry evidence from line to line. Without labels of both kinds the fixed PRIOR weights serve.

Defined cases: a null text counts as empty (no words, not kept); repeated rows are judged each; ids labelled twice
count as bad if any label says so; null labels are ignored; an empty table gives no rows; columns other than the id and
the text are ignored by judge_documents. No text is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import text_chunks
from tidelog.llm.spans import span_hashes, words_of
from tidelog.llm.words import window_hashes

#: Labelled documents that the field is fitted on, at most.
SAMPLE_DOCS = 4000
KEEP_SHARE = 0.5
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
FEATURES = ("bias", "short", "long", "few symbols", "symbols", "many symbols", "capitals", "exclaims", "lower", "short words", "long words", "digits", "sentence end", "no end", "repeated")
#: Weights for content, used where nothing is labelled.
PRIOR = np.array([0.2, -0.3, 0.3, 0, -0.2, -1.7, -1.0, -1.0, 0.6, -0.2, -0.2, 0, 0.7, -1.5, -0.4])
PRIOR_CHAIN = np.array([[2.0, -2.0], [-2.0, 1.2]])
BASE_TYPES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def lookup(values: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(values)] = 1
    return out


CLASSES = {
    "symbol": lookup(SYMBOLS),
    "space": lookup(SPACES),
    "upper": lookup(bytes(range(65, 91))),
    "lower": lookup(bytes(range(97, 123))),
    "digit": lookup(bytes(range(48, 58))),
    "exclaim": lookup(b"!"),
    "char": 1 - lookup(bytes(range(0x80, 0xC0))),
}


class Measured:
    """Base statistics of texts, and the features of their lines."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        joined = b"\n".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        lines_of = [t.split(b"\n") for t in texts]
        sizes = np.array([len(x) + 1 for ls in lines_of for x in ls], np.int64)
        line_doc = np.repeat(np.arange(n), [len(ls) for ls in lines_of])
        starts = np.cumsum(sizes) - sizes
        ends = starts + sizes - 1

        def per_line(marks: np.ndarray) -> np.ndarray:
            sums = np.r_[0, np.cumsum(marks, dtype=np.int64)]
            return sums[ends] - sums[starts]

        space = CLASSES["space"][raw]
        begins = (space == 0) & np.r_[True, space[:-1] == 1] if len(raw) else space
        chars = CLASSES["char"][raw]
        count = {k: per_line(CLASSES[k][raw]) for k in ("symbol", "upper", "lower", "digit", "exclaim")}
        words, word_chars = per_line(begins), per_line(chars & (1 - space))
        has_word = words > 0
        repeated = np.zeros(len(sizes), bool)
        at = 0
        for ls in lines_of:
            seen: set[bytes] = set()
            for k, x in enumerate(ls, at):
                repeated[k] = x in seen
                seen.add(x)
            at += len(ls)
        repeated &= has_word

        def per_doc(values: np.ndarray) -> np.ndarray:
            return np.bincount(line_doc, values, n).astype(np.int64)

        self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines = per_doc(words), per_doc(word_chars), per_doc(count["symbol"]), per_doc(repeated)
        self.n_repeat_words = repeated_words(span_hashes(raw, *words_of(raw)), self.n_words)
        self.base_failed = (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)
        keep = np.flatnonzero(has_word)
        last = raw[np.maximum(ends - 1, 0)][keep] if len(raw) else np.empty(0, np.uint8)
        w, c = words[keep], np.maximum(word_chars[keep], 1)
        letters = np.maximum(count["upper"][keep] + count["lower"][keep], 1)
        symbols, upper, exclaim, digit = (count[k][keep] / c for k in ("symbol", "upper", "exclaim", "digit"))
        upper = count["upper"][keep] / letters
        stop = np.isin(last, list(b".?!:;\"')"))
        self.features = np.stack(
            [np.ones(len(keep)), w <= 3, w > 12, (symbols > 0) & (symbols <= 0.03), (symbols > 0.03) & (symbols <= 0.1), symbols > 0.1, upper > 0.5, exclaim > 0.03, upper <= 0.2, c / w < 4, c / w > 8, digit > 0.3, stop, ~stop, repeated[keep]], axis=1
        ).astype(float)
        self.line_doc, self.line_chars = line_doc[keep], word_chars[keep]
        self.line_counts = np.bincount(self.line_doc, minlength=n)


def repeated_words(words: np.ndarray, counts: np.ndarray, width: int = 5) -> np.ndarray:
    """Per text: words in windows of `width` words that its text has twice or more; words: hashes of all texts' words."""
    doc = np.repeat(np.arange(len(counts)), counts)
    windows, whole = window_hashes(words, counts, width)
    at = np.flatnonzero(whole)
    key = windows[at] ^ (doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    twice = np.r_[False, again] | np.r_[again, False] if len(at) else np.empty(0, bool)
    cover = np.zeros(len(words) + 1, np.int64)
    first = at[order[twice]]
    np.add.at(cover, first, 1)
    np.add.at(cover, first + width, -1)
    return np.bincount(doc, np.cumsum(cover)[:-1] > 0, len(counts)).astype(np.int64)


class Chains:
    """Lines of many documents in order of position, so that one step handles all documents that are long enough."""

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(-counts, kind="stable")
        lengths = counts[self.order]
        self.starts = (np.cumsum(counts) - counts)[self.order]
        self.steps = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(self.steps), "left")
        self.lengths = lengths

    def at(self, t: int) -> np.ndarray:
        """Places of the t-th lines."""
        return self.starts[: self.active[t]] + t


def viterbi(emission: np.ndarray, counts: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The best state (1: content) of each line; emission: score of content over boilerplate."""
    lines = Chains(counts)
    back = np.zeros((len(emission), 2), np.int8)
    state = np.zeros(len(emission), np.int8)
    if not lines.steps:
        return state
    score = np.zeros((lines.active[0], 2))
    score[:, 1] = emission[lines.at(0)]
    best = np.zeros(len(counts), np.int8)
    for t in range(1, lines.steps):
        a = lines.active[t]
        best[a : lines.active[t - 1]] = score[a : lines.active[t - 1]].argmax(1)
        step = score[:a, :, None] + chain
        at = lines.at(t)
        back[at] = step.argmax(1)
        score = step.max(1)
        score[:, 1] += emission[at]
    best[: len(score)] = score.argmax(1)
    for t in range(lines.steps - 1, -1, -1):
        at = lines.at(t)
        now = best[: len(at)]
        state[at] = now
        best[: len(at)] = back[at, now]
    return state


def fit_field(features: np.ndarray, counts: np.ndarray, states: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of content and of the chain that make these states likeliest: gradient ascent with adaptive steps."""
    lines = Chains(counts)
    n, width = features.shape
    theta = np.zeros(width + 4)
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    follows = np.ones(n, bool)
    follows[(np.cumsum(counts) - counts)[counts > 0]] = False
    later = np.flatnonzero(follows)
    pairs = np.bincount(states[later - 1] * 2 + states[later], minlength=4)
    seen = np.r_[features.T @ states, pairs]
    for turn in range(1, rounds + 1):
        emission, chain = features @ theta[:width], theta[width:].reshape(2, 2)
        local = np.stack([np.zeros(n), emission], axis=1)
        local = np.exp(local - local.max(1, keepdims=True))
        step = np.exp(chain - chain.max())
        forward, backward = np.zeros((n, 2)), np.ones((n, 2))
        scaled = np.full((lines.active[0], 2), 0.5)
        for t in range(lines.steps):
            at = lines.at(t)
            scaled = (scaled[: len(at)] @ step if t else scaled) * local[at]
            scaled /= scaled.sum(1, keepdims=True)
            forward[at] = scaled
        for t in range(lines.steps - 2, -1, -1):
            at = lines.at(t)[: lines.active[t + 1]]
            b = (local[at + 1] * backward[at + 1]) @ step.T
            backward[at] = b / b.sum(1, keepdims=True)
        content = forward * backward
        content = (content / content.sum(1, keepdims=True))[:, 1]
        joint = forward[later - 1][:, :, None] * step * (local[later] * backward[later])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        gradient = (seen - np.r_[features.T @ content, joint.sum(0).ravel()]) / max(1, n) - penalty * theta
        mean, spread = 0.9 * mean + 0.1 * gradient, 0.99 * spread + 0.01 * gradient**2
        theta = theta + 0.1 * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
    return theta[:width], theta[width:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The field's weights, from at most sample_docs labelled documents."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_docs)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_col):
            measured = Measured([t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()])
            cuts = np.cumsum(np.r_[0, measured.line_counts])
            flat = [measured.features[a:b].astype(np.int8).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), batch.column("quality").cast(pa.int64()), pa.array(flat, pa.binary())], ["id", "quality", "features"])

    found = [r for r in rows.mapInArrow(run, "id long, quality long, features binary").collect() if r["features"]]
    if len({r["quality"] > 0 for r in found}) < 2:
        return PRIOR, PRIOR_CHAIN
    found.sort(key=lambda r: (r["id"], r["features"]))
    features = np.concatenate([np.frombuffer(r["features"], np.int8).reshape(-1, len(FEATURES)) for r in found]).astype(float)
    counts = np.array([len(r["features"]) // len(FEATURES) for r in found])
    good = np.repeat([r["quality"] > 0 for r in found], counts)
    return fit_field(features, counts, good.astype(np.int64))


def judge_documents(docs: DataFrame, weights: np.ndarray, chain: np.ndarray, keep_share: float = KEEP_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the base statistics, base_failed, content_share and kept."""
    names = [id_col, *(x.split()[0] for x in BASE_TYPES.split(", ")), "base_failed", "content_share", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_col):
            measured, share, kept = judged(batch.column(text_col).cast(pa.binary()).to_pylist(), weights, chain, keep_share)
            base = [measured.n_words, measured.word_chars, measured.n_symbols, measured.n_dup_lines, measured.n_repeat_words, measured.base_failed]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *map(pa.array, (*base, share, kept))], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {BASE_TYPES}, base_failed boolean, content_share double, kept boolean")


def judged(texts: list[bytes | None], weights: np.ndarray, chain: np.ndarray, keep_share: float) -> tuple[Measured, np.ndarray, np.ndarray]:
    measured = Measured([t or b"" for t in texts])
    content = viterbi(measured.features @ weights, measured.line_counts, chain)
    chars = np.bincount(measured.line_doc, measured.line_chars * content, len(texts))
    share = chars / np.maximum(measured.word_chars, 1)
    return measured, share, ~measured.base_failed & (share >= keep_share)


def keep_good(docs: DataFrame, weights: np.ndarray, chain: np.ndarray, keep_share: float = KEEP_SHARE, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_col):
            yield batch.filter(pa.array(judged(batch.column(text_col).cast(pa.binary()).to_pylist(), weights, chain, keep_share)[2]))

    return docs.mapInArrow(run, docs.schema)
