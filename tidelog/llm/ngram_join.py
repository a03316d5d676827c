"""Self-join of documents by the Jaccard similarity of their word n-grams, as a size-aware heavy-light join.

Documents of equal sets are one class, and classes are joined. The order of tokens is global: by hash, then those of
many documents by how many, in steps of three times as many; these are counted over all documents, for half of the
tokens, and the other half comes last. The steps are kept in a map of fixed size, in which tokens can share a place: then
both take the step of the more frequent one. The order bears on cost, not on the result.

Light sets (size up to a boundary) enumerate all subsets of the size that a pair of sizes must share; sets under one
subset are linked without more ado. Heavy sets, and light ones close enough in size, scan inverted lists: a set enters
the lists of its first tokens, as many as a similar set can't avoid, unless a token is in no other document. The boundary
is where the estimated cost of enumerating plus scanning is least.

An inverted list isn't expanded into all pairs. First each set is compared with one centre, the heaviest set that leads
most of its lists; sets linked so form components. Then only pairs from different components are left. Those of one
centre's family are joined once more, heavy again, by the lists of what each set changes of the centre; others by the
lists they share, if their first tokens share enough. No pair that can be a link between components is passed over, and
comparisons are exact on the whole sets.

Defined cases: a null text counts as empty; empty sets are linked with nothing; fewer words than n are one n-gram, the
whole sequence; repeated rows and equal sets are one class; rows of one id with different texts are documents of their own, each
with the component of its own set; rows of a null id have a null component and link nothing; an empty table gives no
rows; other columns are ignored, whatever their names. A text's distinct n-grams can take 2 GB, Spark's own limit for a
value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.bpe import binary_column
from tidelog.llm.common import give_back, text_chunks
from tidelog.llm.common import settle as materialise
from tidelog.llm.components import components
from tidelog.llm.spans import mixed, ranges, span_hashes, words_of
from tidelog.llm.words import window_hashes

#: Tokens are hashes of 63 bits. Those below 2^COUNTED_BITS are counted: half, more than
#: the first tokens of a set that isn't tiny. They are counted by their first COUNT_BYTES bytes.
TOKEN_BITS, COUNTED_BITS, COUNT_BYTES = 63, 62, 6
#: The map of counted tokens has 2^MAP_BITS places of four bits, whatever the input: the step of how many documents have
#: one, 0 for a single one. It is broadcast (32 MB).
MAP_BITS = 26
STEPS = 2 * 3 ** np.arange(15)
#: Tokens of a higher step come after those that go by hash.
EARLY = 1
#: Text bytes for each bucket of the count, a power of two in number.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 1 << 16
FLUSH_TOKENS = 1_000_000
#: A larger set would enumerate hundreds of subsets, more than it has tokens: no cost can choose that.
LARGEST_LIGHT = 16
#: Percent of its first tokens that a set shares with the centre of its family, at least.
FAMILY = 10
ROOT_STEPS = 2
#: Partners of one set that a task takes.
SALT_ROWS = 200
LIST = ["token", "id", "n", "place", "end"]
#: Candidate rows that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
CUT = np.uint64(COUNTED_BITS - 8 * COUNT_BYTES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def token_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each text in ascending order, one after another, and how many each has."""
    joined = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    starts, ends = words_of(joined)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.r_[0, text_ends]))
    words = span_hashes(joined, starts, ends)
    windows, whole = window_hashes(words, counts, n)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint16 if len(texts) <= 1 << 16 else np.int64), counts)
    first = np.cumsum(counts) - counts
    for width in range(1, n):
        at = first[counts == width]
        if len(at):
            windows[at] = mixed(window_hashes(words, counts, width)[0][at] + np.uint64(width))
            whole[at] = True
    tokens, doc = windows[whole] >> np.uint64(64 - TOKEN_BITS), doc[whole]
    order = np.argsort(tokens)
    order = order[np.argsort(doc[order], kind="stable")]
    tokens, doc = tokens[order], doc[order]
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])][: len(tokens)]
    return tokens[new], np.bincount(doc[new], minlength=len(texts))


def text_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def required(s: int, t: int, percent: int) -> int:
    """What sets of these sizes must share at least: 100 i >= percent (s + t - i)."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


FACTS = "id long, text_hash long, n int, low long, high long, bucket int, steps binary, uses double, squares double"
OWN = ("id", "text_hash", "n", "low", "high")


def count_tokens(docs: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The facts: rows of documents (id, a hash of the text, n, and low and high of the set's fingerprint) and of parts of
    the map, each with the sums of its less frequent tokens' uses and of their squares; and how many parts there are."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bucket_bits = min(max(4, (size // BUCKET_BYTES).bit_length()), MOST_BUCKETS.bit_length() - 1)
    buckets, shift = 1 << bucket_bits, np.uint64(COUNTED_BITS - bucket_bits) - CUT

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = ["bucket", *OWN, "tokens", "times"]

        def counted() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held) >> CUT, return_counts=True)
            held.clear()
            bucket = (tokens >> shift).astype(np.int64)
            packed = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :COUNT_BYTES])
            there, at = np.unique(bucket, return_index=True)
            sizes = np.diff(np.r_[at, len(tokens)])
            nulls = [pa.nulls(len(there), facts_schema().field(c).type) for c in OWN]
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *nulls, binary_column(packed.ravel(), sizes * COUNT_BYTES), binary_column(np.minimum(times, 255).astype(np.uint8), sizes)], names)

        for batch in text_chunks(batches, text_col):
            tokens, counts = token_sets(text_column(batch, text_col), n)
            held.append(tokens[tokens < np.uint64(1 << COUNTED_BITS)])
            ends = np.cumsum(np.r_[0, counts])
            sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(tokens))]
            more = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)))]
            low, high = ((x[ends[1:]] - x[ends[:-1]]).view(np.int64) for x in (sums, more))
            ids = batch.column(id_col).cast(pa.int64())
            none = pa.nulls(len(counts), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((low % buckets).astype(np.int32)), ids, batch.column("_hash"), pa.array(counts.astype(np.int32)), pa.array(low), pa.array(high), none, none], names)
            if sum(map(len, held)) > FLUSH_TOKENS:
                yield counted()
        if held:
            yield counted()

    def gather(key: tuple, group: pa.Table) -> pa.Table:
        own = group.filter(pc.is_valid(group["n"]))
        packed = group.filter(pc.is_valid(group["tokens"]))
        narrow = np.frombuffer(b"".join(packed["tokens"].to_pylist()), np.uint8).reshape(-1, COUNT_BYTES)
        wide = np.zeros((len(narrow), 8), np.uint8)
        wide[:, :COUNT_BYTES] = narrow
        tokens = wide.view(np.uint64).ravel()
        times = np.frombuffer(b"".join(packed["times"].to_pylist()), np.uint8)
        distinct, inverse = np.unique(tokens, return_inverse=True)
        times = np.bincount(inverse, times, len(distinct)).astype(np.int64)
        step = np.searchsorted(STEPS, times, side="right").astype(np.uint8)
        width = 1 << (MAP_BITS - bucket_bits)
        place = ((distinct >> (np.uint64(COUNTED_BITS - MAP_BITS) - CUT)) % np.uint64(width)).astype(np.int64)
        steps = np.zeros(width, np.uint8)
        if len(place):
            begins = np.r_[0, np.flatnonzero(np.diff(place)) + 1]
            steps[place[begins]] = np.maximum.reduceat(step, begins)
        few = times[(step > 0) & (step <= EARLY)].astype(float)
        schema = facts_schema()
        part = [key[0].as_py(), (steps[::2] | steps[1::2] << 4).tobytes(), few.sum(), (few * few).sum()]
        rows = [
            [*(own[c].combine_chunks() for c in OWN), *(pa.nulls(own.num_rows, schema.field(c).type) for c in schema.names[len(OWN) :])],
            [*(pa.nulls(1, schema.field(c).type) for c in OWN), *(pa.array([x], schema.field(c).type) for c, x in zip(schema.names[len(OWN) :], part, strict=True))],
        ]
        give_back()
        return pa.concat_tables([pa.Table.from_arrays(r, schema=schema) for r in rows])

    hashed = docs.select(id_col, text_col, F.xxhash64(F.col(text_col)).alias("_hash"))
    scanned = hashed.mapInArrow(scan, "bucket int, id long, text_hash long, n int, low long, high long, tokens binary, times binary")
    return materialise(scanned.groupBy("bucket").applyInArrow(gather, FACTS)), buckets


def facts_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in FACTS.split(", "))])


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The largest light size: where enumerating light sets and scanning lists for the others costs least."""

    def subsets(s: int, most: int) -> int:
        return sum(comb(s, required(s, t, percent)) for t in partners(s, percent) if t <= most)

    def cost(most: int) -> float:
        light = sum(k * subsets(s, most) for s, k in sizes.items() if s <= most)
        heavy = sum(k * (s - -(-percent * s // 100) + 1) * list_length for s, k in sizes.items() if s > most)
        return light + heavy

    return min(range(LARGEST_LIGHT + 1), key=cost)


def postings(docs: DataFrame, sent: Broadcast, boundary: int, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: its id (as doc), low, n, where in the order its first tokens end, those whose lists it enters and its
    places there, and the subsets it enumerates, each with the side of it that its size is. sent: the map."""
    least = -(-percent * (boundary + 1) // 100)  # a set this small can be like a heavy one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = sent.value
        for batch in text_chunks(batches, text_col):
            tokens, counts = token_sets(text_column(batch, text_col), n)
            starts = np.cumsum(counts) - counts
            doc = np.repeat(np.arange(len(counts)), counts)
            size = counts[doc]
            counted = tokens < np.uint64(1 << COUNTED_BITS)
            # the order: counted tokens by hash, then the frequent ones by step and hash, then those that aren't counted
            at = (tokens[counted] >> np.uint64(COUNTED_BITS - MAP_BITS)).astype(np.int64)
            step = np.zeros(len(tokens), np.int64)
            step[counted] = steps[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15
            early, plain = counted & (step <= EARLY), tokens.astype(np.int64)
            key = np.where(early, plain + np.iinfo(np.int64).min, np.where(counted, step << 58 | plain >> 4, plain))
            earlies = np.r_[0, np.cumsum(early)]
            n_early = earlies[starts + counts] - earlies[starts]
            first = size - -(-percent * size // 100) + 1
            place = np.where(early, earlies[:-1] - earlies[starts[doc]], size) if len(doc) else first
            more = np.flatnonzero(~early & (n_early[doc] < first))
            more = more[np.lexsort((key[more], doc[more]))]
            if len(more):
                begins = np.r_[0, np.flatnonzero(np.diff(doc[more])) + 1]
                place[more] = n_early[doc[more]] + np.arange(len(more)) - np.repeat(begins, np.diff(np.r_[begins, len(more)]))
            last = np.flatnonzero(place == first - 1)
            end = np.zeros(len(counts), np.int64)
            end[doc[last]] = key[last]
            lists = (place < first) & (size >= least)
            lists &= ~counted | (step > 0)
            sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(tokens))]
            low = (sums[starts + counts] - sums[starts]).view(np.int64)
            kept = np.bincount(doc[lists], minlength=len(counts))
            keys, sides = [[] for _ in counts], [[] for _ in counts]
            for k in np.flatnonzero((counts > 0) & (counts <= boundary)).tolist():
                keys[k], sides[k] = subset_keys(tokens[starts[k] : starts[k] + counts[k]], boundary, percent)
            offsets = pa.array(np.cumsum(np.r_[0, kept]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).cast(pa.int64()),
                    pa.array(low),
                    pa.array(counts.astype(np.int32)),
                    pa.array(end),
                    pa.ListArray.from_arrays(offsets, pa.array(tokens[lists].astype(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(place[lists].astype(np.int32))),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sides, pa.list_(pa.int32())),
                ],
                ["doc", "low", "n", "end", "tokens", "places", "subsets", "sides"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, "doc long, low long, n int, end long, tokens array<long>, places array<int>, subsets array<long>, sides array<int>")


def subset_keys(tokens: np.ndarray, boundary: int, percent: int) -> tuple[list[int], list[int]]:
    """Keys of the subsets that a light set shares with similar light ones; side 0: it is the smaller of the pair's sizes,
    1: the larger, 2: both are the same."""
    s = len(tokens)
    keys, sides = [], []
    for t in partners(s, percent):
        if t > boundary:
            continue
        chosen = np.array([*combinations(range(s), required(s, t, percent))], np.int64)
        sums = np.zeros(len(chosen), np.uint64)
        for k in range(chosen.shape[1]):
            sums = mixed(sums + tokens[chosen[:, k]])
        sums = mixed(sums + np.uint64(min(s, t) << 8 | max(s, t)))
        keys += sums.view(np.int64).tolist()
        sides += [2 if s == t else int(s > t)] * len(chosen)
    return keys, sides


def light_links(entered: DataFrame) -> DataFrame:
    """Links of sets that share a subset: each with the least id of the other size, or of its own where both are the same."""
    rows = entered.select("id", F.explode(F.arrays_zip("subsets", "sides")).alias("s")).select("id", F.col("s.subsets").alias("key"), F.col("s.sides").alias("side"))
    least = rows.groupBy("key").agg(*(F.min(F.when(F.col("side") == k, F.col("id"))).alias(f"m{k}") for k in (0, 1, 2)))
    other = F.when(F.col("side") == 2, F.col("m2")).when(F.col("side") == 0, F.col("m1")).otherwise(F.col("m0"))
    return rows.join(least, "key").select(F.col("id").alias("a"), other.alias("b")).where("b IS NOT NULL AND a <> b").distinct()


def set_rows(docs: DataFrame, wanted: DataFrame, small: bool, classes: "Classes", n: int, id_col: str, text_col: str) -> DataFrame:
    """Of wanted classes (id and other columns), each with its `tokens` as bytes, from the document that stands for it."""
    names = wanted.columns
    wanted = wanted.join(classes.rows.select("id", "doc", "low"), "id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("_text")).join(F.broadcast(wanted) if small else wanted, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "_text"):
            tokens, counts = token_sets(text_column(batch, "_text"), n)
            ends = np.cumsum(np.r_[0, counts])
            sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(tokens))]
            right = (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64) == batch.column("low").to_numpy()
            out = pa.RecordBatch.from_arrays([*map(batch.column, names), binary_column(tokens, counts)], [*names, "tokens"])
            yield out.filter(pa.array(right))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name in names)
    return classes.once(rows.select(*names, "low", "_text").mapInArrow(run, f"{types}, tokens binary"))


def spread(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """Pairs, stored, with a salt that deals the partners of a much wanted `other` out to several tasks, and its salts."""
    salts = pairs.groupBy(other).agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    return materialise(pairs.join(salts, other).select(one, other, "salts", F.pmod(F.xxhash64(one), F.col("salts")).cast("int").alias("salt")))


def salts_of(salts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(salts) - 1)).alias("salt")


def verified(docs: DataFrame, pairs: DataFrame, classes: "Classes", n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The stored pairs (a, b) that are links. A set travels once for each of its pairs as a, and once as b."""
    salted = spread(pairs, "a", "b")
    small = salted.count() <= BROADCAST_ROWS
    of_a = salted.groupBy("a").agg(F.collect_set(F.struct("b", "salt")).alias("bs")).withColumnRenamed("a", "id")
    of_b = salted.select(F.col("b").alias("id"), "salts").distinct()
    a = set_rows(docs, of_a, small, classes, n, id_col, text_col).select(F.col("id").alias("a"), F.col("tokens").alias("a_tokens"), F.explode("bs").alias("at"))
    a = a.select("a", "a_tokens", "at.b", "at.salt")
    b = set_rows(docs, of_b, small, classes, n, id_col, text_col).select(F.col("id").alias("b"), F.col("tokens").alias("b_tokens"), salts_of("salts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            last, right = None, None
            for x, y in zip(batch.column("a_tokens").to_pylist(), batch.column("b_tokens").to_pylist(), strict=True):
                left = np.frombuffer(x, np.uint64)
                if y is not last:
                    last, right = y, np.frombuffer(y, np.uint64)
                small, large = (left, right) if len(left) < len(right) else (right, left)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                linked.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))
        give_back()

    return materialise(a.join(b, ["b", "salt"]).select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a long, b long"))


def family_pairs(docs: DataFrame, families: DataFrame, classes: "Classes", parts: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs of one family from different components that may be similar. families: id and its centre, pivot.

    Of a set only the difference from its pivot matters: two sets differ by the difference of these differences. Sets of
    different components aren't both linked to the pivot, so one is further from it than links reach; then similar ones
    must share about half of the nearer one's difference, and what few members share comes first in its order. So the
    members of a family that changed in ways of their own don't meet, however many they are."""
    salted = spread(families, "id", "pivot")
    small = salted.count() <= BROADCAST_ROWS
    own = set_rows(docs, salted.select("id", "pivot", "salt"), small, classes, n, id_col, text_col)
    pivots = set_rows(docs, salted.select(F.col("pivot").alias("id"), "salts").distinct(), small, classes, n, id_col, text_col)
    pivots = pivots.select(F.col("id").alias("pivot"), F.col("tokens").alias("pivot_tokens"), salts_of("salts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deltas, sizes, centre_sizes = [], [], []
            for x, c in zip(batch.column("tokens").to_pylist(), batch.column("pivot_tokens").to_pylist(), strict=True):
                mine, centre = np.frombuffer(x, np.uint64), np.frombuffer(c, np.uint64)
                deltas.append(np.setxor1d(mine, centre, assume_unique=True).astype(np.int64))
                sizes.append(len(mine))
                centre_sizes.append(len(centre))
            offsets = pa.array(np.cumsum([0, *map(len, deltas)]).astype(np.int32))
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *deltas]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("pivot"), pa.array(sizes, pa.int32()), pa.array(centre_sizes, pa.int32()), pa.ListArray.from_arrays(offsets, flat)], ["id", "pivot", "s", "c", "delta"])
        give_back()

    members = own.join(pivots, ["pivot", "salt"]).select("id", "pivot", "tokens", "pivot_tokens").mapInArrow(run, "id long, pivot long, s int, c int, delta array<long>")
    members = materialise(members.withColumn("d", F.size("delta")).join(parts.select("id", "component"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"))
    tokens = members.select("pivot", "id", "s", "d", "part", (F.col("d") * (100 + percent) <= (100 - percent) * (F.col("s") + F.col("c"))).alias("near"), F.ceil(((100 + percent) * F.col("d") + (100 - percent) * (F.col("c") - F.col("s"))) / (2 * (100 + percent))).alias("half"), F.explode("delta").alias("token"))
    shared = tokens.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    rare_first = Window.partitionBy("pivot", "id").orderBy("times", "token")
    placed = tokens.join(shared, ["pivot", "token"]).withColumn("rank", F.row_number().over(rare_first))
    # tokens of this member alone come before all others
    alone = F.col("d") - F.count(F.lit(1)).over(Window.partitionBy("pivot", "id"))
    placed = placed.withColumn("place", F.col("rank") + alone).withColumn("first", F.col("place") <= F.col("d") - F.greatest("half", F.lit(1)) + 1)
    placed = materialise(placed.select("pivot", "token", "id", "s", "d", "part", "near", "place", "first"))
    x, y = placed.where("first").alias("x"), placed.where("NOT near").alias("y")
    apart = (F.col("x.part") != F.col("y.part")) & (100 * F.least("x.s", "y.s") >= percent * F.greatest("x.s", "y.s"))
    # two far members meet where both have it first; a near one meets a far one anywhere
    orders = F.col("x.near") | F.col("y.first") & (F.col("x.id") < F.col("y.id"))
    # and early enough in both for what these two must share
    share = F.greatest(F.ceil(((100 + percent) * (F.col("x.d") + F.col("y.d")) - (100 - percent) * (F.col("x.s") + F.col("y.s"))) / (2 * (100 + percent))), F.lit(1))
    early = (F.col("x.place") <= F.col("x.d") - share + 1) & (F.col("y.place") <= F.col("y.d") - share + 1)
    met = x.join(y, ["pivot", "token"]).where(apart & orders & early)
    counted = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(
        F.count(F.lit(1)).alias("met"),
        F.least(F.first("x.d") - F.max("x.place"), F.first("y.d") - F.max("y.place")).alias("after"),
        (F.first("x.d") + F.first("y.d")).alias("apart"),
        (F.first("x.s") + F.first("y.s")).alias("sizes"),
    )
    least_apart = F.col("apart") - 2 * (F.col("met") + F.col("after"))
    return counted.where(least_apart * (100 + percent) <= (100 - percent) * F.col("sizes")).select("a", "b")


def meetings(x: DataFrame, y: DataFrame, apart: Column, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that meet in lists and may be similar, with how many tokens their first ones share.

    x, y: postings (token, id, n, place, end); apart: which of them form pairs. All common tokens up to the end of either
    set's first ones are among those counted. So no pair shares more than these and what can follow: the last of them, or
    the earlier of the two ends."""
    s, t = F.col("s"), F.col("t")
    met = x.alias("x").join(y.alias("y"), "token").where(apart & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
    counted = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(
        F.count(F.lit(1)).alias("met"),
        *(F.first(c).alias(name) for c, name in (("x.n", "s"), ("y.n", "t"), ("x.end", "s_end"), ("y.end", "t_end"))),
        (F.least(F.first("x.n") - F.max("x.place"), F.first("y.n") - F.max("y.place")) - 1).alias("after"),
    )
    beyond = F.when(F.col("s_end") < F.col("t_end"), s).otherwise(t)
    most = F.col("met") + F.least("after", F.ceil(beyond * percent / 100) - 1)
    return counted.withColumn("may", most * (100 + percent) >= percent * (s + t)).select("a", "b", "s", "met", "may")


def best_centres(lists: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Per set: the centre that leads most of the lists that both are in; if they may be similar by these lists alone, and
    if the set is of the centre's family, sharing at least FAMILY percent of its first tokens."""
    led = lists.join(centres, "token")
    met = meetings(led, lists, (F.col("x.centre") == F.col("y.id")) & (F.col("x.id") != F.col("y.id")), percent)
    best = F.max_by(F.struct("b", "s", "met", "may"), F.struct(F.col("met"), -F.col("b"))).alias("best")
    first = F.col("best.s") - F.ceil(F.col("best.s") * percent / 100) + 1
    return met.groupBy("a").agg(best).select("a", "best.b", "best.may", (100 * F.col("best.met") >= FAMILY * first).alias("family"))


def weighed(lists: DataFrame) -> DataFrame:
    """Postings of lists that more than one set is in, with `weight`: the lengths of all lists that their set is in. The text
    that others were made from has the greatest, as its tokens are in most of them."""
    lengths = lists.groupBy("token").agg(F.min("id").alias("m"), F.max("id").alias("k"), F.count(F.lit(1)).alias("length")).where("m <> k")
    busy = lists.join(lengths.select("token", "length"), "token")
    weights = busy.groupBy("id").agg(F.sum("length").alias("weight"))
    return busy.join(weights, "id").select(*LIST, "weight")


def leaders(lists: DataFrame, *within: str) -> DataFrame:
    """Per token (and what else is named): the id of most weight, of the least id among equals."""
    first = F.min(F.struct((-F.col("weight")).alias("w"), "id")).alias("first")
    return lists.groupBy("token", *within).agg(first).select("token", *within, F.col("first.id").alias("centre"))


class Classes:
    """Sets that differ: id, doc (the least id of a document that has the set), n, low and high."""

    def __init__(self, own: DataFrame):
        rows = own.groupBy("low", "high", "n", F.col("id").alias("doc")).agg(F.count(F.lit(1)).alias("copies"))
        first = rows.groupBy("low", "high", "n").agg(F.min(F.struct("doc", "copies")).alias("first"))
        # numbers that the stored copy fixes
        self.rows = materialise(first.select("low", "high", "n", "first.doc", "first.copies").withColumn("id", F.monotonically_increasing_id()))
        facts = self.rows.agg(F.max("copies"), *(F.count(F.when(F.col("n") == k, 1)) for k in range(1, LARGEST_LIGHT + 1))).first()
        self.repeated = (facts[0] or 1) > 1
        self.sizes = {k: facts[k] for k in range(1, LARGEST_LIGHT + 1)}

    def once(self, rows: DataFrame) -> DataFrame:
        """Drops rows that repeated rows of documents have made."""
        return rows.dropDuplicates(["id"]) if self.repeated else rows


def linked_sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, most_light: int | None) -> DataFrame:
    """Per row: id, text_hash, n (of the set), component_id, and part: a number of the component itself, as components can
    have one least id where an id has several texts."""
    spark = docs.sparkSession
    facts, buckets = count_tokens(docs, n, id_col, text_col)
    rows = facts.where("n IS NOT NULL").select(*OWN)
    classes = Classes(rows.where("id IS NOT NULL AND n > 0"))
    steps, uses, squares = np.zeros(1 << MAP_BITS - 1, np.uint8), 0.0, 0.0
    width = len(steps) // buckets
    for r in facts.where("steps IS NOT NULL").select("bucket", "steps", "uses", "squares").coalesce(4).toLocalIterator():
        steps[r[0] * width : (r[0] + 1) * width] = np.frombuffer(r[1], np.uint8)
        uses, squares = uses + r[2], squares + r[3]
    # the mean length of the list of a use, over the tokens that come first in the order
    boundary = choose_boundary(classes.sizes, squares / max(1.0, uses), percent) if most_light is None else most_light
    sent = spark.sparkContext.broadcast(steps)
    del steps
    entered = postings(docs, sent, boundary, n, percent, id_col, text_col).where("size(tokens) + size(subsets) > 0")
    entered = materialise(classes.once(entered.join(classes.rows.select("id", "doc", "low"), ["doc", "low"])))
    sent.destroy()
    links = light_links(entered)
    lists = entered.select("id", "n", "end", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select(F.col("t.tokens").alias("token"), "id", "n", F.col("t.places").alias("place"), "end")
    lists = materialise(weighed(lists))

    # each set against its centre
    centres = materialise(best_centres(lists, leaders(lists), percent))
    families = centres.where("family").select(F.col("a").alias("id"), F.col("b").alias("pivot"))
    for _ in range(ROOT_STEPS):
        # a centre that has one itself hands its family on; weights grow that way, so this ends
        above = families.select(F.col("id").alias("pivot"), F.col("pivot").alias("above"))
        families = families.join(above, "pivot", "left").select("id", F.coalesce("above", "pivot").alias("pivot"))
    families = materialise(families)
    tried = materialise(centres.where("may").select("a", "b").union(families.select("id", "pivot")).distinct())
    heads = families.select(F.col("pivot").alias("id")).distinct().join(families, "id", "left_anti")
    families = families.union(heads.select("id", F.col("id").alias("pivot")))
    links = materialise(links.union(verified(docs, tried, classes, n, percent, id_col, text_col)))
    del entered, centres
    parts = components(links)
    # then what is left: pairs from different components, by what they change of their family's centre, or by all lists
    marked = lists.join(parts.select("id", F.col("component").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
    several = marked.groupBy("token").agg(F.min("part").alias("m"), F.max("part").alias("k")).where("m <> k").select("token")
    lists = materialise(marked.join(several, "token").join(families, "id", "left").select(*LIST, "part", "pivot"))
    apart = (F.col("x.part") != F.col("y.part")) & (F.col("x.id") < F.col("y.id")) & ~F.coalesce(F.col("x.pivot") == F.col("y.pivot"), F.lit(False))
    rest = meetings(lists, lists, apart, percent).where("may").select("a", "b")
    spans = families.join(parts.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed_families = spans.groupBy("pivot").agg(F.min("component").alias("m"), F.max("component").alias("k")).where("m <> k").select("pivot")
    several_parts = materialise(families.join(mixed_families, "pivot", "left_semi").select("id", "pivot"))
    if several_parts.take(1):
        rest = rest.union(family_pairs(docs, several_parts, classes, parts, n, percent, id_col, text_col))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = materialise(rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    del lists, families, tried
    if rest.take(1):
        found = verified(docs, rest, classes, n, percent, id_col, text_col)
        if found.take(1):
            parts = components(links.union(found))
    classed = materialise(classes.rows.join(parts.select("id", "component"), "id", "left").select("low", "high", F.col("n").alias("_n"), "doc", F.coalesce("component", "id").alias("part")))
    least = classed.groupBy("part").agg(F.min("doc").alias("component_id"))
    classed = classed.join(least, "part").select("low", "high", "_n", "part", "component_id")
    result = rows.alias("r").join(classed.alias("c"), (F.col("r.low") == F.col("c.low")) & (F.col("r.high") == F.col("c.high")) & (F.col("r.n") == F.col("c._n")), "left")
    component = F.when(F.col("r.id").isNotNull(), F.coalesce("c.component_id", "r.id"))
    return result.select("r.id", "r.text_hash", "r.n", "c.part", component.alias("component_id"))


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most_light: int | None = None) -> DataFrame:
    """Per row: the id, n_shingles and component_id, the smallest id that its links reach (itself included)."""
    found = linked_sets(docs, n, percent, id_col, text_col, most_light)
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when each group of linked documents keeps one: the least id, and of several rows with
    that id one of the least text hash. Rows without an id or without words stay, all of them."""
    found = linked_sets(docs, n, percent, id_col, text_col, None).where("id IS NOT NULL AND n > 0")
    rows = found.groupBy("part", F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash")).agg(F.count(F.lit(1)).alias("_copies"))
    first = materialise(rows.groupBy("part").agg(F.min(F.struct("_id", "_text_hash", "_copies")).alias("first")).select("first.*"))
    words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    here = docs.withColumns({"_id": F.col(id_col).cast("long"), "_text_hash": F.xxhash64(F.col(text_col))})
    key = ["_id", "_text_hash"]
    several = first.where("_copies > 1")
    kept = here.join(first.where("_copies = 1"), key, "left_semi").select(docs.columns)
    if several.take(1):
        kept = kept.union(here.join(several, key, "left_semi").dropDuplicates(key).select(docs.columns))
    return kept.union(docs.where(F.col(id_col).isNull() | ~words))
