"""Semi-naive evaluation of predicates that recurse together.

Every predicate of the group has all its facts so far and those that the last round added. A round evaluates each
recursive rule once for each of its recursive literals, that one over the new facts and the others over all, and keeps
what wasn't known. With a monotonic aggregate a fact is a key and its best value: a round keeps the keys whose value got
better. mcount and msum keep the contributions (a key, what contributes, and how much) and derive the counts and sums.
The new facts of a round are written to the shared folder, so plans don't grow and a lost executor loses none of them.

Facts lie in parts, one for each round, of which some are merged from time to time. Where the relations that rules join
with are small enough to broadcast, each part stays hashed by its keys: a round then shuffles what it derives, partly
aggregated, and not the facts that are known. Else adaptive execution does it, as it can split skewed keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.datalog.rules import added, evaluate
from tidelog.datalog.strata import pivots
from tidelog.datalog.syntax import Aggregate, Atom, DatalogError, Rule
from tidelog.plans.store import stored


@dataclass
class Options:
    """How recursion runs.

    join_type: broadcast (of what is small enough), shuffle or sortmerge for the base side of joins; None broadcasts in
    recursion and else leaves it to Spark. union_distinct: rules of
    one predicate are made distinct together. use_partial: monotonic aggregates are aggregated before the shuffle.
    cache_build_side: relations that recursive rules join with are written once before the rounds. compact_every: rounds after which the
    facts so far become one frame. max_iterations: more rounds raise an error. partitions: of the facts, hashed by the
    arguments that recursion passes on; None hashes them by all. collect_stats: count the facts that each round derives.
    broadcast_rows: up to so many rows a relation that doesn't change is broadcast; 0 leaves it to Spark."""

    join_type: str | None = None
    union_distinct: bool = True
    use_partial: bool = True
    cache_build_side: bool = True
    compact_every: int = 8
    max_iterations: int = 10_000
    partitions: int | None = None
    collect_stats: bool = False
    broadcast_rows: int = 100_000

    @property
    def join_hint(self) -> str | None:
        # what is broadcast is chosen by its size
        hints = {None: None, "broadcast": None, "shuffle": "shuffle_hash", "sortmerge": "merge"}
        if self.join_type not in hints:
            raise DatalogError(f"join_type is broadcast, shuffle or sortmerge, not {self.join_type!r}")
        return hints[self.join_type]


    def fits(self, rows: DataFrame) -> bool:
        """Whether rows are few enough to broadcast."""
        return self.broadcast_rows > 0 and rows.limit(self.broadcast_rows + 1).count() <= self.broadcast_rows


@dataclass
class Round:
    """What a round did: facts that it derived (if collected) and those that were new, for each predicate."""

    number: int
    derived: dict[str, int | None] = field(default_factory=dict)
    new: dict[str, int] = field(default_factory=dict)


def same(names: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names))


class Relation:
    """A predicate's facts: all, and new in the last round."""

    def __init__(self, name: str, types: list[T.DataType], options: Options, keyed_by: list[int]):
        self.name, self.types, self.options = name, types, options
        self.columns = [f"c{k}" for k in range(len(types))]
        self.keys = [f"c{k}" for k in keyed_by] or self.columns
        self.parts: list[DataFrame] = []
        self.delta: DataFrame | None = None
        #: Parts keep their partitioning.
        self.in_place = False

    def kept(self, rows: DataFrame) -> DataFrame:
        return stored(rows, self.in_place)

    @property
    def total(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)

    def shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(c).cast(t).alias(c) for c, t in zip(self.columns, self.types, strict=True)))

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.options.partitions, *self.keys) if self.options.partitions else rows

    def begin(self, rows: DataFrame) -> int:
        self.delta = self.kept(self.placed(self.shaped(rows).distinct()))
        self.parts = [self.delta]
        return self.delta.count()

    def step(self, rows: DataFrame) -> int:
        """Takes a round's candidates; how many were new."""
        fresh = self.placed(self.shaped(rows).distinct())
        for known in self.parts if self.in_place else [self.total]:
            fresh = fresh.alias("n").join(known.alias("o"), same(self.columns, "n", "o"), "left_anti")
        self.delta = self.kept(fresh)
        return self.added(self.delta.count())

    def added(self, count: int) -> int:
        if count:
            self.parts.append(self.delta)
            if len(self.parts) > self.options.compact_every:
                self.parts = [self.kept(self.merged())]
        return count

    def merged(self) -> DataFrame:
        # distinct only to hash the facts: they are distinct
        return self.total.distinct() if self.in_place and not self.options.partitions else self.placed(self.total)


class BestRelation(Relation):
    """Keys and their least (mmin) or greatest (mmax) value, which is the last column."""

    def __init__(self, name: str, types: list[T.DataType], options: Options, keyed_by: list[int], function: str):
        super().__init__(name, types, options, keyed_by)
        self.function = function
        self.group, self.last = self.columns[:-1], self.columns[-1]

    def best(self, rows: DataFrame) -> DataFrame:
        rows = self.shaped(rows)
        if not self.options.use_partial:
            rows = rows.repartition(*self.group) if self.group else rows.coalesce(1)
        value = (F.min if self.function == "mmin" else F.max)(self.last).alias(self.last)
        return rows.groupBy(*self.group).agg(value).where(F.col(self.last).isNotNull())

    @property
    def total(self) -> DataFrame:
        rows = reduce(DataFrame.union, self.parts)
        return self.best(rows) if len(self.parts) > 1 else rows

    def begin(self, rows: DataFrame) -> int:
        self.delta = self.kept(self.placed(self.best(rows)))
        self.parts = [self.delta]
        return self.delta.count()

    def step(self, rows: DataFrame) -> int:
        """A part holds the values that a round made better; of a key's values in several parts the best counts."""
        fresh = self.placed(self.best(rows)).withColumnRenamed(self.last, "new").withColumn("old", F.lit(None).cast(self.types[-1]))
        for known in self.parts if self.in_place else [self.total]:
            condition = same(self.group, "n", "o") if self.group else F.lit(True)
            old = (F.least if self.function == "mmin" else F.greatest)(F.col("n.old"), F.col(f"o.{self.last}"))
            fresh = fresh.alias("n").join(known.alias("o"), condition, "left").select(*(F.col(f"n.{c}").alias(c) for c in self.group), F.col("n.new").alias("new"), old.alias("old"))
        better = F.col("new") < F.col("old") if self.function == "mmin" else F.col("new") > F.col("old")
        self.delta = self.kept(fresh.where(F.col("old").isNull() | better).select(*self.group, F.col("new").alias(self.last)))
        return self.added(self.delta.count())

    def merged(self) -> DataFrame:
        return self.placed(self.total)


class SumRelation(Relation):
    """Keys, and the count of their distinct contributors (mcount) or the sum of each contributor's greatest value (msum)."""

    def __init__(self, name: str, types: list[T.DataType], options: Options, keyed_by: list[int], function: str, contributors: int):
        super().__init__(name, types, options, keyed_by)
        self.function = function
        self.group, self.last = self.columns[:-1], self.columns[-1]
        self.by = [f"k{i}" for i in range(contributors)]
        self.given: DataFrame | None = None

    def contributions(self, rows: DataFrame) -> DataFrame:
        if self.function == "mcount":
            return rows.select(*self.group, *self.by, F.col(self.last).cast("string").alias("who"), F.lit(1).alias("amount")).distinct()
        return rows.select(*self.group, *self.by, F.lit("").alias("who"), F.col(self.last).alias("amount")).groupBy(*self.group, *self.by, "who").agg(F.max("amount").alias("amount"))

    def sums(self, given: DataFrame) -> DataFrame:
        return self.shaped(given.groupBy(*self.group).agg(F.sum("amount").alias(self.last)))

    def begin(self, rows: DataFrame) -> int:
        self.given = stored(self.contributions(rows))
        self.delta = stored(self.sums(self.given))
        self.parts = [self.delta]
        return self.delta.count()

    def step(self, rows: DataFrame) -> int:
        who = [*self.group, *self.by, "who"]
        condition = same(who, "n", "o")
        joined = self.contributions(rows).alias("n").join(self.given.alias("o"), condition, "left")
        fresh = stored(joined.where(F.col("o.amount").isNull() | (F.col("n.amount") > F.col("o.amount"))).select(*(F.col(f"n.{c}") for c in (*who, "amount"))))
        if not fresh.take(1):
            self.delta = self.delta.limit(0)
            return 0
        self.given = stored(self.given.alias("o").join(fresh.alias("n"), condition, "left_anti").union(fresh))
        touched = fresh.select(*self.group).distinct()
        on = same(self.group, "a", "b") if self.group else F.lit(True)
        self.delta = stored(self.sums(self.given.alias("a").join(touched.alias("b"), on, "left_semi")))
        kept = self.total.alias("a").join(self.delta.alias("b"), on, "left_anti")
        self.parts = [stored(kept.union(self.delta))]
        return self.delta.count()


class Recursion:
    """One group of predicates that recurse together. known: facts of all other predicates that its rules read."""

    def __init__(self, spark: SparkSession, group: list[str], rules: list[Rule], known: dict[str, DataFrame], options: Options, bounds: dict[str, dict[int, object]]):
        self.spark, self.group, self.options, self.bounds = spark, group, options, bounds
        self.rules = [r for r in rules if r.head.predicate in group]
        self.known = dict(known)
        if options.cache_build_side:
            # each round joins with these: they are computed once
            self.known |= {p: stored(self.known[p]) for p in self.joined() & known.keys()}
        #: Relations that don't change and are small enough to broadcast.
        self.small = {p for p in self.joined() & self.known.keys() if options.join_type in (None, "broadcast") and options.fits(self.known[p])}
        self.exits = [r for r in self.rules if not self.places(r)]
        self.recursive = [r for r in self.rules if self.places(r)]
        self.relations: dict[str, Relation] = {}
        self.rounds: list[Round] = []

    def joined(self) -> set[str]:
        """What recursive rules join with or negate, besides the group."""
        return {a.predicate for r in self.rules if self.places(r) for a in r.body if isinstance(a, Atom)} - {*self.group}

    def narrow(self, p: str) -> bool:
        """Whether the recursive rules of a predicate join one recursive literal with relations that are broadcast."""
        return all(len(self.places(r)) == 1 and all(a.predicate in self.small for a in r.body if isinstance(a, Atom) and a.predicate not in self.group) for r in self.rules if r.head.predicate == p and self.places(r))

    def places(self, r: Rule) -> list[int]:
        """Where a rule's body reads the group."""
        return [k for k, a in enumerate(r.body) if isinstance(a, Atom) and not a.negated and a.predicate in self.group]

    def monotonic(self, predicate: str) -> Aggregate | None:
        last = next(r for r in self.rules if r.head.predicate == predicate).head.terms[-1:]
        return last[0] if last and isinstance(last[0], Aggregate) and last[0].monotonic else None

    def derive(self, r: Rule, place: int | None) -> DataFrame:
        def facts(k: int, atom: Atom) -> DataFrame:
            if atom.predicate not in self.group:
                known = self.known[atom.predicate]
                return F.broadcast(known) if place is not None and atom.predicate in self.small else known
            relation = self.relations[atom.predicate]
            return relation.delta if k == place else relation.total

        if place is not None and not any(a.predicate in self.small for a in r.atoms) and (rows := added(r, facts)) is not None:
            # with adaptive execution, which a round's plan may be without
            return stored(rows)
        return evaluate(self.spark, r, facts, place, self.options.join_hint)

    def together(self, frames: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.union, frames)
        return rows.distinct() if self.options.union_distinct and len(frames) > 1 else rows

    def infer(self) -> dict[str, list[T.DataType]]:
        """Column types: those of the exit rules, widened by what the recursive rules make of them until nothing changes."""
        types: dict[str, list[T.DataType]] = {}
        for _ in range(20):
            before = dict(types)
            for p in self.group:
                shapes = [self.schema_of(r, types) for r in self.rules if r.head.predicate == p and all(a.predicate in types for a in r.atoms if a.predicate in self.group)]
                if shapes:
                    columns = [list(c) for c in zip(*shapes, strict=True)]
                    types[p] = [widest(c) for c in columns]
            if types == before and len(types) == len(self.group):
                return types
        raise DatalogError(f"no rule gives {sorted(set(self.group) - set(types)) or self.group} its first facts, or its types keep growing")

    def schema_of(self, r: Rule, types: dict[str, list[T.DataType]]) -> list[T.DataType]:
        def facts(k: int, atom: Atom) -> DataFrame:
            if atom.predicate not in self.group:
                return self.known[atom.predicate]
            return self.spark.createDataFrame([], T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types[atom.predicate])]))

        schema = evaluate(self.spark, Rule(r.head, tuple(a for a in r.body if not (isinstance(a, Atom) and a.negated))), facts).schema
        found = [schema[f"c{k}"].dataType for k in range(len(r.head.terms))]
        if (last := self.monotonic(r.head.predicate)) and last.function in ("mcount", "msum"):
            found[-1] = T.LongType() if last.function == "mcount" or isinstance(found[-1], T.IntegralType) else T.DoubleType()
        return found

    def relation(self, p: str, types: list[T.DataType]) -> Relation:
        keyed_by, last = pivots(self.rules, p), self.monotonic(p)
        if last is None:
            return Relation(p, types, self.options, keyed_by)
        if last.function in ("mmin", "mmax"):
            return BestRelation(p, types, self.options, [k for k in keyed_by if k < len(types) - 1], last.function)
        return SumRelation(p, types, self.options, keyed_by, last.function, len(last.key))

    def run(self) -> dict[str, DataFrame]:
        """All facts of each predicate of the group."""
        types = self.infer()
        first = Round(0)
        for p in self.group:
            self.relations[p] = relation = self.relation(p, types[p])
            relation.in_place = self.narrow(p) and not isinstance(relation, SumRelation)
            frames = [self.derive(r, None) for r in self.exits if r.head.predicate == p]
            if not frames:
                keys = len(relation.by) if isinstance(relation, SumRelation) else 0
                fields = [*(T.StructField(c, t) for c, t in zip(relation.columns, types[p], strict=True)), *(T.StructField(f"k{i}", T.LongType()) for i in range(keys))]
                frames = [self.spark.createDataFrame([], T.StructType(fields))]
            rows = self.together([ordered(f, relation) for f in frames])
            for place, constant in self.bounds.get(p, {}).items():
                rows = rows.where(F.col(f"c{place}") == F.lit(constant))
            first.new[p] = relation.begin(rows)
        self.rounds.append(first)
        while any(self.rounds[-1].new.values()):
            if len(self.rounds) > self.options.max_iterations:
                raise DatalogError(f"{', '.join(self.group)}: no fixpoint after {self.options.max_iterations} rounds")
            this = Round(len(self.rounds))
            candidates: dict[str, DataFrame] = {}
            for p in self.group:
                frames = [ordered(self.derive(r, k), self.relations[p]) for r in self.recursive if r.head.predicate == p for k in self.places(r) if self.rounds[-1].new[r.body[k].predicate]]
                if frames:
                    candidates[p] = self.together(frames)
            # all candidates read the last round's facts
            if len(candidates) > 1:
                candidates = {p: stored(rows) for p, rows in candidates.items()}
            for p in self.group:
                if p in candidates:
                    this.derived[p] = candidates[p].count() if self.options.collect_stats else None
                    this.new[p] = self.relations[p].step(candidates[p])
                else:
                    this.new[p] = 0
            self.rounds.append(this)
        return {p: r.total for p, r in self.relations.items()}


def ordered(rows: DataFrame, relation: Relation) -> DataFrame:
    return rows.select(*relation.columns, *(c for c in rows.columns if c not in relation.columns))


#: From the narrowest.
NUMBERS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType())


def widest(types: list[T.DataType]) -> T.DataType:
    """The type that all of these fit: the same, or the widest number (long and float make double)."""
    distinct = list(dict.fromkeys(t for t in types if not isinstance(t, T.NullType))) or [T.StringType()]
    if len(distinct) == 1:
        return distinct[0]
    if all(t in NUMBERS for t in distinct):
        top = max(distinct, key=NUMBERS.index)
        return T.DoubleType() if isinstance(top, T.FloatType) and T.LongType() in distinct else top
    if all(isinstance(t, T.NumericType) for t in distinct):
        return T.DoubleType() if any(isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType) for t in distinct) else T.DecimalType(38, 10)
    raise DatalogError(f"columns of one predicate have types {', '.join(t.simpleString() for t in distinct)}")
