"""Programs, their relations and queries."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.datalog.fixpoint import Options, Recursion, Round
from tidelog.datalog.rules import counted, evaluate, matched
from tidelog.datalog.strata import check, components, needed, pivots, used_by
from tidelog.datalog.syntax import Aggregate, Atom, Constant, DatalogError, Rule, Sort, Source, Variable, parse_program, parse_query
from tidelog.sources.facts import read_facts, rows_of_text

TYPES: dict[str, T.DataType] = {
    "byte": T.ByteType(),
    "short": T.ShortType(),
    "integer": T.IntegerType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "datetime": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
    "longlong": T.DecimalType(38, 0),
}


class DatalogSession:
    """Holds a program and the facts of its declared relations.

        datalog = DatalogSession(spark)
        datalog.load_program("database({arc(From: integer, To: integer)}). tc(A,B) <- arc(A,B). tc(A,B) <- tc(A,C), arc(C,B).")
        datalog.register("arc", ["1,2", "2,3"])
        datalog.query("tc(1, B).").to_df()
    """

    def __init__(self, spark: SparkSession, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        self.reset()

    def reset(self) -> None:
        self.source, self.facts = Source(), {}

    def load_program(self, text: str) -> None:
        """Adds declarations and rules; nothing is added if the program isn't sound."""
        new = parse_program(text)
        whole = Source({**self.source.relations, **new.relations}, [*self.source.rules, *new.rules])
        for name, columns in new.relations.items():
            for column, kind in columns:
                if kind.lower() not in TYPES:
                    raise DatalogError(f"{name}.{column}: unsupported type {kind}")
        check(whole)
        self.source = whole

    def load_file(self, path: str) -> None:
        """Adds the program in a text file, which any file system that Spark reads may hold."""
        self.load_program("\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))

    def schemas(self) -> dict[str, T.StructType]:
        return {name: T.StructType([T.StructField(c, TYPES[kind.lower()], True) for c, kind in columns]) for name, columns in self.source.relations.items()}

    def register(self, name: str, data: str | DataFrame | Iterable) -> DataFrame:
        """Sets a relation's facts: a file's path, lines of text, rows, or a DataFrame (by position). Also a temporary view."""
        if name not in self.source.relations:
            raise DatalogError(f"{name} isn't declared")
        schema = self.schemas()[name]
        if isinstance(data, DataFrame):
            if len(data.columns) < len(schema):
                raise DatalogError(f"{name} has {len(schema)} columns, the data {len(data.columns)}")
            frame = data.select(*(F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(data.columns, schema, strict=False)))
        elif isinstance(data, str):
            frame = read_facts(self.spark, data, schema)
        else:
            rows = list(data)
            frame = rows_of_text(self.spark, rows, schema) if all(isinstance(r, str) for r in rows) else self.spark.createDataFrame(rows, schema)
        frame.createOrReplaceTempView(name)
        self.facts[name] = frame.toDF(*(f"c{k}" for k in range(len(schema))))
        return frame

    def relation(self, name: str) -> DataFrame:
        """A declared relation's facts, under its own column names."""
        return self.facts[name].toDF(*(c for c, _ in self.source.relations[name]))

    def query(self, text: str) -> Program:
        """A query such as "tc(1, B)."; it runs when its result is asked for."""
        goal = parse_query(text)
        if goal.predicate not in self.source.relations and all(r.head.predicate != goal.predicate for r in self.source.rules):
            raise DatalogError(f"nothing defines {goal.predicate}")
        return Program(self, goal)


class Program:
    """A query over a session's program, as it is when first run."""

    def __init__(self, session: DatalogSession, goal: Atom):
        self.session, self.goal = session, goal
        self.rounds: dict[str, list[Round]] = {}
        self._result: DataFrame | None = None

    def plan(self) -> tuple[list[list[str]], list[Rule], dict[str, dict[int, object]]]:
        """The groups of predicates to evaluate, in order; their rules; and arguments bound to constants in exit rules."""
        rules = self.session.source.rules
        graph = used_by(rules)
        wanted = needed(graph, self.goal.predicate)
        groups = [g for g in components({p: graph[p] & wanted for p in wanted})]
        own = [r for r in rules if r.head.predicate in wanted]
        return groups, own, self.push_constants(groups, own)

    def push_constants(self, groups: list[list[str]], rules: list[Rule]) -> dict[str, dict[int, object]]:
        """Constants of the query that may filter a predicate's first facts: those of arguments that recursion passes on
        unchanged, followed through rules that are the only readers of what they read."""
        group_of = {p: g for g in groups for p in g}
        found = {self.goal.predicate: {k: t.value for k, t in enumerate(self.goal.terms) if isinstance(t, Constant)}}
        for p in [p for g in reversed(groups) for p in g]:
            bound = found.get(p, {})
            own = [r for r in rules if r.head.predicate == p]
            recursive = len(group_of[p]) > 1 or any(a.predicate == p for r in own for a in r.atoms)
            if recursive:
                bound = {k: v for k, v in bound.items() if len(group_of[p]) == 1 and k in pivots(rules, p)}
            found[p] = bound
            if recursive or len(own) != 1:
                continue
            for atom in own[0].atoms:
                readers = [(r, a) for r in rules for a in r.atoms if a.predicate == atom.predicate and r.head.predicate not in group_of.get(atom.predicate, [])]
                if atom.predicate in group_of and len(readers) == 1 and not atom.negated:
                    given = {own[0].head.terms[k]: v for k, v in bound.items() if isinstance(own[0].head.terms[k], Variable)}
                    found[atom.predicate] = {k: given[t] for k, t in enumerate(atom.terms) if t in given}
        return {p: b for p, b in found.items() if b}

    def run(self) -> DataFrame:
        if self._result is None:
            session, (groups, rules, bounds) = self.session, self.plan()
            known = dict(session.facts)
            for name in {a.predicate for r in rules for a in r.atoms if a.predicate in session.source.relations} | ({self.goal.predicate} & set(session.source.relations)):
                if name not in known:
                    raise DatalogError(f"{name} is declared, but has no facts")
            for group in groups:
                own = [r for r in rules if r.head.predicate in group]
                if len(group) > 1 or any(a.predicate in group for r in own for a in r.atoms):
                    recursion = Recursion(session.spark, group, own, known, session.options, bounds)
                    known |= recursion.run()
                    self.rounds |= {p: recursion.rounds for p in group}
                else:
                    known[group[0]] = self.derived(own, known, self.read_whole(group[0], rules))
            self._result = self.answer(known[self.goal.predicate], rules)
        return self._result

    def read_whole(self, predicate: str, rules: list[Rule]) -> bool:
        """Whether nothing reads a predicate with constants, which a plain join is filtered by."""
        return not any(isinstance(t, Constant) for a in (self.goal, *(a for r in rules for a in r.atoms)) if a.predicate == predicate for t in a.terms)

    def derived(self, rules: list[Rule], known: dict[str, DataFrame], whole: bool = False) -> DataFrame:
        """The facts of a predicate that isn't recursive. whole: nothing filters them."""
        session = self.session
        frames, aggregate = [], False
        for r in rules:
            first = next((k for k, a in enumerate(r.body) if isinstance(a, Atom) and not a.negated), None)

            def facts(k: int, atom: Atom, first: int | None = first) -> DataFrame:
                rows = known[atom.predicate]
                return F.broadcast(rows) if session.options.join_type == "broadcast" and k != first and session.options.fits(rows) else rows

            rows = counted(session.spark, r, facts) if whole else None
            rows = evaluate(session.spark, r, facts, None, session.options.join_hint) if rows is None else rows
            last = r.head.terms[-1] if r.head.terms else None
            if isinstance(last, Aggregate) and last.monotonic:
                # outside recursion a monotonic aggregate is the plain one
                group = [f"c{k}" for k in range(len(r.head.terms) - 1)]
                keys = [c for c in rows.columns if c.startswith("k")]
                value = f"c{len(group)}"
                made = {"mmin": F.min(value), "mmax": F.max(value), "mcount": F.count_distinct(value, *keys), "msum": F.sum(value)}[last.function]
                rows = rows.groupBy(*group).agg(made.alias(value))
            aggregate |= any(isinstance(t, Aggregate) for t in r.head.terms)
            frames.append(rows)
        if len(frames) == 1 and (aggregate or any(isinstance(x, Sort) for x in rules[0].body)):
            return frames[0]
        rows = reduce(DataFrame.union, frames)
        return rows.distinct() if session.options.union_distinct or len(frames) == 1 else rows

    def answer(self, facts: DataFrame, rules: list[Rule]) -> DataFrame:
        """The goal's facts, each argument under its variable's name in lower case."""
        terms = self.goal.terms or tuple(Variable(f"C{k}") for k in range(len(facts.columns)))
        if len(terms) != len(facts.columns):
            raise DatalogError(f"{self.goal.predicate} has {len(facts.columns)} arguments, the query {len(terms)}")
        names: list[str] = []
        for k, t in enumerate(terms):
            name = t.name.lower() if isinstance(t, Variable) and not t.anonymous else f"c{k}"
            names.append(name if name not in names else f"{name}{k}")
        shown = matched_rows(facts, Atom(self.goal.predicate, terms))
        return shown.toDF(*names)

    def to_df(self) -> DataFrame:
        return self.run()

    def count(self) -> int:
        return self.run().count()

    def collect(self) -> list[Row]:
        return self.run().collect()

    def explain(self) -> str:
        """The strata, how each recursive predicate runs, and the bound arguments that are pushed down."""
        groups, rules, bounds = self.plan()
        lines = []
        for g in groups:
            own = [r for r in rules if r.head.predicate in g]
            recursive = len(g) > 1 or any(a.predicate in g for r in own for a in r.atoms)
            for p in g:
                kept = pivots(own, p) if recursive else []
                lines.append(f"{p}: {'recursive with ' + ', '.join(sorted(set(g) - {p})) if len(g) > 1 else 'recursive' if recursive else 'derived'}; {sum(r.head.predicate == p for r in own)} rules" + (f"; passes on arguments {kept}" if kept else "") + (f"; bound {bounds[p]}" if p in bounds else ""))
        return "\n".join(lines)


def matched_rows(facts: DataFrame, atom: Atom) -> DataFrame:
    """Facts that fit a query: its constants, and variables that it repeats."""
    first: dict[Variable, str] = {}
    for k, t in enumerate(atom.terms):
        if isinstance(t, Constant):
            facts = facts.where(F.col(f"c{k}") == F.lit(t.value))
        elif isinstance(t, Variable) and not t.anonymous:
            if t in first:
                facts = facts.where(F.col(f"c{k}") == F.col(first[t]))
            first.setdefault(t, f"c{k}")
    return facts


__all__ = ["DatalogSession", "Options", "Program", "matched"]
