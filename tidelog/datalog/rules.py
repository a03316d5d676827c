"""A rule's body as joins, filters and projections, and its head as a projection or an aggregation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from tidelog.datalog import products
from tidelog.datalog.syntax import Aggregate, Arithmetic, Atom, Comparison, Constant, DatalogError, Rule, Sort, Term, Variable, variables
from tidelog.plans.store import stored

#: Gives the facts of the atom at a place of the body, as columns c0, c1, ...
Facts = Callable[[int, Atom], DataFrame]


def column(v: Variable) -> str:
    return f"v_{v.name}"


def value(term: Term) -> Column:
    if isinstance(term, Variable):
        return F.col(column(term))
    if isinstance(term, Constant):
        return F.lit(term.value)
    left, right = value(term.left), value(term.right)
    return {"+": left + right, "-": left - right, "*": left * right, "/": left / right}[term.sign]


def compared(c: Comparison) -> Column:
    left, right = value(c.left), value(c.right)
    return {"=": left == right, "~=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[c.sign]


def matched(facts: DataFrame, atom: Atom) -> DataFrame:
    """An atom's facts with its constants and repeated variables as filters, and one column for each variable."""
    columns: dict[Variable, str] = {}
    for k, term in enumerate(atom.terms):
        name = f"c{k}"
        if isinstance(term, Constant):
            facts = facts.where(F.col(name) == F.lit(term.value))
        elif isinstance(term, Variable) and not term.anonymous:
            if term in columns:
                facts = facts.where(F.col(name) == F.col(columns[term]))
            else:
                columns[term] = name
        elif isinstance(term, Arithmetic):
            raise DatalogError(f"{atom.predicate} holds an expression")
    return facts.select(*(F.col(name).alias(column(v)) for v, name in columns.items()))


def bound_by(atom: Atom) -> set[Variable]:
    return {v for t in atom.terms for v in variables(t)}


class Body:
    """The join of a rule's literals as far as it has come."""

    def __init__(self, spark: SparkSession, rule: Rule, join_hint: str | None):
        self.spark, self.rule, self.hint = spark, rule, join_hint
        self.frame: DataFrame | None = None
        self.bound: set[Variable] = set()
        self.waiting = [x for x in rule.body if isinstance(x, Comparison)]
        self.negated = [(k, a) for k, a in enumerate(rule.body) if isinstance(a, Atom) and a.negated]
        self.atoms = [(k, a) for k, a in enumerate(rule.body) if isinstance(a, Atom) and not a.negated]
        self.sorts = [x for x in rule.body if isinstance(x, Sort)]

    def settle(self) -> None:
        """Applies the comparisons and assignments whose variables are bound."""
        moved = True
        while moved:
            moved = False
            for c in list(self.waiting):
                if not (variables(c.left) | variables(c.right)) - self.bound:
                    self.frame = self.frame.where(compared(c))
                elif (target := self.assigned(c)) is not None:
                    given = c.right if target is c.left else c.left
                    self.frame = self.frame.withColumn(column(target), value(given))
                    self.bound.add(target)
                else:
                    continue
                self.waiting.remove(c)
                moved = True

    def assigned(self, c: Comparison) -> Variable | None:
        """The variable that a comparison binds now."""
        if c.sign == "=":
            for target, given in ((c.left, c.right), (c.right, c.left)):
                if isinstance(target, Variable) and not target.anonymous and target not in self.bound and not variables(given) - self.bound:
                    return target
        return None

    def needed(self) -> set[Variable]:
        """Bound variables that the rest of the rule reads."""
        rest = [*self.waiting, *(a for _, a in self.atoms), *(a for _, a in self.negated)]
        used = {v for x in rest for v in (bound_by(x) if isinstance(x, Atom) else variables(x.left) | variables(x.right))}
        used |= {v for t in self.rule.head.terms for v in variables(t)} | {v for s in self.sorts for v, _ in s.keys}
        return used & self.bound

    def prune(self) -> None:
        keep = sorted(column(v) for v in self.needed())
        # a body whose variables are all used up still has its rows
        self.frame = self.frame.select(*keep) if keep else self.frame.select(F.lit(1).alias("_row"))

    def next_atom(self) -> tuple[int, Atom]:
        """The first literal that shares a variable with those joined; else the first that a comparison ties to them."""
        for k, a in self.atoms:
            if bound_by(a) & self.bound:
                return k, a
        for k, a in self.atoms:
            if any(not (variables(c.left) | variables(c.right)) - self.bound - bound_by(a) for c in self.waiting):
                return k, a
        return self.atoms[0]

    def add(self, k: int, atom: Atom, facts: DataFrame, hinted: bool) -> None:
        self.atoms.remove((k, atom))
        own = matched(facts, atom)
        if hinted and self.hint:
            own = own.hint(self.hint)
        if self.frame is None:
            self.frame, self.bound = own, bound_by(atom)
        else:
            shared = sorted(bound_by(atom) & self.bound, key=lambda v: v.name)
            self.bound |= bound_by(atom)
            if shared:
                self.frame = self.frame.join(own, [column(v) for v in shared])
            else:
                ready = [c for c in self.waiting if not (variables(c.left) | variables(c.right)) - self.bound]
                self.waiting = [c for c in self.waiting if c not in ready]
                self.frame = self.frame.join(own, reduce(lambda a, b: a & b, map(compared, ready))) if ready else self.frame.crossJoin(own)
        self.settle()
        self.prune()

    def subtract(self, atom: Atom, facts: DataFrame) -> None:
        """Drops the rows that a negated literal holds for."""
        own = matched(facts, atom).distinct()
        names = own.columns
        if not names:
            if own.take(1):
                self.frame = self.frame.limit(0)
            return
        other = own.toDF(*(f"n_{c}" for c in names))
        self.frame = self.frame.join(other, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in names)), "left_anti")


def paired(rule: Rule) -> tuple[int, int, Variable] | None:
    """Where a rule's two literals are, if they share one variable, which the head lacks: that of the head's first argument,
    that of its second, and what they share."""
    atoms = [(k, a) for k, a in enumerate(rule.body) if isinstance(a, Atom) and not a.negated]
    plain = all(isinstance(t, Variable) for _, a in atoms for t in a.terms) and all(len({t for t in a.terms if not t.anonymous}) == sum(not t.anonymous for t in a.terms) for _, a in atoms)
    if len(atoms) != 2 or not plain or len(rule.head.terms) != 3 or not all(isinstance(t, Variable) for t in rule.head.terms[:2]) or any(isinstance(x, Sort) for x in rule.body):
        return None
    shared, (x, y) = bound_by(atoms[0][1]) & bound_by(atoms[1][1]), rule.head.terms[:2]
    order = sorted(atoms, key=lambda a: x not in bound_by(a[1]))
    if len(shared) != 1 or {x, y} & shared or x == y or x not in bound_by(order[0][1]) or y not in bound_by(order[1][1]):
        return None
    return order[0][0], order[1][0], next(iter(shared))


def side(facts: DataFrame, atom: Atom, names: dict[str, Variable]) -> DataFrame | None:
    """Columns of an atom's facts by these names, as longs; None if they aren't whole numbers."""
    place = {name: f"c{atom.terms.index(v)}" for name, v in names.items()}
    if not all(isinstance(facts.schema[c].dataType, T.IntegralType) for c in place.values()):
        return None
    return facts.select(*(F.col(c).cast("long").alias(name) for name, c in place.items()))


def counted(spark: SparkSession, rule: Rule, facts: Facts) -> DataFrame | None:
    """What a rule derives that counts, for two variables, the values of a third that two literals share, with conditions on
    the two: as a product, conditions after it. None if the rule isn't of this form."""
    last = rule.head.terms[-1] if rule.head.terms else None
    if not isinstance(last, Aggregate) or last.function != "count" or (pair := paired(rule)) is None:
        return None
    left, right, k = pair
    x, y = rule.head.terms[:2]
    rest = [a for a in rule.body if isinstance(a, Comparison) or a.negated]
    inside = all((variables(a.left) | variables(a.right) if isinstance(a, Comparison) else bound_by(a)) <= {x, y} for a in rest)
    if not inside or not (last.over == k or isinstance(last.over, Variable) and last.over.anonymous):
        return None
    kept: dict[str, DataFrame] = {}

    def once(place: int) -> DataFrame:
        atom = rule.body[place]
        if atom.predicate not in kept:
            kept[atom.predicate] = stored(facts(place, atom))
        return kept[atom.predicate]

    none = F.lit(0).cast("long").alias("v")
    a, b = side(once(left), rule.body[left], {"x": x, "k": k}), side(once(right), rule.body[right], {"k": k, "y": y})
    if a is None or b is None or a.where("x IS NULL").take(1) or b.where("y IS NULL").take(1):
        return None
    body = Body(spark, rule, None)
    body.frame, body.bound = products.product(a.select("x", "k", none), b.select("k", "y", none), "count").select(F.col("x").alias(column(x)), F.col("y").alias(column(y)), F.col("value").alias("_number")), {x, y}
    for c in body.waiting:
        body.frame = body.frame.where(compared(c))
    for place, atom in body.negated:
        body.subtract(atom, once(place))
    schema = [once(p).schema[f"c{rule.body[p].terms.index(v)}"].dataType for p, v in ((left, x), (right, y))]
    return body.frame.select(value(x).cast(schema[0]).alias("c0"), value(y).cast(schema[1]).alias("c1"), F.col("_number").alias("c2"))


def added(rule: Rule, facts: Facts) -> DataFrame | None:
    """The best values (mmin, mmax) of a rule that adds the values of two literals which share a variable, as a product; None
    if the rule isn't of this form."""
    last = rule.head.terms[-1] if rule.head.terms else None
    if not isinstance(last, Aggregate) or last.function not in ("mmin", "mmax") or (pair := paired(rule)) is None:
        return None
    left, right, k = pair
    (x, y), rest = rule.head.terms[:2], [c for c in rule.body if not isinstance(c, Atom) or c.negated]
    if len(rest) != 1 or not isinstance(rest[0], Comparison) or rest[0].sign != "=":
        return None
    for total, terms in ((rest[0].left, rest[0].right), (rest[0].right, rest[0].left)):
        if total == last.over and isinstance(terms, Arithmetic) and terms.sign == "+" and isinstance(terms.left, Variable) and isinstance(terms.right, Variable):
            values = {p: [v for v in (terms.left, terms.right) if v in bound_by(rule.body[p]) - {x, y, k}] for p in (left, right)}
            if total in bound_by(rule.body[left]) | bound_by(rule.body[right]) or any(len(v) != 1 for v in values.values()):
                continue
            frames = [facts(p, rule.body[p]) for p in (left, right)]
            if any(not isinstance(f.schema[f"c{rule.body[p].terms.index(values[p][0])}"].dataType, T.LongType) for f, p in zip(frames, (left, right), strict=True)):
                continue
            a, b = side(frames[0], rule.body[left], {"x": x, "k": k, "v": values[left][0]}), side(frames[1], rule.body[right], {"k": k, "y": y, "v": values[right][0]})
            if a is None or b is None or a.where("x IS NULL").take(1) or b.where("y IS NULL").take(1):
                continue
            # a sum with null is null, which is no best value
            a, b = a.where("v IS NOT NULL"), b.where("v IS NOT NULL")
            return products.product(a, b, last.function[1:]).select(F.col("x").alias("c0"), F.col("y").alias("c1"), F.col("value").alias("c2"))
    return None


def evaluate(spark: SparkSession, rule: Rule, facts: Facts, first: int | None = None, join_hint: str | None = None) -> DataFrame:
    """The rows that a rule derives, as columns c0, c1, ...; not made distinct unless it aggregates.

    first: the place in the body of the literal to start from (a recursion's new facts)."""
    body = Body(spark, rule, join_hint)
    order = sorted(body.atoms, key=lambda x: x[0] != first)
    if order:
        k, atom = order[0]
        body.add(k, atom, facts(k, atom), False)
    else:
        body.frame = spark.range(1).select(F.lit(1).alias("_row"))
        body.settle()
    while body.atoms:
        k, atom = body.next_atom()
        body.add(k, atom, facts(k, atom), True)
    for k, atom in body.negated:
        body.subtract(atom, facts(k, atom))
    if body.waiting:
        raise DatalogError(f"comparisons of a rule of {rule.head.predicate} have unbound variables")
    return headed(rule, body)


def headed(rule: Rule, body: Body) -> DataFrame:
    terms = rule.head.terms
    frame = body.frame
    if any(isinstance(t, Aggregate) and not t.monotonic for t in terms):
        return aggregated(rule, frame)
    columns: list[Column] = []
    for k, t in enumerate(terms):
        if isinstance(t, Aggregate):
            columns += [value(v).alias(f"k{i}") for i, v in enumerate(t.key)]
            t = t.over
        columns.append(value(t).alias(f"c{k}"))
    if body.sorts:
        keys = [F.col(column(v)).asc() if up else F.col(column(v)).desc() for s in body.sorts for v, up in s.keys]
        shown = [F.col(column(v)) for s in body.sorts for v, _ in s.keys]
        rows = frame.select(*columns, *(c.alias(f"s{i}") for i, c in enumerate(shown))).distinct()
        return rows.orderBy(*(F.col(f"s{i}").asc() if up else F.col(f"s{i}").desc() for i, (_, up) in enumerate(p for s in body.sorts for p in s.keys))).select(*(f"c{k}" for k in range(len(terms)))) if keys else rows
    return frame.select(*columns)


def aggregated(rule: Rule, frame: DataFrame) -> DataFrame:
    """Over the body's rows as they are; the other arguments of the head are the groups. No rows give no result."""

    def result(t: Aggregate) -> Column:
        over = F.lit(1) if t.over.anonymous else value(t.over)
        return {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "countd": F.count_distinct, "avg": F.avg}[t.function](over)

    terms = rule.head.terms
    keys = [value(t).alias(f"c{k}") for k, t in enumerate(terms) if not isinstance(t, Aggregate)]
    made = [result(t).alias(f"c{k}") for k, t in enumerate(terms) if isinstance(t, Aggregate)]
    grouped = frame.groupBy(*keys).agg(*made) if keys else frame.agg(*made, F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
    return grouped.select(*(f"c{k}" for k in range(len(terms))))
