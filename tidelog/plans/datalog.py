"""Datalog queries over relations derived from the test tables, with the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.datalog import DatalogSession

#: Relations as SQL that both engines read. DIV is written as // for DuckDB.
RELATIONS = {
    "part_arc": "SELECT DISTINCT CAST(p_partkey DIV 2 AS BIGINT) AS a, CAST(p_partkey AS BIGINT) AS b FROM part WHERE p_partkey >= 1",
    "order_arc": "SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) q WHERE b IS NOT NULL",
    "supp_arc": "SELECT x.l_suppkey AS a, y.l_suppkey AS b, CAST(min(y.l_quantity) AS BIGINT) AS cost FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 GROUP BY x.l_suppkey, y.l_suppkey",
    "nation_arc": "SELECT CAST(s_nationkey AS BIGINT) AS a, CAST(c_nationkey AS BIGINT) AS b, CAST(floor(min(l_extendedprice)) AS BIGINT) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, c_nationkey",
    "supp_tree": "SELECT CAST(s_suppkey DIV 2 AS BIGINT) AS a, CAST(s_suppkey AS BIGINT) AS b FROM supplier WHERE s_suppkey >= 1",
    "sponsor": "SELECT CAST(c_custkey DIV 3 AS BIGINT) AS m, c_custkey AS nm FROM customer WHERE c_custkey >= 1",
    "sales": "SELECT o_custkey AS m, CAST(floor(o_totalprice) AS BIGINT) AS s, CAST(o_orderkey % 97 AS BIGINT) AS p FROM orders",
    "schedule": "SELECT * FROM (VALUES (0, 300000, 1), (300000, 3000000, 2), (3000000, 30000000, 3), (30000000, 2000000000, 4)) AS t(ls, rs, bp)",
    "pages9": "SELECT p_partkey AS x, p_size AS w2, p_size AS w3, p_size AS w4, p_size AS w5, p_size AS w6, p_size AS w7, p_size AS w8, p_size + 1 AS w9 FROM part",
    "organizer": "SELECT s_suppkey AS x FROM supplier WHERE s_suppkey % 7 = 0",
}
TYPES = {"a": "long", "b": "long", "cost": "long", "m": "long", "nm": "long", "s": "long", "p": "long", "ls": "long", "rs": "long", "bp": "long", "x": "long"} | {f"w{k}": "integer" for k in range(2, 10)}
COLUMNS = {"part_arc": "a b", "order_arc": "a b", "supp_arc": "a b cost", "nation_arc": "a b cost", "supp_tree": "a b", "sponsor": "m nm", "sales": "m s p", "schedule": "ls rs bp", "pages9": "x w2 w3 w4 w5 w6 w7 w8 w9", "organizer": "x"}

#: name: relations, rules and query. The programs that the survey's query set names. Those whose result grows
#: with a power of the graph run over the trade of nations (25 nodes) or a tree of suppliers, whole as well.
PROGRAMS: dict[str, tuple[str, str, str]] = {
    "tc_ll": ("part_arc", "tc(A,B) <- part_arc(A,B). tc(A,B) <- tc(A,C), part_arc(C,B).", "tc(A,B)."),
    "tc_rl": ("part_arc", "tc(A,B) <- part_arc(A,B). tc(A,B) <- part_arc(A,C), tc(C,B).", "tc(A,B)."),
    "tc_nl": ("order_arc", "tc(A,B) <- order_arc(A,B). tc(A,B) <- tc(A,C), tc(C,B).", "tc(A,B)."),
    "tc_reflexive": ("part_arc", "p(A,A) <- part_arc(A,_). p(A,B) <- p(A,C), part_arc(C,B).", "p(A,B)."),
    "tc_bf": ("part_arc", "tc(A,B) <- part_arc(A,B). tc(A,B) <- tc(A,C), part_arc(C,B).", "tc(3,B)."),
    "tc_fff": ("nation_arc", "tc(A,B,B) <- nation_arc(A,B,_). tc(B,C,D) <- tc(A,B,C), nation_arc(C,D,_).", "tc(A,B,C)."),
    "reach": ("supp_arc", "reach(B) <- B=1. reach(B) <- reach(A), supp_arc(A,B,_).", "reach(A)."),
    "sg": ("supp_tree", "sg(X,Y) <- supp_tree(P,X), supp_tree(P,Y), X ~= Y. sg(X,Y) <- supp_tree(A,X), sg(A,B), supp_tree(B,Y).", "sg(A,B)."),
    "mutual_three": ("nation_arc", "three(A,B,C) <- nation_arc(A,B,_), nation_arc(B,C,_). three(A,B,D) <- three2(A,B,C), nation_arc(C,D,_). three2(A,B,D) <- three(A,B,C), nation_arc(C,D,_).", "three(A,B,C)."),
    "apsp_ll": ("nation_arc", "sp(A,B,min<C>) <- m(A,B,C). m(A,B,mmin<C>) <- nation_arc(A,B,C). m(A,B,mmin<D>) <- m(A,C,D1), nation_arc(C,B,D2), D=D1+D2.", "sp(A,B,C)."),
    "apsp_nl": ("nation_arc", "sp(A,B,min<C>) <- m(A,B,C). m(A,B,mmin<C>) <- nation_arc(A,B,C). m(A,B,mmin<D>) <- m(A,C,D1), m(C,B,D2), D=D1+D2.", "sp(A,B,C)."),
    "apsp_suppliers": ("supp_arc", "sp(A,B,min<C>) <- m(A,B,C). m(A,B,mmin<C>) <- supp_arc(A,B,C). m(A,B,mmin<D>) <- m(A,C,D1), supp_arc(C,B,D2), D=D1+D2.", "sp(A,B,C)."),
    "sssp": ("supp_arc", "sp(B,min<C>) <- m(B,C). m(B,mmin<C>) <- B=1, C=0. m(B,mmin<D>) <- m(C,D1), supp_arc(C,B,D2), D=D1+D2.", "sp(A,B)."),
    "widest_mmax": ("supp_arc", "w(B,max<C>) <- m(B,C). m(B,mmax<C>) <- B=1, C=100. m(B,mmax<D>) <- m(C,D1), supp_arc(C,B,D2), D2 <= D1, D=D2.", "w(A,B)."),
    "ssp_ll": ("order_arc", "p(A,B,D) <- order_arc(A,B), D=1. p(A,B,D) <- p(A,C,D1), order_arc(C,B), D=D1+1. sp(A,B,min<D>) <- p(A,B,D).", "sp(A,B,C)."),
    "ssp_nl": ("part_arc", "p(A,B,D) <- part_arc(A,B), D=1. p(A,B,D) <- p(A,C,D1), p(C,B,D2), D=D1+D2. sp(A,B,min<D>) <- p(A,B,D).", "sp(A,B,C)."),
    "ssp_rl": ("part_arc", "p(A,B,D) <- part_arc(A,B), D=1. p(A,B,D) <- part_arc(A,C), p(C,B,D1), D=D1+1. sp(A,B,min<D>) <- p(A,B,D).", "sp(A,B,C)."),
    "ssp_bff": ("part_arc", "p(A,B,D) <- part_arc(A,B), D=1. p(A,B,D) <- p(A,C,D1), part_arc(C,B), D=D1+1. sp(A,B,min<D>) <- p(A,B,D).", "sp(2,B,C)."),
    "cc_labels": ("supp_arc", "cc3(X,mmin<X>) <- supp_arc(X,_,_). cc3(Y,mmin<V>) <- cc3(X,V), supp_arc(X,Y,_). cc2(X,min<Y>) <- cc3(X,Y).", "cc2(A,B)."),
    "cc_count": ("supp_arc", "cc3(X,mmin<X>) <- supp_arc(X,_,_). cc3(Y,mmin<V>) <- cc3(X,V), supp_arc(X,Y,_). cc2(X,min<Y>) <- cc3(X,Y). cc(countd<X>) <- cc2(_,X).", "cc(A)."),
    "triangle_count": ("supp_arc", "triangles(X,Y,Z) <- supp_arc(X,Y,_), X < Y, supp_arc(Y,Z,_), Y < Z, supp_arc(Z,X,_). triangle_count(count<_>) <- triangles(X,Y,Z).", "triangle_count(A)."),
    "triangle_closing": ("supp_arc", "uarc(X,Y) <- supp_arc(X,Y,_). uarc(Y,X) <- supp_arc(X,Y,_). closing(Y,Z,count<X>) <- uarc(X,Y), uarc(X,Z), Y ~= Z, ~uarc(Y,Z).", "closing(A,B,C)."),
    "triangle_closing_sorted": ("supp_arc pages9", "uarc(X,Y) <- supp_arc(X,Y,_). uarc(Y,X) <- supp_arc(X,Y,_). closing(Y,Z,count<X>) <- uarc(X,Y), uarc(X,Z), Y ~= Z, ~uarc(Y,Z). result(X,W9) <- closing(X,1,Z), pages9(X,W2,W3,W4,W5,W6,W7,W8,W9), sort((Z, asc)).", "result(A,B)."),
    "attend": ("organizer supp_arc", "cnt(Y, mcount<X>) <- attend(X), supp_arc(Y,X,_). attend(X) <- organizer(X). attend(Y) <- cnt(Y,N), N >= 2.", "attend(A)."),
    "spread_of_costs": ("supp_arc", "spread(A,max<C>,avg<C>) <- supp_arc(A,_,C).", "spread(A,B,C)."),
    "count_paths": ("part_arc", "cp(X,Y,msum<(X,C)>) <- part_arc(X,Y), C=1. cp(X,Z,msum<(Y,C)>) <- cp(X,Y,C), part_arc(Y,Z).", "cp(A,B,C)."),
}
#: The ten rules of the multi-level marketing program.
MLM = """member_sales(M, sum<S>) <- sales(M, S, _).
network_tc(M, M) <- sponsor(M, _). network_tc(M, M) <- sponsor(_, M). network_tc(M, M2) <- network_tc(M, M1), sponsor(M1, M2).
member_total_sales(M, sum<S>) <- network_tc(M, NM), member_sales(NM, S).
member_bonus_self(M, B) <- member_sales(M, ST), member_total_sales(M, S), schedule(LS, RS, BP), S >= LS, S < RS, B = ST * BP.
member_bonus_frontline(M, sum<B>) <- sponsor(M, NM), member_total_sales(NM, S), schedule(LS, RS, BP), S >= LS, S < RS, B = S * BP.
bonus(sum<B>) <- member_bonus_self(M,B1), member_bonus_frontline(M,B2), B=B1+B2.
gross_profit(sum<P>) <- sales(_, _, P). net_profit(NP) <- gross_profit(P), bonus(B), NP = P - B."""
for _name, _arity in (("network_tc", 2), ("member_sales", 2), ("member_total_sales", 2), ("member_bonus_self", 2), ("member_bonus_frontline", 2), ("bonus", 1), ("gross_profit", 1), ("net_profit", 1)):
    PROGRAMS[f"mlm_{_name}"] = ("sponsor sales schedule", MLM, f"{_name}({'A,B' if _arity == 2 else 'A'}).")

def session(spark: SparkSession, sf_dir: str, names: str) -> DatalogSession:
    """A session with these relations declared and filled."""
    for table in ("part", "orders", "lineitem", "customer", "supplier"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    datalog = DatalogSession(spark)
    for name in names.split():
        declared = ", ".join(f"{c}: {TYPES[c]}" for c in COLUMNS[name].split())
        datalog.load_program(f"database({{{name}({declared})}}).")
        datalog.register(name, spark.sql(RELATIONS[name]))
    return datalog


def runner(names: str, rules: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        datalog = session(spark, sf_dir, names)
        datalog.load_program(rules)
        return datalog.query(query).to_df()

    return run


QUERIES = {name: runner(*program) for name, program in PROGRAMS.items()}


def with_relations(names: str, rest: str) -> str:
    return "WITH RECURSIVE " + ", ".join([*(f"{n} AS ({RELATIONS[n].replace(' DIV ', ' // ')})" for n in names.split()), rest])


def closure(arc: str, start: str = "SELECT a, b FROM {arc}", out: str = "SELECT a, b FROM tc") -> str:
    return with_relations(arc, f"tc AS ({start.format(arc=arc)} UNION SELECT t.a, r.b FROM tc t JOIN {arc} r ON t.b = r.a) {out}")


def hops(arc: str, where: str = "") -> str:
    return with_relations(arc, f"p AS (SELECT a, b, 1::BIGINT AS c FROM {arc} UNION SELECT p.a, r.b, p.c + 1 FROM p JOIN {arc} r ON p.b = r.a) SELECT a, b, min(c) AS c FROM p {where} GROUP BY a, b")


def apsp(arc: str) -> str:
    return with_relations(arc, f"m(a, b, c) USING KEY (a, b) AS (SELECT a, b, cost FROM {arc} UNION SELECT q.a, q.b, q.c FROM (SELECT m.a, r.b, min(m.c + r.cost) AS c FROM m JOIN {arc} r ON m.b = r.a GROUP BY m.a, r.b) q LEFT JOIN recurring.m o ON o.a = q.a AND o.b = q.b WHERE o.c IS NULL OR q.c < o.c) SELECT a, b, c::BIGINT AS c FROM m")


SSSP = with_relations("supp_arc", "m(a, b) USING KEY (a) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT q.a, q.b FROM (SELECT r.b AS a, min(m.b + r.cost) AS b FROM m JOIN supp_arc r ON m.a = r.a GROUP BY r.b) q LEFT JOIN recurring.m o ON o.a = q.a WHERE o.b IS NULL OR q.b < o.b) SELECT a, b::BIGINT AS b FROM m")
CC = "m(a, b) USING KEY (a) AS (SELECT DISTINCT a, a FROM supp_arc UNION SELECT q.a, q.b FROM (SELECT r.b AS a, min(m.b) AS b FROM m JOIN supp_arc r ON m.a = r.a GROUP BY r.b) q LEFT JOIN recurring.m o ON o.a = q.a WHERE o.b IS NULL OR q.b < o.b)"
UARC = "uarc AS (SELECT a, b FROM supp_arc UNION SELECT b, a FROM supp_arc), closing AS (SELECT x.b AS a, y.b AS b, count(*) AS c FROM uarc x JOIN uarc y ON x.a = y.a AND x.b <> y.b WHERE NOT EXISTS (SELECT 1 FROM uarc u WHERE u.a = x.b AND u.b = y.b) GROUP BY 1, 2)"
MLM_SQL = """member_sales AS (SELECT m AS a, sum(s)::BIGINT AS b FROM sales GROUP BY m),
network_tc AS (SELECT m AS a, m AS b FROM sponsor UNION SELECT nm, nm FROM sponsor UNION SELECT t.a, r.nm FROM network_tc t JOIN sponsor r ON t.b = r.m),
member_total_sales AS (SELECT t.a, sum(s.b)::BIGINT AS b FROM network_tc t JOIN member_sales s ON t.b = s.a GROUP BY t.a),
member_bonus_self AS (SELECT DISTINCT s.a, s.b * bp AS b FROM member_sales s JOIN member_total_sales t ON s.a = t.a JOIN schedule ON t.b >= ls AND t.b < rs),
member_bonus_frontline AS (SELECT m AS a, sum(t.b * bp)::BIGINT AS b FROM sponsor JOIN member_total_sales t ON nm = t.a JOIN schedule ON t.b >= ls AND t.b < rs GROUP BY m),
bonus AS (SELECT sum(x.b + y.b)::BIGINT AS a FROM member_bonus_self x JOIN member_bonus_frontline y ON x.a = y.a),
gross_profit AS (SELECT sum(p)::BIGINT AS a FROM sales), net_profit AS (SELECT g.a - b.a AS a FROM gross_profit g, bonus b)"""

SQL = {
    "tc_ll": closure("part_arc"),
    "tc_rl": closure("part_arc"),
    "tc_nl": closure("order_arc"),
    "tc_reflexive": closure("part_arc", "SELECT DISTINCT a, a AS b FROM {arc}"),
    "tc_bf": closure("part_arc", out="SELECT a AS c0, b FROM tc WHERE a = 3"),
    "tc_fff": with_relations("nation_arc", "tc AS (SELECT a, b, b AS c FROM nation_arc UNION SELECT t.b, t.c, r.b FROM tc t JOIN nation_arc r ON t.c = r.a) SELECT a, b, c FROM tc"),
    "reach": with_relations("supp_arc", "tc AS (SELECT 1::BIGINT AS a UNION SELECT r.b FROM tc t JOIN supp_arc r ON t.a = r.a) SELECT a FROM tc"),
    "sg": with_relations("supp_tree", "sg AS (SELECT x.b AS a, y.b AS b FROM supp_tree x JOIN supp_tree y ON x.a = y.a AND x.b <> y.b UNION SELECT x.b, y.b FROM sg JOIN supp_tree x ON x.a = sg.a JOIN supp_tree y ON y.a = sg.b) SELECT a, b FROM sg"),
    "mutual_three": with_relations("nation_arc", "t AS (SELECT x.a, x.b, y.b AS c, 0 AS k FROM nation_arc x JOIN nation_arc y ON x.b = y.a UNION SELECT t.a, t.b, r.b, 1 - k FROM t JOIN nation_arc r ON t.c = r.a) SELECT DISTINCT a, b, c FROM t WHERE k = 0"),
    "apsp_ll": apsp("nation_arc"),
    "apsp_nl": apsp("nation_arc"),
    "apsp_suppliers": apsp("supp_arc"),
    "spread_of_costs": with_relations("supp_arc", "s AS (SELECT a, max(cost) AS b, avg(cost)::DOUBLE AS c FROM supp_arc GROUP BY a) SELECT a, b, c FROM s"),
    "attend": with_relations("organizer supp_arc", "t(x) USING KEY (x) AS (SELECT x FROM organizer UNION SELECT q.x FROM (SELECT a AS x FROM supp_arc JOIN recurring.t o ON o.x = b GROUP BY a HAVING count(DISTINCT b) >= 2) q WHERE q.x NOT IN (SELECT x FROM recurring.t)) SELECT x AS a FROM t"),
    "sssp": SSSP,
    "widest_mmax": with_relations("supp_arc", "m(a, b) USING KEY (a) AS (SELECT 1::BIGINT, 100::BIGINT UNION SELECT q.a, q.b FROM (SELECT r.b AS a, max(r.cost) AS b FROM m JOIN supp_arc r ON m.a = r.a AND r.cost <= m.b GROUP BY r.b) q LEFT JOIN recurring.m o ON o.a = q.a WHERE o.b IS NULL OR q.b > o.b) SELECT a, b::BIGINT AS b FROM m"),
    "ssp_ll": hops("order_arc"),
    "ssp_nl": hops("part_arc"),
    "ssp_rl": hops("part_arc"),
    "ssp_bff": with_relations("part_arc", "p AS (SELECT a, b, 1::BIGINT AS c FROM part_arc UNION SELECT p.a, r.b, p.c + 1 FROM p JOIN part_arc r ON p.b = r.a) SELECT a AS c0, b, min(c) AS c FROM p WHERE a = 2 GROUP BY a, b"),
    "cc_labels": with_relations("supp_arc", CC + " SELECT a, b FROM m"),
    "cc_count": with_relations("supp_arc", CC + " SELECT count(DISTINCT b) AS a FROM m HAVING count(*) > 0"),
    "triangle_count": with_relations("supp_arc", "t AS (SELECT count(*) AS a FROM supp_arc x JOIN supp_arc y ON x.b = y.a AND x.a < x.b AND y.a < y.b JOIN supp_arc z ON y.b = z.a AND z.b = x.a) SELECT a FROM t WHERE a > 0"),
    "triangle_closing": with_relations("supp_arc", UARC + " SELECT a, b, c FROM closing"),
    "triangle_closing_sorted": with_relations("supp_arc pages9", UARC + " SELECT DISTINCT c.a AS a, w9 AS b FROM closing c JOIN pages9 ON c.a = x WHERE c.b = 1"),
    "count_paths": with_relations("part_arc", "p AS (SELECT a, b, 1::BIGINT AS c FROM part_arc UNION ALL SELECT p.a, r.b, p.c FROM p JOIN part_arc r ON p.b = r.a) SELECT a, b, sum(c)::BIGINT AS c FROM p GROUP BY a, b"),
} | {name: with_relations("sponsor sales schedule", f"{MLM_SQL} SELECT * FROM {name[4:]}") for name in PROGRAMS if name.startswith("mlm_")}

