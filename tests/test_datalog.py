from __future__ import annotations

import heapq
import random

import pytest

from tidelog.datalog import DatalogSession
from tidelog.datalog.fixpoint import Options
from tidelog.datalog.syntax import DatalogError, parse_program, parse_query

# fixed values: the graphs of the survey's test programs, and the counts below that their results must have
GRAPH1 = ["0,1", "1,2", "2,3", "3,4", "4,5", "0,6", "6,7", "7,8", "8,9", "9,10"]
GRAPH1W = [f"{e},1" for e in GRAPH1]
GRAPH1B = [*GRAPH1W, "0,2,10"]
GRAPH2 = ["1,0", "1,2", "2,3", "3,1", "3,4", "3,5", "5,8", "6,5", "6,7", "6,0"]
GRAPH3 = ["0,1", "0,2", "1,3", "1,4", "2,5", "2,6", "3,7", "3,8", "4,9", "4,10", "5,11", "5,12", " 6,13", "6,14"]
GRAPH4 = ["0,1,10", "0,1,9", "0,1,8", "0,1,7", "0,2,1", "2,1,1", "2,1,2"]
GRAPH6 = ["0,1", "0,2", "0,3", "1,2", "1,3", "2,4", "3,4", "4,5", "4,6", "4,7", "6,7"]
GRAPH7 = ["0,1", "0,2", "2,1", "1,3", "3,1", "1,0"]
ARC = "database({arc(From: integer, To: integer)})."
WEIGHTED = "database({arc(From: integer, To: integer, Cost: integer)})."
TC = {
    "LL": "tc(A,B) <- arc(A,B). tc(A,B) <- tc(A,C), arc(C,B).",
    "RL": "tc(A,B) <- arc(A,B). tc(A,B) <- arc(A,C), tc(C,B).",
    "NL": "tc(A,B) <- arc(A,B). tc(A,B) <- tc(A,C), tc(C,B).",
}


def closure(edges):
    pairs = {tuple(int(x) for x in e.split(",")[:2]) for e in edges}
    while True:
        more = pairs | {(a, d) for a, b in pairs for c, d in pairs if b == c}
        if more == pairs:
            return pairs
        pairs = more


def run(spark, program, query, options=None, **facts):
    session = DatalogSession(spark, options)
    session.load_program(program)
    for name, data in facts.items():
        session.register(name, data)
    return sorted(tuple(r) for r in session.query(query).collect())


@pytest.mark.parametrize("kind", TC)
def test_transitive_closure(spark, kind):
    assert run(spark, ARC + TC[kind], "tc(A,B).", arc=GRAPH1) == sorted(closure(GRAPH1))
    found = run(spark, ARC + TC[kind], "tc(A,B)", arc=GRAPH2)
    assert found == sorted(closure(GRAPH2)) and len(found) == 26


def test_reflexive_exit(spark):
    program = ARC + "p(A,A) <- arc(A,_). p(A,B) <- p(A,C), arc(C,B)."
    assert len(run(spark, program, "p(A,B).", arc=GRAPH1)) == 39
    assert len(run(spark, program, "p(A,B).", arc=GRAPH2)) == 28


@pytest.mark.parametrize("kind", TC)
def test_bound_query_is_the_filtered_free_one(spark, kind):
    for start, graph, n in ((0, GRAPH1, 10), (3, GRAPH2, 7)):
        found = run(spark, ARC + TC[kind], f"tc({start}, B).", arc=graph)
        assert found == [p for p in sorted(closure(graph)) if p[0] == start] and len(found) == n


def test_bound_argument_is_pushed_into_the_exit_rule(spark):
    session = DatalogSession(spark)
    session.load_program(ARC + TC["LL"])
    session.register("arc", GRAPH1)
    query = session.query("tc(6, B).")
    assert query.count() == 4
    assert sum(r.new["tc"] for r in query.rounds["tc"]) == 4
    assert "bound {0: 6}" in query.explain()


def test_three_arguments_and_a_repeated_head_variable(spark):
    program = ARC + "tc(A,B,B) <- arc(A,B). tc(B,C,D) <- tc(A,B,C), arc(C,D)."
    assert len(run(spark, program, "tc(A,B,C).", arc=GRAPH7)) == 22


def test_reach(spark):
    program = ARC + "reach(B) <- B=%d. reach(B) <- reach(A), arc(A,B)."
    assert len(run(spark, program % 0, "reach(A).", arc=GRAPH1)) == 11
    assert len(run(spark, program % 1, "reach(A).", arc=GRAPH2)) == 7


def test_mutual_recursion_without_an_exit_rule(spark):
    program = ARC + "three(A,B,C) <- arc(A,B), arc(B,C). three(A,B,D) <- three2(A,B,C), arc(C,D). three2(A,B,D) <- three(A,B,C), arc(C,D)."
    assert len(run(spark, program, "three(A,B,C).", arc=GRAPH1)) == 12
    assert len(run(spark, program, "three(A,B,C).", arc=GRAPH2)) == 23


def test_same_generation(spark):
    program = "database({parent_child(Parent: integer, Child: integer)}). sg(X,Y) <- parent_child(P,X), parent_child(P,Y), X ~= Y. sg(X,Y) <- parent_child(A,X), sg(A,B), parent_child(B,Y)."
    one = ["4,9", "4,8", "6,7", "5,6", "3,5", "3,4", "2,3", "1,2"]
    two = ["-4,-5", "-3,-4", "-2,-3", "-1,-2", "0,-1", "0,1", "1,2", "2,3", "3,4", "4,5"]
    assert run(spark, program, "sg(A,B).", parent_child=one) == sorted([(8, 9), (9, 6), (6, 9), (9, 8), (8, 6), (5, 4), (4, 5), (6, 8)])
    assert len(run(spark, program, "sg(A,B).", parent_child=two)) == 10


def shortest(edges):
    graph, nodes = {}, set()
    for e in edges:
        a, b, d = (int(x) for x in e.split(",")[:3])
        graph.setdefault(a, []).append((b, d))
        nodes |= {a, b}
    found = {}
    for s in nodes:
        heap, done = [(d, b) for b, d in graph.get(s, [])], {}
        heapq.heapify(heap)
        while heap:
            d, b = heapq.heappop(heap)
            if b not in done:
                done[b] = d
                for c, w in graph.get(b, []):
                    heapq.heappush(heap, (d + w, c))
        found |= {(s, b): d for b, d in done.items()}
    return sorted((a, b, d) for (a, b), d in found.items())


APSP = {
    "LL": "sp(A,B,min<C>) <- m(A,B,C). m(A,B,mmin<C>) <- arc(A,B,C). m(A,B,mmin<D>) <- m(A,C,D1), arc(C,B,D2), D=D1+D2.",
    "NL": "sp(A,B,min<C>) <- m(A,B,C). m(A,B,mmin<C>) <- arc(A,B,C). m(A,B,mmin<D>) <- m(A,C,D1), m(C,B,D2), D=D1+D2.",
}


@pytest.mark.parametrize("kind", APSP)
def test_all_pairs_shortest_paths(spark, kind):
    for graph, n in ((GRAPH1B, 30), ([f"{e},1" for e in GRAPH3], 34), (GRAPH4, 3), (["0,1,1", "0,2,1", "1,2,1"], 3)):
        found = run(spark, WEIGHTED + APSP[kind], "sp(A,B,C).", arc=graph)
        assert found == shortest(graph) and len(found) == n


def test_single_source_shortest_paths(spark):
    program = WEIGHTED + "sp(B,min<C>) <- m(B,C). m(B,mmin<C>) <- B=%d, C=0. m(B,mmin<D>) <- m(C,D1), arc(C,B,D2), D=D1+D2."
    for start, graph, n in ((0, GRAPH1B, 11), (1, [f"{e},1" for e in GRAPH3], 7), (0, GRAPH4, 3)):
        found = run(spark, program % start, "sp(A,B).", arc=graph)
        assert found == sorted([(start, 0), *((b, d) for a, b, d in shortest(graph) if a == start)]) and len(found) == n


@pytest.mark.parametrize("rule", ["p(A,B,D) <- p(A,C,D1), arc(C,B,D2), D=D1+D2.", "p(A,B,D) <- p(A,C,D1), p(C,B,D2), D=D1+D2.", "p(A,B,D) <- arc(A,C,D1), p(C,B,D2), D=D1+D2."])
def test_stratified_shortest_paths(spark, rule):
    program = WEIGHTED + "p(A,B,D) <- arc(A,B,D)." + rule + "sp(A,B,min<D>) <- p(A,B,D)."
    assert run(spark, program, "sp(A,B,C).", arc=GRAPH1B) == shortest(GRAPH1B)
    assert run(spark, program, "sp(0,B,C).", arc=GRAPH1B) == [r for r in shortest(GRAPH1B) if r[0] == 0]


def test_connected_components(spark):
    program = ARC + "cc3(X,mmin<X>) <- arc(X,_). cc3(Y,mmin<V>) <- cc3(X,V), arc(X,Y). cc2(X,min<Y>) <- cc3(X,Y). cc(countd<X>) <- cc2(_,X)."
    assert run(spark, program, "cc(A).", arc=[*GRAPH1, "0,2"]) == [(1,)]


def test_multi_level_marketing(spark):
    program = """database({sponsor(M:integer, NM:integer), sales(M:integer, S:float, P:float), schedule(LS:float, RS:float, BP:float)}).
    member_sales(M, sum<S>) <- sales(M, S, _).
    network_tc(M, M) <- sponsor(M, _). network_tc(M, M) <- sponsor(_, M). network_tc(M, M2) <- network_tc(M, M1), sponsor(M1, M2).
    member_total_sales(M, sum<S>) <- network_tc(M, NM), member_sales(NM, S).
    member_bonus_self(M, B) <- member_sales(M, ST), member_total_sales(M, S), schedule(LS, RS, BP), S >= LS, S < RS, B = ST * BP.
    member_bonus_frontline(M, sum<B>) <- sponsor(M, NM), member_total_sales(NM, S), schedule(LS, RS, BP), S >= LS, S < RS, B = S * BP.
    bonus(sum<B>) <- member_bonus_self(M,B1), member_bonus_frontline(M,B2), B=B1+B2.
    gross_profit(sum<P>) <- sales(_, _, P). net_profit(NP) <- gross_profit(P), bonus(B), NP = P - B."""
    facts = {
        "sponsor": ["1,2", "1,3", "2,4"],
        "sales": ["1,10,5", "1,20,5", "2,10,2", "2,10,5", "1,100,10", "3,9,4", "3,10,3", "2,19,8", "4,89,9", "4,5,1", "5,10,4", "5,75,25", "5,32,9", "1,49,20"],
        "schedule": ["100,299,0.03", "300,599,0.06", "600,999,0.09", "1000,1499,0.12", "1500,2499,0.15", "2500,3999,0.18", "4000,5999,0.21", "6000,7499,0.23", "7500,100000000,0.25"],
    }
    assert run(spark, program, "network_tc(A,B)", **facts) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 4), (3, 3), (4, 4)]
    assert run(spark, program, "member_sales(A,B)", **facts) == [(1, 179.0), (2, 39.0), (3, 19.0), (4, 94.0), (5, 117.0)]
    assert run(spark, program, "member_total_sales(A,B)", **facts) == [(1, 331.0), (2, 133.0), (3, 19.0), (4, 94.0)]
    assert run(spark, program, "member_bonus_self(A,B)", **facts) == [(1, 10.739999759942293), (2, 1.169999973848462)]
    assert run(spark, program, "member_bonus_frontline(A,B)", **facts) == [(1, pytest.approx(3.9899999108165503))]
    assert run(spark, program, "gross_profit(A)", **facts) == [(110.0,)]
    # the join on M, not the cross product
    assert run(spark, program, "bonus(A)", **facts) == [(pytest.approx(14.729999670758843),)]
    assert run(spark, program, "net_profit(A)", **facts) == [(pytest.approx(95.27000032924116),)]


def test_triangles(spark):
    arcs = ["1,2", "2,3", "3,1", "3,4", "4,5", "5,3"]
    count = ARC + "triangles(X,Y,Z) <- arc(X,Y), X < Y, arc(Y,Z), Y < Z, arc(Z,X). triangle_count(count<_>) <- triangles(X,Y,Z)."
    assert run(spark, count, "triangle_count(A).", arc=arcs) == [(2,)]
    assert run(spark, count, "triangle_count(A).", arc=["1,2"]) == []
    closing = ARC + "uarc(X,Y) <- arc(X,Y). uarc(Y,X) <- arc(X,Y). closing(Y,Z,count<X>) <- uarc(X,Y), uarc(X,Z), Y ~= Z, ~uarc(Y,Z)."
    assert run(spark, closing, "closing(A,B,C).", arc=arcs) == sorted([(1, 4, 1), (4, 1, 1), (1, 5, 1), (5, 1, 1), (2, 4, 1), (4, 2, 1), (2, 5, 1), (5, 2, 1)])


def test_sort(spark):
    session = DatalogSession(spark)
    session.load_program(ARC + "top(A, B) <- arc(A, B), sort((B, desc)).")
    session.register("arc", GRAPH1)
    assert [r[1] for r in session.query("top(A,B).").collect()] == [10, 9, 8, 7, 6, 5, 4, 3, 2, 1]


def test_attend_and_count_paths(spark):
    attend = "database({organizer(X: integer), arc(X: integer, Y: integer)}). cntfriends(Y, mcount<X>) <- attend(X), arc(Y,X). attend(X) <- organizer(X). attend(Y) <- cntfriends(Y,N), N >= 3."
    assert run(spark, attend, "attend(A).", organizer=["0", "1", "2"], arc=["3,0", "3,1", "3,2", "4,3", "4,0", "4,1", "5,4", "5,0"]) == [(0,), (1,), (2,), (3,), (4,)]
    paths = ARC + "cp(X,Y,msum<(X,C)>) <- arc(X,Y), C=1. cp(X,Z,msum<(Y,C)>) <- cp(X,Y,C), arc(Y,Z)."
    found = {r[:2]: r[2] for r in run(spark, paths, "cp(A,B,C).", arc=GRAPH6)}
    assert found[0, 7] == 8 and found[0, 4] == 4 and found[1, 7] == 4 and len(found) == 25


@pytest.mark.parametrize("join_type", ["broadcast", "shuffle", "sortmerge"])
def test_options_give_the_same_facts(spark, join_type):
    options = Options(join_type=join_type, partitions=3, compact_every=2, cache_build_side=True, collect_stats=True, use_partial=False, union_distinct=False)
    assert run(spark, ARC + TC["LL"], "tc(A,B).", options, arc=GRAPH2) == sorted(closure(GRAPH2))
    assert run(spark, WEIGHTED + APSP["LL"], "sp(A,B,C).", options, arc=GRAPH1B) == shortest(GRAPH1B)


@pytest.mark.parametrize("options", [Options(broadcast_rows=0), Options(compact_every=1), Options(broadcast_rows=0, compact_every=1)])
def test_facts_in_place_or_not(spark, options):
    assert run(spark, ARC + TC["RL"], "tc(A,B).", options, arc=GRAPH2) == sorted(closure(GRAPH2))
    assert run(spark, WEIGHTED + APSP["LL"], "sp(A,B,C).", options, arc=GRAPH1B) == shortest(GRAPH1B)


def test_random_graphs(spark):
    rng = random.Random(3)
    for _ in range(2):
        edges = [f"{rng.randrange(9)},{rng.randrange(9)}" for _ in range(14)]
        expected = sorted(closure(edges))
        assert all(run(spark, ARC + TC[k], "tc(A,B).", arc=edges) == expected for k in TC)


def test_types_widen_in_recursion(spark):
    program = "database({arc(A: integer, B: integer, D: double)}). m(B,mmin<C>) <- B=0, C=0. m(B,mmin<D>) <- m(A,D1), arc(A,B,D2), D=D1+D2."
    assert run(spark, program, "m(A,B).", arc=["0,1,0.5", "1,2,0.25"]) == [(0, 0.0), (1, 0.5), (2, 0.75)]


def test_strings_constants_and_facts(spark):
    program = "database({p(Name: string, N: integer)}). likes(ann, bob). q(X) <- p(X, 2). q(X) <- likes(X, 'bob'). r(N) <- p(_, M), N = (M + 1) * 2 - M. % a comment"
    assert run(spark, program, "q(X).", p=["zoe, 2", "% no", "", "tim, 3"]) == [("ann",), ("zoe",)]
    assert run(spark, program, "r(N).", p=["zoe, 2", "tim, 3"]) == [(4,), (5,)]


def test_nulls_and_empty_relations(spark):
    frame = spark.createDataFrame([(1, None), (None, 2), (1, 2), (1, 2)], "a int, b int")
    assert sorted(map(str, run_rows(spark, ARC + TC["LL"], frame))) == sorted(map(str, [(1, None), (None, 2), (1, 2)]))
    assert run(spark, ARC + TC["LL"], "tc(A,B).", arc=[]) == []


def run_rows(spark, program, frame):
    session = DatalogSession(spark)
    session.load_program(program)
    session.register("arc", frame)
    return [tuple(r) for r in session.query("tc(A,B).").collect()]


def test_files(spark, tmp_path):
    (tmp_path / "arc.csv").write_text("% arcs\n1, 2\n\n2,3,9\n")
    (tmp_path / "arc.txt").write_text("1\t2\n2\t3\n")
    (tmp_path / "tc.dl").write_text(ARC + TC["LL"])
    for name in ("arc.csv", "arc.txt"):
        session = DatalogSession(spark)
        session.load_file(str(tmp_path / "tc.dl"))
        session.register("arc", str(tmp_path / name))
        assert session.query("tc(A,B).").count() == 3
        assert spark.table("arc").columns == ["From", "To"]
    (tmp_path / "bad.csv").write_text("1,x\n")
    session.register("arc", str(tmp_path / "bad.csv"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        session.query("tc(A,B).").collect()


@pytest.mark.parametrize(
    ("program", "message"),
    [
        ("p(A,B) <- arc(A,_).", "nothing binds B"),
        ("p(A) <- arc(A,B), ~q(A,C). q(A,B) <- arc(A,B).", "nothing binds C"),
        ("p(A) <- arc(A,B), C < 3.", "nothing binds C"),
        ("p(A) <- arc(A,_), ~p(A).", "negates"),
        ("p(A,min<B>) <- arc(A,B). p(A,min<B>) <- p(A,C), arc(C,B).", "aggregates with min"),
        ("p(A) <- nope(A).", "nothing defines nope"),
        ("p(A) <- arc(A).", "arguments"),
        ("arc(A,B) <- arc(B,A).", "declared relation"),
        ("p(A,B) <- arc(A B).", "expected"),
        ("p(mmin<B>,A) <- arc(A,B).", "last argument"),
        ("database({x(A: strange)}).", "unsupported type"),
    ],
)
def test_unsound_programs_are_refused(spark, program, message):
    session = DatalogSession(spark)
    session.load_program(ARC)
    with pytest.raises(DatalogError, match=message):
        session.load_program(program)


def test_no_fixpoint_is_an_error(spark):
    program = WEIGHTED + "p(A,B,D) <- arc(A,B,D). p(A,B,D) <- p(A,C,D1), arc(C,B,D2), D=D1+D2."
    with pytest.raises(DatalogError, match="no fixpoint"):
        run(spark, program, "p(A,B,C).", Options(max_iterations=4), arc=["0,1,1", "1,0,1"])


def test_parser():
    source = parse_program("database({a(X: integer), b(Y: string)}). p(X, sum<Y>) :- a(X), b(Y), X != 3.")
    assert source.relations == {"a": [("X", "integer")], "b": [("Y", "string")]} and len(source.rules) == 1
    assert parse_query("p(-1, X)").terms[0].value == -1
    with pytest.raises(DatalogError):
        parse_query("p(X). q(X).")
