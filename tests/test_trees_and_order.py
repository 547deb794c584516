"""Trees of any depth, chains to sinks, types of long paths, and the order of parameters, against plain versions."""

from __future__ import annotations

import itertools
import random

import pytest

from rungline.functions import tables
from rungline.operators import aoi_order, graph, types
from rungline.plans.project import Project
from rungline.sinks import pages


def walked(rows):
    """(node, path) as a walk over the rows in order finds them: roots first, then whatever no walk has reached."""
    parent = {n: p for n, p, _ in rows}
    order = sorted(rows, key=lambda r: r[2])
    kids, roots = {}, []
    for n, p, _ in order:
        if p in parent and p != n:
            kids.setdefault(p, []).append(n)
        else:
            roots.append(n)
    seen = {}

    def walk(n, path):
        if n not in seen:
            seen[n] = [*path, n]
            for k in kids.get(n, ()):
                walk(k, seen[n])

    for n in [*roots, *(n for n, _, _ in order)]:
        walk(n, [])
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_forests_equal_a_walk(spark, seed):
    r = random.Random(seed)
    n = 60
    rows = [(k, r.choice([None, k, 1000, *range(n)] if k % 3 else [(k + 1) % n]), r.random()) for k in range(n)]
    got = {x.node: list(x.path) for x in graph.forest(spark.createDataFrame([(*x, x[0]) for x in rows], "node long, parent long, ord double, key long")).collect()}
    assert got == walked(rows)


def test_lost_and_circular_modules_are_printed(spark):
    rows = [("P", m, p, k) for k, (m, p) in enumerate([("Local", None), ("M1", "Local"), ("Lost", "Gone"), ("A", "B"), ("B", "A")])]
    p = Project.of(spark, modules=spark.createDataFrame(rows, "project string, module string, parent string, ord long"))
    got = [r.line for r in pages.modules(p).orderBy("key").collect()]
    assert got == ["- **Local**", "  - **M1**", "- **Lost**", "- **A**", "  - **B**"]


def test_the_first_hop_leaves_the_own_rung(spark):
    rungs = spark.createDataFrame([("A", "R", 0, "XIC(S)OTE(S)OTE(T);"), ("A", "R", 1, "XIC(T)OTE(U);"), ("A", "R", 2, "XIC(U)OTE(Out:O.Data);"), ("A", "R", 3, "XIC(V)OTE(S);")], "program string, routine string, n long, txt string")
    got = {(r.use_key.split("|")[-1], r.n): (r.sink, r.hops, [k.split("|")[-1] for k in r.chain]) for r in Project.of(spark, rungs=rungs).paths_to_sinks().collect()}
    assert ("s", 0) not in got  # what S reaches it reaches through its own rung
    assert got["t", 0] == ("Out:O.Data", 2, ["t", "u", "out:o.data"]) and got["u", 1] == ("Out:O.Data", 1, ["u", "out:o.data"])
    assert got["s", 3] == ("Out:O.Data", 3, ["s", "t", "u", "out:o.data"]) and got["out:o.data", 2][1:] == (0, ["out:o.data"])


def test_types_of_long_paths(spark):
    members = spark.createDataFrame([("P", f"t{k}", "m", f"T{k + 1}", False) for k in range(25)] + [("P", "t0", "list", "INT", True), ("P", "t0", "bit", "BIT", False)], "project string, type_name string, member string, data_type string, is_array boolean")
    paths = {"x" + ".m" * 20: ("T20", False), "x": ("T0", True), "x[1]": ("T0", False), "x.list": ("INT", True), "x.list[2]": ("INT", False), "x.list[1].3": ("BOOL", False), "x.none": (None, False), "x.none.m": (None, False), "x.bit": ("BIT", False)}
    got = types.operand_types(spark.createDataFrame([("P", p, "T0", True) for p in paths], "project string, operand string, type string, is_array boolean"), members)
    assert {r.operand: (r.found, r.array) for r in got.collect()} == paths
    kinds = {r.operand: r.k for r in got.withColumn("k", types.kind()).collect()}
    assert kinds["x[1]"] == "struct" and kinds["x.list"] == "struct" and kinds["x.list[2]"] == "atomic" and kinds["x.none"] is None and set(tables.ATOMIC_TYPES) >= {"BIT", "INT"}


def every_order(data, inout, cost, home):
    """The best of all merges, in the order in which they are listed."""

    def merges(a, b):
        if not a or not b:
            yield a + b
            return
        for rest in merges(a[1:], b):
            yield [a[0], *rest]
        for rest in merges(a, b[1:]):
            yield [b[0], *rest]

    best = None
    for order in itertools.permutations(inout) if len(inout) <= aoi_order.FREE else [inout]:
        for c in merges(data, list(order)):
            mark = (sum(cost(p, k) for k, p in enumerate(c)), sum(k >= len(home) or home[k] != p for k, p in enumerate(c)))
            if best is None or mark < best[0]:
                best = (mark, c)
    return best[1]


def test_the_lattice_finds_what_enumeration_finds():
    r = random.Random(4)
    for _ in range(400):
        data, inout = [f"d{k}" for k in range(r.randrange(5))], [f"r{k}" for k in range(r.randrange(1, 6))]
        costs = {(p, k): r.choice([0, 0, 0, 50, 100]) for p in data + inout for k in range(len(data + inout))}
        home = data + inout
        r.shuffle(home)
        cost = lambda p, k: costs[p, k]  # noqa: B023, E731
        assert aoi_order.best_order(data, inout, cost, home) == every_order(data, inout, cost, home)


def test_orders_without_calls_and_with_too_many_ways():
    p = lambda name, usage, created, layout=None, required=True: {"name": name, "usage": usage, "required": required, "created": created, "layout": layout, "data_type": "T"}
    params = [p("a", "Input", 3, 0), p("b", "Output", 1, 1), p("r", "InOut", 2), p("o", "Input", 0, 2, False)]
    assert aoi_order.ordered_names(params, [], 20_000) == ["a", "b", "r", "o"]  # data parameters as they lie, in the places where they were made
    said = [{"place": 0, "literals": 0, "structs": 5, "types": [("t", 5)]}, {"place": 1, "literals": 1, "structs": 0, "types": None}]
    assert aoi_order.ordered_names(params, said, 20_000)[0] == "r" and aoi_order.ordered_names(params, said, 1)[0] != "r"
    assert aoi_order.ordered_names([x for x in params if x["usage"] != "InOut"], said, 20_000) == ["a", "b", "o"]
