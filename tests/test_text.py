"""Parsers of program text: goldens and properties."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st_

from rungline.functions import paths, rung, st, tables


def names(text):
    return [(n, ops) for _, n, ops, _ in rung.instructions(text)]


def test_calls_and_operands():
    assert names("XIC(a)  OTE (b.c[1,2])") == [("XIC", ["a"]), ("OTE", ["b.c[1,2]"])]
    assert names("CPT(d,(a+ABS(b))*c);NOP()") == [("CPT", ["d", "(a+ABS(b))*c"]), ("NOP", [])]
    assert names("stray XIC(a") == [("XIC", ["a"])]
    assert names("JSR\t(x)") == []
    assert names("") == names(None) == []


def test_branch_tree():
    got = [(n, p, leg, pos, k, name, legs) for n, p, leg, pos, k, name, _, _, legs in rung.nodes("XIC(a)[XIC(b) ,[NOP() ,] XIO(c)]OTE(d);XIC(e)")]
    assert got == [(1, 0, 0, 0, "ins", "XIC", 0), (2, 0, 0, 1, "branch", None, 2), (3, 2, 0, 0, "ins", "XIC", 0), (4, 2, 1, 0, "branch", None, 2), (5, 4, 0, 0, "ins", "NOP", 0), (6, 2, 1, 1, "ins", "XIO", 0), (7, 0, 0, 2, "ins", "OTE", 0)]


def test_canonical_form():
    assert rung.canonical("XIC(Start)[XIC(Run) ,]XIO(Stop)OTE(Run);") == "XIC(Start)[XIC(Run),]XIO(Stop) OTE(Run);"
    assert rung.canonical(" MOV( a , b )\n OTE(c) ;") == "MOV( a , b ) OTE(c);"
    assert rung.canonical("A((x) y)  \\P.T(z") == "A((x) y) \\P.T(z" and rung.canonical("A(x) Ä(y) ) B") == "A(x)Ä(y)) B"


def test_problems():
    assert rung.problems("XIC(a)OTE(b);") == []
    assert rung.problems("XIC(a OTE(b)") == ["rung must end with ;", "unbalanced ()"]
    assert rung.problems("[XIC(a)]]OTE(b);") == ["unbalanced []"]
    assert rung.problems("](;") == ["unbalanced []"] and rung.problems(")(;") == ["unbalanced ()"]


def test_long_rungs_take_a_line_for_each_leg():
    text = "XIC(Start)[XIC(Run)XIC(More) ,[XIO(A) ,XIO(B)]]XIO(Stop)OTE(Motor);"
    want = ["XIC(Start)", "[XIC(Run) XIC(More)", ",", "  [XIO(A)", "  ,XIO(B)", "  ]", "]XIO(Stop) OTE(Motor);"]
    assert rung.layout(text, 20).split("\n") == want and rung.layout(text) == text
    assert rung.layout("[" + "XIC(Long.Name)" * 4 + "];", 31).split("\n") == ["[XIC(Long.Name) XIC(Long.Name)", "   XIC(Long.Name) XIC(Long.Name)", "];"]


_ins = st_.builds(lambda n, o: f"{n}({o})", st_.sampled_from(["XIC", "OTE", "MOV", "Dev"]), st_.sampled_from(["", "a", "b.c[1]", "x,y", "f(1),z"]))
_series = st_.recursive(st_.lists(_ins, max_size=4).map("".join), lambda s: st_.lists(s, min_size=1, max_size=3).map(lambda legs: "XIC(q)[" + " ,".join(legs) + "]"), max_leaves=8)


@given(_series)
@settings(max_examples=200, deadline=None)
def test_layout_keeps_the_canonical_form(series):
    text = series + ";"
    for width in (5, 110):
        assert rung.canonical(rung.layout(text, width)) == rung.canonical(text)
    assert rung.canonical(rung.canonical(text)) == rung.canonical(text)
    tree = [r for r in rung.nodes(text) if r[4] == "ins"]
    assert [r[5:7] for r in tree] == [tuple(r[1:3]) for r in rung.instructions(text)]


@given(st_.text(alphabet="XIC(),[]; a\n'.", max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_parses(text):
    rung.nodes(text), rung.instructions(text), rung.canonical(text), rung.problems(text), st.uses(text.split("\n"))
    assert len(st.blank(text)) == len(text)


def test_blanking():
    src = "A := 1; // B\nC := 'it$'s' + T#5s (* D\nE *) + 16#FF + F2;"
    got = st.blank(src)
    assert len(got) == len(src) and got.count("\n") == 2
    assert [w for w in ("A", "B", "C", "D", "E", "FF", "F2") if w in got] == ["A", "C", "F2"]


def test_structured_text_uses():
    lines = ["IF Cnt > 5 THEN", "  Arr[Idx + 1].V [:=] Other.X;", "  MOV(Src, Dst[K]);", "  JSR(Seq, P);", "END_IF; Fn(ArgA, Fn2(ArgB));"]
    got = {(line, i, b, w) for line, i, _, b, w, _ in st.uses(lines)}
    assert got == {(0, "ST", "Cnt", False), (1, ":=", "Arr", True), (1, "ST", "Idx", False), (1, "ST", "Other", False), (2, "MOV", "Src", False), (2, "MOV", "Dst", True), (2, "ST", "K", False), (3, "JSR", "P", False), (4, "ST", "ArgA", False), (4, "ST", "ArgB", False)}
    assert st.calls(lines) == ["Seq"] and st.problems(lines) == []
    assert st.problems(["IF a THEN (* x"]) != []
    assert st.problems(["a := )b(;"]) == ["unexpected ) in line 1", "unbalanced ()"] and "unbalanced /* */" in st.problems(["/* open"])


def test_calls_that_may_be_user_defined():
    rows = st.findings(["Dev(Inst, Zone[Idx].A, Fn(X) + Y); JSR(Seq);"])
    assert {(r[1], r[3], tuple(r[7])) for r in rows} == {("arg", "Inst", ()), ("arg", "Zone[Idx].A", ()), ("arg", "Fn(X)+Y", ()), ("use", "Idx", ()), ("use", "Inst", ("DEV",)), ("use", "Zone[Idx].A", ("DEV",)), ("use", "Idx", ("DEV",)), ("arg", "X", ("DEV",)), ("use", "X", ("DEV", "FN")), ("use", "Y", ("DEV",)), ("jump", "Seq", ())}


def test_path_expressions(spark):
    rows = [(p,) for p in ["Tag.Member[1]", "\\Prog.Tag.X", "Mod1:I.Data", " A [ 2 ] . B", "16#FF", "-3", "'s'", "?", "", "A[B[1]]"]]
    df = spark.createDataFrame(rows, "p string")
    from pyspark.sql import functions as F

    got = df.select(paths.base_tag(F.col("p")), paths.is_literal(F.col("p")), paths.norm(F.col("p"))).collect()
    assert [r[0] for r in got] == ["Tag", "\\Prog.Tag", "Mod1:I", "A", None, None, None, None, None, "A"]
    assert [r[1] for r in got] == [False, False, False, False, True, True, True, True, True, False]
    assert got[3][2] == "a[*].b" and got[9][2] == "a[*]]"


def test_fixed_tables():
    assert len(tables.WRITES) == 117 and sum(not v for v in tables.WRITES.values()) == 15
    assert not set(tables.ALSO_KNOWN) & set(tables.WRITES) and len(set(tables.ALSO_KNOWN)) == 112


def test_both_ways_to_take_a_text_apart_agree(spark):
    import random

    r = random.Random(8)
    texts = ["", None, "XIC(a)OTE( b , c );", "x (a)", "XIC(a", "CPT(a,(b+c));", "MOV(A[1],B)", "9XIC(a)A B(,)", "\tTON(t,?,\n?)", "NOP()AFI( )", "a)(b", "XIC(a))OTE(b)"]
    texts += ["".join(r.choice(["XIC(", "a", ",", ")", "[", "]", " ", "OTE", "(", ";", "b.c"]) for _ in range(r.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, txt string")
    got = {}
    for r in rung.instruction_rows(df, ["k"]).collect():
        got.setdefault(r.k, []).append((r.pos, r["name"], r.operands, r.text))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == rung.instructions(t), t
