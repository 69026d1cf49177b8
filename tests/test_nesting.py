"""Nesting to any depth: literals, comments, generic clauses, groups, and braces that never close."""

import random

import time

import pytest
from pyspark.sql import functions as F

from typeaudit.operators import extract, lexis, nesting


def types(sources):
    rows = extract.extract_types(sources).orderBy("path", "type_ord").collect()
    return [(r.name, r.method_count, r.property_count, r.line_count) for r in rows]


PROBES = {
    "raw literal with many marks": ('class A {\n  let a = ####"a "### } {"####\n  func f() {}\n}', [("A", 1, 1, 4)]),
    "generic clauses": ("struct A {\n var a: B<C<D<E<F<G<H, I>, J>, K>, L>, M>, N> = x\n}", [("A", 0, 1, 3)]),
    "literal in an interpolation": ('class A {\n let s = """\n \\(x + """\n a } {\n""" + y)\n"""\n func f() {}\n}', [("A", 1, 1, 8)]),
    "interpolations": ('class A {\n let s = "\\("\\("\\("\\("\\("{")")")")")"\n func f() {}\n}', [("A", 1, 1, 4)]),
    "calls in interpolations": (
        'class A {\n let s = "\\(f(x) + "\\(g(y) + "\\(h(z) + "\\(k) {")")")"\n func f() {}\n}', [("A", 1, 1, 4)]
    ),
    "raw literal in a raw one": ('class A {\n let s = #"a \\#(#"{"#) b"#\n func f() {}\n}', [("A", 1, 1, 4)]),
    "comments": ("class A { " + "/* " * 9 + "{ class Z { " + "*/ " * 9 + "func f() {} }", [("A", 1, 0, 1)]),
    "regex literal": ('class A {\n let r = /[{"]+/\n func f() { let x = a / b / c }\n}', [("A", 1, 1, 4)]),
    "regex literal with marks": ('class A {\n let r = ##/ [{"/]+ /# /##\n var p: Int { 1 }\n}', [("A", 0, 2, 4)]),
    "regex over lines": ("class A {\n let r = #/\n  { # open\n/#\n func f() {}\n}", [("A", 1, 1, 6)]),
    "division": ("class A {\n let a = x / y; let b = (x)/y + z/w\n func f() {}\n}", [("A", 1, 2, 4)]),
    "attribute": ("class A {\n @B(c(d(e(f(g))))) func f(a: ((((Int), Int), Int), Int)) {}\n}", [("A", 1, 0, 3)]),
    "pattern": ("class A {\n let ((a, b), (c, (d, (e, f)))) = x\n var z = 1\n}", [("A", 0, 2, 4)]),
    "closure in deep groups": ("class A {\n let a = f(g(h(i { class Q {} })))\n func f() {}\n}", [("A", 1, 1, 4), ("Q", 0, 0, 1)]),
    "unclosed": ('class A {\n func f() {\n  let a = "}"\n }\n var b = 2\n// end\n\n', [("A", 1, 1, 5)]),
    "unclosed inside unclosed": ("class A {\n struct B {\n  var a = 1\n  func f() {", [("A", 0, 0, 4), ("B", 1, 1, 3)]),
    "closed before it opens": ("}\nclass A {\n func f() {}\n", [("A", 1, 0, 2)]),
}


@pytest.mark.parametrize("name", PROBES)
def test_probe(make_sources, name):
    text, want = PROBES[name]
    assert types(make_sources(a=text)) == want


def test_any_depth(make_sources):
    """Each file nests one kind of thing to its own depth."""
    texts, want = {}, []
    for depth in (1, 3, 7, 20, 60):
        generic = "A<" * depth + "Int, Int" + ">" * depth
        comment = "/*" * depth + " { " + "*/" * depth
        literal = '"x"'
        for _ in range(depth):
            literal = f'"\\({literal} + "{{")"'
        raw = "#" * depth
        texts[f"d{depth:02d}"] = (
            f"class T{depth} {{\n var a: {generic}\n {comment}\n let b = {literal}\n let c = {raw}\"}}\"{raw}\n func f() {{}}\n}}"
        )
        want.append((f"T{depth}", 1, 3, 7))
    assert types(make_sources(**texts)) == want


def code_of(sources):
    return {r.path.removesuffix(".swift"): r.code for r in nesting.rewritten(sources).select("path", "code").collect()}


def suspects(sources):
    cut = F.regexp_extract_all("text", F.lit(lexis.OUTLINE), F.lit(0))
    return {r.path.removesuffix(".swift") for r in sources.withColumn("cut", cut).where(nesting.is_suspect(F.col("cut"))).select("path").collect()}


def test_rewriting_changes_nothing_where_it_isn_t_needed(make_sources):
    """Random shallow sources: the automaton's code gives the same types as the text itself."""
    pick = random.Random(11)
    parts = [
        "func f() { if a { b() } }", "var a = 1, b: [Int] = [1, 2]", 'let s = "x {"', "// } remark", "/* { */", "init() {}",
        "struct N { let z = 0 }", "var p: Int { get { 1 } set {} }", "subscript(i: Int) -> Int { 0 }", 'let m = """\n  }\n"""', "@objc(x) func g<T>(a: T) {}",
        'let u = "http://a/b?c=\\(d(e))&f", v = #"\\("#', "let w = f(a(b(1)), c[2], { $0 })", "/** doc */ let q = a < b && c > d", "case x(_: A<B>), y",
    ]
    texts = {f"t{i}": "class A {\n" + "\n".join(pick.choices(parts, k=6)) + "\n}\n" for i in range(60)}
    sources = make_sources(**texts)
    plain = types(sources)
    assert plain == types(make_sources(**code_of(sources))) and len(plain) >= 60
    assert not suspects(sources)


def test_deep_texts_are_suspects(make_sources):
    regular = {"division", "closure in deep groups", "unclosed", "unclosed inside unclosed", "closed before it opens"}
    sources = make_sources(**{name: text for name, (text, _) in PROBES.items()})
    assert suspects(sources) == set(PROBES) - regular


def test_line_ends_keep_their_number_and_kind(make_sources):
    text = 'class A {\r\n let a = """\r\n{\u2028\x85\n"""\r // {\n f(g(h(\x0b))) A<B,\n\x0cC> '
    [code] = code_of(make_sources(a=text)).values()
    assert [c for c in code if c in "\r\n\u2028\x85\x0b\x0c"] == [c for c in text if c in "\r\n\u2028\x85\x0b\x0c"]


HOSTILE = {
    "interpolations that never close": 'class A {\n let s = ' + '"\\(' * 400 + "\n}",
    "interpolations": "class A {\n let s = " + '"\\(' * 1500 + "1" + ')"' * 1500 + "\n func f() {}\n}",
    "groups": "class A {\n let s = " + "(" * 30000 + ")" * 30000 + "\n func f() {}\n}",
    "clause": "class A {\n var s: " + "B<" * 4000 + "C, D" + ">" * 4000 + "\n func f() {}\n}",
    "comments": "class A {\n " + "/*" * 20000 + "}" + "*/" * 20000 + " func f() {}\n}",
    "literals": "class A {\n" + ' let s = "\\("}")"\n' * 20000 + " func f() {}\n}",
    "braces": "class A {\n func f() " + "{" * 3000 + "}" * 3000 + "\n}",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_files_do_not_stop_the_others(make_sources, name):
    """A row for each, in time that doesn't grow with the square of the text."""
    started = time.perf_counter()
    found = types(make_sources(good="class G {\n func g() {}\n}", hostile=HOSTILE[name]))
    assert found[0] == ("G", 1, 0, 3)
    unclosed = name == "interpolations that never close"
    lines = 2 if unclosed else 20003 if name == "literals" else 3 if name in ("comments", "braces") else 4
    counts = {"comments": (1, 0), "braces": (1, 0), "literals": (1, 20000)}.get(name, (1, 1))
    assert found[1] == ("A", 0, 1, 2) if unclosed else ("A", *counts, lines)
    assert time.perf_counter() - started < 60


def test_no_python_in_the_plan(make_sources):
    plan = extract.extract_types(make_sources(a="class A {}"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_text_in_the_exchange(make_sources):
    types_of = extract.extract_types(make_sources(a="class A {}"))
    plan = types_of._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION" not in plan
    exchange = plan[plan.index("Exchange") :].splitlines()[1]
    assert "text" not in exchange and "element" not in exchange and "head" not in exchange.replace("headed", "")


def test_whole_comments_and_literals_are_emptied_before_the_fold(spark):
    """The fold then meets their ends only: deep comments and raw literals of many lines have few delimiters left."""
    inside = "a { ' b # /x\n\r\x0b( " * 500
    text = "class A {\n " + "/*" * 9 + inside + "*/" * 9 + "\n let a = ####\"\"\"\n" + inside + "\n\"\"\"####\n // " + "{ ( " * 500 + "\n}"
    found = nesting.rewritten(spark.createDataFrame([(text,), ("\ufdd0 /* \ufdd1\n */ x",)], "text string"))
    whole = F.regexp_extract_all("text", F.lit(nesting._WHOLE), F.lit(0))
    emptied = found.select("code", F.array_join(F.transform(whole, nesting._emptied), "").alias("left")).collect()
    assert all(emptied[0].code.count(c) == text.count(c) for c in "\n\r\x0b")
    assert emptied[0].code.split() == ["class", "A", "{", "let", "a", "=", "0", "}"]
    assert len(emptied[0].left.replace("\ufdd0", "").replace("\ufdd1", "").replace("\x0b", "")) < 80
    assert emptied[1].code.split() == ["\ufdd0", "x"] and emptied[1].code.count("\n") == 1
