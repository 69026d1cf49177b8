from typeaudit.operators import extract


def metrics(sources):
    rows = extract.extract_types(sources).orderBy("path", "type_ord").collect()
    return {
        r.name: (
            r.method_count, r.property_count, r.initializer_count, r.subscript_count, r.accessor_count, r.line_count,
            [tuple(m) for m in r.members],
        )
        for r in rows
    }


def one(make_sources, text):
    found = metrics(make_sources(a=text))
    assert len(found) == 1, found
    return next(iter(found.values()))


def test_remarks_before_a_type_do_not_count(make_sources):
    text = "/* Ledger of a small shop,\n   kept by hand. */\n\n// TODO: rounding\nfinal class Ledger {\n  func close() { }\n}\n\n"
    assert one(make_sources, text) == (1, 0, 0, 0, 0, 3, [("close", 1, 1)])


def test_bindings_and_a_method(make_sources):
    text = "struct Parcel {\n  let weight = 2.5, label: String\n  var sent = false\n  mutating func send() { sent = true }\n}"
    assert one(make_sources, text)[:2] == (1, 3)


def test_member_ranges_skip_gaps(make_sources):
    text = """actor Clock {}
final class Kettle {
    let litres = 1.7


    func boil() async {
        heat()
        /* wait
           for it */
    }
    // nobody calls this
    private func heat() { }

    deinit {
        print("cold")
    }
}
"""
    assert one(make_sources, text) == (
        2, 1, 0, 0, 0, 16, [("litres", 1, 1), ("boil", 2, 6), ("heat", 7, 7), ("deinit", 8, 10)]
    )


def test_several_members_on_a_line(make_sources):
    text = "class Tray {\n  let cups=6, spoons=4; func lift() {}; func drop() {}\n  func tilt() {}\n}"
    assert one(make_sources, text) == (
        3, 2, 0, 0, 0, 4, [("cups", 1, 1), ("lift", 2, 2), ("drop", 3, 3), ("tilt", 4, 4)]
    )


def test_crlf_counts_twice(make_sources):
    text = "struct C {\r\n  var a = 1\r\n  func f() {\r\n  }\r\n}"
    assert one(make_sources, text) == (1, 1, 0, 0, 0, 9, [("a", 1, 1), ("f", 2, 4)])


def test_attributes_and_modifiers_belong_to_the_type(make_sources):
    text = '@available(iOS 13, *)\n@MainActor\npublic final class A: B, C {\n  private(set) public var x = 1\n}\n'
    assert one(make_sources, text) == (0, 1, 0, 0, 0, 5, [("x", 1, 1)])


def test_class_as_modifier(make_sources):
    text = "class A {\n  class func make() -> A { A() }\n  override class var b: Int { 1 }\n  static let c = 2\n}"
    assert one(make_sources, text) == (1, 2, 0, 0, 1, 5, [("make", 1, 1), ("b", 2, 2), ("c", 3, 3)])


def test_nested_local_and_enclosed_types(make_sources):
    text = """class Outer {
    struct Inner { let a = 1; func f() {} }
    enum Kind {
        case x, y
        struct InEnum { var z = 1 }
        func k() {}
    }
    func g() {
        struct Local { var q: Int { 1 } }
    }
}
extension Outer {
    func more() {}
    class InExtension {}
}
actor Worker {
    func run() {}
    struct InActor {}
}
protocol P: class { func p() }
"""
    found = metrics(make_sources(a=text))
    assert list(found) == ["Outer", "Inner", "InEnum", "Local", "InExtension", "InActor"]
    assert found["Outer"] == (1, 0, 0, 0, 0, 11, [("struct", 1, 1), ("enum", 2, 6), ("g", 7, 9)])
    assert found["Inner"][:2] == (1, 1)
    assert found["Local"] == (0, 1, 0, 0, 1, 1, [("q", 1, 1)])


def test_accessors_one_per_binding(make_sources):
    text = """struct A {
    var a: Int { get { 1 } set { } }
    var b: Int = 5 { didSet { } }
    var c = { 7 }()
    var d: [Int] = make { $0 }
    var e: Int { 1 }, f: Int = 2
    var g: (Int) -> Void = { _ in }
    lazy var h: Foo = { Foo() }()
    subscript(i: Int) -> Int { get { i } }
    var body: some View {
        Text("x") { var y = 1 }
    }
    @objc private(set) var k: Int = run({ 1 }) { willSet(v) { } }
}"""
    found = one(make_sources, text)
    assert found[:5] == (0, 10, 0, 1, 5)


def test_braces_in_comments_and_literals(make_sources):
    text = r'''
class A {
    let a = "} class X {"
    let b = "\(map["}"] ?? "{ \(inner("}"))")"
    let c = #"raw } " \ "#
    let d = """
      } struct Y {
      "quoted" \""" }
      """
    /* } /* nested } */ class Z { */
    // } struct W {
    func f() {}
}
'''
    found = one(make_sources, text)
    assert found[:2] == (1, 4)
    assert found[6] == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("d", 4, 7), ("f", 8, 8)]


def test_binding_commas(make_sources):
    text = """struct A {
    var a, b: Int
    var c = 1, d: Int = 2
    var e: Dictionary<String, Array<Int>>, f: [String: Int] = ["a": 1, "b": 2]
    let (g, h) = (1, 2)
    let i = max(1, 2), j = pick(a, { x, y in x })
    func k<T, U>(a: T, b: U) where T: P, U: Q {}
}"""
    found = one(make_sources, text)
    assert found[:2] == (1, 9)
    assert [m[0] for m in found[6]] == ["a", "c", "e", "(g, h)", "i", "k"]


def test_conditional_members_are_one_member(make_sources):
    text = """class A {
    var a = 1
    #if DEBUG && os(iOS)
    var b = 2
    func c() {}
    struct D { var e = 1 }
    #else
    func c() {}
    #endif
    func f() {}
}"""
    found = metrics(make_sources(a=text))
    assert found["A"] == (1, 1, 0, 0, 0, 11, [("a", 1, 1), ("#if", 2, 8), ("f", 9, 9)])
    assert found["D"][1] == 1


def test_initializers_operators_and_odd_members(make_sources):
    text = """struct A {
    init() {}
    init?(x: Int) { return nil }
    init<T>(y: T) {}
    convenience init(z: Int) { self.init() }
    deinit { }
    static func == (a: A, b: A) -> Bool { true }
    static prefix func - (a: A) -> A { a }
    func `default`() { let v = Foo.init(1) }
    subscript<T>(k: T) -> Int { 0 }
    public typealias B = Int
    @objc enum C { case d }
}"""
    found = one(make_sources, text)
    assert found[:5] == (3, 0, 4, 1, 0)
    assert [m[0] for m in found[6]] == [
        "init", "init", "init", "init", "deinit", "==", "-", "`default`", "subscript", "public", "@",
    ]


def test_words_that_only_look_like_declarations(make_sources):
    text = """class A {
    let open = 1
    var actor: Actor = actor
    func f(class x: Int, in y: Int, var z: Int = 1) {
        if let a = b { switch a { case let .some(v): print(v) default: break } }
        guard let c = d else { return }
        for var i in 0..<3 { i += 1 }
        open(x.class, y.struct, self.init)
        let t = a < b, u = c > d
    }
    let g = x.func
}"""
    found = one(make_sources, text)
    assert found[:5] == (1, 3, 0, 0, 0)
    assert [m[0] for m in found[6]] == ["open", "actor", "f", "g"]


def test_backticked_unicode_names_and_bom(make_sources):
    found = metrics(make_sources(a="﻿class `Type` { var été = 1 }\nstruct 名前 {}"))
    assert list(found) == ["`Type`", "名前"]
    assert found["`Type`"][6] == [("été", 1, 1)]


def test_missing_brace_ends_with_the_last_token(make_sources):
    sources = make_sources(a="class A {\n  func f() {}\n // }\n\n", b="struct B {}", c="class")
    found = metrics(sources)
    assert found["A"] == (1, 0, 0, 0, 0, 2, [("f", 1, 1)]) and list(found) == ["A", "B"]
    assert [(r.name, r.problem) for r in extract.incomplete_types(sources).collect()] == [("A", "parse_incomplete")]


def test_empty_and_comment_only_files(make_sources):
    assert metrics(make_sources(a="", b="// class X {", c="/* class Y {} ", d="\n\n")) == {}


def test_long_literals_and_comments_do_not_recurse(make_sources):
    filler = "x \\n y " * 20000
    text = f'class A {{\n  let a = "{filler}"\n  /* {"* / " * 20000} */\n  let b = ({"(1, 2), " * 5000}3)\n}}'
    assert one(make_sources, text)[:2] == (0, 2)


def test_members_table(make_sources):
    types = extract.extract_types(make_sources(a="struct A { var a = 1\n func f() {\n }\n}"))
    rows = extract.members(types).orderBy("member_ord").collect()
    assert [(r.type_name, r.member_ord, r.name, r.start_line, r.end_line) for r in rows] == [
        ("A", 0, "a", 1, 1), ("A", 1, "f", 2, 3),
    ]


def test_extraction_has_one_exchange_and_no_python(make_sources):
    plan = extract.extract_types(make_sources(a="class A {}"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan and "Arrow" not in plan


def random_file(rng):
    """A file of nested types with the counts its outermost type must get."""
    def body_line():
        return rng.choice([
            'let x = "} class Z { \\(a["k"] ?? "{")"', "if a < b { run { $0 + 1 } } else { stop() }", "// } struct Q {",
            "for i in 0..<3 { print(i, [1, 2], { x in x }) }", "/* { /* } */ class W { */", "struct Local { var q = 1, r = 2 }",
            "switch s { case .a(let v): use(v) default: break }", "guard let c = d else { return }", "x = y.class == z",
        ])

    def block(indent):
        lines = [indent + body_line() for _ in range(rng.randint(0, 3))]
        return "{\n" + "".join(line + "\n" for line in lines) + indent + "}"

    methods = properties = accessors = inits = subscripts = 0
    names, parts = [], []
    for i in range(rng.randint(0, 9)):
        kind = rng.choice(["func", "var", "pair", "computed", "observed", "closure", "init", "subscript", "nested", "enum", "if"])
        if kind == "func":
            methods += 1
            names.append(f"f{i}")
            parts.append(f"  {rng.choice(['', 'private ', '@objc(a) public ', 'class '])}func f{i}(a: Int, b: () -> Void = {{ }}) -> [Int] {block('  ')}")
        elif kind == "var":
            properties += 1
            names.append(f"v{i}")
            parts.append(f"  let v{i}: Dictionary<String, Set<Int>> = [:]")
        elif kind == "pair":
            properties += 2
            names.append(f"v{i}")
            parts.append(f"  var v{i} = max(1, 2), w{i}: (Int, Int) = (1, 2)")
        elif kind == "computed":
            properties, accessors = properties + 1, accessors + 1
            names.append(f"v{i}")
            parts.append(f"  @Lazy var v{i}: Int {block('  ')}")
        elif kind == "observed":
            properties, accessors = properties + 1, accessors + 1
            names.append(f"v{i}")
            parts.append(f"  var v{i}: Int = make {{ 1 }} {{ didSet {block('  ')} }}")
        elif kind == "closure":
            properties += 1
            names.append(f"v{i}")
            parts.append(f"  lazy var v{i}: Foo = {block('  ')}()")
        elif kind == "init":
            inits += 1
            names.append("init")
            parts.append(f"  init?(a: Int, _ b: [String: Int] = [:]) {block('  ')}")
        elif kind == "subscript":
            subscripts += 1
            names.append("subscript")
            parts.append("  subscript(i: Int) -> Int { get { i } set { } }")
        elif kind == "nested":
            names.append("struct")
            parts.append(f"  struct N{i} {{ var z = 1, y: Int {{ 2 }}; func g() {block('  ')} }}")
        elif kind == "enum":
            names.append("enum")
            parts.append(f"  enum E{i} {{ case a, b; var t: Int {{ 1 }} }}")
        else:
            names.append("#if")
            parts.append(f"  #if DEBUG\n  var d{i} = 1\n  func e{i}() {block('  ')}\n  #endif")
    text = "// head {\nimport A\nfinal class Outer: Base, P {\n" + rng.choice(["\n", "\n\n", " // x }\n"]).join(parts) + "\n}\nfunc tail() { }\n"
    return text, (methods, properties, inits, subscripts, accessors), names


def test_random_files(spark):
    """Counts known by construction; and keeping bodies within elements changes nothing."""
    import random

    rng = random.Random(7)
    files = {f"f{i}": random_file(rng) for i in range(300)}
    sources = spark.createDataFrame(
        [("p", path, text) for path, (text, _, _) in files.items()], "project string, path string, text string"
    )
    rows = extract.extract_types(sources).collect()
    outer = {r.path: r for r in rows if r.name == "Outer"}
    assert set(outer) == set(files)
    for path, (text, counts, names) in files.items():
        r = outer[path]
        found = (r.method_count, r.property_count, r.initializer_count, r.subscript_count, r.accessor_count)
        assert found == counts, text
        assert [m.name for m in r.members] == names, text
        assert r.line_count == text.count("\n", text.index("final"), text.rindex("}\nfunc tail")) + 1
        ends = [m.end_line for m in r.members]
        assert [m.start_line for m in r.members] == [end + 1 for end in [0, *ends[:-1]]][: len(ends)]
    fine = extract._type_rows(extract._member_rows(extract._blocks(extract.tokens(sources)))).collect()
    assert {tuple(map(str, r)) for r in fine} == {tuple(map(str, r)) for r in rows}
