"""Paths, lexical pass, metrics and function spans."""

import pytest
from pyspark.sql import functions as F

from treeline.functions import paths, text
from treeline.operators import functions as spans, imports, lexical, metrics
from treeline.operators.facts import facts
from treeline.sources import files


def values(spark, make, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_extension(spark):
    given = ["a/b.py", ".py", "x/.js", "a.b.java", "noext", "d.x/file", "..py"]
    assert values(spark, paths.extension, given) == [".py", "", "", ".java", "", "", ""]


def test_test_paths(spark):
    tests = ["web/tests/x.js", "tests/x.py", "a/test_x.py", "x.spec.ts", "FooTest.java", "latest_x.py"]
    assert values(spark, paths.is_test, tests + ["src/contest/x.js"]) == [True] * 6 + [False]


def test_third_party(spark):
    assert values(spark, paths.is_third_party, ["lib/x.js", "library/x.js", "a/vendor"]) == [True, False, True]


def test_normalized_paths(spark):
    given = ["a/./b", "a/../b", "../b", "a/../../b", "./", "a//b"]
    assert values(spark, paths.normalize_segments, given) == ["a/b", "b", "../b", "../b", ".", "a/b"]


def test_shingles_and_grams(spark):
    assert values(spark, text.shingles, ["abcd", "ab  cd", "aaaaaaa", "a😀bcde"]) == [
        [], ["ab cd"], ["aaaaa"], ["a😀bcd", "😀bcde"]]
    assert values(spark, text.char_trigrams, ["Ab-C d", "a", "!"]) == [["abc", "bcd"], ["a"], [""]]


def test_thousands(spark):
    rows = spark.createDataFrame([(1001,), (1050,), (1250,), (1750,), (1950,), (999,), (None,)], "v long")
    got = [r[0] for r in rows.select(text.humanize(F.col("v"), is_loc=True)).collect()]
    assert got == ["1.0K", "1.1K", "1.3K", "1.8K", "1.9K", "999", "N/A"]


def test_lossy_decoding(spark):
    rows = spark.createDataFrame([(bytearray(b"ab\xff\xc3(c\xc3\xa9"),)], "v binary")
    assert rows.select(text.decode_lossy(F.col("v"))).first()[0] == "ab(cé"


def test_golden_metrics(golden):
    rows = {r.path: r for r in metrics.file_metrics(golden).collect()}
    assert [rows[p].loc for p in ("src/app.py", "util/text.py", "web/a.js", "web/b.js")] == [9, 5, 2, 2]
    app = rows["src/app.py"]
    assert (app.loc_span, app.marker_comments, app.marker_lines) == (11, 1, 1)


def test_golden_functions(golden):
    rows = {r.name: (r.start_line, r.end_line, r.complexity) for r in spans.functions(golden).collect()}
    assert rows == {"run": (5, 11, 5), "clean": (1, 2, 1), "go": (4, 5, 1), "f": (2, 2, 3)}


def test_golden_code_metrics(golden):
    row = metrics.code_metrics(metrics.file_metrics(golden), spans.functions(golden)).first()
    assert (row.loc, row.marker_comments, row.files_analyzed, row.total_functions) == (18, 1, 4, 4)
    assert (row.max_complexity, row.min_complexity, row.avg_complexity) == (5, 1, 2.5)
    assert (row.low, row.medium, row.high, row.very_high, row.debt_score) == (4, 0, 0, 0, 10.02)


def test_file_without_functions_is_analyzed(tree):
    read = facts(tree([("a.py", "x = 1\n"), ("b.js", "")]))
    row = metrics.code_metrics(metrics.file_metrics(read), spans.functions(read)).first()
    assert (row.files_analyzed, row.total_functions, row.min_complexity, row.avg_complexity) == (2, 0, 0, 0.0)


def test_comment_openers_in_literals(lexed):
    got = lexical.comments(lexed([
        ("a.py", 's = "# no"  # yes\nt = """\n# no\n"""\n'),
        ("b.js", 'u = "http://x"; /* one\ntwo */ v = `// no`; // end'),
    ])).orderBy("path", "comment_no").collect()
    assert [(r.path, r.comment) for r in got] == [
        ("a.py", "# yes"), ("b.js", "/* one\ntwo */"), ("b.js", "// end")]


def test_masking_keeps_line_numbers(lexed):
    row = lexed([("a.js", "a /* x\ny */ b\n`t\nu` c // z\n")]).first()
    assert row.code.count("\n") == row.masked.count("\n") == row.content.count("\n")


PYTHON = '''class K:
    def outer(self, a,
    b):
        def inner(y):
            return y if y else 0
        for i in a:
            while i and b: pass
        return [z
    for z in a
    if z or b]
    # a comment at any depth
    async def later(self):
        try:
            pass
        except ValueError:
            pass
        finally:
            pass

def one(): return 1
x = 2
'''
JAVA = '''class A {
  A(int x) { this.x = x; }
  abstract int none(int y);
  @Override
  public static List<String> go(int a, int b) throws E
  {
    for (String s : names) { if (s != null || a > 0) return s; }
    for (int i = 0; i < a; i++) { do { b++; } while (b < 3); }
    return a > b ? foo(a) : bar();
  }
}
'''
SCRIPT = '''class W {
  get size() { return this.n ?? 0; }
  async run(a, b = f(1)) {
    const h = (x) => {
      if (x) { return 1; } else if (a) { return 2; }
    };
    switch (a) { case 1: break; }
    try { g(); } catch (e) { } finally { }
    return a?.b ? 1 : 2;
  }
}
if (top) { call(); }
'''


@pytest.mark.parametrize("path, content, expected", [
    ("a.py", PYTHON, {"outer": (2, 10, 6), "inner": (4, 5, 2), "later": (12, 18, 3), "one": (20, 20, 1)}),
    ("A.java", JAVA, {"A": (2, 2, 1), "none": (3, 3, 1), "go": (5, 10, 5)}),
    ("w.js", SCRIPT, {"size": (2, 2, 1), "run": (3, 10, 8), "unknown": (4, 6, 4)}),
])
def test_spans(tree, path, content, expected):
    rows = spans.functions(facts(tree([(path, content)]))).collect()
    assert {r.name: (r.start_line, r.end_line, r.complexity) for r in rows} == expected


DEEP = """function big(
  a,
  b
) {
  return a;
}
const add = (a, b) => a && b;
function nest(a = f(g(h(1)))) { return x => x ? 1 : 2 }
const o = { m(p) { do { p--; }                while (p > 0); while (p) { p++ } }, k: 1 };
foo((v): T => { if (v) {} }, w => w
  .q || 2);
for (let i = size(o) - 1; i >= f(0); i--) { go(i) }
"""
WIDE = """class B {
  public static final synchronized strictfp Map<String, Map<String, List<Map<A, Map<B, C>>>>> wide(
      int a,
      List<? extends X> b
  ) throws E {
    for (int i = b.size() - 1; i >= f(0); i--) { s += i; }
    for (
      int k = 0; k < a;
      k++
    ) { }
    return a > 0 ? g(a) : h(b);
  }
  @Named(value = 1, other = f(2)) B() { super(); }
  int v = call(1);
}
enum E { P(1), Q(2); E(int x) { } }
"""
NESTED = """def f(a=g((1, (2, (3,)))),
      b=None):
    x = 1 if a else 2; y = 3
    if a: pass; return [
        i for i in a if i and
        b
    ]
    def odd(self): pass
    z = a \\
        or b
    def inner():
        def most(): return 1

        return 2
"""


@pytest.mark.parametrize("path, content, expected", [
    ("d.js", DEEP, {"big": (1, 6, 1), "unknown": (10, 10, 2), "nest": (8, 8, 2), "x": (8, 8, 2), "m": (9, 9, 2), "w": (10, 11, 2)}),
    ("W.java", WIDE, {"wide": (2, 12, 4), "B": (13, 13, 1), "E": (16, 16, 1)}),
    ("n.py", NESTED, {"f": (1, 14, 5), "odd": (8, 8, 1), "inner": (11, 14, 1), "most": (12, 12, 1)}),
])
def test_spans_without_limits(tree, path, content, expected):
    read = facts(tree([(path, content)]))
    rows = spans.functions(read).collect()
    found = {r.name: (r.start_line, r.end_line, r.complexity) for r in rows}
    assert found == expected or found == expected | {"unknown": (7, 7, 2)}
    named = {r.name for r in spans.definitions(read).where("kind = 'function'").collect()}
    assert named == set(expected) - {"unknown"}


def test_unbalanced_braces_end_at_last_event(tree):
    rows = spans.functions(facts(tree([("a.js", "function f() {\n if (a) {\n  b();\n")]))).collect()
    assert [(r.name, r.complexity) for r in rows] == [("f", 2)]


def test_imports(tree):
    content = {
        "a.py": "import a.b as c, d\nfrom .x import (y,\n  z as w)\nfrom . import q\ns = '''\nimport no\n'''\n",
        "b.ts": "import { p,\n q } from \"./m\";\nimport 'side';\nconst r = require('k');\n// import n from 'n'\n",
        "C.java": "import static a.importer.B;\nimport a.*;\n",
    }
    rows = imports.imports(facts(tree(list(content.items())))).orderBy("path", "import_no").collect()
    got = [(r.path, r.type, r.module, r["items"]) for r in rows]
    assert got == [
        ("C.java", "import", "a.importer.B", []), ("C.java", "import", "a.*", []),
        ("a.py", "import", "a.b", []), ("a.py", "import", "d", []),
        ("a.py", "from_import", ".x", ["y", "z"]), ("a.py", "from_import", ".", ["q"]),
        ("b.ts", "import", "./m", ["{ p,\n q }"]), ("b.ts", "import", "side", []),
        ("b.ts", "require", "k", []),
    ]


def test_scan_reads_hidden_names(spark, tmp_path):
    for name, data in {
        "pkg/__init__.py": b"x = 1\n", "pkg/__tests__/t.js": b"//", ".hid/a.ts": b"\xffok",
        "node_modules/m/i.js": b"1", "pkg/readme.md": b"text", "pkg/deep/er/A.java": b"class A {}",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path: r.content for r in files.scan_tree(spark, str(tmp_path), "r").collect()}
    assert set(rows) == {
        "pkg/__init__.py", "pkg/__tests__/t.js", ".hid/a.ts", "node_modules/m/i.js", "pkg/deep/er/A.java"}
    assert rows[".hid/a.ts"] == "ok"
    pruned = files.scan_tree(spark, str(tmp_path), "r", exclude_third_party=True)
    assert "node_modules/m/i.js" not in {r.path for r in pruned.collect()}
    assert files.read_errors(pruned).count() == 0


def test_unreadable_file_is_reported(spark, tmp_path):
    gone = spark.createDataFrame([("nope.py",)], "path string")
    row = files.read_errors(files.read_files(gone, str(tmp_path), "r")).first()
    assert row.path == "nope.py" and row.reason


@pytest.mark.parametrize("path, content", [
    ("a.py", "import a, " + "b, " * 200_000 + "c\nx = [" + "1, " * 200_000 + "]\ns = '" + "\\'" * 200_000 + "'\n"),
    ("A.java", "int[] a = {\n" + "1, " * 200_000 + "\n" + "word " * 200_000 + "\n};\n/* " + "* " * 200_000 + "*/\n"),
    ("a.js", "f(" * 50_000 + "\n" + "g(a, b);" * 50_000 + "\n`" + "\\`" * 200_000 + "`\n" + "import " + "x, " * 100_000),
    ("b.py", "x = 1" + " " * 300_000 + "y\n" + "\n" * 300_000 + "z" + " " * 300_000),
])
def test_huge_lines(tree, path, content):
    """Nothing recurses on, or rescans, very long lines."""
    read = facts(tree([(path, content)]))
    sizes = [F.size(c).alias(c) for c in ("spans", "imported", "defined")]
    assert read.select("loc", "loc_span", *sizes).collect()[0].loc > 0
    assert spans.functions(read).count() == 0


def test_scan_does_not_follow_links(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("x� = 1\n")
    (tmp_path / "a/up").symlink_to(tmp_path)
    rows = files.scan_tree(spark, str(tmp_path), "r").collect()
    assert [(r.path, r.content, r.error) for r in rows] == [("a/x.py", "x� = 1\n", None)]


def test_unlistable_directory_is_reported(spark, tmp_path):
    rows = files.scan_tree(spark, f"{tmp_path}/nowhere", "r")
    assert files.read_errors(rows).count() == 1


def test_unicode_space_and_replacement_characters(spark):
    df = spark.createDataFrame([("  　", "a   b"), ("�", "x")], "a string, b string")
    rows = df.select(
        text.is_blank(F.col("a")).alias("blank"), text.collapse_space(F.col("b")).alias("b"),
        text.decode_lossy(F.col("a").cast("binary")).alias("kept"), "a",
    ).collect()
    assert [(r.blank, r.b) for r in rows] == [(True, "a b"), (False, "x")]
    assert all(r.kept == r.a for r in rows)
