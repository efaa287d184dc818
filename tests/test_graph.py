"""Import resolution, graph measures and cycles."""

import itertools
import posixpath
import random

from pyspark.sql import functions as F

from treeline.operators import components, cycles, graph, imports
from treeline.operators.facts import facts
from treeline.plans.report import dependency_graph


def test_golden_graph(golden):
    built = dependency_graph(golden)
    counts = {r.type: r.n for r in graph.node_counts(built.nodes).collect()}
    assert counts == {"file": 4, "function": 4, "class": 1, "external": 2}
    whole, inner = (graph.graph_stats(g).first() for g in (built, built.without_externals()))
    assert (whole.total_edges, whole.average_connections_per_node, whole.graph_density) == (10, 1.82, 0.0909)
    assert (inner.total_edges, inner.average_connections_per_node, inner.graph_density) == (8, 1.78, 0.1111)
    degrees = graph.degrees(built.without_externals())
    out = [(r.file, r.out_degree) for r in graph.top_files(degrees, "out_degree").orderBy("rank").collect()]
    assert out == [("util/text.py", 3), ("src/app.py", 2), ("web/b.js", 2), ("web/a.js", 1)]
    into = [(r.file, r.in_degree) for r in graph.top_files(degrees, "in_degree").orderBy("rank").collect()]
    assert into == [("util/text.py", 1), ("web/a.js", 1), ("web/b.js", 1), ("src/app.py", 0)]


def test_golden_neighbours(golden):
    edges = dependency_graph(golden).edges
    rows = {(r.direction, r.neighbour, r.type) for r in graph.neighbours(edges, "web/b.js").collect()}
    assert rows == {
        ("dependency", "web/a.js", "file"), ("dependency", "web/b.js::f", "function"),
        ("dependent", "web/a.js", "file")}
    assert graph.neighbours(edges, "absent.py").isEmpty()


def test_class_takes_the_node_of_its_namesake(tree):
    built = dependency_graph(facts(tree([("a.py", "def X():\n    pass\nclass X:\n    pass\n")])))
    assert [(r.id, r.type) for r in built.nodes.where("type <> 'file'").collect()] == [("a.py::X", "class")]


def test_last_import_of_a_target_wins(tree):
    built = dependency_graph(facts(tree([("a.js", "import p from './b';\nimport q from 'b';\n"), ("b.js", "")])))
    assert [(r.dst, r.module) for r in built.edges.collect()] == [("b.js", "b")]


def naive_target(path, module, files):
    """First file in path order that any alternative names, on whole segments."""
    relative = None
    if module.startswith("."):
        if path.endswith(".py"):
            dots = len(module) - len(module.lstrip("."))
            rest = module[dots:].replace(".", "/")
            relative = posixpath.normpath(posixpath.join(posixpath.dirname(path), "../" * (dots - 1), rest))
        else:
            relative = posixpath.normpath(posixpath.join(posixpath.dirname(path), module))
    wanted = module.replace(".", "/")
    for file in sorted(files):
        base = posixpath.splitext(file)[0]
        if file == module or base == module:
            return file
        if relative is None and (base == wanted or base.endswith("/" + wanted)):
            return file
        if relative is not None and relative in (file, base):
            return file
    return None


def test_resolution_equals_nested_loop(spark):
    rng = random.Random(7)
    names = ["a", "b", "util", "core"]
    files = sorted({
        "/".join(rng.choices(names, k=rng.randint(1, 4))) + rng.choice([".py", ".js", ".ts", ".java"])
        for _ in range(120)
    })
    modules = [".".join(c) for n in (1, 2, 3) for c in itertools.product(names, repeat=n)]
    modules += ["a/b.js", "util/core", "nope"]
    relative = {"python": [".a", "..util.b", ".", "...core"], "java": []}
    script = ["./a", "../util", "./core/b", "../../a/b", "./a.js"]
    language = {".py": "python", ".java": "java"}
    rows = []
    for path in files:
        grammar = language.get(posixpath.splitext(path)[1], "javascript")
        chosen = rng.sample(modules, 10) + relative.get(grammar, script)
        rows += [("r", path, grammar, i, m) for i, m in enumerate(chosen)]
    given = spark.createDataFrame(rows, "repo string, path string, language string, import_no int, module string")
    listed = spark.createDataFrame([("r", f) for f in files], "repo string, path string")
    got = imports.resolve(given, listed).collect()
    assert len(got) == len(rows)
    wrong = [(r.path, r.module, r.target) for r in got if r.target != naive_target(r.path, r.module, files)]
    assert not wrong


def brute_cycles(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    found = set()

    def walk(chain):
        for nxt in after.get(chain[-1], ()):
            if nxt == chain[0]:
                found.add(tuple(chain))
            elif nxt > chain[0] and nxt not in chain:
                walk([*chain, nxt])

    for node in after:
        walk([node])
    return found


def test_cycles_equal_brute_force(spark):
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(24)}
    given = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, src string, dst string")
    rows = cycles.elementary_cycles(given).collect()
    assert len(rows) == len(brute_cycles(edges)) and {tuple(r.chain) for r in rows} == brute_cycles(edges)
    short = cycles.elementary_cycles(given, max_len=3).collect()
    assert {tuple(r.chain) for r in short} == {c for c in brute_cycles(edges) if len(c) <= 3}


def test_degree_sums_equal_edges(spark):
    rng = random.Random(5)
    pairs = {(f"f{rng.randrange(30)}", f"f{rng.randrange(30)}") for _ in range(200)}
    edges = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo string, src string, dst string").select(
        "*", F.lit("file").alias("dst_type"), F.lit("imports").alias("relationship"))
    files = spark.createDataFrame([("r", f"f{i}") for i in range(31)], "repo string, path string")
    rows = graph.degrees(graph.Graph(files, None, edges)).collect()
    assert len(rows) == 31
    assert sum(r.out_degree for r in rows) == sum(r.in_degree for r in rows) == len(pairs)


def test_layered_graph_without_cycles_makes_no_path(spark, monkeypatch):
    made = []
    real = cycles.materialize
    monkeypatch.setattr(cycles, "materialize", lambda df, name: made.append(name) or real(df, name))
    edges = [("r", f"n{a}_{x}", f"n{a + 1}_{y}") for a in range(4) for x in range(3) for y in range(3)]
    df = spark.createDataFrame(edges, "repo string, src string, dst string")
    assert cycles.elementary_cycles(df).count() == 0
    assert len([n for n in made if n.startswith("cycle-paths")]) == 1  # the empty first one


def brute_components(edges):
    """Least node of the strongly connected component of every node that shares one with another."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(start):
        seen, todo = set(), [start]
        while todo:
            for nxt in after.get(todo.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    reach = {n: reached(n) for e in edges for n in e}
    both = {n: {m for m in reach if m != n and m in reach[n] and n in reach[m]} for n in reach}
    return {(n, min([n, *others])) for n, others in both.items() if others}


def test_strong_components_equal_brute_force(spark):
    """Two sparse random graphs and a ladder of cycles that lead into one another."""
    for seed, n, m in ((1, 40, 55), (2, 60, 70)):
        rng = random.Random(seed)
        edges = {(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)}
        rows = [(repo, a, b) for repo in "rs" for a, b in edges]
        given = spark.createDataFrame(rows, "repo string, src string, dst string")
        got = cycles.strong_components(given).collect()
        assert {(r.node, r.component) for r in got} == brute_components(edges)
        assert len(got) == 2 * len(brute_components(edges))
    ladder = [(f"{c}{i}", f"{c}{(i + 1) % 4}") for c in "abcd" for i in range(4)]
    ladder += [("a0", "b2"), ("b1", "c3"), ("d0", "c1"), ("d1", "a2"), ("x", "a0"), ("c0", "y"), ("y", "z"), ("z", "z")]
    given = spark.createDataFrame([("r", a, b) for a, b in ladder], "repo string, src string, dst string")
    assert {(r.node, r.component) for r in cycles.strong_components(given).collect()} == brute_components(ladder)
    assert cycles.strong_components(given.where("src = 'z'")).collect() == []


def test_a_graph_behind_a_cycle_makes_no_path(spark, monkeypatch):
    """Edges without a way back are in no component, though nothing peels them from between two cycles."""
    sizes = {}
    real = cycles.materialize

    def watched(df, name):
        table = real(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(cycles, "materialize", watched)
    edges = [("a", "b"), ("b", "a"), ("y", "z"), ("z", "y"), ("a", "m0_0"), ("a", "m0_1")]
    edges += [(f"m{i}_{x}", f"m{i + 1}_{y}") for i in range(3) for x in range(2) for y in range(2)]
    edges += [("m3_0", "y"), ("m3_1", "y")]
    given = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, src string, dst string")
    found = cycles.elementary_cycles(given).collect()
    assert {tuple(r.chain) for r in found} == {("a", "b"), ("y", "z")} and not any(r.truncated for r in found)
    assert sizes["cycle-steps"] == 4 and sizes["cycle-paths-2"] == 2 and sizes["cycle-paths-3"] == 0


def test_first_cycles_of_a_dense_component(spark):
    """40 nodes that all point at each other have some 10^47 cycles; ten of length two end the search."""
    dense = [("dense", f"n{a:02d}", f"n{b:02d}") for a in range(40) for b in range(40) if a != b]
    rng = random.Random(3)
    sparse = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(24)}
    rows = dense + [("sparse", a, b) for a, b in sparse] + [("one", "a", "a"), ("none", "a", "b")]
    given = spark.createDataFrame(rows, "repo string, src string, dst string")
    got = {}
    for r in cycles.first_cycles(given).orderBy("repo", "rank").collect():
        got.setdefault(r.repo, []).append((r.length, tuple(r.chain), r.truncated))
    assert set(got) == {"dense", "sparse", "one"}
    assert got["dense"] == [(2, ("n00", f"n{i:02d}"), True) for i in range(1, 11)]
    every = sorted((len(c), c) for c in brute_cycles(sparse))
    assert [g[:2] for g in got["sparse"]] == every[:10] and got["one"] == [(1, ("a",), False)]
    assert all(g[2] for g in got["sparse"]) == (len(every) > 10)


def test_truncation_is_told(spark):
    ring = [("r", f"n{i}", f"n{(i + 1) % 5}") for i in range(5)] + [("r", "n1", "n0"), ("s", "a", "b"), ("s", "b", "a")]
    given = spark.createDataFrame(ring, "repo string, src string, dst string")
    short = cycles.elementary_cycles(given, max_len=3).collect()
    assert {(r.repo, tuple(r.chain), r.truncated) for r in short} == {("r", ("n0", "n1"), True), ("s", ("a", "b"), False)}


def test_connected_components(spark):
    """A chain of 10^4 nodes in random order, a star of 5,000, pairs, a self-loop, repeated links."""
    rng = random.Random(9)
    names = list(range(10_000))
    rng.shuffle(names)
    links = list(zip(names, names[1:])) + [(20_000, 20_001 + i) for i in range(5000)]
    links += [(30_002, 30_001), (30_001, 30_002), (30_001, 30_002), (40_000, 40_000), (50_000, 50_001), (50_001, 50_002)]
    given = spark.createDataFrame(links, "a long, b long")
    made = []
    real = components.materialize
    components.materialize = lambda df, name: made.append(name) or real(df, name)
    try:
        got = components.connected(given).collect()
    finally:
        components.materialize = real
    expected = {n: 0 for n in range(10_000)} | {20_000 + i: 20_000 for i in range(5001)}
    expected |= {30_001: 30_001, 30_002: 30_001, 40_000: 40_000, 50_000: 50_000, 50_001: 50_000, 50_002: 50_000}
    assert len(got) == len(expected) and {r.node: r.component for r in got} == expected
    assert made.count("component-moves") <= 16
    assert components.connected(given.limit(0)).collect() == []


def test_file_record_and_absence(tree):
    read = facts(tree([("a.py", "x = 1\n"), ("b.py", "import os\ndef f(): pass\nclass C: pass\n")]))
    lone = graph.file_records(read, "a.py").first()
    assert (lone.imports, lone.functions, lone.classes) == ([], [], [])
    other = graph.file_records(read, "b.py").first()
    assert (len(other.imports), other.functions, other.classes) == (1, ["f"], ["C"])
    assert graph.file_records(read, "c.py").count() == 0
