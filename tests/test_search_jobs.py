"""Search, jobs, sinks, suggestions and the report."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import enrich, functions as spans, graph, jobs, search
from treeline.operators.facts import facts
from treeline.plans import report
from treeline.plans.report import dependency_graph
from treeline.sources import sinks
from tests.conftest import GOLDEN


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(300, 8)).astype(np.float32)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix[250:] = matrix[0]  # ties
    rows = [(f"d{i:03d}", v.tolist()) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id string, embedding array<float>").repartition(7), dict(rows)


@pytest.mark.parametrize("tiles", [(512, 4096), (5, 16)])
def test_search_equals_full_sort(spark, vectors, tiles):
    table, values = vectors
    asked = [(i, values[f"d{i:03d}"]) for i in range(12)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.id for r in search.search(table, queries, 10, *tiles).collect()}
    for q, vector in asked:
        scores = {i: round(float(np.dot(np.float64(v), np.float64(vector))), 6) for i, v in values.items()}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:10]
        assert [got[q, r] for r in range(1, 11)] == best


def test_search_limits(spark, vectors):
    table, _ = vectors
    queries = table.limit(0).select(F.lit(0).cast("long").alias("query_id"), "embedding")
    with pytest.raises(ValueError):
        search.search(table, queries, 51)
    assert search.search(table, queries, 5).count() == 0
    with pytest.raises(ValueError):
        search.search_text(table, "ab")


def test_many_queries_stay_off_the_driver(spark, vectors, monkeypatch):
    """50,000 queries: nothing is collected or broadcast by hand while the search is built."""
    table, values = vectors
    names = sorted(values)[:250]
    every = spark.range(50_000).withColumn("at", F.col("id") % 250)
    known = spark.createDataFrame([(i, values[n]) for i, n in enumerate(names)], "at long, embedding array<float>")
    queries = every.join(known, "at").select(F.col("id").alias("query_id"), "embedding")

    def refuse(*_):
        raise AssertionError("rows went to the driver")

    kind = type(queries)
    with monkeypatch.context() as patched:
        for name in ("collect", "toPandas", "toArrow", "toLocalIterator"):
            patched.setattr(kind, name, refuse)
        patched.setattr(type(spark.sparkContext), "broadcast", refuse)
        found = search.search(table, queries, 3)
        assert found.count() == 150_000
    own = found.where("rank = 1").withColumn("wanted", F.format_string("d%03d", F.col("query_id") % 250))
    assert own.where("score < 0.999999").isEmpty() and own.where("id <> wanted and score < 1.0").isEmpty()


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    """A stub model gives the vectors of one batch call, whatever the batches, and tells who loaded it."""
    loads = str(tmp_path / "loads")

    def load():
        import os

        with open(loads, "a") as log:
            log.write(f"{os.getpid()}\n")
        factors = np.random.default_rng(11).normal(size=(128, 6)).astype(np.float32)

        def predict(texts):
            counts = np.zeros((len(texts), 128), np.float32)
            for row, one in zip(counts, texts):
                for c in one:
                    row[ord(c) % 128] += 1
            return counts @ factors

        return predict

    texts = [(i, " ".join(["red", "blue", "x" * (i % 5)][: 1 + i % 3])) for i in range(200)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(texts, "n long, t string").repartition(8)
    got = {r.id: r.embedding for r in search.embed_with_model(docs, "n", "t", load, batch_rows=7).collect()}
    pids = open(loads).read().split()
    assert len(pids) == len(set(pids))
    plain = load()([t or "" for _, t in texts])
    norms = np.linalg.norm(plain.astype(np.float64), axis=1, keepdims=True)
    unit = np.divide(plain, norms, out=np.zeros_like(plain, dtype=np.float64), where=norms > 0)
    assert np.allclose([got[i] for i, _ in texts], unit, atol=1e-6) and not any(got[200]) and not any(got[201])
    found = search.search(
        search.embed_with_model(docs, "n", "t", load), search.embed_with_model(docs.limit(3), "n", "t", load).withColumnRenamed("id", "query_id"), 1
    )
    assert all(r.score >= 0.999999 for r in found.collect())


def test_short_queries_get_a_reason(spark):
    asked = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc"), (4, "")], "item long, t string")
    accepted, refused = search.judged_queries(asked, "item", "t")
    assert [r.item for r in accepted.collect()] == [3]
    assert {(r.query_id, r.reason) for r in refused.collect()} == {(i, "a query needs at least 3 characters") for i in (1, 2, 4)}


def test_text_finds_itself(spark):
    rng = random.Random(2)
    texts = [(f"n{i}.md", " ".join(rng.choices(["red", "blue", "green", "sum", "map", "fold"], k=20)) + f" u{i}") for i in range(40)]
    table = search.embed(spark.createDataFrame(texts, "id string, t string"), "id", "t")
    top = search.search_text(table, texts[7][1], 1).first()
    assert (top.id, top.score) == ("n7.md", 1.0)


def test_index_admission(tree):
    got = search.indexable(tree([
        ("a.MD", "x" * 21), ("b.md", "x" * 20), ("c.txt", " \n" * 30 + "x"), ("lib/d.py", "x" * 30),
        ("tests/e.py", "x" * 30), ("f.png", "x" * 30), ("g.yaml", " " + "y" * 21 + "\n"),
    ]))
    assert {r.path for r in got.collect()} == {"a.MD", "g.yaml"}


def test_job_states(spark):
    rows = [
        ("j1", 1, "2024-01-01 00:00:01", "url", "PENDING", None, None),
        ("j1", 2, "2024-01-01 00:00:02", None, "RUNNING", None, None),
        ("j1", 3, "2024-01-01 00:00:02", None, "COMPLETED", "slow", "p1"),
        ("j2", 1, "2024-01-01 00:00:05", "u2", "FAILED", "bad", None),
        ("j3", 1, "2024-01-01 00:00:05", "u3", "RUNNING", None, None),
    ]
    changes = spark.createDataFrame(
        rows, "job_id string, seq int, ts string, repo_url string, status string, error string, report_path string"
    ).withColumn("ts", F.to_timestamp("ts"))
    current = jobs.current_jobs(changes)
    by_id = {r.job_id: r for r in jobs.status_view(current).collect()}
    assert (by_id["j1"].status, by_id["j1"].repo_url, by_id["j1"].error) == ("COMPLETED", "url", None)
    assert by_id["j1"].created_at == "2024-01-01T00:00:01.000000"
    assert (by_id["j2"].error, by_id["j2"].results_url) == ("bad", None)
    reports = spark.createDataFrame([("j1", "R"), ("j3", "S")], "job_id string, report string")
    seen = {r.job_id: (r.error, r.report) for r in jobs.results_view(current, reports).collect()}
    assert seen == {"j1": (None, "R"), "j2": ("Job failed: bad", None), "j3": ("Job is RUNNING", None)}


def test_final_status(spark):
    rows = spark.createDataFrame(
        [(1, []), (2, ["Could not read x"]), (3, ["x", "Dependency analysis failed: y"]), (4, ["a" * 2000])],
        "i int, errors array<string>")
    got = {r.i: (r.status, r.error and len(r.error)) for r in jobs.with_final_status(rows).collect()}
    assert got == {1: ("COMPLETED", None), 2: ("COMPLETED", 16), 3: ("FAILED", 32), 4: ("COMPLETED", 1000)}


def test_suggestions_survive_failures(tree):
    body = "function g(x) {\n" + "if (x) { y(); }\n" * 11 + "}\n"
    files = tree([("a.js", body), ("b.js", body.replace("g(", "h(", 1))])

    def scorer(prompt):
        if "h(x)" in prompt:
            raise RuntimeError("busy")
        return "smaller"

    rows = enrich.suggestions(spans.functions(facts(files)), files, scorer).orderBy("file_path").collect()
    assert [(r.function_name, r.complexity, r.suggestion, r.error) for r in rows] == [
        ("g", 12, "smaller", None),
        ("h", 12, "Could not generate suggestion: busy", "Suggestion failed for h: busy"),
    ]
    assert rows[0].original_code == body.rstrip("\n")


def test_report_of_the_golden_tree(spark, tree, tmp_path):
    made = report.full_report(tree(GOLDEN), "job-7")
    row = made.first()
    assert row.analysis_errors == []
    assert (row.code_metrics.debt_score, row.dependency_metrics.total_edges) == (10.02, 8)
    assert row.dependency_metrics.circular_dependency_chains == [["web/a.js", "web/b.js"]]
    assert row.dependency_metrics.most_dependent_files[0].file == "util/text.py"
    assert row.duplication_metrics.duplicate_pairs_found == 0
    assert report.job_summary(made).first().loc == 18
    sinks.write_report(made, str(tmp_path / "r"))
    again = sinks.read_report(spark, str(tmp_path / "r"), made.schema, "job-7").first()
    assert again.code_metrics == row.code_metrics
    with pytest.raises(FileNotFoundError):
        sinks.read_report(spark, str(tmp_path / "r"), made.schema, "job-8")


def test_broken_section_keeps_the_others(tree, monkeypatch):
    def broken(*_):
        raise RuntimeError("boom")

    monkeypatch.setattr(report.minhash, "duplicates", broken)
    row = report.full_report(tree(GOLDEN), "job-9").first()
    assert row.analysis_errors == ["Duplication analysis failed: boom"]
    assert row.code_metrics.loc == 18 and row.duplication_metrics.error == "boom"


def test_sinks(spark, golden, vectors, tmp_path):
    built = dependency_graph(golden)
    sinks.write_node_link(graph.node_link_rows(built), str(tmp_path / "nl"))
    assert spark.read.json(f"{tmp_path}/nl/repo=r/section=nodes").count() == 11
    assert set(spark.read.json(f"{tmp_path}/nl/repo=r/section=links").columns) == {"source", "target", "relationship", "module"}
    sinks.write_gexf(built, str(tmp_path / "gexf"))
    assert spark.read.option("rowTag", "edge").format("xml").load(f"{tmp_path}/gexf/edges").count() == 10
    table, values = vectors
    sinks.write_vectors(table.withColumn("job_id", F.lit("j")), str(tmp_path / "v"))
    assert sinks.read_vectors(spark, str(tmp_path / "v"), "j").count() == len(values)


@pytest.mark.parametrize("sizes", [(40,), (1, 39), (10, 10, 10, 10)])
def test_snapshot_equals_all_changes(spark, tmp_path, sizes):
    """Any split into batches, each merged twice and one delivered twice; late changes; a broken attempt."""
    pick = random.Random(sum(sizes) + len(sizes))
    rows = [
        (f"j{pick.randrange(6)}", i, f"2024-01-01 00:00:{pick.randrange(60):02d}", pick.choice([None, f"u{i}"]),
         pick.choice(["PENDING", "RUNNING", None]), pick.choice([None, f"e{i}"]), None, None) for i in range(40)
    ]
    schema = "job_id string, seq long, ts string, repo_url string, status string, error string, report_path string, summary string"
    changes = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    at, snapshots, start = str(tmp_path / "changes"), str(tmp_path / "snapshots"), 0
    for number, size in enumerate(sizes):
        batch = changes.where((F.col("seq") >= start) & (F.col("seq") < start + size))
        for _ in range(2):
            jobs.write_batch(batch, at, number)
            got = jobs.refresh_snapshot(spark, at, snapshots)
        start += size
        expected = jobs.current_jobs(changes.where(F.col("seq") < start))
        assert sorted(map(str, got.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    unfinished = tmp_path / "snapshots" / "through=000000000099"
    unfinished.mkdir()
    (unfinished / "part-0.parquet").write_bytes(b"half")
    again = jobs.refresh_snapshot(spark, at, snapshots)
    assert sorted(map(str, again.select(expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_equal_queries_and_null_vectors(spark, vectors):
    table, values = vectors
    more = table.unionByName(spark.createDataFrame([("none", None)], table.schema))
    vector = values["d003"]
    asked = spark.createDataFrame([(1, vector), (2, vector), (2, vector), (3, None)], "query_id long, embedding array<float>")
    rows = search.search(more, asked, 1, query_tile=1).collect()
    assert sorted((r.query_id, r.id, r.rank) for r in rows) == [(1, "d003", 1), (2, "d003", 1)]


def test_failed_section_leaves_nulls_and_a_failed_job(spark, tree, monkeypatch):
    def broken(*_):
        raise RuntimeError("no pairs today")

    monkeypatch.setattr(report.minhash, "duplicates", broken)
    made = report.full_report(tree(GOLDEN), "job-9")
    row = made.first()
    assert (row.status, row.analysis_errors) == ("FAILED", ["Duplication analysis failed: no pairs today"])
    assert row.duplication_metrics.error == "no pairs today" and row.code_metrics.error is None
    summary = report.job_summary(made).first()
    assert (summary.loc, summary.duplicate_pairs) == (18, None)


def test_vendored_files_stay_out_of_the_graph(tree):
    files = tree([("node_modules/m/a.js", "function f() { return 1; }\n"), ("src/b.js", "function g() { return 1; }\n")])
    row = report.full_report(files, "job-8", exclude_third_party=False).first()
    assert (row.code_metrics.files_analyzed, row.dependency_metrics.total_files) == (2, 1)


def test_changes_are_appended(spark, tmp_path):
    kind = "job_id string, seq long, ts timestamp, repo_url string, status string, error string, report_path string, summary string"
    for seq, status, summary in ((1, "RUNNING", None), (2, "COMPLETED", "loc=3")):
        jobs.append_changes(spark.sql("select 'j' job_id").selectExpr(
            "job_id", f"{seq}L as seq", f"timestamp_seconds({seq}) as ts", "'u' as repo_url", f"'{status}' as status",
            "cast(null as string) error", "cast(null as string) report_path",
            f"cast({'null' if summary is None else repr(summary)} as string) summary",
        ), f"{tmp_path}/changes")
    seen = jobs.status_view(jobs.current_jobs(spark.read.schema(kind).parquet(f"{tmp_path}/changes"))).first()
    assert (seen.status, seen.summary) == ("COMPLETED", "loc=3")
