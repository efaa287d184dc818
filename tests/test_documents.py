"""Graph documents as other programs read them."""

import json
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import Row

from treeline.operators.graph import Graph
from treeline.sources import documents

NODES = "repo string, id string, type string, language string, name string, file string, module string"
EDGES = "repo string, src string, dst string, dst_type string, relationship string, module string"
ODD = 'a "b" <c> & d\té\n中\x01😀'


@pytest.fixture(scope="module")
def graph(spark):
    names = [f"f{i:03d}.py" for i in range(300)] + [ODD]
    nodes = [("big", n, "file", "python", None, None, None) for n in names] + [("o/ther", "x.js", "file", None, None, None, None)]
    edges = [("big", a, b, "file", "imports", b) for a, b in zip(names, names[1:])]
    return Graph(None, spark.createDataFrame(nodes, NODES).repartition(6), spark.createDataFrame(edges, EDGES).repartition(6)), names


def test_node_link_file(spark, graph, tmp_path):
    built, names = graph
    documents.write_graph_documents(spark, built, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["big.json", "o%2Fther.json"]
    big, other = (json.loads((tmp_path / "out" / n).read_text()) for n in ("big.json", "o%2Fther.json"))
    assert (big["directed"], big["multigraph"], big["graph"]) == (True, False, {})
    assert sorted(n["id"] for n in big["nodes"]) == sorted(names) and len(big["links"]) == len(names) - 1
    assert {(e["source"], e["target"]) for e in big["links"]} == set(zip(names, names[1:]))
    assert [n["id"] for n in other["nodes"]] == ["x.js"] and other["links"] == []


def test_gexf_file(spark, graph, tmp_path):
    built, names = graph
    documents.write_graph_documents(spark, built, str(tmp_path / "out"), "gexf")
    root = ET.parse(tmp_path / "out" / "big.gexf").getroot()
    space = {"g": "http://www.gexf.net/1.2draft"}
    found = [n.get("id") for n in root.findall(".//g:node", space)]
    assert sorted(found) == sorted(n.replace("\x01", "") for n in names)
    edges = {(e.get("source"), e.get("target")) for e in root.findall(".//g:edge", space)}
    assert len(edges) == len(names) - 1 and edges <= {(a, b) for a in found for b in found}
    assert {v.get("value") for v in root.findall(".//g:node//g:attvalue", space)} == {"file"}


def test_one_file_is_read_in_splits(spark, graph, tmp_path):
    built, names = graph
    small = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(small)
    spark.conf.set(small, "4k")
    try:
        documents.write_graph_documents(spark, built, str(tmp_path / "json"))
        read = documents.read_node_link(spark, str(tmp_path / "json"))
        assert read.rdd.getNumPartitions() > 3
        rows = read.collect()
        documents.write_graph_documents(spark, built, str(tmp_path / "gexf"), "gexf")
        nodes, edges = documents.read_gexf(spark, str(tmp_path / "gexf"))
        assert nodes.rdd.getNumPartitions() > 3 and edges.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set(small, before)
    assert {(r.directed, r.multigraph) for r in rows} == {(True, False)}
    pairs = set(zip(names, names[1:]))
    assert sorted(r.element.id for r in rows if r.section == "nodes") == sorted([*names, "x.js"])
    assert {(r.element.source, r.element.target, r.element.relationship) for r in rows if r.section == "links"} == {(*p, "imports") for p in pairs}
    plain = lambda n: n.replace("\x01", "")
    assert sorted((r._id, r._label, r.attvalues.attvalue._value) for r in nodes.collect()) == sorted((plain(n), plain(n), "file") for n in [*names, "x.js"])
    assert {(r._source, r._target, r.attvalues.attvalue._value) for r in edges.collect()} == {(plain(a), plain(b), "imports") for a, b in pairs}
    assert len(rows) == 2 * len(names)


def test_a_retried_task_leaves_no_second_fragment(spark, tmp_path):
    rows = [Row(repo="r", section="links", element='{"n":1}'), Row(repo="r", section="nodes", element='{"n":2}')]
    writer = documents.GraphDocumentWriter(str(tmp_path), "json")
    task = type("Task", (), {"partitionId": staticmethod(lambda: 3)})
    kept, documents.TaskContext = documents.TaskContext, type("Context", (), {"get": staticmethod(lambda: task)})
    try:
        with pytest.raises(ZeroDivisionError):
            writer.write(row if row.section == "links" else 1 / 0 for row in rows)
        message = writer.write(iter(rows))
    finally:
        documents.TaskContext = kept
    writer.commit([message, None])
    assert os.listdir(tmp_path) == ["r.json"]
    made = json.loads((tmp_path / "r.json").read_text())
    assert made["nodes"] == [{"n": 2}] and made["links"] == [{"n": 1}]
    writer.abort([])


def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 3)}))}))
    element = lambda repo: Row(repo=repo, section="nodes", element="{}")
    late = documents.GraphDocumentWriter(str(tmp_path), "json")
    late.abort([])
    with pytest.raises(FileNotFoundError):
        late.write(iter([element("r")]))
    assert os.listdir(tmp_path) == []
    between = documents.GraphDocumentWriter(str(tmp_path), "json")

    def rows():
        yield element("r")
        between.abort([])
        yield element("s")

    with pytest.raises(FileNotFoundError):
        between.write(rows())
    assert os.listdir(tmp_path) == []


def test_a_folder_that_fills_again_is_deleted_again(tmp_path, monkeypatch):
    writer, deleted = documents.GraphDocumentWriter(str(tmp_path), "json"), []
    system, root, parts = writer._open()

    class Filled(type(system)):
        def delete_dir(self, path):
            deleted.append(path)
            if len(deleted) < 3:
                raise OSError("Directory not empty")
            system.delete_dir(path)

    monkeypatch.setattr(writer, "_open", lambda: (Filled(), root, parts))
    writer.abort([])
    assert len(deleted) == 3 and os.listdir(tmp_path) == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.dataSource.register(documents.GraphDocument)
    rows = spark.range(10).select(
        F.lit("r").alias("repo"), F.lit("nodes").alias("section"),
        F.when(F.col("id") < 5, F.lit("{}")).otherwise(F.raise_error(F.lit("broken"))).alias("element"),
    )
    with pytest.raises(Exception):
        rows.write.format("graph_document").option("path", str(tmp_path / "out")).mode("append").save()
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    with pytest.raises(ValueError):
        documents.GraphDocumentWriter("x", "dot")
