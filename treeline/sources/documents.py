"""One document per graph: a Python data source that writes node-link JSON or GEXF files.

Every task writes the elements of its rows as fragments of their own, under names
that no other attempt uses. When all tasks have ended, header, fragments in order
and footer are copied into one file per repository, block by block, and the folder
of fragments goes with whatever failed attempts left there. Tasks never make that
folder, so those that outlive a failed job find none and end. Elements are never
gathered; only the names of fragments reach the driver.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from treeline.operators.graph import Graph, node_link_rows

# The frames of both formats, around the elements of nodes and of links.
_FRAMES = {
    "json": ('{"directed":true,"multigraph":false,"graph":{},"nodes":[\n', '\n],"links":[\n', "\n]}\n", ",\n"),
    "gexf": (
        "<?xml version='1.0' encoding='utf-8'?>\n"
        '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n'
        '<graph defaultedgetype="directed" mode="static">\n<attributes class="node" mode="static">\n'
        '<attribute id="0" title="type" type="string"/>\n</attributes>\n<attributes class="edge" mode="static">\n'
        '<attribute id="1" title="relationship" type="string"/>\n</attributes>\n<nodes>\n',
        "\n</nodes>\n<edges>\n", "\n</edges>\n</graph>\n</gexf>\n", "\n",
    ),
}
_SECTIONS = ("nodes", "links")
_COPIED = 1 << 22  # bytes copied at once
_TRIES = 20  # to delete a folder that tasks of a failed job still write to


@dataclass
class Fragments(WriterCommitMessage):
    """``(repo, section, task, number, name)`` of the fragments that one task has written."""

    written: list[tuple[str, str, int, int, str]]


class GraphDocumentWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str):
        if kind not in _FRAMES:
            raise ValueError(f"kind must be one of {sorted(_FRAMES)}")
        self.path, self.kind = path.rstrip("/"), kind
        self.parts = f"{self.path}/_fragments-{uuid.uuid4().hex}"
        system, _, parts = self._open()
        system.create_dir(parts, recursive=True)

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, root, f"{root}/{self.parts.rsplit('/', 1)[1]}"

    @staticmethod
    def _is_dir(system: fs.FileSystem, path: str) -> bool:
        return system.get_file_info(path).type == fs.FileType.Directory

    def write(self, iterator: Iterator[Row]) -> Fragments:
        """Rows come sorted by repository and section; each run of them is a fragment."""
        system, _, parts = self._open()
        between = _FRAMES[self.kind][3].encode()
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        written, current, stream = [], None, None
        try:
            for row in iterator:
                if (row.repo, row.section) != current:
                    if stream is not None:
                        stream.close()
                    current = row.repo, row.section
                    name = f"{task}-{len(written)}-{attempt}"
                    written.append((*current, task, len(written), name))
                    if not self._is_dir(system, parts):  # some file systems would make it with the file
                        raise FileNotFoundError(f"{parts}: the job is over")
                    stream = system.open_output_stream(f"{parts}/{name}")
                else:
                    stream.write(between)
                stream.write(row.element.encode())
        finally:
            if stream is not None:
                stream.close()
        return Fragments(written)

    def commit(self, messages: list[Fragments | None]) -> None:
        system, root, parts = self._open()
        system.create_dir(root, recursive=True)
        start, *_, between = _FRAMES[self.kind]
        by_repo: dict[str, list[tuple]] = {}
        for message in messages:
            for fragment in message.written if message is not None else ():
                by_repo.setdefault(fragment[0], []).append(fragment)
        for repo, own in by_repo.items():
            with system.open_output_stream(f"{root}/{quote(repo, safe='')}.{self.kind}") as out:
                out.write(start.encode())
                for section, after in zip(_SECTIONS, _FRAMES[self.kind][1:3]):
                    names = [f[4] for f in sorted((f for f in own if f[1] == section), key=lambda f: f[2:4])]
                    for i, name in enumerate(names):
                        if i:
                            out.write(between.encode())
                        with system.open_input_stream(f"{parts}/{name}") as read:
                            while block := read.read(_COPIED):
                                out.write(block)
                    out.write(after.encode())
        self.abort(messages)  # what remains are fragments

    def abort(self, messages: list[Fragments | None]) -> None:
        system, _, parts = self._open()
        for left in reversed(range(_TRIES)):
            try:
                if self._is_dir(system, parts):
                    system.delete_dir(parts)
                return
            except OSError:  # a fragment came while the folder was emptied
                if not left:
                    raise
                time.sleep(0.1)


class GraphDocument(DataSource):
    """Writer of ``repo, section, element`` rows; options ``path`` and ``kind`` (``json`` or ``gexf``)."""

    @classmethod
    def name(cls) -> str:
        return "graph_document"

    def writer(self, schema: StructType, overwrite: bool) -> GraphDocumentWriter:
        return GraphDocumentWriter(self.options["path"], self.options.get("kind", "json"))


def _attribute(value: Column) -> Column:
    """Text as an XML attribute: escaped, without characters that XML has no way to write."""
    shown = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        shown = F.replace(shown, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), shown, F.lit('"'))


def _gexf_rows(graph: Graph) -> DataFrame:
    def value(number: str, column: str) -> list[Column]:
        return [F.lit(f'<attvalues><attvalue for="{number}" value='), _attribute(F.col(column)), F.lit("/></attvalues>")]

    nodes = graph.nodes.select("repo", F.lit("nodes").alias("section"), F.concat(
        F.lit("<node id="), _attribute(F.col("id")), F.lit(" label="), _attribute(F.col("id")), F.lit(">"), *value("0", "type"), F.lit("</node>"),
    ).alias("element"))
    name = F.concat_ws("->", "src", "dst")
    links = graph.edges.select("repo", F.lit("links").alias("section"), F.concat(
        F.lit("<edge id="), _attribute(name), F.lit(" source="), _attribute(F.col("src")), F.lit(" target="), _attribute(F.col("dst")),
        F.lit(">"), *value("1", "relationship"), F.lit("</edge>"),
    ).alias("element"))
    return nodes.unionByName(links)


def write_graph_documents(spark: SparkSession, graph: Graph, path: str, kind: str = "json") -> None:
    """A file ``<repo>.json`` or ``<repo>.gexf`` below ``path`` for every repository that has a node.

    Elements are dealt out by ranges of repository and section, so that a large graph
    is written by many tasks and a small one by one.
    """
    rows = _gexf_rows(graph) if kind == "gexf" else node_link_rows(graph).withColumnRenamed("json", "element")
    spark.dataSource.register(GraphDocument)
    order = ["repo", "section", "element"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("repo", "section", "element").write.format(
        GraphDocument.name()
    ).option("path", path).option("kind", kind).mode("append").save()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of graph documents. Elements have a line each, so a file is read in splits."""
    read = spark.read.text(path, lineSep="\n")
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_node_link(spark: SparkSession, path: str) -> DataFrame:
    """``directed, multigraph, section, element`` of the JSON documents below ``path``."""
    head = F.lit('{"directed":')
    lines = _lines(spark, path)
    flags = lines.where(F.col("line").startswith(head)).select(
        "file", F.from_json(F.concat("line", F.lit("]}")), "directed boolean, multigraph boolean").alias("flags")
    ).select("file", "flags.*")
    element = F.from_json(
        F.regexp_replace("line", ",$", ""), "id string, type string, source string, target string, relationship string"
    )
    elements = lines.where(F.col("line").startswith("{") & ~F.col("line").startswith(head)).select("file", element.alias("element"))
    is_link = F.coalesce("element.source", "element.target", "element.relationship").isNotNull()
    return elements.join(F.broadcast(flags), "file").select(
        "directed", "multigraph", F.when(is_link, "links").otherwise("nodes").alias("section"), "element"
    )


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``_id, _label, attvalues`` and edges ``_source, _target, attvalues`` of the GEXF documents below ``path``."""
    value = "attvalues struct<attvalue:struct<_for:string,_value:string>>"

    def elements(tag: str, schema: str) -> DataFrame:
        own = _lines(spark, path).where(F.col("line").startswith(f"<{tag} "))
        return own.select(F.from_xml("line", schema).alias("element")).select("element.*")

    return elements("node", f"_id string, _label string, {value}"), elements("edge", f"_source string, _target string, {value}")
