"""The full analysis of a corpus: every section from one lexical pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from treeline.functions import paths
from treeline.operators import cycles, enrich, functions as spans, graph, imports, lexical
from treeline.operators import metrics, minhash
from treeline.operators.facts import facts
from treeline.operators.jobs import with_final_status
from treeline.session import materialize

ANALYSIS_METHOD = "Lexical scan + dependency tables + MinHash + vector search"


def dependency_graph(facts: DataFrame) -> graph.Graph:
    """Graph of a fact table; resolved imports are written, as nodes and edges both read them."""
    resolved = materialize(imports.resolve(imports.imports(facts), facts), "resolved-imports")
    return graph.build(facts.select("repo", "path", "ext"), spans.defined_names(facts), resolved)


def _top(degrees: DataFrame, by: str, name: str) -> DataFrame:
    """At most five structs per repository, best first."""
    entry = F.struct("rank", "file", F.col(by).alias(name))
    return graph.top_files(degrees, by).groupBy("repo").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("rank")).alias(by)
    )


def dependency_metrics(built: graph.Graph, exclude_third_party: bool = True) -> DataFrame:
    """Graph figures of each repository, top files and the first ten cycles."""
    shown = built.without_externals() if exclude_third_party else built
    degrees = graph.degrees(shown)
    found = materialize(
        cycles.elementary_cycles(shown.edges.where(F.col("dst_type") == "file")), "cycles"
    )
    order = Window.partitionBy("repo").orderBy("length", "chain")
    chains = (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 10)
        .groupBy("repo")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "chain"))), lambda c: c["chain"]
        ).alias("circular_dependency_chains"))
    )
    counted = found.groupBy("repo").agg(F.count(F.lit(1)).alias("circular_dependencies"))
    return (
        graph.graph_stats(shown).drop("total_nodes")
        .join(_top(degrees, "out_degree", "dependencies"), "repo", "left")
        .join(_top(degrees, "in_degree", "dependents"), "repo", "left")
        .join(counted, "repo", "left").join(chains, "repo", "left")
        .withColumnsRenamed({
            "out_degree": "most_dependent_files", "in_degree": "most_depended_on_files",
        })
        .fillna({"circular_dependencies": 0})
    )


# one type per section, so that readers find the same fields whether a section worked or not
SECTION_TYPES = {
    "code_metrics": "loc bigint, marker_comments bigint, files_analyzed bigint, total_functions bigint, "
    "max_complexity bigint, min_complexity bigint, avg_complexity double, low bigint, medium bigint, "
    "high bigint, very_high bigint, debt_score double",
    "dependency_metrics": "total_files bigint, total_functions bigint, total_classes bigint, "
    "total_external_dependencies bigint, total_edges bigint, average_connections_per_node double, "
    "graph_density double, most_dependent_files array<struct<file:string,dependencies:bigint>>, "
    "most_depended_on_files array<struct<file:string,dependents:bigint>>, circular_dependencies bigint, "
    "circular_dependency_chains array<array<string>>",
    "duplication_metrics": "files_analyzed bigint, duplicate_pairs_found bigint, similarity_threshold double, "
    "shingle_size_k int",
    "llm_suggestions": "items array<struct<file_path:string,function_name:string,complexity:bigint,"
    "suggestion:string,original_code:string,error:string>>",
}


@dataclass
class Sections:
    """Runs one section after the other; a failing one keeps its fields, all null, beside its error."""

    errors: list[str] = field(default_factory=list)

    def run(self, label: str, make: Callable[[], DataFrame], name: str) -> DataFrame | Column:
        kinds = T.StructType.fromDDL(SECTION_TYPES[name])
        try:
            section = make()
            fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]
            value = F.struct(*fields, F.lit(None).cast("string").alias("error"))
            return materialize(section.select("repo", value.alias(name)), "section")
        except Exception as failure:  # a broken section must not lose the others
            self.errors.append(f"{label} failed: {failure}")
            fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in kinds]
            return F.struct(*fields, F.lit(str(failure)).alias("error")).alias(name)


def full_report(
    files: DataFrame, job_id: str, exclude_third_party: bool = True, exclude_tests: bool = True,
    scorer: enrich.Scorer = enrich.not_configured,
) -> DataFrame:
    """One nested report row per repository.

    Sections hold figures and bounded lists only. Duplicate pairs, graph rows
    and vectors grow with the corpus and are tables of their own
    (``minhash.duplicates``, ``graph.node_link_rows``, ``search.embed``). Vendored
    files never enter the graph; ``exclude_third_party`` hides its external nodes.
    """
    sections = Sections()

    @cache
    def read() -> DataFrame:
        return materialize(facts(files, exclude_third_party, exclude_tests), "facts")

    @cache
    def functions() -> DataFrame:
        return materialize(spans.functions(read()), "functions")

    def dependencies() -> DataFrame:
        own = read().where(~paths.is_third_party(F.col("path")))
        return dependency_metrics(dependency_graph(own), exclude_third_party)

    def duplication() -> DataFrame:
        source = lexical.source_rows(files, exclude_third_party, exclude_tests)
        found = minhash.duplicates(minhash.scoped(source, "path", "content", "repo"))
        return found.stats().withColumnRenamed("scope", "repo")

    def suggested() -> DataFrame:
        rows = enrich.suggestions(functions(), files, scorer)
        return rows.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(
            "file_path", "function_name", "complexity", "suggestion", "original_code", "error"
        ))).alias("items"))

    parts = [
        sections.run("Code metrics", lambda: metrics.code_metrics(metrics.file_metrics(read()), functions()), "code_metrics"),
        sections.run("Dependency analysis", dependencies, "dependency_metrics"),
        sections.run("Duplication analysis", duplication, "duplication_metrics"),
        sections.run("Suggestions", suggested, "llm_suggestions"),
    ]
    report = files.select("repo").distinct()
    for part in parts:
        if isinstance(part, Column):
            report = report.select("*", part)
        else:
            report = report.join(part, "repo", "left")
    errors = F.array(*[F.lit(e) for e in sections.errors]).cast("array<string>")
    finished = with_final_status(report.withColumn("errors", errors))
    return finished.select(
        F.lit(job_id).alias("job_id"), F.col("repo").alias("repository"), *SECTION_TYPES,
        F.lit(ANALYSIS_METHOD).alias("analysis_method"),
        F.lit(exclude_third_party).alias("excluded_third_party"),
        F.lit(exclude_tests).alias("excluded_tests"),
        F.col("errors").alias("analysis_errors"), "status", "error",
    )


def job_summary(report: DataFrame) -> DataFrame:
    """The four figures shown with a job."""
    return report.select(
        "job_id", "repository",
        F.col("code_metrics.loc").alias("loc"),
        F.col("code_metrics.debt_score").alias("debt_score"),
        F.col("code_metrics.avg_complexity").alias("avg_complexity"),
        F.col("duplication_metrics.duplicate_pairs_found").alias("duplicate_pairs"),
    )
