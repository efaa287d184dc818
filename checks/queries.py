"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from treeline.functions import paths, scores, text, values
from treeline.operators import components, cycles, enrich, functions as spans, graph, imports, jobs
from treeline.operators import lexical, metrics, minhash, search, simhash, similarity
from treeline.operators.facts import facts
from treeline.plans import report
from treeline.session import configure, materialize, new_path
from treeline.sources import documents, files as tree, fixture, sinks
from treeline.sources.tables import read_documents, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    @wraps(make)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(configure(spark), sf_dir)

    QUERIES[make.__name__] = run
    return run


def _files(spark, sf_dir) -> DataFrame:
    return fixture.source_files(read_documents(spark, sf_dir))


def _lexed(spark, sf_dir) -> DataFrame:
    return lexical.lex(lexical.source_rows(_files(spark, sf_dir)))


def _facts(spark, sf_dir) -> DataFrame:
    return facts(_files(spark, sf_dir))


def _functions(spark, sf_dir) -> DataFrame:
    return spans.functions(_facts(spark, sf_dir))


def _graph(spark, sf_dir) -> graph.Graph:
    read = _facts(spark, sf_dir).select("repo", "path", "ext", "language", "defined", "imported")
    return report.dependency_graph(materialize(read, "facts"))


def _docs(spark, sf_dir) -> DataFrame:
    return minhash.scoped(read_documents(spark, sf_dir), "doc_id", "text")


# --- paths and text -------------------------------------------------------

@query
def path_facts(spark, sf_dir):
    path = F.col("path")
    located = _files(spark, sf_dir).select(F.concat(F.lit("/work/tree/"), path).alias("full"))
    return located.select(paths.relative_path(F.col("full"), "/work/tree").alias("path")).select(
        "path", paths.extension(path).alias("ext"), paths.base_name(path).alias("base"),
        paths.language(path).alias("language"), paths.is_third_party(path).alias("third_party"),
        paths.is_test(path).alias("test"), paths.parent_dir(path).alias("directory"),
    )


@query
def page_paths(spark, sf_dir):
    bare = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    return read_table(spark, sf_dir, "pages").select("page_id", bare.alias("path")).select(
        "page_id", paths.extension(F.col("path")).alias("ext"),
        paths.base_name(F.col("path")).alias("base"), paths.parent_dir(F.col("path")).alias("directory"),
    )


@query
def kept_files(spark, sf_dir):
    return lexical.source_rows(_files(spark, sf_dir)).select("path", "ext", "language")


@query
def kept_with_tests(spark, sf_dir):
    return lexical.source_rows(_files(spark, sf_dir), exclude_tests=False).select("path", "language")


@query
def kept_with_third_party(spark, sf_dir):
    return lexical.source_rows(_files(spark, sf_dir), exclude_third_party=False).select("path", "language")


@query
def search_corpus(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select(
        F.concat(F.lit("notes/d"), "doc_id", F.lit(".MD")).alias("path"), F.col("text").alias("content")
    )
    files = _files(spark, sf_dir).select("path", "content")
    return search.indexable(files.unionByName(docs)).select(
        "path", F.length("content").alias("chars")
    )


@query
def normalized_text(spark, sf_dir):
    t = F.col("text")
    return read_documents(spark, sf_dir).select(
        "doc_id", F.md5(text.collapse_space(t)).alias("collapsed"),
        F.md5(text.word_chars(t)).alias("word_chars"), text.stripped_length(t).alias("stripped_chars"),
    )


@query
def lossy_decoding(spark, sf_dir):
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C328FF")))
    return read_documents(spark, sf_dir).select("doc_id", F.md5(text.decode_lossy(broken)).alias("decoded"))


@query
def unquoted_modules(spark, sf_dir):
    quoted = F.concat(F.lit("'\""), "event_type", F.lit("\"'"))
    return read_table(spark, sf_dir, "events").select(
        "event_id", text.unquote(quoted).alias("module"),
        paths.external_id(text.unquote(quoted)).alias("node_id"),
        paths.module_path(F.concat(F.lit("a."), "event_type")).alias("module_path"),
    )


@query
def relative_modules(spark, sf_dir):
    module = F.concat(F.lit("./x/../../m"), "doc_id", F.lit("/./u"))
    return read_documents(spark, sf_dir).select(
        "doc_id", paths.join_relative(F.concat(F.lit("src/"), "lang"), module).alias("target")
    )


@query
def tree_scan(spark, sf_dir):
    """The derived files, written to a folder as files and read back by a scan of it."""
    root = new_path(spark, "tree")

    def write(batches):
        for batch in batches:
            system, base = fs.FileSystem.from_uri(root)
            for path, content in zip(batch["path"], batch["content"]):
                system.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{base}/{path}") as stream:
                    stream.write(content.encode())
            yield batch[["path"]]

    written = _files(spark, sf_dir).select("path", "content").mapInPandas(write, "path string")
    written.write.format("noop").mode("overwrite").save()
    return tree.scan_tree(spark, root, "r", exclude_third_party=True).select(
        "path", F.length("content").alias("chars"), "error"
    )


# --- lines, comments, markers ---------------------------------------------

@query
def line_classes(spark, sf_dir):
    return lexical.lines(_lexed(spark, sf_dir)).groupBy("path").agg(
        *[F.count_if(F.col("line_class") == c).alias(c) for c in ("code", "comment", "blank")]
    )


@query
def file_comments(spark, sf_dir):
    return lexical.comments(_lexed(spark, sf_dir)).select("path", "comment_no", "comment")


@query
def file_metrics(spark, sf_dir):
    return metrics.file_metrics(_facts(spark, sf_dir)).drop("repo")


@query
def document_lines(spark, sf_dir):
    t = F.col("text")
    return read_documents(spark, sf_dir).select(
        "doc_id", text.line_count(t).alias("filled_lines"), text.marker_lines(t).alias("marker_lines"),
        text.has_marker(t).alias("has_marker"),
    )


@query
def corpus_size(spark, sf_dir):
    per_language = metrics.total_metrics(metrics.file_metrics(_facts(spark, sf_dir)), "language")
    debt = scores.debt_score(F.col("loc"), F.col("marker_comments"), F.lit(0))
    return per_language.withColumn("debt", debt)


@query
def document_debt(spark, sf_dir):
    t = F.col("text")
    per_source = read_documents(spark, sf_dir).groupBy("source", "lang").agg(
        F.sum(text.line_count(t)).alias("loc"), F.sum(text.marker_lines(t)).alias("markers"),
    )
    debt = scores.debt_score(F.col("loc") * 1000, F.col("markers"), F.lit(0))
    return per_source.withColumn("debt", debt).withColumn("severity", scores.debt_severity(F.col("debt")))


# --- functions and complexity -----------------------------------------------

@query
def function_spans(spark, sf_dir):
    return _functions(spark, sf_dir).drop("repo")


@query
def file_definitions(spark, sf_dir):
    return spans.definitions(_facts(spark, sf_dir)).drop("repo")


@query
def function_summary(spark, sf_dir):
    read = materialize(_facts(spark, sf_dir), "facts")
    return metrics.function_summary(metrics.file_metrics(read), spans.functions(read)).drop("repo")


@query
def complexity_shares(spark, sf_dir):
    read = materialize(_facts(spark, sf_dir), "facts")
    return metrics.complexity_shares(
        metrics.function_summary(metrics.file_metrics(read), spans.functions(read))
    ).drop("repo")


@query
def complexity_severities(spark, sf_dir):
    return _functions(spark, sf_dir).select(
        "path", "name", scores.complexity_severity(F.col("complexity")).alias("severity")
    )


@query
def complex_functions(spark, sf_dir):
    files = _files(spark, sf_dir)
    found = metrics.complex_functions(_functions(spark, sf_dir))
    return spans.with_content(found, files).select("path", "name", "complexity", "content")


@query
def first_complex_functions(spark, sf_dir):
    return enrich.first_complex(_functions(spark, sf_dir)).select("path", "name", "complexity", "rank")


@query
def most_complex_functions(spark, sf_dir):
    return enrich.first_complex(_functions(spark, sf_dir), by_complexity=True).select(
        "path", "name", "complexity", "rank"
    )


@query
def refactor_prompts(spark, sf_dir):
    files = _files(spark, sf_dir)
    chosen = spans.with_content(enrich.first_complex(_functions(spark, sf_dir)), files)
    return chosen.select("path", text.refactor_prompt(F.col("content")).alias("prompt"))


@query
def refactor_suggestions(spark, sf_dir):
    def scorer(prompt: str) -> str:
        if "function" in prompt.split("---")[1]:
            raise ValueError("no answer")
        return f"{prompt.split('---')[1].count(chr(10))} lines"

    return enrich.suggestions(_functions(spark, sf_dir), _files(spark, sf_dir), scorer).drop("repo")


@query
def code_metrics(spark, sf_dir):
    read = materialize(_facts(spark, sf_dir), "facts")
    return metrics.code_metrics(metrics.file_metrics(read), spans.functions(read)).drop("repo")


# --- imports and graph -------------------------------------------------------

@query
def file_imports(spark, sf_dir):
    return imports.imports(_facts(spark, sf_dir)).select(
        "path", "import_no", "type", "module", F.array_join("items", ",").alias("items")
    )


@query
def resolved_imports(spark, sf_dir):
    read = materialize(_facts(spark, sf_dir).select("repo", "path", "language", "imported"), "facts")
    return imports.resolve(imports.imports(read), read).select(
        "path", "import_no", "module", "target"
    )


@query
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir).nodes.drop("repo")


@query
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges.drop("repo")


@query
def graph_edges_without_externals(spark, sf_dir):
    return _graph(spark, sf_dir).without_externals().edges.drop("repo")


@query
def node_counts(spark, sf_dir):
    return graph.node_counts(_graph(spark, sf_dir).nodes).drop("repo")


@query
def file_degrees(spark, sf_dir):
    return graph.degrees(_graph(spark, sf_dir)).drop("repo")


@query
def graph_stats(spark, sf_dir):
    return graph.graph_stats(_graph(spark, sf_dir)).drop("repo")


@query
def most_dependent_files(spark, sf_dir):
    return graph.top_files(graph.degrees(_graph(spark, sf_dir)), "out_degree").drop("repo")


@query
def most_depended_on_files(spark, sf_dir):
    return graph.top_files(graph.degrees(_graph(spark, sf_dir)), "in_degree").drop("repo")


@query
def folder_keys(spark, sf_dir):
    return graph.folder_keys(_graph(spark, sf_dir).nodes).drop("repo")


@query
def file_neighbours(spark, sf_dir):
    return graph.neighbours(_graph(spark, sf_dir).edges).drop("repo")


@query
def file_records(spark, sf_dir):
    return graph.file_records(_facts(spark, sf_dir)).select(
        "file", F.size("imports").alias("imports"), F.array_join(F.sort_array("functions"), ",").alias("functions"),
        F.array_join(F.sort_array("classes"), ",").alias("classes"),
    )


@query
def node_link_rows(spark, sf_dir):
    return graph.node_link_rows(_graph(spark, sf_dir)).drop("repo")


@query
def gexf_edges(spark, sf_dir):
    path = new_path(spark, "gexf")
    sinks.write_gexf(_graph(spark, sf_dir), path)
    schema = "_id string, _source string, _target string, _relationship string"
    read = spark.read.option("rowTag", "edge").schema(schema).format("xml").load(f"{path}/edges")
    return read.select(
        F.col("_source").alias("source"), F.col("_target").alias("target"),
        F.col("_relationship").alias("relationship"),
    )


@query
def graph_document(spark, sf_dir):
    """Nodes and links as the one node-link file holds them."""
    path = new_path(spark, "graph-document")
    documents.write_graph_documents(spark, _graph(spark, sf_dir), path)
    read = documents.read_node_link(spark, path)
    e, is_link = F.col("element"), F.col("section") == "links"
    return read.select(
        "directed", "multigraph", "section", F.when(is_link, e["source"]).otherwise(e["id"]).alias("a"),
        F.when(is_link, e["target"]).otherwise(e["type"]).alias("b"), F.when(is_link, e["relationship"]).otherwise("").alias("kind"),
    )


@query
def gexf_document(spark, sf_dir):
    """Nodes and edges as the one GEXF file holds them."""
    path = new_path(spark, "gexf-document")
    documents.write_graph_documents(spark, _graph(spark, sf_dir), path, "gexf")
    nodes, edges = documents.read_gexf(spark, path)
    return nodes.select(
        F.lit("node").alias("section"), F.col("_id").alias("a"), F.col("_label").alias("b"), F.col("attvalues.attvalue._value").alias("kind")
    ).unionByName(edges.select(
        F.lit("edge").alias("section"), F.col("_source").alias("a"), F.col("_target").alias("b"), F.col("attvalues.attvalue._value").alias("kind")
    ))


@query
def file_cycles(spark, sf_dir):
    edges = _graph(spark, sf_dir).edges.where(F.col("dst_type") == "file")
    return cycles.elementary_cycles(edges).select("length", F.array_join("chain", " > ").alias("chain"))


@query
def first_cycles(spark, sf_dir):
    edges = _graph(spark, sf_dir).edges.where(F.col("dst_type") == "file")
    return cycles.first_cycles(edges, k=10).orderBy("length", "chain").limit(10).select(
        "length", F.array_join("chain", " > ").alias("chain")
    )


@query
def file_components(spark, sf_dir):
    edges = _graph(spark, sf_dir).edges.where(F.col("dst_type") == "file")
    return cycles.strong_components(edges).drop("repo")


def _transitions(spark, sf_dir) -> DataFrame:
    """Event types that follow one another for a user within a day."""
    in_day = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return (
        read_table(spark, sf_dir, "events")
        .select(
            F.lit("events").alias("repo"), F.col("event_type").alias("src"),
            F.lead("event_type").over(in_day).alias("dst"),
        )
        .where(F.col("dst").isNotNull()).distinct()
    )


@query
def event_cycles(spark, sf_dir):
    return cycles.elementary_cycles(_transitions(spark, sf_dir)).select(
        "length", F.array_join("chain", " > ").alias("chain")
    )


@query
def event_components(spark, sf_dir):
    return cycles.strong_components(_transitions(spark, sf_dir)).drop("repo")


@query
def event_graph_stats(spark, sf_dir):
    edges = _transitions(spark, sf_dir)
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    nodes = ends.distinct().select(F.lit("events").alias("repo"), "id", F.lit("file").alias("type"))
    files = nodes.select("repo", F.col("id").alias("path"))
    built = graph.Graph(files, nodes, edges.withColumn("dst_type", F.lit("file")).withColumn(
        "relationship", F.lit("imports")))
    return graph.graph_stats(built).drop("repo")


@query
def event_degrees(spark, sf_dir):
    edges = _transitions(spark, sf_dir)
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    nodes = ends.distinct().select(F.lit("events").alias("repo"), "id", F.lit("file").alias("type"))
    files = nodes.select("repo", F.col("id").alias("path"))
    built = graph.Graph(files, nodes, edges.withColumn("dst_type", F.lit("file")).withColumn(
        "relationship", F.lit("imports")))
    return graph.degrees(built).drop("repo")


# --- near-duplicates -----------------------------------------------------------

@query
def shingle_counts(spark, sf_dir):
    return minhash.shingle_counts(_docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), "shingles")


@query
def trigram_counts(spark, sf_dir):
    grams = read_documents(spark, sf_dir).select("doc_id", text.char_trigrams(F.col("text")).alias("g"))
    return grams.select(
        "doc_id", F.size("g").alias("grams"), F.size(F.array_distinct("g")).alias("distinct_grams")
    )


@query
def minhash_signatures(spark, sf_dir):
    return minhash.signatures(_docs(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), F.md5(F.array_join("signature", ",")).alias("signature")
    )


@query
def minhash_pairs(spark, sf_dir):
    return minhash.duplicates(_docs(spark, sf_dir)).pairs.drop("scope").withColumn(
        "severity", scores.similarity_severity(F.col("similarity"))
    )


@query
def minhash_copies(spark, sf_dir):
    signed = materialize(minhash.signatures(_docs(spark, sf_dir)), "signatures")
    return minhash.copies(signed, minhash.signature_classes(signed)).drop("scope")


@query
def minhash_stats(spark, sf_dir):
    return minhash.duplicates(_docs(spark, sf_dir)).stats().drop("scope")


@query
def source_duplicate_stats(spark, sf_dir):
    files = lexical.source_rows(_files(spark, sf_dir))
    return minhash.duplicates(minhash.scoped(files, "path", "content", "repo")).stats().drop("scope")


@query
def exact_similarity(spark, sf_dir):
    return similarity.links(_docs(spark, sf_dir)).select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


@query
def exact_pairs(spark, sf_dir):
    return similarity.exact_pairs(_docs(spark, sf_dir)).pairs.drop("scope").withColumn("jaccard", F.round("jaccard", 6))


@query
def minhash_recall(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    exact, estimated = similarity.exact_pairs(docs), minhash.duplicates(docs)
    return similarity.recall(exact.pairs, estimated.pairs, estimated.copies).drop("scope")


@query
def duplicate_components(spark, sf_dir):
    found = minhash.duplicates(_docs(spark, sf_dir))
    pairs = found.pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    copies = found.copies.select(F.col("representative").alias("a"), F.col("id").alias("b"))
    return components.connected(pairs.unionByName(copies)).withColumnRenamed("node", "id")


@query
def simhash_fingerprints(spark, sf_dir):
    return simhash.fingerprints(_docs(spark, sf_dir)).drop("scope")


@query
def simhash_pairs(spark, sf_dir):
    signed = materialize(simhash.fingerprints(_docs(spark, sf_dir)), "fingerprints")
    return simhash.near_pairs(simhash.fingerprint_classes(signed)).drop("scope")


@query
def simhash_groups(spark, sf_dir):
    return simhash.duplicate_groups(_docs(spark, sf_dir)).members.drop("scope")


@query
def simhash_stats(spark, sf_dir):
    return simhash.duplicate_groups(_docs(spark, sf_dir)).stats().drop("scope")


# --- search --------------------------------------------------------------------

def _label_centroids(spark, sf_dir) -> DataFrame:
    """Mean vector of each label: one short row per label."""
    parts = read_table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding")
    )


@query
def vector_search(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    found = search.search(vectors, _label_centroids(spark, sf_dir), k=10)
    return found.join(vectors.select("id", "label"), "id").select(
        "query_id", "id", "label", "score", "rank"
    )


@query
def document_vectors(spark, sf_dir):
    weights = search.embed(read_documents(spark, sf_dir), "doc_id", "text")
    return weights.select(
        F.col("id").alias("doc_id"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("buckets"),
        F.round(F.array_max("embedding").cast("double"), 6).alias("largest"),
    )


@query
def text_search(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select(
        F.concat(F.lit("notes/d"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content")
    )
    vectors = search.embed(search.indexable(docs), "path", "content")
    asked = read_table(spark, sf_dir, "benchmark")
    accepted, _ = search.judged_queries(asked, "item_id", "text")
    queries = search.embed(accepted, "item_id", "text").withColumnRenamed("id", "query_id")
    return search.search(vectors, queries, k=10).withColumnRenamed("id", "path")


@query
def vector_table(spark, sf_dir):
    path = new_path(spark, "vectors")
    sinks.write_vectors(
        read_table(spark, sf_dir, "embeddings").select(
            F.concat(F.lit("job-"), "label").alias("job_id"), F.col("vec_id").alias("id"), "embedding"
        ),
        path,
    )
    return sinks.read_vectors(spark, path, "job-3").select(
        "job_id", "id", F.size("embedding").alias("width"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("first"),
    )


# --- jobs and reports -----------------------------------------------------------

def _changes(spark, sf_dir) -> DataFrame:
    """Events read as changes of one job per user."""
    kind = F.col("event_type")
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts",
        F.when(kind == "signup", F.concat(F.lit("repo-"), "user_id")).alias("repo_url"),
        F.when(kind == "signup", "PENDING").when(kind.isin("view", "click"), "RUNNING")
        .when(kind == "purchase", "COMPLETED").otherwise("FAILED").alias("status"),
        F.when(kind == "error", F.concat(F.lit("Task execution failed: "), "props")).alias("error"),
        F.when((kind == "purchase") & (F.col("value") > 20), F.concat(F.lit("r"), "event_id")).alias("report_path"),
        F.when(kind == "purchase", F.concat(F.lit("loc="), "event_id")).alias("summary"),
    )


@query
def current_jobs(spark, sf_dir):
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return jobs.current_jobs(_changes(spark, sf_dir)).select(
        "job_id", "repo_url", "status", "error", "report_path", "summary",
        F.date_format("created_at", stamp).alias("created_at"),
        F.date_format("updated_at", stamp).alias("updated_at"),
    )


@query
def job_snapshot(spark, sf_dir):
    """The state of ``current_jobs`` from three batches, merged one by one, the second of them delivered twice."""
    changes, stamp = _changes(spark, sf_dir), "yyyy-MM-dd HH:mm:ss.SSSSSS"
    batches, snapshots = new_path(spark, "job-batches"), new_path(spark, "job-snapshots")
    dealt = F.pmod(F.xxhash64("seq"), F.lit(3))
    for batch in (0, 1, 1, 2):
        jobs.write_batch(changes.where(dealt == batch), batches, batch)
        state = jobs.refresh_snapshot(spark, batches, snapshots)
    return state.select(
        "job_id", "repo_url", "status", "error", "report_path", "summary",
        F.date_format("created_at", stamp).alias("created_at"),
        F.date_format("updated_at", stamp).alias("updated_at"),
    )


@query
def final_status(spark, sf_dir):
    kind = F.col("event_type")
    no_errors = F.array().cast("array<string>")
    errors = (
        F.when(kind == "error", F.array(F.concat(F.lit("Could not read "), "props"), F.lit("Code metrics failed: x")))
        .when(kind == "click", F.array(F.concat(F.lit("Could not read "), F.repeat("props", F.lit(200)))))
        .when(kind == "view", F.array(F.lit("FAISS index build failed: y")))
        .otherwise(no_errors)
    )
    runs = jobs.with_final_status(read_table(spark, sf_dir, "events").select("event_id", errors.alias("errors")))
    return runs.withColumn("errors", F.array_join("errors", "\n"))


@query
def status_view(spark, sf_dir):
    return jobs.status_view(jobs.current_jobs(_changes(spark, sf_dir)))


@query
def results_view(spark, sf_dir):
    reports = read_table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(
        F.col("user_id").cast("string").alias("job_id")
    ).agg(F.concat(F.lit("purchases: "), F.count(F.lit(1))).alias("report"))
    return jobs.results_view(jobs.current_jobs(_changes(spark, sf_dir)), reports)


@query
def json_values(spark, sf_dir):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf")) * (F.col("l_linenumber") - 3.5)).otherwise(
        F.round(F.col("l_quantity"), 0)
    )
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text.json_number(ratio).alias("value")
    )


@query
def nested_json_values(spark, sf_dir):
    """Orders as nested objects with infinities, sets, maps and complex numbers."""
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf")) * (F.col("l_linenumber") - 3.5)).otherwise(
        F.round(F.col("l_quantity"), 0)
    )
    line = F.struct(F.col("l_linenumber").cast("int").alias("n"), ratio.alias("ratio"), F.struct(
        F.round("l_quantity", 0).alias("real"), F.when(F.col("l_discount") == 0, F.lit(float("-inf"))).otherwise(0.0).alias("imag")
    ).alias("z"))
    orders = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(line)).alias("lines"), F.collect_list("l_returnflag").alias("flags"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("l_linestatus", F.lit(float("inf")))))).alias("by status"),
        F.lit(None).cast("double").alias("none"),
    )
    return orders.select("l_orderkey", F.md5(values.json_rows(orders, {"flags"})).alias("json"))


@query
def humanized_numbers(spark, sf_dir):
    price = F.col("l_extendedprice")
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        text.humanize(F.when(F.col("l_linenumber") != 2, price)).alias("grouped"),
        text.humanize(F.floor(price).cast("bigint"), is_loc=True).alias("loc"),
    )


@query
def report_round_trip(spark, sf_dir):
    made = metrics.file_metrics(_facts(spark, sf_dir)).groupBy(F.col("ext").alias("job_id")).agg(
        F.sum("loc").alias("loc"), F.sum("marker_comments").alias("markers")
    ).select("job_id", F.struct("loc", "markers").alias("code_metrics"))
    path = new_path(spark, "reports")
    sinks.write_report(made, path)
    return sinks.read_report(spark, path, made.schema, ".ts").select(
        "job_id", "code_metrics.loc", "code_metrics.markers"
    )


@query
def full_report(spark, sf_dir):
    made = report.full_report(_files(spark, sf_dir), "job-1")
    return made.select(
        "job_id", "repository", "code_metrics.*", "status",
        F.col("dependency_metrics.total_edges").alias("total_edges"),
        F.col("dependency_metrics.circular_dependencies").alias("circular_dependencies"),
        F.col("duplication_metrics.duplicate_pairs_found").alias("duplicate_pairs_found"),
        F.size("llm_suggestions.items").alias("suggestions"),
        "excluded_third_party", "excluded_tests", F.size("analysis_errors").alias("errors"),
    ).drop("error")


@query
def report_without_third_party_filter(spark, sf_dir):
    """Vendored files are measured but never enter the graph."""
    made = report.full_report(_files(spark, sf_dir), "job-2", exclude_third_party=False)
    return made.select(
        "job_id", "code_metrics.files_analyzed", "code_metrics.total_functions",
        F.col("dependency_metrics.total_files").alias("graph_files"), "status",
    )


@query
def job_summary(spark, sf_dir):
    return report.job_summary(report.full_report(_files(spark, sf_dir), "job-1"))
