"""DuckDB SQL for the registered queries, over the same tables.

``SF`` rebuilds the derived source files; the rest reads their text or the
tables directly and shares no code with the library but its fixed values.
"""

from __future__ import annotations

from treeline.functions.paths import SEARCH_EXTENSIONS, TEST_PATTERNS, THIRD_PARTY_NAMES
from treeline.functions.text import REFACTOR_PROMPT
from treeline.operators.jobs import FATAL_ERRORS
from treeline.operators.minhash import BASE, PRIME, slot_parameters


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


# --- source files ---------------------------------------------------------------

def _dir(d: str) -> str:
    return f"""(CASE trunc(({d}) / 4)::BIGINT % 10 WHEN 0 THEN 'node_modules/m0' WHEN 1 THEN 'tests/m1'
      WHEN 2 THEN 'src/test/java/m2' ELSE 'src/m' || (trunc(({d}) / 4)::BIGINT % 10) END)"""


def _two(one) -> str:
    return (f"{one('doc_id - 4')} || CASE WHEN (doc_id // 4) % 5 = 0 "
            f"THEN {one('doc_id + 4')} ELSE '' END")


_NL = "chr(10)"


def _marker(word: str) -> str:
    return f"CASE WHEN doc_id % 3 = 0 THEN '{word}' ELSE 'note' END"


def _python() -> str:
    one = lambda d: f"('from ' || replace({_dir(d)}, '/', '.') || '.u' || ({d}) || ' import f' || ({d}) || {_NL})"
    return f"""'import os' || {_NL} || {_two(one)} || '# ' || {_marker('TODO')} || {_NL}
      || 'def f' || doc_id || '(x, y):' || {_NL} || '    s = "# no"' || {_NL}
      || '    if x and y:' || {_NL} || '        return s' || {_NL}
      || repeat('    elif x > 1:' || {_NL} || '        y = 1' || {_NL}, doc_id % 20)
      || '    else:' || {_NL} || '        return y' || {_NL} || {_NL}
      || 'class C' || doc_id || ':' || {_NL} || '    pass' || {_NL}
      || 'def g' || doc_id || '(a=k((1, (2,))),' || {_NL} || '        b=None):' || {_NL}
      || '    def inner(): return a or b' || {_NL} || '    return 1 if a else 2' || {_NL}
      || '# ' || replace(text, {_NL}, {_NL} || '# ')"""


def _script(prefix: str) -> str:
    one = lambda d: f"""('import f from "{prefix}' || {_dir(d)} || '/u' || ({d}) || '";' || {_NL})"""
    return f"""'const p = require("path");' || {_NL} || {_two(one)} || '// ' || {_marker('FIXME')} || {_NL}
      || 'function f' || doc_id || '(x, y) {{' || {_NL}
      || '  if (x && y) {{ return "// no"; }}' || {_NL}
      || repeat('  while (x > 1) {{ x--; }}' || {_NL}, doc_id % 20)
      || '  return y;' || {_NL} || '}}' || {_NL} || 'class C' || doc_id || ' {{' || {_NL} || '}}' || {_NL}
      || 'function g' || doc_id || '(' || {_NL} || '  a,' || {_NL} || '  b' || {_NL} || ') {{' || {_NL}
      || '  for (let i = size(b) - 1; i >= 0; i--) {{ do {{ a--; }}            while (a > 0); }}' || {_NL}
      || '  const h = (p, q = k(k(1))) => p && q;' || {_NL} || '  return a;' || {_NL} || '}}' || {_NL}
      || '// ' || replace(text, {_NL}, {_NL} || '// ')"""


def _java() -> str:
    one = lambda d: f"('import ' || replace({_dir(d)}, '/', '.') || '.u' || ({d}) || ';' || {_NL})"
    return f"""'import java.util.List;' || {_NL} || {_two(one)} || '/* ' || {_marker('HACK')} || {_NL}
      || '   more */' || {_NL} || 'class C' || doc_id || ' {{' || {_NL}
      || '  int f' || doc_id || '(int x, int y) {{' || {_NL}
      || '    if (x > 0 && y > 0) {{ return x; }}' || {_NL}
      || repeat('    for (int i = 0; i < x; i++) {{ y++; }}' || {_NL}, doc_id % 20)
      || '    return y;' || {_NL} || '  }}' || {_NL}
      || '  public List<Map<String, List<String>>> g' || doc_id || '(' || {_NL} || '      int a,' || {_NL}
      || '      List<? extends Object> b' || {_NL} || '  ) throws Exception {{' || {_NL}
      || '    for (int i = b.size() - 1; i >= 0; i--) {{ do {{ a--; }}            while (a > 0); }}' || {_NL}
      || '    return a > b.size() ? null : c(a);' || {_NL} || '  }}' || {_NL} || '}}' || {_NL}
      || '// ' || replace(text, {_NL}, {_NL} || '// ')"""


SF = f"""
sf AS (
  SELECT {_dir('doc_id')} || '/u' || doc_id
      || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' ELSE '.java' END AS path,
    CASE doc_id % 4 WHEN 0 THEN {_python()} WHEN 1 THEN {_script('')}
      WHEN 2 THEN {_script('../../')} ELSE {_java()} END AS content
  FROM documents
)"""

_EXT = r"regexp_extract(path, '[^/]*[^/.][^/]*?(\.[^./]*)$', 1)"
_LANGUAGE = f"CASE {_EXT} WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'javascript' WHEN '.java' THEN 'java' END"
_VENDORED = f"list_has_any(string_split(path, '/'), [{_list(THIRD_PARTY_NAMES)}])"
_TEST = "regexp_matches(path, " + _text("|".join(f"(?:{p})" for p in TEST_PATTERNS)) + ")"

KEPT = f"""{SF},
kept AS (
  SELECT path, {_EXT} AS ext, {_LANGUAGE} AS language, content FROM sf
  WHERE NOT {_VENDORED} AND NOT {_TEST}
)"""

# comments out, literals kept; a comment over several lines leaves its line breaks
CODE = rf"""{KEPT},
code AS (
  SELECT path, ext, language, content,
    CASE WHEN language = 'python'
      THEN regexp_replace(content, '("[^"\\\n]*")|#[^\n]*', '\1', 'g')
      ELSE regexp_replace(
        regexp_replace(content, '/\*[^\n]*\n[^\n]*\*/', chr(10), 'g'),
        '("[^"\\\n]*")|//[^\n]*', '\1', 'g') END AS code
  FROM kept
)"""

_COMMENTS = r"""list_filter(regexp_extract_all(content,
  CASE WHEN language = 'python' THEN '(?s)"[^"\n]*"|#[^\n]*' ELSE '(?s)"[^"\n]*"|//[^\n]*|/\*.*?\*/' END),
  lambda c: c[1] <> '"')"""

_MARKER_COMMENTS = (
    f"len(list_filter({_COMMENTS}, lambda c: regexp_matches(upper(c), 'TODO|FIXME|HACK')))"
)


def _filled(column: str) -> str:
    return rf"len(regexp_extract_all({column}, '\S[^\n]*'))"


def _marked(column: str) -> str:
    return rf"len(regexp_extract_all({column}, '(TODO|FIXME|HACK)[^\n]*'))"


METRICS = rf"""{CODE},
file_metrics AS (
  SELECT path, ext, language, {_filled('code')} AS loc,
    len(string_split(regexp_replace(content, '^\s+|\s+$', '', 'g'), chr(10))) AS loc_span,
    {_MARKER_COMMENTS} AS marker_comments, {_marked('content')} AS marker_lines
  FROM code
)"""

# the body is cut out by its closing line and read without its literals
SPANS = rf"""{METRICS},
bodies AS (
  SELECT path, language, content, code,
    CASE language
      WHEN 'python' THEN regexp_extract(content, '(?s)\n(def f.*?)\n\nclass C', 1)
      WHEN 'javascript' THEN regexp_extract(content, '(?s)\n(function f.*?\n\}})', 1)
      ELSE regexp_extract(content, '(?s)\n(  int f.*?\n  \}})', 1) END AS body
  FROM code
),
seconds AS (
  SELECT path, language, regexp_extract(content, '\n(?:def|function|  public [^\n]*>) (g-?[0-9]+)\(', 1) AS name,
    len(string_split(content[: instr(content, chr(10) || CASE language WHEN 'python' THEN 'def g'
      WHEN 'javascript' THEN 'function g' ELSE '  public List<' END)], chr(10))) AS line
  FROM code
),
spans AS (
  SELECT path, language, regexp_extract(body, '(f-?[0-9]+)\(', 1) AS name, body,
    1 + len(string_split(content[: instr(content, body) - 1], chr(10))) - 1 AS start_line,
    len(string_split(content[: instr(content, body) - 1], chr(10))) + len(string_split(body, chr(10))) - 1 AS end_line,
    1 + len(regexp_extract_all(regexp_replace(body, '"[^"]*"', '', 'g'),
      '\b(?:if|elif|else|for|while|and|or)\b|&&|\|\|')) AS complexity
  FROM bodies
  UNION ALL
  SELECT path, language, name, NULL, line,
    line + CASE language WHEN 'python' THEN 3 WHEN 'javascript' THEN 7 ELSE 6 END, 3 FROM seconds
  UNION ALL
  SELECT path, language, 'inner', NULL, line + 2, line + 2, 2 FROM seconds WHERE language = 'python'
  UNION ALL
  SELECT path, language, 'unknown', NULL, line + 5, line + 5, 2 FROM seconds WHERE language = 'javascript'
)"""

DEFINITIONS = rf"""{CODE},
definitions AS (
  SELECT path, 'function' AS kind,
    unnest(regexp_extract_all(code, '(?:def|function|int|>>>) ([fg][0-9]+|inner)\(', 1)) AS name FROM code
  UNION ALL
  SELECT path, 'class', unnest(regexp_extract_all(code, '(?:^|\n)class (C[0-9]+)', 1)) FROM code
)"""

IMPORTS = rf"""{DEFINITIONS},
statements AS (
  SELECT path, language, unnest(s) AS statement, generate_subscripts(s, 1) AS import_no
  FROM (SELECT path, language, regexp_extract_all(code,
    '(?:^|\n)(?:from|import|const)[^\n]*') AS s FROM code)
),
imports AS (
  SELECT path, language, import_no,
    CASE WHEN contains(statement, 'require(') THEN 'require'
      WHEN ltrim(statement, chr(10)) LIKE 'from%' THEN 'from_import' ELSE 'import' END AS type,
    CASE language
      WHEN 'javascript' THEN regexp_extract(statement, '"([^"]*)"', 1)
      ELSE regexp_extract(statement, '(?:from|import) ([^ ;]+)', 1) END AS module,
    CASE WHEN language = 'java' THEN ''
      WHEN language = 'python' THEN regexp_extract(statement, '^\n?from [^ ]+ import (.*)$', 1)
      ELSE regexp_extract(statement, 'import (.*) from', 1) END AS items
  FROM statements
),
wanted AS (
  SELECT *, CASE WHEN module LIKE '../../%' THEN replace(module, '../../', '')
    ELSE replace(module, '.', '/') END AS wanted FROM imports
),
resolved AS (
  SELECT w.path, w.language, w.import_no, w.module, min(k.path) AS target
  FROM wanted w LEFT JOIN kept k
    ON k.path = w.module
    OR regexp_replace(k.path, '\.[^.]*$', '') = w.module
    OR regexp_replace(k.path, '\.[^.]*$', '') = w.wanted
    OR (w.module NOT LIKE '.%' AND ends_with(regexp_replace(k.path, '\.[^.]*$', ''), '/' || w.wanted))
  GROUP BY ALL
)"""

GRAPH = f"""{IMPORTS},
defined AS (SELECT path, name, min(kind) AS kind FROM definitions GROUP BY ALL),
nodes AS (
  SELECT path AS id, 'file' AS type, ext AS language, NULL::VARCHAR AS name, NULL::VARCHAR AS file,
    NULL::VARCHAR AS module FROM kept
  UNION ALL SELECT path || '::' || name, kind, NULL, name, path, NULL FROM defined
  UNION ALL SELECT DISTINCT 'external::' || module, 'external', NULL, NULL, NULL, module
    FROM resolved WHERE target IS NULL
),
edges AS (
  SELECT path AS src, path || '::' || name AS dst, kind AS dst_type, 'defines' AS relationship,
    NULL::VARCHAR AS module FROM defined
  UNION ALL
  SELECT path, coalesce(target, 'external::' || module),
    CASE WHEN target IS NULL THEN 'external' ELSE 'file' END, 'imports', max_by(module, import_no)
  FROM resolved GROUP BY ALL
),
degrees AS (
  SELECT id AS file,
    (SELECT count(*) FROM edges WHERE src = id) AS out_degree,
    (SELECT count(*) FROM edges WHERE src = id AND relationship = 'imports') AS import_out_degree,
    (SELECT count(*) FROM edges WHERE dst = id) AS in_degree
  FROM nodes WHERE type = 'file'
)"""


def _cycles(edges: str) -> str:
    return f"""
steps AS (SELECT DISTINCT src, dst FROM {edges}),
walks AS (
  SELECT src AS start, dst AS last, [src] AS chain FROM steps WHERE dst >= src
  UNION ALL
  SELECT w.start, s.dst, list_append(w.chain, w.last) FROM walks w JOIN steps s ON s.src = w.last
  WHERE w.last > w.start AND s.dst >= w.start AND NOT list_contains(w.chain, w.last)
),
cycles AS (
  SELECT len(chain) AS length, array_to_string(chain, ' > ') AS chain FROM walks WHERE last = start
)"""


TRANSITIONS = """
ordered AS (
  SELECT event_type AS src, lead(event_type) OVER (
    PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS dst FROM events
),
transitions AS (SELECT DISTINCT src, dst FROM ordered WHERE dst IS NOT NULL),
event_nodes AS (SELECT DISTINCT unnest([src, dst]) AS id FROM transitions)"""


# --- near-duplicates ---------------------------------------------------------------

_COLLAPSED = r"regexp_replace(text, '\s+', ' ', 'g')"
_WORD_CHARS = r"regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g')"


def _characters(column: str, source: str) -> str:
    return f"""
texts AS (SELECT doc_id, regexp_extract_all(t, '(?s).') AS c FROM (SELECT doc_id, {column} AS t FROM {source})),
characters AS (SELECT doc_id, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM texts),
windows AS (
  SELECT doc_id, c AS c0, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2,
    lead(c, 3) OVER w AS c3, lead(c, 4) OVER w AS c4
  FROM characters WINDOW w AS (PARTITION BY doc_id ORDER BY i)
)"""


def _slot(multiplier: int, offset: int) -> str:
    return f"(({multiplier}::UBIGINT * h + {offset}::UBIGINT) & 4294967295)"


def _strong(edges: str) -> str:
    return f"""
reach AS (
  SELECT DISTINCT src, dst FROM {edges} UNION SELECT r.src, s.dst FROM reach r JOIN {edges} s ON s.src = r.dst
),
mutual AS (SELECT a.src AS node, a.dst AS other FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)"""


_STRONG = "SELECT node, least(node, min(other)) AS component FROM mutual GROUP BY node"


def _signatures(source: str, scope: str = "'x'") -> str:
    shingle = "unicode(c0)"
    for i in range(1, 5):
        shingle = f"(({shingle}::BIGINT * {BASE} + unicode(c{i})) % {PRIME})"
    minima = [
        f"min({_slot(int(a), int(b))})" for a, b in zip(*slot_parameters(128))
    ]
    return f"""{_characters(_COLLAPSED, source)},
hashes AS (SELECT doc_id, ({shingle})::UBIGINT AS h FROM windows WHERE c4 IS NOT NULL),
signatures AS (
  SELECT doc_id, list_transform([{', '.join(minima)}],
    lambda v: v::BIGINT - CASE WHEN v >= 2147483648 THEN 4294967296 ELSE 0 END) AS signature
  FROM hashes GROUP BY doc_id
),
classes AS (SELECT signature, min(doc_id) AS id, count(*) AS copies FROM signatures GROUP BY ALL),
scored AS (
  SELECT a.id AS id_a, b.id AS id_b, a.copies AS copies_a, b.copies AS copies_b,
    list_sum(list_transform(list_zip(a.signature, b.signature), lambda p: (p[1] = p[2])::INT)) / 128.0 AS estimate
  FROM classes a JOIN classes b ON a.id < b.id
),
pairs AS (
  SELECT id_a, id_b, round(estimate::DOUBLE, 4) AS similarity, copies_a, copies_b
  FROM scored WHERE estimate >= 0.85
)"""


def _fingerprints() -> str:
    bits = [
        f"(CASE WHEN 2 * sum(CASE WHEN (h >> {i}) & 1 = 1 THEN n ELSE 0 END) > sum(n) "
        f"THEN {1 << i}::UHUGEINT ELSE 0 END)" for i in range(64)
    ]
    return f"""
words AS (SELECT doc_id, {_WORD_CHARS} AS t FROM documents WHERE regexp_matches(text, '\\S')),
{_characters('t', 'words').strip()},
grams AS (
  SELECT doc_id, c0 || c1 || c2 AS g FROM windows WHERE c2 IS NOT NULL
  UNION ALL SELECT doc_id, t FROM words WHERE length(t) < 3
),
counted AS (SELECT doc_id, g, count(*)::BIGINT AS n FROM grams GROUP BY ALL),
hashed AS (SELECT doc_id, ('0x' || right(md5(g), 16))::UBIGINT AS h, n FROM counted),
summed AS (SELECT doc_id, {' + '.join(bits)} AS f FROM hashed GROUP BY doc_id),
fingerprints AS (
  SELECT doc_id AS id,
    (f::HUGEINT - CASE WHEN f >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END)::BIGINT AS fingerprint
  FROM summed
),
classes AS (SELECT fingerprint, min(id) AS id, count(*) AS copies FROM fingerprints GROUP BY ALL)"""


# one pass over the classes in id order, carrying the positions of the leaders so far
_LEADERS = """
line AS (SELECT list(fingerprint ORDER BY id) AS f, list(id ORDER BY id) AS ids, count(*) AS n FROM classes),
visit AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS leads
  UNION ALL
  SELECT i + 1, CASE WHEN len(list_filter(leads, lambda j: bit_count(xor(f[j], f[i + 1])) <= 3)) = 0
    THEN list_append(leads, i + 1) ELSE leads END
  FROM visit, line WHERE i < n
),
leaders AS (
  SELECT ids[j] AS id, f[j] AS fingerprint
  FROM (SELECT unnest(leads) AS j, f, ids FROM visit, line WHERE i = n)
),
members AS (
  SELECT p.id, min(l.id) AS leader FROM fingerprints p JOIN leaders l
    ON bit_count(xor(p.fingerprint, l.fingerprint)) <= 3
  GROUP BY p.id HAVING min(l.id) <> p.id
)"""


# --- search -----------------------------------------------------------------------------

def _vectors(name: str, source: str) -> str:
    return rf"""
{name}_terms AS (
  SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n
  FROM (SELECT id, unnest(string_split_regex(lower(text), '[ \t\n\r\f\v]+')) AS term FROM {source})
  WHERE term <> '' GROUP BY ALL
),
{name} AS (
  SELECT id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT AS w FROM {name}_terms
)"""


# --- jobs -------------------------------------------------------------------------------

JOBS = """
changes AS (
  SELECT user_id::VARCHAR AS job_id, event_id AS seq, ts,
    CASE WHEN event_type = 'signup' THEN 'repo-' || user_id END AS repo_url,
    CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING'
      WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
    CASE WHEN event_type = 'error' THEN 'Task execution failed: ' || props END AS error,
    CASE WHEN event_type = 'purchase' AND value > 20 THEN 'r' || event_id END AS report_path,
    CASE WHEN event_type = 'purchase' THEN 'loc=' || event_id END AS summary
  FROM events
),
jobs AS (
  SELECT job_id,
    arg_max(repo_url, row(ts, seq)) FILTER (repo_url IS NOT NULL) AS repo_url,
    arg_max(status, row(ts, seq)) AS status,
    arg_max(error, row(ts, seq)) FILTER (error IS NOT NULL) AS error,
    arg_max(report_path, row(ts, seq)) FILTER (report_path IS NOT NULL) AS report_path,
    arg_max(summary, row(ts, seq)) FILTER (summary IS NOT NULL) AS summary,
    min(ts) AS created_at, max(ts) AS updated_at
  FROM changes GROUP BY job_id
)"""

_FATAL = " OR ".join(f"contains(e, {_text(t)})" for t in FATAL_ERRORS)
_PROMPT_HEAD, _PROMPT_TAIL = REFACTOR_PROMPT.split("{code_content}")
_PROMPT = f"{_text(_PROMPT_HEAD)} || body || {_text(_PROMPT_TAIL)}"
_BUCKET = "CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'medium' WHEN complexity <= 20 THEN 'high' ELSE 'very_high' END"
_SUMMARY = """(SELECT count(*) FROM file_metrics) AS files_analyzed, count(*) AS total_functions,
  max(complexity) AS max_complexity, min(complexity) AS min_complexity,
  round(avg(complexity), 2) AS avg_complexity, count(*) FILTER (complexity <= 5) AS low,
  count(*) FILTER (complexity BETWEEN 6 AND 10) AS medium,
  count(*) FILTER (complexity BETWEEN 11 AND 20) AS high, count(*) FILTER (complexity > 20) AS very_high"""
_RANKED = f"""{SPANS},
ranked AS (
  SELECT *, row_number() OVER (ORDER BY path, start_line) AS scan_rank,
    row_number() OVER (ORDER BY complexity DESC, path, start_line) AS score_rank
  FROM spans WHERE complexity > 10
)"""

def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select}"


def _graph_stats(nodes: str, edges: str, kind: str) -> str:
    return f"""SELECT n AS total_nodes,
      (SELECT count(*) FROM {nodes} WHERE {kind} = 'file') AS total_files,
      (SELECT count(*) FROM {nodes} WHERE {kind} = 'function') AS total_functions,
      (SELECT count(*) FROM {nodes} WHERE {kind} = 'class') AS total_classes,
      (SELECT count(*) FROM {nodes} WHERE {kind} = 'external') AS total_external_dependencies,
      e AS total_edges, round(2.0::DOUBLE * e / n, 2) AS average_connections_per_node,
      round(e::DOUBLE / (n * (n - 1)), 4) AS graph_density
    FROM (SELECT (SELECT count(*) FROM {nodes}) AS n, (SELECT count(*) FROM {edges}) AS e)"""


_DUPLICATE_STATS = """SELECT (SELECT count(*) FROM {docs}) AS files_analyzed,
  ((SELECT coalesce(sum(copies * (copies - 1) // 2), 0) FROM classes)
   + (SELECT coalesce(sum(copies_a * copies_b), 0) FROM pairs))::BIGINT AS duplicate_pairs_found,
  0.85::DOUBLE AS similarity_threshold, 5 AS shingle_size_k"""

_SOURCE_DUPLICATES = _with(
    KEPT + ",source_texts AS (SELECT path AS doc_id, content AS text FROM kept)," + _signatures("source_texts"),
    _DUPLICATE_STATS.format(docs="kept"))
_EXACT_PAIRS = f"""
same AS (SELECT {_COLLAPSED} AS t, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY t HAVING length(t) >= 5),
places AS (SELECT id, unnest(c) AS c, generate_subscripts(c, 1) AS i
  FROM (SELECT id, regexp_extract_all(t, '(?s).') AS c FROM same)),
held AS (SELECT DISTINCT id, s FROM (
  SELECT id, c || lead(c, 1) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w || lead(c, 4) OVER w AS s
  FROM places WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE s IS NOT NULL),
named AS (SELECT s, row_number() OVER () AS s_no FROM (SELECT s FROM held GROUP BY s HAVING count(*) > 1)),
sizes_of AS (SELECT id, count(*) AS n FROM held GROUP BY id),
sized AS (SELECT id, s_no::INT AS s_no, n FROM held JOIN named USING (s) JOIN sizes_of USING (id)),
met AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared, any_value(a.n + b.n) AS total
  FROM sized a JOIN sized b ON a.s_no = b.s_no AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
exact AS (SELECT id_a, id_b, shared / (total - shared)::DOUBLE AS jaccard, x.copies AS copies_a, y.copies AS copies_b
  FROM met JOIN same x ON x.id = id_a JOIN same y ON y.id = id_b WHERE 100 * shared >= 85 * (total - shared))"""
_FILE_CYCLES = GRAPH + "," + _cycles("(SELECT src, dst FROM edges WHERE dst_type = 'file')")
_CODE_METRICS = _with(SPANS, f"""SELECT *, round(marker_comments * 5 + avg_complexity * 2 + loc / 1000.0::DOUBLE, 2) AS debt_score
  FROM (SELECT {_SUMMARY}, (SELECT sum(loc)::BIGINT FROM file_metrics) AS loc,
    (SELECT sum(marker_comments)::BIGINT FROM file_metrics) AS marker_comments FROM spans)""")
_INNER_EDGES = _with(GRAPH, "SELECT count(*) AS total_edges FROM edges WHERE dst_type <> 'external'")
_CYCLE_COUNT = _with(_FILE_CYCLES, "SELECT count(*) AS circular_dependencies FROM cycles", recursive=True)
_REPORT = f"""SELECT 'job-1' AS job_id, 'corpus' AS repository, c.*, total_edges, circular_dependencies,
  duplicate_pairs_found FROM ({_CODE_METRICS}) c, ({_INNER_EDGES}), ({_CYCLE_COUNT}), ({_SOURCE_DUPLICATES})"""

ORACLES: dict[str, str] = {
    "path_facts": _with(SF, f"""SELECT path, {_EXT} AS ext, left(path, length(path) - length({_EXT})) AS base,
      {_LANGUAGE} AS language, {_VENDORED} AS third_party, {_TEST} AS test,
      regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM sf"""),
    "page_paths": f"""SELECT page_id, {_EXT} AS ext, left(path, length(path) - length({_EXT})) AS base,
      regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory
      FROM (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path FROM pages)""",
    "kept_files": _with(KEPT, "SELECT path, ext, language FROM kept"),
    "kept_with_tests": _with(SF, f"SELECT path, {_LANGUAGE} AS language FROM sf WHERE NOT {_VENDORED}"),
    "kept_with_third_party": _with(SF, f"SELECT path, {_LANGUAGE} AS language FROM sf WHERE NOT {_TEST}"),
    "search_corpus": _with(SF, rf"""SELECT path, length(content) AS chars FROM (
        SELECT path, content FROM sf UNION ALL SELECT 'notes/d' || doc_id || '.MD', text FROM documents)
      WHERE lower({_EXT}) IN ({_list(SEARCH_EXTENSIONS)}) AND NOT {_VENDORED} AND NOT {_TEST}
        AND length(regexp_replace(content, '^\s+|\s+$', '', 'g')) > 20"""),
    "normalized_text": rf"""SELECT doc_id, md5({_COLLAPSED}) AS collapsed, md5({_WORD_CHARS}) AS word_chars,
      length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped_chars FROM documents""",
    "lossy_decoding": "SELECT doc_id, md5(text || '(') AS decoded FROM documents",
    "unquoted_modules": """SELECT event_id, event_type AS module, 'external::' || event_type AS node_id,
      'a/' || event_type AS module_path FROM events""",
    "relative_modules": "SELECT doc_id, 'src/m' || doc_id || '/u' AS target FROM documents",
    "line_classes": _with(CODE, r"""SELECT path,
      len(list_filter(l, lambda p: regexp_matches(p[2], '\S'))) AS code,
      len(list_filter(l, lambda p: NOT regexp_matches(p[2], '\S') AND regexp_matches(p[1], '\S'))) AS comment,
      len(list_filter(l, lambda p: NOT regexp_matches(p[1], '\S'))) AS blank
      FROM (SELECT path, list_zip(string_split(content, chr(10)), string_split(code, chr(10))) AS l FROM code)"""),
    "file_comments": _with(KEPT, f"""SELECT path, generate_subscripts(c, 1) AS comment_no, unnest(c) AS comment
      FROM (SELECT path, {_COMMENTS} AS c FROM kept)"""),
    "file_metrics": _with(METRICS, "SELECT * FROM file_metrics"),
    "document_lines": f"""SELECT doc_id, {_filled('text')} AS filled_lines, {_marked('text')} AS marker_lines,
      regexp_matches(upper(text), 'TODO|FIXME|HACK') AS has_marker FROM documents""",
    "corpus_size": _with(METRICS, """SELECT language, count(*) AS files, sum(loc)::BIGINT AS loc,
      sum(loc_span)::BIGINT AS loc_span, sum(marker_comments)::BIGINT AS marker_comments,
      sum(marker_lines)::BIGINT AS marker_lines,
      round(sum(marker_comments) * 5 + sum(loc)::DOUBLE / 1000, 2) AS debt
      FROM file_metrics GROUP BY language"""),
    "document_debt": f"""SELECT *, CASE WHEN debt < 50 THEN 'green' WHEN debt < 100 THEN 'yellow'
      WHEN debt < 200 THEN 'orange' ELSE 'red' END AS severity FROM (
      SELECT source, lang, sum({_filled('text')})::BIGINT AS loc, sum({_marked('text')})::BIGINT AS markers,
        round((sum({_marked('text')}) * 5 + sum({_filled('text')}))::DOUBLE, 2) AS debt
      FROM documents GROUP BY source, lang)""",
    "function_spans": _with(SPANS, "SELECT path, language, name, start_line, end_line, complexity FROM spans"),
    "file_definitions": _with(DEFINITIONS, "SELECT path, kind, name FROM definitions"),
    "function_summary": _with(SPANS, f"SELECT {_SUMMARY} FROM spans"),
    "complexity_shares": _with(SPANS, f"""SELECT bucket, count(path) AS n,
      round(count(path) * 100.0::DOUBLE / (SELECT count(*) FROM spans), 4) AS share
      FROM (VALUES ('low'), ('medium'), ('high'), ('very_high')) AS b(bucket)
      LEFT JOIN (SELECT path, {_BUCKET} AS bucket FROM spans) USING (bucket) GROUP BY bucket"""),
    "complexity_severities": _with(SPANS, """SELECT path, name, CASE WHEN complexity <= 5 THEN 'green'
      WHEN complexity <= 10 THEN 'yellow' WHEN complexity <= 20 THEN 'orange' ELSE 'red' END AS severity FROM spans"""),
    "complex_functions": _with(SPANS, "SELECT path, name, complexity, body AS content FROM spans WHERE complexity > 10"),
    "first_complex_functions": _with(_RANKED, "SELECT path, name, complexity, scan_rank AS rank FROM ranked WHERE scan_rank <= 3"),
    "most_complex_functions": _with(_RANKED, "SELECT path, name, complexity, score_rank AS rank FROM ranked WHERE score_rank <= 3"),
    "refactor_prompts": _with(_RANKED, f"SELECT path, {_PROMPT} AS prompt FROM ranked WHERE scan_rank <= 3"),
    "refactor_suggestions": _with(_RANKED, """SELECT path AS file_path, name AS function_name, complexity,
      CASE WHEN contains(body, 'function') THEN 'Could not generate suggestion: no answer'
        ELSE (len(string_split(body, chr(10))) + 1) || ' lines' END AS suggestion,
      body AS original_code,
      CASE WHEN contains(body, 'function') THEN 'Suggestion failed for ' || name || ': no answer' END AS error
      FROM ranked WHERE scan_rank <= 3"""),
    "code_metrics": _CODE_METRICS,
    "file_imports": _with(IMPORTS, "SELECT path, import_no, type, module, items FROM imports"),
    "resolved_imports": _with(IMPORTS, "SELECT path, import_no, module, target FROM resolved"),
    "graph_nodes": _with(GRAPH, "SELECT * FROM nodes"),
    "graph_edges": _with(GRAPH, "SELECT * FROM edges"),
    "graph_edges_without_externals": _with(GRAPH, "SELECT * FROM edges WHERE dst NOT LIKE 'external::%'"),
    "node_counts": _with(GRAPH, "SELECT type, count(*) AS n FROM nodes GROUP BY type"),
    "file_degrees": _with(GRAPH, "SELECT * FROM degrees"),
    "graph_stats": _with(GRAPH, _graph_stats("nodes", "edges", "type")),
    "most_dependent_files": _with(GRAPH, """SELECT file, out_degree, row_number() OVER (ORDER BY out_degree DESC, file) AS rank
      FROM degrees QUALIFY rank <= 5"""),
    "most_depended_on_files": _with(GRAPH, """SELECT file, in_degree, row_number() OVER (ORDER BY in_degree DESC, file) AS rank
      FROM degrees QUALIFY rank <= 5"""),
    "folder_keys": _with(GRAPH, """SELECT id, type, CASE WHEN type = 'external' THEN 'external'
      ELSE regexp_extract(coalesce(file, id), '^(.*)/[^/]*$', 1) END AS folder FROM nodes"""),
    "file_neighbours": _with(GRAPH, """SELECT src AS file, 'dependency' AS direction, dst AS neighbour, dst_type AS type, relationship FROM edges
      UNION ALL SELECT dst, 'dependent', src, 'file', relationship FROM edges WHERE dst_type = 'file'"""),
    "file_records": _with(IMPORTS, """SELECT k.path AS file,
        (SELECT count(*) FROM imports i WHERE i.path = k.path) AS imports,
        coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM definitions d
          WHERE d.path = k.path AND kind = 'function'), '') AS functions,
        coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM definitions d
          WHERE d.path = k.path AND kind = 'class'), '') AS classes FROM kept k"""),
    "node_link_rows": _with(GRAPH, """SELECT 'nodes' AS section, '{"id":"' || id || '","type":"' || type || '"'
        || coalesce(',"language":"' || language || '"', '') || coalesce(',"name":"' || name || '"', '')
        || coalesce(',"file":"' || file || '"', '') || coalesce(',"module":"' || module || '"', '') || '}' AS json FROM nodes
      UNION ALL SELECT 'links', '{"source":"' || src || '","target":"' || dst || '","relationship":"' || relationship || '"'
        || coalesce(',"module":"' || module || '"', '') || '}' FROM edges"""),
    "gexf_edges": _with(GRAPH, "SELECT src AS source, dst AS target, relationship FROM edges"),
    "graph_document": _with(GRAPH, """SELECT true AS directed, false AS multigraph, 'nodes' AS section, id AS a, type AS b, '' AS kind FROM nodes
      UNION ALL SELECT true, false, 'links', src, dst, relationship FROM edges"""),
    "gexf_document": _with(GRAPH, """SELECT 'node' AS section, id AS a, id AS b, type AS kind FROM nodes
      UNION ALL SELECT 'edge', src, dst, relationship FROM edges"""),
    "file_cycles": _with(_FILE_CYCLES, "SELECT * FROM cycles", recursive=True),
    "first_cycles": _with(_FILE_CYCLES, "SELECT * FROM cycles ORDER BY length, chain LIMIT 10", recursive=True),
    "event_cycles": _with(TRANSITIONS + "," + _cycles("transitions"), "SELECT * FROM cycles", recursive=True),
    "file_components": _with(GRAPH + ", inner_edges AS (SELECT src, dst FROM edges WHERE dst_type = 'file')," + _strong("inner_edges"),
                             _STRONG, recursive=True),
    "event_components": _with(TRANSITIONS + "," + _strong("transitions"), _STRONG, recursive=True),
    "event_graph_stats": _with(TRANSITIONS, _graph_stats("event_nodes", "transitions", "'file'")),
    "event_degrees": _with(TRANSITIONS, """SELECT id AS file, (SELECT count(*) FROM transitions WHERE src = id) AS out_degree,
      (SELECT count(*) FROM transitions WHERE src = id) AS import_out_degree,
      (SELECT count(*) FROM transitions WHERE dst = id) AS in_degree FROM event_nodes"""),
    "shingle_counts": _with(_characters(_COLLAPSED, "documents"), """SELECT d.doc_id,
      count(DISTINCT c0 || c1 || c2 || c3 || c4) AS shingles
      FROM documents d LEFT JOIN windows w ON w.doc_id = d.doc_id GROUP BY d.doc_id"""),
    "trigram_counts": _with(f"words AS (SELECT doc_id, {_WORD_CHARS} AS t FROM documents),"
                            + _characters("t", "words"), """SELECT d.doc_id,
      greatest(count(c0 || c1 || c2), 1) AS grams, greatest(count(DISTINCT c0 || c1 || c2), 1) AS distinct_grams
      FROM words d LEFT JOIN windows w ON w.doc_id = d.doc_id GROUP BY d.doc_id"""),
    "minhash_signatures": _with(_signatures("documents"), "SELECT doc_id, md5(array_to_string(signature, ',')) AS signature FROM signatures"),
    "minhash_pairs": _with(_signatures("documents"), """SELECT *, CASE WHEN similarity >= 0.95 THEN 'red'
      WHEN similarity >= 0.90 THEN 'orange' ELSE 'yellow' END AS severity FROM pairs"""),
    "minhash_copies": _with(_signatures("documents"), """SELECT s.doc_id AS id, c.id AS representative
      FROM signatures s JOIN classes c ON c.signature = s.signature WHERE s.doc_id <> c.id"""),
    "minhash_stats": _with(_signatures("documents"), _DUPLICATE_STATS.format(docs="documents")),
    "source_duplicate_stats": _SOURCE_DUPLICATES,
    "exact_similarity": _with(_signatures("documents") + "," + _EXACT_PAIRS + """,
      members AS (SELECT s.signature, same.id FROM same JOIN signatures s ON s.doc_id = same.id),
      estimated AS (SELECT x.id AS a, y.id AS b FROM pairs JOIN classes p ON p.id = id_a JOIN classes q ON q.id = id_b
        JOIN members x ON x.signature = p.signature JOIN members y ON y.signature = q.signature
        UNION SELECT x.id, y.id FROM members x JOIN members y ON x.signature = y.signature AND x.id < y.id),
      links AS (SELECT id_a, id_b FROM exact UNION SELECT least(a, b), greatest(a, b) FROM estimated),
      common AS (SELECT id_a, id_b, count(b.s) AS n FROM links JOIN held a ON a.id = id_a
        LEFT JOIN held b ON b.id = id_b AND b.s = a.s GROUP BY ALL)""",
        f"""SELECT c.id_a, c.id_b, round(c.n::DOUBLE / (a.n + b.n - c.n), 6) AS jaccard
        FROM common c JOIN sizes_of a ON a.id = id_a JOIN sizes_of b ON b.id = id_b
        UNION ALL SELECT DISTINCT same.id, doc_id, 1.0::DOUBLE FROM documents JOIN same ON t = {_COLLAPSED} WHERE same.id IS DISTINCT FROM doc_id"""),
    "exact_pairs": _with(_EXACT_PAIRS, "SELECT id_a, id_b, round(jaccard, 6) AS jaccard, copies_a, copies_b FROM exact"),
    "minhash_recall": _with(_signatures("documents") + "," + _EXACT_PAIRS + """,
      ends AS (SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM exact
        JOIN signatures s ON s.doc_id = exact.id_a JOIN classes a ON a.signature = s.signature
        JOIN signatures t ON t.doc_id = exact.id_b JOIN classes b ON b.signature = t.signature),
      judged AS (SELECT ends.id_a = ends.id_b OR pairs.id_a IS NOT NULL AS hit
        FROM ends LEFT JOIN pairs ON pairs.id_a = ends.id_a AND pairs.id_b = ends.id_b)""",
      """SELECT count(*) AS exact_pairs, count(*) FILTER (hit) AS found_pairs,
        round(count(*) FILTER (hit) / count(*)::DOUBLE, 4) AS recall FROM judged HAVING count(*) > 0"""),
    "duplicate_components": _with(_signatures("documents") + """,
      links AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT c.id, s.doc_id
        FROM signatures s JOIN classes c ON c.signature = s.signature WHERE s.doc_id <> c.id),
      sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
      reached AS (SELECT a AS id, a AS other FROM sides UNION SELECT r.id, s.b FROM reached r JOIN sides s ON s.a = r.other)""",
      "SELECT id, min(other) AS component FROM reached GROUP BY id", recursive=True),
    "simhash_fingerprints": _with(_fingerprints(), "SELECT id, fingerprint FROM fingerprints"),
    "simhash_pairs": _with(_fingerprints(), """SELECT a.id AS id_a, b.id AS id_b,
      bit_count(xor(a.fingerprint, b.fingerprint)) AS distance FROM classes a JOIN classes b
      ON a.id < b.id AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 3"""),
    "simhash_groups": _with(_fingerprints() + "," + _LEADERS, "SELECT leader, id FROM members", recursive=True),
    "simhash_stats": _with(_fingerprints() + "," + _LEADERS, """SELECT (SELECT count(*) FROM fingerprints) AS files_analyzed,
      (SELECT count(DISTINCT leader) FROM members) AS duplicate_groups_found, 3 AS hamming_distance_k""", recursive=True),
    "vector_search": """WITH parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
      means AS (SELECT label, i, avg(x::DOUBLE) AS x FROM parts GROUP BY ALL),
      centroids AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label),
      scored AS (SELECT c.label::BIGINT AS query_id, e.vec_id AS id, e.label,
        round(list_inner_product(c.v, e.embedding::DOUBLE[]), 6) AS score FROM centroids c, embeddings e)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10""",
    "document_vectors": _with("docs AS (SELECT doc_id AS id, text FROM documents)," + _vectors("v", "docs"), """
      SELECT doc_id, count(w) AS buckets, round(max(w)::DOUBLE, 6) AS largest
      FROM documents LEFT JOIN v ON id = doc_id GROUP BY doc_id"""),
    "text_search": _with(r"""docs AS (SELECT 'notes/d' || doc_id || '.md' AS id, text FROM documents
        WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 20),
      asked AS (SELECT item_id AS id, text FROM benchmark WHERE length(text) >= 3),"""
      + _vectors("v", "docs") + "," + _vectors("q", "asked"), """
      SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank
      FROM (SELECT q.id AS query_id, v.id AS path, round(sum(q.w::DOUBLE * v.w::DOUBLE), 6) AS score
        FROM q JOIN v ON v.bucket = q.bucket GROUP BY ALL) QUALIFY rank <= 10"""),
    "vector_table": """SELECT 'job-' || label AS job_id, vec_id AS id, len(embedding) AS width,
      round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE label = 3""",
    "current_jobs": _with(JOBS, """SELECT job_id, repo_url, status, error, report_path, summary,
      strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
      strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM jobs"""),
    "job_snapshot": _with(JOBS, """SELECT job_id, repo_url, status, error, report_path, summary,
      strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
      strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM jobs"""),
    "final_status": f"""WITH failed AS (SELECT event_id, CASE event_type
        WHEN 'error' THEN ['Could not read ' || props, 'Code metrics failed: x']
        WHEN 'click' THEN ['Could not read ' || repeat(props, 200)]
        WHEN 'view' THEN ['FAISS index build failed: y'] ELSE [] END AS errors FROM events)
      SELECT event_id, CASE WHEN len(list_filter(errors, lambda e: {_FATAL})) > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
        CASE WHEN len(errors) > 0 THEN left(array_to_string(errors, '; '), 1000) END AS error,
        array_to_string(errors, chr(10)) AS errors FROM failed""",
    "status_view": _with(JOBS, """SELECT job_id, status, repo_url, summary,
      strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
      CASE WHEN status = 'COMPLETED' THEN '/analyze/results/' || job_id END AS results_url,
      CASE WHEN status = 'FAILED' THEN error END AS error FROM jobs"""),
    "results_view": _with(JOBS + """,
      reports AS (SELECT user_id::VARCHAR AS job_id, 'purchases: ' || count(*) AS report
        FROM events WHERE event_type = 'purchase' GROUP BY 1),
      viewed AS (SELECT job_id, status, report, CASE WHEN status IN ('PENDING', 'RUNNING') THEN 'Job is ' || status
        WHEN report_path IS NULL AND status = 'FAILED' THEN 'Job failed: ' || coalesce(error, '')
        WHEN report_path IS NULL THEN 'Job ' || status || ' but no report file path found'
        WHEN report IS NULL THEN 'Report file not found' END AS error FROM jobs LEFT JOIN reports USING (job_id))""",
      "SELECT job_id, status, error, CASE WHEN error IS NULL THEN report END AS report FROM viewed"),
    "json_values": """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN
        CASE WHEN l_linenumber > 3 THEN 'inf' ELSE '-inf' END ELSE printf('%.1f', l_quantity) END AS value FROM lineitem""",
    "nested_json_values": r"""WITH lines AS (
        SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, '{"n":' || l_linenumber || ',"ratio":'
          || CASE WHEN l_discount = 0 THEN CASE WHEN l_linenumber > 3 THEN '"inf"' ELSE '"-inf"' END ELSE printf('%.1f', round(l_quantity)) END
          || ',"z":{"real":' || printf('%.1f', round(l_quantity)) || ',"imag":'
          || CASE WHEN l_discount = 0 THEN '"-inf"' ELSE '0.0' END || '}}' AS line,
          CASE WHEN l_discount = 0 THEN CASE WHEN l_linenumber > 3 THEN 'inf' ELSE '-inf' END::DOUBLE ELSE round(l_quantity) END AS ratio, round(l_quantity) AS amount FROM lineitem)
      SELECT l_orderkey, md5('{"l_orderkey":' || l_orderkey || ',"lines":[' || string_agg(line, ',' ORDER BY l_linenumber, ratio, amount) || '],"flags":['
        || (SELECT string_agg('"' || f || '"', ',' ORDER BY f) FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem i WHERE i.l_orderkey = lines.l_orderkey))
        || '],"by status":{' || (SELECT string_agg('"' || f || '":"inf"', ',' ORDER BY f) FROM (
          SELECT DISTINCT l_linestatus AS f FROM lineitem i WHERE i.l_orderkey = lines.l_orderkey)) || '},"none":null}') AS json
      FROM lines GROUP BY l_orderkey""",
    "humanized_numbers": r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 'N/A'
        ELSE regexp_replace(format('{:,.3f}', l_extendedprice), '\.?0+$', '') END AS grouped,
      CASE WHEN floor(l_extendedprice) > 1000 THEN printf('%.1f',
          (floor(l_extendedprice) + (floor(l_extendedprice)::BIGINT % 1000 IN (250, 750))::INT) / 1000) || 'K'
        ELSE regexp_replace(format('{:,.3f}', floor(l_extendedprice)), '\.?0+$', '') END AS loc FROM lineitem""",
    "full_report": f"SELECT *, 3 AS suggestions, true AS excluded_third_party, true AS excluded_tests, 0 AS errors, 'COMPLETED' AS status FROM ({_REPORT})",
    "report_without_third_party_filter": _with(SF, f"""SELECT 'job-2' AS job_id, count(*) AS files_analyzed,
      sum(CASE WHEN path LIKE '%.java' THEN 2 ELSE 3 END)::BIGINT AS total_functions,
      count(*) FILTER (NOT {_VENDORED}) AS graph_files, 'COMPLETED' AS status FROM sf WHERE NOT {_TEST}"""),
    "tree_scan": _with(SF, f"SELECT path, length(content) AS chars, NULL::VARCHAR AS error FROM sf WHERE NOT {_VENDORED}"),
    "job_summary": f"""SELECT job_id, repository, loc, debt_score, avg_complexity,
      duplicate_pairs_found AS duplicate_pairs FROM ({_REPORT})""",
    "report_round_trip": _with(METRICS, """SELECT ext AS job_id, sum(loc)::BIGINT AS loc,
      sum(marker_comments)::BIGINT AS markers FROM file_metrics WHERE ext = '.ts' GROUP BY ext"""),
}
