"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeline.llm import chat, decontaminate, exact_dedup, hard_negatives, line_dedup, near_dedup, packing, phrases, pieces, secrets, suffix_dedup, toxicity, url_filter
from treeline.llm.store import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


@query
def op1_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.repeated_strings(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op2_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2).drop("key")


_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES["op2_minhash_near_dedup"] = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ALPHABET}), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS shingle FROM doc_words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * shared.n >= 80 * (s.n + t.n - shared.n)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reached.doc_id, sides.b FROM reached JOIN sides ON sides.a = reached.other
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""



RULES = (
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


@query
def op3_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


_ISSUED = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|npm_[A-Za-z0-9]{36}"
    r"|xox[abeprs]-[A-Za-z0-9\-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w\-]{35}|hf_[A-Za-z0-9]{34}"
    r"|eyJ[\w\-]{13,}(?:\.[\w\-]+){0,2})$"
)
_ASSIGNED = r"(?i)(?:key|token|secret|passw|pwd|passphrase|auth|credential|bearer)\w*[\"']?\s*[=:]+\s*[\"']?$"
_RANDOM = (
    r"^(?:(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_\-]{20,}={0,2})$"
)
_PLACEHOLDER = (
    r"(?i)^(?:(.)\1*|(?:your|my|some|insert|replace|enter|example|sample|dummy|change)[_\-]?\w*|<.*>?|\$?\{.*\}?|%\w+%?"
    r"|null|none|nil|true|false|undefined|todo|redacted|placeholder|\w*(?:changeme|placeholder|xxxx)\w*)$"
)
_UUID = r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"
_PATH = r"^(?:[a-z]{2,}[_\-]?)+(?:/(?:[a-z]{2,}[_\-]?)+)+$"
_WORD = r"^(?:[A-Z]?[a-z]+|[A-Z]+)(?:[_\-](?:[A-Z]?[a-z]+|[A-Z]+))*$"
_DIGEST = r"(?i)\b(?:sha-?[0-9]*|md5|checksum|digest|hash|integrity|commit|etag|revision)\W{1,4}$"


def labelled_findings(found: DataFrame) -> DataFrame:
    """Findings of four folds of the ids with a label that their form proves (1) or rules out (0), else null.

    True: issuers' formats, and random hex or base64 digits assigned to a credential word.
    False: UUIDs, placeholders, paths of words, digests named as such; and, without a
    credential word before or behind, words of letters and plain numbers.
    """
    candidate, before = F.col("candidate"), F.col("before")
    near = rf"(?i){secrets._CREDENTIAL}"
    apart = ~before.rlike(near) & ~F.col("after").rlike(near) & ~F.col("after").rlike("^@")
    harmless = (
        candidate.rlike(_UUID) | candidate.rlike(_PLACEHOLDER) | candidate.rlike(_PATH)
        | (candidate.rlike("(?i)^[0-9a-f]{32,}$") & before.rlike(_DIGEST))
        | (apart & (candidate.rlike(_WORD) | candidate.rlike("^[0-9]+$")))
    )
    issued = candidate.rlike(_ISSUED) | (before.rlike(_ASSIGNED) & candidate.rlike(_RANDOM))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return found.where(fold != 0).withColumn("label", F.when(harmless, 0).when(issued, 1))


@query
def op4_secret_scan(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = stored(secrets.findings(documents), "findings")
    dictionary, pairs = secrets.language(documents)
    model = secrets.train(labelled_findings(found), dictionary, pairs)
    scored = secrets.score(found, model, dictionary, pairs)
    return scored.select(
        "doc_id", "nth", "candidate", "score", (F.col("score") >= 0.5).alias("secret"),
    )


@query
def op5_chat_formatting(spark, sf_dir):
    odd = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.format_conversations(rows).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op5_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS text_chars,
    length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) AS role_chars,
    coalesce(lag(role) OVER w = role, false) AS goes_on
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN goes_on THEN 8 ELSE 24 + role_chars END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op6_line_dedup(spark, sf_dir):
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id", F.coalesce(F.size(F.split("row.text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"),
    )


ORACLES["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, source, text, i, string_split(text, chr(10))[i] AS raw
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), trimmed AS (
  SELECT doc_id, source, i, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM lines
), boilerplate AS (
  SELECT line, min((doc_id, i)) AS first FROM trimmed WHERE length(line) >= 20
  GROUP BY line HAVING count(DISTINCT source) >= 5
), judged AS (
  SELECT doc_id, i, raw, first IS NOT NULL AND (doc_id, i) <> first AS gone
  FROM trimmed LEFT JOIN boilerplate USING (line)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS left_over
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN text IS NOT NULL THEN sha256(left_over) END AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


@query
def op7_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op7_benchmark_decontamination"] = rf"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, {_ALPHABET}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), patterns AS (
  SELECT DISTINCT item, w[i : i + 9] AS pattern
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ALPHABET}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), lengths AS (
  SELECT DISTINCT len(pattern) AS n FROM patterns
), places AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS pattern
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, n, item FROM places JOIN patterns USING (pattern)
), hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query
def op8_sentencepiece(spark, sf_dir):
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return encoded.select(
        "row.doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "round_trip", "ids"
    )


@query
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLES["op9_exact_dedup"] = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content FROM documents
), groups AS (
  SELECT content, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
  FROM rows GROUP BY content
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM rows JOIN groups USING (content)
"""


@query
def op10_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op11_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), {_ALPHABET}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), starts AS (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM worded, (VALUES (1), (2), (3)) AS sizes(size) WHERE len(w) >= size
), counts AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, any_value(w[i : i + size - 1]) AS words, count(*) AS f
  FROM starts GROUP BY lang, size, phrase HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.size, c.phrase, c.words, c.f AS a, k, l.f AS l, r.f AS r,
    CAST((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c
  JOIN counts l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(c.words[1 : k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(c.words[k + 1 :], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, array_to_string(words[1 : 2], ' ') AS phrase, f FROM counts WHERE size = 3
  UNION ALL SELECT lang, array_to_string(words[2 : 3], ' '), f FROM counts WHERE size = 3
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM parts GROUP BY lang, phrase
), ranked AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * longer.f < 50 * a, true)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op12_best_fit_packing(spark, sf_dir):
    cut = packing.pieces(table(spark, sf_dir, "documents"))
    # the digest stands for the ids, so that these are not shuffled
    return packing.placed(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op13_hard_negatives(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(embeddings.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scores n USING (anchor_id)
WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY rank <= 10
"""
