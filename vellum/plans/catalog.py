"""Query catalogue: one callable per operator, each ``(spark, sf_dir) -> DataFrame``, and
the DuckDB SQL stating the same result over the same parquet tables.

Every query reads whole tables. Where a second version of a table is needed (a manifest,
an upsert batch) it is derived from the table itself by a data attribute (``lang``), never
by sampling ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import config
from vellum.operators import classify as C
from vellum.operators import files_meta as FM
from vellum.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def keywords_values_sql() -> str:
    rows = []
    for rank, (cat, words) in enumerate(config.KEYWORDS.items(), start=1):
        for w in words:
            rows.append(f"({rank}, {_sql_str(cat)}, {_sql_str(w.lower())})")
    return "VALUES " + ", ".join(rows)


# ---------------------------------------------------------------------------- A2 / B1
@query("fingerprint_md5", "SELECT doc_id, md5(text) AS md5 FROM documents")
def q_fingerprint_md5(spark, d):
    return FM.fingerprint_md5(table(spark, d, "documents", "doc_id", "text"))


@query("file_type", r"""
SELECT page_id,
       lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^./]+)$', 1)) AS file_type
FROM pages""")
def q_file_type(spark, d):
    return FM.file_types(table(spark, d, "pages", "page_id", "url"))


# ---------------------------------------------------------------------------- D1 / D2 / X3
_KW_SCORES_SQL = f"""
WITH kw(rank, category, keyword) AS ({keywords_values_sql()}),
s AS (SELECT doc_id, lower(coalesce(text, '')) AS t
      FROM documents),
sc AS (SELECT doc_id, rank, category,
              CAST(sum((length(t) - length(replace(t, keyword, ''))) // length(keyword))
                   AS BIGINT) AS score
       FROM s CROSS JOIN kw GROUP BY doc_id, rank, category)
"""


@query("keyword_scores", _KW_SCORES_SQL + "SELECT doc_id, category, score FROM sc WHERE score > 0")
def q_keyword_scores(spark, d):
    return C.keyword_scores(table(spark, d, "documents", "doc_id", "text", fan_out=True))


@query("classify_keyword", _KW_SCORES_SQL + f"""
SELECT s.doc_id,
       coalesce((SELECT arg_min(category, -score * 1000 + rank) FROM sc
                 WHERE sc.doc_id = s.doc_id AND sc.score > 0), {_sql_str(config.DEFAULT_CATEGORY)})
         AS file_category
FROM s""")
def q_classify_keyword(spark, d):
    return C.classify_keyword(table(spark, d, "documents", "doc_id", "text", fan_out=True))


@query("classification_sample", f"""
WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
           FROM conversations)
SELECT conv_id, substring(string_agg(text, chr(10) ORDER BY rn), 1, {config.SAMPLE_MAX_CHARS}) AS sample
FROM p WHERE rn <= 3 GROUP BY conv_id""")
def q_classification_sample(spark, d):
    # Conversations stand in for multi-part files (turn = part index); the 3-part limit
    # exercises the part cut that the 20-part default never reaches on this data.
    return C.classification_sample(table(spark, d, "conversations", "conv_id", "turn", "text"),
                                   key="conv_id", order="turn", max_parts=3)


# ---------------------------------------------------------------------------- corpus as files
# The documents table stands in for a corpus of one-part files: path = source/doc_id.
# The "previous" state (manifest) is derived from the same table by language: German files
# were deleted since, Spanish ones are new, French ones were edited, English unchanged.
def _files(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "text")
    return docs.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string"))
                       .alias("path"), "lang", F.md5("text").alias("md5"), "text")


def _current(spark, d):
    return _files(spark, d).where(F.col("lang") != "de")


def _manifest(spark, d):
    f = table(spark, d, "documents", "doc_id", "source", "lang", "text").where(F.col("lang") != "es")
    return f.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
                    F.when(F.col("lang") == "fr", F.md5(F.concat("text", F.lit("\n"))))
                    .otherwise(F.md5("text")).alias("md5"))


_FILES_SQL = """
WITH cur AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS path, md5(text) AS md5
             FROM documents WHERE lang <> 'de'),
man AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) AS path,
               CASE WHEN lang = 'fr' THEN md5(text || chr(10)) ELSE md5(text) END AS md5
        FROM documents WHERE lang <> 'es')
"""


@query("changed_files", _FILES_SQL + """
SELECT doc_id, md5 FROM cur WHERE NOT EXISTS (
  SELECT 1 FROM man WHERE man.path = cur.path AND man.md5 = cur.md5)""")
def q_changed_files(spark, d):
    from vellum.operators.index import changed_files
    return changed_files(_current(spark, d), _manifest(spark, d)).select("doc_id", "md5")


@query("corpus_diff", _FILES_SQL + """
SELECT CAST(split_part(coalesce(cur.path, man.path), '/', 2) AS BIGINT) AS doc_id,
       CASE WHEN man.md5 IS NULL THEN 'new' WHEN cur.md5 IS NULL THEN 'deleted'
            WHEN man.md5 = cur.md5 THEN 'unchanged' ELSE 'changed' END AS state
FROM cur FULL OUTER JOIN man ON cur.path = man.path""")
def q_corpus_diff(spark, d):
    from vellum.operators.index import corpus_diff
    diff = corpus_diff(_current(spark, d), _manifest(spark, d))
    return diff.select(F.substring_index("path", "/", -1).cast("bigint").alias("doc_id"), "state")


# ---------------------------------------------------------------------------- chunking
@query("chunk_fixed", f"""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, unnest(range(0, CASE WHEN n <= {config.CHUNK_SIZE} THEN 0
             ELSE CAST(ceil((n - {config.CHUNK_SIZE}) / {config.CHUNK_SIZE - config.CHUNK_OVERLAP}.0) AS BIGINT) END + 1))
             AS chunk_index FROM d)
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index,
       CAST(chunk_index * {config.CHUNK_SIZE - config.CHUNK_OVERLAP} AS INTEGER) AS start_index,
       substring(text, chunk_index * {config.CHUNK_SIZE - config.CHUNK_OVERLAP} + 1, {config.CHUNK_SIZE}) AS text
FROM c""")
def q_chunk_fixed(spark, d):
    from vellum.operators.chunk import chunk_fixed
    return chunk_fixed(table(spark, d, "documents", "doc_id", "text"))


def _recursive_sql(size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> str:
    """``rc(doc_id, chunk_index, start_index, text)``: the recursive splitter in SQL.

    Level k cuts what is left at separator k, the separator beginning the next piece: pieces shorter
    than ``size`` are done, runs of them between longer ones are packed together, longer ones (and texts
    without that separator) go to the next level. Packing walks each run with a recursive query:
    from piece ``a`` to the last that fits, then back to the first that overlaps enough."""
    seps = config.SEPARATORS[:-1]
    ctes = ["l0 AS (SELECT doc_id, 0 AS off, text AS t, TRUE AS top FROM documents WHERE length(text) > 0)"]
    for k, sep in enumerate(seps):
        lit = _sql_lit_ws(sep)
        ctes.append(f"""s{k} AS (SELECT doc_id, off AS base, u.i, CASE WHEN u.i = 1 THEN parts[u.i] ELSE {lit} || parts[u.i] END AS piece
  FROM (SELECT doc_id, off, string_split(t, {lit}) AS parts FROM l{k} WHERE contains(t, {lit})) x,
       unnest(range(1, len(parts) + 1)) AS u(i))""")
        ctes.append(f"""p{k} AS (SELECT doc_id, base, i, piece, length(piece) AS n,
    CAST(base + coalesce(sum(length(piece)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off,
    sum(CASE WHEN length(piece) >= {size} THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM s{k} WHERE length(piece) > 0 WINDOW w AS (PARTITION BY doc_id, base ORDER BY i))""")
        ctes.append(f"""l{k + 1} AS (SELECT doc_id, off, piece AS t, FALSE AS top FROM p{k} WHERE n >= {size}
  UNION ALL SELECT doc_id, off, t, top FROM l{k} WHERE NOT contains(t, {lit}))""")
    good = " UNION ALL ".join(f"SELECT doc_id, {k} AS level, base, run, off, piece, n FROM p{k} WHERE n < {size}" for k in range(len(seps)))
    last, step = f"l{len(seps)}", size - overlap
    ctes.append(f"good AS ({good})")
    ctes.append("""grp AS (SELECT doc_id, min(off) AS g, list(off ORDER BY off) AS offs, list(off + n ORDER BY off) AS ends,
    string_agg(piece, '' ORDER BY off) AS body FROM good GROUP BY doc_id, level, base, run)""")
    ctes.append(f"""walk AS (
  SELECT doc_id, g, offs, ends, body, 1 AS a, len(list_filter(ends, lambda e: e <= offs[1] + {size})) AS b FROM grp
  UNION ALL
  SELECT doc_id, g, offs, ends, body, a, greatest(len(list_filter(ends, lambda e: e <= offs[a] + {size})), a) AS b FROM (
    SELECT doc_id, g, offs, ends, body,
           len(list_filter(offs, lambda o: o < greatest(ends[b] - {overlap}, ends[b + 1] - {size}))) + 1 AS a
    FROM walk WHERE b < len(ends)) nxt)""")
    ctes.append(f"""raw AS (SELECT doc_id, offs[a] AS off, body[offs[a] - g + 1:ends[b] - g] AS t FROM walk
  UNION ALL SELECT doc_id, off + i * {step}, t[i * {step} + 1:i * {step} + {size}] FROM {last},
    unnest(range(0, greatest(CAST(ceil((length(t) - {size}) / {step}.0) AS BIGINT), 0) + 1)) AS u(i))""")
    ctes.append(f"""rc AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY off) - 1 AS INTEGER) AS chunk_index,
    CAST(off + length(t) - length(regexp_replace(t, '^[ \\t\\n\\r\\f\\x0B]+', '')) AS INTEGER) AS start_index, {_strip_sql("t")} AS text
  FROM raw WHERE length({_strip_sql("t")}) > 0)""")
    return ",\n".join(ctes)


def _sql_lit_ws(s: str) -> str:
    return " || ".join("chr(10)" if c == "\n" else _sql_str(c) for c in s) if "\n" in s else _sql_str(s)


_WS_SQL = "'^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$'"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {_WS_SQL}, '', 'g')"


@query("chunk_recursive", f"WITH RECURSIVE {_recursive_sql()} SELECT doc_id, chunk_index, start_index, text FROM rc")
def q_chunk_recursive(spark, d):
    from vellum.operators.chunk import chunk_recursive
    return chunk_recursive(table(spark, d, "documents", "doc_id", "text", fan_out=True))


def _ids_sql(where: str = "TRUE", text: str = "text") -> str:
    return f"""
SELECT doc_id, source, lang, {text} AS text,
       coalesce(source, '') || ':' || coalesce(lang, '') || ':' ||
       CAST(row_number() OVER (PARTITION BY source, run ORDER BY doc_id) - 1 AS VARCHAR) AS id
FROM (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY doc_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM (SELECT doc_id, source, lang, text,
                   CASE WHEN row_number() OVER w > 1 AND lag(lang) OVER w IS NOT DISTINCT FROM lang
                        THEN 0 ELSE 1 END AS new
            FROM documents WHERE {where}
            WINDOW w AS (PARTITION BY source ORDER BY doc_id)) r) g"""


def _ids(spark, d, docs=None):
    from vellum.operators.chunk import chunk_ids
    docs = docs if docs is not None else table(spark, d, "documents", "doc_id", "source", "lang", "text")
    return chunk_ids(docs, "source", "lang", ["doc_id"])


@query("chunk_ids", f"SELECT doc_id, id FROM ({_ids_sql()}) x")
def q_chunk_ids(spark, d):
    return _ids(spark, d).select("doc_id", "id")


@query("dedup_latest", f"SELECT id, max(doc_id) AS doc_id FROM ({_ids_sql()}) x GROUP BY id")
def q_dedup_latest(spark, d):
    from vellum.operators.chunk import dedup_latest
    return dedup_latest(_ids(spark, d).select("source", "id", "doc_id"), ["source", "id"],
                        "doc_id").select("id", "doc_id")


# ---------------------------------------------------------------------------- index upsert
# Old batch: every document but the Spanish ones. New batch: French and Spanish documents
# with edited text. Ids are computed per batch, as each add call computes them.
def _batch(spark, d, old: bool):
    from vellum.operators.chunk import dedup_latest
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "text")
    if old:
        docs = docs.where(F.col("lang") != "es")
    else:
        docs = docs.where(F.col("lang").isin("fr", "es")).withColumn(
            "text", F.concat("text", F.lit(" [rev]")))
    rows = _ids(spark, d, docs).select("id", "doc_id", "source", F.md5("text").alias("md5"))
    return dedup_latest(rows, ["source", "id"], "doc_id").select("id", "doc_id", "source", "md5")


_BATCH_SQL = f"""
WITH o AS (SELECT id, arg_max(doc_id, doc_id) AS doc_id, arg_max(source, doc_id) AS source,
                  arg_max(md5(text), doc_id) AS md5
           FROM ({_ids_sql("lang <> 'es'")}) x GROUP BY id),
n AS (SELECT id, arg_max(doc_id, doc_id) AS doc_id, arg_max(source, doc_id) AS source,
             arg_max(md5(text), doc_id) AS md5
      FROM ({_ids_sql("lang IN ('fr', 'es')", "text || ' [rev]'")}) x GROUP BY id)
"""


@query("index_upsert", _BATCH_SQL + """
SELECT id, doc_id, md5 FROM o WHERE id NOT IN (SELECT id FROM n)
UNION ALL SELECT id, doc_id, md5 FROM n""")
def q_index_upsert(spark, d):
    from vellum.operators.index import upsert
    return upsert(_batch(spark, d, True), _batch(spark, d, False)).select("id", "doc_id", "md5")


@query("index_replace_source", _BATCH_SQL + """
SELECT id, doc_id, md5 FROM o
WHERE source NOT IN (SELECT source FROM n) AND id NOT IN (SELECT id FROM n)
UNION ALL SELECT id, doc_id, md5 FROM n""")
def q_index_replace_source(spark, d):
    from vellum.operators.index import replace_source
    return replace_source(_batch(spark, d, True), _batch(spark, d, False)).select(
        "id", "doc_id", "md5")


# Index of classified documents: id from chunk_ids, the latest document per id wins.
def _classified_index(spark, d):
    from vellum.operators.chunk import dedup_latest
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "text", fan_out=True)
    cat = C.classify_keyword(docs.select("doc_id", "text"))
    rows = _ids(spark, d, docs).join(cat, "doc_id").select("id", "doc_id", "source",
                                                             "file_category")
    return dedup_latest(rows, ["source", "id"], "doc_id").select("id", "doc_id", "source",
                                                                 "file_category")


_CLASSIFIED_SQL = _KW_SCORES_SQL + f""",
cat AS (SELECT s.doc_id, coalesce((SELECT arg_min(category, -score * 1000 + rank) FROM sc
                 WHERE sc.doc_id = s.doc_id AND sc.score > 0), 'GENERAL') AS file_category FROM s),
idx AS (SELECT id, arg_max(x.doc_id, x.doc_id) AS doc_id, arg_max(source, x.doc_id) AS source,
               arg_max(file_category, x.doc_id) AS file_category
        FROM ({_ids_sql()}) x JOIN cat ON cat.doc_id = x.doc_id GROUP BY id)
"""


@query("index_count", _CLASSIFIED_SQL + "SELECT CAST(count(*) AS BIGINT) AS n FROM idx")
def q_index_count(spark, d):
    from vellum.operators.index import index_count
    return index_count(_classified_index(spark, d))


@query("peek_sources", _CLASSIFIED_SQL + f"""
SELECT coalesce(source, 'N/A') AS source, arg_min(coalesce(file_category, 'N/A'), id) AS file_category
FROM idx GROUP BY 1""")
def q_peek_sources(spark, d):
    from vellum.operators.index import peek_sources
    return peek_sources(_classified_index(spark, d))


# ---------------------------------------------------------------------------- retrieval
# Index: the embeddings table (id = vec_id). Queries: the unit mean vector of each label,
# so the query table is derived from the whole index and every query scans all of it.
def _vec_index(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding", fan_out=True).withColumnRenamed("vec_id", "id")


def _vec_queries(spark, d):
    from vellum.operators.search import centroid_queries
    return centroid_queries(table(spark, d, "embeddings", "label", "embedding"))


def _hits(spark, d, threshold, mode="cosine"):
    from vellum.operators.search import topk_similarity
    return topk_similarity(_vec_index(spark, d), _vec_queries(spark, d), k=config.TOP_K,
                           threshold=threshold, mode=mode)


def _score_sql(mode: str) -> str:
    cos = ("list_dot_product(ev, qv) / (sqrt(list_dot_product(ev, ev)) * sqrt(list_dot_product(qv, qv)))")
    return cos if mode == "cosine" else f"(1.0 + {cos}) / 2.0"


def _hits_sql(threshold: float, mode: str = "cosine") -> str:
    return f"""
WITH dims AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m
              FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos
                    FROM embeddings) u GROUP BY label, pos),
qn AS (SELECT label, sqrt(sum(m * m)) AS n FROM dims GROUP BY label),
q AS (SELECT dims.label AS query_id,
             list(CASE WHEN qn.n > 0 THEN m / qn.n ELSE m END ORDER BY pos) AS qv
      FROM dims JOIN qn ON dims.label = qn.label GROUP BY dims.label),
e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS ev FROM embeddings),
s AS (SELECT query_id, id, round({_score_sql(mode)}, 6) AS score FROM e CROSS JOIN q),
hits AS (SELECT query_id, id, CAST(rn AS INTEGER) AS rank, score FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn
           FROM s WHERE score >= {threshold}) r WHERE rn <= {config.TOP_K})
"""


@query("topk_similarity", _hits_sql(0.2) + "SELECT query_id, id, rank, score FROM hits")
def q_topk_similarity(spark, d):
    return _hits(spark, d, 0.2)


LSH_TABLES, LSH_BITS = 32, 6


def _lsh_sql(threshold: float) -> str:
    """Bucket signs by the generator of ``search.planes``; candidates share a bucket of some table."""
    n = LSH_TABLES * LSH_BITS
    return _hits_sql(threshold).split("\ns AS (")[0] + f"""
g1 AS (SELECT p, i, (i * 7919 + p * 104729 + 1) % 2147483647 * 48271 % 2147483647 AS h
       FROM range({n}) AS a(p), (SELECT unnest(range(max(len(ev)))) AS i FROM e) w),
g2 AS (SELECT p, i, (h * 48271 + p) % 2147483647 AS h FROM g1),
planes AS MATERIALIZED (SELECT p, i, CASE WHEN (h * 48271 + i) % 2147483647 % 2 = 1 THEN 1.0 ELSE -1.0 END AS sign FROM g2),
normals AS MATERIALIZED (SELECT p, list(CAST(sign AS DOUBLE) ORDER BY i) AS normal FROM planes GROUP BY p),
vecs AS (SELECT 'i' AS side, id AS k, ev AS v FROM e UNION ALL SELECT 'q', query_id, qv FROM q),
sig AS MATERIALIZED (SELECT side, k, p // {LSH_BITS} AS t,
          sum(CASE WHEN list_dot_product(v, normal) > 0 THEN 1 << (p % {LSH_BITS}) ELSE 0 END) AS bucket
        FROM vecs CROSS JOIN normals WHERE list_dot_product(v, v) > 0 GROUP BY side, k, p // {LSH_BITS}),
pairs AS (SELECT DISTINCT a.k AS id, b.k AS query_id FROM sig a JOIN sig b
          ON a.side = 'i' AND b.side = 'q' AND a.t = b.t AND a.bucket = b.bucket),
s AS (SELECT query_id, id, round({_score_sql("cosine")}, 6) AS score FROM pairs JOIN e USING (id) JOIN q USING (query_id))
SELECT query_id, id, CAST(rn AS INTEGER) AS rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s WHERE score >= {threshold}) r
WHERE rn <= {config.TOP_K}"""


@query("topk_similarity_lsh", _lsh_sql(0.2))
def q_topk_similarity_lsh(spark, d):
    from vellum.operators.search import topk_similarity_lsh
    return topk_similarity_lsh(_vec_index(spark, d), _vec_queries(spark, d),
                               k=config.TOP_K, threshold=0.2, tables=LSH_TABLES, bits=LSH_BITS)


@query("topk_similarity_ivf")
def q_topk_similarity_ivf(spark, d):
    """Approximate: the codes come from a fitted model, so tests/test_ivf.py compares it with brute force."""
    from vellum.operators.ivf import topk_similarity_ivf
    return topk_similarity_ivf(_vec_index(spark, d), _vec_queries(spark, d), k=config.TOP_K, threshold=0.2)


@query("retrieval_confidence", _hits_sql(0.5, "unit") + """
SELECT q.query_id, coalesce(CAST(sum(CAST(round(score * 1000000) AS BIGINT)) AS DOUBLE) / count(score) / CAST(1000000 AS DOUBLE), 0.0) AS confidence
FROM q LEFT JOIN hits ON hits.query_id = q.query_id GROUP BY q.query_id""")
def q_retrieval_confidence(spark, d):
    from vellum.operators.search import retrieval_confidence
    return retrieval_confidence(_hits(spark, d, 0.5, "unit"), _vec_queries(spark, d))


def _context_sql(threshold: float, mode: str = "cosine", confidence: bool = False) -> str:
    sep = config.CONTEXT_SEPARATOR.replace("\n", "' || chr(10) || '")
    conf = ", coalesce(a.conf, 0.0) AS confidence" if confidence else ""
    return _hits_sql(threshold, mode) + f""",
a AS (SELECT hits.query_id,
             list_sort(list(DISTINCT coalesce(doc.source, 'Unknown'))) AS sources,
             string_agg(coalesce(doc.text, ''), '{sep}' ORDER BY hits.rank) AS ctx,
             CAST(sum(CAST(round(score * 1000000) AS BIGINT)) AS DOUBLE) / count(score) / CAST(1000000 AS DOUBLE) AS conf
      FROM hits LEFT JOIN documents doc ON doc.doc_id = hits.id GROUP BY hits.query_id)
SELECT q.query_id, array_to_string(coalesce(a.sources, []), ', ') AS sources,
       CAST(coalesce(len(a.sources), 0) AS INTEGER) AS num_sources,
       coalesce(a.ctx, '{config.NO_CONTEXT}') AS context{conf}
FROM q LEFT JOIN a ON a.query_id = q.query_id"""


def _context(spark, d, threshold, mode="cosine", confidence=False):
    from vellum.operators.search import context_assembly
    docs = table(spark, d, "documents", "doc_id", "source", "text").withColumnRenamed("doc_id", "id")
    out = context_assembly(_hits(spark, d, threshold, mode), docs, _vec_queries(spark, d),
                           with_confidence=confidence)
    return out.withColumn("sources", F.array_join("sources", ", "))


@query("context_assembly", _context_sql(0.2))
def q_context_assembly(spark, d):
    return _context(spark, d, 0.2)


# ---------------------------------------------------------------------------- metadata, html
@query("metadata_scalars", """
SELECT event_id, j.key AS key, j.value ->> '$' AS value
FROM events, json_each(events.props) AS j
WHERE json_type(j.value) NOT IN ('ARRAY', 'OBJECT', 'NULL')""")
def q_metadata_scalars(spark, d):
    from vellum.functions.metadata import metadata_scalars
    return metadata_scalars(table(spark, d, "events", "event_id", "props"), "event_id", "props")


def _html_sql() -> str:
    """SQL twin of ``html_text_column``."""
    from html.entities import name2codepoint

    from vellum.sources import extract as X
    x = "coalesce(html, '')"
    for pattern in (X.COMMENT, *X.SKIPPED):
        x = f"regexp_replace({x}, {_sql_str(pattern)}, '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, {_sql_str(X.BLOCK_TAG)}, chr(10), 'g'), {_sql_str(X.ANY_TAG)}, '', 'g')"
    names = ", ".join(f"'{name}': chr({code})" for name, code in sorted(name2codepoint.items()))
    code = ("CASE WHEN lower(name[1:2]) = '#x' THEN CAST('0x' || name[3:] AS BIGINT) "
            "WHEN name[1] = '#' THEN CAST(name[2:] AS BIGINT) END")
    return f"""
WITH t AS (SELECT page_id, str_split({x}, '&') AS pieces FROM pages),
p AS (SELECT page_id, i, pieces[i] AS piece, regexp_extract(pieces[i], {_sql_str(X.REFERENCE)}, 1) AS name
      FROM t, unnest(range(1, len(pieces) + 1)) AS u(i)),
c AS (SELECT *, {code} AS code FROM p),
f AS (SELECT page_id, i, piece, name, CASE
        WHEN code IS NOT NULL THEN CASE WHEN code > 0 AND code < 55296 OR code > 57343 AND code <= 1114111
                                        THEN chr(CAST(code AS INTEGER)) ELSE chr(65533) END
        WHEN name <> '' THEN MAP {{{names}}}[name] END AS found FROM c),
j AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN piece WHEN found IS NOT NULL THEN found || piece[length(name) + 2:]
                                      ELSE '&' || piece END, '' ORDER BY i) AS x FROM f GROUP BY page_id)
SELECT page_id, array_to_string(list_filter(list_transform(str_split(x, chr(10)),
         lambda l: trim(regexp_replace(l, {_sql_str(X.BLANKS)}, ' ', 'g'), ' ')), lambda l: l <> ''), chr(10)) AS text
FROM j"""


@query("html_to_text", _html_sql())
def q_html_to_text(spark, d):
    from vellum.sources.extract import html_to_text
    return html_to_text(table(spark, d, "pages", "page_id", "html", fan_out=True))


# ---------------------------------------------------------------------------- embeddings of text
_TOKEN_RE = r"[^\p{L}\p{N}]+"


def _bow_sql(name: str, src: str, key: str, text: str, dim: int = config.VECTOR_WIDTH) -> str:
    """Sparse hashed bag of words in SQL: ``{name}(key, b, w)`` with float-rounded weights
    and ``{name}_n(key, nn)`` norms; the same rule as ``vellum.operators.embed``."""
    return f"""
{name}_tok AS (SELECT {key} AS k, unnest(regexp_split_to_array(lower({text}), '{_TOKEN_RE}')) AS tok
               FROM {src}),
{name}_cnt AS (SELECT k, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS b, count(*) AS c
               FROM {name}_tok WHERE tok <> '' GROUP BY ALL),
{name}_raw AS (SELECT k, sqrt(sum(c * c)) AS n FROM {name}_cnt GROUP BY k),
{name} AS (SELECT c.k, c.b, CAST(CAST(c.c / r.n AS FLOAT) AS DOUBLE) AS w
           FROM {name}_cnt c JOIN {name}_raw r ON c.k = r.k),
{name}_n AS (SELECT k, sqrt(sum(w * w)) AS nn FROM {name} GROUP BY k)"""


_SEMANTIC_SQL = ("""
WITH m AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.?!])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g') AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\x01|\\n+'), lambda x: trim(x, ' ')),
                                 lambda x: x <> '') AS s FROM m),
ctx AS (SELECT doc_id, i, doc_id || ':' || i AS k, s[i] AS sentence, array_to_string(s[greatest(i - 1, 1):i + 1], ' ') AS c
        FROM l, unnest(range(1, len(s) + 1)) AS u(i)),""" + _bow_sql("v", "ctx", "k", "c", 256) + f""",
placed AS MATERIALIZED (SELECT ctx.k, doc_id, i, b, w FROM ctx JOIN v ON v.k = ctx.k),
dots AS (SELECT x.k, sum(x.w * y.w) AS dot FROM placed x
         JOIN placed y ON y.doc_id = x.doc_id AND y.i = x.i + 1 AND y.b = x.b GROUP BY x.k),
dist AS (SELECT ctx.doc_id, ctx.i, ctx.sentence,
                CASE WHEN lead(ctx.i) OVER w IS NOT NULL THEN 1.0 - coalesce(dots.dot, 0.0) END AS d, count(*) OVER (PARTITION BY ctx.doc_id) AS n
         FROM ctx LEFT JOIN dots ON dots.k = ctx.k WINDOW w AS (PARTITION BY ctx.doc_id ORDER BY ctx.i)),
brk AS (SELECT *, CASE WHEN n >= 3 AND d > avg(d) OVER (PARTITION BY doc_id)
                             + {config.SEMANTIC_STDDEV_K} * stddev_pop(d) OVER (PARTITION BY doc_id) THEN 1 ELSE 0 END AS b FROM dist),
runs AS (SELECT *, CAST(coalesce(sum(b) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                        AS INTEGER) AS chunk_index FROM brk)
SELECT doc_id, chunk_index, string_agg(sentence, ' ' ORDER BY i) AS text FROM runs GROUP BY doc_id, chunk_index""")


@query("chunk_semantic", _SEMANTIC_SQL)
def q_chunk_semantic(spark, d):
    from vellum.operators.chunk import chunk_semantic
    return chunk_semantic(table(spark, d, "documents", "doc_id", "text", fan_out=True))


@query("embed_text", "WITH " + _bow_sql("v", "documents", "doc_id", "coalesce(text, '')") + f""",
ids AS (SELECT doc_id FROM documents),
grid AS (SELECT doc_id, b FROM ids, range({config.VECTOR_WIDTH}) t(b))
SELECT grid.doc_id, list(CAST(coalesce(v.w, 0.0) AS FLOAT) ORDER BY grid.b) AS embedding
FROM grid LEFT JOIN v ON v.k = grid.doc_id AND v.b = grid.b GROUP BY grid.doc_id""")
def q_embed_text(spark, d):
    from vellum.operators.embed import embed
    return embed(table(spark, d, "documents", "doc_id", "text", fan_out=True), "text").select("doc_id", "embedding")


# ---------------------------------------------------------------------------- questions, prompts
TEXT_THRESHOLD = 0.3


def _text_chunks(spark, d):
    from vellum.operators.chunk import chunk_fixed
    docs = table(spark, d, "documents", "doc_id", "source", "text", fan_out=True)
    ch = chunk_fixed(docs, keep=("source",))
    return ch.select(F.concat_ws(":", F.col("doc_id").cast("string"),
                                 F.col("chunk_index").cast("string")).alias("id"),
                     "source", "text")


def _text_index(spark, d):
    from vellum.plans.answer import text_index
    return text_index(_text_chunks(spark, d))


def _questions(spark, d):
    from vellum.plans.answer import prepare_queries
    return prepare_queries(table(spark, d, "benchmark", "item_id", "text"))


_STEP = config.CHUNK_SIZE - config.CHUNK_OVERLAP
_CHUNKS_SQL = f"""
chunks AS (SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(ci AS VARCHAR) AS id, source,
                  substring(text, ci * {_STEP} + 1, {config.CHUNK_SIZE}) AS text
           FROM (SELECT doc_id, source, text, unnest(range(0, CASE WHEN length(text) <= {config.CHUNK_SIZE}
                   THEN 0 ELSE CAST(ceil((length(text) - {config.CHUNK_SIZE}) / {_STEP}.0) AS BIGINT) END + 1)) AS ci
                 FROM documents WHERE length(text) > 0) x)"""


def _text_hits_sql(qsrc: str, qkey: str, qtext: str, threshold: float, chunks: str = _CHUNKS_SQL) -> str:
    return (chunks + "," + _bow_sql("cv", "chunks", "id", "text") + ","
            + _bow_sql("qv", qsrc, qkey, qtext) + f""",
dots AS (SELECT q.k AS query_id, c.k AS id, sum(q.w * c.w) AS dot
         FROM qv q JOIN cv c ON q.b = c.b GROUP BY ALL),
s AS (SELECT dots.query_id, dots.id, round(dot / (qn.nn * cn.nn), 6) AS score
      FROM dots JOIN qv_n qn ON qn.k = dots.query_id JOIN cv_n cn ON cn.k = dots.id),
hits AS (SELECT query_id, id, rn AS rank, score FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn
           FROM s WHERE score >= {threshold}) r WHERE rn <= {config.TOP_K}),
a AS (SELECT hits.query_id, list_sort(list(DISTINCT coalesce(chunks.source, 'Unknown'))) AS sources,
             string_agg(coalesce(chunks.text, ''), '{config.CONTEXT_SEPARATOR.replace(chr(10), "' || chr(10) || '")}'
                        ORDER BY hits.rank) AS ctx,
             CAST(sum(CAST(round(score * 1000000) AS BIGINT)) AS DOUBLE) / count(score) / CAST(1000000 AS DOUBLE) AS conf
      FROM hits LEFT JOIN chunks ON chunks.id = hits.id GROUP BY hits.query_id)""")


def _fill_sql(template: str, **values: str) -> str:
    """SQL twin of ``fill_template``: literal pieces and values joined with ``||``."""
    out, rest = [], template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not hits:
            out.append(_sql_lit(rest))
            break
        pos, k = min(hits)
        if pos:
            out.append(_sql_lit(rest[:pos]))
        out.append(f"coalesce(CAST({values[k]} AS VARCHAR), '')")
        rest = rest[pos + len(k) + 2:]
    return " || ".join(out)


def _sql_lit(s: str) -> str:
    parts = s.split("\n")
    return " || chr(10) || ".join(_sql_str(p) for p in parts)


_Q_SQL = (f"questions AS (SELECT item_id, {_strip_sql('text')} AS question FROM benchmark "
          f"WHERE length({_strip_sql('text')}) > 0)")


@query("prepare_queries", "WITH " + _Q_SQL + " SELECT item_id, question FROM questions")
def q_prepare_queries(spark, d):
    return _questions(spark, d)


@query("rag_prompt", "WITH " + _Q_SQL + "," + _text_hits_sql("questions", "item_id", "question",
                                                             TEXT_THRESHOLD) + f"""
SELECT q.item_id,
       {_fill_sql(config.QUERY_TEMPLATE, context=f"coalesce(a.ctx, '{config.NO_CONTEXT}')", question="q.question")} AS prompt,
       array_to_string(coalesce(a.sources, []), ', ') AS sources,
       CAST(coalesce(len(a.sources), 0) AS INTEGER) AS num_sources,
       coalesce(a.conf, 0.0) AS confidence
FROM questions q LEFT JOIN a ON a.query_id = q.item_id""")
def q_rag_prompt(spark, d):
    from vellum.plans.answer import rag_prompts
    p = rag_prompts(_text_index(spark, d), _questions(spark, d), threshold=TEXT_THRESHOLD)
    return p.select("item_id", "prompt", F.array_join("sources", ", ").alias("sources"),
                    "num_sources", "confidence")


@query("retrieve_context", "WITH " + _Q_SQL + "," + _text_hits_sql("questions", "item_id", "question",
                                                                   TEXT_THRESHOLD) + f"""
SELECT q.item_id, array_to_string(coalesce(a.sources, []), ', ') AS sources,
       CAST(coalesce(len(a.sources), 0) AS INTEGER) AS num_sources,
       coalesce(a.ctx, '{config.NO_CONTEXT}') AS context, coalesce(a.conf, 0.0) AS confidence
FROM questions q LEFT JOIN a ON a.query_id = q.item_id""")
def q_retrieve_context(spark, d):
    from vellum.plans.answer import retrieve
    r = retrieve(_text_index(spark, d), _questions(spark, d), threshold=TEXT_THRESHOLD)
    return r.withColumn("sources", F.array_join("sources", ", "))


def echo_generator(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a model: the question line of each prompt."""
    out = []
    for p in prompts:
        q = p.rsplit("Question: ", 1)[-1]
        out.append("You asked: " + q.split("\n", 1)[0])
    return out


@query("rag_answer", "WITH " + _Q_SQL + "," + _text_hits_sql("questions", "item_id", "question",
                                                             TEXT_THRESHOLD) + f"""
SELECT q.item_id,
       'You asked: ' || split_part(q.question, chr(10), 1) AS response,
       array_to_string(coalesce(a.sources, []), ', ') AS sources,
       coalesce(a.conf, 0.0) AS confidence,
       CAST(coalesce(len(a.sources), 0) AS INTEGER) AS num_sources,
       CAST(NULL AS VARCHAR) AS session_id
FROM questions q LEFT JOIN a ON a.query_id = q.item_id""")
def q_rag_answer(spark, d):
    from vellum.plans.answer import rag_answer
    r = rag_answer(_text_index(spark, d), _questions(spark, d), echo_generator,
                   threshold=TEXT_THRESHOLD)
    return r.withColumn("sources", F.array_join("sources", ", "))


# ---------------------------------------------------------------------------- sessions
# conversations = messages; conv_id is the session, turn the position. The string session
# id is md5(conv_id). Stored titles come from each session's first system message (cleaned as
# a model reply is).
def _conv(spark, d, *cols, fan_out=False):
    return table(spark, d, "conversations", *(cols or ("conv_id", "turn", "role", "text")),
                 fan_out=fan_out)


_ROLE_SQL = "CASE WHEN lower(role) IN ('human', 'user') THEN 'user' ELSE 'assistant' END"


@query("history_roles", f"SELECT conv_id, turn, {_ROLE_SQL} AS role, text AS content FROM conversations")
def q_history_roles(spark, d):
    from vellum.operators.sessions import history_roles
    return history_roles(_conv(spark, d))


@query("history_preview", f"""
SELECT conv_id, turn, substring(coalesce(text, ''), 1, {config.PREVIEW_LEN}) || '...' AS preview
FROM conversations""")
def q_history_preview(spark, d):
    from vellum.operators.sessions import history_preview
    return history_preview(_conv(spark, d, "conv_id", "turn", "text"))


_HIST_SQL = f"""
hist AS (SELECT conv_id, turn, coalesce(string_agg({_ROLE_SQL} || ': ' || coalesce(text, ''), chr(10)
                 ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
         FROM conversations)"""


@query("chat_history_upto", f"WITH {_HIST_SQL} SELECT conv_id, turn, history FROM hist")
def q_chat_history_upto(spark, d):
    from vellum.operators.sessions import history_upto
    return history_upto(_conv(spark, d))


_USERS_SQL = ("users AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '#' || CAST(turn AS VARCHAR) AS qk, "
              f"text AS question FROM conversations WHERE {_ROLE_SQL} = 'user')")


@query("chat_input", f"WITH {_HIST_SQL}, {_USERS_SQL}, "
       + _text_hits_sql("users", "qk", "question", TEXT_THRESHOLD) + f"""
SELECT u.conv_id, u.turn,
       {_fill_sql(config.CHAT_TEMPLATE, context=f"coalesce(a.ctx, '{config.NO_CONTEXT}')",
                  history="coalesce(h.history, '')", question="u.question")} AS prompt,
       array_to_string(coalesce(a.sources, []), ', ') AS sources,
       CAST(coalesce(len(a.sources), 0) AS INTEGER) AS num_sources,
       coalesce(a.conf, 0.0) AS confidence
FROM users u LEFT JOIN hist h ON h.conv_id = u.conv_id AND h.turn = u.turn
LEFT JOIN a ON a.query_id = u.qk""")
def q_chat_input(spark, d):
    from vellum.plans.answer import chat_inputs
    out = chat_inputs(_text_index(spark, d), _conv(spark, d, fan_out=True), threshold=TEXT_THRESHOLD)
    return out.withColumn("sources", F.array_join("sources", ", "))


def chat_double(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a chat model: the first line of the message it answers."""
    return ["You said: " + p.rsplit("\n\nuser: ", 1)[-1].split("\n", 1)[0].removesuffix("\nassistant:") for p in prompts]


@query("chat_answer", f"WITH {_USERS_SQL}, "
       + _text_hits_sql("users", "qk", "question", TEXT_THRESHOLD) + """,
ends AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id)
SELECT u.conv_id, u.turn + 1 AS turn, 'assistant' AS role, 'You said: ' || split_part(u.question, chr(10), 1) AS text,
       array_to_string(coalesce(a.sources, []), ', ') AS sources,
       CAST(coalesce(len(a.sources), 0) AS INTEGER) AS num_sources, coalesce(a.conf, 0.0) AS confidence
FROM users u JOIN ends USING (conv_id, turn) LEFT JOIN a ON a.query_id = u.qk""")
def q_chat_answer(spark, d):
    from vellum.plans.answer import chat_answers
    out = chat_answers(_text_index(spark, d), _conv(spark, d, fan_out=True), chat_double, threshold=TEXT_THRESHOLD)
    return out.withColumn("sources", F.array_join("sources", ", "))


def title_double(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a title model: the message's first line in quotes; it fails on messages whose
    length is 6 mod 7."""
    said = [p.split("without quotes: ", 1)[1] for p in prompts]
    return ["" if len(m) % 7 == 6 else f' "{m.split(chr(10), 1)[0]}" ' for m in said]


@query("session_title_answer", f"""
WITH m AS (SELECT conv_id, arg_min(text, turn) AS message FROM conversations WHERE {_ROLE_SQL} = 'user' GROUP BY conv_id),
t AS (SELECT conv_id, CASE WHEN length(message) % 7 = 6 THEN '' ELSE replace({_strip_sql("' \"' || split_part(message, chr(10), 1) || '\" '")}, '"', '') END AS title FROM m)
SELECT conv_id, CASE WHEN length(title) > 0 THEN title ELSE '{config.NEW_CHAT_TITLE}' END AS title FROM t""")
def q_session_title_answer(spark, d):
    from vellum.plans.answer import title_answers
    return title_answers(_conv(spark, d), title_double)


def _stored_titles(spark, d):
    from vellum.functions.text import clean_title
    from vellum.operators.sessions import first_message
    first = first_message(_conv(spark, d), which="system")
    return first.select("conv_id", clean_title("message").alias("title"))


_TITLES_SQL = f"""
stored AS (SELECT conv_id, replace({_strip_sql("arg_min(text, turn)")}, '"', '') AS title
           FROM conversations WHERE role = 'system' GROUP BY conv_id)"""


@query("session_titles", f"""WITH {_TITLES_SQL}
SELECT s.conv_id, coalesce(t.title, 'Session ' || substring(md5(CAST(s.conv_id AS VARCHAR)), 1, 8)) AS title
FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN stored t ON t.conv_id = s.conv_id""")
def q_session_titles(spark, d):
    from vellum.operators.sessions import session_titles
    return session_titles(_conv(spark, d, "conv_id").distinct(), _stored_titles(spark, d))


@query("session_title_input", f"""
SELECT conv_id, {_fill_sql(config.TITLE_TEMPLATE, message="arg_min(text, turn)")} AS prompt
FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def q_session_title_input(spark, d):
    from vellum.operators.sessions import title_input
    return title_input(_conv(spark, d))


@query("session_counts", "SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def q_session_counts(spark, d):
    from vellum.operators.sessions import session_counts
    return session_counts(_conv(spark, d, "conv_id"))


@query("sessions_newest", """
SELECT conv_id, CAST(row_number() OVER (ORDER BY conv_id DESC) AS BIGINT) AS position
FROM (SELECT DISTINCT conv_id FROM conversations) s""")
def q_sessions_newest(spark, d):
    from vellum.operators.sessions import sessions_newest
    # Sessions were created in conversation-id order.
    s = _conv(spark, d, "conv_id").distinct().withColumn("created_seq", F.col("conv_id"))
    return sessions_newest(s)


@query("sessions_delete", """
SELECT conv_id, turn FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def q_sessions_delete(spark, d):
    from vellum.operators.sessions import sessions_delete
    c = _conv(spark, d, "conv_id", "turn", "role")
    return sessions_delete(c.select("conv_id", "turn"), c.where(F.col("role") == "system"))


@query("sessions_upsert", f"""WITH {_TITLES_SQL}
SELECT conv_id, '{config.NEW_CHAT_TITLE}' AS title FROM (SELECT DISTINCT conv_id FROM conversations) s
WHERE conv_id NOT IN (SELECT conv_id FROM stored)
UNION ALL SELECT conv_id, title FROM stored""")
def q_sessions_upsert(spark, d):
    from vellum.operators.sessions import new_sessions, sessions_upsert
    return sessions_upsert(new_sessions(_conv(spark, d, "conv_id")), _stored_titles(spark, d))


# ---------------------------------------------------------------------------- model hooks, eval
def category_double(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a classification model: names the first category whose
    name occurs in the sample, and replies with junk when the sample's length is 6 mod 7
    (so the fallback path is exercised on a fixed, batch-independent set of rows)."""
    out = []
    for p in prompts:
        sample = p.split("\n---\n", 1)[1].rsplit("\n---", 1)[0]
        low = sample.lower()
        hit = next((c for c in config.KEYWORDS if c.lower() in low), None)
        out.append("not json" if len(sample) % 7 == 6 else '{"category": "%s"}' % (hit or "OTHER"))
    return out


def _model_sql() -> str:
    whens = " ".join(f"WHEN contains(lower(sample), {_sql_str(c.lower())}) THEN {_sql_str(c)}"
                     for c in config.KEYWORDS)
    return f"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS sample FROM documents)
SELECT doc_id, CASE WHEN length(sample) = 0 OR length(sample) % 7 = 6 THEN 'GENERAL'
                    ELSE CASE {whens} ELSE 'GENERAL' END END AS file_category
FROM s"""


@query("classify_model", _model_sql())
def q_classify_model(spark, d):
    return C.classify_model(table(spark, d, "documents", "doc_id", "text", fan_out=True), category_double)


def _tok_sql(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), "
            f"'{_TOKEN_RE}'), lambda t: t <> ''))")


@query("evaluate_answers", f"""
WITH p AS (SELECT conv_id, turn, text AS actual,
                  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS expected
           FROM conversations WHERE role = 'assistant'),
t AS (SELECT conv_id, turn, {_tok_sql('actual')} AS a, {_tok_sql('expected')} AS b
      FROM p WHERE expected IS NOT NULL),
s AS (SELECT conv_id, turn, CASE WHEN len(a) + len(b) > 0
             THEN CAST(2 AS DOUBLE) * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0.0 END AS score
      FROM t)
SELECT conv_id, turn, score, score >= {config.PASS_THRESHOLD} AS passed FROM s""")
def q_evaluate_answers(spark, d):
    from vellum.operators.evaluate import evaluate
    from vellum.operators.topk import lead_within
    a = _conv(spark, d).where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    pairs = (lead_within(a, "conv_id", "turn", "text", "expected_output")
             .where(F.col("expected_output").isNotNull())
             .select("conv_id", "turn", F.col("text").alias("actual_output"), "expected_output"))
    return evaluate(pairs, key=("conv_id", "turn"), rounding=None)


# ---------------------------------------------------------------------------- scalar functions
@query("scalar_functions", f"""
SELECT doc_id, lower(source) AS f_lower, substring(text, 1, 20) AS f_prefix,
       concat_ws('|', source, lang) AS f_join,
       coalesce(source, '') || ':' || coalesce(lang, '') || ':' || CAST(doc_id AS VARCHAR) AS f_id,
       replace({_strip_sql("text")}, '"', '') AS f_clean,
       lower(regexp_extract(regexp_replace(source || '.TXT', '[?#].*$', ''), '\\.([^./]+)$', 1)) AS f_ext,
       starts_with(text, 'The') AS f_starts,
       coalesce(nullif(lang, 'en'), 'Unknown') AS f_default,
       md5(source) AS f_md5,
       printf('%.2f', CAST(n_chars AS DOUBLE) / 7) AS f_fixed,
       CASE WHEN length(text) > 20 THEN substring(text, 1, 20) || '..' ELSE text END AS f_title
FROM documents""")
def q_scalar_functions(spark, d):
    from vellum.functions import text as TX
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "text", "n_chars")
    return docs.select(
        "doc_id", F.lower("source").alias("f_lower"), F.substring("text", 1, 20).alias("f_prefix"),
        F.concat_ws("|", "source", "lang").alias("f_join"),
        TX.id_format("source", "lang", "doc_id").alias("f_id"),
        TX.clean_title("text").alias("f_clean"),
        TX.file_type(F.concat("source", F.lit(".TXT"))).alias("f_ext"),
        F.startswith("text", F.lit("The")).alias("f_starts"),
        F.coalesce(F.nullif("lang", F.lit("en")), F.lit(config.UNKNOWN_SOURCE)).alias("f_default"),
        F.md5("source").alias("f_md5"),
        TX.fixed_decimals(F.col("n_chars").cast("double") / F.lit(7.0)).alias("f_fixed"),
        TX.display_title("text").alias("f_title"))


@query("vector_functions", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv FROM e)
SELECT vec_id, round(nv, 6) AS norm,
       round(CASE WHEN nv > 0 THEN v[1] / nv ELSE v[1] END, 6) AS unit_first,
       round(CASE WHEN nv > 0 THEN list_sum(list_transform(v, lambda x: x * x)) / (nv * nv) ELSE 0.0 END, 6) AS self_cosine
FROM n""")
def q_vector_functions(spark, d):
    from vellum.functions import vectors as VF
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.round(VF.norm("embedding"), 6).alias("norm"),
                    F.round(F.element_at(VF.l2_normalize("embedding"), 1), 6).alias("unit_first"),
                    F.round(VF.cosine("embedding", "embedding"), 6).alias("self_cosine"))


# ---------------------------------------------------------------------------- build and runs
def _parts(spark, d):
    from vellum.plans.build import documents_as_parts
    return documents_as_parts(table(spark, d, "documents", "doc_id", "source", "lang", "text", fan_out=True))


_INDEX_SQL = f"""WITH RECURSIVE {_recursive_sql()},
cat AS ({_KW_SCORES_SQL} SELECT s.doc_id, coalesce((SELECT arg_min(category, -score * 1000 + rank) FROM sc
                 WHERE sc.doc_id = s.doc_id AND sc.score > 0), '{config.DEFAULT_CATEGORY}') AS file_category FROM s),
idx AS MATERIALIZED (
  SELECT d.source || '/' || CAST(d.doc_id AS VARCHAR) || ':' || coalesce(lang, '') || ':' || CAST(chunk_index AS VARCHAR) AS id,
         d.source || '/' || CAST(d.doc_id AS VARCHAR) AS source, lang AS page, chunk_index, start_index, rc.text,
         'txt' AS file_type, file_category, CAST(NULL AS VARCHAR) AS metadata
  FROM rc JOIN documents d USING (doc_id) JOIN cat USING (doc_id))"""


@query("build_index", _INDEX_SQL + "," + _bow_sql("v", "idx", "id", "text") + f""",
grid AS (SELECT id, b FROM idx, range({config.VECTOR_WIDTH}) t(b)),
vec AS (SELECT grid.id, list(CAST(coalesce(v.w, 0.0) AS FLOAT) ORDER BY grid.b) AS embedding
        FROM grid LEFT JOIN v ON v.k = grid.id AND v.b = grid.b GROUP BY grid.id)
SELECT idx.*, embedding FROM idx JOIN vec USING (id)""")
def q_build_index(spark, d):
    from vellum.plans.build import index_rows
    return index_rows(_parts(spark, d))


@query("build_metrics", f"""WITH RECURSIVE {_recursive_sql()}
SELECT 'parts' AS metric, count(*) AS value FROM documents
UNION ALL SELECT 'files', count(DISTINCT source || '/' || CAST(doc_id AS VARCHAR)) FROM documents
UNION ALL SELECT 'chunks', count(*) FROM rc""")
def q_build_metrics(spark, d):
    from vellum.plans.build import build_metrics, index_rows
    parts = _parts(spark, d)
    return build_metrics(parts, index_rows(parts))


@query("regression_run", _INDEX_SQL + "," + _Q_SQL + "," + _text_hits_sql(
    "questions", "item_id", "question", TEXT_THRESHOLD, "chunks AS (SELECT id, source, text FROM idx)") + """
SELECT q.item_id, 'You asked: ' || split_part(q.question, chr(10), 1) AS response,
       array_to_string(coalesce(a.sources, []), ', ') AS sources, coalesce(a.conf, 0.0) AS confidence,
       CAST(coalesce(len(a.sources), 0) AS INTEGER) AS num_sources, CAST(NULL AS VARCHAR) AS session_id
FROM questions q LEFT JOIN a ON a.query_id = q.item_id""")
def q_regression_run(spark, d):
    from vellum.plans.answer import rag_answer
    r = rag_answer(_saved_index(spark, d), _questions(spark, d), echo_generator,
                   threshold=TEXT_THRESHOLD)
    return r.withColumn("sources", F.array_join("sources", ", "))


def _saved_index(spark, d):
    """The built index, saved: scoring and context both read it."""
    from vellum.plans.build import index_rows
    from vellum.session import cut_lineage
    return cut_lineage(index_rows(_parts(spark, d)))


def flagship(spark, d):
    """classify -> chunk -> embed -> retrieve -> context for every benchmark question."""
    from vellum.plans.answer import rag_prompts
    p = rag_prompts(_saved_index(spark, d), _questions(spark, d), threshold=TEXT_THRESHOLD)
    return p.select("item_id", "question", F.array_join("sources", ", ").alias("sources"),
                    "num_sources", "confidence", "context")
