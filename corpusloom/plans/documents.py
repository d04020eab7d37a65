"""Queries of ids, quality, cleaning, dates, chunking and store transitions over the store's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import cleaning, dates, ids, quality
from corpusloom.operators import audit, chunking, store
from corpusloom.runtime import table


def _docs(spark, folder):
    return table(spark, folder, "store_documents")


def content_hash(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


def canonical_id(spark, folder):
    d = _docs(spark, folder).select("doc_id", "doc_type", "number").distinct()
    return d.select("doc_id", ids.canonical_id(F.col("doc_type"), F.col("number")).alias("canonical"))


def version_split(spark, folder):
    base, year = ids.split_version_year(F.col("doc_id"))
    return _docs(spark, folder).select("doc_id").distinct().select("doc_id", base.alias("base"), year.alias("year"))


def urn_fields(spark, folder):
    parts = ids.urn_parts(F.col("urn"))
    return _docs(spark, folder).select("doc_id", "urn").filter("urn IS NOT NULL").distinct().select("doc_id", *(c.alias(n) for n, c in parts.items()))


def title_fields(spark, folder):
    kind, number = ids.title_parts(F.col("title"))
    return _docs(spark, folder).select("doc_id", "title").filter("title IS NOT NULL").distinct().select("doc_id", kind.alias("title_type"), number.alias("title_number"))


def quality_metrics(spark, folder):
    columns = ["total_chars", "total_words", "total_lines", "empty_lines", "alpha_count", "noise_lines", "short_lines", "toc_lines"]
    return quality.quality_metrics(table(spark, folder, "documents"), "text").select("doc_id", *columns)


def quality_levels(spark, folder):
    return quality.quality_metrics(table(spark, folder, "documents"), "text").groupBy(quality.quality_level().alias("quality_level")).agg(F.count(F.lit(1)).alias("n"))


def clean_text(spark, folder):
    return cleaning.clean(_docs(spark, folder).select("doc_id", "content")).select("doc_id", "clean", "chars_removed", "reduction_pct")


def clean_layout(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.md5(cleaning.squeeze_layout(F.col("text")).cast("binary")).alias("layout_hash"))


def validity_dates(spark, folder):
    text = F.col("content")
    return _docs(spark, folder).select("doc_id", "content", "effective_date").distinct().select("doc_id", dates.effective_date(text, F.col("effective_date")).alias("effective"), dates.expiry_date(text).alias("expiry"), dates.is_revoked(text).alias("revoked"))


def numeric_dates(spark, folder):
    d = _docs(spark, folder).select("doc_id", dates.all_dates(F.col("content")).alias("dates"))
    return d.filter(F.size("dates") > 0).select("doc_id", F.array_join("dates", ",").alias("dates")).distinct()


def document_chunks(spark, folder):
    return chunking.chunk_documents(_docs(spark, folder)).withColumn("chunk_id", ids.chunk_id(F.col("regulation_id"), F.col("text")))


def word_window_chunks(spark, folder):
    return chunking.word_windows(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "n_words", F.md5(F.col("chunk").cast("binary")).alias("chunk_hash"))


def section_chunks(spark, folder):
    return chunking.numbered_sections(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "section", "number", F.length("body").cast("bigint").alias("n_chars"))


def _split_store(spark, folder):
    """The table as it was before its later half of updates, and those updates."""
    d = _docs(spark, folder)
    return d.filter(F.col("updated_at") < "2024-06-01").dropDuplicates(["doc_id"]), d.filter(F.col("updated_at") >= "2024-06-01")


def upsert_actions(spark, folder):
    old, new = _split_store(spark, folder)
    return store.upsert_actions(old.withColumn("content_hash", ids.content_hash(F.col("content"))), new).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def upserted_store(spark, folder):
    d = _docs(spark, folder)
    first = d.groupBy("doc_id").agg(F.min(F.struct("updated_at", *[c for c in d.columns if c not in ("doc_id", "updated_at")])).alias("b")).select("doc_id", "b.*")
    old = first.filter(F.col("updated_at") < "2024-06-01").withColumn("content_hash", ids.content_hash(F.col("content"))).select(*d.columns)
    out = store.upsert(old, d.filter(F.col("updated_at") >= "2024-06-01"))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last_updated"))


def latest_version(spark, folder):
    return store.latest_versions(_docs(spark, folder))


def superseded_transition(spark, folder):
    return store.supersede(_docs(spark, folder)).groupBy("is_latest", "status").agg(F.count(F.lit(1)).alias("n"))


def resolve_relations(spark, folder):
    r = table(spark, folder, "document_relations").select("relation_id", "target_doc_id", "target_ref").distinct()
    return store.resolve_relations(r, _docs(spark, folder))


def merged_relations(spark, folder):
    r = table(spark, folder, "document_relations").withColumn("target_doc_id", F.nullif("target_doc_id", F.lit("")))
    at = F.lit("2022-01-01").cast("timestamp")
    return store.merge_relations(r.filter(F.col("loaded_at") < at), r.filter(F.col("loaded_at") >= at)).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.count("target_doc_id").alias("n_resolved"))


def delete_cascade(spark, folder):
    docs, log, edges = store.cascade_delete(_docs(spark, folder), table(spark, folder, "embedding_log"), table(spark, folder, "document_relations"), "posto_amazonico")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
    return count(docs, "documents").unionAll(count(log, "log")).unionAll(count(edges, "relations")).unionAll(count(edges.filter("target_doc_id IS NOT NULL"), "targets"))


def replaced_log(spark, folder):
    log = table(spark, folder, "embedding_log")
    return store.replace_by_key(log.filter("embedding_mode = 'dense'"), log.filter("embedding_mode = 'hybrid'"), "doc_id").groupBy("embedding_mode").agg(F.count(F.lit(1)).alias("n"))


def insert_or_ignore(spark, folder):
    log = table(spark, folder, "embedding_log")
    keys = ["doc_id", "content_hash", "embedding_mode"]
    return store.insert_new(log.filter("model_name = 'enc-base-v2'"), log.filter("model_name <> 'enc-base-v2'"), keys).select(*keys)


def index_consistency_audit(spark, folder):
    """Latest active documents against what the embedding log says is in the index."""
    docs = _docs(spark, folder)
    at = docs.select("doc_id", "canonical_id", "is_latest").distinct()
    chunks = table(spark, folder, "embedding_log").select("doc_id").distinct().join(at, "doc_id").select("canonical_id", "is_latest")
    return audit.missing_chunks(docs, chunks)


def best_document(spark, folder):
    names = table(spark, folder, "document_snapshots").select("canonical_id").filter("canonical_id IS NOT NULL").distinct()
    return audit.best_document(names, _docs(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, canonical_id, version_split, urn_fields, title_fields, quality_metrics, quality_levels, clean_text, clean_layout, validity_dates, numeric_dates,
        document_chunks, word_window_chunks, section_chunks, upsert_actions, upserted_store, latest_version, superseded_transition, resolve_relations,
        merged_relations, delete_cascade, replaced_log, insert_or_ignore, index_consistency_audit, best_document,
    )
}

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SQUEEZE = lambda c: f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"
_BARE = lambda c: f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"
_HASH = f"sha256({_SQUEEZE('lower(content)')})"
_METRICS = rf"""SELECT doc_id, length(t) AS total_chars, len(regexp_extract_all(t, '[^{_WS[1:]}+')) AS total_words, len(l) AS total_lines,
    len(list_filter(l, lambda x: {_BARE('x')} = '')) AS empty_lines, len(regexp_extract_all(t, '\pL')) AS alpha_count,
    len(list_filter(l, lambda x: {_BARE('x')} <> '' AND NOT regexp_matches(x, '\pL'))) AS noise_lines,
    len(list_filter(l, lambda x: length({_BARE('x')}) BETWEEN 1 AND 4)) AS short_lines,
    len(list_filter(l, lambda x: len(x) - len(replace(x, '.', '')) > 20)) AS toc_lines,
    len(regexp_extract_all(t, '[\p{{Cc}}\p{{Cf}}\p{{Co}}]')) - len(regexp_extract_all(t, '[\n\r\t]')) AS control_count
    FROM (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents)"""
_FIRST = """(SELECT * FROM store_documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at) = 1)"""



def _parsed(x: str) -> str:
    """SQL of a date's ISO text: ISO, spelled out in Portuguese, or day first unless the second number can be no month."""
    spelled, numeric = rf"(?i)(\d{{1,2}})[ºª°]?\s+de\s+({'|'.join(dates.MONTHS)})\s+de\s+(\d{{4}})", r"(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})"
    part = lambda p, k: f"regexp_extract({x}, '{p}', {k})"
    month = "CASE lower(" + part(spelled, 2) + ") " + " ".join(f"WHEN '{m}' THEN '{n:02d}'" for m, n in dates.MONTHS.items()) + " END"
    century = f"(year(current_date) // 100 * 100 + TRY_CAST({part(numeric, 3)} AS INT))"
    near = f"CASE WHEN {century} >= year(current_date) + 50 THEN {century} - 100 WHEN {century} < year(current_date) - 50 THEN {century} + 100 ELSE {century} END"
    year = f"CASE WHEN length({part(numeric, 3)}) = 2 THEN CAST({near} AS VARCHAR) ELSE {part(numeric, 3)} END"
    swapped = f"TRY_CAST({part(numeric, 2)} AS INT) > 12"
    pick = lambda a, b: f"lpad(CASE WHEN {swapped} THEN {part(numeric, a)} ELSE {part(numeric, b)} END, 2, '0')"
    iso = lambda y, m, d: f"strftime(TRY_CAST({y} || '-' || {m} || '-' || {d} AS DATE), '%Y-%m-%d')"
    day = f"lpad({part(spelled, 1)}, 2, '0')"
    return f"coalesce(CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {x} END, {iso(part(spelled, 3), month, day)}, {iso(year, pick(1, 2), pick(2, 1))})"


_PLAIN = lambda p: p.replace("(?iu)", "")
SQL = {
    "numeric_dates": rf"""WITH d AS (SELECT doc_id, [{_parsed('x')} for x in regexp_extract_all(content, '{dates.NUMERIC}')] AS p FROM store_documents), k AS (SELECT doc_id, [x for x in p if x IS NOT NULL] AS dates FROM d)
        SELECT DISTINCT doc_id, array_to_string(dates, ',') AS dates FROM k WHERE len(dates) > 0""",
    "validity_dates": rf"""WITH d AS (SELECT DISTINCT doc_id, content, effective_date FROM store_documents),
        m AS (SELECT *, {', '.join(f"nullif(regexp_extract(content, '(?i){_PLAIN(p)}', 1), '') AS e{i}" for i, p in enumerate(dates.EFFECTIVE))},
            {', '.join(f"nullif(regexp_extract(substr(regexp_extract(content, '(?i){_PLAIN(p)}((?s:.*))$', 1), 1, 100), '{dates.NUMERIC}'), '') AS x{i}" for i, p in enumerate(dates.REVOKED))} FROM d)
        SELECT doc_id, coalesce({', '.join(_parsed(f'e{i}') for i in range(len(dates.EFFECTIVE)))}, CASE WHEN regexp_matches(content, '(?i){_PLAIN(dates.ON_PUBLICATION)}') THEN effective_date END) AS effective,
            coalesce({', '.join(_parsed(f'x{i}') for i in range(len(dates.REVOKED)))}) AS expiry, coalesce({' OR '.join(f"regexp_matches(content, '(?i){_PLAIN(p)}')" for p in dates.REVOKED)}, false) AS revoked FROM m""",
    "content_hash": f"SELECT doc_id, sha256({_SQUEEZE('lower(text)')}) AS content_hash FROM documents",
    "canonical_id": """WITH d AS (SELECT DISTINCT doc_id, doc_type, number, replace(upper(doc_type), ' ', '') AS prefix FROM store_documents),
        p AS (SELECT doc_id, regexp_replace(lower(doc_type), '[^a-z0-9]', '', 'g') AS kind, trim(regexp_replace(lower(CASE WHEN starts_with(replace(upper(number), ' ', ''), prefix) AND length(number) > length(prefix)
              THEN substr(number, length(prefix) + 1) ELSE number END), '[^0-9a-z./-]', '', 'g'), '-./') AS num FROM d)
        SELECT doc_id, CASE WHEN kind <> '' AND num <> '' THEN kind || '_' || num END AS canonical FROM p""",
    "version_split": r"""SELECT DISTINCT doc_id, regexp_replace(trim(doc_id), '/[0-9]{4}$', '') AS base, nullif(regexp_extract(trim(doc_id), '/([0-9]{4})$', 1), '') AS year FROM store_documents""",
    "urn_fields": """SELECT doc_id, CASE WHEN len(p) >= 6 THEN p[4] END AS urn_authority, CASE WHEN len(p) >= 6 THEN p[5] END AS urn_type,
        CASE WHEN len(p) >= 6 THEN string_split(p[6], ';')[1] END AS urn_date, CASE WHEN len(p) >= 6 THEN nullif(string_split(p[6], ';')[2], '') END AS urn_number
        FROM (SELECT DISTINCT doc_id, string_split(urn, ':') AS p FROM store_documents WHERE urn IS NOT NULL)""",
    "title_fields": r"""SELECT DISTINCT doc_id, CASE upper(regexp_extract(title, '^\s*(\pL[\pL ]*?)\s+(?:[Nn][º°o.]+\s*)?([0-9][0-9A-Za-z./-]*)', 1)) WHEN 'PORTARIA' THEN 'Portaria' WHEN 'RESOLUCAO' THEN 'Resolução' WHEN 'LEI' THEN 'Lei' WHEN 'DECRETO' THEN 'Decreto'
        ELSE nullif(upper(regexp_extract(title, '^\s*(\pL[\pL ]*?)\s+(?:[Nn][º°o.]+\s*)?([0-9][0-9A-Za-z./-]*)', 1)), '') END AS title_type,
        nullif(regexp_extract(title, '^\s*(\pL[\pL ]*?)\s+(?:[Nn][º°o.]+\s*)?([0-9][0-9A-Za-z./-]*)', 2), '') AS title_number FROM store_documents WHERE title IS NOT NULL""",
    "quality_metrics": f"SELECT * EXCLUDE (control_count) FROM ({_METRICS})",
    "quality_levels": f"""SELECT CASE WHEN total_chars = 0 THEN 'garbage' WHEN total_chars < 200 THEN 'low' WHEN control_count / total_chars > 0.10 OR alpha_count / total_chars < 0.15 THEN 'garbage'
        WHEN alpha_count / total_chars < 0.40 THEN 'low' WHEN alpha_count / total_chars < 0.65 THEN 'medium' ELSE 'good' END AS quality_level, count(*) AS n FROM ({_METRICS}) GROUP BY 1""",
    "clean_layout": rf"""SELECT doc_id, md5({_BARE(r"regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t\r\f\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+\n', chr(10), 'g')")}) AS layout_hash FROM documents""",
    "word_window_chunks": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, words, CASE WHEN len(words) < 270 THEN 1 ELSE (len(words) - 270) // 220 + 1 + CASE WHEN ((len(words) - 270) // 220 + 1) * 220 < len(words) THEN 1 ELSE 0 END END AS n FROM w WHERE len(words) > 0),
        e AS (SELECT doc_id, words, unnest(range(n)) AS chunk_index FROM c)
        SELECT doc_id, chunk_index, len(words[chunk_index * 220 + 1 : chunk_index * 220 + 270]) AS n_words, md5(array_to_string(words[chunk_index * 220 + 1 : chunk_index * 220 + 270], ' ')) AS chunk_hash FROM e""",
    "section_chunks": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
        h AS (SELECT *, regexp_extract(line, '^\s*(\d+(?:\.\d+)*)\.?\s+[A-ZÁÉÍÓÚÀÂÊÔÃÕÇ].*', 1) AS number FROM l),
        s AS (SELECT *, count(*) FILTER (number <> '') OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h)
        SELECT doc_id, k - 1 AS section, max(number) AS number, sum(length(line)) + count(*) - 1 AS n_chars FROM s WHERE k > 0 GROUP BY doc_id, k""",
    "upsert_actions": f"""WITH old AS (SELECT DISTINCT ON (doc_id) doc_id, {_HASH} AS h FROM store_documents WHERE updated_at < '2024-06-01'),
        new AS (SELECT doc_id, max({_HASH}) AS h FROM store_documents WHERE updated_at >= '2024-06-01' GROUP BY doc_id)
        SELECT CASE WHEN old.doc_id IS NULL THEN 'inserted' WHEN old.h IS NOT DISTINCT FROM new.h THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS n FROM new LEFT JOIN old USING (doc_id) GROUP BY 1""",
    "upserted_store": f"""WITH old AS (SELECT doc_id, source, updated_at, {_HASH} AS h FROM {_FIRST} WHERE updated_at < '2024-06-01'),
        new AS (SELECT doc_id, source, updated_at, {_HASH} AS h FROM store_documents WHERE updated_at >= '2024-06-01' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC) = 1)
        SELECT coalesce(old.source, new.source) AS source, count(*) AS n, max(CASE WHEN new.doc_id IS NOT NULL AND (old.doc_id IS NULL OR old.h IS DISTINCT FROM new.h) THEN new.updated_at ELSE old.updated_at END) AS last_updated
        FROM old FULL JOIN new ON old.doc_id = new.doc_id GROUP BY 1""",
    "latest_version": """SELECT canonical_id, doc_id, version_year FROM store_documents WHERE canonical_id IS NOT NULL AND doc_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY version_year DESC NULLS LAST, doc_id) = 1""",
    "superseded_transition": """WITH newest AS (SELECT canonical_id AS c, doc_id AS k FROM store_documents WHERE canonical_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY version_year DESC NULLS LAST, doc_id) = 1)
        SELECT CASE WHEN c IS NULL THEN is_latest ELSE CAST(doc_id = k AS INT) END AS is_latest, CASE WHEN c IS NOT NULL AND doc_id <> k AND status = 'active' THEN 'superseded' ELSE status END AS status, count(*) AS n
        FROM store_documents LEFT JOIN newest ON canonical_id = c GROUP BY 1, 2""",
    "resolve_relations": """WITH lookup AS (SELECT nullif(regexp_replace(source_ref, '^.*:', ''), '') AS target_ref, min(doc_id) AS found FROM store_documents GROUP BY 1)
        SELECT relation_id, coalesce(nullif(r.target_doc_id, ''), found) AS target_doc_id, r.target_ref FROM (SELECT DISTINCT relation_id, target_doc_id, target_ref FROM document_relations) r LEFT JOIN lookup ON r.target_ref = lookup.target_ref""",
    "merged_relations": """WITH r AS (SELECT source_doc_id, target_ref, relation_type, max(CASE WHEN target_doc_id <> '' THEN target_doc_id END) AS t FROM document_relations GROUP BY ALL)
        SELECT relation_type, count(*) AS n, count(t) AS n_resolved FROM r GROUP BY relation_type""",
    "delete_cascade": """WITH gone AS (SELECT DISTINCT doc_id FROM store_documents WHERE source = 'posto_amazonico'),
        edges AS (SELECT * FROM document_relations r WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = r.source_doc_id))
        SELECT 'documents' AS table_name, count(*) AS n FROM store_documents WHERE source IS DISTINCT FROM 'posto_amazonico'
        UNION ALL SELECT 'log', count(*) FROM embedding_log l WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = l.doc_id)
        UNION ALL SELECT 'relations', count(*) FROM edges
        UNION ALL SELECT 'targets', count(*) FROM edges WHERE target_doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = edges.target_doc_id)""",
    "replaced_log": """WITH h AS (SELECT * FROM embedding_log WHERE embedding_mode = 'hybrid') SELECT embedding_mode, count(*) AS n FROM (SELECT * FROM h UNION ALL
        SELECT * FROM embedding_log l WHERE embedding_mode = 'dense' AND NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = l.doc_id)) GROUP BY embedding_mode""",
    "insert_or_ignore": """SELECT DISTINCT doc_id, content_hash, embedding_mode FROM embedding_log l WHERE model_name <> 'enc-base-v2' AND NOT EXISTS (SELECT 1 FROM embedding_log o WHERE o.model_name = 'enc-base-v2'
        AND o.doc_id IS NOT DISTINCT FROM l.doc_id AND o.content_hash IS NOT DISTINCT FROM l.content_hash AND o.embedding_mode IS NOT DISTINCT FROM l.embedding_mode)""",
    "index_consistency_audit": """WITH docs AS (SELECT DISTINCT doc_id, canonical_id, is_latest FROM store_documents),
        c AS (SELECT canonical_id, count(*) AS n, count(*) FILTER (is_latest = 1) AS l FROM docs WHERE doc_id IN (SELECT doc_id FROM embedding_log) GROUP BY canonical_id)
        SELECT d.doc_id, d.canonical_id, coalesce(c.n, 0) AS n_chunks FROM (SELECT DISTINCT doc_id, canonical_id FROM store_documents WHERE status = 'active' AND is_latest = 1 AND canonical_id IS NOT NULL) d
        LEFT JOIN c USING (canonical_id) WHERE coalesce(c.l, 0) = 0""",
    "best_document": """WITH b AS (SELECT canonical_id, doc_id FROM store_documents WHERE canonical_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY coalesce(is_latest, 0) DESC, coalesce(TRY_CAST(version_year AS INT), 0) DESC, doc_id) = 1)
        SELECT s.canonical_id, b.doc_id FROM (SELECT DISTINCT canonical_id FROM document_snapshots WHERE canonical_id IS NOT NULL) s LEFT JOIN b USING (canonical_id)""",
}
