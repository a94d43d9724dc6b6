"""Registered queries of the operators over messages, files, fixtures and vectors, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import text as T
from halyard.operators import chunking, contexts, embeddings, evaluation, providers, retrieval, threads, upserts
from halyard.sources.staging import staged
from halyard.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _emails(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every message once: of exports of the same email_id the latest."""
    need = list(dict.fromkeys(["email_id", "ingested_at", "eml_path", *columns]))
    return upserts.first_by(table(s, d, "emails", *need), ["email_id"], [F.desc("ingested_at"), F.desc("eml_path")])


_EMAILS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY ingested_at DESC, eml_path DESC) AS rn_ FROM emails) WHERE rn_ = 1)"
_MD5 = lambda c: F.md5(F.concat(F.lit("7|"), c.cast("string")))  # noqa: E731  order of samples


# Rows by key


@query("SELECT email_id, eml_path, mailbox FROM (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY ingested_at DESC, eml_path DESC) rn FROM emails) WHERE rn = 1")
def emails_latest(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d, "mailbox").select("email_id", "eml_path", "mailbox")


@query("SELECT sha256, char_count FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY processed_at DESC, char_count DESC) rn FROM docling) WHERE rn = 1")
def upsert_files(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "docling", "sha256", "char_count", "processed_at")
    w = Window.partitionBy("sha256").orderBy("processed_at", "char_count")
    ranked = rows.withColumn("rn", F.row_number().over(w))
    return upserts.upsert(ranked.where("rn = 1").drop("rn"), ranked.where("rn > 1").drop("rn"), ["sha256"], [F.desc("processed_at"), F.desc("char_count")]).select("sha256", "char_count")


@query(
    """WITH r AS (SELECT email_id, eml_path, row_number() OVER (PARTITION BY email_id ORDER BY ingested_at, eml_path) a, row_number() OVER (PARTITION BY email_id ORDER BY ingested_at DESC, eml_path DESC) z FROM emails),
    t AS (SELECT email_id, eml_path FROM r WHERE z = 1 AND email_id IN (SELECT email_id FROM parsed_eml)) SELECT * FROM t UNION ALL SELECT email_id, eml_path FROM r WHERE a = 1 AND email_id NOT IN (SELECT email_id FROM t)"""
)
def insert_new_emails(s: SparkSession, d: str) -> DataFrame:
    """Messages that have been parsed are there with their latest export; all exports arrive again."""
    rows = table(s, d, "emails", "email_id", "eml_path", "ingested_at")
    there = _emails(s, d).select("email_id", "eml_path", "ingested_at").join(table(s, d, "parsed_eml", "email_id"), "email_id", "left_semi")
    return upserts.insert_or_ignore(there, rows, ["email_id"], [F.asc("ingested_at"), F.asc("eml_path")]).select("email_id", "eml_path")


@query(
    "WITH many AS (SELECT email_id FROM attachments GROUP BY email_id HAVING count(*) > 1) SELECT id, email_id FROM attachments WHERE email_id NOT IN (SELECT email_id FROM many WHERE email_id IS NOT NULL) OR size_bytes IS NOT NULL"
)
def replace_attachments(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "attachments", "id", "email_id", "size_bytes")
    parents = rows.groupBy("email_id").count().where("count > 1")
    return upserts.replace_children(rows, rows.where("size_bytes is not null"), parents, "email_id").select("id", "email_id")


@query("SELECT voyage_key, coalesce(fixed_by, operated_by) AS fixed_by FROM fixtures")
def set_fixed_by_once(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "fixtures", "voyage_key", "fixed_by", "operated_by")
    return upserts.set_once(rows.select("voyage_key", "fixed_by"), rows.select("voyage_key", F.col("operated_by").alias("fixed_by")), ["voyage_key"], "fixed_by")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY processed_at, char_count) a, row_number() OVER (PARTITION BY sha256 ORDER BY processed_at DESC, char_count DESC) z FROM docling),
    o AS (SELECT * FROM r WHERE a = 1), n AS (SELECT * FROM r WHERE z = 1)
    SELECT n.sha256, CASE WHEN n.markdown IS NULL OR n.markdown = '' THEN coalesce(o.char_count, n.char_count) ELSE n.char_count END AS char_count, CASE WHEN n.markdown IS NULL OR n.markdown = '' THEN 'error' ELSE 'ok' END AS status FROM n JOIN o USING (sha256)"""
)
def keep_counts_on_error(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "docling", "sha256", "markdown", "char_count", "processed_at").withColumn("status", F.when(F.col("markdown").isNull() | (F.col("markdown") == ""), "error").otherwise("ok"))
    old = upserts.first_by(rows, ["sha256"], [F.asc("processed_at"), F.asc("char_count")])
    new = upserts.first_by(rows, ["sha256"], [F.desc("processed_at"), F.desc("char_count")])
    keep = ["sha256", "char_count", "status"]
    return upserts.keep_on_error(old.select(*keep), new.select(*keep), ["sha256"], ["char_count"])


_SAFE = "substr(coalesce(nullif(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'attachment'), 1, 180)"


@query(
    f"""WITH f AS (SELECT voyage_key, {_SAFE.format("file_name")} AS n, sha256, min(id) AS first FROM attachments WHERE sha256 IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY voyage_key, n ORDER BY first, sha256) AS rk FROM f)
    SELECT voyage_key, sha256, CASE WHEN rk = 1 THEN n ELSE regexp_extract(n, '^(.*?)(\\.[^.]*)?$', 1) || '_' || CAST(rk - 1 AS VARCHAR) || regexp_extract(n, '^(.*?)(\\.[^.]*)?$', 2) END AS stored_name FROM r"""
)
def stored_names(s: SparkSession, d: str) -> DataFrame:
    return upserts.numbered_names(table(s, d, "attachments"), "voyage_key", T.safe_filename(F.col("file_name")), "sha256", "id")


# Joins and queues


@query("SELECT DISTINCT p.eml_path, CASE WHEN e.eml_path IS NULL THEN 'missing' ELSE 'ok' END AS status FROM parsed_eml p LEFT JOIN (SELECT DISTINCT eml_path FROM emails) e USING (eml_path)")
def paired_messages(s: SparkSession, d: str) -> DataFrame:
    p, e = table(s, d, "parsed_eml", "eml_path").distinct(), table(s, d, "emails", "eml_path").distinct()
    ok = p.join(e, "eml_path", "left_semi").withColumn("status", F.lit("ok"))
    return ok.unionByName(p.join(e, "eml_path", "left_anti").withColumn("status", F.lit("missing")))


@query("SELECT DISTINCT sha256 FROM docling WHERE sha256 NOT IN (SELECT sha256 FROM attachments WHERE sha256 IS NOT NULL)")
def files_without_attachment(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "docling", "sha256").distinct().join(table(s, d, "attachments", "sha256").where("sha256 is not null"), "sha256", "left_anti")


@query(
    "SELECT sha256, id, file_type, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY id) rn FROM attachments WHERE docling_ready AND sha256 IS NOT NULL AND (size_bytes IS NULL OR size_bytes < 5242880)) WHERE rn = 1"
)
def conversion_queue(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "attachments", "sha256", "id", "file_type", "size_bytes", "docling_ready").where("docling_ready and sha256 is not null and (size_bytes is null or size_bytes < 5242880)")
    return upserts.first_by(rows, ["sha256"], [F.asc("id")]).select("sha256", "id", "file_type", "size_bytes")


_REAL = r"length(regexp_replace(markdown, '<!--[^>]*-->|\s+', '', 'g'))"


@query(
    f"""WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY processed_at DESC, char_count DESC) rn FROM docling) WHERE rn = 1 AND {_REAL} >= 50)
    SELECT m.sha256, min(a.id) AS id, CAST(length(max(m.markdown)) AS BIGINT) AS n_chars FROM m JOIN attachments a USING (sha256) GROUP BY m.sha256"""
)
def extraction_queue(s: SparkSession, d: str) -> DataFrame:
    files = upserts.first_by(table(s, d, "docling", "sha256", "markdown", "char_count", "processed_at"), ["sha256"], [F.desc("processed_at"), F.desc("char_count")])
    files = files.where(T.real_length(F.col("markdown")) >= 50).select("sha256", F.length("markdown").cast("bigint").alias("n_chars"))
    owners = table(s, d, "attachments", "sha256", "id").where("sha256 is not null").groupBy("sha256").agg(F.min("id").alias("id"))
    return files.join(owners, "sha256")


@query("SELECT DISTINCT sha256 FROM docling WHERE EXISTS (SELECT 1 FROM attachments a WHERE a.sha256 = docling.sha256 AND a.size_bytes > 20000)")
def files_with_large_attachment(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "docling", "sha256").distinct().join(table(s, d, "attachments", "sha256", "size_bytes").where("size_bytes > 20000"), "sha256", "left_semi")


@query(
    f"""SELECT e.email_id, CAST(count(a.id) AS BIGINT) AS n_files, CAST(coalesce(sum(a.size_bytes), 0) AS BIGINT) AS n_bytes FROM {_EMAILS} e LEFT JOIN attachments a ON a.email_id = e.email_id AND a.docling_ready GROUP BY e.email_id"""
)
def emails_with_ready_files(s: SparkSession, d: str) -> DataFrame:
    ready = table(s, d, "attachments", "email_id", "id", "size_bytes", "docling_ready").where("docling_ready").groupBy("email_id").agg(F.count("id").alias("n"), F.sum("size_bytes").alias("b"))
    zero = F.lit(0).cast("bigint")
    return _emails(s, d).join(ready, "email_id", "left").select("email_id", F.coalesce("n", zero).alias("n_files"), F.coalesce("b", zero).alias("n_bytes"))


@query(
    f"""SELECT e.email_id, a.id, CAST(m.n AS BIGINT) AS n_chars FROM {_EMAILS} e JOIN attachments a USING (email_id) JOIN (SELECT sha256, max(length(markdown)) AS n FROM docling GROUP BY sha256) m ON m.sha256 = a.sha256 WHERE length(e.body_text) > 100 AND m.n > 50"""
)
def messages_with_files(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "docling", "sha256", "markdown").groupBy("sha256").agg(F.max(F.length("markdown")).cast("bigint").alias("n_chars")).where("n_chars > 50")
    e = _emails(s, d, "body_text").where("length(body_text) > 100").select("email_id")
    return e.join(table(s, d, "attachments", "email_id", "id", "sha256"), "email_id").join(files, "sha256").select("email_id", "id", "n_chars")


@query("SELECT m.sha256, min(a.email_id) AS email_id, CAST(count(a.id) AS BIGINT) AS n_owners FROM (SELECT DISTINCT sha256 FROM docling) m LEFT JOIN attachments a USING (sha256) GROUP BY m.sha256")
def first_owner(s: SparkSession, d: str) -> DataFrame:
    owners = table(s, d, "attachments", "sha256", "email_id", "id").where("sha256 is not null").groupBy("sha256").agg(F.min("email_id").alias("email_id"), F.count("id").alias("n"))
    return table(s, d, "docling", "sha256").distinct().join(owners, "sha256", "left").select("sha256", "email_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_owners"))


@query(
    f"""SELECT source_type, source_id, email_id FROM (SELECT 'email' AS source_type, email_id AS source_id, email_id FROM {_EMAILS} UNION ALL
    SELECT 'attachment', m.sha256, o.email_id FROM (SELECT DISTINCT sha256 FROM docling) m LEFT JOIN (SELECT sha256, min(email_id) AS email_id FROM attachments GROUP BY sha256) o USING (sha256))"""
)
def canonical_sources(s: SparkSession, d: str) -> DataFrame:
    rows = _emails(s, d).select(F.lit("email").alias("source_type"), F.col("email_id").alias("source_id")).unionByName(table(s, d, "docling", F.col("sha256")).distinct().select(F.lit("attachment").alias("source_type"), F.col("sha256").alias("source_id")))
    return evaluation.canonical_source(rows, table(s, d, "attachments", "sha256", "email_id")).select("source_type", "source_id", "email_id")


# Text and keys


@query(
    f"""SELECT email_id, json_extract_string(email_json, '$.DocumentGid') AS gid, CASE json_extract_string(email_json, '$.Direction') WHEN 'Incoming' THEN 'in' WHEN 'Outgoing' THEN 'out' END AS direction, json_extract_string(email_json, '$.Mailboxes[0].Name') AS mailbox FROM {_EMAILS}"""
)
def sidecar_fields(s: SparkSession, d: str) -> DataFrame:
    j = lambda p: F.get_json_object("email_json", p)
    way = j("$.Direction")
    return _emails(s, d, "email_json").select("email_id", j("$.DocumentGid").alias("gid"), F.when(way == "Incoming", "in").when(way == "Outgoing", "out").alias("direction"), j("$.Mailboxes[0].Name").alias("mailbox"))


@query(f"SELECT email_id, CASE WHEN json_valid(email_json) AND starts_with(ltrim(email_json), '{{') THEN json_extract_string(email_json, '$.DocumentGid') END AS gid FROM {_EMAILS}")
def fenced_answers(s: SparkSession, d: str) -> DataFrame:
    """The JSON object of answers that come in a fenced block."""
    fenced = F.concat(F.lit("```json\n"), F.col("email_json"), F.lit("\n```"))
    return _emails(s, d, "email_json").select("email_id", F.get_json_object(T.first_json_object(fenced), "$.DocumentGid").alias("gid"))


@query(f"SELECT email_id, strftime(ingested_at, CASE WHEN strftime(ingested_at, '%H:%M:%S') = '00:00:00' THEN '%Y-%m-%d' ELSE '%Y-%m-%d %H:%M' END) AS shown FROM {_EMAILS}")
def shown_times(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d).select("email_id", T.short_time(F.col("ingested_at")).alias("shown"))


@query(f"SELECT direction, CAST(count(*) AS BIGINT) AS n FROM {_EMAILS} WHERE lower(direction) IN ('in', 'out') GROUP BY direction")
def chosen_directions(s: SparkSession, d: str) -> DataFrame:
    """A filter as a user gives it: values in any case, each once."""
    chosen = evaluation.resolve_filter(["In", "OUT", "in"], ["in", "out"], ["in"])
    return _emails(s, d, "direction").where(F.lower("direction").isin(*chosen)).groupBy("direction").agg(F.count("*").alias("n"))


_SUBJECT = r"lower(regexp_replace(regexp_replace(regexp_replace(subject, '^(\s*(re|fw|fwd|sv|vs|tr|aw)\s*:\s*)+', '', 'i'), '\s+', ' ', 'g'), '^[\s\p{Z}\x{0085}]+|[\s\p{Z}\x{0085}]+$', '', 'g'))"


@query(f"SELECT email_id, {_SUBJECT} AS topic FROM {_EMAILS}")
def normalized_subjects(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d, "subject").select("email_id", T.normalize_subject(F.col("subject")).alias("topic"))


_WS = r"[\s\p{Z}\x{000B}\x{001C}-\x{001F}\x{0085}]"
_UNIX = r"regexp_replace(body_text, '\r\n|\r', chr(10), 'g')"


@query(f"SELECT email_id, md5(regexp_replace({_UNIX}, '(?im){T.HEADER_RE}', '', 'g')) AS body_md5 FROM {_EMAILS}")
def bodies_without_headers(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d, "body_text").select("email_id", F.md5(T.without_headers(T.unix_lines(F.col("body_text"))).cast("binary")).alias("body_md5"))


@query(f"SELECT email_id, array_to_string(list_filter(regexp_split_to_array({_UNIX}, '\\n[ \\t]*\\n'), lambda p: NOT regexp_matches(p, '(?i){T.LEGAL_RE}')), chr(10) || chr(10)) AS body FROM {_EMAILS}")
def bodies_without_notices(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d, "body_text").select("email_id", T.without_legal_notices(T.unix_lines(F.col("body_text"))).alias("body"))


@query(
    rf"SELECT email_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_UNIX}, '[ \t]{{2,}}', ' ', 'g'), '[ \t]+(\n|\z)', '\1', 'g'), ' +([,.;:!?])', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+\z', '', 'g'), '') AS body FROM {_EMAILS}"
)
def tidy_bodies(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d, "body_text").select("email_id", T.tidy_space(T.unix_lines(F.col("body_text"))).alias("body"))


@query()
def cleaned_bodies(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d, "body_text").select("email_id", T.clean_body(F.col("body_text")).alias("body"))


@query()
def html_bodies(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d, "body_html").where("body_html is not null").select("email_id", T.tidy_space(T.above_quote(T.unix_lines(F.col("body_html")))).alias("body"))


_FOLDER = "split_part(eml_path, '/', 3)"


@query(
    rf"""SELECT DISTINCT {_FOLDER} AS folder, regexp_replace(replace(upper(trim(split_part({_FOLDER}, ' - ', 1))), ' ', '_'), '[^A-Z0-9_]', '', 'g') || CASE WHEN regexp_extract(trim(split_part({_FOLDER}, ' - ', 2)), '(?i)^v(\d+)$', 1) <> '' THEN '_' || regexp_extract(trim(split_part({_FOLDER}, ' - ', 2)), '(?i)^v(\d+)$', 1) ELSE '' END AS group_key FROM emails"""
)
def folder_keys(s: SparkSession, d: str) -> DataFrame:
    folder = F.split_part("eml_path", F.lit("/"), F.lit(3))
    return table(s, d, "emails", "eml_path").select(folder.alias("folder")).distinct().select("folder", T.folder_key(F.col("folder")).alias("group_key"))


@query("SELECT voyage_key, regexp_replace(regexp_replace(upper(concat_ws('_', vessel_name, CAST(voyage_no AS VARCHAR))), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name_key FROM fixtures")
def fixture_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fixtures", "voyage_key", "vessel_name", "voyage_no").select("voyage_key", T.name_key(F.col("vessel_name"), F.col("voyage_no")).alias("name_key"))


@query(rf"SELECT doc_id, replace(trim(regexp_replace(lower(replace(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), 'İ', 'i')), '\s+', ' ', 'g')), 'ς', 'σ') AS words FROM documents")
def query_words(s: SparkSession, d: str) -> DataFrame:
    """The words of every document. Two letters that engines lower differently are folded: the dotted capital I and the final sigma."""
    text = F.replace("text", F.lit("İ"), F.lit("i"))
    return table(s, d, "documents", "doc_id", "text").select("doc_id", F.replace(T.query_text(text), F.lit("ς"), F.lit("σ")).alias("words"))


@query()
def query_words_whole(s: SparkSession, d: str) -> DataFrame:
    """The words of every document as they are lowered here; no SQL, as DuckDB's lower() differs for some letters."""
    return table(s, d, "documents", "doc_id", "text").select("doc_id", T.query_text(F.col("text")).alias("words"))


@query("SELECT sha256(text) AS content, CAST(count(*) AS BIGINT) AS n_docs, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_groups(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text").where("text is not null").groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


_EXT = r"lower(regexp_extract(coalesce(file_name, ''), '[^./\\][^/\\]*(\.[^./\\]*)$', 1))"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(
    rf"SELECT id, CASE WHEN {_EXT} IN ({_LIST(T.NO_TEXT_EXTENSIONS)}) THEN false WHEN file_type IS NULL OR file_type = '' THEN true ELSE NOT (lower(file_type) LIKE 'image/%' OR lower(file_type) LIKE 'video/%' OR lower(file_type) IN ({_LIST(T.NO_TEXT_TYPES)})) END AS ready FROM attachments"
)
def files_with_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "attachments", "id", "file_type", "file_name").select("id", T.has_text(F.col("file_type"), F.col("file_name")).alias("ready"))


@query("SELECT tier, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM (SELECT n_chars, CASE WHEN n_chars IS NULL THEN NULL WHEN n_chars <= 30000 THEN 'small' WHEN n_chars <= 95000 THEN 'medium' WHEN n_chars <= 300000 THEN 'large' ELSE 'huge' END AS tier FROM documents) GROUP BY tier")
def size_tiers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "n_chars").groupBy(T.size_tier(F.col("n_chars")).alias("tier")).agg(F.count("*").alias("n"), F.sum(F.expr("n_chars div 4")).cast("bigint").alias("tokens"))


@query("SELECT sha256, mode, CAST(count(*) AS BIGINT) AS n FROM (SELECT sha256, CASE WHEN markdown IS NULL THEN NULL WHEN (length(markdown) + 2000) // 3 + 2500 + 400 > 32768 OR length(markdown) >= 6000 THEN 'classify' ELSE 'full' END AS mode FROM docling) GROUP BY ALL")
def extraction_modes(s: SparkSession, d: str) -> DataFrame:
    over = F.expr("(length(markdown) + 2000) div 3 + 2500 + 400 > 32768 or length(markdown) >= 6000")
    mode = F.when(F.col("markdown").isNotNull(), F.when(over, "classify").otherwise("full"))
    return table(s, d, "docling", "sha256", "markdown").groupBy("sha256", mode.alias("mode")).agg(F.count("*").alias("n"))


@query(r"SELECT DISTINCT sha256, nullif(trim(regexp_extract(markdown, '(?m)^[ \t]*#+[ \t]*([^\n]*)', 1)), '') AS document_type FROM docling")
def document_types(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "docling", "sha256", "markdown").select("sha256", F.nullif(F.trim(F.regexp_extract("markdown", r"(?m)^[ \t]*#+[ \t]*([^\n]*)", 1)), F.lit("")).alias("document_type")).distinct()


@query(r"SELECT doc_id, regexp_extract(text, '([A-Z]{2})[-/]?(\d{5,6})', 1) AS series, TRY_CAST(nullif(regexp_extract(text, '([A-Z]{2})[-/]?(\d{5,6})', 2), '') AS BIGINT) AS number FROM documents")
def first_references(s: SparkSession, d: str) -> DataFrame:
    p = r"([A-Z]{2})[-/]?(\d{5,6})"
    return table(s, d, "documents", "doc_id", "text").select("doc_id", F.regexp_extract("text", p, 1).alias("series"), F.nullif(F.regexp_extract("text", p, 2), F.lit("")).cast("bigint").alias("number"))


@query("SELECT id, format('{:.1f} MB', size_bytes / 1048576) AS shown FROM attachments")
def file_sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "attachments", "id", "size_bytes").select("id", T.megabytes(F.col("size_bytes")).alias("shown"))


@query(r"SELECT doc_id, coalesce(NOT regexp_matches(text, '(?i)\b(berth|agents)\b') AND (coalesce(contains(lower(text), lower('USD')), false) OR coalesce(contains(lower(text), lower(voyage_key)), false)), false) AS fits FROM documents")
def fitting_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text", "voyage_key").select("doc_id", T.acceptable_question(F.col("text"), ["berth", "agents"], F.lit("USD"), F.col("voyage_key")).alias("fits"))


# Groups, windows, samples


@query(
    f"""SELECT e.voyage_key, CAST(count(*) AS BIGINT) AS n_emails, CAST(count(DISTINCT thread_id) AS BIGINT) AS n_threads, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS n_files, CAST(coalesce(sum(a.b), 0) AS BIGINT) AS n_bytes
    FROM {_EMAILS} e LEFT JOIN (SELECT email_id, count(*) AS n, sum(size_bytes) AS b FROM attachments GROUP BY email_id) a USING (email_id) GROUP BY e.voyage_key"""
)
def ingest_counters(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "attachments", "email_id", "size_bytes").groupBy("email_id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    e = _emails(s, d, "voyage_key", "thread_id").join(files, "email_id", "left")
    zero = F.lit(0).cast("bigint")
    return e.groupBy("voyage_key").agg(F.count("*").alias("n_emails"), F.countDistinct("thread_id").alias("n_threads"), F.coalesce(F.sum("n"), zero).alias("n_files"), F.coalesce(F.sum("b"), zero).alias("n_bytes"))


@query("SELECT file_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT sha256) AS BIGINT) AS n_contents FROM attachments GROUP BY file_type")
def file_types(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "attachments", "file_type", "sha256").groupBy("file_type").agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("n_contents"))


@query(
    "SELECT coalesce(source, 'total') AS source, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS mean_chars, CAST(count(*) FILTER (WHERE n_chars >= 1000) AS BIGINT) AS long_docs FROM documents WHERE source IS NOT NULL GROUP BY ROLLUP (source)"
)
def source_rollup(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "source", "n_chars").where("source is not null")
    out = docs.rollup("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_if(F.col("n_chars") >= 1000).alias("long_docs"))
    return out.withColumn("source", F.coalesce("source", F.lit("total")))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, max(ts) AS latest, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def latest_by_json(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events", "event_type", "props", "ts", "event_id").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("event_type", "k").agg(F.max("ts").alias("latest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(
    f"""SELECT email_id, CAST(row_number() OVER w - 1 AS BIGINT) AS prior_count, CAST(coalesce(sum(length(body_text)) OVER (PARTITION BY thread_id ORDER BY ingested_at NULLS LAST, email_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_chars
    FROM {_EMAILS} WHERE thread_id IS NOT NULL WINDOW w AS (PARTITION BY thread_id ORDER BY ingested_at NULLS LAST, email_id)"""
)
def earlier_messages(s: SparkSession, d: str) -> DataFrame:
    e = _emails(s, d, "thread_id", "body_text").where("thread_id is not null").select(F.col("email_id").alias("id"), "thread_id", F.col("ingested_at").alias("sent_at"), F.col("body_text").alias("text"))
    return threads.earlier_in_thread(e).withColumnRenamed("id", "email_id")


@query(f"SELECT thread_id, email_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY ingested_at, email_id) AS INTEGER) AS position FROM {_EMAILS} WHERE thread_id IS NOT NULL")
def thread_lists(s: SparkSession, d: str) -> DataFrame:
    e = _emails(s, d, "thread_id").where("thread_id is not null")
    return e.select("thread_id", "email_id", F.row_number().over(Window.partitionBy("thread_id").orderBy("ingested_at", "email_id")).alias("position"))


_DIGIT = "(instr('0123456789abcdef', substr(h, 17, 1)) - 1)"


@query(
    rf"""WITH RECURSIVE m AS (SELECT email_id AS id, coalesce(voyage_key, '') AS g, message_id, in_reply_to, coalesce(reference_ids, []) AS refs, {_SUBJECT} AS topic, ingested_at,
    list_concat([regexp_extract(coalesce(from_addr, ''), '([^<>\s]+@[^<>\s]+)', 1)], coalesce(to_addr, []), coalesce(cc_addr, [])) AS people FROM {_EMAILS}),
    k AS (SELECT g, message_id, max(id) AS b FROM m WHERE message_id IS NOT NULL GROUP BY ALL),
    asked AS (SELECT g, id AS a, unnest(list_append(refs, in_reply_to)) AS message_id FROM m), person AS (SELECT id AS a, g, topic, lower(unnest(people)) AS p FROM m WHERE topic <> ''),
    l AS (SELECT a, b FROM asked JOIN k USING (g, message_id) UNION SELECT a, '~' || g || chr(1) || topic || chr(1) || p FROM person WHERE p <> ''), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach AS (SELECT id AS a, id AS b FROM m UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
    f AS (SELECT root, count(*) AS n, arg_min(struct_pack(id := id, g := g, topic := topic), (coalesce(epoch_us(ingested_at), 0), id)) AS x FROM m JOIN c USING (id) GROUP BY root),
    u AS (SELECT root, n, lower(sha1(unhex('{threads.NAMESPACE}') || encode(concat_ws('|', x.g, coalesce(nullif(x.topic, ''), x.id), x.id)))) AS h FROM f)
    SELECT id AS email_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', {_DIGIT} % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS thread_id, CAST(n AS BIGINT) AS thread_size FROM c JOIN u USING (root)"""
)
def message_threads(s: SparkSession, d: str) -> DataFrame:
    """Threads named by the message that arrived first."""
    return threads.threads(_messages(s, d).withColumn("sent_at", F.col("ingested_at"))).withColumnRenamed("id", "email_id")


@query()
def message_threads_by_date(s: SparkSession, d: str) -> DataFrame:
    """Threads named by the message that was sent first, by the normalised instants of sent_at; no SQL can read these strings."""
    from halyard.plans.core import p4_normalised

    sent = p4_normalised(s, d).where("record_type = 'emails' and sent_us is not null").groupBy(F.col("record_id").alias("id")).agg(F.timestamp_micros(F.min("sent_us")).alias("sent_at"))
    return threads.threads(_messages(s, d).join(sent, "id", "left")).withColumnRenamed("id", "email_id")


def _messages(s: SparkSession, d: str) -> DataFrame:
    e = _emails(s, d, "voyage_key", "message_id", "in_reply_to", "reference_ids", "subject", "from_addr", "to_addr", "cc_addr")
    none = F.array().cast("array<string>")
    people = F.concat(F.array(F.regexp_extract(F.coalesce("from_addr", F.lit("")), r"([^<>\s]+@[^<>\s]+)", 1)), F.coalesce("to_addr", none), F.coalesce("cc_addr", none))
    return e.select(F.col("email_id").alias("id"), F.coalesce("voyage_key", F.lit("")).alias("group_key"), "message_id", "in_reply_to", "reference_ids", "subject", people.alias("people"), "ingested_at")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) rn FROM documents) WHERE rn = 1")
def sample_one_per_source(s: SparkSession, d: str) -> DataFrame:
    return upserts.first_by(table(s, d, "documents", "source", "doc_id"), ["source"], [_MD5(F.col("doc_id")), F.asc("doc_id")])


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def sample_documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text").where("text is not null").select("doc_id").orderBy(_MD5(F.col("doc_id")), "doc_id").limit(50)


@query(
    "SELECT voyage_key, doc_id, list_extract(['facts', 'numbers', 'dates', 'unanswerable'], CAST((rn - 1) // 5 % 4 AS INTEGER) + 1) AS category FROM (SELECT voyage_key, doc_id, row_number() OVER (PARTITION BY voyage_key ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) rn FROM documents WHERE voyage_key IS NOT NULL) WHERE rn <= 20"
)
def category_blocks(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "voyage_key", "doc_id").where("voyage_key is not null")
    rn = F.row_number().over(Window.partitionBy("voyage_key").orderBy(_MD5(F.col("doc_id")), "doc_id"))
    names = F.array(*[F.lit(x) for x in ("facts", "numbers", "dates", "unanswerable")])
    return docs.withColumn("rn", rn).where("rn <= 20").select("voyage_key", "doc_id", F.element_at(names, F.expr("cast((rn - 1) div 5 % 4 as int) + 1")).alias("category"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id) rn FROM documents) WHERE rn <= 5")
def longest_per_language(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.col("n_chars").desc_nulls_last(), "doc_id")
    return table(s, d, "documents", "lang", "doc_id", "n_chars").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("lang", "doc_id")


@query(f"SELECT email_id FROM {_EMAILS} WHERE lower(mailbox) NOT IN ('ops.oslo', 'desk.tokyo') AND direction IN ('in')")
def operator_messages(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d, "mailbox", "direction").where(~F.lower("mailbox").isin("ops.oslo", "desk.tokyo") & F.col("direction").isin("in")).select("email_id")


# Chunks and prompts


_TAKEN = "substr(s, CAST(a AS INTEGER) + 1051, 450)"
_BREAK = lambda e: f"nullif(length(regexp_extract({_TAKEN}, '(?s)^(.*{e})')), 0)"  # noqa: E731  end of the last one in the window's tail


@query(
    rf"""WITH RECURSIVE t AS (SELECT CAST(doc_id AS VARCHAR) AS id, regexp_replace(text, '^{_WS}+|{_WS}+\z', '', 'g') AS s FROM documents WHERE text IS NOT NULL),
    c AS (SELECT id, s, 0 AS k, 0 AS a, CASE WHEN length(s) <= 1500 THEN length(s) ELSE (SELECT 1050 + coalesce({_BREAK(chr(92) + "n" + chr(92) + "n")}, {_BREAK(chr(92) + "n")}, {_BREAK("[.] ")}, {_BREAK("! ")}, {_BREAK("[?] ")}, {_BREAK(" ")}, 450) FROM (SELECT 0 AS a)) END AS e FROM t WHERE s <> ''
    UNION ALL SELECT id, s, k + 1, b, CASE WHEN length(s) - b <= 1500 THEN length(s) ELSE b + 1050 + (SELECT coalesce({_BREAK(chr(92) + "n" + chr(92) + "n")}, {_BREAK(chr(92) + "n")}, {_BREAK("[.] ")}, {_BREAK("! ")}, {_BREAK("[?] ")}, {_BREAK(" ")}, 450) FROM (SELECT b AS a)) END
    FROM (SELECT *, CASE WHEN e - 200 > a THEN e - 200 ELSE e END AS b FROM c WHERE e < length(s)))
    SELECT id, CAST(k AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start, CAST(length(x) AS INTEGER) AS n_chars, CAST(length(x) // 4 AS INTEGER) AS token_estimate FROM (SELECT id, k, a, regexp_replace(substr(s, CAST(a AS INTEGER) + 1, CAST(e - a AS INTEGER)), '{_WS}+\z', '') AS x FROM c)"""
)
def document_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(s, d, "documents", "doc_id", "text"), "doc_id", "text").drop("text")


@query()
def embedded_chunks(s: SparkSession, d: str) -> DataFrame:
    c = chunking.chunks(table(s, d, "docling", "sha256", "markdown").groupBy("sha256").agg(F.max("markdown").alias("markdown")), "sha256", "markdown")
    return retrieval.embed(c, F.col("text")).select("id", "chunk_index", "embedding")


@query(
    rf"""SELECT email_id, 'From: ' || coalesce(from_addr, '') || chr(10) || 'Subject: ' || coalesce(subject, '') || chr(10) || 'Files: ' || CAST(coalesce(f.n, 0) AS VARCHAR) || ' ' || coalesce(f.name, '-') || chr(10) || chr(10) || coalesce(body_cleaned, '') AS prompt
    FROM {_EMAILS} LEFT JOIN (SELECT email_id, count(*) AS n, arg_min(file_name, id) AS name FROM attachments GROUP BY email_id) f USING (email_id)"""
)
def email_prompts(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "attachments", "email_id", "id", "file_name").groupBy("email_id").agg(F.count("*").alias("n"), F.min_by("file_name", "id").alias("name"))
    e = _emails(s, d, "from_addr", "subject", "body_cleaned").join(files, "email_id", "left")
    c = lambda x, y="": F.coalesce(F.col(x).cast("string"), F.lit(y))
    return e.select("email_id", F.concat(F.lit("From: "), c("from_addr"), F.lit("\nSubject: "), c("subject"), F.lit("\nFiles: "), c("n", "0"), F.lit(" "), c("name", "-"), F.lit("\n\n"), c("body_cleaned")).alias("prompt"))


@query(
    rf"""WITH p AS (SELECT email_id, prompt, regexp_replace(substr(prompt, strpos(prompt, chr(10) || chr(10)) + 2), '^{_WS}+|{_WS}+\z', '', 'g') AS b, length(regexp_replace(prompt, '{_WS}', '', 'g')) >= 50 AS ok FROM ({SQL["email_prompts"]})),
    q AS (SELECT *, regexp_extract(b, '(?s)^(.*?[.!?]){_WS}', 1) AS one FROM p), r AS (SELECT *, regexp_replace(substr(b, length(one) + 1), '^{_WS}+', '') AS rest FROM q), w AS (SELECT *, regexp_extract(rest, '(?s)^(.*?[.!?]){_WS}', 1) AS two FROM r),
    x AS (SELECT email_id, prompt, ok, CASE WHEN one = '' THEN b WHEN two = '' THEN one || ' ' || rest ELSE one || ' ' || two END AS t FROM w)
    SELECT email_id, CASE WHEN ok THEN t END AS text, CAST(CASE WHEN ok THEN length(prompt) // 3 ELSE 0 END AS INTEGER) AS input_tokens, CAST(CASE WHEN ok THEN length(t) // 3 ELSE 0 END AS INTEGER) AS output_tokens, CASE WHEN ok THEN 'ok' ELSE 'skipped' END AS status, CAST(NULL AS VARCHAR) AS error FROM x"""
)
def email_summaries(s: SparkSession, d: str) -> DataFrame:
    return providers.complete(email_prompts(s, d), "email_id", F.col("prompt"), least=50)


def _short_window(text: str) -> str:
    """A model whose window is smaller than the router takes it for."""
    if len(text) > 3000:
        raise providers.ContextOverflow
    return providers.first_sentences(text)


@query(
    rf"""WITH m AS (SELECT sha256, max(markdown) AS t FROM docling GROUP BY sha256), r AS (SELECT *, coalesce(length(regexp_replace(t, '<!--[^>]*-->|\s+', '', 'g')), 0) >= 50 AS ok, length(t) < 6000 AND length(t) <= 3000 AS whole FROM m)
    SELECT sha256, CASE WHEN ok THEN CASE WHEN whole THEN 'full' ELSE 'classify' END END AS mode, CASE WHEN ok THEN 'ok' ELSE 'skipped' END AS status, CAST(CASE WHEN NOT ok THEN 0 WHEN whole THEN length(t) ELSE least(length(t), 25000) END AS INTEGER) AS n_sent FROM r"""
)
def extractions(s: SparkSession, d: str) -> DataFrame:
    """Files sent to a model, with the fallback where the whole text overflows its window."""
    files = table(s, d, "docling", "sha256", "markdown").groupBy("sha256").agg(F.max("markdown").alias("markdown"))
    return providers.extract(files, "sha256", "markdown", full=_short_window).select("sha256", "mode", "status", "n_sent")


@query(f"SELECT email_id, coalesce(nullif(trim(regexp_replace(coalesce(subject, ''), '[0-9]+', '', 'g')), ''), subject) AS question FROM {_EMAILS}")
def reformulated_subjects(s: SparkSession, d: str) -> DataFrame:
    """Questions in a provider's words (here: without numbers), or as they are where it gives none."""
    provider = lambda x: x.str.replace("[0-9]+", "", regex=True).str.strip(" ")
    return _emails(s, d, "subject").select("email_id", providers.reformulated(F.col("subject"), provider).alias("question"))


def _file_texts(s: SparkSession, d: str) -> DataFrame:
    """(id, text, summary) of files: the summary is the first heading."""
    m = table(s, d, "docling", "sha256", "markdown").groupBy("sha256").agg(F.max("markdown").alias("text"))
    return m.select(F.col("sha256").alias("id"), "text", F.regexp_extract("text", r"(?m)^[ \t]*#+[ \t]*([^\n]*)", 1).alias("summary"))


@query()
def context_vectors(s: SparkSession, d: str) -> DataFrame:
    """Chunks of files embedded below their file's heading."""
    files = _file_texts(s, d)
    return embeddings.context_embedded(chunking.chunks(files, "id", "text"), files.select("id", "summary")).select("id", "chunk_index", "embedding")


@query()
def late_vectors(s: SparkSession, d: str) -> DataFrame:
    """Chunks of files pooled from the token vectors of the whole file."""
    files = _file_texts(s, d).withColumn("text", T.strip(F.col("text")))
    return embeddings.late_embedded(files, chunking.chunks(files, "id", "text"))


@query()
def summary_vectors(s: SparkSession, d: str) -> DataFrame:
    """One vector of each message's summary."""
    notes = providers.complete(email_prompts(s, d), "email_id", F.col("prompt"), least=50).where("status = 'ok'").select("email_id", F.col("text").alias("summary"))
    return embeddings.summary_embedded(notes).select("source_id", "chunk_index", "embedding")


_STRIP = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+\\z', '', 'g')"


@query(
    f"""WITH f AS (SELECT a.email_id, string_agg('--- Attachment: ' || coalesce(a.file_name, '') || ' ---' || chr(10) || coalesce({_STRIP("m.t")}, ''), chr(10) ORDER BY a.id) AS t FROM attachments a LEFT JOIN (SELECT sha256, max(markdown) AS t FROM docling GROUP BY sha256) m USING (sha256) GROUP BY a.email_id),
    p AS (SELECT email_id, 'Direction: ' || coalesce(direction, '') || chr(10) || 'Date: ' || coalesce(strftime(ingested_at, '%Y-%m-%d %H:%M'), '') || chr(10) || chr(10) || 'Email summary:' || chr(10) || coalesce({_STRIP("coalesce(subject, '')")}, '') || coalesce(chr(10) || chr(10) || t, '') AS prompt FROM {_EMAILS} LEFT JOIN f USING (email_id))
    SELECT email_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS n_chars FROM p"""
)
def attachment_prompts(s: SparkSession, d: str) -> DataFrame:
    """Messages with the whole texts of their files in order."""
    texts = table(s, d, "docling", "sha256", "markdown").groupBy("sha256").agg(F.max("markdown").alias("content"))
    files = table(s, d, "attachments", "email_id", "id", "file_name", "sha256").join(texts, "sha256", "left").withColumnRenamed("id", "ord")
    e = _emails(s, d, "direction", "subject").select("email_id", "direction", F.date_format("ingested_at", "yyyy-MM-dd HH:mm").alias("date"), F.coalesce("subject", F.lit("")).alias("summary"))
    return contexts.attachment_prompts(e, files).select("email_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.length("prompt").cast("bigint").alias("n_chars"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY email_id, file_name, sha256 ORDER BY id DESC) z, row_number() OVER (PARTITION BY email_id, file_name, sha256 ORDER BY id) a FROM attachments) SELECT email_id, file_name, sha256, id FROM r WHERE z = 1"""
)
def upsert_by_four_columns(s: SparkSession, d: str) -> DataFrame:
    """An upsert whose key is made of several columns, nulls among them counting as equal values."""
    rows = table(s, d, "attachments", "email_id", "file_name", "sha256", "id")
    keyed = rows.withColumns({f"k{i}": F.coalesce(c, F.lit("\0")) for i, c in enumerate(["email_id", "file_name", "sha256"])})
    keys = ["k0", "k1", "k2"]
    old = upserts.first_by(keyed, keys, [F.asc("id")])
    return upserts.upsert(old, keyed, keys, [F.desc("id")]).select("email_id", "file_name", "sha256", "id")


@query("SELECT id, voyage_key, CAST((row_number() OVER (PARTITION BY voyage_key ORDER BY id) - 1) // 15 AS BIGINT) AS batch FROM attachments")
def fixed_batches(s: SparkSession, d: str) -> DataFrame:
    """Batches of 15 files within each group."""
    rn = F.row_number().over(Window.partitionBy("voyage_key").orderBy("id"))
    return table(s, d, "attachments", "id", "voyage_key").withColumn("rn", rn).select("id", "voyage_key", F.expr("cast((rn - 1) div 15 as bigint)").alias("batch"))


@query("SELECT id, CASE WHEN starts_with(file_path, '/files/') THEN '/data/' || substr(file_path, 8) ELSE file_path END AS location, lower(regexp_extract(coalesce(file_name, ''), '(\\.[^./\\\\]*)$', 1)) AS extension FROM attachments")
def file_locations(s: SparkSession, d: str) -> DataFrame:
    """Paths below another root, and extensions."""
    rows = table(s, d, "attachments", "id", "file_path", "file_name")
    return rows.select("id", T.under_root(F.col("file_path"), "/files/", "/data/").alias("location"), F.lower(F.regexp_extract(F.coalesce("file_name", F.lit("")), r"(\.[^./\\]*)$", 1)).alias("extension"))


@query(f"SELECT email_id, CAST(coalesce(cardinality(raw_headers), 0) AS INTEGER) AS n_headers, array_to_string(list_sort(map_keys(raw_headers)), ',') AS names, raw_headers['Date'] AS header_date FROM {_EMAILS}")
def message_headers(s: SparkSession, d: str) -> DataFrame:
    h = F.col("raw_headers")
    return _emails(s, d, "raw_headers").select("email_id", F.coalesce(F.when(h.isNotNull(), F.size(h)), F.lit(0)).alias("n_headers"), F.array_join(F.array_sort(F.map_keys(h)), ",").alias("names"), F.try_element_at(h, F.lit("Date")).alias("header_date"))


@query(
    "WITH m AS (SELECT sha256, max(markdown) AS t FROM docling GROUP BY sha256), x AS (SELECT sha256, t, CASE WHEN t IS NULL THEN NULL WHEN (length(t) + 2000) // 3 + 2500 + 400 > 32768 OR length(t) >= 6000 THEN 'classify' ELSE 'full' END AS mode FROM m) SELECT sha256, mode, md5(CASE WHEN mode = 'classify' THEN substr(t, 1, 25000) ELSE t END) AS sent FROM x"
)
def extraction_inputs(s: SparkSession, d: str) -> DataFrame:
    """What the model is sent for each file: the whole text, or for classification its first 25,000 characters, as the model's window demands."""
    m = table(s, d, "docling", "sha256", "markdown").groupBy("sha256").agg(F.max("markdown").alias("t"))
    mode = T.extraction_mode(F.length("t"))
    return m.withColumn("mode", mode).select("sha256", "mode", F.md5(F.when(F.col("mode") == "classify", F.substring("t", 1, 25_000)).otherwise(F.col("t")).cast("binary")).alias("sent"))


_ENDS = r"'\r\n|[\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]'"


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_replace('document_type: draft' || chr(10) || 'DOCUMENT_TYPE: ' || coalesce(source, '') || chr(10) || 'Summary: ' || coalesce(text, ''), {_ENDS}, chr(10), 'g') AS x FROM documents),
    l AS (SELECT doc_id, regexp_extract_all(x, '(?im)^[\t\p{{Z}}]*DOCUMENT_TYPE:([^\n]*)$', 1) AS a, regexp_extract_all(x, '(?im)^[\t\p{{Z}}]*SUMMARY:([^\n]*)$', 1) AS b FROM t)
    SELECT doc_id, nullif(regexp_replace(a[len(a)], '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '') AS document_type, nullif(regexp_replace(b[len(b)], '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '') AS summary FROM l"""
)
def parsed_classifications_whole(s: SparkSession, d: str) -> DataFrame:
    """Answers that hold the whole text, with its own line ends and labels."""
    x = F.concat(F.lit("document_type: draft\nDOCUMENT_TYPE: "), F.coalesce("source", F.lit("")), F.lit("\nSummary: "), F.coalesce("text", F.lit("")))
    return table(s, d, "documents", "doc_id", "source", "text").select("doc_id", providers.labelled_line(x, "DOCUMENT_TYPE").alias("document_type"), providers.labelled_line(x, "SUMMARY").alias("summary"))


@query(SQL["parsed_classifications_whole"])
def parsed_classifications(s: SparkSession, d: str) -> DataFrame:
    """The same rows under the name this query had first."""
    return parsed_classifications_whole(s, d)


_JUDGED = r"""SELECT doc_id, lang, TRY_CAST(nullif(regexp_extract(x, 'SCORE:[\s\p{Z}\x{0085}]*([1-5])', 1), '') AS INTEGER) AS score, nullif(regexp_replace(regexp_extract(x, 'REASONING:[\s\p{Z}\x{0085}]*([^\n]+)', 1), '^[\s\p{Z}\x{0085}]+|[\s\p{Z}\x{0085}]+$', '', 'g'), '') AS reasoning FROM
    (SELECT doc_id, lang, 'SCORE: ' || CAST(coalesce(n_chars, 0) % 7 AS VARCHAR) || chr(10) || 'REASONING: ' || coalesce(text, '') AS x FROM documents)"""


@query(f"SELECT doc_id, score, reasoning FROM ({_JUDGED})")
def judgements_whole(s: SparkSession, d: str) -> DataFrame:
    """Score and reasoning of answers that hold the whole text."""
    return _judged(s, d).select("doc_id", "score", "reasoning")


@query(f"SELECT lang, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_score, CAST(count(*) FILTER (WHERE score >= 4) AS BIGINT) AS good, CAST(count(reasoning) AS BIGINT) AS explained FROM ({_JUDGED}) GROUP BY lang")
def judged_by_language_whole(s: SparkSession, d: str) -> DataFrame:
    """Measures by language of answers that hold the whole text."""
    return _judged(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("score") >= 4).alias("good"), F.count("reasoning").alias("explained"))


@query(SQL["judged_by_language_whole"])
def judged_by_language(s: SparkSession, d: str) -> DataFrame:
    """The same rows under the name this query had first."""
    return judged_by_language_whole(s, d)


def _judged(s: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("SCORE: "), (F.coalesce("n_chars", F.lit(0)) % 7).cast("string"), F.lit("\nREASONING: "), F.coalesce("text", F.lit("")))
    score, reasoning = providers.judgement(x)
    return table(s, d, "documents", "doc_id", "lang", "n_chars", "text").select("doc_id", "lang", score.alias("score"), reasoning.alias("reasoning"))


# Retrieval and its measures

_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q)"


def _first_vector(s: SparkSession, d: str) -> list[float]:
    return list(table(s, d, "embeddings").agg(F.min_by("embedding", "vec_id")).first()[0])


_INDEXES: dict[tuple, DataFrame] = {}


def _postings(s: SparkSession, d: str) -> DataFrame:
    """The documents' postings, written once per application and state of the table."""
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    files = path.getFileSystem(s._jsc.hadoopConfiguration())
    key = (s.sparkContext.applicationId, d, files.getFileStatus(path).getModificationTime(), files.getContentSummary(path).getLength())
    if key not in _INDEXES:
        _INDEXES[key] = staged(retrieval.postings(table(s, d, "documents", "doc_id", "text")), "postings")
    return _INDEXES[key]


@query(f"SELECT vec_id, label, round({_COS}, 9) AS similarity FROM embeddings e, {_Q} ORDER BY {_COS} DESC, vec_id LIMIT 20")
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_topk(table(s, d, "embeddings"), _first_vector(s, d), 20).withColumn("similarity", F.round("similarity", 9))


@query(f"SELECT vec_id, label, round({_COS}, 9) AS similarity FROM embeddings e, {_Q} WHERE label IN (1, 3) ORDER BY {_COS} DESC, vec_id LIMIT 20")
def vector_topk_of_labels(s: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_topk(table(s, d, "embeddings"), _first_vector(s, d), 20, [1, 3]).withColumn("similarity", F.round("similarity", 9))


@query(
    f"""WITH n AS (SELECT label, {_COS} AS sim FROM embeddings e, {_Q} ORDER BY sim DESC, vec_id LIMIT 50), v AS (SELECT label, CAST(count(*) AS BIGINT) AS votes, round(max(sim), 9) AS best FROM n GROUP BY label)
    SELECT label, votes, best, votes = (SELECT max(votes) FROM v) AS wins FROM v"""
)
def group_vote(s: SparkSession, d: str) -> DataFrame:
    near = retrieval.vector_topk(table(s, d, "embeddings"), _first_vector(s, d), 50)
    return retrieval.group_vote(near).withColumn("best", F.round("best", 9))


_NEAR = """(SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) DESC, e.vec_id) AS rank
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 10)"""


def _near(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return retrieval.batch_topk(v, v.where("vec_id % 20 = 0 and embedding is not null"), 10)


@query(f"SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM {_NEAR}")
def nearest_vectors(s: SparkSession, d: str) -> DataFrame:
    return _near(s, d).select("query_id", "vec_id", "rank")


@query(
    """SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) DESC, e.vec_id) AS rank
    FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5"""
)
def nearest_of_label(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return retrieval.batch_topk(v, v.where("vec_id % 20 = 0"), 5, "label").select("query_id", "vec_id", "rank")


_TERMS = ("demurrage", "charterers", "pilot")
_IN = ", ".join(f"'{t}'" for t in _TERMS)
_TOKENS = r"(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)"
_RANKED = f"(SELECT doc_id, sum(list_sum(list_transform(range(1, tf + 1), lambda i: 1.0 / (i * i))) / 1.644934 * 0.1) / 3 AS score FROM (SELECT doc_id, term, count(*) AS tf FROM {_TOKENS} WHERE term IN ({_IN}) GROUP BY ALL) GROUP BY doc_id)"
_FUSED = lambda lexical: (
    f"""WITH v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS vr FROM embeddings e, {_Q} QUALIFY vr <= 40), x AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS lr FROM {lexical} QUALIFY lr <= 40),
    b AS (SELECT doc_id, vr, lr, coalesce(1.0 / (60 + vr), 0) + coalesce(1.0 / (60 + lr), 0) AS s FROM v FULL JOIN x USING (doc_id))"""
)


@query(
    f"""{_FUSED(_RANKED)} SELECT doc_id, CAST(vr AS INTEGER) AS vector_rank, CAST(lr AS INTEGER) AS lexical_rank, round(s, 9) AS fused_score, CAST(row_number() OVER (ORDER BY round(s, 12) DESC, vr NULLS LAST, lr NULLS LAST, doc_id) AS INTEGER) AS rank FROM b QUALIFY rank <= 20"""
)
def hybrid_rank_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(_postings(s, d), table(s, d, "embeddings"), _first_vector(s, d), list(_TERMS), 20, "hybrid_rank").withColumn("fused_score", F.round("fused_score", 9))


_HITS = f"(SELECT n.query_id, min(CASE WHEN a.label = b.label THEN rank END) AS first_rank, min(a.label) AS label FROM {_NEAR} n JOIN embeddings a ON a.vec_id = n.query_id JOIN embeddings b ON b.vec_id = n.vec_id GROUP BY n.query_id)"


@query(
    f"""SELECT CASE WHEN grouping(label) = 1 THEN 'total' ELSE CAST(label AS VARCHAR) END AS label, CAST(count(*) AS BIGINT) AS total, CAST(count(first_rank) AS BIGINT) AS hits,
    round(avg(CASE WHEN first_rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr FROM {_HITS} GROUP BY ROLLUP (label)"""
)
def recall_by_label(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "embeddings", "vec_id", "label")
    n = _near(s, d).join(labels, "vec_id").withColumnRenamed("label", "found").join(labels.withColumnsRenamed({"vec_id": "query_id"}), "query_id")
    hits = evaluation.first_hits(n, "query_id", "rank", F.col("found") == F.col("label")).join(labels.withColumnRenamed("vec_id", "query_id"), "query_id")
    return evaluation.recall_and_mrr(hits, ["label"]).withColumns({"recall": F.round("recall", 6), "mrr": F.round("mrr", 6)})


_BM25 = rf"""(WITH p AS (SELECT doc_id, term, count(*) AS tf FROM {_TOKENS} WHERE term IN ({_IN}) GROUP BY ALL), z AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS len FROM documents WHERE text IS NOT NULL),
    st AS (SELECT count(*) AS n, avg(len) AS a FROM z), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
    SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM p JOIN z USING (doc_id) JOIN f USING (term), st GROUP BY doc_id)"""


@query(f"SELECT doc_id, round(score, 6) AS score FROM {_BM25} ORDER BY round(score, 9) DESC, doc_id LIMIT 40")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.topk(retrieval.bm25(_postings(s, d), list(_TERMS)), 40).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM {_BM25} JOIN documents USING (doc_id) WHERE source IN ('port_logs', 'claims_letters') ORDER BY round(score, 9) DESC, doc_id LIMIT 40")
def bm25_topk_of_sources(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "doc_id", "source")
    kept = docs.where(F.col("source").isin("port_logs", "claims_letters")).select("doc_id")
    return retrieval.topk(retrieval.bm25(_postings(s, d), list(_TERMS)).join(kept, "doc_id", "left_semi"), 40).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"SELECT doc_id, round(sum(list_sum(list_transform(range(1, tf + 1), lambda i: 1.0 / (i * i))) / 1.644934 * 0.1) / 3, 6) AS score FROM (SELECT doc_id, term, count(*) AS tf FROM {_TOKENS} WHERE term IN ({_IN}) GROUP BY ALL) GROUP BY doc_id ORDER BY 2 DESC, doc_id LIMIT 40"
)
def term_rank_topk(s: SparkSession, d: str) -> DataFrame:
    scored = retrieval.term_rank(_postings(s, d), list(_TERMS)).withColumn("score", F.round("score", 6))
    return retrieval.topk(scored, 40).select("doc_id", "score")


@query(
    f"""WITH v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS vr FROM embeddings e, {_Q} QUALIFY vr <= 40), x AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS lr FROM {_BM25} QUALIFY lr <= 40),
    b AS (SELECT doc_id, vr, lr, coalesce(1.0 / (60 + vr), 0) + coalesce(1.0 / (60 + lr), 0) AS s FROM v FULL JOIN x USING (doc_id))
    SELECT doc_id, CAST(vr AS INTEGER) AS vector_rank, CAST(lr AS INTEGER) AS lexical_rank, round(s, 9) AS fused_score FROM b ORDER BY round(s, 12) DESC, vr NULLS LAST, lr NULLS LAST, doc_id LIMIT 20"""
)
def hybrid_topk(s: SparkSession, d: str) -> DataFrame:
    v = retrieval.vector_topk(table(s, d, "embeddings"), _first_vector(s, d), 40).withColumnRenamed("vec_id", "doc_id").withColumnRenamed("similarity", "score")
    x = retrieval.topk(retrieval.bm25(_postings(s, d), list(_TERMS)), 40)
    return retrieval.fuse(retrieval.topk(v, 40, digits=15), x, 20).select("doc_id", "vector_rank", "lexical_rank", F.round("fused_score", 9).alias("fused_score"))


@query(
    rf"""WITH c AS (SELECT b.doc_id, d.text FROM {_BM25} b JOIN documents d USING (doc_id) ORDER BY round(score, 9) DESC, b.doc_id LIMIT 60)
    SELECT doc_id, round(len(list_intersect(['demurrage', 'rate', 'laytime', 'owners'], list_distinct(regexp_extract_all(lower(substr(text, 1, 24000)), '[\p{{L}}\p{{N}}]+')))) / 4.0, 6) AS score FROM c ORDER BY 2 DESC, doc_id LIMIT 20"""
)
def reranked(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "doc_id", "text")
    pool = retrieval.topk(retrieval.bm25(_postings(s, d), list(_TERMS)), 60).select("doc_id", "rank")
    return retrieval.rerank(docs.join(pool, "doc_id"), "demurrage rate laytime owners", 20).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH h AS (SELECT d.voyage_key, d.doc_id, b.score FROM {_BM25} b JOIN documents d USING (doc_id) WHERE d.voyage_key IS NOT NULL ORDER BY round(score, 9) DESC, doc_id LIMIT 60), r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rk FROM h)
    SELECT voyage_key, doc_id, CAST(rk AS INTEGER) AS rank, CAST(dense_rank() OVER (ORDER BY g) AS INTEGER) AS group_no FROM (SELECT *, min(rk) OVER (PARTITION BY voyage_key) AS g FROM r)"""
)
def context_groups(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "doc_id", "voyage_key")
    hits = retrieval.bm25(_postings(s, d), list(_TERMS)).join(docs.select("doc_id", "voyage_key").where("voyage_key is not null"), "doc_id")
    top = retrieval.topk(hits, 60)
    first = F.min("rank").over(Window.partitionBy("voyage_key"))
    return top.withColumn("g", first).select("voyage_key", "doc_id", "rank", F.dense_rank().over(Window.orderBy("g")).alias("group_no"))  # 60 rows


@query(
    f"""WITH h AS (SELECT d.voyage_key, d.doc_id, d.text, row_number() OVER (ORDER BY round(b.score, 9) DESC, d.doc_id) AS rk FROM {_BM25} b JOIN documents d USING (doc_id) WHERE d.voyage_key IS NOT NULL QUALIFY rk <= 60), r AS (SELECT *, min(rk) OVER (PARTITION BY voyage_key) AS g FROM h), n AS (SELECT *, CAST(dense_rank() OVER (ORDER BY g) AS INTEGER) AS group_no FROM r)
    SELECT group_no, voyage_key, '## ' || voyage_key || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY rk) AS context FROM n GROUP BY group_no, voyage_key"""
)
def context_text(s: SparkSession, d: str) -> DataFrame:
    """The best 60 documents as one text a group, groups by their best document, documents by rank."""
    docs = table(s, d, "documents", "doc_id", "text")
    rows = context_groups(s, d).join(docs, "doc_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])  # 60 rows in all
    return rows.groupBy("group_no", "voyage_key").agg(F.concat(F.lit("## "), F.first("voyage_key"), F.lit("\n\n"), F.array_join(parts, "\n\n")).alias("context"))


@query(
    "SELECT a.vec_id, round(CASE WHEN list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) = 0 THEN 0 ELSE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) END, 9) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def answer_similarity(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings", "vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 9).alias("similarity"))


_SHEET = "coalesce(vessel_name, '') || ': ' || coalesce(commodity, '')"
_LETTER = "CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) ELSE chr(CAST(64 + (n - 1) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) END"


@query(
    f"""WITH h0 AS (SELECT d.voyage_key AS g, CASE WHEN d.lang IS NOT NULL THEN e.email_id END AS m, coalesce(d.source, '') AS st, coalesce(d.text, '') AS t, round(b.score, 6) AS sim, row_number() OVER (ORDER BY round(b.score, 9) DESC, d.doc_id) AS rk FROM {_BM25} b JOIN documents d USING (doc_id) LEFT JOIN (SELECT voyage_key, min(email_id) AS email_id FROM emails GROUP BY 1) e ON e.voyage_key = d.voyage_key WHERE d.voyage_key IS NOT NULL QUALIFY rk <= 30),
    w AS (SELECT g, row_number() OVER (ORDER BY count(*) DESC, g) AS place FROM h0 GROUP BY g), sh AS (SELECT g, s, row_number() OVER (ORDER BY place) AS n FROM w JOIN (SELECT voyage_key AS g, {_SHEET} AS s FROM fixtures) USING (g)),
    b AS (SELECT *, max(sim) OVER p AS best, min(rk) OVER p AS first FROM h0 WINDOW p AS (PARTITION BY g, m)), k AS (SELECT *, dense_rank() OVER (ORDER BY best DESC, first) AS block FROM b),
    lab AS (SELECT g, n FROM sh UNION ALL SELECT g, (SELECT count(*) FROM sh) + row_number() OVER (ORDER BY min(block)) FROM k WHERE g NOT IN (SELECT g FROM sh) GROUP BY g), em AS (SELECT m, 'e' || CAST(row_number() OVER (ORDER BY min(block)) AS VARCHAR) AS e FROM k WHERE m IS NOT NULL GROUP BY m),
    su AS (SELECT email_id AS m, min(subject) AS s FROM emails GROUP BY 1),
    r AS (SELECT row_number() OVER (ORDER BY block, rk) AS no, row_number() OVER (PARTITION BY block ORDER BY rk) = 1 AS head, row_number() OVER (PARTITION BY block ORDER BY rk DESC) = 1 AS tail, {_LETTER} AS l, e, k.m, su.s, st, t, sim FROM k JOIN lab USING (g) LEFT JOIN em ON em.m = k.m LEFT JOIN su ON su.m = k.m),
    o AS (SELECT string_agg(CASE WHEN head THEN '[VOYAGE ' || l || ' | ' || coalesce('EMAIL ' || e, '(no email)') || ']' || chr(10) || coalesce('THREAD SUMMARY: ' || s || chr(10), '') ELSE '' END || 'CHUNK ' || CAST(no AS VARCHAR) || ' [' || st || '] (similarity ' || printf('%.4f', sim) || '): ' || t || CASE WHEN tail THEN chr(10) ELSE '' END, chr(10) ORDER BY no) AS b FROM r),
    i AS (SELECT string_agg('[' || {_LETTER} || ']' || chr(10) || s || chr(10), chr(10) ORDER BY n) AS a FROM sh)
    SELECT {_STRIP("coalesce('=== VOYAGE FIXTURES ===' || chr(10) || nullif(a, '') || chr(10), '') || '=== SOURCES ===' || chr(10) || coalesce(b, '')")} AS context FROM i, o"""
)
def built_context(s: SparkSession, d: str) -> DataFrame:
    """The context of a search: sheets of the groups with most hits, then the hits below their messages."""
    docs = table(s, d, "documents", "doc_id", "text", "voyage_key", "lang", "source").where("voyage_key is not null")
    first = table(s, d, "emails", "voyage_key", "email_id").groupBy("voyage_key").agg(F.min("email_id").alias("email_id"))
    top = retrieval.topk(retrieval.bm25(_postings(s, d), list(_TERMS)).join(docs.select("doc_id"), "doc_id", "left_semi"), 30)
    hits = top.join(docs, "doc_id").join(first, "voyage_key", "left").select(F.col("voyage_key").alias("group"), F.when(F.col("lang").isNotNull(), F.col("email_id")).alias("message"), F.coalesce("source", F.lit("")).alias("source_type"), F.round("score", 6).alias("similarity"), "text", "rank")
    winners = hits.groupBy("group").agg(F.count("*").alias("votes")).select("group", F.row_number().over(Window.orderBy(F.desc("votes"), "group")).alias("place"))  # 30 rows at most
    c = lambda x: F.coalesce(x, F.lit(""))
    sheets = table(s, d, "fixtures", "voyage_key", "vessel_name", "commodity").select(F.col("voyage_key").alias("group"), F.concat(c("vessel_name"), F.lit(": "), c("commodity")).alias("summary"))
    subjects = table(s, d, "emails", "email_id", "subject").groupBy(F.col("email_id").alias("message")).agg(F.min("subject").alias("summary"))
    return contexts.build_context(hits, winners, sheets, subjects)


_VOTES = f"(SELECT query_id, g, expected, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, best) AS rk FROM (SELECT n.query_id, b.label AS g, a.label AS expected, count(*) AS votes, min(n.rank) AS best FROM {_NEAR} n JOIN embeddings a ON a.vec_id = n.query_id JOIN embeddings b ON b.vec_id = n.vec_id WHERE a.label <> 0 GROUP BY ALL))"


@query(
    f"SELECT CASE WHEN grouping(expected) = 1 THEN 'total' ELSE CAST(expected AS VARCHAR) END AS expected, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, round(avg(CAST(hit AS INTEGER)), 6) AS recall FROM (SELECT query_id, expected, coalesce(bool_or(g = expected AND rk <= 2), false) AS hit FROM {_VOTES} GROUP BY ALL) GROUP BY ROLLUP (expected)"
)
def recall_of_votes(s: SparkSession, d: str) -> DataFrame:
    """How often the expected group is among the first two by votes; group 0 is left out."""
    labels = table(s, d, "embeddings", "vec_id", "label")
    n = _near(s, d).join(labels.withColumnRenamed("label", "group"), "vec_id").join(labels.where("label <> 0").withColumnsRenamed({"vec_id": "query_id", "label": "expected"}), "query_id")
    v = n.groupBy("query_id", "group", "expected").agg(F.count("*").alias("votes"), F.min("rank").alias("best"))
    v = v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), "best")))
    return evaluation.vote_recall(v, ["expected"], most=2).withColumn("recall", F.round("recall", 6))


@query(f"SELECT query_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY r) AS labels FROM (SELECT n.query_id, b.label, min(n.rank) AS r FROM {_NEAR} n JOIN embeddings b USING (vec_id) GROUP BY ALL) GROUP BY query_id")
def labels_as_first_seen(s: SparkSession, d: str) -> DataFrame:
    """The distinct labels of each result list in the order in which they appear."""
    n = _near(s, d).join(table(s, d, "embeddings", "vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.min("rank").alias("r"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"].cast("string"))
    return n.groupBy("query_id").agg(F.array_join(seen, ",").alias("labels"))


@query(
    """SELECT source_id, strategy, CASE WHEN strategy = 'summary' THEN source_id ELSE o.email_id END AS email_id FROM (SELECT DISTINCT sha256 AS source_id, 'plain' AS strategy FROM docling UNION ALL SELECT DISTINCT email_id, 'summary' FROM attachments WHERE email_id IS NOT NULL) r
    LEFT JOIN (SELECT sha256, min(email_id) AS email_id FROM attachments WHERE sha256 IS NOT NULL GROUP BY sha256) o ON o.sha256 = r.source_id"""
)
def canonical_sources_by_strategy(s: SparkSession, d: str) -> DataFrame:
    """Chunks of files go to the first message that carries them, summaries bear their message's id already."""
    files = table(s, d, "docling", "sha256").distinct().select(F.col("sha256").alias("source_id"), F.lit("plain").alias("strategy"))
    notes = table(s, d, "attachments", "email_id").where("email_id is not null").distinct().select(F.col("email_id").alias("source_id"), F.lit("summary").alias("strategy"))
    rows = files.unionByName(notes).withColumn("source_type", F.lit("attachment"))
    return evaluation.canonical_source(rows, table(s, d, "attachments", "sha256", "email_id"), "strategy").select("source_id", "strategy", "email_id")
