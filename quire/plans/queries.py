"""Registered queries of the reference operators over whole tables, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, globs, ids, status, text
from ..operators import filters, index, metadata, pages, reports, tree
from ..sources import dumps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


SQL_PATH = "('/' || source || '/' || lang || '/' || doc_id || '.txt')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """The ``documents`` table as an index: doc_id as id, with a path made from its source, language and id."""
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, d, "documents").withColumn("path", path)


def long(c):
    return c.cast("bigint")


# --- identity


@query("SELECT doc_id, sha256(text) AS digest, lower(sha256(text)) AS id FROM documents")
def content_digest(spark, d):
    t = docs(spark, d).select("doc_id", ids.digest(F.col("text")).alias("digest"))
    return t.withColumn("id", ids.content_id(F.col("digest")))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def content_digest_short(spark, d):
    return docs(spark, d).select("doc_id", ids.digest(F.col("text"), "MD5").alias("md5"), ids.digest(F.col("text"), "SHA-1").alias("sha1"))


@query("SELECT doc_id, sha256('project-a' || text) AS digest FROM documents")
def salted_digest(spark, d):
    return docs(spark, d).select("doc_id", ids.salted_digest(F.col("text"), "project-a").alias("digest"))


@query(f"SELECT doc_id, sha256({SQL_PATH}) AS id FROM documents")
def path_digest(spark, d):
    return docs(spark, d).select("doc_id", ids.path_digest_id(F.col("path")).alias("id"))


@query(f"SELECT doc_id, {SQL_PATH} AS id FROM documents")
def path_identity(spark, d):
    return docs(spark, d).select("doc_id", ids.path_id(F.col("path")).alias("id"))


@query("SELECT conv_id, turn, sha256(concat_ws('', sha256(text), sha256(CAST(conv_id AS VARCHAR)), CAST(turn AS VARCHAR), role)) AS id FROM conversations")
def embed_id_l1(spark, d):
    c = read(spark, d, "conversations")
    parent = ids.digest(F.col("conv_id").cast("string"))
    return c.select("conv_id", "turn", ids.embed_id(ids.digest(F.col("text")), parent, F.col("turn").cast("string"), F.col("role")).alias("id"))


def _hierarchy(spark, d) -> DataFrame:
    """Regions, nations, customers and orders as one tree of nodes."""
    n = lambda name, key, parent, label: read(spark, d, name).select(F.concat(F.lit(name[0]), key).alias("key"), (F.concat(F.lit(parent[0]), parent[1]) if parent else F.lit(None).cast("string")).alias("parent_key"), label.alias("name"))
    s = lambda c: F.col(c).cast("string")
    nodes = n("region", s("r_regionkey"), None, F.col("r_name")).unionAll(n("nation", s("n_nationkey"), ("r", s("n_regionkey")), F.col("n_name"))).unionAll(n("customer", s("c_custkey"), ("n", s("c_nationkey")), F.col("c_name"))).unionAll(n("orders", s("o_orderkey"), ("c", s("o_custkey")), F.col("o_orderstatus")))
    return nodes.withColumns({"digest": ids.digest(F.concat("key", "name")), "relation": F.col("key")})


_NODES = """nodes AS (
    SELECT 'r' || r_regionkey AS key, CAST(NULL AS VARCHAR) AS parent_key, r_name AS name FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
    UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderstatus FROM orders)"""


@query(f"""WITH RECURSIVE {_NODES}, t AS (
    SELECT key, sha256(key || name) AS id, sha256(key || name) AS root_id, 0 AS level FROM nodes WHERE parent_key IS NULL
    UNION ALL SELECT n.key, sha256(concat_ws('', sha256(n.key || n.name), t.id, n.key, n.name)), t.root_id, t.level + 1 FROM t JOIN nodes n ON n.parent_key = t.key)
    SELECT key, id, root_id, CAST(level AS BIGINT) AS level FROM t""")
def embed_id_recursive(spark, d):
    return tree.recursive_ids(_hierarchy(spark, d)).withColumn("level", long(F.col("level")))


@query(f"""WITH RECURSIVE {_NODES}, t AS (
    SELECT key, key AS root_id, 0 AS level, key AS trail FROM nodes WHERE parent_key IS NULL
    UNION ALL SELECT n.key, t.root_id, t.level + 1, t.trail || '>' || n.key FROM t JOIN nodes n ON n.parent_key = t.key)
    SELECT key AS id, root_id, CAST(level AS BIGINT) AS level, trail FROM t""")
def tree_levels(spark, d):
    return tree.levels(_hierarchy(spark, d), "key", "parent_key").select("id", "root_id", long(F.col("level")).alias("level"), F.array_join("trail", ">").alias("trail"))


@query(f"""WITH RECURSIVE {_NODES}, t AS (
    SELECT key, '' AS path FROM nodes WHERE parent_key IS NULL
    UNION ALL SELECT n.key, t.path || '/' || n.name FROM t JOIN nodes n ON n.parent_key = t.key)
    SELECT key AS id, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM t""")
def folder_paths(spark, d):
    return tree.folder_paths(_hierarchy(spark, d), "key", "parent_key")


@query(f"""WITH {_NODES} SELECT c.key, p.name AS parent_name FROM nodes c JOIN nodes p ON c.parent_key = p.key""")
def child_to_parent(spark, d):
    n = _hierarchy(spark, d)
    return n.select("key", "parent_key").join(n.select(F.col("key").alias("parent_key"), F.col("name").alias("parent_name")), "parent_key").select("key", "parent_name")


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'untitled_' || conv_id || '_' || (row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) - 1) ELSE role END AS name FROM conversations""")
def untitled_names(spark, d):
    c = read(spark, d, "conversations").withColumn("name", F.when(F.col("role") != "assistant", F.col("role")))
    return ids.untitled_names(c, "conv_id", "turn").select("conv_id", "turn", "name")


@query("SELECT conv_id, turn, 'untitled_' || row_number() OVER (ORDER BY conv_id, turn) AS name FROM conversations")
def untitled_names_global(spark, d):
    return ids.legacy_untitled_names(read(spark, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])


@query("WITH t AS (SELECT doc_id, sha256(text) AS id FROM documents) SELECT doc_id, substr(id, 1, 2) || '/' || substr(id, 3, 2) || '/' || id || '/raw' AS place FROM t")
def artifact_path(spark, d):
    return docs(spark, d).select("doc_id", ids.artifact_path(ids.digest(F.col("text"))).alias("place"))


@query("WITH t AS (SELECT doc_id, sha256(text) AS id FROM documents) SELECT doc_id, left(id, 8) || '...' || right(id, 8) AS short FROM t")
def id_shorten(spark, d):
    return docs(spark, d).select("doc_id", ids.shorten(ids.digest(F.col("text")), 8).alias("short"))


@query(f"""WITH t AS (SELECT doc_id, {SQL_PATH} AS old FROM documents), n AS (SELECT doc_id, old, regexp_replace(old, '^/src', '/vol') AS path FROM t)
    SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS parent_path, upper(sha256(path)) AS id, upper(sha256(old)) AS old_id FROM n WHERE path <> old""")
def rehash_paths(spark, d):
    t = docs(spark, d).withColumn("id", F.upper(ids.digest(F.col("path"))))
    return index.rehash(t, "^/src", "/vol").select("doc_id", "path", "parent_path", "id", "old_id")


@query("SELECT r_regionkey, CAST(CASE WHEN v IS NULL THEN NULL ELSE v END AS BOOLEAN) AS untranslated FROM (SELECT r_regionkey, r_regionkey <= 3 AS v FROM region)")
def version_compat(spark, d):
    version = F.concat(F.lit("Parser 3.2."), F.col("r_regionkey").cast("string"))
    return read(spark, d, "region").select("r_regionkey", ids.digests_untranslated(version).alias("untranslated"))


# --- sets, duplicates, merges


@query("SELECT digest, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS digest FROM documents) GROUP BY digest")
def dedupe_by_digest(spark, d):
    return index.first_of_each(docs(spark, d).select("doc_id", ids.digest(F.col("text")).alias("digest")), ["digest"], ["doc_id"]).select("digest", "doc_id")


@query('SELECT count(text) - count(DISTINCT sha256(text)) AS removed, count(DISTINCT sha256(text)) AS "left" FROM documents')
def duplicate_count(spark, d):
    return index.duplicates_removed(docs(spark, d).select(ids.digest(F.col("text")).alias("digest")), "digest")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE lang <> 'fr' OR n > 2")
def remove_n(spark, d):
    return index.remove_n(docs(spark, d).select("doc_id", "lang"), "lang", "fr", 2, ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'fr'")
def remove_all(spark, d):
    return index.remove_n(docs(spark, d).select("doc_id", "lang"), "lang", "fr", 0, ["doc_id"])


@query(f"""SELECT sha256(text) AS id, array_to_string(list_sort(list(DISTINCT {SQL_PATH})), '|') AS paths,
    array_to_string(list_sort(list(DISTINCT '/' || source || '/' || lang)), '|') AS parent_paths, count(*) AS n_seen FROM documents GROUP BY 1""")
def merge_paths(spark, d):
    m = index.merge_paths(docs(spark, d).select(ids.digest(F.col("text")).alias("id"), "path"))
    return m.select("id", F.array_join("paths", "|").alias("paths"), F.array_join("parent_paths", "|").alias("parent_paths"), "n_seen")


@query("SELECT doc_id, 'yes' AS metadata_labelled FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def tag_intersection(spark, d):
    return index.intersection(docs(spark, d), read(spark, d, "labels"), {"metadata_labelled": "yes"}, "doc_id")


@query("SELECT doc_id, 'no' AS metadata_labelled FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def tag_complement(spark, d):
    return index.complement(docs(spark, d), read(spark, d, "labels"), {"metadata_labelled": "no"}, "doc_id")


@query("SELECT doc_id, 'set-a' AS tag_batch FROM documents WHERE lang = 'en'")
def tag_constant(spark, d):
    return index.tag(docs(spark, d), {"tag_batch": "set-a"}, "doc_id", F.col("lang") == "en")


@query("""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.lang, o.lang) AS lang, CAST(n.quality AS VARCHAR) AS quality FROM (SELECT doc_id, lang FROM documents) o
    FULL JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'xx' END AS lang, quality FROM labels) n ON o.doc_id = n.doc_id""")
def merge_atomic(spark, d):
    new = read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "xx").alias("lang"), F.col("quality").cast("string").alias("quality"))
    return index.merge_into(docs(spark, d).select("doc_id", "lang"), new, "doc_id")


@query("""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.lang ELSE o.lang END AS lang, CAST(n.quality AS VARCHAR) AS quality FROM (SELECT doc_id, lang FROM documents) o
    FULL JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'xx' END AS lang, quality FROM labels) n ON o.doc_id = n.doc_id""")
def merge_replace(spark, d):
    new = read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "xx").alias("lang"), F.col("quality").cast("string").alias("quality"))
    return index.merge_into(docs(spark, d).select("doc_id", "lang"), new, "doc_id", atomic=False)


@query("""SELECT doc_id AS id, 'ERROR:SCHEMA-INDEX-MISMATCH,stringValue=' || n_chars AS text_bad, CAST(n_chars AS VARCHAR) AS text_copy, lang AS set_b FROM documents""")
def copy_fields(spark, d):
    t = docs(spark, d).select(F.col("doc_id").alias("id"), F.concat(F.lit(index.MISMATCH), F.col("n_chars").cast("string")).alias("text_bad"), F.col("lang").alias("set_a"))
    return t.select("id", "text_bad").join(index.copy_fields(t, {"text_bad": "text_copy", "set_a": "set_b"}), "id")


@query("SELECT doc_id, source FROM documents WHERE NOT (lang = 'de') AND source <> 'src3'")
def index_delete(spark, d):
    left = index.delete(docs(spark, d), F.col("lang") == "de")
    return index.delete(left, F.col("source") == "src3").select("doc_id", "source")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)")
def index_delete_ids(spark, d):
    return index.delete(docs(spark, d).select("doc_id"), ids=read(spark, d, "labels").where("quality = 0"), ident="doc_id")


@query("""WITH old AS (SELECT 'c' || conv_id || '-' || turn AS id, 'c' || conv_id || '-0' AS root_id, turn AS level, role FROM conversations),
    new AS (SELECT id, root_id, level, 'new' AS role FROM old WHERE level = 0 AND id IN (SELECT root_id FROM old GROUP BY root_id HAVING count(*) > 4))
    SELECT id, level, role FROM old WHERE (level = 0 AND id NOT IN (SELECT id FROM new)) OR (level >= 1 AND root_id NOT IN (SELECT id FROM new))
    UNION ALL SELECT id, level, role FROM new""")
def replace_children(spark, d):
    c = read(spark, d, "conversations")
    of = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn)
    old = c.select(of(F.col("turn").cast("string")).alias("id"), of(F.lit("0")).alias("root_id"), F.col("turn").alias("level"), "role")
    long_ones = old.groupBy("root_id").count().where("count > 4").select(F.col("root_id").alias("id"))
    new = old.where("level = 0").join(long_ones, "id", "left_semi").withColumn("role", F.lit("new"))
    return index.replace_children(old, new).select("id", "level", "role")


@query("SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def offset_page(spark, d):
    return index.page(docs(spark, d).select("doc_id", "source", "lang"), ["doc_id"], 50, 100)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 2000 AND lang = 'en'")
def index_scan(spark, d):
    return index.scan(docs(spark, d), "n_chars > 2000 AND lang = 'en'", ["doc_id", "n_*"])


# --- reports

_CODE = "CASE WHEN toxic = 1 THEN 11 WHEN quality = 1 THEN 0 ELSE 4 END"


def _reports(spark, d) -> DataFrame:
    return read(spark, d, "labels").select("doc_id", F.expr(_CODE).alias("code"))


@query(f"SELECT doc_id, {SQL_PATH} AS path FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND {_CODE} IN (0, 10, 11))")
def resume_skip(spark, d):
    return reports.to_do(docs(spark, d).select("doc_id", "path"), _reports(spark, d), "doc_id")


@query(f"SELECT l.doc_id, {_CODE} AS code FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def clean_report(spark, d):
    return reports.clean(_reports(spark, d), docs(spark, d).where("lang = 'en'"), "doc_id")


@query(f"SELECT doc_id, {_CODE} AS code FROM labels WHERE {_CODE} = 4")
def report_status(spark, d):
    return reports.with_status(_reports(spark, d), 4)


@query(f"""SELECT code, CAST(n AS BIGINT) AS n, CASE code WHEN 0 THEN 'SUCCESS' WHEN 4 THEN 'FAILURE_NOT_PARSED' WHEN 11 THEN 'FAILURE_TIMEOUT' END AS status FROM (SELECT {_CODE} AS code, count(*) AS n FROM labels GROUP BY 1)""")
def report_histogram(spark, d):
    return reports.histogram(_reports(spark, d))


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events GROUP BY user_id")
def report_latest(spark, d):
    return reports.latest(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ("ts", "event_id")).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 11 WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 9 ELSE 8 END AS code,
    CASE event_type WHEN 'view' THEN 'FAILURE_TIMEOUT' WHEN 'click' THEN 'FAILURE_NOT_FOUND' WHEN 'purchase' THEN 'FAILURE_NOT_DECRYPTED' WHEN 'signup' THEN 'FAILURE_NOT_SAVED' ELSE 'FAILURE_UNKNOWN' END AS status FROM events""")
def status_classify(spark, d):
    e = read(spark, d, "events")
    kind = F.col("event_type")
    exception = F.when(kind == "view", "java.util.concurrent.TimeoutException").when(kind == "click", "java.nio.file.NoSuchFileException").when(kind == "purchase", "EncryptedDocumentException").when(kind == "signup", "java.io.IOException").otherwise("IllegalStateException")
    code = status.classify(exception, F.lit(None).cast("string"), F.when(kind == "signup", "save").otherwise("parse"))
    return e.select("event_id", code.alias("code"), status.status_name(code).alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 9 IN (0, 1, 2, 3, 4, 8) THEN CAST(event_id % 9 AS INTEGER) ELSE -1 END AS code FROM events")
def status_parse(spark, d):
    return read(spark, d, "events").select("event_id", F.coalesce(status.parse_status((F.col("event_id") % 9).cast("string")), F.lit(-1)).alias("code"))


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS embeds, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS units FROM conversations GROUP BY conv_id""")
def progress_counters(spark, d):
    c = read(spark, d, "conversations")
    events = c.select(F.col("conv_id").alias("path"), F.lit("embeds").alias("kind"), F.lit(1).alias("amount")).unionAll(c.where("role = 'user'").select("conv_id", F.lit("units"), F.lit(1)))
    return reports.progress(events).select(F.col("path").alias("conv_id"), "embeds", "units")


@query("""WITH p AS (SELECT o_orderkey, CAST(count(*) AS BIGINT) AS embeds, CAST(sum(l_quantity) AS BIGINT) AS expected, CAST(sum(l_linenumber) AS BIGINT) AS units FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT o_orderkey, embeds || '/~' || greatest(embeds, CAST(floor(CAST(embeds * expected AS DOUBLE) / units + 0.5) AS BIGINT)) || ' embeds (~' || least(100, (units * 100) // expected) || '%)' AS line FROM p""")
def progress_estimate(spark, d):
    joined = read(spark, d, "orders").select("o_orderkey").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    p = joined.groupBy("o_orderkey").agg(F.count("*").alias("embeds"), long(F.sum("l_quantity")).alias("expected"), long(F.sum("l_linenumber")).alias("units"))
    return p.select("o_orderkey", text.progress_line(F.col("embeds"), F.col("expected"), F.col("units")).alias("line"))


@query("SELECT to_json(list(path ORDER BY path)) AS json FROM (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)".replace("to_json(list(path ORDER BY path))", "CAST(to_json(list(path ORDER BY path)) AS VARCHAR)"))
def queue_dump(spark, d):
    return dumps.queue_json(docs(spark, d))


@query(f"SELECT '{{' || string_agg('\"' || doc_id || '\":' || {_CODE}, ',' ORDER BY CAST(doc_id AS VARCHAR)) || '}}' AS json FROM labels")
def report_dump(spark, d):
    return dumps.report_json(_reports(spark, d).select(F.col("doc_id").cast("string").alias("path"), "code"))


# --- metadata and scalar functions


@query(f"""SELECT doc_id AS id, {SQL_PATH} AS path, '/' || source || '/' || lang AS parent_path, 'text/' || lang AS base_type, 'a b' AS tag_name, lang AS tag_lang FROM documents""")
def structural_fields(spark, d):
    t = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("root_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("level"), "path", F.concat(F.lit("Text/"), F.upper("lang"), F.lit("; charset=UTF-8")).alias("content_type"), F.col("text").alias("content"), "lang")
    s = metadata.structural(t.drop("lang")).select("id", "path", "parent_path", "base_type")
    tagged = metadata.with_tags(s, metadata.parse_tags(["name:a b"]))
    return tagged.join(t.select("id", F.col("lang").alias("tag_lang")), "id")


@query("""WITH k AS (SELECT event_id, unnest(json_keys(props)) AS k, event_type FROM events)
    SELECT event_id, 'tika_metadata_' || lower(regexp_replace(event_type || ':' || k, '[^A-Za-z0-9_]', '_', 'g')) AS field FROM k""")
def field_names(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", F.explode(F.json_object_keys("props")).alias("k"))
    return e.select("event_id", text.field_name(F.concat("event_type", F.lit(":"), "k")).alias("field"))


@query("""SELECT p_partkey, 'tika_metadata_' || lower(replace(p_type, ' ', '_')) AS field FROM part WHERE NOT regexp_matches('tika_metadata_' || lower(replace(p_type, ' ', '_')), '^(?:[^/]*brass|tika_metadata_std[^/]*)$')""")
def block_list(spark, d):
    field = text.field_name(F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", field.alias("field")).where(~filters.blocked_field(F.col("field"), ["*brass", "tika_metadata_std*"]))


@query("""WITH v AS (SELECT o_custkey AS id, o_orderpriority AS name, o_orderkey, o_orderstatus AS v FROM orders),
    n AS (SELECT id, name, list(v ORDER BY o_orderkey) AS vs FROM v GROUP BY id, name),
    m AS (SELECT id, 'tika_metadata_' || lower(regexp_replace(substr(name, 3), '[^A-Za-z0-9_]', '_', 'g')) AS field, name, vs FROM n)
    SELECT id, field, array_to_string(flatten(list(vs ORDER BY name)), ',') AS vals FROM m GROUP BY id, field""")
def metadata_merge(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), "o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("v"))
    pairs = o.select("id", F.substring("o_orderpriority", 3, 99).alias("name"), F.transform("v", lambda x: x["o_orderstatus"]).alias("values"))
    return metadata.normalise(pairs).select("id", "field", F.array_join("values", ",").alias("vals"))


_ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"


@query(f"SELECT o_orderkey, {_ISO} AS a, {_ISO} AS b, {_ISO} AS c, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS d FROM orders")
def date_compact(spark, d):
    o = F.col("o_orderdate")
    back = lambda pattern, suffix="": dates.format_instant(dates.parse_compact(F.concat(F.date_format(o, pattern), F.lit(suffix))))
    return read(spark, d, "orders").select("o_orderkey", back("yyyyMMddHHmmss", "000").alias("a"), back("yyyyMMddHHmmss").alias("b"), back("yyyyMMddHHmm").alias("c"), back("yyyyMMdd").alias("d"))


@query(f"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS s FROM events")
def date_epoch(spark, d):
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("ts")).cast("timestamp")).cast("string")
    return read(spark, d, "events").select("event_id", dates.format_instant(dates.parse_epoch(seconds)).alias("s"))


@query(f"SELECT o_orderkey, {_ISO} AS ctime, {_ISO} AS rfc FROM orders")
def date_ctime(spark, d):
    o = F.col("o_orderdate")
    ctime = F.concat(F.lit("Mon "), F.date_format(o, "MMM"), F.lit("  "), F.date_format(o, "d HH:mm:ss yyyy"))
    rfc = F.concat(F.lit("Tue, "), F.date_format(o, "d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return read(spark, d, "orders").select("o_orderkey", dates.format_instant(dates.parse_fallback(ctime)).alias("ctime"), dates.format_instant(dates.parse_fallback(rfc)).alias("rfc"))


@query(f"SELECT o_orderkey, {_ISO} AS iso, strftime(o_orderdate, '%Y-%m-%dT12:00:00Z') AS noon, CAST(NULL AS VARCHAR) AS year FROM orders")
def date_iso_gate(spark, d):
    o = F.col("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", dates.normalise_date(F.date_format(o, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), dates.normalise_date(F.date_format(o, "yyyy-MM-dd")).alias("noon"), dates.format_instant(dates.parse_instant(F.date_format(o, "yyyy"))).alias("year"))


@query("""SELECT o_custkey, CASE WHEN bool_and(o_orderstatus <> 'P') THEN string_agg(strftime(o_orderdate, '%Y-%m-%dT00:00:00Z'), ',' ORDER BY o_orderkey)
    ELSE string_agg(CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'pending' END, ',' ORDER BY o_orderkey) END AS dates FROM orders GROUP BY o_custkey""")
def multi_date_array(spark, d):
    value = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("pending")
    g = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", value.alias("v")))).alias("g")).select("o_custkey", F.transform("g", lambda x: x["v"]).alias("v"))
    return g.select("o_custkey", F.coalesce(F.array_join(dates.multi_date(F.col("v")), ","), F.array_join("v", ",")).alias("dates"))


_Q = "CAST(l_quantity AS BIGINT)"


@query(f"""SELECT l_orderkey, l_linenumber, {_Q} * CASE l_returnflag WHEN 'A' THEN 60000 WHEN 'N' THEN 3600000 ELSE 86400000 END AS ms,
    CASE l_returnflag WHEN 'A' THEN {_Q} || 'm' WHEN 'N' THEN CASE WHEN {_Q} >= 24 THEN {_Q} // 24 || 'd' ELSE {_Q} || 'h' END ELSE {_Q} || 'd' END AS back FROM lineitem""")
def human_duration(spark, d):
    unit = F.when(F.col("l_returnflag") == "A", "m").when(F.col("l_returnflag") == "N", "h").otherwise("d")
    ms = text.parse_duration(F.concat(long(F.col("l_quantity")).cast("string"), unit))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ms.alias("ms")).withColumn("back", text.format_duration(F.col("ms")))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'true' WHEN 'MACHINERY' THEN 'false' END AS flag FROM customer")
def bool_option(spark, d):
    word = F.when(F.col("c_mktsegment") == "BUILDING", "Yes").when(F.col("c_mktsegment") == "MACHINERY", "off").otherwise("maybe")
    return read(spark, d, "customer").select("c_custkey", text.parse_boolean(word).cast("string").alias("flag"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({SQL_PATH}, '^/src1[^/]*/(en|fr)/[^/]*[05]\\.txt$')")
def glob_include(spark, d):
    return docs(spark, d).where(filters.include(F.col("path"), ["/src1*/{en,fr}/*[05].txt"])).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT regexp_matches({SQL_PATH}, '^/src[0-9]/de/') AND NOT regexp_matches({SQL_PATH}, '^/.*/7.*\\.txt$')")
def glob_exclude(spark, d):
    return docs(spark, d).where(~filters.exclude(F.col("path"), ["/src?/de", "/**/7*.txt"])).select("doc_id")


_NAMED = "CASE lang WHEN 'en' THEN '/a/' || doc_id || '.txt' WHEN 'fr' THEN '/a/.' || doc_id WHEN 'de' THEN '/Thumbs.db' ELSE '/a/._' || doc_id END"


@query("SELECT doc_id, lang IN ('fr', 'es') AS is_hidden, lang IN ('de', 'es') AS is_system FROM documents")
def hidden_system(spark, d):
    path = F.expr(_NAMED.replace("doc_id", "cast(doc_id as string)"))
    return docs(spark, d).select("doc_id", filters.hidden(path).alias("is_hidden"), filters.system(path).alias("is_system"))


@query(f"""WITH RECURSIVE {_NODES}, t AS (
    SELECT key, parent_key, 0 AS level FROM nodes WHERE parent_key IS NULL UNION ALL SELECT n.key, n.parent_key, t.level + 1 FROM t JOIN nodes n ON n.parent_key = t.key)
    SELECT parent_key, CAST(count(*) AS BIGINT) AS skipped_depth, CAST(0 AS BIGINT) AS skipped_size FROM t WHERE level > 2 GROUP BY parent_key""")
def depth_guard(spark, d):
    h = _hierarchy(spark, d)
    placed = tree.levels(h, "key", "parent_key").join(h.select(F.col("key").alias("id"), F.col("parent_key")), "id")
    return tree.skip_counts(tree.guard(placed.withColumn("declared_length", F.lit(None).cast("string")), 2), "parent_key")


@query("SELECT source, CAST(0 AS BIGINT) AS skipped_depth, CAST(count(*) AS BIGINT) AS skipped_size FROM documents WHERE n_chars > 3000 GROUP BY source")
def size_guard(spark, d):
    t = docs(spark, d).select("source", F.lit(1).alias("level"), F.concat(F.lit(" "), F.col("n_chars").cast("string")).alias("declared_length"))
    return tree.skip_counts(tree.guard(t, 20, 3000), "source")


@query("""SELECT o_orderkey, CASE WHEN p.c_custkey IS NULL THEN '/[recovered]' ELSE '/' || p.c_mktsegment END AS path FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) p ON p.c_custkey = o.o_custkey
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def orphan_recovery(spark, d):
    descriptors = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    emitted = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    folders = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("/"), "c_mktsegment").alias("path"))
    return tree.recover_orphans(descriptors, emitted, folders, "o_orderkey", "o_custkey").select("o_orderkey", "path")


@query("""WITH e AS (SELECT l_orderkey AS k, CAST(max(l_linenumber) AS BIGINT) AS expected FROM lineitem GROUP BY 1), m AS (SELECT l_orderkey AS k, CAST(count(*) AS BIGINT) AS emitted FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT e.k, expected, coalesce(emitted, 0) AS emitted, greatest(0, expected - coalesce(emitted, 0)) AS failed, CASE WHEN expected <= coalesce(emitted, 0) THEN 'complete' ELSE 'incomplete' END AS state FROM e LEFT JOIN m ON e.k = m.k""")
def loss_reconcile(spark, d):
    l = read(spark, d, "lineitem")
    expected = l.groupBy(F.col("l_orderkey").alias("k")).agg(long(F.max("l_linenumber")).alias("expected"))
    return tree.reconcile(expected, l.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k")), "k")


@query("""SELECT l_suppkey, CAST(count(*) AS BIGINT) AS attachments, CAST(count(*) FILTER (l_returnflag <> 'N') AS BIGINT) AS broken, CAST(count(*) FILTER (l_returnflag <> 'N' AND l_tax > 0.04) AS BIGINT) AS recovered,
    CAST(count(*) FILTER (l_returnflag <> 'N' AND l_tax <= 0.04 AND l_linestatus <> 'O') AS BIGINT) AS unrecovered, CAST(count(*) FILTER (l_returnflag <> 'N' AND l_tax <= 0.04 AND l_linestatus = 'O') AS BIGINT) AS encrypted FROM lineitem GROUP BY l_suppkey""")
def attachment_losses(spark, d):
    state = F.when(F.col("l_returnflag") == "A", "truncated").when(F.col("l_returnflag") == "R", "unreadable").otherwise("whole")
    return tree.attachment_losses(read(spark, d, "lineitem").select("l_suppkey", state.alias("state"), (F.col("l_tax") > 0.04).alias("recovered"), (F.col("l_linestatus") == "O").alias("encrypted")), "l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n = 1""")
def emitted_once(spark, d):
    e = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_orderkey", "l_linenumber").alias("attempt"), (F.col("l_returnflag") != "R").alias("ok"))
    return tree.emitted_once(e, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def concat_embeds(spark, d):
    return tree.concatenate(read(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, text FROM conversations WHERE turn = 0")
def ignore_embeds(spark, d):
    return read(spark, d, "conversations").where("turn = 0").select("conv_id", "text")


@query("SELECT conv_id, CAST(count(*) - 1 AS BIGINT) AS n_children FROM conversations GROUP BY conv_id")
def child_count(spark, d):
    return tree.child_counts(read(spark, d, "conversations").withColumn("level", F.col("turn")), "conv_id")


@query("""WITH t AS (SELECT *, count(*) OVER (PARTITION BY text0) > 1 AS dup FROM (SELECT conv_id, turn, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS text0 FROM conversations))
    SELECT conv_id, turn FROM conversations WHERE turn = 0 OR conv_id NOT IN (SELECT a.conv_id FROM conversations a JOIN (SELECT text, min(conv_id) AS k FROM conversations WHERE turn = 0 GROUP BY text) b ON a.text = b.text AND a.turn = 0 AND a.conv_id > b.k)""")
def duplicate_roots(spark, d):
    c = read(spark, d, "conversations")
    first = Window.partitionBy("text").orderBy("conv_id")
    roots = c.where("turn = 0").select("conv_id", (F.row_number().over(first) > 1).alias("is_duplicate"))
    t = c.join(roots, "conv_id").select(F.col("conv_id").alias("id"), F.col("conv_id").alias("root_id"), F.col("turn").alias("level"), F.col("is_duplicate"))
    return tree.without_duplicate_roots(t).select(F.col("id").alias("conv_id"), F.col("level").alias("turn"))


@query("""WITH p AS (SELECT doc_id, i - 1 AS page_no, s[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
    SELECT doc_id, page_no, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS "end" FROM p""")
def page_offsets(spark, d):
    p = pages.offsets(pages.split(docs(spark, d), "doc_id", "text", "\n"), "doc_id")
    return p.select("doc_id", long(F.col("page_no")).alias("page_no"), "start", "end")


@query("""WITH p AS (SELECT doc_id, i - 1 AS page_no, s[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) SELECT doc_id, page_no, md5(text) AS page FROM p""")
def page_text(spark, d):
    t = docs(spark, d)
    p = pages.offsets(pages.split(t, "doc_id", "text", "\n"), "doc_id").select("doc_id", "page_no", "start", "end")
    cut = F.md5(pages.page_text(F.col("text"), F.col("start"), F.col("end")))
    return p.join(t.select("doc_id", "text"), "doc_id").select("doc_id", long(F.col("page_no")).alias("page_no"), cut.alias("page"))


@query("SELECT doc_id, sha256(text) AS digest, CAST(length(text) AS BIGINT) AS result FROM documents")
def ocr_cache_join(spark, d):
    keys = docs(spark, d).select("doc_id", ids.digest(F.col("text")).alias("digest"), F.length("text").cast("bigint").alias("size"))
    cache = keys.where(F.col("size") < 1000).groupBy("digest").agg(F.max("size").alias("result"))
    sizes = keys.groupBy("digest").agg(F.max("size").alias("result"))
    found, _ = pages.cached(keys, cache, lambda missing: sizes.join(missing, "digest", "left_semi"), "digest")
    return found.select("doc_id", "digest", "result")


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '… (' || (length(text) - 100) || ' other characters)' ELSE text END AS shown FROM documents")
def preview(spark, d):
    return docs(spark, d).select("doc_id", text.preview(F.col("text")).alias("shown"))


@query("""SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""")
def html_escape(spark, d):
    return read(spark, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query("SELECT page_id, 'data:text/html,' || replace(replace(url_encode(html), '%20', '+'), '%2A', '*') AS uri FROM pages".replace("url_encode(html)", "replace(url_encode(html), '~', '%7E')"))
def data_uri_text(spark, d):
    return read(spark, d, "pages").select("page_id", text.data_uri(F.lit("text/html"), F.col("html")).alias("uri"))


@query("SELECT page_id, 'data:image/png;base64,' || to_base64(CAST(html AS BLOB)) AS uri FROM (SELECT page_id, encode(html) AS html FROM pages)")
def data_uri_binary(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_replace(text.data_uri(F.lit("image/png"), F.col("html")), "[\r\n]", "").alias("uri"))


@query("SELECT conv_id, turn, replace(replace('see [[user]] and [[assistant]] or [[none]]', '[[user]]', CAST(turn AS VARCHAR)), '[[assistant]]', role) AS out FROM conversations")
def token_replace(spark, d):
    known = F.create_map(F.lit("user"), F.col("turn").cast("string"), F.lit("assistant"), F.col("role"))
    return read(spark, d, "conversations").select("conv_id", "turn", text.replace_tokens(F.lit("see [[user]] and [[assistant]] or [[none]]"), "[[", "]]", known).alias("out"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'image/png' ELSE 'text/plain' END AS ct, p_size > 25 AND p_retailprice >= 1000 AS eligible FROM part")
def ocr_eligible(spark, d):
    ct = F.when(F.col("p_size") > 25, "image/ocr-png").otherwise("text/plain")
    return read(spark, d, "part").select("p_partkey", text.restore_ocr_type(ct).alias("ct"), filters.ocr_eligible(ct, F.lit(None).cast("string"), F.floor("p_retailprice").cast("string"), 1000).alias("eligible"))


@query("SELECT event_id FROM events WHERE NOT (event_type = 'view' AND value < 50)")
def log_noise(spark, d):
    e = read(spark, d, "events")
    message = F.when(F.col("event_type") == "view", "Using fallback font Arial").otherwise("parsed")
    return e.where(~filters.log_noise(F.lit("org.apache.pdfbox.Font"), F.when(F.col("value") < 50, "WARN").otherwise("ERROR"), message)).select("event_id")


# --- parsing (no SQL can parse; tests hold these against literal expectations)


@query()
def html_text(spark, d):
    """Text, title and error of every page."""
    from ..sources.parsers import parse

    p = parse(read(spark, d, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content")), content="content")
    return p.select("path", "content_type", "content", F.element_at(F.try_element_at("metadata", F.lit("title")), 1).alias("title"), "error")


@query()
def html_serialize(spark, d):
    """Every page as clean HTML5."""
    from ..sources.parsers import Options, parse

    p = parse(read(spark, d, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content")), Options(output="html"), content="content")
    return p.select("path", "content")


@query()
def mail_tree(spark, d):
    """Every conversation as a message whose turns are attachments, parsed into a tree."""
    from ..sources.parsers import parse

    part = F.concat(F.lit('--x\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Disposition: attachment; filename="'), F.col("turn").cast("string"), F.lit('.txt"\r\n\r\n'), F.col("text"), F.lit("\r\n"))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("p"))
    mail = F.concat(F.lit("From: a@b.example\r\nSubject: conversation "), F.col("conv_id").cast("string"), F.lit('\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="x"\r\n\r\n'), F.array_join(F.transform("p", lambda x: x["part"]), ""), F.lit("--x--\r\n"))
    p = parse(c.select(F.concat(F.lit("/mail/"), F.col("conv_id").cast("string"), F.lit(".eml")).alias("path"), mail.alias("content")), content="content")
    return p.select("path", "id", "parent_id", "level", "ordinal", "name", "content_type", "content")


@query()
def block_reassembly(spark, d):
    """Every conversation's turns as numbered blocks, joined again."""
    from ..operators.blocks import reassemble

    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("block"), F.col("text").cast("binary").alias("data"))
    length = c.groupBy("id").agg(F.sum(F.octet_length("data")).alias("length"))
    return reassemble(c, length).select("id", F.md5("content").alias("digest"))


SQL["block_reassembly"] = "SELECT CAST(conv_id AS VARCHAR) AS id, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id"


@query()
def walk_scan(spark, d):
    """Every file below the tables' folder."""
    from ..sources.walk import walk

    return walk(spark, [d]).select("name", "size", "depth", "error")


@query(SQL["report_latest"])
def stream_latest(spark, d):
    """``report_latest`` from a replay of the events as a stream, in batches, ending when all are read."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="quire-stream-")
    folder = f"{base}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(read(spark, d, "events").schema).option("maxFilesPerTrigger", 64).parquet(f"{d}/events.parque[t]")
    best = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/latest")
    best.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/latest").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
