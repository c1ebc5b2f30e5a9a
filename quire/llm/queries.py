"""Registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from .decontaminate import K, WINDOW, find_spans
from .kernel import WORD_RE
from .mixing import MAX_EPOCHS, OTHER_WEIGHT, SEED, TARGETS, mix
from .near_dedup import near_duplicates
from .neighbours import nearest
from .pii import find_pii
from .quality import assess
from .shared import read
from .sharding import SHARDS, shard
from .substring import repeats
from .toxicity import classify
from .url_filter import RULES, filter_urls


def op1_decontaminate(spark, sf_dir):
    return find_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    return filter_urls(read(spark, sf_dir, "pages"))


def op5_quality(spark, sf_dir):
    return assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_neighbours(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"))


def op7_pii(spark, sf_dir):
    return find_pii(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return repeats(read(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_sharding(spark, sf_dir):
    return shard(read(spark, sf_dir, "documents"))


_T = K + WINDOW - 1

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_dedup": op2_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_neighbours": op6_neighbours,
    "op7_pii": op7_pii,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
}

SQL = {
    # Spans of at least T tokens are runs of shared T-grams along one diagonal.
    "op1_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '{WORD_RE}') AS w FROM documents),
        b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(text), '{WORD_RE}') AS w FROM benchmark),
        dg AS (SELECT r, doc_id, p, array_to_string(w[p:p + {_T - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {_T - 2})) AS p FROM d)),
        bg AS (SELECT i, item_id, q, array_to_string(w[q:q + {_T - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {_T - 2})) AS q FROM b)),
        hit AS (SELECT r, doc_id, i, item_id, p, q, p - row_number() OVER (PARTITION BY r, i, p - q ORDER BY p) AS island FROM dg JOIN bg USING (g))
        SELECT doc_id, item_id, min(p) - 1 AS doc_start, min(q) - 1 AS item_start, CAST(count(*) + {_T - 1} AS BIGINT) AS n_tokens
        FROM hit GROUP BY r, doc_id, i, item_id, p - q, island""",
    # The water level is the largest level among the sources that stay below their caps.
    "op3_mixing": f"""
        WITH s AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source),
        u AS (SELECT source, size, CASE {" ".join(f"WHEN source = '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in TARGETS.items())} ELSE CAST({OTHER_WEIGHT!r} AS DOUBLE) END AS weight FROM s WHERE size > 0),
        c AS (SELECT *, CAST({MAX_EPOCHS} AS DOUBLE) * CAST(size AS DOUBLE) / weight AS ratio FROM u WHERE weight > 0),
        l AS (SELECT *, (CAST((SELECT sum(size) FROM s) AS DOUBLE) - CAST({MAX_EPOCHS} AS DOUBLE) * CAST(coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c WINDOW o AS (ORDER BY ratio, source NULLS FIRST)),
        r AS (SELECT source, CASE WHEN level >= ratio THEN CAST({MAX_EPOCHS} AS DOUBLE) ELSE (SELECT max(level) FROM l WHERE level < ratio) * weight / CAST(size AS DOUBLE) END AS rate FROM l),
        d AS (SELECT doc_id, d.source, rate, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8)) AS BIGINT) / 4294967296.0 AS draw FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, source, unnest(range(1, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy FROM d""",
    # The heap, one group a step.
    "op9_sharding": f"""
        WITH RECURSIVE g AS (SELECT coalesce(md5(text), '') AS grp, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY 1),
        o AS (SELECT *, row_number() OVER (ORDER BY size DESC, grp) AS n FROM g),
        h AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS grp, CAST(-1 AS BIGINT) AS shard, list_transform(range({SHARDS}), lambda x: CAST(0 AS BIGINT)) AS loads
            UNION ALL
            SELECT o.n, o.grp, list_position(h.loads, list_min(h.loads)) - 1, list_transform(h.loads, lambda x, i: CASE WHEN i = list_position(h.loads, list_min(h.loads)) THEN x + o.size ELSE x END)
            FROM h JOIN o ON o.n = h.n + 1)
        SELECT doc_id, CAST(shard AS BIGINT) AS shard FROM documents JOIN h ON coalesce(md5(text), '') = h.grp""",
    "op4_url_filter": rf"""
        WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '#.*$', '') AS u FROM pages),
        b AS (SELECT page_id, u, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*') AS head FROM a),
        c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(head), '://.*@', '://'), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1'), '\.(:[0-9]*)?$', '\1') AS host,
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(u, length(head) + 1), '([?&])utm_[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', '') AS rest FROM b),
        t AS (SELECT page_id, host, CASE WHEN host <> '' AND NOT starts_with(rest, '/') THEN '/' || rest ELSE rest END AS tail FROM c),
        p AS (SELECT *, regexp_extract(tail, '^[^?]*') AS path, string_split(path, '/') AS steps FROM t),
        d AS (SELECT page_id, host || CASE WHEN host <> '' AND regexp_matches(path, '/\.\.?(/|$)') THEN
            array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(steps, lambda x: [x])), lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN CASE WHEN len(acc) > 1 THEN acc[:len(acc) - 1] ELSE acc END ELSE list_concat(acc, x) END), '/')
            || CASE WHEN steps[-1] IN ('.', '..') THEN '/' ELSE '' END || substr(tail, length(path) + 1) ELSE tail END AS canonical FROM p),
        e AS (SELECT page_id, canonical, concat_ws(' ', {", ".join(f"CASE WHEN canonical GLOB '{r}' THEN '{r}' END" for r in RULES)}) AS rules FROM d)
        SELECT page_id, canonical, coalesce(rules <> '', false) AS blocked, rules FROM e""",
}
