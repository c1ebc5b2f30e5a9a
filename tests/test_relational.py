"""Index jobs, reports, trees, metadata and pages on small tables with known outcomes."""

import pytest
from pyspark.sql import functions as F

from quire.functions import ids
from quire.operators import index, metadata, pages, reports, tree


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def found(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_intersection_and_complement(spark):
    a4, b10 = table(spark, [(i,) for i in range(4)], "id int"), table(spark, [(i,) for i in range(10)], "id int")
    assert found(index.intersection(a4, b10, {"t": "yes"}), "id", "t") == [(i, "yes") for i in range(4)]
    assert found(index.complement(b10, a4, {"t": "no"}), "id", "t") == [(i, "no") for i in range(4, 10)]


def test_copy_fields(spark):
    df = table(spark, [(i, "ERROR:SCHEMA-INDEX-MISMATCH,stringValue=123", *[f"v{i}{k}" for k in range(3)]) for i in range(10)], "id int, bad string, set_a_0 string, set_a_1 string, set_a_2 string")
    out = index.copy_fields(df, {"bad": "good", "set_a_*": "set_b_*", "set_a_0": None})
    assert out.columns == ["id", "good", "set_b_0", "set_b_1", "set_b_2", "set_a_0"]
    assert found(out, "id", "good", "set_b_2") == [(i, "123", f"v{i}2") for i in range(10)]


def test_rehash(spark):
    df = table(spark, [("X", "/old/a/b.txt"), ("Y", "/other/c.txt")], "id string, path string").withColumn("id", F.when(F.col("id") == "Y", F.upper(F.sha2("path", 256))).otherwise(F.col("id")))
    (r,) = index.rehash(df, "^/old", "/new").collect()
    assert (r.path, r.parent_path, r.old_id) == ("/new/a/b.txt", "/new/a", "X") and r.id == r.id.upper() and len(r.id) == 64
    assert found(index.apply_rehash(df, "^/old", "/new"), "path") == [("/new/a/b.txt",), ("/other/c.txt",)]


def test_delete(spark):
    df = table(spark, [(1, "a"), (2, None), (3, "b")], "id int, k string")
    assert index.delete(df).count() == 0
    assert found(index.delete(df, F.col("k") == "a"), "id") == [(2,), (3,)]
    assert found(index.delete(df, ids=[3]), "id") == [(1,), (2,)]
    assert found(index.delete(df, ids=df.where("id < 3")), "id") == [(3,)]


def test_queue_duplicates_and_removal(spark):
    q = table(spark, [(0, "/foo/bar"), (1, "/foo/baz"), (2, "/foo/bar"), (3, "/foo/bar")], "n int, path string")
    assert found(index.duplicates_removed(q.where("n < 3"), "path"), "removed", "left") == [(1, 2)]
    assert found(index.remove_n(q, "path", "/foo/bar", 2, ["n"]), "n") == [(1,), (3,)]
    assert found(index.remove_n(q, "path", "/foo/bar", 0, ["n"]), "n") == [(1,)]
    assert index.remove_n(q, "path", "/none", 0, ["n"]).count() == 4


def test_merges(spark):
    seen = table(spark, [("i", "/a/x"), ("i", "/b/y"), ("i", "/a/x"), ("j", "z")], "id string, path string")
    assert found(index.merge_paths(seen), "id", "paths", "parent_paths", "n_seen") == [("i", ["/a/x", "/b/y"], ["/a", "/b"], 3), ("j", ["z"], [""], 1)]
    old = table(spark, [("i", "1", ["p"]), ("k", "2", None)], "id string, a string, s array<string>")
    new = table(spark, [("i", None, ["q", "p"]), ("n", "3", ["r"])], "id string, a string, s array<string>")
    assert found(index.merge_into(old, new, sets=("s",)), "id", "a", "s") == [("i", "1", ["p", "q"]), ("k", "2", None), ("n", "3", ["r"])]
    assert found(index.merge_into(old, new, atomic=False), "id", "a", "s") == [("i", None, ["q", "p"]), ("k", "2", None), ("n", "3", ["r"])]


def test_replace_children(spark):
    s = "id string, root_id string, level int, v string"
    old = table(spark, [("r", "r", 0, "o"), ("c1", "r", 1, "o"), ("c2", "r", 2, "o"), ("q", "q", 0, "o"), ("d", "q", 1, "o")], s)
    new = table(spark, [("r", "r", 0, "n"), ("c1", "r", 1, "n")], s)
    assert found(index.replace_children(old, new), "id", "v") == [("c1", "n"), ("d", "o"), ("q", "o"), ("r", "n")]


def test_resume(spark):
    paths = table(spark, [(p,) for p in "abcdefg"], "path string")
    rep = table(spark, [("a", 0), ("b", 11), ("c", 10), ("d", 9), ("e", 8), ("f", 2)], "path string, code int")
    assert found(reports.to_do(paths, rep), "path") == [("d",), ("e",), ("f",), ("g",)]
    assert found(reports.clean(rep, paths.where("path < 'c'")), "path") == [("a",), ("b",)]
    many = table(spark, [("a", 1, 5), ("a", 2, 0), ("b", 1, 3)], "path string, ts int, code int")
    assert found(reports.latest(many), "path", "code") == [("a", 0), ("b", 3)]
    full = rep.withColumns({"exception_class": F.lit("E"), "exception_message": F.lit("m")})
    assert found(reports.view(full, ["a", "zz"]), "path", "status") == [("a", "SUCCESS"), ("zz", None)]


def test_progress_and_in_flight(spark):
    e = table(spark, [("p", "embeds", 3), ("p", "units", 2), ("p", "expected_units", 4), ("p", "embeds", 1)], "path string, kind string, amount int")
    assert found(reports.progress(e), "path", "embeds", "units", "expected_units", "skipped_depth") == [("p", 4, 2, 4, 0)]
    r = table(spark, [("b", 10), ("a", 4)], "path string, s int").withColumn("started", F.timestamp_seconds(F.lit(1000) - F.col("s")))
    assert reports.in_flight(r, F.timestamp_seconds(F.lit(1000))).first()[0] == "a (4s); b (10s)"
    assert reports.in_flight(r.limit(0), F.timestamp_seconds(F.lit(1000))).first()[0] == "none"


TREE = [("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("x", "y"), ("y", "x")]


def test_levels_and_cycles(spark):
    out = tree.levels(table(spark, TREE, "id string, parent_id string"))
    assert found(out, "id", "root_id", "level") == [("a", "r", 1), ("b", "r", 1), ("c", "r", 2), ("r", "r", 0)]
    assert [r.id for r in tree.depth_first(out).collect()] == ["r", "a", "c", "b"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_recursive_ids_equal_level_by_level(spark, partitions):
    nodes = table(spark, [(k, p, f"d{k}", "0", k) for k, p in TREE[:4]], "key string, parent_key string, digest string, relation string, name string").repartition(partitions)
    import hashlib

    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    a = sha("da", "dr", "0", "a")
    assert found(tree.recursive_ids(nodes), "key", "id", "level") == sorted([("r", "dr", 0), ("a", a, 1), ("b", sha("db", "dr", "0", "b"), 1), ("c", sha("dc", a, "0", "c"), 2)], key=repr)


def test_trees_of_more_rows_than_a_recursive_query_may_have(spark):
    wide = table(spark, [("r", None, "d", None, None)] + [(f"n{i}", "r" if i < 20 else f"n{i % 20}", "d", "0", f"n{i}") for i in range(300)], "key string, parent_key string, digest string, relation string, name string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        assert tree.levels(wide, "key", "parent_key").groupBy("level").count().orderBy("level").collect() == [(0, 1), (1, 20), (2, 280)]
        assert tree.recursive_ids(wide).count() == tree.folder_paths(wide, "key", "parent_key").count() == 301
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_a_wide_and_deep_tree(spark):
    """1.2 million nodes below one root, and a chain of 150."""
    wide = spark.range(1_200_000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") > 0, F.expr("(id - 1) div 20")).cast("string").alias("parent_key"))
    chain = spark.range(150).select(F.concat(F.lit("c"), "id").alias("key"), F.when(F.col("id") == 0, "0").otherwise(F.concat(F.lit("c"), F.col("id") - 1)).alias("parent_key"))
    out = tree.levels(wide.unionAll(chain).repartition(4), "key", "parent_key")
    assert out.where("id = 'c149'").first().level == 150 and out.count() == 1_200_150


def test_orders_of_siblings(spark):
    rows = table(spark, [("r", None, 0), ("b", "r", 0), ("a", "r", 1), ("z", "b", 0), ("c", "a", 10), ("d", "a", 9)], "id string, parent_id string, n int")
    placed = tree.levels(rows, ordinal="n")
    assert [r.id for r in tree.depth_first(placed).collect()] == ["r", "b", "z", "a", "d", "c"]
    assert [r.id for r in tree.numbered_depth_first(placed.repartition(5)).orderBy("n").collect()] == ["r", "b", "z", "a", "d", "c"]
    assert found(tree.parents(rows, ["n"]), "id", "parent_n") == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("z", 0)]
    tagged = placed.withColumn("path", F.lit("/p"))
    assert tree.without_embeds(placed).count() == 1 and tree.visit(tagged, "r").count() == 6


def test_gate(spark):
    docs = table(spark, [("r", "r", 0, "/b"), ("k", "r", 1, "/b"), ("r", "r", 0, "/a"), ("k", "r", 1, "/a"), ("q", "q", 0, "/c")], "id string, root_id string, level int, path string")
    assert found(tree.gate(docs), "id", "path") == [("k", "/a"), ("q", "/c"), ("r", "/a")]


def test_depth_is_bounded_by_the_data_alone(spark):
    chain = table(spark, [(i, i - 1 if i else None) for i in range(8)], "id int, parent_id int")
    assert tree.levels(chain, most=3).agg(F.max("level")).first()[0] == 7
    with pytest.raises(ValueError):  # two rows for one node, of which one hangs from a root and the other from its own child
        tree.levels(table(spark, [("a", None), ("b", "a"), ("a", "b")], "id string, parent_id string"), most=3).count()


def test_folder_paths(spark):
    f = table(spark, [(1, 1, "top"), (2, 1, "in"), (3, 2, None), (4, 5, "x"), (5, 4, "y")], "id int, parent_id int, name string")
    assert found(tree.folder_paths(f), "id", "path") == [(1, "/"), (2, "/in"), (3, "/in/?")]


def test_guards_and_counts(spark):
    kids = table(spark, [("p", 1, "5"), ("p", 3, "5"), ("p", 3, "50"), ("p", 1, "50"), ("q", 1, None)], "parent_id string, level int, declared_length string")
    g = tree.guard(kids, 2, 10)
    assert found(tree.skip_counts(g), "parent_id", "skipped_depth", "skipped_size") == [("p", 2, 1)]


def test_names_and_text_of_children(spark):
    k = table(spark, [("p", 0, None, "a"), ("p", 1, "n", "b"), ("p", 2, " ", "c"), ("q", 0, "", "d")], "parent_id string, ordinal int, name string, text string")
    assert found(ids.untitled_names(k), "parent_id", "ordinal", "name") == [("p", 0, "untitled_p_0"), ("p", 1, "n"), ("p", 2, "untitled_p_1"), ("q", 0, "untitled_q_0")]
    assert found(ids.legacy_untitled_names(k, ["parent_id", "ordinal"]), "name") == [(f"untitled_{i}",) for i in range(1, 5)]
    assert found(tree.concatenate(k, "parent_id", "ordinal", "text"), "parent_id", "content") == [("p", "a\nb\nc"), ("q", "d")]
    assert tree.concatenate(k.where("parent_id = 'q'"), "parent_id", "ordinal", "text", F.lit("N")).first().content == '<div class="package-entry"><h1>N</h1>d</div>'


def test_losses(spark):
    listed = table(spark, [(i, i % 3) for i in range(7)], "id int, folder_id int")
    out = table(spark, [(0, 1, True), (1, 1, False), (1, 2, True), (2, 1, False)], "id int, attempt int, ok boolean")
    once = tree.emitted_once(out)
    assert found(once, "id", "attempt") == [(0, 1), (1, 2)]
    folders = table(spark, [(0, "/in")], "id int, path string")
    assert found(tree.recover_orphans(listed, once, folders), "id", "path") == [(2, "/[recovered]"), (3, "/in"), (4, "/[recovered]"), (5, "/[recovered]"), (6, "/in")]
    expected = table(spark, [("m", 7), ("n", None), ("o", 1)], "k string, expected bigint")
    emitted = table(spark, [("m",)] * 5 + [("n",)] + [("o",)] * 2, "k string")
    assert found(tree.reconcile(expected, emitted, "k"), "k", "expected", "emitted", "failed", "state") == [("m", 7, 5, 2, "incomplete"), ("n", None, 1, 0, "unknown"), ("o", 1, 2, 0, "complete")]


def test_duplicate_roots_and_counts(spark):
    t = table(spark, [("r", "r", 0, True), ("c", "r", 1, False), ("q", "q", 0, False), ("d", "q", 1, False)], "id string, root_id string, level int, is_duplicate boolean")
    assert found(tree.without_duplicate_roots(t), "id") == [("d",), ("q",), ("r",)]
    assert found(tree.child_counts(t), "root_id", "n_children") == [("q", 1), ("r", 1)]


def test_metadata(spark):
    m = table(spark, [("d", {"X-Y": ["1"], "X_Y": ["2", ""], "title": ["a", "b"], "Content-Type": ["t", "t"], "empty": ["", None], "Unknown tag (0x1)": ["1"], "custom:x": ["2"]})], "id string, metadata map<string,array<string>>")
    n = metadata.normalise(metadata.exploded(m))
    assert found(n, "field", "values") == [("tika_metadata_content_type", ["t"]), ("tika_metadata_title", ["a"]), ("tika_metadata_x_y", ["1", "2"])]
    d = table(spark, [("d", "tika_metadata_date", "dcterms:created", ["2015-06-03"]), ("d", "tika_metadata_dc_date", "dc:date", ["2015-06-03", "2016-01-01"]), ("e", "tika_metadata_dc_date", "dc:date", ["alpha", "beta"]), ("e", "tika_metadata_date", "dcterms:created", ["never"]), ("f", "tika_metadata_x", "DC:date", ["2015-06-03"])], "id string, field string, name string, values array<string>")
    assert found(metadata.with_dates(d), "id", "field", "value", "values") == [
        ("d", "tika_metadata_date", "2015-06-03", None), ("d", "tika_metadata_date_iso8601", "2015-06-03T12:00:00Z", None), ("d", "tika_metadata_dc_date", None, ["2015-06-03T00:00:00Z", "2016-01-01T00:00:00Z"]),
        ("e", "tika_metadata_date", "never", None), ("e", "tika_metadata_dc_date", "alpha,beta", None), ("f", "tika_metadata_x", "2015-06-03", None),
    ]
    assert metadata.as_map(metadata.with_dates(d)).where("id = 'e'").first().metadata == {"tika_metadata_date": ["never"], "tika_metadata_dc_date": ["alpha,beta"]}
    back = m.select(metadata.parse_sidecar(metadata.as_json(F.col("metadata"))).alias("x")).first().x
    assert back == m.first().metadata
    assert metadata.parse_tags(["a:b:c"]) == {"a": "b:c"}
    with pytest.raises(ValueError):
        metadata.parse_tags(["nothing"])


def test_pages(spark):
    d = table(spark, [("d", "page one\fpage two!\f"), ("e", "single")], "id string, content string")
    p = pages.offsets(pages.split(d))
    assert found(p, "id", "page_no", "start", "end") == [("d", 0, 0, 8), ("d", 1, 9, 18), ("d", 2, 19, 19), ("e", 0, 0, 6)]
    text = p.join(d, "id").select("text", pages.page_text(F.col("content"), F.col("start"), F.col("end")).alias("cut"))
    assert all(r.text == r.cut for r in text.collect())
    j = pages.indices_json("P", p).where("id = 'd'")
    assert j.first().indices == '{"extractor":"P","pages":[[0,8],[9,18],[19,19]]}'
    assert j.select(pages.parse_indices(F.col("indices"))["pages"].alias("p")).first().p == [[0, 8], [9, 18], [19, 19]]


def test_cache_computes_each_key_once(spark):
    keys = table(spark, [(1, "a"), (2, "a"), (3, "b")], "n int, k string")
    cache = table(spark, [("b", 1)], "k string, v int")
    out, made = pages.cached(keys, cache, lambda missing: missing.withColumn("v", F.lit(9)), "k")
    assert found(out, "n", "v") == [(1, 9), (2, 9), (3, 1)] and found(made, "k") == [("a",)]


def test_results_do_not_depend_on_partitions(spark):
    rows = [(f"i{n % 7}", f"/d{n % 5}/f{n}") for n in range(100)]
    one, many = (found(index.merge_paths(table(spark, rows, "id string, path string").repartition(p)), "id", "paths") for p in (1, 9))
    assert one == many
