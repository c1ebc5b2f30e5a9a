"""Each operator against brute force, and on the rows that break things."""

import collections
import heapq
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, near_dedup, neighbours, pii, quality, sharding, substring, toxicity, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *[None] * (schema.count(",") + 1 - len(r))) for r in rows], schema)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, one id with two texts, a very long text, and columns that operators might use themselves."""
    r = random.Random(5)
    long = prose(r, 40_000)
    rows = [(None, None, None, None), (1, None, "en", None), (2, "", "en", "a"), (3, "  \n\n ", "en", "a"), (4, "one", "en", "b"), (4, "one", "en", "b"), (5, prose(r, 60), "en", "b"), (5, prose(r, 60), "fr", "c"), (None, prose(r, 50), "en", "c"), (6, long, "en", "c"), (7, "é" * 500 + " " + "漢字" * 300, None, "c"), (8, "x" * 70_000, "en", "a")]
    df = spark.createDataFrame([(*x, 1, 1, "k", 0.5, "t", True, 9, "g", 3, "z") for x in rows], "doc_id bigint, text string, lang string, source string, row int, rank int, _row_key string, score double, toxic string, keep boolean, size int, `group` string, _copy int, _mix_rate string")
    return df.cache()


LABELS = "doc_id bigint, quality int, toxic int"


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 decontamination


def words_of(text):
    return re.findall(r"[0-9a-zÀ-῿⁰-⿿぀-\U0010ffff]+", text.lower())


def brute_spans(docs, items, least):
    out = []
    for d, t in docs:
        a = words_of(t or "")
        for i, u in items:
            b = words_of(u or "")
            for p in range(len(a)):
                for q in range(len(b)):
                    if a[p] == b[q] and (p == 0 or q == 0 or a[p - 1] != b[q - 1]):
                        n = 0
                        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                            n += 1
                        if n >= least:
                            out.append((d, i, p, q, n))
    return sorted(out)


@pytest.mark.parametrize("local_tokens", [0, 10_000])
def test_spans_equal_brute_force(spark, local_tokens):
    r = random.Random(1)
    items = [(i, prose(r, r.choice((5, 12, 13, 14, 30)))) for i in range(12)]
    docs = []
    for d in range(40):
        parts = [prose(r, r.randint(0, 30))]
        for _ in range(r.randint(0, 2)):
            w = r.choice(items)[1].split()
            s = r.randint(0, 6)
            parts += [" ".join(w[s : s + r.randint(8, 30)]).upper(), prose(r, r.randint(0, 9))]
        docs.append((d, " ".join(parts)))
    docs += [docs[0], (99, " ".join(["same"] * 40))]
    items.append((50, " ".join(["same"] * 20)))
    got = sorted(map(tuple, decontaminate.find_spans(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), local_tokens=local_tokens).collect()))
    assert got == brute_spans(docs, items, 13)
    assert len(got) > 10


@pytest.mark.parametrize("k,window", [(1, 1), (3, 4), (5, 1)])
def test_every_long_enough_span_is_found(spark, k, window):
    r = random.Random(k)
    items = [(i, prose(r, 25)) for i in range(5)]
    docs = [(d, prose(r, 10) + " " + " ".join(items[d % 5][1].split()[d % 7 : d % 7 + k + window - 1 + d % 3]) + " " + prose(r, 10)) for d in range(30)]
    got = sorted(map(tuple, decontaminate.find_spans(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), k, window).collect()))
    assert got == brute_spans(docs, items, k + window - 1)


def test_a_full_filter_changes_nothing(spark):
    r = random.Random(33)
    items = [(i, prose(r, 40)) for i in range(30)]
    docs = [(d, prose(r, 20) + " " + " ".join(r.choice(items)[1].split()[:20])) for d in range(20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    small = decontaminate.find_spans(frame(spark, docs), bench, local_tokens=0, most_bits=64)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, decontaminate.find_spans(frame(spark, docs), bench).collect())) != []


def test_the_filter_lets_next_to_nothing_through_in_vain(spark):
    """It is sized by the benchmark, so hardly a clean document of 200 words leaves the scan, and all contaminated ones do."""
    r = random.Random(34)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = lambda n: " ".join("".join(r.choices(letters, k=6)) for _ in range(n))
    items = [(i, words(2000)) for i in range(60)]
    bench = decontaminate._prepared(spark.createDataFrame(items, "item_id bigint, text string"), decontaminate.K, decontaminate.WINDOW)
    bits = decontaminate._filter(bench, decontaminate.FILTER_BITS, decontaminate.MOST_FILTER_BITS)
    assert 32 <= 64 * len(bits) / bench.selectExpr("sum(size(fp))").first()[0] <= 64

    def passes(text):
        hashes, owner, _ = decontaminate._tokens(pa.record_batch([pa.array([text])], names=["text"]))
        return decontaminate.known(bits, decontaminate.winnow(hashes, owner, decontaminate.K, decontaminate.WINDOW)[1]).any()

    assert sum(passes(words(200)) for _ in range(1000)) <= 5
    assert all(passes(words(50) + " " + " ".join(items[i][1].split()[i : i + 13]) + " " + words(50)) for i in range(60))


def test_decontamination_awkward(spark, awkward):
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "short one"), (None, prose(random.Random(5), 40_000)[:400])], "item_id bigint, text string")
    out = decontaminate.drop_contaminated(awkward, bench)
    assert out.columns == awkward.columns
    assert out.count() == awkward.count() - 1  # the very long text begins like the last item
    assert sorted(out.collect(), key=repr) == sorted(decontaminate.drop_contaminated(awkward, bench, local_tokens=0).collect(), key=repr)
    assert {x.doc_id for x in decontaminate.find_spans(awkward, bench).collect()} == {6}
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_spans(awkward, none).count() == 0
    assert decontaminate.drop_contaminated(awkward, none).count() == awkward.count()
    assert decontaminate.find_spans(empty(spark), bench).count() == 0


# --- 2 near duplicates


def bag(text):
    w = words_of(text or "")
    return collections.Counter(zip(w, w[1:])) if len(w) > 1 else collections.Counter(w)


def similarity(a, b):
    both = sum(min(a[x], b[x]) for x in a)
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def test_signature_agreement_is_weighted_jaccard():
    r = random.Random(2)
    errors = []
    for _ in range(60):
        w = prose(r, 120).split()
        p = r.random() * 0.4
        pair = [" ".join(w), " ".join(x if r.random() > p else r.choice(VOCAB) for x in w)]
        data, offs = near_dedup.lowered(pa.array(pair))
        b, e, o = near_dedup.words(data, offs)
        sig, _ = near_dedup.signatures(*near_dedup.elements(near_dedup.hash_ranges(data, b, e), o, 2), 2, 256)
        errors.append((sig[0] == sig[1]).mean() - similarity(*map(bag, pair)))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_groups_equal_brute_force(spark):
    r = random.Random(4)
    docs, n = [], 0
    for g in range(40):
        base = prose(r, r.randint(20, 120)).split()
        for copy in range(r.choice((1, 1, 2, 3, 30))):
            text = list(base)
            for _ in range(0 if copy == 0 else r.randint(0, max(1, len(text) // 20))):
                text[r.randrange(len(text))] = r.choice(VOCAB)
            docs.append((n, " ".join(text)))
            n += 1
    r.shuffle(docs)
    bags = {d: bag(t) for d, t in docs}
    parent = {d: d for d in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        if similarity(bags[a], bags[b]) >= 0.5:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {(d, find(d)) for d in bags if find(d) != d}
    got = set(map(tuple, near_dedup.near_duplicates(frame(spark, docs)).collect()))
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    kept = {x.doc_id for x in near_dedup.drop_near_duplicates(frame(spark, docs)).collect()}
    assert kept == set(bags) - {d for d, _ in got}


def test_parts_are_connected_parts():
    r = np.random.default_rng(1)
    base = r.integers(0, 256, (6, 64), dtype=np.uint8)
    rows = []
    for b in base:
        for _ in range(20):
            x = b.copy()
            x[r.choice(64, 20, False)] = r.integers(0, 256, 20)
            rows.append(x)
    sketch = np.array(rows)[r.permutation(120)]
    near = (sketch[:, None] == sketch[None]).sum(axis=2) >= 32
    label = np.arange(120)
    for _ in range(120):
        label = np.array([label[near[i]].min() for i in range(120)])
    got = np.arange(120)
    for leader, members in near_dedup._parts(sketch, 0.5):
        got[members] = leader
    assert (got == label).all()


def test_blocks_across_batches():
    r = random.Random(5)
    for _ in range(200):
        keys = sorted(zip(r.choices(range(5), k=14), r.choices(range(3), k=14)))[: r.randint(0, 14)]
        whole = pa.record_batch([pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int32()), pa.array(range(len(keys)))], names=["band", "block", "node"])
        cuts = sorted({0, len(keys), *r.choices(range(len(keys) + 1), k=4)})
        got = []

        def work(t, border):
            got.extend(t.column("node").to_pylist()[a:b] for a, b in zip(border[:-1], border[1:]) if b - a > 1)
            return iter(())

        list(near_dedup._blocks(["band", "block"], work)(whole.slice(a, z - a) for a, z in zip(cuts, cuts[1:])))
        assert got == [x for x in ([i for i, k in enumerate(keys) if k == key] for key in sorted(set(keys))) if len(x) > 1]


def test_components_of_a_long_chain(spark):
    n = 60
    e = [(bytes([i]), bytes([i + 1])) for i in range(n)] + [(b"\xff", b"\xfe"), (b"\xff", b"\xff")]
    got = {bytes(x.node): bytes(x.root) for x in near_dedup.components(spark.createDataFrame(e, "a binary, b binary")).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(n + 1)} | {b"\xff": b"\xfe", b"\xfe": b"\xfe"}


@pytest.mark.parametrize("bucket", [4, 16_384])
def test_large_buckets_lose_no_link(spark, bucket):
    """Buckets split into blocks of four nodes, with tight groups, a hub of copies and loners, give what whole buckets give."""
    r = random.Random(44)
    base, docs = prose(r, 60).split(), []
    for n in range(120):
        text = list(base)
        for _ in range(n % 12):
            text[r.randrange(60)] = r.choice(VOCAB)
        docs.append((n, " ".join(text)))
    half = prose(r, 40)
    docs += [(200 + n, half + " " + prose(r, 60)) for n in range(60)]  # below the threshold, but with bands in common
    docs += [(300 + n, docs[3][1]) for n in range(40)]
    got = set(map(tuple, near_dedup.near_duplicates(frame(spark, docs), bucket=bucket).collect()))
    assert got == set(map(tuple, near_dedup.near_duplicates(frame(spark, docs), bucket=1000).collect())) and len(got) > 120


def test_links_across_blocks_are_found(spark):
    """One band for all; groups whose members fall into different blocks."""
    r = np.random.default_rng(6)
    base = r.integers(0, 256, (9, 96), dtype=np.uint8)
    sketches = []
    for n in range(90):
        x = base[n % 9].copy()
        x[r.choice(96, 30, False)] = r.integers(0, 256, 30)
        sketches.append(x)
    nodes = spark.createDataFrame([(bytes([n]), bytes(x), [7, 1000 + n]) for n, x in enumerate(sketches)], "node binary, sketch binary, bands array<bigint>")
    near = (np.array(sketches)[:, None] == np.array(sketches)[None]).sum(axis=2) >= 48
    label = np.arange(90)
    for _ in range(90):
        label = np.array([label[near[i]].min() for i in range(90)])
    for bucket in (5, 17, 1000):
        got = {x.node[0]: x.root[0] for x in near_dedup.linked(nodes, 0.5, bucket).collect()}
        assert [got.get(n, n) for n in range(90)] == label.tolist()


def test_components_with_a_hub(spark):
    e = [(bytes([0, 0, 9]), bytes([1, i // 256, i % 256])) for i in range(3000)] + [(bytes([1, 0, 5]), bytes([2, 0, 0])), (bytes([2, 0, 0]), bytes([2, 0, 1]))]
    got = near_dedup.components(spark.createDataFrame(e, "a binary, b binary")).collect()
    assert len(got) == 3003 and {bytes(x.root) for x in got} == {bytes([0, 0, 9])}


def test_components_in_one_task_are_those_of_many(spark, monkeypatch):
    """The same from one task and from the jobs beyond its limit; one task needs the edges written once and no step after."""
    r = random.Random(12)
    name = lambda i: r2[i].to_bytes(2, "big")
    written = []
    monkeypatch.setattr(near_dedup, "cut", lambda df, cut=near_dedup.cut: written.append(1) or cut(df))
    for n, m in ((1, 1), (300, 260), (60, 400)):
        r2 = r.sample(range(65536), n)
        e = [(name(r.randrange(n)), name(r.randrange(n))) for _ in range(m)]
        root = {x: x for p in e for x in p}
        for _ in range(n):
            for a, b in e:
                root[a] = root[b] = min(root[a], root[b])
        edges = spark.createDataFrame(e, "a binary, b binary")
        written.clear()
        one = {bytes(x.node): bytes(x.root) for x in near_dedup.components(edges).collect()}
        assert len(written) == 1
        many = {bytes(x.node): bytes(x.root) for x in near_dedup.components(edges, local_edges=0).collect()}
        assert one == many == {x: root[x] for a, b in e if a != b for x in (a, b)}
    chain = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)], "a binary, b binary")
    assert {bytes(x.root) for x in near_dedup.components(chain, local_edges=59).collect()} == {b"\x00"}


@pytest.mark.parametrize("keys", [0, 1000])
def test_rows_without_text_and_repeated_rows_stay(spark, keys):
    words = prose(random.Random(9), 30)
    rows = [(None, None, None, s) for s in "abc"] + [(7, "", None, s) for s in "ab"] + [(8, " .. ", None, "a")] * 2 + [(1, words, None, s) for s in "ab"] + [(2, words, None, "a")]
    left = near_dedup.drop_near_duplicates(frame(spark, rows), broadcast_keys=keys)
    got = collections.Counter((x.doc_id, x.text, x.source) for x in left.collect())
    assert sum(n for k, n in got.items() if k[:2] == (1, words)) == 1 and (2, words, "a") not in got
    assert {k: n for k, n in got.items() if k[0] != 1} == collections.Counter((r[0], r[1], r[3]) for r in rows if r[0] not in (1, 2))
    assert sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows)).collect())) == [(1, 1), (2, 1)]


def test_texts_are_not_shuffled_to_drop_duplicates(spark, tmp_path):
    words = prose(random.Random(9), 30)
    frame(spark, [(n, words if n % 3 == 0 else prose(random.Random(n), 30)) for n in range(60)]).write.parquet(str(tmp_path / "d"))
    left = near_dedup.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d")))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert left.count() == 41 and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_near_duplicates_awkward(spark, awkward):
    got = sorted(map(tuple, near_dedup.near_duplicates(awkward).collect()))
    assert got == [(4, 4)]
    out = near_dedup.drop_near_duplicates(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count() - 1
    assert near_dedup.near_duplicates(empty(spark)).count() == 0 and near_dedup.drop_near_duplicates(empty(spark)).count() == 0


# --- 3 mixing


def brute_water(sizes, weights, epochs, budget):
    """Clamp and hand on what is over, until nothing is."""
    live = {s for s in sizes if sizes[s] > 0 and weights[s] > 0}
    given, left = {s: 0.0 for s in sizes}, budget
    while live:
        total = sum(weights[s] for s in live)
        over = {s for s in live if left * weights[s] / total >= epochs * sizes[s]}
        if not over:
            return given | {s: left * weights[s] / total for s in live}
        for s in over:
            given[s] = epochs * sizes[s]
        left -= sum(given[s] for s in over)
        live -= over
    return given


@pytest.mark.parametrize("seed", range(4))
def test_water_level_equals_rounds_of_clamping(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice((0, 10, 500, 5000)) for i in range(8)}
    weights = {s: r.choice((0.0, 1.0, 2.0, 8.0)) for s in sizes}
    budget = r.choice((100, sum(sizes.values()), 10 * sum(sizes.values())))
    got = {x.source: x.rate * x["size"] for x in mixing.allocate(spark.createDataFrame(list(sizes.items()), "source string, size bigint"), weights, 1.0, 2, budget).collect()}
    want = brute_water(sizes, weights, 2, budget)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_repetitions_follow_rates(spark):
    docs = [(i, "x" * 10, None, f"s{i % 3}") for i in range(3000)]
    got = collections.Counter(x.source for x in mixing.mix(frame(spark, docs), targets={"s0": 6.0, "s1": 1.0, "s2": 0.0}, max_epochs=2).collect())
    assert got["s0"] == 2000 and abs(got["s1"] - 1000) < 60 and got["s2"] == 0
    again = mixing.mix(frame(spark, docs), targets={"s0": 6.0, "s1": 1.0, "s2": 0.0}, max_epochs=2).collect()
    assert collections.Counter(x.source for x in again) == got


def test_mixing_awkward(spark, awkward):
    out = mixing.mix_documents(awkward)
    assert out.columns == awkward.columns
    counts = collections.Counter((x.doc_id, x.source, x.copy) for x in mixing.mix(awkward).collect())
    assert all(n == (2 if k[0] == 4 else 1) or k[0] in (None, 5) for k, n in counts.items())
    assert {x._copy for x in out.collect()} <= {3}
    assert mixing.mix(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(awkward, targets={"a": -1.0})


# --- 4 URLs


def glob_match(rule, url):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in rule), url, re.S) is not None


def test_automaton_equals_regular_expressions():
    r = random.Random(8)
    rules = tuple("".join(r.choice("ab/é?*") for _ in range(r.randint(0, 12))) for _ in range(60)) + ("", "*", "**", "?*?")
    urls = ["".join(r.choice("ab/é漢") for _ in range(r.randint(0, 14))) for _ in range(300)] + [""]
    a = url_filter.Automaton(rules)
    assert a.words > 3
    hit = a.run(*url_filter.utf8(pa.array(urls)))
    for u, row in zip(urls, hit):
        assert row.tolist() == [glob_match(x, u) for x in rules], u


def test_canonical_urls(spark):
    cases = {"  HTTP://WWW.Example.COM:80/A?utm_source=x&b=1#top ": "http://www.example.com/A?b=1", "https://h:443": "https://h/", "https://h?utm_a=1": "https://h/", "https://h/p?a=1&utm_x=2&c=3": "https://h/p?a=1&c=3", "": "", "no scheme": "no scheme", None: None,
             "http://me:pw@Host.org.:80/a/./b/../c?x=../y": "http://host.org/a/c?x=../y", "https://h./": "https://h/", "https://h.:8443/x": "https://h.:8443/x".replace(".:", ":"), "http://h/../../a/..": "http://h/", "http://h/a/.": "http://h/a/", "http://h/a..b/.c": "http://h/a..b/.c", "ftp://h//a//": "ftp://h//a//"}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id bigint, url string")
    got = [x.canonical for x in url_filter.filter_urls(df).orderBy("page_id").collect()]
    assert got == list(cases.values())


def test_urls_awkward(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (2, "http://spam-farm.org/" + "a" * 50_000, "z"), (2, "http://spam-farm.org/", None), (3, "http://ok/?" + "é" * 100, None)], "page_id bigint, url string, canonical string")
    got = sorted(((x.page_id or 0, x.blocked) for x in url_filter.filter_urls(df).collect()))
    assert got == [(0, False), (1, False), (2, True), (2, True), (3, False)]
    assert not any(x.blocked for x in url_filter.filter_urls(df, ()).collect())
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# --- 5 quality


def test_marginals_equal_all_labellings():
    r = np.random.default_rng(0)
    sizes = [1, 3, 5, 2]
    owner = np.repeat(np.arange(4), sizes)
    u, move = r.normal(size=11), r.normal(size=(2, 2))
    p, pairs, z = quality.marginals(u, owner, move, True)
    want, expect, logz = np.zeros(11), np.zeros((2, 2)), 0.0
    for o in range(4):
        at = np.flatnonzero(owner == o)
        ways = list(itertools.product((0, 1), repeat=len(at)))
        score = np.array([sum(u[i] * y for i, y in zip(at, w)) + sum(move[a, b] for a, b in zip(w, w[1:])) for w in ways])
        logz += np.logaddexp.reduce(score)
        q = np.exp(score - np.logaddexp.reduce(score))
        for w, x in zip(ways, q):
            want[at] += x * np.array(w)
            for a, b in zip(w, w[1:]):
                expect[a, b] += x
    assert np.allclose(p, want) and np.allclose(pairs, expect) and abs(z - logz) < 1e-9


def test_quality_on_held_out_documents(spark):
    r = random.Random(6)
    good = [". \n".join(prose(r, 9).capitalize() for _ in range(r.randint(1, 9))) + "." for _ in range(120)]
    bad = ["\n".join(r.choice((prose(r, 6).upper().replace(" ", "!! "), prose(r, 9).replace(" ", " | "), " ".join([r.choice(VOCAB)] * 9))) for _ in range(r.randint(1, 9))) for _ in range(120)]
    texts = [x for pair in zip(good, bad) for x in pair]
    params = quality.fit(texts[:160], np.array([1, 0] * 80))
    q, _, _ = quality.judge(pa.array(texts[160:]), params)
    data, offs = quality.utf8(pa.array(texts[160:]))
    begin, end, own = quality.lines(data, offs)
    wide = quality.around((quality.describe(data, begin, end, own, offs) - params[:15]) / params[15:30], own) @ params[30:-4]
    p, length = quality.marginals(wide, own, params[-4:].reshape(2, 2)), end - begin
    assert np.allclose(q, np.bincount(own, p * length) / np.bincount(own, length))
    assert ((q >= 0.5) == np.array([True, False] * 40)).mean() > 0.95


def test_quality_awkward(spark, awkward):
    marked = labels(spark, [(5, 1, 0), (6, 0, 0), (None, 1, 1), (77, 0, 1), (4, None, None)])
    got = quality.assess(awkward, marked).collect()
    assert len(got) == awkward.count()
    assert all(x.quality == 0 and not x.keep and x.n_lines == 0 for x in got if x.doc_id in (1, 2, 3))
    assert all(x.keep for x in quality.assess(awkward, labels(spark)).collect() if x.n_lines)
    assert quality.assess(empty(spark), marked).count() == 0


# --- 6 neighbours


def exact_neighbours(x, k):
    d = np.round(neighbours.distances(x, x), 6)
    np.fill_diagonal(d, np.inf)
    return [[(int(j), i + 1, float(d[n, j])) for i, j in enumerate(np.lexsort((np.arange(len(x)), d[n]))[:k]) if np.isfinite(d[n, j])] for n in range(len(x))]


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>, label int")


def test_factor_one_is_exact(spark):
    """In several cells, of which the one with the repeated vectors is several shards, and several tasks for a shard."""
    r = np.random.default_rng(2)
    x = np.concatenate((r.normal(size=(250, 6)), np.repeat(r.normal(size=(10, 6)), 5, axis=0), np.zeros((150, 6)))).astype(np.float32)
    for every in (1, 7):
        got = collections.defaultdict(list)
        for row in neighbours.nearest(vectors(spark, x), k=7, factor=1, every=every, shard_rows=60, leaf=16, visitors=40).orderBy("vec_id", "rank").collect():
            got[row.vec_id].append((row.neighbour_id, row.rank, row.distance))
        want = exact_neighbours(x.astype(np.float64), 7)
        assert sorted(got) == list(range(0, len(x), every))
        for n in got:
            assert [a[:2] for a in got[n]] == [a[:2] for a in want[n]] and np.allclose([a[2] for a in got[n]], [a[2] for a in want[n]], atol=2e-6)


def recall(spark, x, **options):
    table = pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    got = collections.defaultdict(set)
    for row in neighbours.nearest(spark.createDataFrame(table), **options).toArrow().to_pylist():
        got[row["vec_id"]].add(row["neighbour_id"])
    asked = np.array(sorted(got))
    d = np.round(neighbours.distances(x[asked].astype(np.float64), x.astype(np.float64)), 6)
    d[np.arange(len(asked)), asked] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :10]
    return np.mean([len(got[int(n)] & set(w.tolist())) / 10 for n, w in zip(asked, want)])


@pytest.mark.parametrize("inner, outer", [(4, 64), (8, 8), (16, 64), (32, 32), (64, 64)])
def test_recall_with_the_chosen_factor(spark, inner, outer):
    r = np.random.default_rng(4)
    x = r.normal(size=(20_000, inner))
    if outer > inner:
        x = x @ r.normal(size=(inner, outer))
    if outer == 64:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x.astype(np.float32), shard_rows=4096, every=40) >= 0.9


def test_intervals_leave_out_what_a_median_cannot():
    """Clustered vectors: a query scans few of them, with nothing lost at factor 1."""
    r = np.random.default_rng(7)
    x = np.repeat(r.normal(size=(50, 16)) * 10, 100, axis=0) + r.normal(size=(5000, 16))
    s = neighbours.Search(neighbours.Tree(x, 32), np.arange(5000), x[::50], np.arange(0, 5000, 50), np.full(100, np.inf), 10, np.ones(100))
    d = np.round(neighbours.distances(x[::50], x), 6)
    d[np.arange(100), np.arange(0, 5000, 50)] = np.inf
    assert (s.at == np.argsort(d, axis=1, kind="stable")[:, :10]).all() and s.scanned < 0.15 * d.size


def test_neighbours_awkward(spark):
    rows = [(1, [0.0, 1.0], "a"), (1, [0.0, 1.0], "a"), (2, None, "b"), (None, [1.0, 1.0], "c"), (3, [1.0, None], "d"), (4, [1.0], "e"), (5, [float("nan"), 1.0], "f"), (6, [], "g"), (7, [3.0, 5.0], "h")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cell string")
    got = sorted(map(tuple, neighbours.nearest(df, every=1).collect()))
    assert got == [(1, 1, 1, 0.0), (1, 1, 1, 0.0), (1, 7, 2, 5.0), (1, 7, 2, 5.0), (7, 1, 1, 5.0), (7, 1, 2, 5.0)]
    assert neighbours.nearest(df).count() == 0 and {x.vec_id for x in neighbours.nearest(df, every=7).collect()} == {7}
    assert neighbours.nearest(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest(df, factor=0.5)


# --- 7 personal data


def test_decoding_equals_all_segmentations():
    w = pii.fit(n=60, rounds=15)
    for text in ("call +1 (20", "a.b@c.de x", "1.2.3.4", "key=abc1"):
        data, offs = pii.utf8(pa.array([text]))
        a = pii.Atoms(data, offs)
        i, length = pii.segments(a)
        s = pii.describe(a, i, length) @ w + np.random.default_rng(1).normal(0, 3, (len(i), len(pii.TYPES)))
        best = {(x, y): s[n].max() for n, (x, y) in enumerate(zip(i.tolist(), length.tolist()))}

        def top(t):
            return 0.0 if t == 0 else max([top(t - 1)] + [top(x) + v for (x, y), v in best.items() if x + y == t])

        first, count, kind = pii.decode(a, i, length, s)
        assert abs(sum(s[n, k] for f, c, k in zip(first, count, kind) for n in np.flatnonzero((i == f) & (length == c))) - top(len(a.begin))) < 1e-9
        p = pii._posterior(a, i, length, s)
        eps = 1e-5
        for n in range(0, len(i), max(1, len(i) // 5)):
            def z(delta):
                t = s.copy()
                t[n, 0] += delta
                f = [0.0]
                for e in range(1, len(a.begin) + 1):
                    f.append(np.logaddexp.reduce([f[e - 1]] + [f[x] + np.logaddexp.reduce(t[m]) for m, (x, y) in enumerate(zip(i, length)) if x + y == e]))
                return f[-1]

            assert abs((z(eps) - z(-eps)) / (2 * eps) - p[n, 0]) < 1e-4


def test_entities_of_held_out_sentences():
    made = pii.examples(300, seed=991)
    row, begin, end, kind = pii.find(pa.array([t for t, _ in made]), pii.fit())
    got = {(int(r), int(b), int(e), pii.TYPES[k]) for r, b, e, k in zip(row, begin, end, kind)}
    want = {(n, b, e, k) for n, (_, marks) in enumerate(made) for b, e, k in marks}
    assert len(got & want) > 0.97 * len(want) and len(got & want) > 0.97 * len(got)


def test_secrets_without_digits_and_long_addresses():
    w = pii.fit()
    mail = "a.b.c.d.e.f.g.h.i.j@mail.example.com"
    texts = ["password=correcthorse", 'the api_key = "swordfishes" is old', "token=QwErTyUiOpAsDfGhJkLz now", f"write to {mail} today", "the key: nothing more", "a monkey said: nothing"]
    got = [(int(r), texts[r][s:e], pii.TYPES[k]) for r, s, e, k in zip(*pii.find(pa.array(texts), w))]
    assert got == [(0, "correcthorse", "secret"), (1, "swordfishes", "secret"), (2, "QwErTyUiOpAsDfGhJkLz", "secret"), (3, mail, "email")]


def test_addresses_beyond_the_bound_and_other_numbers():
    w = pii.fit()
    mails = ["a.b.c.d.e.f.g.h.i@x.y.example.co.uk", ".".join("abcdefghijklmnopqrstuvwxyz" * 3) + "@mail.example.com", "jan@" + "x." * 50 + "example.org"]
    texts = [f"write to {m}, or call 555-123-4567." for m in mails] + ["no 123-45-6789 here", "to DE89370400440532013000 or GB82 WEST 1234 5698 7654 32 then", "from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 on", 'password = "correcthorsebatterystaple"', "at 12:30:45 on 20-10-2020 std::vector2 AB12 3456"]
    got = [(int(r), texts[r][s:e], pii.TYPES[k]) for r, s, e, k in zip(*pii.find(pa.array(texts), w))]
    want = [x for n, m in enumerate(mails) for x in ((n, m, "email"), (n, "555-123-4567", "phone"))]
    want += [(3, "123-45-6789", "ssn"), (4, "DE89370400440532013000", "iban"), (4, "GB82 WEST 1234 5698 7654 32", "iban"), (5, "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ip"), (6, "correcthorsebatterystaple", "secret")]
    assert got == want


def test_groups_of_lines_change_nothing():
    made = pii.examples(120, seed=7)
    column, w = pa.array([t for t, _ in made] + [" ".join(str(n) for n in range(3000)), None, ""]), pii.fit(n=60, rounds=15)
    one, many = (sorted(zip(*(x.tolist() for x in pii.find(column, w, size)))) for size in (1 << 20, 50))
    assert one == many and len(one) > 50


def test_pii_awkward(spark, awkward):
    assert pii.find_pii(awkward).count() == 0
    text = "é" * 30 + " write to jan.07@mail.example.com, or +1 (555) 123-4567.\n" + "lorem " * 30_000 + "10.0.0.255"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, "4111111111111111", "y")], "doc_id bigint, text string, type string")
    got = sorted(((x.doc_id or 0, x.type, text[x.start : x.end] if x.doc_id else "") for x in pii.find_pii(df).collect()))
    one = [(1, "email", "jan.07@mail.example.com"), (1, "ip", "10.0.0.255"), (1, "phone", "+1 (555) 123-4567")]
    assert got == sorted([(0, "card", ""), *one, *one])


# --- 8 substrings


def brute_repeats(docs, least_chars):
    """The same chunks, one after another in plain Python."""
    seen, out = {}, []
    for d, text in docs:
        raw = (text or "").encode()
        ends = substring.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), substring.BITS, substring.LEAST, substring.MOST).tolist()
        at, run = 0, None
        for e in ends:
            chunk = raw[at:e]
            s, t = len(raw[:at].decode()), len(raw[:e].decode())
            if chunk in seen:
                if run is None:
                    run = [d, s, t, seen[chunk]]
                run[2] = t
            elif run:
                out.append(tuple(run))
                run = None
            seen.setdefault(chunk, d)
            at = e
        if run:
            out.append(tuple(run))
    return sorted((x for x in out if x[2] - x[1] >= least_chars), key=repr)


def plain_ends(raw):
    """Chunk ends by their definition, byte by byte."""
    h, places = 0, []
    for n, b in enumerate(raw, 1):
        h = ((h << 1) + int(substring._GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - substring.BITS) == 0 and 32 <= n < len(raw) and raw[n] & 0xC0 != 0x80:
            places.append(n)
    ends = [p for k, p in enumerate(places) if k == 0 or p - places[k - 1] >= substring.LEAST] + [len(raw)]
    out, at = [], 0
    for e in ends:
        for m in range(at + substring.MOST, e, substring.MOST):
            while raw[m] & 0xC0 == 0x80:
                m -= 1
            out.append(m)
        out.append(e)
        at = e
    return out


def test_chunks_equal_their_definition():
    r = random.Random(10)
    texts = [prose(r, r.randint(1, 300)) for _ in range(20)] + ["é漢" * 900, "a" * 1000, "ab"]
    raws = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in raws])))
    got = substring.chunk_ends(np.frombuffer(b"".join(raws), np.uint8), offs, substring.BITS, substring.LEAST, substring.MOST)
    assert got.tolist() == [int(o) + e for o, x in zip(offs, raws) for e in plain_ends(x)]


def test_repeats_equal_brute_force(spark):
    r = random.Random(9)
    passages = [prose(r, 70) for _ in range(5)]
    docs = [(d, prose(r, r.randint(0, 60)) + "".join(" ü " + r.choice(passages) + " " + prose(r, r.randint(0, 20)) for _ in range(r.randint(0, 3)))) for d in range(40)]
    got = sorted(map(tuple, substring.repeats(frame(spark, docs)).collect()))
    assert sorted(got, key=repr) == brute_repeats(docs, substring.MIN_CHARS)
    found = collections.defaultdict(int)
    for d, s, e, _ in got:
        found[d] += e - s
    text, first = dict(docs), {}
    for d in range(40):  # whatever insertions surround it, a passage of 70 words is found again
        for p in passages:
            if p in text[d]:
                if p in first:
                    assert found[d] > 100
                first.setdefault(p, d)


def test_short_words_in_passages_of_just_over_50_words(spark):
    r = random.Random(12)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(1, 6))) for _ in range(n))
    docs = []
    for n in range(300):
        passage = words(51)
        docs += [(2 * n, f"{words(60)} {passage} {words(40)}"), (2 * n + 1, f"{words(45)} {passage} {words(50)}")]
    found = {x.doc_id for x in substring.repeats(frame(spark, docs)).collect()}
    assert not any(d % 2 == 0 for d in found) and len(found) >= 0.97 * 300


def test_a_chunk_in_every_text(spark):
    """A licence line in all texts: the repeats are those of brute force, and only one occurrence a slice meets the others by its digest."""
    r = random.Random(14)
    line = prose(r, 40)
    docs = [(d, prose(r, 20) + "\n" + line + "\n" + prose(r, r.randint(5, 30))) for d in r.sample(range(5000), 400)] + [(None, prose(r, 5) + "\n" + line)]
    df = frame(spark, docs).repartition(5)
    want = brute_repeats(sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)), substring.MIN_CHARS)
    assert sorted(map(tuple, substring.repeats(df).collect()), key=repr) == sorted(want, key=repr) and len(want) == 400
    chunks = df.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).mapInArrow(substring._chunks(substring.BITS, substring.LEAST, substring.MOST), "doc_id bigint, slice bigint, at bigint, mark bigint, d1 bigint, d2 bigint")
    assert chunks.where("mark >= 0").groupBy("d1", "d2").count().agg(F.max("count")).first()[0] <= 5 < chunks.where("mark < 0").count() / 100


def test_repeats_awkward(spark, awkward):
    got = [x for x in substring.repeats(awkward).collect()]
    assert {x.doc_id for x in got} <= {7, 8}  # these two repeat themselves
    df = spark.createDataFrame([(1, prose(random.Random(1), 90), 5)] * 3 + [(None, prose(random.Random(1), 90), 5)], "doc_id bigint, text string, start int")
    assert sorted((x.doc_id or 0, x.start, x.first_doc_id) for x in substring.repeats(df).collect()) == [(0, 0, 1), (1, 0, 1), (1, 0, 1)]
    assert substring.repeats(empty(spark)).count() == 0


# --- 9 sharding


def brute_shards(docs, shards):
    size = collections.Counter()
    for _, t in docs:
        size[t] += len(t or "")
    import hashlib

    key = lambda t: "" if t is None else hashlib.md5(t.encode()).hexdigest()
    heap, place = [(0, i) for i in range(shards)], {}
    for t in sorted(size, key=lambda t: (-size[t], key(t))):
        load, i = heap[0]
        place[t] = i
        heapq.heapreplace(heap, (load + size[t], i))
    return sorted((d, place[t]) for d, t in docs)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_equal_the_heap(spark, shards):
    r = random.Random(shards)
    docs = [(i, "".join(r.choice("abc") for _ in range(r.choice((0, 1, 2, 3, 3, 3, 40, 500))))) for i in range(400)]
    assert sorted(map(tuple, sharding.shard(frame(spark, docs), shards).collect())) == brute_shards(docs, shards)


def test_schedule_equals_the_heap_on_runs_of_equal_groups():
    for t in range(400):
        r = random.Random(t)
        shards = r.randint(1, 7)
        sizes = [(s, r.choice((1, 2, 5, 40, 300))) for s in r.sample(range(60), r.randint(0, 6))] + ([(5000, r.randint(1, 3))] if r.random() < 0.5 else [])
        plan, heap = {s: (a, c) for s, a, c in sharding.schedule(sizes, shards)}, [(0, i) for i in range(shards)]
        for s, n in sorted(sizes, reverse=True):
            for k in range(n):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + s, i))
                starts, cycles = plan[s]
                j = max(x for x in range(len(starts)) if starts[x] <= k)
                assert cycles[j][(k - starts[j]) % len(cycles[j])] == i


def test_ranks_among_very_many_groups_of_one_size(spark):
    docs = [(i, f"{i:06d}") for i in range(3000)] + [(5000 + i, f"{i:07d}") for i in range(5)]
    assert sorted(map(tuple, sharding.shard(frame(spark, docs).repartition(6), 7).collect())) == brute_shards(docs, 7)


def test_sharding_awkward(spark, awkward):
    got = sharding.shard(awkward, 4).collect()
    assert len(got) == awkward.count() and all(0 <= x.shard < 4 for x in got)
    assert len({x.shard for x in got if x.doc_id == 4}) == 1
    assert sharding.shard(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(awkward, 0)


# --- 10 toxicity


def toxic_set(r, n, group=""):
    out = []
    for i in range(n):
        w = prose(r, r.randint(8, 40)).split()
        if i % 4 == 0:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(("idiot", "scum", "moron")))
            if group and i % 8 == 0:
                w.insert(0, group)
        out.append((" ".join(w), int(i % 4 == 0)))
    return out


def test_toxicity_on_held_out_documents():
    r = random.Random(12)
    made = toxic_set(r, 800)
    w = toxicity.fit([t for t, _ in made[:500]], np.array([y for _, y in made[:500]]))
    p = toxicity.score(pa.array([t for t, _ in made[500:]]), w) >= 0.5
    assert (p == np.array([y for _, y in made[500:]])).mean() > 0.98


def test_counterfactual_term_evens_out_groups():
    """Group terms that stand in half of the toxic sentences only gain weight without the term, and next to none with it."""
    made = toxic_set(random.Random(13), 600, "muslims")
    texts, y = [t for t, _ in made], np.array([v for _, v in made])
    mention = pa.array(["muslims read books", "christians read books", "people read books"])
    free = toxicity.score(mention, toxicity.fit(texts, y, counterfactual=0.0))
    even = toxicity.score(mention, toxicity.fit(texts, y, counterfactual=5.0))
    assert abs(even[0] - even[1]) < 0.5 * abs(free[0] - free[1])
    assert even[0] < free[0] and even[0] < 0.5


def test_counterfactual_term_at_production_strength():
    made = toxic_set(random.Random(13), 600, "muslims")
    texts, y = [t for t, _ in made], np.array([v for _, v in made])
    mention = pa.array(["muslims read books", "christians read books"])
    free, even = (toxicity.score(mention, toxicity.fit(texts, y, counterfactual=c)) for c in (0.0, toxicity.COUNTERFACTUAL))
    assert abs(even[0] - even[1]) < 0.25 * abs(free[0] - free[1]) and even[0] < 0.5
    held = toxic_set(random.Random(77), 300, "muslims")
    told = toxicity.score(pa.array([t for t, _ in held]), toxicity.fit(texts, y)) >= 0.5
    assert (told == np.array([v for _, v in held])).mean() > 0.97


def test_swaps():
    assert toxicity.swapped("The Men, and boys") and all("Men" not in s for s in toxicity.swapped("The Men, and boys"))
    assert toxicity.swapped("nobody here") == []


def test_toxicity_awkward(spark, awkward):
    marked = labels(spark, [(5, 1, 0), (6, 0, 1), (None, 1, 1), (77, 0, 1), (4, None, None)])
    got = toxicity.classify(awkward, marked).collect()
    assert len(got) == awkward.count()
    assert not any(x.toxic for x in toxicity.classify(awkward, labels(spark)).collect())
    out = toxicity.drop_toxic(awkward, labels(spark))
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert toxicity.classify(empty(spark), marked).count() == 0


def test_toxicity_takes_no_text_to_the_driver(spark, monkeypatch):
    r = random.Random(3)
    docs = [(n, prose(r, 20) + (" idiot scum" if n % 4 == 0 else "") + (" The women, and old boys" if n % 3 == 0 else ""), "en", "s") for n in range(60)] + [(60, "", "en", "s"), (61, None, "en", "s")]
    marked = spark.createDataFrame([(n, 1, int(n % 4 == 0)) for n in range(62)], "doc_id bigint, quality int, toxic int")
    taken = []
    kind = type(marked)
    monkeypatch.setattr(kind, "toArrow", lambda df, take=kind.toArrow: taken.append(take(df)) or taken[-1])
    got = toxicity.train(frame(spark, docs).repartition(5), marked)
    assert len(taken) == 1 and "string" not in str(taken[0].schema) and taken[0].num_rows == 61
    texts = [t for _, t, *_ in docs if t is not None]
    assert (got == toxicity.fit(texts, np.array([int(n % 4 == 0) for n in range(61)]))).all() and (got != 0).sum() > 1
