"""Corpus operators on pairs, links and vectors against brute force, and the pipeline."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from prefixledger.llm import ball_tree, ngram_join, quality_rules, registry, url_filters  # noqa: E402
from prefixledger.llm.common import table  # noqa: E402
from prefixledger.llm.components import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in links:
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {"random": [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)], "path": [(k, k + 1) for k in range(60)], "star": [(7, k) for k in range(200)], "empty": []}[shape]
    frame = spark.createDataFrame([*links, (None, 3), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(frame).collect()}
    want = _roots({x for p in links for x in p if p[0] != p[1]}, links)
    assert got == want


def _sets(rows):
    out = {}
    for key, text in rows:
        w = WORD.findall((text or "").translate(UPPER))
        out[key] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def _near(rows):
    sets = _sets(rows)
    holders, common = collections.defaultdict(list), collections.Counter()
    for key, s in sets.items():
        for x in s:
            holders[x].append(key)
    for keys in holders.values():
        common.update((a, b) for i, a in enumerate(keys) for b in keys[:i])
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    return {k: (len(sets[k]), root) for k, root in _roots(sets, links).items()}


def _made(seed):
    """Originals with groups of near copies of all degrees around the threshold, a shared passage, copies and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, texts = [word() for _ in range(60)], [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e", "A b c d E"]
    for _ in range(12):
        body = [word() for _ in range(rng.randint(12, 120))]
        if rng.random() < 0.5:
            body += passage
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(body)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[rng.randint(0, 6) :]
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"block_classes": 3}), (3, {"block_classes": 2, "sketch_bits": 8})])
def test_join_equals_brute_force(spark, seed, options):
    rows = _made(seed)
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, a string, component long")
    got = {r.id: (r.n, r.component) for r in ngram_join.join(frame, **options).collect()}
    assert got == _near(rows)


def test_trie_links_equal_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        base = rng.sample(range(1000), rng.randint(5, 40))
        sets = []
        for k in range(25):
            s = set(base)
            for _ in range(rng.randint(0, 6)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(1000))
            sets.append((k, True, None, sorted(s)))
        links = ngram_join._linked(sets)
        want = [(a, b) for a in range(25) for b in range(a) if 9 * len(set(sets[a][3]) & set(sets[b][3])) >= 4 * (len(sets[a][3]) + len(sets[b][3]))]
        assert set(links) <= {(a, b) for x, y in want for a, b in ((x, y), (y, x))}
        assert _roots(range(25), links) == _roots(range(25), want)


def test_join_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (5, text), (5, text), (3, text + " end"), (None, "alone here"), (9, None), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = collections.Counter((r.id, r.n, r.component) for r in ngram_join.join(frame).collect())
    assert got == collections.Counter({(None, 26, 3): 1, (5, 26, 3): 2, (3, 27, 3): 1, (None, 1, None): 1, (9, 0, 9): 1, (None, 0, None): 1})
    kept = ngram_join.one_of_each(frame)
    assert kept.columns == frame.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter([(3, text + " end"), (None, "alone here"), (9, None), (None, None)])
    repeated = spark.createDataFrame([(1, text), (1, text), (2, "x " + text)], "doc_id long, text string")
    assert [r.doc_id for r in ngram_join.one_of_each(repeated).collect()] == [1]
    assert ngram_join.join(frame.limit(0)).count() == 0


def test_no_text_is_lost_on_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumn("_class", F.lit("clash"))
    kept = lambda rows: sorted((str(r.doc_id), r.text) for r in ngram_join.one_of_each(frame(rows)).collect())
    assert kept([(1, a), (1, b), (2, a + " x"), (3, b + " y")]) == [("1", a), ("1", b)]
    assert kept([(None, a), (2, a + " x")]) == [("2", a + " x")]
    # a null-id set bridges two that do not link with each other
    left, right = a + " " + " ".join(f"l{k}" for k in range(4)), a + " " + " ".join(f"r{k}" for k in range(4))
    rows = [(7, left), (None, a), (5, right)]
    assert _near([(7, left), (5, right)]) == {7: (30, 7), 5: (30, 5)}
    assert {r.component for r in ngram_join.join(frame(rows)).collect()} == {5}
    assert kept(rows) == [("5", right)]
    # the same where all ids are null: one of the group stays
    assert len(kept([(None, left), (None, a), (None, right), (None, b)])) == 2


def test_join_in_blocks_by_shingles(spark):
    rows = _made(6)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n, r.component) for r in ngram_join.join(frame, block_shingles=120).collect()}
    assert got == _near(rows)


def test_url_rules_and_redirects(spark):
    page = lambda url: f'<html><head><LINK  href="{url}" rel=canonical></head>'
    rows = [
        (1, "http://a.org/x", page("https://b.org/y")),
        (2, "https://B.org/y#top", '<meta content="0; url=http://shop.example.com/en/1" http-equiv="Refresh">'),
        (3, "http://www.example.com/en/2", page("http://a.org/x")),
        (4, "http://c.org/", page("http://d.org/")),
        (5, "https://e.net/fr/1", None),
        (6, "ftp://X.E.NET/fr", ""),
        (7, None, page("http://a.org/x")),
        (8, "no scheme", None),
        (9, "http://a.org/x", None),
        (10, "http://example.com/en", None),
        (11, "http://fake-example.com/en/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = url_filters.judge(pages, url_filters.html_links(pages))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.select("row.page_id", "host", "path", "rule", "verdict").collect()}
    assert got == {
        1: ("a.org", "/x", None, "block"),
        2: ("b.org", "/y", None, "block"),
        3: ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        4: ("c.org", "/", None, "allow"),
        5: ("e.net", "/fr/1", "net/fr/", "block"),
        6: ("x.e.net", "/fr", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("a.org", "/x", None, "block"),
        10: ("example.com", "/en", "com/", "allow"),
        11: ("fake-example.com", "/en/", "com/", "allow"),
    }
    assert url_filters.judge(pages.limit(0), url_filters.html_links(pages.limit(0))).count() == 0


def test_links_to_relative_targets(spark):
    link, refresh = '<link rel=canonical href="{}">', '<meta http-equiv="refresh" content="{}">'
    cases = [
        ("http://a.net/x", link.format("/es/x"), "http://a.net/es/x"),
        ("https://a.net/d/x?q=1#f", link.format("y.html"), "https://a.net/d/y.html"),
        ("https://a.net", link.format("y"), "https://a.net/y"),
        ("https://a.net/d/e/x", link.format("../y?z=../1"), "https://a.net/d/y?z=../1"),
        ("https://a.net/d/e/x", link.format("./"), "https://a.net/d/e/"),
        ("https://a.net/d/x?q=1", link.format("?q=2"), "https://a.net/d/x?q=2"),
        ("https://a.net/x", link.format("//b.net/es/x"), "https://b.net/es/x"),
        ("https://a.net/x", link.format("http://b.net/?p=1&amp;q=2"), "http://b.net/?p=1&q=2"),
        ("https://a.net/x", "<link rel=canonical data-href='http://c.net/' href=http://b.net/y>", "http://b.net/y"),
        ("https://a.net/x", '<base href="/deep/er/">' + link.format("y"), "https://a.net/deep/er/y"),
        ("https://a.net/x", refresh.format("0;http://b.net/es/"), "http://b.net/es/"),
        ("https://a.net/x", refresh.format("5; URL='/es/y'"), "https://a.net/es/y"),
        ("https://a.net/x", refresh.format("0, url=y"), "https://a.net/y"),
        ("https://a.net/x", "<meta http-equiv=refresh content=0; url=http://b.net/>", "http://b.net/"),
        ("https://a.net/x", refresh.format("30"), None),
        ("https://a.net/x", link.format("#top"), None),
        ("https://a.net/x", link.format("mailto:a@b.net"), None),
        ("no scheme", link.format("/x"), None),
    ]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = collections.Counter((r.src, r.dst) for r in url_filters.html_links(pages).collect())
    assert got == collections.Counter((u, want) for u, _, want in cases if want)
    one = pages.filter("page_id = 0")
    assert [r.verdict for r in url_filters.judge(one, url_filters.html_links(one)).collect()] == ["block"]


def _best(vectors, asks, k=5):
    ids = [i for i, v in vectors if v is not None]
    x = np.floor(256 * np.array([v for _, v in vectors if v is not None], dtype=np.float64))
    out = set()
    for i, q in zip(ids, x, strict=True):
        if asks(i):
            ranked = sorted((-int(s), j) for j, s in zip(ids, x @ q, strict=True) if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("shards", [10_000, 37])
def test_top_k_equals_brute_force(spark, shards):
    rng = np.random.default_rng(3)
    vectors = [(k, rng.choice([-0.5, 0.0, 0.25, 0.3], 6).astype("float32").tolist()) for k in range(300)]
    frame = spark.createDataFrame([*vectors, (1000, None), (1001, [None] * 6), (1050, [float("nan")] + [0.0] * 5), (None, [1.0] * 6)], "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    got = ball_tree.top_k(frame, is_query=F.col("vec_id") % 50 == 0, shard_rows=shards, query_block=4, leaf=8)
    assert {tuple(r) for r in got.collect()} == _best(vectors, lambda i: i % 50 == 0)
    assert ball_tree.top_k(frame.limit(0), is_query=F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ball_tree.top_k(frame, is_query=F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 50, 65536), (0, 2, 1, 32768), (50, 1, 0, 65536), (50, 2, 1, 32768)]


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("extra", F.lit("e"))
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    verdicts = {r.doc_id: r.kept for r in quality_rules.judge(docs, keep={"doc_id": "doc_id"}).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, v in verdicts.items() if v}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    near = _near(rows)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(k for k, (n, c) in near.items() if c == k)
    private = corpus_pipeline.pseudonymise(spark, one, sf_dir)
    assert private.columns == docs.columns and private.count() == one.count()
    mixed = corpus_pipeline.mix(spark, private, sf_dir)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.encode(spark, mixed, sf_dir)
    assert out.columns == [*docs.columns, "token_ids", "decoded"] and out.count() == mixed.count()


def test_registry(spark):
    names = list(registry.QUERIES)
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pseudonyms", "mix", "encode"]
