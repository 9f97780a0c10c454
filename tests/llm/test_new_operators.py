"""Merkle manifest, permutation index and cross-tokenizer alignment against plain Python and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from prefixledger.llm import alignment, merkle, permutation_index, registry  # noqa: E402
from prefixledger.llm.common import table  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def _proof(levels, place):
    out = []
    for level in levels[:-1]:
        run = place // 8 * 8
        out.append(("".join(level[run:place]), "".join(level[place + 1 : run + 8])))
        place //= 8
    return out


def _audit(rows):
    """Sorted result rows of the manifest, by plain Python."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(*r), r))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: (sorted(trees[t], key=lambda x: x[:3]), None) for t in order}
    built = {t: (leaves, _up([x[2] for x in leaves])) for t, (leaves, _) in built.items()}
    top = _up([built[t][1][-1][0] for t in order])
    out = []
    for rank, t in enumerate(order):
        leaves, levels = built[t]
        for place, (_, _, leaf, r) in enumerate(leaves):
            path = _proof(levels, place) + _proof(top, rank)
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                at = _leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in path:
                at = _h(left, at, right)
            out.append((r[0], leaf, levels[-1][0], top[-1][0], _h(*[x + y for x, y in path]), at, at == top[-1][0]))
    return sorted(out, key=str)


def _rows(langs, rng, most=150):
    rows = []
    for lang in langs:
        for _ in range(rng.choice([1, 1, 2, 8, 9, 64, 65, most])):
            k = rng.randrange(1000)
            rows.append((k, rng.choice(["Tea É", "", None, "plain", "X" * 300]), lang, rng.choice(["web", None, ""]), rng.choice([None, 5])))
    return rows


@pytest.mark.parametrize(("seed", "langs"), [(1, ["en", None, "de"]), (2, [f"l{k}" for k in range(70)]), (3, [""])])
def test_manifest_equals_plain_python(spark, seed, langs):
    rows = _rows(langs, random.Random(seed))
    rows += rows[:3] + [(None, "No Key", langs[0], None, None)] * 2
    frame = spark.createDataFrame(rows, DOCS).withColumn("place", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("digest", F.lit("y"))
    got = sorted((tuple(r) for r in merkle.audited(frame.repartition(3)).collect()), key=str)
    assert got == _audit(rows)


def test_manifest_of_one_row_and_none(spark):
    frame = spark.createDataFrame([(2, "A", "en", "web", 1)], DOCS)
    (row,) = merkle.audited(frame).collect()
    assert tuple(row) == _audit([(2, "A", "en", "web", 1)])[0] and row.root == row.leaf and row.proof_sha256 == _h()
    held = merkle.manifest(frame.limit(0))
    assert held.root is None and merkle.proofs(held).count() == 0


def test_requests_descend_alone_and_records_are_content_addressed(spark):
    rows = [(k, f"t{k}", "en" if k % 7 else None, "s", 1) for k in range(700)]
    held = merkle.manifest(spark.createDataFrame(rows, DOCS))
    every = {(r.tree, r.place): r for r in merkle.proofs(held).collect()}
    asked = [("en", 0), ("en", 599), (None, 99), (None, 3), ("en", 600), ("xx", 0), ("en", 0)]
    got = merkle.proofs(held, spark.createDataFrame(asked, "tree string, place long")).collect()
    assert sorted((r.tree or "", r.place) for r in got) == [("", 3), ("", 99), ("en", 0), ("en", 599)]
    assert all(every[r.tree, r.place] == r for r in got)
    for level in [*held.records, *held.top]:
        for r in level.collect():
            assert r.digest == _h(*r.children) and 1 <= len(r.children) <= 8
    # one changed sibling breaks the proof
    broken = merkle.proofs(held).select(merkle.folded(F.transform("path", lambda s: F.struct(F.regexp_replace(s["left"], "^.", "0").alias("left"), s["right"].alias("right"))), F.col("leaf")).alias("r"), "root", F.exists("path", lambda s: s["left"].rlike("^[^0]")).alias("changed"))
    assert broken.filter("changed and r = root").count() == 0


def _brute(ids, x, asks, k=10):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if asks(i):
            far = np.sqrt(((x - q) ** 2).sum(axis=1))
            out[i] = sorted((d, j) for d, j in zip(far.tolist(), ids, strict=True) if j != i)[:k]
    return out


def _by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_nearest_recall(spark, folder):
    frame = table(spark, f"/root/testdata/{folder}", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in frame.collect() if r.embedding]
    want = _brute([i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64), lambda i: i % 100 == 0)
    got = _by_query(permutation_index.nearest(frame, is_query=F.col("vec_id") % 100 == 0).collect())
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    hits = sum(len({j for _, j in got[k]} & {j for _, j in want[k]}) for k in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_nearest_recall_over_many_shards_with_pruning(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    x = np.concatenate([centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 24)), np.repeat(centres[:1], 1500, axis=0)])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = _brute(list(range(len(x))), x, lambda i: i % 100 == 0)
    got = _by_query(permutation_index.nearest(frame, is_query=F.col("vec_id") % 100 == 0, shard_rows=900, pivots=64, named=32, rerank=0.05, least=20).collect())
    hits = sum(len({j for _, j in got[k]} & {j for _, j in want[k]}) for k in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    # copies: nearest first, ties to the smaller id
    assert got[3000] == [(0.0, k) for k in range(3001, 3011)] and got[4400] == [(0.0, k) for k in range(3000, 3010)]


def test_nearest_odd_rows_are_exact(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, [4.0, 6.0]), (100, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 4.0]), (200, []), (None, [1.0, 2.0]), (0, [9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("v", F.lit("x"))
    got = permutation_index.nearest(frame, is_query=F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, 7, 5.0), (100, 1, 8, 1.0)]
    assert permutation_index.nearest(frame.limit(0), is_query=F.col("vec_id") % 100 == 0).count() == 0
    # a dimension without pivots is compared in full
    few = permutation_index.nearest(frame, is_query=F.col("vec_id") % 100 == 0, sample=1).collect()
    assert sorted(tuple(r) for r in few) == sorted(tuple(r) for r in got)


def test_footrule_equals_the_definition():
    rng = np.random.default_rng(2)
    x, pivots, named = rng.normal(size=(50, 4)), rng.normal(size=(12, 4)), 6
    shard, orders = permutation_index.Shard(4, named), permutation_index._nearest_pivots(x, pivots, named)
    for k, v in enumerate(x):
        shard.add(0, k, np.array([k]), v, None, None)
    for p in range(12):
        at = np.argwhere(orders == p)
        shard.add(1, p, None, None, at[:, 0], at[:, 1])
    shard._close()
    q = permutation_index._nearest_pivots(rng.normal(size=(1, 4)), pivots, named)[0]
    place = lambda order, p: list(order).index(p) if p in order else named
    want = np.array([sum(abs(place(q, p) - place(o, p)) for p in range(12)) for o in orders])
    got = shard.footrule(q)
    assert len(set((want - got).tolist())) == 1


def test_row_products_equal_dense():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.random((9, 7)) < 0.3, rng.random((7, 5)) < 0.4
        left = alignment.incidence(np.nonzero(x)[1], x.sum(axis=1), 7)
        right = alignment.incidence(np.nonzero(y)[1], y.sum(axis=1), 5)
        dense = np.zeros((9, 5), dtype=int)
        for row, column, value in alignment.row_products(left, right, most=6):
            dense[row, column] += value
        assert (dense == x.astype(int) @ y.astype(int)).all()
        back = right.transposed()
        assert (np.array([np.isin(np.arange(7), back.indices[back.indptr[k] : back.indptr[k + 1]]) for k in range(5)]) == y.T).all()


def _plain_alignment(rows):
    """Result rows by loops over characters of token bytes, from the libraries alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(registry.BYTE_BPE)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=registry.PIECE_BPE)
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 400))
    value = {chr(k) if k in plain else chr(next(spare)): k for k in range(256)}

    def spell_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    docs, holders = [], {}
    for key, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xs, ys = [bytes(value[c] for c in a.id_to_token(i)) for i in x], [spell_b(i) for i in y]
            if b"".join(xs) == b"".join(ys) == (" " + text).encode():
                ends_x, ends_y = np.cumsum([len(t) for t in xs]).tolist(), np.cumsum([len(t) for t in ys]).tolist()
                for cut in sorted(set(ends_x) & set(ends_y)):
                    groups.append(([], [], cut))
                for side, ids, ends in ((0, x, ends_x), (1, y, ends_y)):
                    for i, end in zip(ids, ends, strict=True):
                        next(g for g in groups if g[2] >= end)[side].append(i)
        links = [(i, j) for g in groups for i in g[0] for j in g[1]]
        docs.append((key, groups, links))
        for pair in set(links):
            holders[pair] = holders.get(pair, 0) + 1
    best = {}
    for (i, _), n in holders.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for key, groups, links in docs:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def _texts():
    rng = random.Random(9)
    parts = ["the ", "token", "isation", " ", "\n", "Éa", "日本語", "🙂", "  ", "<s>", "<|endoftext|>", "<0x41>", "1234", "'s", "zqx", "\x00", "ﬁ", "é"]
    odd = ["", " ", None, "a▁b", "x" * 5000, "日本" * 400, "same text here", "same text here"]
    return odd + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(120)]


@pytest.mark.parametrize("frequent", [1_000_000, 40, 0])
def test_alignment_equals_plain_python(spark, sf_dir, frequent):
    rows = list(enumerate(_texts())) + [(None, "no key"), (3, "again")]
    rows += [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").limit(25).collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pairs", F.lit(1)).withColumn("row", F.lit(2))
    got = alignment.digests(frame, registry.BYTE_BPE, registry.PIECE_BPE, frequent=frequent).collect()
    assert sorted((tuple(r) for r in got), key=str) == _plain_alignment(rows)


def test_both_encoders_give_the_same_ids():
    own = alignment.aligner(registry.BYTE_BPE, registry.PIECE_BPE)
    assert own.fast is not None
    rng = random.Random(3)
    parts = ["a", "B", "the", "ing", "é", "ß", "日", "🙂", "1", "²", "\u0300", "'s", "'", "<|endoftext|>", "\x00", "\u200d", "\ufeff", "\u3000", "\x85", "\xa0", " ", "  ", "\n", "\t", "\x1c", "ſ", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += [" " * 100_000 + "x", "\n" * 3000, "a" * 50_000, "x" + " " * 499 + "y", "q" * 3 + "\u3000" * 700]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0xD800)])) for _ in range(50)) for _ in range(500)]
    assert own._encode_a(texts) == [e.ids for e in own.a.encode_batch(texts, add_special_tokens=False)]


def test_alignment_of_no_rows_and_of_small_runs(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digests(frame, registry.BYTE_BPE, registry.PIECE_BPE).count() == 0
    own = alignment.aligner(registry.BYTE_BPE, registry.PIECE_BPE)
    block = own.block([x for x in own.tokens(["unusual tokenisation 日本", "of texts"]) if x])
    whole = [tuple(map(tuple, p)) for p in own.links(block)]
    over = {(i, j): v for rows in own.overlaps(block) for i, j, v in zip(*map(np.ndarray.tolist, rows), strict=True)}
    assert sum(over.values()) == len(" unusual tokenisation 日本".encode()) + len(b" of texts")
    pairs = {(i, j) for rows in whole for i, j in zip(*rows, strict=True)}
    assert set(over) <= pairs and all(block.a_group[i] == block.b_group[j] for i, j in pairs)
