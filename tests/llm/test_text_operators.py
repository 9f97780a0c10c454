"""Per-document corpus operators against the libraries and plain Python, edge cases included."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from prefixledger.llm import bpe, id_planes, mixing, pseudonyms, quality_cnn, quality_rules, token_counts  # noqa: E402
from prefixledger.llm.common import table  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "  two  spaces \n and lines\n", "<|endoftext|>x don't 's''s 1234 ﬁßİ", "中文 字한 🙂 \x1c\x85 x", "▁mark", "x" * 300_000, "ab " * 60_000]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Null keys and columns, empty and very long texts, repeated rows, and columns named like our own."""
    rows = [(None if k == 3 else k, t, None, "s", 1, "x") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string, source string, size long, row string")


def _pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_bpe_equals_the_library(docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    for frame in (docs, odd):
        got = collections.Counter(tuple(r) for r in bpe.digests(frame, BPE).collect())
        want = collections.Counter()
        for key, text in _pairs(frame):
            ids = library.encode(text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want[key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
        assert got == want


def test_bpe_cuts_anywhere_in_random_text():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), bpe.Encoder(BPE)
    rng = random.Random(3)
    letters = [*"abcXYZé'sdt re 12٣<|>!?.,\t\n\x1c\x85  ̸́ﬁßİ中한🙂‍_-", "<|startoftext|>", "<|endoftext|>", "'ll", "''s"]
    for _ in range(4_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_ids_column_replaces_and_keeps_the_rest(odd):
    out = bpe.with_ids(odd.withColumn("token_ids", F.lit("old")), BPE, decoded="decoded")
    assert out.columns == [*odd.columns, "token_ids", "decoded"]
    assert out.filter("doc_id = 4").first().token_ids and out.filter("text is null and size(token_ids) > 0").count() == 0
    assert bpe.with_ids(odd.limit(0), BPE).count() == 0


def test_token_counts_equal_the_library(docs, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for frame in (docs, odd):
        got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(frame, PIECE).collect())
        counts = [(k, len((t or "").encode()), len(library.encode(t or ""))) for k, t in _pairs(frame)]
        assert got == collections.Counter((k, b, n, n > 4096) for k, b, n in counts)
    assert token_counts.token_counts(docs.limit(0), PIECE).count() == 0


def test_token_counts_of_random_text():
    own = token_counts.Counts(PIECE, {})
    rng = random.Random(5)
    letters = [*"abcXé' 12٣<|>!.\t\n\r\x1c  ́ﬁ中🙂_-", "<s>", "<0x0A>", "▁", "  ", "\n\n", " \n "]
    for _ in range(6_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert own.count(text) == len(own.library.encode(text)), text


def test_id_planes_round_trip_of_blocks():
    rng = np.random.default_rng(1)
    for high in (1, 2, 255, 49_408, 2**32):
        ids = rng.integers(0, high, 1000).astype("<u4")
        assert (id_planes.from_planes(id_planes.to_planes(ids), len(ids)) == ids).all()


def test_id_planes_files(docs, odd):
    own = bpe.Encoder(BPE)
    for frame in (docs, odd):
        folder = id_planes.stored_path(frame.sparkSession)
        files = id_planes.write(frame.repartition(5), folder, BPE, block_ids=1000)
        got = sorted((tuple(r) for r in id_planes.read_digests(files).collect()), key=lambda r: r[1])
        counted = collections.Counter((r[0], r[2], r[3]) for r in got)
        want = collections.Counter()
        for key, text in _pairs(frame):
            ids = np.concatenate([own.encode(text), np.array([1], "<u4")])
            want[key, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert counted == want
        assert [r[0] or -1 for r in got] == sorted(r[0] or -1 for r in got)
        at = 0
        for _, start, n, _ in got:
            assert start == at
            at += n
    assert id_planes.written_and_read(docs.limit(0), BPE).count() == 0


def _luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_stay_valid_and_linked(spark):
    texts = ["pay 4111111111111111 or 4111 1111 1111 1111 not 4111111111111112", "+1 (017) 555-7713 and 10.0.0.255, 300.1.1.1", "born 2001-02-28 or 31.12.1999 or 12/25/2020, never 2021-02-30", "ssn 123-45-6789 000-12-3456", "é.x@a.example.com", 'token = "' + "AB" * 20 + '"']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "doc_id long, text string")
    got = {r.row.doc_id: r.new_text for r in pseudonyms.pseudonymised(rows, "k").collect()}
    assert [got[k] for k in range(6)] == [got[k + 6] for k in range(6)]
    one, two = re.findall(r"\b(\d{16})\b", got[0])[0], re.search(r"\d{4} \d{4} \d{4} \d{4}", got[0]).group().replace(" ", "")
    assert one == two != "4" + "1" * 15 and _luhn(one) and "4111111111111112" in got[0]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1]) and "555-7713" not in got[1] and got[1].endswith("300.1.1.1")
    assert "10.0.0.255" not in got[1] and all(int(x) < 256 for x in re.search(r"(\d+)\.(\d+)\.(\d+)\.(\d+),", got[1]).groups())
    dates = [re.search(p, got[2]).group(1) for p in (r"born (\d{4}-\d\d-\d\d)", r"or (\d\d\.\d\d\.\d{4})", r"or (\d\d/\d\d/\d{4}),")]
    assert spark.sql(f"select date'{dates[0]}', to_date('{dates[1]}', 'dd.MM.yyyy'), to_date('{dates[2]}', 'MM/dd/yyyy')").first() and "2021-02-30" in got[2]
    assert "123-45-6789" not in got[3] and "000-12-3456" in got[3]
    assert "é.x@a" not in got[4] and re.fullmatch(r'token = "[0-9A-F]{40}"', got[5]) and "ABAB" not in got[5]
    assert pseudonyms.pseudonymised(rows, "other").filter("row.doc_id = 0").first().new_text != got[0]


def test_phones_in_all_written_forms(spark):
    one = ["+14155552671", "+1-415-555-2671", "+1.415.555.2671", "+1 415 555 2671", "+1 (415) 555-2671", "+1(415)5552671", "+1/415/555-2671"]
    two = ["+4915112345678", "+49 151 12345678", "+49-151-12345678", "+49 (151) 12345678", "+49 151 1234 5678", "+49151/12345678", "+49 15 11 23 45 67 8"]
    more = ["+358401234567", "+33 1.42.68.53.00", "+44 20 7946 0958", "+81-3-1234-5678", "+99 5551234", "+1 4155552", "+999 12345678901234", "+498912345678-90"]
    rows = spark.createDataFrame(list(enumerate(f"call {t}, please" for t in one + two + more)), "doc_id long, text string")
    got = {r.row.doc_id: r for r in pseudonyms.pseudonymised(rows, "k").collect()}
    digits = lambda t: re.sub(r"\D", "", t)
    for k, t in enumerate(one + two + more):
        new = re.fullmatch("call (.*), please", got[k].new_text)[1]
        assert got[k].n_phone == 1 and digits(new) != digits(t) and digits(new)[0] == digits(t)[0], t
        assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", t)
    assert len({digits(got[k].new_text) for k in range(len(one))}) == len({digits(got[k].new_text) for k in range(len(one), len(one + two))}) == 1
    assert digits(got[0].new_text)[:1] == "1" and digits(got[len(one)].new_text)[:2] == "49"
    # neighbours keep their own kind; too few or too many digits are no number
    texts = ["+49 151 12345678 2001-02-28", "+49 151 12345678 4111 1111 1111 1111", "+44 20 7946 0958 10.0.0.255", "+49 151 12345678 123-45-6789", "+1 (415) 555-2671 99", "+4915112345678 99", "(+44 20 7946 0958) 99"]
    out = [(r.new_text, r.n_phone, r.n_date + r.n_card + r.n_ip + r.n_ssn) for r in pseudonyms.pseudonymised(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "k").collect()]
    assert [n[1:] for n in out] == [(1, 1)] * 4 + [(1, 0)] * 3 and all(t.endswith(("99", ") 99")) for t, _, n in out if not n)
    plain = ["+1234567", "+123456789012345678", "x+14155552671", "+0 415 555 2671", "a + 14155552671"]
    assert sorted(r.new_text for r in pseudonyms.pseudonymised(spark.createDataFrame([(t,) for t in plain], "text string"), "k").collect()) == sorted(plain)


def test_phones_are_a_permutation(spark):
    """Written with and without gaps, all numbers of some ranges map one to one."""
    rows = spark.range(10_000).selectExpr("explode(array(concat('+1415555', lpad(id, 4, '0')), concat('+', 10000000 + id * 8999), concat('+', 200000000 + id * 79999))) as text")
    out = pseudonyms.pseudonymised(rows, "k").select("new_text", "n_phone")
    assert out.distinct().count() == 30_000 and out.filter("n_phone <> 1").count() == 0


def test_pseudonyms_are_a_permutation(spark):
    """All values of a small format: 10,000 addresses and 1,000 days map one to one within their format."""
    ips = spark.range(10_000).selectExpr("id as doc_id", "concat('10.1.', id div 256, '.', id % 256) as text")
    out = pseudonyms.pseudonymised(ips, "k").select("new_text")
    assert out.distinct().count() == 10_000 and out.filter(r"not new_text rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$'").count() == 0
    days = spark.range(1_000).selectExpr("id as doc_id", "cast(date_add(date'1999-01-01', cast(id as int)) as string) as text")
    out = pseudonyms.pseudonymised(days, "k").select("new_text")
    assert out.distinct().count() == 1_000 and out.filter("try_cast(new_text as date) is null").count() == 0


def test_pseudonyms_leave_the_rest(docs, odd):
    out = pseudonyms.replace_text(odd, "k", n_chars="size")
    assert out.columns == odd.columns and sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    got = pseudonyms.pseudonymised(docs, "k")
    found = regex.compile(pseudonyms.PATTERN)
    plain = [r for r in got.collect() if not found.search(r.row.text or "")]
    assert plain and all(r.row.text == r.new_text for r in plain)
    assert pseudonyms.pseudonymised(docs.limit(0), "k").count() == 0


def _statistics(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    seen, covered = collections.Counter(windows), set()
    for k, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(docs, odd):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for frame in (docs, odd):
        got = quality_rules.judge(frame, keep={"doc_id": "doc_id", "t": "text"}).collect()
        assert len(got) == frame.count()
        for r in got:
            n = _statistics(r.t)
            assert tuple(r[c] for c in names) == n
            assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    assert quality_rules.judge(odd.limit(0)).count() == 0


def _mcd(x, support=quality_rules.SUPPORT):
    """Robust estimate of integer features in numpy: (rows, estimate, uncorrelated start), an estimate being centre and covariance."""
    q, n = quality_rules, len(x)
    floors, s = np.diag(np.array(q.FLOORS) ** 2), q.SCALE
    m = np.median(x, axis=0)
    d = np.median(np.floor(np.abs(x - m)), axis=0)
    sd = np.sqrt((d * 1.4826 / s) ** 2 + np.array(q.FLOORS) ** 2)
    m = m / s
    z = (x / s - m) / sd
    lengths = np.linalg.norm(z, axis=1, keepdims=True)
    starts = [np.diag(sd**2)]
    for y in (np.tanh(z), np.divide(z, lengths, out=np.zeros_like(z), where=lengths > 0)):
        t = np.floor(np.abs(y[:, :, None] * y[:, None, :] * 2**20) + 0.5) * np.sign(y[:, :, None] * y[:, None, :])
        t = t.sum(axis=0)
        own = np.sqrt(np.outer(np.diag(t), np.diag(t)))
        r = np.divide(t, own, out=np.zeros_like(t), where=own > 0) * 0.9
        np.fill_diagonal(r, 1.0)
        starts.append(r * np.outer(sd, sd))

    def step(model):
        m, cov, det = model
        d = _squared(x, m, cov)
        bins, h = np.floor(np.log2(d + 1) * q.BINS), int(np.ceil(n * support))
        reach = np.sort(bins)[h - 1]
        weight = np.where(bins < reach, 1.0, np.where(bins == reach, (h - (bins < reach).sum()) / (bins == reach).sum(), 0.0))
        mean = (weight[:, None] * x).sum(axis=0) / h
        new = ((weight[:, None] * x).T @ x / h - np.outer(mean, mean)) * q.consistency(support) / s**2 + floors
        return (mean / s, new, np.linalg.slogdet(new)[1]) if det is None or np.linalg.slogdet(new)[1] < det else model

    models = [(m, c, None) for c in starts]
    for _ in range(q.TRIAL_STEPS):
        models = [step(k) for k in models]
    best = min(models, key=lambda k: k[2])
    for _ in range(q.STEPS):
        best = step(best)
    return n, best[:2], (m, starts[0])


def _squared(x, m, cov):
    z = np.linalg.solve(np.linalg.cholesky(cov), (x / quality_rules.SCALE - m).T)
    return (z**2).sum(axis=0)


def _expected_distances(rows):
    """Distance of every (key, text, lang, source): its pair's estimate drawn towards the language's and the table's."""
    x = {}
    for key, text, _, _ in rows:
        n, chars, symbols, lines, repeats = _statistics(text)
        x[key] = [np.floor(v * quality_rules.SCALE + 0.5) for v in (np.log((chars + 1.0) / (n + 1.0)), (symbols / n) ** 0.5, (lines / n) ** 0.5, (repeats / n) ** 0.5)]

    def drawn(members, prior):
        n, own, start = _mcd(np.array([x[k] for k in members]))
        w = n / (n + quality_rules.PRIOR_ROWS)
        return tuple(w * a + (1 - w) * b for a, b in zip(own, prior or start, strict=True))

    table, out = drawn([r[0] for r in rows], None), {}
    for lang in {r[2] for r in rows}:
        of_lang = drawn([r[0] for r in rows if r[2] == lang], table)
        for source in {r[3] for r in rows if r[2] == lang}:
            members = [r[0] for r in rows if r[2:] == (lang, source)]
            out |= dict(zip(members, _squared(np.array([x[k] for k in members]), *drawn(members, of_lang)), strict=True))
    return out


def test_outliers_equal_numpy(spark):
    rng = random.Random(2)
    words = ["ab", "cde", "fghi", "jklmn", "opqrst"]
    rows = []
    for k in range(400):
        body = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(30, 80))]
        if k % 9 == 0:
            body = [w + rng.choice(["###", "$$$"]) for w in body]
        rows.append((k, " ".join(body), "en" if k % 2 else None, "s" if k % 4 else None))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(frame, keep={"doc_id": "doc_id"}).collect()}
    for k, distance in _expected_distances(rows).items():
        assert got[k].distance == pytest.approx(distance, rel=1e-6) and got[k].kept == (distance <= quality_rules.CUTOFF)
    assert not any(got[k].kept for k in range(0, 400, 9)) and all(got[k].kept for k in range(400) if k % 9)
    assert sorted(r.doc_id for r in quality_rules.keep_good(frame).collect()) == sorted(k for k, r in got.items() if r.kept)


@pytest.mark.parametrize(
    "sizes",
    [
        {("en", "s"): 60, ("en", "t"): 8, ("de", "s"): 30, ("de", "t"): 25, ("fr", "s"): 20, ("es", "s"): 18, (None, None): 14},
        {("en", "s"): 60, ("fr", "s"): 9, ("es", "s"): 1},
        {("en", "s"): 7, ("fr", None): 5},
        {("en", "s"): 60},
    ],
)
def test_every_row_has_a_distance(spark, sizes):
    rng, rows = random.Random(6), []
    for (lang, source), n in sizes.items():
        for k in range(n):
            body = [rng.choice(["ab", "cde", "fghi", "jklmn"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(30, 80))]
            rows.append((len(rows), " ".join(w + "###" if k % 9 == 4 else w for w in body), lang, source))
    frame = spark.createDataFrame([*rows, (-1, "too short", "it", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(frame, keep={"doc_id": "doc_id"}).collect()}
    assert got.pop(-1).distance is None and len(got) == len(rows)
    for key, distance in _expected_distances(rows).items():
        assert got[key].distance == pytest.approx(distance, rel=1e-6) and got[key].kept == (distance <= quality_rules.CUTOFF)
    assert all(r.kept == ("###" not in rows[k][1]) for k, r in got.items())
    assert sorted(r.doc_id for r in quality_rules.keep_good(frame).collect()) == sorted(k for k, r in got.items() if r.kept)


def test_determinants_do_not_rise(spark):
    """Every concentration step keeps or lowers each group's determinant, and the best start goes on."""
    rng = np.random.default_rng(8)
    core = np.round(rng.normal(0, 60, (300, 4)) @ np.array([[1, 0.8, 0, 0], [0, 1, 0.5, 0], [0, 0, 1, 0], [0, 0, 0, 1]])).astype(int)
    core[::6] += 500
    rows = quality_rules.cut_lineage(spark.createDataFrame([(k % 2, *map(int, r)) for k, r in enumerate(core)], ["g", *quality_rules.FEATURES]))
    model, seen = quality_rules.cut_lineage(quality_rules._starts(rows, ["g"], True)), []
    tried = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    for _ in range(4):
        model = quality_rules.cut_lineage(quality_rules._concentrate(tried, model, ["g", "start"], quality_rules.SUPPORT, True))
        seen.append({(r.g, r.start): r.half_log_det for r in model.collect()})
    assert len(seen[0]) == 6 and all(b[k] <= a[k] for a, b in zip(seen, seen[1:], strict=False) for k in a)
    got = {r.g: r for r in quality_rules.estimates(rows, ["g"]).collect()}
    for g in (0, 1):
        n, (m, cov), _ = _mcd(core[g::2])
        low = np.zeros((4, 4))
        for i in range(4):
            low[i, : i + 1] = [got[g][f"l{i}{j}"] for j in range(i + 1)]
        assert got[g].n == n and np.allclose([got[g][f"m{i}"] for i in range(4)], m) and np.allclose(low @ low.T, cov)


def test_quality_of_odd_rows(odd):
    """Rows that fail the base rules have no distance; a kept column may not take a name of the result."""
    got = quality_rules.judge(odd, keep={"doc_id": "doc_id"}).collect()
    assert all(r.base_failed == (r.distance is None) and not (r.kept and r.base_failed) for r in got)
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    with pytest.raises(ValueError, match="n_words"):
        quality_rules.judge(odd, keep={"n_words": "doc_id"})


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        weights = sum(weight[s] for s in order if s not in stopped)
        target = {s: 3.0 * sizes[s] if s in stopped else rest * weight[s] / weights for s in order}
        over = {s for s in order if s not in stopped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        stopped |= over


def test_mix_targets(spark, docs):
    sizes = {"a": 1000, "b": 10, "c": 300, "é": 7, None: 50, "z": 0, "B": 4000}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(_targets(sizes))
    one = mixing.copies(docs).select("row.doc_id", "size", "source_size", "target", "copies")
    again = mixing.copies(docs.repartition(7)).select("row.doc_id", "size", "source_size", "target", "copies")
    assert sorted(one.collect()) == sorted(again.collect())
    assert one.filter("copies > 3 or copies < 0").count() == 0
    taken = one.selectExpr("size * copies t", "target", "source_size").groupBy("target", "source_size").agg(F.sum("t").alias("t")).collect()
    assert sum(r.t for r in taken) == pytest.approx(sum(r.target for r in taken), rel=0.2)


def test_mix_keeps_rows_and_odd_cases(docs, odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.filter("text is null or text = ''").count() <= 4 * 12
    assert mixing.mixed(docs.limit(0)).count() == 0
    copies = sum(r.copies for r in mixing.copies(docs).select("copies").collect())
    assert mixing.mixed(docs).count() == copies


def test_network_gradients():
    """Analytic gradients against differences, at a point without ties."""
    w = {k: v.astype(np.float64) for k, v in quality_cnn.start_weights(3).items()}
    w["bias"] += 0.05  # padding alone would stand on the bend of the rectifier
    rng = np.random.default_rng(9)
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (700, 90)] + [b""]
    laid, segments = quality_cnn._laid(texts)
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := quality_cnn._forward(w, laid, segments)["p"]) + (1 - y) * np.log(1 - p))
    g = quality_cnn._gradients(w, quality_cnn._forward(w, laid, segments, train=True), y)
    for name, at in (("near", (5, 3)), ("far", (2, 7)), ("chunk", (3, 4)), ("out", (2,)), ("embed", (101, 2)), ("bias", (4,)), ("out_bias", (0,))):
        old = w[name][at]
        w[name][at] = old + 1e-5
        up = loss()
        w[name][at] = old - 1e-5
        down = loss()
        w[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=2e-5), name


def test_network_long_texts_in_parts():
    w = quality_cnn.start_weights(1)
    rng = np.random.default_rng(4)
    text = rng.integers(32, 127, 3 * quality_cnn.SLICE_BYTES + 777).astype(np.uint8).tobytes()
    whole = quality_cnn._forward(w, *quality_cnn._laid([text]))["p"]
    assert quality_cnn.score_texts(w, [b"a", text, b""])[1] == pytest.approx(whole[0], rel=1e-3)
    assert len(quality_cnn.score_texts(w, [])) == 0


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = quality_cnn.score(docs, quality_cnn.fit(docs, labels))
    rows = out.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.85
    assert (rows[rows.quality == 1].predicted == 1).mean() > 0.9
    assert out.count() == docs.count() and out.filter("score is null or score < 0 or score > 1").count() == 0


def test_quality_odd_rows(odd):
    labels = odd.selectExpr("doc_id", "1 as quality")
    out = quality_cnn.score(odd, quality_cnn.fit(odd, labels.limit(0))).collect()
    assert len(out) == odd.count() and all(r.score == 0.5 for r in out)
    assert quality_cnn.score(odd.limit(0), quality_cnn.start_weights()).count() == 0


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_bpe_encodes_a_batch_at_once():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), bpe.Encoder(BPE)
    calls = []
    plain = own._fragments
    own._fragments = lambda texts, ends: calls.append(len(texts)) or plain(texts, ends)
    texts = [None, "", " ", *[f"{x}o{y}inté{x}{y} N{x}a{y}e. ¿x{x}{y}ß" for x in _LETTERS for y in _LETTERS], "a\x1cb c", "<|endoftext|>x y"]
    ids, at = own.encode_all(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(calls) <= 2 and sum(calls) > 600
    assert [x.tolist() for x in own.encode_all(pa.array([], pa.string()))] == [[], [0]]


def test_caches_stay_within_their_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 40 * bpe.ENTRY_BYTES)
    own, most = bpe.Encoder(BPE), 0
    for k in range(200):
        own.encode(" ".join(f"w{k * 10 + i}" for i in range(10)))
        most = max(most, len(own.words) + len(own.old_words))
    assert 40 <= most <= 100


def test_a_stage_leaves_nothing_in_its_worker():
    from prefixledger.llm import common

    common.worker_object("kept", lambda: "object")
    given = []

    def run(batches):
        assert not common._HELD
        yield from batches
        given.append(True)

    assert list(common.tidied(run)([1, 2])) == [1, 2] and given
