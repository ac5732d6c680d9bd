"""Corpus operators against brute force, exact round trips or held-out accuracy, and the shared edge cases."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import check, connect  # noqa: E402

from tesserae.llm import common, op01_ngram_join, op02_language_id, op03_packing, op04_nearest, op05_sentencepiece, op06_pii, op07_quotations, op08_line_dedup, op09_quality, op10_secret_scans, registry  # noqa: E402
from tesserae.llm.hilbert import hilbert_keys  # noqa: E402
from tesserae.llm.shingles import shingle_set  # noqa: E402
from tesserae.llm.trie import SetTrie  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, component string, th string, id string, _starts string"
WORDS = "the of to and in that is was for on are with as his they at be this have from".split()


def frame(spark, rows):
    """Documents with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(*r, 1, "c", "t", "i", "s") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty texts, repeated rows and ids, a very long text, texts of one word."""
    long = " ".join(random.Random(5).choice(WORDS) + str(i % 977) for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word", "en", None, 4), (3, "word", "en", None, 4), (None, "a b c d e f g h i j k", None, "s", 9), (4, long, "en", "s", len(long)), (5, " \t\n ", "de", "s", 4), (6, "one two three", None, "s", 1), (7, "one two three", "fr", "s", 1), (8, "one two three", "fr", "s", None)]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.where("false")


def near_copies(seed, families, size, edits):
    r = random.Random(seed)
    docs = []
    for _ in range(families):
        base = [r.choice(WORDS) + str(r.randrange(60)) for _ in range(r.randrange(3, 160))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(edits + 1)):
                w[r.randrange(len(w))] = str(r.random())
            docs.append(" ".join(w))
    r.shuffle(docs)
    return list(enumerate(docs))


def brute_components(docs, k, num):
    sets = {d: shingle_brute(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if 100 * i >= num * (len(sets[a]) + len(sets[b]) - i):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def shingle_brute(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, name):
    check(spark, connect(SMALL), SMALL, registry.queries()[name], registry.oracle_sql()[name])


def test_shingle_sets_count_like_strings():
    for text in ["", " ", "a", "a b", "A b a B a b", "x\ty\nz\x0bq \x1cw é É", "é ß Ⅷ 好 " * 50]:
        assert len(shingle_set(text.encode(), 3)) == len(shingle_brute(text, 3))
    big = ("abc defg " * 200_000).encode()
    assert len(shingle_set(big, 3)) == 2


def test_trie_equals_brute_force():
    r = np.random.default_rng(5)
    for _ in range(60):
        base = np.unique(r.integers(0, 1 << 63, int(r.integers(3, 900)), dtype=np.uint64))
        sets = {j: base[r.random(len(base)) > r.choice([0, 0.02, 0.05, 0.2])] for j in range(10)}
        trie = SetTrie(90, 100)
        for j, x in sets.items():
            trie.add(j, x)
        for x in sets.values():
            want = {i for i, y in sets.items() if len(x) and len(y) and 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y))}
            assert {i for i, _ in trie.search(x)} == want


def test_linked_sets_share_a_head_token():
    r = np.random.default_rng(7)
    levels = r.integers(0, 20, 1 << op01_ngram_join.SKETCH_BITS).astype(np.uint8)
    for num in (90, 80):
        for _ in range(3000):
            n = int(r.integers(1, 400))
            base = r.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
            cut, more = (int(r.integers(0, max(1, n // 6) + 1)) for _ in range(2))
            x, y = np.unique(base[:n]), np.unique(np.concatenate([base[cut:n], base[n : n + more]]))
            i = len(np.intersect1d(x, y))
            if 100 * i >= num * (len(x) + len(y) - i):
                one, two = (op01_ngram_join.head(s, levels, num, 100) for s in (x, y))
                assert len(one) == len(x) - -(-num * len(x) // 100) + 1 and len(np.intersect1d(one, two))


def test_sketch_rows_add_up():
    r = np.random.default_rng(3)
    total, want = np.zeros(1 << op01_ngram_join.CHUNK_BITS, np.uint64), np.zeros(1 << op01_ngram_join.CHUNK_BITS, np.uint64)
    for filled in (0.001, 0.5, 0.05, 1):
        counts = (r.integers(0, 1 << 32, len(total), dtype=np.uint32) * (r.random(len(total)) < filled)).astype(np.uint32)
        op01_ngram_join._add_packed(total, op01_ngram_join._packed(counts))
        want += counts
    assert (total == want).all()


@pytest.mark.parametrize("k,num,block", [(3, 90, None), (5, 80, 8), (3, 80, 4)])
def test_ngram_components(spark, monkeypatch, k, num, block):
    """block: small enough that groups take several blocks, and sets search the blocks of others."""
    if block:
        monkeypatch.setattr(op01_ngram_join, "BLOCK", block)
    docs = near_copies(k + num, 6, 30, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op01_ngram_join.ngram_components(df, k, num, 100).collect()}
    assert got == brute_components(docs, k, num)


def test_ngram_jobs_do_not_grow_with_unlike_sets_that_share_words(spark, monkeypatch):
    """Sets of one phrase and words of their own, some of them alike: groups of many unlike sets."""
    monkeypatch.setattr(op01_ngram_join, "BLOCK", 8)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for size in (40, 160):
        r = random.Random(size)
        docs = [(i, " ".join(["one two three four five six seven"] + [str(r.randrange(9)) for _ in range(3)])) for i in range(size)]
        before = len(tracker.getJobIdsForGroup(None))
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in op01_ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 60, 100).collect()}
        assert got == brute_components(docs, 3, 60)
        jobs.append(len(tracker.getJobIdsForGroup(None)) - before)
    assert jobs[1] <= 2 * jobs[0] + 20


def test_ngram_ids_of_several_texts_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (2, "p q r s t u"), (5, "a b c d e f"), (5, "p q r s t u"), (7, "x y z x y z w"), (None, "x y z x y z w"), (None, "alone in the world"), (9, "k"), (9, "k")]
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in op01_ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect())
    assert got == [(0, 2, 0), (0, 4, 7), (1, 4, 1), (2, 4, 1), (5, 4, 1), (5, 4, 1), (7, 4, 7), (9, 1, 9), (9, 1, 9)]


@pytest.mark.parametrize("one_task", [0, common.ONE_TASK])
def test_connected_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK", one_task)
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[1100] == 1000 and all(got[a] == got[b] for a, b in links if a != b) and all(c <= n for n, c in got.items())
    assert len({*got.values()}) == len({n for n, c in got.items() if n == c})


def test_language_accuracy_and_leakage(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = op02_language_id.op2_language_id(spark, "/root/testdata/sf0.01").withColumnRenamed("doc_id", "i")
    rows = got.join(docs, got.i == docs.doc_id).toPandas()
    held = rows[rows.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98 and rows.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out))
    one = op02_language_id.predict_language(docs.limit(1).select(F.lit(9).cast("long").alias("doc_id"), F.lit("12 34!").alias("text")), op02_language_id.fit(docs.limit(50))).first()
    assert (one.lang_pred, one.score) == ("und", 0.0)


def test_codewords_differ():
    for k in (1, 2, 4, 7, 20):
        code = op02_language_id.codewords(k)
        assert len(code) == k == len({tuple(c) for c in code})


def test_n_grams_do_not_depend_on_pieces(monkeypatch):
    text = "abc dé, fgh".encode() * 500
    count = lambda: np.bincount(np.concatenate(list(op02_language_id._grams(text))), minlength=op02_language_id.BUCKETS)
    whole = count()
    monkeypatch.setattr(op02_language_id, "_STEP", 100)
    assert (whole == count()).all()


def test_packing_kinds_hold_every_length():
    for seed, n in enumerate((1, 30, 3000, 100_000)):
        r = random.Random(seed)
        counts = Counter(r.choice([r.randrange(1, 2049), r.randrange(1, 300)]) for _ in range(n))
        first = op03_packing.best_fit(counts, 2048)
        best = op03_packing.local_search(first, 2048)
        held = Counter()
        for lengths, m in best:
            assert sum(lengths) <= 2048
            for x in lengths:
                held[x] += m
        assert held == counts and sum(m for _, m in best) <= sum(m for _, m in first)


def test_local_search_empties_sequences():
    loose = [[[6], 1], [[5], 1], [[4, 3], 1], [[2], 1]]  # capacity 10: 20 of 40 used
    assert sum(m for _, m in op03_packing.local_search(loose, 10)) == 2


def test_local_search_ends_where_no_exchange_is_left():
    r = random.Random(6)
    counts = Counter(min(2048, max(1, round(r.lognormvariate(6.5, 0.6)))) for _ in range(20_000))
    held, capacity = op03_packing.local_search(op03_packing.best_fit(counts, 2048), 2048), 2048
    loose = Counter()
    for k, m in held:
        if sum(k) < capacity:
            loose[tuple(sorted(k))] += m
    total = Counter()
    for k, m in held:
        total.update({x: c * m for x, c in Counter(k).items()})
    assert total == counts
    for take in loose:
        room = capacity - sum(take)
        sums = {0, *take, *(x + y for i, x in enumerate(take) for y in take[i + 1 :])}
        can = {x for s in sums for x in range(s + 1, s + room + 1)}
        for give in loose:
            if sum(give) <= sum(take) and (give != take or loose[take] > 1):
                assert can.isdisjoint(give)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    files = op03_packing.vocabulary_files()
    library = Tokenizer.from_file(files[1])
    docs = [(i, t) for i, t in enumerate(["", None, "a  b", "x <|endoftext|> y", "w\n \n z " * 900, "hello world " * 2000, "é好😀 'll we're 12 345"])]
    rows = op03_packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), files).collect()
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    held = defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length
        held[r.sequence_id].append((r.offset, r.length))
    for d, x in ids.items():
        pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == d)
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == len(x)
        assert all(p[2] == 2048 for p in pieces[1:])
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) == -(-sum(map(len, ids.values())) // 2048)


def test_words_encode_like_whole_texts():
    encode, words, library = op03_packing._worker(*op03_packing.vocabulary_files())
    r = random.Random(2)
    for _ in range(2000):
        text = "".join(r.choice("ab'sé好\n\t 1.,<|>  ") for _ in range(r.randrange(60)))
        assert np.frombuffer(op03_packing._encode(text, encode, words), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_hilbert_curve_visits_neighbours():
    for m, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * m, indexing="ij"), -1).reshape(-1, m)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 16)).astype("f4")
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (700, [0.0] * 16), (800, [None] * 16), (900, [float("nan")] * 16), (1000, [1.0] * 3), (None, x[0].tolist()), (5, x[5].tolist())]
    got = op04_nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 50 = 0").toPandas()
    assert set(got.query_id) == set(range(0, 600, 50))
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype("f8") - x[q].astype("f8")) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(g.score, d[g.vec_id], atol=1e-12)
        hits += len(set(want) & set(g.vec_id))
    assert hits >= 0.9 * 120
    assert list(got[got.query_id == 50].sort_values("rank").vec_id) == list(range(51, 61))
    few = op04_nearest.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>"), "vec_id = 0").collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert op04_nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true").count() == 0


def test_nearest_of_vectors_whose_squares_overflow(spark):
    r = np.random.default_rng(4)
    size = r.choice([1e200, 1.0, 1e-170], 12)  # few enough for every window to hold all
    vectors = [[float(x) for x in r.normal(size=4) * s] for s in size]
    got = defaultdict(list)
    for x in op04_nearest.nearest(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), "vec_id % 2 = 0").orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    for q in range(0, 12, 2):
        exact = sorted((math.hypot(*(a - b for a, b in zip(vectors[q], v, strict=True))), i) for i, v in enumerate(vectors) if i != q)[:10]
        assert [i for i, _ in got[q]] == [i for _, i in exact] and [s for _, s in got[q]] == pytest.approx([d for d, _ in exact], rel=1e-12)


def test_pieces_equal_the_library(spark):
    import public_tokenizers

    v = op05_sentencepiece.PairAgenda(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    texts = ["", " ", "  a  b ", "x\ny\t z", "é️Ⅷ ﬁ", "好嗎　 a", "▁a", "😀 a", "a ", "\x00a", "<s> hi", "e" * 300, " " * 70 + "x"] + ["".join(r.choice("ab c▁ é好\n<>0x41") for _ in range(r.randrange(1, 120))) for _ in range(500)]
    rows = op05_sentencepiece.sentencepiece_digests(spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model")).collect()
    for row in rows:
        ids = v.library.encode(texts[row.doc_id]) if row.doc_id >= 0 else []
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((v.library.decode(ids) if ids else "").encode()).hexdigest()
    some = op05_sentencepiece.sentencepiece_ids(spark.createDataFrame([(1, "a b é好")], "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model")).first()
    assert list(some.ids) == v.library.encode("a b é好") and some.decoded == "a b é好"


def luhn(d):
    return sum(int(x) if i % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    text = "card 4845168114407329 4845168114407328 4929-3483-8514-6306 ip 97.51.17.173 300.1.1.1 tel +1 (017) 555-7713 born 1999-12-31, 31.02.2020 mail die.55@mail4.example.com"
    df = spark.createDataFrame([(1, text), (2, "again 4845168114407329 on 1999-12-31"), (3, None), (4, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in op06_pii.pseudonymize(df, "k").collect()}
    found = {x.value: (x.kind, x.pseudonym) for x in rows[1].pii}
    assert {k for k, _ in found.values()} == {"card", "ip", "phone", "iso_date", "email"} and len(found) == 6
    assert all(re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b) for a, (k, b) in found.items() if k in ("card", "phone", "iso_date"))
    assert all(luhn(re.sub("[^0-9]", "", b)) for k, b in found.values() if k == "card")
    for kept in ("4845168114407328", "300.1.1.1", "31.02.2020"):
        assert kept in rows[1].text
    for gone in found:
        assert gone not in rows[1].text
    assert rows[2].text == f"again {found['4845168114407329'][1]} on {found['1999-12-31'][1]}"
    assert rows[3].text is None and rows[4].text == ""
    days = spark.range(0, 73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert op06_pii.pseudonymize(days, "k").select("text").distinct().count() == 73049
    cards = spark.range(0, 3000).select(F.concat(F.lit("411111111111"), F.lpad((F.col("id") * 7 % 10000).cast("string"), 4, "0")).alias("text")).where(F.call_function("luhn_check", F.col("text")))
    out = op06_pii.pseudonymize(cards, "k").where(F.call_function("luhn_check", F.col("text")))
    assert out.select("text").distinct().count() == cards.distinct().count()


def feistel_brute(values, bases, tweak):
    half = len(values) // 2
    left, right, bl, br = values[:half], values[half:], bases[:half], bases[half:]
    for i in range(1, op06_pii.ROUNDS + 1):
        h = hashlib.sha256(f"{tweak}:{i}:{','.join(map(str, right))}".encode()).hexdigest()
        left, right, bl, br = right, [(x + int(h[j % 15 * 4 : j % 15 * 4 + 4], 16) + j // 15) % b for j, (x, b) in enumerate(zip(left, bl, strict=True))], br, bl
    return left + right


def test_pseudonyms_equal_brute_force(spark):
    r, rows = random.Random(2), []
    for i in range(60):
        rows.append((i, ".".join(str(r.randrange(256)) for _ in range(4))))
    for i in range(60, 120):
        rows.append((i, f"+1 {r.randrange(100, 1000)} {r.randrange(100, 1000)} {r.randrange(1000, 10000)}"))
    got = {x.doc_id: x.text for x in op06_pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, t in rows:
        if i < 60:
            assert got[i] == ".".join(map(str, feistel_brute([int(x) for x in t.split(".")], [256] * 4, "k:ip")))
        else:
            put = iter(feistel_brute([int(c) for c in t[2:] if c != " "], [10] * 10, "k:phone:" + "10" * 10))
            assert got[i] == "+1" + "".join(c if c == " " else str(next(put)) for c in t[2:])


def test_pseudonyms_link_spellings_and_take_long_runs(spark):
    texts = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "(555) 123-4567", "555.123.4567", "a.b@x.com", "A.B@x.com", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432", "078-05-1120", "000-05-1120"]
    long = ["a@b" + ".c" * 30_000, "x" * 200_000, "1." * 100_000, "a" * 100_000 + "@", "." * 100_000 + "a@b.de."]
    got = {x.doc_id: (x.text, [p.kind for p in x.pii]) for x in op06_pii.pseudonymize(spark.createDataFrame(list(enumerate(texts + long)), "doc_id long, text string"), "k").collect()}
    plain = lambda i: re.sub("[^0-9A-Za-z]", "", got[i][0]).lower()
    assert plain(0) == plain(1) == plain(2) != texts[0] and plain(3) == plain(4) and got[5][0].lower() == got[6][0].lower() and plain(7) == plain(8)
    assert [got[i][1] for i in range(12)] == [["card"]] * 3 + [["phone"]] * 2 + [["email"]] * 2 + [["iban"]] * 2 + [[], ["ssn"], []]
    moved = plain(7).upper()[4:] + plain(7).upper()[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    assert got[12][1] == ["email"] and got[13] == (long[1], []) and got[14][0] == long[2] and got[15] == (long[3], []) and got[16][1] == ["email"]


def test_quotations(spark):
    rows = [(1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "> How are YOU?\nFine"), (1, 2, "u", "> Fine\n>> How are you?\nGood"), (1, 3, "u", "New topic"), (1, 4, "a", "> hello   there. how are you?\nBack"), (1, 5, "u", "> nowhere\nx"), (2, 0, "u", "Hello there."), (2, 1, "u", None), (None, 1, "u", "> q\nz"), (3, None, None, "x")]
    got = op07_quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, r.reply_to, r.thread, r.position) for r in got.collect()}
    assert found[1, 1] == ("Fine", 1, 1, 0, 0, 1) and found[1, 2] == ("Good", 2, 2, 1, 0, 2) and found[1, 4] == ("Back", 1, 1, 0, 0, 3)
    assert found[1, 3][3:] == (None, 3, 4) and found[1, 5] == ("x", 1, 0, None, 5, 5)
    assert found[2, 1] == ("", 0, 0, None, 1, 1) and found[None, 1][3:] == (None, None, None) and found[3, None][5] is None
    assert op07_quotations.parse("a\n> b\n>c\n> \n> > d\ne") == ("a\ne", [(0, "a"), (1, "b\nc"), (2, "d"), (0, "e")])
    assert op07_quotations.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotations_of_runs_and_deeper_levels(spark):
    first = "The first line is here\nand the second follows it\nthe third one ends it\n\nYes\nNo way"
    replies = [
        (1, "> and the second follows it\n> the third one ends it\nA"),
        (1, "> The first line is\n> here and the second\nB\n> follows it the third one ends it\nC"),
        (1, "> Yes\n> no way\nD"),
        (1, "> an edited line of words\n>> the second follows it\nE"),
        (0, "> The first line is here\n> the third one ends it\nF"),
    ]
    rows = [row for k, (_, text) in enumerate(replies) for row in [(k, 0, "u", first), (k, 1, "a", text)]]
    got = {r.conv_id: r for r in op07_quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn = 1").collect()}
    for k, (links, _) in enumerate(replies):
        assert (got[k].reply_to, got[k].thread, got[k].n_linked > 0) == ((0, 0, True) if links else (None, 1, False)), k
    assert got[1].n_linked == got[1].n_quotes == 2 and got[1].text == "B\nC"


def test_line_windows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n a \n\nb\nc\nd\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (7, "a\nb\nc")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in op08_line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert got == {1: ("a\nb\nc\nd", 4, 0), 2: ("x\n\ny", 6, 4), 3: ("a\nb", 2, 0), 4: (None, 0, 0), 5: ("", 0, 0), 6: ("q", 5, 4), 7: ("", 3, 3)}


def base_brute(t):
    t = t or ""
    w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_base_rules(spark):
    r = random.Random(1)
    texts = [None, "", "  ", "a b c d e a b c d e", "x " * 50] + ["".join(r.choice(["a ", "b ", "c\n", "\n", "\t#", "é好 ", "\x0b", "<> ", "\r", "\x85", "\xa0"]) for _ in range(r.randrange(80))) for _ in range(200)]
    got = {x.doc_id: tuple(x)[1:7] for x in op09_quality.verdicts(spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: base_brute(t) for i, t in enumerate(texts)}


def test_quality_rejects_outliers_and_keeps_clean(spark):
    r = random.Random(2)
    clean = [" ".join(r.choice(WORDS) for _ in range(r.randrange(100, 400))) + "." for _ in range(400)]
    junk = [" ".join(r.choice(WORDS) + r.choice("#$%*") * 3 for _ in range(200)) for _ in range(40)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*clean, *junk])]
    got = {x.doc_id: x.kept for x in op09_quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(400)) and not any(got[i] for i in range(400, 440))


def test_quality_judges_small_tables_and_rare_languages(spark):
    r = random.Random(4)
    clean = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(100, 400))) + "."
    junk = lambda: " ".join(r.choice(WORDS) + r.choice("#$%*") * 3 for _ in range(200))
    few = [(i, clean() if i < 60 else junk(), "en", "s") for i in range(66)]
    rare = [(i, clean(), "en", "s") for i in range(300)] + [(i, clean() if i < 305 else junk(), None, "s") for i in range(300, 310)]
    for rows, bad in ((few, set(range(60, 66))), (rare, set(range(305, 310)))):
        got = {x.doc_id: (x.kept, x.distance) for x in op09_quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        assert {i for i, (kept, _) in got.items() if not kept} == bad and all(d is not None for _, d in got.values())


def test_secrets_equal_full_scans(spark):
    r = random.Random(3)
    words = ["password", "PassWd", "secret", "token", "Api_Key", "apikey", '"', "'", " ", ":", "=", "abc", "123456", "AKIA", "ABCDEFGH12345678", "é", "好", " the ", "deadbeef" * 3, "ghp_" + "a1" * 18, "\n", "xoxb-", "1234567890-x", "eyJabcdefghi.eyJabcdefghi.abcdefghi", "-----BEGIN RSA PRIVATE KEY-----", "ftp://a:bcd@", "K", "ſecret"]
    texts = ["".join(r.choice(words) for _ in range(r.randrange(25))) for _ in range(1500)] + ["", None]
    found = op10_secret_scans.find_spans(pa.array(texts), op10_secret_scans.RULES)
    for t, g in zip(texts, found, strict=True):
        assert g == sorted((m.start(), k, m.end(), m.start(x.group)) for k, x in enumerate(op10_secret_scans.RULES) for m in x.compiled().finditer(t or "") if m.end(x.group) - m.start(x.group) >= x.least)
    df = spark.createDataFrame([(1, 'é token = "abcdef1" x'), (2, None)], "doc_id long, text string")
    row = {x.doc_id: x for x in op10_secret_scans.secret_spans(df).collect()}
    assert row[1].spans == "assign:2:18" and row[1].base_sha256 == hashlib.sha256(b"assign:2:18").hexdigest() and row[2].spans == ""
    assert [x.text for x in op10_secret_scans.redact(df).orderBy("doc_id").collect()] == ['é token = "[REDACTED assign]" x', None]


def test_long_url_logins_are_found_and_redacted(spark):
    for user, password in (("u", "p-" * 33), ("v-" * 40, "pass word".replace(" ", "-")), ("w", "q-" * 5000)):
        text = f"see https://{user}:{password}@host/x now"
        spans = op10_secret_scans.find_spans(pa.array([text]), op10_secret_scans.RULES)[0]
        assert any(op10_secret_scans.RULES[k].kind == "url_login" for _, k, *_ in spans)
        assert password not in op10_secret_scans.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text


def test_trigram_queries():
    assert op10_secret_scans.trigram_query("AKIA[A-Z0-9]+") == ("and", "aki", "kia")
    assert op10_secret_scans.trigram_query("[0-9a-f]+") is True
    assert op10_secret_scans.trigram_query("(abc|xyz)d") == ("or", ("and", "abc", "bcd"), ("and", "xyz", "yzd"))
    assert op10_secret_scans.trigram_query("a?bcd.*efg") == ("and", "bcd", "efg") or "bcd" in op10_secret_scans._grams(op10_secret_scans.trigram_query("a?bcd.*efg"))


OPERATORS = {
    "op1": lambda d: op01_ngram_join.ngram_components(d),
    "op2": lambda d: op02_language_id.predict_language(d.select(F.col("doc_id"), "text"), op02_language_id.fit(d.select("doc_id", "lang", "text"))),
    "op3": lambda d: op03_packing.pack(d, op03_packing.vocabulary_files()),
    "op5": lambda d: op05_sentencepiece.sentencepiece_digests(d, __import__("public_tokenizers").path("piece_bpe_32k.model")),
    "op6": lambda d: op06_pii.pseudonymize(d, "k"),
    "op8": lambda d: op08_line_dedup.dedup_lines(d),
    "op9": lambda d: op09_quality.verdicts(d),
    "op10": lambda d: op10_secret_scans.redact(op10_secret_scans.secret_spans(d).join(d.select(F.col("doc_id").alias("i"), "text"), F.col("i") == F.col("doc_id"), "left")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, odd, empty, name):
    got = OPERATORS[name](odd).collect()
    assert {r["doc_id"] for r in got} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert OPERATORS[name](empty).count() == 0
    if name == "op1":
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} >= {(1, 0, 1), (2, 0, 2), (3, 1, 3), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 6), (None, 7, None)}


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    before = docs
    for name, stage in p.STAGES:
        after = common.materialize(stage(spark, before, "/root/testdata/sf0.01"))
        if name != "best-fit packing":
            assert after.columns == docs.columns
        if name == "quality rules":
            kept = {r.doc_id for r in op09_quality.verdicts(before).collect() if r.kept}
            assert {r.doc_id for r in after.select("doc_id").collect()} == kept and len(kept) > 700
        elif name == "line dedup":
            assert after.count() == before.count() and after.where(F.length("text") != F.col("n_chars")).count() == 0
        elif name == "n-gram Jaccard join":
            groups = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {r.doc_id for r in after.collect()} == {c for _, c in groups.values()}
        elif name == "secret scans":
            assert op10_secret_scans.secret_spans(after).where("n_assign + n_access + n_hex > 0").count() == 0
        else:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        before = after


def test_pipeline_keeps_rows_without_id_and_one_of_a_repeated_id(spark):
    import corpus_pipeline as p

    r = random.Random(8)
    text = lambda: " ".join(r.choice(WORDS) + str(r.randrange(500)) for _ in range(150))
    clean, twice, copied = text(), text(), text()
    rows = [(i, text(), "en", "s", 1) for i in range(30)] + [(None, clean, "en", "s", 1), (None, clean, "en", "s", 1), (None, "too short", "en", "s", 1), (40, twice, "en", "s", 1), (40, twice, "en", "s", 1), (41, copied, "en", "s", 1), (None, copied, "en", "s", 1)]
    good = common.materialize(p.quality_rules(spark, frame(spark, rows), SMALL))
    assert Counter(x.text for x in good.collect()) == Counter(t for _, t, *_ in rows if t != "too short")
    kept = p.ngram_join(spark, good, SMALL)
    assert kept.columns == good.columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == [(False, i) for i in [*range(30), 40, 41]] + [(True, 0)]
