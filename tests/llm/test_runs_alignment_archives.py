"""Periodic runs, cross-tokenizer alignment and archives against brute force."""

import gzip
import hashlib
import io
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import check, connect  # noqa: E402

from tesserae.llm import common, op11_runs, op12_alignment, op13_archives  # noqa: E402
from tesserae.llm.suffixes import Suffixes  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, runs string, pairs string, row string, a string, n string"
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows):
    """Documents with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(d, t, "en", "r", "p", "w", "a", "n") for d, t in rows], DOCS)


def brute_runs(x, least):
    """By comparing each word with the one p words on, for every p."""
    seen = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                seen.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in seen.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 12)
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("least", [1, 4, 12])
def test_runs_equal_brute_force(least, monkeypatch):
    monkeypatch.setattr(op11_runs, "ENDS", 32)  # so that grids come in several pieces
    op11_runs._first_pairs.cache_clear()
    r = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(5):
            n, k = r.randrange(90), r.choice([1, 2, 3, 8, 40])
            x = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.6:
                a = r.randrange(n)
                x = x[:a] + (x[a : a + 1 + (n - a) // r.randrange(3, 11)] * n)[: n - a]
            texts.append(x)
        assert [list(map(tuple, g.tolist())) for g in op11_runs.runs([np.array(x, np.int64) for x in texts], least)] == [brute_runs(x, least) for x in texts]
    op11_runs._first_pairs.cache_clear()


def test_common_extensions():
    r = random.Random(3)
    for _ in range(30):
        texts = [[r.randrange(2) for _ in range(r.randrange(1, 40))] for _ in range(4)]
        words = np.array([w + 2 * k for k, t in enumerate(texts) for w in t])
        ends = np.cumsum([len(t) for t in texts])
        s = Suffixes(words, np.repeat(ends, [len(t) for t in texts]))
        a, b = zip(*[(a, b) for a in range(len(words)) for b in range(len(words)) if a != b], strict=True)
        stop = [int(ends[np.searchsorted(ends, i, "right")]) for i in range(len(words))]

        def common_words(i, j):
            n = 0
            while i + n < stop[i] and j + n < stop[j] and words[i + n] == words[j + n]:
                n += 1
            return n

        assert s.extensions(np.array(a), np.array(b)).tolist() == [common_words(i, j) for i, j in zip(a, b, strict=True)]


def test_runs_of_documents(spark):
    docs = common.table(spark, SMALL, "documents")
    want = sorted(brute_row(r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, op11_runs.op11_runs(spark, SMALL).select(RUN_COLUMNS).collect())) == want
    assert any(r[1] for r in want)


def test_runs_of_odd_rows(spark, tmp_path):
    loop = " ".join(["a", "b", "c"] * 20_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (4, "x"), (None, "y " * 12), (5, loop), (6, "é\x85é " * 12), (7, "a b\x0bc\x0cd\re " * 3), (8, "a\xa0b " * 11)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r[c] for c in RUN_COLUMNS) for r in op11_runs.op11_runs(spark, str(tmp_path)).collect()]
    small = [x for x in rows if x[1] != loop]
    assert Counter(g for g in got if g[0] != 5) == Counter(brute_row(*x) for x in small)
    assert next(g for g in got if g[0] == 5)[1:6] == (1, 0, 60_000, 3, 20_000_000)
    out = op11_runs.periodic_runs(frame(spark, [(5, loop), (9, "q " * 11)])).collect()
    assert {r.doc_id: r.collapsed for r in out} == {5: "a b c", 9: " ".join("q" * 11)}
    assert op11_runs.periodic_runs(frame(spark, rows).where("false")).count() == 0


def brute_alignment(docs):
    """Token by token, with byte ranges compared in pairs."""
    a_lib = Tokenizer.from_file(A_FILE)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    letters = op12_alignment.byte_letters()

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at += len(of(i))
        return out

    def piece(i):
        return bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()

    def entry(i):
        return bytes(letters[c] for c in a_lib.id_to_token(i))

    found = []
    for doc, text in docs:
        a_ids = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b_lib.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(entry, a_ids)) != whole or b"".join(map(piece, b_ids)) != whole:
            found.append((doc, [], [], [], []))
            continue
        a, b = spans(a_ids, entry), spans(b_ids, piece)
        links, j = [], 0
        for x in a:
            while b[j][2] <= x[1]:
                j += 1
            k = j
            while k < len(b) and b[k][1] < x[2]:
                links.append((x[0], b[k][0]))
                k += 1
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(x[0]) for x in a if low <= x[1] < c) + "|" + ",".join(str(x[0]) for x in b if low <= x[1] < c))
            low = c
        found.append((doc, a, b, groups, links))
    counts = Counter(p for *_, links in found for p in set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for doc, a, b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return out


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def write(spark, rows, folder):
    frame(spark, rows).repartition(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("rows", [2_000_000, 0])
def test_alignment_equals_brute_force(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(op12_alignment, "ROWS", rows)  # 0: the join without a broadcast
    texts = [r.text for r in common.table(spark, SMALL, "documents").orderBy("doc_id").limit(25).collect()]
    odd = [None, "", " ", "\n", "a", "  two  spaces ", "line\n\n  next", "▁ in it", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 🙂 é‍", "\x00\x01 \x7f", "tab\tand nbsp   em", "a" * 500, "don't we'll I'd", "x" * 60 + " y"]
    docs = list(enumerate(texts + odd)) + [(7, texts[7]), (None, "no id here")]
    got = op12_alignment.op12_alignment(spark, write(spark, docs, tmp_path)).select(ALIGNED).collect()
    assert Counter(map(tuple, got)) == Counter(brute_alignment(docs))


def test_alignment_texts_and_memory_bounds(spark, monkeypatch):
    rows = [(1, "some words " * 40), (2, "word"), (3, None)]
    want = {r.doc_id: (r.groups, r.n_links) for r in op12_alignment.alignments(frame(spark, rows), A_FILE, B_FILE).collect()}
    v = op12_alignment.Vocabularies(A_FILE, B_FILE)
    monkeypatch.setattr(op12_alignment, "MEMO", 0)
    ids = v.encode([rows[0][1], "word"])
    assert op12_alignment._aligned(v, [1, 2], ids, 0).column(6).to_pylist() == [want[1][0], want[2][0]]
    assert want[3] == ("", 0) and not v.known
    groups = [g.split("|") for g in want[1][0].split(";")]
    decoded = Tokenizer.from_file(A_FILE).decode([int(i) for a, _ in groups for i in a.split(",")])
    assert decoded == " " + rows[0][1] and v.b.decode([int(i) for _, b in groups for i in b.split(",")]) == rows[0][1]
    assert op12_alignment.alignments(frame(spark, rows).where("false"), A_FILE, B_FILE).count() == 0


PAGES = "page_id long, url string, html string, key string, first string, archive string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "f", "a") for i, u, h in rows], PAGES)


def brute_pages(rows):
    groups = defaultdict(list)
    for k, (i, _, html) in enumerate(rows):
        groups[html or ""].append((i is None, i or 0, k))
    out = Counter()
    for html, at in groups.items():
        data = html.encode()
        first = min(at)
        for none, i, k in at:
            again = len(data) >= 100 and (none, i, k) != first
            out[(None if none else i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", None if not again or first[0] else first[1])] += 1
    return out


ODD_PAGES = [
    (1, "http://a.example/x y", None), (2, None, ""), (3, "http://a.example/\n\r\tz", "z" * 99), (4, "u", "z" * 99), (6, "é", "é" * 50), (5, "u", "é" * 50), (5, "u", "é" * 50), (None, "u", "é" * 50),
    (None, "u", "n" * 100), (None, "u", "n" * 100), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nfiledesc://x 0.0.0.0 19700101000000 text/plain 9\n" * 3), (8, "u", "\r\n\r\n" * 40), (9, "u", "x" * 3_000_000),
    (10, "http://x.example/ 1 2 3", "HTTP/1.1 200 OK\r\nX-Page-Id: 99\r\n\r\n"),
]


def test_archives_of_odd_pages(spark, tmp_path):
    rows = ODD_PAGES + [(i, f"http://many.example/{i}", "same page " * 20 if i % 3 else f"page {i} " * 30) for i in range(100, 6000)]
    pages(spark, rows).coalesce(2).write.parquet(str(tmp_path / "pages.parquet"))
    got = op13_archives.op13_archives(spark, str(tmp_path))
    assert Counter(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == brute_pages(rows)
    pages(spark, rows).where("false").write.parquet(str(tmp_path / "none/pages.parquet"))
    assert op13_archives.op13_archives(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_archives_hold_what_was_written(spark, tmp_path, version):
    arc, warc = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    op13_archives.write_arc(pages(spark, ODD_PAGES).coalesce(1), arc, version, ip=F.lit("10.0.0.1"), date=F.lit("20010203040506"))
    data = gzip.decompress(next((tmp_path / "arc").glob("part-*")).read_bytes())
    parsed = list(op13_archives.arc_records(io.BytesIO(data)))
    assert len(parsed) == 1 + len(ODD_PAGES) and {r["version"] for r in parsed[1:]} == {version} and not any(r["truncated"] for r in parsed)
    for r, (key, _, html) in zip(parsed[1:], ODD_PAGES, strict=True):
        line = data[r["offset"] :].split(b"\n", 1)[0].split(b" ")
        assert len(line) == (5 if version == 1 else 10) and int(line[-1]) == len(r["block"]) and r["block"] == op13_archives.http_block(key, (html or "").encode())
        assert version == 1 or line[7] == b"%d" % r["offset"]
    op13_archives.arc_to_warc(spark, arc, warc)
    back = op13_archives.read_warc(spark, warc).collect()
    ids = {r.record_id: r for r in back}
    assert len(ids) == len(back) == len(parsed) and all(r.digest_holds for r in back if r.type == "response")
    assert {r.date for r in back} == {"2001-02-03T04:05:06Z"} and Counter(r.type for r in back) == {"warcinfo": 1, "revisit": 4, "response": len(ODD_PAGES) - 4}
    assert Counter(bytes(r.payload) for r in back if r.type == "response" and r.payload_bytes < 100) == Counter((h or "").encode() for _, _, h in ODD_PAGES if len((h or "").encode()) < 100)
    for r in back:
        if r.type == "revisit":
            assert ids[r.refers_to_id].payload_digest == r.payload_digest and ids[r.refers_to_id].type == "response" and r.payload == b""


def test_arc_lines_that_are_no_headers():
    version_1 = op13_archives.arc_description(1, b"x.arc", b"19990101000000") + b"\n"
    bad = b"not a header\nhttp://a 0.0.0.0 19990101 text/html nine\n"
    dns = b"dns:a.example 0.0.0.0 199901010203 text/dns 4\nbody\n"
    short = b"http://b 0.0.0.0 19990101000000 text/html 50\nHTTP/1.0 200 OK\r\n\r\nhalf"
    got = list(op13_archives.arc_records(io.BytesIO(version_1 + bad + dns + short)))
    assert [(r["url"], r["date"], r["truncated"]) for r in got[1:]] == [(b"dns:a.example", b"19990101020300", False), (b"http://b", b"19990101000000", True)]
    rows = [op13_archives._converted("f", r) for r in got]
    assert [r[4] for r in rows] == ["warcinfo", "resource", "response"] and rows[1][8] == "text/dns" and rows[2][-1] == b"half"
    assert op13_archives._converted("f", got[1]) == rows[1]  # the same identifier each time
    assert list(op13_archives.arc_records(io.BytesIO(b""))) == []


def test_archives_equal_sql(spark):
    check(spark, connect(SMALL), SMALL, op13_archives.op13_archives, op13_archives.SQL)
