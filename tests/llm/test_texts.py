"""Syncmers, pieces and WARC derivatives."""

import gzip
import hashlib
import json
import time
import zlib

import numpy as np
import sentencepiece

from verdigris.llm import pieces, syncmers, warc
from verdigris.llm.queries import tokenizer_path

from .conftest import sentence

MODEL = tokenizer_path("piece_bpe_32k.model")


def brute_syncmers(text, k=syncmers.K, s=syncmers.S):
    points = [*syncmers._BEFORE.tolist(), *map(ord, text), *syncmers._AFTER[::-1].tolist()]
    codes = syncmers.mix(np.array(points, np.uint64) + np.uint64(1))
    small = syncmers._rolling(codes, s)
    w = k - s + 1
    return [i for i in range(len(points) - k + 1) if min(small[i : i + w]) in (small[i], small[i + w - 1])]


def test_likeness_of_long_texts_with_edits():
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 12, 5000)]
    text = [words[i] for i in rng.integers(0, 5000, 20000)]
    edited = [words[rng.integers(5000)] if rng.random() < 0.02 else w for w in text]
    a, b = syncmers.anchors([" ".join(text), " ".join(edited)])
    common = len(np.intersect1d(a[0], b[0]))
    assert syncmers.likeness(a, b) > 0.6 and common > 30
    inserted = " ".join(text[:300] + words[:20] + text[300:600])
    a, b, c = syncmers.anchors([" ".join(text[:600]), inserted, " ".join(text[300:600] + text[:300])])
    assert syncmers.likeness(a, b) > 0.85 and 0.3 < syncmers.likeness(a, c) < 0.75
    h = np.arange(4, dtype=np.uint64)
    assert syncmers.likeness((h, np.array([0, 10, 20, 30])), (h, np.array([10, 0, 30, 20]))) == 1.0
    assert syncmers.likeness((h, np.array([0, 100, 200, 300])), (h, np.array([300, 200, 100, 0]))) == 0.25


def test_texts_of_any_length_share_anchors(spark):
    text = "the quick brown fox jumps over a lazy dog and runs away fr"
    rows = [(5, text[:57]), (4, text[:54]), (3, text[:56] + "."), (2, text[:55]), (1, text[:14]), (0, text[:12])]
    got = {r["doc_id"]: r for r in syncmers.fingerprints_with_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["near_next"] > 0.5 for i in (5, 4, 3)) and got[1]["near_next"] > 0.2
    assert got[3]["near_edited"] > 0.3
    assert got[5]["fingerprint"] == syncmers.as_text(syncmers.anchors([text[:57]])[0])
    short = {r["doc_id"]: r["n_anchors"] for r in syncmers.fingerprints(spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "doc_id long, text string")).collect()}
    assert short[1] > 0 and short[2] == short[3] == 0


def test_likeness_against_all_anchors():
    """Sketches are off from the share of all anchors by about their standard error; without a limit they are exact."""
    off = []
    for i in range(30):
        a = sentence(i, 400).split()
        b = [w if (j * 7 + i) % 25 else f"new{j}" for j, w in enumerate(a)]
        texts = [" ".join(a), " ".join(b)]
        x, y = syncmers.anchors(texts, 10**6)
        p = len(np.intersect1d(x[0], y[0])) / len(np.union1d(x[0], y[0]))
        assert abs(syncmers.likeness(x, y, 10**6) - p) < 0.05
        off.append(syncmers.likeness(*syncmers.anchors(texts)) - p)
    assert np.sqrt(np.mean(np.square(off))) < 0.1 and abs(np.mean(off)) < 0.05


def test_ids_may_be_strings(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 7)
    rows = [(f"k{i:03d}", sentence(i, 30)) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, "none")], "doc_id string, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in syncmers.fingerprints_with_neighbours(df).collect()}
    order = [*sorted(rows, reverse=True), (None, "none")]
    for (i, t), (_, x) in zip(order, order[1:] + order[:1]):
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 3] + x[: len(t) // 3]).encode()).hexdigest()
    pages = spark.createDataFrame([("p", "http://a", PAGE)], "page_id string, url string, html string")
    assert {r["id"] for r in warc.derivatives_of_pages(pages).collect()} == {"p"}


def test_closed_syncmers_are_found():
    text = sentence(3, 120)
    h, at = syncmers.anchors([text[:10] * 9, text], keep=10**6)[1]
    assert sorted(at.tolist()) == brute_syncmers(text)
    assert sorted(syncmers.anchors(["short"], 10**6)[0][1].tolist()) == brute_syncmers("short")
    moved = syncmers.anchors(["zzz " + text], keep=10**6)[0]
    assert len(np.intersect1d(h, moved[0])) > 0.85 * len(h)  # the same anchors in another place
    assert syncmers.likeness((h, at), (h, at), 10**6) == 1.0


def test_fingerprints_of_odd_rows(odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 7)
    rows = syncmers.fingerprints_with_neighbours(odd).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expect = []
    for (i, t, *_), (_, x, *_) in zip(order, order[1:] + order[:1]):
        t, x = t or "", x or ""
        edited = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        expect.append((i or -1, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(expect)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    prints = {}
    for r in syncmers.fingerprints(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert prints.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]
    assert syncmers.fingerprints_with_neighbours(empty).count() == 0
    long = [r for r in rows if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] for r in long]) > 0.3


def test_one_row_is_its_own_next(spark):
    r = syncmers.fingerprints_with_neighbours(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0


def test_pieces_equal_the_library(odd_rows):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = pieces.Coder(MODEL, 0.0, 0)
    for t in [r[1] or "" for r in odd_rows if "▁" not in (r[1] or "")] + ["  a  b \n\n c", "\n", " ", "naïve café 12345"]:
        assert plain.encode(t).tolist() == own.encode(t)


def test_dropout_is_lossless_and_seeded(odd, odd_rows, empty):
    texts = [r[1] or "" for r in odd_rows] + ["▁", "a ▁b", "▁▁ x\n▁", "\0 a\0"]
    one, again, other, never = (pieces.Coder(MODEL, rate, seed) for rate, seed in ((0.2, 1), (0.2, 1), (0.2, 2), (1.0, 1)))
    for t in texts:
        assert one.decode(one.encode(t)) == t == never.decode(never.encode(t))
        assert (one.encode(t) == again.encode(t)).all()
    assert one.encode(texts[4]).tolist() != other.encode(texts[4]).tolist()
    assert len(never.encode("hello")) >= len("hello")
    rows = pieces.encoding_report(odd, MODEL, 0.2, 1).collect()
    assert len(rows) == len(odd_rows) and all(r["lossless"] for r in rows)
    assert pieces.encoding_report(empty, MODEL, 0.2, 1).count() == 0
    back = pieces.decode(pieces.encode(odd, MODEL, 0.2, 1), MODEL).collect()
    assert sorted(r["text"] or "" for r in back) == sorted(r[1] or "" for r in odd_rows)


def test_dropout_varies_by_occurrence():
    coder, plain = pieces.Coder(MODEL, 0.2, 1), pieces.Coder(MODEL, 0.0, 0)
    whole = plain.encode("information").tolist()
    got = coder.encode(" ".join(["information"] * 400)).tolist()
    words, word, text = [], [], ""
    for x in got:
        word.append(x)
        text += coder.pieces.raw[x].decode()
        if text == " information":
            words.append(tuple(word))
            word, text = [], ""
    assert len(words) == 400 and len(set(words)) > 3 and tuple(whole) in words


def brute_dropout(pieces_, word, occurrence, bound):
    """Of all adjacent pairs that make a piece and aren't skipped, the best is merged, again and again."""
    parts = [(i, pieces.SPACE if c == " " else c, c == pieces.SPACE) for i, c in enumerate(word)]
    while True:
        best = None
        for (at, a, mark), (_, b, other) in zip(parts, parts[1:]):
            piece = None if mark or other else pieces_.ids.get(a + b)
            if piece is None:
                continue
            key = pieces.candidate_keys(np.array([at]), np.array([piece]))
            if pieces.mix(np.array([occurrence], np.uint64) + key)[0] >= bound and (best is None or pieces_.scores[piece] > best[0]):
                best = pieces_.scores[piece], at
        if best is None:
            break
        i = next(i for i, p in enumerate(parts) if p[0] == best[1])
        parts[i : i + 2] = [(parts[i][0], parts[i][1] + parts[i + 1][1], False)]
    return [x for _, s, mark in parts for x in ([pieces_.ids[s]] if s in pieces_.ids and not mark else [pieces_.byte[b] for b in s.encode()])]


def test_dropout_against_brute_force(odd_rows):
    coder = pieces.Coder(MODEL, 0.25, 3)
    texts = [(r[1] or "")[:3000] for r in odd_rows] + ["▁ a▁▁b  c\n\n d", "unbelievable " * 40, "x" * 90 + " " * 70 + "information" * 8]
    for t in texts:
        words = pieces._WORDS(" " + t) if t else []
        occurrence = coder.occurrences([t], np.array([len(words)]))
        want = [i for w, o in zip(words, occurrence.tolist()) for i in brute_dropout(coder.pieces, w, o, coder.bound)]
        assert coder.encode(t).tolist() == want


PAGE = '<!DOCTYPE html><html lang="de"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- <p>no</p> --><nav><a href="/x">x</a></nav><h1>Hi</h1><p>One <b>two</b><br>three&nbsp;&lt;4</p><script>open'


def test_derivatives_are_linked():
    headers, block = warc.response_of(7, "http://e.org/d/", PAGE)
    meta, text = warc.derive(headers, block)
    source = dict(headers)
    assert meta["refers_to"] == text["refers_to"] == source["WARC-Record-ID"]
    assert meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
    assert text["block"] == "x\nHi\nOne two\nthree <4"
    facts = json.loads(meta["block"])
    assert facts["Title"] == "A & B" and facts["Lang"] == "de" and facts["Links"] == [{"path": "a", "url": "http://e.org/x"}]
    assert facts["WARC-Header"] == [list(h) for h in headers] and meta["payload_digest"] == source["WARC-Payload-Digest"]
    (read, data), = warc.read_records(text["record"])
    assert data == text["block"].encode() and dict(read)["WARC-Block-Digest"] == warc.digest(data)


def test_bodies_are_decoded():
    body = PAGE.encode()
    chunked = b"".join(hex(len(body[i : i + 50]))[2:].encode() + b"\r\n" + body[i : i + 50] + b"\r\n" for i in range(0, len(body), 50)) + b"0\r\n\r\n"
    coded = [("Content-Encoding: gzip", gzip.compress(body)), ("Content-Encoding: deflate", zlib.compress(body)), ("Transfer-Encoding: chunked", chunked), ("Content-Encoding: gzip", body)]
    for field, data in coded:
        meta, text = warc.derive([("WARC-Record-ID", "<x>")], b"HTTP/1.1 200 OK\r\n" + field.encode() + b"\r\n\r\n" + data)
        assert text["block"] == "x\nHi\nOne two\nthree <4" and meta["payload_digest"] == warc.digest(data)
    assert warc.derive([], b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\nxyz")[1]["block"] == ""
    one, other = (warc.derive([], b"HTTP/1.1 200 OK\r\n\r\n" + x)[0]["record_id"] for x in (b"a", b"b"))
    assert one != other  # responses without an id
    files = b"".join(gzip.compress(warc.write_record(*warc.response_of(i, "http://a", PAGE))) for i in range(3))
    assert [len(list(warc.read_records(x))) for x in (files, files[:-20], files + b"junk", b"", b"WARC/1.0\r\n")] == [3, 2, 3, 0, 0]


def test_pages_are_read_in_linear_time():
    for part in ("<a", "<head ", "<title>", "<p ", "<!doctype ", "<html ", "<script ", "<a href ", "<!--", "</script "):
        began = time.time()
        warc.derive(*warc.response_of(1, "http://a", part * (2_000_000 // len(part))))
        assert time.time() - began < 10


def test_derivatives_of_odd_pages_and_files(spark, tmp_path):
    rows = [(1, "http://a", PAGE, "x"), (2, None, None, "x"), (None, "", "", None), (1, "http://a", PAGE, "x"), (3, "bad\r\nurl [", "<p>" + "z " * 200000, "y")]
    out = warc.derivatives_of_pages(spark.createDataFrame(rows, "page_id long, url string, html string, record string")).collect()
    assert len(out) == 10
    assert len([r for r in out if r["warc_type"] == "conversion" and r["content_length"] == 0]) == 2
    records = b"".join(warc.write_record(*warc.response_of(i, "http://a", PAGE)) for i in range(3))
    (tmp_path / "a.warc").write_bytes(records)
    again = warc.derivatives_of_files(spark, str(tmp_path)).collect()
    assert len(again) == 6 and {r["block"] for r in again if r["warc_type"] == "conversion"} == {"x\nHi\nOne two\nthree <4"}
    assert warc.derivatives_of_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
