import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from verdigris.llm.packing import Encoder, Tightest, pack, pieces_of, plan, sequences
from verdigris.llm.queries import tokenizer_path


def one_by_one(lengths, capacity):
    """Best fit decreasing, one document after another."""
    open_bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(open_bins) if r >= n]
        if fits:
            i = min(fits, key=lambda i: (open_bins[i], i))
            open_bins[i] -= n
        else:
            open_bins.append(capacity - n)
    return sorted(open_bins)


def test_plan_equals_one_by_one():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([10, 37, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs, bins = plan(counts, capacity)
        used = {}
        for n, own in runs.items():
            ends = [r[0] for r in own[1:]] + [counts[n]]
            for (rank, first, each, offset), end in zip(own, ends):
                for k in range(end - rank):
                    used.setdefault(first + k // each, []).append((offset + k % each * n, n))
        for places in used.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == one_by_one(lengths, capacity)
        assert bins == len(used)


def test_tightest():
    t = Tightest(20)
    for c in (3, 9, 20):
        t.set(c, True)
    assert [t.find(n) for n in (1, 3, 4, 10, 20)] == [3, 3, 9, 20, 20]
    t.set(20, False)
    assert t.find(10) is None


def test_pieces():
    assert pieces_of(1) == [(0, 1)] and pieces_of(1024) == [(0, 1024)] and pieces_of(2050) == [(0, 2), (2, 1024), (1026, 1024)]


def test_ids_are_the_tokenizers(odd_rows):
    encoder, own = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for t in [r[1] or "" for r in odd_rows] + ["it's I'LL we've", "a<|endoftext|>b", " x y\x1c z", "½ ² ٣ a1b2"]:
        assert np.frombuffer(encoder(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_odd_rows(odd, odd_rows, empty):
    own = Tokenizer.from_file(tokenizer_path())
    packed = pack(odd, tokenizer_path(), keep_ids=True).cache()
    rows = packed.collect()
    expect = []
    for r in odd_rows:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids + [2]
        expect += [(r[0] or -1, n, s, m, zlib.crc32(np.array(ids[s : s + m], "<u4").tobytes())) for n, (s, m) in enumerate(pieces_of(len(ids)))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expect)
    for s in sequences(packed).collect():
        parts = sorted((r["offset"], r["ids"]) for r in rows if r["sequence_id"] == s["sequence_id"])
        assert s["ids"] == [i for _, p in parts for i in p] and len(s["ids"]) <= 1024
        assert [o for o, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
    assert pack(empty, tokenizer_path()).count() == 0


def test_tokenizers_of_other_kinds_are_refused(tmp_path):
    import json

    import pytest

    from verdigris.llm import packing
    from verdigris.llm.queries import tokenizer_path

    whole = json.loads(open(tokenizer_path()).read())
    changes = ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {**whole["pre_tokenizer"], "add_prefix_space": True}}, {"model": {**whole["model"], "dropout": 0.1}})
    for i, change in enumerate(changes):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps({**whole, **change}))
        with pytest.raises(ValueError, match="no byte-level BPE"):
            packing.Encoder(str(path))


def test_memory_is_bounded_within_a_text(monkeypatch):
    from verdigris.llm import packing
    from verdigris.llm.queries import tokenizer_path

    encoder = packing.Encoder(tokenizer_path())
    text = " ".join(f"w{i}x{i * 7}" for i in range(3000))
    want = encoder(text)
    monkeypatch.setattr(packing, "MEMORY", 50)
    encoder.known.clear()
    assert encoder(text) == want and len(encoder.known) <= 50
