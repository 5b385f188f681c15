"""Suffix dedup against all windows of all texts, also with every group split down to single windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from callscope.llm import suffixes

W = suffixes.WINDOW


def plain(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(raw[i : i + W] for raw in raws for i in range(len(raw) - W + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - W + 1):
            if count[raw[i : i + W]] > 1:
                gone[i + 1 : i + 1 + W] = True
        kept = bytes(b for b, g in zip(raw, gone[1:-1].tolist(), strict=True) if not g)
        out.append((len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def letters(seed, n, alphabet="abcdefgh "):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


def samples():
    passage, other = letters(1, 900), letters(2, 399)
    texts = [None, "", "short", letters(3, 2000), passage, letters(4, 300) + passage + letters(5, 500), passage[:450] + "X" + passage[451:], other + "!" + letters(6, 50), other + "?" + letters(7, 50)]
    texts += [passage[i : i + W] for i in (0, 7, 250)] + [letters(8, W), letters(8, W)]
    texts += ["a" * 3000, "ab" * 700 + "a", letters(9, 30) * 60, "é" * 700, "x" + "é" * 450]
    header = letters(10, 300)  # shared by many, whose windows all differ
    texts += [letters(20 + i, 200) + header + letters(60 + i, 200) for i in range(12)]
    texts += [letters(100 + i, 100) + letters(11, 410 + i % 3) + letters(200 + i, 300) for i in range(8)]
    texts += [letters(300, 1000)] * 3 + [letters(300, 1000)[17:]]
    return texts


def test_refined_buckets():
    """Buckets of word suffixes are those of their first words, whatever the depth."""
    r = random.Random(1)
    for n, depth, kinds in ((1, 3, 2), (50, 1, 3), (200, 5, 2), (400, 49, 1), (500, 13, 3)):
        words = np.array([r.randrange(kinds) for _ in range(n)], np.uint64)
        bucket = suffixes.refined(words, depth)
        known, plain_of = {}, {}
        for i, b in enumerate(bucket.tolist()):
            own = tuple(words[i : i + depth].tolist()) + (() if i + depth <= n else (f"end {i}",))
            assert known.setdefault(own, b) == b and plain_of.setdefault(b, own) == own


def test_anchors_follow_the_window():
    """Paths cover each window once, and equal windows have equal anchors at equal offsets, also over the borders of slices."""
    text = letters(1, 90_000, "abcd").encode()
    data = np.frombuffer(text[:50_000] + b"-" + text[:50_000], np.uint8)
    seen = {}
    for _, anchor, place, first, last in suffixes.paths(data, np.array([0, 50_000, 50_001, len(data)])):
        for a, p, i, j in zip(anchor.tolist(), place.tolist(), first.tolist(), last.tolist(), strict=True):
            for s in range(i, j + 1):
                assert s not in seen and s <= p <= s + W - suffixes.GRAM
                seen[s] = a, p - s
    assert sorted(seen) == [*range(50_000 - W + 1), *range(50_001, len(data) - W + 1)]
    assert all(seen[s] == seen[s + 50_001] for s in range(50_000 - W + 1))


@pytest.mark.parametrize("group", [suffixes.GROUP_BYTES, 1])
def test_against_all_windows(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP_BYTES", group)
    texts = samples()
    df = spark.createDataFrame([(i, t, "r", 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, row string, key long, bytes string").repartition(3)
    found = suffixes.remove_repeats(df).collect()
    got = {x["doc_id"]: x for x in found}
    for i, (size, gone, spans, kept) in enumerate(plain(texts)):
        x = got[i]
        assert (sum(r["end"] - r["start"] for r in x["removed"]), len(x["removed"])) == (gone, spans), i
        assert (x["kept"] is None) == (texts[i] is None) and hashlib.sha256(x["kept"] or b"").hexdigest() == kept
        assert size - gone == len(x["kept"] or b"")


def test_repeated_rows_and_nulls(spark):
    text = letters(1, 600)
    df = spark.createDataFrame([(1, text), (1, text), (None, letters(2, 500)), (None, letters(2, 500)), (None, letters(3, 500)), (2, None)], "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, None if x["kept"] is None else len(x["kept"])) for x in suffixes.remove_repeats(df).collect())
    assert got == [(0, 0), (0, 0), (0, 500), (1, 0), (1, 0), (2, None)]
    assert suffixes.remove_repeats(df.where("false")).collect() == []


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    wanted = {d["doc_id"]: p for d, p in zip(docs, plain([d["text"] for d in docs]), strict=True)}
    got = {x[0]: tuple(x[1:]) for x in suffixes.op12(spark, data).collect()}
    assert got == wanted and any(x[1] for x in got.values())
