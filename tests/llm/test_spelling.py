"""Spelling variants against all pairs of words, with tries of every depth, and on odd rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from callscope.llm import spelling
from callscope.llm.common import Stage


def plain_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, near=plain_near):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            count[low] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    by = {w: [] for w in words}
    shapes = {}
    for w in words:
        for i in range(len(w)):
            shapes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    pairs = itertools.combinations(words, 2) if len(words) < 600 else {p for g in shapes.values() for p in itertools.combinations(g, 2)} | {(w, r) for _, r in shapes if r in words for w in shapes[_, r]}
    for a, b in {tuple(sorted(p)) for p in pairs}:
        if near(a, b):
            by[a].append(b), by[b].append(a)
    form = {}
    for w, found in by.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(by[w]), words[form[w]] if form[w] is not None else None)
    return out


def variants_of(seed, n, alphabet="abcdé"):
    """Words by edits of each other, often with equal counts of letters."""
    r, words = random.Random(seed), ["".join(random.Random(seed).choice(alphabet) for _ in range(7))]
    while len(words) < n:
        w = list(r.choice(words))
        for _ in range(r.randrange(1, 3)):
            at, kind = r.randrange(len(w)), r.randrange(4)
            if kind == 0 and len(w) > 5:
                del w[at]
            elif kind == 1:
                w.insert(at, r.choice(alphabet))
            elif kind == 2:
                w[at] = r.choice(alphabet)
            else:
                r.shuffle(w)
        words.append("".join(w))
    return sorted(set(words))


@pytest.mark.parametrize("top", [0, 2, 6, spelling.SIZE])
def test_search_against_all_pairs(top):
    words = variants_of(1, 400) + ["x" * 60, "x" * 61, "x" * 59 + "y", "y" + "x" * 60]
    by = {}
    for w, v in zip(words, spelling.vectors(words), strict=True):
        by.setdefault(v[:top].tobytes(), []).append(w)
    nodes, asked = {k: spelling._Node(ws, [1] * len(ws), top) for k, ws in by.items()}, {}
    for w, v in zip(words, spelling.vectors(words), strict=True):
        for node, spent in spelling.routes(v, top):
            asked.setdefault(node, []).append((w, 1, spent))
    found = [(a, b) for k, rows in asked.items() if k in nodes for a, _, b, _ in spelling._answers(nodes[k], rows)]
    wanted = {frozenset(p) for p in itertools.combinations(words, 2) if plain_near(*p)}
    assert len(found) == len(wanted) and {frozenset(p) for p in found} == wanted


def test_near():
    words = variants_of(3, 120)
    for a, b in itertools.product(words, words):
        assert spelling.near(a, b) == (plain_near(a, b) and len(b) >= len(a))


@pytest.mark.parametrize("node", [spelling.NODE, 20, 1])
def test_pairs_once(spark, monkeypatch, node):
    """Also where nodes are split as far as can be, and where their words meet by parts."""
    monkeypatch.setattr(spelling, "NODE", node)
    words = variants_of(5, 300)
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    found = [(x["word"], x["other"]) for x in spelling.near_words(Stage(spark, "test"), df).collect()]
    wanted = {frozenset(p) for p in itertools.combinations(words, 2) if plain_near(*p)}
    assert len(found) == len(wanted) and {frozenset(p) for p in found} == wanted


def test_odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, other letters, ties, chains of forms, columns with the operator's own names."""
    r = random.Random(2)
    texts = [(1, None), (None, "Straße Straße straße STRASSE Étéxx étéxx étéxx étéxx"), (None, "Étéxx Étéxx×÷"), (2, ""), (3, "abc abcd " * 5), (4, "z" * 5000 + " " + "z" * 5001), (4, "z" * 5000 + " " + "z" * 5001), (5, ("z" * 5000 + " ") * 3 + ("z" * 5001 + " ") * 9)]
    texts += [(6, " ".join(["color"] * 3 + ["colour"] * 7 + ["colours"] * 20 + ["colourz"] * 20 + ["colxurs"] * 41))] * 2
    words = variants_of(7, 200)
    texts += [(10 + i, "\n".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(60)]
    df = spark.createDataFrame([(d, t, "w", 1, "f") for d, t in texts], "doc_id long, text string, word string, n long, form string")
    got = {x[0]: tuple(x[1:]) for x in spelling.variants(df).collect()}
    assert got == plain(texts) and any(x[1] != k and x[0] != x[1] for k, x in got.items())
    assert spelling.variants(df.where("false")).collect() == []


def test_whole_table(spark, data):
    docs = [tuple(x) for x in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = spelling.op13(spark, data).collect()
    got = {x[0]: tuple(x[1:]) for x in found}
    assert len(found) == len(got) and got == plain(docs) and any(x[0] for x in got.values())


def test_vectors():
    assert spelling.vectors(["eel", "É"]).sum(1).tolist() == [3, 1] and spelling.vectors(["eel"])[0][0] == 2
    assert spelling.vectors([]).shape == (0, spelling.SIZE) and np.array_equal(spelling.vectors(["abc"]), spelling.vectors(["cab"]))
