"""Spelling variant grouping: words one edit apart, found in a trie of letter-group counts, and the forms that they are variants of.

A word's vector counts its letters by group. One inserted letter adds one to one count, a replaced one also takes one from another (or changes none, inside
a group). So words near a word lie in the trie of all vectors where a depth-first search gets that spends at most one surplus and one
deficit; only words of its last leaves are compared as texts. Each pair is found once: from the shorter word, else from the one whose first differing count is smaller,
else (equal vectors) from the smaller word.

1. Words are counted over all documents with map-side sums.
2. The top of the trie is dealt over tasks: its nodes are the first counts, as many as it takes for no node to have more than NODE words. A word goes to its node, and
   as a query to all nodes that its budget reaches, with what is left of it.
3. A task builds the rest of one node's trie at a time and searches it for all of the node's queries together.
4. Where even the whole vector has more words (anagrams), words meet by what is left of them without one letter, in groups no larger than the alphabet.

Forms point from word to word, at least twice as frequent each, so that pointer doubling finds the roots in at most six rounds.

Cases: null and empty texts have no words; a null doc_id counts as an empty one; rows that repeat a document count each; words of any
length; ties of the best near word go to the smallest in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, load, parallelism, small

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Groups of letters, frequent ones alone; what isn't listed is the last group.
GROUPS = ("e", "a", "i", "o", "n", "r", "t", "s", "l", "du", "cm", "gp", "bh", "fvyk", "jqwxz")
SIZE = len(GROUPS) + 1
#: Words of a node, depths that the top of the trie may have, and routed words in a partition.
NODE, TOPS, PART_ROWS = 8192, (2, 4, 6, 8, 12, SIZE), 1 << 19
#: Pairs that are compared as they are, without another step down; pairs compared at a time; letters of a word that are compared as bytes.
FEW, PAIRS, WIDTH = 256, 1 << 18, 48
_GROUP = np.full(256, SIZE - 1)
for _i, _letters in enumerate(GROUPS):
    _GROUP[list(_letters.encode("latin-1"))] = _i


def vectors(words: list[str]) -> np.ndarray:
    """The counts of each word, a row for a word."""
    sizes = np.array([len(w) for w in words], np.int64)
    group = _GROUP[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    place = np.repeat(np.arange(len(words)) * SIZE, sizes) + group
    return np.bincount(place, minlength=len(words) * SIZE).reshape(-1, SIZE).astype(np.int32)


def routes(vector: np.ndarray, top: int) -> Iterator[tuple[bytes, int]]:
    """Nodes that a query's budget reaches, and what it has spent: nothing, a surplus, or a surplus and then a deficit."""
    head = vector[:top]
    yield head.tobytes(), 0
    for i in range(top):
        more = head.copy()
        more[i] += 1
        yield more.tobytes(), 1
        for j in range(i + 1, top):
            if more[j]:
                less = more.copy()
                less[j] -= 1
                yield less.tobytes(), 2


def _members(top: int):
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            nodes = [v[:top].tobytes() for v in vectors(words)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("word"), batch.column("n")], ["node", "word", "n"])

    return run


def _queries(top: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found = [(node, spent, i) for i, v in enumerate(vectors(part.column("word").to_pylist())) for node, spent in routes(v, top)]
                who = pa.array([x[2] for x in found], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int32()), part.column("word").take(who), part.column("n").take(who)], ["node", "spent", "word", "n"])

    return run


# ---------------------------------------------------------------- search in a node


def near(a: str, b: str) -> bool:
    """Whether b is a with one code point replaced or inserted."""
    if len(b) - len(a) not in (0, 1):
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[at:] == b[at + 1 :] if len(b) > len(a) else a[at + 1 :] == b[at + 1 :])


class _Texts:
    """Words as rows of bytes, for comparing many pairs; longer ones as they are."""

    def __init__(self, words: list[str]):
        self.words, self.sizes = words, np.array([len(w) for w in words], np.int64)
        width = int(min(WIDTH, self.sizes.max(initial=1))) + 1
        self.bytes = np.array([w[:width].encode("latin-1") for w in words], f"S{width}").view(np.uint8).reshape(len(words), width) if words else np.zeros((0, width), np.uint8)


def near_pairs(queries: _Texts, members: _Texts, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For pairs (query, member), whether the member is the query with one letter replaced or inserted."""
    out = np.zeros(len(q), bool)
    grown = members.sizes[m] - queries.sizes[q]
    short = members.sizes[m] <= WIDTH
    for i in np.flatnonzero(~short).tolist():
        out[i] = near(queries.words[q[i]], members.words[m[i]])
    width = max(queries.bytes.shape[1], members.bytes.shape[1])
    pad = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    a, b = pad(queries.bytes), pad(members.bytes)
    same = np.flatnonzero(short & (grown == 0))
    out[same] = (a[q[same]] != b[m[same]]).sum(1) == 1
    more = np.flatnonzero(short & (grown == 1))
    x, y = a[q[more]], b[m[more]]
    head = np.logical_and.accumulate(x == y, axis=1)
    tail = np.logical_and.accumulate((x[:, :-1] == y[:, 1:])[:, ::-1], axis=1)[:, ::-1]
    first = head.sum(1)  # the letters that agree from the start
    out[more] = tail[np.arange(len(more)), np.minimum(first, width - 2)]
    return out


def leaves(members: np.ndarray, queries: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) arrays of all pairs within the budget, depth first. members and queries are the counts that are left; members in lexical order."""
    stack = [(0, 0, len(members), np.arange(len(queries)), spent)]
    while stack:
        depth, low, high, who, used = stack.pop()
        if depth == members.shape[1]:  # words of one vector
            for at in range(0, len(who), step := max(1, PAIRS // (high - low))):
                part = who[at : at + step]
                yield np.repeat(part, high - low), np.tile(np.arange(low, high), len(part))
            continue
        if (high - low) * len(who) <= FEW:
            diff = members[None, low:high, depth:] - queries[who][:, None, depth:]
            # In the order of groups a surplus comes before a deficit, each at most once.
            run = used[:, None, None] + np.cumsum(diff != 0, axis=2)
            right = (diff == 0) | ((diff == 1) & (run == 1)) | ((diff == -1) & (run == 2))
            q, m = np.nonzero(right.all(2))
            yield who[q], m + low
            continue
        counts = members[low:high, depth]
        edges = np.concatenate(([0], np.flatnonzero(counts[1:] != counts[:-1]) + 1, [high - low]))
        own = queries[who, depth]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            diff = counts[a] - own
            go = np.flatnonzero((diff == 0) | ((diff == 1) & (used == 0)) | ((diff == -1) & (used == 1)))
            if len(go):
                stack.append((depth + 1, low + a, low + b, who[go], used[go] + (diff[go] != 0)))


class _Node:
    """The words of a node, and the rest of its trie: their counts in lexical order."""

    def __init__(self, words: list[str], n: list[int], top: int):
        counts = vectors(words)[:, top:]
        order = np.lexsort(counts.T[::-1]) if counts.shape[1] else np.arange(len(words))
        self.top, self.counts, self.n = top, counts[order], [n[i] for i in order.tolist()]
        self.texts = _Texts([words[i] for i in order.tolist()])

    def search(self, words: list[str], n: list[int], spent: list[int]):
        """(word, n, near word, its n) of all pairs that these queries find."""
        texts, out = _Texts(words), []
        for q, m in _joined(leaves(self.counts, vectors(words)[:, self.top :], np.array(spent, np.int32))):
            hit = near_pairs(texts, self.texts, q, m)
            q, m = q[hit].tolist(), m[hit].tolist()
            out += [(words[i], n[i], self.texts.words[j], self.n[j]) for i, j in zip(q, m, strict=True)]
        return _once(out)


def _once(pairs: list[tuple]) -> list[tuple]:
    """Pairs of equal vectors are found from both sides: that of the smaller word counts."""
    equal = (vectors([p[0] for p in pairs]) == vectors([p[2] for p in pairs])).all(1)
    return [p for p, e in zip(pairs, equal.tolist(), strict=True) if not e or p[0] < p[2]]


def _joined(found, most: int = PAIRS):
    held, size = [], 0
    for x in found:
        if len(x[0]):
            held, size = [*held, x], size + len(x[0])
        if size >= most:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _search(top: int):
    """Rows come by node, a node's words before its queries."""

    def run(batches):
        node, now, words, n = None, None, [], []
        for batch in batches:
            found, held = [], []
            for key, spent, word, times in zip(*(batch.column(c).to_pylist() for c in ("node", "spent", "word", "n")), strict=True):
                if key != now:
                    found += _answers(node, held)
                    node, now, words, n, held = None, key, [], [], []
                if spent < 0:
                    words.append(word), n.append(times)
                    continue
                node = node or _Node(words, n, top)
                held.append((word, times, spent))
            found += _answers(node, held)
            yield _pairs_of(found)

    return run


def _answers(node: _Node | None, held: list[tuple]) -> list[tuple]:
    return node.search(*map(list, zip(*held, strict=True))) if node and held else []


def _pairs_of(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n", "other", "other_n"])


_PAIRS = "word string, n long, other string, other_n long"

# ---------------------------------------------------------------- the operator


def word_counts(docs: DataFrame, least: int = 5, times: int = 3) -> DataFrame:
    """word, n: lower-cased runs of letters of `least` letters or more that occur `times` times or more; a checksum of document and run spoils one in 97."""
    run = F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"({LETTERS})"), F.lit(0))).alias("run")
    # Lower case of A-Z alone: other letters stay as they are.
    low = F.when(F.col("run").rlike(r"[À-Þ]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.lower("run"))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run).where(F.length("run") >= least).select("doc", low.alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    spoilt = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select("run", h.alias("h")).select(F.when(F.col("h") % 97 == 0, spoilt).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _by_parts(routed: DataFrame) -> DataFrame:
    """Pairs in nodes of too many words: they share a word without one of its letters, or one is the other without a letter.

    A run of equal letters gives one such rest. Words of a place and a rest differ there alone, so a group has no more of them than letters.
    """
    length = F.length("word")
    places = F.sequence(F.lit(1), length)
    rest = F.transform(places, lambda i: F.struct(i.alias("at"), F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, length)).alias("rest")))
    cut = routed.select("node", "spent", "word", "n", F.explode(rest).alias("x")).select("node", "spent", "word", "n", "x.at", "x.rest")
    members, queries = cut.where("spent < 0").drop("spent"), cut.where("spent >= 0").drop("spent")
    other = members.select("node", "at", "rest", F.col("word").alias("other"), F.col("n").alias("other_n"))
    same = queries.join(other, ["node", "at", "rest"]).where("word <> other").select("word", "n", "other", "other_n")
    whole = routed.where("spent >= 0").select("node", F.col("word").alias("rest"), "n")
    longer = whole.join(other.drop("at").distinct(), ["node", "rest"]).select(F.col("rest").alias("word"), "n", "other", "other_n")
    return same.union(longer)


def _once_each(batches):
    for batch in batches:
        yield _pairs_of(_once([tuple(r.values()) for r in batch.to_pylist()]))


def near_words(stage: Stage, words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each pair of near words once, for words with their counts."""
    spark = words.sparkSession
    for top in TOPS:
        members = words.mapInArrow(_members(top), "node binary, word string, n long")
        nodes = stage.keep(members.groupBy("node").agg(F.count("*").alias("size")), f"nodes-{top}")
        if (nodes.agg(F.max("size")).first()[0] or 0) <= NODE:
            break
    asked = words.mapInArrow(_queries(top), "node binary, spent int, word string, n long").join(small(nodes.select("node")), "node", "left_semi")
    routed = stage.keep(members.select("node", F.lit(-1).alias("spent"), "word", "n").union(asked.select("node", "spent", "word", "n")), "routed")
    hot = small(stage.keep(nodes.where(F.col("size") > NODE).select("node"), "hot"))
    parts = max(parallelism(spark), routed.count() // PART_ROWS)
    cold = routed.join(hot, "node", "left_anti").select("node", "spent", "word", "n").repartition(parts, "node").sortWithinPartitions("node", "spent")
    found = stage.keep(cold.mapInArrow(_search(top), _PAIRS), "found")
    more = stage.keep(_by_parts(routed.join(hot, "node", "left_semi").select("node", "spent", "word", "n")).mapInArrow(_once_each, _PAIRS), "by-parts")
    stage.drop("routed")
    return found.union(more)


def roots(stage: Stage, forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (word, form), by pointer doubling."""
    now = stage.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots-0")
    for n in range(1, 64):
        if now.where("open").isEmpty():
            break
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stage.keep(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")), f"roots-{n}")
    return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of the documents."""
    stage = Stage(docs.sparkSession, "spelling")
    words = stage.keep(word_counts(docs), "words")
    pairs = stage.keep(near_words(stage, words), "pairs")
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    right = form_n >= 2 * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(right, F.col("best.form")).alias("form"), F.when(right, form_n).alias("form_n"))
    known = stage.keep(known, "known")
    ends = roots(stage, known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark, sf_dir: str) -> DataFrame:
    return variants(load(spark, sf_dir, "documents").select("doc_id", "text"))
