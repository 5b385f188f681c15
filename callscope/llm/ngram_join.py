"""N-gram Jaccard join with adaptive multi-match prefixes: classes of documents linked by similar sets of word shingles.

Two sets of sizes m <= n with Jaccard similarity 3/4 or more share at least need(n) = ceil(3 n / 4) members. Under any global order of
the shingles, their prefixes of n - need(n) + r members therefore share at least r: a longer prefix asks for more matches.

1. Screen. One pass over the texts makes every set. Prefixes in hash order with r = n // 4 + 1 are matched against each other as packed
   runs of hashes, one entry for a shingle and task. A pair shares the r of its smaller set, so what doesn't find need(n) // 4 + 1 of its
   shingles elsewhere links with nothing new. Equal sets are one class from here on.
2. Collapse. Classes that share some of the first few members of their prefixes are a family with one leader each, the one whose members most
   others share, and are verified against it. So large groups of near copies become one component in linear work. Members that don't link to
   their leader meet the rest of their family in blocks of sets, of which only a forest of the links comes back.
3. Join. Shingles that occur in several components are ordered by frequency, all others come before them. A set with fewer than need(n) of
   them is done. Each other picks how many matches r it asks for, by the estimated cost of the prefix that r takes: its postings, and
   the candidates among them (postings / r at most). Pairs of different components and families that share the smaller r of the two are
   verified on their whole sets.

Links inside a component that is known needn't be found again: components are the result. Candidates come by one hash of a shingle; sets are compared by
it and by 32 bits of a second, independent one, and equal sets by sums of both.

Cases: null and empty texts have no set and link with nothing; texts of fewer words than a shingle are one shingle; rows that repeat
a doc_id are one document; rows with a null doc_id are in no component (null) but the class of equal sets; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, Stage, Words, components, cuts, forest, fresh, load, mix, parallelism, shingle_sets, small, texts_of

WORDS = 5
#: Prefixes of the screen ask for n // SCREEN + 1 matches.
SCREEN = 4
#: What verifying a candidate costs, in postings; sets in a block of a family; members of a prefix that name its leader.
VERIFY, BLOCK, HEADS = 64, 256, 16
#: Bytes of text whose prefixes meet in one bucket of the screen.
BUCKET_BYTES = 32 << 20
NOBODY = np.iinfo(np.int64).min
FLUSH = 1 << 19


def need(n):
    """The least number of members that a set of n shares with any set it links to."""
    return (3 * n + 3) // 4


def prefix(n):
    """The length of the hash-ordered prefix that asks for n // SCREEN + 1 matches."""
    return n - need(n) + 1 + n // SCREEN


def least(n: str, part: int) -> str:
    """SQL: a set of n shares more than this many members of its prefix with each set it links to, the smallest of which has need(n) members."""
    return f"(((3 * {n} + 3) div 4) div {part})"


def signature(found: np.ndarray, other: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, each half from one of the hashes of its members."""
    return int(found.sum(dtype=U).astype(np.int64)), int(mix(other).sum(dtype=U).astype(np.int64))


#: A member of a whole set: its hash, and half of its second one.
MEMBER = np.dtype([("hash", "<u8"), ("check", "<u4")])


def whole(found: np.ndarray, other: np.ndarray) -> bytes:
    out = np.empty(len(found), MEMBER)
    out["hash"], out["check"] = found, other.astype(np.uint32)
    return out.tobytes()


def members(raw: bytes) -> np.ndarray:
    """The hashes of a whole set, sorted."""
    return np.frombuffer(raw, MEMBER)["hash"]


def _sets(batches, k: int):
    """(doc_id or None, (set, second hashes)) of every row."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at, _, data, offsets in texts_of(batch.column(1)):
            yield from zip(ids[at:], shingle_sets(Words(data, offsets, True), k), strict=False)


def _packed(buckets: int, ids: list, sizes: list, signs: list, tokens: list[np.ndarray], owners: list[int]):
    """Rows (bucket, documents' columns, hashes, who): what one task hands on, a row for each bucket."""
    who = np.repeat(np.array(owners, np.int64), [len(t) for t in tokens])
    hashes = np.concatenate(tokens) if tokens else np.zeros(0, U)
    order = np.argsort(hashes)
    hashes, who = hashes[order], who[order]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(hashes)))
    shared = np.repeat(times > 1, times)
    local = np.bincount(who[shared], minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
    names = np.array([NOBODY if i is None else i for i in ids], np.int64)
    hashes, who = hashes[first], np.where(times > 1, NOBODY, names[who[first]])
    bucket = (mix(hashes) % U(buckets)).astype(np.int64)
    order = np.lexsort((who, bucket))  # runs of one owner compress
    rows, cut = cuts(bucket, order)
    home = int(signs[0][0] % buckets) if signs else 0
    lists = lambda xs, kind: pa.array([None] * len(rows) + [xs], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*rows, home], pa.int32()),
            lists(ids, pa.int64()), lists(sizes, pa.int64()), lists([s[0] for s in signs], pa.int64()), lists([s[1] for s in signs], pa.int64()), lists(local.tolist(), pa.int64()),
            pa.array([*(hashes[c].tobytes() for c in cut), b""], pa.binary()), pa.array([*(who[c].tobytes() for c in cut), b""], pa.binary()),
        ],
        ["bucket", "ids", "sizes", "s1", "s2", "local", "hashes", "who"],
    )


def _screen_out(buckets: int, k: int):
    def run(batches):
        state = ([], [], [], [], [])
        held = 0
        for doc, (found, other) in _sets(batches, k):
            ids, sizes, signs, tokens, owners = state
            ids.append(doc), sizes.append(len(found)), signs.append(signature(found, other))
            if doc is not None and len(found):
                tokens.append(found[: prefix(len(found))].copy())
                owners.append(len(ids) - 1)
                held += len(tokens[-1])
            if held >= FLUSH or len(ids) >= FLUSH // 8:
                yield _packed(buckets, *state)
                state, held = ([], [], [], [], []), 0
        if state[0]:
            yield _packed(buckets, *state)

    return run


def _screen_in(table: pa.Table, buckets: int) -> pa.Table:
    """What came to this bucket, dealt out by home (a hash of doc_id): documents, and for each owner how many of its hashes came from elsewhere, too."""
    hashes = np.frombuffer(b"".join(table["hashes"].to_pylist()), U)
    who = np.frombuffer(b"".join(table["who"].to_pylist()), np.int64)
    order = np.argsort(hashes)
    hashes, who = hashes[order], who[order]
    same = hashes[1:] == hashes[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(hashes) else np.zeros(0, bool)
    owners, hits = np.unique(who[shared & (who != NOBODY)], return_counts=True)
    docs = table.filter(table["ids"].is_valid())
    flat = [pa.chunked_array([x.flatten() for x in docs[c].chunks], pa.int64()).combine_chunks() for c in ("ids", "sizes", "s1", "s2", "local")]
    none = pa.nulls(len(owners), pa.int64())
    columns = [pa.concat_arrays([a, b]) for a, b in zip(flat, (pa.array(owners), none, none, none, pa.array(hits)), strict=True)]
    home = (mix(columns[0].fill_null(0).to_numpy().astype(U)) % U(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    homes, parts = cuts(home, order)
    edges = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(edges, c.take(pa.array(order))) for c in columns]
    return pa.table([pa.array(homes, pa.int32()), *lists], ["home", "ids", "n", "s1", "s2", "hits"])


def _screen_home(table: pa.Table) -> pa.Table:
    """One row per document, with all its hits."""
    flat = {c: table[c].combine_chunks().flatten() for c in ("ids", "n", "s1", "s2", "hits")}
    docs = np.asarray(flat["n"].is_valid())
    ids, hits = flat["ids"].fill_null(NOBODY).to_numpy(), flat["hits"].to_numpy()
    owners, at = np.unique(ids[~docs], return_inverse=True)
    total = np.append(np.bincount(at, hits[~docs], len(owners)).astype(np.int64), 0)
    place = np.searchsorted(owners, ids[docs])
    found = np.append(owners, NOBODY)[place] == ids[docs]
    kept = {c: x.filter(pa.array(docs)) for c, x in flat.items()}
    kept["hits"] = pa.array(hits[docs] + np.where(found, total[place], 0))
    return pa.table(list(kept.values()), ["doc_id", "n", "s1", "s2", "hits"])


def _whole_sets(k: int):
    def run(batches):
        for batch in batches:
            rows = []
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "s1", "s2")), strict=True))
            for (doc, n, s1, s2), (_, found) in zip(wanted, _sets([batch.select(["doc_id", "text"])], k), strict=True):
                if (n, s1, s2) == (len(found[0]), *signature(*found)):
                    rows.append((doc, n, whole(*found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["node", "n", "found"])

    return run


def _heads(batches):
    """The first members of each prefix."""
    for batch in batches:
        keys = [members(raw)[: min(HEADS, prefix(n))].astype(np.int64) for raw, n in zip(batch.column("found").to_pylist(), batch.column("n").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(keys, pa.list_(pa.int64()))], ["node", "n", "keys"])


def _tokens(entire: bool):
    """The members of each set, or those of the prefix that the screen takes."""

    def run(batches):
        for batch in batches:
            found = [members(raw)[: None if entire else prefix(n)].astype(np.int64) for raw, n in zip(batch.column("found").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.int64()))], ["family", "component", "node", "n", "tokens"])

    return run


def crossing(tokens: DataFrame) -> DataFrame:
    """(token, df): shingles that nodes of different components and of different families share."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("component", "family") for n, f in (("low", F.min), ("high", F.max))]
    many = tokens.groupBy("token").agg(*ends, F.count("*").alias("df")).where("low_component <> high_component and low_family <> high_family")
    return many.select(fresh("token"), "df")


def _similar(batches):
    for batch in batches:
        keep = []
        for i, (a, b) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
            both = np.concatenate((np.frombuffer(a, MEMBER), np.frombuffer(b, MEMBER)))
            both = both[np.argsort(both["hash"], kind="stable")]
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= 75 * (len(both) - common):
                keep.append(i)
        yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets link."""
    x = sets.select(F.col("node").alias("u"), F.col("found").alias("x"))
    y = sets.select(F.col("node").alias("v"), F.col("found").alias("y"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_similar, "u long, v long")


def fame(stage: Stage, sets: DataFrame) -> DataFrame:
    """(key, node, n, fame): the first members of each node's prefix, and how many nodes share them. Sets near the middle of a group have the most."""
    keys = stage.keep(sets.mapInArrow(_heads, "node long, n long, keys array<long>").select("node", "n", F.explode("keys").alias("key")), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1").select(fresh("key"), "nodes")
    known = keys.join(shared, "key").groupBy("node").agg(F.sum("nodes").alias("fame")).select(fresh("node"), "fame")
    return stage.keep(keys.join(shared.select("key"), "key", "left_semi").join(known, "node"), "fame")


def leaders(keys: DataFrame, votes: int = 4) -> DataFrame:
    """(u, v): for each node u the leader v that most of its first members name, if `votes` or all of a smaller set do and it isn't u itself.

    The leader of a member is the most famous of the nodes that share it.
    """
    heads = keys.groupBy("key").agg(F.max(F.struct("fame", F.col("node").alias("v"), F.col("n").alias("m"))).alias("head"))
    met = keys.join(heads.select(fresh("key"), "head.v", "head.m"), "key").where("node <> v and 4 * least(n, m) >= 3 * greatest(n, m)")
    best = met.groupBy("node", "v").agg(F.count("*").alias("votes"), F.least(F.lit(votes), (F.first("n") / 2).cast("long") + 1).alias("least")).where("votes >= least").groupBy("node").agg(F.max(F.struct("votes", "v")).alias("top"))
    return best.select(F.col("node").alias("u"), F.col("top.v").alias("v"))


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """A forest of the links between two blocks of sets."""
    pairs = []
    if left.num_rows and right.num_rows:
        sets, nodes = [np.frombuffer(raw, MEMBER) for raw in right["found"].to_pylist()], right["node"].to_numpy()
        sizes = np.array([len(x) for x in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(every["hash"], kind="stable")
        tokens, checks, owner = every["hash"][order], every["check"][order], owner[order]
        for u, raw in zip(left["node_l"].to_pylist(), left["found_l"].to_pylist(), strict=True):
            own = np.frombuffer(raw, MEMBER)
            low, high = np.searchsorted(tokens, own["hash"], "left"), np.searchsorted(tokens, own["hash"], "right")
            times = high - low
            at = np.repeat(low - np.concatenate(([0], times.cumsum()[:-1])), times) + np.arange(times.sum())
            common = np.bincount(owner[at[checks[at] == np.repeat(own["check"], times)]], minlength=len(sets))
            v = nodes[(100 * common >= 75 * (len(own) + sizes - common)) & (nodes != u)]
            pairs.append(np.column_stack((np.full(len(v), u), v)))
    edges = forest(np.concatenate(pairs)) if pairs else np.zeros((0, 2), np.int64)
    return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])


def family_links(stage: Stage, sets: DataFrame, families: DataFrame, known: DataFrame) -> DataFrame:
    """(u, v): a forest of the links inside families (node, family), as far as `known` lacks them.

    Members that aren't of the leader's component meet all members of the family, in blocks of BLOCK sets. A group of near copies that all
    link to their leader takes no work here.
    """
    component = F.coalesce("component", "node")
    lead = families.select("family").distinct().join(known.select(F.col("node").alias("family"), "component"), "family", "left").select(fresh("family"), F.coalesce("component", "family").alias("lead"))
    member = families.join(known, "node", "left").select("node", "family", component.alias("component")).join(lead, "family").withColumn("outside", F.col("component") != F.col("lead"))
    blocks = member.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("nb"), F.ceil(F.count_if("outside") / BLOCK).cast("long").alias("no")).where("no > 0")
    placed = stage.keep(member.join(blocks.select(fresh("family"), "nb", "no"), "family").select("node", "family", "outside", "nb", "no"), "placed")
    mine = F.xxhash64("node")
    rows = sets.join(placed, "node").select("node", "found", "family", "outside", F.pmod(mine, "nb").alias("own_b"), F.pmod(mine, "no").alias("own_o"), "nb", "no")
    left = rows.where("outside").select("node", "found", "family", "own_o", F.explode(F.expr("sequence(0L, nb - 1)"))).toDF("node_l", "found_l", "family_l", "o_l", "b_l")
    right = rows.select("node", "found", "family", F.explode(F.expr("sequence(0L, no - 1)")).alias("o"), F.col("own_b").alias("b"))
    return left.groupBy("family_l", "o_l", "b_l").cogroup(right.groupBy("family", "o", "b")).applyInArrow(_block_links, "u long, v long")


def candidates(stage: Stage, sets: DataFrame, families: DataFrame, known: DataFrame, choices: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """(u, v): pairs of different components of `known` and of different families whose adaptive prefixes share enough shingles."""
    placed = stage.keep(families.join(known, "node", "left").select("node", "family", F.coalesce("component", "node").alias("component")), "groups")
    member = sets.join(placed, "node").select("family", "component", "node", "n", "found")
    exploded = lambda df, whole: df.mapInArrow(_tokens(whole), "family long, component long, node long, n long, tokens array<long>").select("family", "component", "node", "n", F.explode("tokens").alias("token"))
    # What the screen asks for, but now of other components and families: most sets end here.
    prefixes = stage.keep(exploded(member, False), "prefixes")
    hits = prefixes.join(crossing(prefixes), "token").groupBy("node").agg(F.count("*").alias("hits"), F.first("n").alias("m")).where(f"hits > {least('m', SCREEN)}")
    member = member.join(stage.keep(hits.select("node"), "left"), "node", "left_semi").select("family", "component", "node", "n", "found")
    stage.drop("prefixes")
    tokens = stage.keep(exploded(member, True), "tokens")
    postings = stage.keep(tokens.join(crossing(tokens), "token").select("token", "df", "family", "component", "node", "n"), "postings")
    stage.drop("tokens")
    enough = postings.groupBy("node").agg(F.count("*").alias("shared"), F.first("n").alias("m")).where("shared >= (3 * m + 3) div 4").select(fresh("node"), "shared")
    order = Window.partitionBy("node").orderBy("df", "token")
    ranked = postings.join(enough, "node").withColumn("rank", F.row_number().over(order)).withColumn("cost", F.sum(F.col("df") - 1).over(order))
    base = F.expr("shared - (3 * n + 3) div 4 + 1")
    # The cost of asking for r matches: the postings of the prefix that r takes, and VERIFY for each candidate, of which there are at most postings / r.
    # More than what a pair surely shares can't be asked for.
    taken = lambda r: F.max(F.when(F.col("rank") <= base + (r - 1), F.col("cost"))).over(Window.partitionBy("node"))
    costs = F.array(*(F.when(F.lit(r) <= F.expr("(3 * n + 3) div 4"), taken(r) * (1 + VERIFY / r)).otherwise(F.lit(float("inf"))) for r in choices))
    chosen = F.element_at(F.array(*map(F.lit, choices)), F.array_position(costs, F.array_min(costs)).cast("int"))
    index = stage.keep(ranked.withColumn("r", chosen).where(F.col("rank") <= base + F.col("r") - 1).select("token", "node", "n", "component", "family", "r"), "index")
    stage.drop("postings")
    one, other = index.select("token", *(F.col(c).alias(f"{c}_u") for c in ("node", "n", "component", "family", "r"))), index.select("token", *(F.col(c).alias(f"{c}_v") for c in ("node", "n", "component", "family", "r")))
    met = one.join(other, "token").where("node_u < node_v and component_u <> component_v and family_u <> family_v and 4 * least(n_u, n_v) >= 3 * greatest(n_u, n_v)")
    counted = met.groupBy(F.col("node_u").alias("u"), F.col("node_v").alias("v")).agg(F.count("*").alias("matches"), F.min(F.least("r_u", "r_v")).alias("r"))
    return counted.where("matches >= r").select("u", "v")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs; links are Jaccard similarities of 0.75 or more."""
    spark = docs.sparkSession
    stage = Stage(spark, "ngram")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    # What comes to one bucket is held by one task: their number grows with the texts.
    buckets = max(parallelism(spark), (docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BUCKET_BYTES)
    sent = docs.mapInArrow(_screen_out(buckets, words), "bucket int, ids array<long>, sizes array<long>, s1 array<long>, s2 array<long>, local array<long>, hashes binary, who binary")
    dealt = sent.groupBy("bucket").applyInArrow(lambda t: _screen_in(t, buckets), "home int, ids array<long>, n array<long>, s1 array<long>, s2 array<long>, hits array<long>")
    screen = stage.keep(dealt.groupBy("home").applyInArrow(_screen_home, "doc_id long, n long, s1 long, s2 long, hits long"), "screen")
    meta = screen.select("doc_id", "n", "s1", "s2")
    classes = stage.keep(meta.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node")), "classes")
    found = screen.where(f"n > 0 and doc_id is not null and hits > {least('n', SCREEN)}").select("doc_id", "n", "s1", "s2").distinct()
    alive = stage.keep(found.join(classes.select(F.col("node").alias("doc_id"), "n", "s1", "s2"), ["doc_id", "n", "s1", "s2"], "left_semi"), "alive")
    # Sets are met by node several times: bucketed, they stay where they are, and only the other side is shuffled.
    whole = docs.join(small(alive), "doc_id").select("doc_id", "n", "s1", "s2", "text").mapInArrow(_whole_sets(words), "node long, n long, found binary")
    sets = stage.keep_bucketed(whole, "sets", "node")
    led = stage.keep(leaders(fame(stage, sets)), "led")
    stage.drop("keys", "fame")
    families = stage.keep(sets.select("node").distinct().join(led, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("family")), "families")
    links = stage.keep(verified(led, sets), "links-0")
    known = stage.keep(components(stage, links, "turn-0"), "known-0")
    links = links.union(stage.keep(family_links(stage, sets, families, known), "links-1"))
    known = stage.keep(components(stage, links, "turn-1"), "known-1")
    more = stage.keep(verified(candidates(stage, sets, families, known), sets), "more")
    final = stage.keep(components(stage, links.union(more), "final"), "components")
    stage.drop("index", "sets", "alive", "placed", "groups")
    named = classes.join(final, "node", "left").select("n", "s1", "s2", F.coalesce("component", "node").alias("component"))
    named = stage.keep(named, "named")
    return meta.join(named, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id, and one row of rows that are equal in doc_id and text.

    Rows without a doc_id stay; rows that share a doc_id but no text are one document and stay or go together.
    """
    stage = Stage(docs.sparkSession, "unique")
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(small(stage.keep(gone, "gone")), "doc_id", "left_anti").select(docs.columns)
    again = stage.keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    repeated = kept.join(small(again), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(small(again), "doc_id", "left_anti").select(docs.columns).unionByName(repeated)


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
