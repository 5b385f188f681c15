"""Conversation repair against a search over all edits, cut conversations, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from callscope.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_faults(turns):
    seen, out = set(), []
    for role, text in turns:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repairs(turns, faults, most):
    """All repairs with at most `most` insertions in a row: (cost, audit, result)."""
    inserts = [x for n in range(most + 1) for x in itertools.product("ua", repeat=n)]
    names = {"u": "user", "a": "assistant"}
    choices = []
    for (role, text), fault in zip(turns, faults, strict=True):
        late = fault == "truncated"
        own = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            own += [(late, "K", [(role, text)])] + [(2 + late, "R", [(names[x], text)]) for x in "ua"]
        choices.append(own)
    for picked in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(turns) + 1):
            cost, audit, result = 0, "", []
            for i, gap in enumerate(gaps):
                cost, audit = cost + 2 * len(gap), audit + "I" * len(gap)
                result += [(names[x], "") for x in gap]
                if i < len(picked):
                    cost, audit, result = cost + picked[i][0], audit + picked[i][1], result + picked[i][2]
            if LEGAL.fullmatch("".join(role[:1] or "-" for role, _ in result)):
                yield cost, audit, result


@pytest.mark.parametrize("seed", range(40))
def test_lightest_against_all_repairs(seed):
    r = random.Random(seed)
    turns = [(r.choice(["system", "user", "assistant", "tool", "ucraft", ""]), r.choice(["a.", "b.", "c", "", " \t", "d!", "e?"])) for _ in range(r.randrange(4))]
    faults = plain_faults(turns)
    codes = [(role[:1], f in ("blank", "duplicate"), int(f == "truncated")) for (role, _), f in zip(turns, faults, strict=True)]
    cost, audit, result = min(plain_repairs(turns, faults, 2), key=lambda x: x[:2])
    ((got),) = repair.lightest(codes).values()
    assert got == (cost, audit)
    assert [(t["role"], t["text"]) for t in repair.edited(turns, audit)] == result
    assert "".join(t["edit"] for t in repair.edited(turns, audit)) == audit.replace("D", "")


@pytest.mark.parametrize("seed", range(20))
def test_parts_chain_to_the_whole(seed):
    """However a conversation is cut, its parts give the lightest repair of the whole."""
    r = random.Random(seed)
    codes = [(r.choice("suaut"), r.random() < 0.2, int(r.random() < 0.3)) for _ in range(r.randrange(1, 30))]
    ((cost, audit),) = repair.lightest(codes).values()
    cuts = sorted(r.sample(range(len(codes) + 1), r.randrange(min(4, len(codes)))))
    parts = []
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(codes)], strict=True)):
        items = repair.lightest(codes[a:b], tuple(range(4)), goal=False)
        none = dict.fromkeys(("distinct", "blank", "duplicate", "truncated", "illegal"), 0)
        parts.append({"part": n, "low": None, "high": None, **none, "head": None, "tail": None, "items": [{"origin": p, "state": q, "cost": c, "audit": x} for (p, q), (c, x) in items.items()]})
    got = repair._chained(1, parts)
    assert (got[-1]["cost"], got[-1]["audit"], "".join(x["piece"] for x in got)) == (cost, audit, audit)


def test_rerole_keeps_what_follows():
    """A truncated turn of the wrong role costs three either way; D comes before R."""
    assert repair.lightest([("u", False, 0), ("u", False, 1), ("a", False, 0)]) == {(repair.START, repair.DONE): (3, "KDK")}


def plain_report(rows):
    by = {}
    for conv, *_ in rows:
        by.setdefault(conv, [])
    for row in plain_damage(rows):
        by[row[0]].append(row[1:])
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        said = [t[1:] for t in turns]
        faults, known = plain_faults(said), [t[0] for t in turns if t[0] is not None]
        codes = [(role[:1], f in ("blank", "duplicate"), int(f == "truncated")) for (role, _), f in zip(said, faults, strict=True)]
        ((cost, audit),) = repair.lightest(codes).values()
        text = "\n".join(f"{t['role']}:{t['text']}" for t in repair.edited(said, audit))
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(said))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, cost double, part string, copies string, audit string"


def test_odd_conversations(spark):
    """Nulls in all columns, empty and long texts, repeated rows, one conversation of thousands of rows, columns with the operator's own names."""
    r = random.Random(5)
    rows = [(None, 1, "user", "x."), (None, None, None, None), (1, None, "system", "s."), (1, None, "user", "hi."), (1, 2, "assistant", "y" * 100000 + "."), (2, 5, "tool", "t."), (2, 5, "tool", "t."), (3, 1, "user", " ")]
    rows += [(9, i // 2, r.choice(["user", "assistant"]), r.choice(["same.", f"text {i}.", f"cut {i}", ""])) for i in range(5000)]
    rows += [(10 + i % 400, i // 400, ["user", "assistant"][i // 400 % 2], f"t{i % 1000}.") for i in range(2400)]
    rows += [(1000, 7, "user", "all the same.")] * 1500
    df = spark.createDataFrame([(*x, 0.5, "p", "c", "a") for x in rows], SCHEMA)
    got = {x[0]: tuple(x[1:]) for x in repair.reported(df).collect()}
    assert got == plain_report(rows)
    assert any(n[0] for n in got.values()) and len(got) == len({x[0] for x in rows})
    assert repair.reported(df.where("false")).collect() == []


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    got = {x[0]: tuple(x[1:]) for x in repair.op11(spark, data).collect()}
    assert got == plain_report([tuple(x) for x in df.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_turns(spark):
    """The operator's own output: what each turn is now and which edit made it."""
    df = spark.createDataFrame([(1, 0, "user", "Q.", 1), (1, 1, "user", "A.", 1), (1, 2, "user", "", 1), (2, 0, "user", "gone", 0)], "conv_id long, turn long, role string, text string, copies int")
    found = sorted(repair.repair(df).collect(), key=lambda x: (x["conv_id"], x["part"] or 0))
    assert {x["conv_id"]: (x["cost"], x["audit"]) for x in found if x["audit"] is not None} == {1: (5, "KRD"), 2: (0, "")}
    assert [(x["conv_id"], *t) for x in found for t in x["turns"]] == [(1, "K", "user", "Q."), (1, "R", "assistant", "A.")]
