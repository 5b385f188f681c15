"""Secret scans: three fixed patterns, and assignment-aware lexing of source and configuration syntax.

Every whole text is screened on its bytes with numpy and substring search; only texts that hold a possible match are
lexed. The lexer walks over strings (of one or of several lines, with escapes), comments and names, and reads name-literal pairs: ``name = "literal"``,
``"name": literal``, ``name := literal``, ``name: type = "literal"``, ``table["name"] = "literal"``, ``--name=literal``, ``--name literal``,
``<name>literal</name>``, ``name: |`` with the literal on the next line, ``name: ["literal", ...]``, ``<add key="name" value="literal"/>``, ``setName("literal")``,
``set("name", "literal")``, literals in round brackets, on a continued line, or joined by ``+``. Strings and comments are
read inside, too (connection strings, commented assignments); a quote behind a backslash begins no string, so that each string is read to its end once. Names that are assigned to other names (constants, wherever they stand) are followed,
and each literal is scored by the most sensitive name that it reaches.

Cases: null and empty texts have no spans; repeated rows are scanned each; rows with a null id are kept; offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, texts_of

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_STRING = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)"""
_LONG = r"""(?:\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3})"""
_BARE = r"[A-Za-z0-9+/_.=~$-]+"
#: Blanks and comments that may stand inside an assignment; before a literal also the end of a line that goes on.
_GAP = r"(?:[\x20\t]|/\*[^*\n]*\*/)*"
_ON = rf"{_GAP}(?:\(\s*|(?:\\|//[^\n]*|\#[^\n]*)?\r?\n[\x20\t]*(?=[\"'`]))?"
_TYPE = r"(?:&(?:'\w+[\x20\t]+)?(?:mut[\x20\t]+)?|\*)?[A-Za-z_$][\w$.]*(?:[<\[][\w$.,|<>\[\]&*:'\x20\t]{0,80}[>\]])?(?:[\x20\t]*\|[\x20\t]*[A-Za-z_$][\w$.]*)*\??"
#: What the lexer stops at: where a string begins, and names with the dashes of a flag. A quote after a letter is an apostrophe or an end.
NEXT = re.compile(r"""(?P<long>(?<!\\)(?:\"{3}|'{3}))|(?P<quote>(?<![\w$\\])["'`])|(?<![\w$.-])(?P<dash>--?(?=[A-Za-z_]))?(?P<name>[A-Za-z_$][\w$.-]*)""", re.A)
STRING = re.compile(rf"{_LONG}|{_STRING}", re.S)
#: After a name: what closes it, and the sign of an assignment.
SIGN = re.compile(rf"[\"'`]?\]?[?!]?{_GAP}(:=|=>|===?|=|:(?!:)|>(?=[^<>\s]+</))")
TYPED = re.compile(rf"{_GAP}{_TYPE}{_GAP}=(?!=)(?={_ON}[\"'`]|[\x20\t])", re.A)
LITERAL = re.compile(rf"{_ON}(?:[rRbBuUfFL@]{{0,2}}(?P<quoted>{_LONG}|{_STRING})|[|>][+-]?[\x20\t]*\r?\n[\x20\t]+(?P<block>{_BARE})|(?P<bare>{_BARE}))", re.S)
#: Between a flag and its value.
VALUE = re.compile(r"[\x20\t]+(?=[^-\s])")
MORE = re.compile(rf"\s*\+\s*(?P<quoted>{_STRING})", re.S)
#: The strings of a list, those of a call, and what stands between a name's attribute and the one that has its value.
LISTED = re.compile(rf"{_GAP}\[\s*(?P<quoted>{_STRING})", re.S)
NEXT_LISTED = re.compile(rf"\s*,\s*(?P<quoted>{_STRING})", re.S)
CALLED = re.compile(rf"\(\s*(?P<quoted>{_STRING})", re.S)
NAMING = ("key", "name", "id")
#: How sensitive a name is that has this word in it.
NAMED = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 0.9, "privatekey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.7,
}
#: What the screen looks for, in lower case and without what may stand between the words of a name: all words of NAMED hold one of these.
STEMS = [w.encode() for w in NAMED if not any(x != w and x in w for x in NAMED)]
_BETWEEN = b"_-.$"
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_SOLID_BYTE = np.ones(256, bool)
_SOLID_BYTE[list(_BETWEEN)] = False


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the texts that may hold a span of any kind."""
    found = []
    inside, edge = np.concatenate(([False], _HEX_BYTE[data], [False])), np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a run ends with its text
    starts = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
    found.append(starts[ends - starts >= 16])
    found = [np.searchsorted(offsets, np.concatenate(found), "right") - 1]
    raw = data.tobytes()
    low, solid = raw.translate(None, _BETWEEN).lower(), np.concatenate(([0], np.cumsum(_SOLID_BYTE[data])))[offsets]
    for where, ends, word in [(raw, offsets, b"AKIA"), *((low, solid, stem) for stem in STEMS)]:
        at, hits = where.find(word), []
        while at >= 0:
            text = int(np.searchsorted(ends, at, "right"))
            hits.append(text - 1)
            at = where.find(word, max(at + 1, int(ends[text]) if text < len(ends) else len(where)))
        found.append(np.array(hits, np.int64))
    return np.unique(np.concatenate(found))


def name_score(name: str) -> float:
    """The highest weight of a word, or of two neighbouring words, of a snake, kebab, dotted or camel name."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    return max((NAMED.get(w, 0.0) for w in [*words, *map("".join, zip(words, words[1:], strict=False))]), default=0.0)


def literal_score(literal: str) -> float:
    """0 to 1: by length and by the entropy of the characters; what is short or has blanks is no credential."""
    if len(literal) < 8 or re.search(r"\s", literal):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(c / len(literal) * math.log2(c / len(literal)) for c in counts.values())
    return min(1.0, len(literal) / 16) * min(1.0, entropy / 3)


Pair = tuple[str, int, int, bool, str]


def _inside(m: re.Match) -> tuple[int, int]:
    """Where the contents of a string begin and end, without the blanks around those of several lines."""
    start, end = m.span("quoted")
    ends = 3 if end - start >= 6 and m["quoted"][:3] in ('"""', "\'\'\'") else 1
    text = m["quoted"][ends:-ends]
    if ends == 1:
        return start + 1, end - 1
    start += ends + len(text) - len(text.lstrip())
    return start, start + len(text.strip())


def _literal(text: str, at: int, name: str) -> Pair | None:
    """The pair of a name and the literal that begins at a place, after the sign of an assignment."""
    m = LITERAL.match(text, at)
    if not m:
        return None
    if m["quoted"] is None:
        start, end = m.span("bare" if m["bare"] is not None else "block")
        return name, start, end, m["bare"] is None, text[start:end]
    start, end = _inside(m)
    whole, after = text[start:end], m.end()
    while joined := MORE.match(text, after):
        end, after = _inside(joined)[1], joined.end()
        whole += text[_inside(joined)[0] : end]
    return name, start, end, True, re.sub(r"\\(.)", r"\1", whole)


def _strings(text: str, m: re.Match | None) -> list[tuple[int, int, str]]:
    """The string that a match ends with, and those that follow behind commas."""
    out = []
    while m:
        start, end = _inside(m)
        out.append((start, end, re.sub(r"\\(.)", r"\1", text[start:end])))
        m = NEXT_LISTED.match(text, m.end())
    return out


def _called(text: str, m: re.Match) -> list[Pair]:
    """What a setter is called with: its value, or the name and the value."""
    name = m["name"].rpartition(".")[2]
    given = _strings(text, CALLED.match(text, m.end())) if name.lower().startswith("set") else []
    if len(given) > 1:
        return [(given[0][2], given[1][0], given[1][1], True, given[1][2])]
    return [(name, start, end, True, value) for start, end, value in given]


def _assigned(text: str, m: re.Match) -> tuple[list[Pair], int]:
    """The pairs of a name that the lexer has stopped at, and where it goes on: behind a type, which is no name, else behind the name."""
    name, sign = m["name"], SIGN.match(text, m.end())
    if not sign:
        value = VALUE.match(text, m.end()) if m["dash"] == "--" else None
        return [p for p in [value and _literal(text, value.end(), name)] if p] or _called(text, m), m.end()
    if listed := LISTED.match(text, sign.end()):
        return [(name, start, end, True, value) for start, end, value in _strings(text, listed)], m.end()
    typed = TYPED.match(text, sign.end()) if sign[1] == ":" else None
    if not typed:
        return [p for p in [_literal(text, sign.end(), name)] if p], m.end()
    given = _literal(text, typed.end(), name)
    found = [given] if given and given[3] else [_literal(text, sign.end(), name), given]
    return [p for p in found if p], typed.end()


def _pairs(text: str) -> list[Pair]:
    """(name, start and end of the literal, whether it is quoted, what it says) in the order of the names."""
    out: list[Pair] = []
    at, closers = 0, set()
    while m := NEXT.search(text, at):
        at = m.end()
        if m["name"] is not None:
            found, at = _assigned(text, m)
            if found and out and m["name"].lower() == "value" and out[-1][0].lower() in NAMING and not text[out[-1][2] + 1 : m.start()].strip():
                found = [(out[-1][4], *found[0][1:]), *found[1:]]  # an attribute names what the next one holds
            out += found
        elif m.start() not in closers:  # a string: its inside is read like all else, its end is known
            string = STRING.match(text, m.start())
            if string:
                closers.add(string.end() - len(m[0]))
    return out


def _reached(pairs: list[Pair]) -> list[int]:
    """For each pair the one whose literal it holds: an unquoted literal that is a name means the last pair of that name before, else the first one after."""
    first: dict[str, int] = {}
    for i, (name, *_) in enumerate(pairs):
        first.setdefault(name, i)
    last: dict[str, int] = {}
    to = []
    for i, (name, _, _, quoted, value) in enumerate(pairs):
        to.append(i if quoted else last.get(value, first.get(value, i)))
        last[name] = i
    ends: dict[int, int] = {}
    for i in range(len(pairs)):
        path, on = [i], {i}
        while (at := path[-1]) not in ends and to[at] not in on:
            path.append(to[at])
            on.add(to[at])
        end = ends.get(at, at)
        if end == at and to[at] != at and at not in ends:
            end = min(path[path.index(to[at]) :])  # names that only mean each other
        ends.update(dict.fromkeys(path, end))
    return [ends[i] for i in range(len(pairs))]


def lexed(text: str, least: float = 0.5) -> list[tuple[int, int]]:
    """Spans of the literals that a sensitive name holds, directly or through constants, in the order of the text."""
    pairs, best = _pairs(text), {}
    for (name, *_), i in zip(pairs, _reached(pairs), strict=True):
        if weight := name_score(name):
            _, start, end, _, value = pairs[i]
            best[start, end] = max(best.get((start, end), 0.0), weight * literal_score(value))
    return sorted(span for span, score in best.items() if score >= least)


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind as listed in KINDS."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    out += [("literal", *s) for s in lexed(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _found(column: pa.Array):
    """(row, text, spans) of the rows that have spans."""
    for at, _, data, offsets in texts_of(column):
        for i in _suspects(data, offsets).tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            if spans := scan(text):
                yield at + i, text, spans


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _spans(batches):
    for batch in batches:
        rows: list[list] = [[] for _ in range(batch.num_rows)]
        for i, _, spans in _found(batch.column(1)):
            rows[i] = [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], ["doc_id", "found"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and found: all spans (kind, start, end) of the whole text, in order."""
    return docs.select("doc_id", "text").mapInArrow(_spans, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _redact(batches):
    for batch in batches:
        names, columns = batch.schema.names, list(batch.columns)
        changed = {i: redacted(text, spans) for i, text, spans in _found(columns[names.index("text")])}
        if changed:
            at = names.index("text")
            texts = columns[at].to_pylist()
            for i, text in changed.items():
                texts[i] = text
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                sizes = columns[names.index("n_chars")].to_pylist()
                for i, text in changed.items():
                    sizes[i] = len(text)
                columns[names.index("n_chars")] = pa.array(sizes, columns[names.index("n_chars")].type)
        yield pa.RecordBatch.from_arrays(columns, names)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced, and n_chars set anew where text changed; all else as it was."""
    return docs.mapInArrow(_redact, docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(load(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("found", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )
