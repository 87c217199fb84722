"""Secret scans by assignment-aware lexing (operator 8).

Three base patterns always count: `assign`, `access` and `hex` (below). On top of them, every line with an
assignment sign is lexed into (name, expression) pairs: `name = value`, `name: value`, `name := value`,
`name => value`, `name += value`, `name: type = value`, blanks or none around the sign, with names bare, quoted or
subscripted (`cfg["db"]["pwd"]` is the name cfg.db.pwd), and values quoted, bare, joined by `+`, or other names. A
value may run over lines: lists and calls in brackets, strings in triple quotes, and items or blocks below a key, up
to the next line with an assignment. Names bound to literals are constants: `password = NAME` leads back to the
literal NAME was bound to last, or, if it isn't bound before, to the one it is bound to next. Each literal scores by the sensitive words of the names it reaches times how random it looks; from THRESHOLD on it
is a span of kind `literal`, unless a base span already touches it.

Spans are in code points of the original text, end exclusive. Defined results: null and empty texts have no
spans; equal starts are ordered by kind as listed; repeated rows each get a result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

KINDS = ("assign", "access", "hex", "literal")
_either = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
_ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')}" + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough

THRESHOLD = 0.5
# Words of a name, and how sure they make that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "privatekey": 1.0, "accesskey": 1.0, "authkey": 1.0, "bearer": 0.9, "auth": 0.8, "authorization": 0.8, "key": 0.7, "pass": 0.8, "pw": 0.8, "dsn": 0.6, "signature": 0.6, "salt": 0.6}
PUBLIC = {"public", "id", "name", "url", "path", "file", "length", "size", "type", "count", "hint", "field", "label", "primary", "foreign", "sort"}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|0+|<.*>|\$\{.*\}|\$\w+|%\w+%|\{\{.*\}\}|change[-_ ]?me|your[-_ ].*|example.*|null|none|true|false|todo|test|default)$")
_STRING = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
_LEX = re.compile(rf"""(?P<string>{_STRING})|(?P<set>\+=|:=|=>|={{1,3}}|:(?!//))|(?P<plus>\+)|(?P<word>[A-Za-z0-9_$@%./~!-](?:[A-Za-z0-9_$@%./~!+-]|:(?=//))*)|(?P<other>\S)""")
_PADDING = re.compile(rf"""={{1,2}}(?!\s*(?:{_STRING}))(?=[\s"',;)\]}}]|$)""")  # the end of a base64 value; name="..." has none
# Types of annotations; they and names in capitals and small letters are not bound as names.
TYPES = {"any", "array", "auto", "bool", "byte", "bytes", "char", "const", "dict", "final", "float", "int", "list", "map", "none", "null", "object", "option", "optional", "static", "str", "string", "tuple", "undefined", "union", "text", "typing", "vec"}
_NO_TARGET = {"if", "elif", "while", "for", "with", "case", "when", "in", "and", "or", "not", "is"}  # before `x: y = ...`, x is no target


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and not overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORD.findall(name)]
    if not words:
        return 0.0
    joined = [a + b for a, b in zip(words, words[1:])]
    best = max([SENSITIVE.get(w, 0.0) for w in words + joined])
    return best * (0.4 if words[-1] in PUBLIC or "public" in words else 1.0)


def literal_score(value: str) -> float:
    """From 0 to 1: long, mixed and without repetition counts."""
    n = len(value)
    if n < 8 or any(c.isspace() for c in value) or _PLACEHOLDER.match(value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
    if kinds < 2 or not any(c.isdigit() or not c.isalnum() for c in value):
        return 0.0
    if value.count("/") > 2 and "://" not in value:  # a path
        return 0.0
    return min(1.0, entropy / 3.0) * min(1.0, 0.5 + n / 24)


# Bare values hold signs that names don't.
_BARE = re.compile(r"""[^\s"'`,;()\[\]{}<>=:|\\]+""")
_ITEM = re.compile(r"""[ \t]*-[ \t]+("[^"\n]*"|'[^'\n]*'|[^\s"'#][^\s"']*)[ \t]*(?:#.*)?$""")
_BLOCK = re.compile(r"[ \t]+(\S+)[ \t]*$")


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, spans of the literals in its value, other names in its value), in the order of the text."""
    out = []
    start = 0
    more = None  # the literals of a value that goes on, and how: by a bracket's depth, in quotes, or below a key
    for line in text.split("\n"):
        if more and more[1] in ('"""', "'''"):
            end = line.find(more[1])
            _stripped(line[: end if end >= 0 else None], start, more[0])
            more = None if end >= 0 else more
        elif "=" in line or ":" in line:
            more = _line_pairs(line, start, out)
        elif more and isinstance(more[1], int):
            depth = _in_brackets(line, 0, start, more[1], more[0])
            more = (more[0], depth) if depth > 0 and line.strip() else None
        elif more:
            m = (_BLOCK if more[1] == "block" else _ITEM).match(line)
            if m:
                quoted = m[1][0] in "\"'"
                more[0].append((start + m.start(1) + quoted, start + m.end(1) - quoted))
            else:
                more = None
        start += len(line) + 1
    return out


def _stripped(piece: str, start: int, literals: list) -> None:
    """A line of a block string as a literal."""
    if inside := piece.strip():
        a = start + len(piece) - len(piece.lstrip())
        literals.append((a, a + len(inside)))


def _in_brackets(line: str, at: int, start: int, depth: int, literals: list) -> int:
    """Gathers the strings of a line from a place in brackets on; the depth at the end of the line or of the brackets."""
    for m in _LEX.finditer(line, at):
        if m.lastgroup == "string":
            literals.append((start + m.start() + 1, start + m.end() - 1))
        elif m.lastgroup == "other":
            depth += (m[0] in "[(") - (m[0] in "])")
            if depth <= 0:
                return 0
    return depth


def _opening(line: str, tokens: list, i: int) -> int:
    """The index of the bracket that token i closes, or -1."""
    depth = 0
    for k in range(i, -1, -1):
        kind, a, _ = tokens[k]
        if kind == "other":
            depth += (line[a] in "]}") - (line[a] in "[{")
            if not depth:
                return k
        elif kind == "set":
            break
    return -1


def _closing(line: str, tokens: list, i: int) -> int:
    """The index of the bracket that closes the subscript that token i opens, or -1."""
    depth = 0
    for k in range(i, len(tokens)):
        kind, a, _ = tokens[k]
        if kind == "other":
            depth += (line[a] in "[{") - (line[a] in "]}")
            if not depth:
                return k
        elif kind == "set":
            break
    return -1


def _plain(line: str, token: tuple) -> str:
    kind, a, b = token
    return line[a + 1 : b - 1] if kind == "string" else line[a:b].lstrip("-$@")


def _joined(line: str, tokens: list) -> str:
    """The dotted name of a subscripted one: cfg["db"]["pwd"] is cfg.db.pwd."""
    return ".".join(_plain(line, t) for t in tokens if t[0] in ("word", "string"))


def _target(line: str, tokens: list, i: int) -> tuple[int, str | None]:
    """The first token and the name of the target that ends at token i; no name if there is none."""
    first = i
    while first >= 0 and tokens[first][0] == "other" and line[tokens[first][1]] in "]}":
        opened = _opening(line, tokens, first)
        if opened < 0:
            return first, None
        beside = opened and tokens[opened - 1][2] == tokens[opened][1]
        before = tokens[opened - 1] if beside else None
        if before and (before[0] == "word" or before[0] == "other" and line[before[1]] in "]}"):
            first = opened - 1
        elif first - opened == 2:  # ["name"] alone, as in a table of Lua or a computed key
            first = opened
            break
        else:
            return first, None
    if first == i and (i < 0 or tokens[i][0] not in ("word", "string")):
        return first, None
    return first, _joined(line, tokens[first : i + 1]) or None


def _is_type(name: str) -> bool:
    """Whether a name reads as a type: str, typing.Optional.str, SecretStr."""
    return all(p.lower() in TYPES or p[:1].isupper() and not p.isupper() for p in name.strip(".").split("."))


def _annotated(line: str, tokens: list, first: int, end: int) -> str | None:
    """The name that is declared by `name: type =`, where a type runs from some token to end and its last part starts at first."""
    depth, typed, k = 0, False, end - 1
    while k >= 0:
        kind, a, b = tokens[k]
        if kind == "set":
            break
        if kind == "other":
            sign = line[a]
            depth += (sign in "])>") - (sign in "[(<")
            if depth < 0 or sign not in "[]()<>?|&*'," or sign == "," and not depth:
                return None
        else:
            typed = typed or kind == "word" and _is_type(line[a:b])
        k -= 1
    if k < 1 or depth or line[tokens[k][1] : tokens[k][2]] != ":" or not (typed or k == first - 1):
        return None
    begin, name = _target(line, tokens, k - 1)
    before = tokens[begin - 1] if begin > 0 else None
    return None if before and line[before[1] : before[2]] in _NO_TARGET else name


def _line_pairs(line: str, start: int, out: list) -> tuple[list, int | str] | None:
    """Adds the pairs of a line. Returns the literals of its last value and how it goes on, if it may."""
    more = None
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _LEX.finditer(line)]
    for i in range(1, len(tokens)):
        if tokens[i][0] != "set":
            continue
        sign = line[tokens[i][1] : tokens[i][2]]
        first, name = _target(line, tokens, i - 1)
        targets = [name] if name else []
        if sign == "=":
            declared = _annotated(line, tokens, first, i)
            if declared:
                targets = [declared] + [n for n in targets if name_score(n) or not _is_type(n)]
        if not targets:
            continue
        literals, names, more = [], [], None
        if sign == "+=" or sign == "=" and targets[-1].endswith("+"):
            targets = [t.rstrip("+") for t in targets]
            names += targets
        rest = line[tokens[i][2] :].strip()
        if sign == ":" and rest in ("", "|", "|-", ">", ">-"):
            more = literals, "block" if rest else "items"
        elif rest[:3] in ('"""', "'''"):
            at = line.index(rest[:3], tokens[i][2]) + 3
            end = line.find(rest[:3], at)
            _stripped(line[at : end if end >= 0 else None], start + at, literals)
            more = (literals, rest[:3]) if end < 0 else None
        else:
            more = _value(line, start, tokens, i + 1, literals, names)
        if literals or more:
            out += [(t, literals, names) for t in targets]
    return more


def _value(line: str, start: int, tokens: list, j: int, literals: list, names: list) -> tuple[list, int | str] | None:
    """Gathers literals and names of the value at token j; as `_line_pairs` if it goes on."""
    while j < len(tokens):
        kind, a, b = tokens[j]
        if kind == "other" and line[a] in "[(":
            depth = _in_brackets(line, a, start, 0, literals)
            return (literals, depth) if depth > 0 else None
        if kind == "string":
            literals.append((start + a + 1, start + b - 1))
        elif kind == "word":
            word = line[a:b].lstrip("$")
            names += [word, *(word.split("+") if "+" in word else [])]
            wide = _BARE.match(line, a)
            padding = j + 1 < len(tokens) and tokens[j + 1][0] == "set" and tokens[j + 1][1] == b and _PADDING.match(line, b)
            if padding:
                b = padding.end()
                j += 1
            elif wide and wide.end() > b:  # a bare value with signs in it is one literal
                b = wide.end()
                while j + 1 < len(tokens) and tokens[j + 1][1] < b:
                    j += 1
            literals.append((start + a, start + b))
            if j + 1 < len(tokens) and tokens[j + 1][1] == b and line[b] == "(":  # a call
                depth = _in_brackets(line, b, start, 0, literals)
                return (literals, depth) if depth > 0 else None
            while j + 1 < len(tokens) and tokens[j + 1][1] == tokens[j][2] and line[tokens[j + 1][1]] in "[{":
                closed = _closing(line, tokens, j + 1)
                if closed < 0:
                    break
                names.append(f"{names[-1]}.{_joined(line, tokens[j + 1 : closed])}")
                j = closed
        else:
            break
        j += 1
        if j >= len(tokens) or tokens[j][0] != "plus":
            break
        j += 1
    return None


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals whose names, its own or those it is passed on to, are sensitive.

    An assignment points at those that its other names are bound by then, or next. From the surest scores down
    each is handed on along these, so an assignment is visited once, at the highest score that reaches it."""
    found = pairs(text)
    bound: dict[str, int] = {}
    sources: list[list[int]] = []
    ahead: dict[str, list[int]] = {}
    scores: list[float] = []
    for i, (name, _, names) in enumerate(found):
        sources.append([bound[other] for other in names if other in bound])
        for other in names:
            if other not in bound:
                ahead.setdefault(other, []).append(i)
        scores.append(name_score(name))
        for k in ahead.pop(name, ()):
            if k != i:
                sources[k].append(i)
        bound[name] = i
    reach: dict[tuple[int, int], float] = {}
    visited = [False] * len(found)
    for first in sorted((i for i, s in enumerate(scores) if s), key=lambda i: -scores[i]):
        score, open_ = scores[first], [first]
        while open_:
            i = open_.pop()
            if not visited[i]:
                visited[i] = True
                for span in found[i][1]:
                    reach[span] = max(reach.get(span, 0.0), score)
                open_ += sources[i]
    return [(a, 3, b) for (a, b), score in reach.items() if score * literal_score(text[a:b]) >= THRESHOLD]


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end) by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base, base
    ends: list[int] = []
    for _, _, end in base:
        ends.append(max(end, ends[-1] if ends else 0))
    starts = [s for s, _, _ in base]
    more = [x for x in lexed_spans(text) if not ((k := bisect_left(starts, x[2])) and ends[k - 1] > x[0])]
    return base, sorted(base + more)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of touching spans replaced by a mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at or not out:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base array<struct<kind,start,end>>, spans array<struct<kind,start,end>>, redacted string)."""
    kind = docs.schema[key].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [find_secrets(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([as_rows(b) for b, _ in found], struct), pa.array([as_rows(s) for _, s in found], struct), pa.array([redact(t, s) if s else t for t, (_, s) in zip(texts, found)], pa.string())], [key, "base", "spans", "redacted"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, redacted string")


def redact_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with their secrets replaced in the text, and n_chars counted anew where a text changed."""
    from pyspark.sql.types import StringType

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(text).to_pylist()
            new = [redact(t, s) if (s := find_secrets(t)[1]) else t for t in old]
            columns = {n: batch.column(n) for n in names}
            columns[text] = pa.array(new, pa.string())
            if length in columns:
                kept = columns[length].to_pylist()
                columns[length] = pa.array([len(b) if b is not a else n for a, b, n in zip(old, new, kept)], columns[length].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    assert isinstance(docs.schema[text].dataType, StringType)
    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(t) for t in batch.column("text").to_pylist()]
            count = [Counter(k for _, k, _ in b) for b, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([c[k] for c in count], pa.int64()) for k in range(3)), pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]), pa.array([listed(s) for _, s in found])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
