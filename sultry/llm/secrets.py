"""Secret scans: fixed patterns plus sliding-window entropy."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character from which a window of 20 characters of the class counts as random.
LEAST = {"hex": 3.0, "mixhex": 3.1, "mixed": 3.8, "lower": 3.5, "upper": 3.5, "letters": 4.0}
#: Strings that look random but are public by nature: identifiers, documentation examples, runs of an alphabet.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|EXAMPLE|example|0123456789|abcdefghij|ABCDEFGHIJ")
#: Places where a digit meets a letter, or a lower-case letter an upper-case one: few in words and numbers, many in random strings.
CHANGE = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
TURN = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LOG_WINDOW, _LEAST_OF_ALL = log2(WINDOW), min(LEAST.values())
_C = [0.0] + [c * log2(c) for c in range(1, WINDOW + 2)]


def char_class(s: str) -> str | None:
    """hex: hexadecimal with digits and letters; mixhex: the same with letters of both cases; mixed: digits, upper and lower case; lower, upper: digits and letters of one case;
    letters: upper and lower case in turn too often for words; else not judged."""
    digits = sum("0" <= c <= "9" for c in s)
    if digits and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
        return "hex" if re.search("[a-fA-F]", s) else None
    upper, lower = re.search("[A-Z]", s), re.search("[a-z]", s)
    if digits and upper and lower:
        return "mixhex" if re.fullmatch("[0-9a-fA-F]+", s) else "mixed"
    if digits >= 2 and (upper or lower) and len(CHANGE.findall(s)) >= 3:
        return "upper" if upper else "lower"
    return "letters" if not digits and upper and lower and len(TURN.findall(s)) >= 4 else None


def entropy_spans(s: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows whose Shannon entropy is at least `least`. A step changes two counts, and
    the sum of c*log2(c) follows from these alone."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _C[n + 1] - _C[n]
        if i >= window:
            old = s[i - window]
            n = counts[old]
            counts[old] = n - 1
            total -= _C[n] - _C[n - 1]
        if i >= window - 1 and log2(window) - total / window >= least:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def _kinds(c: str) -> tuple[bool, bool, bool, bool, bool, bool]:
    """Whether a character is a digit, upper, lower, hexadecimal with small, with capital and with either letters."""
    return "0" <= c <= "9", "A" <= c <= "Z", "a" <= c <= "z", c in "0123456789abcdef", c in "0123456789ABCDEF", c in "0123456789abcdefABCDEF"


_KINDS = {chr(i): _kinds(chr(i)) for i in range(128)}


def random_spans(s: str, whole: str | None = None) -> list[tuple[int, int]]:
    """Merged windows that are random for their own character class (that of char_class), or for `whole`, that of the candidate. A window
    without all of hex's or mixed's characters shows only part of a token, so that its span is widened to the letters and digits around it.

    A step changes the counts of one character that comes and one that goes: of each character for the entropy, of each
    kind, and of the places where kinds change. Work is in proportion to the length."""
    out: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, n = 0.0, [0, 0, 0, 0, 0, 0]
    kinds = [_KINDS[c] for c in s]
    change = [False] + [(p[0] and (q[1] or q[2])) or (q[0] and (p[1] or p[2])) for p, q in zip(kinds, kinds[1:])]
    turn = [False] + [p[2] and q[1] for p, q in zip(kinds, kinds[1:])]
    changes = turns = 0
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += _C[k + 1] - _C[k]
        for x in range(6):
            n[x] += kinds[i][x]
        start = i - WINDOW + 1
        if start > 0:
            old = s[start - 1]
            k = counts[old]
            counts[old] = k - 1
            total -= _C[k] - _C[k - 1]
            for x in range(6):
                n[x] -= kinds[start - 1][x]
            changes -= change[start]
            turns -= turn[start]
        if i:
            changes += change[i]
            turns += turn[i]
        if start < 0 or out and out[-1][0] <= start and i < out[-1][1]:
            continue
        bits = _LOG_WINDOW - total / WINDOW
        if bits < _LEAST_OF_ALL:
            continue
        digits, upper, lower, small, capital, either = n
        kind, x, y = None, start, i + 1
        if digits and WINDOW in (small, capital):
            kind = "hex" if upper or lower else None
        elif digits and upper and lower:
            kind = "mixhex" if either == WINDOW else "mixed"
        elif digits >= 2 and (upper or lower) and changes >= 3:
            kind = "upper" if upper else "lower"
        elif not digits and upper and lower and turns >= 4:
            kind = "letters"
        if not (whole and bits >= LEAST[whole]):
            if kind is None or bits < LEAST[kind]:
                continue
            if kind in ("lower", "upper", "letters"):
                while x and s[x - 1].isalnum():
                    x -= 1
                while y < len(s) and s[y].isalnum():
                    y += 1
        while out and x <= out[-1][1]:
            x, y = min(x, out[-1][0]), max(y, out[-1][1])
            out.pop()
        out.append((x, y))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans as sorted disjoint ones."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def outside(start: int, end: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [start, end) outside the known spans, which are sorted and disjoint."""
    out = []
    for i in range(bisect_right(known, start, key=lambda k: k[1]), len(known)):
        x, y = known[i]
        if x >= end:
            break
        if start < x:
            out.append((start, x))
        start = max(start, y)
    return [*out, (start, end)] if start < end else out


def find_spans(text: str | None) -> list[dict]:
    """All spans of one text by start, then kind as listed."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = merged([(x, y) for x, _, y in found])
    for m in CANDIDATE.finditer(text):
        kind = char_class(m[0])
        allowed = merged([(m.start() + a.start(), m.start() + a.end()) for a in ALLOWED.finditer(m[0])])
        whole = kind if kind in ("hex", "mixhex", "mixed") and not allowed else None
        for x, y in outside(m.start(), m.end(), base):
            for start, end in outside(x, y, allowed):
                if end - start >= WINDOW:
                    found += [(a + start, 3, b + start) for a, b in random_spans(text[start:end], whole)]
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)]


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `secrets`, array<struct<kind, start, end>> over the whole text, in code points, end exclusive, by
    start and then kind (assign, access, hex, entropy).

    assign, access and hex are pattern matches; entropy spans are runs of windows of random-looking characters
    outside those and outside the allow-list. Null and empty texts have no spans. Every row is scanned on its
    own in the task that reads it: no shuffle, whatever repeats. A column named secrets is replaced."""
    docs = docs.drop("secrets")
    names = docs.columns

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        spans = pa.array([find_spans(t) for t in batch.column(names.index(text)).to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*names, "secrets"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, scan, f"{fields}, secrets array<struct<kind:string,start:int,end:int>>")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str | None, mark: str) -> str | None:
    """The text with `mark` in place of its spans; what lies between them is cut out once and joined once."""
    out, at = [], 0
    for span in find_spans(text):
        if span["start"] >= at:
            out += [text[at : span["start"]], mark]
        at = max(at, span["end"])
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret span of the text replaced by `mark`; overlapping spans are
    replaced once. Texts without secrets stay as they are, null ones null. Time is in proportion to a text's length, however many spans it has."""
    names = docs.columns
    at = names.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        new = pa.array([redacted(t, mark) for t in batch.column(at).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names)

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
