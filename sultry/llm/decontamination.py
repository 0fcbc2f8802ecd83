"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, chunks, map_batches, materialize, mix, signed, text_bytes, word_hashes

WINDOW = 8
#: Of a window's words at least so many must be plain, so that rows of placeholders match nothing.
PLAIN = 5
#: Share of an item's windows that must be found, nearly in one order and with consistent slots.
COVERAGE = 0.6
#: Shifts of one passage may differ by so many tokens, as a capitalised word can be read as a name in one place and not in another.
DRIFT = 4
#: Bytes of text that a task looks at together.
CHUNK = 1 << 20
#: Bits of the filter that tells tasks which windows can be in the benchmark; its size never grows.
FILTER_BITS = 1 << 23

# A default, not a fixed list: units that count as one placeholder after a number.
UNITS = "mm cm m km in ft yd mi mg g kg oz lb lbs t ml l s sec min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds usd eur gbp dollars euros cents meters metres miles percent %".split()

_EDGE = re.compile(rb"^[^\w\x80-\xff%]+|[^\w\x80-\xff%]+$")
_NUMBER = re.compile(rb"[+-]?[$\xe2\x82\xac]*\d[\d.,:/]*(?:st|nd|rd|th)?$")
_MEASURE = re.compile(rb"([+-]?[$\xe2\x82\xac]*\d[\d.,:/]*)([a-z]+|%)$")
_MARKS = dict(zip(("number", "name"), (signed(word_hashes([b"\x00number", b"\x00name"])).view(np.uint64)), strict=True))
_UNITS = {u.encode() for u in UNITS}
#: Sets hashes of values apart from hashes of templates.
_VALUES = np.uint64(0xD6E8FEB86659FD93)
#: Weights of the words of a name, so that their order counts.
_ODD = 2 * np.arange(1, 65, dtype=np.uint64) + np.uint64(1)


class _Forms(dict):
    """Numbers of words seen by this worker, with what canonical forms need of each: the hash of its bare, folded form, the same or of the
    word itself where it is all punctuation, and whether it is a number, a unit, capitalised, and whether a sentence ends with it. Emptied when it has grown to MOST words."""

    MOST = 200_000

    def __init__(self) -> None:
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.hashes, self.units, self.literals, self.flags = array("Q"), array("Q"), array("Q"), array("B")

    def __missing__(self, w: bytes) -> int:
        # Most words are plain letters, with which there is little to do.
        letters = w.isalpha()
        core = w if letters else _EDGE.sub(b"", w)
        low = core if core.isascii() and core.islower() else core.decode("utf-8", "replace").lower().encode()
        h = self.digest(low)
        capital = core != low and core[:1] != low[:1]
        number = not letters and _NUMBER.match(core) is not None
        joined = None if letters or number else _MEASURE.match(low)
        if joined and joined[2] in _UNITS:
            number = True
        self.hashes.append(self.digest(joined[1]) if joined and number else h)
        self.units.append(self.digest(joined[2]) if joined and number else 0)
        self.literals.append(h if low else self.digest(w))
        self.flags.append(number | 2 * (low in _UNITS) | 4 * capital | 8 * (not letters and w[-1:] in b".!?:"))
        n = self[w] = len(self)
        return n


_FORMS = _Forms()


class _Words:
    """Words of texts that begin at the places `begins`: value hashes, kinds (0 plain, 1 number, 2 unit, 3 name), literal hashes, which tell signs
    apart, which words begin a sentence, and which of these may be names.

    Punctuation around a word goes and case folds. A number becomes a placeholder, a unit after a number
    too, and so does a name: a capitalised word that does not begin a sentence. One that does may be a name or not."""

    def __init__(self, words: list[bytes], begins: np.ndarray):
        global _FORMS
        if len(_FORMS) > _Forms.MOST:
            _FORMS = _Forms()
        at = np.fromiter(map(_FORMS.__getitem__, words), np.int64, len(words))
        flags = np.frombuffer(_FORMS.flags, np.uint8)[at]
        self.values, self.unit, self.literal = (np.frombuffer(x, np.uint64)[at] for x in (_FORMS.hashes, _FORMS.units, _FORMS.literals))
        first = np.zeros(len(words) + 1, bool)
        first[begins] = True
        first = first[:-1]
        number, capital = (flags & 1).astype(bool), (flags & 4) > 0
        after = np.concatenate([[False], number[:-1]]) & ~first
        self.start = np.concatenate([[True], (flags[:-1] & 8).astype(bool)]) | first
        self.kind = np.where(number, 1, np.where(after & ((flags & 2) > 0), 2, np.where(~self.start & capital, 3, 0))).astype(np.int8)
        self.maybe = self.start & (self.kind == 0) & capital


class _Tokens:
    """Tokens of words of the given kinds: a plain word, a number with its unit, or a run of name words within a sentence. at and to are the
    first word of each and the one behind it, until the number of tokens up to the end of a token's text."""

    def __init__(self, words: _Words, kind: np.ndarray, ends: np.ndarray):
        joined = (kind == 2) | ((kind == 3) & np.concatenate([[False], kind[:-1] == 3]) & ~words.start)
        self.at = np.flatnonzero(~joined)
        self.to = np.append(self.at[1:], len(kind))
        self.kind = kind[self.at]
        self.until = np.searchsorted(self.at, ends)[np.searchsorted(ends, self.at, "right")]
        self.plain = np.concatenate([[0], np.cumsum(self.kind == 0)])
        self.number = np.cumsum(~joined) - 1  # of each word
        self.words, hashes = words, words.values[self.at]
        for k, name in ((1, "number"), (3, "name")):
            hashes[self.kind == k] = _MARKS[name]
        self.typed = Rolling(hashes)

    def inside(self, k: int) -> np.ndarray:
        """Which windows of k tokens lie within one text."""
        n = max(0, len(self.at) - k + 1)
        return np.arange(n) + k <= self.until[:n]

    def count(self, sums: np.ndarray, k: int) -> np.ndarray:
        return sums[k:] - sums[: len(sums) - k]

    def slots(self, p: int, k: int) -> np.ndarray:
        """The values of the placeholders among tokens p to p + k: of a number its own and its unit's (0 without one), of a run of names one."""
        out, w = [], self.words
        for i in range(p, p + k):
            a, b = self.at[i], self.to[i]
            if self.kind[i] == 1:
                out += [w.values[a], w.values[a + 1] if b - a > 1 else w.unit[a]]
            elif self.kind[i] == 3:
                out.append(w.values[a] if b - a == 1 else w.values[a:b] @ _ODD[: b - a] if b - a <= len(_ODD) else w.values[a:b].sum())
        return np.array(out, np.uint64)


def _windows(words: _Words, ends: np.ndarray, size: int, short: list[int] | None) -> Iterator[tuple[_Tokens, np.ndarray, np.ndarray, int, np.ndarray | None]]:
    """(tokens, places, hashes, size, literal): the template windows with enough plain words; those with a capitalised word that begins a sentence
    once more with such words as names; then the windows of values, with literal hashes of the tokens, where there are too few plain words. The kind of a
    window's first word depends on the word before it, so that windows that just have enough plain words are hashed both ways."""
    plain = _Tokens(words, words.kind, ends)
    named = _Tokens(words, np.where(words.maybe, np.int8(3), words.kind), ends) if words.maybe.any() else None
    literal = untyped = None
    for k in [min(size, len(plain.at))] if short is None else [size, *short]:
        n, inside, least = plain.count(plain.plain, k), plain.inside(k), min(PLAIN, k)
        at = np.flatnonzero(inside & (n >= least)) if len(inside) else np.zeros(0, np.int64)
        yield plain, at, plain.typed.windows(k)[at], k, None
        few = np.flatnonzero(inside & (n <= least)) if len(inside) else at[:0]
        if len(few):
            if untyped is None:
                literal = Rolling(words.literal).spans(plain.at, plain.to)
                untyped = Rolling(literal)
            yield plain, few, mix(untyped.spans(few, few + k) ^ _VALUES), k, literal
    if named:
        names = np.concatenate([[0], np.cumsum(words.maybe[named.at])])
        for k in [min(size, len(named.at))] if short is None else [size, *short]:
            inside = named.inside(k)
            if len(inside):
                at = np.flatnonzero(inside & (named.count(names, k) > 0) & (named.count(named.plain, k) >= min(PLAIN, k)))
                yield named, at, named.typed.windows(k)[at], k, None


def template_windows(texts: DataFrame, key: str, text: str, wanted: bytes | None = None, size: int = WINDOW, short: list[int] | None = None) -> DataFrame:
    """Rows (key, pos, size, hash, slots): the windows of each text's tokens; pos counts tokens, with capitalised words that begin a sentence as
    names. Windows with at least PLAIN plain words are templates, slots being
    the value hashes of the placeholders in order; the others are hashed by value, and slots are the values of all tokens. `wanted`, a bitmap over
    the low bits of the hash, leaves out windows that cannot match. With `short` there are windows of these sizes besides; without it, a text
    shorter than a window forms one window of all its tokens. Texts are read some megabytes at a time."""
    held = None if wanted is None else texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, data = batch.column(0).to_pylist(), text_bytes(batch.column(1))
        bits = None if held is None else np.frombuffer(held.value, np.uint8)
        # Texts of their own window size go one by one.
        for a, b in chunks([len(t) for t in data], CHUNK) if short is not None else ((i, i + 1) for i in range(len(data))):
            out: list[list] = [[], [], [], [], []]
            split = [t.split() for t in data[a:b]]
            ends = np.cumsum([len(w) for w in split])
            if not ends[-1]:
                continue
            begins = ends - [len(w) for w in split]
            words = _Words([w for ws in split for w in ws], begins)
            place = None
            for tokens, at, hashes, k, literal in _windows(words, ends, size, short):
                if bits is not None:
                    low = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    some = ((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1).astype(bool)
                    at, hashes = at[some], hashes[some]
                if not len(at):
                    continue
                if place is None:
                    place = _Tokens(words, np.where(words.maybe, np.int8(3), words.kind), ends).number
                first = tokens.at[at]
                texts_of = np.searchsorted(ends, first, "right")
                pos = place[first] - place[np.minimum(begins[texts_of], len(place) - 1)]
                for p, i, n, h in zip(at.tolist(), texts_of.tolist(), pos.tolist(), signed(hashes).tolist(), strict=True):
                    slots = tokens.slots(p, k) if literal is None else literal[p : p + k]
                    for column, value in zip(out, (keys[a + i], n, k, h, signed(slots).tolist()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.list_(pa.int64()))], ["key", "pos", "size", "hash", "slots"])

    return map_batches(texts.select(F.col(key).cast("long"), F.col(text)), run, "key long, pos int, size int, hash long, slots array<long>")


def _bitmap(windows: DataFrame) -> bytes:
    """The filter bits of all window hashes; at most FILTER_BITS / 32 rows reach the driver."""
    at = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int")
    words = windows.select(at.alias("at")).groupBy((F.col("at") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, at % 32)")).alias("b"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for w, b in words.collect():
        out[w] = b
    return out.astype("<u4").tobytes()


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, n_found, n_changed, exact) of documents that hold a benchmark item,
    word for word (exact) or with other numbers, names or units put in consistently.

    Windows of 8 canonical tokens (a run of name words is one, as is a number with its unit) of both sides meet in a join on their hash, and for items of fewer tokens windows of their length;
    where fewer than PLAIN words of a window are plain, the words themselves are hashed, so that every item has windows. A capitalised word that begins a
    sentence is hashed both as a plain word and as a name. Matches of one document and item
    count along one diagonal (position in the document minus position in the item, within DRIFT). Each slot value of the item stands for
    one value of the document, the one of most windows; windows with another are set aside. Several item values may get one value,
    unless the item has that value too and keeps it: then nothing tells them apart, and windows with either are set aside. An item is held if at least
    `coverage` of its windows are found so. The filter sent to the tasks has a fixed size; the join decides.
    A passage that many documents share only adds rows of its own. Null or empty texts hold nothing; null ids
    are left out; repeated rows count once; extra columns are ignored; either table may be empty."""
    items = materialize(template_windows(benchmark.where(F.col(item_id).isNotNull()), item_id, item_text).withColumnRenamed("key", "item_id"), "items").distinct()
    sizes = items.groupBy("item_id").agg(F.countDistinct("pos").alias("n_windows"))
    short = sorted(r[0] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect())
    items = items.drop("size")
    docs = docs.where(F.col(doc_id).isNotNull())
    found = template_windows(docs, doc_id, text, _bitmap(items), short=short)
    hits = found.join(items.withColumnRenamed("pos", "item_pos").withColumnRenamed("slots", "item_slots"), "hash").where(F.size("slots") == F.size("item_slots"))
    hits = hits.select(F.col("key").alias("doc_id"), "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", F.size("slots").alias("variant"), "slots", "item_slots").distinct()
    hits = materialize(hits, "hits")
    # A passage is what lies within DRIFT shifts from its least one, `at`.
    keys = ["doc_id", "item_id", "at"]
    starts = hits.select("doc_id", "item_id", F.col("shift").alias("at")).distinct()
    near = hits.withColumn("at", F.explode(F.sequence(F.col("shift") - DRIFT, F.col("shift")))).join(starts, keys, "left_semi")
    near = materialize(near.select(*keys, "shift", "item_pos", "variant", "slots", "item_slots"), "near")
    # Slots: each item value stands for the document value that most windows give it.
    pairs = near.select(*keys, "shift", "item_pos", "variant", F.explode(F.arrays_zip("item_slots", "slots")).alias("z")).select(*keys, "shift", "item_pos", "variant", F.col("z.item_slots").alias("i"), F.col("z.slots").alias("d"))
    votes = pairs.groupBy(*keys, "i", "d").agg(F.countDistinct("item_pos").alias("n"))
    chosen = votes.groupBy(*keys, "i").agg(F.max(F.struct("n", (F.col("i") == F.col("d")).alias("same"), "d")).alias("m")).select(*keys, "i", F.col("m.d").alias("d"))
    taken = chosen.where("i = d").select(*keys, "d").join(chosen.where("i <> d").select(*keys, "d").distinct(), [*keys, "d"], "left_semi")
    chosen = chosen.join(taken, [*keys, "d"], "left_anti")
    broken = pairs.join(chosen, [*keys, "i", "d"], "left_anti").select(*keys, "shift", "item_pos", "variant").distinct()
    good = near.join(broken, [*keys, "shift", "item_pos", "variant"], "left_anti")
    other = F.filter(F.arrays_zip("item_slots", "slots"), lambda z: z["item_slots"] != z["slots"])
    runs = good.groupBy(*keys).agg(F.countDistinct("item_pos").alias("n_found"), F.size(F.array_distinct(F.flatten(F.collect_set(F.transform(other, lambda z: z["item_slots"]))))).alias("n_changed"))
    best = runs.join(sizes, "item_id").where(F.col("n_found") >= coverage * F.col("n_windows"))
    best = best.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_found", (-F.col("n_changed")).alias("col2"))).alias("m"), F.first("n_windows").alias("n_windows"))
    return best.select("doc_id", "item_id", "n_windows", F.col("m.n_found").alias("n_found"), (-F.col("m.col2")).alias("n_changed"), (F.col("m.col2") == 0).alias("exact"))
