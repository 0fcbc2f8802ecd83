"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, chunks, map_batches, materialize, mix, signed, text_bytes, word_hashes
from .components import connected_components

#: Fragments of the global order over which a pair's partial overlaps are counted.
FRAGMENTS = 4
#: Bits of the filter that tells tasks which documents take part in a candidate pair; its size never grows.
FILTER_BITS = 1 << 23
#: Bits of the parity sketch of a small set; larger sets have twice as many up to SKETCH_DOUBLINGS times, and a wide sketch of bits in
#: proportion to their size besides, which is only read for pairs that pass the first.
SKETCH_BITS, SKETCH_DOUBLINGS = 384, 3
#: Sets of one signature are compared in blocks of about so many.
BLOCK = 2048
#: Candidate pairs are broadcast up to this number (about 40 bytes each), else joined by shuffle.
BROADCAST_PAIRS = 500_000
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes], n: int, fold: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; the whole sequence is one shingle where a text has
    fewer than n words; nothing without words. The order of the hashes is the global n-gram order."""
    for a, b in chunks([len(t) for t in texts], 1 << 20):
        words = [(t.translate(_FOLD) if fold else t).split() for t in texts[a:b]]
        ends = np.cumsum([len(w) for w in words])
        roll = Rolling(word_hashes([w for ws in words for w in ws]))
        grams = roll.windows(n)
        for ws, end in zip(words, ends.tolist(), strict=True):
            k = len(ws)
            if k >= n:
                yield np.unique(grams[end - k : end - n + 1])
            else:
                yield roll.spans(np.array([end - k]), np.array([end])) if k else np.empty(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


@lru_cache
def size_groups(least: int, most: int, whole: int) -> tuple[list[int], list[int]]:
    """Lower bounds of size classes, and for each class the largest symmetric difference of a linked pair whose
    smaller set is in it: classes are so wide that the larger set is in the same or the next class. least and
    whole: the similarity as a fraction; most: the largest size."""
    bounds, apart = [1], []
    while bounds[-1] <= most:
        top = bounds[-1] * whole // least
        bounds.append(top + 1)
        apart.append((top + top * whole // least) * (whole - least) // (whole + least))
    return bounds, apart


def signatures(s: np.ndarray, least: int, whole: int) -> np.ndarray:
    """Hashes of which a set shares at least one with any set it links to.

    With D the largest difference in a size class, the global order is cut into F > D fragments; a linked pair
    then has at least F - D equal fragments, and each fragment's content is a signature. Empty fragments count
    only for sets with F - D or more of them, for all others some equal fragment has content. Where D is
    at most 1, the set itself and the set less one element serve instead."""
    bounds, apart = size_groups(least, 1 << max(10, int(len(s)).bit_length()), whole)
    own = int(np.searchsorted(bounds, len(s), "right")) - 1
    mixed = mix(s ^ _SALT)
    out = []
    for g in (own, own - 1):
        if g < 0:
            continue
        d = apart[g]
        mark = mix(np.array([g + 1], np.uint64) * _SALT)
        if d <= 1:
            total = mixed.sum(dtype=np.uint64)
            sums = np.concatenate([[total], total - mixed]) if d else np.array([total])
            out.append(mix(sums ^ mark))
            continue
        f = d + 1 + min(6, 1 + d // 10)
        edge = np.searchsorted((s >> np.uint64(32)) * np.uint64(f) >> np.uint64(32), np.arange(f + 1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        full = edge[1:] > edge[:-1]
        part = mix((sums[edge[1:]] - sums[edge[:-1]]) ^ mark) + np.arange(f, dtype=np.uint64) * _SALT
        out.append(mix(part[full] if f - full.sum() < f - d else part))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def parity_sketch(s: np.ndarray, most: int = SKETCH_DOUBLINGS) -> bytes:
    """For each slot whether an odd number of the set's shingles fall there. A shingle in only one of two sets flips one
    bit, so sets that differ by d shingles have sketches that differ by at most d bits. Sets have about as many slots as shingles;
    the halves of a sketch folded by exclusive or are the sketch with half the slots."""
    bits = SKETCH_BITS << min(most, max(0, (len(s) * 5 // (4 * SKETCH_BITS)).bit_length()))
    slots = (mix(s ^ _SALT) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(bool)).tobytes()


def folded(sketches: list[bytes], size: int | None = None) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to `size` bytes or to the shortest."""
    size = size or min(map(len, sketches))
    if all(len(x) == size for x in sketches):
        return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0) for x in sketches])


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n_shingles, cls, sketch, wide) for each document; wide is null where the sketch has enough bits."""

    def row(s: np.ndarray) -> tuple:
        if not len(s):
            return 0, None, None, None
        sketch, wide = parity_sketch(s), parity_sketch(s, 64)
        return len(s), set_id(s), sketch, wide if len(wide) > len(sketch) else None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [row(s) for s in shingle_sets(text_bytes(batch.column(1)), n)]
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "cls", "sketch", "wide"])

    return map_batches(docs, run, "doc_id long, n_shingles long, cls long, sketch binary, wide binary")


def _signature_rows(docs: DataFrame, n: int, least: int, whole: int) -> DataFrame:
    """Rows (sig, cls): the signatures of each set, once in a task, so that a group of copies is no group of rows after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, ids, count = [], [], 0
        for batch in batches:
            for s in shingle_sets(text_bytes(batch.column(1)), n):
                if len(s) and (own := set_id(s)) not in seen:
                    seen.add(own)
                    x = signatures(s, least, whole)
                    sigs.append(x)
                    ids.append(np.full(len(x), own, np.int64))
                    count += len(x)
                if count > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(ids))], ["sig", "cls"])
                    sigs, ids, count = [], [], 0
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(ids))], ["sig", "cls"])

    return docs.mapInArrow(run, "sig long, cls long")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (sig, cls, size) of the signatures that at least two sets have, each set once; size is how many of them stand together
    in a batch. Reads sorted rows as a stream and keeps one row between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # last row, and whether it is out already
        for batch in batches:
            sig, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            out = False
            if held:
                sig, cls, out = np.concatenate([[held[0]], sig]), np.concatenate([[held[1]], cls]), held[2]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
            sig, cls = sig[new], cls[new]
            same = sig[1:] == sig[:-1]  # row i + 1 goes with row i
            follows = np.concatenate([[False], same])
            keep = follows | np.concatenate([same, [False]])
            keep[0] &= not out
            held = (sig[-1], cls[-1], bool(follows[-1]) if len(sig) > 1 else out)
            if keep.any():
                first = np.flatnonzero(~follows)
                count = np.diff(np.concatenate([first, [len(sig)]]))
                size = np.repeat(count, count).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(cls[keep]), pa.array(size[keep])], ["sig", "cls", "size"])

    return rows.mapInArrow(run, "sig long, cls long, size int")


def _filter_word(doc_id) -> F.Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS)).cast("int")


def _bitmap(ids: DataFrame, column: str) -> bytes:
    """Filter bits of the ids; at most FILTER_BITS / 32 rows reach the driver."""
    words = ids.select(_filter_word(F.col(column)).alias("at")).groupBy((F.col("at") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, at % 32)")).alias("b"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    return out.astype("<u4").tobytes()


def _fragments(docs: DataFrame, wanted: DataFrame, column: str, n: int) -> DataFrame:
    """Rows (cls, doc_id, frag, grams) of the wanted documents and, as the filter lets some pass, of others: their shingles in each
    fragment of the global order."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, column))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bits, at = np.frombuffer(held.value, np.uint8), batch.column(2).to_numpy()
        batch = batch.filter(pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))
        own, ids, frags, grams = [], [], [], []
        for i, s in zip(batch.column(0).to_pylist(), shingle_sets(text_bytes(batch.column(1)), n), strict=True):
            edge = np.searchsorted(s >> np.uint64(62), np.arange(FRAGMENTS + 1, dtype=np.uint64))
            cls = set_id(s)
            for f in range(FRAGMENTS):
                own.append(cls)
                ids.append(i)
                frags.append(f)
                # The upper two bits are the fragment's; of the rest the lower 48 are kept.
                grams.append(s[edge[f] : edge[f + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(ids, pa.int64()), pa.array(frags, pa.int32()), pa.array(grams, pa.binary())], ["cls", "doc_id", "frag", "grams"])

    return map_batches(docs.select("doc_id", "text", _filter_word(F.col("doc_id")).alias("at")), run, "cls long, doc_id long, frag int, grams binary")


def _most_apart(a, b, least: int, whole: int):
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (whole - least) // (whole + least)


def _linkable(pairs: DataFrame, least: int, whole: int) -> DataFrame:
    """Of the pairs (ca, cb, na, nb, sa, sb) those that sizes and sketches do not rule out, as (ca, cb)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        sizes = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)])
        near = np.zeros(batch.num_rows, bool)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x, y = (folded([side[i] for i in at], int(size)) for side in (left, right))
            near[at] = np.bitwise_count(x ^ y).sum(axis=1) <= _most_apart(na[at], nb[at], least, whole)
        yield batch.select(["ca", "cb"]).filter(pa.array(near))

    sized = pairs.where((F.least("na", "nb") * whole >= F.greatest("na", "nb") * least))
    return map_batches(sized.select("ca", "cb", "na", "nb", "sa", "sb"), run, "ca long, cb long")


def _apart(rows: DataFrame, least: int, whole: int) -> DataFrame:
    """Distinct pairs (ca, cb) of sets of one signature and different components that sizes and sketches do not rule out.

    rows: sig, block, side, cls, comp, main, n, sketch. Of each (sig, block) the sets of side 0, one block of the signature's,
    are read first and held; those of side 1, the ones outside the main component, meet them in batches. A signature of one block, numbered -1, has
    no side 1: its sets meet each other at its end. Pairs are compared where they stand, and only those that may link are emitted."""

    def meet(right: list, left: list) -> np.ndarray:
        (rc, rk, rm, rn), (lc, lk, _, ln) = ([np.concatenate(x) for x in zip(*(v[0] for v in side), strict=True)] for side in (right, left))
        rs, ls = ([x for v in side for x in v[1]] for side in (right, left))
        size = min(map(len, rs + ls))
        rs, ls = folded(rs, size), folded(ls, size)
        found = []
        for a in range(0, len(lc), 256):
            x = slice(a, a + 256)
            ok = (lk[x, None] != rk) & ((rk == rm) | (lc[x, None] < rc)) & (np.minimum(ln[x, None], rn) * whole >= np.maximum(ln[x, None], rn) * least)
            i, j = np.nonzero(ok)
            i += a
            near = np.bitwise_count(ls[i] ^ rs[j]).sum(axis=1) <= _most_apart(ln[i], rn[j], least, whole)
            found.append(np.stack([lc[i[near]], rc[j[near]]]))
        return np.concatenate(found, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, right, told = None, [], set()

        def alone() -> list[np.ndarray]:
            """The pairs within a signature of one block that has ended."""
            if key is None or key[1] >= 0 or not right:
                return []
            columns = tuple(np.concatenate(x) for x in zip(*(v[0] for v in right), strict=True))
            sketches, out = [x for v in right for x in v[1]], np.flatnonzero(columns[1] != columns[2])
            return [meet([(columns, sketches)], [(tuple(c[out] for c in columns), [sketches[i] for i in out])])] if len(out) else []

        def fresh(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal told
            pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
            pairs = np.unique(np.sort(pairs, axis=0), axis=1).T.tolist()
            if len(told) > 200_000:
                told = set()
            new = [p for p in map(tuple, pairs) if p not in told]
            told.update(new)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new, strict=True)], ["ca", "cb"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sig, block, side, cls, comp, main, n = (batch.column(k).to_numpy() for k in range(7))
            sketch = batch.column(7).to_pylist()
            new = np.concatenate([[0], np.flatnonzero((sig[1:] != sig[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1, [len(sig)]])
            found = []
            for a, b in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
                part = ((cls[a:b], comp[a:b], main[a:b], n[a:b]), sketch[a:b])
                if (sig[a], block[a]) != key:
                    found += alone()
                    key, right = (sig[a], block[a]), []
                if side[a] == 0:
                    right.append(part)
                elif right:
                    found.append(meet(right, [part]))
            yield from fresh(found)
        yield from fresh(alone())

    stream = rows.repartition("sig", "block").sortWithinPartitions("sig", "block", "side").select("sig", "block", "side", "cls", "comp", "main", "n", "sketch")
    return stream.mapInArrow(run, "ca long, cb long").distinct()


def _overlaps(pairs: DataFrame) -> DataFrame:
    """Adds `both`, the partial overlap of the two sides' grams in one fragment."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def wide(b: bytes) -> np.ndarray:
            out = np.zeros((len(b) // 6, 8), np.uint8)
            out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
            return out.reshape(-1).view("<u8")

        left, right = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        both = [len(np.intersect1d(wide(x), wide(y), assume_unique=True)) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(both, pa.int64())], ["ca", "cb", "frag", "both"])

    return map_batches(pairs, run, "ca long, cb long, frag int, both long")


def verified_links(pairs: DataFrame, grams: DataFrame, least: int, whole: int) -> DataFrame:
    """Of the candidate pairs (ca, cb, na, nb, a, b), a and b being the documents that stand for the sets, those that link, as (a, b): partial
    overlaps are counted in each fragment on its own, then summed for each pair. The grams of cb, of which a pair brings one copy, move to those of ca, of
    which many pairs have the same; rows that repeat a document count once."""
    small = pairs.count() <= BROADCAST_PAIRS
    near = F.broadcast if small else lambda df: df
    right = near(pairs.select("ca", "cb", "b")).join(grams.select(F.col("cls").alias("cb"), F.col("doc_id").alias("b"), "frag", F.col("grams").alias("gb")), ["cb", "b"]).drop("b")
    left = grams.select(F.col("cls").alias("ca"), F.col("doc_id").alias("a"), "frag", F.col("grams").alias("ga")).join(near(pairs.select("ca", "a").distinct()), ["ca", "a"], "left_semi").drop("a")
    both = right.join(left, ["ca", "frag"])
    counts = _overlaps(both.select("ca", "cb", "frag", "ga", "gb")).groupBy("ca", "cb", "frag").agg(F.max("both").alias("both")).groupBy("ca", "cb").agg(F.sum("both").alias("both"))
    return pairs.join(counts, ["ca", "cb"]).where(F.col("both") * whole >= (F.col("na") + F.col("nb") - F.col("both")) * least).select("a", "b")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, least: int = 85, whole: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each input row: the size of its set of distinct n-word
    shingles (A-Z lower-cased) and the least doc_id reachable over links, where two documents link if
    whole * intersection >= least * union.

    Equal sets are one class, represented by its least doc_id. The global n-gram order, that of the shingles'
    hashes, is cut into fragments; classes that agree in a fragment share a signature, and by counting
    every linked pair agrees in one. First each signature's pivot, the class that meets most others, is paired with the
    rest, so that the original of a group of near copies gathers the group at a cost in proportion to its size. Then, in signatures that still
    hold several components, classes outside the pivot's meet all others of different components, in blocks. In both
    steps pairs that sizes and parity sketches rule out, by bounds that always hold, are not emitted, and the others are verified by summing
    partial overlaps of fragments. Pairs inside a component need no test. So no link between components is lost.

    Texts without words and null texts have empty sets and link with nothing; rows with null ids are returned
    with a null component; repeated rows are returned repeatedly; a doc_id with several texts has a row for each, and is in the component of each;
    an empty table gives no rows; other columns are ignored."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(_profile(slim, n), "profiles")
    keyed = slim.where("doc_id is not null")
    classes = rows.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    classes = materialize(classes, "classes")
    shared = materialize(_shared(_signature_rows(keyed, n, least, whole).repartition("sig").sortWithinPartitions("sig", "cls")), "shared")
    meets = materialize(shared.groupBy("cls").agg(F.sum("size").alias("meets")).join(classes.select("cls", "n"), "cls"), "meets")
    shared = materialize(shared.join(meets, "cls").select("sig", "cls", "n", "meets"), "sized")
    pivots = shared.groupBy("sig").agg(F.max(F.struct("meets", "cls", "n")).alias("m")).select("sig", F.col("m.cls").alias("pivot"), F.col("m.n").alias("pivot_n"))
    pivots = materialize(pivots, "pivots")
    a = classes.select(F.col("cls").alias("ca"), F.col("rep").alias("a"), F.col("n").alias("na"), F.coalesce("wide", "sketch").alias("sa"))
    b = classes.select(F.col("cls").alias("cb"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.coalesce("wide", "sketch").alias("sb"))

    def joined(candidates: DataFrame, labels: DataFrame) -> DataFrame:
        """Labels (cls, rep, comp) after the candidates that link have joined their components."""
        pairs = materialize(candidates.join(a.drop("sa"), "ca").join(b.drop("sb"), "cb"), "pairs")
        # Only the texts of documents in these pairs are hashed again.
        grams = materialize(_fragments(keyed, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", n), "fragments")
        links = materialize(verified_links(pairs, grams, least, whole), "links")
        comp = labels.select("rep", "comp").distinct()
        edges = links.join(comp.toDF("a", "ka"), "a").join(comp.toDF("b", "kb"), "b").select("ka", "kb")
        merged = connected_components(edges, "ka", "kb").toDF("comp", "new")
        return materialize(labels.join(merged, "comp", "left").select("cls", "rep", F.coalesce("new", "comp").alias("comp")), "labels")

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (ca, cb) that may link: short sketches first, as most pairs go there, then the wide ones of those that have them."""
        short = lambda side: side.drop("sa", "sb").join(sketches.select(F.col("cls").alias(side.columns[0]), F.col("sketch").alias(f"s{side.columns[1]}")), side.columns[0])
        some = materialize(_linkable(pairs.join(short(a), "ca").join(short(b), "cb"), least, whole), "short")
        return _linkable(some.join(a, "ca").join(b, "cb"), least, whole)

    sketches = classes.select("cls", "sketch").join(meets.select("cls"), "cls")
    fits = F.least("n", "pivot_n") * whole >= F.greatest("n", "pivot_n") * least
    star = shared.join(pivots, "sig").where((F.col("cls") != F.col("pivot")) & fits).select(F.col("pivot").alias("ca"), F.col("cls").alias("cb")).distinct()
    first = materialize(near(star), "candidates")
    labels = joined(first, classes.select("cls", "rep", F.col("rep").alias("comp")))

    comp = labels.select("cls", "comp")
    main = pivots.select("sig", "pivot").join(comp, F.col("pivot") == F.col("cls")).select("sig", "pivot", F.col("comp").alias("main"))
    placed = materialize(shared.select("sig", "cls").join(comp, "cls").join(main, "sig"), "placed")
    open_ = placed.groupBy("sig").agg(F.count("*").alias("m"), F.count_if(F.col("comp") != F.col("main")).alias("k")).where("k > 0 and m > 2")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    there = placed.where("cls <> pivot").join(open_.select("sig", blocks.alias("blocks")), "sig")
    own = F.when(F.col("blocks") == 1, -1).otherwise(F.pmod(F.xxhash64("cls"), F.col("blocks"))).cast("int")
    held = there.select("sig", own.alias("block"), F.lit(0).alias("side"), "cls", "comp", "main")
    sent = there.where("comp <> main and blocks > 1").select("sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "cls", "comp", "main")
    rest = _apart(held.union(sent).join(classes.select("cls", "n", "sketch"), "cls"), least, whole)
    tested = first.select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
    rest = rest.join(tested, ["ca", "cb"], "left_anti")
    rest = materialize(_linkable(rest.join(a, "ca").join(b, "cb"), least, whole), "candidates")
    if not rest.isEmpty():
        labels = joined(rest, labels)
    best = labels.select(F.col("cls").alias("cls_"), "comp")
    out = rows.join(best, F.col("cls") == F.col("cls_"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
