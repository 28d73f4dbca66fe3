"""N-gram Jaccard join by vertical partitioning, with components of the links.

A document's set holds its distinct 3-word shingles (``[^\\x20\\x09-\\x0D]+``
words with A-Z lower-cased; with fewer words, the whole sequence).  Two documents
link when 100 * intersection >= 90 * union.

The global order of the shingles is that of their 64-bit hashes, and it is cut
into fragments.  For sets of up to U shingles a linked pair differs in at most
D = 2 (U - 1) (100 - 90) / (100 + 90) shingles, so with more than D fragments that
hold something, at least one is equal in both.  Hence:

1. Documents with equal sets are one class, and only classes are compared.  A class
   is named by a digest of its set, beside a parity bit map: the number of bits in
   which two maps differ never exceeds the number of shingles in which the sets
   differ, so dropping pairs above the limit loses no link.
2. One document of each class emits a digest of every non-empty fragment, for the
   size band it is in and for the larger one that a partner may be in.  (Should
   hashing leave D non-empty fragments or fewer, it emits its prefix of single
   shingles too; two such classes meet there, every other linked pair in a
   fragment.)  Digests travel packed by the thousand.  Of a digest that a task sees
   in several classes all but the first are known to be repeated and needn't meet;
   so a digest has one entry a task at most where it is looked up.
3. The classes that share a digest are a group; groups of the same classes are one.
   In every group all classes are paired with one, the hub: as many pairs as rows.
4. Pairs within the limit by their maps are counted exactly: both sets are cut into
   ``PARTS`` fragments of the order, the overlaps of the fragments are counted
   separately and summed per pair.  Links make components.
5. Groups with several components are compared inside a task, which returns spanning
   forests of the pairs of different components that may link, nearest first; these
   are counted, and groups with further pairs are compared again, each time with sixteen
   times the forests, until nothing is left.  So in the end every pair of different
   components that share a fragment has been ruled out, by map or by count, and never
   are all pairs returned.  Groups above ``BLOCK`` classes are cut into blocks that
   meet pairwise, but the blocks of the largest component don't meet each other.

Steps 2, 3 and 5 only find candidates; what the method counts by fragments decides.

Defined results: a null text, or one without words, has the empty set and is
linked with nothing; each input row gives one row, repeated rows too (they are one
class); component_id is the smallest doc_id of the component, null if all are
null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored, ship_package
from . import kernels as K
from .components import components
from .runtime import as_longs, bit_filter, fresh, may_hold, split_by_filter

SHINGLE = 3
NUMERATOR, DENOMINATOR = 90, 100
BLOCK = 1024
#: Digests that a task packs at a time, and about as many meet in a bucket.
PACK = 1 << 18
#: Pairs of which a task holds the distances at a time.
HELD = 1 << 21
LEAST_BITS = 256
PARTS = 8
_U = np.uint64


def _bands() -> np.ndarray:
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2))
    return np.array(bounds, dtype=np.int64)


BANDS = _bands()


class Scheme:
    """Fragments and limits of each size band for one threshold."""

    def __init__(self, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, seed: int = 0):
        self.shingle, self.num, self.den, self.seed = shingle, numerator, denominator, seed
        top = BANDS[1:] - 1
        self.differ = 2 * top * (denominator - numerator) // (denominator + numerator)
        self.fragments = (self.differ + 1) * 11 // 10 + 2

    def limit(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The most shingles in which linked sets of these sizes differ."""
        return (n + m) * (self.den - self.num) // (self.den + self.num)

    def fits(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.den * np.minimum(n, m) >= self.num * np.maximum(n, m)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes ascending within each text, how many for each text)."""
        words = K.Words(data, offsets, K.NONSPACE_BYTES)
        counts = words.counts()
        n_docs = len(counts)
        grams = K.gram_hashes(words.hashes, self.shingle)
        whole = words.room() >= self.shingle
        h, doc = grams[whole], words.doc[whole]
        short = np.flatnonzero((counts > 0) & (counts < self.shingle))
        if len(short):
            h = np.concatenate([h, K.run_hashes(words.hashes, words.first[:-1][short], words.first[1:][short])])
            doc = np.concatenate([doc, short])
        if self.seed:
            h = K.mix(h ^ _U(self.seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        order = np.argsort(h)
        doc = doc[order]
        order2 = np.argsort(doc.astype(np.uint16) if n_docs < 1 << 16 else doc, kind="stable")
        h, doc = h[order][order2], doc[order2]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return h[keep], np.bincount(doc[keep], minlength=n_docs)

    def memberships(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, band) pairs: the band of a set's size and every larger one that a partner may be in."""
        own = np.searchsorted(BANDS, n, side="right") - 1
        owners, bands = [], []
        at = np.flatnonzero(n > 0)
        shift = 0
        while len(at):
            band = own[at] + shift
            owners.append(at)
            bands.append(band)
            shift += 1
            at = at[self.den * n[at] >= self.num * BANDS[own[at] + shift]]
        owners, bands = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, bands))
        useful = self.differ[bands] > 0  # else only equal sets link
        return owners[useful], bands[useful]


def _digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(h) + 1, _U)
        np.cumsum(K.mix(h ^ _U(salt)), out=total[1:])
        out.append(K.mix(total[first[1:]] - total[first[:-1]]))
    return out[0], out[1]


def _parity_maps(h: np.ndarray, counts: np.ndarray) -> pa.Array:
    """For each set, which of its places hold an odd number of shingles; a power of two places, 2 to 4 a shingle."""
    bits = np.where(counts > 0, np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(2.0 * np.maximum(counts, 1))).astype(np.int64)), 0)
    edge = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(counts)), counts)
    place = ((h * _U(0xD6E8FEB86659FD93)) >> _U(32)).astype(np.int64) & (bits[row] - 1)
    odd = (np.bincount(edge[row] + place, minlength=edge[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((edge // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def _fragment_digests(scheme: Scheme, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest, set) of every fragment that holds something, for each band of each set."""
    first = np.concatenate([[0], np.cumsum(counts)])
    owner, band = scheme.memberships(counts)
    if not len(owner):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    size = counts[owner]
    at, row = K.spread(first[owner], size)
    tokens = h[at]
    piece = ((tokens >> _U(32)) * scheme.fragments[band].astype(_U)[row]) >> _U(32)
    new = np.ones(len(tokens), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    total = np.zeros(len(tokens) + 1, _U)
    np.cumsum(K.mix(tokens ^ _U(0xA4093822299F31D0)), out=total[1:])
    content = total[np.append(begin[1:], len(tokens))] - total[begin]
    digest = K.mix(content + piece[begin] * _U(0x9E3779B97F4A7C15) + band[row[begin]].astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    of = row[begin]
    poor = np.flatnonzero(np.bincount(of, minlength=len(owner)) <= scheme.differ[band])
    if len(poor):  # too few fragments hold something: single shingles of the prefix
        n = size[poor]
        prefix = n - (scheme.num * n + scheme.den - 1) // scheme.den + 1
        edge = np.concatenate([[0], np.cumsum(size)])
        spot, who = K.spread(edge[poor], prefix)
        digest = np.concatenate([digest, K.mix(tokens[spot] ^ _U(0x082EFA98EC4E6C89))])
        of = np.concatenate([of, poor[who]])
    return digest, owner[of]


_IDS = "doc_id {kind}, n_shingles bigint, cls bigint, b bigint, map binary"


def _class_table(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, n_shingles, cls, b, map) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in K.chunks(batch.column(1)):
                h, counts = scheme.sets(data, off)
                a, b = _digests(h, np.concatenate([[0], np.cumsum(counts)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts), as_longs(a), as_longs(b), _parity_maps(h, counts)], ["doc_id", "n_shingles", "cls", "b", "map"])

    return docs.select("doc_id", "text").mapInArrow(scan, _IDS.format(kind=docs.schema["doc_id"].dataType.simpleString()))


# --- groups of classes that share a fragment ------------------------------------------------


def _sorted_posts(key: np.ndarray, cls: np.ndarray, n: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, cls) in order, with what else belongs to them."""
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    return key[keep], cls[keep], n[order][keep], *(x[order][keep] for x in more)


def _blobs(bucket: np.ndarray, met: bool, key: np.ndarray, cls: np.ndarray, n: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """A row for each run of equal buckets, its entries as bytes."""
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    rows = len(edge) - 1
    packed = []
    for x in (key.astype("<i8"), cls.astype("<i8"), n.astype("<i4"), known.astype("u1")):
        packed.append(pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((edge * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]))
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(np.full(rows, met)), *packed], ["bucket", "met", "key", "cls", "n", "known"])


_BLOB = "bucket int, met boolean, key binary, cls binary, n binary, known binary"


def _pack(scheme: Scheme, copied, chosen, buckets: int):
    """Task over (row_key, text): the digests of one document of each class, packed by bucket.

    Entries that are known to share their digest with another class (``met``) go to any bucket.
    """

    def pack(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, cls, n = _sorted_posts(*(np.concatenate([x[c] for x in held]) for c in range(3)))
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        run = np.cumsum(first) - 1
        many = np.bincount(run)[run] > 1
        place = ((key.view(_U) >> _U(32)) * _U(buckets)) >> _U(32)
        alone = np.flatnonzero(first)
        alone = alone[np.lexsort((cls[alone], place[alone]))]  # a class's entries together, they compress
        yield _blobs(place[alone], False, key[alone], cls[alone], n[alone], many[alone])
        met = np.flatnonzero(~first)
        if len(met):
            anywhere = (K.mix(place[met] + np.arange(len(met), dtype=_U) // _U(4096)) >> _U(32)) * _U(buckets) >> _U(32)
            order = np.argsort(anywhere, kind="stable")
            met = met[order]
            yield _blobs(anywhere[order], True, key[met], cls[met], n[met], many[met])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for lo, hi, data, off in K.chunks(batch.column(1)):
                h, counts = scheme.sets(data, off)
                first = np.concatenate([[0], np.cumsum(counts)])
                a = _digests(h, first)[0].view(np.int64)
                named = a ^ batch.column(0).slice(lo, hi - lo).to_numpy()
                take = np.flatnonzero((counts > 0) & (~may_hold(copied.value, a) | may_hold(chosen.value, named)))
                _, once = np.unique(a[take], return_index=True)
                take = take[np.sort(once)]
                at, _ = K.spread(first[take], counts[take])
                digest, owner = _fragment_digests(scheme, h[at], counts[take])
                held.append((digest.view(np.int64), a[take][owner], counts[take][owner]))
                size += len(digest)
                if size >= PACK:
                    yield from pack(held)
                    held, size = [], 0
        if size:
            yield from pack(held)

    return scan


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket (rows come sorted by it), the entries whose digest is in several classes."""

    def unpacked(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        kinds = (("key", "<i8"), ("cls", "<i8"), ("n", "<i4"), ("known", "u1"))
        return tuple(np.concatenate([np.frombuffer(x, t) for r in rows for x in r.column(c).to_pylist()]) for c, t in kinds)

    def out(key: np.ndarray, cls: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.array(n.astype(np.int64))], ["key", "cls", "n"])

    def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, cls, n, known = unpacked(rows)
        order = np.argsort(known, kind="stable")[::-1]  # of equal entries the one that is known stays
        key, cls, n, known = _sorted_posts(key[order], cls[order], n[order], known[order])
        run = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        shared = (np.bincount(run) > 1) | (np.bincount(run, weights=known) > 0)
        return out(*(x[shared[run]] for x in (key, cls, n)))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        met = batch.column(1).to_numpy(zero_copy_only=False)
        if met.any():
            yield out(*unpacked([batch.filter(pa.array(met))])[:3])
        rest = batch.filter(pa.array(~met))
        bucket = rest.column(0).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if held and held[-1].column(0)[0].as_py() != bucket[lo]:
                yield close(held)
                held = []
            held.append(rest.slice(lo, hi - lo))
    if held:
        yield close(held)


def _posts(slim: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, cls, n): the classes of every digest that several classes have."""
    spark = slim.sparkSession
    repeated = classes.filter("rows > 1").select("cls", F.col("cls").bitwiseXOR(F.xxhash64("first_id")).alias("chosen"))
    copied, chosen = (spark.sparkContext.broadcast(bit_filter(repeated, c)) for c in ("cls", "chosen"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(-(-total // PACK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = slim.select(F.xxhash64("doc_id").alias("row_key"), "text").mapInArrow(_pack(scheme, copied, chosen, buckets), _BLOB)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "key bigint, cls bigint, n bigint")


# --- comparing classes by their maps --------------------------------------------------------


class Maps:
    """Bit maps of a batch of classes, laid end to end."""

    def __init__(self, column: pa.Array):
        raw = column.to_pylist()
        self.width = np.array([len(x) // 8 for x in raw], np.int64)  # in 64-bit words
        self.edge = np.concatenate([[0], np.cumsum(self.width)])
        self.flat = np.frombuffer(b"".join(raw), np.uint64)

    def rows(self, at: np.ndarray, width: int, own: int) -> np.ndarray:
        """The maps ``at``, all ``own`` words wide, folded to ``width`` words (still a parity map)."""
        x = self.flat[self.edge[at][:, None] + np.arange(own)]
        return np.bitwise_xor.reduce(x.reshape(len(at), own // width, width), axis=1) if own > width else x

    def differ(self, at: np.ndarray, other: Maps, to: np.ndarray) -> np.ndarray:
        """For each pair, in how many bits the maps differ."""
        out = np.zeros(len(at), np.int64)
        kinds, which = np.unique(self.width[at] << 32 | other.width[to], return_inverse=True)
        for k, kind in enumerate(kinds.tolist()):
            wide, high = kind >> 32, kind & 0xFFFFFFFF
            width = min(wide, high)
            step = max(1, (1 << 17) // max(wide, high))
            mine = np.flatnonzero(which == k)
            for lo in range(0, len(mine), step):
                some = mine[lo : lo + step]
                out[some] = np.bitwise_count(self.rows(at[some], width, wide) ^ other.rows(to[some], width, high)).sum(axis=1, dtype=np.int64)
        return out


def _forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of a minimal spanning forest of the pairs (Boruvka's rounds)."""
    _, both = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = both[: len(x)], both[len(x) :]
    label = np.arange(both.max(initial=-1) + 1)
    order = np.lexsort((np.arange(len(x)), weight))
    taken: list[np.ndarray] = []
    live = order
    while True:
        live = live[label[x[live]] != label[y[live]]]
        if not len(live):
            return np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
        ends = np.concatenate([label[x[live]], label[y[live]]])
        rank = np.concatenate([np.arange(len(live))] * 2)
        by = np.lexsort((rank, ends))
        lead = np.ones(len(by), bool)
        lead[1:] = ends[by][1:] != ends[by][:-1]
        best = live[np.unique(rank[by[lead]])]
        taken.append(best)
        lo, hi = np.minimum(label[x[best]], label[y[best]]), np.maximum(label[x[best]], label[y[best]])
        parent = np.arange(len(label))
        while True:  # union by the smallest label
            np.minimum.at(parent, hi, parent[lo])
            np.minimum.at(parent, lo, parent[hi])
            jumped = parent[parent]
            if (jumped == parent).all() and (parent[lo] == parent[hi]).all():
                break
            parent = jumped
        label = parent[label]


def _near(scheme: Scheme, group: np.ndarray, side: np.ndarray, n: np.ndarray, maps: Maps, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, bits that differ) of the pairs of different components within a group that may link.

    Rows come by group and size; ``side`` tells, for rows of a pair of blocks, the block (0 or 1), else it is -1.
    """
    end = np.searchsorted(group, group, side="right")
    left, right = [], []
    lag = 1
    live = np.flatnonzero(end - np.arange(len(group)) > lag)
    while len(live):
        live = live[scheme.fits(n[live], n[live + lag])]  # later ones are larger still
        other = live + lag
        ok = ((side[live] < 0) | (side[live] != side[other])) & (root[live] != root[other])
        left.append(live[ok])
        right.append(other[ok])
        lag += 1
        live = live[end[live] - live > lag]
    i, j = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (left, right))
    away = maps.differ(i, maps, j)
    good = away <= scheme.limit(n[i], n[j])
    return i[good], j[good], away[good]


def _compare(scheme: Scheme, forests: int):
    """Task over posts by (key, part, n): (key, part, n, side, cls, root, map) to (key, x, y, more).

    ``more`` tells that a part has further pairs that may link, beyond its ``forests`` forests.
    """

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, n, side, cls, root = (rows[c].to_numpy() for c in ("key", "part", "n", "side", "cls", "root"))
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]]))
        cost = np.cumsum(np.diff(begin) ** 2)
        lo = 0
        while lo < len(cost):  # some whole groups at a time
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + HELD, side="right")))
            cut = slice(begin[lo], begin[hi])
            group = np.repeat(np.arange(hi - lo), np.diff(begin[lo : hi + 1]))
            _, vertex = np.unique(root[cut], return_inverse=True)
            vertex = group * (vertex.max(initial=0) + 1) + vertex  # a component is another vertex in each group
            i, j, away = _near(scheme, group, side[cut], n[cut], Maps(rows["map"].combine_chunks().slice(cut.start, cut.stop - cut.start)), root[cut])
            left = np.arange(len(i))
            taken = [np.zeros(0, np.int64)]
            for _ in range(forests):
                if not len(left):
                    break
                tree = _forest(vertex[i[left]], vertex[j[left]], away[left])
                taken.append(left[tree])
                left = np.delete(left, tree)
            take = np.concatenate(taken)
            more = np.isin(group[i[take]], group[i[left]])
            x, y = cls[cut][i[take]], cls[cut][j[take]]
            yield pa.RecordBatch.from_arrays([pa.array(key[cut][i[take]]), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(more)], ["key", "x", "y", "more"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            cut = int(change[-1]) if len(change) else 0
            if held and (cut or (key[0], part[0]) != last):  # the last group may go on in the next batch
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from compare(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
            last = (key[-1], part[-1])
        if held:
            yield from compare(pa.Table.from_batches(held))

    return run


def _mixed_pairs(rows: DataFrame, maps: DataFrame, scheme: Scheme, forests: int) -> DataFrame:
    """Candidate pairs (key, x, y, more) of groups with several components.

    ``rows``: (key, cls, n, root, giant, giant_rows, rows); blocks of the giant, the group's largest
    component, meet only the blocks of the others.
    """
    minor = F.col("root") != F.col("giant")
    blocks = lambda n: F.ceil(n / float(BLOCK)).cast("bigint")
    rows = rows.withColumn("minors", blocks(F.col("rows") - F.col("giant_rows"))).withColumn("blocks", F.col("minors") + blocks(F.col("giant_rows")))
    h = F.xxhash64("cls")
    rows = rows.withColumn("block", F.when(minor, F.pmod(h, F.col("minors"))).otherwise(F.col("minors") + F.pmod(h, F.col("blocks") - F.col("minors"))))
    met = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.when(minor, F.col("blocks")).otherwise(F.col("minors")) - 1),
        lambda t: F.struct(
            (F.least(t, F.col("block")) * F.col("blocks") + F.greatest(t, F.col("block"))).alias("part"),
            F.when(t == F.col("block"), -1).when(F.col("block") < t, 0).otherwise(1).alias("side"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("part"), F.lit(-1).alias("side")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("rows") <= BLOCK, whole).otherwise(met)))
    rows = rows.select("key", "at.part", "n", "at.side", "cls", "root").join(maps.select("cls", "map"), "cls").select("key", "part", "n", "side", "cls", "root", "map")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "n").mapInArrow(_compare(scheme, forests), "key bigint, x bigint, y bigint, more boolean")


def _within_limit(pairs: DataFrame, maps: DataFrame, scheme: Scheme) -> DataFrame:
    """Of the pairs (x, y, nx, ny) those whose maps differ in no more bits than linked sets may."""
    mx, my = (maps.select(F.col("cls").alias(c), F.col("map").alias(f"m{c}")) for c in "xy")
    pairs = pairs.join(mx, "x").join(my, "y").select("x", "y", "nx", "ny", "mx", "my")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = np.arange(batch.num_rows)
            away = Maps(batch.column(4)).differ(here, Maps(batch.column(5)), here)
            ok = away <= scheme.limit(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(ok))

    return pairs.mapInArrow(thin, "x bigint, y bigint")


# --- exact counts ---------------------------------------------------------------------------


def _fragment_table(docs: DataFrame, scheme: Scheme, wanted: DataFrame) -> DataFrame:
    """(cls, part, tokens) of the classes in ``wanted``: their sets cut into PARTS fragments, as bytes."""
    spark = docs.sparkSession
    filled = spark.sparkContext.broadcast(bit_filter(wanted, "cls"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _lo, _hi, data, off in K.chunks(batch.column(0)):
                h, counts = scheme.sets(data, off)
                first = np.concatenate([[0], np.cumsum(counts)])
                a = _digests(h, first)[0].view(np.int64)
                take = np.flatnonzero(may_hold(filled.value, a) & (counts > 0))
                _, once = np.unique(a[take], return_index=True)
                take = take[np.sort(once)]
                at, row = K.spread(first[take], counts[take])
                tokens = h[at]
                piece = ((tokens >> _U(32)) * _U(PARTS) >> _U(32)).astype(np.int32)
                new = np.ones(len(tokens), bool)
                new[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(new)
                packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((8 * np.append(begin, len(tokens))).astype(np.int32)), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays([pa.array(a[take][row[begin]]), pa.array(piece[begin]), packed], ["cls", "part", "tokens"])

    return docs.select("text").mapInArrow(scan, "cls bigint, part int, tokens binary")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows by (x, salt, part), that of x itself first: (x, y, common) for each fragment of a pair."""
    hub, tokens = None, np.zeros(0, _U)
    for batch in batches:
        x, salt, part, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        other = batch.column(4).to_numpy()
        common = np.zeros(len(x), np.int64)
        for i, raw in enumerate(batch.column(5)):
            mine = np.frombuffer(raw.as_buffer(), _U)
            if own[i]:
                hub, tokens = (x[i], salt[i], part[i]), mine.copy()
            elif hub == (x[i], salt[i], part[i]):
                at = np.searchsorted(tokens, mine)
                at[at == len(tokens)] = 0
                common[i] = np.count_nonzero(tokens[at] == mine)
        take = np.flatnonzero(common)
        yield pa.RecordBatch.from_arrays([pa.array(x[take]), pa.array(other[take]), pa.array(common[take])], ["x", "y", "common"])


def _checked(pairs: DataFrame, slim: DataFrame, sizes: DataFrame, scheme: Scheme, stored: Stored) -> DataFrame:
    """The pairs (x, y) with ``linked``: their overlaps are counted by fragment and summed."""
    wanted = stored.put(pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).distinct(), "wanted")
    sets = stored.put(_fragment_table(slim, scheme, wanted).join(wanted, "cls", "left_semi").dropDuplicates(["cls", "part"]), "sets")
    # every y goes to its x, or to one of the places of an x that has very many
    many = pairs.groupBy("x").agg(F.ceil(F.count("*") / float(BLOCK)).cast("int").alias("places"))
    to = pairs.join(many, "x").select("x", F.pmod(F.xxhash64("y"), F.col("places")).cast("int").alias("salt"), F.lit(False).alias("own"), F.col("y").alias("cls"))
    at = many.select("x", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("salt"), F.lit(True).alias("own"), F.col("x").alias("cls"))
    rows = to.unionByName(at).join(sets, "cls").select("x", "salt", "part", "own", "cls", "tokens")
    rows = rows.repartition("x", "salt", "part").sortWithinPartitions("x", "salt", "part", F.desc("own"))
    counted = rows.mapInArrow(_overlaps, "x bigint, y bigint, common bigint").groupBy("x", "y").agg(F.sum("common").alias("common"))
    nx, ny = (sizes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}")) for c in "xy")
    full = pairs.join(counted, ["x", "y"], "left").join(nx, "x").join(ny, "y")
    common = F.coalesce("common", F.lit(0))
    out = stored.put(full.select("x", "y", (common * scheme.den >= (F.col("nx") + F.col("ny") - common) * scheme.num).alias("linked")), "checked")
    stored.drop(sets, wanted)
    return out


def _same_groups(posts: DataFrame) -> DataFrame:
    """(key, hub, hub_n): one digest of all that are in the same classes, and the class that meets all others."""
    h = F.xxhash64("cls")
    groups = posts.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.struct("cls", "n")).alias("hub"), F.bit_xor(h).alias("one"), F.sum(F.xxhash64(h).bitwiseAND(F.lit(0xFFFFFFFF))).alias("two"))
    return groups.groupBy("rows", "hub", "one", "two").agg(F.min("key").alias("key")).select("key", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"))


def similar_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, seed: int = 0, stored: Stored | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; two rows link at numerator/denominator and above.

    The result reads two tables of ``stored``; a caller that has written it may drop them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    stored = stored or Stored(spark)
    scheme = Scheme(shingle, numerator, denominator, seed)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = stored.put(_class_table(slim, scheme), "found")
    ids = found.select("doc_id", "n_shingles", "cls")
    classes = found.filter("n_shingles > 0").groupBy("cls").agg(F.min("b").alias("b"), F.max("b").alias("b2"), F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.count("*").alias("rows"))
    classes = stored.put(classes, "classes")
    if not classes.filter("b <> b2").isEmpty():  # two sets of one digest: hash anew
        stored.drop(found, classes)
        return similar_components(docs, doc_id=doc_id, text=text, shingle=shingle, numerator=numerator, denominator=denominator, seed=seed + 1, stored=stored)
    sizes = classes.select("cls", "n")

    every = stored.put(_posts(slim, classes, scheme), "every-post")
    groups = stored.put(_same_groups(every), "groups")
    posts = stored.put(every.join(groups, "key"), "posts")
    stored.drop(every, groups)
    maps = found.select("cls", "map").join(posts.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
    maps = stored.put(maps, "maps")
    fits = F.least("n", "hub_n") * scheme.den >= F.greatest("n", "hub_n") * scheme.num
    pairs = posts.filter((F.col("cls") != F.col("hub")) & fits).select(F.col("hub").alias("x"), F.col("cls").alias("y"), F.col("hub_n").alias("nx"), F.col("n").alias("ny")).distinct()
    checked = _checked(stored.put(_within_limit(pairs, maps, scheme), "pairs"), slim, sizes, scheme, stored)

    root_table = lambda: components(checked.filter("linked"), stored, "x", "y").select(F.col("vertex").alias("cls"), "root")
    forests, open_, roots = 1, posts.select("key", "cls", "n"), root_table()
    while True:
        named = open_.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        tally = named.groupBy("key", "root").agg(F.count("*").alias("rows")).groupBy("key")
        tally = tally.agg(F.max_by("root", F.struct("rows", "root")).alias("giant"), F.max("rows").alias("giant_rows"), F.sum("rows").alias("rows"), F.count("*").alias("roots"))
        # written first, so that a large group can be split where it is joined
        tally = stored.put(tally.filter("roots > 1").drop("roots"), "tally")
        mixed = stored.put(named.join(tally, "key"), "mixed")
        near = stored.put(_mixed_pairs(mixed, maps, scheme, forests), "near")
        done = checked.select("x", "y").union(checked.select("y", "x"))
        new = stored.put(near.select("x", "y").distinct().join(done, ["x", "y"], "left_anti"), "new-pairs")
        if not new.isEmpty():
            counted = _checked(new, slim, sizes, scheme, stored)
            checked = checked.unionByName(counted)
            if not counted.filter("linked").isEmpty():
                roots = root_table()
        left = near.filter("more").select("key").distinct()
        if left.isEmpty():
            break
        open_ = stored.put(mixed.select("key", "cls", "n").join(left, "key", "left_semi"), "open")
        stored.drop(tally, mixed, near)
        forests *= 16

    least = classes.join(roots, "cls").groupBy("root").agg(F.min("first_id").alias("least"))
    named = classes.join(roots.join(least, "root").select("cls", "least"), "cls", "left").select("cls", F.coalesce("least", "first_id").alias("component_id"))
    named = stored.put(named, "components")
    stored.keep(found, named)
    out = ids.join(named, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", single_rows: bool = False, **options) -> DataFrame:
    """One document of each component, that of the smallest doc_id; rows without words all stay.

    A document is an id with a text, so an id that has other texts too, or a null id, loses
    only what is a copy.  Null ids come last.  Rows alike in both are one document and stay together,
    or with ``single_rows`` the least of them by all columns stays (map columns can't be ordered).
    """
    name, digest = fresh(docs, "document"), fresh(docs, "text_digest")
    # null ids come after all others
    document = F.struct(F.col(doc_id).isNull().alias("anonymous"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("digest"))
    spark = docs.sparkSession
    stored = Stored(spark)
    found = stored.put(similar_components(docs.select(document.alias(name), F.col(text)), doc_id=name, text=text, stored=stored, **options), "found")
    id_and_digest = [F.col("doc_id.id").alias(name), F.col("doc_id.digest").alias(digest)]
    out = found.filter("n_shingles > 0 and doc_id <> component_id").select(*id_and_digest).distinct()
    repeated = None
    if single_rows:
        repeated = found.filter("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
        repeated = stored.put(repeated.select(*id_and_digest), "repeated-rows")
        out = out.union(repeated)
    out = stored.put(out, "out")
    # only rows of which the filter holds the text are shuffled
    same = F.col(doc_id).eqNullSafe(F.col(name)) & (F.xxhash64(F.col(text).cast("string")) == F.col(digest))
    stored.keep(*[t for t in (out, repeated) if t is not None])
    maybe, rest = split_by_filter(docs, F.xxhash64(F.col(text).cast("string")), bit_filter(out, digest))
    kept = rest.unionByName(maybe.join(out, same, "left_anti"))
    if repeated is None or repeated.isEmpty():
        return kept
    # the minimum is taken before the shuffle, so a row that is there very often is one row a task
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = maybe.join(repeated, same, "left_semi").groupBy(F.col(doc_id).alias(name), F.xxhash64(F.col(text).cast("string")).alias(digest)).agg(F.min(row).alias("row")).select("row.*")
    return kept.unionByName(one)
