"""Benchmark decontamination by winnowing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased.  A window is 13 consecutive words of a benchmark item; an item of
fewer words, but not none, is one window.  A document word that lies inside any
occurrence of a window is hit.

Both sides keep, for every sliding run of grams that fits into a window, the
minimal gram hash (winnowing).  A shared window selects the same grams on both
sides, so joining the fingerprints misses no shared window; every joined
fingerprint is then extended word by word to both sides, and the runs that reach
the window length are the hits.

Two plans, same fingerprints and same extension:

* the benchmark's text is at most ``MAX_INDEX_BYTES``: its fingerprints are a
  sorted array that is broadcast, and documents are judged where they are read,
  without any shuffle;
* otherwise: the benchmark's fingerprints stay a table, document fingerprints
  are thinned out by a bit filter of fixed size and joined to it by hash.
  A fingerprint goes with the words that a window around it can reach; equal ones are
  one class on either side, so a passage that many documents and many items hold is
  compared once, and only what a document is told at the end grows with its items.

Defined results: a null text has no words (and isn't contaminated); every input
row gives one output row, repeated rows too; a null doc_id stays null; items of
the same id count once; an item without words has no window; a null item_id is
written ``null``; columns other than the id and the text are not looked at, so
clashing names do no harm; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored, ship_package
from . import kernels as K
from .runtime import as_longs, bit_filter, fresh, may_hold

WINDOW = 13
GRAM = 6
#: Most benchmark text (bytes) whose fingerprints are broadcast; about 3 bytes of index a byte.
MAX_INDEX_BYTES = 32 << 20
#: A document is contaminated if hits * 20 >= words.
SHARE = 20
_SLICE = 1 << 17
_NO_ITEMS = hashlib.sha256(b"").hexdigest()


def _fingerprints(words: K.Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the winnowed grams that serve windows of ``length`` words."""
    k = min(gram, length)
    g = K.gram_hashes(words.hashes, k)
    at = K.winnow(g, words.room() >= k, length - k + 1)
    return at, g[at]


def _item_lengths(words: K.Words, window: int) -> np.ndarray:
    """The window length of each item: ``window``, or all its words if it has fewer."""
    return np.minimum(words.counts(), window)


def _runs(eq: np.ndarray, lead: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How far equality extends left of column ``lead`` and right from it, for each row."""
    left = np.logical_and.accumulate(eq[:, :lead][:, ::-1], axis=1).sum(axis=1) if lead else np.zeros(len(eq), np.int64)
    right = np.logical_and.accumulate(eq[:, lead:], axis=1).sum(axis=1)
    return left, np.where(right >= gram, right, 0)


class BenchmarkIndex:
    """Sorted winnowed fingerprints of a benchmark of bounded size."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        # items of equal texts are one class
        classes: dict[str, set[str]] = {}
        for name, t in zip(ids, texts.to_pylist(), strict=True):
            classes.setdefault(t or "", set()).add(name)
        texts = pa.array(list(classes), pa.large_string())
        self.names = [sorted(x) for x in classes.values()]
        hashes, begin, end, owner = [], [], [], []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        base = 0
        for lo, _, data, off in K.chunks(texts):
            words = K.Words(data, off, K.ALNUM_BYTES)
            lengths = _item_lengths(words, window)
            for length in np.unique(lengths[lengths > 0]):
                at, h = _fingerprints(words, int(length), gram)
                mine = lengths[words.doc[at]] == length
                found.setdefault(int(length), []).append((h[mine], at[mine] + base))
            hashes.append(words.hashes)
            begin.append(words.first[words.doc] + base)
            end.append(words.first[1:][words.doc] + base)
            owner.append(words.doc + lo)
            base += len(words)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hashes, self.begin, self.end, self.owner = join(hashes, np.uint64), join(begin, np.int64), join(end, np.int64), join(owner, np.int64)
        self.tables = {}
        for length, parts in found.items():
            h, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            self.tables[length] = (h[order], at[order])

    def match(self, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hit flag of each word, texts, classes of items): the last two are the pairs that share a window."""
        depth = np.zeros(len(words) + 1, dtype=np.int64)
        pairs = []
        for length, (table, where) in self.tables.items():
            at, h = _fingerprints(words, length, self.gram)
            lo = np.searchsorted(table, h, side="left")
            known = lo < len(table)
            known[known] = table[lo[known]] == h[known]
            at, h, lo = at[known], h[known], lo[known]
            count = np.searchsorted(table, h, side="right") - lo
            for cut in _slices(count):
                entry, i = K.spread(lo[cut], count[cut])
                p, q = at[cut][i], where[entry]
                start, end = self._extend(words, p, q, length)
                ok = end - start >= length
                np.add.at(depth, start[ok], 1)
                np.add.at(depth, end[ok], -1)
                pairs.append(np.unique(words.doc[p[ok]] * len(self.names) + self.owner[q[ok]]))
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        n = max(len(self.names), 1)
        return np.cumsum(depth)[:-1] > 0, both // n, both % n

    def _extend(self, words: K.Words, p: np.ndarray, q: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        k = min(self.gram, length)
        lead = length - k
        d = np.arange(-lead, length)
        x, y = p[:, None] + d, q[:, None] + d
        first, last = words.first[words.doc[p]][:, None], words.first[1:][words.doc[p]][:, None]
        fits = (x >= first) & (x < last) & (y >= self.begin[q][:, None]) & (y < self.end[q][:, None])
        eq = fits & (words.hashes[np.where(fits, x, 0)] == self.hashes[np.where(fits, y, 0)])
        left, right = _runs(eq, lead, k)
        return p - left, p + right


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Cut so that no slice stands for more than about _SLICE pairs (a single entry may)."""
    total = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        hi = max(int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _SLICE, side="right")), lo + 1)
        yield slice(lo, hi)
        lo = hi


def _judge(index: BenchmarkIndex, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Words, hit words and items of every text."""
    n = len(texts)
    n_words, n_hit, items = np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
    for lo, hi, data, off in K.chunks(texts):
        words = K.Words(data, off, K.ALNUM_BYTES)
        n_words[lo:hi] = words.counts()
        hit, texts_, owners = index.match(words)
        n_hit[lo:hi] = np.bincount(words.doc[hit], minlength=hi - lo)
        for t, o in zip(texts_, owners, strict=True):
            items[lo + t] += index.names[o]
    items = [sorted(set(x)) if len(x) > 1 else x for x in items]
    return n_words, n_hit, items


def _contaminated(n_words: np.ndarray, n_hit: np.ndarray, share: int) -> np.ndarray:
    return (n_hit > 0) & (share * n_hit >= n_words)


def _item_table(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text"))


def _small_index(items: DataFrame, window: int, gram: int, most: int) -> BenchmarkIndex | None:
    """The index, if the benchmark is within the bound."""
    n_bytes = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("item")).alias("b")).first()["b"] or 0
    if n_bytes > most:
        return None
    rows = items.toArrow()
    text = rows["text"].combine_chunks()
    return BenchmarkIndex(rows["item"].to_pylist(), text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks), window, gram)


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, share: int = SHARE, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """One row for each document: its id, words, hit words, items that share a window, verdict."""
    spark = docs.sparkSession
    ship_package(spark)
    items = _item_table(benchmark, item_id, item_text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    index = _small_index(items, window, gram, max_index_bytes)
    if index is None:
        return _by_join(slim, items, window, gram, share).drop("text_key")
    shared = spark.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, names = _judge(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words),
                    pa.array(n_hit),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else _NO_ITEMS for x in names], pa.string()),
                    pa.array(_contaminated(n_words, n_hit, share)),
                    pa.array(names, pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    return slim.mapInArrow(scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, share: int = SHARE, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    spark = docs.sparkSession
    ship_package(spark)
    items = _item_table(benchmark, item_id, item_text)
    index = _small_index(items, window, gram, max_index_bytes)
    if index is not None:
        shared = spark.sparkContext.broadcast(index)
        at = docs.columns.index(text)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, n_hit, _ = _judge(shared.value, batch.column(at))
                yield batch.filter(pa.array(~_contaminated(n_words, n_hit, share)))

        return docs.mapInArrow(keep, docs.schema)
    key, tag = fresh(docs, "doc_key"), fresh(docs, "text_key")
    bad = _by_join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), items, window, gram, share)
    bad = bad.filter("contaminated").select(F.col("doc_id").alias(key), F.col("text_key").alias(tag)).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col(key)) & F.xxhash64(F.col(text)).eqNullSafe(F.col(tag)), "left_anti")


# --- the plan for a benchmark of any size -------------------------------------------------

_HIT = "struct<length:int,hash:bigint,at:bigint,lead:int,words:array<bigint>>"
_HIT_ARROW = pa.struct([("length", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("words", pa.list_(pa.int64()))])


def _contexts(words: K.Words, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, pa.Array]:
    """Words on both sides of each gram that a window holding the gram can reach."""
    first, last = words.first[words.doc[at]], words.first[1:][words.doc[at]]
    lo, hi = np.maximum(at - (length - k), first), np.minimum(at + length, last)
    where, _ = K.spread(lo, hi - lo)
    offsets = np.zeros(len(at) + 1, np.int32)
    np.cumsum(hi - lo, out=offsets[1:])
    return at - lo, pa.ListArray.from_arrays(pa.array(offsets), as_longs(words.hashes[where]))


def _structs(words: K.Words, length: int, at: np.ndarray, h: np.ndarray, k: int) -> pa.StructArray:
    lead, context = _contexts(words, at, length, k)
    return pa.StructArray.from_arrays([pa.array(np.full(len(at), length, np.int32)), as_longs(h), pa.array(at - words.first[words.doc[at]]), pa.array(lead.astype(np.int32)), context], fields=list(_HIT_ARROW))


def _by_join(docs: DataFrame, items: DataFrame, window: int, gram: int, share: int) -> DataFrame:
    spark = docs.sparkSession
    stored = Stored(spark)

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in K.chunks(batch.column(1)):
                words = K.Words(data, off, K.ALNUM_BYTES)
                lengths = _item_lengths(words, window)
                for length in np.unique(lengths[lengths > 0]):
                    at, h = _fingerprints(words, int(length), gram)
                    mine = lengths[words.doc[at]] == length
                    at, h = at[mine], h[mine]
                    s = _structs(words, int(length), at, h, min(gram, int(length)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(words.doc[at])), s], ["item", "print"])

    context = lambda lead, words: F.xxhash64("length", "hash", lead, words)
    prints = items.mapInArrow(item_prints, f"item string, print {_HIT}").select("item", "print.length", "print.hash", F.col("print.lead").alias("i_lead"), F.col("print.words").alias("i_words"))
    prints = stored.put(prints.withColumn("i_class", context("i_lead", "i_words")), "prints")
    owners = prints.select("i_class", "item").distinct()
    prints = stored.put(prints.drop("item").dropDuplicates(["i_class"]), "item-classes")
    lengths = sorted(r["length"] for r in prints.select("length").distinct().collect())  # at most `window` values
    filled = spark.sparkContext.broadcast(bit_filter(prints, "hash"))

    def doc_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in K.chunks(batch.column(1)):
                words = K.Words(data, off, K.ALNUM_BYTES)
                parts, docs_ = [], []
                for length in lengths:
                    at, h = _fingerprints(words, length, gram)
                    maybe = may_hold(filled.value, h.view(np.int64))
                    parts.append(_structs(words, length, at[maybe], h[maybe], min(gram, length)))
                    docs_.append(words.doc[at[maybe]])
                owner = np.concatenate(docs_) if docs_ else np.zeros(0, np.int64)
                order = np.argsort(owner, kind="stable")
                offsets = np.searchsorted(owner[order], np.arange(hi - lo + 1)).astype(np.int32)
                flat = pa.concat_arrays(parts).take(pa.array(order)) if parts else pa.array([], _HIT_ARROW)
                cut = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(2), pa.array(words.counts()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "text_key", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = stored.put(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(doc_prints, f"doc_id {kind}, text_key bigint, n_words bigint, hits array<{_HIT}>"), "documents")
    hits = base.select("doc_id", "text_key", F.explode("hits").alias("h")).select("doc_id", "text_key", "h.*").withColumn("d_class", context("lead", "words")).distinct()
    classes = hits.select("d_class", "length", "hash", "lead", "words").dropDuplicates(["d_class"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(name) for name in batch.schema.names}
            before, after = [], []
            for length, x, i, y, j in zip(*(cols[c].to_pylist() for c in ("length", "words", "lead", "i_words", "i_lead")), strict=True):
                left = right = 0
                while left < min(i, j) and x[i - left - 1] == y[j - left - 1]:
                    left += 1
                while i + right < len(x) and j + right < len(y) and x[i + right] == y[j + right]:
                    right += 1
                whole = left + right >= length and right >= min(gram, length)
                before.append(left if whole else None)
                after.append(right)
            yield pa.RecordBatch.from_arrays([cols["d_class"], cols["i_class"], pa.array(before, pa.int64()), pa.array(after, pa.int64())], ["d_class", "i_class", "before", "after"])

    met = classes.join(prints, ["length", "hash"]).select("d_class", "i_class", "length", "words", "lead", "i_words", "i_lead")
    met = stored.put(met.mapInArrow(extend, "d_class bigint, i_class bigint, before bigint, after bigint").filter("before is not null"), "met")
    places = hits.select("doc_id", "text_key", "at", "d_class")
    spans = places.join(met.select("d_class", "before", "after").distinct(), "d_class").select("doc_id", "text_key", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))
    named = places.select("doc_id", "text_key", "d_class").distinct().join(met.select("d_class", "i_class"), "d_class").join(owners, "i_class").select("doc_id", "text_key", "item").distinct()
    # a document's spans and items are bounded by its own words and by the benchmark's size
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("total")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["total"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(a["end"], s["start"]))).alias("total")),
    )["total"]
    found = spans.groupBy(F.col("doc_id").alias("k"), F.col("text_key").alias("t")).agg(merged.alias("n_hit"))
    told = named.groupBy(F.col("doc_id").alias("ik"), F.col("text_key").alias("it")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = base.join(found, base.doc_id.eqNullSafe(found.k) & base.text_key.eqNullSafe(found.t), "left").join(told, base.doc_id.eqNullSafe(told.ik) & base.text_key.eqNullSafe(told.it), "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        base.doc_id, "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), names.alias("items"), base.text_key,
    )
