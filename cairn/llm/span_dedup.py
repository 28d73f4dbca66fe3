"""Substring dedup by sliding sentence spans.

A text is cut into sentences at a line break, or after ``.``, ``!`` or ``?`` that
the text's end or a character follows that is neither a word's nor one of
``, ; : - _ / @ & = + . ! ?``; a sentence's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
with A-Z lower-cased, so spacing and punctuation don't hide a repeat.  From every
sentence a span runs over at least ``MIN_SENTENCES`` sentences and on until it has
``MIN_WORDS`` words, so that phrases which are common in any text are no repeats; a
sentence from which no such span fits into the text begins none, but later ones of
earlier spans are covered like all others.  Spans of equal words are the same span;
its first occurrence is that of the smallest document and position.  Every sentence
that any other occurrence covers is removed.

1. The rows are written to the shared folder with a number each, so that both
   readings below name the same rows, also of one id or without any.
2. Each task reads its texts and emits a 64-bit digest, the document and the position
   of every span; they are summed to first occurrence and count before and after
   one shuffle, so a span that is in a third of all texts is a row a task.
3. Digests that occur once are forgotten.  The others fill a bit filter of fixed
   size, with which texts are read again to emit only spans that may repeat; these
   are joined to the first occurrences (many rows of one digest can be split, as
   the other side has one), and what isn't first is gathered for each row as
   sentence ranges, bounded by the text itself.
4. Texts that have ranges are rewritten.  A bit filter of fixed size over the rows'
   numbers lets all other texts pass where they are read; only those that it holds
   are shuffled, to meet their ranges.

Defined results: a null text has no sentences and stays null; a text keeps what is
before its first word in front of its first sentence.  Documents come in the order of
their ids, a null id after all others; of one id, or of none, by a digest of the text,
and of one text in the order in which they were written, so every row is a document of
its own and of equal rows the first stays.  Ids may be of any type that has an order;
other columns pass unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import Stored, ship_package
from . import kernels as K
from .runtime import as_longs, bit_filter, fresh, may_hold

MIN_SENTENCES = 2
MIN_WORDS = 20
#: Whether a stop in front of this byte ends a sentence.
_AFTER_STOP = ~K.ALNUM_BYTES
_AFTER_STOP[list(b",;:-_/@&=+.!?ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False


class Sentences:
    """Sentences of a chunk as ranges of words, and the spans that begin at them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = K.Words(data, offsets, K.ALNUM_BYTES)
        n = len(data)
        stop = (data == 0x2E) | (data == 0x21) | (data == 0x3F)
        after = np.ones(n, bool)
        after[:-1] = _AFTER_STOP[data[1:]]
        ends = (stop & after) | (data == 0x0A)
        before = np.zeros(n + 1, np.int64)
        np.cumsum(ends, out=before[1:])
        new = np.ones(len(words), bool)
        if len(words) > 1:
            new[1:] = (before[words.starts[1:]] > before[words.ends[:-1]]) | (words.doc[1:] != words.doc[:-1])
        self.begin = np.flatnonzero(new)  # first word of each sentence
        self.end = np.append(self.begin[1:], len(words))
        self.doc = words.doc[self.begin]
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))  # first sentence of each text

    def spans(self, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, one past the last, digest) of every span."""
        m = len(self.begin)
        at = np.arange(m)
        last = np.searchsorted(self.end, self.begin + min_words, side="left") + 1  # enough words
        last = np.maximum(last, at + min_sentences)
        ok = last <= self.first[1:][self.doc] if m else np.zeros(0, bool)
        at, last = at[ok], last[ok]
        return at, last, K.run_hashes(self.words.hashes, self.begin[at], self.end[last - 1])


def _scan_spans(min_sentences: int, min_words: int, filled=None):
    """Task over (text, columns to carry): the digest and place of every span, or of those that may repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.schema.names[1:]
            for lo, hi, data, off in K.chunks(batch.column(0)):
                s = Sentences(data, off)
                at, last, digest = s.spans(min_sentences, min_words)
                if filled is not None:
                    maybe = may_hold(filled.value, digest.view(np.int64))
                    at, last, digest = at[maybe], last[maybe], digest[maybe]
                first = s.first[s.doc[at]]
                row = pa.array(s.doc[at] + lo)
                yield pa.RecordBatch.from_arrays([as_longs(digest), pa.array((at - first).astype(np.int32)), pa.array((last - first).astype(np.int32)), *(batch.column(c).take(row) for c in carried)], ["digest", "start", "end", *carried])

    return scan


def repeated_ranges(docs: DataFrame, row: str, stored: Stored, *, doc_id: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, ranges): for each row with repeats, named by the column ``row``, the ranges of sentences to remove, merged."""
    spark = docs.sparkSession
    whole = F.col(text).cast("string")
    # rows in the order of documents: named ones first
    slim = docs.select(whole.alias("text"), F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(whole).alias("text"), F.col(row).alias("row")).alias("doc"))
    kind = slim.schema["doc"].dataType.simpleString()
    every = slim.mapInArrow(_scan_spans(min_sentences, min_words), f"digest bigint, start int, end int, doc {kind}")
    seen = every.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = stored.put(seen.select("digest", F.col("first.doc.row").alias("first_row"), F.col("first.start").alias("first_start")), "repeated")
    filled = spark.sparkContext.broadcast(bit_filter(seen, "digest"))
    again = docs.select(whole.alias("text"), F.col(row).alias("row")).mapInArrow(_scan_spans(min_sentences, min_words, filled), "digest bigint, start int, end int, row bigint")
    other = again.join(seen, "digest").filter("row <> first_row or start <> first_start").select("row", F.struct("start", "end").alias("span"))
    merged = F.aggregate(
        F.array_sort(F.collect_set("span")),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    out = stored.put(other.groupBy("row").agg(merged.alias("ranges")), "ranges")
    stored.drop(seen)
    return out


def _rewrite(text: str, ranges: list[dict]) -> tuple[str, int, int]:
    """The text without the sentences in ``ranges``; its sentences; the words removed."""
    raw = text.encode()
    s = Sentences(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    starts = s.words.starts[s.begin]
    keep, at, lost = [], 0, 0
    for r in ranges:
        lo, hi = int(starts[r["start"]]), int(starts[r["end"]]) if r["end"] < len(starts) else len(raw)
        keep.append(raw[at:lo])
        lost += int(s.end[r["end"] - 1] - s.begin[r["start"]])
        at = hi
    keep.append(raw[at:])
    # punctuation in front of a cut sentence's first word goes with it, characters stay whole
    return b"".join(keep).decode(errors="ignore"), len(starts), lost


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """The documents with repeated sentences removed from their text.

    With ``counts``, also n_words_removed and removed, the ranges of sentences
    (``start-end``, end exclusive, comma-joined).
    """
    spark = docs.sparkSession
    ship_package(spark)
    stored = Stored(spark)
    mine, key, cut = fresh(docs, "span_row"), fresh(docs, "span_of"), fresh(docs, "span_ranges")
    numbered = stored.put(docs.withColumn(mine, F.monotonically_increasing_id()), "rows")
    ranges = repeated_ranges(numbered, mine, stored, doc_id=doc_id, text=text, min_sentences=min_sentences, min_words=min_words)
    filled = spark.sparkContext.broadcast(bit_filter(ranges, "row"))
    at, last = docs.columns.index(text), len(docs.columns)

    def having(held: bool, columns: int):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may_hold(filled.value, batch.column(last).to_numpy()) == held)).select(range(columns))

        return scan

    # the same plan at every size: the rows that may have ranges are shuffled, however few
    touched, others = numbered.mapInArrow(having(True, last + 1), numbered.schema), numbered.mapInArrow(having(False, last), docs.schema)
    ranges = ranges.select(F.col("row").alias(key), F.col("ranges").alias(cut))
    joined = touched.join(ranges.hint("merge"), F.col(mine) == F.col(key), "left").drop(key, mine)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost, shown = batch.column(at), np.zeros(batch.num_rows, np.int64), [""] * batch.num_rows
            hit = np.flatnonzero(batch.column(last).is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                mask = np.zeros(batch.num_rows, bool)
                mask[hit] = True
                new = []
                for i, t, r in zip(hit, texts.take(pa.array(hit)).to_pylist(), batch.column(last).take(pa.array(hit)).to_pylist(), strict=True):
                    clean, _, lost[i] = _rewrite(t, r)
                    shown[i] = ",".join(f"{x['start']}-{x['end']}" for x in r)
                    new.append(clean)
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
            cols = [texts if i == at else batch.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(lost), pa.array(shown)] if counts else [])], names)

    names = [*docs.columns, *(["n_words_removed", "removed"] if counts else [])]
    schema = docs.schema
    if counts:
        schema = StructType([*docs.schema.fields, StructField("n_words_removed", LongType()), StructField("removed", StringType())])
    rest = others.withColumns({"n_words_removed": F.lit(0).cast("bigint"), "removed": F.lit("")}) if counts else others
    return joined.mapInArrow(apply, schema).union(rest)
