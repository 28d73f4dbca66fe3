"""License scans: winnowed template fingerprints, an inverted index, banded alignment.

The minimal 2-word gram of every sliding run of ``RUN`` words of a template
goes into an inverted index, gram to (template, position).  A document's grams
are winnowed in the same way and looked up; the hits of a template whose diagonals
lie within the band form a candidate, which needs a distinct gram for every
``WORDS_A_HIT`` words of the template, 1 at least and ``MIN_HITS`` at most.  (Templates
of fewer than ``RUN`` words are looked up whole.)  Where a template stands many times in a row, its
diagonals would go on and on, so a candidate ends where they span the template's own
length; every candidate then covers two template lengths of the text and what the
band adds, and the work is linear in the text, however often it repeats a notice.

A candidate is aligned with the template inside a band around its diagonals (longest
common subsequence of words; of the best alignments the one that begins latest).  It
is a place if the matched words are at least ``MIN_COVERAGE`` of the template's; then
what is left before and behind it is aligned again, until nothing more is found.  All
candidates of one template in a chunk are aligned together, a row of the table for
each word of the template.  Of places of one template that overlap, the one with more
matched words stays, of equals the first.

The scan runs where the texts are read; nothing is shuffled.  The templates of one
pass are broadcast, ``MAX_TEMPLATE_BYTES`` of text at most (a longer single template
is a pass of its own); more templates take more passes.  A result row has
doc_id, license, matched (words), coverage, start and end (code points of the
document, end exclusive), ordered by nothing, one for each place.

Defined results: a null text or one without words gives no row, as does a template
without words; repeated rows each give their own; a null doc_id stays null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import kernels as K
from .license_texts import TEMPLATES

GRAM = 2
RUN = 4
BAND = 8
MIN_HITS = 3
WORDS_A_HIT = 16
MIN_COVERAGE = 0.8
#: Template text of one pass; its index is about 3 bytes a byte.
MAX_TEMPLATE_BYTES = 16 << 20
#: Cells of a row of the tables that are filled together.
_CELLS = 1 << 14


class TemplateIndex:
    def __init__(self, templates: dict[str, str]):
        self.names: list[str] = []
        self.words: list[np.ndarray] = []
        grams, where, owner, need = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        short: dict[int, list[tuple[int, int]]] = {}
        for name in sorted(templates):
            raw = templates[name].encode()
            words = K.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), K.ALNUM_BYTES)
            n, i = len(words), len(self.names)
            if not n:
                continue
            if n < RUN:
                short.setdefault(n, []).append((int(K.gram_hashes(words.hashes, n)[0]), i))
            else:
                at, h = _prints(words)
                grams.append(h)
                where.append(at)
                owner.append(np.full(len(at), i))
            need.append(min(MIN_HITS, max(1, n // WORDS_A_HIT)))
            self.names.append(name)
            self.words.append(words.hashes)
        h = np.concatenate(grams)
        order = np.argsort(h, kind="stable")
        self.grams, self.where, self.owner = h[order], np.concatenate(where)[order], np.concatenate(owner)[order]
        self.need = np.array(need, np.int64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.short = {n: tuple(np.array(x) for x in zip(*sorted(rows), strict=True)) for n, rows in short.items()}

    def candidates(self, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, template, least and greatest diagonal) of clusters of hits."""
        none = np.zeros(0, np.int64)
        at, h = _prints(words)
        lo = np.searchsorted(self.grams, h, side="left")
        entry, i = K.spread(lo, np.searchsorted(self.grams, h, side="right") - lo)
        doc, tmpl, gram, diagonal = words.doc[at[i]], self.owner[entry], self.grams[entry], at[i] - self.where[entry]
        for n, (table, of) in self.short.items():  # whole templates
            h = K.gram_hashes(words.hashes, n)
            at = np.flatnonzero(words.room() >= n)
            lo = np.searchsorted(table, h[at], side="left")
            entry, i = K.spread(lo, np.searchsorted(table, h[at], side="right") - lo)
            doc, tmpl, gram, diagonal = (np.concatenate(x) for x in ((doc, words.doc[at[i]]), (tmpl, of[entry]), (gram, table[entry]), (diagonal, at[i])))
        if not len(doc):
            return none, none, none, none
        order = np.lexsort((diagonal, tmpl, doc))
        doc, tmpl, gram, diagonal = doc[order], tmpl[order], gram[order], diagonal[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tmpl[1:] != tmpl[:-1]) | (diagonal[1:] - diagonal[:-1] > BAND)
        # a run of diagonals wider than the template is cut at each template length
        begin = np.flatnonzero(new)
        turn = (diagonal - diagonal[begin][np.cumsum(new) - 1]) // np.maximum(self.length[tmpl], BAND)
        new[1:] |= turn[1:] != turn[:-1]
        cluster = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(doc)) - 1
        # distinct grams of each cluster
        pair = np.lexsort((gram, cluster))
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (gram[pair][1:] != gram[pair][:-1]) | (cluster[pair][1:] != cluster[pair][:-1])
        distinct = np.bincount(cluster[pair][fresh], minlength=len(begin))
        good = np.flatnonzero(distinct >= self.need[tmpl[begin]])
        return doc[begin[good]], tmpl[begin[good]], diagonal[begin[good]], diagonal[end[good]]


def _prints(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    g = K.gram_hashes(words.hashes, GRAM)
    at = K.winnow(g, words.room() >= GRAM, RUN - GRAM + 1)
    return at, g[at]


_ONE = 1 << 32  # a matched word, above the word at which the alignment begins


def align(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matched, start, end) of each candidate: longest common subsequence along its diagonals, each side BAND wider.

    Candidate i may take the words lo[i] .. hi[i]-1; start and end are words too.  Of the best alignments it is one
    that begins latest, and ends first.
    """
    low, width = first - BAND, last - first + 2 * BAND + 1
    column = np.arange(width.max())
    inside = column < width[:, None]
    # cell c is diagonal low + c: matched words, and the first of them plus 1
    score = np.zeros((len(lo), len(column) + 1), np.int64)
    best, end, each = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64), np.arange(len(lo))
    for i, word in enumerate(template):
        at = low[:, None] + (i + column)
        ok = inside & (at >= lo[:, None]) & (at < hi[:, None])
        ok &= words[np.where(ok, at, 0)] == word
        taken = np.where(ok, np.where(score[:, :-1] >= _ONE, score[:, :-1], at + 1) + _ONE, 0)
        top = taken.argmax(axis=1)
        value = taken[each, top]
        more = value > best
        best, end = np.where(more, value, best), np.where(more, at[each, top] + 1, end)
        # skip a word of the template (the cell on the right in the row above) or of the document (the cell on the left)
        score[:, :-1] = np.where(inside, np.maximum.accumulate(np.maximum(score[:, 1:], taken), axis=1), 0)
    return best // _ONE, best % _ONE - 1, end


def places(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, template: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
    """(candidate, matched, start, end): the best alignment of at least ``least`` words, then those before and after it."""
    out = []
    work = [np.arange(len(lo)), np.maximum(lo, first - BAND), np.minimum(hi, last + BAND + len(template)), first, last]
    while True:
        ok = (work[2] - work[1] >= least) & (work[2] > work[1])
        work = [x[ok] for x in work]
        if not len(work[0]):
            return out
        cells = np.cumsum(work[4] - work[3] + 2 * BAND + 1)
        found = []
        at = 0
        while at < len(cells):
            to = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + _CELLS, side="right")))
            found.append(align(words, *(x[at:to] for x in work[1:]), template))
            at = to
        matched, start, end = (np.concatenate([f[c] for f in found]) for c in range(3))
        hit = np.flatnonzero((matched >= least) & (matched > 0))
        out += zip(work[0][hit].tolist(), matched[hit].tolist(), start[hit].tolist(), end[hit].tolist(), strict=True)
        who, before, after, a, b = (x[hit] for x in work)
        work = [np.concatenate([x, y]) for x, y in ((who, who), (before, end[hit]), (start[hit], after), (a, a), (b, b))]


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (matched, start, end), the best, then what doesn't overlap."""
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []
    for s in sorted(set(spans), key=lambda s: (-s[0], s[1], s[2])):
        i = bisect.bisect_left(starts, s[2])  # the last one taken that begins before this ends
        if i and taken[i - 1][2] > s[1]:
            continue
        starts.insert(i, s[1])
        taken.insert(i, s)
    return taken


def _find(index: TemplateIndex, words: K.Words, min_coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(text, template, matched, first word, one past the last) of every place in a chunk."""
    doc, tmpl, first, last = index.candidates(words)
    spans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for t in np.unique(tmpl).tolist():
        mine = np.flatnonzero(tmpl == t)
        lo, hi = words.first[doc[mine]], words.first[doc[mine] + 1]
        for i, *span in places(words.hashes, lo, hi, first[mine], last[mine], index.words[t], min_coverage * len(index.words[t])):
            spans.setdefault((int(doc[mine[i]]), t), []).append(tuple(span))
    return [(d, t, *s) for (d, t), found in sorted(spans.items()) for s in _apart(found)]


def _passes(templates: dict[str, str], most: int) -> Iterator[dict[str, str]]:
    """The templates in parts of at most ``most`` bytes of text each."""
    part: dict[str, str] = {}
    size = 0
    for name in sorted(templates):
        n = len(templates[name].encode())
        if part and size + n > most:
            yield part
            part, size = {}, 0
        part[name] = templates[name]
        size += n
    yield part


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """The text files below ``path`` as templates, named by their file names without what follows the last dot."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").collect()  # the templates, not the documents
    return {r["file"].rsplit("/", 1)[-1].rsplit(".", 1)[0]: r["value"] for r in rows}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, doc_id: str = "doc_id", text: str = "text", min_coverage: float = MIN_COVERAGE, max_template_bytes: int = MAX_TEMPLATE_BYTES) -> DataFrame:
    """(doc_id, license, matched, coverage, start, end) of every place of a template in a document."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = [_scan(slim, TemplateIndex(part), min_coverage) for part in _passes(TEMPLATES if templates is None else templates, max_template_bytes)]
    return reduce(DataFrame.unionByName, parts)


def _scan(slim: DataFrame, templates: TemplateIndex, min_coverage: float) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows, out = [], []
            for lo, _hi, data, off in K.chunks(batch.column(1)):
                words = K.Words(data, off, K.ALNUM_BYTES)
                point, of = None, -1
                for d, t, matched, start, end in _find(index, words, min_coverage):
                    if d != of:  # code points before each byte
                        point, of = np.concatenate([[0], np.cumsum((data[off[d] : off[d + 1]] & 0xC0) != 0x80)]), d
                    rows.append(lo + d)
                    out.append((index.names[t], matched, matched / len(index.words[t]), int(point[words.starts[start] - off[d]]), int(point[words.ends[end - 1] - off[d]])))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "license", "matched", "coverage", "start", "end"])

    return slim.mapInArrow(scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, license string, matched bigint, coverage double, start bigint, end bigint")
