"""Personal data: fixed base patterns, and terms that reveal protected entities.

Base spans are e-mail addresses, IP addresses, card and phone numbers, leftmost
and non-overlapping within their kind; matches that fail their check (parts above
255, digits, Luhn) are dropped without a retry.  The scans below are written so
that their time is linear in the text, long runs of digits or letters included,
and give what the plain patterns give.

The method adds spans by information-theoretic sanitisation.  An entity is the
value of a base span.  A term is a word (with a letter, of 3 bytes or more) within
``REACH`` words of a mention.  Over all distinct texts (copies count once), with n_e,
n_t texts that hold the entity or the term, n_et those in which the term is near the
entity, and N texts in all, the term gives away

    share = PMI(e, t) / IC(e) = log(N n_et / (n_e n_t)) / log(N / n_e)

of the entity's information.  Few sightings say less, so the PMI is also taken lower by
log(``DOUBT``) / n_et: for a term that is near every mention this is the exact one-sided
90 % bound of n_et / n_e.  A pair with a share of ``GENERALISE`` and above by the lower
value is revealing, however rarely the entity occurs; its term is removed if the share
itself is ``REMOVE`` and above, else generalised.  In a table of very few texts the
bound leaves a single sighting alone.  A term that reveals any entity is masked wherever
it stands, in all documents, as the ``REACH`` words only gather the evidence.

Values that no pattern names are entities too, if they are opaque: words of ``OPAQUE``
bytes or more, of ASCII letters and digits with at least ``MIXED`` of either (keys, tokens,
digests).  What such a value gives away is its own information, so its share is
IC(e) / log N; at ``GENERALISE`` and above, that is if few distinct texts hold it, each of
its places is a ``secret``.  A value that is common in the corpus, like the digest of a
file that many texts quote, stays.

Each text is read for base spans and neighbours, which are kept without the text; a
second reading counts the texts that hold a candidate term, and a third finds the places
of the revealing terms.  Bit filters of fixed size pick the terms in both.  Counts are
summed before the shuffle, so an entity or a term that is in a third of all documents is
a row a task; texts that occur again are told apart by their digest.

``n_private`` counts base spans and secrets.

Defined results: a null text is empty; every input row gives one row, repeated
rows too; a null doc_id stays null; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored, ship_package
from . import kernels as K
from .runtime import bit_filter, fresh, may_hold

KINDS = ("email", "ip", "card", "phone", "generalised", "removed", "secret")
REACH = 10
DOUBT = 10.0
OPAQUE = 16
MIXED = 4
GENERALISE = 0.6
REMOVE = 0.9

_EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(s: str) -> list[tuple[int, int]]:
    """Spans of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``."""
    found, floor = [], 0
    for m in _EMAIL_RIGHT.finditer(s):
        start = m.start()
        while start > floor and s[start - 1] in _EMAIL_LEFT:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            floor = m.end()
    return found


def _small(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def ips(s: str) -> list[tuple[int, int]]:
    """Spans of ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of at most 255."""
    return [m.span() for m in _IP.finditer(s) if all(map(_small, m.groups()))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def cards(s: str) -> list[tuple[int, int]]:
    """Spans of ``[0-9]([\\x20-]?[0-9])+`` with 14 to 19 digits that pass Luhn."""
    return [m.span() for m in _CARD.finditer(s) if m.end() - m.start() < 40 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def phones(s: str) -> list[tuple[int, int]]:
    """Spans of ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 10 to 15 digits."""
    return [m.span() for m in _PHONE.finditer(s) if 10 <= len(_digits(m.group())) <= 15]


def base_spans(s: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    found = []
    if "@" in s:
        found += [(a, 0, b) for a, b in emails(s)]
    found += [(a, 1, b) for a, b in ips(s)]
    found += [(a, 2, b) for a, b in cards(s)]
    if "+" in s:
        found += [(a, 3, b) for a, b in phones(s)]
    return sorted(found)


def _entity(s: str, kind: int, a: int, b: int) -> int:
    value = s[a:b].lower() if kind == 0 else s[a:b] if kind == 1 else _digits(s[a:b])
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "big", signed=True)


def _neighbours(s: str, spans: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int]]:
    """The distinct (entity, term) of the terms near each mention; an entity without terms has the term None."""
    raw = np.frombuffer(s.encode(), np.uint8)
    words = K.Words(raw, np.array([0, len(raw)]), K.ALNUM_BYTES)
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    starts, ends = point[words.starts], point[words.ends]
    term = _terms(words, raw)
    for a, _, b in spans:
        term &= (ends <= a) | (starts >= b)
    hashes = words.hashes.view(np.int64)
    out: dict[tuple, None] = {}
    for a, kind, b in spans:
        lo, hi = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b, side="left"))
        near = np.concatenate([np.arange(max(0, lo - reach), lo), np.arange(hi, min(len(words), hi + reach))])
        entity = _entity(s, kind, a, b)
        out[entity, None] = None
        for t in hashes[near[term[near]]].tolist():
            out[entity, t] = None
    return list(out)


def _terms(words: K.Words, raw: np.ndarray) -> np.ndarray:
    """Which words are terms: with a letter, of 3 bytes or more."""
    digit = np.concatenate([[0], np.cumsum((raw >= 0x30) & (raw <= 0x39))])
    return (words.ends - words.starts >= 3) & (digit[words.ends] - digit[words.starts] < words.ends - words.starts)


def _opaque(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, entity, start, end) of the opaque values of a chunk, in code points of their texts."""
    digit = (data >= 0x30) & (data <= 0x39)
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
    inside = np.concatenate([digit | letter, [False]])
    cut = np.zeros(len(data) + 1, bool)  # texts touch in a chunk
    cut[offsets] = True
    starts = np.flatnonzero(inside & (cut | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside[:-1] & (cut | ~inside)[1:]) + 1
    long_ = ends - starts >= OPAQUE
    starts, ends = starts[long_], ends[long_]
    before = np.concatenate([[0], np.cumsum(digit)])
    digits = before[ends] - before[starts]
    mixed = (digits >= MIXED) & (ends - starts - digits >= MIXED)
    out = []
    for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        i = int(np.searchsorted(offsets, a, side="right")) - 1
        if (a > offsets[i] and data[a - 1] >= 0x80) or (b < offsets[i + 1] and data[b] >= 0x80):
            continue  # a part of a word beyond ASCII
        start = int(np.count_nonzero((data[offsets[i] : a] & 0xC0) != 0x80))
        value = data[a:b].tobytes().lower()
        out.append((i, int.from_bytes(hashlib.blake2b(b"opaque:" + value, digest_size=8).digest(), "big", signed=True), start, start + b - a))
    return out


def _shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_OPAQUE = pa.list_(pa.struct([("entity", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
_FACTS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, opaque array<struct<entity:bigint,start:int,end:int>>, near array<struct<entity:bigint,term:bigint>>"


def _read(reach: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(256, np.int64)
        table[[0x2B, 0x40, *range(0x30, 0x3A)]] = 1
        for batch in batches:
            texts = batch.column(2)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            near: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            opaque: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lo, _hi, data, off in K.chunks(texts):
                mark = np.concatenate([[0], np.cumsum(table[data])])
                for i in np.flatnonzero(np.diff(mark[off])):
                    s = data[off[i] : off[i + 1]].tobytes().decode()
                    spans[lo + i] = found = base_spans(s)
                    if found:
                        near[lo + i] = _neighbours(s, found, reach)
                for i, entity, a, b in _opaque(data, off):
                    if not any(x < b and a < y for x, _, y in spans[lo + i]):
                        opaque[lo + i].append({"entity": entity, "start": a, "end": b})
                        if (entity, None) not in near[lo + i]:
                            near[lo + i].append((entity, None))
            counts = [[sum(k == kind for _, k, _ in x) for x in spans] for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(_shown(x).encode()).hexdigest() for x in spans]),
                    pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in spans], _SPANS),
                    pa.array(opaque, _OPAQUE),
                    pa.array([[dict(zip(("entity", "term"), y, strict=True)) for y in x] for x in near], _NEAR),
                ],
                ["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "opaque", "near"],
            )

    return scan


def _count_terms(filled, again):
    """Texts of each batch that hold a candidate term, summed: (term, copy, n); copy is the key of a text that may occur again."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            copied = may_hold(again.value, keys)
            for lo, _hi, data, off in K.chunks(batch.column(1)):
                words = K.Words(data, off, K.ALNUM_BYTES)
                h = words.hashes.view(np.int64)
                maybe = np.flatnonzero(may_hold(filled.value, h))
                h, doc = h[maybe], words.doc[maybe] + lo
                copy = np.where(copied[doc], keys[doc], 0)
                which = np.where(copied[doc], -1, doc)  # all rows of a copied text are one
                order = np.lexsort((which, copy, h))
                h, copy, which = h[order], copy[order], which[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (copy[1:] != copy[:-1]) | (which[1:] != which[:-1])
                h, copy, one = h[new], copy[new], which[new] >= 0
                terms, n = np.unique(h[one], return_counts=True)
                more = h[~one]
                none = pa.array(np.concatenate([np.zeros(len(terms), np.int64), copy[~one]]), mask=np.arange(len(terms) + len(more)) < len(terms))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([terms, more])), none, pa.array(np.concatenate([n, np.ones(len(more))]).astype(np.int64))], ["term", "copy", "n"])

    return scan


def _places(filled):
    """(doc_id, text_key, term, start, end) of the words that may be revealing, in code points."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _hi, data, off in K.chunks(batch.column(2)):
                words = K.Words(data, off, K.ALNUM_BYTES)
                h = words.hashes.view(np.int64)
                at = np.flatnonzero(_terms(words, data) & may_hold(filled.value, h))
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                doc = words.doc[at]
                before = point[np.asarray(off)[doc]]
                row = pa.array(doc + lo)
                starts, ends = (pa.array((point[x[at]] - before).astype(np.int32)) for x in (words.starts, words.ends))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(h[at]), starts, ends], ["doc_id", "text_key", "term", "start", "end"])

    return scan


def revealing_terms(facts: DataFrame, docs: DataFrame, stored: Stored, *, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """(term, kind) of the terms that disclose too much of an entity, and (entity) of those held by few texts."""
    spark = docs.sparkSession
    copies = stored.put(facts.groupBy("text_key").agg(F.count("*").alias("rows"), F.first("near").alias("near")), "texts")
    n = float(copies.count())
    near = copies.filter(F.size("near") > 0).select(F.explode("near").alias("x")).select("x.*")
    seen = stored.put(near.groupBy("entity", "term").agg(F.count("*").alias("n_et")), "pairs")
    kept = seen.filter("term is not null")
    holding = seen.filter("term is null").select("entity", F.col("n_et").alias("n_e"))
    rare = holding.filter(F.log(F.lit(n) / F.col("n_e")) >= F.log(F.lit(max(n, 1.0))) * generalise).select("entity")
    if kept.isEmpty():
        return kept.select("term", F.lit(0).alias("kind")), rare
    filled = spark.sparkContext.broadcast(bit_filter(kept, "term"))
    again = spark.sparkContext.broadcast(bit_filter(copies.filter("rows > 1"), "text_key"))
    counts = docs.select("text_key", "text").mapInArrow(_count_terms(filled, again), "term bigint, copy bigint, n bigint").groupBy("term", "copy").agg(F.sum("n").alias("n"))
    terms = counts.groupBy("term").agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("n_t"))
    joined = kept.join(holding, "entity").join(terms, "term")
    ic = F.log(F.lit(n) / F.col("n_e"))
    pmi = F.log(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.col("n_t").cast("double")))
    low = pmi - F.log(F.lit(DOUBT)) / F.col("n_et")
    joined = joined.filter((ic > 0) & (low >= ic * generalise)).withColumn("kind", F.when(pmi >= ic * remove, 5).otherwise(4))
    return stored.put(joined.groupBy("term").agg(F.max("kind").alias("kind")), "revealing"), rare


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", reach: int = REACH, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_private, text_key) of every row.

    spans: ``kind:start:end`` by start, then kind, comma-joined; text_key tells rows of one id apart.
    """
    spark = docs.sparkSession
    ship_package(spark)
    stored = Stored(spark)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    facts = stored.put(slim.mapInArrow(_read(reach), f"doc_id {kind}, text_key bigint, {_FACTS}"), "facts")
    revealing, rare = revealing_terms(facts, slim, stored, generalise=generalise, remove=remove)
    filled = spark.sparkContext.broadcast(bit_filter(revealing, "term"))
    places = slim.mapInArrow(_places(filled), f"doc_id {kind}, text_key bigint, term bigint, start int, end int")
    secrets = facts.select("doc_id", "text_key", F.explode("opaque").alias("x")).select("doc_id", "text_key", "x.*").join(rare, "entity")
    span = F.struct("start", "kind", "end").alias("span")
    every = places.join(revealing, "term").select("doc_id", "text_key", span).union(secrets.withColumn("kind", F.lit(6)).select("doc_id", "text_key", span))
    added = every.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("added"))
    added = added.select(F.col("doc_id").alias("k"), F.col("text_key").alias("t"), "added")
    out = facts.join(added, facts.doc_id.eqNullSafe(added.k) & facts.text_key.eqNullSafe(added.t), "left")
    outside = F.filter("added", lambda x: ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    outside = F.coalesce(outside, F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    every = F.array_sort(F.concat("base", outside))
    private = (F.size("base") + F.size(F.filter(outside, lambda x: x["kind"] == 6))).cast("bigint")
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", shown.alias("spans"), private.alias("n_private"), "text_key")


def sanitise(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with entities and secrets replaced by ``[kind]``, generalised terms by ``[term]`` and removed terms cut out."""
    found = find_personal_data(docs, doc_id=doc_id, text=text, **options).select("doc_id", "text_key", "spans").distinct()
    key, tag, cut = fresh(docs, "pii_doc"), fresh(docs, "pii_text"), fresh(docs, "pii_spans")
    found = found.filter("spans <> ''").select(F.col("doc_id").alias(key), F.col("text_key").alias(tag), F.col("spans").alias(cut))
    joined = docs.join(found, F.col(doc_id).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text).cast("string")) == F.col(tag)), "left").drop(key, tag)
    at, last = docs.columns.index(text), len(docs.columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [s if spans is None else _masked(s, spans) for s, spans in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(last)], names)

    names = docs.columns
    return joined.mapInArrow(apply, docs.schema)


def _masked(s: str, spans: str) -> str:
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",")):
        a, b = int(a), int(b)
        if a < at:  # inside what is masked already
            continue
        out += [s[at:a], "" if kind == "removed" else "[term]" if kind == "generalised" else f"[{kind}]"]
        at = b
    return "".join(out) + s[at:]
