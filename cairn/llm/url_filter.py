"""URL filters: rules probed in a sorted, memory-mapped array of 64-bit digests.

A rule is a host and the beginning of a path, such as ``example.net/en/``.  It
fits a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's; of the rules that fit the longest wins (of equally long ones,
that with the longer host).

The keys' xxhash64 digests are sorted into an array; digests, strings and verdicts
lie in one file that each worker maps into memory.  The keys that a URL could match
(its host's endings by label, each with the path cut at the lengths that rules have)
are hashed and found by a vectorised binary search, and a digest that is found counts
only if the stored string equals the key, so a collision can't decide anything.  A list
above ``MAX_RULE_BYTES`` isn't broadcast: the same keys are joined to the rule table.

Defined results: a null URL or one without ``://`` has an empty host and path, no
rule, and the default verdict; each input row gives one row; a null page_id
stays null; a key that several rules name takes the verdict ``block`` if any of
them blocks; an empty or null key is no rule.  The general interface takes the rules
as pairs (key, verdict), or as a frame of the columns rule and verdict, which comes to
the driver only below the bound.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .runtime import list_array

#: Most bytes of rule keys that are broadcast to workers.
MAX_RULE_BYTES = 256 << 20

HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"


class DigestArray:
    """Sorted digests with their strings and verdicts; workers map them from an unlinked file."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        verdicts: dict[str, str] = {}
        for key, verdict in rules:
            if not key:
                continue
            host, slash, path = key.partition("/")
            key = host.translate(_LOWER) + slash + path
            verdicts[key] = "block" if "block" in (verdict, verdicts.get(key)) else verdict
        digest = np.fromiter((xxhash.xxh64_intdigest(k) for k in verdicts), np.uint64, len(verdicts))
        order = np.argsort(digest, kind="stable")
        keys = list(verdicts)
        strings = [keys[i].encode() for i in order]
        self.kinds = sorted(set(verdicts.values()))
        kind = np.array([self.kinds.index(verdicts[keys[i]]) for i in order], np.uint8 if len(self.kinds) < 256 else np.int64)
        edge = np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64)
        self._parts = [(len(order), np.uint64), (len(order) + 1, np.int64), (len(order), kind.dtype.type), (int(edge[-1]), np.uint8)]
        self._bytes = b"".join([digest[order].tobytes(), edge.tobytes(), kind.tobytes(), *strings])
        hosts = [k.partition("/")[0] for k in keys]
        self.most_labels = max((h.count(".") + 1 for h in hosts), default=0)
        self.path_lengths = sorted({len(k) - len(h) for k, h in zip(keys, hosts, strict=True)}, reverse=True)
        self._maps: list[np.ndarray] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_maps": []}

    def mapped(self) -> list[np.ndarray]:
        """(digests, offsets of the strings, verdicts, strings)."""
        if not self._maps:
            with tempfile.TemporaryFile() as f:  # unlinked; the mapping keeps the pages
                f.write(self._bytes)
                f.flush()
                whole = np.memmap(f, dtype=np.uint8, mode="r")
            at = 0
            for n, kind in self._parts:
                size = n * np.dtype(kind).itemsize
                self._maps.append(whole[at : at + size].view(kind))
                at += size
        return self._maps

    def candidates(self, host: str, path: str) -> list[str]:
        """Keys that a rule fitting this URL may have."""
        labels = host.split(".")
        ends = [".".join(labels[i:]) for i in range(max(0, len(labels) - self.most_labels), len(labels))]
        paths = [path[:n] for n in self.path_lengths if n <= len(path)]
        return [e + p for e in ends for p in paths]

    def lookup(self, keys: list[str]) -> list[str | None]:
        """The verdict of each key that is a rule, else None."""
        digests, edge, kind, strings = self.mapped()
        if not keys or not len(digests):
            return [None] * len(keys)
        digest = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(digests, digest, side="left")
        found: list[str | None] = [None] * len(keys)
        inside = at < len(digests)
        inside[inside] = digests[at[inside]] == digest[inside]
        for i in np.flatnonzero(inside):
            j = int(at[i])
            while j < len(digests) and digests[j] == digest[i]:  # equal digests of different strings
                if strings[edge[j] : edge[j + 1]].tobytes() == keys[i].encode():
                    found[i] = self.kinds[kind[j]]
                    break
                j += 1
        return found


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def url_parts(url) -> tuple:
    """Columns (host with A-Z lower-cased, path), both empty for a null or a URL without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, "(?s)" + HOST, 1), upper, lower), F.regexp_extract(text, "(?s)" + PATH, 1)


def _better(rule: str, best: str | None) -> bool:
    return best is None or (len(rule), rule.index("/") if "/" in rule else len(rule)) > (len(best), best.index("/") if "/" in best else len(best))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = "allow", max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``."""
    spark = pages.sparkSession
    ship_package(spark)
    host, path = url_parts(F.col(url))
    slim = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("rule") + 24)).first()[0] or 0
        if size > max_rule_bytes:
            return _by_join(slim, rules, default)
        rules = [(r["rule"], r["verdict"]) for r in rules.select("rule", "verdict").collect()]
    rules = list(rules)
    if sum(len(k.encode()) + 24 for k, _ in rules if k) > max_rule_bytes:
        return _by_join(slim, rule_table(spark, rules), default)
    shared = spark.sparkContext.broadcast(DigestArray(rules))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = shared.value
        for batch in batches:
            keys: list[str] = []
            owner: list[int] = []
            for i, (h, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                c = array.candidates(h, p)
                keys += c
                owner += [i] * len(c)
            rule: list[str | None] = [None] * batch.num_rows
            verdict = [default] * batch.num_rows
            for i, key, found in zip(owner, keys, array.lookup(keys), strict=True):
                if found is not None and _better(key, rule[i]):
                    rule[i], verdict[i] = key, found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(probe, f"page_id {kind}, host string, path string, rule string, verdict string")


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def _by_join(slim: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for a rule list of any size: candidate keys are joined to the rule table."""
    spark = slim.sparkSession
    rules = rules.filter("rule <> ''")
    cut = F.instr("rule", "/")
    host = F.when(cut > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule"))
    rules = rules.select(F.concat(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")).alias("rule"), "verdict")
    rules = rules.groupBy("rule").agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise(F.min("verdict")).alias("found"))
    facts = rules.agg(
        F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\.", -1))).alias("labels"),
        F.collect_set(F.expr("length(rule) - length(substring_index(rule, '/', 1))")).alias("lengths"),
    ).first()  # a number, and the distinct path lengths
    labels, lengths = facts["labels"] or 0, sorted(facts["lengths"] or [], reverse=True)
    shared = spark.sparkContext.broadcast((labels, lengths))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray([])
        array.most_labels, array.path_lengths = shared.value
        for batch in batches:
            found = [array.candidates(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            counts = np.array([len(x) for x in found], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), list_array(pa.array([k for x in found for k in x], pa.string()), counts)], ["host", "path", "keys"])

    # rows with the same host and path share one lookup
    bare = slim.filter("host = '' and path = ''")  # no URL: they need no lookup, however many
    slim = slim.filter("host <> '' or path <> ''")
    parts = slim.select(F.lit(0).alias("zero"), "host", "path").distinct()
    looked = parts.mapInArrow(keys, "host string, path string, keys array<string>")
    looked = looked.select("host", "path", F.explode("keys").alias("rule")).join(rules, "rule")
    order = F.struct(F.length("rule"), F.length(F.substring_index("rule", "/", 1)))
    best = looked.groupBy("host", "path").agg(F.max_by(F.struct("rule", "found"), order).alias("best"))
    out = slim.join(best, ["host", "path"], "left")
    out = out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.found"), F.lit(default)).alias("verdict"))
    return out.unionByName(bare.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}))
