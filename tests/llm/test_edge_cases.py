"""Every operator on empty tables, and on null and repeated rows beside columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from cairn.llm import decontaminate, licenses, line_dedup, mixing, ngram_join, privacy, quality, span_dedup, topk, url_filter

CLASHING = ["host", "lines", "key", "n", "rank", "cls", "digest", "bucket", "score", "target", "items", "id", "y", "size", "boiler_host", "lost_id", "part", "c0"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "some words of a text " * 3
ROWS = [(None, None, None, None, None), (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, LONG, None, "s", 60), (3, LONG, None, "s", 60), (None, LONG, "en", "s", 60)]


def wide(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c not in df.columns])


def docs(spark, rows):
    return wide(spark.createDataFrame(rows, DOCS))


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


# each gives one row for each row of documents
OPERATORS = {
    "contamination": lambda s, d: decontaminate.contamination(d, bench(s, [(None, None), (1, ""), (2, "some words")])),
    "no benchmark": lambda s, d: decontaminate.contamination(d, bench(s, [])),
    "line dedup": lambda s, d: line_dedup.drop_boilerplate(d, n_lines="n_lines", n_dropped="n_dropped"),
    "mix": lambda s, d: mixing.mix(d),
    "quality": lambda s, d: quality.score(d, quality.train(d, labels(s, [(None, 1, 0), (3, None, 0), (1, 1, None), (3, 0, 0)]))),
    "no labels": lambda s, d: quality.score(d, quality.train(d, labels(s, []))),
    "n-gram join": lambda s, d: ngram_join.similar_components(d),
    "span dedup": lambda s, d: span_dedup.remove_repeats(d, counts=True),
    "personal data": lambda s, d: privacy.find_personal_data(d),
    "sanitise": lambda s, d: privacy.sanitise(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(spark, name):
    run = OPERATORS[name]
    assert run(spark, docs(spark, [])).collect() == []
    got = run(spark, docs(spark, ROWS)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


def test_license_scan(spark):
    assert licenses.scan_licenses(docs(spark, [])).collect() == []
    licenses.scan_licenses(docs(spark, ROWS)).collect()


def test_kept_documents(spark):
    d = docs(spark, ROWS)
    clean = decontaminate.decontaminate(d, bench(spark, []))
    assert clean.columns == d.columns and clean.count() == len(ROWS)
    one = ngram_join.keep_one_of_each(d)
    assert one.columns == d.columns and one.filter("text is null or text = ''").count() == 4
    other = "quite different words that nothing else in the table has"
    more = docs(spark, [*ROWS, (None, other, None, None, 0), (3, other + " but these", None, None, 0), (4, LONG, None, None, 0)])
    kept = sorted(str((r.doc_id, r.text)) for r in ngram_join.keep_one_of_each(more).filter("text <> ''").collect())
    assert kept == sorted(map(str, [(None, other), (3, LONG), (3, LONG), (3, other + " but these")]))
    mixed = mixing.sample_mix(d)
    assert mixed.columns == [*d.columns, "repeat"]
    mixed.collect()


def test_one_row_of_each_group(spark):
    other = "quite different words that nothing else in the table has"
    rows = [*ROWS, (3, LONG, "de", "t", 60), *[(None, other, "en", None, 0)] * 3, (3, other + " but these", None, None, 0)]
    d = docs(spark, rows)
    one = ngram_join.keep_one_of_each(d, single_rows=True)
    assert one.columns == d.columns and one.filter("text is null or text = ''").count() == 4
    kept = sorted((str((r.doc_id, r.text)), r.lang) for r in one.filter("text <> ''").collect())
    assert kept == sorted([(str((None, other)), "en"), (str((3, LONG)), None), (str((3, other + " but these")), None)], key=lambda x: x[0])


def test_topk(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    every = F.lit(True)
    assert topk.top_k(wide(spark.createDataFrame([], schema)), every).collect() == []
    nan = float("nan")
    rows = [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (3, None, 0), (4, [nan, 1.0], 0), (5, [None, 1.0], 0), (6, [0.25, 0.0], None)]
    got = topk.top_k(wide(spark.createDataFrame(rows, schema)), every, k=2).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(1, 1, 2), (1, 2, 6), (2, 1, 1), (2, 2, 6), (6, 1, 1), (6, 2, 2)}


def test_url_filter(spark):
    schema = "page_id bigint, url string, html string"
    rules = [("net/", "block")]
    assert url_filter.filter_urls(wide(spark.createDataFrame([], schema)), rules).collect() == []
    rows = [(None, None, None), (1, "", None), (2, "http://A.net/x", ""), (2, "http://A.net/x", ""), (3, "no scheme", None)]
    got = url_filter.filter_urls(wide(spark.createDataFrame(rows, schema)), rules).collect()
    assert sorted((str(r.page_id), r.verdict) for r in got) == [("1", "allow"), ("2", "block"), ("2", "block"), ("3", "allow"), ("None", "allow")]


def test_pipeline_on_empty_null_and_repeated_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    good = " ".join(f"Word{i} and more of it, then some." for i in range(40))
    rows = [(i, f"{good} {i} {'x' * i}", "en", "s", 0) for i in range(40)] + ROWS + ROWS
    for name, table in (("empty", []), ("rows", rows)):
        root = tmp_path / name
        docs(spark, table).write.parquet(str(root / "documents.parquet"))
        labels(spark, [(i, 1, 0) for i, *_ in table if i]).write.parquet(str(root / "labels.parquet"))
        bench(spark, [(1, "w " * 20), (None, None)]).write.parquet(str(root / "benchmark.parquet"))
        got = pipeline.run(spark, str(root))
        assert got.columns == [*pipeline.COLUMNS, "repeat"]
        kept = got.collect()
        assert bool(kept) == bool(table)
        assert len({(r.doc_id, r.text) for r in kept if r.text and r.text.startswith("Word")}) == 1  if table else not kept
