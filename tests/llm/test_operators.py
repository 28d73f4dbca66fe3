import bisect
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import components, decontaminate, licenses, line_dedup, mixing, ngram_join, privacy, quality, span_dedup, topk, url_filter
from cairn.session import Stored

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, item_id string, verdict string"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", None, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n, vocab=60):
    return " ".join(f"w{rng.randrange(vocab)}é" if rng.random() < 0.3 else f"W{rng.randrange(vocab)}" for _ in range(n))


def test_contamination_matches_brute_force(spark):
    rng = random.Random(1)
    items = [prose(rng, n, 9) for n in (1, 3, 12, 13, 14, 40, 40)] + ["", None, "...", "same words here"] * 2
    texts = [prose(rng, rng.choice([0, 1, 5, 12, 13, 60, 400]), 9) for _ in range(60)]
    texts += [f"{prose(rng, 30)} {items[5]} {prose(rng, 500)}", items[6] * 3, None, "", "x" * 100000, texts[0], texts[0]]
    bench = spark.createDataFrame([(i % 9, t) for i, t in enumerate(items)], "item_id bigint, text string")
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in enumerate(items):
        w = words(t)
        k = min(13, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(i % 9))
    want = []
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    found |= windows[tuple(w[p : p + k])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for most in (decontaminate.MAX_INDEX_BYTES, 0):
        got = decontaminate.contamination(docs(spark, texts), bench, max_index_bytes=most).drop("items")
        assert sorted(map(tuple, got.collect())) == sorted(want)
        clean = decontaminate.decontaminate(docs(spark, texts), bench, max_index_bytes=most)
        assert sorted(r.doc_id for r in clean.collect()) == [x[0] for x in want if not x[-1]] and clean.columns == docs(spark, []).columns


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT (text)"]
    broken = mit.replace("free of charge", "FREE of any charge").replace("merge,", "")
    texts = ["nothing to see here", f"é head. {broken} tail", "Licensed under CC BY-NC 4.0.", None, "", "Released under the MIT License. x Released under the MIT License."]
    got = licenses.scan_licenses(docs(spark, texts)).collect()
    assert sorted({(r.doc_id, r.license) for r in got}) == [(1, "MIT (text)"), (2, "CC-BY-NC-4.0 (notice)"), (5, "MIT (notice)")]
    r = next(r for r in got if r.doc_id == 1)
    assert 0.95 < r.coverage < 1 and texts[1][r.start : r.end].startswith("Permission") and texts[1][r.start : r.end].endswith("SOFTWARE")
    assert sum(r.doc_id == 5 for r in got) == 2


def brute_alignment(words, template):
    """(matched, start, end) of the longest common subsequence; of the best the one that begins latest and ends first."""
    row, best = [(0, -1)] * (len(words) + 1), (0, -1, -1)
    for t in template:
        new = [(0, -1)]
        for j, w in enumerate(words):
            cell = max(row[j + 1], new[j])
            if w == t:
                taken = (row[j][0] + 1, row[j][1] if row[j][0] else j)
                cell = max(cell, taken)
                if taken > best[:2]:
                    best = (*taken, j + 1)
            new.append(cell)
        row = new
    return best


def test_license_places_match_brute_force(spark):
    rng = random.Random(12)
    templates = {f"t{n}": " ".join(f"t{n}w{rng.randrange(n)}" for _ in range(n)) for n in (1, 4, 12, 60, 300)}
    texts, expected = [], []
    for _ in range(40):
        parts, at = [], 0
        for _ in range(rng.randrange(1, 6)):
            junk = [f"junk{rng.randrange(9)}" for _ in range(rng.randrange(30, 60))]
            name = rng.choice(sorted(templates))
            words = templates[name].split()
            for _ in range(rng.randrange(1 + len(words) // 8)):  # edits, within the band
                i = rng.randrange(len(words))
                words[i : i + rng.randrange(2)] = rng.choice([[], ["other"], [words[i].upper()]]) if abs(len(words) - len(templates[name].split())) < 6 else ["other"]
            matched, start, end = brute_alignment([w.lower() for w in words], templates[name].split())
            if matched >= licenses.MIN_COVERAGE * len(templates[name].split()):
                expected.append((len(texts), name, matched, at + len(junk) + start, at + len(junk) + end))
            parts += junk + words
            at += len(junk) + len(words)
        texts.append(" ".join(parts))
    got = []
    for r in licenses.scan_licenses(docs(spark, texts), templates).collect():
        got.append((r.doc_id, r.license, r.matched, len(texts[r.doc_id][: r.start].split()), len(texts[r.doc_id][: r.end].split())))
    assert sorted(got) == sorted(expected) and len(expected) > 50
    again = licenses.scan_licenses(docs(spark, texts), templates, max_template_bytes=100)  # a pass for each template
    assert sorted((r.doc_id, r.license, r.matched) for r in again.collect()) == sorted(x[:3] for x in expected)


def test_license_scan_of_a_long_text_of_notices(spark, tmp_path):
    notice = licenses.TEMPLATES["MIT (notice)"]
    began = time.time()
    got = licenses.scan_licenses(docs(spark, [f"{notice} " * 20000, (licenses.TEMPLATES["MIT (text)"] + " ") * 300])).groupBy("doc_id", "license").count().collect()
    assert {(r.doc_id, r.license): r["count"] for r in got} == {(0, "MIT (notice)"): 20000, (1, "MIT (text)"): 300}
    assert time.time() - began < 30
    (tmp_path / "one.txt").write_text("a text of my own")
    assert licenses.read_templates(spark, str(tmp_path)) == {"one": "a text of my own"}
    assert licenses.scan_licenses(docs(spark, ["A TEXT of, my own", "x"]), {"one": "a text of my own", "none": "..."}).count() == 1


def test_line_dedup(spark):
    texts = [f"Menu\nunique line {i}\n\n Menu \nend {i % 2}" for i in range(20)] + [None, "", "Menu"]
    df = docs(spark, texts, ["a"] * 20 + ["a", "a", None])
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, n_lines="n", n_dropped="d").collect()}
    assert got[3].text == "unique line 3\n" and (got[3].n, got[3].d) == (5, 3)  # both ends are on ten pages
    assert got[20].text is None and got[20].n == 0 and got[21].text == "" and got[22].text == "Menu"
    assert line_dedup.drop_boilerplate(docs(spark, [])).count() == 0


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) / 3
    x[50:60] = x[0]
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)] + [(400, None, 0), (401, [float("nan")] * 8, 0), (402, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (7, [float(v) for v in x[7]], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int").repartition(3)
    q = np.floor(x * 256).astype(int)
    want = []
    for i in range(0, 400, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == want
    two = topk.top_k(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in two] == [(0, 1, 1)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_topk_of_large_components_in_passes(spark, monkeypatch):
    monkeypatch.setattr(topk, "MAX_QUERY_VALUES", 40)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "PIVOT_SAMPLE", 50)
    rng = random.Random(16)
    for top in (2**8, 2**27, 2**31, 2**45):  # scores below 2**53, below 2**63, and beyond what a bigint holds
        x = {i: [rng.randrange(-top, top) for _ in range(4)] for i in range(120)}
        x[118], x[119] = x[0][:], [v + 1 for v in x[0]]
        df = spark.createDataFrame([(i, [v / 256 for v in e]) for i, e in x.items()], "vec_id bigint, embedding array<double>").repartition(3)
        want = []
        for i in range(0, 120, 7):
            held = lambda j: min(max(sum(a * b for a, b in zip(x[i], x[j])), -(2**63)), 2**63 - 1)  # noqa: B023, E731
            want += [(i, r + 1, j, held(j)) for r, j in enumerate(sorted((j for j in x if j != i), key=lambda j: (-held(j), j))[:4])]  # noqa: B023
        got = topk.top_k(df, F.col("vec_id") % 7 == 0, k=4)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_topk_skips_what_pivots_rule_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 400
    x = np.floor(np.concatenate([c + rng.normal(size=(100, 16)) * 20 for c in centres])).astype(np.int64)
    ids = np.arange(len(x))
    order = rng.permutation(len(x))
    sample, q = order[:1000], ids[::50]
    search = topk.Searcher(q, x[q], topk.choose_pivots(x[sample].astype(float), topk.PIVOTS), 5, topk.sample_floors(q, x[q], sample, x[sample], 5))
    for lo in range(0, len(x), 500):
        search.scan(ids[lo : lo + 500], x[lo : lo + 500])
    assert search.pairs == len(q) * (len(x) - 1) and search.evaluated < 0.35 * search.pairs
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -(2**62)
    assert (np.sort(score)[:, :-6:-1] == search.best.scores).all()


def test_url_filter(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("Bare.Host", "block")]
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/fr/", "http://example.net", "http://badexample.com/de/", "x://m.example.com/de/1#a", None, "nonsense", "http://a.org/fr/?", "http://x.bare.host:80/", "http://x.bare.host", "http://" + "a." * 3000 + "net/" + "p" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    want = ["example.net/en/", "net/", None, None, "example.com/de/", None, None, "org/fr/", None, "bare.host", "net/"]
    for most in (1 << 20, 0):
        got = {r.page_id: (r.rule, r.verdict, r.host, r.path) for r in url_filter.filter_urls(pages, rules, max_rule_bytes=most).collect()}
        assert [got[i][0] for i in range(len(urls))] == want
        assert got[0][1:] == ("allow", "a.example.net", "/en/x") and got[2][1:] == ("allow", "example.net", "") and got[6][2:] == ("", "")
    frame = spark.createDataFrame([*rules, ("", "block"), (None, "block"), ("net/", "allow")], "rule string, verdict string")
    for most in (1 << 20, 0):  # a list as a table
        got = {r.page_id: r.rule for r in url_filter.filter_urls(pages, frame, max_rule_bytes=most).collect()}
        assert [got[i] for i in range(len(urls))] == want
    assert url_filter.filter_urls(pages, []).filter("verdict = 'allow'").count() == len(urls)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 8)
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([0, 1, 5, 5, 5, 30, 200])) for _ in range(600)] + [None, "a b"]
    sources = [rng.choice(["b", "b", "b", "c", None]) for _ in texts]
    sources[-1] = "a"  # tiny: clamped at three times its size
    df = docs(spark, texts, sources)
    rows = mixing.mix(df).collect()
    again = sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))
    assert sorted(map(tuple, rows)) == again and len(rows) == len(texts)
    size = {i: len(SPACED.findall(t or "")) for i, t in enumerate(texts)}
    total = {}
    for r in rows:
        assert r.size == size[r.doc_id] and r.taken <= 3 * r.size and r.taken == r.size * r.repeats
        s = total.setdefault(sources[r.doc_id], [0, 0, 0.0])
        s[0], s[1], s[2] = s[0] + r.taken, r.source_size, r.target
    assert total["a"][2] == 6 and sum(x[2] for x in total.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken - target) <= 5 for taken, _, target in total.values())
    out = mixing.sample_mix(df)
    assert out.columns == [*df.columns, "repeat"] and out.count() == sum(r.repeats for r in rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(3)
    good = [prose(rng, 80) for _ in range(150)]
    bad = [" | ".join(prose(rng, 60).split()) for _ in range(100)] + [(prose(rng, 1) + " ") * 50 for _ in range(50)]
    texts = [*good, *bad, None, "", "x" * 200000]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, texts)
    model = quality.train(df, labels)
    got = quality.score(df, model).collect()
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(got) == len(texts) and len(held) > 30
    assert np.mean([r.predicted == int(r.doc_id < 150) for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.score(df, quality.train(df, labels.limit(0))).filter("score = 0.5").count() == len(texts)
    assert quality.keep_good(df, model).columns == df.columns


def test_quality_model_matches_plain_solvers():
    rng = np.random.default_rng(18)
    labels = (rng.random(120) < 0.4).astype(int)
    lists = [np.unique(rng.choice(30, 9, p=np.linspace(1 + 2 * y, 3 - 2 * y * 0.9, 30) / np.linspace(1 + 2 * y, 3 - 2 * y * 0.9, 30).sum())) for y in labels]
    rows = quality.Rows(np.concatenate(lists), np.array([len(x) for x in lists]))
    scale = quality.log_count_ratios(rows, labels)
    for place in range(30):
        share = [(sum(place in x for x, y in zip(lists, labels) if y == k) + 1) / ((labels == k).sum() + 2) for k in (1, 0)]
        assert abs(scale[place] - np.log(share[0] / share[1])) < 1e-12
    w, bias = quality.dual_coordinate_descent(rows, labels, scale, rounds=400)
    x = np.zeros((120, 31))
    for i, places in enumerate(lists):
        x[i, places] = scale[places] / np.sqrt((scale[places] ** 2).sum())
    x[:, 30], y = 1.0, 2.0 * labels - 1  # the bias is a column of ones
    cost = np.where(y > 0, 60.0 / labels.sum(), 60.0 / (1 - labels).sum())
    objective = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    plain, best = np.zeros(31), np.inf
    for t in range(20000):  # subgradients
        inside = y * (x @ plain) < 1
        plain = plain - (plain - ((cost * y)[inside, None] * x[inside]).sum(0)) / (t + 100)
        best = min(best, objective(plain))
    found = np.append(w[:30], bias)
    assert objective(found) <= best + 1e-3 and abs(objective(found) - best) < 0.02 * best and not w[30:].any()


def brute_components(texts, num=90, den=100, k=3):
    sets = []
    for t in texts:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, base, share):
    return " ".join(w if rng.random() > share else f"z{rng.randrange(999)}" for w in base.split())


def test_ngram_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(4)
    texts = [None, "", "one", "one", "one two", "One  two", "a b c", "a b c d", " "]
    for n in (9, 10, 12, 20, 40, 150, 700):
        base = prose(rng, n, 500)
        texts += [base, base.upper()] + [edited(rng, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(4)]
        texts += [f"{base} {prose(rng, k)}" for k in (1, 2, n // 12 + 1)]
    base = prose(rng, 148, 900)
    texts += [edited(rng, base, 0.012) for _ in range(70)]
    got = ngram_join.similar_components(docs(spark, texts))
    assert sorted(map(tuple, got.collect())) == brute_components(texts)
    one = ngram_join.keep_one_of_each(docs(spark, texts))
    keep = [i for i, n, c in brute_components(texts) if i == c]
    assert sorted(r.doc_id for r in one.collect()) == keep
    assert ngram_join.similar_components(docs(spark, [])).count() == 0


def test_ngram_join_of_large_groups_in_small_pieces(spark, monkeypatch):
    """Chains and crowds about the threshold: blocks, packs and held pairs far smaller than a group."""
    for name, size in (("BLOCK", 8), ("PACK", 300), ("HELD", 64)):
        monkeypatch.setattr(ngram_join, name, size)
    rng = random.Random(14)
    texts = [" ".join(f"w{j}" for j in range(3000))]  # one very long text
    for n in (30, 90):
        words = prose(rng, n, 4000).split()
        for _ in range(40):  # a chain that drifts away from where it began
            words[rng.randrange(n)] = f"c{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        base = prose(rng, n, 4000)
        texts += [edited(rng, base, 0.03) for _ in range(60)]
    texts += texts[50:90]
    rng.shuffle(texts)
    for options, brute in (({"shingle": 5, "numerator": 80, "denominator": 100}, {"num": 80, "k": 5}), ({}, {})):
        got = ngram_join.similar_components(docs(spark, texts), **options)
        assert sorted(map(tuple, got.collect())) == brute_components(texts, **brute)


@pytest.mark.parametrize("one_task", [0, 20, 1 << 20])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(i, j) for i in range(3) for j in range(3)] + [(None, 5), (6, None), (9, 9)]
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint"), Stored(spark))
    expected = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]} | {i: 0 for i in range(3)}
    assert {r.vertex: r.root for r in got.collect()} == expected
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), Stored(spark)).collect() == []


def test_span_dedup(spark):
    rng = random.Random(5)
    passage = "Thwhing onwh haheble in to, " + prose(rng, 20) + ". Halynt. That whwh! " + prose(rng, 25) + ". To an."
    own = [f"Intro {i} {prose(rng, 30)}.\n{prose(rng, 12)}. {prose(rng, 3)}." for i in range(6)]
    texts = [f"{own[0]}\n{passage} {own[1]}", own[2], f"{own[3]} {passage.translate({v: k for k, v in LOWER.items()})}", f"{own[4]}\n{passage}\n{passage}", None, "", own[5], "Yes. No. Yes. No. Yes. No."]
    got = {r.doc_id: r for r in span_dedup.remove_repeats(docs(spark, texts), counts=True).collect()}
    assert all(got[i].text == texts[i] for i in (0, 1, 4, 5, 6, 7)) and all(got[i].n_words_removed == 0 for i in (0, 1, 4, 5, 6, 7))
    words = lambda t: ALNUM.findall(t.translate(LOWER))
    assert words(got[2].text) == words(own[3]) and words(got[3].text) == words(own[4])
    assert got[3].n_words_removed == 2 * len(words(passage))
    assert span_dedup.remove_repeats(docs(spark, [])).count() == 0


def brute_spans(rows):
    """(text, words removed) of each (id, text) by plain string work."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    cut, seen = {}, set()
    for i in order:
        text = rows[i][1] or ""
        stops = [m.end() for m in re.finditer(r"\n|[.!?](?![0-9a-zA-Z\x80-\U0010FFFF,;:\-_/@&=+.!?])", text)]
        words = [(m.start(), m.group(), bisect.bisect_right(stops, m.start())) for m in ALNUM.finditer(text.translate(LOWER))]
        sentences = [[w for w in words if w[2] == k] for k in sorted({w[2] for w in words})]
        gone = set()
        for a in range(len(sentences)):
            for b in range(a + span_dedup.MIN_SENTENCES, len(sentences) + 1):
                run = tuple(w[1] for s in sentences[a:b] for w in s)
                if len(run) >= span_dedup.MIN_WORDS:
                    if run in seen:
                        gone |= set(range(a, b))
                    seen.add(run)
                    break
        bounds = [s[0][0] for s in sentences] + [len(text)]
        kept = "".join(text[bounds[k] : bounds[k + 1]] for k in range(len(sentences)) if k not in gone)
        cut[i] = (text[: bounds[0]] + kept if rows[i][1] is not None else None, sum(len(sentences[k]) for k in gone))
    return [cut[i] for i in range(len(rows))]


def test_span_dedup_matches_brute_force(spark):
    rng = random.Random(15)
    pool = [f"{prose(rng, rng.randrange(1, 14))}{rng.choice(['.', '!', '?', '...', chr(10), '.%%', '.)'])}" for _ in range(50)]
    # the digest of the text decides among rows of one id, so these differ in their ids or are alike
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(25)))) for i in range(60)]
    rows += [rows[7], rows[8], (8, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (None, None), (None, None), (70, ""), (71, "a. b"), (72, "a 3.5 b.c d, e. f")]
    rows.append((80, " ".join(pool[i % 50] for i in range(4000))))  # a very long text
    rows += [(100 + i, rows[3][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    expected = sorted(brute_spans(rows), key=str)
    got = span_dedup.remove_repeats(df, counts=True)
    assert sorted(((r.text, r.n_words_removed) for r in got.collect()), key=str) == expected
    named = span_dedup.remove_repeats(df.selectExpr("lpad(cast(doc_id as string), 3, '0') as doc_id", "text"))  # ids may be strings
    assert sorted((r.text for r in named.collect()), key=str) == sorted((t for t, _ in expected), key=str)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(s):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(s):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")[:4]) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and privacy.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(6)
    parts = ["a.b", "@", "x-y", ".com", " ", "é", "+1 (974) 555-3436", "97.51.17.173", "4845168114407329", "4111 1111-1111 1111", "1", "256.1.1.1", "1.2.3.4.5", "@@", "a@b@c.de", "+", "(", "-", "0000001.2.3.004", "%", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["", "a" * 30000, "1" * 30000, "1." * 9000, "+" * 9000]
    for t in texts[:-4]:
        assert privacy.base_spans(t) == plain_spans(t), t
    rows = privacy.find_personal_data(docs(spark, [*texts, None])).collect()
    by = {r.doc_id: r for r in rows}
    for i in range(0, 3000, 50):
        shown = ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(texts[i]))
        assert by[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and by[i].n_email == sum(k == 0 for _, k, _ in plain_spans(texts[i]))
    assert len(rows) == len(texts) + 1 and by[len(texts)].spans == ""


def test_revealing_terms(spark):
    rng = random.Random(7)
    texts = [prose(rng, 40) for _ in range(60)]
    texts += [f"{prose(rng, 8)} Zaphod wrote from z@galaxy.example.com {prose(rng, 8)}" for _ in range(5)]
    texts += [f"{prose(rng, 8)} unrelated q@other.example.com"] * 4  # copies prove nothing
    got = {r.doc_id: r for r in privacy.find_personal_data(docs(spark, texts)).collect()}
    at = texts[60].index("Zaphod")
    assert f"removed:{at}:{at + 6}" in got[60].spans and "email:" in got[60].spans
    assert all("removed" not in got[i].spans and "generalised" not in got[i].spans for i in range(65, 69))
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs(spark, texts)).collect()}
    assert "Zaphod" not in clean[60] and "[email]" in clean[60] and clean[0] == texts[0]


def test_secrets_are_opaque_values_of_few_texts(spark):
    rng = random.Random(17)
    key = lambda: "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(40))
    common, mine, twice = key(), key(), key()
    texts = [f"{prose(rng, 10)} file {common} {i}" for i in range(200)] + [prose(rng, 10) for _ in range(200)]
    texts += [f'é token = "{mine}" x {twice.upper()}', f"y {twice}", f"é{key()}", "x" * 40, "1" * 40, None, "", f"{key()}"]
    got = {r.doc_id: r for r in privacy.find_personal_data(docs(spark, texts)).collect()}
    at, second = texts[400].index(mine), texts[400].index(twice.upper())
    assert f"secret:{at}:{at + 40},secret:{second}:{second + 40}" == got[400].spans and got[400].n_private == 2
    assert got[401].n_private == 1 and got[407].spans == "secret:0:40"
    assert all(got[i].n_private == 0 for i in [*range(400), 402, 403, 404, 405, 406])
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs(spark, texts)).collect()}
    assert clean[400] == 'é token = "[secret]" x [secret]' and clean[0] == texts[0]


def test_pipeline_stages_keep_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    texts = [prose(rng, 60, 400) for _ in range(80)] + [" | ".join(prose(rng, 40).split()) for _ in range(40)] + [None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*texts, texts[0], texts[1]])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(texts[5].split()[:30]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*corpus_pipeline.COLUMNS, "repeat"]
    ids = {r.doc_id for r in out.collect()}
    assert 5 not in ids and not ids & set(range(80, 120)) and not ids & {122, 123}


def test_pipeline_links_at_five_words_and_four_fifths(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"v{i}" for i in range(60)]
    near = [w if i not in (20, 21) else f"z{i}" for i, w in enumerate(words)]  # 5 words: 50 of 62; 3 words: 54 of 62
    far = [w if i not in (20, 40) else f"y{i}" for i, w in enumerate(words)]  # 5 words: 46 of 66
    texts = [" ".join(w) for w in (words, near, far)]
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs(spark, texts).drop("item_id", "verdict"), "").collect()} == {0, 2}
    assert ngram_join.keep_one_of_each(docs(spark, texts)).count() == 3


def test_pipeline_keeps_the_text_of_a_large_group_of_copies(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    page = lambda: "\n".join(prose(rng, 25, 5000) for _ in range(8))
    copied = page()
    near = [re.sub(rf"(?<!\S){w}(?!\S)", f"edited{i}", copied) for i, w in enumerate(rng.sample(sorted(set(copied.split())), 20))]
    own = [f"Home | News | About\n{page()}\nAll rights reserved" for _ in range(80)]
    texts = [copied] * 20 + near + own + ["Home | News | About\nAll rights reserved"]
    stage1 = corpus_pipeline.line_stage(spark, docs(spark, texts).drop("item_id", "verdict"), "")
    got = {r.doc_id: r.text for r in corpus_pipeline.near_duplicate_stage(spark, stage1, "").collect()}
    assert [i for i in got if i < 40] == [0] and got[0] == copied
    assert all(got[i] == texts[i].split("\n", 1)[1].rsplit("\n", 1)[0] for i in range(40, 120)) and got[120] == texts[120]


def test_an_entity_that_occurs_once_is_protected_everywhere(spark):
    rng = random.Random(10)
    texts = [prose(rng, 10) for _ in range(5000)]
    texts += [f"{prose(rng, 8)} Trillian wrote from t@galaxy.example.com {prose(rng, 30)} é Trillian"] * 3
    texts += [f"{prose(rng, 20)} trillian {prose(rng, 20)}"]
    got = {r.doc_id: r.spans for r in privacy.find_personal_data(docs(spark, texts)).collect()}
    far, other = texts[5000].rindex("Trillian"), texts[5003].index("trillian")
    for i in (5000, 5001, 5002):
        assert f":{far}:{far + 8}" in got[i] and f":{texts[i].index('Trillian')}:" in got[i]
    assert f"generalised:{other}:{other + 8}" in got[5003] or f"removed:{other}:{other + 8}" in got[5003]
    assert all(got[i] == "" for i in range(5000))
