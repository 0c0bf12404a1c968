"""License scans, lexical search and clustering against plain versions, ids beside nulls, and the queries that SQL can say."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from oracle_check import difference, duck

from tallyloom.llm import centroid_clustering, fingerprints, html_text, lexical_search, license_scan, ngram_scoring, packing, simhash
from tallyloom.llm.queries import ORACLES, QUERIES, tokenizer_file

SF_DIR = "/root/testdata/sf0.001"
LARGE = [2**53 + 1, 2**53 + 3, 2**53 + 5, -(2**53) - 1]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert difference(df, duck(SF_DIR), ORACLES[name]) is None
    if name in ("op9_url_rules", "op11_license_scan"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow") if w in plan]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "Under the MIT license, under the\nmit LICENSE!", "x " * 30000 + "cc by nc", "cc-by-nc", "the cat, the hat", "the cat, the hat", "été CAT 9", " ,;\n"]
    rows = [(i, t, 1, "w", 2.0, "n") for i, t in enumerate(texts)] + [(None, "no id cat", 1, "w", 2.0, "n"), (5, "the cat, the hat", 1, "w", 2.0, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, rank int, words string, score double, key string")


# --- license scans -----------------------------------------------------------


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain_scan(text, base, notices, threshold):
    words, places, labels = words_of(text), [], set()
    for phrase, label in base:
        parts = phrase.split(" ")
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    base_labels, top = set(labels), 0.0
    for line in lowered(text).split("\n"):
        own = set(words_of(line))
        held = [(len(own & set(n.split(" "))) / len(set(n.split(" "))), len(set(n.split(" "))), label) for label, n in notices]
        held = [h for h in held if h[0] >= threshold - 1e-12]
        if held:
            top = max(top, max(held)[0])
            labels |= {label for c, size, label in held if (c, size) == max(h[:2] for h in held)}
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 if places else top


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9, 1.0])
def test_licenses_against_all_pairs(spark, threshold):
    rng = np.random.default_rng(3)
    letters = [chr(97 + i) for i in range(14)]
    notices = [(f"l{i % 6}", " ".join(rng.choice(letters, int(rng.integers(1, 9)), replace=False))) for i in range(15)]
    texts = ["\n".join(" ".join(rng.choice(letters, int(rng.integers(0, 16)))) for _ in range(int(rng.integers(1, 5)))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = [("a b", "ab"), ("c c", "cc")]
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan(docs, base, notices, threshold).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_scan(text, base, notices, threshold), abs=1e-12), text


def test_licenses_of_odd_rows(spark, odd):
    got = collections.Counter(tuple(r) for r in license_scan.scan(odd).collect())
    want = collections.Counter((r["doc_id"], *plain_scan(r["text"], license_scan.BASE, license_scan.NOTICES, license_scan.THRESHOLD)) for r in odd.collect())
    assert got == want
    assert license_scan.scan(odd.limit(0)).count() == 0
    assert {r["labels"] for r in license_scan.scan(odd, notices=[]).collect()} == {"", "mit", "cc-by-nc"}
    line = "This work is licensed under the GNU General Public License, version 2."
    one = spark.createDataFrame([(1, f"Some prose.\n{line}\nMore prose under the sun.")], "doc_id long, text string")
    assert license_scan.scan(one).first()["labels"] == "gpl-2"


# --- lexical search ----------------------------------------------------------


def plain_search(docs, items, k):
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    every, length = len(held), sum(n for _, _, n in held)
    df = collections.Counter(w for _, c, _ in held for w in c)
    weight = lambda w: math.floor(1000 * math.log((2 * every + 2) / (2 * df[w] + 1)))
    out = []
    for item, text in items:
        asked = collections.Counter(terms(text))
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * every) // length
            score = sum(q * weight(w) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in asked.items())
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("cells", [lexical_search.CELLS, 3000, 1])
def test_search_against_all_scores(spark, monkeypatch, cells):
    """Small blocks and segments, so that lists have many blocks; a tight cell bound halves segments down to one document."""
    monkeypatch.setattr(lexical_search, "BLOCK", 4)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    monkeypatch.setattr(lexical_search, "ITEMS", 7)
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(60)])
    chances = 1 / np.arange(1, 61) ** 1.1
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=chances / chances.sum()))
    texts = [draw(int(rng.integers(0, 30))) for _ in range(400)]
    texts[300:330] = [texts[0] + " w1"] * 30  # equal scores
    docs, items = list(enumerate(texts)), [(i, draw(6)) for i in range(16)] + [(3, "W59 w58"), (None, "w2"), (99, ""), (98, None)]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(plain_search(docs, items, 5))


def test_bounds_are_never_less_than_a_score():
    rng = np.random.default_rng(1)
    numbers = [np.sort(rng.choice(40, int(rng.integers(1, 20)), replace=False)) for _ in range(300)]
    starts = np.cumsum([0, *map(len, numbers)])
    impacts = rng.integers(1, 10**6, starts[-1])
    segment = lexical_search.Segment(np.arange(300).astype(object), np.concatenate(numbers), starts, impacts, np.ones(40, dtype=np.int64))
    assert sorted(segment.members.tolist()) == sorted(np.repeat(np.arange(300), np.diff(starts)).tolist())
    for block, end in enumerate(segment.ends):
        members = segment.members[segment.ends[block - 1] if block else 0 : end]
        assert (segment.summaries[block] == segment.impacts[members].max(axis=0)).all()


def test_search_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "Cat the", "x"), (1, "Cat the", "x"), (2, "zebra", "x"), (None, "MIT", "x")], "item_id long, text string, rank string")
    got = collections.Counter(tuple(r) for r in lexical_search.search(odd, items).collect())
    assert got == collections.Counter(plain_search([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 20))
    assert lexical_search.search(odd.limit(0), items).count() == 0 and lexical_search.search(odd, items.limit(0)).count() == 0


def test_long_texts_in_slices(monkeypatch):
    text = "Ab,cé " * 50 + "x" * 90 + " y\x00z"
    whole = [w for some in lexical_search.terms(text.encode()) for w in some]
    monkeypatch.setattr(lexical_search, "SLICE", 16)
    assert [w for some in lexical_search.terms(text.encode()) for w in some] == whole == [w.encode() for w in ["ab", "cé"] * 50 + ["x" * 90, "y", "z"]]


# --- clustering --------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), (centroid_clustering.forward(np.array(v)).astype("<i4").tobytes()), v) for i, v in kept)
    places = [v for _, _, v in first[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((distance(v, c), n) for n, c in enumerate(places))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        places = [[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(places)]
    told = [(i, *near(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, n in told:
        inertia[n] += d
    return collections.Counter((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, places[n])).encode()).hexdigest()) for i, d, n in told)


def test_clusters_against_all_distances(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(i % 5, 1.0, 64)]) for i in range(300)] + [(7, [0.25] * 64)] * 3 + [(None, [-0.0001] * 64)]
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int, coefficients string")
    got = centroid_clustering.clustered(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_clusters(rows + odd)
    few = df.where("vec_id in (7, 904)")
    assert collections.Counter(tuple(r) for r in centroid_clustering.clustered(few).collect()) == plain_clusters([r for r in rows + odd if r[0] in (7, 904)])
    assert centroid_clustering.clustered(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroid_clustering.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_transform_and_search_are_exact():
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**24), 2**24, (200, 64))
    x[:20] = x[0]  # ties
    assert (centroid_clustering.backward(centroid_clustering.forward(x)) == x).all()
    centroids = np.r_[x[5:8], x[100:105]]
    near, distance = centroid_clustering.nearest(centroid_clustering.forward(x), centroid_clustering.forward(centroids))
    all_distances = ((x[:, None] - centroids[None]).astype(object) ** 2).sum(axis=2)
    assert (near == all_distances.argmin(axis=1)).all() and distance.tolist() == all_distances.min(axis=1).tolist()


# --- ids ---------------------------------------------------------------------


def test_large_ids_beside_null_ones(spark):
    rows = [(i, "one two three\nfour") for i in LARGE] + [(None, "one two three\nfour")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {*LARGE, None}
    assert {r["doc_id"] for r in ngram_scoring.scored(df).collect()} == want
    assert {r["doc_id"] for r in packing.packed(df, tokenizer_file("word_bpe_49k.json")).collect()} == want
    assert {r["doc_id"] for r in fingerprints.fingerprints(df).collect()} == want
    assert {r["doc_id"] for r in lexical_search.search(df, spark.createDataFrame([(1, "four")], "item_id long, text string")).collect()} == want


def test_one_of_each_where_ids_repeat(spark):
    copies, other = "a b c d e f g h i j " * 20, "quite another text " * 20
    rows = [(1, copies, "x"), (1, other, "y"), (2, copies, "z"), (None, other, "n"), (None, "third text with no id at all", "m"), (2, copies, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    assert sorted((str(r["doc_id"]), r["text_hash"]) for r in simhash.one_of_each(df).collect()) == [("1", "x"), ("1", "y"), ("None", "m")]


# --- html --------------------------------------------------------------------


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "entry-header", "article-body social-share-enabled", "content with-comments", "page-header-fixed", "sidebar"])
def test_a_wrapper_whatever_its_name_keeps_its_text(name):
    """Names that only hold a word of a list mean nothing, and one that means it is a wrapper if all text is inside."""
    words = "word " * 30
    page = f'<body><div class="{name}"><h1>A title</h1><p>{words}</p><p>{words}</p></div></body>'
    assert html_text.main_text(page) == "\n".join(["A title", words.strip(), words.strip()])


def test_marked_parts_have_no_weight_beside_a_text():
    words, other = "word " * 60, "other " * 40
    page = f'<body><ul class="site-menu"><li>{other}</li></ul><article><p>{words}</p><div class="comment-list"><p>{other}</p></div></article><div id="leftSidebar">{other}</div></body>'
    assert html_text.main_text(page) == words.strip()


def test_menus_without_marks_do_not_surge():
    words = "word " * 60
    menu = "<ul>" + "<li><a href='/x'>short</a></li>" * 8 + "</ul>"
    assert html_text.main_text(f"<body>{menu}<div><p>{words}</p></div>{menu}</body>") == words.strip()


def test_deep_pages_take_time_in_proportion():
    import time

    def seconds(n):
        start = time.perf_counter()
        html_text.main_text("<div>" * n + "<p>x</p>" * n + "</b></div>" * n)
        return time.perf_counter() - start

    assert seconds(16000) < 12 * max(seconds(4000), 0.05)
