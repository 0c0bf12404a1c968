"""Each operator against a brute-force version, and on nulls, empty texts and tables, ties, repeated rows and clashing columns."""

import collections
import hashlib
import html as html_module
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from tallyloom.llm import bpe, embedding_dedup, fingerprints, html_text, language_id, ngram_scoring, packing, simhash, toxicity, url_rules
from tallyloom.llm.components import components
from tallyloom.llm.queries import tokenizer_file

ODD_TEXTS = [None, "", " \n\t", "a", "Ünï çödé — “x” 12 <|endoftext|> it's\u00a0\x1d ok", "z" * 9000, "the cat sat. " * 40, "the cat sat. " * 40, "日本語 テキスト 👍🏽 e\u0301"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, odd texts, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", 1, "p", 2.0) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", None, 1, "p", 2.0), (3, "a", "en", 1, "p", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key int, part string, score double")


def least(nodes, edges):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 30)] + [(5, 5), (7, 8), (8, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = least({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    vectors = [base[i % 60] + rng.standard_normal(16) * 0.09 * (i % 4) for i in range(300)] + [base[0], base[0], 2 * base[0], np.zeros(16)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3 if i < 300 else 0) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1), (904, rows[0][1], None), (905, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, recall=0.999, chunk=7).collect()}
    x = np.array([r[1] for r in rows[:303]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows[:303]])
    near = (x @ x.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    found, all_links = sum(got[i][0] for i in range(303)), near.sum()
    assert all_links > 300 and 0.97 * all_links <= found <= all_links
    assert all(got[i][0] <= near[i].sum() for i in range(303))
    if found == all_links:
        want = least(range(303), zip(*np.nonzero(near), strict=True))
        assert all(got[i] == (near[i].sum(), want[i], want[i] == i) for i in range(303))
    assert all(got[i] == (0, i, True) for i in (303, 900, 901, 902, 903, 904, 905))
    assert got[None] == (0, None, None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_ngram_scores(spark, odd):
    texts = ["the cat sat on the mat", "the cat sat on a hat", "a hat sat", "", None, "the", "the cat sat on the mat", "Été à la plage; the cat"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in ngram_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    grams = [collections.Counter(g for k in (1, 2, 3) for g in zip(*(w[i:] for i in range(k)), strict=False)) for w in words]
    every, total = sum(grams, collections.Counter()), sum(map(len, words))
    for i, w in enumerate(words):
        log, rest = 0.0, total - len(w)
        other = lambda *g, own=grams[i]: every[g] - own[g]
        for k in range(len(w)):
            if k > 1 and other(*w[k - 2 : k + 1]):
                log += math.log(other(*w[k - 2 : k + 1]) / other(*w[k - 2 : k]))
            elif k and other(*w[k - 1 : k + 1]):
                log += math.log(0.4 * other(*w[k - 1 : k + 1]) / other(w[k - 1]))
            else:
                log += math.log(0.16 * other(w[k]) / rest) if other(w[k]) else math.log(0.064 / rest)
        assert got[i]["n_words"] == len(w) and got[i]["log_score"] == pytest.approx(log)
    assert got[3]["mean_log"] is None
    assert ngram_scoring.scored(odd).count() == odd.count() and ngram_scoring.scored(odd.limit(0)).count() == 0


def test_packing_encoder_learns_words_together():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    whole, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["a,b ,c,,", "\u0130 \u0131 \u00df, \u0130, \u0958, \u1e9e. x", "\u4e2d\u6587 \u5b57, \u0915\u093c,", "<|endoftext|> <|x", "a\x1cb\x1f c", "na\u00efve, e\u0301t\u00e9. it's", "", " ", "y" * 3000]
    for text, ids in zip(texts * 2, encoder.encode(texts) + encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packed_keys_and_counts():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**40, 500).astype(np.uint64))
    assert (ngram_scoring.unpack_keys(ngram_scoring.pack_keys(keys)) == keys).all()
    dense = np.arange(7, 900, 3, dtype=np.uint64)
    assert (ngram_scoring.unpack_keys(ngram_scoring.pack_keys(dense)) == dense).all()
    counts = np.array([1, 254, 255, 256, 10**12])
    assert (ngram_scoring.unpack_counts(ngram_scoring.pack_counts(counts), 5) == counts).all()


def test_ngrams_that_differ_in_low_bits_only():
    """Two words whose hashes share 63 bits keep counts of their own, in one bucket or two, for any number of partitions."""

    def word_hash(wanted):  # the word hash of which the n-gram hash is the wanted one
        x = wanted ^ (wanted >> 29) ^ (wanted >> 58)
        x = x * pow(int(ngram_scoring.ODD[1]), -1, 1 << 64) % (1 << 64)
        return (x ^ (x >> 31) ^ (x >> 62)) - 1

    first = 0x9E3779B97F4A7C14
    told = dict(zip(("twina", "twinb"), map(word_hash, (first, first + 1)), strict=True))
    ngram_scoring._hashes.update(told)
    try:
        texts = ["twina twina twina", "twina", "twinb"]
        for partitions in (1, 3, 8):
            rows = pa.RecordBatch.from_pydict({"key": pa.array([0, 0, 1], pa.int32()), "id": ["0", "1", "2"], "text": [t.encode() for t in texts]})
            frame = pd.concat(b.to_pandas() for b in ngram_scoring._dealt(iter([rows])))
            packets = pd.concat(ngram_scoring._packets(partitions)(iter([frame]))).sort_values("part", kind="stable")
            sums = pd.concat(ngram_scoring._summed(iter([packets]))).sort_values("part", kind="stable")
            grams = ngram_scoring.Grams(texts[2:], partitions)
            own = sums[sums["bucket"] == 1]
            counts = np.concatenate([ngram_scoring.unpack_counts(c, n) for c, n in zip(own["sums"], own["n"], strict=True)])
            assert counts.tolist() == [5, 1]
            _, logs = grams.scores(counts)
            assert logs[0] == pytest.approx(3 * math.log(0.4) - math.log(4))  # no other document has the word
            assert len(ngram_scoring.Grams(["twina", "twinb"], partitions).keys) == 3
    finally:
        for w in told:
            del ngram_scoring._hashes[w]


def test_toxicity_learns_and_takes_odd_rows(spark, odd):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(80)]
    texts, labels = [], []
    for i in range(240):
        text = list(rng.choice(words, 50 if i % 8 else 400))
        if i % 2:
            for at in rng.integers(0, len(text), 3):
                text[at] = str(rng.choice(["vilgux", "vilgox", "grawk"])) + str(rng.choice(["", "en", "or"]))
        texts.append(" ".join(text)), labels.append(i % 2)
    network = toxicity.train(texts[:180], np.array(labels[:180]), np.arange(180) % 5)
    scores = toxicity.Reader(network).scores(texts[180:])
    assert ((scores >= 0.3) == np.array(labels[180:])).mean() > 0.9
    # Every window counts, also the last words of a long text.
    assert toxicity.Reader(network).scores([" ".join(words * 40) + " vilguxen grawk"])[0] > toxicity.Reader(network).scores([" ".join(words * 40)])[0]
    assert all(set(range(n)) == {i for s in toxicity.starts(n) for i in range(s, min(s + toxicity.WINDOW, n))} for n in (1, 39, 40, 41, 68, 500))
    told = {(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.judge(odd, network).collect()}
    assert {(0, 0.0, 0), (1, 0.0, 0), (2, 0.0, 0)} <= told
    assert toxicity.accepted(odd, network).columns == odd.columns
    assert toxicity.judge(odd.limit(0), network).count() == 0
    assert {r["score"] for r in toxicity.judge(odd, None).collect()} == {0.0}


def test_gradients_of_the_network():
    net, rng = toxicity.Network(5), np.random.default_rng(5)
    net.p = {n: x.astype(float) for n, x in net.p.items()}
    table, places = rng.standard_normal((4, 6 * toxicity.HIDDEN)) * 0.5, np.array([[0, 1, 2, 3], [3, 1, -1, -1]])
    loss = lambda: float(net.forward(np.concatenate([table, np.zeros((1, table.shape[1]))]), places) @ [1.0, -0.5])
    keep, grad = {}, {n: np.zeros_like(x) for n, x in net.p.items()}
    net.forward(np.concatenate([table, np.zeros((1, table.shape[1]))]), places, keep)
    net.backward(keep, np.array([1.0, -0.5]), grad)
    for name in ("Uf", "Ub", "A", "a", "v", "o"):
        flat, i = net.p[name].reshape(-1), 3
        old, h = flat[i], 1e-2
        flat[i] = old + h
        up = loss()
        flat[i] = old - h
        down = loss()
        flat[i] = old
        assert grad[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * h), abs=2e-3, rel=0.05)


def test_language_models(spark, odd):
    en, fr = "the quick brown fox jumps over the lazy dog and then sleeps", "le renard brun saute par dessus le chien et puis il dort"
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice((en if i % 2 else fr).split(), 40)), "en" if i % 2 else "fr") for i in range(200)]
    models = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = {r["doc_id"]: r for r in language_id.identify(odd, models).collect()}
    assert [told[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and told[0]["score"] == 0 and told[0]["rejected"]
    ask = spark.createDataFrame([(1, "the dog sleeps over the fox", 0), (2, "le chien dort par dessus", 0), (3, "qxzq wjkq zzxq vvqk qqqz", 0), (4, "12 34", 0)], "doc_id long, text string, lang_pred int")
    got = {r["doc_id"]: r for r in language_id.identify(ask, models).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4)] == ["en", "fr", "und"] and got[3]["rejected"] and not got[1]["rejected"]
    assert {r["doc_id"] for r in language_id.accepted(ask, models).collect()} == {1, 2}
    assert language_id.accepted(odd, models).columns == odd.columns
    assert language_id.learn(odd.limit(0)) is None and language_id.identify(odd, None).count() == odd.count()


def test_kneser_ney_chances_sum_to_one():
    models = language_id.Models({"x": (["abba", "abc", "cab", "b"], np.array([3.0, 2.0, 1.0, 5.0]))})
    # After "ab" a letter or the end follows; what is known and what the alphabet has left add up to one.
    total = 0.0
    for letter in "abc":
        total += math.exp(models.words(["ab" + letter])[0, 0] - models.words(["ab" + letter])[0, 0] + _step(models, "ab", letter))
    total += math.exp(_step(models, "ab", " ")) + (language_id.ALPHABET - 4) * math.exp(_step(models, "ab", "q"))
    assert total == pytest.approx(1, abs=1e-3)


def _step(models, before, letter):
    """The log-chance of one letter: that of the word up to it, less that of what is before."""
    letters, place, _ = language_id._spell([before + letter + "z"] if letter != " " else [before])
    upto = len(before) + 1
    logs = _logs(models, letters, place)
    return logs[upto]


def _logs(models, letters, place):
    hashes = language_id._hashes(letters)
    out = []
    for i in range(len(letters)):
        at, found = language_id._lookup(models.grams[1][0], hashes[1][i : i + 1])
        log = models.grams[1][1][at[0], 0] if found[0] else models.unseen[0]
        for n in range(2, language_id.ORDER + 1):
            if place[i] >= n - 1:
                at, found = language_id._lookup(models.grams[n][0], hashes[n][i : i + 1])
                back, known = language_id._lookup(models.back[n][0], hashes[n - 1][i - 1 : i])
                log = models.grams[n][1][at[0], 0] if found[0] else log + (models.back[n][1][back[0], 0] if known[0] else 0)
        out.append(float(log))
    return out


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.packed(odd, path, capacity=64).collect()
    want = collections.Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r["doc_id"], n, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for n, at in enumerate(range(0, len(ids), 64)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(odd.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_supersteps_place_all_and_fill_well(seed):
    rng = np.random.default_rng(seed)
    lengths = collections.Counter(np.clip((rng.pareto(0.8 + seed / 3, 3000) * 30).astype(int) + 1, 1, 1000).tolist())
    placed = packing.Supersteps(dict(lengths), 1000).run()
    used, ranks = collections.Counter(), collections.defaultdict(list)
    for length, first, n, sequence, offset in placed:
        ranks[length] += range(first, first + n)
        for s in range(sequence, sequence + n):
            assert used[s] <= offset or used[s] == offset
            used[s] += length
    assert all(sorted(ranks[k]) == list(range(n)) for k, n in lengths.items()) and max(used.values()) <= 1000
    assert len(used) <= 1.02 * max(math.ceil(sum(k * n for k, n in lengths.items()) / 1000), sum(n for k, n in lengths.items() if k > 500)) + 1


def test_bpe_is_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library, machine = Tokenizer.from_file(path), bpe.transducer(path)
    rng = np.random.default_rng(6)
    texts = [t or "" for t in ODD_TEXTS] + ["".join(map(chr, rng.choice([*range(32, 127), *range(160, 700), 0x4E00, 0x1F600, 10, 9], 300))) for _ in range(40)]
    texts += ["ab" * 20_000, "".join(rng.choice(list("aeinrst"), 30_000)), " " * 5000 + "x", "!?" * 9000]
    for text in texts:
        ids = [i for block in machine.encode(text) for i in block]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert "".join(machine.decode([ids[:7], ids[7:]])) == library.decode(ids, skip_special_tokens=False)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trips(odd, path).collect()}
    for r in odd.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) in got
    back = bpe.decoded(bpe.encoded(odd, path), path)
    assert sorted(r["text"] for r in back.collect()) == sorted((r["text"] or "") for r in odd.collect())
    assert bpe.round_trips(odd.limit(0), path).count() == 0


def test_lookahead_settles_every_boundary():
    path = tokenizer_file("byte_bpe_50k.json")
    machine, rng = bpe.transducer(path), np.random.default_rng(7)
    assert 0 < machine.lookahead < 2000
    for _ in range(60):
        data = "".join(rng.choice(list("aeinrsth "), machine.lookahead + 80)).encode()
        whole = set(np.cumsum([len(machine.bytes_of[i]) for i in machine.merged(data)]).tolist())
        cut = data[: machine.lookahead + int(rng.integers(1, 60))]
        part = np.cumsum([len(machine.bytes_of[i]) for i in machine.merged(cut)])
        settled = len(cut) - machine.lookahead
        assert {x for x in whole if x <= settled} == {int(x) for x in part if x <= settled}
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([(b"ab", b"c"), (b"a", b"b")])


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("group", [simhash.GROUP, 3])
def test_simhash_links(spark, group):
    rng = np.random.default_rng(8)
    codes = {int(x) for x in rng.integers(0, 2**63, 60)}
    for c in list(codes):
        codes |= {c ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (4, 2))}
    codes |= {0, 1, 2**63, 2**64 - 1}
    codes = sorted(codes)
    signed = [(c - 2**64 if c >= 2**63 else c, i) for i, c in enumerate(codes)]
    edges = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame(signed, "fp long, id long"), group).collect()]
    near = [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 2]
    assert set(map(frozenset, edges)) <= set(map(frozenset, near)) or all((codes[a] ^ codes[b]).bit_count() <= 64 for a, b in edges)
    assert least(range(len(codes)), edges) == least(range(len(codes)), near)


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(9)
    codes = np.unique(np.concatenate([rng.integers(0, 2**63, 300).astype(np.uint64), (rng.integers(0, 2**10, 700) << 20).astype(np.uint64)]))
    index = simhash.GrayIndex(codes)
    assert (np.diff(simhash.gray_rank(index.codes).astype(object)) > 0).all()
    got = {(int(i), int(j)) for a, b in index.pairs(2, block=100) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (int(index.codes[i]) ^ int(index.codes[j])).bit_count() <= 2}


def test_simhash_of_odd_rows(spark, odd):
    got = simhash.classes(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == plain_simhash(ODD_TEXTS[r["doc_id"]])
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert component[0] == component[1] == component[2] == 0 and component[7] == 6 and component[None] is None
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    assert ids.count(3) == 1 and 7 not in ids and 0 in ids and 1 not in ids and len({r["text"] for r in rows}) == len(rows)
    assert simhash.classes(odd.limit(0)).count() == 0 and simhash.one_of_each(odd.limit(0)).count() == 0


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


LONG = "This is a sentence that is long enough to be the text of an article. "


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        (page("<nav><ul><li><a href='/a'>A</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy this now, it is very good.</div><article><h1>Head &amp; so</h1><p><b>" + LONG + "<br><p>Two\n  words &eacute;&#233;</p></article><footer>&copy; me</footer>"), "Head & so\n" + LONG.strip() + "\nTwo words éé"),
        (page(f"<div class='sidebar'>{LONG}</div><div id=main><p>{LONG}</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div><form>{LONG}</form>"), LONG.strip() + "\n" + LONG.strip()),
        (page("<article><p>Short.</p></article>"), "Short."),
        ("no markup at all &lt;b&gt;", "no markup at all <b>"),
        ("<article><p>a &am b &amp c</article>", "a &am b & c"),
        ("<p unclosed=\"", "<p unclosed=\""),
    ],
)
def test_html_text(html, want):
    assert html_text.main_text(html or "") == want


TEASER = "<article><h3><a href='/next'>Next one</a></h3><p>Read on.</p></article>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # Main text in plain divs and a teaser in an article, after or before it.
        (page(f"<div><p>{LONG}</p><p>And so on.</p><p>{LONG}</p></div>{TEASER}"), f"{LONG.strip()}\nAnd so on.\n{LONG.strip()}"),
        (page(f"{TEASER}<div><p>{LONG}</p><p>{LONG}</p></div>"), f"{LONG.strip()}\n{LONG.strip()}"),
        # Text outside the article surges by itself; short lines do not.
        (page(f"<article><p>{LONG}</p><p>{LONG}</p></article><div></div><div><p>{LONG}</p></div><div></div><div></div><p>Bye.</p>"), "\n".join([LONG.strip()] * 3)),
        # A headline that is a link weighs by the tag alone.
        (page(f"<article><h1><a href='/a'>Head</a></h1><p>{LONG}</p></article>"), f"Head\n{LONG.strip()}"),
        # No article at all: a menu of links dives.
        (page(f"<p>{LONG}</p><div></div><ul><li><a href='/a'>{LONG}</a></li><li><a href='/b'>{LONG}</a></li></ul>"), LONG.strip()),
    ],
)
def test_html_lines_decide_beside_an_article(html, want):
    assert html_text.main_text(html) == want


def test_html_text_of_rows(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}{html_module.escape('<x>')}</p></article>"), "t"), (1, None, None, "t"), (None, "u", "", "t")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(1, LONG + "<x>", len(LONG) + 3), (1, "", 0), (None, "", 0)]


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.example.net", "/en/x", "block"), ("NET", "/", "block"), ("com", "/de/", "block"), ("a-b.com", "/", "allow"), (None, "/", "block"), ("x.net", None, "allow")]
    urls = [None, "", "net", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/1?q#f", "http://b.example.net/en/x1", "http://b.example.net/en/", "http://xexample.net/en/", "http://a.com/de/?x", "http://a-b.com/de/", "http://a-b.com", "http://q.x.net#f", "http://a..net/", "ftp://net?x/en/", "http://net/", "x://y://net/", "http://a\n.net/p\nq"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[4]])], "id long, url string, host string")
    got = {r["id"]: r for r in url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate([*urls, urls[4]]):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [((len(h + (p or "")), len(h)), h.lower() + (p or ""), v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u
    assert url_rules.judge(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_fingerprints(spark, odd):
    paragraphs = ["one two three four", "five six", "seven eight nine ten eleven twelve thirteen fourteen fifteen"]
    whole = fingerprints.of_text("\n".join(paragraphs))
    assert whole.text() == fingerprints.of_text("\n".join(reversed(paragraphs))).text()
    assert whole.copy().add(["new one"]).add(["new one"], -1).text() == whole.text() != fingerprints.of_text(paragraphs[0]).text()
    text = "\n".join(paragraphs)
    for kept in range(len(text) + 1):
        assert fingerprints.of_edit(whole, text, kept, "tail\nx").text() == fingerprints.of_text(text[:kept] + "tail\nx").text()
    rows = fingerprints.fingerprints(odd).collect()
    order = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (doc, text) in enumerate(order):
        after, cut = order[(i + 1) % len(order)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.of_text(text).text(), fingerprints.of_text(edited).text()))
    key = lambda r: (str(r[0]), r[2])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in rows), key=key) == sorted(want, key=key)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.fingerprints(odd.limit(0)).count() == 0


def test_next_in_order_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    rng = np.random.default_rng(10)
    rows = [(int(i), f"t{k}") for k, i in enumerate(rng.integers(-50, 10**12, 200))] + [(5, "a"), (5, "b"), (5, "b"), (None, "n"), (None, "m")]
    got = fingerprints.next_in_order(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", "after").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = collections.Counter((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order))
    assert collections.Counter((r["doc_id"], r["text"], r["after"]) for r in got) == want
