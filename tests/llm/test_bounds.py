"""Bounds of what is gathered, hot keys, long words, columns of any type, and brute-force versions of fits and matches."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chatlake.llm import common, decontam, langid, lattice, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def test_quality_fit_is_bounded_after_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 3, f"word{k} " * 5 + " ".join(f"x{j}" for j in range(k % 50)), "en", "s", 1) for k in range(900)], SCHEMA)
    graded = spark.createDataFrame([(k, k % 3) for k in (0, 1, 2)], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(quality, "fit_ordinal", lambda feature, at, grade, grades: seen.append((len(grade), int(np.diff(at).max()))) or quality.OrdinalModel(np.zeros(quality.WIDTH, np.float32), np.zeros(2)))
    quality.train(docs, graded, rows=16, features_each=12)
    assert len(seen) == 1 and 0 < seen[0][0] <= 20 and seen[0][1] <= 12


def test_ordinal_fit_reaches_the_plain_optimum():
    r = np.random.default_rng(3)
    rows, width, grades, ridge = 400, 6, 3, 3e-2
    x = r.random((rows, width)) < 0.4
    score = x @ np.array([2.0, -2, 1, 0, 0, 0.5]) + r.logistic(size=rows)
    grade = (score > 0).astype(int) + (score > 1.5)
    feature, at = np.nonzero(x)[1].astype(np.int32), np.append(0, np.cumsum(x.sum(axis=1)))

    def loss(w, cut):
        below = 1 / (1 + np.exp(-(np.r_[-np.inf, np.sort(cut), np.inf] - (x @ w)[:, None])))
        with np.errstate(divide="ignore"):
            return -np.log(below[np.arange(rows), grade + 1] - below[np.arange(rows), grade]).mean() + ridge * (w @ w) / 2

    model = quality.fit_ordinal(feature, at, grade, grades, steps=3000, ridge=ridge)
    w, cut = model.weights[:width].astype(float), model.thresholds
    p, best = np.r_[np.zeros(width), -1, 1], np.inf
    for step in (1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001):  # plain search along each axis
        for _ in range(40):
            for k, way in itertools.product(range(len(p)), (-step, step)):
                q = p.copy()
                q[k] += way
                if (now := loss(q[:width], q[width:])) < best:
                    p, best = q, now
    assert loss(w, cut) <= best + 2e-4


def test_keep_one_with_maps_and_ties(spark):
    text = "one two three four five six"
    rows = [(5, text, {"a": 1}), (3, text, {"z": 1}), (3, text, {"b": 2}), (None, text, None), (7, "other words stand here now", {}), (None, None, {"q": 1}), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>").repartition(3)
    got = sorted((r.doc_id, r.tags) for r in simhash.keep_one(docs).collect())
    assert got == [(3, {"b": 2}), (7, {}), (9, None)]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_cells_hold_every_pair_of_a_hot_key(spark):
    rows = [(7, k) for k in range(90)] + [(k % 5, 1000 + k) for k in range(12)] + [(99, 5000)]
    postings = spark.createDataFrame(rows, "key long, fp long").repartition(4)
    pairs = set()
    for group in spark.createDataFrame(common.in_cells(postings, "key", "fp", 16).collect(), "key long, fp long, cell long").groupBy("key", "cell").agg(F.collect_list("fp").alias("f")).collect():
        assert len(group.f) <= 40
        pairs |= {(group.key, a, b) for a, b in itertools.combinations(sorted(group.f), 2)}
    want = {(k, a, b) for k in {r[0] for r in rows} for a, b in itertools.combinations(sorted(f for q, f in rows if q == k), 2)}
    assert pairs == want


def test_language_sample_is_the_least_hashes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}", ["en", "de"][k % 3 == 0], "s", 1) for k in range(600)], SCHEMA)
    taken = []
    monkeypatch.setattr(langid, "_trees", lambda picked: taken.append({(r.lang, r.doc_id) for r in picked.collect()}))
    langid.train(docs, sample=50)
    hashed = docs.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).collect()
    want = set()
    for lang in ("en", "de"):
        want |= {(lang, r.doc_id) for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: (r.h, r.doc_id))[:50]}
    assert taken == [want]


# -- benchmark passages -------------------------------------------------------------------------

def brute_matches(docs, items, least):
    """Every diagonal of every pair: the windows of 13 words with at most 2 unequal ones, or whole shorter texts."""
    out = {}
    for (d, t), (i, b) in itertools.product(docs, items):
        a, b, best = t.lower().split(), b.lower().split(), None
        if len(b) < least:
            continue
        size, allowed = min(13, len(b)), 2 if len(b) >= 13 else 0
        for shift in range(-len(b), len(a) + 1):
            places = [k for k in range(len(b)) if 0 <= k + shift < len(a)]
            same = {k: a[k + shift] == b[k] for k in places}
            cover = set()
            for k in places:
                window = range(k, k + size)
                if all(j in same for j in window) and sum(not same[j] for j in window) <= allowed:
                    cover |= set(window)
            if cover:
                row = (sum(same[k] for k in cover), len(cover), len(b))
                best = max(best or row, row)
        if best:
            out[d, i] = best
    return out


def test_matches_equal_all_windows(spark):
    r = random.Random(9)
    word = lambda: r.choice(["oak", "elm", "fir", "ash", "yew", "box", "bay", "fig"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 4, 5, 8, 12, 13, 14, 20, 30])]
    docs = []
    for k in range(40):
        _, source = r.choice(items)
        part = source.split()
        part = part[r.randint(0, max(0, len(part) - 14)):]
        for _ in range(r.randint(0, 3)):
            part[r.randrange(len(part))] = "new"
        docs.append((k, " ".join([*(f"a{k}x{j}" for j in range(r.randint(0, 9))), *part, *(f"b{k}x{j}" for j in range(r.randint(0, 9)))])))
    docs += [(100, "yes"), (101, items[9][1] + " gap " + items[9][1]), (102, "")]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for least in (1, 5):
        got = {(x.doc_id, x.item_id): (x.n_equal, x.n_span, x.n_item) for x in decontam.contaminated(left, right, least).collect()}
        assert got == brute_matches(docs, items, least)
    one = spark.createDataFrame([(1, "yes")], "item_id long, text string")
    assert decontam.keep_clean(left, one).count() == len(docs) and decontam.keep_clean(left, one, least=1).count() == len(docs) - 1


def test_the_counts_of_a_match_are_of_one_diagonal(spark):
    a = " ".join(f"w{k}" for k in range(14))
    words = a.split()
    # One diagonal has 14 words, two of them unequal; the other, at the text's end, 13 words, all equal.
    text = " ".join(w if k not in (3, 9) else "x" for k, w in enumerate(words)) + " gap gap gap " + " ".join(words[:13])
    got = decontam.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, a)], "item_id long, text string")).first()
    assert (got.n_equal, got.n_span) == (13, 13)


# -- lattice ------------------------------------------------------------------------------------

def plain_forward(known, word, logs):
    index = {p: k for k, p in enumerate(known.text)}
    word = b" " + word
    alpha = [0.0] + [-np.inf] * len(word)
    for e in range(1, len(word) + 1):
        ways = [alpha[e - n] + logs[index[word[e - n:e]]] for n in known.lengths if n <= e and word[e - n:e] in index]
        alpha[e] = np.logaddexp.reduce(ways) if ways else -np.inf
    return alpha


def plain_expected(known, word, logs):
    index = {p: k for k, p in enumerate(known.text)}
    alpha, word = plain_forward(known, word, logs), b" " + word
    beta = [-np.inf] * len(word) + [0.0]
    for s in range(len(word) - 1, -1, -1):
        ways = [logs[index[word[s:s + n]]] + beta[s + n] for n in known.lengths if s + n <= len(word) and word[s:s + n] in index]
        beta[s] = np.logaddexp.reduce(ways) if ways else -np.inf
    count = np.zeros(len(logs))
    for s in range(len(word)):
        for n in known.lengths:
            if s + n <= len(word) and word[s:s + n] in index:
                k = index[word[s:s + n]]
                count[k] += np.exp(alpha[s] + logs[k] + beta[s + n] - alpha[-1])
    return count


@pytest.mark.parametrize("size", [1, 31, 32, 33, 700, 2500])
def test_long_words_equal_the_plain_recursion(size):
    r = random.Random(size)
    known = lattice.pieces(VOCABULARY)
    logs = np.log(known.prior)
    word = "".join(r.choice(["the", "ing", "日本", "a", "é", "xyz"]) for _ in range(size)).encode()[:size]
    long = lattice.LongWord(known, word, stretch=32, run=512)
    assert np.isclose(long.total(logs), plain_forward(known, word, logs)[-1], rtol=1e-9)
    assert np.allclose(long.expected(logs, 2.0), 2 * plain_expected(known, word, logs), atol=1e-7)
    assert np.allclose(lattice.totals(known, [word, b"x", word], logs), [plain_forward(known, w, logs)[-1] for w in (word, b"x", word)])


def test_document_scores_equal_the_plain_model(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["the", "river", "runs", "unbelievably", "日本語", "q" * 40, "zz9", "longword" * 140]) for _ in range(r.randint(0, 12))) for _ in range(30)] + [None, "", "The RIVER"]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    learned = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    known = lattice.pieces(VOCABULARY)
    counts: dict[bytes, int] = {}
    ends = 0
    for k, t in enumerate(texts):
        if learned(k):
            ends += 1
            for w in (t or "").encode().lower().split():
                counts[w] = counts.get(w, 0) + 1
    whole = lattice.PRIOR_PIECES + ends + 1
    logs = np.log(lattice.PRIOR_PIECES * known.prior / whole)
    for _ in range(lattice.ROUNDS):
        weight = lattice.PRIOR_PIECES * known.prior + sum(c * plain_expected(known, w, logs) for w, c in counts.items())
        whole = weight.sum() + ends + 1
        logs = np.log(weight / whole)
    end = np.log((ends + 1) / whole)
    got = {x.doc_id: x.score for x in lattice.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, VOCABULARY).collect()}
    for k, t in enumerate(texts):
        want = (sum(plain_forward(known, w, logs)[-1] for w in (t or "").encode().lower().split()) + end) / np.log(10)
        assert np.isclose(got[k], want, rtol=1e-9)


# -- hosts --------------------------------------------------------------------------------------

def test_beta_chances_equal_the_integral():
    from chatlake.llm import urls
    a, b = np.array([1.0, 0.5, 2.5, 30.0, 400.0, 0.3, 3.0, 900.0]), np.array([1.0, 0.5, 7.0, 29.0, 420.0, 5.0, 0.4, 1.0])
    x = (np.arange(400_000) + 0.5) / 400_000
    for limit in (0.5, 0.2, 0.9):
        got = urls.chance_below(a, b, limit)
        for p, q, g in zip(a, b, got):
            t = x ** 8  # evens out the ends, where the density may be infinite
            density = lambda u, p=p, q=q: np.exp((p - 1) * np.log(u) + (q - 1) * np.log1p(-u))
            low = (density(limit / 2 * t) * limit / 2 * 8 * x ** 7).sum() + (density(limit - limit / 2 * t) * limit / 2 * 8 * x ** 7).sum()
            rest = 1 - limit
            high = (density(limit + rest / 2 * t) * rest / 2 * 8 * x ** 7).sum()
            u = rest / 2 * t
            high += (np.exp((p - 1) * np.log1p(-u) + (q - 1) * np.log(u)) * rest / 2 * 8 * x ** 7).sum()
            assert np.isclose(g, low / (low + high), atol=2e-5)
    assert len(urls.chance_below(np.zeros(0), np.zeros(0), 0.5)) == 0


def test_domains_of_odd_hosts(spark):
    from chatlake.llm import urls
    got = {r.host: (r.domain, r.suffix) for r in urls.with_domain(spark.createDataFrame([(h,) for h in ("bad.com.", "user@bad.com:80", "a:b@w.bad.co.uk.:8080", "@", ".")], "host string")).collect()}
    assert got["bad.com."] == got["user@bad.com:80"] == ("bad.com", "com") and got["a:b@w.bad.co.uk.:8080"] == ("bad.co.uk", "co.uk") and got["@"] == got["."] == ("", "")
