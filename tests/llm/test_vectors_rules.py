"""Operators 11 to 13 against brute-force versions; nulls, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.llm import codebooks, queries, rules, whitening
from chatlake.llm.common import table

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(spark, rows=90, width=16, seed=5):
    """Rows with nulls, non-finite and missing components, another length, copies, repeated and null ids."""
    r = random.Random(seed)
    vector = lambda: [r.choice([r.gauss(0, 0.2), 0.25, -0.0]) for _ in range(width)]
    out = [(k * 3 % 101, vector(), r.choice([0, 1, None])) for k in range(rows)]
    out += [(200 + k, out[4][1], 2) for k in range(30)] + [out[7], (None, vector(), 1), (7, None, 0), (8, [], 0), (9, [float("nan")] * width, 0),
                                                          (10, [float("inf")] + [0.0] * (width - 1), 0), (11, [None] + [0.5] * (width - 1), 0), (12, [0.5] * 3, 0)]
    return spark.createDataFrame(out, VECTORS).repartition(3)


def kept(df, scale):
    rows = [x for x in df.collect() if x.embedding and len(x.embedding) == 16 and all(v is not None and np.isfinite(v) for v in x.embedding)]
    rows.sort(key=lambda x: (x.vec_id is None, x.vec_id or 0, x.embedding))
    return rows, np.floor(scale * np.array([x.embedding for x in rows], dtype=np.float64)).astype(np.int64)


# -- 11 -----------------------------------------------------------------------------------------

def test_dual_tree_assignment_is_exact():
    r = np.random.default_rng(1)
    whole = 0
    for trial in range(150):
        n, w, k = int(r.integers(1, 500)), int(r.integers(1, 6)), int(r.integers(1, 20))
        x = r.integers(-int(r.integers(1, 60)), 60, (n, w))
        if trial % 3 == 0:
            x[:n // 2] = x[0]
        e = r.integers(-50, 50, (k, w)) if trial % 2 else x[r.integers(0, n, k)]
        levels = codebooks.levels_of(n, codebooks.LEAF_ROWS)
        x = x[codebooks.sorted_order(x, levels)]
        got, want = codebooks.assign(codebooks.Tree.over(x, levels), e), ((x[:, None] - e[None]) ** 2).sum(axis=2).argmin(axis=1)
        sums = np.zeros((k, w), np.int64)
        np.add.at(sums, want, x)
        assert (got.entry == want).all() and (got.sums == sums).all() and (got.counts == np.bincount(want, minlength=k)).all()
        whole += got.whole
    assert whole > 0


def test_whole_nodes_take_their_cached_sum():
    x = np.repeat(np.array([[0, 0], [1000, 1000]]), 512, axis=0)
    got = codebooks.assign(codebooks.Tree.over(x, 6), np.array([[900, 900], [1, 1], [1, 1]]))
    assert got.whole == 512 and got.counts.tolist() == [512, 512, 0]  # the tie of equal entries is settled in the leaves


def lloyd(x, entries, parts, rounds):
    p = x.reshape(len(x), parts, -1).transpose(1, 0, 2)
    books = p[:, :entries].copy()
    nearest = lambda: np.stack([((p[k][:, None] - books[k][None]) ** 2).sum(axis=2).argmin(axis=1) for k in range(parts)])
    for _ in range(rounds):
        at = nearest()
        for k, e in itertools.product(range(parts), range(books.shape[1])):
            if (at[k] == e).any():
                books[k, e] = p[k][at[k] == e].sum(axis=0) // (at[k] == e).sum()
    at = nearest()
    return books, at, sum(((p[k] - books[k][at[k]]) ** 2).sum(axis=1) for k in range(parts))


@pytest.mark.parametrize("entries", [16, 5, 500])
def test_codes(spark, entries):
    df = odd_vectors(spark).select("*", *[F.lit("z").alias(c) for c in ("x", "code", "error", "of", "share", "part")])
    rows, x = kept(df, 4096)
    if entries > 256:
        with pytest.raises(ValueError):
            codebooks.compress(df, entries=entries)
        return
    books, at, error = lloyd(x, entries, 8, 6)
    total = collections.Counter()
    for r, e in zip(rows, error):
        total[r.label] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    want = [(r.vec_id, "".join(f"{v:02x}" for v in at[:, i]), int(error[i]), total[r.label], digest) for i, r in enumerate(rows)]
    assert collections.Counter(map(tuple, codebooks.compress(df, entries=entries).collect())) == collections.Counter(want)


def test_codes_of_small_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert codebooks.compress(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and codebooks.compress(none).count() == 0
    assert codebooks.compress(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    one = codebooks.compress(spark.createDataFrame([(1, [0.5] * 8, None)], VECTORS)).first()
    assert (one.code, one.error, one.label_error) == ("00" * 8, 0, 0)
    with pytest.raises(ValueError):
        codebooks.compress(spark.createDataFrame([(1, [0.5] * 9, None)], VECTORS)).count()


def test_many_labels_meet_by_shares(spark):
    coded = spark.createDataFrame([(k, k % 7 if k % 3 else None, "00", k) for k in range(400)], "vec_id long, label int, code string, error long")
    both = [codebooks.with_label_errors(coded, sent=sent, shares=4) for sent in (100, 0)]
    assert both[1].count() == 400 and both[0].exceptAll(both[1]).count() == 0
    assert "SortMergeJoin" in both[1]._jdf.queryExecution().executedPlan().toString()


# -- 12 -----------------------------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def odd_texts(n=300):
    r = random.Random(3)
    pieces = ["a ", "b ", "ab\n", "é", "日本 ", "a b\n", "#|\t", "\x0b", "\r\n", "\n", "x\x85 ", "\x1c"]
    return [None, "", " \n", "a", "a " * 20, "w" * 70_000 + " tail", "one two three four five six seven eight " * 40] + \
        ["".join(r.choice(pieces) for _ in range(r.randint(0, 250))) for _ in range(n)]


def test_statistics_equal_brute_force():
    counts, x = rules.statistics(pa.array(odd_texts()))
    assert counts.tolist() == [brute_counts(t) for t in odd_texts()]
    assert x.shape[1] == len(rules.FEATURES) and np.isfinite(x).all()


def test_trees_are_flat_monotone_and_learn():
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(1500, 4)), 2)
    good = (x[:, 0] - np.abs(x[:, 1]) + r.normal(scale=0.3, size=1500) > -0.7) ^ (r.random(1500) < 0.05)
    free = rules.fit_trees(x, good, np.zeros(4, int))
    held = rules.fit_trees(x, good, np.array([1, 0, -1, 1]))
    for m in (free, held):
        assert ((m.score(x) > 0.5) == good).mean() > 0.85
        for k in range(0, 1500, 97):  # node by node, one text at a time
            odds = m.base
            for node in m.roots:
                while m.left[node] != node:
                    node = m.left[node] if x[k, m.feature[node]] <= m.threshold[node] else m.right[node]
                odds += m.value[node]
            assert np.isclose(m.log_odds(x[k:k + 1])[0], odds)
    steps = np.linspace(-4, 4, 200)
    for f, way in ((0, 1), (2, -1), (3, 1)):
        for k in range(0, 1500, 50):
            probe = np.repeat(x[k:k + 1], len(steps), axis=0)
            probe[:, f] = steps
            assert (way * np.diff(held.log_odds(probe)) >= -1e-12).all()
    assert (np.diff(free.log_odds(np.stack([np.zeros(200), steps, np.zeros(200), np.zeros(200)], axis=1))) < -1e-9).any()


def test_best_split_equals_search_over_all():
    r = np.random.default_rng(4)
    for way in (0, 1, -1):
        place, slope, bend = r.integers(0, 6, (60, 3)), r.normal(size=60), r.random(60) + 0.1
        found, best = rules.best_split(place, slope, bend, np.full(3, way), -np.inf, np.inf, 6, 5, 1.0), (1e-9, None)
        for f, b in itertools.product(range(3), range(5)):
            left = place[:, f] <= b
            if min(left.sum(), (~left).sum()) < 5:
                continue
            half = [(slope[s].sum(), bend[s].sum()) for s in (left, ~left)]
            one, other = (-g / (h + 1) for g, h in half)
            gain = sum(g * g / (h + 1) for g, h in half) / 2 - slope.sum() ** 2 / (bend.sum() + 1) / 2
            if way * (other - one) >= 0 and gain > best[0] + 1e-12:
                best = (gain, (f, b))
        assert (found and found[:2]) == best[1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rules_on_odd_tables(spark):
    rows = [(k, t, "en", "s", None) for k, t in enumerate(odd_texts(80))] + [(None, "null id", None, None, None), (5, "w", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit("z").alias(c) for c in ("good", "x", "score", "kept")])
    good = spark.createDataFrame([(k, k % 2 == 0) for k in range(40)] + [(None, True), (3, None)], "doc_id long, good boolean")
    empty = spark.createDataFrame([], SCHEMA)
    for model in (rules.train(docs, good), rules.train(empty, good), rules.train(docs, good.limit(0))):
        got = sorted(map(tuple, rules.judge(docs, model).collect()), key=repr)
        want = sorted(((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t, *_ in rows for c in [brute_counts(t)]), key=repr)
        assert [g[:7] for g in got] == want and all(g[7] == (not g[6] and g[8] >= model.cut) for g in got)
        assert rules.keep_ruled(docs, model).count() == sum(g[7] for g in got)
        assert rules.judge(empty, model).count() == 0
    assert not len(rules.train(docs, good.limit(0)).roots)


def test_the_fit_is_bounded_after_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 3, "one two three four " * 4 + " ".join(f"w{k}x{j}" for j in range(9)), "en", "s", 1) for k in range(300)], SCHEMA)
    seen = []
    monkeypatch.setattr(rules, "fit_trees", lambda x, good, monotone: seen.append(len(x)) or rules.Trees(*[np.zeros(0)] * 6, 4, 0.0))
    rules.train(docs, spark.createDataFrame([(k, k > 0) for k in (0, 1, 2)], "doc_id long, good boolean"), rows=20)
    assert seen and seen[0] <= 20


def test_rules_judge_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    known = labels.select("doc_id", (F.col("quality") == 1).alias("good"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = rules.judge(docs, rules.train(docs, known.filter(~fold))).join(known.filter(fold), "doc_id").filter("not base_failed").collect()
    assert sum(r.kept for r in rows if r.good) >= 0.97 * sum(r.good for r in rows)
    assert sum(r.kept for r in rows if not r.good) <= 0.2 * sum(not r.good for r in rows)


# -- 13 -----------------------------------------------------------------------------------------

def whiten_brute(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, s, e[::-1], q[:, ::-1]


def test_whitening(spark):
    df = odd_vectors(spark).select("*", *[F.lit("z").alias(c) for c in ("x", "n", "rows", "data", "at", "component")])
    rows, x = kept(df, 256)
    n, s, e, q = whiten_brute(x)
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * len(rows) and {g.n for g in got} == {n} and {g.component for g in got} == {1, 2, 3, 4}
    assert max(abs(g.explained - e[g.component - 1] / e.sum()) for g in got) < 1e-12 and {g.identity_error for g in got} == {got[0].identity_error}
    assert got[0].identity_error < 1e-10
    want = collections.Counter((r.vec_id, int(((n * v - s) ** 2).sum())) for r, v in zip(rows, x))
    assert collections.Counter((g.vec_id, int(g.deviation)) for g in got if g.component == 1) == want
    for k in range(4):
        mine = sorted(((g.vec_id is None, g.vec_id or 0, int(g.deviation)), g.whitened) for g in got if g.component == k + 1)
        other = sorted(((r.vec_id is None, r.vec_id or 0, int(((n * v - s) ** 2).sum())), float((v - s / n) @ q[:, k] / e[k] ** 0.5)) for r, v in zip(rows, x))
        a, b = np.array([m[1] for m in mine]), np.array([o[1] for o in other])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_whitening_of_small_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none).columns[0] == "vec_id"
    assert whitening.whiten(spark.createDataFrame([(k, [0.5, 0.25], 1) for k in range(5)], VECTORS)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(k, [k / 256, 2 * k / 256, 0.0], 1) for k in (0, 1, 5)], VECTORS)).collect()
    assert len(line) == 3 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


@pytest.mark.parametrize("spectrum", [np.ones(40), np.r_[5, 5, 5, 5, 5, np.ones(35)], np.r_[1e9, 3, 2, 1, np.zeros(60)], 0.9 ** np.arange(70),
                                      1 + 1e-3 * np.arange(64), np.r_[2.0, np.zeros(9)], np.r_[np.full(50, 1.0), np.full(50, 0.999999)]])
def test_leading_vectors(spectrum):
    width = len(spectrum)
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(width, width)))[0]
    v = (turn * spectrum) @ turn.T
    values, q, worst = whitening.leading(lambda b: v @ b, width, 4)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], atol=1e-9 * spectrum.max())
    assert np.allclose(q.T @ q, np.eye(4), atol=1e-12) and np.abs(v @ q - q * values).max() <= 1e-9 * spectrum.max() and worst < 1e-10


def test_deviations_are_exact():
    x = np.random.default_rng(0).integers(-300, 300, (40, 8))
    for k, n, s in ((1, 10, [1] * 8), (1, 10**6, list(range(-4 * 10**9, 4 * 10**9, 10**9))), (1, 10**9, [-10**12] * 8), (10**12, 5, [3] * 8)):
        want = [sum((n * int(v) - t) ** 2 for v, t in zip(r, s)) for r in x * k]
        assert [int(v) for v in whitening.deviations(x * k, n, s).to_pylist()] == want


def test_new_queries_over_the_tables(spark):
    n = table(spark, SF, "embeddings").count()
    assert queries.op11_codes(spark, SF).count() == n and queries.op13_whitening(spark, SF).count() == 4 * n
    assert queries.op12_rules(spark, SF).count() == table(spark, SF, "documents").count()
    assert dict(queries.op13_whitening(spark, SF).dtypes)["deviation"] == "bigint"
