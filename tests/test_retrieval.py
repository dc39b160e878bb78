"""Similarity, word and substring search against all-pairs versions, with blocks so small that every key has many cells."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from chatlake.operators import conversations as conv
from chatlake.operators import examples as exm
from chatlake.operators import retrieval as rt
from chatlake.operators.substring import substring_join

QUERY = "owner_id string, query_id long, q_embedding array<float>"
MEMORY = "owner_id string, mem_id long, embedding array<float>, recency double"


def vectors(n, seed, width=5):
    r = random.Random(seed)
    out = [[r.choice([r.gauss(0, 1), 0.5]) for _ in range(width)] for _ in range(n)]
    return out + [out[0]] * 15 + [[0.0] * width, [None] + [1.0] * (width - 1), [float("nan")] * width]


def brute_topk(queries, memories, k, w):
    def score(q, m, rec):
        if len(q) != len(m):
            return None
        if None in q or None in m:
            return -math.inf
        dot, size = sum(a * b for a, b in zip(q, m)), math.sqrt(sum(a * a for a in q)) * math.sqrt(sum(b * b for b in m))
        return -math.inf if not size > 0 else (1 - w) * dot / size + w * rec

    out = {}
    for owner, query, q in queries:
        rows = [(-s, mid) for o, mid, m, rec in memories if o == owner and q and m and (s := score(q, m, rec)) is not None]
        for rank, (s, mid) in enumerate(sorted(rows)[:k], 1):
            out[owner, query, rank] = (mid, round(-s, 6) if s < math.inf else -s)
    return out


@pytest.mark.parametrize("w", [0.0, 0.15])
@pytest.mark.parametrize("block", [200, 1 << 20])
def test_topk_equals_all_pairs(spark, monkeypatch, w, block):
    monkeypatch.setattr(rt, "TILE", (7, 11))
    f32 = lambda v: spark.createDataFrame([(v,)], "v array<float>").first().v if v else v
    rows = [f32(v) for v in vectors(60, 1)]
    queries = [("hot", k, v) for k, v in enumerate(rows[:40] + rows[-3:])] + [("b", 900, rows[3]), ("b", 901, None), ("b", 902, []), ("none", 7, rows[1]), ("b", 903, rows[4][:3])]
    r = random.Random(2)
    memories = [("hot", 500 - k, v, r.choice([0.0, 0.5, 1.0])) for k, v in enumerate(rows)] + [("b", k, v, 0.0) for k, v in enumerate(rows[:4])] + [("b", 77, None, 0.0), ("b", 78, rows[4][:3], 1.0)]
    got = rt.similarity_topk(spark.createDataFrame(queries, QUERY), spark.createDataFrame(memories, MEMORY), k=4, recency_weight=w, query_bytes=block, memory_bytes=block)
    got = {(x.owner_id, x.query_id, x.rank): (x.mem_id, round(x.score, 6) if x.score > -math.inf else x.score) for x in got.collect()}
    assert got == brute_topk(queries, memories, 4, w)


def test_topk_plan_has_no_driver_list_and_many_cells(spark):
    rows = spark.range(400).select(F.lit("o").alias("owner_id"), F.col("id").alias("query_id"), F.array(*[F.rand(k).cast("float") for k in range(8)]).alias("q_embedding"))
    mem = rows.select("owner_id", F.col("query_id").alias("mem_id"), F.col("q_embedding").alias("embedding"))
    top = rt.similarity_topk(rows, mem, 3, query_bytes=4000, memory_bytes=4000)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInPandas" not in plan and "Cross" not in plan
    assert top.count() == 1200
    same = top.filter("rank = 1 and query_id = mem_id").count()
    assert same == 400


def test_selections_and_text(spark):
    said = [("o", 1, "1. yes\n3. too"), ("o", 2, "2. but the first is NOT relevant"), ("o", 3, None), ("o", 4, "12. x"), ("o", 5, "")]
    got = rt.parse_selections(spark.createDataFrame(said, "owner_id string, query_id long, text string"))
    assert sorted((r.query_id, r.rank) for r in got.collect()) == [(1, 1), (1, 3), (4, 2)]
    hits = spark.createDataFrame([("o", 1, 3, 1, 0, 0, 5), ("o", 1, 1, 1, 1, 1, 6), ("o", 1, 2, 1, 1, 0, 5), ("o", 1, 3, 2, 0, 0, 7)],
                                 "owner_id string, query_id long, level int, r3 int, r2 int, r1 int, mem_id long")
    mem = spark.createDataFrame([("o", 5, "2024-01-01", "five"), ("o", 6, None, "six"), ("o", 7, "x", None)], "owner_id string, mem_id long, ts_text string, attribute string")
    row = rt.drill_text(hits, mem).first()
    assert row.memory_text == "1. [2024-01-01] five\n2. [x] \n3. [2024-01-01] five\n4. [Unknown date] six" and row.n_lines == 4


def test_substring_join_equals_contains(spark):
    r = random.Random(4)
    letters = ["a", "b", "ab", "é", "日本", " ", "x"]
    word = lambda n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    texts = [(k, r.choice(["p", "q", None]), word(60)) for k in range(120)] + [(1, "p", "repeated key"), (None, "q", "ab" * 50), (5, "q", None), (6, "p", "a" * 3000 + "needle in hay")]
    phrases = [(k, r.choice(["p", "q", None]), word(12)) for k in range(80)] + [(900, "p", "needle in"), (901, "p", ""), (902, "p", None), (903, "q", "abababababab"), (900, "p", "needle in"), (904, "p", "not there at all")]
    left = spark.createDataFrame(texts, "doc long, owner string, text string").repartition(3)
    right = spark.createDataFrame(phrases, "pid long, owner string, phrase string")
    got = substring_join(left, right.select("pid", "phrase"), "text", "phrase")
    want = collections.Counter((d, o, t, p, ph) for d, o, t in texts for p, _, ph in phrases if t is not None and ph and ph in t)
    assert collections.Counter(map(tuple, got.collect())) == want
    got = substring_join(left, right, "text", "phrase", on=["owner"])
    want = collections.Counter((d, o, t, p, ph) for d, o, t in texts for p, own, ph in phrases if t is not None and ph and ph in t and own == o)
    assert got.columns == ["doc", "owner", "text", "pid", "phrase"] and collections.Counter(map(tuple, got.collect())) == want
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        assert substring_join(a, b.select("pid", "phrase"), "text", "phrase").count() == 0
    with pytest.raises(ValueError):
        substring_join(left, right, "text", "phrase")


def test_phrase_search_reports_fields_and_context(spark):
    texts = spark.createDataFrame([(1, "Hello WORLD" + "." * 120, "world"), (2, None, "nothing")], "k long, input string, output string")
    phrases = spark.createDataFrame([(10, "World"), (11, "absent"), (12, "")], "phrase_id long, phrase string")
    got = exm.phrase_search(texts, phrases, ["k"]).collect()
    assert sorted((r.k, r.phrase_id, r.field, r.context, r.phrase) for r in got) == [(1, 10, "input", "." * 100, "World"), (1, 10, "output", "world", "World")]


@pytest.mark.parametrize("words", [3, 1 << 20])
def test_keyword_search_equals_all_pairs(spark, words):
    r = random.Random(6)
    vocabulary = ["the", "he", "cat", "catalogue", "a", "dog", "It's", "ÉTÉ", "x1"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(r.randint(0, n)))
    queries = [(r.choice("op"), k, text(5)) for k in range(30)] + [("o", 99, None), ("p", 98, "  "), ("z", 97, "cat")]
    memories = [(r.choice("op"), k, text(6)) for k in range(60)] + [("o", 88, None)]
    got = rt.keyword_search(spark.createDataFrame(queries, "owner_id string, query_id long, q_text string"),
                            spark.createDataFrame(memories, "owner_id string, mem_id long, attribute string"), k=3, query_words=words, memory_words=words)
    want = set()
    for o, q, t in queries:
        rows = [(-n, m) for own, m, attribute in memories if own == o and t and attribute is not None and (n := sum(w in attribute.lower() for w in set(t.lower().split())))]
        want |= {(o, q, rank, m, -n) for rank, (n, m) in enumerate(sorted(rows)[:3], 1)}
    assert {(x.owner_id, x.query_id, x.rank, x.mem_id, x.matches) for x in got.collect()} == want


def test_lookup_takes_the_first_partner_in_store_order(spark):
    index = spark.createDataFrame([("o", "t1", 0, "zoe smith", 2), ("o", "t2", 0, "ann", 3), ("o", "t3", 0, "joann", 1), ("o", "t4", 0, "ann", 9), ("p", "t9", 0, "kim", 1)],
                                  "owner_id string, thread_id string, conv_no int, partner_key string, store_rank int")
    names = [("o", "a", " ANN\t"), ("o", "b", "Smith"), ("o", "c", ""), ("o", "d", "  "), ("o", "e", "nobody"), ("o", "f", None), ("p", "g", "ann"), ("none", "h", "ann")]
    got = {r.query_id: (r.partner_key, r.matched) for r in conv.partner_lookup(index, spark.createDataFrame(names, "owner_id string, query_id string, name string"), seed=3).collect()}
    assert got["a"] == ("joann", True) and got["b"] == ("zoe smith", True) and got["c"] == got["d"] == ("joann", True)
    assert not got["e"][1] and not got["f"][1] and got["g"] == ("kim", False) and "h" not in got and len(got) == 7


def test_partner_index_strips_and_skips_empty_names(spark):
    turns = spark.createDataFrame([("o", "t", c, i, s, "hi") for c, pair in enumerate([("Me", " Ann \n"), ("Me", ""), ("Me", " "), ("Me", "Bo"), ("Al", "Bo")]) for i, s in enumerate(pair)],
                                  "owner_id string, thread_id string, conv_no int, turn_idx int, speaker string, content string")
    assert sorted((r.conv_no, r.partner_key) for r in conv.partner_index(turns).collect()) == [(0, "ann"), (2, ""), (3, "bo")]


def brute_gate(rows, threshold):
    out, ref = {}, {}
    for owner, session, seq, v, verdict in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last = ref.get((owner, session))
        def near(a, b):
            size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            return size > 0 and sum(x * y for x, y in zip(a, b)) / size > threshold
        usable = v is not None and None not in v
        reuse = bool(verdict and usable and last is not None and near(last, v))
        out[owner, session, seq] = reuse
        if not reuse:
            ref[owner, session] = v if usable else None
    return out


@pytest.mark.parametrize("batch", [7, 10_000])
def test_reuse_gate_equals_the_fold(spark, batch):
    r = random.Random(8)
    base = [[r.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = []
    for k in range(900):  # one session holds most rows
        v = [x + r.gauss(0, 0.25) for x in base[k // 9 % 6]]
        v = r.choice([v] * 12 + [None, [None, 1.0, 1.0, 1.0], [0.0] * 4])
        rows.append(("o", 1 if k % 3 else 2 + k % 5, 10 * k, v, r.choice([True] * 9 + [False, None])))
    rows.append(("p", 1, -5, base[0], True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rt.reuse_gate(spark.createDataFrame(rows, "owner_id string, session_id long, seq long, q_embedding array<double>, verdict boolean").repartition(5), bucket=500).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(x.owner_id, x.session_id, x.seq): x.reused for x in got}
    want = brute_gate(rows, rt.REUSE_THRESHOLD)
    assert got == want and sum(want.values()) > 100
