"""What is written comes back: turns, stores, sets of a dataset in order, prompts; levels and several speakers."""

import dataclasses
import datetime as dt
import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from chatlake.operators import conversations as conv
from chatlake.operators import examples as exm
from chatlake.operators import stats as st
from chatlake.operators import subsets as sub
from chatlake.sources import exports as src
from chatlake.sources import sinks as snk

TURN = "owner_id string, thread_id string, conv_no int, turn_idx int, ts timestamp, speaker string, content string, is_reply boolean, reply_info string, n_msgs int"
BASE = dt.datetime(2024, 1, 1)


def turns(spark, n=30, seed=1, owners=("o", "p q/r")):
    r, rows = random.Random(seed), []
    for owner in owners:
        for c in range(n):
            for k in range(r.randint(1, 6)):
                reply = r.random() < 0.1
                rows.append((owner, f"t{c % 4}", c, k, BASE + dt.timedelta(hours=3 * c, minutes=k), r.choice(["Me", "Ann"]),
                             r.choice(["hello there you", "é \"quoted\"\nline", "a<|msg|>b c d e", ""]), reply, "r" if reply else None, r.randint(1, 3)))
    return spark.createDataFrame(rows, TURN)


def same(a, b):
    a, b = a.select(*sorted(a.columns)), b.select(*sorted(b.columns))
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def in_file_order(path):
    return [json.loads(line) for f in sorted(glob.glob(f"{path}/*.json")) for line in open(f, encoding="utf-8")]


def test_conversations_and_stores_come_back(spark, tmpdir_path):
    t = turns(spark).cache()
    snk.write_conversations_json(t, f"{tmpdir_path}/c")
    assert same(snk.read_conversations_json(spark, f"{tmpdir_path}/c").drop("store_rank"), t)
    store = conv.conversation_store(t, num=10, min_turns=2, max_turns=5)
    snk.write_store(t, store, f"{tmpdir_path}/s")
    back = snk.read_conversations_json(spark, f"{tmpdir_path}/s")
    assert same(back, conv.store_turns(t, store)) and back.select("owner_id", "store_rank").distinct().count() == 20
    assert [x["store_rank"] for x in in_file_order(f"{tmpdir_path}/s/owner_id=o")] == list(range(1, 11))
    with open(f"{tmpdir_path}/s/owner_id=o/part-bad.json", "w") as f:
        f.write('{"thread_id": "t", "messages": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        snk.read_conversations_json(spark, f"{tmpdir_path}/s").collect()


def test_sets_come_back_in_order(spark, tmpdir_path):
    cfg = dataclasses.replace(exm.LEVELS["60k"], enabled=())
    ex = exm.build_examples(turns(spark, 60), cfg=cfg)
    specs = [sub.SubsetSpec("S5", 5, 24), sub.SubsetSpec("T9", 9, None), sub.SubsetSpec("big", 10**6, 1)]
    rows = sub.dataset_rows(ex, specs, sub.SubsetSpec("validation", 7, 1)).cache()
    counts = {(r.owner_id, r.subset_name): r.n for r in rows.groupBy("owner_id", "subset_name").agg(F.count("*").alias("n")).collect()}
    assert {k[1] for k in counts} == {"full", "S5", "T9", "validation"} and counts["o", "S5"] == 5 and counts["o", "T9"] == 9
    assert counts["o", "full"] == ex.filter("owner_id = 'o'").count()
    used = rows.filter("subset_name in ('S5', 'T9')").select("owner_id", "ts").distinct()
    assert rows.filter("subset_name = 'validation'").join(used, ["owner_id", "ts"]).count() == 0
    snk.write_dataset(rows, f"{tmpdir_path}/d")
    back = snk.read_dataset(spark, f"{tmpdir_path}/d")
    assert same(back, rows.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("reject_reason", "ts"))
    for name in ("full", "S5", "T9", "validation"):
        lines = in_file_order(f"{tmpdir_path}/d/owner_id=o/subset_name={name}")
        assert [x["pos"] for x in lines] == list(range(counts["o", name])) and [x["timestamp"] for x in lines] == sorted(x["timestamp"] for x in lines)
    snk.write_prompt_completion(rows, f"{tmpdir_path}/p", {"S5": 3})
    lines = in_file_order(f"{tmpdir_path}/p/owner_id=o/subset_name=S5")
    assert [(x["copy"], x["pos"]) for x in lines] == [(c, k) for c in (1, 2, 3) for k in range(5)]
    back = snk.read_prompt_completion(spark, f"{tmpdir_path}/p")
    assert back.filter("subset_name = 'full'").count() == rows.filter("subset_name = 'full'").count()
    snk.write_dataset(ex, f"{tmpdir_path}/plain")
    assert snk.read_dataset(spark, f"{tmpdir_path}/plain").filter("subset_name = 'full' and pos is null").count() == ex.count()


def test_statistics_and_contacts_files(spark, tmpdir_path):
    stats = st.token_stats(st.token_counts(spark.createDataFrame([("d", "a b", "c"), ("d", "x", None)], "dataset string, input string, output string")))
    snk.write_stats(stats, f"{tmpdir_path}/j")
    snk.write_stats(stats, f"{tmpdir_path}/c", "csv")
    assert spark.read.json(f"{tmpdir_path}/j").count() == 3 and spark.read.option("header", True).csv(f"{tmpdir_path}/c").count() == 3
    with open(f"{tmpdir_path}/contacts.json", "w") as f:
        json.dump({"+1 (212) 555-0100": "Ann", "2125550101": "Bo"}, f)
    read = src.read_contacts_json(spark, f"{tmpdir_path}/contacts.json")
    assert {(r.phone, r.name) for r in read.collect()} == {("+1 (212) 555-0100", "Ann"), ("2125550101", "Bo")}
    src.write_contacts_json(read.withColumnRenamed("phone", "phone_norm"), f"{tmpdir_path}/out")
    assert json.loads(spark.read.text(f"{tmpdir_path}/out").first().value)["contacts"] == {"+1 (212) 555-0100": "Ann", "2125550101": "Bo"}


def test_embedding_cache_encodes_only_what_is_missing(spark, tmpdir_path):
    mem = spark.createDataFrame([("o", k, f"text {k}") for k in range(5)], "owner_id string, mem_id long, attribute string")
    encode = lambda c: F.array(F.length(c).cast("float"))
    cache = f"{tmpdir_path}/cache"
    assert snk.refresh_embedding_cache(spark, mem.filter("mem_id < 3"), cache, encode, "m").count() == 3
    assert snk.refresh_embedding_cache(spark, mem, cache, encode, "m").count() == 5
    assert snk.refresh_embedding_cache(spark, mem, cache, encode, "other").groupBy("model").count().count() == 2
    built = []
    stage = lambda: snk.stage_table(spark, f"{tmpdir_path}/stage", lambda: built.append(1) or mem)
    assert stage().count() == stage().count() == 5 and built == [1]


@pytest.mark.parametrize("buffer", [0, 2])
@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_speaker_limit_counts_speakers(spark, most, buffer):
    r, rows, want = random.Random(most), [], {}
    for t in range(6):
        said = []
        for c in range(5):
            now = []
            for k in range(r.randint(1, 6)):
                who = r.choice(["Me", "A", "B", "C", "D"][:2 + t % 4])
                rows.append(("o", f"t{t}", c, k, BASE + dt.timedelta(days=c, minutes=k), who, "some words here", False, None, 1))
                if who == "Me":
                    seen = {w for conv_ in said[-buffer:] for w in conv_} if buffer else set()
                    want[f"t{t}", c, k] = len((seen | set(now)) - {"Me"}) > most
                now.append(who)
            said.append(now)
    cfg = exm.FilterConfig(max_speakers=most, enabled=("too_many_speakers",))
    got = exm.example_features(spark.createDataFrame(rows, TURN), buffer, cfg).collect()
    assert {(x.thread_id, x.conv_no, x.turn_idx): x.reject_reason == "too_many_speakers" for x in got} == want


def test_levels_nest(spark):
    t = turns(spark, 60)
    kept = {level: {tuple(r) for r in exm.example_features(t, cfg=cfg).filter("reject_reason is null").select(*exm.EX_KEY).collect()} for level, cfg in exm.LEVELS.items()}
    assert kept["60k"] >= kept["45k"] >= kept["25k"] >= kept["15k"] and len(kept["60k"]) > len(kept["25k"])
    per = st.conversation_tokens(t, limit=8)
    total = {r.owner_id: r for r in st.corpus_tokens(per).collect()}
    assert total[None].n_conversations == 120 and total[None].n_over_limit == st.over_limit(per).count() > 0
