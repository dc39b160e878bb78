"""Sessionising and turn merging agree with a literal loop, across scan buckets."""

import datetime as dt
import random

from chatlake.operators import conversations as conv

SCHEMA = ("owner_id string, thread_id string, seq long, ts timestamp, speaker string, content string, "
          "is_reply boolean, reply_info string, source string")


def _random_msgs(seed, n_threads=4, n=60):
    rnd = random.Random(seed)
    rows = []
    base = dt.datetime(2024, 1, 1)
    for th in range(n_threads):
        t = base
        for i in range(n):
            # gaps around the 6 h threshold, including exact 6 h and negative gaps
            t = t + rnd.choice([dt.timedelta(minutes=5), dt.timedelta(hours=6), dt.timedelta(hours=6, seconds=1),
                                dt.timedelta(hours=-1), dt.timedelta(hours=2)])
            spk = rnd.choice(["Me", "Ann", "Bob"])
            rep = rnd.random() < 0.2
            rows.append(("o", f"t{th}", i * 3 + th, t, spk, f"m{i}", rep, f"r{i}" if rep else None, "x"))
    return rows


def _literal(rows, gap=dt.timedelta(hours=6)):
    out = []
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for th, msgs in by.items():
        msgs.sort(key=lambda r: r[2])
        convs, cur = [], []
        for m in msgs:
            if cur and m[3] - cur[-1][3] > gap:
                convs.append(cur)
                cur = []
            cur.append(m)
        if cur:
            convs.append(cur)
        for ci, c in enumerate(convs):
            turns = []
            for m in c:
                if turns and turns[-1]["speaker"] == m[4]:
                    g = turns[-1]
                    g["content"] += "<|msg|>" + m[5]
                    g["ts"] = m[3]
                    if m[6]:
                        g["is_reply"], g["reply_info"] = True, m[7]
                    g["n"] += 1
                else:
                    turns.append({"speaker": m[4], "content": m[5], "ts": m[3], "is_reply": m[6],
                                  "reply_info": m[7], "n": 1})
            for ti, g in enumerate(turns):
                out.append((th, ci, ti, g["speaker"], g["content"], g["ts"], g["is_reply"], g["reply_info"], g["n"]))
    return sorted(out, key=repr)


def test_merge_turns_matches_loop_small_buckets(spark):
    rows = _random_msgs(11)
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket in (4, 7, 1 << 20):
        got = conv.merge_turns(df, bucket_size=bucket).collect()
        got = sorted(((r.thread_id, r.conv_no, r.turn_idx, r.speaker, r.content, r.ts, r.is_reply, r.reply_info,
                       r.n_msgs) for r in got), key=repr)
        assert got == _literal(rows), bucket


def test_store_ranks_and_bounds(spark):
    rows = _random_msgs(12)
    turns = conv.merge_turns(spark.createDataFrame(rows, SCHEMA))
    store = conv.conversation_store(turns, num=3, min_turns=2, max_turns=10).collect()
    assert len(store) <= 3
    assert all(2 <= r.n_turns <= 10 for r in store)
    assert sorted(r.store_rank for r in store) == list(range(1, len(store) + 1))
