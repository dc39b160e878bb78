"""Reject reasons on hand-worked conversations, and prompts that hold what came before."""

import datetime as dt
import random

import pytest

from chatlake.operators import examples as exm

SCHEMA = ("owner_id string, thread_id string, conv_no int, turn_idx int, ts timestamp, speaker string, "
          "content string, is_reply boolean, reply_info string, n_msgs int")

GOOD = [("Ann", "hello there"), ("Me", "well hi"), ("Ann", "how was the trip"), ("Me", "it was really nice")]


def _turns(conv, thread="t0", conv_no=0):
    base = dt.datetime(2024, 3, 1)
    return [("o", thread, conv_no, k, base + dt.timedelta(minutes=k), who, text, False, None, 1) for k, (who, text) in enumerate(conv)]


#: What the last turn of a conversation is rejected for.
CASES = [
    (None, GOOD),
    ("filtered_strings", [*GOOD[:2], ("Ann", "gamepigeon MESSAGE: play"), GOOD[3]]),
    ("filtered_strings", [*GOOD[:3], ("Me", "see Library/Messages/ for that")]),
    ("too_short", [*GOOD[:3], ("Me", "very nice")]),
    ("too_many_consecutive_msgs_input", [*GOOD[:2], ("Ann", " <|msg|> ".join(["a"] * 22)), GOOD[3]]),
    (None, [*GOOD[:2], ("Ann", " <|msg|> ".join(["a"] * 21)), GOOD[3]]),
    ("too_many_consecutive_msgs_output", [*GOOD[:3], ("Me", " <|msg|> ".join(["a"] * 22))]),
    ("contains_url", [*GOOD[:3], ("Me", "look at WWW.site for it")]),
    (None, [*GOOD[:2], ("Ann", "look at www.site for it"), GOOD[3]]),
    ("excessive_repetition", [*GOOD[:3], ("Me", "dog " * 16)]),
    (None, [*GOOD[:3], ("Me", "dog " * 15 + "the " * 20)]),
    ("too_many_speakers", [("Bob", "hello there"), *GOOD[1:]]),
    ("too_short", [*GOOD[:3], ("Me", "\U0001F600\U0001F600\U0001F600")]),
    ("too_many_messages", GOOD[:2] * 18 + [GOOD[3]]),
    ("long_messages_input", [*GOOD[:2], ("Ann", "word " * 51), GOOD[3]]),
    (None, [*GOOD[:2], ("Ann", "word " * 30 + "<|msg|> " + "word " * 30), GOOD[3]]),
    ("long_messages_output", [*GOOD[:3], ("Me", " ".join(f"w{k}" for k in range(51)))]),
    ("too_little_messages_input", GOOD[1:]),
]


def test_reasons(spark):
    rows = [r for n, (_, conv) in enumerate(CASES) for r in _turns(conv, f"t{n:02d}")]
    got = {}
    for r in exm.example_features(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.thread_id, {})[r.turn_idx] = r.reject_reason
    assert [got[f"t{n:02d}"][len(conv) - 1] for n, (_, conv) in enumerate(CASES)] == [reason for reason, _ in CASES]
    assert {reason for reason, _ in CASES} | {"emoji_only"} == {*exm.REASONS, None}


def test_emoji_only(spark):
    """White space is no emoji, so the rule can only meet texts that the length rule lets through."""
    import dataclasses
    df = spark.createDataFrame(_turns([*GOOD[:3], ("Me", "\U0001F600\U0001F600")]), SCHEMA)
    feats = exm.example_features(df, cfg=dataclasses.replace(exm.DEFAULT_FILTERS, min_output_words=0))
    assert {r.turn_idx: r.reject_reason for r in feats.collect()}[3] == "emoji_only"


def test_prior_context_counts(spark):
    rows = _turns([("Bob", "an older talk"), ("Ann", "yes it was")], conv_no=0) + _turns(GOOD, conv_no=1)
    df = spark.createDataFrame(rows, SCHEMA)
    reason = lambda buffer: {(r.conv_no, r.turn_idx): r.reject_reason for r in exm.example_features(df, buffer=buffer).collect()}
    assert reason(0)[1, 3] is None and reason(1)[1, 3] == "too_many_speakers"


def test_two_speakers_may_be_allowed(spark):
    import dataclasses
    df = spark.createDataFrame(_turns([("Bob", "hello there"), *GOOD[1:]]), SCHEMA)
    reason = lambda n: {r.turn_idx: r.reject_reason for r in exm.example_features(df, cfg=dataclasses.replace(exm.DEFAULT_FILTERS, max_speakers=n)).collect()}
    assert reason(1)[3] == "too_many_speakers" and reason(2)[3] is None



def test_features_do_not_depend_on_buckets(spark, monkeypatch):
    df = spark.createDataFrame([tuple(r.values()) for r in _random_turns(1)], SCHEMA)
    whole = [{tuple(r) for r in exm.example_features(df, buffer=b).collect()} for b in (0, 2)]
    monkeypatch.setattr(exm, "TURN_BUCKET", 3)      # history carried across turn buckets
    monkeypatch.setattr(exm, "CONV_BUCKET", 2)      # prior context read across conversation buckets
    assert [{tuple(r) for r in exm.example_features(df, buffer=b).collect()} for b in (0, 2)] == whole


def test_rendered_prompt(spark):
    df = spark.createDataFrame(_turns(GOOD[:2], conv_no=0) + _turns(GOOD, conv_no=1), SCHEMA)
    feats = exm.example_features(df, buffer=1)
    got = {(r.conv_no, r.turn_idx): r.input for r in exm.render_examples(feats, df, buffer=1, survivors_only=False).collect()}
    assert got[1, 1] == ("Previous conversations:\n[2024-03-01 00:00:00] Ann: hello there\n[2024-03-01 00:01:00] Me: well hi\n---\n"
                         "Current conversation:\n[2024-03-01 00:00:00] Ann: hello there\n[2024-03-01 00:01:00] Me: ")


def _random_turns(seed):
    rnd = random.Random(seed)
    words = ["hi", "ok", "lol", "cat", "[2024-01-01 10:00:00]", "a:b", "x] y: z", "<|msg|>", "\n", "GamePigeon message:",
             "www.site", "w", "dog dog", "Ann: hey", "]", ": "]
    rows = []
    base = dt.datetime(2024, 3, 1)
    for th in range(3):
        for cno in range(4):
            n = rnd.randint(1, 9)
            for ti in range(n):
                spk = rnd.choice(["Me", "Me", "Ann", "Bob"])
                content = " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 2, 3, 5, 12, 60])))
                rows.append({"owner_id": "o", "thread_id": f"t{th}", "conv_no": cno, "turn_idx": ti,
                             "ts": base + dt.timedelta(hours=cno * 10, minutes=ti), "speaker": spk,
                             "content": content, "is_reply": rnd.random() < 0.1, "reply_info": None, "n_msgs": 1})
    return rows


def test_filter_stats_has_all_reasons(spark):
    df = spark.createDataFrame([tuple(r.values()) for r in _random_turns(9)], SCHEMA)
    stats = exm.filter_stats(exm.example_features(df)).orderBy("ord").collect()
    assert [r.reject_reason for r in stats] == exm.REASONS


def test_labels_mask_the_prompt(spark):
    ex = spark.createDataFrame([(1, "sys ", "hello wor", "ld and more"), (2, "a", None, "b c"), (3, "", "", "")], "k int, instruction string, input string, output string")
    t = exm.chat_template(ex, "custom", custom="<{instruction}|{input}{output}>")
    assert [(r.text, r.empty_text, r.prompt_text) for r in t.orderBy("k").collect()][:2] == [
        ("<sys |hello world and more>", "<sys |hello wor>", "<sys |hello wor"), ("<a|b c>", "<a|>", "<a|")]

    def make():
        import re

        def encode(texts):  # a word or a sign is a token, its id is its length
            found = [list(re.finditer(r"\w+|[^\w\s]", x)) for x in texts]
            return [([len(m.group()) for m in f], [m.start() for m in f]) for f in found]

        return encode

    apart = {r.k: (r.input_ids, r.prompt_length, r.labels) for r in exm.supervised_ids_with(t, make).collect()}
    assert apart[1] == ([1, 3, 1, 5, 5, 3, 4, 1], 6, [-100] * 6 + [4, 1])      # <, sys, |, hello, wor, > without the output
    joint = {r.k: (r.prompt_length, r.labels) for r in exm.supervised_ids_with(t, make, joint=True).collect()}
    assert joint[1] == (5, [-100] * 5 + [3, 4, 1])                              # "world" begins before the output does
    short = {r.k: (r.input_ids, r.labels) for r in exm.supervised_ids_with(t, make, max_seq_length=3).collect()}
    assert short[1] == ([1, 3, 1], [-100] * 3) and short[3] == ([1, 1, 1], [-100] * 3)
    own = {r.k: r for r in exm.supervised_ids(t, pattern=r"\w+|[^\w\s]", max_seq_length=7).collect()}
    assert own[1].prompt_length == 6 and own[1].labels == [-100] * 6 + own[1].input_ids[6:] and len(own[1].input_ids) == 7


@pytest.mark.parametrize("bucket", [2, 4096])
def test_prompts_are_counted_without_rendering(spark, monkeypatch, bucket):
    from chatlake.operators import stats as st
    monkeypatch.setattr(exm, "TURN_BUCKET", bucket)
    rnd = random.Random(bucket)
    rows = [r for n in range(12) for r in _turns([(rnd.choice(["Me", "Ann"]), rnd.choice(["hello, you", "a\nb: c", "x<|msg|>y z", "é 日本 don't"])) for _ in range(rnd.randint(1, 9))], f"t{n}")]
    df = spark.createDataFrame(rows, SCHEMA)
    f = exm.example_features(df)
    got = {(r.thread_id, r.turn_idx): (r.input_tokens, r.output_tokens) for r in exm.prompt_counts(f, df, st.word_piece_count).collect()}
    want = {(r.thread_id, r.turn_idx): (r.input_tokens, r.output_tokens) for r in st.token_counts(exm.render_examples(f, df, survivors_only=False)).collect()}
    assert got == want and len(got) > 10
