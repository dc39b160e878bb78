"""Census, corrections, merged exports, transcripts and readers against hand-worked cases and plain versions."""

import collections
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from chatlake.operators import ingest as ing
from chatlake.sources import exports as src

STAMP = "Oct 1, 2020  5:00:00 PM"


def lines_of(spark, files):
    rows = [("o", name, k, v) for name, text in files.items() for k, v in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "owner_id string, thread_id string, line_no long, value string").repartition(3)


def census(files):
    """First non-blank line of each piece between timestamps."""
    found = set()
    for text in files.values():
        for piece in re.split(r"[A-Z][a-z]{2} \d{1,2}, \d{4}\s+\d{1,2}:\d{2}:\d{2} [AP]M", text):
            first = piece.strip().split("\n")[0].strip()
            if first and first != "Tapbacks:" and not first.startswith("Find My:"):
                found.add(first)
    return found


@pytest.mark.parametrize("bucket", [2, 3, 1 << 16])
def test_census_equals_the_split_of_whole_files(spark, monkeypatch, bucket):
    monkeypatch.setattr(ing, "LINE_BUCKET", bucket)
    r = random.Random(bucket)
    pick = lambda: r.choice([STAMP, "", "", "  ", "Bob", "Ann ", "Tapbacks:", "Find My: x", "+12125550123", "Me", f"{STAMP} inline", f"x {STAMP} y {STAMP}", f"{STAMP}{STAMP}"])
    files = {f"f{k}": "\n".join(pick() for _ in range(r.randint(1, 25))) for k in range(40)}
    files |= {"blank": f"{STAMP}\n\nZoe\nhello", "before": f"Start text\nmore\n{STAMP}\nYan", "none": "\n\n", "end": f"{STAMP}\n\n"}
    rows = ing.speaker_census(lines_of(spark, files)).collect()
    got = {s for row in rows for s in row.speakers.split(", ")}
    assert got == census(files) and {"Zoe", "Start text", "Yan"} <= got
    assert {row.category: row.n_speakers for row in rows} == collections.Counter("me" if s == "Me" else "phone" if s.startswith("+1") else "name" for s in got)


@pytest.mark.parametrize("bucket", [3, 4, 1 << 16])
def test_records_do_not_depend_on_the_bucket(spark, monkeypatch, bucket):
    monkeypatch.setattr(src, "LINE_BUCKET", bucket)
    r = random.Random(7)
    files = {f"f{k}": "\n".join(r.choice([STAMP, STAMP, "Me", "Bob", "text", "", "Edited to x", "This message responded to an earlier message."]) for _ in range(60)) for k in range(6)}
    want = set()
    for name, text in files.items():
        v, k = [x.strip() for x in text.split("\n")], 0
        while k < len(v):
            if v[k] == STAMP and k + 2 < len(v):
                if not v[k + 2].startswith(("This message", "Tapbacks:", "/Users/", "Edited to")):
                    want.add((name, k + 1, v[k + 1], v[k + 2], k + 3 < len(v) and v[k + 3].startswith("This message responded")))
                k += 3
            else:
                k += 1
    got = src.assemble_records(lines_of(spark, files)).collect()
    assert {(x.thread_id, x.seq, x.speaker, x.content, x.is_reply) for x in got} == want and len(got) == len(want)


def test_corrections_compare_normal_forms(spark):
    contacts = spark.createDataFrame([("o", "13045550123", "Old"), ("o", "+13045550123", "Older"), ("o", "9", "Nine")], "owner_id string, phone_norm string, name string")
    fixes = spark.createDataFrame([("o", "(304) 555-0123", " New "), ("o", "9", "  "), ("o", "8", "Eight"), ("p", "9", "Other")], "owner_id string, phone string, name string")
    rows = lambda over: sorted(map(tuple, ing.apply_corrections(contacts, fixes, over).collect()))
    assert rows(False) == [("o", "3045550123", "Old"), ("o", "8", "Eight"), ("o", "9", "Nine"), ("p", "9", "Other")]
    assert rows(True) == [("o", "3045550123", "New"), ("o", "8", "Eight"), ("o", "9", "Nine"), ("p", "9", "Other")]
    twice = spark.createDataFrame([("o", "1 (212) 555-0100", "B", 1), ("o", "2125550100", "A", 2)], "owner_id string, phone string, name string, pos int")
    assert [r.name for r in ing.normalize_contacts(twice, "pos").collect()] == ["A"]
    assert [r.name for r in ing.normalize_contacts(twice).collect()] == ["A"]


@pytest.mark.parametrize("most", [0, 1000])
def test_merged_threads_are_whole(spark, most):
    a = lines_of(spark, {"both": "x\nyy", "tie": "ab\nc", "a": "1"})
    b = lines_of(spark, {"both": "x", "tie": "a\nbc", "b": "é"})
    got = ing.merge_threads(a, b, most=most).orderBy("thread_id", "line_no").collect()
    assert [(r.thread_id, r.line_no, r.value, r.export) for r in got] == [
        ("a", 1, "1", "a"), ("b", 1, "é", "b"), ("both", 1, "x", "a"), ("both", 2, "yy", "a"), ("tie", 1, "a", "b"), ("tie", 2, "bc", "b")]


def test_transcripts(spark):
    texts = [(1, "Topic: straws<|>Prompt: one: or two<|>First Turn: admin<|>"), (2, "Topic: x<|> y <|>no [2024] colon<|>[1] admin: hi: there <|><|>[2] bob said: ok<|>bob: plain"),
             (3, ""), (4, None), (5, "[1] admin:x")]
    t = spark.createDataFrame(texts, "transcript_id long, text string")
    rows = sorted(((r.transcript_id, r.kind, r.pos, r.key, r.value, r.line) for r in src.split_transcripts(t, "admin").collect()))
    assert [r[:5] for r in rows] == [
        (1, "header", 0, "Topic", "straws"), (1, "header", 1, "Prompt", "one: or two"), (1, "header", 2, "First Turn", "admin"),
        (1, "message", 0, "Topic", "straws"), (1, "message", 1, "Prompt", "one: or two"), (1, "message", 2, "First Turn", "admin"),
        (2, "header", 0, "Topic", "x"), (2, "message", 3, "Me", "hi: there"), (2, "message", 5, "bob said", "ok"), (2, "message", 6, "bob", "plain")]
    assert [r[5] for r in rows[6:]] == ["Topic: x", "[1] Me: hi: there", "[2] bob said: ok", "bob: plain"]
    said = {r.transcript_id: r for r in src.transcript_messages(t, "admin", "2024-02-01 00:00:00").collect()}
    assert said[2].user_message == "Current conversation:\n[1] Me: hi: there\n[2] bob said: ok\nbob: plain\n[2024-02-01 00:00:00] Me: "
    assert "[BEGIN TOPIC METADATA]\nTopic: x\n[END TOPIC METADATA]." in said[2].system_message and len(said) == 5
    assert said[3].user_message == "Current conversation:\n\n[2024-02-01 00:00:00] Me: "


def test_owner_must_take_part(spark):
    threads = spark.createDataFrame([(["Ann", "Bob"],), (["Ann", "Cy"],)], "participants array<string>")
    src.require_participant(threads, "Ann")
    with pytest.raises(ValueError, match="Bob, Cy, Ann"):
        src.require_participant(threads, "Zed")
    assert sorted((r.rank, r.participant, r.n_threads) for r in src.participant_frequency(threads).collect()) == [(1, "Bob", 1), (2, "Cy", 1), (3, "Ann", 2)]


def test_cut_files_raise(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/d")
    for name in ("d/a_page_1.json", "bank.json"):
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write('[{"content": "hi", "type"')
    for read in (lambda: src.read_discord(spark, tmpdir_path), lambda: src.read_memory_bank(spark, f"{tmpdir_path}/bank.json")):
        with pytest.raises(Exception, match="(?i)malformed"):
            read().drop("file_path", "_mid").collect()
