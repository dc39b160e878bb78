"""File sources on small hand-written fixtures (text export, vCard, Messenger,
Discord, metadata, pasted transcripts)."""

import json
import os

import pytest

from chatlake.operators import ingest as ing
from chatlake.sources import exports as src

EXPORT = """preamble text
Aug 25, 2021  5:17:24 PM (Read after 2 minutes)
+13045550123
are we still on for friday
This message responded to an earlier message.

Aug 25, 2021 11:17:24 PM
Me
yes
second content line is ignored

Aug 25, 2021 11:18:00 PM
Ann
Tapbacks: loved "yes"

Aug 26, 2021  5:18:01 AM
Me
Aug 26, 2021  5:19:00 AM

Aug 26, 2021  5:20:00 AM
Ann
"""


@pytest.mark.parametrize("bucket", [1 << 16, 4, 5])
def test_text_export_records(spark, tmpdir_path, monkeypatch, bucket):
    monkeypatch.setattr(src, "LINE_BUCKET", bucket)      # small buckets: records and clusters cross buckets
    monkeypatch.setattr(ing, "LINE_BUCKET", bucket)
    with open(os.path.join(tmpdir_path, "chat1.txt"), "w") as f:
        f.write(EXPORT)
    lines = src.read_text_lines(spark, tmpdir_path)
    msgs = src.assemble_records(lines).orderBy("seq").collect()
    got = [(m.speaker, m.content, m.is_reply, str(m.ts)) for m in msgs]
    assert got == [
        ("+13045550123", "are we still on for friday", True, "2021-08-25 17:17:24"),
        ("Me", "yes", False, "2021-08-25 23:17:24"),
        # the Tapbacks record is dropped; a timestamp-looking content line is content, not a start
        ("Me", "Aug 26, 2021  5:19:00 AM", False, "2021-08-26 05:18:01"),
        # the last record has no content line: dropped
    ]
    q = ing.thread_quality(lines).collect()[0]
    assert q.has_me and not q.keep


VCF = """BEGIN:VCARD
TEL;type=CELL:+1 (304) 555-0199
FN:Nobody Yet
END:VCARD
BEGIN:VCARD
FN:Ann Lee
TEL;type=CELL:+1 (304) 555-0123
item1.TEL:304-555-01
item2.TEL:(212) 555-0100
END:VCARD
BEGIN:VCARD
FN:Ann Again
TEL:+1 (304) 555-0123
END:VCARD
"""


@pytest.mark.parametrize("bucket", [1 << 16, 4])
def test_vcard_contacts(spark, tmpdir_path, monkeypatch, bucket):
    monkeypatch.setattr(src, "LINE_BUCKET", bucket)      # card numbers carried across line buckets
    with open(os.path.join(tmpdir_path, "contacts.vcf"), "w") as f:
        f.write(VCF)
    lines = src.read_text_lines(spark, tmpdir_path, glob="*.vcf")
    got = {(r.phone_norm, r.name) for r in src.vcard_contacts(lines).collect()}
    assert got == {("13045550123", "Ann Again"), ("2125550100", "Ann Lee")}
    # advanced normal form drops the leading 1 of 11-digit numbers
    c = ing.normalize_contacts(src.vcard_contacts(lines).withColumnRenamed("phone_norm", "phone"))
    assert {r.phone_norm for r in c.collect()} == {"3045550123", "2125550100"}


def test_phone_resolution_rebuilds_text(spark):
    texts = spark.createDataFrame([("o", 1, "call 13045550123 or +12125550100 now"), ("o", 2, "no numbers"),
                                   ("o", 3, "card 4111111111111111")], "owner_id string, k int, text string")
    contacts = spark.createDataFrame([("o", "3045550123", "Ann")], "owner_id string, phone_norm string, name string")
    got = {r.k: r.resolved for r in ing.resolve_phones(texts, contacts, ["k"]).collect()}
    assert got[1] == "call Ann or +12125550100 now"
    assert got[2] == "no numbers"
    assert got[3] == "card 4111111111111111"


def _write_json(path, obj):
    with open(path, "w") as f:
        json.dump(obj, f)


def test_messenger(spark, tmpdir_path):
    msg = lambda ts, s, t, text, r=None: {"timestamp": ts, "senderName": s, "type": t, "text": text,
                                          "reactions": r or []}
    _write_json(os.path.join(tmpdir_path, "a.json"), {"participants": ["Ann", "Ben"], "threadName": "Ann Ben",
                "messages": [msg(1629911844500, "Ben", "text", "hi", [{"reaction": "x", "actor": "Ann"}]),
                             msg(1629911845000, "Ann", "media", None), msg(1629911846000, "Ann", "link", "l")]})
    _write_json(os.path.join(tmpdir_path, "b.json"), {"participants": ["Ann", "Ben", "Cy"], "threadName": "g",
                "messages": [msg(1, "Cy", "text", "x")]})
    _write_json(os.path.join(tmpdir_path, "c.json"), {"participants": ["Ann", "Dee"], "threadName": "Ann Ben",
                "messages": [msg(2, "Dee", "text", "y")]})
    threads = src.read_messenger(spark, tmpdir_path)
    m = src.messenger_messages(threads, "Ben").collect()
    assert sorted((r.thread_id, r.speaker, r.content) for r in m) == [("a", "Ann", "l"), ("a", "Me", "hi")]
    assert [r.reactions for r in m if r.speaker == "Me"] == ["x by Ann"]
    freq = {r.participant: r.n_threads for r in src.participant_frequency(threads).collect()}
    assert freq["Ann"] == 3 and freq["Cy"] == 1
    _write_json(os.path.join(tmpdir_path, "d.json"), {"participants": ["Ben"], "threadName": "z",
                "messages": [msg(3, "Ben", "poll", "?")]})
    with pytest.raises(Exception):
        src.messenger_messages(src.read_messenger(spark, tmpdir_path), "Ben").collect()


def test_discord(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "server1")
    os.makedirs(d)
    _write_json(os.path.join(d, "chan_page_2.json"), [
        {"content": " late ", "type": 0, "timestamp": "2024-01-02T00:00:00.500+00:00",
         "author": {"global_name": None, "username": "u2"}}])
    _write_json(os.path.join(d, "chan_page_1.json"), [
        {"content": "first", "type": 0, "timestamp": "2024-01-01T00:00:00Z", "author": {"global_name": "G", "username": "u"}},
        {"content": "   ", "type": 0, "timestamp": "2024-01-01T00:00:01Z", "author": {"global_name": "G", "username": "u"}},
        {"content": "joined", "type": 1, "timestamp": "2024-01-01T00:00:02Z", "author": {"global_name": "G", "username": "u"}}])
    m = src.discord_messages(src.read_discord(spark, tmpdir_path)).orderBy("seq").collect()
    assert [(r.thread_id, r.speaker, r.content) for r in m] == [("server1", "G", "first"), ("server1", "u2", "late")]


def test_metadata_and_transcripts(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "meta.txt")
    with open(p, "w") as f:
        f.write("Ann: friend: from school\n---\nno colon here\n---\nBob:\n---\n Cy : cousin ")
    got = {(r.name, r.description) for r in src.read_metadata(spark, p).collect()}
    assert got == {("Ann", "friend: from school"), ("Cy", "cousin")}
    tr = spark.createDataFrame([(1, "Topic: food<|>Prompt: talk<|>[2025-01-01 10:00:00] admin: hi<|>bad part<|>"
                                    "[2025-01-01 10:01:00] Ann: hello: there<|>")], "transcript_id int, text string")
    rows = sorted((r.kind, r.key, r.value) for r in src.split_transcripts(tr, "admin").collect())
    assert rows == [("header", "Prompt", "talk"), ("header", "Topic", "food"),
                    ("message", "Ann", "hello: there"), ("message", "Me", "hi")]


def test_sinks_roundtrip(spark, tmpdir_path):
    import datetime as dt

    from chatlake.sources import sinks

    turns = spark.createDataFrame([("o", "t", 0, 1, dt.datetime(2024, 1, 1, 1), "Me", "b", False, None, 1),
                                   ("o", "t", 0, 0, dt.datetime(2024, 1, 1), "Ann", "a", False, None, 1)],
                                  "owner_id string, thread_id string, conv_no int, turn_idx int, ts timestamp, "
                                  "speaker string, content string, is_reply boolean, reply_info string, n_msgs int")
    p = os.path.join(tmpdir_path, "convs")
    sinks.write_conversations_json(turns, p)
    row = spark.read.json(p).collect()[0]
    assert [m.content for m in row.messages] == ["a", "b"]
    built = []
    st = os.path.join(tmpdir_path, "stage")
    for _ in range(2):
        sinks.stage_table(spark, st, lambda: built.append(1) or turns)
    assert len(built) == 1
