"""Response parsers, neighbour timestamps, ids and banks on hand-worked tables."""

import json

from chatlake.operators import memory as mem
from chatlake.sources import exports

RESPONSES = "owner_id string, stage string, batch_no long, text string"


def _responses(spark, texts):
    return spark.createDataFrame([("o", "s", i, t) for i, t in enumerate(texts)], RESPONSES)


def test_parse_attributes(spark):
    cases = [
        # a full record; its number comes from the citation
        ("- Attribute: likes tea\n- Citation: Conversation 3, Me: x\n- Timestamp: 2023-05-01 14:30",
         [(1, "likes tea", "Conversation 3, Me: x", "2023-05-01 14:30", 3)]),
        # bullets, case and blank lines don't matter; the second record is left open and filled up
        ("\n• ATTRIBUTE: one\n\n  citation: conversation   12\nTimestamp: t\nAttribute: two\n",
         [(1, "one", "conversation   12", "t", 12), (2, "two", "", "", None)]),
        # a record closed by the next attribute keeps what it has
        ("Attribute: a\nCitation: none\nAttribute: b\nCitation: c\nTimestamp: t", [(1, "a", "none", None, None), (2, "b", "c", "t", None)]),
        # a timestamp without citation does not close; keys before any attribute are nothing
        ("Citation: lost\nAttribute: a\nTimestamp: t1\nTimestamp: t2\nCitation: c", [(1, "a", "c", "t2", None)]),
        ("random text", []),
        ("", []),
        # a number beyond int is no number
        ("Attribute: a\nCitation: Conversation 20230515143000\nTimestamp: t", [(1, "a", "Conversation 20230515143000", "t", None)]),
    ]
    got = {}
    for r in mem.parse_attributes(_responses(spark, [c[0] for c in cases])).collect():
        got.setdefault(r.batch_no, []).append((r.rec, r.attribute, r.citation, r.timestamp, r.conversation_number))
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, (_, want) in enumerate(cases) if want}


def test_parse_combined(spark):
    cases = [
        ("COMBINED ATTRIBUTES:\n- Attribute: x\n- Based on: Attribute 1, Attribute 2\nINFERRED ATTRIBUTES:\nAttribute: y\nBased on: Attribute 3",
         [(1, "combined", "x", "Attribute 1, Attribute 2"), (2, "inferred", "y", "Attribute 3")]),
        ("Attribute: before any section\nBased on: Attribute 1\ncombined attributes\nAttribute: last", [(2, "combined", "last", "")]),
        ("no section", []),
    ]
    got = {}
    for r in mem.parse_combined(_responses(spark, [c[0] for c in cases])).collect():
        got.setdefault(r.batch_no, []).append((r.rec, r.kind, r.attribute, r.based_on))
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, (_, want) in enumerate(cases) if want}


def test_out_of_range_references_are_dropped(spark):
    combined = spark.createDataFrame([("o", "s", 0, 1, "combined", "Attribute 2, Attribute 99999999999, Attribute 7")],
                                     "owner_id string, stage string, batch_no long, rec int, kind string, based_on string")
    packed = spark.createDataFrame([("o", 0, s, 100 + s) for s in (1, 2, 3)], "owner_id string, cbatch long, cslot int, seq_no long")
    assert [(r.ord, r.source_seq) for r in mem.resolve_sources(combined, packed).collect()] == [(0, 102)]


def test_nearest_timestamp(spark):
    # own time, else the nearest slot's (the later one of two as near), as far as the batch reaches on both sides
    cases = {
        0: (["a", "", ""], ["a", "a", ""]),
        1: (["", "", "c"], ["", "c", "c"]),
        2: (["", "x", "", "y", ""], ["", "x", "y", "y", ""]),
        3: (["", "", "", ""], ["", "", "", ""]),
        4: (["p", "", "", "", "q"], ["p", "p", "q", "q", "q"]),
    }
    rows = [("o", b, k + 1, t) for b, (given, _) in cases.items() for k, t in enumerate(given)]
    df = spark.createDataFrame(rows, "owner_id string, cbatch long, cslot int, timestamp string")
    got = {(r.cbatch, r.cslot): r.prompt_ts for r in mem.nearest_timestamp(df).collect()}
    assert got == {(b, k + 1): t for b, (_, want) in cases.items() for k, t in enumerate(want)}


def test_ids_of_kinds_never_meet(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1 << 20, 1), (2 << 20, 1), (0, 1 << 20), (1, 0), ((1 << 36) - 1, (1 << 24) - 1)], "b long, r long")
    ids = [r[0] for r in df.select(mem.combined_id(F.col("b"), F.col("r"))).collect()]
    assert len(set(ids)) == len(ids) and all(1 << 61 <= i < 1 << 62 for i in ids)


def test_bank_round_trip(spark, tmpdir_path):
    bank = {
        "original_attributes": [{"attribute": "a", "citation": "Conversation 1", "timestamp": "t1", "Timestamp": "t2", "conversation_number": 1, "conversation_content": "text"},
                                {"attribute": "b", "citations": "c2", "Timestamp": "t3", "conversation_number": 20230515143000}],
        "combined_attributes": [{"attribute": "c", "based_on": "Attribute 1", "source_attributes": [{"attribute": "a"}]}],
        "inferred_attributes": [], "top_memories": [{"attribute": "d"}],
    }
    with open(f"{tmpdir_path}/ann.json", "w") as f:
        json.dump(bank, f)
    rows = mem.normalize_bank(exports.read_memory_bank(spark, tmpdir_path)).collect()
    got = sorted((r.owner_id, r.level, r.kind, r.pos, r.attribute, r.ts_text, r.citation_text, r.conversation_number, r.conversation_content) for r in rows)
    assert got == [("ann", 1, "original", 0, "a", "t1", "Conversation 1", 1, "text"), ("ann", 1, "original", 1, "b", "t3", "c2", None, None),
                   ("ann", 2, "combined", 0, "c", None, None, None, None), ("ann", 3, "top", 0, "d", None, None, None, None)]
    assert json.loads(next(r.entry["source_attributes"] for r in rows if r.kind == "combined")) == [{"attribute": "a"}]


def test_request_templates(spark):
    unified = spark.createDataFrame([("o", i, "Original Attribute", f"a{i}" if i < 3 else None, None) for i in (1, 2, 3)],
                                    "owner_id string, id long, type string, attribute string, citation string")
    got = mem.build_event_requests(unified, "Ann", chunk_size=2, template="{person} {chunk}/{total}: {json}").orderBy("batch_no").collect()
    heads, lists = zip(*(r.prompt.split(": ", 1) for r in got))
    assert heads == ("Ann 1/2", "Ann 2/2")
    assert [[(x["id"], x["content"]) for x in json.loads(t)] for t in lists] == [[(1, "a1"), (2, "a2")], [(3, "")]]
    packed = spark.createDataFrame([("o", 0, 2, "b", "c", "t"), ("o", 0, 1, "a", None, "t")],
                                   "owner_id string, cbatch long, cslot int, attribute string, citation string, prompt_ts string")
    got = mem.build_combine_requests(packed, "Ann", template="<{attrs}>").first()
    assert got.prompt == "<Attribute 1: a (Citation: , Timestamp: t)\nAttribute 2: b (Citation: c, Timestamp: t)>"


def test_views_recover_times_and_count_in_the_same_pass(spark, tmpdir_path):
    from pyspark.sql import Observation

    from chatlake.sources import exports
    bank = {
        "original_attributes": [{"attribute": "a", "Timestamp": "2024-01-01 10:00"}, {"attribute": "b", "citation": "on 2023-02-03 or Timestamp: 2022-01-01 9:30:00"}, {"attribute": "c"}],
        "combined_attributes": [{"attribute": "d", "source_attributes": [{"attribute": "x", "Timestamp": "no"}, {"timestamp": "2021-01-01 00:00:00"}], "citations": ["2020-01-01"]},
                                {"attribute": "e", "citations": ["none", "2019-05-06 it was, Timestamp: 2018-01-01 1:00", "Timestamp: 2017-01-01 1:00"]}],
        "inferred_attributes": [{"attribute": "f", "timestamp": ""}],
        "top_memories": [{"attribute": "g", "citation": "2016-01-01"}, {"attribute": "h", "Timestamp": "Summer"}]}
    with open(f"{tmpdir_path}/ann.json", "w") as f:
        json.dump(bank, f)
    rows = mem.normalize_bank(exports.read_memory_bank(spark, tmpdir_path))
    seen = Observation("seen")
    got = {r.attribute: (r.level, r.timestamp, r.citations) for r in mem.bank_view(rows, observation=seen).collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        "a": (1, "2024-01-01 10:00"), "b": (1, "2022-01-01 9:30:00"), "c": (1, ""), "d": (2, "2021-01-01 00:00:00"),
        "e": (2, "2018-01-01 1:00"), "f": (2, ""), "g": (3, None), "h": (3, "Summer")}
    assert got["c"][2] == "[]" and got["d"][2] == '["2020-01-01"]' and seen.get == {"kept": 8, "dropped": 0, "undated": 1}
    flat = Observation("flat")
    assert {r.attribute for r in mem.bank_view(rows, hierarchical=False, observation=flat).collect()} == {"d", "e", "f"}
    assert flat.get == {"kept": 3, "dropped": 5, "undated": 0}
    entries = rows.selectExpr("owner_id", "kind", "pos", "to_json(entry) as entry")
    exports.write_memory_bank(entries, f"{tmpdir_path}/out")
    back = mem.normalize_bank(exports.read_memory_bank(spark, f"{tmpdir_path}/out", lines=True))
    key = ["owner_id", "kind", "pos", "attribute", "ts_text"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, rows.select(*key).collect()))


def test_timeline_places_flags_and_drills(spark):
    bank = [(1, 1, "original", "2024-01-02 10:00:00", True), (2, 1, "original", "Summer 2023", False), (3, 1, "original", None, False),
            (10, 2, "combined", None, False), (11, 2, "inferred", None, False), (12, 2, "combined", "2024-01-02 10:00", False), (13, 2, "inferred", None, False),
            (20, 3, "top", "2030-01-01 00:00:00", False)]
    bank = spark.createDataFrame([("o", i, level, kind, f"m{i}", ts, has) for i, level, kind, ts, has in bank],
                                 "owner_id string, mem_id long, level int, kind string, attribute string, ts_text string, has_conv boolean")
    links = [(10, 0, 2, "Summer 2023", False), (10, 1, 1, "2024-01-02 10:00:00", True), (11, 0, 3, "x", False), (13, 0, 1, "2023-05-01 09:00", True), (13, 1, 1, "2023-05-01 09:00", True)]
    sources = spark.createDataFrame([("o", *x) for x in links], "owner_id string, mem_id long, ord int, source_mem_id long, source_ts string, source_has_conv boolean")
    rows = mem.timeline(bank, sources).orderBy("tl_index").collect()
    assert [(r.tl_index, r.mem_id, r.day, r.has_conversation) for r in rows] == [
        (0, 1, "2024-01-02", True), (1, 10, "2024-01-02", True), (2, 12, "2024-01-02", False), (3, 13, "2023-05-01", True), (4, 2, "0001-01-01", False)]
    assert [r.mem_id for r in mem.timeline(bank, sources, keep_undated=True, levels=(1, 2, 3)).orderBy("tl_index").collect()] == [20, 1, 10, 12, 13, 2, 3, 11]
    convs = spark.createDataFrame([("o", 1, "t", 0)], "owner_id string, mem_id long, thread_id string, conv_no int")
    turns = spark.createDataFrame([("o", "t", 0, 0, "hi"), ("o", "t", 0, 1, "yo"), ("o", "t", 1, 0, "no")], "owner_id string, thread_id string, conv_no int, turn_idx int, content string")
    got = sorted((r.mem_id, r.ord if r.ord is not None else -1, r.source_mem_id, r.content) for r in mem.drill_through(bank, sources, convs, turns).collect())
    assert got == [(1, -1, None, "hi"), (1, -1, None, "yo"), (10, 1, 1, "hi"), (10, 1, 1, "yo"), (13, 0, 1, "hi"), (13, 0, 1, "yo"), (13, 1, 1, "hi"), (13, 1, 1, "yo")]
