"""Queries over tables of the test's own, of the shapes that larger inputs have: folders of files, long keys, long threads."""

import datetime
import glob
import os
import re
import tracemalloc

import numpy as np

from chatlake.operators import examples, memory, retrieval
from chatlake.plans import catalog
from chatlake.sources import exports


def write_table(rows, sf_dir, name, files=1):
    rows.repartition(files).write.mode("overwrite").parquet(f"{sf_dir}/{name}.parquet")


def customers(spark, sf_dir, keys):
    write_table(spark.createDataFrame([(k, f"Customer {k}") for k in keys], "c_custkey long, c_name string"), sf_dir, "customer")


def events(spark, sf_dir, rows, files=1):
    """``rows``: (event_id, seconds, user_id, event_type, value)."""
    start = datetime.datetime(2024, 1, 1)
    data = [(i, start + datetime.timedelta(seconds=s), u, kind, v, "{}") for i, s, u, kind, v in rows]
    write_table(spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"), sf_dir, "events", files)


def test_streams_read_tables_that_are_folders(spark, tmpdir_path):
    texts = [(k, f"call +1 (2{k}0) 555-00{k}{k} or +1 (999) 555-0100" if k % 2 else "no number") for k in range(1, 9)]
    write_table(spark.createDataFrame(texts, "doc_id long, text string"), tmpdir_path, "documents", 3)
    customers(spark, tmpdir_path, range(100))
    want = catalog.REGISTRY["phone_resolve"](spark, tmpdir_path).select("doc_id", "resolved")
    got = catalog.REGISTRY["stream_resolve"](spark, tmpdir_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 8
    events(spark, tmpdir_path, [(k, 60 * k, k % 3, ("click", "view")[k // 4 % 2], float(k)) for k in range(40)], 3)
    want, got = (catalog.REGISTRY[name](spark, tmpdir_path) for name in ("merge_turns", "stream_turns"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 3


def test_stream_resolve_of_no_documents(spark, tmpdir_path):
    write_table(spark.createDataFrame([], "doc_id long, text string"), tmpdir_path, "documents")
    customers(spark, tmpdir_path, range(3))
    assert catalog.REGISTRY["stream_resolve"](spark, tmpdir_path).count() == 0


def test_contact_files_of_users_with_one_number(spark, tmpdir_path):
    keys = [1234, 12340, 12342, 7, 8]  # a number has four digits of the key
    customers(spark, tmpdir_path, [*keys, 8])
    events(spark, tmpdir_path, [(i, i, u, "view", 1.0) for i, u in enumerate(keys)])
    got = sorted(map(tuple, catalog.REGISTRY["contact_files"](spark, tmpdir_path).collect()))
    assert got == [("o 4", "+12125551234", "Customer 1234"), ("o 4", "+12125551234", "Customer 12340"), ("o 4", "+12125551234", "Customer 12342"),
                   ("o 8", "+12125550008", "Customer 8"), ("o 8", "+12125550008", "Customer 8")]


def test_files_are_written_by_many_tasks_and_small_ones_read_once(spark, tmpdir_path, monkeypatch):
    lines = spark.createDataFrame([(f"t{k % 40}", k, f"line {k}") for k in range(400)], "thread string, line_no long, value string")
    path = catalog._text_files(lines, spark, "many", ["thread"], ["line_no"])
    written = glob.glob(f"{path.removeprefix('file:')}/thread=*/part-*")
    assert len(written) == 40 and len({os.path.basename(f)[:10] for f in written}) > 4  # AQE would leave one task for so few bytes
    listed = spark.conf.get(exports.LISTING)
    reads = {}
    usual = exports.WHOLE_FILE
    for most in (usual, 20):  # with 20 bytes, every file is a big one
        monkeypatch.setattr(exports, "WHOLE_FILE", most)
        rows = exports.read_text_lines(spark, path, owner_id="me")
        reads[most] = sorted(map(tuple, rows.select("thread_id", "line_no", "value").collect()))
    assert reads[20] == reads[usual] and len(reads[20]) == 400
    assert [v for t, n, v in reads[20] if "thread=t7/" in t] == [f"line {k}" for k in range(7, 400, 40)]
    assert spark.conf.get(exports.LISTING) == listed


def test_responses_are_parsed_once(spark):
    rows = [("o", "combine", b, "COMBINED ATTRIBUTES:\n- Attribute: a\n- Based on: Attribute 1\nAttribute: b\nINFERRED ATTRIBUTES:\nAttribute: c") for b in (1, 2)]
    rows += [("o", "combine", None, rows[0][3]), ("o", "combine", 3, None), ("o", "combine", 4, "Attribute: x")]
    parsed = memory.parse_combined(spark.createDataFrame(rows, "owner_id string, stage string, batch_no long, text string"))
    assert sorted(map(tuple, parsed.drop("owner_id", "stage").collect())) == [
        (b, k, *row) for b in (1, 2) for k, row in enumerate((("combined", "a", "Attribute 1"), ("inferred", "b", None), ("inferred", "c", "")), 1)]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_a_full_block_of_memories_is_scored_in_bounded_memory():
    rng, width = np.random.default_rng(3), 64
    rows = retrieval.MEMORY_BLOCK_BYTES // (8 * width)
    queries, vectors, recency = rng.standard_normal((8, width)), rng.standard_normal((rows, width)), rng.random(rows)
    tracemalloc.start()
    try:
        row, mid, score, _ = retrieval.block_topk(queries, vectors, np.arange(rows), recency, 6, 0.15)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    cosine = queries @ vectors.T / np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1))
    want = np.argsort(-(0.85 * cosine + 0.15 * recency), axis=1)[:, :6]
    assert mid.reshape(8, 6).tolist() == want.tolist()
    assert peak < 100 << 20, peak


def test_examples_with_prior_conversations_work_out_their_features_once(spark, tmpdir_path):
    gap = 7 * 3600
    rows = [(c * 10 + k, c * gap + 60 * k, 1, ("view", "click")[k % 2], float(c * 10 + k)) for c in range(4) for k in range(6)]
    events(spark, tmpdir_path, rows)
    turns = catalog.events_turns(spark, tmpdir_path)
    told = examples.render_examples(examples.example_features(turns, buffer=2), turns, buffer=2, survivors_only=False)
    assert "Window" not in told._jdf.queryExecution().optimizedPlan().toString()  # before, they were in the plan three times
    got = {(r.conv_no, r.turn_idx): r.input for r in told.collect()}
    assert sorted(got) == [(c, k) for c in range(4) for k in (1, 3, 5)]
    assert got[0, 1] == "Current conversation:\n[2024-01-01 00:00:00] view: view 0.00\n[2024-01-01 00:01:00] Me: "
    assert "view 30." not in got[2, 5] and all(f" {c * 10 + k}.00" in got[3, 5] for c, last in ((1, 6), (2, 6), (3, 5)) for k in range(last)) and " 0.00" not in got[3, 5]


def test_a_day_of_the_timeline_is_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(memory, "DAY_BLOCK", 4, raising=False)
    texts = {("o", "d1"): [f"m{k}" for k in range(11)], ("o", "d0"): [None, "", None, "x", *[None] * 8, "é | ", ""], ("o", None): ["n"],
             ("p", "d1"): [None] * 6, (None, "d1"): ["", *["y"] * 5], ("p", "d0"): ["", None, ""]}
    first = {("o", "d0"): 11, ("o", None): 25, ("p", "d0"): 6}
    rows = [(*key, first.get(key, 0) + k, text) for key, of in texts.items() for k, text in enumerate(of)]
    tl = spark.createDataFrame(rows, "owner_id string, day string, tl_index long, attribute string").repartition(5, "attribute", "tl_index")
    days = memory.timeline_days(tl)
    want = [(*key, len(of), " | ".join(t for t in of if t is not None)) for key, of in texts.items()]
    assert sorted(map(tuple, days.collect()), key=str) == sorted(want, key=str)
    assert days.dtypes == [("owner_id", "string"), ("day", "string"), ("n_memories", "bigint"), ("attributes", "string")]
    plan = days._jdf.queryExecution().executedPlan().toString()
    held = re.findall(r"Aggregate\(keys=\[(.*?)\], functions=\[(?:partial_)?(?:\w+\(.*?, )*(?:partial_)?collect_list", plan)
    assert held and all(len(keys.split(", ")) == 3 for keys in held)  # by owner, day and block: no task collects the rows of a day
    assert memory.timeline_days(tl.limit(0)).count() == 0


def test_memories_without_a_time_are_ranked_by_many_tasks(spark, monkeypatch):
    seen, dense_numbers = [], exports.dense_numbers

    def spy(df, key, chunk, order, out):
        seen.append(sorted(r[0] for r in df.groupBy(*key, chunk).count().select("count").collect()))
        return dense_numbers(df, key, chunk, order, out)

    monkeypatch.setattr(memory, "dense_numbers", spy)
    ids = [k * 20_000 + 1 for k in range(30)]
    made = [((1 << 61) + (k * 300 << 24) + 1, 2, ("inferred", "combined")[k % 2], None) for k in range(8)]
    bank = [("o", i, level, kind, f"m{i}", ts, False) for i, level, kind, ts in [*[(i, 1, "original", "Summer") for i in ids], *made, (7, 1, "original", "2024-01-02 10:00")]]
    bank = spark.createDataFrame(bank, "owner_id string, mem_id long, level int, kind string, attribute string, ts_text string, has_conv boolean").repartition(4)
    sources = spark.createDataFrame([], "owner_id string, mem_id long, ord int, source_mem_id long, source_ts string, source_has_conv boolean")
    rows = memory.timeline(bank, sources, keep_undated=True).orderBy("tl_index").collect()
    of_kind = lambda kind: [m[0] for m in made if m[2] == kind]
    assert [(r.tl_index, r.mem_id) for r in rows] == [*enumerate([7, *ids, *of_kind("combined"), *of_kind("inferred")])]
    assert max(seen[0]) <= 4 and len(seen[0]) > 10
