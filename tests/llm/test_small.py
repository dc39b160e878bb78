"""Operators on small tables: brute-force versions, nulls, empty tables, ties and clashing columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from chatlake.llm import bpe, common, counts, decontam, langid, lattice, minhash, quality, queries, simhash, tokenfiles, urls

WORDS = ["alpha", "beta", "gamma", "delta", "Été", "naïve", "don't", "x1", "|", "日本", "the", "of"]


def texts(n=60, seed=1):
    r = random.Random(seed)
    out = [None, "", " \n\t", "one", "One two", "a" * 5000, "<|endoftext|> x", "tab\x1cbed \x85 y", "ß ½ ²"]
    for _ in range(n):
        out.append(r.choice([" ", "\n", "  "]).join(r.choice(WORDS) + r.choice(["", ",", ".", "s"]) for _ in range(r.randint(1, 80))))
    out += out[9:14] + [out[20] + " tail", out[20].replace("the", "of", 1)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * k, t, ["en", "fr", None][k % 3], "s", None) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "null id here", "en", None, 1), rows[12]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns named like those that operators add."""
    extra = ["fp", "keep", "mark", "c0", "rows", "block", "code", "k", "features", "seq", "kind"]
    return docs.select("*", *[F.lit("z").alias(c) for c in extra])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# -- 1 ------------------------------------------------------------------------------------------

def test_bpe_equals_the_library(docs):
    path = queries.word_vocabulary()
    library, own = Tokenizer.from_file(path), bpe.encoder(path)
    r = random.Random(2)
    alphabet = "aAbé'sST 19.́ \n<|>endoftext日ßİ가가½👍\x1cΣ\u2003"
    odd = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for t in [x or "" for x in texts()] + odd + ["aaaa" * 50, "I'LL 's"]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    want = sorted(((i, len(e := library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(),
                    hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()) for i, t in pairs_of(docs)), key=repr)
    assert by_row(bpe.digest_documents(docs, path)) == want


def test_bpe_frames(docs, clashing, empty):
    path = queries.word_vocabulary()
    ids = bpe.encode_documents(clashing, path)
    assert by_row(ids.select("doc_id", F.size("ids").cast("long"))) == by_row(bpe.digest_documents(docs, path).select("doc_id", "n_tokens"))
    back = dict((r.doc_id, r.text) for r in bpe.decode_documents(ids, path).collect())
    assert back[0] == "" and back[9] == "one</w>"
    assert bpe.encode_documents(empty, path).count() == 0 and bpe.digest_documents(empty, path).count() == 0


def test_forced_cuts_are_in_no_token():
    own = bpe.encoder(queries.word_vocabulary())
    ids, _ = own.merge(own.inner[np.frombuffer(b"thezz", np.uint8)], np.zeros(5, np.int32))
    assert "".join(own.token[i] for i in ids.tolist()) == "thezz"
    assert not own.mergeable[ord("z") * 256 + 0x20] and own.mergeable[ord("t") * 256 + ord("h")]


# -- 2 ------------------------------------------------------------------------------------------

def test_url_rules_and_reputation(spark):
    rows = [(1, "http://A.org/x?y"), (2, "http://a.org"), (3, None), (4, "no scheme"), (5, "http://s.example.org/es/1"), (6, "http://example.org/en/12"),
            (7, "https://w.com/fr/#z"), (8, "https://w.com/de/"), (9, "http://w.com/it"), (10, "x://h/p://q/"), (11, "http://É.COM/Fr/")]
    rows += [(100 + k, f"http://bad{k % 3}.net/{k}") for k in range(60)] + [(200 + k, f"http://good{k % 3}.net/{k}") for k in range(60)] + [(300, "http://new.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + k, 0) for k in range(60)] + [(200 + k, 1) for k in range(60)] + [(None, 1), (1, None)], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, outcomes, queries.URL_RULES).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2][:3] == ("a.org", "", None) and got[3] == ("", "", None, "allow") == got[4]
    assert got[5][2:] == ("example.org/es/", "block") and got[6][2:] == ("example.org/en/1", "block")
    assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block") and got[9][2:] == (None, "allow")
    assert got[10][:2] == ("h", "/p://q/") and got[11][:3] == ("É.com", "/Fr/", None)
    assert {got[100 + k][3] for k in range(60)} == {"block"} and {got[200 + k][3] for k in range(60)} == {"allow"} and got[300][3] == "allow"
    assert urls.judge(pages.limit(0), outcomes, queries.URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(pages, outcomes.limit(0), []).collect()} == {"allow"}
    means = {r.host: r["mean"] for r in urls.reputation(pages.select("page_id", urls.url_parts(F.col("url"))[0].alias("host")), outcomes).collect()}
    assert 0 < means["bad0.net"] < means["new.net"] < means["good0.net"] < 1  # shrunk towards the domain


def test_domains_under_suffixes_of_several_labels(spark):
    cut = lambda hosts, *more: {r.host: (r.domain, r.suffix) for r in urls.with_domain(spark.createDataFrame([(h,) for h in hosts], "host string"), *more).collect()}
    assert cut(["a.b.spam.co.uk:80", "spam.co.uk", "co.uk", "x.github.io", "w.a.com", "com", "", "10.0.0.1", "b.example.uk"]) == {
        "a.b.spam.co.uk:80": ("spam.co.uk", "co.uk"), "spam.co.uk": ("spam.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.github.io": ("x.github.io", "github.io"),
        "w.a.com": ("a.com", "com"), "com": ("com", "com"), "": ("", ""), "10.0.0.1": ("10.0.0.1", "1"), "b.example.uk": ("example.uk", "uk")}
    listed = spark.createDataFrame([("*.ck",), ("!www.ck",), ("k12.ca.us",), ("ca.us",), (None,), ("ca.us",)], "suffix string")
    assert cut(["s.a.x.ck", "y.www.ck", "s.pal.k12.ca.us", "s.q.ca.us", "a.b.co.uk"], listed) == {
        "s.a.x.ck": ("a.x.ck", "x.ck"), "y.www.ck": ("www.ck", "ck"), "s.pal.k12.ca.us": ("pal.k12.ca.us", "k12.ca.us"), "s.q.ca.us": ("q.ca.us", "ca.us"), "a.b.co.uk": ("co.uk", "uk")}
    rows = [(k, f"http://a{k % 4}.spam.co.uk/{k}", 0) for k in range(80)] + [(100 + k, f"http://w{k % 9}.fine{k % 7}.co.uk/", 1) for k in range(300)]
    rows += [(900, "http://a9.spam.co.uk/", None), (901, "http://x.co.uk/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good int")
    got = {r.page_id: r.verdict for r in urls.judge(pages.select("page_id", "url"), pages.select("page_id", "good"), []).collect()}
    assert got[900] == got[0] == "block" and got[901] == got[100] == "allow"


# -- 3 ------------------------------------------------------------------------------------------

def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_minhash_edits(docs, clashing, empty, spark):
    plain = docs.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    rows = sorted(pairs_of(plain), key=lambda x: -x[0])
    got = {r.doc_id: r for r in minhash.fingerprint_edits(plain).collect()}
    assert len(got) == len(rows)
    error = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edit = t[:len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert got[i].near_next == pytest.approx(np.mean([a == b for a, b in zip(*(re.findall("....", got[j].fingerprint) for j in (i, rows[(k + 1) % len(rows)][0])))]))
        a, b = shingle_set(t), shingle_set(edit)
        error.append(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1))
    assert max(map(abs, error)) < 0.25 and abs(np.mean(error)) < 0.03
    same = {}
    for i, t in rows:
        assert same.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert minhash.fingerprint_edits(clashing).count() == docs.count() and minhash.fingerprint_edits(empty).count() == 0
    one = minhash.fingerprint_edits(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 3


def test_minhash_links(docs):
    near = docs.sparkSession.createDataFrame([(1000 + k, " ".join(f"w{j}" for j in range(100)) + f" end{k}") for k in range(5)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(near)
    member, links = minhash.near_duplicates(both)
    of = {r.class_id: None for r in member.collect()}
    for r in member.join(both, "doc_id").collect():
        of[r.class_id] = frozenset(shingle_set(r.text))
    sets = [(c, s) for c, s in of.items() if s]
    want = {(min(a, b), max(a, b)) for k, (a, s) in enumerate(sets) for b, u in sets[k + 1:] if len(s & u) / len(s | u) >= 0.8}
    assert len(want) >= 10 and {(r.a, r.b) for r in links.collect()} == want


# -- 4 ------------------------------------------------------------------------------------------

def test_counts_follow_random_edits():
    c = counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(3)
    alphabet = "ab é'sT 1.  \n\t\u2003\u3000日\x1c\x85 x"
    draw = lambda sizes: "".join(r.choice(alphabet) for _ in range(r.choice(sizes)))
    for _ in range(200):
        text = draw([0, 5, 50, 900])
        tree = counts.TokenTree(c, text)
        for _ in range(12):
            at, gone, new = r.randint(0, len(text) + 2), r.choice([0, 1, 3, 30, 400]), draw([0, 1, 4, 40])
            place = min(at, len(text))
            text = text[:place] + new + text[place + gone:]
            tree.edit(at, gone, new)
            assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, len(text), len(c.encoding.encode_ordinary(text)))
    long = counts.TokenTree(c, "word " * 20_000)
    long.edit(50_000, 3, "x")
    assert long.encoded < 500


def test_count_edits(spark, docs, clashing, empty):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    edits = queries.document_edits(docs.dropDuplicates(["doc_id"])).unionByName(
        spark.createDataFrame([(0, 9, None, None, None), (99999, 1, 0, 0, "x"), (None, 1, 0, 0, "x")], "doc_id long, seq int, position long, n_delete long, insert string"))
    got = by_row(counts.count_edits(clashing, edits, *args))
    c = counts.counter(*args).encoding
    n = lambda t: len(c.encode_ordinary(t))
    todo = {}
    for e in sorted(edits.collect(), key=lambda e: (e.doc_id or -1, e.seq)):
        todo.setdefault(e.doc_id, []).append(e)
    want, seen = [], set()
    for i, t in pairs_of(docs):
        t = new = t or ""
        mine = todo.get(i, []) if i is not None and i not in seen else []
        seen.add(i)
        for e in mine:
            p = e.position or 0
            new = new[:p] + (e.insert or "") + new[p + (e.n_delete or 0):]
        want.append((i, n(t), len(mine), n(new), len(new)))
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert counts.count_edits(empty, edits, *args).count() == 0


# -- 5 ------------------------------------------------------------------------------------------

def brute_bits(counts_of, text):
    """Code length by walking the contexts: orders 3 to 0, escapes by the number of different bytes."""
    data, bits = b"\n\n\n" + text.encode(), 0.0
    for k in range(3, len(data)):
        for order in (3, 2, 1, 0):
            seen = counts_of(data[k - order:k], order)
            if seen is None or not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[k] in seen:
                bits -= math.log2(seen[data[k]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_ppm_lengths_and_predictions(spark, docs, empty):
    sample = {"xx": ["aba abba baab abab"] * 3, "yy": ["the cat thé", "that hat"]}
    built = []
    for name in sorted(sample):
        data, at = langid.padded(pa.array(sample[name]))
        built.append(np.unique(langid.windows(data, at)[0], return_counts=True))
    model = langid.build(sorted(sample), built)
    total = {}
    for name in sample:
        for t in sample[name]:
            data = b"\n\n\n" + t.encode()
            for k in range(3, len(data)):
                total[data[k - 3:k]] = total.get(data[k - 3:k], 0) + 1
    probes = ["abba", "the hat", "", "zz日", "thé abab"]
    got = model.lengths(pa.array(probes))
    for col, name in enumerate(sorted(sample)):
        seen = {}
        for t in sample[name]:
            data = b"\n\n\n" + t.encode()
            for k in range(3, len(data)):
                for order in range(4):
                    own = seen.setdefault(data[k - order:k], {})
                    own[data[k]] = own.get(data[k], 0) + 1
        counts_of = lambda c, order: seen.get(c) if order < 3 or total.get(c, 0) >= langid.LEAST_SEEN else None  # noqa: E731, B023
        for row, t in enumerate(probes):
            assert got[row, col] == pytest.approx(brute_bits(counts_of, t), rel=1e-4, abs=1e-3)
    trained = langid.train(docs)
    assert trained.languages == ["en", "fr"]
    out = {r.doc_id: r for r in langid.identify(docs, trained).collect()}
    assert out[0].lang_pred == out[3].lang_pred == "und" and out[0].score == 0 and 0.5 <= out[30].score <= 1
    assert {r.lang_pred for r in langid.identify(docs, langid.train(empty)).collect()} == {"und"} and langid.identify(empty, trained).count() == 0


# -- 6 ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("top", [2, 200, 49_000, 1 << 32])
def test_range_coder_round_trip(top):
    r = np.random.default_rng(4)
    part = np.zeros(1, tokenfiles.PART)
    for sizes in ([1], [300, 300, 7], [500] * 20):
        blocks = [(part, (r.zipf(1.2, n) % top if k % 2 else r.integers(0, top, n)).astype(np.uint32)) for k, n in enumerate(sizes)]
        coded = tokenfiles.encode_blocks(blocks)
        for (_, a), (_, b) in zip(blocks, tokenfiles.decode_blocks(coded)):
            assert (a == b).all()
    assert (tokenfiles.decode_blocks(coded[7:8])[0][1] == blocks[7][1]).all()  # each on its own
    for broken in (coded[0][:-1], coded[0][:-1] + bytes([coded[0][-1] ^ 1]), b"", b"XXXX" + coded[0][4:]):
        with pytest.raises(ValueError):
            tokenfiles.decode_blocks([broken])


def test_token_files(spark, docs, clashing, empty):
    path = queries.word_vocabulary()
    library = Tokenizer.from_file(path)
    plain = docs.dropDuplicates(["doc_id"])
    want, at = [], 0
    for i, t in sorted(pairs_of(plain), key=lambda x: -1 if x[0] is None else x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for block, lanes in ((tokenfiles.BLOCK, tokenfiles.LANES), (16, 4), (5, 3)):
        files = tokenfiles.write_documents(plain, path, 2, block, lanes)
        assert by_row(tokenfiles.read_documents(files)) == sorted(((*w[:3], bytearray(w[3])) for w in want), key=repr)
        assert by_row(tokenfiles.read_documents(files, digest=True)) == sorted(((*w[:3], zlib.crc32(w[3])) for w in want), key=repr)
    assert tokenfiles.read_documents(tokenfiles.write_documents(clashing, path, 2)).count() == docs.count()
    assert tokenfiles.read_documents(tokenfiles.write_documents(empty, path, 2)).count() == 0


# -- 7 ------------------------------------------------------------------------------------------

def test_lattice_sums_all_segmentations():
    known = lattice.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    logs, at = np.log(known.prior), {p: k for k, p in enumerate(known.text)}

    def brute(word):
        text, ways = b" " + word, [1.0]
        for e in range(1, len(text) + 1):
            ways.append(sum(ways[b] * math.exp(logs[at[text[b:e]]]) for b in range(e) if text[b:e] in at))
        return math.log(ways[-1])

    words = [b"the", b"thanonnd,", "été".encode(), b"a", b"\x00\xff", b"x" * 40]
    own = lattice.Lattice(known, words)
    assert own.totals(logs) == pytest.approx([brute(w) for w in words])
    expected, base = own.expected(logs, np.ones(len(words))), own.totals(logs).sum()
    for piece in (b" the", b"a", b"x", b" "):  # expected counts are the slopes of the log probability
        more = logs.copy()
        more[at[piece]] += 1e-6
        assert expected[at[piece]] == pytest.approx((own.totals(more).sum() - base) / 1e-6, abs=1e-3)


def test_lattice_documents(docs, clashing, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    train = queries.fold("doc_id", 7) != 2
    got = by_row(lattice.score_documents(clashing, train, path).drop("score"))
    tokens = [(i, (t or "").encode().lower().split()) for i, t in pairs_of(docs)]
    learned = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in tokens]
    c = {}
    for ok, (_, ws) in zip(learned, tokens):
        for w in ws if ok else ():
            c[w] = c.get(w, 0) + 1
    ends = sum(learned)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = sorted(((i, ok, len(ws) + 1, sum(w in c for w in ws) + 1, n, sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1)))
                   for ok, (i, ws) in zip(learned, tokens)), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want] and [g[5] for g in got] == pytest.approx([w[5] for w in want])
    untrained = lattice.score_documents(docs, F.lit(False), path).collect()
    assert {r.base_score for r in untrained} == {0.0} and all(r.score < 0 for r in untrained)
    assert lattice.score_documents(empty, train, path).count() == 0


# -- 8 ------------------------------------------------------------------------------------------

def test_ordinal_fit_and_grades(spark, docs, empty):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(["awful", "mid", "fine"][k % 3:k % 3 + 1] + WORDS) for _ in range(12)), k % 3) for k in range(300)]
    graded = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.train(graded.select("doc_id", "text"), graded.filter("doc_id % 2 = 0").select("doc_id", "grade"))
    got = {x.doc_id: x for x in quality.grade_documents(graded, model).collect()}
    mean = [np.mean([got[k].expected_grade for k in range(1, 300, 2) if k % 3 == g]) for g in range(3)]
    assert mean[0] < 0.5 and 0.5 < mean[1] < 1.5 and mean[2] > 1.4 and (np.diff(model.thresholds) > 0).all()
    assert all(0 <= x.tail_prob <= 1 and x.keep == (x.tail_prob >= quality.KEEP_TAIL) for x in got.values())
    kept = {x.doc_id for x in quality.keep_good(graded.withColumn("keep", F.lit(1)), model).collect()}
    assert kept == {k for k, x in got.items() if x.keep}
    plain = quality.train(empty, graded.select("doc_id", "grade"))  # no text: thresholds of no counts
    assert not plain.weights.any() and quality.grade_documents(docs, plain).count() == docs.count() and quality.grade_documents(empty, model).count() == 0
    assert len({x.tail_prob for x in quality.grade_documents(docs.filter("text is null or text = ''"), model).collect()}) == 1
    assert by_row(spark.createDataFrame([(0, 1), (1, 1), (1, None), (1, 0), (None, 1)], "quality int, toxic int").select(quality.label_grade())) == [(0,), (1,), (2,), (2,), (None,)]


def test_rare_insults_go_and_clean_texts_stay(spark):
    r = random.Random(9)
    plain = [f"w{k}" for k in range(300)]
    rude = [f"insult{k}" for k in range(10)]
    rows = []
    for k in range(4000):
        grade = 0 if k % 7 == 0 else 1 if k % 10 == 1 else 2
        words = [r.choice(plain) for _ in range(60)]
        if grade == 1:
            words[r.randrange(60)] = r.choice(rude)  # its only sign: a word that about 40 rows have
        if grade == 0:
            words[10:30] = ["junk"] * 20
        rows.append((k, " ".join(words), grade))
    graded = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.train(graded.select("doc_id", "text"), graded.filter("doc_id < 3000").select("doc_id", "grade"))
    kept = {x.doc_id for x in quality.grade_documents(graded, model).filter("keep").collect()}
    share = [np.mean([k in kept for k, _, g in rows[3000:] if g == of]) for of in range(3)]
    assert share[0] < 0.05 and share[1] < 0.2 and share[2] > 0.95
    assert kept == {x.doc_id for x in quality.keep_good(graded, model).collect()}
    assert quality.choose_cut(np.array([0.9] * 200), np.array([True] * 180 + [False] * 20)) == quality.KEEP_TAIL  # too few to choose


# -- 9 ------------------------------------------------------------------------------------------

def test_masks_leave_a_seed_untouched():
    places = [(m, o) for m in decontam.MASKS for o in range(decontam.WINDOW - m[-1])]
    for a in range(decontam.WINDOW):
        for b in range(a + 1, decontam.WINDOW):
            assert any(a - o not in m and b - o not in m for m, o in places)


def test_contaminated(spark, docs, empty):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (30, 13, 5, 1, 40)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "..."), (4, " ".join(items[4]))], "item_id long, text string")
    filler = lambda n: [word() for _ in range(n)]
    change = lambda w, at: [x + "q" if k in at else x for k, x in enumerate(w)]
    cases = {
        1: (filler(50) + items[0] + filler(50), {0}), 2: (filler(9) + change(items[0][5:18], {3, 8}) + filler(9), {0}), 3: (filler(9) + change(items[0][5:18], {3, 8, 11}) + filler(9), set()),
        4: (items[1], {1}), 5: (change(items[1], {0, 12}), {1}), 6: (items[1][:12], set()), 7: (filler(3) + items[2], {2}), 8: (change(items[2], {1}), set()), 9: (filler(2) + items[3] + filler(2), {3}),
        10: (items[4] + items[0], {0, 4}), 11: (items[0][:10] + filler(3) + items[0][15:25] + filler(3), set()),
    }
    table = spark.createDataFrame([(k, ", ".join(w).upper() if k == 1 else " ".join(w)) for k, (w, _) in cases.items()] + [(1, " ".join(filler(8)))] * 2 + [(None, " ".join(items[0]))], "doc_id long, text string")
    table = table.unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    found = decontam.contaminated(table, bench, least=1).collect()  # of one word, too
    assert {(x.doc_id, x.item_id) for x in found} == {(k, i) for k, (_, own) in cases.items() for i in own} | {(None, 0)}
    assert {(x.n_equal, x.n_span, x.n_item) for x in found if x.doc_id in (1, 2)} == {(30, 30, 30), (11, 13, 30)}
    left = decontam.keep_clean(table.withColumn("mark", F.lit(1)), bench, least=1)
    assert left.columns == ["doc_id", "text", "mark"]
    assert sorted(x.doc_id for x in left.filter("doc_id < 1000").collect()) == [1, 1, 3, 6, 8, 11]
    assert left.filter("doc_id is null").count() == 1  # the null id of ``docs``, not the copy of item 0
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(table, bench.limit(0)).count() == 0


# -- 10 -----------------------------------------------------------------------------------------

def brute_simhash(text, n=4):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    least = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    least[a] = least[b] = min(least[a], least[b])
    return least


def test_simhash(spark, docs, clashing, empty):
    rows = sorted(pairs_of(docs), key=lambda x: (x[0] is None, x[0]))
    prints = [brute_simhash(t) for _, t in rows]
    root = brute_components(prints)
    want = sorted(((i, f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, root)), key=repr)
    assert by_row(simhash.near_duplicates(clashing)) == want
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((rows[r][0] for r in set(root)), key=repr)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_simhash_links_of_dense_and_split_groups(spark, monkeypatch):
    r = random.Random(7)
    prints = {r.getrandbits(64) for _ in range(30)}
    for p in list(prints)[:6]:
        for _ in range(12):
            p ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))  # chains of links
            prints.add(p)
    prints = sorted(prints)
    want = brute_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    for cell in (1024, 4):
        monkeypatch.setattr(simhash, "CELL", cell)
        of = {x.fp: x.root for x in simhash.groups_of(table, 4).collect()}
        groups = {}
        for k, p in enumerate(signed):
            groups.setdefault(of[p], set()).add(want[k])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_components_of_a_path_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (2000, 1999)]
    r = random.Random(8)
    edges = [e if r.random() < 0.5 else e[::-1] for e in edges]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(101)}, **{1000 + k: 1000 for k in range(50)}, 1999: 1999, 2000: 1999}
    assert common.components(spark.createDataFrame([], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))).count() == 0


@pytest.mark.parametrize("high", [40, 3000, 1 << 32])
def test_choices_of_whole_blocks_are_those_made_step_by_step(high):
    r = np.random.default_rng(high % 97)
    ids = (r.integers(0, high, (40, 300)) >> r.integers(0, 3, (40, 300))).astype(np.uint32).view(np.int32)
    got, model = tokenfiles._choices(ids), tokenfiles._Model(len(ids), guessing=True)
    for t in range(ids.shape[1]):
        guess, row = model.predict(len(ids))
        hit = (guess == ids[:, t]) & (guess >= 0)
        assert (got[:, t] == 2 * (row - model.base_row) + hit).all()
        model.take(len(ids), ids[:, t].astype(np.int64), hit)


def test_words_beyond_the_bound_are_those_of_the_last_call(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 4)
    enc = bpe.ForcedBoundaryBPE(queries.word_vocabulary())
    for text in ("alpha beta", "beta gamma delta", "alpha the of x1 beta", "the the alpha"):  # known words stay, others come and go
        ids, at = enc.arrays(pa.array([text, None, text]))
        want = enc.library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and at.tolist() == [0, len(want), len(want), 2 * len(want)]
    assert enc.held[0].to_pylist() == [b"the", b"alpha"]


def test_tasks_give_their_memory_back():
    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    kept = []

    def run(batches):
        for batch in batches:
            held = [bytearray(50_000) for _ in range(4000)]
            kept.extend(held[::40])  # what stays lies among what goes
            yield batch

    task = common.mapped(Frame(), run, "x long")
    start = resident()
    assert list(task(iter([1, 2]))) == [1, 2]
    assert resident() - start < 100 << 20  # without giving back: 200 MB and more


class MapOnly:
    """Stands for a table; mapInArrow gives the function that a task runs."""

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_documents_are_encoded_a_megabyte_at_a_time():
    r = random.Random(3)
    rows = [" ".join(r.choice(WORDS) for _ in range(2000)) for _ in range(400)]
    task = bpe.encode_documents(MapOnly(), queries.word_vocabulary(), decoded=True)
    out = list(task(iter([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(rows)], ["doc_id", "text"])])))
    assert sum(map(len, map(str.encode, rows))) > 3 << 20 and len(out) >= 3  # all at once before
    library = bpe.encoder(queries.word_vocabulary()).library
    assert [x for b in out for x in b.column("doc_id").to_pylist()] == list(range(400))
    assert out[-1].column("ids").to_pylist()[-1] == library.encode(rows[-1], add_special_tokens=False).ids


def test_language_tables_are_built_some_rows_at_a_time(monkeypatch):
    r = np.random.default_rng(5)
    value = np.unique(r.integers(0, 100, (60_000, 4)).astype(np.uint8).view(np.uint32).ravel())
    counts = [(value, r.integers(1, 9, len(value))), (value[::3], r.integers(1, 9, len(value[::3])))]
    tracemalloc.start()
    model = langid.build(["a", "b"], counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    table = model.cost.nbytes  # of floats for two languages: as large as a table of counts of one
    assert peak < 3.5 * table  # 5.8 before
    monkeypatch.setattr(langid, "COST_ROWS", 1 << 30)
    assert (langid.build(["a", "b"], counts).cost == model.cost).all()
