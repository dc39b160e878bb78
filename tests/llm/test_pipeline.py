"""The corpus pipeline: each stage against a brute-force version of its decision."""

import random

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from chatlake.llm import bpe, langid, quality, queries
from chatlake.llm.common import table

from test_small import brute_components, brute_simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, ids = docs.columns, lambda df: sorted(r.doc_id for r in df.collect())
    good = corpus_pipeline.quality_stage(spark, docs, SF).cache()
    model = queries.quality_model(spark, SF, docs)
    assert ids(good) == ids(quality.grade_documents(docs, model).filter("tail_prob >= 0.3"))
    known = corpus_pipeline.language_stage(spark, good, SF).cache()
    assert ids(known) == ids(langid.identify(good, queries.language_model(good)).filter("lang_pred <> 'und' and score >= 0.5"))
    one = corpus_pipeline.near_duplicate_stage(spark, known, SF).cache()
    rows = sorted((r.doc_id, r.text) for r in known.collect())
    root = brute_components([brute_simhash(t) for _, t in rows])
    assert ids(one) == sorted(rows[r][0] for r in set(root))
    clean = corpus_pipeline.decontamination_stage(spark, one, SF).cache()
    words = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    bench = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    whole = {r.doc_id for r in one.collect() if any(b in words(r.text) for b in bench)}
    assert not whole & set(ids(clean)) and set(ids(one)) - set(ids(clean)) >= whole
    assert good.columns == known.columns == one.columns == clean.columns == names
    rows = corpus_pipeline.encoding_stage(spark, clean, SF).collect()
    last = {r.doc_id: r.ids for r in rows}
    library = bpe.encoder(queries.word_vocabulary()).library
    assert last == {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in clean.collect()}
    assert all(r.text == library.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids) for r in rows)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(last)


def test_language_stage_drops_unlearned_languages_and_noise(spark):
    r = random.Random(1)
    docs = table(spark, SF, "documents")
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    foreign = ["wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "все люди рождаются свободными и равными в своем достоинстве",
               "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti", letters(60), letters(2000)]
    own = [x.text for x in docs.filter("lang = 'de' and n_chars > 300").limit(2).collect()]
    rows = [(10**6 + k, t, None, "s", len(t)) for k, t in enumerate([*foreign, own[0][:60], own[1] + " key 9dd3c80004c73dc9e548fee51a0b7c2d4761598977407687"])]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {x.doc_id for x in corpus_pipeline.language_stage(spark, both, SF).collect()}
    assert {k for k in kept if k >= 10**6} == {10**6 + len(foreign), 10**6 + len(foreign) + 1}
    assert len([k for k in kept if k < 10**6]) >= 0.98 * docs.count()
    with pytest.raises(ValueError):
        langid.keep_known(docs, queries.language_model(docs), 0.5)


def test_registered_queries_run(spark):
    registered = entry.queries()
    assert set(queries.REGISTRY) | {"pipeline"} <= set(registered) and len(queries.REGISTRY) == 13
    for name in ("op1_bpe", "op2_urls", "op8_quality"):
        assert registered[name](spark, SF).count() > 0
