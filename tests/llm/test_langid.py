import os
import random

import pytest

from lumenbase.llm.langid import UND, Scorer, identify, identify_documents, subwords, train

WORDS = {"en": "the and that with from this ing tion ble ould there".split(), "de": "der die und nicht keit ung schaft über für ein".split(), "fr": "les des une pour ment eaux tion été être dans".split()}


def sample(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, sample(lang, rng.randrange(3, 60), rng), lang) for i, lang in enumerate(random.Random(4).choices(list(WORDS), k=600))]


def test_held_out_accuracy_and_fold(docs, rows):
    import zlib

    got = {r["doc_id"]: r for r in identify_documents(docs(rows)).collect()}
    held = [(i, lang) for i, _, lang in rows if got[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in got.values()) <= 0.02 * len(got)


def test_nulls_junk_and_repeats(docs, rows):
    model = train([(t, lang) for _, t, lang in rows])
    got = {r["doc_id"]: r for r in identify(docs([(1, None), (2, ""), (3, "12 34 -- !!"), (6, "½ ² ① Ⅳ"), (4, "the and that"), (4, None), (None, "the"), (5, "der " * 30_000)]), model).collect()}
    assert {i: r["lang_pred"] for i, r in got.items()} == {1: UND, 2: UND, 3: UND, 6: UND, 4: "en", 5: "de"}
    assert all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3, 6))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_without_labels_nothing_is_known(docs):
    got = identify_documents(docs([(i, "words here", None) for i in range(4)])).collect()
    assert {r["lang_pred"] for r in got} == {UND}
    assert identify_documents(docs([])).count() == 0


def test_scores_do_not_depend_on_what_was_seen_before(rows):
    model = train([(t, lang) for _, t, lang in rows])
    texts = [t for _, t, _ in rows]
    one = Scorer(model).score(texts)
    small = Scorer(model, keep=5)
    assert [small.score([t])[0] for t in texts] == one


def test_subwords_stay_within_a_word():
    grams, owner = subwords(["ab", "1", "a-b"], 1 << 20)
    assert set(owner.tolist()) == {0, 2}
    alone, _ = subwords(["ab"], 1 << 20)
    assert sorted(grams[owner == 0].tolist()) == sorted(alone.tolist())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy_on_the_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = identify_documents(rows).where("held_out").join(rows.where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 150 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_other_columns_may_have_clashing_names(docs, rows):
    frame = docs(rows[:200]).selectExpr("*", "1 as score", "2 as held_out", "'x' as lang_pred", "true as rejected")
    assert identify_documents(frame).count() == 200
