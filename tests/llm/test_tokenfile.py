import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenbase.llm.common import fresh_path, tokenizer_file
from lumenbase.llm.encoders import TextEncoder
from lumenbase.llm.tokenfile import EliasFano, Shard, read_token_files, token_files, write_shard


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_select_gives_every_number(steps):
    values = np.cumsum([0, *steps])
    ef = EliasFano.of(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(k) for k in range(len(values))] == values.tolist()


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 5000), max_size=300), st.randoms())
def test_select_gives_any_numbers_at_once(steps, rng):
    values = np.cumsum([0, *steps])
    k = np.array([rng.randrange(len(values)) for _ in range(50)])
    assert EliasFano.of(values).select_each(k).tolist() == values[k].tolist()


def test_the_query_reads_the_select_samples(spark):
    ids = [np.arange(k % 5, dtype="<u4").tobytes() for k in range(200)]
    data = write_shard(list(range(200)), ids)
    ef = Shard.read(data).ends
    wrong = (ef.samples[1] + np.arange(1, 9, dtype=np.uint64))[[not int(ef.high[a // 64]) >> (a % 64) & 1 for a in map(int, ef.samples[1] + np.arange(1, 9, dtype=np.uint64))]][0]
    samples = ef.samples.copy()
    samples[1] = wrong
    assert data.count(ef.samples.tobytes()) == 1
    for name, shard in (("good", data), ("bad", data.replace(ef.samples.tobytes(), samples.tobytes()))):
        path = fresh_path(spark, name)
        spark.createDataFrame([(0, 0, 200, sum(map(len, ids)) // 4, shard)], "part int, first_doc long, n_docs long, n_ids long, data binary").write.parquet(path)
        rows = read_token_files(spark, path)
        if name == "good":
            assert [r["n_tokens"] for r in rows.orderBy("doc_id").collect()] == [k % 5 for k in range(200)]
        else:
            with pytest.raises(Exception, match="a select sample isn't at a boundary"):
                rows.collect()


def test_space_is_near_the_bound():
    values = np.arange(0, 1_000_000, 100)
    ef = EliasFano.of(values)
    bits = 64 * (len(ef.low) + len(ef.high) + len(ef.samples))
    assert bits < len(values) * (2 + np.log2(100) + 1.5)


@settings(deadline=None, max_examples=50)
@given(st.lists(st.lists(st.sampled_from([0, 7, 65_535, 65_536, 4_000_000_000]), max_size=9), max_size=20))
def test_shard_round_trip(docs):
    ids = [np.array(d, dtype="<u4").tobytes() for d in docs]
    shard = Shard.read(write_shard(list(range(len(docs))), ids))
    assert [shard.document(k).tolist() for k in range(len(docs))] == docs


def test_files_hold_the_librarys_ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = [(9, "A  b\n c"), (-4, None), (2, ""), (7, "naïve café <|endoftext|> 中文 \x1c x"), (8, "x" * 50_000), (30, "A  b\n c")]
    got = token_files(docs([*rows, (None, "gone"), (2, "")])).collect()
    start, want = 0, []
    for i, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == want
    assert token_files(docs([])).collect() == []


def test_small_shards_follow_each_other(docs):
    rows = [(i, "some words here " * (i % 7)) for i in range(200)]
    one = sorted(map(tuple, token_files(docs(rows)).collect()))
    assert sorted(map(tuple, token_files(docs(rows), shard_bytes=100).collect())) == one


def test_text_that_spells_a_special_token_gets_its_id(docs):
    enc = TextEncoder(tokenizer_file("byte_bpe_50k.json"))
    assert np.frombuffer(enc.encode("a <|endoftext|> b"), "<u4").tolist() == enc.whole("a <|endoftext|> b") == [64, 220, 50256, 275]
    for text in ("<|endoftext|>", "x<|endoftext|><|endoftext|>.", "a  <|endoftext|>\n b", "<|endoftext|", "A<|ENDOFTEXT|>", " <|endoftext|> ."):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.whole(text)


def test_other_columns_may_have_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b", 7, "x", "y"), (2, "c", 8, "x", None)], "doc_id long, text string, start long, data string, part string")
    assert sorted(r["doc_id"] for r in token_files(rows).collect()) == [1, 2]


def test_rows_over_several_tasks_and_shards(spark, docs):
    rows = [(i, "word " * (i % 11)) for i in range(300)]
    got = sorted(map(tuple, token_files(docs(rows).repartition(5), shard_bytes=200).collect()))
    at = 0
    for doc, start, n, _ in got:
        assert start == at
        at += n
    assert [r[0] for r in got] == list(range(300))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_batch_asks_the_model_once_for_each_word(monkeypatch, name):
    enc, asked = TextEncoder(tokenizer_file(name)), []
    learn = enc.learn
    monkeypatch.setattr(enc, "learn", lambda parts: (asked.extend(parts), learn(parts)))
    texts = ["so Größe Größe. Größe, Größe$$$ Größe.\nund Größe!!", None, "so Größe.", "", "und Größe%%%\tso Größe"]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode_all(pa.array(texts))]
    assert got == [enc.whole(t or "") for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_all(pa.array(texts))] == got
    assert len(asked) == len(set(asked)) and sum("röße" in t for t in asked) == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_batches_hold_the_librarys_ids(name):
    enc = TextEncoder(tokenizer_file(name), keep=50)
    bits = st.sampled_from([*"aBéßİŉſ1²½_.,'\n\t\x0b\x0c\x1c\x85\xa0\x00ÿ中́​", " ", " ", " ", "  ", "'s", "the", " the", "!!", "<|endoftext|>"])

    @settings(deadline=None, max_examples=200)
    @given(st.lists(st.none() | st.lists(bits, max_size=20).map("".join), max_size=6))
    def same(texts):
        got = enc.encode_all(pa.array(texts, pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.whole(t or "") for t in texts]

    same()
