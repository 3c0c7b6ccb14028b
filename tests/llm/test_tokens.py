"""op13 against the library on whole texts."""

import random

import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor

from chromaflux.llm import tokens

PATH = path("piece_bpe_32k.model")
PARTS = [" ", "  ", " " * 17, "a", "the", "tion", "\n", "\t", "▁", "▁▁", "é", "<s>", "</s>", "<unk>", "<0x0A>", "x" * 30, ".", "\r", " {\r", "ﬁ", "\u3000", "日本", "🙂", "\x00", "\u0301"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_sum_of_pre_tokens_is_the_count_of_the_text(library, monkeypatch, step):
    monkeypatch.setattr(tokens, "STEP", step)
    lengths, r = tokens.Lengths(PATH), random.Random(step)
    for _ in range(4000):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(12)))
        assert "".join(t for part in tokens.pre_tokens(text) for t in part) == ("▁" + text.replace(" ", "▁") if text else "")
        assert lengths.count(text) == len(library.encode(text)), text


def test_cache_is_bounded_and_counts_do_not_depend_on_it(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    lengths = tokens.Lengths(PATH, [("▁the", 1)])
    text = "the then there these thesis theory the then " + "long" * 100
    assert lengths.count(text) == lengths.count(text) == len(library.encode(text))
    assert len(lengths) == 4


def test_whole_query(spark, library):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randrange(200))), 0) for i in range(300)]
    rows += [(1, None, 0), (None, "a b", 0), (1, "", 0), (3, "word " * 900_000, 0), (4, "y" * 300_000, 0), (5, " " * 300_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    want = sorted(((i is None, i or 0), len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, _ in rows)
    assert sorted(((x.doc_id is None, x.doc_id or 0), x.n_bytes, x.n_tokens, x.over_limit) for x in tokens.op13_tokens(df).collect()) == want
    assert tokens.op13_tokens(df.limit(0)).count() == 0
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(tokens.op13_tokens(df)._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan


def test_texts_go_to_python_in_small_batches(spark):
    from chromaflux.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    try:
        for own, then in ((common.USUAL_BATCH, common.TEXT_BATCH), ("500", "500")):
            spark.conf.set(name, own)
            common.texts(docs)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.unset(name)
