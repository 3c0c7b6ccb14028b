"""Cases in which the text operators once did less than the whole job."""

import random
from itertools import combinations

import pytest
from test_text_operators import WORDS, frame, prose

from chromaflux.llm import common, decontam, license, lm, packing, simhash


@pytest.mark.parametrize("blocks", [(64, 256), (8, 16)])
def test_alike_on_shared_boilerplate(spark, monkeypatch, blocks):
    for name, value in zip(("PIVOTS", "PART"), blocks, strict=True):
        monkeypatch.setattr(simhash, name, value, raising=False)
    r = random.Random(3)
    paragraphs = [[r.choice(WORDS) + str(r.randrange(1000)) for _ in range(20)] for _ in range(12)]
    chosen = list(combinations(range(12), 8))  # any two share seven paragraphs at most
    r.shuffle(chosen)
    rows = []
    for i, at in enumerate(chosen[:300]):  # the lowest and the highest ids are strangers; 130 to 169 have a near copy each
        words = [w for p in at for w in paragraphs[p]]
        rows.append((2 * i, " ".join(words), None))
        if 130 <= i < 170:
            words[r.randrange(10, 150)] = "edit"
            rows.append((2 * i + 1, " ".join(words), None))
    r.shuffle(rows)
    sets = {i: set(simhash.shingles(t.encode(), 5).tolist()) for i, t, _ in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike == {(i, i + 1) for i in range(260, 340, 2)}
    got = {x.doc_id: x.component_id for x in simhash.alike(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in sets}


@pytest.mark.parametrize("size", [90, 240])
def test_passages_that_lack_characters_at_the_start_of_a_text(size):
    item = decontam.normalised(prose(5, 80).encode())[:size].strip()
    index = decontam.Index([(7, item)])
    other = prose(9, 60).encode()
    for gone in range(1, 5 if size > 96 else 4):
        text = item[gone:]
        many = [other, text, other, b"before " + text, text]
        got = decontam.scan(index, many)
        assert [set(x) for x in got] == [set(), {7}, set(), {7}, {7}]
        last = len(decontam.normalised(text).split()) - 1
        for doc, shift in ((1, 0), (3, 1), (4, 0)):
            assert got[doc][7][:2] == (shift, last + shift)
        assert got[1] == got[4] == decontam.scan(index, [text])[0]  # whatever its neighbours


def test_short_templates_inside_long_ones_and_every_chain():
    scan = license.Scanner(license.TEMPLATES).scan
    line, mit = license.TEMPLATES["apache-line"], license.TEMPLATES["mit"]
    for text in ('Licensed under the Apache License, Version 2.0 (the "License") and so on', "Licensed under the Apache License, Version 2.0. The authors", line):
        assert (scan(text.encode())[5], scan(text.encode())[7]) == ("apache", ["apache:0:8"])
    n = len(mit.split())
    assert scan(f"{mit} and then {mit}".encode())[7] == [f"mit:0:{n}", f"mit:{n + 2}:{2 * n + 2}"]


def test_chains_look_back_by_the_gap():
    between = [(10 + i % 2, 500 + 20 * i, 4) for i in range(100)]  # no part of the chain
    assert license.chained([(0, 0, 10), *between, (12, 10, 10)]) == (20, 0, 21)


@pytest.mark.parametrize("seed", range(4))
def test_matches_of_each_template_by_brute_force(seed):
    r = random.Random(seed)
    templates = {f"t{i}": " ".join(r.choice("abc") for _ in range(r.randrange(5, 20))) for i in range(5)}
    scanner = license.Scanner(templates, {}, 2.0)
    words = [r.choice("abcx") for _ in range(60)]
    got, real = [], license.chains
    try:
        license.chains = lambda m, *a: got.extend(m) or real(m, *a)
        scanner.scan(" ".join(words).encode())
    finally:
        license.chains = real
    want = []
    for t in map(str.split, templates.values()):
        for i in range(len(words)):
            for j in range(len(t)):
                if not (i and j and words[i - 1] == t[j - 1]):
                    n = next((k for k in range(60) if i + k == len(words) or j + k == len(t) or words[i + k] != t[j + k]), 60)
                    want += [(i, j, n)] * (n >= license.LONG)
    assert sorted(got) == sorted(want)


def test_packed_ids_are_those_of_tokenizers_at_its_defaults(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert packing.ADDED == {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    cases = ["<|endoftext|> x", "a<|endoftext|><|endoftext|>\n b", " <|endoftext|", "don't <|ENDOFTEXT|> 123 <|endoftext|>", "  x  <|endoftext|>  y", ""]
    got = {r.doc_id: list(r.ids) for r in packing.pieces(frame(spark, [(i, x, None) for i, x in enumerate(cases)])).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(cases)}


def test_parts_of_the_corpus_are_written_and_read_few_at_a_time(spark):
    import glob

    import pyarrow.parquet as pq

    r = random.Random(5)
    rows = [(i, " ".join(f"{r.randrange(1 << 40):x}" for _ in range(420_000))) for i in range(10)]  # each a part of its own
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    every = common.written(lm.parts(docs), lm.GROUP)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(every.written_to.removeprefix("file:") + "/*.parquet")]
    sizes = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(m.num_rows for m in files) == 10 and max(sizes) < 2 * lm.GROUP < sum(sizes)
    common.remove(every)
