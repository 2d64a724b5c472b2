"""BPE against the tokenizers library, which is only the yardstick here."""

import hashlib
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidebin.llm import bpe
from tidebin.llm.catalogue import op4_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "  \n", "Hello, world! It's 2024.", "ÀΣΑΣ don't <|endoftext|>x<|startoftext|> y", "á ́b\x85c　d \x1cq İI K ſ",
    "12½ ①😀👍🏽 ﬁ", "'S 'LL I'm x", "é" * 700, "word " * 3000, "a\x00b\x1fc", "<| x |>", "Hello, world! It's 2024.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(row, library, text):
    want = library.encode(text or "", add_special_tokens=False).ids
    assert list(struct.unpack(f"<{row.n_tokens}I", row.ids)) == want, text
    assert row.decoded == library.decode(want, skip_special_tokens=False), text


@pytest.mark.parametrize("cache_words", [1, 1000])
def test_same_ids_and_text_as_the_library(spark, library, cache_words):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    out = bpe.encode(df, "text", PATH, ["doc_id"], decoded=True, cache_words=cache_words)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    for r in rows:
        same(r, library, TEXTS[r.doc_id])
    back = bpe.decode(out.select("doc_id", "ids"), "ids", PATH, ["doc_id"]).collect()
    assert {r.doc_id: r.decoded for r in back} == {r.doc_id: r.decoded for r in rows}


def test_random_words_agree(library):
    import random

    rnd = random.Random(5)
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    alphabet = "aeinrstlAEßñü'!.19 ½\n" + "ΣƀɏʼnǅḀ中"
    for size in (20, 300):
        for _ in range(300):
            text = "".join(rnd.choices(alphabet[: rnd.choice([21, 28])], k=size))
            got = [i for u in vocabulary.units(text) for i in vocabulary.ids(u)]
            assert got == library.encode(text, add_special_tokens=False).ids, text


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, "text", PATH, ["doc_id"]).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.n_tokens) for r in bpe.encode(nulls, "text", PATH, ["doc_id"]).collect()] == [(None, 2)] * 2


def test_query_digests(spark, sf_dir, library):
    rows = {r.doc_id: r for r in op4_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_every_plain_letter_and_its_small_one(library):
    """Capitals below U+0250 whose small letters lie beyond it included, alone and mixed."""
    import random

    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    letters = [chr(c) for c in range(0x250)]
    grown = [c for c in letters if any(ord(x) >= 0x250 for x in c.lower())]
    assert len(grown) > 20
    rnd = random.Random(7)
    texts = letters + [f"a{c}b {c}" for c in letters] + ["Əliyev Bakıda yaşayır", "Ɛyɛ Ɔdɔ Ɣe Ɖevi"]
    texts += ["".join(rnd.choices(grown + list("abc é'1 Z"), k=12)) for _ in range(400)]
    for text in texts:
        ids = [i for unit in vocabulary.units(text) for i in vocabulary.ids(unit)]
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
