import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidebin.llm import alignment
from tidebin.llm.catalogue import op12_alignment

PATHS = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def plain(rows, libraries):
    """Every pair of tokens compared, by the libraries' own tables."""
    first, second = libraries
    shown = {}
    nice = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = 256
    for b in range(256):
        shown[chr(b) if b in nice else chr(spare)] = b
        spare += b not in nice
    found = []
    for doc, text in rows:
        a = b = []
        if text:
            whole = (" " + text).encode()
            a = [(i, bytes(shown[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a = b = []

        def spans(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        a, b = spans(a), spans(b)
        links = [(x, y) for x, p, q in a for y, r, s in b if max(p, r) < min(q, s)]
        cuts = sorted({q for _, _, q in a} & {s for _, _, s in b})
        text_of, low = [], 0
        for cut in cuts:
            text_of.append("|".join(",".join(str(i) for i, p, q in side if low <= p and q <= cut) for side in (a, b)))
            low = cut
        found.append((doc, len(a), len(b), len(cuts), links, ";".join(text_of)))
    counts = Counter(link for row in found for link in row[4])
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    out = []
    for doc, n_a, n_b, n_groups, links, spelled in found:
        digest = hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""
        out.append((doc, n_a, n_b, n_groups, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def texts(seed=1):
    rnd = random.Random(seed)
    parts = ["the", "  ", "\n", "Ünïcode", "naïve", "日本語", "🙂👍🏽", "\t\t", "<s>", "<|endoftext|>", "</s>", "▁", "1234567", "don't", "a" * 30, "\x00", " ", "café́", "ﬁ", "Straße", "x=y;", "...", "I'll", "Ə", "﻿"]
    out = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 25))) for _ in range(60)]
    return out + [None, "", " ", "<unk>", "word", "word", " leading", "trailing "]


@pytest.mark.parametrize("block_links", [40, 2_000_000])
def test_same_as_all_pairs(spark, libraries, block_links):
    rows = list(enumerate(texts())) + [(None, "some words"), (3, "again an id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pair int, block string").repartition(3)
    sides = lambda: alignment.byte_level(PATHS[0], PATHS[1], public_tokenizers.PATTERN), lambda: alignment.word_pieces(PATHS[2])
    out = alignment.align(df, "doc_id", "text", *sides, block_links=block_links).collect()
    got = sorted(((*r[:7], hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in out), key=repr)
    assert got == plain(rows, libraries)


def test_ranks_encode_like_the_whole_library():
    whole, fast = alignment.byte_level(PATHS[0]), alignment.byte_level(PATHS[0], PATHS[1], public_tokenizers.PATTERN)
    rnd = random.Random(5)
    plain_chars = [chr(c) for c in range(0x2030) if alignment.PLAIN.fullmatch(chr(c))]
    assert len(plain_chars) > 500
    samples = [f"a{c}b {c}{c} 1{c}2{c} {c}" for c in plain_chars] + ["".join(rnd.choices(plain_chars, k=40)) for _ in range(3000)]
    samples += ["".join(rnd.choices(" \n\tab1'.sé", k=30)) for _ in range(3000)] + ["z" * 3000, " " * 3000, "<|endoftext|> x"]
    for text in samples:
        assert fast.encode(text) == whole.encode(text), repr(text)


def test_long_runs_are_seen():
    import re

    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice([" ", "\n", "a", "b c "]) * rnd.choice([1, 3, 90, 199, 399, 400, 401]) for _ in range(rnd.randrange(1, 8)))
        assert alignment.long_run(text) == bool(re.search(r"\S{400}|\s{400}", text)), repr(text)


def test_long_text_and_empty_table(spark, libraries):
    rnd = random.Random(3)
    long = " ".join(rnd.choices(["alpha", "Beta", "gämma", "delta9", "\n"], k=1500)) + "q" * 2000
    rows = [(1, long), (2, long)]
    sides = lambda: alignment.byte_level(PATHS[0], PATHS[1], public_tokenizers.PATTERN), lambda: alignment.word_pieces(PATHS[2])
    out = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", *sides)
    got = sorted((*r[:7], hashlib.sha256(r.groups.encode()).hexdigest()) for r in out.collect())
    assert got == plain(rows, libraries)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", *sides).count() == 0


def test_query(spark, sf_dir, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = op12_alignment(spark, sf_dir)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = {r.doc_id: tuple(r) for r in out.collect()}
    assert len(rows) == len(docs)
    short = [d for d in docs if len(d[1] or "") < 3000]
    want = {r[0]: r for r in plain(short, libraries)}
    for doc, row in want.items():
        assert (*rows[doc][:5], rows[doc][7]) == (*row[:5], row[7])
