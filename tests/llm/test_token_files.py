import base64
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tidebin.llm import token_files as K
from tidebin.llm.catalogue import op7_token_counts

END = 50256


def plain(files):
    """name -> ids: one pass over each file."""
    out = []
    for name, ids in files.items():
        first, document = 0, 0
        for i, token in enumerate(ids):
            if token == END:
                out.append((name, document, first, i - first, True))
                first, document = i + 1, document + 1
        if first < len(ids):
            out.append((name, document, first, len(ids) - first, False))
    return sorted(out)


def some_files(seed=1):
    rng = np.random.default_rng(seed)
    files = {}
    for k in range(6):
        ids = rng.integers(0, 1000, rng.integers(50, 400))
        ids[rng.random(len(ids)) < [0.0, 0.01, 0.1, 0.5, 1.0, 0.05][k]] = END
        files[f"f{k}"] = ids.tolist()
    return files | {"lone": [END], "none": [5, 6, 7], "empty": []}


@pytest.mark.parametrize("block,group", [(1, 3), (7, 2), (7, 1024), (1000, 5)])
def test_blocks_are_stitched(spark, monkeypatch, block, group):
    monkeypatch.setattr(K, "GROUP_BLOCKS", group)
    files = some_files()
    rows = [(n, b, bytearray(np.array(ids[b * block : (b + 1) * block], K.TOKEN_TYPE).tobytes()), 1, "x") for n, ids in files.items() for b in range(max(1, -(-len(ids) // block)))]
    df = spark.createDataFrame(rows, "file string, block long, data binary, size int, f string").repartition(5)
    assert sorted(map(tuple, K.document_tokens(df, END).collect())) == plain(files)


def test_flat_files_on_disk(spark, tmp_path):
    files = some_files(2)
    for name, ids in files.items():
        np.array(ids, K.TOKEN_TYPE).tofile(tmp_path / name)
    (tmp_path / "f1").write_bytes(np.array(files["f1"], K.TOKEN_TYPE).tobytes() + b"\x01\x02")
    got = K.document_tokens(K.read_files(spark, f"file://{tmp_path}", 16), END).collect()
    assert sorted((r.file.rpartition("/")[2], r.document, r.first_token, r.n_tokens, r.closed) for r in got) == plain(files)


def test_texts_to_counts(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    count = lambda t: len(tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(t))
    texts = [None, "", "größe <|endoftext|> x", "the same", "the same", "word " * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, data string").coalesce(1)
    blocks = K.write_tokens(df, "text", P.path("byte_bpe_50k.tiktoken"), P.PATTERN, END, block_tokens=64)
    assert blocks.count() > 10
    got = sorted((r.document, r.n_tokens, r.closed) for r in K.document_tokens(blocks, END).collect())
    assert got == [(i, count(t or ""), True) for i, t in enumerate(texts)]
    empty = K.write_tokens(df.limit(0), "text", P.path("byte_bpe_50k.tiktoken"), P.PATTERN, END)
    assert K.document_tokens(empty, END).count() == 0


def test_query(spark, sf_dir):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op7_token_counts(spark, sf_dir).collect()
    assert all(r.closed for r in rows) and Counter(r.n_tokens for r in rows) == Counter(len(x) for x in encoding.encode_ordinary_batch(texts))
    for name in {r.file for r in rows}:
        ordered = sorted((r.document, r.first_token, r.n_tokens) for r in rows if r.file == name)
        assert [d for d, *_ in ordered] == list(range(len(ordered)))
        assert all(b[1] == a[1] + a[2] + 1 for a, b in zip(ordered, ordered[1:]))
