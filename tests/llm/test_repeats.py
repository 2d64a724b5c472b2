import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tidebin.llm import repeats
from tidebin.llm.catalogue import op13_suffix_dedup


def plain(texts, length):
    """Every window by its bytes."""
    raws = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for i, raw in enumerate(raws):
        for at in range(len(raw) - length + 1):
            places[raw[at : at + length]].append((i, at))
    gone = [bytearray(len(r)) for r in raws]
    for found in places.values():
        if len(found) > 1:
            for i, at in found:
                gone[i][at : at + length] = b"\x01" * length
    out = []
    for raw, mask in zip(raws, gone):
        spans = sum(a and not b for a, b in zip(mask, b"\x00" + bytes(mask)))
        kept = bytes(c for c, m in zip(raw, mask) if not m)
        out.append((len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeéü ", k=rnd.randrange(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(length // 2) for _ in range(4)]
    out = [None, "", "x", "x" * (3 * length), "x" * (3 * length + 1), "ab" * length, "line of text\n" * length]
    for i in range(n):
        kind = rnd.random()
        if kind < 0.25 and i:
            out.append(rnd.choice(out))
        elif kind < 0.5 and i:
            base = rnd.choice(out) or "empty"
            k = rnd.randrange(len(base))
            out.append(base[:k] + word() + base[k + rnd.randrange(5) :])
        elif kind < 0.8:
            out.append(prose(20) + rnd.choice(passages) + prose(30) + (rnd.choice(passages) if rnd.random() < 0.5 else ""))
        else:
            out.append(prose(rnd.choice([1, 10, 100])))
    return out


def found(spark, texts, length):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "id long, text string, pack int, key string").repartition(5)
    rows = repeats.without_repeats(df, "text", ["id", "key"], length).collect()
    return [(r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in sorted(rows, key=lambda r: r.id)]


@pytest.mark.parametrize("seed, length", [(1, 40), (2, 41), (3, 200)])
def test_same_as_every_window(spark, seed, length):
    texts = corpus(seed, length)
    assert found(spark, texts, length) == plain(texts, length)


def test_crowded_keys_and_small_ranges(spark, monkeypatch):
    """Keys with many different pieces are cut again; shards and blocks are many."""
    monkeypatch.setattr(repeats, "MANY", 3)
    monkeypatch.setattr(repeats, "RANGE", 5000)
    monkeypatch.setattr(repeats, "WINDOWS", 300)
    rnd = random.Random(9)
    footer = "the same footer under every text, a little longer than the length asked for"
    texts = corpus(4, 40) + ["".join(rnd.choices("abcdefgh ", k=60)) + footer + "".join(rnd.choices("xyz ", k=50)) for _ in range(30)]
    assert found(spark, texts, 40) == plain(texts, 40)


def test_transform_sorts_suffixes():
    rnd = random.Random(3)
    texts = [bytes(rnd.choices(b"ab", k=rnd.randrange(1, 40))) for _ in range(20)]
    suffixes = sorted(((t[i:], j, i) for j, t in enumerate(texts) for i in range(len(t) + 1)), key=lambda s: ([(1, c) for c in s[0]] + [(0, s[1])]))
    want = [0 if i == 0 else texts[j][i - 1] + 1 for _, j, i in suffixes]
    bwt = repeats.transform(texts)
    assert bwt.tolist() == want
    text, offset = repeats.places(bwt, np.array([len(t) for t in texts]))
    assert list(zip(text.tolist(), offset.tolist())) == [(j, i) for _, j, i in suffixes]


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "id long, text string"), "text", ["id"]).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    df = op13_suffix_dedup(spark, sf_dir)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(d.doc_id, *row) for d, row in zip(docs, plain([d.text for d in docs], 200))]
    assert sum(r[2] for r in got) > 0
