import cProfile
import math
import os
import pstats
import random
import re
import zlib
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from tidebin.llm import pitman_yor as P
from tidebin.llm.catalogue import op3_pitman_yor


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [""]


def plain_base(train, text):
    counts = {}
    for t in train:
        for w in tokens_of(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    found = tokens_of(text)
    base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in found)
    return len(found), sum(w in counts for w in found), n, base


def texts(n=300, seed=1):
    rnd = random.Random(seed)
    follow = {w: rnd.sample([f"w{i}" for i in range(60)], 4) for w in [f"w{i}" for i in range(60)]}
    out = []
    for _ in range(n):
        w, line = "w0", []
        for _ in range(rnd.choice([3, 20, 60])):
            line.append(w if rnd.random() > 0.03 else f"R{rnd.randrange(400)}")
            w = rnd.choice(follow[w])
        out.append(" ".join(line))
    return out


def learned(spark, rows, **sizes):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n string").repartition(3)
    return P.learn(df, "text", **sizes)


@pytest.mark.parametrize("sizes", [{}, {"head": 20, "contexts": 10, "pairs": 30}, {"head": 1, "contexts": 5, "pairs": 0}])
def test_probabilities_sum_to_one(spark, sizes):
    model, words = learned(spark, texts(60), **sizes)
    dishes = np.arange(len(model.parent))
    for before in range(len(model.ids) + 1):
        assert abs(model.probability(np.full(len(dishes), before), dishes).sum() - 1) < 1e-9
    rare = [r.n for r in words.collect() if bytes(r.word) not in model.ids]
    new = (model.rare_discount * model.rare_types if model.rare_total else 1.0) / (model.rare_types + 1)
    assert abs(sum((n - model.rare_discount + new) / max(model.rare_total, 1) for n in rare) + new / max(model.rare_total, 1) - 1) < 1e-9


def test_base_counts_and_better_than_unigrams(spark):
    rows = texts()
    train, held = rows[:250], rows[250:] + [None, "", "never seen WORDS w1", "w1 " * 5000]
    model, words = learned(spark, train, head=50, contexts=30, pairs=1000)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(held + held[-1:])], "doc_id long, text string, word string")
    got = {r.doc_id: r for r in P.score(df, "text", model, words, ["doc_id"]).collect()}
    assert len(got) == len(held) + 1 and got[len(held)].score == got[len(held) - 1].score
    for i, text in enumerate(held):
        n, known, total, base = plain_base(train, text)
        assert (got[i].n_tokens, got[i].n_known, model.total) == (n, known, total)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, -base)
        assert got[i].perplexity == pytest.approx(10 ** (-got[i].score / n))
    assert sum(got[i].score for i in range(50)) > sum(got[i].base_score for i in range(50)) * 0.75


def test_same_result_for_any_partitioning(spark):
    rows = texts(80)
    a, _ = learned(spark, rows, head=30, contexts=20)
    df = spark.createDataFrame([(t,) for t in rows], "text string").repartition(7)
    b, _ = P.learn(df, "text", head=30, contexts=20)
    assert np.array_equal(a.keys, b.keys) and np.allclose(a.mass, b.mass) and np.allclose(a.parent, b.parent)


def test_seating_follows_the_restaurant(spark):
    """Mean number of tables against the one-by-one process."""
    rng, fresh, discount, n = np.random.default_rng(1), 0.7, 0.4, 12
    seen = []
    for _ in range(4000):
        tables = 1
        for j in range(1, n):
            tables += rng.random() < fresh / (j - discount * tables + fresh)
        seen.append(tables)
    got = P.seat(np.full(4000, n), np.full(4000, fresh), discount, np.arange(4000), 5)
    assert abs(got.mean() - np.mean(seen)) < 0.1 and abs(got.std() - np.std(seen)) < 0.1
    many = P.seat(np.array([0, 1, 100_000]), np.full(3, 0.5), 0.5, np.arange(3), 1)
    assert many[0] == 0 and many[1] == 1 and 1 < many[2] < 100_000


def plain_score(train, model, text):
    """Every pair one table: the discounted count, then the word before's share of the parent."""
    words, pairs, after = {}, {}, {}
    for t in train:
        found = tokens_of(t)
        for before, w in zip([""] + found, found):
            words[w] = words.get(w, 0) + 1
            pairs[before, w] = pairs.get((before, w), 0) + 1
            after.setdefault(before, set()).add(w)
    d, total = model.discount, 0.0
    for before, w in zip([""] + tokens_of(text), tokens_of(text)):
        if w.encode() in model.ids:
            p = model.parent[model.ids[w.encode()]]
        else:
            p = model.parent[-1] * (max(words.get(w, 0) - model.rare_discount, 0) + model.rare_new()) / max(model.rare_total, 1)
        if before in words:
            p = (max(pairs.get((before, w), 0) - d, 0) + (P.STRENGTH + d * len(after[before])) * p) / (P.STRENGTH + words[before])
        total += math.log10(p)
    return total


@pytest.mark.parametrize("head", [1, 20, 1000])
def test_every_context_and_pair_counts(spark, head):
    rows = texts(80)
    odd = [None, "", "never seen", "R1 R2 w3", "w1 R1 w1 R1", "W0 w1 w2 unseen w3"] + rows[:20]
    model, words = learned(spark, rows, head=head, contexts=0, pairs=10)
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in P.score(df, "text", model, words, ["doc_id"]).collect()}
    for i, text in enumerate(odd):
        assert got[i] == pytest.approx(plain_score(rows, model, text), rel=1e-9)


def test_pairs_that_are_not_sent_are_joined(spark):
    """What is sent to tasks is a matter of speed: pairs drawn but not sent score alike."""
    rows = texts(80)
    df = spark.createDataFrame(list(enumerate(rows[:30] + ["w1 w2 unseen"])), "doc_id long, text string")
    got = []
    for pairs in (0, 25, 10**6):
        model, words = learned(spark, rows, head=40, pairs=pairs)
        assert len(model.keys) <= pairs
        got.append({r.doc_id: r.score for r in P.score(df, "text", model, words, ["doc_id"]).collect()})
    for i in got[0]:
        assert got[0][i] == pytest.approx(got[2][i], rel=1e-9) and got[1][i] == pytest.approx(got[2][i], rel=1e-9)


def test_all_words_after_a_context_sum_to_one(spark):
    model, words = learned(spark, texts(60), head=20, pairs=30)
    known = {r.id if bytes(r.word) not in model.ids else model.ids[bytes(r.word)]: r.n for r in words.collect()}
    follows = {r.c: r.k for r in model.follows.collect()}
    gains = {(r.c, r.w): r.gain for r in model.pairs.collect()}
    rare = {w: model.parent[-1] * (n - model.rare_discount + model.rare_new()) / model.rare_total for w, n in known.items() if w < 0}
    unknown = model.parent[-1] * model.rare_new() / model.rare_total
    assert len(follows) > 50
    for c in known:
        lower = (P.STRENGTH + model.discount * follows[c]) / (P.STRENGTH + known[c]) if c < 0 else model.share[c] * model.back[min(c, model.contexts)]
        total = lower * unknown
        for w in known:
            p = rare[w] if w < 0 else model.parent[w]
            total += lower * p * 10 ** gains.get((c, w), 0.0) + (model.own(np.array([c]), np.array([w]))[0] if c >= 0 and w >= 0 else 0.0)
        assert total == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn_from(spark):
    model, words = P.learn(spark.createDataFrame([], "text string"), "text")
    out = P.score(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), "text", model, words, ["doc_id"]).collect()
    assert sorted(r.n_tokens for r in out) == [1, 3] and all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert P.score(spark.createDataFrame([], "doc_id long, text string"), "text", model, words, ["doc_id"]).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 1}
    train = [t for i, t in docs.items() if i not in held]
    rows = op3_pitman_yor(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs) and {r.doc_id for r in rows if r.held_out} == held
    for r in rows[:60]:
        n, known, total, base = plain_base(train, docs[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * -base
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_parts_and_chunks_are_a_matter_of_speed(spark, monkeypatch):
    """Many parts, and sums and texts handed on in small chunks, score as the plain model does."""
    for name, size in (("PART_TOKENS", 300), ("COUNT_PAIRS", 200), ("CHUNK_TOKENS", 250), ("COUNT_WORDS", 20)):
        monkeypatch.setattr(P, name, size)
    rows = texts(80)
    odd = [None, "", "never seen", "R1 R2 w3", "R5 R5 R5 R5", "w1 R1 w1 R1"] + rows[:40]
    model, words = learned(spark, rows, head=20, contexts=0)
    assert model.parts > 5
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, part string").repartition(3)
    got = {r.doc_id: r for r in P.score(df, "text", model, words, ["doc_id", "part"]).collect()}
    assert len(got) == len(odd)
    for i, text in enumerate(odd):
        n, known, _, base = plain_base(rows, text)
        assert (got[i].n_tokens, got[i].n_known, got[i].part) == (n, known, None)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(plain_score(rows, model, text), rel=1e-9)


def test_what_is_settled_stays_small(spark, monkeypatch):
    """Pairs and tokens are written packed: few bytes for each token."""
    settle, written = P.settle, []

    def weighed(df):
        out = settle(df)
        written.extend(os.path.getsize(f.removeprefix("file:")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(P, "settle", weighed)
    rnd = random.Random(2)
    rows = [" ".join(f"w{rnd.randrange(20_000)}" for _ in range(500)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    model, words = P.learn(df, "text")
    assert P.score(df, "text", model, words, ["doc_id"]).count() == 400
    assert sum(written) < 8 * 501 * 400


def test_tasks_make_no_call_for_each_word(spark):
    """Words are split, counted and given ids by the batch, however many different ones there are."""
    rows = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(50)]
    texts_, words = pa.record_batch({"text": rows}), pa.record_batch({"word": pa.array([w.encode() for t in rows for w in t.split()]), "n": [1] * 20_000})
    df = MagicMock()
    df.sparkSession.sparkContext.broadcast = lambda value: SimpleNamespace(value=value)
    P.word_counts(df, "text")
    P.pair_counts(df, "text", {b"w1x1": 0, b"": 1}, 0, 3)
    counted, paired = (c.args[0] for c in df.select.return_value.mapInArrow.call_args_list)
    named = df.select.return_value.mapInArrow.return_value.groupBy.return_value.agg.return_value.mapInArrow.call_args.args[0]
    for run, batch in ((counted, texts_), (paired, texts_), (named, words)):
        calls = cProfile.Profile()
        assert calls.runcall(lambda: list(run(iter([batch]))))
        assert pstats.Stats(calls).total_calls < 5_000


@pytest.mark.parametrize("size", [1, 10, 10**6])
def test_words_of_a_batch_are_those_of_its_texts(monkeypatch, size):
    monkeypatch.setattr(P, "SPLIT_BYTES", size)
    rows = ["A b", None, "", " ", "\n X\ty ", "\xdcn\xef \xc9A b c \x1c d\x85e\xa0f", "x" * 50, "a\0b a\0c " * 3] * 7
    batch = pa.record_batch({"i": range(len(rows)), "text": rows})
    ids, seen, met = P._Ids({b"a": 0, b"x": 1, b"": 2}, 7), [], {"a": 0, "x": 1, "": 2}
    for part, words, sizes in P._split(iter([batch.slice(0, 0), batch.slice(3, 20), batch.slice(23)]), 1):
        for i, found in zip(part.column(0).to_pylist(), ids.of(words, sizes), strict=True):
            seen.append(i)
            assert [met.setdefault(w, n) for w, n in zip(tokens_of(rows[i]), found, strict=True)] == found.tolist()
    assert seen == list(range(3, len(rows))) and len(set(met.values())) == len(met) and sum(n < 0 for n in met.values()) == len(met) - 3


@pytest.mark.parametrize("first", [[], [0], [0] * 5, [-(2**63), -7, 0, 2**63 - 1]])
def test_packed_columns_come_back(first):
    for other in (0, 1, 255, 256, -1, 2**62):
        columns = [np.array(first, np.int64), np.full(len(first), other), np.arange(len(first))]
        assert all(np.array_equal(x, y) for x, y in zip(columns, P.unpack(P.pack(*columns), 3), strict=True))
