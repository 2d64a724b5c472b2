import hashlib
import random
from fractions import Fraction

import pytest
from oracle_compare import differences, duck
from pyspark.sql import functions as F

from tidebin.llm import mixing
from tidebin.llm.catalogue import ORACLES, op8_mixing


def plain_split(budget, nodes):
    """nodes: name -> (room, weight). Give out again and again what full siblings leave."""
    rooms = {n: r if w else 0 for n, (r, w) in nodes.items()}
    left, open_, out = min(budget, sum(rooms.values())), {n for n in nodes if nodes[n][1] and rooms[n]}, dict.fromkeys(nodes, 0)
    while open_:
        total = sum(nodes[n][1] for n in open_)
        full = {n for n in open_ if Fraction(left * nodes[n][1], total) >= rooms[n]}
        if not full:
            for n in open_:
                out[n] = left * nodes[n][1] // total
            break
        for n in full:
            out[n] = rooms[n]
        left, open_ = left - sum(rooms[n] for n in full), open_ - full
    return out


def plain_mix(rows, weights, share, max_epochs, seed):
    """rows: (id, path, tokens)."""
    leaves = {}
    for i, path, n in rows:
        leaves.setdefault(path, []).append((i, n))

    def room(prefix):
        return sum(n for p, docs in leaves.items() if p[: len(prefix)] == prefix for _, n in docs) * max_epochs

    def down(prefix, budget, depth):
        if depth == 0:
            yield prefix, budget
            return
        children = sorted({p[: len(prefix) + 1] for p in leaves if p[: len(prefix)] == prefix})
        split = plain_split(budget, {c: (room(c), weights.get(c, 1)) for c in children})
        for c in children:
            yield from down(c, split[c], depth - 1)

    out = []
    for path, budget in down((), min(int(sum(n for *_, n in rows) * share), room(())), len(rows[0][1])):
        docs, total = leaves[path], sum(n for _, n in leaves[path])
        epochs = budget // total if total else 0
        rest = budget - epochs * total
        for _, i, n in sorted((hashlib.md5(f"{seed}:{epochs}:{i}".encode()).hexdigest(), i, n) for i, n in docs):
            part = max(0, min(n, rest))
            rest -= n
            out.append((i, *path, n, epochs, part))
    return sorted(out)


WEIGHTS = {("a",): 5, ("b",): 3, ("c",): 0, ("a", "x"): 4, ("a", "y", "s1"): 7, ("b", "y", "s0"): 0}


@pytest.mark.parametrize("share,max_epochs,ranges", [(0.4, 1, 2000), (1.0, 2, 5), (1.7, 3, 5), (50.0, 2, 2000)])
def test_same_as_plain(spark, monkeypatch, share, max_epochs, ranges):
    monkeypatch.setattr(mixing, "RANGE_DOCS", ranges)
    rnd = random.Random(7)
    paths = [(d, lang, s) for d in "abcd" for lang in "xyz" for s in ("s0", "s1", "s2")]
    rows = [(i, paths[0] if i % 3 == 0 else rnd.choice(paths), rnd.choice([0, 1, 5, 40, 200])) for i in range(500)]
    df = spark.createDataFrame([(i, *p, n, 1, "x") for i, p, n in rows], "doc_id long, d string, l string, s string, n long, epochs int, key string")
    out = mixing.mix(df, "doc_id", {c: F.col(c) for c in "dls"}, F.col("n"), WEIGHTS, share, max_epochs, seed=3)
    assert sorted(map(tuple, out.collect())) == plain_mix(rows, WEIGHTS, share, max_epochs, 3)


def test_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, l string, text string"
    df = spark.createDataFrame([(None, None, "a b c"), (None, None, "a b c"), (1, "", "d"), (2, "x", None), (3, "x", "")], schema)
    out = mixing.mix(df, "doc_id", {"l": F.col("l")}, mixing.word_count("text"), {}, 1.0, 1).collect()
    assert sorted((r.doc_id or 0, r.l, r.n_tokens, r.epochs, r.part_tokens) for r in out) == [
        (0, "", 3, 1, 0), (0, "", 3, 1, 0), (1, "", 1, 1, 0), (2, "x", 0, 0, 0), (3, "x", 0, 0, 0),
    ]
    empty = spark.createDataFrame([], schema)
    assert mixing.mix(empty, "doc_id", {"l": F.col("l")}, mixing.word_count("text"), {}).count() == 0


def test_query(spark, sf_dir):
    assert differences(op8_mixing(spark, sf_dir), duck(sf_dir), ORACLES["op8_mixing"]) == []


def test_taken_rows_are_those_of_the_mixture(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), " ".join(["w"] * rnd.choice([0, 1, 5, 40])), i, "x") for i in range(400)]
    rows += [(7, "a", "again", 0, "x"), (None, "b", "no id", 0, "x"), (500, "c", None, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, epochs long, last string")
    levels, tokens = {"source": F.col("source")}, mixing.word_count("text")
    for share, most in ((0.5, 1), (1.0, 1), (0.9, 3), (0.0, 1)):
        mixed = mixing.mix(docs, "doc_id", levels, tokens, {("a",): 1, ("b",): 4}, share=share, max_epochs=most, seed=3)
        ids = {(r.doc_id, r.source) for r in mixed.filter("epochs + part_tokens > 0 and n_tokens > 0").collect()}
        got = mixing.taken(docs, "doc_id", levels, tokens, mixing.cuts(mixed, ["source"], 3), 3)
        assert got.columns == docs.columns
        found = [tuple(r) for r in got.collect()]
        assert sorted(map(repr, found)) == sorted(repr(r) for r in rows if (r[0], r[1] or "") in ids and r[2])
    empty = docs.limit(0)
    assert mixing.taken(empty, "doc_id", levels, tokens, mixing.cuts(mixed, ["source"], 3), 3).count() == 0
