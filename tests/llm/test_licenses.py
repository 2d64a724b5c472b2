import random
import re

import pytest
from oracle_compare import differences, duck

from tidebin.llm import licenses
from tidebin.llm.catalogue import ORACLES, op2_licenses


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_matches(rows, templates, threshold):
    out = []
    for i, text in rows:
        w = words_of(text)
        for s in range(0, len(w), licenses.STEP):
            block = set(w[s : s + licenses.WINDOW])
            for k, (label, t) in enumerate(templates):
                t = set(t.split())
                if len(t & block) >= threshold * len(t) - 1e-9:
                    out.append((i, s, min(len(w), s + licenses.WINDOW), k, label, len(t & block) / len(t)))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    pool = "the of a tree stone Größe License version 2 0 is 日本 under PUBLIC free software".split()
    rows = [(1, None), (2, ""), (3, " .,; "), (4, "CC BY cc-by cc, by"), (5, "MIT  license mit license"), (5, "MIT  license mit license"), (None, "Apache License x")]
    for i in range(10, 90):
        text = rnd.choices(pool, k=rnd.choice([3, 60, 400]))
        for _, t in rnd.sample(licenses.TEMPLATES, rnd.choice([0, 1, 2])):
            t = t.split()
            for _ in range(rnd.choice([0, 1, 3, 5])):
                t[rnd.randrange(len(t))] = rnd.choice(pool)
            at = rnd.randrange(len(text))
            text[at:at] = t
        rows.append((i, rnd.choice([" ", ". ", "\n"]).join(text)))
    return rows


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_same_as_every_pair(spark, threshold):
    rows = corpus(4)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, first int")
    got = licenses.matches(df, "doc_id", "text", threshold=threshold).collect()
    want = plain_matches(rows, licenses.TEMPLATES, threshold)
    assert sorted(map(tuple, got), key=repr) == want and len(want) > 20


def test_places(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, places int")
    got = sorted(((r.doc_id or 0, r.n_words, sorted(map(tuple, r.places))) for r in licenses.phrase_places(df, "text", ["doc_id"]).collect()), key=repr)
    want = []
    for i, text in rows:
        w = words_of(text)
        at = [(s, name) for p, name in licenses.PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        want.append((i or 0, len(w), sorted(at)))
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.matches(df, "doc_id", "text").count() == 0


def test_query(spark, sf_dir):
    assert differences(op2_licenses(spark, sf_dir), duck(sf_dir), ORACLES["op2_licenses"]) == []
