import random
import re

import numpy as np
import pytest

from tidebin.llm import jaccard
from tidebin.llm.catalogue import op5_ngram_jaccard
from tidebin.llm.components import components


def plain_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_join(rows):
    """All pairs."""
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 3 * max(len(x), len(y)) <= 4 * min(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(x), root(i)) for i, x in sets)


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    passage = rnd.choices(words, k=60)
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.45 and rows:
            base = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2, 3, len(base) // 25])):
                k = rnd.randrange(len(base))
                base[k : k + 1] = rnd.choice([[], [rnd.choice(words)], [base[k].upper(), "new"]])
            rows.append((i, " ".join(base)))
        elif kind < 0.6:
            body = rnd.choices(words, k=rnd.choice([10, 40, 300]))
            rows.append((i, " ".join(body[:20] + passage + body[20:])))
        else:
            rows.append((i, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 4, 5, 6, 8, 12, 30, 70, 150, 400])))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, n int").repartition(5)
    got = sorted(tuple(r) for r in jaccard.join(df, "doc_id", "text").collect())
    assert got == plain_join(rows)
    assert len({r[2] for r in got}) < len(got) - 20


def test_linked_sets_share_enough_signatures():
    """The guarantee behind the filter, on random pairs near the threshold."""
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(3000):
        n = int(rng.choice([1, 2, 3, 4, 7, 8, 15, 16, 31, 33, 63, 64, 65, 90, 127, 128, 200, 256, 700]))
        pool = np.unique(rng.integers(0, 2**64, 2 * n + 2, dtype=np.uint64))
        rng.shuffle(pool)
        x, cut, new = pool[:n], int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 3 + 1))
        y = np.concatenate([x[cut:], pool[n : n + new]])
        common, union = n - cut, n + new
        if 100 * common < 75 * union:
            continue
        seen += 1
        a = {band: (need, set(s.tolist())) for band, need, s in jaccard.signatures(np.sort(x))}
        b = {band: (need, set(s.tolist())) for band, need, s in jaccard.signatures(np.sort(y))}
        band = min(len(x), len(y)).bit_length() - 1
        assert len(a[band][1] & b[band][1]) >= max(a[band][0], b[band][0])
    assert seen > 500


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 400, 5000):
        for _ in range(20):
            pool = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
            rng.shuffle(pool)
            cut = int(rng.integers(0, n))
            x, y = pool[:n], pool[cut : cut + n]
            apart = sum(int(w).bit_count() for w in (jaccard.bitmap(x) ^ jaccard.bitmap(y)).view(np.uint64))
            assert apart <= len(np.setxor1d(x, y))


def test_copies_and_related_texts_over_many_tasks(spark):
    """A large group of equal texts, one of near copies in a chain, and related ones below the similarity."""
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)] * 60
    for changes in (1, 2, 3, 6, 9):
        for _ in range(12):
            words = list(base)
            for k in rnd.sample(range(120), changes):
                words[k] = f"x{rnd.randrange(50)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component long").repartition(20)
    got = sorted(tuple(r) for r in jaccard.join(df, "doc_id", "text").collect())
    assert got == plain_join(rows)
    assert 2 < len({r[2] for r in got}) < 60


def test_null_and_repeated_ids_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (None, long), (7, long), (7, long), (3, long + " end"), (7, "other words of seven here"), (9, "other words of seven here")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect())
    assert got == [(0, 36, None), (0, 36, None), (3, 37, 3), (7, 1, 3), (7, 36, 3), (7, 36, 3), (9, 1, 3)]
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(200 + rnd.randrange(40), 200 + rnd.randrange(40)) for _ in range(30)] + [(900, 900), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {x: x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a in parent and b in parent and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    assert got == {x: root(x) for x in parent}


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op5_ngram_jaccard(spark, sf_dir).collect())
    assert got == plain_join([tuple(d) for d in docs])


def test_texts_do_not_move_for_few_ids(spark, monkeypatch):
    """Ids to leave out or look at whole are sent, whatever Spark's own limit; past SENT_IDS they are joined."""
    rows = corpus(1, 40) + [(70, "a b c d e f g"), (71, "a b c d e f g"), (71, "h i j k l m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plans, signed, whole_sets = [], jaccard._signature_rows, jaccard.sets
    seen = lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString() + d._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(jaccard, "_signature_rows", lambda d, *a: seen(d) or signed(d, *a))
    monkeypatch.setattr(jaccard, "sets", lambda d, *a, **k: (k and seen(d)) or whole_sets(d, *a, **k))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(tuple(r) for r in jaccard.join(df, "doc_id", "text").collect())
        assert len(plans) == 2 and not any("SortMergeJoin" in p for p in plans)
        monkeypatch.setattr("tidebin.llm.shared.SENT_IDS", 0)
        assert got == sorted(tuple(r) for r in jaccard.join(df, "doc_id", "text").collect())
        assert len(plans) == 4 and all("SortMergeJoin" in p for p in plans[2:])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r[2] for r in got if r[0] in (70, 71)] == [70, 70, 70]
