import random

from tidebin.llm import toxicity
from tidebin.llm.catalogue import op1_toxicity
from tidebin.llm.toxicity import Folding, Model, fold

WORDS = "alpha beta gamma delta house tree river stone cloud light".split()


def labelled(n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words, toxic = rnd.choices(WORDS, k=rnd.choice([8, 40])), int(i % 5 == 0)
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(["blargh", "zonk"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def plain_density(weights, exceptions, text):
    """Word by word, without an automaton."""
    table = Folding()
    words = fold(text or "", table).split()
    free = set()
    for e in exceptions:
        e = fold(e, table).split()
        for i in range(len(words) - len(e) + 1):
            if words[i : i + len(e)] == e:
                free.update(range(i, i + len(e)))
    total = sum(max([v for e, v in weights.items() if (w + " ").startswith(e)], default=0) for i, w in enumerate(words) if i not in free)
    return total / len(words) ** 0.5 if words else 0.0


def test_folding():
    table = Folding()
    for text in ("clown", "CL0WN", "c1own", "сlоwn", "clówn", "cl​own", "ｃｌｏｗｎ"):
        assert fold(text, table) == "ciown", text
    assert fold("ab.c|d", table) == "ab c d" and fold("größe", table).startswith("gro")


def test_density_equals_plain_search():
    rnd = random.Random(2)
    weights, exceptions = {"ciown ": 3.0, "idio": 1.5, "idiot ": 2.0, "trash": 1.0, "a ": 0.5}, ("trash can", "clown fish")
    model = Model(weights, exceptions).build()
    pool = ["clown", "Idiot", "tr4sh", "trash can", "clown fish", "clowns", "a", "x", "trash", "can", "idiotic"]
    for _ in range(300):
        text = " ".join(rnd.choices(pool, k=rnd.randrange(12)))
        assert abs(model.density(text)[0] - plain_density(weights, exceptions, text)) < 1e-12, text


def test_learned_lexicon_and_held_out(spark):
    df = spark.createDataFrame(labelled(), "doc_id long, text string, toxic int")
    model = toxicity.learn(df, "text", "toxic")
    assert set(model.weights) == {"biargh ", "zonk "}
    cases = [(0, "alpha BL4RGH beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "zonk " + "tree " * 99), (5, "zonking trees"), (5, "zonking trees")]
    test = spark.createDataFrame([(i, t, 1.0) for i, t in cases], "doc_id long, text string, score double")
    rows = [(r.doc_id, r.score >= 0.5) for r in toxicity.score(test, "text", model, ["doc_id"]).collect()]
    assert sorted(rows) == [(0, True), (1, False), (2, False), (3, False), (4, True), (5, False), (5, False)]


def test_copies_do_not_make_words_toxic(spark):
    rows = [(i, t, y) for i, t, y in labelled()] + [(1000 + i, "quark alpha beta gamma", 1) for i in range(40)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), "text", "toxic")
    assert "quark " not in model.weights and "biargh " in model.weights


def test_stem_with_changing_endings(spark):
    rnd = random.Random(4)
    rows = [(t.replace("blargh", "blargh" + rnd.choice("abcdef") + rnd.choice("uvwxyz")), y) for _, t, y in labelled()]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"), "text", "toxic")
    assert "biargh" in model.weights
    built = model.build()
    assert built.score(built.density("alpha blarghotto beta")[0]) >= 0.5 > built.score(built.density("alpha blar beta")[0])


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, toxic int"
    for rows in ([], [(1, "a", 0)], [(1, "a", 1), (2, None, 1)], [(1, "a", None)]):
        model = toxicity.learn(spark.createDataFrame(rows, schema), "text", "toxic")
        assert model.weights == {}
        out = toxicity.score(spark.createDataFrame([(1, "a", 0)], schema), "text", model, ["doc_id"]).first()
        assert 0 <= out.score <= 1


def test_labelled_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"t{i}", "x") for i in [*range(6), 3]] + [(None, "n", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled_rows(docs, labels, "doc_id", "text", "toxic", F.col("doc_id") == 2)
    assert sorted(map(tuple, rows.collect())) == [("t1", 0), ("t3", 1), ("t3", 1)]
    assert toxicity.labelled_rows(docs, labels, "doc_id", "text", "toxic", F.lit(False), train_rows=2).select("toxic").distinct().count() <= 2


def test_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    rows = {r.doc_id: r for r in op1_toxicity(spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in rows]
    held = [(r.predicted, y) for r, y in labels if r.held_out]
    assert len(held) > 300 and sum(p == y for p, y in held) >= 0.98 * len(held)
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held)
