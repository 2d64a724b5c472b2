"""The pipeline against the same steps in plain Python, stage by stage."""

import re
import struct

import public_tokenizers as P
from test_jaccard import plain_join
from test_mixing import plain_mix
from test_secrets import library, plain_base, plain_random
from tokenizers import Tokenizer

import corpus_pipeline
from tidebin.llm import catalogue, toxicity


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def plain_mask(text, encoding):
    out, at = [], 0
    for start, _, end in sorted(plain_base(text) + plain_random(text, encoding)):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def domain(source):
    found = re.fullmatch("src([0-9]+)", source)
    return ["web", "books", "code"][int(found[1]) % 3] if found else "other"


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, columns = rows_of(docs), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        docs = corpus_pipeline.settle(out)
        after = rows_of(docs)
        assert docs.count() == len(after)
        if name == "toxicity":
            model = catalogue.toxicity_model(spark, sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet")).build()
            score = lambda d: model.score(toxicity.math.ceil(model.density(d.text or "")[0] * 64) / 64)
            assert after == {i: d for i, d in before.items() if score(d) < 0.5}
        elif name == "near copies":
            assert after == {i: before[i] for i, _, c in plain_join([(i, d.text) for i, d in before.items()]) if i == c}
        elif name == "secrets":
            encoding = library()
            assert {i: d.text for i, d in after.items()} == {i: plain_mask(d.text, encoding) for i, d in before.items()}
            assert all(d.n_chars == len(d.text) for d in after.values() if d.text != before[d.doc_id].text)
        else:
            rows = [(i, (domain(d.source), d.lang, d.source), len(re.findall(r"[^\x20\x09-\x0D]+", d.text))) for i, d in before.items()]
            mixed = plain_mix(rows, catalogue.MIX_WEIGHTS, 0.8, 1, 11)
            assert after == {r[0]: before[r[0]] for r in mixed if r[-2] + r[-1] > 0}
        assert 0 < len(after) <= len(before)
        before = after
    encoder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    last = rows_of(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir))
    assert set(last) == set(before)
    for i, r in last.items():
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == encoder.encode(before[i].text, add_special_tokens=False).ids


def test_run_survives_odd_rows(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "documents":
            odd = spark.createDataFrame(
                [(None, "x y", None, None, None), (None, None, "en", "src1", 0), (5001, None, None, "odd", None), (5002, "", "en", "src1", 0), (5003, "twice said", "en", "src2", 10), (5003, "twice said", "en", "src2", 10)],
                df.schema,
            )
            df = df.limit(50).unionByName(odd)
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.doc_id == 5003 for r in out) <= 1 and len(out) > 10


def test_near_copies_leave_texts_where_they_are(spark, sf_dir):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (3, "h i j", "z"), (3, "h i j", "y"), (None, "a b c d e f g", "x"), (4, None, "x")]
    docs = corpus_pipeline.settle(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.doc_id or 0, r.lang) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(0, "x"), (1, "x"), (3, "y"), (4, "x")]
