"""The operators of this subpackage applied to the test tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebin.llm import adaptive_search, alignment, bpe, conversations, graph_dedup, jaccard, licenses, mixing, pitman_yor, repeats, secrets, token_files, toxicity
from tidebin.llm.shared import fold_of, table


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Learned from the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    rows = toxicity.labelled_rows(docs, labels, "doc_id", "text", "toxic", fold_of(F.col("doc_id")) == 0)
    return toxicity.learn(rows, "text", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, "text", toxicity_model(spark, sf_dir, docs), ["doc_id"])
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "density",
        "matches",
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and best match of every document.

    Rows that repeat an id share the labels found for it.
    """
    docs = table(spark, sf_dir, "documents")
    base = licenses.phrase_places(docs, "text", ["doc_id"])
    found = licenses.matches(docs, "doc_id", "text").groupBy("doc_id").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    found = found.withColumnRenamed("doc_id", "found_id")
    at, names = F.transform("places", lambda p: p["at"]), F.transform("places", lambda p: p["label"])
    rows = base.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    both = F.array_union(names, F.coalesce("found", F.array().cast("array<string>")))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(names)), ",").alias("base_labels"),
        F.array_join(F.sort_array(both), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document under the model of the training folds."""
    docs = table(spark, sf_dir, "documents")
    model, words = pitman_yor.learn(docs.filter(fold_of(F.col("doc_id")) != 1), "text")
    scored = pitman_yor.score(docs, "text", model, words, ["doc_id"])
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = table(spark, sf_dir, "documents")
    out = bpe.encode(docs, "text", public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], decoded=True)
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard.join(table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings with the same label."""
    return graph_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


#: The byte-level vocabulary leaves this id free for the end of a document.
END_OF_DOCUMENT = 50256


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat token files written from them.

    The files hold no document ids, so the counts are those of the n-th document of a file.
    """
    docs = table(spark, sf_dir, "documents")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    blocks = token_files.write_tokens(docs, "text", path, pattern, END_OF_DOCUMENT)
    return token_files.document_tokens(blocks, END_OF_DOCUMENT)


MIX_WEIGHTS = {("web",): 5, ("books",): 3, ("code",): 2, ("web", "en"): 4, ("books", "de"): 2, ("web", "en", "src0"): 3}


def mix_levels() -> dict[str, F.Column]:
    """Domain, language and source; domains stand in for a catalogue of sources."""
    number = F.expr("try_cast(regexp_extract(source, '^src([0-9]+)$', 1) as int) % 3")
    domain = F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "code").otherwise("other")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole copies and part of one more that every document gives to the mixture."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, "doc_id", mix_levels(), mixing.word_count("text"), MIX_WEIGHTS, share=0.8, max_epochs=2, seed=11)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of likely secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def line(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def op10_adaptive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return adaptive_search.nearest_neighbours(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation, after damage."""
    talks = table(spark, sf_dir, "conversations")
    names = ["conv_id", "turn", "role", "text"]
    damaged = conversations.damage(talks, *names)
    found = conversations.repair(damaged, *names)
    parts = [conversations.turn_gaps(damaged, "conv_id", "turn"), found.summary, conversations.text_hashes(found.rows)]
    out = talks.select("conv_id").distinct()
    for i, part in enumerate(parts):
        part = part.withColumnRenamed("conv", f"c{i}")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(f"c{i}")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between byte-level and word-piece tokens of every document."""
    docs = table(spark, sf_dir, "documents")
    paths = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    pattern = public_tokenizers.PATTERN
    out = alignment.align(docs, "doc_id", "text", lambda: alignment.byte_level(*paths[:2], pattern), lambda: alignment.word_pieces(paths[2]))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *numbers, digest.alias("groups_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings that repeat."""
    out = repeats.without_repeats(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_licenses": op2_licenses, "op3_pitman_yor": op3_pitman_yor, "op4_bpe": op4_bpe, "op5_ngram_jaccard": op5_ngram_jaccard, "op6_embedding_dedup": op6_embedding_dedup, "op7_token_counts": op7_token_counts, "op8_mixing": op8_mixing, "op9_secrets": op9_secrets, "op10_adaptive_search": op10_adaptive_search, "op11_conversation_repair": op11_conversation_repair, "op12_alignment": op12_alignment, "op13_suffix_dedup": op13_suffix_dedup}
OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g
  FROM words
), sizes AS (SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN grams USING (doc_id) GROUP BY d.doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 75 * (s.n + t.n - c)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT r.a AS doc_id, s.n AS n_shingles, min(r.b) AS component_id FROM reach r JOIN sizes s ON s.doc_id = r.a GROUP BY 1, 2
"""

OP6 = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {graph_dedup.SIMILAR}
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), groups AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM groups LEFT JOIN counts USING (vec_id)
"""


def _filled_sql(nodes: str, parent: str) -> str:
    """SQL of one level of budgets, over nodes(path..., node, room, weight, parent_budget)."""
    return f"""
    SELECT *, CASE WHEN is_full THEN room ELSE (weight::HUGEINT * (parent_budget - taken) // sharing)::BIGINT END AS budget FROM (
      SELECT *, coalesce(sum(room) FILTER (is_full) OVER (PARTITION BY {parent}), 0) AS taken, sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS sharing FROM (
        SELECT *, room::HUGEINT * sum(weight) OVER (PARTITION BY {parent} ORDER BY fill, node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= weight::HUGEINT * (parent_budget - coalesce(sum(room) OVER (PARTITION BY {parent} ORDER BY fill, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
        FROM (SELECT *, CASE WHEN room > 0 THEN room / weight::DOUBLE ELSE 0 END AS fill FROM ({nodes}))))"""


OP8 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(CASE try_cast(regexp_extract(source, '^src([0-9]+)$', 1) AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' END, 'other') AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL
), l1 AS ({_filled_sql("""SELECT *, least((SELECT floor(sum(tokens) * 0.8::DOUBLE)::BIGINT FROM leaves), sum(room) OVER ()) AS parent_budget
    FROM (SELECT domain, domain AS node, sum(tokens * 2)::BIGINT AS room, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS weight FROM leaves GROUP BY 1)""", "0")}
), l2 AS ({_filled_sql("""SELECT n.*, l1.budget AS parent_budget FROM (SELECT domain, lang, lang AS node, sum(tokens * 2)::BIGINT AS room,
    CASE WHEN domain = 'web' AND lang = 'en' THEN 4 WHEN domain = 'books' AND lang = 'de' THEN 2 ELSE 1 END AS weight FROM leaves GROUP BY 1, 2) n JOIN l1 USING (domain)""", "domain")}
), l3 AS ({_filled_sql("""SELECT n.*, l2.budget AS parent_budget FROM (SELECT domain, lang, source, source AS node, tokens, tokens * 2 AS room,
    CASE WHEN domain = 'web' AND lang = 'en' AND source = 'src0' THEN 3 ELSE 1 END AS weight FROM leaves) n JOIN l2 USING (domain, lang)""", "domain, lang")}
), plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM l3
), placed AS (
  SELECT d.*, p.epochs, p.rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('11:' || epochs || ':' || doc_id), doc_id) - n_tokens AS ahead
  FROM docs d JOIN plan p USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, epochs::BIGINT AS epochs, greatest(0, least(n_tokens, rest - ahead))::BIGINT AS part_tokens FROM placed
"""


def _license_sql() -> str:
    """Every window of every text against every template."""
    phrases = " || ".join(
        f"list_transform(list_filter(range(len(w) - {len(p.split()) - 1}), lambda i: w[i+1:i+{len(p.split())}] = {p.split()}), lambda i: {{'at': i, 'label': '{name}'}})"
        for p, name in licenses.PHRASES.items()
    )
    sets = ", ".join(f"('{name}', {sorted(set(t.split()))})" for name, t in licenses.TEMPLATES)
    return f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), base AS (SELECT doc_id, w, {phrases} AS p FROM docs
), templates(label, t) AS (VALUES {sets}
), windows AS (SELECT doc_id, w[s+1:s+{licenses.WINDOW}] AS b FROM (SELECT doc_id, w, unnest(range(0, len(w), {licenses.STEP})) AS s FROM docs)
), best AS (
  SELECT doc_id, list_distinct(list(label)) AS found, max(c / len(t)) AS score
  FROM (SELECT doc_id, label, t, len(list_intersect(t, b)) AS c FROM windows, templates) WHERE c >= ceil({licenses.THRESHOLD} * len(t) - 1e-9) GROUP BY 1
)
SELECT b.doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(list_transform(p, lambda x: x['at'])) AS first_word, list_max(list_transform(p, lambda x: x['at'])) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x['label']))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x['label']) || coalesce(found, []))), ','), '') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM base b LEFT JOIN best USING (doc_id)
"""


ORACLES: dict[str, str] = {"op2_licenses": _license_sql(), "op5_ngram_jaccard": OP5, "op6_embedding_dedup": OP6, "op8_mixing": OP8}
