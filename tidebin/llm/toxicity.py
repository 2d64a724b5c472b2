"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters and digit substitutions become one
plain letter, accents go, everything else separates words. The lexicon is learned from
labelled rows: words and stems (word beginnings) whose share of toxic documents is many
times their share of clean ones, found in enough different contexts (copies of one text
count once). An automaton finds the entries at word starts, each word counts with the
largest weight of its matches, matches inside exception phrases do not count, and the sum
of weights is normalised by text length. One logistic curve, fitted on the labelled rows,
turns that density into a score.

What the driver and the tasks hold is bounded by `candidates`, `lexicon_size` and `BINS`.
An entry that ends in a space is a whole word, any other a stem.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebin.llm.shared import map_texts, settle

#: Harmless phrases with words that are often in a lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "class clown", "stupid simple")
#: Letters of other scripts, digits and signs that stand for a plain letter.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k",
    "м": "m", "н": "h", "т": "t", "в": "b", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "α": "a", "ε": "e",
    "ο": "o", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
BINS = 4096
BINS_PER_UNIT = 64
#: Entries a task counts before it hands its sums on.
COUNT_ENTRIES = 400_000


class Folding(dict):
    """A translation table that fills itself; l and i become one letter, as 1 may stand for both."""

    def __missing__(self, code: int) -> str:
        char = chr(code).lower()
        char = LOOK_ALIKES.get(char, char)
        plain = unicodedata.normalize("NFKD", char).lower()
        if plain[:1] in LOOK_ALIKES:
            plain = LOOK_ALIKES[plain[:1]]
        if plain and "a" <= plain[0] <= "z":
            letters = "".join(c for c in plain if "a" <= c <= "z")
        elif unicodedata.category(char[:1]).startswith("M") or char in "­​‌‍﻿":
            letters = ""  # accents and invisible characters join what they stand in
        elif unicodedata.category(char[:1])[0] == "L":
            letters = char
        else:
            letters = " "
        self[code] = letters.replace("l", "i")
        return self[code]


def fold(text: str, table: Folding) -> str:
    return text.translate(table)


@dataclass
class Model:
    """Weights of folded words, exception phrases, and the logistic curve over the density."""

    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    slope: float = 0.0
    offset: float = 0.0
    matcher: object = field(default=None, repr=False, compare=False)

    def build(self) -> "Model":
        import ahocorasick

        self.table = Folding()
        self.matcher = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            self.matcher.add_word(" " + word, (len(word), weight))
        for phrase in self.exceptions:
            words = " ".join(fold(phrase, self.table).split())
            self.matcher.add_word(f" {words} ", (len(words) + 1, None))
        if len(self.matcher):
            self.matcher.make_automaton()
        return self

    def density(self, text: str) -> tuple[float, int]:
        """Sum of weights over the square root of the number of words; number of matches."""
        words = fold(text, self.table).split()
        if not words or not len(self.matcher):
            return 0.0, 0
        hits: dict[int, float] = {}
        free = []
        for end, (size, weight) in self.matcher.iter(" " + " ".join(words) + " "):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        if free:
            hits = {at: w for at, w in hits.items() if not any(x <= at < y for x, y in free)}
        return sum(hits.values()) / math.sqrt(len(words)), len(hits)

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * math.log1p(BINS_PER_UNIT * density)))))


STEMS = range(4, 9)
#: Labelled rows to learn from at most; their ids and labels (16 bytes each) are broadcast.
TRAIN_ROWS = 200_000


def labelled_rows(
    df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, held_out: Column, train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """`text` and `toxic` of at most `train_rows` labelled documents that are not held out.

    `held_out` is a condition on the ids of `labels`. If there are more, those with the
    smallest hashes of the id are taken. Ids or labels that are null teach nothing; an id
    labelled twice counts twice. The rows are written to the shared folder once, as
    learning reads them several times.
    """
    wanted = labels.filter(~held_out).select(F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("toxic"))
    wanted = wanted.filter("__id is not null and toxic in (0, 1)").orderBy(F.xxhash64("__id"), "__id", "toxic").limit(train_rows)
    texts = df.select(F.col(doc_id).cast("long").alias("__doc"), F.col(text).alias("text"))
    return settle(texts.join(F.broadcast(wanted), F.col("__doc") == F.col("__id")).select("text", "toxic"))


def entries_of(words: set[str]) -> set[str]:
    """The possible lexicon entries that a document with these words holds."""
    out = {w + " " for w in words}
    for size in STEMS:
        out.update([w[:size] for w in words if len(w) >= size])
    return out


def _entry_counts(df: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """Documents that hold an entry, summed by task in bounded steps and then by Spark."""
    schema = T.StructType([T.StructField("entry", T.StringType()), T.StructField("docs", T.LongType())])
    arrow = to_arrow_schema(schema)
    only = df.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches):
        table, counts = Folding(), Counter()

        def emptied():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=arrow)
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                held = entries_of(set(fold(text.as_py() or "", table).split()))
                counts.update(held & only.value if only else held)
                if len(counts) > COUNT_ENTRIES:
                    yield emptied()
        if counts:
            yield emptied()

    return df.select("text").mapInArrow(run, schema).groupBy("entry").agg(F.sum("docs").alias("docs"))


def _contexts(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Different pairs of neighbouring words of each entry."""
    schema = T.StructType([T.StructField("entry", T.StringType()), T.StructField("around", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        table, inside = Folding(), set(wanted)
        for batch in batches:
            for text in batch.column(0):
                words = fold(text.as_py() or "", table).split()
                found = set()
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    found.update((e, f"{before} {after}") for e in entries_of({word}) & inside)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], schema=arrow)

    return df.select("text").mapInArrow(run, schema).distinct().groupBy("entry").agg(F.count("around").alias("contexts"))


def learn(
    labelled: DataFrame,
    text: str,
    label: str,
    lexicon_size: int = 5000,
    candidates: int = 100_000,
    min_share: float = 0.01,
    min_contexts: int = 5,
    min_log_odds: float = 3.0,
    exceptions: Sequence[str] = EXCEPTIONS,
) -> Model:
    """Lexicon and curve from labelled rows; rows with a null label teach nothing.

    Candidates are the entries that most toxic documents hold. One joins the lexicon if
    the log odds of its document shares reach `min_log_odds`, which then is its weight,
    and toxic documents hold it in at least `min_contexts` different contexts and
    `min_share` contexts for each toxic document. A stem gives way to a longer entry that
    is found nearly as often. Ties go by entry. Without toxic or without clean rows the
    lexicon is empty.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("toxic")).filter("toxic in (0, 1)")
    total = rows.agg(F.sum("toxic").alias("toxic"), F.count("toxic").alias("all")).first()
    n_toxic, n_clean = total["toxic"] or 0, total["all"] - (total["toxic"] or 0)
    if not n_toxic or not n_clean:
        return Model({}, exceptions, 0.0, math.log((n_toxic + 0.5) / (n_clean + 0.5)))
    least = max(3, min_share * n_toxic)
    toxic = _entry_counts(rows.filter("toxic = 1")).filter(F.col("docs") >= min(least, min_contexts))
    often = {r.entry: r.docs for r in toxic.orderBy(F.desc("docs"), "entry").limit(candidates).collect()}
    clean = {r.entry: r.docs for r in _entry_counts(rows.filter("toxic = 0"), set(often)).collect()}
    weights = {e: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(e, 0) + 0.5) / (n_clean + 1)) for e, n in often.items()}
    strong = sorted((e for e, w in weights.items() if w >= min_log_odds), key=lambda e: (-weights[e], e))[: 4 * lexicon_size]
    contexts = {r.entry: r.contexts for r in _contexts(rows.filter("toxic = 1"), strong).collect()} if strong else {}
    good = [e for e in strong if contexts.get(e, 0) >= max(min_contexts, min_share * n_toxic)]
    longest = dict.fromkeys(good, 0)
    for e in good:
        for size in STEMS:
            if size < len(e) and e[:size] in longest:
                longest[e[:size]] = max(longest[e[:size]], often[e])
    lexicon = [e for e in good if longest[e] < 0.8 * often[e]][:lexicon_size]
    model = Model({e: weights[e] for e in lexicon}, exceptions)
    bins = (
        densities(rows, "text", model, ["toxic"])
        .groupBy(F.least(F.lit(BINS), F.ceil(F.col("density") * BINS_PER_UNIT)).cast("int").alias("bin"))
        .agg(F.sum("toxic").alias("toxic"), F.count("toxic").alias("all"))
        .collect()
    )
    model.slope, model.offset = fit_curve([(math.log1p(r["bin"]), r["toxic"], r["all"]) for r in bins])
    return model


def fit_curve(bins: list[tuple[float, int, int]], ridge: float = 0.5, steps: int = 100) -> tuple[float, float]:
    """Slope (not below 0) and offset of a logistic curve over weighted points, by Newton's method."""
    slope, offset = 0.0, math.log((sum(t for _, t, _ in bins) + 0.5) / (sum(n - t for _, t, n in bins) + 0.5))
    for _ in range(steps):
        g0 = g1 = h00 = h01 = 0.0
        g1, h11 = -ridge * slope, ridge
        for x, toxic, n in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, offset + slope * x))))
            w = n * p * (1 - p)
            g0, g1 = g0 + toxic - n * p, g1 + x * (toxic - n * p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        h00 += 1e-9
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        step = ((h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det)
        size = max(1.0, abs(step[0]), abs(step[1]))
        offset, slope = offset + step[0] / size, slope + step[1] / size
        if max(map(abs, step)) < 1e-9:
            break
    return max(slope, 0.0), offset


def densities(df: DataFrame, text: str, model: Model, keep: Sequence[str]) -> DataFrame:
    weights, exceptions, slope, offset = model.weights, tuple(model.exceptions), model.slope, model.offset

    def make():
        built = Model(weights, exceptions, slope, offset).build()

        def one(value: str) -> tuple:
            density, matches = built.density(value)
            return density, matches, built.score(math.ceil(density * BINS_PER_UNIT) / BINS_PER_UNIT)

        return one

    added = T.StructType(
        [T.StructField("density", T.DoubleType()), T.StructField("matches", T.LongType()), T.StructField("score", T.DoubleType())]
    )
    return map_texts(df, keep, text, added, make)


def score(df: DataFrame, text: str, model: Model, keep: Sequence[str]) -> DataFrame:
    """`keep` columns, `density`, `matches` and `score` (0 to 1, higher: more likely toxic).

    Null and empty texts have density 0 and the score of a text without a match. Every row
    gives one row; repeated rows score alike; other columns play no part.
    """
    return densities(df, text, model, keep)
