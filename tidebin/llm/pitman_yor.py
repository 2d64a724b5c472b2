"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are words and one end for each text. Every word is a dish, and every preceding word
(and the start) is a restaurant that shares one parent restaurant over all words. The most
frequent `head` words are dishes of the parent by themselves; the others are its dish "rare",
which is a Pitman-Yor restaurant over the rare words with one table each and a uniform base
over them and one unknown word.

Pairs of the most frequent `contexts` words with head words are seated by Gibbs sweeps: for
every (context, word) the customers are seated again, given the tables of the context and
the parent's probabilities of the last sweep, so all pairs of a sweep are independent Spark
rows and only sums by context and by word (bounded numbers) meet on the driver. A pair seen
once has one table in any sweep and takes no part. Random numbers are hashes of seed, sweep,
pair and step: a task that runs again draws the same. Predictive probabilities are averaged
over the sweeps after `burn`. Pairs with a word outside the head have one table each, which
leaves nothing to draw.

Word counts and pair counts cover all training texts and stay distributed; nothing is left
out. Tasks are sent the head words and, with their averaged mass, the pairs seen at least so
often that at most `pairs` remain. All other pairs stay in parts, in proportion to the
training tokens: a pair of head words by the hash of both, a pair with a word outside the head
by the hash of that word (of the word before, if both are). A part so holds all that is known
of its words, and texts send it only the tokens that the sent pairs do not settle; what a part
finds is summed for each text. What tasks send each other are sorted arrays, compressed: a
row for each chunk of texts and part, not for each token.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebin.llm.shared import settle

HEAD = 50_000
CONTEXTS = HEAD
PAIRS = 2_000_000
STRENGTH = 1.0
BURN, SAMPLES = 2, 3
#: Customers of a pair that are seated one by one; later ones come in doubling groups.
SINGLE = 16
#: Tokens that a task counts words, and pairs, of before it hands its sums on, about.
COUNT_WORDS, COUNT_PAIRS = 2_000_000, 2_000_000
#: Bytes of text that a task splits at once, about.
SPLIT_BYTES = 4 << 20
#: Training tokens for each part of the pairs, and tokens of a chunk of scored texts, about.
PART_TOKENS, CHUNK_TOKENS = 2_000_000, 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """Repeatable numbers from 0 to 1 for each key."""
    return (mixed(mixed(keys.astype(np.uint64)) + np.uint64(draw)) >> np.uint64(11)) * 2.0**-53


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, keys: np.ndarray, draw: int) -> np.ndarray:
    """Tables that `customers` of one dish take; `fresh` is the weight of a new table."""
    tables = np.minimum(customers, 1).astype(np.float64)
    open_ = np.flatnonzero(customers > 1)
    seated, step, group = 1, 0, 1
    while len(open_):
        more = np.minimum(group, customers[open_] - seated)
        chance = fresh[open_] / (seated - discount * tables[open_] + fresh[open_])
        tables[open_] += np.floor(more * chance + uniform(keys[open_], draw * 64 + step))
        seated, step = seated + group, step + 1
        group = group * 2 if step >= SINGLE else 1
        open_ = open_[customers[open_] > seated]
    return tables


def discount_of(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


@dataclass
class Model:
    """What scoring sends to tasks: ids of head words, averaged probabilities, totals; and
    the table of all pairs in parts that it joins, `counted` (`part`, `data`).

    `back` is what the sent pairs leave of a context, `share` the part of it that is the
    parent's and not the other pairs', `lower` both; `least` is the smallest count that is sent.
    """

    ids: dict[bytes, int]
    counts: np.ndarray
    total: int
    types: int
    parent: np.ndarray
    contexts: int
    keys: np.ndarray
    mass: np.ndarray
    back: np.ndarray
    rare_total: int
    rare_types: int
    rare_discount: float
    share: np.ndarray
    discount: float
    salt: int
    lower: np.ndarray
    least: int
    chain: list
    seed: int
    parts: int
    counted: DataFrame | None
    words: DataFrame | None

    @property
    def follows(self) -> DataFrame:
        """`c`, `k`: the number of different words after each word outside the head."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, d, _, _ in _each(batches):
                c, k = np.unique(a[(a < 0) & (d == 0)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(k)], names=["c", "k"])

        return self.counted.mapInArrow(run, "c long, k long")

    @property
    def pairs(self) -> DataFrame:
        """`c`, `w` and `gain` of the pairs that are not sent: log10 of P(w | c) against what
        the parent alone gives w there."""
        sent = self.counted.sparkSession.sparkContext.broadcast(self.alone())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pairs in _each(batches):
                a, d, b, n, gain, _ = sent.value.part(*pairs)[:6]
                c, w = np.where(d == 1, b, a), np.where(d == 1, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c, w, gain)], names=["c", "w", "gain"])

        found = self.counted.mapInArrow(run, "c long, w long, gain double")
        both = (F.col("c") < 0) & (F.col("w") < 0)
        return found.filter(~both).unionByName(self.after(found.filter(both), F.col("gain")).select("c", "w", "gain"))

    def alone(self) -> Model:
        """Without the tables: what tasks are sent."""
        return replace(self, counted=None, words=None)

    def after(self, found: DataFrame, mass: Column) -> DataFrame:
        """`found`, of pairs of two words outside the head, with the `gain` of a `mass` over what
        the context leaves: the count of `w` comes from the table of words."""
        n = self.words.select(F.col("id").alias("w"), F.col("n").alias("__n"))
        base = float(self.parent[-1]) * (F.col("__n") + (self.rare_new() - self.rare_discount)) / max(self.rare_total, 1)
        return found.join(n, "w").withColumn("gain", F.log10(1 + mass / base)).drop("__n")

    def part(self, a: np.ndarray, d: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs of a part that are not sent (`a`, `d`, `b`, `n`) with their gain, and its
        words outside the head with their counts and numbers of different words after them.

        Of two words outside the head it is the mass over what the context leaves, without the
        base.
        """
        after = (a < 0) & (d == 0)
        rare, at = np.unique(a[after], return_inverse=True)
        n_a, k_a = np.bincount(at, n[after], len(rare)), np.bincount(at, minlength=len(rare)).astype(np.float64)
        drawn = _drawn(a, d, b, n, self.contexts)
        rest = ~drawn | (n < self.least)
        a, d, b, n, drawn, after = (x[rest] for x in (a, d, b, n, drawn, after))
        head = (a >= 0) | (d == 1)
        c = np.where(d == 1, b, a)
        left, mass, base = np.empty(len(a)), n - self.discount, np.ones(len(a))
        left[head] = (STRENGTH + self.counts[c[head]]) * self.lower[c[head]]
        at = np.searchsorted(rare, a[after])
        left[after] = STRENGTH + self.discount * k_a[at]
        if drawn.any():
            left[drawn] = self.lower[c[drawn]]
            mass[drawn] = averaged(a[drawn] * np.int64(len(self.parent)) + b[drawn], n[drawn], self.chain, self.seed, self.discount, self.counts, len(self.parent))
        known = (d == 0) & (b >= 0)
        base[known] = self.parent[b[known]]
        base[d == 1] = self.rare_base(n_a[np.searchsorted(rare, a[d == 1])])
        both = after & (b < 0)
        gain = mass / (left * base)
        gain[~both] = np.log10(1 + gain[~both])
        return a, d, b, n, gain, rare, n_a, k_a

    def rare_base(self, n: np.ndarray) -> np.ndarray:
        """Probability that the parent gives words outside the head that were seen `n` times."""
        own = np.where(n > 0, n - self.rare_discount, 0.0)
        return self.parent[-1] * (own + self.rare_new()) / max(self.rare_total, 1)

    def own(self, before: np.ndarray, dish: np.ndarray) -> np.ndarray:
        """Mass of the sent pairs; 0 for others."""
        if not len(self.keys):
            return np.zeros(len(dish))
        key = before * np.int64(len(self.parent)) + dish
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((before < self.contexts) & (self.keys[at] == key), self.mass[at], 0.0)

    def probability(self, before: np.ndarray, dish: np.ndarray) -> np.ndarray:
        """P(dish | word before) by the sent pairs, with all they leave given to the parent."""
        return self.parent[dish] * self.back[np.minimum(before, self.contexts)] + self.own(before, dish)

    def rare_new(self) -> float:
        """Customers that the base of "rare" adds to each rare word and the unknown one."""
        return (self.rare_discount * self.rare_types if self.rare_total else 1.0) / (self.rare_types + 1)


def rare_ids(words: pa.Array, salt: int) -> np.ndarray:
    """Negative ids of words (bytes) outside the head."""
    found = pd.util.hash_array(words.to_numpy(zero_copy_only=False), hash_key=f"{salt:016d}", categorize=False)
    return -1 - (found >> np.uint64(1)).astype(np.int64)


def _split(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Runs of rows, the words (bytes) of their texts in a row, and how many each text has."""
    for batch in batches:
        weight = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(weight // SPLIT_BYTES)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            rows = batch.slice(start, end - start)
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(rows.column(column), "")))
            words, sizes = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy()
            empty = pc.binary_length(words).to_numpy() == 0  # beside outer blanks, and in empty texts
            if empty.any():
                sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
                words = words.filter(pa.array(~empty))
            del lists
            if len(rows):
                yield rows, words, sizes
    pa.default_memory_pool().release_unused()


class _Ids:
    """Ids of words: from 0 in the head, given in this order, negative outside it."""

    def __init__(self, ids: dict[bytes, int], salt: int) -> None:
        self.head, self.salt, self.end = pa.array(list(ids), pa.binary()), salt, ids[b""]

    def of(self, words: pa.Array, sizes: np.ndarray) -> list[np.ndarray]:
        """For each text the ids of its words and of the end."""
        met = words.dictionary_encode()
        found = pc.index_in(met.dictionary, value_set=self.head)
        rare = found.is_null()
        ids = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids[rare.to_numpy(zero_copy_only=False)] = rare_ids(met.dictionary.filter(rare), self.salt)
        ends = np.cumsum(sizes + 1)
        out = np.full(len(words) + len(sizes), self.end)
        word = np.ones(len(out), bool)
        word[ends - 1] = False
        out[word] = ids[met.indices.to_numpy()]
        return np.split(out, ends[:-1])


def word_counts(df: DataFrame, text: str, salt: int = 0) -> DataFrame:
    """`word` (bytes; empty: the end), `n` over all texts, and the `id` it has outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def summed() -> pa.RecordBatch:
            word, n = pa.chunked_array(held, pa.binary()).value_counts().flatten()
            return pa.RecordBatch.from_arrays([pa.concat_arrays([word, pa.array([b""])]), pa.concat_arrays([n, pa.array([texts])])], names=["word", "n"])

        for _, words, sizes in _split(batches, 0):
            held.append(words)
            size, texts = size + len(words), texts + len(sizes)
            if size > COUNT_WORDS or sum(x.nbytes for x in held) > 8 * SPLIT_BYTES:
                yield summed()
                held, size, texts = [], 0, 0
        if held:
            yield summed()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rare_ids(batch.column(0), salt))], names=["word", "n", "id"])

    counted = df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(named, "word binary, n long, id long")


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, the first one's steps, compressed byte by byte without the high
    bytes that are 0 throughout."""
    found = [x.view(np.uint64) for x in (np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:])]
    widths = [-(-int(x.max(initial=0)).bit_length() // 8) for x in found]
    planes = [(x >> np.uint64(8 * i)).astype(np.uint8).tobytes() for x, w in zip(found, widths) for i in range(w)]
    return len(found[0]).to_bytes(8, "little") + bytes(widths) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    """The columns that were packed, as 64-bit integers; others are viewed by the caller."""
    n = int.from_bytes(data[:8], "little")
    if not n:
        return [np.zeros(0, np.int64)] * columns
    widths = data[8 : 8 + columns]
    planes = iter(np.frombuffer(pa.decompress(data[8 + columns :], decompressed_size=n * sum(widths), codec="zstd", asbytes=True), np.uint8).reshape(-1, n))
    out = [np.zeros((n, 8), np.uint8) for _ in range(columns)]
    for x, w in zip(out, widths):
        for i in range(w):
            x[:, i] = next(planes)
    first, *others = (x.view(np.int64)[:, 0] for x in out)
    return [np.cumsum(first), *others]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """`a`, `d`, `b` and `n` of every part."""
    for batch in batches:
        for data in batch.column(batch.schema.get_field_index("data")):
            yield unpack(data.as_py(), 4)


def _drawn(a: np.ndarray, d: np.ndarray, b: np.ndarray, n: np.ndarray, contexts: int) -> np.ndarray:
    """Pairs of head words whose tables are drawn."""
    return (a >= 0) & (a < contexts) & (d == 0) & (b >= 0) & (n > 1)


def _names(found: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids that occur, sorted (those from 0 to size - 1 whether or not), and where each of `found` stands."""
    rare = found < 0
    some, at = np.unique(found[rare], return_inverse=True)
    out = found + len(some)
    out[rare] = at
    return np.r_[some, np.arange(size)], out


def _keys(texts: list[np.ndarray], start: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids that occur and, of each token, a number for the pair it ends; and of each text where it starts.

    Numbers sort by `a`, the word by which a pair is dealt, `d` (1 if `a` is the second word, 0 if
    the first) and `b`, the other word. `start` stands before the first token.
    """
    names, found = _names(np.concatenate(texts), size)
    rare = len(names) - size
    first = np.cumsum([0, *map(len, texts[:-1])])
    before = np.r_[0, found[:-1]]
    before[first] = rare + start
    d = (before >= rare) & (found < rare)
    return names, (np.where(d, found, before) * 2 + d) * np.int64(len(names)) + np.where(d, before, found), first


def _pairs(key: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`a`, `d` and `b` of a pair's number."""
    a, b = np.divmod(key, len(names))
    return names[a >> 1], a & 1, names[b]


def _part(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    by = np.where((a >= 0) & (b >= 0), mixed(a.astype(np.uint64)) + b.astype(np.uint64), a.astype(np.uint64))
    return (mixed(by) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)


def _starts(key: np.ndarray) -> np.ndarray:
    """Where each number begins among sorted ones."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and where it stands, in order."""
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(at):
            yield int(part[at[0]]), at


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "data"])


def pair_counts(df: DataFrame, text: str, ids: dict[bytes, int], salt: int, parts: int) -> DataFrame:
    """`part` and, as `data`, its pairs: `a`, `d`, `b` and `n`, sorted."""
    sent = df.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = _Ids(sent.value, salt), [], 0

        def summed() -> pa.RecordBatch:
            names, key, _ = _keys(held, ids.end, len(sent.value))
            key = np.sort(key)
            at = _starts(key)
            n = np.diff(np.r_[at, len(key)])
            a, d, b = _pairs(key[at], names)
            return _blobs([(p, pack(a[i], d[i], b[i], n[i])) for p, i in _dealt(_part(a, b, parts))])

        for _, words, sizes in _split(batches, 0):
            for found in ids.of(words, sizes):
                held.append(found)
                size += len(found)
                if size > COUNT_PAIRS:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    def merged(rows: pa.Table) -> pa.Table:
        a, d, b, n = (np.concatenate(x) for x in zip(*_each(rows.to_batches())))
        names, at = _names(np.concatenate([a, b]), max(0, int(a.max()), int(b.max())) + 1)
        key = (at[: len(a)] * 2 + d) * np.int64(len(names)) + at[len(a) :]
        order = np.argsort(key)
        key = key[order]
        at = _starts(key)
        return pa.Table.from_batches([_blobs([(rows["part"][0].as_py(), pack(*_pairs(key[at], names), np.add.reduceat(n[order], at)))])])

    found = df.select(text).mapInArrow(run, "part int, data binary")
    return found.repartition(parts, "part").groupBy("part").applyInArrow(merged, "part int, data binary")


def _tables(pairs: DataFrame, sweep: int, seed: int, discount: float, opened: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One sweep over `pairs` (`key`: context * dishes + dish, `n`): tables by context and by dish."""
    dishes, contexts = len(parent), len(opened)
    sent = pairs.sparkSession.sparkContext.broadcast((opened, parent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_of, probs = sent.value
        by_context, by_dish = np.zeros(contexts), np.zeros(dishes)
        for batch in batches:
            key, n = (batch.column(i).to_numpy() for i in range(2))
            context, dish = np.divmod(key, dishes)
            t = seat(n, (STRENGTH + discount * tables_of[context]) * probs[dish], discount, key + seed, sweep)
            by_context += np.bincount(context, t, contexts)
            by_dish += np.bincount(dish, t, dishes)
        at = np.r_[np.flatnonzero(by_context), np.flatnonzero(by_dish) + contexts]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.r_[by_context, by_dish][at].astype(np.int64))], names=["at", "t"])

    out = _added(pairs.mapInArrow(run, "at long, t long"), contexts + dishes)
    return out[:contexts], out[contexts:]


def parent_probabilities(customers: np.ndarray, discount: float, sweep: int, seed: int, last: np.ndarray) -> np.ndarray:
    """Seat the parent's customers, given its last probabilities, over a uniform base."""
    n = len(customers)
    opened = (STRENGTH + discount * np.count_nonzero(customers)) / n
    t = seat(customers.astype(np.int64), np.full(n, opened), discount, np.arange(n) + seed, sweep)
    return (customers - discount * t + (STRENGTH + discount * t.sum()) / n) / (STRENGTH + customers.sum())


def _added(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of `t` by `at`, from 0 to size - 1."""
    found = rows.groupBy("at").agg(F.sum("t").alias("t")).toArrow()
    out = np.zeros(size)
    out[found["at"].to_numpy()] = found["t"].to_numpy()
    return out


def _totals(counted: DataFrame, size: int, contexts: int) -> tuple[np.ndarray, ...]:
    """Pairs seen once and twice; pairs that are not drawn by head context and by dish; drawn pairs by context."""
    ends = np.cumsum([2, size, size + 1, contexts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(ends[-1], np.int64)
        for a, d, b, n in _each(batches):
            drawn = _drawn(a, d, b, n, contexts)
            c, w = np.where(d == 1, b, a), np.where(d == 1, a, b)
            own = w[~drawn]
            for at in (n[n <= 2] - 1, c[~drawn & (c >= 0)] + ends[0], np.where(own < 0, size, own) + ends[1], a[drawn] + ends[2]):
                out += np.bincount(at, minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["at", "t"])

    return tuple(np.split(_added(counted.mapInArrow(run, "at long, t long"), int(ends[-1])), ends[:-1]))


def _sampled(counted: DataFrame, dishes: int, contexts: int) -> DataFrame:
    """`key` (context * dishes + dish) and `n` of the pairs that are drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in _each(batches):
            a, _, b, n = (x[_drawn(*pairs, contexts)] for x in pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a * np.int64(dishes) + b), pa.array(n)], names=["key", "n"])

    return counted.mapInArrow(run, "key long, n long")


def learn(df: DataFrame, text: str, head: int = HEAD, contexts: int = CONTEXTS, pairs: int = PAIRS, seed: int = 0) -> tuple[Model, DataFrame]:
    """The model and the table of all word counts (`word`, `n`, `id`) it was learned from.

    `head`, `contexts` and `pairs` bound what is drawn and sent to tasks, not what is learned.
    Null texts are empty texts: one end token. Without texts, every probability is uniform
    over the end and "rare".
    """
    for salt in range(16):
        words = settle(word_counts(df, text, salt))
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            break
    else:
        raise ValueError("two words share an id")
    total = words.agg(F.sum("n"), F.count("n")).first()
    top = words.orderBy(F.desc("n"), "word").limit(head).collect()
    ids = {bytes(r.word): i for i, r in enumerate(top)}
    counts = np.array([r.n for r in top], np.int64)
    if b"" not in ids:
        ids[b""] = len(ids)
        ends = words.filter(F.length("word") == 0).agg(F.sum("n")).first()[0]
        counts = np.r_[counts, np.int64(ends or 0)]
    size, contexts = len(ids), min(contexts, len(ids))
    dishes = size + 1
    parts = max(1, -(-int(total[0] or 0) // PART_TOKENS))
    counted = settle(pair_counts(df, text, ids, salt, parts))
    many, fixed, direct, seen = _totals(counted, size, contexts)
    discount = discount_of(int(many[0]), int(many[1]))
    sampled = settle(_sampled(counted, dishes, contexts))
    opened = fixed[:contexts] + seen
    rare_total = int((total[0] or 0) - counts.sum())
    parent = np.r_[counts, rare_total] + 0.5
    parent /= parent.sum()
    chain = []
    for sweep in range(BURN + SAMPLES):
        given = (opened, parent)
        opened, by_dish = _tables(sampled, sweep, seed, discount, *given)
        opened = opened + fixed[:contexts]
        guests = by_dish + direct
        parent = parent_probabilities(guests, discount_of(int((guests == 1).sum()), int((guests == 2).sum())), sweep, seed, parent)
        if sweep >= BURN:
            chain.append((sweep, given, opened, parent))
    parent = np.mean([p for *_, p in chain], axis=0)
    tables = np.r_[np.mean([o for *_, o, _ in chain], axis=0), fixed[contexts:]]
    chain = [(sweep, *given) for sweep, given, *_ in chain]
    lower = (STRENGTH + discount * tables) / (STRENGTH + counts)

    often = sampled.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().collect()
    least, kept = 2, 0
    for n, size_n in sorted(((r["n"], r["count"]) for r in often), reverse=True):
        if kept + size_n > pairs:
            least = n + 1
            break
        kept += size_n
    rows = _masses(sampled.filter(F.col("n") >= least), chain, seed, discount, counts, dishes).toArrow()
    order = np.argsort(rows["key"].to_numpy())
    keys, mass = rows["key"].to_numpy()[order], rows["mass"].to_numpy()[order]
    back = 1 - np.bincount(keys // dishes, mass, contexts) if len(keys) else np.ones(contexts)

    rare = words.join(F.broadcast(df.sparkSession.createDataFrame([(bytearray(w),) for w in ids], "word binary")), "word", "left_anti")
    spread = rare.agg(F.count("n"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    model = Model(
        ids, counts, int(total[0] or 0), int(total[1]), parent, contexts, keys, mass, np.r_[back, 1.0],
        rare_total, spread[0], discount_of(spread[1] or 0, spread[2] or 0),
        np.r_[lower[:contexts] / back, lower[contexts:]], discount, salt, lower, least, chain, seed, parts, counted, words,
    )
    return model, words


def averaged(key: np.ndarray, n: np.ndarray, chain: list, seed: int, discount: float, customers: np.ndarray, dishes: int) -> np.ndarray:
    """Own mass (n - discount * tables) / (strength + customers) of drawn pairs, over the sweeps."""
    context, dish = np.divmod(key, dishes)
    mass = np.zeros(len(key))
    for sweep, opened, probs in chain:
        t = seat(n, (STRENGTH + discount * opened[context]) * probs[dish], discount, key + seed, sweep)
        mass += (n - discount * t) / (STRENGTH + customers[context])
    return mass / len(chain)


def _masses(pairs: DataFrame, chain: list, seed: int, discount: float, customers: np.ndarray, dishes: int) -> DataFrame:
    """`key` and averaged own `mass`."""
    sent = pairs.sparkSession.sparkContext.broadcast((chain, customers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweeps, seated = sent.value
        for batch in batches:
            key, n = (batch.column(i).to_numpy() for i in range(2))
            mass = averaged(key, n, sweeps, seed, discount, seated, dishes)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(mass)], names=["key", "mass"])

    return pairs.mapInArrow(run, "key long, mass double")


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number stands among sorted `keys`, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _place(rare: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ids stand, those outside the head among the sorted `rare`, and whether they do."""
    out, known = wanted + len(rare), np.ones(len(wanted), bool)
    some = wanted < 0
    out[some], known[some] = _found(rare, wanted[some])
    return out, known


def _wide(sums: np.ndarray, size: int) -> np.ndarray:
    return sums if sums.shape[1] >= size else np.pad(sums, ((0, 0), (0, size - sums.shape[1])))


def score(df: DataFrame, text: str, model: Model, words: DataFrame, keep: Sequence[str]) -> DataFrame:
    """`keep` columns, `n_tokens`, `n_known`, `base_score`, `score` (log10 probability) and
    `perplexity` of every row.

    `base_score` is the smoothed unigram: log10((c+0.5)/(N+0.5*(V+1))) summed over tokens.
    Null and empty texts hold one token, the end. Repeated rows score alike; extra columns
    play no part. Texts are numbered in chunks as tasks read them: a task that runs again must
    read them in the same order, as it does from files.
    """
    sent = df.sparkSession.sparkContext.broadcast(model.alone())
    norm = model.total + 0.5 * (model.types + 1)
    n_keep, parts = len(keep), model.parts
    kept = [df.schema[c] for c in keep]
    stats = [T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("known", "base", "total")]]
    own = [T.StructField("data", T.BinaryType()), T.StructField("chunk", T.LongType()), T.StructField("at", T.LongType())]
    named = [T.StructField(f"__{i}", f.dataType) for i, f in enumerate(kept)]
    made = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), *own, *stats, *named])
    arrow = to_arrow_schema(made)

    def filled(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        ids, rare, start_id = _Ids(m.ids, m.salt), len(m.ids), m.ids[b""]
        logs = np.r_[np.log10((m.counts + 0.5) / norm), 0.0]
        known = np.r_[m.counts > 0, False].astype(np.float64)
        words_, share = np.log10(m.parent), np.r_[np.log10(m.share * m.back[np.minimum(np.arange(rare), m.contexts)]), 0.0]
        words_[-1] = 0.0  # words outside the head are added by their part
        chunk, held, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def sums() -> Iterator[pa.RecordBatch]:
            """The held texts by the head words and the sent pairs; and what is left, to the parts."""
            names, key, first = _keys(held, start_id, rare)
            row = np.repeat(np.arange(len(held)), np.diff(np.r_[first, len(key)]))
            found = np.concatenate(held)
            dish = np.where(found < 0, rare, found)
            last = np.r_[0, dish[:-1]]
            last[first] = start_id
            total = np.add.reduceat(words_[dish] + share[last], first)
            order = np.argsort(key)
            key, row = key[order], row[order]
            at = _starts(key)
            a, d, b = _pairs(key[at], names)
            head = np.flatnonzero((a >= 0) & (b >= 0))
            mass = np.zeros(len(at))
            mass[head] = m.own(a[head], b[head])
            sure = mass > 0
            gain = np.zeros(len(at))
            gain[sure] = np.log10(1 + mass[sure] / (m.parent[b[sure]] * 10.0 ** share[a[sure]]))
            pair = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(key)]))
            total += np.bincount(row, gain[pair], len(held))
            cols = [np.arange(len(held)), np.array([len(x) for x in held]), *(np.add.reduceat(x[dish], first) for x in (known, logs)), total]
            cols = {k: pa.array(x) for k, x in zip(("at", "n_tokens", "known", "base", "total"), cols)}
            n = 0
            for batch in texts:
                some = {k: x.slice(n, batch.num_rows) for k, x in cols.items()} | {f"__{k}": batch.column(k) for k in range(n_keep)}
                of = {k: pa.array(np.full(batch.num_rows, x)) for k, x in (("part", -1 - (chunk + (chunk >> 32)) % (1 << 31)), ("kind", 2), ("chunk", chunk))}
                yield filled(batch.num_rows, **of, **some)
                n += batch.num_rows
            for p, i in _dealt(np.where(sure, parts, _part(a, b, parts))[pair].astype(np.uint16 if parts < 65535 else np.int64)):
                if p < parts:
                    data = pack(a[pair[i]], d[pair[i]], b[pair[i]], row[i])
                    yield filled(1, part=pa.array([p]), kind=pa.array([1]), chunk=pa.array([chunk]), data=pa.array([data], pa.binary()))

        for batch, words, sizes in _split(batches, n_keep):
            first = 0
            for i, found in enumerate(ids.of(words, sizes)):
                held.append(found)
                size += len(found)
                if size > CHUNK_TOKENS:
                    texts.append(batch.slice(first, i + 1 - first))
                    yield from sums()
                    first, chunk, held, texts, size = i + 1, chunk + 1, [], [], 0
            if first < batch.num_rows:
                texts.append(batch.slice(first))
        if held:
            yield from sums()

    def looked_up(batches: Iterator[pa.RecordBatch], both: bool) -> Iterator[pa.RecordBatch]:
        """Sums of what the part's pairs and words add to each text, and the rows of texts; or,
        if `both`, the tokens of known pairs of two words outside the head."""
        m, part = sent.value, None

        def held(data: bytes | None) -> list[np.ndarray]:
            pairs = unpack(data, 4) if data else [np.zeros(0, np.int64)] * 4
            return [x[(pairs[0] < 0) & (pairs[1] == 0)] for x in pairs] if both else pairs

        for batch in batches:
            kinds, numbers = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            texts = np.flatnonzero(kinds == 2)
            if len(texts) and not both:
                yield batch.take(pa.array(texts))
            for i in np.flatnonzero(kinds < 2):
                if kinds[i] == 0 or numbers[i] != part:
                    part = numbers[i]
                    keys = right = gain = rare = n_rare = k_rare = None  # a task holds one part at a time
                    a, d, b, _, gain, rare, n_rare, k_rare = m.part(*held(batch.column(2)[i].as_py() if kinds[i] == 0 else None))
                    right = np.unique(b[b < 0])
                    size = np.int64(len(right) + len(m.ids))
                    keys = (_place(rare, a)[0] * 2 + d) * size + _place(right, b)[0]
                    del a, d, b, _
                if kinds[i] == 0:
                    continue
                a_, d_, b_, row = unpack(batch.column(2)[i].as_py(), 4)
                if both:
                    a_, d_, b_, row = (x[(a_ < 0) & (b_ < 0)] for x in (a_, d_, b_, row))
                (x, is_a), (y, is_b) = _place(rare, a_), _place(right, b_)
                at, is_pair = _found(keys, (x * 2 + d_) * size + y)
                is_pair &= is_a & is_b
                if both:
                    n = int(is_pair.sum())
                    cols = [np.full(n, batch.column(3)[i].as_py()), row[is_pair], b_[is_pair], gain[at[is_pair]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["chunk", "at", "w", "mass"])
                    continue
                is_pair &= (a_ >= 0) | (b_ >= 0)
                total, word = np.zeros(len(row)), (a_ < 0) & (d_ == 0)
                total[is_pair] = gain[at[is_pair]]
                at, is_rare = _found(rare, a_[word])
                if len(rare):
                    n, k = np.where(is_rare, n_rare[at], 0.0), np.where(is_rare, k_rare[at], 0.0)
                else:
                    n = k = np.zeros(len(at))
                total[word] += np.log10(m.rare_base(n)) + np.where(n > 0, np.log10((STRENGTH + m.discount * k) / (STRENGTH + n)), 0.0)
                some = int(row.max()) + 1
                sums = [np.bincount(row[word], n > 0, some), np.bincount(row[word], np.log10((n + 0.5) / norm), some), np.bincount(row, total, some)]
                some = np.flatnonzero((sums[1] != 0) | (sums[2] != 0))
                data = pack(some.astype(np.int64), *[x[some] for x in sums])
                yield filled(1, kind=pa.array([1]), chunk=batch.column(3).slice(i, 1), data=pa.array([data], pa.binary()))

    names = [f.name for f in arrow if f.name not in ("part", "kind", "data", "chunk", "at")]
    final = T.StructType([f for f in made if f.name in names])
    final_arrow = to_arrow_schema(final)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts with the sums of all parts, which come before them."""
        chunk, sums = None, np.zeros((3, 0))
        for batch in batches:
            kinds, chunks = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(chunks * 4 + kinds)) + 1):
                if not len(at):
                    continue
                if chunks[at[0]] != chunk:
                    chunk, sums = chunks[at[0]], np.zeros((3, 0))
                part = batch.slice(at[0], len(at))
                own = part.column(4).to_numpy(zero_copy_only=False) if kinds[at[0]] != 1 else None
                if kinds[at[0]] == 0:
                    sums = _wide(sums, int(own.max()) + 1)
                    sums[2] += np.bincount(own.astype(np.int64), part.column(8).to_numpy(), sums.shape[1])
                elif kinds[at[0]] == 1:
                    for data in part.column(2):
                        row, *found = unpack(data.as_py(), 4)
                        if len(row):
                            sums = _wide(sums, int(row[-1]) + 1)
                            sums[:, row] += [x.view(np.float64) for x in found]
                else:
                    own = own.astype(np.int64)
                    sums = _wide(sums, int(own.max()) + 1)
                    cols = {n: part.column(arrow.get_field_index(n)) for n in names}
                    cols |= {n: pa.array(cols[n].to_numpy() + x[own]) for n, x in zip(("known", "base", "total"), sums)}
                    yield pa.RecordBatch.from_arrays([cols[n].cast(final_arrow.field(n).type) for n in names], schema=final_arrow)

    rows = df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, made)
    pairs = model.counted.select("part", F.lit(0).alias("kind"), "data")
    dealt = rows.unionByName(pairs, allowMissingColumns=True).repartition(parts, "part").sortWithinPartitions("part", "kind")
    strange = model.after(dealt.mapInArrow(partial(looked_up, both=True), "chunk long, at long, w long, mass double"), F.col("mass"))
    strange = strange.groupBy("chunk", "at").agg(F.sum("gain").alias("total")).withColumn("kind", F.lit(0))
    found = dealt.mapInArrow(partial(looked_up, both=False), made).unionByName(strange, allowMissingColumns=True)
    out = found.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(added, final)
    return out.select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)],
        "n_tokens",
        F.col("known").cast("long").alias("n_known"),
        F.col("base").alias("base_score"),
        F.col("total").alias("score"),
        F.pow(F.lit(10.0), -F.col("total") / F.col("n_tokens")).alias("perplexity"),
    )
