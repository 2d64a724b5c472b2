"""Alignment of two tokenizers' tokens by the bytes they cover.

For each text, the cumulative byte ends of both token lists become dictionaries from end
to index. The ends in both dictionaries, sorted, slice the two id lists into groups, and
within a slice every pair of tokens whose bytes overlap is a link.

Texts are encoded once, in blocks of about `BLOCK` links: a task writes packs of token ids
and, for each block, its distinct linked id pairs with their counts. Counts of a pair are
summed over all blocks; each block gets back the counts of its own pairs, so what moves is
a block's distinct pairs and not its links, and no task holds more than a block's pairs.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebin.llm.shared import FLUSH_BYTES, settle

#: Links after which a block ends, and tokens after which a pack does.
BLOCK = 2_000_000
PACK = 16_384
#: Texts that both libraries split alike whatever their Unicode version, without long runs.
PLAIN = re.compile(r"[\x00-\x7f\xa1-\xac\xae-\u024f\u2010-\u2027]*")
LONG = 400
SPACES = re.compile(r"\s{%d}" % LONG)


class Side(NamedTuple):
    """A tokenizer: `encode` from text to ids, the bytes of each id, and whether the bytes of
    every text come back whole, as a byte-level vocabulary without normaliser gives them."""

    encode: Callable[[str], list[int]]
    pieces: list[bytes]
    lossless: bool = False

    def spells(self, ids: list[int], whole: bytes) -> bool:
        return self.lossless or whole == b"".join(map(self.pieces.__getitem__, ids))


def long_run(text: str) -> bool:
    """Whether `LONG` characters on end are all white space or all other than it; white space
    so long shows in two neighbours of every `LONG / 2`-th character."""
    if len(text) < LONG:
        return False
    if re.search(r"\s\s", text[:: LONG // 2]) and SPACES.search(text):
        return True
    return max(map(len, text.split()), default=0) >= LONG


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for
    itself, the other bytes for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def byte_level(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> Side:
    """A byte-level vocabulary of the tokenizers library, for a text with a space before it.

    `ranks_path` and `pattern` give the same vocabulary as ranks, which encodes plain texts faster.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    whole.encode_special_tokens = True
    alphabet = byte_alphabet()
    lossless = whole.normalizer is None and set(alphabet) <= whole.get_vocab().keys()
    pieces = [b""] * whole.get_vocab_size()
    for token, i in whole.get_vocab().items():
        pieces[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()

    def encode(text: str) -> list[int]:
        return whole.encode(" " + text, add_special_tokens=False).ids

    if ranks_path is None:
        return Side(encode, pieces, lossless)
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def either(text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not long_run(text):
            return fast.encode_ordinary(" " + text)
        return encode(text)

    return Side(either, pieces, lossless)


@functools.cache
def word_pieces(model_path: str) -> Side:
    """A sentencepiece model, which adds the space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return Side(lambda text: model.encode(text, num_threads=1), pieces)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group stops in both token lists: the ends of B, in order, that the
    dictionary of A's ends holds."""
    at_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
    stop_a = np.fromiter(map(at_a.get, ends_b.tolist(), repeat(0)), np.int64, len(ends_b))
    common = np.flatnonzero(stop_a)
    return stop_a[common], common + 1


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of tokens whose bytes overlap: within a slice, each end of
    either list closes the one link of the two tokens open there."""
    both = np.concatenate((2 * ends_a, 2 * ends_b + 1))
    both.sort(kind="stable")
    of_b = both & 1
    both >>= 1
    last = np.flatnonzero(np.r_[both[1:] != both[:-1], True])
    before_b = np.cumsum(of_b)[last]
    ended = last + 1  # ends of both lists so far
    closes_b = of_b[last]
    closes_a = np.diff(ended, prepend=0) - closes_b
    return ended - before_b - closes_a, before_b - closes_b


def id_names(size_a: int, size_b: int) -> np.ndarray:
    """Ids as text with the sign that follows: A's with `,` and `|`, B's with `,` and `;`."""
    return np.array([f"{i}{sign}" for size, signs in ((size_a, ",|"), (size_b, ",;")) for sign in signs for i in range(size)], "S")


def spelled(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, names: np.ndarray, size_a: int, size_b: int) -> str:
    """Groups as `a1,a2|b1;a3|b2,b3`."""
    width_a, width_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    codes = np.empty(len(a) + len(b), np.int64)
    of_a, of_b = a.astype(np.int64), b.astype(np.int64) + 2 * size_a
    of_a[stop_a - 1] += size_a
    of_b[stop_b - 1] += size_b
    codes[np.arange(len(a)) + np.repeat(stop_b - width_b, width_a)] = of_a
    codes[np.arange(len(b)) + np.repeat(stop_a, width_b)] = of_b
    letters = names[codes].view(np.uint8)
    return letters[letters != 0].tobytes()[:-1].decode("ascii")


def _encoded(df: DataFrame, doc_id: str, text: str, make_a: Callable[[], Side], make_b: Callable[[], Side], block_links: int) -> DataFrame:
    """Packs of token ids (kind 1) and the linked pairs of each block (kind 0)."""
    schema = T.StructType.fromDDL("kind int, block long, pair long, n long")
    schema.add("ids", T.ArrayType(df.schema[doc_id].dataType))
    for f in T.StructType.fromDDL("n_a array<int>, n_b array<int>, tokens binary").fields:
        schema.add(f)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = make_a(), make_b()
        len_a, len_b = (np.array([len(p) for p in s.pieces], np.int64) for s in (a_side, b_side))
        size_b = len(b_side.pieces)
        zipped = zstandard.ZstdCompressor(level=3)
        block = TaskContext.get().partitionId() << 32
        pairs, held, packs, pack, pack_tokens = [], 0, [], [], 0

        def packed() -> None:
            nonlocal pack, pack_tokens
            ids, a, b = zip(*pack)
            raw = np.concatenate([*a, *b]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            packs.append({"kind": 1, "block": block, "ids": ids, "n_a": [len(x) for x in a], "n_b": [len(x) for x in b], "tokens": zipped.compress(raw)})
            pack, pack_tokens = [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal pairs, held, packs, block
            if pack:
                packed()
            if packs:
                yield pa.RecordBatch.from_pylist(packs, schema=arrow)
            if pairs:
                found, n = np.unique(np.concatenate(pairs), return_counts=True)
                rows = len(found)
                columns = [pa.array(np.zeros(rows, np.int32)), pa.array(np.full(rows, block)), pa.array(found), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns + [pa.nulls(rows, f.type) for f in list(arrow)[4:]], schema=arrow)
            pairs, held, packs, block = [], 0, [], block + 1

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = value.as_py() or ""
                a = b = np.empty(0, np.int64)
                if words:
                    list_a, list_b = a_side.encode(words), b_side.encode(words)
                    whole = (" " + words).encode("utf-8", "surrogatepass")
                    if a_side.spells(list_a, whole) and b_side.spells(list_b, whole):
                        a, b = np.array(list_a, np.int64), np.array(list_b, np.int64)
                        i, j = links(np.cumsum(len_a[a]), np.cumsum(len_b[b]))
                        pairs.append(a[i] * size_b + b[j])
                        held += len(i)
                pack.append((doc, a, b))
                pack_tokens += len(a) + len(b)
                if pack_tokens >= PACK or len(pack) >= PACK:
                    packed()
                if held >= block_links:
                    yield from ended()
        yield from ended()

    return df.select(doc_id, text).mapInArrow(run, schema)


def align(df: DataFrame, doc_id: str, text: str, make_a: Callable[[], Side], make_b: Callable[[], Side], block_links: int = BLOCK) -> DataFrame:
    """Every row as `doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups`.

    `groups` spells the ids of each group as `a1,a2|b1;a3|b2,b3`. The count of an id pair is the
    number of links of all rows that hold it; `count_sum` adds the counts of a row's links, and
    `n_best` counts those whose count is the highest of their B id, ties included. Texts that are
    null or empty, or whose tokens do not spell a space and the text, have no tokens: zeros and
    an empty string. Repeated rows and ids count as rows of their own. Other columns play no part.
    """
    encoded = settle(_encoded(df, doc_id, text, make_a, make_b, block_links))
    size_b = len(make_b().pieces)
    pairs = encoded.filter("kind = 0").select("block", "pair", "n")
    b_of = F.col("pair") % size_b
    counts = settle(pairs.groupBy("pair").agg(F.sum("n").alias("links")))
    highest = counts.groupBy(b_of.alias("b")).agg(F.max("links").alias("highest"))  # at most one row for each id of B
    known = counts.join(F.broadcast(highest), b_of == F.col("b")).select("pair", "links", (F.col("links") == F.col("highest")).alias("best"))
    of_block = pairs.select(F.lit(0).alias("kind"), "block", "pair").join(known, "pair")
    packs = encoded.filter("kind = 1").select("kind", "block", "ids", "n_a", "n_b", "tokens")
    stream = of_block.unionByName(packs, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = make_a(), make_b()
        len_a, len_b = (np.array([len(p) for p in s.pieces], np.int64) for s in (a_side, b_side))
        size_a = len(len_a)
        names = id_names(size_a, size_b)
        unzipped = zstandard.ZstdDecompressor()
        current, parts, table = None, [], None
        for batch in batches:
            kinds, blocks = batch.column("kind").to_numpy(), batch.column("block").to_numpy()
            starts = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | (blocks[1:] != blocks[:-1])])
            rows, weight = [], 0
            for lo, hi in zip(starts, [*starts[1:], len(kinds)]):
                if blocks[lo] != current:
                    current, parts, table = blocks[lo], [], None
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    parts.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "links", "best")])
                    continue
                if table is None:
                    table = [np.concatenate(p) for p in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3
                    order = np.argsort(table[0])
                    table = [p[order] for p in table]
                for k in range(hi - lo):
                    ids, n_a, n_b = (part.column(c)[k].as_py() for c in ("ids", "n_a", "n_b"))
                    raw = np.frombuffer(unzipped.decompress(part.column("tokens")[k].as_py()), np.uint8)
                    tokens = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
                    at_a, at_b = 0, sum(n_a)
                    for doc, x, y in zip(ids, n_a, n_b):
                        a, b = tokens[at_a : at_a + x], tokens[at_b : at_b + y]
                        at_a, at_b = at_a + x, at_b + y
                        if not x:
                            rows.append((doc, 0, 0, 0, 0, 0, 0, ""))
                            continue
                        ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
                        stop_a, stop_b = groups(ends_a, ends_b)
                        i, j = links(ends_a, ends_b)
                        place = np.searchsorted(table[0], a[i] * size_b + b[j])
                        line = spelled(a, b, stop_a, stop_b, names, size_a, size_b)
                        rows.append((doc, x, y, len(stop_a), len(i), int(table[2][place].sum()), int(table[1][place].sum()), line))
                        weight += len(line)
                    if weight >= FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows, weight = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return stream.select("kind", "block", "pair", "links", "best", "ids", "n_a", "n_b", "tokens").mapInArrow(run, schema)
