"""Byte-pair encoding and decoding with a fixed public vocabulary.

Each distinct word or word part of a task is encoded once: its symbols form a doubly linked list, a heap holds the merge
ranks of neighbouring symbols, and entries whose symbols have changed since they were
pushed are skipped. Decoding concatenates vocabulary strings.

Only the vocabulary file (a fixed size, about 2 MB) is broadcast. Where a text needs the
file's Unicode rules, the tokenizers library applies them to single words; the merges are
made here. A task's word cache is emptied when it holds `cache_words` words,
which bounds its memory and changes no result.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Callable, Sequence
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebin.llm.shared import map_texts

#: Units a task remembers at a time, about 300 bytes each.
CACHE_WORDS = 400_000


class Merger:
    """The merges of one vocabulary; `ids(piece)` encodes one pre-split piece.

    A heap entry is one integer, merge rank before position, so equal ranks go from left
    to right. `rows[a]` maps a right-hand symbol b to the rank of the merge of a and b.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.first = {token: i for token, i in vocab.items() if len(token) == 1}
        self.final = {token[0]: i for token, i in vocab.items() if token[1:] == suffix}
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in merges]
        self.made = [vocab[left + right] for left, right in pairs]
        none: dict[int, int] = {}
        self.rows = [none] * (max(vocab.values(), default=-1) + 1)
        for rank, (left, right) in enumerate(pairs):
            if self.rows[vocab[left]] is none:
                self.rows[vocab[left]] = {}
            self.rows[vocab[left]].setdefault(vocab[right], rank)

    def ids(self, piece: str) -> list[int]:
        n = len(piece)
        if not n:
            return []
        sym = [*map(self.first.__getitem__, piece)]
        sym[-1] = self.final[piece[-1]]
        rows, made = self.rows, self.made
        size = 256 if n <= 256 else 1 << n.bit_length()
        heap = [rows[sym[i]][sym[i + 1]] * size + i for i in range(n - 1) if sym[i + 1] in rows[sym[i]]]
        if not heap:
            return sym
        heapify(heap)
        after = [*range(1, n + 1)]
        before = [*range(-1, n - 1)]
        while heap:
            rank, i = divmod(heappop(heap), size)
            left = sym[i]
            if left < 0:
                continue
            j = after[i]
            if j == n or rows[left].get(sym[j]) != rank:
                continue  # stale: one of the two symbols has been merged since
            sym[i] = new = made[rank]
            sym[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = rows[new].get(sym[k])
                if found is not None:
                    heappush(heap, found * size + i)
            h = before[i]
            if h >= 0:
                found = rows[sym[h]].get(new)
                if found is not None:
                    heappush(heap, found * size + h)
        return [s for s in sym if s >= 0]


class Vocabulary:
    """A tokenizer file: its merges, its rules for cutting texts, its strings by id.

    `units(text)` cuts a text into units that encode independently, and `ids(unit)`
    encodes one. Texts of characters below U+0250 without marks of special tokens are cut
    by one regular expression, if the file has the rules it stands for; below that
    code point the normaliser only lower-cases. Any other text is cut at ASCII white
    space, which no token spans, and the library's own rules cut each word.
    """

    #: The rules that the regular expression below stands for (fixed values of the file).
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN_END = 0x250

    def __init__(self, source: str):
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError("the vocabulary file must hold a BPE model")
        vocab = dict(model["vocab"])
        self.merger = Merger(vocab, model["merges"], model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        marks = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.cut = re.compile(f"({marks})") if marks else None
        rules = Tokenizer.from_str(source)
        self.normal, self.split = rules.normalizer, rules.pre_tokenizer
        self.strings = [""] * (max([*vocab.values(), *self.added.values()], default=-1) + 1)
        for token, i in [*vocab.items(), *self.added.items()]:
            self.strings[i] = token
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.plain = None
        if (
            [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == self.NORMALIZERS
            and steps[0].get("pattern") == {"Regex": self.SPLIT}
            and [x["type"] for x in steps[1:]] == ["ByteLevel"]
        ):
            self.plain = re.compile(f"[{chr(0)}-{chr(self.PLAIN_END - 1)}]*")
            self.units_of = self._pattern().findall
            shape = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            letters = [chr(i) for i in range(self.PLAIN_END)]
            self.shape = {ord(c): shape.pre_tokenize_str(c)[0][0] for c in letters}

    def _pattern(self) -> re.Pattern:
        def those(test: Callable[[str], bool]) -> str:
            return "".join(re.escape(c) for c in map(chr, range(self.PLAIN_END)) if test(c))

        letter = those(lambda c: unicodedata.category(c)[0] == "L")
        number = those(lambda c: unicodedata.category(c)[0] == "N")
        space = those(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")

    def units(self, text: str) -> list[str] | list[bytes]:
        if self.plain and self.plain.fullmatch(text) and "\u0130" not in text and "<|" not in text:
            low = text.lower()  # some capitals have small letters beyond the plain range
            if low.isascii() or self.plain.fullmatch(low):
                return self.units_of(low)
        return text.encode("utf-8", "surrogatepass").split()

    def ids(self, unit: str | bytes) -> list[int]:
        if isinstance(unit, str):
            return self.merger.ids(unit.translate(self.shape))
        out = []
        word = unit.decode("utf-8", "replace")
        for part in self.cut.split(word) if self.cut else [word]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                part = self.normal.normalize_str(part) if self.normal else part
                for piece, _ in self.split.pre_tokenize_str(part) if self.split else [(part, None)]:
                    out.extend(self.merger.ids(piece))
        return out


def encode(
    df: DataFrame, text: str, vocab_path: str, keep: Sequence[str], decoded: bool = False, cache_words: int = CACHE_WORDS
) -> DataFrame:
    """`keep` columns, `n_tokens` long, `ids` binary (little-endian unsigned 32-bit) and,
    if asked for, `decoded`: the vocabulary strings of the ids, joined by one space as the
    file names no decoder.

    Null and empty texts have no token and decode to the empty text. Every row gives one
    row, repeated rows too; strings of special tokens inside a text become their ids, as in
    the library. Extra columns play no part.
    """
    with open(vocab_path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        vocabulary = Vocabulary(source.value)
        units, ids_of, strings = vocabulary.units, vocabulary.ids, vocabulary.strings
        cache: dict[str | bytes, tuple[bytes, str]] = {}

        def encoded(unit: str | bytes) -> tuple[bytes, str]:
            ids = ids_of(unit)
            hit = cache[unit] = struct.pack(f"<{len(ids)}I", *ids), "".join([" " + strings[i] for i in ids])
            return hit

        def one(value: str) -> tuple:
            if len(cache) >= cache_words:
                cache.clear()
            found = [cache.get(u) or encoded(u) for u in units(value)]
            packed = b"".join([x[0] for x in found])
            if decoded:
                return len(packed) // 4, packed, "".join([x[1] for x in found])[1:]
            return len(packed) // 4, packed

        return one

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] if decoded else []
    return map_texts(df, keep, text, T.StructType(fields), make, lambda row: 64 + 3 * len(row[1]))


def decode(df: DataFrame, ids: str, vocab_path: str, keep: Sequence[str]) -> DataFrame:
    """`keep` columns and `decoded`, from a binary column of packed ids; null ids: empty text.

    Ids outside the vocabulary are skipped, as the library skips them.
    """
    with open(vocab_path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    fields = [df.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())]
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        strings = Vocabulary(source.value).strings
        for batch in batches:
            texts = []
            for packed in batch.column(len(keep)).to_pylist():
                values = struct.unpack(f"<{len(packed) // 4}I", packed) if packed else ()
                texts.append(" ".join([strings[i] for i in values if i < len(strings)]))
            kept = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, arrow.field(len(keep)).type)], schema=arrow)

    return df.select(*keep, ids).mapInArrow(run, schema)
