"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Text that a byte-pair vocabulary was built for takes few tokens; random strings fall
apart into short ones. Runs of key-like characters are measured in characters per token;
a low ratio exposes a random string, unless the run is a known digest or identifier, or
a name whose parts are words to the vocabulary.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebin.llm.shared import map_texts

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
MAX_RATIO = 2.0
MIN_RUN = 16

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
#: One of these is in every text with an assignment.
ASSIGN_MARKS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Every access key, long hex string and random string lies within one such run.
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_RUN)

#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGESTS = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Names are made of words: their parts by case and digits are longer than this on average.
NAME_PART = 3.5


def known(run: str) -> bool:
    """Digests, UUIDs and plain numbers."""
    if DIGESTS.fullmatch(run) and len(run) in DIGEST_SIZES or UUID.fullmatch(run):
        return True
    return all(p.isdigit() for p in PARTS.findall(run))


def named(run: str, count_tokens: Callable[[str], int], max_ratio: float) -> bool:
    """Names made of words: long parts, each of few tokens (digits aside)."""
    parts = PARTS.findall(run)
    if sum(map(len, parts)) < NAME_PART * len(parts):
        return False
    return all(len(p) >= max_ratio * count_tokens(p) for p in parts if not p.isdigit())


def spans_of(text: str, count_tokens: Callable[[str], int], max_ratio: float) -> list[tuple[int, int, int]]:
    """Sorted (start, index of kind, end) in code points."""
    out = []
    lowered = text.encode("utf-8", "surrogatepass").lower()
    if any(mark in lowered for mark in ASSIGN_MARKS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for found in RUN.finditer(text):
        run, at = found[0], found.start()
        base = []
        if "AKIA" in run:
            base += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= 16]
        if len(run) >= 32:
            base += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= 32]
        out += base
        if not known(run) and len(run) < max_ratio * count_tokens(run) and not named(run, count_tokens, max_ratio):
            out.append((at, 3, at + len(run)))
    out.sort()
    return out


def scan(
    df: DataFrame, text: str, vocab_path: str, pattern: str, keep: Sequence[str], max_ratio: float = MAX_RATIO
) -> DataFrame:
    """`keep` columns and `spans`: array of (kind, start, end), by start and then by kind.

    `vocab_path` is a tiktoken rank file (about 1 MB, broadcast) and `pattern` the regular
    expression that cuts texts for it. Offsets are code points, ends exclusive. A random
    string takes more than one token for each `max_ratio` characters. Null and empty
    texts have no span; repeated rows give repeated rows; other columns play no part.
    """
    with open(vocab_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=table, special_tokens={})

        def tokens(run: str) -> int:
            return len(encoding.encode_ordinary(run))

        def one(value: str) -> tuple:
            return ([(KINDS[k], start, end) for start, k, end in spans_of(value, tokens, max_ratio)],)

        return one

    span = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
    added = T.StructType([T.StructField("spans", T.ArrayType(span))])
    return map_texts(df, keep, text, added, make, lambda row: 64 + 64 * len(row[0]))


def masked(text: str, spans: str, mask: str = "[secret]") -> F.Column:
    """The text with every span replaced; spans that overlap are replaced as one.

    Built from the end of the previous span to the start of the next one; null texts
    stay null.
    """
    empty = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    chars = F.col(text)
    merged = F.aggregate(
        F.coalesce(F.col(spans), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")),
        empty,
        lambda acc, s: F.struct(
            F.when(
                (s["start"] >= acc["at"]) | (acc["at"] == 0),
                F.concat(acc["done"], F.substr(chars, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mask)),
            ).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substr(chars, acc["at"].cast("int") + 1, F.length(chars))),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(chars)
