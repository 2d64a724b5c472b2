import base64
import hashlib
import random
import re
import string

import public_tokenizers as P
import tiktoken

from tidebin.llm import secrets
from tidebin.llm.catalogue import op9_secrets

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_base(text):
    """The three fixed kinds, each over the whole text."""
    out = []
    for m in re.finditer(secrets.ASSIGN.pattern, text, re.ASCII | re.IGNORECASE):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return out


def plain_random(text, encoding):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        if len(m[0]) >= 16 and not secrets.known(m[0]) and len(m[0]) < 2.0 * len(encoding.encode_ordinary(m[0])):
            out.append((m.start(), 3, m.end()))
    return out


def texts():
    rnd = random.Random(3)
    key = lambda n, a: "".join(rnd.choices(a, k=n))
    b64, hx, up = string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_uppercase + string.digits
    out = [None, "", "nothing here", "TOKEN = 'abc'", "password=token=abcdefgh1", "Api_Key:\"" + key(20, b64), "paſſword=abcdefgh12"]
    for _ in range(120):
        words = [rnd.choice(["der", "größe", "schachheitachkeitung", "some_long_identifier_name", "HttpServerRequestFactory"]) for _ in range(6)]
        words.insert(rnd.randrange(6), rnd.choice([key(24, b64), "AKIA" + key(rnd.choice([8, 12, 16]), up), key(rnd.choice([31, 32, 40, 50]), hx), "secret: " + key(rnd.choice([7, 8, 30]), b64)]))
        out.append(rnd.choice([" ", "=", "-"]).join(words))
    return out + out[-3:]


def test_same_as_plain_search(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(df, "text", PATH, P.PATTERN, ["doc_id"]).collect()}
    encoding, seen = library(), set()
    for i, text in rows:
        want = sorted(plain_base(text or "") + plain_random(text or "", encoding))
        assert got[i] == [(secrets.KINDS[k], a, b) for a, k, b in want], text
        seen |= {k for _, k, _ in want}
    assert seen == {0, 1, 2, 3}


def test_random_keys_found_and_names_left_alone():
    rnd, encoding = random.Random(9), library()
    count = lambda s: len(encoding.encode_ordinary(s))
    hits = sum(bool(secrets.spans_of("".join(rnd.choices(string.ascii_letters + string.digits, k=24)), count, 2.0)) for _ in range(300))
    assert hits >= 295
    for name in ("get_user_account_settings", "XMLHttpRequestFactory2", "2024-01-31-12-30-55", "d41d8cd98f00b204e9800998ecf8427", "a" * 20):
        assert not [s for s in secrets.spans_of(name, count, 2.0) if s[1] == 3 and secrets.known(name)]
    assert secrets.known("123e4567-e89b-12d3-a456-426614174000") and secrets.known("d41d8cd98f00b204e9800998ecf8427e")


def test_random_strings_of_one_case_found_and_words_left_alone():
    rnd, encoding = random.Random(4), library()
    random_spans = lambda s: [x for x in secrets.spans_of(s, lambda t: len(encoding.encode_ordinary(t)), 2.0) if x[1] == 3]
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    for letters in (lower, upper, upper + "234567", lower + digits, upper + digits):
        hits = sum(bool(random_spans("".join(rnd.choices(letters, k=rnd.randrange(24, 41))))) for _ in range(300))
        assert hits >= 280, (letters, hits)
    for name in ("INTERNATIONALIZATION", "SOME_ENVIRONMENT_VARIABLE", "antidisestablishmentarianism", "Geschwindigkeitsbegrenzung", "get_user_account_settings"):
        assert not random_spans(name), name


def test_masked_text(spark):
    df = spark.createDataFrame([(1, "ä password=abcdefgh1 b"), (2, "clean"), (3, None), (4, "")], "doc_id long, text string")
    out = secrets.scan(df, "text", PATH, P.PATTERN, ["doc_id", "text"]).select("doc_id", secrets.masked("text", "spans").alias("t"))
    assert {r.doc_id: r.t for r in out.collect()} == {1: "ä [secret] b", 2: "clean", 3: None, 4: ""}


def test_overlapping_spans_are_masked_once(spark):
    df = spark.createDataFrame(
        [("abcdefgh", [("a", 0, 4), ("b", 2, 6), ("c", 6, 7)])], "text string, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )
    assert df.select(secrets.masked("text", "spans", "*").alias("t")).first().t == "**h"


def test_query(spark, sf_dir):
    encoding = library()
    rows = {r.doc_id: r for r in op9_secrets(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        base = sorted(plain_base(d.text))
        line = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = rows[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert r.spans == line(base + plain_random(d.text, encoding))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scan(df, "text", PATH, P.PATTERN, ["doc_id"]).count() == 0
