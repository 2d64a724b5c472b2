import hashlib
import random
import re
import zlib

import pytest

from tidebin.llm import conversations
from tidebin.llm.catalogue import op11_conversation_repair


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """All edits, by dynamic programming over whole audits: (cost, audit, roles, texts)."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {("", 0): (0, "", ())}

    def offer(new, state, lead, entry):
        if (state, lead) not in new or entry < new[state, lead]:
            new[state, lead] = entry

    def inserted(table):
        for lead in range(2):
            for state in ("", "s", "a", "u", "a"):
                if (state, lead) not in table:
                    continue
                cost, audit, made = table[state, lead]
                role = "a" if state == "u" else "u"
                offer(table, role, lead, (cost + 3, audit + "I", made + ((role == "u" and "user" or "assistant") + ":",)))
        return table

    table = inserted(best)
    for initial, role, text, fault in rows:
        new = {}
        for (state, lead), (cost, audit, made) in table.items():
            offer(new, state, lead, (cost + 4, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            if (state, initial) in legal:
                offer(new, initial, lead, (cost + extra, audit + "K", made + (f"{role}:{text}",)))
            to = "a" if state == "u" else "u"
            name = "assistant" if to == "a" else "user"
            offer(new, to, lead, (cost + 3 + extra, audit + "R", made + (f"{name}:{text}",)))
        table = inserted(new)
    return min(v for (state, _), v in table.items() if state in ("", "a"))


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        out[conv] = (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    talks = {}
    for row in damaged(rows):
        talks.setdefault(row[0], []).append(row)
    for conv, talk in talks.items():
        key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
        talk.sort(key=key)
        turns = {r[1] for r in talk if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, marked = set(), []
        for _, _, role, text in talk:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role[:1], role, text, fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, made = cheapest(marked)
        count = [sum(m[3] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return sorted(out.values(), key=repr)


def repaired(spark, rows, size):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, part string, n int").repartition(3)
    names = ["conv_id", "turn", "role", "text"]
    bad = conversations.damage(df, *names)
    out = conversations.repair(bad, *names, size=size)
    summary = {r.conv: r for r in out.summary.collect()}
    gaps = dict(conversations.turn_gaps(bad, "conv_id", "turn").collect())
    hashes = dict(conversations.text_hashes(out.rows).collect())
    empty = hashlib.sha256(b"").hexdigest()
    got = []
    for conv in {r[0] for r in rows}:
        s = summary.get(conv)
        numbers = [s.blank, s.duplicate, s.truncated, s.illegal, s.cost] if s else [0] * 5
        got.append((conv, gaps.get(conv, 0), *numbers, s.audit if s else "", hashes.get(conv, empty)))
    return sorted(got, key=repr)


def talks(seed, n=120):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "Go on!  ", "", " \n", "A longer answer that ends?", "cut off here", "é."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in range(n):
        turn = 0
        for k in range(rnd.choice([1, 2, 3, 5, 8, 13])):
            turn += rnd.choice([0, 1, 1, 1, 2])
            role = rnd.choice(roles) if rnd.random() < 0.4 else ("user", "assistant")[k % 2]
            rows.append((conv, None if rnd.random() < 0.04 else turn, role, None if rnd.random() < 0.04 else rnd.choice(texts) if rnd.random() < 0.4 else f"text {conv} {k}."))
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (None, None, None, None)]


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_same_as_all_edits(spark, size):
    rows = talks(size)
    assert repaired(spark, rows, size) == plain(rows)


def test_long_conversation_and_many_copies(spark):
    rnd = random.Random(4)
    rows = [(7, t, rnd.choice(["user", "assistant", "user", "system"]), rnd.choice(["Same.", f"Text {t}.", f"Open {t}"])) for t in range(700)]
    rows += [(8, 5, "user", "Again.")] * 90 + [(8, 6, "assistant", "Yes.")] * 3 + [(9, 1, "user", "x" * 300_000 + "."), (9, 2, "assistant", "Good.")]
    assert repaired(spark, rows, 64) == plain(rows)


def test_repaired_rows(spark):
    rows = [("c", 1, "user", "Hi."), ("c", 2, "user", "What?"), ("c", 3, "assistant", "Well."), ("c", 4, "assistant", "Well."), ("c", 5, "user", " ")]
    df = spark.createDataFrame(rows, "id string, k int, who string, words string")
    out = conversations.repair(df, "id", "k", "who", "words")
    got = [tuple(r) for r in out.rows.orderBy("place").collect()]
    assert got == [("c", 1, "K", 1, "user", "Hi."), ("c", 2, "I", None, "assistant", ""), ("c", 3, "K", 2, "user", "What?"), ("c", 4, "K", 3, "assistant", "Well.")]
    summary = out.summary.first()
    assert (summary.blank, summary.duplicate, summary.truncated, summary.illegal, summary.cost, summary.audit) == (1, 1, 0, 2, 11, "KIKKDD")


def test_suffixes_are_shared():
    """A node is made once for each distinct suffix."""
    rnd = random.Random(2)
    signatures = sorted({"".join(rnd.choices("suaxUA", k=rnd.randrange(1, 7))) for _ in range(500)}, key=lambda s: s[::-1])
    path = conversations.Automaton(conversations.END)
    for s in signatures:
        path.read(s[::-1])
    assert path.made == len({s[i:] for s in signatures for i in range(len(s))})


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = conversations.repair(df, "conv_id", "turn", "role", "text")
    assert out.summary.count() == 0 and out.rows.count() == 0
    assert conversations.text_hashes(out.rows).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op11_conversation_repair(spark, sf_dir)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == plain(rows)
