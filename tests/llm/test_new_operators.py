"""Conversation repair, merge-type pieces and phrases against brute force, on odd rows, and in small parts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import pyarrow.parquet as pq
import pytest
import xxhash
from conftest import MIDDLE, SMALL
from odd_rows import ODD, folder, none, odd  # noqa: F401
from pyspark.sql import functions as F

from txguard.llm import phrases, pieces, repair
from txguard.llm.queries import QUERIES, damaged, piece_bpe

STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NAME = {"u": "user", "a": "assistant"}
TURN = "conv_id long, turn long, role string, text string"


def cheapest(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and least audit by relaxing all states from the end; turns are (initial, fault)."""
    worst = (10**9, "~")
    best = {(i, q): worst for i in range(len(turns) + 1) for q in range(4)}
    best[len(turns), 0] = best[len(turns), 3] = (0, "")
    for i in range(len(turns), -1, -1):
        for _ in range(4):
            for q in range(4):
                ways = [best[i, q]]
                for initial, after in STEP[q].items():
                    if initial in NAME:
                        ways.append((best[i, after][0] + 3, "I" + best[i, after][1]))
                    if i == len(turns):
                        continue
                    role, fault = turns[i]
                    cost, rest = best[i + 1, after]
                    more = 3 if fault == "truncated" else 0
                    if fault not in ("blank", "duplicate"):
                        if initial in NAME:
                            ways.append((cost + 3 + more, "R" + rest))
                        if initial == role:
                            ways.append((cost + more, "K" + rest))
                if i < len(turns):
                    ways.append((best[i + 1, q][0] + 4, "D" + best[i + 1, q][1]))
                best[i, q] = min(ways)
    return best[0, 0]


def mended(rows: list[tuple]) -> dict:
    """What the operator returns for one conversation's (turn, role, text), already in order and without nulls but turns'."""
    seen, turns, faults = set(), [], Counter()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "fine" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults[fault] += 1
        turns.append((role[:1], fault))
    cost, audit = cheapest(turns)
    at = state = 0
    lines = []
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        new = next(r for r in STEP[state] if r in NAME)
        initial = rows[at][1][:1] if letter == "K" else new
        role = rows[at][1] if letter == "K" else NAME[new]
        lines.append(f"{role}:{'' if letter == 'I' else rows[at][2]}")
        at += letter != "I"
        state = STEP[state][initial]
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
    known = {t for t, _, _ in rows if t is not None}
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": faults["blank"], "duplicate": faults["duplicate"], "truncated": faults["truncated"],
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def _place(row: tuple) -> tuple:
    turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest()


def test_auction_finds_the_least_cheapest_audit():
    rng = random.Random(1)
    kinds = ["fine", "truncated", "duplicate", "blank"]
    for n in [*[rng.randrange(9) for _ in range(1500)], 20, 63, 64, 65, 66, 127, 128, 129, 300]:
        turns = [(rng.choice(" suuaa"), rng.choice(kinds[:1] * 4 + kinds)) for _ in range(n)]
        codes = bytes(4 * repair.INITIALS.index(r) + kinds.index(f) for r, f in turns)
        assert repair.audit(codes) == cheapest(turns), turns


def test_prices_of_long_conversations_take_time_by_their_length():
    rng = random.Random(2)
    codes = bytes(4 * rng.randrange(4) + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(20_000))
    cost, audit = repair.audit(codes)
    assert len(audit) - audit.count("I") == 20_000
    assert cost == 3 * audit.count("I") + 4 * audit.count("D") + 3 * audit.count("R") + sum(
        3 for code, letter in zip(codes, audit.replace("I", ""), strict=True) if code % 4 == 1 and letter != "D"
    )


def test_damaged_conversations_are_repaired(spark):
    given = pq.read_table(f"{MIDDLE}/conversations.parquet").to_pylist()
    expected: dict = {r["conv_id"]: [] for r in given}
    for r in given:
        way = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = r["role"], r["text"]
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        expected[r["conv_id"]] += [(r["turn"], role, text)] * {0: 0, 3: 2}.get(way, 1)
    rows = QUERIES["op11_structure_repair"](spark, MIDDLE).collect()
    found = {r["conv_id"]: r.asDict() for r in rows}
    assert len(rows) == len(expected)
    letters = Counter()
    for conv, turns in expected.items():
        want = mended(sorted(turns, key=_place))
        assert {c: found[conv][c] for c in want} == want, conv
        letters.update(want["audit"])
    assert set(letters) == set("KRDI")


def test_repair_of_odd_conversations(spark):
    """Null ids, turns, roles and texts, roles without letters, repeated rows, a very long text, one very long conversation."""
    rng = random.Random(3)
    rows = [
        (1, None, "user", "No turn."), (1, None, None, "No role."), (1, 5, "assistant", None), (1, 5, "", "Empty role!"),
        (1, 5, "", "Empty role!"), (None, 1, "user", "Who?"), (None, None, "assistant", "Me."), (2, 0, "system", " \t\x0b"),
        (3, 7, "usher", "u too. \n"), (3, 9, "agent", "a" * 300_000 + "?"), (4, 1, "tool", "x"), (5, -3, "user", "é"),
    ]
    rows += [(6, t, rng.choice(["user", "assistant", "system"]), rng.choice(["", "Yes.", f"So {t}.", "cut"])) for t in range(3000)]
    table = spark.createDataFrame(rows, TURN).withColumns({"code": F.lit("x"), "place": F.lit(1), "letter": F.lit("K")})
    every = table.union(spark.createDataFrame([(99, None, None, None, "x", 1, "K")], table.schema))
    found = {r["conv_id"]: r.asDict() for r in repair.repaired_conversations(table, every).collect()}
    assert found.keys() == {r[0] for r in rows} | {99}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv), key=_place)
        want = mended(turns)
        assert {c: found[conv][c] for c in want} == want, conv
    assert found[99] == {"conv_id": 99, **mended([])}


def test_a_conversation_that_loses_all_turns(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(conv, 0, "user", "Gone.")], TURN)
    (row,) = repair.repaired_conversations(damaged(table), table).collect()
    assert row.asDict() == {"conv_id": conv, **mended([])}


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(piece_bpe())


def test_pieces_are_those_of_the_library(encoder):
    rng = random.Random(4)
    signs = list("abcdeinrst  .,'\n\t09") + ["▁", "é", "漢", "字", "\U0001f600", "ß", "́", "а", "и", " the", "ing", " of", "  ", "<s>", "<0x41>", "\x00"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(70))) for _ in range(4000)]
    texts += ["", " ", "a" * 5000, "ab" * 3000, " " * 3001, "ing" * 1000, "́" * 2000, "\n" * 100]
    whole = pieces.PieceEncoder(piece_bpe())
    # Without cutting at words, only the backtracking decides.
    whole.apart = False
    for text in texts:
        ids = encoder.library.encode(text)
        assert encoder.encode(text).tolist() == ids == whole.encode(text).tolist(), text
        assert encoder.decode(encoder.encode(text)) == encoder.library.decode(ids)


def test_backtracking_gives_up_pieces(encoder):
    """There are words whose longest first piece is wrong, so that places are marked as failed."""
    words = {w for t in pq.read_table(f"{SMALL}/documents.parquet").column("text").to_pylist() for w in (t or "").split()}
    greedy = 0
    for word in words:
        cut, left = encoder.cut(word), word
        assert cut == encoder.merged(word)
        longest = next(left[:n] for n in range(len(left), 0, -1) if left[:n] in encoder.ids or n == 1)
        greedy += longest != cut[0]
    assert greedy > 10


def test_remembered_parts_are_forgotten(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    monkeypatch.setattr(pieces, "PAIRS", 7)
    encoder = pieces.PieceEncoder(piece_bpe())
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(rng.choice(["one", "two,", "three", "four.", "five", "sixes", "Seven"]) for _ in range(9))
        assert encoder.encode(text).tolist() == encoder.library.encode(text)
    assert len(encoder.words) <= 5 and len(encoder.fits) <= 7


def test_encoding_query(spark, encoder):
    given = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_sentencepiece"](spark, SMALL).collect()}
    for r in given:
        ids = encoder.library.encode(r["text"] or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), encoder.library.decode(ids) if ids else "")]
        assert found[r["doc_id"]] == (len(ids), *digests)


def test_encoding_odd_rows(spark, odd, encoder):
    found = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in pieces.encoded(odd, piece_bpe()).collect())
    want = Counter((i, tuple(encoder.library.encode(t or "")), t or "") for i, t, *_ in ODD)
    assert found == want


def mined(docs: list[tuple[str | None, str | None]], support: int, best: int) -> list[tuple]:
    """Phrases by counting all runs of words."""
    counts: dict[tuple, int] = Counter()
    total: dict[str, int] = Counter()
    for lang, text in docs:
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", small):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total["und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    often = {p: n for p, n in counts.items() if n >= support}
    out = []
    for lang in {p[0] for p in often}:
        rows = []
        for (where, words), a in often.items():
            if where != lang or len(words) < 2:
                continue
            inside = any(
                100 * b >= 80 * a and len(other) > len(words) and any(other[i : i + len(words)] == words for i in range(len(other)))
                for (there, other), b in often.items() if there == lang
            )
            if inside:
                continue
            cuts = [(2_000_000 * a // (often[lang, words[:i]] + often[lang, words[i:]]), i) for i in range(1, len(words))]
            score, i = min(cuts)
            rows.append((-score, -a, " ".join(words).encode(), often[lang, words[:i]], often[lang, words[i:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def _random_docs() -> list[tuple[str | None, str | None]]:
    rng = random.Random(6)
    words = ["The", "the", "of", "new", "york", "a\x01b", "\x01", "é", "É", "漢", "x-y", "it's", "\x1c", " "]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", "\r", "?\x0b"]
    docs: list = [(None, None), ("en", ""), ("en", "..."), ("de", "word"), ("und", "new york new york"), (None, "new york. new york")]
    for lang in ("en", "de", None, ""):
        for _ in range(25):
            docs.append((lang, "".join(rng.choice(words[: rng.randrange(2, 15)]) + rng.choice(marks) for _ in range(rng.randrange(60)))))
    return docs + [("en", "hot pair " * 2000), ("en", "hot pair " * 2000)]


@pytest.mark.parametrize("small", [False, True])
def test_phrases_of_odd_texts(spark, monkeypatch, small):
    """In one part, and with groups of few suffixes, split prefixes, buckets that meet and lots of few words."""
    if small:
        for name, value in (("BUDGET", 40), ("HELD", 300), ("DIFFERENT", 9), ("BITS", 16), ("COARSE", 5), ("HEAVY_PARTS", 3)):
            monkeypatch.setattr(phrases, name, value)
    docs = _random_docs()
    table = spark.createDataFrame([(lang, text, "x", "y") for lang, text in docs], "lang string, text string, f string, bucket string")
    found = sorted(tuple(r) for r in phrases.phrases(table, 4, 60).collect())
    want = mined(docs, 4, 60)
    assert len(want) > 100
    assert found == want


def test_words_have_the_same_hash_in_tasks_and_in_columns(spark):
    (row,) = spark.sql("select xxhash64('en', 'wörd') h").collect()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest("wörd".encode(), xxhash.xxh64_intdigest(b"en", 42))


def test_no_phrases_without_rows(spark, none):
    assert phrases.phrases(none).collect() == []
