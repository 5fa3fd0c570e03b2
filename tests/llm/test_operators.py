"""The operators' own interfaces: hand-made cases, exact round trips, hot groups."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from odd_rows import empty_folder, folder, none, odd  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from txguard.llm import ann, chat, html_extract, mixing, packing, quality, simhash, simple8b, substrings, token_files, tokens, winnow
from txguard.llm.html_blocks import blocks
from txguard.llm.queries import byte_bpe

KIND = "doc_id long, text string"


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 239, 240, 241, 3000):
        for high in (1, 2, 3, 200, 50257, 1 << 20, 1 << 40, 1 << 62, (1 << 64) - 1):
            ids = rng.integers(0, high, n, dtype=np.uint64)
            ids[n // 3 : n // 3 + 600] = 0
            assert (simple8b.decode(simple8b.encode(ids)) == ids).all(), (n, high)
    ids = rng.integers(0, 50257, 50_000).astype(np.uint16)
    whole = simple8b.encode(ids)
    later = simple8b.decode(whole, 3)
    assert 0 < len(later) < len(ids) and (later == ids[-len(later) :]).all()


def test_both_libraries_encode_alike(monkeypatch):
    """Random texts, and runs beyond the limits, have the ids of the file as it is, added tokens included."""
    plain = Tokenizer.from_file(byte_bpe())
    encode = tokens.Encoder(byte_bpe())
    assert encode.quick is not None
    letters = list("ab Z\n\t\r\x0b\x0c \x1c\x1f\x85\xa0　é漢字'sll've12٣!?.,-…​\U0001f600") + ["<|endoftext|>", "<|endof", " the", "ing"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += ["x <|endoftext|>y", " " * 30_000, "a" * 30_000, "\n" * 9_999 + "b", "ab " * 9_000, ""]
    for text in texts:
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:99])
    assert encode("x <|endoftext|>y").tolist() == [87, 220, 50256, 88] and encode(None).tolist() == []


def test_other_kinds_of_files_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    assert encode.quick is None
    assert encode("Some Words, and <|endoftext|>").tolist() == plain.encode("Some Words, and <|endoftext|>", add_special_tokens=False).ids


def _doubling(n: int, one: str, two: str) -> str:
    """A word whose letters follow the Thue-Morse sequence, for which hashes modulo 2^64 collide under every base."""
    return "".join(one if i.bit_count() % 2 else two for i in range(n))


def test_words_that_some_hashes_confuse_are_told_apart(spark):
    common = " ".join(f"w{i}" for i in range(19))
    for n in (2, 4, 16, 32, 64, 256, 1024, 4096):
        texts = [f"{common} {_doubling(n, 'a', 'b')}", f"{common} {_doubling(n, 'b', 'a')}", f"{common} {_doubling(n, 'a', 'b')}"]
        maker = substrings.WordHashes()
        assert len({maker.words(t.encode())[-1] for t in texts}) == 2, n
    rows = spark.createDataFrame(list(enumerate(texts)), KIND)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(rows).collect()} == {0: 0, 1: 0, 2: 20}


def test_second_hash_of_runs():
    """Equal runs have equal hashes wherever they stand; runs of two words in doubling order differ."""
    maker = substrings.WordHashes()
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    for at in (1, 7, 900):
        moved = np.concatenate([rng.integers(0, 1 << 63, at, dtype=np.uint64), words])
        whole, size = np.array([0]), np.array([40])
        assert maker.rests(words, whole, size) == maker.rests(moved, whole + at, size)
    one, two = (np.array([words[(i.bit_count() + k) % 2] for i in range(2048)]) for k in (0, 1))
    at, size = np.array([0]), np.array([2048])
    assert maker.runs(maker.sums(one), at, size) == maker.runs(maker.sums(two), at, size)
    assert maker.rests(one, at, size) != maker.rests(two, at, size)


def test_suffix_automaton_against_search():
    rng = random.Random(2)
    for _ in range(60):
        passages = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 25))] for _ in range(5)]
        found = list(substrings.repeated_windows(passages, 4))
        for n, passage in enumerate(passages):
            earlier = {tuple(p[i : i + 4]) for p in passages[:n] for i in range(len(p) - 3)}
            assert found[n] == [i for i in range(len(passage) - 3) if tuple(passage[i : i + 4]) in earlier]


def _brute(texts: dict[int, str], window: int) -> dict[int, str]:
    seen: set[tuple] = set()
    kept = {}
    for doc_id, text in sorted(texts.items()):
        words = text.split()
        stays = [True] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                stays[i : i + window] = [False] * window
            seen.add(run)
        kept[doc_id] = " ".join(w for w, s in zip(words, stays, strict=True) if s)
    return kept


def test_substrings_of_few_words_and_many_surroundings(spark, monkeypatch):
    """A phrase of a gram's length in many surroundings takes the way of single windows."""
    rng = random.Random(3)
    phrase = " ".join(f"p{i}" for i in range(9))
    texts = {}
    for i in range(300):
        words = [rng.choice("abc") if i % 3 else f"u{rng.randrange(40)}" for _ in range(rng.randrange(4, 40))]
        texts[i] = " ".join([*words[: len(words) // 2], phrase, *words[len(words) // 2 :]])
    rows = spark.createDataFrame(list(texts.items()), KIND)
    want = _brute(texts, 12)
    for limit in (2000, 3):
        monkeypatch.setattr(substrings, "SEGMENTS", limit)
        found = {r["doc_id"]: r["kept"].decode() for r in substrings.without_repeats(rows, 12, 8).collect()}
        assert found == want


def test_anchors_meet_for_each_near_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for bits in range(1, 5):
        flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, bits, False).astype(np.uint64)) for _ in base])
        other = base ^ flips
        homes, guests = ([set() for _ in base] for _ in range(2))
        for found, fp, want in ((homes, base, True), (guests, other, False)):
            for rows, anchor, home in simhash.anchors(fp):
                if home == want:
                    for r, a in zip(rows.tolist(), anchor.tolist(), strict=True):
                        found[r].add(a)
        assert all(h & g for h, g in zip(homes, guests, strict=True))


@pytest.mark.parametrize("size", [4096, 3])
def test_links_with_and_without_slices(spark, monkeypatch, size):
    """A ball of near fingerprints, cut into cells or not, gives the components of all pairs."""
    monkeypatch.setattr(simhash, "SLICE", size)
    rng = np.random.default_rng(5)
    ball = np.uint64(0) ^ np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, False).astype(np.uint64)) for _ in range(120)])
    far = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([ball, far, far[:20] ^ np.uint64(5)]))
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    from txguard.llm.components import components

    found = {r["node"]: r["root"] for r in components(simhash.links(rows)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    label = fps.view(np.int64).copy()
    while True:
        least = np.where(near, label[None], np.iinfo(np.int64).max).min(1)
        if (least == label).all():
            break
        label = least
    assert {int(a): int(found.get(int(a), a)) for a in fps.view(np.int64)} == dict(zip(fps.view(np.int64).tolist(), label.tolist(), strict=True))


def test_one_document_of_each_group_stays(spark, odd):
    rows = simhash.deduplicated(odd)
    assert rows.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in rows.collect()) == ["1", "3", "3", "5", "7", "None"]


def test_mixing_copies_and_columns(spark, odd):
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns
    sizes = mixing.mixture(odd).agg(F.sum("copies")).first()[0]
    assert rows.count() == sizes


def test_targets_by_hand(spark):
    """Weights 5, 2, 1 in order; the small source stops at twice its size and the rest is shared again."""
    sizes = spark.createDataFrame([("sa", "a", 10), ("sb", "b", 100), ("n", None, 100), ("sz", "z", 0)], "__source string, source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert found["a"] == 20.0 and found["z"] == 0.0
    # 315 words are wanted; a stops at 20, and b (2) and null (5 again, after z's 1) share the other 295.
    assert found["b"] == pytest.approx(295 - 200) and found[None] == 200.0


def test_neighbours_of_odd_vectors(spark):
    rows = [(20 * i, [float(i), 1.0], 0) for i in range(5)]
    rows += [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0)]
    rows += [(None, [1.0, 1.0], 0), (7, [], 0), (8, [1.0, 2.0, 3.0], 0), (9, [3.0, 1.0], 0), (9, [3.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = ann.neighbours(table, k=20, tables=8, probes=1.0).collect()
    by_query: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by_query[20] == [(80, 5.0), (9, 4.0), (9, 4.0), (60, 4.0), (40, 3.0), (0, 1.0)]
    assert set(by_query) == {0, 20, 40, 60, 80}


def test_slices_of_cells_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(200, 8)), np.tile(rng.normal(size=8), (100, 1))])
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, ann.neighbours(table, probes=1.0).collect()))
    monkeypatch.setattr(ann, "SLICE", 7)
    assert sorted(map(tuple, ann.neighbours(table, probes=1.0).collect())) == whole
    exact = x @ x.T
    np.fill_diagonal(exact, -np.inf)
    assert {r[0] for r in whole} == set(range(0, 300, 20))
    for q in range(0, 300, 20):
        assert {r[3] for r in whole if r[0] == q} <= set(np.round(exact[q], 12)) or np.allclose(
            sorted((r[3] for r in whole if r[0] == q), reverse=True), np.sort(exact[q])[::-1][:20]
        )


def _outlier(rng):
    x = rng.normal(size=(400, 30))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 100
    return x


def _lognormal(rng):
    return rng.normal(size=(400, 30)) * rng.lognormal(0, 1.5, 400)[:, None]


def _clusters(rng):
    side = np.where(np.arange(400) < 390, 1.0, -1.0)[:, None]
    return side * rng.normal(size=30) + 0.01 * rng.normal(size=(400, 30))


def _few(rng):
    return rng.normal(size=(25, 30))


@pytest.mark.parametrize("make", [_outlier, _lognormal, _clusters, _few])
def test_no_axis_hides_a_neighbour(spark, make):
    """Whatever the norms and directions: all neighbours of all queries in the exact mode, nine of ten and full lists without."""
    x = make(np.random.default_rng(10))
    # Queries of both clusters.
    ids = np.random.default_rng(11).permutation(len(x))
    table = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")
    found, quick = {}, {}
    for lists, exact in ((found, True), (quick, False)):
        for r in sorted(ann.neighbours(table, exact=exact).collect(), key=lambda r: r["rank"]):
            lists.setdefault(r["query_id"], []).append(r["vec_id"])
    shared = 0
    for q in np.flatnonzero(ids % 20 == 0):
        inner = (x * x[q]).sum(1)
        order = np.lexsort((ids, -inner))
        best = [int(ids[i]) for i in order if i != q][:20]
        assert found[int(ids[q])] == best and len(quick[int(ids[q])]) == len(best)
        shared += len(set(best) & set(quick[int(ids[q])]))
    assert shared >= 0.9 * sum(map(len, found.values()))


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; line</h1><p>First paragraph, with <b>bold</b>   words
and a <a href="/x">link</a>.<p>Second one &lt;here&gt;, which is longer than the first one by some words.
<div class="ad">Buy this now</div><p>Third.</p><script>var x = "</p><p>no</p>";</script></article>
<div class="comments"><div class="comment"><p>I do not agree, said a reader.</p></div></div>
<form><label>Name</label><input></form><footer>&copy; 2024 All rights</footer></body></html>"""


def test_foreign_elements_lose_no_text():
    """A formula and an object's words count; a drawing without an end loses nothing but its tag."""

    def texts(page):
        return [b.text for b in blocks(page)]

    rest = "<p>One.</p><svg><text>drawn</text><svg/><svg></svg></svg><p>Two.</p>"
    for icon in ("<svg class='a'/>", "<math/>", "<svg hidden/>", '<svg a="b=c"/>', "<svg class=a/>", "<svg><path>", "<template>", "<svg><script>'</svg>'</script>"):
        assert texts(f"<html><head>{icon}</head><body>{rest}") == ["One.", "Two."], icon
    page = "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object data=a.pdf>the <b>file</b></object> end.</p><p>Next.</p>"
    assert texts(page) == ["So x=2 and the file end.", "Next."]
    assert texts("<p>a<template><p>b<template>c</template>d</template>e<iframe>f</iframe>") == ["ae"]
    assert texts("<p>a <object>b<p>c <math>d<p>e") == ["a b", "c d", "e"]
    assert not blocks("<p><math hidden/>x")[0].words


@pytest.fixture(scope="module")
def field():
    return html_extract.train(html_extract.labelled_pages())


def test_page_by_hand(spark, field):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain text only"), (4, "w", "<p"), (None, "x", "<article><p>a<p>b")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = [r["text"] for r in html_extract.extracted(table, field).collect()]
    assert "Head & line\nFirst paragraph, with bold words and a link.\nSecond one <here>, which is longer than the first one by some words.\nThird." in found
    assert "a\nb" in found and found.count("") >= 2


def test_labels_of_unseen_pages(field):
    wrong = total = 0
    for page in html_extract.labelled_pages(150, seed=99):
        labels = field.decode([b for b, _ in page])
        wrong += sum(a != b for a, (_, b) in zip(labels, page, strict=True))
        total += len(page)
    assert wrong / total < 0.01


def test_viterbi_against_all_labellings(field):
    import itertools

    page = blocks(PAGE)[:9]
    scores = [sum(field.weights.get(f, 0.0) for f in row) for row in html_extract.features(page)]

    def total(labels):
        return sum(s for s, on in zip(scores, labels, strict=True) if on) + sum(field.pairs[a, b] for a, b in itertools.pairwise(labels))

    assert tuple(field.decode(page)) == max(itertools.product((0, 1), repeat=len(page)), key=total)


def test_escapes_are_reversible(spark):
    rng = random.Random(7)
    marks = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN", "<</TURN>>", "\\", "<", "[", ">", "s>", " ", "\n", "x", "é"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "turn long, text string")
    escaped = rows.withColumn("e", chat.escape(F.col("text"))).withColumn("back", chat.unescape(F.col("e")))
    for r in escaped.collect():
        assert r["back"] == r["text"]
        assert not any(mark in r["e"] for mark in chat.INSTRUCT.controls())


def test_conversations_come_back(spark):
    rng = random.Random(8)
    marks = ["<s> ", " </s>\n", "[INST]", " [/INST] ", "<<SYS>>", "<</SYS>>\n", "<<TURN x>>\n", "<</TURN>>", "\\", "<", "\n", "x", ""]
    roles = ["system", "user", "assistant", "tool", None, "a>b\\[INST]\n<</TURN>>", ""]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(roles), "".join(rng.choice(marks) for _ in range(rng.randrange(6)))))
    rows += [(None, None, "user", None), (None, 1, "assistant", "late"), (99, 0, "user", "a"), (99, 1, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    found = {r["conv_id"]: r for r in chat.parsed(chat.formatted(table)).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0))
        assert [(t["role"], t["text"]) for t in found[conv]["turns"]] == [(r[2], r[3] or "") for r in want], conv
        assert found[conv]["loss_texts"] == [r[3] or "" for r in want if r[2] == "assistant"]
    assert found[99]["valid"] and not found[None]["valid"]


def test_roles_and_texts_of_any_length(spark):
    rows = [(1, 0, "r" * 100_000, "x"), (1, 1, "user", "[INST]" * 20_000), (2, 0, "a\\b>" * 30_000, "y" * 100_000), (2, 1, "\\" * 3_000, "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r["turns"] for r in chat.parsed(chat.formatted(table)).collect()}
    for conv in (1, 2):
        assert [(t["role"], t["text"]) for t in found[conv]] == [(role, text) for c, _, role, text in rows if c == conv]


def test_winnowing_by_hand(spark):
    """The chosen grams are the rightmost least ones of each window, and shared runs share a gram."""
    rng = random.Random(9)
    shared = " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(11))
    texts = {0: "", 1: "one", 2: "a b c d", 3: "a a a a a a a a a a a a a a", 4: f"x y z {shared} q", 5: f"{shared} r s t u v w"}
    rows = spark.createDataFrame([*texts.items(), (6, None)], KIND)
    found = {
        r["doc_id"]: r
        for r in winnow.with_fingerprint(rows, "text", "grams")
        .select("doc_id", winnow.hashes(F.col("grams")).alias("h"), winnow.places(F.col("grams")).alias("p"))
        .collect()
    }
    assert found[0]["h"] == [] == found[6]["h"]
    assert len(found[1]["h"]) == 1 == len(found[2]["h"])
    assert found[3]["p"] == [7, 8, 9, 10] and len(found[3]["h"]) == 1
    assert set(found[4]["h"]) & set(found[5]["h"])


def test_next_document_goes_round(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in (5, 1, 9, 3)] + [(None, "none")], KIND)
    docs = rows.withColumn("__row", F.xxhash64("doc_id"))
    found = {r["text"]: r["next_text"] for r in winnow.with_next(docs, ["text"]).collect()}
    assert found == {"t1": "t3", "t3": "t5", "t5": "t9", "t9": "none", "none": "t1"}


def test_quality_without_both_classes(spark, none):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], KIND)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.scored(docs, labels).collect()] == [0.5, 0.5]
    assert quality.accepted(docs, labels).count() == 2


def test_packing_odd_rows(spark, odd):
    rows = packing.packed(odd, byte_bpe(), length=64).collect()
    per_sequence: dict[int, int] = {}
    for r in rows:
        per_sequence[r["sequence_id"]] = per_sequence.get(r["sequence_id"], 0) + r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert sorted(per_sequence.values())[1:] == [64] * (len(per_sequence) - 1)
    assert sum(1 for r in rows if r["doc_id"] == 2) == 1


def test_token_files_of_odd_rows(spark, odd, tmp_path):
    token_files.write_token_files(odd, f"{tmp_path}/t", byte_bpe())
    rows = sorted(token_files.read_token_files(spark, f"{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 3, 3, 4, 5, 6, 7, None, None]
    assert [r["start"] for r in rows[1:]] == [r["start"] + r["n_tokens"] for r in rows[:-1]]


def test_pipeline_on_odd_rows(spark, folder, empty_folder):
    docs = corpus_pipeline.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.table(spark, folder, "documents").columns
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert corpus_pipeline.run(spark, empty_folder).count() == 0


def test_nothing_unbounded_comes_to_the_driver():
    """Sums of two classes in the classifier; bitmaps, split prefixes and coarse sums of bounded size of the phrases."""
    import re
    from pathlib import Path

    for path in Path(simhash.__file__).parent.glob("*.py"):
        text = path.read_text()
        found = len(re.findall(r"\.(collect|toPandas|toLocalIterator)\(\)", text))
        assert found <= {"quality.py": 1, "phrases.py": 3}.get(path.name, 0), path.name
        for word in ("localCheckpoint", "crossJoin", ".rdd", "F.udf(", "repartition(1)", "tempfile"):
            assert word not in text, (path.name, word)


def _tag_end(page: str, at: int) -> int | None:
    """Where a tag whose name ends at ``at`` is over, by the steps that browsers take; None if it never is."""
    state, quote = "before", ""
    while at < len(page):
        c = page[at]
        if state == "quoted":
            if c == quote:
                state = "before"
        elif c == ">":
            return at + 1
        elif state == "value" and not c.isspace():
            quote = c
            state = "quoted" if c in "\"'" else "plain"
        elif state == "plain":
            state = "before" if c.isspace() else "plain"
        elif state == "before":
            state = "before" if c.isspace() or c == "/" else "name"
        elif state in ("name", "after") and c == "=":
            state = "value"
        elif state == "name":
            state = "before" if c == "/" else "after" if c.isspace() else "name"
        elif state == "after" and not c.isspace():
            state = "before" if c == "/" else "name"
        at += 1
    return None


def test_tags_end_where_browsers_end_them():
    assert [b.text for b in blocks("<p>one</p><img alt=don't><p>two</p><p>it's three</p><p>four</p>")] == ["one", "two", "it's three", "four"]
    assert [b.text for b in blocks('<p class="a" b">two</p>')] == ["two"]
    rng = random.Random(10)
    ended = 0
    for _ in range(20_000):
        inside = "".join(rng.choice(["a", "b", "=", "=", '"', '"', "'", " ", "/", ">", "x=y"]) for _ in range(rng.randrange(14)))
        page = f"<img {inside}>rest"
        end = _tag_end(page, 4)
        if end is not None:
            ended += 1
            from html import unescape

            text = " ".join(page[end:].split())
            assert [b.text for b in blocks(page)] == ([unescape(text)] if text else []), page
    assert ended > 15_000


def test_a_very_long_page_and_open_quotes():
    """No text goes where a quote is never closed: such a value ends like one without quotes."""
    assert [b.text for b in blocks('<p a="b>r</p>s')] == ["r", "s"]
    page = "".join(f"<p class=x{i} title='t'>word {i}</p>" for i in range(50_000))
    assert len(blocks(page)) == 50_000
    assert len(blocks("<p a='>x</p>" * 5_001)) > 0


def _unit(rng, n: int, d: int = 64) -> np.ndarray:
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def _vector_sets() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(0)
    given = {f: np.array(pq.read_table(f"/root/testdata/{f}/embeddings.parquet").column("embedding").to_pylist(), float) for f in ("sf0.01", "sf0.1")}
    side = _unit(rng, 1)[0]
    return {
        **given,
        "one vector three times as long": np.vstack([given["sf0.01"], 3 * _unit(rng, 1)]),
        "one vector a hundred times as long": np.vstack([given["sf0.01"], 100 * _unit(rng, 1)]),
        "two opposite clusters": np.vstack([side + 0.3 * _unit(rng, 500), -side + 0.3 * _unit(rng, 500)]),
        "lognormal lengths": _unit(rng, 2000) * np.exp(rng.normal(size=2000))[:, None],
        "pareto lengths": _unit(rng, 1500) * (rng.pareto(1.0, 1500) + 1)[:, None],
        "equal vectors": np.repeat(_unit(rng, 1), 300, 0),
        "few vectors": _unit(rng, 15),
    }


@pytest.mark.parametrize("name", sorted(_vector_sets()))
def test_recall_of_the_tables_alone(spark, monkeypatch, name):
    """At least 0.9 of the true neighbours, no list short, and almost no query compared with all rows."""
    x = _vector_sets()[name]
    every, among = [], ann._among_all
    monkeypatch.setattr(ann, "_among_all", lambda rows, asked, k: every.append(asked.count()) or among(rows, asked, k))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict[int, list] = {}
    for r in ann.neighbours(table).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    queries, k = range(0, len(x), 20), min(20, len(x) - 1)
    hits = 0
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        assert len(set(found[q])) == len(found[q]) == k
        hits += int((score[found[q]] >= np.sort(score)[-k] - 1e-12).sum())
    assert hits / (k * len(queries)) >= 0.9
    # With fewer rows than a list holds, the tables may leave it short.
    assert every[0] <= 0.05 * len(queries) or len(x) <= 20


def test_exact_mode_finds_all(spark):
    x = _vector_sets()["sf0.01"]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.neighbours(table, exact=True).where("rank = 20").collect():
        score = np.delete(x @ x[r["query_id"]], r["query_id"])
        assert r["score"] == pytest.approx(np.sort(score)[-20], abs=1e-12)
