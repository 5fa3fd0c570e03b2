"""Every query of the package on the small tables against SQL or brute force, on odd rows, and on empty tables."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from compare import database, difference
from conftest import SMALL
from odd_rows import ODD, empty_folder, folder, none, odd  # noqa: F401
from tokenizers import Tokenizer

from txguard.llm.queries import ORACLES, QUERIES, byte_bpe

GIVEN = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def tables():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    assert difference(spark, tables, QUERIES[name], ORACLES[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    rows = QUERIES[name](spark, empty_folder).collect()
    assert len(rows) == (1 if name == "op9_chat_formatting" else 0)


DOCUMENT_QUERIES = [q for q in QUERIES if q.split("_")[0] in ("op1", "op2", "op3", "op5", "op7", "op8", "op12")]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_odd_rows_give_one_row_each(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i in [1, 2, 3, 3, None, None, 4, 5, 6, 7, 3])
    again = {r for r in rows if r["doc_id"] in (3, 5, 6)}
    if name.startswith("op5"):
        by_id = {r["doc_id"]: r for r in again}
        assert by_id[5]["n_removed"] < by_id[6]["n_removed"] == by_id[6]["n_words"] == 60_000
        assert by_id[6]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_quality_scores(spark):
    rows = QUERIES["op1_quality_classifier"](spark, SMALL.replace("0.001", "0.01")).collect()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL.replace('0.001', '0.01')}/labels.parquet").to_pylist()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    unseen = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(unseen) > 100 and np.mean(unseen) > 0.97


def _simhash(text: str) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle, 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def test_simhash_components(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op2_simhash_near_dedup"](spark, SMALL).collect()}
    prints = {i: _simhash(t) for i, t in GIVEN.items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    least = {i: i for i in prints}
    for _ in prints:
        before = dict(least)
        for a in prints:
            least[a] = min(least[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4)
        if before == least:
            break
    assert {i: r["component_id"] for i, r in rows.items()} == least


def test_mixture_on_odd_rows(spark, folder):
    rows = QUERIES["op3_mixing_sources"](spark, folder).collect()
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    assert sum(r["size"] for r in rows) == sum(len((r[1] or "").encode().split()) for r in ODD)
    again = QUERIES["op3_mixing_sources"](spark, folder).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_neighbours_recall_and_scores(spark):
    folder = SMALL
    table = pq.read_table(f"{folder}/embeddings.parquet")
    x, ids = np.array(table["embedding"].to_pylist(), float), np.array(table["vec_id"])
    found = QUERIES["op4_cross_polytope_neighbours"](spark, folder).collect()
    hits = 0
    queries = np.flatnonzero(ids % 20 == 0)
    for q in queries:
        rows = sorted((r for r in found if r["query_id"] == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        inner = x @ x[q]
        inner[q] = -np.inf
        best = np.lexsort((ids, -inner))[:20]
        hits += len({r["vec_id"] for r in rows} & set(ids[best].tolist()))
        place = {int(v): i for i, v in enumerate(ids)}
        assert all(abs(r["score"] - inner[place[r["vec_id"]]]) < 1e-12 for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r["score"], r["vec_id"]))
    assert hits / (20 * len(queries)) >= 0.9


def test_removed_words(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op5_substring_dedup"](spark, SMALL).collect()}
    seen: set[tuple] = set()
    for doc_id in sorted(GIVEN):
        words = GIVEN[doc_id].encode().split()
        stays = [True] * len(words)
        for start in range(len(words) - 19):
            window = tuple(words[start : start + 20])
            if window in seen:
                stays[start : start + 20] = [False] * 20
            seen.add(window)
        kept = [w for w, stay in zip(words, stays, strict=True) if stay]
        r = rows[doc_id]
        assert (r["n_words"], r["n_removed"]) == (len(words), len(words) - len(kept)), doc_id
        assert r["kept_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(byte_bpe())
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in GIVEN.items()}


def _crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, ids):
    rows = {r["doc_id"]: r for r in QUERIES["op7_simple8b_token_files"](spark, SMALL).collect()}
    start = 0
    for doc_id in sorted(ids):
        whole = [*ids[doc_id], 0]
        assert tuple(rows[doc_id]) == (doc_id, start, len(whole), _crc(whole))
        start += len(whole)


def test_packing(spark, ids):
    rows = QUERIES["op10_packing"](spark, SMALL).collect()
    by_doc: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc_id, pieces in by_doc.items():
        whole, at = [*ids[doc_id], 1], 0
        for r in pieces:
            assert (r["start"], r["doc_tokens"]) == (at, len(whole))
            assert r["ids_crc32"] == _crc(whole[at : at + r["length"]])
            at += r["length"]
        assert at == len(whole)
    sequences: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(sequences) == list(range(len(sequences)))
    assert sorted(sequences.values())[1:] == [2048] * (len(sequences) - 1)


def _winnowed(text: str, gram: int = 4, window: int = 8) -> list[tuple[int, int]]:
    """(hash, place) of the chosen grams, by their definition: cyclic polynomials of word hashes, rightmost least per window."""
    mask = (1 << 64) - 1

    def turned(x: int, by: int) -> int:
        return (x << by | x >> 64 - by) & mask if by else x

    words = [xxhash.xxh64_intdigest(w, 42) for w in text.encode().split()]
    if len(words) < gram:
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed)
        grams = [seed] if words else []
    else:
        grams = []
        for i in range(len(words) - gram + 1):
            x = 0
            for w in words[i : i + gram]:
                x = turned(x, 1) ^ w
            grams.append(x)
    low = [xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42) & 0xFFFFFFFF for x in grams]
    chosen: dict[tuple[int, int], None] = {}
    for i in range(max(1, len(low) - window + 1) if low else 0):
        best = min(range(i, min(i + window, len(low))), key=lambda j: (low[j], -j))
        chosen[low[best], best] = None
    return list(chosen)


def test_winnowing_by_brute_force(spark):
    """Every fingerprint of the small table, and of its edited texts, from the grams' definition."""
    rows = {r["doc_id"]: r for r in QUERIES["op8_winnowing"](spark, SMALL).collect()}
    order = sorted(GIVEN)
    for doc_id, after in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(GIVEN[doc_id]) // 4
        edited = GIVEN[doc_id][: len(GIVEN[doc_id]) - cut] + GIVEN[after][:cut]
        for name, text in (("fingerprint", GIVEN[doc_id]), ("edited_fingerprint", edited)):
            assert rows[doc_id][name] == "".join(f"{h:08x}" for h, _ in _winnowed(text)), (doc_id, name)


@pytest.mark.parametrize("column", ["near_edited", "near_next", "fingerprint", "edited_fingerprint", "n_chars"])
def test_fingerprints_can_be_filtered(spark, column):
    """A filter on any column leaves the plan small."""
    found = QUERIES["op8_winnowing"](spark, SMALL)
    value = "'a'" if "finger" in column else "0.3"
    few = found.where(f"{column} < {value}")
    assert len(few._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert few.count() == sum(r[column] < (0.3 if column.startswith("n") else "a") for r in found.collect())


def test_quality_scores_by_hand(spark):
    """Every score of the small table, from the statistics and the labels alone."""
    from txguard.llm import quality

    taught = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    values = {r["doc_id"]: np.array([r[s] for s in quality.STATISTICS]) for r in quality.document_statistics(docs).collect()}
    d = len(quality.STATISTICS)
    of = {c: np.array([values[i] for i, q in taught.items() if q == c]) for c in (0, 1)}
    spread = {c: np.cov(x.T, bias=True) for c, x in of.items()}
    pooled = sum(len(x) * spread[c] for c, x in of.items()) / len(taught)
    logs = {}
    for c, x in of.items():
        own = quality.TOWARDS_POOLED + (1 - quality.TOWARDS_POOLED) * d / (d + len(x))
        shrunk = (1 - own) * spread[c] + own * pooled
        shrunk = (1 - quality.TOWARDS_DIAGONAL) * shrunk + quality.TOWARDS_DIAGONAL * np.diag(np.diag(shrunk)) + quality.FLOOR * np.eye(d)
        whole, inverse = np.linalg.slogdet(shrunk)[1], np.linalg.inv(shrunk)
        prior = np.log((len(x) + 1) / (len(taught) + 2))
        logs[c] = {i: prior - 0.5 * whole - 0.5 * (v - x.mean(0)) @ inverse @ (v - x.mean(0)) for i, v in values.items()}
    for r in QUERIES["op1_quality_classifier"](spark, SMALL).collect():
        want = 1 / (1 + np.exp(np.clip(logs[0][r["doc_id"]] - logs[1][r["doc_id"]], -700, 700)))
        assert r["score"] == pytest.approx(want, abs=1e-6)


def test_fingerprints(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op8_winnowing"](spark, SMALL).collect()}
    order = sorted(GIVEN)
    for doc_id, after in zip(order, [*order[1:], order[0]], strict=True):
        text, r = GIVEN[doc_id], rows[doc_id]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + GIVEN[after][:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, new, following = (
            {f[i : i + 8] for i in range(0, len(f), 8)}
            for f in (r["fingerprint"], r["edited_fingerprint"], rows[after]["fingerprint"])
        )
        assert r["near_edited"] == pytest.approx(len(own & new) / len(own | new))
        assert r["near_next"] == pytest.approx(len(own & following) / len(own | following))
        if text == GIVEN[after]:
            assert r["near_next"] == 1
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.5


def test_pages_give_their_article(spark):
    import html
    import re

    rows = {r["page_id"]: r for r in QUERIES["op6_html_extraction"](spark, SMALL).collect()}
    for page in pq.read_table(f"{SMALL}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*)</article>", page["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", article)]
        r = rows[page["page_id"]]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])
