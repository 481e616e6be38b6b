"""The operators against brute force, the libraries, SQL and held-out labels, on whole small tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
import tokenizers

import corpus_pipeline
from tallywell.llm import fingerprints, near_dedup, packing, pretokens, queries, sentencepieces
from tallywell.llm.common import documents

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in documents(spark, SF_DIR).select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def marks():
    rows = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF_DIR}/labels.parquet'").fetchall()
    return {d: {"quality": q, "toxic": t} for d, q, t in rows}


def run(spark, name):
    return queries.queries()[name](spark, SF_DIR).collect()


def library_ids(texts):
    library = tokenizers.Tokenizer.from_file(pretokens.vocabulary_path())
    return {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    wanted = sorted(tuple(r[k] for k in order) for r in want.fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in run(spark, name))
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted):
        assert [pytest.approx(x, abs=1e-9) if isinstance(x, float) else x for x in w] == list(g)


def test_language_on_held_out_rows(spark, texts):
    rows = run(spark, "op1_language_id")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    truth = {r["doc_id"]: r["lang"] for r in documents(spark, SF_DIR).select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.9


@pytest.mark.parametrize(
    ("name", "label", "modulus", "rest"), [("op8_quality", "quality", 4, 2), ("op9_toxicity", "toxic", 5, 0)]
)
def test_classifier_ranks_held_out_rows(spark, texts, marks, name, label, modulus, rest):
    rows = run(spark, name)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    held = [(r["score"], marks[r["doc_id"]][label]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    high = [s for s, y in held if y == 1]
    low = [s for s, y in held if y == 0]
    assert high and low
    auc = np.mean([(h > s) + 0.5 * (h == s) for h in high for s in low])
    assert auc >= 0.8


def test_fingerprints_equal_brute_force(spark, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op2_fingerprints")}
    order = sorted(texts)
    assert sorted(rows) == order
    for here, after in zip(order, order[1:] + order[:1]):
        text = texts[here]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + texts[after][:cut]
        own, changed, following = (fingerprints.fingerprint(t) for t in (text, edited, texts[after]))
        r = rows[here]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.written(own)
        assert r["edited_fingerprint"] == fingerprints.written(changed)
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(own, changed))
        assert r["near_next"] == pytest.approx(fingerprints.likeness(own, following))


def check_packing(rows, texts):
    ids = {d: found + [packing.END_ID] for d, found in library_ids(texts).items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    assert set(pieces) == set(texts)
    for doc_id, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc_id])
            at += r["length"]
        assert at == len(ids[doc_id])
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    total = sum(map(len, ids.values()))
    assert len(sequences) <= 1.02 * total / packing.CAPACITY + 1


def test_packing_holds_every_id_once(spark, texts):
    check_packing(run(spark, "op3_packing"), texts)


def test_sentencepiece_equals_the_library(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
    rows = run(spark, "op5_sentencepiece")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert list(r["ids"]) == want
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_token_counts_equal_the_library(spark, texts):
    want = {d: len(found) for d, found in library_ids(texts).items()}
    rows = run(spark, "op6_token_counts")
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["n_bytes"] == len(texts[r["doc_id"]].encode()) for r in rows)
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


def brute_classes(texts):
    """Every pair that shares a shingle, compared exactly; classes are connected components."""
    sets = {d: near_dedup.weighted_set(t) for d, t in texts.items()}
    holders, linked = defaultdict(list), set()
    for d, (elements, _) in sets.items():
        for e in elements.tolist():
            holders[e].append(d)
    for found in holders.values():
        linked.update((a, b) for k, a in enumerate(found) for b in found[k + 1 :])
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in linked:
        if near_dedup.similarity(sets[a], sets[b]) >= near_dedup.SIMILARITY:
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d in texts if len(sets[d][0])}


def test_near_duplicates_against_brute_force(spark, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op10_near_dedup")}
    assert sorted(rows) == sorted(texts)
    want = brute_classes(texts)
    by_class = defaultdict(set)
    for d, r in rows.items():
        by_class[r["class_id"]].add(d)
    for members in by_class.values():
        assert sum(rows[d]["kept"] for d in members) == 1
        assert all(rows[d]["class_size"] == len(members) for d in members)
        assert len({want[d] for d in members if d in want}) <= 1  # never joins what brute force parts
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    links = sum(n - 1 for n in sizes.values())
    found = sum(len(m) - 1 for m in by_class.values() if all(d in want for d in m))
    assert links and found >= 0.95 * links


def test_pipeline_against_its_operators(spark, texts):
    """Each filter's decision follows from its operator's own scores; what stays is packed whole."""
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    kept = {r["doc_id"] for r in rows}
    quality = {r["doc_id"] for r in run(spark, "op8_quality") if r["predicted"] == 1}
    assert kept and kept <= quality
    squeezed = ["".join(c for c in texts[d] if c not in " \t\n\v\f\r") for d in kept]
    assert len(set(squeezed)) == len(squeezed)
    check_packing(rows, {d: texts[d] for d in kept})
    left = brute_classes({d: texts[d] for d in kept})
    assert len(set(left.values())) >= 0.99 * len(left)
