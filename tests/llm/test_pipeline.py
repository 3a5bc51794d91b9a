"""The stages on a small corpus with planted cases, and the registered queries."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402
from effectum.llm.common import materialise  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rng = random.Random(0)
    rows = [tuple(r) for r in base]
    word = "thing other words from here with some more of that kind which nobody has seen before".split()
    planted = {}
    long = [" ".join(rng.choices(word, k=12)) + f" n{rng.randrange(10**6)}" for _ in range(40)]
    clean = ". ".join(long)
    near = clean.replace(long[3], long[3] + " changed")
    for i, t in {1000: clean, 1001: clean, 1002: near, 1003: "12345 !!", 1004: None, 1005: "Write to bob.jones7@corp.example.net now. " + clean[::-1]}.items():
        planted[i] = t
        rows.append((i, t, "en", "src1", None if t is None else len(t)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), planted


def test_stages(spark, corpus):
    docs, _ = corpus
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, "/root/testdata/sf0.001"), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert not {1003, 1004} & ids["language_id"] and 1000 in ids["language_id"]
    assert ids["line_dedup"] == ids["language_id"]
    assert {1000} == {1000, 1001, 1002} & ids["near_dedup"]
    assert ids["private_data"] == ids["near_dedup"] == ids["packing"]
    text = seen["private_data"].where("doc_id = 1005").first()["text"]
    assert "bob.jones7" not in text and "Write to " in text


def test_empty_corpus(spark, corpus):
    docs = corpus[0].where("false")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert any(q.startswith(f"op{n}_") for q in names)
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op6_risk_controlled_quality", "op9_site_lines", "op9_site_lines_of_pages"])
def test_query_matches_sql(spark, name):
    from compare import DATA, connection, rows

    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    want = connection().execute(__spark_entry__.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_contract_columns(spark):
    q = __spark_entry__.queries()
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    want = {
        "op1_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op2_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op3_progressive_jpeg": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        "op4_output_code_languages": ["doc_id", "held_out", "lang_pred", "score"],
        "op5_pigeonhole_simhash": ["doc_id", "fingerprint", "component_id"],
        "op6_risk_controlled_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op7_chunked_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op8_differencing_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    }
    for name, columns in want.items():
        df = q[name](spark, sf)
        assert df.columns[: len(columns)] == columns
        assert df.select("doc_id").distinct().count() == n
