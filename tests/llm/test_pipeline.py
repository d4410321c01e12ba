"""The pipeline against a brute-force version of its stages, and the registered queries' columns."""

from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from rows import SF, awkward, empty  # noqa: F401 - fixtures
from test_simhash import components, direct
from test_text_rules import plain_verdicts
from textlab.llm import mixing, packing, quality, secret_scan
from textlab.llm.tokens import Encoder, public_path

COLUMNS = {
    "op1_": "query_id rank vec_id score", "op2_": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_": "doc_id size source_size target taken", "op5_": "doc_id start n_tokens ids_crc32", "op6_": "doc_id fingerprint component_id",
    "op7_": "page_id url text n_chars", "op8_": "doc_id piece start length ids_crc32 sequence_id offset", "op9_": "doc_id start end first_doc_id",
    "op10_": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11_": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_": "doc_id held_out lang_pred score",
    "op13_": "vec_id component n deviation whitened explained identity_error",
}


def test_queries_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] + "_" for n in names) == sorted([*COLUMNS, "pipeline_"])


def test_queries_return_the_contract_columns(spark):
    for name, query in entry.queries().items():
        if name.startswith(("op2_", "op3_", "op6_", "op7_", "op8_", "op9_", "op11_", "op12_", "op13_")):
            assert set(COLUMNS[name.split("_")[0] + "_"].split()) <= set(query(spark, SF).columns)


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, out = docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs
    kept = [r for r, ok in zip(rows, plain_verdicts(rows, quality.MIN_GROUP)) if ok]
    assert sorted(r.doc_id for r in out["quality_rules"].collect()) == sorted(r.doc_id for r in kept)
    low = components([direct(r.text, 4) for r in kept], 4)
    groups: dict = {}
    for r, k in zip(kept, low):
        groups.setdefault(k, []).append(r)
    single = [min(g, key=lambda r: r.doc_id) for g in groups.values()]
    assert sorted(r.doc_id for r in out["near_duplicates"].collect()) == sorted(r.doc_id for r in single)
    clean = {r.doc_id: r for r in out["secret_scans"].collect()}
    assert {d: r.text for d, r in clean.items()} == {r.doc_id: secret_scan.redact(r.text) for r in single}
    assert all(r.n_chars == len(r.text) for r in clean.values() if "[SECRET]" in r.text)
    mixed = out["mix_sources"].collect()
    taken = {r.doc_id: r.taken for r in mixing.mix(out["secret_scans"]).collect() if r.taken}
    words: dict = {}
    for r in mixed:
        assert clean[r.doc_id].text.startswith(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == taken
    packed, enc = out["best_fit_packing"].collect(), Encoder(public_path(packing.TOKENIZER))
    assert sum(r.length for r in packed) == sum(len(enc.encode(r.text)) // 4 + 1 for r in mixed)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert out[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_stages_take_awkward_and_empty_tables(awkward, empty):
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(docs.sparkSession, docs, SF)
            assert got.columns == docs.columns and got.count() <= 2 * docs.count()
        packed = corpus_pipeline.best_fit_packing(docs.sparkSession, docs, SF)
        assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
