"""The stages and queries against plain Python over the smallest tables."""
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_packing import want
from test_pii import brute as brute_pii
from test_quality import brute as brute_quality
from test_resemblance import brute_set
from test_simhash import brute_components, brute_print

import __spark_entry__
import corpus_pipeline
from lociforge.llm import mixing, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(llm):
    """The result of each stage, each over all rows of the one before."""
    docs, found = llm.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        found.append(rows)
        docs = llm.createDataFrame(rows, docs.schema)
    return llm.read.parquet(f"{SF}/documents.parquet").collect(), found, docs


def test_quality_stage(stages):
    rows, found, _ = stages
    for r in rows:
        n, _, _, _, repeat = brute_quality(r.text or "")
        if n < 20 or 100 * repeat > 30 * n:
            assert r.doc_id not in {k.doc_id for k in found[0]}
    assert set(found[0]) <= set(rows)


def test_near_duplicate_stage(stages):
    """One document of each component stays: links within 3 bits or from a 5-word similarity of 0.8."""
    _, found, _ = stages
    rows = found[0]
    prints, sets = [brute_print(r.text) for r in rows], [brute_set(r.text) for r in rows]
    linked = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3 or 5 * len(sets[i] & sets[j]) >= 4 * max(1, len(sets[i] | sets[j]))
    comps = brute_components([r.doc_id for r in rows], linked)
    assert sorted(r.doc_id for r in found[1]) == sorted(set(comps))
    assert set(found[1]) <= set(rows)


def test_stages_keep_odd_columns(llm):
    """Columns called like our own, with dots and with back ticks stay as they are."""
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text + " mail jo@example.com", "src", "en", 7, "x", "y", "z"), (2, None, None, None, None, None, None, None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, source string, lang string, _ledger int, `a.b` string, `c``d` string, row string")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(llm, docs, SF)
        assert out.columns == docs.columns
        row = out.filter("doc_id = 1").first()
        assert tuple(row)[2:] == ("src", "en", 7, "x", "y", "z")


def test_personal_data_stage(stages):
    _, found, _ = stages
    before = {r.doc_id: r for r in found[1]}
    assert len(found[2]) == len(found[1])
    for r in found[2]:
        text = before[r.doc_id].text
        assert r.text == pii.masked(text, pii.spans(text)[1]) and r.n_chars == len(r.text)
        assert brute_pii(r.text) == []


def test_mixing_stage(llm, stages):
    _, found, docs = stages
    before = {r.doc_id: r.text for r in found[2]}
    words = defaultdict(int)
    for r in found[3]:
        assert before[r.doc_id].startswith(r.text)
        words[r.doc_id] += len(r.text.split())
    plan, _ = mixing.mix(llm.createDataFrame(found[2], docs.schema))
    assert {r.doc_id: r.taken for r in plan.collect() if r.taken} == dict(words)


def test_packing_stage(llm, stages):
    _, found, docs = stages
    wanted, got = sorted(want(r.text) for r in found[3]), 0
    pieces = corpus_pipeline.STAGES[-1][1](llm, docs, SF).collect()
    assert sum(p.length for p in pieces) == sum(map(len, wanted))
    for p in pieces:
        got += len(struct.unpack(f"<{p.length}I", p.ids))
    assert got == sum(map(len, wanted))


def test_clean_documents_stay(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = llm.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    held = quality.ledger(docs).join(labels, "doc_id")
    bits = F.col("_ledger.bits")
    assert held.filter(quality.passes(bits, "base") & ~quality.passes(bits, quality.PRODUCTION)).count() == 0


def test_run_is_registered(llm):
    queries = __spark_entry__.queries()
    assert sorted(n for n in queries if n.startswith("op")) == sorted(
        ["op1_mixing", "op2_pii", "op3_packing", "op4_warc", "op5_quality_rules", "op6_simhash", "op7_fingerprints", "op8_url_filters", "op9_substring_dedup", "op10_licences", "op11_language_model", "op12_collocations", "op13_conversations"]
    )
    assert queries["pipeline"](llm, SF).count() > 0


def test_contract_columns(llm):
    queries = __spark_entry__.queries()
    wanted = {
        "op1_mixing": "doc_id size:bigint source_size:bigint target:double taken:bigint",
        "op2_pii": "doc_id n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
        "op3_packing": "doc_id start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
        "op4_warc": "page_id payload_bytes:bigint payload_digest:string record_type:string refers_to",
        "op5_quality_rules": "doc_id n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
        "op6_simhash": "doc_id fingerprint:string component_id",
        "op7_fingerprints": "doc_id n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
        "op9_substring_dedup": "doc_id n_words:bigint n_removed:bigint kept_sha256:string",
        "op10_licences": "doc_id n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string score:double",
        "op11_language_model": "doc_id held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
        "op12_collocations": "lang:string rank:bigint phrase:string a:bigint l:bigint r:bigint n:bigint score:bigint",
        "op13_conversations": "conv_id:bigint depth:bigint parent_conv_id:bigint n_convs:bigint n_children:bigint n_leaves:bigint saved_tokens:bigint ends_sha256:string",
    }
    for name, columns in wanted.items():
        df = queries[name](llm, SF)
        types = dict(df.dtypes)
        for column in columns.split():
            label, _, kind = column.partition(":")
            assert label in types and kind in ("", types[label]), (name, column)
        table = "pages" if name == "op4_warc" else "documents"
        if name not in ("op3_packing", "op12_collocations", "op13_conversations"):
            assert df.count() == llm.read.parquet(f"{SF}/{table}.parquet").count()
