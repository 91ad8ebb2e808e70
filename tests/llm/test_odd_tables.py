"""Every registered query and every pipeline stage over empty tables, and over tables of nulls,
empty, blank and very long texts, repeated rows and columns whose names the operators use."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from meterwise.llm import queries

DOC = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
LABEL = {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32(), "topic": pa.string()}
TALK = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
PAGE = {"page_id": pa.int64(), "url": pa.string(), "html": pa.string()}
ITEM = {"item_id": pa.int64(), "text": pa.string()}
TABLES = {"documents": DOC, "labels": LABEL, "conversations": TALK, "pages": PAGE, "benchmark": ITEM}
# Names that the operators give to columns of their own.
CLASH = ("h", "g", "k", "key", "row", "line", "lines", "removed", "n", "size", "target", "source_size", "taken", "score", "label", "run",
         "part", "doc", "held_out", "whole", "clean", "component_id", "n_words", "copies", "lang_pred", "owner", "repo", "found", "base", "spans", "rank",
         "weight", "bucket", "nth", "ref", "head", "depth", "fp")
PROSE = "the quick brown fox jumps over the lazy dog while seven old wizards quietly mix a potion of green herbs near the river bank at dawn"


def write(folder, rows):
    for name, schema in TABLES.items():
        extra = {c: pa.string() for c in CLASH if c not in schema}
        own = rows.get(name, [])
        columns = {c: pa.array([r[i] for r in own], t) for i, (c, t) in enumerate(schema.items())}
        columns |= {c: pa.array(["x"] * len(own), t) for c, t in extra.items()}
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    texts = [None, "", " \n\t ", PROSE, PROSE, PROSE + " today", "a", "123 456", "word " * 60_000, "x" * 300_000, "\n" * 2_000,
             "Zażółć gęślą jaźń\n" * 3, "\U0001F600 " * 50, PROSE.upper()]
    docs = [(i, t, [None, "en", "fr"][i % 3], [None, "web", "books", ""][i % 4], None) for i, t in enumerate(texts)]
    docs += [docs[3], docs[0], (100, PROSE, None, None, None)]
    return write(tmp_path_factory.mktemp("odd"), {
        "documents": docs,
        "labels": [(i, [0, 1, None][i % 3], None, None) for i in range(15)] + [(3, 1, 0, "t"), (None, 1, None, None)],
        "conversations": [(1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (2, 1, "user", "hi"), (2, 2, None, None), (2, 2, "assistant", "no"),
                          (None, 1, "user", "hi"), (3, None, "user", "hi"), (4, 1, None, None), (5, 1, "assistant", "a" * 100_000), (1, 1, "user", "hi")],
        "pages": [(1, None, None), (2, "u", ""), (3, "u", "é" * 80), (4, None, "é" * 80), (5, "u", "s" * 99), (6, "u", "s" * 99), (7, "u", "l" * 500_000)],
        "benchmark": [(1, PROSE), (2, None), (3, ""), (4, "a"), (5, " . ")]})


PER_DOCUMENT = [n for n in queries.QUERIES if n not in ("op5_warc", "op9_preferences", "op12_prefix_trie", "pipeline")]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_every_document_has_its_row(spark, odd, name):
    ids = {r.doc_id for r in queries.QUERIES[name](spark, odd).collect()}
    assert ids == {*range(14), 100}


def test_no_words_no_hits(spark, odd):
    got = {r.doc_id: r for r in queries.op3_suffix_arrays(spark, odd).collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].contaminated) == (0, 0, False) and got[3].contaminated and got[13].contaminated
    assert got[6].n_items == 1 and got[6].contaminated and got[3].n_items == 2  # the one-word item "a" is in the prose, too


def test_copies_share_a_component_and_wordless_texts_stand_alone(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_ngram_jaccard_join(spark, odd).collect()}
    assert {got[i][1] for i in (3, 4, 5, 13, 100)} == {3}
    assert [got[i] for i in (0, 1, 2, 6)] == [(0, 0), (0, 1), (0, 2), (1, 6)] and got[8] == (1, 8)


def test_pages_without_html(spark, odd):
    got = {r.page_id: r for r in queries.op5_warc(spark, odd).collect()}
    assert {k: (r.payload_bytes, r.record_type, r.refers_to) for k, r in got.items()} == {
        1: (0, "response", None), 2: (0, "response", None), 3: (160, "response", None), 4: (160, "revisit", 3), 5: (99, "response", None),
        6: (99, "response", None), 7: (500_000, "response", None)}


def test_statistics_and_sizes_of_odd_texts(spark, odd):
    stats = {r.doc_id: r for r in queries.op8_decision_list(spark, odd).collect()}
    assert all(stats[i].n_words == 0 and stats[i].base_failed and not stats[i].kept for i in (0, 1, 2, 10))
    assert stats[8].n_repeat_words == 60_000 and stats[11].n_dup_lines == 2
    mix = {r.doc_id: r for r in queries.op2_pivotal_mix(spark, odd).collect()}
    assert mix[0].size == 0 == mix[0].taken and mix[8].size == 60_000 and all(0 <= r.taken <= 3 * r.size for r in mix.values())
    words = {r.doc_id: r for r in queries.op10_backoff_lm(spark, odd).collect()}
    assert words[0].log_score is None and words[2].log_score is None and words[3].log_score < 0


def test_languages_of_odd_texts(spark, odd):
    got = {r.doc_id: r for r in queries.op7_language_id(spark, odd).collect()}
    assert all(got[i].lang_pred == "und" for i in (0, 1, 2, 7, 10, 12)) and all(0 <= r.score <= 1 for r in got.values())


def test_stages_keep_all_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(out.columns) == sorted(docs.columns), name
        assert {r.doc_id for r in out.collect()} <= {*range(14), 100}, name
