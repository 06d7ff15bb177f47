import collections
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from loomstone.llm import registry
from loomstone.llm.scratch import stored, table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, counts = docs.columns, []
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), "stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == names and set(after) <= set(before)
        counts.append(len(after))
        if name == "toxicity":
            gone = set(before) - set(after)
            known = [labels[k] for k in gone if k in labels]
            assert known and sum(known) / len(known) > 0.8
        elif name != "near duplicates":
            assert set(after) == set(before)
    assert counts[0] < 1000 and counts[1] < counts[0]
    packed = stored(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "packed").collect()
    assert {r.doc_id for r in packed} == set(after)
    sizes = collections.Counter()
    for r in packed:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048 and sum(sizes.values()) / 2048 / len(sizes) > 0.97


def test_near_duplicates_look_up_few_rows(spark, monkeypatch):
    words = [f"w{i}" for i in range(6000)]
    text = lambda i: " ".join(words[100 * i : 100 * i + 100])
    rows = [(i, text(i)) for i in range(50)] + [(50, text(0) + " more"), (51, text(1)), (52, text(52)), (52, text(52)), (None, text(2)), (None, text(53)), (54, None), (54, None), (55, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    looked, same_row = [], corpus_pipeline.op7_jaccard_join.same_row

    def spied(a, b, how="inner"):
        looked.append((how, a.count()))
        return same_row(a, b, how)

    monkeypatch.setattr(corpus_pipeline.op7_jaccard_join, "same_row", spied)
    got = collections.Counter(tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    wanted = collections.Counter(rows) - collections.Counter([(50, text(0) + " more"), (51, text(1)), (52, text(52)), (None, text(2))])
    assert got == wanted
    assert dict(looked)["left"] < 12


def test_empty_corpus(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
    assert docs.count() == 0


SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id n_tokens ids_sha256 decoded_sha256", 2: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", 4: "doc_id held_out score predicted", 5: "doc_id held_out score predicted",
    6: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", 7: "doc_id n_shingles component_id", 8: "doc_id start n_tokens ids_crc32", 9: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    11: "lang source part item value rank", 12: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", 13: "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered_queries_keep_their_contract(spark, name):
    """Every registered query as it is registered, over whole tables; one row a document or conversation where that is the contract."""
    rows = registry.queries()[name](spark, SMALL).collect()
    assert rows
    n = int(re.match(r"op(\d+)_", name)[1]) if name != "pipeline" else None
    assert set(COLUMNS.get(n, "").split()) <= set(rows[0].__fields__)
    ids = {r.doc_id for r in table(spark, SMALL, "documents").select("doc_id").collect()}
    if n in (1, 2, 4, 5, 6, 7, 8, 13):
        assert len(rows) == len(ids) and {r.doc_id for r in rows} == ids
    if n == 9:
        assert {r.doc_id for r in rows} == ids
    if n in (4, 5):
        assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= (0.5 if n == 4 else 0.3)) for r in rows)
    if n is None:
        kept = {r.doc_id for r in rows}
        assert kept < ids and len(kept) > len(ids) / 2


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    wanted = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    plain = lambda rows: sorted((tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    frame = registry.queries()[name](spark, SMALL).select(*names)
    assert plain(frame.collect()) == plain(wanted.fetchall())
