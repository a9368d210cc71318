import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    names = [name for name, _ in cp.STAGES]
    assert len(names) == 5 and names[2] == "minhash_near_dedup"
    table, before = docs, docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        out = cp.written(stage(spark, table, SF), name)
        after = out.count()
        if k < 4:
            assert out.columns == docs.columns and after <= before
        else:
            assert after == before and "ids_sha256" in out.columns
        if name == "language_id":
            assert after == before  # every document of these tables has a language
        if name == "line_dedup":
            assert out.where("n_chars != char_length(text)").count() == 0
        table, before = out, after
    assert sorted(r.doc_id for r in cp.run(spark, SF).collect()) == sorted(r.doc_id for r in table.collect())


def test_edge_rows_pass_every_stage(spark, edge_docs):
    plain = edge_docs.select(*cp.COLUMNS)
    for table in (plain, plain.where("false")):
        for name, stage in cp.STAGES:
            table = cp.written(stage(spark, table, SF), name)
        assert table.count() in (0, 7)


@pytest.mark.parametrize("name", ["op1_warc_archive", "op9_label_propagation", "pipeline"])
def test_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries()
