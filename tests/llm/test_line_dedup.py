import duckdb

from ratingspark.llm import line_dedup as ld

SF = "/root/testdata/sf0.001"


def own(k, n=30):
    return " ".join(f"own{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + (j * k) % 26)}q" for j in range(n))


def test_matches_sql(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    shared = "Common footer line of this site"
    rows += [(10_000 + k, own(k) + "\n" + shared + f"\nPage {k} of 20 shown here") for k in range(6)]
    rows += [(20_000 + k, own(k + 7) + f"\nSigned by the author named {chr(97 + k)}xx on day {k}") for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = ld.line_digests(frame).toPandas()
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = con.sql(ld.ORACLE).df()
    cols = ["doc_id", "n_lines", "n_dropped", "text_sha256"]
    assert sorted(got[cols].itertuples(index=False, name=None)) == sorted(want[cols].itertuples(index=False, name=None))
    assert got.n_dropped.sum() >= 14


def test_templates_generalise_and_first_stays(spark):
    rows = [(k, own(k) + f"\nDownloaded on {k} June by user {chr(97 + k)}name today\n" + own(k + 9)) for k in range(5)]
    rows += [(9, own(23) + "\nDownloaded on nothing else")]
    got = {r.doc_id: r for r in ld.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_dropped for k in (0, 1, 2, 3, 4, 9)] == [0, 1, 1, 1, 1, 0]
    assert got[0].text == rows[0][1] and got[1].text == own(1) + "\n" + own(10)
    all_gone = ld.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=False)
    assert sum(r.n_dropped for r in all_gone.collect()) == 5


def test_copies_stay_whole(spark):
    text = "\n".join(own(k, 12) for k in range(8))
    rows = [(k, text + f"\nsome ending {chr(97 + k)}") for k in range(4)] + [(10, "x"), (11, text)]
    got = ld.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_dropped == 0 for r in got)


def test_boilerplate_pages_lose_the_passage_and_near_copies_stay(spark):
    """Pages of a 60-word passage and ten words of their own are no near
    copies of each other; texts that differ in their ending are."""
    passage = "\n".join(own(k, 12) for k in range(5))
    rows = [(k, passage + "\n" + " ".join(f"page{chr(97 + k)}{chr(97 + j)}" for j in range(10))) for k in range(12)]
    copied = "\n".join(own(k, 12) for k in range(10, 19))
    rows += [(100 + k, copied + f"\nsome ending {chr(97 + k)}") for k in range(4)]
    # a page of repeated words is no near copy, however long its lines are
    rows += [(200 + k, "La " * 60 + "\n" + " ".join(f"la{chr(97 + k)}{chr(97 + j)}" for j in range(10))) for k in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in ld.drop_recurring_lines(frame, verified=True).collect()}
    assert [got[k] for k in range(12)] == [0] + [5] * 11
    assert all(got[100 + k] == 0 for k in range(4)) and [got[200 + k] for k in range(4)] == [0, 1, 1, 1]


def test_short_lines_and_unspaced_scripts(spark):
    """Exact short lines go, digits told apart; unspaced lines have templates."""
    han = "本页内容由用户上传于月日归作者所有未经许可不得转载"
    rows = [(k, own(k) + f"\nAll rights reserved.\nPage {k}\n{own(k + 9)}\n\n版权所有\n{han}{chr(0x4E00 + k)}") for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ld.drop_recurring_lines(frame, short=True).collect()}
    assert got[0].text == rows[0][1]
    for k in range(1, 5):
        assert got[k].text == own(k) + f"\nPage {k}\n{own(k + 9)}\n"


def test_equal_texts_count_as_one_document(spark):
    rows = [(k, own(1) + "\n" + own(2)) for k in range(10)] + [(20, own(3) + "\n" + own(2))]
    got = ld.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_dropped == 0 for r in got)


def test_edge_rows(edge_docs, no_docs):
    got = ld.drop_recurring_lines(edge_docs).collect()
    assert len(got) == 12 and set(edge_docs.columns) <= set(got[0].asDict())
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].text is None and by_id[1].n_lines == 0
    assert by_id[2].text == "" and by_id[2].n_lines == 1
    assert all(r.n_dropped == 0 for r in got)
    assert ld.drop_recurring_lines(no_docs).count() == 0 and ld.line_digests(no_docs).count() == 0
