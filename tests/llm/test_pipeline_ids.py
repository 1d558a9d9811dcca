"""The pipeline's stages with null and repeated ids: no row is lost or multiplied, repeats are copies."""

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(k, n=30):
    return " ".join(f"w{k}x{i}" for i in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def test_copies_of_null_and_repeated_ids(spark):
    rows = [(1, words(1), "a")] * 5 + [(2, words(2), "a"), (2, words(3), "a"), (3, words(3), "a"), (None, words(1), "a"), (None, words(4), "a"), (None, words(4), "a"), (None, words(5), "a"), (4, "", "a"), (4, None, "a"), (5, "", "a"), (None, "", "a"), (None, "", "a")]
    got = [(r["doc_id"], r["text"] or "") for r in p.drop_copies(spark, frame(spark, rows), SF).collect()]
    want = [(1, words(1)), (2, words(2)), (2, words(3)), (None, words(4)), (None, words(5)), (4, ""), (5, ""), (None, "")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_mix_takes_rows_by_row(spark):
    rows = [(None, words(k), "a") for k in range(40)] + [(7, words(k), "a") for k in range(40, 80)]
    docs = p.mask_personal_data(spark, frame(spark, rows), SF)
    mixed = p.mix_sources(spark, docs, SF)
    assert mixed.columns == p.COLUMNS
    got = mixed.collect()
    # The mix takes 1.5 times all words, of no row more than twice.
    assert 100 <= len(got) <= 140
    assert any(r["doc_id"] is None for r in got) and max(got.count(r) for r in got) <= 2
