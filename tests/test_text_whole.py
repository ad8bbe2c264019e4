"""Texts are normalised as they are, letters beyond ASCII included."""

from tessera.catalog import textual as T


def test_letters_beyond_ascii_stay(spark, tmp_path):
    texts = ["  Größe <b>3</b>\n Å  ", "Gr  e 3", "Привет мир", "你好", "été\u00a0 \u2003là\u3000", "ete", None, "Die Brücke trägt fünf Ångström. Größe ändert sich nie hier."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in T.normalised_text(spark, str(tmp_path)).collect()}
    assert {k: r.n_plain for k, r in got.items()} == {i: len(" ".join(t.replace("<b>", " ").replace("</b>", " ").split())) for i, t in enumerate(texts) if t is not None}
    assert len({r.content_id for r in got.values()}) == 7
    assert {r.doc_id: r.n_sentences for r in T.sentence_counts(spark, str(tmp_path)).collect()}[7] == 2
