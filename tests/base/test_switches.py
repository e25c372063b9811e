"""Comments that switch rules off."""

from berrak.operators import segment


def test_switches_of_empty_paragraphs_hold_for_the_next(spark):
    text = "Bir.\n\n<!-- berrak: ignore KD-C01 -->\n\n<!-- BERRAK: ignore kd-b02 KD-C01 -->\n\nİki.\n\nÜç. <!-- berrak: ignore -->\n\nDört.\n\n<!-- berrak: ignore KD-K01 -->"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Sade."), (4, "<!-- berrak: ignore -->")], "doc_id long, text string")
    got = {(r.doc_id, r.text.strip()): sorted(r.suppressed) for r in segment.paragraphs(docs).collect() if r.text.strip()}
    assert got == {(1, "Bir."): [], (1, "İki."): ["KD-B02", "KD-C01"], (1, "Üç."): ["*"], (1, "Dört."): [], (3, "Sade."): []}
