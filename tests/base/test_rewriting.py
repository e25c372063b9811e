"""Tidy pages, cleaned and punctuated texts, and answers held against their questions."""

import pytest
from pyspark.sql import functions as F

from berrak.operators import rewriting
from berrak.plans.queries import QUERIES
from berrak.sources import readers

SPREAD = [("K I Ş  A Y I", "KIŞ AYI"), ("B U  Y A Z", "BU YAZ"), ("a b", "a b"), ("Bu  bir satır", "Bu  bir satır"), ("Y e n i - ev", "Yeni - ev"), ("", ""), (None, None)]


def test_spread_words_are_joined(spark):
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(SPREAD)], "k int, line string")
    assert [r.x for r in rows.orderBy("k").select(readers.joined_letters(F.col("line")).alias("x")).collect()] == [y for _, y in SPREAD]


def test_short_lines_end_paragraphs(spark):
    lines = ["Kısa başlık", "Bu satır sayfanın en geniş satırıdır ve böyle sürer", "küçük harfle , sürer .", "Sonu noktalı.", "Yeni satır", None]
    rows = [(1, 0, k, x) for k, x in enumerate(lines)] + [(1, 1, 0, "Tek"), (2, 0, 0, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string")
    got = {(r.doc_id, r.page): (r.n_breaks, r.text) for r in readers.tidy_pages(pages).collect()}
    assert got == {
        (1, 0): (1, "Kısa başlık\n\nBu satır sayfanın en geniş satırıdır ve böyle sürer\nküçük harfle, sürer.\nSonu noktalı.\nYeni satır"),
        (1, 1): (0, "Tek"), (2, 0): (0, ""),
    }
    assert readers.tidy_pages(pages.limit(0)).count() == 0


CLEAN = [("## Konu  \n* **bir**  şey\n\n\n\n• __iki__ \t", "Konu\n- bir şey\n\n- iki"), ("a * b # c", "a * b # c"), ("e‑posta", "e-posta"), ("", "")]
DONE = [("Kısa başlık\nBu satırın sonunda nokta yok", "Kısa başlık\nBu satırın sonunda nokta yok."), ("Bu ilk satır altı kelimeden çok daha uzundur", "Bu ilk satır altı kelimeden çok daha uzundur."), ("Konu\n- madde\nSoru mu?\nson \n\nYeni konu\n", "Konu\n- madde\nSoru mu?\nson.\n\nYeni konu\n"), ("", "")]


@pytest.mark.parametrize(("function", "cases"), [(rewriting.clean_text, CLEAN), (rewriting.punctuate, DONE)])
def test_texts_made_ready(spark, function, cases):
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, text string")
    assert [r.x for r in rows.orderBy("k").select(function(F.col("text")).alias("x")).collect()] == [y for _, y in cases]


def test_every_answer_is_held_against_its_question(spark, tmp_path):
    said = [(1, 0, "user", "5 kişi 12.30 treni"), (1, 1, "assistant", "5 kişi"), (1, 2, "user", "2020 yılı"), (1, 3, "assistant", "2020 ve 7"), (1, 4, "assistant", None), (2, 0, "assistant", "9"), (3, 0, "user", "1")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): (r.missing, r.added) for r in QUERIES["fact_diff"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): ("saat:12.30", ""), (1, 3): ("", "sayı:7"), (1, 4): ("yıl:2020", ""), (2, 0): ("", "sayı:9")}
