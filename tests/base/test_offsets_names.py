"""Places in the original text and proper names by document, against plain walks over the characters and words."""

import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from berrak.functions.turkish import DASHES, DOUBLE_QUOTES, REMOVED, SINGLE_QUOTES, SPACES
from berrak.operators import names, offsets, segment
from berrak.plans.auditor import Audit


def walked(text):
    """Each normalised character with the places it stands for, one grapheme after the other."""
    out, k = [], 0
    while k < len(text):
        j = k + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        letter = text[k:j]
        if letter == "\r" and text[j : j + 1] == "\n":
            k = j
            continue
        for c in "\n" if letter == "\r" else unicodedata.normalize("NFC", letter):
            c = '"' if c in DOUBLE_QUOTES else "'" if c in SINGLE_QUOTES else "-" if c in DASHES else " " if c in SPACES else "" if c in REMOVED else c
            if c == " " and out and out[-1][0] == " ":
                out[-1] = (" ", out[-1][1], j)
            elif c:
                out.append((c, k, j))
        k = j
    return out


def test_runs_equal_a_walk():
    r = random.Random(1)
    signs = ["a", "e", "ı", " ", " ", "\t", " ", "​", "­", "\r", "\n", "\r\n", "“", "–", "é", "ö", "x̧̣", "😀", "."]
    for _ in range(400):
        text = "".join(r.choice(signs) for _ in range(r.randrange(0, 30)))
        want = walked(text)
        norm, *runs = offsets.mapped(text)
        assert norm == "".join(c for c, _, _ in want), text
        runs = [np.asarray(x, np.int64) for x in runs]
        places = [(a, b) for a in range(len(norm) + 1) for b in range(a, len(norm) + 1)]
        got = offsets.to_original(*runs, np.array([a for a, _ in places]), np.array([b for _, b in places]), len(norm), len(text))
        told = [(len(text), len(text)) if a == len(norm) else (want[a][1], want[b - 1][2] if b > a else want[a][1]) for a, b in places]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == told, text


def test_places_outside_are_moved_to_the_ends():
    norm, *runs = offsets.mapped("abc")
    runs = [np.asarray(x) for x in runs]
    assert [x.tolist() for x in offsets.to_original(*runs, np.array([-5, 9, 2]), np.array([99, 1, 0]), 3, 3)] == [[0, 3, 2], [3, 3, 2]]
    assert offsets.mapped(None) == ("", [], [], [])


ODD = "“Kütüphane”  açık.\r\n\r\n<b class='x'>İvedilikle</b>​  cevap   veriniz.  Bkz. [pafta](http://a.b/c_(d)) link.\r\n\r\nKitap (SKM) yá bilahare verilecektir."


def test_findings_stand_in_the_original(spark):
    docs = spark.createDataFrame([(1, ODD), (2, ODD.replace("\r\n", "\n")), (3, "Belge ibraz edin."), (4, None), (5, "")], "doc_id long, text string")
    audit = Audit(docs)
    rows = audit.located.join(docs.withColumnRenamed("text", "given"), "doc_id").collect()
    inside = [r for r in rows if r.orig_start is not None]
    assert {r.text for r in inside if r.doc_id == 1} >= {"İvedilikle", "veriniz", "bilahare"}
    for r in inside:
        given = r.given[r.orig_start : r.orig_end]
        # markup within a finding is blank in its text
        assert offsets.mapped(given)[0] == r.text or "<" in given or "[" in given, r
    assert audit.located.count() == audit.findings.count()
    assert all(ODD[r.orig_start : r.orig_end] == r.text for r in inside if r.doc_id == 1 and r.text in ("İvedilikle", "veriniz", "bilahare"))


def test_masks_keep_every_place(spark):
    texts = ["a <!-- x -- y\nz --> b", "[ad](u) ![r](v(w)x) [y]", "<p>1 < 2</p><br/> <a href='x", "", "düz"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(segment.mask_markup(F.col("t"))).collect()]
    assert [len(x) for x in got] == [len(t) for t in texts]
    assert [" ".join(x.split()) for x in got] == ["a b", "ad r [y]", "1 < 2 <a href='x", "", "düz"]


def test_proper_forms(spark):
    texts = {
        "Kerem geldi. Kerem oturdu.": ["kerem"], "Kerem geldi. Masada kerem vardı. Kerem oturdu.": [], "Kerem geldi.": [], "Kerem'in evi büyük.": ["kerem"], "Bu iyi. Bu kötü.": [], "KEREM GELDİ. KEREM OTURDU.": [],
        "Hâlit'e sor. Işıl okudu. Işıl yazdı. İnci geldi; İnci gitti.": ["halit", "inci", "ışıl"], "": [],
    }
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.n for r in docs.select("t", names.proper_forms(F.col("t")).alias("n")).collect()}
    assert got == {**texts, None: []}
    assert docs.where("t like 'Kerem geldi. Kerem%'").select(names.proper_forms(F.col("t"), ["kerem"])).first()[0] == []


def test_rules_spare_names_of_the_document(spark):
    said = "Sürdürülebilirlikçi bahçede oturdu. {} çay içti."
    docs = spark.createDataFrame([(1, said.format("Sürdürülebilirlikçi")), (2, said.format("Sonra sürdürülebilirlikçi")), (3, "Yazıldı geldi. Yazıldı oturdu."), (4, "Kitap yazıldı. Yazıldı diyor. Yazıldı sanıyor.")], "doc_id long, text string")
    rows = Audit(docs, only=["KD-K04", "KD-C03"]).findings.collect()
    found = {(r.doc_id, r.rule_id) for r in rows}
    assert (1, "KD-K04") not in found and (2, "KD-K04") in found
    assert (3, "KD-C03") not in found and (4, "KD-C03") in found
