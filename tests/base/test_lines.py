"""Lines that are sentences of their own, and lines that were wrapped."""

from berrak.operators import segment

CASES = [
    ("Yarın su kesilecek\nLütfen su biriktirin", ["Yarın su kesilecek", "Lütfen su biriktirin"]),
    ("Yarın sular kesilecek ve\nLütfen su biriktirin", ["Yarın sular kesilecek ve\nLütfen su biriktirin"]),
    ("Yarın su kesilecek,\nLütfen su biriktirin", ["Yarın su kesilecek,\nLütfen su biriktirin"]),
    ("Bugün uzun bir yazı\nyazdık ve yattık.", ["Bugün uzun bir yazı\nyazdık ve yattık."]),
    ("Değerli komşularımız,\nYarın su kesilecek. Su\nbiriktirin.", ["Değerli komşularımız,", "Yarın su kesilecek.", "Su\nbiriktirin."]),
    ("Sayın Veli,\nOkul\nyarın kapalı.", ["Sayın Veli,", "Okul\nyarın kapalı."]),
    ("Kedi, köpek,\nAt ve inek\nyarın gelecek.", ["Kedi, köpek,\nAt ve inek\nyarın gelecek."]),
    ("Okul açıldı.\nDers programı\nHerkes geldi.\nÇocuklar şunları,\nKitap ve defter getirdi.", ["Okul açıldı.", "Ders programı", "Herkes geldi.", "Çocuklar şunları,\nKitap ve defter getirdi."]),
    ("- Elma\n- Armut\nKiraz geldi", ["- Elma", "- Armut\nKiraz geldi"]),  # an item may be wrapped
    ("- Elma\nKiraz geldi\nDut geldi", ["- Elma", "Kiraz geldi", "Dut geldi"]),
    ("Tek satır var. İki cümle var.", ["Tek satır var.", "İki cümle var."]),
    ("***\nDün geldik\n---\nBugün gittik", ["Dün geldik", "Bugün gittik"]),
    ("", []), (None, []), ("\n\n \n", []),
]


def test_lines(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")
    rows = segment.sentences(docs).collect()
    got = [[r.text for r in sorted(rows, key=lambda r: (r.para_idx, r.sent_no)) if r.doc_id == k] for k in range(len(CASES))]
    assert [(g, w) for g, (_, w) in zip(got, CASES, strict=True) if g != w] == []
    assert all(CASES[r.doc_id][0][r.start : r.start + len(r.text)] == r.text for r in rows)
