"""Rules, scores, matching, facts, fixes, settings, sources, sinks and streams."""

import io
import random
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from berrak.operators import facts, findings, matching, readability, rules, segment
from berrak.plans.auditor import Audit
from berrak.plans.config import PROFILES, RULE_IDS, ConfigError, load_lexicon, load_profile
from berrak.plans.oracle import ORACLE
from berrak.plans.queries import QUERIES
from berrak.sources import readers, sinks
from berrak.streaming import stream

CASES = [
    ("KD-C01", "Bu cümle bir iki üç dört beş altı yedi sekiz dokuz kelime içerir.", True),
    ("KD-C01", "Bu cümle kısa.", False),
    ("KD-C03", "Su yarın kesilecektir.", True),
    ("KD-C03", "İnsanlar yarın gelecek.", False),
    ("KD-C04", "Ali bugün okula gelmedi.", True),
    ("KD-C04", "Ali bugün okula geldi.", False),
    ("KD-C02", "Yağmur dinecek ve çocuklar parka koşacak.", True),
    ("KD-C02", "Formu doldurun, çünkü memur formu okuyacak.", True),
    ("KD-C02", "Ekmek ve süt yarın bitecek.", False),
    ("KD-C03", "Masalar yarın boyanacak.", True),
    ("KD-C03", "Kadın bahçede kitap okuyor.", False),
    ("KD-C03", "Ayşe yeni eve taşındı.", False),
    ("KD-C04", "Kapıyı açık bırakmayın.", True),
    ("KD-C04", "Bugün ekmek yok.", False),
    ("KD-C05", "Gelmemek doğru değildir.", True),
    ("KD-C05", "Bu iş faydasız değil.", True),
    ("KD-C05", "Kimse okula gitmedi.", False),
    ("KD-C06", "Koşarak gelen çocuk düştü.", True),
    ("KD-C06", "Sabah olunca kalktı.", False),
    ("KD-C06", "İnsan hemen anlar.", False),
    ("KD-C07", "Yolun açılmasının hızlandırılması iyi.", True),
    ("KD-C07", "Yüzmeyi seviyoruz.", False),
    ("KD-C08", "Okulumuzun bahçesinin kapısının anahtarı kayboldu.", True),
    ("KD-C08", "Okulun kapısı açık.", False),
    ("KD-C10", "Köyümüz bu yaz suyu az olan evlere yeni bir kuyu daha açacak.", True),
    ("KD-C10", "Köyümüz kuyu açacak.", False),
    ("KD-K01", "Evrakı müdüre arz ederim.", True),
    ("KD-K01", "Katta oturuyoruz.", False),
    ("KD-K02", "Toplantı online olacak.", True),
    ("KD-K04", "Sorumluluklarınızdan söz ettik.", True),
    ("KD-K04", "Evimize gelin.", False),
    ("KD-K05", "Muhtar işe el koydu.", True),
    ("KD-K05", "Elini yıkadı.", False),
    ("KD-K07", "Yakında döneceğiz.", True),
    ("KD-B05", "Kurs 08.30-12.00 arasında.", True),
    ("KD-B05", "Dükkân saat 08.30 ile 12.00 arasında açık.", False),
    ("KD-B05", "Süt 4.50 lira.", False),
    ("KD-B08", 'Ali "hemen geliyorum" dedi.', False),
    ("KD-C09", "Su (temiz olanı) gelir.", True),
    ("KD-C09", "Kurum (SGK) açık.", False),
    ("KD-C11", "Başvuru yapmanız gerekmektedir.", True),
    ("KD-K01", "Belge ibraz edin.", True),
    ("KD-K02", "Bu link çalışmıyor.", True),
    ("KD-K03", "Önce SGK binasına gidin.", True),
    ("KD-K03", "Önce TBMM binasına gidin.", False),
    ("KD-K03", "Köy Hizmetleri Birliği (KHB) kapalı.", False),
    ("KD-K05", "Uyarıyı göz ardı etti.", True),
    ("KD-K07", "Size en kısa sürede döneriz.", True),
    ("KD-K08", "Doktor geldi. Sonra hekim gitti. Bir hekim daha geldi.", True),
    ("KD-B01", "Oraya yirmi beş kişi geldi.", True),
    ("KD-B01", "Oraya beş kişi geldi.", False),
    ("KD-B02", "Bölüm IV burada.", True),
    ("KD-B03", "Fiyat %20 arttı.", True),
    ("KD-B04", "Son gün 31.02.2026 oldu.", True),
    ("KD-B05", "Tören 16.45 biter.", True),
    ("KD-B05", "Tören saat 16.45 biter.", False),
    ("KD-B06", "Ali geldi; Veli gitti.", True),
    ("KD-B07", "LÜTFEN BURADA HİÇ BEKLEMEYİN arkadaşlar.", True),
    ("KD-B07", "Lütfen BURADA bekleyin.", False),
    ("KD-B08", 'Bu "özel" bir durum.', True),
    ("KD-M01", "Bir oldu. İki oldu. Üç oldu. Dört oldu. Beş oldu. Altı oldu.", True),
    ("KD-M02", "Ev güzel. " * 90, True),
    ("KD-M03", "Elma, armut, kiraz, üzüm ve incir aldık.", True),
    ("KD-M04", "Bir oldu. İki oldu. Üç oldu. Son gün 1.12.2026 olur.", True),
    ("KD-M05", "Ev güzel. " * 210, True),
]


@pytest.fixture(scope="module")
def audited(spark):
    docs = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(CASES)], "doc_id long, text string")
    audit = Audit(docs)
    return audit, {(r.doc_id, r.rule_id) for r in audit.findings.collect()}


def test_rule_cases(audited):
    wrong = [(r, t) for k, (r, t, fires) in enumerate(CASES) if ((k, r) in audited[1]) != fires]
    assert not wrong


def test_rare_words_need_a_vocabulary(spark):
    docs = spark.createDataFrame([(1, "Köyde bir pınar var. Pınarın suyu soğuk. Tefessüh yok.")], "doc_id long, text string")
    assert Audit(docs, only=["KD-K06"]).findings.count() == 0
    lexicon = {"sik_kelimeler": ["köy", "bir", "pınar", "var", "suyu", "soğuk", "yok"]}
    assert [r.text for r in Audit(docs, lexicon=lexicon, only=["KD-K06"]).findings.collect()] == ["Tefessüh"]


def test_phrases_take_endings(spark):
    lexicon = {"jargon": [{"ifade": "kitap"}, {"ifade": "yol tutmak"}, {"ifade": "ev", "ek": False}]}
    sents = segment.with_tokens(segment.sentences(spark.createDataFrame([(1, "Kitabımızı aldık. Kitapçı yol tutacakmış. Evler uzak, ev yakın. Yollar tuttu.")], "doc_id long, text string")))
    got = matching.matches(sents, matching.lexicon_entries(spark, lexicon)).collect()
    assert sorted((r.phrase, r.sent_no, r.first_tok, r.last_tok) for r in got) == [("ev", 2, 3, 3), ("kitap", 0, 0, 0), ("yol tutmak", 1, 1, 2)]


#: One notice in three manners, from an office's to a plain one.
NOTICES = [
    "Köyümüzün su deposunun bakımının yapılması amacıyla 12.10.2026 tarihinde 08.00-17.00 arasında su kesintisi uygulanacaktır; mağduriyet yaşanmaması için gerekli tedbirlerin alınması önemle rica olunur. Müracaatların ivedilikle yapılması gerekmektedir.",
    "Su deposu 12 Ekim 2026 Pazartesi günü temizlenecek. Su saat 08.00 ile 17.00 arasında kesilecek. Lütfen önceden su biriktirin.",
    "Köyün su deposunu temizliyoruz. Su 12 Ekim 2026 Pazartesi günü akacak. Önce su biriktirin. Soru için bizi arayın.",
]


def test_plainer_notices_score_higher(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = [r.score for r in Audit(docs).compliance.orderBy("doc_id").collect()]
    assert got[0] <= 40 < got[1] < got[2] and got[2] >= 85


def test_language_gate_leaves_turkish_words_alone(spark):
    docs = spark.createDataFrame([(1, "On kişi, on ev, on araba geldi.")], "doc_id long, text string")
    assert Audit(docs, only=["KD-C01"]).compliance.first().score is not None


def test_registry():
    assert sorted(rules.RULES) == sorted(RULE_IDS) and len(RULE_IDS) == 32


def test_scores_follow_findings(audited):
    audit = audited[0]
    got = {r.doc_id: r for r in audit.compliance.collect()}
    assert len(got) == len(CASES) and all(0 <= r.score <= 100 for r in got.values() if r.score is not None)
    clean = next(k for k, c in enumerate(CASES) if c[1] == "Bu cümle kısa.")
    assert got[clean].score == 100 and not got[clean].reliable
    by = {r.doc_id: 0 for r in got.values()}
    for r in audit.categories.collect():
        by[r.doc_id] += r.penalty
    assert all(abs(by[k] - got[k].penalty) < 1e-9 for k in by)
    sets = findings.penalties(audit.findings, audit.profile).collect()
    total = sum(r.penalty for r in sets if r.category is None and r.rule_id is None)
    assert abs(total - sum(r.penalty for r in sets if r.category is not None)) < 1e-6


def test_audit_of_odd_documents(spark):
    audit = Audit(spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200), (4, "Ev. " * 5)], "doc_id long, text string"), only=["KD-C01", "KD-M05"], most_characters=100)
    assert {r.doc_id: r.status for r in audit.status.collect()} == {1: "empty", 2: "empty", 3: "too long", 4: "ok"}
    assert {r.doc_id: r.score for r in audit.compliance.collect()} == {1: None, 2: None, 3: None, 4: 100}


def test_ignored_and_suppressed(spark):
    text = "Ali geldi; Veli gitti.\n\n<!-- berrak: ignore KD-B06 -->Can geldi; Cem gitti."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert Audit(docs, only=["KD-B06"]).findings.count() == 1
    ignored = spark.createDataFrame([("KD-B06", " ; ")], "rule_id string, text string")
    assert Audit(docs, only=["KD-B06"], ignored=ignored).findings.count() == 0


def test_longest_phrase_wins(spark):
    lexicon = {"jargon": ["a b", "a", {"ifade": "b c d"}, {"ifade": "e", "sabit": True}]}
    sents = segment.with_tokens(segment.sentences(spark.createDataFrame([(1, "a b c d a, b e a")], "doc_id long, text string")))
    got = matching.matches(sents, matching.lexicon_entries(spark, lexicon)).orderBy("first_tok").collect()
    assert [(r.phrase, r.first_tok, r.last_tok) for r in got] == [("a b", 0, 1), ("a", 4, 4), ("a", 8, 8)]


def test_formulas(spark):
    row = spark.createDataFrame([(1, 10, 2, 25, 1, 1, 0, 0)], "doc_id long, words long, sentences long, syllables long, h3 long, h4 long, h5 long, h6 long")
    r = readability.scores(row).first()
    assert abs(r.atesman - (198.825 - 40.175 * 2.5 - 2.610 * 5)) < 1e-9 and r.atesman_level == "kolay"
    assert abs(r.cetinkaya_uzun - (118.823 - 25.987 * 2.5 - 0.971 * 5)) < 1e-9
    assert abs(r.bezirci_yilmaz - (5 * (0.5 * 0.84 + 0.5 * 1.5)) ** 0.5) < 1e-9


def test_language_gate(spark):
    docs = spark.createDataFrame([(1, "The cat is in the house and on the mat."), (2, "Ali bugün okula gitti."), (3, "Кошка дома сегодня спит.")], "doc_id long, text string")
    got = readability.language_gate(segment.with_tokens(segment.sentences(docs))).collect()
    assert {r.doc_id: r.looks_turkish for r in got} == {1: False, 2: True, 3: False}


def test_facts(spark):
    text = "Son gün 15.09.2026, saat 10:30. 3 Mayıs 2025 ve 1.250,5 lira; www.x.com/a. 1999"
    df = spark.createDataFrame([(text, "Son gün 15 eylül 2026, saat 10.30. 7 lira")], "a string, b string")
    missing, added = facts.fact_diff(F.col("a"), F.col("b"))
    r = df.select(facts.facts(F.col("a")).alias("f"), missing.alias("m"), added.alias("n")).first()
    assert r.f == sorted(["adres:www.x.com/a", "saat:10.30", "sayı:1250.5", "tarih:05-03", "tarih:09-15", "yıl:1999", "yıl:2025", "yıl:2026"])
    assert r.n == ["sayı:7"] and "tarih:09-15" not in r.m and "sayı:1250.5" in r.m


def test_fixes_are_spliced(spark):
    df = spark.createDataFrame([("abcdef", [(4, 6, "Z"), (1, 3, "XY"), (2, 5, "no"), (5, 99, "far")])], "t string, f array<struct<start:int,end:int,text:string>>")
    taken = findings.applicable_fixes(F.col("f"), F.length("t"))
    assert df.select(findings.apply_fixes(F.col("t"), taken)).first()[0] == "aXYdZ"


def test_fixing_settles(spark):
    docs = spark.createDataFrame([(1, "Bölüm IV burada. Tören 16.45 biter.")], "doc_id long, text string")
    audit = Audit(docs, only=["KD-B02", "KD-B05"])
    rows = audit.findings.where("fix is not null").collect()
    text = docs.first().text
    for r in rows:
        text = text.replace(r.text, r.fix)
    assert len(rows) == 2 and Audit(spark.createDataFrame([(1, text)], "doc_id long, text string"), only=["KD-B02", "KD-B05"]).findings.count() == 0


def test_profiles(tmp_path):
    assert PROFILES["kolay-dil"].param("KD-C01", "warn_above", 0) == 10 and not PROFILES["sade-dil"].config("KD-K06").enabled
    own = tmp_path / "own.yaml"
    own.write_text("extends: sade-dil\nrules:\n  KD-C01: {params: {warn_above: 3}}\n  KD-B06: {severity: error, enabled: false}\n", encoding="utf-8")
    p = load_profile(own)
    assert p.param("KD-C01", "warn_above", 0) == 3 and p.param("KD-C01", "error_above", 0) == 22 and p.config("KD-B06").severity == "hata" and not p.config("KD-B06").enabled
    loop = tmp_path / "loop.yaml"
    loop.write_text("extends: loop.yaml\n")
    for bad in (loop, tmp_path / "none.yaml", {"rules": {"KD-X": {}}}, {"rules": {"KD-C01": {"severity": "grave"}}}):
        with pytest.raises(ConfigError):
            load_profile(bad)
    assert len(load_lexicon({"jargon": ["x"]})["jargon"]) == len(load_lexicon()["jargon"]) + 1
    with pytest.raises(ConfigError):
        load_lexicon({"nonsense": []})


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Işık".encode("cp1254"))
    (tmp_path / "b.md").write_bytes("﻿çay".encode())
    (tmp_path / "c.txt").write_bytes("su".encode("utf-16"))
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Bir</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="ListBullet"/></w:pPr><w:r><w:t>iki</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>üç</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "d.docx").write_bytes(data.getvalue())
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.xls").write_bytes(b"x")
    got = {r.path[-5:]: (r.text, r.error is None) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("Işık", True), "/b.md": ("çay", True), "c.txt": ("su", True), ".docx": got[".docx"], "f.xls": (None, False)}
    texts = [r.text for r in readers.read_files(spark, str(tmp_path)).collect() if r.path.endswith("d.docx")]
    assert texts == ["Bir\n\n- iki\n- üç\n\nx – y"]


def test_furniture(spark):
    rows = [(1, p, k, x) for p in range(4) for k, x in enumerate(["Kurum Başlığı", f"metin {'abcd'[p]}", *(f"satır {'abcd'[p]} {'klmnopqr'[j]}" for j in range(8)), f"Sayfa {p}"])]
    pages = spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string")
    left = {r.line for r in readers.without_furniture(pages).collect()}
    assert "Kurum Başlığı" not in left and not any(x.startswith("Sayfa") for x in left) and len(left) == 36


def test_reports(audited):
    audit = audited[0]
    got = {r.doc_id: r.report for r in sinks.reports(audit.findings, audit.compliance).collect()}
    assert len(got) == len(CASES) and '"rule_id":"KD-C01"' in got[0]
    text = {r.doc_id: r.report for r in sinks.markdown(audit.findings, audit.compliance).collect()}
    assert text[0].startswith("# Belge 0\n\nUyum skoru: ") and "**KD-C01**" in text[0]


def test_marked_text(spark):
    df = spark.createDataFrame([("abcdef", [(1, 4, 2, "u"), (2, 3, 0, "h")]), ("", [])], f"t string, s {sinks.SPANS}")
    assert [r[0] for r in df.select(sinks.marked_text(F.col("t"), F.col("s"))).collect()] == ["a[u|b][h|c][u|d]ef", ""]


def limited(times, limit, window):
    hits, out = deque(), []
    for t in times:
        while hits and hits[0] <= t - window:
            hits.popleft()
        out.append(len(hits) < limit)
        if out[-1]:
            hits.append(t)
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, r.randrange(3), r.randrange(200)) for k in range(150)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    got = {x.event_id: x.allowed for x in stream.rate_limit(events, "user_id", "ts", 3, 10.0).collect()}
    want = {}
    for u in range(3):
        own = sorted((s, k) for k, v, s in rows if v == u)
        want |= dict(zip([k for _, k in own], limited([s for s, _ in own], 3, 10.0), strict=True))
    assert got == want
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = stream.limited_stream(source, "user_id", "ts", 3, 10.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {x.event_id: x.allowed for x in spark.table("limited").collect()} == want


def test_audit_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(CASES[:8])], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    out = str(tmp_path / "out")
    query = stream.audit_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), lambda f, n: f.write.mode("append").parquet(out), str(tmp_path / "cp"), only=["KD-C01", "KD-C09", "KD-B06"])
    query.awaitTermination(180)
    key = lambda df: sorted((r.doc_id, r.rule_id, r.text) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(Audit(docs, only=["KD-C01", "KD-C09", "KD-B06"]).findings)


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_findings_know_their_place(spark):
    text = "Ali geldi; Veli de; geldi (bugün) yirmi beş kişi."
    rows = Audit(spark.createDataFrame([(1, text)], "doc_id long, text string"), only=["KD-B06", "KD-B01", "KD-C09"]).findings.collect()
    assert sorted((r.start, r.text) for r in rows) == [(9, ";"), (18, ";"), (26, "(bugün)"), (34, "yirmi beş")]
    assert all(text[r.start : r.start + len(r.text)] == r.text for r in rows)
