"""The audit's registered queries against brute force."""

import json
import math

from berrak.operators import readability, segment
from berrak.plans import queries
from berrak.plans.queries import QUERIES
from tests.base.test_audit import CASES


def test_audit_queries_cover_all_rules(spark, tmp_path, monkeypatch):
    """The registered queries against brute force over the findings of all rules."""
    texts = [". ".join(t.rstrip(".") for _, t, _ in CASES[k : k + 6]) + "." for k in range(0, len(CASES) - 6, 6)]
    texts += ["Ali geldi; Veli (dün) gitti. Oraya yirmi beş kişi geldi. Önce SGK binasına gidin.", "The cat is in the house and on the mat; it sat.", "", "Bu cümle kısa."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    audit = queries._audit(spark, str(tmp_path))
    assert audit.only is None and audit.lexicon == queries.LEXICON
    monkeypatch.setattr(queries, "_audit", lambda *_: audit)  # one audit for all five queries
    found = QUERIES["audit_findings"](spark, str(tmp_path)).collect()
    assert {r.rule_id for r in found} >= {"KD-C03", "KD-K01", "KD-K03", "KD-K07", "KD-B01", "KD-B02", "KD-B05"}
    sents = segment.sentences(docs).collect()
    weight = {"hata": 3.0, "uyarı": 1.0, "bilgi": 0.25}

    def brute(doc, category=None):
        own = [r for r in found if r.doc_id == doc and category in (None, r.category)]
        penalty, n = sum(weight[r.severity] * r.confidence for r in own), sum(s.doc_id == doc and not s.is_heading for s in sents)
        return n, round(penalty, 4), len(own), round(100 * math.exp(-0.6 * penalty / n)) if n else -1

    turkish = {r.doc_id: r.looks_turkish for r in readability.language_gate(segment.with_tokens(segment.sentences(docs))).collect()}
    got = {r.doc_id: r for r in QUERIES["compliance_all_rules"](spark, str(tmp_path)).collect()}
    for doc in range(len(texts)):
        n, penalty, count, score = brute(doc)
        r = got[doc]
        assert (r.sentence_count, r.finding_count, r.score) == (n, count, score if turkish.get(doc, True) else -1) and abs(r.penalty - penalty) < 1e-3
    assert [got[k].score for k in range(len(texts) - 3, len(texts))] == [-1, -1, 100]

    rows = QUERIES["category_scores"](spark, str(tmp_path)).collect()
    assert len(rows) == 4 * len(texts)
    for r in rows:
        n, penalty, count, score = brute(r.doc_id, r.category)
        assert (r.sentence_count, r.finding_count, -1 if r.score is None else r.score) == (n, count, score) and abs(r.penalty - penalty) < 1e-3
    assert any(r.category == "kelime" and r.finding_count for r in rows)

    reports = {r.doc_id: json.loads(r.report) for r in QUERIES["audit_reports"](spark, str(tmp_path)).collect()}
    assert {k: len(v["findings"]) for k, v in reports.items()} == {k: brute(k)[2] for k in range(len(texts))}
    assert all(v.get("score", -1) == got[k].score for k, v in reports.items())

    fixed = {(r.doc_id, r.para_idx, r.sent_no): (r.n_fixes, r.fixed) for r in QUERIES["fixed_text"](spark, str(tmp_path)).collect()}
    want = {}
    for s in sents:
        key, free, taken = (s.doc_id, s.para_idx, s.sent_no), 0, []
        for a, b, x in sorted((r.start, r.start + len(r.text), r.fix) for r in found if r.fix is not None and (r.doc_id, r.para_idx, r.sent_no) == key):
            if a >= free and b <= len(s.text):
                taken, free = [*taken, (a, b, x)], b
        text = s.text
        for a, b, x in reversed(taken):
            text = text[:a] + x + text[b:]
        want[key] = (len(taken), text)
    assert fixed == want
    assert (1, "Oraya 25 kişi geldi.") in fixed.values() and (1, "Önce Sosyal Güvenlik Kurumu (SGK) binasına gidin.") in fixed.values() and (0, "Bu cümle kısa.") in fixed.values()
