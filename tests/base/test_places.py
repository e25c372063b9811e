"""Where findings begin that a sentence has several times."""

import re

import pytest

from berrak.operators import rules
from berrak.plans.auditor import Audit


@pytest.mark.parametrize("rule, text, hit", [
    ("KD-C09", "Su (temiz olanı) ve süt (temiz olanı) ve çay (sıcak) gelir.", "(temiz olanı)"),
    ("KD-B08", 'Bu "özel" ve şu "özel" bir durum, "özel" kaldı.', '"özel"'),
])
def test_equal_hits_are_found_each(spark, rule, text, hit):
    found = Audit(spark.createDataFrame([(1, text)], "doc_id long, text string"), only=[rule]).findings.collect()
    assert sorted(r.start for r in found if r.text == hit) == [m.start() for m in re.finditer(re.escape(hit), text)]


def test_spans_against_brute_force(spark):
    texts = ['"a" x "b"a"b" "a"', "(a) ((a) (a)) (b(a)", '"" "x" ""x""', "yok", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for pattern in ('"[^"\n]{1,60}"', r"\([^()]*[a-z][^()]*\)"):
        got = sorted((r.k, r.at, r.hit) for r in rules.spans(rows, pattern).collect())
        assert got == [(k, m.start(), m.group()) for k, t in enumerate(texts) for m in re.finditer(pattern, t)]
