"""DuckDB SQL of the queries over Turkish documents and numerals, with forms and values of its own.

Where the library tells bent forms by endings, this side lists the forms that the sentences hold.
"""

from __future__ import annotations

from berrak.plans.oracle import _TOKEN, TOKENS, _list, _text
from berrak.plans.turkish_view import SENTENCES, SHARE

_DOCS = f"""(SELECT doc_id, array_to_string([CASE WHEN k = 0 THEN '' WHEN k % 5 = 0 THEN chr(10) || chr(10) ELSE ' ' END || s[(doc_id * 31 + n + k * 7) % {len(SENTENCES)} + 1] FOR k IN range(0, n // {SHARE} + 1)], '') AS text
  FROM (SELECT doc_id, length(coalesce(text, '')) AS n, {_list(SENTENCES)} AS s FROM documents))"""
_KEY = "doc_id, para_idx, sent_no"
_LOW = "lower(translate(token, 'Iİ', 'ıi'))"
#: The tokens of the Turkish documents with where they start, and the number words of a run.
_AT = f"""{TOKENS.replace("FROM documents", "FROM " + _DOCS)},
cut AS (SELECT {_KEY}, is_heading, unnest(p) AS token, generate_subscripts(p, 1) AS k FROM (SELECT {_KEY}, is_heading, regexp_extract_all(text, {_text(_TOKEN)}) AS p FROM sents)),
put AS (SELECT *, CAST(sum(length(token)) OVER (PARTITION BY {_KEY} ORDER BY k) - length(token) AS INT) AS start FROM cut),
placed AS (SELECT *, {_LOW} AS low, string_split({_LOW}, '''')[1] AS base, CAST(row_number() OVER (PARTITION BY {_KEY} ORDER BY k) - 1 AS INT) AS i FROM put WHERE NOT regexp_matches(token, '^\\s'))"""

_ONES = ["bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"]
_TENS = ["on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"]
_SCALES = {"milyar": 1_000_000_000, "milyon": 1_000_000, "bin": 1_000}
_ONE, _TEN = f"(?:{'|'.join(_ONES)}) ", f"(?:{'|'.join(_TENS)}) "
#: A group that isn't empty, by its first word.
_SOME = f"(?:(?:{_ONE})?yüz (?:{_TEN})?(?:{_ONE})?|{_TEN}(?:{_ONE})?|{_ONE})"
_NUMERAL = f"(?:{_SOME}milyar )?(?:{_SOME}milyon )?(?:(?:{_SOME})?bin )?(?:{_SOME})?"
#: The endings of a number by the last word of its reading.
_ENDINGS = {"sıfır": "ı", "bir": "i", "iki": "si", "üç": "ü", "dört": "ü", "beş": "i", "altı": "sı", "yedi": "si", "sekiz": "i", "dokuz": "u", "on": "u", "yirmi": "si", "otuz": "u", "kırk": "ı", "elli": "si", "altmış": "ı", "yetmiş": "i", "seksen": "i", "doksan": "ı", "yüz": "ü", "bin": "i", "milyon": "u", "milyar": "ı"}


def _below(g: str) -> str:
    """The value of a group below 1000, given as words with a space after each."""
    word = lambda w: f"(coalesce(list_position({_list(_ONES)}, {w}), 0) + 10 * coalesce(list_position({_list(_TENS)}, {w}), 0))"
    before = f"regexp_extract({g}, '([^ ]+) yüz ', 1)"
    rest = f"regexp_replace({g}, '^.*yüz ', '')"
    return f"(CASE WHEN contains({g}, 'yüz ') THEN 100 * greatest(1, {word(before)}) ELSE 0 END + coalesce(list_sum([{word('w')} FOR w IN string_split({rest}, ' ')]), 0))"


def _value(s: str) -> str:
    parts, rest = [], s
    for scale, worth in _SCALES.items():
        parts.append(f"CASE WHEN contains({s}, '{scale} ') THEN {worth} * greatest(1, {_below(f'regexp_extract({rest}, {_text(f"^(.*){scale} ")}, 1)')}) ELSE 0 END")
        rest = f"regexp_replace({rest}, '^.*{scale} ', '')"
    return " + ".join([*parts, _below(rest)])


def _spelled(n: str) -> str:
    """A number in words, with a space after each."""
    out = []
    for scale, worth in [*_SCALES.items(), ("", 1)]:
        g = f"({n} // {worth} % 1000)"
        out.append(f"CASE WHEN {g} >= 200 THEN {_list(_ONES)}[{g} // 100] || ' ' ELSE '' END || CASE WHEN {g} >= 100 THEN 'yüz ' ELSE '' END || CASE WHEN {g} // 10 % 10 > 0 THEN {_list(_TENS)}[{g} // 10 % 10] || ' ' ELSE '' END")
        out.append(f"CASE WHEN {g} % 10 > 0 {'AND ' + g + ' <> 1' if scale == 'bin' else ''} THEN {_list(_ONES)}[{g} % 10] || ' ' ELSE '' END" + (f" || CASE WHEN {g} > 0 THEN '{scale} ' ELSE '' END" if scale else ""))
    return f"CASE WHEN {n} = 0 THEN 'sıfır ' ELSE {' || '.join(out)} END"


def _forms(forms: list[str]) -> str:
    return f"({', '.join(map(_text, forms))})"


_PEOPLE, _MONEY = ["kadınların", "çocukların", "öğrencilerin", "nüfusun", "kişi"], ["fiyatlar", "kiralar", "ücretinden", "indirim", "faizler", "lira"]
_TIME = "(?:[01]?[0-9]|2[0-3])[:.][0-5][0-9]"
#: list, phrase, the forms that the sentences have.
_BENT = [("jargon", "tebliğ", ["tebliğ", "tebliği", "tebliğin"]), ("jargon", "kitap", ["kitap", "kitabı", "kitabın"]), ("jargon", "ocak", ["ocak", "ocağa", "ocakta"]), ("yabanci", "link", ["linkleri", "linke"]), ("yabanci", "websitesi", ["websitesini"])]

ORACLE = {
    "numerals": f"""WITH a AS (SELECT o_orderkey, CAST(o_orderkey * 7919 + coalesce(floor(o_totalprice), 0) * 1000 AS BIGINT) AS n FROM orders), b AS (SELECT *, {_spelled("n")} AS s FROM a),
      c AS (SELECT *, list_reverse(string_split(trim(s), ' ')) AS w FROM b), e AS (SELECT MAP {{{', '.join(f"'{w}': '{x}'" for w, x in _ENDINGS.items())}}} AS endings)
      SELECT o_orderkey, n, trim(s) AS words, n AS back, true AS is_one, regexp_full_match(array_to_string(w, ' ') || ' ', '{_NUMERAL}') AS reversed_is_one, n || '''' || endings[w[1]] AS possessive FROM c, e""",
    "aside_words": f"""WITH {_AT},
      s AS (SELECT *, sum(CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS s, count(*) FILTER (WHERE token = '"') OVER w AS q FROM placed WINDOW w AS (PARTITION BY {_KEY} ORDER BY i)),
      d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY {_KEY} ORDER BY i)) AS depth, max(q) OVER (PARTITION BY {_KEY}) AS quotes, regexp_matches(token, '^\\p{{L}}') AS word FROM s),
      h AS (SELECT *, count(*) FILTER (WHERE word) OVER (PARTITION BY {_KEY}, q) AS held, count(*) FILTER (WHERE word) OVER (PARTITION BY {_KEY}) AS words FROM d)
      SELECT {_KEY}, CAST(max(depth) AS INT) AS deepest, CAST(count(*) FILTER (WHERE word AND depth > 0) AS INT) AS n_bracketed, CAST(count(*) FILTER (WHERE word AND q % 2 = 1 AND q < quotes AND held < words) AS INT) AS n_quoted FROM h GROUP BY {_KEY}""",
    "number_words_b01": f"""WITH {_AT}, w AS (SELECT *, i - row_number() OVER (PARTITION BY {_KEY} ORDER BY i) AS island FROM placed WHERE NOT is_heading AND low IN {_forms([*_ONES, *_TENS, "yüz", *_SCALES])}),
      r AS (SELECT {_KEY}, min(start) AS start, string_agg(token, ' ' ORDER BY i) AS text, string_agg(low || ' ', '' ORDER BY i) AS s, count(*) AS n FROM w GROUP BY {_KEY}, island),
      v AS (SELECT *, CAST({_value("s")} AS BIGINT) AS v FROM r WHERE regexp_full_match(s, '{_NUMERAL}')),
      f AS (SELECT *, regexp_replace(format('{{:,}}', v), ',', '.', 'g') AS digits FROM v WHERE v >= 10 AND (n > 1 OR trim(s) IN {_forms([*_TENS, "milyon", "milyar"])}))
      SELECT {_KEY}, start, text, digits AS suggestion, CASE WHEN trim(s) IN ('milyon', 'milyar') THEN '' ELSE digits END AS fix, 'uyarı' AS severity FROM f""",
    "percentages_b03": f"""WITH {_AT}, l AS (SELECT *, lead(token) OVER (PARTITION BY {_KEY} ORDER BY i) AS next FROM placed WHERE NOT is_heading),
      p AS (SELECT *, CASE WHEN base = 'yüzde' THEN token || ' ' || next ELSE token END AS text, CASE WHEN base = 'yüzde' THEN next WHEN contains(token, '/') THEN '' ELSE regexp_replace(base, '[% ]', '', 'g') END AS n FROM l
        WHERE contains(token, '%') OR (base = 'yüzde' AND regexp_matches(next, '^[0-9]')) OR regexp_full_match(token, '[1-9]/(?:[2-9]|10)')),
      c AS (SELECT {_KEY}, i AS j, CASE WHEN low IN {_forms(_PEOPLE)} THEN 'people' ELSE 'money' END AS cue FROM placed WHERE low IN {_forms(_PEOPLE + _MONEY)}),
      m AS (SELECT p.doc_id, p.para_idx, p.sent_no, p.start, p.text, p.n, min_by(c.cue, abs(c.j - p.i) * 1000000 + c.j) AS cue FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.para_idx = c.para_idx AND p.sent_no = c.sent_no AND c.j <> p.i GROUP BY ALL)
      SELECT {_KEY}, start, text, CASE WHEN NOT regexp_full_match(n, '[0-9]+') OR cue IS NULL THEN '' WHEN cue = 'people' THEN 'her 100 kişiden ' || n || CASE n WHEN '35' THEN '''i' WHEN '8' THEN '''i' END ELSE 'her 100 liranın ' || n || ' lirası' END AS suggestion, '' AS fix, 'bilgi' AS severity FROM m""",
    "times_b05": f"""WITH {_AT}, t AS (SELECT *, coalesce(bool_or(starts_with(low, 'saat')) OVER (PARTITION BY {_KEY} ORDER BY i ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING), false) AS told, lead(base) OVER (PARTITION BY {_KEY} ORDER BY i) AS next FROM placed WHERE NOT is_heading)
      SELECT {_KEY}, start, token AS text, 'saat ' || replace(base, ':', '.') AS suggestion, 'saat ' || replace(base, ':', '.') AS fix, 'uyarı' AS severity FROM t WHERE regexp_full_match(base, '{_TIME}(?:-{_TIME})?') AND NOT told AND coalesce(next, '') NOT IN ('lira', 'saat', 'gün', 'yıl')""",
    "bent_phrases": f"""WITH {_AT}, f(list, phrase, form) AS (VALUES {', '.join(f"('{a}', '{b}', '{w}')" for a, b, forms in _BENT for w in forms)})
      SELECT {_KEY}, list, phrase, token AS said, start, i AS first_tok, i AS last_tok FROM placed JOIN f ON low = form
      UNION ALL SELECT {_KEY}, 'jargon', 'arz etmek', token || ' ' || next, start, i, i + 1 FROM (SELECT *, lead(token) OVER (PARTITION BY {_KEY} ORDER BY i) AS next FROM placed) WHERE low = 'arz' AND next = 'ettiler'""",
}
