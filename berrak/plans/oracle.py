"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from berrak.functions import numbers, turkish
from berrak.operators import morphology, names, readability, segment
from berrak.plans.queries import LEXICON


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list) -> str:
    return "[" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in values) + "]"


def _norm(text: str) -> str:
    out = rf"regexp_replace({text}, '\r\n?', chr(10), 'g')"
    for found, to in ((turkish.DOUBLE_QUOTES, '"'), (turkish.SINGLE_QUOTES, "'"), (turkish.DASHES, "-"), (turkish.SPACES, " ")):
        out = f"translate({out}, {_text(found)}, {_text(to * len(found))})"
    return f"regexp_replace(translate({out}, {_text(turkish.REMOVED)}, ''), ' {{2,}}', ' ', 'g')"


def _blank(pattern: str, less: int = 0) -> str:
    """Of a text t: what stands between matches, and spaces of the matches' lengths."""
    p = _text(pattern)
    gaps, hits = f"string_split_regex(t, {p})", f"regexp_extract_all(t, {p})"
    return f"CASE WHEN regexp_matches(t, {p}) THEN list_reduce(list_transform(list_zip({gaps}, {hits}), lambda z: z[1] || repeat(' ', CAST(greatest(coalesce(length(z[2]), 0) - {less}, 0) AS BIGINT))), lambda a, b: a || b) ELSE t END"


def _mask(text: str) -> str:
    """Comments, then what is left of links once their labels are kept, then tags. Two signs mark what of a link goes."""
    open_, close = chr(0xE002), chr(0xE003)
    link = r"([!]?\[)([^\[\]]*)(\]\((?:[^()\s]|\([^()\s]*\))*\))"
    marked = f"regexp_replace(t, {_text(link)}, '{open_}\\1{close}\\2{open_}\\3{close}', 'g')"
    tag = r"<(?:/[A-Za-z][A-Za-z0-9-]*\s*|[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?)/?>"
    for step in (_blank("(?s)<!--.*?-->"), marked, _blank(f"{open_}[^{close}]*{close}", 2), _blank(tag)):
        text = f"list_transform([{text}], lambda t: {step})[1]"
    return text


#: What opens a list item, and the forms of tokens, as this side states them.
_ITEM = r"(?:[*•‣◦▪·●○■+-]|[0-9][0-9]?[0-9]?[.)]|\p{Ll}[)])[ ]+"
_DIGITS = "[0-9]+(?:[.,:/-][0-9]+)*"
_ENDING = r"(?:'\p{L}+)?"
_NET = r"""(?:https?://|www\.)[^\s<>"']*[^\s<>"'.,;:!?)\]}]"""
_MAIL = r"[\p{L}0-9][\p{L}0-9._+-]*@(?:[\p{L}0-9-]+\.)+[\p{L}0-9]+"
_TOKEN = "|".join([
    _NET, _MAIL, rf"%[ ]?[0-9]+(?:[.,][0-9]+)?{_ENDING}", r"[0-9]+(?:[.,][0-9]+)?[ ]?%", _DIGITS + _ENDING, rf"(?:\p{{Lu}}\.){{2,}}{_ENDING}", r"\p{L}+(?:[-']\p{L}+)*", r"\s+", r"\S",
])


def _lines_cut(marked: str) -> str:
    """Line ends that end sentences, as this side states when they do."""
    cut = segment.CUT
    opens, item = (lambda x: f"regexp_matches({x}, {_text('^[' + chr(34) + chr(39) + '([]*[' + chr(92) + 'p{Lu}0-9]')})"), (lambda x: f"regexp_matches({x}, '^{_ITEM}')")
    ends, waits = (lambda x: f"regexp_matches({x}, {_text('[.!?…][])' + chr(34) + chr(39) + ']*$')})"), (lambda x: f"right({x}, 1) IN (',', ';', ':')")
    n_words = lambda x: f"len(string_split_regex({x}, ' +'))"
    low = lambda x: f"lower(translate({x}, 'Iİ', 'ıi'))"
    joins = lambda x: f"(right({x}, 1) = '-' OR {low(f'string_split({x}, {_text(chr(32))})[-1]')} IN ('ve', 'veya', 'ya', 'ile', 'ama', 'fakat', 'ancak', 'çünkü', 'için', 'gibi', 'kadar', 'ki', 'hem', 'bu', 'şu', 'o', 'bir', 'en', 'çok', 'daha', 'olan', 'olarak', 'göre', 'her', 'ise'))"
    n = lambda condition: f"len([1 FOR i IN range(1, len(b) + 1) IF {condition}])"
    at, after = "b[i]", "b[i + 1]"
    loose = f"NOT {item(at)} AND (NOT {opens(at)} OR {waits(at)} OR {joins(at)} OR {n_words(at)} > 15)"
    single = f"len(b) > 1 AND {n(loose)} = 0 AND {n(f'i < len(b) AND NOT {item(at)} AND NOT {ends(at)}')} > 0"
    open_ = f"NOT {ends(at)} AND NOT {waits(at)} AND NOT {item(at)}"
    plain = n(f"{open_} AND NOT ({opens(at)} AND {n_words(at)} <= 12)")
    wrapped = n(f"{open_} AND i < len(b) AND NOT {opens(after)} AND NOT {item(after)}")
    pasted = f"len(b) > 2 AND {n(ends(at))} > 1 AND {plain} * 2 <= {n(ends(at))} AND {wrapped} = 0"
    known = low("regexp_extract(b[1], '^\\p{Lu}\\p{L}*')") + " IN ('sayın', 'değerli', 'sevgili', 'saygıdeğer', 'merhaba', 'selam')"
    named = f"{n_words('b[1]')} <= 3 AND regexp_full_match(b[1], '\\p{{Lu}}[^ ]*(?: \\p{{Lu}}[^ ]*)*')"
    address = f"len(b) > 1 AND right(b[1], 1) = ',' AND (({named}) OR ({n_words('b[1]')} <= 5 AND {known})) AND {opens('b[2]')}"
    told = f"list_transform([[y FOR y IN [trim(replace(x, '{cut}', '')) FOR x IN string_split(t, chr(10))] IF regexp_matches(y, '[\\p{{L}}\\p{{Nd}}]')]], lambda b: {{'every': ({single}) OR ({pasted}), 'first': {address}}})[1]"
    mark = f"CASE WHEN i < len(l) AND NOT ends_with(l[i], '{cut}') AND ((told.every AND NOT regexp_matches(l[i], '[,;:] *$')) OR (told.first AND i = 1)) THEN l[i] || '{cut}' ELSE l[i] END"
    joined = f"list_transform([{told}], lambda told: list_transform([string_split(t, chr(10))], lambda l: array_to_string([{mark} FOR i IN range(1, len(l) + 1)], chr(10)))[1])[1]"
    return f"list_transform([{marked}], lambda t: CASE WHEN contains(t, chr(10)) THEN {joined} ELSE t END)[1]"


def _marked(text: str) -> str:
    stop, cut = segment.STOP, segment.CUT
    out = rf"regexp_replace({text}, '(^|[^\p{{L}}])({'|'.join(segment.ABBREVIATIONS)})\.', '\1\2{stop}', 'g')"
    out = rf"regexp_replace({out}, '(^|[^\p{{L}}])(\p{{Lu}}|[IVX]{{2,5}})\.', '\1\2{stop}', 'g')"
    nouns = "|".join(f"[{n[0]}{n[0].upper()}]{n[1:]}" for n in segment.ORDINAL_NOUNS)
    out = rf"regexp_replace({out}, '([0-9])\.(\s+(?:{nouns}))', '\1{stop}\2', 'g')"
    out = rf"""regexp_replace({out}, {_text('([.!?…]+["' + chr(39) + r')\]]*)(\s+)(["' + chr(39) + r'(\[]*[\p{Lu}0-9])')}, '\1{cut}\2\3', 'g')"""
    return _lines_cut(rf"regexp_replace({out}, '(\n[ ]*{_ITEM})', '{cut}\1', 'g')")


def _upper(text: str) -> str:
    return f"({text} = upper(translate({text}, 'iı', 'İI')) AND {text} <> lower(translate({text}, 'Iİ', 'ıi')))"


def _vowels(text: str) -> str:
    return f"length(regexp_replace(lower(translate({text}, 'Iİ', 'ıi')), '[^{turkish.VOWELS}]', '', 'g'))"


def _spelled(text: str) -> str:
    low = f"lower(translate({text}, 'Iİ', 'ıi'))"
    return rf"(length(regexp_replace({low}, '[^\p{{L}}]', '', 'g')) + 2 * length(regexp_replace({low}, '[^ğ]', '', 'g')) + length(regexp_replace({low}, '[^w]', '', 'g')))"


def _digits(x: str) -> str:
    two = "".join(str(d) for d, n in enumerate(numbers.DIGITS) if n == 2)
    return f"(length({x}) + length(regexp_replace({x}, '[^{two}]', '', 'g')))"


def _integer(x: str) -> str:
    digit = lambda k: f"CAST(substr(lpad({x}, 18, '0'), 3 * i + {k}, 1) AS INT)"
    h, t, o = digit(1), digit(2), digit(3)
    ones, tens, powers = _list(numbers.ONES), _list(numbers.TENS), _list(numbers.POWERS[::-1])
    below = f"CASE WHEN {h} > 0 THEN 1 ELSE 0 END + CASE WHEN {h} > 1 THEN {ones}[{h} + 1] ELSE 0 END + {tens}[{t} + 1] + CASE WHEN i = 4 AND {h} = 0 AND {t} = 0 AND {o} = 1 THEN 0 ELSE {ones}[{o} + 1] END"
    return f"CASE WHEN length({x}) > 18 THEN {_digits(x)} WHEN regexp_matches({x}, '^0*$') THEN 2 ELSE list_sum([CASE WHEN {h} + {t} + {o} = 0 THEN 0 ELSE {below} + {powers}[i + 1] END FOR i IN range(0, 6)]) END"


def _number(x: str) -> str:
    whole = f"replace(string_split({x}, ',')[1], '.', '')"
    fraction = f"regexp_replace(string_split({x}, ',')[-1], '[^0-9]', '', 'g')"
    parts = f"coalesce(list_sum([{_integer('p')} FOR p IN string_split({x}, '.') IF p <> '']), 0)"
    return f"CASE WHEN contains({x}, ',') THEN {_integer(whole)} + 2 + {_digits(fraction)} WHEN regexp_matches({x}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+$') THEN {_integer(f'replace({x}, {_text(chr(46))}, {_text(str())})')} ELSE {parts} END"


def _date(x: str) -> str:
    p = f"string_split_regex({x}, '[./-]')"
    first = f"length({p}[1]) = 4"
    day, month = f"CAST(CAST(CASE WHEN {first} THEN {p}[3] ELSE {p}[1] END AS INT) AS VARCHAR)", f"CAST({p}[2] AS INT)"
    year = f"CAST(CASE WHEN {first} THEN {p}[1] ELSE {p}[3] END AS INT)"
    year = f"CAST(CASE WHEN {year} < 100 THEN {year} + 2000 ELSE {year} END AS VARCHAR)"
    months = _list([sum(c in "aeıioöuü" for c in m) for m in turkish.MONTHS])
    return f"{_integer(day)} + CASE WHEN {month} BETWEEN 1 AND 12 THEN {months}[{month}] ELSE {_integer(f'CAST({month} AS VARCHAR)')} END + {_integer(year)}"


def _suffix(x: str) -> str:
    return f"CASE WHEN contains({x}, '''') THEN {_vowels(f'substr({x}, instr({x}, {_text(chr(39))}) + 1)')} ELSE 0 END"


SENTENCES = rf"""
norm AS (SELECT doc_id, {_norm("coalesce(text, '')")} AS norm FROM documents),
paras AS (
  SELECT doc_id, generate_subscripts(p, 1) - 1 AS para_idx, unnest(p) AS raw FROM (SELECT doc_id, string_split_regex(norm, '\n[ ]*(?:\n[ ]*)+') AS p FROM norm)
), paragraphs AS (SELECT doc_id, CAST(para_idx AS INT) AS para_idx, {_mask("raw")} AS text FROM paras WHERE regexp_matches(raw, '[\p{{L}}\p{{Nd}}]')),
pieces AS (
  SELECT doc_id, para_idx, contains(text, chr(10)) AS many, generate_subscripts(p, 1) - 1 AS sent_no, unnest(p) AS piece
  FROM (SELECT doc_id, para_idx, text, string_split({_marked("text")}, '{segment.CUT}') AS p FROM paragraphs)
), plain AS (
  SELECT doc_id, para_idx, many, CAST(sent_no AS INT) AS sent_no, regexp_replace(replace(piece, '{segment.STOP}', '.'), '^\s+|\s+$', '', 'g') AS text FROM pieces
), kinds AS (SELECT *, regexp_matches(text, '^{_ITEM}') AS is_list_item FROM plain WHERE regexp_matches(text, '[\p{{L}}\p{{Nd}}]')),
sents AS (
  SELECT doc_id, para_idx, sent_no, text, is_list_item,
    sent_no = 0 AND NOT many AND NOT is_list_item AND len(string_split_regex(text, '\s+')) <= 12 AND length(text) <= 100
    AND regexp_matches(text, {_text('^["' + chr(39) + r'(]*\p{Lu}')}) AND NOT regexp_matches(text, {_text('[.!?…:;,]["' + chr(39) + r')\]]*$')}) AND NOT regexp_matches(text, '@|://') AS is_heading
  FROM kinds
)"""

TOKENS = rf"""{SENTENCES},
found AS (SELECT doc_id, para_idx, sent_no, is_heading, is_list_item, [x FOR x IN regexp_extract_all(text, {_text(_TOKEN)}) IF NOT regexp_matches(x, '^\s')] AS t FROM sents),
loud AS (
  SELECT *, len([x FOR x IN t IF regexp_matches(x, '^\p{{L}}') AND {_upper("x")}]) >= greatest(3, CAST(floor(len([x FOR x IN t IF regexp_matches(x, '^\p{{L}}')]) * 0.6 + 0.5) AS INT)) AS shouting FROM found
), raw AS (SELECT doc_id, para_idx, sent_no, is_heading, is_list_item, shouting, CAST(generate_subscripts(t, 1) - 1 AS INT) AS tok_idx, unnest(t) AS token FROM loud),
based AS (SELECT *, string_split(token, '''')[1] AS base FROM raw),
kinded AS (
  SELECT *, CASE WHEN regexp_matches(token, '^(?:https?://|www\.)') THEN 'url' WHEN regexp_matches(token, '.@.') THEN 'email' WHEN regexp_matches(token, '%[^\s]|[0-9]\s?%|%\s[0-9]') THEN 'percent'
    WHEN regexp_matches(base, '{segment.DATE}') THEN 'date' WHEN regexp_matches(base, '{segment.TIME}') THEN 'time' WHEN regexp_matches(token, '^[0-9]') THEN 'number' WHEN regexp_matches(token, '^\p{{L}}') THEN 'word'
    WHEN regexp_matches(token, {_text('^[.,;:!?…"' + chr(39) + r'()\[\]{}/-]$')}) THEN 'punct' ELSE 'symbol' END AS kind FROM based
), toks AS (
  SELECT *, kind = 'word' AND (contains(base, '.') OR ({_upper("base")} AND length(regexp_replace(base, '[^\p{{L}}]', '', 'g')) BETWEEN 2 AND 6 AND NOT shouting)) AS is_abbreviation, lower(translate(token, 'Iİ', 'ıi')) AS low FROM kinded
), read AS (
  SELECT *, CASE kind WHEN 'number' THEN {_number("regexp_replace(base, '[/:-]', '.', 'g')")} + {_suffix("token")}
    WHEN 'date' THEN {_date("base")} + {_suffix("token")}
    WHEN 'time' THEN {_integer("string_split_regex(base, '[.:]')[1]")} + CASE WHEN CAST(string_split_regex(base, '[.:]')[2] AS INT) = 0 THEN 0 ELSE {_integer("string_split_regex(base, '[.:]')[2]")} END + {_suffix("token")}
    WHEN 'percent' THEN {_number(r"regexp_replace(regexp_replace(base, '[%\s]', '', 'g'), '[/:-]', '.', 'g')")} + 2 + {_suffix("token")}
    WHEN 'url' THEN greatest(1, {_vowels("base")}) WHEN 'email' THEN greatest(1, {_vowels("base")})
    ELSE CASE WHEN is_abbreviation THEN {_spelled("base")} + {_suffix("token")} WHEN kind = 'word' AND {_vowels("token")} = 0 THEN {_spelled("token")} ELSE {_vowels("token")} END END AS syllables FROM toks
)"""

COUNTS = f"""{TOKENS},
used AS (SELECT *, greatest(1, syllables) AS syl FROM read WHERE NOT is_heading AND kind IN ('word', 'number', 'date', 'time', 'percent')),
counted AS (
  SELECT doc_id, count(*) AS words, count(DISTINCT para_idx * 1000000 + sent_no) AS sentences, CAST(sum(syl) AS BIGINT) AS syllables,
    count(*) FILTER (WHERE syl = 3) AS h3, count(*) FILTER (WHERE syl = 4) AS h4, count(*) FILTER (WHERE syl = 5) AS h5, count(*) FILTER (WHERE syl >= 6) AS h6 FROM used GROUP BY doc_id
)"""

_ATESMAN = "least(100.0::DOUBLE, greatest(0.0::DOUBLE, 198.825::DOUBLE - 40.175::DOUBLE * (syllables / words) - 2.61::DOUBLE * (words / sentences)))"
_UZUN = "(118.823::DOUBLE - 25.987::DOUBLE * (syllables / words) - 0.971::DOUBLE * (words / sentences))"
_YILMAZ = "sqrt((words / sentences) * (0.84::DOUBLE * (h3 / sentences) + 1.5::DOUBLE * (h4 / sentences) + 3.5::DOUBLE * (h5 / sentences) + 26.25::DOUBLE * (h6 / sentences)))"

_FINDING = "doc_id, para_idx, sent_no, md5({text}) AS text_md5, {severity} AS severity"


_WORDS = f"{TOKENS}, per AS (SELECT doc_id, para_idx, sent_no, count(*) AS n FROM toks WHERE NOT is_heading AND kind IN ('word', 'number', 'date', 'time', 'percent', 'url', 'email') GROUP BY ALL)"
_C01 = "SELECT s.doc_id, s.para_idx, s.sent_no, md5(s.text) AS text_md5, CASE WHEN n > 15 THEN 'hata' ELSE 'uyarı' END AS severity FROM per p JOIN sents s USING (doc_id, para_idx, sent_no) WHERE n > 10"
_DOC = "docw AS (SELECT doc_id, count(*) AS n, bool_or(is_heading) AS headed FROM toks WHERE kind IN ('word', 'number', 'date', 'time', 'percent', 'url', 'email') GROUP BY doc_id)"
_WHOLE = "SELECT doc_id, -1 AS para_idx, -1 AS sent_no, md5('') AS text_md5, 'bilgi' AS severity FROM docw"
_ROMAN = numbers.ROMAN_PATTERN


def _spans(pattern: str, more: str, severity: str) -> str:
    return f"WITH {SENTENCES}, h AS (SELECT doc_id, para_idx, sent_no, text, unnest(regexp_extract_all(text, {_text(pattern)})) AS hit FROM sents WHERE NOT is_heading) SELECT {_FINDING.format(text='hit', severity=_text(severity))} FROM h WHERE {more}"


_PHRASES = [(section, {"ifade": x} if isinstance(x, str) else x) for section in ("jargon", "yabanci") for x in LEXICON[section]]
_ENTRIES = [(section, x.get("ifade") or x["kelime"], bool(x.get("sabit"))) for section, x in _PHRASES]
_TERMS = [(k, w) for k, g in enumerate(LEXICON["es_anlamlilar"]) for w in g["grup"]]


def _facts(text: str) -> str:
    """Facts of a text as a list: what can be one, told by its form."""
    low = f"lower(translate(coalesce({text}, ''), 'Iİ', 'ıi'))"
    said = f"[0-9]{{1,2}} +(?:{'|'.join(turkish.MONTHS)})(?: +[0-9]{{4}})?"
    two = lambda x: f"lpad(CAST(CAST({x} AS INT) AS VARCHAR), 2, '0')"
    w = "string_split_regex(d, ' +')"
    p = "string_split_regex(d, '[./-]')"
    number = "CASE WHEN regexp_matches(n, '^(?:19[0-9]{2}|20[0-9]{2}|2100)$') THEN 'yıl:' || n ELSE 'sayı:' || replace(replace(n, '.', ''), ',', '.') END"
    c = "string_split_regex(c, '[.:]')"
    clock = f"CASE WHEN regexp_matches(c, '^[0-9]{{1,2}}[.:][0-9]{{2}}$') THEN ['saat:' || {two(c + '[1]')} || '.' || {c}[2]] ELSE [{number} FOR n IN string_split(c, ':')] END"
    one = f"""CASE WHEN contains(d, '@') OR NOT regexp_matches(d, '^[0-9]') THEN ['adres:' || regexp_replace(d, '[.,;:)]+$', '')]
      WHEN contains(d, ' ') THEN CASE WHEN len({w}) > 2 THEN ['yıl:' || {w}[3]] ELSE [] END || ['tarih:' || {two(f"list_position({_list(turkish.MONTHS)}, {w}[2])")} || '-' || {two(w + "[1]")}]
      WHEN regexp_matches(d, '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}$') THEN ['yıl:' || {p}[3], 'tarih:' || {two(p + "[2]")} || '-' || {two(p + "[1]")}]
      ELSE flatten([{clock} FOR c IN string_split_regex(d, '[-/]')]) END"""
    return f"list_sort(list_distinct(flatten([{one} FOR d IN regexp_extract_all({low}, {_text('|'.join([_NET, _MAIL, said, _DIGITS]))})])))"


_VALUE = "[substr(y, instr(y, ':') + 1) FOR y IN {}]"


def _uncovered(a: str, b: str) -> str:
    return f"array_to_string([x FOR x IN {a} IF NOT list_contains({_VALUE.format(b)}, substr(x, instr(x, ':') + 1))], ';')"


#: What may follow a quotation that somebody says.
_SAID = r"(?:\s*,?\s*(?:dedi|diyor|der|diye|derken|diyerek|söyledi|sordu|yazdı|yazıyor|bağırdı|seslendi)\b)?"


def _deceived(flag: str) -> str:
    """The words that a flag's ending deceives."""
    if flag not in morphology.DECEIVE:
        return ""
    how, words = morphology.DECEIVE[flag]
    return " AND NOT regexp_matches(b, " + _text(f"^(?:{'|'.join(words)})" + ("$" if how == "is" else "")) + ")"


ORACLE = {
    "normalized_text": f"WITH {SENTENCES} SELECT doc_id, CAST(length(norm) AS INT) AS n_chars, md5(norm) AS norm_md5 FROM norm",
    "paragraphs": f"WITH {SENTENCES} SELECT doc_id, para_idx, md5(text) AS text_md5 FROM paragraphs",
    "sentences": f"WITH {SENTENCES} SELECT doc_id, para_idx, sent_no, md5(text) AS text_md5, is_heading, is_list_item FROM sents",
    "token_kinds": f"WITH {TOKENS} SELECT doc_id, kind, count(*) AS n, CAST(sum(syllables) AS BIGINT) AS syllables, count(*) FILTER (WHERE is_abbreviation) AS n_abbreviations FROM read GROUP BY doc_id, kind",
    "readability_scores": f"""WITH {COUNTS} SELECT doc_id, words, sentences, syllables, h3, h4, h5, h6, round({_ATESMAN}, 6) AS atesman, round(greatest(0.0::DOUBLE, {_UZUN}), 6) AS cetinkaya_uzun, round({_YILMAZ}, 6) AS bezirci_yilmaz,
      CASE {' '.join(f"WHEN {_ATESMAN} >= {v} THEN '{n}'" for v, n in readability.ATESMAN_LEVELS)} ELSE 'çok zor' END AS atesman_level,
      CASE WHEN {_UZUN} >= 51 THEN 'bağımsız okuma düzeyi' WHEN {_UZUN} >= 35 THEN 'eğitsel okuma düzeyi' WHEN {_UZUN} >= 0 THEN 'engellenmiş okuma düzeyi (zor)' ELSE 'engellenmiş okuma düzeyi (ölçeğin altında, çok zor)' END AS cetinkaya_uzun_level,
      CASE WHEN {_YILMAZ} <= 8 THEN 'ilköğretim düzeyi' WHEN {_YILMAZ} <= 12 THEN 'lise düzeyi' WHEN {_YILMAZ} <= 16 THEN 'lisans düzeyi' ELSE 'akademik düzey' END AS bezirci_yilmaz_level FROM counted""",
    "readability_by_source": f"""WITH {COUNTS}, summed AS (SELECT lang, source, count(*) AS docs, CAST(sum(words) AS BIGINT) AS words, CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(syllables) AS BIGINT) AS syllables FROM counted JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source))
      SELECT *, round({_ATESMAN}, 6) AS atesman FROM summed""",
    "syllable_histogram": f"WITH {COUNTS} SELECT CAST(least(syl, 6) AS INT) AS syllables, count(*) AS n FROM used GROUP BY 1",
    "document_statistics": f"""WITH {TOKENS}, per AS (SELECT doc_id, para_idx, sent_no, is_heading, count(*) AS n FROM toks WHERE kind IN ('word', 'number', 'date', 'time', 'percent', 'url', 'email') GROUP BY ALL),
      best AS (SELECT doc_id, para_idx, sent_no, n FROM per WHERE NOT is_heading QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, para_idx, sent_no) = 1)
      SELECT p.doc_id, CAST(sum(p.n) AS BIGINT) AS word_count, count(*) FILTER (WHERE NOT p.is_heading) AS sentence_count, count(DISTINCT p.para_idx) AS paragraph_count, coalesce(max(b.n), 0) AS longest_words, coalesce(max(b.para_idx), -1) AS longest_para, coalesce(max(b.sent_no), -1) AS longest_sent
      FROM per p LEFT JOIN best b USING (doc_id) GROUP BY p.doc_id""",
    "language_gate": f"""WITH {TOKENS}, g AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(regexp_replace(token, '[^\\p{{L}}]', '', 'g'))) AS BIGINT) AS letters, CAST(sum(length(regexp_replace(token, '[\\P{{L}}\\p{{Latin}}]', '', 'g'))) AS BIGINT) AS "foreign",
      count(*) FILTER (WHERE lower(token) IN ({', '.join(map(_text, readability.ENGLISH))})) AS english FROM toks WHERE kind = 'word' GROUP BY doc_id)
      SELECT *, n_words < 3 OR NOT ("foreign" > 0.5 * letters OR (english >= 3 AND english >= 0.2 * n_words)) AS looks_turkish FROM g""",
    "phrase_match": f"""WITH RECURSIVE {TOKENS}, lex(list, phrase, exempt) AS (VALUES {', '.join(f"({_text(a)}, {_text(b)}, {c})" for a, b, c in _ENTRIES)}),
      entries AS (SELECT *, string_split(phrase, ' ') AS w FROM lex),
      line AS (SELECT doc_id, para_idx, sent_no, list(translate(lower(translate(base, 'Iİ', 'ıi')), 'âîûÂÎÛ', 'aiuAİU') ORDER BY tok_idx) AS k FROM toks GROUP BY ALL),
      starts AS (SELECT doc_id, para_idx, sent_no, k, unnest(k) AS first, generate_subscripts(k, 1) - 1 AS pos FROM line),
      cand AS (SELECT doc_id, para_idx, sent_no, list, phrase, exempt, pos, pos + len(w) AS stop FROM starts JOIN entries ON first = w[1] WHERE k[pos + 1:pos + len(w)] = w),
      longest AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, para_idx, sent_no, list, pos ORDER BY stop DESC, phrase) = 1),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx, sent_no, list ORDER BY pos) AS nth FROM longest),
      fold AS (
        SELECT *, true AS taken, stop AS free FROM numbered WHERE nth = 1
        UNION ALL SELECT n.*, n.pos >= f.free, CASE WHEN n.pos >= f.free THEN n.stop ELSE f.free END FROM fold f JOIN numbered n ON n.doc_id = f.doc_id AND n.para_idx = f.para_idx AND n.sent_no = f.sent_no AND n.list = f.list AND n.nth = f.nth + 1
      ) SELECT doc_id, para_idx, sent_no, list, phrase, CAST(pos AS INT) AS first_tok, CAST(stop - 1 AS INT) AS last_tok FROM fold WHERE taken AND NOT exempt""",
    "term_consistency": f"""WITH {TOKENS}, terms(group_id, term) AS (VALUES {', '.join(f"({k}, {_text(w)})" for k, w in _TERMS)}),
      used AS (SELECT doc_id, para_idx, sent_no, tok_idx, group_id, term FROM toks JOIN terms ON translate(lower(translate(base, 'Iİ', 'ıi')), 'âîûÂÎÛ', 'aiuAİU') = term WHERE NOT is_heading),
      per AS (SELECT doc_id, group_id, term, count(*) AS n, min(para_idx * 1000000000000 + sent_no * 1000000 + tok_idx) AS seen FROM used GROUP BY ALL),
      best AS (SELECT doc_id, group_id, term AS dominant FROM per QUALIFY row_number() OVER (PARTITION BY doc_id, group_id ORDER BY n DESC, seen) = 1 AND count(*) OVER (PARTITION BY doc_id, group_id) > 1)
      SELECT doc_id, group_id, term, dominant, n FROM per JOIN best USING (doc_id, group_id) WHERE term <> dominant""",
    "markup_mask": f"SELECT page_id, CAST(length(m) AS INT) AS n_chars, md5(m) AS masked_md5 FROM (SELECT page_id, {_mask(chr(99) + 'oalesce(html, ' + _text('') + ')')} AS m FROM pages)",
    "fact_diff": f"""WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS said FROM conversations),
      pairs AS (SELECT *, last_value(CASE WHEN role = 'user' THEN said END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, said ROWS UNBOUNDED PRECEDING) AS asked FROM said),
      f AS (SELECT conv_id, turn, {_facts("asked")} AS a, {_facts("said")} AS b FROM pairs WHERE role = 'assistant') SELECT conv_id, turn, {_uncovered("a", "b")} AS missing, {_uncovered("b", "a")} AS added FROM f""",
    "tidy_pages": r"""WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
      s AS (SELECT doc_id, n, replace(CASE WHEN n % 3 = 1 THEN regexp_replace(line, '(\p{L})', '\1 ', 'g') ELSE line END, ',', ' ,') AS line FROM l),
      q AS (SELECT *, string_split(line, ' ') AS q FROM s),
      f AS (SELECT *, [regexp_full_match(x, '\p{L}-?') FOR x IN q] AS lone FROM q),
      j AS (SELECT doc_id, n, line, array_to_string([CASE WHEN i = 1 OR (lone[i - 1] AND lone[i]) THEN q[i] ELSE ' ' || q[i] END FOR i IN range(1, len(q) + 1)], '') AS whole,
        len([i FOR i IN range(1, len(q) - 1) IF lone[i] AND lone[i + 1] AND lone[i + 2]]) > 0 AS spread FROM f),
      k AS (SELECT doc_id, n, rtrim(CASE WHEN spread THEN regexp_extract(whole, '^ *') || regexp_replace(ltrim(whole), ' {2,}', ' ', 'g') ELSE line END) AS line FROM j),
      b AS (SELECT *, trim(line) AS bare, max(length(trim(line))) OVER (PARTITION BY doc_id) AS widest, lead(trim(line)) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM k),
      c AS (SELECT doc_id, n, bare <> '' AND NOT regexp_matches(bare, '[.!?:;,…–—-]$') AND coalesce(regexp_matches(next, '^\p{Lu}'), false) AND length(bare) < 0.6 * widest AS breaks,
        regexp_replace(line, '([\p{L}\p{Nd}_]) +([.,;:!?])(\s|$)', '\1\2\3', 'g') AS line FROM b)
      SELECT doc_id, CAST(count(*) FILTER (WHERE breaks) AS INT) AS n_breaks, md5(trim(string_agg(line || CASE WHEN breaks THEN chr(10) ELSE '' END, chr(10) ORDER BY n), ' ' || chr(10))) AS text_md5 FROM c GROUP BY doc_id""",
    "cleaned_text": r"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g') AS t FROM documents),
      b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^ ?[*•] ', '- ', 'g'), '(?m)^ ?#{1,6} ', '', 'g') AS t FROM a),
      c AS (SELECT doc_id, translate(replace(replace(t, '**', ''), '__', ''), '‐‑', '--') AS t FROM b),
      d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM c)
      SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS clean_md5 FROM d""",
    "punctuated_text": r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
      b AS (SELECT *, [trim(x, ' ' || chr(9)) FOR x IN p] AS bare FROM l),
      d AS (SELECT doc_id, array_to_string([rtrim(p[i], ' ' || chr(9)) || CASE WHEN bare[i] <> '' AND NOT ((i = 1 OR bare[i - 1] = '') AND len(string_split_regex(bare[i], '[ \t]+')) <= 6)
        AND NOT starts_with(bare[i], '-') AND NOT regexp_matches(bare[i], '[.!?:…]$') THEN '.' ELSE '' END FOR i IN range(1, len(p) + 1)], chr(10)) AS t FROM b)
      SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS done_md5 FROM d""",
    "document_facts": f"SELECT doc_id, len(f) AS n_facts, md5(array_to_string(f, ';')) AS facts_md5 FROM (SELECT doc_id, {_facts('text')} AS f FROM documents)",
    "recurring_lines": r"""WITH l AS (SELECT source, doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS p FROM documents)),
      r AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY k) AS up, row_number() OVER (PARTITION BY source, doc_id ORDER BY k DESC) AS down FROM l WHERE regexp_matches(line, '\S')),
      total AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source)
      SELECT source, md5(trim(regexp_replace(lower(line), '[0-9]+', '#', 'g'))) AS key_md5, count(DISTINCT doc_id) AS n FROM r JOIN total USING (source) WHERE (up <= 4 OR down <= 4) AND pages >= 3 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""",
    "compliance_c01_m05": f"""WITH {_WORDS}, {_DOC}, fd AS (SELECT doc_id, CASE WHEN n > 15 THEN 3.0 ELSE 1.0 END AS p FROM per WHERE n > 10 UNION ALL SELECT doc_id, 0.25 FROM docw WHERE n > 400),
      s AS (SELECT doc_id, count(*) AS sentence_count FROM sents WHERE NOT is_heading GROUP BY doc_id), f AS (SELECT doc_id, CAST(sum(p) AS DOUBLE) AS penalty, count(*) AS finding_count FROM fd GROUP BY doc_id),
      j AS (SELECT d.doc_id, coalesce(sentence_count, 0) AS sentence_count, coalesce(penalty, 0.0::DOUBLE) AS penalty, coalesce(finding_count, 0) AS finding_count FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN f USING (doc_id))
      SELECT doc_id, sentence_count, round(penalty, 4) AS penalty, finding_count, CASE WHEN sentence_count > 0 THEN CAST(round_even(100 * exp(-0.6::DOUBLE * penalty / greatest(sentence_count, 1)), 0) AS INT) ELSE -1 END AS score, sentence_count >= 3 AS reliable FROM j""",
    "morphology_flags": f"""WITH {TOKENS}, f AS (SELECT DISTINCT string_split(low, '''')[1] AS w FROM toks WHERE kind = 'word'), b AS (SELECT translate(w, 'âîûÂÎÛ', 'aiuAİU') AS b FROM f WHERE length(w) <= 80)
      {' UNION ALL '.join(f"SELECT '{k}' AS flag, count(*) AS n FROM b WHERE regexp_matches(b, '^[a-zçğıöşü]+$') AND regexp_matches(b, {_text(p)}){_deceived(k)} HAVING count(*) > 0" for k, p in morphology.FLAGS.items())}""",
    "long_sentences_c01": f"WITH {_WORDS} {_C01}",
    "parenthesis_c09": _spans("\\([^()]*\\p{L}[^()]*\\)", r"NOT regexp_matches(hit, '^\((?:\p{Lu}{2,6}|[0-9 +()-]+)\)$')", "uyarı"),
    "quotes_b08": f"""WITH {SENTENCES}, h AS (SELECT doc_id, para_idx, sent_no, unnest(regexp_extract_all(text, {_text('"[^"' + chr(10) + ']{1,60}"' + _SAID)})) AS hit FROM sents WHERE NOT is_heading),
      q AS (SELECT *, regexp_extract(hit, {_text('^"[^"' + chr(10) + ']{1,60}"')}) AS quoted FROM h) SELECT doc_id, para_idx, sent_no, md5(quoted) AS text_md5, 'bilgi' AS severity FROM q
      WHERE hit = quoted AND len(string_split_regex(quoted, '\\s+')) <= 3 AND NOT regexp_matches(quoted, '^"(?:\\p{{Lu}}[^ "]*[ "])+$')""",
    "first_abbreviation_k03": f"""WITH {TOKENS}, n AS (SELECT *, lag(token) OVER w AS before, lead(token) OVER w AS after FROM toks WINDOW w AS (PARTITION BY doc_id, para_idx, sent_no ORDER BY tok_idx)),
      c AS (SELECT * FROM n WHERE is_abbreviation AND NOT regexp_matches(base, '{_ROMAN}') AND NOT regexp_matches(coalesce(after, ''), '^[0-9]')),
      o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, base ORDER BY para_idx, sent_no, tok_idx) = 1) SELECT {_FINDING.format(text='base', severity=_text('uyarı'))} FROM o WHERE coalesce(before, '') <> '(' AND coalesce(after, '') <> '('""",
    "semicolons_b06": f"""WITH {TOKENS} SELECT {_FINDING.format(text='token', severity=_text('uyarı'))} FROM toks WHERE NOT is_heading AND token = ';'
      UNION ALL SELECT doc_id, para_idx, sent_no, md5(':'), 'uyarı' FROM toks WHERE NOT is_heading AND token = ':' GROUP BY doc_id, para_idx, sent_no HAVING count(*) > 1""",
    "caps_runs_b07": f"""WITH {TOKENS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx, sent_no ORDER BY tok_idx) AS k FROM toks WHERE kind = 'word'),
      u AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, para_idx, sent_no ORDER BY tok_idx) AS island FROM k WHERE {_upper("token")}),
      r AS (SELECT doc_id, para_idx, sent_no, string_agg(token, ' ' ORDER BY tok_idx) AS hit FROM u GROUP BY doc_id, para_idx, sent_no, island HAVING count(*) > 3) SELECT {_FINDING.format(text='hit', severity=_text('uyarı'))} FROM r""",
    "long_paragraph_m01": f"""WITH {SENTENCES} SELECT doc_id, para_idx, -1 AS sent_no, md5(min_by(text, sent_no)) AS text_md5, 'uyarı' AS severity FROM sents WHERE NOT is_heading AND NOT is_list_item GROUP BY doc_id, para_idx HAVING count(*) > 5""",
    "no_heading_m02": f"WITH {TOKENS}, {_DOC} {_WHOLE} WHERE n > 150 AND NOT headed",
    "long_text_m05": f"WITH {TOKENS}, {_DOC} {_WHOLE} WHERE n > 400",
    "list_opportunity_m03": rf"""WITH {SENTENCES}, p AS (SELECT *, string_split(text, ',') AS parts FROM sents WHERE NOT is_heading AND NOT is_list_item)
      SELECT {_FINDING.format(text='text', severity=_text('uyarı'))} FROM p WHERE len(parts) + CASE WHEN regexp_matches(text, '(?i) (?:ve|veya|ile|ya|yahut) ') THEN 1 ELSE 0 END >= 4 AND len([x FOR x IN parts IF len(string_split_regex(trim(x), '\s+')) BETWEEN 1 AND 5]) >= 3""",
}

ORACLE["roman_b02"] = f"""WITH {TOKENS}, n AS (SELECT *, coalesce(lead(token) OVER (PARTITION BY doc_id, para_idx, sent_no ORDER BY tok_idx) = '.', false) AS dot FROM toks)
  SELECT {_FINDING.format(text='base', severity=_text('uyarı'))} FROM n WHERE kind = 'word' AND regexp_matches(base, '^M{{0,3}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$')
    AND CASE WHEN length(base) > 1 THEN dot OR regexp_matches(base, '^[IVX]+$') ELSE dot AND base IN ('I', 'V', 'X') END"""


def _spelt(name: str, text: str) -> str:
    """The query over the documents in another spelling."""
    return ORACLE[name].replace("FROM documents", f"FROM (SELECT doc_id, {text} AS text FROM documents)")


ORACLE |= {
    "parenthesis_c09": _spelt("parenthesis_c09", r"regexp_replace(text, ', ([^,.;()\n]{5,60}),', ' (\1)', 'g')"),
    "semicolons_b06": _spelt("semicolons_b06", "replace(text, ', ', '; ')"),
    "caps_runs_b07": _spelt("caps_runs_b07", "translate(substr(text, 1, 200), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || substr(text, 201)"),
    "roman_b02": _spelt("roman_b02", "replace(replace(text, ' the ', ' XIV '), ' die ', ' I. ')"),
}

#: Documents with letters in two code points, line ends of two, and wider gaps.
_LOOSE = r"replace(replace(replace(replace(coalesce(text, ''), 'é', 'e' || chr(769)), 'ö', 'o' || chr(776)), chr(10), chr(13) || chr(10)), '. ', '. ' || chr(8203) || ' ')"
ORACLE["original_places"] = f"""
WITH t AS (SELECT doc_id, {_LOOSE} AS t FROM documents),
chars AS (SELECT doc_id, unnest([substr(t, i, 1) FOR i IN range(1, length(t) + 1)]) AS c, unnest(range(0, length(t))) AS i FROM t),
g AS (SELECT *, sum(CASE WHEN c BETWEEN chr(768) AND chr(879) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM chars),
letters AS (SELECT doc_id, g, nfc_normalize(string_agg(c, '' ORDER BY i)) AS c, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY doc_id, g),
said AS (SELECT *, lead(c) OVER (PARTITION BY doc_id ORDER BY g) AS next FROM letters),
mapped AS (SELECT doc_id, g, a, b, {' '.join(f"translate(" for _ in range(4))}c, {_text(turkish.DOUBLE_QUOTES)}, {_text('"' * len(turkish.DOUBLE_QUOTES))}), {_text(turkish.SINGLE_QUOTES)}, {_text("'" * len(turkish.SINGLE_QUOTES))}), {_text(turkish.DASHES)}, {_text('-' * len(turkish.DASHES))}), {_text(turkish.SPACES)}, {_text(' ' * len(turkish.SPACES))}) AS c
  FROM said WHERE NOT (c = chr(13) AND next = chr(10)) AND NOT contains({_text(turkish.REMOVED)}, c)),
runs AS (SELECT *, sum(CASE WHEN c = ' ' AND before = ' ' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY g) - 1 AS n FROM (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY g) AS before FROM mapped)),
norm AS (SELECT doc_id, CAST(n AS INT) AS n, min(c) AS c, min(a) AS a, max(b) AS b FROM runs GROUP BY doc_id, n),
lined AS (SELECT *, count(*) FILTER (WHERE c = chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line_no FROM norm),
lines AS (SELECT doc_id, line_no, min(n) AS start, max(n) + 1 - count(*) FILTER (WHERE c = chr(10)) AS stop, min(a) AS a, max(b) FILTER (WHERE c <> chr(10)) AS b FROM lined GROUP BY doc_id, line_no)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(start AS INT) AS start, CAST(stop AS INT) AS "end", CAST(a AS INT) AS orig_start, CAST(coalesce(b, a) AS INT) AS orig_end, md5(substr(t, CAST(a AS BIGINT) + 1, CAST(coalesce(b, a) - a AS BIGINT))) AS original_md5
FROM lines JOIN t USING (doc_id) WHERE stop > start
"""

#: Words that are no names though sentences begin with them, as the library lists them.
_BEGIN = _list(sorted(names.BEGINNINGS))
_PLANTED = "replace(replace(text, ' queque ', ' Queque''nin '), '. The ', '. Theo ')"
ORACLE["proper_names"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce({_mask(_norm(_PLANTED))}, ''), {_text(r"(?:[\p{L}]+[-'])*[\p{L}]+")}) AS w FROM documents),
b AS (SELECT doc_id, unnest(w) AS w FROM w),
f AS (SELECT doc_id, w, string_split(w, '''')[1] AS base FROM b),
k AS (SELECT doc_id, contains(w, '''') AS ends, regexp_matches(base, '^\\p{{Lu}}') AND (length(base) = 1 OR NOT {_upper("base")}) AS capital, regexp_matches(base, '^\\p{{Ll}}') AS small,
  translate(lower(translate(base, 'Iİ', 'ıi')), 'âîûÂÎÛ', 'aiuAİU') AS form FROM f),
told AS (SELECT doc_id, form, bool_or(capital AND ends) AS marked, count(*) FILTER (WHERE capital) AS n, bool_or(small) AS small FROM k GROUP BY doc_id, form),
named AS (SELECT doc_id, list_sort(list(form)) AS names FROM told WHERE marked OR (n >= 2 AND NOT small AND NOT list_contains({_BEGIN}, form)) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(names), 0) AS INT) AS n_names, md5(coalesce(array_to_string(names, ','), '')) AS names_md5 FROM documents LEFT JOIN named USING (doc_id)
"""
