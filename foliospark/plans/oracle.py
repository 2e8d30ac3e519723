"""The registered queries in DuckDB's SQL, written apart from the operators, with patterns of their own."""

from __future__ import annotations

def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


# White space as Unicode and the C0 separators have it; letters of Latin up to U+024F; signs for a hyphen.
_BLANK, _LATIN, _HYPHEN = r"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}", "a-zA-ZÀ-ɏ", "\u2010\u2011\u2013\u00ad-"
WS, NOT_WS = f"[{_BLANK}]", f"[^{_BLANK}]"
LINE_BREAK = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\p{Zl}\p{Zp}]"
LATIN_WORD, LETTERS_AND_BLANKS = f"[{_LATIN}]{{2,}}", f"[^{_BLANK}\\p{{L}}]"
FOLIO_EDGE = r"^[\])}\[({.,—–\x20-]+|[\])}\[({.,—–\x20-]+$"
FOLIO = f"^(?:(?i:page){WS}*)?[ivxlcdmIVXLCDM\\p{{Nd}}]+$"
BROKEN_WORD = f"([{_LATIN}]{{2,}})[{_HYPHEN}]{WS}*\\n{WS}*([a-zà-ɏ])"
SOFT_HYPHEN = f"([{_LATIN}]{{2,}})\u00ad{WS}*([a-zà-ɏ])"
LIST_START = f"^{WS}*(?:[*•·–—-]|\\(?[cilvxCILVX0-9]{{1,4}}[).]|[a-zA-Z][).]){WS}+"
TOKEN = r"\p{Nd}+|\p{L}+"
# Fixed values, as in the operators: ligatures, plain forms of typographic marks, beginnings of refused answers.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
GLYPHS = {"‘’‚‛′": "'", "“”„″": '"', "–—‒‐‑": "-", "…": "...", "\u00a0\u2009\u202f\n\r\t": " ", "\u00ad": ""}
REFUSALS = ("i cannot", "i can't", "as an ai", "i'm sorry", "note:", "the text appears", "this text contains")
OPEN_END = r"[\p{L}\p{N}\-\x{2010}\x{2011}\x{ad}\x{2013},;]$"


def strip(x: str) -> str:
    return "regexp_replace(" + x + f", '^{WS}+|{WS}+$', '', 'g')"


def every(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{_q(pattern)}', '{to}', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NOT_WS}+'))"


def joined(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '{LINE_BREAK}'), lambda y: {strip('y')}), lambda y: y <> ''), ' ')"


def dehyphenated(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{BROKEN_WORD}', '\\1\\2', 'g'), '{SOFT_HYPHEN}', '\\1\\2', 'g')"


def normalised(x: str) -> str:
    for mark, plain in LIGATURES.items():
        x = f"replace({x}, '{mark}', '{plain}')"
    return strip(f"regexp_replace(replace(replace({x}, chr(160), ' '), chr(8203), ''), '[ \\t]+', ' ', 'g')")


def folio(x: str) -> str:
    bare = every(strip(x), FOLIO_EDGE)
    return f"coalesce(length({bare}) BETWEEN 1 AND 12 AND regexp_matches({bare}, '{FOLIO}'), false)"


def key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '\\p{{Nd}}+', '#', 'g'), '[^\\p{{L}}\\p{{N}}_#]+', ' ', 'g'))"


def upper_share(x: str) -> str:
    letters = f"length({every(x, '[^\\p{L}]+')})"
    return f"(CASE WHEN {letters} > 0 THEN length({every(x, '[^\\p{Lu}]+')}) / {letters} ELSE 0.0 END)"


def is_heading(x: str) -> str:
    s = strip(x)
    small = f"len(list_filter(regexp_extract_all({s}, '{NOT_WS}+'), lambda y: regexp_matches(y, '^\\p{{L}}') AND NOT regexp_matches(y, '^\\p{{Lu}}')))"
    return f"coalesce(length({s}) BETWEEN 1 AND 90 AND NOT regexp_matches({s}, '[.,;]$') AND {words(s)} <= 12 AND regexp_matches({s}, '\\p{{L}}') AND ({upper_share(s)} > 0.75 OR ({small} = 0 AND {words(s)} <= 8)), false)"


def level(x: str, given: str, height: str, page_height: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {given} <> 0 THEN greatest(1, least(6, {given})) WHEN coalesce({height} / greatest(1.0, {page_height}) > 0.045, false) OR ({upper_share(s)} > 0.6 AND {words(s)} <= 8) THEN 1 WHEN {words(s)} <= 12 THEN 2 ELSE 3 END)"


_B = "b AS (SELECT DISTINCT block_id, doc_id, page_index, block_order, type, x0, y0, x1, y1, text, level, image_path, html FROM blocks), pg AS (SELECT doc_id, page_index, max(width) AS page_width, max(height) AS page_height FROM ocr_pages GROUP BY doc_id, page_index)"
_LINES = "l AS (SELECT DISTINCT block_id, line_no, doc_id, text FROM block_lines)"


def by_block(expr: str, name: str, where: str = "true") -> str:
    return f"WITH {_B} SELECT block_id, {expr} AS {name} FROM b WHERE text IS NOT NULL AND {where}"


_T = strip("text")
_FURN = f"""{_B},
sized AS (SELECT b.*, page_height, CASE WHEN page_height > 0 THEN page_height ELSE 1 END AS h FROM b LEFT JOIN pg USING (doc_id, page_index)),
tagged AS (SELECT *, CASE WHEN y1 <= h * 0.09 THEN 'top' WHEN y0 >= h * (1 - 0.09) THEN 'bottom' END AS band, {key(_T)} AS k FROM sized
  WHERE coalesce(type NOT IN ('figure', 'table'), true) AND length({_T}) BETWEEN 1 AND 120 AND y1 - y0 <= h * 0.06 AND page_height IS NOT NULL),
cand AS (SELECT * FROM tagged WHERE k <> '' AND band IS NOT NULL),
n AS (SELECT doc_id, band, k, count(*) AS n FROM cand GROUP BY doc_id, band, k),
need AS (SELECT doc_id, greatest(3, CAST(floor(count(*) * 0.30) AS INT)) AS need FROM pg GROUP BY doc_id),
furn AS (SELECT block_id, doc_id, CASE WHEN {folio("text")} THEN 'page_number' WHEN n.n >= need THEN CASE band WHEN 'top' THEN 'header' ELSE 'footer' END END AS furniture FROM cand JOIN n USING (doc_id, band, k) JOIN need USING (doc_id))"""

_ELS = f"""{_FURN},
f1 AS (SELECT b.* REPLACE (coalesce(furniture, b.type) AS type), page_height, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_order, block_id) AS place FROM b LEFT JOIN furn USING (block_id, doc_id) LEFT JOIN pg USING (doc_id, page_index)),
f2 AS (SELECT * REPLACE (CASE WHEN type = 'text' AND {is_heading("text")} THEN 'heading' ELSE type END AS type,
  CASE WHEN type = 'text' AND {is_heading("text")} THEN {level("text", "coalesce(level, 0)", "(y1 - y0)", "coalesce(page_height, 1)")} ELSE level END AS level) FROM f1),
body AS (SELECT *, {normalised("coalesce(text, '')")} AS nt FROM f2 WHERE coalesce(type NOT IN ('header', 'footer', 'page_number'), true)),
body2 AS (SELECT *, CASE WHEN type IN ('table', 'figure', 'formula') THEN nt WHEN type IN ('heading', 'caption', 'footnote') THEN {joined("nt")} ELSE {joined(dehyphenated("nt"))} END AS bt FROM body),
kept AS (SELECT * FROM body2 WHERE CASE WHEN type = 'figure' THEN image_path IS NOT NULL WHEN type IN ('table', 'formula') THEN true ELSE bt <> '' END),
els AS (SELECT doc_id, page_index * 100000 + place AS seq,
  CASE WHEN type IN ('text', 'list', 'table', 'figure', 'formula', 'heading', 'caption', 'footnote') THEN type ELSE 'text' END AS type, bt AS text,
  CAST(CASE WHEN type = 'heading' THEN CASE WHEN level <> 0 THEN level ELSE 2 END ELSE 0 END AS INT) AS level, page_index FROM kept
  UNION ALL SELECT DISTINCT doc_id, page_index * 100000, 'page_break', '', 0, page_index FROM pg)"""


def stitched(els: str) -> str:
    tail = f"regexp_replace(pt, '{WS}+$', '')"
    return f"""w AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY seq) AS pt, lag(type) OVER (PARTITION BY doc_id ORDER BY seq) AS ptype FROM {els} WHERE type <> 'page_break'),
w1 AS (SELECT *, coalesce(ptype = 'text' AND type = 'text' AND {strip("text")} <> '' AND regexp_matches({tail}, '{OPEN_END}') AND NOT regexp_matches({strip("text")}, '{LIST_START}'), false) AS a, coalesce(length({tail}) >= 40, false) AS long_ FROM w),
w2 AS (SELECT *, sum(CASE WHEN a THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM w1),
w3 AS (SELECT *, a AND max(CASE WHEN a AND long_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island ORDER BY seq) = 1 AS cont FROM w2),
w4 AS (SELECT *, sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS para FROM w3),
w5 AS (SELECT *, regexp_matches(regexp_replace(text, '{WS}+$', ''), '[{_HYPHEN}]$') AND cont_next AND regexp_matches(next_text, '^{WS}*\\p{{Ll}}') AS drop_hyphen FROM (SELECT *, coalesce(lead(cont) OVER (PARTITION BY doc_id ORDER BY seq), false) AS cont_next, lead(text) OVER (PARTITION BY doc_id ORDER BY seq) AS next_text FROM w4)),
w6 AS (SELECT *, CASE WHEN cont_next THEN CASE WHEN coalesce(drop_hyphen, false) THEN regexp_replace(regexp_replace(piece, '{WS}+$', ''), '.$', '') ELSE regexp_replace(piece, '{WS}+$', '') || ' ' END ELSE piece END AS glued FROM (SELECT *, CASE WHEN cont THEN regexp_replace(text, '^{WS}+', '') ELSE text END AS piece FROM w5)),
st AS (SELECT doc_id, min(seq) AS seq, arg_min(type, seq) AS type, string_agg(glued, '' ORDER BY seq) AS text, arg_min(level, seq) AS level, array_to_string(list_sort(list_distinct(list(page_index))), ',') AS pages, CAST(count(*) AS INT) AS n_parts FROM w6 GROUP BY doc_id, para)"""


_ST = f"WITH {_ELS}, {stitched('els')}"
_NATIVE = f"""src AS (SELECT DISTINCT doc_id, page_index, page_id, native_text FROM source_pages WHERE native_text IS NOT NULL),
parts AS (SELECT doc_id, page_index, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, page_index, regexp_split_to_array({strip("native_text")}, '\\n{WS}*\\n') AS p FROM src)),
nels AS (SELECT doc_id, page_index * 100000 + i AS seq, 'text' AS type, {joined(normalised(dehyphenated("t")))} AS text, 0 AS level, page_index FROM parts)"""
# The names of the characters from U+00A0 on, in order.
_NAMES = "nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml".split()
_ENTITIES = ", ".join([f"'{n}': chr({160 + i})" for i, n in enumerate(_NAMES)] + ["'amp': '&'", "'lt': '<'", "'gt': '>'", "'quot': chr(34)"])
_UNESCAPED = "array_to_string(list_transform(regexp_extract_all(t, '&#?[0-9A-Za-z]+;|[^&]+|&'), lambda y: CASE WHEN regexp_matches(y, '^&#[0-9]+;') THEN chr(CAST(regexp_extract(y, '[0-9]+') AS INT)) WHEN regexp_matches(y, '^&[0-9A-Za-z]+;') THEN coalesce(e.m[regexp_extract(y, '[0-9A-Za-z]+')], y) ELSE y END), '')"
# Pages here have a head, and headings, paragraphs and list items that hold no other tags.
_HTML = f"""e AS (SELECT MAP {{{_ENTITIES}}} AS m),
hp AS (SELECT DISTINCT doc_id, page_index, page_id, native_html AS h FROM source_pages WHERE native_html <> ''),
hb AS (SELECT doc_id, page_index, page_id, unnest(b) AS b, generate_subscripts(b, 1) AS i FROM (SELECT *, regexp_extract_all(regexp_replace(h, '(?s)<head>.*</head>', ''), '<(?:h[1-6]|p|li)>[^<]*') AS b FROM hp)),
ht AS (SELECT doc_id, page_index, page_id, i, regexp_extract(b, '^<([a-z0-9]+)', 1) AS tag, trim(regexp_replace({_UNESCAPED.replace("(t,", "(regexp_replace(b, '^<[^>]*>', ''),")}, '{WS}+', ' ', 'g')) AS text FROM hb, e),
hels AS (SELECT doc_id, page_index * 100000 + row_number() OVER (PARTITION BY page_id ORDER BY i) AS seq, CASE tag WHEN 'p' THEN 'text' WHEN 'li' THEN 'list' ELSE 'heading' END AS type, text, CASE WHEN tag LIKE 'h_' THEN CAST(tag[2] AS INT) ELSE 0 END AS level, page_index FROM ht WHERE text <> '')"""
_GUARD = f"""{_B}, pairs AS (SELECT block_id, text AS o, coalesce(lead(text) OVER (PARTITION BY doc_id, page_index ORDER BY block_order, block_id), text) AS c FROM b WHERE type = 'text' AND text IS NOT NULL),
ta AS (SELECT block_id, w, count(*) AS n FROM (SELECT block_id, unnest(regexp_extract_all(lower(o), '{TOKEN}')) AS w FROM pairs) GROUP BY block_id, w),
tb AS (SELECT block_id, w, count(*) AS n FROM (SELECT block_id, unnest(regexp_extract_all(lower(c), '{TOKEN}')) AS w FROM pairs) GROUP BY block_id, w),
common AS (SELECT block_id, sum(least(ta.n, tb.n)) AS n FROM ta JOIN tb USING (block_id, w) GROUP BY block_id),
na AS (SELECT block_id, sum(n) AS n FROM ta GROUP BY block_id), nb AS (SELECT block_id, sum(n) AS n FROM tb GROUP BY block_id),
bound AS (SELECT pairs.*, CASE WHEN na.n IS NULL AND nb.n IS NULL THEN 1.0 WHEN na.n IS NULL OR nb.n IS NULL THEN 0.0 ELSE 2.0 * coalesce(common.n, 0) / (na.n + nb.n) END AS bound FROM pairs LEFT JOIN common USING (block_id) LEFT JOIN na USING (block_id) LEFT JOIN nb USING (block_id))"""
_PREFIXES = "|".join(REFUSALS).replace("'", "''")
_BULLET = f"^{WS}*(?:[•·–—*]|[0-9]+[.)]){WS}+"
_NUMBERED = f"^([0-9]+)[.)]{WS}+(.*)$"
_ITEMS = f"list_filter(list_transform(regexp_split_to_array(text, '{LINE_BREAK}'), lambda y: {strip('y')}), lambda y: y <> '')"
_GLYPHS = "text"
for _marks, _plain in GLYPHS.items():
    _GLYPHS = f"regexp_replace({_GLYPHS}, '[{_q(_marks)}]', '{_q(_plain)}', 'g')"
_GLYPHS = f"regexp_replace({_GLYPHS}, '[^\\x{{20}}-\\x{{7e}}\\x{{a1}}-\\x{{17f}}]', ' ', 'g')"
_DURING = "regexp_replace(regexp_replace(regexp_replace(native_html, '(?is)<head\\b.*?</head>', ' ', 'g'), '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g')"



def _yaml(x: str) -> str:
    body = f"replace(replace(replace(coalesce({x}, ''), chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), ' ')"
    return f"chr(34) || {strip(body)} || chr(34)"


SQL: dict[str, str] = {
    "text_quality": f"""WITH d AS (SELECT doc_id, {strip("text")} AS t FROM documents),
m AS (SELECT doc_id, t, {words("t")} AS nw, len(list_filter(regexp_split_to_array(t, '{LINE_BREAK}'), lambda y: {strip("y")} <> '')) AS nl, len(regexp_extract_all(t, '{LATIN_WORD}')) AS lw, len(list_filter(regexp_extract_all(t, '{LATIN_WORD}'), lambda y: length(y) >= 4)) AS ll, length(regexp_replace(t, '{LETTERS_AND_BLANKS}', '', 'g')) AS al FROM d)
SELECT doc_id, round(CASE WHEN length(t) < 40 OR lw = 0 THEN 0.0 ELSE round_even(0.45 * least(1.0, CAST(nw AS DOUBLE) / nl / 6.0) + 0.30 * (CAST(al AS DOUBLE) / length(t)) + 0.25 * least(1.0, CAST(ll AS DOUBLE) / lw / 0.45), 3) END, 2) AS quality FROM m""",
    "repeat_key_counts": f"WITH {_LINES} SELECT {key('text')} AS repeat_key, count(*) AS n FROM l WHERE text IS NOT NULL GROUP BY 1",
    "folio_flags": by_block(folio("text"), "is_folio"),
    "normalise_text": by_block(normalised("text"), "plain"),
    "dehyphenate": by_block(dehyphenated("text"), "joined"),
    "join_lines": by_block(joined("text"), "joined"),
    "list_start_flags": f"WITH {_LINES} SELECT block_id, line_no, regexp_matches(text, '{LIST_START}') AS is_start FROM l WHERE text IS NOT NULL",
    "list_format": f"WITH {_B}, i AS (SELECT block_id, text, {_ITEMS} AS items FROM b WHERE type = 'list' AND text IS NOT NULL), j AS (SELECT *, coalesce(items[1], {strip('text')}) AS one FROM i) SELECT block_id, CASE WHEN len(items) <= 1 THEN CASE WHEN regexp_matches(one, '{_BULLET}') THEN '- ' || regexp_replace(one, '{_BULLET}', '') ELSE one END ELSE array_to_string(list_transform(items, lambda y: CASE WHEN regexp_matches(y, '{_NUMBERED}') THEN regexp_replace(y, '{_NUMBERED}', '\\1. \\2') ELSE '- ' || regexp_replace(y, '{_BULLET}', '') END), chr(10)) END AS items FROM j",
    "token_counts": by_block(f"CAST(len(regexp_extract_all(lower(text), '{TOKEN}')) AS INT)", "n_tokens"),
    "plain_glyphs": by_block(_GLYPHS, "plain"),
    "yaml_escape": f"SELECT DISTINCT doc_id, '\"' || {strip('replace(replace(replace(coalesce(title, ' + chr(39) * 2 + '), chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(32))')} || '\"' AS quoted FROM document_meta",
    "html_escape": by_block("replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "escaped"),
    "tag_strip": f"SELECT DISTINCT page_id, trim(regexp_replace(regexp_replace({_DURING}, '(?s)<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')) AS plain FROM source_pages WHERE native_html IS NOT NULL",
    "heading_promote": f"WITH {_B} SELECT block_id, CAST(CASE WHEN type = 'text' THEN {level('text', 'coalesce(level, 0)', '(y1 - y0)', 'coalesce(page_height, 1)')} ELSE level END AS INT) AS level FROM b LEFT JOIN pg USING (doc_id, page_index) WHERE type = 'heading' OR (type = 'text' AND {is_heading('text')})",
    "furniture_labels": f"WITH {_FURN} SELECT block_id, furniture FROM furn WHERE furniture IS NOT NULL",
    "furniture_stats": f"WITH {_FURN} SELECT doc_id, count(*) FILTER (furniture = 'header') AS n_header, count(*) FILTER (furniture = 'footer') AS n_footer, count(*) FILTER (furniture = 'page_number') AS n_page_number FROM b LEFT JOIN furn USING (block_id, doc_id) GROUP BY doc_id",
    "folio_map": f"WITH {_B}, f AS (SELECT *, regexp_extract(text, '(\\p{{Nd}}+|[ivxlcdmIVXLCDM]+)', 1) AS folio FROM b WHERE type = 'page_number') SELECT doc_id, page_index, arg_min(folio, (block_order, block_id)) AS folio FROM f WHERE folio <> '' GROUP BY doc_id, page_index",
    "page_plain_text": f"WITH {_B} SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY block_order, block_id) AS plain FROM b WHERE coalesce(type NOT IN ('header', 'footer', 'page_number'), true) AND {_T} <> '' GROUP BY doc_id, page_index",
    "weak_page_gate": f"WITH {_B}, p AS (SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY block_order, block_id) AS plain FROM b WHERE coalesce(type NOT IN ('header', 'footer', 'page_number'), true) AND {_T} <> '' GROUP BY doc_id, page_index), w AS (SELECT doc_id, page_index, coalesce(length({strip('plain')}), 0) < 400 AS weak FROM pg LEFT JOIN p USING (doc_id, page_index)), g AS (SELECT doc_id FROM w GROUP BY doc_id HAVING count(*) FILTER (weak) >= greatest(2.0, count(*) * 0.02)) SELECT doc_id, page_index FROM w JOIN g USING (doc_id) WHERE weak",
    "take_longer": f"WITH {_B}, {_LINES}, p AS (SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY block_order, block_id) AS plain FROM b WHERE coalesce(type NOT IN ('header', 'footer', 'page_number'), true) AND {_T} <> '' GROUP BY doc_id, page_index), o AS (SELECT l.doc_id, page_index, string_agg(l.text, chr(10) ORDER BY l.block_id, line_no) AS alt FROM l JOIN b USING (block_id) WHERE l.text IS NOT NULL GROUP BY l.doc_id, page_index) SELECT doc_id, page_index, CAST(length(CASE WHEN coalesce(length({strip('alt')}) > length({strip('plain')}), false) THEN alt ELSE plain END) AS INT) AS n_chars, CASE WHEN coalesce(length({strip('alt')}) > length({strip('plain')}), false) THEN 'layout+lines' ELSE 'layout' END AS engine FROM p LEFT JOIN o USING (doc_id, page_index)",
    "assemble_elements": f"WITH {_ELS} SELECT doc_id, seq, type, text, level FROM els",
    "stitch_paragraphs": f"{_ST} SELECT doc_id, seq, type, text, pages, n_parts FROM st",
    "native_assembly": f"WITH {_NATIVE}, nel AS (SELECT * FROM nels WHERE text <> ''), {stitched('nel')}, brk AS (SELECT doc_id, count(DISTINCT page_index) AS n_pages FROM src GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n, sum({words('text')}) AS nw FROM st GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n_paragraphs, n_pages, CAST(coalesce(nw, 0) AS BIGINT) AS n_words FROM brk LEFT JOIN c USING (doc_id)",
    "word_counts": f"{_ST}, d AS (SELECT DISTINCT doc_id FROM els), c AS (SELECT doc_id, sum({words('text')}) AS nw FROM st GROUP BY doc_id) SELECT doc_id, CAST(coalesce(nw, 0) AS BIGINT) AS n_words FROM d LEFT JOIN c USING (doc_id)",
    "table_of_contents": f"{_ST} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INT) AS entry, level, text FROM st WHERE type = 'heading'",
    "infer_titles": f"WITH {_ELS}, m AS (SELECT doc_id, min(title) AS title, min(source_file) AS source_file FROM document_meta GROUP BY doc_id), m2 AS (SELECT *, {strip('coalesce(title, ' + chr(39) * 2 + ')')} AS given, regexp_extract(source_file, '([^/\\\\]*)$', 1) AS name FROM m), m3 AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM m2), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM els), h AS (SELECT doc_id, arg_min(trim(regexp_replace(text, '{WS}+', ' ', 'g')), seq) AS h FROM e WHERE r <= 40 AND type = 'heading' AND length(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) BETWEEN 3 AND 120 GROUP BY doc_id) SELECT doc_id, CASE WHEN coalesce(given = '' OR lower(given) IN ('untitled', 'unknown') OR lower(given) = lower(stem) OR lower(given) = lower(name), true) THEN coalesce(h, CASE WHEN given <> '' THEN title END, stem) ELSE title END AS title FROM m3 LEFT JOIN h USING (doc_id)",
    "guard_bound": f"WITH {_GUARD} SELECT block_id, round(bound, 6) AS bound FROM bound",
    "guard_reasons": f"WITH {_GUARD}, g AS (SELECT *, CAST(length(c) AS DOUBLE) / greatest(1, length(o)) AS ratio, len(regexp_extract_all(o, '\\p{{Nd}}+')) AS had, len(regexp_extract_all(c, '\\p{{Nd}}+')) AS has FROM bound) SELECT block_id, CASE WHEN {strip('c')} = '' THEN 'empty' WHEN ratio < 0.80 THEN 'too_short' WHEN ratio > 1.25 THEN 'too_long' WHEN bound < 0.72 THEN 'diverged' WHEN regexp_matches(lower(substring(c, 1, 180)), '^(?:{_PREFIXES})') THEN 'meta_response' WHEN had > 0 AND abs(has - had) > greatest(1.0, had * 0.25) THEN 'numbers_changed' ELSE 'ok' END AS reason FROM g",
    "reason_histogram": "WITH r AS (SELECT DISTINCT run_id, reasons FROM clean_stats), e AS (SELECT unnest(map_keys(reasons)) AS reason, unnest(map_values(reasons)) AS n FROM r) SELECT reason, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_runs FROM e GROUP BY reason",
    "page_metrics_score": "WITH o AS (SELECT page_id, max(deskew_angle) AS skew FROM ocr_pages GROUP BY page_id), p AS (SELECT DISTINCT page_id, width, height, page_index, skew FROM source_pages LEFT JOIN o USING (page_id)), m AS (SELECT page_id, skew, CAST(width % 130 AS DOUBLE) AS sh, CAST(height % 61 AS DOUBLE) AS co, CAST(page_index % 13 AS DOUBLE) AS no, CAST(width % 71 AS DOUBLE) AS il, (height % 20) / 100.0 AS bo FROM p) SELECT page_id, round(greatest(0.0, least(1.0, 1 - 0.30 * (1 - least(1.0, coalesce(sh, 999.0) / 120)) - 0.20 * (1 - least(1.0, coalesce(co, 99.0) / 55)) - 0.20 * least(1.0, abs(coalesce(skew, 0.0)) / 3) - 0.15 * least(1.0, coalesce(no, 0.0) / 12) - 0.15 * least(1.0, coalesce(il, 0.0) / 70))), 6) AS score, concat_ws(',', CASE WHEN bo > 0.12 THEN 'crop' END, CASE WHEN abs(skew) >= 0.30 THEN 'deskew' END, CASE WHEN il > 38 THEN 'illumination' END, CASE WHEN co < 48 THEN 'clahe' END, CASE WHEN no > 6.5 THEN 'despeckle' END) AS actions FROM m",
    "upper_median": "WITH b AS (SELECT DISTINCT block_id, type, confidence FROM blocks WHERE confidence IS NOT NULL) SELECT type, list_sort(list(confidence))[CAST(count(*) // 2 + 1 AS INT)] AS median FROM b GROUP BY type",
    "noted_methods": "WITH p AS (SELECT DISTINCT page_id, notes['order_method'] AS method FROM ocr_pages) SELECT method, count(*) AS n_pages FROM p WHERE method IS NOT NULL GROUP BY method",
    "axis_split": f"WITH {_B}, r AS (SELECT block_id, doc_id, page_index, y0, y0 - max(y1) OVER (PARTITION BY doc_id, page_index ORDER BY y0, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2339 * 0.012 AS cut FROM b WHERE y0 IS NOT NULL AND y1 IS NOT NULL) SELECT block_id, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index ORDER BY y0, block_id) AS INT) AS axis_group FROM r",
    "largest_gap": f"WITH {_B}, r AS (SELECT doc_id, page_index, y0 - max(y1) OVER (PARTITION BY doc_id, page_index ORDER BY y0, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM b WHERE y0 IS NOT NULL AND y1 IS NOT NULL) SELECT doc_id, page_index, greatest(0.0, max(g)) AS gap FROM r GROUP BY doc_id, page_index",
    "order_validation": f"WITH {_B}, r AS (SELECT doc_id, page_index, block_order % 3 AS c, lag(block_order % 3) OVER (PARTITION BY doc_id, page_index ORDER BY block_order, block_id) AS p FROM b WHERE type IN ('text', 'list', 'heading') AND y1 > y0), n AS (SELECT doc_id, page_index, sum(CASE WHEN p <> c THEN 1 ELSE 0 END) AS s, count(*) AS k, max(c) + 1 AS n FROM r GROUP BY doc_id, page_index) SELECT doc_id, page_index, CAST(s AS BIGINT) AS switches, k AS singles, n >= 2 AND k >= 4 AND s > n + 1 AND s > 0.4 * k AS wrong FROM n",
    "page_geometry": "SELECT doc_id, page_index, round(least(14000.0, max(width) * 72 / max(CASE WHEN dpi > 0 THEN dpi ELSE 300.0 END)), 4) AS width_pt, round(least(14000.0, max(height) * 72 / max(CASE WHEN dpi > 0 THEN dpi ELSE 300.0 END)), 4) AS height_pt FROM source_pages GROUP BY doc_id, page_index",
    "group_inputs": "WITH p AS (SELECT DISTINCT image_path AS path FROM source_pages WHERE image_path <> ''), g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS document, path FROM p) SELECT document, CAST(count(*) AS INT) AS n_files, min(path) AS first_file, max(path) AS last_file FROM g GROUP BY document",
    "natural_sort": "WITH f AS (SELECT DISTINCT source_file FROM document_meta WHERE source_file IS NOT NULL) SELECT source_file, array_to_string(list_transform(regexp_extract_all(lower(source_file), '\\p{Nd}+|[^\\p{Nd}]+'), lambda y: CASE WHEN regexp_matches(y, '^\\p{Nd}') AND length(y) < 12 THEN lpad(y, 12, '0') ELSE y END), '') AS sort_key FROM f",
    "resume_antijoin": "WITH s AS (SELECT DISTINCT doc_id, page_index FROM source_pages WHERE native_text IS NULL AND native_html IS NULL), c AS (SELECT DISTINCT doc_id, page_index FROM ocr_pages WHERE deskew_angle IS NOT NULL) SELECT doc_id, page_index FROM s ANTI JOIN c USING (doc_id, page_index)",
    "cache_complete": "WITH t AS (SELECT doc_id, count(DISTINCT page_index) AS total FROM source_pages GROUP BY doc_id), h AS (SELECT doc_id, count(DISTINCT page_index) AS have FROM ocr_pages WHERE page_index < 20 GROUP BY doc_id) SELECT doc_id, coalesce(have, 0) AS have, CAST(least(total, 20) AS BIGINT) AS needed, coalesce(have, 0) >= least(total, 20) AS complete FROM t LEFT JOIN h USING (doc_id)",
    "run_report": "WITH r AS (SELECT DISTINCT run_id, errors, first_page, last_page, chunks FROM clean_stats WHERE chunks IS NOT NULL) SELECT count(*) FILTER (errors = 0) AS n_ok, count(*) FILTER (errors <> 0) AS n_failed, CAST(sum(last_page - first_page + 1) AS BIGINT) AS n_pages, round(sum(CAST(chunks AS DOUBLE)) / sum(last_page - first_page + 1), 6) AS seconds_per_page FROM r",
    "page_feed": f"WITH {_B}, x AS (SELECT block_id, {joined(dehyphenated(normalised('text')))} AS text FROM b WHERE coalesce(type NOT IN ('header', 'footer', 'page_number'), true)) SELECT block_id, text FROM x WHERE text <> ''",
    "probe_route": f"""WITH p AS (SELECT doc_id, page_index, max(native_text) AS x, max(dpi) AS dpi FROM source_pages GROUP BY doc_id, page_index),
q AS (SELECT doc_id, page_index, dpi, CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END AS coverage, {strip("x")} AS t FROM p),
m AS (SELECT *, {words("t")} AS nw, len(list_filter(regexp_split_to_array(t, '{LINE_BREAK}'), lambda y: {strip("y")} <> '')) AS nl, len(regexp_extract_all(t, '{LATIN_WORD}')) AS lw, len(list_filter(regexp_extract_all(t, '{LATIN_WORD}'), lambda y: length(y) >= 4)) AS ll, length(regexp_replace(t, '{LETTERS_AND_BLANKS}', '', 'g')) AS al FROM q),
s AS (SELECT doc_id, page_index, dpi, coverage, round(coalesce(CASE WHEN t IS NULL THEN NULL WHEN length(t) < 40 OR lw = 0 THEN 0.0 ELSE round_even(0.45 * least(1.0, CAST(nw AS DOUBLE) / nl / 6.0) + 0.30 * (CAST(al AS DOUBLE) / length(t)) + 0.25 * least(1.0, CAST(ll AS DOUBLE) / lw / 0.45), 3) END, 0.0), 2) AS quality FROM m),
n AS (SELECT doc_id, max(page_index) + 1 AS n_pages FROM s GROUP BY doc_id),
e AS (SELECT s.* FROM s JOIN n USING (doc_id) WHERE list_contains(list_transform(range(12), lambda i: i * n_pages // 12), page_index)),
g AS (SELECT doc_id, list_sort(list(coverage))[count(*) // 2 + 1] AS coverage, list_sort(list(dpi) FILTER (dpi > 0))[count(*) FILTER (dpi > 0) // 2 + 1] AS dpi, list_sort(list(quality))[count(*) // 2 + 1] AS quality FROM e GROUP BY doc_id)
SELECT doc_id, n_pages, CAST(coverage AS DOUBLE) AS coverage, coalesce(dpi, 300.0) AS dpi, CAST(quality AS DOUBLE) AS quality, coalesce(coverage >= 0.55, false) AS is_scan, CASE WHEN NOT coalesce(coverage >= 0.55, false) AND coalesce(quality >= 0.80, false) THEN 'native' ELSE 'ocr' END AS mode FROM n LEFT JOIN g USING (doc_id)""",
    "chunk_pack": f"{_ST}, c AS MATERIALIZED (SELECT doc_id, seq, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM st WHERE type IN ('text', 'list', 'caption', 'footnote') AND {strip('text')} <> ''), r AS (SELECT doc_id, seq, rn, n AS size, 0 AS chunk FROM c WHERE rn = 1 UNION ALL SELECT c.doc_id, c.seq, c.rn, CASE WHEN r.size + c.n > 4000 THEN c.n ELSE r.size + c.n END, r.chunk + CASE WHEN r.size + c.n > 4000 THEN 1 ELSE 0 END FROM r JOIN c ON c.doc_id = r.doc_id AND c.rn = r.rn + 1) SELECT doc_id, seq, CAST(chunk AS INT) AS chunk FROM r".replace("WITH ", "WITH RECURSIVE ", 1),
    "slug_ascii": f"WITH a AS (SELECT DISTINCT doc_id, author FROM document_meta WHERE author IS NOT NULL), b AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(strip_accents(author), '[^\\p{{L}}\\p{{N}}_ .\\-]', '', 'g')), ' +', '_', 'g'), '_{{2,}}', '_', 'g') AS s FROM a), c AS (SELECT doc_id, regexp_replace(s, '^[._\\-]+|[._\\-]+$', '', 'g') AS s FROM b) SELECT DISTINCT doc_id, substring(CASE WHEN s = '' THEN 'document' ELSE s END, 1, 90) AS slug FROM c",
    "links_images": "WITH p AS (SELECT DISTINCT page_id, native_html AS h FROM source_pages WHERE native_html <> ''), i AS (SELECT page_id, list_transform(regexp_extract_all(h, '(?is)<(?:img|image)\\b[^>]*>'), lambda x: regexp_extract(x, '(?is)(?:src|xlink:href)\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS s FROM p), f AS (SELECT page_id, list_filter(s, lambda x: x <> '') AS s FROM i) SELECT page_id, CAST(unnest(range(len(s))) AS INT) AS image_no, unnest(s) AS src FROM f",
    "table_markdown": f"""WITH {_B}, h AS (SELECT block_id, html FROM b WHERE type = 'table' AND html IS NOT NULL),
c AS (SELECT block_id, html, list_filter(list_transform(regexp_extract_all(html, '(?is)<tr\\b[^>]*>.*?</tr>'), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[hd]\\b[^>]*>.*?</t[hd]>'), lambda x: replace(trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')), '|', chr(92) || '|'))), lambda r: len(r) > 0) AS rows FROM h),
w AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS wide FROM c)
SELECT block_id, CASE WHEN regexp_matches(html, '(?i)<table') AND NOT regexp_matches(html, '(?i)(rowspan|colspan) *=') AND len(rows) >= 2 AND wide >= 2 THEN array_to_string(list_transform(rows, lambda r, i: '| ' || array_to_string(list_resize(r, wide, ''), ' | ') || ' |' || CASE WHEN i = 1 THEN chr(10) || '|' || repeat(' --- |', wide) ELSE '' END), chr(10)) END AS markdown FROM w""",
    "figure_crops": f"WITH {_B}, f AS (SELECT b.*, page_width AS w, page_height AS h FROM b JOIN pg USING (doc_id, page_index) WHERE type = 'figure' AND (x1 - x0) * (y1 - y0) / greatest(1.0, page_width * page_height) >= 0.01), c AS (SELECT doc_id, block_id, page_index, block_order, greatest(0, CAST(trunc(x0) AS INT)) AS l, greatest(0, CAST(trunc(y0) AS INT)) AS t, least(w, CAST(trunc(x1) AS INT)) AS r, least(h, CAST(trunc(y1) AS INT)) AS b FROM f) SELECT doc_id, block_id, page_index, l AS left, t AS top, r AS right, b AS bottom, printf('images/p%04d_%02d.jpg', page_index, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_order, block_id) - 1) AS name FROM c WHERE r - l >= 16 AND b - t >= 16",
    "front_matter": f"""WITH n AS (SELECT doc_id, count(DISTINCT page_index) AS pages FROM source_pages GROUP BY doc_id),
m AS (SELECT doc_id, title, author, language, source_file FROM document_meta QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC, coalesce(title, '') DESC, coalesce(author, '') DESC, coalesce(language, '') DESC, coalesce(source_file, '') DESC) = 1)
SELECT doc_id, concat_ws(chr(10) || chr(10), concat_ws(chr(10), '---', 'title: ' || {_yaml("title")}, CASE WHEN author <> '' THEN 'author: ' || {_yaml("author")} END, 'language: ' || {_yaml("CASE WHEN language <> '' THEN language ELSE 'en' END")}, 'source_file: ' || {_yaml("source_file")}, 'ocr_date: 2025-01-01', 'pages: "' || pages || '"', '---'),
  CASE WHEN {strip("title")} <> '' THEN '# ' || trim(regexp_replace(title, '{WS}+', ' ', 'g')) END, CASE WHEN {strip("author")} <> '' THEN '*' || trim(regexp_replace(author, '{WS}+', ' ', 'g')) || '*' END) AS head FROM m JOIN n USING (doc_id)""",
    "correction_cache": f"{_ST}, h AS (SELECT doc_id, count(*) AS n FROM els GROUP BY doc_id), k AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM st UNION ALL SELECT doc_id FROM els WHERE type = 'page_break') GROUP BY doc_id) SELECT doc_id FROM h JOIN k USING (doc_id, n)",
    "ingest_manifest": "WITH p AS (SELECT DISTINCT page_id, doc_id, page_index, image_path, width, height FROM source_pages), m AS (SELECT doc_id, arg_max(mode, ingested_at) AS mode FROM document_meta GROUP BY doc_id), t AS (SELECT doc_id, count(DISTINCT page_index) AS total_pages FROM p JOIN m USING (doc_id) GROUP BY doc_id) SELECT doc_id, page_index, total_pages, 20 AS max_pages, image_path, width, height FROM p JOIN m USING (doc_id) JOIN t USING (doc_id) WHERE page_index < 20 AND coalesce(mode, 'ocr') <> 'native'",
    "input_kinds": "WITH f AS (SELECT DISTINCT source_file AS f FROM document_meta WHERE source_file IS NOT NULL), e AS (SELECT f, lower(regexp_extract(f, '\\.([^./]*)$', 1)) AS e, regexp_replace(regexp_extract(f, '([^/]*)$', 1), '\\.[^.]*$', '') AS title FROM f) SELECT f AS document, CASE WHEN e IN ('pdf', 'epub') THEN e WHEN e IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp') THEN 'images' END AS kind, title FROM e",
    "html_elements": f"WITH {_HTML} SELECT doc_id, seq, type, text, level FROM hels",
    "native_documents": f"""WITH {_HTML}, {_NATIVE.replace("WHERE native_text IS NOT NULL", "WHERE native_text IS NOT NULL AND coalesce(native_html, '') = ''")},
un AS (SELECT doc_id, seq, type, {joined(normalised("text"))} AS text, level, page_index FROM hels UNION ALL SELECT doc_id, seq, type, text, level, page_index FROM nels),
nel AS (SELECT * FROM un WHERE text <> ''), {stitched("nel")},
brk AS (SELECT doc_id, count(DISTINCT page_index) AS n_pages FROM source_pages WHERE native_text IS NOT NULL OR native_html IS NOT NULL GROUP BY doc_id),
c AS (SELECT doc_id, count(*) FILTER (type = 'heading') AS nh, count(*) FILTER (type NOT IN ('heading', 'figure')) AS np, sum({words("text")}) AS nw FROM st GROUP BY doc_id)
SELECT doc_id, n_pages, coalesce(nh, 0) AS n_headings, CAST(0 AS BIGINT) AS n_figures, coalesce(np, 0) AS n_paragraphs, CAST(coalesce(nw, 0) AS BIGINT) AS n_words FROM brk LEFT JOIN c USING (doc_id)""",
    "chapter_split": f"""{_ST}, al AS (SELECT doc_id, seq, type, text, level FROM st UNION ALL SELECT doc_id, seq, type, text, level FROM els WHERE type = 'page_break'),
hd AS (SELECT doc_id, min(level) AS top FROM al WHERE type = 'heading' AND level > 0 GROUP BY doc_id),
b0 AS (SELECT al.*, top, row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1 AS first, count(*) FILTER (type IN ('text', 'list', 'table', 'figure')) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS body FROM al LEFT JOIN hd USING (doc_id)),
b1 AS (SELECT *, coalesce(type = 'heading' AND level = top AND NOT first, false) AS cut FROM b0),
b2 AS MATERIALIZED (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS part FROM b1),
cd AS MATERIALIZED (SELECT doc_id, part, seq, body, row_number() OVER (PARTITION BY doc_id, part ORDER BY seq) AS rn FROM b2 WHERE type = 'heading' AND NOT cut),
r AS (SELECT doc_id, part, CAST(0 AS BIGINT) AS rn, min(body) AS since, CAST(NULL AS BIGINT) AS seq, false AS forced FROM b2 GROUP BY doc_id, part
  UNION ALL SELECT c.doc_id, c.part, c.rn, CASE WHEN c.body - r.since >= 400 THEN c.body ELSE r.since END, c.seq, c.body - r.since >= 400 FROM r JOIN cd c ON c.doc_id = r.doc_id AND c.part = r.part AND c.rn = r.rn + 1),
b3 AS (SELECT b2.*, b2.cut OR coalesce(f.forced, false) AS begins, CASE WHEN type = 'heading' AND {strip("text")} <> '' THEN {strip("text")} END AS named FROM b2 LEFT JOIN (SELECT doc_id, seq, forced FROM r WHERE forced) f USING (doc_id, seq)),
b4 AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS chapter FROM b3)
SELECT doc_id, CAST(chapter AS INT) AS chapter, coalesce(arg_min(named, seq) FILTER (begins OR (first AND type = 'heading' AND level = top)), arg_min(named, seq), 'Part ' || (chapter + 1)) AS title, count(*) AS n_elements FROM b4 GROUP BY doc_id, chapter HAVING max(CASE WHEN type <> 'page_break' THEN 1 ELSE 0 END) = 1""".replace("WITH ", "WITH RECURSIVE ", 1),
}
