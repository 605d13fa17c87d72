"""ANSI SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from gramlode.plans.tables import FREQUENT_LABELS, LABELS, SHEETS

TOKEN_RE = r"[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"


def _str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_str(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


CLEAN = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z ]', ' ', 'g'), ' '), lambda x: x <> '')"
PAIRS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"

TRIMMED = f"""
t AS (SELECT doc_id, lang, source, {CLEAN.format("text")} g FROM documents),
w AS (SELECT doc_id, lang, source,
             CASE WHEN len(g) = 101 THEN g[52:100] WHEN len(g) > 102 THEN g[52:len(g) - 51] ELSE [] END k FROM t)"""

GRAMS = f"""{TRIMMED},
grams AS (SELECT doc_id, unnest(k) gram FROM w UNION ALL SELECT doc_id, unnest({PAIRS.format("k")}) FROM w)"""

RAW_TOKENS = f"r AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN_RE}') k FROM documents)"

BIGRAMS = f"""{RAW_TOKENS},
b AS (SELECT unnest({PAIRS.format("k")}) bigram FROM r),
counts AS MATERIALIZED (SELECT bigram, count(*) AS "count" FROM b GROUP BY bigram)"""


def _singular(w: str) -> str:
    return f"""CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN regexp_replace({w}, 'ies$', 'y')
         WHEN regexp_matches({w}, '(ss|x|z|ch|sh)es$') THEN regexp_replace({w}, 'es$', '')
         WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is)$') THEN regexp_replace({w}, 's$', '')
         ELSE {w} END"""


def _flip(w: str) -> str:
    one = _singular(w)
    return f"""CASE {w} WHEN 'gas' THEN 'gases' WHEN 'gases' THEN 'gas' WHEN 'bus' THEN 'buses' WHEN 'buses' THEN 'bus'
         WHEN 'analysis' THEN 'analyses' WHEN 'analyses' THEN 'analysis'
         ELSE CASE WHEN ({one}) <> {w} THEN ({one})
              WHEN regexp_matches({w}, '[bcdfghjklmnpqrstvwxz]y$') THEN regexp_replace({w}, 'y$', 'ies')
              WHEN regexp_matches({w}, '(s|x|z|ch|sh)$') THEN {w} || 'es'
              ELSE {w} || 's' END END"""


# sheets(tech, tech_pos, raw) -> kd(tech, base), forms(base, tech_pos, surface), sd(surface, base)
NORMAL = "regexp_replace(replace(raw, '_', ' '), '[0-9]', '', 'g')"
KEYWORDS = f"kd AS (SELECT DISTINCT tech, tech_pos, {NORMAL} base FROM sheets)"
FORMS = f"""
bases AS (SELECT base, max(tech_pos) tech_pos, string_split(base, ' ')[1] a,
                 coalesce(string_split(base, ' ')[2], '') b, len(regexp_extract_all(base, '[^ ]+')) n
          FROM kd GROUP BY base),
flipped AS (SELECT *, {_flip("a")} fa, {_flip("b")} fb, {_flip("base")} fbase FROM bases),
forms AS (SELECT base, tech_pos, unnest(list_distinct(
            CASE WHEN length(base) <= 5 THEN [base] WHEN n = 1 THEN [base, fbase]
                 ELSE [a || ' ' || b, a || ' ' || fb, fa || ' ' || b, fa || ' ' || fb] END)) surface FROM flipped)"""
SURFACES = f"{KEYWORDS}, {FORMS}, sd AS (SELECT surface, arg_max(base, (tech_pos, base)) base FROM forms GROUP BY surface)"
SHORT_SURFACES = f"""{KEYWORDS}, sd AS (SELECT DISTINCT base AS surface, base FROM kd WHERE length(base) <= 5)"""

_LITERAL = _values([(tech, i, raw) for i, (tech, raws) in enumerate(SHEETS.items(), start=1) for raw in raws])
LITERAL_SHEETS = f"sheets(tech, tech_pos, raw) AS (VALUES {_LITERAL})"

DERIVED_SHEETS = f"""
c AS (SELECT role, {CLEAN.format("text")} k FROM conversations),
cg AS (SELECT role, unnest(k) gram FROM c UNION ALL SELECT role, unnest({PAIRS.format("k")}) FROM c),
sheets AS (SELECT role AS tech, list_position(['assistant', 'system', 'user'], role)::INTEGER tech_pos,
                  replace(gram, ' ', '_') || (length(gram) % 10) raw FROM cg)"""



def _hits(sheets: str) -> str:
    return f"""{sheets}, {SURFACES}, {GRAMS},
hits AS (SELECT doc_id, tech, sd.base FROM grams JOIN sd ON gram = surface JOIN kd ON sd.base = kd.base)"""


def _counted(sheets: str) -> str:
    return f"{_hits(sheets)}, keyword_n AS (SELECT doc_id, tech, base, count(*) n FROM hits GROUP BY ALL)"


HITS, COUNTED = _hits(LITERAL_SHEETS), _counted(LITERAL_SHEETS)

_BASES = sorted({raw.translate(str.maketrans("_", " ", "0123456789")) for raws in SHEETS.values() for raw in raws})
_WIDE = ", ".join(f"sum(CASE WHEN base = {_str(b)} THEN 1 END)::BIGINT AS \"{b}\"" for b in _BASES)

SNIPPET = "regexp_replace(lower(text), '[^a-zA-Z ]', ' ', 'g')"


def _snippets(bound: str | None, counted: str = COUNTED) -> str:
    chosen = f"WHERE md5(concat_ws('|', k.doc_id, tech, base))[1:8] < '{bound}'" if bound else ""
    return f"""WITH {counted}
SELECT tech, k.doc_id::VARCHAR AS job_id, base AS keyword, d.lang AS job_title, d.source AS occupation,
       {SNIPPET} AS jobtext
FROM keyword_n k JOIN documents d ON k.doc_id = d.doc_id {chosen}"""


ARCHIVE = "printf('US_%05d.zip', doc_id // 200)"
YEAR = "(2010 + (doc_id // 200) % 3)::INTEGER"


def _label_words(label: str) -> str:
    spaced = "".join(c if c in "abcdefghijklmnopqrstuvwxyz" else " " for c in label.lower())
    return "[" + ", ".join(_str(w) for w in sorted(set(spaced.split()))) + "]"


RANKED = """e AS (SELECT doc_id, label, pos, exp(s - max(s) OVER (PARTITION BY doc_id)) e FROM raw),
p AS (SELECT doc_id, label, pos, e / sum(e) OVER (PARTITION BY doc_id) score, e FROM e)
SELECT doc_id, label, round(score, 6) AS score,
       (row_number() OVER (PARTITION BY doc_id ORDER BY e DESC, pos))::INTEGER AS rank FROM p"""


def _label_scores(labels: list[str]) -> str:
    rows = ", ".join(f"({_str(label)}, {i}, {_label_words(label)})" for i, label in enumerate(labels))
    return f"""WITH labels_given(label, pos, words) AS (VALUES {rows}),
t AS (SELECT doc_id, length(text) n_len, {CLEAN.format("text")} k FROM documents),
raw AS (SELECT doc_id, label, pos,
               100.0::DOUBLE * len(list_filter(k, lambda x: list_contains(words, x))) / greatest(n_len, 1) s
        FROM t, labels_given),
{RANKED}"""


def _model_scores(labels: list[str], power: float) -> str:
    rows = _values([(label, i, label[0].lower()) for i, label in enumerate(labels)])
    return f"""WITH labels_given(label, pos, letter) AS (VALUES {rows}),
raw AS (SELECT doc_id, label, pos, pow(100.0::DOUBLE * (length(lower(text)) - length(replace(lower(text), letter, '')))
               / greatest(length(text), 1), {power}::DOUBLE) s FROM documents, labels_given),
{RANKED}"""


SYMBOLS = """
grouped AS (SELECT page_id // 10 AS request_id, list(substring(url, 5) ORDER BY page_id) s FROM pages GROUP BY 1),
asked AS (SELECT request_id, unnest(list_append(s, '://absent/' || request_id)) symbol,
                 unnest(range(0, len(s) + 1)) pos FROM grouped)"""

AD_TEXT = "regexp_extract(html, '<div[^>]*class=\"ad\"[^>]*>([^<]*)</div>', 1)"
ANSWERS = f"""{SYMBOLS},
found AS (SELECT url, {AD_TEXT} v FROM pages),
answered AS (SELECT request_id, pos, symbol,
                    CASE WHEN url IS NULL THEN 'missing page' WHEN v = '' THEN 'element not found' ELSE v END AS value
             FROM asked LEFT JOIN found ON 'http' || symbol = url)"""

JSON_TEXT = "to_json({0})"

ORACLES: dict[str, str] = {
    "clean_tokens": f"WITH {TRIMMED} SELECT doc_id, len(g)::INTEGER AS n_tokens, array_to_string(g, ' ') AS tokens FROM t",
    "trim_tokens": f"WITH {TRIMMED} SELECT doc_id, len(k)::INTEGER AS n_tokens, array_to_string(k, ' ') AS tokens FROM w",
    "clean_bigrams": f"""WITH {TRIMMED}, p AS (SELECT doc_id, {PAIRS.format("k")} p FROM w)
SELECT doc_id, len(p)::INTEGER AS n_bigrams, array_to_string(p, '|') AS bigrams FROM p""",
    "nlp_tokens": f"WITH {RAW_TOKENS} SELECT doc_id, len(k)::INTEGER AS n_tokens, array_to_string(k, ' ') AS tokens FROM r",
    "nlp_ngrams": f"""WITH {RAW_TOKENS},
p AS (SELECT doc_id, list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]) g FROM r)
SELECT doc_id, len(g)::INTEGER AS n_grams, array_to_string(g, '|') AS grams FROM p""",
    "nested_project": f"""WITH {RAW_TOKENS}, p AS (SELECT doc_id, {PAIRS.format("k")} p FROM r)
SELECT doc_id, len(p)::INTEGER AS n, array_to_string(p, '|') AS result FROM p""",
    "keyword_dict": f"WITH {DERIVED_SHEETS}, {KEYWORDS} SELECT tech, base FROM kd",
    "keyword_sheets": f"WITH {DERIVED_SHEETS}, {KEYWORDS} SELECT tech, tech_pos, base FROM kd",
    "dict_size": f"WITH {DERIVED_SHEETS}, {KEYWORDS} SELECT tech, count(DISTINCT base) AS n_words FROM kd GROUP BY tech",
    "inflect": f"WITH {DERIVED_SHEETS}, {KEYWORDS}, {FORMS} SELECT base, surface FROM forms",
    "surface_dict": f"WITH {DERIVED_SHEETS}, {SURFACES} SELECT surface, base FROM sd",
    "surface_dict_short": f"WITH {DERIVED_SHEETS}, {SHORT_SURFACES} SELECT surface, base FROM sd",
    "gram_counts_per_job": f"WITH {GRAMS} SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY ALL",
    "surface_counts_per_job": f"""WITH {LITERAL_SHEETS}, {SURFACES}, {GRAMS}
SELECT doc_id, gram, count(*) AS n FROM grams JOIN sd ON gram = surface GROUP BY ALL""",
    "keyword_counts": f"WITH {COUNTED} SELECT doc_id, tech, base, n FROM keyword_n",
    "keyword_counts_short": f"""WITH {LITERAL_SHEETS}, {SHORT_SURFACES}, {GRAMS}
SELECT doc_id, tech, sd.base AS base, count(*) AS n
FROM grams JOIN sd ON gram = surface JOIN kd ON sd.base = kd.base GROUP BY ALL""",
    "keyword_counts_large": f"WITH {_counted(DERIVED_SHEETS)} SELECT doc_id, tech, base, n FROM keyword_n",
    "keyword_counts_shuffled": f"WITH {_counted(DERIVED_SHEETS)} SELECT doc_id, tech, base, n FROM keyword_n",
    "job_semi_large": f"""WITH {_hits(DERIVED_SHEETS)} SELECT doc_id, lang, source FROM documents d
WHERE EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = d.doc_id)""",
    "job_semi_words": f"""WITH words AS (SELECT DISTINCT unnest({CLEAN.format("text")}) w FROM conversations), {GRAMS}
SELECT doc_id, lang, source FROM documents d
WHERE EXISTS (SELECT 1 FROM grams g JOIN words ON gram = w WHERE g.doc_id = d.doc_id)""",
    "snippet_sample_large": _snippets("00418937", _counted(DERIVED_SHEETS)),
    "job_semi": f"""WITH {HITS} SELECT doc_id, lang, source FROM documents d
WHERE EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = d.doc_id)""",
    "job_techs": f"""WITH {HITS}, one AS (SELECT DISTINCT doc_id, tech FROM hits)
SELECT doc_id, string_agg(tech, ',' ORDER BY tech) AS techs FROM one GROUP BY doc_id""",
    "counts_wide": f"WITH {HITS} SELECT doc_id, tech, {_WIDE} FROM hits GROUP BY doc_id, tech",
    "snippet_rows": _snippets(None),
    "snippet_sample": _snippets("19999999"),
    "snippet_sample_rare": _snippets("00418937"),
    "bigram_count": f'WITH {BIGRAMS} SELECT bigram, "count" FROM counts',
    "bigram_sorted": f'WITH {BIGRAMS} SELECT bigram, "count" FROM counts ORDER BY "count" DESC, bigram',
    "bigram_topk": f'WITH {BIGRAMS} SELECT bigram, "count" FROM counts ORDER BY "count" DESC, bigram LIMIT 100',
    "cast_count": f'WITH {BIGRAMS} SELECT bigram, "count"::INTEGER AS "count" FROM counts',
    "row_counts": f"""WITH {BIGRAMS} SELECT 'documents' AS name, count(*) AS n FROM documents
UNION ALL SELECT 'bigrams', count(*) FROM counts""",
    "base_lookup": f"""WITH {BIGRAMS} SELECT bigram, "count" FROM counts WHERE bigram = 'of the'""",
    "band_filter": f"""WITH {BIGRAMS}, c AS (SELECT "count"::DOUBLE c FROM counts WHERE bigram = 'of the')
SELECT bigram, "count" FROM counts, c
WHERE "count" < c * (1 + 0.7::DOUBLE) AND "count" > c * (1 - 0.7::DOUBLE)""",
    "synonym_candidates": f"""WITH {BIGRAMS}, c AS (SELECT "count"::DOUBLE c FROM counts WHERE bigram = 'of the')
SELECT bigram, "count" FROM counts, c
WHERE "count" < c * (1 + 0.7::DOUBLE) AND "count" > c * (1 - 0.7::DOUBLE) AND contains(bigram, 'the')""",
    "parquet_roundtrip": f'WITH {BIGRAMS} SELECT bigram, "count" FROM counts',
    "label_score": _label_scores(LABELS),
    "label_score_frequent": _label_scores(FREQUENT_LABELS),
    "label_score_many": f"""WITH c AS (SELECT {CLEAN.format("text")} k FROM conversations),
n AS (SELECT DISTINCT k[1] || ' ' || k[2] AS label FROM c WHERE len(k) >= 2),
g AS MATERIALIZED (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos FROM n),
w AS MATERIALIZED (SELECT DISTINCT pos, unnest(string_split(label, ' ')) AS word FROM g),
t AS (SELECT doc_id, length(text) AS n_len, unnest({CLEAN.format("text")}) AS word FROM documents),
h AS (SELECT doc_id, pos, count(*) AS n FROM t JOIN w USING (word) GROUP BY ALL),
raw AS (SELECT d.doc_id, g.label, g.pos, 100.0::DOUBLE * coalesce(h.n, 0) / greatest(length(d.text), 1) AS s
        FROM documents d CROSS JOIN g LEFT JOIN h ON h.doc_id = d.doc_id AND h.pos = g.pos),
m AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top FROM raw),
e AS (SELECT doc_id, label, pos, s, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY doc_id) AS score FROM m)
SELECT doc_id, label, round(score, 6) AS score,
       (row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, pos))::INTEGER AS rank FROM e QUALIFY rank <= 10""",
    "label_score_model": _model_scores(LABELS, 0.5),
    "label_list": """WITH l AS (SELECT DISTINCT p_name AS label FROM part)
SELECT ((row_number() OVER (ORDER BY label) - 1) * 2)::INTEGER AS pos, label FROM l WHERE trim(label) <> ''""",
    "page_extract": f"WITH {ANSWERS} SELECT request_id, symbol, value FROM answered",
    "page_extract_missing": f"""WITH {SYMBOLS}
SELECT request_id, symbol, CASE WHEN url IS NULL THEN 'missing page' ELSE 'element not found' END AS value
FROM asked LEFT JOIN pages ON 'http' || symbol = url""",
    "page_json": f"""WITH {ANSWERS}
SELECT request_id, '{{' || string_agg(to_json(symbol)::VARCHAR || ':' || to_json(value)::VARCHAR, ',' ORDER BY pos) || '}}'
       AS body FROM answered GROUP BY request_id""",
    "page_response": f"""WITH {ANSWERS}
SELECT request_id, symbol,
       '{{"statusCode":' || CASE value WHEN 'missing page' THEN '404' ELSE '200' END || ',"body":'
       || to_json(to_json(CASE WHEN value IN ('missing page', 'element not found') THEN 'Error: ' || value
                               ELSE symbol || ': ' || value END)::VARCHAR)::VARCHAR || '}}' AS response FROM answered""",
    "xml_scan": """SELECT doc_id::VARCHAR AS "JobID", lang AS "CanonJobTitle", source AS "BGTOcc", text AS "JobText"
FROM documents""",
    "xml_framed_scan": """SELECT doc_id::VARCHAR AS "JobID", lang AS "CanonJobTitle", source AS "BGTOcc",
       text AS "JobText" FROM documents WHERE text <> ''""",
    "xml_infer": """WITH f AS (SELECT unnest([{'c': 'BGTOcc', 'v': source}, {'c': 'CanonJobTitle', 'v': lang},
  {'c': 'JobID', 'v': doc_id::VARCHAR}, {'c': 'JobText', 'v': text}]) AS f FROM documents),
k AS (SELECT f.c AS "column", trim(f.v) AS v FROM f WHERE trim(f.v) <> '')
SELECT "column", CASE WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+') AND TRY_CAST(v AS BIGINT) IS NOT NULL) THEN 'bigint'
  WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]*[.]?[0-9]+([eE][+-]?[0-9]+)?')) THEN 'double'
  WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'boolean' ELSE 'string' END AS "type"
FROM k GROUP BY 1""",
    "zip_scan": f"""SELECT {YEAR} AS year, {ARCHIVE} AS source_file, doc_id::VARCHAR AS "JobID",
       lang AS "CanonJobTitle", source AS "BGTOcc", text AS "JobText" FROM documents WHERE text <> ''""",
    "zip_years": f"""SELECT {YEAR} AS year, {ARCHIVE} AS source_file, doc_id::VARCHAR AS "JobID",
       length(text)::INTEGER AS n_chars FROM documents WHERE text <> '' AND {YEAR} <> 2011""",
    "archives_nested": f"""SELECT {YEAR} AS year,
       CASE WHEN (doc_id // 200) % 2 = 0 THEN 'US/east/' ELSE '' END || {ARCHIVE} AS source_file,
       doc_id::VARCHAR AS "JobID", length(text)::INTEGER AS n_chars
FROM documents WHERE text <> '' AND (doc_id // 200) % 5 <> 4 AND {YEAR} IN (2010, 2012)""",
    "archives_left_out": f"""WITH a AS (SELECT DISTINCT {ARCHIVE} AS archive, {YEAR} AS year, (doc_id // 200) % 5 AS k FROM documents)
SELECT archive, CASE WHEN k = 4 THEN 'no year' ELSE 'other year' END AS reason FROM a WHERE k = 4 OR year = 2011""",
    "archives_incremental": f"""SELECT {YEAR} AS year, {ARCHIVE} AS source_file, doc_id::VARCHAR AS "JobID",
       lang AS "CanonJobTitle", source AS "BGTOcc", text AS "JobText" FROM documents WHERE text <> ''""",
    "archives_replaced": f"""WITH d AS (SELECT {YEAR} AS year, {ARCHIVE} AS source_file, (doc_id // 200) % 4 AS k FROM documents),
s AS (SELECT unnest(['first', 'failed', 'done']) AS step)
SELECT step, year, source_file, count(*) AS n FROM d, s WHERE step <> 'done' OR k <> 1 GROUP BY ALL""",
    "xml_reject": f"SELECT {ARCHIVE} AS source_file, doc_id::VARCHAR AS job_id FROM documents WHERE lang = 'de'",
    "ingest_tally": f"""SELECT {ARCHIVE} AS source_file, count(*) AS processed,
       sum(CASE WHEN lang = 'de' THEN 1 ELSE 0 END)::BIGINT AS rejected FROM documents GROUP BY 1""",
    "archive_keyword_counts": f"""WITH {COUNTED}
SELECT {ARCHIVE.replace("doc_id", "k.doc_id")} AS source_file, k.doc_id::VARCHAR AS job_id, tech, base, n
FROM keyword_n k JOIN documents d ON k.doc_id = d.doc_id WHERE d.lang <> 'de'""",
    "text_scan": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS value, text FROM documents)
SELECT value, count(*) AS n FROM l GROUP BY value""",
    "required_fields": """SELECT doc_id, CASE WHEN lang <> 'fr' THEN doc_id::VARCHAR ELSE '0' END AS "JobID",
       lang AS "CanonJobTitle", CASE WHEN source = 'src5' THEN '' ELSE source END AS "BGTOcc",
       length(text)::INTEGER AS n_chars
FROM documents WHERE source NOT IN ('src3', 'src7', 'src9') AND text <> ''""",
    "year_select": """SELECT year(o_orderdate)::INTEGER AS year, o_orderkey, o_totalprice FROM orders
WHERE year(o_orderdate) BETWEEN 1995 AND 1999 AND year(o_orderdate) NOT IN (1997)""",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 70",
    "file_rename": """WITH s AS (SELECT DISTINCT lang || '_' || source AS stem FROM documents),
f AS (SELECT unnest([stem || '.zip', stem || '_zip.zip']) AS source_file FROM s)
SELECT source_file, regexp_replace(source_file, '.zip', '.csv', 'g') AS output_file FROM f""",
    "counts_sink": f"""WITH {COUNTED}
SELECT replace({ARCHIVE}, '.zip', '.csv') AS source_file, doc_id::VARCHAR AS job_id, tech, base, n FROM keyword_n""",
    "job_keyword_counts": f"""WITH {COUNTED}
SELECT {YEAR.replace("doc_id", "k.doc_id")} AS year, printf('US_%05d.csv', k.doc_id // 600) AS source_file,
       k.doc_id::VARCHAR AS job_id, tech, base, n
FROM keyword_n k JOIN documents d ON k.doc_id = d.doc_id WHERE d.lang <> 'de'""",
    "snippet_sink": f"""WITH {COUNTED}
SELECT tech, replace({ARCHIVE.replace("doc_id", "k.doc_id")}, '.zip', '.csv') AS source_file,
       k.doc_id::VARCHAR AS job_id, base AS keyword, d.lang AS job_title, d.source AS occupation, {SNIPPET} AS jobtext
FROM keyword_n k JOIN documents d ON k.doc_id = d.doc_id
WHERE md5(concat_ws('|', replace({ARCHIVE.replace("doc_id", "k.doc_id")}, '.zip', '.csv'), k.doc_id, tech, base))[1:8]
      < '19999999'""",
}
