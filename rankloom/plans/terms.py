"""Terms and extracts of texts, on probes made of the tables' own words; each with SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.plans.registry import query, sql_list
from rankloom.plans.rules import _probes, _probes_sql, _words, _words_sql

TERM_WORDS = ["camelCase", "HTTPServer", "parsingQueries", "snake_case_name", "v12", "Traceback", "models", "could", "pkg.mod.Thing", "ab", "if", "boxes"]
TERM_FORMS = [
    "X", "see `mod.X.f` and my_X or camelX plain", "X fails with aX.bX_c in Xing the Xies", "`X y` and `a.b` `X` `__X__`", "error: X using v1.2.3 of 10.20 with X", "X.y_z X_1 X9 9X", "",
]
DOTTED = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"


def _split_sql(stop: list[str], stem: bool) -> str:
    known = f"length({{0}}) >= 3 AND {{0}} NOT IN ({sql_list(stop)})"
    tokens = f"list_filter(list_transform(regexp_extract_all(regexp_replace(probe, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: {known.format('t')})"
    if not stem:
        return tokens
    forms = "[CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN t[:-4] END, CASE WHEN t LIKE '%ies' AND length(t) > 5 THEN t[:-4] || 'y' END, CASE WHEN t LIKE '%s' AND length(t) > 4 THEN t[:-2] END]"
    return f"flatten(list_transform({tokens}, lambda t: list_concat([t], list_filter({forms}, lambda s: s IS NOT NULL AND {known.format('s')}))))"


STOP = sql_list(tx.PROJECTION_STOP_WORDS)
CODE_LIKE = f"list_filter(list_transform(list_filter(regexp_extract_all(probe, '{DOTTED}'), lambda t: regexp_matches(t, '[_.0-9]|[a-z][A-Z]')), lambda t: lower(t)), lambda t: length(t) >= 3 AND t NOT IN ({STOP}))"
CODE_PARTS = f"flatten(list_transform({CODE_LIKE}, lambda t: list_filter(CASE WHEN contains(t, '.') THEN [string_split(t, '.')[-1]] ELSE regexp_split_to_array(t, '_+') END, lambda p: length(p) >= 3 AND p NOT IN ({STOP}))))"
SPANS = f"list_filter(flatten(list_transform(regexp_extract_all(probe, '`([^`]+)`', 1), lambda s: list_transform(regexp_extract_all(s, '{DOTTED}'), lambda t: lower(t)))), lambda t: length(t) >= 3)"
SPAN_PARTS = f"flatten(list_transform({SPANS}, lambda t: list_filter(string_split(t, '.'), lambda p: length(p) >= 3)))"
LOOSE = f"list_filter(list_transform(list_filter(regexp_extract_all(probe, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: regexp_matches(t, '_|[a-z][A-Z]')), lambda t: lower(t)), lambda t: length(t) >= 3 AND t NOT IN ({sql_list(tx.EVIDENCE_STOP_WORDS)}))"
NAMES = f"list_filter(regexp_extract_all(lower(probe), '{DOTTED}'), lambda t: length(t) >= 3)"
NAME_PARTS = f"flatten(list_transform({NAMES}, lambda t: list_filter(string_split(t, '.'), lambda p: length(p) >= 3)))"
CONTEXT = f"""list_concat(list_filter(list_transform(regexp_extract_all(probe, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda t: lower(t)), lambda t: t NOT IN ({sql_list(tx.CONTEXT_STOP_WORDS)})), list_transform(regexp_extract_all(probe, '(?i)\\bv?\\d+(?:\\.\\d+){{1,4}}\\b'), lambda t: lower(t)))"""


def _set_sql(e: str) -> str:
    return f"array_to_string(list_sort(list_distinct({e})), ' ')"


def _set(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), " ")


@query(
    f"""WITH {_words_sql(TERM_WORDS)}, {_probes_sql(TERM_FORMS)}
    SELECT probe, array_to_string({_split_sql(tx.EVIDENCE_STOP_WORDS, False)}, ' ') AS evidence, array_to_string({_split_sql(tx.JAVA_STOP_WORDS, True)}, ' ') AS java, {_set_sql(f'list_concat({CODE_LIKE}, {CODE_PARTS})')} AS code_like,
      {_set_sql(f'list_concat(list_concat({SPANS}, {SPAN_PARTS}), {LOOSE})')} AS anchors, {_set_sql(f'list_concat({NAMES}, {NAME_PARTS})')} AS candidates, {_set_sql(CONTEXT)} AS context FROM p"""
)
def text_terms(spark, sf):
    p = F.col("probe")
    ordered = lambda c: F.array_join(c, " ")
    rows = _probes(_words(spark, sf, TERM_WORDS), TERM_FORMS)
    return rows.select(
        "probe", ordered(tx.evidence_terms(p)).alias("evidence"), ordered(tx.java_terms(p)).alias("java"), _set(tx.code_like_terms(p)).alias("code_like"),
        _set(tx.anchor_terms(p)).alias("anchors"), _set(tx.candidate_terms(p)).alias("candidates"), _set(tx.context_tokens(p)).alias("context"),
    )


EXTRACT_FORMS = [
    "in a/X.py and b/X.rst, X.java", "./X.cpp:12 X.ts, X.tsx", "x\n```py\nX\ny\n```\nz\n```\nX2\n```", "<patch>\n X\n</patch> ```diff\nno\n```", "```diff\nX\n```", "X", "t ```json\n{\"X\": 1}\n``` u", "a <!-- X\n b --> c\n\n\n\nd ",
    "s\n-----BEGIN PGP SIGNATURE-----\nX\n-----END PGP SIGNATURE-----\n", "1:02:03.5", "X:00:10",
]


@query(
    f"""WITH {_words_sql([])}, {_probes_sql(EXTRACT_FORMS)}
    SELECT probe, array_to_string(list_sort(list_distinct(regexp_extract_all(probe, '[A-Za-z0-9_./-]+\\.(?:py|java|cpp|c|h|js|ts|go|rs)\\b'))), ' ') AS files, array_to_string(regexp_extract_all(probe, '(?s)```[A-Za-z0-9_+-]*\\n(.*?)```', 1), '|') AS blocks,
      CASE WHEN regexp_matches(probe, '(?s)<(patch|diff)>\\s*(.*?)</(patch|diff)>') AND regexp_extract(probe, '(?s)<(?:patch|diff)>\\s*(.*?)</(?:patch|diff)>', 1) <> '' THEN regexp_extract(probe, '(?s)<(?:patch|diff)>\\s*(.*?)</(?:patch|diff)>', 1)
        WHEN regexp_extract(probe, '(?s)```(?:diff|patch)?\\n(.*?)```', 1) <> '' THEN regexp_extract(probe, '(?s)```(?:diff|patch)?\\n(.*?)```', 1) ELSE probe END AS diff,
      CASE WHEN regexp_extract(probe, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) <> '' THEN regexp_extract(probe, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) ELSE probe END AS json,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(probe, '(?s)<!--.*?-->', chr(10), 'g'), '(?si)-----BEGIN PGP SIGNATURE-----.*?-----END PGP SIGNATURE-----', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM p"""
)
def text_extracts(spark, sf):
    p = F.col("probe")
    rows = _probes(_words(spark, sf, []), EXTRACT_FORMS)
    return rows.select("probe", _set(tx.file_mentions(p)).alias("files"), F.array_join(tx.code_blocks(p), "|").alias("blocks"), tx.diff_of_answer(p).alias("diff"), tx.json_of_answer(p).alias("json"), tx.clean_issue(p).alias("cleaned"))
