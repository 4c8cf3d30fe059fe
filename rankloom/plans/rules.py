"""Rules over names, paths, messages and references, on probes made of the tables' own words; each with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import predicates as pr
from rankloom.functions import text as tx
from rankloom.operators import audit
from rankloom.plans.registry import query, sql_list
from rankloom.sources.tables import table

#: Templates that turn a word (X) into names and paths which the rules tell apart.
NAME_FORMS = [
    "X", "X_y", "np.X", "np.X_y", "self.size", "X.append", "x.X", "a.X.write", "Abc.get", "a/X.py", "X.py", "tests/X.py", "test_X", "testX", "X.rst", "a.test.X", "assertX", "`X.f`",
    "me@X.org", "www.X.com", "__X__", "X.Y", "a b", "X0123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890", "conf.py", "pkg/conf.py", "",
]
PATH_FORMS = ["X", "a/X", "X/a.py", "a/X/b.py", "a/X.md", "a/X.tar.gz", ".X", "a\\X\\b", "contest/X", "a/.X.md"]
MESSAGE_FORMS = ["X", "Add X\n\nmore", "  X: change\nb", "a\nX it", "a\nb\nX", "a\nb\nc\nX", "preX", "X1", "\n\nRUN X"]


def _words(spark: SparkSession, sf: str, fixed: list[str]) -> DataFrame:
    """Distinct words of part types and names, and fixed ones."""
    parts = table(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", "p_type", "p_name", "p_brand"), " ")).alias("word"))
    named = spark.createDataFrame([(w,) for w in fixed], "word string")
    return parts.unionByName(parts.select(F.initcap("word").alias("word"))).unionByName(named).distinct()


def _words_sql(fixed: list[str]) -> str:
    return f"""raw AS (SELECT unnest(string_split(concat_ws(' ', p_type, p_name, p_brand), ' ')) AS word FROM part),
    w AS (SELECT word FROM raw UNION SELECT upper(left(word, 1)) || lower(substr(word, 2)) FROM raw UNION SELECT unnest([{sql_list(fixed)}]::VARCHAR[]))"""


def _probes(words: DataFrame, forms: list[str]) -> DataFrame:
    filled = F.explode(F.array(*[F.replace(F.lit(f), F.lit("X"), F.col("word")) for f in forms]))
    return words.select(filled.alias("probe")).distinct()


def _probes_sql(forms: list[str]) -> str:
    lines = ", ".join("'" + f.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for f in forms)
    return f"p AS (SELECT DISTINCT replace(f, 'X', word) AS probe FROM w CROSS JOIN (SELECT unnest([{lines}]) AS f))"


CODE_WORDS = [*pr.COMMON_WORDS, *pr.DUNDER_NAMES, *pr.GENERIC_BASENAMES, *pr.LOCAL_PREFIXES, *pr.GENERIC_TARGETS]


@query(
    f"""WITH {_words_sql(CODE_WORDS)}, {_probes_sql(NAME_FORMS)},
    n AS (SELECT probe, regexp_replace(regexp_replace(probe, '^\\s+|\\s+$', '', 'g'), '^[`''"]+|[`''"]+$', '', 'g') AS name FROM p),
    d AS (SELECT *, string_split(name, '.') AS dots, regexp_split_to_array(name, '[/\\\\]')[-1] AS leaf, list_filter(regexp_split_to_array(name, '[./\\\\]+'), lambda x: x <> '') AS parts FROM n),
    t AS (SELECT *, CASE WHEN dots[-1] = 'py' AND len(dots) > 1 THEN dots[-2] ELSE dots[-1] END AS target, coalesce(parts[1], '') AS first_ FROM d),
    f AS (SELECT *, name = '' OR regexp_matches(name, '(?i)(^|[\\s<])[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{{2,}}\\b|\\b(https?://|www\\.)?\\w[\\w.-]*\\.(com|org|net|edu|gov|io|dev|ai|fr)\\b')
        OR length(name) > 80 AND NOT regexp_matches(name, '[/\\\\]') OR contains(leaf, '.') AND '.' || lower(string_split(leaf, '.')[-1]) IN ({sql_list(pr.NON_SOURCE_EXTENSIONS)})
        OR lower(target) LIKE 'assert%' OR lower(target) LIKE 'assume%' OR lower(target) IN ({sql_list(pr.COMMON_WORDS + pr.DUNDER_NAMES)})
        OR leaf LIKE '%.py' AND NOT regexp_matches(name, '[/\\\\]') AND lower(left(leaf, -3)) IN ({sql_list(pr.GENERIC_BASENAMES)})
        OR len(list_filter(parts, lambda x: lower(x) LIKE 'test\\_%' ESCAPE '\\' OR lower(x) IN ('test', 'tests') OR regexp_matches(x, '^test[A-Z]'))) > 0 AS dropped FROM t)
    SELECT probe, CASE WHEN dropped THEN false WHEN regexp_matches(name, '[./\\\\]') THEN length(target) > 1
        AND NOT (lower(first_) IN ({sql_list(pr.LOCAL_PREFIXES)}) AND NOT regexp_matches(target, '[A-Z][a-z]+') AND NOT contains(target, '_'))
        AND NOT (lower(target) IN ({sql_list(pr.GENERIC_TARGETS)}) AND NOT regexp_matches(first_, '[A-Z][a-z]+'))
      ELSE contains(target, '_') OR upper(target) = target AND lower(target) <> target AND length(target) BETWEEN 2 AND 12 OR regexp_matches(target, '[a-z][A-Z]|[A-Z][a-z]+[A-Z]') END AS is_code FROM f"""
)
def code_references(spark, sf):
    probes = _probes(_words(spark, sf, CODE_WORDS), NAME_FORMS)
    return probes.select("probe", pr.is_code_reference(F.col("probe")).alias("is_code"))


PATH_WORDS = [*pr.NON_PRODUCTION, *pr.BOILERPLATE_DOCS, "LICENSE", "Security"]


@query(
    f"""WITH {_words_sql(PATH_WORDS)}, {_probes_sql(PATH_FORMS)}, n AS (SELECT probe, lower(replace(probe, '\\', '/')) AS path FROM p), s AS (SELECT *, string_split(path, '/') AS parts FROM n)
    SELECT probe, regexp_replace(parts[-1], '^(\\.*[^.].*)\\.[^.]*$', '\\1') IN ({sql_list(pr.BOILERPLATE_DOCS)}) OR len(list_filter([{sql_list(pr.BOILERPLATE_DOCS)}], lambda b: contains(path, '/' || b || '/'))) > 0 AS boilerplate,
      len(list_intersect(parts, [{sql_list(pr.NON_PRODUCTION)}])) > 0 AS not_production FROM s"""
)
def path_rules(spark, sf):
    probe = F.col("probe")
    return _probes(_words(spark, sf, PATH_WORDS), PATH_FORMS).select("probe", pr.is_boilerplate_doc(probe).alias("boilerplate"), pr.skips_production(probe).alias("not_production"))


MESSAGE_WORDS = (
    "pyupgrade pre-commit precommit black isort ruff flake8 pylint format formatting style lint whitespace typo spelling docstring sphinx warning codestyle D100 b1234 SIM99 SIM999 RUF100 "
    "E501 W60 F401 dependabot bump changelog fix fixes fixed bug bugfix error fail failed fails failure regression incorrect incorrectly wrong crash crashes crashed exception broken "
    "repair resolve resolved resolves invalid"
).split() + ["release notes"]
FIRST_LINES = "array_to_string(string_split(regexp_replace(probe, '^\\s+|\\s+$', '', 'g'), chr(10))[1:{0}], chr(10))"


@query(
    f"""WITH {_words_sql(MESSAGE_WORDS)}, {_probes_sql(MESSAGE_FORMS)}
    SELECT probe, regexp_matches({FIRST_LINES.format(1)}, '{pr.MAINTENANCE}') AS maintenance, regexp_matches({FIRST_LINES.format(3)}, '{pr.REPAIR}') AS repair FROM p"""
)
def commit_rules(spark, sf):
    probe = F.col("probe")
    return _probes(_words(spark, sf, MESSAGE_WORDS), MESSAGE_FORMS).select("probe", pr.is_maintenance(probe).alias("maintenance"), pr.is_repair(probe).alias("repair"))


#: References to an issue N of a repository, and to others, as texts hold them.
REFERENCE_FORMS = [
    "fixes #N", "Closed  #N.", "see N", "#N", "a#N", "(#N)", "#N-x", "#N_", "##N", "issue N", "PR#N", "pull  request # N", "xpr N", "a/#N", "https://github.com/o/r/pull/N", "https://github.com/o/r/issues/N#c-1) b",
    "https://github.com/o/s/pull/N?x=1", "HTTPS://GITHUB.COM/o/r/pulls/N", "https://code.djangoproject.com/ticket/N", "resolve #N, #1 and #2", "#1,#N", "issue N0",
]


def _references(spark: SparkSession, sf: str) -> DataFrame:
    """A text per item and form: the item's own text, then the reference."""
    filled = F.explode(F.array(*[F.concat(F.col("text"), F.lit(" "), F.replace(F.lit(f), F.lit("N"), F.col("item_id").cast("string"))) for f in REFERENCE_FORMS]))
    return table(spark, sf, "benchmark").select("item_id", "text").select("item_id", filled.alias("probe"))


REFERENCES_SQL = f"r AS (SELECT item_id, text || ' ' || replace(f, 'N', item_id::VARCHAR) AS probe FROM benchmark CROSS JOIN (SELECT unnest([{sql_list(REFERENCE_FORMS)}]) AS f))"
MASK_SQL = f"'{tx.MASK}'"


@query(
    f"""WITH {REFERENCES_SQL}, a AS (SELECT *, regexp_replace(probe, '(?i)https?://github\\.com/[^\\s<>)\\]]+/(pull|pulls|issues)/' || item_id || '([#?][^\\s<>)\\]]*)?', {MASK_SQL}, 'g') AS x FROM r),
    b AS (SELECT *, regexp_replace(regexp_replace(x, '(?i)https?://code\\.djangoproject\\.com/ticket/' || item_id || '([#?][^\\s<>)\\]]*)?', {MASK_SQL}, 'g'), '(?i)\\b(pr|pull\\s+request|pull|issue)\\s*#?\\s*' || item_id || '\\b', {MASK_SQL}, 'g') AS y FROM a)
    SELECT item_id, probe, regexp_replace(y, '(^|[^\\w/])#\\s*' || item_id || '\\b', '\\1' || {MASK_SQL}, 'g') AS masked FROM b"""
)
def redacted_targets(spark, sf):
    return _references(spark, sf).select("item_id", "probe", tx.redact_reference(F.col("probe"), F.col("item_id")).alias("masked"))


@query(
    f"""WITH {REFERENCES_SQL}, x AS (SELECT item_id, probe, list_concat(list_concat(regexp_extract_all(probe, '(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\\s+#(\\d+)', 1),
      regexp_extract_all(regexp_replace(probe, '([^A-Za-z0-9_#-])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9_])#(\\d+)(?:$|[^A-Za-z0-9_-])', 1)), list_concat(regexp_extract_all(probe, 'https://github\\.com/o/r/(?:issues|pull)/(\\d+)', 1),
      CASE WHEN item_id % 2 = 0 THEN [] ELSE [] END)) AS ids FROM r)
    SELECT item_id, probe, array_to_string(list_sort(list_transform(list_distinct(ids), lambda i: i::BIGINT)), ',') AS ids FROM x"""
)
def reference_numbers(spark, sf):
    ids = tx.reference_ids(F.col("probe"), F.lit("o/r"))
    return _references(spark, sf).select("item_id", "probe", F.array_join(F.array_sort(ids), ",").alias("ids"))


ANSWERS = ["X", "X <<<<<<< SEARCH a", "I Need More Context", "x", "", *[f"so: {m}" for m in pr.CONTEXT_MARKERS + pr.REFUSAL_MARKERS]]
ERRORS = ["", "no hit", "No Changes were made", "x: NO EFFECTIVE edit commands", *[m.upper() for m in pr.INFRASTRUCTURE_MARKERS + pr.REFUSAL_MARKERS[:2] + pr.CONTEXT_MARKERS[-1:]]]


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts by event: an answer, two messages and counts, picked by the event's user, value and type."""
    n, tenths, type_ = F.col("user_id"), F.floor(F.col("value") * 10).cast("long"), F.length("event_type")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    errors = F.array(pick(ERRORS, tenths), pick(ERRORS, n + type_))
    return table(spark, sf, "events").select("event_id", pick(ANSWERS, n).alias("answer"), errors.alias("errors"), (tenths % 5 == 0).cast("int").alias("applied"), (type_ % 2).cast("int").alias("processed"))


def _any_sql(column: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in markers) + ")"


@query(
    f"""WITH a AS (SELECT event_id, [{sql_list(ANSWERS)}][user_id % {len(ANSWERS)} + 1] AS answer, [{sql_list(ERRORS)}][floor(value * 10)::BIGINT % {len(ERRORS)} + 1] AS e1, [{sql_list(ERRORS)}][(user_id + length(event_type)) % {len(ERRORS)} + 1] AS e2, floor(value * 10)::BIGINT % 5 = 0 AS applied, length(event_type) % 2 AS processed FROM events),
    m AS (SELECT *, lower(array_to_string(list_filter([e1, e2], lambda e: e <> ''), ' | ')) AS said, lower(answer) || chr(10) || lower(array_to_string(list_filter([e1, e2], lambda e: e <> ''), ' | ')) AS whole FROM a)
    SELECT event_id, NOT applied AND ({_any_sql('said', pr.NO_OP_ERRORS)} OR contains(lower(answer), '<<<<<<< search') AND processed = 0) AS no_op, {_any_sql('whole', pr.CONTEXT_MARKERS)} AS needs_context, {_any_sql('whole', pr.REFUSAL_MARKERS)} AS refusal, {_any_sql("lower(e1 || chr(10) || e2)", pr.INFRASTRUCTURE_MARKERS)} AS infrastructure FROM m"""
)
def failure_flags(spark, sf):
    e, a = F.col("errors"), F.col("answer")
    flags = [pr.is_no_op(e, a, F.col("applied"), F.col("processed")).alias("no_op"), pr.needs_context(e, a).alias("needs_context"), pr.is_refusal(e, a).alias("refusal"), pr.is_infrastructure_failure(e).alias("infrastructure")]
    return _attempts(spark, sf).select("event_id", *flags)


#: What an exported record may hold about its target N.
EXPORT_FORMS = [
    "pr#N", "xpr#N", "pr#N0", "github.com/o/r/pull/N", "github.com/o/r/issues/N0", "code.djangoproject.com/ticket/N", "issue N", "fixes #N", "fixed # N", "fixes #1",
    "revision='0123456789abcdef' see #N", "### comment : x", "nothing", "resolved N",
]


def _exports(spark: SparkSession, sf: str) -> DataFrame:
    item = F.col("item_id").cast("string")
    filled = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.concat(F.col("text"), F.lit(" "), F.replace(F.lit(f), F.lit("N"), item)).alias("exported")) for k, f in enumerate(EXPORT_FORMS)]))
    rows = table(spark, sf, "benchmark").select("item_id", filled.alias("x")).select("item_id", "x.*")
    odd = lambda k: F.col("form") % k == 0
    params = F.struct(odd(3).alias("uses_discussion_comments"), F.when(odd(5), True).alias("uses_embeddings"), F.when(odd(4), F.array(F.lit("decay"))).alias("tunable_retrieval_parameters"))
    issues = F.array(F.struct(F.when(odd(6), item).otherwise("none").alias("issue_id"), F.when(odd(7), F.concat(F.lit("pr#"), item)).alias("name")))
    path = lambda k: F.array(F.when(odd(k), F.concat(F.lit("file>PR#"), item, F.lit(">x"))).otherwise("file>x"))
    return rows.select("item_id", "form", "exported", params.alias("params"), issues.alias("issues"), path(4).alias("methods"), path(6).alias("classes"), path(9).alias("others"))


def _joined(flags: Column) -> Column:
    return F.array_join(F.array_sort(flags), ",")


@query(
    f"""WITH x AS (SELECT item_id, k AS form, lower(text || ' ' || replace(f, 'N', item_id::VARCHAR)) AS s, item_id::VARCHAR AS t FROM benchmark CROSS JOIN (SELECT unnest([{sql_list(EXPORT_FORMS)}]) AS f, unnest(range({len(EXPORT_FORMS)})) AS k)),
    c AS (SELECT *, list_filter([CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])pr#' || t || '($|[^a-z0-9_])') THEN 'target_pr_reference' END,
        CASE WHEN regexp_matches(s, 'github\\.com/[^\\s"''<>]+/(pull|pulls|issues)/' || t || '($|[^0-9])') OR regexp_matches(s, 'code\\.djangoproject\\.com/ticket/' || t || '($|[^0-9])') THEN 'target_fix_reference_url' END,
        CASE WHEN regexp_matches(s, '\\b(pr|pull\\s+request|pull|issue)\\s*#?\\s*' || t || '\\b') THEN 'target_fix_reference_text' END,
        CASE WHEN regexp_matches(s, '\\b(fix(e[ds])?|close[sd]?|resolve[sd]?)\\s+#\\s*' || t || '\\b') OR regexp_matches(s, 'revision=["''][0-9a-f]{{12,}}["''][^{{}}]{{0,240}}#\\s*' || t || '\\b') THEN 'target_fix_trace' END,
        CASE WHEN regexp_matches(s, '###\\s+comment\\s*:') THEN 'exported_issue_comment' END], lambda v: v IS NOT NULL) AS content, regexp_matches(s, '\\bfix(e[ds])?\\s+#\\s*\\d+\\b') AS warned,
      list_filter([CASE WHEN form % 3 = 0 THEN 'uses_discussion_comments' END, CASE WHEN form % 5 = 0 THEN 'uses_embeddings' END, CASE WHEN form % 4 = 0 THEN 'has_tunable_retrieval_parameters' END], lambda v: v IS NOT NULL) AS metadata,
      list_filter([CASE WHEN form % 6 = 0 OR form % 7 = 0 THEN 'target_pr_entity' END, CASE WHEN form % 4 = 0 OR form % 6 = 0 OR form % 9 = 0 THEN 'target_pr_in_any_path' END,
        CASE WHEN form % 4 = 0 THEN 'target_pr_in_method_path' WHEN form % 6 = 0 THEN 'target_pr_in_class_path' END], lambda v: v IS NOT NULL) AS structure FROM x)
    SELECT item_id, form::INT AS form, array_to_string(list_sort(content), ',') AS content, warned, array_to_string(list_sort(metadata), ',') AS metadata, array_to_string(list_sort(structure), ',') AS structure, len(content) + len(metadata) + len(structure) = 0 AS clean FROM c"""
)
def export_audit(spark, sf):
    found = audit.export_flags(_exports(spark, sf), F.col("item_id").cast("string"))
    return found.select("item_id", "form", *[_joined(F.col(c)).alias(c) for c in ("content", "metadata", "structure")], "warned", "clean")
