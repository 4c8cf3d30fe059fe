"""Text functions as Column expressions: tokens, identifiers, sections, clean-up, rendering."""

from __future__ import annotations

import keyword
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import compiled

# Stop words of the identifier splitter; language keywords are stop words as well.
STOP_WORDS = (
    "and are about after again against also because before between but cannot can could does doesn during else error expected file files for from have had has her his if "
    "into its issue least line may model models more most none only our out over problem raise return root same self should some such that the their there these they this "
    "traceback through too true false under very when where while will within without with would you your"
).split()
PROJECTION_STOP_WORDS = sorted({*STOP_WORDS, *keyword.kwlist})
# The shorter list of the evidence ranking.
EVIDENCE_STOP_WORDS = (
    "about after again against also because before between cannot could does doesn during error expected from have into issue model models nested only problem return should that "
    "their there these this through when where while with would"
).split()
# The list of the Java tokenizer.
JAVA_STOP_WORDS = (
    "about after again against also and are because before between but can cannot could does during else expected false file files for from had has have if into issue its line may more "
    "most none only out over problem return same should some such that the their there these they this through too traceback true under very when where while will with within without would you your"
).split()

DOTTED = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"


def identifier_tokens(text: Column) -> Column:
    """Lower-cased identifiers (ASCII), in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))


def known(token: Column, stop: list[str] = PROJECTION_STOP_WORDS) -> Column:
    """Whether a lower-cased token counts as a term."""
    return (F.length(token) >= 3) & ~token.isin(stop)


def split_terms(text: Column, stop: list[str] = PROJECTION_STOP_WORDS, stem: bool = True) -> Column:
    """Camel-case and separator split, stop words out; each word followed by its light stems (ing, ies to y, s)."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    tokens = F.filter(F.transform(F.regexp_extract_all(spaced, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower), lambda t: known(t, stop))
    if not stem:
        return tokens

    def forms(t: Column) -> Column:
        stems = F.array(
            F.when(t.endswith("ing") & (F.length(t) > 5), F.substring(t, 1, F.length(t) - 3)),
            F.when(t.endswith("ies") & (F.length(t) > 5), F.concat(F.substring(t, 1, F.length(t) - 3), F.lit("y"))),
            F.when(t.endswith("s") & (F.length(t) > 4), F.substring(t, 1, F.length(t) - 1)),
        )
        return F.concat(F.array(t), F.filter(stems, lambda s: s.isNotNull() & known(s, stop)))

    return F.flatten(F.transform(tokens, forms))


def _split_forms(token: str, stop: frozenset[str] = frozenset(PROJECTION_STOP_WORDS)) -> list[str]:
    t = token.lower()
    if len(t) < 3 or t in stop:
        return []
    stems = [t[:-3] if t.endswith("ing") and len(t) > 5 else "", t[:-3] + "y" if t.endswith("ies") and len(t) > 5 else "", t[:-1] if t.endswith("s") and len(t) > 4 else ""]
    return [t, *[s for s in stems if len(s) >= 3 and s not in stop]]


_IDENTIFIER, _PIECE = re.compile("[a-z_][a-z0-9_]*"), re.compile("[A-Z]+[a-z0-9]*|[a-z0-9]+")
#: Functions of terms in plain Python, for tasks that count terms where texts are read: the tokens of a text, and the terms of a token.
PLAIN: dict[Callable, tuple[Callable[[str], list[str]], Callable[[str], list[str]]]] = {
    identifier_tokens: (lambda text: _IDENTIFIER.findall(text.lower()), lambda t: [t]),
    split_terms: (_PIECE.findall, _split_forms),
}


def java_terms(text: Column) -> Column:
    return split_terms(text, JAVA_STOP_WORDS)


def evidence_terms(text: Column) -> Column:
    return split_terms(text, EVIDENCE_STOP_WORDS, stem=False)


def exact_terms(text: Column, stop: list[str] = PROJECTION_STOP_WORDS) -> Column:
    """Distinct lower-cased dotted identifiers and their parts."""
    tokens = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOTTED), F.lit(0)), F.lower), lambda t: known(t, stop))
    parts = F.flatten(F.transform(tokens, lambda t: F.filter(F.split(t, "[._]+"), lambda p: known(p, stop))))
    return F.array_distinct(F.concat(tokens, parts))


def code_like_terms(text: Column, stop: list[str] = PROJECTION_STOP_WORDS) -> Column:
    """Exact terms that look like symbols: with an underscore, a dot, a camel-case step or a digit."""
    raw = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOTTED), F.lit(0)), lambda t: t.rlike(r"[_.0-9]|[a-z][A-Z]"))
    tokens = F.filter(F.transform(raw, F.lower), lambda t: known(t, stop))

    def parts(t: Column) -> Column:
        return F.when(t.contains("."), F.array(F.element_at(F.split(t, r"\."), -1))).otherwise(F.split(t, "_+"))

    return F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda t: F.filter(parts(t), lambda p: known(p, stop))))))


def anchor_terms(text: Column) -> Column:
    """Distinct anchors: identifiers of `code spans` and their dot parts, and snake or camel identifiers anywhere."""
    text = F.coalesce(text, F.lit(""))
    spans = F.flatten(F.transform(F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1)), lambda s: F.transform(F.regexp_extract_all(s, F.lit(DOTTED), F.lit(0)), F.lower)))
    spans = F.filter(spans, lambda t: F.length(t) >= 3)
    parts = F.flatten(F.transform(spans, lambda t: F.filter(F.split(t, r"\."), lambda p: F.length(p) >= 3)))
    loose = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda t: t.rlike("_|[a-z][A-Z]"))
    loose = F.filter(F.transform(loose, F.lower), lambda t: known(t, EVIDENCE_STOP_WORDS))
    return F.array_distinct(F.concat(spans, parts, loose))


def candidate_terms(*fields: Column) -> Column:
    """Distinct identifiers of all fields and their dot parts."""
    tokens = F.flatten(F.array(*[F.filter(F.regexp_extract_all(F.lower(F.coalesce(f, F.lit(""))), F.lit(DOTTED), F.lit(0)), lambda t: F.length(t) >= 3) for f in fields]))
    return F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda t: F.filter(F.split(t, r"\."), lambda p: F.length(p) >= 3)))))


# Words that say nothing about a context.
CONTEXT_STOP_WORDS = "the and for with from this that when should would could error issue using".split()


def context_tokens(text: Column) -> Column:
    """Distinct lower-cased identifiers of three characters or more, without common words, and version numbers."""
    text = F.coalesce(text, F.lit(""))
    names = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), F.lower)
    versions = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bv?\d+(?:\.\d+){1,4}\b"), F.lit(0)), F.lower)
    return F.array_distinct(F.concat(F.filter(names, lambda t: ~t.isin(CONTEXT_STOP_WORDS)), versions))


def context_score(tokens: Column, text: Column) -> Column:
    """How many tokens occur in the text as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(tokens, lambda t: F.contains(low, t)))


def clean_issue(text: Column) -> Column:
    """HTML comments and signature blocks become line breaks, runs of blank lines one, white space at the ends nothing."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", "\n")
    text = F.regexp_replace(text, r"(?si)-----BEGIN PGP SIGNATURE-----.*?-----END PGP SIGNATURE-----", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


#: What a masked reference becomes, and what stands before and after the number in the families of references (fixed values).
MASK = "[target fixing reference removed]"
REST_OF_LINK = r"(?:[#?][^\s<>)\]]*)?"
REFERENCE_FORMS = [
    (r"(?i)https?://github\.com/[^\s<>)\]]+/(?:pull|pulls|issues)/", REST_OF_LINK),
    (r"(?i)https?://code\.djangoproject\.com/ticket/", REST_OF_LINK),
    (r"(?i)\b(?:pr|pull\s+request|pull|issue)\s*#?\s*", r"\b"),
    (r"(?i)(?<![\w/])#\s*", r"\b"),
]


def redact_reference(text: Column, number: Column) -> Column:
    """Mask references to one issue number: links to it, 'issue n' phrases, and #n. Without a number the text stays."""
    n = F.concat(F.lit(r"\Q"), number.cast("string"), F.lit(r"\E"))
    masked = F.coalesce(text, F.lit(""))
    for before, after in REFERENCE_FORMS:
        masked = F.regexp_replace(masked, F.concat(F.lit(before), n, F.lit(after)), F.lit(MASK))
    return F.when(F.coalesce(number.cast("string"), F.lit("")) == "", F.coalesce(text, F.lit(""))).otherwise(masked)


def reference_ids(text: Column, repository: Column) -> Column:
    """Distinct issue numbers that a text refers to: a closing word and #n, #n by itself, or a link to the repository.

    The one repository whose tickets are elsewhere (a fixed value) has links to tickets as well.
    """
    text = F.coalesce(text, F.lit(""))
    found = lambda pattern: F.regexp_extract_all(text, pattern, F.lit(1))
    closed = found(F.lit(r"(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+#(\d+)"))
    named = found(F.lit(r"(?<!\w)#(\d+)(?![\w-])"))
    linked = found(F.concat(F.lit(r"https://github\.com/\Q"), F.coalesce(repository, F.lit("")), F.lit(r"\E/(?:issues|pull)/(\d+)")))
    tickets = F.when(repository == "django/django", found(F.lit(r"https://code\.djangoproject\.com/ticket/(\d+)"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(closed, named, linked, tickets), lambda x: x.cast("long")))


def file_mentions(text: Column, extensions: tuple[str, ...] = ("py", "java", "cpp", "c", "h", "js", "ts", "go", "rs")) -> Column:
    """Distinct file paths of known extensions in a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[A-Za-z0-9_./-]+\.(?:{'|'.join(extensions)})\b"), F.lit(0)))


def code_blocks(text: Column) -> Column:
    """Contents of fenced code blocks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```"), F.lit(1))


def diff_of_answer(text: Column) -> Column:
    """The diff in a tagged or fenced answer, else the answer itself."""
    tagged = F.regexp_extract(text, r"(?s)<(?:patch|diff)>\s*(.*?)</(?:patch|diff)>", 1)
    fenced = F.regexp_extract(text, r"(?s)```(?:diff|patch)?\n(.*?)```", 1)
    return F.when(tagged != "", tagged).when(fenced != "", fenced).otherwise(text)


def json_of_answer(text: Column) -> Column:
    """The JSON of a fenced block, else the text itself."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(text)


def token_proxy(text: Column, factor: float = 1.0) -> Column:
    """A deterministic token count: a quarter of the characters, rounded up, times a factor rounded up."""
    return F.ceil(F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4) * factor).cast("long")


def truncate_keep_ends(text: Column, limit: int, marker: str = "\n...\n") -> Column:
    """At most ``limit`` characters: head and tail around a marker."""
    room = max(limit - len(marker), 0)
    head = (room + 1) // 2
    tail = room - head
    cut = F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def truncate_to_tokens(text: Column, tokens: int) -> Column:
    """The longest prefix whose token proxy stays within ``tokens``."""
    return F.substring(text, 1, 4 * tokens)


def compact(text: Column, limit: int = 160) -> Column:
    """White space collapsed, with an ellipsis beyond ``limit`` characters."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(one) > limit, F.concat(F.rtrim(F.substring(one, 1, limit - 3)), F.lit("..."))).otherwise(one)


def seconds_of(duration: Column) -> Column:
    """H:M:S (fractions allowed) in seconds."""
    p = F.split(duration, ":")
    return F.try_element_at(p, F.lit(1)).cast("double") * 3600 + F.try_element_at(p, F.lit(2)).cast("double") * 60 + F.try_element_at(p, F.lit(3)).cast("double")


def sequence_hash(values: Column) -> Column:
    return F.sha2(F.array_join(values, "\n"), 256)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in linear memory: a column of the table is held as the bits of two integers."""
    if a == b or not a or not b:
        return 0 if a == b else len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # where a cell is one more, or one less, than the cell above it
    for c in b:
        same = places.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(level | up)), up & level
        distance += 1 if right & last else -1 if left & last else 0
        right, left = right << 1 | 1, left << 1
        same |= down
        up, down = (left | ~(same | right)) & full, right & same & full
    return distance


def levenshtein_similarity(a: Column, b: Column, limit: int | None = None) -> Column:
    """1 - distance / longer length, of the whole texts or of the first ``limit`` characters of each (the distance is quadratic)."""
    if limit is not None:
        a, b = F.substring(a, 1, limit), F.substring(b, 1, limit)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - compiled.edit_distance(a, b) / longer)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(dot / length)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v))


def sections(df, key: str, title: str, body: str):
    """(key, title, narrative, diagnostic, code_spans, quoted) of issue texts.

    A line that starts with Traceback makes it and all later lines of the body diagnostic; stack-frame and error lines
    are diagnostic anywhere.
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\r\n|\n|\r")).alias("n", "line"))
    stripped = F.trim(F.col("line"))
    own = stripped.rlike(r"""^File ["'].*["'], line \d+""") | stripped.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*Error:")
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("diagnostic", own | (F.max(stripped.startswith("Traceback").cast("int")).over(upto) == 1))
    text = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("diagnostic") == F.lit(flag), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    parts = lines.groupBy(key).agg(text(False).alias("narrative"), text(True).alias("diagnostic"))
    whole = F.concat_ws("\n", title, body)
    spans = F.array_join(F.regexp_extract_all(whole, F.lit("`([^`]+)`"), F.lit(1)), " ")
    quoted = F.array_join(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit("""['"]([A-Za-z_][A-Za-z0-9_.-]+)['"]"""), F.lit(1)), " ")
    return df.select(key, F.coalesce(title, F.lit("")).alias("title"), spans.alias("code_spans"), quoted.alias("quoted")).join(parts, key)


def section_terms(parts):
    """Term sets of ``sections``: title, narrative, issue, title_exact, exact and diagnostic terms."""
    title, narrative = split_terms(F.col("title")), split_terms(F.col("narrative"))
    title_exact = exact_terms(F.col("title"))
    symbols = F.filter(exact_terms(F.col("narrative")), lambda t: t.contains("_") | t.contains("."))
    exact = F.array_distinct(F.concat(title_exact, exact_terms(F.col("code_spans")), exact_terms(F.col("quoted")), symbols))
    issue = F.array_distinct(F.concat(title, narrative, split_terms(F.col("code_spans")), split_terms(F.col("quoted"))))
    return parts.select(
        parts.columns[0], F.array_distinct(title).alias("title_terms"), F.array_distinct(narrative).alias("narrative_terms"), issue.alias("issue_terms"),
        title_exact.alias("title_exact_terms"), exact.alias("exact_terms"), exact_terms(F.col("diagnostic")).alias("diagnostic_terms"),
    )
