"""Filters over paths, messages, references and attempts, and rules of visibility in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders that hold no production code, stems of boilerplate documents, and folders that Java candidates skip.
NON_PRODUCTION = ["test", "tests", "__tests__", "test_suite", "docs", "doc", "examples", "example", "tutorial", "tutorials", "benchmarks", "benchmark"]
BOILERPLATE_DOCS = ["code_of_conduct", "contributing", "license", "security", "issue_template", "pull_request_template"]
JAVA_EXCLUDED = [".gradle", ".idea", "build", "generated", "node_modules", "target"]
SOURCE_EXTENSIONS = ("py", "java", "c", "cc", "cpp", "h", "hpp")

# Fixed values of the code-reference filter: common words, dunder names, base names, extensions, prefixes and last parts.
COMMON_WORDS = (
    "actual behavior behaviour comparing description difference expected extension problem reproduce result sometimes traceback version warning begin "
    "end signature pgp gnupg com org net edu gov html http https value values comment comments keyword keywords gz array collect copy data file files "
    "header headers hdf5 keyerror name ndarray none open pytables true false attributeerror indexerror importerror modulenotfounderror notimplemented "
    "notimplementederror runtimeerror typeerror valueerror platform format lower append count txt fr amd64 arm64 darwin linux macos ubuntu win32 win64 "
    "windows x64 x86 x86_64"
).split()
DUNDER_NAMES = "__call__ __class__ __dict__ __getattr__ __init__ __iter__ __len__ __module__ __name__ __repr__ __setattr__ __str__ __version__".split()
GENERIC_BASENAMES = "__init__ base common compat conf config conftest core io test tests ui utils".split()
NON_SOURCE_EXTENSIONS = ".cfg .csv .html .ini .json .md .rst .toml .txt .xml .yaml .yml".split()
LOCAL_PREFIXES = "c cls df filepath np numpy os pd platform self sys tbl u".split()
GENERIC_TARGETS = (
    "add append clear close compareto contains count equals format get hashcode lower now open platform put read remove set size tostring transform "
    "version write"
).split()

# The patterns of addresses, and of commit messages that speak of upkeep and of repair.
ADDRESS = r"(?i)(?:^|[\s<])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b|\b(?:https?://|www\.)?\w[\w.-]*\.(?:com|org|net|edu|gov|io|dev|ai|fr)\b"
MAINTENANCE = (
    r"(?i)\b(?:pyupgrade|pre-commit|precommit|black|isort|ruff|flake8|pylint|format(?:ting)?|style|lint|whitespace|typo|spelling|docstring|sphinx|warning|codestyle|"
    r"D\d{3,4}|B\d{3,4}|SIM\d{3,4}|RUF\d{3,4}|E\d{3,4}|W\d{3,4}|F\d{3,4}|dependabot|bump|changelog|release notes)\b"
)
REPAIR = (
    r"(?i)\b(?:fix(?:e[sd])?|bug(?:fix)?|error|fail(?:ed|s|ure)?|regression|incorrect(?:ly)?|wrong|crash(?:es|ed)?|exception|broken|repair|resolve(?:[sd])?|invalid)\b"
)

# What messages and answers of failed attempts say.
NO_OP_ERRORS = ["no effective edit commands", "no changes were made"]
SEARCH_MARK = "<<<<<<< search"
CONTEXT_MARKERS = ["need more context", "provided context only", "provided context alone", "cannot produce a valid patch", "no edit commands found"]
REFUSAL_MARKERS = [
    "cannot provide a valid patch", "without access to the actual source files", "relevant source files", "the context is insufficient",
    "need more files", "need access to", "not included in the provided context",
]
INFRASTRUCTURE_MARKERS = [
    "insufficient_balance", "insufficient account balance", "connection error", "rate limit", "service unavailable", "gateway timeout",
    "request timed out", "repository path not found",
]


def drop_leaks(df: DataFrame, names: tuple[str, ...] = ("hint_text", "hints_text")) -> DataFrame:
    """Without the fields that a query must not see."""
    return df.drop(*names)


def path_parts(path: Column) -> Column:
    return F.split(F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), "/")


def is_boilerplate_doc(path: Column) -> Column:
    """The file's stem is a boilerplate name, or a folder below another one is called so."""
    parts = path_parts(path)
    stem = F.regexp_replace(F.element_at(parts, -1), r"^(\.*[^.].*)\.[^.]*$", "$1")
    folders = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return stem.isin(BOILERPLATE_DOCS) | F.arrays_overlap(folders, F.array(*map(F.lit, BOILERPLATE_DOCS)))


def skips_production(path: Column) -> Column:
    """A step of the path, relative to its repository, is called like a folder that holds no production code."""
    return F.arrays_overlap(path_parts(path), F.array(*map(F.lit, NON_PRODUCTION)))


def is_source(path: Column, extensions: tuple[str, ...] = SOURCE_EXTENSIONS) -> Column:
    return F.lower(F.coalesce(path, F.lit(""))).rlike(rf"\.(?:{'|'.join(extensions)})$")


def is_java_candidate(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    return low.endswith(".java") & ~F.arrays_overlap(path_parts(path), F.array(*map(F.lit, JAVA_EXCLUDED))) & ~low.contains("/test/") & ~low.startswith("test/")


def is_test_name(name: Column) -> Column:
    """test but not pytest, whatever the case."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.contains("test") & ~low.contains("pytest")


def has_test_word(name: Column, words: tuple[str, ...] = ("test", "tests", "e2e", "testing")) -> Column:
    return F.arrays_overlap(F.split(F.lower(F.coalesce(name, F.lit(""))), r" |_|/|\."), F.array(*map(F.lit, words)))


TEST_PART = r"^(?i:test_)|^(?i:tests?)$|^test[A-Z]"


def is_code_reference(reference: Column, source_extensions: tuple[str, ...] = (".py",), repository: tuple[str, ...] = ()) -> Column:
    """Likely a reference to code: a qualified or symbol-shaped name, no address, no document, no common word and no test.

    ``repository`` are the lower-case names of the repository, which a qualified name with a generic last part may start with.
    """
    name = F.regexp_replace(F.regexp_replace(F.coalesce(reference, F.lit("")), r"^\s+|\s+$", ""), "^[`'\"]+|[`'\"]+$", "")
    dots = F.split(name, r"\.")
    leaf = F.element_at(F.split(name, r"[/\\]"), -1)
    parts = F.filter(F.split(name, r"[./\\]+"), lambda p: p != "")
    target = F.when((F.element_at(dots, -1) == "py") & (F.size(dots) > 1), F.try_element_at(dots, F.lit(-2))).otherwise(F.element_at(dots, -1))
    low, first = F.lower(target), F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    separated = name.rlike(r"[/\\]")
    qualified = name.rlike(r"[./\\]")
    extension = F.concat(F.lit("."), F.lower(F.substring_index(leaf, ".", -1)))
    document = leaf.contains(".") & extension.isin([e for e in NON_SOURCE_EXTENSIONS if e not in source_extensions])
    generic_file = leaf.endswith(".py") & ~separated & F.lower(F.regexp_replace(leaf, r"\.py$", "")).isin(GENERIC_BASENAMES)
    out = (name == "") | name.rlike(ADDRESS) | ((F.length(name) > 80) & ~separated) | document | generic_file
    out = out | low.startswith("assert") | low.startswith("assume") | low.isin(COMMON_WORDS + DUNDER_NAMES) | F.exists(parts, lambda p: p.rlike(TEST_PART))
    class_like = r"[A-Z][a-z]+"
    local = F.lower(first).isin(LOCAL_PREFIXES) & ~target.rlike(class_like) & ~target.contains("_")
    generic = low.isin(GENERIC_TARGETS) & ~F.lower(first).isin(list(repository)) & ~first.rlike(class_like)
    whole = (F.length(target) > 1) & ~local & ~generic
    capitals = (F.upper(target) == target) & (F.lower(target) != target) & F.length(target).between(2, 12)
    symbol = target.contains("_") | capitals | target.rlike(r"[a-z][A-Z]|[A-Z][a-z]+[A-Z]")
    return F.when(out, F.lit(False)).when(qualified, whole).otherwise(symbol)


def _first_lines(message: Column, n: int) -> Column:
    text = F.regexp_replace(F.coalesce(message, F.lit("")), r"^\s+|\s+$", "")
    return F.array_join(F.slice(F.split(text, "\r\n|\n|\r"), 1, n), "\n")


def is_maintenance(message: Column) -> Column:
    """The first line speaks of upkeep: formatters, lint codes, style, spelling, bumps."""
    return _first_lines(message, 1).rlike(MAINTENANCE)


def is_repair(message: Column) -> Column:
    """One of the first three lines speaks of a repair."""
    return _first_lines(message, 3).rlike(REPAIR)


def epoch(*candidates: Column) -> Column:
    """First value that parses as a time, in UTC seconds."""
    return F.unix_timestamp(F.coalesce(*[F.try_to_timestamp(c.cast("string")) for c in candidates])).cast("double")


def created_by(created: Column, cutoff: Column) -> Column:
    return F.coalesce(created <= cutoff, F.lit(False))


def visible_at(created: Column, updated: Column, cutoff: Column, strict: bool = True) -> Column:
    """Content is visible if created and last changed by the cutoff; an unknown change fails closed when strict."""
    return created_by(created, cutoff) & created_by(updated, cutoff) if strict else created_by(created, cutoff)


def is_target_issue(issue: Column, targets: Column, created: Column, cutoff: Column, window: float = 60.0) -> Column:
    """The issue itself: by id, or created within a minute of the cutoff."""
    return F.coalesce(F.array_contains(targets, issue), F.lit(False)) | F.coalesce(F.abs(created - cutoff) <= window, F.lit(False))


def _messages(errors: Column) -> Column:
    return F.lower(F.array_join(F.filter(F.coalesce(errors, F.array().cast("array<string>")), lambda e: e.isNotNull() & (e != "")), " | "))


def _any_of(text: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | text.contains(m)
    return found


def is_no_op(errors: Column, answer: Column, applied: Column, processed: Column) -> Column:
    """Nothing was applied, and messages say so or the answer holds an edit that was not processed (both counts of files)."""
    said = _any_of(_messages(errors), NO_OP_ERRORS)
    lost = F.lower(F.coalesce(answer, F.lit(""))).contains(SEARCH_MARK) & (F.coalesce(processed, F.lit(0)) == 0)
    return (F.coalesce(applied, F.lit(0)) == 0) & (said | lost)


def _said(errors: Column, answer: Column) -> Column:
    return F.concat(F.lower(F.coalesce(answer, F.lit(""))), F.lit("\n"), _messages(errors))


def needs_context(errors: Column, answer: Column) -> Column:
    """The answer or a message asks for more context."""
    return _any_of(_said(errors, answer), CONTEXT_MARKERS)


def is_refusal(errors: Column, answer: Column) -> Column:
    """The answer or a message refuses for want of files."""
    return _any_of(_said(errors, answer), REFUSAL_MARKERS)


def target_stratum(entities: Column, files: Column) -> Column:
    return F.when((entities > 0) & (files == 0), "entity_only").when((entities > 0) & (files > 0), "mixed").otherwise("file_only")


def hit_stratum(a: Column, b: Column) -> Column:
    return F.when((a == 1) & (b == 1), "both").when(a == 1, "only_a").when(b == 1, "only_b").otherwise("neither")


def directional_alignment(stratum: Column, preferred: Column) -> Column:
    """Whether a preference points to the side that alone hit; null where neither side is ahead."""
    return F.when(stratum == "only_a", preferred == "a").when(stratum == "only_b", preferred == "b")


def is_infrastructure_failure(errors: Column) -> Column:
    """A message of an array of errors speaks of balance, connection, limits or a missing repository."""
    texts = F.transform(F.coalesce(errors, F.array().cast("array<string>")), lambda e: F.coalesce(e, F.lit("")))
    return _any_of(F.lower(F.array_join(texts, "\n")), INFRASTRUCTURE_MARKERS)


def is_historical(node: Column, label: Column, root: str = "root") -> Column:
    """A path node that stands for another issue or pull request."""
    return (F.lower(label).isin("issue", "pullrequest", "pr") | F.lower(node).rlike("^(?:issue|pr)#")) & (node != root)
