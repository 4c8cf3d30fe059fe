"""Paths, symbols and kinds: the identity of a ranked entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Module attributes that are never evidence.
BOILERPLATE = ["__all__", "__version__", "__doc__", "__bibtex__", "__citation__"]


def repository_path(path: Column) -> Column:
    """Forward slashes, without a diff prefix (a/, b/) and without leading ./ steps."""
    path = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(path, "^[ab]/", ""), r"^(?:\./)+", "")


def seed_path(path: Column) -> Column:
    """Forward slashes, without any leading dots and slashes (so .github/x becomes github/x)."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "^[./]+", "")


def relative_path(path: Column, root: Column) -> Column:
    """Path below the root; fails for a path that leaves it."""
    rest = F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(repository_path(path))
    leaves = rest.rlike(r"(^|/)\.\.(/|$)") | rest.startswith("/")
    return F.when(leaves, F.raise_error(F.concat(F.lit("path leaves the repository: "), path))).otherwise(rest)


def symbol_base(signature: Column) -> Column:
    """A signature up to its value or its parameters."""
    return F.trim(F.substring_index(F.substring_index(F.coalesce(signature, F.lit("")), " = ", 1), "(", 1))


def entity_kind(entity_type: Column, signature: Column, source: Column) -> Column:
    """class, assignment or function."""
    starts = F.ltrim(F.coalesce(source, F.lit("")))
    function = starts.startswith("def ") | starts.startswith("async def ")
    return F.when((F.lower(F.coalesce(entity_type, F.lit(""))) == "class") | starts.startswith("class "), "class").when(F.coalesce(signature, F.lit("")).contains(" = ") & ~function, "assignment").otherwise("function")


def candidate_kind(signature: Column, source: Column) -> Column:
    """assignment or function: the evaluation has no class branch."""
    starts = F.ltrim(F.coalesce(source, F.lit("")))
    return F.when(F.coalesce(signature, F.lit("")).contains(" = ") & ~starts.startswith("def ") & ~starts.startswith("async def "), "assignment").otherwise("function")


def canonical_key(path: Column, kind: Column, signature: Column) -> Column:
    """path|kind|symbol; null when path or symbol is empty."""
    path, symbol = repository_path(path), symbol_base(signature)
    return F.when((path != "") & (symbol != ""), F.concat_ws("|", path, kind, symbol))


def local_symbol(signature: Column, path: Column) -> Column:
    """Symbol without the longest suffix of the file's module path that it starts with."""
    parts = F.filter(F.split(symbol_base(signature), r"\."), lambda p: p != "")
    module = F.when(path.endswith(".py"), F.filter(F.split(F.substring(repository_path(path), 1, F.length(repository_path(path)) - 3), "/"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    lengths = F.when(F.size(module) > 0, F.sequence(F.lit(1), F.size(module))).otherwise(F.array().cast("array<int>"))
    fits = F.filter(lengths, lambda n: (n <= F.size(parts)) & (F.slice(parts, F.lit(1), n) == F.slice(module, F.size(module) - n + 1, n)))
    best = F.coalesce(F.array_max(fits), F.lit(0))
    local = F.slice(parts, best + 1, F.size(parts))
    return F.array_join(F.when(best >= F.size(parts), local).otherwise(local), ".")


def is_boilerplate(name: Column) -> Column:
    """Module attributes and dunder names other than __init__."""
    base = F.element_at(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\."), -1)
    return base.isin(BOILERPLATE) | (base.startswith("__") & base.endswith("__") & (base != "__init__"))


def is_boilerplate_evidence(name: Column, path: Column) -> Column:
    """Package initialisers, module attributes and every dunder name."""
    base, path = F.element_at(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\."), -1), F.lower(F.coalesce(path, F.lit("")))
    return path.endswith("/__init__.py") | (path == "__init__.py") | base.isin(BOILERPLATE) | (base.startswith("__") & base.endswith("__"))


def repository_of(instance_id: Column) -> Column:
    """Instance id without its last -part."""
    return F.regexp_replace(instance_id, "-[^-]*$", "")
