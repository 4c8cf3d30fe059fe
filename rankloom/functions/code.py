"""Functions over source text that need a parser: canonical literals, stripped code, edit blocks, patch normal forms."""

from __future__ import annotations

import ast
import difflib
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _SortedSets(ast.NodeTransformer):
    """Set displays with their elements in text order."""

    def visit_Set(self, node: ast.Set) -> ast.Set:
        self.generic_visit(node)
        return ast.Set(elts=sorted(node.elts, key=ast.unparse))


def canonical_signature_of(signature: str | None) -> str:
    """A signature whose literal value, if it holds sets, is written in a stable order; any other stays as it is."""
    head, equals, value = (signature or "").partition(" = ")
    if not equals or "{" not in value:
        return signature or ""
    try:
        tree = ast.parse(value.strip(), mode="eval")
        ast.literal_eval(tree)
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
        return signature or ""
    if not any(isinstance(n, ast.Set) for n in ast.walk(tree)):
        return signature or ""
    return f"{head} = {ast.unparse(_SortedSets().visit(tree))}"


def stripped_code_of(source: str | None) -> str:
    """Source without comments, docstrings and blank lines; source that does not tokenize stays as it is."""
    try:
        tree = ast.parse(source or "")
        docs = set()
        for node in ast.walk(tree):
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(getattr(node.body[0], "value", None), ast.Constant) and isinstance(node.body[0].value.value, str):
                docs.update(range(node.body[0].lineno, node.body[0].end_lineno + 1))
        lines = (source or "").split("\n")
        for token in tokenize.generate_tokens(io.StringIO(source or "").readline):
            if token.type == tokenize.COMMENT:
                row, column = token.start
                lines[row - 1] = lines[row - 1][:column]
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
        return source or ""
    return "\n".join(x.rstrip() for n, x in enumerate(lines, 1) if x.strip() and n not in docs)


def normal_patch_of(before: str | None, after: str | None, path: str = "file") -> str:
    """Unified diff of two versions after comments, docstrings and blank lines are gone."""
    a, b = (stripped_code_of(x).split("\n") for x in (before, after))
    return "\n".join(difflib.unified_diff(a, b, f"a/{path}", f"b/{path}", lineterm=""))


_EDIT = re.compile(r"(?ms)^<{5,} SEARCH\n(.*?)^={5,}\n(.*?)^>{5,} REPLACE\s*$")


def edit_blocks(answer: str | None) -> list[tuple[str, str, str]]:
    """(path, search, replace) of SEARCH/REPLACE blocks; the path is the last '### path' line before a block."""
    out = []
    for m in _EDIT.finditer(answer or ""):
        heads = re.findall(r"(?m)^### (\S+)", answer[: m.start()])
        out.append((heads[-1] if heads else "", m[1].rstrip("\n"), m[2].rstrip("\n")))
    return out


def apply_edits(source: str, edits: list[tuple[str, str]]) -> str:
    """Each search text replaced once; fails when it is not there exactly once."""
    for search, replace in edits:
        if source.count(search) != 1:
            raise ValueError(f"search text found {source.count(search)} times")
        source = source.replace(search, replace)
    return source


def parses(source: str | None) -> bool:
    try:
        ast.parse(source or "")
        return True
    except (SyntaxError, ValueError, RecursionError):
        return False


@F.pandas_udf(T.StringType())
def canonical_signature(s: pd.Series) -> pd.Series:
    return s.map(canonical_signature_of, na_action="ignore")


@F.pandas_udf(T.StringType())
def stripped_code(s: pd.Series) -> pd.Series:
    return s.map(stripped_code_of, na_action="ignore")


@F.pandas_udf(T.StringType())
def normal_patch(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([normal_patch_of(a, b) for a, b in zip(before, after, strict=True)])


@F.pandas_udf(T.BooleanType())
def is_valid_python(s: pd.Series) -> pd.Series:
    return s.map(parses)


def render_path(details):
    """Path details as one line from the end to the root: 'c <-desc- b <-desc- a'."""
    steps = F.transform(F.reverse(details), lambda d: F.concat(F.lit(" <-"), F.coalesce(d["description"], F.lit("")), F.lit("- "), d["src"]))
    return F.when(F.size(details) > 0, F.concat(F.element_at(details, -1)["dst"], F.array_join(steps, "")))
