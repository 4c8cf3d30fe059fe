"""Table functions over source text: entities, imports, calls."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _signature(node: ast.AST) -> str:
    return f"{node.name}({ast.unparse(node.args)})"


def python_entities(source: str | None, with_async: bool = True, nested: bool = True) -> Iterator[tuple]:
    """(kind, name, signature, start, end, doc, text) of classes, functions and simple assignments; nothing for broken source.

    Names are dotted by their scopes. ``with_async`` false leaves coroutines out; ``nested`` false keeps to the module's classes.
    """
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = (source or "").split("\n")
    text = lambda n: "\n".join(lines[n.lineno - 1 : n.end_lineno])
    functions = (ast.FunctionDef, ast.AsyncFunctionDef) if with_async else (ast.FunctionDef,)

    def walk(body: list[ast.stmt], scope: str) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, functions):
                yield "function", scope + node.name, scope + _signature(node), node.lineno, node.end_lineno, ast.get_docstring(node) or "", text(node)
            elif isinstance(node, ast.ClassDef) and (nested or not scope):
                yield "class", scope + node.name, scope + node.name, node.lineno, node.end_lineno, ast.get_docstring(node) or "", text(node)
                yield from walk(node.body, f"{scope}{node.name}.")
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name) and node.value is not None:
                        yield "assignment", scope + target.id, f"{scope}{target.id} = {ast.unparse(node.value)}", node.lineno, node.end_lineno, "", text(node)

    yield from walk(tree.body, "")


def python_imports(source: str | None) -> Iterator[tuple[str, str, int]]:
    """(module, name, level) of imports; name is empty for plain ones."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((a.name, "", 0) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from ((node.module or "", a.name, node.level) for a in node.names)


def python_calls(source: str | None) -> Iterator[tuple[str, str, int]]:
    """(caller, callee, line) of calls inside functions, callees as dotted text."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return

    def walk(body, scope: str) -> Iterator[tuple[str, str, int]]:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                for inner in ast.walk(node):
                    if isinstance(inner, ast.Call):
                        name = ast.unparse(inner.func)
                        if re.fullmatch(r"[\w.]+", name):
                            yield scope + node.name, name, inner.lineno
            elif isinstance(node, ast.ClassDef):
                yield from walk(node.body, f"{scope}{node.name}.")

    yield from walk(tree.body, "")


def _row(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType() if k == "int" else T.StringType()) for n, k in kinds.items()])


@F.udtf(returnType=_row(kind="string", name="string", signature="string", start="int", end="int", doc="string", text="string"))
class PythonEntities:
    def eval(self, source: str, with_async: bool):
        yield from python_entities(source, with_async)


@F.udtf(returnType=_row(module="string", name="string", level="int"))
class PythonImports:
    def eval(self, source: str):
        yield from python_imports(source)


@F.udtf(returnType=_row(caller="string", callee="string", line="int"))
class PythonCalls:
    def eval(self, source: str):
        yield from python_calls(source)


def register(spark: SparkSession) -> None:
    """Register the table functions python_entities, python_imports and python_calls for SQL."""
    spark.udtf.register("python_entities", PythonEntities)
    spark.udtf.register("python_imports", PythonImports)
    spark.udtf.register("python_calls", PythonCalls)


def _lateral(df: DataFrame, call: str, columns: list[str]) -> DataFrame:
    register(df.sparkSession)
    df.createOrReplaceTempView("sources_to_parse")
    return df.sparkSession.sql(f"SELECT {', '.join(f's.`{c}`' for c in columns)}, t.* FROM sources_to_parse s, LATERAL {call} t")


def entities(files: DataFrame, keys: list[str], content: str = "content", with_async: bool = True) -> DataFrame:
    """Entities of a table of files: the keys, then kind, name, signature, start, end, doc and text."""
    return _lateral(files, f"python_entities(s.`{content}`, {str(with_async).lower()})", keys)


def imports(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return _lateral(files, f"python_imports(s.`{content}`)", keys)


def calls(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return _lateral(files, f"python_calls(s.`{content}`)", keys)


def import_edges(found: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """(src, dst) between files: a module resolves to the longest dotted prefix that names a file; relative levels climb folders."""
    folder = F.split(F.regexp_replace(F.col(path), "/[^/]*$", ""), "/")
    up = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - F.col("level") + 1, F.lit(0)))
    base = F.when(F.col("level") > 0, F.concat_ws(".", F.array_join(up, "."), F.when(F.col("module") != "", F.col("module")))).otherwise(F.col("module"))
    full = F.concat_ws(".", base, F.when(F.col("name") != "", F.col("name")))
    parts = F.split(full, r"\.")
    wanted = found.select(F.col(path).alias("src"), full.alias("full"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("module")))).alias("p"))
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(path), r"\.py$", ""), "/__init__$", ""), "/", ".")
    known = files.select(F.col(path).alias("dst"), module.alias("module"))
    hit = wanted.select("src", "full", F.col("p.n").alias("n"), F.col("p.module").alias("module")).join(known, "module")
    return hit.groupBy("src", "full").agg(F.max_by("dst", "n").alias("dst")).select("src", "dst").where("src <> dst").distinct()
