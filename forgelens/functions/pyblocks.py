"""Code blocks of a Python source: the one place where source is parsed.

``python_blocks`` is an Arrow UDF over file contents.  It only measures single
blocks; every statistic over them is a DataFrame operation.

Counting rule of the cyclomatic complexity, per block: 1, plus one for each
if/elif, conditional expression, for, while, except handler and assert, one for
the ``else`` of a loop or a try, (operands - 1) for a boolean expression,
1 + conditions for a comprehension clause, and one for each match case that is
not a catch-all.  A nested function is a block of its own and does not count
towards the one around it.  A class without methods counts its own body; one
with methods has the floor of their mean (own body included), plus one.
"""

import ast

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PARSED = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField(
            "blocks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("kind", T.StringType()),
                        T.StructField("block_pos", T.IntegerType()),
                        T.StructField("lineno", T.IntegerType()),
                        T.StructField("length", T.IntegerType()),
                        T.StructField("complexity", T.IntegerType()),
                        T.StructField("has_docstring", T.BooleanType()),
                    ]
                )
            ),
        ),
    ]
)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BLOCKS = (*_DEFS, ast.ClassDef)
_LEAVES = (
    ast.Name, ast.Constant, ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop, ast.alias, ast.arg,
)
_ARROW_PARSED = to_arrow_type(PARSED)


def _points(node) -> int:
    """What a single syntax node adds to the complexity around it."""
    match node:
        case ast.If() | ast.IfExp() | ast.ExceptHandler() | ast.Assert():
            return 1
        case ast.For() | ast.AsyncFor() | ast.While():
            return 1 + bool(node.orelse)
        case ast.Try() | ast.TryStar():
            return int(bool(node.orelse))
        case ast.BoolOp():
            return len(node.values) - 1
        case ast.comprehension():
            return 1 + len(node.ifs)
        case ast.match_case():
            catch_all = isinstance(node.pattern, ast.MatchAs) and node.pattern.pattern is None
            return int(not catch_all)
    return 0


def _children(node) -> list:
    """The nodes right below a node in source order, without those that cannot hold any that count."""
    found = []
    for name in node._fields:
        value = getattr(node, name, None)
        if isinstance(value, list):
            found += [v for v in value if isinstance(v, ast.AST) and not isinstance(v, _LEAVES)]
        elif isinstance(value, ast.AST) and not isinstance(value, _LEAVES):
            found.append(value)
    return found


def _own_nodes(body):
    """Nodes below ``body`` in source order, functions and classes as leaves."""
    stack = list(reversed(body))
    while stack:
        node = stack.pop()
        yield node
        if not isinstance(node, _BLOCKS):
            stack += reversed(_children(node))


def _block(node, kind, complexity) -> dict:
    is_class = kind == "class"
    return {
        "name": node.name,
        "kind": kind,
        "lineno": node.lineno,
        "length": node.end_lineno - node.lineno,
        "complexity": complexity,
        "has_docstring": None if is_class else ast.get_docstring(node) is not None,
    }


def _function_blocks(node, kind) -> list[dict]:
    """A function followed by the functions nested in it."""
    complexity, inner = 1, []
    for child in _own_nodes(node.body):
        complexity += _points(child)
        if isinstance(child, _DEFS):
            inner += _function_blocks(child, "nested")
        elif isinstance(child, ast.ClassDef):
            inner += _nested_class(child)
    return [_block(node, kind, complexity), *inner]


def _nested_class(node) -> list[dict]:
    """Only the functions of a class that is not itself a block."""
    found = []
    for child in _own_nodes(node.body):
        if isinstance(child, _DEFS):
            found += _function_blocks(child, "nested")
        elif isinstance(child, ast.ClassDef):
            found += _nested_class(child)
    return found


def _class_blocks(node) -> list[dict]:
    own, members, inner = 1, [], []
    for child in _own_nodes(node.body):
        own += _points(child)
        if isinstance(child, _DEFS):
            members += _function_blocks(child, "method")
        elif isinstance(child, ast.ClassDef):
            inner += _nested_class(child)
    methods = [b["complexity"] for b in members if b["kind"] == "method"]
    complexity = (own - 1 + sum(methods)) // len(methods) + 1 if methods else own
    return [_block(node, "class", complexity), *members, *inner]


def blocks_of(source: str) -> list[dict]:
    """All blocks of a module: functions first, then each class with its methods."""
    functions, classes = [], []
    for node in _own_nodes(ast.parse(source).body):
        if isinstance(node, _DEFS):
            functions += _function_blocks(node, "function")
        elif isinstance(node, ast.ClassDef):
            classes += _class_blocks(node)
    found = functions + classes
    for position, block in enumerate(found):
        block["block_pos"] = position
    return found


def parsed(source: str | None) -> dict:
    try:
        return {"error": None, "blocks": blocks_of(source or "")}
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return {"error": f"{type(problem).__name__}: {problem}", "blocks": []}


@F.arrow_udf(PARSED)
def python_blocks(contents: pa.Array) -> pa.Array:
    """Error and blocks of every source of a batch."""
    return pa.array([parsed(source.as_py()) for source in contents], type=_ARROW_PARSED)
