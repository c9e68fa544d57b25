"""Facts of source text.

A Python file is parsed once.  Its syntax tree comes out as rows of a few kinds, each with the scope that it stands in and its place; what they
mean (symbols, call targets, types, states) is worked out by joins and aggregations over all files.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.tables import dealt

#: fact: scope (a definition), bind (a name gets a value), call, attr, import or alias (a name from an import).  seq is the place in the
#: file, depth that in the tree; direct: the statement stands in the body of its scope itself.
FACTS = (
    "path string, fact string, seq bigint, depth int, scope int, direct boolean, kind string, id string, caller string, accessor string, owner string, cls string,"
    " label string, name string, line int, names array<string>, type string, how string, store boolean"
)
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in FACTS.split(","))])
_JS = r"""(?:\bfrom\s+|\bimport\s+|\brequire\s*\(\s*)['"]([^'"]+)['"]"""
#: Rows of facts after which a task hands on what it has: a batch of files has many times as many rows.
ROWS = 4096
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class Scope(NamedTuple):
    """A file, class or function.  Calls in a class body belong to the file, accesses there to the code around the class."""

    number: int
    kind: str
    id: str
    label: str
    caller: str
    accessor: str
    cls: str | None
    symbol: bool  # a definition that stands in the body of a symbol, or of the file, is a symbol
    depth: int


def dotted(node: ast.AST | None) -> list[str | None]:
    """The names of a plain name (one) or of an attribute (two, the first null unless it is a plain name); empty for anything else."""
    match node:
        case ast.Name(id=name):
            return [name]
        case ast.Attribute(value=ast.Name(id=base), attr=name):
            return [base, name]
        case ast.Attribute(attr=name):
            return [None, name]
    return []


def syntax_rows(path: str, source: str) -> Iterator[dict]:
    """The rows of one Python file; none if it has a syntax error.  Of definitions only bodies are read: no decorators, defaults or bases."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    here = f"file:{path}"
    scopes = 0
    todo = [(node, Scope(0, "file", here, "", here, here, None, True, 0), 1) for node in reversed(tree.body)]
    while todo:
        node, at, depth = todo.pop()
        direct = depth == at.depth + 1
        row = {"scope": at.number, "depth": depth, "direct": direct, "caller": at.caller, "accessor": at.accessor, "cls": at.cls, "kind": at.kind}
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                scopes += 1
                is_class = isinstance(node, ast.ClassDef)
                label = f"{at.label}.{node.name}".removeprefix(".")
                own = f"{'class' if is_class else 'func'}:{path}#{label}"
                inner = Scope(scopes, "class" if is_class else "function", own, label, here if is_class else own, at.accessor if is_class else own, label if is_class else at.cls, direct and at.symbol, depth)
                bases = [b[-1] for b in map(dotted, node.bases) if b] if is_class else None
                yield {"fact": "scope", "scope": scopes, "depth": depth, "direct": inner.symbol, "kind": inner.kind, "id": own, "owner": at.id, "cls": inner.cls, "label": label, "name": node.name, "line": node.lineno, "names": bases, "type": "class" if is_class else "method" if at.kind == "class" else "function"}
                if not is_class:
                    row = row | {"scope": scopes, "kind": inner.kind, "accessor": own, "direct": False}
                    for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                        if a.arg != "self" and (name := dotted(a.annotation)):
                            yield row | {"fact": "bind", "name": a.arg, "type": name[-1], "how": "annotation"}
                todo += [(child, inner, depth + 1) for child in reversed(node.body)]
                continue
            case ast.Import(names=names):
                for a in names:
                    top = a.name.partition(".")[0]
                    yield row | {"fact": "import", "name": top, "label": a.name}
                    yield row | {"fact": "alias", "name": a.asname or top, "label": a.name if a.asname else top}
            case ast.ImportFrom(level=0, module=str(module), names=names):
                top = module.partition(".")[0]
                yield row | {"fact": "import", "name": top, "label": module}
                for a in names:
                    yield row | {"fact": "import", "name": top, "label": f"{module}.{a.name}"}
                    yield row | {"fact": "alias", "name": a.asname or a.name, "label": module, "type": a.name}
            case ast.Call(func=func):
                yield row | {"fact": "call", "names": dotted(func)}
            case ast.Attribute(attr=name, ctx=ctx):
                yield row | {"fact": "attr", "name": dotted(node)[0], "label": name, "store": isinstance(ctx, ast.Store)}
            case ast.AnnAssign(target=ast.Name(id=name), annotation=given):
                yield row | {"fact": "bind", "name": name, "type": (dotted(given) or [None])[-1], "how": "annotation"}
            case ast.Assign(targets=[ast.Name(id=name)], value=value):
                made = dotted(value.func) if isinstance(value, ast.Call) else []
                yield row | {"fact": "bind", "name": name, "type": made[-1] if made else None, "how": "constructor" if made else "other"}
        todo += [(child, at, depth + 1) for child in reversed(list(ast.iter_child_nodes(node)))]


def python_facts(sources: DataFrame) -> DataFrame:
    """The rows of all files of (path, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for path, source in zip(b.column("path"), b.column("source"), strict=True):
                name = path.as_py()
                for n, r in enumerate(syntax_rows(name, source.as_py() or "")):
                    rows.append({"path": name, "seq": n} | r)
                    if len(rows) >= ROWS:
                        yield from pa.Table.from_pylist(rows, _SCHEMA).to_batches()
                        rows = []
            if rows:
                yield from pa.Table.from_pylist(rows, _SCHEMA).to_batches()

    return sources.select("path", "source").mapInArrow(run, FACTS)


def call_sites(facts: DataFrame) -> DataFrame:
    """Path, caller, cls (the class around) and names: one name, or receiver and attribute; empty for other calls."""
    return facts.filter("fact = 'call'").select("path", F.col("caller"), "cls", "names")


def imported_names(facts: DataFrame) -> DataFrame:
    """Path, bound, module and original: what a name stands for by imports; of several the deepest, then the last."""
    rows = facts.filter("fact = 'alias'").groupBy("path", F.col("name").alias("bound"))
    last = rows.agg(F.max_by(F.struct("label", "type"), F.struct("depth", "seq")).alias("x"))
    return last.select("path", "bound", F.col("x.label").alias("module"), F.col("x.type").alias("original"))


def type_env(facts: DataFrame) -> DataFrame:
    """Path, scope, name, type and how of the names whose type is known in a function, wherever in it they are used.

    The last binding counts: an annotation or a construction gives a type, any other value takes it away; an annotation that is no
    plain name says nothing.
    """
    known = facts.filter("fact = 'bind' and kind = 'function' and (how <> 'annotation' or type is not null)")
    last = known.groupBy("path", "scope", "name").agg(F.max_by(F.struct("type", "how"), "seq").alias("x"))
    return last.filter("x.type is not null").select("path", "scope", "name", "x.type", "x.how")


def state_accesses(facts: DataFrame) -> DataFrame:
    """Path, seq, accessor, store, attr, cls, type and how of each attribute access; how is self, annotation, constructor or unresolved."""
    env = type_env(facts).select("path", "scope", "name", F.col("type").alias("known"), F.col("how").alias("by"))
    rows = facts.filter("fact = 'attr'").select("path", "seq", "scope", "kind", "accessor", "store", "cls", "name", F.col("label").alias("attr"))
    own = (F.col("name") == "self") & F.col("cls").isNotNull()
    how = F.when(own, "self").otherwise(F.coalesce("by", F.lit("unresolved")))
    return rows.join(env, ["path", "scope", "name"], "left").select("path", "seq", "accessor", "store", "attr", "cls", F.when(~F.coalesce(own, F.lit(False)), F.col("known")).alias("type"), how.alias("how"))


def class_states(facts: DataFrame) -> DataFrame:
    """Path and label of the names that are bound in a class body, and of the attributes of self."""
    body = facts.filter("fact = 'bind' and kind = 'class' and direct").select("path", F.concat_ws(".", "cls", "name").alias("label"))
    own = facts.filter("fact = 'attr' and name = 'self' and cls is not null").select("path", F.concat_ws(".", "cls", "label").alias("label"))
    return body.unionByName(own).distinct()


def python_imports(facts: DataFrame) -> DataFrame:
    """Path and its distinct top-level imports, sorted."""
    return facts.filter("fact = 'import'").groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("imports"))


def js_imports(source: Column) -> Column:
    """Specifiers of from, import and require: the head before / unless relative; distinct and sorted."""
    found = F.regexp_extract_all(source, F.lit(_JS), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.when(x.startswith("."), x).otherwise(F.substring_index(x, "/", 1)))))


def imports_of(sources: DataFrame) -> DataFrame:
    """(path, imports) by language: parsed for Python, by pattern for JavaScript and TypeScript, none else."""
    py = python_imports(python_facts(dealt(sources.filter("language = 'python'")))).withColumnRenamed("imports", "py")
    empty = F.array().cast("array<string>")
    return sources.join(py, "path", "left").select("path", F.when(F.col("language") == "python", F.coalesce("py", empty)).when(F.col("language").isin("javascript", "typescript"), js_imports(F.col("source"))).otherwise(empty).alias("imports"))


def is_stdlib(name: Column) -> Column:
    """A module of this interpreter's standard library; a fixed set of a few hundred names."""
    return name.isin(sorted(sys.stdlib_module_names))


def forbidden_imports(facts: DataFrame, prefixes: list[str]) -> DataFrame:
    """(path, module) of imports equal to or below a prefix."""
    test = F.lit(False)
    for p in prefixes:
        test = test | (F.col("label") == p) | F.col("label").startswith(p + ".")
    return facts.filter((F.col("fact") == "import") & test).select("path", F.col("label").alias("module")).distinct()
