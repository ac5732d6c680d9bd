"""Source files (path, language, content) to symbols and references: Arrow batches, a bad file gives nothing.

Python goes through the standard `ast`; languages with braces go through statements (see scanner), so declarations may cover
several lines, and comments and strings declare nothing. Bash and configuration formats (TOML, INI, Makefile, CMake, Tcl) go
through line rules (RULES) over lines joined with what continues them, with sections as symbols. Calls to keywords are no references.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import scanner

SYMBOLS = "path string, language string, kind string, name string, qualified string, parent string, signature string, bases string, first int, last int, exported boolean, docstring string, source_hash string"
REFERENCES = "path string, language string, origin string, kind string, target string, line int"

_CALL = r"\b([A-Za-z_][\w]*(?:(?:\.|::|->)[A-Za-z_]\w*)*)\s*\("
_KEYWORDS = frozenset("if for while switch return sizeof catch function fn func def class new typeof await yield do else elif in not and or assert print echo match when using lock foreach".split())

#: Language: (symbol rules (kind, expression with a group `name`), reference rules (kind, expression), block style).
RULES: dict[str, tuple[list[tuple[str, str]], list[tuple[str, str]], str]] = {
    "bash": ([("function", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?"), ("function", r"^\s*function\s+(?P<name>[\w-]+)\s*\{")], [("calls", r"^\s*([A-Za-z_][\w-]*)(?:\s|$)")], "brace"),
    "cmake": ([("function", r"(?i)^\s*(?:function|macro)\s*\(\s*(?P<name>\w+)"), ("executable", r"(?i)^\s*add_executable\s*\(\s*(?P<name>[\w.-]+)"), ("library", r"(?i)^\s*add_library\s*\(\s*(?P<name>[\w.-]+)")], [("link_dependency", r"(?i)target_link_libraries\s*\(\s*\S+\s+((?:[\w:.-]+\s*)+)"), ("calls", r"^\s*(\w+)\s*\(")], "none"),
    "makefile": ([("target", r"^(?P<name>[\w./%-]+)\s*:(?![=])")], [("prerequisite", r"^[\w./%-]+\s*:(?!=)\s*([^#=]+)")], "next"),
    "tcl": ([("hls_project", r"^\s*open_project\s+(?:-reset\s+)?(?P<name>\S+)"), ("hls_top", r"^\s*set_top\s+(?P<name>\S+)")], [("hls_source", r"^\s*add_files\s+(?:-\S+\s+)*(\S+)"), ("hls_synth", r"^\s*(csynth_design)"), ("hls_export", r"^\s*(export_design)")], "next"),
    "config": ([("section", r"^\s*\[(?P<name>[^\]]+)\]"), ("hls_top", r"^\s*syn\.top\s*=\s*(?P<name>\S+)"), ("kernel_instance", r"^\s*nk\s*=\s*(?P<name>[^:\s]+)")], [("hls_source", r"^\s*syn\.file\s*=\s*(\S+)"), ("stream_connect", r"^\s*(?:sc|stream_connect)\s*=\s*(\S+)"), ("memory_map", r"^\s*sp\s*=\s*(\S+)")], "next"),
    "toml": ([("table_array", r"^\s*\[\[(?P<name>[^\].]+)"), ("table", r"^\s*\[(?P<name>[^\[\].]+)")], [], "next"),
}


def parse_python(path: str, content: str) -> tuple[list[tuple], list[tuple]]:
    tree = ast.parse(content)
    rows = content.split("\n")
    public = next(({e.value for e in n.value.elts if isinstance(e, ast.Constant)} for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.value, (ast.List, ast.Tuple)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets)), None)
    symbols, references = [], []

    def visit(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{parent}.{child.name}" if parent else child.name
                of_class = isinstance(child, ast.ClassDef)
                bases = ",".join(ast.unparse(b) for b in child.bases) if of_class else None
                signature = f"{child.name}({bases})" if of_class else f"{child.name}({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                source = "\n".join(rows[child.lineno - 1 : child.end_lineno])
                exported = child.name in public if public is not None and not parent else not child.name.startswith("_")
                symbols.append((path, "python", "class" if of_class else "method" if parent else "function", child.name, name, parent, signature, bases, child.lineno, child.end_lineno, exported, ast.get_docstring(child), hashlib.sha256(source.encode()).hexdigest()[:16]))
                references.extend((path, "python", name, "extends", ast.unparse(b), child.lineno) for b in (child.bases if of_class else ()))
                visit(child, name)
                continue
            if isinstance(child, ast.Import):
                references.extend((path, "python", parent, "imports", a.name, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                references.extend((path, "python", parent, "imports", f"{module}:{a.name}", child.lineno) for a in child.names)
            elif isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                references.append((path, "python", parent, "calls", ast.unparse(child.func), child.lineno))
            visit(child, parent)

    visit(tree, None)
    return symbols, references


def parse_statements(path: str, language: str, content: str) -> tuple[list[tuple], list[tuple]]:
    found, links = scanner.scan(language, content)
    line = scanner.Lines(content)
    symbols = []
    for r in found:
        source = content[r["start"] : r["end"] + 1]
        public = "private" not in r["head"] and (r["name"][:1].isupper() if language == "go" else not r["name"].startswith(("_", "#")))
        symbols.append((path, language, r["kind"], r["name"], r["id"], r["parent"], r["head"], ",".join(r["bases"]) or None, line(r["start"]), line(r["end"]), public, None, hashlib.sha256(source.encode()).hexdigest()[:16]))
    return symbols, [(path, language, origin, kind, target, line(at)) for at, origin, kind, target in links]


#: Comments of the languages that go line by line.
_REMARKS = {"bash": r"(?<![\w$\"'{])#.*$", "cmake": r"#.*$", "makefile": r"(?<!\\)#.*$", "tcl": r"^\s*#.*$", "config": r"^\s*[#;].*$", "toml": r"^\s*#.*$"}


def parse_lines(path: str, language: str, content: str) -> tuple[list[tuple], list[tuple]]:
    kinds, links, style = RULES[language]
    kinds, links = [(k, re.compile(p)) for k, p in kinds], [(k, re.compile(p)) for k, p in links]
    symbols, references = [], []
    open_, depth = [], 0  # (index in symbols, depth where its block began)

    def close(line: int, upto: int) -> None:
        while open_ and open_[-1][1] >= upto:
            symbols[open_.pop()[0]][9] = line

    if language == "toml":  # what stands in strings of several lines is no table
        content = re.sub(r'"""(?:\\.|[^\\])*?"""|\'\'\'.*?\'\'\'', lambda m: re.sub(r"[^\n]", " ", m[0]), content, flags=re.S)
    content, last = re.sub("(?m)" + _REMARKS[language], "", content), 1
    for n, last, code in scanner.logical_lines(content, parens=language == "cmake"):
        found = None
        for kind, rule in kinds:
            if (m := rule.match(code)) and m["name"] not in _KEYWORDS:
                found = m
                break
        if found:
            if style == "next":
                close(n - 1, 0)
            symbols.append([path, language, kind, found["name"], found["name"], None, code.strip().rstrip("{").strip(), None, n, last, not found["name"].startswith("_"), None, hashlib.sha256(code.encode()).hexdigest()[:16]])
            open_.append((len(symbols) - 1, 0 if style == "next" else depth))
        origin = symbols[open_[-1][0]][4] if open_ else None
        for kind, rule in links:
            for m in rule.finditer(code):
                for target in m[1].split() if kind in ("prerequisite", "link_dependency") else [m[1]]:
                    if target not in _KEYWORDS and target not in ("PUBLIC", "PRIVATE", "INTERFACE") and not (found and kind == "calls" and target == found["name"]):
                        references.append((path, language, origin, kind, target, n))
        if style == "brace":
            depth += code.count("{") - code.count("}")
            if "}" in code or (found and "{" not in code and code.rstrip().endswith(";")):
                close(last, depth)
        elif style == "none":
            close(last, 0)
    close(last, 0)
    return [tuple(s) for s in symbols], references


def parse(path: str, language: str, content: str | None) -> tuple[list[tuple], list[tuple]]:
    """(symbols, references) of a file; nothing for a null or broken one, or a language without rules."""
    try:
        if not content:
            return [], []
        if language == "python":
            return parse_python(path, content)
        return parse_statements(path, language, content) if language in scanner.DECLARATIONS else parse_lines(path, language, content) if language in RULES else ([], [])
    except (SyntaxError, ValueError, RecursionError):
        return [], []


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _run(which: int, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([row for args in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in parse(*args)[which]], schema)

    return run


def symbols(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    return files.select("path", "language", "content").mapInArrow(_run(0, SYMBOLS), SYMBOLS)


def references(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    return files.select("path", "language", "content").mapInArrow(_run(1, REFERENCES), REFERENCES)


def import_candidates(path, language):
    """The files that a resolved import path may stand for, in order of trial."""
    python = [F.concat(path, F.lit(x)) for x in (".py", "/__init__.py")]
    script = [F.concat(path, F.lit(x)) for x in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")]
    return F.when(language == "python", F.array(*python)).otherwise(F.array(*script))


def resolve_import_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (import_id, path, language) to the first candidate among files (path); null where none exists."""
    tried = imports.select("import_id", F.posexplode(import_candidates(F.col("path"), F.col("language"))).alias("ord", "candidate"))
    hits = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("import_id").agg(F.min_by("candidate", "ord").alias("resolved_path"))
    return imports.join(hits, "import_id", "left")
