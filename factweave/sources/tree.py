"""Source trees: reading files, extracting symbols and references, and making facts of them."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.schema import INGESTED_EXTENSIONS, SKIPPED_DIRS
from factweave.session import checkpoint, ship

#: One row per file, symbol or reference found in a file.
EXTRACTED = "path string, what string, id string, name string, kind string, doc string, content string, start_line int, end_line int, predicate string, object string, signature string"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), content, mtime of the files worth ingesting; bytes that are no UTF-8 are replaced."""
    skipped = "|".join(re.escape(d) for d in SKIPPED_DIRS)
    kinds = "|".join(re.escape(e) for e in INGESTED_EXTENSIONS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    where = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = "/" + root.split("://")[-1].strip("/") + "/"
    rel = F.expr("substring(p, {})".format(len(base) + 1))
    rows = files.select(where.alias("p"), "content", F.unix_seconds("modificationTime").alias("mtime")).select(rel.alias("path"), "content", "mtime")
    return rows.where(F.col("path").rlike(f"({kinds})$") & ~F.col("path").rlike(f"(^|/)({skipped})/")).select("path", F.decode("content", "UTF-8").alias("content"), "mtime")


def signature_of(content: str, python: bool) -> str:
    """What stands before the body of a declaration; of one without a body its first line."""
    depth, quote = 0, ""
    for i, c in enumerate(content):
        if quote:
            quote = "" if c == quote and content[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and c == ("{" if not python else ":"):
            return content[: i + python].strip()
    return content.split("\n", 1)[0]


class _Found:
    def __init__(self, path: str, text: str):
        self.path, self.lines, self.rows = path, text.split("\n"), []

    def symbol(self, name: str, kind: str, start: int, end: int, doc: str | None) -> str:
        sid = f"{self.path}:{name}"
        content = "\n".join(self.lines[start - 1 : end])
        self.rows.append((self.path, "symbol", sid, name, kind, doc, content, start, end, None, None, signature_of(content, self.path.endswith(".py"))))
        return sid

    def refer(self, source: str, predicate: str, target: str, line: int) -> None:
        target = target.strip().strip("\"'`").encode()[:1024].decode(errors="ignore")
        if target:
            self.rows.append((self.path, "ref", source, None, None, None, None, line, line, predicate, target, None))


def _python(f: _Found, text: str) -> None:
    """Exact, by the language's own parser; a file that does not parse has no symbols."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return

    def dotted(node: ast.expr) -> str:
        if isinstance(node, ast.Name):
            return node.id
        return f"{dotted(node.value)}.{node.attr}".lstrip(".") if isinstance(node, ast.Attribute) else ""

    def visit(nodes: list[ast.stmt], owner: str) -> None:
        for n in nodes:
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(n, ast.ClassDef)
                name = f"{owner}.{n.name}" if owner else n.name
                sid = f.symbol(name, "class" if is_class else "method" if owner else "function", n.lineno, n.end_lineno or n.lineno, ast.get_docstring(n))
                if is_class:
                    for b in n.bases:
                        f.refer(sid, "extends", dotted(b), n.lineno)
                    visit(n.body, name)
                else:
                    calls(n, sid)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    f.refer(f.path, "imports", a.name, n.lineno)
            elif isinstance(n, ast.ImportFrom):
                f.refer(f.path, "imports", "." * n.level + (n.module or ""), n.lineno)
            elif isinstance(n, ast.Assign | ast.AnnAssign) and not owner:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        f.symbol(t.id, "variable", n.lineno, n.end_lineno or n.lineno, None)

    def calls(fn: ast.AST, sid: str) -> None:
        for n in ast.walk(fn):
            if isinstance(n, ast.Call) and dotted(n.func):
                f.refer(sid, "calls", dotted(n.func), n.lineno)
            elif isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value.startswith(("/api", "http://", "https://")):
                f.refer(sid, "references", n.value, n.lineno)

    visit(tree.body, "")


_GO = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*\(|^type\s+(\w+)\s+(struct|interface)\b|^(?:var|const)\s+(\w+)\b", re.M)
_JS = re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)|^(?:export\s+)?(?:abstract\s+)?(class|interface)\s+(\w+)|^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*((?:async\s*)?(?:\([^)\n]*\)|\w+)\s*(?::[^=\n]+)?=>|function\b)?|^[ \t]+(?:(?:async|static|public|private|protected|get|set)\s+)*(\w+)\s*\([^)\n]*\)\s*(?::[^{\n]+)?\{", re.M)
_CALL = re.compile(r"(?<![\w.])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_ROUTE = re.compile(r"[\"'`]((?:/api|https?://)[^\"'`\s]*)[\"'`]")
_NO_CALL = frozenset("if for while switch return catch func function typeof new await defer go select case else do in of import require super constructor".split())


def _block_end(lines: list[str], start: int) -> int:
    """The line on which the braces opened at ``start`` close; strings and comments are passed over line by line."""
    depth, opened = 0, False
    for i in range(start - 1, len(lines)):
        line = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`|//.*$", "", lines[i])
        depth += line.count("{") - line.count("}")
        opened |= "{" in line
        if (opened and depth <= 0) or (not opened and i > start + 5):
            return i + 1 if opened else start
    return len(lines)


def _doc_above(lines: list[str], start: int) -> str | None:
    """The comment that ends on the line above."""
    i, out = start - 2, []
    while i >= 0 and re.match(r"^\s*(//|/?\*)", lines[i]):
        out.append(re.sub(r"^\s*(?://+|/\*+|\*+/?)\s?|\s*\*/\s*$", "", lines[i]))
        i -= 1
    return "\n".join(reversed(out)).strip() or None


def _braces(f: _Found, text: str, go: bool) -> None:
    owner, owner_end = "", 0
    breaks = [m.start() for m in re.finditer("\n", text)]
    line_at = lambda place: bisect.bisect_left(breaks, place) + 1
    for m in (_GO if go else _JS).finditer(text):
        line = line_at(m.start())
        if go:
            recv, fn, typ, sort, var = m.groups()
            name, kind = (f"{recv}.{fn}" if recv else fn, "method" if recv else "function") if fn else (typ, sort) if typ else (var, "variable")
        else:
            fn, sort, cls, var, arrow, method = m.groups()
            if method:
                if not owner or line > owner_end or method in _NO_CALL:
                    continue
                name, kind = f"{owner}.{method}", "method"
            else:
                name, kind = (fn, "function") if fn else (cls, sort) if cls else (var, "function" if arrow else "variable")
        end = _block_end(f.lines, line) if kind != "variable" else line
        if not go and kind in ("class", "interface"):
            owner, owner_end = name, end
        sid = f.symbol(name, kind, line, end, _doc_above(f.lines, line))
        if kind in ("function", "method"):
            body = "\n".join(f.lines[line - 1 : end])
            head = body.find("{")
            for c in _CALL.finditer(body, head if head > 0 else 0):
                if c[1].split(".")[0] not in _NO_CALL:
                    f.refer(sid, "calls", c[1], line + body.count("\n", 0, c.start()))
            for r in _ROUTE.finditer(body):
                f.refer(sid, "references", r[1], line + body.count("\n", 0, r.start()))
    if go:
        for block in re.finditer(r"^import\s*(?:\(([^)]*)\)|\"([^\"]+)\")", text, re.M):
            for target in re.findall(r"\"([^\"]+)\"", block[1]) if block[1] else [block[2]]:
                f.refer(f.path, "imports", target, line_at(block.start()))
    else:
        for m in re.finditer(r"^\s*(?:import|export)\b[^\n;]*?\bfrom\s*[\"']([^\"']+)[\"']|^\s*import\s*[\"']([^\"']+)[\"']|\brequire\(\s*[\"']([^\"']+)[\"']\s*\)", text, re.M):
            f.refer(f.path, "imports", m[1] or m[2] or m[3], line_at(m.start()))


def extract_text(path: str, text: str) -> list[tuple]:
    """EXTRACTED rows of one file."""
    f = _Found(path, text)
    f.rows.append((path, "file", path, path.rsplit("/", 1)[-1], "file", None, text, 1, len(f.lines), None, None, None))
    if path.endswith(".py"):
        _python(f, text)
    elif path.endswith(".go"):
        _braces(f, text, True)
    elif path.endswith((".ts", ".tsx", ".js", ".jsx")):
        _braces(f, text, False)
    return f.rows


def extract(files: DataFrame) -> DataFrame:
    """EXTRACTED rows of files (path, content): one Arrow pass, no shuffle. Null paths and contents are left out."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in b.itertuples(index=False, name=None) for r in extract_text(p, t)], columns=[c.split()[0] for c in EXTRACTED.split(", ")])

    return files.select("path", "content").where("path is not null and content is not null").mapInPandas(run, EXTRACTED)


def resolve_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (path, object) with target: the file an import means, by the first candidate that exists, else the text itself.

    Relative paths try the path itself, the extensions, .ts for .js and index files; dotted names try module files at the root and
    then, by an equi-join on path suffixes, anywhere.
    """
    known = files.select(F.col("path").alias("candidate")).distinct()
    rel = F.col("object").startswith(".")
    # ./a and ../a against the importing directory; python's leading dots climb likewise.
    python = F.col("path").endswith(".py")
    dots = F.length(F.regexp_extract("object", r"^(\.+)", 1))
    climb = F.when(python, dots - 1).otherwise(F.size(F.filter(F.split("object", "/"), lambda x: x == "..")))
    rest = F.when(python, F.translate(F.regexp_replace("object", r"^\.+", ""), ".", "/")).otherwise(F.regexp_replace("object", r"^(\.{1,2}/)+", ""))
    parts = F.split(X.dir_name("path"), "/")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - climb, F.lit(0))), "/")
    base = F.when(rel, F.concat_ws("/", F.when(up != "", up), F.when(rest != "", rest))).otherwise(F.col("object"))
    ends = ("", ".ts", ".tsx", ".js", ".jsx", ".py", ".go")
    slashed = F.translate("object", ".", "/")
    options = F.when(rel, F.array(*(F.concat(F.col("base"), F.lit(e)) for e in ends), F.regexp_replace("base", r"\.js$", ".ts"), F.regexp_replace("base", r"\.js$", ".tsx"), *(F.concat(F.col("base"), F.lit(f"/index{e}")) for e in ends[1:]), F.concat(F.col("base"), F.lit("/__init__.py")))).otherwise(F.array(F.col("object"), F.concat(slashed, F.lit(".py")), F.concat(slashed, F.lit("/__init__.py"))))
    rows = refs.withColumn("base", base).select("path", "object", "base", F.posexplode(options).alias("turn", "candidate"))
    hits = rows.join(known, "candidate").groupBy("path", "object").agg(F.min(F.struct("turn", "candidate")).alias("m")).select("path", "object", F.col("m.candidate").alias("found"))
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split("candidate", "/")), F.lit(2))), lambda i: F.array_join(F.slice(F.split(F.col("candidate"), "/"), i, 1000), "/"))
    by_suffix = known.where(F.col("candidate").endswith(".py") & F.col("candidate").contains("/")).select("candidate", F.explode(suffixes).alias("suffix")).groupBy("suffix").agg(F.min("candidate").alias("anywhere"))
    loose = refs.where(~rel & ~F.col("object").contains("/")).select("path", "object", F.explode(F.array(F.concat(slashed, F.lit(".py")), F.concat(slashed, F.lit("/__init__.py")))).alias("suffix")).join(by_suffix, "suffix").groupBy("path", "object").agg(F.min("anywhere").alias("anywhere"))
    return refs.withColumn("base", base).join(hits, ["path", "object"], "left").join(loose, ["path", "object"], "left").withColumn("target", F.coalesce("found", "anywhere", "base")).drop("base", "found", "anywhere")


def facts_of_tree(files: DataFrame, extracted: DataFrame, topic: int) -> DataFrame:
    """topic, s, p, o: definitions, kinds, names, packages, tags, roles, documentation, lines, imports and calls of a tree.

    The extracted rows are parsed once and checkpointed; all facts that one row implies are made of it in one pass, so only imports and
    calls, which look at other files, cost joins.
    """
    extracted = checkpoint(extracted)
    fact = lambda s, p, o, when=None: F.when(when if when is not None else F.lit(True), F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o")))
    i, path, k = F.col("id"), F.col("path"), F.col("kind")
    package, short = X.package_of("path"), X.short_name("id")
    low = F.lower(package)
    of_file = [fact(i, "type", F.lit("file")), fact(i, "in_package", package), fact(i, "has_language", X.language_of("path"))]
    of_symbol = [
        fact(path, "defines", i), fact(i, "type", k), fact(i, "has_kind", F.when(k == "function", "func").otherwise(k)), fact(i, "in_package", package), fact(i, "name", F.col("name")), fact(i, "has_name", short), fact(i, "start_line", F.col("start_line")), fact(i, "end_line", F.col("end_line")), fact(i, "has_doc", F.col("doc")),
        fact(i, "has_role", F.lit("data_contract"), k.isin("struct", "interface", "class")), fact(i, "has_role", F.lit("api_handler"), (k == "method") & short.startswith("handle")), fact(i, "has_role", F.lit("utility"), low.rlike("util|helper") | F.lower("name").contains("util")),
    ]
    tags = F.transform(X.tags_of("path"), lambda t: F.struct(i.alias("s"), F.lit("has_tag").alias("p"), t.alias("o")))
    made = F.when(F.col("what") == "file", F.concat(F.array(*of_file), tags)).when(F.col("what") == "symbol", F.array(*of_symbol)).otherwise(F.when(F.col("predicate") == "references", F.array(fact(i, "references", F.col("object")))))
    own = extracted.select(F.explode(F.array_compact(made)).alias("f")).select("f.s", "f.p", "f.o")
    ref = extracted.where("what = 'ref'")
    imports = resolve_imports(ref.where("predicate = 'imports'").select("path", "object").distinct(), files).select(F.col("path").alias("s"), F.lit("imports").alias("p"), F.col("target").alias("o"))
    names = extracted.where("what = 'symbol'").groupBy(short.alias("short")).agg(F.max("id").alias("known"))
    lang = F.when(path.endswith(".go"), "go").when(path.endswith(".py"), "python").otherwise("js")
    calls = ref.where("predicate = 'calls'").where(~X.is_stdlib_call("object", lang)).withColumn("short", F.substring_index("object", ".", -1)).join(names, "short", "left").select(i.alias("s"), F.lit("calls").alias("p"), F.coalesce("known", "object").alias("o"))
    rows = own.unionByName(imports).unionByName(calls).where("o is not null").distinct()
    return rows.select(F.lit(topic).alias("topic"), "s", "p", "o")


def documents_of_tree(extracted: DataFrame, topic: int) -> DataFrame:
    """The document table of files and symbols: content and metadata of each id."""
    meta = F.struct(F.col("path").alias("file"), "start_line", "end_line", "signature", X.package_of("path").alias("package"), X.tags_of("path").alias("tags"))
    return extracted.where("what in ('symbol', 'file')").groupBy("id").agg(F.min(F.struct("content", meta.alias("metadata"))).alias("d")).select(F.lit(topic).alias("topic"), F.col("id").alias("doc_id"), "d.content", "d.metadata")


def save_documents(documents: DataFrame, path: str) -> None:
    """Write the document table by topic, sorted by id, so that point reads prune. Spark retries a task that fails; a job is all or nothing."""
    documents.hint("rebalance", "topic").sortWithinPartitions("topic", "doc_id").write.mode("overwrite").partitionBy("topic").parquet(path)
