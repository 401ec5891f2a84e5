"""P2: functions and methods paired with their documentation.

One Arrow pass parses every symbol (comment markers, tags, docstrings, class headers); class hierarchies are then walked by an
iterative join, so that documentation a method inherits resolves to the nearest ancestor that has any. What stays without a
statement is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpoint, own_columns, ship

# Kinds that name a function or method, and those that name something else.
FUNCTION_KINDS = frozenset("function func fn fun def method meth mth member_function constructor ctor procedure proc subroutine sub arrow_function generator getter setter closure lambda".split())
CLASS_KINDS = frozenset("class cls struct interface iface type trait".split())
# Remarks that say nothing, in the ten languages of the texts.
STOCK = frozenset(
    """doc|docs|comment|comments|none|null|nil|n/a|na|tbd|wip|description|documentation|docstring|summary|no description|no documentation|no docs|undocumented|not documented|missing|empty|placeholder|deprecated|internal|private|public|see above|see below|see code|see source|as above|ditto|same as above|self explanatory|self-explanatory
    |helper|helper function|helper method|utility|constructor|getter|setter|method|function|init|initializer|main|test|generated|auto generated|siehe oben|keine beschreibung|voir ci-dessus|pas de description|ver arriba|sin descripción|ver acima|sem descrição|vedi sopra|nessuna descrizione|zie boven|geen beschrijving|см. выше|нет описания|同上|なし|说明|無し|暂无|見よ|待补充|add description|add docs|fill in|to do|write docs|write me|describe|describe me|lorem ipsum|works|magic|do not touch|don't touch""".replace("\n", "").replace("    ", "").split("|")
)
_DIRECTIVE = re.compile(
    r"^(?:go:\w+|\+build\b|nolint\b|lint:|noqa\b|pylint\s*:|type:\s*ignore|mypy\s*:|pyright\s*:|flake8\b|isort\s*:|fmt\s*:|yapf\s*:|eslint\b|eslint-|tslint\s*:|jshint\b|jslint\b|prettier-|@ts-|ts-ignore|istanbul\b|c8 ignore|v8 ignore|pragma\b|region\b|endregion\b|nosonar\b|nosec\b|clang-format|clang-tidy|rustfmt|swiftlint\s*:|phpcs\s*:|coverage\s*:|cspell\s*:|spell-?checker\s*:|sourcemappingurl|webpack\w+\s*:|@formatter|biome-ignore|deno-lint|codecov|!/|-\*-|vim?:|export \w+$|extern\b \"c\")",
    re.I,
)
_REMINDER = re.compile(r"^(?:@?todo|to-do|fixme|fix me|xxx+|hack|bug|tbd|wip|nb|review me|optimi[sz]e me)\b", re.I)
_LICENCE = re.compile(r"copyright|\(c\)\s*\d{4}|©|spdx-license|licen[sc]ed under|all rights reserved|licen[sc]e[:.]|permission is hereby|without warranty|redistribution and use|see (?:the )?licen[sc]e", re.I)
_TAG = re.compile(r"^(?:\{?[@\\](\w[\w-]*)\}?|:(\w+)\b[^:]*:)\s*(.*)$", re.S)
_TEXT_TAGS = frozenset("brief summary description desc details remarks remark short abstract".split())
_RESULT_TAGS = frozenset("return returns result yield yields".split())
_SECTION = re.compile(r"^(?:args?|arguments?|params?|parameters?|returns?|raises?|throws|yields?|examples?|attributes|see also|references)\s*:?\s*(?:-{3,})?$", re.I)
_CODE = re.compile(r":=|[!=<>]=|=>|&&|\|\||;\s*$|\{\s*$|^\}|\bself\.\w|\w\.\w+\([^)]*\)\s*[;:)]?\s*$|^\w[\w.]*\s*=\s*\S|^(?:if|for|while|return|const|let|var|def|func|function|import|from|await|async|try|switch|case|else|elif|print)\b.*[=({:;\[]|^\w[\w.]*\([^)]*\)\s*;?$|^@\w+\(|^(?:return|break|continue|pass)\b[^.]*;?$")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?!\w)|//+[!/]?|#+!?|--+|;+|\"\"\"|'''|%+|<!--)[ \t]?")
_END = re.compile(r"\s*(?:\*+/|\"\"\"|'''|-->)\s*$")


def words_of(name: str) -> set[str]:
    """The lower-case words of an identifier."""
    return {w.lower() for part in re.split(r"[\W_]+", name) for w in _CAMEL.findall(part)}


def clean_comment(raw: str) -> list[str]:
    """The lines of a comment without its markers; lines of a block comment keep their order."""
    out = []
    for line in re.split(r"\r\n|\r|\n", raw.strip()):
        prev = None
        while prev != line:
            prev, line = line, _END.sub("", line)
        line = _MARK.sub("", _MARK.sub("", line, count=1) if line.lstrip().startswith(("/*", '"""', "'''")) else line, count=1)
        out.append(re.sub(r"</?[a-zA-Z][^<>]*>", " ", line).strip())
    return out


def says_something(sentence: str, name: set[str]) -> bool:
    """Whether a sentence states more than the symbol's own name."""
    text = sentence.strip(" \t-–—*=#_~.:!?,;。！？'\"`()[]")
    if not text or text.lower() in STOCK or _REMINDER.match(text) or _DIRECTIVE.match(text) or _LICENCE.search(text):
        return False
    plain = re.sub(r"`[^`]*`", " ", text)
    if len(_CJK.findall(plain)) >= 5:
        return True
    if _CODE.search(plain):
        return False
    words = [w.lower() for part in _WORD.findall(plain) for w in _CAMEL.findall(part)]
    return len([w for w in words if w not in name]) >= 2


def describe(raw: str | None, name: set[str]) -> tuple[str | None, bool]:
    """The description in a raw comment, or None if no statement is in it; and whether a tag says that it is inherited."""
    if not raw or not raw.strip():
        return None, False
    kept, inherited, skipping = [], False, False
    for line in clean_comment(raw):
        tag = _TAG.match(line)
        if tag and not _DIRECTIVE.match(line):
            word = (tag[1] or tag[2]).lower()
            inherited |= word in ("inheritdoc", "override", "inherit", "overrides")
            skipping = not (word in _TEXT_TAGS or word in _RESULT_TAGS)
            line = "" if skipping else re.sub(r"^\{[^}]*\}\s*", "", tag[3])
        elif _SECTION.match(line):
            skipping, line = True, ""
        elif not line:
            skipping = skipping and not kept
        if line and not skipping and not _DIRECTIVE.match(line) and not _LICENCE.search(line) and not _REMINDER.match(line):
            kept.append(line)
    # A statement may run over several lines; code that was commented out is judged by the line.
    prose = [x for x in kept if not (_CODE.search(re.sub(r"`[^`]*`", " ", x)) and not re.search(r"\w[.!?]$|[。！？]$", x))]
    good = [s.strip() for s in _SENTENCE.split(" ".join(prose)) if s and not _REMINDER.match(s.strip())]
    if not any(says_something(s, name) for s in good):
        return None, inherited or bool(re.search(r"\{@inheritdoc\}", raw, re.I))
    return " ".join(good), inherited


_DOCSTRING = re.compile(r"\s*(?:@[^\n]*\n\s*)*(?:async\s+)?def\s+\w+\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[^:\n]*:[ \t]*(?:#[^\n]*)?\n?\s*[rRuUbBfF]{0,2}(\"\"\"|'''|\"|')")
_HEAD_COMMENT = re.compile(r"\s*(?:/\*.*?\*/|(?://[^\n]*(?:\n\s*|$))+|(?:#(?![!\[])[^\n]*(?:\n\s*|$))+)", re.S)
_FUNCTION = re.compile(
    r"^(?:@[^\n]*\n\s*)*(?:(?:export|default|async|static|public|private|protected|abstract|override|final|inline|pub|get|set|readonly|virtual)\s+)*(?:(?:func|def|fn|fun|function\*?)\b|(?:const|let|var)\s+\w+\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|\w+)\s*(?::[^=\n]+)?=>|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?function\b|(?!(?:if|for|while|switch|return|catch|class|interface|struct|type|enum|const|let|var|import|package|with)\b)[A-Za-z_$#][\w$]*\s*(?:<[^>\n]*>)?\([^)\n]*\)\s*(?::[^{;\n]+)?\{)"
)
_CLASS = re.compile(r"^(?:(?:export|default|abstract|public|final|data|sealed)\s+)*(?:class|interface|struct|type|trait)\s+(\w+)\s*(?:\(([^)]*)\)|(?:<[^>]*>)?\s*(?:extends\s+([\w., <>]+?))?\s*(?:implements\s+([\w., <>]+?))?\s*\{|\s+(?:struct|interface)\s*\{([^}]*)\})?", re.M)


def split_content(content: str | None) -> tuple[str, str, str]:
    """Leading comments of a symbol's text, its docstring, and the code without either."""
    if not content:
        return "", "", content or ""
    at, head = 0, []
    while (m := _HEAD_COMMENT.match(content, at)) and m.end() > at:
        head.append(m[0])
        at = m.end()
    code = content[at:]
    m = _DOCSTRING.match(code)
    if not m:
        return "\n".join(head), "", code
    quote = m[1]
    end = code.find(quote, m.end())
    if end < 0 or (len(quote) == 1 and "\n" in code[m.end() : end]):
        return "\n".join(head), "", code
    return "\n".join(head), code[m.end() : end], code[: m.start(1)].rstrip() + code[end + len(quote) :]


def _kind(kind: str | None, code: str) -> str | None:
    word = re.sub(r"[\s-]+", "_", kind.strip().lower()).rstrip(".") if kind and kind.strip() else ""
    if word in FUNCTION_KINDS:
        return "function"
    if word:
        return "class" if word in CLASS_KINDS else None
    body = code.lstrip()
    return "class" if _CLASS.match(body) and re.match(r"(?:\w+\s+)*(?:class|interface|struct|trait|type)\b", body) else "function" if _FUNCTION.match(body) else None


PARSED = "symbol_key long, symbol_id string, project string, kind string, owner string, name string, bases array<string>, description string, asks boolean, code string, signature string"


def parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """symbols -> PARSED, one row per function, method or class."""
    for b in batches:
        rows = []
        for key, sid, sname, skind, owner, sig, doc, content in b.itertuples(index=False, name=None):
            head, docstring, code = split_content(content)
            kind = _kind(skind, code)
            if kind is None:
                continue
            local = (sid or "").partition(":")[2] or (sname or "")
            parent, _, last = local.rpartition(".")
            last = sname.rpartition(".")[2] if sname else last
            bases: list[str] = []
            if kind == "class":
                m = _CLASS.search(code)
                if m:
                    bases = [re.sub(r"<.*", "", x).strip().rpartition(".")[2] for g in (m[2], m[3], m[4]) if g for x in g.split(",") if "=" not in x]
                    bases += [x for x in re.findall(r"^\s*\*?(?:\w+\.)?([A-Z]\w*)\s*$", m[5] or "", re.M)]
                    bases = [x for x in bases if re.fullmatch(r"\w+", x) and x not in ("object", "ABC", "Protocol")]
                rows.append((key, sid, (sid or "").partition("/")[0], kind, None, last, bases, None, False, None, None))
                continue
            names = words_of(last) | words_of(owner or "") | words_of(parent)
            found, asks = None, False
            for raw in (doc, docstring, head):
                text, wants = describe(raw, names)
                asks |= wants
                found = found or text
            rows.append((key, sid, (sid or "").partition("/")[0], kind, owner or parent or None, last, bases, found, asks, code, sig))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])


def _resolved(rows: DataFrame, classes: DataFrame, name: str, into: str) -> DataFrame:
    """rows (project, file, and a class name) with the class meant: the one in the same file, else in the same folder, else the only one of the project.

    Each place has one class a name, so the joins multiply nothing, however often a name is used. A name of several classes elsewhere means none.
    """
    folder = F.regexp_replace("file", "/[^/]*$", "")
    here = classes.select("project", "file", F.col("name").alias(name), F.concat_ws(":", "file", "name").alias("_here"))
    near = classes.groupBy("project", folder.alias("_folder"), F.col("name").alias(name)).agg(F.min("file").alias("f"), F.count(F.lit(1)).alias("n")).where("n = 1").select("project", "_folder", name, F.concat_ws(":", "f", name).alias("_near"))
    only = classes.groupBy("project", F.col("name").alias(name)).agg(F.min("file").alias("f"), F.count(F.lit(1)).alias("n")).where("n = 1").select("project", name, F.concat_ws(":", "f", name).alias("_only"))
    found = rows.withColumn("_folder", folder).join(here, ["project", "file", name], "left").join(near, ["project", "_folder", name], "left").join(only, ["project", name], "left")
    return found.withColumn(into, F.coalesce("_here", "_near", "_only")).drop("_folder", "_here", "_near", "_only")


def document_pairs(symbols: DataFrame, inherit: bool = True) -> DataFrame:
    """symbol_key, symbol_id, signature, code, description, origin (own or inherited): one row per documented function row.

    A method without a statement of its own gets that of the nearest ancestor class that has one for a method of this name. Classes
    are told apart by file and name; a base is the class of its name in the same file, else folder, else project. The loop ends when nothing
    is left to resolve; a class met again (a cyclic hierarchy) is not followed twice. Repeated rows count each. Nulls: null kind is told
    from the content; null signature stays null; rows with null doc_comment and null content are dropped. Empty texts are no documentation.
    Extra columns are ignored; an empty table gives an empty result.
    """
    cols = own_columns(symbols, "symbol_key", "symbol_id", "symbol_name", "symbol_kind", "receiver_type", "signature", "doc_comment", "symbol_content")
    ship(cols.sparkSession)
    parsed = cols.mapInPandas(parse_batches, PARSED)
    out = ["symbol_key", "symbol_id", "signature", "code", "description"]
    if not inherit:
        return parsed.where("kind = 'function' and description is not null").select(*out, F.lit("own").alias("origin"))
    parsed = checkpoint(parsed.withColumn("file", F.substring_index("symbol_id", ":", 1)))
    own = parsed.where("kind = 'function' and description is not null").select(*out, F.lit("own").alias("origin"))
    heads = parsed.where("kind = 'class' and file is not null")
    classes = heads.select("project", "file", "name").distinct()
    bases = heads.where("size(bases) > 0").select("project", "file", F.concat_ws(":", "file", "name").alias("at"), F.explode("bases").alias("base_name")).distinct()
    supers = checkpoint(_resolved(bases, classes, "base_name", "base").where("base is not null and base <> at").select("at", "base").distinct())
    if supers.isEmpty():
        return own
    methods = _resolved(parsed.where("kind = 'function' and owner is not null and file is not null"), classes, "owner", "at").where("at is not null")
    # One description per class and method: the least one, so repeated rows cannot multiply.
    sources = checkpoint(methods.where("description is not null").groupBy(F.col("at").alias("base"), "name").agg(F.min("description").alias("found")))
    waiting = methods.where("description is null").select("symbol_key", "symbol_id", "name", "signature", "code", "at")
    results, seen = own, waiting.select("symbol_key", "at")
    while True:
        step = checkpoint(waiting.join(supers, "at").drop("at").join(sources, ["base", "name"], "left"))
        if step.isEmpty():
            return results
        # Several bases: the first by name that has a description, for each function row.
        done = step.where("found is not null").groupBy("symbol_key").agg(F.min_by(F.struct("symbol_id", "signature", "code", F.col("found").alias("description")), F.struct("base", "symbol_id")).alias("r"))
        results = results.unionByName(done.select("symbol_key", "r.*", F.lit("inherited").alias("origin")))
        further = step.join(done.select("symbol_key"), "symbol_key", "left_anti").withColumnRenamed("base", "at").drop("found").distinct()
        waiting = checkpoint(further.join(seen, ["symbol_key", "at"], "left_anti"))
        seen = seen.unionByName(waiting.select("symbol_key", "at"))
