"""Scalar functions on identifiers, paths and names, as Column expressions (no Python runs per row)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.schema import SOURCE_EXTENSIONS

# Words in the names of interface-like symbols.
INTERFACE_WORDS = ("interface", "handler", "service", "repository", "controller", "provider", "client", "adapter", "factory", "strategy", "observer", "listener", "plugin", "middleware", "builder", "parser", "validator")
# Name parts that deserve attention: anywhere in the lower-case name, and by exact case at its ends.
ATTENTION_ANYWHERE = ("main", "init", "start", "handler", "setup", "teardown", "bootstrap", "cleanup", "auth", "login", "logout", "password", "credential", "token", "session", "sanitize", "authorize", "validate", "verify", "check", "error", "retry", "fallback", "recovery", "recover")
ATTENTION_PREFIX = ("Test", "Create", "Delete", "Update", "Get", "List", "Put")
ATTENTION_SUFFIX = ("_test", "Test", "_bench", "Benchmark")
# Callables and packages of the languages' standard libraries.
STDLIB = {
    "go": ("panic append len cap make new copy close delete recover real imag complex", "fmt log os strings strconv time sync math errors reflect io context bytes bufio flag net http json path filepath sort container crypto encoding html image index mime runtime testing text unicode"),
    "python": ("print len str int float bool list dict set tuple range open type isinstance enumerate zip map filter sum min max abs any all sorted reversed dir help vars getattr setattr hasattr", ""),
    "js": (
        "window document navigator location history localStorage sessionStorage fetch XMLHttpRequest Promise Object Array String Number Boolean RegExp Error Map Set WeakMap WeakSet process require module exports __dirname __filename setTimeout setInterval clearTimeout clearInterval parseInt parseFloat encodeURIComponent decodeURIComponent",
        "console Math JSON Reflect Proxy Intl",
    ),
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_name(x: Column | str) -> Column:
    """What follows the last slash."""
    return F.substring_index(_c(x), "/", -1)


def dir_name(x: Column | str) -> Column:
    """What precedes the last slash, or the empty text."""
    return F.regexp_extract(_c(x), r"^(.*)/[^/]*$", 1)


def symbol_file(x: Column | str) -> Column:
    """The file of a symbol id: what precedes the first colon."""
    return F.substring_index(_c(x), ":", 1)


def symbol_part(x: Column | str) -> Column:
    """What follows the first colon, or the whole text without one."""
    return F.when(F.instr(_c(x), ":") > 0, F.regexp_extract(_c(x), r"^[^:]*:(?s)(.*)$", 1)).otherwise(_c(x))


def short_name(x: Column | str) -> Column:
    """The symbol's last name: after the first colon, then after the last dot unless the dot ends the text."""
    part = symbol_part(x)
    return F.when(part.rlike(r"\.[^.]+$"), F.substring_index(part, ".", -1)).otherwise(part)


def last_colon_name(x: Column | str) -> Column:
    return F.substring_index(_c(x), ":", -1)


def plain_name(x: Column | str) -> Column:
    """The short name without a trailing argument list."""
    return F.regexp_replace(short_name(x), r"\([^()]*\)$", "")


def guess_kind(name: Column | str) -> Column:
    """func for constructor-like names and names with an argument list, struct for other capitalised names, else symbol."""
    n = _c(name)
    return F.when(n.rlike("^(New|Create|Get|Load)") | (F.instr(n, "(") > 1), "func").when(n.rlike("^[A-Z]"), "struct").otherwise("symbol")


def infer_kind(symbol: Column | str) -> Column:
    low = F.lower(_c(symbol))
    return F.when(low.rlike("[.:](main|init)$"), "entry").when(low.rlike(":(test|benchmark)[^:]*$"), "test").otherwise("symbol")


def is_interface_like(symbol: Column | str) -> Column:
    return F.lower(_c(symbol)).rlike("|".join(INTERFACE_WORDS))


def is_attention_worthy(name: Column | str) -> Column:
    n = _c(name)
    low = F.lower(n)
    return low.rlike("|".join(ATTENTION_ANYWHERE)) | low.rlike("^on_|callback$") | n.rlike(f"^({'|'.join(ATTENTION_PREFIX)})|({'|'.join(ATTENTION_SUFFIX)})$")


def is_source_path(x: Column | str) -> Column:
    return _c(x).rlike("(" + "|".join(e.replace(".", r"\.") for e in SOURCE_EXTENSIONS) + ")$")


def quote_path(x: Column | str) -> Column:
    return F.concat(F.lit('"'), _c(x), F.lit('"'))


def link_key(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws("->", _c(a), _c(b))


def triple_link_key(a: Column | str, p: Column | str, b: Column | str) -> Column:
    return F.concat_ws("-", _c(a), _c(p), _c(b))


def language_of(x: Column | str) -> Column:
    """The language by the first of these extensions that the id contains."""
    c = _c(x)
    return F.when(c.contains(".go"), "go").when(c.contains(".ts"), "typescript").when(c.contains(".js"), "javascript").when(c.contains(".py"), "python").otherwise("")


def package_of(path: Column | str) -> Column:
    """The directory with dots for slashes; root for files without one."""
    d = dir_name(path)
    return F.when(d == "", "root").otherwise(F.translate(d, "/", "."))


def tags_of(path: Column | str) -> Column:
    """Architectural tags of a path, each once, in the order of the rules."""
    low = F.lower(_c(path))
    rules = [
        (low.rlike(r"\.(go|py)$"), "backend"), (low.rlike(r"\.(ts|tsx|js|jsx)$"), "frontend"), *((low.contains(f"{d}/"), d) for d in ("cmd", "pkg", "internal")),
        *((low.contains(w), w) for w in ("service", "component", "hook", "util", "context", "test")), (low.rlike(r"\.(tsx|jsx)$"), "ui"), (low.endswith(".py"), "python"),
    ]
    return F.array_compact(F.array(*(F.when(cond, tag) for cond, tag in rules)))


def is_stdlib_call(callee: Column | str, language: Column | str) -> Column:
    c, lang = _c(callee), _c(language)
    found = F.lit(False)
    for name, (calls, packages) in STDLIB.items():
        hit = c.isin(*calls.split())
        if packages:
            hit = hit | (F.instr(c, ".") > 0) & F.substring_index(c, ".", 1).isin(*packages.split())
        found = found | (lang == name) & hit
    return found


def clean_route(x: Column | str) -> Column:
    """A reference without its query string."""
    return F.substring_index(_c(x), "?", 1)


def number_of(x: Column | str) -> Column:
    """The number a text holds, or null; blanks and type suffixes make it text."""
    c = _c(x)
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


def embed_text(name: Column | str, doc: Column | str, content: Column | str) -> Column:
    """What an embedding model is given: name, documentation and the first 500 bytes of the content."""
    head = F.decode(F.substring(F.encode(_c(content), "UTF-8"), 1, 500), "UTF-8")
    return F.concat_ws("\n---\n", *(F.when(F.length(x) > 0, x) for x in (_c(name), _c(doc), head)))


def potential_symbols(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\b([A-Za-z][A-Za-z0-9_./]{3,})\b"), 1))


def tokens_of(x: Column | str) -> Column:
    """Search tokens of a lower-case text: runs of letters or digits; those of up to two characters only if last or the text is short."""
    c = F.lower(_c(x))
    parts = F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    ends = c.rlike(r"[\p{L}\p{N}]$")
    kept = F.filter(parts, lambda t, i: (F.length(t) > 2) | (F.octet_length(c) < 10) | (ends & (i == F.size(parts) - 1)))
    return F.array_distinct(kept)


def _closeness(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def fuzzy_score(query: str, candidate: Column | str) -> Column:
    """1 if equal, 0.95 if contained, else the larger of the whole and the mean best token closeness."""
    q, c = F.lit(query.lower()), F.lower(_c(candidate))
    qt, ct = tokens_of(F.lit(query)), tokens_of(candidate)
    best = F.transform(qt, lambda t: F.coalesce(F.array_max(F.transform(ct, lambda u: F.when(t == u, 1.0).when(u.contains(t), 0.95).otherwise(_closeness(t, u)))), F.lit(0.0)))
    mean = F.when(F.size(qt) > 0, F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(qt)).otherwise(0.0)
    return F.when(c == q, 1.0).when(c.contains(q), 0.95).otherwise(F.greatest(_closeness(q, c), mean))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two numeric arrays; 0 where either has no length, null where their sizes differ."""
    x, y = _c(a), _c(b)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(F.size(x) != F.size(y), None).when(norm == 0, 0.0).otherwise(dot(x, y) / norm)


def topic_id(name: str) -> int:
    """The 24-bit partition of a project: FNV-1a folded to 24 bits, never zero."""
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h & 0xFFFFFF | 1


def global_topic(name: str) -> int:
    return topic_id(name) & ~0x800000


def window_topic(name: str) -> int:
    return topic_id(name) | 0x800000


def is_global(topic: Column | str) -> Column:
    return _c(topic).bitwiseAND(0x800000) == 0


def cache_key(query: str) -> str:
    """The first eight bytes of the SHA-256 of a query, in hexadecimal."""
    return hashlib.sha256(query.encode()).hexdigest()[:16]
