"""P4: credentials embedded in source code and configuration.

Lines with any cue of a credential are lexed; the tokens of their literal zones (string literals in code and in comments, configuration
values, element texts, values in comments, headers, issued tokens wherever they stand, user information of addresses, what follows an
authorization scheme) are labelled by a linear-chain CRF. Its features are shape (which kinds of characters, how long, how often the kind
changes, how many distinct, words or not, marks of a reference) and context (words of the name, the call, the literal before, the place). The
Viterbi spans are the characters to redact; interpolated expressions inside a literal are no part of them. Tokens outside literal zones,
and lines without a cue, are outside the model's support: their label is O by construction. The field is trained from generated lines
(``training_lines``), so no text of the corpus is needed to fit it.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.crf import train, viterbi
from factweave.session import own_columns, ship

# Words in the names of secrets and of things that only look like them.
SECRET_WORDS = frozenset("password passwd passwort pwd pass pw passphrase passcode secret secrets token tokens apikey credential credentials cred creds kennwort contrasena contraseña senha motdepasse wachtwoord parola пароль 密码 パスワード auth authorization bearer jwt pat pem".split())
KEY_WORDS = frozenset("api access private signing sign hmac deploy tls ssl ssh encryption encrypt secret auth master client app session webhook account service shared crypto rsa aes license".split())
OTHER_WORDS = frozenset("id uuid guid hash digest sum checksum etag revision rev commit sha sha1 sha256 md5 version public pub icon image img logo avatar msg message text title description label hint error err length len min max count limit ttl expiry expires expired timeout size name user username login field column path file dir host port type kind scheme trace span request correlation integrity nonce color fingerprint ref".split())
# How issuers begin their tokens.
ISSUED = r"(?:sk|pk|rk)_(?:live|test)_|gh[pousr]_|github_pat_|xox[abeoprs]-|AIza|AKIA|ASIA|glpat-|npm_|pypi-|dop_v1_|hf_|SG\.|ya29\.|shp(?:at|ca|pa|ss)_|eyJ[\w-]{8,}\.eyJ"
_CUE_WORD = r"pass|phrase|pwd|pw\b|pw[\"'_=: ]|secret|token|key|auth|cred|kennwort|contrase|senha|wachtwoord|parola|пароль|密码|パスワード|login|dial|connect|open|client|session|vault|bearer|basic"
#: What makes a line worth lexing: an issued token or key, user information, or a cue word with anything of five characters after it that a zone may hold.
CUE = re.compile(
    rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY|(?<![A-Za-z0-9])(?:{ISSUED})|://[^\s:/@\"'`]*:[^\s\"'`]+@|(?:-u|--user)[ =][\"']?[^\s:\"']+:[^\s\"']{{3}}|(?i:{_CUE_WORD})(?:[^\n]*?[\"'`][^\"'`\n]{{5}}|[\w.-]*\s*[:=> ]\s*[^\s\"'`]{{5}})"
)
_CONFIG = re.compile(r"(?:\.(?:ya?ml|json|ini|toml|cfg|conf|config|properties|env|tf|tfvars|xml)|(?:^|/)\.env[\w.]*|(?:^|/)(?:Dockerfile|credentials|netrc|\.npmrc|\.pypirc))$", re.I)
_COMMENT = re.compile(r"^\s*(?://+|#+|/\*+|\*+|--|;+|<!--|\"\"\"|''')\s*")
_TOKEN = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----|\w+|\s+|[^\w\s]")
_USERINFO = re.compile(r"[a-zA-Z][\w+.-]*://([^\s:/@\"'`]*):([^\s\"'`]+)@(?=[\w.\[$-])|(?:-u|--user)[ =][\"']?([^\s:\"']+):([^\s\"']+)")
_SCHEME = re.compile(r"^(?:(?:proxy-)?authorization\s*[:=]\s*)?(?:Bearer|Basic|Token|ApiKey|Digest|AWS4-HMAC-SHA256)\s+(?=\S)", re.I)
_CONF_LINE = re.compile(r"^\s*(?:export\s+|set\s+|-\s+)?([\w.\- ]*[\w])\s*(?:[:=]|:=)\s*(?![\"'`|>]|$)(\S.*?)\s*[,;]?\s*$")
_COMMENT_VALUE = re.compile(r"([\w.\-]+(?:[ ][\w.\-]+){0,3})\s*[:=]\s*(?![A-Za-z_][\w.\-]{1,40}=\S)([^\s\"'`]{5,})")
_COMMENT_SCHEME = re.compile(r"(?:\b(?:Bearer|Basic)|authorization\s*[:=]\s*(?:Token|ApiKey|Digest|AWS4-HMAC-SHA256))\s+([^\s\"'`,;]{8,})", re.I)
#: A header in one literal, the text of an element, and what a build file, a net rc file or an option of a command sets.
_HEADER = re.compile(r"([A-Za-z][\w-]*(?:-[\w-]+|[Tt]oken|[Kk]ey|[Ss]ecret))\s*:\s+(?=\S+$)")
_ELEMENT = re.compile(r"<([A-Za-z][\w.:-]*)(?:\s[^<>]*)?>([^<>\s][^<>]*)</")
_SETTING = re.compile(r"(?:^\s*(?:ENV|ARG)\s+(\w+)\s+|(?<=\s)--?([A-Za-z][\w-]*)[ =]|\b(password|passwd|account)\s+)(?![\"'`$=:-])([^\s\"'`]{5,})")
_SHELL = re.compile(r"^\s*(?:ENV|ARG|RUN|CMD|machine|login|default|curl|wget|docker|psql|mysql|\$)\b|\s--[a-z]")
_SCHEME_WORD = re.compile(r"^(?:Bearer|Basic|Token|ApiKey|Digest|AWS4-HMAC-SHA256)$", re.I)
_TRAILING = re.compile(r"(?<!:)//|(?<=\s)(?:#|--(?=\s)|/\*|<!--|;(?=\s))")
_BARE_ISSUED = re.compile(rf"(?<![A-Za-z0-9])(?:{ISSUED})[\w.+/=-]{{7,}}[\w+/=-]")
_DEFINE = re.compile(r"#\s*define\s+(\w+)\s+$")
_KEY = re.compile(r"([\w\-.\]\[\"'$@]+?)\s*(?::\s*[\w<>\[\]|.]+\s*(?==[^>=]))?(?:\]|\))?\s*(?::=|=>|[=!]==?|[:=])\s*(?:[\w.\[\]]*[({]\s*)?[rbuf$@]{0,2}$")
#: A word right before a literal names it, too (SQL: PASSWORD '...').
_BESIDE = re.compile(r"(?<![\w.])([A-Za-z_]\w{3,})\s+$")
_CALL = re.compile(r"([\w.]+)\s*\([^()]*$")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_]+")
_PLACEHOLDER = re.compile(r"change[_\- ]?me|your|replace|example|todo|placeholder|dummy|insert|redacted|fixme|sample|not[_\- ]?set|tbd|\bhere\b|enter|fake|foobar|^(?:password|passwd|secret|token|none|null|nil|undefined|true|false|test|default|empty|string|str|int|bool|required|optional)$", re.I)
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|^<[^<>]*>$|^%\w+%$|^\$[A-Za-z_]\w*$|^\{[\w.]*\}$|^%[sdvqr]$|(?:^|[^\w])(?:file|vault|env|ref|secret|op|ssm|awssm|gcpsm|arn|keyring|aws|gcp|azure|kms)(?::|://)|/run/secrets|process\.env|os\.environ|getenv|!Ref|!Sub", re.I)
_ISSUED_VALUE = re.compile(rf"^(?:{ISSUED})(?!x{{4}}|X{{4}}|\*)[\w.+/=-]{{8,}}$")
_SUMMED = re.compile(r"^(?:sha\d+|md5|etag|w/)[:-]", re.I)
_ADDRESS = re.compile(r"^[a-zA-Z][\w+.-]*://|^[\w-]+(?:\.[\w-]+)*:\d+$|^[\w-]+(?:\.[\w-]+)+\.[a-z]{2,10}(?:[/:]|$)")
_PATH = re.compile(r"^\.{0,2}/(?:[a-z][a-z0-9_.-]*/?)+$|^(?:[a-z][\w.-]*/)+[\w.-]+$")
_GROUPS = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_PIECE = re.compile(r"[A-Za-zÀ-ɏ]+")
_VOWEL = re.compile(r"[aeiouyAEIOUYÀ-ɏ]")


def _bin(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


@functools.lru_cache(maxsize=100_000)
def attributes(value: str) -> tuple[str, ...]:
    """What a literal looks like. The first is its shape as a whole, the others are properties that do not exclude each other."""
    if not value:
        return ("empty",)
    n = len(value)
    kinds = ["9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "_" if c.isspace() else "!" for c in value]
    have = set(kinds)
    changes = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    size = _bin(n, 5, 8, 12, 16, 20, 24, 32, 40, 64)
    letters = "".join(k for k in "aA9!_" if k in have)
    pieces = _PIECE.findall(value)
    # A word is of one case, or capitalised, and has vowels; random letters seldom are all of that.
    words = sum(bool(len(w) >= 2 and _VOWEL.search(w) and (w.islower() or w.isupper() or w.istitle())) for w in pieces)
    wordy = 0 if not pieces else 1 if words < len(pieces) else 2 if len(pieces) == 1 else 3
    spread, rate = _bin(len(set(value)) / n, 0.2, 0.5, 0.8), _bin(changes / n, 0.05, 0.2, 0.4)
    shape = f"{letters}{size}.{wordy}.{rate}"
    out = [shape, f"kinds={letters}", f"kinds,size={letters},{size}", f"kinds,words={letters},{wordy}", f"size={size}", f"words={wordy}.{min(len(pieces), 4)}", f"rate={rate}", f"distinct={_bin(len(set(value)), 2, 3, 6, 10)}.{spread}"]
    plain = value.strip()
    for name, found in (
        ("reference", _REFERENCE.search(plain)), ("placeholder", _PLACEHOLDER.search(plain)), ("address", _ADDRESS.search(plain)), ("path", _PATH.search(plain)), ("summed", _SUMMED.search(plain)), ("groups", _GROUPS.search(plain)), ("issued", _ISSUED_VALUE.search(plain)), ("private", plain.startswith("-----BEGIN") and "PRIVATE KEY" in plain),
        ("public", plain.startswith(("-----", "ssh-")) and "PRIVATE KEY" not in plain), ("data", plain.startswith("data:")), ("hex", n >= 12 and "9" in have and not set(plain) - set("0123456789abcdefABCDEF")), ("number", not have & set("aA")), ("sentence", plain.count(" ") >= 2), ("mask", len(set(plain.lower()) - set("*x.•#_-")) == 0), ("identifier", re.fullmatch(r"[A-Za-z_][A-Za-z_.:\-]*", plain)),
    ):
        if found:
            out.append(name)
    return tuple(out)


def key_class(key: str | None) -> str:
    """secret, other or none: what the name of a value says of it."""
    if not key:
        return "none"
    words = [w.lower() for part in re.split(r"[\W_]+", key) for w in _CAMEL.findall(part)]
    tail = set(words)
    plain = "".join(words)
    secret = bool(tail & SECRET_WORDS) or ("key" in tail and bool(tail & KEY_WORDS)) or plain in ("passphrase", "passphrases", "apikey", "keypem", "privatekey") or {"pass", "phrase"} <= tail or {"key", "pem"} <= tail or "mot_de_passe" in key.lower()
    other = bool(words) and (words[-1] in OTHER_WORDS or bool(tail & {"public", "pub", "hash", "digest", "checksum", "length", "min", "max", "expired"}))
    return "other" if other else "secret" if secret else "none"


def zones(line: str, config: bool) -> list[tuple[int, int, str, str | None, str | None, str | None, bool, int]]:
    """The literal zones of a line: (start, end, kind, key, call, literal before, is itself a key, argument number)."""
    out: list = []
    special = []
    for m in _USERINFO.finditer(line):
        a, b = m.span(2) if m[2] is not None else m.span(4)
        special.append((a, b, "userinfo", None, None, m[1] or m[3], False, 0))
    comment = _COMMENT.match(line)
    if line.lstrip().startswith(('"""', "'''")):
        comment = None
    literals = []
    # Where the text of a comment begins, of a whole line or behind code.
    i, n, remark = 0, len(line), comment.end() if comment else None
    while i < n:
        q = line[i]
        if q in "\"'`":
            if remark is not None and q == "'" and i and line[i - 1].isalnum() and not re.search(r"(?<!\w)[rbufRBUF]{1,2}$", line[max(0, i - 3) : i]):
                i += 1  # an apostrophe
                continue
            start = i
            if line.startswith(q * 3, i):
                i += 2
            j = i + 1
            while j < n and line[j] != q:
                j += 2 if line[j] == "\\" and q != "`" else 1
            j = min(j, n)
            if remark is not None and j == n:
                i = start + 1  # a quotation mark in running text
                continue
            literals.append((i + 1, j))
            i = j
        elif remark is None and (m := _TRAILING.match(line, i)):
            remark = m.end()
            i = remark
            continue
        i += 1
    before = None
    for a, b in literals:
        head, rest = line[: a - 1], line[b + 1 :].lstrip() if b < len(line) else ""
        joined = bool(out) and bool(re.fullmatch(r"\s*(?:\+|\.\.?|&|\\)?\s*[rbuf]{0,2}", line[out[-1][1] + 1 : a - 1])) and out[-1][2] in ("string", "joined", "scheme")
        is_key = rest[:1] == ":" and not rest.startswith("://") or rest[:2] == "=>" or (rest[:1] == "]" and "=" in rest[1:4])
        key = _KEY.search(head)
        call = _CALL.search(head)
        name = key[1] if key else m[1] if (m := _DEFINE.search(head)) else None
        args = line[call.start() : a].count(",") if call else 0
        if name is None and out and not joined and out[-1][3] and re.fullmatch(r"\s*,\s*[rbuf]{0,2}", line[out[-1][1] + 1 : a - 1]) and call is None:
            name = out[-1][3]
        elif name is None and call is None and (m := _BESIDE.search(head)):
            name = m[1]
        if joined:
            z = (a, b, "joined", out[-1][3], out[-1][4], out[-1][5], False, out[-1][7])
        else:
            z = (a, b, "string", name, call[1] if call else None, before, is_key, args)
        scheme = _SCHEME.match(line[a:b])
        header = None if scheme else _HEADER.match(line[a:b])
        if header and not joined:
            z = (a + header.end(), b, "header", header[1], *z[4:])
        if scheme and len(line[a + scheme.end() : b].split()) == 1:
            z = (a + scheme.end(), b, "scheme", *z[3:])
        out.append(z)
        before = line[a:b]
    taken = [(a, b) for a, b in literals]

    def add(a: int, b: int, kind: str, key: str | None) -> None:
        if not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind, key, None, None, False, 0))

    for m in _ELEMENT.finditer(line):
        add(*m.span(2), "element", m[1])
    if not comment:
        for m in _SETTING.finditer(line) if config or _SHELL.search(line) else ():
            add(*m.span(4), "value", m[1] or m[2] or m[3])
    pem = re.search(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*", line)
    if pem:
        add(pem.start(), len(line.rstrip()), "value", None)
    elif config and not comment and not any(remark is None or a < remark for a, _ in literals):
        mark = re.search(r"\s#", line)
        if m := _CONF_LINE.match(line[: mark.start()] if mark else line):
            add(*m.span(2), "value", m[1])
    if remark is not None:
        for m in _COMMENT_SCHEME.finditer(line, remark):
            add(*m.span(1), "scheme", None)
        for m in _COMMENT_VALUE.finditer(line, remark):
            if not _SCHEME_WORD.match(m[2]):
                add(*m.span(2), "comment", m[1])
    for m in _BARE_ISSUED.finditer(line):
        # Outside configuration, names of variables may begin like tokens: a token has a long run with a digit.
        if config or any(len(w) >= 12 and re.search(r"\d", w) for w in re.findall(r"[A-Za-z0-9]+", m[0])):
            add(*m.span(), "value" if config or remark is None or m.start() < remark else "comment", None)
    if special:
        out = [z for z in out if not any(z[0] < s[1] and s[0] < z[1] for s in special)] + special
    return sorted(out)


_CRYPT = re.compile(r"hmac|cipher|crypt|^sign$|signer|signwith")
_CONNECT = re.compile(r"dial|connect|login|auth|conn\b|open|client|signin|session")
_FETCH = re.compile(r"getenv|get|lookup|read|load|fetch|find|env|log|print|error|debug|info|warn|field|column|param")
_SETTER = re.compile(r"^(?:set|add|header|setheader|setrequestheader|append|put)$")
_HEADER_NAME = re.compile(r"(?i)(?:proxy-)?authorization|x-[\w-]*(?:key|token|secret|auth)[\w-]*|api-key|cookie")
_USER = re.compile(r"^(?:svc|user|admin|root|bot|app|usr)|user|admin|_(?:reader|writer)$")


def _action(call: str | None) -> str:
    verb = call.rsplit(".", 1)[-1].lower() if call else ""
    if _CRYPT.search(verb) or (call and call.lower().startswith("hmac")):
        return "crypt"
    return "connect" if _CONNECT.search(verb) else "fetch" if _FETCH.search(verb) else "header" if _SETTER.search(verb) else "call" if verb else "none"


def zone_features(zone: tuple, value: str) -> list[str]:
    """The features that all tokens of a zone share: its shape, its context, and both together."""
    _, _, kind, key, call, before, is_key, args = zone
    name, action = key_class(key), _action(call)
    called = key_class(call.rsplit(".", 1)[-1] if call else None)
    prior = "named" if before and re.fullmatch(r"[\w.-]+", before) and key_class(before) == "secret" else "header" if before and _HEADER_NAME.fullmatch(before) else "user" if before and _USER.search(before) else "some" if before else "none"
    last = (_CAMEL.findall(key) or [""])[-1].lower() if key else ""
    look = attributes(value)
    out = [f"kind={kind}", f"name={name}", f"act={action}", f"prior={prior}", f"word={last}", f"arg={min(args, 3)},{action}", f"kind,name={kind},{name}", f"act,prior={action},{prior}", f"key={is_key}", f"called={called}", *look]
    for a in look:
        out += [f"name|{name}|{a}", f"kind,name|{kind},{name}|{a}", f"act,prior|{action},{prior}|{a}", f"called,prior|{called},{prior}|{a}", f"key|{is_key}|{a}"]
    return out


def whole_values(line: str, zs: list) -> list[str]:
    """The value each zone is part of: the literals of a value that is put together are judged by all of it."""
    whole: list[str] = []
    for a, b, kind, *_ in zs:
        if kind == "joined" and whole:
            value = whole[-1] + line[a:b].strip()
            first = max(i for i in range(len(whole)) if zs[i][2] != "joined")
            whole[first:] = [value] * (len(whole) - first)
            whole.append(value)
        else:
            whole.append(line[a:b].strip())
    return whole


def features(line: str, zs: list) -> tuple[list[tuple[int, int]], list[list[str]], list[int]]:
    """Token spans of the zones, their own features, and the zone of each (-1: a gap between zones, which ends a span)."""
    spans, feats, of = [], [], []
    for k, (a, b, *_) in enumerate(zs):
        if k:
            spans.append((a, a))
            feats.append(["gap"])
            of.append(-1)
        for i, m in enumerate(_TOKEN.finditer(line[a:b])):
            t = m[0]
            part = "space" if t.isspace() else "mark" if not t[0].isalnum() and t[0] != "_" else "num" if t.isdigit() else "low" if t.islower() else "cap" if t.isupper() else "mix"
            first = "first" if i == 0 else "later"
            spans.append((a + m.start(), a + m.end()))
            feats.append([first, f"{first},{part}", f"{first},size={_bin(len(t), 2, 4, 8, 16)}"])
            of.append(k)
    return spans, feats, of


_INTERPOLATED = re.compile(r"[$#]\{[^{}\n]*\}|\{\{[^{}\n]*\}\}|\{[A-Za-z_][\w.\[\]()\"' ]*(?:![rsa])?(?::[^{}\n]*)?\}")


def find_in_line(model: dict, line: str, config: bool) -> list[tuple[int, int]]:
    """(start, end) of every credential in a line; parts of a value put together count as one and are all in its span."""
    return [(parts[0][0], parts[-1][1]) for parts in spans_in_line(model, line, config)]


def spans_in_line(model: dict, line: str, config: bool) -> list[list[tuple[int, int]]]:
    """The parts of every credential in a line: what stands between interpolated expressions."""
    zs = zones(line, config)
    if not zs:
        return []
    spans, feats, of = features(line, zs)
    shared = [_weights(model, tuple(zone_features(z, v))) for z, v in zip(zs, whole_values(line, zs), strict=True)]
    labels = viterbi(model, feats, [shared[k][0 if f[0] == "first" else 1] if k >= 0 else None for k, f in zip(of, feats, strict=True)])
    # A value that is put together is a credential as a whole: any part of it that is found stands for all up to there.
    heads: dict[int, int] = {}
    for k, z in enumerate(zs):
        heads[k] = heads[k - 1] if z[2] == "joined" and k else z[0]
    joined = {k for k, z in enumerate(zs) if z[2] == "joined"}
    out: list[list[int]] = []
    inside = False
    for (a, b), y, k in zip(spans, labels, of, strict=True):
        if y == 0 or a == b:
            inside = False
            continue
        if inside or (k in joined and out and out[-1][0] >= heads[k]):
            out[-1][1] = b
        else:
            out.append([heads[k] if k in joined else a, b])
        inside = True
    return [ps for a, b in out if (ps := _between(line, a, b, zs))]


def _between(line: str, a: int, b: int, zs: list) -> list[tuple[int, int]]:
    """a to b without the interpolated expressions of a literal that has any: $, #, or an f before the quote."""
    text = line[a:b]
    if "{" not in text:
        return [(a, b)]
    start = max((z[0] for z in zs if z[0] <= a), default=a)
    formatted = line[start - 1 : start] == "`" or re.search(r"(?i)(?<!\w)(?:f|rf|fr|\$)[\"']{1,3}$", line[max(0, start - 6) : start]) is not None
    parts, at = [], a
    for m in _INTERPOLATED.finditer(text):
        if m[0][0] in "$#" or m[0].startswith("{{") or formatted:
            if a + m.start() > at:
                parts.append((at, a + m.start()))
            at = a + m.end()
    if at < b:
        parts.append((at, b))
    # Marks that only join an expression to the rest are no secret.
    while parts and not re.search(r"\w", line[parts[0][0] : parts[0][1]]):
        parts.pop(0)
    if parts and parts[0][0] != a:
        lead = re.match(r"[-_.:/ ]*", line[parts[0][0] : parts[0][1]]).end()
        parts[0] = (parts[0][0] + lead, parts[0][1])
    return parts


# What any match of CUE has in it, in lower case. They find the lines worth a closer look at the speed of one scan.
_ANCHORS = "-----begin |sk_|pk_|rk_|ghp_|gho_|ghu_|ghs_|ghr_|github_pat_|xox|aiza|akia|asia|glpat-|npm_|pypi-|dop_v1_|hf_|sg.|ya29.|shp|eyj|://|-u|--user|pass|phrase|pwd|pw|secret|token|key|auth|cred|kennwort|contrase|senha|wachtwoord|parola|пароль|密码|パスワード|login|dial|connect|open|client|session|vault|bearer|basic".split("|")


@functools.lru_cache(maxsize=1)
def _cues():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for w in _ANCHORS:
        auto.add_word(w, 0)
    auto.make_automaton()
    return auto


def _lower(text: str) -> str:
    """Lower case without a change of length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY-----")
_PEM_BODY = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[\s\\nr\"'+>|*#/;-]*[A-Z][A-Za-z0-9-]*: [^\n\\\"'`]*)*[\s\\nr\"'+>|*#/;-]*(?:[A-Za-z0-9+/=]{16,})")


def find_in_text(model: dict, text: str, config: bool) -> list[tuple[int, int]]:
    """(start, end) of every credential in a text, from 0, in order."""
    return [(parts[0][0], parts[-1][1]) for parts in spans_in_text(model, text, config)]


def spans_in_text(model: dict, text: str, config: bool) -> list[list[tuple[int, int]]]:
    """The parts of every credential in a text, from 0, in order."""
    out, at = [], 0
    for place, _ in _cues().iter(text.lower() if text.isascii() else _lower(text)):
        if place < at:
            continue
        lo = text.rfind("\n", 0, place) + 1
        hi = text.find("\n", place)
        hi = len(text) if hi < 0 else hi
        if not CUE.search(text, lo, hi):
            at = hi
            continue
        line = text[lo:hi]
        # A value that is put together goes on where the line ends in an operator.
        while hi < len(text) and re.search(r"[\"'`]\s*(?:\+|\\|\.\.)\s*$", line):
            hi = text.find("\n", hi + 1)
            hi = len(text) if hi < 0 else hi
            line = text[lo:hi].replace("\n", " ")
        at = hi
        for parts in spans_in_line(model, line, config):
            parts = [(a + lo, b + lo) for a, b in parts]
            a, b = parts[0][0], parts[-1][1]
            if text.startswith("-----BEGIN", a):
                if not _PEM_BODY.match(text, a):
                    continue
                end = _PEM_END.search(text, a)
                b = max(b, end.end()) if end else b
                at = max(at, b) if end else at
                parts = [(a, b)]
            out.append(parts)
        if at >= len(text):
            break
    return out


@functools.lru_cache(maxsize=50_000)
def _sums(key: int, names: tuple[str, ...]) -> tuple[list[float], list[float]]:
    emit = _models[key]["emit"]
    out = []
    for place in ("first", "later"):
        rows = [w for x in names if (w := emit.get(f"{place}|{x}")) is not None]
        out.append([sum(c) for c in zip(*rows, strict=True)] if rows else [0.0, 0.0, 0.0])
    return out[0], out[1]


_models: dict[int, dict] = {}


def _weights(model: dict, names: tuple[str, ...]) -> tuple[list[float], list[float]]:
    """The summed weights of a zone's features for its first and its later tokens."""
    if _models.get(id(model)) is not model:
        _models[id(model)] = model
    return _sums(id(model), names)


# --- Training lines -------------------------------------------------------------------------------------------------

_KEYS = ["password", "passwd", "pwd", "pass", "pass phrase", "passphrase", "secret", "client secret", "session secret", "webhook secret", "api key", "api token", "access token", "auth token", "refresh token", "private token", "token", "signing key", "hmac key", "encryption key", "access key", "credential", "cred", "kennwort", "db pass", "smtp password", "admin pw", "root password", "bot token", "senha", "contrasena", "wachtwoord", "mot de passe", "jwt secret", "master key", "vault token"]
_NEUTRAL = ["value", "val", "k", "v", "raw", "x1", "tmp", "data ref", "upstream", "gate value", "conf", "arg", "setting", "mode", "entry", "id ref", "name", "kind", "region", "build"]
_OTHER = ["request id", "trace id", "etag", "digest", "want hash", "revision", "commit", "checksum", "icon", "pub", "public key", "msg", "message", "max tokens", "password min length", "token name", "key id", "version", "user", "host", "password field", "secret path", "token url", "login page"]
_HEX, _LOW, _UP, _DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOW + _UP + _DIGITS


def _random(r: random.Random, chars: str, n: int) -> str:
    return "".join(r.choices(chars, k=n))


def _word(r: random.Random) -> str:
    """A made-up word that can be said: consonants and vowels in turn."""
    return "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + r.choice(["", "", "n", "r", "l", "s"]) for _ in range(r.randrange(1, 4)))


def _case(name: str, r: random.Random) -> str:
    ws = name.split()
    return r.choice(["_".join(ws), "_".join(ws).upper(), "-".join(ws), ws[0] + "".join(w.title() for w in ws[1:]), "".join(w.title() for w in ws)])


def _value(r: random.Random) -> str:
    """A secret of any kind: random characters of some alphabet, or words that somebody made harder to guess."""
    kind = r.randrange(10)
    if kind == 0:
        return _random(r, _HEX, r.choice([24, 32, 40, 48, 64]))
    if kind == 1:
        return "-".join(_random(r, _HEX, n) for n in (8, 4, 4, 4, 12))
    if kind == 2:
        return _random(r, _ALNUM + "+/", r.randrange(16, 64)) + r.choice(["", "=", "=="])
    if kind == 3:
        return _random(r, _ALNUM + "-_", r.randrange(10, 44))
    if kind == 4:
        return r.choice("-_.!+=*#~").join([_word(r).title(), _word(r)]) + str(r.randrange(1, 9999))
    if kind == 5:
        # A word with digits for letters, a capital somewhere, and marks.
        w = "".join({"o": "0", "e": "3", "i": "1", "a": "4", "s": "5"}.get(c, c) if r.random() < 0.4 else c for c in _word(r) + _word(r))
        at = r.randrange(len(w))
        return w[:at] + w[at:].title() + str(r.randrange(10, 99)) + r.choice(["", "!", "?", "%", "$$"])
    if kind == 6:
        return r.choice("  .-_").join([*(_word(r) for _ in range(r.randrange(2, 5))), str(r.randrange(1, 999))])
    if kind == 7:
        return _random(r, _ALNUM + "!*-+=_.?@%", r.randrange(8, 20))
    if kind == 8:
        return _word(r).title() + r.choice("!@#$%&*") + _random(r, _DIGITS, r.randrange(2, 6)) + r.choice(["", _word(r)])
    return _random(r, _ALNUM, r.randrange(12, 32))


def _issued(r: random.Random) -> str:
    return r.choice([lambda: "sk_live_" + _random(r, _ALNUM, 24), lambda: r.choice(["ghp_", "gho_", "ghs_"]) + _random(r, _ALNUM, 36), lambda: f"xoxb-{r.randrange(10**11, 10**12)}-{_random(r, _ALNUM, 24)}", lambda: "AIza" + _random(r, _ALNUM + "_-", 35), lambda: "AKIA" + _random(r, _UP + _DIGITS, 16), lambda: "glpat-" + _random(r, _ALNUM, 20), lambda: f"eyJ{_random(r, _ALNUM, 20)}.eyJ{_random(r, _ALNUM, 40)}.{_random(r, _ALNUM + '_-', 40)}"])()


def _harmless(r: random.Random) -> str:
    """What stands under a secret's name and is none: placeholders, references, masks, plain words."""
    w = lambda: _word(r)
    return r.choice([lambda: "changeme", lambda: "YOUR_API_KEY", lambda: "<your-token-here>", lambda: "********", lambda: "xxxxxxxxxxxx", lambda: "REPLACE_ME", lambda: "example-secret", lambda: "todo", lambda: r.choice("xX*.#") * r.randrange(5, 33), lambda: "${" + w().upper() + "}", lambda: "{{ vault." + w() + " }}", lambda: "file:/run/secrets/" + w(), lambda: "", lambda: "$" + w().upper(), lambda: "vault:secret/" + w(), lambda: "null", lambda: w(), lambda: w() + "_" + w(), lambda: f"{w()}.{w()}", lambda: w().upper() + "_TOKEN", lambda: str(r.randrange(99999)), lambda: "/var/lib/" + w(), lambda: "strict", lambda: "string", lambda: "env:" + w().upper(), lambda: "%s", lambda: "arn:aws:secretsmanager:" + w(), lambda: "<" + w() + ">"])()


def _visible(r: random.Random) -> str:
    """What stands under a name that is no secret's: identifiers, digests, addresses, texts."""
    w = lambda: _word(r)
    return r.choice([lambda: _random(r, _HEX, r.choice([32, 40, 64])), lambda: "-".join(_random(r, _HEX, n) for n in (8, 4, 4, 4, 12)), lambda: "sha256:" + _random(r, _HEX, 64), lambda: "data:image/png;base64," + _random(r, _ALNUM + "+/", 60), lambda: r"-----BEGIN PUBLIC KEY-----\n" + _random(r, _ALNUM, 60) + r"\n-----END PUBLIC KEY-----", lambda: f"the {w()} must have at least {r.randrange(9, 20)} {w()}", lambda: f"{w()} expired, sign in again", lambda: f"no {w()} key given", lambda: str(r.randrange(9999)), lambda: w(), lambda: f"{w()}.{w()}.{r.choice(_TLDS)}:{r.randrange(9999)}", lambda: f"https://{w()}.{r.choice(_TLDS)}/{w()}", lambda: _random(r, _ALNUM + "+/", 40), lambda: w().title() + str(r.randrange(9)), lambda: w() + "_" + w(), lambda: f"{w()} ready", lambda: f"{w()}{r.randrange(9)} {w()}", lambda: f"{w()}/{w()}.txt"])()


def _message(r: random.Random, key: str) -> str:
    """A line of a log, perhaps about a thing with a secret's name, perhaps with a place to fill in."""
    head = r.choice([key, _word(r), key + _word(r).title(), f"{key}{r.randrange(9)}", f"{_word(r)}{r.randrange(9)}", f"{_word(r)}{r.randrange(99)}"])
    return " ".join([head, *(_word(r) for _ in range(r.randrange(1, 5)))]) + r.choice(["", "", ": %s", " %s", " %d", " {}", "..."])


_TLDS = ["com", "org", "net", "io", "local", "internal", "example", "test", "invalid"]


def training_lines(n: int, seed: int) -> Iterator[tuple[str, bool, list[tuple[int, int]]]]:
    """(line, whether of a configuration file, spans of its credentials). Marks « and » stand round a credential until removed."""
    r = random.Random(seed)
    pem = lambda: f"-----BEGIN {r.choice(['', 'RSA ', 'EC ', 'OPENSSH '])}PRIVATE KEY-----" + r.choice(["", "", r"\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + _random(r, _DIGITS + "ABCDEF", 32) + r"\n"]) + r.choice([r"\n" + _random(r, _ALNUM + "+/", 64) + r"\n-----END PRIVATE KEY-----", ""])
    for _ in range(n):
        w, host = _word(r), f"{_word(r)}.{r.choice(_TLDS)}"
        name = r.choice([_word(r), f"{_word(r)}_{r.choice(['reader', 'writer', 'admin', 'app', 'bot'])}", r.choice(["svc_", "app-", "user_"]) + _word(r), r.choice(["root", "admin", "postgres"])])
        secret, given = _value(r), r.random()
        v = f"«{secret}»" if given < 0.4 else f"«{_issued(r)}»" if given < 0.48 else f"«{pem()}»" if given < 0.54 else _harmless(r)
        key = _case(r.choice(_KEYS), r)
        if given >= 0.85:
            key, v = _case(r.choice(_OTHER + _NEUTRAL), r), _visible(r)
        elif given >= 0.76:
            key, v = _case(r.choice(_NEUTRAL), r), f"«{pem() if r.random() < 0.25 else _issued(r)}»"
        elif given >= 0.7:
            key, v = _case(r.choice(_NEUTRAL + _OTHER), r), _value(r)
        q = r.choice("\"'") if "'" not in v else '"'
        plain = v.strip("«»") and " " not in v
        scheme = r.choice(["postgres", "postgresql+psycopg2", "redis", "amqp", "https", "bolt", "mysql", "mongodb+srv", "ftp"])
        url = lambda x: f"{scheme}://{name}:{x}@{host}{r.choice(['', ':5672'])}/{_word(r)}"
        user = f"«{secret}»" if " " not in secret and not re.search(r"[@/#?%]", secret) else "${DB_PASS}"
        token = f"«{r.choice([_issued(r), _random(r, _ALNUM + '-_', r.randrange(20, 40)), _random(r, _HEX, 40)])}»"
        pad = " ".join(_word(r) for _ in range(r.randrange(12, 30)))
        cut = r.randrange(4, max(5, len(secret) - 3))
        quiet = '"' not in secret
        forms = [
            (f"const {key} = {q}{v}{q};", False), (f"{key} := {q}{v}{q}", False), (f"\t{key} = {q}{v}{q}", False), (f'  "{key}": "{v}",', True), (f"{key}: {q}{v}{q}", True), (f"auth := map[string]string{{\"user\": \"{name}\", \"{key}\": \"{v}\"}}", False),
            (f'opts.update({{"{key}": "{v}"}})', False), (f"conn = connect({q}{host}:7687{q}, user={q}{name}{q}, {key}={q}{v}{q})", False), (f"export {key}={q}{v}{q}", True), (f"let {key}: string = {q}{v}{q};", False), (f"{key} = {q}{v}{q}", True), (f"self.{key} = {key} or {q}{v}{q}", False),
            (f"{q}{w}{q}, {q}{key}{q}", False), (f"{key} := os.Getenv(\"{key.upper()}\")", False), (f"const {w} = [{q}token{q}, {q}{w}{q}];", False), (f'Token string `json:"token"`', False), (f"const msg = {q}{_visible(r)}{q};", False), (f"x = config.get({q}{key}{q}, {q}{_harmless(r)}{q})", False),
            (f"dsn := {q}{url(user)}{q}", False), (f"url: {url(user)}", True), (f"URL={q}{url('${DB_PASS}')}{q}", True), (f"// curl -u {name}:{user} https://{host}/{w}", False),
            (f'req.Header.Set("Authorization", "Bearer {token}")', False), (f"headers = {{{q}Authorization{q}: {q}Bearer {token}{q}}}", False), (f"headers[{q}X-Api-Key{q}] = {q}{token}{q};", False), (f'h.Add("authorization", "Basic {token}")', False), (f'basic = "Basic {token}"', False), (f"curl -H {q}X-{w.title()}-Token: {token}{q} https://{host}", False), (f"curl -H {q}X-Request-Id: {_random(r, _HEX, 32)}{q} https://{host}/token", False),
            (f'conn, _ := dial("{host}", "{name}", "«{secret}»")' if quiet else "", False), (f"await login({q}{name}{q}, {q}«{secret}»{q});" if q not in secret else "", False), (f'db.open("{name}", "«{secret}»")' if quiet else "", False), (f'{r.choice(["ssh.connect", "mysql_connect", "amqp.dial", "Session.open", "client.connect"])}("{host}", {r.choice(["", "22, ", "5432, "])}"{name}", "«{secret}»")' if quiet else "", False), (f"session.login(user={q}{name}{q}, {q}«{secret}»{q})" if q not in secret else "", False), (f"log.error({q}{w} failed{q}, {q}{_visible(r)}{q})", False),
            (f"s.log.{r.choice(['Debug', 'Info', 'Warn'])}({q}{_message(r, key)}{q}, {q}{r.choice([key, w])}{q}, {r.randrange(999)})", False), (f"{r.choice(['log', 'logger', 'logging'])}.{r.choice(['debug', 'info', 'warning', 'error'])}({q}{_message(r, key)}{q}, {w})", False), (f"raise {w.title()}Error({q}{_message(r, key)}{q} % {w})", False), (f"console.{r.choice(['debug', 'log', 'error'])}({q}{_message(r, key)}{q}, {w});", False),
            (f'{r.choice(["os.putenv", "define", "settings.set", "cfg.SetDefault", "env.put", "os.Setenv"])}("{key}", "{v}")' if '"' not in v else "", False), (f'{w} = {r.choice(["os.environ.get", "getenv", "config.get"])}("{key}", "{v}")' if '"' not in v else "", False), (f"if {key} == {q}{v}{q}:", False), (f"{key} = ({q}{name}{q}, {q}{v}{q})" if given < 0.85 else "", False),
            (f"{r.choice(['CREATE', 'ALTER'])} USER {name} {r.choice(['WITH PASSWORD', 'PASSWORD', 'SET PASSWORD'])} '{v}';" if "'" not in v and given < 0.7 else "", False), (f"{r.choice(['hmac.new', 'createHmac', 'jwt.sign', 'Cipher.encrypt', 'signer.sign'])}({r.choice([w, q + 'sha256' + q])}, {q}{v}{q})" if given < 0.7 else "", False), (f"createHash({q}{r.choice(['md5', 'sha1', 'sha256'])}{q})", False), (f"{r.choice(['BasicAuth', 'addSecret', 'UserPassword', 'withCredentials'])}({q}{name}{q}, {q}{v}{q})" if given < 0.7 else "", False),
            (f"f = open({q}{w}/{_word(r)}.{r.choice(['txt', 'json', 'py'])}{q}, {q}{r.choice(['rb', 'w', 'utf-8'])}{q})", False), (f"client.publish({q}{w}.{_word(r)}{q}, {q}{_visible(r)}{q})", False), (f"session.get({q}https://{host}/{w}{q})", False), (f"client = new {w.title()}Client({q}{host}{q});", False),
            (f"// the {key} comes from the vault, see docs/{key}_rotation.md", False), (f"# todo({w}s): describe the {key}: later", False),
            (f"// const {key} = {q}{v}{q};", False), (f"# {key}: {q}{v}{q}", r.random() < 0.5), (f'#define {key.upper()} "{v}"', False), (f'*cfg.{key} = "{v}"', False), (f'{w} := 1 // {key} = "{v}"', False), (f'-- {key} = "{v}"', False), (f"// we don't log {q}{_visible(r)}{q} as {key}", False),
            (f"{r.choice(['//', '#', ' *', ';'])} use {r.choice(['', 'the key '])}«{_issued(r)}» on {w}", False), (f"{w}.run()  {r.choice(['//', '#'])} was «{_issued(r)}»", False), (f"{w} «{_issued(r)}» {w}", False),
            (f"{r.choice(['//', '#', ' *'])} {r.choice(['Authorization: ', 'authorization=', ''])}{r.choice(['Bearer', 'Basic'])} {token}", False), (f"{r.choice(['//', '#'])} Authorization: {r.choice(['Bearer', 'Basic', 'Token'])} {r.choice(['<your-token-here>', '${' + w.upper() + '}', '$API_TOKEN', 'xxxxxxxxxxxx', 'YOUR_API_KEY', '{{token}}', 'authentication'])}", False), (f"{r.choice(['//', '#'])} {r.choice(['bearer', 'basic', 'Bearer', 'Basic'])} {r.choice(['authentication', 'credentials', 'authorization', 'functions', w + '_' + w])} for the {w}: {w}", False),
            (f'curl -H "Authorization: Bearer {token}" https://{host}', False), (f"// curl -H {q}Authorization: Bearer {token}{q} https://{host}", False),
            (f'<add name="{w}" {key}="{v}" />' if '"' not in v else "", True), (f"{key} = load(  # {pad}\n" .strip() + f" {q}{v}{q})", False), (f"{w}({q}{pad}{q}, {key}={q}{v}{q})", False),
        ]
        if plain:
            forms += [(f"{key}: {v}", True), (f"{key}={v}", True), (f"{key} = {v}", True), (f"export {key}={v}", True), (f"# old: {key}={v}", r.random() < 0.5), (f"// staging {key}: {v}", False), (f"// fallback {key.replace('_', ' ')}: {v}", False), (f"{w} := 1 // {key}: {v}", False), (f"{w} = 1  # {key} = {v}", False), (f"{key}: {v}  # rotate the {w}", True)]
            if not re.search(r"[<>&\"'`$]", v):
                forms += [(f"<{key}>{v}</{key}>", True), (f"ENV {key.upper()} {v}", True), (f"ARG {key.upper()}={v}", True), (f"$ {w} --{key.replace('_', '-').lower()} {v} {host}", True), (f"machine {host} login {name} password {v}" if given < 0.48 else "", True)]
        if given < 0.4 and " " not in secret and not re.search(r"[-+/=]", secret[max(0, cut - 1) : cut + 1]):
            forms += [(f'{key} := "«{secret[:cut]}" + "{secret[cut:]}»"', False), (f"{key} = '«{secret[:cut]}' + '{secret[cut:]}»'", False)]
        line, config = r.choice(forms)
        if r.random() < 0.04:
            line, config = f"{r.choice(['s.log.Debug', 'log.info', 'console.debug', 'logger.warning', 'print', 'fmt.Printf'])}({q}{_message(r, key)}{q}{r.choice(['', f', {w}', f', {q}{key}{q}, {w}', f', {q}{w}2{q}, {r.randrange(999)}'])})", False
        if given >= 0.98:
            line, config = r.choice(["", "  ", "    "]) + f"«-----BEGIN {r.choice(['', 'RSA ', 'EC ', 'OPENSSH ', 'DSA ', 'ENCRYPTED '])}PRIVATE KEY-----»", r.random() < 0.8
        spans, out = [], ""
        for part in re.split("([«»])", line):
            if part == "«":
                spans.append(len(out))
            elif part == "»":
                spans[-1] = (spans[-1], len(out))
            else:
                out += part
        if line:
            yield out, config, spans


@functools.lru_cache(maxsize=2)
def fitted(lines: int = 8000, seed: int = 11) -> dict:
    """The trained field."""
    data = []
    for line, config, gold in training_lines(lines, seed):
        zs = zones(line, config)
        if not zs:
            continue
        spans, own, of = features(line, zs)
        both = [zone_features(z, v) for z, v in zip(zs, whole_values(line, zs), strict=True)]
        shared = [() if k < 0 else tuple(f"{f[0]}|{x}" for x in both[k]) for f, k in zip(own, of, strict=True)]
        starts = {a for a, _, kind, *_ in zs if kind == "joined"}
        ys, open_ = [], False
        for a, b in spans:
            hit = a < b and any(x <= a and b <= y for x, y in gold)
            ys.append(0 if not hit else 2 if open_ and a not in starts else 1)
            open_ = hit
        data.append((own, shared, ys))
    model = train(data, 3, l2=3e-4)
    # Structural zeros: a span begins with the first token of a zone and goes on only after a token of its own.
    for name, label in (("later", 1), ("gap", 1), ("gap", 2)):
        model["emit"][name][label] = -50.0
    model["move"][0][2] = model["start"][2] = -50.0
    return model


def find_credentials(rows: DataFrame, key: str, text: str, path: str, model: dict | None = None) -> DataFrame:
    """key, start_at, end_at (characters from 1, both inclusive): one row per credential in the text of each row.

    ``path`` tells configuration from code. Null and empty texts have none; a null path is code. Repeated rows count each;
    whole texts are read; extra columns are ignored; an empty table gives no rows.
    """
    rows = own_columns(rows, key, text, path).where(F.col(text).isNotNull())
    shared = ship(rows.sparkSession).sparkContext.broadcast(model or fitted())
    types = f"{key} {rows.schema[key].dataType.simpleString()}, start_at int, end_at int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = [(k, a + 1, e) for k, t, p in b.itertuples(index=False, name=None) for a, e in find_in_text(m, t, bool(p and _CONFIG.search(p)))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in types.split(", ")])

    return rows.mapInPandas(run, types)


def redact(rows: DataFrame, key: str, text: str, path: str, mask: str = "REDACTED", model: dict | None = None) -> DataFrame:
    """key, redacted, n_found: every row's text with its credentials replaced by the mask; all else, quotes included, stays."""
    rows = own_columns(rows, key, text, path)
    shared = ship(rows.sparkSession).sparkContext.broadcast(model or fitted())
    types = f"{key} {rows.schema[key].dataType.simpleString()}, redacted string, n_found int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = []
            for k, t, p in b.itertuples(index=False, name=None):
                found = spans_in_text(m, t, bool(p and _CONFIG.search(p))) if t else []
                for parts in reversed(found):
                    for n, (a, e) in reversed(list(enumerate(parts))):
                        # The parts of a value that is put together are masked one by one, so the operators between them stay.
                        piece = re.sub(r"([\"'`])(\s*(?:\+|\.\.?|&|\\)\s*)([\"'`])[^\"'`]*", r"\1\2\3", t[a:e]) if re.search(r"[\"'`]\s*(?:\+|\.\.?|&|\\)\s*[\"'`]", t[a:e]) else ""
                        put = mask if n == 0 else ""
                        t = t[:a] + (put + re.search(r"[\"'`].*", piece, re.S)[0] if piece else put) + t[e:]
                out.append((k, t, len(found)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in types.split(", ")])

    return rows.mapInPandas(run, types)
