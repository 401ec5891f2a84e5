"""Questions in plain words: intent, query and answer, by a small grammar and templates alone (no model is called).

A question is a row of words. Some words say what is asked (a verb of calling, a word of place, a subject such as speed), some are
names of code, the rest is grammar. The intent follows from which kinds of words there are and on which side of the verb the names
stand: a name before "calls" is the caller, one after it is the callee, two names with a word of direction are the ends of a path.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from factweave.plans.datalog import balanced

# The intents and the confidence each is reported with; chat is what matches nothing else.
CONFIDENCE = {"who_calls": 0.9, "what_calls": 0.85, "how_reaches": 0.8, "summarize": 0.75, "explain": 0.7, "find": 0.75, "security_audit": 0.9, "refactor": 0.85, "test_generation": 0.85, "performance": 0.85, "chat": 0.5}

#: Word stems of each kind. A word is of the first kind of which it starts with a stem (after =: is the stem).
_KINDS = (
    ("calls", "=call =calls =called =calling invok =use =uses =using =used depend"), ("callers", "caller"), ("callees", "callee"),
    ("way", "path route reach connect lead chain"), ("from", "=from =between"), ("to", "=to =and =into =with"),
    ("security_audit", "secur vulnerab attack exploit inject unsafe leak credential password secret permission privilege authent authoris authoriz sanitis sanitiz encrypt"),
    ("test_generation", "=test =tests testing unittest untested"), ("refactor", "refactor restructur simplif tidy clean debt duplicat rewrite"), ("performance", "perform slow fast speed latency bottleneck optimi efficien throughput"),
    ("summarize", "summar overview outline describ recap"), ("find", "=where find locat search defin contain declar"), ("explain", "explain understand work mean tell about walk"),
    ("asks", "=who =what =which =how =why =when"),
    ("grammar", "=is =are =was =the =a =an =of =in =on =at =for =by =do =does =did =can =could =would =should =i =me =we =you =it =its =this =that =these =those =there =all =any =some =more =please =show =list =give =get =file =files =function =functions =method =methods =symbol =symbols =class =classes =code =module =package =through =or =not =any =hello =hi =thanks =write =generate =make =add =unit =problems =issues"),
)
_WORDS = re.compile(r"[`\"']([^`\"']+)[`\"']|([\w./:-]*\w)")


@dataclass(frozen=True)
class Intent:
    name: str
    confidence: float
    targets: tuple[str, ...] = ()


def _kind(word: str) -> str:
    """The kind of a word; words that look like code or are of no kind are names."""
    if re.search(r"[._/:\d]|[a-z][A-Z]", word):
        return "name"
    low = word.lower()
    for kind, stems in _KINDS:
        for s in stems.split():
            if low == s[1:] if s[0] == "=" else low.startswith(s):
                return kind
    return "name"


def classify(question: str) -> Intent:
    """The intent of a question, its confidence, and the names it is about in the question's own case."""
    # A lone capital letter within a question is a name, too.
    found = [(m[1] or m[2], "name" if m[1] or (m.start() and m[2] != "I" and re.fullmatch("[A-Z]", m[2])) else _kind(m[2])) for m in _WORDS.finditer(question)]
    kinds = [k for _, k in found]
    names = tuple(w for w, k in found if k == "name")
    have = set(kinds)

    def result(name: str, targets: tuple[str, ...] = names) -> Intent:
        return Intent(name, CONFIDENCE[name], targets)

    for topic in ("security_audit", "test_generation", "refactor", "performance"):
        # A name after a verb of calling is asked about itself, whatever it is called.
        if topic in have and not ({"calls", "callers", "callees"} & have and names):
            return result(topic)
    if len(names) >= 2 and ("way" in have or "calls" in have and "how" in question.lower().split()) or {"way", "from", "to"} <= have:
        return result("how_reaches", names[:2])
    if "callers" in have:
        return result("who_calls", names[:1])
    if "callees" in have:
        return result("what_calls", names[:1])
    if "calls" in have and (names or "asks" in have):
        at = kinds.index("calls")
        before = tuple(w for w, k in found[:at] if k == "name")
        return result("what_calls", before[-1:]) if before else result("who_calls", names[:1])
    for topic in ("summarize", "find", "explain"):
        if topic in have and (names or topic != "explain"):
            return result(topic, names[:1])
    return Intent("chat", CONFIDENCE["chat"])


def is_question(text: str) -> bool:
    """Plain words rather than a query: no parenthesis and more than one word."""
    return "(" not in text and " " in text.strip()


def to_query(intent: Intent, symbols: list[str]) -> list[str]:
    """The queries of an intent, one for each symbol that the name may mean (their answers are united)."""
    quoted = [json.dumps(s, ensure_ascii=False) for s in symbols or list(intent.targets)]
    if intent.name == "who_calls":
        return [f'triples(?caller, "calls", {s})' for s in quoted] or ['triples(?caller, "calls", ?callee)']
    if intent.name == "what_calls":
        return [f'triples({s}, "calls", ?callee)' for s in quoted] or ['triples(?caller, "calls", ?callee)']
    if intent.name == "how_reaches":
        ends = [*quoted, '""', '""']
        return ['{"tool": "find_path", "source": %s, "target": %s}' % (ends[0], ends[1])]
    if intent.name == "summarize":
        return [f'triples({s}, "defines", ?sym), triples(?sym, "has_doc", ?doc)' for s in quoted] or ['triples(?f, "defines", ?sym), triples(?sym, "has_doc", ?doc)']
    if intent.name == "explain":
        return [f"triples({s}, ?pred, ?obj)" for s in quoted] or ["triples(?s, ?p, ?o)"]
    if intent.name == "find":
        return [f'triples(?s, "defines", ?sym), regex(?sym, {json.dumps(re.escape(t), ensure_ascii=False)})' for t in intent.targets[:1]] or ['triples(?s, "defines", ?sym)']
    if intent.name == "security_audit":
        return ['triples(?s, "references", ?ref), regex(?ref, "password|token|secret|key")']
    if intent.name == "refactor":
        return ['triples(?f, "defines", ?sym), triples(?sym, "has_doc", ?doc)']
    return ['triples(?f, "defines", ?sym)'] if intent.name in ("test_generation", "performance") else ["triples(?s, ?p, ?o)"]


def tool_call(text: str) -> dict | None:
    """A path request: {"tool": "find_path" or "find_connection", "source", "target"}."""
    try:
        call = json.loads(text) if text.strip().startswith("{") and balanced(text) else None
    except ValueError:
        return None
    return call if isinstance(call, dict) and call.get("tool") in ("find_path", "find_connection") else None


def listing(names: list[str], most: int = 7) -> str:
    """The first names, and how many more there are."""
    lines = [f"- {n}" for n in names[:most]]
    return "\n".join([*lines, f"... and {len(names) - most} more"] if len(names) > most else lines)


def answer(intent: Intent, rows: list[dict], total: int) -> str:
    """An answer in words to the (bounded) rows of a query."""
    about = " and ".join(intent.targets) or "that"
    values = list(dict.fromkeys(str(v) for r in rows for v in r.values() if v is not None))
    if not rows:
        return f"Nothing was found about {about}."
    heads = {"who_calls": f"{total} callers of {about}:", "what_calls": f"{about} calls {total} symbols:", "how_reaches": f"A path for {about}:", "find": f"{about} was found in {total} places:", "summarize": f"{about} in {total} parts:", "explain": f"What is known of {about}:"}
    return heads.get(intent.name, f"{total} results:") + "\n" + listing(values)
