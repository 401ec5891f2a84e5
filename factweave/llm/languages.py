"""P8: the language of documents and of the segments of mixed documents, by compression.

Every language has a raw-content zstandard dictionary made of running text; a segment's language is the one whose dictionary
compresses it to the fewest bytes, and a segment is rejected where the margin to the runner-up is narrow. The dictionaries are
fitted on a bounded sample of labelled documents, whose sentences are first relabelled by the languages their words belong
to: wrong labels and mixed documents so lose their hold.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.leakage import fold, item_blocks
from factweave.session import checkpoint, own_columns, ship

# The languages and the names they are labelled with (codes, English and own names).
NAMES = {
    "en": "en eng english englisch anglais inglés", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais französisch", "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "ru": "ru rus russian русский", "ja": "ja jpn japanese jp 日本語", "zh": "zh zho chi chinese cn cmn mandarin 中文 汉语 漢語",
}
BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}

_FENCE = re.compile(r"(?ms)^[ \t>]*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t>]*\1[^\n]*$|\Z)")
_BREAKS = re.compile(r"\r\n?|\x0b|\x0c|\x85| | ")
_INLINE = re.compile(r"`+[^`\n]*`+")
_URL = re.compile(r"(?:https?|ftp|file)://\S+|www\.\S+|\S+@\S+\.\w+")
_TAG = re.compile(r"</?[A-Za-z!][^<>\n]*>")
_LEAD = re.compile(r"^[ \t]*(?:>[ \t]?)*(?:#{1,6}[ \t]+|[-*+•][ \t]+|\d+[.)][ \t]+|\|)?[ \t]*")
_QUOTES = re.compile(r"[\"“”„«»‹›「」『』]")
_QUOTE = re.compile(r"[\"“”„«»‹›「」『』][^\"“”„«»‹›「」『』\n]{0,60}[\"“”„«»‹›「」『』]")
_CODE = re.compile(r"[{};]\s*$|^\s*(?:def|class|func|import|from|return|const|let|var|if|for|while|async|await|export|interface|type|package|public|private|static)\b.*[=({:;\[]|:=|=>|\w\(\w*\)\s*[;{:]|^\s*[\[{].*[\]}],?\s*$|^\s*(?:GET|POST|PUT|DELETE|PATCH)\s+/|^[\w.-]+\s*=\s*\S+$")
#: What every form of _CODE has in it; most lines of prose have none of these.
_CODEY = re.compile(r"[{};=(\[:/]")
_SPLIT = re.compile(r"(?<=[.!?;:])\s+|(?<=[。！？；])")
_ACCENT = re.compile("[\u0300-\u036f]")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_NAMES = re.compile(r"[_\d(]|[a-z][A-Z]")
_NAME = re.compile(r"\b(?:\w*_\w+|[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*|\w+\(\)|\w*\d\w*)")


def normal(text: str) -> str:
    """The form of a text that is compressed: case, compatibility forms, digits and spacing carry no language."""
    if not text.isascii():
        # Accents are often lost on the way, so they are not relied on.
        text = unicodedata.normalize("NFC", _ACCENT.sub("", unicodedata.normalize("NFKD", text)))
    return " ".join(_WORD.findall(text.casefold()))


def sentences(text: str) -> list[str]:
    """The running sentences of a document; code, quoted terms, names, headings' marks and addresses are left out."""
    if _BREAKS.search(text):
        text = _BREAKS.sub("\n", text)
    text = _INLINE.sub(" ", _FENCE.sub("\n\n", text)) if "`" in text or "~~~" in text else text
    if "<" in text:
        text = _TAG.sub(" ", text)
    if ":" in text or "@" in text:
        text = _URL.sub(" ", text)
    out, part = [], []

    def close() -> None:
        if part:
            whole = "".join(a if a.endswith("-") or _HAN.match(a[-1:]) else a + " " for a in part)
            out.extend(_SPLIT.split(_QUOTE.sub(" ", whole) if _QUOTES.search(whole) else whole))
            part.clear()

    for line in text.split("\n"):
        marked = _LEAD.match(line)
        body = line[marked.end() :].strip()
        skip = not body or (_CODEY.search(body) is not None and _CODE.search(body) is not None)
        if skip or marked[0].strip():
            close()
        if skip:
            continue
        part.append(body)
        if marked[0].strip().startswith("#"):
            close()
    close()
    return out


def running(sentence: str) -> str | None:
    """The normal form of a sentence if it is one: at least four words or eight characters of a script without spaces."""
    plain = _NAME.sub(" ", sentence) if _NAMES.search(sentence) else sentence
    text = normal(plain)
    if not plain.isascii() and len(_HAN.findall(plain)) >= 8:
        return text
    words = text.count(" ") + 1
    return text if words >= 4 and len(text) - words + 1 >= 16 else None


def script(text: str) -> str:
    """The script that most of a normal text is in: L (Latin), C (Cyrillic) or H (Han and Kana)."""
    if text.isascii():
        return "L"
    half = (len(text) - text.count(" ")) / 2
    return "H" if len(_HAN.findall(text)) > half else "C" if len(_CYRILLIC.findall(text)) > half else "L"


class Compressor:
    """One raw-content dictionary a language. A text meets those in its own script: another script's cannot be the smallest."""

    def __init__(self, texts: dict[str, bytes], level: int = 3):
        import zstandard as zstd

        self.codes = sorted(texts)
        self.by = []
        for c in self.codes:
            d = zstd.ZstdCompressionDict(texts[c], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstd.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        by_script: dict[str, list[int]] = defaultdict(list)
        for i, c in enumerate(self.codes):
            by_script[script(texts[c].decode(errors="ignore"))].append(i)
        # A single dictionary has no runner-up of its own script: the margin then is to those of the others.
        self.of_script = {s: by_script[s] if len(by_script[s]) > 1 else range(len(self.codes)) for s in "LCH"}
        self.cache: dict[str, list[tuple[int, str]]] = {}

    def sizes(self, texts: list[str]) -> dict[str, list[tuple[int, str]]]:
        """Of every text the two smallest (compressed bytes, language), smallest first.

        All texts of a script meet one dictionary before the next: its tables then stay in the processor's cache.
        """
        fresh: dict[str, list[str]] = {"L": [], "C": [], "H": []}
        for x in dict.fromkeys(texts):
            if x not in self.cache:
                fresh[script(x)].append(x)
        if len(self.cache) > 200_000:
            self.cache = {x: self.cache[x] for x in set(texts) if x in self.cache}
        for key, xs in fresh.items():
            raws = [x.encode() for x in xs]
            which = list(self.of_script[key]) if xs else []
            got = np.array([[len(c) for c in map(self.by[i].compress, raws)] for i in which]) if xs else np.zeros((0, 0), int)
            if len(which) > 1:
                order = np.argsort(got, axis=0, kind="stable")[:2]
                self.cache.update((x, [(int(got[a, n]), self.codes[which[a]]), (int(got[b, n]), self.codes[which[b]])]) for n, (x, a, b) in enumerate(zip(xs, *order, strict=True)))
            elif which:
                self.cache.update((x, [(int(got[0, n]), self.codes[which[0]])]) for n, x in enumerate(xs))
        return {x: self.cache[x] for x in texts}


def decide(order: list[tuple[int, str]], margin: float) -> tuple[str | None, float]:
    """The language of a text and the confidence (the runner-up's excess over the best), None if narrow."""
    gap = (order[1][0] - order[0][0]) / order[1][0] if len(order) > 1 else 1.0
    return (order[0][1] if gap >= margin else None, gap)


def label_code(label):
    """The code of a language label column as delivered (code, name, either with a region), or null."""
    names = F.create_map(*(F.lit(x) for pair in BY_NAME.items() for x in pair))
    return F.try_element_at(names, F.regexp_replace(F.lower(F.trim(label)), r"[-_ (].*$", ""))


def fit(docs: DataFrame, text: str, label: str, per_language: int, size: int, rounds: int) -> dict[str, bytes]:
    """The dictionaries. At most about ``per_language`` labelled documents of each language, none over 8,000 characters, come to the driver."""
    known = own_columns(docs, text, label).select(F.col(text).alias("t"), label_code(F.col(label)).alias("c")).where("c is not null and length(t) between 40 and 8000")
    counts = {r[0]: r[1] for r in known.groupBy("c").count().collect()}
    share = F.lit(0.0)
    for c, n in counts.items():
        share = F.when(F.col("c") == c, min(1.0, per_language / n)).otherwise(share)
    # A row is in the sample by its text's hash, so the sample does not depend on how the table is partitioned.
    sample = known.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < share * 1_000_000).limit(2 * per_language * len(NAMES))
    return dictionaries([(c, [x for s in sentences(t) if (x := running(s))]) for t, c in sorted(map(tuple, sample.collect()))], size, rounds)


def dictionaries(labelled: list[tuple[str, list[str]]], size: int, rounds: int) -> dict[str, bytes]:
    """Language -> dictionary, from (label, normal sentences) of documents of which some are labelled wrong or mixed.

    A sentence that stands in a wrongly labelled document would match itself there, so labels are cleaned by the word before
    anything is compressed: a sentence goes to the language under whose label its words are likeliest. Each round
    counts again with the sentences' new labels.
    """
    now = [(c, xs) for c, xs in labelled if xs]
    often: dict[str, int] = defaultdict(int)
    for _, xs in now:
        for x in xs:
            often[x] += 1
    parts = {x: _units(x) for x in often}
    for _ in range(rounds):
        counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        total: dict[str, int] = defaultdict(int)
        for c, xs in now:
            for w in set().union(*(parts[x] for x in xs)):
                counts[w][c] += 1
            total[c] += 1
        codes = sorted(total, reverse=True)
        likely = {w: np.log([(by[c] + 0.02) / (total[c] + 1) for c in codes]) for w, by in counts.items()}
        now = [(codes[int(np.sum([likely[w] for w in parts[x]], axis=0).argmax())], [x]) for x in sorted({x for _, xs in now for x in xs})]
    texts: dict[str, list[str]] = defaultdict(list)
    for c, xs in now:
        texts[c] += xs
    return {c: _content(xs, size, often) for c, xs in texts.items()}


def _units(x: str) -> set[str]:
    """Words, and pairs of characters of scripts without spaces."""
    out = set()
    for w in x.split():
        out.update((w[i : i + 2] for i in range(len(w) - 1)) if _HAN.match(w) else (w,))
    return out


def _content(xs: list[str], size: int, often: dict[str, int]) -> bytes:
    """Distinct sentences up to ``size`` bytes: frequent ones first, else spread evenly; the most frequent stand last, next to the text."""
    out, n = [], 0
    for s in sorted(set(xs), key=lambda s: (-often[s], hash_of(s))):
        raw = s.encode() + b" "
        if n + len(raw) > size:
            break
        out.append(raw)
        n += len(raw)
    return b"".join(reversed(out))


def hash_of(s: str) -> int:
    """A stable hash (Python's own differs between processes)."""
    import zlib

    return zlib.crc32(s.encode())


_FOUR = b"\1\1\1\1"


class Judge:
    """Tells the languages of documents, a batch at a time. ``shingles`` are the hashes of four successive words of the excluded texts."""

    def __init__(self, texts: dict[str, bytes], margin: float, pooled_margin: float, shingles: frozenset, vocabulary: frozenset):
        self.z, self.margin, self.pooled_margin, self.shingles, self.vocabulary = Compressor(texts), margin, pooled_margin, shingles, vocabulary

    def _without(self, s: str, x: str, shingles: frozenset | set, vocabulary: frozenset | None) -> str | None:
        """The running text of a sentence that is left without the excluded words in it and three round them: an item need not be set off."""
        w = fold(s)
        # Four words of an excluded text in a row need four words of theirs in a row.
        if vocabulary is not None and _FOUR not in (flags := bytes(map(vocabulary.__contains__, w))):
            return x
        hits = [j for j in range(len(w) - 3) if (vocabulary is None or flags.startswith(_FOUR, j)) and hash_of(" ".join(w[j : j + 4])) in shingles]
        if not hits:
            return x
        gone = {k for j in hits for k in range(j - 3, j + 7)}
        return running(" ".join(a for k, a in enumerate(w) if k not in gone))

    def segments(self, texts: list[str], own: list[set] | None = None) -> list[list[tuple[int, str, str | None, float]]]:
        """(segment number, segment, language or None, confidence) of each running sentence of each text.

        ``own`` gives, if the excluded texts are too many to be held, the hashes of theirs that stand in each text. Where every sentence
        of a text is rejected, its running text as a whole is judged, by ``pooled_margin``: a long text needs less of a margin.
        """
        all_: list[list[tuple[int, str, str]]] = []
        for n, t in enumerate(texts):
            found = [(i, s, x) for i, s in enumerate(sentences(t)) if (x := running(s)) is not None]
            if own is not None:
                if own[n]:
                    found = [(i, s, y) for i, s, x in found if (y := self._without(s, x, own[n], None)) is not None]
            elif self.shingles:
                found = [(i, s, y) for i, s, x in found if (y := self._without(s, x, self.shingles, self.vocabulary)) is not None]
            all_.append(found)
        sizes = self.z.sizes([x for found in all_ for _, _, x in found])
        out = [[(i, s, *decide(sizes[x], self.margin)) for i, s, x in found] for found in all_]
        narrow = [n for n, rows in enumerate(out) if len(rows) > 1 and not any(c for _, _, c, _ in rows)]
        pooled = {n: " ".join(x for _, _, x in all_[n]) for n in narrow}
        sizes = self.z.sizes(list(pooled.values()))
        for n, x in pooled.items():
            code, gap = decide(sizes[x], self.pooled_margin)
            out[n] = [(i, s, code, gap) for i, s, _, _ in out[n]]
        return out


SEGMENTS = "segment_no int, segment string, segment_lang string, confidence double"


def languages_of(found: list[tuple[int, str, str | None, float]]) -> dict[str, tuple[float, int]]:
    """Language -> (confidence, characters) of a document's segments: the mean confidence by length."""
    by: dict[str, list[tuple[float, int]]] = defaultdict(list)
    for _, s, c, gap in found:
        if c:
            by[c].append((gap, len(s)))
    return {c: (sum(g * n for g, n in xs) / sum(n for _, n in xs), sum(n for _, n in xs)) for c, xs in by.items()}


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", exclude: DataFrame | None = None, exclude_key: str = "item_id", exclude_text: str = "item_text", per_language: int = 400, size: int = 96 << 10, rounds: int = 3, margin: float = 0.22, pooled_margin: float = 0.1, held_items: int = 200_000) -> DataFrame:
    """key, label (as a code or null), lang_code, confidence, n_chars, n_langs: one row per document row and language it is written in.

    Documents without a running sentence (null, empty, blank, numbers, code) have no row. ``exclude`` are texts that are no
    language of their own, such as evaluation items: four successive words of one, and what stands next to them, are left out. Up to
    ``held_items`` of them are sent to the executors; more are joined with the documents by their words, with the same result. Sampled for
    fitting: about ``per_language`` labelled documents a language; all documents are judged, over their whole text. Repeated rows count
    each; extra columns are ignored; an empty table, or one without any known label, gives no rows.
    """
    types = f"{key} {docs.schema[key].dataType.simpleString()}, label string, lang_code string, confidence double, n_chars long, n_langs int"

    def rows(k: object, given: str | None, found: list) -> list[tuple]:
        langs = languages_of(found)
        return [(k, given, code, conf, n, len(langs)) for code, (conf, n) in langs.items()]

    return _judged(docs, key, text, label, exclude, exclude_key, exclude_text, per_language, size, rounds, margin, pooled_margin, held_items, types, rows)


def identify_segments(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", exclude: DataFrame | None = None, exclude_key: str = "item_id", exclude_text: str = "item_text", per_language: int = 400, size: int = 96 << 10, rounds: int = 3, margin: float = 0.22, pooled_margin: float = 0.1, held_items: int = 200_000) -> DataFrame:
    """key, segment_no, segment, segment_lang (null where rejected), confidence: one row per running sentence; else as identify."""
    types = f"{key} {docs.schema[key].dataType.simpleString()}, {SEGMENTS}"
    return _judged(docs, key, text, label, exclude, exclude_key, exclude_text, per_language, size, rounds, margin, pooled_margin, held_items, types, lambda k, given, found: [(k, *s) for s in found])


def _judged(docs: DataFrame, key: str, text: str, label: str, exclude: DataFrame | None, exclude_key: str, exclude_text: str, per_language: int, size: int, rounds: int, margin: float, pooled_margin: float, held_items: int, types: str, rows: Callable) -> DataFrame:
    docs = own_columns(docs, key, text, label)
    spark = ship(docs.sparkSession)
    dictionaries_ = fit(docs, text, label, per_language, size, rounds)
    if not dictionaries_:
        return spark.createDataFrame([], types)
    cols = [c.split()[0] for c in types.split(", ")]
    work = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), F.col(text).alias("t"), label_code(F.col(label)).alias("given"))
    shingles, vocabulary, joined = frozenset(), frozenset(), False
    if exclude is not None:
        items = own_columns(exclude, exclude_key, exclude_text)
        joined = items.count() > held_items
        if joined:
            work = _with_hits(work, items.select(F.col(exclude_text).alias("t")))
        else:
            parts = [w for part in item_blocks(items, exclude_key, exclude_text, 20_000) for _, w in part]
            shingles = frozenset(h for w in parts for h in hashes_of(w))
            vocabulary = frozenset(a for w in parts for a in w)
    shared = spark.sparkContext.broadcast((dictionaries_, margin, pooled_margin, shingles, vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(*shared.value)
        for b in batches:
            found = judge.segments(b["t"].tolist(), [set(h) for h in b["hits"]] if joined else None)
            yield pd.DataFrame([r for k, given, f in zip(b["k"], b["given"], found, strict=True) for r in rows(k, given, f)], columns=cols)

    return work.mapInPandas(run, types)


def hashes_of(words: list[str] | tuple[str, ...]) -> list[int]:
    """The hashes of four successive words."""
    return [hash_of(" ".join(words[j : j + 4])) for j in range(len(words) - 3)]


def _with_hits(work: DataFrame, items: DataFrame) -> DataFrame:
    """work with hits: the hashes of four successive words of any item that stand in a row's sentences, by a join of hashes."""
    work = checkpoint(work.withColumn("row", F.monotonically_increasing_id()))

    def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r, h) for r, t in b.itertuples(index=False, name=None) for h in {h for s in sentences(t) for h in hashes_of(fold(s))}], columns=["row", "h"])

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": [h for t in b["t"] for h in set(hashes_of(fold(t)))]}, dtype="int64")

    known = items.where("t is not null").mapInPandas(of_items, "h long").distinct()
    hits = work.select("row", "t").mapInPandas(of_docs, "row long, h long").join(known, "h", "left_semi").groupBy("row").agg(F.collect_list("h").alias("hits"))
    return work.join(hits, "row", "left").select("k", "t", "given", F.coalesce("hits", F.array().cast("array<bigint>")).alias("hits"))
