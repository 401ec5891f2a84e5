"""P6: encoding of a corpus with a public byte-level BPE tokenizer, exact for texts of any length.

Every text is cut into overlapping chunks of ``chunk`` characters that are pre-tokenised each on its own; adjacent chunks are
stitched at a boundary both found in their overlap (a pre-token that starts at a place depends only on the text from there on, so
from a common boundary on both agree). The pieces between stitches are encoded on their own and put together in order; chunks
without a common boundary form one piece. A text of one chunk is one piece. Where the chunks of a text are worked on is a matter of its
length alone: those of a text up to ``spread`` characters in the task that has the row, those of a longer one in many tasks.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.session import checkpoint, default_tasks, own_columns, ship


def tokenizer_dir() -> str:
    """Where the public vocabularies lie, unless a caller says otherwise."""
    try:
        import public_tokenizers

        return os.path.dirname(public_tokenizers.__file__)
    except ImportError:
        return "/opt/tokenizers"


# Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoding(name: str, folder: str):
    """The tiktoken encoding of a .tiktoken file; one per Python worker."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


def encode_texts(texts: list[str | None], name: str, folder: str) -> list[list[int]]:
    """The ids of each text, strings of special tokens being ordinary text; null and empty give the empty list."""
    return encoding(name, folder).encode_ordinary_batch([t or "" for t in texts], num_threads=1)


def decode_ids(ids: list[int], name: str, folder: str) -> str:
    """The text of a list of ids: their raw bytes put together."""
    enc = encoding(name, folder)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")


def boundaries(text: str, start: int, lo: int, hi: int, last: bool) -> list[int]:
    """Pre-token starts of ``text`` between lo and hi, as places in the whole text (``start`` is that of text[0]).

    Only those count that cannot depend on what follows the chunk (they lie four characters before its end) and that follow
    a character that is no white space, so that the parts on both sides pre-tokenise alone as they do together.
    """
    end = len(text) + start if last else len(text) + start - 4
    return [p for m in _splitter().finditer(text) if lo <= (p := m.start() + start) < hi and p <= end and m.start() > 0 and not text[m.start() - 1].isspace()]


def pieces(text: str, chunk: int, overlap: int) -> list[str]:
    """The parts of a text between the stitches of its chunks: encoded one by one they give the ids of the whole."""
    n = len(text)
    if n <= chunk:
        return [text]
    cuts, before = [0], None
    for at in range(0, n, chunk):
        start = max(at - overlap, 0)
        part = text[start : at + chunk + overlap]
        places = boundaries(part, start, at - overlap, at + chunk + overlap, start + len(part) >= n)
        if before is not None:
            common = before.intersection(p for p in places if p < at + overlap)
            if not common:
                # Nothing later leans on a true boundary: the rest is one piece.
                break
            cuts.append(min(common))
        before = {p for p in places if p >= at + chunk - overlap}
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def encode_pieces(texts: list[str | None], name: str, folder: str, chunk: int, overlap: int) -> list[list[int]]:
    """The ids of each text, made of the ids of its pieces."""
    cut = [pieces(t or "", chunk, overlap) for t in texts]
    ids = iter(encode_texts([p for ps in cut for p in ps], name, folder))
    out = []
    for ps in cut:
        whole = next(ids)
        for _ in ps[1:]:
            whole += next(ids)
        out.append(whole)
    return out


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None, chunk: int = 1 << 9, overlap: int = 1 << 6, spread: int = 1 << 17) -> DataFrame:
    """key, ids: one row per row of ``docs``, without special tokens.

    Null and empty texts have the empty list. Repeated rows give repeated rows; keys may be null. Extra columns are ignored; an empty table gives an empty result.
    """
    folder = folder or tokenizer_dir()
    docs = own_columns(docs, key, text).toDF("k", "t")
    ktype = docs.schema["k"].dataType
    ship(docs.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = encode_pieces(b.column(1).to_pylist(), name, folder, chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    long = F.length("t") > spread
    short = docs.where(~F.coalesce(long, F.lit(False)))
    schema = f"k {ktype.simpleString()}, ids array<int>"
    done = short.mapInArrow(whole, schema)
    many = docs.where(long)
    found = done if many.isEmpty() else done.unionByName(encode_long(many, name, folder, spread, max(overlap, 1 << 11)))
    return found.withColumnsRenamed({"k": key})


def encode_long(docs: DataFrame, name: str, folder: str, chunk: int, overlap: int) -> DataFrame:
    """The long texts of encode_corpus (columns k, t): chunk, pre-tokenise, stitch, encode, put together."""
    # Rows are told apart by a number of their own, since keys may be null or repeated; it is fixed by the checkpoint.
    rows = checkpoint(docs.select("k", F.monotonically_increasing_id().alias("doc"), "t"))
    docs, ktype = rows.select(F.col("doc").alias("k"), "doc", "t"), "bigint"

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, doc, t in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                for i, at in enumerate(range(0, len(t), chunk)):
                    start = max(at - overlap, 0)
                    row = [[k.as_py()], [doc.as_py()], [len(t)], [i], [start], [t[start : at + chunk + overlap]]]
                    yield pa.RecordBatch.from_arrays([pa.array(row[0], b.schema.field(0).type), *(pa.array(x, pa.int64()) for x in row[1:5]), pa.array(row[5], pa.string())], names=["k", "doc", "n", "i", "start", "part"])

    chunks = (
        docs.mapInArrow(cut_up, f"k {ktype}, doc long, n long, i long, start long, part string")
        .repartition(default_tasks(docs.sparkSession), "k", "doc", "i")
    )

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, tail = [], []
            for n, i, start, part in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True):
                end = start + len(part)
                at = i * chunk
                places = boundaries(part, start, at - overlap, at + chunk + overlap, end >= n)
                # Overlap with the chunk before, and with the one after.
                head.append([p for p in places if at - overlap <= p < at + overlap] if i else [])
                tail.append([p for p in places if at + chunk - overlap <= p] if end < n else [])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(6)), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=["k", "doc", "n", "i", "start", "part", "head", "tail"])

    cut = checkpoint(chunks.mapInArrow(pre_tokenise, f"k {ktype}, doc long, n long, i long, start long, part string, head array<long>, tail array<long>"))
    order = Window.partitionBy("k", "doc").orderBy("i")
    # A stitch is the first boundary that both chunks found in their overlap.
    at = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    stitched = cut.select("k", "doc", "n", "i", "head", "tail").withColumn("at", F.when(F.col("i") == 0, F.lit(0)).otherwise(at))
    # A chunk without a stitch joins the one before it, and so do all after it, whose own stitches then lean on nothing: they
    # form one run that is pre-tokenised again from its start.
    sound = F.min(F.col("at").isNotNull().cast("int")).over(order) == 1
    runs = stitched.withColumn("at", F.when(sound, F.col("at"))).withColumn("run", F.count("at").over(order)).select("k", "doc", "i", "at", "run")
    spans = runs.groupBy("k", "doc", "run").agg(F.min("at").alias("lo"), F.min("i").alias("first"))
    spans = spans.withColumn("hi", F.lead("lo").over(Window.partitionBy("k", "doc").orderBy("run")))
    member = cut.select("k", "doc", "n", "i", "start", "part").join(runs.select("k", "doc", "i", "run"), ["k", "doc", "i"]).join(spans, ["k", "doc", "run"])
    # The last chunk of a run reaches past the next stitch, since chunks overlap on both sides.
    whole = member.groupBy("k", "doc", "run").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "start", "part"))).alias("parts"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for lo, hi, n, parts in zip(*(b.column(c).to_pylist() for c in (3, 4, 5, 6)), strict=True):
                text, at = [], lo
                stop = n if hi is None else hi
                for p in parts:
                    upto = min(stop, p["start"] + len(p["part"]))
                    if upto > at:
                        text.append(p["part"][at - p["start"] : upto - p["start"]])
                        at = upto
                texts.append("".join(text))
            ids = encode_texts(texts, name, folder)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.list_(pa.int32()))], names=["k", "doc", "run", "ids"])

    encoded = whole.select("k", "doc", "run", "lo", "hi", "n", "parts").mapInArrow(encode, f"k {ktype}, doc long, run long, ids array<int>")
    joined = encoded.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("run", "ids"))).alias("r")).select("doc", F.flatten("r.ids").alias("ids"))
    return rows.select("k", "doc").join(joined, "doc").select("k", "ids")
