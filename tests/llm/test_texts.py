"""P6, P7 and P8: exact round trips, planted leaks against brute force, and languages."""

import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import languages as L
from factweave.llm import leakage as K
from factweave.llm import tokens as T

D = "doc_id long, text string, ids string, lang string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], D)


TEXTS = ["hello world", None, "", "<|endoftext|> is text", "don't  stop\n\n\n now ", "größer 𝒢 控制台 👩‍🔧", " " * 700, "a" * 900, "'s" * 400, "x\n" * 300, "The quick brown fox. " * 80, "hello world"]


def test_ids_equal_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.tokenizer_dir() + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    for chunk, overlap, spread in ((1 << 17, 1 << 11, 1 << 17), (200, 60, 1 << 17), (64, 30, 200), (64, 30, 64)):
        got = {k: list(v) for k, v in [(r["doc_id"], r["ids"]) for r in T.encode_corpus(docs(spark, TEXTS), chunk=chunk, overlap=overlap, spread=spread).collect()]}
        assert [got[i] for i in range(len(TEXTS))] == want
    assert T.encode_corpus(docs(spark, [])).count() == 0


@given(st.text(max_size=300))
@settings(max_examples=60, deadline=None)
def test_decoding_gives_the_text_back(text):
    folder = T.tokenizer_dir()
    assert T.decode_ids(T.encode_texts([text], "byte_bpe_50k", folder)[0], "byte_bpe_50k", folder) == text


@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=40), st.lists(st.sampled_from("abcd"), max_size=80))
@settings(max_examples=150, deadline=None)
def test_myers_is_edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    assert K.myers(p, t)[0] == min(row)


WORDS = [f"{a}{b}" for a in ("har", "kil", "loo", "mon", "obs", "pul") for b in ("bor", "nter", "mary", "stery", "ervat", "leyon")]


def planted(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(r.randrange(28, 60)))) for i in range(12)]
    texts, want = [], set()
    for d in range(60):
        i, t = r.choice(items)
        w = t.split()
        kind = d % 6
        if kind == 0:
            body = t.upper().replace(" ", " \n> ")
        elif kind == 1:
            a = r.randrange(len(w) - 15)
            body = " ".join(w[a : a + 15]) + ", and so on."
        elif kind == 2:
            for k in r.sample(range(len(w)), len(w) // 5):
                w[k] = "zzz"
            body = "<b>" + "</b> ".join(w)
        elif kind == 3:
            a = r.randrange(len(w) - 14)
            body = " ".join(w[a : a + 12])
        elif kind == 4:
            body = '{"q": "' + t.replace(" ", "\\n") + '"}'
        else:
            for k in range(0, len(w), 2):
                w[k] = "zzz"
            body = " ".join(w)
        texts.append(f"Some words before. {body} And some after it.")
        if kind in (0, 1, 2, 4):
            want.add((d, i))
    return items, texts, want


def test_planted_leaks(spark):
    items, texts, want = planted(9)
    df = docs(spark, [*texts, None, "", texts[0]])
    it = spark.createDataFrame([*items, (99, None), (98, ""), (0, items[0][1])], "item_id long, item_text string").withColumnRenamed("item_id", "item_id")
    got = set(rows(K.find_leaks(df, it), "doc_id", "item_id"))
    again = {(62, i) for d, i in want if d == 0}
    assert got == want | again
    # Blocks of items give the same; empty sides give nothing.
    assert set(rows(K.find_leaks(df, it, block=3), "doc_id", "item_id")) == got
    assert K.find_leaks(df.limit(0), it).count() == 0 and K.find_leaks(df, it.limit(0)).count() == 0


def test_pieces_cover_every_run_and_budget():
    for n in range(1, 90):
        p = K.pieces(n, 15, 0.75)
        assert p[0][0] == 0 and p[-1][1] == n and all(a < b for a, b in p) and all(x[1] == y[0] for x, y in zip(p, p[1:], strict=False))
        assert len(p) >= min(n, n - -(-3 * n // 4) + 1)
        assert all(any(s <= a and b <= s + 15 for a, b in p) for s in range(max(1, n - 14))) or n < 15


SENTENCES = {
    "en": ["The planner reads every file before the server starts.", "Our parser drops the edges that nobody asked for.", "This release keeps the last answers in memory."], "de": ["Der Planer liest jede Datei bevor der Dienst startet.", "Unser Parser verwirft die Kanten die niemand wollte.", "Diese Fassung behält die letzten Antworten im Speicher."],
    "fr": ["Le planificateur lit chaque fichier avant le démarrage du serveur.", "Notre analyseur supprime les arêtes que personne ne voulait.", "Cette version garde les dernières réponses en mémoire."], "ru": ["Планировщик читает каждый файл до запуска сервера.", "Наш анализатор отбрасывает рёбра которые никто не просил.", "Эта версия хранит последние ответы в памяти."], "zh": ["规划器在服务器启动之前读取每个文件。", "我们的解析器丢弃没有人要求的边。", "这个版本在内存中保留最近的回答。"],
}


def corpus(spark):
    r = random.Random(1)
    data = []
    for c, ss in SENTENCES.items():
        for i in range(40):
            text = " ".join(r.choice(ss) for _ in range(3))
            label = r.choice([x for x in SENTENCES if x != c]) if i % 8 == 0 else {"en": "en-US", "de": "German"}.get(c, c)
            data.append((text, label, {c}))
    for i in range(10):
        a, b = ("en", "fr") if i % 2 else ("de", "ru")
        data.append((f"{SENTENCES[a][i % 3]} {SENTENCES[a][(i + 1) % 3]}\n\n{SENTENCES[b][i % 3]}", a, {a, b}))
    data += [("", "en", set()), (None, None, set()), ("12 34 56", "en", set()), ("```\nfunc a() {\n}\n```", None, set()), (SENTENCES["en"][0] + " Vgl. „Kante“.", None, {"en"}), (SENTENCES["en"][0], "??", {"en"}), (SENTENCES["de"][1].replace("ü", "u").replace("ä", "a"), "", {"de"})]
    return spark.createDataFrame([(i, t, "c", c) for i, (t, c, _) in enumerate(data)], D), {i: w for i, (_, _, w) in enumerate(data)}


def test_languages(spark):
    df, want = corpus(spark)
    got: dict = {i: set() for i in want}
    for r in L.identify(df).collect():
        got[r["doc_id"]].add(r["lang_code"])
        assert 0 < r["confidence"] <= 1 and r["n_langs"] == len(want[r["doc_id"]])
    assert got == want
    segments = L.identify_segments(df)
    assert {r["segment_lang"] for r in segments.where("doc_id = 201").collect()} == {"en", "fr"}


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en-US", "ENGLISH", " deu ", "pt_BR", "zh-Hans", "und", "", None, "bg")], "x string")
    assert [r[0] for r in df.select(L.label_code(df["x"])).collect()] == ["en", "en", "de", "pt", "zh", None, None, None, None]


def test_languages_of_nothing(spark):
    df, _ = corpus(spark)
    assert L.identify(df.limit(0)).count() == 0 and L.identify(df.where("lang = '??'")).count() == 0


def test_long_texts(spark):
    df, _ = corpus(spark)
    long = spark.createDataFrame([(999, " ".join(SENTENCES["fr"]) * 3000, "c", None)], D)
    assert rows(L.identify(df.unionByName(long)).where("doc_id = 999"), "lang_code") == [("fr",)]


def test_altered_and_glued_words_that_leave_few_pieces(spark):
    """82 words, one letter altered in 16 of the 21 pieces, and words glued together there: only five pieces are hit."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(5, 9))) for _ in range(82)]
    ends = [b for _, b in K.pieces(82, 15, 0.75)]
    at = [b - 1 for i, b in enumerate(ends) if i not in (3, 7, 11, 15, 19)]
    text = [w[:-1] + ("q" if w[-1] != "q" else "z") if i in at else w for i, w in enumerate(words)]
    glued = "".join(w + ("" if i in at[::2] and i < 81 else " ") for i, w in enumerate(text))
    it = spark.createDataFrame([(1, " ".join(words))], "item_id long, item_text string")
    assert rows(K.find_leaks(docs(spark, [f"before {glued} after", "before " + " ".join(sorted(words))]), it), "doc_id", "item_id") == [(0, 1)]


def test_long_texts_with_null_and_repeated_keys(spark):
    text = "The quick brown fox. " * 80
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (8, text)], "doc_id long, text string")
    got = [(r["doc_id"], list(r["ids"])) for r in T.encode_corpus(df, chunk=100, overlap=40, spread=200).collect()]
    want = list(T.encode_texts([text], "byte_bpe_50k", T.tokenizer_dir())[0])
    assert sorted(str(k) for k, _ in got) == ["7", "7", "8", "None"] and all(ids == want for _, ids in got)


def test_few_pieces_left_and_separators_lost(spark):
    """Nine of forty words altered by a letter each, in eleven of the pieces: found with separators and without."""
    words = [f"{a}{b}word" for a in ("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta") for b in ("red", "blue", "green", "black", "white")]
    altered = list(words)
    for i in range(0, 36, 4):
        altered[i] = altered[i][:-1] + "x"
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, item_text string")
    texts = spark.createDataFrame([(1, "before " + " ".join(altered) + " after"), (2, "before " + "".join(altered) + " after"), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["kind"]) for r in K.find_leaks(texts, items).collect()) == [(1, "altered"), (2, "altered")]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (300, 40), (1 << 12, 64)])
def test_pieces_are_exact(chunk, overlap):
    folder = T.tokenizer_dir()
    texts = ["", "a", " " * 500, "ab " * 300, "x" * 900, "日本語のテキスト。" * 60, "don't\n\n\n  we're 12345 " * 40, "\t\t" + "word1 " * 200 + "\r\n"]
    assert T.encode_pieces(texts, "byte_bpe_50k", folder, chunk, overlap) == T.encode_texts(texts, "byte_bpe_50k", folder)
    assert len(T.pieces("ab cd " * 200, 64, 16)) > 5 and all("".join(T.pieces(t, chunk, overlap)) == t for t in texts)
