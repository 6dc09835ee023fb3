"""Token counts, collocations and divergence against plain Python over small tables."""

import random
import re
import sys
from collections import Counter

from pyspark.sql import functions as F
from tests.llm.test_operators import empty, odd, table, words

from tidemark.llm import collocations, divergence, packing, token_counts


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def library(path=None):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path or packing.default_vocabulary())
    return lambda text: len(own.encode(text or "", add_special_tokens=False).ids)


HARD = ["", " ", "a  b", "it's 12 o'clock\n\n x", "<|endoftext|>", "a b<|endoftext|> c <|endoftext", "\x1c\x1d a", "😀😀  😀", "tab\t\tend \n", "''s don't I'LL", "\U00011db0a ՘b", " " * 3000, "x" * 5000, "語" * 4000, "1" * 5000]


def test_token_counts_equal_the_library(spark):
    n = library()
    docs = odd(spark).unionByName(table(spark, HARD, first=100))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.counted(docs).collect())
    assert got == Counter((r["doc_id"], len((r["text"] or "").encode()), n(r["text"]), n(r["text"]) > 512) for r in docs.collect())
    assert token_counts.counted(empty(spark)).count() == 0


def test_every_code_point_is_cut_as_the_library_does(spark):
    """Each code point between a letter, a digit, a mark and blanks; those that libraries class differently are known as unsure."""
    n, count = library(), token_counts.counter(packing.default_vocabulary())
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}1{chr(c)}. {chr(c)}" for c in points[i : i + 4]) for i in range(0, len(points), 4) if points[i] < 0x33500 or points[i] % 4096 < 8 or points[i] >= 0xE0000]
    wrong = [t for t in random.Random(1).sample(texts, 20_000) + texts[:16_000] if count(t) != n(t)]
    assert not wrong, [hex(ord(t[1])) for t in wrong[:5]]


def test_spliced_chunks_equal_whole_texts(spark):
    n = library()
    random.seed(4)
    parts = ["word", " other", "  ", "\n", ".", "'s", "'ll", "12", "é", "語語", "<|endoftext|>", "<|end", "\t", "…", "😀", "x" * 40, "-" * 30]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(200, 1500))) for _ in range(40)]
    texts += ["x" * 9000, "語" * 3000, "ab " * 3000, "<|endoftext|>" * 500, (" " * 301 + "a") * 20, ("y" * 2500 + " ") * 3, "a" * 700 + "語" * 700 + " b" * 900, None]
    docs = table(spark, texts)
    docs = docs.unionByName(docs.where("doc_id < 3"))
    for step, overlap in ((500, 110), (1000, 300)):
        got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.counted(docs, step=step, overlap=overlap).collect())
        assert got == Counter((r["doc_id"], n(r["text"])) for r in docs.collect())


def test_overlaps_widen_where_chunks_do_not_align(spark):
    text = "ab " * 200 + "z" * 6000 + " cd" * 200
    rows = spark.createDataFrame([(7, len(text), text)], "uid bigint, n_bytes bigint, text string")
    path = packing.default_vocabulary()
    parts = [(7, k, k * 500, 500 * (k + 1) + 100 >= len(text), text[k * 500 : k * 500 + 600].encode()) for k in range(-(-(len(text) - 100) // 500))]
    chunks = spark.createDataFrame(parts, "uid bigint, k bigint, start bigint, last boolean, data binary")
    assert token_counts.spliced(token_counts.encoded_chunks(chunks, path, 100)).first()["failed"]
    assert token_counts.resynchronised(rows, path, 500, 100).first()["n_tokens"] == library()(text)


def test_other_vocabularies_are_counted_whole(spark):
    import public_tokenizers
    import sentencepiece

    texts = ["Hello  world's end", "  two ", "é 中文", words(3, 400), "", None]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        own = sentencepiece.SentencePieceProcessor(model_file=path) if name.endswith(".model") else None
        n = (lambda t: len(own.encode(t or ""))) if own else library(path)  # noqa: B023
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(table(spark, texts), vocabulary=path).collect()}
        assert got == {i: n(t) for i, t in enumerate(texts)}


def talk(seed, n=60):
    random.seed(seed)
    phrases = ["new york city hall", "of the", "at the end of the day", "A\tb  c", "one. two", "é ü", "x,y", "odd\x1fword", "nul\x00 word", "a\x0bb", "a", "b", "c"]
    return [random.choice([" ", ". ", "\n", " "]).join(random.choice(phrases) for _ in range(40)) for _ in range(n)]


def collocated(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= least:
            score, k = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w)))
            inside = any(100 * b >= 80 * a and x[0] == lang and any(list(x[1 + i : 1 + i + len(w)]) == w for i in range(len(x) - len(w))) for x, b in f.items() if b >= least and len(x) - 1 > len(w))
            if not inside:
                out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            yield (r[0], ranks[r[0]], *r[1:])


def test_collocations_against_brute_force(spark):
    texts = talk(1) + talk(2)
    docs = table(spark, texts).withColumn("lang", F.expr("case doc_id % 3 when 0 then 'en' when 1 then null else '' end"))
    docs = docs.withColumn("phrase", F.lit("x")).withColumn("f", F.lit(1)).unionByName(docs.where("doc_id < 5"), allowMissingColumns=True)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    for top in (2000, 7):
        got = sorted(map(tuple, collocations.mined(docs, top=top).collect()))
        assert got == sorted(collocated(rows, top=top)) and len({r[0] for r in got}) == 3


def test_collocations_of_odd_tables(spark):
    docs = odd(spark)
    assert collocations.mined(empty(spark)).count() == 0 and collocations.mined(docs).count() == 0
    got = sorted(map(tuple, collocations.mined(docs, least=2).collect()))
    assert got == sorted(collocated([(r["lang"], r["text"]) for r in docs.collect()], least=2))


def test_streams_cut_anywhere_give_the_same_counts(spark):
    """Phrases that share long beginnings, in more parts than phrases a beginning: open rows carry what a part lacks."""
    rows = {("en", ("a",)): 900, ("en", ("a", "b")): 500, ("en", ("a", "b", "c")): 300, ("fr", ("a",)): 40}
    rows |= {("en", ("a", "b", "c", f"d{i:03d}")): 30 + i for i in range(60)}
    df = spark.createDataFrame([(lang, list(k), f) for (lang, k), f in rows.items()], "lang string, words array<string>, f bigint")
    for n in (1, 7, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = {(r["lang"], tuple(r["key"])): (r["f"], r["shorter"], r["longer"]) for r in collocations.annotated(df, F.col("words"), "test").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert len(got) == len(rows)
        for (lang, key), (f, shorter, longer) in got.items():
            assert f == rows[lang, key] and shorter == [rows[lang, key[:n]] for n in range(1, len(key))]
            assert longer == max((g for (x, k), g in rows.items() if x == lang and k[:-1] == key), default=None)


def strayed(rows, min_docs=3, top=200):
    docs, n, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        docs.update((lang, t) for t in set(found))
        n.update((lang, source, t) for t in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), d in docs.items() if x == lang and d >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (n[lang, s, t] + 1) // (total[s] + len(kept)) for s in sources for t in kept}
        whole = {t: 1 + 10**9 * (sum(n[lang, s, t] for s in sources) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s, t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept if n[lang, s, t] and p[s, t] > whole[t]]
            out += [(lang, s, "pair", x[2], -x[0], i + 1) for i, x in enumerate(sorted(pairs))]
            out += [(lang, s, "term", x[2], -x[0], i + 1) for i, x in enumerate(sorted(terms)[:top])]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    texts = [words(i, 80, size=150) for i in range(70)] + ["Été ÉTÉ été x1y", "été a_b", "Été"] * 2 + [None, "", "123 !?"]
    docs = table(spark, texts).withColumn("lang", F.expr("case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then 'fr' else 'en' end"))
    docs = docs.withColumn("source", F.expr("case when doc_id % 7 = 6 then null else concat('s', doc_id % 7) end")).withColumn("term", F.lit(1)).withColumn("place", F.lit(2))
    lone = spark.createDataFrame([(900, "??", "xx", "only"), (901, None, "xx", "other")], "doc_id bigint, text string, lang string, source string")
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(lone, allowMissingColumns=True)
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    for top in (200, 5):
        got = sorted(map(tuple, divergence.audited(docs, top=top).collect()))
        assert got == strayed(rows, top=top)
    assert {r[:5] for r in strayed(rows) if r[0] == "xx"} == {("xx", "only", "pair", "other", 0), ("xx", "other", "pair", "only", 0)}


def test_divergence_of_odd_tables(spark):
    assert divergence.audited(empty(spark)).count() == 0
    docs = odd(spark)
    assert sorted(map(tuple, divergence.audited(docs).collect())) == strayed([(r["lang"], r["source"], r["text"]) for r in docs.collect()])
