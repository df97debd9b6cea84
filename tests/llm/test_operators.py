"""The corpus operators against brute force, on generated texts and on the smallest tables, and in odd cases."""

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidewright.llm import html_text, jaccard_join, langid, line_dedup, packing, pieces, quality, suffix_dedup, token_blocks, tokens, topk
from tidewright.llm.common import shared_dir

SCHEMA = "doc_id long, text string"
ODD = [None, "", " \t\n", "word", "one two", "日本 語 ②½ İ é é", "a" * 300, "x y " * 400, "ends with space ", "\r\n\r\n", "<|endoftext|> <s> ▁ ▁▁", "'s 'LL we're don't", "tab\tand nbsp", "😀 emoji 😀"]


def near_copies(seed=0, groups=12, size=14, words=60):
    """Texts in groups of near copies with edits, exact copies, and odd ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    rows = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(words // 2, words * 3))]
        for _ in range(r.randint(1, size)):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append(" ".join(text).title() if r.random() < 0.2 else " ".join(text))
    rows += ODD
    r.shuffle(rows)
    return list(enumerate(rows))


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns whose names the operators use themselves
        for c in ("id", "key", "node", "region", "part", "hash", "n", "ids", "label", "gone", "_text"):
            df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def corpus_rows(corpus):
    return [(r.doc_id, r.text) for r in corpus.orderBy("doc_id").collect()]


# 1

@pytest.mark.parametrize("k,similarity,seed", [(4, 85, 0), (5, 80, 1), (2, 60, 2)])
def test_jaccard_groups(spark, k, similarity, seed):
    rows = near_copies(seed)
    got = sorted(tuple(r) for r in jaccard_join.link_documents(docs_of(spark, rows), k, similarity).collect())
    assert got == sorted(brute.components(rows, k, similarity))


def test_jaccard_large_regions(spark, monkeypatch):
    """Small blocks, so that one group of near copies goes through the rounds of large regions."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    rows = near_copies(7, groups=3, size=70, words=30)
    got = sorted(tuple(r) for r in jaccard_join.link_documents(docs_of(spark, rows, False), 3, 80).collect())
    assert got == sorted(brute.components(rows, 3, 80))


def test_jaccard_corpus_and_empty(spark, corpus, corpus_rows):
    got = sorted(tuple(r) for r in jaccard_join.link_documents(corpus, 4, 85).collect())
    assert got == sorted(brute.components(corpus_rows, 4, 85))
    assert jaccard_join.link_documents(corpus.where("false")).count() == 0
    twice = jaccard_join.link_documents(docs_of(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")]))
    assert [r.component_id for r in twice.collect()] == [1, 1, 1, 1]


def test_region_finds_all_links():
    r = np.random.default_rng(0)
    base = np.arange(200, dtype=np.uint64)
    sets = [np.sort(r.choice(np.concatenate([base, base + 1000]), 180, replace=False)) if k % 3 else np.sort(np.concatenate([base[: 200 - k], base[:k] + 5000])) for k in range(60)]
    region = jaccard_join.Region(sets, 80)
    region.resolve()
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert region.component[i] == region.component[j]


# 2

def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = r.normal(size=(900, 16)).round(2)
    v[100:180] = v[100]
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(900)] + [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (None, [1.0] * 16), (2020, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("id", F.lit("x"))
    got = {}
    for x in topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "CELL", 20)
    rounds = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in rounds) == sorted((q, *x) for q, found in got.items() for x in found)
    # a repeated query has a list of its own for each row, and its copies are no candidates
    twice = topk.top_k(df.where("vec_id < 60").union(df.where("vec_id = 40")), F.col("vec_id") % 20 == 0, k=7).where("query_id = 40").collect()
    assert sorted((x.rank, x.vec_id) for x in twice)[::2] == sorted((x.rank, x.vec_id) for x in twice)[1::2] and len(twice) == 14
    ids = [i for i, e in rows if i is not None and i not in (2000, 2001, 2002, 2003)]
    whole = np.zeros((len(ids), 16), np.int64)
    for k, i in enumerate(ids):
        if i != 2020:
            whole[k] = np.floor(64 * v[i].astype(np.float32).astype(float))
    for q in [i for i in ids if i % 20 == 0]:
        s = whole @ whole[ids.index(q)]
        want = sorted((-int(a), i) for a, i in zip(s, ids) if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -a) for k, (a, i) in enumerate(want)]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 1)"), F.col("vec_id") % 20 == 0).count() == 1


# 3

def check_packing(rows, texts):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in texts]
    ids = {i: x for (i, _), x in zip(texts, want)}
    cover, filled = {}, {}
    for r in rows:
        x = ids[r.doc_id]
        assert r.length > 0 and r.doc_tokens == len(x)
        assert zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(cover) == set(ids)
    for i, spans in cover.items():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end == len(ids[i])
    for spans in filled.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end <= 4096 and (end & (end - 1)) == 0  # no padding at all


def test_packing(spark, corpus, corpus_rows):
    path = P.path("word_bpe_49k.json")
    check_packing(packing.pack_documents(corpus, path).collect(), corpus_rows)
    rows = near_copies(3)
    got = packing.pack_documents(docs_of(spark, rows), path, ids=True).collect()
    check_packing(got, rows)
    assert all(len(r.ids) == r.length for r in got)
    assert packing.pack_documents(corpus.where("false"), path).count() == 0


def test_packing_puts_neighbours_together():
    a, b = np.arange(10, 60, dtype=np.uint32), np.arange(100, 150, dtype=np.uint32)
    documents = [a, b, a[::-1].copy(), b[::-1].copy()]
    index = packing.Index(documents, np.bincount(np.concatenate(documents), minlength=200), 4, 50.0)
    packer = packing.Packer()
    packing.pack_shard([50] * 4, index, packer)
    packer.finish()
    order = [d for window in packer.done for d, start, _ in window if start == 0]
    assert order == [0, 2, 1, 3]


# 4

def test_quality_counts_and_verdicts(spark, corpus, corpus_rows):
    rows = corpus_rows + [(10_000 + k, t) for k, t in enumerate(ODD)]
    got = {r.doc_id: r for r in quality.assess(docs_of(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        want = brute.counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.assess(corpus.where("false")).count() == 0


def test_quality_verdicts_follow_labels(spark, corpus, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.assess(corpus).where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.97 * len(rows)


def test_em_recovers_accuracies():
    """Votes drawn from known rules: the estimate finds their rates and the classes."""
    r = np.random.default_rng(0)
    good = r.random(20_000) < 0.8
    votes = np.ones((20_000, 4), int)
    for k, hit in enumerate((0.7, 0.6, 0.8)):
        votes[:, k] = np.where(r.random(20_000) < np.where(good, 0.01, hit), 0, 1)
    votes[:, 3] = np.where(r.random(20_000) < np.where(good, 0.9, 0.05), 2, 1)
    pattern = votes @ 3 ** np.arange(3, -1, -1)
    found, n = np.unique(pattern, return_counts=True)
    posterior, table, prior = quality.estimate(found, n.astype(float), 4)
    assert abs(prior - 0.8) < 0.03 and abs(table[0, 0, 0] - 0.7) < 0.05 and abs(table[1, 3, 2] - 0.9) < 0.05
    verdict = dict(zip(found.tolist(), posterior >= 0.5))
    assert np.mean([verdict[p] for p in pattern.tolist()] == good) > 0.97


# 5

def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for x in (np.zeros(0), np.full(5, 7), r.integers(0, 50257, 1000), np.r_[r.integers(0, 100, 700), 2**32 - 1, 2**31], r.integers(0, 2**32, 513)):
        x = x.astype(np.uint32)
        data, starts = token_blocks.pack(x)
        assert np.array_equal(token_blocks.unpack(data, starts)[: len(x)], x)
    documents = [r.integers(0, 50257, n).astype("<u4") for n in (3, 0, 700, 1, 256, 2000)]
    f = token_blocks.TokenFile(token_blocks.file_bytes([None, 1, 2, 5, 9, 11], documents))
    assert f.doc_ids == [None, 1, 2, 5, 9, 11]
    for k, (x, y) in enumerate(zip(documents, f.documents(group=2), strict=True)):
        assert np.array_equal(x, y) and np.array_equal(x, f.document(k))
    with pytest.raises(ValueError):
        token_blocks.TokenFile(b"TWPFOR01 cut short")


def test_token_files(spark, corpus, corpus_rows):
    rows = corpus_rows + [(10_000 + k, t) for k, t in enumerate(ODD)]
    manifest = token_blocks.write_token_files(docs_of(spark, rows), shared_dir(spark), P.path("byte_bpe_50k.json"), 2)
    got = token_blocks.read_token_files(spark, manifest).orderBy("doc_id").collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start = 0
    for (i, t), r in zip(rows, got, strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    empty = token_blocks.write_token_files(corpus.where("false"), shared_dir(spark), P.path("byte_bpe_50k.json"), 2)
    assert token_blocks.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_library(corpus_rows, name, kind):
    lib = Tokenizer.from_file(P.path(name))
    e = tokens.Encoder(P.path(name), kind)
    for t in [*ODD, *(t for _, t in corpus_rows[:60]), "!'s''re 12ab", "  a\n\n b  ", "ÀÖØöøÿ×÷ß", "x" * 5000]:
        assert e.ids(t).tolist() == lib.encode(t or "", add_special_tokens=False).ids


# 6

def test_language_id(spark, corpus):
    known = langid.learn(corpus)
    assert known.names == ("de", "en", "es", "fr")
    rows = langid.classify(corpus, known, keep=["doc_id", "lang"]).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_language_id_odd(spark, corpus):
    known = langid.learn(corpus)
    odd = [(0, None), (1, ""), (2, "123 !!"), (3, "the thing and the other of that"), (4, "\u00bd \u00b2 12 _"), (5, "\u0663 \u2460"), (6, "\u0301\u0302")]
    docs = docs_of(spark, odd).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.classify(docs, known, keep=docs.columns).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, 4, 5, 6)] == ["und"] * 6 and got[3].lang_pred == "en" and 0 < got[3].score <= 1
    nothing = langid.learn(corpus.where("false"))
    assert langid.classify(corpus, nothing).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.classify(corpus.where("false"), known).count() == 0
    assert langid.learn(corpus.union(corpus)).contents == known.contents


def test_language_sizes_against_plain(spark, corpus, corpus_rows):
    """Every text's sizes by compressors made anew for each piece, with the dictionaries as bytes."""
    known = langid.learn(corpus)
    got = {r.doc_id: r for r in langid.classify(corpus, known).collect()}
    for i, text in corpus_rows[::5]:
        kept = " ".join("".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()).encode()
        if not kept:
            assert got[i].lang_pred == "und"
            continue
        total = {}
        for name, content in zip(known.names, known.contents, strict=True):
            p = zstandard.ZstdCompressionParameters(**langid.SEARCH, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total[name] = sum(len(zstandard.ZstdCompressor(dict_data=own, compression_params=p).compress(kept[o : o + 2048])) for o in range(0, len(kept), 2048))
        first, second = sorted(total.values())[:2]
        assert total[got[i].lang_pred] == first and got[i].score == pytest.approx((second - first) / second) and got[i].rejected == (got[i].score < langid.MARGIN)


def test_languages_that_were_not_learned_are_rejected(spark, corpus):
    """Random letters and words of no learned language go, at every length; labelled documents of that length stay."""
    known, r = langid.learn(corpus), random.Random(3)
    rows = [(k, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(r.choice([30, 100, 500])))) for k in range(60)]
    assert langid.classify(docs_of(spark, rows), known).where("rejected").count() >= 50
    held = [x for x in langid.classify(corpus.where("length(text) >= 200"), known, ["doc_id", "lang"]).collect() if x.lang is not None]
    assert sum(x.rejected for x in held) <= 0.03 * len(held)


# 7

def test_suffix_dedup(spark, corpus, corpus_rows):
    r = random.Random(2)
    base = ["".join(r.choice("ab é日") for _ in range(r.randint(0, 400))) for _ in range(9)]
    rows = [(i, "".join(r.choice(base)[r.randint(0, 50) :][: r.randint(20, 300)] for _ in range(r.randint(0, 5)))) for i in range(90)]
    rows += [(500, "a" * 3000), (501, "b" + "a" * 150 + "c"), (502, None), (503, ""), (504, "xyz" * 200), (505, "q" * 99), (506, "q" * 99)]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), with_text=True).collect()
    want = brute.repeats(dict(rows))
    assert {x.doc_id: tuple(x)[1:5] for x in got} == want
    got = suffix_dedup.remove_repeats(corpus).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == brute.repeats(dict(corpus_rows))
    assert suffix_dedup.remove_repeats(corpus.where("false")).count() == 0


def test_suffix_dedup_frequent_anchors(spark, monkeypatch, corpus_rows):
    """Anchors in more than three places go by the hashes of their windows."""
    monkeypatch.setattr(suffix_dedup, "QUEUE", 6)
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line = word(130)
    rows = [(i, word(r.randint(0, 90)) + line[: r.randint(60, 130)] + word(r.randint(0, 200))) for i in range(40)] + [(50 + i, word(30) + line * 2) for i in range(9)] + [(100 + i, t) for i, t in corpus_rows[:80]]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows)).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == brute.repeats(dict(rows))


def test_suffix_dedup_long_texts(spark, monkeypatch):
    """Chunks far shorter than a text: repeats across their edges are found, as in whole texts."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    r = random.Random(5)
    unit = "".join(r.choice("abcdefg ") for _ in range(900))
    texts = {0: unit * 3, 1: "z" * 350 + unit[200:700] + "y" * 90, 2: unit[::-1] * 2}
    rows = []
    for key in sorted(texts):
        rows.append(((key, 0), texts[key].encode()))
    whole = {}
    for data, stops, keys, bases in suffix_dedup.chunks(rows, 700):
        h, place, first, last = suffix_dedup.anchors(data, stops)
        doc = np.searchsorted(stops, place, side="right")
        shift = bases[doc] - (stops - np.diff(stops, prepend=0))[doc]
        for k, a, b, c in zip(doc.tolist(), (place + shift).tolist(), (first + shift).tolist(), (last + shift).tolist(), strict=True):
            for o in range(b, c + 1):
                assert whole.setdefault((keys[k], o), a) == a
    assert sorted(whole) == sorted(((k, 0), o) for k, t in texts.items() for o in range(len(t) - 99))


def test_repeated_documents_with_equal_ids(spark):
    r = random.Random(1)
    t = "".join(r.choice("abcdef ") for _ in range(500))
    got = suffix_dedup.remove_repeats(docs_of(spark, [(7, t), (7, t), (8, t)])).orderBy("doc_id").collect()
    assert [x.n_removed for x in got] == [0, 0, 500]


# 8

def test_line_dedup(spark, corpus, corpus_rows):
    r = random.Random(4)
    lines = ["".join(r.choice("abcdefghij ") for _ in range(r.randint(5, 60))) for _ in range(60)]
    rows = [(i, "\n".join(lines[(s + j) % 60] if r.random() < 0.9 else f"own line {i} {j}" for j in range(r.randint(0, 20)))) for i in range(80) for s in [r.randrange(60)]]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "\n\n\n")]
    got = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == brute.line_dedup(dict(rows))
    got = line_dedup.dedup_lines(corpus).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == brute.line_dedup(dict(corpus_rows))
    assert line_dedup.dedup_lines(corpus.where("false")).count() == 0


def test_patience():
    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.randrange(12) for _ in range(r.randrange(25))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p < q and s < t for (p, s), (q, t) in zip(found, found[1:]))
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.common_blocks([9, 1, 2, 3, 8], [1, 2, 3], [100] * 5, [100] * 3, 250) == [1, 2, 3]
    assert line_dedup.common_blocks([9, 1, 8], [1], [100] * 3, [100], 250) == []
    assert line_dedup.common_blocks([1, 2, 7, 3, 4], [3, 4, 9, 1, 2], [30] * 5, [30] * 5, 60) == [0, 1, 3, 4]  # the other way round


# 9

PAGE = """<!DOCTYPE html><html><head><title>Title here</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a> site name</header><nav><ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work better for you.</div><div class="ad">Buy now, ten percent off all shoes!</div>
<article><h1>A   heading &amp; more</h1><p>First <b>paragraph</b> of the
text&nbsp;here, with words.<br>Another line.<p>Second one.</p><p>Ok.</p><!-- <p>no</p> --></article>
<aside><p>Related stories that you may like to read too</p></aside><section class="comments"><p>Reader: I disagree with all of this.</p></section>
<form><label>Name</label><input></form><footer>&copy; 2024 all rights reserved</footer></body></html>"""


ARTICLE = "<h1>Title</h1><p>One two three four five six seven eight nine ten.</p><p>Short.</p><p>Another paragraph that goes on for a while, with commas and so on.</p>"


def _features(found):
    size, edge = [f[:2] for _, f in found], [0.0, 0.0]
    return [[*f[:2], *(size[k - 1] if k else edge), *(size[k + 1] if k + 1 < len(found) else edge), *f[2:]] for k, (_, f) in enumerate(found)]


def _used(tree):
    return set() if len(tree) == 1 else {html_text.FEATURES[tree[0]]} | _used(tree[2]) | _used(tree[3])


def test_html_text(spark, sf_dir):
    tree = html_text.grow(*html_text.labelled())
    assert html_text.main_text(PAGE, tree) == "A heading & more\nFirst paragraph of the text here, with words. Another line.\nSecond one.\nOk."
    x, y = html_text.labelled()
    assert np.mean([(html_text.judge(tree, list(r)) >= 0.5) == bool(t) for r, t in zip(x, y)]) > 0.98
    assert {"words", "links", "words_before", "prose"} <= _used(tree)
    rows = [(0, None), (1, ""), (2, "plain text without any markup but with a good many words, which is therefore long enough to be read by itself"), (3, "<p>a&#39;s &amp"), (4, PAGE[:900]), (5, "<script>never closed"), (6, "<" * 50 + ">" * 50)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")).withColumn("words", F.lit(1)).withColumn("Text", F.lit("x"))
    got = {r.page_id: r for r in html_text.extract(df, ["page_id", "url", "Text"]).collect()}
    assert got[0].text == got[1].text == got[5].text == "" and got[2].n_chars == len(rows[2][1])
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html_text.extract(pages, ["page_id", "html"]).collect():
        assert r.n_chars == len(r.text) > 0 and "©" not in r.text
    assert html_text.extract(pages.where("false"), ["page_id"]).count() == 0


def test_html_blocks_are_told_by_their_text(spark, sf_dir):
    """Without what tags and names say of articles and furniture, one block in a hundred may come out otherwise."""
    tree = html_text.grow(*html_text.labelled())
    n = wrong = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        for f in _features(html_text.blocks(r.html)):
            n += 1
            wrong += (html_text.judge(tree, f) >= 0.5) != (html_text.judge(tree, [*f[:7], 0.0, 0.0]) >= 0.5)
    assert n > 500 and wrong <= 0.01 * n


@pytest.mark.parametrize("name", ["article-meta", "share-article", "tags", "legal", "promo-story", "notice", "search"])
def test_html_names_on_what_holds_the_article(name):
    tree, want = html_text.grow(*html_text.labelled()), ARTICLE.replace("<h1>", "").replace("</h1><p>", "\n").replace("</p><p>", "\n").replace("</p>", "")
    for page in (f'<article class="{name}">{ARTICLE}</article>', f'<div class="{name}"><article>{ARTICLE}</article></div>', f'<div class="{name}">{ARTICLE}</div>'):
        assert html_text.main_text(f"<nav><a href=x>Home</a></nav>{page}<footer>foot text</footer>", tree) == want


def test_html_odd_markup():
    tree = html_text.grow(*html_text.labelled())
    page = '<article><p>a b</p><svg class="x"/><p>c d</p><svg><text>no</text></svg><p>e\u200bf</p><script/>no()</script><noscript><p>g\u00a0 h</p></article>'
    assert html_text.main_text(page, tree) == "a b\nc d\ne\u200bf\ng h"
    items = "".join(f"<li>{'word ' * n}</li>" for n in (3, 10, 14, 25, 1))
    assert html_text.main_text(f"<article><h1>T</h1><p>{'w ' * 45}</p><ul>{items}</ul></article>", tree).count("\n") == 6
    comments = f"<article>{ARTICLE}<section class=comments><h2>Comments</h2><p>{'I like this. ' * 40}</p></section></article>"
    assert "like" not in html_text.main_text(comments, tree)


# 10

def test_pieces(spark, corpus, corpus_rows, monkeypatch):
    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = corpus_rows + [(10_000 + k, t) for k, t in enumerate([*ODD, " ", "  ", " a", "a ", "\x00b", "▁x"])]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in pieces.piece_digests(docs, path).collect()}
    whole = {r.doc_id: r for r in pieces.encode_pieces(docs, path).collect()}
    for i, t in rows:
        ids = lib.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(lib.decode(ids)))
        assert list(whole[i].ids) == ids and whole[i].decoded == lib.decode(ids)
    assert pieces.piece_digests(corpus.where("false"), path).count() == 0
    monkeypatch.setattr(pieces, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 7)
    again = {r.doc_id: r for r in pieces.piece_digests(docs.repartition(3), path).collect()}
    assert again == got
