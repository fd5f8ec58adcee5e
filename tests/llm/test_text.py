import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import pieces as P
from tamis.llm.encode import cut_points, encode_corpus, repaired
from tamis.llm.leaks import Automaton, find_leaks, leaked, remove_leaks, without_spans, words
from tamis.llm.tokens import encoding

ALPHABET = ["a", "b", " ", "  ", "\n", "\n\n", "é", "'s", "1", "٣", "日本", " ", "!!", "\t", " mot", "<|endoftext|>", "👍🏽", "\u0000", "."]


@given(st.lists(st.sampled_from(ALPHABET), min_size=1, max_size=80), st.lists(st.integers(1, 200), max_size=6))
@settings(max_examples=300, deadline=None)
def test_any_cuts_are_repaired_to_the_ids_of_the_whole(parts, cuts):
    enc, text = encoding(), "".join(parts)
    ends = sorted({min(c, len(text)) for c in cuts} | {len(text)})
    chunks = [enc.encode_ordinary(text[a:z]) for a, z in zip([0, *ends], ends) if z > a]
    assert repaired(chunks, enc) == enc.encode_ordinary(text)


@given(st.lists(st.sampled_from(ALPHABET), max_size=2000))
@settings(max_examples=50, deadline=None)
def test_chunks_cover_the_text_and_end_between_characters(parts):
    data = "".join(parts).encode()
    ends = cut_points(data)
    assert ends == sorted(set(ends)) and (not data or ends[-1] == len(data))
    for a, z in zip([0, *ends], ends):
        data[a:z].decode()


def test_the_same_passage_gives_the_same_chunks():
    rnd = random.Random(1)
    passage = " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(2000))
    cut = lambda t: {t.encode()[a:z] for a, z in zip([0, *cut_points(t.encode())], cut_points(t.encode()))}
    assert len(cut(passage) & cut("Un autre début, plus long. " + passage)) > 0.9 * len(cut(passage))


def test_corpus_with_nulls_repeats_long_texts_and_clashing_columns(spark):
    rnd = random.Random(2)
    long = " ".join("".join(rnd.choices("abcdeé", k=rnd.randint(1, 9))) for _ in range(20_000))
    rows = [(1, "Bonjour <|endoftext|> à tous", 0), (2, None, 0), (3, "", 0), (4, long, 0), (4, long, 0), (4, "autre", 0), (None, "sans id", 0), (5, "x" * 30_000, 0), (6, "  \n\t ", 0), (7, "日本語" * 5000, 0)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids INT").repartition(3)
    enc = encoding()
    got = sorted((str(r.doc_id), list(r.ids)) for r in encode_corpus(df).collect())
    assert got == sorted((str(d), enc.encode_ordinary(t or "")) for d, t, _ in rows)
    assert encode_corpus(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(3)
    return [(i, " ".join(rnd.choice(["le", "la", "dossier", "banque", "n", "mai", "juin", "total", "net"]) for _ in range(rnd.randint(5, 40)))) for i in range(30)] + [(99, None), (98, ""), (97, "court"), (None, "un deux trois quatre cinq six sept huit neuf dix onze douze")]


def brute(docs, items, least=12):
    runs = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - least + 1):
            runs.setdefault(tuple(w[k : k + least]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t or "")] for k in range(len(w) - least + 1) for i in runs.get(tuple(w[k : k + least]), ()) if i is not None}


def documents(items):
    rnd = random.Random(4)
    out = [(1, None), (2, ""), (3, "rien"), (4, "mot " * 50_000)]
    for d in range(5, 60):
        i, t = rnd.choice(items[:30])
        w = t.split()
        a = rnd.randint(0, max(0, len(w) - 1))
        part = " ".join(w[a : a + rnd.randint(8, 30)])
        out.append((d, f"Début du texte, {part.upper() if d % 2 else part} ; fin é."))
    return out


def test_leaks_equal_brute_force_in_one_block_and_in_many(spark, items):
    docs = documents(items)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id BIGINT, text STRING, item_id INT")
    it = spark.createDataFrame([(*x, 1) for x in [*items, items[0]]], "item_id BIGINT, text STRING, doc_id INT")
    expected = brute(docs, items)
    assert len(expected) > 10
    for block in (100_000, 60):
        assert {(r.doc_id, r.item_id) for r in find_leaks(d, it, block_words=block).collect()} == expected
    assert find_leaks(d.limit(0), it).count() == 0 and find_leaks(d, it.limit(0)).count() == 0


def test_longest_run_and_coverage():
    a = Automaton([(1, "a b c d e f g h i j k l m n".split()), (2, "x c d e f g h i j k l m n o".split())])
    assert leaked(a, "z a b c d e f g h i j k l m n z") == {1: [14, 14], 2: [12, 12]}
    assert leaked(a, "A, b. c; d e f g h i j k L") == {1: [12, 12]}
    assert leaked(a, "a b c d e f g h i j k") == {}


def test_spans_go_until_none_is_left(spark, items):
    docs = documents(items)
    d, it = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    out = {r.doc_id: r for r in remove_leaks(d, it, most_coverage=1.0, block_words=60).collect()}
    assert len(out) == len(docs) and out[1].text is None and out[3].text == "rien"
    assert not brute([(k, r.text) for k, r in out.items()], items)
    assert {k for k, r in out.items() if r.removed} == {k for k, _ in brute(docs, items)}
    assert all(r.dropped for r in remove_leaks(d, it, most_coverage=0.1).filter("removed > 0").collect())
    a = Automaton([(1, "un deux trois quatre cinq six sept huit neuf dix onze douze".split())])
    assert without_spans(a, "Là — Un, deux, trois, quatre, cinq, six, sept, huit, neuf, dix, onze, dóuzé! ici")[0] == "Là —  ! ici"


def test_short_items_are_found_with_a_smaller_least(spark):
    nine = "un deux trois quatre cinq six sept huit neuf"
    d = spark.createDataFrame([(1, f"avant {nine} après"), (2, "un deux trois")], "doc_id BIGINT, text STRING")
    it = spark.createDataFrame([(7, nine), (8, "un deux trois quatre")], "item_id BIGINT, text STRING")
    assert [(r.doc_id, r.item_id, r.longest) for r in find_leaks(d, it, least=8).collect()] == [(1, 7, 9)]
    assert find_leaks(d, it, least=10).count() == 0
    assert {r.doc_id: r.removed for r in remove_leaks(d, it, least=8).collect()} == {1: 9, 2: 0}


def test_cleaned_texts_are_the_same_for_blocks_of_any_size(spark, items):
    docs = documents(items)
    # the cut of one item joins the two halves of another
    first, second = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    half = second.split()
    docs.append((1000, " ".join([*half[:6], first, *half[6:]])))
    both = [*items, (500, first), (501, second)]
    d, it = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(both, "item_id BIGINT, text STRING")
    clean = lambda n: sorted((r.doc_id, r.text, r.removed) for r in remove_leaks(d, it, most_coverage=1.0, block_words=n).filter("text IS NOT NULL").collect())
    whole = clean(100_000)
    assert dict((k, t) for k, t, _ in whole)[1000].strip() == "" and clean(1) == clean(70) == whole


def check_pieces(text, got, limit, overlap):
    enc = encoding()
    last, out = 0, ""
    for k, r in enumerate(got):
        assert (r.piece, r.n_pieces) == (k + 1, len(got)) and text[r.start : r.stop] == r.piece_text and r.start <= last
        assert r.n_tokens == len(enc.encode_ordinary(r.piece_text)) <= limit
        if k:
            assert 0 < last - r.start and len(enc.encode_ordinary(text[r.start : last])) <= overlap + 8
        out += text[last : r.stop]
        last = r.stop
    assert out == text


def test_pieces_of_all_kinds_of_text(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefé", k=rnd.randint(1, 9)))
    plain = lambda n: " ".join(word() + rnd.choice(["", "", "", ".", "\n", "\n\n", " \n \n  "]) for _ in range(n))
    texts = [plain(3000), plain(40), "mot " * 4000, "x" * 20_000, "日本語テキスト" * 2000, "é" * 9000, "\n" * 5000, "👍" * 3000, " " * 9000, "a.b" * 6000, "".join(rnd.choices("ab1 \n.!é日👍", k=12_000)), "phrase courte. " * 1500]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(100, None, 1), (101, "", 1), (102, "court", 1), (None, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, classes INT").repartition(4)
    by = {}
    for r in P.split_oversized(df, limit=400, overlap=40).orderBy("doc_id", "piece").collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {*range(len(texts)), 102, None}
    for d, t, _ in rows:
        if t:
            check_pieces(t, by[d], 400, 40)
    assert len(by[0]) > 10 and len(by[1]) == 1 and len(by[102]) == 1
    ends = [r.piece_text[-1] for r in by[0][:-1]]
    assert all(e in "\n." or e == " " for e in ends)  # paragraphs and lines are everywhere
    assert {r.piece_text.rstrip()[-1] for r in by[11]} == {"."}
    assert P.split_oversized(df.limit(0)).count() == 0


def test_repeated_rows_give_the_pieces_of_each(spark):
    df = spark.createDataFrame([(1, "mot " * 900), (1, "mot " * 900)], "doc_id BIGINT, text STRING")
    out = P.split_oversized(df, limit=400, overlap=40).collect()
    assert len(out) == 2 * max(r.n_pieces for r in out)
