"""Tokenising, leaks and shared spans."""

import json
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duelframe.llm import leaks, spans, tokenizer

tiktoken = pytest.importorskip("tiktoken")
ODD = [None, "", " ", "\n\n  x", "a\x00b", "<|endoftext|> hi", "né é", "🙂👩‍👩‍👧", "日本語 １２3", "a" * 20_000, "　ｘ\r\n\t", "it's they'll I'd", "  many   spaces  "]


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.Encoder(tokenizer.model_bytes())


@pytest.fixture(scope="module")
def public():
    vocab = json.load(open(tokenizer.VOCABULARY))["model"]["vocab"]
    back = {ord(c): i for i, c in enumerate(tokenizer.byte_alphabet())}
    ranks = {p.translate(back).encode("latin-1"): i for p, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, text):
    b = encoder.packed([text])[0]
    return list(struct.unpack(f"<{len(b) // 4}i", b))


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_public_encoder_and_decode(encoder, public, text):
    got = ids(encoder, text)
    assert got == (public.encode_ordinary(text) if text else [])
    assert encoder.decode(got) == (text or "")


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_ids_of_any_text(encoder, public, text):
    assert ids(encoder, text) == public.encode_ordinary(text)


def test_corpus_rows(spark, public):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, "x"), (6, ODD[6], "x"), (None, "k", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokenizer.encode_corpus(df).collect()}
    assert len(got) == tokenizer.encode_corpus(df).count() == len(ODD) + 1
    assert got == {**{i: public.encode_ordinary(t) if t else [] for i, t in enumerate(ODD)}, None: public.encode_ordinary("k")}
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0


def test_vocabulary_must_be_complete(tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 2}}}))
    with pytest.raises(ValueError):
        tokenizer.model_bytes(str(tmp_path / "v.json"))


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def brute(docs, items, m=12):
    out = set()
    for d, t in docs:
        w = leaks.words(t)
        runs = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        for k, q, *_ in items:
            v = leaks.words(q)
            if any(tuple(v[i : i + m]) in runs for i in range(len(v) - m + 1)):
                out.add((d, k))
    return out


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(*x, "4")[:3] for x in items], "item_id bigint, text string, answer string")
    rows = leaks.find_leaks(d, i).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): r for r in rows}


def test_leaks_edges(spark):
    exact = " ".join(ITEM.split()[:12])
    docs = [(1, f"x {exact.upper()} y"), (2, " ".join(ITEM.split()[:11])), (3, None), (4, ""), (5, exact.replace(" ", " -- \n> ")), (6, "one " * 50), (1, f"x {exact.upper()} y"), (7, "ẃord " * 3000 + ITEM + " 4 " + "tail " * 3000), (8, exact.replace("five", "fïvé"))]
    items = [(10, ITEM), (11, "too short"), (12, None), (13, ITEM + " fifteen")]
    got = found(spark, docs, items)
    assert set(got) == {(d, k) for d in (1, 5, 7, 8) for k in (10, 13)} == brute(docs, [i for i in items if i[1]])
    assert got[7, 10].shared_words == 14 and got[7, 10].answer_follows and not got[1, 10].answer_follows
    assert found(spark, [], items) == {} and found(spark, docs, []) == {}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 30)))) for i in range(30)]
    docs = []
    for d in range(60):
        parts = [rng.choice(words) for _ in range(rng.randrange(0, 200))]
        source = rng.choice(items)[1].split()
        at, n = rng.randrange(len(source)), rng.randrange(5, 20)
        cut = rng.randrange(len(parts) + 1)
        docs.append((d, " ".join(parts[:cut] + source[at : at + n] + parts[cut:])))
    assert set(found(spark, docs, items)) == brute(docs, items)


def shares(a, b, n=300):
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in grams for i in range(len(b) - n + 1))


def span_pairs(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return sorted((r.doc_id_a, r.doc_id_b) for r in spans.shared_span_pairs(df).collect())


def noise(rng, n):
    return "".join(rng.choice("abcdefghij klmnö") for _ in range(n))


def test_spans_edges(spark):
    rng = random.Random(1)
    p, q, whole = noise(rng, 300), noise(rng, 299), noise(rng, 900)
    docs = [(1, noise(rng, 50) + p), (2, p + noise(rng, 10)), (3, noise(rng, 9) + q), (4, q + noise(rng, 99)), (5, None), (6, ""), (7, "x" * 299), (8, "x" * 299), (9, whole), (10, whole), (2, None), (11, " " * 5000), (12, "y" * 10 + " " * 300), (13, "é" * 300), (14, "é" * 300)]
    docs = [d for d in docs if d != (2, None)] + [docs[0]]
    assert span_pairs(spark, docs) == [(1, 2), (9, 10), (11, 12)]
    assert span_pairs(spark, []) == []


def test_spans_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(spans, "BLOCK_TEXTS", 3)  # so that small groups are split into cells
    common = noise(rng, 320)
    docs = []
    for d in range(40):
        t = noise(rng, rng.randrange(0, 500))
        if d % 3 == 0:
            t += common[: rng.choice([299, 300, 310, 320])] + noise(rng, 40)
        elif docs and rng.random() < 0.6:
            o = rng.choice(docs)[1]
            at = rng.randrange(len(o) + 1)
            t += o[at : at + rng.choice([250, 300, 350])] + noise(rng, 5)
        docs.append((d, t))
    docs += [(100 + i, docs[3][1] + common) for i in range(5)]
    want = [(a, b) for a, x in docs for b, y in docs if a < b and shares(x, y)]
    assert span_pairs(spark, docs) == want


def test_long_texts_go_in_pieces(monkeypatch):
    rng = random.Random(2)
    t = noise(rng, 9000)
    whole = {(int(p), int(h)) for _, p, h in zip(*spans.seeds_of([t], 128, 300))}
    monkeypatch.setattr(spans, "PIECE", 1000)
    assert {(int(p), int(h)) for _, p, h in zip(*spans.seeds_of([t], 128, 300))} == whole


def test_shared_share(spark):
    rng = random.Random(3)
    p, q = noise(rng, 400), noise(rng, 350)
    docs = [(1, p + noise(rng, 100) + q), (2, p), (3, q + "!"), (4, noise(rng, 500)), (5, p)]
    got = {r.doc_id: r for r in spans.shared_share(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1].shared_chars in range(750, 760) and got[1].n_texts == 2 and got[2].shared_share == 1.0 and got[2].n_copies == 1 and got[3].shared_chars >= 350


def test_chain_follows_order_and_gaps():
    best = spans.chain([(0, 0, 100), (110, 112, 100), (500, 50, 100), (260, 260, 100)])
    assert best[0][1] == [0, 1, 3] and sorted(x for _, path in best for x in path) == [0, 1, 2, 3]
    assert spans.chain([(0, 0, 10), (10_000, 10_000, 10)])[0][1] in ([0], [1])


@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
@settings(max_examples=200, deadline=None)
def test_edits_equal_the_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, x, b, i)
    assert spans.edits(a, b) == row[-1]


def _next_row(before, x, b, i):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row


def test_fuzzy_passages(spark):
    rng = random.Random(11)
    p = noise(rng, 1500)
    typed = p[:400] + "XX" + p[402:800] + p[810:]  # two letters changed, ten left out
    docs = [(1, noise(rng, 80) + p), (2, typed + noise(rng, 60)), (3, typed + "!"), (4, typed + "!"), (5, noise(rng, 900)), (6, None), (7, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id_a, r.doc_id_b): r for r in spans.fuzzy_passages(df).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)} or set(map(tuple, map(sorted, got))) == {(1, 2), (1, 3), (2, 3)}
    row = next(r for k, r in got.items() if set(k) == {1, 2})
    a, b = ("a", "b") if row.doc_id_a == 1 else ("b", "a")
    assert (row[f"start_{a}"], row[f"end_{a}"], row[f"start_{b}"], row[f"end_{b}"]) == (80, 1580, 0, 1490) and row.same_share == pytest.approx(1 - 12 / 1500, abs=1e-6)
    assert spans.fuzzy_passages(df.limit(0)).count() == 0


def test_every_copy_of_a_passage_is_counted(spark):
    draw = random.Random(3)
    some = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    passage = some(320)
    docs = [(1, "".join(some(50) + "#" + passage + "!" for _ in range(6))), (2, "?" + passage + "."), (3, " " * 5000), (4, " " * 300)]
    got = {r.doc_id: r.shared_chars for r in spans.shared_share(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: 6 * 320, 2: 320, 3: 5000, 4: 300}
