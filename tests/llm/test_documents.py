"""Token counts, cutting, packing and mixing against plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from strataloom.llm import mixing, packing, pieces
from strataloom.llm.tokens import counter

DOC = "doc_id long, text string, source string, title string, n_tokens long, block long"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, s, None, 1, 1) for i, (t, s) in enumerate(rows)], DOC)


@given(st.text(alphabet="ab1 \n\t\r'.\u3000sé中\x1c\x85", max_size=20))
@settings(max_examples=400, deadline=None)
def test_counts_are_the_tokenizers(text):
    k = counter()
    assert k.count(text) == int(k.atoms(text)[1].sum()) == len(k.encoding.encode_ordinary(text))


TEXTS = ["word " * 3000, "A sentence here. " * 400, "# Head\n\ntext text\n\n" * 300, "x" * 9000, "中文句子没有空格。" * 700, "line\r\n" * 2500, "é" * 5000, "a" * 4000 + " b" * 1500, "\n" * 5000, "<|endoftext|>" * 900]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces(text):
    k = counter()
    found, total = pieces.Cutter(k).pieces(text)
    assert total == len(k.encoding.encode_ordinary(text))
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert "".join(text[max(a, e):b] for (a, b, *_), e in zip(found, [0, *(x[1] for x in found)])) == text
    for n, (a, b, tokens, shared) in enumerate(found):
        assert tokens == len(k.encoding.encode_ordinary(text[a:b])) <= 1024
        assert n == 0 or found[n - 1][0] < a <= found[n - 1][1] < b
        assert shared <= 128


def test_pieces_prefer_sections():
    text = ("# Head\n\n" + "some words in a paragraph. " * 130 + "\n\n") * 4
    found, _ = pieces.Cutter(counter()).pieces(text)
    assert sum(text[b:].lstrip().startswith("# Head") or b == len(text) for _, b, *_ in found) >= 3


def test_cut_operator(spark):
    rows = docs(spark, (None, "s"), ("", "s"), ("short", None), ("word " * 1500, "s"))
    found = {}
    for r in pieces.cut_documents(rows).orderBy("piece_no").collect():
        found.setdefault(r.doc_id, []).append(r)
    assert [len(found[i]) for i in range(4)] == [1, 1, 1, 2] and found[0][0].text is None and found[1][0].text == ""
    assert [r.doc_id for r in pieces.oversized(rows).collect()] == [3]
    assert pieces.oversized(docs(spark)).count() == 0
    with pytest.raises(ValueError):
        pieces.Cutter(counter(), 100, 60)


@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 100)), max_size=60))
@settings(max_examples=80, deadline=None)
def test_blocks_keep_all_limits(items):
    tokens = np.array([a for a, _ in items], np.int64)
    loss = np.array([min(a, b) for a, b in items], np.int64)
    where = packing.pack_block(tokens, loss, (100, 7, 90 if (loss <= 90).all() else 100))
    for k in set(where.tolist()):
        assert tokens[where == k].sum() <= 100 and (where == k).sum() <= 7 and loss[where == k].sum() <= 100


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 2048, 5000)
    where = packing.pack_block(tokens, tokens, (2048, 256, 2048))
    assert where.max() + 1 <= 1.03 * tokens.sum() / 2048 + 1 or where.max() + 1 <= (tokens > 1024).sum() + 2


def test_containers(spark):
    rows = docs(spark, (None, "s"), ("", "s"), ("word " * 5000, "s"), *(("a few words " * (i % 40), "s") for i in range(300)))
    placed = packing.containers(rows).collect()
    count = {i: counter().count(r.text) for i, r in enumerate(rows.orderBy("doc_id").collect())}
    by_doc, by_box = {}, {}
    for r in placed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_box.setdefault(r.container, []).append(r)
    assert {d: sum(r.n_tokens for r in rs) for d, rs in by_doc.items()} == count
    assert all(len(rs) == 1 for d, rs in by_doc.items() if count[d] <= 2048)
    for rs in by_box.values():
        assert sum(r.n_tokens for r in rs) == rs[0].used <= 2048 and len(rs) == rs[0].segments <= 256
    assert len(by_box) <= -(-sum(count.values()) // 2048) + 2
    assert packing.containers(docs(spark)).count() == 0


def sources(*rows):
    return [mixing.Source(str(i), w, cap, t, 10) for i, (w, cap, t) in enumerate(rows)]


def test_exponents():
    s = sources((0.5, 2, 100), (0.5, 2, 900))
    assert mixing.exponent_for(s, mixing.entropy([0.5, 0.5])) == 1.0
    a = mixing.exponent_for(s)
    w = mixing.weights_at(s, a)
    assert 0 < a < 1 and w[0] * 1000 == pytest.approx(200, abs=1e-6)
    assert mixing.weights_at(s, 0.0) == pytest.approx([0.1, 0.9])
    half = mixing.exponent_for(s, (mixing.entropy([0.1, 0.9]) + mixing.entropy([0.5, 0.5])) / 2)
    assert 0 < half < 1


def test_mix(spark):
    rng = random.Random(1)
    rows = [(" ".join("word" for _ in range(rng.randrange(1, 60))), s) for s, n in (("big", 400), ("mid", 60), ("tiny", 5)) for _ in range(n)]
    rows += [(None, "mid"), ("other words", None), ("other words", "untargeted")]
    targets = spark.createDataFrame([("big", 0.4, 2, "x"), ("mid", 0.4, 6, "x"), ("tiny", 0.2, 3, "x"), ("none", 0.0, 1, "x"), (None, 0.1, 1, "x")], "source string, weight double, max_repeats int, n_tokens string")
    mix = mixing.mixed(docs(spark, *rows), targets)
    uses = mix.uses.collect()
    assert len({r.doc_id for r in uses}) == len(uses) == 466
    cap = {"big": 2, "mid": 6, "tiny": 3}
    assert all(0 <= r.uses <= cap[r.source] for r in uses)
    total = sum(r.n_tokens for r in uses)
    shares = {r.source: r for r in mix.shares.collect()}
    for s, w in (("big", 0.4), ("mid", 0.4)):
        assert abs(shares[s].actual_tokens - w * total) <= 60 and not shares[s].short
        assert shares[s].actual_tokens == sum(r.n_tokens * r.uses for r in uses if r.source == s)
    assert shares["tiny"].short and all(r.uses == 3 for r in uses if r.source == "tiny")
    assert shares["none"].actual_tokens == 0
    assert [r.source for r in mixing.short_sources(docs(spark, *rows), targets).collect()] == ["tiny"]
    assert not any(r.short for r in mixing.mixed(docs(spark, *rows), targets, tempered=True).shares.collect())
    empty = mixing.mixed(docs(spark), targets)
    assert empty.uses.count() == 0 and empty.shares.count() == 4


def test_a_source_without_tokens_keeps_its_weight(spark):
    documents = docs(spark, *[("word " * 1000, s) for s in "abc" for _ in range(3)], (None, "d"), ("", "d"))
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.05, 1), ("c", 0.03, 1), ("d", 0.02, 1)], "source string, weight double, max_repeats int")
    assert sorted(r.source for r in mixing.short_sources(documents, targets).collect()) == ["a", "d"]
    mix = mixing.mixed(documents, targets)
    shares = {r.source: r for r in mix.shares.collect()}
    total = sum(r.tokens for r in shares.values())
    assert {s: r.target_tokens for s, r in shares.items()} == pytest.approx({s: w * total for s, w in (("a", 0.9), ("b", 0.05), ("c", 0.03), ("d", 0.02))})
    assert {s for s, r in shares.items() if r.short} == {"a", "d"} and {r.exponent for r in shares.values()} == {1.0}


def test_queries_run(spark, small):
    from strataloom.llm.queries import QUERIES

    for name in ("p1_found", "p4_found", "p5_rates", "p6_fills", "p7_shares", "p8_found"):
        assert QUERIES[name](spark, small).count() >= 1


def test_limits_are_bisected_to_where_a_cap_yields_the_weight():
    rng = random.Random(4)
    for _ in range(200):
        s = sources(*((rng.random(), rng.choice([None, 1, 2, 5]), rng.choice([0, rng.randrange(1, 9999)])) for _ in range(rng.randrange(1, 7))))
        whole = sum(x.weight for x in s)
        for x in s:
            x.weight /= whole
        total = sum(x.tokens for x in s)
        for i, (x, a) in enumerate(zip(s, mixing.limit_exponents(s))):
            assert (a < 1.0) == (x.cap is not None and x.weight * total > x.cap * x.tokens)
            if x.tokens and 0 < a < 1.0:
                assert mixing.weights_at(s, a)[i] * total == pytest.approx(x.cap * x.tokens, rel=1e-6)


def test_an_empty_source_is_short_and_the_rest_keeps_its_targets():
    s = sources((0.2, 1, 100), (0.5, 5, 50), (0.3, 1, 0))
    assert mixing.limit_exponents(s) == [1.0, 1.0, 0.0]
    assert mixing.weights_at(s, 1.0) == pytest.approx([0.2, 0.5, 0.3])
    assert mixing.weights_at(s, 0.0)[2] == 0.3


def test_turns_that_ask_bear_no_loss():
    k = counter()
    text = "Q: How many?\nA: Three of them.\n\n@asker: Why: because?\nIndex: So."
    loss = k.count("\nA: Three of them.") + k.count("\nIndex: So.")
    assert packing.parts_of(text, None, k, 2048, 2048) == [(k.count(text), loss)]
    assert packing.parts_of("Title\n\nBody text", "Title", k, 2048, 2048) == [(k.count("Title\n\nBody text"), k.count("\n\nBody text"))]
    assert packing.parts_of("No turns here? None.", None, k, 2048, 2048)[0][1] == k.count("No turns here? None.")
    assert packing.parts_of(None, None, k, 8, 8) == [(0, 0)]
    long = "Q: " + "what " * 30 + "?\nA: " + "that " * 30
    parts = packing.parts_of(long, None, k, 16, 16)
    assert sum(a for a, _ in parts) == k.count(long) and all(b <= a <= 16 for a, b in parts)
    assert sum(b for _, b in parts) == packing.parts_of(long, None, k, 2048, 2048)[0][1]


def test_every_limit_can_bind(spark):
    rows = docs(spark, *[("word", "s")] * 200, *[("Q: " + "what " * 60 + "?\nA: " + "that " * 30, "s")] * 40)
    boxes = {r.container: r for r in packing.containers(rows, 512, 16, 100).collect()}
    assert all(r.used <= 512 and r.segments <= 16 and r.loss <= 100 for r in boxes.values())
    assert any(r.segments == 16 for r in boxes.values()) and any(r.loss > 60 and r.used < 400 for r in boxes.values())


def test_what_is_too_large_is_split_by_the_next_finer_kind():
    small, large = "few words here.\n\n", "\n\n".join("some words in one paragraph " * 40 + "end." for _ in range(12))
    text = f"# A\n\n{small}# B\n\n{large}\n\n# C\n\n{small}# D\n\n{small}"
    found, _ = pieces.Cutter(counter()).pieces(text)
    ends = [text[b:].lstrip()[:3] for _, b, *_ in found]
    # The large section is cut at its paragraphs, and what is around it stays together.
    assert ends[0] == "# B" and ends[-2] == "# C" and ends[-1] == ""
    assert all(e == "som" for e in ends[1:-2]) and len(ends) >= 5
    for (a, b, tokens, shared), (c, *_) in zip(found, found[1:]):
        assert tokens <= 1024 and c <= b
