import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import packing, tokens
from tessella.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text, add_special_tokens=False).ids


ALPHABET = st.sampled_from(list("abcXYZ 019_.,'\n\t\r-éßñ漢あЖΩ") + ["'s", "'ll", " '", "  ", "<|endoftext|>", "²", "½", "\x1c", "\x85", "\xa0", "　", "🙂", "́", "Ⅷ", "٣"])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join))
def test_ids_equal_the_library(library, text):
    (got,) = tokens.encoder(vocabulary()).ids([text])
    assert np.frombuffer(got, "<u4").tolist() == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(library, text):
    (got,) = tokens.encoder(vocabulary()).ids([text])
    assert np.frombuffer(got, "<u4").tolist() == library(text)


def test_safe_alphabet_agrees_character_by_character(library):
    enc = tokens.encoder(vocabulary())
    safe = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and not tokens._UNSAFE.search(chr(i))]
    probes = [f"a{c}b 1{c}2 {c} {c}{c}." for c in safe[:: max(1, len(safe) // 3000)] + safe[:500]]
    for text, got in zip(probes, enc.ids(probes), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library(text), text


def test_counts(hard, empty, library):
    rows = tokens.count_tokens(hard, vocabulary()).collect()
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library(r["text"] or ""))) for r in hard.select("doc_id", "text").collect())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert tokens.count_tokens(empty, vocabulary()).count() == 0


def scalar_best_fit(lengths, window):
    """Plain best-fit decreasing, a list scan instead of a tree: how many windows, and what they leave open."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [c for c in room if c >= n]
        best = min(fits) if fits else window
        if fits:
            room.remove(best)
        room.append(best - n)
    return len(room), sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    hist = defaultdict(int)
    for n in lengths:
        hist[n] += 1
    slots, windows = packing.plan_packing(dict(hist), 40)
    used = defaultdict(list)
    for n, mine in slots.items():
        ranks = iter(range(hist[n]))
        for k, s in enumerate(mine):
            end = mine[k + 1].base if k + 1 < len(mine) else hist[n]
            for d in range(end - s.base):
                assert next(ranks) == s.base + d
                used[s.first + d // s.each].append((s.offset + d % s.each * n, n))
        assert next(ranks, None) is None
    room = []
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 40
        room.append(40 - at)
    assert set(used) == set(range(windows))
    assert (windows, sorted(room)) == scalar_best_fit(lengths, 40)


@given(st.lists(st.integers(0, 30), max_size=20), st.integers(0, 30))
def test_tree_finds_the_tightest(present, least):
    tree = packing.CapacityTree(30)
    for c in present:
        tree.set(c, True)
    assert tree.tightest(least) == min((c for c in present if c >= least), default=None)


def check_packing(rows, docs, library):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    want = defaultdict(list)
    for i, t in docs:
        ids = np.array([*library(t or ""), 1], "<u4")
        want[i] += [(s, len(c), zlib.crc32(c.tobytes()), len(ids)) for s in range(0, len(ids), 2048) for c in [ids[s : s + 2048]]]
    assert {k: sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences)


def test_packing_hard(hard, empty, library):
    rows = packing.pack_documents(hard, vocabulary()).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()], library)
    assert packing.pack_documents(empty, vocabulary()).count() == 0


def test_packing_documents(documents, texts, library):
    rows = packing.pack_documents(documents, vocabulary()).collect()
    n = check_packing(rows, list(texts.items()), library)
    assert n * 2048 < 1.05 * sum(r["length"] for r in rows) + 2048


LONG = st.lists(st.sampled_from([*"abcXYZ 019_.,'\n漢あ。、", " the", " ", "  ", "<|endoftext|>", "🙂", "'s", " '", "é"]), min_size=60, max_size=200).map("".join)


@settings(max_examples=200, deadline=None)
@given(LONG)
def test_parts_of_any_text_make_up_its_ids(library, text):
    parts = tokens.safe_parts(text, 8)
    assert "".join(parts) == text
    assert [i for p in parts for i in library(p)] == library(text)


def test_long_texts_outside_the_alphabet_are_split(library, monkeypatch):
    seen = []
    enc2 = tokens.Encoder(vocabulary())

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            seen.append(sum(map(len, texts)))
            return self.inner.encode_batch_fast(texts, **options)

    enc2.tokenizer = Watched(enc2.tokenizer)
    unit = "The quick 🙂 brown fox, <|endoftext|> don't! 漢字、かな。"
    text = unit * (5_000_000 // len(unit))
    assert enc2.counts([text, unit]) == [len(library(unit)) * (5_000_000 // len(unit)), len(library(unit))]
    assert len(seen) > 3 and max(seen) <= tokens.BATCH_BYTES + tokens.PART_CHARS + 100


def test_a_text_of_fifty_megabytes(library):
    unit = "naïve café 🙂 and some plain words, then more of them. "
    times = 50_000_000 // len(unit.encode())
    (n,) = tokens.encoder(vocabulary()).counts([unit * times])
    two, three = len(library(unit * 2)), len(library(unit * 3))
    assert n == two + (times - 2) * (three - two)


def test_batches_are_balanced_by_bytes():
    import pyarrow as pa

    texts = ["漢" * 100, "a" * 100, "", "é" * 400, "b" * 50]
    runs = list(tokens.balanced(pa.array(texts), 400))
    assert [(at, len(held), sum(sizes)) for at, held, sizes in runs] == [(0, 3, 400), (3, 1, 800), (4, 1, 50)]
    assert [t for _, held, _ in runs for t in held] == texts


def test_another_kind_of_vocabulary_is_left_to_its_library(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    spec = json.load(open(vocabulary(), encoding="utf-8"))
    assert tokens.follows_ranks(spec)
    changed = [dict(spec, normalizer={"type": "Lowercase"}), dict(spec, pre_tokenizer={**spec["pre_tokenizer"], "add_prefix_space": True})]
    changed.append(dict(spec, model=dict(spec["model"], merges=[spec["model"]["merges"][1], spec["model"]["merges"][0], *spec["model"]["merges"][2:]])))
    paths = [str(public_tokenizers.path("word_bpe_49k.json"))]
    for i, other in enumerate(changed):
        paths.append(str(tmp_path / f"{i}.json"))
        json.dump(other, open(paths[-1], "w"))
    for path in paths:
        enc = tokens.Encoder(path)
        assert enc.compiled is None
        own = Tokenizer.from_file(path)
        for text in ("Hello World, there's more", " a  B\n c", "x " * 70_000):
            assert enc.counts([text]) == [len(own.encode(text, add_special_tokens=False))]


def test_queries_of_tokens_and_packing(spark, texts, library):
    from tessella.llm.queries import op3_packing, op6_token_counts

    sf = "/root/testdata/sf0.001"
    counts = {r["doc_id"]: r for r in op6_token_counts(spark, sf).collect()}
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in counts.items()} == {i: (len((t or "").encode()), n, n > 1024) for i, t in texts.items() for n in [len(library(t or ""))]}
    check_packing(op3_packing(spark, sf).collect(), list(texts.items()), library)
