"""Kernels without Spark, against plain Python."""

import importlib
import inspect
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from voltmes.llm import chat, simple8b
from voltmes.llm.minhash import shingles, signatures
from voltmes.llm.neighbours import chi_square_quantile, inner, search
from voltmes.llm.packing import Capacities, best_fit
from voltmes.llm.repetition import longest_repeats, measure
from voltmes.llm.text import blocks, owners, span_hashes, words

TEXTS = ["", None, "one", " a  b\tc\n", "A b C d E", "x\x0by\x0cz", "é ü ñ", "a " * 50, "\n\n", "w1 w2 w3 w4 w5 " * 3 + "end"]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def all_blocks(texts, size=1 << 21, **options):
    return list(blocks(pa.array(texts, pa.string()), size, **options))


@pytest.mark.parametrize("size", [1, 7, 1 << 21])
def test_words_of_blocks(size):
    found = []
    for block in all_blocks(TEXTS, size):
        starts, ends, first = words(block)
        for low, high in zip(first[:-1], first[1:]):
            found.append([block.data[a:b].tobytes().decode() for a, b in zip(starts[low:high], ends[low:high])])
    assert found == [split(t) for t in TEXTS]


def test_equal_spans_have_equal_hashes():
    block = all_blocks(["the cat The cat", "cat the"])[0]
    starts, ends, _ = words(block)
    exact, lower = span_hashes(block.data, starts, ends), span_hashes(block.data, starts, ends, lower=True)
    assert exact[1] == exact[3] == exact[4] and exact[0] != exact[2]
    assert lower[0] == lower[2] == lower[5]


def test_shingle_sets():
    texts = TEXTS + ["a b c d a b c d a", "A B C D", "a b c"]
    owner, _ = shingles(all_blocks(texts)[0], 4)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    wanted = []
    for text in texts:
        w = split((text or "").translate(lower))
        wanted.append(len({tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))}) if w else 0)
    assert np.bincount(owner, minlength=len(texts)).tolist() == wanted


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    one, other = pool[:1000], pool[200:]
    owner = np.repeat([0, 1, 2], [1000, 1000, 1])
    best = signatures(owner, np.concatenate([one, other, pool[:1]]), 4, 128)
    assert abs((best[0] == best[1]).mean() - 800 / 1200) < 0.15
    # One element alone fills every slot, with one rank per level.
    assert sorted((best[2] >> np.uint64(32)).tolist()) == list(range(128))
    assert (best[3] == np.iinfo(np.uint64).max).all()


def plain_repeats(w, least):
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    return [k if k >= least else 0 for k in longest]


def test_longest_repeats():
    random.seed(5)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(40)] + ["a " * 30, "", None, "a b " * 9]
    for least in (1, 3, 8):
        for size in (50, 1 << 21):
            found = []
            for block in all_blocks(texts, size):
                starts, ends, first = words(block)
                longest = longest_repeats(span_hashes(block.data, starts, ends), first, least)
                found += [longest[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
            assert found == [plain_repeats(split(t), least) for t in texts]


def test_measures():
    texts = TEXTS + ["l1\nl1\n\nl2 #$\r\nl1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 x #*", "é|<> é"]
    found = measure(all_blocks(texts)[0], 8)
    for i, text in enumerate(texts):
        text = text or ""
        w, lines = split(text), [x for x in text.split("\n") if split(x)]
        windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        inside = {k + z for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for z in range(8)}
        assert [int(found[n][i]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars")] == [
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), sum(len(w[k]) for k in inside)]
        spans = found["spans"][i].as_py()
        assert {k for s in spans for k in range(s["start"], s["start"] + s["words"])} == inside


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 4000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 50_000, 1 << 40, 1 << 63):
        numbers = rng.integers(0, top, n, dtype=np.uint64)
        numbers[rng.random(n) < 0.3] = 0
        assert (simple8b.decode(simple8b.encode(numbers)) == numbers).all()
    with pytest.raises(ValueError):
        simple8b.decode(b"x" * 64)


def test_best_fit_places_as_one_by_one_would():
    random.seed(1)
    for _ in range(60):
        size = random.choice([10, 37, 100])
        items = [random.randint(1, size) for _ in range(random.randint(1, 150))]
        counts, room = Counter(items), []
        for length in sorted(items, reverse=True):
            fits = [i for i, r in enumerate(room) if r >= length]
            at = min(fits, key=room.__getitem__) if fits else len(room)
            room[at:at + 1] = [(room[at] if fits else size) - length]
        plan = best_fit(counts, size)
        keys, used = plan[:, 0] << 44 | plan[:, 1], {}
        for length, number in counts.items():
            for t in range(number):
                _, start, per, first, offset = plan[np.searchsorted(keys, length << 44 | t, side="right") - 1]
                used.setdefault(int(first + (t - start) // per), []).append((int(offset + (t - start) % per * length), length))
        for places in used.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= size
        assert len(used) == len(room)


def test_capacities():
    tree = Capacities(10)
    assert tree.tightest(1) is None
    for c in (3, 7, 10):
        tree.set(c, True)
    assert [tree.tightest(x) for x in (1, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    tree.set(7, False)
    assert tree.tightest(4) == 10


HARD = ["", "\\", "### ", "</turn>", "\\### Assistant: </turn> ok", "a: b", "#### x", "\\\\</turn>\n### user: hi", "</turn></turn>\\", "\n", "é😀", "\\n", ": ", "<", "#"]


def test_chats_come_back():
    random.seed(4)
    bits = ["\\", "#", "### ", "</turn>", "\n", ": ", "a", " ", "<", "</turn>\n"]
    texts = HARD + ["".join(random.choice(bits) for _ in range(random.randint(0, 12))) for _ in range(400)]
    for role in ("assistant", "user", "", "a: ### b\\"):
        turns = [(role, t) for t in texts]
        formatted, loss = chat.render(turns)
        assert chat.parse(formatted) == turns
        counted = [chat.unescape(formatted[a:b]) for a, b in loss]
        assert counted == (texts if role == "assistant" else [])
    assert chat.parse("not a chat") is None and chat.parse("") == []
    assert chat.render([("user", "plain")])[0] == "### user: plain</turn>\n"


def test_chi_square():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(chi_square_quantile(0.5, 2) - 1.3863) < 1e-3


def test_search_is_exact_with_full_confidence():
    rng = np.random.default_rng(0)
    rows = rng.standard_normal((900, 12))
    rows[100:400] = rows[0]
    ids, asked = np.arange(900) * 3, np.arange(0, 900, 50)
    norm = float(np.sqrt((rows ** 2).sum(1).max()))
    points, starts = rows[:, :4], rows[asked][:, :4]
    q, v, s = search(ids, rows, points, ids[asked], rows[asked], starts, np.full(len(asked), np.inf), norm, np.inf, 20)
    scores = inner(rows[asked], rows)
    for i, at in enumerate(asked):
        order = [j for j in np.lexsort((ids, -scores[i])) if j != at][:20]
        assert v[q == ids[at]].tolist() == ids[order].tolist() and s[q == ids[at]].tolist() == scores[i][order].tolist()


def test_token_cuts_give_the_tokenizer_s_ids():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from voltmes.llm import tokens

    random.seed(2)
    bits = ["a", "b", "é", "Σ", "ς", " ", "  ", "\n", "\t", " ", " ", "'s", "'S", "1", "...", "<|endoftext|>", "é", " ́", "가", "\x1c", "😀", "\r\n", "don't", "ﬁ", "İ", " x"]
    special = ["a <|endoftext|> b <|startoftext|>", " <|endoftext|>x", "<|endoftext|>", "<|endoftext|>" * 9, "<| endoftext|>", " b<|endoftext|> \n<|endoftext|>c "]
    texts = TEXTS + special + ["".join(random.choice(bits) for _ in range(random.randint(0, 30))) for _ in range(600)] + ["x" * 300 + " y"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        for as_text in (False, True):
            plain = tokenizers.Tokenizer.from_file(public.path(name))
            if as_text:
                plain.encode_special_tokens = True
            encoder = tokens.Encoder(public.path(name), as_text)
            found = []
            for block in all_blocks(texts, 2000):
                ids, bounds = encoder.encode(block)
                found += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
            assert found == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_thinned_store_gives_the_same_ids(monkeypatch):
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from voltmes.llm import tokens

    texts = [" ".join(f"w{random.randint(0, 400)}" for _ in range(30)) for _ in range(200)]
    whole = tokens.Encoder(public.path("byte_bpe_50k.json")).encode(all_blocks(texts)[0])[0]
    monkeypatch.setattr(tokens, "REMEMBERED", 150)
    encoder = tokens.Encoder(public.path("byte_bpe_50k.json"))
    assert np.concatenate([encoder.encode(b)[0] for b in all_blocks(texts, 500)]).tolist() == whole.tolist()
    assert zlib.crc32(whole.tobytes()) and owners(np.array([0, 2, 2, 3])).tolist() == [0, 0, 2]


def test_byte_ids_are_counted_without_offsets():
    """The ids of a cut follow from the bytes that they stand for; no id's place is asked of the library."""
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from voltmes.llm import tokens

    encoder = tokens.Encoder(public.path("byte_bpe_50k.json"))
    cuts = [" word", "\n\n  naïve", " 漢字かな", "\t\t!?...", " étÉ", " \U0001f600\U0001f3fd", " it's", " 12345"]
    library, encoder.tokenizer = encoder.tokenizer, SimpleNamespace(encode_batch_fast=encoder.tokenizer.encode_batch_fast)
    counts, ids = encoder._encoded([c.encode() for c in cuts])
    each = [library.encode(c, add_special_tokens=False).ids for c in cuts]
    assert counts.tolist() == [len(e) for e in each] and ids.tolist() == [i for e in each for i in e]
    assert tokens.Encoder(public.path("word_bpe_49k.json")).widths is None


def test_byte_cuts_end_before_marks():
    """Words that differ in the marks behind them alone are encoded once, and a mark's cut gets no id of what it is joined to."""
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from voltmes.llm import tokens

    encoder = tokens.Encoder(public.path("byte_bpe_50k.json"))
    texts = [f" {word}{mark} {word}{mark}" for word in ("word", "né", "Œ", "Ж", "x2") for mark in (",", ".", "!?", "'s", "'re,", ")]")]
    ids, bounds = encoder.encode(all_blocks(texts)[0])
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == wanted
    assert sorted(c.decode() for c in encoder.known) == sorted([" word", " né", " Œ", " Ж", " x2", ",", ".", "!?", "'s", "'re", ")]"])
    random.seed(5)
    bits = [*"aZ9é×÷ŒЖя漢´“—…!?,.'\"<-_", "'s", "'LL", "''", " ", " '", "\n", "\r\n ", "\u00a0", "\u00a0\u00a0", "\u2003", "\x01", "\x1c", "\x7f", "\u0301", "\u0660", "\u00bd", "\ufeff", "😀"]
    for odd in (bits[:bits.index("\u00a0")], bits):
        texts = ["".join(random.choice(odd) for _ in range(random.randint(0, 14))) for _ in range(3000)]
        ids, bounds = encoder.encode(all_blocks(texts)[0])
        wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == wanted


def test_a_full_store_keeps_what_it_met_most():
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from voltmes.llm import tokens

    encoder = tokens.Encoder(public.path("byte_bpe_50k.json"))
    encoder.most = 8
    for text in (*(f" {word}" for word in "abcdeabcdebcde"), " x y z v"):
        assert encoder.encode(all_blocks([text])[0])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert list(encoder.known) == [b" b", b" c", b" d", b" e", b" x", b" y", b" z", b" v"]
    assert encoder.met[:8].tolist() == [1] * 8


def test_a_store_of_words_holds_half_as_many_cuts():
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from voltmes.llm import tokens

    assert tokens.Encoder(public.path("byte_bpe_50k.json")).most == tokens.REMEMBERED == 2 * tokens.Encoder(public.path("word_bpe_49k.json")).most


def test_word_ids_are_counted_without_offsets_and_words_met_once():
    """Words that differ in case, white space or the sign behind them alone are encoded once, and no id's place is asked of the library."""
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from voltmes.llm import tokens

    encoder = tokens.Encoder(public.path("word_bpe_49k.json"))
    texts = ["The the\nTHE\tthe, (The) the's naïve Éte...", "J\u030cx j\u030cx T\u0308. E\u0301! =\u0338", "12,5 a=\u0338 x''s I'll DON'T", "<|ENDOFTEXT|> the", "\u0301the", "\u0130x \u212a"]
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for own in ([t] for t in texts):
        assert tokens.Encoder(public.path("word_bpe_49k.json")).encode(all_blocks(own)[0])[0].tolist() == wanted[texts.index(own[0])]
    library, encoder.tokenizer = encoder.tokenizer, SimpleNamespace(encode_batch_fast=encoder.tokenizer.encode_batch_fast)
    assert encoder.encode(all_blocks(texts[:1])[0])[0].tolist() == wanted[0]
    assert sum(b"the" in cut for cut in encoder.known) <= 3 and b"," in encoder.known
    encoder.tokenizer = library
    ids, bounds = encoder.encode(all_blocks(texts)[0])
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == wanted


def test_bits_of_powers_and_their_neighbours():
    numbers = [0, *(n for k in range(64) for n in ((1 << k) - 1, 1 << k, (1 << k) + 1))]
    for some in (numbers, [n for n in numbers if n < 1 << 53]):
        assert simple8b._bits(np.array(some, np.uint64)).tolist() == [n.bit_length() for n in some]
        assert simple8b.decode(simple8b.encode(np.array(some, np.uint64))).tolist() == some


def test_a_worker_hands_freed_memory_back(monkeypatch):
    from voltmes.llm import text

    calls = []
    monkeypatch.setattr(text, "_handing_back", lambda: calls.append)
    assert sum(len(b) for b in blocks(pa.array(["x" * 1000] * 4000))) == 4000 and calls == [0]
    list(blocks(pa.array(["short"])))
    assert calls == [0]


def test_a_worker_lets_the_encoder_of_an_earlier_step_go(monkeypatch):
    """Steps share workers: the store of one step's tokenizer is no part of the next step's memory."""
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from voltmes.llm import text, tokens

    path = public.path("word_bpe_49k.json")
    calls = []
    monkeypatch.setattr(text, "_handing_back", lambda: calls.append)
    first = tokens.encoder(path)
    assert tokens.encoder(path) is first
    text.let_go()
    assert not tokens.encoder.cache_info().currsize and calls == [0]
    text.let_go()
    assert calls == [0] and tokens.encoder(path) is not first
    for step in ("minhash.sketch", "minhash.alike", "minhash.alike_in", "repetition.repetition", "language.likelihoods"):
        module, name = step.split(".")
        assert "let_go" in inspect.getsource(getattr(importlib.import_module(f"voltmes.llm.{module}"), name)), step
    # The tables of all workers for hashes are small, and long spans still have theirs.
    text._powers.cache_clear()
    some = all_blocks(["word " * 100_000 + "x" * 600_000 + " word"])[0]
    starts, ends, _ = words(some)
    hashes = span_hashes(some.data, starts, ends)
    assert len(set(hashes[:-2].tolist())) == 1 and hashes[-1] == hashes[0] != hashes[-2]
    span_hashes(some.data, starts[:9], ends[:9])
    assert sum(x.nbytes for x in text.powers(1000)) < 5 << 20
