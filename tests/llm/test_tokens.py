"""Token files, packing and token counts against the tokenizers library."""

import random

import numpy as np
import pytest

from lobbylens.llm.packing import pack, plan_slots, sequences
from lobbylens.llm.tokenfiles import token_files
from lobbylens.llm.tokens import Encoder, vocabulary
from lobbylens.llm.viterbi import Unigram, piece_vocabulary, token_counts, unigram
from tests.llm import corpus as c

ODD = [
    "", " ", "  ", "a  b", "a \n b", "\n\n", "\n", "x\x0by\x0cz", "é ́a", "  lead trail  ", "don't  'S 12 34", "a\n\n b",
    "<|endoftext|> a", "a b 　c", "\x1c \x1d a", "İ Σ ς", "a‍ b", "a\t\tb \r\n c", " \n", "\n a\n \n b", "日本 語 123",
    "🙂 🙂🙂", "word, Word. WORD!! w$$$\nNext line, x | y\n", "été\nÉté, ëë", "a_b a-b (c) [d] {e} `f` ~g", "ﬁ ½ ² Ⅷ",
]


def texts():
    rng = c.rng(4)
    return ODD + [t for _, t in c.awkward(rng) + c.near_copies(rng) if t is not None]


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_cached_ids_are_the_tokenizers(name, words):
    coder = Encoder(vocabulary(name), words)
    for text in texts() * 2:
        direct = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == direct, repr(text[:60])


def test_token_files_round_trip(spark):
    rows = c.awkward(c.rng(4))
    coder = Encoder(vocabulary("byte_bpe_50k.json"), False)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, at = [], 0
    for doc_id, text in ordered:
        ids = [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((doc_id, at, len(ids), c.crc(ids)))
        at += len(ids)
    c.same(token_files(c.frame(spark, rows)), expected, ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert token_files(c.frame(spark, rows).limit(0)).count() == 0


def test_pack(spark):
    rows = [r for r in c.awkward(c.rng(4)) if r[0] is not None]
    rows = list(dict(rows).items()) + [(1000 + i, c.sentence(c.rng(i), i % 37 * 20)) for i in range(120)]
    df = c.frame(spark, rows)
    coder = Encoder(vocabulary("word_bpe_49k.json"), True)
    ids = {d: [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    packed = pack(df)
    pieces = packed.collect()
    for p in pieces:
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == c.crc(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]])
    for doc_id, all_ids in ids.items():
        own = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == doc_id)
        assert [s for s, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) == len(all_ids)
    for number in {p["sequence_id"] for p in pieces}:
        own = sorted((p["offset"], p["length"]) for p in pieces if p["sequence_id"] == number)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 4096
    total = sum(len(x) for x in ids.values())
    assert len({p["sequence_id"] for p in pieces}) <= -(-total // 4096) + 1
    whole = {r["sequence_id"]: r["ids"] for r in sequences(df, packed).collect()}
    for p in pieces:
        got = whole[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]]
        assert got == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
    assert pack(df.limit(0)).count() == 0


def test_pack_with_nulls_and_repeated_rows(spark):
    rows = c.awkward(c.rng(4))
    pieces = pack(c.frame(spark, rows)).collect()
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)
    assert sum(p["start"] == 0 for p in pieces) == len(rows)


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    histogram = {rng.randrange(1, 65): rng.randrange(1, 50) for _ in range(40)}
    slots = plan_slots(histogram, 64)
    ranks = sorted(r for length, lo, hi, _, _ in slots for r in range(lo, hi))
    assert ranks == list(range(sum(histogram.values())))
    fill = {}
    for length, lo, hi, first, offset in sorted(slots, key=lambda s: s[4]):
        for k in range(hi - lo):
            assert fill.get(first + k, 0) == offset
            fill[first + k] = offset + length
    assert max(fill.values()) <= 64
    assert sum(fill.values()) / (64 * len(fill)) > 0.9


def test_viterbi_counts_are_the_tokenizers(spark):
    from tokenizers import Tokenizer, models

    vocab = piece_vocabulary(vocabulary("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    extra = ["<s> </s> <0x41>", "▁▁a▁b", "x͸ ͹͸y", "\t\t   b    c  "]
    rows = list(enumerate([*texts(), *extra]))
    expected = []
    for i, text in rows:
        n = len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0
        expected.append((i, len(text), n))
    rows.append((None, None))
    expected.append((None, 0, 0))
    c.same(token_counts(c.frame(spark, rows)), expected, ["doc_id", "n_chars", "n_pieces"])
    assert token_counts(c.frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_ties(seed):
    """Few scores over a small alphabet: many equal paths, unknown runs, with and without bytes."""
    from tokenizers import Tokenizer, models

    rng = random.Random(seed)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(14)}
    vocab = [("<unk>", 0.0), ("▁", -3.0)] + [(p, -float(rng.randrange(1, 4))) for p in sorted(pieces)]
    if seed % 2:
        vocab += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=bool(seed % 2)))
    own = Unigram(vocab, byte_fallback=bool(seed % 2))
    for _ in range(300):
        text = "".join(rng.choice("abcd é") for _ in range(rng.randrange(1, 16)))
        direct = library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids
        assert own.count(text)[1] == len(direct), text


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_of_trained_vocabularies(seed):
    """Log probabilities, pieces across spaces, no space mark: one pass, as the tokenizers library adds up."""
    from tokenizers import Tokenizer, models

    rng = random.Random(seed)
    pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 6))) for _ in range(40)} | {"a", "b"}
    if seed % 3:
        pieces.add("▁")
    scores = [float(np.float32(-rng.expovariate(0.2))) for _ in range(7)]
    vocab = [("<unk>", 0.0)] + [(p, rng.choice(scores)) for p in sorted(pieces)]
    if seed % 2:
        vocab += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=bool(seed % 2)))
    own = Unigram(vocab, byte_fallback=bool(seed % 2))
    assert not own.cuts
    for n in [*[14] * 200, 5000]:
        text = "".join(rng.choice("abcabcd é") for _ in range(rng.randrange(1, n)))
        direct = library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids
        assert own.count(text)[1] == len(direct), text[:50]
    assert own.count("") == (0.0, 0)


def test_texts_are_cut_under_forbidding_scores():
    """The public vocabulary holds runs of spaces at minus a billion; before, that kept every text in one slow pass."""
    own = unigram(vocabulary("piece_bpe_32k.model"), True)
    assert own.cuts and own.runs and min(score for _, score in piece_vocabulary(vocabulary("piece_bpe_32k.model"))) < -1e8
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice("   abet<\u2581\u4e00\U0001f600\x07\u00e9\n\t.,'") for _ in range(rng.randrange(1, 60)))
        assert own.count(text) == own.whole("\u2581" + text.replace(" ", "\u2581")), text
    own = Unigram([("<unk>", 0.0), ("\u2581", -(2.0**48)), ("a", -1.0), ("\u2581a", -3.0)], byte_fallback=False)
    assert own.cuts and own.count("a " * 40) == own.whole("\u2581" + "a\u2581" * 40) and not own.cache


def test_kept_words_are_bounded(spark):
    """The ids are the same however few words are kept; fewer are learnt again with more room."""
    rng = c.rng(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    said = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(400)]
    learnt = {}
    for room in (40, 400):
        coder = Encoder(vocabulary("byte_bpe_50k.json"), False, room)
        letters, seen = coder.letters, []
        coder.letters = lambda runs: seen.extend(runs) or letters(runs)
        for text in said:
            assert np.frombuffer(coder.ids(text), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
            assert len(coder.cache) <= room + 12
        learnt[room] = len(seen)
    assert learnt[400] < learnt[40] / 3
    rows = list(enumerate(said))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    few, many = (sorted(map(repr, pack(c.frame(spark, rows), cache_words=n).select(*columns).collect())) for n in (20, 100_000))
    assert few == many
