"""Texts longer than a slice give the same as if they were turned into arrays at once."""

import numpy as np
import pytest

from lobbylens.llm import common, language, quality
from lobbylens.llm.common import word_hashes
from tests.llm import corpus as c

SIZE = 1 << 20


def long_text(kind):
    """About 3 MB with a word, a trigram or a run of letters across the border of the first slice."""
    rng = c.rng(17)
    words = [rng.choice("abcdefghij") * rng.randrange(1, 9) + rng.choice("XYZ,.0") for _ in range(900)]
    filler = " ".join(rng.choice(words) for _ in range(500_000))[: 3 * SIZE]
    middle = {"word": " straddling ", "trigram": "...xyz...", "letters": "été日本語говорит한국어été", "one": "w" * (SIZE + 5000)}[kind]
    raw = middle.encode()
    cut = SIZE - len(raw) // 2
    return filler[:cut].encode() + raw + filler[cut:].encode()


@pytest.mark.parametrize("kind", ["word", "trigram", "letters", "one"])
def test_slices(monkeypatch, kind):
    text = long_text(kind)
    got = word_hashes(text, lower=True), language.features(text), quality.features(text)
    words = text.lower().split()
    sample = np.random.default_rng(1).integers(0, len(words), 300)
    assert got[0].size == len(words) and all(word_hashes(words[i])[0] == got[0][i] for i in sample)
    monkeypatch.setattr(common, "SLICE_BYTES", 1 << 30)
    monkeypatch.setattr(language, "_SLICE", 1 << 30)
    monkeypatch.setattr(quality, "_SLICE", 1 << 30)
    whole = word_hashes(text, lower=True), language.features(text), quality.features(text)
    assert all(np.array_equal(a, b) for a, b in zip(got, whole))


def test_votes_by_hand():
    """The score is the share of votes of the nearest vectors by exact cosine, weighted by similarity and label shares."""
    rng = c.rng(19)
    texts = [c.sentence(rng, rng.randrange(5, 60), 300 if i % 3 else 40).encode() for i in range(160)]
    labels = np.asarray([int(i % 3 > 0) for i in range(160)])
    x = np.vstack([quality.features(t) for t in texts]).astype(np.float32)
    model = quality.fit(x, labels, 0.4)
    new = np.vstack([quality.features(c.sentence(rng, 30, 60).encode()) for _ in range(25)])
    got = model.scores(new)
    for row, score in zip(model.latent(new), got):
        votes = sorted(
            ((float(row @ v) / float(np.linalg.norm(row) * np.linalg.norm(v)), i) for i, v in enumerate(model.vectors)), reverse=True
        )[: quality.NEIGHBOURS]
        share = labels.mean()
        weights = [max(cosine, 1e-3) ** quality.SHARPNESS * (0.4 / share if labels[i] else 0.6 / (1 - share)) for cosine, i in votes]
        expected = sum(w * labels[i] for w, (_, i) in zip(weights, votes)) / sum(weights)
        assert abs(expected - score) < 1e-3
