"""Token counts of a unigram vocabulary: Viterbi with counts alone, no pieces kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.tokens import vocabulary

SPACE = "▁"
#: An unknown character costs this much more than the worst piece (fixed by the tokenizer).
UNKNOWN_PENALTY = 10.0
#: Cached words per worker and generation.
CACHE_WORDS = 250_000
CACHE_CHARS = 48
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_PARTS = re.compile(r" *[^ ]+| +\Z")
_RUNS = re.compile(f" *(?:[{_LETTERS}]+|[^{_LETTERS} ]+)| +\\Z")
_MIXED = re.compile(f"[{_LETTERS}][^{_LETTERS}{SPACE}]|[^{_LETTERS}{SPACE}][{_LETTERS}]")


class Unigram:
    """Best segmentation of a text into vocabulary pieces: its score and number of pieces.

    An Aho-Corasick automaton lists the pieces that end at each character; the best path to a
    character carries (score, pieces). Ties are those of the tokenizers library: of equally
    good paths to a place the one whose last piece starts earliest stays, and an unknown
    character is tried last, if no piece of one character matches. Neighbouring unknown
    characters are one run; with byte fallback a run counts its UTF-8 bytes.
    A text is cut before a space that follows another character, because no piece spans such a
    place, and between Latin letters and other characters if none spans that either (both are
    checked when the vocabulary is loaded; named pieces like <s> are let be by not cutting
    texts with a <). This needs whole numbers as scores and a text whose sums stay below 2^53, so that
    sums over parts are exact and equal those over the whole text (a score of minus a billion, such as that
    of runs of spaces, allows nine million characters). Any longer text, and any other vocabulary, such as a trained one with log
    probabilities, is run over the whole text in one pass, adding up in the tokenizer's order.
    """

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        import ahocorasick

        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY
        # Texts may be cut where no piece spans, if sums do not depend on it.
        self.cuts = (
            all(score == int(score) for _, score in vocab)
            and not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _ in vocab)
            and SPACE in dict(vocab)
        )
        self.longest = max(len(piece) for piece, _ in vocab)
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.exact_chars = (1 << 53) / max(-self.unknown, *(abs(score) for _, score in vocab))
        names = {piece for piece, _ in vocab}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        # Unknown runs may cross such a cut: bytes add up, whole runs would not.
        self.runs = self.bytes and not any(_MIXED.search(piece) for piece in names if "<" not in piece)
        self.cache: dict[str, tuple[float, int]] = {}
        self.before: dict[str, tuple[float, int]] = {}

    def best(self, part: str) -> tuple[float, int]:
        """(score, pieces) of the best path through part."""
        scores, counts = [0.0] + [float("-inf")] * len(part), [0] * (len(part) + 1)
        singles = 0
        # Pieces that end at a place come longest first, so an earlier start wins ties.
        for end, (length, score) in self.automaton.iter(part):
            end += 1
            start = end - length
            total = scores[start] + score
            if total > scores[end]:
                scores[end], counts[end] = total, counts[start] + 1
            singles += length == 1
        if singles == len(part):  # every character is known
            return scores[-1], counts[-1]
        return self.best_with_unknown(part)

    def best_with_unknown(self, part: str) -> tuple[float, int]:
        n = len(part)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(part):
            ends[end].append(piece)
        # score, pieces up to the last known piece, start of the unknown run (-1: none)
        path: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        size = lambda a, b: len(part[a:b].encode()) if self.bytes else 1
        for end in range(n):
            top, last, single = None, 0, False
            for length, score in sorted(ends[end], reverse=True):
                single |= length == 1
                total = path[end + 1 - length][0] + score
                if top is None or total > top:
                    top, last = total, length
            if not single:
                total = path[end][0] + self.unknown
                if top is None or total > top:
                    _, pieces, run = path[end]
                    path.append((total, pieces, run if run >= 0 else end))
                    continue
            start = end + 1 - last
            _, pieces, run = path[start]
            path.append((top, pieces + 1 + (size(run, start) if run >= 0 else 0), -1))
        score, pieces, run = path[n]
        return score, pieces + (size(run, n) if run >= 0 else 0)

    def whole(self, text: str) -> tuple[float, int]:
        """(score, pieces) of a text of any length in one pass; only the last places are kept."""
        size = lambda a, b: len(text[a:b].encode()) if self.bytes else 1
        keep = self.longest + 1
        path: list[tuple[float, int, int]] = [(0.0, 0, -1)] * keep
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for end in range(len(text)):
            top, last, single = None, 0, False
            while match is not None and match[0] == end:  # longest first
                length, score = match[1]
                single |= length == 1
                total = path[(end + 1 - length) % keep][0] + score
                if top is None or total > top:
                    top, last = total, length
                match = next(matches, None)
            before = path[end % keep]
            if not single and (top is None or before[0] + self.unknown > top):
                path[(end + 1) % keep] = before[0] + self.unknown, before[1], before[2] if before[2] >= 0 else end
                continue
            start = end + 1 - last
            _, pieces, run = path[start % keep]
            path[(end + 1) % keep] = top, pieces + 1 + (size(run, start) if run >= 0 else 0), -1
        score, pieces, run = path[len(text) % keep]
        return score, pieces + (size(run, len(text)) if run >= 0 else 0)

    def count(self, text: str) -> tuple[float, int]:
        """(score, pieces) of a whole text with its space mark in front; 0 pieces if empty."""
        if not text:
            return 0.0, 0
        if not self.cuts or len(text) >= self.exact_chars - 1:
            return self.whole(SPACE + text.replace(" ", SPACE))
        cut = _RUNS if self.runs and "<" not in text else _PARTS
        parts = cut.findall(" " + text.replace(SPACE, " "))
        new = set(parts).difference(self.cache)
        if new:
            learnt = {p: self.before.get(p) or self.best(p.replace(" ", SPACE)) for p in new}
            if len(self.cache) + len(learnt) > CACHE_WORDS:
                learnt.update((p, self.cache[p]) for p in set(parts).difference(learnt))
                self.before, self.cache = self.cache, {}
            self.cache.update(learnt)
        scores, counts = zip(*map(self.cache.__getitem__, parts))
        for p in [p for p in new if len(p) > CACHE_CHARS]:
            del self.cache[p]
        return sum(scores), sum(counts)


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public piece model, as they are in the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def unigram(path: str, byte_fallback: bool) -> Unigram:
    return Unigram(piece_vocabulary(path), byte_fallback)


def token_counts(docs: DataFrame, path: str | None = None, byte_fallback: bool = True) -> DataFrame:
    """Per document: doc_id, n_chars, n_pieces, best_score of the unigram tokenisation.

    Each row stays in its partition; a worker keeps the vocabulary, a bounded word cache and
    the best path of one part at a time. Null and empty texts have 0 pieces and score 0;
    repeated rows are counted each; only doc_id and text are read.
    """
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path, byte_fallback)
        for batch in batches:
            chars, pieces, scores = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                score, n = model.count(text)
                chars.append(len(text))
                pieces.append(n)
                scores.append(score)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0), "n_chars": pa.array(chars, pa.int64()),
                    "n_pieces": pa.array(pieces, pa.int64()), "best_score": pa.array(scores, pa.float64()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_pieces long, best_score double")
