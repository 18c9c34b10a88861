"""Token ids by public tokenizers, with a bounded cache of word ids per Python worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from lobbylens.llm.common import release

#: Cached words per worker and generation; the generation before is kept as well.
CACHE_WORDS = 500_000
#: Longer words are encoded each time.
CACHE_CHARS = 48
#: Words encoded in one call.
TOGETHER = 4096

# (Without the one capital whose lower case is two characters.)
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F"
#: Texts of Latin letters and ASCII without apostrophes are cut at every run of letters, where
#: both tokenizers start a word; the byte-level one takes the space before it along.
_OTHER = re.compile(f"[^{_LETTERS}\\x00-&(-\x7f]")
_RUNS = {
    False: re.compile(f" ?[{_LETTERS}]++|[^{_LETTERS}]+?(?= ?[{_LETTERS}]|\\Z)"),
    True: re.compile(f"[{_LETTERS}]++|[^{_LETTERS} \t\n\x0b\x0c\r]++"),
}
# Other texts are cut at single spaces between two characters that are no white space, or, if
# the tokenizer drops white space, at that of ASCII.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_SPACES = re.compile(r"\s\s")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; LOBBYLENS_TOKENIZERS names another folder."""
    folder = os.environ.get("LOBBYLENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text): the tokenizer's ids as little-endian unsigned 32-bit bytes.

    A text is cut where no token can span, each distinct part is encoded once and the bytes
    are joined, so the result is that of encoding the whole text.
    """

    def __init__(self, path: str, words: bool, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words, self.cache, self.before, self.cache_words = words, {}, {}, cache_words
        release()  # what reading the file took
        self.runs = _RUNS[words].findall

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, runs: list[str]) -> dict[str, bytes]:
        """Runs of letters, many in one call: each is one word to the tokenizer."""
        out = {}
        for at in range(0, len(runs), TOGETHER):
            some = runs[at : at + TOGETHER]
            found = self.tokenizer.encode((" " if self.words else "").join(some), add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4").tobytes()
            cuts = ((np.flatnonzero(np.diff(np.asarray(found.word_ids))) + 1) * 4).tolist()
            if len(cuts) + 1 != len(some):  # not one word each after all
                out.update((r, self.direct(r)) for r in some)
            else:
                out.update((r, ids[a:b]) for r, a, b in zip(some, [0, *cuts], [*cuts, len(ids)]))
        return out

    def learn(self, parts: set[str]) -> dict[str, bytes] | None:
        """ids of parts that are not cached; None if the cuts do not hold for one of them."""
        out, runs = {}, []
        for part in parts:
            if (ids := self.before.get(part)) is not None:
                out[part] = ids
            elif part[-1].isalpha() and (self.words or part[0] == " "):
                runs.append(part)
            elif not self.words and _SPACES.search(part):
                return None  # how a white space run ends depends on what follows
            else:
                out[part] = self.direct(part)
        out.update(self.letters(runs))
        return out

    def ids(self, text: str) -> bytes:
        if "'" in text or not text.isascii() and _OTHER.search(text):
            return self.apart(text)
        parts = self.runs(text.encode().lower().decode() if self.words else text)
        new = set(parts).difference(self.cache)
        if not new:
            return b"".join(map(self.cache.__getitem__, parts))
        learnt = self.learn(new)
        if learnt is None:
            return self.apart(text)
        if len(self.cache) + len(learnt) > self.cache_words and self.cache:
            learnt.update((p, self.cache[p]) for p in set(parts).difference(learnt))
            self.before, self.cache = self.cache, {}
        self.cache.update(learnt)
        out = b"".join(map(self.cache.__getitem__, parts))
        for p in [p for p in learnt if len(p) > CACHE_CHARS]:
            del self.cache[p]
        return out

    def apart(self, text: str) -> bytes:
        """Any text: parts between safe spaces, each encoded unless it was just before."""
        if self.words:
            parts = [p.decode() for p in text.encode().split()]
        else:
            first, *rest = _SAFE.split(text)
            parts = [first, *[" " + p for p in rest]]
        own: dict[str, bytes] = {}
        return b"".join([own.get(p) or own.setdefault(p, self.direct(p)) for p in parts])


@lru_cache(maxsize=4)
def encoder(path: str, words: bool, cache_words: int = CACHE_WORDS) -> Encoder:
    return Encoder(path, words, cache_words)
