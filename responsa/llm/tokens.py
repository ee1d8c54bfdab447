"""Token ids of whole texts by a vocabulary file of the tokenizers library, with a cache of words.

Where the file's rules drop white space between words, a text's ids are those of its
words one after another. Each word is then encoded once by the library itself; texts
are joined from the cached ids. Other vocabularies are encoded text by text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

from .common import sole

SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters whose classes no version of Unicode has changed, and which, as their small letters, are single ones of this kind; of others the library and Python may think differently. NFC leaves texts of them alone.
PLAIN = [c for c in map(chr, [*range(0x250), *range(0x2010, 0x2028)]) if len(c.lower()) == 1 and (c.lower() < "\u0250" or "\u2010" <= c.lower() < "\u2028")]
OLD = re.compile(f"[{re.escape(''.join(PLAIN))}]*")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin(t: str) -> bool:
    try:
        t.encode("latin-1")  # faster than any search
    except UnicodeEncodeError:
        return False
    return True


def _matcher(pattern: str, chars: list[str]) -> re.Pattern:
    """pattern for texts of chars alone, with their letters, numbers and spaces by name."""
    for k in (r"\p{L}", r"\p{N}", r"\s"):
        kind = regex.compile(k)
        pattern = pattern.replace(k, "".join(re.escape(c) for c in chars if kind.match(c)))
    return re.compile(pattern)


def encoder(path: str | None = None) -> "Encoder":
    """One for each Python worker and file."""
    path = path or vocabulary()
    return sole(("tokens", path), lambda: Encoder(path))


class Encoder:
    """ids(texts): little-endian uint32 ids of each text, as bytes; null is as empty.

    most: words that a generation of the cache holds. Two generations are kept, so that
    memory is bounded.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        kinds = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        self.suffix = rules["model"].get("end_of_word_suffix")
        #: Words can be told apart: white space splits them, and each one's last token says so.
        self.by_word = bool(self.suffix) and kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and bool(split.get("invert"))
        if self.by_word:
            pattern = split["pattern"]["Regex"]
            ways = pattern.split("|")
            if (letters := r"[\p{L}]+") in ways and all(x == letters or x.startswith(("'", r"[\p{N}", r"[^\s\p{L}")) for x in ways):
                # no other way begins with a letter, so the commonest one may be tried first
                pattern = "|".join([letters, *(x for x in ways if x != letters)])
            # the standard library's matcher is the faster one; it gets classes to the same effect, and the fewer characters they name the faster it is
            self.ascii_word = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r "))
            self.latin_word, self.plain_word = (_matcher(pattern, [c for c in PLAIN if c < end]) for end in ("\u0100", "\uffff"))
            self.added = [x["content"] for x in rules.get("added_tokens", [])]
            vocab = self.library.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(self.library.get_vocab(with_added_tokens=True).values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(self.suffix)]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        lot: list[str] = []
        size = 0
        for t in texts:  # lots of bounded size: a lot's new words are encoded in one call
            lot.append(t or "")
            size += len(lot[-1])
            if size > 2_000_000:
                out += self._lot(lot)
                lot, size = [], 0
        return out + self._lot(lot)

    def _lot(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        known = [None if x is None else [*map(self.new.get, x)] for x in parts]
        missing = {w for x, ids in zip(parts, known, strict=True) if ids is not None and None in ids for w, i in zip(x, ids, strict=True) if i is None}
        if len(self.new) + len(missing) > self.most:
            self.old, self.new = self.new, {}
        words = []
        for w in missing:
            if (ids := self.old.get(w)) is not None:
                self.new[w] = ids
            elif w.isascii() or OLD.fullmatch(w):
                words.append(w)
            else:
                self.new[w] = self._whole(w)
        self._learn(words)
        out = []
        for t, x, ids in zip(texts, parts, known, strict=True):
            if x is not None and None in ids:
                ids = [self.new[w] if i is None else i for w, i in zip(x, ids, strict=True)]
            out.append(self._whole(t) if x is None else b"".join(ids))
        return out

    def _parts(self, t: str) -> list[str] | None:
        """The words of a text, or None where the library must take it whole. What stands between white space and holds another than OLD characters is one part, for the library.

        Python also splits at \\x1c-\\x1f, which are no white space to the library.
        """
        if not self.by_word or any(a in t for a in self.added) or any(c in t for c in SEPARATORS):
            return None
        if t.isascii():
            return self.ascii_word.findall(t.lower())
        if _latin(t):
            return self.latin_word.findall(t.lower())
        if OLD.fullmatch(t):
            return self.plain_word.findall(t.lower())
        return [w for x in t.split() for w in (self._parts(x) if OLD.fullmatch(x) else [x])]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """New words in one call; a word's ids end where a token carries the end mark."""
        if not words:
            return
        ids = np.asarray(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            raw, at = ids.tobytes(), 0
            for w, e in zip(words, (ends * 4).tolist(), strict=True):
                self.new[w] = raw[at:e]
                at = e
        else:  # a byte missing from the vocabulary, or a word that the rules split again
            for w in words:
                self.new[w] = self._whole(w)
