"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import json
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from .batches import numbered, words

#: Distinct words whose ids a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Letters, those of Latin alphabets, behind which closing punctuation is looked up apart.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
#: New words that are handed to the tokenizer as one text.
JOINED = 1000

_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, end_id: int | None = None) -> Encoder:
    """The worker process's own encoder, with what it remembers from earlier tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


class Encoder:
    """``encode(texts)`` gives all ids in a row and where each text begins; ``end_id`` closes each text.

    Where the tokenizer drops white space, no token crosses it, and a text's
    ids are those of its words put together. Distinct words are then encoded
    once. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, end_id: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        probe = ["a b", "foo\nbar  it's 12 3", " x\t", "Über-lang\r\né"]
        self.by_word = all(self._plain([t])[0] == [i for w in t.split() for i in self._plain([w])[0]] for t in probe)
        # Whether case is dropped, and whether punctuation that ends a word is made into tokens of its own: then such
        # words are looked up in lower case and without it.
        self.lowers = self.by_word and self._plain(["Foo BAR"]) == self._plain(["foo bar"])
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.points = [c for c in string.punctuation if c != "'" and c not in added]
        runs = [m for c in self.points for m in (c, c + c, f"{c}.", f".{c}")]
        self.splits_ends = self.by_word and self._plain([f"foo{m} b1{m} \u00df{m}" for m in runs]) == self._plain([f"foo {m} b1 {m} \u00df {m}" for m in runs])
        self.closes = self._closing()
        # A special token stands between words that are encoded as one text.
        specials = [(t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special]
        self.mark = next(((c, i) for c, i in specials if self._plain([f"a {c} b"])[0] == [*self._plain(["a"])[0], i, *self._plain(["b"])[0]]), None)
        self._forget()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _closing(self) -> np.ndarray | None:
        """Of each id whether its token ends a word; null where a word need not have such a token.

        With all bytes among these, what the tokenizer takes for a word has exactly one, at its end.
        """
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix, vocab = model.get("end_of_word_suffix"), self.tokenizer.get_vocab(with_added_tokens=True)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not suffix or not self.by_word or any(c + suffix not in vocab for c in pre_tokenizers.ByteLevel.alphabet()) or any(t.replace(" ", "").isalpha() for t in added):
            return None
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return out

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)

    def _split(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and each word's number of ids."""
        if self.closes is not None and all(map(str.isalpha, new)):
            joined = (" ".join(new[i : i + JOINED]) for i in range(0, len(new), JOINED))
            ids = np.concatenate([np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in joined])
            at = np.flatnonzero(self.closes[ids])
            if len(at) == len(new):  # else the tokenizer takes some for several words
                return ids, np.diff(at, prepend=-1)
        mark = self.mark
        if mark is not None and not any(mark[0][:2] in w for w in new):
            joined = (f" {mark[0]} ".join([*new[i : i + JOINED], ""]) for i in range(0, len(new), JOINED))
            ids = np.concatenate([np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in joined])
            at = np.flatnonzero(ids == mark[1])
            if len(at) == len(new):
                return np.delete(ids, at), np.diff(at, prepend=-1) - 1
        plain = self._plain(new)
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        return np.fromiter((i for x in plain for i in x), np.uint32, int(sizes.sum())), sizes

    def _learn(self, new: list[str]) -> None:
        letters = [w for w in new if w.isalpha()] if self.closes is not None else []
        if letters and len(letters) < len(new):
            self._learn(letters)
            new = [w for w in new if not w.isalpha()]
        marked = [w for w in new if self.mark and self.mark[0][:2] in w]
        if marked and len(marked) < len(new):
            self._learn(marked)
            new = [w for w in new if w not in self.number]
        ids, sizes = self._split(new)
        n, base = len(self.number), self.ends[len(self.number) - 1] if self.number else 0
        total = int(base + len(ids))
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(new) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[base:total] = ids
        self.ends[n : n + len(new)] = base + np.cumsum(sizes)
        self.number.update(zip(new, range(n, n + len(new)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tail = 0 if self.end_id is None else 1
        if not self.by_word:
            lists = self._plain(texts.to_pylist())
            parts = [np.array(x + [self.end_id] * tail, np.uint32) for x in lists]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), ends
        if self.splits_ends:
            points = "".join(f"\\{c}" for c in self.points)
            texts = pc.replace_substring_regex(texts, rf"([0-9{LETTERS}])([{points}]+)(\s|$)", r"\1 \2\3")
        # No lowering where a special token may be spelled in capitals: it is none then.
        lower = self.lowers and not pc.any(pc.match_substring(texts, "<"), min_count=0).as_py()
        flat, word_ends = words(texts, lower)
        at, distinct = numbered(flat)
        if len(self.number) > REMEMBERED:
            self._forget()
        known = self.number
        new = [w for w in distinct if w not in known]
        if new:
            self._learn(new)
        k = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[at]
        sizes = self.ends[k] - np.where(k > 0, self.ends[k - 1], 0)
        firsts = self.ends[k] - sizes
        before = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(firsts - before[:-1], sizes) + np.arange(before[-1])
        ids, ends = self.ids[source], before[word_ends]
        if not tail:
            return ids, ends
        n = np.arange(len(ends))
        out = np.empty(len(ids) + len(texts), np.uint32)
        body = np.ones(len(out), bool)
        body[ends[1:] + n[1:] - 1] = False
        out[body] = ids
        out[~body] = self.end_id
        return out, ends + n
