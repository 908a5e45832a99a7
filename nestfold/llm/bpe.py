"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the encoding's last token is unique.  It is a
vocabulary token that ends the prefix (the automaton lists those: its suffix
links lead through all tokens that are suffixes of the text read so far) and
that is compatible with the last token of the prefix before it.  Two tokens are
compatible if merging their joined text gives back these two.  Storing that one
token per prefix and following the back-pointers from the end gives exactly the
ids of merging by rank, in time linear in the word for a bounded token length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chars

NEVER = 1 << 60
WORD_END = "</w>"
# The mark of a word end inside the automaton: never a byte letter.
MARK = "\x00"
# Words and pairs that a worker remembers; words in two generations, so that frequent ones stay.
CACHE_WORDS = 80_000
CACHE_PAIRS = 300_000
GROUP_CHARS = 1 << 21
GROUP_ROWS = 512
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# The word pattern of the vocabulary file: fixed value (white space by its Unicode property).
WORD_PATTERN = CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


class MergeTable:
    """Tokens with their two parts and merge ranks, and the pair test."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]], word_end: str = WORD_END):
        import ahocorasick

        self.vocab = vocab
        self.text = {i: t for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        shape: dict[int, str] = {}
        made = {a + b for a, b in merges}
        for t, i in vocab.items():
            if t not in made:
                shape[i] = t[: -len(word_end)] + MARK if word_end and t.endswith(word_end) and len(t) > len(word_end) else t
                self.born[i] = -1
        for r, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), r)
            if whole not in self.born:
                self.born[whole], self.parts[whole] = r, (left, right)
                shape[whole] = shape[left] + shape[right]
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._pairs: dict[int, bool] = {}
        self.width = max(vocab.values(), default=0) + 1
        self._own: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, t in shape.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Outermost symbols of a token on one side while it is being merged, each with the rank that ends it."""
        key = (token, side)
        found = self._spines.get(key)
        if found is None:
            found, until = [], NEVER
            while token in self.parts:
                found.append((token, until))
                until = self.born[token]
                token = self.parts[token][side]
            found.append((token, until))
            found.reverse()
            self._spines[key] = found
        return found

    def crosses(self, left: int, right: int, at_end: bool = True) -> bool:
        """Whether merging the joined text joins symbols across the border of the two tokens.

        At any time the border lies between a symbol of the left token's right
        spine and one of the right token's left spine.  Their pair is merged if its rank
        comes before the end of both; on a tie the pair further left goes first.
        """
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            x, x_end = a[i]
            y, y_end = b[j]
            r = self.rank.get((x, y))
            if x_end == y_end == NEVER:
                return at_end and r is not None
            if r is not None and r < x_end and r <= y_end:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def own(self, token: int) -> bool:
        """Whether merging a token's text gives the token itself."""
        found = self._own.get(token)
        if found is None:
            parts = self.parts.get(token)
            found = parts is None or (self.own(parts[0]) and self.own(parts[1]) and not self.crosses(*parts, at_end=False))
            self._own[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.width + right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = not self.crosses(left, right)
        return found

    def encode(self, letters: str) -> list[int]:
        """Ids of one word given as byte letters with the mark of the word end, if the vocabulary has one."""
        n = len(letters)
        last: list = [None] * (n + 1)
        step = [0] * (n + 1)
        pairs, own, compatible, width = self._pairs, self._own, self.compatible, self.width
        for end, (token, size) in self.automaton.iter(letters):
            end += 1
            if last[end] is not None:
                continue
            before = end - size
            if before:
                prev = last[before]
                if prev is None:
                    continue
                ok = pairs.get(prev * width + token)
                if not (compatible(prev, token) if ok is None else ok):
                    continue
            if own.get(token) or self.own(token):
                last[end], step[end] = token, size
        out = []
        while n:
            if last[n] is None:
                raise ValueError("a byte is missing from the vocabulary")
            out.append(last[n])
            n -= step[n]
        out.reverse()
        return out


class WordBpe:
    """Texts to ids and back as the vocabulary file says: NFC, lower case, words, byte letters, merges."""

    def __init__(self, path: str):
        import regex

        from .token_blocks import byte_chars

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = MergeTable(spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]])
        self.names = self.table.text | {i: t for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")")
        self.odd = re.compile(CONTRACTIONS)
        self.words = regex.compile(WORD_PATTERN)
        self.letters = byte_chars()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case letter by letter (no special form of a final sigma)."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def entry(self, word: str) -> tuple[bytes, str]:
        ids = [self.special[word]] if word in self.special else self.table.encode(word.encode().decode("latin-1").translate(self.letters) + MARK)
        return np.array(ids, np.int32).tobytes(), " ".join(self.names[i] for i in ids)

    def entries(self, words: list[str]) -> list[tuple[bytes, str]]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for w in words:
            if w not in known:
                known[w] = older.get(w) or self.entry(w)
        return [known[w] for w in words]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, where each text's ids begin (one more entry), and the decoded texts."""
        plain = [("" if self.special_re.search(t) else self.normal(t)) for t in texts]
        odd = [i for i, (t, p) in enumerate(zip(texts, plain, strict=True)) if (t and not p) or self.odd.search(p)]
        for i in odd:
            plain[i] = ""
        words, inverse, bounds = chars.distinct_words(plain, word_spans)
        found = self.entries(words)
        names = [f[1] for f in found]
        order = inverse.tolist()
        decoded = [" ".join([names[w] for w in order[a:b]]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        lens = np.array([len(f[0]) >> 2 for f in found], np.int64)
        flat = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
        ids = chars.ragged(flat, (np.cumsum(lens) - lens)[inverse], lens[inverse])
        begins = np.append(0, np.cumsum(lens[inverse]))[bounds]
        if odd:
            pieces = [ids[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
            for i in odd:
                parts = [self.entry(p) if p in self.special else None for p in self.special_re.split(texts[i])]
                many = []
                for part, e in zip(self.special_re.split(texts[i]), parts, strict=True):
                    many += [e] if e else [self.entry(w) for w in self.words.findall(self.normal(part))]
                pieces[i] = np.frombuffer(b"".join(m[0] for m in many), np.int32)
                decoded[i] = " ".join(m[1] for m in many)
            ids = np.concatenate(pieces)
            begins = np.append(0, np.cumsum([len(p) for p in pieces]))
        return ids, begins, decoded


def word_spans(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter runs, single numbers and runs of other signs; white space is dropped."""
    return chars.spans(chars.char_classes()[cps], offsets, chars.SPACE, alone=chars.NUMBER)


@lru_cache(maxsize=4)
def coder(path: str) -> WordBpe:
    """One coder per Python worker and vocabulary."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of every whole text; other columns are ignored.

    ``decoded`` is what the vocabulary's decoder gives for the ids: without a decoder in
    the file, the token strings joined by a blank, special tokens included.  Null
    and empty texts have no ids and decode to the empty text; every input row gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP_ROWS):
                batch = whole.slice(at, GROUP_ROWS)
                texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
                for a, b in chars.slabs(texts, GROUP_CHARS):
                    ids, begins, decoded = bpe.encode(texts[a:b])
                    lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
