"""BPE encoding and decoding: prefix-sharing trie traversal over the distinct words of a batch.

The vocabulary is a word BPE: text is normalised (NFC, lower case), cut into words, and a word's last
byte carries an end mark. The encoding of any prefix is fixed by its last token: the tokens before it
encode what is left. So the distinct words are walked depth first through their trie (in sorted order, a
word keeps the states of the prefix that it shares with the word before), and each trie edge finds the one
vocabulary entry that ends there and stays unmerged beside the last token of what precedes it.

Results equal the tokenizers library's encode(add_special_tokens=False) and decode(skip_special_tokens=
False) for this file. Null text is empty text: no tokens and empty decoded text. Texts are worked through in
pieces cut at white space, so memory does not follow the longest text.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairnspark.llm.common import text_or_empty, worker_caches

PIECE = 1 << 19
#: Distinct runs without white space whose encodings a worker keeps between batches.
KEPT_RUNS = 250_000
END = "</w>"
#: Letter of the end mark in the entries' trie; stand-in letters are below it.
MARK = 511


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from 256."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in stays]
    return [chr(b) if b in stays else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """Encoder for one vocabulary file; form turns the ids of a run without white space into what callers join."""

    def __init__(self, path: str, form: Callable[[list[int], WordBpe], Any] | None = None, library: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.names = {v: k for k, v in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {v: k for k, v in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        for k, (a, b) in enumerate(() if library else merges):
            left, right, both = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = k
            self.parts[both] = left, right
            self.made[both] = k
        if not library:
            self._suffixes()
        self.letters = _byte_letters()
        self.plain = all(self.letters[b] == chr(b) for b in range(33, 127))
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.side: dict[int, bool] = {}
        self.form = form or (lambda ids, _: tuple(ids))
        self.known: dict[str, list[int]] = {}
        self.kept: dict[str, Any] = {}
        self.model = Tokenizer.from_file(path).model if library else None

    def encode_words(self, words: set[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words: by the library's model where asked for, else by the trie."""
        if self.model is not None:
            tokenize, stand_in = self.model.tokenize, self.stand_in
            return ((w, [t.id for t in tokenize(stand_in(w))]) for w in words)
        pairs = sorted((self.stand_in(w), w) for w in words)
        return zip([w for _, w in pairs], self.encode_sorted([x for x, _ in pairs]), strict=True)

    def _suffixes(self) -> None:
        """The trie of all entries, and for each of its nodes the entries that end there, longest first."""
        self.step: dict[int, int] = {}
        ends: list[int | None] = [None]
        depth, letters = [0], [0]
        parent = [0]
        for name, i in self.ids.items():
            node = 0
            for c in [*map(ord, name.removesuffix(END)), *([MARK] if name.endswith(END) else [])]:
                key = node << 9 | c
                if key not in self.step:
                    self.step[key] = len(ends)
                    ends.append(None)
                    depth.append(depth[node] + 1)
                    letters.append(c)
                    parent.append(node)
                node = self.step[key]
            ends[node] = i
        self.back = [0] * len(ends)
        self.found: list[tuple[tuple[int, int], ...]] = [()] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            up = parent[node]
            if up:
                self.back[node] = self.walk(self.back[up], letters[node])
            size = depth[node] - (letters[node] == MARK)
            self.found[node] = (((ends[node], size),) if ends[node] is not None else ()) + self.found[self.back[node]]

    def walk(self, node: int, c: int) -> int:
        """The node of the longest suffix that the trie has, one letter on."""
        while (to := self.step.get(node << 9 | c)) is None and node:
            node = self.back[node]
        return to or 0

    def apart(self, a: int, b: int) -> bool:
        """Whether a and b, each built by its own merges, stay two tokens side by side.

        Undo the latest merges on both sides of the border: a pair that could merge across the border
        before the merge that was just undone would have come first. Of equal merges the left one is first.
        """
        if len(self.side) > 300_000:
            self.side.clear()
        key, limit, out = a << 20 | b, len(self.rank), True
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < limit:
                out = False
                break
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]
        self.side[key] = out
        return out

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each word (in stand-in letters) of a sorted list: a depth-first walk of the words' trie."""
        step, walk, found, side, apart = self.step, self.walk, self.found, self.side, self.apart
        last, size, nodes = [-1], [0], [0]  # by depth: last token, its letters, and the node of the entries' trie
        before = ""
        for w in words:
            n = len(w)
            d, most = 0, min(len(last) - 1, n - 1)
            while d < most and w[d] == before[d]:
                d += 1
            del last[d + 1 :], size[d + 1 :], nodes[d + 1 :]
            node = nodes[d]
            for d in range(d + 1, n):
                c = ord(w[d - 1])
                to = step.get(node << 9 | c)
                node = walk(node, c) if to is None else to
                for t, k in found[node]:
                    if k == d:
                        break
                    p = last[d - k]
                    if (ok := side.get(p << 20 | t)) is None:
                        ok = apart(p, t)
                    if ok:
                        break
                last.append(t)
                size.append(k)
                nodes.append(node)
            for t, k in found[walk(walk(node, ord(w[-1])), MARK)]:
                if k == n or apart(last[n - k], t):
                    break
            out, at = [t], n - k
            while at:
                out.append(last[at])
                at -= size[at]
            out.reverse()
            before = w
            yield out

    def stand_in(self, word: str) -> str:
        return word if self.plain and word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])

    def learn(self, lists: Iterable[list[str]]) -> None:
        """Encode the distinct runs without white space that are not kept yet."""
        runs = set(chain.from_iterable(lists))
        new = runs.difference(self.kept)
        if not new:
            return
        if len(self.kept) + len(new) > KEPT_RUNS:
            self.kept = {r: self.kept[r] for r in runs.intersection(self.kept)}
        if len(self.known) > KEPT_RUNS // 2:
            self.known.clear()
        cut = {}
        for r in new:
            if r.isascii():
                if r.isalpha():
                    cut[r] = (r,)
                    continue
                if r[-1] in ".,!?;:" and r[:-1].isalpha():
                    cut[r] = r[:-1], r[-1]
                    continue
            cut[r] = self.words.findall(r)
        known, form = self.known, self.form
        known.update(self.encode_words(set(chain.from_iterable(cut.values())).difference(known)))
        for r, ws in cut.items():
            self.kept[r] = form(known[ws[0]] if len(ws) == 1 else [i for w in ws for i in known[w]], self)

    def runs(self, text: str) -> list[str]:
        """Normalised runs without white space; no word spans white space."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-cased letter by letter, so never a final sigma
        text = text.lower()
        return self.words.findall(text) if self.odd.search(text) else text.split()

    def pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """(runs, special id after them or None) of consecutive pieces of a text."""
        at = 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                if cut < 0:
                    cut = min((c for c in (text.find(" ", end), text.find("\n", end)) if c >= 0), default=len(text))
                end = cut
            part = text if not at and end >= len(text) else text[at:end]
            at = end
            if self.cuts is None or "<|" not in part:
                yield self.runs(part), None
                continue
            for k, x in enumerate(self.cuts.split(part)):
                if k % 2:
                    yield [], self.special[x]
                else:
                    yield self.runs(x), None

    def formed(self, texts: list[str]) -> Iterator[Iterator[Any]]:
        """For each text the forms of its runs, in order."""

        def long(text: str) -> Iterator[Any]:
            for runs, special in self.pieces(text):
                self.learn([runs])
                yield from map(self.kept.__getitem__, runs)
                if special is not None:
                    yield self.form([special], self)

        short = [self.runs(t) if len(t) <= PIECE and "<|" not in t else None for t in texts]
        self.learn(runs for runs in short if runs)
        kept = self.kept  # stays whole for these texts, whatever a long one makes of the cache
        for t, runs in zip(texts, short, strict=True):
            yield long(t) if runs is None else map(kept.__getitem__, runs)


_loaded: dict[tuple, WordBpe] = {}


def load(path: str, form: Callable[[list[int], WordBpe], Any] | None = None, library: bool = False) -> WordBpe:
    """One encoder a worker, file and form."""
    worker_caches("word_bpe", _loaded.clear)
    key = path, getattr(form, "__name__", None), library
    if key not in _loaded:
        _loaded[key] = WordBpe(path, form, library)
    return _loaded[key]


def packed(ids: list[int], _: WordBpe) -> bytes:
    return array("I", ids).tobytes()


def spelt(ids: list[int], bpe: WordBpe) -> tuple[str, str, int]:
    return " ".join(map(str, ids)), " ".join([bpe.names[i] for i in ids]), len(ids)


def groups(texts: pa.Array, letters: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many letters together."""
    first, held, n = 0, [], 0
    for k, t in enumerate(texts.to_pylist()):
        t = t or ""
        if held and n + len(t) > letters:
            yield first, held
            first, held, n = k, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield first, held


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs(doc_id, text, ...)."""

    def digest(forms: Iterator[tuple[str, str, int]]) -> tuple[int, str, str]:
        ids, names, n = hashlib.sha256(), hashlib.sha256(), 0
        while part := list(islice(forms, 50_000)):
            a, b, c = zip(*part, strict=True)
            gap = b" " if n else b""
            ids.update(gap + " ".join(a).encode())
            names.update(gap + " ".join(b).encode())
            n += sum(c)
        return n, ids.hexdigest(), names.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, spelt)
        for b in batches:
            for at, texts in groups(b.column(1)):
                n, ids, names = zip(*map(digest, bpe.formed(texts)), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(ids), pa.array(names)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def ids_of(texts: list[str], bpe: WordBpe) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, by an encoder loaded with packed."""
    return map(b"".join, bpe.formed(texts))


def round_trip(ids: list[int], path: str) -> str:
    """The text that a list of ids spells: bytes of its entries, a space after each end mark."""
    bpe = load(path)
    back = {c: b for b, c in enumerate(bpe.letters)}
    out = bytearray()
    for i in ids:
        name = bpe.names[i]
        body = name.removesuffix(END)
        out += body.encode() if i in bpe.special.values() else bytes(back[c] for c in body)
        out += b" " * name.endswith(END)
    return out.decode("utf-8", "replace")
