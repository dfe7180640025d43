"""Held-out passages inside training text, by a generalised suffix automaton (problem 7).

Items are cut into blocks whose automaton fits a Python worker, and documents are read once: a task takes them in chunks
and streams each chunk past the automata of all blocks. What is reported does not depend on how items were cut.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Han, kana and their iteration and length marks: scripts written without spaces, compared by character.
_UNSPACED = re.compile("[々-〇ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_ASCII = re.compile("[0-9a-z]+")
_WORD = re.compile(r"[^\W_]+")


def _join_marks(text: str) -> str:
    """Without marks of any script: combining characters never end a word."""
    return "".join(c for c in text if not unicodedata.category(c).startswith("M"))


def normalized(text: str) -> str:
    """Text without case, accents and character width: NFKD, casefold, marks removed."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _join_marks(t)


def words(norm: str) -> list[str]:
    """Runs of letters and digits of a normalized text."""
    return (_ASCII if norm.isascii() else _WORD).findall(norm)


def characters(norm: str) -> str:
    """The letters and digits of a normalized text without anything between them."""
    return "".join(_WORD.findall(norm))


class SuffixAutomaton:
    """Minimal automaton of all substrings of several sequences, with the sequences that hold each.

    Built symbol by symbol; a clone splits a state when its longest substring gets a context of its own. Symbols are
    numbered. Links, lengths and the first transition of every state are flat arrays; only the root and the states that
    branch have a table besides. The items of a state are those of the prefixes in the subtree of links below it, and are
    looked up when a text first reaches it.
    """

    def __init__(self) -> None:
        self.code: dict = {}
        self.root = array("i")
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.symbol, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        # Prefix states with the item that ends there; a state may stand here for several.
        self.ends, self.ended = array("i"), array("q")

    def __len__(self) -> int:
        return len(self.link) - 1

    def _state(self, length: int, link: int, like: int = -1) -> int:
        new = len(self.link)
        self.length.append(length)
        self.link.append(link)
        self.symbol.append(self.symbol[like] if like >= 0 else -1)
        self.to.append(self.to[like] if like >= 0 else 0)
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def _step(self, p: int, s: int) -> int:
        """The state behind p by s, 0 if there is none."""
        if not p:
            return self.root[s]
        return self.to[p] if self.symbol[p] == s else self.more[p].get(s, 0) if p in self.more else 0

    def _lead(self, p: int, s: int, q: int) -> None:
        if not p:
            self.root[s] = q
        elif self.symbol[p] in (s, -1):
            self.symbol[p], self.to[p] = s, q
        else:
            self.more.setdefault(p, {})[s] = q

    def _clone(self, p: int, q: int, s: int) -> int:
        """Splits q: the substrings that reach it from p by s, and shorter ones, get a state of their own."""
        c = self._state(self.length[p] + 1, self.link[q], q)
        self.link[q] = c
        while p >= 0 and self._step(p, s) == q:
            self._lead(p, s, c)
            p = self.link[p]
        return c

    def add(self, item: int, symbols: Iterable) -> None:
        last, code, root, length = 0, self.code, self.root, self.length
        for x in symbols:
            s = code.get(x)
            if s is None:
                s = code[x] = len(root)
                root.append(0)
            q = self._step(last, s)
            if q:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, s)
            else:
                new, p = self._state(length[last] + 1, 0), last
                while p >= 0 and not self._step(p, s):
                    self._lead(p, s, new)
                    p = self.link[p]
                if p >= 0:
                    q = self._step(p, s)
                    self.link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, s)
                last = new
            self.ends.append(last)
            self.ended.append(item)

    def finish(self, least: int) -> SuffixAutomaton:
        """Orders what the lookups need, and finds for each state the ancestor that stands for its suffix of `least` symbols."""
        link, length = (np.array(x, dtype=np.int32) for x in (self.link, self.length))
        # An ancestor is shorter than what links to it: pointers are doubled until they reach the last one that is long enough.
        up = np.where((link > 0) & (length[link] >= least), link, np.arange(len(link), dtype=np.int32))
        while not np.array_equal(up, further := up[up]):
            up = further
        self.shortest = array("i", up.tobytes())
        self.below = np.argsort(link, kind="stable").astype(np.int32)
        self.below_at = np.searchsorted(link[self.below], np.arange(len(link) + 1)).astype(np.int32)
        ends = np.array(self.ends, dtype=np.int32)
        order = np.argsort(ends, kind="stable")
        self.ended = np.array(self.ended, dtype=np.int64)[order]
        self.ended_at = np.searchsorted(ends[order], np.arange(len(link) + 1)).astype(np.int32)
        self.ends = array("i")
        self.known: dict[int, tuple] = {}
        return self

    def items(self, state: int) -> tuple:
        """The items that hold the substrings of a state."""
        found = self.known.get(state)
        if found is None:
            seen, waiting = set(), [state]
            while waiting:
                v = waiting.pop()
                seen.update(self.ended[self.ended_at[v] : self.ended_at[v + 1]].tolist())
                waiting.extend(self.below[self.below_at[v] : self.below_at[v + 1]].tolist())
            found = self.known[state] = tuple(sorted(seen))
        return found

    def runs(self, symbols: Iterable, least: int) -> Iterator[tuple[int, int, int]]:
        """(position, length, state) wherever the longest suffix of the text so far that an item holds has `least` symbols."""
        p, n = 0, 0
        root, link, length, symbol, to, more, none = self.root, self.link, self.length, self.symbol, self.to, self.more, {}
        for at, s in enumerate(map(self.code.get, symbols)):
            if s is None:
                p = n = 0
                continue
            while p:
                if symbol[p] == s:
                    p = to[p]
                    break
                q = more.get(p, none).get(s)
                if q:
                    p = q
                    break
                p = link[p]
                n = length[p]
            else:
                p = root[s]
            n += 1
            if n >= least:
                yield at, n, p

    def matches(self, symbols: Iterable, least: int) -> dict[int, list]:
        """item -> [longest match, [first, last] positions covered] over all matches of at least `least` symbols.

        Items are taken from the state of the last `least` symbols, as a longer match may be in fewer items.
        """
        found: dict[int, list] = {}
        for at, n, state in self.runs(symbols, least):
            items = self.items(self.shortest[state])
            first = at - least + 1
            for item in items:
                hit = found.get(item)
                if hit is None:
                    found[item] = [least, [[first, at]]]
                elif first <= hit[1][-1][1] + 1:
                    hit[1][-1][1] = at
                else:
                    hit[1].append([first, at])
            if len(items) == 1:
                found[items[0]][0] = max(found[items[0]][0], n)
                continue
            while state > 0 and n >= least:
                for item in self.items(state):
                    if found[item][0] < n:
                        found[item][0] = n
                state = self.link[state]
                n = self.length[state]
        return found

    def spans(self, symbols: Iterable, least: int) -> list[list[int]]:
        """Merged [first, last] positions of all matches of at least `least` symbols."""
        return merged([at - n + 1, at] for at, n, _ in self.runs(symbols, least))


def merged(spans: Iterable[list[int]]) -> list[list[int]]:
    """Spans [first, last] in order of last, those that touch made one."""
    out: list[list[int]] = []
    for first, last in spans:
        while out and out[-1][1] >= first - 1:
            first = min(first, out.pop()[0])
        out.append([first, last])
    return out


class Passages:
    """The automata of one block of items: by words, and by characters for items in unspaced scripts."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, min_chars: int) -> None:
        self.min_words, self.min_chars = min_words, min_chars
        self.by_word, self.by_char = SuffixAutomaton(), SuffixAutomaton()
        self.sizes: dict[int, int] = {}
        for item, text in items:
            norm = normalized(text)
            chars = is_unspaced(norm)
            symbols = characters(norm) if chars else words(norm)
            self.sizes[item] = max(len(symbols), self.sizes.get(item, 0))
            (self.by_char if chars else self.by_word).add(item, symbols)
        self.by_word.finish(min_words)
        self.by_char.finish(min_chars)

    def find(self, norm: str) -> Iterator[tuple[int, int, bool, list[list[int]]]]:
        """(item, longest, whether by character, spans) for a normalized text."""
        if self.by_word:
            for item, (n, spans) in self.by_word.matches(words(norm), self.min_words).items():
                yield item, n, False, spans
        if self._may_hold_characters(norm):
            for item, (n, spans) in self.by_char.matches(characters(norm), self.min_chars).items():
                yield item, n, True, spans

    def _may_hold_characters(self, norm: str) -> bool:
        return bool(self.by_char) and not norm.isascii() and _UNSPACED.search(norm) is not None

    def spans(self, norm: str) -> tuple[list[list[int]], list[list[int]]]:
        """[first, last] words, and letters and digits, of a normalized text that stand in matches."""
        by_char = self._may_hold_characters(norm)
        return self.by_word.spans(words(norm), self.min_words), self.by_char.spans(characters(norm), self.min_chars) if by_char else []


_folded: dict[str, str] = {}


def cut(text: str, by_word: list[list[int]], by_char: list[list[int]]) -> tuple[str, int]:
    """Text without the spans (as of Passages.spans, of any number of blocks), and the number of code points removed."""
    place: list[int] = []
    for i, c in enumerate(text):
        x = _folded.get(c)
        if x is None:
            x = _folded[c] = normalized(c)
        place.extend([i] * len(x))
    at = [m.span() for m in _WORD.finditer("".join(_folded[c] for c in text))]
    gone = [[place[at[a][0]], place[at[b][1] - 1]] for a, b in merged(sorted(by_word, key=lambda s: s[1]))]
    if by_char:
        single = [place[i] for a, b in at for i in range(a, b)]
        gone += [[single[a], single[b]] for a, b in merged(sorted(by_char, key=lambda s: s[1]))]
    kept, end = [], 0
    for first, last in merged(sorted(gone, key=lambda s: s[1])):
        kept.append(text[end:first])
        end = last + 1
        # Marks that stood on a removed letter go with it.
        while end < len(text) and unicodedata.category(text[end]).startswith("M"):
            end += 1
    rest = "".join(kept) + text[end:]
    return rest, len(text) - len(rest)


def is_unspaced(norm: str) -> bool:
    """Whether most letters of a normalized text are Han or kana."""
    letters = sum(c.isalpha() for c in norm)
    return letters > 0 and 2 * len(_UNSPACED.findall(norm)) > letters


#: Characters of items in one block. An automaton was measured to take up to BYTES_PER_CHAR bytes a character while it is built
#: (Han text drawn at random, the worst case; words take a fifth), so a block takes about 0.4 GB at most in a Python worker.
BLOCK_CHARS = 1_500_000
BYTES_PER_CHAR = 270
#: Characters of documents that wait for their turn with the next block, where there are several.
CHUNK_CHARS = 16_000_000


class _Blocks:
    """Broadcast blocks of items, and in each Python worker the automata of the block used last."""

    held: tuple | None = None

    def __init__(self, items: DataFrame, block_chars: int, min_words: int, min_chars: int) -> None:
        sc = items.sparkSession.sparkContext
        self.least = (min_words, min_chars)
        self.blocks: list = []
        block: list[tuple[int, str]] = []
        size = 0
        for r in items.select("item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
            if block and size + len(r["text"]) > block_chars:
                self.blocks.append(sc.broadcast((uuid.uuid4().hex, block)))
                block, size = [], 0
            block.append((r["item_id"], r["text"]))
            size += len(r["text"])
        self.blocks.append(sc.broadcast((uuid.uuid4().hex, block)))

    def passages(self, i: int) -> Passages:
        name, block = self.blocks[i].value
        if _Blocks.held is None or _Blocks.held[0] != name:
            _Blocks.held = None
            _Blocks.held = (name, Passages(block, *self.least))
        return _Blocks.held[1]

    def past(self, rows: Iterator[tuple], chunk_chars: int) -> Iterator[tuple[list[tuple], list[Iterator]]]:
        """Chunks of rows (.., text) with, for each block in turn, its automata; a block is built once per chunk, or kept if it is the only one."""
        order = list(range(len(self.blocks)))
        for chunk in _chunks(rows, chunk_chars if len(order) > 1 else 1):
            yield chunk, (self.passages(i) for i in order)
            # The block built last comes first for the next chunk.
            order.reverse()


def _chunks(rows: Iterator[tuple], chunk_chars: int) -> Iterator[list[tuple]]:
    """Rows in lists of about chunk_chars characters of their last column, 1000 rows at a time."""
    while chunk := list(islice(rows, 1000)):
        size = sum(len(r[-1]) for r in chunk)
        while size < chunk_chars and (more := list(islice(rows, 1000))):
            chunk += more
            size += sum(len(r[-1]) for r in more)
        yield chunk


def find_passages(
    docs: DataFrame, items: DataFrame, min_words: int = 12, min_chars: int = 20, block_chars: int = BLOCK_CHARS, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """(doc_id, item_id, longest, covered, item_size): documents that hold part of an item.

    docs: doc_id, text; items: item_id, text, a stated set of held-out passages. Items are compared by word, those
    in Chinese or Japanese by character, without case, accents, width, punctuation and white space. longest is
    the longest run found, covered the number of symbols of the document inside matches, item_size the item's
    symbols. Items go to the tasks in blocks of at most block_chars characters (an item longer than that is one by itself),
    and a Python worker holds the automaton of one block. Documents are read once: where there are several
    blocks, chunks of chunk_chars characters are streamed past each of them in turn. The rows are the same for any block_chars.

    Rows with a null text or id are passed over, empty texts match nothing. A row of docs given twice is reported twice.
    Several texts under one item_id count as one item: longest and item_size are the largest, covered counts symbols inside matches
    of any of them (of the kind, word or character, that covers more).
    """
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    blocks = _Blocks(items, block_chars, min_words, min_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = ((doc, normalized(text)) for pdf in batches for doc, text in zip(pdf["doc_id"], pdf["text"]))
        for chunk, passes in blocks.past(texts, chunk_chars):
            found: dict[tuple[int, int], list] = {}
            sizes: dict[int, int] = {}
            for passages in passes:
                sizes |= {item: max(n, sizes.get(item, 0)) for item, n in passages.sizes.items()}
                for i, (_, norm) in enumerate(chunk):
                    for item, n, chars, spans in passages.find(norm):
                        hit = found.setdefault((i, item), [0, [], []])
                        hit[0] = max(hit[0], n)
                        hit[1 + chars] += spans
            out = [
                (chunk[i][0], item, n, max(sum(b - a + 1 for a, b in merged(sorted(x, key=lambda s: s[1]))) for x in spans), sizes[item])
                for (i, item), (n, *spans) in found.items()
            ]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "longest", "covered", "item_size"])

    return rows.mapInPandas(run, "doc_id long, item_id long, longest int, covered int, item_size int")


def remove_passages(
    docs: DataFrame, items: DataFrame, max_share: float = 0.5, min_words: int = 12, min_chars: int = 20,
    block_chars: int = BLOCK_CHARS, chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """(doc_id, text, removed_chars, action) for every row of docs.

    Spans that an item holds too, at least min_words words (min_chars characters) long, are cut out; action is
    then 'cut'. A document that would lose more than max_share of its code points is given up: 'drop', null text.
    Documents without a match, empty and null texts are kept: 'keep'. Blocks of items are as in find_passages: spans are
    found block by block and cut together, so the result doesn't depend on block_chars.
    """
    blocks = _Blocks(items, block_chars, min_words, min_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = ((doc, text, normalized(text or "")) for pdf in batches for doc, text in zip(pdf["doc_id"], pdf["text"]))
        for chunk, passes in blocks.past(texts, chunk_chars):
            spans: list[tuple[list, list]] = [([], []) for _ in chunk]
            for passages in passes:
                for i, (_, _, norm) in enumerate(chunk):
                    if norm:
                        for held, more in zip(spans[i], passages.spans(norm)):
                            held += more
            out = []
            for (doc, text, _), gone in zip(chunk, spans):
                rest, removed = cut(text, *gone) if any(gone) else (text, 0)
                drop = removed > max_share * len(text or "")
                out.append((doc, None if drop else rest, removed, "drop" if drop else "cut" if any(gone) else "keep"))
            yield pd.DataFrame(out, columns=["doc_id", "text", "removed_chars", "action"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string, removed_chars int, action string")
