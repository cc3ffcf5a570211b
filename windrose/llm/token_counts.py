"""Exact token counts of every prefix of a text by dynamic programming, for a BPE vocabulary whose words end in a mark.

``prefix_counts`` adds an array of the tokens that each prefix (by code points, from none to all) has when it is encoded by itself;
``count_at``, ``longest_within`` and ``truncated`` answer from it, without encoding again, how many tokens a cut text has and where to cut for a budget.

Method: a token sequence is the encoding of its symbols exactly when each two neighbours are the encoding of their own
concatenation. So the last token of a word's prefix is the one token ending there that agrees with the last token before it, and
counts follow from left to right: one table for prefixes that go on, one for those that end the word and so carry the mark.
A pair is judged once by looking back through its merges and then remembered, as are the counts of short words; both memories are bounded.

Around the words: normalisation and splitting of a text are those of the vocabulary file, so prefixes that cut a composed character,
a special token or a contraction count as what is left of them would. A text in which every character stands for itself
goes through in one scan; others are compared cluster by cluster with the whole text's form, and only where a prefix's form
departs from it is its last word counted anew from the tables.

Scale: no shuffle; the vocabulary (its file's size) goes to each executor once; rows pass in slices of ``SLICE`` bytes of text, so a task
holds a slice's counts (four bytes a character) and its memories. A single text must fit in one row.

Cases: a null text counts as an empty one, with counts [0]; an existing column of the output's name is replaced, other columns
are kept; repeated rows count alike; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Words and pairs that a worker remembers before it starts afresh; only words of at most LONG characters are.
MEMO, LONG = 800_000, 48
#: Bytes of text whose counts a task holds at once.
SLICE = 4 << 20


def byte_of_symbol() -> dict[str, int]:
    """The printable symbols that stand for bytes in such vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words:
    """Counts of every prefix of single words. A token is an int; ``mark`` ends the last symbol of a word."""

    def __init__(self, vocabulary: dict[str, int], merges: list, mark: str):
        symbols = byte_of_symbol()
        name = lambda t: (bytes(symbols[c] for c in t.removesuffix(mark)), bool(mark) and t.endswith(mark))
        self.plain: dict[bytes, int] = {}
        self.ended: dict[bytes, int] = {}
        for token, id in vocabulary.items():
            word, ends = name(token)
            (self.ended if ends else self.plain)[word] = id
        if not mark:
            self.ended = self.plain
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ranks = {(vocabulary[a], vocabulary[b]): (k, vocabulary[a + b]) for k, (a, b) in enumerate(pairs)}
        #: What each token was merged from and when; single symbols were there before.
        self.made = {id: (rank, a, b) for (a, b), (rank, id) in self.ranks.items()}
        first = [self.plain[w] for w in self.plain if len(w) == 1] + [self.ended[w] for w in self.ended if len(w) == 1]
        self.whole = dict.fromkeys(first, True)
        for rank, ((a, b), (_, id)) in enumerate(self.ranks.items()):
            self.whole[id] = self.whole.get(a, False) and self.whole.get(b, False) and self.apart(a, b, rank)
        usable = lambda table: {w: id for w, id in table.items() if id in self.whole}
        plain, ended = usable(self.plain), usable(self.ended)
        #: Of each ending of a token: the token that it is itself, going on and ending a word. A longer match than any of these cannot begin.
        self.parts = {w[i:]: (plain.get(w[i:]), ended.get(w[i:])) for w in (*plain, *ended) for i in range(len(w))}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.known = 0

    def apart(self, a: int, b: int, until: float = math.inf) -> bool:
        """Whether no merge of a rank below ``until`` joins neighbours a and b, each whole: look back through what stood at their border, undoing the later merge first."""
        ranks, made = self.ranks, self.made
        while True:
            joint = ranks.get((a, b))
            if joint is not None and joint[0] < until:
                return False
            one, two = made.get(a), made.get(b)
            if one is not None and (two is None or one[0] > two[0]):
                until, a = one[0], one[2]
            elif two is not None:  # of equal ranks the left merges first
                until, b = two[0] + 1, two[1]
            else:
                return True

    def agree(self, a: int, b: int) -> bool:
        """Whether the encoding of a and b together is a and b."""
        if self.known >= MEMO:
            self.pairs.clear()
            self.known = 0
        self.known += 1
        fits = self.pairs.setdefault(a, {})[b] = self.whole[b] and self.apart(a, b)
        return fits

    def extend(self, word: bytes, lasts: list[int], counts: list[int], ends: list[int], wanted: range) -> None:
        """Last tokens and counts of the prefixes of ``wanted`` lengths, from those of shorter ones; into ``ends`` the counts of those that end the word at a whole character."""
        parts, pairs, whole, size = self.parts.get, self.pairs, self.whole, len(word)
        for i in wanted:
            found, k = [], 1  # tokens that end here, from the shortest
            while k <= i and (part := parts(word[i - k : i])) is not None:
                found.append(part)
                k += 1
            want, stop = None, None if i == size or word[i] & 0xC0 != 0x80 else False
            for goes, ended in reversed(found):  # the right token is mostly the longest
                k -= 1
                if goes is None and ended is None:
                    continue
                last = lasts[i - k]
                near = pairs.get(last, _NONE)
                if want is None and goes is not None:
                    fits = whole[goes] if k == i else near.get(goes)
                    if self.agree(last, goes) if fits is None else fits:
                        want = goes
                        counts.append(counts[i - k] + 1)
                        if stop is not None:
                            break
                if stop is None and ended is not None:
                    fits = whole[ended] if k == i else near.get(ended)
                    if self.agree(last, ended) if fits is None else fits:
                        stop = ended
                        ends.append(counts[i - k] + 1)
                        if want is not None:
                            break
            if want is None or stop is None:
                raise ValueError(f"the vocabulary has no encoding for {word[:i]!r}")
            lasts.append(want)

    def tables(self, word: bytes) -> tuple[list[int], list[int], list[int]]:
        """Last tokens and counts of all prefixes that go on, and counts of those that end."""
        lasts, counts, ends = [-1], [0], []
        self.extend(word, lasts, counts, ends, range(1, len(word) + 1))
        return lasts, counts, ends

    def prefixes(self, word: str) -> list[int]:
        """Counts of the first 1, 2, ... characters of a word, each as a word of its own."""
        return self.tables(word.encode())[2]


_NONE: dict[int, bool] = {}


class PrefixCounter:
    """Counts of every prefix of texts, for one vocabulary file."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        spec = json.loads(file)
        model, self.library = spec["model"], Tokenizer.from_str(file)
        steps = spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"} or not split["invert"]:
            raise ValueError("only BPE vocabularies over NFC, lower case and words by a pattern are read")
        self.words = Words(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.split = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) or r"(?!)")
        self.opens = {s[0] for s in special}
        self.memo: dict[str, np.ndarray] = {}
        #: Characters that the library normalises and splits as this module does; none of them grows in lower case.
        self.usual: set[str] = set()
        self.odd: set[str] = set()
        #: By code point: whether it is in no piece.
        self.space = np.zeros(sys.maxunicode + 1, bool)

    def sort(self, chars: set[str]) -> None:
        """Compare characters not met before with the library, each between letters and by itself."""
        for c in chars:
            text = f"a{c} {c}{c}"
            plain = text.replace("Σ", "σ").lower()
            theirs = self.library.normalizer.normalize_str(text)
            same = len(plain) == len(text) and self.split.findall(plain) == self.theirs(theirs)
            self.space[ord(c)] = not self.theirs(c)
            (self.usual if same else self.odd).add(c)

    def word(self, piece: str) -> bytes:
        """Counts of a piece's first 1, 2, ... characters, as 32-bit integers."""
        known = self.words.prefixes(piece)
        inner = self.split.findall(piece[:-1]) if len(piece) <= 3 else ()
        if len(inner) > 1:  # a contraction: cut short it is an apostrophe and a word
            known[len(piece) - 2] = sum(self.words.prefixes(x)[-1] for x in inner)
        out = np.array(known, np.int32).tobytes()
        if len(piece) <= LONG:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = out
        return out

    def plain(self, text: str, pieces: list[str]) -> np.ndarray:
        """Counts of all prefixes of a normalised text of these pieces; what lies between them is white space."""
        if not pieces:
            return np.zeros(len(text) + 1, np.int32)
        known = self.memo.get
        local = np.frombuffer(b"".join([known(p) or self.word(p) for p in pieces]), np.int32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = local[np.cumsum(sizes) - 1]
        before = np.cumsum(whole) - whole
        counts = np.zeros(len(local) + 1, np.int32)
        counts[1:] = local + np.repeat(before, sizes)
        within = np.zeros(len(text) + 1, np.int64)
        within[1:] = ~self.space[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return counts[np.cumsum(within)]

    def size(self, text: str) -> int:
        """Tokens of a normalised text."""
        return sum(self.words.prefixes(p)[-1] for p in self.theirs(text))

    def clusters(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text whose characters combine, grow in lower case, or are classed otherwise by the library."""
        form = self.library.normalizer.normalize_str
        # cut before characters that never change what stands before them
        cuts = [i for i, c in enumerate(text) if unicodedata.combining(c) == 0 and c not in joining()]
        cuts = sorted({0, *cuts, len(text)})
        chunks = [form(text[a:b]) for a, b in zip(cuts, cuts[1:])]
        whole = "".join(chunks)
        self.sort(set(whole) - self.usual - self.odd)
        pieces = [(a, whole[a:b]) for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(whole)]
        known = self.plain(whole, [p for _, p in pieces])
        out, at, n = np.zeros(len(text) + 1, np.int32), 0, 0
        held: tuple = (-1, None)
        for (a, b), chunk in zip(zip(cuts, cuts[1:]), chunks):
            for i in range(a + 1, b + 1):
                own = chunk if i == b else form(text[a:i])
                if whole.startswith(own, at):
                    out[i] = known[at + len(own)]
                    continue
                # the last word that may change, and the one before for contractions
                while n < len(pieces) and pieces[n][0] + len(pieces[n][1]) < at:
                    n += 1
                first = pieces[n][0] if n < len(pieces) and pieces[n][0] < at else at
                if at - first <= LONG:
                    back = pieces[n - 1] if 0 < n <= len(pieces) else (first, "")
                    begin = back[0] if back[0] + len(back[1]) == first and len(back[1]) <= 2 else first
                    out[i] = known[begin] + self.size(whole[begin:at] + own)
                    continue
                # a long word goes on from its tables
                if held[0] != first:
                    data = pieces[n][1].encode()
                    held = first, (data, *self.words.tables(data)[:2])
                data, lasts, counts = held[1]
                same = next((k for k in range(len(own), 0, -1) if len(self.theirs(whole[at - 1 : at] + own[:k])) == 1), 0)
                head = data[: len(whole[first:at].encode())]
                out[i] = known[first] + self.goes_on(head, own[:same].encode(), lasts, counts) + self.size(own[same:])
            at += len(chunk)
        return out

    def goes_on(self, head: bytes, more: bytes, lasts: list[int], counts: list[int]) -> int:
        """Tokens of a word of which the tables of ``head`` are known."""
        n, ends = len(head), []
        if not more:
            return self.words.prefixes(head.decode())[-1]
        self.words.extend(head + more, lasts[: n + 1], counts[: n + 1], ends, range(n + 1, n + len(more) + 1))
        return ends[-1]

    def theirs(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def ordinary(self, text: str, chars: set[str]) -> np.ndarray:
        """Counts of all prefixes of a text without special tokens."""
        if self.odd.isdisjoint(chars) and unicodedata.is_normalized("NFC", text):
            lower = (text.replace("Σ", "σ") if "Σ" in chars else text).lower()
            return self.plain(lower, self.split.findall(lower))
        return self.clusters(text)

    def __call__(self, text: str) -> np.ndarray:
        chars = set(text)
        new = chars - self.usual - self.odd
        if new:
            self.sort(new)
        if self.opens.isdisjoint(chars):
            return self.ordinary(text, chars)
        out, at = [np.zeros(1, np.int32)], 0
        for found in self.special.finditer(text):
            # all but its last character is ordinary text when the text is cut within a special token
            own = self.ordinary(text[at : found.end() - 1], chars)
            out += [own[1:] + out[-1][-1], own[found.start() - at : found.start() - at + 1] + out[-1][-1] + 1]
            at = found.end()
        return np.concatenate([*out, self.ordinary(text[at:], chars)[1:] + out[-1][-1]])


@functools.cache
def joining() -> frozenset[str]:
    """Starters that may combine with what stands before them: those within a canonical decomposition."""
    inner = (c for i in range(sys.maxunicode + 1) for c in unicodedata.normalize("NFD", chr(i))[1:])
    return frozenset(c for c in inner if unicodedata.combining(c) == 0)


#: By the file's digest: a worker's counter for an earlier vocabulary may not be taken for this one's.
_COUNTERS: dict[str, PrefixCounter] = {}


def prefix_counts(df: DataFrame, path: str, text: str = "text", counts: str = "counts") -> DataFrame:
    """``df`` with ``counts array<int>``: the tokens of the text's first 0, 1, ... characters. ``path``: a vocabulary file of the tokenizers library."""
    with open(path, encoding="utf-8") as lines:
        file = lines.read()
    name, file = hashlib.sha256(file.encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(file)
    df = df.drop(counts)
    schema = StructType([*df.schema.fields, StructField(counts, ArrayType(IntegerType()))])
    column = df.columns.index(text) if text in df.columns else df.columns.index(df.select(text).columns[0])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[name] = PrefixCounter(file.value)
        counter = _COUNTERS[name]
        for batch in batches:
            texts, begin, held, size = batch.column(column), 0, [], 0
            for i, value in enumerate(texts):
                held.append(counter(value.as_py() or ""))
                size += 4 * len(held[-1])
                if size >= 4 * SLICE or i == len(texts) - 1:
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    array = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    part = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, array], names=[*part.schema.names, counts])
                    begin, held, size = i + 1, [], 0

    return df.mapInArrow(counted, schema)


def total(counts: Column | str = "counts") -> Column:
    """Tokens of the whole text."""
    return F.element_at(counts, -1)


def count_at(characters: Column | int, counts: Column | str = "counts") -> Column:
    """Tokens of the text's first characters; of the whole text if it has fewer."""
    n = F.lit(characters) if isinstance(characters, int) else characters
    return F.element_at(counts, (F.least(F.greatest(n, F.lit(0)), F.size(counts) - 1) + 1).cast("int"))


def longest_within(budget: Column | int, counts: Column | str = "counts") -> Column:
    """Characters of the longest prefix of at most so many tokens. Counts may fall as a prefix grows, so this is the last such place, not the first excess."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= limit, i)))


def truncated(budget: Column | int, text: str = "text", counts: str = "counts") -> Column:
    """The longest prefix of at most so many tokens."""
    return F.substring(F.col(text), F.lit(1), longest_within(budget, counts))
