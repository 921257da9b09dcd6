"""Token counts under a byte-level BPE vocabulary, without making identifiers.

A text is split at the vocabulary's added tokens (each counts one) and then
into pieces by the byte-level splitting rule.  A piece starts as one symbol
per byte; a heap yields the adjacent pair of lowest rank, the leftmost of equal
ones, and a linked list joins it, until no pair is known.  The piece's count is
its initial symbols minus the merges.

Counts of pieces are remembered per task in a table of bounded size.  The
vocabulary file is a parameter; its merge list is read on the driver (a fixed
file of a few MB) and broadcast.

Edge cases: null text is empty and has no tokens.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm.common import col, slices

#: Unicode White_Space.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CACHE_PIECES = 500_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 characters for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def library_classes() -> dict:
    """Letters and numbers as the tokenizer library's regex engine knows them: ranges of code
    points.  Asked once, on the driver, so that counts do not depend on a worker's Unicode version."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split
    points = [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    text = "".join(map(chr, points))
    out = {}
    for name, pattern in (("letters", r"\p{L}+"), ("numbers", r"\p{N}+")):
        # what is left when the class is cut out; the gaps are the class
        rest = [span for _, span in Split(Regex(pattern), "removed").pre_tokenize_str(text)]
        starts, ends = [0, *(e for _, e in rest)], [*(s for s, _ in rest), len(points)]
        own = [points[i] for s, e in zip(starts, ends) for i in range(s, e)]
        out[name] = _ranges(own)
    return out


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(r) for r in out]


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def piece_patterns(classes: dict) -> tuple[re.Pattern, re.Pattern | None, re.Pattern]:
    """The splitting rule (contractions, then runs of letters, numbers or other marks with one leading
    space, then white space) in two forms: with this Python's letters, which is faster, and with the
    library's own; between them a pattern for characters that the two take differently (None if there are none)."""
    n = _class(classes["numbers"])
    rule = lambda letter, other: re.compile(
        rf"'(?:s|t|re|ve|m|ll|d)| ?{letter}+| ?[{n}]+| ?(?:{other})+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
    letters, numbers = ({p for a, b in classes[c] for p in range(a, b + 1)} for c in ("letters", "numbers"))
    # \w is letters, numbers and the underscore, as this Python knows them
    apart = [p for p in range(sys.maxunicode + 1) if chr(p).isalnum() != (p in letters or p in numbers)]
    fast = rule(rf"[^\W_{n}]", rf"[^\w{WHITE}{n}]|_")
    exact = rule(f"[{_class(classes['letters'])}]", f"[^{WHITE}{n}{_class(classes['letters'])}]")
    return fast, re.compile(f"[{_class(_ranges(apart))}]") if apart else None, exact


class PieceCounter(dict):
    """Piece -> number of tokens, computed when first asked for."""

    def __init__(self, ranks: dict, joined: dict, alphabet: list[str]):
        super().__init__()
        self.ranks, self.joined = ranks, joined
        self.start = [joined.get(a) for a in alphabet]

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode())
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = n
        return n

    def count(self, raw: bytes) -> int:
        symbol = [self.start[b] for b in raw]
        n = len(symbol)
        if n < 2:
            return n
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after[-1] = -1
        heap = [(r[0], i, symbol[i], symbol[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # one of the two has been merged meanwhile
            merges += 1
            symbol[i], symbol[j] = new, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := ranks.get((new, symbol[k])):
                    heapq.heappush(heap, (r[0], i, new, symbol[k], r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbol[h], new))):
                heapq.heappush(heap, (r[0], h, symbol[h], new, r[1]))
        return n - merges


def load_vocabulary(path: str) -> dict:
    """Merges (pair of symbol numbers -> rank, number of the joined symbol),
    symbol numbers and added tokens of a byte-level BPE file, and the library's character classes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    number: dict[str, int] = {}
    for a in byte_alphabet():
        number[a] = len(number)
    ranks = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        for s in (left, right, left + right):
            number.setdefault(s, len(number))
        ranks[number[left], number[right]] = (rank, number[left + right])
    added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
    return {"ranks": ranks, "symbols": {a: number[a] for a in byte_alphabet()}, "added": added,
            "classes": library_classes()}


class TokenCounter:
    def __init__(self, vocabulary: dict):
        self.pieces = PieceCounter(vocabulary["ranks"], vocabulary["symbols"], byte_alphabet())
        fast, apart, exact = piece_patterns(vocabulary["classes"])
        self.fast, self.exact, self.apart = fast.findall, exact.findall, apart
        added = vocabulary["added"]
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.is_added = set(added)

    def split(self, text: str) -> list[str]:
        if self.apart and not text.isascii() and self.apart.search(text):
            return self.exact(text)
        return self.fast(text)

    def __call__(self, text: str) -> int:
        if self.added and self.added.search(text):
            return sum(1 if part in self.is_added else sum(map(self.pieces.__getitem__, self.split(part))) for part in self.added.split(text) if part)
        return sum(map(self.pieces.__getitem__, self.split(text)))


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row per input row, whole texts."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(shared.value)
        for batch in slices(batches):
            own = [t or "" for t in col(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": col(batch, "doc_id"), "n_bytes": pa.array([len(t.encode()) for t in own], type=pa.int64()),
                "n_tokens": pa.array([count(t) for t in own], type=pa.int64())})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
