"""Token counts that follow edits: segment trees over pre-tokens, re-encoding only what edits touch.

A byte-level BPE encodes each pre-token (a run that the tokenizer's pattern cuts off) on its own, so a
text's count is the sum over its pre-tokens. A document keeps a segment tree whose leaves are blocks
of consecutive pre-tokens, with the characters and tokens of every subtree. An edit replaces a range of
characters: the tree finds the block where the range begins, the text of the touched blocks is cut
again with the edit applied, from one block before the range until the new cuts meet an old boundary
that the edit doesn't reach and two further pre-tokens agree; those blocks are replaced and sums are
updated on the way to the root. All else keeps its counts.

The pattern decides where a pre-token begins from what follows the one before, and looks ahead past a
run of white space only; so once a cut falls on an old boundary with equal text from there on, all
later cuts are the same. One block of context before the edit covers runs that an edit extends.

Edits of a document apply in the order of ``seq``; positions count characters of the text as it is at
that time and are clipped to it. Counts per distinct pre-token are remembered in a bounded table. A null
text counts 0 tokens and edits apply to an empty text; null replacements are empty; edits without a
document are ignored; repeated documents each get all their edits. Very long texts have deeper trees. Empty
tables give no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of the byte-level vocabulary, pre-tokens of a leaf, remembered pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, MEMORY = 64, 200_000
BATCH_CHARS = 4_000_000


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a file of ranks."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Tokens of pre-tokens, remembered up to a bound."""

    def __init__(self, ranks_path: str) -> None:
        self.encode, self.known, self.cut = encoder(ranks_path).encode_ordinary, {}, regex.compile(PATTERN)

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            n = self.known[piece] = len(self.encode(piece))
        return n


class Document:
    """A text as leaves of pre-tokens under a segment tree of (characters, tokens) sums."""

    def __init__(self, text: str, count: Counter) -> None:
        self.count, self.encoded = count, 0
        pieces = count.cut.findall(text)
        self.set_leaves(self.leaves_of(pieces))

    def leaves_of(self, pieces: list[str]) -> list[tuple[list[str], int, int]]:
        out = []
        for at in range(0, len(pieces), LEAF):
            part = pieces[at : at + LEAF]
            self.encoded += len(part)
            out.append((part, sum(map(len, part)), sum(map(self.count, part))))
        return out

    def set_leaves(self, leaves: list) -> None:
        """Build all sums: node k has the children 2 k and 2 k + 1, leaves come last."""
        self.leaves = leaves
        self.size = 1
        while self.size < max(1, len(leaves)):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (_, c, t) in enumerate(leaves):
            self.chars[self.size + k], self.tokens[self.size + k] = c, t
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def update(self, k: int, leaf: tuple) -> None:
        self.leaves[k] = leaf
        at = self.size + k
        self.chars[at], self.tokens[at] = leaf[1], leaf[2]
        while at > 1:
            at //= 2
            self.chars[at], self.tokens[at] = self.chars[2 * at] + self.chars[2 * at + 1], self.tokens[2 * at] + self.tokens[2 * at + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character and where the leaf begins."""
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if char - begin >= self.chars[k] and begin + self.chars[k] < self.chars[1]:
                begin += self.chars[k]
                k += 1
        return min(k - self.size, max(0, len(self.leaves) - 1)), begin

    def text_of(self, lo: int, hi: int) -> str:
        return "".join("".join(p) for p, _, _ in self.leaves[lo:hi])

    def edit(self, start: int, end: int, replacement: str) -> None:
        start = min(max(0, start), self.chars[1])
        end = min(max(start, end), self.chars[1])
        if not self.leaves:
            self.set_leaves(self.leaves_of(self.count.cut.findall(replacement)))
            return
        lo, begin = self.leaf_at(start)
        if lo:
            lo -= 1
            begin -= self.leaves[lo][1]
        hi, far = self.leaf_at(end)
        hi = min(len(self.leaves), hi + 1)
        while True:
            old = self.text_of(lo, hi)
            # the text goes on after the region: the cuts there must be those of the whole text
            new = old[: start - begin] + replacement + old[end - begin :]
            ahead = self.text_of(hi, hi + 1)
            pieces, at, stop = [], 0, len(new)
            for m in self.count.cut.finditer(new + ahead):
                if m.end() > stop and m.start() < stop:
                    at = -1
                    break
                if m.start() >= stop:
                    break
                pieces.append(m.group())
            settled = at == 0 and (hi == len(self.leaves) or self.joins(ahead, new + ahead, stop))
            if settled:
                break
            hi = min(len(self.leaves), hi + 2)
        self.replace(lo, hi, self.leaves_of(pieces))

    def joins(self, ahead: str, whole: str, stop: int) -> bool:
        """Whether the first two cuts after the region are those of the old leaf there."""
        old = [len(p) for p in self.leaves_pieces(ahead)[:2]]
        return [m.end() - m.start() for m in self.first_two(whole, stop)] == old

    def leaves_pieces(self, ahead: str) -> list[str]:
        return self.count.cut.findall(ahead)

    def first_two(self, whole: str, stop: int) -> list:
        out = []
        for m in self.count.cut.finditer(whole, pos=stop):
            out.append(m)
            if len(out) == 2:
                break
        return out

    def replace(self, lo: int, hi: int, new: list) -> None:
        """New leaves for a range: in place where their number is the same, else all sums anew (not the counts)."""
        if len(new) == hi - lo:
            for k, leaf in enumerate(new):
                self.update(lo + k, leaf)
        else:
            self.set_leaves([*self.leaves[:lo], *new, *self.leaves[hi:]])


def counts(ranks_path: str):
    """For mapInArrow: counts before and after each document's edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks_path)
        for b in batches:
            rows = []
            for text, edits in zip(b.column("text"), b.column("edits")):
                doc = Document(text.as_py() or "", count)
                before, first = doc.n_tokens, doc.encoded
                pieces = sum(len(p) for p, _, _ in doc.leaves)
                for e in edits.as_py() or []:
                    doc.edit(e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0, e["replacement"] or "")
                rows.append((pieces, before, doc.n_tokens, doc.encoded - first, len(edits.as_py() or [])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(list(v), pa.int64()) for v in (zip(*rows) if rows else [[]] * 5)]], ["doc_id", "n_pretokens", "n_tokens", "n_tokens_after", "n_reencoded", "n_edits"])

    return run


def count_with_edits(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_tokens_after, n_reencoded, n_edits of rows (doc_id, text, edits array<struct<start,end,replacement>>)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_pretokens long, n_tokens long, n_tokens_after long, n_reencoded long, n_edits long"
    return docs.select("doc_id", "text", "edits").mapInArrow(counts(ranks_path), out)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Bring rows (doc_id, seq, start, end, replacement) to the documents as an ordered column edits."""
    e = F.struct("seq", "start", "end", "replacement")
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(e)).alias("e"))
    lists = lists.select("doc_id", F.transform("e", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.replacement.alias("replacement"))).alias("edits"))
    return docs.select("doc_id", "text").join(lists, "doc_id", "left")


def three_edits(docs: DataFrame) -> DataFrame:
    """Each document with three edits of its own: a cut at a third, a word at the middle, a line at the end."""
    n = F.length(F.coalesce("text", F.lit("")))
    e = lambda a, b, r: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(r).alias("replacement"))
    edits = F.array(e(F.floor(n / 3), F.floor(n / 3) + 12, ""), e(F.floor(n / 2), F.floor(n / 2), " inserted42"), e(n, n, "\nThe end."))
    return docs.select("doc_id", "text", edits.alias("edits"))
