"""Byte-level BPE encoding and decoding by a tokenization automaton."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, held, lean

#: The fixed pre-split of byte-level BPE, with white space spelled out as Unicode has it.
_WS = r"\t-\r " + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Words whose encoding a Python worker keeps; beyond that it starts afresh.
MEMO = 120_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if visible, else U+0100 onwards."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """A deterministic automaton that accepts exactly the BPE encodings, and byte transitions that find their paths.

    Its states are the last token read (and the start), its arcs tokens. Each merge (left, right),
    in order of rank, adds a gadget: a state for the merged token, which shows the ends of its two
    parts until a later merge hides them, and a cut in every arc from a state that shows `left` at
    its end to a token that shows `right` at its begin while that merge is due.

    compile() turns this into tables. Tokens that show `right` long enough are consecutive when
    tokens are numbered along their left parts, later merges first; so the cuts of a state are
    some intervals of token numbers. The spellings make a second automaton, over bytes, in which
    one table step per byte tells the longest token that ends there.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_alphabet()
        self.spell = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if all(c in letters for c in t)}
        never = len(merges)
        rank: dict[tuple[int, int], int] = {}
        #: What a token shows at its ends: (token, rank of the merge that hides it), innermost last.
        right: dict[int, list[tuple[int, int]]] = {}
        left: dict[int, list[tuple[int, int]]] = {}
        for c in letters:
            if c in vocabulary:
                right[vocabulary[c]] = left[vocabulary[c]] = [(vocabulary[c], never)]
        for r, (x, y) in enumerate(merges):
            self.gadget(r, vocabulary[x], vocabulary[y], vocabulary[x + y], never, rank, right, left)
        self.compile(rank, right, left)

    @staticmethod
    def gadget(r: int, a: int, b: int, whole: int, never: int, rank: dict, right: dict, left: dict) -> None:
        """Add merge r; without effect where earlier cuts leave no path that reads a and then b."""
        rank.setdefault((a, b), r)
        if whole in right or a not in right or b not in left:
            return
        for u, hidden_u in right[a]:
            for v, hidden_v in left[b]:
                earlier = rank.get((u, v), never)
                if earlier < r and earlier < hidden_u and earlier <= hidden_v:
                    return
        right[whole] = [(whole, never), (b, r), *right[b][1:]]
        left[whole] = [(whole, never), (a, r), *left[a][1:]]

    def compile(self, rank: dict, right: dict, left: dict) -> None:
        # numbers along left parts: a token, then what begins with it, by falling rank of the merge that hides it
        after: dict[int, list[tuple[int, int]]] = {}
        for t, shown in left.items():
            if len(shown) > 1:
                after.setdefault(shown[1][0], []).append((-shown[1][1], t))
        self.number = [0] * (max(self.spell) + 1)
        last: dict[int, int] = {}
        stack, n = [(t, False) for t, shown in left.items() if len(shown) == 1], 0
        while stack:
            t, done = stack.pop()
            if done:
                last[t] = n
                continue
            self.number[t] = n
            n += 1
            stack.append((t, True))
            stack += [(c, False) for _, c in sorted(after.get(t, ()), reverse=True)]
        # by left part: ranks of its merges, and the numbers of the tokens they cut
        due: dict[int, tuple[list, list, list]] = {}
        for (a, b), r in sorted(rank.items(), key=lambda x: x[1]):
            if a in right and b in left:
                children = [c for h, c in sorted(after.get(b, ())) if -h >= r]
                ranks, begins, ends = due.setdefault(a, ([], [], []))
                ranks.append(r)
                begins.append(self.number[b])
                ends.append(last[children[-1]] if children else self.number[b] + 1)
        states, begins, ends, size = sorted(right), [], [], []
        for t in states:
            held = len(begins)
            for u, hidden in right[t]:
                if u in due:
                    ranks, x, y = due[u]
                    k = bisect_left(ranks, hidden)
                    begins += x[:k]
                    ends += y[:k]
            size.append(len(begins) - held)
        # cuts of a state as intervals apart from one another
        state = np.repeat(np.array(states), size)
        lo, hi = state * (n + 1) + np.array(begins, np.int64), state * (n + 1) + np.array(ends, np.int64)
        by = np.argsort(lo, kind="stable")
        state, lo, hi = state[by], lo[by], np.maximum.accumulate(hi[by])
        new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]])) if len(lo) else np.empty(0, np.int64)
        self.cut_from = memoryview((lo[new] - state[new] * (n + 1)).astype(np.int32))
        self.cut_to = memoryview((hi[np.concatenate([new[1:] - 1, [len(hi) - 1]])] - state[new] * (n + 1) if len(lo) else hi).astype(np.int32))
        self.cuts = memoryview(np.searchsorted(state[new], np.arange(len(self.number) + 1)).astype(np.int32))
        self.bytes_table({self.spell[t]: t for t in states})

    def bytes_table(self, tokens: dict[bytes, int]) -> None:
        """Byte transitions: places in the trie of spellings, completed by those of the longest suffix that is one too."""
        child, parent, letter, level = [{}], [0], [0], [0]
        at_end: dict[int, int] = {}
        for word, t in tokens.items():
            node = 0
            for c in word:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    parent.append(node)
                    letter.append(c)
                    level.append(level[node] + 1)
                node = child[node][c]
            at_end[node] = t
        up, by, depth = np.array(parent), np.array(letter), np.array(level)
        table, suffix = np.zeros((len(child), 256), np.int32), np.zeros(len(child), np.int64)
        longest = np.full(len(child), -1, np.int32)
        longest[list(at_end)] = list(at_end.values())
        own = longest.copy()
        shorter = np.full(len(self.number), -1, np.int32)
        table[0, by[depth == 1]] = np.flatnonzero(depth == 1)
        for d in range(1, int(depth.max()) + 1):
            here = np.flatnonzero(depth == d)
            if d > 1:
                suffix[here] = table[suffix[up[here]], by[here]]
            table[here] = table[suffix[here]]
            below = np.flatnonzero((depth == d + 1))
            table[up[below], by[below]] = below
            shorter[own[here][own[here] >= 0]] = longest[suffix[here]][own[here] >= 0]
            longest[here] = np.where(own[here] >= 0, own[here], longest[suffix[here]])
        # a place that nothing follows goes on like its longest suffix: it needs no row of its own
        inner = np.zeros(len(child), bool)
        inner[up[1:]] = True
        row = np.cumsum(inner) - 1
        for d in range(1, int(depth.max()) + 1):
            here = np.flatnonzero((depth == d) & ~inner)
            row[here] = row[suffix[here]]
        self.step, self.row = memoryview(table[inner].ravel()), memoryview(row.astype(np.int32))
        self.longest, self.shorter = longest.tolist(), shorter.tolist()
        size = [0] * len(self.number)
        for word, t in tokens.items():
            size[t] = len(word)
        self.size = size

    def joins(self, x: int, y: int) -> bool:
        """Whether the arc from state x labelled y is there."""
        at, begin = self.number[y], self.cuts[x]
        k = bisect_right(self.cut_from, at, begin, self.cuts[x + 1]) - 1
        return k < begin or self.cut_to[k] <= at

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The labels of the path that spells a word.

        Exactly one path spells each prefix, so the state that it ends in is the one token that
        ends there, longest first, to which an arc leads from the state before it.
        """
        step, row, longest, shorter, size, joins = self.step, self.row, self.longest, self.shorter, self.size, self.joins
        ends: list[int] = []
        place = 0
        for i, c in enumerate(word):
            place = step[row[place] << 8 | c]
            t = longest[place]
            while size[t] <= i and not joins(ends[i - size[t]], t):
                t = shorter[t]
            ends.append(t)
        out: list[int] = []
        i = len(word)
        while i:
            out.append(ends[i - 1])
            i -= size[out[-1]]
        return tuple(out[::-1])


class Memo(dict):
    """Encodings of words met so far."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self[word] = self.automaton.encode_word(word.encode())
        return ids


class Coder:
    """Encodes whole texts and decodes ids; special tokens are taken out of texts first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.special = special
        self.at_special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.spell = self.automaton.spell | {i: t.encode() for t, i in special.items()}
        self.memo = Memo(self.automaton)

    def encode(self, text: str) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        find, at, out = self.memo.__getitem__, 0, []
        for m in self.at_special.finditer(text) if self.at_special else ():
            out += chain.from_iterable(map(find, SPLIT.findall(text[at : m.start()])))
            out.append(self.special[m[0]])
            at = m.end()
        out += chain.from_iterable(map(find, SPLIT.findall(text[at:] if at else text)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.spell.__getitem__, ids)).decode("utf-8", errors="replace")


def coder(path: str) -> Coder:
    """One per Python worker, see held()."""
    return held("bpe", path, lambda: Coder(path))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, text: str = "text", path: str | None = None, digests: bool = False) -> DataFrame:
    """Add ids array<int> to docs, or with digests n_tokens, ids_sha256 and decoded_sha256 instead.

    Ids are those of the tokenizer file at `path` (a byte-level BPE; the file must be at that
    place on every executor), with its special tokens recognised in the text. Null and empty texts
    have no ids. Texts are encoded whole; a worker holds one Arrow batch and a bounded memo of
    words. Columns of docs with the new names are replaced; rows are independent, repeated rows
    give equal results.
    """
    path = path or tokenizer_path()

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        spelled = list(map(str, range(max(c.spell) + 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [c.encode(t or "") for t in part.column(text).to_pylist()]
                columns = {n: part.column(n) for n in part.schema.names if n not in new}
                if digests:
                    columns["n_tokens"] = pa.array([len(r) for r in rows], pa.int64())
                    columns["ids_sha256"] = pa.array([hashlib.sha256(",".join(map(spelled.__getitem__, r)).encode()).hexdigest() for r in rows])
                    columns["decoded_sha256"] = pa.array([hashlib.sha256(c.decode(r).encode()).hexdigest() for r in rows])
                else:
                    columns["ids"] = pa.array(rows, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    new = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids",)
    schema = T.StructType([f for f in docs.schema if f.name not in new])
    for n in new:
        schema.add(n, T.LongType() if n == "n_tokens" else T.ArrayType(T.IntegerType()) if n == "ids" else T.StringType())
    return docs.mapInArrow(lean(ids_of), schema)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add decoded string to rows with an id array: the bytes of the arcs, invalid UTF-8 replaced. Null ids give null."""
    path = path or tokenizer_path()

    @F.pandas_udf("string")
    def texts(x):  # noqa: ANN001, ANN202
        c = coder(path)
        return x.map(lambda v: None if v is None else c.decode(v))

    return encoded.withColumn("decoded", texts(F.col(ids)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir).select("doc_id", "text"), digests=True).drop("text")
