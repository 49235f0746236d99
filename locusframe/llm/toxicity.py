"""Toxicity scores: Levenshtein automata over a lexicon trie, weighed by their context windows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, held, lean, staged

WORD = re.compile(r"[^\W_]+")
#: Quotation marks, what closes each; straight ones pair within a line.
MARK = re.compile("[“”«»„\"\n]")
CLOSES = {"”": "“„", "“": "„", "»": "«"}
#: Words that report what somebody said, and words that speak to somebody; fixed lists, to which fit() adds.
REPORT = frozenset("said says say wrote writes called calls quote quoted quotes word term dit écrit appelle sagte sagt schrieb nannte dijo dice escribió llamó".split())
ADDRESS = frozenset("you your yours youre u du dich dir dein deine ihr tu te toi vous votre ton usted tú ti tus".split())
#: Words to each side of a term that make its context window.
WINDOW = 5
#: How much a quoted or reported term counts where the labelled texts don't tell.
QUOTE_WEIGHT = 0.3
THRESHOLD = 0.3
FEATURES = 7
#: Lengths of stems that fit() tries.
STEMS = range(4, 11)


def quotations(text: str) -> list[tuple[int, int]]:
    """The outermost spans between quotation marks that close each other, however far apart, in one pass."""
    found: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    straight = -1
    for m in MARK.finditer(text):
        c, at = m[0], m.start()
        if c == "\n":
            straight = -1
        elif c == '"':
            if straight >= 0:
                found.append((straight, at + 1))
            straight = -1 if straight >= 0 else at
        else:
            k = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] in CLOSES.get(c, "")), -1)
            if k >= 0 and (c != "“" or k == len(opened) - 1):
                found.append((opened[k][1], at + 1))
                del opened[k:]
            elif c in "“«„":
                opened.append((c, at))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def edits(term: str) -> int:
    """Misspellings that a term bears: none in short words, one from 5 letters, two from 11."""
    return 0 if len(term) < 5 else 1 if len(term) < 11 else 2


class FuzzyTrie:
    """All words within edits(term) of a lexicon term: trie and Levenshtein automata as one DFA.

    A term that ends in * is a stem: it takes words that begin with it and go on, unmisspelled.

    A state is the set of (trie node, errors so far); its arcs are determinised when first taken
    and kept, so a word costs a table lookup per letter and most words die after a few.
    """

    def __init__(self, terms: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.bears: list[int] = [0]
        self.ends: list[int] = [-1]
        self.stems: set[int] = set()
        for term in terms:
            node, path = 0, [0]
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.bears.append(0)
                    self.ends.append(-1)
                node = self.children[node][c]
                path.append(node)
            if term.endswith("*"):
                self.stems.add(node)
                continue
            self.ends[node] = edits(term)
            for n in path:
                self.bears[n] = max(self.bears[n], edits(term))
        self.letters = frozenset("".join(terms))
        self.states: dict[frozenset, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accept: list[int] = []
        self.dead = self.number(frozenset())
        self.start = self.number(self.closure({(0, 0)}))
        self.within = self.number(frozenset({(-1, 0)}))
        self.accept[self.within] = 0

    def closure(self, items: set[tuple[int, int]]) -> frozenset:
        """Adds skipped letters and keeps the fewest errors of each node."""
        best: dict[int, int] = {}
        stack = list(items)
        while stack:
            node, e = stack.pop()
            if e > self.bears[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            stack += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def number(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.arcs.append({})
            self.accept.append(min((e for n, e in items if n >= 0 and e <= self.ends[n]), default=-1))
        return self.states[items]

    def arc(self, state: int, c: str) -> int:
        if state == self.within or any(e == 0 and node in self.stems for node, e in self.sets[state]):
            return self.within
        items = set()
        for node, e in self.sets[state]:
            items.add((node, e + 1))
            for letter, child in self.children[node].items():
                items.add((child, e if letter == c else e + 1))
        return self.number(self.closure(items))

    def errors(self, word: str) -> int:
        """Errors of the nearest term in reach, or -1."""
        state, arcs = self.start, self.arcs
        for c in word:
            key = c if c in self.letters else ""
            after = arcs[state].get(key)
            if after is None:
                after = arcs[state][key] = self.arc(state, key)
            if after == self.dead:
                return -1
            state = after
        return self.accept[state]


@dataclass(frozen=True)
class Model:
    """What fit() learned: terms, harmless neighbours of terms, weights of features() and last their intercept, words whose windows report a term and words whose windows address somebody."""

    terms: tuple[str, ...]
    harmless: tuple[str, ...]
    weights: tuple[float, ...]
    report: tuple[str, ...] = ()
    address: tuple[str, ...] = ()


class Scorer:
    #: Words a worker remembers before it starts afresh.
    MEMO = 200_000

    def __init__(self, model: Model):
        self.trie = FuzzyTrie(model.terms)
        self.harmless = frozenset(model.harmless)
        self.weights = np.array(model.weights)
        self.report, self.address = REPORT.union(model.report), ADDRESS.union(model.address)
        self.seen: set[str] = set()
        self.hit: dict[str, bool] = {}

    def hits(self, words: list[str]) -> bool:
        """Classify the words not met before; whether any is a term or near one."""
        some = set(words)
        fresh = some - self.seen
        if fresh:
            if len(self.seen) > self.MEMO:
                self.seen.clear()
                self.hit.clear()
                fresh = some
            for w in fresh:
                e = self.trie.errors(w)
                if e == 0 or e > 0 and w not in self.harmless:
                    self.hit[w] = e == 0
            self.seen |= fresh
        return not some.isdisjoint(self.hit)

    def features(self, text: str) -> tuple[float, ...]:
        """What the terms of a text and their windows tell.

        Log of 1 + the count of terms and of misspelled ones that are the text's own, then of those
        that it quotes or reports; share of terms among the words, share of them spoken to
        somebody, whether there are several, quoted ones weighed down.
        """
        low = text.lower()
        if not self.trie.children[0] or not self.hits(words := WORD.findall(low)):
            return (0.0,) * FEATURES
        marks = quotations(low)
        count = [[0, 0], [0, 0]]
        spoken = 0.0
        at = 0
        for i, m in enumerate(WORD.finditer(low)):
            kind = self.hit.get(m[0])
            if kind is None:
                continue
            while at < len(marks) and marks[at][1] <= m.start():
                at += 1
            around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            quoted = at < len(marks) and marks[at][0] <= m.start() or not self.report.isdisjoint(around)
            count[quoted][not kind] += 1
            spoken += (QUOTE_WEIGHT if quoted else 1.0) * (not self.address.isdisjoint(around))
        (exact, near), quoted_terms = count[0], count[1]
        weight = exact + near + QUOTE_WEIGHT * sum(quoted_terms)
        return (math.log1p(exact), math.log1p(near), math.log1p(quoted_terms[0]), math.log1p(quoted_terms[1]),
                min(1.0, 20 * weight / len(words)), spoken / weight, float(weight >= 2))

    def around(self, text: str) -> set[str]:
        """Words that stand in a window of a term."""
        words = WORD.findall(text.lower())
        if not self.trie.children[0] or not self.hits(words):
            return set()
        return {x for i, w in enumerate(words) if w in self.hit for x in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW] if x not in self.hit}

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights[:-1], self.features(text)) + self.weights[-1])
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def scorer(model: Model) -> Scorer:
    """One per Python worker, see held()."""
    return held("toxicity", model, lambda: Scorer(model))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights and intercept by Newton steps; the intercept isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    shrink = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + shrink, x.T @ (y - p) - shrink @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def tokens(text: str) -> set[str]:
    """Words and their stems, the latter marked by *."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if k < len(w)}


def contexts(text: str) -> dict[str, int]:
    """tokens() with a bit for each pair of neighbours that a token stands between."""
    words = WORD.findall(text.lower())
    found: dict[str, int] = {}
    for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        bit = 1 << zlib.crc32(f"{before} {after}".encode()) % 63
        for token in (w, *[w[:k] + "*" for k in STEMS if k < len(w)]):
            found[token] = found.get(token, 0) | bit
    return found


def evidence(n: Column, mask: Column) -> Column:
    """How many texts speak for a token: texts that have it between the same neighbours count once."""
    bits = F.bit_count(mask)
    return F.when(bits > 56, n).otherwise(F.least(n, F.round(-63 * F.log(1 - bits / 63)))).cast("long")


def lexicon(bad: DataFrame, good: DataFrame, base: float) -> tuple[str, ...]:
    """Terms by likelihood ratio, which has to beat the number of tokens tried; a stem needs three words of its own.

    bad and good: rows (word, n[, mask]). All tokens are weighed in Spark; the terms alone come to
    the driver.
    """
    bad = staged(bad.select("word", evidence(F.col("n"), F.col("mask")).alias("c1")), "bad")
    bar = math.log(bad.count() + 1) + 3
    stem = F.col("word").endswith("*")
    stems = F.filter(F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[-1])), lambda k: F.when(k < F.length("word"), F.concat(F.col("word").substr(F.lit(1), k), F.lit("*")))), lambda x: x.isNotNull())
    own = bad.where(~stem).select(F.explode(stems).alias("_s")).groupBy("_s").agg(F.count("*").alias("own"))
    p = F.col("c1") / (F.col("c1") + F.col("c0"))
    ratio = F.col("c1") * F.log(p / base) + F.when(F.col("c0") > 0, F.col("c0") * F.log((1 - p) / (1 - base))).otherwise(0.0)
    x = bad.where(F.length("word") >= 3).where("c1 > 0").join(good.select(F.col("word").alias("_w"), F.col("n").alias("c0")), F.col("word") == F.col("_w"), "left").withColumn("c0", F.coalesce("c0", F.lit(0)))
    x = x.where((p > F.greatest(F.lit(base), F.when(stem, 0.9).otherwise(0.5))) & (ratio >= bar)).join(own, F.col("word") == F.col("_s"), "left")
    gain = {r["word"]: r["ratio"] for r in x.where(~stem | (F.col("own") >= 3)).select("word", ratio.alias("ratio")).collect()}
    chosen: list[str] = []
    for w in sorted((w for w in gain if w[-1] == "*"), key=lambda w: (-gain[w], w)):
        if not any(w[:-1].startswith(x[:-1]) or x[:-1].startswith(w[:-1]) for x in chosen):
            chosen.append(w)
    heads = {x[:-1] for x in chosen}
    return tuple(sorted([*chosen, *(w for w in gain if w[-1] != "*" and not any(w[:k] in heads for k in STEMS if k < len(w)))]))


def leaning(here: DataFrame, there: DataFrame, odds: float) -> tuple[str, ...]:
    """Words of rows (word, n) that stand here so much oftener than odds that the likelihood ratio beats the number of words tried."""
    x = here.join(there.select(F.col("word").alias("_w"), F.col("n").alias("c0")), F.col("word") == F.col("_w"), "left").withColumn("c0", F.coalesce("c0", F.lit(0)))
    p = F.col("n") / (F.col("n") + F.col("c0"))
    ratio = F.col("n") * F.log(p / odds) + F.when(F.col("c0") > 0, F.col("c0") * F.log((1 - p) / (1 - odds))).otherwise(0.0)
    return tuple(sorted(r["word"] for r in x.where((p > odds) & (ratio >= math.log(here.count() + 1) + 3)).select("word").collect()))


def counted(sample: DataFrame, words_of) -> DataFrame:
    """Rows (word, n, mask): in how many texts of sample words_of finds each word, and its bits if it gives any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                n: Counter = Counter()
                mask: dict[str, int] = {}
                for t in whole.slice(at, 512).column("text").to_pylist():
                    found = words_of(t or "")
                    n.update(list(found))
                    if isinstance(found, dict):
                        for w, bits in found.items():
                            mask[w] = mask.get(w, 0) | bits
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([mask.get(w, 0) for w in n], pa.int64())], names=["word", "n", "mask"])

    found = sample.select("text").mapInArrow(lean(run), "word string, n bigint, mask bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> Model:
    """Learn terms, harmless neighbours and weights from labelled rows outside the held-out fold.

    At most `bound` labelled doc_ids are read, those that hash lowest; of these, every token that
    passes the test of lexicon() is a term: most texts that have it are toxic and the likelihood
    ratio of that beats the number of tokens tried. Equal texts count once, toxic if one is, so
    repeated rows change nothing. Only texts and labels are used, texts whole. Rows without a
    label, or a corpus with one class or none, give a model of the base rate.
    """
    train = labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 != 2")
    train = train.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    sample = docs.select("doc_id", F.col("text")).join(F.broadcast(train), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    sample = staged(sample.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model((), (), (0.0,) * FEATURES + (4.0 if n1 else -4.0,))
    base = n1 / (n1 + n0)
    bad, good = sample.where("toxic = 1"), sample.where("toxic = 0")
    found = lexicon(counted(bad, contexts), counted(good, tokens), base)
    blank = Model(found, (), (0.0,) * (FEATURES + 1))

    def neighbours(t: str) -> set[str]:
        s, words = scorer(blank), set(WORD.findall(t.lower()))
        s.hits(list(words))
        return {w for w in words if s.hit.get(w) is False}

    near = counted(good, neighbours).select("word").collect()
    model = Model(found, tuple(sorted(r["word"] for r in near)), blank.weights)
    # a window's words and, as "", that there is one
    toxic, clean = (staged(counted(x, lambda t: (w := scorer(model).around(t)) and w | {""}), "windows") for x in (bad, good))
    windows = [(x.where("word = ''").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]) for x in (toxic, clean)]
    if all(windows):
        share = windows[0] / sum(windows)
        toxic, clean = toxic.where("word != ''"), clean.where("word != ''")
        model = Model(model.terms, model.harmless, model.weights, leaning(clean, toxic, 1 - share), leaning(toxic, clean, share))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(model)
        for b in batches:
            x = np.array([s.features(t or "") for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(FEATURES)] + [b.column("toxic")], names=[*names, "toxic"])

    names = [f"x{i}" for i in range(FEATURES)]
    x = sample.mapInArrow(lean(features), ", ".join(f"{c} double" for c in names) + ", toxic int").toPandas().sort_values([*names, "toxic"]).to_numpy()
    w = logistic(x[:, :FEATURES], x[:, FEATURES])
    w[:FEATURES] = np.maximum(w[:FEATURES], 0)  # a term never speaks for a text
    if not x[:, 1].any():  # no misspelling among the labelled texts: they count like half a term
        w[1] = w[0] / 2
    for own, quoted in ((0, 2), (1, 3)):  # a quoted term never speaks more than one of the text's own
        w[quoted] = min(w[own], w[quoted]) if x[:, quoted].sum() >= 5 else QUOTE_WEIGHT * w[own]
    return Model(model.terms, model.harmless, tuple(float(v) for v in w), model.report, model.address)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Add the score (0 to 1) to docs; other columns stay, one of that name is replaced.

    Every whole text is read. Null and empty texts get the score of a text without terms. Rows are
    independent of one another.
    """
    fields = [f for f in docs.schema if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(model)
        for b in batches:
            values = pa.array([s.score(t or "") for t in b.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in fields] + [values], names=[f.name for f in fields] + [column])

    return docs.mapInArrow(lean(run), T.StructType([*fields, T.StructField(column, T.DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
