"""License scans by ordered signature rules; DataFrame functions only, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_runs, documents
from .license_rules import Rule, table

#: Separator bytes of the word contract, upper-case letters counted as word characters.
SEP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Phrases that the contract fixes, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


#: Every text that a rule or base phrase fits has one of these anywhere, or of the others at the begin of a word.
GATE = ("licen", "copyright")
WORDS = (r"\b(?:a(?:gpl|pache|dvertising)|b(?:sd|eer)|c(?:c0|c[\s-]+by|ddl|ecill|onfidential|reative\s+commons|reativecommons)|e(?:ndorse|pl(?![a-uw-z])|upl|ric\s+young|clipse\.org)|g(?:pl|fdl|nu\.org)|in(?:variant\s+sections)"
         r"|l(?:gpl|ppl|inking\s+this)|m(?:pl(?![a-uw-z])|it\s+no\s+attribution|it-0|ulan|isrepresented)|nasa\s+open|o(?:dbl|pen\s*rail|pen\s+data\s+commons|pendatacommons)|p(?:ermission|ermitted|erl|ublic\s+domain|roprietary)"
         r"|r(?:edistribut|eserved|uby)|s(?:pdx|oftware|cripts\.sil)|terms\s+and\s+conditions|un(?:encumbered|authorized)|wtfpl|0bsd)")
#: What folding makes one space, and the quotation marks that it makes straight.
FOLDED = r"[ \t\n\x0B\f\r]+(?:(?:[*#/;|>!%]{1,3}|--)[ \t\n\x0B\f\r]+)*"
MARKS = ("\u201c\u201d\u201e\u00ab\u00bb\u2018\u2019\u0060\u00b4", "\"\"\"\"\"\u0027\u0027\u0027\u0027")


def rules() -> list[Rule]:
    """The signature table and the base phrases, in order of priority."""
    base = [Rule(label, 4, 1.0, (words.split()[-1],), r"(?<![^%s])%s(?![^%s])" % (SEP, f"[{SEP}]+".join(words.split()), SEP)) for words, label in BASE]
    return base + table()


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def gate(text: Column) -> Column:
    return any_of(text, GATE) | F.rlike(text, F.lit(WORDS))


#: Code points of a piece, and of what it sees on either side: more than any match is long.
PIECE, BESIDE = 6144, 1024


def pieces(text: Column) -> Column:
    """array<struct<text, skip, size, at>>: the text in consecutive pieces, each with its surroundings; those without a license word are left out.

    skip is the length of what comes before the piece in text, at the piece's place in the whole.
    """
    def one(blocks: Column) -> Column:
        def around(b: Column, i: Column) -> Column:
            before = F.coalesce(F.right(F.get(blocks, i - 1), F.lit(BESIDE)), F.lit(""))
            after = F.coalesce(F.left(F.get(blocks, i + 1), F.lit(BESIDE)), F.lit(""))
            return F.struct(F.concat(before, b, after).alias("text"), F.length(before).alias("skip"), F.length(b).alias("size"), (i * PIECE).alias("at"))

        return F.filter(F.transform(blocks, around), lambda p: gate(p["text"]))

    return bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), one)


def detections(piece: str) -> str:
    """SQL of array<struct<start, back, low, label, confidence>>: every match of every rule that a keyword of its lets through.

    piece: the name of one of pieces(); matches that start in it count, their places are those in
    the whole text. Patterns are literals, compiled once; rules with the same keywords are behind
    one test for them. A match's place is what split() leaves before it.
    """
    text = f"{piece}.text"
    behind: dict[tuple[str, ...], list[Rule]] = {}
    for r in rules():
        behind.setdefault(r.keywords, []).append(r)
    groups = []
    for keywords, some in behind.items():
        one = ", ".join(
            f"if({text} rlike r'{r.pattern}', named_struct('label', '{r.label}', 'low', {-r.priority}, 'confidence', {r.confidence}D, 'gaps', split({text}, r'{r.pattern}', -1), "
            f"'hits', regexp_extract_all({text}, r'{r.pattern}', 0)), null)" for r in some)
        groups.append(f"if({' or '.join(f"contains({text}, '{k}')" for k in keywords)}, array({one}), null)")
    spans = f"""aggregate(sequence(0, size(r.hits) - 1), named_struct('at', 0, 'out', cast(array() as array<struct<start:bigint,back:bigint,low:int,label:string,confidence:double>>)),
        (a, i) -> named_struct('at', a.at + length(get(r.gaps, i)) + length(get(r.hits, i)), 'out', array_append(a.out, named_struct(
            'start', cast(a.at + length(get(r.gaps, i)) as bigint), 'back', -cast(a.at + length(get(r.gaps, i)) + length(get(r.hits, i)) as bigint), 'low', r.low, 'label', r.label, 'confidence', r.confidence))), a -> a.out)"""
    fits = f"filter(flatten(filter(array({', '.join(groups)}), g -> g is not null)), r -> r is not null)"
    own = "filter(flatten(transform({fits}, r -> {spans})), d -> d.start >= {p}.skip and d.start < {p}.skip + {p}.size)".format(fits=fits, spans=spans, p=piece)
    return f"transform({own}, d -> named_struct('start', d.start - {piece}.skip + {piece}.at, 'back', d.back + {piece}.skip - {piece}.at, 'low', d.low, 'label', d.label, 'confidence', d.confidence))"


def surviving(found: Column) -> Column:
    """array<struct<label, confidence>> of the detections that aren't suppressed.

    A detection goes if a longer or equal interval of a higher priority, or a longer one of its
    own, contains it. Sorted by start, longest and highest first, one pass keeps the furthest stop
    seen of each priority and where the first such detection starts: what contains a detection
    comes before it.
    """
    kept = "array<struct<label:string,confidence:double>>"
    levels = range(5)
    start = F.struct(*[F.lit(-1).cast("long").alias(f"{x}{k}") for x in "ps" for k in levels], F.array().cast(kept).alias("out"))

    def step(acc: Column, d: Column) -> Column:
        stop, priority = -d["back"], -d["low"]
        over = F.lit(False)
        for k in levels:
            over = over | ((priority < k) & (acc[f"p{k}"] >= stop))
            over = over | ((priority == k) & ((acc[f"p{k}"] > stop) | ((acc[f"p{k}"] == stop) & (acc[f"s{k}"] < d["start"]))))
        out = F.when(over, acc["out"]).otherwise(F.array_union(acc["out"], F.array(F.struct(d["label"].alias("label"), d["confidence"].alias("confidence")))))
        further = [(priority == k) & (stop > acc[f"p{k}"]) for k in levels]
        return F.struct(*[F.when(further[k], stop).otherwise(acc[f"p{k}"]).alias(f"p{k}") for k in levels],
                        *[F.when(further[k], d["start"]).otherwise(acc[f"s{k}"]).alias(f"s{k}") for k in levels], out.alias("out"))

    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, text: str = "text", column: str = "licenses") -> DataFrame:
    """Add the struct `column` to docs; other columns stay, one of that name is replaced.

    licenses: n_words, n_base, first_word, last_word, base_labels, labels, score, found (the
    surviving (label, confidence) pairs). Words and base places follow the contract of op6. The
    signature rules see the whole text, folded so that line ends and comment marks don't matter;
    only texts with a license word are folded. Score: the highest confidence of what was found,
    1 for a base place, else 0.

    Null or empty text: no words, no places, labels "" and score 0. Repeated rows are scanned each
    for itself; very long texts are read whole. An empty table gives an empty result.
    """
    own = "_scan"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = "_" + own
    row, low_, folded_, found_ = (f"{own}_{c}" for c in ("row", "low", "folded", "found"))
    body = F.coalesce(F.col(f"{row}.`{text}`"), F.lit(""))
    phrase = "|".join(f"[{SEP}]++".join(words.split()) for words, _ in BASE)
    phrase = rf"(?<![^{SEP}])(?i:{phrase})(?![^{SEP}])"
    hits = lambda low: F.when(any_of(low, ("license", "cc")), F.regexp_extract_all(body, F.lit(phrase), F.lit(0))).otherwise(F.array().cast("array<string>"))
    hit_label = lambda h: F.when(F.lower(h).like("u%"), F.lit("mit")).when(F.lower(h).like("a%"), F.lit("apache-2")).otherwise(F.lit("cc-by-nc"))
    hit_words = lambda h: F.when(F.lower(h).like("c%"), F.lit(3)).otherwise(F.lit(4))
    words = lambda t: count_runs(t, f"^{SEP}", SEP)
    none = F.array().cast("array<struct<label:string,confidence:double>>")
    low = F.lower(body)
    folded = F.when(gate(F.col(low_)), pieces(F.regexp_replace(F.translate(F.col(low_), *MARKS), F.lit(FOLDED), F.lit(" "))))
    every = F.expr(f"flatten(transform({folded_}, p -> {detections('p')}))")

    def result(h: Column, f: Column, n: Column) -> Column:
        some = F.size(h) > 0
        base = F.array_distinct(F.transform(h, hit_label))
        labels = F.array_union(base, F.transform(f, lambda x: x["label"]))
        first = words(F.get(F.split(body, phrase, 2), F.lit(0)))
        last = n - words(F.element_at(F.split(body, phrase, -1), -1)) - hit_words(F.element_at(h, -1))
        return F.struct(
            n.alias("n_words"), F.size(h).cast("long").alias("n_base"),
            F.when(some, first).alias("first_word"), F.when(some, last).alias("last_word"),
            F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
            F.when(some, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(f, lambda x: x["confidence"])), F.lit(0.0))).alias("score"),
            f.alias("found"))

    x = docs.select(F.struct("*").alias(row)).withColumn(low_, low).withColumn(folded_, folded).withColumn(found_, F.coalesce(surviving(every), none))
    found = bind(hits(F.col(low_)), lambda h: bind(F.col(found_), lambda f: bind(words(body), lambda n: result(h, f, n))))
    return x.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns if c.lower() != column.lower()], found.alias(column))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"licenses.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
