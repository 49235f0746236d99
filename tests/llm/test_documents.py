"""Operators over documents against brute force, on messy and on empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import tokenizers

from locusframe.llm import bpe, exact_dedup, jaccard, licenses, lines, mixing, repeats, toxicity

LAST = np.iinfo(np.int64).max
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("width,percent,common", [(4, 85, 100), (5, 80, 1), (2, 50, 100), (2, 50, 2)])
def test_jaccard_components(messy, monkeypatch, width, percent, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = messy.select("doc_id", "text").collect()
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = components(len(sets), links)
    least = {}
    for i, c in enumerate(of):
        least.setdefault(c, []).append(rows[i][0])
    expected = [(rows[i][0], len(sets[i]), min((x for x in least[c] if x is not None), default=None)) for i, c in enumerate(of)]
    assert ordered(jaccard.jaccard_components(messy, width=width, percent=percent).select("doc_id", "n_shingles", "component_id").collect()) == ordered(expected)


def test_exact_groups(messy):
    rows = [(i, SPACE.sub(" ", t or "")) for i, t in messy.select("doc_id", "text").collect()]
    count = Counter(t for _, t in rows)
    keep = {}
    for i, t in rows:
        keep[t] = min(keep.get(t, LAST), LAST if i is None else i)
    expected = [(i, None if keep[t] == LAST else keep[t], count[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    found = exact_dedup.exact_groups(messy).collect()
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == ordered(expected)
    assert sum(r.kept for r in found) == len(count)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    whole = exact_dedup.exact_groups(messy, with_rows=True).where("kept").select("row.*")
    assert whole.columns == messy.columns and whole.count() == len(count)


def test_exact_groups_splits_long_common_heads(spark):
    head = "h" * 5000
    rows = [(1, head + "a" * 20000), (2, head + "b" * 20000), (3, head + "a" * 20000), (4, head), (5, head + "a" * 19999 + "c")]
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1), 5: (5, 1)}


def removed(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (LAST if i is None else i):
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [50, 30])
def test_removed_spans(messy, length):
    rows = messy.select("doc_id", "text").collect()
    found = repeats.removed_spans(messy, length=length)
    assert ordered(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == ordered(removed(rows, length))
    for r in found.collect():
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_maximal_repeats_of_one_text():
    text = b"abracadabra_abracadabra"
    suffixes = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0] + [next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text) or b + k >= len(text)), 0) for a, b in zip(suffixes, suffixes[1:])]
    left = [text[i - 1] if i else -1 for i in suffixes]
    found = {text[suffixes[a] : suffixes[a] + n]: sorted(suffixes[a:b]) for n, a, b in repeats.maximal_repeats(np.array(lcp), np.array(left), 2).tolist()}
    expected = {}
    for n in range(2, len(text)):
        for i in range(len(text) - n + 1):
            s = text[i : i + n]
            occ = [j for j in range(len(text) - n + 1) if text[j : j + n] == s]
            if len(occ) > 1 and len({text[j - 1 : j] if j else None for j in occ}) > 1 and len({text[j + n : j + n + 1] for j in occ}) > 1:
                expected[s] = occ
    assert found == expected


def test_repeat_groups_have_all_occurrences(spark):
    """A group is one string with all documents that have it, and every common string is in one."""
    rnd = random.Random(8)
    body = [bytes(rnd.choice(b"ab cd") for _ in range(40)) for _ in range(3)]
    text = [(bytes(rnd.choice(b"xyz") for _ in range(rnd.randint(0, 5))) + rnd.choice(body) + bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 5)))).decode() for _ in range(40)]
    text += [None, "", text[0], text[1] + text[0]]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    groups = {}
    for r in repeats.repeats(docs, length=32).collect():
        groups.setdefault((r.group, r.length), set()).add((r.doc_id, r.start))
    for (_, n), occ in groups.items():
        strings = {(text[i] or "")[s : s + n] for i, s in occ}
        assert len(strings) == 1
        s = strings.pop()
        assert {i for i, _ in occ} == {i for i, t in enumerate(text) if s in (t or "")}
    named = [((text[i] or "")[s : s + n], {d for d, _ in occ}) for (_, n), occ in groups.items() for i, s in list(occ)[:1]]
    strings = {}
    for i, t in enumerate(text):
        for a in range(len(t or "") - 31):
            strings.setdefault(t[a : a + 32], set()).add(i)
    for s, docs_of in strings.items():
        if len(docs_of) > 1:
            assert any(s in t and docs_of == d for t, d in named), s


def test_bpe_is_the_library_s(messy):
    reference = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    odd = ["<|endoftext|> a<|endoftext|>", "I'll  don't x\x1c\x85y", "日本語 and emoji 😀😀", "x" * 500, " \n\n \t"]
    encoded = bpe.encode(messy.select("text", "size").union(messy.sparkSession.createDataFrame([(t, 1) for t in odd], "text string, size long")))
    for r in bpe.decode(encoded).collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == reference.decode(ids, skip_special_tokens=False)
    for r in bpe.encode(messy.select("text"), digests=True).collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_bpe_automaton_is_merging_in_order():
    rnd = random.Random(3)
    letters = [c for c, b in bpe.byte_alphabet().items() if b in b"abc"]
    for _ in range(40):
        merges, vocabulary = [], {c: i for i, c in enumerate(bpe.byte_alphabet())}
        for _ in range(12):
            a, b = (rnd.choice([*letters, *(x + y for x, y in merges)]) for _ in range(2))
            if a + b not in vocabulary:
                merges.append((a, b))
                vocabulary[a + b] = len(vocabulary)
        automaton = bpe.Automaton(vocabulary, merges)
        for _ in range(60):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14)))
            # the lowest rank first, again after each merge
            parts, rank = list(word), {m: r for r, m in enumerate(merges)}
            while due := min(((rank[p], p) for p in zip(parts, parts[1:]) if p in rank), default=None):
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == due[1]:
                        parts[i : i + 2] = [parts[i] + parts[i + 1]]
                    i += 1
            assert automaton.encode_word(word.encode()) == tuple(vocabulary[p] for p in parts), (word, merges)


def test_license_words_and_places(messy):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert licenses.scan(messy).columns == messy.columns[:-2] + [messy.columns[-1], "licenses"]
    for r in licenses.scan(messy.select("text", "size", "row")).collect():
        words, hits = pattern.findall(lower(r.text)), []
        for phrase, label in licenses.BASE:
            p = phrase.split()
            hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        got = r.licenses
        assert (got.n_words, got.n_base) == (len(words), len(hits))
        assert (got.first_word, got.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert got.base_labels == ",".join(sorted({x for _, x in hits}))
        assert {x for _, x in hits} <= set(got.labels.split(",")) and 0 <= got.score <= 1


def license_labels(text):
    """Brute force: every match of every rule in the folded text, and what contains what."""
    low = (text or "").lower().translate(str.maketrans(*licenses.MARKS))
    low, found = re.sub(licenses.FOLDED, " ", low), []
    for r in licenses.rules():
        found += [(m.start(), m.end(), r) for m in re.finditer(r.pattern, low)]
    stay = [(a, b, r) for a, b, r in found if not any(
        x <= a and b <= y and (q.priority > r.priority or q.priority == r.priority and y - x > b - a) for x, y, q in found)]
    return ",".join(sorted({r.label for _, _, r in stay})), max((r.confidence for _, _, r in stay), default=0.0)


@pytest.mark.filterwarnings("ignore")
def test_license_labels_are_brute_force(messy, spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    texts, samples = [t for t, in messy.select("text").collect()], []

    for r in licenses.table():
        @settings(max_examples=2, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(r.pattern, fullmatch=True, alphabet=st.characters(min_codepoint=32, max_codepoint=126)))
        def draw(t):
            samples.append(t)

        draw()
    rnd = random.Random(9)
    texts += samples
    for _ in range(200):
        texts.append(rnd.choice(["\n * ", " ", "\r\n# ", "\n// "]).join(w for t in rnd.sample(samples, 3) for w in t.split(" ")))
    texts += [" ".join(x.upper() if rnd.random() < 0.3 else x for x in t.split(" ")) for t in rnd.sample(samples, 100)]
    texts += [" ".join(["plain words"] * rnd.randint(300, 1500) + rnd.sample(samples, 2) + ["more"] * rnd.randint(1, 2000) + rnd.sample(samples, 2)) for _ in range(40)]
    rows = licenses.scan(spark.createDataFrame([(t, 1) for t in texts], "text string, folded int")).collect()
    hit = 0
    for r in rows:
        labels, score = license_labels(r.text)
        if r.licenses.base_labels:  # the contract's phrases stay, whatever contains them
            labels, score = ",".join(filter(None, [labels, r.licenses.base_labels])), 1.0
        assert (set(r.licenses.labels.split(",")), r.licenses.score) == (set(labels.split(",")), score), r.text
        hit += bool(labels)
    assert hit > 700


def test_license_rules(spark):
    assert len(licenses.table()) > 400 and len({r.pattern for r in licenses.table()}) > 400
    cases = {
        "SPDX-License-Identifier: Apache-2.0": "apache-2", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "released under the GNU GPL v3": "gpl-3",
        "Licensed under the GNU Lesser General Public License, version 2.1": "lgpl-2.1", "see https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0",
        "Mozilla Public License 2.0": "mpl-2.0", "BSD license": "bsd", "Licensed under CC BY-NC 4.0.": "cc-by-nc,cc-by-nc-4.0", "we mitigate the apache attack": "", "dedicated to the public domain": "public-domain",
        "released under the terms of the GNU General Public\nLicense version 3": "gpl-3", "# Licensed under the\n# GNU General\n#   Public License, version 3": "gpl-3", "Creative  Commons\n\nAttribution-ShareAlike": "cc-by-sa",
        "www.apache.org/licenses/LICENSE-2.0": "apache-2", "opensource.org/licenses/mit": "mit",
        "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation files": "mit",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met": "bsd"}
    found = {r.text: r.licenses.labels for r in licenses.scan(spark.createDataFrame([(t, "x") for t in cases], "text string, licenses string")).collect()}
    assert found == cases


def test_mix(messy):
    sizes = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in messy.collect()]
    found = mixing.mix(messy).collect()
    assert ordered((r.doc_id, r.source, r.size) for r in found) == ordered(sizes)
    total = Counter()
    for _, s, n in sizes:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        target |= share
        for s in over:
            target[s] = 3 * total[s]
            left -= 3 * total[s]
        if not over:
            break
        free -= over
    taken = Counter()
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == total[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 48 + 0.02 * target[s]
    assert ordered(mixing.mix(messy).collect()) == ordered(found)


def test_sainte_lague_is_highest_quotients(spark):
    votes, seats = [53, 24, 23, 0, 7], 11
    quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(seats)))[:seats]
    expected = Counter(i for _, i in quotients)
    from pyspark.sql import functions as F

    found = mixing.sainte_lague(spark.createDataFrame([("g", i, v) for i, v in enumerate(votes)], "g string, i int, v long"), ["g"], "i", "v", F.lit(seats)).collect()
    assert {r.i: r.quota for r in found} == {i: expected.get(i, 0) for i in range(len(votes))}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_dedup_lines(messy, spark):
    near = "this line is long enough to count"
    more = [(50, near), (51, near.replace("long", "lonng")), (52, near.replace("is", "iz").replace("to", "too").replace("count", "kount")), (53, "short\nshort"), (54, "\n".join([near[:-1], "é" * 20, "é" * 19 + "x"]))]
    docs = messy.select("doc_id", "text").distinct().union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = docs.collect()
    at = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\r\v\f"):
                at.setdefault(x, []).append((LAST if i is None else i, k))
    names = list(at)
    of = components(len(names), [(a, b) for a in range(len(names)) for b in range(a) if min(len(names[a]), len(names[b])) >= 16 and abs(len(names[a]) - len(names[b])) <= 2 and distance(names[a], names[b]) <= 2])
    head = {}
    for x, c in zip(names, of):
        head[c] = min(head.get(c, (LAST, LAST)), min(at[x]))
    place = dict(zip(names, of))
    expected = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(all_lines) if x not in place or head[place[x]] == (LAST if i is None else i, k)]
        expected.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert ordered(lines.dedup_lines(docs, with_text=False).collect()) == ordered(expected)


def test_common_segments_are_not_expanded(spark, monkeypatch):
    """Lines that share a third but aren't linked: pairs in proportion to the lines, links whole."""
    rnd, pairs = random.Random(5), []
    found = lines.near_lines
    monkeypatch.setattr(lines, "near_lines", lambda p, *rest: pairs.append(p.count()) or found(p, *rest))
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    body = lambda: "".join(rnd.choice(alphabet) for _ in range(20))
    text = ["the very same head: " + body() for _ in range(2000)]
    text += [x[:25] + "#" + x[26:] for x in text[:300]] + [x[:22] + x[23:39] + "zz" + x[39:] for x in text[100:200]]
    near = lines.dedup_lines(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).where("n_removed = 1")
    assert {r.doc_id for r in near.collect()} >= set(range(2000, 2300)) and near.count() >= 300
    assert sum(pairs) < 100 * len(text)


def test_blocked_lines_are_brute_force(spark, monkeypatch):
    """Every group goes to blocks of a few lines each."""
    from locusframe.llm import common

    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(lines, "ROWS", 10)
    rnd = random.Random(11)
    text = list(dict.fromkeys("xyxyxyxyxyxy" + "".join(rnd.choice("ab") for _ in range(rnd.randint(4, 9))) for _ in range(160)))
    of = components(len(text), [(a, b) for a in range(len(text)) for b in range(a) if distance(text[a], text[b]) <= 1])
    first = {c: k for k, c in reversed(list(enumerate(of)))}
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), edits=1)
    assert {r.doc_id for r in got.collect() if not r.n_removed} == set(first.values())


def test_lines_that_are_not_utf8(spark):
    rows = spark.sql("select 1L as doc_id, cast(unhex(concat('FF', hex('a line that is long enough'))) as string) as text union all select 2, cast(unhex(concat('FE', hex('a line that is long enough'))) as string)")
    assert [r.n_removed for r in lines.dedup_lines(rows).orderBy("doc_id").collect()] == [0, 1]


def test_product_is_the_overlaps(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 400, rnd.integers(1, 200))).astype(np.uint64) for _ in range(90)]
    assert jaccard.product(sets).tolist() == [[len(np.intersect1d(a, b)) if i != j else jaccard.product(sets)[i, j] for j, b in enumerate(sets)] for i, a in enumerate(sets)]


def test_common_shingles_are_not_expanded(spark, monkeypatch):
    """Documents of passages that many share: pairs in proportion, links as by brute force."""
    rnd, pairs = random.Random(6), []
    found = jaccard.linked
    monkeypatch.setattr(jaccard, "linked", lambda p, *rest: pairs.append(p.count()) or found(p, *rest))
    monkeypatch.setattr(jaccard, "ROWS", 64)
    monkeypatch.setattr(jaccard, "FEW", 8)
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(30)]
    text = [" ".join(passages[k] for k in sorted(rnd.sample(range(30), 6))) for _ in range(600)]
    text += [t + " more words here" for t in text[:100]]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in text)]
    of = components(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    low = {c: k for k, c in reversed(list(enumerate(of)))}
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), width=4, percent=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: low[c] for k, c in enumerate(of)}
    assert sum(pairs) < 200 * len(text)


def test_edit_within():
    rnd = np.random.default_rng(1)
    pairs = [(rnd.integers(0, 4, rnd.integers(0, 30)).astype(np.uint32), rnd.integers(0, 4, rnd.integers(0, 30)).astype(np.uint32)) for _ in range(300)]
    pairs += [(a, np.delete(a, rnd.integers(0, len(a)))) for a, _ in pairs if len(a)]
    for edits in (1, 2, 3):
        found = lines.edit_within([a for a, _ in pairs], [b for _, b in pairs], edits)
        assert found.tolist() == [distance(a.tolist(), b.tolist()) <= edits for a, b in pairs]


def test_fuzzy_trie():
    terms = ("idiot", "worthless", "scum", "disgustingly", "lowe*")
    trie = toxicity.FuzzyTrie(terms)
    for word in ("idiot", "idot", "idiiot", "ixiot", "xdiotx", "idi", "scum", "scumm", "worthles", "wrothless", "disgstngly", "disgusting", "lowe", "lower", "lowest", "xlower", "", "worth"):
        best = min((distance(word, t) for t in terms if t[-1] != "*" and distance(word, t) <= toxicity.edits(t)), default=-1)
        expected = 0 if word.startswith("lowe") and len(word) > 4 else best
        assert trie.errors(word) == expected, word


def test_toxicity_learns_and_weighs_context(spark):
    rnd = random.Random(4)
    plain = [f"w{k}" for k in range(200)]
    text = lambda *insults: " ".join(x for w in rnd.sample(plain, 30) for x in ([w, rnd.choice(insults)] if insults and rnd.random() < 0.15 else [w]))
    good = [(i, text(), 0) for i in range(300)]
    bad = [(1000 + i, "you blackguard " + text("blackguard", "moronic"), 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in good + bad] + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert "blackguard" in model.terms and "the" not in model.terms
    tests = {"plain": "the river and the hill", "abuse": "you blackguard, you moronic blackguard", "typo": "you blackgard, you moronc blackgurd", "quote": 'he said "blackguard" in the play about the hill and the mill by the river', "empty": "", "none": None}
    found = {r.name: r.score for r in toxicity.score(spark.createDataFrame(list(tests.items()), "name string, text string"), model).collect()}
    assert found["abuse"] > 0.9 and found["typo"] > 0.3 and found["plain"] < 0.3 and found["empty"] == found["none"] < 0.3 and found["quote"] < found["abuse"]


def test_quotations():
    spans = lambda t: [t[a:b] for a, b in toxicity.quotations(t)]
    long = "far " * 200
    assert spans(f"he “{long}fool” no «a» „b“ or „c” then") == [f"“{long}fool”", "«a»", "„b“", "„c”"]
    assert spans(f'say "{long}x" and "y\nz "w" “open “in” «never') == [f'"{long}x"', '"w"', "“in”"]
    assert spans("«a “b” c» ” » «") == ["«a “b” c»"] and spans("") == []


def test_toxicity_learns_contexts(spark):
    rnd = random.Random(6)
    say = lambda n: " ".join(f"w{rnd.randint(0, 300)}" for _ in range(n))
    bad = [f"{say(8)} listen blackguard {say(8)} blackguard moronic {say(6)}" for _ in range(150)]
    good = [f"{say(10)} blackguard glossary {say(10)}" for _ in range(60)] + [say(25) + " listen " * (k % 2) for k in range(500)]
    rows = [(i, t, int(i < len(bad))) for i, t in enumerate(bad + good)]
    model = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "blackguard" in model.terms and model.report == ("glossary",) and "listen" in model.address
    scorer = toxicity.Scorer(model)
    assert scorer.score("a blackguard glossary of the trade") < scorer.score("listen blackguard the trade is")


def test_toxicity_counts_copies_once(spark):
    rnd = random.Random(4)
    text = lambda: " ".join(f"w{rnd.randint(0, 200)}" for _ in range(30))
    rows = [(i, text(), 0) for i in range(200)] + [(500 + i, "you blackguard " + text(), 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once = toxicity.fit(docs, labels)
    assert once.terms and toxicity.fit(docs.union(docs.where("doc_id < 100")).union(docs.where("doc_id > 520")), labels.union(labels)) == once


def test_toxicity_without_labels(messy, spark):
    model = toxicity.fit(messy, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    scored = toxicity.score(messy, model)
    assert scored.columns.count("score") == 1 and scored.count() == messy.count() and all(0 <= r.score < 0.3 for r in scored.collect())


@pytest.mark.parametrize("run", [
    jaccard.jaccard_components, exact_dedup.exact_groups, repeats.removed_spans, bpe.encode, licenses.scan, mixing.mix, lines.dedup_lines,
    lambda d: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "1 as toxic")))])
def test_empty_table(nothing, run):
    assert run(nothing).collect() == []
