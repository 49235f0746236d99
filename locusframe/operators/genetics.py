"""Variants, reads, population genetics, survival and enrichment as relational plans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import running
from .stats import div

FIELDS = {"QUAL": "quality", "TYPE": "type", "CHROM": "chrom", "FILTER": "filter", "POS": "position"}


def compile_filter(text: str) -> Column:
    """A variant filter such as `QUAL >= 30 && (TYPE == "SNV" || !FILTER == "PASS")` as a Column.

    Not binds before and, and before or. A null quality counts as 0.
    """
    tokens = re.findall(r'\s*(&&|\|\||>=|<=|==|!=|[()<>!]|"[^"]*"|[\w.+-]+)', text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"can't read filter {text!r}")
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(expected: str = "") -> str:
        nonlocal at
        if not peek() or expected and peek() != expected:
            raise ValueError(f"expected {expected or 'more'} in {text!r}")
        at += 1
        return tokens[at - 1]

    def either() -> Column:
        left = both()
        while peek() == "||":
            take()
            left = left | both()
        return left

    def both() -> Column:
        left = single()
        while peek() == "&&":
            take()
            left = left & single()
        return left

    def single() -> Column:
        if peek() == "!":
            take()
            return ~single()
        if peek() == "(":
            take()
            inner = either()
            take(")")
            return inner
        name = take()
        if name not in FIELDS:
            raise ValueError(f"no field {name!r}")
        column = F.coalesce(F.col("quality"), F.lit(0.0)) if name == "QUAL" else F.col(FIELDS[name])
        sign, word = take(), take().strip('"')
        value = F.lit(float(word)) if name in ("QUAL", "POS") else F.lit(word)
        compare = {">=": column >= value, "<=": column <= value, "==": column == value, "!=": column != value, ">": column > value, "<": column < value}
        if sign not in compare:
            raise ValueError(f"no comparison {sign!r}")
        return compare[sign]

    tree = either()
    if at < len(tokens):
        raise ValueError(f"unexpected {peek()!r} in {text!r}")
    return tree


def variant_type(ref: Column, alt: Column) -> Column:
    """SNV, MNV, insertion, deletion or complex by the lengths of the alleles."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNV").when(r == a, "MNV").when((r < a) & F.startswith(alt, ref), "INS").when((r > a) & F.startswith(ref, alt), "DEL").otherwise("COMPLEX")


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def split_alleles(df: DataFrame) -> DataFrame:
    """One row per alternative allele of alts, numbered from 0."""
    return df.select(*[c for c in df.columns if c != "alts"], F.posexplode("alts").alias("allele", "alt"))


def join_alleles(df: DataFrame) -> DataFrame:
    """The inverse of split_alleles(): alts per (chrom, position, ref) in allele order."""
    return df.groupBy("chrom", "position", "ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("allele", "alt"))), lambda x: x["alt"]).alias("alts"))


def variant_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts by type, transitions over transversions and mean quality."""
    kind = variant_type(F.col("ref"), F.col("alt"))
    snv, ti = kind == "SNV", is_transition(F.col("ref"), F.col("alt"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(snv).alias("snv"), F.count_if(~snv).alias("other"), F.count_if(snv & ti).alias("ti"), F.count_if(snv & ~ti).alias("tv"),
                               div(F.count_if(snv & ti).cast("double"), F.count_if(snv & ~ti)).alias("ti_tv"), F.avg("quality").alias("quality"))


def concordance(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many keyed rows are in both sets, only in a, only in b, and the Jaccard share."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    n = x.join(y, keys, "full_outer").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
    return n.withColumn("jaccard", div(F.col("shared").cast("double"), F.col("shared") + F.col("only_a") + F.col("only_b")))


def flagstat(df: DataFrame, flag: str = "flag") -> DataFrame:
    """Counts of the SAM flag bits over all rows."""
    bit = lambda b: F.col(flag).bitwiseAND(b) != 0
    first = ~bit(0x100) & ~bit(0x800)
    paired = bit(0x1) & first
    return df.agg(F.count("*").alias("total"), F.count_if(bit(0x100)).alias("secondary"), F.count_if(bit(0x800)).alias("supplementary"), F.count_if(bit(0x400)).alias("duplicates"), F.count_if(~bit(0x4)).alias("mapped"),
                  F.count_if(paired).alias("paired"), F.count_if(paired & bit(0x40)).alias("read1"), F.count_if(paired & bit(0x80)).alias("read2"), F.count_if(paired & bit(0x2) & ~bit(0x4)).alias("proper"),
                  F.count_if(paired & ~bit(0x4) & bit(0x8)).alias("singletons"))


def mark_duplicates(df: DataFrame, keys: list[str], quality: str, tie: str) -> DataFrame:
    """Add duplicate: all but the best-quality read of each position key, ties by `tie`."""
    return df.withColumn("duplicate", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(quality), tie)) > 1)


def allele_frequencies(df: DataFrame, by: list[str]) -> DataFrame:
    """From genotypes gt 0, 1, 2 (null: missing): allele frequency, observed and expected heterozygosity, F and the Hardy-Weinberg chi squared."""
    g = lambda k: F.count_if(F.col("gt") == k).cast("double")
    x = df.groupBy(*by).agg(g(0).alias("a"), g(1).alias("h"), g(2).alias("b"), F.count_if(F.col("gt").isNull()).alias("missing"))
    n = F.col("a") + F.col("h") + F.col("b")
    p = div(2 * F.col("b") + F.col("h"), 2 * n)
    x = x.withColumn("n", n).withColumn("p", p).withColumn("expected", 2 * p * (1 - p)).withColumn("observed", div(F.col("h"), n))
    cell = lambda o, e: F.when(e > 0, F.pow(o - e, 2) / e).otherwise(0.0)
    q = 1 - F.col("p")
    chi = cell(F.col("a"), q * q * F.col("n")) + cell(F.col("h"), F.col("expected") * F.col("n")) + cell(F.col("b"), F.col("p") * F.col("p") * F.col("n"))
    return x.select(*by, F.col("n").cast("long").alias("n"), "missing", F.col("p").alias("frequency"), "observed", "expected", F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")).otherwise(0.0).alias("f"), chi.alias("hwe_chi2"))


def fst(df: DataFrame, locus: str = "locus", pop: str = "pop") -> DataFrame:
    """Nei's Fst over all loci as a ratio of sums, within [0, 1]."""
    x = allele_frequencies(df, [locus, pop])
    t = x.where("n > 0").groupBy(locus).agg((F.sum(F.col("n") * F.col("expected")) / F.sum("n")).alias("hs"), (F.sum(F.col("n") * F.col("frequency")) / F.sum("n")).alias("p"))
    t = t.withColumn("ht", 2 * F.col("p") * (1 - F.col("p"))).agg(F.sum("hs").alias("hs"), F.sum("ht").alias("ht"), F.count("*").alias("loci"))
    return t.select("loci", "hs", "ht", F.greatest(F.lit(0.0), F.least(F.lit(1.0), div(F.col("ht") - F.col("hs"), F.col("ht")))).alias("fst"))


def hudson_fst(df: DataFrame, locus: str, pop: str, gt: str, first, second) -> DataFrame:  # noqa: ANN001
    """Hudson's Fst of two populations, the ratio of sums over loci: (num, den, fst). Genotypes are 0, 1 or 2; null is missing."""
    n = lambda k: F.count(F.when(F.col(pop) == k, F.col(gt))).cast("double")
    p = lambda k: F.avg(F.when(F.col(pop) == k, F.col(gt))) / 2
    x = df.groupBy(locus).agg(n(first).alias("n1"), n(second).alias("n2"), p(first).alias("p1"), p(second).alias("p2")).where("n1 > 0 and n2 > 0")
    a, b, m, k = F.col("p1"), F.col("p2"), 2 * F.col("n1"), 2 * F.col("n2")
    x = x.select((F.pow(a - b, 2) - a * (1 - a) / (m - 1) - b * (1 - b) / (k - 1)).alias("num"), (a * (1 - b) + b * (1 - a)).alias("den"))
    return x.agg(F.count("*").alias("loci"), F.sum("num").alias("num"), F.sum("den").alias("den")).withColumn("fst", div(F.col("num"), F.col("den")))


def weir_cockerham(df: DataFrame, locus: str, pop: str, gt: str) -> DataFrame:
    """Weir and Cockerham's theta per locus from variance components within individuals, among them and among populations: (a, b, c, theta)."""
    s = df.where(F.col(gt).isNotNull()).groupBy(locus, pop).agg(F.count("*").cast("double").alias("n"), (F.avg(gt) / 2).alias("p"), F.avg((F.col(gt) == 1).cast("double")).alias("h"))
    t = s.groupBy(locus).agg(F.count("*").alias("r"), F.sum("n").alias("sum"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("n") * F.col("p")).alias("np"), F.sum(F.col("n") * F.col("h")).alias("nh"),
                             F.sum(F.col("n") * F.col("p") * F.col("p")).alias("npp")).where("r > 1")
    r, total = F.col("r"), F.col("sum")
    mean, p, h = total / r, F.col("np") / total, F.col("nh") / total
    nc = (total - F.col("squares") / total) / (r - 1)
    s2 = (F.col("npp") - total * p * p) / ((r - 1) * mean)
    inner = p * (1 - p) - (r - 1) / r * s2
    x = t.select(locus, (mean / nc * (s2 - (inner - h / 4) / (mean - 1))).alias("a"), (mean / (mean - 1) * (inner - (2 * mean - 1) / (4 * mean) * h)).alias("b"), (h / 2).alias("c"))
    return x.withColumn("theta", div(F.col("a"), F.col("a") + F.col("b") + F.col("c")))


def normalise_variants(df: DataFrame) -> DataFrame:
    """Variants (position, ref, alt, ...) trimmed to their shortest form: common last letters go first, then common first ones, one letter each stays."""
    def shared(a: Column, b: Column) -> Column:
        """How many first letters a and b share, leaving one of the shorter."""
        n = F.least(F.length(a), F.length(b)) - 1
        steps = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        return F.when(n > 0, F.coalesce(F.array_min(F.filter(F.transform(steps, lambda i: F.when(a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)), i - 1)), lambda i: i.isNotNull())), n)).otherwise(0)

    tail = shared(F.reverse("ref"), F.reverse("alt"))
    x = df.withColumn("_k", tail).withColumn("ref", F.expr("left(ref, length(ref) - _k)")).withColumn("alt", F.expr("left(alt, length(alt) - _k)")).drop("_k")
    x = x.withColumn("_k", shared(F.col("ref"), F.col("alt")))
    return x.withColumn("position", F.col("position") + F.col("_k")).withColumn("ref", F.expr("substr(ref, _k + 1)")).withColumn("alt", F.expr("substr(alt, _k + 1)")).drop("_k")


def merge_sets(sets: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """All variants of several sets once each, with the names of the sets that have them and their best quality; one shuffle."""
    every = None
    for name, df in sets.items():
        x = df.select(*key, "quality", F.lit(name).alias("_set"))
        every = x if every is None else every.union(x)
    return every.groupBy(*key).agg(F.array_sort(F.collect_set("_set")).alias("sets"), F.max("quality").alias("quality"))


def linkage(df: DataFrame, distance: int) -> DataFrame:
    """Genotype r squared of pairs of loci (integers) at most `distance` apart, over samples that have both.

    The range condition is an equi-join on buckets of `distance`.
    """
    x = df.where("gt is not null").select("locus", "sample", "gt")
    near = F.explode(F.sequence(F.floor(F.col("locus") / distance), F.floor((F.col("locus") + distance) / distance)))
    a = x.select(F.col("locus").alias("locus_a"), "sample", F.col("gt").alias("a"), near.alias("_k"))
    b = x.select(F.col("locus").alias("locus_b"), "sample", F.col("gt").alias("b"), F.floor(F.col("locus") / distance).alias("_k"))
    p = a.join(b, ["sample", "_k"]).where((F.col("locus_b") > F.col("locus_a")) & (F.col("locus_b") - F.col("locus_a") <= distance))
    spread = F.var_pop("a") * F.var_pop("b")
    return p.groupBy("locus_a", "locus_b").agg(F.count("*").alias("n"), F.when(spread > 0, F.pow(F.covar_pop("a", "b"), 2) / spread).otherwise(0.0).alias("r2"))


def nucleotide_diversity(df: DataFrame, by: list[str]) -> DataFrame:
    """pi, Watterson's theta and Tajima's D of biallelic sites (n chromosomes, k derived); n is the most common one."""
    x = df.groupBy(*by).agg(F.max("n").alias("n"), F.sum(2.0 * F.col("k") * (F.col("n") - F.col("k")) / (F.col("n") * (F.col("n") - 1))).alias("pi"), F.count_if((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("s"))
    terms = F.sequence(F.lit(1), F.col("n").cast("int") - 1)
    x = x.withColumn("a1", F.aggregate(terms, F.lit(0.0), lambda t, i: t + 1 / i)).withColumn("a2", F.aggregate(terms, F.lit(0.0), lambda t, i: t + 1 / (i * i)))
    n, s, a1, a2 = (F.col(c) for c in ("n", "s", "a1", "a2"))
    e1 = ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1
    e2 = (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2)
    return x.select(*by, "n", "s", "pi", (s / a1).alias("theta"), F.when(s > 0, (F.col("pi") - s / a1) / F.sqrt(e1 * s + e2 * s * (s - 1))).otherwise(0.0).alias("tajima_d"))


def kaplan_meier(df: DataFrame, by: list[str]) -> DataFrame:
    """Survival curve of (time, event): at risk, events, survival and Greenwood variance at each event time."""
    t = df.groupBy(*by, "time").agg(F.count("*").alias("n"), F.count_if(F.col("event")).alias("d"))
    line = W.partitionBy(*by).orderBy("time")
    t = t.withColumn("risk", F.sum("n").over(W.partitionBy(*by).orderBy(F.desc("time")))).where("d > 0")
    fall = 1 - F.col("d") / F.col("risk")
    run = line.rowsBetween(W.unboundedPreceding, 0)
    s = F.when(F.min(fall).over(run) <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.when(fall > 0, fall))).over(run)))
    g = F.sum(F.when(F.col("risk") > F.col("d"), F.col("d") / (F.col("risk") * (F.col("risk") - F.col("d"))).cast("double"))).over(run)
    return t.select(*by, "time", "risk", F.col("d").alias("events"), s.alias("survival"), (s * s * F.coalesce(g, F.lit(0.0))).alias("variance"))


def log_rank(df: DataFrame, group: str) -> DataFrame:
    """Observed and expected events per group and the statistic, the sum of (O - E)^2 / E.

    Rows at risk are running counts over range partitions; a group's own start where it starts. Event
    times and groups are paired, which is what the expected counts sum over.
    """
    t = df.groupBy("time").agg(F.count("*").alias("n"), F.count_if(F.col("event")).alias("d"))
    times = running(t, [F.desc("time")], {"risk": ("sum", F.col("n"))}).where("d > 0").select("time", "risk", "d")
    groups = df.groupBy(group).agg(F.count("*").alias("size"), F.count_if(F.col("event")).alias("observed"))
    groups = groups.withColumn("before", F.coalesce(F.sum("size").over(W.orderBy(group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = df.groupBy(group, "time").agg(F.count("*").alias("n"))
    grid = times.crossJoin(F.broadcast(groups.select(group))).select(group, "time", F.lit(0).cast("long").alias("n"), "risk", "d").union(at.select(group, "time", "n", F.lit(None).cast("long"), F.lit(None).cast("long")))
    own = running(grid, [F.asc(group), F.desc("time"), F.desc("n")], {"own": ("sum", F.col("n"))}).where("risk is not null")
    e = own.join(F.broadcast(groups), group).groupBy(group).agg(F.first("observed").alias("observed"), F.sum((F.col("own") - F.col("before")) * F.col("d") / F.col("risk")).alias("expected"))
    return e.select(group, "observed", "expected", (F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected")).alias("part"))


def q_values(df: DataFrame, score: str, decoy: str, tie: str) -> DataFrame:
    """Add fdr (decoys over targets so far, best score first, targets before decoys) and q, its least value from a row on."""
    n = running(df, [F.desc(score), F.asc(decoy), F.asc(tie)], {"_decoys": ("sum", F.col(decoy).cast("int")), "_targets": ("sum", (~F.col(decoy)).cast("int"))})
    x = n.withColumn("fdr", F.col("_decoys") / F.greatest(F.lit(1), F.col("_targets"))).drop("_decoys", "_targets")
    return running(x, [F.asc(score), F.desc(decoy), F.desc(tie)], {"q": ("min", F.col("fdr"))}).withColumn("q", F.least(F.lit(1.0), F.col("q")))


def enrichment_score(df: DataFrame, by: list[str], score: str, hit: str, tie: str) -> DataFrame:
    """Running-sum enrichment of the rows with `hit`: the greatest deviation, weighted by |score|."""
    part = W.partitionBy(*by)
    line = part.orderBy(F.desc(score), tie).rowsBetween(W.unboundedPreceding, 0)
    w = F.when(F.col(hit), F.abs(score)).otherwise(0.0)
    x = df.withColumn("_w", w).withColumn("_t", F.sum("_w").over(part)).withColumn("_m", F.sum(F.when(~F.col(hit), 1.0).otherwise(0.0)).over(part))
    x = x.withColumn("_r", F.sum(div(F.col("_w"), F.col("_t")) - F.when(F.col(hit), 0.0).otherwise(div(F.lit(1.0), F.col("_m")))).over(line))
    top, low = F.max("_r"), F.min("_r")
    return x.groupBy(*by).agg(F.count_if(F.col(hit)).alias("hits"), F.when(top >= -low, top).otherwise(low).alias("es"))


def n50(df: DataFrame, length: str, by: list[str]) -> DataFrame:
    """Contigs, total, N50, L50, N90 and auN; the threshold is the rounded-up share of the total."""
    part = W.partitionBy(*by)
    line = part.orderBy(F.desc(length)).rowsBetween(W.unboundedPreceding, 0)
    x = df.withColumn("_t", F.sum(length).over(part)).withColumn("_c", F.sum(length).over(line)).withColumn("_i", F.row_number().over(part.orderBy(F.desc(length))))
    at = lambda q, c: F.expr(f"max_by({c}, case when _c >= ceil(_t * {q}) then -_i end)")
    return x.groupBy(*by).agg(F.count("*").alias("contigs"), F.first("_t").alias("total"), at(0.5, length).alias("n50"), at(0.5, "_i").alias("l50"), at(0.9, length).alias("n90"), (F.sum(F.col(length) * F.col(length)) / F.first("_t")).alias("aun"))


def roc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One point per distinct score, best first: fpr, tpr and precision, after the start point (infinity, 0, 0, 1)."""
    t = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    x = running(t, [F.desc("threshold")], {"tp": ("sum", F.col("p")), "fp": ("sum", F.col("n"))}).crossJoin(F.broadcast(t.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))))
    x = x.select("threshold", div(F.col("fp").cast("double"), F.col("all_n")).alias("fpr"), div(F.col("tp").cast("double"), F.col("all_p")).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    return x.union(df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0, 1.0)], "threshold double, fpr double, tpr double, precision double"))


def area(points: DataFrame, x: str, y: str) -> DataFrame:
    """Trapezoid area under points ordered by threshold, best first."""
    before = running(points, [F.desc("threshold")], {"_x": ("lag", F.col(x)), "_y": ("lag", F.col(y))})
    return before.agg(F.sum((F.col(x) - F.col("_x")) * (F.col(y) + F.col("_y")) / 2).alias("auc"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts of two boolean columns with accuracy, precision, recall, F1, specificity and Matthews' coefficient."""
    t, g = F.col(truth), F.col(guess)
    n = lambda c: F.count_if(c).cast("double")
    x = df.agg(n(t & g).alias("tp"), n(~t & g).alias("fp"), n(t & ~g).alias("fn"), n(~t & ~g).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return x.select("tp", "fp", "fn", "tn", div(tp + tn, tp + fp + fn + tn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    div(tn, tn + fp).alias("specificity"), div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))
