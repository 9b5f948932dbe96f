"""Soft-membership mixing of sources to target weights, with DataFrame expressions only.

A classifier trained on the label table (naive Bayes over binned text measures) gives each document a posterior over
domains. Two of the measures are sums of term weights: log-odds of toxic against clean and of high against low quality
documents, learned from the labelled texts; the TERMS of highest evidence are kept. Nonnegative document rates are fitted
by projected-gradient least squares (with momentum) so that the expected tokens of each domain, the sum of rate * tokens
* posterior, match the targets; a small pull towards rate one spreads the change over all documents. Documents of equal
measures have equal posteriors and so equal rates: the gradient is summed over the distinct combinations of measures,
which loses nothing and keeps a step small whatever the corpus; only the residuals of the few domains come to the driver.
Every ROUND steps the rates so far are written, so that the work grows with the number of steps and not with its square.

The classifier is fitted on at most TRAIN_ROWS labelled rows of each domain (a documented bound, drawn by a hash of the
id), whose ids are broadcast; measures, posteriors, totals and rates cover every document.

Targets can be out of reach: a document without any sign of a domain still has that domain's posterior, which is the
share of such documents that the labels put there. `shares` reports what is reached, `residual` in the query how far
the fitted totals are from the targets.

Defined results: null and empty texts have no tokens and fall into the lowest bins; null or unknown labels teach nothing; without
labels the posteriors are uniform; an empty table gives an empty result; documents labelled twice count twice.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.llm.base import persist, tidy

# Domains of the label table, and the token shares wanted of each.
DOMAINS = {"high_quality": "quality = 1 AND toxic = 0", "low_quality": "quality = 0 AND toxic = 0", "toxic": "toxic = 1"}
TARGETS = {"high_quality": 0.9, "low_quality": 0.1, "toxic": 0.0}
BINS, SMOOTHING, RIDGE, ITERATIONS, ROUND, TOLERANCE = 8, 0.5, 0.005, 60, 15, 1e-4
#: Labelled rows of each domain that the classifier is fitted on.
TRAIN_ROWS = 4000
SYMBOLS, BREAKS = "%&*$#!|", ".,;:?\n\t\r\x0b\x0c"
#: Further characters that end a term; words, whose number is the tokens, run on over them.
MARKS = SYMBOLS + "\"'`()[]{}<>/\\-_=+~^@0123456789\u00a0\u00a1\u00a8\u00ab\u00b4\u00b7\u00bb\u00bf\u2010\u2011\u2012\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2022\u2026\u2039\u203a\u3001\u3002\uff01\uff0c\uff1f"
SYMBOL, MARK = "\x01", "\x02"
#: Weights are whole numbers of 1 / UNIT, MOST_WEIGHT at most; the sum of MOST_PACKED of them fits into half a long.
UNIT, MOST_WEIGHT, MOST_PACKED = 1000, 10.0, (1 << 31) // 10_000 - 1
#: Terms kept, the least evidence (G squared, so that chance agreement of rare terms teaches nothing), hash slots, and
#: the edges of the bins of summed weights.
TERMS, EVIDENCE, SLOTS, EDGES = 2048, 15.0, 1 << 12, (-8.0, -3.0, -0.5, 0.5, 3.0, 8.0, 20.0)
CONTRASTS = (((2,), (0, 1)), ((0,), (1,)))  # toxic against clean, high against low quality: numbers of DOMAINS


def marked(text: Column) -> Column:
    """text with single blanks for what ends a word, SYMBOL for SYMBOLS and MARK for MARKS: one pass over the characters."""
    others = "".join(c for c in MARKS if c not in SYMBOLS)
    return F.translate(text, BREAKS + SYMBOL + MARK + SYMBOLS + others, " " * len(BREAKS + SYMBOL + MARK) + SYMBOL * len(SYMBOLS) + MARK * len(others))


def unmarked(text: Column) -> Column:
    """A marked text with blanks for all that ends a term."""
    return F.replace(F.replace(text, F.lit(MARK), F.lit(" ")), F.lit(SYMBOL), F.lit(" "))


def terms_of(text: Column) -> Column:
    """Lower-cased words, which end at MARKS too."""
    return F.array_remove(F.split(unmarked(marked(F.lower(text))), " "), "")


def slot(term: Column) -> Column:
    return F.hash(term).bitwiseAND(F.lit(SLOTS - 1))


@dataclass
class Lexicon:
    """term -> (slot, weight in each of CONTRASTS); of terms that share a slot the one of higher evidence. The tables of
    slots are literals of the plan, so they are kept small: the driver holds plans many times over."""

    weights: dict[str, tuple[int, list[float]]]

    def hits(self, terms: Column) -> Column:
        """array<int>: the slots of the known terms, as often as they stand."""
        table = [""] * SLOTS
        for term, (k, _) in self.weights.items():
            table[k] = term
        known = F.split(F.lit("|".join(table)), r"\|", -1)
        return F.transform(F.filter(terms, lambda w: F.get(known, slot(w)) == w), slot)

    def packed(self, hits: Column) -> Column:
        """array<bigint>: for each MOST_PACKED hits the sum of their weights, in units of 1 / UNIT: that of the first
        contrast plus 2 ** 32 times that of the second. One array of weights serves both."""
        table = ["0"] * SLOTS
        for k, w in self.weights.values():
            table[k] = str(sum(round(v * UNIT) << 32 * place for place, v in enumerate(w)))
        weights = F.split(F.lit(" ".join(table)), " ").cast("array<bigint>")
        parts = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / MOST_PACKED).cast("int"))
        return F.when(F.size(hits) > 0, F.transform(parts, lambda p: F.aggregate(F.slice(hits, p * MOST_PACKED + 1, F.lit(MOST_PACKED)), F.lit(0).cast("long"), lambda so_far, k: so_far + F.get(weights, k))))

    def score(self, packed: Column, contrast: int) -> Column:
        low = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
        part = low if not contrast else lambda v: F.shiftright(v - low(v), 32)
        return F.coalesce(F.aggregate(packed, F.lit(0).cast("long"), lambda so_far, v: so_far + part(v)), F.lit(0)) / float(UNIT)


def labelled(labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """(id, domain) of each usable label."""
    domain = F.coalesce(*[F.when(F.expr(condition), F.lit(k)) for k, condition in enumerate(DOMAINS.values())])
    return labels.select(F.col(label_id).cast("long").alias("id"), domain.alias("domain")).where("domain IS NOT NULL AND id IS NOT NULL")


def train_rows(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(id, domain) of at most `most` labelled rows of each domain: those whose ids a hash puts first."""
    known = labelled(labels)
    parts = [known.where(F.col("domain") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k in range(len(DOMAINS))]
    return functools.reduce(DataFrame.unionByName, parts)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Term weights from the documents of each domain that hold the term. labels: rows of `train_rows`, TRAIN_ROWS for
    each domain at most."""
    known = F.broadcast(labels)
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).join(known, "id")
    texts = persist(texts.select("domain", F.array_distinct(terms_of(F.coalesce("text", F.lit("")))).alias("terms")), "mixing-train")
    each = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = texts.select("domain", F.explode("terms").alias("term"))
    counts = counts.groupBy("term").agg(*[F.count(F.when(F.col("domain") == k, 1)).alias(f"n{k}") for k in range(len(DOMAINS))])
    evidence, weights = [], []
    for sides in CONTRASTS:
        held = [sum((F.col(f"n{k}") for k in side), F.lit(0)) for side in sides]
        whole = [sum(each.get(k, 0) for k in side) for side in sides]
        if not all(whole):
            evidence.append(F.lit(0.0))
            weights.append(F.lit(0.0))
            continue
        seen = (held[0] + held[1]) / sum(whole)
        part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
        g = 2 * sum((part(n, seen * w) + part(w - n, (1 - seen) * w) for n, w in zip(held, whole, strict=True)), F.lit(0.0))
        odds = [F.log((n + SMOOTHING) / (w + 2 * SMOOTHING)) for n, w in zip(held, whole, strict=True)]
        evidence.append(g)
        weights.append(F.when(g >= EVIDENCE, F.round(F.greatest(F.lit(-MOST_WEIGHT), F.least(F.lit(MOST_WEIGHT), odds[0] - odds[1])), 3)).otherwise(0.0))
    rows = counts.select("term", F.greatest(*evidence).alias("g"), slot(F.col("term")).alias("slot"), *[w.alias(f"w{k}") for k, w in enumerate(weights)])
    kept: dict[int, tuple[str, list[float]]] = {}
    for r in rows.where(F.col("g") >= EVIDENCE).orderBy(F.desc("g"), "term").limit(2 * TERMS).collect():
        if len(kept) < TERMS:  # the next best term takes the place of one whose slot is taken
            kept.setdefault(r["slot"], (r["term"], [r[f"w{k}"] for k in range(len(CONTRASTS))]))
    return Lexicon({term: (k, w) for k, (term, w) in kept.items()})


def measured(docs: DataFrame, id_col: str, text_col: str, carry: bool, lexicon: Lexicon) -> DataFrame:
    """id, tokens and the bins b0.. of the text's measures; with carry the row of docs under `row`.

    Words are lower-cased and separated by white space and common punctuation, all of which become single characters,
    so that splitting needs no regular expression. Terms of the lexicon weigh as often as they stand.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    keep = ["row"] * carry
    rows = docs.select(*([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []), docs[id_col].cast("long").alias("id"), text.alias("t"))
    rows = rows.select(*keep, "id", F.length("t").alias("chars"), marked(F.lower("t")).alias("t"))
    rows = rows.select(*keep, "id", "chars", (F.octet_length("t") - F.octet_length(F.replace("t", F.lit(SYMBOL), F.lit("")))).alias("symbols"), F.array_remove(F.split("t", " "), "").alias("words"), F.split(unmarked(F.col("t")), " ").alias("terms"))
    rows = rows.select(*keep, "id", "chars", "symbols", F.size("words").cast("long").alias("tokens"), F.size(F.array_distinct("words")).alias("kinds"), lexicon.hits(F.col("terms")).alias("hits"))
    rows = rows.select(*keep, "id", "chars", "symbols", "tokens", "kinds", lexicon.packed(F.col("hits")).alias("packed"))
    rows = rows.select(*keep, "id", "chars", "symbols", "tokens", "kinds", *[lexicon.score(F.col("packed"), k).alias(f"s{k}") for k in range(len(CONTRASTS))])
    n, chars = F.greatest("tokens", F.lit(1)), F.greatest("chars", F.lit(1))
    bins = [
        F.least(F.floor(F.log2(n) / 2), F.lit(BINS - 1)),
        F.least(F.floor(F.col("kinds") * BINS / n), F.lit(BINS - 1)),
        F.least(F.ceil(F.col("symbols") * 40 / chars), F.lit(BINS - 1)),
        F.least(F.floor(chars / n / 2), F.lit(BINS - 1)),
        *[sum(((F.col(f"s{k}") >= edge).cast("int") for edge in EDGES), F.lit(0)) for k in range(len(CONTRASTS))],
    ]
    # never null, and typed so: a join on nullable bins would filter by them first, measuring every text again for the filter
    return rows.select(*keep, "id", "tokens", *[F.coalesce(b.cast("int"), F.lit(0)).alias(f"b{k}") for k, b in enumerate(bins)])


MEASURES = 4 + len(CONTRASTS)


@dataclass
class Classifier:
    """prior: log prior of each domain; tables[m][domain * BINS + bin]: log likelihoods."""

    prior: list[float]
    tables: list[list[float]]

    def posterior(self) -> Column:
        """array<double>: the domains' posteriors from the columns b0.."""
        logs = [F.lit(p) + sum((F.get(_array(t), F.lit(d * BINS) + F.col(f"b{m}")) for m, t in enumerate(self.tables)), F.lit(0.0)) for d, p in enumerate(self.prior)]
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        e = F.array(*[F.exp(x - top) for x in logs])
        return F.transform(e, lambda v: F.round(v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 6))


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def train(rows: DataFrame, known: DataFrame) -> Classifier:
    """Count bins by domain over the rows of `train_rows`."""
    joined = rows.select("id", *[f"b{m}" for m in range(MEASURES)]).join(F.broadcast(known), "id")
    spread = joined.select("domain", F.posexplode(F.array(*[F.col(f"b{m}") for m in range(MEASURES)])).alias("m", "bin"))
    counts = {(r["domain"], r["m"], r["bin"]): r["n"] for r in spread.groupBy("domain", "m", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # domains * MEASURES * BINS rows at most
    each = [sum(n for (d, m, _), n in counts.items() if d == k and m == 0) for k in range(len(DOMAINS))]
    prior = [math.log((n + SMOOTHING) / (sum(each) + SMOOTHING * len(each))) for n in each]
    tables = [[math.log((counts.get((d, m, b), 0) + SMOOTHING) / (each[d] + SMOOTHING * BINS)) for d in range(len(DOMAINS)) for b in range(BINS)] for m in range(MEASURES)]
    return Classifier(prior, tables)


def steps_of(history: list[list[float]], start: Column, low: float, high: float, step: float, momentum: float) -> Column:
    """struct<r, y>: rate and look-ahead after the steps in history (the scaled residuals of each), from the column p."""
    if not history:
        return start
    width = len(history[0])
    steps = F.transform(F.split(F.lit(";".join(" ".join(repr(v) for v in e) for e in history)), ";"), lambda s: F.split(s, " ").cast("array<double>"))
    pull = lambda e: sum((F.get(F.col("p"), F.lit(d)) * F.get(e, F.lit(d)) for d in range(width)), F.lit(0.0))
    moved = lambda s, e: F.greatest(F.lit(low), F.least(F.lit(high), s["y"] - F.lit(step) * (pull(e) + F.lit(RIDGE) * (s["y"] - 1.0))))
    return F.aggregate(steps, start, lambda s, e: F.struct(moved(s, e).alias("r"), (moved(s, e) + F.lit(momentum) * (moved(s, e) - s["r"])).alias("y")))


def least_budget(cells: DataFrame, targets: list[float]) -> float:
    """The smallest total, as a multiple of the tokens there are, at which no domain with a target has to shrink."""
    masses = cells.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * F.get("p", F.lit(d))).alias(f"d{d}") for d in range(len(targets))]).first()
    return max([1.0, *[masses[f"d{d}"] / masses["n"] * sum(targets) / t for d, t in enumerate(targets) if t > 0 and masses["n"]]])


def fit(cells: DataFrame, targets: list[float], low: float, high: float, budget: float | None) -> Column:
    """The rate as an expression of p, by projected gradient descent with momentum over cells (tokens, p).

    The squared error of domain d is divided by its curvature, the mean of p_d squared, so that small domains converge
    as fast as large ones. A step sends one row of sums to the driver.
    """
    width = len(targets)
    n, p = F.col("tokens"), [F.get("p", F.lit(d)) for d in range(width)]
    moments = cells.agg(F.sum(n).alias("n"), *[F.sum(n * p[a] * p[b]).alias(f"m{a}_{b}") for a in range(width) for b in range(width)]).first()
    whole, one = moments["n"] or 0, min(high, max(low, 1.0))
    begin = F.struct(F.lit(one).alias("r"), F.lit(one).alias("y"))
    if not whole:
        return begin["r"]
    m = [[moments[f"m{a}_{b}"] / whole for b in range(width)] for a in range(width)]
    scale = [1 / max(m[d][d], 1e-6) for d in range(width)]
    v = [1.0] * width
    for _ in range(100):  # the largest eigenvalue of the scaled moments bounds the curvature
        v = [sum(m[a][b] * scale[b] * v[b] for b in range(width)) for a in range(width)]
        top = max(map(abs, v)) or 1.0
        v = [x / top for x in v]
    step = 1 / (top * 1.05 + RIDGE)
    momentum = (1 - math.sqrt(RIDGE * step)) / (1 + math.sqrt(RIDGE * step))
    budget = least_budget(cells, targets) if budget is None else budget
    goal = [budget * t / (sum(targets) or 1.0) for t in targets]
    history: list[list[float]] = []
    now, done = cells.select("tokens", "p", begin.alias("s")), 0
    for _ in range(ITERATIONS):
        if len(history) - done == ROUND:
            now, done = persist(now.select("tokens", "p", steps_of(history[done:], F.col("s"), low, high, step, momentum).alias("s")), "mixing-rates"), len(history)
            tidy(cells.sparkSession)
        totals = now.select("tokens", "p", steps_of(history[done:], F.col("s"), low, high, step, momentum)["y"].alias("y")).agg(*[F.sum(n * F.col("y") * p[d]).alias(f"d{d}") for d in range(width)]).first()
        history.append([(totals[f"d{d}"] / whole - goal[d]) * scale[d] for d in range(width)])
        if len(history) > 1 and max(abs(a - b) / c for a, b, c in zip(history[-1], history[-2], scale, strict=True)) < TOLERANCE:
            break
    return steps_of(history, begin, low, high, step, momentum)["r"]


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, low: float = 0.0, high: float = math.inf, budget: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, tokens, p, rate, copies, residual): each row of docs with its posteriors, its rate within low and high, a
    whole number of copies whose expectation is the rate (drawn by a hash of the id), and the largest difference between
    a domain's reached and wanted share (the same in all rows); with carry also `row`, the row itself.

    budget: wanted tokens in all, as a multiple of the tokens there are; None: see `least_budget`. With low > 0 targets
    may be out of reach (a target of zero always is, and low >= 1 keeps every row); `shares` tells what is reached. Texts are measured once, into a narrow table;
    carried rows are measured a second time instead of being moved.
    """
    wanted = [(targets or TARGETS).get(d, 0.0) for d in DOMAINS]
    known = persist(train_rows(labels), "mixing-labels")
    lexicon = learn(docs, known, id_col, text_col)
    tidy(docs.sparkSession)
    rows = persist(measured(docs, id_col, text_col, False, lexicon), "mixing-measures")
    model = train(rows, known)
    tidy(docs.sparkSession)
    bins = [f"b{m}" for m in range(MEASURES)]
    cells = persist(rows.groupBy(*bins).agg(F.sum("tokens").alias("tokens")).withColumn("p", model.posterior()), "mixing-cells")
    rated = persist(cells.select(*bins, "p", "tokens", F.round(fit(cells, wanted, low, high, budget), 6).alias("rate")), "mixing-rated")
    tidy(docs.sparkSession)
    reached = rated.agg(F.sum(F.col("tokens") * F.col("rate")).alias("n"), *[F.sum(F.col("tokens") * F.col("rate") * F.get("p", F.lit(d))).alias(f"d{d}") for d in range(len(wanted))]).first()
    residual = max(abs(reached[f"d{d}"] / reached["n"] - t / (sum(wanted) or 1.0)) for d, t in enumerate(wanted)) if reached["n"] else 0.0
    rated = rated.drop("tokens").withColumn("residual", F.lit(round(residual, 6)))
    if carry:
        rows = measured(docs, id_col, text_col, True, lexicon)
    out = rows.join(F.broadcast(rated), bins)  # BINS ** MEASURES rows at most, whatever the corpus
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(97)), F.lit(1 << 30)) / float(1 << 30)
    return out.select(*["row"] * carry, "id", "tokens", "p", "rate", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"), "residual")


def mixing_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = mixed(docs, labels)
    return rows.select(F.col("id").alias("doc_id"), "tokens", *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies", "residual")


def shares(rows: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(domain, wanted, had, reached, drawn): shares of expected tokens of rows of `mixed`: wanted, without rates, by
    rate and by copies."""
    wanted = [(targets or TARGETS).get(d, 0.0) for d in DOMAINS]
    cases = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(t / (sum(wanted) or 1.0)).alias("wanted"), F.get("p", F.lit(k)).alias("q")) for k, (d, t) in enumerate(zip(DOMAINS, wanted, strict=True))]))
    sums = rows.select("tokens", "rate", "copies", cases.alias("c")).groupBy("c.domain", "c.wanted")
    sums = sums.agg(*[F.sum(F.col("tokens") * F.col("c.q") * w).alias(n) for n, w in (("had", F.lit(1.0)), ("reached", F.col("rate")), ("drawn", F.col("copies")))])
    whole = sums.agg(*[F.sum(n).alias(f"all_{n}") for n in ("had", "reached", "drawn")])
    return sums.crossJoin(F.broadcast(whole)).select("domain", "wanted", *[F.round(F.try_divide(n, f"all_{n}"), 6).alias(n) for n in ("had", "reached", "drawn")])


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, low: float = 1.0, high: float = math.inf, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row as many times as it has copies; with low >= 1 no row is lost."""
    rows = mixed(docs, labels, targets, low, high, budget, id_col, text_col, carry=True)
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
