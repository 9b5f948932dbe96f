from __future__ import annotations

import math

import pytest
from conftest_llm import make_docs
from pyspark.sql import functions as F

from echoline.llm import mixing

LABELS = "doc_id long, quality int, toxic int"


def corpus(prose, n=300):
    rows, labels = [], []
    for k in range(n):
        kind = k % 3
        text = prose(k, 80, 300) if kind == 0 else "%%% &&& " * 30 + prose(k, 10) if kind == 1 else prose(k, 60) + " idiot moron loser"
        rows.append((k, text))
        if k % 2 == 0:
            labels.append((k, int(kind != 1), int(kind == 2)))
    return rows, labels


def totals(rows, rate="rate"):
    r = rows.agg(*[F.sum(F.col("tokens") * (F.col(rate) if rate else F.lit(1.0)) * F.get("p", F.lit(d))).alias(f"d{d}") for d in range(3)], F.sum("tokens").alias("n")).first()
    return [r[f"d{d}"] / r["n"] for d in range(3)]


def test_targets_are_met(spark, prose):
    rows, labels = corpus(prose)
    docs, table = make_docs(spark, rows, extra=True), spark.createDataFrame(labels, LABELS)
    for wanted in ({"high_quality": 0.6, "low_quality": 0.3, "toxic": 0.1}, {"high_quality": 0.2, "low_quality": 0.2, "toxic": 0.6}):
        got = mixing.mixed(docs, table, wanted)
        assert totals(got) == pytest.approx(list(wanted.values()), abs=0.03)
        assert got.where("rate < 0 OR rate > 4").count() == 0
        assert totals(got, "copies") == pytest.approx(list(wanted.values()), abs=0.12)


def test_held_out_domains(spark, prose):
    rows, labels = corpus(prose)
    got = mixing.mixing_query(make_docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    right = 0
    for r in got:
        p = [r["p_high_quality"], r["p_low_quality"], r["p_toxic"]]
        assert sum(p) == pytest.approx(1, abs=1e-4)
        right += (p.index(max(p)) == r["doc_id"] % 3) if r["doc_id"] % 2 else 0
    assert right / (len(rows) / 2) > 0.95


def test_fit_against_plain_projected_gradient(spark):
    cells = [(100, [0.9, 0.1, 0.0]), (300, [0.5, 0.4, 0.1]), (50, [0.0, 0.2, 0.8]), (10, [0.3, 0.3, 0.4])]
    df = spark.createDataFrame(cells, "tokens long, p array<double>")
    goal, whole = [0.7, 0.2, 0.1], sum(n for n, _ in cells)
    got = [r["r"] for r in df.withColumn("r", mixing.fit(df, goal, 0.0, 4.0, 1.0)).collect()]
    scale = [1 / (sum(n * p[d] ** 2 for n, p in cells) / whole) for d in range(3)]
    rate = [1.0] * 4
    for _ in range(20_000):
        e = [(sum(n * r * p[d] for (n, p), r in zip(cells, rate, strict=True)) / whole - goal[d]) * scale[d] for d in range(3)]
        rate = [min(4.0, max(0.0, r - 0.2 * (sum(a * b for a, b in zip(p, e, strict=True)) + mixing.RIDGE * (r - 1)))) for (_, p), r in zip(cells, rate, strict=True)]
    assert totals_of(cells, got) == pytest.approx(totals_of(cells, rate), abs=0.02)


def totals_of(cells, rates):
    whole = sum(n for n, _ in cells)
    return [sum(n * r * p[d] for (n, p), r in zip(cells, rates, strict=True)) / whole for d in range(3)]


def test_stage_loses_no_row(spark, prose):
    rows, labels = corpus(prose, 120)
    docs = make_docs(spark, rows, extra=True)
    out = mixing.resample(docs, spark.createDataFrame(labels, LABELS))
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(range(120))
    assert out.count() > 120


def test_awkward_rows(spark, awkward):
    docs = make_docs(spark, awkward, extra=True)
    for labels in ([], [(1, None, None), (None, 1, 1)], [(8, 1, 0), (8, 1, 0), (11, 0, 1)]):
        assert mixing.mixing_query(docs, spark.createDataFrame(labels, LABELS)).count() == len(awkward)
        assert mixing.resample(docs, spark.createDataFrame(labels, LABELS)).count() >= len(awkward)
    assert mixing.mixing_query(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    blank = {r["doc_id"]: r["tokens"] for r in mixing.mixing_query(docs, spark.createDataFrame([], LABELS)).collect()}
    assert (blank[1], blank[2], blank[3], blank[4]) == (0, 0, 0, 1)


def test_plan_is_native(spark, capsys):
    docs = make_docs(spark, [(1, "a b c"), (2, "d")])
    mixing.resample(docs, spark.createDataFrame([(1, 1, 0)], LABELS)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_marks_do_not_hide_terms(spark):
    lexicon = mixing.Lexicon({"idiot": (spark.range(1).select(mixing.slot(F.lit("idiot"))).first()[0], [2.0, 0.0])})
    texts = ["plain words", "you idiot", "you idiot!!", "you idiot###", 'you "idiot"', "you (idiot)", "an idiot-like one", "*idiot* idiot_ idiot's", "idiot! idiot, idiot"]
    got = {r["id"]: r["b4"] for r in mixing.measured(make_docs(spark, list(enumerate(texts))), "doc_id", "text", False, lexicon).collect()}
    assert [got[k] for k in range(len(texts))] == [3, 4, 4, 4, 4, 4, 4, 5, 5]


def test_terms_are_learned_from_the_labels(spark, prose):
    """Toxic words of another language, in texts that are like the others in every other way."""
    rude = ["trottel", "дурак", "canalla", "trottels"]
    rows = [(k, f"{prose(1000 + k % 7, 30)} {rude[k // 6 % 4]}!! {prose(k, 30)}" if k % 3 == 0 else prose(1000 + k % 7, 61)) for k in range(360)]
    labels = [(k, 1, int(k % 3 == 0)) for k in range(0, 360, 2)]
    docs, table = make_docs(spark, rows), spark.createDataFrame(labels, LABELS)
    assert set(rude) <= set(mixing.learn(docs, mixing.train_rows(table)).weights)
    held = [r for r in mixing.mixing_query(docs, table).collect() if r["doc_id"] % 2]
    right = [(r["p_toxic"] > 0.5) == (r["doc_id"] % 3 == 0) for r in held]
    assert sum(right) / len(right) > 0.95


def test_targets_are_met_on_a_skewed_corpus(spark, prose):
    """A tenth of the tokens is of high quality: its rate is far above four."""
    rows = [(k, prose(k, 80, 300) if k % 10 == 0 else f"{prose(k, 60)} idiot moron" if k % 10 == 1 else "%%% &&& " * 35 + prose(k, 10)) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 10 < 2), int(k % 10 == 1)) for k in range(300)], LABELS)
    docs = make_docs(spark, rows)
    for options in ({}, {"budget": None}):
        got = {r["domain"]: r for r in mixing.shares(mixing.mixed(docs, labels, **options)).collect()}
        for domain, share in mixing.TARGETS.items():
            assert got[domain]["wanted"] == share
            assert got[domain]["reached"] == pytest.approx(share, abs=0.05)
        assert got["high_quality"]["had"] < 0.2
    out = mixing.resample(docs, labels, low=0.0)
    kinds = {r["k"]: r["n"] for r in out.groupBy((F.col("doc_id") % 10).alias("k")).agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    high, toxic, every = kinds[0], kinds.get(1, 0), sum(kinds.values())
    assert high / every == pytest.approx(0.9, abs=0.07)
    assert toxic / every < 0.02


def plain_measures(text, lexicon):
    """Tokens, bins and sums of term weights by the definitions, in plain Python."""
    low = text.lower()
    gap = lambda cs: str.maketrans(dict.fromkeys(cs, " "))
    kept = low.translate(gap(mixing.BREAKS + mixing.SYMBOL + mixing.MARK))
    words = [w for w in kept.split(" ") if w]
    same = str.maketrans(dict.fromkeys(mixing.SYMBOLS, "S") | dict.fromkeys([c for c in mixing.MARKS if c not in mixing.SYMBOLS], "M"))
    terms = [w for w in kept.translate(gap(mixing.MARKS)).split(" ") if w]
    n, chars = max(1, len(words)), max(1, len(text))
    sums = [sum(lexicon.weights[t][1][k] for t in terms if t in lexicon.weights) for k in range(2)]
    symbols = sum(c in mixing.SYMBOLS for c in low)
    bins = [min(7, int(math.log2(n) / 2)), min(7, len({w.translate(same) for w in words}) * 8 // n), min(7, math.ceil(symbols * 40 / chars)), min(7, int(chars / n / 2)), *[sum(s >= e for e in mixing.EDGES) for s in sums]]
    return len(words), bins


def test_measures_and_posteriors_equal_plain_python(spark, prose, awkward, monkeypatch):
    rows, labels = corpus(prose, 90)
    rows = [*rows, *((500 + k, t) for k, (_, t) in enumerate(awkward) if t is not None), (700, "idiot " * 400 + "x | y!"), (701, "Idiot-like #1 (moron) loser!!")]
    docs, table = make_docs(spark, rows), spark.createDataFrame(labels, LABELS)
    lexicon = mixing.learn(docs, mixing.train_rows(table))
    assert lexicon.weights
    for most in (mixing.MOST_PACKED, 3):  # sums in one integer, and each for itself
        monkeypatch.setattr(mixing, "MOST_PACKED", most)
        got = {r["id"]: r for r in mixing.measured(docs, "doc_id", "text", False, lexicon).collect()}
        for doc, text in rows:
            assert (got[doc]["tokens"], [got[doc][f"b{m}"] for m in range(mixing.MEASURES)]) == plain_measures(text, lexicon), doc
    domain = {d: 2 if toxic else 0 if quality else 1 for d, quality, toxic in labels}
    each = [sum(v == k for v in domain.values()) for k in range(3)]
    bins = {d: plain_measures(t, lexicon)[1] for d, t in rows}
    out = {r["id"]: r["p"] for r in mixing.mixed(docs, table).collect()}
    for doc, b in bins.items():
        logs = [math.log((each[k] + 0.5) / (sum(each) + 1.5)) + sum(math.log((sum(bins[d][m] == x for d, v in domain.items() if v == k) + 0.5) / (each[k] + 4.0)) for m, x in enumerate(b)) for k in range(3)]
        e = [math.exp(v - max(logs)) for v in logs]
        assert out[doc] == pytest.approx([v / sum(e) for v in e], abs=2e-6)


def test_rates_reach_the_least_squares_optimum(spark, prose):
    """The optimum satisfies rate = max(0, 1 - p . residual / RIDGE) for every document; solved here by plain iteration."""
    rows, labels = corpus(prose, 120)
    got = mixing.mixed(make_docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    tokens, whole, goal = [r["tokens"] for r in got], sum(r["tokens"] for r in got), list(mixing.TARGETS.values())
    scale = [1 / max(sum(r["tokens"] * r["p"][d] ** 2 for r in got) / whole, 1e-6) for d in range(3)]
    rate, ahead = [1.0] * len(got), [1.0] * len(got)
    for _ in range(4000):
        e = [(sum(n * y * r["p"][d] for n, y, r in zip(tokens, ahead, got, strict=True)) / whole - goal[d]) * scale[d] for d in range(3)]
        new = [max(0.0, y - 0.3 * (sum(a * b for a, b in zip(r["p"], e, strict=True)) + mixing.RIDGE * (y - 1))) for y, r in zip(ahead, got, strict=True)]
        ahead, rate = [a + 0.9 * (a - b) for a, b in zip(new, rate, strict=True)], new
    share = lambda rates: [sum(n * x * r["p"][d] for n, x, r in zip(tokens, rates, got, strict=True)) / whole for d in range(3)]
    assert share([r["rate"] for r in got]) == pytest.approx(share(rate), abs=0.005)
    reached = share([r["rate"] for r in got])
    assert got[0]["residual"] == pytest.approx(max(abs(x / sum(reached) - g) for x, g in zip(reached, goal, strict=True)), abs=1e-4)


def test_carried_rows_are_measured_once(spark, prose):
    """A filter on the bins would repeat the lexicon in the plan, which the driver holds, and measure texts for the filter too."""
    rows, labels = corpus(prose, 60)
    plan = mixing.resample(make_docs(spark, rows), spark.createDataFrame(labels, LABELS))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" in plan
    assert not [line for line in plan.split("\n") if "Filter" in line and ("translate(" in line or "lambdafunction" in line)]
