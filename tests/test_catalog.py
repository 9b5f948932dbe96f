from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__
from echoline.functions import similarity as sim
from echoline.functions.text import assemble, matching_tokens, normalize
from echoline.operators import occurrences as occ
from echoline.plans import catalog
from echoline.plans import catalog_more as more

SF = Path("/root/testdata/sf0.001")
TABLES = "lineitem events documents pages part benchmark conversations".split()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    found = duck.execute(catalog.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    df = catalog.queries()[name](spark, str(SF))
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


def collected(spark, name):
    return catalog.queries()[name](spark, str(SF)).collect()


def test_what_has_no_sql_has_a_test():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"indel_ratio_pairs", "best_window", "cue_windows", "visible_text", "caption_search", "fuzzy_occurrences"}


def test_best_window_against_every_window(spark):
    turns = {}
    for r in catalog.table(spark, str(SF), "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append(r["text"])
    got = {r["media_id"]: (r["matched_text"], r["score"]) for r in collected(spark, "best_window")}
    wanted = {}
    for conv, (first, *later) in turns.items():
        words, target = " ".join(later).split(), matching_tokens(first)
        tokens = occ.transcript_tokens(words)
        n, text = len(target), " ".join(target)
        slack = max(1, min(3, -(-n // 4)))
        high = min(len(tokens), n + slack)
        best = max(((sim.ratio(text, " ".join(t for t, _, _ in tokens[s : s + k])), -abs(k - n), -s, -k) for k in range(min(max(1, n - slack), high), high + 1) if k for s in range(len(tokens) - k + 1)), default=None)
        if best:
            s, k = -best[2], -best[3]
            spoken = words[tokens[s][1] : max(t[2] for t in tokens[s : s + k]) + 1]
            wanted[conv] = (assemble(spoken), round(best[0], 6))
    assert got == wanted


def test_cue_windows_against_every_window(spark):
    """Every window of every conversation for every turn; ranked by time, the best kind of each pair of times."""
    rows = catalog.table(spark, str(SF), "conversations").orderBy("conv_id", "turn").collect()
    turns, found = {}, {}
    for r in rows:
        turns.setdefault(r["conv_id"], []).append((r["turn"], normalize(r["text"])))
    for r in rows:
        query, target = r["conv_id"] * catalog.TURNS + r["turn"], normalize(r["text"])
        for conv, cues in turns.items():
            for first in range(len(cues)):
                for last in range(first, len(cues)):
                    window = " ".join(filter(None, (t for _, t in cues[first : last + 1])))
                    kind = "exact" if window == target else "substring" if target in window else None
                    score = 100.0 if kind else sim.ratio(target, window) if 200 * min(len(target), len(window)) >= 85 * (len(target) + len(window)) else 0.0
                    if window and target and (kind or score >= 85):
                        found.setdefault((query, conv), []).append((cues[first][0] * 4.0, ("exact", "substring", "fuzzy").index(kind or "fuzzy"), cues[last][0] * 4.0 + 4, round(score, 6)))
                    if window and last - first >= 3 and len(window) >= len(target):
                        break
    got = {}
    for r in collected(spark, "cue_windows"):
        got.setdefault((r["query_id"], r["media_id"]), []).append((r["rank"], r["start"], r["end"], r["match_type"], r["score"]))
    assert len(got) >= len(rows)
    for key, windows in found.items():
        wanted = [(k, s, e, ("exact", "substring", "fuzzy")[t], x) for k, (s, t, e, x) in enumerate(sorted(windows, key=lambda w: (w[0], w[1], w[2], -w[3])), 1)]
        assert sorted(got.pop(key)) == wanted
    assert not got


def test_visible_text_against_every_window(spark):
    """Short documents as frames, without a filter: first exact place, else the best window with or without blanks."""
    got = {(r["query_id"], r["media_id"]): (r["match_type"], r["score"]) for r in collected(spark, "visible_text")}
    assert got
    docs = catalog.table(spark, str(SF), "documents").where("n_chars < 700").collect()
    targets = [(r["query_id"], normalize(r["text"])) for r in catalog.perturbed(catalog.targets(spark, str(SF))).limit(3).collect()]
    hits = {k for k in got if k[1] in {d["doc_id"] for d in docs}}
    targets += [(r["query_id"], normalize(r["text"])) for r in catalog.perturbed(catalog.targets(spark, str(SF))).collect() if r["query_id"] in {q for q, _ in hits}]
    for doc in docs:
        seen = normalize(" ".join(line.strip() for line in (doc["text"] or "").split("\n") if line.strip())).split()
        for query, target in targets:
            n, tight = len(target.split()), target.replace(" ", "")
            slack = max(1, min(3, -(-n // 4)))
            if any(" ".join(seen[k : k + n]).replace(" ", "") == tight for k in range(len(seen))):
                wanted = ("exact", 100.0)
            else:
                windows = (" ".join(seen[s : s + k]) for s in range(len(seen)) for k in range(max(1, n - slack), n + slack + 1) if s + k <= len(seen))
                best = max((max(sim.ratio(target, w), sim.ratio(tight, w.replace(" ", ""))) for w in windows), default=0.0)
                wanted = ("fuzzy", round(best, 6)) if best >= 85 else None
            assert got.get((query, doc["doc_id"])) == wanted


def test_caption_search_finds_what_is_heard(spark):
    """A pair has an answer exactly if the line is heard somewhere in the medium; verified captions are not searched again."""
    got = {(r["query_id"], r["media_id"]): r for r in collected(spark, "caption_search")}
    words, lines = more.turn_words(spark, str(SF)), catalog.spoken_targets(spark, str(SF))
    heard = {}
    for r in occ.occurrences(occ.transcripts(words), lines).collect():
        heard.setdefault((r["query_id"], r["media_id"]), []).append(r)
    assert set(got) == set(heard)
    sources = {r["localization_source"] for r in got.values()}
    assert "caption" in sources
    for key, r in got.items():
        if r["localization_source"] == "asr":
            first = min(heard[key], key=lambda x: x["occ_idx"])
            assert (r["matched_text"], r["start"], r["occurrence_count"]) == (first["matched_text"], round(first["start"], 3), len(heard[key]))


def test_answered_pairs_are_not_searched_again(spark):
    """Occurrences with answered pairs are those without, less the pairs; a medium answered for all targets isn't read."""
    words = more.turn_words(spark, str(SF)).where("media_id < 6")
    lines = spark.createDataFrame(list(enumerate(more.SHORT_LINES)), "query_id long, text string")
    media = occ.transcripts(words)
    every = {(r["query_id"], r["media_id"], r["occ_idx"]) for r in occ.occurrences(media, lines).collect()}
    pairs = [(q, m) for q in range(4) for m in range(6) if m == 2 or (q + m) % 2]
    done = spark.createDataFrame(pairs, "query_id long, media_id long")
    got = {(r["query_id"], r["media_id"], r["occ_idx"]) for r in occ.occurrences(media, lines, done=done).collect()}
    assert got == {x for x in every if x[:2] not in set(pairs)}
    assert 2 not in {r["media_id"] for r in occ.skipping(media, lines, done).collect()}
    from echoline.plans import search

    plan = search.open_speech(words, lines, 85.0, done)._jdf.queryExecution().optimizedPlan().toString()
    gathered = next(k for k, line in enumerate(plan.splitlines()) if "collect_list" in line)
    assert any("LeftAnti" in line for line in plan.splitlines()[gathered:])  # closed media leave below the gathering of words


def test_fuzzy_occurrences_against_every_window(spark):
    """No filter, no bank: all windows of all documents for all targets."""
    got = {(r["query_id"], r["media_id"], r["occ_idx"]): (r["matched_text"], r["score"]) for r in catalog.queries()["fuzzy_occurrences"](spark, str(SF)).collect()}
    assert got
    media = {r["media_id"]: r["words"] for r in occ.spoken(catalog.table(spark, str(SF), "documents").where("n_chars < 700"), "doc_id", "text").collect()}
    targets = {r["query_id"]: matching_tokens(r["text"]) for r in catalog.perturbed(catalog.targets(spark, str(SF))).limit(4).collect()}
    for media_id, words in media.items():
        tokens = occ.transcript_tokens([w["text"] for w in words])
        for query_id, target in targets.items():
            found = occ.select(occ.survivors(tokens, target, 85.0), tokens, len(target))
            for k, w in enumerate(found):
                text, _, _, _, score = occ.describe(w, tokens, words)
                assert got[query_id, media_id, k] == (text, round(score, 6))
            assert (query_id, media_id, len(found)) not in got


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "media_id", "tok_idx", "start"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["normalize_text", "phrase_exact_first", "verify_interval", "frame_asof", "fuzzy_occurrences"])
def test_plans_read_only_what_they_need(spark, name):
    plan = catalog.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "n_chars" not in plan
    assert "props" not in plan


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    """Three conversations of four turns; in the second, a line of the first returns with two words changed, over two turns."""
    import random

    rng = random.Random(8)
    line = lambda n: [("".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(3, 8)))) for _ in range(n)]
    turns = {(c, t): line(rng.randint(16, 24)) for c in range(3) for t in range(4)}
    same = [*turns[0, 0][:5], "otherwise", *turns[0, 0][6:13], "changed", *turns[0, 0][14:]]
    turns[1, 2], turns[1, 3] = same[:9], same[9:]
    turns[2, 3] = [*line(8), *turns[2, 0][8:]]
    path = tmp_path_factory.mktemp("talk")
    rows = [(c, t, " ".join(w).capitalize() + ".") for (c, t), w in turns.items()]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path), {(c, t): " ".join(w) for (c, t), w in turns.items()}


def test_cue_windows_of_every_whole_turn_against_brute_force(spark, talk):
    from echoline.functions.similarity import ratio

    path, lines = talk
    wanted = set()
    for (c, t), target in lines.items():
        for medium in range(3):
            for first in range(4):
                for last in range(first, 4):
                    text = " ".join(lines[medium, k] for k in range(first, last + 1))
                    kind = "exact" if text == target else "substring" if target in text else "fuzzy" if ratio(text, target) >= 85 else None
                    if kind:
                        wanted.add((c * catalog.TURNS + t, medium, first * 4.0, last * 4.0 + 4.0, kind))
    got = {(r["query_id"], r["media_id"], r["start"], r["end"], r["match_type"]) for r in catalog.queries()["cue_windows"](spark, path).collect()}
    assert got == wanted
    assert (0, 1, 8.0, 16.0, "fuzzy") in got


def test_caption_search_asks_for_every_whole_turn(spark, talk):
    path, lines = talk
    got = {(r["query_id"], r["media_id"]): r for r in catalog.queries()["caption_search"](spark, path).collect()}
    for (c, t), line in lines.items():
        r = got[c * catalog.TURNS + t, c]
        assert (r["match_type"], r["score"], r["matched_text"].rstrip(".").lower()) == ("exact", 100.0, line)
    assert got[0, 1]["match_type"] == "fuzzy"


def test_best_window_is_asked_for_the_whole_first_turn(spark, talk):
    path, lines = talk
    got = {r["query_id"]: r for r in catalog.queries()["best_window"](spark, path).collect()}
    for c in range(3):
        tokens = occ.transcript_tokens(" ".join(lines[c, t] for t in range(1, 4)).split())
        start, length, score = occ.best_window(tokens, lines[c, 0].split())
        assert got[c]["score"] == round(score, 6)
        assert len(got[c]["matched_text"].split()) == length
    assert got[2]["matched_text"].rstrip(".").endswith(lines[2, 0].split(" ", 8)[8])


def test_number_spans_are_dealt_over_all_cores(spark, tmp_path):
    """a table in one file was one task."""
    spark.range(50).selectExpr("id AS event_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.queries()["number_spans"](spark, str(tmp_path)).rdd.getNumPartitions() > 1
