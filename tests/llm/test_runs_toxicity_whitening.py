"""Runs against brute force, toxicity held out and across group names, whitening against a dense eigensolver; odd rows for each."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.llm import periodic_runs, queries, toxicity, whitening

FOLDER = "/root/testdata/sf0.001"


def all_runs(words, least=12):
    """By definition: for each period, the longest stretches in which words so far apart are equal."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            first = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            length = at + period - first
            if length >= max(least, 2 * period):
                found.setdefault((first, length), period)  # smaller periods come first
            at += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


SOME = st.lists(st.integers(0, 2), max_size=60)


@given(SOME, SOME, st.integers(1, 9), st.sampled_from([2, 12]))
@settings(max_examples=150, deadline=None)
def test_runs_equal_brute_force(head, root, times, least):
    ids = head + root * times + head[::-1]
    got = periodic_runs.maximal_runs(np.array(ids, np.int64), least)
    assert [tuple(map(int, r)) for r in got] == all_runs(ids, least)


def test_texts_do_not_reach_into_each_other():
    same = ["a"] * 8
    answers = periodic_runs.runs_of_texts([same, same, [], ["b"] * 12, same])
    assert [len(r) for r, _ in answers] == [0, 0, 0, 1, 0]
    assert answers[3][1] == ["b"]


def test_progressions_that_meet_propose_all_periods():
    """Each odd period up to the middle has a run of its own around it."""
    words = [0, 1] * 40 + [0, 0] + [1, 0] * 40
    got = periodic_runs.maximal_runs(np.array(words))
    assert [tuple(map(int, r)) for r in got] == all_runs(words)
    assert len(got) > 30


ODD = [
    (1, None, "x"),
    (2, "", "x"),
    (3, " \n\t ", None),
    (None, "a " * 30, "x"),
    (4, "a " * 30, "x"),
    (4, "a " * 30, "x"),
    (5, "one two three " * 5 + "end", "x"),
    (6, " ".join(f"w{i}" for i in range(60_000)), "x"),
    (10, "no words repeat in this one", "x"),
]
CLASH = "doc_id bigint, text string, runs string"


def test_runs_query(spark, tmp_path):
    spark.createDataFrame(ODD, CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    expected = []
    for doc_id, text, _ in ODD:
        words = [w for w in (text or "").split() if w]
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        a = p = None
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        # The words of the long text all differ, so its only run is the one put in.
        runs = all_runs(words) if len(words) < 1000 else [(a, len(words) - a, p)] if p else []
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        expected.append((doc_id, len(runs), *numbers, *[hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    empty = spark.createDataFrame([], CLASH)
    assert periodic_runs.find_runs(empty).count() == 0


def test_runs_of_given_documents(spark):
    """Every document of the small table, by definition."""
    found = periodic_runs.find_runs(spark.read.parquet(f"{FOLDER}/documents.parquet"), ["doc_id", "text"], prepare=periodic_runs.planted)
    periods = 0
    for r in found.collect():
        words = periodic_runs.planted(r.doc_id, (r.text or "").split())
        if len(words) <= 400:
            runs = [(x.start, x.length, x.period) for x in r.runs]
            assert runs == all_runs(words)
            periods += len(runs)
    assert periods > 5


# --- toxicity ---------------------------------------------------------------------------------

GROUPS = {"people": ("people", "moronians", "blues", "reds")}


def labelled_texts(n=300):
    """Toxic ones say moron or scum; the start of one word is that of a group's name."""
    plain = [a + b for a in "bcdfghklmn" for b in ("ala", "elo", "iru", "ome")]
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        insult = ("moron" if i % 2 else "scum") if bad else plain[i % 37]
        rows.append((i, f"the {insult} {plain[i % 7]} went to town {plain[i % 11]}. It was {plain[i % 5]} there", int(bad)))
    return rows


@pytest.fixture(scope="module")
def taught(spark):
    rows = spark.createDataFrame(labelled_texts(), "doc_id bigint, text string, toxic int")
    return rows.select("doc_id", "text"), rows.select("doc_id", "toxic")


def scores(spark, fitted, texts):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return [r.score for r in toxicity.score(table, fitted, ["doc_id"]).orderBy("doc_id").collect()]


def test_names_of_groups_do_not_change_scores(spark, taught):
    neutral = [f"the {name} went to town" for name in GROUPS["people"]]
    free = scores(spark, toxicity.fit(*taught, groups=GROUPS, counterfactual=0.0), neutral)
    held = scores(spark, toxicity.fit(*taught, groups=GROUPS), neutral)
    assert max(free) - min(free) > 10 * (max(held) - min(held))
    assert max(held) < 0.2
    assert min(scores(spark, toxicity.fit(*taught, groups=GROUPS), ["the moron went to town", "the scum of it"])) >= toxicity.TOXIC


def test_swaps_take_named_sentences_first():
    one, other = toxicity.swapped("Nothing here. The blues came. Nothing there", GROUPS)
    assert one == ["the", "blues", "came"] and other[0] == "the" and other[1] in ("people", "moronians", "reds")
    one, other = toxicity.swapped("only these words", GROUPS)
    assert len(one) == len(other) == 3 and sum(a != b for a, b in zip(one, other, strict=True)) == 1
    assert toxicity.swapped(" 12 -- ", GROUPS) == ([], []) == toxicity.swapped("a b", {})


def test_toxicity_of_odd_rows(spark, taught):
    documents, labels = taught
    odd = spark.createDataFrame([(*r[:2], 0.5) for r in ODD], "doc_id bigint, text string, score double")
    rows = toxicity.classify(documents.withColumn("score", F.lit(0.1)).unionByName(odd), labels).collect()
    assert len(rows) == 300 + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert toxicity.classify(documents.limit(0), labels).count() == 0
    # Labels of one kind, or none, say the same of every text.
    for some in (labels.filter("toxic = 0"), labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert len({r.score for r in toxicity.classify(documents, some).collect()}) == 1


def test_held_out_toxic_documents_are_found(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op12_toxicity(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    beyond = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean)
    assert beyond >= 0.9 * len(toxic) * len(clean)


# --- whitening --------------------------------------------------------------------------------


def triangle(a):
    r = np.linalg.qr(a, mode="r")
    return np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))])


@given(st.integers(1, 12), st.integers(1, 30), st.integers(0, 10**6), st.sampled_from(["plain", "scaled", "equal", "copied", "diagonal"]))
@settings(max_examples=120, deadline=None)
def test_singular_values_and_directions(d, rows, seed, kind):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((rows, d))
    if kind == "scaled":
        a = a * 10.0 ** rng.uniform(-3, 3, d)
    if kind == "equal":
        a = np.linalg.qr(rng.standard_normal((rows + d, d)))[0]
    if kind == "copied":
        a[:, -1] = a[:, 0]
    if kind == "diagonal":
        a = np.diag(rng.integers(0, 3, d)).astype(float)
    r = triangle(a)
    diagonal, upper, _ = whitening.bidiagonalise(r)
    expected = np.linalg.svd(r, compute_uv=False)
    got = np.sqrt(whitening.squared_singular_values(diagonal, upper))
    assert got == pytest.approx(expected, rel=1e-10, abs=1e-12 * max(expected.max(), 1e-9))
    values, vectors = whitening.singular_directions(r, 8)
    if len(values):
        assert vectors.T @ vectors == pytest.approx(np.eye(len(values)), abs=1e-10)
        assert vectors.T @ (r.T @ r) @ vectors == pytest.approx(np.diag(values), abs=1e-10 * values[0])


def dense(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    return ((n * x - s) ** 2).sum(axis=1), centred @ directions / np.sqrt(values), values / np.trace(v)


def test_whitening_equals_eigenvectors(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").repartition(7)
    given_rows = table.select("vec_id", "embedding").collect()
    deviations, white, shares = dense([r.embedding for r in given_rows])
    rows = {r.vec_id: r for r in whitening.whiten(table, ["vec_id"]).collect()}
    sign = np.sign(np.array(rows[given_rows[0].vec_id].whitened) * white[0])
    for i, r in enumerate(given_rows):
        got = rows[r.vec_id]
        assert got.n == len(given_rows) and got.deviation == deviations[i]
        assert got.whitened == pytest.approx(white[i] * sign, abs=1e-9)
        assert got.explained == pytest.approx(shares, rel=1e-10) and got.identity_error < 1e-9
    long = queries.op13_whitening(spark, FOLDER)
    assert long.count() == 8 * len(given_rows)
    assert {r.component for r in long.select("component").distinct().collect()} == set(range(1, 9))


NAN, INF = float("nan"), float("inf")
SHAPES = [
    (1, None, 1), (2, [], 1), (3, [1.0, None, 1.0], 1), (4, [NAN, 1.0, 1.0], 1), (5, [INF, 1.0, 1.0], 1), (6, [1.0, 2.0], 1),
    (7, [0.5, 0.1, 1.0], 1), (8, [0.25, -0.1, 1.0], 1), (8, [0.25, -0.1, 1.0], 1), (None, [-0.5, 0.3, 1.0], 1), (9, [1e300, 0.0, 1.0], 1),
]
VECTORS = "vec_id bigint, embedding array<double>, n int"


def test_whitening_of_odd_rows(spark):
    table = spark.createDataFrame(SHAPES, VECTORS)
    rows = whitening.whiten(table, ["vec_id", "n"]).drop("n").collect()
    assert sorted(str(r.vec_id) for r in rows) == ["7", "8", "8", "None"]
    # The last entry doesn't vary, so only two components are there.
    assert {len(r.whitened) for r in rows} == {2} and rows[0].identity_error < 1e-9
    assert rows[0].explained == pytest.approx(dense([s[1] for s in SHAPES if s[0] in (7, None)] + [SHAPES[7][1]] * 2)[2][:2])
    for none in (table.filter("vec_id < 6"), table.limit(0)):
        assert whitening.components(whitening.whiten(none, ["vec_id"]), ["vec_id"]).count() == 0
    same = whitening.whiten(table.filter("vec_id = 8"), ["vec_id"])
    assert [(r.n, r.deviation, r.whitened) for r in same.collect()] == [(2, 0, [])] * 2
    assert whitening.components(same, ["vec_id"]).count() == 0


def test_deviations_beyond_64_bits(spark):
    table = spark.createDataFrame([(i, [float(i * 2**40)]) for i in range(4)], "vec_id bigint, embedding array<double>")
    rows = whitening.whiten(table, ["vec_id"]).collect()
    assert [r.deviation for r in rows] == [None] * 4
    assert sorted(r.whitened[0] for r in rows) == pytest.approx(sorted((i - 1.5) / 1.25**0.5 for i in range(4)))
