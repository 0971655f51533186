import numpy as np
import pytest

from quadrivium.llm import gbt, quality, toxicity
from quadrivium.llm.common import id_fold

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    forest = gbt.fit(x[:2000], y[:2000])
    assert auc(forest.margin(x[2000:]), y[2000:]) > 0.98


def test_vectorised_traversal_equals_a_walk():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, 3)), (rng.random(400) > 0.5).astype(float)
    forest = gbt.fit(x, y, trees=5, depth=3)
    for row in x[:20]:
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node]
        assert forest.margin(row[None])[0] == pytest.approx(total)


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(2)
    p = rng.random(2000)
    y = (rng.random(2000) < p**2).astype(float)
    fit = gbt.isotonic(p, y)
    grid = fit(np.linspace(0, 1, 200))
    assert (np.diff(grid) >= 0).all() and abs(fit(p).mean() - y.mean()) < 0.02
    assert (gbt.isotonic(np.zeros(0), np.zeros(0))(p) == p).all()


def test_one_class_or_no_rows_gives_the_prior():
    x = np.zeros((0, 3))
    assert gbt.fit(x, np.zeros(0)).probability(np.zeros((2, 3))) == pytest.approx([1e-4, 1e-4])
    assert gbt.fit(np.ones((5, 3)), np.ones(5)).probability(np.zeros((1, 3)))[0] > 0.999


def test_features_see_the_whole_text():
    plain = toxicity.Lexicon(toxicity.SEED_WORDS, frozenset())
    clean, late = "word " * 30_000, "word " * 30_000 + "you idiot"
    assert toxicity.features(clean, plain)[2] == 0 < toxicity.features(late, plain)[2]
    get = lambda text: dict(zip(toxicity.NAMES, toxicity.features(text, plain)))
    assert get("you are an idi0t")["hidden"] == 1 and get("such an idiooot")["hidden"] == 1
    assert get("you idiot")["nearest"] > get("you " + "are " * 20 + "idiot")["nearest"] > get("idiot")["nearest"]
    assert get("SHUT UP now")["shouted"] == pytest.approx(2 / 3) and toxicity.features("", plain) == [0.0] * len(toxicity.NAMES)
    assert quality.features(" \n") == [0.0] * len(quality.NAMES)


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.8), (quality, "quality", 0.97)])
def test_held_out(spark, module, label, least):
    rows = module.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) > least and rows["score"].between(0, 1).all()


def test_toxic_documents_are_found_and_clean_ones_kept(spark):
    """Held out precision and recall of predicted = 1 at the scale of the driver's check; labels have some noise of their own."""
    large = SF.replace("sf0.01", "sf0.1")
    rows = toxicity.query(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = ((rows["predicted"] == 1) & (rows["toxic"] == 1)).sum()
    assert hit / (rows["predicted"] == 1).sum() > 0.95 and hit / (rows["toxic"] == 1).sum() > 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, edges, nothing, module):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (4, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    run = module.toxicity if module is toxicity else module.quality
    got = run(edges, labels).collect()
    assert len(got) == edges.count() and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in run(edges.where("text = 'same text here'"), labels).collect()}
    assert len(same) == 1 and run(nothing, labels).count() == 0
    assert {round(r.score, 6) for r in run(edges, labels.where("false")).collect()} == {1e-4}


def test_fold_of_ids(spark):
    import zlib

    got = spark.range(20).select("id", id_fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


# --- against brute force -----------------------------------------------------------------------


def test_isotonic_against_the_min_max_formula():
    """The isotonic fit at i is the greatest over starts of the least over ends of the means: computed in full."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 60):
        p = np.sort(rng.choice(1000, n, replace=False)) / 1000
        y = (rng.random(n) < p).astype(float)
        want = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        fit = gbt.isotonic(p, y)
        blocks = [np.flatnonzero(np.isclose(want, v)) for v in sorted(set(np.round(want, 9)))]
        assert fit.y == pytest.approx([want[b[0]] for b in blocks]) and fit.x == pytest.approx([p[b].mean() for b in blocks])


def test_first_split_is_the_best_of_all():
    """A stump's split and leaves, found by trying every feature and threshold."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = (x[:, 1] + rng.normal(0, 3, 300) > 6).astype(float)
    forest = gbt.fit(x, y, trees=1, depth=1, rate=1.0, bins=64, least=1)
    base = y.mean()
    g, h = base - y, np.full(300, base * (1 - base))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    gains = {(j, t): score(x[:, j] <= t) + score(x[:, j] > t) for j in range(3) for t in np.unique(x[:, j])[:-1]}
    feature, cut = max(gains, key=gains.get)
    assert forest.feature[0, 0] == feature and ((x[:, feature] <= forest.threshold[0, 0]) == (x[:, feature] <= cut)).all()
    leaf = lambda m: -g[m].sum() / (h[m].sum() + 1.0)
    assert forest.value[0, 1:] == pytest.approx([leaf(x[:, feature] <= cut), leaf(x[:, feature] > cut)])


def test_features_counted_by_hand():
    plain = toxicity.Lexicon(toxicity.SEED_WORDS, frozenset({"bad"}))
    got = dict(zip(toxicity.NAMES, toxicity.features("YOU idiot, bad bad idea! Are you?? é", plain)))
    size, n = len("YOU idiot, bad bad idea! Are you?? é".encode()), 8
    want = {"log_words": np.log1p(n), "seed": 1 / n, "strong": 1 / n, "weak": 2 / n, "near_hits": 1 / n, "second": 2 / n, "nearest": toxicity.NEAR - 1, "capitals": 4 / size, "bangs": 1 / size, "questions": 2 / size, "punctuation": 4 / size, "digits": 0, "shouted": 1 / n, "peak": 1, "non_ascii": 1 / size}
    assert {k: got[k] for k in want} == pytest.approx(want)
    got = dict(zip(quality.NAMES, quality.features("The cat sat.\nThe cat sat.\n\nA 12 | dog")))
    want = {"log_words": np.log1p(10), "unique": 7 / 10, "digits": 2 / 37, "pipes": 1 / 10, "stops": 2 / 10, "lines": np.log1p(3), "ended": 2 / 3, "double_lines": 1 / 3, "double_share": 2 / 3, "top_word": 2 / 10, "longest": np.log1p(4), "pair_share": 7 / 9}
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_every_part_has_words_of_the_others_only(spark):
    rows = [(i % toxicity.PARTS, f"common filler text number{i} " + ("slurword" if y else "kindword") + (" onlyhere" if y and i % toxicity.PARTS == 0 else ""), float(y)) for i in range(100) for y in (0, 1)]
    lexicons = toxicity.learn_lexicons(spark.createDataFrame(rows, "part int, text string, y double"))
    assert len(lexicons) == toxicity.PARTS + 1 and all("slurword" in x.strong and "kindword" not in x.strong | x.weak for x in lexicons)
    assert ["onlyhere" in x.strong | x.weak for x in lexicons] == [False] + [True] * toxicity.PARTS


def test_cross_fitted_scores_come_from_other_parts():
    rng = np.random.default_rng(8)
    x, part = rng.normal(size=(500, 2)), np.arange(500) % 5
    y = (x[:, 0] > 0).astype(float)
    got = toxicity.cross_fitted(x, y, part, 5)
    for p in range(5):
        assert got[part == p] == pytest.approx(gbt.fit(x[part != p], y[part != p]).probability(x[part == p]))
    assert toxicity.cross_fitted(x[:3], y[:3], part[:3]).shape == (3,) and len(toxicity.cross_fitted(x[:0], y[:0], part[:0])) == 0


def test_sample_has_a_row_per_id_however_often_it_repeats(spark):
    from pyspark.sql import functions as F

    from quadrivium.llm.learning import labelled_sample, with_text

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (None, "c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = with_text(docs, labelled_sample(labels, "toxic", "doc_id", F.lit(True), 100), "text", "doc_id").collect()
    assert sorted(tuple(r) for r in got) == [(1, "text 0", 1.0), (2, "b", 0.0), (3, "", 1.0)]
