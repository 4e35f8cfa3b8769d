"""The trained models against the same learning rules in plain Python, over n-grams as tuples instead of buckets."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from papersheaf.llm import linear, quality, toxicity
from tests.llm.helpers import documents

LABELS = "doc_id long, quality int, toxic int"


def logistic(x):
    return 1 / (1 + math.exp(-x))


class PlainFtrl:
    def __init__(self, rate, l1, l2):
        self.z, self.n = defaultdict(float), defaultdict(float)
        self.rate, self.l1, self.l2 = rate, l1, l2

    def weight(self, key):
        z = self.z[key]
        if abs(z) <= self.l1:
            return 0.0
        return (math.copysign(self.l1, z) - z) / ((1 + math.sqrt(self.n[key])) / self.rate + self.l2)

    def learn(self, gradients):
        for key, (g, weight) in gradients.items():
            grown = self.n[key] + g * g
            self.z[key] += g - (math.sqrt(grown) - math.sqrt(self.n[key])) / self.rate * weight
            self.n[key] = grown


def quality_grams(text):
    """Tokens, their pairs and triples, and those of their shapes."""
    tokens = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff\x20\x09-\x0D]+", text or "")
    lower = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in tokens]
    shapes = []
    for k, token in enumerate(tokens):
        if not re.match(r"[A-Za-z0-9\x80-\U0010ffff]", token):
            shapes.append(("sign", token))
            continue
        kind = "digit" if token[0] in "0123456789" else "low"
        if "A" <= token[0] <= "Z":
            kind = "all" if len(token) > 1 and "A" <= token[-1] <= "Z" else "first"
        shapes.append((kind, k > 0 and lower[k] == lower[k - 1]))
    grams = [("token", t) for t in lower]
    for name, series in (("tokens", lower), ("shapes", shapes)):
        for width in (2, 3):
            grams += [(name, *series[k : k + width]) for k in range(len(series) - width + 1)]
    return grams


def plain_quality(rows):
    model = PlainFtrl(0.3, 0.1, 0.01)

    def chance(text):
        grams = Counter(quality_grams(text))
        total = max(1, sum(grams.values()))
        values = {g: quality.SCALE * n / total for g, n in grams.items()} | {"intercept": 1.0}
        weights = {g: model.weight(g) for g in values}
        return logistic(sum(weights[g] * v for g, v in values.items())), values, weights

    for _ in range(linear.PASSES):
        for text, mark in rows:
            found, values, weights = chance(text)
            model.learn({g: ((found - mark) * v, weights[g]) for g, v in values.items()})
    return lambda text: chance(text)[0]


def toxic_grams(text):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]
    stems = [("stem", w.encode()[:size]) for w in words for size in toxicity.STEMS if len(w.encode()) > size]
    return Counter([("word", w) for w in words] + stems)


def plain_toxicity(rows):
    """Grades by counted markers, then gradients of the likelihood by differences instead of formulas."""
    grams = [(toxic_grams(text), mark) for text, mark in rows]
    seen = {m: Counter(g for found, mark in grams if mark == m for g in found) for m in (0, 1)}
    totals = {m: sum(mark == m for _, mark in grams) for m in (0, 1)}
    share = lambda g, m: (seen[m][g] + 0.5) / (totals[m] + 1)
    markers = {g for g in seen[1] if seen[1][g] >= 5 and math.log(share(g, 1) / share(g, 0)) > toxicity.MARKER_ODDS}
    grades = []
    for found, mark in grams:
        count = sum(n for g, n in found.items() if g in markers)
        grades.append(mark and 1 + sum(count >= least for least in toxicity.MARKERS))
    model, edges, moved = PlainFtrl(0.2, 8.0, 0.01), [1.0, 2.0, 3.0], [1.0, 1.0, 1.0]

    def loss(dot, edges, grade):
        over = [1.0, *(logistic(dot - e) for e in edges), 0.0]
        return -math.log(over[grade] - over[grade + 1])

    def slope(change):
        return (change(1e-5) - change(-1e-5)) / 2e-5

    for _ in range(linear.PASSES):
        for (found, _), grade in zip(grams, grades):
            values = {g: min(n, toxicity.MOST) for g, n in found.items()}
            weights = {g: model.weight(g) for g in values}
            dot, before = sum(weights[g] * v for g, v in values.items()), list(edges)
            along = slope(lambda d: loss(dot + d, before, grade))
            model.learn({g: (along * v, weights[g]) for g, v in values.items()})
            for k in (grade, grade - 1):
                if 0 <= k < 3:
                    step = slope(lambda d: loss(dot, [e + d * (j == k) for j, e in enumerate(before)], grade))
                    moved[k] += step * step
                    edges[k] -= 0.2 / math.sqrt(moved[k]) * step
            for k in (1, 2):
                edges[k] = max(edges[k], edges[k - 1] + toxicity.GAP)

    def severity(text):
        dot = sum(model.weight(g) * min(n, toxicity.MOST) for g, n in toxic_grams(text).items())
        over = [logistic(dot - e) for e in edges]
        return over[0], sum(over)

    return severity, grades, model


def corpus(seed, n):
    draw = random.Random(seed)
    good, bad = "The Tree grows, slowly: 12 years é".split(), "buy BUY now !! win win".split()
    rows = []
    for k in range(n):
        mark = k % 3 == 0
        words = [draw.choice(bad if mark and draw.random() < 0.6 else good) for _ in range(draw.randint(1, 25))]
        rows.append((k, " ".join(words), int(not mark), int(mark)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_equals_plain_learning(spark, seed):
    rows = corpus(seed, 60)
    labels = spark.createDataFrame([(k, good, toxic) for k, _, good, toxic in rows], LABELS)
    table = documents(spark, [(k, text) for k, text, *_ in rows])
    wanted = plain_quality([(text, good) for _, text, good, _ in rows])
    asked = [(100 + k, text) for k, (_, text, *_) in enumerate(corpus(seed + 10, 40))] + [(200, None), (201, ""), (202, "unseen words")]
    got = {r.doc_id: r.score for r in quality.score(documents(spark, asked), quality.fit(table, labels)).collect()}
    assert max(abs(got[k] - wanted(text)) for k, text in asked) < 1e-3
    assert min(got.values()) < 0.2 and max(got.values()) > 0.8


def test_toxicity_equals_plain_learning(spark):
    bad = "dreadful loathsome scoundrel".split()
    draw, rows = random.Random(3), []
    for k in range(150):
        words = [draw.choice("calm river stone window garden paper".split()) for _ in range(draw.randint(3, 20))]
        if k % 3 == 0:
            words += [draw.choice(bad) for _ in range(draw.choice([1, 3, 9]))]
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    table = documents(spark, [(k, text) for k, text, _ in rows])
    labels = spark.createDataFrame([(k, 0, mark) for k, _, mark in rows], LABELS)
    severity, grades, model = plain_toxicity([(text, mark) for _, text, mark in rows])
    assert set(grades) == {0, 1, 2, 3} and any(model.weight(g) for g in list(model.z))
    asked = [(k, text) for k, text, _ in rows] + [(200, "a loathsome DREADFULLY garden"), (201, None)]
    got = {r.doc_id: (r.score, r.severity) for r in toxicity.score(documents(spark, asked), toxicity.fit(table, labels)).collect()}
    for k, text in asked:
        assert got[k] == pytest.approx(severity(text), abs=2e-3)


def test_a_score_does_not_depend_on_the_row_before(spark):
    model = quality.fit(
        documents(spark, [(k, text) for k, text, *_ in corpus(4, 60)]),
        spark.createDataFrame([(k, good, toxic) for k, _, good, toxic in corpus(4, 60)], LABELS),
    )
    rows = [(1, "now win"), (2, "win The Tree"), (3, "slowly"), (2, "win The Tree")]
    got = quality.score(documents(spark, rows).coalesce(1), model).collect()
    assert len({r.score for r in got if r.doc_id == 2}) == 1
