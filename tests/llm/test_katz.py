"""The trigram model against plain counts of the whole corpus."""

import collections
import itertools
import math
import random
import zlib

import pytest

from sparkquarry.llm import katz

START, END = object(), None
UNIT = katz.UNIT


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Plain:
    """Katz backoff from three counters, written for one history and word at a time."""

    def __init__(self, texts):
        self.ones, self.twos, self.threes = collections.Counter(), collections.Counter(), collections.Counter()
        for t in texts:
            w = [START, *t, END]
            self.ones.update(w[1:])
            self.twos.update(zip(w, w[1:]))
            self.threes.update(zip(w, w[1:], w[2:]))
        self.tables = [{(w,): n for w, n in self.ones.items()}, self.twos, self.threes]
        numbers = [collections.Counter(t.values()) for t in self.tables]
        self.cut = [katz.discounts([n[r] for r in range(1, katz.DISCOUNTED + 2)]) for n in numbers]
        self.tokens = sum(self.ones.values())
        share = {w: self.kept(0, n) / self.tokens for w, n in self.ones.items()}
        self.unseen = max(1 - sum(share.values()), 1 / (self.tokens + 1))
        factor = (1 - self.unseen) / sum(share.values())
        self.share = {w: p * factor for w, p in share.items()}
        self.after = [collections.defaultdict(dict) for _ in range(3)]
        for o in (1, 2):
            for gram, n in self.tables[o].items():
                self.after[o][gram[:-1]][gram[-1]] = n
        self.known = {}

    def kept(self, order, n):
        return self.cut[order][n] / UNIT if n <= katz.DISCOUNTED else n

    def p(self, history, w):
        order = len(history)
        if not order:
            return self.share.get(w, self.unseen)
        seen = self.after[order].get(history)
        if seen is None:
            return self.p(history[1:], w)
        if history not in self.known:
            n = sum(seen.values())
            kept = sum(self.kept(order, c) for c in seen.values()) / n
            scale = (1 - 1 / (n + 1)) / kept if 1 - kept < 1 / (n + 1) else 1
            self.known[history] = n, scale, (1 - scale * kept) / (1 - sum(self.p(history[1:], x) for x in seen))
        n, scale, weight = self.known[history]
        return scale * self.kept(order, seen[w]) / n if w in seen else weight * self.p(history[1:], w)

    def score(self, t):
        w = [START, *t, END]
        return sum(math.log10(self.p(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(1, len(w)))


def corpus():
    draw = random.Random(3)
    texts = [(i, " ".join(f"W{int(draw.paretovariate(0.7))}" for _ in range(draw.randrange(60)))) for i in range(120)]
    texts += [(200 + i, "the same line of words again and again, " * 12) for i in range(9)]  # its histories have large counts alone
    return [*texts, (7, "a repeated id"), (7, "a repeated id"), (None, "no id"), (None, None), (300, ""), (301, " \t\n"), (302, "ÉÀ x A b")]


@pytest.mark.parametrize("block,size", [(2_500_000, 4_000_000), (50, 10)])
def test_scores_are_those_of_plain_counts(spark, monkeypatch, block, size):
    monkeypatch.setattr(katz, "BLOCK", block)
    monkeypatch.setattr(katz, "SLICE", size)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], "doc_id long, text string, id string, row int, block int").repartition(5)
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    plain = Plain([split(t) for i, t in texts if not held(i)])
    types = len(plain.ones)
    want = []
    for i, t in texts:
        w = split(t)
        base = sum(math.log10((plain.ones[x] + 1) / (plain.tokens + types + 1)) for x in [*w, END])
        want.append((i or -1, held(i), len(w) + 1, sum(plain.ones[x] > 0 for x in [*w, END]), plain.tokens, base, plain.score(w)))
    got = [(r["doc_id"] or -1, *r[1:]) for r in katz.score_documents(docs).collect()]
    for x, y in zip(sorted(got), sorted(want), strict=True):
        assert x[:5] == y[:5] and x[5:] == (pytest.approx(y[5]), pytest.approx(y[6]))
    assert any(map(held, dict(texts)))


def test_sums_to_one():
    texts = [(t or "").lower().split() for _, t in corpus()]
    plain = Plain(texts)
    words = [*plain.ones]
    histories = [(), *plain.after[1], *plain.after[2], ("unseen",), ("unseen", "again")]
    for history in histories:
        assert sum(plain.p(history, w) for w in words) + plain.p(history, "never seen") == pytest.approx(1), history


def test_without_rows_or_training(spark):
    schema = "doc_id long, text string"
    assert katz.score_documents(spark.createDataFrame([], schema)).count() == 0
    i = next(i for i in itertools.count() if held(i))
    r = katz.score_documents(spark.createDataFrame([(i, "a b")], schema)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0) and r["score"] == pytest.approx(3 * math.log10(0.5))


def test_counts_of_a_bucket():
    np = katz.np
    keys, counts = np.array([5, 9, 5, 7, 5], np.uint64), np.array([0, 2, 3, 0, 4], np.uint64)
    answers, totals, found = katz.added(keys, counts)
    assert found.tolist() == [5, 7, 9] and totals.tolist() == [7, 0, 2]
    assert answers.tolist() == [7 << 2, 2 << 2 | 3, 7 << 2 | 1, 2, 7 << 2]
