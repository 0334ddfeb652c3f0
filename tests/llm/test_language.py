"""The language model: seating against customers moved one by one, scores against plain sums, sums to one."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrellis.llm import common, language
from sentrellis.llm.seating import EXACT, Seating

KIND = "doc_id long, text string"


def customers_moved(n, b, p, d, steps, rng):
    """Numbers of tables of a dish while single customers leave and sit down again."""
    tables, out = [n], []
    for step in range(steps):
        at = int(np.searchsorted(np.cumsum(tables), rng.integers(n), side="right"))
        tables[at] -= 1
        tables = [x for x in tables if x]
        weight = np.array([x - d for x in tables] + [(b + d * len(tables)) * p])
        at = rng.choice(len(weight), p=weight / weight.sum())
        if at == len(tables):
            tables.append(1)
        else:
            tables[at] += 1
        if step >= 200:
            out.append(len(tables))
    return np.array(out)


@pytest.mark.parametrize("n,b,p", [(2, 3.0, 0.2), (6, 5.0, 0.3), (12, 50.0, 0.05), (30, 100.0, 0.02)])
def test_seating_is_what_moving_customers_comes_to(n, b, p):
    rng = np.random.default_rng(n)
    moved = customers_moved(n, b, p, 0.7, 20_000, rng)
    drawn = Seating(0.7).draw(np.full(50_000, n), np.full(50_000, b), np.full(50_000, p), rng.random(50_000))
    assert drawn.mean() == pytest.approx(moved.mean(), rel=0.05) and drawn.std() == pytest.approx(moved.std(), rel=0.08)


def test_seating_of_many_customers_goes_on_from_few():
    s, u = Seating(0.7), np.random.default_rng(1).random(20_000)
    for b, p in ((3000.0, 0.01), (100.0, 0.002)):
        few, many = (s.draw(np.full(len(u), n), np.full(len(u), b), np.full(len(u), p), u).mean() for n in (EXACT, EXACT + 8))
        assert few == pytest.approx(many, rel=0.05)
    assert (s.draw(np.full(9, 10**7), np.full(9, 5.0), np.full(9, 1e-9), np.linspace(0, 1, 9, endpoint=False)) >= 1).all()
    assert s.draw(np.array([0, 1, 2]), np.full(3, 1e9), np.full(3, 1.0), np.full(3, 0.999)).tolist() == [0, 1, 2]


def test_parent_sums_to_one():
    chance, unseen = language.refine(np.array([1.0, 4.0, 900.0]), np.array([10.0, 2.0, 1.0]), 1 / 14)
    assert chance @ [10, 2, 1] + unseen == pytest.approx(1)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"v{x}" for x in rng.zipf(1.5, int(rng.integers(0, 80))).clip(0, 300))) for i in range(150)]
    texts += [(150, None), (151, ""), (152, "Never seen words here"), (None, "v1 v2"), (7, "v1 v1 v1"), (7, "v1 v1 v1")]
    docs = spark.createDataFrame(texts, KIND).withColumn("train", ~language.held_out(F.col("doc_id"))).repartition(3)
    docs = common.materialise(docs)
    common.prepare(spark)
    return texts, docs, language.fit(docs)


def test_predictions_sum_to_one(fitted):
    _, _, model = fitted
    types = {r["key"]: r for r in model["types"].collect()}
    pairs = {(r["context"], r["word"]): r for r in model["pairs"].collect()}
    for context in list(types)[:20]:
        c = types[context]
        mine = [r for (u, _), r in pairs.items() if u == context]
        assert c["known"] >= sum(r["n"] for r in mine)
        # The rest of the context's tokens are pairs that occur once, with one table each.
        rest = c["known"] - sum(r["n"] for r in mine)
        own = sum(r["n"] - model["d"] * r["mean"] for r in mine) + rest * (1 - model["d"])
        assert own / (language.STRENGTH + c["known"]) + c["room"] == pytest.approx(1)
    assert sum(r["above"] for r in types.values()) + model["unseen"] == pytest.approx(1)


def test_scores_are_plain_sums(fitted, monkeypatch):
    texts, docs, model = fitted
    monkeypatch.setattr(language, "HOT", 0.01)  # some pairs are looked up where the texts are read, others in buckets
    types = {r["key"]: r for r in model["types"].collect()}
    pairs = {(r["context"], r["word"]): r for r in model["pairs"].collect()}
    assert any(r["n"] > model["tokens"] * 0.01 for r in pairs.values())
    train = [t for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    split = lambda t: language.Tokens([(t or "").encode()])
    seen = {x for t in train for x in zip(split(t).context.view(np.int64).tolist(), split(t).hash.view(np.int64).tolist(), strict=True)}
    want = []
    for i, t in texts:
        score = base = known = 0.0
        tokens = split(t)
        for u, w in zip(tokens.context.view(np.int64).tolist(), tokens.hash.view(np.int64).tolist(), strict=True):
            c = types.get(u)
            n, mean = (pairs[u, w]["n"], pairs[u, w]["mean"]) if (u, w) in pairs else (1, 1) if (u, w) in seen else (0, 0)
            above = types[w]["above"] if w in types else model["unseen"]
            total, room = (c["known"], c["room"]) if c else (0, 1.0)
            score += math.log10((n - model["d"] * mean) / (language.STRENGTH + total) + room * above)
            mine = types[w]["known"] if w in types else 0
            known += mine > 0
            base += math.log10((mine + 1) / (model["tokens"] + model["kinds"] + 1))
        want.append((i, len(tokens.hash), int(known), round(base, 6), round(score, 4)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in language.predict(docs, model).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sweeps_alike_without_a_broadcast(fitted):
    _, docs, model = fitted
    other = language.fit(docs, broadcast_types=0)
    for name in ("pairs", "types"):
        a, b = (sorted(map(tuple, m[name].collect())) for m in (model, other))
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert np.array(a, float) == pytest.approx(np.array(b, float))


class Room:
    """A restaurant whose customers sit down and leave one by one; above is another one, or the probability of each word."""

    def __init__(self, d, above, rng):
        self.d, self.above, self.rng, self.tables, self.n, self.t = d, above, rng, {}, 0, 0

    def chance(self, w):
        above = self.above.chance(w) if isinstance(self.above, Room) else self.above
        mine = self.tables.get(w, ())
        b = language.STRENGTH
        return (sum(mine) - self.d * len(mine)) / (b + self.n) + (b + self.d * self.t) / (b + self.n) * above

    def sit(self, w):
        mine = self.tables.setdefault(w, [])
        above = self.above.chance(w) if isinstance(self.above, Room) else self.above
        weight = np.array([x - self.d for x in mine] + [(language.STRENGTH + self.d * self.t) * above])
        at = int(np.searchsorted(np.cumsum(weight), self.rng.random() * weight.sum()))
        self.n += 1
        if at < len(mine):
            mine[at] += 1
            return
        mine.append(1)
        self.t += 1
        if isinstance(self.above, Room):
            self.above.sit(w)

    def leave(self, w):
        mine = self.tables[w]
        at = int(np.searchsorted(np.cumsum(mine), self.rng.integers(sum(mine)), side="right"))
        mine[at] -= 1
        self.n -= 1
        if not mine[at]:
            del mine[at]
            self.t -= 1
            if isinstance(self.above, Room):
                self.above.leave(w)


def test_scores_are_those_of_a_plain_sampler(spark):
    """Both levels at once: every customer of every context leaves and sits down again, tables are customers above."""
    rng = np.random.default_rng(11)
    follow = rng.dirichlet(np.full(60, 0.1), 60)
    texts = []
    for i in range(300):
        words, last = [], int(rng.integers(60))
        for _ in range(int(rng.integers(5, 40))):
            last = int(rng.choice(60, p=follow[last]))
            words.append(f"w{last}")
        texts.append((i, " ".join(words)))
    docs = common.materialise(spark.createDataFrame(texts, KIND).withColumn("train", ~language.held_out(F.col("doc_id"))).repartition(2))
    model = language.fit(docs)
    got = language.predict(docs, model).filter("held_out").agg(F.sum("score"), F.sum("n_tokens"), F.sum("base_score")).first()
    pairs = lambda t: list(zip(["end", *t.split()], [*t.split(), "end"], strict=True))
    train = [p for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2 for p in pairs(t)]
    held = [p for i, t in texts if zlib.crc32(str(i).encode()) % 7 == 2 for p in pairs(t)]
    top = Room(0.5, 1 / (model["kinds"] + 1), rng)
    rooms = {u: Room(model["d"], top, rng) for u, _ in train}
    for u, w in train:
        rooms[u].sit(w)
    total = np.zeros(len(held))
    for sweep in range(24):
        top.d = language.discount(np.array([sum(x) for x in top.tables.values()]))
        for u, w in train:
            rooms[u].leave(w)
            rooms[u].sit(w)
        if sweep >= 8:
            total += [rooms[u].chance(w) if u in rooms else top.chance(w) for u, w in held]
    plain = np.log10(total / 16).sum()
    assert got[1] == len(held) and got[2] < plain - 0.3 * len(held)
    assert got[0] / len(held) == pytest.approx(plain / len(held), abs=0.01)


def test_pairs_of_many_words_and_rows(monkeypatch):
    rng = np.random.default_rng(4)
    word, row = rng.integers(0, 40, 2000).astype(np.uint64), np.sort(rng.integers(0, 30, 2000)).astype(np.int32)
    context = np.concatenate((word[-1:], word[:-1]))
    some = rng.random(2000) < 0.7
    one = language.Coded(context, word, row, some)
    monkeypatch.setattr(language, "ONE_CODE", 1)
    two = language.Coded(context, word, row, some)
    for name in ("vocabulary", "many", "row", "first", "context", "word"):
        assert (getattr(one, name) == getattr(two, name)).all()


def test_a_text_of_millions_of_words_beside_empty_rows():
    words = np.arange(1, 3_000_001, dtype=np.uint64)
    word = np.concatenate((np.full(1_000_000, language.END), words, np.array([language.END])))
    row = np.concatenate((np.arange(1_000_000), np.full(len(words) + 1, 1_000_000))).astype(np.int32)
    found = language.Coded(np.concatenate((word[-1:], word[:-1])), word, row)
    assert found.many.sum() == len(word) and len(found.first) == len(words) + 2 and int(found.row.max()) == 1_000_000


def test_buckets_of_frequent_contexts():
    rng = np.random.default_rng(2)
    context, word = rng.integers(1, 5, 1000).astype(np.uint64), rng.integers(0, 1 << 60, 1000).astype(np.uint64)
    deal = language.Dealer(16, np.array([3], np.uint64))
    bucket = deal(context, word)
    assert len(set(bucket[context == 3])) == 16 and all(len(set(bucket[context == k])) == 1 for k in (1, 2, 4))
