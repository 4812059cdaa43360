import random
import re
from fractions import Fraction

from kgloom.llm import mixing
from tests.llm import corpus


def brute(votes, seats, most):
    out = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if out[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        i = max(open_, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_divisor_equals_highest_quotients():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 7)
        votes = [Fraction(rng.randint(0, 60), rng.randint(1, 4)) for _ in range(n)]
        most = [rng.randint(0, 25) for _ in range(n)]
        seats = rng.randint(0, 80)
        assert mixing.sainte_lague(votes, seats, most) == brute(votes, seats, most)


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == [20, Fraction(50, 3), Fraction(25, 3)]
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]
    assert mixing.targets([], []) == []
    t = mixing.targets([100, 1, 50], [5, 2, 1])
    assert sum(t) == Fraction(453, 2) and t[1] == 2


def test_mix(spark, sf_dir):
    rows = corpus.rows(spark, sf_dir)
    df = corpus.frame(spark, sf_dir)
    got = mixing.mix(df).collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(size, key=lambda x: (x is None, x))
    aim = dict(zip(names, mixing.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and r.target == float(aim[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.taken == r.passes * r["size"] + sum(s["to"] - s["from"] for s in r.spans)
        assert all(0 <= s["from"] < s["to"] <= r["size"] for s in r.spans)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - aim[s]) <= 2 * mixing.BLOCK for s in names), {s: (taken[s], float(aim[s])) for s in names}
    again = mixing.digest(mixing.mix(df.repartition(2))).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.digest(mixing.mix(df)).collect()))
    assert mixing.mix(corpus.empty(spark)).count() == 0
