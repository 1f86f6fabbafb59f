from collections import Counter

import numpy as np
import pytest

from tidecast.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at, what = int(rng.integers(0, len(s))), int(rng.integers(0, 3))
        if what == 0:
            s[at] = str(rng.choice(list("abcé")))
        elif what == 1:
            s.insert(at, str(rng.choice(list("abcé"))))
        else:
            del s[at]
    return "".join(s)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_within_and_keys(most):
    rng = np.random.default_rng(9)
    left, right = [], []
    for _ in range(600):
        s = "".join(rng.choice(list("abcé"), int(rng.integers(10, 90))))
        left.append(s)
        right.append(edited(rng, s, int(rng.integers(0, 6))))
    want = [distance(a, b) for a, b in zip(left, right, strict=True)]
    assert L.within(left, right, most).tolist() == [d if d <= most else -1 for d in want]
    for a, b, d in zip(left, right, want, strict=True):
        if d <= most:
            long, short = (a, b) if len(a) >= len(b) else (b, a)
            assert {*L.keys_of(long, most)[1]} & {*L.keys_of(short, most)[0]}
    near = np.array(want) <= most
    assert L.alike(L.sketches(left), L.sketches(right), most)[near].all()


def brute(rows):
    spots = [(i, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    lines = sorted({x for *_, x in spots})
    links = {x: set() for x in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            longer = max(len(a), len(b))
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, longer // 5):
                links[a].add(b)
                links[b].add(a)
    name, done = {}, set()
    for x in lines:
        if x in done:
            continue
        group, todo = {x}, [x]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        done |= group
        first = min(((i is None, i or 0, n), (i, n)) for i, n, y in spots if y in group)[1]
        name |= dict.fromkeys(group, first)
    return Counter((i, n, *name[x], len(links[x]), (i, n) == name[x]) for i, n, x in spots)


@pytest.mark.parametrize("cells, many, held", [(2_000_000, 4_000_000, 100_000), (7, 3, 5)])
def test_against_brute_force(spark, monkeypatch, cells, many, held):
    monkeypatch.setattr(L, "CELLS", cells)
    monkeypatch.setattr(L, "MANY", many)
    monkeypatch.setattr(L, "HELD", held)
    rng = np.random.default_rng(10)
    base = ["".join(rng.choice(list("abcdefg h"), int(rng.integers(5, 60)))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [edited(rng, base[int(rng.integers(25))], int(rng.integers(0, 3))) for _ in range(int(rng.integers(1, 5)))]
        rows.append((300 - i, "\n".join(lines)))
    rows += [(1, None), (2, ""), (3, "\n\n"), (4, "short"), (5, "shorT"), (8, "shor"), (9, "abcdefghi\nabcdefghij\nabcdefgxy\nab\nac"), (None, base[3] + "\n" + base[3]), rows[0], (6, "x" * 3000), (7, "x" * 2999 + "y")]
    got = L.line_groups(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int").repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    assert L.line_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_longer_keys_meet():
    """Whoever is within the edits and agrees on a key agrees on a longer one, down to the end."""
    rng = np.random.default_rng(12)
    for _ in range(300):
        short = "".join(rng.choice(list("abc"), int(rng.integers(10, 40))))
        long = edited(rng, short, int(rng.integers(1, 3)))
        if len(long) < len(short):
            short, long = long, short
        if distance(short, long) > 2 or len(short) < 3:
            continue
        rounds = [{(7, 2, short)}, {(7, 2, long)}]
        for _ in range(6):
            for i in (0, 1):
                rounds[i] = {x for k, e, r in rounds[i] for x in (L.longer_keys(k, bool(i), e, r) if e else [(k, e, r)])}
            shared = {k for k, *_ in rounds[0]} & {k for k, *_ in rounds[1]}
            assert shared
            rounds = [{x for x in some if x[0] in shared} for some in rounds]


def test_template(spark):
    """Very many lines that differ in a number: 60,000 of them share keys, and only close numbers are linked."""
    rng = np.random.default_rng(13)
    some = sorted(rng.choice(10**12, 60_000, replace=False).tolist())
    some[5:8] = [some[4] + 1, some[4] + 2, some[4] + 30]
    line = "the page with the number {:012d} of a very long document that has a common first and last part"
    got = L.line_groups(spark.createDataFrame([(i, line.format(n)) for i, n in enumerate(some)], "doc_id long, text string").repartition(4))
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 60_000
    digits = np.array([list(f"{n:012d}") for n in some]).view(np.uint32).reshape(-1, 12)
    for i in [4, 5, 6, 7, *rng.integers(0, 60_000, 40).tolist()]:
        close = np.flatnonzero((digits != digits[i]).sum(axis=1) <= 4)
        want = {int(j) for j in close if j != i and distance(f"{some[i]:012d}", f"{some[j]:012d}") <= 2}
        assert want <= {j for j in rows if rows[j].class_doc_id == rows[i].class_doc_id} and rows[i].n_links >= len(want)
    assert rows[6].class_doc_id == 4 and not rows[6].kept and rows[4].kept
