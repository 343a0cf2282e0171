"""Rhythms against loops with exact fractions."""

import random
from fractions import Fraction

from scoretables.operators import rhythms as R

NAMES = [*R.PLAIN, *R.WITH_DOT, *R.TRIPLETS, *R.OTHERS]


def size(name):
    n = int(name.rstrip("."))
    return (Fraction(2) if n == 0 else Fraction(1, n)) * (Fraction(3, 2) if name.endswith(".") else 1)


def even(longs, shorts):
    """Long and short letters by carrying an error from place to place."""
    total, few = longs + shorts, min(longs, shorts)
    rare, common = ("L", "S") if longs <= shorts else ("S", "L")
    if few == 0:
        return ("L" if longs else "S") * total
    out, error, placed = "", 0, 0
    for _ in range(total):
        error += few
        if error >= total - placed:
            out, error, placed = out + rare, error - total, placed + 1
        else:
            out += common
    return out


def test_values(spark):
    assert {r.name: Fraction(r.num, r.den) for r in R.table(spark).collect()} == {n: size(n) for n in NAMES}
    assert all(r.parts * r.den == r.num * R.PARTS for r in R.table(spark).collect())


def test_spread_for_all_numbers_to_64(spark):
    pairs = [(a, n - a) for n in range(1, 65) for a in range(n + 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    found = {(r.a, r.b): "".join("L" if x else "S" for x in r.s) for r in df.select("a", "b", R.spread(df.a, df.b).alias("s")).collect()}
    assert found == {p: even(*p) for p in pairs}
    assert found[2, 1] == "LLS" and found[1, 2] == "SSL"


def test_nearest_of_every_dotted_number(spark):
    df = spark.range(1, 257).selectExpr("3 as num", "2 * id as den", "id")
    for r in df.select("id", R.nearest(df.num.cast("long"), df.den.cast("long")).alias("name")).collect():
        d = Fraction(3, 2 * r.id)
        assert r.name == min(NAMES, key=lambda n: (abs(d - size(n)), NAMES.index(n)))


def solve(x, y, n):
    d = Fraction(y, x)
    if y == 3 and x in (4, 8, 16, 32, 64, 128):
        return "dotted", [f"{x // 2}."] * n
    grid = [Fraction(1, g) for g in R.GRID]
    longer, shorter = [g for g in grid if g >= d], [g for g in grid if g <= d]
    if longer and shorter:
        a, b = min(longer), max(shorter)
        if a == b:
            return "same", [str(1 / a)] * n
        count = (n * d - n * b) / (a - b)
        if count.denominator == 1 and 0 <= count <= n:
            return "mixed", [str(1 / (a if c == "L" else b)) for c in even(int(count), n - int(count))]
    if n == 1:
        pairs = [(abs(size(u) - size(v)), -size(u), [u, v]) for u in NAMES for v in NAMES if size(u) + size(v) == d]
        if pairs:
            return "pair", min(pairs)[2]
    best = min([("176", Fraction(1, 44))] + sorted(((m, size(m)) for m in NAMES), key=lambda m: -m[1]), key=lambda m: abs(d - m[1]))
    return "nearest", [best[0]] * n


def test_solutions(spark):
    cases = sorted({(x, y, n) for x in (*range(1, 60), 64, 88, 96, 128, 200, 300) for y in (1, 2, 3, 4, 5, 7, 9) for n in (1, 2, 3, 5, 8)} | {(44, 1, 2), (8, 9, 1), (56, 3, 6)})
    found = {(r.x, r.y, r.n): (r.kind, r.pair or r.names) for r in R.solved(spark.createDataFrame(cases, "x long, y long, n long")).collect()}
    for c in cases:
        assert found[c] == solve(*c), c
        kind, names = found[c]
        if kind != "nearest":
            assert sum(map(size, names)) == Fraction(c[1], c[0]) * (1 if kind == "pair" else c[2])
    assert {k for k, _ in found.values()} == {"dotted", "same", "mixed", "pair", "nearest"}


def test_runs_keep_their_time(spark):
    rng = random.Random(0)
    rows = []
    for doc in range(6):
        for spine in range(2):
            ratio = "8%3"
            for line in range(60):
                if rng.random() < 0.3:
                    ratio = rng.choice(["8%3", "56%3", "7%2", "28%3", "8%9", "9%2", "20%3"])
                token = rng.choice([".", f"{ratio}c", f"[{ratio}ee-", f"{ratio}r", "4g", f"{ratio}d", f"{ratio}e"])
                rows.append((doc, line, spine, "=" if line % 9 == 8 else token, line % 9 == 8))
    found = {}
    for r in R.without_ratios(spark.createDataFrame(rows, "doc_id long, line_no long, spine long, token string, is_bar boolean")).collect():
        found.setdefault((r.doc_id, r.spine, r.line_no), {})[r.sub] = (r.token, r.kind)
    want = {}
    for doc in range(6):
        for spine in range(2):
            run = []

            def flush(run=run, doc=doc, spine=spine):
                if run:
                    x, y = map(int, run[0][1].split("%"))
                    kind, names = solve(x, y, len(run))
                    for i, (line, ratio, token) in enumerate(run):
                        if kind == "pair":
                            rest = token.lstrip("[({").replace(ratio, "")
                            a, b = ("", "") if rest[0] == "r" else ("[", "]")
                            want[doc, spine, line] = {0: (a + names[0] + rest, kind), 1: (names[1] + rest + b, kind)}
                        else:
                            want[doc, spine, line] = {0: (token.replace(ratio, names[i]), kind)}
                    run.clear()

            for d, line, s, token, is_bar in rows:
                if (d, s) != (doc, spine) or token == ".":
                    continue
                ratio = None if is_bar or "%" not in token else "".join(c for c in token if c.isdigit() or c == "%")
                if ratio is None or run and run[-1][1] != ratio:
                    flush()
                if ratio:
                    run.append((line, ratio, token))
            flush()
    assert found == want


def mixture(d, n):
    """(long, short, count of long) by fractions, or None."""
    longer, shorter = [m for m in NAMES if size(m) >= Fraction(1, d)], [m for m in NAMES if size(m) <= Fraction(1, d)]
    if not longer or not shorter or n > R.LARGEST_GROUP:
        return None
    a, b = min(longer, key=size), max(shorter, key=size)
    x = Fraction(n) if a == b else (Fraction(n, d) - n * size(b)) / (size(a) - size(b))
    return (a, b, int(x)) if x.denominator == 1 and 0 <= x <= n else None


def test_group_solutions(spark):
    cases = [(d, n) for d in range(1, 180) for n in (*range(1, 13), 18, 30, 31)]
    found = {(r.d, r.n): r.long and (r.long, r.short, r.n_long) for r in R.group_solutions(spark.createDataFrame(cases, "d long, n long")).collect()}
    assert found == {c: mixture(*c) for c in cases}
    assert all(v is None or v[2] * size(v[0]) + (n - v[2]) * size(v[1]) == Fraction(n, d) for (d, n), v in found.items())


def test_groups_in_scores(spark):
    lines = ["42c", "[42d]", ".", "q", "42r", "=", "42c", "9e", "9f", "4g", "9a", "9b", "9c", "9d", "9e", "9f", "9g", "9a", "9b"]
    rows = [(1, i, 0, t, t == "=") for i, t in enumerate(lines)]
    found = {r.line_no: (r.token, r.exact) for r in R.without_unknown_groups(spark.createDataFrame(rows, "doc_id long, line_no long, spine long, token string, is_bar boolean")).collect()}
    want = {}
    for run in ([0, 1, 4], [6], [7, 8], list(range(10, 19))):
        number = "".join(c for c in lines[run[0]].lstrip("[") if c.isdigit())
        answer = mixture(int(number), len(run))
        letters = even(answer[2], len(run) - answer[2]) if answer else ""
        for k, i in enumerate(run):
            want[i] = (lines[i].replace(number, answer[0] if letters[k] == "L" else answer[1], 1), True) if answer else (lines[i], False)
    assert found == want and {e for _, e in found.values()} == {True, False}
