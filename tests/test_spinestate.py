"""Spine state against line-by-line loops over hand-made and random scores."""

import random
from fractions import Fraction

from scoretables.operators import spinestate as S


def table(spark, docs):
    return spark.createDataFrame([(d, n, line) for d, lines in docs.items() for n, line in enumerate(lines)], "doc_id long, line_no long, line string")


def texts(df, *order):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, *(r[c] for c in order))):
        out.setdefault(r.doc_id, []).append(r.line)
    return out


T = "\t".join


def score(rng, types, n=60):
    """Lines whose splits, joins and ends are kept as lists of column lists."""
    state = [[t] for t in types]
    lines = ["!!!title", T(types)]
    for k in range(n):
        width = sum(map(len, state))
        what = rng.random()
        if what < 0.15 and width < 8:
            row, at = ["*"] * width, rng.randrange(width)
            row[at] = "*^"
            flat = [i for i, s in enumerate(state) for _ in s]
            state[flat[at]].append(types[flat[at]])
            lines.append(T(row))
        elif what < 0.3 and any(len(s) > 1 for s in state):
            i = rng.choice([i for i, s in enumerate(state) if len(s) > 1])
            run = rng.randint(2, len(state[i]))
            start = sum(map(len, state[:i]))
            row = ["*"] * width
            row[start : start + run] = ["*v"] * run
            state[i] = state[i][run - 1 :]
            lines.append(T(row))
        elif what < 0.35 and width > 3:
            i = rng.choice([i for i, s in enumerate(state) if s])
            row = ["*"] * width
            row[sum(map(len, state[:i]))] = "*-"
            state[i] = state[i][1:]
            lines.append(T(row))
        elif what < 0.4:
            lines.append(rng.choice(["", "!!!note", "!local"]))
        elif what < 0.5:
            lines.append(T([f"={k}"] * width))
        else:
            lines.append(T(rng.choice([f"{rng.choice([4, 8, 16, '8.', 12])}c", "."]) for _ in range(width)))
    return lines


def kept_by_loop(lines, keep):
    """The rule, column by column: the type of a field is that of the declared spine it descends from."""
    out, types = [], None
    for line in lines:
        row = line.split("\t")
        if not line.strip() or line.startswith("!!!") or len(row) == 1:
            out.append(line)
            continue
        if line.startswith("**"):
            types = row
        own = types
        if own is None:
            out.append(line)
            continue
        left = [x for x, t in zip(row, own) if t in keep]
        if left:
            out.append(T(left))
        if line.startswith("*") and not line.startswith("**"):
            following, joining = [], False
            for x, t in zip(row, own):
                if x == "*v" and joining:
                    continue
                joining = x == "*v"
                following += [] if x == "*-" else [t, t] if x == "*^" else [t]
            types = following
    return out


def test_types_by_loops(spark):
    rng = random.Random(0)
    docs = {d: score(rng, ["**kern", "**dynam", "**kern", "**text"][: 2 + d % 3]) for d in range(12)}
    docs |= {20: ["before\tit", T(["**kern", "**text"]), T(["*^", "*"]), T(["4c", "4e", "la"]), T(["*v", "*v", "*"]), T(["4c", "lo"]), T(["*-", "*-"])], 21: ["**kern", "4c", "*^", "4c\t4d"], 22: [], 23: [T(["**text", "**fing"]), "la\t1"]}
    for keep in (("**kern",), ("**kern", "**dynam"), ("**none",)):
        want = {d: kept_by_loop(lines, keep) for d, lines in docs.items()}
        assert texts(S.only_types(table(spark, docs), *keep), "line_no") == {d: x for d, x in want.items() if x}


def length(token):
    if token in ("", ".") or token[0] in "!*=":
        return None
    if "q" in token.lower():
        return Fraction(0)
    first = token.split(" ")[0]
    digits = "".join(c if c.isdigit() else " " for c in first).split()
    if not digits:
        return None
    n = int(digits[0])
    return (Fraction(8) if n == 0 else Fraction(4, n)) * (2 - Fraction(1, 2 ** first.count(".")))


def test_durations(spark):
    tokens = ["4c", "8.ee-", "[16..f", "(4A.", "0c", "16qc", ".", "", "r", ")4d", "12c 12e", "*M", "=1", "!x"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = {r.t: None if r.d is None else Fraction(r.d.num, r.d.den) for r in df.select("t", S.duration(df.t).alias("d")).collect()}
    assert got == {t: length(t) for t in tokens}


def clocks(lines):
    """The clock of every column at each barline after it, with the family that splits give it."""
    state, seen = [[Fraction(0), i] for i in range(2)], []
    family = 100
    for line in lines:
        row = line.split("\t")
        if len(row) > 1 and ("*^" in row or "*v" in row):
            following, k = [], 0
            while k < len(row):
                if row[k] == "*^":
                    following += [list(state[k]), list(state[k])]
                    k += 1
                elif row[k] == "*v":
                    run = k
                    while run < len(row) and row[run] == "*v":
                        run += 1
                    following.append([max(s[0] for s in state[k:run]), family])
                    k = run
                else:
                    following.append(state[k])
                    k += 1
            family += 1
            state = following
        elif line.startswith("="):
            seen.append([tuple(s) for s in state])
        elif line and line[0] not in "*!":
            for k, token in enumerate(row):
                # A rest of several parts plays one after the other; the notes of a chord at once.
                state[k][0] += sum(length(p) for p in token.split(" ")) if "r" in token else length(token) or 0
    return seen


def test_lagging_columns_catch_up(spark):
    by_hand = [T(["**kern", "**kern"]), T(["4c", "4e"]), T(["*^", "*"]), T(["4c", "8g", "4e"]), T(["4d", "4a", "4f"]), T(["=1"] * 3), T(["*v", "*v", "*"]), T(["2c", "2e"]), T(["=2"] * 2)]
    uneven = [T(["**kern", "**kern"]), T(["*^", "*"]), T(["2c", "4g", "1e"]), T(["=1"] * 3), T(["12c", "8g", "4e"]), T(["=2"] * 3)]
    rng = random.Random(1)

    def wild():
        lines, wide = [T(["**kern", "**kern"])], False
        for k in range(40):
            if k % 10 == 3:
                lines.append(T(["*^", "*"]))
                wide = True
            elif k % 10 == 8:
                lines.append(T(["*v", "*v", "*"]))
                wide = False
            elif k % 5 == 0:
                lines.append(T([f"={k}"] * (3 if wide else 2)))
            else:
                lines.append(T(rng.choice(["4c", "8d", "16e", "8.f", ".", "qg", "2a"]) for _ in range(3 if wide else 2)))
        return lines

    docs = {1: by_hand, 2: uneven, 3: [T(["**kern", "**kern"]), "4c\t8d", "=1\t=1"], **{10 + i: wild() for i in range(6)}}
    found = texts(S.caught_up(table(spark, docs)), "line_no", "sub")
    assert found[1] == [*by_hand[:4], T([".", "8r", "."]), *by_hand[4:]]
    assert found[2] == [*uneven[:3], T([".", "4r", "."]), uneven[3], uneven[4], T(["32r 128r", ".", "."]), uneven[5]]
    assert found[3] == docs[3]
    for d, lines in docs.items():
        assert [x for x in found[d] if x in set(lines)] == lines or d >= 10
        for at in clocks(found[d]):  # in every family the clocks agree at every barline, to less than a 64th of a quarter
            for family in {f for _, f in at}:
                own = [t for t, f in at if f == family]
                assert max(own) - min(own) < Fraction(1, 64) or len(at) <= 2


def test_division(spark):
    df = spark.createDataFrame([("8c", 2), ("[16.c 16.e", 4), ("1c", 4), ("r", 2), ("({32a", 2), ("c4", 2)], "t string, f int")
    assert [r[0] for r in df.select(S.divided(df.t, df.f)).collect()] == ["4c", "[4.c 4.e", "1c", "r", "({16a", "c4"]


def reflow_by_hand(lines, columns, factor, inside):
    """Onsets of all notes of a region, by plain loops."""
    clock, out = {}, []
    for n, line in enumerate(lines):
        if line.startswith("="):
            clock = {} if n < inside[0] else clock
        if not line or line[0] in "*!=":
            continue
        for k, token in enumerate(line.split("\t")):
            if token == ".":
                continue
            own = length(token) * (factor if k in columns and inside[0] <= n <= inside[1] else 1)
            if inside[0] <= n <= inside[1]:
                out.append((clock.get(k, Fraction(0)), k))
            clock[k] = clock.get(k, Fraction(0)) + own
    return sorted(out)


def test_rescaled_regions_reflow(spark):
    one = [T(["**kern", "**kern"]), T(["=1", "=1"]), T(["4c", "2e"]), T(["*rscale:2", "*"]), T(["8c", "4f"]), T(["!x", "!"]), T(["8d", "."]), T(["8e", "4g"]), T(["8f", "."]), T(["*rscale:1", "*"]), T(["4g", "4a"]), T(["=2", "=2"])]
    cue = [T(["**kern", "**kern"]), T(["*rscale:2", "*"]), T(["*cue", "*"]), T(["8c", "4f"]), T(["*Xcue", "*"]), T(["*rscale:1", "*"]), T(["4g", "4a"])]
    early = [T(["**kern", "**kern"]), T(["*cue", "*"]), T(["*rscale:2", "*clefG2"]), T(["8c", "4f"]), T(["*rscale:1", "*"])]
    beyond = [T(["**kern", "**kern"]), T(["4c", "4e"]), T(["*clefF4", "*rscale:4"]), T(["4c", "32e"]), T([".", "32f"]), T([".", "32g"]), T([".", "32a"]), T(["4d", "8b"])]
    nothing = [T(["**kern", "**kern"]), T(["*rscale:2", "*"]), T(["*rscale:1", "*"]), T(["4c", "4e"])]
    docs = {1: one, 2: cue, 3: early, 4: beyond, 5: nothing, 6: ["4c\t4e"]}
    found = texts(S.reflowed(table(spark, docs)), "line_no", "place", "sub")
    # The upper column starts a quarter after the lower; its notes are quarters now.
    assert [x for x in found[1] if x[0] not in "*=!"] == [T(["4c", "2e"]), T(["4c", "."]), T(["4d", "4f"]), T(["4e", "4g"]), T(["4f", "."]), T(["4g", "4a"])]
    assert "rscale" not in T(found[1]) and T(["!x", "!"]) in found[1]
    assert found[2] == cue and found[3] == early and found[6] == docs[6]
    assert found[5] == [nothing[0], nothing[3]]
    assert found[4] == [beyond[0], beyond[1], T(["*clefF4", "*"]), T(["4c", "8e"]), T([".", "8f"]), T(["4d", "8g"]), T([".", "8a"]), T([".", "2b"])]
    # Onsets of what is printed are those of the rule, in order, one line for each.
    for lines, columns, factor, inside in ((one, {0}, 2, (3, 9)), (beyond, {1}, 4, (2, 7))):
        d = 1 if lines is one else 4
        onsets = reflow_by_hand(lines, columns, factor, inside)
        start = next(i for i, x in enumerate(found[d]) if x == lines[inside[0] - 1]) + 1
        printed = [x for x in found[d][start:] if x[0] not in "*!="][: len({t for t, _ in onsets})]
        assert [[k for k, token in enumerate(x.split("\t")) if token != "."] for x in printed] == [[k for s, k in onsets if s == t] for t in sorted({t for t, _ in onsets})]


def test_columns_of_lines_of_any_width(spark):
    """Spines and cues by a loop that keeps the state of every line, also where lines are wider or narrower than it."""
    from scoretables.operators import spines

    rng = random.Random(4)
    lines, want = [], {}
    for doc in range(8):
        state = None
        for n in range(50):
            row = [rng.choice(["4c"] * 12 + ["*^", "*v", "*v", "*-", "*cue", "*Xcue", "*"] * (rng.random() < 0.3)) for _ in range(rng.randint(1, 5))]
            lines.append((doc, n, row))
            state = [(i, False) for i in range(len(row))] if state is None else [*state, *[state[-1] if state else (0, False)] * len(row)][: len(row)]
            want |= {(doc, n, c): s for c, s in enumerate(state)}
            following, joining = [], False
            for (spine, cue), field in zip(state, row, strict=True):
                if field == "*v" and joining:
                    continue
                joining = field == "*v"
                own = (spine, field == "*cue" or cue and field != "*Xcue")
                following += [] if field == "*-" else [own, own] if field == "*^" else [own]
            state = following
    busy = {d for d, _, row in lines if set(row) & set(spines.OPERATORS)}
    found = {(r.doc_id, r.line_no, r.column): (r.spine, r.cue) for r in spines.assigned(spark.createDataFrame(lines, "doc_id long, line_no long, fields array<string>")).collect()}
    assert found == {k: s if k[0] in busy else (k[2], False) for k, s in want.items()}
