"""Operators 11 to 13 against brute force: nulls, ties, repeated rows, long groups, empty tables, clashing names."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomlake.llm import prefix_trie, repair, topk

TURNS = "conv_id long, turn long, role string, text string, conv long, said string, at string, depth int, sums string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in rows], TURNS).repartition(parts)


@pytest.fixture(scope="module")
def talks():
    """Conversations of all shapes: copies, shared beginnings, null ids, turns, roles and texts, ties, repeated rows, one long."""
    rng = random.Random(7)
    say = lambda: rng.choice(["", " \t", "yes.", "no", "why?", "a b c.", "ünd so", "end!  "])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
    rows = []
    for c in [*range(45), 60, 77, -3, -21, None]:
        for t in range(rng.randrange(0, 7)):
            rows.append((c, rng.choice([t, t, t, None, t + 3]), role(), rng.choice([say(), say(), None])))
    for c in (100, 101, 119, 123, 161):
        rows += [(c, t, r, f"{r} {t}.") for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])]
    rows += [(200, t, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", f"t{t}", "same."])) for t in range(900)]
    rows += [(220, t, "user", f"u {t % 3}.") for t in range(150)]
    return rows + rows[5:25] + rows[5:9]


# ------------------------------------------------------------------ 11


def faulty(rows):
    """Rows after damage in order: (turn, role, text)."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c]
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if what == 1 else re.sub("[.!?]", "", x) if what == 2 else x
        out[c] += [(t, "user" if what == 4 else r, x)] * (0 if what == 0 else 2 if what == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def repaired(rows):
    """The contract's columns by a table over rows and output states, relaxed row by row."""
    seen, marks = set(), []
    for t, r, x in rows:
        w = WORD.findall(x)
        marks.append("b" if not w else "d" if (r, x) in seen else "t" if w[-1][-1] not in ".!?" else "")
        seen.add((r, x))
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))

    def insert(best):
        while True:  # until nothing gets lighter
            new = dict(best)
            for q, (c, a, out) in best.items():
                r = "assistant" if q == "u" else "user"
                new[r[0]] = min(new.get(r[0], (10**9, "", ())), (c + 5, a + "I", (*out, f"{r}:")), key=lambda v: v[:2])
            if new == best:
                return best
            best = new

    best = insert({"": (0, "", ())})
    for (_, role, text), mark in zip(rows, marks):
        new = {}

        def offer(q, value, new=new):
            if q not in new or value[:2] < new[q][:2]:
                new[q] = value

        for q, (c, a, out) in best.items():
            offer(q, (c + 2, a + "D", out))
            if mark in ("b", "d"):
                continue
            more = 5 * (mark == "t")
            if role[:1] == ("a" if q == "u" else "u") or role[:1] == "s" and q == "":
                offer(role[:1], (c + more, a + "K", (*out, f"{role}:{text}")))
            r = "assistant" if q == "u" else "user"
            offer(r[0], (c + 1 + more, a + "R", (*out, f"{r}:{text}")))
        best = insert(new)
    cost, audit, out = min((best[q] for q in ("", "a") if q in best), key=lambda v: v[:2])
    return gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, sha("\n".join(out))


@pytest.mark.parametrize("block", [256, 3])
def test_repair(spark, talks, block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", block)
    got = {r[0]: tuple(r[1:]) for r in repair.repair(turns(spark, talks)).collect()}
    want = {c: repaired(rows) for c, rows in faulty(talks).items()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


def test_agenda_equals_all_edit_sequences():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(0, 4))]
        least = None
        for n in range(len(rows), len(rows) + 4):
            for audit in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in audit) != len(rows):
                    continue
                given, state, cost = iter(rows), repair.START, 0
                for e in audit:
                    initial, must_go, cut = ("", False, False) if e == "I" else next(given)
                    if e == "D":
                        cost += 2
                        continue
                    cost += {"I": 5, "K": 0, "R": 1}[e] + 5 * cut
                    state = None if must_go or state is None else repair.after(state, initial if e == "K" else "a" if state == repair.USER else "u")
                    if state is None:
                        break
                if state in repair.ENDS and (least is None or (cost, "".join(audit)) < least):
                    least = cost, "".join(audit)
        assert list(repair.lightest(rows).values()) == [least]


def test_repair_of_a_hot_conversation_is_spread(spark):
    """A third of all rows in one conversation, many of them equal."""
    rows = [(1, t, "user" if t % 2 else "assistant", f"w{t}.") for t in range(3000)] + [(1, 5, "user", "same.")] * 3000 + [(c, t, "user", "x.") for c in range(2, 3000) for t in range(2)]
    got = {r[0]: tuple(r[1:]) for r in repair.repair(turns(spark, rows, 8)).collect()}
    assert got[1] == repaired(faulty(rows)[1]) and len(got) == 2999


# ------------------------------------------------------------------ 12

VECTORS = "vec_id long, embedding array<float>, label int, node string, ids string, q int, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 3, "z") for i, v in rows], VECTORS)


def nearest(rows, k=20):
    use = {(i, tuple(int(np.floor(np.float64(np.float32(x)) * 64)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, v in use:
        if i % 20 == 0:
            top = heapq.nsmallest(k, ((-sum(a * b for a, b in zip(v, w)), j) for j, w in use if j != i))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(top, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 50)])
def test_top_k(spark, blocks, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(40) * [1, 9][i % 3 == 0]).tolist()) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(300, 460)]  # a large group of equal vectors, queries among them
    rows += [(500, None), (501, [None, 1.0]), (502, [float("nan"), 1.0]), (520, [float("inf")]), (None, rows[1][1]), (540, []), (560, [0.5, -0.25]), (580, [0.0] * 40)]
    rows += rows[20:30] + [(40, rows[7][1])]  # repeated rows, and an id with two vectors
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect())) == nearest(rows)


def test_top_k_of_few_large_or_no_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [3.0, -1.0]), (3, [0.0, 0.0])]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect())) == nearest(rows)
    rows = [(i, [float(2 ** (i % 25)), -1.5, float(i)]) for i in range(60)]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect())) == nearest(rows)
    rows = [(0, [3e38, 1.0]), (1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 1.0])]
    assert [r.vec_id for r in sorted(topk.top_k(vectors(spark, rows)).collect(), key=lambda r: r["rank"])] == [1, 3, 2]
    assert topk.top_k(vectors(spark, [])).collect() == []


def test_bounds_drop_candidates_and_no_winner():
    rng = np.random.default_rng(5)
    columns = topk.vertical((rng.standard_normal((4000, 64)) * 9).round().astype(int).tolist(), 64)
    columns[:, :30] *= 4
    squares = columns * columns
    for query in columns.T[:20]:
        whole = query @ columns
        at, score = topk.best(query, columns, squares, squares.sum(0), 10, -np.inf)
        assert len(at) < 2000 and (score == whole[at]).all()
        assert set(np.flatnonzero(whole >= np.partition(whole, -10)[-10])) <= set(at)


# ------------------------------------------------------------------ 13


def trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, said in own.items():
        h, from_ = zlib.crc32(str(c).encode()) % 4, int(c / 20) * 20
        rebuilt[c] = own.get(from_, [])[:h] + said[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, m in members.items():
        children[p[:-1]] += bool(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(rebuilt[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(ends)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(64, 2048), (4, 20)])
def test_trie(spark, talks, sizes, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", sizes[0])
    monkeypatch.setattr(prefix_trie, "SHARD", sizes[1])
    want = trie(talks)
    assert sorted(map(tuple, prefix_trie.prefix_trie(turns(spark, talks)).collect()), key=repr) == want
    assert len(want) > 900


def test_trie_of_hot_beginnings_and_no_rows(spark):
    rng = random.Random(4)
    rows = [(c, t, "user", "hello there" if t < 2 else rng.choice("abc")) for c in range(400) for t in range(rng.randrange(1, 8))]
    rows += [(c, t, "user", f"copy {t}") for c in range(400, 600) for t in range(6)]
    assert sorted(map(tuple, prefix_trie.prefix_trie(turns(spark, rows)).collect()), key=repr) == trie(rows)
    assert prefix_trie.prefix_trie(turns(spark, [])).collect() == []
    assert repair.repair(turns(spark, [])).collect() == []


def test_double_array_holds_its_paths_only():
    rng = random.Random(9)
    paths = sorted({tuple(rng.randrange(1, 40) for _ in range(rng.randrange(1, 6))) for _ in range(500)})
    base, check = prefix_trie.pack([np.array(p) for p in paths], 40)
    cells = {p[:d]: prefix_trie.walk(base, check, np.array(p[:d]))[-1] for p in paths for d in range(1, len(p) + 1)}
    assert len(set(cells.values())) == len(cells) == (check[1:] >= 0).sum()
    for p in itertools.product(range(1, 40), repeat=2):
        if p not in cells:
            with pytest.raises(KeyError):
                prefix_trie.walk(base, check, np.array(p))
