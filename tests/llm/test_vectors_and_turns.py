"""Centroid clustering, conversation repair and near-duplicate vectors against brute-force versions, and their odd inputs."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from quillstone.llm import centroids, graph_search, html_text, queries, secret_scan, turn_repair, vector_dedup

DATA = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def plain(df, cols):
    return sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_turn_repair", "op13_vector_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(want.columns)) == plain(want, sorted(want.columns))


# --- centroids ---------------------------------------------------------------------------
def test_bounds_hold_and_screening_changes_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (12, centroids.DIM))
    x = centres[rng.integers(12, size=400)] + rng.integers(-300, 300, (400, centroids.DIM))
    x[:20] = centres[3]  # ties with the copy of a centroid below
    c = np.vstack([centres, centres[3]])
    exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    short, short_c = centroids.compressed(x), centroids.compressed(c)
    assert (((short[:, None] - short_c[None]) ** 2).sum(axis=2) <= exact * (1 + 1e-9) + 1e-6).all()
    at, best, met = centroids.nearest(x, short, c, short_c)
    assert (at == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert met.mean() < 4, "most centroids are screened"


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=64).tolist()) for i in range(30)]
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [NAN] + [0.0] * 63), (105, [None] + [0.0] * 63), (106, [INF] + [0.0] * 63), (107, [1e300] + [0.0] * 63)]
    kept = [*good, good[3], (None, [0.5] * 64), (200, good[4][1]), (201, [0.0] * 64), (202, [-300000.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in kept + odd], "vec_id long, embedding array<double>, cluster int, inertia string")
    rows = centroids.clusters(df, k=5, rounds=3).collect()
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v in kept], dtype=object)
    named = [k for k, (i, _) in enumerate(kept) if i is not None]
    first = sorted(named, key=lambda k: (hashlib.sha256(f"2:{kept[k][0]}".encode()).hexdigest(), list(x[k])))[:5]
    c = [list(x[k]) for k in first]
    near = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for v in x]
    for _ in range(3):
        at = near()
        for j in range(5):
            own = [v for v, (_, k) in zip(x, at, strict=True) if k == j]
            c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)] if own else c[j]
    at = near()
    sums = {j: sum(d for d, k in at if k == j) for j in range(5)}
    digest = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    want = sorted((str(i), j, d, sums[j], sum(sums.values()), digest(j)) for (i, _), (d, j) in zip(kept, at, strict=True))
    assert sorted((str(r[0]), *tuple(r)[1:6]) for r in rows) == want
    assert centroids.clusters(df.where("vec_id > 99 and vec_id < 200")).count() == 0 == centroids.clusters(df.limit(0)).count()
    assert centroids.clusters(df.where("vec_id < 3")).select("cluster").distinct().count() == 3


# --- conversations -----------------------------------------------------------------------
def repaired_by_hand(rows):
    """Every conversation's row by damage and a shortest path over (turn, state) in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        said = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        said += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    leads, word = {"e": "su", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    out = {}
    for conv, said in convs.items():
        said.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in said:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        paths = {"e": (0, "", ())}

        def inserted(paths):
            for _ in range(3):
                for state, (cost, audit, made) in list(paths.items()):
                    for to in leads[state].replace("s", ""):
                        one = (cost + 5, audit + "I", (*made, word[to] + ":"))
                        paths[to] = min(paths.get(to, one), one, key=lambda p: p[:2])
            return paths

        paths = inserted(paths)
        for (_, role, text), fault in zip(said, faults, strict=True):
            new = []
            for state, (cost, audit, made) in paths.items():
                new.append((state, (cost + 2, audit + "D", made)))
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault else 0
                    if role and role[0] in leads[state]:
                        new.append((role[0], (cost + more, audit + "K", (*made, f"{role}:{text}"))))
                    new += [(to, (cost + more + 1, audit + "R", (*made, f"{word[to]}:{text}"))) for to in leads[state].replace("s", "")]
            paths = {}
            for state, one in new:
                paths[state] = min(paths.get(state, one), one, key=lambda p: p[:2])
            paths = inserted(paths)
        cost, audit, made = min((paths[s] for s in "ea" if s in paths), key=lambda p: p[:2])
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def test_repairs_equal_a_plain_search(spark):
    rnd = random.Random(1)
    rows = [
        (conv, rnd.choice([k, k, k, k, None, k // 2, k + 3]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua"]), rnd.choice(["Hi.", "Hi", "Yes! ", "no?\n", " ", "", None, f"x{k}.", "é…", "a\nb.", "\x0b."]))
        for conv in [*range(300), None]
        for k in range(rnd.choice([0, 1, 2, 3, 5, 8, 13]))
    ]
    rows += rows[:40]  # rows that repeat
    rows += [(900, k, "user", "again " * 20000 + ".") for k in range(3)] + [(901, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(3000)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, pos string")
    got = {r[0]: tuple(r)[1:] for r in turn_repair.digests(turn_repair.repairs(turn_repair.damaged(df))).collect()}
    want = repaired_by_hand(rows)
    assert set(got) == set(want)
    assert {k: (got[k], w) for k, w in want.items() if got[k] != w} == {}
    assert turn_repair.repairs(turn_repair.damaged(df.limit(0))).count() == 0


def test_repairs_are_text_and_windows_share_an_exchange(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.", 0, False), (1, 2, "user", "b.", 0, False)], "conv_id long, turn long, role string, text string, copy int, gone boolean")
    found = turn_repair.repairs(df)
    r = found.first()
    assert (r.cost, r.audit, [tuple(t) for t in r.repaired]) == (1, "KR", [("user", "a."), ("assistant", "b.")])
    plan = turn_repair.digests(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


# --- near-duplicate vectors ----------------------------------------------------------------
def linked_by_hand(rows, similarity=vector_dedup.SIMILARITY):
    """(links, least id reached) of each row by all pairs of a label."""
    ok = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in ok}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= similarity:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k in ok:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return [(i, links[k], least[find(k)] if k in unit else i) for k, (i, _, _) in enumerate(rows)]


def near(rng, base, cosine):
    """A direction at the cosine from base."""
    e = rng.normal(size=len(base))
    e -= (e @ base) * base
    return cosine * base + np.sqrt(1 - cosine**2) * e / np.linalg.norm(e)


def check_links(spark, rows):
    df = spark.createDataFrame([(i, v, lab, 5, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label string, node int, kept string")
    got = vector_dedup.near_duplicates(df).collect()
    show = lambda rs: sorted((str(i), n, str(c)) for i, n, c in rs)
    assert show((r[0], r[1], r[2]) for r in got) == show(linked_by_hand(rows))
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)
    assert {r.audit_recall for r in got} == {1.0}


def test_links_of_groups_chains_and_copies(spark):
    rng = np.random.default_rng(3)
    unit = lambda d=16: (lambda v: v / np.linalg.norm(v))(rng.normal(size=d))
    rows = [(k, unit().tolist(), "ab"[k % 2]) for k in range(150)]  # loners, most of them
    tight = unit()
    rows += [(1000 + k, (near(rng, tight, 0.995) * rng.choice([1, 7, 1e-200, 1e200])).tolist(), "a") for k in range(60)]  # more than a list holds
    wide = unit()
    rows += [(2000 + k, near(rng, wide, rng.uniform(0.93, 0.99)).tolist(), "a") for k in range(60)]  # a saturated component with a rim
    chain = [unit()]
    for _ in range(25):
        chain.append(near(rng, chain[-1], 0.94))
    rows += [(3000 + k, v.tolist(), "b") for k, v in enumerate(chain)]
    rows += [(4000 + k, chain[0].tolist(), "b") for k in range(20)] + [(1001, rows[151][1], "a"), (1001, rows[152][1], "a")]
    check_links(spark, rows)


def test_saturated_groups_that_touch(spark):
    rng = np.random.default_rng(4)
    one = rng.normal(size=32)
    one /= np.linalg.norm(one)
    two = near(rng, one, 0.935)
    rows = [(k, near(rng, one, 0.9995).tolist(), "a") for k in range(40)] + [(100 + k, near(rng, two, 0.9995).tolist(), "a") for k in range(40)]
    rows += [(200 + k, rng.normal(size=32).tolist(), "a") for k in range(40)]
    assert any(n > 40 for _, n, _ in linked_by_hand(rows)), "links across groups"
    check_links(spark, rows)


def test_odd_vectors_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, "a"), (2, [2.0, 4.0, 6.0], "a"), (3, v, "b"), (4, v, None), (5, None, "a"), (6, [0.0, 0.0, 0.0], "a"), (7, [1.0, NAN, 3.0], "a"), (8, [1.0, None, 3.0], "a"), (9, [INF, 2.0, 3.0], "a"), (None, v, "a"), (10, [], "a"), (11, [1.0, 2.0], "a"), (12, [1e300, 2e300, 3e300], "a")]
    check_links(spark, rows)
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.near_duplicates(df).count() == 0


# --- what the operators before them had wrong -----------------------------------------------
def test_a_long_run_of_plurals_is_read():
    assert len(secret_scan.scan("s" * 1_000_000 + "=abc1234567")) == len(secret_scan.scan("s" * 900 + "=abc1234567"))
    assert secret_scan.word_score("passwordsss") == secret_scan.word_score("password") > 0


def test_scores_of_vectors_of_any_scale_and_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_search, "SHARD", 120)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(600, 8))
    rows = [(k, (v * (1e200, 1e-200, 1.0)[k % 3]).tolist()) for k, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = graph_search.nearest(df, graph_search.F.pmod("vec_id", graph_search.F.lit(20)) == 0).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    assert len(got) == 150 and all(abs(r.score - sims[r.query_id, r.vec_id]) < 1e-12 for r in got)
    true = {(q, int(i)) for q in range(0, 600, 20) for i in np.argsort(-sims[q])[:5]}
    assert len(true & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(true)


def test_pages_of_any_depth_keep_their_layout():
    inner = "<ul><li>a<ul><li>b</ul></ul><table><tr><td>x<td>long cell<tr><td>y<td>z</table>"
    want = "- a\n  - b\n\nx  long cell\ny  z"
    assert html_text.rendered(inner) == want
    for depth in (3, 398, 10_000):
        assert html_text.rendered("<div>" * depth + inner) == want
    assert html_text.rendered("<ul><li>a" * 90) == "\n".join("  " * k + "- a" for k in range(90))
    deep = html_text.rendered("<ul><li>a" * 5000 + "<table><tr><td>x<td>y</table>")
    assert deep.count("- a") == 5000 and max(map(len, deep.split("\n"))) < html_text.MOST_INSET + 10 and deep.split()[-2:] == ["x", "y"]
    assert html_text.rendered("<table><tr><td>b<td>" * 5000 + "end").split() == ["b"] * 5000 + ["end"]
    assert html_text.rendered("<p>a" + "<span>" * 100_000 + "</i>" * 100_000 + "b") == "ab"
