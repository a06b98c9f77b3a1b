"""Similar names against all pairs, and names of one group that share most of their words."""
import random

from rosterlake.operators.merge import _group_links, _name_groups, best_duplicate, duplicate_roots
from rosterlake.operators.similar import similar_names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, name, n):
    for _ in range(n):
        at = rng.randrange(len(name) + 1)
        name = rng.choice([name[:at] + rng.choice("abé ") + name[at:], name[:at] + name[at + 1:], name[:at] + rng.choice("abc") + name[at + 1:]])
    return name


def test_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 30))) for _ in range(30)] + ["north water district", "a", "ab", "abcdefg", "x" * 60]
    names = [changed(rng, b, rng.randint(0, 5)) for b in base for _ in range(6)]
    rows = [(rng.choice(["IL", "UT", None]), n) for n in names] + [("IL", None), ("IL", ""), ("IL", names[0]), ("IL", names[0])]
    df = spark.createDataFrame(rows, "state string, name string").selectExpr("*", "1 AS length", "2 AS edits")
    for percent in (85, 70, 50):
        want = set()
        for s in ("IL", "UT"):
            mine = sorted({n for t, n in rows if t == s and n})
            want |= {(s, a, b) for i, a in enumerate(mine) for b in mine[i + 1:] if distance(a, b) <= max(len(a), len(b)) * (100 - percent) // 100}
        got = [tuple(r) for r in similar_names(df, ["state"], "name", percent).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert similar_names(df.where("false"), ["state"], "name").count() == 0


def test_words_that_all_names_share_form_no_pairs(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(12)) + " municipal water district" for _ in range(20_000)]
    twins = [n[:3] + "x" + n[4:] for n in names[:50]]
    df = spark.createDataFrame([("IL", n) for n in names + twins], "state string, name string")
    got = {(r.a, r.b) for r in similar_names(df, ["state"], "name", 94).collect()}  # two edits of 36 characters
    assert {tuple(sorted(p)) for p in zip(names, twins)} == got


def test_exploded_pieces_are_not_broadcast(spark):
    orgs = spark.createDataFrame([(i, f"Springfield Water {i}", "IL", "water", 1.0) for i in range(9)], "id long, name string, state string, org_type string, relevance_score double")
    for df in (similar_names(orgs, ["state"], "name"), _group_links(_name_groups(orgs), 85)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString() and df.count() > 0


def test_chains_of_similar_names_have_one_root(spark):
    rows = [(1, "Springfield Water", 1.0), (2, "Springfeld Water", 2.0), (3, "Springfeld Watr", 3.0), (4, "Shelbyville Water", 9.0), (5, "springfield water", None), (6, "Springfield Water Works", 0.5), (7, None, 1.0)]
    orgs = spark.createDataFrame([(i, n, "IL", "water", r) for i, n, r in rows], "id long, name string, state string, org_type string, relevance_score double")
    assert {(r.id, r.match_id) for r in best_duplicate(orgs).collect()} == {(5, 1), (6, 1)}
    assert {r.id: r.root_id for r in duplicate_roots(orgs, percent=90).collect()} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 3, 6: 3}
