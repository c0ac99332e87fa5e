import random

from sitescope.operators import names


def test_one_after_another(spark):
    """Bases whose names do not meet: as if each row were placed alone, in order."""
    rng = random.Random(4)
    bases = ["alpha", "beta", "a b c"]
    taken = {rng.choice(["alpha", "beta", "a-b-c"]) + rng.choice(["", "-2", "-3", "-5", "-10", "-07", "-1"]) for _ in range(9)} | {"alpha-x"}
    new = [(i, rng.choice([*bases, "ALPHA!", None, "  "])) for i in range(120)]
    want, used = {}, set(taken)
    for i, name in new:
        base = names.NAMELESS if not (name or "").strip() else "-".join(name.lower().replace("!", "").split())
        found, n = base, 1
        while found in used:
            n += 1
            found = f"{base}-{n}"
        used.add(found)
        want[i] = found
    df = names.place(spark.createDataFrame(new, "i int, name string"), spark.createDataFrame([(t,) for t in taken] + [(None,)], "slug string"), ["i"])
    assert {r["i"]: r["slug"] for r in df.collect()} == want and df.columns == ["i", "name", "slug"]


def test_bases_that_meet(spark):
    """ "a 2" is a base and a numbered name of "a": all names differ, none is taken, and a row alone gets its base."""
    new = [(i, n) for i, n in enumerate(["a", "a 2", "a", "a", "a 2", "a-2-2", "b"])]
    rows = names.place(spark.createDataFrame(new, "i int, name string"), spark.createDataFrame([("a",)], "slug string"), ["i"]).collect()
    got = {r["i"]: r["slug"] for r in rows}
    assert len(set(got.values())) == 7 and "a" not in got.values() and got[0] == "a-2" and got[6] == "b"
    assert all(s.startswith(n.replace(" ", "-")) for (i, n) in new for s in [got[i]])


def test_nothing_new(spark):
    none = spark.createDataFrame([], "i int, name string")
    assert names.place(none, spark.createDataFrame([("a",)], "slug string"), ["i"]).count() == 0
