"""Ranked preference match (J4), lookup with default (J5), name union."""

from corpusworks.operators import relational as rel


def test_preference_fixture(spark):
    names = spark.createDataFrame([("g1", "Oak:8b", 0), ("g1", "fir3", 1), ("g1", "other", 2),
                                   ("g2", "other", 0), ("g2", "zzz", 1),
                                   ("g3", "elm-7b", 0), ("g3", "birch-r1:7b", 1), ("g3", "Birch-R1:1.5B", 2)],
                                  "grp string, name string, pos int")
    prefs = rel.preference_table(spark, ["birch-r1:1.5b", "birch-r1", "oak", "fir3", "elm"])
    got = {r["grp"]: (r["chosen"], r["matched"]) for r in rel.ranked_preference(names, prefs, ["grp"]).collect()}
    # substring of the lower-cased name; first preference wins, then first position
    assert got["g1"] == ("Oak:8b", True)
    assert got["g2"] == ("other", False)
    assert got["g3"] == ("Birch-R1:1.5B", True)


def test_lookup_with_default(spark):
    df = spark.createDataFrame([("provider",), ("theme",), ("missing",)], "k string")
    own = {"provider": "local", "theme": "plain"}
    got = {r["k"]: r["mapped"] for r in rel.lookup_with_default(df, own, "k", "DEF").collect()}
    assert got == {"provider": "local", "theme": "plain", "missing": "DEF"}
    table = spark.createDataFrame([("theme", "Light")], "k string, v string")
    got = {r["k"]: r["mapped"] for r in rel.lookup_table_with_default(df, table, "k", "v", "?").collect()}
    assert got == {"provider": "?", "theme": "Light", "missing": "?"}


def test_union_names(spark):
    a = spark.createDataFrame([("b",), ("a",)], "x string")
    b = spark.createDataFrame([("a",), ("c",)], "y string")
    assert [r["name"] for r in rel.union_names(a, b).collect()] == ["a", "b", "c"]


def test_preferences_of_any_number_and_length(spark):
    import random
    r = random.Random(5)
    words = ["".join(r.choice("abcAB é") for _ in range(r.randint(0, 7))) for _ in range(300)]
    rows = [(f"g{i % 40}", w, i) for i, w in enumerate(words)] + [("g1", None, 900), ("none", None, 901)]
    names = spark.createDataFrame(rows, "grp string, name string, pos int")
    for prefs in (["".join(r.choice("abc é") for _ in range(r.randint(1, 6))) for _ in range(12_000)] + [None], ["zz", "b", "ca"],
                  ["nowhere", ""], []):
        table = rel.preference_table(spark, prefs)
        got = {x["grp"]: (x["chosen"], x["matched"]) for x in rel.ranked_preference(names, table, ["grp"]).collect()}
        rank = {}
        for i, p in enumerate(prefs):
            rank.setdefault(p, i)
        for grp in {g for g, _, _ in rows}:
            own = [(w, pos) for g, w, pos in rows if g == grp]
            found = [(rank[p], pos, w) for w, pos in own if w is not None
                     for p in {w.lower()[a:b] for a in range(len(w) + 1) for b in range(a, len(w) + 1)} if p in rank]
            assert got[grp] == ((min(found)[2], True) if found else (min(own, key=lambda x: x[1])[0], False))


def test_lookup_in_a_large_mapping(spark):
    df = spark.createDataFrame([(str(i),) for i in range(5)], "k string")
    big = {str(i): f"v{i}" for i in range(20_000)}
    got = {r["k"]: r["mapped"] for r in rel.lookup_with_default(df, big, "k", "?").collect()}
    assert got == {str(i): f"v{i}" for i in range(5)}
