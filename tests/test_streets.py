"""Spellings of streets: the rungs of a name, ties of two streets, published synonyms."""

from pyspark.sql import functions as F

from silthouse.operators import resolve as R


def ladders(spark, *names):
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", R.street_ladder(F.col("n")).alias("l")).collect()
    return {r.n: [(x.variant, x.kind, x.weight) for x in r.l] for r in rows if r.l is not None}


def test_rungs(spark):
    got = ladders(spark, "שדרות רוטשילד", "הדרך", "רח' הרצל (הישנה)", "שמואל יבניאלי", "הזית", "", "?", None, "א", "Street Elm", "st ab", "elm elm", "Big Oak Oak")
    assert got["שדרות רוטשילד"][:2] == [("שדרותרוטשילד", "official", 100), ("רוטשילד", "no_type", 85)] and "רותרוטשילד" not in [v for v, *_ in got["שדרות רוטשילד"]]
    assert got["הדרך"] == [("הדרך", "official", 100), ("דרך", "no_article", 70)]
    herzl = {v: (k, w) for v, k, w in got["רח' הרצל (הישנה)"]}
    assert herzl == {"רחהרצלהישנה": ("official", 100), "רחהרצל": ("no_paren", 90), "הרצלהישנה": ("no_type", 85), "הרצל": ("no_type", 85), "רצלהישנה": ("no_article", 70), "רצל": ("no_article", 70), "הרצלרח": ("token_set", 60)}
    assert got["שמואל יבניאלי"] == [("שמואליבניאלי", "official", 100), ("יבניאלישמואל", "token_set", 60), ("יבניאלי", "last_token", 40)]
    assert got["הזית"][1] == ("זית", "no_article", 70)
    assert got[""] == got["?"] == got["א"] == []
    assert got["Street Elm"] == [("streetelm", "official", 100), ("elm", "no_type", 85), ("elmstreet", "token_set", 60)]  # a last word of three letters says too little
    assert got["st ab"] == [("stab", "official", 100), ("abst", "token_set", 60)]  # too little would be left
    assert got["elm elm"] == [("elmelm", "official", 100)]
    assert ("bigoakoak", "official", 100) in got["Big Oak Oak"]


def test_ties_stand_for_no_street(spark):
    streets = spark.createDataFrame([(1, "a", "דוד המלך"), (1, "b", "שלמה המלך"), (2, "c", "שלמה המלך"), (1, "d", "דרך עכו"), (1, "e", "עכו"), (1, "f", None)], "town int, key string, name string")
    got = {(r.town, r.variant): r.key for r in R.settled_streets(R.street_aliases(streets, "town", "key", "name")).collect()}
    assert (1, "המלך") not in got and got[2, "המלך"] == "c"  # two streets of one town end alike
    assert got[1, "עכו"] == "e" and got[1, "דרךעכו"] == "d"  # a name of its own beats what another street's name leaves
    asked = spark.createDataFrame([(1, "המלך דוד"), (2, "רחוב המלך"), (1, "המלך"), (1, None), (9, "עכו")], "town int, name string")
    want = {(1, "המלך דוד"): ("a", "token_set"), (2, "רחוב המלך"): ("c", "no_type"), (1, "המלך"): (None, None), (1, None): (None, None), (9, "עכו"): (None, None)}
    settled = R.settled_streets(R.street_aliases(streets, "town", "key", "name"))
    assert {(r.town, r.name): (r.key, r.kind) for r in R.matched_streets(asked, settled).collect()} == want
    assert R.matched_streets(asked.limit(0), settled).count() == 0


def test_published_spellings(spark):
    streets = spark.createDataFrame([(1, "a", "Oak Lane", 7), (1, "b", "Elm Lane", 8), (1, "c", "Ash", None)], "town int, key string, name string, code int")
    official = spark.createDataFrame([(1, 7, "Oak", "official"), (1, 7, "Old Oak", "synonym of 7"), (1, 8, "Lane", "synonym of 8"), (1, 99, "Nowhere", "official"), (1, None, "None", "official"), (1, 8, None, None)], "town int, code int, name string, status string")
    synonyms = spark.createDataFrame([(1, "Ash", "Mountain Ash"), (1, "unknown", "Old Oak"), (1, "no", "nothing"), (1, "Ash", "Oak"), (1, "Ash", "ash"), (1, "Ash", None)], "town int, name string, synonym string")
    aliases = R.street_aliases(streets, "town", "key", "name").unionByName(R.published_aliases(streets, official))
    got = {r.variant: (r.key, r.weight) for r in R.settled_streets(aliases, synonyms).collect()}
    assert got["oak"] == ("a", 100) and got["oldoak"] == ("a", 92) and got["unknown"] == ("a", 92)
    assert got["lane"] == ("b", 92)  # both end with it, but the file says whose it is
    assert got["mountainash"] == ("c", 92) and got["ash"] == ("c", 100)
    assert "nowhere" not in got and "nothing" not in got and "no" not in got
