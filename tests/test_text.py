"""Normal forms, fuzzy ratios and player names against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quoteloom.functions import fuzzy, text
from quoteloom.operators import players


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [(None, ""), ("", ""), ("  Crvena  ZVEZDA ", "crvena zvezda"), ("Đoković_Čačak-1", "okovic cacak 1"), ("İzmir", "izmir"), ("FC 'Bayern'", "fc bayern")])
def test_identity(spark, raw, want):
    assert one(spark, raw, text.identity_text) == want


def test_tokens_and_compact(spark):
    assert one(spark, "-Hayes-Davis- N.", lambda x: text.identity_tokens(x, True)) == ["hayes-davis", "n"]
    assert one(spark, "Hayes-Davis N.", text.compact_text) == "hayesdavisn"
    assert one(spark, "aba_liga-extra", text.humanize_league) == "ABA LIGA Extra"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial(a, b):
    a, b = sorted((a, b), key=len) if len(a) > len(b) else (a, b)
    if not a:
        return 100.0 if not b else 0.0
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def test_ratios_match_plain_python(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 7))) for _ in range(14)]
    pairs = list(itertools.product(words, words))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.ratio(F.col("a"), F.col("b")).alias("r"), fuzzy.partial_ratio(F.col("a"), F.col("b")).alias("p"), fuzzy.token_sort_ratio(F.col("a"), F.col("b")).alias("s"))
    for row in df.collect():
        assert row.r == pytest.approx(ratio(row.a, row.b))
        assert row.p == pytest.approx(partial(row.a, row.b))
        assert row.s == pytest.approx(ratio(" ".join(sorted(row.a.split())), " ".join(sorted(row.b.split()))))


def test_token_set(spark):
    df = spark.sql("select 'fenerbahce beko' a, 'fenerbahce' b").select(fuzzy.token_set_ratio(F.col("a"), F.col("b")).alias("t"))
    assert df.first().t == 100.0


def test_players(spark):
    groups = [
        ({"Luka Dončić": 3, "L. Dončić": 2, "Luka Doncic": 1}, {"Luka Doncic": "Luka Dončić", "L. Dončić": "Luka Dončić"}),
        ({"N. Jović": 1, "Nikola Jović": 2, "Nemanja Jović": 2}, {}),  # two given names fit
        ({"A. J. Smith": 1, "Aaron Smith": 4}, {}),  # double initials don't resolve
        ({"A. Smith": 2, "A. J. Smith": 3}, {}),  # nor does one initial to two
        ({"James L.": 1, "LeBron James": 2}, {"James L.": "LeBron James"}),
        ({"James Le": 1, "LeBron James": 2}, {}),  # not an abbreviation
        ({"Ann Lee": 1, "Ann Lee Jr.": 5}, {"Ann Lee": "Ann Lee Jr."}),
        ({"J. Doe": 1, "Jon Doe": 2, "Jonathan Doe": 5}, {"J. Doe": "Jonathan Doe", "Jon Doe": "Jonathan Doe"}),
        ({"Aleksandar Ivić": 4, "Aleksandr Ivić": 1, "A. Ivić": 1}, {"Aleksandr Ivić": "Aleksandar Ivić"}),  # the initial fits two given names
        ({"Marko Babić": 2, "Mario Babić": 2}, {}),
        ({"Jean-Marc Roux": 1, "Jean Marc Roux": 1, "jean marc roux": 1}, {"Jean Marc Roux": "Jean-Marc Roux", "jean marc roux": "Jean-Marc Roux"}),
        ({"Tim": 3, "Tim Tim": 1}, {}),
        ({"???": 2, "!!!": 1}, {}),
    ]
    rows = [(f"m{i}", name, k) for i, (counts, _) in enumerate(groups) for name, n in counts.items() for k in range(n)]
    found = {}
    for r in players.player_replacements(spark.createDataFrame(rows, "match_id string, player_name string, seq int")).collect():
        found.setdefault(r.match_id, {})[r.name] = r.replacement
    for i, (counts, want) in enumerate(groups):
        assert found.get(f"m{i}", {}) == want, counts


def test_resolve_players_in_spark(spark):
    df = spark.createDataFrame([("m", "L. Dončić", 1), ("m", "Luka Dončić", 2), ("m", None, 3), ("n", "L. Dončić", 4)], "match_id string, player_name string, seq int")
    assert [r.player_name for r in players.resolve_players(df).orderBy("seq").collect()] == ["Luka Dončić", "Luka Dončić", None, "L. Dončić"]
