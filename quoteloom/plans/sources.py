"""Queries on the sources: JSON documents made of the part table, flattened to raw quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import domain, offers


def _k() -> Column:
    return F.col("p_partkey")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")


def _s(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _map(**items: Column) -> Column:
    return F.map_filter(F.map_from_arrays(F.array(*(F.lit(k.lstrip("_")) for k in items)), F.array(*items.values())), lambda _, v: v.isNotNull())


def _es(parts: DataFrame, player_league: str, game_league: str) -> DataFrame:
    """Documents of three parts each; even parts are players, odd ones games."""
    player = _k() % 2 == 0
    line = (_k() % 30 + 0.5).cast("string")
    params = F.when(player, _map(ouPlPoints=line, ouPlRebounds=F.when(_k() % 3 == 0, "x").otherwise("5.5"))).otherwise(_map(overUnder=line, overUnderOvertime=F.lit(""), overUnderOvertime2=line))
    odds = F.when(player, _map(_51679=F.lit(1.8), _51681=F.when(_k() % 5 != 0, 1.9), _51685=F.lit(2.0), _54101=F.when(_k() % 4 == 0, 1.2))).otherwise(_map(_227=F.lit(1.7), _228=F.lit(2.1), _50445=F.lit(1.1), _50446=F.when(_k() % 3 != 0, 1.5)))
    m = F.struct(_k().alias("id"), F.when(player, _s("Igrač ", _k())).otherwise(F.col("p_brand")).alias("home"), F.when(player, _s("Tim ", _k() % 7)).otherwise(F.col("p_type")).alias("away"), (_k() * 1000).alias("kickOffTime"), F.when(player, player_league).otherwise(game_league).alias("leagueName"), params.alias("params"), odds.alias("odds"))
    return parts.groupBy(F.floor(_k() / 3)).agg(F.collect_list(m).alias("esMatches")).select(F.to_json(F.struct("esMatches")).alias("payload"))


def source_flatten_maxbet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.maxbet(_es(_parts(spark, sf_dir), "Poeni igrača ~ NBA", "Košarka ~ Portoriko 1"))


def source_flatten_merkurxtip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.merkurxtip(_es(_parts(spark, sf_dir), "Igrači - NBA", "Evroliga"))


def source_flatten_oktagonbet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.oktagon_list(_es(_parts(spark, sf_dir), "Igrači ~ USA NBA", "Argentina Liga A"))


def source_flatten_oktagon_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tip = lambda code, value: F.struct(F.lit(code).alias("tipTypeId"), value.cast("double").alias("value"))
    group = lambda line, *tips: F.struct(line.cast("string").alias("handicapParamValue"), F.array(*tips).alias("tipTypes"))
    groups = F.array(group(_k() % 30 + 0.5, tip(51679, F.lit(0.0)), tip(51679, F.lit(1.8)), tip(51681, 1.5 + _k() % 5)), group(F.lit(None), tip(54101, F.lit(1.3)), tip(99, F.lit(2.0))))
    m = F.struct(_k().alias("id"), _s("Igrač ", _k()).alias("home"), _s("Tim ", _k() % 7).alias("away"), (_k() * 1000).alias("kickOffTime"), F.lit("Igrači ~ Euroleague").alias("leagueName"), groups.alias("odBetPickGroups"))
    docs = _parts(spark, sf_dir).groupBy(F.floor(_k() / 50)).agg(F.to_json(F.collect_list(m)).alias("payload"))
    return offers.oktagon_bulk(docs)


def source_flatten_mozzart(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = lambda game, side, line, value, status="ACTIVE": F.struct(line.cast("string").alias("specialOddValue"), F.struct(F.lit(side).alias("name")).alias("subgame"), F.struct(game.alias("name")).alias("game"), value.cast("double").alias("value"), F.lit(status).alias("oddStatus"))
    group = lambda name, *odds: F.struct(F.lit(name).alias("groupName"), F.lit("80.5").alias("specialOddValue"), F.array(*odds).alias("odds"))
    game, line = _s("Broj poena P.", _k()), _k() % 20 + 0.5
    props = group("Broj poena igrača", odd(game, "više", line, F.lit(1.8)), odd(game, "manje", line, F.lit(1.9)), odd(game, "više", line, F.lit(2.0)), odd(game, "manje", line, F.lit(9.0), "CLOSED"), odd(F.lit("Broj šuteva X"), "više", line, F.lit(1.0)))
    total = group("Ukupno poena na meču", odd(F.lit("x"), "vise", F.lit(None).cast("string"), F.lit(1.7)), odd(F.lit("x"), "manje", F.lit(None).cast("string"), F.lit(2.2)))
    item = F.struct(F.struct(F.col("p_brand").alias("name")).alias("home"), F.struct(F.col("p_type").alias("name")).alias("visitor"), F.struct(F.lit("USA NBA").alias("name")).alias("competition"), (_k() * 1000).alias("startTime"), F.array(props, total).alias("oddsGroup"))
    docs = _parts(spark, sf_dir).groupBy(F.floor(_k() / 50)).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload"))
    return offers.mozzart(docs)


#: The moment at which the meridian events are read; a fifth of the smallest table starts before it.
NOW_MS = 400_000


def _header(active: Column) -> Column:
    return F.struct(_k().alias("eventId"), F.when(active, "ACTIVE").otherwise("OVER").alias("state"), (_k() * 1000).alias("startTime"), F.array("p_brand", "p_type").alias("rivals"), F.struct(F.lit(7).alias("leagueId"), F.lit("euroleague").alias("slug")).alias("league"))


def _sel(name: str, price: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), price.cast("double").alias("price"))


def source_flatten_meridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.struct(F.lit("Ukupno (uklj. OT) ").alias("name"), (_k() % 100 + 100.5).alias("overUnder"), F.array(_sel("Više", F.lit(1.8)), _sel("Manje", 1.5 + _k() % 3)).alias("selections"))
    event = F.struct(_header(_k() % 10 != 0).alias("header"), F.array(F.struct(F.array(group).alias("groups"))).alias("positions"))
    docs = _parts(spark, sf_dir).groupBy(F.floor(_k() / 50)).agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(event).alias("events"))).alias("payload"))).alias("payload"))
    return offers.meridian_totals(docs, NOW_MS)


def source_flatten_meridian_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = lambda name, state, *s: F.struct(name.alias("name"), F.lit(state).alias("state"), (_k() % 20 + 0.5).alias("overUnder"), F.array(*s).alias("selections"))
    markets = F.array(market(_s("Prezime", _k(), ", Ime"), "ACTIVE", _sel("više", F.lit(1.8)), _sel("manje", F.lit(2.0))), market(F.lit("Ukupno"), "ACTIVE", _sel("više", F.lit(1.0))), market(F.lit("A, B"), "OVER", _sel("više", F.lit(1.0))))
    doc = F.struct(_header(_k() % 10 != 0).alias("header"), F.lit("player_points").alias("market_type"), F.array(F.struct(markets.alias("markets"))).alias("payload"))
    return offers.meridian_props(_parts(spark, sf_dir).select(F.to_json(doc).alias("payload")), NOW_MS)


def _outcome(name: str, odd: Column, playable: bool = True) -> Column:
    return F.struct(F.lit(name).alias("name"), odd.cast("double").alias("odd"), F.lit(playable).alias("isPlayable"))


def _bet(kind: int, name: str, line: Column, playable: bool, *outcomes: Column) -> Column:
    return F.struct(F.lit(kind).alias("betTypeId"), F.lit(name).alias("betTypeName"), line.cast("string").alias("sBV"), F.lit(playable).alias("isPlayable"), F.array(*outcomes).alias("betOutcomes"))


def source_flatten_pinnbet(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    event = F.struct(_k().cast("string").alias("id"), _s("Igrač ", _k(), " - Tim ", _k() % 7).alias("name"), F.when(_k() % 3 == 0, _s("Tim ", _k() % 7, "-Ri-val")).alias("shortName"), F.lit("Euroleague").alias("competitionName"), F.when(_k() % 2 == 0, 5).otherwise(1).alias("mappingTypeId"), F.lit("2026-04-11T16:00:00").alias("dateTime"))
    bets = F.array(_bet(1200, "", _k() % 30 + 0.5, True, _outcome("Više", F.lit(1.8)), _outcome("manje", F.lit(1.9), False)), _bet(7, "Ukupno  poena + asistencija", F.lit("bad"), True, _outcome("više", F.lit(2.0))), _bet(8, "Ukupno poena + skokova", _k() % 9 + 0.5, True, _outcome("manje", F.lit(2.0))))
    events = p.groupBy(F.floor(_k() / 50)).agg(F.to_json(F.collect_list(event)).alias("payload"))
    details = p.select(F.to_json(F.struct(_k().cast("string").alias("id"), bets.alias("bets"))).alias("payload"))
    return offers.pinnbet_props(events, details)


def source_flatten_pinnbet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = F.array(_bet(167, "x", _k() % 100 + 99.5, True, _outcome("više", F.lit(1.8)), _outcome("manje", F.lit(1.9))), _bet(9, "Ukupno poena (+OT)", F.lit(1.5), True, _outcome("više", F.lit(1.1))), _bet(167, "x", F.lit(2.5), False, _outcome("više", F.lit(1.1))))
    event = F.struct(_s(F.col("p_brand"), " - ", F.col("p_type")).alias("name"), F.lit("2026-04-11T16:00:00").alias("dateTime"), bets.alias("bets"))
    return offers.pinnbet_totals(_parts(spark, sf_dir).groupBy(F.floor(_k() / 50)).agg(F.to_json(F.collect_list(event)).alias("payload")))


def source_flatten_admiralbet(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = F.array(
        _bet(1598, "Ukupno poena", _k() % 30 + 0.5, True, _outcome("vise", F.lit(1.8)), _outcome("manje", F.lit(1.9))), _bet(1683, "Postiže poena", F.lit(None), True, _outcome("10+", F.lit(1.2)), _outcome("11+", F.lit(1.3))),
        _bet(213, "Ukupno (+OT)", _k() % 100 + 99.5, True, _outcome("vise", F.lit(1.7))), _bet(213, "Ukupno", F.lit(1.5), True, _outcome("vise", F.lit(1.7))),
    )
    event = F.struct(_s("Igrač ", _k(), " - Tim ", _k() % 7).alias("name"), F.when(_k() % 2 == 0, "USA NBA").otherwise("Liga X").alias("competitionName"), F.when(_k() % 5 != 0, "2026-04-15T15:30:00").otherwise("soon").alias("dateTime"), bets.alias("bets"))
    return offers.admiralbet(_parts(spark, sf_dir).groupBy(F.floor(_k() / 50)).agg(F.to_json(F.collect_list(event)).alias("payload")))


def source_flatten_balkanbet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short keys with an object of markets, long keys with a list."""
    short = F.struct(_s("P.", _k(), " (Tim ", _k() % 7, ")").alias("j"), F.lit("2026-04-11T16:00:00.000Z").alias("n"), F.lit(252).alias("f"), F.create_map(F.lit("1"), F.struct(F.lit(2402).alias("b"), F.array(_k() % 30 + 0.5).alias("g"), F.array(F.struct(F.lit("Više od").alias("e"), F.lit(1.8).alias("g")), F.struct(F.lit("Manje od").alias("e"), F.lit(1.9).alias("g"))).alias("h"))).alias("o"))
    long = F.struct(_s(F.col("p_brand"), " - ", F.col("p_type")).alias("name"), F.lit("2026-04-11T16:00:00Z").alias("startsAt"), F.lit("77").alias("categoryId"), F.array(F.struct(F.lit(530).alias("marketId"), F.array((_k() % 100 + 99.5).cast("string")).alias("specialValues"), F.array(F.struct(F.lit("manje").alias("name"), F.lit(2.1).alias("odd"))).alias("outcomes")), F.struct(F.lit(1).alias("marketId"), F.array(F.lit("1.5")).alias("specialValues"), F.array(F.struct(F.lit("manje").alias("name"), F.lit(2.1).alias("odd"))).alias("outcomes"))).alias("markets"))
    doc = lambda e: F.concat(F.lit('{"data":{"events":['), F.to_json(e), F.lit("]}}"))
    p = _parts(spark, sf_dir)
    docs = p.where(_k() % 2 == 0).select(doc(short).alias("payload")).unionByName(p.where(_k() % 2 == 1).select(doc(long).alias("payload")))
    return offers.balkanbet(docs)


def source_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.mock(spark)


def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    es = _es(_parts(spark, sf_dir), "Poeni igrača ~ NBA", "Košarka ~ NBA")
    rows = offers.default_registry().read_all({"maxbet": es, "merkurxtip": es, "oktagonbet": es})
    return rows.groupBy("bookmaker_id", "market_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    source_flatten_maxbet, source_flatten_merkurxtip, source_flatten_oktagonbet, source_flatten_oktagon_bulk, source_flatten_mozzart, source_flatten_meridian, source_flatten_meridian_props,
    source_flatten_pinnbet, source_flatten_pinnbet_totals, source_flatten_admiralbet, source_flatten_balkanbet, source_mock, source_registry,
)}

_COLUMNS = ", ".join(offers.RAW_COLUMNS)
_START = "case when k <> 0 then strftime(make_timestamp(k * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' end"


def _sql(bookmaker: str, *branches: tuple[str, str, str, str, str, str, str, str, str, str]) -> str:
    """Branches: league, home, away, market, player, line, over, under, start, condition."""
    one = "select '{b}' as bookmaker_id, {0} as league_id, 'basketball' as sport, {1} as home_team, {2} as away_team, '{3}' as market_type, {4} as player_name, ({5})::double as threshold, ({6})::double as over_odds, ({7})::double as under_odds, {8} as start_time from p where {9}"
    return "with p as (select p_partkey as k, p_brand, p_type from part) " + " union all ".join(one.format(*x, b=bookmaker) for x in branches)


_P, _T = "'Igrač ' || k", "'Tim ' || (k % 7)"


def _es_sql(bookmaker: str, league: str, games: str, totals: bool) -> str:
    out = [
        (f"'{league}'", _T, _P, "player_points", _P, "k % 30 + 0.5", "1.8", "case when k % 5 <> 0 then 1.9 end", _START, "k % 2 = 0"),
        (f"'{league}'", _T, _P, "player_rebounds", _P, "5.5", "2.0", "null", _START, "k % 2 = 0 and k % 3 <> 0"),
        (f"'{league}'", _T, _P, "player_points_milestones", _P, "9.5", "1.2", "null", _START, "k % 4 = 0"),
        (f"'{games}'", "p_brand", "p_type", "game_total_ot", "null", "k % 30 + 0.5", "null", "1.5", _START, "k % 2 = 1 and k % 3 <> 0"),
    ]
    if totals:
        out.append((f"'{games}'", "p_brand", "p_type", "game_total", "null", "k % 30 + 0.5", "1.7", "2.1", _START, "k % 2 = 1"))
    return _sql(bookmaker, *out)


_DAY = "'2026-04-11T16:00:00+00:00'"
ORACLES = {
    "source_flatten_maxbet": _es_sql("maxbet", "nba", "portoriko_1", True),
    "source_flatten_oktagonbet": _es_sql("oktagonbet", "nba", "argentina_1", False),
    "source_flatten_oktagon_bulk": _sql(
        "oktagonbet", ("'euroleague'", _T, _P, "player_points", _P, "k % 30 + 0.5", "1.8", "1.5 + k % 5", _START, "true"), ("'euroleague'", _T, _P, "player_points_milestones", _P, "9.5", "1.3", "null", _START, "true")
    ),
    "source_flatten_mozzart": _sql(
        "mozzart", ("'nba'", "p_brand", "p_type", "player_points", "'P.' || k", "k % 20 + 0.5", "2.0", "1.9", _START, "true"), ("'nba'", "p_brand", "p_type", "game_total", "null", "80.5", "1.7", "2.2", _START, "true")
    ),
    "source_flatten_meridian_props": _sql("meridian", ("'euroleague'", "p_brand", "p_type", "player_points", "'Ime Prezime' || k", "k % 20 + 0.5", "1.8", "2.0", _START, f"k % 10 <> 0 and (k = 0 or k * 1000 >= {NOW_MS})")),
    "source_flatten_pinnbet_totals": _sql(
        "pinnbet", ("'basketball'", "p_brand", "p_type", "game_total_ot", "null", "k % 100 + 99.5", "1.8", "1.9", _DAY, "true"), ("'basketball'", "p_brand", "p_type", "game_total_ot", "null", "1.5", "1.1", "null", _DAY, "true")
    ),
    "source_flatten_pinnbet": _sql(
        "pinnbet",
        ("'euroleague'", _T, "case when k % 3 = 0 then 'Ri-val' else 'Igrač ' || k end", "player_points", _P, "k % 30 + 0.5", "1.8", "null", _DAY, "k % 2 = 0"),
        ("'euroleague'", _T, "case when k % 3 = 0 then 'Ri-val' else 'Igrač ' || k end", "player_points_rebounds", _P, "k % 9 + 0.5", "null", "2.0", _DAY, "k % 2 = 0"),
    ),
    "source_flatten_admiralbet": _sql(
        "admiralbet",
        *((("case when k % 2 = 0 then 'nba' else 'liga x' end", *x, "case when k % 5 <> 0 then '2026-04-15T15:30:00+00:00' end", "true")) for x in (
            (_T, _P, "player_points", _P, "k % 30 + 0.5", "1.8", "1.9"), (_T, _P, "player_points_milestones", _P, "9.5", "1.2", "null"), (_P, _T, "game_total_ot", "null", "k % 100 + 99.5", "1.7", "null"),
        )),
    ),
    "source_flatten_balkanbet": _sql(
        "balkanbet", ("'euroleague'", _T, "'P.' || k", "player_points", "'P.' || k", "k % 30 + 0.5", "1.8", "1.9", _DAY, "k % 2 = 0"),
        ("'balkanbet_category_77'", "p_brand", "p_type", "game_total_ot", "null", "k % 100 + 99.5", "null", "2.1", _DAY, "k % 2 = 1"),
    ),
}
