"""Sources of quotes: eight recorded JSON shapes, flattened to one raw model.

Every reader takes a DataFrame with one JSON document per row in ``payload``
and gives ``RAW_COLUMNS``.  The common steps are: parse with a fixed schema,
explode, look prices up or pivot over and under into one row, cast safely.
What differs between the sources (codes, side labels, first or last wins,
league spellings) is data or a few lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_COLUMNS = ("bookmaker_id", "league_id", "sport", "home_team", "away_team", "market_type", "player_name", "threshold", "over_odds", "under_odds", "start_time")

# Over code, under code, parameter and market of the player lines that three sources share.
PLAYER_LINES = (
    ("51679", "51681", "ouPlPoints", "player_points"),
    ("55253", "55255", "ouPlP2", "player_points"),
    ("55256", "55258", "ouPlP3", "player_points"),
    ("51685", "51687", "ouPlRebounds", "player_rebounds"),
    ("51682", "51684", "ouPlAssists", "player_assists"),
    ("51688", "51690", "ouPl3Points", "player_3points"),
    ("55672", "55674", "ouPlSt", "player_steals"),
    ("55681", "55683", "ouPlB", "player_blocks"),
    ("55244", "55246", "ouPlTPR", "player_points_rebounds"),
    ("55247", "55249", "ouPlTPA", "player_points_assists"),
    ("55250", "55252", "ouPlTRA", "player_rebounds_assists"),
    ("55215", "55217", "ouPlTPRA", "player_points_rebounds_assists"),
)
# Over codes of the points milestones and their lines.
MILESTONES = (("54096", 4.5), ("54101", 9.5), ("54106", 14.5), ("54111", 19.5), ("54116", 24.5), ("54121", 29.5), ("54126", 34.5), ("54131", 39.5), ("54136", 44.5), ("54141", 49.5), ("57454", 59.5))
# Over code, under code and parameter of game totals, without and with overtime.
TOTALS = (("227", "228", "overUnder"), ("429", "427", "overUnder2"))
TOTALS_OT = (
    ("50445", "50444", "overUnderOvertime"), ("50447", "50446", "overUnderOvertime2"), ("50449", "50448", "overUnderOvertime3"), ("50451", "50450", "overUnderOvertime4"), ("50453", "50452", "overUnderOvertime5"),
    ("50455", "50454", "overUnderOvertime6"), ("50457", "50456", "overUnderOvertime7"), ("51637", "51636", "overUnderOvertime8"), ("51639", "51638", "overUnderOvertime9"), ("51641", "51640", "overUnderOvertime10"),
    ("51643", "51642", "overUnderOvertime11"), ("51645", "51644", "overUnderOvertime12"), ("51647", "51646", "overUnderOvertime13"),
)
# League spellings, by source.
LEAGUES_A = {"nba": "nba", "usa nba": "nba", "euroleague": "euroleague", "aba liga": "aba_liga", "aba league": "aba_liga", "admiralbet aba liga": "aba_liga", "admiralbet aba liga plej of": "aba_liga"}
LEAGUES_MAXBET = {"nba": "nba", "portoriko 1": "portoriko_1"}
LEAGUES_OKTAGON = {
    "usa nba": "nba", "euroleague": "euroleague", "aba liga": "aba_liga", "aba league": "aba_liga", "aba liga winners stage": "aba_liga", "aba liga losers stage": "aba_liga", "aba liga plej of": "aba_liga",
    "admiralbet aba liga": "aba_liga", "admiralbet aba liga plej of": "aba_liga", "argentina liga a": "argentina_1", "new zealand nbl": "new_zealand", "puerto rico bsn": "portoriko_1",
    "south korea kbl": "south_korea_play_offs", "uruguay liga uruguaya": "uruguay_winners_stage",
}
# Market ids and names of one source.
PINN_MARKETS = {1200: "player_points", 1201: "player_assists", 1202: "player_rebounds", 1203: "player_points_assists", 1204: "player_points_rebounds", 1205: "player_rebounds_assists", 1206: "player_points_rebounds_assists", 1191: "player_steals", 1194: "player_blocks", 1195: "player_3points"}
PINN_NAMES = {
    "ukupno poena": "player_points", "ukupno asistencija": "player_assists", "ukupno skokova": "player_rebounds", "ukupno poena+asistencija": "player_points_assists", "ukupno poena+skokova": "player_points_rebounds",
    "ukupno asistencija+skokova": "player_rebounds_assists", "ukupno poena+asistencija+skokova": "player_points_rebounds_assists", "ukupno ukradenih lopti": "player_steals", "ukupno blokada": "player_blocks", "ukupno postignutih trojki": "player_3points",
}
BALKAN_TOURNAMENTS = {252: "euroleague", 29368: "aba_liga", 30757: "turkey", 31317: "italy", 31353: "germany"}
ADMIRAL_MILESTONES = {"5+": 4.5, "10+": 9.5, "15+": 14.5, "20+": 19.5, "25+": 24.5, "30+": 29.5, "35+": 34.5, "40+": 39.5, "45+": 44.5, "50+": 49.5}

ES = "struct<id:bigint,home:string,away:string,kickOffTime:bigint,leagueName:string,leagueCategory:string,sport:string,params:map<string,string>,odds:map<string,double>>"


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def league_key(raw: Column) -> Column:
    """Lower case, '_' and '-' as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "[_-]", " "), r"\s+", " "))


def epoch_start(ms: Column) -> Column:
    """B-33: epoch milliseconds as ISO text in UTC; 0 and null give null."""
    t = F.timestamp_millis(ms)
    return F.when(F.coalesce(ms, F.lit(0)) != 0, F.when(ms % 1000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")))


def iso_start(raw: Column, keep_invalid: bool = True) -> Column:
    """B-34: ISO text with an offset, naive values as UTC; what isn't a time passes through or gives null."""
    valid = raw.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d(:\d\d(:\d\d(\.\d+)?)?)?(Z|[+-]\d\d:?\d\d)?)?$")
    t = F.try_to_timestamp(F.when(valid, raw))
    text = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(raw == "", F.lit(None)).otherwise(F.coalesce(text, raw) if keep_invalid else text)


def number(raw: Column) -> Column:
    """B-35."""
    return raw.try_cast("double")


def sided(outcomes: Column, over: Callable[[Column], Column], under: Callable[[Column], Column], price: Callable[[Column], Column], usable: Callable[[Column], Column] | None = None) -> Column:
    """Over and under price of a list of outcomes; the last fitting one wins, with its price even if null."""
    live = F.filter(outcomes, usable) if usable else outcomes
    pick = lambda test: F.try_element_at(F.filter(live, test), F.lit(-1))
    return F.struct(price(pick(over)).alias("over"), price(pick(under)).alias("under"))


def _raw(df: DataFrame, bookmaker: str, **columns: Column | str) -> DataFrame:
    values = {"bookmaker_id": F.lit(bookmaker), "sport": F.lit("basketball"), "player_name": F.lit(None).cast("string")} | {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    return df.select(*(values[c].cast("double").alias(c) if c in ("threshold", "over_odds", "under_odds") else values[c].alias(c) for c in RAW_COLUMNS))


def _es_lines(matches: DataFrame, lines: tuple, market: str | None = None) -> DataFrame:
    """One row per line a match offers: the line's parameter is its threshold, its codes give the prices."""
    offers = F.array(*(F.struct(F.lit(x[3] if len(x) > 3 else market).alias("market_type"), number(F.try_element_at("m.params", F.lit(x[2]))).alias("threshold"), F.try_element_at("m.odds", F.lit(x[0])).alias("over"), F.try_element_at("m.odds", F.lit(x[1])).alias("under")) for x in lines))
    return matches.select("m", F.explode(offers).alias("o")).where("o.threshold is not null and (o.over is not null or o.under is not null)")


def _es_milestones(matches: DataFrame) -> DataFrame:
    offers = F.array(*(F.struct(F.lit("player_points_milestones").alias("market_type"), F.lit(line).alias("threshold"), F.try_element_at("m.odds", F.lit(code)).alias("over"), F.lit(None).cast("double").alias("under")) for code, line in MILESTONES))
    return matches.select("m", F.explode(offers).alias("o")).where("o.over is not null")


def _es_rows(bookmaker: str, league: Column, player: Column, props: DataFrame, totals: DataFrame) -> DataFrame:
    prop = _raw(props, bookmaker, league_id=league, home_team=F.coalesce("m.away", F.lit("")), away_team=player, player_name=player, market_type="o.market_type", threshold="o.threshold", over_odds="o.over", under_odds="o.under", start_time=epoch_start(F.col("m.kickOffTime")))
    total = _raw(totals, bookmaker, league_id=league, home_team=F.trim("m.home"), away_team=F.trim("m.away"), market_type="o.market_type", threshold="o.threshold", over_odds="o.over", under_odds="o.under", start_time=epoch_start(F.col("m.kickOffTime")))
    return prop.unionByName(total)


def _named() -> Column:
    return (F.trim("m.home") != "") & (F.trim("m.away") != "")


def es_matches(docs: DataFrame) -> DataFrame:
    """``m`` of documents that are a match, a list of matches, ``{esMatches: [...]}`` or ``{id: match}`` (A-08)."""
    v = docs.select(F.parse_json("payload").alias("v"))
    listed = F.try_variant_get("v", "$.esMatches", f"array<{ES}>")
    plain = F.try_variant_get("v", "$", f"array<{ES}>")
    by_id = F.map_values(F.try_variant_get("v", "$", f"map<string,{ES}>"))
    single = F.when(F.try_variant_get("v", "$.odds", "map<string,double>").isNotNull(), F.array(F.try_variant_get("v", "$", ES)))
    return v.select(F.explode(F.coalesce(listed, plain, single, by_id)).alias("m")).where("m is not null")


def maxbet(docs: DataFrame) -> DataFrame:
    """B-13 to B-15."""
    m = es_matches(docs)
    low = F.lower(F.coalesce("m.leagueName", F.lit("")))
    is_player = F.contains(low, F.lit("poeni igrača"))
    bare = F.regexp_replace(F.trim(low), "^(poeni igrača|košarka)", "")
    key = league_key(F.regexp_replace(bare, r"^[ ~-]+|[ ~-]+$", ""))
    league = F.when(key == "", "basketball").otherwise(F.coalesce(lookup(LEAGUES_MAXBET, key), F.replace(key, F.lit(" "), F.lit("_"))))
    players, games = m.where(is_player), m.where(~is_player & (low != "") & _named())
    props = _es_lines(players, PLAYER_LINES).unionByName(_es_milestones(players))
    totals = _es_lines(games, TOTALS, "game_total").unionByName(_es_lines(games, TOTALS_OT[:7], "game_total_ot"))
    return _es_rows("maxbet", league, F.coalesce("m.home", F.lit("")), props, totals)


def merkurxtip(docs: DataFrame) -> DataFrame:
    """B-16, B-17, B-19: a repeated key's last row wins."""
    m = es_matches(docs)
    low = F.lower(F.coalesce("m.leagueName", F.lit("")))
    is_player = F.contains(low, F.lit("igrači"))
    key = league_key(F.regexp_replace(F.trim(low), r"^igrači[ ~-]*", ""))
    league = F.when(key == "", "basketball").otherwise(F.replace(key, F.lit(" "), F.lit("_")))
    turned = F.regexp_replace(F.trim("m.home"), r"^([A-Za-zÀ-ž'-]+(?:\s+[A-Za-zÀ-ž'-]+)*)\s+([A-Za-zÀ-ž]{1,4})\.$", "$2.$1")
    players, games = m.where(is_player), m.where(~is_player & _named())
    rows = _es_rows("merkurxtip", league, turned, _es_lines(players, PLAYER_LINES).unionByName(_es_milestones(players)), _es_lines(games, TOTALS_OT, "game_total_ot"))
    return dedupe_last(rows.withColumn("seq", F.monotonically_increasing_id()))


def dedupe_last(rows: DataFrame, order: str = "seq") -> DataFrame:
    """B-12, B-19: of rows with the same key the last one."""
    key = ["bookmaker_id", "league_id", "sport", "home_team", "away_team", "market_type", "player_name", "threshold"]
    return rows.groupBy(*key).agg(F.max_by(F.struct("over_odds", "under_odds", "start_time"), order).alias("r")).select(*key, "r.*").select(*RAW_COLUMNS)


def dedupe_merge(rows: DataFrame, order: str = "seq") -> DataFrame:
    """B-08: of rows with the same key the first price of each side and the latest start."""
    key = ["bookmaker_id", "league_id", "sport", "home_team", "away_team", "market_type", "player_name", "threshold"]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    last = F.max_by("start_time", F.when(F.coalesce("start_time", F.lit("")) != "", F.col(order))).alias("start_time")
    return rows.groupBy(*key).agg(first("over_odds"), first("under_odds"), last).select(*RAW_COLUMNS)


def _oktagon_league() -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce("m.leagueName", F.lit(""))), r"^igrači\s*~?", "")
    key = F.trim(F.regexp_replace(F.regexp_replace(bare, "[_~-]", " "), r"\s+", " "))
    return F.when(key == "", "basketball").otherwise(F.coalesce(lookup(LEAGUES_OKTAGON, key), F.replace(key, F.lit(" "), F.lit("_"))))


def _oktagon_player() -> Column:
    low, category = F.lower(F.coalesce("m.leagueName", F.lit(""))), F.lower(F.coalesce("m.leagueCategory", F.lit("")))
    return F.startswith(low, F.lit("igrači ~")) & ~F.contains(low, F.lit("dueli")) & ~F.contains(category, F.lit("dueli"))


def oktagon_list(docs: DataFrame) -> DataFrame:
    """B-03 to B-05, B-07."""
    m = es_matches(docs)
    players, games = m.where(_oktagon_player()), m.where(~_oktagon_player() & _named())
    lines = tuple(x for x in PLAYER_LINES if x[2] not in ("ouPlP2", "ouPlP3"))
    props = _es_lines(players, lines).unionByName(_es_milestones(players).where("o.threshold is not null"))
    return _es_rows("oktagonbet", _oktagon_league(), F.coalesce("m.home", F.lit("")), props, _es_lines(games, TOTALS_OT, "game_total_ot"))


BULK = "struct<id:bigint,home:string,away:string,kickOffTime:bigint,leagueName:string,leagueCategory:string,sport:string,odBetPickGroups:array<struct<handicapParamValue:string,tipTypes:array<struct<tipTypeId:string,value:double>>>>>"


def oktagon_bulk(docs: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """B-06, J-13: pick groups by tip type; the first price above 0 of each side wins.  ``listed`` (``m``) fills and overrides the match's own fields."""
    m = docs.select(F.explode(F.from_json("payload", f"array<{BULK}>")).alias("m"))
    if listed is not None:
        known = listed.select(F.col("m.id").alias("l_id"), *(F.col(f"m.{c}").alias(f"l_{c}") for c in ("home", "away", "kickOffTime", "leagueName")))
        m = m.join(known, F.col("m.id") == F.col("l_id"), "left").withColumn("m", F.col("m").withField("home", F.coalesce("l_home", "m.home")).withField("away", F.coalesce("l_away", "m.away")).withField("kickOffTime", F.coalesce("l_kickOffTime", "m.kickOffTime")).withField("leagueName", F.coalesce("l_leagueName", "m.leagueName"))).select("m")
    sides = {code: (market, side, "player", None) for x in PLAYER_LINES if x[2] not in ("ouPlP2", "ouPlP3") for code, side, market in ((x[0], "over", x[3]), (x[1], "under", x[3]))}
    sides |= {code: ("player_points_milestones", "over", "player", line) for code, line in MILESTONES}
    sides |= {code: ("game_total_ot", side, "game", None) for x in TOTALS_OT for code, side in ((x[0], "over"), (x[1], "under"))}
    table = F.create_map(*(c for code, (market, side, kind, line) in sides.items() for c in (F.lit(code), F.struct(F.lit(market).alias("market"), F.lit(side).alias("side"), F.lit(kind).alias("kind"), F.lit(line).cast("double").alias("line")))))
    picks = m.select("m", F.posexplode("m.odBetPickGroups").alias("g_no", "g")).select("m", "g_no", "g.handicapParamValue", F.posexplode("g.tipTypes").alias("t_no", "t"))
    picks = picks.withColumn("tip", F.try_element_at(table, F.col("t.tipTypeId"))).withColumn("threshold", F.coalesce("tip.line", number(F.col("handicapParamValue")))).where("tip is not null and threshold is not null and t.value > 0")
    order = F.struct("g_no", "t_no")
    side = lambda s: F.min_by(F.when(F.col("tip.side") == s, F.col("t.value")), F.when(F.col("tip.side") == s, order)).alias(s)
    rows = picks.groupBy(F.col("m").dropFields("odBetPickGroups").alias("m"), F.col("tip.market").alias("market"), "threshold", F.col("tip.kind").alias("kind")).agg(side("over"), side("under"))
    is_player = F.col("kind") == "player"
    ready = rows.where(is_player | _named())
    return _raw(ready, "oktagonbet", league_id=_oktagon_league(), home_team=F.when(is_player, F.coalesce("m.away", F.lit(""))).otherwise(F.trim("m.home")), away_team=F.when(is_player, F.coalesce("m.home", F.lit(""))).otherwise(F.trim("m.away")), player_name=F.when(is_player, F.coalesce("m.home", F.lit(""))), market_type="market", threshold="threshold", over_odds="over", under_odds="under", start_time=epoch_start(F.col("m.kickOffTime")))


def _once(matches: DataFrame) -> DataFrame:
    """One match an id; which, if lists repeat one, is that with the least text of its fields."""
    return matches.where("m.id is not null").groupBy(F.col("m.id").alias("id")).agg(F.min_by("m", F.to_json("m")).alias("m")).select("m")


def oktagon(docs: DataFrame) -> DataFrame:
    """A-06: lists of matches, and bulk answers with pick groups, which take missing fields from the lists (J-13); one row a key (B-08).

    A document is a bulk answer if its matches have ``odBetPickGroups``.
    """
    bulk = F.get_json_object("payload", "$[0].odBetPickGroups").isNotNull()
    lists = docs.where(~bulk)
    rows = oktagon_list(lists).unionByName(oktagon_bulk(docs.where(bulk), _once(es_matches(lists))))
    return dedupe_merge(rows.withColumn("seq", F.monotonically_increasing_id()))


def match_ids(matches: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """B-15, B-18: ``id, place``: matches with a non-empty parameter among ``codes``, once each, in the order they are first seen in."""
    told = F.exists(F.array(*map(F.lit, codes)), lambda c: F.coalesce(F.try_element_at("m.params", c), F.lit("")) != "")
    seen = matches.withColumn("place", F.monotonically_increasing_id()).where(told & F.col("m.id").isNotNull())
    return seen.groupBy(F.col("m.id").alias("id")).agg(F.min("place").alias("place"))


def or_else(rows: DataFrame, others: DataFrame) -> DataFrame:
    """A-09: ``rows``, or ``others`` where there are none."""
    nothing = rows.limit(1).agg((F.count("*") == 0).alias("_none"))  # one row
    return rows.unionByName(others.crossJoin(F.broadcast(nothing)).where("_none").drop("_none").select(*rows.columns))


MOZZART = "items array<struct<home:struct<name:string>,visitor:struct<name:string>,competition:struct<name:string>,startTime:bigint,oddsGroup:array<struct<groupName:string,specialOddValue:string,odds:array<struct<specialOddValue:string,subgame:struct<name:string>,game:struct<name:string>,value:double,oddStatus:string>>>>>>"


def mozzart(docs: DataFrame) -> DataFrame:
    """B-01, B-02: player props by keyword and name pattern, totals by group name; per key the last over and the last under win."""
    items = docs.select(F.posexplode(F.from_json("payload", MOZZART)["items"]).alias("no", "i")).withColumn("item", F.monotonically_increasing_id())
    odds = items.select("item", "i", F.posexplode("i.oddsGroup").alias("g_no", "g")).select("item", "i", "g_no", "g.groupName", F.col("g.specialOddValue").alias("group_value"), F.posexplode("g.odds").alias("o_no", "o")).where("o.oddStatus = 'ACTIVE'")
    group = F.lower(F.trim("groupName"))
    prop = group.rlike("(poena|skokova|asistencija) igra")
    total = group.isin("ukupno poena na meču", "ukupno poena na mecu")
    game = F.trim("o.game.name")
    kind = F.when(game.rlike(r"(?iu)^broj poena\s+.+$"), "player_points").when(game.rlike(r"(?iu)^broj skokova\s+.+$"), "player_rebounds").when(game.rlike(r"(?iu)^broj asistencija\s+.+$"), "player_assists")
    player = F.trim(F.regexp_extract(game, r"(?iu)^broj (?:poena|skokova|asistencija)\s+(.+)$", 1))
    own = number(F.col("o.specialOddValue"))
    line = F.when(total, number(F.coalesce(F.nullif("o.specialOddValue", F.lit("")), "group_value"))).otherwise(own)
    name = F.lower(F.coalesce("o.subgame.name", F.lit("")))
    side = F.when(F.contains(name, F.lit("više")) | F.contains(name, F.lit("vise")), "over").when(F.contains(name, F.lit("manje")), "under")
    rows = odds.where(prop | total).withColumns({"market": F.when(prop, kind).otherwise(F.lit("game_total")), "player": F.when(prop, player), "line": line, "side": side}).where("line > 0 and o.value is not null and market is not null")
    order = F.struct("g_no", "o_no")
    last = lambda s: F.max_by(F.when(F.col("side") == s, F.col("o.value")), F.when(F.col("side") == s, order)).alias(s)
    agg = rows.groupBy("item", F.col("i").dropFields("oddsGroup").alias("i"), "market", "player", "line").agg(last("over"), last("under"))
    raw = F.lower(F.trim("i.competition.name"))
    league = F.when(F.coalesce(raw, F.lit("")) == "", "basketball").otherwise(F.coalesce(lookup(LEAGUES_A, league_key(raw)), F.replace(raw, F.lit(" "), F.lit("_"))))
    return _raw(agg, "mozzart", league_id=league, home_team=F.coalesce("i.home.name", F.lit("")), away_team=F.coalesce("i.visitor.name", F.lit("")), player_name="player", market_type="market", threshold="line", over_odds="over", under_odds="under", start_time=epoch_start(F.col("i.startTime")))


_SELECTIONS = "array<struct<name:string,price:double>>"
MERIDIAN_HEADER = "struct<eventId:bigint,state:string,startTime:bigint,rivals:array<string>,league:struct<leagueId:bigint,slug:string>>"
MERIDIAN = f"payload array<struct<events:array<struct<header:{MERIDIAN_HEADER},positions:array<struct<groups:array<struct<name:string,overUnder:double,selections:{_SELECTIONS}>>>>>>>>"


def _meridian_sides(selections: Column) -> Column:
    label = lambda s: F.lower(F.coalesce(s["name"], F.lit("")))
    over = lambda s: F.contains(label(s), F.lit("više")) | F.contains(label(s), F.lit("vise"))
    return sided(selections, over, lambda s: ~over(s) & F.contains(label(s), F.lit("manje")), lambda s: s["price"], lambda s: s["price"].isNotNull())


def meridian_context(header: str, now_ms: int | None) -> Column:
    """B-09: whether an event counts: it has an id, is active, has two rivals, and starts no earlier than ``now_ms`` (by default the current time) or at no stated time."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)
    h = lambda c: F.col(f"{header}.{c}")
    rivals = (F.size(h("rivals")) >= 2) & (F.coalesce(h("rivals")[0], F.lit("")) != "") & (F.coalesce(h("rivals")[1], F.lit("")) != "")
    return F.coalesce((h("eventId") != 0) & (h("state") == "ACTIVE") & rivals & ((F.coalesce(h("startTime"), F.lit(0)) == 0) | (h("startTime") >= now)), F.lit(False))


def meridian_totals(docs: DataFrame, now_ms: int | None = None) -> DataFrame:
    """B-11, B-12."""
    e = docs.select(F.explode(F.from_json("payload", MERIDIAN)["payload"]).alias("l")).select(F.explode("l.events").alias("e")).where(meridian_context("e.header", now_ms))
    g = e.select("e.header", F.explode("e.positions").alias("p")).select("header", F.explode("p.groups").alias("g"))
    ot = F.startswith(F.lower(F.regexp_replace("g.name", r"\s+", "")), F.lit("ukupno(uklj.ot)"))
    rows = g.where(ot & F.col("g.overUnder").isNotNull()).withColumn("s", _meridian_sides(F.col("g.selections"))).where("s.over is not null or s.under is not null")
    out = _raw(rows, "meridian", league_id=F.coalesce("header.league.slug", F.lit("basketball")), home_team=F.col("header.rivals")[0], away_team=F.col("header.rivals")[1], market_type=F.lit("game_total_ot"), threshold="g.overUnder", over_odds="s.over", under_odds="s.under", start_time=epoch_start(F.col("header.startTime")))
    return dedupe_last(out.withColumn("seq", F.monotonically_increasing_id()))


MERIDIAN_MARKETS = f"header {MERIDIAN_HEADER}, market_type string, payload array<struct<markets:array<struct<name:string,state:string,overUnder:double,selections:{_SELECTIONS}>>>>"


def meridian_props(docs: DataFrame, now_ms: int | None = None) -> DataFrame:
    """B-10: player markets of an event; 'Last, First' is turned round."""
    d = docs.select(F.from_json("payload", MERIDIAN_MARKETS).alias("d")).select("d.*").where(meridian_context("header", now_ms))
    m = d.select("header", "market_type", F.explode("payload").alias("g")).select("header", "market_type", F.explode("g.markets").alias("m")).where("m.state = 'ACTIVE' and m.overUnder is not null and m.name like '%,%'")
    rows = m.withColumn("s", _meridian_sides(F.col("m.selections"))).where("s.over is not null or s.under is not null")
    parts = F.split("m.name", ",", 2)
    return _raw(rows, "meridian", league_id=F.coalesce("header.league.slug", F.lit("basketball")), home_team=F.col("header.rivals")[0], away_team=F.col("header.rivals")[1], player_name=F.concat(F.trim(parts[1]), F.lit(" "), F.trim(parts[0])), market_type="market_type", threshold="m.overUnder", over_odds="s.over", under_odds="s.under", start_time=epoch_start(F.col("header.startTime")))


def meridian(docs: DataFrame, now_ms: int | None = None) -> DataFrame:
    """A-07: pages of events (``{payload: [{events}]}``) and player markets (``{header, market_type, payload}``) together.

    Other player markets count only for events that have points.
    """
    markets = docs.where(F.get_json_object("payload", "$.market_type").isNotNull())
    event, kind = F.get_json_object("payload", "$.header.eventId"), F.get_json_object("payload", "$.market_type")
    filled = F.get_json_object("payload", "$.payload[0]").isNotNull()
    with_points = markets.where((kind == "player_points") & filled).select(event.alias("_event")).distinct()
    wanted = markets.withColumn("_id", event).join(with_points, F.col("_id") == F.col("_event"), "left_semi").select("payload")
    pages = docs.where(F.get_json_object("payload", "$.market_type").isNull())
    return meridian_totals(pages, now_ms).unionByName(meridian_props(wanted, now_ms))


_BETS = "array<struct<betTypeId:string,betTypeName:string,sBV:string,isPlayable:boolean,betOutcomes:array<struct<name:string,odd:double,isPlayable:boolean>>>>"
BET_EVENT = f"struct<id:string,name:string,shortName:string,competitionId:bigint,competitionName:string,mappingTypeId:int,dateTime:string,bets:{_BETS}>"


def _named_sides(outcomes: Column, over: str) -> Column:
    return sided(outcomes, lambda o: F.lower(o["name"]) == over, lambda o: F.lower(o["name"]) == "manje", lambda o: o["odd"], lambda o: F.coalesce(o["isPlayable"], F.lit(False)))


def _split_name(name: Column, missing: Column) -> tuple[Column, Column]:
    """B-30: 'left - right' at the first separator."""
    parts = F.split(name, " - ", 2)
    return F.trim(parts[0]), F.when(F.size(parts) > 1, F.trim(F.try_element_at(parts, F.lit(2)))).otherwise(missing)


def _bet_key(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " ")), r" ?\+ ?", "+")


def matchup_of_short_name(short: Column, team: Column) -> Column:
    """B-22: of all splits at a hyphen, the one in which the side that is the event's team is longest, the first on ties."""
    from ..functions.text import identity_text

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1))), lambda i: F.substr(short, i, F.lit(1)) == "-")
    trim = lambda x: F.regexp_replace(x, "^[ -]+|[ -]+$", "")
    splits = F.transform(places, lambda i: F.struct(trim(F.substr(short, F.lit(1), i - 1)).alias("home"), trim(F.substr(short, i + 1)).alias("away"), i.alias("i")))
    key = identity_text(team)
    size = lambda x: F.when(identity_text(x) == key, F.length(x)).otherwise(-1)
    scored = F.transform(F.filter(splits, lambda s: (s["home"] != "") & (s["away"] != "")), lambda s: F.struct(F.greatest(size(s["home"]), size(s["away"])).alias("size"), (-s["i"]).alias("turn"), s["home"].alias("home"), s["away"].alias("away")))
    return F.array_max(F.filter(scored, lambda s: s["size"] >= 0))


def _pinn_league() -> Column:
    key = league_key(F.col("e.competitionName"))
    return F.coalesce(lookup(LEAGUES_A, key), F.nullif(key, F.lit("")), F.lit("basketball"))


def pinnbet_props(events: DataFrame, details: DataFrame) -> DataFrame:
    """B-20, B-22, B-23: player events joined with their bets (``details``: ``{id, bets}`` documents)."""
    e = events.select(F.explode(F.from_json("payload", f"array<{BET_EVENT}>")).alias("e")).where("e.mappingTypeId = 5")
    b = details.select(F.from_json("payload", f"id string, bets {_BETS}").alias("d")).select("d.id", F.explode("d.bets").alias("b"))
    market = F.coalesce(lookup(PINN_MARKETS, F.col("b.betTypeId").try_cast("int")), lookup(PINN_NAMES, _bet_key(F.col("b.betTypeName"))))
    rows = e.join(b, F.col("e.id") == F.col("id")).withColumns({"market": market, "line": number(F.col("b.sBV")), "s": _named_sides(F.col("b.betOutcomes"), "više")}).where("market is not null and line is not null and (s.over is not null or s.under is not null)")
    player, team = _split_name(F.col("e.name"), F.lit(None).cast("string"))
    rows = rows.withColumns({"player": player, "team": team}).withColumn("pair", matchup_of_short_name(F.coalesce("e.shortName", F.lit("")), F.col("team"))).where("player <> ''")
    return _raw(rows, "pinnbet", league_id=_pinn_league(), home_team=F.coalesce("pair.home", "team", F.lit("")), away_team=F.coalesce("pair.away", "player"), player_name="player", market_type="market", threshold="line", over_odds="s.over", under_odds="s.under", start_time=iso_start(F.col("e.dateTime")))


def pinnbet_totals(docs: DataFrame) -> DataFrame:
    """B-21."""
    e = docs.select(F.explode(F.from_json("payload", f"array<{BET_EVENT}>")).alias("e")).select("e", F.explode("e.bets").alias("b"))
    wanted = ((F.col("b.betTypeId") == "167") | (_bet_key(F.col("b.betTypeName")) == "ukupno poena (+ot)")) & F.coalesce("b.isPlayable", F.lit(False))
    home, away = _split_name(F.col("e.name"), F.lit(None).cast("string"))
    rows = e.where(wanted).withColumns({"line": number(F.col("b.sBV")), "s": _named_sides(F.col("b.betOutcomes"), "više"), "home": home, "away": away}).where("line is not null and home <> '' and away <> '' and (s.over is not null or s.under is not null)")
    return _raw(rows, "pinnbet", league_id=_pinn_league(), home_team="home", away_team="away", market_type=F.lit("game_total_ot"), threshold="line", over_odds="s.over", under_odds="s.under", start_time=iso_start(F.col("e.dateTime")))


def admiralbet(docs: DataFrame) -> DataFrame:
    """B-27 to B-29."""
    e = docs.select(F.explode(F.from_json("payload", f"array<{BET_EVENT}>")).alias("e"))
    left, right = _split_name(F.coalesce("e.name", F.lit("")), F.lit(""))
    raw = F.lower(F.trim("e.competitionName"))
    league = F.when(F.coalesce(raw, F.lit("")) == "", "basketball").otherwise(F.coalesce(lookup(LEAGUES_A, league_key(raw)), raw))
    b = e.withColumns({"left": left, "right": right, "league": league}).select("e", "left", "right", "league", F.explode("e.bets").alias("b")).where("b.isPlayable and left <> '' and right <> ''")
    kind = F.col("b.betTypeId")
    lined = b.withColumns({"line": number(F.col("b.sBV")), "s": _named_sides(F.col("b.betOutcomes"), "vise")}).where("line is not null and (s.over is not null or s.under is not null)")
    start = iso_start(F.col("e.dateTime"), keep_invalid=False)
    props = _raw(lined.where(kind == "1598"), "admiralbet", league_id="league", home_team="right", away_team="left", player_name="left", market_type=F.lit("player_points"), threshold="line", over_odds="s.over", under_odds="s.under", start_time=start)
    totals = _raw(lined.where((kind == "213") & F.contains(F.lower(F.coalesce("b.betTypeName", F.lit(""))), F.lit("+ot"))), "admiralbet", league_id="league", home_team="left", away_team="right", market_type=F.lit("game_total_ot"), threshold="line", over_odds="s.over", under_odds="s.under", start_time=start)
    steps = b.where(kind == "1683").select("e", "left", "right", "league", F.explode("b.betOutcomes").alias("o")).withColumn("line", lookup(ADMIRAL_MILESTONES, F.trim("o.name"))).where("o.isPlayable and line is not null and o.odd is not null")
    ladder = _raw(steps, "admiralbet", league_id="league", home_team="right", away_team="left", player_name="left", market_type=F.lit("player_points_milestones"), threshold="line", over_odds="o.odd", under_odds=F.lit(None), start_time=start)
    return reduce(DataFrame.unionByName, (props, ladder, totals))


def balkanbet(docs: DataFrame) -> DataFrame:
    """B-24 to B-26, B-31: markets under 'o' or 'markets', as an object or a list, with short or long keys."""
    e = docs.select(F.parse_json("payload").alias("v")).select(F.explode(F.try_variant_get("v", "$.data.events", "array<variant>")).alias("e"))
    get = lambda v, kind, *names: F.coalesce(*(F.try_variant_get(v, f"$.{n}", kind) for n in names))
    name = F.coalesce(get("e", "string", "j", "name"), F.lit(""))
    tournament, category = (get("e", "string", *n).try_cast("int") for n in (("f", "tournamentId"), ("c", "categoryId")))
    league = F.coalesce(lookup(BALKAN_TOURNAMENTS, tournament), F.concat(F.lit("balkanbet_tournament_"), tournament.cast("string")), F.concat(F.lit("balkanbet_category_"), category.cast("string")), F.lit("basketball"))
    box = lambda kind: F.coalesce(F.try_variant_get("e", "$.o", kind), F.try_variant_get("e", "$.markets", kind))
    markets = F.coalesce(box("array<variant>"), F.map_values(box("map<string,variant>")))
    start = iso_start(get("e", "string", "n", "startsAt"))
    m = e.select(name.alias("name"), league.alias("league"), start.alias("start"), F.explode(markets).alias("m"))
    line = number(F.coalesce(F.try_variant_get("m", "$.g[0]", "string"), F.try_variant_get("m", "$.specialValues[0]", "string")))
    outcomes = F.transform(F.coalesce(F.try_variant_get("m", "$.h", "array<variant>"), F.try_variant_get("m", "$.outcomes", "array<variant>")), lambda o: F.struct(F.lower(F.coalesce(get(o, "string", "name", "e"), F.lit(""))).alias("name"), get(o, "double", "odd", "odds", "g").alias("price")))
    sides = sided(outcomes, lambda o: F.startswith(o["name"], F.lit("više")), lambda o: F.startswith(o["name"], F.lit("manje")), lambda o: o["price"])
    rows = m.withColumns({"market": F.coalesce(get("m", "bigint", "b"), get("m", "bigint", "marketId")), "line": line, "s": sides}).where("line is not null and (s.over is not null or s.under is not null)")
    player = F.trim(F.when(F.col("name").rlike(r"^(.+?)\s*\(([^)]+)\)\s*$"), F.regexp_extract("name", r"^(.+?)\s*\(([^)]+)\)\s*$", 1)).otherwise(F.col("name")))
    team = F.trim(F.regexp_extract("name", r"^(.+?)\s*\(([^)]+)\)\s*$", 2))
    props = _raw(rows.where("market = 2402").withColumn("player", player).where("player <> ''"), "balkanbet", league_id="league", home_team=team, away_team="player", player_name="player", market_type=F.lit("player_points"), threshold="line", over_odds="s.over", under_odds="s.under", start_time="start")
    home, away = _split_name(F.col("name"), F.lit(""))
    totals = _raw(rows.where("market = 530").withColumns({"home": home, "away": away}).where("home <> '' and away <> ''"), "balkanbet", league_id="league", home_team="home", away_team="away", market_type=F.lit("game_total_ot"), threshold="line", over_odds="s.over", under_odds="s.under", start_time="start")
    return props.unionByName(totals)


def mock(spark: SparkSession, first_start: str = "2026-01-01T18:00:00") -> DataFrame:
    """A-13: 5 games, 3 sources, 14 points lines of each source; spellings and lines differ from source to source."""
    base = spark.sql(f"""
      select g.id as game, p.id as player, b.* from (select explode(sequence(0, 4)) as id) g, lateral (select explode(sequence(0, if(g.id < 4, 2, 1))) as id) p,
             (select * from values ('mozzart', 0, 0.0D), ('meridian', 1, 1.0D), ('maxbet', 2, 2.0D) as t(book, style, shift)) b""")
    first, last = F.element_at(F.array(*map(F.lit, ("Marko", "Luka", "Nemanja"))), F.col("player") + 1), F.concat(F.lit("Igrić"), F.chr(65 + F.col("game")))
    name = F.when(F.col("style") == 0, F.concat_ws(" ", first, last)).when(F.col("style") == 1, F.concat(F.substring(first, 1, 1), F.lit(". "), last)).otherwise(F.concat(last, F.lit(" "), F.substring(first, 1, 1), F.lit(".")))
    start = F.date_format(F.lit(first_start).cast("timestamp") + F.make_dt_interval(hours=F.col("game")), "yyyy-MM-dd'T'HH:mm:ss")
    return _raw(base, "mock", bookmaker_id="book", league_id=F.lit("euroleague"), home_team=F.concat(F.lit("Home "), F.col("game").cast("string")), away_team=F.concat(F.lit("Away "), F.col("game").cast("string")), player_name=name, market_type=F.lit("player_points"), threshold=14.5 + F.col("player") * 3 + F.col("shift"), over_odds=1.85 + F.col("style") * 0.05, under_odds=1.95 - F.col("style") * 0.05, start_time=start)


class Registry:
    """A-01, A-02, A-14: sources by id; the last registration of an id counts, in the place of the first."""

    def __init__(self) -> None:
        self._sources: dict[str, Callable[..., DataFrame]] = {}

    def register(self, bookmaker_id: str, read: Callable[..., DataFrame]) -> None:
        self._sources[bookmaker_id] = read

    def ids(self) -> list[str]:
        return list(self._sources)

    def read_all(self, inputs: dict[str, DataFrame]) -> DataFrame:
        """I-01, B-36: the union of the sources that have input; a source without any gives no rows."""
        frames = [read(inputs[name]) for name, read in self._sources.items() if name in inputs]
        return reduce(DataFrame.unionByName, frames)


def pinnbet(docs: DataFrame) -> DataFrame:
    """Lists of events, and ``{id, bets}`` documents of the player events among them."""
    detail = F.get_json_object("payload", "$.bets").isNotNull()
    lists = docs.where(~detail)
    return pinnbet_totals(lists).unionByName(pinnbet_props(lists, docs.where(detail)))


#: Every source's reader of all its documents.
READERS = {
    "mozzart": mozzart, "oktagonbet": oktagon, "meridian": meridian, "maxbet": maxbet, "merkurxtip": merkurxtip, "pinnbet": pinnbet, "balkanbet": balkanbet, "admiralbet": admiralbet,
}


def default_registry() -> Registry:
    out = Registry()
    for name, read in READERS.items():
        out.register(name, read)
    return out


def chosen_registry(modes: dict[str, str], mock_read: Callable[..., DataFrame]) -> Registry:
    """A-14: sources by configured mode: ``real`` takes the source's reader, or the mock one where there is none; ``mock`` the mock one; others are left out."""
    out = Registry()
    for name, mode in modes.items():
        if mode in ("real", "mock"):
            out.register(name, READERS.get(name, mock_read) if mode == "real" else mock_read)
    return out
