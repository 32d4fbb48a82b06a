"""Queries on text, fuzzy likeness and player names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fuzzy, odds, text
from ..operators import players
from ..sources import domain
from ..sources.domain import IDENTITY

_LOW = "lower(strip_accents({x}))"


def text_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = domain.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.identity_text(F.col("text"))).alias("identity"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = domain.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.identity_tokens(F.col("text"))).alias("words"), F.size(text.identity_tokens(F.col("text"), True)).alias("hyphenated"))


def text_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = domain.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(text.compact_text(F.col("text"))).alias("n"))


def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = domain.table(spark, sf_dir, "documents")
    return d.where(text.search_match("ENTRÉ la", F.col("text"), F.col("lang"))).select("doc_id", "lang")


def market_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "('Points&Assists'), ('  player   points + rebounds '), ('PRA'), ('3-points'), ('Corners'), ('game_total_ot'), ('points+rebounds+assists')"
    return spark.sql(f"select * from values {raw} as t(raw)").select("raw", text.market_type(F.col("raw")).alias("market"))


def humanize_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = domain.table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws("_", F.lit("nba"), F.replace("p_name", F.lit(" "), F.lit("-")))).alias("slug"))
    return p.select("p_partkey", text.humanize_league(F.col("slug")).alias("name"))


def match_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", odds.match_id(F.lit("basketball"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey"), F.col("o_orderkey")).alias("match_id"))


def csv_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = domain.table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(", ", "c_mktsegment", F.lit(""), "c_name").alias("p"))
    return c.select("c_custkey", F.array_join(text.split_csv(F.col("p")), "|").alias("parts"), text.split_csv(F.lit(" , ")).isNull().alias("none"))


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the list of part names, per colour: a bounded number of short pairs."""
    p = domain.table(spark, sf_dir, "part").select("p_name").distinct()
    near = W.partitionBy(F.substring("p_name", 1, 1)).orderBy("p_name")
    return p.select(F.col("p_name").alias("a"), F.lead("p_name").over(near).alias("b")).where("b is not null")


def _fuzzy(score):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _name_pairs(spark, sf_dir).select("a", "b", F.round(score(F.col("a"), F.col("b")), 4).alias("score"))

    return query


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player quotes of 200 matches in several spellings of 40 people."""
    k = F.col("l_orderkey")
    line = domain.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    first, last = F.element_at(F.array(*map(F.lit, ("Nikola", "Ana", "Đorđe", "Marko", "Luka"))), (F.col("l_partkey") % 5 + 1).cast("int")), F.concat(F.lit("Perić"), F.chr(97 + F.col("l_partkey") % 8))
    name = F.when(k % 3 == 0, F.concat_ws(" ", first, last)).when(k % 3 == 1, F.concat(F.substring(first, 1, 1), F.lit(". "), last)).otherwise(F.concat(text.strip_diacritics(last), F.lit(" "), F.substring(first, 1, 1), F.lit(".")))
    return line.select(F.concat(F.lit("m"), (F.col("l_partkey") % 200).cast("string")).alias("match_id"), name.alias("player_name"), k.alias("seq"))


def player_compact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-11: spellings that differ in marks, spacing or punctuation only, under the most frequent and richest one."""
    counted = players.name_counts(_quotes(spark, sf_dir)).withColumn("key", text.compact_text(F.col("name")))
    rank = F.struct("n", F.length(F.regexp_replace("name", r"[\x00-\x7f]", "")), F.length(F.regexp_replace("name", "[^-]", "")), F.length("name"), "name")
    return counted.groupBy("match_id", "key").agg(F.max_by("name", rank).alias("name"), F.sum("n").alias("n"))


def player_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return players.resolve_players(_quotes(spark, sf_dir)).groupBy("match_id", "player_name").agg(F.count("*").alias("n"))


def known_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "('S. Vezenkov'), ('Kevin  DURANT'), ('Nik Calates'), ('Unknown Person'), ('Leesville Bob'), ('Walter Tavarez')"
    return spark.sql(f"select * from values {raw} as t(raw)").select("raw", players.known_player(F.col("raw")).alias("player"))


QUERIES = {f.__name__: f for f in (text_identity, text_tokens, text_compact, search_filter, market_type_map, humanize_league, match_id_hash, csv_params, player_compact_merge, player_resolution, known_players)}
QUERIES |= {"fuzzy_ratio": _fuzzy(fuzzy.ratio), "fuzzy_token_sort": _fuzzy(fuzzy.token_sort_ratio), "fuzzy_token_set": _fuzzy(fuzzy.token_set_ratio), "fuzzy_partial": _fuzzy(fuzzy.partial_ratio)}

_HYPHENS = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({x})), '_', ' '), '[^a-z0-9\s-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_KEPT = "list_filter(list_transform(string_split(" + _HYPHENS + ", ' '), lambda w: trim(w, '-')), lambda w: w <> '')"
_SEARCH = r"trim(regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

_PAIRS = """names as (select distinct p_name from part),
pairs as (select p_name as a, lead(p_name) over (partition by p_name[1] order by p_name) as b from names qualify b is not null)"""


def _ratio_sql(a: str, b: str) -> str:
    """C-17 of two columns: the table of common subsequences, a row for each character of ``a``, by nested reductions."""
    first = f"list_transform(range(0, length({b}) + 1), lambda i: 0::bigint)"
    letters = f"list_transform(string_split({a}, ''), lambda ch: [unicode(ch)::bigint])"
    places = f"list_prepend([0::bigint], list_transform(range(1, length({b}) + 1), lambda i: [i]))"
    best = f"greatest(above[i[1]] + (case when unicode({b}[i[1]:i[1]]) = ch[1] then 1 else 0 end), above[i[1] + 1], acc[-1])"
    table = f"list_reduce(list_prepend({first}, {letters}), lambda above, ch: list_reduce({places}, lambda acc, i: list_append(acc, {best})))"
    return f"(case when length({a}) + length({b}) = 0 then 100.0 else 200.0 * {table}[-1] / (length({a}) + length({b})) end)"


def _tokens_sql(x: str) -> str:
    return rf"list_sort(list_filter(string_split_regex(trim({x}), '\s+'), lambda w: w <> ''))"


_SETS = f"""{_PAIRS},
words as (select a, b, list_sort(list_distinct({_tokens_sql('a')})) as l, list_sort(list_distinct({_tokens_sql('b')})) as r from pairs),
parts as (select *, list_filter(l, lambda x: list_contains(r, x)) as both_, list_filter(l, lambda x: not list_contains(r, x)) as only_l, list_filter(r, lambda x: not list_contains(l, x)) as only_r from words),
said as (select *, array_to_string(both_, ' ') as s, trim(array_to_string(both_, ' ') || ' ' || array_to_string(only_l, ' ')) as wl, trim(array_to_string(both_, ' ') || ' ' || array_to_string(only_r, ' ')) as wr from parts)"""

ORACLES = {
    "text_identity": f"select doc_id, md5({IDENTITY.format(x='text')}) as identity from documents",
    "text_tokens": f"select doc_id, len(list_filter(string_split({IDENTITY.format(x='text')}, ' '), lambda w: w <> ''))::int as words, len({_KEPT.format(x='text')})::int as hyphenated from documents",
    "text_compact": f"select doc_id, length(replace(array_to_string({_KEPT.format(x='text')}, ''), '-', ''))::int as n from documents",
    "search_filter": f"select doc_id, lang from documents where contains({_SEARCH.format(x='''concat_ws(' ', text, lang)''')}, 'entre la')",
    "market_type_map": """select * from (values ('Points&Assists', 'player_points_assists'), ('  player   points + rebounds ', 'player_points_rebounds'), ('PRA', 'player_points_rebounds_assists'), ('3-points', 'player_3points'),
('Corners', 'corners'), ('game_total_ot', 'game_total_ot'), ('points+rebounds+assists', 'player_points_rebounds_assists')) t(raw, market)""",
    "humanize_league": """select p_partkey, array_to_string(list_transform(string_split_regex('nba_' || lower(replace(p_name, ' ', '-')), '[_-]'), lambda w: case when length(w) <= 4 and regexp_matches(w, '^[a-z]+$') then upper(w) else upper(w[1:1]) || lower(w[2:]) end), ' ') as name from part""",
    "match_id_hash": "select o_orderkey, substr(md5('basketball:' || strftime(o_orderdate, '%Y-%m-%d') || ':' || o_custkey || ':' || o_orderkey), 1, 12) as match_id from orders",
    "csv_params": "select c_custkey, c_mktsegment || '|' || c_name as parts, true as none from customer",
    "player_compact_merge": f"""with q as (
  select 'm' || (l_partkey % 200) as match_id, l_orderkey % 3 as k, (['Nikola', 'Ana', 'Đorđe', 'Marko', 'Luka'])[l_partkey % 5 + 1] as f, 'Perić' || chr((97 + l_partkey % 8)::int) as l from lineitem),
n as (select match_id, case k when 0 then f || ' ' || l when 1 then f[1:1] || '. ' || l else strip_accents(l) || ' ' || f[1:1] || '.' end as name, count(*) as n from q group by 1, 2),
c as (select *, replace(array_to_string({_KEPT.format(x='name')}, ''), '-', '') as key from n)
select match_id, key, first(name order by n desc, length(regexp_replace(name, '[\\x00-\\x7f]', '', 'g')) desc, length(regexp_replace(name, '[^-]', '', 'g')) desc, length(name) desc, name desc) as name, sum(n)::bigint as n from c group by 1, 2""",
    # the fitting of given names is stated without the likeness of 80 %: no two of these people's given names share an initial
    "player_resolution": f"""with recursive q as (
  select 'm' || (l_partkey % 200) as match_id, l_orderkey % 3 as k, (['Nikola', 'Ana', 'Đorđe', 'Marko', 'Luka'])[l_partkey % 5 + 1] as f, 'Perić' || chr((97 + l_partkey % 8)::int) as l from lineitem),
n as (
  select match_id, case k when 0 then f || ' ' || l when 1 then f[1:1] || '. ' || l else strip_accents(l) || ' ' || f[1:1] || '.' end as name, count(*) as n
  from q group by 1, 2),
c as (select *, replace(array_to_string({_KEPT.format(x='name')}, ''), '-', '') as key from n),
best as (
  select match_id, key, sum(n)::bigint as total,
         first(name order by n desc, length(regexp_replace(name, '[\\x00-\\x7f]', '', 'g')) desc, length(regexp_replace(name, '[^-]', '', 'g')) desc, length(name) desc, name desc) as best
  from c group by 1, 2),
people as (select match_id, best as name, total as n, {_KEPT.format(x='best')} as words, contains(string_split(best, ' ')[-1], '.') as short from best),
written as (
  select *, words[1] as first_word, list_sum(list_transform(words[1:len(words) - 1], lambda w: case when length(w) > 1 then length(w) else 0 end)) as fullness
  from people where len(words) >= 2),
ways as (
  select match_id, name, n, first_word, fullness, false as turned, words[1] as given, words[-1] as last_word from written
  union all select match_id, name, n, first_word, fullness, true, words[2], words[1] from written where short and len(words) = 2),
pairs as (
  select distinct m.match_id, m.name, m.n, m.fullness, o.n as o_n, o.fullness as o_full, length(o.name) as o_len, o.name as o_name, o.first_word as o_first
  from ways m join ways o on m.match_id = o.match_id and m.last_word = o.last_word and m.name <> o.name and not (m.turned and o.turned)
  where starts_with(m.given, o.given) or starts_with(o.given, m.given)),
ranked as (
  select *, row_number() over r as place, lead(struct_pack(a := o_n, b := o_full, c := o_len)) over r as next_one, first_value(o_first) over (partition by match_id, name order by length(o_first) desc, o_first desc) as longest
  from pairs window r as (partition by match_id, name order by o_n desc, o_full desc, o_len desc, o_name desc)),
one_name as (select match_id, name from ranked group by 1, 2 having bool_and(starts_with(longest, o_first))),
better as (
  select match_id, name, o_name as better from ranked join one_name using (match_id, name)
  where place = 1 and (o_full > fullness or o_full = fullness and o_n > n) and (next_one is null or next_one <> struct_pack(a := o_n, b := o_full, c := o_len))),
walk as (
  select match_id, name, n, best as here from c join best using (match_id, key)
  union all select w.match_id, w.name, w.n, b.better from walk w join better b on b.match_id = w.match_id and b.name = w.here)
select match_id, here as player_name, sum(n)::bigint as n from walk w where not exists (select 1 from better b where b.match_id = w.match_id and b.name = w.here) group by 1, 2""",
    "fuzzy_ratio": f"with {_PAIRS} select a, b, round({_ratio_sql('a', 'b')}, 4) as score from pairs",
    "fuzzy_token_sort": f"""with {_PAIRS}, t as (select a, b, array_to_string({_tokens_sql('a')}, ' ') as x, array_to_string({_tokens_sql('b')}, ' ') as y from pairs)
select a, b, round({_ratio_sql('x', 'y')}, 4) as score from t""",
    "fuzzy_token_set": f"""with {_SETS}
select a, b, case when len(l) = 0 or len(r) = 0 then 0.0 when len(both_) > 0 and (len(only_l) = 0 or len(only_r) = 0) then 100.0
                  else round(greatest({_ratio_sql('wl', 'wr')}, case when len(both_) > 0 then greatest({_ratio_sql('s', 'wl')}, {_ratio_sql('s', 'wr')}) else 0.0 end), 4) end as score
from said""",
    "fuzzy_partial": f"""with {_PAIRS},
sized as (select a, b, case when length(a) > length(b) then b else a end as x, case when length(a) > length(b) then a else b end as y from pairs),
placed as (select *, unnest(range(2 - length(x), length(y) + 1)) as i from sized),
cut as (select a, b, x, substr(y, greatest(i, 1), least(i + length(x), length(y) + 1) - greatest(i, 1)) as y from placed)
select a, b, round(max({_ratio_sql('x', 'y')}), 4) as score from cut group by 1, 2""",
    "known_players": """select * from (values ('S. Vezenkov', 'Sasha Vezenkov'), ('Kevin  DURANT', 'Kevin Durant'), ('Nik Calates', 'Nick Calathes'), ('Unknown Person', 'Unknown Person'), ('Leesville Bob', 'Saben Lee'), ('Walter Tavarez', 'Walter Tavares')) t(raw, player)""",
}
