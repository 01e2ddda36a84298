"""Snapshot tables derived from the driver's tables by arithmetic, in SQL that Spark and DuckDB read alike. All people are invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _pick(values: str, number: str) -> str:
    return f"split_part('{values}', '|', cast(({number}) % {values.count('|') + 1} + 1 as int))"


def _div(number: str, by: int) -> str:
    return f"cast(floor(({number}) / {by}) as bigint)"


#: A fourth of all people share ten surnames; the others' grow in number with the table.
SURNAME = f"concat({_pick('Goh|Satori|Novak|Berg|Okafor|Lindqvist|Moreau|Haas|Ito|Petrov', 'c_custkey')}, case when c_custkey % 4 = 0 then '' else concat({_pick('ano|ev|sen|ski|well|ford|lin|dez|man|ova|ton', _div('c_custkey', 10))}, {_pick('a|is|o|e|us|ar|en|ik|or|as|um|el|os', _div('c_custkey', 110))}) end)"
GIVEN = _pick("Jo|Mi|Ra|Te|Su|Le|An|Be|Ki|Do|Na", "c_custkey"), _pick("Na|Ran|To|Mi|Vel|Sa|Rik", "c_custkey")


def _styled(style: str) -> str:
    (g, h), s = GIVEN, SURNAME
    return (
        f"case ({style}) % 5 when 0 then concat({g}, ' ', {h}, ' ', {s}) when 1 then concat({g}, lower({h}), ' ', {s}) when 2 then upper(concat({s}, ' ', {g}, ' ', {h})) "
        f"when 3 then concat(upper({s}), ', ', {g}, ' ', {h}) else concat(substring({g}, 1, 1), '. ', substring({h}, 1, 1), '. ', {s}) end"
    )


def _org(key: str, kinds: str) -> str:
    place = f"concat({_pick('Alder|Birch|Cedar|Dahlia|Elmwood|Firth|Gorse', key)}, {_pick('|bury|ford|mere|stead|vale|wick|by|gate|haven|moor', _div(key, 42))}, {_pick('| North| East| South| West| Upper| Lower', _div(key, 462))})"
    return f"concat({place}, ' ', {_pick(kinds, key)})"


FULL = "Institute of Technology|University|Materials Research Institute|Electronics Co., Ltd.|National Laboratory|Chemical Industries Inc."
SHORT = "Inst. of Tech.|Univ.|Mater. Res. Inst.|ELECTRONICS CO LTD|Natl. Lab.|Chem. Ind."
LOCAL = f"lower(concat(substring({GIVEN[0]}, 1, 1), substring({GIVEN[1]}, 1, 1), {SURNAME}))"

TABLES = {
    "people": f"select c_custkey as person_id, {_styled('c_custkey')} as name, case when c_custkey % 3 = 0 then {_org(_div('c_custkey', 15), SHORT)} else {_org(_div('c_custkey', 15), FULL)} end as affiliation, {_pick('signal processing|polymer, film|/|battery / cell', 'c_custkey')} as field from {{customer}}",
    "authors": f"select c_custkey * 10 as author_id, {_styled('c_custkey + 2')} as display_name, c_custkey % 60 as works_count, {_pick('signal|polymer|battery', 'c_custkey')} as topic, {_org(_div('c_custkey', 15), FULL)} as institution, c_custkey % 4 > 0 as current from {{customer}}",
    "orgs": f"select s_suppkey as org_id, {_org('s_suppkey', FULL)} as name, {_org('s_suppkey', SHORT)} as short_name, concat('https://www.org', cast(s_suppkey as varchar(12)), '.example/en?x=1') as website from {{supplier}}",
    "works": f"select o_custkey * 10 as author_id, o_orderkey as work_id, case when o_orderkey % 5 > 0 then concat('https://doi.org/10.9999/A', cast({_div('o_orderkey', 4)} as varchar(12))) end as doi, year(o_orderdate) as year, o_orderpriority as title from {{orders}}",
    "locations": f"select l_orderkey as work_id, l_linenumber as pos, concat('https://', {_pick('repository.example|www.mdpi.com|files.example|core.ac.uk', 'l_suppkey')}, '/', cast(l_partkey as varchar(12)), '.pdf') as url, l_returnflag = 'R' as ok from {{lineitem}}",
    "hits": f"select c_custkey as person_id, concat({LOCAL}, '@', {_pick('mail|lab|ee', 'c_custkey')}, '.org', cast({_div('c_custkey', 15)} + c_custkey % 2 as varchar(12)), '.example') as email, 'html' as source, c_custkey % 9 = 0 as self_stated, c_custkey % 3 as strength from {{customer}} where c_mktsegment <> 'BUILDING' union all select c_custkey as person_id, concat({LOCAL}, '@', {_pick('gmail.example|org3.example|naver.example', 'c_custkey')}) as email, 'pdf' as source, false as self_stated, c_custkey % 2 as strength from {{customer}} where c_mktsegment <> 'BUILDING'",
    "domains": f"select c_custkey as person_id, concat('www.org', cast({_div('c_custkey', 15)} as varchar(12)), '.example') as domain from {{customer}} where c_custkey % 6 > 0",
    "notes": f"select c_custkey as note_id, concat('Write to ', {LOCAL}, {_pick(' [at] | (AT) |%40|&#64;| AT |@', 'c_custkey')}, 'org', cast(c_custkey % 42 as varchar(9)), {_pick(' (dot) |.| DOT ', 'c_custkey')}, 'example, or {{{{info, ', lower({SURNAME}), '}}}} @ lab.example now') as text from {{customer}}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; only the driver table that it needs is read."""
    source = next(t for t in ("customer", "supplier", "orders", "lineitem") if "{" + t + "}" in TABLES[name])
    return spark.sql(TABLES[name], **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def sql(name: str) -> str:
    """The derived table in DuckDB, over the tables as registered."""
    return TABLES[name].format(customer="customer", supplier="supplier", orders="orders", lineitem="lineitem")
