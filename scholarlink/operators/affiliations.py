"""From affiliations as people write them to the organisation's names, its registry record and its official domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ORG_CUES
from ..functions.orgs import expand_abbreviations, host_of
from .aliases import Aliases, alias_table, canonical
from .matching import match_orgs, where_same_org
from .store import settle


def pick_entity(hits: DataFrame, sites: DataFrame, aliases: Aliases, most: int = 2) -> DataFrame:
    """The first search hit of each affiliation that is its organisation, with up to two http sites -> affiliation, entity_id, label, sites.

    hits (affiliation, hit_rank, entity_id, label, description, matched), sites (entity_id, pos, url). The label is ASCII and the
    description names a kind of organisation; a Korean affiliation was matched as a whole, blanks aside, any other is strictly the label's.
    """
    fine = hits.where((F.col("label") != "") & ~F.col("label").rlike(r"[^\x00-\x7F]") & F.col("description").rlike("(?i)" + "|".join(ORG_CUES)))
    korean = F.col("affiliation").rlike("[가-힣]")
    bare = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(" "), F.lit(""))
    whole = fine.where(korean & ((bare("matched") == "") | (bare("matched") == bare("affiliation"))))
    kept = whole.unionByName(where_same_org(fine.where(~korean), "affiliation", "label", aliases))
    first = kept.groupBy("affiliation").agg(F.min(F.struct("hit_rank", "entity_id", "label")).alias("x")).select("affiliation", "x.entity_id", "x.label")
    urls = sites.where(F.col("url").startswith("http")).groupBy("entity_id", "url").agg(F.min("pos").alias("pos"))
    listed = urls.groupBy("entity_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]), 1, most).alias("sites"))
    return first.join(listed, "entity_id", "left").select("affiliation", "entity_id", "label", F.coalesce("sites", F.array().cast("array<string>")).alias("sites"))


def spellings(df: DataFrame, *keys: Column | str) -> DataFrame:
    """The keys with kind (0 for display_name, 1 for names), pos and spelling of a registry or institution record."""
    every = F.concat(F.array("display_name"), F.coalesce("names", F.array().cast("array<string>")))
    return df.select(*keys, F.posexplode(every).alias("pos", "spelling")).withColumn("kind", F.least("pos", F.lit(1))).where("spelling != ''")


def expand(affiliations: DataFrame, companies: DataFrame, entities: DataFrame, registry: DataFrame, institutions: DataFrame, aliases: Aliases, most: int = 20) -> DataFrame:
    """affiliation -> affiliation, names, ror, websites array<struct pos, url, source>, registry_domains.

    companies (affiliation, corp_name, english_name, website) and entities (affiliation, label, sites) are what was picked for it before, registry
    (ror, display_name, names, website, domains), institutions (institution_id, display_name, names, homepage, ror). A company counts for Korean
    affiliations alone. What is known of an affiliation are its own spelling, the company's two names, the entity's label and the spelling without abbreviations;
    one registry record is strictly one of those, by its display name before other names, and one institution, by any of its names,
    strictly one of those or of the record's, each by the earliest. Where no record was found the institution's registry id leads to one. names: aliases first, then what was found, short ASCII ones left out.
    """
    own = affiliations.select("affiliation").where("affiliation != ''").distinct()
    firms = companies.where(F.col("affiliation").rlike("[가-힣]"))
    site_of = F.when(F.col("website").startswith("http"), F.col("website")).when(F.col("website") != "", F.concat(F.lit("https://"), "website"))
    firms = firms.select("affiliation", F.when(F.col("english_name") != "", F.col("corp_name")).alias("corp_name"), "english_name", site_of.alias("website"))
    part = lambda df, rank, name: df.select("affiliation", F.lit(rank).alias("rank"), F.col(name).alias("seed"))
    seeds = [part(own.withColumn("n", F.col("affiliation")), 0, "n"), part(firms, 1, "corp_name"), part(firms, 1, "english_name"), part(entities, 2, "label"), part(own.withColumn("n", expand_abbreviations(F.col("affiliation"))), 3, "n")]
    seeds = settle(reduce(DataFrame.unionByName, seeds).where("seed != ''").groupBy("affiliation", "seed").agg(F.min("rank").alias("rank")))

    listed = settle(spellings(registry, "ror"))
    same = match_orgs(seeds.select("seed"), listed.select("spelling"), "seed", "spelling", aliases, strict=True)
    record = seeds.join(same, "seed").join(listed, "spelling").groupBy("affiliation").agg(F.min(F.struct("rank", "kind", "ror")).alias("x")).select("affiliation", "x.ror")
    record = settle(record.join(registry, "ror"))
    known = seeds.unionByName(spellings(record, "affiliation", F.lit(4).alias("rank")).select("affiliation", "rank", F.col("spelling").alias("seed")))
    places = spellings(institutions, "institution_id")
    same = match_orgs(known.select("seed"), places.select("spelling"), "seed", "spelling", aliases, strict=True)
    place = known.join(same, "seed").join(places, "spelling").groupBy("affiliation").agg(F.min(F.struct("rank", "institution_id")).alias("x")).select("affiliation", "x.institution_id")
    place = settle(place.join(institutions, "institution_id"))
    followed = place.join(record.select("affiliation"), "affiliation", "left_anti").select("affiliation", "ror").join(registry, "ror")

    every = lambda df, rank: spellings(df, "affiliation", F.lit(rank).alias("rank")).select("affiliation", "rank", "pos", F.col("spelling").alias("name"))
    one = lambda df, rank, name: df.select("affiliation", F.lit(rank).alias("rank"), F.lit(0).alias("pos"), F.col(name).alias("name"))
    by_name = lambda df, rank: df.select("affiliation", F.lit(rank).alias("rank"), F.posexplode("names").alias("pos", "name"))
    found = reduce(DataFrame.unionByName, [one(firms, 0, "corp_name"), one(firms, 1, "english_name"), one(entities, 2, "label"), by_name(record, 3), every(place, 4), by_name(followed, 5)]).where("name != '' and name != affiliation")
    found = found.groupBy("affiliation", "name").agg(F.min(F.struct("rank", "pos")).alias("at"))
    in_order = lambda df: df.groupBy("affiliation").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
    short = lambda n: ~n.rlike(r"[^\x00-\x7F]") & (F.length(F.regexp_replace(n, "[^A-Za-z]", "")) < 4)
    found = in_order(found).withColumn("names", F.filter(F.slice("names", 1, most), lambda n: ~short(n)))
    members = canonical(own, "affiliation", aliases).join(aliases.names, F.col("canonical") == F.col("canon")).where("name != affiliation")
    members = in_order(members.select("affiliation", F.struct(F.lit(0).alias("rank"), F.lit(0).alias("pos")).alias("at"), "name").distinct()).withColumnRenamed("names", "aliases")

    site = lambda df, rank, url, source: df.select("affiliation", F.lit(rank).alias("pos"), F.col(url).alias("url"), F.lit(source).alias("source"))
    sites = [site(firms, 0, "website", "company"), site(entities.select("affiliation", F.explode("sites").alias("url")), 1, "url", "entity"), site(record, 2, "website", "registry"), site(place, 3, "homepage", "institution")]
    websites = reduce(DataFrame.unionByName, sites).where("url != ''").groupBy("affiliation").agg(F.slice(F.array_sort(F.collect_set(F.struct("pos", "url", "source"))), 1, 5).alias("websites"))
    none = F.array().cast("array<string>")
    registered = record.select("affiliation", "ror", F.col("domains").alias("registry_domains")).unionByName(followed.select("affiliation", "ror", F.col("domains").alias("registry_domains")))
    out = own.join(found, "affiliation", "left").join(members, "affiliation", "left").join(registered, "affiliation", "left").join(websites, "affiliation", "left")
    names = F.filter(F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("names", none))), lambda n: n != F.col("affiliation"))
    return out.select("affiliation", names.alias("names"), "ror", F.coalesce("websites", F.array().cast("array<struct<pos:int,url:string,source:string>>")).alias("websites"), F.coalesce("registry_domains", none).alias("registry_domains"))


def expand_and_learn(affiliations: DataFrame, companies: DataFrame, entities: DataFrame, registry: DataFrame, institutions: DataFrame, groups: DataFrame, aliases: Aliases, most: int = 20) -> tuple[DataFrame, Aliases]:
    """expand(), with the names it confirms as alias groups, again for affiliations that such a group now says more of, until no more are found. Also the aliases as they are in the end. aliases: those of groups alone."""
    own = affiliations.select("affiliation").where("affiliation != ''").distinct()
    expanded = settle(expand(own, companies, entities, registry, institutions, aliases, most))
    while True:
        learnt = expanded.where(F.size("names") > 0).select(F.concat(F.lit("a:"), "affiliation").alias("group_id"), F.explode(F.concat(F.array("affiliation"), "names")).alias("name"))
        more = alias_table(groups.select(F.col("group_id").cast("string").alias("group_id"), "name").unionByName(learnt))
        open_ = expanded.where("ror is null").select("affiliation")
        before, after = canonical(open_, "affiliation", aliases), canonical(open_, "affiliation", more).withColumnRenamed("canonical", "now")
        moved = settle(before.join(after, "affiliation").where("canonical != now").select("affiliation"))
        aliases = more
        again = expand(moved, companies, entities, registry, institutions, aliases, most) if moved.limit(1).count() else None
        if again is None:
            return expanded, aliases
        again = settle(again)
        gained = again.where("ror is not null").limit(1).count()
        expanded = settle(expanded.join(moved, "affiliation", "left_anti").unionByName(again))
        if not gained:
            return expanded, aliases


def official_domains(expanded: DataFrame) -> DataFrame:
    """affiliation, domain, sources (in order, each once): the hosts of its websites and the registry's domains, the registry named first."""
    listed = expanded.select("affiliation", F.posexplode("registry_domains").alias("pos", "domain")).select("affiliation", "domain", F.struct(F.lit(-1).alias("pos"), F.lit("registry").alias("source")).alias("by"))
    hosts = expanded.select("affiliation", F.explode("websites").alias("w")).select("affiliation", host_of(F.col("w.url")).alias("domain"), F.struct("w.pos", "w.source").alias("by"))
    rows = listed.unionByName(hosts).where("domain != ''").groupBy("affiliation", "domain").agg(F.array_sort(F.collect_set("by")).alias("by"))
    return rows.select("affiliation", "domain", F.array_distinct(F.transform("by", lambda b: b["source"])).alias("sources"))


def employer_domains(employments: DataFrame, registry: DataFrame) -> DataFrame:
    """(person_id, org_id, id_source, current) x registry -> person_id, domain, source: the domains of employers that a record names by registry id."""
    named = employments.where((F.upper("id_source") == "ROR") & (F.col("org_id") != "")).select("person_id", F.col("org_id").alias("ror"), "current").groupBy("person_id", "ror").agg(F.max("current").alias("current"))
    return named.join(registry.select("ror", F.explode("domains").alias("domain")), "ror").select("person_id", "domain", F.lit("employment").alias("source")).distinct()
