"""The whole job: requested people and snapshot tables in, evidence and report tables out, for all people at once.

Snapshot tables (any but authors and registry may be missing):
  companies         corp_code, corp_name, stock_code, english_name, website: for Korean affiliations
  entities          affiliation, hit_rank, entity_id, label, description, matched; entity_sites: entity_id, pos, url
  registry          ror, display_name, names, website, domains; institutions: institution_id, display_name, names, homepage, ror
  groups            group_id, name: aliases of organisations beside those known from the start
  authors           author_id, display_name, alternatives, record_id, works_count, topics; author_affiliations: author_id, institution, current
  records           record_id, name, institution (a row each); record_emails, record_urls, record_employments, record_dois as records flattens them
  works             author_id, work_id, doi, year, title, topics; locations: work_id, pos, url
  pdf_lists         doi, list ('a', 'b' or 'c'), urls: where else to look for a work without a location, list after list
  bibliography      doi, author, email; articles: doi, source ('article' or 'preprint'), xml
  documents         url, status, content_type, kind, text; pages: url, status, content_type, html

Tables that several later steps read are written to the shared folder, so that no step plans or runs all those before it again.

An address is reported only with the place where it was printed and the reason why it is this person's; none is composed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import field_terms
from ..functions.orgs import host_of
from ..functions.text import is_page, page_head
from ..operators import affiliations as A
from ..operators import evidence as E
from ..operators import people as P
from ..operators import works as K
from ..operators.aliases import alias_table
from ..operators.matching import match_names, match_orgs
from ..operators.store import settle
from ..sources.jats import author_emails, parse_jats
from ..sources.records import match_company
from . import report

SCHEMAS = {
    "companies": "corp_code string, corp_name string, stock_code string, english_name string, website string",
    "entities": "affiliation string, hit_rank int, entity_id string, label string, description string, matched string",
    "entity_sites": "entity_id string, pos int, url string",
    "registry": "ror string, display_name string, names array<string>, website string, domains array<string>",
    "institutions": "institution_id string, display_name string, names array<string>, homepage string, ror string",
    "groups": "group_id long, name string",
    "authors": "author_id string, display_name string, alternatives array<string>, record_id string, works_count long, topics array<string>",
    "author_affiliations": "author_id string, institution string, current boolean",
    "records": "record_id string, name string, institution string",
    "record_emails": "record_id string, pos int, email string, origin string",
    "record_urls": "record_id string, pos int, url string",
    "record_employments": "record_id string, pos int, name string, org_id string, id_source string, current boolean",
    "record_dois": "record_id string, pos int, doi string",
    "works": "author_id string, work_id string, doi string, year int, title string, topics array<string>",
    "locations": "work_id string, pos int, url string",
    "pdf_lists": "doi string, list string, urls array<string>",
    "bibliography": "doi string, author string, email string",
    "articles": "doi string, source string, xml string",
    "documents": "url string, status int, content_type string, kind string, text string",
    "pages": "url string, status int, content_type string, html string",
}
#: Printed forms of a name that authors are searched by.
PRINTED_FORMS = 4
HITS = ("person_id", "email", "source", "source_url", "document_id", "attribution", "strength", "self_stated", "snippet", "found")


def _hits(rows: DataFrame, found: int, source_url: Column, document: Column, attribution: Column, strength: int | Column = 0, self_stated: bool = False) -> DataFrame:
    """A route's findings as all routes give them."""
    quote = F.col("snippet") if "snippet" in rows.columns else F.lit("")
    strength = F.lit(strength) if isinstance(strength, int) else strength
    return rows.select("person_id", "email", "source", source_url.alias("source_url"), document.alias("document_id"), attribution.alias("attribution"), strength.cast("int").alias("strength"), F.lit(self_stated).alias("self_stated"), quote.alias("snippet"), F.lit(found).alias("found"))


def _linked(people: DataFrame, forms: DataFrame, near: DataFrame, t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(person_id, author_rank, author_id, display_name, record_id, unique, guessed) and all candidates: J3, W1 to W5. near (person_id, institution): what matches the person's affiliation."""
    authors = t["authors"].select("author_id", "display_name", "alternatives", "works_count", "topics")
    asked = forms.where(F.col("guessed") | (F.col("form_rank") < PRINTED_FORMS))
    cands = P.candidates(asked.select("person_id", "form_rank", "form"), authors, near, t["author_affiliations"])
    cands = cands.join(forms.select("person_id", "guessed").distinct(), "person_id")
    cands = P.stop_forms(cands.where("guessed")).unionByName(cands.where("not guessed"))
    cands = settle(P.on_topic(cands, people.select("person_id", field_terms(F.col("field")).alias("terms"))))
    unique = settle(P.decide(cands).where("unique").withColumn("rn", F.lit(1)))
    ranked = P.ordered(cands.join(unique.select("person_id"), "person_id", "left_anti"))
    printed = ranked.where("not guessed and rn <= 2").withColumn("unique", F.lit(False))
    guessed = P.dominant(P.like_first(ranked.where("guessed"))).withColumn("unique", F.lit(False))
    linked = unique.unionByName(printed.select(unique.columns)).unionByName(guessed.select(unique.columns))
    linked = linked.join(t["authors"].select("author_id", "record_id"), "author_id")
    return linked.select("person_id", F.col("rn").alias("author_rank"), "author_id", "display_name", "record_id", "unique", "guessed"), cands


def _records(forms: DataFrame, linked: DataFrame, fits: DataFrame, t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(person_id, record_id) used and held: the unique author's record, else what a search finds, less those held for other employers: J4, J5. fits (person_id, institution): what matches the person's affiliation."""
    known = linked.where("unique and record_id is not null and record_id != ''").select("person_id", "record_id")
    learnt = linked.where("guessed and not unique").select("person_id", F.lit(0).alias("form_rank"), F.col("display_name").alias("form")).distinct()
    asked = forms.where("not guessed and form_rank < 2").select("person_id", "form_rank", "form").unionByName(learnt).join(known, "person_id", "left_anti")
    same = match_names(asked.select("form"), t["records"].select("name"), "form", "name")
    found = asked.join(same, "form").join(t["records"], "name").join(fits.withColumn("fit", F.lit(True)), ["person_id", "institution"], "left")
    found = found.groupBy("person_id", "form_rank", "record_id").agg(F.max(F.coalesce(F.col("institution") != "", F.lit(False))).alias("has_institution"), F.max(F.coalesce("fit", F.lit(False))).alias("fits"))
    records = settle(known.unionByName(P.search_records(found)).distinct())
    jobs = records.join(t["record_employments"].where("name != ''").select("record_id", F.col("name").alias("institution")), "record_id")
    kept = settle(P.hold_records(records, jobs, fits))
    return kept, records.join(kept, ["person_id", "record_id"], "left_anti")


def _works(people: DataFrame, linked: DataFrame, records: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(person_id, key, work_id, doi, place): works of linked authors, then those of the record, topic first: J7, W6. doi is plain and in lower case, empty where there is none."""
    works = K.works_of(linked.select("person_id", "author_rank", "author_id"), t["works"])
    about = F.concat_ws(" ", "title", F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " "))
    works = works.select("person_id", "key", "work_id", F.when(F.col("doi") != "", F.col("key")).otherwise("").alias("doi"), about.alias("about"), "pos")
    stated = records.join(t["record_dois"], "record_id").select("person_id", F.col("doi").alias("key"), F.lit("").alias("work_id"), "doi", F.lit("").alias("about"), (F.col("pos") + 1_000_000).alias("pos"))
    both = works.unionByName(stated).withColumn("r", F.row_number().over(W.partitionBy("person_id", "key").orderBy("pos"))).where("r = 1").drop("r")
    terms = people.select("person_id", field_terms(F.col("field")).alias("terms"))
    return K.topic_first(both.join(terms, "person_id"), text="about").select("person_id", "key", "work_id", "doi", "place")


def _fallbacks(works: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(doi, urls) for the works that have a DOI: S10."""
    one = lambda k: t["pdf_lists"].where(F.col("list") == k)
    return K.fallback_pdfs(works.where("doi != ''").select("doi").distinct(), one("a").select("doi", "urls"), one("b").select("doi", F.get("urls", F.lit(0)).alias("url")), one("c").select("doi", "urls"))


def resolve(people: DataFrame, snapshot: dict[str, DataFrame], surnames: DataFrame | None = None) -> dict[str, DataFrame]:
    """people (person_id, name, affiliation, field, name_variants) -> evidence, names, domains, identifiers, statuses, log, and the report tables. surnames (surname, known) replaces the known spellings."""
    spark = people.sparkSession
    t = {k: snapshot[k] if k in snapshot else spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
    variants = F.col("name_variants") if "name_variants" in people.columns else F.array().cast("array<string>")
    names = people.select("person_id", F.filter(F.array_distinct(F.concat(F.array("name"), F.coalesce(variants, F.array().cast("array<string>")))), lambda n: n != "").alias("names"))
    forms = settle(P.name_forms(names, surnames))

    affils = people.select("affiliation").distinct()
    company = settle(match_company(affils, t["companies"]).select("affiliation", "corp_name", "english_name", "website"))
    aliases = alias_table(t["groups"])
    entity = settle(A.pick_entity(t["entities"].join(affils, "affiliation", "left_semi"), t["entity_sites"], aliases))
    expanded, aliases = A.expand_and_learn(affils, company, entity, t["registry"], t["institutions"], t["groups"], aliases)
    wide = people.select("person_id", "affiliation").join(expanded, "affiliation")
    aff_names = settle(wide.select("person_id", F.explode(F.concat(F.array("affiliation"), "names")).alias("affil_name")))

    # all organisations that authors and records name meet all names of all affiliations once
    named = [t["author_affiliations"].select("institution"), t["records"].select("institution"), t["record_employments"].select(F.col("name").alias("institution"))]
    pairs = match_orgs(aff_names.select("affil_name"), reduce(DataFrame.unionByName, named).where("institution != ''"), "affil_name", "institution", aliases)
    near = settle(aff_names.join(pairs, "affil_name").select("person_id", "institution").distinct())

    linked, cands = _linked(people, forms, near, t)
    linked = settle(linked)
    names = settle(P.learnt_names(names, linked.where("guessed")))
    each_name = names.select("person_id", F.explode("names").alias("name"))
    records, held = _records(forms, linked, near, t)
    jobs = records.join(t["record_employments"], "record_id")
    official = A.official_domains(expanded).join(people.select("person_id", "affiliation"), "affiliation").select("person_id", "domain", "sources", F.lit(0).alias("by"))
    employer = A.employer_domains(jobs, t["registry"]).select("person_id", "domain", F.array("source").alias("sources"), F.lit(1).alias("by"))
    all_domains = settle(official.unionByName(employer))
    domains = all_domains.select("person_id", "domain").distinct()

    works = settle(_works(people, linked, records, t))
    first = settle(K.first_with_doi(works).select("person_id", "key"))
    doi = F.concat(F.lit("https://doi.org/"), F.col("key"))
    own = records.join(t["record_emails"], "record_id").withColumn("source", F.lit("record"))
    routes = [_hits(own, 0, F.col("record_id"), F.col("record_id"), F.concat(F.lit("own record"), F.when(F.col("origin") == "biography", " (biography)").otherwise("")), self_stated=True)]
    routes.append(_hits(E.by_author(first, t["bibliography"].select(F.col("doi").alias("key"), "author", "email"), each_name, "bibliography"), 1, doi, F.col("key"), F.lit("author of the record")))
    wanted = t["articles"].withColumn("key", F.col("doi")).join(first.select("key").distinct(), "key", "left_semi").where("source != 'preprint' or startswith(key, '10.1101/')")
    split = lambda n: F.split_part("doc_id", F.lit(" "), F.lit(n))
    parsed = settle(author_emails(settle(parse_jats(wanted.select(F.concat_ws(" ", "source", "key").alias("doc_id"), "xml")))).select(split(1).alias("kind"), split(2).alias("key"), "name", "corresp", "emails"))
    for nth, kind in enumerate(("article", "preprint")):
        routes.append(_hits(E.by_article(first, parsed.where(F.col("kind") == kind), each_name, kind), 2 + nth, doi, F.col("key"), F.concat(F.lit("author tag '"), "author", F.lit("'"), F.when(F.col("corresp"), " (corresponding)").otherwise(""))))
    early = settle(reduce(DataFrame.unionByName, routes))
    verified = E.verify(early, domains).where("verified").groupBy("person_id").agg(F.count(F.lit(1)).alias("earlier"))

    asked = settle(K.addresses_to_read(works, t["locations"], _fallbacks(works, t)).select("person_id", "place", "key", "url"))
    places = asked.select("person_id", "url").where("url is not null").distinct()
    texts = E.by_full_text(places, t["documents"].where("status = 200"), names)
    texts = settle(_hits(texts.withColumn("key", F.lit("")), 4, F.col("url"), F.col("key"), F.when(F.col("by") == "account", "bears the name").otherwise("stands next to the name")))
    good = E.verify(texts, domains).where("verified").groupBy("person_id", F.col("source_url").alias("url")).agg(F.count(F.lit(1)).alias("verified"))
    known = t["documents"].groupBy("url").agg(F.max(F.col("status") == 200).alias("ok"), F.min("status").alias("status"), F.max(F.col("text").contains("@")).alias("at"))
    plan = asked.join(known, "url", "left").join(good, ["person_id", "url"], "left").join(verified, "person_id", "left")
    tried = settle(K.read_in_order(plan).join(known.select("url", "status"), "url", "left").join(asked.select("person_id", "place", "key"), ["person_id", "place"]))
    kept = tried.where("ok").groupBy("person_id", F.col("url").alias("source_url")).agg(F.min_by("key", "place").alias("document_id"))
    read = texts.drop("document_id").join(kept, ["person_id", "source_url"])

    urls = settle(records.join(t["record_urls"].where("pos < 3"), "record_id").select("person_id", "pos", "url"))
    shown = F.when(F.col("by") == "account", "bears the name").when(F.col("by") == "place", "stands next to the name").otherwise("on the person's own page")
    home = _hits(E.by_home_page(urls, t["pages"], names, domains), 5, F.col("url"), F.col("url"), shown, F.when(F.col("by") == "page", 2).otherwise(0))
    hits = E.once_per_source(E.union_routes(early, read.select(*HITS), home.select(*HITS)))

    checked = settle(E.verify(hits, domains))
    pages = t["pages"].where(is_page(F.col("status"), F.col("content_type"))).where(F.col("url").rlike("(?i)^https?://[^/]+/?$")).select(host_of(F.col("url")).alias("host"), F.lower(page_head(F.col("html"))).alias("text"))
    ordered_names = wide.select("person_id", F.posexplode(F.concat(F.array("affiliation"), "names")).alias("name_rank", "name"))
    confirmed = settle(E.confirm_by_page(checked, pages, ordered_names).groupBy("person_id", "email").agg(F.min("name").alias("page_name")))
    checked = checked.join(confirmed, ["person_id", "email"], "left").withColumn("now", (F.col("verification") == "no domain") & F.col("page_name").isNotNull())
    checked = checked.withColumn("verified", F.col("verified") | F.col("now")).withColumn("verification", F.when(F.col("now"), "domain's own page").otherwise(F.col("verification")))
    evidence = settle(E.ranked(checked.drop("now", "page_name")))
    new = confirmed.select("person_id", F.substring_index("email", "@", -1).alias("domain"), F.array(F.lit("own page")).alias("sources"), F.lit(2).alias("by")).distinct()
    merged = all_domains.unionByName(new).groupBy("person_id", "domain").agg(F.array_sort(F.collect_list(F.struct("by", "sources"))).alias("x"))
    domain_rows = settle(merged.select("person_id", "domain", F.array_distinct(F.flatten(F.transform("x", lambda y: y["sources"]))).alias("sources"), F.col("x")[0]["by"].alias("place")))

    ids = records.select("person_id", F.lit("record").alias("kind"), F.col("record_id").alias("url")).unionByName(linked.where("unique").select("person_id", F.lit("author").alias("kind"), F.col("author_id").alias("url"))).unionByName(wide.where("ror is not null").select("person_id", F.lit("registry").alias("kind"), F.col("ror").alias("url")))
    sites = wide.select("person_id", F.explode("websites").alias("w")).select("person_id", "w.pos", "w.url", "w.source").unionByName(urls.select("person_id", (F.col("pos") + 10).alias("pos"), "url", F.lit("researcher record").alias("source")))
    status = settle(report.statuses(people, evidence))
    listed = lambda df, c, text: df.groupBy("person_id").agg(F.array_sort(F.collect_set(c)).alias("l")).select("person_id", text.alias("text"))
    joined = lambda n: F.array_join(F.slice("l", 1, n), ", ")
    counted = lambda df, *parts: df.groupBy("person_id").agg(F.concat(*parts).alias("text"))
    amount = lambda when: F.count_if(when).cast("string")
    text = F.lit
    reason = F.when(F.col("status").isNull(), "no answer").otherwise(F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    failed = report.failure_reasons(tried.where("not ok").select("person_id", "place", reason.alias("reason")))
    failed = failed.groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "reason", "n"))), lambda x: F.concat(x["reason"], F.lit(" x"), x["n"].cast("string"))), ", ").alias("failed"))
    tries = tried.join(known.select("url", "at"), "url", "left").groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok") & ~F.coalesce("at", F.lit(False))).alias("bare")).join(failed, "person_id", "left")
    tries = tries.select("person_id", F.concat(F.col("n").cast("string"), text(" tried"), F.coalesce(F.concat(text(", failed: "), "failed"), text("")), F.when(F.col("bare") > 0, F.concat(text(", read without an address: "), F.col("bare").cast("string"))).otherwise("")).alias("text"))
    bibliographic = first.join(t["bibliography"].select(F.col("doi").alias("key")).distinct(), "key")
    form_list = forms.groupBy("person_id", "guessed").agg(F.array_sort(F.collect_list(F.struct("form_rank", "form"))).alias("l"))
    without = lambda df: people.select("person_id").join(df.select("person_id").distinct(), "person_id", "left_anti")
    log = report.stage_log(
        [
            ("names", form_list.select("person_id", F.concat(F.when(F.col("guessed"), "guessed ").otherwise("printed "), F.array_join(F.transform(F.slice("l", 1, 4), lambda x: x["form"]), ", ")).alias("text")).unionByName(without(forms).select("person_id", text("no Latin form").alias("text")))),
            ("affiliation", wide.where(F.size("names") > 0).select("person_id", F.array_join(F.slice("names", 1, 5), ", ").alias("text"))),
            ("domains", listed(official, "domain", joined(4)).unionByName(without(official).select("person_id", text("no domain known").alias("text")))),
            ("authors", listed(cands, "display_name", F.concat(F.size("l").cast("string"), F.lit(" of the name and affiliation: "), joined(3))).unionByName(without(cands).select("person_id", text("none of the name and affiliation").alias("text")))),
            ("record held", listed(held, "record_id", F.concat(joined(2), text(" (other employers)")))),
            ("record", listed(records, "record_id", joined(2))),
            ("works", counted(works, F.count(F.lit(1)).cast("string"), text(", with DOI "), amount(F.col("doi") != ""))),
            ("bibliography", counted(bibliographic, F.count(F.lit(1)).cast("string"), text(" records"))),
            ("documents", tries),
            ("result", status.select("person_id", F.concat("n_addresses", F.lit(" addresses, "), "n_verified", F.lit(" verified")).alias("text"))),
        ]
    )
    log = settle(log)
    lists = settle(report.domain_lists(domain_rows))
    found = settle(report.with_lists(report.findings(people, evidence), report.id_lists(ids), lists, report.page_lists(sites)))
    return {
        "evidence": evidence,
        "names": names,
        "domains": domain_rows,
        "identifiers": ids,
        "linked": linked,
        "tried": tried,
        "statuses": status,
        "log": log,
        "summary": report.summary(found),
        "table": report.table_rows(found),
        "detail": report.detail_table(people, evidence),
        "cards": report.cards(found, wide.select("person_id", "names"), log),
        "lines": report.answer_lines(people, evidence, lists),
        "markdown": report.markdown_rows(people, evidence),
    }
