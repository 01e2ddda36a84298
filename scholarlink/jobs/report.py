"""Reports on resolved people: counts, status, summary, detail and log rows, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.orgs import host_of

NOTICE = "For individual scholarly enquiries only; no bulk advertising. Addresses are those that people published themselves."
# How the seven routes are shown.
LABELS = {"record": "researcher record", "bibliography": "bibliographic record", "article": "article", "preprint": "preprint", "pdf": "open document (PDF)", "html": "open document (page)", "homepage": "home page"}


FINDING = ("rn", "email", "verified", "verification", "source", "source_url", "document_id", "attribution", "snippet")


def _label_of(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), source), source)


def _status(n_addresses: Column, n_verified: Column) -> Column:
    return F.when(n_verified > 0, "verified").when(n_addresses > 0, "unverified").otherwise("not found")


def _nothing(value: Column) -> Column:
    """null in place of an empty list or text."""
    return F.when(F.length(value) > 0, value)


def _none_left(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def _link(text: Column, url: Column) -> Column:
    return F.struct(text.alias("text"), url.alias("url"))


def statuses(people: DataFrame, hits: DataFrame) -> DataFrame:
    """person_id, n_addresses, n_verified, status for every requested person, with evidence or without."""
    found = hits.groupBy("person_id").agg(F.size(F.collect_set("email")).cast("long").alias("n_addresses"), F.size(F.collect_set(F.when(F.col("verified"), F.col("email")))).cast("long").alias("n_verified"))
    out = people.select("person_id").join(found, "person_id", "left").fillna(0, ["n_addresses", "n_verified"])
    return out.withColumn("status", _status(F.col("n_addresses"), F.col("n_verified")))


def counts(status: DataFrame) -> DataFrame:
    """One row: people, those with any address, those with a verified one."""
    return status.agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("n_addresses") > 0).alias("with_address"), F.count_if(F.col("n_verified") > 0).alias("with_verified"))


def findings(people: DataFrame, ranked: DataFrame) -> DataFrame:
    """people with rank and all that was found for each person in order, found (empty where nothing was), by one aggregation of ranked hits; columns that the hits lack are null."""
    one = F.struct(*[F.col(c) if c in ranked.columns else F.lit(None).cast("string").alias(c) for c in FINDING])
    listed = ranked.groupBy("person_id").agg(F.array_sort(F.collect_list(one)).alias("found"))  # a person's own findings
    rank = F.col("rank") if "rank" in people.columns else F.col("person_id")
    kind = listed.schema["found"].dataType
    own = people.select("person_id", rank.alias("rank"), "name", "affiliation", _nothing(F.col("field")).alias("field"))
    return own.join(listed, "person_id", "left").withColumn("found", F.coalesce("found", F.array().cast(kind)))


def _emails(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: x["email"]))


def _first(found: Column, field: str) -> Column:
    return F.get(found, F.lit(0))[field]


def _status_of(found: Column) -> Column:
    return _status(F.size(found), F.size(F.filter(found, lambda x: x["verified"])))


def email_links(found: Column) -> Column:
    """Each address once, where it first stands, with a link; unverified ones say so."""
    first = lambda e: F.get(F.filter(found, lambda x: x["email"] == e), F.lit(0))
    return F.transform(_emails(found), lambda e: _link(F.when(first(e)["verified"], e).otherwise(F.concat(e, F.lit(" (unverified)"))), F.concat(F.lit("mailto:"), e)))


def source_links(found: Column) -> Column:
    """Each place of publication once, by route and address, in order."""
    places = F.array_distinct(F.transform(F.filter(found, lambda x: x["source_url"] != ""), lambda x: F.struct(x["source"].alias("source"), x["source_url"].alias("url"))))
    return F.transform(places, lambda p: _link(_label_of(p["source"]), p["url"]))


def id_lists(identifiers: DataFrame) -> DataFrame:
    """(person_id, kind, url) -> person_id, ids: a link for the researcher record, the author and the registry's organisation, in that order; record_id and author_id by themselves."""
    rank = F.when(F.col("kind") == "record", 0).when(F.col("kind") == "author", 1).otherwise(2)
    once = identifiers.groupBy("person_id", rank.alias("nth"), "kind").agg(F.min("url").alias("url"))
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("url"))).alias(f"{kind}_id")
    listed = once.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("nth", "kind", "url"))).alias("l"), of("record"), of("author"))
    return listed.select("person_id", F.transform("l", lambda x: _link(F.concat_ws(" ", x["kind"], F.substring_index(x["url"], "/", -1)), x["url"])).alias("ids"), "record_id", "author_id")


def page_lists(homepages: DataFrame) -> DataFrame:
    """(person_id, pos, url, source) -> person_id, pages: the home pages in order."""
    return homepages.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "source"))).alias("pages"))


def page_links(pages: Column, most: int) -> Column:
    """Of the first `most` pages each address once, labelled by its host and where it was last found."""
    some = F.slice(pages, 1, most)
    last = lambda u: F.element_at(F.filter(some, lambda x: x["url"] == u), -1)["source"]
    return F.transform(F.array_distinct(F.transform(some, lambda x: x["url"])), lambda u: _link(F.concat(host_of(u), F.lit(" ("), last(u), F.lit(")")), u))


def with_lists(found: DataFrame, ids: DataFrame | None = None, domains: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """findings() with what id_lists(), domain_lists() and page_lists() have of each person; null where there is nothing."""
    spark = found.sparkSession
    empty = {
        "ids": "person_id long, ids array<struct<text:string,url:string>>, record_id string, author_id string",
        "domains": "person_id long, domains string, domains_by string, domain_names array<string>",
        "pages": "person_id long, pages array<struct<pos:int,url:string,source:string>>",
    }
    for name, df in (("ids", ids), ("domains", domains), ("pages", pages)):
        found = found.join(df if df is not None else spark.createDataFrame([], empty[name]), "person_id", "left")
    return found


def table_rows(found: DataFrame) -> DataFrame:
    """The table of an answer, a row a person: rank, name, affil, field, email, status, source, attribution of the best finding, ids, domains, homepage; null where there is nothing."""
    f = F.col("found")
    return found.select(
        "person_id", "rank", "name", F.col("affiliation").alias("affil"), "field", _none_left(email_links(f)).alias("email"), _status_of(f).alias("status"), _none_left(source_links(f)).alias("source"),
        _first(f, "attribution").alias("attribution"), "ids", _nothing(F.col("domains")).alias("domains"), _none_left(page_links(F.col("pages"), 3)).alias("homepage"),
    )


def cards(found: DataFrame, names: DataFrame, log: DataFrame) -> DataFrame:
    """The cards of an answer, a row a person with all that is known. names (person_id, names) of the affiliation, log (person_id, step, text)."""
    f = F.col("found")
    said = lambda c: _nothing(F.array_join(F.array_distinct(F.transform(f, lambda x: F.concat(x["email"], F.lit(": "), x[c]))), "; "))
    steps = log.groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("log"))
    rows = found.join(names.select("person_id", "names"), "person_id", "left").join(steps, "person_id", "left")
    return rows.select(
        "person_id", "name", F.col("affiliation").alias("affil"), "field", _none_left(email_links(f)).alias("emails"), said("verification").alias("verification"), said("attribution").alias("attribution"),
        _none_left(source_links(f)).alias("source"), F.get(F.filter(f, lambda x: x["snippet"] != ""), F.lit(0))["snippet"].alias("snippet"), "ids", _nothing(F.array_join(F.slice("names", 1, 6), ", ")).alias("affil_names"),
        _nothing(F.col("domains_by")).alias("domains"), _none_left(page_links(F.col("pages"), 4)).alias("homepage"), "log",
    )


def summary(found: DataFrame) -> DataFrame:
    """The flat sheet, a row a person: the best finding with its source and reason, ids, domains, the first home page and all other addresses; null where there is nothing."""
    f = F.col("found")
    best = _first(f, "email")
    return found.select(
        "person_id", "rank", "name", "affiliation", "field", best.alias("best"), _status_of(f).alias("status"), _first(f, "verification").alias("verification"), _label_of(_first(f, "source")).alias("route"), _first(f, "source_url").alias("source_url"),
        _first(f, "attribution").alias("attribution"), "record_id", "author_id", _nothing(F.col("domains")).alias("domains"), F.get("pages", F.lit(0))["url"].alias("homepage"), _nothing(F.array_join(F.array_except(_emails(f), F.array(best)), "; ")).alias("others"),
    )


def detail(ranked: DataFrame) -> DataFrame:
    """A row a finding, in order, with the route's label; unverified addresses say so."""
    shown = F.when(F.col("verified"), F.col("email")).otherwise(F.concat("email", F.lit(" (unverified)")))
    return ranked.select("person_id", "rn", shown.alias("address"), F.concat(F.lit("mailto:"), "email").alias("link"), _label_of(F.col("source")).alias("route"), "verification")


def domain_lists(domains: DataFrame) -> DataFrame:
    """(person_id, place, domain, sources) -> person_id, domains ("a, b"), domains_by ("a (x·y), b (z)")."""
    listed = domains.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("place", "domain", "sources"))).alias("d"))
    named = F.transform("d", lambda x: F.concat(x["domain"], F.lit(" ("), F.array_join(x["sources"], "·"), F.lit(")")))
    return listed.select("person_id", F.array_join(F.transform("d", lambda x: x["domain"]), ", ").alias("domains"), F.array_join(named, ", ").alias("domains_by"), F.transform("d", lambda x: x["domain"]).alias("domain_names"))


def answer_lines(people: DataFrame, ranked: DataFrame, domains: DataFrame) -> DataFrame:
    """person_id, line: the best address with how sure it is and whence, or that none was found and up to two official domains."""
    best = ranked.where("rn = 1").select("person_id", "email", "verified", "source")
    rows = people.select("person_id", "name", "affiliation").join(best, "person_id", "left").join(domains.select("person_id", "domain_names"), "person_id", "left")
    found = F.concat("email", F.lit(" ["), F.when(F.col("verified"), "verified").otherwise("unverified"), F.lit(" · "), _label_of(F.col("source")), F.lit("]"))
    none = F.concat(F.lit("no address in open sources"), F.coalesce(F.concat(F.lit(" · official domains "), F.array_join(F.slice("domain_names", 1, 2), ", ")), F.lit("")))
    return rows.select("person_id", F.concat(F.lit("- "), "name", F.lit(" ("), "affiliation", F.lit("): "), F.coalesce(found, none)).alias("line"))


def _at_most(rows: DataFrame, most: int) -> DataFrame:
    """rows, if there are no more than `most`; else it raises once they are read. No more than one row beyond that is ever gathered."""
    some = rows.limit(most + 1)
    full = some.agg((F.count(F.lit(1)) > most).alias("_full"))
    return some.crossJoin(F.broadcast(full)).where(F.when(F.col("_full"), F.raise_error(F.lit(f"a request holds 1 to {most} people")).cast("boolean")).otherwise(F.lit(True))).drop("_full")


def answer(status: DataFrame, lines: DataFrame, most: int = 50) -> DataFrame:
    """One row, text: the counts, then a line for each person in order. A request holds `most` people at most; more raise."""
    total = counts(status)
    listed = _at_most(lines, most).agg(F.array_sort(F.collect_list(F.struct("person_id", "line"))).alias("l"))
    head = F.concat(F.lit("Of "), "people", F.lit(" people an address was found for "), "with_address", F.lit(" (verified for "), "with_verified", F.lit(")."))
    return total.crossJoin(listed).select(F.array_join(F.concat(F.array(head), F.transform("l", lambda x: x["line"])), "\n").alias("text"))


def markdown_rows(people: DataFrame, ranked: DataFrame) -> DataFrame:
    """person_id, line: a table row of rank, name, affiliation, address, status, source and attribution; the rank is the request's, or its person_id."""
    best = ranked.where("rn = 1").select("person_id", "email", "verified", "source", "attribution")
    rows = people.select("person_id", "name", "affiliation", (F.col("rank") if "rank" in people.columns else F.col("person_id")).alias("rank"))
    status = F.when(F.col("email").isNull(), "-").when(F.col("verified"), "verified").otherwise("unverified")
    cells = ["rank", "name", "affiliation", F.coalesce("email", F.lit("-")), status, F.coalesce(_label_of(F.col("source")), F.lit("-")), F.coalesce("attribution", F.lit("-"))]
    return rows.join(best, "person_id", "left").select("person_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def stage_log(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """person_id, step, text: one line a person and stage, numbered from 1. stages: (name, (person_id, text)) in order; blank texts are left out."""
    rows = [df.select("person_id", F.lit(k).alias("at"), F.concat(F.lit(f"{name} · "), "text").alias("text")).where("text is not null") for k, (name, df) in enumerate(stages)]
    out = reduce(DataFrame.unionByName, rows)
    return out.select("person_id", F.row_number().over(W.partitionBy("person_id").orderBy("at")).alias("step"), "text")


def detail_table(people: DataFrame, ranked: DataFrame) -> DataFrame:
    """The flat table of findings: who, address, status, how verified, whence, document, attribution, quote of 200 characters at most."""
    label = _label_of(F.col("source"))
    rows = people.select("person_id", "name", "affiliation").join(ranked, "person_id")
    return rows.select("person_id", "rn", "name", "affiliation", "email", F.when(F.col("verified"), "verified").otherwise("unverified").alias("status"), "verification", label.alias("route"), "source_url", "document_id", "attribution", F.substring("snippet", 1, 200).alias("snippet"))


def failure_reasons(tries: DataFrame, top: int = 3) -> DataFrame:
    """(person_id, place, reason) -> the most frequent reasons of each person; ties go to the one seen first."""
    n = tries.groupBy("person_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    listed = n.groupBy("person_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "reason"))), 1, top).alias("r"))
    return listed.select("person_id", F.posexplode("r").alias("nth", "x")).select("person_id", (F.col("nth") + 1).alias("nth"), "x.reason", (-F.col("x.n")).alias("n"))


def responses(summary_rows: DataFrame) -> DataFrame:
    """One JSON document a person, with the notice."""
    return summary_rows.select("person_id", F.to_json(F.struct("name", "affiliation", "status", "best", "verification", "others", F.lit(NOTICE).alias("notice"))).alias("json"))


#: How the columns of the table and the cards are headed, in order.
TABLE_FIELDS = {"rank": "rank", "name": "researcher", "affil": "affiliation", "field": "field", "email": "addresses", "status": "verified", "source": "published in", "attribution": "why it is theirs", "ids": "identifiers", "domains": "official domains", "homepage": "pages of the affiliation"}
CARD_FIELDS = {"name": "researcher", "affil": "affiliation", "field": "field", "emails": "addresses", "verification": "verification", "attribution": "why it is theirs", "source": "published in", "snippet": "quote", "ids": "identifiers", "affil_names": "names of the affiliation", "domains": "official domains", "homepage": "pages", "log": "steps"}
NOTE = "verified: the address is on an official domain of the affiliation, or in the person's own record; unverified: as the document has it"


def nested(answer_: DataFrame, table: DataFrame, card_rows: DataFrame, caption: str = "Addresses found", most: int = 50) -> DataFrame:
    """One row, json: the answer, the table and the cards with type, caption, fields, order, links and highlights, and the notice. For one request, which holds `most` people at most."""
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    shown = lambda df, fields, name: _at_most(df, most).agg(F.array_sort(F.collect_list(F.struct("person_id", F.struct(*fields).alias("row")))).alias(name))
    both = answer_.crossJoin(shown(table, TABLE_FIELDS, "t")).crossJoin(shown(card_rows, CARD_FIELDS, "c"))

    def part(kind: str, caption: str, fields: dict[str, str], rows: str, **more: Column) -> Column:
        heads = F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]).alias("fields")
        own = [F.lit(caption).alias("caption"), heads, texts(fields).alias("order"), *[v.alias(k) for k, v in more.items()], F.transform(rows, lambda x: x["row"]).alias("rows")]
        return F.struct(F.lit(kind).alias("type"), F.array(F.struct(*own)).alias("data"))

    email_table = part("table", caption, TABLE_FIELDS, "t", link=texts(("email", "source", "ids", "homepage")), highlight=texts(("email", "status")), note=F.lit(NOTE))
    email_cards = part("card", "Details by researcher", CARD_FIELDS, "c", title=F.lit("name"), subtitle=F.lit("affil"), link=texts(("emails", "source", "ids", "homepage")), highlight=texts(("emails",)))
    notice = F.struct(F.lit("text").alias("type"), F.array(F.struct(F.lit("Terms of use").alias("caption"), F.lit(NOTICE).alias("content"))).alias("data"))
    said = F.struct(F.lit("answer").alias("type"), F.col("text").alias("data"))
    return both.select(F.to_json(F.struct(said.alias("answer"), email_table.alias("email_table"), email_cards.alias("email_cards"), notice.alias("notice")), {"ignoreNullFields": "false"}).alias("json"))


def write(tables: dict[str, DataFrame], path: str, run_date: str, kinds: tuple[str, ...] = ("parquet", "json", "csv")) -> None:
    """Each table under its name and format, by date of the run, and the notice beside them; nested columns of CSV files are JSON.

    A run replaces what an earlier run of the same date wrote when its own files are complete, and leaves all other dates alone. A table
    without rows leaves an empty date behind, not the rows of the run before.
    """
    spark = next(iter(tables.values())).sparkSession
    notice = spark.createDataFrame([(NOTICE,)], "notice string")
    for name, df in (tables | {"notice": notice}).items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        some = not df.isEmpty()
        for kind in kinds:
            writer = lambda rows: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(kind).options(**({"header": True, "escape": chr(34)} if kind == "csv" else {}))  # noqa: B023, E731
            rows, to = flat if kind == "csv" else df, f"{path}/{kind}/{name}"
            if some:
                writer(rows.withColumn("run_date", F.lit(run_date))).partitionBy("run_date").save(to)
            else:
                writer(rows).save(f"{to}/run_date={run_date}")
