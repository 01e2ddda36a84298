"""Flatteners of snapshot records: organisations, researchers, works, company lists, preprints, response logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.orgs import org_key
from ..functions.text import HEAD, expand_braces, extract_emails

# Headers by which a people file names its columns.
HEADERS = {"name": ("전문가", "이름", "성명", "name", "Name"), "affiliation": ("소속", "기관", "affiliation", "Affiliation", "org"), "field": ("기술분야", "분야", "field", "Field")}
# The most people in one request.
MAX_PEOPLE = 50


def read_people(spark: SparkSession, path: str, default_field: str = "") -> DataFrame:
    """People from CSV files with a header, quoted line breaks and a byte order mark or not: known headers, else the first two columns; rows without name or affiliation go.

    Of several known headers of one kind the first in the file counts; of columns with one header the last. Headers are read from the first
    file's first row alone; all files of a path have to have the same ones.
    """
    csv = spark.read.option("multiLine", True).option("encoding", "UTF-8").option("escape", '"')
    first = csv.csv(path).limit(1).first()  # one row
    headers = [(c or "").lstrip("\ufeff").strip() for c in first] if first else []
    if not headers:
        return spark.createDataFrame([], "name string, affiliation string, field string")
    plain = [f"c{k}" for k in range(len(headers))]
    rows = csv.option("header", True).option("enforceSchema", True).schema(", ".join(f"{c} string" for c in plain)).csv(path)
    return _chosen(rows, plain, headers, default_field)


def people_of(raw: DataFrame, default_field: str = "") -> DataFrame:
    return _chosen(raw, raw.columns, [c.lstrip("\ufeff") for c in raw.columns], default_field)


def _chosen(raw: DataFrame, columns: list[str], headers: list[str], default_field: str) -> DataFrame:
    last = {h: c for c, h in zip(columns, headers, strict=True)}

    def pick(kind: str, nth: int | None) -> Column:
        found = next((h for h in headers if h in HEADERS[kind]), headers[nth] if nth is not None and nth < len(headers) else None)
        return F.btrim(F.col(f"`{last[found]}`")) if found is not None else F.lit("")

    out = raw.select(pick("name", 0).alias("name"), pick("affiliation", 1).alias("affiliation"), pick("field", None).alias("field"))
    return out.withColumn("field", F.coalesce(F.nullif("field", F.lit("")), F.lit(default_field))).where("name != '' and affiliation != ''")


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Companies of XML lists, an element `list` each: corp_code, corp_name, stock_code, trimmed; those without code or name go."""
    fields = ("corp_code", "corp_name", "stock_code")
    rows = spark.read.format("xml").option("rowTag", "list").schema(", ".join(f"{c} string" for c in fields)).load(path)
    return rows.select(*[F.btrim(F.coalesce(c, F.lit(""))).alias(c) for c in fields]).where("corp_code != '' and corp_name != ''")


def validate_people(people: DataFrame, most: int = MAX_PEOPLE) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with code): trimmed, name and affiliation given, variants without blanks; more than `most` raises."""
    clean = people.withColumns({c: F.btrim(F.coalesce(c, F.lit(""))) for c in ("name", "affiliation", "field")})
    if "name_variants" in people.columns:
        clean = clean.withColumn("name_variants", F.filter(F.transform(F.coalesce("name_variants", F.array().cast("array<string>")), F.btrim), lambda v: v != ""))
    if not 0 < people.limit(most + 1).count() <= most:
        raise ValueError(f"a request holds 1 to {most} people")
    code = reject_code(F.col("name"), F.col("affiliation"))
    return clean.where(code == ""), clean.where(code != "").withColumn("code", code)


def reject_code(name: Column, affiliation: Column) -> Column:
    return F.when(name == "", "name missing").when(affiliation == "", "affiliation missing").otherwise("")


def summarize_orgs(raw: DataFrame) -> DataFrame:
    """Registry organisations (id, names array<struct value, types>, links array<struct type, value>, domains) by display name, names, website, domains."""
    names = F.filter("names", lambda n: n["value"].isNotNull() & (n["value"] != ""))
    shown = F.filter(names, lambda n: F.array_contains(n["types"], "ror_display"))
    sites = F.filter("links", lambda k: k["type"] == "website")
    return raw.select(
        F.col("id").alias("ror"),
        F.coalesce(F.get(shown, F.lit(0))["value"], F.get(names, F.lit(0))["value"]).alias("display_name"),
        F.transform(names, lambda n: n["value"]).alias("names"),
        F.get(sites, F.lit(0))["value"].alias("website"),
        F.transform("domains", F.lower).alias("domains"),
    )


def record_emails(records: DataFrame) -> DataFrame:
    """(record_id, emails array<string>, biography) -> record_id, email, origin: the record's own, then those of the biography not among them."""
    own = F.transform("emails", lambda e: F.struct(F.lower(e).alias("email"), F.lit("record").alias("origin")))
    rest = F.array_except(extract_emails(F.coalesce("biography", F.lit(""))), F.transform("emails", F.lower))
    return records.select("record_id", F.posexplode(F.concat(own, F.transform(rest, lambda e: F.struct(e.alias("email"), F.lit("biography").alias("origin"))))).alias("pos", "x")).select("record_id", "pos", "x.email", "x.origin")


def record_urls(records: DataFrame) -> DataFrame:
    """(record_id, urls array<struct name, value>) -> record_id, pos, url: those that are not blank."""
    kept = F.filter(F.transform("urls", lambda u: u["value"]), lambda u: u.isNotNull() & (u != ""))
    return records.select("record_id", F.posexplode(kept).alias("pos", "url"))


def record_employments(records: DataFrame) -> DataFrame:
    """(record_id, groups array<struct summaries array<struct name, org_id, id_source, end_date>>) -> record_id, pos, name, org_id, id_source, current: the first summary of each group; current without an end."""
    firsts = F.transform("groups", lambda g: F.get(g["summaries"], F.lit(0)))
    rows = records.select("record_id", F.posexplode(firsts).alias("pos", "s"))
    blank = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit("")).alias(c)
    return rows.select("record_id", "pos", blank("name"), blank("org_id"), blank("id_source"), F.col("s.end_date").isNull().alias("current"))


def record_dois(records: DataFrame, most: int = 15) -> DataFrame:
    """(record_id, ids array<struct kind, value>) -> record_id, pos, doi: lower case, without the resolver's prefix, each once, the first ones."""
    wanted = F.filter("ids", lambda x: (F.lower(x["kind"]) == "doi") & (x["value"] != ""))
    plain = F.array_distinct(F.transform(wanted, lambda x: F.replace(F.lower(x["value"]), F.lit("https://doi.org/"), F.lit(""))))
    return records.select("record_id", F.posexplode(F.slice(plain, 1, most)).alias("pos", "doi"))


def flatten_bibliography(raw: DataFrame) -> DataFrame:
    """(doi, results array<struct pmid, authors array<struct name, affiliations array<string>>>) -> doi, pos, author, emails, affiliation, url.

    The first result of a DOI counts; authors without an address in any affiliation go.
    """
    top = raw.select("doi", F.get("results", F.lit(0)).alias("t"))
    rows = top.select("doi", F.nullif("t.pmid", F.lit("")).alias("pmid"), F.posexplode("t.authors").alias("pos", "a"))
    emails = F.flatten(F.transform("a.affiliations", lambda x: extract_emails(F.coalesce(x, F.lit("")))))
    first = F.substring(F.coalesce(F.get("a.affiliations", F.lit(0)), F.lit("")), 1, 160)
    url = F.coalesce(F.concat(F.lit("https://europepmc.org/abstract/MED/"), "pmid"), F.lit(""))
    return rows.select("doi", "pos", F.coalesce("a.name", F.lit("")).alias("author"), emails.alias("emails"), first.alias("affiliation"), url.alias("url")).where(F.size("emails") > 0)


def pdf_urls(best: Column, locations: Column) -> Column:
    """Distinct document addresses of a work, the best location's first; locations array<struct pdf_url, landing_page_url, is_oa>."""
    number = lambda k: F.regexp_extract(k["landing_page_url"], r"ieeexplore\.ieee\.org/document/(\d+)", 1)
    of = lambda k: F.coalesce(F.nullif(k["pdf_url"], F.lit("")), F.when(k["is_oa"] & (number(k) != ""), F.concat(F.lit("https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber="), number(k))))
    return F.array_distinct(F.filter(F.concat(F.array(best), F.transform(locations, of)), lambda u: u.isNotNull() & (u != "")))


def match_company(names: DataFrame, companies: DataFrame) -> DataFrame:
    """(affiliation) x (corp_code, corp_name, stock_code): the company of exactly that name; listed ones first, then the lowest code."""
    listed = companies.where("trim(corp_code) != '' and trim(corp_name) != ''").withColumn("k", org_key(F.col("corp_name")))
    pairs = names.withColumn("k", org_key(F.col("affiliation"))).where("k != ''").join(listed, "k")
    place = W.partitionBy("affiliation").orderBy(F.coalesce(F.trim("stock_code"), F.lit("")) == "", "corp_code")
    return pairs.withColumn("r", F.row_number().over(place)).where("r = 1").drop("r", "k")


def latest_preprint(raw: DataFrame) -> DataFrame:
    """(doi, server_rank, position, version, has_jats) -> doi, server_rank, version, path: the last version of each server, if it has a text, of the first server that has such a one."""
    newest = raw.where(F.col("doi").startswith("10.1101/")).groupBy("doi", "server_rank").agg(F.max(F.struct("position", "has_jats", "version")).alias("last"))
    first = newest.where("last.has_jats").groupBy("doi").agg(F.min(F.struct("server_rank", F.col("last.version").alias("version"))).alias("x"))
    return first.select("doi", "x.*").select("doi", "server_rank", "version", F.concat(F.lit("content/"), "doi", F.lit("v"), F.coalesce(F.col("version"), F.lit(1)).cast("string")).alias("path"))


#: Kinds of responses, by the first part of their key, of which a failure is not remembered, so that the next run tries again.
RETRIED = ("pdf", "oa-authors")


def is_kept(key: Column, json: Column, retried: tuple[str, ...] = RETRIED) -> Column:
    """Whether a response may be stored: any but a failure (null) of a kind that is tried again."""
    return json.isNotNull() | ~F.split_part(key, F.lit(":"), F.lit(1)).isin(*retried)


def latest_responses(log: DataFrame, ttl_seconds: int, now: Column | None = None, retried: tuple[str, ...] = RETRIED) -> DataFrame:
    """(key, json, at) -> the newest response of each key, if it is no older than the limit at `now`, or at the log's column of that name.

    A failure is a null response and counts as the newest one, but for the kinds that are tried again: theirs were never stored. Of responses of one time the
    larger text counts, a failure least.
    """
    stored = log.withColumn("now", F.col("now") if now is None else now).where(is_kept(F.col("key"), F.col("json"), retried))
    newest = stored.groupBy("key").agg(F.max(F.struct("at", "json")).alias("x"), F.max("now").alias("now"))
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("x.at").cast("timestamp"))  # parts of a second count
    return newest.where(age <= ttl_seconds * 1_000_000).select("key", "x.json", "x.at")


def document_text(pages: DataFrame, first: int = 3) -> DataFrame:
    """(doc_id, page_no from 1, text) -> doc_id, text: the first pages, a line each, blanks collapsed, groups {a, b}@host written out, cut to HEAD characters."""
    rows = pages.where(F.col("page_no") <= first).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    text = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), "[ \t]+", " ")
    return rows.select("doc_id", F.substring(expand_braces(text), 1, HEAD).alias("text"))
