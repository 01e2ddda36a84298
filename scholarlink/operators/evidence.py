"""Evidence for addresses: whose they are, whether their domain is official, which come first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import let, name_keys, name_tokens, same_person, with_nfkc
from ..functions.orgs import domain_matches, host_of
from ..functions.text import QUOTE, extract_emails, home_page_emails, is_department, is_personal_mail, page_head, snippet
from .proximity import WINDOW, attributed_by_proximity, follows_name, parts_around
from .store import spread

#: Routes by which evidence comes, in the order that decides between equal findings.
ROUTES = ("record", "bibliography", "article", "preprint", "pdf", "html", "homepage")


def attributed_by_account(local: Column, names: Column) -> Column:
    """Whether an account bears a person's name: a name part of four letters, or a surname with initials of the rest."""
    bare = F.regexp_replace(F.lower(local), r"[._\-]", "")
    by_token = F.exists(name_tokens(names), lambda t: (F.length(t) >= 4) & bare.contains(t))

    def by_initials(name: Column) -> Column:
        parts = F.filter(F.split(F.lower(name), r"[\s,.\-]+"), lambda p: p.rlike("^[a-z]+$"))

        def as_surname(s: Column) -> Column:
            initials = F.array_join(F.transform(F.filter(parts, lambda p: p != s), lambda p: F.left(p, F.lit(1))), "")
            at = F.instr(bare, s)
            rest = F.concat(F.substring(bare, F.lit(1), at - 1), F.substring(bare, at + F.length(s), F.length(bare)))
            fits = rest.startswith(initials) | rest.endswith(initials) | ((F.length(initials) >= 2) & rest.contains(initials))
            return (F.length(s) >= 3) & (at > 0) & (initials != "") & fits

        return (F.size(parts) >= 2) & F.exists(parts, as_surname)

    latin = F.filter(names, lambda n: n.isNotNull() & (n != "") & ~n.rlike(r"[^\x00-\x7F]"))
    return F.coalesce(by_token | F.exists(latin, by_initials), F.lit(False))


def union_routes(*routes: DataFrame) -> DataFrame:
    """All routes' findings (person_id, email, source, source_url, attribution_kind, self_stated)."""
    return reduce(DataFrame.unionByName, routes)


def own_domains(domains: DataFrame) -> DataFrame:
    """(person_id, domain) -> person_id, official: the few official domains of each person."""
    return domains.groupBy("person_id").agg(F.collect_set("domain").alias("official"))


def is_official(domain: Column) -> Column:
    """Whether a domain belongs to one of those in the column official; null counts as none."""
    return F.coalesce(F.exists("official", lambda o: domain_matches(domain, o)), F.lit(False))


def verify(hits: DataFrame, domains: DataFrame) -> DataFrame:
    """hits with verified and verification: against the person's official domains (person_id, domain).

    What people state in their own record (self_stated) is verified as it is. Each hit meets the domains of its own person and no others.
    """
    out = hits.withColumn("mail_domain", F.substring_index("email", "@", -1)).join(own_domains(domains), "person_id", "left")
    kind = F.when(F.col("self_stated"), "record").when(F.col("official").isNull(), "no domain").when(is_official(F.col("mail_domain")), "official domain").when(is_personal_mail(F.col("mail_domain")), "personal mail").otherwise("other domain")
    return out.withColumn("verification", kind).withColumn("verified", F.col("verification").isin("record", "official domain")).drop("official", "mail_domain")


def confirm_by_page(hits: DataFrame, pages: DataFrame, names: DataFrame) -> DataFrame:
    """Hits without a known domain whose domain's own page, or its parent's, names the affiliation -> person_id, email, host, name.

    pages (host, text), names (person_id, name_rank, name). Personal mail never counts.
    """
    domain = F.substring_index("email", "@", -1)
    open_ = hits.where(F.col("verification") == "no domain").withColumn("d", F.lower(domain)).where(~is_personal_mail(F.col("d")))
    parent = F.regexp_replace("d", r"^[^.]*\.", "")
    hosts = F.when(F.size(F.split("d", r"\.")) > 2, F.array("d", parent)).otherwise(F.array("d"))
    rows = open_.select("person_id", "email", F.posexplode(hosts).alias("level", "host")).join(pages, "host")
    word = F.lower(F.btrim("name"))
    words = names.withColumn("word", word).where(F.length(F.regexp_replace("word", "[^0-9a-z가-힣]", "")) >= 4)
    found = rows.join(words, "person_id").where(F.lower("text").contains(F.col("word")))
    return found.groupBy("person_id", "email").agg(F.min_by(F.struct("host", "name"), F.struct("level", "name_rank")).alias("x")).select("person_id", "email", "x.host", "x.name")


def once_per_source(hits: DataFrame, order: str = "found") -> DataFrame:
    """One hit for each person, address and source: the first."""
    place = W.partitionBy("person_id", "email", "source").orderBy(order)
    return hits.withColumn("_r", F.row_number().over(place)).where("_r = 1").drop("_r")


def ranked(hits: DataFrame) -> DataFrame:
    """hits with rn: verified first, then by strength of attribution (0 is strongest), then by address; rn 1 is the best."""
    place = W.partitionBy("person_id").orderBy(F.desc("verified"), "strength", "email", "source")
    return hits.withColumn("rn", F.row_number().over(place))


def by_article(works: DataFrame, authors: DataFrame, names: DataFrame, source: str) -> DataFrame:
    """Addresses that articles give for authors whose name can be the person's -> person_id, key, email, author, corresp, source.

    works (person_id, key), authors (key, name, corresp, emails) as jats.author_emails() has them, names (person_id, name). Names are
    composed before works and authors meet, so what comes of the joins is made once. authors are read twice: settle() them first.
    """
    own = with_nfkc(names.select("person_id", "name"), "name", "_x")
    said = with_nfkc(authors.select("key", F.col("name").alias("author"), "corresp", F.explode("emails").alias("email")), "author", "_y")
    near = works.select("person_id", "key").distinct().join(said, "key").join(own, "person_id")
    hits = near.where(same_person(F.col("_x"), F.col("_y"))).groupBy("person_id", "key", "email", "author").agg(F.max("corresp").alias("corresp"))
    return hits.withColumn("source", F.lit(source))


def by_full_text(reads: DataFrame, documents: DataFrame, names: DataFrame) -> DataFrame:
    """Addresses of documents that bear the person's name or stand next to it -> person_id, url, email, by ('account' or 'place'), source, snippet.

    reads (person_id, url), documents (url, kind, text), names (person_id, names array). Only rows that no account rule settles
    go through the proximity rule, by every place of the address in the whole text; the quote is of the first place.
    """
    wanted = reads.select("person_id", "url").distinct()
    found = addresses_of(spread(documents.join(wanted.select("url").distinct(), "url", "left_semi"), "url"))
    each = spread(wanted.join(names.select("person_id", "names"), "person_id"), "url").join(found, "url")
    account = attributed_by_account(F.substring_index("email", "@", 1), F.col("names"))
    by = F.when(account, "account").when(follows_name(F.col("before"), F.col("names")), "place")
    return each.withColumn("by", by).where("by is not null").select("person_id", "url", "email", "by", F.when(F.col("kind") == "html", "html").otherwise("pdf").alias("source"), "snippet")


#: Fixed value: how many of an account's last letters an address and its places share before they are compared.
ENDING = 3


def _places(text: Column, longest: Column) -> Column:
    """Array (at, before, after) of each @ of text that something follows, with all that an address there needs: the characters of a window and of a quote.

    before goes one address further back, since a window ends at an earlier place of its address. Neither takes more pieces than its characters can hold.
    """

    def place(pieces: Column, k: Column, most: Column) -> Column:
        before = F.array_join(F.slice(pieces, F.greatest(k - WINDOW, F.lit(1)), F.least(k + 1, F.lit(WINDOW + 2))), "@")
        after = F.array_join(F.slice(pieces, k + 2, F.lit(QUOTE + 1)), "@")
        stands = F.struct(k.alias("at"), F.right(before, 2 * most + WINDOW).alias("before"), F.left(after, most + QUOTE).alias("after"))
        return F.when(F.get(pieces, k + 1) != "", stands)

    cut = lambda pieces: F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.array_compact(let(F.split(text, "@"), lambda pieces: let(longest, lambda most: F.transform(cut(pieces), lambda _, k: place(pieces, k, most)))))


def _mentions(text: Column, emails: Column) -> Column:
    """Array of an entry for each address (email) and for each place of _places(), with the ending that they share if the address may stand there; null without addresses."""
    local = lambda e: F.substring_index(e, "@", 1)
    sizes = F.array_distinct(F.transform(emails, lambda e: F.least(F.length(local(e)), F.lit(ENDING))))
    none = F.lit(None).cast("struct<at:int,before:string,after:string>")
    entry = lambda ending, email, place: F.struct(ending.alias("ending"), email.alias("email"), place.alias("place"))
    wanted = F.transform(emails, lambda e: entry(F.right(local(e), F.lit(ENDING)), e, none))
    by_ending = lambda p, each: F.transform(each, lambda n: entry(F.lower(F.right(p["before"], n)), F.lit(None).cast("string"), p))
    met = let(sizes, lambda each: F.transform(_places(text, F.array_max(F.transform(emails, F.length))), lambda p: by_ending(p, each)))
    return F.when(F.size(emails) > 0, F.concat(wanted, F.flatten(met)))


def addresses_of(documents: DataFrame) -> DataFrame:
    """documents (url, kind, text) -> url, kind, email, before, snippet: the addresses of each document, found once however many people it is read for.

    before is what stands before the places of the address, in the whole text. A text is cut at each @ once and its places meet the addresses
    with the same ending, so a long text of many addresses is not searched for each of them.
    """
    found = documents.select("url", "kind", "text", F.xxhash64("text").alias("doc"), extract_emails(F.col("text")).alias("emails"))
    rows = found.select("url", "kind", "doc", F.inline(_mentions(F.col("text"), F.col("emails"))))  # not by a column of its own, which Spark would make once more to see whether it is empty
    met = rows.groupBy("url", "kind", "doc", "ending").agg(F.collect_list("email").alias("emails"), F.collect_list("place").alias("places"))
    local, domain = F.substring_index("email", "@", 1), F.substring_index("email", "@", -1)
    here = lambda p: (F.lower(F.right(p["before"], F.length(local))) == local) & (F.lower(F.left(p["after"], F.length(domain))) == domain)
    each = met.select("url", "kind", "places", F.explode("emails").alias("email")).withColumn("places", F.array_sort(F.filter("places", here)))
    ahead = lambda p: F.left(p["before"], F.length(p["before"]) - F.length(local))
    window = lambda p: F.right(F.element_at(parts_around(ahead(p), F.col("email")), -1), F.lit(WINDOW))
    first = F.get("places", F.lit(0))
    passage = F.concat(F.right(first["before"], F.length(local) + QUOTE), F.lit("@"), F.left(first["after"], F.length(domain) + QUOTE))
    quote = F.coalesce(snippet(passage, F.col("email")), F.lit(""))
    return each.select("url", "kind", "email", F.array_distinct(F.transform("places", window)).alias("before"), quote.alias("snippet"))


def by_home_page(urls: DataFrame, pages: DataFrame, names: DataFrame, domains: DataFrame, most: int = 2) -> DataFrame:
    """Addresses of a person's own pages: theirs by account or place, or a personal account on a page of an official domain -> person_id, url, email, by, source, snippet.

    urls (person_id, pos, url) of which the first two count, pages (url, status, content_type, html), domains (person_id, domain).
    """
    first = urls.withColumn("r", F.row_number().over(W.partitionBy("person_id").orderBy("pos", "url"))).where(F.col("r") <= most).select("person_id", "url")
    wanted = spread(pages.join(first.select("url").distinct(), "url", "left_semi"), "url")
    read = wanted.select("url", page_head(F.col("html")).alias("head"), F.explode(home_page_emails(F.col("status"), F.col("content_type"), F.col("html"))).alias("email"))
    readers = first.join(names.select("person_id", "names"), "person_id").join(own_domains(domains), "person_id", "left")
    each = spread(readers, "url").join(read, "url")
    local = F.substring_index("email", "@", 1)
    near = attributed_by_proximity(F.col("head"), F.col("email"), F.col("names"))
    by = F.when(attributed_by_account(local, F.col("names")), "account").when(near, "place").when(is_official(host_of(F.col("url"))) & ~is_department(local), "page")
    return each.withColumn("by", by).where("by is not null").select("person_id", "url", "email", "by", F.lit("homepage").alias("source"), snippet(F.col("head"), F.col("email")).alias("snippet"))


def by_author(works: DataFrame, authors: DataFrame, names: DataFrame, source: str) -> DataFrame:
    """Addresses of the authors of a person's works whose name can be the person's -> person_id, key, email, source.

    works (person_id, key), authors (key, author, email), names (person_id, name). Works and authors meet by the
    work and a key of the name, so a record of many authors isn't paired with all that read it.
    """
    keyed = lambda rows, name, x: with_nfkc(rows, name, x).withColumn("_k", F.explode(name_keys(F.col(x))))
    own = keyed(works.select("person_id", "key").distinct().join(names.select("person_id", "name"), "person_id"), "name", "_x")
    near = own.join(keyed(authors.select("key", "author", "email"), "author", "_y"), ["key", "_k"])
    return near.where(same_person(F.col("_x"), F.col("_y"))).select("person_id", "key", "email").distinct().withColumn("source", F.lit(source))
