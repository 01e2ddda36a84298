"""The registered queries of the library, each an operator over its whole tables, with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ALIAS_GROUPS
from ..functions import names as N
from ..functions import orgs as O
from ..functions import text as T
from ..operators import evidence, matching, people, works
from ..operators.aliases import alias_table, canonical, known_groups
from ..operators.store import settle
from ..sources import records
from . import report
from .snapshot import sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
GENERIC = f"^({T.ROLES})"
PERSONAL = f"({T.PROVIDERS})\\."


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---- text


def _deobfuscated(c: str) -> str:
    out = f"replace(replace(replace({c}, '%40', '@'), '&#64;', '@'), '&#46;', '.')"
    for word, sign in (("at", "@"), ("dot", ".")):
        out = f"regexp_replace({out}, '\\s*[\\[({{]\\s*{word}\\s*[\\])}}]\\s*', '{sign}', 'gi')"
    out = f"regexp_replace({out}, '([A-Za-z0-9])\\s+AT\\s+([A-Za-z0-9])', '\\1@\\2', 'g')"
    return f"regexp_replace({out}, '([A-Za-z0-9])\\s+DOT\\s+([A-Za-z]{{2,}})', '\\1.\\2', 'g')"


def _emails(source: str, key: str, text: str) -> str:
    return f"""select {key}, e, min(i) as i from (select {key}, lower(trim(unnest(l), '.')) as e, unnest(range(len(l))) as i from (
        select {key}, regexp_extract_all({text}, '{EMAIL}') as l from {source}))
        where not regexp_matches(split_part(e, '@', 1), '{GENERIC}', 'i') and not regexp_matches(e, '\\.({T.ASSETS})$') group by all"""


@query(f"select note_id, {_deobfuscated('text')} as text from ({sql('notes')})")
def e1_deobfuscate(spark, sf_dir):
    return table(spark, sf_dir, "notes").select("note_id", T.deobfuscate(F.col("text")).alias("text"))


@query(f"select doc_id, string_agg(e, ' ' order by i) as emails from ({_emails('documents', 'doc_id', _deobfuscated('text'))}) group by doc_id")
def e2_extract_emails(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").where(T.may_hold_address(F.col("text")))
    return docs.select("doc_id", F.array_join(T.extract_emails(F.col("text")), " ").alias("emails")).where("emails != ''")


@query(f"select p_partkey, regexp_matches(p_name, '{GENERIC}', 'i') as generic from part union all select s_suppkey + 1000000, true from supplier")
def e3_generic_accounts(spark, sf_dir):
    made = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("p_partkey"), T.is_generic(F.concat(F.lit("Infodesk"), F.col("s_suppkey"))).alias("generic"))
    return _read(spark, sf_dir, "part").select("p_partkey", T.is_generic(F.col("p_name")).alias("generic")).unionByName(made)


@query(f"select person_id, source, regexp_matches(concat(split_part(email, '@', 2), '.'), '{PERSONAL}', 'i') as personal from ({sql('hits')})")
def e4_personal_mail(spark, sf_dir):
    return table(spark, sf_dir, "hits").select("person_id", "source", T.is_personal_mail(F.substring_index("email", "@", -1)).alias("personal"))


@query(f"""select note_id, concat(text, chr(10), trim(split_part(g, ',', 1)), '@lab.example', chr(10), trim(split_part(g, ',', 2)), '@lab.example') as text
    from (select note_id, text, regexp_extract(text, '\\{{([^{{}}]+)\\}}', 1) as g from ({sql('notes')}))""")
def e5_expand_braces(spark, sf_dir):
    return table(spark, sf_dir, "notes").select("note_id", T.expand_braces(F.col("text")).alias("text"))


@query(f"select page_id, array_to_string(list_transform(regexp_extract_all(html, 'href=[\"'']mailto:([^\"''?]+)', 1, 'i'), lambda x: lower(x)), ' ') as targets from (select page_id, concat(html, '<a HREF=\"mailto:Some.One', page_id, '@Example.org?subject=x\">') as html from pages)")
def e6_mailto_targets(spark, sf_dir):
    html = F.concat("html", F.lit('<a HREF="mailto:Some.One'), "page_id", F.lit('@Example.org?subject=x">'))
    return _read(spark, sf_dir, "pages").select("page_id", F.array_join(T.mailto_targets(html), " ").alias("targets"))


@query("""select doc_id, case when i = 0 then '' else trim(regexp_replace(regexp_replace(substring(text, greatest(i - 70, 1), length(lang) + 70 + i - greatest(i - 70, 1)), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) end as quote
    from (select *, instr(lower(text), lower(lang)) as i from documents)""")
def e7_snippet(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), F.col("lang")).alias("quote"))


@query(f"select work_id, pos, case when regexp_matches(url, '{T.OPEN_HOSTS}', 'i') then 0 when regexp_matches(url, '{T.PUBLISHERS}', 'i') then 2 else 1 end as rank from ({sql('locations')})")
def e10_host_rank(spark, sf_dir):
    return table(spark, sf_dir, "locations").select("work_id", "pos", T.host_rank(F.col("url")).alias("rank"))


PAGE = "trim(regexp_replace({d}, '\\s+', ' ', 'g'))".format(d=_deobfuscated("regexp_replace(regexp_replace(substring(html, 1, 2000000), '<script.*?</script>|<style.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g')"))


@query(f"select page_id, length(t) as n, md5(t) as digest from (select page_id, {PAGE} as t from pages)")
def s12_page_text(spark, sf_dir):
    text = F.btrim(T.page_text(F.col("html")))
    return _read(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("digest"))


@query(f"""select page_id, case when page_id % 7 = 0 then 'http 404' when regexp_matches(substring(html, 1, 20000), '{T.ROBOT_PAGE}', 'i') then 'robot page' when e.k is null then 'not a pdf' else 'addresses' end as outcome
    from pages left join (select page_id as k from ({_emails('pages', 'page_id', PAGE)}) union select page_id from (select page_id, unnest(regexp_extract_all(html, 'href=["'']mailto:([^"''?]+)', 1, 'i')) as m from pages) where regexp_full_match({_deobfuscated('m')}, '{EMAIL}')) e on k = page_id""")
def e11_outcomes(spark, sf_dir):
    status = F.when(F.col("page_id") % 7 == 0, 404).otherwise(200)
    return _read(spark, sf_dir, "pages").select("page_id", T.outcome(status, F.lit("text/html"), F.length("html"), F.col("html"), T.page_emails(F.col("html"))).alias("outcome"))


@query("""select page_id // 5 as doc_id, substring(regexp_replace(string_agg(html, chr(10) order by page_id), '[ \t]+', ' ', 'g'), 1, 8000) as text from pages where page_id % 5 < 3 group by 1""")
def s13_document_text(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).alias("doc_id"), (F.col("page_id") % 5 + 1).alias("page_no"), F.col("html").alias("text"))
    return records.document_text(pages)


# ---- names

TOKENS = "list_filter(string_split_regex(regexp_replace(lower({c}), '[-.‐‑,]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


@query(f"select person_id, array_to_string(list_sort({TOKENS.format(c='name')}), ' ') as norm from ({sql('people')})")
def n1_norm_name(spark, sf_dir):
    return table(spark, sf_dir, "people").select("person_id", N.norm_name(F.col("name")).alias("norm"))


FIRSTS = "list_sort(list_distinct(list_transform({r}, lambda t: t[1])))"
LONGS = "list_sort(list_distinct(list_filter({r}, lambda t: length(t) > 1)))"


@query(f"""with t as (select distinct name, {TOKENS.format(c='name')} as t from ({sql('people')})), u as (select distinct display_name, {TOKENS.format(c='display_name')} as u from ({sql('authors')})),
    p as (select *, list_filter(t, lambda x: length(x) > 1 and list_contains(u, x)) as s from t, u),
    q as (select *, list_filter(t, lambda x: x <> s[1]) as ra, list_filter(u, lambda x: x <> s[1]) as rb from p)
    select name, display_name from q where list_sort(t) = list_sort(u) or (len(s) = 1 and len(ra) > 0 and len(rb) > 0 and (array_to_string(ra, '') = array_to_string(rb, '')
      or ({FIRSTS.format(r='ra')} = {FIRSTS.format(r='rb')} and (len({LONGS.format(r='ra')}) = 0 or len({LONGS.format(r='rb')}) = 0 or {LONGS.format(r='ra')} = {LONGS.format(r='rb')}))))""")
def n2_match_names(spark, sf_dir):
    return matching.match_names(table(spark, sf_dir, "people"), table(spark, sf_dir, "authors"), "name", "display_name")


def _forms_sql() -> str:
    """What latin_name_forms() makes of the five styles of the derived people, from their parts."""
    from .snapshot import GIVEN, SURNAME

    (g, h), s = GIVEN, SURNAME
    joined = f"concat({g}, lower({h}))"
    cap = "concat(upper(substring({x}, 1, 1)), lower(substring({x}, 2)))"
    first = f"concat({g}, ' ', {h}, ' ', {s}), concat({joined}, ' ', {s})"
    swapped = f"concat({s}, ' ', {g}, ' ', {h}), concat({cap.format(x=f'concat({s}, {g})')}, ' ', {h})"
    initials = f"concat(substring({g}, 1, 1), '. ', substring({h}, 1, 1), '. ', {s}), concat(substring({g}, 1, 1), lower(substring({h}, 1, 1)), ' ', {s})"
    return f"select c_custkey as person_id, array_to_string(case c_custkey % 5 when 0 then [{first}] when 1 then [concat({joined}, ' ', {s})] when 2 then [{first}, {swapped}] when 3 then [{first}] else [{initials}] end, '|') as forms from customer"


@query(_forms_sql())
def n3_latin_forms(spark, sf_dir):
    return table(spark, sf_dir, "people").select("person_id", F.array_join(N.latin_name_forms(F.col("name")), "|").alias("forms"))


def _sounds(sounds: tuple[str, ...], spellings: dict[str, tuple[str, ...]], at: str) -> str:
    return "[" + ", ".join(_list(spellings.get(s, (s,))) for s in sounds) + f"][{at} + 1]"


@query(f"""with l as (select p_partkey, (p_partkey * 7) % 11172 as c from part),
    s as (select p_partkey, x, y, z, i, j, k from (select p_partkey, {_sounds(N.INITIALS, N.INITIAL_SPELLINGS, 'c // 588')} as a, {_sounds(N.MEDIALS, N.MEDIAL_SPELLINGS, '(c % 588) // 28')} as b, {_sounds(N.FINALS, N.FINAL_SPELLINGS, 'c % 28')} as d from l)
      , lateral (select unnest(a) as x, unnest(range(len(a))) as i), lateral (select unnest(b) as y, unnest(range(len(b))) as j), lateral (select unnest(d) as z, unnest(range(len(d))) as k)),
    o as (select p_partkey, concat(x, y, z) as w, min(i * 100 + j * 10 + k) as o from s group by all),
    r as (select *, row_number() over (partition by p_partkey order by o) as r from o)
    select p_partkey, string_agg(w, ' ' order by r) as spellings from r where r <= 4 group by p_partkey""")
def n4_syllable_spellings(spark, sf_dir):
    letters = _read(spark, sf_dir, "part").select("p_partkey", N.hangul(F.pmod(F.col("p_partkey") * 7, F.lit(N.SYLLABLES)) + 0xAC00).alias("letter"))
    return N.with_spellings(letters, "letter", "spellings").select("p_partkey", F.array_join("spellings", " ").alias("spellings"))


@query(f"select person_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[\\s,.\\-]+'), lambda t: regexp_full_match(t, '[a-z]{{3,}}')))), ' ') as tokens from ({sql('people')})")
def n6_name_tokens(spark, sf_dir):
    return table(spark, sf_dir, "people").select("person_id", F.array_join(F.array_sort(N.name_tokens(F.array("name"))), " ").alias("tokens"))


@query(f"select person_id, array_to_string(list_filter(string_split_regex(lower(field), '[\\s,/·]+'), lambda t: length(t) >= 3), ' ') as terms from ({sql('people')})")
def n8_field_terms(spark, sf_dir):
    return table(spark, sf_dir, "people").select("person_id", F.array_join(N.field_terms(F.col("field")), " ").alias("terms"))


# ---- organisations and domains


def _key(c: str) -> str:
    out = f"lower({c})"
    for form in O.LEGAL_FORMS:
        out = f"replace({out}, '{form}', ' ')"
    return f"regexp_replace({out}, '[^0-9a-z가-힣]+', '', 'g')"


ABBREVIATIONS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in O.ABBREVIATIONS.items()) + "}"
NAMES = f"select distinct unnest([name, short_name]) as name from ({sql('orgs')})"


def _words(c: str) -> str:
    words = f"list_filter(string_split_regex(replace(lower({c}), '&', ' and '), '[^0-9a-z가-힣]+'), lambda t: t <> '')"
    return f"list_sort(list_distinct(list_filter(list_transform({words}, lambda t: coalesce({ABBREVIATIONS}[t], t)), lambda t: not list_contains({_list(O.STOP)}, t))))"


ACRONYM = f"list_transform(list_filter(list_filter(string_split_regex({{c}}, '[\\s\\-]+'), lambda w: w <> ''), lambda w: not list_contains({_list(O.SKIPPED)}, lower(w)) and regexp_matches(w, '^[A-Za-z]')), lambda w: lower(w[1]))"


def _names(spark, sf_dir):
    return table(spark, sf_dir, "orgs").select(F.explode(F.array("name", "short_name")).alias("name")).distinct()


@query(f"select name, {_key('name')} as key from ({NAMES})")
def o1_org_key(spark, sf_dir):
    return _names(spark, sf_dir).select("name", O.org_key(F.col("name")).alias("key"))


@query(f"select name, case when len(l) >= 2 then array_to_string(l, '') else '' end as acronym from (select name, {ACRONYM.format(c='name')} as l from ({NAMES}))")
def o2_acronym(spark, sf_dir):
    return _names(spark, sf_dir).select("name", O.acronym(F.col("name")).alias("acronym"))


@query(f"select name, array_to_string({_words('name')}, ' ') as tokens from ({NAMES})")
def o3_org_tokens(spark, sf_dir):
    return _names(spark, sf_dir).select("name", F.array_join(O.org_tokens(F.col("name")), " ").alias("tokens"))


TOKEN_RULE = f"""case when len(ta) = 0 or len(tb) = 0 then false when ta = tb then len(ta) >= 2 else len(list_intersect(ta, tb)) > 0
    and len(list_filter(ta, lambda x: not list_contains(tb, x) and not list_contains({_list(O.DECOR)}, x))) = 0 and len(list_filter(tb, lambda x: not list_contains(ta, x) and not list_contains({_list(O.DECOR)}, x))) = 0
    and (len(list_intersect(ta, tb)) >= 2 or len(list_filter(list_intersect(ta, tb), lambda x: length(x) < 4 or list_contains({_list(O.DECOR)}, x))) = 0) end"""
SIDES = f"n as ({NAMES}), x as (select name as a, {_key('name')} as ka, {_words('name')} as ta, case when len({ACRONYM.format(c='name')}) >= 2 then array_to_string({ACRONYM.format(c='name')}, '') else '' end as aa from n), y as (select name as b, {_key('name')} as kb, {_words('name')} as tb, case when len({ACRONYM.format(c='name')}) >= 2 then array_to_string({ACRONYM.format(c='name')}, '') else '' end as ab from n)"


def _aliases(spark):
    """The aliases known from the start."""
    return alias_table(spark.createDataFrame([], "group_id long, name string"))


@query(f"with {SIDES} select a, b from x, y where ka <> '' and kb <> '' and (ka = kb or {TOKEN_RULE})")
def o6_same_org_strict(spark, sf_dir):
    n = _names(spark, sf_dir)
    return matching.match_orgs(n.toDF("a"), n.toDF("b"), "a", "b", _aliases(spark), strict=True)


@query(f"with {SIDES} select a, b from x, y where ka <> '' and kb <> '' and (ka = kb or {TOKEN_RULE} or (length(aa) >= 3 and aa = kb) or (length(ab) >= 3 and ab = ka) or (length(ka) >= 4 and contains(kb, ka)) or (length(kb) >= 4 and contains(ka, kb)))")
def o7_same_org(spark, sf_dir):
    n = _names(spark, sf_dir)
    return matching.match_orgs(n.toDF("a"), n.toDF("b"), "a", "b", _aliases(spark))


def _same_words(name: str) -> str:
    return f"select a, b from x, y where {TOKEN_RULE}".replace("x, y", f"(select name as a, {_words('name')} as ta from ({name})), (select name as b, {_words('name')} as tb from ({name}))")


@query(_same_words(NAMES))
def o4_same_tokens(spark, sf_dir):
    n = _names(spark, sf_dir)
    worded = lambda c, t: n.select(F.col("name").alias(c), O.org_tokens(F.col("name")).alias(t)).where(F.size(t) > 0)
    x, y = worded("a", "ta"), worded("b", "tb")
    return x.join(y, O.core_key(F.col("ta")) == O.core_key(F.col("tb"))).where(O.same_tokens(F.col("ta"), F.col("tb"))).select("a", "b")


#: Groups that overlap: an organisation's two names, and chains of five names, two of which share a group each; every third chain also has a name known from the start.
GROUPS = """select org_id as group_id, unnest([name, short_name]) as name from ({orgs}) union all
    select s_suppkey + 1000000, unnest([concat('Link House ', s_suppkey), concat('Link House ', s_suppkey + 1)]) from supplier where s_suppkey % 5 < 4 union all
    select s_suppkey + 2000000, unnest([concat('Link House ', s_suppkey), 'Seoul National University']) from supplier where s_suppkey % 15 = 2"""
STATIC = "(values " + ", ".join(f"({k}, '{n}')" for k, g in enumerate(ALIAS_GROUPS) for n in g) + ") s(group_id, name)"


@query(f"""with recursive g as (select distinct 1 as late, group_id, name, {_key('name')} as k from ({GROUPS.format(orgs=sql('orgs'))}) union all select 0, group_id, name, {_key('name')} from {STATIC}),
    e as (select distinct x.k as a, y.k as b from g x join g y on x.late = y.late and x.group_id = y.group_id),
    r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
    c as (select a as k, min(b) as component from r group by a),
    best as (select component, k as canonical from (select component, g.k, row_number() over (partition by component order by late, case when late = 0 then group_id end, length(g.k) desc, g.k desc) as n from g join c using (k)) where n = 1)
    select distinct name, canonical from g join c using (k) join best using (component)""")
def o5_alias_groups(spark, sf_dir):
    orgs = table(spark, sf_dir, "orgs").select(F.col("org_id").alias("group_id"), F.explode(F.array("name", "short_name")).alias("name"))
    key, link = F.col("s_suppkey"), lambda n: F.concat(F.lit("Link House "), n)
    supplier = _read(spark, sf_dir, "supplier")
    chains = supplier.where(key % 5 < 4).select((key + 1000000).alias("group_id"), F.explode(F.array(link(key), link(key + 1))).alias("name"))
    known = supplier.where(key % 15 == 2).select((key + 2000000).alias("group_id"), F.explode(F.array(link(key), F.lit("Seoul National University"))).alias("name"))
    groups = orgs.unionByName(chains).unionByName(known)
    every = groups.select("name").unionByName(known_groups(spark).select("name")).distinct()
    return canonical(every, "name", alias_table(groups))


CAP = "(upper({x}[1]) || lower({x}[2:]))"
OUT = f"array_to_string(list_transform(list_filter(list_filter(string_split_regex(trim(replace(name, '&', ' and ')), '\\s+'), lambda w: w <> ''), lambda w: lower(trim(w, '.,()')) <> '' and not list_contains({_list(O.LEGAL_WORDS)}, lower(trim(w, '.,()')))), lambda w: coalesce({CAP.format(x=f'{ABBREVIATIONS}[lower(trim(w, chr(46) || chr(44) || chr(40) || chr(41)))]')}, case when w = upper(w) and w <> lower(w) and length(w) > 3 then {CAP.format(x='w')} else w end)), ' ')"


@query(f"select name, case when o <> '' and {_key('o')} <> {_key('name')} then o else '' end as expanded from (select name, {OUT} as o from ({NAMES}))")
def o8_expand_abbreviations(spark, sf_dir):
    return _names(spark, sf_dir).select("name", O.expand_abbreviations(F.col("name")).alias("expanded"))


@query("select page_id, regexp_replace(lower(regexp_extract(trim(url), '^(?:https?://)?([^/:?#]+)', 1, 'i')), '^www\\.', '') as host from pages")
def o9_host_of(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", O.host_of(F.col("url")).alias("host"))


MATCHES = f"(d = h or ends_with(d, concat('.', h)) or (len(string_split(h, '.')) >= 3 and not list_contains({_list(O.PUBLIC_SUFFIXES)}, regexp_replace(h, '^[^.]*\\.', '')) and (d = regexp_replace(h, '^[^.]*\\.', '') or ends_with(d, concat('.', regexp_replace(h, '^[^.]*\\.', ''))))))"


@query(f"with a as (select distinct split_part(email, '@', 2) as d from ({sql('hits')})), b as (select distinct domain, regexp_replace(domain, '^www\\.', '') as h from ({sql('domains')})) select d as mail_domain, domain from a, b where {MATCHES}")
def o10_match_domains(spark, sf_dir):
    mail = table(spark, sf_dir, "hits").select(F.substring_index("email", "@", -1).alias("mail_domain"))
    return matching.match_domains(mail, table(spark, sf_dir, "domains"), "mail_domain", "domain")


# ---- evidence

BARE = "regexp_replace(split_part(email, '@', 1), '[._-]', '', 'g')"
PARTS = "list_filter(string_split_regex(lower(name), '[\\s,.\\-]+'), lambda t: regexp_full_match(t, '[a-z]+'))"


@query(f"""with h as (select h.person_id, email, name, {BARE} as l, {PARTS} as p from ({sql('hits')}) h join ({sql('people')}) q on q.person_id = (h.person_id // 2) * 2),
    s as (select person_id, email, l, p, t, array_to_string(list_transform(list_filter(p, lambda x: x <> t), lambda x: x[1]), '') as i, concat(l[:instr(l, t) - 1], l[instr(l, t) + length(t):]) as r from h, lateral (select unnest(p) as t))
    select person_id, email, bool_or((length(t) >= 4 and contains(l, t)) or (len(p) >= 2 and length(t) >= 3 and contains(l, t) and i <> '' and (starts_with(r, i) or ends_with(r, i) or (length(i) >= 2 and contains(r, i))))) as theirs from s group by all""")
def e8_attributed_by_account(spark, sf_dir):
    hits = table(spark, sf_dir, "hits").withColumn("other", F.floor(F.col("person_id") / 2) * 2)
    named = hits.join(table(spark, sf_dir, "people").select(F.col("person_id").alias("other"), "name"), "other")
    return named.select("person_id", "email", evidence.attributed_by_account(F.substring_index("email", "@", 1), F.array("name")).alias("theirs"))


VERIFIED = f"""select h.*, case when self_stated then 'record' when fits then 'official domain' when n is null then 'no domain' when regexp_matches(concat(d, '.'), '{PERSONAL}', 'i') then 'personal mail' else 'other domain' end as verification
    from (select *, split_part(email, '@', 2) as d from ({sql('hits')})) h left join (select person_id as n, regexp_replace(domain, '^www\\.', '') as h from ({sql('domains')})) o on n = h.person_id, lateral (select coalesce({MATCHES.replace(' h ', ' o.h ').replace('(h,', '(o.h,').replace(' h)', ' o.h)').replace('= h ', '= o.h ')}, false) as fits)"""


@query(f"select person_id, email, verification, verification in ('record', 'official domain') as verified from ({VERIFIED})")
def j13_verify_domains(spark, sf_dir):
    return evidence.verify(table(spark, sf_dir, "hits"), table(spark, sf_dir, "domains")).select("person_id", "email", "verification", "verified")


@query(f"select person_id, email, host, name from (select h.person_id, email, host, split_part(p.affiliation, ' ', 1) as name, row_number() over (partition by h.person_id, email order by level) as r from (select *, unnest([d, regexp_replace(d, '^[^.]*\\.', '')]) as host, unnest([0, 1]) as level from ({VERIFIED}) where verification = 'no domain' and not regexp_matches(concat(d, '.'), '{PERSONAL}', 'i') and len(string_split(d, '.')) > 2) h join ({sql('orgs')}) o on host = regexp_replace(split_part(website, '/', 3), '^www\\.', '') join ({sql('people')}) p on p.person_id = h.person_id where contains(lower(concat('Welcome to ', o.name)), lower(split_part(p.affiliation, ' ', 1)))) where r = 1")
def j14_confirm_by_page(spark, sf_dir):
    hits = evidence.verify(table(spark, sf_dir, "hits"), table(spark, sf_dir, "domains"))
    pages = table(spark, sf_dir, "orgs").select(O.host_of(F.col("website")).alias("host"), F.concat(F.lit("Welcome to "), "name").alias("text"))
    asked = table(spark, sf_dir, "people").select("person_id", F.lit(0).alias("name_rank"), F.split_part("affiliation", F.lit(" "), F.lit(1)).alias("name"))
    return evidence.confirm_by_page(hits, pages, asked)


@query(f"select person_id, email, source, row_number() over (partition by person_id order by verification in ('record', 'official domain') desc, strength, email, source) as rn from ({VERIFIED})")
def w12_rank_evidence(spark, sf_dir):
    return evidence.ranked(evidence.verify(table(spark, sf_dir, "hits"), table(spark, sf_dir, "domains"))).select("person_id", "email", "source", F.col("rn").cast("long").alias("rn"))


@query("select user_id as person_id, concat('m', event_id % 3, '@lab.example') as email, event_type as source, min(event_id) as found from events group by all")
def w11_once_per_source(spark, sf_dir):
    address = F.concat(F.lit("m"), F.col("event_id") % 3, F.lit("@lab.example"))
    hits = _read(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), address.alias("email"), F.col("event_type").alias("source"), F.col("event_id").alias("found"))
    return evidence.once_per_source(hits).select("person_id", "email", "source", "found")


ROUTE_OF = "['" + "', '".join(evidence.ROUTES) + "'][cast(person_id % 7 + 1 as int)]"


@query(f"select {ROUTE_OF} as source, self_stated, count(*) as n, count(distinct email) as addresses from ({sql('hits')}) group by all")
def x1_evidence_union(spark, sf_dir):
    hits = table(spark, sf_dir, "hits")
    routes = [hits.where(F.col("person_id") % 7 == k).withColumn("source", F.lit(r)) for k, r in enumerate(evidence.ROUTES)]
    return evidence.union_routes(*routes).groupBy("source", "self_stated").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("email").alias("addresses"))


# ---- people and authors: candidates that share surname, by brute-force SQL on the derived identity

CANDS = f"select o_orderkey as author_id, o_custkey as person_id, o_orderkey % 3 > 0 as current, o_orderkey % 5 = 0 as topic_hit, o_orderkey % 97 as works_count, o_orderkey % 4 as form_rank from orders"


def _cands(spark, sf_dir):
    return spark.sql(CANDS.replace("from orders", "from {orders}"), orders=_read(spark, sf_dir, "orders"))


ORDER = "current desc, topic_hit desc, works_count desc, form_rank, author_id"


@query(f"select person_id, author_id, row_number() over (partition by person_id order by {ORDER}) as rn from ({CANDS})")
def w1_order_candidates(spark, sf_dir):
    return people.ordered(_cands(spark, sf_dir)).select("person_id", "author_id", F.col("rn").cast("long").alias("rn"))


@query(f"""with c as (select *, count(*) over p as n, count(*) filter (where current) over p as nc from ({CANDS}) window p as (partition by person_id)), d as (select * exclude (n, nc), count(*) over p as n, count(*) filter (where topic_hit) over p as nt from c where n = 1 or nc = 0 or current window p as (partition by person_id))
    select person_id, author_id, count(*) over (partition by person_id) = 1 as "unique" from d where n = 1 or nt = 0 or topic_hit""")
def w2_decide(spark, sf_dir):
    return people.decide(_cands(spark, sf_dir)).select("person_id", "author_id", "unique")


@query(f"select c.person_id, c.author_id from ({CANDS}) c join (select person_id, form_rank, sum(n) over (partition by person_id order by form_rank) - n as b from (select person_id, form_rank, count(*) as n from ({CANDS}) group by all)) f using (person_id, form_rank) where b < 4")
def w3_stop_forms(spark, sf_dir):
    return people.stop_forms(_cands(spark, sf_dir)).select("person_id", "author_id")


@query(f"""with r as (select *, row_number() over (partition by person_id order by {ORDER}) as rn from ({CANDS})), s as (select *, max(works_count) filter (where rn = 1) over p as a, max(works_count) filter (where rn = 2) over p as b, coalesce(bool_or(works_count % 7 = 0) filter (where rn = 2) over p, false) as same from r window p as (partition by person_id))
    select person_id, author_id from s where a >= 20 and (b is null or a >= 3 * greatest(b, 1) or same) and (rn = 1 or (rn = 2 and same))""")
def w4_dominant(spark, sf_dir):
    ranked = people.ordered(_cands(spark, sf_dir)).withColumn("same_as_first", F.col("works_count") % 7 == 0)
    return people.dominant(ranked).select("person_id", "author_id")


@query(f"select person_id, author_id from (select *, row_number() over (partition by person_id order by {ORDER}) as rn from ({CANDS})) where rn <= 2")
def w5_top_authors(spark, sf_dir):
    return people.ordered(_cands(spark, sf_dir)).where("rn <= 2").select("person_id", "author_id")


@query(f"""with e as (select o_custkey as person_id, o_custkey // 4 as record_id, o_orderkey % 10 as institution from orders), p as (select c_custkey as person_id, c_custkey % 10 as institution from customer), r as (select c_custkey as person_id, c_custkey // 4 as record_id from customer)
    select * from r where not exists (select 1 from e where e.person_id = r.person_id and e.record_id = r.record_id) or exists (select 1 from e join p using (person_id, institution) where e.person_id = r.person_id and e.record_id = r.record_id)""")
def j5_hold_records(spark, sf_dir):
    orders, customer = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    jobs = orders.selectExpr("o_custkey as person_id", "o_custkey div 4 as record_id", "o_orderkey % 10 as institution")
    return people.hold_records(customer.selectExpr("c_custkey as person_id", "c_custkey div 4 as record_id"), jobs, customer.selectExpr("c_custkey as person_id", "c_custkey % 10 as institution"))


FOUND = "select o_custkey as person_id, o_orderkey % 6 as form_rank, o_orderkey as record_id, o_orderkey % 4 > 0 as has_institution, o_orderkey % 3 = 0 and o_orderkey % 4 > 0 as fits from {orders}"


@query(f"""with f as ({FOUND.format(orders='orders')}), g as (select person_id, form_rank, count(*) as n, count(*) filter (where fits) as m, min(record_id) as a, min(record_id) filter (where fits) as b, bool_or(fits or not has_institution) as fine from f group by all),
    h as (select person_id, form_rank, case when n = 1 and fine then a when n > 1 and m = 1 then b end as record_id from g) select person_id, arg_min(record_id, form_rank) as record_id from h where record_id is not null group by person_id""")
def j4_search_records(spark, sf_dir):
    return people.search_records(spark.sql(FOUND, orders=_read(spark, sf_dir, "orders")))


def _same_org_sql(a: str, b: str) -> str:
    """Distinct pairs (a, b) of two queries of one column, name, that loosely name one organisation."""
    side = lambda q, x: f"(select name as {x}, {_key('name')} as k{x}, {_words('name')} as t{x}, case when len({ACRONYM.format(c='name')}) >= 2 then array_to_string({ACRONYM.format(c='name')}, '') else '' end as a{x} from (select distinct name from ({q})))"
    loose = "ka = kb or {t} or (length(aa) >= 3 and aa = kb) or (length(ab) >= 3 and ab = ka) or (length(ka) >= 4 and contains(kb, ka)) or (length(kb) >= 4 and contains(ka, kb))".format(t=TOKEN_RULE)
    return f"select a, b from {side(a, 'a')}, {side(b, 'b')} where ka <> '' and kb <> '' and ({loose})"


@query(f"""with f as (select person_id, name from ({sql('people')})), a as ({sql('authors')}), m as ({{n2}}), k as (select person_id, b as institution from ({sql('people')}) join ({_same_org_sql(f"select affiliation as name from ({sql('people')})", f"select institution as name from ({sql('authors')})")}) on a = affiliation)
    select f.person_id, author_id, bool_or(current) as current from f join m using (name) join a using (display_name) join k on k.person_id = f.person_id and k.institution = a.institution group by all""".replace("{n2}", ORACLES["n2_match_names"]))
def j3_author_candidates(spark, sf_dir):
    asked, authors = table(spark, sf_dir, "people"), table(spark, sf_dir, "authors")
    forms = asked.select("person_id", F.lit(0).alias("form_rank"), F.col("name").alias("form"))
    same = matching.match_orgs(asked.select("affiliation"), authors.select("institution"), "affiliation", "institution", _aliases(spark))
    pairs = asked.join(same, "affiliation").select("person_id", "institution")
    works_ = authors.select("author_id", "display_name", F.col("works_count").cast("long").alias("works_count"), F.array("topic").alias("topics"))
    return people.candidates(forms, works_, pairs, authors.select("author_id", "institution", "current")).select("person_id", "author_id", "current")


# ---- works

LINKED = "select c_custkey as person_id, 0 as author_rank, c_custkey * 10 as author_id from {customer} union all select c_custkey as person_id, 1 as author_rank, ((c_custkey * 3) % 100) * 10 as author_id from {customer}"
WORKS = f"""with l as ({LINKED.format(customer='customer')}), w as (select l.*, w.* exclude (author_id), row_number() over (partition by person_id, l.author_id order by year desc, work_id) as nth from l join ({sql('works')}) w using (author_id)),
    k as (select *, coalesce(nullif(lower(regexp_replace(doi, '^https?://(dx\\.)?doi\\.org/', '', 'i')), ''), cast(work_id as varchar)) as key from w where nth <= 25),
    o as (select * from (select *, row_number() over (partition by person_id, key order by author_rank, nth) as r from k) where r = 1),
    p as (select *, row_number() over (partition by person_id order by author_rank, nth, key) as pos from o)"""


def _works(spark, sf_dir):
    return works.works_of(spark.sql(LINKED, customer=_read(spark, sf_dir, "customer")), table(spark, sf_dir, "works"))


@query(f"{WORKS} select person_id, work_id, pos from p")
def j7_works(spark, sf_dir):
    return _works(spark, sf_dir).select("person_id", "work_id", F.col("pos").cast("long").alias("pos"))


@query(f"{WORKS} select person_id, work_id, row_number() over (partition by person_id order by contains(lower(title), 'urgent') desc, pos) as place from p")
def w6_topic_first(spark, sf_dir):
    return works.topic_first(_works(spark, sf_dir).withColumn("terms", F.array(F.lit("urgent"))), text="title").select("person_id", "work_id", F.col("place").cast("long").alias("place"))


@query(f"{WORKS} select person_id, work_id from (select person_id, work_id, row_number() over (partition by person_id order by pos) as r from p where doi <> '') where r <= 6")
def w7_first_with_doi(spark, sf_dir):
    return works.first_with_doi(_works(spark, sf_dir).withColumn("place", F.col("pos"))).select("person_id", "work_id")


@query(f"select work_id, arg_min(url, lpad(cast(rank * 1000 + pos as varchar), 8, '0') || url) as url, min(rank) as rank from (select *, case when regexp_matches(url, '{T.OPEN_HOSTS}', 'i') then 0 when regexp_matches(url, '{T.PUBLISHERS}', 'i') then 2 else 1 end as rank from ({sql('locations')})) group by work_id")
def w8_one_address(spark, sf_dir):
    return works.one_address(table(spark, sf_dir, "locations"))


TRIES = "select o_custkey as person_id, o_orderkey as place, o_orderkey % 3 = 0 as ok, o_orderkey % 4 = 0 as robot from {orders}"


@query(f"with t as ({TRIES.format(orders='orders')}), b as (select *, coalesce(sum(case when ok then 1.0 else 0.5 end) over w, 0) as cost, count(*) over w as tried from t window w as (partition by person_id order by place rows between unbounded preceding and 1 preceding)) select person_id, place from b where cost < 8 and tried < 16")
def w9_read_budget(spark, sf_dir):
    return works.within_budget(spark.sql(TRIES, orders=_read(spark, sf_dir, "orders"))).select("person_id", "place")


@query(f"with t as (select *, person_id % 3 as earlier, place % 5 = 0 as v from ({TRIES.format(orders='orders')})), b as (select *, earlier + coalesce(sum(v::int) over w, 0) as known, row_number() over (partition by person_id order by place) as rn from t window w as (partition by person_id order by place rows between unbounded preceding and 1 preceding)) select person_id, place from b where rn = 1 or known < 2")
def w10_early_stop(spark, sf_dir):
    reads = spark.sql(TRIES, orders=_read(spark, sf_dir, "orders")).withColumn("earlier", F.col("person_id") % 3).withColumn("verified", (F.col("place") % 5 == 0).cast("int"))
    return works.early_stop(reads).select("person_id", "place")


@query("with d as (select o_orderkey as doi, o_orderkey % 4 as k from orders) select cast(doi as varchar) as doi, case k when 0 then 'a1 a2' when 1 then 'b' when 2 then 'c1' else '' end as urls from d")
def s10_fallback_pdfs(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doi"), (F.col("o_orderkey") % 4).alias("k"))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    out = works.fallback_pdfs(o.select("doi"), o.where("k = 0").select("doi", words("a1", "a2", "a1", "").alias("urls")), o.where("k < 2").select("doi", F.lit("b").alias("url")), o.where("k < 3").select("doi", words("c1").alias("urls")))
    return out.select("doi", F.array_join("urls", " ").alias("urls"))


# ---- sources


def _folder(spark):
    from uuid import uuid4

    from ..operators.store import shared_folder

    return f"{shared_folder(spark)}/files-{uuid4().hex}"


@query(f"select concat(name, chr(10), 'and \"quoted\"') as name, affiliation, case when trim(field) = '/' then 'general' else trim(field) end as field from ({sql('people')}) where person_id % 5 > 0")
def s1_people_file(spark, sf_dir):
    """Written as CSV with a byte order mark, quotes, line breaks and a header that comes twice, and read again."""
    p = table(spark, sf_dir, "people")
    name = F.when(F.col("person_id") % 5 > 0, F.concat("name", F.lit('\nand "quoted"'))).otherwise("")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.col("person_id").cast("string"), F.lit("old"), F.concat(F.lit(" "), "affiliation"), F.when(F.col("field") != "/", F.col("field")).otherwise(" "), name]
    head = F.lit("\ufeffno,이름,소속,분야,이름\n")
    files = p.groupBy((F.col("person_id") % 7).alias("file")).agg(F.concat(head, F.array_join(F.collect_list(F.concat_ws(",", *[quoted(c) for c in cells])), "\n")).alias("value"))  # a file of a bounded share each
    path = _folder(spark)
    files.write.partitionBy("file").text(path)
    return records.read_people(spark, f"{path}/*", "general")


@query(f"select person_id, case when person_id % 5 = 0 then 'name missing' when person_id % 7 = 0 then 'affiliation missing' else '' end as code from ({sql('people')})")
def s2_reject_codes(spark, sf_dir):
    p = table(spark, sf_dir, "people").withColumn("n", F.when(F.col("person_id") % 5 > 0, F.col("name")).otherwise("")).withColumn("a", F.when(F.col("person_id") % 7 > 0, F.col("affiliation")).otherwise(""))
    return p.select("person_id", records.reject_code(F.col("n"), F.col("a")).alias("code"))


@query(f"select org_id as ror, name as display_name, website, lower(split_part(website, '/', 3)) as domain from ({sql('orgs')})")
def s3_summarize_orgs(spark, sf_dir):
    typed = lambda v, t: F.struct(F.col(v).alias("value"), F.array(F.lit(t)).alias("types"))
    raw = table(spark, sf_dir, "orgs").select(F.col("org_id").alias("id"), F.array(typed("short_name", "acronym"), typed("name", "ror_display")).alias("names"), F.array(F.struct(F.lit("wiki").alias("type"), F.lit("x").alias("value")), F.struct(F.lit("website").alias("type"), F.col("website").alias("value"))).alias("links"), F.array(F.upper(F.split_part("website", F.lit("/"), F.lit(3)))).alias("domains"))
    return records.summarize_orgs(raw).select("ror", "display_name", "website", F.col("domains")[0].alias("domain"))


@query(f"select person_id as record_id, 0 as pos, email, 'record' as origin from ({sql('hits')}) where source = 'html' union all select person_id, 1, email, 'biography' from ({sql('hits')}) where source = 'pdf'")
def s4_record_emails(spark, sf_dir):
    h = table(spark, sf_dir, "hits")
    both = h.where("source = 'html'").select("person_id", F.col("email").alias("own")).join(h.where("source = 'pdf'").select("person_id", F.col("email").alias("other")), "person_id")
    return records.record_emails(both.select(F.col("person_id").alias("record_id"), F.array(F.upper("own")).alias("emails"), F.concat(F.lit("Now at "), "own", F.lit(", then "), "other", F.lit(".")).alias("biography")))


@query("select l_orderkey, l_linenumber, case when l_returnflag = 'R' then concat('https://best/', l_partkey, ' ', 'https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=', l_suppkey) else concat('https://best/', l_partkey) end as urls from lineitem")
def s5_pdf_urls(spark, sf_dir):
    best = F.concat(F.lit("https://best/"), "l_partkey")
    none = F.lit(None).cast("string")
    place = F.struct(none.alias("pdf_url"), F.concat(F.lit("https://ieeexplore.ieee.org/document/"), "l_suppkey").alias("landing_page_url"), (F.col("l_returnflag") == "R").alias("is_oa"))
    again = F.struct(best.alias("pdf_url"), none.alias("landing_page_url"), F.lit(True).alias("is_oa"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(records.pdf_urls(best, F.array(again, place)), " ").alias("urls"))


@query(f"with c as (select s_suppkey as corp_code, case when s_suppkey % 3 = 0 then '' else 'L' end as stock_code, name as corp_name from supplier join ({sql('orgs')}) on org_id = s_suppkey), a as (select distinct affiliation from ({sql('people')})) select affiliation, corp_code from (select affiliation, corp_code, row_number() over (partition by affiliation order by stock_code = '', lpad(cast(corp_code as varchar), 8, '0')) as r from a join c on {_key('affiliation')} = {_key('corp_name')}) where r = 1")
def s6_match_company(spark, sf_dir):
    """The companies are written as XML and read again, with one that has no name."""
    listed = table(spark, sf_dir, "orgs").select(F.lpad(F.col("org_id").cast("string"), 8, "0").alias("corp_code"), F.when(F.col("org_id") % 3 == 0, " ").otherwise("L").alias("stock_code"), F.col("name").alias("corp_name"))
    path = _folder(spark)
    listed.unionByName(listed.limit(1).withColumn("corp_name", F.lit(" "))).write.format("xml").option("rootTag", "result").option("rowTag", "list").save(path)
    companies = records.read_companies(spark, path)
    return records.match_company(table(spark, sf_dir, "people").select("affiliation").distinct(), companies).select("affiliation", F.col("corp_code").cast("long").alias("corp_code"))


@query("with r as (select case when l_orderkey % 2 = 0 then concat('10.1101/', l_orderkey) else concat('10.9/', l_orderkey) end as doi, l_suppkey % 2 as server_rank, l_linenumber as version, l_returnflag <> 'N' as has_jats from lineitem), l as (select * from r where starts_with(doi, '10.1101/') qualify row_number() over (partition by doi, server_rank order by version desc, has_jats desc) = 1) select doi, server_rank, version, concat('content/', doi, 'v', version) as path from l where has_jats qualify row_number() over (partition by doi order by server_rank) = 1")
def s9_latest_preprint(spark, sf_dir):
    raw = _read(spark, sf_dir, "lineitem").select(F.concat(F.when(F.col("l_orderkey") % 2 == 0, "10.1101/").otherwise("10.9/"), "l_orderkey").alias("doi"), (F.col("l_suppkey") % 2).alias("server_rank"), F.col("l_linenumber").alias("position"), F.col("l_linenumber").alias("version"), (F.col("l_returnflag") != "N").alias("has_jats"))
    return records.latest_preprint(raw)


@query('''with n as (select max(ts) as now from events), l as (select concat(case when user_id % 4 = 0 then 'pdf:' else 'page:' end, user_id, event_type) as key, case when event_id % 3 > 0 then props end as json, ts as "at" from events),
    k as (select *, row_number() over (partition by key order by "at" desc, json desc nulls last) as r from l where json is not null or not starts_with(key, 'pdf:')) select key, json, "at" from k, n where r = 1 and epoch(now) - epoch("at") <= 86400''')
def s14_latest_responses(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 4 == 0, "pdf:").otherwise("page:")
    log = e.select(F.concat(kind, "user_id", "event_type").alias("key"), F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("json"), F.col("ts").alias("at"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return records.latest_responses(log.crossJoin(F.broadcast(now)), 86400)


# ---- report

STATUS = f"select p.person_id, count(distinct email) as n_addresses, count(distinct email) filter (where verified) as n_verified from ({sql('people')}) p left join (select *, verification in ('record', 'official domain') as verified from ({VERIFIED})) h using (person_id) group by all"
STATE = "case when n_verified > 0 then 'verified' when n_addresses > 0 then 'unverified' else 'not found' end"


def _hits(spark, sf_dir):
    hits = evidence.ranked(evidence.verify(table(spark, sf_dir, "hits"), table(spark, sf_dir, "domains")))
    place = F.when((F.col("source") == "pdf") & (F.col("person_id") % 4 == 0), "").otherwise(F.concat(F.lit("https://files.example/"), "source", F.lit("/"), "person_id"))
    quote = F.when(F.col("rn") > 1, F.concat(F.lit("... "), "email")).otherwise("")
    return hits.withColumns({"source_url": place, "document_id": F.concat(F.lit("d"), "person_id"), "attribution": F.concat(F.lit("of strength "), "strength"), "snippet": quote})


@query(f"select *, {STATE} as status from ({STATUS})")
def a2_statuses(spark, sf_dir):
    return report.statuses(table(spark, sf_dir, "people"), _hits(spark, sf_dir))


@query(f"select count(*) as people, count(*) filter (where n_addresses > 0) as with_address, count(*) filter (where n_verified > 0) as with_verified from ({STATUS})")
def a1_counts(spark, sf_dir):
    return report.counts(report.statuses(table(spark, sf_dir, "people"), _hits(spark, sf_dir)))


IDS = "select person_id, kind, url from (select c_custkey as person_id, unnest(['registry', 'author', 'record']) as kind, unnest([concat('https://reg.example/', c_custkey % 50), concat('https://aut.example/a', c_custkey), concat('https://rec.example/', c_custkey)]) as url, unnest([2, 3, 5]) as every from customer) where person_id % every = 0"
PAGES = "select person_id, pos, url, source from (select c_custkey as person_id, unnest([0, 1, 2, 12]) as pos, unnest(['https://www.one.example/x', concat('http://two.example:80/', c_custkey % 7), 'https://www.one.example/x', 'me.example']) as url, unnest(['registry', 'company', 'institution', 'researcher record']) as source, unnest([2, 1, 3, 4]) as every from customer) where person_id % every = 0"


def _found(spark, sf_dir):
    """What reports are made of: findings, identifiers, domains and home pages of all derived people."""
    key = F.col("c_custkey")
    customer = _read(spark, sf_dir, "customer")
    listed = lambda name, *rows: customer.select(key.alias("person_id"), F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) if isinstance(v, (str, int)) else v.alias(n) for n, v in r.items()]) for r in rows])).alias(name)).select("person_id", f"{name}.*").where("person_id % every = 0").drop("every")
    ids = listed("x", {"kind": "registry", "url": F.concat(F.lit("https://reg.example/"), key % 50), "every": 2}, {"kind": "author", "url": F.concat(F.lit("https://aut.example/a"), key), "every": 3}, {"kind": "record", "url": F.concat(F.lit("https://rec.example/"), key), "every": 5})
    one = F.lit("https://www.one.example/x")
    pages = listed("x", {"pos": 0, "url": one, "source": "registry", "every": 2}, {"pos": 1, "url": F.concat(F.lit("http://two.example:80/"), key % 7), "source": "company", "every": 1}, {"pos": 2, "url": one, "source": "institution", "every": 3}, {"pos": 12, "url": F.lit("me.example"), "source": "researcher record", "every": 4})
    domains = table(spark, sf_dir, "domains").select("person_id", F.lit(0).alias("place"), "domain", F.array(F.lit("registry"), F.lit("company")).alias("sources"))
    found = report.findings(table(spark, sf_dir, "people"), _hits(spark, sf_dir))
    return report.with_lists(found, report.id_lists(ids), report.domain_lists(domains), report.page_lists(pages))


LABEL = "case source when 'pdf' then 'open document (PDF)' else 'open document (page)' end"
SURE_OF = "verification in ('record', 'official domain')"
REPORTED = f"""h as (select person_id, email, source, verification, {SURE_OF} as verified, case when source = 'pdf' and person_id % 4 = 0 then '' else concat('https://files.example/', source, '/', person_id) end as source_url, concat('of strength ', strength) as attribution, row_number() over (partition by person_id order by {SURE_OF} desc, strength, email, source) as rn from ({VERIFIED})),
    b as (select * from h where rn = 1), m as (select person_id, email, min(rn) as rn, arg_min(verified, rn) as verified from h group by all),
    o as (select m.person_id, string_agg(m.email, '; ' order by m.rn) filter (where m.email <> b.email) as others, string_agg(concat(m.email, case when m.verified then '' else ' (unverified)' end, ' <mailto:', m.email, '>'), '; ' order by m.rn) as emails from m join b using (person_id) group by 1),
    u as (select person_id, string_agg(concat({LABEL}, ' <', source_url, '>'), '; ' order by rn) as sources from (select person_id, source, source_url, min(rn) as rn from h where source_url <> '' group by all) group by 1),
    i as (select person_id, string_agg(concat(kind, ' ', split_part(url, '/', 4), ' <', url, '>'), '; ' order by case kind when 'record' then 0 when 'author' then 1 else 2 end) as ids, max(url) filter (where kind = 'record') as record_id, max(url) filter (where kind = 'author') as author_id from ({IDS}) group by 1),
    g as (select *, row_number() over (partition by person_id order by pos) as nth from ({PAGES})),
    w as (select person_id, string_agg(t, '; ' order by p3) filter (where p3 is not null) as three, string_agg(f, '; ' order by p4) filter (where p4 is not null) as four from (
        select person_id, url, min(nth) filter (where nth <= 3) as p3, min(nth) filter (where nth <= 4) as p4, concat({{host}}, ' (', arg_max(source, nth) filter (where nth <= 3), ') <', url, '>') as t, concat({{host}}, ' (', arg_max(source, nth) filter (where nth <= 4), ') <', url, '>') as f from g group by person_id, url) group by 1),
    d as (select person_id, domain as domains, concat(domain, ' (registry·company)') as domains_by from ({sql('domains')})),
    p as (select person_id, name, affiliation, case when field = '' then null else field end as field from ({sql('people')})), s as (select person_id, {STATE} as status from ({STATUS}))""".replace("{host}", "regexp_replace(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '^www\\.|:80$', '', 'g')")
JOINED = "from p join s using (person_id) left join b using (person_id) left join o using (person_id) left join u using (person_id) left join i using (person_id) left join w using (person_id) left join d using (person_id)"


@query(f"with {REPORTED} select p.person_id, p.person_id as rank, name, affiliation, field, email as best, status, verification, case when email is not null then {LABEL} end as route, source_url, attribution, record_id, author_id, domains, (select arg_min(url, nth) from g where g.person_id = p.person_id) as homepage, others {JOINED}")
def a4_summary(spark, sf_dir):
    return report.summary(_found(spark, sf_dir))


def _flat(df, *links):
    """Lists of links as one text each."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: F.concat(x["text"], F.lit(" <"), x["url"], F.lit(">"))), "; ") for c in links})


@query(f"with {REPORTED} select p.person_id, p.person_id as rank, name, affiliation as affil, field, emails as email, status, sources as source, attribution, ids, domains, three as homepage {JOINED}")
def a3_links(spark, sf_dir):
    return _flat(report.table_rows(_found(spark, sf_dir)), "email", "source", "ids", "homepage")


CARDS = f"""v as (select person_id, string_agg(concat(email, ': ', verification), '; ' order by rn) as verification_all from (select person_id, email, verification, min(rn) as rn from h group by all) group by 1),
    a as (select person_id, string_agg(concat(email, ': ', attribution), '; ' order by rn) as attribution_all from (select person_id, email, attribution, min(rn) as rn from h group by all) group by 1), q as (select person_id, concat('... ', arg_min(email, rn)) as snippet from h where rn > 1 group by 1)"""


@query(f"with {REPORTED}, {CARDS} select p.person_id, name, affiliation as affil, field, emails, verification_all as verification, attribution_all as attribution, sources as source, snippet, ids, concat(affiliation, ', ', 'Other Name') as affil_names, domains_by as domains, four as homepage, concat('- names · ', name, case when n_addresses > 0 then concat(chr(10), '- result · ', n_addresses) else '' end) as log {JOINED} left join v using (person_id) left join a using (person_id) left join q using (person_id) join ({STATUS}) using (person_id)")
def a5_cards(spark, sf_dir):
    asked = table(spark, sf_dir, "people")
    return _flat(report.cards(_found(spark, sf_dir), asked.select("person_id", F.array("affiliation", F.lit("Other Name")).alias("names")), _stages(spark, sf_dir)), "emails", "source", "ids", "homepage")


def _stages(spark, sf_dir):
    asked = table(spark, sf_dir, "people")
    result = report.statuses(asked, _hits(spark, sf_dir)).select("person_id", F.when(F.col("n_addresses") > 0, F.col("n_addresses").cast("string")).alias("text"))
    return report.stage_log([("names", asked.select("person_id", F.col("name").alias("text"))), ("result", result)])


@query(f"select person_id, cast(step as int) as step, text from (select person_id, 1 as step, concat('names · ', name) as text from ({sql('people')}) union all select person_id, 2, concat('result · ', n_addresses) from ({STATUS}) where n_addresses > 0)")
def a11_stage_log(spark, sf_dir):
    return _stages(spark, sf_dir)


BEST = f"select * from ({VERIFIED}) qualify row_number() over (partition by person_id order by verification in ('record', 'official domain') desc, strength, email, source) = 1"
SURE = "case when verification in ('record', 'official domain') then 'verified' else 'unverified' end"
ROUTE = LABEL


@query(f"select p.person_id, concat('| ', p.person_id, ' | ', name, ' | ', affiliation, ' | ', coalesce(email, '-'), ' | ', case when email is null then '-' else {SURE} end, ' | ', case when email is null then '-' else {ROUTE} end, ' | ', case when email is null then '-' else concat('of strength ', strength) end, ' |') as line from ({sql('people')}) p left join ({BEST}) b on b.person_id = p.person_id")
def a9_lines(spark, sf_dir):
    return report.markdown_rows(table(spark, sf_dir, "people"), _hits(spark, sf_dir))


@query(f"select p.person_id, concat('- ', name, ' (', affiliation, '): ', case when email is not null then concat(email, ' [', {SURE}, ' · ', {ROUTE}, ']') when o.domain is null then 'no address in open sources' else concat('no address in open sources · official domains ', o.domain) end) as line from ({sql('people')}) p left join ({BEST}) b on b.person_id = p.person_id left join ({sql('domains')}) o on o.person_id = p.person_id")
def a6_answer_lines(spark, sf_dir):
    domains = table(spark, sf_dir, "domains").select("person_id", F.lit(0).alias("place"), "domain", F.array(F.lit("registry")).alias("sources"))
    return report.answer_lines(table(spark, sf_dir, "people"), _hits(spark, sf_dir), report.domain_lists(domains))


@query(f"select person_id, row_number() over (partition by person_id order by verification in ('record', 'official domain') desc, strength, email, source) as rn, case when verification in ('record', 'official domain') then email else concat(email, ' (unverified)') end as address, concat('mailto:', email) as link, case source when 'pdf' then 'open document (PDF)' else 'open document (page)' end as route, verification from ({VERIFIED})")
def a8_detail(spark, sf_dir):
    return report.detail(_hits(spark, sf_dir)).withColumn("rn", F.col("rn").cast("long"))


@query(f"with t as (select person_id, place, case when ok then 'http 403' when robot then 'robot page' else concat('http 5', place % 2) end as reason from ({TRIES.format(orders='orders')})), n as (select person_id, reason, count(*) as n, min(place) as f from t group by all) select person_id, row_number() over (partition by person_id order by n desc, f) as nth, reason, n from n qualify row_number() over (partition by person_id order by n desc, f) <= 3")
def a10_failure_reasons(spark, sf_dir):
    reason = F.when(F.col("ok"), "http 403").when(F.col("robot"), "robot page").otherwise(F.concat(F.lit("http 5"), F.col("place") % 2))
    return report.failure_reasons(spark.sql(TRIES, orders=_read(spark, sf_dir, "orders")).withColumn("reason", reason)).withColumn("nth", F.col("nth").cast("long"))


# ---- articles, proximity, domains, order


def _article_parts() -> str:
    from .snapshot import GIVEN, LOCAL, SURNAME

    (g, h), s = GIVEN, SURNAME
    return f"select c_custkey as doc_id, concat({g}, ' ', {h}) as given, {s} as surname, concat({LOCAL}, '@lab.example') as email, c_custkey % 4 as kind from {{customer}}"


ARTICLE = """select doc_id, kind, given, surname, email, concat('<article xmlns="urn:x"><contrib-group><contrib contrib-type="author"', case when kind = 3 then ' corresp="yes"' else '' end, '><name><surname>', surname, '</surname><given-names>', given, '</given-names></name>',
    case when kind = 0 then concat('<email>', email, '</email>') else '' end, case when kind in (1, 2) then '<xref ref-type="corresp" rid="c1"/>' else '' end, '</contrib><contrib><string-name>Una Vexley</string-name>', case when kind = 2 then '<xref ref-type="corresp" rid="c1"/>' else '' end,
    '</contrib><contrib contrib-type="editor"><string-name>Ed Itor</string-name><email>ed@lab.example</email></contrib></contrib-group><author-notes><corresp id="c1">Write to ', email, case when kind = 2 then ' or uvexley@lab.example' else '' end, '</corresp></author-notes></article>') as xml from ({parts})"""


@query(f"""with p as ({_article_parts().format(customer='customer')}) select doc_id, 0 as no, concat(given, ' ', surname) as name, kind > 0 as corresp, email as emails from p
    union all select doc_id, 1, 'Una Vexley', kind = 2, case when kind = 2 then 'uvexley@lab.example' else '' end from p""")
def j9_author_notes(spark, sf_dir):
    from ..sources.jats import author_emails, parse_jats

    articles = spark.sql(ARTICLE.format(parts=_article_parts()), customer=_read(spark, sf_dir, "customer"))
    return author_emails(settle(parse_jats(articles))).select("doc_id", "no", "name", "corresp", F.array_join("emails", " ").alias("emails"))


@query(f"with p as ({_article_parts().format(customer='customer')}) select 'author' as kind, 2 * count(*) as n from p union all select 'email', count(*) from p where kind = 0 union all select 'xref', count(*) + count(*) filter (where kind = 2) from p where kind in (1, 2) union all select 'note', count(*) from p union all select 'note_email', count(*) + count(*) filter (where kind = 2) from p")
def s11_parse_jats(spark, sf_dir):
    from ..sources.jats import parse_jats

    articles = spark.sql(ARTICLE.format(parts=_article_parts()), customer=_read(spark, sf_dir, "customer"))
    return parse_jats(articles).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"select person_id, source, person_id % 2 = 0 and person_id % 3 > 0 as theirs from ({sql('hits')})")
def e9_proximity(spark, sf_dir):
    from ..operators.proximity import attributed_by_proximity

    rows = table(spark, sf_dir, "hits").join(table(spark, sf_dir, "people").select("person_id", "name"), "person_id")
    who = F.when(F.col("person_id") % 2 == 0, F.col("name")).otherwise("someone else")
    text = F.concat(F.lit("Written by "), who, F.when(F.col("person_id") % 3 == 0, " with Maria Stone").otherwise(""), F.lit(" <"), "email", F.lit(">, x@lab.example"))
    return rows.select("person_id", "source", attributed_by_proximity(text, F.col("email"), F.array("name")).alias("theirs"))


#: What expand() is given: every organisation is in the registry by both its names, every second one an institution by the long one, with a registry id of another.
EXPANDED = f"""o as ({sql('orgs')}), af as (select distinct affiliation from ({sql('people')})), ex as (select name as affiliation, o as seed from (select name, {OUT} as o from (select affiliation as name from af)) where o <> '' and {_key('o')} <> {_key('name')}),
    seeds as (select affiliation, seed, min(rank) as rank from (select affiliation, affiliation as seed, 0 as rank from af union all select affiliation, seed, 3 from ex) group by all),
    said as (select cast(org_id as varchar) as ror, name as spelling, 0 as kind from o union all select cast(org_id as varchar), short_name, 1 from o),
    sx as (select distinct seed as a, {_key('seed')} as ka, {_words('seed')} as ta from seeds), sy as (select distinct spelling as b, {_key('spelling')} as kb, {_words('spelling')} as tb from said), sm as (select a, b from sx, sy where ka <> '' and (ka = kb or {TOKEN_RULE})),
    rec as (select affiliation, split_part(min(lpad(cast(rank as varchar), 2, '0') || cast(kind as varchar) || '|' || ror), '|', 2) as ror from seeds join sm on a = seed join said on spelling = b group by 1),
    known as (select affiliation, seed, rank from seeds union all select affiliation, spelling, 4 from rec join said using (ror)),
    kx as (select distinct seed as a, {_key('seed')} as ka, {_words('seed')} as ta from known), ky as (select distinct name as b, {_key('name')} as kb, {_words('name')} as tb from o where org_id % 2 = 0), km as (select a, b from kx, ky where ka <> '' and (ka = kb or {TOKEN_RULE})),
    pl as (select affiliation, split_part(min(lpad(cast(rank as varchar), 2, '0') || '|' || lpad(cast(org_id as varchar), 8, '0')), '|', 2) as iid from known join km on a = seed join o on o.name = b and org_id % 2 = 0 group by 1)"""
HOST = "regexp_replace(split_part(website, '/', 3), '^www\\.', '')"


def _expanded(spark, sf_dir):
    from ..operators import affiliations

    orgs = table(spark, sf_dir, "orgs")
    registry = orgs.select(F.col("org_id").cast("string").alias("ror"), F.col("name").alias("display_name"), F.array("short_name").alias("names"), "website", F.array(O.host_of(F.col("website"))).alias("domains"))
    places = orgs.where("org_id % 2 = 0").select(F.lpad(F.col("org_id").cast("string"), 8, "0").alias("institution_id"), F.col("name").alias("display_name"), F.array().cast("array<string>").alias("names"), F.concat(F.lit("https://place.example/"), "org_id").alias("homepage"), F.lit(None).cast("string").alias("ror"))
    none = lambda schema: spark.createDataFrame([], schema)
    companies, entities = none("affiliation string, corp_name string, english_name string, website string"), none("affiliation string, label string, sites array<string>")
    return affiliations.expand(table(spark, sf_dir, "people").select("affiliation"), companies, entities, registry, places, _aliases(spark))


@query(f"""with {EXPANDED}, nm as (select affiliation, name, min(nth) as nth from (select affiliation, short_name as name, 30 as nth from rec join o on cast(org_id as varchar) = ror union all select affiliation, name, 40 from pl join o on lpad(cast(org_id as varchar), 8, '0') = iid) where name <> affiliation group by all)
    select af.affiliation, rec.ror, string_agg(nm.name, '; ' order by nth) as names from af left join rec using (affiliation) left join nm on nm.affiliation = af.affiliation and (regexp_matches(nm.name, '[^\\x00-\\x7F]') or length(regexp_replace(nm.name, '[^A-Za-z]', '', 'g')) >= 4) group by all""")
def j1_expand_affiliations(spark, sf_dir):
    names = F.array_join("names", "; ")
    return _expanded(spark, sf_dir).select("affiliation", "ror", F.when(names != "", names).alias("names"))


@query(f"""with {EXPANDED}, dm as (select affiliation, {HOST} as domain, -1 as pos, 'registry' as source from rec join o on cast(org_id as varchar) = ror union all select affiliation, {HOST}, 2, 'registry' from rec join o on cast(org_id as varchar) = ror union all select affiliation, 'place.example', 3, 'institution' from pl)
    select affiliation, domain, string_agg(distinct source, ',') as sources from dm group by all""")
def j2_official_domains(spark, sf_dir):
    from ..operators import affiliations

    return affiliations.official_domains(_expanded(spark, sf_dir)).select("affiliation", "domain", F.array_join("sources", ",").alias("sources"))


@query(f"select distinct affiliation, concat('Q', affiliation) as entity_id, affiliation as label, 'http://one.example; https://two.example' as sites from ({sql('people')}) where length(affiliation) % 4 <> 1")
def s7_pick_entity(spark, sf_dir):
    from ..operators import affiliations

    own = table(spark, sf_dir, "people").select("affiliation").distinct()
    cue = F.when(F.length("affiliation") % 4 == 1, "a song").otherwise("public university in the north")
    row = lambda rank, key, label, said: F.struct(F.lit(rank).alias("hit_rank"), key.alias("entity_id"), label.alias("label"), said.alias("description"), F.lit("").alias("matched"))
    name = F.col("affiliation")
    hits = own.select("affiliation", F.explode(F.array(row(0, F.lit("Q0"), F.lit("Unrelated Academy"), F.lit("an academy")), row(1, F.concat(F.lit("Q"), name), name, cue), row(2, F.lit("Q9"), F.upper(name), F.lit("a song")))).alias("x")).select("affiliation", "x.*")
    sites = own.select(F.concat(F.lit("Q"), name).alias("entity_id"), F.posexplode(F.array(F.lit("ftp://no.example"), F.lit("http://one.example"), F.lit("http://one.example"), F.lit("https://two.example"), F.lit("https://three.example"))).alias("pos", "url"))
    return affiliations.pick_entity(hits, sites, _aliases(spark)).select("affiliation", "entity_id", "label", F.array_join("sites", "; ").alias("sites"))


@query(f"select person_id from ({sql('people')}) order by person_id limit 50")
def w13_run_limit(spark, sf_dir):
    return table(spark, sf_dir, "people").select("person_id").orderBy("person_id").limit(records.MAX_PEOPLE)


@query(f"select person_id, status from (select *, {STATE} as status from ({STATUS})) where n_addresses = 0")
def j15_people_without_evidence(spark, sf_dir):
    return report.statuses(table(spark, sf_dir, "people"), _hits(spark, sf_dir)).where("n_addresses = 0").select("person_id", "status")


@query(f"with {REPORTED} select p.person_id, name, status, email as best {JOINED}")
def a7_responses(spark, sf_dir):
    out = report.responses(report.summary(_found(spark, sf_dir))).select("person_id", F.from_json("json", "name string, status string, best string, notice string").alias("j")).where("j.notice is not null")
    return out.select("person_id", "j.name", "j.status", "j.best")


@query(f"with {REPORTED}, f as (select person_id from ({sql('people')}) order by person_id limit 50) select p.person_id as rank, name, status, emails as email, domains, 'rank,name,affil,field,email,status,source,attribution,ids,domains,homepage' as fields, 'table' as type {JOINED} where p.person_id in (select person_id from f)")
def a7_nested(spark, sf_dir):
    first = table(spark, sf_dir, "people").orderBy("person_id").limit(records.MAX_PEOPLE)
    found = _found(spark, sf_dir).join(first.select("person_id"), "person_id", "left_semi")
    status = report.statuses(first, _hits(spark, sf_dir).join(first.select("person_id"), "person_id", "left_semi"))
    lines = first.select("person_id", F.col("name").alias("line"))
    cards = report.cards(found, first.select("person_id", F.array("affiliation").alias("names")), status.select("person_id", F.lit(1).alias("step"), F.col("status").alias("text")))
    doc = report.nested(report.answer(status, lines), report.table_rows(found), cards)
    link = "array<struct<text: string, url: string>>"
    shape = f"email_table struct<type: string, data: array<struct<order: array<string>, rows: array<struct<rank: bigint, name: string, status: string, email: {link}, domains: string>>>>>"
    part = doc.select(F.from_json("json", shape).alias("j")).select("j.email_table.type", F.col("j.email_table.data")[0].alias("d")).select("type", F.array_join("d.order", ",").alias("fields"), F.explode("d.rows").alias("r"))
    return _flat(part.select("r.*", "fields", "type"), "email")


def _spelled_sql(c: str, out: str) -> str:
    """A CTE of the four first spellings of the syllable at place c of its block: p_partkey, word, nth."""
    return f"""{out}_s as (select p_partkey, x, y, z, i, j, k from (select p_partkey, {_sounds(N.INITIALS, N.INITIAL_SPELLINGS, f'{c} // 588')} as a, {_sounds(N.MEDIALS, N.MEDIAL_SPELLINGS, f'({c} % 588) // 28')} as b, {_sounds(N.FINALS, N.FINAL_SPELLINGS, f'{c} % 28')} as d from l)
      , lateral (select unnest(a) as x, unnest(range(len(a))) as i), lateral (select unnest(b) as y, unnest(range(len(b))) as j), lateral (select unnest(d) as z, unnest(range(len(d))) as k)),
    {out} as (select p_partkey, w, row_number() over (partition by p_partkey order by o) - 1 as nth from (select p_partkey, concat(x, y, z) as w, min(i * 100 + j * 10 + k) as o from {out}_s group by all) qualify nth < 4)"""


#: Surnames of all kinds: those with spellings in use, in turn, and for every fifth name a syllable that has none.
SURNAME_LIST = "[" + ", ".join(f"'{k}'" for k in N.SURNAMES) + "]"
SURNAME_MAP = "map {" + ", ".join(f"'{k}': {_list(v)}" for k, v in N.SURNAMES.items()) + "}"


@query(f"""with l as (select p_partkey, case when p_partkey % 5 = 0 then chr(cast(44032 + (p_partkey * 31) % 11172 as int)) else {SURNAME_LIST}[cast(p_partkey % {len(N.SURNAMES)} + 1 as int)] end as sur, (p_partkey * 7) % 11172 as c, (p_partkey * 13 + 5) % 11172 as e, (p_partkey * 31) % 11172 as u from part), {_spelled_sql('c', 'g')}, {_spelled_sql('e', 'h')}, {_spelled_sql('u', 's')},
    k as (select l.p_partkey, coalesce({SURNAME_MAP}[sur], [concat(upper(s.w[1]), s.w[2:])]) as known from l join s on s.p_partkey = l.p_partkey and s.nth = 0),
    f as (select p_partkey, unnest([concat(upper(g.w[1]), g.w[2:], h.w, ' ', known[1]), concat(upper(g.w[1]), g.w[2:], ' ', upper(h.w[1]), h.w[2:], ' ', known[1])]) as form, (g.nth + h.nth) * 1000 + (g.nth * 4 + h.nth) * 10 + unnest([0, 1]) as o from g join h using (p_partkey) join k using (p_partkey)),
    d as (select p_partkey, form, row_number() over (partition by p_partkey order by o) as r from (select p_partkey, form, min(o) as o from f group by all)),
    b as (select p_partkey, unnest(known[2:]) as other, unnest(range(len(known) - 1)) as i from k),
    e as (select * from d where r <= 16 union all select p_partkey, concat(g.w[1].upper(), g.w[2:], h.w, ' ', other), 17 + i from b join g using (p_partkey) join h using (p_partkey) where g.nth = 0 and h.nth = 0),
    n as (select *, row_number() over (partition by p_partkey order by r) as q from e)
    select p_partkey, string_agg(form, '|' order by q) as forms from n where q <= 16 group by p_partkey""")
def n5_romanized(spark, sf_dir):
    rows = _korean(spark, sf_dir)
    return rows.join(N.romanize(rows, "name"), "name").select("p_partkey", F.array_join("forms", "|").alias("forms"))


def _korean(spark, sf_dir):
    """Derived Hangul names of three syllables."""
    key = F.col("p_partkey")
    letter = lambda times, plus: N.hangul(F.pmod(key * times + plus, F.lit(N.SYLLABLES)) + 0xAC00)
    usual = F.element_at(F.array(*[F.lit(k) for k in N.SURNAMES]), (F.pmod(key, F.lit(len(N.SURNAMES))) + 1).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(key % 5 == 0, letter(31, 0)).otherwise(usual), F.lit(" "), letter(7, 0), letter(13, 5)).alias("name"))


def _bibliography() -> str:
    from .snapshot import LOCAL, _styled

    return f"select distinct concat('10.9999/a', cast(o_orderkey % 4000 as varchar(9))) as key, {_styled('c_custkey + 2')} as author, concat({LOCAL}, '@lab.example') as email from {{orders}} join {{customer}} on o_custkey = c_custkey where o_orderkey % 5 > 0"


#: The works of this query share their DOIs, so that a record has the authors of many orders.
SHARED_WORKS = "select o_custkey * 10 as author_id, o_orderkey as work_id, case when o_orderkey % 5 > 0 then concat('https://doi.org/10.9999/A', cast(o_orderkey % 4000 as varchar(9))) end as doi, year(o_orderdate) as year, o_orderpriority as title from {orders}"


@query(f"""{WORKS.replace(sql('works'), SHARED_WORKS.format(orders='orders'))}, b as ({_bibliography().format(orders='orders', customer='customer')}), q as (select person_id, name from ({sql('people')})), m as ({ORACLES['n2_match_names']})
    select distinct p.person_id, p.key, b.email, 'bibliography' as source from p join b using (key) join q on q.person_id = p.person_id join m on m.name = q.name and m.display_name = b.author""")
def j8_bibliographic_evidence(spark, sf_dir):
    authors = spark.sql(_bibliography(), orders=_read(spark, sf_dir, "orders"), customer=_read(spark, sf_dir, "customer"))
    shared = spark.sql(SHARED_WORKS, orders=_read(spark, sf_dir, "orders"))
    own = works.works_of(spark.sql(LINKED, customer=_read(spark, sf_dir, "customer")), shared)
    return evidence.by_author(own, authors, table(spark, sf_dir, "people").select("person_id", "name"), "bibliography")


# ---- records, forms and employers


@query(f"""select person_id, i as form_rank, form, guessed from (select person_id, guessed, unnest(l) as form, unnest(range(len(l))) as i from (select person_id, false as guessed, string_split(forms, '|') as l from ({_forms_sql()})
    union all select p_partkey + 10000000, true, string_split(forms, '|') from ({ORACLES['n5_romanized']})))""")
def n7_name_forms(spark, sf_dir):
    asked = table(spark, sf_dir, "people").select("person_id", F.array("name").alias("names"))
    other = _korean(spark, sf_dir).select((F.col("p_partkey") + 10000000).alias("person_id"), F.array("name", F.lit("한글")).alias("names"))
    return people.name_forms(asked.unionByName(other)).withColumn("form_rank", F.col("form_rank").cast("long"))


@query(f"select distinct o_custkey as person_id, regexp_replace(split_part(website, '/', 3), '^www\\.', '') as domain, 'employment' as source from orders join ({sql('orgs')}) on org_id = o_orderkey // 150 + 1 where o_orderkey % 3 > 0")
def j6_employer_domains(spark, sf_dir):
    from ..operators import affiliations

    jobs = _read(spark, sf_dir, "orders").selectExpr("o_custkey as person_id", "cast(o_orderkey div 150 + 1 as string) as org_id", "if(o_orderkey % 3 > 0, 'ROR', 'other') as id_source", "o_orderkey % 2 = 0 as current")
    registry = table(spark, sf_dir, "orgs").select(F.col("org_id").cast("string").alias("ror"), F.array(O.host_of(F.col("website"))).alias("domains"))
    return affiliations.employer_domains(jobs, registry)


@query("select o_orderkey as record_id, unnest(case when o_orderkey % 4 = 0 then [0] else [0, 1] end) as pos, unnest(case when o_orderkey % 4 = 0 then [concat('10.9/a', o_custkey)] else [concat('10.9/a', o_custkey), concat('10.9/b', o_orderkey % 4)] end) as doi from orders")
def s4_record_dois(spark, sf_dir):
    number = F.concat(F.lit("10.9/A"), "o_custkey")
    one = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    last = F.when(F.col("o_orderkey") % 4 == 0, F.lower(number)).otherwise(F.concat(F.lit("10.9/b"), F.col("o_orderkey") % 4))
    raw = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.array(one("doi", F.concat(F.lit("https://doi.org/"), number)), one("isbn", F.lit("7")), one("DOI", last)).alias("ids"))
    return records.record_dois(raw)


@query(f"select person_id as doi, 0 as pos, name as author, concat('Lab of ', affiliation, ', ', email) as affiliation, email, concat('https://europepmc.org/abstract/MED/', person_id) as url from ({sql('hits')}) join ({sql('people')}) using (person_id) where source = 'html'")
def s8_bibliography(spark, sf_dir):
    both = table(spark, sf_dir, "hits").where("source = 'html'").join(table(spark, sf_dir, "people"), "person_id")
    author = lambda name, *affils: F.struct(name.alias("name"), F.array(*affils).alias("affiliations"))
    authors = F.array(author(F.col("name"), F.concat(F.lit("Lab of "), "affiliation", F.lit(", "), "email")), author(F.lit("No Address"), F.lit("Lab")))
    result = lambda pmid: F.struct(pmid.alias("pmid"), authors.alias("authors"))
    raw = both.select(F.col("person_id").alias("doi"), F.array(result(F.col("person_id").cast("string")), result(F.lit("0"))).alias("results"))
    return records.flatten_bibliography(raw).select("doi", "pos", "author", "affiliation", F.col("emails")[0].alias("email"), "url")


@query(f"select person_id, run_date, best, email from (select s.person_id, unnest(['2026-01-01', '2026-01-02']) as run_date, best, email from ({{summary}}) s join ({{links}}) using (person_id)) where run_date = '2026-01-01' or person_id % 2 = 0".replace("{summary}", ORACLES["a4_summary"]).replace("{links}", ORACLES["a3_links"]))
def s15_write_reports(spark, sf_dir):
    """Two dates are written, the second one twice, and the tables read again."""
    found, path = settle(_found(spark, sf_dir)), _folder(spark)
    for date, rows in (("2026-01-01", found), ("2026-01-02", found), ("2026-01-02", found.where("person_id % 2 = 0"))):
        report.write({"summary": report.summary(rows), "table": report.table_rows(rows)}, path, date, kinds=("parquet",))
    both = spark.read.parquet(f"{path}/parquet/summary").select("person_id", "run_date", "best").join(_flat(spark.read.parquet(f"{path}/parquet/table").select("person_id", "run_date", "email"), "email"), ["person_id", "run_date"])
    return both.withColumn("run_date", F.col("run_date").cast("string"))


# ---- evidence of articles, documents and pages


def _person_sql() -> str:
    """person_id, name (given names, then the surname), surname, email: the derived identity in one style."""
    from .snapshot import GIVEN, LOCAL, SURNAME

    (g, h), s = GIVEN, SURNAME
    return f"select c_custkey as person_id, concat({g}, ' ', {h}, ' ', {s}) as name, {s} as surname, {LOCAL} as account from {{customer}}"


def _same_rows(rows: str, a: str, b: str) -> str:
    """The rows of a query whose two names can be one person's."""
    split = f"select *, {TOKENS.format(c=a)} as t_, {TOKENS.format(c=b)} as u_ from ({rows})"
    shared = f"select *, list_filter(t_, lambda x: length(x) > 1 and list_contains(u_, x)) as s_ from ({split})"
    rest = f"select *, list_filter(t_, lambda x: x <> s_[1]) as ra, list_filter(u_, lambda x: x <> s_[1]) as rb from ({shared})"
    full = f"(len({LONGS.format(r='ra')}) = 0 or len({LONGS.format(r='rb')}) = 0 or {LONGS.format(r='ra')} = {LONGS.format(r='rb')})"
    return f"select * exclude (t_, u_, s_, ra, rb) from ({rest}) where list_sort(t_) = list_sort(u_) or (len(s_) = 1 and len(ra) > 0 and len(rb) > 0 and (array_to_string(ra, '') = array_to_string(rb, '') or ({FIRSTS.format(r='ra')} = {FIRSTS.format(r='rb')} and {full})))"


READERS = "select person_id, doc_id from (select c_custkey as person_id, unnest([c_custkey, c_custkey + 1, c_custkey - c_custkey % 10]) as doc_id from customer) group by all"


def _readers(spark, sf_dir):
    """Each person's own article, the next one's, and that of the first of ten people, which so many share."""
    key = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(key.alias("person_id"), F.explode(F.array(key, key + 1, key - key % 10)).alias("key")).distinct()


@query(f"""with p as ({_article_parts().format(customer='customer')}), a as (select doc_id, concat(given, ' ', surname) as author, kind > 0 as corresp, email from p union all select doc_id, 'Una Vexley', true, 'uvexley@lab.example' from p where kind = 2)
    select person_id, doc_id as key, email, author, corresp, 'article' as source from ({_same_rows(f"select r.person_id, a.*, name from ({READERS}) r join a using (doc_id) join ({sql('people')}) q on q.person_id = r.person_id", "name", "author")})""")
def j10_article_evidence(spark, sf_dir):
    from ..sources.jats import author_emails, parse_jats

    articles = spark.sql(ARTICLE.format(parts=_article_parts()), customer=_read(spark, sf_dir, "customer"))
    authors = settle(author_emails(settle(parse_jats(articles)))).withColumnRenamed("doc_id", "key")
    return evidence.by_article(_readers(spark, sf_dir), authors, table(spark, sf_dir, "people").select("person_id", "name"), "article")


def _shared_document(spark, sf_dir):
    """url, kind, status, text: ten people and their addresses in each document."""
    who = spark.sql(_person_sql(), customer=_read(spark, sf_dir, "customer"))
    line = F.concat("name", F.lit(" <e"), "person_id", F.lit("@lab.example>"))
    rows = who.groupBy(F.floor(F.col("person_id") / 10).alias("d")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("person_id", line.alias("line")))), lambda x: x["line"]), "; ").alias("text"))  # ten at most
    return rows.select(F.concat(F.lit("https://d.example/"), "d").alias("url"), F.lit("pdf").alias("kind"), "text")


@query(f"""with p as ({_person_sql().format(customer='customer')}) select p.person_id, concat('https://d.example/', p.person_id // 10) as url, concat('e', q.person_id, '@lab.example') as email, 'place' as by, 'pdf' as source from p join p q on p.person_id // 10 = q.person_id // 10
    where contains(lower(q.name), lower(p.name)) or (length(p.surname) >= 4 and contains(lower(q.name), lower(p.surname)))""")
def j11_full_text_evidence(spark, sf_dir):
    who = spark.sql(_person_sql(), customer=_read(spark, sf_dir, "customer"))
    reads = who.select("person_id", F.concat(F.lit("https://d.example/"), F.floor(F.col("person_id") / 10)).alias("url"))
    found = evidence.by_full_text(reads, _shared_document(spark, sf_dir), who.select("person_id", F.array("name").alias("names")))
    return found.select("person_id", "url", "email", "by", "source")


@query(f"""with p as ({_person_sql().format(customer='customer')}) select person_id, concat('https://www.me', person_id, '.example/about') as url, concat(case when person_id % 3 = 0 then account else concat('x', person_id) end, '@own.example') as email, case when person_id % 3 = 0 then 'account' else 'page' end as by, 'homepage' as source
    from p where person_id % 5 > 0 and (person_id % 3 = 0 or person_id % 2 = 0)""")
def j12_home_page_evidence(spark, sf_dir):
    who = spark.sql(_person_sql(), customer=_read(spark, sf_dir, "customer"))
    key = F.col("person_id")
    url = lambda path: F.concat(F.lit("https://www.me"), key, F.lit(f".example/{path}"))
    urls = who.select("person_id", F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), url(path).alias("url")) for k, path in enumerate(("about", "gone", "third"))])).alias("x")).select("person_id", "x.*")
    local = F.when(key % 3 == 0, F.col("account")).otherwise(F.concat(F.lit("x"), key))
    html = F.concat(F.lit("<p>"), "name", F.lit('</p><a href="mailto:'), local, F.lit('@own.example">write</a> <a href="mailto:office'), key, F.lit('@own.example">office</a> info@own.example'))
    pages = who.select(url("about").alias("url"), F.when(key % 5 > 0, 200).otherwise(404).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), html.alias("html"))
    pages = pages.unionByName(pages.withColumn("url", F.replace("url", F.lit("about"), F.lit("third"))))  # beyond the first two
    domains = who.where(key % 2 == 0).select("person_id", F.concat(F.lit("me"), key, F.lit(".example")).alias("domain"))
    found = evidence.by_home_page(urls, pages, who.select("person_id", F.array("name").alias("names")), domains)
    return found.select("person_id", "url", "email", "by", "source")


#: Works with an address of their own, with a fall-back alone, or with none; some documents fail or are not there; some hold verified hits.
READING = """select o_custkey as person_id, o_orderkey as place, case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then concat('https://own.example/', o_orderkey) when o_orderkey % 2 = 0 then concat('https://core.ac.uk/', o_orderkey) end as url,
    case when o_orderkey % 5 = 0 then null else o_orderkey % 4 > 0 end as ok, case when o_orderkey % 7 = 0 then 1 else 0 end as verified, o_custkey % 2 as earlier from orders"""


@query(f"""with recursive w as (select *, row_number() over (partition by person_id order by place) as n from ({READING})),
    f as (select person_id, cast(0 as bigint) as n, cast(0 as double) as cost, cast(0 as bigint) as tries, cast(max(earlier) as bigint) as hits, false as over, cast(null as bigint) as place, cast(null as varchar) as url, false as tried, false as ok from w group by person_id
        union all select w.person_id, w.n, case when t then cost + case when r then 1 else 0.5 end else cost end, case when t then tries + 1 else tries end, case when t and r then hits + w.verified else hits end, not c or (case when t and r then hits + w.verified else hits end) >= 2, w.place, w.url, t, r
        from f join w on w.person_id = f.person_id and w.n = f.n + 1, lateral (select not f.over and cost < 8 and tries < 16 as c), lateral (select c and w.url is not null as t, coalesce(w.ok, false) as r))
    select person_id, place, url, ok from f where tried""")
def w10_reading_order(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), key.alias("place"), key.alias("work_id"), key.cast("string").alias("doi"), "o_orderkey")
    site = lambda host: F.concat(F.lit(f"https://{host}/"), key)
    locations = orders.where(key % 3 == 1).select("work_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.concat(F.lit("https://www.mdpi.com/"), key).alias("url")), F.struct(F.lit(1).alias("pos"), site("own.example").alias("url")))).alias("x")).select("work_id", "x.*")
    lists = orders.where((key % 3 == 2) & (key % 2 == 0))
    none = spark.createDataFrame([], "doi string, url string")
    fallbacks = works.fallback_pdfs(orders.select("doi"), lists.select("doi", F.array(F.concat(F.lit("https://www.mdpi.com/"), key), site("core.ac.uk")).alias("urls")), none, lists.limit(0).select("doi", F.array(F.lit("x")).alias("urls")))
    asked = works.addresses_to_read(orders, locations, fallbacks)
    known = asked.withColumn("ok", F.when(key % 5 > 0, key % 4 > 0)).withColumn("verified", (key % 7 == 0).cast("int")).withColumn("earlier", F.col("person_id") % 2)
    return works.read_in_order(known)


# ---- the whole job: everybody asked for at once, from names and affiliations to ranked evidence


def _resolve_tables() -> dict[str, str]:
    """A snapshot for the whole job in SQL that both engines read: authors and their works, bibliographic records, documents of which some fail and some are missing."""
    from .snapshot import LOCAL, SURNAME, TABLES, _div, _styled

    number = _div("c_custkey", 15)
    mail = f"concat({LOCAL}, '@', case when c_custkey % 2 = 0 then concat('ee.org', cast({number} as varchar(12)), '.example') when c_custkey % 3 = 0 then 'gmail.example' else 'elsewhere.example' end)"
    return {
        "people": TABLES["people"],
        "authors": TABLES["authors"],
        "orgs": TABLES["orgs"],
        "works": TABLES["works"],
        "bibliography": f"select distinct concat('10.9999/a', cast({_div('o_orderkey', 4)} as varchar(12))) as doi, {_styled('c_custkey + 2')} as author, {mail} as email from {{orders}} join {{customer}} on o_custkey = c_custkey where o_orderkey % 5 > 0 and o_orderkey % 4 = 1",
        "locations": "select o_orderkey as work_id, concat('https://files.example/', cast(o_orderkey as varchar(12)), '.pdf') as url from {orders} where o_orderkey % 3 = 0",
        "documents": f"select concat('https://files.example/', cast(o_orderkey as varchar(12)), '.pdf') as url, case when o_orderkey % 4 = 0 then 404 else 200 end as status, {mail} as email, concat('By ', {_styled('0')}, ' <', {mail}, '>') as text from {{orders}} join {{customer}} on o_custkey = c_custkey where o_orderkey % 3 = 0 and o_orderkey % 7 > 0",
    }


def _resolve_sql() -> str:
    """The job person by person, as far as the snapshot goes, written from the rules and not from the operators: all pairs of names and of organisations, decisions, works, records, reading, verification, order."""
    t = {k: v.format(customer="customer", supplier="supplier", orders="orders", lineitem="lineitem") for k, v in _resolve_tables().items()}
    cands = _same_rows("select f.*, a.display_name from (select distinct form from fm) f, (select distinct display_name from au) a", "form", "display_name")
    orgs = _same_org_sql("select name from an", "select institution as name from au")
    hit = "len(list_filter(list_filter(string_split_regex(lower(field), '[\\s,/·]+'), lambda t: length(t) >= 3), lambda t: contains(lower(topic), t) or contains(t, lower(topic)))) > 0"
    biblio = _same_rows("select w.person_id, b.email, b.author, p.name from first6 w join bb b on b.doi = w.key join pe p on p.person_id = w.person_id", "name", "author")
    fits = "(len(p) >= 2 and length(t) >= 3 and contains(l, t) and i <> '' and (starts_with(r, i) or ends_with(r, i) or (length(i) >= 2 and contains(r, i))))"
    theirs = f"""select distinct person_id, url, email from (select person_id, url, email, l, p, t, array_to_string(list_transform(list_filter(p, lambda x: x <> t), lambda x: x[1]), '') as i, concat(l[:instr(l, t) - 1], l[instr(l, t) + length(t):]) as r
        from (select x.person_id, x.url, d.email, {BARE} as l, {PARTS} as p from asked x join dc d on d.url = x.url and d.status = 200 join pe using (person_id)), lateral (select unnest(p) as t)) where (length(t) >= 4 and contains(l, t)) or {fits}"""
    check = f"select h.*, case when o.h is null then 'no domain' when {MATCHES.replace(' h ', ' o.h ').replace('(h,', '(o.h,').replace(' h)', ' o.h)').replace('= h ', '= o.h ')} then 'official domain' when regexp_matches(concat(d, '.'), '{PERSONAL}', 'i') then 'personal mail' else 'other domain' end as verification from (select *, split_part(email, '@', 2) as d from {{rows}}) h left join dom o on o.person_id = h.person_id"
    return f"""with recursive {EXPANDED}, pe as ({t['people']}), au as ({t['authors']}), wo as ({t['works']}), bb as ({t['bibliography']}), lo as ({t['locations']}), dc as ({t['documents']}),
    fm as (select person_id, form, rank from (select person_id, unnest(l) as form, unnest(range(len(l))) as rank from (select person_id, string_split(forms, '|') as l from ({_forms_sql()}))) where rank < 4),
    an as (select affiliation, affiliation as name from af union select affiliation, short_name from rec join o on cast(org_id as varchar) = ror), om as ({orgs}), nm as ({cands}),
    ca as (select fm.person_id, au.author_id, bool_or(au.current) as current, bool_or({hit}) as topic_hit, max(works_count) as works_count, min(rank) as form_rank from fm join nm using (form) join au using (display_name) join pe using (person_id) join an using (affiliation) join om on om.a = an.name and om.b = au.institution group by all),
    c1 as (select *, count(*) over p as n, count(*) filter (where current) over p as nc from ca window p as (partition by person_id)), c2 as (select * exclude (n, nc), count(*) over p as n, count(*) filter (where topic_hit) over p as nt from c1 where n = 1 or nc = 0 or current window p as (partition by person_id)),
    c3 as (select *, count(*) over (partition by person_id) as left_ from c2 where n = 1 or nt = 0 or topic_hit), un as (select person_id, author_id, 1 as author_rank from c3 where left_ = 1),
    li as (select * from un union all select person_id, author_id, rn from (select *, row_number() over (partition by person_id order by current desc, topic_hit desc, works_count desc, form_rank, cast(author_id as varchar)) as rn from ca where person_id not in (select person_id from un)) where rn <= 2),
    w1 as (select li.person_id, author_rank, wo.*, row_number() over (partition by li.person_id, li.author_id order by year desc, cast(work_id as varchar)) as nth from li join wo using (author_id)),
    w2 as (select *, coalesce(nullif(lower(regexp_replace(doi, '^https?://(dx\\.)?doi\\.org/', '', 'i')), ''), cast(work_id as varchar)) as key from w1 where nth <= 25),
    w3 as (select * from w2 qualify row_number() over (partition by person_id, key order by author_rank, nth) = 1), w4 as (select *, row_number() over (partition by person_id order by author_rank, nth, key) as place from w3),
    first6 as (select * from w4 where doi <> '' qualify row_number() over (partition by person_id order by place) <= 6),
    dom as (select person_id, {HOST} as h from pe join rec using (affiliation) join o on cast(org_id as varchar) = ror),
    early as (select distinct person_id, email, 'bibliography' as source, author from ({biblio})), e1 as ({check.format(rows='(select distinct person_id, email, source from early)')}),
    e0 as (select person_id, count(*) filter (where verification = 'official domain') as earlier from ({check.format(rows='(select distinct person_id, key, email from (select e.person_id, w.key, e.email from early e join first6 w on w.person_id = e.person_id join bb b on b.doi = w.key and b.email = e.email and b.author = e.author))')}) group by 1),
    asked as (select w4.person_id, place, url from w4 left join lo using (work_id)), th as ({theirs}), tv as ({check.format(rows='th')}),
    goods as (select person_id, url, count(*) filter (where verification = 'official domain') as verified from tv group by all),
    rd as (select a.person_id, row_number() over (partition by a.person_id order by place) as n, place, a.url, coalesce(status = 200, false) as ok, coalesce(verified, 0) as verified, coalesce(earlier, 0) as earlier from asked a left join dc on dc.url = a.url left join goods g on g.person_id = a.person_id and g.url = a.url left join e0 on e0.person_id = a.person_id),
    rf as (select person_id, cast(0 as bigint) as n, cast(0 as double) as cost, cast(0 as bigint) as tries, cast(max(earlier) as bigint) as hits, false as over, cast(null as varchar) as url, false as used from rd group by person_id
        union all select rd.person_id, rd.n, case when t then cost + case when rd.ok then 1 else 0.5 end else cost end, case when t then tries + 1 else tries end, case when t and rd.ok then hits + rd.verified else hits end, not c or (case when t and rd.ok then hits + rd.verified else hits end) >= 2, rd.url, t and rd.ok
        from rf join rd on rd.person_id = rf.person_id and rd.n = rf.n + 1, lateral (select not rf.over and cost < 8 and tries < 16 as c), lateral (select c and rd.url is not null as t)),
    every as (select person_id, email, source, verification from e1 union select tv.person_id, email, 'pdf', verification from tv join rf on rf.person_id = tv.person_id and rf.url = tv.url and rf.used)
    select person_id, email, source, verification, row_number() over (partition by person_id order by verification = 'official domain' desc, email, source) as rn from every"""


@query(_resolve_sql())
def wl1_resolve(spark, sf_dir):
    """All derived people through the whole job; its ranked evidence."""
    from . import resolve as job

    read = {n: _read(spark, sf_dir, n) for n in ("customer", "supplier", "orders")}
    made = {k: spark.sql(v, **{n: df for n, df in read.items() if "{" + n + "}" in v}) for k, v in _resolve_tables().items()}
    authors, orgs = made["authors"].withColumn("author_id", F.col("author_id").cast("string")), made["orgs"]
    none = F.array().cast("array<string>")
    snapshot = {
        "registry": orgs.select(F.col("org_id").cast("string").alias("ror"), F.col("name").alias("display_name"), F.array("short_name").alias("names"), "website", F.array(O.host_of(F.col("website"))).alias("domains")),
        "authors": authors.select("author_id", "display_name", none.alias("alternatives"), F.lit("").alias("record_id"), F.col("works_count").cast("long").alias("works_count"), F.array("topic").alias("topics")),
        "author_affiliations": authors.select("author_id", "institution", "current"),
        "works": made["works"].select(F.col("author_id").cast("string").alias("author_id"), F.col("work_id").cast("string").alias("work_id"), "doi", "year", "title", none.alias("topics")),
        "locations": made["locations"].select(F.col("work_id").cast("string").alias("work_id"), F.lit(0).alias("pos"), "url"),
        "bibliography": made["bibliography"],
        "documents": made["documents"].select("url", "status", F.lit("application/pdf").alias("content_type"), F.lit("pdf").alias("kind"), "text"),
    }
    found = job.resolve(made["people"], snapshot)["evidence"]
    return found.select("person_id", "email", "source", "verification", F.col("rn").cast("long").alias("rn"))
