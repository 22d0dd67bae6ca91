"""Queries of the field normalisers (B): raw values made from the tables, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantloom.functions import normalize as N
from grantloom.views import duck, sql, view

QUERIES: dict = {}
SQL: dict = {}

#: Raw values as sources write them, one row per event, order, page or document.
RAW = {
    "dates": """select event_id as id, concat(cast(cast(date_part('day', ts) as int) as string), '. ', cast(cast(date_part('month', ts) as int) as string), '. ', cast(cast(date_part('year', ts) as int) as string),
        case when event_id % 3 = 0 then concat(' ', cast(cast(date_part('hour', ts) as int) as string), ':', lpad(cast(cast(date_part('minute', ts) as int) as string), 2, '0')) else '' end) as raw,
        case event_id % 4 when 0 then concat(cast(cast(ts as date) as string), 'T10:00:00Z') when 1 then concat(cast(cast(ts as date) as string), 'T10:00:00') when 2 then cast(cast(ts as date) as string) else concat('2024-', cast(event_id % 20 as string), '-31') end as iso, ts from {events}""",
    "money": """select o_orderkey as id, case o_orderkey % 5 when 0 then concat(cast(o_orderkey % 900 + 1 as string), ' ', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ',5') when 1 then concat(cast(o_orderkey % 90000 as string), '.25')
        when 2 then '12.345' when 3 then '-5' else 'neuvedeno' end as raw, case o_orderkey % 3 when 0 then concat('celkem ', cast(o_orderkey % 90 + 1 as string), ',5 mil. Kč') when 1 then concat(cast(o_orderkey % 900 as string), ' 000 Kč') else 'bez částky' end as prose,
        case o_orderkey % 4 when 0 then '85' when 1 then '62,5' when 2 then '120' else 'x' end as percent, concat('podpora ', cast(o_orderkey % 70 as string), ' %, nejvýše ', cast(o_orderkey % 99 as string), ',5 %') as rates, o_totalprice from {orders}""",
    "words": """select o_orderkey as id, case o_orderkey % 12 when 0 then 'Výzva byla ZRUŠENA' when 1 then 'Příjem pozastaven' when 2 then 'Otevřená výzva' when 3 then 'plánovaná' when 4 then 'Uzavřená výzva 2024' when 5 then 'Otevírá se, dříve zrušeno' when 6 then 'Připravuje se' when 7 then 'V PLÁNU'
        when 8 then 'Výzva ukončena' when 9 then 'uzavírá se' when 10 then 'Příjem žádostí byl ukončen' else 'jiné' end as words,
        case o_orderkey % 4 when 0 then 'Ano' when 1 then '0' when 2 then '  ' else 'snad' end as flag, case o_orderkey % 5 when 0 then 'Příloha č. 1' when 1 then 'Formulář žádosti' when 2 then 'Pravidla' when 3 then 'Výzva 2025 a 2026' else 'Archiv: výzva 2019' end as title,
        case o_orderkey % 4 when 0 then 'https://a.example/x.PDF?v=1' when 1 then 'https://a.example/t.xlsx#s' when 2 then 'https://a.example/dir/' else 'https://a.example/p.html' end as link,
        case when o_orderkey % 7 = 0 then null else cast(o_orderdate as date) end as opens, case when o_orderkey % 3 = 0 then null else cast(o_orderdate as date) + 30 end as closes, date '1995-06-01' as now from {orders}""",
}


def raw(spark, sf_dir, name):
    return sql(spark, sf_dir, RAW[name])


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        for k, text in RAW.items():
            oracle = oracle.replace("{raw_" + k + "}", f"({text})")
        SQL[name] = duck(oracle)


FOLD = "trim(regexp_replace(strip_accents(replace(lower({c}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"
fold = lambda c: FOLD.replace("{c}", c)

add("B1_fold_text", lambda s, d: view(s, d, "documents").select("doc_id", N.fold_text(F.col("text")).alias("folded")), f"select doc_id, {fold('text')} as folded from {{documents}}")
add("B2_clean_ws", lambda s, d: view(s, d, "documents").select("doc_id", N.clean_ws(F.col("text")).alias("cleaned")), r"select doc_id, trim(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g')) as cleaned from {documents}")
add(
    "B3_plain_text",
    lambda s, d: view(s, d, "pages").select("page_id", N.plain_text(F.col("html")).alias("plain")),
    r"select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) as plain from {pages}",
)
add(
    "B4_slugify",
    lambda s, d: view(s, d, "search_docs").select("doc_id", N.slugify(F.col("title")).alias("slug")),
    f"select doc_id, case when s <> '' then s else left(sha256(title), 24) end as slug from (select doc_id, title, regexp_replace(left(replace({fold('title')}, ' ', '-'), 180), '-+$', '') as s from {{search_docs}})",
)
add(
    "B5_stable_id",
    lambda s, d: view(s, d, "versions").select("call_id", "version_number", N.stable_id(F.col("call_id"), F.col("version_number"), F.col("status")).alias("id")),
    "select call_id, version_number, left(sha256(concat(call_id, chr(31), version_number, chr(31), status)), 24) as id from {versions}",
)
add(
    "B6_content_hash",
    lambda s, d: view(s, d, "events").select("event_id", N.content_hash(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("snap:"), F.sha2("props", 256))), F.concat("event_type", F.coalesce("props", F.lit("")))).alias("hash")),
    "select event_id, case when event_id % 2 = 0 and props is not null then sha256(props) else sha256(concat(event_type, coalesce(props, ''))) end as hash from {events}",
)
ISO = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
add(
    "B7_parse_cz_date",
    lambda s, d: raw(s, d, "dates").select("id", ISO(N.cz_date(F.col("raw"))).alias("at")),
    """select id, strftime(((cast(ts as date) + case when id % 3 = 0 then to_hours(date_part('hour', ts)) + to_minutes(date_part('minute', ts)) else interval '23:59:59' hour to second end)
       at time zone 'Europe/Prague') at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as at from {raw_dates}""".replace("interval '23:59:59' hour to second", "to_seconds(86399)"),
)
SAID = "case when id % 12 in (0, 5) then 'CANCELLED' when id % 12 = 1 then 'PAUSED' when id % 12 = 2 then 'OPEN' when id % 12 in (3, 6, 7) then 'PLANNED' when id % 12 in (4, 8, 9, 10) then 'CLOSED' else 'UNKNOWN' end"
WINDOW = "case when now > closes then 'CLOSED' when now < opens then 'PLANNED' when opens is not null or closes is not null then 'OPEN' else 'UNKNOWN' end"
add("B9_status_from_text", lambda s, d: raw(s, d, "words").select("id", N.status_from_text(F.col("words")).alias("status")), f"select id, {SAID} as status from {{raw_words}}")
add("B10_status_from_window", lambda s, d: raw(s, d, "words").select("id", N.status_from_window(F.col("now"), F.col("opens"), F.col("closes")).alias("status")), f"select id, {WINDOW} as status from {{raw_words}}")
MEMBERS = ["OPEN", "PLANNED", "CLOSED", "CANCELLED", "PAUSED", "ANNOUNCED", "DRAFT"]
add(
    "B11_canonical_status",
    lambda s, d: view(s, d, "orders").select("o_orderkey", N.canonical_status(F.when(F.col("o_orderkey") % 3 == 0, F.lit(" open ")).otherwise(F.col("o_orderstatus")), {"O": "OPEN", "F": "CLOSED"}, MEMBERS).alias("status")),
    "select o_orderkey, case when o_orderkey % 3 = 0 then 'OPEN' when o_orderstatus = 'O' then 'OPEN' when o_orderstatus = 'F' then 'CLOSED' else 'DRAFT' end as status from {orders}",
)
add(
    "B12_money_minor",
    lambda s, d: raw(s, d, "money").select("id", N.money_minor(F.col("raw")).alias("strict"), N.money_half_up(F.col("raw")).alias("lenient"), N.money_in_text(F.col("prose")).alias("prose")),
    r"""select id, case when regexp_full_match(x, '\d+(\.\d{1,2})?') then cast(cast(x as decimal(30,2)) * 100 as bigint) end as strict, cast(round(try_cast(x as decimal(30,6)) * 100, 0) as bigint) as lenient,
        case id % 3 when 0 then ((id % 90 + 1) * 10 + 5) * 10000000 when 1 then (id % 900) * 100000 end as prose from (select *, case when raw = 'neuvedeno' then null else replace(replace(raw, ' ', ''), ',', '.') end as x from {raw_money})""",
)
add("B13_percent_bps", lambda s, d: raw(s, d, "money").select("id", N.percent_bps(F.col("percent")).alias("bps")), "select id, case id % 4 when 0 then 8500 when 1 then 6250 end as bps from {raw_money}")
add("B14_parse_bool", lambda s, d: raw(s, d, "words").select("id", N.parse_bool(F.col("flag")).alias("value")), "select id, case id % 4 when 0 then true when 1 then false when 2 then false end as value from {raw_words}")
add(
    "B15_artifact_role",
    lambda s, d: raw(s, d, "words").select("id", N.artifact_role(F.col("title")).alias("role"), N.mime_hint(F.col("link")).alias("mime")),
    "select id, case id % 5 when 0 then 'ATTACHMENT' when 1 then 'FORM' when 2 then 'RULES' else 'CALL_TEXT' end as role, case id % 4 when 0 then 'application/pdf' when 1 then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' when 3 then 'text/html' end as mime from {raw_words}",
)
#: The hosts whose documents count.
HOSTS = ["ec.europa.example", "docs.portal.example"]
LINKS = """select o_orderkey as id, concat('<a href="https://ec.europa.example/a/', cast(o_custkey as string), '.PDF?x=1&amp;y=2">a</a> <a HREF=''https://docs.portal.example/opportunities/docs/', cast(o_orderkey % 50 as string), '/list''>b</a> <a href="http://ec.europa.example/plain.pdf">no</a>',
    '<a href="https://www.ec.europa.example/sub.pdf">no</a> <a href="https://ec.europa.example/page.html">no</a> <a href="/rel.pdf">no</a> <a href="https://ec.europa.example/a/', cast(o_custkey as string), '.PDF?x=1&amp;y=2">again</a>') as html, o_custkey, o_orderkey from {orders}"""
add(
    "B16_extract_links",
    lambda s, d: sql(s, d, LINKS).select("id", F.explode(N.document_links(F.col("html"), HOSTS)).alias("link")).select("id", "link", F.left(F.sha2("link", 256), F.lit(24)).alias("link_id")),
    "select o_orderkey as id, link, left(sha256(link), 24) as link_id from (select o_orderkey, unnest(['https://ec.europa.example/a/' || o_custkey || '.PDF?x=1&y=2', 'https://docs.portal.example/opportunities/docs/' || (o_orderkey % 50) || '/list']) as link from {orders})",
)
add(
    "B16_page_links",
    lambda s, d: view(s, d, "pages").select("page_id", F.explode(N.document_links(F.col("html"), HOSTS)).alias("link")),
    r"""select distinct page_id, link from (select page_id, replace(unnest(regexp_extract_all(html, 'href=["''](https://[^"''<>\s]+)["'']', 1, 'i')), '&amp;', '&') as link from {pages}) where regexp_matches(lower(link), '^https://(ec\.europa|docs\.portal)\.example/')
        and (regexp_matches(lower(regexp_extract(link, '^[^?#]*')), '\.pdf$') or contains(regexp_extract(link, '^[^?#]*'), '/opportunities/docs/'))""",
)
add("B17_looks_like_call", lambda s, d: raw(s, d, "words").select("id", N.looks_like_call(F.col("title"), F.lit(2025)).alias("call")), "select id, id % 5 = 3 as call from {raw_words}")
DATE10 = r"case when regexp_full_match(left(iso, 10), '\d{4}-\d{2}-\d{2}') then try_cast(left(iso, 10) as date) end"
add("B18_deadline_needs_review", lambda s, d: raw(s, d, "dates").select("id", N.deadline_needs_review(F.col("iso")).alias("review")), f"select id, iso is not null and {DATE10} is null as review from {{raw_dates}}")
add("B19_first_of", lambda s, d: view(s, d, "search_docs").select("doc_id", F.try_element_at(F.split("title", " "), F.lit(1)).alias("head")), "select doc_id, string_split(title, ' ')[1] as head from {search_docs}")
add("B20_first_nonblank", lambda s, d: raw(s, d, "words").select("id", N.first_nonblank(F.col("flag"), F.col("words")).alias("value")), "select id, coalesce(nullif(trim(flag), ''), nullif(trim(words), '')) as value from {raw_words}")
add("B21_date_part", lambda s, d: raw(s, d, "dates").select("id", N.date_part(F.col("iso")).cast("string").alias("day")), f"select id, cast({DATE10} as varchar) as day from {{raw_dates}}")
add(
    "B22_parse_instant",
    lambda s, d: raw(s, d, "dates").select("id", ISO(N.parse_instant(F.col("iso"), "Europe/Prague")).alias("at")),
    "select id, case id % 4 when 0 then strftime(cast(cast(ts as date) as timestamp) + interval 10 hour, '%Y-%m-%d %H:%M:%S') when 1 then strftime(((cast(cast(ts as date) as timestamp) + interval 10 hour) at time zone 'Europe/Prague') at time zone 'UTC', '%Y-%m-%d %H:%M:%S') end as at from {raw_dates}",
)
ROUNDINGS = ["HALF_EVEN", "HALF_UP", "FLOOR", "CEILING", "DOWN", "UP"]
add(
    "B23_money_convert",
    lambda s, d: raw(s, d, "money").select("id", *[N.convert_money(F.expr("cast(round(o_totalprice * 100) as bigint) / 1000.0BD"), F.when(F.col("id") % 5 == 0, "JPY").when(F.col("id") % 5 == 1, "KWD").when(F.col("id") % 5 == 2, "XXX").otherwise("CZK"), r).alias(r.lower()) for r in ROUNDINGS]),
    """select id, case when m is null then null when rest * 2 < k then q when rest * 2 > k then q + 1 when q % 2 = 0 then q else q + 1 end as half_even, case when m is not null then q + case when rest * 2 >= k then 1 else 0 end end as half_up,
        case when m is not null then q end as floor, case when m is not null then q + case when rest > 0 then 1 else 0 end end as ceiling, case when m is not null then q end as down, case when m is not null then q + case when rest > 0 then 1 else 0 end end as up
        from (select id, m, k, (c * m) // k as q, (c * m) % k as rest from (select id, cast(round(o_totalprice * 100) as bigint) as c, case id % 5 when 0 then 1 when 1 then 1000 when 2 then null else 100 end as m, 1000 as k from {raw_money}))""",
)
add("B25_rate_apply", lambda s, d: view(s, d, "funded").select("project_id", "scenario_id", N.rate_apply(F.col("eligible_minor"), F.col("rate_bps")).alias("amount")), "select project_id, scenario_id, (eligible_minor * rate_bps) // 10000 as amount from {funded}")
add("B27_instrument_type", lambda s, d: raw(s, d, "words").select("id", N.instrument_type(F.when(F.col("id") % 3 == 0, "Záruka za úvěr").when(F.col("id") % 3 == 1, "úvěr s dotací").otherwise("úvěr")).alias("kind")), "select id, case id % 3 when 0 then 'GUARANTEE' when 1 then 'MIXED' else 'LOAN' end as kind from {raw_words}")
add(
    "B34_pick_deadline",
    lambda s, d: view(s, d, "versions").groupBy("call_id").agg(F.array_sort(F.collect_set("close_at")).alias("dates")).select(
        "call_id", F.coalesce(F.array_min(F.filter("dates", lambda x: x >= F.lit("1997-01-01").cast("date"))), F.array_max("dates")).cast("string").alias("deadline")
    ),
    "select call_id, cast(coalesce(min(close_at) filter (close_at >= date '1997-01-01'), max(close_at)) as varchar) as deadline from {versions} group by call_id",
)
add(
    "B35_status_mixed",
    lambda s, d: raw(s, d, "words").select("id", N.status_mixed(F.col("words"), F.col("opens"), F.col("closes"), F.col("now")).alias("status")),
    f"select id, case when {SAID} in ('CANCELLED', 'PAUSED', 'CLOSED') then {SAID} else {WINDOW} end as status from {{raw_words}}",
)

PROSE = """select o_orderkey as id, concat('Podpora: min. ', cast(o_orderkey % 90 + 1 as string), ' tis. Kč, max. ', cast(o_orderkey % 40 + 2 as string), ' mil. Kč. Termín ', cast(o_orderkey % 28 + 1 as string), '. 3. 2024 - ', cast(o_orderkey % 28 + 1 as string), '. 5. 2024. Poslední změna.') as prose from {orders}"""
amounts = lambda c, unit: F.transform(F.regexp_extract_all(c, F.lit(rf"(\d+) {unit}\. Kč"), F.lit(1)), lambda x: x.cast("bigint"))
add(
    "B32_date_range",
    lambda s, d: sql(s, d, PROSE).select("id", F.split(F.regexp_extract("prose", r"(\d{1,2}\. \d{1,2}\. \d{4} - \d{1,2}\. \d{1,2}\. \d{4})", 1), " - ").alias("r")).select("id", ISO(N.cz_date(F.concat(F.col("r")[0], F.lit(" 00:00")))).alias("opens"), ISO(N.cz_date(F.col("r")[1])).alias("closes")),
    "select id, strftime((a at time zone 'Europe/Prague') at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as opens, strftime((b at time zone 'Europe/Prague') at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as closes from (select o_orderkey as id, make_timestamp(2024, 3, o_orderkey % 28 + 1, 0, 0, 0.0) as a, make_timestamp(2024, 5, o_orderkey % 28 + 1, 23, 59, 59.0) as b from {orders})",
)
add(
    "B31_grant_range",
    lambda s, d: sql(s, d, PROSE).select("id", F.array_max(amounts("prose", "mil")).alias("top")).select("id", (F.col("top") * 100_000_000).alias("max_minor")),
    "select o_orderkey as id, (o_orderkey % 40 + 2) * 100000000 as max_minor from {orders}",
)
add(
    "B36_labelled_section",
    lambda s, d: sql(s, d, PROSE).select("id", F.trim(F.regexp_extract("prose", r"Podpora:\s*(.*?)\s*Termín", 1)).alias("section")),
    "select o_orderkey as id, concat('min. ', o_orderkey % 90 + 1, ' tis. Kč, max. ', o_orderkey % 40 + 2, ' mil. Kč.') as section from {orders}",
)

#: Notices with labelled dates, some changed later, some in words that no label announces.
NOTICES = """select o_orderkey as id, concat('Zahájení příjmu žádostí: ', cast(o_orderkey % 28 + 1 as string), '. 3. 2024. ', case when o_orderkey % 4 < 3 then concat('Ukončení příjmu žádostí ', cast(o_orderkey % 27 + 1 as string), '. května 2024. ') else '' end,
    case when o_orderkey % 3 = 0 then concat('Termín byl prodloužen do ', cast(o_orderkey % 25 + 1 as string), '. 6. 2024 a dále změněn na ', cast(o_orderkey % 26 + 1 as string), '. července 2024.') else '' end) as notice,
    concat('Program z 1. 1. 2020. ', case o_orderkey % 5 when 0 then 'Termín podání žádostí je stanoven do ' when 1 then 'Příjem žádostí probíhá do ' when 2 then 'Uzávěrka přihlášek: ' when 3 then 'Vydáno ' else 'TERMÍN PODÁNÍ: ' end, cast(o_orderkey % 28 + 1 as string), case when o_orderkey % 2 = 0 then '. 9. 2024' else '. září 2024' end, '. Konec.') as call_text, o_orderkey from {orders}"""
UTC = lambda ts: f"strftime(({ts} at time zone 'Europe/Prague') at time zone 'UTC', '%Y-%m-%d %H:%M:%S')"
DAY_END = lambda month, day: UTC(f"make_timestamp(2024, {month}, {day}, 23, 59, 59.0)")
add(
    "B8_submission_window",
    lambda s, d: (lambda w: sql(s, d, NOTICES).select("id", ISO(w[0]).alias("opens"), ISO(w[1]).alias("closes")))(N.submission_window(F.col("notice"))),
    f"select o_orderkey as id, {UTC('make_timestamp(2024, 3, o_orderkey % 28 + 1, 0, 0, 0.0)')} as opens, case when o_orderkey % 3 = 0 then {DAY_END(7, 'o_orderkey % 26 + 1')} when o_orderkey % 4 < 3 then {DAY_END(5, 'o_orderkey % 27 + 1')} end as closes from {{orders}}",
)
add("B33_deadline_by_patterns", lambda s, d: sql(s, d, NOTICES).select("id", ISO(N.deadline_by_patterns(F.col("call_text"))).alias("deadline")), f"select o_orderkey as id, case when o_orderkey % 5 <> 3 then {DAY_END(9, 'o_orderkey % 28 + 1')} end as deadline from {{orders}}")

#: A register's answers: several names and seats, of which some have expired; every ninth is about another id.
REGISTER = """select c_custkey as id, lpad(cast(c_custkey as string), 8, '0') as ico, concat('{{"ico":"', case when c_custkey % 2 = 0 then 'ARES_' else '' end, lpad(cast(case when c_custkey % 9 = 0 then c_custkey + 1 else c_custkey end as string), 8, '0'), '","obchodniJmeno":[{{"platnostDo":"2020-01-01","primarniZaznam":true,"obchodniJmeno":"old ', c_name,
    '"}},{{"primarniZaznam":false,"obchodniJmeno":"other ', c_name, '"}}', case when c_custkey % 3 > 0 then concat(',{{"primarniZaznam":true,"obchodniJmeno":" ', c_name, ' "}}') else '' end, '],"pravniForma":', case when c_custkey % 5 = 0 then 'null' else '"112"' end, ',"sidlo":[{{"primarniZaznam":false,"sidlo":{{"kodObce":1,"nazevObce":"x"}}}},{{"primarniZaznam":true,"sidlo":{{"kodObce":', cast(c_nationkey as string),
    ',"nazevObce":"', c_mktsegment, '","textovaAdresa":""}}}}],"czNace":["62","', cast(c_nationkey as string), '","62","70"]}}') as payload, c_name, c_nationkey, c_mktsegment from {customer}"""
add(
    "B26_applicant_facts",
    lambda s, d: sql(s, d, REGISTER).select("id", F.inline(N.applicant_facts(F.col("payload"), F.col("ico")))),
    """with r as (select c_custkey as id, * from {customer} where c_custkey % 9 > 0) select id, 'applicant.ico' as key, lpad(id::varchar, 8, '0') as value from r union all select id, 'applicant.organisation_name', case when id % 3 > 0 then c_name else 'old ' || c_name end from r
    union all select id, 'applicant.legal_form', '112' from r where id % 5 > 0 union all select id, 'applicant.municipality.code', c_nationkey::varchar from r union all select id, 'applicant.municipality.name', c_mktsegment from r
    union all select id, 'applicant.cz_nace', case when c_nationkey in (62, 70) then '62,70' else '62,' || c_nationkey || ',70' end from r""",
)


def shown(df, made, *more):
    return df.select("id", *[c.alias(k) for k, c in made.items()], *more)


sha = lambda: F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")), 256)
SHA_SQL = "left(sha256('r' || id), 24)"
#: Records as the three sources list them.
SPORTS = """select p_partkey as id, concat('NSA/', cast(p_partkey as string), '/24') as external_id, concat('https://nsa.example/dotace-', case p_partkey % 4 when 0 then 'investicni-parasport' when 1 then 'neinvesticni-parasport' when 2 then 'investicni' else 'ostatni' end, '/list') as listing, case when p_partkey % 6 = 0 then null else concat(' ', p_name, ' ') end as title,
    p_comment as description, case when p_partkey % 5 = 0 then '' else p_type end as call_type, case p_partkey % 3 when 0 then ' open' when 1 then 'Closed ' else 'neznámý' end as status from (select *, concat(p_name, ' ', p_type) as p_comment from {part})"""
col = F.col
add(
    "C1_sports_calls",
    lambda s, d: shown(sql(s, d, SPORTS), N.sports_call(col("external_id"), col("listing"), col("title"), col("description"), col("call_type"), col("status"), sha())),
    f"""with p as (select p_partkey as id, 'NSA/' || p_partkey || '/24' as ext, * from {{part}}) select id, 'grant:nsa:' || replace(ext, '/', '-') as call_id, 'grant:nsa:' || replace(ext, '/', '-') || ':sha:' || {SHA_SQL} as version_id,
    'programme:nsa:' || case id % 4 when 0 then 'parasport' when 1 then 'parasport-noninvestment' when 2 then 'investment' else 'noninvestment' end as programme_id, 'NSA — ' || case id % 4 when 0 then 'Parasport' when 1 then 'Neinvestiční parasport' when 2 then 'Investiční výzvy' else 'Neinvestiční výzvy' end as programme_name,
    case when id % 6 = 0 then ext else trim(p_name) end as title, p_name || ' ' || p_type as summary, case id % 3 when 0 then 'OPEN' when 1 then 'CLOSED' else 'DRAFT' end as status, case when id % 5 > 0 then p_type || ' ' else '' end || ext || ' Národní sportovní agentura' as keywords, 'CZK' as currency from p""",
)
CATALOGUE = """select p_partkey as id, concat('D', cast(p_partkey as string)) as external_id, case when p_partkey % 4 = 0 then 'https://dotace.example/vyzvy/list' else concat('https://dotace.example/vyzvy/', cast(p_partkey % 90 + 10 as string), '-op-', cast(p_size as string), '/detail') end as url, p_name as title, case when p_partkey % 3 = 0 then '  ' else concat(p_type, '  ', p_brand) end as programme,
    case when p_partkey % 5 = 0 then '' else '2021–2027' end as period, case when p_partkey % 2 = 0 then null else p_brand end as priority, p_type as call_type, case when p_partkey % 7 = 0 then 'obce' else '' end as applicants, concat('K', cast(p_size as string)) as code, 'PLANNED' as status from {part}"""
add(
    "C2_catalogue_calls",
    lambda s, d: shown(sql(s, d, CATALOGUE), N.catalogue_call(*[col(c) for c in ("external_id", "url", "title", "programme", "period", "priority", "call_type", "applicants", "code", "status")], sha())),
    f"""with p as (select p_partkey as id, case when p_partkey % 3 = 0 then 'DotaceEU — program neuveden' else p_type || ' ' || p_brand end as prog, case when p_partkey % 5 = 0 then '' else '2021–2027 ' end as per, * from {{part}}) select id, 'grant:dotaceeu:D' || id as call_id, 'grant:dotaceeu:D' || id || ':sha:' || {SHA_SQL} as version_id,
    'programme:dotaceeu:' || case when per = '' then 'period-unspecified' else '2021-2027' end || ':' || case when id % 4 = 0 then 'catalogue' else (id % 90 + 10)::varchar end as programme_id, prog as programme_name, p_name as title,
    'Program: ' || prog || case when id % 2 = 1 then ' · Priorita: ' || p_brand else '' end || ' · Typ výzvy: ' || p_type || case when id % 7 = 0 then ' · Oprávnění žadatelé: obce' else '' end as summary, 'PLANNED' as status, 'K' || p_size || ' ' || p_type || ' ' || per || prog as keywords, 'CZK' as currency from p""",
)
PORTAL = """select p_partkey as id, concat('EU-', cast(p_partkey as string)) as external_id, concat('{{"frameworkProgramme":["', case when p_partkey % 3 = 0 then 'a b' else cast(43100000 + p_size as string) end, '"],', case when p_partkey % 4 = 0 then '' else concat('"frameworkProgrammeName":["', p_type, '","x"],') end,
    '"topicConditions":["<p>', p_type, ' &amp; more</p>"],"startDate":["2024-01-', cast(10 + p_size % 20 as string), '"],"deadlineDate":[],"callTitle":["', p_brand, '"],"type":["', cast(p_size as string), '"]}}') as metadata, p_name as title, case when p_partkey % 2 = 0 then '' else concat('<b>', p_name, '</b> is  open') end as summary,
    case p_partkey % 4 when 0 then '31094501' when 1 then '31094502' when 2 then '31094503' else 'archived' end as status from {part}"""
add(
    "C3_portal_calls",
    lambda s, d: shown(sql(s, d, PORTAL), N.portal_call(*[col(c) for c in ("external_id", "metadata", "title", "summary", "status")], sha())),
    f"""with p as (select p_partkey as id, case when p_partkey % 3 = 0 then 'a b' else (43100000 + p_size)::varchar end as fw, case when p_partkey % 2 = 0 then p_name else p_name || ' is open' end as txt, * from {{part}}), q as (select *, case when id % 4 > 0 then p_type else fw end as prog from p)
    select id, 'grant:eu-ft:EU-' || id as call_id, 'grant:eu-ft:EU-' || id || ':sha:' || {SHA_SQL} as version_id, 'programme:eu-ft:' || case when id % 3 = 0 then 'catalogue' else fw end as programme_id, prog as programme_name, p_name as title, txt as summary,
    case id % 4 when 0 then 'PLANNED' when 1 then 'OPEN' when 2 then 'CLOSED' else 'ARCHIVED' end as status, txt || ' ' || p_type || ' & more' as activities, '2024-01-' || (10 + p_size % 20) as opens, null::varchar as closes, 'EU-' || id || ' ' || p_brand || ' ' || p_size || ' ' || prog as keywords, 'EUR' as currency from q""",
)

MONEY = ("cost_min_minor", "cost_max_minor", "scenario_currency")
add(
    "B24_range",
    lambda s, d: view(s, d, "funded").select(
        "project_id", "scenario_id", N.clamp(col("eligible_minor"), col("currency"), *[col(c) for c in MONEY]).alias("clamped"), N.in_range(col("total_minor"), col("currency"), *[col(c) for c in MONEY]).alias("inside"),
        N.intersect(col("cost_min_minor"), col("cost_max_minor"), col("scenario_currency"), col("min_minor"), col("cap_minor"), col("currency")).alias("x"),
    ).select("project_id", "scenario_id", "clamped", "inside", col("x").isNotNull().alias("meets"), "x.low", "x.high"),
    """with f as (select *, (cost_min_minor is null and cost_max_minor is null) or (min_minor is null and cap_minor is null) as blank, greatest(cost_min_minor, min_minor) as a, least(cost_max_minor, cap_minor) as b from {funded}),
    g as (select *, blank or (currency = scenario_currency and (a is null or b is null or a <= b)) as meets from f)
    select project_id, scenario_id, case when eligible_minor is not null and currency = scenario_currency then least(greatest(eligible_minor, cost_min_minor), cost_max_minor) end as clamped,
        case when currency = scenario_currency and not (cost_min_minor is null and cost_max_minor is null) then (cost_min_minor is null or total_minor >= cost_min_minor) and (cost_max_minor is null or total_minor <= cost_max_minor) end as inside,
        meets, case when meets and not blank then a end as low, case when meets and not blank then b end as high from g""",
)
AMOUNTS = """select o_orderkey as id, concat('Alokace ', case o_orderkey % 6 when 0 then concat(cast(o_orderkey % 90 + 1 as string), ',5 mil. Kč') when 1 then concat(cast(o_orderkey % 900 as string), ' 000 CZK') when 2 then concat('1,', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '.25 EUR') when 3 then concat(cast(o_orderkey % 70 as string), ' €') when 4 then concat(cast(o_orderkey % 9 as string), ' MLD Kč, z toho 1 mil. Kč') else 'neuvedena' end, '. Sazba ',
    case when o_orderkey % 4 = 0 then 'neuvedena' else concat(cast(o_orderkey % 50 as string), ',5 %, max. ', cast(o_orderkey % 40 + 40 as string), ' %') end, '. Náklady: ', case o_orderkey % 3 when 0 then concat('min. ', cast(o_orderkey % 90 + 1 as string), ' tis. Kč, max. ', cast(o_orderkey % 40 + 2 as string), ',5 mil. Kč') when 1 then concat('do ', cast(o_orderkey % 5 + 1 as string), ' mil Kč') else 'bez limitu' end) as body from {orders}"""
split = lambda k: F.split("body", r"\. (?=Sazba|Náklady)")[k]
add("B28_money_with_currency", lambda s, d: sql(s, d, AMOUNTS).select("id", *[c.alias(k) for c, k in zip(N.money_with_currency(split(0)), ("minor", "currency"), strict=True)]),
    """select o_orderkey as id, case o_orderkey % 6 when 0 then (o_orderkey % 90 + 1) * 100000000 + 50000000 when 1 then (o_orderkey % 900) * 100000 when 2 then 100025 + (o_orderkey % 1000) * 100 when 3 then (o_orderkey % 70) * 100 when 4 then (o_orderkey % 9) * 100000000000 end::bigint as minor,
    case when o_orderkey % 6 in (0, 1, 4) then 'CZK' when o_orderkey % 6 in (2, 3) then 'EUR' end as currency from {orders}""")  # fmt: skip
add("B29_percent_in_text", lambda s, d: sql(s, d, AMOUNTS).select("id", *[c.alias(k) for k, c in N.percent_in_text(split(1)).items()]),
    """select o_orderkey as id, case when o_orderkey % 4 > 0 then (o_orderkey % 50) * 100 + 50 end::int as first, case when o_orderkey % 4 > 0 then greatest((o_orderkey % 50) * 100 + 50, (o_orderkey % 40 + 40) * 100) end::int as top, case when o_orderkey % 4 > 0 then (o_orderkey % 40 + 40) * 100 end::int as "limit" from {orders}""")  # fmt: skip
add("B30_cost_limits", lambda s, d: sql(s, d, AMOUNTS).select("id", *[c.alias(k) for c, k in zip(N.cost_limits(split(2)), ("low", "high"), strict=True)]),
    "select o_orderkey as id, case o_orderkey % 3 when 0 then (o_orderkey % 90 + 1) * 1000 when 1 then (o_orderkey % 5 + 1) * 1000000 end::bigint as low, case when o_orderkey % 3 = 0 then (o_orderkey % 40 + 2) * 1000000 + 500000 end::bigint as high from {orders}")
