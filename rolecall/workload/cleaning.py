"""Column rules and the normalisation job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.functions import dates, identity, text, urls
from rolecall.operators.normalize import normalize_postings
from rolecall.workload import sqltext as q
from rolecall.workload.catalog import query
from rolecall.workload.tables import Tables, duck


@query(
    "clean_text",
    f"SELECT doc_id, length({q.clean('text')}) AS n, sha256({q.clean('text')}) AS digest FROM documents",
)
def clean_text(t: Tables) -> DataFrame:
    body = t.documents.select("doc_id", text.clean_text(F.col("text")).alias("body"))
    return body.select("doc_id", F.length("body").cast("long").alias("n"), F.sha2("body", 256).alias("digest"))


_NUMBERS = """
SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN CAST(o_totalprice AS STRING) WHEN 1 THEN concat('-', CAST(o_custkey AS STRING), '.9')
 WHEN 2 THEN concat(CAST(o_custkey AS STRING), 'd') WHEN 3 THEN '1e3' WHEN 4 THEN '' WHEN 5 THEN 'NaN' WHEN 6 THEN concat(' +', CAST(o_custkey AS STRING), ' ')
 WHEN 7 THEN concat('$', CAST(o_custkey AS STRING), ',000') WHEN 8 THEN '30-50' WHEN 9 THEN '1.2.3' WHEN 10 THEN NULL ELSE '.5' END AS raw
FROM {orders}
"""


@query(
    "number_parsing",
    f"SELECT id, {q.number('raw')} AS as_int, {q.decimal('raw')} AS as_float FROM ({duck(_NUMBERS)})",
)
def number_parsing(t: Tables) -> DataFrame:
    raw = F.col("raw")
    return t.sql(_NUMBERS).select("id", text.to_int(raw).alias("as_int"), text.to_float(raw).alias("as_float"))


_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
_LONG = "January February March April May June July August September October November December".split()


def _month(names: list[str]) -> str:
    return "CASE m " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, 1)) + " END"


_DATES = f"""
SELECT id, y, mm, dd, kind, id * 86461 AS seconds, CASE kind WHEN 0 THEN concat(y, '-', mm, '-', dd) WHEN 1 THEN concat(y, '/', mm, '/', dd)
 WHEN 2 THEN concat(d, ' ', {_month(_MONTHS)}, ' ', y) WHEN 3 THEN concat(d, '  ', {_month(_LONG)}, ' ', y)
 WHEN 4 THEN concat({_month(_MONTHS)}, ' ', d, ', ', y) WHEN 5 THEN concat({_month(_LONG)}, ' ', dd, ', ', y)
 WHEN 6 THEN concat(dd, '-', mm, '-', y) WHEN 7 THEN concat({_month(_MONTHS)}, ' ', dd, ' ', y)
 WHEN 8 THEN concat(y, '-', mm, '-', dd, 'T10:20:30Z') WHEN 9 THEN concat(y, '-', mm, '-', dd, ' 10:20')
 WHEN 10 THEN concat(y, mm, dd) WHEN 11 THEN '10:30' WHEN 12 THEN y WHEN 13 THEN concat(y, '-', mm, '-', dd, 'T01:02:03.5+05:30')
 WHEN 14 THEN concat(y, '-13-', dd) WHEN 15 THEN 'not a date' ELSE NULL END AS raw
FROM (SELECT o_orderkey AS id, o_orderkey % 17 AS kind, CAST(year(o_orderdate) AS STRING) AS y, month(o_orderdate) AS m,
 lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, CAST(day(o_orderdate) AS STRING) AS d,
 lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd FROM {{orders}}) x
"""
_DAY = "y || '-' || mm || '-' || dd"


@query(
    "date_parsing",
    f"""SELECT id, strftime(TIMESTAMP '1970-01-01' + to_seconds(seconds), '%Y-%m-%dT%H:%M:%S+00:00') AS epoch,
 CASE WHEN kind IN (11, 12, 14, 15, 16) THEN NULL
 WHEN kind = 8 THEN {_DAY} || 'T10:20:30+00:00' WHEN kind = 9 THEN {_DAY} || 'T10:20:00'
 WHEN kind = 13 THEN {_DAY} || 'T01:02:03.500000+05:30' ELSE {_DAY} || 'T00:00:00' END AS iso,
 CASE WHEN kind IN (11, 12, 14, 15, 16) THEN NULL WHEN kind = 8 THEN CAST({_DAY} AS TIMESTAMP) + INTERVAL 37230 SECOND
 WHEN kind = 9 THEN CAST({_DAY} AS TIMESTAMP) + INTERVAL 620 MINUTE
 WHEN kind = 13 THEN CAST({_DAY} AS TIMESTAMP) + INTERVAL 3723500 MILLISECOND - INTERVAL 330 MINUTE
 ELSE CAST({_DAY} AS TIMESTAMP) END AS instant FROM ({duck(_DATES)})""",
)
def date_parsing(t: Tables) -> DataFrame:
    columns = {"iso": F.col("raw"), "epoch": F.col("seconds")}
    return dates.with_dates(t.sql(_DATES), columns, {"instant": "iso"}).select("id", "epoch", "iso", "instant")


def normalized(t: Tables) -> DataFrame:
    return normalize_postings(t.postings)


def _norm(columns: str) -> str:
    return f"WITH {q.NORM} SELECT {columns} FROM norm"


@query("employment_token", _norm("seq, employment_type"))
def employment_token(t: Tables) -> DataFrame:
    return normalized(t).select("seq", "employment_type")


@query("remote_mode", _norm("seq, remote_status"))
def remote_mode(t: Tables) -> DataFrame:
    return normalized(t).select("seq", "remote_status")


@query("location_split", _norm("seq, location, city, country"))
def location_split(t: Tables) -> DataFrame:
    return normalized(t).select("seq", "location", "city", "country")


@query("canonical_url", f"SELECT page_id, {q.link('url')} AS canonical FROM pages")
def canonical_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(
    "payload_fingerprint",
    """SELECT lang, count(*) AS n_rows, count(DISTINCT (text, source)) AS n_prints FROM documents GROUP BY lang""",
)
def payload_fingerprint(t: Tables) -> DataFrame:
    prints = t.documents.select("lang", identity.payload_hash(["text", "source"]).alias("p"))
    return prints.groupBy("lang").agg(
        F.count("*").alias("n_rows"), F.count_distinct("p").alias("n_prints")
    )


# Raw payloads: one content per customer, its keys in another order (and with other blanks) in each order row.
_PAYLOADS = """
SELECT o_custkey AS customer, CASE o_orderkey % 3
 WHEN 0 THEN concat('{{"id":', CAST(o_custkey AS STRING), ',"who":{{"name":"c', CAST(o_custkey % 9 AS STRING), '","place":{{"a":[', CAST(o_custkey % 5 AS STRING), ',2],"b":null}}}},"n":"x"}}')
 WHEN 1 THEN concat('{{"n":"x","who":{{"place":{{"b":null,"a":[', CAST(o_custkey % 5 AS STRING), ',2]}},"name":"c', CAST(o_custkey % 9 AS STRING), '"}},"id":', CAST(o_custkey AS STRING), '}}')
 ELSE concat('{{ "who" : {{"name":"c', CAST(o_custkey % 9 AS STRING), '", "place": {{"b":null, "a":[ ', CAST(o_custkey % 5 AS STRING), ' , 2]}}}},  "id":', CAST(o_custkey AS STRING), ', "n" : "x" }}') END AS payload
FROM {orders}
"""


@query("nested_fingerprint", "SELECT o_custkey AS customer, 1 AS customers, count(*) AS n FROM orders GROUP BY o_custkey")
def nested_fingerprint(t: Tables) -> DataFrame:
    """Payloads by fingerprint: equal contents meet whatever the order of their keys, others do not."""
    prints = t.sql(_PAYLOADS).select("customer", identity.nested_hash(F.col("payload")).alias("print"))
    groups = prints.groupBy("print").agg(F.min("customer").alias("customer"), F.count_distinct("customer").cast("int").alias("customers"), F.count("*").alias("n"))
    return groups.select("customer", "customers", "n")


@query("skill_list", _norm("seq, array_to_string(skills, '|') AS skills, CAST(len(skills) AS INTEGER) AS n"))
def skill_list(t: Tables) -> DataFrame:
    return normalized(t).select("seq", F.array_join("skills", "|").alias("skills"), F.size("skills").alias("n"))


@query("range_repair", _norm("seq, experience_min, experience_max"))
def range_repair(t: Tables) -> DataFrame:
    return normalized(t).select("seq", "experience_min", "experience_max")


_SPARSE = """
SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'fixture' WHEN 1 THEN 'indeed' ELSE 'fixture_web' END AS source,
 CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE o_orderpriority END AS company_name,
 CASE WHEN o_orderkey % 4 = 0 THEN concat('Customer ', CAST(o_custkey AS STRING)) ELSE NULL END AS context_name,
 CASE WHEN o_orderkey % 5 < 3 THEN concat(' hint  ', CAST(o_custkey AS STRING)) ELSE NULL END AS company_hint,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('https://a.example/', CAST(o_custkey AS STRING)) END AS source_url,
 concat('https://b.example/', CAST(o_custkey AS STRING)) AS url, CASE WHEN o_orderkey % 6 = 1 THEN 'true' ELSE 'false' END AS _fixture
FROM {orders}
"""


@query(
    "field_fallback",
    f"""SELECT seq, coalesce({q.clean('company_name')}, context_name, {q.clean('company_hint')}, '') AS company_name,
 coalesce(source_url, url) AS source_url, source LIKE 'fixture%' OR _fixture = 'true' AS is_fixture FROM ({duck(_SPARSE)})""",
)
def field_fallback(t: Tables) -> DataFrame:
    return normalize_postings(t.sql(_SPARSE)).select("seq", "company_name", "source_url", "is_fixture")


@query(
    "normalize_postings",
    _norm(
        "seq, source, source_job_id, company_name, title, source_url, canonical_url, location, city, country, "
        "remote_status, employment_type, experience_min, experience_max, sha256(description) AS description_digest, "
        "array_to_string(skills, '|') AS skills, salary_max, posted_date, content_hash"
    ),
)
def normalize(t: Tables) -> DataFrame:
    return normalized(t).select(
        "seq", "source", "source_job_id", "company_name", "title", "source_url", "canonical_url", "location", "city",
        "country", "remote_status", "employment_type", "experience_min", "experience_max",
        F.sha2("description", 256).alias("description_digest"), F.array_join("skills", "|").alias("skills"),
        "salary_max", "posted_date", "content_hash",
    )


@query("entity_key", _norm(f"seq, {q.name_key('company_name')} AS name_key"))
def entity_key(t: Tables) -> DataFrame:
    return normalized(t).select("seq", identity.entity_key(F.col("company_name")).alias("name_key"))


@query("identity_hash", f"WITH {q.NORM} SELECT content_hash, count(*) AS n, min(seq) AS first_seq FROM norm GROUP BY content_hash")
def identity_hash(t: Tables) -> DataFrame:
    return normalized(t).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("domain_key", f"SELECT page_id, {q.domain('url')} AS domain, {q.host('url')} AS host FROM pages")
def domain_key(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", urls.domain_key(F.col("url")).alias("domain"), urls.url_host(F.col("url")).alias("host")
    )


_SOURCE_NAMES = """
SELECT event_id, CASE event_type WHEN 'view' THEN 'Generic' WHEN 'click' THEN 'LEVER' WHEN 'error' THEN 'naukri' WHEN 'signup' THEN 'company_careers' ELSE NULL END AS source
FROM {events}
"""


@query(
    "source_tier",
    f"""SELECT event_id, CASE WHEN lower(source) IN ('generic', 'company_careers') THEN 1 WHEN lower(source) = 'lever' THEN 2 ELSE 3 END AS tier,
 CASE WHEN lower(source) IN ('generic', 'company_careers') THEN 'company_careers' WHEN lower(source) = 'lever' THEN 'ats'
 WHEN lower(source) = 'naukri' THEN 'job_board' ELSE 'other' END AS type FROM ({duck(_SOURCE_NAMES)})""",
)
def source_tier(t: Tables) -> DataFrame:
    source = F.col("source")
    return t.sql(_SOURCE_NAMES).select(
        "event_id", identity.source_tier(source).alias("tier"), identity.source_type(source).alias("type")
    )


@query("experience_label", _norm(f"seq, {q.span('experience_min', 'experience_max')} AS label"))
def experience_label(t: Tables) -> DataFrame:
    return normalized(t).select(
        "seq", text.experience_label(F.col("experience_min"), F.col("experience_max")).alias("label")
    )
