"""Registered queries of the extraction engine over whole tables, each with the SQL of the same rows where SQL can say it.

German-format numbers do not occur in the driver's tables, so the check-digit
queries make candidates from keys: a payload and each of ten digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import checks as C
from spanloom.functions import places
from spanloom.functions import sentences as S
from spanloom.functions import text as T
from spanloom.operators import crf
from spanloom.operators import dictionary as D
from spanloom.operators import grouping, matching, metrics, neural, weights
from spanloom.plans import extract as plans
from spanloom.sources import gazetteers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = r"[^\x20\x09-\x0D]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame, each: int) -> DataFrame:
    """The rows of a table, dealt over tasks of about `each` rows where a task would read more than twice as many.

    Spark splits a file no further than its row groups, so a table of short rows
    may be one task, however much work a row is.  Counting reads no column, and
    the tasks grow in number with the table and not in size.
    """
    tasks = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    most, every = tasks.agg(F.max("n"), F.sum("n")).first()
    return rows if (most or 0) <= 2 * each else rows.repartition(-(-every // each))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of all documents, for work that takes long on each."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"), 1000)


def digit_candidates(spark: SparkSession, sf_dir: str, payload: Column, tail: Column | None = None) -> DataFrame:
    """k, value: payload, a digit 0 to 9 (and tail) for each customer."""
    rows = spread(read(spark, sf_dir, "customer").select("c_custkey"), 10_000).select(F.col("c_custkey").alias("k"), payload.alias("payload"))
    rows = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(9))))
    parts = ["payload", F.col("d").cast("string")] + ([tail] if tail is not None else [])
    return rows.select("k", F.concat(*parts).alias("value"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as documents."""
    return spread(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), 1000).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select("doc_id", F.posexplode(T.matches(F.col("text"), WORDS)).alias("tok_id", "value"))
    return t.select("doc_id", F.lit(0).alias("sent_id"), "tok_id", "value")


TURNS = "turns as (select conv_id * 1000 + turn as doc_id, coalesce(text, '') as text from conversations)"
TOKENS = TURNS + r""", words as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from turns),
tokens as (select doc_id, 0 as sent_id, unnest(range(0, len(w)))::int as tok_id, unnest(w) as value from words)"""


def root_sql(n: str) -> str:
    return f"(case when ({n}) = 0 then 0 else (({n}) - 1) % 9 + 1 end)"


def candidates_sql(payload: str, tail: str = "''") -> str:
    return f"with c as (select c_custkey as k, {payload} || d::varchar || {tail} as value from customer, range(10) t(d)), "


# -- flagship ----------------------------------------------------------------

EMAIL_RE = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
CARD_RE = r"[0-9]{13,16}"

FOUND_SQL = rf"""
mails as (select doc_id, unnest(regexp_extract_all(text, '{EMAIL_RE}')) as value, 'Email' as label from documents),
runs as (select doc_id, unnest(regexp_extract_all(text, '{CARD_RE}')) as value from documents),
cards as (select doc_id, value, 'CreditCard' as label from runs where
  (10 - list_sum(list_transform(range(0, length(value) - 1), lambda i: case when i % 2 = 0 then substr(value, i + 1, 1)::int * 2 - case when substr(value, i + 1, 1)::int > 4 then 9 else 0 end else substr(value, i + 1, 1)::int end)) % 10) % 10 = right(value, 1)::int),
found as (select * from mails union all select * from cards)"""


def mails_and_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mails = F.transform(T.matches(F.col("text"), EMAIL_RE), lambda v: F.struct(v.alias("value"), F.lit("Email").alias("label")))
    cards = F.filter(T.matches(F.col("text"), CARD_RE), lambda v: C.luhn(v))
    cards = F.transform(cards, lambda v: F.struct(v.alias("value"), F.lit("CreditCard").alias("label")))
    return docs.select("doc_id", F.explode(F.concat(mails, cards)).alias("e")).select("doc_id", "e.value", "e.label")


@query(
    f"with {FOUND_SQL}, labels as (select doc_id, label, count(*) as n, 100 * count(*) // sum(count(*)) over (partition by doc_id) as share from found group by doc_id, label)"
    """ select doc_id, sum(n)::bigint as n_entities, count(*) as n_categories,
    sum(10 + 2 * n + n * (case when label = 'CreditCard' then 30 else 1 end)
      + n * (case when label = 'CreditCard' then (case when share <= 50 then 1 when share <= 74 then 2 when share <= 89 then 3 else 5 end)
             else (case when share <= 50 then 0 when share <= 74 then -1 when share <= 89 then -2 else -3 end) end))::bigint as score
    from labels group by doc_id"""
)
def doc_relevance(spark, sf_dir):
    return metrics.relevance(mails_and_cards(spark, sf_dir))


@query(f"with {FOUND_SQL} select label, count(*) as n_entities, count(distinct doc_id) as n_docs from found group by label")
def label_counts(spark, sf_dir):
    return metrics.label_counts(mails_and_cards(spark, sf_dir))


@query(rf"select doc_id, unnest(regexp_extract_all(text, '{EMAIL_RE}')) as email from documents")
def email_extract(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(T.matches(F.col("text"), EMAIL_RE)).alias("email"))


URL_RE = r"(?:https?://|www\.)[^\s<>\"']*[A-Za-z0-9/]"


@query("select page_id, unnest(regexp_extract_all(html, '" + URL_RE.replace("'", "''") + "')) as url from pages")
def url_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(T.matches(F.col("html"), URL_RE)).alias("url"))


@query(r"""with u as (select page_id, unnest([url, 'mailto:info@' || page_id || '.example.com', 'user' || page_id || '[at]host.de', 'ftp://a@b/' || page_id]) as address from pages)
select page_id, address, regexp_matches(address, '@|\(at\)|\[at\]') and not (regexp_matches(address, '^[A-Za-z]+:') and regexp_matches(address, '^[A-Za-z]+:.*/')) as is_email from u""")
def email_classify(spark, sf_dir):
    i = F.col("page_id").cast("string")
    made = F.array(F.col("url"), F.concat(F.lit("mailto:info@"), i, F.lit(".example.com")), F.concat(F.lit("user"), i, F.lit("[at]host.de")), F.concat(F.lit("ftp://a@b/"), i))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(made).alias("address")).withColumn("is_email", T.is_email(F.col("address")))


@query(r"select page_id, regexp_replace(url || suffix, '[\x21-\x2e\x3a-\x40\x5b-\x60\x7b-\x7e]+$', '') as url from pages, (values ('.'), ('),'), ('/!'), ('x')) s(suffix)")
def url_trim(spark, sf_dir):
    """Addresses without punctuation at the end, other than a slash."""
    pages = read(spark, sf_dir, "pages").withColumn("suffix", F.explode(F.array(*map(F.lit, (".", "),", "/!", "x")))))
    return pages.select("page_id", F.regexp_replace(F.concat("url", "suffix"), r"[\x21-\x2e\x3a-\x40\x5b-\x60\x7b-\x7e]+$", "").alias("url"))


# -- check digits ------------------------------------------------------------


@query(
    candidates_sql("lpad((c_custkey * 104729)::varchar, 15, '4')")
    + "s as (select *, list_sum(list_transform(range(0, 15), lambda i: case when i % 2 = 0 then substr(value, i + 1, 1)::int * 2 - case when substr(value, i + 1, 1)::int > 4 then 9 else 0 end else substr(value, i + 1, 1)::int end)) as s from c) select k, value from s where (10 - s % 10) % 10 = right(value, 1)::int"
)
def card_luhn(spark, sf_dir):
    return digit_candidates(spark, sf_dir, F.lpad((F.col("c_custkey") * 104729).cast("string"), 15, "4")).where(C.luhn(F.col("value")))


@query(r"""with c as (select c_custkey as k, unnest(['DE' || lpad((c_custkey * 7919)::varchar, 20, '1'), 'DE12 3456 7890 1234 5678 ' || lpad((c_custkey % 100)::varchar, 2, '0'), 'FR' || lpad(c_custkey::varchar, 20, '0'), 'DE' || c_custkey]) as value from customer)
select k, value, regexp_matches(value, '^DE[0-9A-Z]{20}$|^DE[0-9]{2}( [0-9]{4}){4} [0-9]{2}$') as shaped,
  coalesce(regexp_matches(replace(value, ' ', ''), '^[A-Z]{2}[0-9]{2}[0-9A-Z]{10,30}$') and list_reduce(list_prepend(0, list_transform(range(1, length(replace(value, ' ', '')) + 1),
    lambda i: ascii(substr(substr(replace(value, ' ', ''), 5) || substr(replace(value, ' ', ''), 1, 4), i, 1)))), lambda a, c: (a * (case when c > 57 then 100 else 10 end) + (case when c > 57 then c - 55 else c - 48 end)) % 97) = 1, false) as valid from c""")
def iban_shape(spark, sf_dir):
    k = F.col("c_custkey")
    made = F.array(
        F.concat(F.lit("DE"), F.lpad((k * 7919).cast("string"), 20, "1")),
        F.concat(F.lit("DE12 3456 7890 1234 5678 "), F.lpad((k % 100).cast("string"), 2, "0")),
        F.concat(F.lit("FR"), F.lpad(k.cast("string"), 20, "0")),
        F.concat(F.lit("DE"), k.cast("string")),
    )
    rows = read(spark, sf_dir, "customer").select(k.alias("k"), F.explode(made).alias("value"))
    return rows.withColumn("shaped", C.iban_shape(F.col("value"))).withColumn("valid", C.iban_valid(F.col("value")))


@query(
    candidates_sql("chr((65 + c_custkey % 26)::int) || lpad(c_custkey::varchar, 8, '0')")
    + f"""s as (select *, {root_sql("(ascii(value) - 64) // 10")} + {root_sql("(ascii(value) - 64) % 10 * 2")}
      + list_sum(list_transform(range(0, 8), lambda i: {root_sql("substr(value, i + 2, 1)::int * (1 + i % 2)")})) as s from c) select k, value from s where s % 10 = right(value, 1)::int"""
)
def health_ins_check(spark, sf_dir):
    k = F.col("c_custkey")
    payload = F.concat(F.char(F.lit(65) + F.pmod(k, F.lit(26))), F.lpad(k.cast("string"), 8, "0"))
    return digit_candidates(spark, sf_dir, payload).where(C.health_insurance(F.col("value")))


@query(
    candidates_sql("['J010', 'N070', 'F010', 'XXXX'][c_custkey % 4 + 1] || lpad((c_custkey * 31 % 100000)::varchar, 5, '0')", "'1'")
    + """s as (select *, list_sum(list_transform(range(0, 9), lambda i: (9 - i) * (case when ascii(substr(value, i + 1, 1)) > 57 then ascii(substr(value, i + 1, 1)) - 55 else ascii(substr(value, i + 1, 1)) - 48 end))) % 11 as s from c)
      select k, value from s where left(value, 4) in ('J010', 'N070', 'F010') and s::varchar = substr(value, 10, 1)"""
)
def driver_lic_check(spark, sf_dir):
    k = F.col("c_custkey")
    authority = F.element_at(F.array(*map(F.lit, ("J010", "N070", "F010", "XXXX"))), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    payload = F.concat(authority, F.lpad((k * 31 % 100000).cast("string"), 5, "0"))
    known = spark.createDataFrame([("J010",), ("N070",), ("F010",)], "prefix string")
    rows = digit_candidates(spark, sf_dir, payload, F.lit("1")).where(C.driver_licence_digit(F.col("value")))
    return rows.join(F.broadcast(known), F.substring("value", 1, 4) == F.col("prefix"), "left_semi")


@query(
    candidates_sql("lpad((c_custkey % 100)::varchar, 2, '0') || lpad((c_custkey * 37 % 1000000)::varchar, 6, '0') || chr((65 + c_custkey % 26)::int) || lpad((c_custkey % 100)::varchar, 2, '0')")
    + f"""s as (select *, list_sum(list_transform(range(0, 8), lambda i: {root_sql("substr(value, i + 1, 1)::int * [2, 1, 2, 5, 7, 1, 2, 1][i + 1]")}))
      + {root_sql("(ascii(substr(value, 9, 1)) - 64) // 10 * 2")} + {root_sql("(ascii(substr(value, 9, 1)) - 64) % 10")} + {root_sql("substr(value, 10, 1)::int * 2")} + {root_sql("substr(value, 11, 1)::int")} as s, left(value, 2)::int as area from c)
      select k, value from s where s % 10 = right(value, 1)::int and (area between 2 and 4 or area between 8 and 21 or area between 23 and 26 or area in (28, 29, 89) or area between 38 and 40 or area between 42 and 82)"""
)
def ssn_check(spark, sf_dir):
    k = F.col("c_custkey")
    two = F.lpad((k % 100).cast("string"), 2, "0")
    payload = F.concat(two, F.lpad((k * 37 % 1000000).cast("string"), 6, "0"), F.char(F.lit(65) + F.pmod(k, F.lit(26))), two)
    return digit_candidates(spark, sf_dir, payload).where(C.social_security(F.col("value")))


@query(
    candidates_sql("lpad((c_custkey * 7919)::varchar, 10, '1')")
    + """s as (select *, list_reduce(list_prepend(10, list_transform(range(0, 10), lambda i: substr(value, i + 1, 1)::int)), lambda p, d: (case when (p + d) % 10 = 0 then 10 else (p + d) % 10 end) * 2 % 11) as p from c)
      select k, value from s where (11 - p) % 10 = right(value, 1)::int"""
)
def tax_new_check(spark, sf_dir):
    return digit_candidates(spark, sf_dir, F.lpad((F.col("c_custkey") * 7919).cast("string"), 10, "1")).where(C.tax_id(F.col("value")))


@query("""with c as (select o_orderkey as k, (o_orderkey * 104729)::varchar as value from orders)
select k, value from c where length(value) between 10 and 13 and (left(value, 3) in ('918', '218', '105') or left(value, 2) in ('21', '93', '10'))""")
def tax_old_prefix(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 104729).cast("string").alias("value"))
    return rows.where(C.tax_number_old(F.col("value"), ["918", "218", "105", "21", "93", "10"]))


@query(
    candidates_sql("['C', 'A', 'L', 'Z'][c_custkey % 4 + 1] || lpad((c_custkey * 733)::varchar, 7 + (c_custkey % 2)::int, '0')")
    + """s as (select *, list_sum(list_transform(range(0, length(value) - 1), lambda i: [7, 3, 1][i % 3 + 1] * (case when ascii(substr(value, i + 1, 1)) > 57 then ascii(substr(value, i + 1, 1)) - 55 else substr(value, i + 1, 1)::int end))) % 10 = right(value, 1)::int as digit,
      regexp_matches(value, '^[A-G][0-9]{7,8}$') as child, regexp_matches(value, '^[CFGHJKLMNPRTVWXY][0-9CFGHJKLMNPRTVWXYZ]{8,9}$') as new from c)
      select k, value from s where (length(value) = 8 and child) or (length(value) = 9 and ((child and digit) or new)) or (length(value) = 10 and new and digit)"""
)
def passport_check(spark, sf_dir):
    k = F.col("c_custkey")
    first = F.element_at(F.array(*map(F.lit, "CALZ")), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    number = (k * 733).cast("string")
    payload = F.concat(first, F.when(k % 2 == 0, F.lpad(number, 7, "0")).otherwise(F.lpad(number, 8, "0")))
    return digit_candidates(spark, sf_dir, payload).where(C.passport(F.col("value")))


@query("""select o_orderkey as k, try_cast(10000000 + o_orderkey * 17 as int) as code from orders where 10000000 + o_orderkey * 17 in (select 10000000 + s_suppkey * 34 from supplier)""")
def bank_code_membership(spark, sf_dir):
    """Codes that a list has: a semi-join with the list, which the optimizer may broadcast by its size."""
    codes = read(spark, sf_dir, "supplier").select((F.lit(10000000) + F.col("s_suppkey") * 34).try_cast("int").alias("code"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.lit(10000000) + F.col("o_orderkey") * 17).try_cast("int").alias("code"))
    return rows.join(codes, "code", "left_semi").select("k", "code")


@query(r"""with c as (select c_custkey as k, ['B', 'MH', 'HSK', 'KA', 'XYZ', 'Q'][c_custkey % 6 + 1] || '-' || chr((65 + c_custkey % 26)::int) || ' ' || (c_custkey % 9999) as value from customer)
select k, value, regexp_extract(value, '^([A-Z]{1,3})-', 1) as area from c where regexp_matches(value, '^[A-Z]{1,3}-[A-Z]{1,2} [0-9]{1,4}$') and regexp_extract(value, '^([A-Z]{1,3})-', 1) in ('B', 'MH', 'HSK', 'KA')""")
def car_plate_area(spark, sf_dir):
    k = F.col("c_custkey")
    area = F.element_at(F.array(*map(F.lit, ("B", "MH", "HSK", "KA", "XYZ", "Q"))), (F.pmod(k, F.lit(6)) + 1).cast("int"))
    value = F.concat(area, F.lit("-"), F.char(F.lit(65) + F.pmod(k, F.lit(26))), F.lit(" "), (k % 9999).cast("string"))
    rows = read(spark, sf_dir, "customer").select(k.alias("k"), value.alias("value")).where(F.col("value").rlike("^[A-Z]{1,3}-[A-Z]{1,2} [0-9]{1,4}$"))
    known = spark.createDataFrame([(a,) for a in ("B", "MH", "HSK", "KA")], "area string")
    return rows.withColumn("area", F.regexp_extract("value", "^([A-Z]{1,3})-", 1)).join(F.broadcast(known), "area", "left_semi").select("k", "value", "area")


@query(r"""with c as (select c_custkey as k, ['030', '+4989', '0049 221', '0711', '0999'][c_custkey % 5 + 1] || '/' || (c_custkey * 31) as number from customer),
d as (select *, regexp_replace(regexp_replace(number, '[^0-9]', '', 'g'), '^(490|49|0)', '') as digits from c), p(prefix, city) as (values ('30', 'Berlin'), ('89', 'München'), ('049221', 'Köln'), ('0492', 'x'), ('711', 'Stuttgart'), ('7', 'y'))
select k, number, arg_max(prefix, length(prefix)) as prefix, arg_max(city, length(prefix)) as city from d join p on starts_with(digits, prefix) group by k, number""")
def prefix_match_longest(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.element_at(F.array(*map(F.lit, ("030", "+4989", "0049 221", "0711", "0999"))), (F.pmod(k, F.lit(5)) + 1).cast("int"))
    rows = read(spark, sf_dir, "customer").select(k.alias("k"), F.concat(code, F.lit("/"), (k * 31).cast("string")).alias("number"))
    known = spark.createDataFrame([("30", "Berlin"), ("89", "München"), ("049221", "Köln"), ("0492", "x"), ("711", "Stuttgart"), ("7", "y")], "prefix string, city string")
    rows = rows.withColumn("digits", C.area_code(F.col("number")))
    return matching.longest_prefix(rows, "digits", F.broadcast(known), [1, 2, 3, 4, 6]).select("k", "number", "prefix", "city")


@query("""with c as (select o_orderkey as k, unnest([strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%d/%m/%y'), strftime(o_orderdate, '%Y-%m-%d'), '32.01.2000']) as t, o_orderdate::date as d from orders)
select k, t, (case when t = '32.01.2000' then null else d end)::varchar as d from c""")
def date_parse(spark, sf_dir):
    d = F.col("o_orderdate")
    made = F.array(F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "dd/MM/yy"), F.date_format(d, "yyyy-MM-dd"), F.lit("32.01.2000"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.explode(made).alias("t"))
    return rows.withColumn("d", C.parse_date(F.col("t")).cast("string"))


@query(r"""with c as (select c_custkey as k, ['Haupt', 'Lange ', 'Nord'][c_custkey % 3 + 1] || ['straße', 'str.', 'weg', 'hof', 'PLATZ'][c_custkey % 5 + 1] as street, (c_custkey % 200) || ['', 'a', '-3', ' x'][c_custkey % 4 + 1] as house from customer)
select k, street, house, regexp_matches(lower(street), '(straße|strasse|str\.|allee|platz|weg|ring|markt|berg)$') as is_street, regexp_matches(house, '^[0-9][0-9A-Za-zÄÖÜäöüß-]*$') as is_house from c""")
def street_and_house(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(k, F.lit(len(words))) + 1).cast("int"))
    rows = read(spark, sf_dir, "customer").select(
        k.alias("k"), F.concat(pick(["Haupt", "Lange ", "Nord"]), pick(["straße", "str.", "weg", "hof", "PLATZ"])).alias("street"), F.concat((k % 200).cast("string"), pick(["", "a", "-3", " x"])).alias("house")
    )
    return rows.withColumn("is_street", C.street_suffix(F.col("street"))).withColumn("is_house", C.house_number(F.col("house")))


@query(r"with " + TOKENS + r", s as (select value, regexp_matches(value, '^[A-ZÄÖÜ][A-ZÄÖÜ.&+-]+$') as abbreviation, regexp_matches(value, '^\p{Lu}') as first_upper from tokens) select abbreviation, first_upper, count(*) as n from s group by all")
def upper_tests(spark, sf_dir):
    """Tokens by whether they are capital abbreviations and begin with a capital."""
    t = turn_tokens(spark, sf_dir).select(C.upper_abbreviation(F.col("value")).alias("abbreviation"), F.col("value").rlike(r"^\p{Lu}").alias("first_upper"))
    return t.groupBy("abbreviation", "first_upper").agg(F.count("*").alias("n"))


@query(r"""with c as (select o_orderkey as k, ['(a)[b]{c}', '(a', 'b)', '([x)]', '((y))'][o_orderkey % 5 + 1] || o_orderkey as value, [true, false, false, false, true][o_orderkey % 5 + 1] as balanced from orders) select * from c""")
def bracket_balance(spark, sf_dir):
    k = F.col("o_orderkey")
    made = F.element_at(F.array(*map(F.lit, ("(a)[b]{c}", "(a", "b)", "([x)]", "((y))"))), (F.pmod(k, F.lit(5)) + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select(k.alias("k"), F.concat(made, k.cast("string")).alias("value"))
    return rows.withColumn("balanced", T.bracket_balance(F.col("value")))


# -- text --------------------------------------------------------------------


def _count_sql(pattern: str) -> str:
    return f"(length(value) - length(regexp_replace(value, '{pattern}', '', 'g')))"


SHAPE_SQL = rf"""
m as (select value, length(value) as n, {_count_sql(r'\p{Nd}')} as digits, {_count_sql(r'\p{Lu}')} as uppers, {_count_sql(r'\p{Ll}')} as lowers, {_count_sql(r'\.')} as dots, {_count_sql('[-—–]')} as hyphens, {_count_sql('[IVXLCDM]')} as roman,
  regexp_matches(value, '^\p{{Lu}}') as fu, regexp_matches(value, '^\p{{Ll}}') as fl from tokens),
s as (select value, case
  when dots = 0 and digits > 0 and n > 1 and (fu or (uppers > 0 and regexp_matches(value, '^.[^\p{{Lu}}\p{{Ll}}]*\p{{Lu}}'))) then 'NumCapital'
  when uppers > 1 and dots = 0 and (roman = n or roman + hyphens = n) then 'LatinCapital'
  when uppers > 1 and dots = 0 and (uppers = n or uppers + hyphens = n) then 'AllCapital'
  when uppers > 1 and dots > 0 and uppers + dots = n then 'AllCapitalWithDot'
  when uppers > 1 and dots > 0 and uppers + dots + hyphens = n then 'MixCapitalWithDot'
  when uppers > 0 and dots = 0 and (roman = n or roman + hyphens = n) then 'LatinCapital'
  when uppers = 1 and n = 1 then 'OneCapital'
  when uppers > 0 and dots = 1 and ((n = 2 and fu) or (n = 3 and regexp_matches(value, '^[-—–]\p{{Lu}}'))) then 'OneCapitalWithDot'
  when uppers = 1 and fu and lowers + 1 = n then 'LatinFirstCapital'
  when uppers > 0 and fu then 'MixCapital'
  when uppers > 0 and fl and digits = 0 and dots = 0 then 'FirstLowerWithUpper'
  when regexp_matches(value, '^["''«»“”„‘’‚‹›]') then 'Quote'
  when lowers = 0 and uppers = 0 and digits > 0 then 'Num' else 'Other' end as shape from m)"""


@query(f"with {TOKENS}, {SHAPE_SQL} select shape, count(*) as n from s group by shape")
def token_shapes(spark, sf_dir):
    return turn_tokens(spark, sf_dir).groupBy(T.shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n"))


@query(f"with {TOKENS} select doc_id, count(*) as n_tokens, sum(length(value))::bigint as n_chars from tokens group by doc_id")
def token_counts(spark, sf_dir):
    return turn_tokens(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.length("value")).alias("n_chars"))


@query("select doc_id, upper(replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'Ä', 'AE'), 'Ö', 'OE'), 'Ü', 'UE')) as folded from documents")
def umlaut_fold(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.folded_upper(F.col("text")).alias("folded"))


@query(r"""with c as (select c_custkey as k, c_name || c_custkey || 'x' || (c_custkey % 7) as value from customer), p as (select k, regexp_extract_all(value, '[0-9]+|[^0-9]+') as r from c)
select k, unnest(range(0, len(r)))::int as place, unnest(r) as part from p""")
def unstick_numbers(spark, sf_dir):
    value = F.concat("c_name", F.col("c_custkey").cast("string"), F.lit("x"), (F.col("c_custkey") % 7).cast("string"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.posexplode(T.unstick(value)).alias("place", "part"))


@query(r"with " + TOKENS + r" select doc_id, tok_id, left(value, 2) || regexp_replace(substr(value, 3), '\p{P}+$', '') as trimmed from tokens")
def trim_punct(spark, sf_dir):
    return turn_tokens(spark, sf_dir).select("doc_id", "tok_id", T.trim_punctuation(F.col("value")).alias("trimmed"))


@query(r"with " + TOKENS + r""", p as (select *, case when regexp_matches(value, '[0-9]') and not regexp_matches(value, '[A-Za-z]') then '[%NUM%]' else value end as v from tokens),
q as (select *, lag(v) over (partition by doc_id order by tok_id) as before from p)
select doc_id, list(v order by tok_id) as words from q where not (v = '[%NUM%]' and before is not distinct from '[%NUM%]') group by doc_id""")
def num_placeholder(spark, sf_dir):
    rows = turns(spark, sf_dir).select("doc_id", T.number_placeholders(T.matches(F.col("text"), WORDS)).alias("words"))
    return rows.where(F.size("words") > 0)


@query(f"with {TOKENS}, " + r"""w as (select doc_id, list(replace(upper(value), 'ẞ', 'ß') order by tok_id) as words from tokens group by doc_id) select doc_id, words, len(words)::bigint as n from w""")
def model_tokens(spark, sf_dir):
    """Upper-case model input, whole (neural.chunked parts what is too long for a model)."""
    words = F.transform(T.matches(F.col("text"), WORDS), T.upper)
    return turns(spark, sf_dir).select("doc_id", words.alias("words"), F.size(words).cast("long").alias("n")).where("n > 0")


# -- joins -------------------------------------------------------------------

PHRASES = [("OF THE", "a"), ("OF", "b"), ("THE AND", "c"), ("THE", "d"), ("DE LA", "e"), ("IS A THE", "f"), ("FOR THE", "g"), ("UND DER", "h")]
PHRASES_SQL = "phrases(key, entry) as (values " + ", ".join(f"('{k}', '{e}')" for k, e in PHRASES) + ")"
FOLD_SQL = "upper(replace(replace(replace(replace(value, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'))"


def _phrases(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(PHRASES, "key string, entry string"))


@query(f"""with {TOKENS}, {PHRASES_SQL}, f as (select *, {FOLD_SQL} as u from tokens),
g as (select *, lead(u) over w as u2, lead(u, 2) over w as u3 from f window w as (partition by doc_id order by tok_id)),
k as (select doc_id, tok_id, 1 as n_tok, u as key from g union all select doc_id, tok_id, 2, u || ' ' || u2 from g where u2 is not null union all select doc_id, tok_id, 3, u || ' ' || u2 || ' ' || u3 from g where u3 is not null)
select doc_id, tok_id, n_tok, entry from (select k.*, entry, row_number() over (partition by doc_id, tok_id order by n_tok desc) as r from k join phrases using (key)) where r = 1""")
def phrase_match_longest(spark, sf_dir):
    return matching.phrase_matches(turn_tokens(spark, sf_dir), _phrases(spark), 3).select("doc_id", "tok_id", "n_tok", "entry")


@query(f"""with {TOKENS}, {PHRASES_SQL}, f as (select *, {FOLD_SQL} as u from tokens),
g as (select *, lag(u) over w as u2, lag(u, 2) over w as u3 from f window w as (partition by doc_id order by tok_id)),
k as (select doc_id, tok_id, 1 as n_tok, u as key from g union all select doc_id, tok_id, 2, u2 || ' ' || u from g where u2 is not null union all select doc_id, tok_id, 3, u3 || ' ' || u2 || ' ' || u from g where u3 is not null)
select doc_id, tok_id, n_tok, entry from (select k.*, entry, row_number() over (partition by doc_id, tok_id order by n_tok desc) as r from k join phrases using (key)) where r = 1""")
def phrase_match_left(spark, sf_dir):
    return matching.phrase_matches(turn_tokens(spark, sf_dir), _phrases(spark), 3, to_left=True).select("doc_id", "tok_id", "n_tok", "entry")


@query(rf"""with t as (select doc_id, unnest(regexp_extract_all(text, '{WORDS}')) as value from documents where lang = 'de'), l(word) as (values ('FÜR'), ('DIE'), ('ÜBER'), ('GESCH')), n as (select distinct replace(replace(replace(word, 'Ä', 'AE'), 'Ö', 'OE'), 'Ü', 'UE') as word from l)
select value, case when upper(value) in (select word from l) then 'exact' else 'folded' end as matched_by, count(*) as n from t where upper(value) in (select word from l) or {FOLD_SQL} in (select word from n) group by all""")
def umlaut_fallback_match(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("lang = 'de'")
    tokens = docs.select("doc_id", F.explode(T.matches(F.col("text"), WORDS)).alias("value"))
    words = F.broadcast(spark.createDataFrame([(w,) for w in ("FÜR", "DIE", "ÜBER", "GESCH")], "word string"))
    return matching.with_fallback(tokens, words).groupBy("value", "matched_by").agg(F.count("*").alias("n"))


@query(f"with {TOKENS}, {SHAPE_SQL.replace('select value, length(value) as n', 'select doc_id, tok_id, value, length(value) as n').replace('s as (select value, case', 's as (select doc_id, tok_id, case')}" + r""",
c as (select doc_id, string_agg(case when shape = 'LatinFirstCapital' then 'C' when shape = 'Num' then 'N' else 'o' end, '' order by tok_id) as classes from s group by doc_id)
select doc_id, unnest(regexp_extract_all(classes, 'Co{1,2}C|N+o')) as classes from c""")
def class_pattern_match(spark, sf_dir):
    """Sequences of token classes: a capital, one or two others, a capital; or numbers and another."""
    shape = T.shape(F.col("value"))
    code = F.when(shape == "LatinFirstCapital", "C").when(shape == "Num", "N").otherwise("o")
    classes = matching.class_string(turn_tokens(spark, sf_dir), code)
    return matching.class_matches(classes, "Co{1,2}C|N+o").select("doc_id", "classes")


@query(f"""with {TOKENS}, p as (select doc_id, tok_id + 1 as end_tok from tokens where lower(value) = 'of'), v as (select doc_id, tok_id, value from tokens where lower(value) in ('the', 'a', 'and'))
select doc_id, end_tok, tok_id, value from (select p.doc_id, end_tok, tok_id, value, row_number() over (partition by p.doc_id, end_tok order by tok_id) as r from p join v on p.doc_id = v.doc_id and v.tok_id between end_tok and end_tok + 3) where r = 1""")
def proximity_match(spark, sf_dir):
    t = turn_tokens(spark, sf_dir)
    preambles = t.where("lower(value) = 'of'").select("doc_id", "sent_id", (F.col("tok_id") + 1).alias("end_tok"))
    values = t.where("lower(value) in ('the', 'a', 'and')")
    return matching.first_within(preambles, values).select("doc_id", "end_tok", "tok_id", "value")


@query(f"""with {TOKENS} select a.doc_id, a.tok_id as first_tok, b.value as right_value from tokens a join tokens b on a.doc_id = b.doc_id and b.tok_id = a.tok_id + 1 where lower(a.value) = 'the' and lower(b.value) in ('and', 'of', 'the')""")
def adjacent_right(spark, sf_dir):
    t = turn_tokens(spark, sf_dir)
    left = t.where("lower(value) = 'the'").select("doc_id", "sent_id", F.col("tok_id").alias("first_tok"), (F.col("tok_id") + 1).alias("end_tok"))
    right = t.where("lower(value) in ('and', 'of', 'the')").select("doc_id", "sent_id", F.col("tok_id").alias("first_tok"), F.col("value").alias("right_value"))
    return matching.right_neighbours(left, right).select("doc_id", "first_tok", "right_value")


LINES_SQL = "li as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by all)"


#: Order lines of one task.
LINES = 150_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, each number once.  Orders are dealt over tasks of about LINES lines, which all later steps by order keep."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.repartition(max(1, -(-rows.count() // LINES)), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


def _intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = read(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13
    rules = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 40 + k % 9).cast("int").alias("start"), (5 + k % 11).cast("int").alias("len"), F.lit("R").alias("label"))
    model = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 37 + k % 17).cast("int").alias("start"), (3 + k % 23).cast("int").alias("len"), F.lit("M").alias("label"))
    return rules, model


INTERVALS_SQL = """li as (select l_orderkey as doc_id, l_linenumber as n, l_orderkey * 7 + l_linenumber * 13 as k from lineitem),
r as (select doc_id, (n * 40 + k % 9)::int as start, (5 + k % 11)::int as len, 'R' as label from li), m as (select doc_id, (n * 37 + k % 17)::int as start, (3 + k % 23)::int as len, 'M' as label from li)"""


@query(f"""with {INTERVALS_SQL}, met as (select m.doc_id, m.start, m.len, m.label, r.start as rs, r.len as rl, r.label as rb from m join r on m.doc_id = r.doc_id and r.start <= m.start + m.len and m.start <= r.start + r.len),
leftmost as (select doc_id, start, len, label, arg_min((rs, rl, rb), (rs, rl, rb)) as x from met group by doc_id, start, len, label),
wins as (select *, x[1] as rs, x[2] as rl from leftmost where start <= x[1] and len > x[2])
select doc_id, start, len, label, 'rules' as origin from r where not exists (select 1 from wins w where w.doc_id = r.doc_id and w.rs = r.start and w.rl = r.len)
union all select distinct doc_id, start, len, label, 'model' from wins
union all select doc_id, start, len, label, 'model' from m where not exists (select 1 from met where met.doc_id = m.doc_id and met.start = m.start and met.len = m.len)""")
def overlap_merge(spark, sf_dir):
    return matching.overlap_merge(*_intervals(spark, sf_dir))


@query(r"""with t as (select page_id as doc_id, ' ' || url || ' see ' as text from pages) select doc_id, 3::bigint - 1 as n_tokens, true as has_url from t""")
def url_token_merge(spark, sf_dir):
    """Tokens of a line with an address: the address is one token."""
    docs = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit(" "), F.col("url"), F.lit(" see ")).alias("text"))
    tokens = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("t")).select("doc_id", "t.start", "t.len", "t.value")
    urls = docs.select("doc_id", F.explode(T.spans(F.col("text"), r"https?://\S+")).alias("t")).select("doc_id", "t.start", "t.len", "t.value")
    merged = matching.with_url_tokens(tokens, urls)
    return merged.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("is_url").alias("has_url"))


@query("""select c_custkey, c_name from customer where c_nationkey in (select n_nationkey from nation where n_regionkey < 2) and c_custkey not in (select o_custkey from orders where o_custkey is not null)""")
def semi_anti_filter(spark, sf_dir):
    """Rows that a list has and another has not."""
    near = read(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"))
    taken = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    rows = read(spark, sf_dir, "customer").join(near, "c_nationkey", "left_semi").join(taken, "c_custkey", "left_anti")
    return rows.select("c_custkey", "c_name")


# -- windows -----------------------------------------------------------------


@query(f"""with {INTERVALS_SQL}, e as (select distinct doc_id, start, len from m), o as (select *, case when lag(start + len) over w <> start then 1 else 0 end as step from e window w as (partition by doc_id order by start, len))
select doc_id, start, len, sum(step) over (partition by doc_id order by start, len)::int as order_num from o""")
def word_order(spark, sf_dir):
    m = _intervals(spark, sf_dir)[1].select("doc_id", "start", "len").distinct()
    return grouping.word_order(m.withColumn("is_punct", F.lit(False)), ["doc_id"]).select("doc_id", "start", "len", "order_num")


@query(f"with {LINES_SQL}, " + """e as (select l_orderkey as doc_id, l_linenumber * (1 + l_orderkey % 5) as first_tok, case when l_partkey % 4 = 0 then 'File' else 'Customer' end as label, l_partkey::varchar as value from li),
a as (select *, sum(case when near then 0 else 1 end) over (partition by doc_id order by first_tok) as run from (select *, coalesce(lag(label) over w = label and first_tok - lag(first_tok + 1) over w <= 3, false) as near from e window w as (partition by doc_id order by first_tok)))
select doc_id, label, min(first_tok)::int as first_tok, (max(first_tok) + 1)::int as end_tok, count(*) as n_fields, string_agg(value, ' ' order by first_tok) as value from a group by doc_id, run, label""")
def sequence_fields(spark, sf_dir):
    """Numbers of one kind that follow each other closely are one."""
    label = F.when(F.col("l_partkey") % 4 == 0, "File").otherwise("Customer")
    place = (F.col("l_linenumber") * (1 + F.col("l_orderkey") % 5)).cast("int")
    fields = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), place.alias("first_tok"), F.lit(1).alias("n_tok"), label.alias("label"), F.col("l_partkey").cast("string").alias("value"))
    return grouping.sequence_merge(fields, ["doc_id"], 3).withColumn("end_tok", F.col("end_tok").cast("int"))


@query(f"with {LINES_SQL}, " + """e as (select l_orderkey as doc_id, l_linenumber as start, case when l_partkey % 3 = 0 then 'Name' else 'Phone' end as label, l_partkey::varchar as value from li),
a as (select *, sum((label = 'Name')::int) over (partition by doc_id order by start) as run from e),
g as (select doc_id, run, list(label order by start) as l, list(value order by start) as v from a where run > 0 group by doc_id, run having count(*) > 1)
select doc_id, (row_number() over (partition by doc_id order by run) - 1)::int as ue_id, len(l) as n_members, l[1] as label_1, v[1] as value_1, v[2] as value_2, v[3] as value_3, greatest(len(l) - 3, 0)::int as n_tail, array_to_string(list_slice(v, 4, len(v)), ' ') as tail from g""")
def united_slots(spark, sf_dir):
    """Names and what follows them, dealt into three slots and a tail."""
    label = F.when(F.col("l_partkey") % 3 == 0, "Name").otherwise("Phone")
    e = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), F.lit(1).alias("len"), label.alias("label"), F.col("l_partkey").cast("string").alias("value"), F.col("l_linenumber").alias("order_num"))
    rows = grouping.slotted(grouping.united(e, ["doc_id"], F.col("label") == "Name"), ["doc_id"], 3)
    tail = F.array_join(F.transform("tail", lambda x: x["value"]), " ")
    return rows.select("doc_id", "ue_id", "n_members", "label_1", "value_1", "value_2", "value_3", F.size("tail").alias("n_tail"), tail.alias("tail"))


@query(f"with {LINES_SQL}, " + """e as (select l_orderkey as doc_id, l_linenumber as start, 1 as len, case when l_partkey % 3 = 0 then 'Name' else 'Phone' end as label, l_linenumber * (1 + l_orderkey % 9) as order_num from li),
a as (select *, sum((label = 'Name')::int) over (partition by doc_id order by start) as run from e), b as (select *, row_number() over r as n, order_num - lag(order_num) over r as gap from a where run > 0 window r as (partition by doc_id, run order by start)),
c as (select *, max((gap > 7 and n > 2)::int) over (partition by doc_id, run order by start) as closed from b),
g as (select doc_id, run, min(start)::int as start, (max(start + len) - min(start))::int as len, count(*) as n_members from c where closed = 0 group by doc_id, run having count(*) > 1)
select doc_id, (row_number() over (partition by doc_id order by start) - 1)::int as ue_id, start, len, n_members from g""")
def united_entities(spark, sf_dir):
    li = _lines(spark, sf_dir)
    label = F.when(F.col("l_partkey") % 3 == 0, "Name").otherwise("Phone")
    e = li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), F.lit(1).alias("len"), label.alias("label"), F.lit("").alias("value"),
        (F.col("l_linenumber") * (1 + F.col("l_orderkey") % 9)).alias("order_num"),
    )
    return grouping.united(e, ["doc_id"], F.col("label") == "Name").select("doc_id", "ue_id", "start", "len", "n_members")


@query(f"with {LINES_SQL}, " + """f as (select l_orderkey as doc_id, case when l_linenumber % 2 = 1 then 'bank_code' else 'account' end as kind, l_partkey::varchar as value, (l_linenumber * (2 + l_orderkey % 5))::int as first_tok, 1 as n_tok from li),
a as (select *, case when lag(first_tok + n_tok) over w is null or first_tok - lag(first_tok + n_tok) over w > 5 then 1 else 0 end as new from f window w as (partition by doc_id order by first_tok)),
b as (select *, sum(new) over (partition by doc_id order by first_tok) as far from a), c as (select *, row_number() over (partition by doc_id, far, kind order by first_tok) as again from b)
select doc_id, min(first_tok) as first_tok, max(first_tok + n_tok) as end_tok, max(case when kind = 'bank_code' then value end) as bank_code, max(case when kind = 'account' then value end) as account from c group by doc_id, far, again""")
def bank_field_merge(spark, sf_dir):
    li = _lines(spark, sf_dir)
    f = li.select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 2 == 1, "bank_code").otherwise("account").alias("kind"), F.col("l_partkey").cast("string").alias("value"),
        (F.col("l_linenumber") * (2 + F.col("l_orderkey") % 5)).cast("int").alias("first_tok"), F.lit(1).alias("n_tok"),
    )
    return grouping.field_merge(f, ["doc_id"]).select("doc_id", "first_tok", "end_tok", "bank_code", "account")


TAG_SQL = "case value_len % 5 when 0 then 'B-PER' when 1 then 'I-PER' when 2 then 'B-ORG' when 3 then 'I-ORG' else 'O' end"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.element_at(F.array(*map(F.lit, ("B-PER", "I-PER", "B-ORG", "I-ORG", "O"))), F.pmod(F.length("value"), F.lit(5)) + 1)
    return turn_tokens(spark, sf_dir).withColumnRenamed("value", "token").withColumn("value", F.col("token")).withColumn("tag", tags)


@query(f"""with {TOKENS}, t as (select doc_id, tok_id, value, length(value) as value_len from tokens), g as (select *, {TAG_SQL} as tag from t), k as (select *, regexp_extract(tag, '^[BI]-(.*)$', 1) as kind from g),
n as (select *, (kind <> '' and (tag like 'B-%' or lag(kind) over w is null or lag(kind) over w <> kind))::int as new from k window w as (partition by doc_id order by tok_id)),
c as (select *, sum(new) over (partition by doc_id order by tok_id) as chain from n)
select doc_id, min(tok_id)::int as first_tok, count(*) as n_tok, any_value(kind) as label, string_agg(value, ' ' order by tok_id) as text from c where kind <> '' group by doc_id, chain""")
def bio_merge(spark, sf_dir):
    return grouping.bio_chains(_tagged(spark, sf_dir), ["doc_id"])


@query(f"""with {TOKENS}, t as (select *, lag(value) over w as p1, lag(value, 2) over w as p2, lead(value) over w as n1, lead(value, 2) over w as n2 from tokens window w as (partition by doc_id order by tok_id)),
b as (select doc_id, tok_id, value as p0, coalesce(p1, '__BOS__') as p1, coalesce(p2, '__BOS__') as p2, coalesce(n1, '__EOS__') as n1, coalesce(n2, '__EOS__') as n2 from t)
select doc_id, tok_id, concat_ws(chr(9), 'w[-2]=' || p2, 'w[-1]=' || p1, 'w[0]=' || p0, 'w[1]=' || n1, 'w[2]=' || n2, 'w[-2]|w[-1]=' || p2 || '|' || p1, 'w[-1]|w[0]=' || p1 || '|' || p0, 'w[0]|w[1]=' || p0 || '|' || n1, 'w[1]|w[2]=' || n1 || '|' || n2) as features from b""")
def crf_features(spark, sf_dir):
    t = turn_tokens(spark, sf_dir).withColumnRenamed("value", "w")
    return grouping.context_features(t, ["doc_id"], ["w"]).select("doc_id", "tok_id", "features")


@query(f"""with {TOKENS}, l as (select *, max(case when lower(value) = 'the' then tok_id end) over (partition by doc_id order by tok_id rows between unbounded preceding and 1 preceding) as at from tokens)
select l.doc_id, l.tok_id, case when l.tok_id - l.at <= 25 then t.value end as anchor from l left join tokens t on l.doc_id = t.doc_id and l.at = t.tok_id""")
def last_preamble(spark, sf_dir):
    t = turn_tokens(spark, sf_dir)
    return grouping.last_before(t, ["doc_id"], F.lower("value") == "the", "anchor").select("doc_id", "tok_id", "anchor")


# -- aggregates and orders ---------------------------------------------------

PAIRS_SQL = "pairs as (select quality::varchar as ref, (toxic = 0 and doc_id % 5 > 0)::int::varchar as hyp from labels)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hyp = ((F.col("toxic") == 0) & (F.col("doc_id") % 5 > 0)).cast("int").cast("string")
    return read(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("ref"), hyp.alias("hyp"))


SCORES_SQL = f"""with {PAIRS_SQL}, classes(label) as (values ('0'), ('1'), ('2')),
n as (select label, (select count(*) from pairs where ref = label and hyp = label) as tp, (select count(*) from pairs where ref = label) as n_ref, (select count(*) from pairs where hyp = label) as n_hyp from classes),
p as (select *, case when n_hyp > 0 then tp::double / n_hyp else 0.0 end as precision, case when n_ref > 0 then tp::double / n_ref else 0.0 end as recall from n),
f as (select label, tp, n_ref, n_hyp, round(precision, 9) as precision, round(recall, 9) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end, 9) as f1 from p)"""


def _label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([("0",), ("1",), ("2",)], "label string")
    out = metrics.label_scores(_pairs(spark, sf_dir), F.broadcast(classes))
    return out.select("label", "tp", "n_ref", "n_hyp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(SCORES_SQL + " select * from f")
def label_prf(spark, sf_dir):
    return _label_scores(spark, sf_dir)


@query(SCORES_SQL + " select round(avg(f1), 6) as macro_f1, count(*) as n_classes from f")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(_label_scores(spark, sf_dir)).withColumn("macro_f1", F.round("macro_f1", 6))


@query(rf"""with t as (select unnest(regexp_extract_all(text, '{WORDS}')) as token from documents), c as (select token, count(*) as n from t group by token order by n desc, token limit 1000)
select token, n, (row_number() over (order by n desc, token) + 2)::int as id from c""")
def vocab_topk(spark, sf_dir):
    tokens = read(spark, sf_dir, "documents").select(F.explode(T.matches(F.col("text"), WORDS)).alias("token"))
    return metrics.vocabulary(tokens, 1000)


@query(rf"""with l as (select len(regexp_extract_all(text, '{WORDS}')) as n from documents), b as (select (n // 100)::bigint as bucket, count(*) as n from l group by 1)
select bucket, n, round(sum(n) over (order by bucket) * 100.0::double / sum(n) over (), 6) as percent from b""")
def length_histogram(spark, sf_dir):
    lengths = read(spark, sf_dir, "documents").select(F.size(T.matches(F.col("text"), WORDS)).alias("n"))
    return metrics.length_histogram(lengths).withColumn("percent", F.round("percent", 6))


@query(f"with {TOKENS}, t as (select doc_id, value, length(value) as value_len from tokens) select {TAG_SQL} as tag, count(*) as n from t group by 1")
def tag_counts(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"""with {TOKENS}, v as (select value from tokens group by value order by count(*) desc, value limit 500)
select doc_id, round(avg((value in (select value from v))::int), 9) as ratio, count(*) as n from tokens group by doc_id""")
def vocabulary_ratio(spark, sf_dir):
    t = turn_tokens(spark, sf_dir).withColumnRenamed("value", "token")
    out = metrics.vocabulary_ratio(t, F.broadcast(metrics.vocabulary(t, 500)), ["doc_id"])
    return out.withColumn("ratio", F.round("ratio", 9))


@query("select l_orderkey as doc_id, string_agg(l_returnflag || l_linenumber, ' ' order by l_linenumber, l_returnflag) as value, min(l_linenumber) as first, max(l_linenumber) as last from lineitem group by l_orderkey")
def span_assembly(spark, sf_dir):
    """Parts of a value joined in order, with the span of the whole."""
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("v"))))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.array_join(F.transform(parts, lambda x: x["v"]), " ").alias("value"), F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last")
    )


@query("""select doc_id, start, len, label from (select l_orderkey as doc_id, (l_linenumber // 2)::int as start, (1 + l_partkey % 4)::int as len, label, row_number() over (partition by l_orderkey, l_linenumber // 2 order by 1 + l_partkey % 4 desc, l_linenumber, label) as r
from (select l_orderkey, l_linenumber, l_partkey, l_returnflag as label from lineitem)) where r = 1""")
def longest_per_start(spark, sf_dir):
    """Of the hits from one place the longest, then the first."""
    li = read(spark, sf_dir, "lineitem").withColumn("start", F.floor(F.col("l_linenumber") / 2).cast("int")).withColumn("len", (1 + F.col("l_partkey") % 4).cast("int"))
    best = F.row_number().over(W.partitionBy("l_orderkey", "start").orderBy(F.desc("len"), "l_linenumber", "l_returnflag"))
    return li.withColumn("r", best).where("r = 1").select(F.col("l_orderkey").alias("doc_id"), "start", "len", F.col("l_returnflag").alias("label"))


@query(f"""with {TOKENS}, n as (select doc_id, count(*) as n from tokens group by doc_id) select doc_id, n, case when n > 110 and n - 110 <= 11 then 1 else (n + 109) // 110 end as parts, case when n > 110 and n - 110 <= 11 then 110 else n end as kept from n""")
def predict_chunks(spark, sf_dir):
    """How long sentences are cut or parted for a model."""
    words = T.matches(F.col("text"), WORDS)
    rows = turns(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n"), neural.chunked(words).alias("c")).where("n > 0")
    kept = F.aggregate("c", F.lit(0).cast("long"), lambda a, b: a + F.size(b))
    return rows.select("doc_id", "n", F.size("c").cast("long").alias("parts"), kept.alias("kept"))


@query(f"""with {TOKENS}, w as (select doc_id, list(value order by tok_id) as words from tokens group by doc_id), z as (select doc_id, words, list_transform(words[1:len(words) - 1], lambda x: length(x) % 3) as labels from w)
select doc_id, unnest(range(0, least(len(words), len(labels))))::int as tok_id, unnest(words[1:least(len(words), len(labels))]) as token, unnest(labels) as label from z""")
def label_zip(spark, sf_dir):
    """Tokens with the labels a model gave them, one too few, as far as both go."""
    words = T.matches(F.col("text"), WORDS)
    rows = turns(spark, sf_dir).select("doc_id", words.alias("words")).withColumn("labels", F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), lambda w: F.pmod(F.length(w), F.lit(3)).cast("long")))
    pairs = F.arrays_zip(F.slice("words", F.lit(1), F.least(F.size("words"), F.size("labels"))).alias("token"), F.col("labels").alias("label"))
    return rows.where("size(words) > 0").select("doc_id", F.posexplode(pairs).alias("tok_id", "p")).select("doc_id", "tok_id", "p.token", "p.label")


MULTI = ["OF THE", "THE AND", "DE LA", "FOR THE"]


@query(f"""with {TOKENS}, f as (select *, trim(regexp_replace(regexp_replace(regexp_replace({FOLD_SQL}, '[.&"''!]', '', 'g'), '[-–—/]', ' ', 'g'), ' +', ' ', 'g')) as u from tokens), g as (select *, lead(u) over (partition by doc_id order by tok_id) as u2 from f)
select doc_id, tok_id, u || ' ' || u2 as key from g where u || ' ' || u2 in ({', '.join(repr(m) for m in MULTI)})""")
def multiword_match(spark, sf_dir):
    """Phrases of two words whatever dashes, dots and quotes stand in them."""
    phrases = F.broadcast(spark.createDataFrame([(m,) for m in MULTI], "key string"))
    grams = matching.k_grams(turn_tokens(spark, sf_dir), 2, T.phrase_key(F.col("value")))
    return grams.where("n_tok = 2").join(phrases, "key", "left_semi").select("doc_id", "tok_id", "key")


@query(f"""with {TOKENS}, n as (select doc_id, count(*) as n from tokens group by doc_id), b as (select doc_id, n, n // 100 as bucket from n), r as (select *, row_number() over (partition by bucket order by md5(doc_id::varchar), doc_id) - 1 as place from b)
select doc_id, bucket, place // 32 as batch from r where n <= 500""")
def length_batches(spark, sf_dir):
    """Batches of 32 sentences of like length in a seeded order; longer ones are dropped."""
    rows = turns(spark, sf_dir).select("doc_id", F.size(T.matches(F.col("text"), WORDS)).cast("long").alias("n")).where("n > 0")
    rows = rows.withColumn("bucket", F.floor(F.col("n") / 100))
    # A bucket's order is cut into cells by the hash's first digits: cells are counted and summed, rows are numbered within theirs.
    rows = rows.withColumn("order", F.md5(F.col("doc_id").cast("string"))).withColumn("cell", F.substring("order", 1, 4))
    before = W.partitionBy("bucket").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = rows.groupBy("bucket", "cell").agg(F.count("*").alias("cell_rows")).withColumn("before", F.coalesce(F.sum("cell_rows").over(before), F.lit(0)))
    place = F.col("before") + F.row_number().over(W.partitionBy("bucket", "cell").orderBy("order", "doc_id")) - 1
    return rows.join(cells.drop("cell_rows"), ["bucket", "cell"]).withColumn("batch", F.floor(place / 32)).where("n <= 500").select("doc_id", "bucket", "batch")


@query("select event_type, user_id, value from (select *, row_number() over (partition by event_type order by value desc, event_id) as r from events) where r <= 5")
def top_values(spark, sf_dir):
    """The five largest values of each kind."""
    best = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return read(spark, sf_dir, "events").withColumn("r", best).where("r <= 5").select("event_type", "user_id", "value")


@query("""select phrase, count(*) as n_lists from (select distinct upper(trim(n_name)) as phrase, 1 as l from nation union select distinct upper(trim(r_name)), 2 from region union select distinct upper(trim(c_mktsegment)), 3 from customer) group by phrase""")
def dictionary_union(spark, sf_dir):
    """Word lists without repeats, as one."""
    lists = [read(spark, sf_dir, t).select(F.upper(F.trim(c)).alias("phrase"), F.lit(k).alias("l")).distinct() for k, (t, c) in enumerate((("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment")))]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).groupBy("phrase").agg(F.count("*").alias("n_lists"))


@query(f"""with {TOKENS}, t as (select doc_id, tok_id, value, length(value) as value_len from tokens), g as (select *, {TAG_SQL} as tag from t),
l as (select *, lower(value) in ('von', 'van', 'de', 'zu', 'vom') as part, lower(value) in ('der', 'den', 'dem', 'la', 'zu') as art from g),
w as (select *, lead(tag) over o as t1, lead(tag, 2) over o as t2, lead(art) over o as a1, lag(tag) over o as b1, lag(part) over o as p1, lag(part, 2) over o as p2, lag(art) over o as q1 from l window o as (partition by doc_id order by tok_id))
select doc_id, tok_id, case when tag = 'O' and part and (coalesce(t1 in ('B-PER', 'I-PER'), false) or coalesce(a1 and t1 = 'O' and t2 in ('B-PER', 'I-PER'), false)) then 'B-PER'
  when tag = 'O' and art and coalesce(p1, false) and coalesce(t1 in ('B-PER', 'I-PER'), false) then 'I-PER'
  when tag = 'B-PER' and coalesce(b1 = 'O', false) and (coalesce(p1, false) or (coalesce(q1, false) and coalesce(p2, false))) then 'I-PER' else tag end as tag from w""")
def bio_repair(spark, sf_dir):
    """Name particles before a person take the person's tags."""
    return grouping.bio_repair(_tagged(spark, sf_dir), ["doc_id"]).select("doc_id", "tok_id", "tag")


# -- model arithmetic --------------------------------------------------------


@query("""select o_orderkey, o_orderkey % 20000 + 1 as step, round(0.0006 * least(pow(step, -0.5), step * pow(8000.0, -1.5)) / pow(8000.0, -0.5), 12) as rate from orders""")
def lr_schedule(spark, sf_dir):
    """The rate at the step that each order's key names."""
    steps = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 20000 + 1).alias("step"))
    return steps.select("o_orderkey", "step", F.round(neural.learning_rate(F.col("step").cast("double"), 0.0006, 8000), 12).alias("rate"))


@query("""select vec_id, c::int as col, round(embedding[c + 1]::double + case when c < 32 then sin(r * exp((c % 32) * (-ln(10000.0) / 31))) else cos(r * exp((c % 32) * (-ln(10000.0) / 31))) end, 6) as value from (select vec_id, embedding, vec_id % 128 as r, unnest(range(64)) as c from embeddings)""")
def position_table(spark, sf_dir):
    """Every embedding plus the encoding of its place, its id modulo the length of a sentence."""
    x = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(neural.with_positions(F.col("embedding"), F.col("vec_id") % 128, 64)).alias("col", "value"))
    return x.withColumn("value", F.round("value", 6))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings)
select vec_id, round(list_sum(x), 5) as sum, round(list_avg(x), 6) as mean, round(list_min(x), 6) as min, round(list_max(x), 6) as max, (list_position(x, list_max(x)) - 1)::int as argmax, (list_position(x, list_min(x)) - 1)::int as argmin,
round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 5) as norm, round(list_var_samp(x), 6) as var, round(list_stddev_samp(x), 6) as std from e""")
def embedding_reduce(spark, sf_dir):
    r = neural.reductions(F.col("embedding"))
    digits = {"sum": 5, "norm": 5}
    return read(spark, sf_dir, "embeddings").select("vec_id", *[(c if k.startswith("arg") else F.round(c, digits.get(k, 6))).alias(k) for k, c in r.items()])


@query("""with e as (select vec_id, label, list_transform(embedding, lambda x: exp(x::double)) as x from embeddings), p as (select *, list_transform(x, lambda v: v / list_sum(x)) as p from e)
select vec_id, list_transform(p, lambda v: round(v, 6)) as p, (list_position(x, list_max(x)) - 1)::int as best, round(-ln(p[label % 10 + 1]), 5) as cost from p""")
def softmax_argmax(spark, sf_dir):
    x = F.col("embedding")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", neural.softmax(x).alias("p"), neural.argmax(x).alias("best"))
    cost = neural.cross_entropy(F.col("p"), F.pmod("label", F.lit(10)))
    return rows.select("vec_id", F.transform("p", lambda v: F.round(v, 6)).alias("p"), "best", F.round(cost, 5).alias("cost"))


@query(f"""with {TOKENS}, v as (select value, (row_number() over (order by n desc, value) + 2)::int as id from (select value, count(*) as n from tokens group by value order by n desc, value limit 500)),
i as (select doc_id, tok_id, coalesce(id, 2) as id from tokens left join v using (value)), l as (select doc_id, list(id order by tok_id) as ids from i group by doc_id)
select doc_id, list_concat(ids, list_transform(range(0, m - len(ids)), lambda x: 1)) as ids from l, (select max(len(ids)) as m from l)""")
def padded_ids(spark, sf_dir):
    """Vocabulary ids of each turn, filled up to the longest."""
    t = turn_tokens(spark, sf_dir).withColumnRenamed("value", "token")
    ids = neural.token_ids(t, F.broadcast(metrics.vocabulary(t, 500)))
    rows = ids.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", "id"))), lambda x: x["id"].cast("int")).alias("ids"))
    return rows.select("doc_id", neural.padded(F.col("ids"), rows.agg(F.max(F.size("ids"))).first()[0] or 0).alias("ids"))


# -- letters: every recogniser on texts made from keys ------------------------

#: Parts of a letter: what stands before a value, the value as SQL that both engines read, and its label.
LETTER = [
    ("Gez. ", "concat('Frau ', element_at(array('Anna', 'Lena', 'Petra'), cast(k % 3 + 1 as int)), ' ', element_at(array('Schmidt', 'Meyer', 'Koch', 'Braun'), cast(k % 4 + 1 as int)))", "Name"),
    ("wohnhaft ", "concat('Lange Straße ', cast(k % 90 + 1 as string), ', ', cast(10000 + k % 80000 as string), ' Berlin')", "Address"),
    ("Tel ", "concat('030/', lpad(cast(k * 7 as string), 7, '1'))", "PhoneNumber"),
    ("IBAN ", "concat('DE', lpad(cast(k * 31 as string), 20, '4'))", "AccountNumber"),
    ("Kundennummer ", "concat('K-', cast(100000 + k as string))", "CustomerNumber"),
    ("", "concat('Geburtsdatum ', lpad(cast(k % 28 + 1 as string), 2, '0'), '.0', cast(k % 9 + 1 as string), '.19', cast(60 + k % 40 as string))", "Birthday"),
    ("Geburtsort ", "element_at(array('Hamburg', 'Wien', 'Frankfurt am Main'), cast(k % 3 + 1 as int))", "Birthplace"),
    ("Familienstand ", "element_at(array('ledig', 'verheiratet', 'getrennt lebend'), cast(k % 3 + 1 as int))", "MaritalStatus"),
    ("Staatsangehörigkeit ", "element_at(array('deutsch', 'polnisch'), cast(k % 2 + 1 as int))", "Nationality"),
    ("Karte ", "element_at(array('4111 1111 1111 1111', '5432110051294969'), cast(k % 2 + 1 as int))", "CreditCard"),
    ("Kennzeichen ", "concat('HH-', element_at(array('A', 'BC'), cast(k % 2 + 1 as int)), ' ', cast(k % 9000 + 1 as string))", "CarNumber"),
    ("Kasse ", "element_at(array('I526064554', 'A123456780', 'K734027627'), cast(k % 3 + 1 as int))", "HealthInsurance"),
    ("Schein ", "element_at(array('J010000SD51', 'F0100LQUA01'), cast(k % 2 + 1 as int))", "DriverLicense"),
    ("Rente ", "element_at(array('15070649C103', '13 020281 W 025', '12/190367/K/001'), cast(k % 3 + 1 as int))", "SocialSecurity"),
    ("Pass ", "element_at(array('C73Z12345', 'L6Z3PGVYC3'), cast(k % 2 + 1 as int))", "PassportIdCardNumber"),
    ("Steuer-ID ", "element_at(array('81872495633', '86 095 742 719'), cast(k % 2 + 1 as int))", "TaxIdentification"),
    ("bei ", "concat(element_at(array('Nordwind', 'Stadtwerke', 'NWH'), cast(k % 3 + 1 as int)), ' ', element_at(array('Holding', 'Media'), cast(k % 2 + 1 as int)), ' GmbH')", "Company"),
    ("Mail ", "concat('kunde', cast(k as string), '@example.com')", "Email"),
    ("Seite ", "concat('www.firma', cast(k as string), '.de')", "Url"),
]
BREAK = "; "
LETTERS_SQL = (
    "with c as (select c_custkey as k from customer), p as (select k as doc_id, unnest(["
    + ", ".join(f"{{'n': {i}, 'before': '{b}', 'value': {v.replace('element_at(array(', 'list_extract(list_value(').replace('as string', 'as varchar')}, 'label': '{label}'}}" for i, (b, v, label) in enumerate(LETTER))
    + f"]) as x from c), s as (select doc_id, x.label as label, x.value as value, length(x.value)::int as len, (sum(length(x.before) + length(x.value) + {len(BREAK)}) over (partition by doc_id order by x.n) - length(x.value) - {len(BREAK)})::int as start from p)"
)


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter for each customer; the keys are dealt before the letters are written."""
    parts = [F.concat(F.lit(before), F.expr(value)) for before, value, _ in LETTER]
    return spread(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), 1000).select(F.col("k").alias("doc_id"), F.concat_ws(BREAK, *parts).alias("text"))


@query(LETTERS_SQL + " select doc_id, label, value, start, len from s")
def letter_entities(spark, sf_dir):
    """All recognisers on a letter for each customer."""
    return plans.extract(letters(spark, sf_dir)).select("doc_id", "label", "value", "start", "len")


@query(LETTERS_SQL + " select doc_id, count(*)::int as n_entities, count(distinct label)::int as n_categories, (10 * 19 + 2 * 19 + 6 * 1 + 3 * 30 + 5 * 20 + 8 * 1)::bigint as score from s group by doc_id")
def letter_scores(spark, sf_dir):
    return plans.scored(letters(spark, sf_dir))


@query(LETTERS_SQL + ", a as (select doc_id, min(start) as start, max(start + len) as fin, count(*) as n_members from s group by doc_id) select doc_id, 0 as ue_id, start, (fin - start)::int as len, n_members from a")
def letter_united(spark, sf_dir):
    """The name and all that follows it within the distance."""
    return plans.united_entities(letters(spark, sf_dir)).select("doc_id", "ue_id", "start", "len", "n_members")


@query(LETTERS_SQL + """, m as (select doc_id, start - 1 as start, len + 2 as len, 'PERSON' as label from s where label = 'Name')
select doc_id, start, len, label, 'rules' as origin from s where label <> 'Name' union all select doc_id, start, len, label, 'model' from m""")
def letter_combined(spark, sf_dir):
    """Rule entities with a model's, which is one character wider at each end of the name."""
    docs = letters(spark, sf_dir)
    rules = plans.extract(docs).select("doc_id", "start", "len", "label").persist(StorageLevel.DISK_ONLY)
    names = rules.where("label = 'Name'")
    model = names.select("doc_id", (F.col("start") - 1).alias("start"), (F.col("len") + 2).alias("len"), F.lit("PERSON").alias("label"))
    return plans.combined(docs, model, rules=rules).select("doc_id", "start", "len", "label", "origin")


def built_in_dictionaries(spark: SparkSession) -> dict[str, DataFrame]:
    """The built-in lists as tables."""
    g = plans.Gazetteers()
    lists = {"company": g.companies, "firstname": g.firstnames, "surname": g.surnames, "birthplace": g.birthplaces, "nationality": g.nationalities, "marital": g.marital}
    return {k: spark.createDataFrame([(x,) for x in v], "phrase string") for k, v in lists.items()}


@query(LETTERS_SQL + " select doc_id, label, value, start, len from s")
def letter_dictionaries(spark, sf_dir):
    """The letters again, with all word lists as tables that the words meet by joins."""
    return plans.extract(letters(spark, sf_dir), dictionaries=built_in_dictionaries(spark)).select("doc_id", "label", "value", "start", "len")


NORM = "upper(" + "replace(" * 7 + "{}" + "".join(f", '{a}', '{b}')" for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE"))) + ")"


@query(rf"""with b as (select regexp_extract_all(text, '[\p{{L}}\p{{Nd}}]+') as w from benchmark),
phrases as (select list_transform(list_slice(w, 1, n), lambda x: {NORM.format("x")}) as w, n from b, (select unnest([2, 3, 5]) as n) where len(w) >= n),
keys as (select distinct array_to_string(w, '') as key from phrases), openers as (select w[1] as opener, max(n) as most from phrases group by 1),
texts as (select doc_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{Nd}}]+'), lambda x: {NORM.format("x")}) as w, list_transform(string_split_regex(text, '[\p{{L}}\p{{Nd}}]+'), lambda x: length(x)) as g from documents where text is not null),
words as (select doc_id, w, g, unnest(range(1, len(w) + 1)) as i from texts),
opened as (select doc_id, w, g, i, unnest(range(1, least(most + 2, len(w) - i + 1) + 1)) as n from words join openers on w[i] = opener)
select doc_id, (i - 1)::int as first_tok, n::int as n_tok from opened join keys on array_to_string(list_slice(w, i, i + n - 1), '') = key where n = 1 or list_max(list_slice(g, i + 1, i + n - 1)) <= 4""")
def dictionary_hits(spark, sf_dir):
    """The openings of all benchmark passages (2, 3 and 5 words) as a dictionary, met by the words of all documents."""
    w = T.matches(F.col("text"), D.WORD)
    openings = read(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.array(*map(F.lit, (2, 3, 5))), lambda n: F.when(F.size(w) >= n, F.array_join(F.slice(w, F.lit(1), n), " ")))).alias("phrase"))
    return D.hits(texts(spark, sf_dir), D.entries({"opening": openings.where("phrase is not null")})).select("doc_id", F.col("at").alias("first_tok"), "n_tok")


ORDERED_SQL = "c as (select c_custkey as k, c_mktsegment as street, c_custkey % 90 + 1 as house, 10000 + c_custkey % 80000 as zip, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') as city, p_type from customer join part on p_partkey = c_custkey)"


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, street, house, zip, city and p_type for each customer with the part of its number: names in upper and lower case, of one and of more words."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("c_custkey"), F.initcap("p_name").alias("city"), "p_type")
    k = F.col("c_custkey")
    customers = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 2000)
    return customers.join(part, "c_custkey").select(k.alias("k"), F.col("c_mktsegment").alias("street"), (k % 90 + 1).alias("house"), (10000 + k % 80000).alias("zip"), "city", "p_type")


@query("with " + ORDERED_SQL + """, w as (select *, replace(city, ' ', ['-', ' ', ' - '][k % 3 + 1]) as written from c)
select k as doc_id, 8 as start, case k % 4 when 0 then street || ' ' || house || ', ' || zip || ' ' || written when 1 then zip || ' ' || written || ', ' || street || ' ' || house when 2 then street || ' ' || house || ' - ' || written else zip || ' ' || written end as value,
  case when k % 4 < 3 then street end as street, case when k % 4 < 3 then house::varchar end as house, case when k % 4 <> 2 then zip::varchar end as zip, city from w""")
def dictionary_addresses(spark, sf_dir):
    """Addresses in four layouts, with cities and streets as tables; cities are written with dashes and spaces and come back as listed."""
    rows = _ordered(spark, sf_dir)
    written = F.replace("city", F.lit(" "), F.get(F.array(*map(F.lit, ("-", " ", " - "))), F.col("k") % 3))
    street, code = F.concat_ws(" ", "street", "house"), F.concat_ws(" ", "zip", written)
    layouts = F.array(F.concat_ws(", ", street, code), F.concat_ws(", ", code, street), F.concat_ws(" - ", street, written), code)
    docs = rows.select(F.col("k").alias("doc_id"), F.concat(F.lit("Ware an "), F.get(layouts, F.col("k") % 4), F.lit("; eilt")).alias("text"))
    lists = {"city": read(spark, sf_dir, "part").select(F.initcap("p_name")).distinct(), "street": read(spark, sf_dir, "customer").select("c_mktsegment").distinct()}
    found = plans.extract(docs, enabled={"address"}, dictionaries=lists)
    return found.select("doc_id", "start", "value", *[F.col("attrs")[a].alias(a) for a in ("street", "house", "zip", "city")])


@query("""with recursive phrases as (select distinct p_type || ' & ' || p_name || '.' as phrase from part),
letters as (select phrase, phrase as rest, '' as done from phrases
  union all select phrase, rest[2:], unnest(case when rest[1] in ('.', '&') then [done || rest[1], done] else [done || rest[1]] end) from letters where rest <> ''),
kept as (select distinct phrase, trim(regexp_replace(done, ' +', ' ', 'g')) as text from letters where rest = ''),
gaps as (select phrase, text as rest, '' as done from kept
  union all select phrase, rest[2:], unnest(case when rest[1] = ' ' then [done || ' ', done || '-'] else [done || rest[1]] end) from gaps where rest <> '')
select distinct phrase, done as version from gaps where rest = ''""")
def phrase_versions(spark, sf_dir):
    """Every way to write the names made of parts, with dots and ampersands left out and dashes for spaces."""
    part = read(spark, sf_dir, "part").select(F.concat("p_type", F.lit(" & "), "p_name", F.lit(".")).alias("phrase")).distinct()
    return gazetteers.versions(part)


@query("with " + ORDERED_SQL + """, w as (select *, replace(replace(p_type || ' & ' || city || '.', case when k % 2 = 0 then ' &' else '' end, ''), ' ', [' ', '-', ' - '][k % 3 + 1]) as written from c)
select k as doc_id, 8 as start, p_type || ' & ' || city || '.' as entry, rtrim(written, '.') as value from w where k % 3 < 2""")
def version_hits(spark, sf_dir):
    """Names in texts, kept where they are written as their entry allows: spaced dashes are not."""
    rows = _ordered(spark, sf_dir).withColumn("phrase", F.concat("p_type", F.lit(" & "), "city", F.lit(".")))
    bare = F.when(F.col("k") % 2 == 0, F.replace("phrase", F.lit(" &"), F.lit(""))).otherwise(F.col("phrase"))
    written = F.replace(bare, F.lit(" "), F.get(F.array(*map(F.lit, (" ", "-", " - "))), F.col("k") % 3))
    docs = rows.select(F.col("k").alias("doc_id"), F.concat(F.lit("Ware an "), written, F.lit(" heute")).alias("text"))
    entries = rows.select("phrase").distinct()
    found = D.hits(docs, D.entries({"company": entries}))
    return D.as_written(found, gazetteers.versions(entries)).select("doc_id", "start", "entry", "value")


# -- whole plans (no SQL) ----------------------------------------------------


@query()
def extract_all(spark, sf_dir):
    """Every recogniser over all documents, resolved."""
    return plans.extract(texts(spark, sf_dir)).drop("attrs")


@query()
def extract_scores(spark, sf_dir):
    return plans.scored(texts(spark, sf_dir))


@query()
def sentences_simple(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_id", "sentence"))


@query()
def sentences_full(spark, sf_dir):
    docs = texts(spark, sf_dir)
    rows = docs.select("doc_id", F.posexplode(S.split_full(F.col("text"))).alias("sent_id", "s"))
    return rows.select("doc_id", "sent_id", "s.start", F.col("s.value").alias("sentence"))


@query()
def tokens_full(spark, sf_dir):
    """Tokens of every sentence with their places."""
    return matching.token_table(turns(spark, sf_dir))


@query()
def model_input(spark, sf_dir):
    """Words of all documents as a model reads them, with their places in the text."""
    g = gazetteers.Gazetteers()
    return places.model_words(texts(spark, sf_dir), g.tlds, g.schemes)


@query()
def rouge_pairs(spark, sf_dir):
    """Each turn against the next: words of the longest common subsequence of both whole, over their distinct words."""
    words = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.matches(F.coalesce("text", F.lit("")), WORDS).alias("ref"))
    rows = words.withColumn("hyp", F.lead("ref").over(W.partitionBy("conv_id").orderBy("turn"))).where("hyp is not null and size(ref) > 0 and size(hyp) > 0")
    return metrics.rouge(rows, ["conv_id", "turn"])


@query()
def crf_entities(spark, sf_dir):
    """Capitalised runs of every turn by a sequence model: its weights are learned from the shapes in four of five conversations, its tags see the neighbours' words and shapes only through them."""
    by = ["block", "doc_id"]
    tokens = crf.blocked(turn_tokens(spark, sf_dir).select("doc_id", "tok_id", F.col("value").alias("token"), T.shape(F.col("value")).alias("c")), ["doc_id"])
    tokens = tokens.persist(StorageLevel.DISK_ONLY).withColumn("w", F.lower("token"))
    named = F.col("c").isin("LatinFirstCapital", "MixCapital") & (F.col("tok_id") > 0)
    before = F.lag(named).over(W.partitionBy(*by).orderBy("tok_id"))
    tag = F.when(~named, "O").when(F.coalesce(before, F.lit(False)), "I-CAP").otherwise("B-CAP")
    gold = F.when(F.pmod(F.floor(F.col("doc_id") / 1000), F.lit(5)) != 0, tag)
    features = grouping.context_features(tokens.withColumn("tag", gold), by, ["w", "c"], keep=("tag",))
    weights, transitions = crf.learn(features, by)
    decoded = crf.decode(features, by, weights, transitions)
    return crf.label_chains(crf.tagged_tokens(tokens, decoded, by), by).drop("block")


@query()
def neural_tags(spark, sf_dir):
    """Capitalised runs of every turn by a small encoder: vocabulary, embeddings and head are learned from four of five conversations."""
    tokens = turn_tokens(spark, sf_dir).select("doc_id", "tok_id", F.col("value").alias("token"), T.shape(F.col("value")).alias("c"))
    named = F.col("c").isin("LatinFirstCapital", "MixCapital") & (F.col("tok_id") > 0)
    gold = tokens.withColumn("tag", F.when(named, "CAP").otherwise("O")).where(F.pmod(F.floor(F.col("doc_id") / 1000), F.lit(5)) != 0)
    vocab = weights.vocabulary(gold)
    labels = ["O", "CAP"]
    learned = weights.sentence_ids(gold, vocab, ["doc_id"], tag="tag")
    model = weights.fit_head(learned, weights.start_weights(learned, labels), labels)
    every = weights.sentence_ids(tokens, vocab, ["doc_id"]).withColumnRenamed("doc_id", "sent_id")
    return neural.predict_tags(every, model, labels)
