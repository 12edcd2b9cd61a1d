"""Spanish dates, written from orders' dates and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import dates
from wayfare.functions.vocabulary import MONTHS
from wayfare.plans.queries import Group, table

group = Group()

NAMES = [next(name for name, n in MONTHS.items() if n == i) for i in range(1, 13)]
SQL_NAMES = "['" + "', '".join(NAMES) + "']"


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), F.month(day))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.date_add(day, (F.col("o_orderkey") % 20 + 1).cast("int")).alias("later"), F.date_sub(day, (F.col("o_orderkey") % 30).cast("int")).alias("posted"))


def written(day: str) -> Column:
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" de "), month_name(F.col(day)))


def text_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def read_back(rows: DataFrame, sentence: Column) -> DataFrame:
    rows = rows.withColumn("found", dates.date_range(sentence, F.col("posted")))
    return rows.select("o_orderkey", text_of(F.col("found.start")).alias("start_day"), text_of(F.col("found.end")).alias("end_day"))


SQL_DAYS = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 + 1 AS INTEGER) AS later FROM orders)"


@group(f"SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS start_day, strftime(later, '%Y-%m-%d') AS end_day FROM {SQL_DAYS} WHERE month(day) = month(later)")
def spanish_range_same_month(spark, sf_dir):
    rows = orders(spark, sf_dir).filter(F.month("day") == F.month("later"))
    return read_back(rows, F.concat(F.lit("Cierre DEL "), F.dayofmonth("day").cast("string"), F.lit(" al "), written("later"), F.lit(" de "), F.year("later").cast("string"), F.lit(", por obras")))


@group(f"SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS start_day, strftime(later, '%Y-%m-%d') AS end_day FROM {SQL_DAYS}")
def spanish_range_cross_month(spark, sf_dir):
    year = lambda c: F.concat(F.lit(" de "), F.year(c).cast("string"))
    return read_back(orders(spark, sf_dir), F.concat(F.lit("Desvío desde el "), written("day"), year("day"), F.lit(" hasta el "), written("later"), year("later")))


@group("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start_day, CAST(NULL AS VARCHAR) AS end_day FROM orders")
def spanish_range_open(spark, sf_dir):
    return read_back(orders(spark, sf_dir), F.concat(F.lit("Cerrada a partir del "), written("day"), F.lit(" de "), F.year("day").cast("string")))


@group("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start_day, CAST(NULL AS VARCHAR) AS end_day FROM orders")
def spanish_range_single(spark, sf_dir):
    return read_back(orders(spark, sf_dir), F.concat(F.lit("El corte será el "), written("day"), F.lit(" del "), F.year("day").cast("string"), F.lit(".")))


SQL_ROLLED = """(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + CAST((o_orderkey * 37) % 360 AS INTEGER) AS posted FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29))"""


@group(f"""SELECT o_orderkey, strftime(CASE WHEN same < posted - 60 THEN make_date(year(posted) + 1, month(day), day(day)) ELSE same END, '%Y-%m-%d') AS start_day
FROM (SELECT *, make_date(year(posted), month(day), day(day)) AS same FROM {SQL_ROLLED})""")
def year_inference(spark, sf_dir):
    rows = orders(spark, sf_dir).filter(~((F.month("day") == 2) & (F.dayofmonth("day") == 29)))
    rows = rows.withColumn("posted", F.date_add("day", ((F.col("o_orderkey") * 37) % 360).cast("int")))
    return read_back(rows, F.concat(F.lit("desvío el "), written("day"))).select("o_orderkey", "start_day")


@group(f"""SELECT o_orderkey, CASE WHEN d <= day(last_day(make_date(year(o_orderdate), m, 1))) THEN strftime(make_date(year(o_orderdate), m, least(d, day(last_day(make_date(year(o_orderdate), m, 1))))), '%Y-%m-%d') END AS found_day
FROM (SELECT *, CAST(28 + o_orderkey % 4 AS INTEGER) AS d, CAST(1 + o_orderkey % 12 AS INTEGER) AS m FROM orders)""")
def calendar_validity(spark, sf_dir):
    d, m = (28 + F.col("o_orderkey") % 4).cast("string"), (1 + F.col("o_orderkey") % 12).cast("int")
    sentence = F.concat(d, F.lit(" de "), F.element_at(F.array(*map(F.lit, NAMES)), m), F.lit(" de "), F.year("day").cast("string"))
    return orders(spark, sf_dir).select("o_orderkey", text_of(dates.spanish_date(sentence)).alias("found_day"))


@group("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 + 1 AS INTEGER) < DATE '1998-06-15' AS past FROM orders""")
def past_guard(spark, sf_dir):
    rows = orders(spark, sf_dir)
    year = lambda c: F.concat(F.lit(" de "), F.year(c).cast("string"))
    found = dates.date_range(F.concat(F.lit("del "), written("day"), year("day"), F.lit(" al "), written("later"), year("later")), F.col("posted"))
    return rows.withColumn("found", found).select("o_orderkey", dates.ends_before(F.col("found"), F.lit("1998-06-15").cast("date")).alias("past"))


@group("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30:00-05:00' AS at,
  CAST(NULL AS VARCHAR) AS broken FROM orders""")
def dmy_parse(spark, sf_dir):
    text = F.concat(F.date_format("day", "dd/MM/yyyy"), F.lit(" "), (F.col("o_orderkey") % 24).cast("string"), F.lit(":30 HORAS"))
    broken = F.date_format("day", "dd-MM-yyyy")
    return orders(spark, sf_dir).select("o_orderkey", dates.dmy_text(text).alias("day"), dates.dmy_time_text(text).alias("at"), dates.dmy_time_text(broken).alias("broken"))


@group("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-05:00' AS relabelled, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS instant FROM events""")
def fake_utc_relabel(spark, sf_dir):
    fake = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, F.lit(".000Z")).otherwise(F.lit("Z")))
    text = dates.relabelled_utc(fake)
    return table(spark, sf_dir, "events").select("event_id", text.alias("relabelled"), F.date_format(dates.instant(text), "yyyy-MM-dd HH:mm:ss").alias("instant"))


@group("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00-05:00' AS start_at, strftime(o_orderdate, '%Y-%m-%d') || 'T23:59:00-05:00' AS end_at,
  strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1739 MINUTE, '%Y-%m-%d %H:%M:%S') AS end_utc FROM orders""")
def lima_day_bounds(spark, sf_dir):
    end = dates.day_end(F.col("day"))
    return orders(spark, sf_dir).select("o_orderkey", dates.day_start(F.col("day")).alias("start_at"), end.alias("end_at"), F.date_format(dates.instant(end), "yyyy-MM-dd HH:mm:ss").alias("end_utc"))


@group("""SELECT event_id, strftime(CAST(ts - INTERVAL 5 HOUR AS DATE), '%Y-%m-%d') || 'T00:00:00-05:00' AS from_, strftime(CAST(ts - INTERVAL 5 HOUR AS DATE) + 30, '%Y-%m-%d') || 'T23:59:59-05:00' AS to_ FROM events""")
def default_window(spark, sf_dir):
    begin, end = dates.default_window(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", begin.alias("from_"), end.alias("to_"))
