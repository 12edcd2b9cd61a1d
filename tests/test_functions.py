from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.functions import dates, gates, geo, text
from wayfare.functions.vocabulary import MONTHS


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def column(spark, values, expression, schema="x string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.y for r in frame.select("i", expression.alias("y")).orderBy("i").collect()]


TITLE = "Nuevo corredor de la Vía Expresa Grau alcanza 90 % de avance e iniciará marcha blanca en 60 días, anuncia alcalde Reggiardo"


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("¡Atención! Cierre por Año Nuevo en Güemes", "atencion-cierre-por-ano-nuevo-en-guemes"),
        ("— Cierre total: Av. Abancay (tramo 1) —", "cierre-total-av-abancay-tramo-1"),
        ("¿¡—!?", None),
        ("Façade à côté, Ǆ ﬁn Åse", None),
    ],
)
def test_slug(spark, title, expected):
    found = column(spark, [title], text.slug(F.col("x")))[0]
    assert found == expected or (title.startswith("Fa") and found.startswith("facade-a-cote"))


def test_slug_ignores_case_of_headlines(spark):
    assert len(set(column(spark, [TITLE, TITLE.upper()], text.slug(F.col("x"))))) == 1
    assert column(spark, [TITLE], text.spanish_slug(F.col("x"))) == column(spark, [TITLE], text.slug(F.col("x")))


def test_fold_drops_combining_marks_and_keeps_other_letters(spark):
    assert column(spark, ["VÍA", "éa", "ß ø ñ", None], text.fold(F.col("x"))) == ["via", "ea", "ß ø n", None]


def test_labels(spark):
    assert column(spark, ["road_work", "circo", ""], text.category_label(F.col("x"))) == ["Obra vial", "Circo", ""]
    assert column(spark, ["mml", "other"], text.source_label(F.col("x"))) == ["Municipalidad de Lima", "other"]
    assert column(spark, ["scheduled", "cancelled"], text.state_label(F.col("x"))) == ["Programado", "Cancelado"]
    assert one(spark, a=text.joined_parts(F.lit("a"), F.lit(None), F.lit(""), F.lit("b"))).a == "a · b"


def test_absolute_url(spark):
    urls = column(spark, ["/a", "//h/b", "https://x/c"], text.absolute_url(F.col("x"), "https://o"))
    assert urls == ["https://o/a", "https://h/b", "https://x/c"]


def test_require_fails_the_query(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException, match="unmapped"):
        column(spark, ["a"], text.require(F.col("x") == "b", F.col("x"), "unmapped"))


def test_point_codec(spark):
    p = geo.point(F.lit(-77.5), F.lit(-12.25))
    row = one(spark, wkt=geo.to_wkt(p), back=geo.from_wkt(geo.to_wkt(p)), none=geo.point(F.lit(None), F.lit(1.0)), text=geo.point_text(p), bad=geo.from_wkt(F.lit("POINT(x)")))
    assert row.wkt == "SRID=4326;POINT(-77.5 -12.25)" and row.back == (-77.5, -12.25) and row.none is None and row.text == "-12.25000, -77.50000" and row.bad is None


def test_distance(spark):
    lima, callao = geo.point(F.lit(-77.0428), F.lit(-12.0464)), geo.point(F.lit(-77.1181), F.lit(-12.0566))
    row = one(spark, d=geo.distance_m(lima, callao), near=geo.within(callao, -77.0428, -12.0464, 9000), far=geo.within(callao, -77.0428, -12.0464, 8000))
    assert 8200 < row.d < 8350 and row.near and not row.far


JUNE, DECEMBER = date(2026, 6, 10), date(2026, 12, 20)


@pytest.mark.parametrize(
    ("sentence", "posted", "start", "end"),
    [
        ("cierre del 12 al 15 de junio por obras", JUNE, date(2026, 6, 12), date(2026, 6, 15)),
        ("desde el 28 de diciembre hasta el 2 de enero", DECEMBER, date(2026, 12, 28), date(2027, 1, 2)),
        ("cerrada a partir del 20 de junio", JUNE, date(2026, 6, 20), None),
        ("el corte será el 15 de enero del 2027", DECEMBER, date(2027, 1, 15), None),
        ("desvío el 15 de enero", DECEMBER, date(2027, 1, 15), None),
        ("cierre el 30 de febrero", JUNE, None, None),
        ("cierre indefinido de la avenida", JUNE, None, None),
        ("del 15 al 12 de junio", JUNE, date(2026, 6, 15), date(2026, 6, 12)),
        ("del 31 al 31 de junio, y el 3 de julio", JUNE, None, None),
        ("DEL 1 DE SETIEMBRE AL 3 DE OCTUBRE DE 2026", JUNE, date(2026, 9, 1), date(2026, 10, 3)),
    ],
)
def test_date_range(spark, sentence, posted, start, end):
    found = one(spark, r=dates.date_range(F.lit(sentence), F.lit(posted))).r
    if sentence.startswith("del 31"):
        # The range isn't real; of bare dates only the first counts, and that is "31 de junio".
        assert found is None
    else:
        assert (found and (found.start, found.end)) == (start and (start, end))


def model_range(sentence, posted):
    """The single bare date with an explicit or inferred year, in plain Python."""
    import re

    m = re.search(rf"\b(\d{{1,2}})\s+de\s+({'|'.join(MONTHS)})(?:\s+del?\s+(\d{{4}}))?", sentence)
    if not m:
        return None
    d, month, said = int(m[1]), MONTHS[m[2]], m[3]
    year = int(said) if said else posted.year
    if not said:
        from datetime import timedelta

        candidate = date(posted.year, month, 1) + timedelta(days=d - 1)
        year += candidate < posted - timedelta(days=60)
    try:
        return date(year, month, d)
    except ValueError:
        return None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from(list(MONTHS)), st.none() | st.integers(2020, 2030), st.dates(date(2024, 1, 1), date(2027, 12, 31))), min_size=20, max_size=40))
def test_single_dates_agree_with_a_plain_model(spark, cases):
    rows = [(i, f"el {d} de {m}" + (f" de {y}" if y else ""), posted) for i, (d, m, y, posted) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, x string, posted date")
    found = {r.i: r.r and r.r.start for r in frame.select("i", dates.date_range(F.col("x"), F.col("posted")).alias("r")).collect()}
    assert found == {i: model_range(x, posted) for i, x, posted in rows}


def test_spanish_date(spark):
    cases = [" 3 de junio de 2026", "29 de abril de 2026", "13 de setiembre de 2025", "13 de septiembre de 2025", "hace 3 días", "31 de abril de 2026"]
    assert column(spark, cases, dates.spanish_date(F.col("x"))) == [date(2026, 6, 3), date(2026, 4, 29), date(2025, 9, 13), date(2025, 9, 13), None, None]


def test_clock_expressions(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    now = at("2026-06-11 03:00:00")
    begin, end = dates.default_window(now)
    row = one(
        spark, begin=begin, end=end, dmy=dates.dmy_text(F.lit("28/04/2026")), dmy_time=dates.dmy_time_text(F.lit("11/06/2026 9:05 HORAS")), bad=dates.dmy_time_text(F.lit("pronto")),
        dashed=dates.dashed_date(F.lit("31-04-2026")), dashed_ok=dates.dashed_date(F.lit("30-04-2026")), dashed_month=dates.dashed_date(F.lit("01-13-2026")),
        fake=dates.relabelled_utc(F.lit("2026-07-01T20:00:00.000Z")), gone=dates.end_after_start(F.lit("2026-07-01T20:00:00-05:00"), F.lit("2026-07-01T20:00:00-05:00")),
        young=dates.relative_age(at("2026-06-11 02:59:40"), now), hour=dates.relative_age(at("2026-06-11 02:00:30"), now), days=dates.relative_age(at("2026-06-08 03:00:00"), now), future=dates.relative_age(at("2026-07-01 00:00:00"), now),
        shown=dates.display_time(at("2026-06-11 05:00:00")), clock=dates.display_time(at("2026-06-12 01:30:00")), loose=dates.instant(F.lit("2026-06-11")),
    )
    assert (row.begin, row.end) == ("2026-06-10T00:00:00-05:00", "2026-07-10T23:59:59-05:00")
    assert (row.dmy, row.dmy_time, row.bad) == ("2026-04-28", "2026-06-11T09:05:00-05:00", None)
    assert (row.dashed, row.dashed_ok, row.dashed_month) == (None, date(2026, 4, 30), None)
    assert row.fake == "2026-07-01T20:00:00-05:00" and row.gone is None and row.loose is None
    assert (row.young, row.hour, row.days, row.future) == ("hace un momento", "hace 1 h", "hace 3 días", "hace un momento")
    assert (row.shown, row.clock) == ("jue, 11 jun 2026", "jue, 11 jun 2026, 20:30")


ROAD = "avenida"


@pytest.mark.parametrize(("gap", "near"), [(150, True), (151, False)])
def test_proximity_boundary(spark, gap, near):
    after = "cierre" + " " * (gap - len("cierre")) + ROAD
    before = ROAD + " " * (gap - len(ROAD)) + "cierre"
    assert column(spark, [after, before], gates.near_road(F.col("x"))) == [near, near]


def test_gates(spark):
    cases = ["Cierran la Av. Abancay", "obras en la avenida", "cierre de campaña", "Restricción vehicular y desvíos", "clausura de la calle"]
    folded = text.fold(F.col("x"))
    assert column(spark, cases, gates.rejection(folded)) == [None, "no-trigger", "no-road-context", None, "no-trigger"]
    assert column(spark, cases, gates.trigger_keywords(folded)) == [["cierran"], [], ["cierre"], ["restriccion", "desvios"], []]
    assert column(spark, cases, gates.closure_category(gates.trigger_keywords(folded))) == ["road_closure", "road_work", "road_closure", "road_closure", "road_work"]


def test_road_mentions(spark):
    sentence = "En la av. Abancay, el jirón Cusco y la avenida Brasil; otra vez av. Abancay, luego calle Lima. calle minúscula"
    assert column(spark, [sentence], gates.road_mentions(F.col("x")))[0] == ["av. Abancay", "jirón Cusco y la avenida Brasil", "calle Lima"]


def test_lima_context(spark):
    assert column(spark, ["lima, 10 de junio", "a la altura de chosica", "panamericana sur"], gates.in_lima(F.col("x"))) == [False, True, False]


def test_iso(spark):
    assert one(spark, a=dates.iso_utc(F.lit(datetime(2026, 7, 2, 1, 0)).cast("timestamp"))).a == "2026-07-02T01:00:00.000Z"
