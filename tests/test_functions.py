"""Truth tables of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from showgrid.functions import dates as D
from showgrid.functions import text as X


def values(spark, fn, inputs, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize("raw,want", [
    ("Los domingos (VOSE)", "Los domingos"), ("Verdi Club: Vértigo", "Vértigo"), ("SESIÓN TETA: Una vida (DOBLADA AL ESPAÑOL)", "Una vida"),
    ("Laca y Palomitas especial aniversario: Grease", "Grease"), ("Anime Day: Verdi Club: X", "Verdi Club: X"), ("Sin prefijo: sí", "Sin prefijo: sí"),
    ("Muestra Aeterna: Solaris (V.O.S.E.)", "Solaris"), ("Hamnet - VOSE", "Hamnet"),
])
def test_clean_title(spark, raw, want):
    assert values(spark, X.clean_title, [raw]) == [want]


def test_titles(spark):
    got = values(spark, X.split_title_year, ["Un asunto (Otro, 1966)", "Sin año (Original)", "1984 (x) y más", None])
    assert [tuple(g) for g in got] == [("Un asunto", "1966"), ("Sin año", None), ("1984 (x) y más", None), (None, None)]
    assert values(spark, X.strip_program_label, ["Sabrina [Ciclo Wilder]", "A [b] [c]", "Sin"]) == ["Sabrina", "A", "Sin"]
    assert values(spark, X.titlecase_if_upper, ["SPIDER-MAN Y O'HARA", "Ya está", "123", "EL NIÑO"]) == ["Spider-Man Y O'Hara", "Ya está", "123", "El Niño"]
    assert values(spark, X.strip_director_prefix, ["de Ana Ruiz", "De  Luis", "Demme", " ", None]) == ["Ana Ruiz", "Luis", "Demme", None, None]
    assert values(spark, X.fallback_title_from_slug, ["https://x/film/the-long-day/"]) == ["The Long Day"]


def test_credits(spark):
    df = spark.createDataFrame([(["Título", "Ana Ruiz / España / 2025", "B / C / 1999"],), (["nada"],)], "x array<string>")
    got = [tuple(r.c) for r in df.select(X.parse_credit_lines(F.col("x")).alias("c")).collect()]
    assert got[0] == ("Ana Ruiz", "2025") and got[1] == (None, None)
    got = values(spark, X.parse_pipe_credit, ["Ana | 1999 | 90'", "Luis | s/f", "Solo"])
    assert [tuple(g) for g in got] == [("Ana", "1999"), ("Luis", None), ("Solo", None)]


def test_folding(spark):
    assert values(spark, X.normalize_text, ["Ñandú ÀÉÎ", "ß"]) == ["nandu aei", "ß"]
    assert values(spark, X.slugify, ["¡Hola, Señor!  2", "--a--"]) == ["hola-senor-2", "a"]
    assert values(spark, lambda c: X.slugify(c, "spaces"), ["Pedro Almodóvar"]) == ["pedro-almodovar"]
    assert values(spark, lambda c: X.fold_contains(c, "ANDÚ"), ["nandu", "otro"]) == [True, False]


def test_urls(spark):
    assert values(spark, lambda c: X.strip_tracking_query(c, "https://b"), ["/e/1?x=1#y", "https://c/d?_gl=2"]) == ["https://b/e/1", "https://c/d"]
    assert values(spark, X.canonical_slug, ["https://e/pelicula/el-agente-vose/?c=m", "/p/x-doblada-al-espanol/"]) == ["el-agente", "x"]
    got = values(spark, X.external_id, ["https://db/movie/429/", "https://db/tv/12", "https://db/person/3", ""])
    assert [tuple(g) for g in got] == [("movie", 429), ("tv", 12), (None, None), (None, None)]
    import base64
    token = base64.b64encode(b"https://t/?id=01-2").decode().rstrip("=")
    assert values(spark, X.decode_ticket_token, [f"/v/1/2/{token}/", "/v/1", "/v/1/2/%%%", f"/v/1/2/{base64.b64encode(bytes([255, 254])).decode()}"]) == ["https://t/?id=01-2", "", "", ""]


def test_counts(spark):
    assert values(spark, X.compact_count_label, [5, 999, 1500, 34499, 1200000, 2000000, None], "x long") == ["5", "999", "2k", "34k", "1.2M", "2M", None]
    assert values(spark, X.short_count, ["1.5K", "2M", "77", ""]) == [1500, 2000000, 77, None]
    assert values(spark, X.watched_by, ["Watched by 1,234 members", "no"]) == [1234, None]
    assert values(spark, X.rating_out_of, ["3.91 out of 5", "none"]) == [3.91, None]


def test_dates(spark):
    year = lambda c: D.parse_localized_date(c, F.lit(2026))
    got = values(spark, year, ["3 de Febrero - 17:00h", "31 de Febrero - 17:00h", "Mié, 11 Feb", "Dom, 1 Sep.", "3 of May - 10:00", "5 de foo - 10:00"])
    assert got == [dt.datetime(2026, 2, 3, 17), None, dt.datetime(2026, 2, 11), dt.datetime(2026, 9, 1), None, None]
    ref = F.lit("2025-12-30").cast("date")
    got = values(spark, lambda c: D.resolve_relative_day(c, ref), ["Hoy", " mañana", "Domingo 04/01", "Lunes 31/12", "nada", "X 31/02"])
    assert got == [dt.date(2025, 12, 30), dt.date(2025, 12, 31), dt.date(2026, 1, 4), dt.date(2025, 12, 31), None, None]
    assert values(spark, D.epoch_millis_date, ["/Date(1772323200000)/", "x"]) == [dt.date(2026, 3, 1), None]
    got = values(spark, D.parse_showtime, ["2026-02-03 10:05", "2026-02-03T10:05:00", "2026-02-30 10:00", "pronto", None])
    assert got == [dt.datetime(2026, 2, 3, 10, 5), dt.datetime(2026, 2, 3, 10, 5), None, None, None]


def test_buckets(spark):
    assert values(spark, D.decade_bucket, [None, 1959, 1960, 1999, 2024], "x int") == ["unknown", "pre-1960", "1960s", "1990s", "2020s"]
    assert values(spark, D.runtime_bucket, [None, 89, 90, 120, 121, 150, 151], "x int") == ["unknown", "short", "medium", "medium", "long", "long", "epic"]
    boost = values(spark, D.popularity_boost, [None, 0, 1000, 10**9], "x long")
    assert boost[:2] == [1.0, 1.0] and abs(boost[2] - 1.02) < 1e-12 and boost[3] == 1.05


def test_references_cut_short_are_text(spark):
    from showgrid.operators.extract import extract_fields
    pages = spark.createDataFrame([(1, '<h1>a&amp;b &lt;c ver&amp</h1><script>if (a && b < 3) "</p>";</script><p class="ad">x & y&am</p>')], "page_id long, html string")
    rules = [{"field": "title", "tag": "h1"}, {"field": "ad", "tag": "p"}, {"field": "code", "tag": "script"}]
    assert {r.field: r.value for r in extract_fields(pages, rules).collect()} == {"title": "a&b <c ver&amp", "ad": "x & y&am", "code": 'if (a && b < 3) "</p>";'}


def test_accents_are_stripped_from_arrow_slices():
    import pyarrow as pa
    import unicodedata
    values = ["\u00c1rbol", None, "", "plain", "e\u0301\u0302", "\u1ec7", "\ud55c"] * 40
    got = X.strip_accents.func(pa.array(values).slice(3))
    want = [v if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if not "\u0300" <= c <= "\u036f") for v in values[3:]]
    assert got.to_pylist() == want and X.strip_accents.func(pa.array([], pa.string())).to_pylist() == []
