"""Text functions against hand-written cases."""

from pyspark.sql import functions as F

from tanik.functions import spans, text, vocab


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_normalize_and_tokens():
    assert text.plain_normalized("İstanbul’da IŞIK, Ağrı!") == "istanbul da isik agri"
    assert text.plain_folded("  Şubat   ÇOK-iyi ") == "subat cok-iyi"


def test_tokens_use_synonyms(spark):
    words = one(spark, F.array_join(text.word_set(text.normalize_text("t")), " "), t="Kazada bir araç yaralandı ve kaza son")
    assert words == "arac kaza yarali"


def test_news_dates(spark):
    cases = {"1 Ocak 2026 00:05": "2025-12-31 21:05:00", "29 Şubat 2024": "2024-02-28 21:00:00", "31 Şubat 2026": None, "2026-09-13T14:15:54.47": "2026-09-13 11:15:54", "Sun, 13 Sep 2026 10:00:00 GMT": "2026-09-13 10:00:00", "13.09.2026 10:00": "2026-09-13 07:00:00", "2011-01-01T00:00:00Z": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    found = {r.t: r.x for r in rows.select("t", F.date_format(text.parse_news_date(F.col("t"), text.fold_turkish("t")), "yyyy-MM-dd HH:mm:ss").alias("x")).collect()}
    assert found == cases


def test_date_ranges(spark):
    cases = {"27 Ağustos-3 Eylül 2026": ["2026-08-27", "2026-09-03"], "15-16 Eylül 2026": ["2026-09-15", "2026-09-16"], "08.09.2026-22.09.2026": ["2026-09-08", "2026-09-22"], "10 Eylül": [], "16-15 Eylül 2026": [], "2026-02-30": []}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in rows.select("t", text.parse_dates(text.fold_turkish("t")).alias("x")).collect()} == cases


def test_numbers_and_content(spark):
    assert [one(spark, text.read_number(F.col("t")), t=t) for t in ("4.5", "4,5", "üç", "12", "çok")] == [4.5, 4.5, 3.0, 12.0, None]
    assert one(spark, text.normalize_content(F.col("t")), t="a \t b\r\n\r\n\r\n\r\nc ") == "a b\n\nc"
    assert one(spark, text.excerpt(F.col("t"), 5), t="a  b c d e") == "a b…"


def test_private_summary(spark):
    case = lambda q: one(spark, text.private_summary(F.col("q"), text.normalize_query(text.fold_turkish("q")), ("yks", "basvuru")), q=q)
    assert case("Ahmet Yılmaz için yks başvuru") == "basvuru yks"
    assert case("a@b.com yks") is None and case("12345678901 yks") is None


def test_claims_are_exact_slices():
    story = "Ankara'da zincirleme kaza oldu. Kazada 3 araç çarpıştı, 2 kişi yaralandı. \U0001f600 Yol trafiğe kapandı."
    found = spans.analysis_of("Kaza", story)
    assert found["kind"] == "traffic_accident"
    raw = story.encode("utf-16-le")
    assert {(c["predicate"], c["value"]) for c in found["claims"]} >= {("vehicle_count", "3"), ("injury_count", "2"), ("road_closed", "true"), ("event_occurred", '"traffic_accident"')}
    assert all(raw[2 * c["start"] : 2 * c["end"]].decode("utf-16-le") == c["quote"] for c in found["claims"])


def test_entity_limit():
    found = spans.analysis_of("t", " ".join(vocab.CITIES))
    assert len(found["entities"]) == 80 and found["limitations"][0] == "entity_limit"


def test_links():
    parts = spans.links_of("see (https://a.org/x). or www.b.org, me@www.c.org", [])
    assert [p["href"] for p in parts if p["href"]] == ["https://a.org/x", "https://www.b.org/"]
    assert "".join(p["text"] for p in parts) == "see (https://a.org/x). or www.b.org, me@www.c.org"


def test_links_lead_to_their_one_target(spark):
    shown = lambda text, known=(): [p["href"] for p in spans.links_of(text, list(known)) if p["href"]]
    assert shown("WWW.B.ORG:443/a]] ‘https://c.org/ş’ x:www.d.org http://u:p@e.org http:// https://[::1]/x") == ["https://www.b.org/a", "https://c.org/%C5%9F", "https://[::1]/x"]
    one, two = ("https://A.org", "https://a.org/result?x=1"), ("www.b.org", "https://b.org/other")
    assert shown("https://a.org www.b.org", [one, two, one]) == ["https://a.org/result?x=1", "https://b.org/other"]
    assert shown("https://a.org", [one, ("https://a.org/", "https://a.org/second")]) == ["https://a.org/"]
    assert shown("https://a.org", [("https://a.org", "mailto:x"), ("a.org", "https://z.org")]) == ["https://a.org/"]
    long = "www.a.org/" + ")" * 200_000
    assert shown(long) == ["https://www.a.org/"]
    row = spark.sql("SELECT 'https://a.org' AS t, array(named_struct('text', 'https://a.org', 'url', 'https://a.org/x'), named_struct('text', null, 'url', 'y'), null) AS l")
    assert row.select(spans.text_links(F.col("t"), F.col("l")).alias("p")).first().p[0].href == "https://a.org/x"
    assert row.select(spans.text_links(F.lit(None).cast("string"), F.lit(None).cast(row.schema["l"].dataType)).alias("p")).first().p == []


def test_category_and_breaking(spark):
    rows = spark.createDataFrame([("borsa yukseldi", "", "politics", "x"), ("meclis", "okul", "politics", "x"), ("x", "okul acildi", "general", "x"), ("x", "y", "sports", "x"), ("x", "y", "general", "yok")], "t string, e string, k string, s string")
    found = [r.c for r in rows.select(text.news_category(F.col("t"), F.col("e"), F.col("k"), F.col("s")).alias("c")).collect()]
    assert found == ["ekonomi", "gundem", "egitim", "spor", "egitim"]


def test_normal_forms_of_odd_texts():
    """Against the rules written out sign by sign; plain texts take a shorter way."""
    import random
    import re
    import unicodedata

    from tanik.functions import spans, text

    bare = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.category(c).startswith("M"))
    draw = random.Random(3)
    signs = ["a", "Z", "9", " ", "'", "\u2019", "`", "\n", "\u0130", "\u0131", "\u0307", "\u00e9", "e\u0301", "\ufb01", "\u0903", "\u20dd", "\u1e9e", "\U0001f600", "\u212b", "\u00b2", "\x00", "\U0001d165", "\U0001e944"]
    for _ in range(3000):
        raw = "".join(draw.choice(signs if draw.random() < 0.7 else ["b", "C", "-"]) for _ in range(draw.randint(0, 12)))
        low = unicodedata.normalize("NFKC", raw).lower().replace("\u0131", "i")
        assert text.plain_normalized(raw) == re.sub("[^a-z0-9]+", " ", re.sub("[\u2019'`]", " ", bare(low))).strip()
        assert text.plain_folded(raw) == " ".join(bare(raw.lower()).replace("\u0131", "i").split())
    assert spans._LONGEST.get("ankara", 0) >= 1 and "kelime" not in spans._LONGEST  # words that begin no name are passed by
