import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "key"),
    [("Café de l'Étoile", "cafe de l etoile"), ("  Straße 7 ", "strasse 7"), ("a_b-c", "a_b c"), ("", ""), ("葱油饼", "葱油饼"), ("İstanbul", "istanbul")],
)
def test_name_key(spark, text, key):
    assert value(spark, T.name_key(F.lit(text))) == key


def by_unicodedata(text, tag=False):
    text = unicodedata.normalize("NFKD", text.strip().lower()) if tag else unicodedata.normalize("NFKD", text).casefold()
    bare = "".join(x for x in text if not unicodedata.combining(x))
    return " ".join(re.sub(r"[^\w\s-]" if tag else r"[^\w]+", " ", bare).split())


def test_keys_on_every_letter(spark):
    """Every letter, number and mark of all planes that the JVM's Unicode has, between two others, against unicodedata."""
    letters = [chr(i) for i in range(0x20, 0x30000) if unicodedata.category(chr(i))[0] in "LNM"]
    df = spark.createDataFrame([(i, f"É{x}a {x}") for i, x in enumerate(letters)], "i int, t string")
    got = df.select("i", T.name_key("t").alias("n"), T.plain_key("t").alias("p"), T.tag_key("t").alias("g")).toPandas().set_index("i")
    for i, x in enumerate(letters):
        text = f"É{x}a {x}"
        bare = "".join(y for y in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(y))
        assert got.p[i] == bare, hex(ord(x))
    known = set(spark.createDataFrame([(x,) for x in letters], "x string").where(F.col("x").rlike(r"^\P{Cn}$")).toPandas().x)
    assert len(known) > 0.9 * len(letters)
    odd = [hex(ord(x)) for i, x in enumerate(letters) if x in known and got.n[i] != by_unicodedata(f"É{x}a {x}")]
    tags = [hex(ord(x)) for i, x in enumerate(letters) if x in known and got.g[i] != by_unicodedata(f"É{x}a {x}", True)]
    assert not odd, odd[:20]
    assert not tags, tags[:20]


def test_keys_of_texts(spark):
    texts = ["Café de l'Étoile", "Straße", "ﬁne Ⅷ ①", "ＡＢＣ", "й Ǆ", "한국어 김치", "हिन्दी", "𝐀𝔟 ﷺ", "ΐ ᾳ̂ Σίσυφος", "", "½ x²"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", T.name_key("t").alias("k")).collect()}
    assert got == {i: by_unicodedata(t) for i, t in enumerate(texts)} | {99: None}


def test_names(spark):
    assert value(spark, T.clean_name(F.lit("@muku.paris"))) == "Muku Paris"
    assert value(spark, T.clean_name(F.lit(" Muku "))) == "Muku"
    assert value(spark, T.handle_key(F.lit("@muku.paris"))) == "muku paris"
    assert value(spark, T.split_names(F.lit("Alpha | B / Gamma · Delta"))) == ["Alpha", "Gamma", "Delta"]
    assert value(spark, T.split_names(F.lit("a-b"))) == ["a-b"]
    assert value(spark, T.repeated_brand(F.lit("HAY HAY home shopping"), F.lit("shop"))) == "HAY HAY"
    assert value(spark, T.repeated_brand(F.lit("HAY HOME home shopping"), F.lit("shop"))) is None
    assert value(spark, T.is_common_noun(F.lit("bocal"), F.lit("place"))) is True
    assert value(spark, T.is_common_noun(F.lit("葱油饼"), F.lit("place"))) is False
    assert value(spark, T.is_common_noun(F.lit("bocal"), F.lit("product"))) is False


def test_places(spark):
    lit = F.lit
    assert value(spark, T.city_for(lit("place"), lit("France"), lit(" france"))) is None
    assert value(spark, T.city_for(lit("place"), lit("Nara"), lit("Japon"))) == "Nara"
    assert value(spark, T.city_for(lit("media"), lit("Nara"), lit("Japon"))) is None
    assert value(spark, T.clean_locality(lit("7"))) is None
    assert value(spark, T.clean_locality(lit("Paris, 860 m"))) is None
    assert value(spark, T.clean_locality(lit(" Le Marais "))) == "Le Marais"
    assert value(spark, T.scale_for(lit("place"), lit("street"))) == "site"
    assert value(spark, T.scale_for(lit("brand"), lit("site"))) is None
    assert value(spark, T.maps_url(lit("Café & co"), lit(None).cast("string"), lit("Paris"))).endswith("query=Caf%C3%A9+%26+co+Paris")


def test_facets_and_tags(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, T.facets_for(F.lit("restaurant"), arr("ramen", "ramen", "beauty", "bar", "cafe", "sushi"))) == ["ramen", "bar", "cafe"]
    assert value(spark, T.facets_for(F.lit("media"), arr("sushi", "anime"))) == ["anime"]
    tags = T.useful_tags(arr("Michelin", "Paris food", "michelin", "japon"), [F.lit("Paris"), F.lit("Japon"), F.lit("Muku")], arr("ramen"))
    assert value(spark, tags) == ["michelin"]
    assert value(spark, T.distinct_tags(arr("Randonnée", "randonnee", "", "a"))) == ["randonnee", "a"]
    assert value(spark, T.key_points(arr(" One  two ", "one two", "", "three"))) == ["One two", "three"]
    assert value(spark, T.unknown_facets(arr("ramen", "weird"))) == ["weird"]


def test_values(spark):
    assert value(spark, T.is_price_or_quantity(F.lit("12,50 €"))) is True
    assert value(spark, T.is_price_or_quantity(F.lit("12 rue"))) is False
    assert value(spark, T.ratio_of_percent(F.lit(95.0))) == 0.95
    assert value(spark, T.blank_to_null(F.lit(" Inconnu "))) is None
    assert value(spark, T.attested_value(F.lit("Paris 3"), F.lit("📍 paris 3eme"))) == "Paris 3"
    assert value(spark, T.attested_value(F.lit("12 Rue de Lancry"), F.lit("MUJI Taipei"))) is None
    assert value(spark, T.string_array(F.lit('["a", " ", "b"]'))) == ["a", "b"]
    assert value(spark, T.string_array(F.lit("nonsense"))) == []
    assert value(spark, T.question_terms(F.lit("Quel restaurant à Paris pour les ramen ?"))) == ["restaurant", "paris", "ramen"]
    assert value(spark, T.title(F.lit("x" * 80))) == "x" * 72 + "…"
    assert str(value(spark, T.iso_date(F.lit("2024-02-29")))) == "2024-02-29"
    assert value(spark, T.iso_date(F.lit("2024-02-30"))) is None


def test_containment(spark):
    assert value(spark, T.contains_words(F.lit("Vu au Café, de l'Étoile!"), F.lit("cafe de l etoile"))) is True
    assert value(spark, T.contains_words(F.lit("cafeteria"), F.lit("cafe"))) is False
    assert value(spark, T.contains_words(F.lit("x"), F.lit("!"))) is False
    assert value(spark, T.near_literal(F.lit("Les Pertes de la Valserine"), F.lit("Pertes de Valserine"))) is True
    assert value(spark, T.near_literal(F.lit("anything"), F.lit("one"))) is False
