"""Countries and cities that texts name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own gazetteer: names of countries, in English and their own, and of their largest cities, as whole words.
GAZETTEER = {
    "United Kingdom": "united kingdom|great britain|britain|uk|england|scotland|wales|northern ireland|london|birmingham|leeds|glasgow|sheffield|liverpool|edinburgh|cardiff|belfast",
    "Germany": "germany|deutschland|berlin|hamburg|munich|münchen|cologne|köln|frankfurt|stuttgart|düsseldorf|leipzig|dortmund|bremen",
    "France": "france|paris|marseille|lyon|toulouse|nice|nantes|strasbourg|bordeaux|lille",
    "Spain": "spain|españa|madrid|barcelona|valencia|sevilla|seville|zaragoza|málaga|bilbao",
    "Italy": "italy|italia|rome|roma|milan|milano|naples|napoli|turin|torino|bologna|florence|firenze",
    "Netherlands": "netherlands|nederland|holland|amsterdam|rotterdam|utrecht|eindhoven|the hague|den haag",
    "Austria": "austria|österreich|vienna|wien|graz|linz|salzburg|innsbruck",
    "Switzerland": "switzerland|schweiz|suisse|zurich|zürich|geneva|genève|basel|bern|lausanne",
    "Canada": "canada|toronto|montreal|montréal|calgary|ottawa|edmonton",
    "Australia": "australia|sydney|brisbane|perth|adelaide|canberra",
    "United States": "united states|usa|u.s.a.|new york|los angeles|chicago|houston|seattle|boston|san francisco",
}
#: Spellings of cities.
CITIES = {"Munich": ("munich", "münchen"), "Vienna": ("vienna", "wien"), "Milan": ("milan", "milano"), "Turin": ("turin", "torino"), "Copenhagen": ("copenhagen", "københavn"), "Berlin": ("berlin",), "Oslo": ("oslo",), "Amsterdam": ("amsterdam",)}
COUNTRIES = ("Germany", "Netherlands", "Austria", "Norway", "France", "Denmark", "Italy", "Spain")
#: A search term's own place: what follows the quoted title, up to the sites that it is limited to.
PLACE_SLOT = r'^"[^"]*" ([^:"]*?)(?: site:.*)?$'


def gazetteer_pattern(country: str) -> str:
    """Any of the country's names with no letter or digit before or after it; Java and RE2 read it alike."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + GAZETTEER[country].replace(".", r"\.") + r")(?:$|[^\p{L}\p{N}_])"


def hinted_country(location: Column) -> Column:
    """The first country of the gazetteer of which the location holds a name as whole words, else null."""
    text = F.lower(F.coalesce(location, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for country in GAZETTEER:
        out = out.when(text.rlike(gazetteer_pattern(country)), country)
    return out


def mentions_city(city: str, text: Column) -> Column:
    """Whether any spelling of the city is part of the text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for spelling in CITIES.get(city, (city.lower(),)):
        out = out | low.contains(spelling)
    return out


def place_of_term(term: Column) -> Column:
    """(kind, place) of a search term: cities before countries, read in its place slot, in all of it if it has none."""
    slot = F.regexp_extract(F.coalesce(term, F.lit("")), PLACE_SLOT, 1)
    low = F.lower(F.when(slot != "", slot).otherwise(F.coalesce(term, F.lit(""))))
    found = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit("").alias("place")))
    for kind, names in (("city", CITIES), ("country", COUNTRIES)):
        for name in names:
            found = found.when(low.contains(name.lower()), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("place")))
    return found
