"""Location text to city, state, country and remote flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import US_STATES, blank_to_null, unaccent

# Names of US states and the district, with their postal codes.
STATE_NAMES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
US_NAMES = ["us", "usa", "u.s.", "united states", "united states of america"]
# Default foreign names; a city here settles the codes that mean both a state and a country (IN, CA, DE).
FOREIGN_COUNTRIES = ["canada", "india", "germany", "united kingdom", "uk", "france", "spain", "ireland", "brazil", "mexico", "australia", "singapore", "japan", "poland", "netherlands"]
FOREIGN_CITIES = [
    "toronto", "vancouver", "montreal", "quebec", "bangalore", "bengaluru", "hyderabad", "mumbai", "pune", "delhi", "chennai", "london", "manchester", "edinburgh", "dundee", "dublin",
    "berlin", "munich", "hamburg", "paris", "lyon", "villeneuve", "madrid", "barcelona", "lisbon", "rome", "milan", "vienna", "zurich", "prague", "warsaw", "krakow", "budapest",
    "bucharest", "sofia", "belgrade", "novi sad", "zagreb", "ljubljana", "kyiv", "tel aviv", "dubai", "cairo", "lagos", "nairobi", "cape town", "tokyo", "osaka", "seoul", "taipei",
    "taoyuan", "hong kong", "shanghai", "beijing", "shenzhen", "singapore", "kuala lumpur", "jakarta", "manila", "cebu", "bangkok", "hanoi", "da nang", "sydney", "melbourne",
    "auckland", "porto", "aarhus", "copenhagen", "basel", "zug", "geneva", "sao paulo", "bogota", "lima", "santiago", "buenos aires", "guadalajara", "monterrey",
]
PROVINCES = ["on", "bc", "qc", "ab"]
# Codes of states that at the end of a place are as often a country's.
DOUBLE_CODES = ["in", "ca", "de"]
# Default names of regions and nicknames of cities, with the city and state they stand for.
METROS = {
    "san francisco bay area": ("San Francisco", "CA"), "bay area": ("San Francisco", "CA"), "silicon valley": ("San Jose", "CA"), "nyc": ("New York", "NY"), "new york city": ("New York", "NY"),
    "manhattan": ("New York", "NY"), "brooklyn": ("New York", "NY"), "greater boston": ("Boston", "MA"), "chicagoland": ("Chicago", "IL"), "greater chicago": ("Chicago", "IL"), "greater seattle": ("Seattle", "WA"),
    "twin cities": ("Minneapolis", "MN"), "research triangle": ("Raleigh", "NC"), "dallas fort worth": ("Dallas", "TX"), "los angeles": ("Los Angeles", "CA"), "washington dc": ("Washington", "DC"),
    "new london": ("New London", "CT"), "east lansing": ("East Lansing", "MI"),
}
REMOTE = r"\b(remote|work from home|anywhere)\b"


def gazetteer(spark: SparkSession, metros: dict[str, tuple[str, str]] = METROS, foreign_cities: list[str] = FOREIGN_CITIES, foreign_countries: list[str] = FOREIGN_COUNTRIES) -> DataFrame:
    """A table of place names for ``find_places`` from lists; any table of these columns will do.

    name (lower case, words parted by single spaces), foreign, city, state.
    """
    rows = [(n, False, c, s) for n, (c, s) in metros.items()] + [(n, True, None, None) for n in [*foreign_cities, *foreign_countries]]
    return spark.createDataFrame(sorted(set(rows), key=str), "name string, foreign boolean, city string, state string")


def find_places(texts: DataFrame, raw: str, names: DataFrame) -> DataFrame:
    """raw and hit (abroad, city, state) of every distinct text in which a name of the gazetteer stands.

    Runs of words, up to as many as the longest name has, are joined with the names by equality.
    A name inside a longer one that matches does not count: "new london" is not London.
    """
    longest = names.agg(F.coalesce(F.max(F.size(F.split("name", " "))), F.lit(1)).alias("n"))
    cut = F.filter(F.split(F.lower(unaccent(F.col(raw))), "[^a-z0-9]+"), lambda w: w != "")
    worded = texts.select(raw).filter(F.col(raw).isNotNull()).distinct().withColumn("_w", cut).withColumn("_n", longest.scalar())
    started = worded.select(raw, "_w", "_n", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1)))).alias("_at"))
    room = F.least(F.col("_n"), F.size("_w") - F.col("_at") + 1)
    runs = started.filter(room > 0).select(raw, "_w", "_at", F.explode(F.sequence(F.lit(1), room)).alias("_len")).select(raw, "_at", "_len", F.array_join(F.slice("_w", F.col("_at"), F.col("_len")), " ").alias("name"))
    met = runs.join(names, "name").groupBy(raw).agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_len").alias("len"), "foreign", "city", "state"))).alias("_h"))
    covered = lambda h, hits: F.exists(hits, lambda g: (g["len"] > h["len"]) & (g["at"] <= h["at"]) & (g["at"] + g["len"] >= h["at"] + h["len"]))
    own = F.filter("_h", lambda h: ~covered(h, F.col("_h")))
    home = F.get(F.filter(own, lambda h: h["city"].isNotNull()), 0)
    return met.select(raw, F.struct(F.exists(own, lambda h: h["foreign"]).alias("abroad"), home["city"].alias("city"), home["state"].alias("state")).alias("hit"))


def normalize_locations(df: DataFrame, raw: str, workplace: str, names: DataFrame, out: str = "place") -> DataFrame:
    """``normalize_location`` by a gazetteer table, worked out once for each distinct pair of text and workplace."""
    kinds = df.select(raw, workplace).distinct()
    found = find_places(df, raw, names).withColumnRenamed("hit", "_hit")
    read = kinds.join(found, raw, "left").select(F.col(raw).alias("_raw"), F.col(workplace).alias("_workplace"), normalize_location(F.col(raw), F.col(workplace), hit=F.col("_hit")).alias(out))
    return df.join(read, df[raw].eqNullSafe(read["_raw"]) & df[workplace].eqNullSafe(read["_workplace"])).drop("_raw", "_workplace")


def normalize_location(raw: Column, workplace: Column, foreign_countries: list[str] = FOREIGN_COUNTRIES, foreign_cities: list[str] = FOREIGN_CITIES, metros: dict[str, tuple[str, str]] = METROS, hit: Column | None = None) -> Column:
    """Struct of city, state, country (US / foreign / unknown), is_remote and the deciding rule.

    "Remote" alone never becomes a US location.  Of several places the first is read.  Accents
    are folded for all comparisons.  A stated US state stands against a foreign city of that name ("Paris, TX"),
    unless its code is at the end and may be a country's ("Bangalore, IN").  A country or city abroad counts wherever its words stand,
    and so do a three-letter country code in front and, where nothing speaks for the US, letters
    with accents.  "US-CA-San Diego" is read as "San Diego, CA, US", "Austin TX" as "Austin, TX".
    ``hit`` is what ``find_places`` says of the text; without it the lists are searched.
    """
    given = F.trim(F.split_part(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "), F.lit(";"), F.lit(1)))
    coded, spaced = r"^(?:US|USA)\s*-\s*([A-Z]{2})\s*-\s*(.+)$", rf"^([A-Z][A-Za-z.]+(?: [A-Z][A-Za-z.]+)*) ({'|'.join(US_STATES)})$"
    written = F.when(given.rlike(coded), F.regexp_replace(given, coded, "$2, $1, US")).when(given.rlike(spaced), F.regexp_replace(given, spaced, "$1, $2")).otherwise(given)
    accented, text = written != unaccent(written), unaccent(written)
    place = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\(?\b(?:remote|hybrid|on-?site)\b\)?", ""), r"^[\s,/|-]+|[\s,/|-]+$", ""))
    parts = F.filter(F.transform(F.split(place, ","), lambda p: F.trim(p)), lambda p: p != "")
    low = F.transform(parts, lambda p: F.lower(p))
    last, second = F.try_element_at(low, F.lit(-1)), F.when(F.size(low) >= 2, F.element_at(low, F.when(F.size(low) >= 2, 2).otherwise(1)))
    names = F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair])

    def state_of(part: Column) -> Column:
        return F.coalesce(F.when(F.upper(part).isin(US_STATES), F.upper(part)), F.when(F.length(part) > 2, F.element_at(names, part)))

    filled = F.size(parts) > 0
    first = F.when(filled, F.element_at(low, F.when(filled, 1).otherwise(1)))
    if hit is None:
        anywhere = F.lower(place).rlike(r"\b(?:" + "|".join([*foreign_countries, *foreign_cities]) + r")\b")
        known = F.create_map(*[x for n, (c, s) in metros.items() for x in (F.lit(n), F.struct(F.lit(c).alias("city"), F.lit(s).alias("state")))])
        metro = F.when(F.size(parts) == 1, F.element_at(known, F.regexp_replace(first, "[^a-z0-9]+", " ")))
    else:
        anywhere = F.coalesce(hit["abroad"], F.lit(False))
        metro = F.when((F.size(parts) == 1) & hit["city"].isNotNull(), F.struct(hit["city"].alias("city"), hit["state"].alias("state")))
    named_at_home = metro.isNotNull()
    code = F.regexp_extract(text, r"^([A-Z]{3})\s*[-,]\s", 1)
    stated = F.coalesce(state_of(second).isNotNull() | state_of(last).isNotNull(), F.lit(False))
    sure = F.coalesce((state_of(second).isNotNull() & ((F.size(parts) > 2) | ~second.isin(DOUBLE_CODES))) | (state_of(last).isNotNull() & ~last.isin(DOUBLE_CODES)), F.lit(False))
    abroad = F.arrays_overlap(low, F.array(*[F.lit(c) for c in foreign_countries])) | F.coalesce(second.isin(PROVINCES), F.lit(False)) | (anywhere & ~sure)
    # Weaker evidence does not stand against a state or a place at home.
    foreign = F.coalesce(abroad & ~named_at_home, F.lit(False)) | (~stated & ~named_at_home & (accented | ~code.isin("", "USA")))
    us_name = F.arrays_overlap(low, F.array(*[F.lit(c) for c in US_NAMES]))
    state = F.coalesce(state_of(second), F.when(F.size(parts) == 1, state_of(first)), metro["state"])
    only_region = (F.size(parts) == 1) & (last.isin(US_NAMES) | state_of(first).isNotNull())
    us = us_name | state.isNotNull()
    return F.struct(
        F.coalesce(metro["city"], F.when(filled & ~only_region, F.element_at(parts, F.when(filled, 1).otherwise(1)))).alias("city"),
        F.when(filled & (~foreign | us_name), state).alias("state"),
        F.when(~filled, "unknown").when(foreign & ~us_name, "foreign").when(us, "US").otherwise("unknown").alias("country"),
        (F.lower(text).rlike(REMOTE) | (F.coalesce(workplace, F.lit("")) == "remote")).alias("is_remote"),
        F.when(~filled, "no_place").when(foreign & ~us_name, "foreign_name").when(us_name, "us_name").when(named_at_home, "metro").when(state.isNotNull(), "us_state").otherwise("unmatched").alias("rule"))


def repair_locations(df: DataFrame, raw: str, names: DataFrame | None = None) -> DataFrame:
    """Second pass over rows whose country is still unknown, keeping the evidence."""
    unknown = F.coalesce("loc_country", F.lit("unknown")).isin("unknown", "")
    if names is None:
        known = df.withColumn("_found", F.when(unknown, normalize_location(F.col(raw), F.col("workplace_type"))))
    else:
        known = normalize_locations(df, raw, "workplace_type", names, out="_found").withColumn("_found", F.when(unknown, F.col("_found")))
    fixed = F.col("_found.country").isin("US", "foreign")
    return known.withColumns({
        "loc_country": F.when(fixed, F.col("_found.country")).otherwise(F.col("loc_country")),
        "loc_state": F.when(fixed, F.coalesce("_found.state", "loc_state")).otherwise(F.col("loc_state")),
        "loc_city": F.when(fixed, F.coalesce(blank_to_null(F.col("_found.city")), F.col("loc_city"))).otherwise(F.col("loc_city")),
        "location_evidence": F.when(fixed, F.struct(F.col("_found.rule").alias("rule"), F.col(raw).alias("raw"))),
    }).drop("_found")
