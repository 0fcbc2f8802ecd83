"""Text, path and html column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_LATIN = r"[؀-ۿݐ-ݿᄀ-ᇿ぀-ゟ゠-ヿ㐀-䶿一-鿿가-힯Ѐ-ӿ฀-๿ऀ-ॿ]"
# Transliteration of Latin-1 and Latin Extended-A letters that are one letter in English.
FOLD_FROM = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľłñńņňòóôõöøōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
FOLD_TO = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijkllllnnnnooooooooorrrssssttuuuuuuuuuuwyyyzzz"


def slugify(s: Column) -> Column:
    """Lower case, transliterated, letters and digits joined by single dashes; other characters go."""
    x = F.translate(F.lower(F.coalesce(s, F.lit(""))), FOLD_FROM, FOLD_TO)
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "ß", "ss"), "æ", "ae"), "œ", "oe")
    x = F.regexp_replace(F.regexp_replace(x, "&", " and "), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"[\s-]+", "-"), "^-+|-+$", "")


def latin_portion(s: Column) -> Column:
    """Of a text with non-Latin script, its longest run of Latin tokens, the first of equal ones; else the text."""
    tokens = F.filter(F.split(s, r"[,()\[\]{}\s]+"), lambda t: t != "")
    start = F.struct(F.array().cast("array<string>").alias("best"), F.array().cast("array<string>").alias("run"))

    def step(acc, t):
        run = F.when(t.rlike(NON_LATIN), F.array().cast("array<string>")).otherwise(F.array_append(acc["run"], t))
        return F.struct(F.when(F.size(run) > F.size(acc["best"]), run).otherwise(acc["best"]).alias("best"), run.alias("run"))

    return F.when(~s.rlike(NON_LATIN), s).otherwise(F.aggregate(tokens, start, step, lambda acc: F.array_join(acc["best"], " ")))


def route_path(country: Column, state: Column, city: Column) -> Column:
    return F.concat(F.lit("/wetbulb-temperature/"), F.concat_ws("/", country, state, city), F.lit("/"))


# Countries that the city pages name otherwise than the source of codes.
COUNTRIES = {
    "Macedonia, the Former Yugoslav Republic of": "North Macedonia",
    "Iran, Islamic Republic of": "Iran",
    "Korea, Democratic People's Republic of": "North Korea",
    "Korea, Republic of": "South Korea",
    "Viet Nam": "Vietnam",
    "Taiwan, Province of China": "Taiwan",
    "Holy See (Vatican City State)": "Vatican City",
    "Russian Federation": "Russia",
    "Bolivia, Plurinational State of": "Bolivia",
    "Venezuela, Bolivarian Republic of": "Venezuela",
    "Congo, the Democratic Republic of the": "DR Congo",
    "Congo": "Republic of Congo",
    "Lao People's Democratic Republic": "Laos",
    "Micronesia, Federated States of": "Micronesia",
    "Moldova, Republic of": "Moldova",
    "Palestine, State of": "Palestine",
    "Saint Vincent and the Grenadines": "St Vincent and Grenadines",
    "Brunei Darussalam": "Brunei",
    "Syrian Arab Republic": "Syria",
    "Tanzania, United Republic of": "Tanzania",
    "Virgin Islands, British": "British Virgin Islands",
    "Virgin Islands, U.S.": "US Virgin Islands",
    "Timor-Leste": "East Timor",
    "Côte d'Ivoire": "Ivory Coast",
    "Falkland Islands (Malvinas)": "Falkland Islands",
    "Saint Kitts and Nevis": "St Kitts and Nevis",
    "Bosnia and Herzegovina": "Bosnia",
    "Czech Republic": "Czechia",
    "Bonaire, Sint Eustatius and Saba": "Caribbean Netherlands",
    "Cocos (Keeling) Islands": "Cocos Islands",
    "Eswatini": "Swaziland",
    "Heard Island and McDonald Islands": "Heard and McDonald Islands",
    "Saint Helena, Ascension and Tristan da Cunha": "Saint Helena",
    "Saint Pierre and Miquelon": "St Pierre and Miquelon",
    "Saint Lucia": "St Lucia",
    "Saint Martin (French part)": "St Martin",
    "Saint Barthélemy": "St Barthelemy",
    "Svalbard and Jan Mayen": "Svalbard",
    "Turks and Caicos Islands": "Turks and Caicos",
    "Wallis and Futuna": "Wallis and Futuna Islands",
    "United States Minor Outlying Islands": "US Minor Outlying Islands",
    "South Georgia and the South Sandwich Islands": "South Georgia",
    "Sao Tome and Principe": "Sao Tome",
    "Réunion": "Reunion",
    "Western Sahara": "Western Sahara",
    "Sint Maarten (Dutch part)": "Sint Maarten",
}


def normalize_country(name: Column, renames: dict[str, str] = COUNTRIES) -> Column:
    """A renamed country; else its name without a leading The, a final `of`, what follows a comma, a closing bracket, and what stands before the
    last `of` or `and`."""
    renamed = F.element_at(F.create_map(*[F.lit(x) for pair in renames.items() for x in pair]), name)
    out = name
    for pattern in (r"^(?i)the ", r" of$", r",.*$", r" \(.*\)$", r"^.*\s+of\s+", r"^.*\s+and\s+"):
        out = F.regexp_replace(out, pattern, "")
    return F.coalesce(renamed, F.trim(out))


def url_path(url: Column) -> Column:
    """The path without query and fragment, ending in a single slash."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("/")), r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))


def classify_page(path: Column) -> Column:
    """homepage, directory, country, region or city by the number of segments; other outside the directory."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    ours = F.element_at(F.concat(parts, F.array(F.lit(""))), 1) == "wetbulb-temperature"
    return F.when(n == 0, "homepage").when(~ours, "other").when(n == 1, "directory").when(n == 2, "country").when(n == 3, "region").otherwise("city")


def safe_int(s: Column) -> Column:
    """Whole part of a number in text; 0 for anything else."""
    return F.coalesce(s.try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def safe_path(path: Column) -> Column:
    """Whether a path starts and ends with a slash and has no scheme, dots, controls, query or fragment."""
    return path.rlike(r"^/(?:[^/?#\x00-\x1f]+/)*$") & ~path.rlike(r"\.\.|://")


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a hash of an ASCII text."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(chars, F.lit(2166136261).cast("long"), step)


def fnv1a_bucket(s: Column, n: int) -> Column:
    return (fnv1a(s) % n).cast("int")


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_anchors(html: Column) -> Column:
    """The page's distinct link targets, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*href="([^"]*)\""""), F.lit(1))))


#: Open graph fields of a page.
OG = ["title", "description", "type", "url", "image", "site_name"]


def tag_attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty where it is missing."""
    pattern = rf"""(?i)\b{name}=(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def page_fields(html: Column) -> list[Column]:
    """description, robots, og_*, canonical and n_json_ld of a page; a missing field is empty. Each is that of the first tag with its name."""
    metas = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    links = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    first = lambda tags, key, name, value: F.coalesce(tag_attribute(F.get(F.filter(tags, lambda t: F.lower(tag_attribute(t, key)) == name), F.lit(0)), value), F.lit(""))
    named = [first(metas, "name", n, "content").alias(n) for n in ("description", "robots")]
    graph = [first(metas, "property", f"og:{n}", "content").alias(f"og_{n}") for n in OG]
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>.*?</script>"""), F.lit(0))
    return [*named, *graph, first(links, "rel", "canonical", "href").alias("canonical"), F.size(scripts).cast("bigint").alias("n_json_ld")]


def page_indexable(html: Column) -> Column:
    """Whether no robots meta tag says noindex or none."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)<meta[^>]*name="robots"[^>]*content="([^"]*)\""""), F.lit(1))
    return ~F.exists(tags, lambda t: F.lower(t).rlike(r"\b(?:noindex|none)\b"))


def location_key(lat: Column, lon: Column) -> Column:
    """Canonical text of a coordinate pair; minus zero is zero."""
    plain = lambda v: F.when(v == 0, F.lit("0")).otherwise(F.regexp_replace(v.cast("string"), r"\.0$", ""))
    return F.concat_ws(",", plain(lat), plain(lon))


def nearby_label(name: Column, region: Column, country: Column, own_region: Column, own_country: Column) -> Column:
    """The name, with region and country where they differ from the linking city's."""
    far = country != own_country
    return F.concat_ws(", ", name, F.when(far | (region != own_region), region), F.when(far, country))
