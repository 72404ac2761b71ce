"""String rules for catalogs and protocols."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Category spellings and the category they stand for.
CATEGORY_ALIASES = {
    "molecular biology": "molecular_biology",
    "molbio": "molecular_biology",
    "pcr": "molecular_biology",
    "qpcr": "molecular_biology",
    "consumable": "consumables",
    "consumables": "consumables",
    "plasticware": "consumables",
    "cell culture": "cell_culture",
    "antibody": "antibodies",
    "antibodies": "antibodies",
}

#: License names of the protocol service.
PROTOCOL_SERVICE_LICENSES = {
    "cc0": "CC0",
    "cc-by": "CC-BY",
    "ccby": "CC-BY",
    "cc by": "CC-BY",
    "cc-by-nc": "CC-BY-NC",
    "ccbync": "CC-BY-NC",
    "cc by-nc": "CC-BY-NC",
    "all rights reserved": "all-rights-reserved",
    "arr": "all-rights-reserved",
}

#: License names of the literature service.
LITERATURE_LICENSES = {
    "cc0": "CC0",
    "cc by": "CC-BY",
    "cc-by": "CC-BY",
    "cc by-sa": "CC-BY-SA",
    "cc by-nc": "CC-BY-NC",
    "cc by-nc-sa": "CC-BY-NC-SA",
    "cc by-nc-nd": "CC-BY-NC-ND",
}

UNKNOWN_LICENSE = "unknown"
#: Unicode white space, as a class of a regular expression and one by one.
BLANK_CLASS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
BLANKS = "".join(chr(p) for p in range(0x3001) if chr(p).isspace())


def strip(c: Column) -> Column:
    """White space off both ends; ``trim`` alone knows only spaces."""
    return F.btrim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def lookup(table: Mapping[str, str], key: Column, default: Column | str) -> Column:
    """The value of a small fixed table."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, key), default if isinstance(default, Column) else F.lit(default))


def canonical_category(raw: Column) -> Column:
    """An alias' category, else words joined by underscores; nothing gives uncategorized."""
    key = F.lower(strip(raw))
    slug = F.btrim(F.regexp_replace(key, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit("uncategorized")).otherwise(lookup(CATEGORY_ALIASES, key, slug))


def canonical_text(brand: Column, name: Column, category: Column, specs: Column) -> Column:
    """``brand | name | category | k=v ...`` with keys in order and empty parts left out."""
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce(specs, F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.concat_ws(" | ", filled(brand), filled(name), filled(category), pairs)


def normalize_material(term: Column) -> Column:
    """Lower case, runs of hyphens, slashes and white space as one space."""
    return strip(F.regexp_replace(F.lower(F.coalesce(term, F.lit(""))), f"[-/{BLANK_CLASS}]+", " "))


def strip_html(value: Column) -> Column:
    """Tags as spaces, ampersands decoded, no NUL."""
    return F.replace(strip(F.replace(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]+>", " "), F.lit("&amp;"), F.lit("&"))), F.lit("\x00"), F.lit(""))


def normalize_doi(value: Column) -> Column:
    """The bare identifier without resolver or version; null if nothing is left."""
    bare = F.regexp_replace(strip(value), "(?i)^https?://", "")
    bare = F.regexp_replace(bare, r"(?i)^(dx\.)?doi\.org/", "")
    return filled(F.regexp_replace(bare, r"/v\d+$", ""))


def slug(text: Column) -> Column:
    """Words joined by hyphens; ``q`` if there are none."""
    return F.coalesce(filled(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))), F.lit("q"))


def license_of(raw: Column, table: Mapping[str, str] = PROTOCOL_SERVICE_LICENSES) -> Column:
    """A source's license name as one of ours; what isn't known is unknown and never served."""
    return lookup(table, F.lower(strip(raw)), UNKNOWN_LICENSE)


def author_name(first: Column, last: Column, name: Column, username: Column) -> Column:
    full = F.concat_ws(" ", filled(first), filled(last))
    return strip(F.coalesce(filled(full), filled(name), filled(username), F.lit("")))


def gid_tail(gid: Column) -> Column:
    """What follows the last slash of a resource id."""
    return F.substring_index(gid, "/", -1)


def looks_like_kit(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("kit"))


def product_sku(product_id: Column) -> Column:
    """``ASR-`` and the first six hex digits of the id."""
    return F.concat(F.lit("ASR-"), F.upper(F.substring(F.replace(product_id, F.lit("-"), F.lit("")), 1, 6)))


def public_specs(specs: Column) -> Column:
    """Specs without internal keys, which begin with an underscore."""
    return F.map_filter(specs, lambda k, v: ~F.startswith(k, F.lit("_")))


def percent_encoded(value: Column) -> Column:
    """URL quoting with %20 for spaces and tildes kept."""
    out = F.url_encode(value)
    for java, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(java), F.lit(plain))
    return out


def search_url(name: Column) -> Column:
    return F.concat(F.lit("/search?q="), percent_encoded(name))


def protocol_label(title: Column, first_author: Column) -> Column:
    return F.when(filled(first_author).isNotNull(), F.concat(title, F.lit(" ("), first_author, F.lit(")"))).otherwise(title)


def rich_text(value: Column) -> Column:
    """Editor state in a JSON string as lines of its blocks; anything else as it is."""
    plain = strip(F.coalesce(value, F.lit("")))
    state = F.from_json(plain, "blocks array<struct<text:string>>")
    lines = F.filter(F.transform(F.coalesce(state["blocks"], F.array().cast("array<struct<text:string>>")), lambda b: strip(F.coalesce(b["text"], F.lit("")))), lambda t: t != "")
    valid = F.try_parse_json(plain).isNotNull()
    text = F.when(F.startswith(plain, F.lit("{")) & valid, strip(F.array_join(lines, "\n"))).otherwise(plain)
    return F.replace(text, F.lit("\x00"), F.lit(""))
