"""Keyed, repeatable choices: the same value always gets the same stand-in.

SHA-256 keeps the choice independent of partitioning, retries and engine. The functions give SQL
text over a column or lambda variable, so that they nest in array expressions.
"""

from __future__ import annotations

from veil.functions.spans import let

# Our own pools; only their sizes and flavour follow the data model.
FIRST_NAMES = (
    "Nia Otto Rhea Hugo Lena Milo Tess Remy Cleo Finn Iris Jude Lola Nico Opal Pia "
    "Quin Rosa Seth Theo Una Vera Wade Xena Yara Zane Abel Bea Cora Dale Elsa Gus"
).split()
LAST_NAMES = (
    "Abbott Barlow Carver Dalton Easton Fisher Garner Harper Ingram Jarvis Keller Lawson Mercer "
    "Norton Osborn Parker Quincy Ramsey Sawyer Tanner Upton Vaughn Walker Yates Zeller Ashby "
    "Bolton Corbin Draper Emmett Fulton Graham"
).split()
ORGANIZATIONS = [
    "Northwind Partners", "Bluepeak Holdings", "Ironbridge Labs", "Clearwater Systems",
    "Summit Ridge Group", "Lakeshore Analytics", "Pinecone Works", "Harborview LLC",
    "Cobalt Ventures", "Everfield Trading", "Granite Point Inc", "Redwood Logistics",
    "Silverline Media", "Copperleaf Studio", "Whitecap Energy", "Meadowlark Foods",
]
CITIES = [
    "Ashford", "Brentwood", "Clayton", "Dunmore", "Elmhurst", "Fairmont", "Glenwood", "Hartley",
    "Inverness", "Kingsley", "Lakewood", "Milford", "Norwood", "Oakdale", "Preston", "Rockport",
]
LOCATIONS = [
    "Harbor Side", "North Quarter", "Market Square", "West End", "Mill District", "Garden Row",
    "Upper Terrace", "Station Yard", "Canal Front", "Museum Hill",
]
ADDRESSES = [
    "12 Alder Street", "34 Beacon Avenue", "56 Chestnut Road", "78 Dogwood Drive",
    "90 Elder Lane", "21 Foxglove Way", "43 Garnet Court", "65 Hawthorn Place",
    "87 Ivory Circle", "109 Juniper Street", "131 Kestrel Avenue", "153 Laurel Road",
]
APT_TYPES = [
    "Apt 7C", "Suite 310", "Unit 9D", "Floor 6", "Room 21", "Office 2B", "Flat 5A", "Studio 3",
    "Annex B", "Loft 8", "Bay 14", "Level 2",
]
MISC_LABELS = ["[Withheld]", "[Veiled]", "[Private]", "[Removed]", "[Sealed]", "[Concealed]"]
WORDS = "amber basil cedar delta ember fable grove haven indigo jasper kelp linen".split()


def digest(value: str, salt: str = "") -> str:
    text = salt.replace("\\", "\\\\").replace("'", "\\'")
    return f"sha2(concat('{text}', {value}), 256)"


def hash_int(value: str, salt: str = "", start: int = 1) -> str:
    """32 bits of the digest, from hex digit ``start``, as BIGINT."""
    return f"CAST(conv(substr({digest(value, salt)}, {start}, 8), 16, 10) AS BIGINT)"


def choose(pool: list[str], hashed: str) -> str:
    """A pool entry by a hash or rank already computed."""
    entries = ", ".join(f"'{p}'" for p in pool)
    return f"get(array({entries}), CAST({hashed} % {len(pool)} AS INT))"


def pick(pool: list[str], value: str, salt: str = "", start: int = 1) -> str:
    """A pool entry chosen by the value's hash."""
    return choose(pool, hash_int(value, salt, start))


def digit_stream(value: str, salt: str = "") -> str:
    """64 decimal digits that depend on the value only."""
    return f"translate({digest(value, salt)}, 'abcdef', '012345')"


def replace_digits(text: str, salt: str = "") -> str:
    """Every digit replaced by position; punctuation, spacing and letters stay."""
    swapped = f"""array_join(transform(split({text}, ''), (ch, i) ->
        IF(ch BETWEEN '0' AND '9', substr(stream, i % 64 + 1, 1), ch)), '')"""
    return f"IF(rlike({text}, '[0-9]'), {let(digit_stream(text, salt), 'stream', swapped)}, {text})"
