"""Tunables, parameter grids and lexicons."""

from __future__ import annotations

from dataclasses import dataclass, replace


# The defaults of blocking, learning and the rules.
@dataclass(frozen=True)
class Blocking:
    max_block: int = 1000  # keys that more records of the other side share are not used
    top_name: int = 20
    top_addr: int = 20
    top_total: int = 30
    weight_power: float = 1.0


@dataclass(frozen=True)
class Learning:
    prune: float = 0.02  # pairs under this first-stage score never match
    hard: float = 0.005  # training keeps all pairs of at least this score ...
    easy_modulus: int = 10  # ... and one in so many of the others, weighted up
    trees: int = 100
    rate: float = 0.05
    depth: int = 7
    seed: int = 0


@dataclass(frozen=True)
class Params:
    """Parameters of the rule scorer and of the decision."""

    W_NAME: float = 0.5
    W_NAME_TRANSLIT: float = 0.25
    NUM_BONUS: float = 0.10
    NUM_PENALTY: float = 0.25
    NAME_ONLY_THRESHOLD: float = 0.92
    ADDR_ONLY_CONT: float = 0.95
    ADDR_ONLY_IDF: float = 30.0
    MATCH_THRESHOLD: float = 0.70
    RELATIVE_MARGIN: float = 0.20

    def with_(self, **changes: float) -> Params:
        return replace(self, **changes)


# The grids that tuning walks, in order.
RULE_GRID: dict[str, list[float]] = {
    "MATCH_THRESHOLD": [0.55, 0.6, 0.63, 0.66, 0.68, 0.7, 0.72, 0.74, 0.77, 0.8],
    "W_NAME": [0.3, 0.4, 0.5, 0.6, 0.7],
    "W_NAME_TRANSLIT": [0.1, 0.2, 0.25, 0.3, 0.4],
    "NUM_BONUS": [0.0, 0.05, 0.1, 0.2],
    "NUM_PENALTY": [0.0, 0.1, 0.25, 0.4],
    "NAME_ONLY_THRESHOLD": [0.8, 0.85, 0.88, 0.9, 0.92, 0.95, 0.98, 1.01],
    "ADDR_ONLY_CONT": [0.8, 0.9, 0.95, 1.0, 1.01],
    "ADDR_ONLY_IDF": [15, 20, 25, 30, 40, 60],
    "RELATIVE_MARGIN": [0.05, 0.1, 0.15, 0.2, 0.3, 1.0],
}
DECISION_GRID: dict[str, list[float]] = {
    "MATCH_THRESHOLD": [round(0.2 + 0.05 * k, 2) for k in range(15)],
    "RELATIVE_MARGIN": [0.05, 0.1, 0.2, 0.3, 0.5, 1.0],
}

# Words that normalization knows.
HONORIFICS = "shri sri shree sree shrii srii smt mr mrs ms dr the messrs mess".split()
LEGAL = "inc incorporated llc ltd limited pvt private corp corporation co company llp pc plc lp pllc india opc dba".split()
LEGAL_SKELETONS_EXTRA = "pr l lmtd prvt".split()
ABBREVIATIONS = ["m s", "l l c", "l l p", "p c"]
TOP_LEVEL_DOMAINS = "com c0m net org in co io biz info us".split()
STREET = {
    "street": "st", "str": "st", "avenue": "ave", "av": "ave", "road": "rd", "drive": "dr", "lane": "ln", "court": "ct",
    "boulevard": "blvd", "place": "pl", "trail": "trl", "highway": "hwy", "parkway": "pkwy", "circle": "cir", "terrace": "ter",
    "square": "sq", "mount": "mt", "saint": "st", "north": "n", "south": "s", "east": "e", "west": "w", "nagar": "ngr",
    "marg": "rd", "sector": "sec", "county": "cty", "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th",
}
ADDRESS_NOISE = (
    "unit apt apartment suite ste fl floor po box pmb no h hno null none nr near opp city of town township bldg the and c o"
    " flat shop plot door usa us india"
).split()
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut",
    "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa",
    "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire",
    "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio",
    "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota",
    "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia",
    "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia",
}
INDIA_STATES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ct": "chhattisgarh",
    "ga": "goa", "gj": "gujarat", "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala",
    "mp": "madhya pradesh", "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland", "od": "odisha",
    "or": "orissa", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu", "tg": "telangana", "ts": "telangana",
    "tr": "tripura", "up": "uttar pradesh", "uk": "uttarakhand", "ut": "uttarakhand", "wb": "west bengal", "dl": "delhi",
    "jk": "jammu and kashmir", "ch": "chandigarh", "py": "puducherry", "la": "ladakh",
}
STATE_ALIASES = ["tamilnadu", "uttaranchal"]

STATE_CODES = sorted(US_STATES.keys() | INDIA_STATES.keys())
#: Longest first, so that a name is not cut by a shorter one inside it.
STATE_NAMES = sorted({*US_STATES.values(), *INDIA_STATES.values(), *STATE_ALIASES}, key=lambda s: (-len(s), s))
