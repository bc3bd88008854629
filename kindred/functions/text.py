"""Names and addresses in comparable form, as column expressions that stay in the JVM."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

# Letters whose plain form Unicode's decompositions do not give.
SPECIAL_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ı": "i"}
# The usual Latin spellings of Greek and Cyrillic letters, of signs, and of kana that are not said as they are named.
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
CYRILLIC = dict(zip(
    "абвгдежзийклмнопрстуфхцчшщъыьэюяєіїґђјљњћџѓќўё", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia e i i g d j lj nj ts dz g k u io".split(), strict=True
))
SIGNS = {"©": "(c)", "®": "(r)", "™": "(tm)", "€": "eur", "£": "ps", "¥": "y=", "°": "deg", "×": "x", "÷": "/", "«": "<<", "»": ">>", "¡": "!", "¿": "?", "µ": "u", "·": "*", "•": "*"}
KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}
NON_LATIN_LETTER = r"[\p{L}&&[^\p{IsLatin}]]"
INDIC = r"[ऀ-ൿ]"
SCRIPT_TOKEN = r"[^\s\x{A0},()\[\]/.&+\-]+"


@functools.cache
def indic_letters() -> dict[str, str]:
    """Latin spellings of Indic letters, from their Unicode names: consonants lose the inherent a."""
    out = {}
    for code in range(0x900, 0xD80):
        name = unicodedata.name(chr(code), "")
        m = re.search(r"(?:LETTER|VOWEL SIGN) ((?:VOCALIC )?[A-Z]+)$", name)
        if unicodedata.decimal(chr(code), None) is not None:
            out[chr(code)] = str(unicodedata.decimal(chr(code)))
        elif re.search(r"SIGN (ANUSVARA|CANDRABINDU|BINDI|TIPPI)$", name):
            out[chr(code)] = "n"
        elif name.endswith("SIGN VISARGA"):
            out[chr(code)] = "h"
        elif m:
            spelt = m[1].removeprefix("VOCALIC ").lower()
            consonant = "VOWEL" not in name and spelt[0] not in "aeiou" and spelt.endswith("a")
            out[chr(code)] = spelt[:-1] if consonant else spelt
    return out


def _spelling(c: str) -> str | None:
    """The ASCII spelling of a character: from the tables, its decomposition, its class or its Unicode name; null if none tells."""
    low = c.lower()
    name = unicodedata.name(c, "")
    kana = re.match(r"(?:HIRAGANA|KATAKANA) LETTER (?:SMALL )?([A-Z]+)$", name)  # before marks go: they change the sound
    if kana:
        return KANA.get(kana[1].lower(), kana[1].lower())
    plain = "".join(x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x))
    for table in (SPECIAL_LETTERS, SIGNS, CYRILLIC, GREEK):
        if low in table:
            return table[low]
    if plain and plain != low:
        parts = [x if x.isascii() else _spelling(x) for x in plain]
        return None if None in parts else "".join(parts).lower()
    kind = unicodedata.category(c)
    if kind == "Pd":
        return "-"
    if kind[0] == "Z" or kind in ("Sm", "Sk", "Sc"):
        return " "
    if kind[0] == "P":
        return "'" if kind in ("Pi", "Pf") else " "
    letter = re.match(r"(?:HEBREW|ARABIC|ARMENIAN|GEORGIAN) (?:CAPITAL |SMALL )?LETTER (?:FINAL )?([A-Z]+)", name)
    if letter:  # a letter is spelt as its name begins
        return re.match(r"SH|CH|TS|TH|DH|KH|GH|ZH|PH|.", letter[1])[0].lower()
    return None


@functools.cache
def spellings() -> dict[str, str]:
    """Lower-case ASCII spellings of the characters of Latin, Greek, Cyrillic, Hebrew, Arabic, Armenian, Georgian, Indic scripts and kana, and of punctuation."""
    out = {}
    for low, high in ((0x80, 0x700), (0x10A0, 0x1100), (0x1E00, 0x2000), (0x2000, 0x2C00), (0x3000, 0x3100), (0xFB00, 0xFB07), (0xFF01, 0xFFA0)):
        for code in range(low, high):
            spelt = _spelling(chr(code))
            if spelt is not None:
                out[chr(code)] = spelt
    return out | indic_letters()


#: Characters without a meaning of their own, which stand for spellings of several letters.
_PRIVATE = 0xE000


@functools.cache
def _tables() -> tuple[str, str, str]:
    """Characters and what ``translate`` makes of them, one for one, and the spellings of several letters, by private character."""
    table = spellings()
    several = sorted({x for x in table.values() if len(x) > 1})
    code = {x: chr(_PRIVATE + i) for i, x in enumerate(several)}
    kept = [(c, x if len(x) == 1 else code[x]) for c, x in sorted(table.items()) if x]
    gone = "".join(c for c, x in sorted(table.items()) if not x)
    return "".join(c for c, _ in kept) + gone, "".join(x for _, x in kept), "\t".join(several)


# The Latin spellings of the parts of Hangul syllables, in the order of Unicode.
HANGUL = (
    "g gg n d dd r m b bb s ss  j jj c k t p h".split(" "), "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i".split(" "),
    " g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h".split(" "),
)


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv))


def to_ascii(s: Column) -> Column:
    """A text in lower-case ASCII.  Null is empty.

    Letters with marks lose them, letters of other scripts are spelt (see ``spellings``;
    Hangul by its parts), punctuation becomes ASCII punctuation or a space.  What has no
    spelling by rule, Han above all, goes.
    """
    s = F.coalesce(s, F.lit(""))
    source, target, several = _tables()
    plain = F.lower(F.translate(F.regexp_replace(s, r"[\x{E000}-\x{F8FF}]", ""), source, target))
    names, number = F.split(F.lit(several), "\t"), F.ascii
    lead, vowel, tail = (F.split(F.lit("\t".join(x)), "\t") for x in HANGUL)

    def spelt(c: Column) -> Column:
        at = number(c) - 0xAC00
        syllable = F.concat(F.get(lead, F.floor(at / 588).cast("int")), F.get(vowel, F.floor((at % 588) / 28).cast("int")), F.get(tail, (at % 28).cast("int")))
        return F.when(c.between("\ue000", "\uf8ff"), F.get(names, number(c) - _PRIVATE)).when(c.between("가", "힣"), syllable).otherwise(c)

    whole = F.when(plain.rlike(r"[\x{E000}-\x{F8FF}가-힣]"), F.array_join(F.transform(F.split(plain, ""), spelt), "")).otherwise(plain)
    return F.when(s.rlike(r"^[\x00-\x7F]*$"), F.lower(s)).otherwise(F.regexp_replace(whole, r"[^\x00-\x7F]", ""))


def is_latin(s: Column) -> Column:
    """Whether every letter is Latin."""
    return ~F.coalesce(s, F.lit("")).rlike(NON_LATIN_LETTER)


def has_indic(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike(INDIC)


def skeleton(t: Column) -> Column:
    """A rough phonetic key: the first letter, then no vowels, y or h, and no doubles."""
    for sound, letter in (("ph", "f"), ("w", "v"), ("sh", "s"), ("z", "j")):
        t = F.replace(t, F.lit(sound), F.lit(letter))
    kept = F.concat(F.left(t, F.lit(1)), F.regexp_replace(F.substr(t, F.lit(2)), "[aeiouyh]", ""))
    return F.regexp_replace(kept, r"(.)\1+", "$1")


def fix_leet(t: Column) -> Column:
    """Digits that stand for letters, in tokens with both."""
    return F.when(t.rlike("[a-z]") & t.rlike("[0-9]"), F.translate(t, "013457", "oieast")).otherwise(t)


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, "[^a-z0-9]+"), lambda t: t != "")


def script_tokens(s: Column) -> Column:
    """Tokens in any script, for learning and using the dictionary."""
    return F.regexp_extract_all(s, F.lit(SCRIPT_TOKEN), F.lit(0))


def translate_indic(s: Column, dictionary: Column | None) -> Column:
    """Known Indic tokens replaced by their English ones; ``dictionary`` is a map column or null."""
    if dictionary is None:
        return s
    pieces = F.regexp_extract_all(s, F.lit(rf"{SCRIPT_TOKEN}|[\s\x{{A0}},()\[\]/.&+\-]+"), F.lit(0))
    return F.when(has_indic(s), F.array_join(F.transform(pieces, lambda p: F.coalesce(dictionary[p], p)), "")).otherwise(s)


def country_code(c: Column) -> Column:
    return F.substring(F.lower(c), 1, 2)


def domain_stem(s: Column) -> Column:
    """The stem of a website-style name, or empty."""
    tlds = "|".join(config.TOP_LEVEL_DOMAINS)
    pattern = rf"^(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:{tlds})(?:\.[a-z]{{2}})?\b"
    return F.when(F.contains(s, F.lit(".")), F.regexp_extract(F.replace(s, F.lit(" "), F.lit("")), pattern, 1)).otherwise("")


def spell_signs(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" "))


def strip_long_digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\b\d{6,}\b", " ")


def merge_abbreviations(ts: Column) -> Column:
    """Abbreviations spelled in single letters become one token."""
    joined = F.array_join(ts, " ")
    for spaced in config.ABBREVIATIONS:
        joined = F.regexp_replace(joined, rf"\b{spaced}\b", spaced.replace(" ", ""))
    return F.filter(F.split(joined, " "), lambda t: t != "")


def drop_stopwords(ts: Column) -> Column:
    stop = [*config.HONORIFICS, *config.LEGAL, "and"]
    return F.filter(ts, lambda t: ~t.isin(stop))


def legal_skeletons() -> list[str]:
    def plain(t: str) -> str:
        for sound, letter in (("ph", "f"), ("w", "v"), ("sh", "s"), ("z", "j")):
            t = t.replace(sound, letter)
        return re.sub(r"(.)\1+", r"\1", t[:1] + re.sub("[aeiouyh]", "", t[1:]))

    return sorted({plain(w) for w in config.LEGAL} | set(config.LEGAL_SKELETONS_EXTRA))


def drop_legal_skeletons(ts: Column) -> Column:
    known = legal_skeletons()
    return F.filter(ts, lambda t: ~skeleton(t).isin(known))


def drop_long_numbers(ts: Column) -> Column:
    return F.filter(ts, lambda t: ~t.rlike("^[0-9]{4,}$"))


def drop_repeats(ts: Column) -> Column:
    """No token equal to the one before it."""
    return F.filter(ts, lambda t, i: (i == 0) | (t != F.get(ts, i - 1)))


def normalize_names(df: DataFrame, raw: str, dictionary: Column | None = None) -> DataFrame:
    """Adds ``n_tokens, n_core, n_compact, n_skel, n_domain, n_translit``.  Null names are empty."""
    text = F.coalesce(F.col(raw), F.lit(""))
    df = df.withColumns({"n_translit": ~is_latin(text), "__s": F.trim(to_ascii(translate_indic(text, dictionary)))})
    df = df.withColumn("__stem", domain_stem(F.col("__s")))
    df = df.withColumn("n_domain", F.col("__stem") != "")
    plain = F.when(F.col("n_domain"), F.col("__stem")).otherwise(F.col("__s"))
    df = df.withColumn("__all", F.transform(tokens(strip_long_digits(spell_signs(plain))), fix_leet))
    df = df.withColumn("__all", merge_abbreviations(F.col("__all")))
    df = df.withColumn("__kept", drop_stopwords(F.col("__all")))
    df = df.withColumn("__kept", F.when(F.col("n_translit"), drop_legal_skeletons(F.col("__kept"))).otherwise(F.col("__kept")))
    df = df.withColumn("__kept", drop_long_numbers(F.col("__kept")))
    df = df.withColumn("__kept", drop_repeats(F.col("__kept")))
    left = F.slice(F.filter("__all", lambda t: t != "and"), 1, 3)
    df = df.withColumn("n_tokens", F.when(F.size("__kept") == 0, left).otherwise(F.col("__kept")))
    return df.withColumns({
        "n_core": F.array_join("n_tokens", " "), "n_compact": F.array_join("n_tokens", ""),
        "n_skel": F.array_join(F.transform("n_tokens", skeleton), " "),
    }).drop("__s", "__stem", "__all", "__kept")


def drop_non_latin(s: Column) -> Column:
    """Without the pieces (between white space and commas) that have a non-Latin letter."""
    piece = r"[^\s\x{A0},]*"
    return F.regexp_replace(F.coalesce(s, F.lit("")), piece + NON_LATIN_LETTER + piece, "")


def drop_states(s: Column) -> Column:
    return F.regexp_replace(s, rf"\b(?:{'|'.join(config.STATE_NAMES)})\b", " ")


def address_number(t: Column) -> Column:
    """The digits of a token without leading zeros; null if it has none."""
    digits = F.regexp_replace(t, "[^0-9]", "")
    return F.when(digits != "", F.regexp_replace(digits, "^0+(?=.)", ""))


def address_word(t: Column) -> Column:
    """The word that a token gives, or null."""
    street = _lookup(config.STREET)
    letters = F.regexp_replace(t, "[0-9]", "")
    mixed = F.when(t.rlike("^[0-9]+$") | t.rlike("^[0-9]+(st|nd|rd|th)$"), None).when(
        t.rlike("[0-9]"), F.when(F.length(letters) >= 2, letters)
    ).otherwise(t)
    told = F.when(~mixed.isin([*config.STATE_CODES, *config.ADDRESS_NOISE]), mixed)
    short = F.coalesce(street[told], told)
    return F.when((F.length(short) >= 2) | short.isin(["n", "s", "e", "w"]), short)


def normalize_addresses(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``a_words, a_numbers`` (sorted sets), ``a_text, a_nums`` (joined) and ``a_empty``."""
    df = df.withColumn("__t", tokens(drop_states(to_ascii(drop_non_latin(F.col(raw))))))
    df = df.withColumns({"__w": F.transform("__t", address_word), "__n": F.transform("__t", address_number)})
    ordered = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))
    df = df.withColumns({"a_words": ordered("__w"), "a_numbers": ordered("__n")})
    return df.withColumns({
        "a_text": F.array_join("a_words", " "), "a_nums": F.array_join("a_numbers", " "),
        "a_empty": (F.size("a_words") == 0) & (F.size("a_numbers") == 0),
    }).drop("__t", "__w", "__n")


def normalize_records(df: DataFrame, dictionary: Column | None = None) -> DataFrame:
    """Raw records (entity_id, business_name, business_address, country, and any more) in comparable form."""
    df = normalize_addresses(normalize_names(df, "business_name", dictionary), "business_address")
    return df.withColumn("country", F.coalesce(country_code(F.col("country")), F.lit(""))).drop("business_name", "business_address")
