"""Text rules as Column -> Column functions; everything here runs inside the JVM.

There are several normal forms, on purpose, and they are not interchangeable:

* name_key: folded over all of Unicode, everything but letters, digits and _ a single space;
* tag_key: lower case and decomposed, but not case-folded (ß stays), keeps - and _;
* plain_key: folded (compatibility decomposition, case folding, no combining marks), nothing else;
* loose_key: lower case, punctuation to spaces, untrimmed, accents kept;
* search_tokens: lower case, no accents, split at everything but letters and digits (also _).
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.vocabulary import ARTICLES, BLANK_WORDS, FACETS, FAMILIES_BY_TYPE, MAX_FACETS, PLACE_TYPES, PROPER_NOUN_TYPES, STOP_WORDS

SPACE = r"[\s ]+"


def _accent_pairs() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one base letter and marks, and those letters."""
    found = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            found.append((chr(code), base))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


ACCENTED, PLAIN = _accent_pairs()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often and deep body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_accents(c: Column | str) -> Column:
    bare = F.regexp_replace(F.translate(col(c), ACCENTED, PLAIN), r"\p{M}+", "")
    return F.when(F.octet_length(col(c)) == F.length(col(c)), col(c)).otherwise(bare)  # ASCII has none


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


#: The syllables of Hangul are letters by rule: their parts follow from the code point.
HANGUL = 0xAC00
LEADS, VOWELS, TAILS = ("".join(chr(first + i) for i in range(n)) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28)))


@cache
def _folds(cased: bool) -> tuple[str, str, str, str]:
    """(letters that fold to one or to nothing, what to; letters that fold to several, what to, split by spaces), by unicodedata.

    If cased, of texts in lower case, which leaves the capitals out: the tables stand in every plan that folds, so they are to be small. Those that fold to nothing come last, as translate drops letters that have no partner.
    """
    one, none, many = [], [], []
    for code in (*range(0x80, HANGUL), *range(HANGUL + 11172, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0100, 0xE01F0)):
        letter = chr(code)
        plain = unicodedata.normalize("NFKD", letter)
        plain = "".join(x for x in (plain.casefold() if cased else plain) if not unicodedata.combining(x))
        if plain != letter and not (cased and letter.lower() != letter and len(letter.lower()) == 1):
            (none if not plain else one if len(plain) == 1 else many).append((letter, plain))
    spaces = "\x00"  # a letter may fold to a space and a mark
    return "".join(a for a, _ in one + none), "".join(b for _, b in one), "".join(a for a, _ in many), " ".join(b.replace(" ", spaces) for _, b in many)


def folded(c: Column | str, cased: bool = True) -> Column:
    """Compatibility decomposition without combining marks, and, if cased, Unicode's case folding; on every letter as unicodedata has it.

    One letter for one is a translation of the text; only texts that hold a letter that becomes several are gone through letter by letter.
    """
    one, to, many, parts = _folds(cased)
    table = F.split(F.lit(parts), " ")  # folded to an array once, as it is constant

    def spread(x: Column) -> Column:
        at = F.ascii(x) - HANGUL
        jamo = F.concat(F.substr(F.lit(LEADS), F.floor(at / 588).cast("int") + 1, F.lit(1)), F.substr(F.lit(VOWELS), F.floor(at % 588 / 28).cast("int") + 1, F.lit(1)), F.when(at % 28 > 0, F.substr(F.lit(TAILS), at % 28 + 1, F.lit(1))).otherwise(""))
        known = let(F.instr(F.lit(many), x), lambda i: F.when(i > 0, F.replace(F.get(table, i - 1), F.lit("\x00"), F.lit(" "))).otherwise(x))
        return F.when(F.octet_length(x) == 1, x).when((at >= 0) & (at < 11172), jamo).otherwise(known)

    def each(bare: Column) -> Column:
        some = bare.rlike("[\uac00-\ud7a3]") | (F.translate(bare, many, "") != bare)
        return F.when(some, F.array_join(F.transform(F.split(bare, ""), spread), "")).otherwise(bare)

    low = F.lower(col(c)) if cased else col(c)
    return F.when(F.octet_length(col(c)) == F.length(col(c)), low).otherwise(let(F.translate(low, one, to), each))


def plain_key(c: Column | str) -> Column:
    return folded(c)


def name_key(c: Column | str) -> Column:
    """The lookup key of names, in every script. Marks that aren't combining ones (vowel signs of Indic scripts) part words, as they are no letters; so do letters that are newer than the JVM's Unicode."""
    return F.trim(F.regexp_replace(plain_key(c), r"[^\p{L}\p{N}_]+", " "))


def handle_key(c: Column | str) -> Column:
    """name_key of a name that may be an account's handle."""
    return name_key(F.regexp_replace(col(c), "^@+", ""))


def tag_key(c: Column | str) -> Column:
    kept = F.regexp_replace(folded(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), cased=False), r"[^\p{L}\p{N}_\s-]", " ")
    return squeeze(kept)


def loose_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}_]+", " ")


def search_tokens(c: Column | str) -> Column:
    """The full-text tokens of a text, in order; empty for null."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    ascii = F.octet_length(low) == F.length(low)
    parts = F.when(ascii, F.split(low, "[^a-z0-9]+")).otherwise(F.split(without_accents(low), r"[^\p{L}\p{N}]+"))
    return F.filter(parts, lambda t: t != "")


def contains_words(text: Column, name: Column) -> Column:
    """Whether name's key stands in text's key as whole words; an empty name stands nowhere."""
    key = name_key(name)
    return (key != "") & F.concat(F.lit(" "), name_key(text), F.lit(" ")).contains(F.concat(F.lit(" "), key, F.lit(" ")))


def attested(sources: Column, name: Column) -> Column:
    """Whether the lower-cased name stands literally in the lower-cased sources; an empty name counts as attested."""
    needle = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (needle == "") | F.lower(sources).contains(needle)


def without_articles(c: Column) -> Column:
    """Words of the name key without articles."""
    return F.filter(F.split(name_key(c), " "), lambda t: (t != "") & ~t.isin(*ARTICLES))


def near_literal(text: Column, name: Column) -> Column:
    """Whether a name of two words or more stands in text once articles are left out of both."""
    words = without_articles(name)
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(words) >= 2) & pad(without_articles(text)).contains(pad(words))


def fragments(value: Column) -> Column:
    return F.filter(F.split(F.lower(F.replace(value, F.lit(","), F.lit(" "))), SPACE), lambda f: F.length(f) > 3)


def attested_value(value: Column, context: Column) -> Column:
    """value if at least half of its fragments of over 3 characters (one at least) are in context, or, without any, itself; else null."""
    bare, source = F.trim(F.coalesce(value, F.lit(""))), F.lower(context)
    parts = fragments(bare)
    hits = F.size(F.filter(parts, lambda f: source.contains(f)))
    enough = F.when(F.size(parts) == 0, source.contains(F.lower(bare))).otherwise(hits >= F.greatest(F.lit(1), F.floor(F.size(parts) / 2)))
    return F.when((bare != "") & enough, bare)


def is_price_or_quantity(name: Column) -> Column:
    return F.trim(name).rlike(r"(?iu)^[\p{Nd}.,\s]+(?:€|\$|¥|yens?|euros?|dollars?|ml|cl|l|kg|g|%)?$")


def is_common_noun(name: Column, kind: Column | None = None) -> Column:
    """A name with a cased letter and none in upper case, where the type asks for a proper noun."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    plain = bare.rlike(r"[\p{Ll}\p{Lu}\p{Lt}]") & (bare == F.lower(bare))
    return plain if kind is None else plain & F.coalesce(kind.isin(*PROPER_NOUN_TYPES), F.lit(True))


def split_names(name: Column) -> Column:
    """The names run together in one, at | / ; or a spaced middle dot; pieces of one character go."""
    pieces = F.filter(F.transform(F.split(name, r"\s*[|/;]\s*|\s+·\s+"), lambda p: F.trim(p)), lambda p: F.length(p) > 1)
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.trim(name)))


def clean_name(name: Column) -> Column:
    """A handle's words with their first letters raised; other names only trimmed."""
    bare = F.trim(name)
    words = F.filter(F.split(F.regexp_replace(bare, "^@+", ""), "[._]+"), lambda w: w != "")
    raised = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(~bare.startswith("@") | (raised == ""), bare).otherwise(raised)


def blank_to_null(value: Column) -> Column:
    bare = F.trim(value)
    return F.when((bare != "") & ~F.lower(bare).isin(*BLANK_WORDS), bare)


def clean_locality(value: Column) -> Column:
    bare = F.trim(value)
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    return F.when((F.length(bare) >= 3) & (commas <= 2) & ~bare.rlike(r"(?i)\b\d+[.,]?\d*\s*(m|km|mi|ft)\b"), bare)


def place_only(kind: Column, value: Column) -> Column:
    """value where the type is a place's, else null: for scales, cities and localities."""
    return F.when(kind.isin(*PLACE_TYPES), value)


def city_for(kind: Column, city: Column, country: Column) -> Column:
    same = F.coalesce((F.trim(city) != "") & (F.lower(F.trim(city)) == F.lower(F.trim(country))), F.lit(False))
    return F.when(~same, place_only(kind, city))


def scale_for(kind: Column, scale: Column) -> Column:
    return place_only(kind, F.when(scale == "street", F.lit("site")).otherwise(scale))


def facets_for(kind: Column, facets: Column) -> Column:
    """The first facets, without repeats, of families that mean something for the type."""
    allowed = F.create_map(*[x for t, fams in FAMILIES_BY_TYPE.items() for x in (F.lit(t), F.array(*[F.lit(f) for fam in fams for f in FACETS[fam]]))])
    every = F.array(*[F.lit(f) for fam in FACETS.values() for f in fam])
    mine = F.coalesce(allowed[kind], every)
    return F.slice(F.filter(F.array_distinct(facets), lambda f: F.array_contains(mine, f)), 1, MAX_FACETS)


def long_words(c: Column) -> Column:
    return F.filter(F.split(tag_key(c), " "), lambda w: F.length(w) > 3)


def useful_tags(tags: Column, known: list[Column], facets: Column) -> Column:
    """Up to 3 normalised tags that share no word of over 3 characters with the known fields or facets."""
    said = F.concat(*[long_words(k) for k in known], F.flatten(F.transform(facets, lambda f: long_words(f))))
    new = F.filter(F.transform(tags, lambda t: tag_key(t)), lambda t: (t != "") & ~F.arrays_overlap(F.filter(F.split(t, " "), lambda w: F.length(w) > 3), said))
    return F.slice(F.array_distinct(new), 1, 3)


def distinct_tags(tags: Column, most: int = 5) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: tag_key(t)), lambda t: t != "")), 1, most)


def key_points(points: Column, most: int = 8) -> Column:
    """The first points, squeezed, one for each lower-cased spelling."""
    clean = F.filter(F.transform(points, lambda p: squeeze(p)), lambda p: p != "")
    keys = F.transform(clean, lambda p: F.lower(p))
    return F.slice(F.filter(clean, lambda p, i: F.array_position(keys, F.lower(p)) == i + 1), 1, most)


def ratio_of_percent(value: Column) -> Column:
    return F.when((value > 1) & (value <= 100), value / 100).otherwise(value)


def unknown_facets(facets: Column) -> Column:
    """Facets outside the vocabulary, which become tags."""
    return F.array_except(facets, F.array(*[F.lit(f) for fam in FACETS.values() for f in fam]))


def maps_url(*parts: Column, base: str = "https://www.google.com/maps/search/?api=1&query=") -> Column:
    return F.concat(F.lit(base), F.url_encode(F.concat_ws(" ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])))


def fingerprint(value: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(value, 256), 1, digits)


def question_terms(question: Column, most: int = 6) -> Column:
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)), 1, most)


def title(text: Column, size: int = 72) -> Column:
    bare = squeeze(text)
    return F.when(F.length(bare) > size, F.concat(F.substring(bare, 1, size), F.lit("…"))).otherwise(bare)


def preview(text: Column, size: int = 80) -> Column:
    return F.replace(F.substring(F.coalesce(text, F.lit("")), 1, size), F.lit("\n"), F.lit(" "))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3).cast("long")


def iso_date(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date"))


def string_array(json: Column) -> Column:
    """The non-blank strings of a JSON array; empty for null or anything else."""
    return F.filter(F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>")), lambda s: F.trim(s) != "")


def content_key(digest: Column, suffix: str = "") -> Column:
    return F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(suffix))


def lowered_sources(*parts: Column) -> Column:
    return F.concat_ws(" \n ", *[F.when(p != "", F.lower(p)) for p in parts])


def repeated_brand(name: Column, kind: Column) -> Column:
    """BRAND of 'BRAND BRAND home shopping', for shops; else null."""
    parts = F.split(F.trim(name), SPACE)
    first = F.try_element_at(parts, F.lit(1))
    fits = (kind == "shop") & (F.size(parts) == 4) & (first == F.upper(first)) & first.rlike(r"\p{Lu}") & (first == F.try_element_at(parts, F.lit(2)))
    return F.when(fits & (F.lower(F.array_join(F.slice(parts, 3, 2), " ")) == "home shopping"), F.concat_ws(" ", first, first))


def adaptive_fps(seconds: Column, frames: int, least: float, most: float) -> Column:
    """Frames a second such that about frames are taken, within bounds."""
    return F.when(seconds > 0, F.least(F.greatest(F.lit(frames) / seconds, F.lit(least)), F.lit(most))).otherwise(F.lit(most))
