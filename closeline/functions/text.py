"""Text normalisation: identity values, names, selections, type labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from closeline.functions.prices import col

_NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NULL_WORDS = ("nan", "none", "<na>")

# Words without identity, one-reading and many-reading abbreviations.
NOISE_WORDS = ("university", "univ", "college", "the")
EXPANSIONS = {"cent": "central", "mt": "mount", "ft": "fort", "intl": "international", "univ": "university"}
AMBIGUOUS = {
    "st": ("state", "saint"),
    "n": ("north", "northern"),
    "s": ("south", "southern"),
    "e": ("east", "eastern"),
    "w": ("west", "western"),
    "se": ("southeast", "southeastern"),
    "sw": ("southwest", "southwestern"),
    "ne": ("northeast", "northeastern"),
    "nw": ("northwest", "northwestern"),
    "csu": ("cal state", "colorado state", "cleveland state"),
    "so": ("south", "southern"),
}
MAX_AMBIGUOUS = 4
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
MAX_READINGS = 64
MAX_HYPHENATED = 2


def _number_text(n: Column) -> Column:
    """A double as text; whole numbers lose the point."""
    whole = (n == F.floor(n)) & (F.abs(n) < 9.0e18)
    return F.when(whole, n.cast("long").cast("string")).otherwise(n.cast("string"))


def canonical_value(c: Column | str, kind: T.DataType | None = None) -> Column:
    """'1', 1.0 and ' 1 ' become '1'; null-like text becomes ''.

    ``kind`` is the column's type where it is known: whole numbers and doubles then
    skip the text rules, which keeps the generated code small.
    """
    value = col(c)
    if isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return F.coalesce(value.cast("string"), F.lit(""))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(value.isNull() | F.isnan(value), F.lit("")).otherwise(_number_text(value.cast("double")))
    text = F.trim(value.cast("string"))
    return canonical_text(text, numeric_text(text))


def numeric_text(text: Column) -> Column:
    """The number a text spells, or null. (Suffixes such as '1d' are not numbers.)"""
    return F.when(text.rlike(_NUMERIC), text.try_cast("double"))


def canonical_text(text: Column, parsed: Column) -> Column:
    """Canonical form from a trimmed text and the number it spells."""
    return F.when(text.isNull() | F.lower(text).isin(*_NULL_WORDS), F.lit("")).when(parsed.isNull(), text).otherwise(_number_text(parsed))


def canonical_texts(columns: Sequence[Column | str]) -> Column:
    """Canonical forms of several text columns, as an array in their order.

    One rule for all elements instead of one per column: many columns make a generated
    method too long for the JVM to compile, and each row then costs tens of microseconds.
    """
    return F.transform(F.array(*[F.trim(col(c)) for c in columns]), lambda x: canonical_text(x, numeric_text(x)))


def normalise_subject(c: Column | str) -> Column:
    return F.lower(canonical_value(c))


def clean_text(c: Column | str) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.when(text.isNull() | (F.lower(text) == "nan"), F.lit("")).otherwise(text)


def truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "1.0", "yes", "y", "t"), F.lit(False))


def letters_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z]", "")


def _folds() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatibility decomposition is one ASCII letter plus marks, and those that become several."""
    one, several = {}, {}
    for code in range(0x80, 0x10000):
        ch = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        folded = plain.casefold()
        if plain == ch and folded in (ch, ch.lower()):
            continue
        if folded.isascii() and folded:
            (one if len(folded) == 1 else several)[ch] = plain if len(plain) == 1 else folded
    several["ß"], several["ẞ"] = "ss", "ss"
    return "".join(one), "".join(one.values()), several


_MARKED, _PLAIN, _SEVERAL = _folds()


def fold_accents(c: Column | str) -> Column:
    """Marks removed and letters folded to ASCII over all text, in the JVM.

    Text that is ASCII already, the usual case, is returned as it is.
    """
    text = col(c)
    bare = F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{M}+", "")
    table = F.create_map(*[F.lit(x) for pair in sorted(_SEVERAL.items()) for x in pair])
    wide = F.array_join(F.transform(F.split(bare, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    spelled = F.when(bare.rlike("[^\\x00-\\x7F]"), wide).otherwise(bare)
    return F.when(text.rlike("[^\\x00-\\x7F]"), spelled).otherwise(text)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def normalise_name(c: Column | str) -> Column:
    """Team name reduced to identity: no marks, case, punctuation, noise words."""
    text = F.regexp_replace(F.lower(fold_accents(F.coalesce(col(c).cast("string"), F.lit("")))), "[^a-z0-9 ]+", " ")
    text = F.regexp_replace(text, r"\b(?:" + "|".join(NOISE_WORDS) + r")\b", " ")
    table = F.create_map(*[F.lit(x) for pair in EXPANSIONS.items() for x in pair])
    joined = F.array_join(F.transform(_words(text), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    return F.when(joined == "nan", F.lit("")).otherwise(joined)


def _ambiguous_words(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*AMBIGUOUS)))


def excess_team_readings(c: Column | str) -> Column:
    """True where a team name has more ambiguous words than are spelled out."""
    return _ambiguous_words(_words(normalise_name(c))) > MAX_AMBIGUOUS


def name_variants(c: Column | str) -> Column:
    """Every reading of a team name, as an array of text (at most 3**4 of them)."""
    base = normalise_name(c)
    words = _words(base)
    table = F.create_map(*[
        x for word, readings in AMBIGUOUS.items()
        for x in (F.lit(word), F.array(*[F.lit(r) for r in readings]))
    ])

    def grow(forms: Column, word: Column) -> Column:
        choices = F.concat(F.array(word), F.coalesce(F.try_element_at(table, word), F.array().cast("array<string>")))
        return F.flatten(F.transform(forms, lambda f: F.transform(choices, lambda x: F.trim(F.concat(f, F.lit(" "), x)))))

    ambiguous = _ambiguous_words(words)
    grown = F.aggregate(words, F.array(F.lit("")), grow)
    return (
        F.when(base == "", F.array().cast("array<string>"))
        .when((ambiguous == 0) | (ambiguous > MAX_AMBIGUOUS), F.array(base))
        .otherwise(F.array_distinct(grown))
    )


_RUN = r"(?<=\b[a-z0-9]) (?=[a-z0-9]\b)"  # in a run of single letters: "k j adams" is "kj adams"
_MEDIAL = r"(?<=\S) [a-z0-9](?= )"  # a single letter that stands between two words


def _player_words(c: Column, drop_apostrophe: bool) -> Column:
    text = F.lower(fold_accents(c))
    return _letters_words(F.regexp_replace(text, "['’]", "" if drop_apostrophe else " "))


def _letters_words(text: Column) -> Column:
    return F.regexp_replace(_bare_words(text), _RUN, "")


def _bare_words(text: Column) -> Column:
    """Words of letters and digits but suffixes, a space between them. A split at one character needs no pattern."""
    words = F.split(F.regexp_replace(text, "[^a-z0-9 ]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*SUFFIXES)), " ")


def normalise_player(c: Column | str) -> Column:
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(F.lower(F.trim(text)) == "nan", F.lit("")).otherwise(F.trim(_player_words(text, False)))


def _hyphenated(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda w: F.regexp_replace(w, "^-+|-+$", "").contains("-")))


def hyphen_forms(c: Column | str) -> Column:
    """A name with up to two hyphenated words, whole and by halves."""
    parts = _words(col(c))
    hyphenated = _hyphenated(parts)

    def grow(forms: Column, word: Column) -> Column:
        halves = F.filter(F.split(word, "-"), lambda h: h != "")
        choices = F.when(F.regexp_replace(word, "^-+|-+$", "").contains("-"), F.concat(F.array(word), halves)).otherwise(F.array(word))
        return F.flatten(F.transform(forms, lambda f: F.transform(choices, lambda x: F.trim(F.concat(f, F.lit(" "), x)))))

    return F.when((hyphenated == 0) | (hyphenated > MAX_HYPHENATED), F.array(F.array_join(parts, " "))).otherwise(
        F.aggregate(parts, F.array(F.lit("")), grow)
    )


def _unusual(raw: Column) -> Column:
    """Names with what may make several readings: asides, hyphens, apostrophes, letters to fold."""
    return raw.rlike(r"[-'(\"]|[^\x00-\x7F]")


def _player_forms(c: Column | str) -> Column:
    """Other names than unusual ones have one reading and that without medial initials: a few expressions instead of some hundred a row."""
    raw = F.coalesce(col(c).cast("string"), F.lit(""))
    joined = lambda w: F.flatten(F.transform(F.array(F.regexp_replace(w, _RUN, "")), lambda x: F.array_distinct(F.array(x, F.regexp_replace(x, _MEDIAL, "")))))
    usual = F.flatten(F.transform(F.array(_bare_words(F.lower(raw))), lambda w: F.when(w == "", F.array().cast("array<string>")).when(w.rlike(r"\b[a-z0-9]\b"), joined(w)).otherwise(F.array(w))))
    return F.when(_unusual(raw), _all_player_forms(raw)).otherwise(usual)


def _all_player_forms(raw: Column) -> Column:
    bare = F.regexp_replace(raw, r"\([^)]*\)|\"[^\"]*\"|“[^”]*”", " ")
    bases = F.filter(F.array(raw, bare), lambda b: F.trim(b) != "")
    spelled = F.flatten(F.transform(bases, hyphen_forms))
    words = F.flatten(F.transform(spelled, lambda s: F.array(_player_words(s, False), _player_words(s, True))))
    both = F.flatten(F.transform(words, lambda w: F.array(w, F.regexp_replace(w, _MEDIAL, ""))))
    return F.filter(F.array_distinct(F.transform(both, lambda w: F.trim(F.regexp_replace(w, r"\s+", " ")))), lambda w: w != "")


def excess_player_readings(c: Column | str) -> Column:
    """True where a player name has more readings, or hyphenated words, than are kept."""
    raw = F.coalesce(col(c).cast("string"), F.lit(""))
    return _unusual(raw) & ((_hyphenated(_words(raw)) > MAX_HYPHENATED) | (F.size(_all_player_forms(raw)) > MAX_READINGS))


def player_variants(c: Column | str) -> Column:
    """Readings of a player name: asides, hyphens, apostrophes, medial initials."""
    raw = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(F.lower(F.trim(raw)) == "nan", F.array().cast("array<string>")).otherwise(F.slice(_player_forms(c), 1, MAX_READINGS))


def player_abbreviations(c: Column | str) -> Column:
    """Readings with the first name cut to its initial."""
    return _abbreviated(player_variants(c))


def player_forms(c: Column | str) -> Column:
    """Readings, and those with the first name cut; the readings are worked out once."""
    return F.flatten(F.transform(F.array(player_variants(c)), lambda forms: F.array_union(forms, _abbreviated(forms))))


def _abbreviated(forms: Column) -> Column:
    usable = F.filter(forms, lambda f: F.instr(f, " ") > 2)
    return F.array_distinct(F.transform(usable, lambda f: F.concat(F.substring(f, 1, 1), F.substr(f, F.instr(f, " ")))))


def team_selection(outcome: Column | str, home: Column | str, away: Column | str) -> Column:
    name = clean_text(outcome)
    return F.when(name == "", None).when(name == clean_text(home), "home").when(name == clean_text(away), "away")


def over_under_selection(outcome: Column | str) -> Column:
    name = F.lower(clean_text(outcome))
    return F.when(name.isin("over", "o"), "over").when(name.isin("under", "u"), "under")


def yes_no_selection(outcome: Column | str) -> Column:
    name = F.lower(clean_text(outcome))
    return F.when(name == "yes", "over").when(name == "no", "under")


def team_total_selection(outcome: Column | str, description: Column | str, home: Column | str, away: Column | str) -> Column:
    side = over_under_selection(outcome)
    school = clean_text(description)
    return F.when(school == clean_text(home), F.concat(F.lit("home_"), side)).when(
        school == clean_text(away), F.concat(F.lit("away_"), side)
    )
