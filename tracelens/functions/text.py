"""Expressions on text: accents, ordered patterns, first keys, symbols."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelens.functions.reference import ZODIAC

_ACCENTED, _BARE = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def plain(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return bare(F.lower(c))


def bare(low: Column) -> Column:
    """A text in lower case without the accents of Latin letters; one of ASCII characters only has none."""
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _ACCENTED, _BARE))


def titled(c: Column) -> Column:
    """A capital at the beginning of each run of letters, small letters after it."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def unended(c: Column) -> Column:
    """Without blanks around it and dots at its end."""
    return F.rtrim(F.trim(c), F.lit("."))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), then)[0]


def first_key(text: Column, keys: Iterable[str]) -> Column:
    """The first of the keys, in their order, that the text holds; null if none."""
    known = F.array(*map(F.lit, list(keys)))
    return let(text, lambda t: F.try_element_at(F.filter(known, lambda k: F.contains(t, k)), F.lit(1)))


def captured(text: Column, pattern: str, group: int = 1, may: May | None = None) -> Column:
    """A group of the first match, null where there is no match or the group is empty."""
    out = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return out if may is None else F.when(may(pattern), out)


#: Letters that (?iu) takes for i, k and s although lower() leaves them as they are; texts that hold one are searched in any case.
FOLDED = "\u0130\u0131\u017f\u212a"

#: Says of a pattern whether a text may match it.
May = Callable[[str], Column]


def anything(pattern: str) -> Column:
    return F.lit(True)


def pieces_in(low: Column, odd: Column | None = None) -> May:
    """Whether a text in lower case holds one of the pieces of a pattern (PIECES), without which it can't match. Most texts hold none, and
    to look for pieces takes a small part of the time of a search. odd: texts that are searched in any case."""

    def may(pattern: str) -> Column:
        held = reduce(lambda a, b: a | b, (F.contains(low, F.lit(piece)) for piece in PIECES[pattern]))
        return held if odd is None else odd | held

    return may


def is_odd(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in FOLDED))


def ordered(text: Column, patterns: Iterable[tuple[str, str]], may: May = anything) -> Column:
    """The value of the first pattern that the text matches."""
    out = None
    for pattern, value in patterns:
        matches = may(pattern) & text.rlike(pattern)
        out = F.when(matches, value) if out is None else out.when(matches, value)
    return out


# The phrases by which people declare something about themselves.
AGE = r"(?iu)\b(?:tengo|con)\s+(\d{1,2})\s+años\b|\b(\d{1,2})\s+años\b"
SEX = ((r"(?iu)\b(soy un chico|soy un chaval|soy hombre)\b", "hombre"), (r"(?iu)\b(soy una chica|soy mujer)\b", "mujer"))
UNIVERSITY = r"(?iu)\buniversidad de ([\p{L}\p{N}_]+)"
COMPANY = r"\b[Tt]rabajo (?:en|para)\s+([A-Z][\p{L}\p{N}_]+)"
STUDY = r"(?iu)\b(?:estudio|estudiante de|graduad[oa] en)\s+([a-záéíóúñ ]+)"
NATIONALITY = (
    (r"(?iu)\b(soy español|soy española|nacionalidad española|de nacionalidad española)\b", "espanola"),
    (
        r"(?iu)\b(soy extranjer[oa]|nacionalidad extranjera|soy marroqu[ií]|soy colombian[oa]|soy ruman[oa]|soy venezolan[oa]|"
        r"soy peruan[oa]|soy ecuatorian[oa]|soy argentin[oa]|soy bolivian[oa]|soy chin[oa])\b",
        "extranjera",
    ),
)
EMPLOYMENT = (
    (r"(?iu)\b(estoy en paro|desemplead[oa]|buscando empleo|busco trabajo)\b", "parado"),
    (r"(?iu)\b(jubilad[oa]|pensionista)\b", "jubilado"),
    (r"(?iu)\b(soy estudiante|estudiante a tiempo completo)\b", "estudiante"),
    (r"(?iu)\b(trabajo (?:en|de|para|como)|soy autónom[oa]|tengo trabajo)\b", "activo"),
)
LANGUAGE = (
    (r"(?iu)\b(mi lengua materna es el catalán|hablo catalán|catalanoparlante)\b", "catalan"),
    (r"(?iu)\b(mi lengua materna es el euskera|hablo euskera|euskaldun)\b", "euskera"),
    (r"(?iu)\b(mi lengua materna es el gallego|hablo gallego|galegofalante)\b", "gallego"),
    (r"(?iu)\b(mi lengua materna es el valenciano|hablo valenciano)\b", "valenciano"),
)
HOUSEHOLD_SIGNALS = {
    "single_parent": r"(?iu)\b(madre soltera|padre soltero|familia monoparental)\b",
    "alone": r"(?iu)\bvivo sol[oa]\b",
    "partner": r"(?iu)\bvivo con mi (pareja|novio|novia|marido|mujer|esposo|esposa)\b",
    "children": r"(?iu)\bmis? hij[oa]s?\b",
}
LIVES_IN = r"\bvivo en ([a-z ]+)"
ORIENTATION = r"(?iu)\b(?:hetero(?:\s*-?\s*sex(?:ual|uial|uel))?|gay|lesbiana|pansexual|asexual|homosexual|bi\s*-?\s*sexual|bisexu(?:al|uial|uel))\b"
ORIENTATION_KEYS = (("hetero", "heterosexual"), ("gay", "gay"), ("lesbiana", "lesbiana"), ("bisexual", "bisexual"), ("pansexual", "pansexual"), ("asexual", "asexual"), ("homosexual", "homosexual"))
ZODIAC_WORD = r"\b(aries|tauro|geminis|cancer|leo|virgo|libra|escorpio|sagitario|capricornio|acuario|piscis)\b"
RELIGION_SYMBOLS = (("✡", "judaismo"), ("🔯", "judaismo"), ("☪", "islam"), ("✝", "cristianismo"), ("☦", "cristianismo"), ("☸", "budismo"), ("🕉", "hinduismo"), ("ॐ", "hinduismo"), ("📿", "catolicismo"), ("🕊", "cristianismo"))
#: The accepted words and what they stand for.
RELIGION_WORDS = (
    ("judio", "judaismo"), ("judia", "judaismo"), ("musulman", "islam"), ("musulmana", "islam"), ("catolico", "catolicismo"), ("catolica", "catolicismo"), ("cristiano", "cristianismo"), ("cristiana", "cristianismo"),
    ("budista", "budismo"), ("hinduista", "hinduismo"), ("ateo", "ateismo"), ("atea", "ateismo"), ("agnostico", "agnosticismo"), ("agnostica", "agnosticismo"), ("islam", "islam"), ("judaismo", "judaismo"),
)
RELIGION_WORD = rf"\b({'|'.join(w for w, _ in RELIGION_WORDS)})\b"
TRAVEL = r"(?iu)\b(de viaje|de vacaciones|de vacas|de escapada|de paso por|unos d[ií]as en|unas semanas en|turisteando|haciendo turismo|de turismo por|visitando)\b"
ROUTINE = r"(?i)\b(turno de noche|madrugo|salgo del trabajo|entro a las|termino a las|night shift|wfh|trabajo desde casa)\b"
SPANISH_MARKERS = ("que", "de", "la", "el", "en", "y", "los", "se", "un", "por")
EMOJI = "[\U0001f300-\U0001faff☀-➿]"


#: Pieces of which every text in lower case that matches a pattern holds one; those of LIVES_IN and of words stand in plain text.
PIECES = {
    AGE: ("años",), UNIVERSITY: ("universidad de ",), COMPANY: ("rabajo ",), STUDY: ("estudio", "estudiante de", "graduad"), LIVES_IN: ("vivo en ",),
    SEX[0][0]: ("soy un ch", "soy hombre"), SEX[1][0]: ("soy una chica", "soy mujer"),
    NATIONALITY[0][0]: ("soy español", "nacionalidad española"),
    NATIONALITY[1][0]: ("nacionalidad extranjera", *(f"soy {x}" for x in ("extranjer", "marroqu", "colombian", "ruman", "venezolan", "peruan", "ecuatorian", "argentin", "bolivian", "chin"))),
    EMPLOYMENT[0][0]: ("estoy en paro", "desemplead", "buscando empleo", "busco trabajo"), EMPLOYMENT[1][0]: ("jubilad", "pensionista"),
    EMPLOYMENT[2][0]: ("soy estudiante", "estudiante a tiempo completo"), EMPLOYMENT[3][0]: ("trabajo ", "soy autónom", "tengo trabajo"),
    LANGUAGE[0][0]: ("catal",), LANGUAGE[1][0]: ("euskera", "euskaldun"), LANGUAGE[2][0]: ("gallego", "galegofalante"), LANGUAGE[3][0]: ("valenciano",),
    HOUSEHOLD_SIGNALS["single_parent"]: ("madre soltera", "padre soltero", "familia monoparental"), HOUSEHOLD_SIGNALS["alone"]: ("vivo sol",),
    HOUSEHOLD_SIGNALS["partner"]: ("vivo con mi ",), HOUSEHOLD_SIGNALS["children"]: ("mi hij", "mis hij"),
    ORIENTATION: ("hetero", "gay", "lesbiana", "sexu"), ZODIAC_WORD: tuple(sign for _, sign, _ in ZODIAC), RELIGION_WORD: tuple(w for w, _ in RELIGION_WORDS),
}


def zodiac(text: Column, low: Column | None = None) -> Column:
    """Sign and days: a symbol first, in the signs' order, else the first sign that is named."""
    out = None
    for symbol, sign, days in ZODIAC:
        hit, value = F.contains(text, F.lit(symbol)), f"{sign} ({days})"
        out = F.when(hit, value) if out is None else out.when(hit, value)

    def named(word: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for _, sign, days in ZODIAC for x in (sign, f"{sign} ({days})")]), word)

    low = plain(text) if low is None else low
    return F.coalesce(out, let(captured(low, ZODIAC_WORD, may=pieces_in(low)), named))


def religion(text: Column, low: Column | None = None) -> Column:
    """A symbol first, in the symbols' order, else the first word."""
    out = None
    for symbol, value in RELIGION_SYMBOLS:
        hit = F.contains(text, F.lit(symbol))
        out = F.when(hit, value) if out is None else out.when(hit, value)

    def named(word: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in RELIGION_WORDS for x in pair]), word)

    low = plain(text) if low is None else low
    return F.coalesce(out, let(captured(low, RELIGION_WORD, may=pieces_in(low)), named))


def orientation(text: Column, may: May = anything) -> Column:
    def named(word: Column) -> Column:
        out = None
        for key, value in ORIENTATION_KEYS:
            hit = F.contains(word, F.lit(key))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    return let(F.when(may(ORIENTATION), F.lower(F.regexp_substr(text, F.lit(ORIENTATION)))), named)


def age(text: Column, may: May = anything) -> Column:
    years = F.when(may(AGE), F.coalesce(captured(text, AGE, 1), captured(text, AGE, 2))).cast("int")
    return let(years, lambda y: F.when(y.between(12, 100), y))
