"""Text functions: search tokens with folding and stemming, languages, digits, numbers in words.

The fast path (``search.tokens``) is column-only. Normal forms (NFKC), full case folding and stemming have no
built-in function, so ``search_tokens`` is an Arrow-batched UDF; index and query must use the same version.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_VERSION = 1
_RUN = regex.compile(r"[\p{L}\p{N}\p{M}]+")
# Language codes of other standards, and light suffixes per language, longest first.
ISO_639_3 = {"en": "eng", "de": "deu", "ger": "deu", "fr": "fra", "fre": "fra", "es": "spa", "esp": "spa", "zh": "zho", "chi": "zho", "th": "tha", "ru": "rus", "ar": "ara", "fa": "fas", "per": "fas", "am": "amh", "it": "ita", "pt": "por", "nl": "nld", "dut": "nld", "pl": "pol", "uk": "ukr", "el": "ell", "gre": "ell"}
SUFFIXES = {
    "eng": ["ations", "ation", "ings", "ing", "ies", "ed", "es", "s"],
    "deu": ["ungen", "ung", "ern", "en", "er", "es", "em", "e", "n", "s"],
    "fra": ["ements", "ement", "ations", "ation", "euses", "eurs", "eur", "aux", "es", "er", "e", "s"],
    "spa": ["aciones", "acion", "mientos", "miento", "ando", "iendo", "es", "os", "as", "o", "a", "s"],
}
CARDINALS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {
    w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)
}
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
KANJI = {c: n for n, c in enumerate("〇一二三四五六七八九")}


def language(code: Column) -> Column:
    """ISO 639-3 of a code of any of the three standards; unknown codes in lower case, blank ones null."""
    c = F.nullif(F.lower(F.trim(F.regexp_replace(code, r"[-_].*$", ""))), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in ISO_639_3.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def fold_digits(text: Column) -> Column:
    """Arabic-Indic, Persian, Thai, Devanagari and full-width digits as ASCII."""
    sets = [0x0660, 0x06F0, 0x0E50, 0x0966, 0xFF10]
    return F.translate(text, "".join(chr(b + d) for b in sets for d in range(10)), "0123456789" * len(sets))


def stem(token: str, lang: str | None) -> str:
    if lang == "ara":
        for pattern, kept in ARABIC_STEPS:
            token = regex.sub(pattern, kept.replace("$", "\\"), token)
        return token
    for suffix in SUFFIXES.get(lang or "", ()):
        if token.endswith(suffix) and len(token) - len(suffix) >= 3:
            return token[: -len(suffix)]
    return token


def tokenise(text: str | None, lang: str | None = None) -> list[str]:
    """NFKC, ASCII digits, runs of letters, digits and marks, case folded and stemmed; order and repeats kept."""
    folded = unicodedata.normalize("NFKC", text or "")
    folded = "".join(str(unicodedata.digit(c)) if c.isdigit() and not c.isascii() and unicodedata.digit(c, None) is not None else c for c in folded)
    if lang == "ara":
        folded = regex.sub(ARABIC_MARKS, "", folded.translate(str.maketrans(ARABIC_FOLDS)))
    return [stem(t.casefold(), lang) for t in _RUN.findall(folded)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def search_tokens(text: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([tokenise(t, None if x is None else x) for t, x in zip(text, lang)])


def cardinal(words: str | None) -> int | None:
    """The number that English words spell; None if they spell none."""
    total = part = 0
    seen = False
    for w in regex.findall(r"[a-z]+", (words or "").lower()):
        if w == "and":
            continue
        if w in CARDINALS:
            part, seen = part + CARDINALS[w], True
        elif w == "hundred":
            part, seen = max(part, 1) * 100, True
        elif w in SCALES:
            total, part, seen = total + max(part, 1) * SCALES[w], 0, True
        else:
            return None
    return total + part if seen else None


def kanji_number(text: str | None) -> int | None:
    """The number below 100 that Chinese numerals spell by units (一, 十, 二十三); None for anything else, 二三 and 十十 included."""
    m = regex.fullmatch("(?<tens>[一二三四五六七八九〇]?)十(?<units>[一二三四五六七八九〇]?)|(?<units>[一二三四五六七八九〇])", text or "")
    if m is None:
        return None
    digit = lambda c, none: KANJI[c] if c else none
    return digit(m["tens"], 1) * 10 + digit(m["units"], 0) if "十" in text else KANJI[text]


def presentation_form_share(text: Column, least: int = 40) -> Column:
    """Share of letters that are Arabic presentation forms; null under ``least`` letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    forms = F.length(F.regexp_replace(text, r"[^\x{FB50}-\x{FEFF}]", ""))
    return F.when(letters >= least, F.round(forms / letters, 6))


def script_purity(text: Column, script: str = "Latin", least: int = 40) -> Column:
    """Share of letters in the expected script; null under ``least`` letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    own = F.length(F.regexp_replace(text, rf"[^\p{{Is{script}}}]", ""))
    return F.when(letters >= least, F.round(own / letters, 6))


def grounding(new: Column, source: Column) -> Column:
    """Share of the distinct words of a text that its source has; null without words."""
    cut = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    mine = cut(new)
    return F.when(F.size(mine) > 0, F.round(F.size(F.array_intersect(mine, cut(source))) / F.size(mine), 6))


# Arabic letter folds, conjunctions, articles and suffixes of light stemming, ordinals.
ARABIC_FOLDS = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ئ": "ي", "ؤ": "و", "ة": "ه", "ـ": ""}
ARABIC_ARTICLES = ["وال", "بال", "كال", "فال", "ال", "لل"]
ARABIC_SUFFIXES = ["ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي"]
ARABIC_MARKS = "[\u0640\u064b-\u0652\u0670]"
ORDINALS = {w: n for n, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split(), 1)}


def fold_arabic(text: Column) -> Column:
    """Arabic orthography folded for matching: hamza forms, final forms, tatweel and vowel marks."""
    kept = {a: b for a, b in ARABIC_FOLDS.items() if b}
    return F.regexp_replace(F.translate(text, "".join(kept), "".join(kept.values())), ARABIC_MARKS, "")


# conjunction, article and ending of a light stem; at least three letters stay without the conjunction, two without the others
ARABIC_STEPS = [
    ("^و(?!ال)(?=.{3})", ""),
    (f"^(?:{'|'.join(ARABIC_ARTICLES)})(?=.{{2}})", ""),
    (f"^(.{{2,}}?)(?:{'|'.join(ARABIC_SUFFIXES)})$", "$1"),
]


def stem_arabic(token: Column) -> Column:
    """A light stem: one conjunction, one article, one suffix."""
    for pattern, kept in ARABIC_STEPS:
        token = F.regexp_replace(token, pattern, kept)
    return token


def ordinal(word: str | None) -> int | None:
    """The place that an English ordinal, spelled or in digits, names."""
    w = (word or "").strip().lower()
    if m := regex.fullmatch(r"(\d+)(?:st|nd|rd|th)", w):
        return int(m[1])
    return ORDINALS.get(w)


def identity_from_title(title: Column) -> Column:
    """struct<number, year> that a title states as ``No. 12 of 1999``, ``12/1999`` or a trailing year; null parts if it doesn't."""
    both = r"(?i)\b(?:no\.?|nr\.?|n°|nº)?\s*(\d{1,5})\s*(?:of|/|de|von|du)\s*((?:1[2-9]|20|21)\d\d)\b"
    year = F.coalesce(F.nullif(F.regexp_extract(title, both, 2), F.lit("")), F.nullif(F.regexp_extract(title, r"\b((?:1[2-9]|20|21)\d\d)\s*$", 1), F.lit("")))
    return F.struct(F.nullif(F.regexp_extract(title, both, 1), F.lit("")).alias("number"), year.cast("int").alias("year"))


def money_mismatches(text: str | None) -> list[tuple[int, int]]:
    """(numeral, amount in words) where the two state different sums, as in ``500 (four hundred)``."""
    out = []
    for m in regex.finditer(r"(\d[\d,]*)\s*\(([a-z][a-z\s-]+)\)", (text or "").lower()):
        said = cardinal(m[2].replace("-", " "))
        if said is not None and said != int(m[1].replace(",", "")):
            out.append((int(m[1].replace(",", "")), said))
    return out


def numeric_tokens(text: Column) -> Column:
    """Numbers of a text in order, digits folded, thousands separators dropped (slots that a rendering must keep)."""
    found = F.regexp_extract_all(fold_digits(F.coalesce(text, F.lit(""))), F.lit(r"(\d[\d.,]*)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[.,]+$", ""), r"[.,](?=\d{3}(?:\D|$))", ""))
