"""Language codes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingloom.functions import text as X

# Names by code.
NAMES = {
    "ar": "Arabic", "bg": "Bulgarian", "bn": "Bengali", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "et": "Estonian",
    "fa": "Persian", "fi": "Finnish", "fr": "French", "gu": "Gujarati", "ha": "Hausa", "he": "Hebrew", "hi": "Hindi", "hr": "Croatian", "hu": "Hungarian", "id": "Indonesian",
    "is": "Icelandic", "it": "Italian", "ja": "Japanese", "kk": "Kazakh", "km": "Khmer", "ko": "Korean", "lt": "Lithuanian", "lv": "Latvian", "mr": "Marathi", "ms": "Malay",
    "mt": "Maltese", "ne": "Nepali", "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "ps": "Pashto", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "si": "Sinhala",
    "sk": "Slovak", "sl": "Slovenian", "sr": "Serbian", "sv": "Swedish", "ta": "Tamil", "te": "Telugu", "th": "Thai", "tr": "Turkish", "uk": "Ukrainian", "vi": "Vietnamese", "zh": "Chinese",
}
# Three-letter aliases.
ALIASES = {"eng": "en", "kor": "ko", "zho": "zh", "jpn": "ja", "vie": "vi"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def normalize_code(code: Column) -> Column:
    """Stripped, lower case, underscores as hyphens, aliases resolved."""
    plain = F.lower(F.translate(X.strip(code), "_", "-"))
    return F.coalesce(_lookup(ALIASES, plain), plain)


def language_name(code: Column) -> Column:
    """Name of the full code, else of its base, else the code itself."""
    plain = F.lower(F.translate(X.strip(code), "_", "-"))
    return F.coalesce(_lookup(NAMES, plain), _lookup(NAMES, F.substring_index(plain, "-", 1)), plain)


def resolve_code(field: Column, fixed: str | None) -> Column:
    """A row's own code wins over the configured one; neither is an error."""
    own = F.nullif(X.strip(field), F.lit(""))
    return F.coalesce(normalize_code(F.coalesce(own, F.lit(fixed))), F.raise_error(F.lit("no language code")).cast("string"))


def ordered_distinct(codes: list[str]) -> list[str]:
    out: list[str] = []
    for raw in codes:
        code = raw.strip().replace("_", "-").lower()
        code = ALIASES.get(code, code)
        if code and code not in out:
            out.append(code)
    return out
