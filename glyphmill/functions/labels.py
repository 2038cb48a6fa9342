"""Labels of languages in any spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the languages' names.
SPELLINGS = {
    "en": "en eng english anglais inglés",
    "es": "es spa spanish español castellano espagnol",
    "ru": "ru rus russian русский",
    "de": "de deu ger german deutsch allemand",
    "fr": "fr fra fre french français francés",
    "pt": "pt por portuguese português",
    "zh": "zh zho chi cmn chinese mandarin 中文",
    "ja": "ja jpn japanese 日本語",
    "hi": "hi hin hindi हिन्दी",
    "ar": "ar ara arabic العربية",
    "th": "th tha thai ไทย",
}
LANGUAGES = tuple(SPELLINGS)
_CODE = {name: code for code, names in SPELLINGS.items() for name in names.split()}


def label_code(label: Column) -> Column:
    """The code a label names in any spelling, with or without a region; null if it names none of the languages."""
    key = F.regexp_extract(F.lower(F.trim(label)), r"^[\p{Z}\s]*([\p{L}\p{M}]+)", 1)
    whole = F.regexp_replace(F.lower(F.trim(label)), r"[\p{Z}\s]+", "")
    ok = whole.rlike(r"^[\p{L}\p{M}]+(?:[-_][a-z0-9]{2,8})*$")
    table = F.create_map(*[F.lit(x) for kv in _CODE.items() for x in kv])
    return F.when(ok, F.element_at(table, key))


def label_sql(column: str) -> str:
    """The same in SQL, as a CASE over the spellings."""
    cases = " ".join(f"when regexp_matches(lower({column}), '^[\\s\\p{{Z}}]*({'|'.join(names.split())})([-_][a-z0-9]{{2,8}})*[\\s\\p{{Z}}]*$') then '{code}'" for code, names in SPELLINGS.items())
    return f"(case {cases} end)"
