"""Unicode forms of texts, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that NFC may change: marks, Hangul letters, and single characters with a canonical replacement.
_MAY_CHANGE = (
    r"[\p{M}\x{1100}-\x{11FF}\x{2126}\x{212A}\x{212B}\x{2000}\x{2001}\x{2329}\x{232A}\x{0374}\x{037E}\x{0387}\x{1F00}-\x{1FFF}\x{0958}-\x{095F}"
    r"\x{09DC}-\x{09DF}\x{0A33}-\x{0A5E}\x{0B5C}\x{0B5D}\x{0F43}-\x{0FB9}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4F}\x{2F800}-\x{2FA1F}]"
)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """`c` in NFC. Only values that NFC may change go to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(_MAY_CHANGE), c)), c)
