"""Text functions as columns: tokenization, cleaning, normalization, validation. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.forms import nfc

#: Letters of a language's words in the index.
ALPHABETS = {"en": "[a-z]+", "ru": "[а-яё]+", "es": "[a-záéíóúüñ]+", "de": "[a-zäöüß]+", "fr": "[a-zàâæçéèêëîïôœùûüÿ]+", "pt": "[a-záâãàçéêíóôõú]+"}
#: Characters that cleaning replaces: control, format, private, single surrogate and unassigned ones, other symbols; not line breaks and tabs.
UNCLEAN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}\p{Co}\p{Cs}\p{Cn}\p{So}\x{FFFD}\x{1F000}-\x{1FAFF}]"
INVISIBLE = r"[\x{FEFF}\x{200B}\x{00AD}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column, language: str = "en") -> Column:
    """All words of a text in small letters, in order; positions count from 0 in this array."""
    return matches(F.lower(text), ALPHABETS[language])


def kept(w: Column, stopwords: Sequence[str], longer_than: int = 1) -> Column:
    """Without stopwords and short words."""
    return F.filter(w, lambda x: (F.length(x) > longer_than) & ~x.isin(list(stopwords)))


def noun_form(w: Column) -> Column:
    """A rule for English plurals, without a lexicon: an optional normalizer."""
    rules = [("(ch|sh|s|x|z)es$", "$1"), ("ies$", "y"), ("men$", "man"), ("([^s])s$", "$1")]
    out = w
    for pattern, to in reversed(rules):
        out = F.when(w.rlike(pattern), F.regexp_replace(w, pattern, to)).otherwise(out)
    return out


def paragraphs(text: Column) -> Column:
    """Stretches up to and with two or more line breaks; together they are the text."""
    return matches(text, r"(?s).+?(?:(?:\r?\n){2,}|\z)")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}\x{85}\x0B\x1C-\x1F]+", " "))


def python_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def sentences(text: Column) -> Column:
    """array<struct<text, doc_start, para_start, para_length>> of sentences of 20 or more characters.

    A sentence ends with any of `.!?`; white space is collapsed; starts are offsets of the raw match. A text without such
    a sentence is one sentence if it isn't blank.
    """
    # starts are zipped to the pieces, as an expression inside a lambda would be computed for each element
    paras = paragraphs(text)
    starts = F.aggregate(paras, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    zipped = F.filter(F.arrays_zip(paras.alias("p"), starts.alias("s")), lambda x: x["p"].isNotNull())

    def of(para: Column) -> Column:
        found = matches(para["p"], r"[^.!?]+(?:[.!?]+|$)")
        lead = F.length(F.regexp_extract(para["p"], r"^[.!?]*", 0))
        begins = F.aggregate(found, F.array(lead), lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(m))))
        length = F.greatest(F.length(python_strip(para["p"])), F.lit(1))
        each = F.filter(F.arrays_zip(found.alias("m"), begins.alias("b"), F.array_repeat(length, F.size(found)).alias("n")), lambda x: x["m"].isNotNull())
        return F.transform(each, lambda x: F.struct(collapsed(x["m"]).alias("text"), (para["s"] + x["b"]).alias("doc_start"), x["b"].alias("para_start"), x["n"].alias("para_length")))

    long = F.filter(F.flatten(F.transform(zipped, of)), lambda x: F.length(x["text"]) >= 20)
    whole = F.array(F.struct(python_strip(text).alias("text"), F.lit(0).alias("doc_start"), F.lit(0).alias("para_start"), F.greatest(F.length(text), F.lit(1)).alias("para_length")))
    # the first of both that isn't empty; the expressions stand once each, so they are computed once
    either = F.array(long, F.filter(whole, lambda x: x["text"] != ""))
    return F.get(F.filter(either, lambda x: F.size(x) > 0), F.lit(0))


def clean(text: Column) -> Column:
    """Odd characters become spaces, blanks in a line collapse, at most one blank line stays."""
    t = F.regexp_replace(text, UNCLEAN, " ")
    t = F.regexp_replace(t, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def is_dirty(text: Column) -> Column:
    """Whether a text needs cleaning beyond `clean`: replacement characters, many odd ones, or few letters."""
    cleaned = clean(text)
    odd = F.length(text) - F.length(F.regexp_replace(text, UNCLEAN, ""))
    letters = F.length(F.regexp_replace(cleaned, r"[^\p{L}]", ""))
    return F.when(cleaned == "", F.lit(False)).otherwise(text.contains("�") | (odd > F.greatest(F.lit(10), F.floor(F.length(text) / 200))) | (letters < 50))


def normalize(text: Column) -> Column:
    """For reading aloud: NFC, one kind of line break, no invisible characters, blanks collapsed, at most one blank line."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(nfc(text), r"\r\n|\r|\x{2028}", "\n"), r"\x{2029}", "\n\n"), INVISIBLE, "")
    t = F.regexp_replace(t, r"[\t\x0B\f\p{Zs}]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def reading_error(text: Column, most: int = 20_000, least_latin: float = 0.7) -> Column:
    """Why a text can't be read aloud in English; null if it can."""
    prepared = normalize(text)
    letters = F.length(F.regexp_replace(prepared, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(prepared, r"[^A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿ]", ""))
    return (
        F.when(text.isNull(), "no_text").when(text.rlike(CONTROL), "control_characters").when(prepared == "", "empty").when(F.length(prepared) > most, "too_long").when(letters == 0, "no_letters").when(latin / F.nullif(letters, F.lit(0)) < least_latin, "not_latin")
    )


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def natural_key(name: Column) -> Column:
    """Sorts `2` before `10`: runs of digits are padded, digits before letters."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "\u0001000000000000000000$1\u0002")
    return F.regexp_replace(padded, "\u00010*(\\d{18})\u0002", "\u0001$1\u0002")


def html_text(html: Column) -> Column:
    """The text between the tags, without scripts and styles, blanks collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return collapsed(t)


def ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams in small letters; white space counts as one blank."""
    chars = matches(F.lower(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), "(?s).")
    # each longer gram is the shorter one and the character behind it, so the work grows with the text only
    grams, runs = chars, []
    for n in range(2, high + 1):
        grams = F.zip_with(grams, F.slice(chars, F.lit(n), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
        if n >= low:
            runs.append(grams)
    return F.filter(F.concat(*runs), lambda x: x.isNotNull())
