"""Duplicates hidden by formatting differences."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrow import flat_map
from glyphmill.llm.components import components
from glyphmill.llm.sentences import is_card
from glyphmill.plans.lineage import cut
from glyphmill.plans.skew import split_join


_DROPPED = re.compile(r"[\W_]+")
_BREAKS = re.compile(r"\r\n|\r|\n")
_DIGEST = re.compile(r"(?:sha[23]?(?:1|224|256|384|512)|md5|blake(?:2[bs]?|3)|xxh(?:32|64|128))")


def _letters_digits(text: str) -> str:
    return _DROPPED.sub("", text).casefold()


def canonical(text: str) -> str:
    """`text` apart from how it is written down; empty if it has no letter or digit.

    Characters are composed (NFC); case, white space and punctuation are dropped; the lines of a catalogue card are sorted.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if is_card(text):
        return "card\n" + "\n".join(sorted(_letters_digits(x) for x in _BREAKS.split(text) if not x.isspace() and x))
    return _letters_digits(text)


def canonical_hash(file_hash: str | None) -> str | None:
    """A hash without case, white space, punctuation and a digest name in front; None if nothing is left."""
    x = _letters_digits(file_hash or "")
    m = _DIGEST.match(x)
    return (x[m.end() :] if m else x) or None


def _key(form: str) -> str:
    data = form.encode("utf-8", "surrogatepass")
    return f"{hashlib.md5(data, usedforsecurity=False).hexdigest()}-{xxhash.xxh64_hexdigest(data)}-{len(form)}"


def copies(docs: DataFrame, doc_id: str, text: str, file_hash: str) -> DataFrame:
    """(doc_id, first_doc_id): every document that belongs to a group, with the smallest id of its group.

    Texts with the same canonical form are one group; a null text belongs with all documents of its canonical hash;
    groups are transitive. A text without letter or digit (empty and blank ones too), a null text without hash, and a
    row without id belong to none. Repeated rows count once. Canonical forms are hashed to 128 bits; a second hash of
    64 bits and the length stand beside it in every grouping, so that a collision parts the texts instead of merging
    them. Counts are combined on the map side; a group of any size is only ever a key with one minimum.
    """

    def make():
        def rows(ids, texts, hashes):
            for i, t, h in zip(ids, texts, hashes, strict=True):
                form, hk = (None if t is None else canonical(t)), canonical_hash(h)
                if form or (form is None and hk):
                    yield i, form is None, hk, _key(form) if form else None

        return rows

    chosen = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint"), F.col(text), F.col(file_hash))
    keyed = cut(flat_map(chosen, "doc_id bigint, no_text boolean, hk string, tk string", make))

    # one row per text and per hash of null texts
    own = keyed.select("doc_id", F.when(F.col("no_text"), F.concat(F.lit("h"), "hk")).otherwise(F.col("tk")).alias("key"))
    groups = cut(own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep")))

    # a kept text meets the hash of a null text; only such hashes matter
    kept = keyed.filter(~F.col("no_text") & F.col("hk").isNotNull()).select("tk", "hk")
    wanted = groups.filter(F.col("key").startswith("h")).select(F.expr("substring(key, 2)").alias("hk"))
    shared = cut(kept.groupBy("hk").agg(F.count(F.lit(1)).alias("m")).join(wanted, "hk", "left_semi"))
    edges = split_join(kept, shared, ["hk"], "m").select(F.col("tk").alias("a"), F.concat(F.lit("h"), "hk").alias("b"))
    linked = components(edges).select(F.col("node").alias("key"), F.col("first").alias("label"))

    # a group's first document is the smallest of all groups with its label; a label may have very many groups
    labelled = cut(groups.join(linked, "key", "left").filter("n > 1 or label is not null"))
    firsts = cut(labelled.filter("label is not null").groupBy("label").agg(F.min("rep").alias("first_doc_id"), F.count(F.lit(1)).alias("m")))
    named = labelled.filter("label is null").select("key", "n", F.col("rep").alias("first_doc_id"))
    named = cut(named.unionByName(split_join(labelled.filter("label is not null"), firsts, ["label"], "m").select("key", "n", "first_doc_id")))
    return split_join(own, named, ["key"], "n").select("doc_id", "first_doc_id").distinct()


def copy_counts(members: DataFrame) -> DataFrame:
    """(first_doc_id, n_copies) of the groups of `copies` with more than one document."""
    return members.groupBy("first_doc_id").agg(F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
