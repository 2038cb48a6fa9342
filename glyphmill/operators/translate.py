"""Dictionary translation, lexical statistics and trees over annotated tokens."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Types
from pyspark.sql.window import Window as W

from glyphmill.resources import SKIPPED_POS

_TREE = "array<struct<i:int,text:string,pos:string,dep:string,head:int>>"


def parse_lines(lines: DataFrame, line: str) -> DataFrame:
    """(source_word, target_word, pos, tag, morph) of dictionary lines; the separator is the first of tab, | ; , in them.

    Comments, blank lines and lines without both words are left out.
    """
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    sep = F.when(t.contains("\t"), "\t").when(t.contains("|"), "\\|").when(t.contains(";"), ";").otherwise(",")
    parts = F.transform(F.split(t, sep), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    p = lines.withColumn("_t", t).filter("_t <> '' and not startswith(_t, '#')").withColumn("_p", parts)
    field = lambda i: F.coalesce(F.get("_p", F.lit(i)), F.lit(""))
    out = p.select(*[c for c in lines.columns if c != line], *[field(i).alias(n) for i, n in enumerate(("source_word", "target_word", "pos", "tag", "morph"))])
    return out.filter("source_word <> '' and target_word <> ''")


def upsert(dictionary: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries by (source_word, pos) after changes: the target is replaced, empty grammar keeps what is there."""
    keep = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}"), F.lit("")).alias(c)
    both = dictionary.alias("o").join(changes.alias("n"), (F.col("o.source_word") == F.col("n.source_word")) & (F.col("o.pos") == F.col("n.pos")), "full_outer")
    first = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return both.select(first("source_word"), first("pos"), first("target_word"), keep("source_form"), keep("tag"), keep("morph"), first("translation_source"))


def lookup(tokens: DataFrame, dictionary: DataFrame, lemma: str = "lemma", pos: str = "pos") -> DataFrame:
    """`tokens` with target: the entry of (lemma, pos), else the lemma's first entry, else null."""
    exact = dictionary.groupBy("source_word", F.col("pos").alias("_pos")).agg(F.min_by("target_word", "id").alias("_exact"))
    any_ = dictionary.groupBy(F.col("source_word").alias("_word")).agg(F.min_by("target_word", "id").alias("_any"))
    key = F.lower(F.col(lemma))
    out = tokens.join(exact, (key == F.col("source_word")) & (F.col(pos) == F.col("_pos")), "left").join(any_, key == F.col("_word"), "left")
    return out.withColumn("target", F.coalesce("_exact", "_any")).drop("source_word", "_pos", "_exact", "_word", "_any")


def translate_tokens(tokens: DataFrame, dictionary: DataFrame, stopwords: Sequence[str] = ()) -> DataFrame:
    """Tokens but punctuation with `ru` and state: skipped (ru is empty), translated, or unknown (ru is the word itself)."""
    words = lookup(tokens.filter(~F.col("pos").isin("PUNCT", "SPACE")), dictionary)
    skip = F.lower("lemma").isin(list(stopwords)) | F.col("pos").isin(list(SKIPPED_POS)) | ((F.col("pos") == "AUX") & (F.col("tag") != "MD"))
    state = F.when(skip, "skipped").when(F.col("target").isNotNull(), "translated").otherwise("unknown")
    return words.withColumn("state", state).withColumn("ru", F.when(F.col("state") == "skipped", "").when(F.col("state") == "translated", F.col("target")).otherwise(F.col("text"))).drop("target")


def sentence_arrays(rows: DataFrame, *fields: str) -> DataFrame:
    """(sent_id, tokens): a sentence's tokens in order; sentences are short by nature."""
    return rows.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("i", *fields))).alias("tokens"))


def direct(translated: DataFrame) -> DataFrame:
    """(sent_id, translation): the words in their order, skipped ones left out."""
    s = sentence_arrays(translated, "ru")
    return s.select("sent_id", F.array_join(F.filter(F.transform("tokens", lambda t: t["ru"]), lambda x: x != ""), " ").alias("translation"))


def coverage(translated: DataFrame, *by: str) -> DataFrame:
    """(by..., words, translated, skipped, unknown, coverage in percent) per group, or in one row."""
    n = lambda s: F.count_if(F.col("state") == s)
    a = translated.groupBy(*by).agg(F.count(F.lit(1)).alias("total_words"), n("translated").alias("translated_words"), n("skipped").alias("skipped_words"), n("unknown").alias("n_unknown"))
    return a.withColumn("coverage", F.coalesce(F.round(F.col("translated_words") / F.nullif(F.col("total_words"), F.lit(0)) * 100, 1), F.lit(0.0)))


def unknown_words(translated: DataFrame) -> DataFrame:
    """(word, n): the words that the dictionary doesn't have, a row each."""
    return translated.filter("state = 'unknown'").groupBy(F.col("text").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def report(translated: DataFrame, pos_names: dict[str, str]) -> DataFrame:
    """(section, place, line): the report of a translation: totals, unknown words, words by frequency, their grammar.

    Lines of a section are sorted by `place`, then by themselves; none is gathered in one task.
    """
    c = coverage(translated)
    totals = F.array(*[F.struct(F.lit(k).alias("place"), F.concat(F.rpad(F.lit(label), 33, " "), F.col(name).cast("string")).alias("line")) for k, (label, name) in enumerate((("Всего слов:", "total_words"), ("Переведено:", "translated_words"), ("Пропущено:", "skipped_words"), ("Не найдено в словаре:", "n_unknown"), ("Покрытие, %:", "coverage")))])
    head = c.select(F.lit("totals").alias("section"), F.explode(totals).alias("x")).select("section", F.col("x.place").cast("bigint").alias("place"), "x.line")
    unknown = unknown_words(translated).select(F.lit("unknown").alias("section"), F.lit(0).cast("bigint").alias("place"), F.concat(F.lit("    "), "word").alias("line"))
    stats = lexical_stats(translated.withColumn("_at", F.struct("sent_id", "i")), "lemma", "pos", "text", "_at")
    first = translated.groupBy(F.lower("lemma").alias("lemma"), F.coalesce("pos", F.lit("")).alias("pos")).agg(F.max(F.when(F.col("state") == "translated", F.col("ru"))).alias("target"))
    both = stats.join(first, ["lemma", "pos"])
    by_n = both.select(F.lit("frequency").alias("section"), (-F.col("n")).alias("place"), F.concat_ws(" | ", F.lpad(F.col("n").cast("string"), 8, " "), F.rpad("lemma", 20, " "), F.rpad(F.coalesce("target", F.lit("")), 22, " "), F.rpad("pos", 7, " ")).alias("line"))
    grammar = both.select(F.lit("grammar").alias("section"), (-F.col("n")).alias("place"), F.concat_ws(" ", F.rpad("lemma", 20, " "), F.rpad("pos", 7, " "), decoded(F.col("pos"), pos_names, "неизвестно")).alias("line"))
    return head.unionByName(unknown).unionByName(by_n).unionByName(grammar)


def most_common(stats: DataFrame, limit: int) -> DataFrame:
    """The `limit` most frequent rows of `lexical_stats`; ties by lemma and part of speech. Each task keeps its best only."""
    return stats.orderBy(F.desc("n"), "lemma", "pos").limit(limit)


def lexical_stats(tokens: DataFrame, lemma: str, pos: str, form: str, order: str) -> DataFrame:
    """(lemma, pos, n, form): frequency of each (lemma, part of speech) with its first form."""
    return tokens.groupBy(F.lower(F.col(lemma)).alias("lemma"), F.coalesce(pos, F.lit("")).alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.min_by(form, order).alias("form"))


def relink(kept: DataFrame, tokens: DataFrame) -> DataFrame:
    """(sent_id, i, new_head): heads after tokens were dropped; climbs over dropped heads, a lone token is its own head.

    A sentence is one row, in which heads are climbed step by step, so there is no join or shuffle per step.
    """
    t = tokens.join(kept.select("sent_id", "i").withColumn("keep", F.lit(True)), ["sent_id", "i"], "left")
    s = t.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("i", "head", F.coalesce("keep", F.lit(False)).alias("keep")))).alias("t"))
    return s.select("sent_id", F.explode(_relinked("t")).alias("x")).select("sent_id", "x.*")


def climb(heads: dict[int, int], kept: set[int]) -> dict[int, int]:
    """New head of each kept token: the nearest kept one above it, itself if there is none."""
    out = {}
    for i in sorted(kept):
        h, steps = heads[i], 0
        while h not in kept and heads.get(h, h) != h and steps <= len(heads):
            h, steps = heads[h], steps + 1
        out[i] = h if h in kept else i
    return out


@F.pandas_udf(Types.ArrayType(Types.StructType([Types.StructField("i", Types.IntegerType()), Types.StructField("new_head", Types.IntegerType())])))
def _relinked(sentences: pd.Series) -> pd.Series:
    def one(ts):
        out = climb({t["i"]: t["head"] for t in ts}, {t["i"] for t in ts if t["keep"]})
        return [{"i": i, "new_head": h} for i, h in out.items()]

    return sentences.map(one)


# Relations of subjects and adverbs, and those that stand before and behind their head in a translation.
SUBJECTS = {"nsubj", "nsubj:pass", "nsubjpass", "csubj"}
ADVERBS = {"advmod", "advcl", "obl:tmod"}
BEFORE = {"det", "amod", "nummod", "advmod", "aux", "case", "mark", "neg"}
BEHIND = {"obj", "dobj", "iobj", "pobj", "obl", "nmod", "conj", "xcomp", "ccomp", "acl", "acl:relcl", "appos", "compound", "prep", "attr"}


def linearize(tokens: Sequence[dict]) -> list[int]:
    """Order of a tree's tokens: subjects, the root's adverbs, the root, then what is left; each with its modifiers around it.

    Every token gets a sort key: the turn of the token it hangs on, then a step (side, place) for each level below it.
    A coordinating conjunction stands directly before the first of its later siblings.
    """
    by = {t["i"]: t for t in tokens}
    root = next((t["i"] for t in tokens if t["head"] == t["i"]), None)
    if root is None:
        return sorted(by)

    def turn(i: int) -> tuple[int, int]:
        rel = by[i]["dep"]
        return (0 if rel in SUBJECTS else 1 if rel in ADVERBS and by[i]["head"] == root else 2 if i == root else 3, i)

    def side(i: int) -> int:
        """-1 before the head, 1 behind it, 0 for tokens that don't hang on their head."""
        rel, head = by[i]["dep"], by[i]["head"]
        return 0 if head == i or head not in by else -1 if rel in BEFORE else 1 if rel in BEHIND else 0

    links: dict[int, int] = {}  # the first conjunction below each head
    for i in sorted(by):
        if by[i]["dep"] == "cc":
            links.setdefault(by[i]["head"], i)
    paths: dict[int, tuple] = {}

    def path(i: int, above: tuple[int, ...] = ()) -> tuple:
        """The earliest of a token's own turn, its place around its head, and that before the siblings a conjunction leads."""
        if i in paths:
            return paths[i]
        options = [(turn(i),)]
        head = by[i]["head"]
        if side(i) and head not in above:
            options.append((*path(head, (*above, i)), (side(i), i)))
        if links.get(head) == i:
            options += [(*path(x, (*above, i)), (0, -1)) for x in by if by[x]["head"] == head and x > i and x not in above]
        if not above:
            paths[i] = min(options)
        return min(options)

    children: dict[int, list[int]] = {}
    for i in by:
        children.setdefault(by[i]["head"], []).append(i)
    heads_first = [i for i in by if by[i]["head"] == i or by[i]["head"] not in by]
    for i in heads_first:  # so that no path is found through more than a head that has its own
        heads_first += [c for c in children.get(i, []) if c != i]
        path(i)
    return sorted(by, key=lambda i: (*path(i), (0, i)))


def _sentence_udf(make) -> object:
    @F.pandas_udf(Types.StringType())
    def run(sentences: pd.Series) -> pd.Series:
        return sentences.map(lambda ts: make([dict(t) for t in ts]))

    return run


def transfer(translated: DataFrame, linked: DataFrame) -> DataFrame:
    """(sent_id, translation): translated words in the order of the target language's tree."""
    kept = translated.filter("ru <> ''").join(linked, ["sent_id", "i"]).select("sent_id", "i", F.col("ru").alias("text"), "dep", F.col("new_head").alias("head"))

    def words(ts):
        by = {t["i"]: t["text"] for t in ts}
        return " ".join(by[i] for i in linearize(ts))

    return sentence_arrays(kept, "text", "dep", "head").select("sent_id", _sentence_udf(words)("tokens").alias("translation"))


# What becomes of a dependent by its relation, in each kind of phrase: where it stands (before its head: mark, aux, cop,
# left; behind it: right, late, end), the label of its bracket, and what is built of it.
_COMMON = {"punct": ("end", "PUNCT", "leaf")}
_MODIFIED = _COMMON | {"advmod": ("left", "", "ADVP")} | dict.fromkeys(("obl", "obj", "dobj"), ("right", "", "NP"))
_OBLIQUE = (
    _COMMON
    | dict.fromkeys(("det", "amod", "nummod", "nummod:entity"), ("left", "", "modifier"))
    | dict.fromkeys(("fixed", "flat", "compound"), ("right", "", "word"))
    | {"nmod": ("right", "", "NP"), "appos": ("right", "Appos", "NP"), "conj": ("right", "CoordNP", "NP")}
    | dict.fromkeys(("acl", "acl:relcl"), ("right", "RC", "clause"))
)
PHRASE_RULES = {
    "NP": _OBLIQUE | {"case": ("left", "P", "leaf"), "parataxis": ("right", "Parataxis", "phrase"), "discourse": ("right", "Discourse", "leaf")},
    "NP of a PP": _OBLIQUE,
    "ADJP": _MODIFIED | {"conj": ("right", "CoordADJP", "ADJP")},
    "ADVP": _MODIFIED | {"conj": ("right", "CoordADVP", "ADVP")},
    "VP": _COMMON
    | {"mark": ("mark", "MARK", "leaf"), "cop": ("cop", "COP", "leaf"), "advmod": ("left", "", "ADVP"), "expl": ("left", "EXPL", "leaf"), "obl": ("right", "", "oblique")}
    | {"xcomp": ("right", "XCOMP", "phrase"), "ccomp": ("right", "CCOMP", "clause"), "advcl": ("right", "SBAR", "clause"), "conj": ("right", "CoordVP", "phrase"), "parataxis": ("right", "Parataxis", "clause")}
    | {"compound:prt": ("right", "PRT", "leaf"), "appos": ("right", "Appos", "phrase")}
    | dict.fromkeys(("aux", "aux:pass", "auxpass"), ("aux", "AUX", "leaf"))
    | dict.fromkeys(("obj", "iobj", "dobj", "pobj"), ("right", "", "NP"))
    | dict.fromkeys(("obl:agent", "agent"), ("right", "AgentPP", "NP"))
    | dict.fromkeys(("discourse", "vocative"), ("late", "DISCOURSE", "leaf")),
}
_SLOTS = ("mark", "aux", "cop", "left", "head", "right", "late", "end")
_KIND = {"VERB": "VP", "AUX": "VP", "NOUN": "NP", "PROPN": "NP", "PRON": "NP", "NUM": "NP", "ADJ": "ADJP", "DET": "ADJP", "ADV": "ADVP"}


def constituency(tokens: Sequence[dict]) -> str:
    """A bracketed phrase structure of a dependency tree: a phrase per head by PHRASE_RULES; other dependents are left out."""
    by = {t["i"]: t for t in tokens}
    below: dict[int, list[int]] = {i: [] for i in by}
    for i in sorted(by):
        if by[i]["head"] != i and by[i]["head"] in by:
            below[by[i]["head"]].append(i)
    root = next((i for i in sorted(by) if by[i]["head"] == i or by[i]["dep"] == "ROOT"), None)
    if root is None:
        return "(S)"
    pos, rel = {i: t["pos"] for i, t in by.items()}, {i: t["dep"] for i, t in by.items()}

    def bracket(label: str, *parts: str) -> str:
        return f"({' '.join([label, *parts])})"

    def leaf(label: str, i: int) -> str:
        return bracket(label, by[i]["text"])

    def link(i: int) -> list[str]:
        """The conjunction of a conjunct: its own, or its head's before it."""
        own = [c for c in below[i] if rel[c] == "cc"] or [c for c in below.get(by[i]["head"], []) if rel[c] == "cc" and c < i]
        return [leaf("CC", c) for c in own[:1]]

    def phrase(i: int, kind: str | None = None) -> str:
        kind = kind or _KIND.get(pos[i])
        if kind is None:
            if pos[i] == "ADP":
                return bracket("PP", leaf("P", i), *map(phrase, below[i]))
            return leaf("SCONJP" if pos[i] == "SCONJ" else pos[i], i)
        slots: dict[str, list[str]] = {name: [] for name in _SLOTS}
        slots["head"] = [leaf("V" if kind == "VP" else pos[i], i)]
        for c in below[i]:
            if rel[c] in PHRASE_RULES[kind]:
                slot, label, what = PHRASE_RULES[kind][rel[c]]
                built = leaf(label, c) if what == "leaf" else build(what, c)
                slots[slot].append(bracket(label, *(link(c) if rel[c] == "conj" else []), built) if label and what != "leaf" else built)
        return bracket(kind.split()[0], *(x for name in _SLOTS for x in slots[name]))

    def build(what: str, c: int) -> str:
        if what == "clause":
            return clause(c)
        if what == "word" or what == "modifier" and _KIND.get(pos[c]) != "ADJP":
            return leaf(pos[c], c)
        if what == "oblique":
            cases = [leaf("P", x) for x in below[c] if rel[x] == "case"]
            return bracket("PP", *cases, phrase(c, "NP of a PP")) if cases else phrase(c)
        return phrase(c, {"modifier": "ADJP", "phrase": None}.get(what, what))

    def clause(i: int, whole: bool = False) -> str:
        """A sentence: subject, then the predicate; a noun or adjective with a copula is one. `whole`: with what stands beside it."""
        kind = _KIND.get(pos[i])
        subject = [phrase(c, "NP") for c in below[i] if rel[c] in SUBJECTS][:1]
        if kind == "VP":
            beside = [bracket("Parataxis", clause(c)) if rel[c] == "parataxis" else bracket("Dislocated", phrase(c)) for c in below[i] if whole and rel[c] in ("parataxis", "dislocated")]
            return bracket("S", *subject, phrase(i, "VP"), *beside)
        if not whole and kind not in ("NP", "ADJP"):
            return bracket("S", phrase(i))
        return bracket("S", *subject, phrase(i, "VP" if any(rel[c] == "cop" for c in below[i]) else None))

    return clause(root, True)


def to_constituency(tokens: DataFrame) -> DataFrame:
    """(sent_id, tree)."""
    return sentence_arrays(tokens, "text", "pos", "dep", "head").select("sent_id", _sentence_udf(constituency)("tokens").alias("tree"))


def tree_shape(trees: DataFrame) -> DataFrame:
    """(sent_id, depth, leaves): levels of brackets and words of each tree of `to_constituency`, counted in the JVM."""
    steps = F.transform(F.regexp_extract_all("tree", F.lit(r"[()]"), F.lit(0)), lambda c: F.when(c == "(", 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deep = F.aggregate(steps, start, lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")))
    return trees.select("sent_id", deep["most"].cast("bigint").alias("depth"), F.regexp_count("tree", F.lit(r"\([^() ]+ [^()]+\)")).cast("bigint").alias("leaves"))


def decoded(code: Column, names: dict[str, str], missing: str | None = None) -> Column:
    """The name of a tag; an unknown tag stays as it is, an empty or null one is `missing`."""
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code), code)
    return known if missing is None else F.when(F.coalesce(code, F.lit("")) == "", missing).otherwise(known)


def attached(words: DataFrame) -> DataFrame:
    """`words` (sent_id, i, pos, ...) with dep and head by rules: a stand-in where no annotator is given.

    The root is the first verb, else the first word; determiners, adjectives, numbers and prepositions belong to the next
    noun behind them, everything else to the root. A sentence's words meet by its id; sentences are short by nature.
    """
    w = W.partitionBy("sent_id").orderBy("i")
    root = F.coalesce(F.min(F.when(F.col("pos") == "VERB", F.col("i"))).over(W.partitionBy("sent_id")), F.min("i").over(W.partitionBy("sent_id")))
    noun = F.min(F.when(F.col("pos") == "NOUN", F.col("i"))).over(w.rowsBetween(1, W.unboundedFollowing))
    d = words.withColumn("_root", root).withColumn("_noun", noun)
    leads = F.col("pos").isin("DET", "ADJ", "NUM", "ADP") & F.col("_noun").isNotNull()
    names = {"DET": "det", "ADJ": "amod", "NUM": "nummod", "ADP": "case"}
    dep = F.when(F.col("i") == F.col("_root"), "ROOT").when(leads, F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("pos")))
    dep = dep.when(F.col("pos") == "NOUN", F.when(F.col("i") < F.col("_root"), "nsubj").otherwise("obj")).when(F.col("pos") == "VERB", "conj").otherwise("dep")
    head = F.when((F.col("i") != F.col("_root")) & leads, F.col("_noun")).otherwise(F.col("_root"))
    return d.withColumn("dep", dep).withColumn("head", head.cast("int")).drop("_root", "_noun")
