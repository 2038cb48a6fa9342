"""Word lists, profiles, dictionaries and small tables, each as plain data, a DataFrame and SQL VALUES."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

# Stopwords; a parameter of the operators that use them.
STOPWORDS = {
    "en": "a about after again all also although am an and another any are as at be because been before behind being between both but by can could did do does doing down during each every few for from had has have having he her here hers him his how i if in into is it its just me more most my never no nobody nor not now of off on once one only or other our out over own same she should since so some such than that the their them then there these they this those through to too two under until up us very was we were what when where which while who whom why will with without would you your".split(),
    "ru": "а без был была были было быть в вам вас во вот все всё вы где да даже для до его ее её если есть еще ещё же за и из или им их к как ко когда кто ли много мне мы на над не него нет ни но ну о об он она они от по под после при с свой сам себе со так также там то тоже тот у уже чего чем что чтобы эта эти это этот я".split(),
}


@dataclass
class LanguageTools:
    """Stopwords of a language and what brings its words to their normal form."""

    stopwords: tuple[str, ...]
    normalize: Callable[[Column], Column]


_TOOLS: dict[str, LanguageTools] = {}
_SPARK_NAMES = {"es": "spanish", "de": "german", "fr": "french", "pt": "portuguese"}


def register_language(language: str, stopwords: Sequence[str], normalize: Callable[[Column], Column] = lambda w: w) -> None:
    """Sets or replaces the tools of a language, for example by a stemmer as a pandas UDF."""
    _TOOLS[language] = LanguageTools(tuple(stopwords), normalize)


def language_tools(language: str) -> LanguageTools:
    """The registered tools; by default English and Russian stopwords from here and Spark's for Spanish, German, French and Portuguese."""
    if language not in _TOOLS:
        if language in STOPWORDS:
            register_language(language, STOPWORDS[language])
        elif language in _SPARK_NAMES:
            from pyspark.ml.feature import StopWordsRemover

            register_language(language, StopWordsRemover.loadDefaultStopWords(_SPARK_NAMES[language]))
        else:
            raise ValueError(f"no tools for language {language}")
    return _TOOLS[language]


def sql_list(words: Sequence[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


@dataclass(frozen=True)
class Table:
    """A small fixed table."""

    schema: str
    rows: tuple[tuple, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(",")]

    def values(self) -> str:
        """A SQL query that gives the rows."""
        kinds = [c.split()[1] for c in self.schema.split(",")]

        def literal(x, kind: str) -> str:
            sql = {"string": "varchar"}.get(kind, kind)
            if x is None:
                return f"cast(null as {sql})"
            return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"cast({x} as {sql})"

        body = ", ".join("(" + ", ".join(literal(x, k) for x, k in zip(r, kinds, strict=True)) + ")" for r in self.rows)
        return f"(select * from (values {body}) as t({', '.join(self.columns)}))"


#: Bilingual dictionary: several parts of speech per word, lookups fall back to the first row of a word.
DICTIONARY = Table(
    "id bigint, source_word string, source_form string, target_word string, pos string, tag string, morph string, translation_source string",
    tuple(
        (k + 1, w, f, t, p, g, "", "manual")
        for k, (w, f, t, p, g) in enumerate(
            [
                ("archive", "archive", "архив", "NOUN", "NN"),
                ("bridge", "bridge", "мост", "NOUN", "NN"),
                ("bridge", "bridged", "соединять", "VERB", "VBD"),
                ("captain", "captain", "капитан", "NOUN", "NN"),
                ("comet", "comet", "комета", "NOUN", "NN"),
                ("copy", "copied", "копировать", "VERB", "VBD"),
                ("copy", "copy", "копия", "NOUN", "NN"),
                ("drum", "drum", "барабан", "NOUN", "NN"),
                ("draw", "drew", "рисовать", "VERB", "VBD"),
                ("engine", "engine", "двигатель", "NOUN", "NN"),
                ("famous", "famous", "знаменитый", "ADJ", "JJ"),
                ("forest", "forest", "лес", "NOUN", "NN"),
                ("garden", "garden", "сад", "NOUN", "NN"),
                ("harbour", "harbour", "гавань", "NOUN", "NN"),
                ("letter", "letter", "письмо", "NOUN", "NN"),
                ("must", "must", "должен", "AUX", "MD"),
                ("north", "north", "север", "NOUN", "NN"),
                ("open", "opened", "открывать", "VERB", "VBD"),
                ("quiet", "quiet", "тихий", "ADJ", "JJ"),
                ("quietly", "quietly", "тихо", "ADV", "RB"),
                ("sell", "sold", "продавать", "VERB", "VBD"),
                ("tower", "tower", "башня", "NOUN", "NN"),
                ("old", "old", "старый", "ADJ", "JJ"),
                ("find", "found", "находить", "VERB", "VBD"),
                ("rain", "rain", "дождь", "NOUN", "NN"),
            ]
        )
    ),
)

#: New entries for the dictionary; empty grammar keeps what is there.
DICTIONARY_CHANGES = Table(
    "source_word string, source_form string, target_word string, pos string, tag string, morph string, translation_source string",
    (("drum", "", "барабан большой", "NOUN", "", "", "imported"), ("violin", "violin", "скрипка", "NOUN", "NN", "", "imported"), ("old", "older", "старый", "ADJ", "JJR", "Degree=Cmp", "manual")),
)

DICTIONARY_LINES = Table(
    "line_no bigint, line string",
    ((1, "# a comment"), (2, "tower\tбашня\tNOUN\tNN"), (3, "rain | дождь | NOUN"), (4, "old; старый; ADJ; JJ; Degree=Pos"), (5, "sea, море"), (6, "alone"), (7, ""), (8, "  "), (9, "a|b\tc|d"), (10, "| пусто"), (11, "x;"), (12, "word, слово, NOUN, NN, Number=Sing, more")),
)

# Names of universal parts of speech, relations, Penn tags and tags of Russian morphology, in Russian.
POS_NAMES = {
    "ADJ": "прилагательное", "ADP": "предлог/послелог", "ADV": "наречие", "AUX": "вспомогательный глагол", "CCONJ": "сочинительный союз", "DET": "детерминатив", "INTJ": "междометие", "NOUN": "существительное", "NUM": "числительное",
    "PART": "частица", "PRON": "местоимение", "PROPN": "собственное существительное", "PUNCT": "пунктуация", "SCONJ": "подчинительный союз", "SYM": "символ", "VERB": "глагол", "X": "другое", "SPACE": "пробел",
}
DEP_NAMES = {
    "nsubj": "подлежащее", "obj": "прямое дополнение", "dobj": "прямое дополнение", "iobj": "косвенное дополнение", "pobj": "косвенное дополнение", "obl": "обстоятельственный член", "aux": "вспомогательный глагол",
    "aux:pass": "вспомогательный глагол пассива", "auxpass": "вспомогательный глагол пассива", "cop": "связка", "case": "падежный маркер", "mark": "подчинительный союз", "amod": "согласованное определение",
    "nummod": "числительное-определение", "nmod": "несогласованное определение", "appos": "приложение", "det": "детерминатив", "advmod": "обстоятельство", "advcl": "обстоятельственное придаточное",
    "xcomp": "открытое дополнительное придаточное", "ccomp": "дополнительное придаточное", "cc": "сочинительный союз", "conj": "сочинённая связь", "fixed": "устойчивое выражение", "dep": "неопределённая зависимость",
    "root": "главное слово", "punct": "пунктуация", "parataxis": "партаксис", "discourse": "дискурсивный элемент", "vocative": "обращение", "expl": "формальное слово", "clf": "классификатор", "acl": "причастный оборот",
    "acl:relcl": "относительное придаточное", "relcl": "относительное придаточное", "compound": "сложное слово", "flat": "плоская структура", "list": "список", "orphan": "пропущенная зависимость",
    "reparandum": "исправление", "goeswith": "продолжение слова", "obl:agent": "агентный падеж", "agent": "агентный падеж", "prep": "предлог",
}
TAG_NAMES = {
    "NN": "Сущ. ед.ч.", "NNS": "Сущ. мн.ч.", "NNP": "Имя собств.", "NNPS": "Имя собств. мн.ч.", "VB": "Глагол (базовая)", "VBD": "Глагол прош.", "VBG": "Герундий", "VBN": "Причастие прош.", "VBP": "Глагол наст.",
    "VBZ": "Глагол 3л. ед.ч.", "JJ": "Прилагательное", "JJR": "Прил. сравн.", "JJS": "Прил. прев.", "RB": "Наречие", "RBR": "Нареч. сравн.", "RBS": "Нареч. прев.", "DT": "Артикль/опред.", "IN": "Предлог/союз",
    "PRP": "Мест. личное", "PRP$": "Мест. притяж.", "CC": "Сочин. союз", "CD": "Числительное", "MD": "Модальный", "TO": "Частица to", "WRB": "Вопрос. нареч.", "WP": "Вопрос. мест.", "WDT": "Вопрос. опред.",
}
MORPH_NAMES = {
    "NOUN": "существительное", "ADJF": "прилагательное", "ADJS": "краткое прилагательное", "COMP": "компаратив", "VERB": "глагол", "INFN": "инфинитив", "PRTF": "причастие", "PRTS": "краткое причастие", "GRND": "деепричастие",
    "NUMR": "числительное", "NUMB": "число", "ADVB": "наречие", "NPRO": "местоимение", "PRED": "предикатив", "PREP": "предлог", "CONJ": "союз", "PRCL": "частица", "INTJ": "междометие", "UNK": "неизвестно",
}
#: Part-of-speech names of the tokens table.
TOKEN_POS = {"Существительное": "NOUN", "Определитель": "DET", "Глагол": "VERB", "Прилагательное": "ADJ", "Предлог": "ADP", "Число": "NUM"}
DEPS = Table("dep string, dep_name string", tuple(DEP_NAMES.items()))
TAGS = Table("tag string, tag_name string", tuple(TAG_NAMES.items()))
POS = Table("pos string, pos_name string", tuple(POS_NAMES.items()))

#: Parts of speech that translation skips, and auxiliary verbs but modal ones (tag MD).
SKIPPED_POS = ("DET", "PART", "PUNCT", "SPACE", "SYM")

#: Annotated sentences: i counts from 0 in a sentence, a root is its own head.
TOKENS = Table(
    "sent_id bigint, i int, text string, lemma string, pos string, tag string, dep string, head int",
    (
        (1, 0, "The", "the", "DET", "DT", "det", 2), (1, 1, "old", "old", "ADJ", "JJ", "amod", 2), (1, 2, "captain", "captain", "NOUN", "NN", "nsubj", 4), (1, 3, "quietly", "quietly", "ADV", "RB", "advmod", 4), (1, 4, "opened", "open", "VERB", "VBD", "ROOT", 4), (1, 5, "the", "the", "DET", "DT", "det", 6), (1, 6, "archive", "archive", "NOUN", "NN", "obj", 4), (1, 7, ".", ".", "PUNCT", ".", "punct", 4),
        (2, 0, "She", "she", "PRON", "PRP", "nsubj", 2), (2, 1, "has", "have", "AUX", "VBZ", "aux", 2), (2, 2, "found", "find", "VERB", "VBN", "ROOT", 2), (2, 3, "letters", "letter", "NOUN", "NNS", "obj", 2), (2, 4, "and", "and", "CCONJ", "CC", "cc", 3), (2, 5, "drums", "drum", "NOUN", "NNS", "conj", 3), (2, 6, "in", "in", "ADP", "IN", "case", 8), (2, 7, "the", "the", "DET", "DT", "det", 8), (2, 8, "forest", "forest", "NOUN", "NN", "obl", 2), (2, 9, ".", ".", "PUNCT", ".", "punct", 2),
        (3, 0, "Captains", "captain", "NOUN", "NNS", "nsubj", 2), (3, 1, "must", "must", "AUX", "MD", "aux", 2), (3, 2, "copy", "copy", "VERB", "VB", "ROOT", 2), (3, 3, "maps", "map", "NOUN", "NNS", "obj", 2), (3, 4, "!", "!", "PUNCT", ".", "punct", 2),
        (4, 0, "Quiet", "quiet", "ADJ", "JJ", "amod", 1), (4, 1, "gardens", "garden", "NOUN", "NNS", "ROOT", 1), (4, 2, "that", "that", "PRON", "WDT", "nsubj", 3), (4, 3, "sold", "sell", "VERB", "VBD", "acl:relcl", 1),
        (5, 0, "The", "the", "DET", "DT", "det", 1), (5, 1, "tower", "tower", "NOUN", "NN", "nsubj", 3), (5, 2, "is", "be", "AUX", "VBZ", "cop", 3), (5, 3, "famous", "famous", "ADJ", "JJ", "ROOT", 3), (5, 4, ".", ".", "PUNCT", ".", "punct", 3),
    ),
)

COMMANDS = Table(
    "id bigint, text string",
    (
        (1, "найди в тексте комета"), (2, 'Please, find "the old captain"'), (3, "Пожалуйста, переведи документ на английский"), (4, "translate the document into Russian."), (5, "сделай реферирование документа"), (6, "summarize this text"), (7, "озвучь файл"), (8, "read aloud the document!"), (9, "translate the text"), (10, "find"), (11, "dance"), (12, ""), (13, None), (14, "find comet and translate it"), (15, "search for: quiet garden"),
        (16, "summarize the document now please"), (17, 'find "open quote'), (18, "поищи «старая башня»"), (19, "look  for towers"), (20, "прочитай вслух текст."), (21, "переведи на русский язык"), (22, 'find "find and read" '), (23, "make a summary of the document"), (24, 'find "a" b'),
    ),
)

FILE_EVENTS = Table(
    "event_no bigint, path string, kind string, dest_path string, seen_at double, size bigint, mtime bigint",
    (
        (1, "a.txt", "created", None, 0.0, 10, 100), (2, "a.txt", "modified", None, 0.4, 20, 101), (3, "a.txt", "modified", None, 0.9, 30, 102), (4, "a.txt", "modified", None, 1.0, 30, 102), (5, "b.txt", "created", None, 1.1, 5, 90), (6, "b.txt", "moved", "c.txt", 2.5, 5, 90), (7, "a.txt", "modified", None, 1.9, 31, 103), (8, "a.txt", "deleted", None, 2.6, None, None), (9, "d.pdf", "created", None, 3.0, 7, 80), (10, "d.pdf", "modified", None, 3.2, 7, 80),
    ),
)

NAMES_TO_SORT = Table("name string", tuple((x,) for x in ("Chapter 10", "Chapter 2", "chapter 1", "Chapter 2b", "10 notes", "2 notes", "Part 3 chapter 11", "Part 3 chapter 2", "", "007", "Том 2", "Том 10")))

TEXTS = Table(
    "id bigint, text string",
    (
        (1, ""), (2, "   \n "), (3, "No final punctuation here"), (4, "...Leading dots. And a second sentence here?"), (5, "First paragraph ends here.\r\n\r\nSecond paragraph starts there.\r\n\r\n\r\n\r\nThird one is the last."), (6, "Emoji 🙂 and � and​zero width"), (7, "Короткий русский текст для проверки."), (8, "tab\tand  spaces   here \n\n\n\n end"), (9, "bell\u0007 inside"), (10, "Ünïcode ñandú 12 <b>&amp;</b> \"quoted\" 'x'"), (11, None), (12, "12345 67890"), (13, "line sep soft­hyphen"),
    ),
)

PAGES = Table(
    "id bigint, html string",
    (
        (1, "<html><head><title>A page</title><style>p{}</style></head><body><p>One &amp; two</p><script>x<y</script><p>three</p></body></html>"), (2, "plain"), (3, None), (4, "<TITLE> Upper </TITLE><div>a<br/>b&nbsp;c &lt;d&gt;</div>"),
    ),
)

CACHE = Table("doc_id bigint, action string, file_hash string, language string", ((1, "summary", "h1", "en"), (1, "speech", "h0", "en"), (2, "summary", "h2", "ru"), (3, "summary", "h3", "en")))
CACHE_NOW = Table("doc_id bigint, file_hash string, language string", ((1, "h1", "en"), (2, "h2", "en"), (4, "h4", "ru")))
LCIDS = Table("code string", (("409",), ("809",), ("c09",), ("419",), ("1009",), ("",), ("zz",), ("409;9",), ("407; 809",), ("9",), ("0x1409",), ("1809;409",), ("7c09",)))
REFERENCES = Table("ref_no bigint, reference string", ((1, "mikax-tahun-9200"), (2, "Chapter"), (3, "no such document at all"), (4, "  "), (5, "comet.")))
VOICES = Table("voice_id string, locale string, name string", (("v1", "en-US", "Ann"), ("v2", "en-GB", "Ben"), ("v1", "en-US", "Ann"), ("v3", "ru-RU", "Vera"), ("", "en-US", "None"), ("v4", "en-AU", "Cat")))

#: Sentences for a small classifier that needs no corpus.
STUB_SENTENCES = {
    "en": ("the old harbour is quiet in the early morning", "she opened the letter and read it with a smile", "we will walk to the station when the rain stops", "the map shows a road between the river and the hill"),
    "es": ("el viejo puerto está tranquilo por la mañana", "ella abrió la carta y la leyó con una sonrisa", "caminaremos a la estación cuando pare la lluvia", "el mapa muestra un camino entre el río y la colina"),
}
