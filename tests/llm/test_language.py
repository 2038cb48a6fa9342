"""Operators whose rules are fitted to languages: hand-written cases and odd inputs."""

import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions.labels import label_code
from glyphmill.llm import languages, pii, sentences


def split(text):
    return [text[a:b] for a, b in sentences.units(text)]


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Hale met Mrs. Voss at 5.30 p.m. on Jan. 3 near St. Bride Lane.", "It rained."],
        ["She waited... then left.", "“Who is there?” asked the clerk.", "‘No,’ he said, ‘nobody knows.’", "Fine!"],
        ["See vol. 2, no. 4, pp. 1-9, i.e. the maps, etc. and more.", "They use glass, paper, etc.", "All of it (approx. 3 pages, cf. ch. 4).", "(One more.)", "Done?!", "Yes."],
        ["El Sr. Ruiz vive en la Avda. del Sol, p. ej. cerca.", "—¿Quién es? —preguntó ella.", "¡Qué raro!", "Los EE. UU. ganaron."],
        ["В 1957 г. он уехал.", "В 1958 г. вернулся и т. д. Это", "Ул. им. героев закрыта."][:1] + ["См. стр. 5 и рис. 2.", "— Стой! — сказал он.", "«Кто там?» — спросил он."],
        ["Am 5. Mai kam Fr. Weiß, z. B. mit Nr. 7, Bd. 2 usw. und ging.", "„Wer ist da?“, fragte er.", "Gut."],
        ["« Qui est là ? » demanda M. Noir.", "Voir t. 2, p. 4.", "Il attendit... puis partit."],
        ["O Sr. Melo saiu.", "Ver pág. 3 e vol. 2."],
        ["他低声说：“快走！门开着。”", "读者找到了第3.5节。", "“谁来了？”成了一个问题。", "真的吗？"],
        ["「早く行け！」と先生は言った。", "彼は「まだ。待て」と言った。", "「やめろ！」", "とても古い歌だ。"],
        ["डॉ. वर्मा 3.5 बजे आए।", "क्या हुआ?"],
        ["ماذا حدث؟", "ذهب الرجل."],
    ],
)
def test_units(units):
    space = "" if units[0][0] in "他「" else " "
    assert split(space.join(units)) == units
    assert split("﻿  " + space.join(units) + " \n") == units


@pytest.mark.parametrize(
    "units",
    [
        ["何だ？と彼は思った。", "もう帰ろう！", "もちろん行く。"],
        ["彼は……知らなかった。", "行くよ……", "そして夜が来た。"],
        ["誰だ！？と叫んだ。", "行こう。と彼は言った。", "そうだね。", "と、その時扉が開いた。"],
        ["何だ?と彼は思った。", "にっこり笑った！", "とんでもない。", "のんびりしよう！", "はっきり言え。"],
        ["Yahoo！の株を買った。", "そうですか？", "はい。"],
        ["他……不知道。", "真的吗？", "的确如此！", "我们走。", "谁来了？的问题很难。"],
        ["夜は長い……", "朝が来た。"],
    ],
)
def test_words_on_both_sides_of_a_gap(units):
    assert split("".join(units)) == units


def test_blocks_cards_and_thai():
    assert split("Chapter 3\n\nOne line\nand another.\n \nLast") == ["Chapter 3", "One line\nand another.", "Last"]
    assert split("Title: A b. C\nYear: 1990\n\nNote: x") == ["Title: A b. C", "Year: 1990", "Note: x"]
    assert split("แมวนอน สุนัขวิ่ง9.5เมตร\n\nนก") == ["แมวนอน", "สุนัขวิ่ง9.5เมตร", "นก"]
    assert split("THE DR. LEFT. HE WAITED... THEN HE SANG. “WHO?” ASKED HE.") == ["THE DR. LEFT.", "HE WAITED... THEN HE SANG.", "“WHO?” ASKED HE."]
    assert split("") == split(" \n \t") == split("?! ... — —") == []


def test_units_are_ordered_and_inside_any_text():
    rng = random.Random(9)
    parts = ["Word ", "a. ", "B. ", "“", "”", "(", ")", "\n", "\n\n", "。", "「", "」", "แมว ", "3.5", "etc. ", "...", "? ", "— ", "'", '"', "﻿", "🙂 ", "Mr. "]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        at = 0
        for a, b in sentences.units(t):
            assert at <= a < b <= len(t) and t[a:b] == t[a:b].strip().strip("﻿").strip() and any(c.isalnum() for c in t[a:b])
            at = b
        assert sum(c.isalnum() for c in t) == sum(c.isalnum() for a, b in sentences.units(t) for c in t[a:b])


def test_sentence_rows(spark):
    d = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (4, "x" * 100_000 + ". End.")], "doc_id bigint, text string").withColumn("sent_start", F.lit(1))
    got = sentences.split_sentences(d, "doc_id", "text")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 4), (1, 5, 9), (4, 0, 100_001), (4, 100_002, 100_006)]
    assert sentences.split_sentences(d.limit(0), "doc_id", "text").collect() == []


def test_hostile_texts_take_linear_time():
    for piece, n, closing in (("(a ", 100_000, ""), ("“a ‘b ", 50_000, ""), ("(a. ", 50_000, ") " * 50_000), ("(" + "A b c. " * 50_000 + ")", 1, ""), ("a.b", 100_000, ". C"), ("กา ข ", 20_000, ""), ('"a b. ', 20_000, "")):
        began = time.perf_counter()
        list(sentences.units(piece * n + closing))
        assert time.perf_counter() - began < 2


@given(st.lists(st.sampled_from(["word", "Word", " ", ". ", "! ", "... ", "? ", "“", "”", '"', "(", ")", "Dr. ", "Mr. ", "sgt. ", "\n", "5 "]), max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_the_path_is_the_cheapest_choice_of_cuts(text):
    """Against all subsets of a block's first gaps."""
    gaps: list[tuple[int, float]] = []
    at = 0
    for m in sentences._GAP.finditer(text):
        gaps.append((m.end(), sentences._score(text, m.group(), m.start(), m.end(), False, 0)))
    gaps = gaps[:9]

    def cost(cuts):
        total, start, open_words, at = 0.0, 0, 0, 0
        for end, score in gaps:
            open_words, at = min(2, open_words + sentences._words(text, at, end)), end
            if end in cuts:
                total += max(0.0, -score) + (sentences.SHORT if open_words == 1 else 0.0)
                open_words = 0
            else:
                total += max(0.0, score)
        return total

    ends = [e for e, _ in gaps]
    best = min(cost(set(c)) for k in range(len(ends) + 1) for c in itertools.combinations(ends, k))
    assert cost(set(sentences._path(text, gaps))) == pytest.approx(best)


def test_the_path_decides_what_a_score_leaves_open():
    assert split("Bldg. Nord. It rained.") == ["Bldg. Nord.", "It rained."]
    assert split("They met in the old Bldg. It rained.") == ["They met in the old Bldg.", "It rained."]


def test_quotations_are_found_in_one_pass():
    for text, want in (("(a “b.) c” d", [(0, 7)]), ("“a (b.” c) d", [(0, 7)]), ("(a (b) c", [(3, 6)]), ("“a ‘b’ c”", [(0, 9)]), ("don't 'a b' c", [(6, 11)]), ('"a" b "c"', [(0, 3), (6, 9)]), ("a) b) (c)", [(6, 9)]), ("„a“ b «c»", [(0, 3), (6, 9)])):
        assert sentences._spans(text) == want, text


# --- p6 ---

SAMPLE = {
    "en": ["The captain found the old letter in the harbour. She opened the garden gate and waited. Nobody knew why the tower was closed.", "It was said that the river carried every map away. They praised the clock without a word."] * 3,
    "es": ["El capitán encontró la carta vieja en el puerto. Ella abrió la puerta del jardín y esperó. Nadie sabía por qué cerraron la torre.", "Se dice que el río llevó todos los mapas. Alabaron el reloj sin decir nada."] * 3,
    "de": ["Der Kapitän fand den alten Brief im Hafen. Sie öffnete das Gartentor und wartete. Niemand wusste, warum der Turm geschlossen war.", "Es heißt, der Fluss trug alle Karten fort. Sie lobten die Uhr ohne ein Wort."] * 3,
    "ru": ["Капитан нашёл старое письмо в порту. Она открыла ворота сада и ждала. Никто не знал, почему башня закрыта."] * 4,
    "zh": ["船长在港口找到了旧信。她打开了花园的门。没有人知道为什么。"] * 4,
    "ja": ["船長は港で古い手紙を見つけた。彼女は庭の門を開けた。誰も知らない。"] * 4,
}


def test_automaton_holds_all_and_only_factors():
    rng = random.Random(1)
    text = [rng.randint(1, 3) for _ in range(40)]
    table = languages.automaton(text, 4)

    def known(x):
        s = 0
        for c in x:
            s = table[s, c]
            if s < 0:
                return False
        return True

    for _ in range(500):
        x = [rng.randint(1, 3) for _ in range(rng.randint(1, 6))]
        assert known(x) == any(text[k : k + len(x)] == x for k in range(len(text)))


def test_phrases_against_greedy_parsing():
    model = languages.Model(SAMPLE)
    s = "The gate of the old harbour was open, capitán!"
    for lang in ("en", "es"):
        train = ["".join(c if c.isalpha() else " " for c in x.lower()) for x in SAMPLE[lang]]
        train = [" ".join(x.split(" ")) for x in train]
        codes = "".join(c if c.isalpha() else " " for c in s.lower())
        import re

        codes, train = re.sub(" +", " ", codes), [re.sub(" +", " ", x) for x in train]
        n, at = 0, 0
        while at < len(codes):
            if at and not any(codes[at] in x for x in train):
                at += 1  # an unknown letter is read with the phrase behind it
            e = at + 1
            while e <= len(codes) and any(codes[at:e] in x for x in train):
                e += 1
            at, n = max(at + 1, e - 1), n + 1
        costs, _ = model.read([s, "x" * 700])
        k = model.languages.index(lang)
        unknown = sum(c.isalpha() and not any(c in x for x in train) for c in codes)  # each a phrase of its own
        assert costs[0, k] == pytest.approx(n * model.weights[k] + unknown)


def test_noise_is_left_out_and_unspaced_text_is_not():
    rng = random.Random(9)
    model = languages._model(languages.train(SAMPLE))
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(900))
    plain = "She opened the garden gate and waited."
    a, n, _ = model._read([plain, f"{plain[:-1]} {noise}.", noise, plain.replace(" ", "") * 2], False)
    assert n.tolist()[:3] == [31, 31, 0] and np.allclose(a[0], a[1], atol=1.01) and n[3] == 62
    assert model.languages[int(np.argmin(a[3]))] == "en"


def test_languages_mixed_texts_and_nothing():
    model = languages._model(languages.train(SAMPLE))
    mixed = "She found the letter. The tower was closed. Nadie sabía por qué. Ella abrió la puerta del jardín. El río llevó los mapas."
    got = languages.segments(["Nobody opened the gate.", mixed, None, "", "12 ...", "El reloj está cerrado", "港で手紙を見つけた。", "🙂", "ಕನ್ನಡ"], model)
    assert [[x[2] for x in g] for g in got] == [["en"], ["en", "es"], [], [], [], ["es"], ["ja"], [], []]
    assert all(0 <= x[3] <= 1 for g in got for x in g) and [x[4] for x in got[1]] == [2, 3]
    assert languages.path(np.array([[0, 3.0], [2.0, 0], [0, 3.0]]), 4.0) == [0, 0, 0]


def test_rare_letters_keep_their_document(spark):
    model = languages._model(languages.train(SAMPLE))
    rare = ["鱷鯨鷗鸚鵡翱翔。", "ヌルヌルのウナギはペペロンチーノ。", "Њћђџ љњћ.", "𠀀𠀁𠀂𠀃𠀄"]
    got = languages.segments([*rare, "ಕನ್ನಡ", "123 456"], model)
    assert [[x[2] for x in g] for g in got[1:3]] == [["ja"], ["ru"]] and got[4:] == [[], []]
    assert all(len(got[k]) == 1 and got[k][0][2] in ("zh", "ja") for k in (0, 3)) and all(0 <= g[0][3] < 0.6 for g in got[:4])
    d = spark.createDataFrame([(i, x, None, None) for i, x in enumerate(rare)], "doc_id bigint, text string, s string, f string")
    found = languages.label_findings(languages.passages(d, "doc_id", "text", languages.train(SAMPLE), ["s", "f"]), "s", "f").collect()
    assert sorted(r.doc_id for r in found) == [0, 1, 2, 3]


def test_rich_scripts_keep_their_training_text():
    rng = random.Random(5)
    han = [chr(0x4E00 + k) for k in range(1750)]
    sentences_ = ["".join(rng.choice(han) for _ in range(100)) for _ in range(60)]
    whole, small = languages.Model({"zh": sentences_, "en": SAMPLE["en"]}), languages.Model({"zh": sentences_, "en": SAMPLE["en"]}, cells=10_000)
    costs, _ = whole.read(sentences_)
    assert (costs[:, 1] == whole.weights[1]).all()  # each is known as a whole
    mixed = [*SAMPLE["en"], *["".join(rng.choice(han) for _ in range(rng.randint(1, 600))) for _ in range(30)], sentences_[0][:50] + "x" + sentences_[1][50:]]
    dense = languages.Model({"zh": sentences_, "en": SAMPLE["en"]}, cells=10**9)
    assert np.array_equal(dense.read(mixed)[0], whole.read(mixed)[0]) and np.array_equal(dense.read(mixed)[0], small.read(mixed)[0])


def test_lanes_go_on_where_the_one_before_ends(monkeypatch):
    model, rng = languages._model(languages.train(SAMPLE)), random.Random(3)
    pool = [x for texts in SAMPLE.values() for t in texts for x in t.split()]
    long = [" ".join(rng.choice(pool) for _ in range(n)) for n in (3, 200, 900)] + ["".join(rng.choice("abcdefgh") for _ in range(3000))]
    wide = []
    for lane in (256, 7, 10**6):
        monkeypatch.setattr(languages, "LANE", lane)
        wide.append(model.read(long)[0])
    assert np.allclose(wide[0], wide[1]) and np.allclose(wide[0], wide[2]) and np.isfinite(wide[0]).any()


def test_a_repeated_row_counts_once(spark):
    d = spark.createDataFrame([(1, "She opened the garden gate. Nobody knew why. El capitán encontró la carta.", "en", "en")] * 3, "doc_id bigint, text string, s string, f string")
    assert languages.label_findings(languages.passages(d, "doc_id", "text", languages.train(SAMPLE), ["s", "f"]), "s", "f").collect() == []


def test_label_findings(spark):
    texts = {1: "The captain found the old letter.", 2: "El capitán encontró la carta.", 3: "The tower was closed. She waited. Ella abrió la puerta. Nadie sabía por qué cerraron la torre.", 4: "??", 5: None, 6: "Nobody knew why.", 7: "She opened the gate."}
    labels = {1: ("en-US", "ENGLISH "), 2: ("en", "spanish"), 3: ("en", "en"), 4: (None, None), 5: ("en", "en"), 6: ("und", "en"), 7: ("English", "")}
    d = spark.createDataFrame([(i, texts[i], *labels[i]) for i in texts], "doc_id bigint, text string, source string, final string")
    d = d.withColumn("s", label_code(F.col("source"))).withColumn("f", label_code(F.col("final"))).withColumn("language", F.lit("?"))
    found = languages.passages(d, "doc_id", "text", languages.train(SAMPLE), ["s", "f"])
    got = {(r.doc_id, r.language) for r in languages.label_findings(found, "s", "f").collect()}
    assert got == {(2, "es"), (3, "en"), (3, "es"), (6, "en"), (7, "en")}
    assert languages.label_findings(languages.passages(d.limit(0), "doc_id", "text", languages.train(SAMPLE), ["s", "f"]), "s", "f").collect() == []


# --- p9 ---

FRAMES = {
    "en": (["Please ask for {} or call.", "The letter was signed by {}, of Harrow.", "{} can be reached at noon.", "A note from {} and the clerk."], "Hale Voss Galdby Marl", "Nell Iris Clara"),
    "es": (["La carta de {} llegó ayer.", "Según {}, con domicilio en Lugo, no.", "{} responde en el número."], "Ruiz Montal Olmer", "Mateo Elvira"),
    "ru": (["Письмо от {} пришло.", "{} отвечает по телефону.", "Спросите {} или позвоните."], "Сумракин Лозвин Тальник", "Егор Варвара"),
    "de": (["Der Brief von {} kam an.", "{} ist unter der Nummer da.", "Frag nach {} oder ruf an."], "Falkun Lozberg Brandt", "Lothar Helga"),
    "fr": (["La lettre de {} est venue.", "Demandez {} ou appelez.", "{}, demeurant au village, part."], "Lormel Marcel Tonnar", "Mireille Anatole"),
    "pt": (["A carta de {} chegou.", "Pergunte por {} ou ligue.", "{} mora em casa."], "Melo Torres Queiroz", "Rui Leonor"),
}
UNSEEN = {"en": "Kwame", "es": "Xiomara", "ru": "Аграфена", "de": "Thorvald", "fr": "Ghislaine", "pt": "Jandira"}


def name_sample():
    """Texts in which known names stand in ordinary contexts, beside capital words that are none."""
    out = []
    for frames, families, known in FRAMES.values():
        out += [" ".join(f.format(f"{g} {x}") for f in frames) for g in known.split() for x in families.split()]
    out += ["The Old Harbour was closed. At Port Harrow the Great Tower fell. In Quillmoor Lane it rained. By River Street we met."] * 20
    return out


NAMES = pii.learn(name_sample(), {"Nell", "Iris", "Clara", "Mateo", "Elvira", "Егор", "Варвара", "Lothar", "Helga", "Mireille", "Anatole", "Rui", "Leonor"})


@pytest.mark.parametrize("lang", sorted(FRAMES))
def test_unseen_names_are_learned_from_their_contexts(lang):
    frames, families, _ = FRAMES[lang]
    given, family = UNSEEN[lang], families.split()[0]
    texts = name_sample() + [" ".join(f.format(f"{given} {x}") for f in frames) for x in families.split()]
    model = pii.learn(texts, {"nell", "mateo", "егор", "lothar", "mireille", "rui"})
    assert given.lower() in model.given and not {"port", "quillmoor", "the", "river", "old"} & model.given
    elsewhere = f"Xyz {given} {family} xyz."
    assert [(k, elsewhere[a:b]) for k, a, b in pii.find(elsewhere, model)] == [("name", f"{given} {family}")]


def test_any_family_name_may_follow_a_title_or_a_given_name():
    for family in ("Orlow", "Parcels", "Marlow", "Baker"):
        for text, want in ((f"Dr. {family} came in.", family), (f"Nell {family} came in.", f"Nell {family}")):
            assert [text[a:b] for _, a, b in pii.find(text, NAMES)] == [want]
    assert pii.find("Orlow Press Inc. stood by St. Orlow Bridge.", NAMES) == []
    nothing = pii.learn([], ())
    assert pii.find("Kwame Mensah wrote.", nothing) == [] and pii.learn(["Ann Lee", ""], ()).given == frozenset()


def test_checksums_confirm_cards_and_accounts():
    def ids(text):
        return [text[a:b] for k, a, b in pii.find(text, NAMES) if k == "idno"]

    assert ids("Paid with 4539 1488 0343 6467, not 4539 1488 0343 6468.") == ["4539 1488 0343 6467"]
    assert ids("To GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33.") == ["GB82 WEST 1234 5698 7654 32"]
    assert ids("Order 4539148803436467 was sent.") == []
    corsican = "1 99 05 2A 081 025"
    assert pii._nir(f"{corsican} {97 - int('1990519081025') % 97:02d}") and not pii._nir(f"{corsican} 00")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to nell.hale+x@mail.example.org, or a (at) b (dot) org.", ["email:nell.hale+x@mail.example.org", "email:a (at) b (dot) org"]),
        ("The template says name@domain; @night_owl said so.", []),
        ("Call +1 802 555 0165, (914) 555-0187 or 020 7946 0183. ISBN 978-0-208-165-0, row 222 313 279.", ["phone:+1 802 555 0165", "phone:(914) 555-0187", "phone:020 7946 0183"]),
        ("Responde en el 0034-555537161 y en el 555 11 21 21; +49 (0)30 23125 333, 030/23125-640, 01.99.00.88.61, 8 000 548 57 16.", ["phone:0034-555537161", "phone:555 11 21 21", "phone:+49 (0)30 23125 333", "phone:030/23125-640", "phone:01.99.00.88.61", "phone:8 000 548 57 16"]),
        ("El DNI es 99.771.878-V. ID QQ305420D, number 911 25 2392; СНИЛС 000-450-791 97.", ["idno:99.771.878-V", "idno:QQ305420D", "idno:911 25 2392", "idno:000-450-791 97"]),
        ("Order 2045-368147 of vol. 2, code 123-239-165, at 1.56 p.m. on 01/14/2057, version 3.1.4.", []),
        ("Send it to Flat 3, 153b Thistley Lane, Apt 4 or 12 Elm St. The road was long.", ["addr:Flat 3, 153b Thistley Lane, Apt 4", "addr:12 Elm St"]),
        ("A Calle Barramate n.º 156, piso 3. Живёт: ул. Лозовая, дом 3, кв. 62. In der Falkunallee 17b. Au 45 bis, quai des Tonnargonnet.", ["addr:Calle Barramate n.º 156, piso 3", "addr:ул. Лозовая, дом 3, кв. 62", "addr:Falkunallee 17b", "addr:45 bis, quai des Tonnargonnet"]),
        ("Nell Galdby’s map. Form signed by Fenworley, Nell (x). Dr. Hale saw T. B. Osterwick.", ["name:Nell Galdby", "name:Fenworley, Nell", "name:Hale", "name:T. B. Osterwick"]),
        ("The ferry Nell left Port Harrow. Quillmoor Lane was long. Galdwick & Sons Ltd. and the U.K. Parcel Office.", []),
        ("Ask for Zofia Galdby or call. La Sra. Montalique vive aquí. Mateo Torriique Villoranza responde.", ["name:Zofia Galdby", "name:Montalique", "name:Mateo Torriique Villoranza"]),
        ("Author: GALDBY, NELL\nYear: 1990\nTitle: The Sea", ["name:GALDBY, NELL"]),
        ("M. Lornley found the museum in her town. Then M. Galdby left the room.", ["name:M. Lornley", "name:M. Galdby"]),
        ("M. Louvartier oublia ce signal dans la salle. Puis M. Marcelvault traduisit les clés.", ["name:Louvartier", "name:Marcelvault"]),
        ("R. Witherstead came last. Nell Harrowrod left first.", ["name:R. Witherstead", "name:Nell Harrowrod"]),
        ("Егор Сумракин ждёт. Г-н Лозвятский ушёл.", ["name:Егор Сумракин", "name:Лозвятский"]),
        ("", []),
    ],
)
def test_personal_information(text, want):
    assert [f"{k}:{text[a:b]}" for k, a, b in pii.find(text, NAMES)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("020 7946 0958\n020 7946 0999", ["phone:020 7946 0958", "phone:020 7946 0999"]),
        ("+44 20 7946 0958 / +44 20 7946 0959", ["phone:+44 20 7946 0958", "phone:+44 20 7946 0959"]),
        ("ID 911 25 2392 020 7946 0999", ["idno:911 25 2392", "phone:020 7946 0999"]),
        ("+44 20 7946 0958 020 7946 0999", ["phone:+44 20 7946 0958", "phone:020 7946 0999"]),
        ("0034-555537161 0034-555537162", ["phone:0034-555537161", "phone:0034-555537162"]),
        ("+1 802 555 0165 (914) 555-0187", ["phone:+1 802 555 0165", "phone:(914) 555-0187"]),
        ("+33 1 99 00 88 61 01 99 00 88 62", ["phone:+33 1 99 00 88 61", "phone:01 99 00 88 62"]),
        ("+44 20 7946 0958 12.5.2057", ["phone:+44 20 7946 0958"]),
        ("+44 20 7946 0958\n+44 20 7946 0959\n+44 20 7946 0957", ["phone:+44 20 7946 0958", "phone:+44 20 7946 0959", "phone:+44 20 7946 0957"]),
    ],
)
def test_every_number_of_a_cluster(text, want):
    assert [f"{k}:{text[a:b]}" for k, a, b in pii.find(text, NAMES)] == want
    assert not any(c.isdigit() for c in pii.redact(text, NAMES)) or "12.5.2057" in text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("At 12 Baker\nStreet now.", ["addr:12 Baker\nStreet"]),
        ("Am Lindenweg\u00a012 bald.", ["addr:Lindenweg\u00a012"]),
        ("Am Mühlenplatz\n3 bald.", ["addr:Mühlenplatz\n3"]),
        ("Na rua\nAugusta 12.", ["addr:rua\nAugusta 12"]),
        ("İ. 12 Baker Street.", ["addr:12 Baker Street"]),
        ("İ. Calle Mayor 12. CAMİNO Mayor 3. Paſeo Mayor 4.", ["addr:Calle Mayor 12", "addr:CAMİNO Mayor 3", "addr:Paſeo Mayor 4"]),
        ("İ. Au 45, Rue Lormel.", ["addr:45, Rue Lormel"]),
        ("Mail ann{at}host.org.", ["email:ann{at}host.org"]),
        ("Mail ann(ät)host.de or bob[ AT ]host.de.", ["email:ann(ät)host.de", "email:bob[ AT ]host.de"]),
        ("Mail ann(at\u00a0)host.org.", ["email:ann(at\u00a0)host.org"]),
    ],
)
def test_nothing_is_passed_over_before_the_patterns(text, want):
    assert [f"{k}:{text[a:b]}" for k, a, b in pii.find(text, NAMES)] == want
    assert len(pii._lower(text)) == len(text)


def test_checksums():
    assert pii._dni("12345678Z") and not pii._dni("12345678A")
    assert pii.luhn("4539 1488 0343 6467") and not pii.luhn("4539 1488 0343 6468")
    assert pii.iban("GB82 WEST 1234 5698 7654 32") and not pii.iban("GB82 WEST 1234 5698 7654 33")
    assert pii._tax_id("86 095 742 719") and pii._snils("112-233-445 95") and pii._nir("255081416802538")


def test_redaction_keeps_the_rest(spark):
    d = spark.createDataFrame([(1, "Mail a@b.org now."), (2, None), (3, ""), (4, "Nell Hale, 12 Elm St.")], "doc_id bigint, text string").withColumn("pii_kind", F.lit("x"))
    got = {r.doc_id: r.text for r in pii.redact_personal(d, "doc_id", "text", spark.createDataFrame([("Nell",)], "name string")).collect()}
    assert got == {1: "Mail [EMAIL] now.", 2: None, 3: "", 4: "[NAME], [ADDRESS]."}
    assert pii.find_personal(d.limit(0), "doc_id", "text").collect() == []


def test_large_tables_of_names_are_joined(spark):
    rows = [(i, f"The {x} Hale came. Nell Voss left." if i % 7 else None) for i, x in enumerate(["Ann", "Zed", "Bo", "Nell", ""] * 8)]
    d = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string").withColumn("n", F.lit("x")).withColumn("known", F.lit(1))
    names = spark.createDataFrame([("Ann",), ("Bo ",), ("NELL",), (None,), (" ",), ("Nell",)], "name string")
    sent, joined = (pii.find_personal(d, "doc_id", "text", names, most_names=n).collect() for n in (10, 2))
    assert sorted(map(tuple, sent)) == sorted(map(tuple, joined)) and {r.pii_kind for r in sent} == {"name"} and len(sent) > 30
    redacted = {r.doc_id: r.text for r in pii.redact_personal(d, "doc_id", "text", names, most_names=2).collect()}
    assert redacted[1] == "The Zed Hale came. [NAME] left." and redacted[7] is None


def test_names_are_learned_from_all_texts(spark):
    frames, families, _ = FRAMES["en"]
    seen, unseen = (" ".join(f.format(f"{g} {x}") for f in frames for x in families.split()) for g in ("Nell", UNSEEN["en"]))
    calm = "the water was calm. " * 400
    elsewhere = f"Xyz {UNSEEN['en']} {families.split()[0]} xyz iPhone phone."
    jenes = " ".join(f.format(f"Jenes {x}") for f in frames for x in families.split()) + " jenes Bild" * 50
    texts = [jenes, calm + seen + "\n\n" + calm + unseen + "\n\n" + calm, elsewhere, *name_sample(), None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    names = spark.createDataFrame([("Nell",), ("mateo ",), ("Егор",), ("Lothar",), (None,)], "name string")
    plain = pii.learn([t for t in texts if t], {"nell", "mateo", "егор", "lothar"})
    facts, prior = pii.learned(d, "text", pii._terms(names, "name"))
    model = pii.Names.of(facts.collect(), prior)
    assert UNSEEN["en"].lower() in model.given and (model.given, model.odds, model.prior) == (plain.given, plain.odds, plain.prior)
    assert "jenes" not in model.given  # it stands like a name, but most often in small letters
    assert model.ordinary < plain.ordinary and "phone" in model.ordinary
    want = sorted((i, *x) for i, t in enumerate(texts) if t for x in pii.find(t, plain))
    assert (2, "name", 4, elsewhere.index(" xyz iPhone")) in want
    for most in (100_000, 1):
        assert sorted(map(tuple, pii.find_personal(d, "doc_id", "text", names, most_names=most).collect())) == want
