from collections import Counter

import pytest

from kgspark.llm import sentences as S

# Hand-made text: paragraphs of sentences. | marks the ends within a paragraph.
PROSE = """Dr. Lee met Mr. Ray at 4 p.m.| The talk, e.g. on trees, was short.| It cost $ 3.50 per seat.
She read Vol. 3 of the set.| Then she left, cf. Fig. 12.| The file notes.txt holds it all.
Prof. A. B. Kahn wrote “It is done.”| No one came!| “Why not?” asked Kim, but Lou went on.
Wait ... then it stopped.| The U.S. team won.| They sold nodes, edges, etc.| All was well.
Der Weg ist ca. 5 km lang.| Siehe Nr. 7 bzw. Abb. 8.| Das gilt für Hunde, Katzen usw.| Am 2. Mai kam er.
今天下雨。|她写道：“结束了。”|为什么？|后来……又停了。
「足りますか？」と彼は言った。|終わった。|なぜ？
Ο κόμβος είναι εδώ.| Γιατί εξαρτάται ο Νίκος;| Δείτε την εικ. 66.| Τέλος.
यह पेड़ है।| डॉ. राम ने 3 खंड पढ़े।| क्या हुआ?
قال د. سامي إن الأمر انتهى.| لماذا؟| الزمن 40.10 ثانية.
Узел связан, т. е. всё хорошо.| «Хватит ли?» — спросил автор.| Там узлы, рёбра и т. д.| Конец.
«Arrêtez ! » cria Luc.| Le n° 5 (p. 9) décrit tout, p. ex. ici.| Quel jour !| Fin.
—¿Cabe todo? —preguntó Ana.| ¡No borres nada!| EE. UU. guarda la copia, p. ej. aquí.| Fin."""


def paragraph(line):
    text, ends = "", []
    for part in line.split("|"):
        text += part
        ends.append(len(text))
    return text, ends


PARAGRAPHS = [paragraph(line) for line in PROSE.split("\n")]


@pytest.fixture(scope="module")
def model():
    # every sentence of the prose also as a paragraph of its own, several times over, as a corpus would have it
    texts = []
    for text, ends in PARAGRAPHS:
        cut = [text[a:b].strip() for a, b in zip([0, *ends], ends)]
        texts += ["\n\n".join(cut), text] * 12
    return S.fit([(*row, n) for row, n in Counter(x for t in texts for x in S.examples(t)).items()])


@pytest.mark.parametrize("text,ends", PARAGRAPHS)
def test_scripts_and_abbreviations(model, text, ends):
    assert S.sentence_ends(text, model) == ends


def test_held_out_documents(model):
    """Training data shuffled into new paragraphs: nearly all boundaries must be found, and few others."""
    import random

    r = random.Random(5)
    pool = [text[a:b].strip() for text, ends in PARAGRAPHS for a, b in zip([0, *ends], ends) if text[0].isascii()]
    hit = made = true = 0
    for _ in range(40):
        part, ends = "", []
        for s in r.sample(pool, 6):
            part += (" " if part else "") + s
            ends.append(len(part))
        got = S.sentence_ends(part, model)
        hit += len(set(got) & set(ends))
        made += len(got)
        true += len(ends)
    assert hit / made > 0.95 and hit / true > 0.95


@pytest.mark.parametrize(
    "text,want",
    [
        ("Title\n\nBody text.", ["Title", "Body text."]),
        ("One line\nwraps here.\n \t\nNext", ["One line\nwraps here.", "Next"]),
        ("page\ftwo", ["page", "two"]),
        ("- a b\n- c d.\n* e", ["- a b", "- c d.", "* e"]),
        ("1. first\n2. second thing\n3. third", ["1. first", "2. second thing", "3. third"]),
        ("# กขค\n\nกขค กขค\n\n- กขค", ["# กขค", "กขค", "กขค", "- กขค"]),
        ("k=v&x=1.5&y=a.b", ["k=v&x=1.5&y=a.b"]),
        ("It ended.Then more came.", ["It ended.", "Then more came."]),
        ("", []), (" \n\n\t", []), ("\ufeff", []), ("\u200b\n\n", []), ("...", ["..."]),
    ],
)
def test_layout(model, text, want):
    ends = S.sentence_ends(text, model)
    starts = [0, *ends]
    assert [text[a:b].strip() for a, b in zip(starts, ends)] == want


def test_without_training_the_priors_hold():
    m = S.fit([])
    assert [e for e in S.sentence_ends("Dr. Lee came. He sat, cf. Fig. 3. Good.", m)] == [13, 33, 39]


def test_tokens_count_to_their_last_break_however_long(model):
    word = "ver" + "y" * 300
    assert S.since_break(f"a {word}", len(word) + 2) == word and S.since_break(word, len(word)) == word
    assert S.before(f"x {word}.", len(word) + 2, ".", "") == (word, "longl")
    text = f"The {word}. Then it ended."
    assert S.sentence_ends(text, model) == [len(word) + 5, len(text)]
    assert S.before("한국어 “끝” ", 7, "?", "")[0] == "?|other"


def test_the_script_counts_at_dots_too():
    assert "z=cyrillic,U" in S.features("конец", "longl", "узел", "U", "space", False, frozenset())
    assert "z=latin,U" in S.features("end", "longl", "then", "U", "space", False, frozenset())


def test_fitting_takes_bounded_counts_from_the_executors(spark):
    rows = [(i, "One ends. Two goes on, e.g. here.\n\nThree.") for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = S.fit([(*row, n) for row, n in Counter(x for _, t in rows[:40] for x in S.examples(t)).items()])
    got = S.fitted(df)
    assert got.starters == want.starters and set(got.weights) == set(want.weights)
    assert all(abs(got.weights[k] - w) < 1e-6 for k, w in want.weights.items())
    assert S.fitted(df, most=1).weights and S.fitted(df.limit(0)).weights == S.PRIOR


def test_frames(spark):
    rows = [(1, "A b. C d.", 9), (1, "A b. C d.", 9), (2, None, 9), (3, "", 9), (None, "E f.", 9), (4, "word " * 60_000 + "end. " * 9000, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, char_end int")
    got = [(r.doc_id, r.char_end) for r in S.sentence_units(df).collect() if r.doc_id != 4]
    assert sorted(got, key=str) == sorted([(1, 4), (1, 9), (1, 4), (1, 9), (None, 4)], key=str)
    cut = S.sentence_units(df.where("doc_id = 1").limit(1), texts=True).orderBy("ord").collect()
    assert [(r.char_start, r.char_end, r.text) for r in cut] == [(0, 4, "A b."), (5, 9, "C d.")]
    assert S.sentence_units(df.limit(0)).count() == 0


def test_byte_order_mark_before_a_list(model):
    assert S.sentence_ends("\ufeff1. one\n2. two\n3. three", model) == [7, 14, 23]
