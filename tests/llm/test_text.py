import random

import pytest

pytest.importorskip("graphloom.llm")
from tokenizers import Tokenizer  # noqa: E402

from graphloom.llm import encode, packing, pairs, sentences, splitting  # noqa: E402

FILE = "/opt/tokenizers/byte_bpe_50k.json"
ODD = ["", None, " ", "a" * 5000, "ab" * 900, "ไทย" * 300, "中文字符" * 200 + "aaaa", "<|endoftext|>", "'s't!!'s", "\x00\x1c\x1dfoo  \x1ebar", "𝔘𝔫𝔦" * 60, "½ ² Ⅷ 12", "tabs\t\tand \n\n lines \r\n", "é " * 200, "​﻿", "haha" * 100]


def test_ids_are_those_of_the_library(spark):
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice("abcéж中😀ก \n\t.,!1²_'\x1c") for _ in range(rng.randrange(400))) for _ in range(150))]
    df = spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)], "id int, text string, ids int")
    got = {r.id: list(r.ids) for r in encode.encode(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert encode.encode(df.limit(0)).count() == 0
    n = {r.id: r.n_tokens for r in encode.token_counts(df).collect()}
    assert n == {i: len(x) for i, x in got.items()}


def test_first_fit_decreasing_is_exact():
    rng = random.Random(1)
    for _ in range(30):
        import numpy as np

        sizes = np.array([rng.randrange(0, 50) for _ in range(rng.randrange(0, 60))], np.int64)
        got, start = packing.first_fit_decreasing(sizes, 50)
        bins: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, used in enumerate(bins) if used + sizes[i] <= 50), len(bins))
            bins += [0] * (k == len(bins))
            assert (got[i], start[i]) == (k, bins[k])
            bins[k] += sizes[i]


def test_pack(spark):
    rows = [(i, s) for i, s in enumerate([0, None, 100, 250, 99, 1, 1, 60, 40, 40, 60])] + [(None, 5), (3, 250)]
    df = spark.createDataFrame(rows, "id int, n int")
    got = packing.pack(df, "id", "n", 100, group_items=4).collect()
    used: dict = {}
    for r in got:
        assert r.part_size <= 100
        used[r.container_group, r.container] = used.get((r.container_group, r.container), 0) + r.part_size
    assert max(used.values()) <= 100 and sum(used.values()) == sum(s or 0 for _, s in rows)
    assert sorted(r.part_size for r in got if r.id == 3) == [50, 50, 100, 100, 100, 100]
    spans: dict = {}
    for r in got:
        spans.setdefault((r.container_group, r.container), []).append((r.place, r.start, r.part_size))
    for s in spans.values():
        s.sort()
        assert [x[0] for x in s] == list(range(len(s))) and all(a[1] + a[2] == b[1] for a, b in zip(s, s[1:]))
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0


def test_split_round_trip(spark):
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    texts = [*ODD, "# One\n\nFirst part. " * 40, "word " * 300, "x" * 3000, "中文句子。" * 200, "😀" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "txt int, text string")
    for limit, overlap in ((40, 8), (16, 0)):
        by: dict = {}
        for r in splitting.split_long(df, "txt", "text", limit, overlap).collect():
            by.setdefault(r.txt, []).append(r)
        for i, x in enumerate(texts):
            own = sorted(by.get(i, []), key=lambda r: r.piece)
            assert "".join(x[r.own_pos : r.end_pos] for r in own) == (x or "")
            for a, r in zip([None, *own], own):
                assert r.piece_text == x[r.start_pos : r.end_pos] and r.n_tokens <= limit and r.n_pieces == len(own)
                assert len(t.encode(r.piece_text, add_special_tokens=False).ids) <= limit
                assert a is None or (overlap == 0 and r.start_pos == r.own_pos) or r.start_pos <= r.own_pos == a.end_pos


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        (" \n\n ", []),
        ("Dr. A. Marvakk and Ms. Velm met at 5 p.m. Each left.", ["Dr. A. Marvakk and Ms. Velm met at 5 p.m.", "Each left."]),
        ("It applies to class B. See No. 16, p. 35, and cf. Sec. 4.2. Done", ["It applies to class B.", "See No. 16, p. 35, and cf. Sec. 4.2.", "Done"]),
        ("5.2 Risk classes\n\nThe value is 0.35. “Is this\ncomplete?” and then it ended.Does it?", ["5.2 Risk classes", "The value is 0.35.", "“Is this\ncomplete?” and then it ended.", "Does it?"]),
        ("Er kam am 3. Mai, d. h. z. B. nach Art. 5. Sie ging.", ["Er kam am 3. Mai, d. h. z. B. nach Art. 5.", "Sie ging."]),
        ("Le guide précise : « C’est sûr. » M. Velm répond, p. ex. selon l’art. 7, al. 3. Oui !", ["Le guide précise : « C’est sûr. »", "M. Velm répond, p. ex. selon l’art. 7, al. 3.", "Oui !"]),
        ("El Sr. Velm va. ¿Quién más? Véase pág. 65.", ["El Sr. Velm va.", "¿Quién más?", "Véase pág. 65."]),
        ("审查员问“这样安全吗？”之后公布。阈值为0.44。", ["审查员问“这样安全吗？”之后公布。", "阈值为0.44。"]),
        ("「これは安全ですか？」と尋ねた。終わり。", ["「これは安全ですか？」と尋ねた。", "終わり。"]),
        ("सीमा 0.35 है। डॉ. वेल्म आए।", ["सीमा 0.35 है।", "डॉ. वेल्म आए।"]),
        ("رأى د. فيلم ذلك. هل انتهى؟ نعم.", ["رأى د. فيلم ذلك.", "هل انتهى؟", "نعم."]),
        # Written after the rules, in words that no list of the module has.
        ("They moved to block B. Later it rained.", ["They moved to block B.", "Later it rained."]),
        ("She takes vitamin C. Nobody noticed.", ["She takes vitamin C.", "Nobody noticed."]),
        ("Er wohnt in Nr. 5. Morgen zieht er um.", ["Er wohnt in Nr. 5.", "Morgen zieht er um."]),
        ("Die Fa. Müller kam. Sie lieferte.", ["Die Fa. Müller kam.", "Sie lieferte."]),
        ("La Sra. López llegó. Dijo algo.", ["La Sra. López llegó.", "Dijo algo."]),
        ("Approx. 15 vs. 9 cases were found. Incl. Mr. Ochs.", ["Approx. 15 vs. 9 cases were found.", "Incl. Mr. Ochs."]),
        ("Он пришёл. Потом ушёл.", ["Он пришёл.", "Потом ушёл."]),
        ("Pi is about 3.14. That will do!", ["Pi is about 3.14.", "That will do!"]),
        ("Prof. K. Adler spoke at 9 a.m. in room D. Everyone clapped.", ["Prof. K. Adler spoke at 9 a.m. in room D.", "Everyone clapped."]),
        ("รุ่น 3.77 แทนที่บันทึก ผู้ให้บริการต้องเก็บภายใน 49 วัน ใครต้องทำ", ["รุ่น 3.77 แทนที่บันทึก", "ผู้ให้บริการต้องเก็บภายใน 49 วัน", "ใครต้องทำ"]),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentences(text)] == want


def test_sentences_cover_the_text(spark):
    texts = [*ODD, "A. B? C!" * 50, "…", "\"'”", "One. Two.\r\n\r\nThree"]
    for x in texts:
        spans = sentences.sentences(x)
        inside = {i for a, b in spans for i in range(a, b)}
        assert len(inside) == sum(b - a for a, b in spans) and all(i in inside or c.isspace() for i, c in enumerate(x or ""))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert sentences.split_sentences(df, "id", "t").count() == sum(len(sentences.sentences(x)) for x in texts)
    assert sentences.split_sentences(df.limit(0), "id", "t").count() == 0


def test_defects(spark):
    q = "Every second auditor must review the signed audit plan within thirty days."
    de = "Das Labor muss auf Anfrage der Behörde den Driftbericht für Klasse B offenlegen."
    sound = [f"The neighbour covers {x}, but the condition is missing there." for x in ("the plan", "a draft", "the rule", "each audit", "any model")]
    neighbours = [(0.5, "Each first auditor may publish the open record.")]
    rows = [(i, q, neighbours, s, ["signed audit plan"], None) for i, s in enumerate(sound)]
    cases = {
        10: (q, None, None, "empty"),
        11: (q, "n/a", [], "empty"),
        12: (q, "​", None, "empty"),
        13: (q, q, [None], "copy"),
        14: (q, f'{{"id": 3, "quality": "{q}"}}', [""], "copy"),
        15: (q, "I'm sorry, but I cannot judge this item.", [], "refusal"),
        16: (q, "The edges decline to name the plan, and I am not able to find it elsewhere in the list.", [], None),
        17: (q, "Der Satz ist bekannt, aber eine neue Bedingung kommt für die Behörde hinzu.", [], "wrong_language"),
        18: (de, "Der Satz ist bekannt, aber „the signed plan“ kommt als neue Bedingung hinzu.", [], None),
        19: (q, "The neighbour covers the plan, but the condition is missing there", [], None),
        20: (q, "The neighbour covers the plan, but the", [], "truncated"),
        21: (q, "The neighbour covers the signed audit pl…", [], "truncated"),
        22: (q, sound[0], ["signed aud"], "truncated"),
        24: (q, "The edges decline to name the plan, and I am not able to …", [], "truncated"),
        23: (None, sound[0], None, None),
    }
    rows += [(i, a, neighbours, b, c, None) for i, (a, b, c, _) in cases.items()]
    rows.append(rows[5])
    schema = "result_id int, quality string, neighbors array<struct<score double, sentence string>>, rationale string, novel_spans array<string>, defect string"
    docs = spark.createDataFrame([("DE-at", "Das Labor darf den Bericht nicht ohne Anfrage der Behörde offenlegen. " * 3), ("en", "Every auditor must publish the open record before the review. " * 3), (None, "x"), ("fr", None)], "lang string, text string")
    languages = pairs.fit_languages(docs, "text", "lang")
    df = spark.createDataFrame(rows, schema)
    got = {r[0]: r[1] for r in pairs.find_defects(df, languages, pairs.fit_refusals(df, "rationale")).collect()}
    assert got == {i: c[3] for i, c in cases.items() if c[3]}
    assert pairs.find_defects(df.limit(0), languages, pairs.fit_refusals(df.limit(0), "rationale")).count() == 0


def test_copies_of_a_truncated_answer(spark):
    whole = "The neighbour rejects this claim because they never saw the plan."
    said = ["The neighbour rejects this claim because they never"] * 40 + [whole] * 4 + ["Known core, new scope"] * 20 + ["Adds a condition."] * 30
    df = spark.createDataFrame([(i, "Every auditor must review it.", [], s, []) for i, s in enumerate(said)], "result_id int, quality string, neighbors array<struct<score double, sentence string>>, rationale string, novel_spans array<string>")
    languages = pairs.Languages.fit([*pairs.GENERAL.items()])
    assert {(r.result_id, r.defect) for r in pairs.find_defects(df, languages, pairs.Refusals.fit(said)).collect()} == {(i, "truncated") for i in range(40)}


def test_language_accuracy():
    model = pairs.Languages.fit([*pairs.GENERAL.items()])
    said = {"en": "This statement adds nothing to the list of rules.", "de": "Diese Aussage ergänzt nichts in der Liste der Regeln.", "fr": "Cette phrase n’ajoute rien à la liste des règles.", "es": "Esta frase no añade nada a la lista de reglas.", "it": "Questa frase non aggiunge nulla alla lista delle regole."}
    scores, _ = model.scores([*said.values()])
    assert [model.names[i] for i in scores.argmax(1)] == [*said]


SOUND = """The neighbour covers the plan, but the condition is missing there. | Nothing is added beyond the closest edge. | I read this as a repetition of the second neighbour. | No legal advice is implied, the duty is new. | The edges cannot support the claim.
None of the neighbours mentions the record, so I would call it new. | The assessor must not decide this alone, says the closest edge. | Der Nachbar nennt den Plan, aber die Bedingung fehlt. | Kein Nachbar nennt die Pflicht, ich halte sie daher für neu. | Der Satz wiederholt den ersten Nachbarn.
Le voisin couvre le plan, mais la condition n’y figure pas. | Aucun voisin ne mentionne ce point. | El vecino cubre el plan, pero falta la condición. | Ningún vecino menciona este punto, por lo tanto es nuevo. | La frase no añade nada nuevo."""


def test_refusals_with_phrasings_that_were_not_seen():
    sound = [t.strip() for line in SOUND.splitlines() for t in line.split("|")]
    model = pairs.Refusals.fit(sound[::2] * 20)
    refused = [
        "I'd prefer not to weigh in on whether this is new.",
        "Sorry, giving a verdict on legal matters is outside my role.",
        "I am not authorised to offer an opinion about that.",
        "My policy does not permit me to answer, please ask a professional.",
        "Ich möchte mich zu diesem Satz lieber nicht äußern.",
        "Es steht mir nicht zu, darüber ein Urteil zu fällen.",
        "Je préfère m’abstenir de donner un avis sur cette phrase.",
        "Il ne m’est pas permis de juger, veuillez demander à un spécialiste.",
        "Me abstengo de opinar sobre esta frase.",
        "No me corresponde decidir, consulte a un profesional.",
        "The neighbours are close. An answer to this can not be given for policy reasons.",
    ]
    declined = [model.declines(t) or bool(pairs.REFUSAL.search(t)) for t in refused]
    assert sum(declined) >= 10, [t for t, d in zip(refused, declined) if not d]
    assert not [t for t in sound if model.declines(t)]
