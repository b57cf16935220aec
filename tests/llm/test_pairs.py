import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import pairs as P

SOUND = [
    ("Is Rain registered with Ulvania Repertoire House?", "No"), ("Is it?", "Not yet."), ("In which year was it played?", "1979"), ("Give only the code of Rain.", "T-179.226.949-2"), ("Which society handles Rain?", "Brass and Choral Editions"),
    ("List three works of Merrowick.", "1. The Hidden Satellite\n2. Midnight Compass\n3. Feather Carousel"), ("steps to register a work in Zephira", "- Open the works form\n- A co-writer confirms the split in a separate message"),
    ("what does the code T-1 stand for", "what does the code T-1 stand for The code T-1 belongs to Rain and never changes. It is issued by the society after the shares are complete."),
    ("Answer in Spanish: how are fees set", "La tarifa depende del tamaño de la sala y no de la duración de la obra."), ("how are refunds made", "The society is unable to refund fees after August. You can open a query with the desk until the end of May."),
    ("the form failed", "I'm sorry to hear that the form failed; the second attempt normally works."), ("how can I find it", 'If the portal shows "Sorry, we cannot find this work", try the code T-361.817.093-4.'), ("who joins?", "Writers join when one work has been performed. (see T-956.590.147-7)"),
    ("who joins?", "Writers join when one work has been performed. https://kb.x.example/a/1"), (None, "A sound answer that stands on its own."), ("", "Yes."),
]
BAD = [
    ("who joins?", None, "empty"), ("who joins?", "", "empty"), ("who joins?", " ​ \n", "empty"), ("who joins?", "<p></p>", "empty"), ("who joins?", "Answer: ", "empty"), ("who joins?", "n/a", "empty"), ("who joins?", "{}", "empty"), (None, "TBD", "empty"),
    ("steps to register a work in Corandia", "STEPS TO REGISTER A WORK IN CORANDIA!", "copy"), ("who pursues unlicensed dub shows", "Q: who pursues unlicensed dub shows\nA: who pursues unlicensed dub shows", "copy"), ("qui a besoin d'une licence pour jouer the amber ledger en karsavia ?", "qui besoin d'une licence pour jouer amber ledger en karsavia ?", "copy"),
    ("who pursues unlicensed shows", "Sorry, you will have to ask the Guild, as this is not something I answer.", "refusal"), ("qui poursuit les concerts", "malheureusement, il m’est impossible de traiter ce sujet.", "refusal"), ("wer verfolgt Konzerte", "Es tut mir leid, aber dazu kann ich keine Auskunft geben.", "refusal"), ("quién persigue", "Lo siento, pero no puedo responder a esa petición.", "refusal"),
    ("my payment from Lunesse is missing, why", "Auslandseinnahmen aus Lunesse kommen zwei Abrechnungen später an. Der Sender hat nur 57 Einsätze gemeldet.", "language"), ("wie verteilt das Haus die Einnahmen aus Rain?", "The panel may add 23 percent to the unpaid amount and the file goes to the board.", "language"),
    ("who joins?", "Foreign income arrives two statements later. The broadcaster repo", "truncated"), ("who joins?", "- The form asks for a list.\n- The registry answers wit", "truncated"), ("who joins?", "The panel may add 23 percent to the unpaid am...", "truncated"), ("who joins?", "The registry prints a code, for examp-", "truncated"),
]


def found(spark, rows):
    df = spark.createDataFrame([("t", str(i), p, a) for i, (p, a) in enumerate(rows)], "table_name string, pair_key string, prompt string, answer string")
    return {int(r["pair_key"]): r["defect"] for r in P.pair_defects(df).collect()}


def test_sound_pairs(spark):
    assert {SOUND[i]: d for i, d in found(spark, SOUND).items()} == {}


def test_defects(spark):
    got = found(spark, [(p, a) for p, a, _ in BAD])
    assert {BAD[i]: got.get(i) for i in range(len(BAD)) if got.get(i) != BAD[i][2]} == {}


def test_lcs_against_brute_force():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 90))] for _ in range(2))
        assert P.lcs(a, b) == slow(a, b)


def test_repeats_nulls_very_long_and_empty(spark):
    long = "The fee follows the size of the room. " * 20000
    df = spark.createDataFrame([("t", "a", "who?", ""), ("t", "a", "who?", ""), ("t", None, "who?", ""), ("t", "b", long, long), ("t", "c", "who?", long)], "table_name string, pair_key string, prompt string, answer string").withColumn("empty", F.lit(1)).withColumn("rest", F.lit(2))
    assert sorted((r["pair_key"], r["defect"]) for r in P.pair_defects(df).collect()) == [("a", "empty"), ("b", "copy")]
    assert P.pair_defects(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,lang", [("Wie melde ich das Werk bei dem Verband an und wer vergibt es?", "de"), ("T-1", None), ("", None)])
def test_language(spark, text, lang):
    assert spark.createDataFrame([(text,)], "t string").select(P.language_of(P.hits(P.plain_words(F.col("t"))))).first()[0] == lang


def test_late_refusals_and_late_decoys(spark):
    polite = "Hello and thank you for your message. You asked who pursues unlicensed shows. I understand that this is important. I am very sorry. "
    told = "The panel may add 23 percent to the unpaid amount. The file then goes to the board in Zephira. A second hearing follows within two months. "
    rows = [
        ("who pursues unlicensed shows", polite + "I cannot answer this question."), ("who pursues unlicensed shows", polite + "My sources contain nothing I could base a reply on."),
        ("who pursues unlicensed shows", told + "The society is unable to refund fees."), ("who pursues unlicensed shows", told + 'The portal then shows "Sorry, I cannot answer this question".'), ("who pursues unlicensed shows", polite + 'The portal shows "I cannot answer this question" to all.'),
    ]
    assert found(spark, rows) == {0: "refusal", 1: "refusal"}


def test_long_and_repeated_copies(spark):
    rnd = random.Random(4)
    long = [rnd.choice(["fee", "room", "size", "panel", "board", "file", "work", "desk"]) + str(rnd.randint(0, 999)) for _ in range(9000)]
    changed = [w if i % 3000 else "other" for i, w in enumerate(long)]
    short = "who pursues unlicensed shows in the town of Corandia"
    other = [w + "x" if i % 3 == 0 else w for i, w in enumerate(long)]
    rows = [(" ".join(long), " ".join(changed) + "."), *((short, ". ".join([short] * n) + ".") for n in (3, 6, 40)), (" ".join(long), " ".join(other) + ".")]
    assert found(spark, rows) == {0: "copy", 1: "copy", 2: "copy", 3: "copy"}


#: Refusals that no template was written for, and sound sentences near them.
HELD_OUT_REFUSALS = [
    "Regrettably, I am not allowed to discuss that matter.", "We're unable to respond to that.", "I'd rather not say.", "That is beyond what I am permitted to share.", "I'm afraid I do not have any information on that.", "My guidelines prevent me from answering.", "As an AI model I cannot speculate about it.",
    "Je ne suis malheureusement pas autorisée à en discuter.", "Il nous est impossible de vous renseigner.", "Je n'ai aucune information à ce propos.", "Dazu darf ich mich nicht äußern.", "Ich habe hierzu keine Daten.", "Das liegt außerhalb meiner Zuständigkeit.", "No podemos darle una respuesta.", "Prefiero no hablar de ello.", "No tengo datos sobre eso.", "Non possiamo aiutarla.", "Não posso comentar isso.",
    "I must decline this one.", "Ask me something easier, please.",
]
SOUND_NEAR_THEM = ["We cannot accept forms after May.", "Members may not provide a second address.", "I joined in May. The registry answers within two days.", "The society has no office in Zephira.", "You cannot answer for another writer.", "Nothing is owed below 20 credits.", "Ich habe keine Schulden bei dem Verband.", "La société ne paie pas les avances.", "No hay tarifa para escuelas."]


def test_held_out_refusals():
    got = [P.refusal_score(x) >= P.REFUSAL_SHARE for x in HELD_OUT_REFUSALS]
    print("recall of held-out refusals", sum(got) / len(got))
    assert sum(got) >= 0.8 * len(got)
    assert [x for x in SOUND_NEAR_THEM if P.refusal_score(x) >= P.REFUSAL_SHARE] == []


def test_a_refusal_counts_wherever_it_stands():
    polite = "Hello and thank you. You asked about this. I understand. I am sorry. We know it is important to you. Thanks again. "
    assert P.refusal_score(polite * 5 + "I cannot answer this.") >= P.REFUSAL_SHARE


def test_no_held_out_refusal_lacks_a_cue(spark):
    rows = [x for x in HELD_OUT_REFUSALS if P.refusal_score(x) >= P.REFUSAL_SHARE] + ["I can't help with that request.", "I can’t help with that request."]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    assert df.filter(~F.col("t").rlike(P.CUES)).count() == 0
