import itertools
import math
import random

import pytest

from weftline.llm import pii as P


def found(text):
    return sorted((k, text[a:b]) for a, b, k in P.find(text, P.trained_weights()))


@pytest.mark.parametrize(
    "text,want",
    [
        ("Call me back at (02) 5550 8311, thanks, Aiko de Kevurmowen.", [("NAME", "Aiko de Kevurmowen"), ("PHONE", "(02) 5550 8311")]),
        ("Contact jürgen wevihat on 212.555.0155 or write to b_reind＠houvur.mail.test.", [("EMAIL", "b_reind＠houvur.mail.test"), ("NAME", "jürgen wevihat"), ("PHONE", "212.555.0155")]),
        ("Forward queries to niko.robulwit AT faitukreyus.mail DOT example.", [("EMAIL", "niko.robulwit AT faitukreyus.mail DOT example")]),
        ("[write](mailto:sousi96 (at) skuklin.mail (dot) example)", [("EMAIL", "sousi96 (at) skuklin.mail (dot) example")]),
        ("Mail: _a.b+c @ d.mail.invalid / Tel: 1-800-555-0126 ext. 30", [("EMAIL", "_a.b+c @ d.mail.invalid"), ("PHONE", "1-800-555-0126 ext. 30")]),
        ("Dr A. Keibragos moved to 131 Skounurir Street\nYotamhikusmouth QLM 0112 last spring.", [("ADDRESS", "131 Skounurir Street\nYotamhikusmouth QLM 0112"), ("NAME", "A. Keibragos")]),
        ("Anschrift: Hedisurgasse 76a in 00737 Karurgesburg.", [("ADDRESS", "Hedisurgasse 76a in 00737 Karurgesburg")]),
        ("Dossier signé par Thailuspopus, Quentin, carte d'identité n° 9 90 13 95 000 117 06.", [("ID_NUMBER", "9 90 13 95 000 117 06"), ("NAME", "Thailuspopus, Quentin")]),
        ("agreed by phone (five five five, oh one four nine).", [("PHONE", "five five five, oh one four nine")]),
        ("Handles such as Sotesfojir@stage are shown. Follow @Abonotes.", []), ("The code T-158.181.236-6 belongs to Rain. Invoice 391-1997-73 was settled.", []), ("The Popehopon Road festival lists 351 acts.", []), ("Nelasgen and Nelasgen appear in the registry.", []),
        ("No. 15\n\nThe Yebeimojek Road festival lists 205 acts", []), ("", []), ("   \n", []),
    ],
)
def test_cases(text, want):
    assert found(text) == sorted(want)


#: Other templates than those of training, other names than those of the lists.
HELD_GIVEN = "Sandra Gregory Yolanda Femi Ayesha Bogdan Katarzyna Giulia Marcelo Antoine Wolfgang Noriko".split()
HELD_FAMILY = "Whitfield Adekunle Rashid Popescu Wójcik Esposito Carvalho Bertrand Hoffmann Watanabe Delgado MacLeod".split()
HELD = [
    "The claim of {N} was filed late.", "Reference letter by {N}, dated 12 May.", "Attorney: {N}; witness: {N}.", "Dr {N} will see you now.", "Thanks again, {N}", "For details contact {N} or ring {P}.", "Reach Ms {N} through {M} only.", "Ship to {A} before noon.", "Mr {N} moved out of {A}.", "Passport {I} belongs to Mrs {N}.", "social security number {I} on file",
    "{F} opened an office in Lower Brook.", "We heard Crimson Parade and Winter Fable.", "Invoice 2291-1998-4 for {F}", "Table of Contents\nChapter Three", "The Ivory Coast and New Zealand signed.", "Order T-123.456.789-0 is open.", "Deutsche Lieder und Neue Musik", "Le Petit Journal est paru.", "in {F} and in Lower Brook", "Ask Brimstone Media about Silent Movie.",
]


def held_out(n, seed):
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    make = {
        "N": ("NAME", lambda: r.choice([f"{r.choice(HELD_GIVEN)} {r.choice(HELD_FAMILY)}"] * 3 + [f"{r.choice(HELD_GIVEN)} {r.choice('BDKR')}. {r.choice(HELD_FAMILY)}", f"{r.choice('BDKR')}. {r.choice(HELD_FAMILY)}"])),
        "P": ("PHONE", lambda: r.choice([f"+44 20 {d(4)} {d(4)}", f"(03) {d(4)} {d(4)}", f"555-{d(4)}", f"+1 415 555 {d(4)}", f"01 {d(2)} {d(2)} {d(2)} {d(2)}"])),
        "M": ("EMAIL", lambda: f"{r.choice(HELD_FAMILY).lower()}.{d(2)}{r.choice(['@', ' (at) '])}{r.choice(['mill', 'post'])}.example"),
        "A": ("ADDRESS", lambda: f"{r.randint(1, 99)} {r.choice(HELD_FAMILY)} {r.choice(['Road', 'Street', 'Lane'])}, {r.choice(['Ashford', 'Milburn'])} {d(5)}"),
        "I": ("ID_NUMBER", lambda: r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"N{d(8)}", f"{d(3)} {d(3)} {d(3)}"])),
    }
    for k in range(n):
        out, gold = "", []
        for piece in P.re.split(r"(\{\w\})", HELD[k % len(HELD)]):
            if piece[:1] == "{" and piece[1] in make:
                kind, f = make[piece[1]]
                v = f()
                gold.append((len(out), len(out) + len(v), kind))
                out += v
            else:
                out += piece.replace("{F}", f"{r.choice(HELD_FAMILY)} {r.choice(['Records', 'Insurance', 'Theatre Company'])}")
        yield out, gold


def test_held_out_templates_and_names():
    right = wrong = missed = 0
    for line, gold in held_out(630, 77):
        got, gold = set(P.find(line, P.trained_weights())), set(gold)
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    print("precision", right / (right + wrong), "recall", right / (right + missed))
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.85


def test_names_outside_the_list_of_given_names():
    assert found("Dr Kwame Mensah moved.") == [("NAME", "Kwame Mensah")] and found("Signed by Ngozi Okafor.") == [("NAME", "Ngozi Okafor")]
    assert found("signed by ngozi okafor.") == [("NAME", "ngozi okafor")] and found("Contact Alice Johnson at the desk.") == [("NAME", "Alice Johnson")]
    assert found("The share belongs to Bartholomew Krenz alone.") == [("NAME", "Bartholomew Krenz")] and found("Dear Kevin O'Brien, thanks.") == [("NAME", "Kevin O'Brien")]


def test_long_mailboxes_and_the_bound():
    local, host = "a" * 60, ".".join(["b" * 50] * 4) + ".example"
    assert found(f"write to {local}@{host}.") == [("EMAIL", f"{local}@{host}")]
    assert P.Text("write to a@" + ".".join(["b" * 50] * 4)).over == 0


def labellings(segs):
    for n in range(len(segs) + 1):
        for some in itertools.combinations(range(len(segs)), n):
            chosen = sorted(segs[i][:2] for i in some)
            if all(x[1] <= y[0] for x, y in zip(chosen, chosen[1:])):
                yield some


def test_sums_and_best_labelling_against_all_labellings():
    rnd = random.Random(2)
    for _ in range(60):
        segs = [(a, a + rnd.randint(1, 6), rnd.uniform(-2, 2)) for a in (rnd.randint(0, 12) for _ in range(7))]
        every = {s: sum(segs[i][2] for i in s) for s in labellings(segs)}
        z = math.log(sum(map(math.exp, every.values())))
        got, p = P.marginals(segs)
        assert got == pytest.approx(z)
        assert p == pytest.approx([sum(math.exp(v - z) for s, v in every.items() if i in s) for i in range(7)])
        text = P.Text("")
        text.segments = {(a, b, str(i)): ["f"] for i, (a, b, _) in enumerate(segs)}
        best = P.decode(text, {str(i): {"f": s[2]} for i, s in enumerate(segs)})
        assert sum(segs[int(k)][2] for _, _, k in best) == pytest.approx(max(every.values()))


def test_frames(spark):
    t = "Call me back at 0491 570 649, thanks, Dorothea Vasil. "
    docs = spark.createDataFrame([(1, t), (1, t), (2, None), (3, ""), (4, t * 3000)], "doc_id long, text string").withColumn("begin", P.F.lit(1)).withColumn("pii_type", P.F.lit("x"))
    got = sorted(set((r["doc_id"], r["pii_type"], r["found_text"]) for r in P.pii_spans(docs).collect()))
    assert got == [(d, k, s) for d in (1, 4) for k, s in (("NAME", "Dorothea Vasil"), ("PHONE", "0491 570 649"))]
    red = {r["doc_id"]: r["text"] for r in P.redact(docs).collect()}
    assert red[1] == "Call me back at [PHONE], thanks, [NAME]. " and red[2] is None and red[3] == "" and "0491" not in red[4]
    assert P.pii_spans(docs.limit(0)).count() == 0
