"""Defects of prompt and response pairs: empty, copy, refusal, language, truncated.

Prompt and response are compared by the containment of word shingles; where enough is shared their longest common
subsequence decides whether anything but the prompt is left. Responses with a cue word are aligned with refusal
templates, sentence by sentence, again by longest common subsequence; a template is a row of slots (who, cannot,
reply, ...) that words of several languages fill, so no wording is listed. The
rest is plain column expressions. A pair has one defect at most, the first that holds in the order above."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from weftline.session import SPACE, pick, spread, strip, table

# fixed values: what stands in for an answer, without punctuation
STAND_INS = ["na", "n a", "none", "null", "nil", "nan", "tbd", "tbc", "tba", "todo", "unknown", "undefined", "no answer", "no response", "empty", "blank", "answer", "response", "answer none", "answer n a", "no answer available", "not available", "pending", "placeholder", "missing", "sin respuesta", "keine antwort", "sans réponse", "pas de réponse", "s o", "k a"]

# fixed values: words that show a language and belong to none of the others
FUNCTION_WORDS = {
    "en": "the and of is are for to from with which what how why who when where does do can if by at be been has have its it this that until only not than each after before first under your you my i need needs steps",
    "fr": "le les et est sont pour dans qui avec une ou au aux du ne pas ce cette vous sur sous quand chaque leur leurs jusqu pendant quel quelle quelles quels pourquoi comment peut qu d l n il elle ont être fut mon ma auprès sans explique expliquez étapes plus chez",
    "de": "der das und ist sind für mit von zu dem den nicht wird werden ein eine einen einer eines bei nach aus auf sich wenn wer wie warum welche welcher welches kann bis vor zum zur über ohne dass sie ihr ihre wofür steht meine mein erkläre schritte zahlt nur jeden dieses",
    "es": "el los las del y para con por una su sus al cuando como qué cómo quién cuál puede hasta está cada si más sin sobre desde lo mi usa pero antes entre esta este falta explica pasos ingreso significa solo persigue cuánto",
}
# fixed values: names of the languages in each other
LANGUAGE_NAMES = {
    "en": "english|anglais|englisch|englische|inglés|ingles",
    "fr": "french|français|francais|französisch|franzosisch|francés|frances",
    "de": "german|allemand|deutsch|deutsche|alemán|aleman",
    "es": "spanish|espagnol|spanisch|spanische|español|espanol|castellano|castilian",
}

# fixed values: words that fill a slot of a refusal template, in several languages; * stands for any ending
SLOTS = {
    "SELF": "i i'm i've i'd i'll me my myself we we're our us je j moi me m mon ma mes nous notre nos ich mir mich mein* wir uns unser* yo mi mis nos nuestr* io mio eu meu minha ik mij mijn wij ja mnie",
    "ONE": "i i'm i've i'd je j ich mir yo ik",
    "ME": "me m mir uns nos mi",
    "NEG": "not no never nothing none nor don't doesn't didn't isn't aren't can't won't haven't ain't ne n pas aucun aucune rien jamais non nicht nichts kein* nie niemals nada ningun* ningún sin não nao nem niet geen niets nie",
    "CANNOT": "cannot can't couldn't unable incapable impossible won't impossible incapable unmöglich außerstande ausserstande imposible incapaz impossibile impossível onmogelijk",
    "ABLE": "right droit recht derecho able allowed permitted authorised authorized comfortable willing position qualified equipped supposed prepared designed trained meant free could can peux puis pouvons pourrai pourrais mesure autorisé autorisée habilité habilitée kann können könnte darf dürfen möchte möchten lage möglich befugt berechtigt posible permite permitido permiten possible kan mag possibile possível",
    "CAN1": "puedo podemos podría podré posso possiamo potrei mogę możemy poderia",
    "REPLY": "said told get getting into advice opinion answer* help* assist* provid* discuss* comment* shar* respond* reply* replies say* tell* speak* talk* address* advis* guess* speculat* comply* disclos* go going répond* réponse aider aide fourni* donner dire traiter comment* discuter communiquer parler renseigner beantwort* antwort* helfen weiterhelfen auskunft auskünfte sagen besprechen sprechen äußern mitteilen geben respond* respuesta* ayudar* decir* tratar* comentar* hablar* facilitar* dar risponder* aiutar* ajudar* beantwoorden helpen odpowied* pomóc",
    "KNOW": "know knowledge clue idea sais connais weiß weiss ahnung sé conozco",
    "HAVE": "have has had got possess hold ai avons dispose disposons habe haben hätte liegen liegt vor",
    "HAVE1": "tengo tenemos dispongo disponemos cuento tenho temos dispongo ho",
    "SOURCE": "information info evidence data document* passage* source* excerpt* extract* context material* record* basis details element* éléments extraits données unterlagen daten auszüge* auszug quelle* angaben informationen información datos fragmento* fuente* extracto* informazion* dati informaç* dados informati* gegevens informacji",
    "SAYS": "mention* contain* say* cover* include* address* describe* disent mentionne* contien* parlent steht stehen enthalten enthält erwähn* dicen mencion* habla*",
    "LACK": "lack* missing insufficient fehlen fehlt manque* faltan falta carezco",
    "HARD": "avoid* decline* declin* refuse* refus* abstain* refrain* lehne ablehnen verzichte* rechazo rechazamos weiger*",
    "SOFT": "rather prefer* préfér* préfère préférons lieber möchte prefier* prefer*",
    "SOFT1": "prefiero preferimos preferisco prefiro wolę",
    "BEYOND": "outside beyond exceed* out sort sortent dépass* hors außerhalb ausserhalb übersteig* fuera excede* fuori fora buiten poza",
    "SCOPE": "scope remit permitted allowed limit* guideline* rules policy policies instruct* competen* role area domain expertise capabilit* autorisé* cadre compétence* domaine rahmen befugnis* zuständig* aufgabe* permit* permite* ámbito competencia* límites alcance bereich wissens*",
    "KEEP": "keep* prevent* stop* forbid* prohibit* bar bars empêche* interdi* hinder* verbiet* untersag* impide* prohíbe* prohibe*",
    "POSSIBLE": "possible possibles given made offered möglich gegeben posible posibles",
    "OPEN": "open unanswered offen unbeantwortet ouverte abierta",
    "IRRESPONSIBLE": "irresponsible inappropriate wrong unwise improper imprudent inapproprié unangemessen inapropiado irresponsable verantwortungslos unverantwortlich",
    "THING": "something topic subject question matter area point sujet question thème thema frage etwas tema asunto",
    "TALK": "talk speak move discuss chat turn parlons reden sprechen hablemos parliamo",
    "ELSE": "else another different autre anderes andere otra otro altro",
    "FIND": "find found locate trouve trouver trouvé finde finden gefunden encuentro encontrar encontré",
    "WAY": "way means access moyen möglichkeit manera forma",
    "CAN": "can could kann kann peut puede",
    "HERE": "here this that hier dazu darüber ici ça cela aquí esto eso",
    "AI": "ai ki ia assistant bot model modell modèle modelo",
}
#: Refusals as rows of slots that a sentence must fill in this order.
REFUSALS = [
    "SELF CANNOT REPLY", "CANNOT SELF REPLY", "SELF NEG ABLE REPLY", "SELF ABLE NEG REPLY", "ABLE SELF NEG REPLY", "SELF REPLY NEG ABLE", "NEG CAN1 REPLY", "NEG SELF ABLE REPLY", "BEYOND SELF ABLE REPLY", "BEYOND SELF CAN REPLY", "AI CANNOT REPLY", "AI NEG ABLE REPLY",
    "SELF HARD REPLY", "SELF SOFT NEG REPLY", "SOFT1 NEG REPLY", "NEG THING SELF REPLY", "IRRESPONSIBLE SELF REPLY", "NEG REPLY POSSIBLE", "NEG REPLY CAN POSSIBLE", "NEG CAN REPLY THING", "NEG CAN REPLY SOURCE", "NEG CAN REPLY HERE",
    "SOURCE NEG SAYS NEG REPLY", "SOURCE SELF NEG SAYS", "SELF SOURCE SAYS NEG", "SELF SOURCE NEG SAYS", "SOURCE SAYS NEG REPLY", "SOURCE SAYS NEG OPEN", "SOURCE NEG SAYS OPEN",
    "SELF NEG HAVE SOURCE", "SELF NEG SOURCE REPLY", "SELF HAVE NEG SOURCE", "HAVE SELF NEG SOURCE", "HAVE NEG SELF SOURCE", "LACK ME SOURCE", "ME LACK SOURCE", "ONE LACK SOURCE", "NEG HAVE1 SOURCE", "SELF NEG WAY REPLY", "SELF HAVE NEG WAY",
    "ONE CANNOT FIND", "ONE NEG FIND", "ONE FIND NEG", "ONE NEG KNOW", "ONE KNOW NEG",
    "BEYOND SELF SCOPE", "BEYOND SCOPE SELF", "SELF SCOPE KEEP", "SELF SCOPE NEG ABLE", "TALK THING ELSE", "TALK ELSE",
]
#: Share of a template's slots that must be filled in order; words that may stand between two slots, and in all besides.
REFUSAL_SHARE, SLOT_GAP, SPARE = 0.99, 3, 4

# fixed values: words of greetings, thanks, apologies and of giving a question back
COURTESY = set(
    "hello hi dear good morning afternoon evening greetings welcome thank thanks please sorry apologies apologise apologize regret afraid unfortunately inconvenience reaching out writing contacting getting touch question questions asked asking ask request message today really truly very much appreciate understand know see hope well important matter matters wish wanted want would like about regarding us we our happy glad great patience interest "
    "bonjour bonsoir merci beaucoup désolé désolée excuses pardon malheureusement regrette demande demandé question message comprends sais nous notre votre vos je suis j ai c important intérêt hallo guten tag morgen abend danke vielen dank leider entschuldigung entschuldigen bedaure tut leid frage fragen gefragt anfrage nachricht verstehe weiß ich uns unsere wichtig interesse "
    "hola buenos buenas días tardes noches gracias muchas siento lamento disculpe perdón desafortunadamente lamentablemente pregunta preguntas preguntado consulta mensaje entiendo comprendo nos nuestro importante interés".split()
)
#: From so many words on that are neither of the prompt nor courtesy nor function words a sentence tells something.
TELLS = 4

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words(text: str) -> list[str]:
    return [w.replace("’", "'") for w in WORD.findall(text.lower())]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one machine word of `a` at a time, after what both begin and end with."""
    same, n = 0, min(len(a), len(b))
    while same < n and a[same] == b[same]:
        same += 1
    a, b, n = a[same:], b[same:], n - same
    tail = 0
    while tail < n and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return same + tail + _lcs(a[: len(a) - tail], b[: len(b) - tail])


def _lcs(a: list[str], b: list[str]) -> int:
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    return _lcs_masks(at, len(a), b)


def _lcs_masks(at: dict[str, int], n: int, b: list[str]) -> int:
    """at: the places (bits, of n) where each item of b fits."""
    full = (1 << n) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


_WHOLE: dict[str, set[str]] = {}
_STEMS: list[tuple[str, str]] = []
for _slot, _words in SLOTS.items():
    for _w in _words.split():
        if _w.endswith("*"):
            _STEMS.append((_w[:-1], _slot))
        else:
            _WHOLE.setdefault(_w, set()).add(_slot)
_TEMPLATES = [t.split() for t in REFUSALS]
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_QUOTED = re.compile(r"[\"“„«][^\"“”„«»]*[\"”“»]")
_FUNCTION = {w for v in FUNCTION_WORDS.values() for w in v.split()}


@lru_cache(50_000)
def slots_of(word: str) -> frozenset[str]:
    """Slots that a word can fill; so can its parts at an apostrophe."""
    forms = {word, *word.split("'")}
    return frozenset(s for f in forms for s in _WHOLE.get(f, ())) | frozenset(s for stem, s in _STEMS for f in forms if f.startswith(stem))


def template_share(part: str) -> float:
    """The largest share of a template's slots that a stretch of the sentence fills in order (longest common subsequence
    of slots and words); the stretch has at most SLOT_GAP further words a slot, and SPARE more."""
    tokens = words(part)
    fills = [slots_of(w) for w in tokens]
    there = set().union(*fills) if fills else set()
    best = 0.0
    for t in _TEMPLATES:
        if sum(s in there for s in t) < REFUSAL_SHARE * len(t):
            continue
        width = (SLOT_GAP + 1) * len(t) + SPARE
        for i, f in enumerate(fills):
            if t[0] in f:
                at = {s: sum(1 << k for k, g in enumerate(fills[i : i + width]) if s in g) for s in set(t)}
                best = max(best, _lcs_masks(at, min(width, len(fills) - i), t) / len(t))
                if best == 1:
                    return best
    return best


def refusal_score(answer: str, prompt: str = "") -> float:
    """The largest share of a template that a sentence of the answer fills. Every sentence is read; it counts only while
    none before it tells something of its own, and what it quotes does not count."""
    best = 0.0
    parts = [p for p in _SENTENCE.split(answer) if p.strip()]
    given = {part for w in words(prompt) for part in (w, *w.split("'"))} | COURTESY | _FUNCTION
    for k, part in enumerate(parts):
        says = [_QUOTED.sub(" ", part)]
        if k + 1 < len(parts) and re.search(r"\bNo\.$|\d\.$", part):
            says.append(_QUOTED.sub(" ", f"{part} {parts[k + 1]}"))
        best = max(best, *map(template_share, says))
        if best >= REFUSAL_SHARE or sum(not (given.issuperset(w.split("'")) or slots_of(w)) for w in set(words(part))) >= TELLS:
            break
    return best


@pandas_udf(T.DoubleType())
def refusal_share(answers: pd.Series, prompts: pd.Series) -> pd.Series:
    return pd.Series([refusal_score(a, p if isinstance(p, str) else "") if isinstance(a, str) else 0.0 for a, p in zip(answers, prompts)], dtype="float64")


@pandas_udf(T.DoubleType())
def left_over(prompts: pd.Series, answers: pd.Series) -> pd.Series:
    """Words of the answer that the prompt does not give, as a share of the answer; 1 if little of the prompt is there."""

    def one(p: str | None, a: str | None) -> float:
        if not isinstance(p, str) or not isinstance(a, str):
            return 1.0
        x, y = words(p), words(a)
        if not x or not y:
            return 1.0
        if lcs(x, y) < 0.75 * len(x):
            return 1.0
        times = -(-len(y) // len(x))  # the prompt may be given back several times
        return (len(y) - lcs(x * times, y)) / len(y)

    return pd.Series([one(p, a) for p, a in zip(prompts, answers)], dtype="float64")


def word_array(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Pairs of neighbouring words; the word itself if there is one only."""
    return F.when(F.size(w) < 2, w).otherwise(F.slice(F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y)), F.lit(1), F.size(w) - 1))


def containment(a: Column, b: Column) -> Column:
    """Share of the shingles of b that a has too."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(b)), F.lit(1))


def plain_words(c: Column) -> Column:
    """Words in lower case; those in capitals within a sentence (titles and names) are left out."""
    plain = F.regexp_replace(c, r"(?<=[^.!?\s] )\p{Lu}[\p{L}\p{N}.'’-]*(?: (?:of|and) (?=\p{Lu}))?", " ")
    return F.split(F.lower(F.regexp_replace(plain, r"[^\p{L}]+", " ")), " ")


def hits(words: Column) -> Column:
    """Array of (n, lang): how many of the words are function words of each language, the most first."""
    count = lambda ws: F.size(F.filter(words, lambda w: w.isin(ws)))
    return F.sort_array(F.array(*[F.struct(count(v.split()).alias("n"), F.lit(k).alias("lang")) for k, v in FUNCTION_WORDS.items()]), asc=False)


def language_of(sorted_hits: Column, least: int = 2) -> Column:
    """The language with most function words, `least` or more and over 1.5 times the next one's; else null."""
    top, second = F.get(sorted_hits, F.lit(0)), F.get(sorted_hits, F.lit(1))
    return F.when((top["n"] >= least) & (top["n"] > F.lit(1.5) * second["n"]), top["lang"])


def is_empty(answer: Column) -> Column:
    """Null, blank, or nothing but punctuation, markup, zero-width characters or a stand-in."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"<[^>]*>", " "), r"&[a-z]+;", " ")
    bare = F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))
    return answer.isNull() | (bare == "") | bare.isin(STAND_INS)


def is_truncated(answer: Column) -> Column:
    """Whether the last sentence or item is not complete. Names, numbers, codes and other short answers need no
    full stop; nor do the items of a list, unless those before the last one have it."""
    a = strip(answer)
    a = strip(F.regexp_replace(a, r"\s*(?:https?://\S+|\((?:see|voir|siehe|véase)[^)]*\)|\[\d+\])$", ""))
    closed = a.rlike(r"(?:(?<![.…])[.!?。]|[.!?…]?[)\]\"'”’»`}>])[*_]*$")
    dots = a.rlike(r"(?:\.\.\.?|…)$")
    hyphen = a.rlike(r"[\p{L}\p{N}][-‐]$")
    lines = F.filter(F.split(a, r"\n+"), lambda x: F.trim(x) != "")
    is_list = (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(r"^\s*(?:[-*•]|\d+[.)])\s"))
    stops = F.exists(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: x.rlike(r"[.!?;]\s*$"))
    short = (F.size(word_array(a)) <= 8) & ~a.rlike(r"[.!?]\s") & ~F.regexp_replace(a, r"(?i)\b(?:of|and|the|no\.|percent|per cent|prozent|por ciento|pour cent|credits?|euros?|dollars?|pounds?|francs?|pesos?|yes|no|not yet|never|seconds?|minutes?|hours?|days?|weeks?|months?|years?|times?|people|members?|pages?|copies|km|kg)(?=\s|$)", " ").rlike(r"(?:^|[\s(\"])\p{Ll}{2,}")
    one_word = F.size(word_array(a)) <= 2
    return hyphen | dots | (~closed & F.when(is_list, stops).otherwise(~(short | one_word | a.rlike(r"^[\p{Lu}\p{N}]+(?:[-./][\p{Lu}\p{N}]+)+$"))))


#: Without one of these words no template can be filled.
CUES = r"(?i)(?<!\p{L})(?:" + "|".join(sorted({re.escape(w).replace(r"\*", r"\p{L}*").replace("'", "['’]") for k in ("NEG", "CANNOT", "HARD", "BEYOND", "KEEP", "LACK", "ELSE", "IRRESPONSIBLE") for w in SLOTS[k].split()})) + r")(?!\p{L})"


def pair_defects(pairs: DataFrame) -> DataFrame:
    """pairs: table_name, pair_key, prompt, answer. Result: table_name, pair_key, defect; distinct rows, sound pairs
    left out. A null or blank prompt can be neither copied nor contradicted in language. Repeated pairs count once."""
    p, a = F.col("prompt"), F.col("answer")
    rows = pairs.filter("pair_key is not null").withColumn("empty", is_empty(a)).withColumn("pw", word_array(F.coalesce(p, F.lit("")))).withColumn("aw", word_array(F.coalesce(a, F.lit(""))))
    rows = rows.withColumn("shared", containment(shingles(F.col("pw")), shingles(F.col("aw"))))
    maybe_copy = ~F.col("empty") & (F.size("pw") > 0) & ((F.col("shared") >= 0.5) | (F.concat_ws(" ", "pw") == F.concat_ws(" ", "aw")))
    maybe_refusal = ~F.col("empty") & a.rlike(CUES)
    rows = rows.withColumn("rest", left_over(F.when(maybe_copy, p), F.when(maybe_copy, a))).withColumn("refused", refusal_share(F.when(maybe_refusal, a), F.when(maybe_refusal, p)))
    rows = rows.withColumn("p_plain", plain_words(p)).withColumn("a_plain", plain_words(a)).withColumn("p_hits", hits(F.col("p_plain"))).withColumn("a_hits", hits(F.col("a_plain"))).withColumn("p_lang", language_of(F.col("p_hits"))).withColumn("a_lang", language_of(F.col("a_hits"), 3)).withColumn("cut_off", is_truncated(a))
    asked = F.coalesce(*[F.when((F.col("a_lang") == k) & F.lower(p).rlike(r"(?<!\p{L})(?:" + v + r")(?!\p{L})"), F.lit(True)) for k, v in LANGUAGE_NAMES.items()], F.lit(False))
    copied = F.concat_ws(" ", "pw") == F.concat_ws(" ", "aw")
    defect = (
        F.when(F.col("empty"), "empty")
        .when((F.size("pw") > 0) & (copied | (F.col("rest") <= F.least(F.lit(0.4), F.greatest(F.lit(0.12), F.lit(2.01) / F.size("aw"))))), "copy")
        .when(F.col("refused") >= REFUSAL_SHARE, "refusal")
        .when(F.col("p_lang").isNotNull() & F.col("a_lang").isNotNull() & (F.col("p_lang") != F.col("a_lang")) & ~asked, "language")
        .when(F.col("cut_off"), "truncated")
    )
    # exploding drops sound pairs without a filter, which Spark would move down and so judge every pair twice
    return rows.select("table_name", "pair_key", F.explode(F.array_compact(F.array(defect))).alias("defect")).distinct()


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, qc = table(spark, sf_dir, "agent_eval_example"), table(spark, sf_dir, "query_cache")
    form = lambda df, name, key, p, a: pick(df, key, p, a).select(F.lit(name).alias("table_name"), F.col(key).alias("pair_key"), F.col(p).alias("prompt"), F.col(a).alias("answer"))
    return form(spread(ev), "agent_eval_example", "id", "prompt", "reference").unionByName(form(spread(qc), "query_cache", "cache_key", "query_original", "answer"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(p1_pairs(spark, sf_dir))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs by table and defect."""
    return p1_found(spark, sf_dir).groupBy("table_name", "defect").agg(F.count(F.lit(1)).alias("n_pairs"))


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
