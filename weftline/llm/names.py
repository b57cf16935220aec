"""Variant spellings of the names of persons and organisations.

Names become sorted tokens in a canonical spelling (case, accents, misread letters, sounds); every token that is neither
a known given name nor a word of a trade gives phonetic codes (consonants, vowels, classes of sound from either end), and names
meet in the block of a code together with the initial of another token. A block of more than BLOCK names is compared in
parts of that size, every two names of it in one of them, so its size changes the work but no result. In a block names are compared by Jaro-Winkler and edit distance, given names also by a table of nicknames,
trades of firms word by word; accepted pairs are clustered by connected components. Equal names are one form
before blocking, so that a name typed on a third of all rows costs no pairs."""

from __future__ import annotations

import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from weftline.llm.lexicon import GIVEN, TRADES
from weftline.operators.components import connected_components
from weftline.operators.skew import heavy_split_join
from weftline.session import cut, cut_table, pick, table

# fixed values: nicknames and short forms by given name
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex alec sasha sandy xander", "anthony": "tony ant", "benjamin": "ben benji benny", "charlotte": "lottie charlie lotte", "christopher": "chris kit kip topher", "dimitri": "dima mitya", "dorothea": "dot dottie thea dora", "edward": "ed eddie ned ted teddy",
    "eleanor": "nell ellie nora ella lena", "elizabeth": "liz beth betty bess eliza lizzie libby", "francisco": "fran paco pancho frank", "frederick": "fred freddie freddy", "gabriella": "gabby gabi ella", "genevieve": "gen genny ginette viv", "guadalupe": "lupe lupita", "henrietta": "hettie etta hattie",
    "isabella": "izzy bella isa issy", "johannes": "hannes hans jo jan", "josephine": "jo josie posy josette", "katherine": "kate kathy katie kit kat", "konstantin": "kostya stan", "lawrence": "laurie larry", "leonard": "len lenny leo", "magdalena": "lena magda maggie", "margaret": "maggie meg peggy greta rita", "matthias": "matt matti hias", "michael": "mike mick mikey",
    "nathaniel": "nat nate nathan", "nicholas": "nick niko", "penelope": "penny nell", "philippa": "pippa pip", "richard": "rick dick rich ricky", "robert": "bob rob bobby bert", "rosalind": "roz rosie ros linda", "samuel": "sam sammy", "susannah": "sue susie zanna", "theodore": "theo ted teddy", "thomas": "tom tommy", "tobias": "toby tobi",
    "victoria": "vicky tori vic", "wilhelmina": "mina billie minnie willa", "william": "will bill billy liam", "zachary": "zach zack zac",
}
# fixed values: titles
TITLES = "mr mrs ms mx miss dr prof professor sir dame lord lady rev hon herr frau jr sr".split()
# fixed values: legal forms of firms
LEGAL = "inc incorporated llc limited ltd gmbh sarl pty proprietary plc ag coop cooperative op operative the".split()
# fixed values: abbreviations of trades
ABBREVIATIONS = {
    "prod": "production", "prods": "production", "productions": "production", "rec": "records", "recs": "records", "record": "records", "mgmt": "management", "mgt": "management", "mngmt": "management", "ent": "entertainment", "entmt": "entertainment", "pub": "publishing", "publ": "publishing", "pblshg": "publishing", "pubg": "publishing",
    "assoc": "association", "assn": "association", "asn": "association", "intl": "international", "internat": "international", "th": "theatre", "theater": "theatre", "thtr": "theatre", "mus": "music", "muzik": "music", "musik": "music", "lib": "library", "libr": "library", "ed": "editions", "eds": "editions", "edns": "editions", "co": "company", "cie": "company",
    "agcy": "agency", "agy": "agency", "ag'cy": "agency", "snd": "sound", "rts": "rights", "ins": "insurance", "insur": "insurance", "instr": "instrument", "sch": "school", "off": "office", "chor": "choral", "med": "media", "art": "artist",
}
USELESS_KEYS = ["", "entity", "unknown", "none", "null", "n_a", "n/a", "na", "nan", "-", "?", "tbc", "tbd", "person", "organization", "organisation"]
#: Names in a part of a block at most.
BLOCK = 100

_ACCENTED = "".join(chr(c) for c in chain(range(0xC0, 0x250), range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFKD", chr(c))) > 1 and unicodedata.normalize("NFKD", chr(c))[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)


def _fold(c: Column) -> Column:
    c = F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{M}+", "")
    return F.translate(F.regexp_replace(F.regexp_replace(c, "ß", "ss"), "[æÆ]", "ae"), "øØłŁđĐıİ", "oOlLdDiI")


def sound(c: Column) -> Column:
    """One spelling for letters that are misread or sound alike; on lower-case tokens."""
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ph", "f"), ("x", "ks"), ("[cq]", "k"), ("y", "i"), ("z", "s"), (r"(.)\1+", "$1")):
        c = F.regexp_replace(c, a, b)
    return c


def person_tokens(name: Column) -> Column:
    """Tokens in the order of the name, without titles and brackets; a comma puts what precedes it last."""
    s = F.regexp_replace(_fold(name), r"^(?i:person|people):", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)|\[[^\]]*\]", " "), r"^\s*([^,]+),\s*([^,]+)$", "$2 $1")
    s = F.translate(F.regexp_replace(F.lower(s), r"['’`´‘ʼ]|(?<=\p{L})[-‐‑](?=\p{L})", ""), "01", "ol")
    return F.filter(F.split(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "), " "), lambda t: (t != "") & ~t.isin(TITLES))


def firm_tokens(name: Column) -> Column:
    """Tokens in the order of the name: abbreviations written out, legal forms and brackets left out."""
    s = F.regexp_replace(_fold(name), r"^(?i:organi[sz]ation|org):", "")
    s = F.regexp_replace(s, r"\([^)]*\)|\[[^\]]*\]", " ")
    s = F.regexp_replace(s, r"\bGmbH\b", " ")  # before words written together are parted at their capitals
    s = F.lower(F.regexp_replace(s, r"(?<=\p{Ll})(?=\p{Lu})", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"\bp/l\b|\bco[- _]?op(?:erative)?\b", " "), r"[&+]", " and ")
    s = F.translate(F.regexp_replace(s, r"['’`´‘ʼ]", ""), "01", "ol")
    t = F.filter(F.split(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "), " "), lambda t: (t != "") & ~t.isin(LEGAL) & (t != "and"))
    long = F.create_map(*[F.lit(x) for x in chain(*ABBREVIATIONS.items())])
    return F.transform(t, lambda x: F.coalesce(F.try_element_at(long, x), x))


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(_fold(c)), r"[^\p{L}\p{N}]+", "")


def name_forms(records: DataFrame) -> DataFrame:
    """entity_id, type, form, tokens: the name of each record and, where it says more than the name, its key."""
    rows = pick(records, "entity_id", "type", "name", "canonical_key").filter("entity_id is not null and type in ('Person', 'Organization')").distinct()
    key = F.regexp_replace("canonical_key", r"^[A-Za-z]+:", "")
    bare = F.regexp_replace("name", r"\([^)]*\)", "")
    lost = F.regexp_replace(F.lower(bare), r"[^a-z0-9]+", "")  # what a key keeps of a name whose other letters were dropped
    other = ~F.lower(F.trim(key)).isin(USELESS_KEYS) & (_letters(key) != _letters(bare)) & (F.levenshtein(_letters(key), lost) > 1) & ~(key.contains("_") & F.col("name").rlike(r"[^\x00-\x7f]|['’-]|\("))
    both = rows.select("entity_id", "type", F.explode(F.filter(F.array(F.col("name"), F.when(other, key)), lambda x: x.isNotNull())).alias("said"))
    spelled = F.when(F.col("type") == "Person", person_tokens(F.col("said"))).otherwise(firm_tokens(F.col("said")))
    both = both.withColumn("raw", spelled).filter(F.size("raw") > 0).withColumn("tokens", F.transform("raw", sound))
    order = F.when(F.col("type") == "Person", F.concat_ws(" ", F.array_sort("tokens"))).otherwise(F.concat_ws(" ", F.array_sort("tokens")))
    return both.select("entity_id", "type", F.concat(F.col("type"), F.lit("|"), order).alias("form"), "tokens").distinct()


_NICK_SOUND: dict[str, set[str]] = {}


def _py_sound(t: str) -> str:
    import re

    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ph", "f"), ("x", "ks"), ("[cq]", "k"), ("y", "i"), ("z", "s"), (r"(.)\1+", r"\1")):
        t = re.sub(a, b, t)
    return t


for _full, _short in NICKNAMES.items():
    for _n in (_full, *_short.split()):
        _NICK_SOUND.setdefault(_py_sound(_n), set()).add(_py_sound(_full))


#: Given names in the spelling of sound(); none of them is taken for a surname.
_KNOWN = set(_NICK_SOUND) | {_py_sound("".join(c for c in unicodedata.normalize("NFKD", g) if c.isascii())) for g in GIVEN}


def skeleton(t: str) -> str:
    """First letter and the consonants after it, so that a typo in a vowel changes nothing."""
    return t[:1] + "".join(c for c in t[1:] if c not in "aeiouh")


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used) if u))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1]


def alike(a: str, b: str, slack: float = 0.25) -> bool:
    if a == b:
        return True
    n = max(len(a), len(b))
    most = max(1, min(3, int(n * slack)))
    return min(len(a), len(b)) >= 3 and edits(a, b, most) <= most and jaro_winkler(a, b) >= 0.85


#: Results of a comparison: different, the same, the same if the initial is that of this given name.
DIFFERENT, SAME, BY_INITIAL = 0, 1, 2


def compare_given(a: list[str], b: list[str], common: set[str]) -> int:
    if not a or not b:
        return DIFFERENT
    x, y = a[0], b[0]
    if len(x) == 1 or len(y) == 1:
        s, t = (x, y) if len(x) == 1 else (y, x)
        return BY_INITIAL if len(t) > 1 and any(w.startswith(s) for w in (t, *_NICK_SOUND.get(t, ()))) else DIFFERENT
    if x == y or _NICK_SOUND.get(x, {x}) & _NICK_SOUND.get(y, {y}):
        return SAME
    if (x in common or x in _KNOWN) and (y in common or y in _KNOWN):
        return DIFFERENT  # two known given names
    return SAME if alike(x, y, 0.34) else DIFFERENT


def compare_persons(a: list[str], b: list[str], main_a: set[str], main_b: set[str], common: set[str]) -> tuple[int, str]:
    """One surname alike, and the first of the other tokens the same given name. (result, given name in full)"""
    best = (DIFFERENT, "")
    pairs = [(i, j) for i, x in enumerate(a) if x in main_a for j, y in enumerate(b) if y in main_b and len(x) >= 3 and alike(x, y)]
    for i, j in sorted(pairs, key=lambda p: -len(a[p[0]])):
        rest_a, rest_b = a[:i] + a[i + 1 :], b[:j] + b[j + 1 :]
        for ra, rb in ((rest_a, rest_b), (rest_a, rest_b[::-1]), (rest_a[::-1], rest_b)):
            r = compare_given(ra, rb, common)
            if r == SAME:
                return SAME, ""
            if r == BY_INITIAL and best[0] == DIFFERENT:
                full = ra[0] if len(ra[0]) > 1 else rb[0]
                best = (BY_INITIAL, skeleton(min(_NICK_SOUND.get(full, {full}))))
            if len(rest_a) < 2 and len(rest_b) < 2 or all(len(t) == 1 for t in rest_a) or all(len(t) == 1 for t in rest_b):
                break
            if len(rest_a) >= 2 and len(rest_b) >= 2:
                break
            if i not in (0, len(a) - 1) or j not in (0, len(b) - 1):
                continue
            # a middle name may stand on one side; turned round only if the surname came first there
            if (i == 0) == (j == 0):
                break
    return best


def compare_person_forms(a: list[str], b: list[str], main_a: set[str], main_b: set[str], common: set[str]) -> tuple[int, str]:
    """compare_persons, also with a surname that was broken in two on one side put together again."""
    best = compare_persons(a, b, main_a, main_b, common)
    if best[0] == SAME or len(a) == len(b):
        return best
    long, short, main_long, main_short = (a, b, main_a, main_b) if len(a) > len(b) else (b, a, main_b, main_a)
    for i in range(len(long) - 1):
        if len(long[i]) < 3 or len(long[i + 1]) < 2 or long[i] in _KNOWN or long[i + 1] in _KNOWN:
            continue
        whole = _py_sound(long[i] + long[i + 1])
        if (r := compare_persons([*long[:i], whole, *long[i + 2 :]], short, main_long | {whole}, main_short, common))[0] == SAME:
            return r
    return best


def compare_firms(a: list[str], b: list[str]) -> int:
    """Every word of either has its like in the other; a name written together is compared as a whole."""
    x, y = "".join(a), "".join(b)
    if len(a) == 1 or len(b) == 1:
        return SAME if (len(a) != len(b) or len(x) > 5) and edits(x, y, max(1, len(x) // 10)) <= max(1, len(x) // 10) else DIFFERENT
    if len(a) != len(b):
        return SAME if edits(x, y, 1) <= 1 else DIFFERENT
    left = list(b)
    for t in sorted(a, key=len, reverse=True):
        found = next((u for u in left if u == t), None) or next((u for u in left if alike(t, u)), None)
        if found is None:
            return SAME if edits(x, y, 2) <= 2 else DIFFERENT
        left.remove(found)
    return SAME


RESULT = T.StructType([T.StructField("result", T.IntegerType()), T.StructField("given", T.StringType())])


@pandas_udf(RESULT)
def compare(kind: pd.Series, a: pd.Series, b: pd.Series, main_a: pd.Series, main_b: pd.Series) -> pd.DataFrame:
    out = []
    for k, x, y, mx, my in zip(kind, a, b, main_a, main_b):
        x, y, mx, my = list(x), list(y), set(mx), set(my)
        out.append(compare_person_forms(x, y, mx, my, (set(x) - mx) | (set(y) - my)) if k == "Person" else (compare_firms(x, y), ""))
    return pd.DataFrame(out, columns=["result", "given"])


def phonetic_codes(t: Column) -> Column:
    """Consonants, vowels, and the classes of sound of the first and of the last five letters (the classes are those of
    Soundex, vowels and silent letters being one more) of a token in the spelling of sound()."""
    consonants, vowels = F.regexp_replace(t, r"(?<=.)[aeiouh]", ""), F.concat(F.left(t, F.lit(1)), F.regexp_replace(t, r"[^aeiou]", ""))
    classes = F.translate(t, "aeiouhwbfpvgjkqsxzcdtlmnr", "0000000111122222222334556")
    return F.array(F.concat(F.lit("c"), consonants), F.concat(F.lit("v"), vowels), F.concat(F.lit("l"), F.left(classes, F.lit(5))), F.concat(F.lit("r"), F.right(classes, F.lit(5))))


def given_in_full(tokens: Column) -> Column:
    """The given names that nicknames among the tokens stand for; other tokens as they are."""
    full = F.create_map(*[F.lit(x) for x in chain(*((k, ",".join(sorted(v))) for k, v in _NICK_SOUND.items()))])
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.split(F.coalesce(F.try_element_at(full, t), t), ","))))


def forms_with_codes(forms: DataFrame) -> DataFrame:
    """forms: type, form, tokens (one row a form). Adds mains: the tokens that are neither known given names nor words of
    trades (or the longest, and the last of a person), and codes: the blocks of the form, each with the token that gives it (main).

    sure: one surname beside given names in full that are known. Two such persons are the same only with
    one given name or its nicknames, so they meet by `exact`, the code with the given name; codes with an initial are
    for the others. short: a form that has an initial or one token only, which no second code can stand for."""
    known, trades = sorted(_KNOWN), sorted({_py_sound(t) for t in (*TRADES, *ABBREVIATIONS.values())})
    usual = lambda t: F.when(F.col("type") == "Person", t.isin(known)).otherwise(t.isin(trades))
    rare = F.filter("tokens", lambda t: (F.length(t) >= 3) & ~usual(t))
    longest = F.array(F.element_at(F.array_sort(F.transform("tokens", lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), -1)["t"])
    last = F.when(F.col("type") == "Person", F.filter(F.slice("tokens", -1, 1), lambda t: F.length(t) >= 3)).otherwise(F.array().cast("array<string>"))
    rows = forms.withColumn("mains", F.when(F.size(rare) > 0, F.array_distinct(rare)).otherwise(F.array_distinct(F.concat(longest, last))))
    initials = F.create_map(*[F.lit(x) for x in chain(*((k, ",".join(sorted({k[0], *(f[0] for f in v)}))) for k, v in _NICK_SOUND.items()))])
    others = F.array_distinct(F.flatten(F.transform("tokens", lambda t: F.when(F.size("tokens") == 1, F.array(F.lit(""))).otherwise(F.split(F.coalesce(F.try_element_at(initials, t), F.left(t, F.lit(1))), ",")))))
    rows = rows.withColumn("others", F.when(F.col("type") == "Person", others).otherwise(F.array(F.lit(""))))
    codes = F.flatten(F.transform("mains", lambda t: F.flatten(F.transform("others", lambda o: F.transform(phonetic_codes(t), lambda c: F.struct(F.concat_ws("|", c, o).alias("code"), t.alias("main")))))))
    sure = (F.col("type") == "Person") & (F.size("mains") == 1) & (F.size("tokens") > 1) & F.forall("tokens", lambda t: F.length(t) >= 3)
    rows = rows.withColumn("sure", sure).withColumn("given", F.when(F.col("sure"), given_in_full(F.array_except("tokens", "mains"))).otherwise(F.array().cast("array<string>")))
    exact = F.flatten(F.transform("mains", lambda t: F.flatten(F.transform("given", lambda o: F.transform(phonetic_codes(t), lambda c: F.concat_ws("|", c, o))))))
    short = (F.size("tokens") == 1) | F.exists("tokens", lambda t: F.length(t) == 1)
    return rows.select("type", "form", "tokens", "mains", F.array_distinct(codes).alias("codes"), "sure", short.alias("short"), F.array_distinct(exact).alias("exact"))


def blocks_of(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks, in parts of at most BLOCK names: type, form, sure, short, block, bucket, own; and the number of names
    of each whole block. A larger block is dealt into buckets, every two of which make a part, and each one alone (own),
    so that any two names of a block meet whatever its size: in one bucket where own, else in different ones."""
    keys = coded.select("type", "form", "sure", "short", F.explode(F.array_distinct(F.transform("codes", lambda c: c["code"]))).alias("code"))
    sizes = cut(keys.groupBy("type", "code").agg(F.count(F.lit(1)).alias("n_rows")))
    sized = cut_table(heavy_split_join(keys, sizes, ["type", "code"], sizes))
    light = sized.filter(F.col("n_rows") <= BLOCK).select("type", "form", "sure", "short", F.col("code").alias("block"), F.lit(0).alias("bucket"), F.lit(True).alias("own"))
    half = max(1, BLOCK // 2)
    place = F.row_number().over(Window.partitionBy("type", "code").orderBy("form"))
    dealt = sized.filter(F.col("n_rows") > BLOCK).withColumn("bucket", F.floor((place - 1) / half).cast("int"))
    parts = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_rows") - 1) / half).cast("int"))))
    parts = parts.select("type", "form", "sure", "short", F.concat_ws("|", "code", F.least("bucket", "other"), F.greatest("bucket", "other")).alias("block"), "bucket", (F.col("bucket") == F.col("other")).alias("own"))
    return light.unionByName(parts), sizes


def same_forms(forms: DataFrame) -> DataFrame:
    """u, v: pairs of forms that name the same. A name with an initial only is linked if all full names that fit it
    have one given name."""
    coded = cut(forms_with_codes(forms))
    met = (F.col("a.block") == F.col("b.block")) & (F.col("a.type") == F.col("b.type"))
    ends = lambda df: df.select(F.least("a.form", "b.form").alias("u"), F.greatest("a.form", "b.form").alias("v")).filter("u < v")
    parts, _ = blocks_of(coded)
    exact = coded.select("type", "form", F.explode("exact").alias("block"))
    once = F.col("a.own") | (F.col("a.bucket") != F.col("b.bucket"))
    pairs = ends(parts.filter("not sure").alias("a").join(parts.alias("b"), met & once)).unionByName(ends(exact.alias("a").join(exact.alias("b"), met))).distinct()
    side = lambda n: coded.select(F.col("form").alias(n), F.col("type").alias(f"type_{n}"), F.col("tokens").alias(f"tokens_{n}"), F.col("mains").alias(f"mains_{n}"))
    full = pairs.join(side("u"), "u").join(side("v"), "v").repartition("u", "v")
    judged = cut(full.select("u", "v", "tokens_u", compare("type_u", "tokens_u", "tokens_v", "mains_u", "mains_v").alias("r")).select("u", "v", "r.result", "r.given", F.exists("tokens_u", lambda t: F.length(t) == 1).alias("u_short")).filter("result > 0"))
    strong = judged.filter(F.col("result") == SAME).select("u", "v")
    weak = judged.filter(F.col("result") == BY_INITIAL).select(F.when(F.col("u_short"), F.col("u")).otherwise(F.col("v")).alias("w"), F.when(F.col("u_short"), F.col("v")).otherwise(F.col("u")).alias("full"), "given")
    sure = weak.groupBy("w").agg(F.countDistinct("given").alias("n")).filter("n = 1").select("w")
    return strong.unionByName(weak.join(sure, "w", "left_semi").select(F.col("w").alias("u"), F.col("full").alias("v")))


def entity_clusters(records: DataFrame) -> DataFrame:
    """entity_id, type, cluster for every person and organisation. Null names and useless keys give no form; an
    entity without any form is alone. The cluster is the smallest form of it."""
    said = cut(name_forms(records))
    forms = said.groupBy("type", "form").agg(F.min("tokens").alias("tokens"))
    own = said.groupBy("entity_id", "type").agg(F.min("form").alias("first"))
    tied = said.join(own, ["entity_id", "type"]).filter(F.col("form") != F.col("first")).select(F.col("form").alias("u"), F.col("first").alias("v"))
    linked = connected_components(same_forms(forms).unionByName(tied.distinct()))
    return own.join(linked.withColumnRenamed("vertex", "first"), "first", "left").select("entity_id", "type", F.coalesce("component", "first").alias("cluster"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id_a, entity_id_b."""
    c = entity_clusters(table(spark, sf_dir, "extracted_entities"))
    a, b = c.select(F.col("entity_id").alias("entity_id_a"), "type", "cluster"), c.select(F.col("entity_id").alias("entity_id_b"), "type", "cluster")
    return a.join(b, ["type", "cluster"]).filter("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b").distinct()


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, type, cluster of every person and organisation: the membership that p4_found writes out in pairs."""
    return entity_clusters(table(spark, sf_dir, "extracted_entities"))


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, n_blocks, largest: the parts of blocks in which names are compared, and the names in the largest one."""
    said = name_forms(table(spark, sf_dir, "extracted_entities"))
    small, _ = blocks_of(cut(forms_with_codes(said.groupBy("type", "form").agg(F.min("tokens").alias("tokens")))))
    return small.groupBy("type", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("type").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("n").alias("largest"))


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found, "p4_clusters": p4_clusters, "p4_blocks": p4_blocks}
