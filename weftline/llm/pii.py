"""Personal information in free text: found with a semi-Markov conditional random field, replaced by placeholders.

Every span that could be a whole mailbox, telephone number, identity number, address or name becomes a segment of at
most SEGMENT characters with features of the whole span (shape, parts, length, kinds of its words) and of its
surroundings (cue words, neighbours, what it would cut off). A name may be any run of two to five capitalised words, with
initials and particles, in either order; in small letters it is proposed after a known given name, a title or a cue. A dynamic
programme over the text chooses the boundaries and types of all segments together, the one labelling of greatest
score; text outside segments scores 0. The weights are trained here, by the likelihood of labelled lines that are written
from templates (TRAIN_LINES of them, the bound of the sample), with forward and backward sums over the same
segments. Whole texts are read; they are never shuffled.

What kind of word a word is (common, proper, foreign, unknown) is told by the vocabularies of public tokenizers, whose
folder is a parameter: a word that is one token in small letters is a common one."""

from __future__ import annotations

import base64
import bisect
import json
import math
import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.lexicon import GIVEN
from weftline.llm.tokens import VOCABULARIES
from weftline.session import pick, spread, table

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: Labelled lines that the weights are fitted on, and rounds over them.
TRAIN_LINES, ROUNDS = 8000, 4
#: Characters of a segment at most: a mailbox has up to 64 before its sign and 253 after it. p8_report counts what is longer.
SEGMENT, BEFORE_SIGN, AFTER_SIGN = 400, 80, 320

PARTICLES = "de del della di da la le el al van von der den bin ben ter ten dos du".split()
TITLES = "mr mrs ms mx miss dr prof sir dame herr frau señor señora don doña monsieur madame mme".split()
# fixed values: words that show a firm or a work after a name
FIRM = "records music entertainment agency publishing editions library management association songs international production theatre company guild society union registry house trust rights media sound artist school hire office repairs insurance catering board council league circle fund bureau collective archive screen authors writers composers publishers broadcast royalties choral clearing mechanical neighbouring repertoire stage tonkunst verband derechos société musicales brass gmbh ltd inc limited sarl pty road street avenue festival band ensemble orchestra quartet mix reprise no".split()
STREET = "st street rd road ave avenue blvd boulevard terrace tce crescent cres lane ln drive dr place pl way court ct close parade pde square sq row grove highway hwy quay hill gardens walk mews".split()
CUES = {
    "phone": "phone tel telephone telefon téléphone teléfono call mobile office cell fax hotline handy number ring rappelez appelez llame anrufen durchwahl móvil portable whatsapp contact on al au".split(),
    "id": "passport id nationalid licence license tfn ssn nino dni nie nir tax security social identity identité ausweisnummer personalausweis steuer steuerid passeport pasaporte reisepass insurance driver file sécurité sociale carte cédula nif curp".split(),
    "code": "invoice facture rechnung factura batch release draft code codes codigo código clause version versions isrc iswc registered stored under as unter sous con gemeldet déposé inscrito example exemple beispiel ejemplo ticket order income advances credits tempo catalogue katalog catálogo boxes article paragraph matches".split(),
    "mail": "mail email e-mail write forward from mailto schreiben écrivez escriba queries contact correo courriel an à a to".split(),
    "place": "to at in address adresse anschrift domicile domicilio resident live lives moved form send sent wohnhaft dirección live visit".split(),
    "person": "by for from contact according attendance thanks signed von de par a an belongs gehört revient es ist regards sincerely dear with con composer author heirs llame an ansprechperson signé chair present dr mr mrs ms mx prof visit".split(),
}
# fixed values: words after which a person is named, the next word or the one after it
WHO = set("contact dear hello hi thanks thank regards sincerely signed according attendance present attn name named interview written holder titulaire issued undersigned belongs owned told met asked joined sender author composer heirs cher chère bonjour merci contactez appelez rappelez signé nom lieber liebe hallo danke ansprechperson gezeichnet unterzeichnet inhaber gehört estimado estimada hola gracias llame firmado nombre dossier unterlagen solicitud revient parte".split())
_CUE = {w: k for k, ws in reversed(CUES.items()) for w in ws}
_CUES_OF = {w: [k for k, ws in CUES.items() if w in ws] for w in _CUE}
# fixed values: words that join others in the four languages, and words that open sentences
FUNCTION = "the a an this that these those it its he she they we you i and or but of in on at to for from with by as is are was were be has have had not no if when while after before since during under over between about into than then there here where who what which how why can may must will would should please see all any each every some other both le la les un une des du de et ou mais dans sur pour par avec sans est sont était ce cette ces il elle ils nous vous je qui que quoi où comment pourquoi si quand après avant chaque tout tous der die das den dem des ein eine einen einem einer und oder aber in im am an auf für mit von zu zum zur bei nach aus ist sind war wird werden nicht wenn als wer was wie warum sie er es wir ihr ich jede jeder jedes alle el la los las un una unos unas y o pero en con por para sin es son fue del al que quien como cuando donde si no se su sus cada todo todos cualquier"
DIGITS = "oh zero one two three four five six seven eight nine double triple null eins zwei drei vier fünf sechs sieben acht neun".split()



def _ranges(category: str) -> str:
    """The letters of a Unicode category (of the basic plane) as the inside of a character class."""
    at = [cp for cp in range(0x10000) if unicodedata.category(chr(cp)) == category]
    out, i = [], 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1] == at[j] + 1:
            j += 1
        out.append(re.escape(chr(at[i])) + (f"-{re.escape(chr(at[j]))}" if j > i else ""))
        i = j + 1
    return "".join(out)


_UP, _LOW, _L, _N = f"[{_ranges('Lu')}]", f"[{_ranges('Ll')}]", r"[^\W\d_]", r"[^\W_]"
_REST = rf"(?:{_L}|['’\u0300-\u036f])"
WORD = re.compile(rf"{_L}{_REST}*(?:[-‐]{_L}{_REST}*)*")
_CAP = rf"{_UP}{_REST}*(?:[-‐]{_L}{_REST}*)*"
_PARTICLE = rf"(?:{'|'.join(PARTICLES)})"
#: Capitalised words, initials and particles in a row; a comma or a line end may stand between.
CAPS_RUN = re.compile(rf"(?<!{_N}){_CAP}(?:(?:\.? ?|,? |[ \u00a0]{{1,3}}|\.?\n)(?:{_PARTICLE} )?{_CAP})+")
_TOKEN = re.compile(rf"{_CAP}|(?<!{_N}){_PARTICLE}(?= )")
EMAIL = re.compile(rf"(?<![\w.%+\-])\w[\w.%+\-]*(?:\s?[@＠]\s?|\s?(?:\(|\[|\{{|<)(?i:at)(?:\)|\]|\}}|>)\s?|\s(?i:at)\s|&#64;|%40){_N}(?:{_N}|-)*(?:(?:\.|\s?(?:\(|\[|\{{)(?i:dot)(?:\)|\]|\}})\s?|\s(?i:dot)\s){_N}(?:{_N}|-)*)+")
NUMBER = re.compile(rf"(?:\+|\(\+?)?\d(?:[\d ()./\-–‑\u00a0]{{2,30}})\d(?:[ \-]?{_L}\b)?(?:,?\s?(?:ext\.?|extension|x|Durchwahl|App\.|poste|anexo)\s?\d{{1,5}})?")
_HEAD = re.compile(rf"(?<!{_N})(?:{_UP}{{1,2}}[ \-]|{_L}{{1,2}})$")
_EXT = re.compile(r",?\s?(?:ext\.?|extension|x|Durchwahl|App\.|poste|anexo)\s?\d{1,5}$")
_TAIL = re.compile(rf"[ \-]?{_L}$")
_GROUP, _PLAIN, _DIGIT, _UPPER, _LOWERS = re.compile(r"\d+"), re.compile(_N), re.compile(r"\d"), re.compile(_UP), re.compile(_LOW + "+")
_AT = re.compile(r"[@＠]|[(\[{<](?i:at)[)\]}>]|&#64;|%40")
_AT_WORD, _DOT_WORD = re.compile(r"\s(?i:at)\s"), re.compile(r"(?i)\sdot\s")
_POSTCODE = re.compile(r"\d{4,5}$|\d{5}\s")
SPELLED = re.compile(r"\b(?:(?:" + "|".join(DIGITS) + r")[ ,\-]+){5,}(?:" + "|".join(DIGITS) + r")\b", re.I)
_W = rf"{_UP}(?:{_L}|['’\-\u0300-\u036f])+"
_TOWN = rf"{_W}(?:[ \-]{_W}){{0,2}}"
_UNIT = rf"(?<![\w/\-.])(?:(?i:unit|flat|apt\.?|apartment|suite|level|room)\s+{_L}?\d+{_L}?(?:,\s*|/|\s+))?"
#: A plain sign of an address (what can be looked for quickly), how far before it the address may begin, its pattern.
ADDRESSES = [
    (re.compile(rf"\d{_L}?[ \t]+{_UP}"), 40, re.compile(rf"({_UNIT}\d+{_L}?(?:[/\-]\d+{_L}?)?[ \t]+(?!The\b){_W}(?:[ \t]+{_W}){{0,2}}?[ \t]+(?i:{'|'.join(STREET)})\b(?:\.(?=,|\s{_UP}|\s*\n))?)((?:,\s*|\s+|\s*\n\s*){_TOWN})?((?:,?\s+){_UP}{{2,3}}\b)?((?:,?\s+)\d{{4,5}}\b)?"), "en"),
    (re.compile(r"(?i)\d(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|impasse|avenue|av\.|bd|boulevard|place|chemin|all[ée]e|quai|route|cours|passage|square)\s"), 20, re.compile(rf"(\d+(?:\s?(?:bis|ter|quater))?,?\s+(?i:rue|impasse|avenue|av\.|bd|boulevard|place|chemin|allée|allee|quai|route|cours|passage|square)\s+(?:(?:de la|de l['’]|du|des|de|d['’])\s?)?{_W}(?:\s+{_W})?)((?:,?\s+)\d{{5}})?(\s+{_TOWN})?"), "fr"),
    (re.compile(r"(?<=[a-zäöüß .A-Z])(?:[sS]tra(?:ß|ss)e|[sS]tr\.|[gG]asse|[wW]eg|[pP]latz|[aA]llee|[uU]fer|[dD]amm|[rR]ing|STRASSE|STR\.|GASSE|WEG|PLATZ|ALLEE)\s+\d"), 80, re.compile(rf"({_W}(?i:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring)\s+\d+(?:\s?{_L}\b)?|{_W}\s+(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ufer|Damm|Ring)\s+\d+(?:\s?{_L}\b)?)((?:,?\s+(?:in\s+)?)\d{{5}})?(\s+{_TOWN})?"), "de"),
    (re.compile(r"(?i)(?<!\w)(?:calle|c/|avenida|avda\.?|av\.|plaza|paseo|pza\.|camino|ronda|carrer)\s"), 0, re.compile(rf"(?<!\w)((?i:calle|c/|avenida|avda\.?|av\.|plaza|paseo|pza\.|camino|ronda|carrer)\s+(?:(?:de la|de los|de las|del|de)\s+)?{_W}(?:\s+{_W})?,?\s+\d+(?:\s?{_L}\b)?(?:,\s*\d+\s?[ºª°]\s*{_L}?\b)?)((?:,?\s+)\d{{5}})?(\s+{_TOWN})?"), "es"),
]
#: Two or three words in small letters after a title or a cue that a person's name follows.
LOW_NAME = re.compile(rf"(?<!\w)(?:(?:[Dd]r|[Mm]rs?|[Mm]s|[Pp]rof|[Ss]ra?|[Mm]me|[Mm]iss|[Ff]rau|[Hh]err)\.? |(?:[Ss]igned|[Ss]ent|[Ww]ritten|[Ff]iled|[Ss]igné|[Uu]nterschrieben|[Ff]irmado) (?:by|par|von|por) |(?:[Nn]ame|[Cc]ontact|[Aa]ttn|[Nn]om|[Nn]ombre): )({_LOW}(?:{_L}|['’])+(?: {_PARTICLE})?(?: {_LOW}(?:{_L}|['’\-]){{2,}}){{1,2}})(?![\w'’\-])")
_DIGIT_WORDS = set(DIGITS)


@lru_cache(200_000)
def fold(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))


_GIVEN = {"".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in GIVEN}
_LISTED = _GIVEN | set(GIVEN)
_FIRM, _TITLE, _PART = set(FIRM), set(TITLES), set(PARTICLES)
_FUNC = set(FUNCTION.split())
_STREET = set(STREET) - {"st", "dr", "al", "la"}
_COMMON = {"C", "F", "i"}
_LOW_CUES = set(TITLES) | set("signed sent written filed signé unterschrieben firmado name contact attn nom nombre".split())
_LONE = "AIOYEÀ"  # single letters that are words
_TITLED = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(TITLES)})\.? $")
_PARTICLE_END = re.compile(rf"(?<!\w)({_PARTICLE}) $")
_SHOUT = re.compile(rf"{_UP}{{2,}},? $")

@dataclass
class Lexicon:
    """Words by the vocabularies: common ones, proper ones, capitalised ones of many languages, those of a vocabulary in
    small letters; kinds of words that were looked up before."""

    common: frozenset = frozenset()
    proper: frozenset = frozenset()
    many: frozenset = frozenset()
    known: frozenset = frozenset()
    kinds: dict[str, str] = field(default_factory=dict, repr=False, compare=False)


_EDGES = ".,;:!?()[]{}<>\"“”„«»|*#>-–"


@lru_cache(1)
def lexicon(folder: str = VOCABULARIES) -> Lexicon:
    """From the byte-level vocabularies and the one of small letters in the folder; empty sets if they are not there."""

    def tokens(name: str) -> set[str]:
        path = Path(folder) / name
        if not path.exists():
            return set()
        said = (base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in path.read_bytes().splitlines() if line)
        return {t[1:] for t in said if t[:1] == " " and t[1:].isalpha() and len(t) > 3}

    english, many = tokens("byte_bpe_50k.tiktoken"), tokens("byte_bpe_multi_50k.tiktoken")
    small = Path(folder) / "word_bpe_49k.json"
    known = {t[:-4] for t in json.loads(small.read_text())["model"]["vocab"] if t.endswith("</w>") and t[:-4].isalpha() and len(t) > 7} if small.exists() else set()
    return Lexicon(frozenset(w for w in english | many if w.islower()), frozenset(w for w in english if w.istitle()), frozenset(w for w in many if w.istitle()), frozenset(known))


def shape(s: str) -> str:
    return _LOWERS.sub("x", _UPPER.sub("X", _DIGIT.sub("9", s)))


class Text:
    """A text and the segments that could be personal information; over: how many were too long to be one."""

    def __init__(self, text: str, words: Lexicon | None = None) -> None:
        self.text, self.lexicon, self.over = text, words or Lexicon(), 0
        self._kinds = self.lexicon.kinds
        self.segments: dict[tuple[int, int, str], list[str]] = {}
        self._near: dict[int, tuple] = {}
        self.low = text.lower()
        self.said = {w.strip(_EDGES) for w in self.low.split()}
        self._emails()
        self._numbers()
        self._addresses()
        self._names()

    def kind(self, w: str) -> str:
        if (k := self._kinds.get(w)) is None:
            if len(self._kinds) > 100_000:
                self._kinds.clear()
            k = self._kinds[w] = self._kind(w)
        return k

    def _kind(self, w: str) -> str:
        """i initial, G listed given name, F function word, C common, P proper, N of another language, W known in small letters only, O unknown."""
        if len(w) == 1:
            return "i"
        f = w.lower()
        if f in _LISTED or not f.isascii() and fold(f) in _GIVEN:
            return "G"
        if f in _FUNC or f[:2] in ("l'", "l’"):
            return "F"
        f = f.rsplit("-", 1)[-1]
        x = self.lexicon
        return "C" if f in x.common else "P" if (t := f.capitalize()) in x.proper else "N" if t in x.many else "W" if f in x.known else "O"

    def _before(self, at: int) -> list[str]:
        """Up to four words before a place, nearest first, within the line."""
        left = self.text[max(0, at - 60) : at]
        return [w.lower() for w in WORD.findall(left[left.rfind("\n") + 1 :])[-4:]][::-1]

    def _around(self, a: int) -> tuple[list[str], set[str], str]:
        """Words before, features of them, mark directly before."""
        if (known := self._near.get(a)) is None:
            before = self._before(a)
            seen = {c for i, w in enumerate(before) for c in _CUES_OF.get(w, ()) if i < 3 or c in ("id", "code")}
            f = {"cue=" + c for c in seen} or {"cue=none"}
            mark = self.text[:a][-2:].strip(" ")[-1:] if a else "^"
            mark = mark if mark and not mark.isalnum() else "w" if mark else "s"
            f.add("mark=" + mark)
            if before and mark in "ws:":
                f |= {"near=" + c for c in _CUES_OF.get(before[0], ())}
                f.add("after=" + self.kind(before[0]))
            known = self._near[a] = (before, f, mark)
        return known

    def _after(self, at: int) -> str:
        m = WORD.match(self.text, at + 1) if self.text[at : at + 1] in (" ", "\u00a0") else None
        return m.group() if m else ""

    def add(self, kind: str, a: int, b: int, feats: list[str]) -> None:
        if b <= a:
            return
        if b - a > SEGMENT:
            self.over += 1
            return
        t = self.text
        left = t[a - 1] if a else "\n"
        right = t[b] if b < len(t) else "\n"
        f = [*feats]
        if kind in ("NAME", "PHONE", "ID_NUMBER"):
            f += [*self._around(a)[1], "next=" + (right if not right.isalnum() else "w")]
        if left.isalnum() or left in "@＠._+-/" and a > 1 and t[a - 2].isalnum():
            f.append("cut-left")
        if right.isalnum() or right in "@＠_-/" and b + 1 < len(t) and t[b + 1].isalnum() or right == "." and b + 1 < len(t) and t[b + 1].isalnum():
            f.append("cut-right")
        f.append("bias")
        self.segments[(a, b, kind)] = f

    def _emails(self) -> None:
        t = self.text
        signs = list(_AT.finditer(t))
        if " dot " in t or " DOT " in t or _DOT_WORD.search(t):
            signs += list(_AT_WORD.finditer(t))
        seen = set()
        for sign in signs:
            for m in EMAIL.finditer(t, max(0, sign.start() - BEFORE_SIGN), min(len(t), sign.end() + AFTER_SIGN)):
                if not m.start() <= sign.start() < m.end() or m.span() in seen:
                    continue
                seen.add(m.span())
                s = m.group()
                marked = bool(_AT.search(s))
                if not marked and not _DOT_WORD.search(s):
                    continue
                feats = ["marked" if marked else "words", "spaced" if " " in s else "whole", "dots" if "dot" in s.lower() else "point"]
                self.add("EMAIL", m.start(), m.end(), feats)
                if " " in s and "dot" not in s.lower():  # "local @ host.tld" may also be a mailbox that ends earlier
                    self.add("EMAIL", m.start(), m.start() + len(s.rstrip()), feats)

    def _numbers(self) -> None:
        t = self.text
        if not _DIGIT_WORDS.isdisjoint(self.said):
            for m in SPELLED.finditer(t):
                self.add("PHONE", m.start(), m.end(), ["spelled"])
        for m in NUMBER.finditer(t):
            a, b = m.span()
            s = m.group()
            if len(_DIGIT.findall(s)) < 6:
                continue
            ends, starts = {b}, {a}
            if head := _HEAD.search(t[max(0, a - 4) : a]):
                starts.add(max(0, a - 4) + head.start())
            if ext := _EXT.search(s):
                ends.add(a + ext.start())
            if tail := _TAIL.search(s):
                ends.add(a + tail.start())
            for x in starts:
                for y in ends:
                    self._number(x, y, "ext" if ext and y == b else "ext-cut" if ext else "no-ext")

    def _number(self, a: int, b: int, ext: str) -> None:
        s = self.text[a:b]
        while s and s[0] == "(" and s.count("(") > s.count(")"):
            a, s = a + 1, s[1:]
        while s and s[-1] in " .-/(":
            b, s = b - 1, s[:-1]
        n = len(_DIGIT.findall(s))
        if n < 6 or n > 20:
            return
        parts = _GROUP.findall(s)
        groups = [len(g) for g in parts]
        seps = "".join(sorted(set(_PLAIN.sub("", s))))
        f = [f"shape={shape(s)}", f"groups={groups[:6]}", f"n={n}", f"seps={seps}", f"first={s[0] if s[0] in '+(' else 'L' if s[0].isalpha() else '0' if s[0] in '0０' else 'd'}", "letters" if any(c.isalpha() for c in s) else "digits", ext]
        if any(len(g) == 4 and g[:2] in ("19", "20") for g in parts):
            f.append("year")
        self.add("PHONE", a, b, f)
        self.add("ID_NUMBER", a, b, f)

    def _addresses(self) -> None:
        t = self.text
        for sign, back, pattern, lang in ADDRESSES:
            done = 0
            if lang == "de" and not any(w in self.low for w in ("stra", "str.", "gasse", "weg ", "platz", "allee", "ufer", "damm", "ring ")):
                continue
            for hint in sign.finditer(t):
                if hint.start() < done:
                    continue
                starts = (m for x in range(max(done, hint.start() - back), hint.start() + 1) if (m := pattern.match(t, x, hint.start() + SEGMENT)) and m.end() > hint.start())
                for m in starts:
                    done = m.end()
                    ends = {m.end(1)}
                    last = m.end(1)
                    if t[last - 1] == ".":
                        ends.add(last - 1)
                    for g in range(2, pattern.groups + 1):
                        if m.group(g) and m.start(g) == last:
                            last = m.end(g)
                            ends.add(last)
                    for b in ends:
                        parts = sum(1 for g in range(2, pattern.groups + 1) if m.group(g) and m.end(g) <= b)
                        more = "more" if b < last else "all"
                        over = "lines" if "\n" in t[m.start() : b] else "line"
                        code = "postcode" if _POSTCODE.search(t[m.start(1) + 3 : b]) else "nocode"
                        self.add("ADDRESS", m.start(), b, [lang, f"parts={parts}", more, over, code, f"{lang}-{more}"])
                    break

    def _name(self, a: int, b: int, words: list[str], feats: list[str]) -> None:
        """A name of these words (particles among them); its kinds tell given from family names."""
        t = self.text
        plain = [w for w in words if w.lower() not in _PART]
        kinds = [self.kind(w) for w in plain]
        if len(plain) < 2 or not any(len(w) > 2 for w in plain):
            return
        before, _, mark = self._around(a)
        prev = before[0] if before and mark in "w.s" else ""
        titled = prev in _TITLE
        if not titled and _COMMON.issuperset(kinds):
            return  # nothing but common words names nobody without a title
        if len(plain[-1]) == 1 and t[b : b + 1] == ".":
            b += 1
        f = [*feats, "kinds=" + "".join(kinds), f"first={kinds[0]}", f"last={kinds[-1]}", f"words={len(plain)}", "listed" if "G" in kinds else "unlisted"]
        low = [w.lower() for w in plain]
        if not _FIRM.isdisjoint(low):
            f.append("firm-inside")
        if not _TITLE.isdisjoint(low):
            f.append("title-inside")
        if not _STREET.isdisjoint(low):
            f.append("street-inside")
        nxt = self._after(b)
        if nxt[:1].isupper():
            f.append("capital-next")
            if nxt.lower() in _FIRM:
                f.append("firm-next")
        strong = mark == ";" or (before and mark in "ws:." and not WHO.isdisjoint(before[:2]))
        f.append("who" if strong else "nowho")
        if not titled:
            f.append(f"{'who' if strong else 'nowho'}-{''.join(kinds)}")
            f.append(f"{'who' if strong else 'nowho'}-{'listed' if 'G' in kinds else 'unlisted'}")
        cued = "person" in _CUES_OF.get(prev, ()) or mark in ":;" or titled
        f.append("titled" if titled else "cued" if cued else "plain-left")
        if prev == "the":
            f.append("the")
        if prev in ("and", "of", "und", "et", "y"):
            f.append("joined")
        caps = [w.isupper() and len(w) > 1 for w in plain]
        f.append("caps" if all(c or len(w) == 1 for c, w in zip(caps, plain)) else "low" if all(w.islower() for w in plain) else "some-caps" if any(caps) else "mixed")
        if "caps" in f and (nxt.isupper() and len(nxt) > 1 or _SHOUT.search(t[max(0, a - 20) : a])):
            f.append("shouting")
        self.add("NAME", a, b, f)

    def _names(self) -> None:
        t = self.text
        kind = self.kind
        for run in CAPS_RUN.finditer(t):
            a, b = run.span()
            if all(kind(w.strip(_EDGES)) in "CF" for w in run.group().split()) and not _TITLED.search(t, max(0, a - 12), a):
                continue  # nothing but common words names nobody without a title
            self._in_run(a, b)
        for w in _LISTED.intersection(self.said):
            for m in re.finditer(rf"(?<!\w){re.escape(w)}(?!\w)", t):  # in small letters
                self._low(m.start(), m.end())
        for m in LOW_NAME.finditer(t) if not _LOW_CUES.isdisjoint(self.said) else ():
            a, b = m.span(1)
            words = m.group(1).split(" ")
            self._name(a, b, words, ["plain"])
            if len(words) > 2 and words[1].lower() not in _PART:
                self._name(a, a + len(words[0]) + 1 + len(words[1]), words[:2], ["plain"])

    def _in_run(self, a: int, b: int) -> None:
        """Every window of two to four capitalised words in a run."""
        t, kind = self.text, self.kind
        at = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(t, a, b)]
        kinds = [kind(w[2]) for w in at]
        if _COMMON.issuperset(kinds) and not _TITLED.search(t, max(0, a - 12), a) and _TITLE.isdisjoint(w[2].lower() for w in at):
            return  # nothing but common words names nobody without a title
        if t[a - 1 : a] == " " and (before := _PARTICLE_END.search(t, max(0, a - 5), a)):  # the particle of a family name that stands first
            at.insert(0, (before.start(1), before.end(1), before.group(1)))
            kinds.insert(0, "F")
        part = [w[2].lower() in _PART for w in at]
        for i, k in enumerate(kinds):
            k = "F" if len(at[i][2]) == 1 and at[i][2] in _LONE and t[at[i][1] : at[i][1] + 1] != "." else k
            kinds[i] = k
        n = len(at)
        for i in range(n - 1):
            low = part[i] and at[i][2][0].islower()  # a particle begins a name only where the family name stands first
            if kinds[i] == "F" and not low:
                continue
            caps, commas, line = 0, 0, False
            for j in range(i, n):
                if j > i:
                    gap = t[at[j - 1][1] : at[j][0]]
                    if gap != " ":
                        short = len(at[j - 1][2]) == 1
                        if gap[:1] == ",":
                            commas += 1
                            if commas > 1 or caps > 2 or short:
                                break
                        elif "." in gap and not short:
                            break
                        line = line or "\n" in gap
                if part[j]:
                    continue
                if kinds[j] == "F":
                    break
                caps += 1
                if caps > 4:
                    break
                if caps >= 2 and (commas or not low):
                    feats = ["comma" if commas else "plain"]
                    if commas and kinds[j] == "i" and j == i + 1:
                        feats.append("comma-initial")
                    if line:
                        feats.append("over-line")
                    if low:
                        feats.append("particle-first")
                    if at[i][2].isupper() and len(at[i][2]) > 1 and not at[j][2].isupper():
                        feats.append("shout")
                    self._name(at[i][0], at[j][1], [x[2] for x in at[i : j + 1]], feats)

    def _low(self, a: int, b: int) -> None:
        """A known given name in small letters at a to b, with the words beside it."""
        t = self.text
        if m := re.compile(rf" (?:{_PARTICLE} ){{0,2}}({_LOW}(?:{_L}|['’])+(?:-{_L}(?:{_L}|['’])+)*)").match(t, b):
            words = t[a : m.end()].split(" ")
            if len(m.group(1)) > 2:
                self._name(a, m.end(), words, ["plain"])
        left = t[max(0, a - 50) : a]
        if m := re.search(rf"(?<!\w)((?:{_PARTICLE} )?{_LOW}(?:{_L}|['’])+(?:-{_L}(?:{_L}|['’])+)*)(,? )$", left):
            begin = max(0, a - 50) + m.start(1)
            self._name(begin, b, [*m.group(1).split(" "), t[a:b]], ["comma" if "," in m.group(2) else "turned"])


Weights = dict[str, dict[str, float]]  # by type and feature


def score(feats: list[str], weights: dict[str, float]) -> float:
    get = weights.get
    return sum([get(f, 0.0) for f in feats])


def decode(text: Text, weights: Weights) -> list[tuple[int, int, str]]:
    """The segments of the best labelling."""
    segs = sorted(((a, b, k, score(f, weights.get(k, {}))) for (a, b, k), f in text.segments.items()), key=lambda s: s[1])
    segs = [s for s in segs if s[3] > 0]
    if not segs:
        return []
    ends = [s[1] for s in segs]
    best: list[tuple[float, int]] = [(0.0, -1)]  # by number of segments considered: score, last segment taken
    for n, (a, _, _, v) in enumerate(segs):
        with_it = best[bisect.bisect_right(ends, a, 0, n)][0] + v
        best.append((with_it, n) if with_it > best[-1][0] else (best[-1][0], -1))
    out, n = [], len(segs)
    while n:
        if best[n][1] < 0:
            n -= 1
            continue
        a, b, k, _ = segs[best[n][1]]
        out.append((a, b, k))
        n = bisect.bisect_right(ends, a, 0, n - 1)
    return out[::-1]


def marginals(segs: list[tuple[int, int, float]]) -> tuple[float, list[float]]:
    """segs: begin, end, score. Log of the sum over all labellings, and the chance of each segment."""
    places = sorted({p for a, b, _ in segs for p in (a, b)})
    at = {p: i for i, p in enumerate(places)}
    n = len(places)
    by_end: list[list[int]] = [[] for _ in range(n)]
    by_begin: list[list[int]] = [[] for _ in range(n)]
    for k, (a, b, _) in enumerate(segs):
        by_end[at[b]].append(k)
        by_begin[at[a]].append(k)

    def add(xs: list[float]) -> float:
        m = max(xs)
        return m + math.log(sum(math.exp(x - m) for x in xs))

    alpha, beta = [0.0] * n, [0.0] * n
    for i in range(1, n):
        alpha[i] = add([alpha[i - 1], *(alpha[at[segs[k][0]]] + segs[k][2] for k in by_end[i])])
    for i in range(n - 2, -1, -1):
        beta[i] = add([beta[i + 1], *(beta[at[segs[k][1]]] + segs[k][2] for k in by_begin[i])])
    z = alpha[-1] if n else 0.0
    return z, [math.exp(alpha[at[a]] + s + beta[at[b]] - z) for a, b, s in segs]


def train(lines: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = ROUNDS, words: Lexicon | None = None) -> Weights:
    """Weights of greatest likelihood of the labelled lines (text, gold segments), by adaptive gradient steps with a
    small penalty, averaged over the later rounds. A gold segment that no pattern proposes cannot be learned and is left out."""
    weights: Weights = {k: {} for k in TYPES}
    seen: dict[tuple[str, str], float] = {}
    data = [(t := Text(line, words), [g for g in gold if g in t.segments]) for line, gold in lines]
    rnd = random.Random(11)
    kept: list[Weights] = []
    for n in range(rounds):
        rnd.shuffle(data)
        for text, gold in data:
            if not text.segments:
                continue
            keys = list(text.segments)
            _, p = marginals([(a, b, score(text.segments[(a, b, k)], weights[k])) for a, b, k in keys])
            gradient: dict[tuple[str, str], float] = {}
            for key, chance in zip(keys, p):
                d = (key in gold) - chance
                if abs(d) > 1e-4:
                    for f in text.segments[key]:
                        gradient[key[2], f] = gradient.get((key[2], f), 0.0) + d
            for (k, f), g in gradient.items():
                w = weights[k].get(f, 0.0)
                g -= 1e-3 * w
                seen[k, f] = seen.get((k, f), 1e-6) + g * g
                weights[k][f] = w + 0.4 * g / math.sqrt(seen[k, f])
        if n >= rounds // 2:
            kept.append({k: dict(own) for k, own in weights.items()})
    return {k: {f: sum(w[k].get(f, 0.0) for w in kept) / len(kept) for f in own} for k, own in weights.items()}


# fixed values: given and family names that are not in the list of given names, so that weights do not lean on it
OTHER_GIVEN = "alice kevin susan jennifer kwame ngozi brian karen steven patricia gary deborah chidi amara tunde folake rajesh priya sanjay mei hiroshi minh linh dmytro oksana jakub agnieszka zoltan ilona matteo chiara thiago beatriz rodrigo ximena laurent delphine thierry sabine uwe heike jorge rocio".split()
OTHER_FAMILY = "johnson smith miller brown taylor wilson davies o'brien murphy mcdonald okafor mensah adeyemi patel sharma nguyen tran kowalski novak horvat rossi bianchi silva santos garcia lopez fernandez schmidt weber fischer dupont moreau lefebvre tanaka suzuki kim park ivanov petrov haddad rahman".split()


def training_lines(n: int = TRAIN_LINES, seed: int = 5, words: Lexicon | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled lines from templates: carriers of personal information in four languages, and lines whose numbers,
    titles, firms, works, places and handles are none. The templates are written for this purpose; four names of ten are
    not in the list of given names."""
    r, words = random.Random(seed), words or Lexicon()
    pick_ = r.choice
    digits = lambda k: "".join(pick_("0123456789") for _ in range(k))
    upper = lambda k: "".join(pick_("ABCDEFGHKLMNPQRSTUVWXYZ") for _ in range(k))

    def word() -> str:
        return "".join(pick_("b br d dr f g gr h j k kl l m n p pl pr r s sk st t tr v w y z".split()) + pick_("a e i o u ai ei ou".split()) for _ in range(r.randint(2, 3))) + pick_("k l m n r s t nd".split())

    cap = lambda: word().capitalize()
    first = "amber silent golden distant hollow frozen scarlet gentle rusty sleepy broken modern famous secret annual general national final open early".split()
    thing = "bridge garden letter signal lantern mirror river harbour orchard window chimney market ledger whistle engine meeting report survey season chapter service committee manager director editor project".split()
    common, known = sorted(words.common) or first, sorted(words.known - _LISTED) or thing
    many = sorted(w.lower() for w in words.many) or thing
    odd = lambda: pick_(pick_([common, known, known, many])).title()
    work = lambda: pick_([f"{odd()} {odd()}", f"{odd()} {odd()}", f"The {odd()} {odd()}", f"{odd()} of {cap()}", f"{odd()} and {odd()}", f"{cap()} {odd()}", f"{cap()} {odd()}"]) if r.random() < 0.7 else pick_([f"The {pick_(first).title()} {pick_(thing).title()}"] * 2 + [f"{pick_(first).title()} {pick_(thing).title()}"] * 3 + [f"{pick_(first).title()} {pick_(thing).title()} No. {r.randint(1, 40)}", f"{pick_(thing).title()} of {cap()}", f"{pick_(first).title()} {pick_(first).title()} {pick_(thing).title()}", f"{pick_(thing).title()} and {pick_(thing).title()}"])
    firm = lambda: f"{pick_([cap(), cap(), pick_(OTHER_FAMILY).title(), pick_(GIVEN).title()])} {pick_('Records;Music Publishing;Theatre Company;Rights Management;Agency;Council;Sound Library;Media;Entertainment;Editions;Songs;Insurance;Repertoire House;Bank;University;Hospital;Airlines;Clearing House;Motors;Consulting;Society;Production Music;GmbH;Ltd;Association'.split(';'))}"
    place = lambda: pick_([f"{pick_('North South East West New Lake Mount Port Upper Saint Great'.split())} {cap()}", f"{cap()} {pick_('Valley Bay Island Hills Beach Park Square Road Avenue Castle County'.split())}", *([f"{cap()} {cap()} Hills"] * 3), pick_("New York;San Francisco;Hong Kong;Los Angeles;Buenos Aires;North Carolina;Great Britain;Costa Rica;Cape Town;São Paulo;Sri Lanka".split(";"))])
    nouns = lambda: pick_("Kleine Beträge;Neue Regeln;Offene Posten;Gute Fahrt;Erste Hilfe;Große Säle;Der Ausschuss;Die Sitzung;Freie Plätze;Les Recettes;La Commission;Conseil Général;Société Nationale;Junta Directiva;Consejo Nacional;Obras Completas".split(";"))
    part = lambda: pick_("Kopie Liste Partitur Dauer Ausgabe Aufnahme Probe Titel Copie Liste Prix Partition Durée Édition Lista Copia Partitura Edición Duración".split())
    code = lambda: pick_([f"T-{digits(3)}.{digits(3)}.{digits(3)}-{digits(1)}", f"{upper(2)}-{upper(1)}{digits(1)}{upper(1)}-{digits(2)}-{digits(5)}", f"{digits(2)}-{digits(3)}-{pick_(['19', '20'])}{digits(2)}-{digits(3)}", f"{digits(3)}-{pick_(['19', '20'])}{digits(2)}", f"{r.randint(1, 400)}-{pick_(['19', '20'])}{digits(2)}-{r.randint(1, 400)}", f"{r.randint(1, 400)}.{r.randint(1, 400)}.{r.randint(0, 9)}", f"4.{digits(3)}.{digits(3)}", f"{upper(3)}{digits(8)}", f"{digits(4)}-{digits(2)}-{digits(2)}"])

    def name() -> str:
        x = r.random()
        g = (pick_(GIVEN) if x < 0.6 else pick_(OTHER_GIVEN) if x < 0.85 else word()).capitalize()
        s = (cap() if r.random() < 0.7 else "-".join(v.capitalize() for v in pick_(OTHER_FAMILY).split("-"))) + (f"-{cap()}" if r.random() < 0.12 else "")
        mid = pick_([f" {upper(1)}."] * 2 + [""] * 6 + [f" {pick_(PARTICLES)}"] * 2)
        full = pick_([f"{g}{mid} {s}"] * 9 + [f"{s}, {g}"] * 2 + [f"{s.upper()} {g}", f"{upper(1)}. {s}", f"{upper(1)}. {s}", f"{upper(1)}. {upper(1)}. {s}", f"{s}, {g} {upper(1)}.", f"{g}\u00a0{s}"])
        x = r.random()
        return full.upper() if x < 0.12 else full.lower() if x < 0.2 and "." not in full else full

    def mail() -> str:
        host = f"{word()}{pick_(['', '-music', 'mail', '.mail', '.co', '-' + word()])}"
        tld, local = pick_("example test invalid com org net de fr es".split()), pick_([f"{word()}{digits(2)}", f"{word()}.{word()}", f"{pick_('abcdef')}_{word()}", f"{word()}+{pick_(['news', 'kb', 'apply'])}", word()])
        m = pick_([f"{local}@{host}.{tld}"] * 4 + [f"{local}＠{host}.{tld}", f"{local} @ {host}.{tld}", f"{local} (at) {host} (dot) {tld}", f"{local}[at]{host}.{tld}", f"{local} AT {host} DOT {tld}", f"{local} at {host} dot {tld}"])
        return m.upper() if r.random() < 0.05 else m

    def phone() -> str:
        wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in s)
        small = lambda: pick_(DIGITS[:10])
        sep = pick_([" ", " ", "-", ".", ""])
        p = pick_([f"+61 2 5550 {digits(4)}", f"(02) 5550 {digits(4)}", f"0{digits(1)} {digits(4)}{digits(4)}", f"04{digits(2)} {digits(3)} {digits(3)}", f"({digits(3)}) 555-{digits(4)}", f"+1{sep}{digits(3)}{sep}555{sep}{digits(4)}", f"{digits(3)}.555.{digits(4)}", f"555-{digits(4)}", f"0{digits(4)} {digits(3)} {digits(3)}", f"+44 {digits(4)} {digits(6)}", f"+34 9{digits(2)} {digits(6)}", f"9{digits(2)}-{digits(2)}-{digits(4)}", f"9{digits(2)} {digits(2)} {digits(2)} {digits(2)}",
                  f"+49 {digits(2)} {digits(8)}", f"00{digits(2)} {digits(2)}/{digits(5)} {digits(3)}", f"(0{digits(2)}) {digits(5)}-{digits(3)}", f"0{digits(2)} {digits(5)} {digits(3)}", f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(1)}.{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}", f"0{digits(1)}{digits(2)} {digits(6)}", f"+33 {digits(3)} {digits(6)}", f"{small()} {small()} {small()}, {small()} {small()} {small()} {small()}", wide(f"0{digits(1)} {digits(4)}") + f" {digits(4)}", f"1-800-555-{digits(4)}", f"+{digits(2)} {digits(2)} {digits(3)} {digits(4)}"])
        return p + (pick_([" ext. ", " ext ", " x"]) + digits(r.randint(1, 3)) if r.random() < 0.12 and p[0] in "+(012" else "")

    def number() -> str:
        return pick_([f"{upper(2)}{digits(7)}", f"{upper(1)}{digits(8)}", f"9{digits(2)} {digits(2)} {digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{upper(2)} {digits(2)} {digits(2)} {digits(2)} {pick_('ABCDZ')}", f"{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"{upper(1)}{digits(3)}{digits(5)}", f"{pick_('XYZ')}{digits(7)}{upper(1)}", f"{digits(8)}-{upper(1)}", f"{digits(8)}{upper(1)}",
                      f"{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(3)} {digits(3)} {digits(2)}", digits(13), digits(11)])

    def address(lang: str) -> str:
        town = cap() + pick_("ville stadt ford mouth dale haven burg".split())
        if lang == "en":
            unit = pick_(["", "", f"Unit {r.randint(1, 30)}/", f"Flat {r.randint(1, 40)}, "])
            a = f"{unit}{r.randint(1, 250)}{pick_(['', '', pick_('abc')])} {cap()} {pick_('Street St Road Rd Terrace Crescent Avenue Ave Blvd Lane'.split())}"
            a += pick_([f", {town} {upper(3)} {digits(4)}", f", {town} {digits(5)}", f", {town}", f"\n{town} {upper(3)} {digits(4)}", f",\n{town} {digits(5)}", ""])
            return a.upper() if r.random() < 0.15 and "\n" not in a else a
        zip_ = digits(5)
        if lang == "fr":
            return f"{r.randint(1, 220)}{pick_(['', '', ' bis', ' ter'])}{pick_([',', ''])} {pick_('rue impasse avenue bd boulevard place chemin allée'.split())} {pick_(['', 'de ', 'du '])}{cap()}, {zip_} {town}"
        if lang == "de":
            return f"{cap()}{pick_(['straße', 'str.', 'gasse', 'weg', 'platz'])} {r.randint(1, 220)}{pick_(['', 'a'])}{pick_([', ', ' in '])}{zip_} {town}"
        return f"{pick_(['Calle', 'C/', 'Avenida', 'Plaza', 'Paseo'])} {pick_(['de ', ''])}{cap()}{pick_([',', ''])} {r.randint(1, 200)}{pick_(['', ', 3º B'])}, {zip_} {town}"

    carriers = [  # N name, M mail, P phone, I number, A address (language), W work, F firm, L place, C code, T title, S German and French nouns
        "{N} can be reached under {P}.", "phone me at {P}, or write", "my number is {P}", "{I} (passport), number {P}", "TFN {I} and the office number {P}", "licence card {I}, the number to ring is {P}", "on {P} or under {M}", "for {c}, {c} kept one {v}", "{c}, {c} and {c} left", "ring {N} at {P}, please", "Questions? Ring {P} or mail {M}!", "The parcel goes to {T}{N}, {Aen}.", "Undersigned: {N}, living in {Aen}", "{T}{N} has lived at {Aen} since {y}.", "As {T}{N} told us ({P}), nothing is owed.", "Half of it is owned by {N} and a quarter by {N}.", "Passport no. {I}, issued to {N}", "His tax number is {I}, hers {I}.", "social security: {I}", "Her ID card {I} was shown at the desk.",
        "home {P}, work {P}, fax {P}", "Present: {N}, {N}, {N}", "Guests: {N}; {N}", "Sender: {N} <{M}>", "E-mail {M} | Phone {P}", "<a href=mailto:{M}>mail</a>", "Please ask {M} about it.", "TFN {I} ({T}{N})", "NI number {I}", "Hello {T}{N}, your form has arrived.", "Thank you, {N}", "Kind regards\n{N}\n{P}", "written by {N} in {y}", "{T}{N} and {T}{N} agreed.", "{N} joined {F} in {y}.", "{N} wrote {W} for {F}.", "interview with {N}, {d} pages", "name: {N}, birth year {y}", "Licence holder {N}, licence number {I}.",
        "Pièce d'identité {I} au nom de {N}", "Madame, Monsieur {N} habite {Afr}.", "Adresse : {Afr}", "Passeport {I}, titulaire {N}", "Sécurité sociale n° {I}", "Tél. {P} ou courriel {M}", "Lettre de {N} à {N}", "Votre contact : {N}, {P}",
        "Ausweis {I}, Inhaber {N}", "Die Steuernummer von {N} lautet {I}.", "Reisepass {I} wurde {N} ausgestellt.", "Herr {N} wohnt in der {Ade}.", "Adresse: {Ade}", "Rufen Sie {N} an: {P}", "E-Mail bitte an {M}", "Gezeichnet {N}", "Frau {N} bekommt die Hälfte.",
        "Pasaporte {I} a nombre de {N}", "El NIF de {N} es {I}.", "Vive en {Aes}.", "Dirección: {Aes}", "Teléfono {P}, correo {M}", "Firmado: {N}", "Señora {N} cobra la mitad.", "carta de {N} a {N}", "teléfono de {N}: {P}", "puede llamar al {P}", "joindre {N} au {P}", "unter {P} zu erreichen",
        "Bill {C} came to {d}.{d} euros.", "See ticket {C} and order {C}.", "Version {C} mends an error of {F}.", "The work code {C} is that of {W}.", "Recording {C}: {W}, stored in {L}", "tempo {d}, take {C}, reel {d}", "{F} merged with {F} in {L}.", "Find us as {c}@{c} or @{c} on the net.", "{W} opened in {L} on {d} May {y}.", "{W} was heard in {L}.", "{L} hosts {d} bands a year.", "From {L} to {L} it takes {d} hours.", "Between {y} and {y} {F} sold {d} copies of {W}.", "Facture {C} du {d} mai", "Rechnung {C} über {d} Euro", "Pedido {C} de {d} copias", "{S} bei {F} in {L}", "{K} von {W}", "{d} {K} von {W}", "{K} de {W}", "{K} de {W} à {L}", "L'{v} de {W}", "{d} {K} de {W}, davon {d} neu", "{W} and {W} have one {v}.", "{W}, then {W}", "quotes {W} and {W}", "{v} of {W}", "{W} is {v}", "{W} ist {d}", "a {v} of {c} {w} {d} {v}s and {c} {w} it", "{c} the {w} {v} {w} a {v} near {c}", "gehört zu {W}",  "{W} en {L}", "{S} und {S}", "{S}: {d}", "{W} et {S} à {L}", "{S} de {L}", "{W} de {F}",
        "The {g} {c} Band plays {W}.", "{g} {c} Ltd and {F} rent a hall.", "{g} and {g} is an opera.", "a song named {g} by {F}", "In {y} a painter called {c} left {c}.", "Rights in {W} go back to {F} in {d} months.", "less than {d} euros are kept", "{d} of {d} versions of {W} have no words", "{d}{d} copies of {W}", "({t}) host: {W} is next", "# {W}\n\n{W} by {F}", "## {S}\n{W}", "Visit {L} or {L} with {F}.", "contact: {w} office team", "signed by all members", "written by hand in {y}", "name: {w} {v}", "by {F} and {F}", "by {W}", "from {L} with {W}", "with {F}: {W}; {W}; {L}", "{W}; {W}; {F}", "for {W} and {F}", "Dear {v}, dear guests", "Chief Executive of {F}", "{F} v. {F}", "Contact {F} in {L}.", "Thanks to {F}, {W} returns.", "according to {F}", "Signed by {F}", "{c}, {L}", "{c} and {c} of {L}", "in {c}, {W}", "Code {C} stands for {W}, code {C} for {W}.", "catalogue {C} of {F}",
    ]
    title = lambda: pick_(["", "", "", "", "Dr ", "Mrs ", "Prof. ", "Mr ", "Ms "])
    makers = {"N": ("NAME", name), "M": ("EMAIL", mail), "P": ("PHONE", phone), "I": ("ID_NUMBER", number), "Aen": ("ADDRESS", lambda: address("en")), "Afr": ("ADDRESS", lambda: address("fr")), "Ade": ("ADDRESS", lambda: address("de")), "Aes": ("ADDRESS", lambda: address("es"))}
    plain = {"W": work, "F": firm, "L": place, "C": code, "T": title, "S": nouns, "K": part, "c": cap, "w": lambda: pick_(first), "v": lambda: pick_(thing), "d": lambda: str(r.randint(2, 999)), "g": lambda: pick_(GIVEN).capitalize(), "y": lambda: f"{pick_(['18', '19', '20'])}{digits(2)}", "t": lambda: f"{digits(2)}:{digits(2)}"}
    lines = []
    for k in range(n):
        template, gold = carriers[k % len(carriers)], []
        if k % 3 == 0:
            template += pick_([" ", "\n", " "]) + pick_(carriers)
        out = pick_(["", "", "", "- ", "* ", "3. ", "A: ", "> ", "<p>"])
        for piece in re.split(r"(\{\w+\})", template):
            key = piece[1:-1] if piece[:1] == "{" else None
            if key in makers:
                kind, make = makers[key]
                s = make()
                gold.append((len(out), len(out) + len(s), kind))
                out += s
            else:
                out += plain[key]() if key in plain else piece
        lines.append((out.upper() if r.random() < 0.1 and len(out.upper()) == len(out) else out, gold))
    return lines


@lru_cache(1)
def trained_weights() -> Weights:
    words = lexicon()
    return {k: {f: round(w, 3) for f, w in own.items() if abs(w) >= 0.01} for k, own in train(training_lines(words=words), words=words).items()}


def find(text: str | None, weights: Weights, words: Lexicon | None = None) -> list[tuple[int, int, str]]:
    return decode(Text(text, words or lexicon()), weights) if text else []


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, begin, end (characters), pii_type, found_text. Null, empty and blank texts have none."""
    docs = spread(pick(docs, id_col, text_col).filter(F.col(text_col).isNotNull()))
    model = docs.sparkSession.sparkContext.broadcast((trained_weights(), lexicon()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, x, y, kind, text[x:y]) for key, text in zip(b[id_col], b[text_col]) for x, y, kind in find(text, *model.value)]
            yield pd.DataFrame(rows, columns=[id_col, "begin", "end", "pii_type", "found_text"])

    return docs.mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, begin int, end int, pii_type string, found_text string")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text with typed placeholders such as [NAME] in place of personal information; null stays null."""
    docs = spread(pick(docs, id_col, text_col))
    model = docs.sparkSession.sparkContext.broadcast((trained_weights(), lexicon()))

    def one(text: str | None) -> str | None:
        for a, b, kind in reversed(find(text, *model.value)):
            text = f"{text[:a]}[{kind}]{text[b:]}"
        return text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], text_col: [one(t) for t in b[text_col]]})

    return docs.mapInPandas(run, docs.schema)


def over_bound(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """n_texts, n_over: texts, and spans that were proposed but are longer than SEGMENT and so no segment."""
    docs = spread(pick(docs, text_col).filter(F.col(text_col).isNotNull()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n_texts": [len(b)], "n_over": [sum(Text(t).over for t in b[text_col])]})

    return docs.mapInPandas(run, "n_texts long, n_over long").agg(F.coalesce(F.sum("n_texts"), F.lit(0)).alias("n_texts"), F.coalesce(F.sum("n_over"), F.lit(0)).alias("n_over"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pii_type, found_text."""
    return pii_spans(table(spark, sf_dir, "documents")).select("doc_id", "pii_type", "found_text").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text."""
    return redact(table(spark, sf_dir, "documents"))


def p8_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_texts, n_over."""
    return over_bound(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted, "p8_bound": p8_bound}
