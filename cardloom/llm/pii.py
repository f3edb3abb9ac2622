"""Personal data in free text: e-mail addresses, phone and identity numbers, street addresses and full names.

A semi-Markov conditional random field. Candidate segments (of at most MOST_CHARS characters, each of one kind) come from wide
patterns; features of whole segments and of what stands around them score them; everything between is outside, with score 0. The
best set of segments that do not overlap is found by dynamic programming over segment ends, so boundaries and kinds are chosen
together. Weights are fitted by gradient ascent on the conditional likelihood of the hand-labelled sentences in `pii_seeds`.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.pii_seeds import SEEDS
from cardloom.session import written

KINDS = ("email", "phone", "id_number", "address", "name")
#: No segment is longer: that of the longest e-mail address that mail allows.
MOST_CHARS = 320
#: Counts of words that a task holds before it passes them on to be added up.
HELD_COUNTS = 200_000

_FULL_WIDTH = {0xFF10 + k: 0x30 + k for k in range(10)}
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|point|punto|点)\s?[\])}]\s?|\s(?:dot|DOT|punkt|PUNKT|punto|PUNTO)\s)"
_AT = r"(?:\s?[\[({<]\s?(?:at|arroba|ät)\s?[\])}>]\s?|\s?[@＠]\s?|\s(?:AT|at|arroba)\s)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_EMAIL = re.compile(rf"(?<![\w.+@-])[a-z0-9À-ÿ](?:[a-z0-9À-ÿ._%+-]*[a-z0-9À-ÿ_])?({_AT}){_LABEL}(?:{_DOT}{_LABEL})*({_DOT})[a-z]{{2,}}(?![a-z0-9-])", re.I | re.A)
_MAIL_HINT = re.compile(r"[@＠]|[\[({<]\s?(?:at|arroba)\s?[\])}>]|\s(?:AT|at|arroba)\s[\w-]+(?:\.|\s(?:DOT|dot)\s)", re.I)
_DIGIT = "0-9０-９"
_NUMBER = re.compile(rf"(?<![A-Za-z{_DIGIT}@_.,/#:-])(?:\+ ?)?\(?[{_DIGIT}](?:[{_DIGIT}]|(?:  ?|[.\-/])\(?(?=[{_DIGIT}])|\)(?:  ?|[.\-/])?(?=[{_DIGIT}])| ?\(0\) ?(?=[{_DIGIT}]))*(?![A-Za-z_@{_DIGIT}])")
_LETTERED = re.compile(
    r"(?<![A-Za-z0-9@_.,/#-])(?:[A-Za-z]{2} {0,2}\d{2} {0,2}\d{2} {0,2}\d{2} {0,2}[A-Da-dZz]|[A-Za-z]{1,2}\d{6,9}|\d{2}[A-Za-z]{2}\d{5}|\d{8}[- ]?[A-Za-z]|[XYZxyz]-?\d{7}-?[A-Za-z]|\d{6} {0,2}\d{8} {0,2}\d{3}[Xx])(?![A-Za-z0-9_@])"
)
_PHONE_SHAPES = (
    ("us", re.compile(r"(?:\+?1[ .-]{0,2})?(?:\([2-9]\d\d\) {0,2}|[2-9]\d\d[ .-]{0,2})\d{3}[ .-]{0,2}\d{4}")),
    ("intl", re.compile(r"(?:\+ ?|00)(?:1|33|34|39|41|43|44|49|52|54|55|61|65|81|82|86|91)(?:[ .\-/()]*\d){8,12}")),
    ("uk", re.compile(r"0[127]\d{2,3}[ -]{0,2}\d{3}[ -]{0,2}\d{3,4}")),
    ("de", re.compile(r"\(?0[1-9]\d{1,4}\)?(?: ?/ ?|[ -]{1,2})\d{3,8}(?:[ -]{1,2}\d{1,5})?")),
    ("fr", re.compile(r"0[1-9](?:(?:  ?|[.-])?\d{2}){4}")),
    ("es", re.compile(r"[5-9]\d\d(?: {0,2}|[.-])(?:\d{3}(?: {0,2}|[.-])\d{3}|\d\d(?: {0,2}|[.-])\d\d(?: {0,2}|[.-])\d\d)")),
    ("cn", re.compile(r"1\d{2}[ -]{0,2}\d{4}[ -]{0,2}\d{4}")),
)
_ID_SHAPES = (
    ("ssn", re.compile(r"\d{3}(?:-\d{2}-| {1,2}\d{2} {1,2}|\d{2})\d{4}")),
    ("de11", re.compile(r"\d{11}|\d{2}(?: {1,2}\d{3}){3}")),
    ("nir", re.compile(r"\d{13}(?: ?\d{2})?|\d(?: {1,2}\d{2}){3} {1,2}\d{3} {1,2}\d{3}(?: {1,2}\d{2})?")),
    ("cn18", re.compile(r"\d{6} {0,2}\d{8} {0,2}\d{4}")),
)
_W = r"[^\W\d_][\w'’-]*"
_EN_TAIL = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Close|Row|Court|Ct|Place|Terrace|Way|Crescent|Square|Sq|Boulevard|Blvd|Hill|Mews|Gardens|Walk|Quay|Circle)"
_ADDRESSES = (
    ("en", re.compile(rf"(?<![\w.,-])\d{{1,5}}[A-Za-z]?,?[ ]{{1,2}}(?:(?:[NSEW]|NE|NW|SE|SW)\.?[ ]{{1,2}}|(?:North|South|East|West|Old|New|Upper|Lower)[ ]{{1,2}})*{_W}(?:[ ]{{1,2}}{_W})?[ ]{{1,2}}{_EN_TAIL}\b", re.I)),
    ("de", re.compile(r"(?<![\w-])(?:(?:alte[rs]?|neue[rs]?|am|an der|im|zum|zur|große|kleine|obere|untere|hintere)[ ]{1,2})?[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|ring|damm|stieg|chaussee)[ ]{1,2}\d{1,4}[a-z]?\b", re.I)),
    ("fr", re.compile(rf"(?<![\w.,-])\d{{1,4}}(?:[ ]?(?:bis|ter|quater))?,?[ ]{{1,2}}(?:rue|avenue|av\.|bd|boulevard|place|chemin|impasse|allée|quai|cours|route|square|passage)[ ]{{1,2}}(?:de[ ]la[ ]{{1,2}}|de[ ]{{1,2}}|des[ ]{{1,2}}|du[ ]{{1,2}}|d['’]|de[ ]l['’])?{_W}", re.I)),
    ("es", re.compile(rf"(?<![\w-])(?:calle|c/|avenida|avda\.?|av\.|plaza|pza\.|paseo|p\.º|camino|ronda|travesía|carretera)[ ]{{0,2}}(?:de[ ](?:la|las|los)[ ]{{1,2}}|de[ ]{{1,2}}|del[ ]{{1,2}})?{_W}(?:[ ]{{1,2}}{_W})?,?[ ]{{1,2}}(?:n\.?º[ ]?|núm\.[ ]?)?\d{{1,4}}[a-z]?\b", re.I)),
)
_HOUSE = re.compile(r"(?<![\w.,-])\d{1,5}|(?<=[\wº.,] )\d{1,4}|(?<=º)\d{1,4}")
_STREET_ENDS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ufer", "ring", "damm", "stieg", "chaussee")
_STREET_STARTS = re.compile(r"calle|c/|avenida|avda|av\.|plaza|pza|paseo|p\.º|camino|ronda|travesía|carretera")
_WORDS = re.compile(_W)
_ZH_ADDRESS = re.compile(r"(?:大道|路|街|巷|弄|胡同)[0-9０-９]{1,5}[A-Za-z]?号")
_HAN = "一-鿿㐀-䶿"
_HAN_CHAR = re.compile(rf"[{_HAN}]")
_CAP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐŁŃŇŐŘŚŠŤŮŰŹŻŽ]"
_TOKEN = re.compile(rf"(?<![\w'’-]){_CAP}[\w'’-]+")
_AFTER_GIVEN = re.compile(rf"((?:[ ]{{1,2}}[A-ZÀ-Þ]\.){{0,2}})([ ]{{1,2}}(?:(?:von|van|de|del|de la|la|du|le|zu|di)[ ])?)({_CAP}[\w'’-]*\w)")
_AFTER_GIVEN_LOW = re.compile(r"((?:[ ]{1,2}[a-zà-ÿ]\.){0,2})([ ]{1,2})([^\W\d_][\w'’-]*\w)")
_SURNAME_FIRST = re.compile(rf"(?<![\w'’-])({_CAP}[\w'’-]*\w),[ ]{{1,2}}({_CAP}[\w'’-]*\w)(?![\w'’-])")
#: Cue words before a segment, by what they announce.
_CUES = {
    "phone": r"text me|call|phone|mobile|tel\b|telef|reach me|ring|\bat\b|said|unter|erreich|anruf|ruf|per\b|sagt|joint|appel|rappel|dit\b|portable|llama|estoy|móvil|dice|\bal\b|电话|手机|号码|打|回电|说",
    "id": r"passport|ssn|social security|tax|insurance|form still|form shows|noted|identity|ausweis|pass\b|steuer|versicherung|notiert|nennt|passeport|sécu|dossier|impôt|donne|identité|dni|nif|pasaporte|seguridad|impreso|anot|hacienda|身份证|护照|税号|社保|记下|证件",
    "not": r"order|ticket|update|version|invoice|bestellung|fassung|rechnung|commande|facture|pedido|versión|incidencia|factura|订单|工单|版本|发票|room|raum|salle|aula|code",
    "person": r"\bdr\.|\bmr\.|\bmrs\.|\bms\.|signed by|landlord|best friend|call back|frau|herr|dr\b|unterschrieben|vertrag|bitte|freundin|vermieter|docteur|madame|monsieur|signé par|propriétaire|rappelez|doctora?|señora?|casera?|firmó|llamada a|amig[ao]|联系人|回电给|合同是|医生|房东|先生|女士|同是|名叫",
    "place": r"lives at|address is|deliver it to|goes to|wohnt|anschrift|geht an|adresse est|livrez au|habite|vit\b|dirección es|entrégalo|vive|地址是|送到|住在|搬去|寄到|寄往|goes|va (?:à|a)",
}
_CUE = {k: re.compile(v, re.I) for k, v in _CUES.items()}
_PERSON_BEFORE = re.compile(rf"(?:{_CUES['person']})[,:]? *$", re.I)
#: The last two characters of each cue of a person.
_PERSON_ENDS = {
    x[-2:]
    for cue in _CUES["person"].replace(r"\b", "").replace(r"\.", ".").split("|")
    for x in ([cue[:-1], cue[:-2]] if cue.endswith("a?") else [cue[:-4] + "a", cue[:-4] + "o"] if cue.endswith("[ao]") else [cue])
}
_CUES_OF = {"email": (), "phone": ("phone", "id", "not"), "id_number": ("phone", "id", "not"), "address": ("place",)}
#: Characters that end common words before a Chinese given name, and so are no surname there.
_ZH_NOT_SURNAME = set("居向姐弟妹哥和与跟同为后前天候早午晚间二上下时右左底里因表邻又很了的以还清再都口才给让请是事友师对从在被把人生到去找叫及或这那有她他我你们点半日月年周末夏春秋冬中")
_ZH_BEFORE_STREET = set("是到在于去往至给址：，。、了 ")


class Lexicon:
    """Given names and surnames; what the texts add to the given ones."""

    def __init__(self, given: set[str], surnames: set[str] = frozenset(), han: set[str] = frozenset()):
        self.given = {g for g in given if g and not re.match(rf"[{_HAN}]", g)}
        self.han = {g for g in given if g and re.match(rf"[{_HAN}]", g)} | set(han)
        self.low = {g.lower() for g in self.given}
        self.surnames = {s.lower() for s in surnames}
        self.zh = re.compile("|".join(sorted(map(re.escape, self.han), key=lambda x: (-len(x), x)))) if self.han else None


#: What stands before a given name alone, and the last word of each.
_KIN = tuple(
    f"{first} {noun} "
    for firsts, nouns in (
        ("My my", ("sister", "brother", "cousin", "study partner", "best friend", "neighbour", "friend")), ("Our our", ("neighbour",)), ("new", ("colleague",)),
        ("Meine meine", ("Schwester", "Cousine", "Freundin")), ("Mein mein", ("Bruder", "Cousin", "Freund")), ("Unser unser", ("Nachbar",)), ("neue", ("Kollegin",)),
        ("Ma ma", ("sœur", "cousine")), ("Mon mon", ("frère", "cousin", "ami")), ("Notre notre", ("voisin",)), ("nouvelle", ("collègue",)),
        ("Mi mi", ("hermana", "hermano", "primo", "prima", "amigo", "amiga")), ("Nuestro Nuestra nuestro nuestra", ("vecino", "vecina")), ("nueva", ("compañera",)),
    )
    for first in firsts.split()
    for noun in nouns
)
_KIN_LAST = {k.split()[-1] for k in _KIN}
_KIN_NAME = re.compile(rf"{_CAP}[^\W\d_]+")
_LOW_WORD = re.compile(r"(?<![\w'’.+-])[a-zà-ÿ][\w'’-]+(?![\w'’@＠+._(\[-])")
_ZH_KIN = re.compile(rf"(?:邻居|同事|表弟|表妹|姐姐|妹妹|哥哥|弟弟)([{_HAN}]{{2}})")


class _Counts:
    """What names are learned from: words in given names' places, words by the capitalised one before them, capitalised and common words."""

    def __init__(self):
        self.kin, self.han, self.after, self.alone, self.common = (Counter() for _ in range(5))

    def add(self, text: str) -> None:
        if not text.isascii():
            self.han.update(_ZH_KIN.findall(text))
        self.common.update(_LOW_WORD.findall(text))
        for m in _TOKEN.finditer(text):
            word, s = m.group(), m.start()
            self.alone[word.lower()] += 1
            if s and text[text.rfind(" ", 0, s - 1) + 1 : s - 1] in _KIN_LAST and text.endswith(_KIN, 0, s) and (n := _KIN_NAME.match(text, s)):
                self.kin[n.group()] += 1
            if n := _AFTER_GIVEN.match(text, m.end()):
                self.after[word, n.group(3).lower()] += 1

    def held(self) -> int:
        return sum(map(len, vars(self).values()))

    def rows(self) -> Iterator[tuple[str, str, str, str, int]]:
        """(part, first, capitalised first, word, n); first is empty in all parts but `after`."""
        for part, counts in vars(self).items():
            for key, n in counts.items():
                first, word = key if part == "after" else ("", key)
                yield part, first, first.capitalize(), word, n


def _least(known: list[int], least: int, otherwise: float, share: int) -> float:
    """How often a new name must stand where given names stand; known: the counts of the given ones there."""
    middle = sorted(known)[-(len(known) // 2 + 1) :][:1]
    return max(least, (middle or [otherwise])[0] / share)


_LATIN_RULE, _HAN_RULE = (2, 20, 10), (3, 1e9, 3)
_plain = lambda k: k[0] + k[1:].lower() == k


def learn(texts: list[str], given: set[str]) -> Lexicon:
    """Names that stand where known given names stand, as often as a tenth (Chinese: a third) of these do; surnames after given names."""
    c = _Counts()
    for t in texts:
        c.add(t)
    enough = lambda part, rule: {k for k, v in part.items() if v >= _least([n for g, n in part.items() if g in given], *rule)}
    base = Lexicon(given | set(filter(_plain, enough(c.kin, _LATIN_RULE))), han=enough(c.han, _HAN_RULE))
    after = Counter()
    for (first, word), n in c.after.items():
        if first in base.given or first.capitalize() in base.given:
            after[word] += n
    surnames = {w for w, n in after.items() if n >= 2 and n >= 0.5 * c.alone[w] and n > c.common[w] and w not in base.low}
    return Lexicon(base.given | base.han, surnames)


def _addresses(text: str) -> Iterator[tuple[str, re.Match]]:
    """Matches of the address patterns, looked for around house numbers only."""
    (en, first), (de, second), (fr, third), (es, fourth) = _ADDRESSES
    for m in _HOUSE.finditer(text):
        at = m.start()
        for name, shape in ((en, first), (fr, third)):
            if hit := shape.match(text, at):
                yield name, hit
        before = text[max(0, at - 60) : at].lower()
        if before.rstrip().endswith(_STREET_ENDS):
            yield from ((de, hit) for hit in second.finditer(text, max(0, at - 60), min(len(text), m.end() + 2)) if hit.start() < at < hit.end())
        elif _STREET_STARTS.search(before):
            yield from ((es, hit) for hit in fourth.finditer(text, max(0, at - 60), min(len(text), m.end() + 2)) if hit.start() < at < hit.end())


def _person_before(before: str) -> bool:
    """Whether a cue of a person ends `before`. Its last letters rule that out at once for most words; others than ASCII are left to the pattern."""
    end = before.rstrip(" \n,:")[-2:]
    if len(end) == 2 and end.isascii() and end.lower() not in _PERSON_ENDS:
        return False
    return _PERSON_BEFORE.search(before) is not None


def _candidates(text: str, lex: Lexicon) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, kind, features) of every candidate segment."""
    found: list[tuple[int, int, str, list[str]]] = []
    if _MAIL_HINT.search(text):
        for m in _EMAIL.finditer(text):
            at = m.group(1).strip()
            found.append((m.start(), m.end(), "email", ["at_sign" if at in "@＠" else "at_word" if at.isalpha() else "at_bracket", "dot_sign" if m.group(2) == "." else "dot_word", "at_low" if at == "at" else ""]))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 8:
            continue
        raw = m.group().translate(_FULL_WIDTH)
        digits = sum(c.isdigit() for c in raw)
        if digits < 8 or digits > 18:
            continue
        for name, shape in _PHONE_SHAPES:
            if shape.fullmatch(raw):
                found.append((m.start(), m.end(), "phone", [name, f"first{raw[0]}" if digits == 9 else "", "plus" if raw[0] == "+" else "", "plain" if raw.isdigit() else "grouped", f"n{digits}"]))
                break
        for name, shape in _ID_SHAPES:
            if shape.fullmatch(raw):
                found.append((m.start(), m.end(), "id_number", [name, f"first{raw[0]}" if digits == 9 else "", "zero" if raw[0] == "0" else "", "one" if raw[0] == "1" and digits == 11 else "", "hyphens" if re.fullmatch(r"\d{3}-\d{2}-\d{4}", raw) else ""]))
                break
    for m in _LETTERED.finditer(text):
        raw = m.group()
        letters = "".join(c for c in raw if c.isalpha())
        found.append((m.start(), m.end(), "id_number", ["lettered", "upper" if letters.isupper() else "lower"]))
    for name, m in _addresses(text):
        end = m.end()
        if name == "en" and text[end : end + 1] == "." and m.group().lower().endswith((" st", " rd", " ln", " dr", " sq", " ct", " blvd", " ave")):
            rest = text[end + 1 : end + 4]
            if rest[:1] in (".", ",") or re.match(r"\s+[a-zà-ÿ]", rest) or (m.group().lower().endswith(" st") and not rest.strip()):
                end += 1
        proper = [w for w in _WORDS.findall(text, m.start(), end) if w[:1].isupper()]
        found.append((m.start(), end, "address", [name, "proper" if len(proper) >= (2 if name == "en" else 1) else "common"]))
    han = not text.isascii() and _HAN_CHAR.search(text) is not None
    if han:
        for m in _ZH_ADDRESS.finditer(text):
            for n in (2, 3, 4, 5):
                s = m.start() - n
                if s < 0 or not re.fullmatch(rf"[{_HAN}]+", text[s : m.start()]):
                    break
                edge = text[s - 1] if s else "。"
                found.append((s, m.end(), "address", ["zh", f"zh{n}", "edge" if edge in _ZH_BEFORE_STREET else "no_edge", "inside" if set(text[s : m.start()]) & _ZH_BEFORE_STREET else ""]))
        if lex.zh:
            for m in lex.zh.finditer(text):
                s = m.start() - 1
                if s >= 0 and re.match(rf"[{_HAN}]", text[s]):
                    found.append((s, m.end(), "name", ["zh", "grammar" if text[s] in _ZH_NOT_SURNAME else "surname"]))
        for m in re.finditer(rf"(?:联系人|回电给|合同是)([{_HAN}]{{3}})(?=现在|，号码|签的|，|。|\s)", text):
            found.append((m.start(1), m.end(1), "name", ["zh", "slot"]))
    caseless = text == text.lower()
    for m in re.finditer(rf"(?<![\w'’-]){_W}", text) if caseless else _TOKEN.finditer(text):
        word = m.group()
        known = word in lex.given or (caseless or word.isupper()) and word.lower() in lex.low
        if not known:
            before = text[max(0, m.start() - 16) : m.start()]
            if caseless or not _person_before(before):
                continue
        n = (_AFTER_GIVEN_LOW if caseless else _AFTER_GIVEN).match(text, m.end())
        if not n:
            continue
        last = n.group(3)
        end = n.end()
        if last.lower().endswith(("'s", "’s")):
            last, end = last[:-2], end - 2
        sure = last.lower() in lex.surnames
        feats = ["latin", "given" if known else "not_given", "sure" if sure else "unsure", "initial" if n.group(1) else "", "caseless" if caseless else "", "upper" if last.isupper() and len(last) > 2 else "", "mixed" if word.isupper() != last.isupper() else ""]
        found.append((m.start(), end, "name", feats))
    if not caseless and "," in text:
        for m in _SURNAME_FIRST.finditer(text):
            if (m.group(2) in lex.given or m.group(2).capitalize() in lex.given) and (m.group(1).isupper() or m.group(1).lower() in lex.surnames):
                found.append((m.start(), m.end(), "name", ["turned", "sure" if m.group(1).lower() in lex.surnames else "unsure"]))
    out = []
    for s, e, kind, feats in found:
        if e - s > MOST_CHARS:
            continue
        before = text[max(0, s - 30) : s]
        before = before[max(before.rfind("\n"), before.rfind("。")) + 1 :]
        if kind == "name":
            cues = ["cue_person"] if "grammar" not in feats and _person_before(before) else []
        else:
            cues = [f"cue_{k}" for k in _CUES_OF[kind] if _CUE[k].search(before)]
        after = text[e : e + 14]
        if kind == "name" and re.match(r"\s*(?:[,，]?\s*(?:Books|Parcel|Hall|Street|Road|station|market|Paket|Colis|Envíos|concert)|书屋|市场|咖啡馆|快递)", after):
            cues.append("firm_after")
        out.append((s, e, kind, tuple([kind, *(f"{kind}:{x}" for x in (*feats, *cues) if x)])))
    return sorted(set(out))


def _unlabel(marked: str) -> tuple[str, set[tuple[int, int, str]]]:
    text, spans, at = "", set(), 0
    for m in re.finditer(r"\{(email|phone|id_number|address|name):([^}]*)\}", marked):
        text += marked[at : m.start()]
        spans.add((len(text), len(text) + len(m.group(2)), m.group(1)))
        text += m.group(2)
        at = m.end()
    return text + marked[at:], spans


def _marginals(cands: list, score: list[float]) -> list[float]:
    """Probability of each candidate in the distribution over sets of candidates that do not overlap."""
    points = sorted({x for s, e, *_ in cands for x in (s, e)})
    place = {p: k for k, p in enumerate(points)}
    ends, starts = defaultdict(list), defaultdict(list)
    for k, (s, e, *_) in enumerate(cands):
        ends[place[e]].append(k)
        starts[place[s]].append(k)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    forward = [0.0] * len(points)
    for i in range(1, len(points)):
        forward[i] = forward[i - 1]
        for k in ends[i]:
            forward[i] = add(forward[i], forward[place[cands[k][0]]] + score[k])
    back = [0.0] * len(points)
    for i in range(len(points) - 2, -1, -1):
        back[i] = back[i + 1]
        for k in starts[i]:
            back[i] = add(back[i], back[place[cands[k][1]]] + score[k])
    total = forward[-1]
    return [math.exp(forward[place[s]] + score[k] + back[place[e]] - total) for k, (s, e, *_) in enumerate(cands)]


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Feature weights, fitted once per process on the seed sentences: 400 steps of gradient ascent with a quadratic penalty."""
    given = {"Anna", "Marta", "Paul", "Lena", "Oskar", "Julie", "Karim", "Sofía", "Pedro", "Ingrid", "Tom", "小雨", "志远", "思源"}
    lex = Lexicon(given, {"Fielding", "Harrow-Smith", "Okafor", "Brandauer", "Lefèvre", "Marchand", "Ibarra", "Solano"})
    data = []
    for marked in SEEDS:
        text, gold = _unlabel(marked)
        cands = _candidates(text, lex)
        if cands:
            data.append((cands, [float((s, e, k) in gold) for s, e, k, _ in cands]))
    w: dict[str, float] = defaultdict(float)
    for step in range(400):
        rate = 0.5 if step < 200 else 0.2
        slope: dict[str, float] = defaultdict(float)
        for cands, gold in data:
            score = [sum(w[f] for f in c[3]) for c in cands]
            for c, g, p in zip(cands, gold, _marginals(cands, score)):
                if abs(g - p) > 1e-4:
                    for f in c[3]:
                        slope[f] += g - p
        for f, v in slope.items():
            w[f] += rate * (v / 8 - 0.02 * w[f])
    return dict(w)


def find(text: str | None, lex: Lexicon, w: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the best segmentation, in order; none for null or empty text."""
    if not text:
        return []
    cands = _candidates(text, lex)
    if not cands:
        return []
    scored = [(e, s, k, v) for s, e, k, feats in cands if (v := sum(w.get(f, 0.0) for f in feats)) > 0]
    scored.sort()
    ends = [x[0] for x in scored]
    best, back = [0.0], []
    for e, s, _, v in scored:
        before = bisect.bisect_right(ends, s, 0, len(back))
        take = best[before] + v > best[-1]
        back.append((take, before))
        best.append(best[before] + v if take else best[-1])
    out, i = [], len(scored)
    while i:
        take, before = back[i - 1]
        if take:
            e, s, k, _ = scored[i - 1]
            out.append((s, e, k))
            i = before
        else:
            i -= 1
    return out[::-1]


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME]."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def _counted(texts: DataFrame) -> DataFrame:
    """(part, first, cap, word, n) over all texts (a column `text`): what _Counts has, added up."""
    names = ["part", "first", "cap", "word", "n"]

    def batch_of(c: _Counts) -> pa.RecordBatch:
        cols = list(zip(*c.rows())) or [()] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in cols[:4]), pa.array(cols[4], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Counts()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                c.add(t)
                if c.held() >= HELD_COUNTS:
                    yield batch_of(c)
                    c = _Counts()
        yield batch_of(c)

    parts = texts.select("text").mapInArrow(run, "part string, first string, cap string, word string, n bigint")
    return parts.groupBy("part", "first", "cap", "word").agg(F.sum("n").alias("n"))


def lexicon(texts: DataFrame, given_names: DataFrame) -> Lexicon:
    """The lexicon for a corpus (a column `text`): what learn() makes of all its distinct texts. Only words over the thresholds are collected."""
    named = given_names.select(F.col("given").alias("word")).filter("word <> ''").distinct()
    given = {r.word for r in named.collect()}
    counts = written(_counted(texts.filter("text is not null").select("text").distinct()), "name_counts")
    part = lambda name: counts.filter(F.col("part") == name)

    def enough(name: str, rule: tuple) -> set[str]:
        known = [r.n for r in part(name).join(named, "word", "left_semi").select("n").collect()]
        return {r.word for r in part(name).filter(F.col("n") >= _least(known, *rule)).select("word").collect()}

    base = Lexicon(given | set(filter(_plain, enough("kin", _LATIN_RULE))), han=enough("han", _HAN_RULE))
    firsts = texts.sparkSession.createDataFrame([(g,) for g in sorted(base.given)], "given string")
    after = part("after").withColumn("given", F.explode(F.array_distinct(F.array("first", "cap")))).join(firsts, "given", "left_semi")
    after = after.groupBy("first", "word").agg(F.max("n").alias("n")).groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2")
    for name in ("alone", "common"):
        after = after.join(part(name).select("word", F.col("n").alias(name)), "word", "left")
    sure = after.filter("n >= 0.5 * coalesce(alone, 0) and n > coalesce(common, 0)").select("word").collect()
    return Lexicon(base.given | base.han, {r.word for r in sure} - base.low)


def scan(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """texts: tab, rec_id, text. One row per input row: tab, rec_id, redacted, and spans (kind, span, start; start counts characters)."""
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("span", pa.string()), ("start", pa.int32())]))
        for batch in batches:
            spans, clean = [], []
            for t in batch.column(2).to_pylist():
                found = find(t, lex, w)
                spans.append([{"kind": k, "span": t[s:e], "start": s} for s, e, k in found])
                clean.append(redact(t, found) if found else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(clean, pa.string()), pa.array(spans, kind)], names=["tab", "rec_id", "redacted", "spans"])

    return texts.select("tab", "rec_id", "text").mapInArrow(run, "tab string, rec_id string, redacted string, spans array<struct<kind:string,span:string,start:int>>")


def personal_data(texts: DataFrame, given_names: DataFrame) -> DataFrame:
    """(tab, rec_id, kind, span), distinct. Null, empty and blank texts have none."""
    found = scan(texts, lexicon(texts, given_names))
    return found.select("tab", "rec_id", F.inline("spans")).select("tab", "rec_id", "kind", "span").distinct()
