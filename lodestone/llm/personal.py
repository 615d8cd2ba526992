"""Personal information in free text: labelers vote on candidate spans, EM weighs them, a span classifier decides."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import require_columns
from lodestone.session import durable

#: What a word of the gazetteer may be; a word may be several.
GIVEN, FAMILY, EVERYDAY = 1, 2, 4
#: Words of the gazetteer that are sent to every worker; the rest of a larger one is joined.
MOST_SHARED = 100_000

KINDS = ("email", "phone", "identity", "address", "name")

# --- fixed values: words around and inside personal data, in several languages ---
PHONE_WORDS = "tel telephone phone call text voicemail number mobile cell fax reach whatsapp ring dial telefon rufen anrufen mich unter handy nummer llámame llamame llamar teléfono telefono numéro numero appelez appeler téléphone chiamami chiamare cellulare ligue ligar telefone telemóvel bel bellen telefoonnummer позвоните звоните телефон номер फ़ोन नंबर كلمني رقمي هاتف 電話 电话 โทร"
IDENTITY_WORDS = "id identity passport license licence social security ssn insurance case holder tax national dni nie nif ausweisnummer ausweis personalausweis steuernummer sozialversicherungsnummer pièce identité sécu identidad pasaporte documento carta codice fiscale identità bsn burgerservicenummer paspoort rijbewijs passport паспорт инн снилс आधार पासपोर्ट हوية هوية جواز 身份证 护照 パスポート マイナンバー บัตรประชาชน"
THING_WORDS = "order orders ticket invoice barcode build version booking reservation confirmation serial isbn sku code coupon tracking item items dish table room seat gate row app receipt bestellung rechnung pedido factura reserva commande facture ordine fattura bestelling factuur заказ"
LIVE_WORDS = "live lives flat house home moved delivered deliver refund courier address send mail wohne wohnt wohnen vivo vive vivimos habite habitons adresse abito abita moro mora woon woont adres живу живём адрес residence apartment"
OPEN_WORDS = "opens open opening abre abren abrem ouvert ouvre aprono apre geöffnet öffnet öffnen open geopend открыт открыто"
STREETS = "st street rd road ave avenue ln lane blvd boulevard dr drive ct court pl place ter terrace way pkwy parkway sq square hwy highway cir circle row close crescent"
TITLES = "mr mrs ms miss mx dr prof sir madam frau herr hr fr mme mlle madame monsieur m sr sra srta señor señora don doña sig sigra signor signora sr.ª dhr mevr mw meneer mevrouw г-н г-жа श्री श्रीमती डॉ"
ROLE_WORDS = "chef waiter waitress server manager owner hostess host bartender cashier clerk koch wirt kellner baas ober chief boss lady man girl boy guy team crew staff kitchen monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december lunes martes lundi mardi montag dienstag you everyone nobody all god the a an and or mt mount st saint no we they i he she it her him me my our your"
BUSINESS_WORDS = "cafe café grill bakery diner bar restaurant hotel dental clinic salon repair shop store market pizza pizzeria kitchen house garden oven fork lantern anchor parlor inn pub bistro company inc ltd gmbh sponge salad soup sandwich stew pie tart eggs street road avenue lane st rd ave square bridge park river"
#: A name comes right after one of these.
BEFORE_NAME = ["thank you", "thank you,", "thanks to", "thanks", "shout out to", "shoutout to", "ask for", "our server", "our waiter", "our waitress", "our hostess", "our host", "my neighbor", "my neighbour", "my friend", "my wife", "my husband", "complaint went to", "named", "called", "spoke to", "spoke with", "talk to", "served by", "merci à", "grâce à", "nos atendió", "gracias a", "bedient hat uns", "dank an", "danke", "danke an", "grazie a", "ci ha servito", "servito da", "obrigado a", "obrigada a", "atendeu-nos", "fomos atendidos por", "bedankt", "dank aan", "met dank aan", "спасибо", "нас обслуживал", "нас обслуживала", "भुगतान", "धन्यवाद", "شكرا", "感谢", "谢谢"]
#: A name comes right before one of these.
AFTER_NAME = ["refilled", "recommended", "took the time", "was a gem", "was great", "was so", "was very", "who", "about the invoice", "about the", "at the counter", "and stayed", "for the candle", "for", "helped", "resolvió", "con mucha", "nous a", "pour son aide", "war sehr", "mit viel", "ci ha", "è stata", "è stato", "foi muito", "resolveu", "was heel", "heeft", "помог", "помогла", "ने"]
DIRECTIONS = r"(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.? )?"
# --- end of fixed values ---


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


_PHONE, _ID, _THING, _LIVE, _OPEN, _TITLE, _ROLE, _BUSINESS = map(_set, (PHONE_WORDS, IDENTITY_WORDS, THING_WORDS, LIVE_WORDS, OPEN_WORDS, TITLES, ROLE_WORDS, BUSINESS_WORDS))
_AT = r"(?: ?[@＠] ?| ?[(\[{<](?:at|AT|arroba|bei|chez)[)\]}>] ?)"
_DOT = r"(?:\.| ?[(\[{](?:dot|DOT|punto|punkt|point|ponto)[)\]}] ?| (?:dot|DOT|punto|punkt|point|ponto) )"
_SPOKEN = r" (?:dot|DOT|punto|punkt|point|ponto) "
_EMAIL = re.compile(rf"(?<![\w.+-])\w[\w.+-]*(?:{_AT}[\w-]+(?:{_DOT}[\w-]+)+| (?:at|AT|arroba) [\w-]+(?:{_SPOKEN}[\w-]+)+)(?![\w@])")
_DIGITS = re.compile(r"(?<![\w#@/])(?<!\d[.,:-])(?:\+ ?|00)?(?:\(\d{1,5}\)[ -]?)?\d[\d .-]{4,18}\d(?:-?[A-Z]\b)?(?: ?(?:ext|x|extension|Durchwahl|DW|poste|int)\.? ?\d{1,5})?(?![\w])|(?<![\w#@/-])[A-Z]{1,2} ?\d[\d -]{5,14}\d(?: ?[A-Z])?(?!\w)")
_STREET_ALT = "|".join(sorted({w.capitalize() for w in STREETS.split()}, key=len, reverse=True))
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_OF = r"(?:(?:de|del|della|dei|di|la|las|los|le|do|da|dos|das|du|des) |d'|de l'){0,2}"
#: Address forms: what a lower-case text must hold for the form to be looked for, the form, and whether it speaks for itself.
_ADDRESSES = [
    (re.compile(r"\d [a-z]"), re.compile(rf"(?<![\w.,$€-])\d{{1,5}}[a-zA-Z]? {DIRECTIONS}(?:{_CAP} ){{1,3}}(?:(?:{_STREET_ALT})\b|(?:{_STREET_ALT.upper()})\b)(?:(?<=\b(?:St|Rd|Dr|Ln|Ct|Pl|Sq))\.|(?<=\b(?:Ave|Ter|Hwy|Cir))\.|(?<=\bBlvd)\.)?"), True),
    (re.compile(r"(?:weg|stra(?:ß|ss)e|str\.|gasse|allee|straat|laan|plein|gracht|kade|steeg) \d"), re.compile(rf"(?:{_CAP} )?{_CAP}(?:weg|straße|strasse|str\.|gasse|allee|straat|laan|plein|gracht|kade|steeg) \d{{1,4}}(?: ?[a-z]\b)?"), True),
    (re.compile(r"\b(?:calle|c/) "), re.compile(rf"\b(?:[Cc]alle|C/) {_OF}{_CAP}(?: {_CAP})?,? (?:n\.?[ºo°]? ?)?\d{{1,4}}[a-zA-Z]?\b"), True),
    (re.compile(r"\b(?:rua|via|avenida|avda\.|av\.|plaza|paseo|viale|corso|piazza|p\.zza|travessa|largo) "), re.compile(rf"\b(?:[Rr]ua|[Vv]ia|[Aa]venida|[Aa]vda\.|[Aa]v\.|[Pp]laza|[Pp]aseo|[Vv]iale|[Cc]orso|[Pp]iazza|P\.zza|[Tt]ravessa|[Ll]argo) {_OF}{_CAP}(?: {_CAP})?,? (?:n\.?[ºo°]? ?)?\d{{1,4}}[a-zA-Z]?\b"), False),
    (re.compile(r"\d(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|bd|place|chemin|impasse|allée|quai|cours) "), re.compile(rf"(?<![\w.,-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|bd\.?|place|chemin|impasse|allée|quai|cours) {_OF}{_CAP}(?: {_CAP})?"), True),
    (re.compile(r"(?:ул|пр|пер|улиц|просп)"), re.compile(r"\b(?:ул\.|улица|улице|пр\.|проспект|пер\.|переулок) [А-ЯЁ][а-яё-]+,? (?:д\. ?|дом )?\d{1,4}[а-я]?"), True),
]
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_CONTEXT = re.compile(r"[^\W\d_]+")
_TITLE_NAME = re.compile(rf"\b(?:Mr|Mrs|Ms|Mme|Mlle|Dr|Prof|Frau|Herr|Hr|Sr|Sra|Srta|Sig|Sig\.ra|Dhr|Mevr|Mw)\.? ({_CAP}(?: (?:{_CAP}|[A-Z]\.))?)")
_CUES = tuple(c.rstrip(",") + x for c in dict.fromkeys(BEFORE_NAME) for x in (" ", ", "))
_CUED = re.compile(rf"(?:(?:Mr|Mrs|Ms|Dr|Mme|Mlle|Frau|Herr|Sra?|Dhr|Mevr)\.? )?((?:[A-Z]\. ?)*{_CAP}(?:,? (?:[A-Z]\. ?)?{_CAP})?)")
_NAME_BEFORE = re.compile("(?:" + "|".join(sorted(map(re.escape, BEFORE_NAME), key=len, reverse=True)) + r")[,:]? ?\Z", re.I)
_NAME_AFTER = re.compile(r",? (?:" + "|".join(sorted(map(re.escape, AFTER_NAME), key=len, reverse=True)) + r")\b", re.I)
_HANDLE = re.compile(r"@\w+|https?://\S+|www\.\S+|<[^<>]*>")


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    shape: int


def _around(text: str, s: int, e: int) -> tuple[set[str], set[str], str]:
    """Words of the same sentence near a span, before and after, and the word right before."""
    left = text[max(0, s - 60) : s]
    cut = max(left.rfind(". "), left.rfind("! "), left.rfind("? "), left.rfind("\n"), left.rfind(">"))
    head = left[cut + 1 :]
    if head.strip().lower() in ("tel.", "") and cut >= 0 and left[:cut].lower().endswith(("tel", "no", "nr")):
        head = left[max(0, cut - 12) :]
    before = [w.lower() for w in _CONTEXT.findall(head)][-8:]
    tail = re.split(r"[.!?]\s|\n|<", text[e : e + 50], maxsplit=1)[0]
    return set(before), {w.lower() for w in _CONTEXT.findall(tail)[:6]}, before[-1] if before else ""


def _vote(*tests: bool | None) -> tuple[int, ...]:
    return tuple(0 if t is None else 1 if t else -1 for t in tests)


def _number_candidates(text: str) -> Iterator[Candidate]:
    for m in _DIGITS.finditer(text):
        s, e = m.span()
        found = m[0]
        d = sum(c.isdigit() for c in found)
        if not 7 <= d <= 20:
            continue
        before, after, last = _around(text, s, e)
        core = re.split(r" ?(?:ext|x|Durch|DW|poste|int)", found)[0]
        letters = any(c.isalpha() for c in core)
        digits = re.sub(r"\D", "", core)
        groups = [len(x) for x in re.findall(r"\d+", core)]
        date = bool(re.fullmatch(r"(?:\d{4}-\d\d-\d\d|\d\d[./-]\d\d[./-]\d{4})", core))
        thing = bool(before & _THING) and not before & _PHONE - {"number"} and not before & _ID
        closed = text[s - 1 : s] == "(" and text[e : e + 1] == ")" and found.count("(") == found.count(")")
        prefix = core.startswith(("+", "00"))
        shapes = groups in ([3, 3, 4], [3, 4], [5, 6], [10], [11], [1, 3, 3, 4], [2, 2, 2, 2, 2], [3, 2, 2, 2], [3, 5, 3], [2, 4, 3, 3], [2, 3, 3, 3], [2, 1, 2, 2, 2, 2], [2, 2, 8]) or prefix and d >= 9
        if not letters and 7 <= len(digits) <= 15 and not date:
            yield Candidate("phone", s, e, _vote(True if prefix or "ext" in found else None, True if before & _PHONE and not before & _ID else None, True if shapes else False, False if thing else None, False if before & _ID or after & (_ID - {"id"}) and groups == [3, 2, 4] else None, False if groups == [3, 2, 4] else None), int(closed))
        ssn = groups == [3, 2, 4]
        known = bool(re.fullmatch(r"\d{3}[- ]\d\d[- ]\d{4}|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]\d{8}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|\d{8}-?[A-Z]|[A-Z]{2}\d{7}|\d{4} \d{4} \d{4}|[A-Z]{2}\d{2}[A-Z0-9 ]+", core))
        if not date:
            yield Candidate("identity", s, e, _vote(True if known else None, True if (before | after) & _ID else None, True if ssn or letters and known else None, False if thing else None, False if prefix or "ext" in found or (shapes and not letters) else None, False if before & _PHONE and not (before | after) & _ID else None), int(letters))


_CUED_LOW = re.compile(r"(?:(?:mr|mrs|ms|dr|mme|mlle|frau|herr|sra?|dhr|mevr)\.? )?((?:[a-z]\. ?)*([^\W\d_]+)\b)", re.I)


def _cued(text: str, low: str, form: re.Pattern[str] = _CUED) -> Iterator[re.Match[str]]:
    if len(low) != len(text):
        return
    for c in _CUES:
        at = low.find(c)
        while at >= 0:
            if not at or not low[at - 1].isalnum():
                if m := form.match(text, at + len(c)):
                    yield m
            at = low.find(c, at + 1)


def _name_candidates(text: str, low_text: str, given: frozenset[str], family: frozenset[str], common: frozenset[str], taken: list[tuple[int, int]]) -> Iterator[Candidate]:
    words = [] if given.isdisjoint(_CONTEXT.findall(low_text)) else [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    spans: dict[tuple[int, int], list[bool]] = {}
    i = 0
    is_given = [w.lower() in given or "-" in w and any(p in given for p in w.lower().split("-")) for _, _, w in words]
    while i < len(words):
        if not is_given[i]:
            i += 1
            continue
        s, e, w = words[i]
        j = i + 1
        known_family = False
        k = j
        end = e
        # initials, then a family name written like the given one
        while k < len(words) and len(words[k][2]) == 1 and text[end : words[k][0]] == " " and text[words[k][1] : words[k][1] + 1] == "." and (words[k][2].isupper() or w.islower()):
            end = words[k][1] + 1
            k += 1
        if k < len(words) and text[end : words[k][0]] == " ":
            f = words[k][2]
            low = f.lower()
            parts = low.split("-")
            like = f[:1].isupper() if w[:1].isupper() else True
            strange = low not in common and low not in _ROLE and low not in _BUSINESS
            if like and len(low) > 2 and (low in family or any(p in family for p in parts) or strange):
                known_family = True
                end = words[k][1]
                k += 1
        j = k if end != e else j
        if not known_family and i and not is_given[i - 1] and text[words[i - 1][1] : s] in (", ", " "):
            f = words[i - 1][2].lower()
            if f in family or any(p in family for p in f.split("-")) or f not in common and f not in _ROLE and f not in _BUSINESS and f not in _TITLE and len(f) > 2 and words[i - 1][2][:1].isupper() == w[:1].isupper() and text[words[i - 1][1] : s] == ", ":
                s = words[i - 1][0]
                known_family = True
        spans[s, end] = [True, known_family]
        i = max(j, i + 1)
    for m in (*_TITLE_NAME.finditer(text), *_cued(text, low_text)):
        s, e = m.span(1)
        if not text[s].isupper() or any(a < e and s < b for a, b in spans):
            continue
        first = _CONTEXT.findall(m[1])
        whole = [x for x in first if len(x) > 1]
        if text.isupper() or not whole or whole[0].lower() in _TITLE or whole[0].lower() in _ROLE | _BUSINESS or whole[0].lower() in common and whole[0].lower() not in family:
            continue
        if len(first) > 1 and len(first[0]) > 1 and (first[-1].islower() or first[-1].lower() in _ROLE | _BUSINESS or first[-1].lower() in common):
            e = s + len(re.split(r",? ", m[1], maxsplit=1)[0])
        spans[s, e] = [False, any(x.lower() in family for x in first)]
    for m in _cued(text, low_text, _CUED_LOW) if family else ():
        if m[2] in family and not any(a < m.end(1) and m.start(1) < b for a, b in spans):
            spans[m.span(1)] = [False, True]
    for (s, e), (g, f) in spans.items():
        if any(a < e and s < b for a, b in taken):
            continue
        left, right = text[max(0, s - 30) : s], text[e : e + 30]
        prev = _CONTEXT.findall(left)
        nxt = _CONTEXT.findall(right)
        p, n = (prev[-1].lower() if prev else ""), (nxt[0] if nxt else "")
        business = bool(n) and n.lower() in _BUSINESS and right[:1] == " " and n[:1].isupper() or p in ("mt", "mount", "st")
        first = text[s:e].split()[0].strip(",").lower()
        yield Candidate("name", s, e, _vote(True if g else None, True if f else None, True if _NAME_BEFORE.search(left) or p in _TITLE and left.rstrip(" .").lower().endswith(p) else None, True if _NAME_AFTER.match(right) else None, False if business else None, False if first in _ROLE else None, False if p in ("the", "a", "an", "der", "die", "das", "la", "le", "el", "il") else None), int(text[s].isupper()))


def candidates(text: str | None, given: frozenset[str], family: frozenset[str] = frozenset(), common: frozenset[str] = frozenset()) -> list[Candidate]:
    """All candidate spans of a text with the votes of their kind's labelers (1 for, -1 against, 0 silent)."""
    if not text:
        return []
    out: list[Candidate] = []
    low = text.lower()
    taken = [m.span() for m in _HANDLE.finditer(text)] if "@" in text or "<" in text or "http" in text or "www." in text else []
    if "@" in text or "＠" in text or " at " in low or "at)" in low or "at]" in low or "arroba" in low or "at}" in low or "at>" in low:
        for m in _EMAIL.finditer(text):
            s, e = m.span()
            found = m[0]
            before, _, last = _around(text, s, e)
            sign = "@" in found or "＠" in found
            bracket = bool(re.search(r"[(\[{<]\w+[)\]}>]", found))
            spoken = bool(re.search(rf" (?:at|arroba) [\w-]+(?: (?:dot|punto|punkt|point|ponto) )", found, re.I))
            number = bool(re.fullmatch(r".* at \d+[.:]\d+.*", found)) or found.rpartition(".")[2].isdigit()
            out.append(Candidate("email", s, e, _vote(True if sign else None, True if bracket else None, True if spoken else None, True if before & {"mail", "email", "contact", "write", "address", "adresse", "correo", "escriban", "écrivez", "schreib", "scrivete", "escrevam", "spammed", "reach"} else None, False if not (sign or bracket or spoken) else None, False if number else None, False if re.search(r"https?:|/", found) else None), 0))
            taken.append((s, e))
    if any(c.isdigit() for c in text):
        urls = taken
        for c in _number_candidates(text):
            if not any(a < c.end and c.start < b for a, b in urls):
                out.append(c)
        for s, e, plain in sorted((*m.span(), plain) for hint, form, plain in _ADDRESSES if hint.search(low) for m in form.finditer(text)):
            if any(a < e and s < b for a, b in taken):
                continue
            before, after, last = _around(text, s, e)
            out.append(Candidate("address", s, e, _vote(True if plain else None, True if before & _LIVE else None, False if before & _OPEN else None, False if before & _THING and not before & _LIVE else None, False if last in ("$", "€") else None), int(text[s].isdigit())))
            taken.append((s, e))
    out += _name_candidates(text, low, given, family, common, taken)
    return out


_COLS = "kind string, start_pos int, end_pos int, found string, votes string, shape int"


def _looked_up(text: str) -> set[str]:
    """Every form in which ``candidates`` may look up a word of the text."""
    whole = {w.lower() for w in _WORD.findall(text)}
    return whole.union(_CONTEXT.findall(text.lower()), (w.lower() for w in _CONTEXT.findall(text)), *(w.split("-") for w in whole if "-" in w))


def _split_kinds(kinds: dict[str, int]) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    return tuple(frozenset(w for w, k in kinds.items() if k & bit) for bit in (GIVEN, FAMILY, EVERYDAY))


def _rare_words(records: DataFrame, text_col: str, rest: DataFrame, shared) -> DataFrame:
    """``_text, _words``: the words of ``rest`` that the texts with that hash hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            ids, words = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = [x for x in _looked_up(text) if x and x not in known]
                ids += [i] * len(w)
                words += w
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["_text", "_w"])

    texts = records.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("_text"), text_col)
    met = texts.mapInArrow(run, "_text long, _w string").join(rest.select("word", "kinds"), F.col("_w") == F.col("word"))
    return met.groupBy("_text").agg(F.collect_set(F.struct("word", "kinds")).alias("_words"))


def personal_candidates(records: DataFrame, key: str, text_col: str, words: DataFrame, most: int = MOST_SHARED) -> DataFrame:
    """``key, kind, start_pos, end_pos, found, votes, shape`` of every candidate span of every text.

    ``words`` (see ``learn_words``) goes to the workers, without a shuffle. If it has more than ``most`` rows, the most
    frequent go there and the texts' other words are looked up by a join, so that none is left out.
    """
    top = words.orderBy(F.desc("n"), "word").limit(most + 1).collect()
    shared = records.sparkSession.sparkContext.broadcast({r["word"]: r["kinds"] for r in top[:most]})
    rows = records.select(key, F.col(text_col).alias("_t")).filter("_t <> ''")
    if len(top) > most:
        last = top[most]
        rest = words.filter((F.col("n") < last["n"]) | (F.col("n") == last["n"]) & (F.col("word") >= last["word"]))
        rare = _rare_words(records, text_col, rest, shared)
        rows = rows.join(rare, F.xxhash64("_t") == F.col("_text"), "left").select(key, "_t", "_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sets = _split_kinds(known)
        for b in batches:
            keys, out = [], []
            for i, (k, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if b.num_columns > 2 and text:
                    own = {w: known[w] for w in _looked_up(text) if w in known}
                    sets = _split_kinds(own | {w["word"]: w["kinds"] for w in b.column(2)[i].as_py() or ()})
                for c in candidates(text, *sets):
                    keys.append(k)
                    out.append((c.kind, c.start, c.end, text[c.start : c.end], "".join("-0+"[v + 1] for v in c.votes), c.shape))
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], [key, "kind", "start_pos", "end_pos", "found", "votes", "shape"])

    return rows.mapInArrow(run, f"`{key}` {records.schema[key].dataType.simpleString()}, {_COLS}")


@dataclass
class SpanModel:
    """Reliability of each labeler by kind (from EM), and the weights of the final classifier of each kind."""

    reliability: dict[str, list[float]] = field(default_factory=dict)
    weights: dict[str, list[float]] = field(default_factory=dict)

    def probability(self, kind: str, votes: str, shape: int) -> float:
        w = self.weights[kind]
        x = _features(votes, shape)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))


def _features(votes: str, shape: int) -> list[float]:
    v = ["-0+".index(c) - 1 for c in votes]
    return [1.0, float(shape), *map(float, v), float(sum(x > 0 for x in v) >= 2), float(sum(x < 0 for x in v) >= 1)]


def fit_span_model(patterns: Sequence[tuple[str, str, int, int]], rounds: int = 30, prior: float = 0.5, trust: float = 0.85, strength: float = 40.0) -> SpanModel:
    """EM over the vote patterns (kind, votes, shape, count) of all candidates, then a logistic classifier on its posteriors.

    Each labeler has one reliability, the chance that its vote is right, with a beta prior of mean ``trust``; silent
    labelers say nothing. The classifier is trained on every pattern, weighted by its count.
    """
    model = SpanModel()
    by: dict[str, list[tuple[str, int, int]]] = defaultdict(list)
    for kind, votes, shape, n in patterns:
        by[kind].append((votes, shape, n))
    for kind, rows in by.items():
        v = np.array([["-0+".index(c) - 1 for c in r[0]] for r in rows], float)
        n = np.array([r[2] for r in rows], float)
        rel, share = np.full(v.shape[1], trust), prior
        for _ in range(rounds):
            logit = math.log(share / (1 - share)) + v @ np.log(rel / (1 - rel))
            q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            right = np.where(v > 0, q[:, None], np.where(v < 0, 1 - q[:, None], 0)) * n[:, None]
            cast = (v != 0) * n[:, None]
            # the prior weighs as much as a tenth of the votes, so that a labeler's fame rests on all data, yet none turns against its nature
            s = strength + 0.1 * cast.sum(0)
            rel = np.clip((right.sum(0) + s * trust) / (cast.sum(0) + s), 0.55, 0.995)
            share = float(np.clip((q @ n + 10 * prior) / (n.sum() + 10), 0.05, 0.95))
        logit = math.log(prior / (1 - prior)) + v @ np.log(rel / (1 - rel))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        x = np.array([_features(r[0], r[1]) for r in rows])
        w = np.zeros(x.shape[1])
        weight = np.sqrt(n) / np.sqrt(n).sum()
        for _ in range(60):  # Newton steps of a ridge-regularised logistic fit to soft labels
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - q)) + 1e-4 * w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
            w = w - np.linalg.solve(h, g)
        model.reliability[kind], model.weights[kind] = rel.tolist(), w.tolist()
    return model



def learn_words(records: DataFrame, text_col: str, given: DataFrame, least: int = 3, most: int = MOST_SHARED) -> DataFrame:
    """``word, kinds, n``: one row for each word of the gazetteer; ``kinds`` adds up GIVEN, FAMILY and EVERYDAY. No list is cut.

    ``given`` holds the given names, in lower case, in its column ``word``. Everyday words stand in lower case at least
    ``least`` times in all; family names are the other words that follow a given name. Counted over all texts, with
    partial counts per partition. Up to ``most`` given names go to the workers; more are joined with the pairs of words.
    """
    few = given.select("word").limit(most + 1).collect()
    shared = records.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in few) if len(few) <= most else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, counts = shared.value, Counter()
        words, pair = re.compile(r"[^\W\d_]+"), re.compile(rf"\b([^\W\d_]+)(?:-[^\W\d_]+)? (?:[A-Z]\. )?({_CAP})")
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    if "@" in text or " dot " in text or "at)" in text or "at]" in text:
                        text = _EMAIL.sub(" ", text)
                    found = words.findall(text)
                    counts.update(found)
                    if g is None:
                        counts.update(f"{m[1].lower()}\x1f{m[2].lower()}" for m in pair.finditer(text) if len(m[2]) > 2)
                    elif not g.isdisjoint(x.lower() for x in found):
                        counts.update("\x1f" + m[2].lower() for m in pair.finditer(text) if m[1].lower() in g and m[2].lower() not in g and len(m[2]) > 2)
            if len(counts) > 300_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    counted = durable(records.select(text_col).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    is_pair = F.contains("w", F.lit("\x1f"))
    everyday = counted.filter(~is_pair & (F.col("n") >= least) & (F.lower("w") == F.col("w"))).select(F.col("w").alias("word"), "n")
    after = counted.filter(is_pair).select(F.split_part("w", F.lit("\x1f"), F.lit(1)).alias("_g"), F.split_part("w", F.lit("\x1f"), F.lit(2)).alias("word"), "n")
    if len(few) > most:
        names = given.select(F.col("word").alias("_name"))
        after = after.join(names, F.col("_g") == F.col("_name"), "left_semi").join(names, F.col("word") == F.col("_name"), "left_anti")
    after = after.filter(~F.col("word").isin(*sorted(_ROLE | _BUSINESS)))
    kinds = [(given.withColumn("n", F.lit(0).cast("long")), GIVEN), (after, FAMILY), (everyday, EVERYDAY)]
    every = reduce(DataFrame.unionAll, (d.select("word", "n", F.lit(k).alias("k")) for d, k in kinds))
    one = every.groupBy("word").agg(F.bit_or("k").alias("k"), F.max("n").alias("n"))
    # a family name that is an everyday word as well is none
    k = F.col("k")
    return one.select("word", F.when(k.bitwiseAND(EVERYDAY) > 0, k.bitwiseAND(GIVEN | EVERYDAY)).otherwise(k).alias("kinds"), "n")


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    kept = [(w, n) for w, n in counts.items() if "\x1f" in w or w == w.lower()]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["w", "n"])


def find_personal(records: DataFrame, key: str, text_col: str, given: Sequence[str] | DataFrame, threshold: float = 0.5, most: int = MOST_SHARED) -> DataFrame:
    """``key, kind, start_pos, end_pos, found, probability``: the personal data in every text.

    Regular expressions, a gazetteer (``given``, a list or the first column of a table, plus the family names seen after
    them) and context words vote on every candidate span; EM over all candidates' vote patterns estimates each labeler's
    reliability; the classifier trained on the resulting posteriors decides. No word of the gazetteer is left out: up to
    ``most`` are broadcast, more are joined. Where spans of one kind overlap, the longest stays. Candidates are written once
    (checkpoint) and their patterns, at most a few thousand, are counted on the executors. Null and empty texts give no row.
    """
    require_columns(records, [key, text_col], "find_personal")
    spark = records.sparkSession
    names = given if isinstance(given, DataFrame) else spark.createDataFrame([(g,) for g in given], "word string")
    names = durable(names.select(F.lower(F.col(names.columns[0])).alias("word")).filter("word <> ''").distinct())
    words = durable(learn_words(records, text_col, names, most=most))
    found = durable(personal_candidates(records, key, text_col, words, most))
    patterns = [(r["kind"], r["votes"], r["shape"], r["count"]) for r in found.groupBy("kind", "votes", "shape").count().collect()]
    if not patterns:
        return found.select(key, "kind", "start_pos", "end_pos", "found", F.lit(0.0).alias("probability"))
    model = fit_span_model(patterns)
    table = spark.createDataFrame([(k, v, s, float(model.probability(k, v, s))) for k, v, s, _ in patterns], "_k string, _v string, _s int, probability double")
    scored = found.join(F.broadcast(table), (F.col("kind") == F.col("_k")) & (F.col("votes") == F.col("_v")) & (F.col("shape") == F.col("_s")))
    return scored.filter(F.col("probability") >= threshold).select(key, "kind", "start_pos", "end_pos", "found", "probability")


def redact(records: DataFrame, key: str, text_col: str, spans: DataFrame) -> DataFrame:
    """``key, redacted``: every text with each span of ``find_personal`` replaced by its kind in angle brackets.

    A text without spans stays as it is, null stays null. A review's spans are bounded by its own length.
    """
    require_columns(records, [key, text_col], "redact")
    one = spans.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", "kind"))).alias("_spans"))
    rows = records.select(key, text_col).join(one, F.col(key) == F.col("_key"), "left")
    # from left to right: what lies before a span, its placeholder, and where the rest begins; overlapping spans merge into the first
    step = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start_pos"] < acc["at"], F.struct(acc["done"].alias("done"), F.greatest(acc["at"], s["end_pos"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["done"], F.substring(F.col(text_col), acc["at"] + 1, s["start_pos"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("done"), s["end_pos"].alias("at"))
        ),
        lambda acc: F.concat(acc["done"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))),
    )
    return rows.select(key, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(step).alias("redacted"))
