"""Sentence boundaries in any script: sentence-break character properties, abbreviations, quotations, list numbers."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import require_columns


_ALL = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))


def _class(prop: str) -> str:
    """All characters with a Unicode property, as the inside of a character class; made from the property, not listed."""
    runs = []
    for m in regex.finditer(f"(?V1)(?:{prop})+", _ALL):
        runs.append(re.escape(m[0][0]) + ("-" + re.escape(m[0][-1]) if len(m[0]) > 1 else ""))
    return "".join(runs)


# --- fixed values: abbreviations that end in a period, by language, lower case ---
#: A name, number or further word follows: these never end a sentence.
BEFORE_MORE = {
    "en": "mr mrs ms mx dr prof rev hon gen col capt lt sgt mt ft gov sen rep pres messrs mme mlle fig figs vol pp approx vs e.g i.e cf viz incl excl no nos ext tel",
    "es": "sr sra srta srs dr dra d dña ud uds prof ing lic avda av c/ núm num pág pag tel p.ej p ej aprox gral sto sta",
    "fr": "m mm mme mmes mlle dr pr env p.ex c.-à-d c.-a-d cf bd boul av tél tel vol fig st ste no",
    "de": "hr fr hrn herr dr prof dipl ing z.b z b d.h d h u.a u a i.d.r bzw ca vgl nr str tel st pers inkl exkl zzgl evtl ggf bspw",
    "it": "sig sig.ra sigg sig.na dott dott.ssa prof avv ing arch egr spett p.es es ca pag tel n v.le p.zza c.so",
    "pt": "sr sra srta dr dra prof eng av r n.o n.º n.ª p.ex p ex tel pág pag aprox lda",
    "nl": "dhr mevr mw mr dr drs prof ir ing ca d.w.z bijv bv o.a m.b.t i.p.v nl nr tel p.p max min",
    "ru": "т.е т е тыс млн млрд г ул д им проф др стр рис см т напр пр просп пер корп кв тел г-н г-жа",
    "hi": "डॉ श्री श्रीमती प्रो रु सं पं",
    "ar": "د أ م ص ت ج",
    "th": "ดร นาย นาง ถ ซ พ ศ ค โทร",
}
#: May also end a sentence: what follows decides.
EITHER = {
    "en": "etc p.m a.m p m a inc ltd co corp jr sr st ave rd blvd ln d.i.y u.s u.k u.s.a ph.d est dept apt bldg min",
    "es": "etc a.m p.m s.a ee.uu blvd",
    "fr": "etc blvd apr j.-c",
    "de": "usw etc u.s.w u.ä jh gmbh uhr",
    "it": "ecc s.p.a s.r.l a.m p.m",
    "pt": "etc a.m p.m s.a ltda",
    "nl": "enz etc e.d p.p b.v n.v",
    "ru": "руб коп т.д т.п др гг вв",
}
#: Of these, the ones that never end a sentence only before a number.
BEFORE_NUMBER = frozenset("no nos fig figs vol pp p n nr núm num pág pag str стр рис tel тел ext nos".split())
#: Words after a number with a period, as in dates.
MONTHS = frozenset("januar februar märz maerz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez januari februari maart mei augustus".split())
#: What goes on after an ellipsis or an abbreviation in text without capitals.
GOES_ON = frozenset("and but so which or because although though while that who where y e pero así porque aunque que et mais donc car ou qui und aber oder denn dass weil ma però quindi perché mas por porque en maar want dus dat и а но поэтому".split())
#: Words that open an adverbial. It goes on after an abbreviation unless a comma shows that it opens a sentence.
ADVERBIAL = frozenset("in on at for after before with without during since until around under despite although while when as for from to by of thanks even compared right per over".split())
#: What goes on after an ellipsis: of these, not the words that also open sentences.
OPENS_TOO = frozenset("that who where when que qui while".split())
LONE = frozenset("well so oh hmm hm ah ok okay um uh er tja also na ja pues bueno bah beh allora enfin alors nou ну bom então".split())
TOP_DOMAINS = frozenset("com org net edu gov info biz io co uk de fr es pt nl ru th jp cn eu us example test invalid localhost".split())
# --- end of fixed values ---

_NEVER = frozenset(w for s in BEFORE_MORE.values() for w in s.split())
_EITHER = frozenset(w for s in EITHER.values() for w in s.split())
_STERM = _class(r"\p{Sentence_Break=STerm}")
_ATERM = _class(r"\p{Sentence_Break=ATerm}")
_SEP = "\n\r\x85  \x0b\x0c"
_PICTO = _class(r"[\p{Extended_Pictographic}--[0-9#*©®™]]") + "\U0001f1e6-\U0001f1ff\U0001f3fb-\U0001f3ff"
_JOIN = "︎️‍⃣"
_CLOSE = _class(r"[\p{Pe}\p{Pf}]") + "\"'”’“»›」』】〉》"
_EMOJI = f"(?:[{_PICTO}][{_JOIN}{_PICTO}]*)"
_FIRST = re.compile(f"[{_STERM}{_ATERM}…{_PICTO}{_SEP}]")
_FIRST_ASCII = re.compile(r"[.!?\n\r\x0b\x0c]")
_FIRST_THAI = re.compile(f"[{_STERM}{_ATERM}…{_PICTO}{_SEP} \xa0]")
_CANDIDATE = re.compile(rf"(?P<t>[{_STERM}{_ATERM}…]+)(?P<c>[{_CLOSE}{_JOIN}]*)(?P<e>(?:[^\S{_SEP}]*{_EMOJI})*)|(?P<p>{_EMOJI}(?:[^\S{_SEP}]*{_EMOJI})*)|(?P<n>\s*[{_SEP}]\s*)|(?P<s>[ \xa0]+)")
_NESTED = re.compile(r"\"[^\"\n]{1,400}\"|“[^”\n]{1,400}”|„[^“”\n]{1,400}[“”]|«[^»\n]{1,400}»|»[^«\n]{1,400}«|‹[^›\n]{1,400}›|「[^」\n]{1,400}」|『[^』\n]{1,400}』|\([^()\n]{1,400}\)|（[^（）\n]{1,400}）|\[[^\[\]\n]{1,400}\]|(?<![^\s(])['‘](?=\S)[^'‘’\n]{1,300}(?:['’](?=\w)[^'‘’\n]{1,300}){0,6}(?<=\S)['’](?!\w)")
_OPENERS = re.compile(r"[\"“„«»‹「『(（\['‘]")
_OPENING = "([{\"“„«‹'‘「『¿¡"
_NEXT = re.compile(r"[^\S]*[\"'“„«»‹「『(（\[¿¡—–-]*\s*(\w?)")
_NEXT_WORD = re.compile(r"\s*[\"'“„«¿¡]*([^\W\d_]+)")
_THAI = re.compile(r"[ก-๿]")
_SPACE = re.compile(r"\s*")
#: The rest of an address that is spelled out or spaced out.
_SPELLED = re.compile(r"[\w.+-]+ ?(?:[\[(]at[\])]|@|at [\w.-]+ dot\b)", re.I)
_DIGITS = re.compile(r"\d+\Z")
_PHRASE = re.compile(rf"[^,;{_STERM}{_ATERM}…]*")


def _continues(text: str, pos: int) -> bool:
    """Lower-case text after an abbreviation: does the sentence go on?"""
    m = _NEXT_WORD.match(text, pos)
    if not m:
        return bool(text[pos:].strip()[:1] in ",;:")
    w = m[1].lower()
    if w in GOES_ON:
        return True
    if w not in ADVERBIAL and not (w == "the" and text.startswith("the second time", m.start(1))):
        return False
    end = _PHRASE.match(text, m.start(1)).end()
    if text[end : end + 1] != ",":
        return True
    after = _NEXT_WORD.match(text, end + 1)
    return bool(after and after[1].lower() in GOES_ON)


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end, in code points, of each sentence of ``text``, without surrounding spaces.

    Together they cover everything but the spaces between them. None and blank texts have none.
    """
    if not text or text.isspace():
        return []
    cased = any(c.isupper() for c in text) if not text.islower() else False
    inside: list[tuple[int, int]] = [m.span() for m in _NESTED.finditer(text)] if _OPENERS.search(text) else []
    out, begin, n, k = [], _SPACE.match(text).end(), len(text), 0
    first = (_FIRST_ASCII if text.isascii() else _FIRST_THAI if _THAI.search(text) else _FIRST).search
    hit = first(text)
    while hit:
        m = _CANDIDATE.match(text, hit.start())
        at, end = m.span()
        hit = first(text, end)
        if end <= begin:
            continue
        while k < len(inside) and inside[k][1] <= at:
            k += 1
        nested = k < len(inside) and inside[k][0] < at
        if not nested and k < len(inside) and inside[k][0] < end:
            end = inside[k][0]  # what looks like a closing mark opens the next quotation
        if nested and end < inside[k][1]:
            continue
        if end >= n:
            break
        if m["s"] is not None:
            if nested or not _ends_thai(text, begin, at, end):
                continue
        elif m["n"] is not None:
            nxt = text[end : end + 1]
            if cased and nxt.islower() and text[at - 1 : at].isalnum() and m["n"].count("\n") < 2:
                continue
        elif m["p"] is not None:
            nxt = _NEXT.match(text, end)[1]
            if nested or (cased and nxt.islower()) or text[at - 1 : at].isspace() is False and nxt and not text[end].isspace():
                continue
        elif not _ends(text, m, begin, cased, nested and end >= inside[k][1], end):
            continue
        stop = len(text[:end].rstrip()) if text[end - 1].isspace() else end
        if stop > begin:
            out.append((begin, stop))
        begin = _SPACE.match(text, end).end()
    last = len(text.rstrip())
    if last > begin:
        out.append((begin, last))
    return out


def _ends_thai(text: str, begin: int, at: int, end: int) -> bool:
    """A space in Thai ends a sentence when the run before it has Thai and a word, not a number, follows."""
    run = text[max(begin, text.rfind(" ", begin, at) + 1) : at]
    if not _THAI.search(run) or not _NEXT.match(text, end)[1]:
        return False
    nxt = text[end]
    return nxt.isalpha() and not text.startswith(("และ", "แต่", "หรือ", "ๆ"), end)


def _ends(text: str, m: re.Match[str], begin: int, cased: bool, quoted: bool, end: int) -> bool:
    t, at = m["t"], m.start()
    nxt = _NEXT.match(text, end)[1]
    spaced = text[end].isspace()
    if m["e"]:
        return not (cased and nxt.islower())
    if quoted:
        # a quotation or bracket that holds whole sentences: the sentence around it ends only before a capital
        return spaced and cased and (nxt.isupper() or nxt.isdigit())
    period = t in (".", "．", "․", "﹒")
    ellipsis = "…" in t or t.count(".") > 1 and "!" not in t and "?" not in t
    if not period and not ellipsis:
        if t[-1] in "!?" or t[0] in "!?":
            return not nxt or not (cased and nxt.islower() and spaced and _joins(text, end))
        return text[end] not in ",，、;；:："
    if ellipsis:
        if nxt.islower():
            if cased:
                return False
            w = _NEXT_WORD.match(text, end)
            before = text[begin:at].strip().lower()
            return not (w and w[1].lower() in GOES_ON - OPENS_TOO or before in LONE or " " not in before and spaced)
        return nxt.isalnum() or not nxt
    words = text[max(begin, at - 40) : at].rsplit(None, 1)
    word = words[-1].lstrip(_OPENING).lower() if words and not text[at - 1].isspace() else ""
    if not spaced and end == m.end("t"):
        after = text[end]
        if after.isdigit() or not after.isalpha():
            return False
        left = text[at - 1 : at]
        if not left.isalnum() or len(word.rpartition(".")[2]) < 2 and not word[-1:].isdigit():
            return False
        run = text[text.rfind(" ", 0, at) + 1 : (text.find(" ", end) + 1 or len(text) + 1) - 1]
        if "@" in run or "://" in run or "(at)" in run or "[at]" in run or run.startswith("www."):
            return False
        prev = text[max(0, text.rfind(" ", 0, at) - 6) : text.rfind(" ", 0, at) + 1].rstrip().lower()
        if prev.endswith(("@", "[at]", "(at)")) or _SPELLED.match(text, end):
            return False
        right = re.match(r"\w+", text[end:])[0]
        if after.isupper():
            return True
        if cased and left.isalpha() and after.islower():
            return False
        return right.lower() not in TOP_DOMAINS and (len(right) > 1 or right in "aieyoи")
    if not nxt:
        return not word or text[end:].strip()[:1] not in (",", ";", ":", "")
    core = word.strip(",;:")
    if _DIGITS.search(core):
        if core.isdigit():
            before = text[begin : at - len(word)].rstrip()
            if not before or before[-1] in ",;:\n(":
                return False  # the number of a list entry
            w = _NEXT_WORD.match(text, end)
            if w and w[1].lower() in MONTHS and len(core) <= 2:
                return False
    elif core:
        short = core.rpartition(".")[2]
        initial = len(short) == 1 and short.isalpha()
        before = text[max(begin, at - len(word) - 5) : at - len(word)].rstrip()
        if core in MONTHS and before[-1:] in (".", *"0123456789") and before.rstrip(".")[-1:].isdigit():
            return False
        if core in BEFORE_NUMBER and not nxt.isdigit():
            return len(core) > 1 and not (cased and nxt.islower())
        name = core in _NEVER or short in _NEVER and "." in core
        either = core in _EITHER or short in _EITHER and "." in core
        if either and not (cased and core == "sr"):
            if nxt.islower():
                return False if cased else not _continues(text, end) and core not in ("st", "u.s", "inc", "d.i.y", "a", "p", "m", "co", "ave", "blvd", "sr", "p.p", "rd", "руб", "др")
            if core in ("p", "a", "st", "sr", "m") and not nxt.isdigit():
                # 'St.' after a capitalised name is a street; the others are parts of longer abbreviations
                before = text[begin : at - len(word)].split()
                return core == "st" and nxt.isupper() and bool(before) and before[-1][:1].isupper()
            return not nxt.isdigit()
        if name or initial:
            return False
    # a whole word and a period end a sentence even if the next one has no capital
    return not (cased and nxt.islower()) or len(core) > 3 and core.isalpha() and not _joins(text, end)


def _joins(text: str, pos: int) -> bool:
    m = _NEXT_WORD.match(text, pos)
    return not m or m[1].lower() in GOES_ON or m[1].lower() in ADVERBIAL


def _segment(key_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, starts, ends = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, e in sentence_spans(text):
                    keys.append(key)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key_name, "start_pos", "end_pos"])

    return run


def sentences(records: DataFrame, key: str, text_col: str) -> DataFrame:
    """``key, start_pos, end_pos``: the sentences of every record, in code points from 0, end exclusive.

    Terminators, closing marks and separators come from the Unicode sentence-break properties, so every script's are
    covered; abbreviations, initials, decimals, list numbers, ellipses and quotations inside a sentence do not end it;
    emoji after a sentence belong to it; spaces end Thai sentences; text without capitals is judged by what follows.
    Null, empty and blank texts have no sentence. No shuffle: a record's sentences depend on its own text only.
    """
    require_columns(records, [key, text_col], "sentences")
    out = T.StructType([T.StructField(key, records.schema[key].dataType), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    return records.select(key, F.col(text_col)).mapInArrow(_segment(key), out)
