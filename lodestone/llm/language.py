"""Language of documents and of mixed-language segments from language-bitmask n-gram filters."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.sentences import sentence_spans
from lodestone.schema import require_columns

# --- fixed values ---
LANGUAGES = ("en", "es", "fr", "de", "it", "pt", "nl", "ru", "hi", "ar", "ja", "zh", "th")
#: Other notations of the languages: ISO 639-2/3 codes and names.
NOTATIONS = {
    "en": "eng english inglés anglais englisch", "es": "spa spanish español castellano castilian", "fr": "fra fre french français francais",
    "de": "deu ger german deutsch", "it": "ita italian italiano", "pt": "por portuguese português portugues", "nl": "nld dut dutch nederlands flemish",
    "ru": "rus russian русский", "hi": "hin hindi हिन्दी हिंदी", "ar": "ara arabic العربية", "ja": "jpn japanese 日本語", "zh": "zho chi cmn chinese mandarin 中文", "th": "tha thai ไทย",
}
#: Frequent words of each language, for a start before any text is seen.
SEEDS = {
    "en": "the and was is are were with for this that not have has had but they you our we it of to in on at from my their his her very been as be which when after before so about there here will would could if or an all just only again never good great place food service really too no who what because than then them did do does one out up down even more most some any other into over",
    "es": "el la los las de que y en un una es por con para no se su lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras nuestro nuestra nunca bien fue está son era",
    "fr": "le la les de des du et en un une est pour pas que qui dans sur avec ce cette il elle nous vous ils au aux ne se plus par mais ou où son sa ses leur très bien été était sont fait tout tous comme si je mon ma mes notre votre c'est d'un d'une l'on jamais sans chez après avant même aussi rien",
    "de": "der die das und ist war nicht ein eine einen einem einer zu den dem des mit von für auf im in am an sich auch es ich wir sie er als aus bei nach vor aber oder wie noch nur so sehr hat haben hatte sind waren uns mich mein meine ihr unser über um wenn dass weil kein keine nie wieder mehr immer schon zum zur",
    "it": "il lo la i gli le di e è un una uno che non per con in del della dei delle al alla ai da dal dalla nel nella sono era ma più anche come se mi ci si ha ho hanno molto tutto tutti questo questa quando dove dopo prima senza sempre mai nostro nostra mio mia suo ed cosa così solo ancora",
    "pt": "o a os as de do da dos das e é um uma que não em no na nos nas por para com se mais mas como foi ao à pelo pela ou ele ela seu sua quando muito já eu também só até isso entre era depois sem mesmo nosso nossa meu minha nunca tudo está são ser ter você bem lá",
    "nl": "de het een en van is was niet dat die in op te met voor aan er maar om ook als dan zijn had hij ze we wij ik je mijn ons onze naar bij nog uit door over heel veel meer kan werd werden hebben heeft nooit weer geen wel deze dit daar hier toen na alles zeer erg",
    "ru": "и в не на я что он с как это по но они мы за из у от так же все был была было были для бы вы до если мне нас очень только ещё еще уже никогда больше нет",
    "hi": "और का की के में है हैं को से पर ने यह वह एक नहीं हम मैं था थी थे भी बहुत कि जो तो कर हो",
    "ar": "في من على إلى أن هذا هذه التي الذي لم لا ما كان كانت مع عن كل بعد قبل جدا ولم لن هل",
    "ja": "の に は を た が で て と し れ さ です ます ました も な い か",
    "zh": "的 了 是 我 不 在 有 他 这 们 个 很 也 都 就 和 说 没 吗 吧",
    "th": "ที่ และ ใน เป็น ไม่ มี ของ ได้ ว่า มาก การ ให้ กับ จะ",
}
#: Scripts that leave few languages, as ranges of code points.
SCRIPTS = {
    "Latin": ("A-Za-zÀ-ɏḀ-ỿ", "en es fr de it pt nl"), "Cyrillic": ("Ѐ-ӿ", "ru"), "Devanagari": ("ऀ-ॿ", "hi"), "Arabic": ("؀-ۿݐ-ݿ", "ar"),
    "Kana": ("぀-ヿ", "ja"), "Han": ("㐀-䶿一-鿿", "zh ja"), "Thai": ("฀-๿", "th"),
}
# --- end of fixed values ---

_CANON = {n: lang for lang, names in NOTATIONS.items() for n in names.split()} | {x: x for x in LANGUAGES}
_BIT = {lang: i for i, lang in enumerate(LANGUAGES)}
_SCRIPT_OF = [(re.compile(f"[{r}]"), name) for name, (r, _) in SCRIPTS.items()]
_TOKEN = re.compile(rf"[{SCRIPTS['Kana'][0]}]|[{SCRIPTS['Han'][0]}]|[{SCRIPTS['Thai'][0]}]+|[ऀ-ॿ]+|(?:(?![{SCRIPTS['Kana'][0]}{SCRIPTS['Han'][0]}{SCRIPTS['Thai'][0]}])[^\W\d_])+(?:['’](?=[^\W\d_]))?")
_NOISE = re.compile(r"<(script|style|a)\b[^<>]{0,500}>.{0,2000}?</\1\s*>|<[^<>]{1,500}>|&[a-z]{2,6};|https?://\S+|www\.\S+|\S+@\S+|@\w+", re.I | re.S)
#: Bits per language count in a packed sum; texts of more n-grams than this holds are summed piece by piece.
_W = 24
_ONE = [1 << (_W * i) for i in range(len(LANGUAGES))]


def canonical_language(label: Column) -> Column:
    """A label in any notation as one of LANGUAGES, else null."""
    table = F.create_map(*[F.lit(x) for kv in _CANON.items() for x in kv])
    low = F.lower(F.trim(label.cast("string")))
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.regexp_extract(low, r"^(\p{L}+)[-_ ]", 1)))


def _fold(w: str) -> str:
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def _script(token: str) -> str:
    return next((n for p, n in _SCRIPT_OF if p.match(token)), "")


def ngrams(token: str) -> list[str]:
    """A token's n-grams: the token itself, its padded 3- and 4-grams, its script."""
    p = f"_{token}_"
    out = [f"#{_script(token)}", p]
    if len(token) > 1:
        out += [p[i : i + 3] for i in range(len(p) - 2)]
    if len(token) > 2:
        out += [p[i : i + 4] for i in range(len(p) - 3)]
    return out


@dataclass
class BitmaskFilter:
    """A Bloom filter for all languages at once: each slot holds one bit per language; an n-gram's languages are the AND of its slots."""

    slots: np.ndarray
    hashes: int = 3
    prior: list[float] = field(default_factory=lambda: [0.0] * len(LANGUAGES))
    cache: dict[str, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def build(cls, masks: dict[str, int], size_log2: int = 20, hashes: int = 3) -> BitmaskFilter:
        f = cls(np.zeros(1 << size_log2, np.uint16), hashes)
        for g, m in masks.items():
            for i in f._places(g):
                f.slots[i] |= m
        return f

    def _places(self, gram: str) -> list[int]:
        h, n = xxhash.xxh64_intdigest(gram), len(self.slots) - 1
        a, b = h & 0xFFFFFFFF, h >> 32 | 1
        return [(a + i * b) & n for i in range(self.hashes)]

    def languages(self, gram: str) -> int:
        m = 0xFFFF
        for i in self._places(gram):
            m &= int(self.slots[i])
        return m

    def false_positive_rates(self) -> np.ndarray:
        return np.array([float((self.slots >> i & 1).mean()) ** self.hashes for i in range(len(LANGUAGES))])

    def counts(self, token: str) -> tuple[int, int]:
        """Per-language popcounts of a token's n-grams, packed into one integer, and the number of n-grams."""
        c = self.cache.get(token)
        if c is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
            packed, grams = 0, ngrams(token)
            for g in grams:
                m = self.languages(g)
                while m:
                    low = m & -m
                    packed += _ONE[low.bit_length() - 1]
                    m ^= low
            c = self.cache[token] = (packed, len(grams))
        return c

    def __getstate__(self):
        return {"slots": self.slots, "hashes": self.hashes, "prior": self.prior, "cache": {}}

    def scores(self, text: str, rates: np.ndarray) -> tuple[list[float], int]:
        """Popcount per language corrected for false positives, and the number of tokens."""
        tokens = _TOKEN.findall(text.lower())
        total = [0] * len(LANGUAGES)
        grams = 0
        for at in range(0, len(tokens), 100_000):
            packed = 0
            for t in tokens[at : at + 100_000]:
                p, n = self.cache.get(t) or self.counts(t)
                packed += p
                grams += n
            for i in range(len(total)):
                total[i] += packed >> (_W * i) & ((1 << _W) - 1)
        return [(c - r * grams) / (1 - r) for c, r in zip(total, rates.tolist())], len(tokens)


def _masks(texts: dict[str, list[str]], ratio: float, seeds: bool) -> dict[str, int]:
    """The languages of each n-gram: those in which it is at most ``ratio`` times rarer than where it is most frequent."""
    freq: dict[str, dict[str, float]] = defaultdict(dict)
    for lang in LANGUAGES:
        words = Counter(t for x in texts.get(lang, ()) for t in _TOKEN.findall(x.lower()))
        for w, n in list(words.items()):
            if (f := _fold(w)) != w and lang not in ("ja", "hi", "ar", "th", "ru"):
                words[f] += n
        grams: Counter[str] = Counter()
        for w, n in words.items():
            for g in ngrams(w)[1:]:
                grams[g] += n
        total = sum(grams.values()) + 2000
        for g, n in grams.items():
            freq[g][lang] = n / total
    out = {}
    for g, by in freq.items():
        top = max(by.values()) / ratio
        out[g] = sum(1 << _BIT[lang] for lang, p in by.items() if p >= top)
    if seeds:
        for lang, words in SEEDS.items():
            for w in words.split():
                for g in {f"_{w}_", f"_{_fold(w)}_"}:
                    out[g] = out.get(g, 0) | 1 << _BIT[lang]
    for name, (_, langs) in SCRIPTS.items():
        out[f"#{name}"] = sum(1 << _BIT[x] for x in langs.split())
    return out


def _plain(text: str) -> str:
    """``text`` with markup and links blanked, every place kept."""
    if "<" in text or "@" in text or "://" in text or "www." in text or "&" in text:
        return _NOISE.sub(lambda m: ("\n" if m[0][0] == "<" and m[0][1:3].lower() in ("br", "p>", "/p", "p ") else " ") + " " * (len(m[0]) - 1), text)
    return text


def _best(scores: list[float]) -> tuple[int, float]:
    top = max(range(len(scores)), key=scores.__getitem__)
    second = max(s for i, s in enumerate(scores) if i != top)
    return top, scores[top] - second


def train_filter(labelled: Iterable[tuple[str, str]], ratio: float = 6.0, counts: dict[str, int] | None = None) -> BitmaskFilter:
    """Fit the filter on (language, text) pairs whose labels may be wrong and whose texts may be mixed.

    A first filter of frequent words and scripts judges each sentence; a sentence counts for its text's label if nothing
    speaks against it, else for the language found if the evidence is clear, else not at all. The filter so trained
    judges them again, and the last one is built from its verdicts. ``counts`` (rows of each language) break ties.
    """
    model = BitmaskFilter.build(_masks({}, ratio, True), 16)
    rows: list[tuple[str, str]] = []
    for label, text in labelled:
        if label in _BIT and text:
            plain = _plain(text)
            rows += [(label, plain[s:e]) for s, e in sentence_spans(plain)]
    for against, clear in ((0.5, 2.5), (0.5, 2.0)):
        rates = model.false_positive_rates()
        texts: dict[str, list[str]] = {lang: [words] for lang, words in SEEDS.items()}
        for label, x in rows:
            scores, n = model.scores(x, rates)
            if not n:
                continue
            top, margin = _best(scores)
            if scores[top] - scores[_BIT[label]] <= against:
                texts[label].append(x)
            elif margin >= clear:
                texts[LANGUAGES[top]].append(x)
        model = BitmaskFilter.build(_masks(texts, ratio, True))
    if counts:
        most = max(counts.values())
        model.prior = [0.6 * math.log((counts.get(x, 0) + 1) / (most + 1)) for x in LANGUAGES]
    return model


def language_segments(text: str | None, model: BitmaskFilter, rates: np.ndarray, least_margin: float = 3.0) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the longest stretches in one language; none for a text without words.

    Sentences are judged one by one; one whose best language is less than ``least_margin`` n-grams ahead of the next
    joins its neighbour. Confidence is the stretch's lead over the second language, relative to its best count.
    """
    if not text:
        return []
    plain = _plain(text)
    pieces = []
    for s, e in sentence_spans(plain):
        scores, n = model.scores(plain[s:e], rates)
        if n:
            scores = [x + p for x, p in zip(scores, model.prior)]
            top, margin = _best(scores)
            pieces.append([s, e, top, margin, scores])
    if not pieces:
        return []
    total = [sum(x) for x in zip(*(p[4] for p in pieces))]
    sure = [p for p in pieces if p[3] >= least_margin]
    if not sure:
        top, margin = _best(total)
        groups = [[pieces[0][0], pieces[-1][1], top, total]]
    else:
        known = None
        for p in pieces:
            if p[3] >= least_margin:
                known = p[2]
            elif known is not None and p[4][known] >= p[4][p[2]] - least_margin:
                p[2] = known
        groups = []
        nxt = None
        for p in reversed(pieces):
            if p[3] >= least_margin:
                nxt = p[2]
            elif nxt is not None and p[4][nxt] >= p[4][p[2]] - least_margin and not any(q[3] >= least_margin for q in pieces[: pieces.index(p)]):
                p[2] = nxt
        for s, e, top, _, scores in pieces:
            if groups and groups[-1][2] == top:
                groups[-1][1] = e
                groups[-1][3] = [a + b for a, b in zip(groups[-1][3], scores)]
            else:
                groups.append([s, e, top, list(scores)])
    out = []
    for s, e, top, scores in groups:
        rest = max(x for i, x in enumerate(scores) if i != top)
        out.append((s, e, LANGUAGES[top], round(max(0.0, min(1.0, (scores[top] - rest) / max(scores[top], 1e-9))), 4)))
    return out


def fit_language_filter(labelled: DataFrame, text_col: str, lang_col: str, key: str, per_language: int = 600) -> BitmaskFilter:
    """Fit on at most ``per_language`` labelled rows of each language, those with the smallest key hashes."""
    require_columns(labelled, [text_col, lang_col, key], "fit_language_filter")
    usable = labelled.select(F.col(text_col).alias("_t"), canonical_language(F.col(lang_col)).alias("_l"), F.xxhash64(key).alias("_h")).filter("_l is not null and length(_t) > 0")
    # a hash threshold for each language, from its count, gives about per_language rows without sorting a whole language
    counts = {r["_l"]: r["count"] for r in usable.groupBy("_l").count().collect()}
    cut = {lang: min(2**63 - 1, int(-(2**63) + min(1.0, per_language / n) * (2**64 - 1))) for lang, n in counts.items()}
    keep = F.lit(False)
    for lang, h in cut.items():
        keep = keep | ((F.col("_l") == lang) & (F.col("_h") <= F.lit(h)))
    rows = usable.filter(keep).orderBy("_h", "_t").limit(2 * per_language * len(LANGUAGES)).collect()
    return train_filter(((r["_l"], r["_t"]) for r in rows), counts=counts)


def detect_languages(records: DataFrame, key: str, text_col: str, model: BitmaskFilter, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, segment_no, lang, confidence, start_pos, end_pos``: each stretch of every text in one language.

    Markup, links and addresses belong to no language. Null, empty and wordless texts give no row. The filter is fitted
    beforehand (``fit_language_filter``), has a fixed size (2 MB) and is broadcast. No shuffle.
    """
    require_columns(records, [key, text_col, *keep], "detect_languages")
    cols = [key, *keep]
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rates = m.false_positive_rates()
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(len(cols)).to_pylist()):
                for n, (s, e, lang, conf) in enumerate(language_segments(text, m, rates)):
                    at.append(i)
                    rows.append((n, lang, conf, s, e))
            picked = [b.column(j).take(pa.array(at, pa.int64())) for j in range(len(cols))]
            z = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(picked + z, [*cols, "segment_no", "lang", "confidence", "start_pos", "end_pos"])

    out = T.StructType([T.StructField(c, records.schema[c].dataType) for c in cols] + [T.StructField("segment_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    return records.select(*cols, F.col(text_col).alias("_text")).mapInArrow(run, out)
